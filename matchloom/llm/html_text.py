"""Main text of HTML pages by two passes of block rules.

Blocks are cut at block-level tags. What is marked as a menu, header, footer, sidebar, notice, advert, form or comment by
tag, role, class or id is no candidate. Pass one decides the other blocks by link density and by stop-word density with
length. Pass two gives the blocks left open, which are short, poor in stop words or links within running text, the label
of their nearest decided neighbours in the same part of the page: in an article element, or outside of any.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.common import ship, table, tidied

#: Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can could do for from had has have he her his how i if in into is it its more most no not of on one or other our out she so some such than that the
    their them then there these they this to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des deux du elle en est et être il ils je la le les leur lui mais me même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vous y à
    aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist kann mit nach nicht noch nur oder sich sie sind so über um und unter vom von vor war was werden wie wir wird zu zum zur
    al algo como con cual de del desde donde el ella ellas ellos en entre era es esta este esto está fue ha hay la las le lo los más mi muy ni no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene un una uno y ya""".split()
)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the first ones hold no markup either.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
SILENT = frozenset("head template svg math canvas object audio video select datalist button applet map".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class and id that mark what is no article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adsbox banner banners sponsor sponsored sponsors promo promos promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs
    footer footers masthead topbar cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay comment comments commentlist commenters disqus reply replies
    respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget widgets toolbar pagination pager copyright disclaimer paywall teaser teasers""".split()
)
KEPT_BEFORE = frozenset("with has no without".split())
#: Of these the ones that titles use, too: they mark only as the last part of a name, or before a word for a box.
ONLY_LAST = frozenset("notice notices alert alerts banner promotion share sharing social related recommended search comment comments reply replies respond copyright subscription widget login".split())
BOXES = frozenset("area bar block body box btn button buttons container content feed footer form group header holder icon icons inner item items links list message messages module outer panel post posts row section stream text thread title toggle top widget wrap wrapper".split())
#: Headings of reader comments; answers count as such only with their number.
COMMENT_HEADS = re.compile(r"^((\d+ )?(reader |user )?(comments?|kommentare?|commentaires?|comentarios?)( \(?\d+\)?)?|leave a (comment|reply)|\d+ (responses?|repl(y|ies))|(responses|replies) \(?\d+\)?):?$", re.I)
AT = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|[!?][^>]*>|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>)""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z", re.S)
WORDS = re.compile(r"[^\W\d_]+")
#: Marks that end or part sentences in scripts that don't part words by spaces.
SENTENCE_MARKS = re.compile("[\u3001\u3002\uff0c\uff0e\uff1a\uff1b\uff01\uff1f\u104a\u104b\u17d4\u0e2f]| (?=[\u0e00-\u0e7f])")
#: Limits: words share of links, stop words of a sure and of a likely block, code points of a long one.
LINKS, STOP_HIGH, STOP_LOW, LONG = 0.5, 0.30, 0.12, 140
#: Share of known stop words below which a page is in another language; letters of a short word there, and characters for a mark.
KNOWN, SHORT, PER_MARK = 0.06, 3, 6


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    region: int
    heading: bool
    running: bool = False
    label: str = ""


@dataclass
class _Open:
    tag: str
    outside: bool
    silent: bool
    region: int
    heading: bool
    running: bool = False


def _marked(tag: str, attrs: str, in_region: bool) -> bool:
    if tag in OUTSIDE or tag == "header" and not in_region:
        return True
    if tag in ("html", "body", "main") or "=" not in attrs and "hidden" not in attrs:
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = re.findall(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+", one)
                low = [p.lower() for p in parts]
                if any(p in MARKS and not (i and low[i - 1] in KEPT_BEFORE) and (p not in ONLY_LAST or i + 1 == len(low) or low[i + 1] in BOXES) for i, p in enumerate(low)):
                    return True
                if low == ["header"] and not in_region or low[-1:] == ["header"] and low[0] in ("site", "page", "main", "top", "global"):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, not yet labelled; blank ones are left out.

    An article or main element whose own class or id marks it as something else (a teaser, say) is outside of the article,
    unless the page has no other: then its name is taken to be a name only."""
    found = _blocks(page, False)
    return found if any(b.region and not b.outside for b in found) or not any(b.region for b in found) else _blocks(page, True)


def _blocks(page: str, trusting: bool) -> list[Block]:
    """trusting: article and main elements are taken for what they are, whatever their class and id."""
    out: list[Block] = []
    stack = [_Open("", False, False, 0, False)]
    words: list[str] = []
    places: dict[str, list[int]] = {}  # of each tag in the stack; under "" those of block-level tags
    linked, links, regions, breaks, after_head = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, after_head
        text = " ".join("".join(words).split())
        top = stack[-1]
        if text:
            level = int(top.tag[1]) if top.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0
            if level and after_head and level <= after_head:
                after_head = 0
            if level > 1 and len(text) < 60 and COMMENT_HEADS.match(text):
                after_head = level
            out.append(Block(text, min(linked, len(text)), top.outside or bool(after_head), top.region, top.heading, top.running))
        words.clear()
        linked = 0

    def close_to(n: int) -> None:
        nonlocal links
        for o in stack[n:]:
            links -= o.tag == "a"
            places[o.tag].pop()
            if o.tag in BLOCK:
                places[""].pop()
        del stack[n:]

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    i = 0
    while i < len(page):
        j = page.find("<", i)
        m = AT.match(page, j) if j >= 0 else None
        if j >= 0 and m is None:  # no tag: a plain character, or markup that the page's end cuts off
            if CUT.match(page, j):
                j, m = len(page) if j == i else j, None
                if j == len(page):
                    break
                page = page[:j]
            else:
                j += 1
        chunk = page[i : j if j >= 0 else len(page)]
        if chunk and not stack[-1].silent:
            t = entities.unescape(chunk) if "&" in chunk else chunk
            words.append(t)
            if links:
                linked += len(t.strip())
            if not t.isspace():
                breaks = 0
        if j < 0:
            break
        i = j
        if m is None:
            continue
        i = m.end()
        if m["start"]:
            tag, attrs = m["start"].lower(), m["attrs"] or ""
            if tag in RAW and not attrs.endswith("/"):
                shut = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, i)
                i = shut.end() if shut else len(page)
                continue
            if tag == "br":
                breaks += 1
                words.append(" ")
                if breaks == 2:
                    flush()
                continue
            if tag in BLOCK or tag == "head":
                flush()
                breaks = 0
                if tag == "body" and places.get("head"):
                    close_to(places["head"][0])
                k = last("")  # an open paragraph ends where a block starts, an item where the next one does
                if k and (stack[k].tag == "p" or stack[k].tag == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6")):
                    close_to(k)
            elif tag in ("img", "input"):
                words.append(" ")
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag != "a":
                continue
            top, article = stack[-1], tag in ("article", "main")
            outside = top.outside or not (article and trusting) and _marked(tag, attrs, top.region > 0)
            region = top.region
            if article and not top.outside:
                regions += region == 0
                region = region or regions
            heading = top.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            for name in (tag, "") if tag in BLOCK else (tag,):
                places.setdefault(name, []).append(len(stack))
            stack.append(_Open(tag, outside, top.silent or tag in SILENT, region, heading, tag == "p" or top.running and tag not in BLOCK))
            links += tag == "a"
        elif m["end"]:
            tag = m["end"].lower()
            at = last(tag)
            if tag in BLOCK or tag == "head":
                flush()
            if at and (tag in BLOCK or tag == "head" or last("") <= at):
                close_to(at)
    flush()
    return out


def stop_density(text: str, known: bool) -> float:
    """Share of stop words among the words; where the language isn't known, of words of at most SHORT letters, as function words are
    in most languages, or as many as PER_MARK for each sentence mark of scripts without spaces between words, if that is more."""
    words = WORDS.findall(text.lower())
    if not words:
        return 0.0
    if known:
        return sum(w in STOP_WORDS for w in words) / len(words)
    return max(sum(len(w) <= SHORT for w in words) / len(words), min(1.0, PER_MARK * len(SENTENCE_MARKS.findall(text)) / len(text)))


def in_known_language(found: list[Block]) -> bool:
    """Whether the longer blocks that may be text hold enough of the known stop words."""
    long = [w for b in found if not b.outside and 2 * len(b.text) >= LONG and b.linked <= LINKS * len(b.text) for w in WORDS.findall(b.text.lower())]
    return not long or sum(w in STOP_WORDS for w in long) >= KNOWN * len(long)


def first_pass(found: list[Block]) -> None:
    """Labels good or bad what is sure; leaves '' where it isn't: short blocks, headings, blocks poor in stop words, and
    paragraphs of an article that are mostly link."""
    known = in_known_language(found)
    for b in found:
        stops = stop_density(b.text, known)
        size = len(b.text)
        if b.outside or b.linked > LINKS * size and not (b.region and b.running):
            b.label = "bad"
        elif b.linked > LINKS * size or b.heading:
            b.label = ""
        elif size >= LONG and stops >= STOP_LOW or size >= LONG // 2 and stops >= STOP_HIGH:
            b.label = "good"
        elif not b.region and (size >= LONG and stops < STOP_LOW / 3 or size < LONG and "©" in b.text):
            b.label = "bad"


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest decided neighbour in their part of the page; at equal distance a
    heading follows the block after it and any other block is good if either side is. Within an article element the
    islands that are bad (adverts, link lists) are no neighbours. Where there are none, open blocks are good in an
    article element and bad elsewhere."""
    first = [b.label for b in found]
    before, after = _decided(found, first, range(len(found))), _decided(found, first, range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        if first[i]:
            continue
        near = [(abs(k - i), step, first[k]) for step, k in ((-1, before[i]), (1, after[i])) if k is not None]
        if not near:
            b.label = "good" if b.region else "bad"
        elif b.heading and near[-1][1] == 1:
            b.label = near[-1][2]
        else:
            least = min(near)[0]
            b.label = "good" if any(d == least and label == "good" for d, _, label in near) else "bad"


def _decided(found: list[Block], labels: list[str], order: range) -> list[int | None]:
    """For each block the last one passed in this order that is decided and may lend its label to its part of the page."""
    last: dict[int, int] = {}
    out: list[int | None] = [None] * len(found)
    for i in order:
        region = found[i].region
        out[i] = last.get(region)
        if labels[i] and not (region and labels[i] == "bad"):
            last[region] = i
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    first_pass(found)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html).

    Null, empty and textless html give an empty text. Repeated rows stay repeated; other columns are not read.
    Pages are read whole, however long; an empty table gives no rows. Markup that is cut off or never closed ends with the
    page. A block as near to a good as to a bad neighbour counts as good."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(tidied(run), f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts every page; see extract() for odd rows."""
    return extract(table(spark, sf_dir, "pages"))
