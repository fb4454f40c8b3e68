"""HTML extraction and URL filters."""

import html as entities
import re

import duckdb
from pyspark.sql import functions as F

from matchloom.llm import html_text, urls

LONG = "This is the long part of the story that was told by the people of the town and it is here for all of them to read as they want, with words that are in it."


def test_articles_of_the_tables(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        at, end = r.html.find("<article>"), r.html.find("</article>")
        parts = re.split(r"<(?:/?p|/?h1)>", r.html[at + 9 : end if end >= 0 else len(r.html)])
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert html_text.main_text(r.html) == "\n\n".join(p for p in parts if p)


def test_what_is_no_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body><header><p>{LONG}</p></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><main class="with-sidebar"><h1>Title &amp; more</h1><p>{LONG}<p>Short&nbsp;one.<div class='ad'>{LONG}</div><ul><li><a href=1>{LONG}</a></li></ul>
    <p>An <b>in</b>line <a href=y>link</a> in\n a short <i>block</i>.</p><form><p>{LONG}</p></form><section id="comments"><h2>Comments</h2><p>{LONG}</p></section></main><aside><p>{LONG}</p></aside><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == f"Title & more\n\n{LONG}\n\nShort one.\n\nAn inline link in a short block."


def test_density_rules_without_an_article_tag():
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>{LONG}</p><p>Brief.</p><p>{LONG}</p></div><div><a href=c>Three</a> | <a href=d>Four</a></div><div>© 2024</div></body>"
    assert html_text.main_text(page) == f"Head\n\n{LONG}\n\nBrief.\n\n{LONG}"


def test_comment_heading_without_marks():
    page = f"<article><h1>Head</h1><p>{LONG}</p><h2>3 Comments</h2><p>{LONG}</p></article>"
    assert html_text.main_text(page) == f"Head\n\n{LONG}"


def test_broken_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.main_text(f"<article><p>{LONG}<p>cut <b") == f"{LONG}\n\ncut"
    assert html_text.main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert html_text.main_text("<article><!-- x <p>no</p> --><p>yes</p></article><!-- open") == "yes"
    many = "<article>" + "<p>a<i title='x>" * 3000
    assert isinstance(html_text.main_text(many), str)
    assert html_text.main_text("<article><p>" + "word " * 200_000 + "</p></article>").count("word") == 200_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x", 1), (2, None, f"<article><p>{LONG}</p></article>", "x", 2), (2, None, f"<article><p>{LONG}</p></article>", "x", 2), (None, "v", "", None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, LONG, len(LONG)), (2, None, LONG, len(LONG)), (None, "v", "", 0)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []


URLS = [
    "http://Shop.Example.NET/en/a?x=1#f", "https://example.net/en/", "https://example.net/de/x", "https://example.net", "http://a.example.com/de/b", "http://example.com/en", "ftp://x.org/fr/1", "http://notexample.net.org/fr/2", "no scheme", "", None, "://", "http://cheap-pills.example.com/en/17/?utm_source=b",
    "HTTP://www.cheap-pills.example.com/en/17#top", "http://m.cheap-pills.example.com/other", "http://h:80/p://q?r", "http://xorg/fr/", "http://www.spam-farm.example.org/fr/z", "x://A/b\nc?d", "http://cheap-pills.example.com/en/17/?utm_source=b", "http://m.cheap-pills.example.com/en/17?page=2", "http://cheap-pills.example.com/en/20000", "http://spam-farm.example.org/es/19999/", "http://h/" + "long/" * 50_000,
]


def test_verdicts_match_sql(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, urls.op7_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.SQL})").fetchall())
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[0] == ("shop.example.net", "/en/a", "example.net/en/", "allow") and by_id[3] == ("example.net", "", None, "allow")
    assert by_id[8] == ("", "", None, "allow") and by_id[12][3] == by_id[13][3] == by_id[19][3] == by_id[22][3] == "block" and by_id[17][2:] == ("org/fr/", "allow")
    assert by_id[20][3] == by_id[21][3] == by_id[23][3] == "allow" and len(by_id[23][1]) == 250_001


def test_bloom_removes_no_listed_url(spark):
    every = spark.range(5000).selectExpr("concat('h/', id) AS canonical", "id")
    listed = every.where("length(canonical) % 2 = 0").select("canonical")
    for limit in (0, 8 << 20):
        found = urls.with_hits(every, listed.unionByName(listed), limit)
        assert found.count() == 5000 and sorted(r[0] for r in found.where("listed").collect()) == sorted(r[0] for r in listed.collect())
    assert urls.with_hits(every.limit(0), listed).count() == 0 and urls.with_hits(every, listed.limit(0)).where("listed").count() == 0


def test_exact_join_removes_what_the_filter_lets_through(spark, monkeypatch):
    from matchloom.llm import bloom

    monkeypatch.setattr(bloom, "PER_BLOCK", 400)  # a filter so full that it errs
    every = spark.range(4000).selectExpr("concat('h/', id) AS canonical")
    listed = every.where("hash(canonical) % 4 = 0")
    asked, _ = urls.probed(every, listed)
    assert asked.where("maybe").count() > listed.count()
    assert urls.with_hits(every, listed).where("listed").count() == listed.count()


def test_filter_keeps_other_rows_out_of_joins(spark):
    pages = spark.createDataFrame([(i, None if i % 2 else "http://popular.example.org/x") for i in range(50)], "page_id long, url string")
    out = urls.judge(pages, urls.spam_pages(spark))
    assert out.count() == 50 and {r.verdict for r in out.collect()} == {"allow"}


def test_the_earlier_of_equally_long_rules_fits(spark):
    tied = (urls.Rule("block", "x.b.org", "/"), urls.Rule("allow", "b.org", "/aa"))
    assert len({len(r.name) for r in tied}) == 1
    df = spark.createDataFrame([("ab.b.org", "/aa/"), ("x.b.org", "/aa/")], "host string, path string")
    for rules, want in ((tied, ["b.org/aa", "x.b.org/"]), (tied[::-1], ["b.org/aa", "b.org/aa"])):
        assert [r.r for r in df.select(urls.fitting_rule(F.col("host"), F.col("path"), rules).alias("r")).collect()] == want


PROSE = "The house that we had seen was on the hill, and it is not the only one of its kind that has been there for so long, as all of us know by now. " * 2


def test_nothing_of_the_article_is_lost():
    page = (
        f"<main><article><h1>On floods</h1><p>{PROSE}© by the agency.</p><h2>Responses to the flood</h2><p>{PROSE}</p><p><a href=x>{PROSE}</a></p><p>Short one.</p>"
        f"<h2>Comments (3)</h2><p>I know this very well, and I have seen that it was all like this.</p></article></main><footer>© 2024 Us</footer>"
    )
    want = ["On floods", " ".join((PROSE + "© by the agency.").split()), "Responses to the flood", PROSE.strip(), PROSE.strip(), "Short one."]
    assert html_text.main_text(page).split("\n\n") == want


def test_an_articles_own_name_is_no_mark():
    for attrs in ('class="related-story"', 'id="ad-2024"'):
        assert html_text.main_text(f"<nav>menu</nav><article {attrs}><p>{PROSE}</p></article>") == PROSE.strip()
    both = f'<article><p>{PROSE}</p></article><article class="teaser"><p>{PROSE}Other.</p></article>'
    assert html_text.main_text(both) == PROSE.strip()


def test_densities_decide_without_any_article_element():
    menu = "".join(f"<li><a href={i}>Section {i} of our site</a></li>" for i in range(12))
    page = f"<body><div>Top story</div><ul>{menu}</ul><h1>Heading</h1><div>{PROSE}</div><div>Short line.</div><div>{PROSE}</div><div>{'Lorem ipsum dolor sit amet consectetur. ' * 6}</div><ul>{menu}</ul><div>© Us</div></body>"
    found = html_text.blocks(page)
    html_text.first_pass(found)
    assert [b.label for b in found if b.text.startswith("Section")] == ["bad"] * 24 and [b.label for b in found if b.text == "Short line."] == [""]
    assert html_text.main_text(page).split("\n\n") == ["Heading", PROSE.strip(), "Short line.", PROSE.strip()]


def test_query_op2_reads_all_pages_whole(spark, sf_dir):
    rows = {r.page_id: r for r in html_text.op2_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        assert rows[p.page_id].text == html_text.main_text(p.html) and rows[p.page_id].n_chars == len(rows[p.page_id].text) and rows[p.page_id].url == p.url


def test_stray_and_unclosed_tags_take_linear_time():
    import time

    began = time.process_time()
    page = f"<article>{'<b>x' * 30_000}{'</i>' * 30_000}{'<div>y</div>' * 10_000}<p>{PROSE}</p></article>"
    assert PROSE.strip() in html_text.main_text(page)
    assert time.process_time() - began < 5


def test_names_and_headings_that_only_look_like_marks():
    page = f"""<article><h1>Head</h1><p class="notice-of-death">{PROSE}</p><h2>Responses</h2><p class="alert-system">{PROSE}</p><p class="cookie-notice">{PROSE}</p><div class="alert-box">{PROSE}</div>
    <p class="related-to-rain">{PROSE}</p><div class="related">{PROSE}</div><div class="share-buttons">{PROSE}</div><h2>2 Responses</h2><p>{PROSE}</p></article>"""
    assert html_text.main_text(page).split("\n\n") == ["Head", PROSE.strip(), "Responses", PROSE.strip(), PROSE.strip()]


def test_languages_without_a_list_of_stop_words():
    russian = "Дом, который мы видели на холме, не один такой, и он был там так долго, что все мы знаем о нём и не раз его видели, но кто в нём жил, не знал ни я, ни ты. " * 2
    chinese = "我们在山上看到的房子，不是唯一的一座。它在那里很久了，所以我们都知道；可是谁住在里面，没有人知道。" * 4
    thai = "บ้านที่เราเห็นบนเนินเขา ไม่ใช่หลังเดียว มันอยู่ที่นั่นมานานแล้ว ดังนั้นเราทุกคนจึงรู้ แต่ใครอยู่ข้างใน ไม่มีใครรู้ " * 3
    for text in (russian, chinese, thai):
        menu = "".join(f"<li><a href={i}>{text[:12]}</a></li>" for i in range(12))
        page = f"<body><ul>{menu}</ul><div>{text}</div><div>{text[:30]}</div><div>{text}</div><ul>{menu}</ul></body>"
        assert html_text.main_text(page).split("\n\n") == [text.strip(), text[:30].strip(), text.strip()]


def test_density_limits_decide_the_rows(spark, monkeypatch):
    """Without an article element the text is what the densities say: other limits give other texts, as told."""
    page = f"<body><div>{'The rain in the hills was long. ' * 5}</div><div>{PROSE}</div><div><a href=x>{PROSE}</a> and more of it</div></body>"
    rain = ("The rain in the hills was long. " * 5).strip()
    assert html_text.main_text(page).split("\n\n") == [rain, PROSE.strip()]
    monkeypatch.setattr(html_text, "STOP_LOW", 0.9)
    monkeypatch.setattr(html_text, "STOP_HIGH", 0.9)
    assert html_text.main_text(page) == ""
    monkeypatch.setattr(html_text, "LINKS", 1.0)
    monkeypatch.setattr(html_text, "STOP_LOW", 0.12)
    assert len(html_text.main_text(page).split("\n\n")) == 3
