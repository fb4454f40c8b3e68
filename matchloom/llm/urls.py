"""URL filters: rules by host and path, then a blocked Bloom filter before an exact join.

The list of canonical URLs is hashed into a Bloom filter whose blocks are rows of a table, 256 bits
each. A URL touches one block only, so probing is one equality join on the block number; the filter is
broadcast when its size, known from the count of listed URLs, is under `broadcast_bytes`, and joined by
shuffle beyond it. Only rows whose URL has all its bits set go to the exact hash join with the list, which removes false
positives; all others, among them those without a URL, are never shuffled by it. The list holds a URL once, and Spark
can split a partition with a very common one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bloom
from matchloom.llm.common import lower_ascii, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of op7; hosts, languages and numbers whose combinations make up its list of blocked pages.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
SPAM_HOSTS = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org")
SPAM_LANGUAGES, SPAM_PAGES = ("en", "fr", "de", "es"), 20_000


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end; A-Z lower-cased; empty where there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without www. or m., path without closing slashes, query without tracking parameters.

    Scheme and fragment go. Null and URLs without :// give null, which is never listed."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)="))), "&")
    base = F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(F.contains(url, F.lit("://")), F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the longest rule that fits, else null. Of equally long ones the earlier."""
    out = F.lit(None).cast("string")
    for _, _, r in sorted(((len(r.name), -i, r) for i, r in enumerate(rules)), key=lambda x: x[:2]):  # the last to fit stands
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def probed(rows: DataFrame, listed: DataFrame, broadcast_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """rows(canonical, ..) with `maybe`, false where the filter of listed(canonical) rules them out, and the list without repeats."""
    listed = listed.where(F.col("canonical").isNotNull()).select("canonical").distinct()
    blocks = bloom.blocks_for(listed.count())
    held = bloom.bloom_filter(listed, "canonical", blocks)
    if bloom.size_of(blocks) <= broadcast_bytes:
        return bloom.flagged(rows, "canonical", F.broadcast(held), blocks, "maybe").withColumn("maybe", F.col("maybe") & F.col("canonical").isNotNull()), listed
    # rows without a URL would all meet in one block
    asked = bloom.flagged(rows.where(F.col("canonical").isNotNull()), "canonical", held, blocks, "maybe")
    return asked.unionByName(rows.where(F.col("canonical").isNull()).withColumn("maybe", F.lit(False))), listed


def with_hits(rows: DataFrame, listed: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """rows(canonical, ..) with `listed`: whether the URL is in listed(canonical). Null is not."""
    asked, known = probed(rows, listed, broadcast_bytes)
    hits = asked.where("maybe").join(known.withColumn("hit", F.lit(True)).hint("shuffle_hash"), "canonical", "left").withColumn("listed", F.coalesce("hit", F.lit(False)))
    columns = [*[F.col(f"`{c}`") for c in rows.columns], "listed"]
    return asked.where("not maybe").withColumn("listed", F.lit(False)).select(*columns).unionByName(hits.select(*columns))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, canonical, rule, listed, verdict for each row of pages(page_id, url).

    The rule decides where one fits (the longest, of equally long ones the earlier); else listed URLs are blocked and
    others allowed. Null URLs, empty ones and such without :// have empty host and path, no canonical form, and are
    allowed. URLs are read whole, however long. Repeated rows stay repeated; an empty table gives none; other columns of
    pages are not carried."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(by_rule)
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return with_hits(rows, listed).withColumn("rule", rule).select("page_id", "host", "path", "canonical", "rule", "listed", F.coalesce(by_rule, by_list).alias("verdict"))


def spam_pages(spark: SparkSession) -> DataFrame:
    """canonical: a list of blocked pages, SPAM_PAGES numbers on each of SPAM_HOSTS in each of SPAM_LANGUAGES."""
    each = spark.range(SPAM_PAGES).withColumn("host", F.explode(F.array(*map(F.lit, SPAM_HOSTS)))).withColumn("language", F.explode(F.array(*map(F.lit, SPAM_LANGUAGES))))
    return each.select(F.concat_ws("/", "host", "language", F.col("id").cast("string")).alias("canonical"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page by the rules and the list of spam_pages()."""
    return judge(table(spark, sf_dir, "pages"), spam_pages(spark)).select("page_id", "host", "path", "rule", "verdict")


_HOSTS, _LANGUAGES = ([*map(str, x)] for x in (SPAM_HOSTS, SPAM_LANGUAGES))
SQL = rf"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') AS kept FROM u),
c AS (SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM k),
l AS (SELECT host || '/' || language || '/' || n AS canonical FROM unnest({_HOSTS}) AS a(host), unnest({_LANGUAGES}) AS b(language), range({SPAM_PAGES}) AS d(n)),
r AS (SELECT c.*, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN l USING (canonical)
"""
