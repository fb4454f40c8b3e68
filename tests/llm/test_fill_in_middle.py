"""Fill-in-the-middle: brute force, SQL, exact round trips, odd rows."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.llm import fill_in_middle as fim
from matchloom.llm import queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, units string, form string, first string, prefix string"


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, None, text
    if h[3] % 100 < 80:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def odd(spark):
    texts = ["", None, " ", "a", "\n a  b\t", "x <P> y", "<", "<P <S <M P> S> M>", "é 😀 wide space \x0b end\r\n", "w " * 30_000, "no_break" * 40_000, " \t" * 20_000, "tail   "]
    rows = [(i, t, 1, "u", "f", "x", "p") for i, t in enumerate(texts * 6)] + [(None, "no id here", None, None, None, None, None)] * 2 + [(5, "same id", 1, "u", "f", "x", "p")] * 2
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_rows_match_brute_force(spark):
    docs = odd(spark)
    got = fim.arranged(docs).select("doc_id", "n", "form", "prefix", "middle", "suffix", "output", fim.restored(F.col("output"), F.col("form")).alias("back"), "text").collect()
    want = [(r.doc_id, *brute(r.doc_id, r.text)) for r in docs.collect()]
    assert [tuple(r)[:7] for r in got] == want
    assert all(r.back == r.text for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.arranged(docs.limit(0)).collect() == []


def test_shares_and_sentinels_are_parameters(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    own = fim.Sentinels("[pre]", "[suf]", "[mid]")
    got = fim.arranged(docs, seed=7, plain_percent=100, spm_percent=0, sentinels=own).withColumn("back", fim.restored(F.col("output"), F.col("form"), own)).collect()
    assert {r.form for r in got} == {"psm"} and {r.back for r in got} == {"one two three four"}
    assert all(r.output == f"[pre]{r.prefix}[suf]{r.suffix}[mid]{r.middle}" for r in got)
    assert {r.form for r in fim.arranged(docs, plain_percent=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><S", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*bad)
    assert spark.range(1).select(fim.restored(F.lit(None).cast("string"), F.lit("psm")).alias("a"), fim.restored(F.lit("x"), F.lit(None).cast("string")).alias("b")).first() == (None, None)


def test_query_matches_sql_and_brute_force(spark, sf_dir):
    df = queries.QUERIES["op11_fill_in_middle"](spark, sf_dir)
    got = sorted(map(tuple, df.collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(queries.SQL["op11_fill_in_middle"])
    assert [d[0] for d in found.description] == df.columns
    assert got == sorted(found.fetchall())
    want = []
    for doc_id, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        n, form, p, m, _, out = brute(doc_id, text)
        want.append((doc_id, n, form, None if p is None else len(p), None if m is None else len(m), hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_plan_has_no_python_and_no_shuffle(spark, sf_dir):
    plan = queries.QUERIES["op11_fill_in_middle"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_extract_all") <= 2  # made once, and named once where it is read
