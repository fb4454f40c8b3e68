"""Fill-in-the-middle: texts cut in three at unit borders, put in another order with sentinels, and restored from that.

A unit is a word with the white space before it, or white space at the end. Cuts and forms come from the SHA-256 of seed and
doc_id, so a row's result depends on nothing else and a rerun or a lost executor changes nothing. All of it is column
expressions over one row: no shuffle, no Python. The array of units is made once a row, and texts that stay plain are never
sliced or joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import table

#: A unit (regular expression): words with the white space before them, or what white space is left.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        each = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(each):
            for j, b in enumerate(each):
                if not a or i != j and a in b or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                    raise ValueError("sentinels must not be empty, hold or overlap one another")

    @property
    def pattern(self) -> str:
        """Any of them, as a regular expression."""
        return "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", s) for s in (self.prefix, self.suffix, self.middle))


def drawn(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th (from 0) 32-bit number of the row: a group of 8 hexadecimal digits of the digest of `seed:doc_id`; null ids count as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def arranged(docs: DataFrame, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output for each row of docs(doc_id, text).

    Null text counts as empty. Empty texts and texts that hold a sentinel are plain. Repeated rows and rows that share an id get
    the same draws; null ids draw as an empty id. Parts may be empty. Texts are read whole, however long. An empty table gives no
    rows; other columns are not read."""
    s, id_ = sentinels, F.col("doc_id")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    taken = (F.col("text") == "") | F.contains("text", F.lit(s.prefix)) | F.contains("text", F.lit(s.suffix)) | F.contains("text", F.lit(s.middle))
    plain = taken | (drawn(id_, seed, 2) % 100 >= plain_percent)
    form = F.when(plain, "plain").when(drawn(id_, seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    cuts = [drawn(id_, seed, k) % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.withColumn("form", form).withColumn("first", F.least(*cuts).cast("int")).withColumn("last", F.greatest(*cuts).cast("int"))
    units, n = F.col("units"), F.col("n").cast("int")
    parts = {"prefix": (F.lit(1), F.col("first")), "middle": (F.col("first") + 1, F.col("last") - F.col("first")), "suffix": (F.col("last") + 1, n - F.col("last"))}
    rows = rows.withColumns({k: F.when(F.col("form") != "plain", F.array_join(F.slice(units, start, length), "")) for k, (start, length) in parts.items()})
    psm = F.concat(F.lit(s.prefix), "prefix", F.lit(s.suffix), "suffix", F.lit(s.middle), "middle")
    spm = F.concat(F.lit(s.suffix), "suffix", F.lit(s.prefix), "prefix", F.lit(s.middle), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output of arranged() was made of, parsed at its sentinels; null where output or form is null.

    Outputs of form psm and spm hold each sentinel once, in the form's order; others are as they are."""
    parts = F.split(output, sentinels.pattern, -1)
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).when(form.isNotNull(), output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arranges every document, and restores it from the output; see arranged() for odd rows."""
    rows = arranged(table(spark, sf_dir, "documents")).withColumn("back", restored(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '{UNIT}') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a+1:b], ''), '') AS mid, coalesce(array_to_string(units[b+1:n], ''), '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END AS output FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
