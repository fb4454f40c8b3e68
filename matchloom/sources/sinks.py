"""Report sinks: text columns with fixed decimals, Markdown, and writes that can be resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(c: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", c.cast("double"))


def pairs_csv(pairs: DataFrame, path: str, decimals: int = 6) -> None:
    """All doubles with so many decimals, under a header."""
    kinds = dict(pairs.dtypes)
    pairs.select(*[fixed(F.col(c), decimals).alias(c) if kinds[c] == "double" else F.col(c) for c in pairs.columns]).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def resumed(units: DataFrame, path: str, keys: list[str], schema: str, work) -> DataFrame:
    """All results in `path` after work(units) of those that it lacks; what is there already isn't done again."""
    spark = units.sparkSession
    write_units(work(missing(units, spark.read.schema(schema).parquet(path), keys)), path, keys)
    return spark.read.schema(schema).parquet(path)


def report_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def markdown_row(*cells) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(df: DataFrame, most_rows: int = 1000) -> str:
    """A table of a small frame; over most_rows rows it refuses instead of cutting off."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def missing(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work that are not done yet."""
    return units.join(done.select(*keys).distinct(), keys, "left_anti")


def write_units(results: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces only the partitions of the units in results, so a run can stop and go on."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def model(df: DataFrame, path: str) -> None:
    """Galleries, templates and bases are Parquet tables."""
    df.write.mode("overwrite").parquet(path)
