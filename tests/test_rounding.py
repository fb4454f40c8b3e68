"""Rounded values against SQL to the last bit, the sign of zero included."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchloom.functions import labels as L
from matchloom.functions import vectors as V
from matchloom.plans import registry


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Vectors with components that come to zero from below."""
    d = tmp_path_factory.mktemp("small")
    v = np.random.default_rng(3).normal(0, 0.1, (40, 64))
    v[:, 1] = np.where(np.arange(40) % 2, -1e-7, -1.2e-7)
    v[7, 20] = -1e-9
    pq.write_table(pa.table({"vec_id": pa.array(range(40), pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(40)], pa.int32())}), d / "embeddings.parquet")
    return str(d)


def exact(columns, rows):
    return sorted(repr([list(x) if isinstance(x, (list, tuple)) else x for x in (r[c] for c in columns)]) for r in rows)


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    asked = exact(range(len(names)), found.fetchall())
    assert any("-0.0]" in r or "-0.0," in r for r in asked)
    assert exact(names, registry.queries()[name](spark, d).collect()) == asked


def test_decimals(spark):
    df = spark.createDataFrame([(-1e-9, "-0.0"), (1e-9, "0.0"), (-0.0, "-0.0"), (-2.5, "-3.0"), (2.5, "3.0"), (float("nan"), "nan"), (float("inf"), "inf"), (None, "None")], "x double, want string")
    for r in df.select(V.decimals(F.col("x"), 0).alias("got"), "want").collect():
        assert repr(r.got) == r.want


def test_unit(spark, small):
    same_as_sql(spark, small, "f4_unit")


def test_whiten(spark, small):
    same_as_sql(spark, small, "f7_whiten")


@pytest.mark.parametrize("name", ["a8_mean_gallery", "a7_weighted_centroid"])
def test_centroids(spark, small, name):
    same_as_sql(spark, small, name)


def test_percentile_of_equal_values(spark, tmp_path):
    """0.85 and 0.15 of 900.14 add up to less than it, which left no row at or below the threshold."""
    pq.write_table(pa.table({"l_extendedprice": [900.14] * 4, "l_linestatus": ["O", "F"] * 2, "l_returnflag": ["A", "N", "A", "R"]}), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    asked = con.execute(registry.oracle_sql()["a32_segment_merge"]).fetchall()
    assert sorted(map(tuple, registry.queries()["a32_segment_merge"](spark, str(tmp_path)).select("segment", "n", "threshold").collect())) == sorted(asked)
    assert sum(n for _, n, _ in asked) == 4


def test_large_sizes_have_all_their_digits(spark):
    n = [float(1 << 53) * 1024.0**4, 1.1818254493395242e30, 1.0702725905254079e30, -1.2e31, 2.0**110, 2.0**110 - 2.0**57, 9.9e37]
    rows = spark.createDataFrame([(x,) for x in n], "x double").select(L.byte_size(F.col("x")).alias("t"), L._decimals(F.col("x"), 2).alias("d")).collect()
    assert [r.d for r in rows] == [f"{x:.2f}" for x in n]
    assert [r.t for r in rows if r.t.endswith("TB")] == [f"{x / 1024.0**4:.2f} TB" for x in n if x > 0]
