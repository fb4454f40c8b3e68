"""Vector functions F1-F9 and pair queries J1, J2, W1-W9, T1-T4."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.operators import pairs, ranks, tiles
from matchloom.operators.spread import Spread
from matchloom.plans import tables as T
from matchloom.plans.registry import query

_NEXT = "nxt AS (SELECT a.vec_id, a.v, b.v AS u FROM feat a JOIN feat b ON b.vec_id = a.vec_id + 1)"


def _with_next(spark, d):
    f = T.feat(spark, d)
    return f.select("vec_id", "v").join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")


def _pairwise(name, expr, sql):
    @query(name, f"WITH {T.FEAT}, {_NEXT} SELECT vec_id, round({sql}, 6) AS value FROM nxt")
    def run(spark, d):
        return _with_next(spark, d).select("vec_id", V.decimals(expr(F.col("v"), F.col("u")), 6).alias("value"))

    return run


_TILES = ("list_transform(v, lambda x: (x + 1) * 127.5)", "list_transform(u, lambda x: (x + 1) * 127.5)")
_pairwise(
    "f1_chi_square",
    lambda a, b: V.chi_square(F.transform(a, lambda x: (x + 1) * 127.5), F.transform(b, lambda x: (x + 1) * 127.5)),
    f"0.5 * list_sum(list_transform(list_zip({_TILES[0]}, {_TILES[1]}), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2] + 1e-10)))",
)
_pairwise("f2_euclidean", V.euclidean, "sqrt(list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")
_pairwise("f3_cosine", V.cosine, f"{T.dot_sql('v', 'u')} / (({T.norm_sql('v')} + 1e-9) * ({T.norm_sql('u')} + 1e-9))")
_pairwise("f5_l2_from_cosine", lambda a, b: V.l2_from_cosine(V.dot(a, b)), f"sqrt(greatest(0, 2 - 2 * {T.dot_sql('v', 'u')}))")
_pairwise("f6_gram_l2", V.l2_by_gram, f"sqrt(greatest(0, {T.dot_sql('v', 'v')} + {T.dot_sql('u', 'u')} - 2 * {T.dot_sql('v', 'u')}))")


@query("f4_unit", f"WITH {T.FEAT}, t AS (SELECT vec_id, list_transform(v, lambda x: x * (vec_id % 3) + 0.0) AS y FROM feat) SELECT vec_id, list_transform(CASE WHEN {T.norm_sql('y')} > 1e-12 THEN list_transform(y, lambda x: x / {T.norm_sql('y')}) ELSE y END, lambda x: round(x, 6)) AS v FROM t")
def f4(spark, d):
    y = F.transform("v", lambda x: x * (F.col("vec_id") % 3) + F.lit(0.0))
    return T.feat(spark, d).select("vec_id", F.transform(V.unit(y), lambda x: V.decimals(x, 6)).alias("v"))


@query(
    "f7_whiten",
    f"WITH {T.FEAT}, sd AS (SELECT list(s ORDER BY i) AS s FROM (SELECT u.i, stddev_pop(v[u.i]) AS s FROM feat, unnest(range(1, 65)) AS u(i) GROUP BY 1)), t AS (SELECT vec_id, list_transform(list_zip(v, s), lambda z: z[1] / z[2])[4:] AS y FROM feat, sd) SELECT vec_id, list_transform(y, lambda x: round(x / {T.norm_sql('y')}, 5)) AS v FROM t",
)
def f7(spark, d):
    f = T.feat(spark, d)
    sd = f.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda z: z["s"]).alias("s"))
    return f.crossJoin(F.broadcast(sd)).select("vec_id", F.transform(V.whiten(F.col("v"), F.col("s"), 3), lambda x: V.decimals(x, 5)).alias("v"))


@query("f8_quantize", f"WITH {T.FEAT} SELECT vec_id, list_transform(v, lambda x: greatest(0, least(255, round_even((x + 1) * 127.5, 0)))::INT) AS tile FROM feat")
def f8(spark, d):
    return T.feat(spark, d).select("vec_id", V.to_uint8(F.col("v"), 127.5, 1.0).alias("tile"))


@query(
    "f9_cell_mask",
    "WITH m AS (SELECT r * 8 + c AS i FROM (SELECT 2 AS r, unnest(range(1, 7)) AS c UNION ALL SELECT 3, unnest(range(1, 7)) UNION ALL SELECT 4, unnest(range(2, 6)) UNION ALL SELECT 5, unnest(range(2, 6)) UNION ALL SELECT 6, unnest(range(2, 6)))) SELECT vec_id, round(sum(embedding[i + 1]::DOUBLE), 6) AS kept_sum, count(*) AS cells FROM embeddings, m GROUP BY vec_id",
)
def f9(spark, d):
    """Keeps the 24 of 8 x 8 cells that hold eyes, nose and mouth."""
    kept = V.landmark_cells(F.col("v"))
    return T.feat(spark, d).select("vec_id", V.decimals(V.total(kept), 6).alias("kept_sum"), F.size(kept).cast("long").alias("cells"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_UNIQUE = f"up AS (SELECT a.vec_id AS query, b.vec_id AS candidate, round({_DIST}, 9) AS d FROM feat a JOIN feat b ON a.vec_id < b.vec_id)"
_ORDERED = f"op AS (SELECT a.vec_id AS query, b.vec_id AS candidate, round({_DIST}, 9) AS d FROM feat a JOIN feat b ON a.vec_id <> b.vec_id)"


@query("j1_ordered_pairs", f"WITH {T.FEAT}, {_ORDERED} SELECT query, candidate, d FROM op")
def j1(spark, d):
    """What leaves the tasks is the result: a row for each pair, in both orders."""
    return tiles.distances(T.feat(spark, d), "vec_id", "v", both=True)


@query("j2_unique_pairs_all", f"WITH {T.FEAT}, p AS (SELECT a.vec_id AS query, {_DIST} AS d FROM feat a JOIN feat b ON a.vec_id < b.vec_id) SELECT count(*) AS pairs, round(max(d), 6) AS largest, round(min(d), 6) AS smallest, round(avg(d), 6) AS mean FROM p")
def j2(spark, d):
    t = pairs.distance_stats(T.feat(spark, d), "vec_id")
    return t.select("pairs", F.round("largest", 6).alias("largest"), F.round("smallest", 6).alias("smallest"), F.round(F.col("total") / F.col("pairs"), 6).alias("mean"))


_POWERS = ", ".join(str(1 << i) for i in range(40))


@query("w1_error_pairs", f"WITH {T.FEAT}, {_ORDERED}, r AS (SELECT *, row_number() OVER (ORDER BY d, query, candidate) AS error_pair_rank, count(*) OVER () AS n FROM op) SELECT error_pair_rank, query, candidate, d, round(1e6 * error_pair_rank / n, 6) AS realized_far_ppm FROM r WHERE error_pair_rank IN ({_POWERS}) OR error_pair_rank = greatest(1, (1000 * n + 999999) // 1000000)")
def w1(spark, d):
    """The k-th smallest ordered pairs, for k = 1, 2, 4, .. and the rank of the specified rate: exact selection, whatever k."""
    return error_pairs(T.feat(spark, d)).select(F.col("k").alias("error_pair_rank"), "query", "candidate", "d", F.round(F.lit(1e6) * F.col("k") / F.col("n"), 6).alias("realized_far_ppm"))


def error_ranks(n: int, ppm: int = 1000) -> list[int]:
    """1, 2, 4, .. up to n, and the rank of the rate `ppm`."""
    return sorted({max(1, (ppm * n + 999_999) // 1_000_000), *(1 << i for i in range(40) if 1 << i <= n)})


def error_pairs(feat):
    """n, k, query, candidate, d: the ordered pairs at the ranks of errors."""
    return tiles.placed(Spread(feat, "vec_id", "v"), error_ranks)[0]


@query("w2_spec_rank", "SELECT n, ppm, greatest(1, (ppm * n + 999999) // 1000000) AS k FROM (SELECT count(*) AS n FROM lineitem), unnest([10, 76, 100, 10000, 10582]) AS u(ppm)")
def w2(spark, d):
    """ceil(ppm * n / 1e6), at least 1, in whole numbers."""
    n = T.read(spark, d, "lineitem").agg(F.count("*").alias("n"))
    return n.select("n", F.explode(F.array(*map(F.lit, (10, 76, 100, 10000, 10582)))).alias("ppm")).select("n", "ppm", F.greatest(F.lit(1).cast("long"), F.expr("(ppm * n + 999999) div 1000000")).alias("k"))


@query("w3_curve_ranks", "WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT (2 ** i)::BIGINT AS k FROM n, unnest(range(0, 40)) AS u(i) WHERE 2 ** i < n UNION SELECT greatest(1, (1000 * n + 999999) // 1000000) FROM n) SELECT k FROM r")
def w3(spark, d):
    """1, 2, 4, ... below n, and the rank of the specified rate."""
    n = T.read(spark, d, "orders").agg(F.count("*").alias("n"))
    powers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda k: k < F.col("n"))
    return n.select(F.explode(F.array_union(powers, F.array(F.greatest(F.lit(1).cast("long"), F.expr("(1000 * n + 999999) div 1000000"))))).alias("k"))


@query("w5_cosine_at_far", f"WITH {T.FEAT}, c AS (SELECT round({T.dot_sql('a.v', 'b.v')}, 9) AS c FROM feat a JOIN feat b ON a.vec_id < b.vec_id AND a.label <> b.label), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS rn, count(*) OVER () AS n FROM c) SELECT ppm, max(c) AS cosine FROM r, unnest([100, 1000, 10000]) AS u(ppm) WHERE rn = least(n, greatest(1, (ppm * n + 999999) // 1000000)) GROUP BY ppm")
def w5(spark, d):
    """The k-th largest cosine between different identities, k = ceil(rate * count), by tiles."""
    return spark.createDataFrame(cosines_at_far(cosines(T.feat(spark, d)), (100, 1000, 10000)), "ppm int, cosine double")


def cosines(feat) -> Spread:
    """The products of all unique pairs of different labels."""
    return Spread(feat, "vec_id", "v", product=True, label="label")


def cosines_at_far(c: Spread, ppm: tuple[int, ...]) -> list[tuple[int, float]]:
    """The cosine that so many in a million of all pairs reach, at least one."""
    rank = lambda n, x: n + 1 - min(n, max(1, (x * n + 999_999) // 1_000_000))
    n, at = c.at(lambda n: sorted({rank(n, x) for x in ppm}))
    return [(x, at[g][rank(n[g], x)]) for g in n for x in ppm]


@query("w6_unique_to_ordered", f"WITH {T.FEAT}, {_UNIQUE}, r AS (SELECT *, row_number() OVER (ORDER BY d, query, candidate) AS rn FROM up) SELECT k, query, candidate, d FROM r JOIN (SELECT unnest([1, 2, 3, 8, 9, 20, 101, 1000]) AS k) ON rn = (k + 1) // 2")
def w6(spark, d):
    """The k-th ordered pair is the ceil(k / 2)-th unique one."""
    want = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 2, 3, 8, 9, 20, 101, 1000)))).alias("ordered")).withColumn("k", F.expr("(ordered + 1) div 2"))
    placed = tiles.lowest(T.feat(spark, d), "vec_id", "v", 500).withColumn("k", F.row_number().over(Window.orderBy("d", "query", "candidate")))  # 500 rows
    return placed.join(want, "k").select(F.col("ordered").alias("k"), "query", "candidate", "d")


@query("w9_normalize_100", f"WITH {T.FEAT}, {_UNIQUE} SELECT query, candidate, CASE WHEN m > 0 THEN round(100 * d / m, 6) ELSE 0 END AS normalized FROM up, (SELECT max(d) AS m FROM up)")
def w9(spark, d):
    """100 * d / the largest over all rows; no minimum is taken off."""
    f = T.feat(spark, d)
    n, at = Spread(f, "vec_id", "v").at(lambda n: [n])
    largest = at[None][n[None]] if n else 0.0
    return tiles.distances(f, "vec_id", "v", over=largest).withColumnRenamed("d", "normalized")


@query("t1_sorted_impostors", f"WITH {T.SMALL} SELECT rank, d FROM (SELECT d, row_number() OVER (ORDER BY d, doc_id) AS rank FROM s WHERE kind = 'impostor')")
def t1(spark, d):
    s = T.scores_small(spark, d).where("kind = 'impostor'").select("d", "doc_id")
    return ranks.numbered(s, ["d", "doc_id"], "rank").select("rank", "d")


@query("t2_lowest_pairs", f"WITH {T.FEAT}, {_UNIQUE} SELECT query, candidate, d FROM up ORDER BY d, query, candidate LIMIT 20")
def t2(spark, d):
    return tiles.lowest(T.feat(spark, d), "vec_id", "v", 20).orderBy("d", "query", "candidate")


@query("t3_top_k_per_chunk", f"WITH {T.FEAT}, {_UNIQUE}, r AS (SELECT *, row_number() OVER (PARTITION BY query % 4 ORDER BY d, query, candidate) AS rn FROM up) SELECT query, candidate, d FROM r WHERE rn <= 10 ORDER BY d, query, candidate LIMIT 10")
def t3(spark, d):
    """A tile of pairs is a chunk: what is among the first of all is among the first of its chunk, however pairs are cut."""
    return tiles.lowest(T.feat(spark, d), "vec_id", "v", 10).orderBy("d", "query", "candidate")


@query("t4_top_k_with_maximum", f"WITH {T.FEAT}, {_UNIQUE} SELECT query, candidate, d, m AS largest FROM up, (SELECT max(d) AS m FROM up) ORDER BY d, query, candidate LIMIT 15")
def t4(spark, d):
    f = T.feat(spark, d)
    n, at = Spread(f, "vec_id", "v").at(lambda n: [n])
    largest = at[None][n[None]] if n else None
    return tiles.lowest(f, "vec_id", "v", 15).orderBy("d", "query", "candidate").withColumn("largest", F.lit(largest).cast("double"))


@query("t5_top_dimensions", f"WITH {T.FEAT}, a AS (SELECT u.i - 1 AS dim, var_pop(v[u.i]) AS s FROM feat, unnest(range(1, 65)) AS u(i) GROUP BY 1) SELECT dim, round(s, 6) AS score FROM a ORDER BY round(s, 9) DESC, dim LIMIT 8")
def t5(spark, d):
    s = T.feat(spark, d).select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("s"))
    return s.orderBy(F.desc(F.round("s", 9)), "dim").limit(8).select(F.col("dim").cast("long").alias("dim"), F.round("s", 6).alias("score"))


@query("t6_first_misclassified", f"WITH {T.MATCHES} SELECT vec_id, person, best_person FROM matches WHERE known AND person <> best_person ORDER BY vec_id LIMIT 15")
def t6(spark, d):
    return T.matches(spark, d).where("known and person <> best_person").select("vec_id", "person", "best_person").orderBy("vec_id").limit(15)


@query("t7_identity_cap", f"WITH {T.FEAT} SELECT vec_id, person FROM feat WHERE person IN (SELECT DISTINCT person FROM feat ORDER BY person LIMIT 4)")
def t7(spark, d):
    f = T.feat(spark, d)
    return f.join(F.broadcast(f.select("person").distinct().orderBy("person").limit(4)), "person", "left_semi").select("vec_id", "person")


@query("t8_systematic_sample", f"WITH {T.SMALL} SELECT rank, d FROM (SELECT d, row_number() OVER (ORDER BY d, doc_id) AS rank FROM s) WHERE rank % 10 = 1")
def t8(spark, d):
    return ranks.numbered(T.scores_small(spark, d).select("d", "doc_id"), ["d", "doc_id"], "rank").where("rank % 10 = 1").select("rank", "d")
