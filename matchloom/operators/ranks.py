"""Exact ranks, percentiles and running sums without a task that sees all rows.

Values are dealt to buckets between bounds that approximate percentiles give (one row of at most BUCKETS numbers). Counts of
buckets tell where a rank lies; only rows of those buckets are looked at again. Running sums add what lies in
earlier buckets to a window within each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.shared import written

BUCKETS, ACCURACY = 64, 2000


def bounds(df: DataFrame, d: str, at: tuple[float, ...] = ()) -> list[float]:
    """Values that cut df[d] into about equal parts, and close ones around the shares in `at`."""
    near = [min(1.0, max(0.0, p + s / ACCURACY)) for p in at for s in (-2, 2)]
    shares = sorted({*(i / BUCKETS for i in range(1, BUCKETS)), *near})
    found = df.agg(F.percentile_approx(F.col(d).cast("double"), F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("b")).first()
    return sorted(set(found[0] or []))


def bucket(d: Column, cuts: list[float]) -> Column:
    """How many cuts lie below d, by bisection; null stays null."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(d <= cuts[mid], between(low, mid)).otherwise(between(mid + 1, high))

    return F.when(d.isNotNull(), between(0, len(cuts)))


def counted(df: DataFrame, d: str, by: list[str]) -> DataFrame:
    """by, __bucket, __n, __before: rows of each bucket of each group, and rows of earlier ones. A group has few buckets."""
    n = df.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("__before", F.sum("__n").over(upto) - F.col("__n"))


def at_ranks(df: DataFrame, d: str, want: DataFrame, by: list[str] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """want(by.., .., k) with `value`, the k-th smallest of df[d] in its group (from 1), and `below`, the number of smaller
    rows. Nulls don't count. Ranks that no row has give no row."""
    by = by or []
    rows = df.where(F.col(d).isNotNull()).select(*by, F.col(d).alias("__d"))
    rows = rows.withColumn("__bucket", bucket(F.col("__d"), bounds(rows, "__d") if cuts is None else cuts))
    each = counted(rows, "__d", by)
    met = each.join(want, by) if by else each.crossJoin(F.broadcast(want))
    hit = met.where("k > __before and k <= __before + __n")
    few = rows.join(F.broadcast(hit.select(*by, "__bucket").distinct()), [*by, "__bucket"], "left_semi").groupBy(*by, "__bucket", "__d").agg(F.count("*").alias("__m"))
    upto = Window.partitionBy(*by, "__bucket").orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("__to", F.sum("__m").over(upto))
    found = few.join(F.broadcast(hit), [*by, "__bucket"]).where("k <= __before + __to and k > __before + __to - __m")
    return found.select(*want.columns, F.col("__d").alias("value"), (F.col("__before") + F.col("__to") - F.col("__m")).alias("below"))


def percentiles(df: DataFrame, d: str, shares: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """by.., n, p: percentiles of df[d] in the order of `shares`, between the two nearest values where none is exact."""
    by = by or []
    rows = df.where(F.col(d).isNotNull()).select(*by, F.col(d).cast("double").alias("__v"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    asked = n.where("n > 0").withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(shares)])))
    asked = asked.select(*by, "n", F.col("s.i").alias("i"), (F.col("s.p") * (F.col("n") - 1)).alias("at"))
    want = asked.select(*by, "n", "i", "at", F.explode(F.array_distinct(F.array(F.floor("at") + 1, F.ceil("at") + 1))).alias("k"))
    got = at_ranks(rows, "__v", want, by, bounds(rows, "__v", tuple(shares)))
    low, high, part = F.min("value"), F.max("value"), F.min("at") - F.floor(F.min("at"))
    # a value that both neighbours have is the percentile itself; its two parts may add up to a little less, which would lose all rows at it
    each = got.groupBy(*by, "n", "i").agg(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias("v"))
    return each.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("p"))


def running(df: DataFrame, d: str, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """df, which has a row for each value of d (in each group), with running sums upwards: name -> column summed."""
    by = by or []
    rows = df.withColumn("__bucket", bucket(F.col(d), bounds(df, d)))
    each = rows.groupBy(*by, "__bucket").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])  # a row for each bucket
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*by, "__bucket", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    upto = Window.partitionBy(*by, "__bucket").orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *[F.sum(c).over(upto).alias(f"__own_{n}") for n, c in sums.items()])
    return within.join(F.broadcast(each), [*by, "__bucket"]).select(*df.columns, *[(F.col(f"__{n}") + F.col(f"__own_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in the order given, which must be total: a distributed sort, written with
    the place within its partition, to which the sizes of earlier partitions are added."""
    rows = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__in") + 1).alias(name))


def rows_at(df: DataFrame, d: str, ties: list[str], want: DataFrame, cuts: list[float] | None = None) -> DataFrame:
    """want(.., k) with the columns of the k-th row of df in order of d and `ties`: the value by at_ranks(), then the rows
    that share it are numbered."""
    found = written(at_ranks(df, d, want, cuts=cuts))
    same = df.join(F.broadcast(found.select(F.col("value").alias(d)).distinct()), d, "left_semi")
    places = numbered(same.select(d, *ties), [d, *ties], "__place")
    first = places.groupBy(F.col(d).alias("value")).agg(F.min("__place").alias("__first"))
    places = places.withColumnRenamed(d, "value").join(F.broadcast(first), "value").withColumn("__nth", F.col("__place") - F.col("__first"))
    return places.join(F.broadcast(found), ["value"]).where("__nth = k - below - 1").select(*want.columns, F.col("value").alias(d), *ties)


def shares_from(values: DataFrame, v: str, asked: DataFrame, a: str, name: str = "share") -> DataFrame:
    """asked with the share of values[v] that is at least asked[a], 0 to 1 (0 over nothing); both sides may be large. Equal values are counted
    together, running sums over them are made bucket by bucket, and the asked rows find theirs by value. Null is asked for nothing: null."""
    base = values.where(F.col(v).isNotNull()).select(F.col(v).alias("__v"), F.lit(1).cast("long").alias("__n"))
    base = base.unionByName(asked.where(F.col(a).isNotNull()).select(F.col(a).alias("__v"), F.lit(0).cast("long").alias("__n")))
    base = written(base.groupBy("__v").agg(F.sum("__n").alias("__n")))
    total = F.broadcast(base.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total")))  # one row
    upto = running(base, "__v", {"__upto": "__n"}).crossJoin(total)
    share = F.when(F.col("__total") > 0, (F.col("__total") - F.col("__upto") + F.col("__n")) / F.col("__total")).otherwise(0.0)
    return asked.join(upto.select(F.col("__v").alias(a), share.alias(name)), a, "left").select(*asked.columns, name)
