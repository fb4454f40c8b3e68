"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, laid end to end, form a stream of words that is packed into blocks of `length`. Each output
shard has per_shard slots for blocks. How many of them a source gets there is drawn: of its share the whole part is
certain, and the slots that the whole parts leave are drawn one by one, each source as likely as what is left of its
share. The numbers that draw them are those of a sequence that fills the interval evenly over all shards (multiples of
the golden ratio from a seeded start), so a source's draws in all differ from its target by a few blocks at any number of shards,
where independent draws would miss small sources by their standard deviation. The counts are a table, and the rest
follows from it, a source's total too: its draws are numbered shard by shard, and draw j reads block
permutation_e(j mod blocks) of pass e = j div blocks, a permutation of its own for each source and pass. A draw after `most`
whole passes is void: its slot stays empty. Blocks are joined by that index. Within a shard
the draws of all sources are put in an order by another permutation. Nothing depends on how rows are
partitioned: reruns agree.

Offsets in a stream are summed in levels: within a chunk of documents by hash, over the chunks of a stretch, and over
stretches, so a source that holds most rows is no window of its own. Draws are numbered in the same way. Joins with draws are told to merge: a plan sees the few sources that draws are made from,
not their number, and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import WORD, table, written

LENGTH, PER_SHARD, WEIGHTS, MOST = 32, 4096, (1, 2, 3), 3
#: Rounds of the swap-or-not permutation; documents of a chunk; sources that may be broadcast; draws of an explode and of a task.
ROUNDS, CHUNK, BROADCAST_SOURCES, SPAN, PER_TASK = 12, 512, 200_000, 2048, 131_072
#: Chunks, or shards, of a stretch.
STRETCH = 1024
#: What is added from one number to the next, modulo 1: multiples of it fill the interval most evenly.
GOLDEN = (5**0.5 - 1) / 2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def size_of(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """x in 0..n-1 mapped by a pseudorandom permutation of 0..n-1 (swap or not, Hoang, Morris and Rogaway 2012)."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *seed), n) - x, n)
        return F.when(F.pmod(F.xxhash64(r, F.greatest(x, other), *seed), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), swap)


def sources(sized: DataFrame, length: int = LENGTH, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """A row per source of sized(source, size): sid (its place by code point, null last), source_size, target,
    blocks, draws, first (its first draw among all). Targets share the sum of sizes by weight; the water
    level at which min(level * weight, most * size) add up to it is found from running sums."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    full_at = Window.orderBy("full_level", "sid")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("full_level", F.col("cap") / F.col("weight")).withColumn("all_size", F.sum("source_size").over(every))
    below = F.coalesce(F.sum("cap").over(full_at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("weight").over(full_at.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("try_level", (F.col("all_size") - below) / from_here)
    s = s.withColumn("level", F.max(F.when(F.col("try_level") <= F.col("full_level"), F.col("try_level"))).over(every))
    s = s.withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("cap")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / length))
    s = s.withColumn("draws", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("first", F.sum("draws").over(by_name) - F.col("draws")).withColumn("all_draws", F.sum("draws").over(every))
    return s.select("source", "sid", "source_size", "target", "blocks", "draws", "first", "all_draws")


def before(rows: DataFrame, by: list[str], at: str, n: str, name: str) -> DataFrame:
    """rows with the sum of n over rows of the same `by` and smaller `at`, a whole number from 0 on, which may be many:
    within stretches of STRETCH values, and over stretches."""
    stretch = rows.withColumn("__stretch", F.expr(f"{at} div {STRETCH}"))
    whole = stretch.groupBy(*by, "__stretch").agg(F.sum(n).alias("__n"))
    first = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "__stretch", F.coalesce(F.sum("__n").over(first), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    each = stretch.withColumn("__in", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return each.join(whole.hint("merge"), [*by, "__stretch"]).select(*rows.columns, (F.col("__before") + F.col("__in")).alias(name))


def _parts(src: DataFrame) -> int:
    """Tasks for the draws of all sources."""
    return max(1, -(-(src.agg(F.sum("draws")).first()[0] or 0) // PER_TASK))


def shard_counts(src: DataFrame, seed: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """shard, sid, n: draws of each source in each output shard. The last shard may have fewer slots; the sum of n over a shard is
    its number of slots."""
    some = src.where("draws > 0").select("sid", "draws", "all_draws")
    # one row per source and size of shard: shards from `at` on, `shards` of them, of `slots` each
    full = F.floor(F.col("all_draws") / per_shard)
    kinds = F.array(F.struct(F.lit(0).cast("long").alias("at"), full.alias("shards"), F.lit(per_shard).cast("long").alias("slots")), F.struct(full.alias("at"), F.lit(1).cast("long").alias("shards"), (F.col("all_draws") % per_shard).alias("slots")))
    each = some.withColumn("k", F.explode(kinds)).select("sid", "draws", "all_draws", "k.*").where("shards > 0 and slots > 0")
    each = each.withColumn("whole", F.expr("draws * slots div all_draws")).withColumn("rest", F.expr("draws * slots % all_draws"))
    upto = Window.partitionBy("at").orderBy("sid")
    each = each.withColumn("high", F.sum("rest").over(upto) / F.col("all_draws")).withColumn("low", (F.sum("rest").over(upto) - F.col("rest")) / F.col("all_draws"))
    certain = each.where("whole > 0").withColumn("span", F.explode(F.expr(f"sequence(0L, (shards - 1) div {SPAN})"))).repartition(_parts(src), "sid", "span")
    certain = certain.withColumn("shard", F.explode(F.expr(f"sequence(at + span * {SPAN}, at + least(shards, (span + 1) * {SPAN}) - 1)"))).select("shard", "sid", F.col("whole").alias("n"))
    # what is left: shares of sources, cut at whole numbers so that a number between two of them meets few
    shares = each.where("rest > 0").withColumn("cell", F.explode(F.expr("sequence(cast(floor(low) as long), cast(floor(high) as long))"))).select("at", "cell", "sid", "low", "high")
    left = each.groupBy("at", "shards").agg(F.round(F.sum("rest") / F.first("all_draws")).cast("long").alias("open")).where("open > 0")
    points = left.withColumn("span", F.explode(F.expr(f"sequence(0L, (shards * open - 1) div {SPAN})"))).repartition(_parts(src), "at", "span")
    points = points.withColumn("i", F.explode(F.expr(f"sequence(span * {SPAN}, least(shards * open, (span + 1) * {SPAN}) - 1)")))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("at")), F.lit(1 << 52)) / float(1 << 52)
    number = start + F.col("i") * GOLDEN
    points = points.select("at", F.expr("at + i div open").alias("shard"), ((number - F.floor(number)) * F.col("open")).alias("x")).withColumn("cell", F.floor("x"))
    drawn = points.join(shares.hint("merge"), ["at", "cell"]).where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("shard", "sid", F.lit(1).cast("long").alias("n"))
    return certain.unionByName(drawn).groupBy("shard", "sid").agg(F.sum("n").alias("n"))


def draws(src: DataFrame, seed: int = 0, per_shard: int = PER_SHARD, most: int = MOST) -> DataFrame:
    """A row per draw: sid, shard, place (in the output), pass, block."""
    counts = written(shard_counts(src, seed, per_shard))
    slots = before(counts, ["sid"], "shard", "n", "slot")  # of the source's draws, the first that this shard has
    in_shard = Window.partitionBy("shard").orderBy("sid")
    slots = slots.withColumn("at", F.sum("n").over(in_shard) - F.col("n")).withColumn("in_all", F.sum("n").over(Window.partitionBy("shard")))
    near = F.broadcast(src) if src.count() <= BROADCAST_SOURCES else src
    # dealt to a given number of tasks, or the few rows of counts would be put together and opened in one
    slots = slots.join(near.select("sid", "blocks"), "sid").withColumn("n", F.least("n", most * F.col("blocks") - F.col("slot"))).where("n > 0").repartition(_parts(src), "shard", "sid")
    each = slots.withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    nth, pass_ = F.expr("(slot + i) % blocks"), F.expr("(slot + i) div blocks")
    place = F.col("shard") * per_shard + permuted(F.col("at") + F.col("i"), F.col("in_all"), F.lit(seed), F.col("shard"))
    return each.select("sid", "shard", place.alias("place"), pass_.alias("pass"), permuted(nth, F.col("blocks"), F.lit(seed), F.col("sid"), pass_).alias("block"))


def placed(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, text) with size, sid, start (its first word's place in its source's stream), and the
    sources. Both are written tables. Order in a stream: chunk by hash of doc_id and text, doc_id, hash of the text."""
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    src = written(sources(sized, length).coalesce(1))
    chunks = max(1, sized.count() // CHUNK)
    near = F.broadcast(src) if src.count() <= BROADCAST_SOURCES else src
    rows = sized.join(near.select("source", "sid"), sized["source"].eqNullSafe(near["source"])).select(sized["*"], "sid")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)))
    starts = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    starts = before(starts, ["sid"], "chunk", "n", "chunk_start")
    within = Window.partitionBy("sid", "chunk").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_chunk", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts.drop("n").hint("merge"), ["sid", "chunk"]).select("doc_id", "sid", "size", "tie", (F.col("chunk_start") + F.col("in_chunk")).alias("start"))
    return written(rows), src


def overlaps(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per document with words and block that it reaches into: sid, start, size, block, n (words there)."""
    o = rows.where("size > 0").select("sid", "start", "size", F.explode(F.expr(f"sequence(start div {length}, (start + size - 1) div {length})")).alias("block"))
    return o.withColumn("n", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length) - F.greatest(F.col("start"), F.col("block") * length))


def mix(docs: DataFrame, seed: int = 0, length: int = LENGTH) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, source, text).

    Null and blank texts have size 0 and give nothing; very long ones are cut into blocks like others. Repeated rows are
    documents of their own; which of them comes first in the stream changes nothing that is returned but among
    themselves. A null source is a source. No row gives no rows. Columns other than these three are not read."""
    rows, src = placed(docs, length)
    times = draws(src, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = overlaps(rows, length).join(times.hint("merge"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    near = F.broadcast(src) if src.count() <= BROADCAST_SOURCES else src
    with_words = rows.where("size > 0").join(taken.hint("merge"), ["sid", "start"], "left").select("doc_id", "sid", "size", "taken")
    without = rows.where("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken"))
    return with_words.unionByName(without).join(near.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, places: bool = False) -> DataFrame:
    """The mix as rows with the columns of docs: one per document, pass over its source and output shard that takes any of it.

    The text is the whole text where one shard takes all of the document's blocks in a pass, else the words of the blocks
    taken, joined by spaces. Documents without words (null and blank texts) are in no block and go; repeated rows are documents
    of their own; very long texts are cut like others. No rows give no rows. n_chars, if there, is of the new text.
    Each shard is whole in one partition, its rows by the first place that they take; with places, shard and place are
    added as columns."""
    rows, src = placed(docs, length)
    parts = overlaps(rows, length).join(draws(src, seed, per_shard).select("sid", "block", "pass", "shard", "place").hint("merge"), ["sid", "block"])
    parts = parts.repartition("sid", "start")  # for both groupings
    parts = parts.groupBy("sid", "start", "pass", "shard").agg(F.min("place").alias("place"), F.sum("n").alias("taken"), F.array_sort(F.collect_list("block")).alias("blocks"))
    parts = parts.groupBy("sid", "start").agg(F.collect_list(F.struct("shard", "place", "taken", "blocks")).alias("takes"))
    parts = parts.join(rows.where("size > 0").hint("merge"), ["sid", "start"]).select("doc_id", "tie", "size", "start", "takes")
    # repeated rows have the same key: where there are any, each is told apart by its place among them
    repeated = bool(rows.groupBy("doc_id", "tie").count().where("count > 1").take(1))
    parts = parts.withColumn("nth", F.dense_rank().over(Window.partitionBy("doc_id", "tie").orderBy("start")) if repeated else F.lit(1))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("key_tie"))
    packed = packed.withColumn("key_nth", F.row_number().over(Window.partitionBy("key", "key_tie").orderBy(F.lit(1))) if repeated else F.lit(1))
    joined = packed.join(parts.hint("merge"), packed["key"].eqNullSafe(parts["doc_id"]) & (F.col("key_tie") == F.col("tie")) & (F.col("key_nth") == F.col("nth")))
    # the words as a lambda's variable: a column would be worked out anew for each block
    piece = lambda w, b: F.slice(w, F.greatest(b * length - F.col("start"), F.lit(0)).cast("int") + 1, (F.least(F.col("start") + F.col("size"), (b + 1) * length) - F.greatest(F.col("start"), b * length)).cast("int"))
    cut = lambda w, t: F.when(t["taken"] < F.col("size"), F.array_join(F.flatten(F.transform(t["blocks"], lambda b: piece(w, b))), " ")).otherwise(F.col("doc.text"))
    each = F.element_at(F.transform(F.array(words_of(F.col("doc.text"))), lambda w: F.transform("takes", lambda t: F.struct(t["shard"].alias("shard"), t["place"].alias("place"), cut(w, t).alias("text")))), 1)
    plain = F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "text"])
    joined = joined.select(plain.alias("rest"), F.explode(each).alias("take"))
    joined = joined.repartition("take.shard").sortWithinPartitions("take.shard", "take.place", "rest.doc_id")
    out = [F.col("take.text").alias(c) if c == "text" else F.length("take.text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*out, *([F.col("take.shard").alias("shard"), F.col("take.place").alias("place")] if places else []))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; see mix() for odd rows."""
    return mix(table(spark, sf_dir, "documents"))
