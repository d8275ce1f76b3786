"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: a line from `start` to `end` times its
mean weight. The schedule's integral, the mean weight, fixes the source's share of the mix. A document's
place in its source's cumulative token demand is inverted through the integrated schedule, which gives its
training position; documents are range-sorted by position.

Only DataFrame functions run here. A source's documents stand in the order of a hash of doc_id, and prefix sums
are made in two levels: the leading bits of the hash deal each source into buckets of about BUCKET_ROWS rows, sums
of (source, bucket) are summed up by a window over those few rows, and a second window runs inside one bucket of
one source. mix() needs ids, sources and sizes only. curriculum() never moves texts for it: a document's place in
its bucket is told from its hash, so texts meet a small table of buckets and are shuffled once, by position.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, sent, table, word_count

#: Mean weights by the rank of the source's name, repeating; a null source ranks last.
WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all sizes that the mix takes, and times that a document may be taken.
SHARE, REPEATS = 1.5, 2
#: Schedules by the same rank: (start, end), with a mean of 1.
RAMPS = ((1.4, 0.6), (0.6, 1.4), (1.0, 1.0))
#: Rows that a bucket of a source has about, if one source has them all.
BUCKET_ROWS = 4096
SEED, HASH_BITS = 20, 62


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Target of each source from (source, source_size): one row for each source.

    A source gets level * weight words, at most `repeats` times its size, where the level makes the sum
    `share` of all sizes: the fixed point of resharing every excess by weight. Sources in the order of their
    saturation are capped up to the one where the remaining words per weight fall below it. A source of size
    zero has target zero; an empty table has no rows. The windows run over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    order = Window.orderBy("saturation", "source_rank")
    ranked = sizes.withColumn("source_rank", rank).withColumn("weight", by_rank)
    ranked = ranked.withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("saturation", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(all_rows))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    free = F.col("saturation") > F.col("level")
    # the level of the first source that isn't capped holds for all after it
    level = F.min(F.when(free, F.struct(F.col("saturation"), F.col("source_rank"), F.col("level")))).over(all_rows)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return ranked.withColumn("target", target).select("source", "source_rank", "source_size", "weight", "target")


def _ramp(rank: Column, ramps, k: int) -> Column:
    return F.element_at(F.array(*[F.lit(float(r[k])) for r in ramps]), (rank % len(ramps) + 1).cast("int"))


def position(demand: Column, start: Column, end: Column) -> Column:
    """The t at which the integral of start + (end - start) * t over [0, t] reaches `demand` of its whole."""
    a, whole = (end - start) / 2, (start + end) / 2
    root = (-start + F.sqrt(F.greatest(start * start + 4 * a * demand * whole, F.lit(0.0)))) / (2 * a)
    return F.when(F.abs(a) < 1e-12, demand).otherwise(F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0)))


def _place(doc_id: Column) -> Column:
    """A hash of doc_id, from 0 to below 2 ** HASH_BITS."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id), 64 - HASH_BITS)


def _buckets(sized: DataFrame, weights, share: float, repeats: float) -> tuple[DataFrame, DataFrame, int]:
    """(sources, buckets, bits) of rows (source, size, o): buckets (source, b, n, before), b being the leading bits of o; sources as of targets(), with what the passes leave: full, left."""
    bits = min(30, max(6, (sized.count() // BUCKET_ROWS).bit_length()))
    sums = checkpointed(sized.groupBy("source", F.shiftright("o", HASH_BITS - bits).alias("b")).agg(F.sum("size").alias("n")))
    sources = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, repeats)
    goal = F.floor("target")
    sources = sources.withColumn("full", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    sources = checkpointed(sources.withColumn("left", goal - F.col("full") * F.col("source_size")))
    down = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0)))
    return sources, checkpointed(before.alias("a").join(sent(sources).alias("z"), F.col("a.source").eqNullSafe(F.col("z.source"))).select("a.*", "z.source_rank", "z.source_size", "z.target", "z.full", "z.left")), bits


def _with_bucket(rows: DataFrame, buckets: DataFrame, bits: int) -> DataFrame:
    """rows (source, o, ...) with their bucket's columns."""
    met = rows.alias("d").join(sent(buckets).alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.shiftright("d.o", HASH_BITS - bits) == F.col("f.b")))
    return met.select("d.*", *[f"f.{c}" for c in buckets.columns if c != "source"])


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, ramps=RAMPS, names: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, passes, first_position, last_position.

    A source's documents stand in the order of a hash of doc_id. Each pass over them takes whole documents;
    the pass in which the source's target is reached ends inside one document, which is taken in part. So taken
    is never over `repeats` times size, and a source's sum differs from its target by less than one word.
    Documents of equal doc_id and size share their order by chance, but the rows are the same. Null or blank
    texts have size 0 and take nothing, very long ones count whole; null sources form one source, the last.
    Repeated rows are taken one by one; an empty table has an empty result. Other columns of docs, whatever
    their names, are not looked at.
    """
    key = {"doc_id": "doc_id", "source": "source", "text": "text"} | dict(names or {})
    sized = docs.select(F.col(key["doc_id"]).alias("doc_id"), F.col(key["source"]).alias("source"), word_count(F.col(key["text"])).alias("size"))
    sized = checkpointed(sized.withColumn("o", _place(F.col("doc_id"))))
    _, buckets, bits = _buckets(sized, weights, share, repeats)
    inside = Window.partitionBy("source", "b").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_bucket(sized, buckets, bits).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.least(F.greatest(F.col("left") - F.col("at"), F.lit(0)), F.col("size")).cast("long")
    placed = placed.withColumn("part", part).withColumn("taken", F.col("full") * F.col("size") + F.col("part"))
    placed = placed.withColumn("passes", F.when(F.col("size") > 0, F.col("full") + (F.col("part") > 0).cast("long")).otherwise(0))
    start, end = (_ramp(F.col("source_rank"), ramps, k) for k in (0, 1))
    middle = lambda n: (n * F.col("source_size") + F.col("at") + F.col("size") / 2) / F.col("target")
    first = F.when(F.col("passes") > 0, position(F.least(middle(F.lit(0)), F.lit(1.0)), start, end))
    last = F.when(F.col("passes") > 0, position(F.least(middle(F.col("passes") - 1), F.lit(1.0)), start, end))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", first.alias("first_position"), last.alias("last_position"))


def _limits(sized: DataFrame, sources: DataFrame, buckets: DataFrame, bits: int) -> DataFrame:
    """(source, limit_o, limit_t): in the pass in which the target is reached the documents up to this (o, t) are taken, of which most lies below the target.

    Only the one bucket of a source in which that happens is looked through. Rows of equal (o, t), which are
    copies under one id, are taken together.
    """
    edge = checkpointed(buckets.filter("before < left and before + n >= left").select("source", "b", "before", "left"))
    at = F.shiftright("d.o", HASH_BITS - bits) == F.col("e.b")
    rows = sized.alias("d").join(sent(edge).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & at)
    rows = rows.groupBy("d.source", "e.b", "e.before", "e.left", "o", "t").agg(F.sum("size").alias("n"))
    down = Window.partitionBy("source").orderBy("o", "t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(down), F.lit(0)))
    inside = rows.filter(2 * (F.col("left") - F.col("at")) >= F.col("n")).groupBy("source").agg(F.max(F.struct("o", "t")).alias("x"))
    start = edge.select(F.col("source").alias("s"), F.shiftleft("b", HASH_BITS - bits).alias("from"))  # all of the buckets before
    ends = start.join(inside, F.col("s").eqNullSafe(F.col("source")), "left")
    return checkpointed(ends.select("s", F.coalesce("x.o", F.col("from") - 1).alias("limit_o"), F.coalesce("x.t", F.lit(2**63 - 1)).alias("limit_t")).withColumnRenamed("s", "source"))


def curriculum(docs: DataFrame, partitions: int | None = None, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, ramps=RAMPS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents as training takes them: whole copies with copy number and position, range-sorted by position.

    Keeps all columns of docs, whatever their names, and adds copy and position, with underscores behind the
    names if docs has such columns. A document that the mix does not take is left out (null and blank texts
    always); one that it takes twice stands at two positions. The pass in which a source's target is reached
    takes the last document wholly if most of it lies below the target, so a source's sum differs from it by
    half a document at most; copies under one id are taken together there. A place inside a bucket is read from
    the hash, which is as near as a bucket is small. Repeated rows are taken one by one; very long texts whole;
    null sources form one source; an empty table has an empty result.
    """
    o, t = _place(F.col(doc_id)), F.xxhash64(F.col(text))
    sized = checkpointed(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), o.alias("o"), t.alias("t")))
    sources, buckets, bits = _buckets(sized, weights, share, repeats)
    limits = _limits(sized, sources, buckets, bits)
    # the documents stay in one column of their own
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source).alias("source"), F.col(doc_id).alias("id"), o.alias("o"), t.alias("t"), F.col(text).alias("words"))
    rows = rows.filter(F.col("words").rlike(r"[^\x20\x09-\x0D]")).drop("words")
    rows = _with_bucket(rows, buckets, bits).alias("d").join(sent(limits).alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")), "left").select("d.*", "l.limit_o", "l.limit_t")
    below = F.coalesce((F.col("o") < F.col("limit_o")) | ((F.col("o") == F.col("limit_o")) & (F.col("t") <= F.col("limit_t"))), F.lit(False))
    rows = rows.withColumn("passes", (F.col("full") + below.cast("long")).cast("int")).filter("passes > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    width = HASH_BITS - bits
    inside = F.col("before") + F.col("n") * ((F.col("o") - F.shiftleft("b", width)) / float(1 << width))
    demand = F.least(((F.col("copy") - 1) * F.col("source_size") + inside) / F.col("target"), F.lit(1.0))
    start, end = (_ramp(F.col("source_rank"), ramps, k) for k in (0, 1))
    names = [fresh(docs, "copy"), fresh(docs, "position")]
    rows = rows.select("doc", "id", F.col("copy").alias("copy_no"), position(demand, start, end).alias("at"))
    spread = (partitions,) if partitions else ()
    rows = rows.repartitionByRange(*spread, "at", "id").sortWithinPartitions("at", "id")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], F.col("copy_no").alias(names[0]), F.col("at").alias(names[1]))


def op10_curriculum_mix(spark, sf_dir):
    rows = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", "passes", "first_position")
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
