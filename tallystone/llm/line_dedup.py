"""Line dedup: lines that many sites share are boilerplate and are removed everywhere.

A line stands for itself by the hash of its trimmed text. Its spread is the number of distinct sites that
have it. One HyperLogLog sketch for each line hash, merged by aggregation, estimates the spread; hashes whose
estimate is near the threshold get an exact distinct count. Only DataFrame functions run here.

Hashes with a single site are left out before the sketches by a min and a max of the site's hash. Pairs of hash and
site are summed up before they meet anything, so a line that half of the documents hold is one row of each task and
site. Lines are removed by their hash, and rows without such lines aren't changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEND_ROWS, checkpointed, fresh, table

#: Sites from which on a line is boilerplate; log2 of a sketch's registers; relative band of exact counts.
MIN_SITES, LG_K, BAND = 6, 8, 0.35
#: Parts of a hash that many rows have.
SALT = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", ""))


def line_rows(docs: DataFrame, text: str, site: str, row_id: str) -> DataFrame:
    """(row_id, h, s) of each line that isn't blank."""
    lines = docs.select(F.col(row_id).alias("row_id"), F.xxhash64(F.lit("site"), F.col(site)).alias("s"), F.explode(_lines(F.col(text))).alias("line"))
    return lines.filter(F.col("line").rlike(r"[^ \t\r]")).select("row_id", "s", _hash(F.col("line")).alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """(h, sites) of the hashes with min_sites sites or more; sites is exact near the threshold, else an estimate."""
    spread = lines.groupBy("h").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    shared = checkpointed(spread.filter((F.col("lo") != F.col("hi")) & (F.col("n") >= min_sites)).select("h"))
    # one row for each pair of hash and site, summed up before they meet anything, so that a common line is few rows and the sketches get no repeats
    summed = lambda rows: rows.groupBy("h", "s").agg(F.count("*").alias("rows"))
    few = shared.count() <= SEND_ROWS
    pairs = checkpointed(summed(lines.join(F.broadcast(shared), "h", "left_semi")) if few else summed(lines).join(shared, "h", "left_semi"))
    sketches = pairs.groupBy("h").agg(F.hll_sketch_agg("s", F.lit(lg_k)).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    sketches = checkpointed(sketches.filter(F.col("sites") >= min_sites * (1 - band)))
    sure = sketches.filter(F.col("sites") > min_sites * (1 + band))
    near = sketches.filter(F.col("sites") <= min_sites * (1 + band))
    exact = pairs.join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.unionByName(exact)


def removed_lines(docs: DataFrame, text: str = "text", site: str = "source", row_id: str = "doc_id", **limits) -> DataFrame:
    """(row_id, gone): the hashes of the boilerplate lines of each row id that has some.

    A hash that many rows have is dealt into SALT parts where the hashes are too many to be sent to all.
    """
    lines = line_rows(docs, text, site, row_id)
    found = checkpointed(boilerplate(lines, **limits).select("h"))
    if found.count() <= SEND_ROWS:
        hits = lines.join(F.broadcast(found), "h", "left_semi")
    else:
        salt = F.pmod(F.xxhash64(F.lit(4), "row_id"), F.lit(SALT))
        hits = lines.withColumn("part", salt).join(found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["h", "part"], "left_semi")
    return hits.groupBy("row_id").agg(F.collect_set("h").alias("gone"))


def clean(docs: DataFrame, text: str = "text", site: str = "source", row_id: str = "doc_id", **limits) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines, n_removed.

    A null site counts as one site. Blank lines always stay. Null text stays null and has one (blank) line;
    very long texts are cleaned whole. Rows that share an id, or have none, each lose their own boilerplate lines
    and no others. All columns are kept, whatever their names; n_lines and n_removed get underscores behind their
    names if docs has such columns. An empty table stays empty.
    """
    gone = removed_lines(docs, text, site, row_id, **limits)
    own, lost = fresh(docs, "row_of_gone"), fresh(docs, "gone_hashes")
    at = docs.join(gone.select(F.col("row_id").alias(own), F.col("gone").alias(lost)), F.col(row_id).eqNullSafe(F.col(own)), "left").drop(own)
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(lost), _hash(x)))
    names = [fresh(docs, "n_lines"), fresh(docs, "n_removed")]
    after = at.withColumns({names[0]: F.size(lines).cast("long"), lost: F.when(F.col(lost).isNotNull() & F.col(text).isNotNull(), kept)})
    after = after.withColumn(names[1], F.coalesce(F.col(names[0]) - F.size(lost), F.lit(0)).cast("long"))
    return after.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(lost, "\n"))).drop(lost)


def op4_line_spread(spark, sf_dir):
    rows = clean(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
