"""URL filters: rules by host suffix and path prefix, and a Bloom filter cascade for listed keys.

A cascade holds the listed keys exactly with respect to a known universe of keys. Level 1 is a Bloom filter
of the listed keys; level 2 of those keys of the universe that level 1 takes wrongly; level 3 of the listed
keys that level 2 takes; and so on until a level takes none wrongly. A key of the universe is listed if the
first level that misses it has an even number. Keys outside the universe can be answered wrongly, so the
universe is always taken from the corpus that is filtered.

Keys are dealt into shards of bounded size by hash. A shard's cascade is built by one task from the shard's
distinct keys; nothing depends on the number of rows that a key has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, added, checkpointed, fresh, table

#: The rules of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Keys of the universe in a shard, and MB of all filters up to which they are sent to every executor.
SHARD_KEYS, SEND_MB = 200_000, 64
BITS_PER_KEY, HASHES = 10, 7


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does. Equally long rules: the first given."""
    rule = verdict = None
    for does, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, does) if verdict is None else verdict.when(fits, does)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _bits(h1: np.ndarray, h2: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    """Bit numbers (keys x hashes) of a level."""
    with np.errstate(over="ignore"):
        a = (h1 ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (h2 + np.uint64(level)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(n_bits)


def _filter(h1: np.ndarray, h2: np.ndarray, level: int) -> tuple[int, np.ndarray]:
    n_bits = max(64, math.ceil(len(h1) * BITS_PER_KEY / 64) * 64)
    field = np.zeros(n_bits, dtype=bool)
    field[_bits(h1, h2, level, n_bits).ravel()] = True
    return n_bits, np.packbits(field)


def _takes(bits: np.ndarray, n_bits: int, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    at = _bits(h1, h2, level, n_bits)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The levels of one shard from its distinct keys."""
    h1, h2 = (pdf[c].to_numpy().astype(np.uint64) for c in ("h1", "h2"))
    listed = pdf["listed"].to_numpy(dtype=bool)
    inside, outside, rows, level = np.flatnonzero(listed), np.flatnonzero(~listed), [], 1
    while len(inside):
        n_bits, bits = _filter(h1[inside], h2[inside], level)
        rows.append((int(pdf["shard"].iloc[0]), level, n_bits, bits.tobytes()))
        taken = outside[_takes(bits, n_bits, h1[outside], h2[outside], level)] if len(outside) else outside
        inside, outside, level = taken, inside, level + 1
    return pd.DataFrame(rows, columns=["shard", "level", "n_bits", "bits"])


def _is_listed(levels: list[tuple[int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out, live = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
    for k, (n_bits, bits) in enumerate(levels, 1):
        if not len(live):
            break
        hit = _takes(bits, n_bits, h1[live], h2[live], k)
        out[live[~hit]] = k % 2 == 0
        live = live[hit]
    out[live] = len(levels) % 2 == 1
    return out


def hashed(key: Column, shards: int) -> list[Column]:
    """Two 64-bit hashes that stand for a key, and its shard."""
    h1 = F.xxhash64(key)
    return [h1.alias("h1"), F.xxhash64(F.lit(7), key, F.lit(9)).alias("h2"), F.pmod(F.xxhash64(F.lit(3), key), F.lit(shards)).cast("int").alias("shard")]


def build_cascade(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(levels, number of shards) from rows (key, listed); a key is listed if any of its rows is, null keys are left out.

    levels: shard, level, n_bits, bits. No listed key: no rows.
    """
    keys = checkpointed(universe.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed")))
    shards = max(1, math.ceil(keys.count() / shard_keys))
    dealt = keys.select("listed", *hashed(F.col("key"), shards))
    return checkpointed(dealt.groupBy("shard").applyInPandas(_build, "shard int, level int, n_bits long, bits binary")), shards


def _levels(rows) -> dict[int, list[tuple[int, np.ndarray]]]:
    out: dict[int, list] = {}
    for shard, _, n_bits, bits in sorted((int(r[0]), int(r[1]), int(r[2]), r[3]) for r in rows):
        out.setdefault(shard, []).append((n_bits, np.frombuffer(bits, dtype=np.uint8)))
    return out


def apply_cascade(rows: DataFrame, key: Column, levels: DataFrame, shards: int, send_mb: int = SEND_MB) -> DataFrame:
    """rows with `listed` (`listed_` if rows has such a column). Filters of up to send_mb go to every executor; larger ones meet their rows by shard.

    In the second way a shard's keys are cut into pieces of about SHARD_KEYS, each with its own copy of the
    shard's filters; a key goes to one of them once, however many rows have it, and the rows join what it gets.
    """
    own = [fresh(rows, n) for n in ("h1", "h2", "shard")]
    wide = rows.select("*", *[c.alias(n) for c, n in zip(hashed(key, shards), own, strict=True)])
    mb = (levels.agg(F.sum(F.length("bits"))).first()[0] or 0) / 1e6
    if mb <= send_mb:
        sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in levels.collect()])

        def start():
            known = _levels(sent.value)

            def member(h1: list, h2: list, shard: list) -> list[list]:
                h1, h2, shard = np.array(h1, dtype=np.int64).view(np.uint64), np.array(h2, dtype=np.int64).view(np.uint64), np.array(shard)
                listed = np.zeros(len(shard), dtype=bool)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    listed[at] = _is_listed(known.get(int(s), []), h1[at], h2[at])
                return [listed.tolist()]

            return member

        return added(wide, own, "listed boolean", start).drop(*own)
    keys = wide.select(*[F.col(n).alias(k) for n, k in zip(own, ("h1", "h2", "shard"), strict=True)]).distinct()
    pieces = max(1, math.ceil(keys.count() / (shards * SHARD_KEYS)))
    keys = keys.withColumn("piece", F.pmod(F.xxhash64("h2"), F.lit(pieces)).cast("int"))
    copies = levels.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = _levels(right[["shard", "level", "n_bits", "bits"]].itertuples(index=False, name=None))
        known = next(iter(known.values()), [])
        return left[["h1", "h2"]].assign(listed=_is_listed(known, left["h1"].to_numpy().astype(np.uint64), left["h2"].to_numpy().astype(np.uint64)))

    found = keys.groupBy("shard", "piece").cogroup(copies.groupBy("shard", "piece")).applyInPandas(meet, "h1 long, h2 long, listed boolean")
    name = fresh(rows, "listed")
    return wide.join(found.select(F.col("h1").alias(own[0]), F.col("h2").alias(own[1]), F.col("listed").alias(name)), own[:2]).drop(*own)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each page: page_id, host, path, rule, listed, verdict.

    A page's key is its host and path; `listed` has a column key. The verdict is that of the longest rule
    that fits; else block for a listed key, else allow. An url without host (null, no `://`) has an empty
    key, which is never listed, and so is allowed. Repeated rows are judged one by one, very long urls whole;
    other columns of pages, whatever their names, are left out; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    universe = parts.select(key.alias("key"), F.lit(False).alias("listed")).filter("key != ''")
    universe = universe.unionByName(listed.select("key", F.lit(True).alias("listed")).filter("key != ''"))
    levels, shards = build_cascade(universe)
    rows = apply_cascade(parts, key, levels, shards)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed") & (key != ""), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, own).alias("verdict"))


def feed(spark, sf_dir) -> DataFrame:
    """The listed keys of the query: a feed of one key in eight of those that the corpus has, chosen by md5."""
    host, path = host_and_path(F.col("url"))
    keys = table(spark, sf_dir, "pages", "url").select(F.concat(host, path).alias("key")).filter("key != ''")
    return keys.filter(F.substring(F.md5(F.encode("key", "UTF-8")), 1, 1).isin("0", "1"))


def op9_url_cascade(spark, sf_dir):
    rows = judge(table(spark, sf_dir, "pages", "page_id", "url"), feed(spark, sf_dir))
    return rows.select("page_id", "host", "path", "rule", "verdict")
