"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has a bit for each place in which over half of a text's shingle hashes have one. Cut into
reach // 2 + 1 segments, two fingerprints that differ in `reach` bits at most have a segment that differs in
one bit at most. So each fingerprint is indexed under every segment with each one of its bits made a wildcard,
fingerprints of an equal variant are joined, and the whole fingerprints are verified.

Only distinct fingerprints are indexed; the documents of one come back at the end by a join on it. A bucket of
variants with two members gives its pair from its min and max alone. Larger ones are joined pair by pair if
they have DENSE members at most; denser ones never are. near_duplicates() then indexes each of their
fingerprints under itself and all that differ in one bit: two link if and only if they share such a neighbour,
and all that share one link to its smallest, so no link is lost. similar_groups(), which works by similarity,
takes stars there and has an exact index behind them: prefixes of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEND_ROWS, added, checkpointed, fresh, lean, sent, small_batches, table
from .components import components

BITS = 64
SHINGLE, REACH, SEED = 3, 2, 42
#: Members of a bucket up to which they are joined pair by pair.
DENSE = 48
#: Of similar_groups(): words of a shingle, segments, their bits, and segments indexed under variants.
SIMILAR_SHINGLE, SEGMENTS, SEGMENT_BITS, INDEXED = 5, 10, 24, 4
#: Members of a variant bucket up to which similar_groups() takes all pairs of it.
PAIRED = 8
#: Shingles from which sets are large, and bits in which large ones of a similarity of 0.8 never differ (36 are expected, with a deviation of 5.6).
SURE_SIZE, FAR_OFF = 64, 72
#: One text in SAMPLE is looked at for common shingles: those in COMMON of them at least, COMMON_KEYS at most.
SAMPLE, COMMON, COMMON_KEYS = 8, 8, 100_000
_BLOCK, _TEXTS = 1 << 16, 256


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of a text's runs of `shingle` words, A-Z lower-cased; of all words if there are fewer."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    line, n = b" ".join(w), max(1, len(w) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[:n].tolist(), ends[min(shingle, len(w)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in pairs), dtype=np.uint64, count=n)


def majority(h: np.ndarray) -> np.ndarray:
    """For each of 64 bits whether over half of the hashes have it."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), _BLOCK):
        part = np.ascontiguousarray(h[at : at + _BLOCK])
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones > len(h)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A text's SimHash of 64 bits, repeats included; 0 without words."""
    return int(np.packbits(majority(shingle_hashes(text, shingle, seed)), bitorder="little").view(np.uint64)[0])


def wide_bits(h: np.ndarray, n: int = SEGMENTS, bits: int = SEGMENT_BITS) -> list[int]:
    """The segments of a SimHash of n * bits bits over distinct shingle hashes; zeros without any."""
    if not len(h):
        return [0] * n
    flags = []
    with np.errstate(over="ignore"):
        for k in range(-(-n * bits // BITS)):  # more bits by mixing the hash
            x = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            flags.append(majority(x ^ (x >> np.uint64(32))))
    flags = np.concatenate(flags)[: n * bits].reshape(n, bits)
    return (flags * (1 << np.arange(bits, dtype=np.int64))).sum(axis=1).tolist()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return added(rows, ["text"], "fp long", lambda: lambda texts: [[_signed(fingerprint(t, shingle, seed)) for t in texts]]).drop("text")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(rows: DataFrame, bits: int) -> DataFrame:
    """(id, key) for each one-wildcard variant of each segment of rows (id, segs); a key holds segment, bit and the rest of the segment."""
    masks = F.array(*[F.lit(((1 << bits) - 1) & ~(1 << j)).cast("long") for j in range(bits)])
    keys = F.flatten(F.transform("segs", lambda x, i: F.transform(masks, lambda m, j: x.bitwiseAND(m).bitwiseOR(F.shiftleft((i * bits + j).cast("long"), 32)))))
    return rows.select("id", F.explode(keys).alias("key"))


def buckets(indexed: DataFrame) -> DataFrame:
    """(key, n, a, b) of the variants that several ids have: their number, the smallest and the largest id."""
    # nearly all keys are single, so nothing is summed up before the shuffle
    return checkpointed(indexed.repartition("key").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n > 1"))


def members(rows: DataFrame, held: DataFrame, bits: int) -> DataFrame:
    """(key, id) of the members of the buckets held, found again from the segments as they are.

    A variant's members have one of two segments, with the wildcard's bit or without it. So only the segments,
    not all their variants, meet the buckets.
    """
    slot, rest = F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    bit = F.expr("shiftleft(1L, cast(slot % {0} as int))".format(bits))
    both = held.select("key", slot.alias("slot"), rest.alias("rest")).select("key", F.expr(f"slot div {bits}").alias("i"), F.explode(F.array("rest", F.col("rest").bitwiseOR(bit))).alias("seg"))
    plain = rows.select("id", F.posexplode("segs").alias("i", "seg")).select("id", F.col("i").cast("long").alias("i"), "seg")
    return both.join(plain, ["i", "seg"]).select("key", "id")


def candidates(rows: DataFrame, held: DataFrame, bits: int, dense: int = DENSE) -> DataFrame:
    """(a, b), a < b: ids that share a bucket of up to `dense` members."""
    own = members(rows, held.filter(f"n > 2 and n <= {dense}").select("key"), bits)
    pairs = own.withColumnRenamed("id", "a").join(own.withColumnRenamed("id", "b"), "key").filter("a < b").select("a", "b")
    return held.filter("n = 2").select("a", "b").unionByName(pairs)


def _neighbours(fps: DataFrame) -> DataFrame:
    """(a, b): fingerprints that share a neighbour at one bit, by a star from its smallest.

    Two that both differ from a third in one bit at most differ in two at most; and two that differ in two
    bits share the one with one of these bits changed. A neighbour has 65 fingerprints around it at most, so
    its group is bounded.
    """
    around = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(BITS)]]
    stars = fps.withColumn("z", F.explode(F.array(*around))).groupBy("z").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    return stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a != b").distinct()


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp) that differ in two bits at most; of dense buckets enough of them to join the same components."""
    half = (1 << BITS // 2) - 1
    rows = fps.select(F.col("fp").alias("id"), F.array(F.col("fp").bitwiseAND(F.lit(half)), F.shiftrightunsigned("fp", BITS // 2)).alias("segs"))
    held = buckets(variants(rows, BITS // 2))
    found = candidates(rows, held, BITS // 2, dense).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= REACH).distinct()
    crowded = held.filter(f"n > {dense}").select("key")
    if not crowded.isEmpty():
        found = found.unionByName(_neighbours(members(rows, crowded, BITS // 2).select(F.col("id").alias("fp")).distinct())).distinct()
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; very long texts are taken
    whole. Repeated rows of an id keep their rows, and an id with two texts joins the components of both only
    where a fingerprint does. A row with a null id gets the component of its fingerprint's other rows, null if
    there are none. Other columns are left out, whatever their names; an empty table has an empty result.
    """
    made = checkpointed(fingerprints(docs, doc_id, text, shingle, seed))
    first = checkpointed(made.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = checkpointed(links(first.select("fp"), dense))
    edges = found.join(first.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b").select("u", "v")
    labels = components(edges)
    ids = first.join(labels.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("label", "first").alias("component_id"))
    return made.join(ids, "fp").select("doc_id", "fp", "component_id")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in pieces, so that the shingle sets of few texts are held at once."""
    for pdf in batches:
        for at in range(0, len(pdf), _TEXTS):
            yield pdf.iloc[at : at + _TEXTS]


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, shingle, seed))


def _set_id(h: np.ndarray) -> int:
    """A signed 64-bit hash of a shingle set."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(h.tobytes(), SEED))


def _prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes of a set of n, in the order of (count among the common ones, hash), of which a set with a similarity of 0.8 has one at least: n - ceil(0.8 n) + 1."""
    if not len(h):
        return h
    rank = np.zeros(len(h), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, counts[at], 0)
    return h[np.lexsort((h, rank))][: len(h) - (4 * len(h) + 4) // 5 + 1]


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that many of a sample of the texts have, ascending, and their counts there. They only set the order of the prefixes: any order is exact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            sets = [shingle_set(t, shingle) for t in pdf["text"].drop_duplicates()]
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)})

    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    held = sample.mapInPandas(lean(run), "key long").groupBy("key").agg(F.count("*").alias("n")).filter(f"n >= {COMMON}").orderBy(F.desc("n"), "key").limit(COMMON_KEYS).collect()
    keys, counts = np.array([r.key for r in held], dtype=np.int64).view(np.uint64), np.array([r.n for r in held], dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _likely(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b, off) of distinct pairs whose sizes allow a similarity of 0.8; off is the number of bits in which they differ.

    Pairs of large sets that differ in over FAR_OFF bits are left out: at 0.8 that is over six standard deviations away.
    """
    off = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    of = lambda side: first.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("segs").alias(f"s{side}"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of("a"), "a").join(of("b"), "b")
    both = both.filter("9 * least(na, nb) >= 4 * (na + nb)").withColumn("off", off)
    return checkpointed(both.filter(f"least(na, nb) < {SURE_SIZE} or off <= {FAR_OFF}").select("a", "b", "off"))


def _closest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, off) those that are the closest one of either set: no more than there are sets."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "off").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "off"))
    best = both.groupBy("x").agg(F.min_by("y", "off").alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components (node, label)."""
    for x in ("a", "b"):
        pairs = pairs.join(sent(labels.select(F.col("node").alias(x), F.col("label").alias(f"c{x}"))), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    return pairs.filter("ca != cb").drop("ca", "cb")


def _verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is 0.8 at least, counted on the sets: 9 * common >= 4 * (n of a + n of b). Only their texts are looked up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            sets = [shingle_set(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"sid": np.array([_set_id(h) for h in sets], dtype=np.int64), "h": [h.view(np.int64) for h in sets]})

    pairs = checkpointed(pairs.select("a", "b"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    need = checkpointed(reps.join(asked, "sid").select(F.col("id").alias("doc_id")).distinct())
    texts = rows.join(sent(need), "doc_id", "left_semi")
    # an id may have other texts too, which nobody has asked for; repeated rows give the same set again
    sets = checkpointed(texts.mapInPandas(lean(run), "sid long, h array<long>").join(asked, "sid", "left_semi").dropDuplicates(["sid"]))
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b")
    return both.filter(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")


def _shared(first: DataFrame) -> DataFrame:
    """(key, sid, n, i) of the prefix hashes that several sets have, i being the place in the prefix. One of them must have it so early that it can be the smaller set of a pair."""
    indexed = first.select("sid", "n", F.posexplode("prefix").alias("i", "key")).repartition("key")
    several = indexed.groupBy("key").agg(F.count("*").alias("c"), F.max(F.expr("n - 9 * i")).alias("least")).filter("c > 1 and least >= 0").select("key")
    return checkpointed(indexed.join(several, "key", "left_semi"))


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, size, sid, n, i, c) of _shared() in the buckets where several components (node, label) meet, c being the set's."""
    rows = shared.join(sent(labels.select(F.col("node").alias("sid"), "label")), "sid", "left").select("key", "sid", "n", "i", F.coalesce("label", "sid").alias("c"))
    mixed = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 != c1").select("key", "size")
    return checkpointed(rows.join(mixed, "key"))


def _enough(a: str, b: str) -> str:
    """Whether two sets may have a similarity of 0.8 if this is the first hash of their prefixes that they share: what is left in both must do."""
    return f"9 * least(n{a} - i{a}, n{b} - i{b}) >= 4 * (n{a} + n{b})"


def _stars(mixed: DataFrame) -> DataFrame:
    """(a, b) of each bucket's sets with the one that has fewest rarer hashes: of a family of copies the one that was changed least, which most of them are like."""
    heads = mixed.groupBy("key").agg(F.min_by(F.struct("sid", "n", "i", "c"), "i").alias("h")).select("key", *[F.col(f"h.{x}").alias(f"{y}h") for x, y in (("sid", "s"), ("n", "n"), ("i", "i"), ("c", "c"))])
    own = mixed.select("key", *[F.col(x).alias(f"{y}m") for x, y in (("sid", "s"), ("n", "n"), ("i", "i"), ("c", "c"))])
    return own.join(heads, "key").filter("cm != ch").filter(_enough("m", "h")).select(F.col("sm").alias("a"), F.col("sh").alias("b"))


def _unmet(mixed: DataFrame, dense: int) -> DataFrame:
    """(a, b) of all sets of different components that may have a similarity of 0.8.

    Two such sets share a hash of their prefixes, and from the first one that they share enough is left in
    both. In buckets of over `dense` members components meet first and their members after that, so that the
    pairs inside a large component are never made.
    """
    side = lambda rows, x: rows.select("key", *[F.col(k).alias(f"{v}{x}") for k, v in (("sid", "s"), ("n", "n"), ("i", "i"), ("c", "c"))])
    few, many = mixed.filter(f"size <= {dense}"), mixed.filter(f"size > {dense}")
    pairs = side(few, "a").join(side(few, "b"), "key").filter("ca < cb").filter(_enough("a", "b"))
    kinds = many.groupBy("key", "c").agg(F.max(F.expr("5 * n - 9 * i")).alias("most"), F.min("n").alias("least"))  # what members have left at most
    of = lambda x: kinds.select("key", F.col("c").alias(f"c{x}"), F.col("most").alias(f"most{x}"), F.col("least").alias(f"least{x}"))
    kinds = of("a").join(of("b"), "key").filter("ca < cb and mosta >= 4 * leastb and mostb >= 4 * leasta").select("key", "ca", "cb")
    crowded = kinds.join(side(many, "a"), ["key", "ca"]).join(side(many, "b"), ["key", "cb"]).filter(_enough("a", "b"))
    return pairs.select(F.col("sa").alias("a"), F.col("sb").alias("b")).unionByName(crowded.select(F.col("sa").alias("a"), F.col("sb").alias("b")))


def _by_variants(first: DataFrame) -> DataFrame:
    """(a, b) of sets that share a whole segment or a one-wildcard variant of one of the first INDEXED: all pairs of small buckets, and stars around the smallest member of others."""
    plain = first.select("sid", F.posexplode("segs").alias("i", "seg"))
    heads = plain.groupBy("i", "seg").agg(F.min("sid").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    equal = plain.join(heads, ["i", "seg"]).filter("a != sid").select("a", F.col("sid").alias("b"))
    indexed = first.select(F.col("sid").alias("id"), F.slice("segs", 1, INDEXED).alias("segs"))
    held = buckets(variants(indexed, SEGMENT_BITS))
    large = held.filter(f"n > {PAIRED}").select("key", "a")
    around = members(indexed, large.select("key"), SEGMENT_BITS).join(large, "key").filter("a != id").select("a", F.col("id").alias("b"))
    return equal.unionByName(candidates(indexed, held, SEGMENT_BITS, PAIRED)).unionByName(around)


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SIMILAR_SHINGLE, dense: int = DENSE) -> DataFrame:
    """(doc_id, group_id): group_id is the smallest doc_id reachable over links of similar texts.

    Texts link if and only if their sets of distinct shingle hashes have a Jaccard similarity of 0.8 at least;
    every link is counted on the sets (but for pairs of large sets over FAR_OFF bits apart, see _likely()). Every
    distinct set is indexed. Null, empty and blank texts have the same empty set; a text of fewer words than a
    shingle has one shingle; very long texts are taken whole. Repeated rows of an id keep their rows, and an id
    with several texts joins the groups of each. Rows with null ids are left out, other columns are not looked
    at, and an empty table has an empty result.

    Fingerprints of SEGMENTS * SEGMENT_BITS bits find most links, by segments and their variants. What that
    misses, as near 0.8 it must, is found by an exact index over all sets: first each bucket's sets meet the one
    of them that was changed least; what is still in different groups then meets wholly, by _unmet(). Of many
    pairs only the closest of each set are looked up first, since the rest mostly lies in one group after that.
    """
    with small_batches(docs.sparkSession):
        return _similar_groups(docs, doc_id, text, shingle, dense)


def _similar_groups(docs: DataFrame, doc_id: str, text: str, shingle: int, dense: int) -> DataFrame:
    """similar_groups(); everything that sends texts to Python is run inside."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    common, counts = _common(rows, shingle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            sets = [shingle_set(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "sid": np.array([_set_id(h) for h in sets], dtype=np.int64), "n": np.array([len(h) for h in sets], dtype=np.int64),
                "segs": [wide_bits(h) for h in sets], "prefix": [_prefix(h, common, counts).view(np.int64) for h in sets],
            })

    kind = docs.schema[doc_id].dataType.simpleString()
    made = rows.mapInPandas(lean(run), f"doc_id {kind}, sid long, n long, segs array<long>, prefix array<long>")
    made = checkpointed(made.withColumn("row", F.monotonically_increasing_id()))  # fixed by being kept
    reps = checkpointed(made.groupBy("sid").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.count("*").alias("copies")))
    again = checkpointed(made.select("sid", "row").join(reps.filter("copies > 1").select("sid", F.col("row").alias("kept")), "sid").filter("row != kept").select("row"))
    first = made.join(sent(again), "row", "left_anti").select("sid", "n", "segs", "prefix")

    labels = None

    def link(pairs: DataFrame) -> DataFrame:
        """The components with the links among the pairs."""
        found = _verified(pairs, reps, rows, shingle).select(F.col("a").alias("u"), F.col("b").alias("v"))
        return components(found if labels is None else found.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))

    labels = link(_closest(_likely(_by_variants(first), first)))
    shared = _shared(first)
    labels = link(_closest(_likely(_stars(_mixed(shared, labels)), first)))
    pairs = _likely(_unmet(_mixed(shared, labels), dense), first)
    labels = link(_closest(pairs))
    labels = link(_apart(pairs, labels))
    ids = reps.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "id", F.coalesce("label", "sid").alias("label"))
    least = ids.groupBy("label").agg(F.min("id").alias("group_id"))
    return made.select("doc_id", "sid").join(ids.join(least, "label").select("sid", "group_id"), "sid").select("doc_id", "group_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", send_rows: int = SEND_ROWS, **options) -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest doc_id. All columns are kept, whatever their names.

    Null, empty and blank texts are one group. Rows with null ids stay. Of rows that repeat an id one stays; an
    id that is the smallest of any group stays. Very long texts are compared whole; an empty table stays empty.
    """
    groups = checkpointed(similar_groups(docs, doc_id, text, **options))
    name = fresh(docs, "gone")
    gone = groups.filter("doc_id != group_id").select(F.col("doc_id").alias(name)).distinct()
    gone = checkpointed(gone.join(groups.select(F.col("group_id").alias(name)).distinct(), name, "left_anti"))
    kept = docs.join(sent(gone, send_rows), F.col(doc_id) == F.col(name), "left_anti")
    again = groups.groupBy("doc_id").count().filter("count > 1")
    return kept if again.isEmpty() else kept.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(kept.filter(F.col(doc_id).isNull()))


def op2_simhash_dedup(spark, sf_dir):
    rows = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
