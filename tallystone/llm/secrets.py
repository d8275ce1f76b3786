"""Secret scans: key assignments, access keys, hex runs, and strings of high entropy.

Only DataFrame functions run here. Offsets of all matches of a pattern come from the text cut at its
matches: the lengths of the pieces and of the matches add up to the positions.

The entropy method looks at candidate strings (long runs of key characters holding a letter and a digit). A
candidate with slashes is cut at its parts that are words or numbers; what stands between is looked at. A window of WINDOW characters slides over a candidate; its character counts, and from them the sum of
c * log2(c), are updated for the one character that enters and the one that leaves. The window's Shannon
entropy, log2(WINDOW) - sum / WINDOW, is held against the limit of the candidate's character class. The span
runs from the first to the last window over the limit, unless an allow list knows the run or the span, or a
pattern's span overlaps it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

#: Fixed patterns by kind, in their order: pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Matches whose positions are summed up together; bits of a character's count, and counts in a long.
BLOCK, COUNT_BITS, PACKED = 128, 5, 12
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Class of a candidate (the first that matches all of it) and the least entropy of a window, in bits.
CLASSES = ((r"^[0-9a-fA-F]+$", 2.9), (r"^[^A-Z]+$|^[^a-z]+$", 3.5), (r"^[\s\S]+$", 3.7))
_HUMP, _END = r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[A-Z][a-z]{2,})*", r"(?![^/])"
#: Parts of a path that are words or numbers; others, and parts of one or two characters, stay together with their slashes.
WORDLIKE = rf"(?=[^/]{{3}})(?:{_HUMP}(?:[-_](?:{_HUMP}|[0-9]+))*[-_]?[0-9]{{0,4}}|[0-9]{{3,8}}|[0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?){_END}"
_PART = rf"(?!{WORDLIKE})[^/]+"
RUN = rf"(?<![^/]){_PART}(?:/+{_PART})*"
#: Runs that are no secrets: UUIDs and words joined by hyphens. Spans that aren't: examples, dates and long repeats.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}$",
)
ALLOW_SPAN = (
    r"(?i)example|placeholder|changeme|dummy",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"(.)\1{7}",
)
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, found), by code points.

    Positions are running sums, first inside blocks of BLOCK matches, then over the blocks, so that a text of
    very many matches isn't copied for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("long"), m.alias("found")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + x["gap"]
        end = here + x["long"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(here.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("out"))

    def summed(m: Column) -> Column:
        n = F.greatest(F.ceil(F.size(m) / BLOCK).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.slice(m, k * BLOCK + 1, F.lit(BLOCK)), start, step))

    def put_together(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, at: F.transform(b["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["found"].alias("found"))))
        return F.flatten(moved)

    return _with(_with(both, summed), put_together)


def _with(value: Column, f) -> Column:
    """f(value), where value is made once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _base(text: Column, rank: int) -> Column:
    kind, pattern, group, least = KINDS[rank]
    spans = F.filter(_located(text, pattern), lambda x: F.length(F.regexp_extract(x["found"], pattern, group)) >= least)
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _hot(candidate: Column) -> Column:
    """(first, last): starts of the first and the last window over the limit; nulls if there is none.

    The counts of a window lie in a few longs, PACKED of them in each, so that a move changes two places only.
    """
    limit = F.when(candidate.rlike(CLASSES[0][0]), CLASSES[0][1]).when(candidate.rlike(CLASSES[1][0]), CLASSES[1][1]).otherwise(CLASSES[2][1])
    place = lambda x: F.instr(F.lit(ALPHABET), x) - 1
    signs = F.transform(F.filter(F.split(candidate, ""), lambda x: x != ""), lambda x: F.struct(F.floor(place(x) / PACKED).cast("int").alias("word"), (COUNT_BITS * (place(x) % PACKED)).alias("bit")))
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    none = F.lit(None).cast("int")
    words = -(-len(ALPHABET) // PACKED)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).cast("double").alias("sum"), none.alias("first"), none.alias("last"))
    nothing = F.struct(F.lit(-1).alias("word"), F.lit(0).alias("bit"))
    moves = F.zip_with(signs, F.concat(F.array_repeat(nothing, WINDOW), signs), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    moves = F.slice(F.transform(moves, lambda x, i: F.struct(x["enters"].alias("enters"), x["leaves"].alias("leaves"), i.alias("i"))), F.lit(1), F.size(signs))
    w = lambda n: F.element_at(weigh, n + 1)
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])
    count = lambda counts, x: F.call_function("shiftright", F.element_at(counts, F.greatest(x["word"], F.lit(0)) + 1), x["bit"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        same, goes = (enters["word"] == leaves["word"]) & (enters["bit"] == leaves["bit"]), leaves["word"] >= 0
        out, into = count(acc["counts"], leaves), count(acc["counts"], enters)
        total = acc["sum"] + F.when(same, 0.0).otherwise(w(into + 1) - w(into) + F.when(goes, w(F.greatest(out - 1, F.lit(0))) - w(out)).otherwise(0.0))
        zero = F.lit(0).cast("long")
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == enters["word"], one(enters)).otherwise(zero) - F.when(j == leaves["word"], one(leaves)).otherwise(zero))
        over = (x["i"] + 1 >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= limit)
        at = x["i"] + 1 - WINDOW
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(acc["first"].isNull() & over, at).otherwise(acc["first"]).alias("first"), F.when(over, at).otherwise(acc["last"]).alias("last"))

    return F.aggregate(moves, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _any(s: Column, patterns) -> Column:
    return s.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def _entropy(text: Column, base: Column, allow=ALLOW, allow_span=ALLOW_SPAN) -> Column:
    likely = lambda s: (F.length(s) >= WINDOW) & s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~_any(s, allow)
    shift = lambda c: F.transform(_located(c["found"], RUN), lambda r: F.struct((c["start"] + r["start"]).alias("start"), r["found"].alias("found")))
    runs = F.filter(F.flatten(F.transform(_located(text, CANDIDATE), shift)), lambda x: likely(x["found"]))
    hot = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["found"].alias("found"), _hot(x["found"]).alias("hot")))
    hot = F.filter(hot, lambda x: x["hot"]["first"].isNotNull() & ~_any(F.substring(x["found"], x["hot"]["first"] + 1, x["hot"]["last"] - x["hot"]["first"] + WINDOW), allow_span))
    spans = F.transform(
        hot, lambda x: F.struct((x["start"] + x["hot"]["first"]).cast("long").alias("start"), F.lit(len(KINDS)).alias("rank"), (x["start"] + x["hot"]["last"] + WINDOW).cast("long").alias("end"), F.lit("entropy").alias("kind"))
    )
    apart = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(text.rlike(CANDIDATE), apart.cast(SPAN)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, text: str = "text", allow=ALLOW, allow_span=ALLOW_SPAN) -> DataFrame:
    """docs with `secrets` (`secrets_` if docs has such a column): spans (start, rank, end, kind) by start, then kind.

    Offsets are code points, the end exclusive. Null and empty texts have none, very long ones are scanned whole;
    repeated rows are scanned one by one; all columns are kept, whatever their names; an empty table has an empty
    result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = fresh(docs, "base_spans")
    rows = docs.withColumn(base, F.concat(*[_base(whole, k) for k in range(len(KINDS))]))
    return rows.withColumn(fresh(docs, "secrets"), F.array_sort(F.concat(base, _entropy(whole, F.col(base), allow, allow_span)))).drop(base)


def redact(scanned: DataFrame, text: str = "text", mask: str = "*") -> DataFrame:
    """Rows of scan() with the characters of every span in `secrets` masked."""
    signs = F.transform(F.split(F.col(text), ""), lambda c, i: F.when(F.exists("secrets", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit(mask)).otherwise(c))
    return scanned.withColumn(text, F.when(F.size("secrets") > 0, F.array_join(signs, "")).otherwise(F.col(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark, sf_dir):
    rows = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(KINDS))
    of = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, kind[0]))).cast("long").alias(f"n_{kind[0]}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
