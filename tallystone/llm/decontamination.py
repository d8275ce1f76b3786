"""Benchmark decontamination by a generalised suffix automaton of the items' words.

The automaton accepts every run of words of every item. A document's words are streamed through it; at each
word it holds the longest run ending there that some item has. A run of `window` words or more marks all its
words; an item with fewer words marks its words where it occurs whole. For each state the automaton knows the
items that hold it, so a marked run also tells its items.

Words that no item has reset the automaton, so only runs of known words are walked. Items are dealt into
shards of bounded size, one automaton each, and a block of documents meets one after the other; the automata
of larger item sets need more time, not more memory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, checkpointed, fresh, table

WINDOW = 10
#: A document goes wholly if at least this part of its words is marked; else the marked spans go.
MAX_COVERAGE = 0.5
#: UTF-8 bytes of the items of one automaton.
SHARD_BYTES = 4_000_000
#: Bytes of documents for which a task goes through several automata once.
BLOCK_BYTES = 64 << 20
RESULTS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[bytes]:
    """A text's words, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: dict[int, set] = {}
        short: dict[int, tuple[int, set]] = {}
        self.least = window
        for item_id, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            last = 0
            for c in own:
                last = self._extend(last, c)
                ends.setdefault(last, set()).add(item_id)
            if own and len(own) < window:
                short.setdefault(last, (len(own), set()))[1].add(item_id)
                self.least = min(self.least, len(own))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        held: dict[int, set] = {}
        for v in reversed(order):
            if self.length[v] >= window:
                held.setdefault(v, set()).update(ends.get(v, ()))
                if self.length[self.link[v]] >= window:
                    held.setdefault(self.link[v], set()).update(held[v])
        #: the state of the last `window` words, the items there, and (length, items) of short items that end here
        self.base, self.short = [0] * len(self.length), [()] * len(self.length)
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.base[v] = v if self.length[up] < window else self.base[up]
            self.short[v] = self.short[up] + ((short[v],) if v in short else ())
        self.items = {v: held[v] for v in set(self.base) if v}

    def _new(self, length: int, link: int, after: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        """The state of last's longest run with c behind it."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        half = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = half
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        return half

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(marked spans of words, end exclusive and joined where they touch; items)."""
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, -1) for w in text), dtype=np.int32, count=len(text))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (numbers >= 0).view(np.int8), [0]])))
        spans: list[list[int]] = []
        found: set = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._walk(numbers[a:b].tolist(), a, spans, found)
        return [(a, b) for a, b in spans], found

    def _walk(self, run: list[int], offset: int, spans: list[list[int]], found: set) -> None:
        after, link, length, base, short, window = self.next, self.link, self.length, self.base, self.short, self.window
        v = n = 0
        for i, c in enumerate(run, offset + 1):
            while v and c not in after[v]:
                v = link[v]
                n = length[v]
            u = after[v].get(c)
            if u is None:
                n = 0
                continue
            v, n = u, n + 1
            long = n if n >= window else 0
            if long:
                found |= self.items[base[v]]
            for m, items in short[v]:
                if m <= n:
                    found |= items
                    long = max(long, m)
            if long:
                start = i - long
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without spans of its words."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    keep, last = [], 0
    for a, b in spans:
        keep.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return " ".join(x for x in (*keep, text[last:]) if x)


def cut(text: str, automata: list[Automaton]) -> str:
    """A text without marked spans, also without those that come up where the rest meets."""
    while found := _union([s for a in automata for s in a.match(words(text))[0]]):
        text = without(text, found)
    return text


class Shards:
    """The automata of an item set's shards, one after the other; a single one is kept, of several only one is there at a time."""

    def __init__(self, sent: list, window: int):
        self.sent, self.window = sent, window
        self.only = Automaton(sent[0].value, window) if len(sent) == 1 else None

    def __iter__(self) -> Iterator[Automaton]:
        if self.only:
            yield self.only
            return
        for part in self.sent:
            yield Automaton(part.value, self.window)
            part.__dict__.pop("_value", None)  # it is read again from the executor's copy

    def match(self, texts: list[str | None]) -> list[tuple[list, set]]:
        """(spans, items) of each text."""
        spans, held = [[] for _ in texts], [set() for _ in texts]
        for own in self:
            for k, t in enumerate(texts):
                if t is not None:
                    more, found = own.match(words(t))
                    if more:
                        spans[k] += more
                        held[k] |= found
        return [(_union(s), h) for s, h in zip(spans, held, strict=True)]

    def cut(self, texts: list[str], spans: list[list]) -> list[str]:
        """Texts without the spans, and without what is marked in the rest."""
        texts = [without(t, s) for t, s in zip(texts, spans, strict=True)]
        at = list(range(len(texts)))
        while at:
            found = self.match([texts[k] for k in at])
            at, again = [k for k, (s, _) in zip(at, found, strict=True) if s], [s for s, _ in found if s]
            for k, s in zip(at, again, strict=True):
                texts[k] = without(texts[k], s)
        return texts


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    columns: tuple[str, ...] = (),
    clean: bool = True,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row for each document: doc_id, the columns in `columns`, n_words, n_hit, items (sorted as strings), spans (of words), and with clean=True dropped and clean_text.

    clean_text is the text without marked spans; a document of which max_coverage or more is marked has
    dropped=true and an empty clean_text. Null and empty texts have no words and are kept as they are, very long
    ones are taken whole. Null item ids and items without words mark nothing; no items: nothing is marked; equal
    items are all named. Repeated rows are judged one by one; an empty table has an empty result. A result whose
    name is in `columns` gets underscores behind it; docs' other columns are left out.

    Items are sent in shards of up to shard_bytes, and documents aren't moved. One shard's automaton is built
    once by a task; with more shards a task builds one after the other for each BLOCK_BYTES of its documents, so
    that more items take more time and not more memory.
    """
    spark = docs.sparkSession
    small = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    n_bytes = small.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, math.ceil(n_bytes / shard_bytes))
    dealt = small.withColumn("s", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    dealt = dealt if shards == 1 else checkpointed(dealt)
    sent = [spark.sparkContext.broadcast([(r.i, r.t) for r in dealt.filter(F.col("s") == s).collect()]) for s in range(shards)]

    def start():
        parts = Shards(sent, window)

        def judge(texts: list[str | None]) -> list[list]:
            found = parts.match(texts)
            spans, n_words = [s for s, _ in found], [0 if t is None else len(words(t)) for t in texts]
            n_hit = [sum(b - a for a, b in s) for s in spans]
            out = [n_words, n_hit, [sorted(h) for _, h in found], [[{"start": a, "end": b} for a, b in s] for s in spans]]
            if clean:
                gone = [bool(s) and h >= max_coverage * n for s, h, n in zip(spans, n_hit, n_words, strict=True)]
                kept, hit = [None if t is None else "" if g else t for t, g in zip(texts, gone, strict=True)], [k for k, s in enumerate(spans) if s and not gone[k]]
                for k, t in zip(hit, parts.cut([texts[k] for k in hit], [spans[k] for k in hit]), strict=True):
                    kept[k] = t
                out += [gone, kept]
            return out

        return judge

    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(f"`{c}`") for c in columns])
    own = fresh(rows, "text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(f"`{c}`") for c in columns], F.col(text).alias(own))
    return added(rows, [own], RESULTS + ", dropped boolean, clean_text string" * clean, start, BLOCK_BYTES if shards > 1 else 0).drop(own)


def op3_decontaminate(spark, sf_dir):
    rows = decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), clean=False)
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
