"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms, case, letters of other scripts that look like Latin ones, and
digits and signs that stand for letters; i, l and 1 become one letter. Words are then matched against stems
(the start of a word) and whole words, the longest one first; an exception phrase matches before the words in
it and weighs nothing.

The lexicon is learned from labelled rows: a stem's weight is the logarithm of its rate among the words of
toxic texts over that among the others', kept where its share of documents differs beyond chance. A logistic
curve over the sum of weights, the same per word, and the length, fitted on labelled rows that the lexicon
has not seen, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, checkpointed, fresh, lean, table

#: Labelled rows that are fitted at most, chosen by a hash of the id. They bound the lexicon too: a stem must be in LEAST_DOCS of them.
FIT_ROWS = 20_000
PREFIXES = (4, 5, 6, 7, 8)
#: Toxic documents that must have a stem, and the least likelihood ratio (G) of its share among them.
LEAST_DOCS, LEAST_G = 3, 18.0
#: Phrases that are harmless though a word of them may be in the lexicon.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "class clown", "idiot proof", "pond scum", "sore loser")
#: Letters of other scripts that look like Latin ones, and signs that stand for letters; i, l and 1 are one.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "η": "n", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_FOLD = {ord(a): b.replace("l", "i") for a, b in HOMOGLYPHS.items()} | {ord("l"): "i"}
_SIGN = {ord(a): b for a, b in SIGNS.items()}
_WORD = re.compile(r"[^\W_]+(?:[@$!|]+[^\W_]+)*")
_NUMBER = re.compile(r"[0-9]+")


def folded(text: str | None) -> list[str]:
    """A text's words after folding; numbers stay as they are."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out = _WORD.findall(text.lower())
    sign = re.compile(r"[0-9@$!|]").search
    words = " ".join([w.translate(_SIGN) if sign(w) and not _NUMBER.fullmatch(w) else w for w in out] if sign(text) else out)
    return (words.replace("l", "i") if words.isascii() else words.translate(_FOLD)).split(" ") if words else []


def _stems(word: str) -> set[str]:
    return {word[:n] for n in PREFIXES if n < len(word)} | {word + " "}


@dataclass
class Lexicon:
    """Weights by stem (a whole word ends with a blank), exception phrases, and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...] = (-2.0, 1.0, 1.0, 0.0)

    def automaton(self):
        import ahocorasick

        known = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            known.add_word(" " + stem, weight)
        for phrase in self.exceptions:
            known.add_word(" " + "  ".join(folded(phrase)) + " ", 0.0)
        if len(known):
            known.make_automaton()
        return known

    def features(self, known, text: str | None) -> tuple[float, float, float]:
        words = folded(text)
        total = sum(w for _, w in known.iter_long(" " + "  ".join(words) + " ")) if words and len(known) else 0.0
        return math.log1p(total), math.log1p(100 * total / (len(words) + 10)), math.log1p(len(words)) / 5

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions=EXCEPTIONS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """The lexicon of up to `rows` labelled documents, of which a third fits the curve only.

    Documents whose crc32 of the id modulo 5 is 0 are never looked at. Null labels and ids are left out; an id
    that has several labels or texts counts with each. Without labelled rows of both kinds the lexicon is
    empty and the curve gives every text the same low score. The labels that are fitted, `rows` at most, are sent
    to every executor, so only the texts that have one are moved.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).distinct()
    known = known.filter(F.crc32(F.col("i").cast("string")) % 5 != 0).orderBy(F.xxhash64("i"), "i", "y").limit(rows)
    own = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(known), "i").withColumn("held", F.pmod(F.xxhash64(F.lit(6), "i"), F.lit(3)) == 0)
    own = checkpointed(own.repartition("i"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, d, total = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
        for pdf in batches:
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                y, own = int(y != 0), Counter(folded(t))
                stems: Counter = Counter()
                for w, k in own.items():
                    for s in _stems(w):
                        stems[s] += k
                n[y].update(stems)
                d[y].update(stems.keys())
                total[y] += sum(own.values())
                d[y][""] += 1
                n[y][""] += sum(own.values())
        keys = list(n[0].keys() | n[1].keys())
        if keys:
            yield pd.DataFrame({"stem": keys, **{f"{c}{y}": [x[y][k] for k in keys] for c, x in (("n", n), ("d", d)) for y in (0, 1)}})

    stems = own.filter("not held").select("t", "y").mapInPandas(lean(count), "stem string, n0 long, n1 long, d0 long, d1 long")
    stems = checkpointed(stems.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")]).filter(f"stem = '' or d1 >= {LEAST_DOCS}"))
    of = stems.filter("stem = ''").first()
    if of is None or not of.d0 or not of.d1:
        return Lexicon({}, tuple(exceptions), (-3.0, 0.0, 0.0, 0.0))
    rate = F.log(((F.col("n1") + 0.5) / of.n1) / ((F.col("n0") + 0.5) / of.n0))
    whole = float(of.d0 + of.d1)
    part = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * whole / (row * column))).otherwise(0.0)
    having = F.col("d0") + F.col("d1")
    cells = [(F.col("d1"), of.d1, having), (F.col("d0"), of.d0, having), (of.d1 - F.col("d1"), of.d1, whole - having), (of.d0 - F.col("d0"), of.d0, whole - having)]
    g = 2 * sum((part(*c) for c in cells), F.lit(0.0))
    best = stems.filter("stem != ''").select("stem", rate.alias("weight"), g.alias("g")).filter(f"g >= {LEAST_G} and weight >= 1 and d1 * {of.d0} > d0 * {of.d1}")
    weights = {r.stem: float(r.weight) for r in best.collect()}
    lexicon = Lexicon(weights, tuple(exceptions))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in batches:
            x = np.array([lexicon.features(automaton, t) for t in pdf["t"]]).reshape(-1, 3)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": (pdf["y"] != 0).astype(float)})

    seen = own.filter("held").select("t", "y").mapInPandas(lean(features), "a double, b double, c double, y double").collect()
    y = np.array([r.y for r in seen])
    if not 0 < y.sum() < len(y):
        return lexicon
    lexicon.curve = _fit_curve(np.array([[r.a, r.b, r.c] for r in seen]), y)
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with `score` (`score_` if docs has such a column), from the text alone; all columns stay, whatever their names.

    Null and empty texts have no words and get the curve's value there; very long texts are read whole. Repeated
    rows are scored one by one; an empty table has an empty result.
    """

    def start():
        automaton = lexicon.automaton()
        return lambda texts: [lexicon.score(np.array([lexicon.features(automaton, t) for t in texts]).reshape(-1, 3)).tolist()]

    return added(docs, [text], "score double", start)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with score and predicted (1 from a score of 0.5), by a lexicon fitted on the labelled rows; see fit() and scored().

    Both results have underscores behind their names where docs has such a column. Without labels of both kinds
    the score is low for all.
    """
    rows = scored(docs, fit(docs, labels, text=text, **options), text)
    return rows.withColumn(fresh(docs, "predicted"), (F.col(rows.columns[-1]) >= 0.5).cast("int"))


def op6_toxicity(spark, sf_dir):
    """A null doc_id has a null held_out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = judged(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return rows.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")
