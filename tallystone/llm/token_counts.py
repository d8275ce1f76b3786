"""Token counts of whole texts, huge ones by overlapping chunks that are spliced at stable boundaries.

A boundary between two characters is stable if no piece of the vocabulary holds the two side by side: no
sequence of merges can then join them, so the tokens on its two sides don't depend on each other. For the
sentence-piece model the vocabulary is looked through once to prove that a space after any other character is
such a boundary. A text is cut there into units, and the count of a unit is kept for the next time that it
comes up.

A huge text is encoded in overlapping chunks with the offsets of the tokens. Where two chunks overlap, both
must have a token end at the same offset and that boundary must be stable; they are spliced there. If there is
no such place, the overlap is doubled and the second chunk is encoded anew, up to the whole text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, table

#: Characters of a chunk, and of the overlap of two chunks; longer texts than CHUNK are huge.
CHUNK, OVERLAP = 32_768, 256
LIMIT = 4096
#: Unit counts that a worker keeps.
KEPT_UNITS = 400_000
BLANK = "▁"


class SentencePieces:
    """Counts by a sentence-piece model. Knows by proof over its pieces which boundaries are stable."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        #: characters that stand before a blank inside some piece
        self.before_blank = {p[i] for p in pieces for i in range(len(p) - 1) if p[i + 1] == BLANK}
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.proven = self.before_blank <= {BLANK} and self._plain()
        self.kept: dict[str, int] = {}

    def _plain(self) -> bool:
        """Whether the model's own rules leave texts as they are before encoding, but for a blank before them."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as proto
        except ImportError:  # without protobuf the rules can't be read
            return False
        spec = proto.ModelProto.FromString(self.model.serialized_model_proto()).normalizer_spec
        return spec.name == "identity" and not spec.precompiled_charsmap and not spec.normalization_rule_tsv and not spec.remove_extra_whitespaces and spec.add_dummy_prefix

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count(self, text: str) -> int:
        """Tokens of a text, by units between stable boundaries."""
        if BLANK in text:
            text = text.replace(BLANK, " ")
        if not self.proven or not text:
            return self.whole([text])[0]
        units = re.split(r"(?<=[^ ]) (?=[\s\S])", text) if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")
        kept, n, new = self.kept, 0, []
        for unit in units:
            k = kept.get(unit)
            if k is None:
                new.append(unit)
            else:
                n += k
        if new:
            if len(kept) > KEPT_UNITS:
                kept.clear()
            for unit, k in zip(new, self.whole(new), strict=True):
                kept[unit] = k
                n += k
        return n

    def ends(self, text: str) -> list[int]:
        """Ends of a text's tokens, by characters."""
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80)])  # of each byte offset
        return chars[[p.end for p in self.model.encode(text, return_type="proto").pieces]].tolist()

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece holds the characters on both sides of text[at]."""
        a, b = (BLANK if c == " " else c for c in text[at - 1 : at + 1])
        return a + b not in self.pairs


class JsonTokenizer:
    """Counts by a tokenizer file; special strings are read as the file has it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.proven = False

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        return self.whole([text])[0]


def load(path: str):
    return SentencePieces(path) if path.endswith(".model") else JsonTokenizer(path)


def spliced(coder: SentencePieces, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text by overlapping chunks.

    A chunk starts after a space that follows another character, which the model's own first blank stands
    for, and so has the tokens of that space in it. Its first tokens can still differ from those of the whole
    text, so the splice must lie behind the chunk's start at a stable boundary where both chunks end a token.
    """
    # the splice lies before the end of the first chunk: tokens without width, of a character's bytes, belong behind it
    text = text.replace(BLANK, " ")
    n, start, stop, held = 0, 0, 0, []
    while True:
        width = overlap
        start = _cut(text, stop - width) if stop else 0
        last, stop = stop, max(start + chunk, stop + overlap if start else 2 * stop)
        stop = len(text) if stop >= len(text) - overlap else stop
        while True:
            ends = [start + e for e in coder.ends(text[start:stop])]
            common = [c for c in sorted(set(held) & set(ends)) if start < c < last and coder.stable(text, c)] if start else []
            if common or not start:
                break
            width *= 2
            start = _cut(text, last - width)
        if common:
            splice = common[len(common) // 2]
            n += sum(e > splice for e in ends) - sum(e > splice for e in held)
        else:
            n = len(ends)
        if stop == len(text):
            return n
        held = ends


def _cut(text: str, at: int) -> int:
    """The last place up to `at` behind a single space that follows another character; 0 if there is none."""
    while at > 1:
        at = text.rfind(" ", 0, at)
        if at < 1:
            return 0
        if text[at - 1] != " " and text[at + 1 : at + 2] != " ":
            return at + 1
    return 0


def count_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the library on the whole text, without added special tokens. Null and empty texts
    have 0 bytes and 0 tokens; very long ones are counted whole, by chunks. Other columns, whatever their names,
    are left out; repeated rows are counted one by one; an empty table has an empty result.
    """

    def start():
        coder = load(path)
        count = lambda t: spliced(coder, t, chunk, overlap) if coder.proven and len(t) > chunk else coder.count(t)
        return lambda texts: [[count(t) for t in texts]]

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    return added(rows, ["text"], "n_tokens long", start).drop("text").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir, path: str | None = None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path)
