"""Operator 4: token counts by heap-and-linked-list byte-pair merging.

``token_counts`` adds no identifiers: the count of a text is the number of symbols that merging
leaves, where a character outside the vocabulary counts as its UTF-8 bytes. The words of a batch
that a worker hasn't met are merged together, each in its own linked list; long words, and those
that hold pieces of equal scores, go through the heap one by one.

Cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted
whole; repeated rows give repeated results; an empty table gives an empty table; further
columns of the input are ignored, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter as Tally

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_batches, resident, slices

#: Words whose counts a Python worker keeps (about 150 bytes each); longer words are never kept.
KEPT_WORDS, KEPT_CHARS = 300_000, 48
MARK = "▁"  # stands for a space in the vocabulary


class Counter:
    """Number of tokens of words. A word is spaces and what follows them, up to the next space."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = {
            model.id_to_piece(i).replace(MARK, " "): -model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        # No merge crosses a place that no piece spans; if pieces span spaces, texts are merged as one word.
        whole = any(re.search("[^ ] ", p) for p in self.piece)
        lines = any("\n" in p for p in self.piece)
        self.find = re.compile(r"[\s\S]+" if whole else r" *[^ ]+| +" if lines else r" *[^ \n]+|\n| +").findall
        # Words in use move from the older half to the younger one when the older half goes.
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self._number()

    def _number(self) -> None:
        """Numbers of characters and pieces, 0 for characters in no piece, and the ranks of their pairs."""
        symbols = sorted({*"".join(self.piece), *self.piece})
        number = {x: k for k, x in enumerate(symbols, 1)}
        self.of_code = np.zeros(0x110000, np.int32)
        for x in symbols:
            if len(x) == 1:
                self.of_code[ord(x)] = number[x]
        self.cost = np.array([0, *(1 if x in self.piece else len(x.encode()) for x in symbols)])
        # Pieces of one score are merged from left to right, whichever comes first: ranks can't say that.
        shared = Tally(self.piece.values())
        made = sorted((p for p in self.piece if len(p) > 1), key=self.piece.get)
        equal = [p for p in made if shared[self.piece[p]] > 1]
        self.has_equal = re.compile("|".join(map(re.escape, equal)) or "(?!)").search
        pairs = [(number[p[:k]], number[p[k:]], r, number[p]) for r, p in enumerate(made) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.merges = bpe.Ranks(*np.array(pairs, np.int64).reshape(-1, 4).T)
        self.together = len(number) < (1 << 20) - 1

    def rank(self, pair: tuple[str, str]) -> float | None:
        return self.piece.get(pair[0] + pair[1])

    def alone(self, word: str) -> int:
        return sum(1 if s in self.piece else len(s.encode()) for s in bpe.merge(list(word), self.rank)[0])

    def merged(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        heap = np.fromiter((not self.together or n > bpe.MOST or self.has_equal(w) is not None for n, w in zip(size.tolist(), words, strict=True)), bool, len(words))
        n = np.zeros(len(words), np.int64)
        for k in np.flatnonzero(heap).tolist():
            n[k] = self.alone(words[k])
        rest = np.flatnonzero(~heap)
        if len(rest):
            codes = np.frombuffer("".join([words[k] for k in rest.tolist()]).encode("utf-32-le"), np.uint32)
            symbols = self.of_code[codes]
            left = bpe.merge_many(symbols, size[rest], self.merges)
            cost = np.where(left < 0, 0, self.cost[left])
            other = np.flatnonzero(left == 0)
            cost[other] = 1 + (codes[other] > 0x7F) + (codes[other] > 0x7FF).astype(np.int64) + (codes[other] > 0xFFFF)
            n[rest] = np.add.reduceat(cost, np.cumsum(size[rest]) - size[rest])
        return n

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.find(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.young) > KEPT_WORDS // 2:
            self.young, self.old = {}, self.young
        new = set().union(*parts).difference(self.young)
        known = self.young
        for w in new.intersection(self.old):
            known[w] = self.old[w]
            new.discard(w)
        words = list(new)
        known.update(zip(words, self.merged(words).tolist(), strict=True))
        out = [sum(map(known.__getitem__, p)) for p in parts]
        for w in words:
            if len(w) > KEPT_CHARS:
                del known[w]
        return out


def counter(path: str) -> Counter:
    return resident(__name__, path, lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each text under the piece model at ``path``."""

    def step(batch: pa.RecordBatch):
        counts = counter(path).counts
        texts = [t or "" for t in batch.column(1).to_pylist()]
        size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        n = np.fromiter((n for a, b in slices(size.tolist(), 4 << 20) for n in counts(texts[a:b])), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), step, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
