"""Operator 8: benchmark decontamination by rare seeds and Smith-Waterman alignment.

Words are runs of letters and digits of the lower-cased text. An alignment gets MATCH for each equal
word and loses GAP for each word replaced, left out or put in. A document holds an item if the best
alignment reaches ``least`` of what the item itself would get.

Seeds only save alignments, they never decide. An alignment that reaches ``least`` matches at least
need = least * size of an item's size words, so at least HITS of any size - need + HITS of them. The
seeds of an item are that many of its words, those that stand in the fewest documents times items:
words that an edit made up stand in no document and cost nothing, and a template's words come last.
Longer n-grams can't be asked for: a copy with every third word replaced shares no trigram and aligns
at over 0.5. Each word of the document inside an alignment is matched or costs GAP; so a stretch with
h seeds can hold an alignment only if its length leaves (MATCH + GAP) * (h + need - HITS) -
GAP * length at least, and then only if its words that stand in the item at all weigh enough. What is
left is aligned; the rows are those of aligning every document with every item.

The items are joined by broadcasting their seeds and words, MAX_WORDS words at a time: a larger
benchmark takes several passes over the documents, never a larger broadcast.

Cases: null and empty texts and items match nothing, like items with fewer than n words; texts of
any length are searched whole; repeated documents give repeated rows; an item that stands twice is
reported under its smallest item_id only if the rows agree in both columns, else under each id; an
empty table on either side gives an empty table; further columns are ignored, so their names can't
clash.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, resident, slices, word_hashes, words

GRAM, LEAST = 3, 0.5
MATCH, GAP = 2, 1
#: Seeds that must meet within a span, at most; more make the filter sharper and the seeds more common.
HITS = 4
#: Words of items that one pass broadcasts, at most.
MAX_WORDS = 1_000_000
_U = np.uint64
_ODD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_wide = re.compile(r"[^\w]|_").sub


def normalised(text: str | None) -> bytes:
    """Lower-cased letters and digits, other characters as spaces."""
    if not text:
        return b""
    text = text.lower()
    return text.encode().translate(_ODD) if text.isascii() else _wide(" ", text).encode()


class Words:
    """Hashes of the words of some texts."""

    def __init__(self, texts: list[bytes]):
        joined, _, self.owner, start, end = words(texts)
        self.word = word_hashes(joined, start, end)
        self.per = np.bincount(self.owner, minlength=len(texts))
        self.first = np.cumsum(self.per) - self.per


class Known:
    """Membership of hashes in a small set: a bitmap first, then the sorted set."""

    def __init__(self, found: np.ndarray):
        self.found = np.unique(found)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.found & _U((1 << 22) - 1)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(hashes & _U((1 << 22) - 1)).astype(np.int64)])
        if not len(self.found):
            return maybe[:0]
        x = hashes[maybe]
        return maybe[self.found[np.minimum(np.searchsorted(self.found, x), len(self.found) - 1)] == x]


class Items:
    """Test items of one pass: words and, once their counts are known, seeds."""

    def __init__(self, rows: list[tuple[int, str]], n: int, least: float):
        w = Words([normalised(r[1]) for r in rows])
        every = [(r[0], w.word[a : a + k]) for r, a, k in zip(rows, w.first, w.per, strict=True) if k >= n]
        self.ids, self.word = [i for i, _ in every], [x for _, x in every]
        self.known = [np.unique(x) for x in self.word]
        self.size = np.array([len(x) for x in self.word], np.int64)
        self.need = np.array([max(1, math.ceil(least * k - 1e-9)) for k in self.size], np.int64)
        self.least = np.ceil(least * MATCH * self.size - 1e-9).astype(np.int64)
        self.hits = np.minimum(self.need, HITS)
        self.span = np.array([k + max(0, math.floor(MATCH * k * (1 - least) / GAP + 1e-9)) for k in self.size], np.int64)

    def choose(self, counts: dict[int, int]) -> None:
        """Seeds: word hashes, with the items in which each stands."""
        seeds = [np.zeros(0, _U)]
        word, items = np.unique(np.concatenate([*self.known, np.zeros(0, _U)]), return_counts=True)
        for k, x in enumerate(self.word):
            df = np.array([counts.get(int(h), 0) for h in x.astype(np.int64)], np.int64)
            # Each place of a seed meets every item that has it: a template's words cost most.
            cost = df * items[np.searchsorted(word, x)]
            rare = np.argsort(cost, kind="stable")[: self.size[k] - self.need[k] + self.hits[k]]
            seeds.append(np.unique(x[rare[df[rare] > 0]]))
        seed = np.concatenate(seeds)
        item = np.repeat(np.arange(len(self.word)), [len(x) for x in seeds[1:]])
        order = np.argsort(seed, kind="stable")
        self.seed, self.seed_item = seed[order], item[order]


def align(item: np.ndarray, text: np.ndarray) -> int:
    """Best Smith-Waterman score of two word sequences."""
    best, row = 0, np.zeros(len(text) + 1, np.int64)
    steps = GAP * np.arange(len(text) + 1)
    for w in item:
        now = np.maximum(0, row - GAP)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(text == w, MATCH, -GAP))
        now[0] = 0
        row = np.maximum.accumulate(now + steps) - steps  # words of the text that are left out
        best = max(best, int(row.max()))
    return best


def _stretches(w: Words, items: Items, known: Known) -> tuple[np.ndarray, ...]:
    """Text, item, begin and end of the words around each place where enough of an item's seeds meet, in order."""
    at = known.places(w.word)
    low, high = (np.searchsorted(items.seed, w.word[at], side) for side in ("left", "right"))
    many = high - low
    at = np.repeat(at, many)
    item = items.seed_item[np.repeat(low, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
    pair = w.owner[at] * len(items.ids) + item
    order = np.argsort(pair, kind="stable")
    at, item, pair = at[order], item[order], pair[order]
    # Best of all stretches that end at a hit: the weight to there less the smallest one before, hits[item] hits back.
    new = np.ones(len(at), bool)
    new[1:] = pair[1:] != pair[:-1]
    group = np.cumsum(new)
    weight = (MATCH + GAP) * np.arange(len(at)) - GAP * at - group * ((MATCH + 2 * GAP) * (len(w.word) + len(at)))  # each group lies below the one before
    low = np.minimum.accumulate(weight)
    back = np.arange(len(at)) - items.hits[item] + 1
    i = np.flatnonzero(back >= 0)
    i = i[pair[back[i]] == pair[i]]
    i = i[weight[i] - low[back[i]] + MATCH + (MATCH + GAP) * (items.need - items.hits)[item[i]] >= items.least[item[i]]]
    text, span = w.owner[at[i]], items.span[item[i]]
    return text, item[i], np.maximum(at[i] - span + 1, w.first[text]), np.minimum(at[i] + span, w.first[text] + w.per[text])


def _places(w: Words, items: Items, known: Known) -> list[tuple[int, int, int]]:
    """(text, item, score) of the texts that hold enough of an item's words within a span."""
    text, item, begin, end = _stretches(w, items, known)
    if not len(text):
        return []
    # Stretches of a text and item that overlap are one.
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(text)) - 1
    best: dict[tuple[int, int], int] = {}
    for t, k, a, b in zip(text[start].tolist(), item[start].tolist(), begin[start].tolist(), end[stop].tolist(), strict=True):
        x, own = w.word[a:b], items.known[k]
        weight = np.zeros(len(x) + 1, np.int64)
        np.cumsum(np.where(own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x, MATCH, -GAP), out=weight[1:])
        if (weight - np.minimum.accumulate(weight)).max() >= items.least[k]:
            best[t, k] = max(best.get((t, k), 0), align(items.word[k], x))
    return [(t, k, s) for (t, k), s in best.items() if s]


def _passes(items: DataFrame, id_col: str, text_col: str, max_words: int):
    """The items, in lists of about max_words words at most; read one list at a time."""
    rows, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").distinct().orderBy("id", "text").toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if rows and size + n > max_words:
            yield rows
            rows, size = [], 0
        rows.append((r["id"], r["text"]))
        size += n
    if rows:
        yield rows


def matches(docs: DataFrame, items: DataFrame, n: int = GRAM, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(id, item, score): documents that hold a test item, with the share of the item's own score that the alignment reaches."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = None
    for rows in _passes(items, item_col, item_text, max_words):
        chosen = Items(rows, n, least)
        if not chosen.ids:
            continue
        shared = spark.sparkContext.broadcast(np.unique(np.concatenate(chosen.word)))

        def count(batch: pa.RecordBatch, shared=shared):
            known = resident(__name__, ("words", shared), lambda: Known(shared.value))
            texts = batch.column(0).to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                w = Words([normalised(t) for t in texts[a:b]])
                hit = known.places(w.word)
                owner = w.owner[hit]
                order = np.lexsort((w.word[hit], owner))
                x, o = w.word[hit][order], owner[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1])
                word, k = np.unique(x[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(k)], names=["word", "n"])

        # A row for each distinct word of this pass at most.
        counts = {r["word"]: r["n"] for r in map_batches(texts.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        chosen.choose(counts)
        items_of = spark.sparkContext.broadcast(chosen)

        def search(batch: pa.RecordBatch, items_of=items_of):
            it = items_of.value
            known = resident(__name__, ("seeds", items_of), lambda: Known(it.seed))
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                got = []
                for t, k, s in _places(Words([normalised(x) for x in texts[a:b]]), it, known):
                    share = s / (MATCH * len(it.word[k]))
                    if share >= least:
                        got.append((a + t, it.ids[k], share))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], names=["id", "item", "score"])

        part = map_batches(texts, search, "id long, item long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        found = texts.where("false").select("id", F.lit(0).cast("long").alias("item"), F.lit(0.0).alias("score"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a test item; rows with a null id stay."""
    held = cut(matches(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("_held")).distinct())
    return docs.join(held, docs[id_col] == held["_held"], "left_anti")
