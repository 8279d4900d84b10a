"""Operator 9: language identification of spans.

The script of a word's letters narrows the candidate languages; a word's score under each is the
naive Bayes log likelihood of its character n-grams; Viterbi with a switching penalty labels the
words, so that spans of mixed text keep their own language. A text's language is the label with
most letters, its score that label's share of the letters.

A word is a run of letters (with their combining marks) of one script. A longer run than PIECE, or
than UNSPACED in scripts that are written without spaces, is several words, all of them scored.
N-grams are known by 64-bit hashes.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, taken in the order of a
hash of the id, so at any size) and holds the most frequent n-grams, MAX_GRAMS at most and fewer
if there are so many languages that the table would have over MAX_CELLS numbers.

Cases: a null or empty text, or one without a letter, is ``und`` with score 0; long texts are
labelled whole; ties between languages go to the first in alphabetical order; repeated rows give
repeated results; an empty table gives an empty table; without labelled rows every text is
``und``; further columns of the input are ignored, so their names can't clash.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, inverse_powers, map_batches, mix, powers, slices

SAMPLE_ROWS, MAX_GRAMS, MAX_CELLS, LONGEST_GRAM = 6_000, 200_000, 1_600_000, 4
SWITCH = 8.0  # nats that a change of language costs
PIECE, UNSPACED = 24, 4  # code points
UNKNOWN = "und"
#: First code points of script blocks, and the script from there on.
SCRIPTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han")]
NAMES = sorted({name for _, name in SCRIPTS})
WITHOUT_SPACES = ("han", "kana", "thai", "other")
_LAST = 0x32400  # beyond it no letters are looked for
_BORDER = np.uint64(32)
_U = np.uint64
LETTER, MARK = 1, 2
_tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: LETTER, MARK or 0, and its script; and of each script the length of its words."""
    if not _tables:
        kind = np.zeros(_LAST + 1, np.uint8)
        for c in range(_LAST):
            x = chr(c)
            if x.isalpha():
                kind[c] = LETTER
            elif c >= 0x300 and unicodedata.category(x)[0] == "M":
                kind[c] = MARK
        begin = np.array([a for a, _ in SCRIPTS])
        of_block = np.array([NAMES.index(name) for _, name in SCRIPTS], np.uint8)
        script = of_block[np.searchsorted(begin, np.arange(_LAST + 1), "right") - 1]
        longest = np.array([UNSPACED if name in WITHOUT_SPACES else PIECE for name in NAMES], np.int64)
        _tables.append((kind, script, longest))
    return _tables[0]


class Words:
    """Words of some texts: text, start and number of code points, hash and script of each; and of each text whether it has a letter."""

    def __init__(self, texts: list[str | None]):
        kinds, scripts, longest = tables()
        lower = [(t or "").lower() for t in texts]
        self.codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.cumsum([0] + [len(t) + 1 for t in lower[:-1]])
        code = np.minimum(self.codes, _LAST)
        kind, script = kinds[code], scripts[code]
        self.has_letter = np.add.reduceat(kind == LETTER, at) > 0 if len(texts) else np.zeros(0, bool)
        inside = kind > 0
        # A word ends where letters end, and between letters of two scripts; marks go with the letter before.
        edge = np.ones(len(code) + 1, bool)
        edge[1:-1] = (inside[1:] != inside[:-1]) | ((script[1:] != script[:-1]) & (kind[1:] == LETTER) & (kind[:-1] == LETTER))
        edge = np.flatnonzero(edge)
        start, size = edge[:-1], np.diff(edge)
        keep = inside[start] if len(start) else np.zeros(0, bool)
        start, size = start[keep], size[keep]
        most = longest[script[start]]
        pieces = -(-size // most)
        k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size, most = (np.repeat(x, pieces) for x in (start, size, most))
        self.start = start + k * most
        self.size = np.minimum(most, size - k * most)
        self.script = script[self.start]
        self.text = np.searchsorted(at, self.start, "right") - 1
        sums = np.zeros(len(self.codes) + 1, _U)
        np.cumsum(mix(self.codes.astype(_U)) * powers(len(self.codes))[: len(self.codes)], out=sums[1:])
        self.hash = mix((sums[self.start + self.size] - sums[self.start]) * inverse_powers(len(self.codes))[self.start])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct word, and the number among them of every word."""
        _, first, back = np.unique(self.hash, return_index=True, return_inverse=True)
        return first, back

    def grams(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the words in rows, with their borders, and of longer words as such; and each one's place in rows."""
        size = self.size[rows] + 2
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        last = at == size[owner] - 1
        code = np.full(len(owner), _BORDER, _U)
        letter = (at > 0) & ~last
        code[letter] = self.codes[self.start[rows][owner[letter]] + at[letter] - 1]
        code = mix(code)
        left = size[owner] - at  # code points from here to the end
        found, who, h = [], [], code
        for n in range(2, LONGEST_GRAM + 1):
            h = mix(h[:-1] + _U(n)) + code[n - 1 :]
            whole = np.flatnonzero(left[: len(h)] >= n)
            found.append(mix(h[whole]))
            who.append(owner[whole])
        long = np.flatnonzero(size > LONGEST_GRAM)
        found.append(mix(self.hash[rows[long]] + _U(1)))
        who.append(long)
        return np.concatenate(found), np.concatenate(who)


class Model:
    """Languages, sorted hashes of n-grams, their log probabilities under each language, and the languages of each script."""

    def __init__(self, langs: list[str], gram: np.ndarray, logs: np.ndarray, of_script: np.ndarray):
        self.langs, self.gram, self.logs, self.of_script = langs, gram, logs, of_script

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words under each language, 0 for the best one; and the number of every word among them."""
        rows, back = words.distinct()
        total = np.zeros((len(rows), len(self.langs)))
        if len(rows) and len(self.gram):
            h, who = words.grams(rows)
            at = np.minimum(np.searchsorted(self.gram, h), len(self.gram) - 1)
            hit = np.flatnonzero(self.gram[at] == h)
            at, who = at[hit], who[hit]
            weight = np.minimum(words.size[rows], 8) / np.maximum(np.bincount(who, minlength=len(rows)), 1)
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(who, self.logs[at, k], len(rows)) * weight
        allowed = self.of_script[words.script[rows]]
        total = np.where(allowed | ~allowed.any(1, keepdims=True), total, total.min(1, keepdims=True) - 20.0)
        return (total - total.max(1, keepdims=True)).astype(np.float32), back


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows rows with a text and a language, whole texts."""
    known = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_text is not null and _lang is not null")
    ids = known.select("_id", "_lang").orderBy(F.xxhash64("_id"), "_id", "_lang").limit(sample_rows)
    sample = known.join(F.broadcast(ids.select("_id").distinct()), "_id", "left_semi")  # sample_rows ids at most

    def count(batch: pa.RecordBatch):
        langs = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            texts = [t for t, x in zip(batch.column(0).to_pylist(), langs, strict=True) if x == lang]
            for a, b in slices([len(t) for t in texts]):
                words = Words(texts[a:b])
                rows, back = words.distinct()
                h, who = words.grams(rows)
                gram, at = np.unique(h, return_inverse=True)
                n = np.bincount(at, np.bincount(back, minlength=len(rows))[who], len(gram)).astype(np.int64)
                of_script = np.bincount(words.script, minlength=len(NAMES))
                kind = np.repeat([False, True], [len(gram), len(NAMES)])
                keys = np.concatenate((gram.view(np.int64), np.arange(len(NAMES))))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys), pa.array([lang] * len(keys)), pa.array(np.concatenate((n, of_script)))], names=["is_script", "gram", "lang", "n"])

    counts = cut(map_batches(sample.select("_text", "_lang"), count, "is_script boolean, gram long, lang string, n long").groupBy("is_script", "gram", "lang").agg(F.sum("n").alias("n")).where("n > 0"))
    scripts = counts.where("is_script").select("gram", "lang", "n").collect()  # a row for each language and script
    langs = sorted({r["lang"] for r in scripts})
    if not langs:
        forget(counts)
        return Model([], np.zeros(0, _U), np.zeros((0, 0)), np.zeros((len(NAMES), 0), bool))
    share = np.zeros((len(NAMES), len(langs)))
    for r in scripts:
        share[r["gram"], langs.index(r["lang"])] = r["n"]
    share /= np.maximum(share.sum(1, keepdims=True), 1)
    grams = counts.where("not is_script")
    totals = grams.groupBy("gram").agg(F.sum("n").alias("total"))
    # How many n-grams have each count: a row for each count that occurs in the sample.
    most, least = min(MAX_GRAMS, max(1, MAX_CELLS // len(langs))), None
    for r in totals.groupBy("total").count().orderBy(F.desc("total")).collect():
        most -= r["count"]
        if most < 0:
            break
        least = r["total"]
    top = totals.where(F.col("total") >= (least or 1 << 62)).select("gram")
    got = grams.join(top, "gram").select("gram", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int").alias("lang"), "n").toArrow()  # MAX_CELLS rows at most
    forget(counts)
    gram, row = np.unique(got.column("gram").to_numpy().view(_U), return_inverse=True)
    table = np.zeros((len(gram), len(langs)))
    table[row, got.column("lang").to_numpy() - 1] = got.column("n").to_numpy()
    logs = np.log((table + 0.5) / (table.sum(0) + 0.5 * max(1, len(gram))))
    return Model(langs, gram, logs.astype(np.float32), share >= 0.01)


def viterbi(score: np.ndarray, start: np.ndarray, size: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each row of score; text t has rows start[t]:start[t] + size[t]. All texts go in step, longest first."""
    n, k = score.shape
    out = np.zeros(n, np.int32)
    if k < 2 or not n:
        return out
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left").tolist()  # texts with a word at that step
    best = np.zeros((len(order), k), np.float32)
    stay = np.zeros((n, k), bool)
    came = np.zeros(n, np.int32)
    for i, m in enumerate(live):
        b, rows = best[:m], at[:m] + i
        if i:
            other = b.max(1, keepdims=True) - np.float32(switch)
            stay[rows], came[rows] = b >= other, b.argmax(1)
            b = np.maximum(b, other)
        b = b + score[rows]
        best[:m] = b - b.max(1, keepdims=True)
    now = best.argmax(1)
    for i in range(len(live) - 1, -1, -1):
        m = live[i]
        rows = at[:m] + i
        out[rows] = now[:m]
        if i:
            now[:m] = np.where(stay[rows, now[:m]], now[:m], came[rows])
    return out


def label_words(model: Model, texts: list[str | None], switch: float = SWITCH) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, all labels, and start and size of each text in them."""
    words = Words(texts)
    size = np.bincount(words.text, minlength=len(texts))
    start = np.cumsum(size) - size
    scores, back = model.scores(words)
    return words, viterbi(scores[back], start, size, switch), start, size


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """id, lang_pred, score and the spans (lang, words) of each text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.gram, model.logs, model.of_script))  # MAX_CELLS numbers at most
    k = len(model.langs)
    span = pa.struct([("lang", pa.string()), ("words", pa.int64())])

    def step(batch: pa.RecordBatch):
        m = Model(*shared.value)
        texts = batch.column(1).to_pylist()
        # The table of a slice has a number for each word and language.
        for a, b in slices([len(t or "") * max(1, k // 8) for t in texts], 3 << 20):
            if not k:
                pred, score, spans = [UNKNOWN] * (b - a), np.zeros(b - a), [[]] * (b - a)
            else:
                words, label, start, size = label_words(m, texts[a:b], switch)
                weight = np.bincount(words.text * k + label, words.size, (b - a) * k).reshape(b - a, k)
                known = words.has_letter
                pred = [m.langs[t] if ok else UNKNOWN for t, ok in zip(weight.argmax(1), known, strict=True)]
                score = np.where(known, weight.max(1) / np.maximum(weight.sum(1), 1), 0.0)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])
                at = np.flatnonzero(new)
                of = np.bincount(words.text[at], minlength=b - a)
                offsets = np.concatenate(([0], np.cumsum(of))).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(np.array(m.langs, object)[label[at]], pa.string()), pa.array(np.diff(np.append(at, len(label))))], fields=list(span))
                spans = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score), spans if isinstance(spans, pa.Array) else pa.array(spans, pa.list_(span))], names=[id_col, "lang_pred", "score", "spans"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), step, f"`{id_col}` long, lang_pred string, score double, spans array<struct<lang:string,words:bigint>>")
