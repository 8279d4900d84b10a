"""Operator 5: encoding and decoding with a word-end BPE vocabulary, by speculation and verification.

Greedy longest match proposes the tokens of every new word of a batch, all words a symbol
further at a time. A sequence of tokens is what merging gives exactly if merging each
adjacent pair by itself gives that pair back (and a lone token itself), so vectorised
look-ups test all adjacent pairs of the batch; only words with a failing pair are merged
exactly, all of them together as well.

Cases: null and empty texts have no tokens and decode to the empty text; text of any length
is encoded whole; strings of special tokens inside a text become those tokens; repeated rows
give repeated results; an empty table gives an empty table; further columns of the input are
ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_batches, resident, slices

#: Words a Python worker keeps (about 300 bytes each); longer words are never kept.
KEPT_WORDS, KEPT_CHARS = 200_000, 48
#: Separators of str.split that the vocabulary's pattern takes for ordinary characters.
_NOT_WHITE = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + n))
        n += b not in plain
    return out


class Codec:
    """Vocabulary of a tokenizer file with word-end BPE; ``word_ids`` and ``word_text`` keep what words encode to."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.id: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.id.items(), *self.special.items()]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.letters = byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.word_ids: dict[str, str] = {}
        self.word_text: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.known_pairs = np.zeros(0, np.int64)  # sorted
        self.pair_fits = np.zeros(0, bool)
        self.fits_alone: dict[int, bool] = {}
        self.digits = {i: str(i) for i in self.token}
        # Symbols are bytes, the last one of a word 256 higher; -1 stands for a symbol without a token.
        self.symbol_id = np.array([self.id.get(x + e, -1) for e in ("", self.end) for x in self.letters], np.int32)
        of_letter = {x: b for b, x in enumerate(self.letters)}
        self.token_symbols = {i: self._numbers(t, of_letter) for t, i in self.id.items()}
        known = [(self.id[a], self.id[b], k, self.id[a + b]) for (a, b), k in self.ranks.items() if a in self.id and b in self.id and a + b in self.id]
        self.together = len(known) == len(self.ranks) and bool((self.symbol_id >= 0).all()) and max(self.id.values()) < 1 << 20
        self.merges = bpe.Ranks(*np.array(known, np.int64).reshape(-1, 4).T)
        self._plant()

    def _numbers(self, token: str, of_letter: dict[str, int]) -> list[int]:
        ends = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
        out = [of_letter.get(x, -1) for x in (token[: -len(self.end)] if ends else token)]
        if ends:
            out[-1] += 256
        return out

    def _plant(self) -> None:
        """Trie of the tokens' symbols: sorted keys of (node, symbol), the node that each leads to and each node's token or -1."""
        steps: dict[int, int] = {}
        tokens = [-1]
        for i, symbols in self.token_symbols.items():
            node = 0
            if min(symbols, default=-1) < 0:
                continue  # no word has these symbols
            for x in symbols:
                node = steps.setdefault(node << 9 | x, len(tokens))
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = i
        self.step = np.array(sorted(steps), np.int64)
        self.leads = np.array([steps[k] for k in self.step.tolist()], np.int32)
        self.node_token = np.array(tokens, np.int32)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words one after the other, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        out[np.cumsum(size) - 1] += 256
        return out, size

    def exact(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that merging gives, and how many each word has."""
        owner = np.repeat(np.arange(len(size)), size)
        short = size <= (bpe.MOST if self.together else 0)
        out = np.full(len(symbols), -1, np.int32)
        inside = short[owner]
        out[inside] = bpe.merge_many(self.symbol_id[symbols[inside]], size[short], self.merges)
        start = np.cumsum(size) - size
        for k in np.flatnonzero(~short).tolist():
            text = [self.letters[x & 255] + (self.end if x > 255 else "") for x in symbols[start[k] : start[k] + size[k]].tolist()]
            found = [self.id[x] for x in bpe.merge(text, self.ranks.get)[0]]
            out[start[k] : start[k] + len(found)] = found
        there = out >= 0
        return out[there], np.bincount(owner[there], minlength=len(size))

    def proposed(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match."""
        stop = np.cumsum(size)
        place = stop - size  # of the next symbol
        word, node = np.arange(len(size)), np.zeros(len(size), np.int64)
        best, after = np.full(len(size), -1, np.int32), place.copy()
        owners, tokens = [], []
        while len(word):
            key = node << 9 | symbols[np.minimum(place, len(symbols) - 1)]
            at = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            on = (self.step[at] == key) & (place < stop)
            node = np.where(on, self.leads[at], 0)
            place = place + on
            found = self.node_token[node]
            longer = on & (found >= 0)
            best, after = np.where(longer, found, best), np.where(longer, place, after)
            cut = ~on
            owners.append(word[cut])
            tokens.append(best[cut])
            lost = cut & (best < 0)
            place = np.where(cut, after, place)
            best = np.where(cut, -1, best)
            more = ~(cut & (after >= stop)) & ~lost
            word, node, place, stop, best, after = word[more], node[more], place[more], stop[more], best[more], after[more]
        owner, flat = np.concatenate(owners), np.concatenate(tokens)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))

    def _fit(self, sequences: list[tuple[int, ...]]) -> np.ndarray:
        """Whether merging the symbols of each sequence of tokens gives it back."""
        symbols = [[x for t in ts for x in self.token_symbols[t]] for ts in sequences]
        size = np.fromiter(map(len, symbols), np.int64, len(symbols))
        flat, count = self.exact(np.fromiter((x for s in symbols for x in s), np.int64, int(size.sum())), size)
        stop = np.cumsum(count).tolist()
        flat = flat.tolist()
        return np.array([tuple(flat[b - n : b]) == ts for ts, b, n in zip(sequences, stop, count.tolist(), strict=True)], bool)

    def _learn(self, pairs: np.ndarray, width: int) -> None:
        at = np.searchsorted(self.known_pairs, pairs)
        new = pairs[(at >= len(self.known_pairs)) | (self.known_pairs[np.minimum(at, len(self.known_pairs) - 1)] != pairs)] if len(self.known_pairs) else pairs
        if len(new):
            if len(self.known_pairs) > 2_000_000:
                self.known_pairs, self.pair_fits, new = np.zeros(0, np.int64), np.zeros(0, bool), pairs
            fits = self._fit(list(zip((new // width).tolist(), (new % width).tolist(), strict=True)))
            keys = np.concatenate((self.known_pairs, new))
            order = np.argsort(keys, kind="stable")
            self.known_pairs, self.pair_fits = keys[order], np.concatenate((self.pair_fits, fits))[order]

    def learn(self, new: list[str]) -> dict[str, tuple[str, str]]:
        """Encode words, each one pre-token, together."""
        if not new:
            return {}
        symbols, length = self.symbols(new)
        flat, size = self.proposed(symbols, length)
        flat = flat.astype(np.int64)
        width = 1 << 20
        owner = np.repeat(np.arange(len(new)), size)
        fails = np.zeros(len(new), bool)
        fails[owner[flat < 0]] = True
        inside = (owner[1:] == owner[:-1]) & ~fails[owner[1:]]
        keys = (flat[:-1] * width + flat[1:])[inside]
        self._learn(np.unique(keys), width)
        if len(keys):
            fails[owner[:-1][inside][~self.pair_fits[np.searchsorted(self.known_pairs, keys)]]] = True
        lone = (size == 1) & ~fails
        alone = flat[np.cumsum(size)[lone] - 1]
        if unknown := [(t,) for t in set(alone.tolist()) if t not in self.fits_alone]:
            self.fits_alone.update(zip((t for (t,) in unknown), self._fit(unknown).tolist(), strict=True))
        fails[np.flatnonzero(lone)[[not self.fits_alone[t] for t in alone.tolist()]]] = True
        merged, count = self.exact(symbols[np.repeat(fails, length)], length[fails])
        digits, token = self.digits, self.token
        out = {}
        for which, tokens, counts in ((~fails, flat[~fails[owner]], size[~fails]), (fails, merged, count)):
            tokens, stop = tokens.tolist(), np.cumsum(counts).tolist()
            numbers, texts = [digits[t] for t in tokens], [token[t] for t in tokens]
            a = 0
            for k, b in zip(np.flatnonzero(which).tolist(), stop, strict=True):
                out[new[k]] = " ".join(numbers[a:b]), " ".join(texts[a:b])
                a = b
        return out

    def pieces(self, text: str) -> list[str]:
        """Words of a normalised text, between its special tokens."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.find(text) if _NOT_WHITE.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of tokens, their ids and the decoded text."""
        parts: list[list[str]] = []
        for text in texts:
            if "<" in text and any(s in text for s in self.special):
                parts.append([w for k, part in enumerate(self.cut_special(text)) for w in ([part] if k % 2 else self.pieces(part))])
            else:
                parts.append(self.pieces(text))
        if len(self.word_ids) > KEPT_WORDS // 2:
            # The older half goes; words in use move from it to the younger one.
            self.older = self.word_ids, self.word_text
            self.word_ids, self.word_text = {}, {}
        ids, decoded = self.word_ids, self.word_text
        new = set().union(*parts).difference(ids, self.special)
        for w in [w for w in new if w in self.older[0]]:
            ids[w], decoded[w] = self.older[0][w], self.older[1][w]
            new.discard(w)
        long = [w for w in new if len(w) > KEPT_CHARS]
        if new:
            mixed = {w: self.find(w) for w in new if not w.isalpha()}  # letters, digits and marks are apart
            plain = new.difference(mixed)
            found = self.learn(list(plain.union(*mixed.values())))
            for w in plain:
                ids[w], decoded[w] = found[w]
            for w, ps in mixed.items():
                ids[w], decoded[w] = found[ps[0]] if len(ps) == 1 else (" ".join([found[p][0] for p in ps]), " ".join([found[p][1] for p in ps]))
        for w, i in self.special.items():
            ids[w], decoded[w] = str(i), w
        out = []
        for part in parts:
            if len(part) < 2:
                out.append((ids[part[0]].count(" ") + 1, ids[part[0]], decoded[part[0]]) if part else (0, "", ""))
                continue
            every = itemgetter(*part)
            numbers = " ".join(every(ids))
            out.append((numbers.count(" ") + 1, numbers, " ".join(every(decoded))))
        for w in long:
            del ids[w], decoded[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder joins them."""
        return " ".join([self.token[i] for i in ids])


def codec(path: str) -> Codec:
    return resident(__name__, path, lambda: Codec(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Token ids and decoded text of each text.

    Returns id, n_tokens, ids array<int> and decoded string; with ``digests`` the last two
    are ids_sha256 and decoded_sha256 instead (of decimal ids joined by one space, and of the
    UTF-8 text).
    """
    def step(batch: pa.RecordBatch):
        c = codec(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices([len(t) for t in texts], 4 << 20):
            found = c.encode_batch(texts[a:b])
            n = pa.array([x[0] for x in found], pa.int64())
            if digests:
                ids, text = ([hashlib.sha256(x[k].encode()).hexdigest() for x in found] for k in (1, 2))
            else:
                ids, text = pa.array([list(map(int, x[1].split())) for x in found], pa.list_(pa.int32())), [x[2] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, pa.array(ids) if digests else ids, pa.array(text, pa.string())], names=names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = ("string", "string") if digests else ("array<int>", "string")
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), step, f"`{id_col}` long, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")
