"""Merging of many words at once and the codec that uses it, against the heap and the library."""

import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from stowage.llm import bpe, bpe_codec, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(4))
def test_merge_many_is_merge(seed):
    """Ranks in any order, also such that a merge makes a pair of a lower rank."""
    r = random.Random(seed)
    token = {x: i for i, x in enumerate("abc")}
    pairs = {}
    while len(pairs) < 60:
        a, b = r.choice(list(token)), r.choice(list(token))
        if len(a + b) < 9 and (a, b) not in pairs:
            pairs[a, b] = 0
            token.setdefault(a + b, len(token))
    ranks = dict(zip(pairs, r.sample(range(200), len(pairs)), strict=True))
    table = bpe.Ranks(*(np.array(x) for x in zip(*((token[a], token[b], k, token[a + b]) for (a, b), k in ranks.items()), strict=True)))
    words = ["".join(r.choice("abc") for _ in range(r.choice((1, 2, 3, 5, 9, 40, 64)))) for _ in range(700)]
    size = np.array([len(w) for w in words])
    out = bpe.merge_many(np.array([token[x] for w in words for x in w]), size, table)
    for w, part in zip(words, np.split(out, np.cumsum(size)[:-1]), strict=True):
        assert [t for t in part.tolist() if t >= 0] == [token[s] for s in bpe.merge(list(w), ranks.get)[0]]


def invented(n, seed=3):
    r = random.Random(seed)
    letters = ["abcdefghijklmnopqrstuvwxyz", "äöüéèñçß", "абвгдеж", "中文字", "0123456789", ".,;-'", "</w>"]
    word = lambda: "".join(r.choice(r.choice(letters[:2] if r.random() < 0.8 else letters)) for _ in range(r.choice((1, 2, 4, 7, 9, 12, 30, 70))))
    return [" ".join(word() for _ in range(r.randrange(40))) for _ in range(n)]


def test_invented_words_as_the_library(monkeypatch):
    tok = tokenizers.Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    texts = invented(150)
    monkeypatch.setattr(bpe_codec, "KEPT_WORDS", 600)  # the caches change over too
    codec = bpe_codec.Codec(PATH)
    got = [x for k in range(0, len(texts), 10) for x in codec.encode_batch(texts[k : k + 10])]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [[int(i) for i in g[1].split()] for g in got] == want
    assert [g[0] for g in got] == list(map(len, want))
    assert [g[2] for g in got] == [tok.decode(i, skip_special_tokens=False) for i in want]


def test_words_are_not_merged_one_by_one(monkeypatch):
    calls = []
    one = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda *a: calls.append(a) or one(*a))
    bpe_codec.Codec(PATH).encode_batch(invented(60))
    assert all(len(symbols) > 64 for symbols, _ in calls)


def test_piece_counts_of_a_batch_as_the_library(monkeypatch):
    """New words are merged together, those of over 64 symbols or with runs of spaces (equal scores) by the heap."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*(t.replace(" x", "   x") + " ꙮ\n 𐍈é▁ " for t in invented(120)), "", "     ", "a" * 300, "ࠀ߿𐍈" * 5]
    calls = []
    one = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda *a: calls.append(a) or one(*a))
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 600)  # the caches change over too
    counter = token_counts.Counter(path)
    got = [n for k in range(0, len(texts), 10) for n in counter.counts(texts[k : k + 10])]
    assert got == [len(model.encode(t)) for t in texts]
    assert calls and all(len(symbols) > 64 or "  " in "".join(symbols) for symbols, _ in calls)
