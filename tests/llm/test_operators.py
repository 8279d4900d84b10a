"""The ten operators against brute force, the libraries they stand in for, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from stowage.llm import bpe_codec, decontaminate, flac, html_text, jaccard, langid, licenses, queries, suffixes, token_counts, toxicity  # noqa: E402
from stowage.llm.components import components  # noqa: E402

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau".split()


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", "x") for i, t in enumerate(texts, start)], "doc_id long, text string, lang string, source string, text_2 string")


ODD = [None, "", " \n\t", "a", "a b c", "<|endoftext|> x", "É é ﬁ \x1c  Ⅷ", "日本 語́", "▁ a  b", "x" * 5000, "it's 'LL don't 123 !!??", "a\x00b", "😀😀 ok"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = []
    for _ in range(60):
        base = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(5, 120))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = [w if r.random() > 0.03 else r.choice(WORDS) for w in base]
            out.append(" ".join(copy[: len(copy) - r.randrange(3)]))
    return [*out, *out[:5], None, "", "  ", "a b", "A B", "a b"]


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "percent", "hot"), [(4, 85, 32), (5, 80, 3), (3, 70, 2)])
def test_jaccard_components(spark, texts, n, percent, hot):
    sets = [shingles(t, n) for t in texts]
    own = list(range(len(sets)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                own[max(a, b)] = min(a, b)
    got = jaccard.jaccard_components(docs_of(spark, texts), n, percent, hot=hot).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = True
        out.append((len(t), int(mark.sum()), int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~mark])))
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 16384])
def test_suffix_dedup(spark, block_rows):
    r = random.Random(5)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randrange(60, 200))) for _ in range(8)]
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(0, 150))) + (p := r.choice(passages))[: r.randrange(30, len(p))] + "".join(r.choice("xyz") for _ in range(r.randrange(60))) for _ in range(80)]
    texts += [*texts[:3], "ab" * 120, "q" * 300, "", None]
    want = removed([(t or "").encode() for t in texts], 60)
    got = suffixes.remove_repeats(docs_of(spark, texts).withColumn("kept", F.lit(1)), 60, block_rows=block_rows).orderBy("doc_id").collect()
    assert [(g["n_bytes"], g["n_removed"], g["n_spans"], bytes(g["kept"])) for g in got] == want


def test_multikey_sort():
    rng = np.random.default_rng(6)
    for n in (1, 2, 50):
        x = rng.integers(0, 3, (n, 4)).astype(np.uint64) * np.uint64(0x0100000001)
        raw = [row.astype(">u8").tobytes() for row in x]
        order, shared = suffixes.multikey_sort(x)
        assert [raw[i] for i in order] == sorted(raw)
        for k in range(1, n):
            a, b = raw[order[k - 1]], raw[order[k]]
            assert shared[k] == next((i for i in range(32) if a[i] != b[i]), 32)


def test_token_counts(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    every = [*texts, *ODD]
    got = token_counts.token_counts(docs_of(spark, every), public_tokenizers.path("piece_bpe_32k.model"), limit=50).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(model.encode(t or "")) for t in every]
    assert [r["over_limit"] for r in got] == [r["n_tokens"] > 50 for r in got]


def test_bpe_codec(spark, texts):
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    every = [*texts, *ODD]
    got = bpe_codec.encode(docs_of(spark, every), public_tokenizers.path("word_bpe_49k.json")).orderBy("doc_id").collect()
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in every]
    assert [r["ids"] for r in got] == want
    assert [r["decoded"] for r in got] == [tok.decode(i, skip_special_tokens=False) for i in want]


def test_flac(spark, texts):
    every = [*texts[:40], *ODD]
    media = flac.to_media(docs_of(spark, every))
    got = flac.digests(media).orderBy("doc_id").collect()
    for r, t in zip(got, every, strict=True):
        data = (t or "").encode()
        data = data.ljust(max(1, -(-len(data) // 192)) * 192)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    blocks = flac.pcm_blocks(media, samples=384).where("doc_id = 0").orderBy("sample_offset").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == bytes(c ^ 128 for c in every[0].encode().ljust(-(-len(every[0]) // 192) * 192))


def test_flac_detects_damage():
    stream = bytearray(flac.encode([flac.payload(b"some text " * 50)])[0])
    stream[-20] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_decontamination(spark):
    r = random.Random(7)
    items = [" ".join(r.choice(WORDS) + str(r.randrange(500)) for _ in range(r.randrange(16, 40))) for _ in range(10)]
    filler = lambda: " ".join(r.choice(WORDS) + str(r.randrange(500)) for _ in range(80))
    edited = lambda t: " ".join(w if k % 7 else "changed" for k, w in enumerate(t.split()))
    texts = [filler() + " " + items[0] + " " + filler(), edited(items[1]).upper() + "! " + filler(), filler(), None, "", items[2].replace(" ", ",  ")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(99, None, 1), (98, "", 1), (97, "two words", 1)], "item_id long, text string, doc_id long")
    for most in (1_000_000, 30):
        got = decontaminate.matches(docs_of(spark, texts), bench, max_words=most).collect()
        assert sorted((g["doc_id"], g["item_id"]) for g in got) == [(0, 0), (1, 1), (5, 2)]
    kept = decontaminate.clean(docs_of(spark, texts), bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == [2, 3, 4]


def test_decontamination_finds_what_every_alignment_finds(spark):
    r = random.Random(11)
    word = lambda n: r.choice(WORDS) + str(r.randrange(n))
    items = [" ".join(word(30) for _ in range(size)) for size in (3, 7, 25, 25, 38, 38, 55)]
    texts = []
    for t in items:
        for every in (2, 3, 4, 5, 6):
            for put in ([f"new{every}"], [], ["put", "in"]):  # replaced, left out, replaced by two
                copy = [x for k, w in enumerate(t.split(), 1) for x in (put if k % every == 0 else [w])]
                texts.append(" ".join([word(30) for _ in range(40)] + copy + [word(30) for _ in range(r.randrange(150))]))
        texts.append(" ".join(w if r.random() < 0.75 else word(30) for w in t.split()))
        texts.append(" put ".join(t.split()))
    number = {w: i for i, w in enumerate(sorted({w for t in [*items, *texts] for w in t.split()}))}
    as_numbers = lambda t: np.array([number[w] for w in t.split()])
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            share = decontaminate.align(as_numbers(item), as_numbers(t)) / (2 * len(item.split()))
            if share >= 0.5:
                want[i, k] = share
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(g["doc_id"], g["item_id"]): g["score"] for g in decontaminate.matches(docs_of(spark, texts), bench).collect()}
    assert got == want
    assert {(17 * k + 3 * j + 0, k) for k in range(2, 7) for j in range(1, 5)} <= set(got)


def test_alignment():
    x = np.array([1, 2, 3, 4, 5])
    assert decontaminate.align(x, np.array([9, 1, 2, 3, 4, 5, 9])) == 10
    assert decontaminate.align(x, np.array([1, 2, 8, 4, 5])) == 7
    assert decontaminate.align(x, np.array([1, 2, 4, 5])) == 7
    assert decontaminate.align(x, np.array([7, 8])) == 0


def test_licenses(spark):
    def brute(text):
        best = None
        lines = (text or "").split("\n")
        grams = lambda t: set(licenses.bigrams(licenses._words(t.lower())))
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                own = grams("\n".join(lines[i:j]))
                for name, template in sorted(licenses.TEMPLATES):
                    t = grams(template)
                    dice = 2 * len(own & t) / (len(own) + len(t))
                    if dice >= licenses.LEAST and (best is None or (-dice, i, name) < (-best[1], best[2], best[0])):
                        best = (name, dice, i, j - i)
        return best

    texts = ["Some words.\nReleased under the MIT License.", "This work is licensed under the GNU\nGeneral Public License, version 3.\nmore words here", "Licensed under the apache license version 2.0", "a\n" * 20 + "All rights reserved", "the license of this work", None, "", "Released under the BSD License."]
    got = licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [None if r["license"] is None else (r["license"], r["dice"], r["first_line"], r["n_lines"]) for r in got] == [brute(t) for t in texts]


def test_licenses_inside_lines_and_by_version(spark):
    gpl = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    bsd = licenses._BSD + licenses._BSD_1_2
    cases = {
        "x\nLicensed under CC BY-NC 4.0.": ["cc-by-nc-4.0"],
        "Licensed under CC BY 4.0. y": ["cc-by-4.0"],
        "Copyright 2024 Foo Inc. All rights reserved.": ["reserved"],
        "some words " + licenses._MIT + " more words": ["mit"],
        "a b " + bsd + licenses._BSD_END: ["bsd-2-clause"],
        "Copyright X. All rights reserved. " + bsd + licenses._BSD_3 + licenses._BSD_END: ["reserved", "bsd-3-clause"],
        "This program is free software; " + gpl.format("", 2): ["gpl-2.0"],
        "This program is free software: " + gpl.format("", 3): ["gpl-3.0"],
        "This program is free software: " + gpl.format("Affero ", 3): ["agpl-3.0"],
        "This library is free software; " + gpl.format("Lesser ", "2.1"): ["lgpl-2.1"],
        "This work is licensed under the GNU General Public License.": ["gpl"],
        "Released under the MIT License. Then text. Licensed under the Apache License, Version 2.0.": ["mit", "apache-2.0"],
        "Released under the MIT licence, as some spell it": ["mit"],
        "the license of this work": [],
    }
    got = licenses.scan(docs_of(spark, list(cases))).orderBy("doc_id").collect()
    assert [[x["license"] for x in r["licenses"] or []] for r in got] == list(cases.values())
    assert got[5]["license"] == "bsd-3-clause"


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Menu</a></nav><div class="ad">Buy <b>now</b></div><article><header><h1>Head &amp; s</h1></header><div><p>One<br>two <i>th</i>ree<p>four\n five</div><div class="comments"><p>first!</div><p>six</article><footer>&copy; f</footer>'


@pytest.mark.parametrize(("page", "text"), [(PAGE, "Head & s One two three four five six"), (None, ""), ("", ""), ("<p>a<p>", "a"), ("<article>x <script>var a = '</p>';</script>y", "x y"), ("<main>a < b &lt;c&gt;<!-- no --></main>", "a < b <c>"), ('<div role="main"><article><div>a</div> b</article> c</div>', "a b c")])
def test_page_text(spark, page, text):
    df = spark.createDataFrame([(1, "http://h/x", page, "z")], "page_id long, url string, html string, text string")
    got = html_text.main_text(df).first()
    assert (got["text"], got["n_chars"]) == (text, len(text))


LONG_TEXT = "an article of some length"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html class='social'><body class='home right-sidebar'><article>a b</article><div class='sidebar'>no</div></body></html>", "a b"),
        ("<body id='widget'><p>open</p></body>", "open"),
        ("<article class='post comments-open'>a</article>", "a"),
        ("<main id='related'>a<div class='related'>no</div></main>", "a"),
        ("<div class='has sidebar'><main>a</main>no</div>", "a"),
        ("<div class='has-sidebar'><div role='main'>a</div></div>", "a"),
        (f"<main><h1>Top</h1><div class='right-sidebar'><article>{LONG_TEXT}<div class='comments'><article>no</article></div></article></div></main>", "Top " + LONG_TEXT),
        (f"<article>{LONG_TEXT}</article><div class='comments'><article>first!</article><article>second</article></div>", LONG_TEXT),
        (f"<div>{LONG_TEXT}</div><div class='related'><article>teaser</article></div>", LONG_TEXT),
        ("<aside><article>no</article></aside>", ""),
    ],
)
def test_class_words_dont_hide_articles(spark, page, text):
    df = spark.createDataFrame([(1, "http://h/x", page)], "page_id long, url string, html string")
    assert html_text.main_text(df).first()["text"] == text


def test_host_boilerplate(spark):
    menu = "home news sport weather travel food music film"
    rows = [(i, f"http://h{i // 3}.com/{i}", f"<body><div>{menu}</div><div>body text number {i} is only here {'w%d ' % i * 5}</div></body>") for i in range(6)]
    rows.append((6, "http://alone.com", f"<body><div>{menu}</div><div>kept</div></body>"))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(menu not in got[i] and f"{i} is only here" in got[i] for i in range(6))
    assert got[6] == menu + " kept"


def test_language(spark):
    data = {"en": "the cat and the dog with that", "fr": "le chat et la souris avec des", "ru": "кошка и собака вместе"}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for _ in range(5) for lang, t in data.items())]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = ["the dog", "la souris et le chat", "собака", "", None, "123", "the cat and the dog with that " * 3 + "le chat et la souris avec des " * 5]
    got = langid.identify(docs_of(spark, tests), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en", "fr", "ru", "und", "und", "und", "fr"]
    assert [s["lang"] for s in got[-1]["spans"]] == ["en", "fr"]
    assert 0.5 < got[-1]["score"] < 0.8


def test_toxicity(spark):
    r = random.Random(8)
    bad = ["you stupid idiot", "what a PATHETIC loser you are!!", "you are worthless trash"]
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(30)) + (" " + r.choice(bad) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    assert sum(got[a]["predicted"] == c for a, _, c in rows if a % 5 == 0) >= 115
    odd = toxicity.score(docs_of(spark, [None, "", "you idiot"]), model).orderBy("doc_id").collect()
    assert odd[0]["score"] == odd[1]["score"] and all(0 <= x["score"] <= 1 for x in odd)


def test_empty_tables(spark):
    empty = docs_of(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    assert suffixes.remove_repeats(empty, 60).count() == 0
    assert decontaminate.matches(empty, bench).count() == 0
    assert licenses.scan(empty).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert flac.digests(flac.to_media(empty)).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = jaccard.jaccard_components(df, 4, 85).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in got if r["doc_id"]) == [(False, 1, 1), (False, 1, 1), (False, 2, 1)]


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, small).cache()
        assert docs.columns == before.columns, name
        assert 0 < docs.count() <= before.count()
        before = docs
    assert len(corpus_pipeline.STAGES) == 5
    assert set(queries.queries()) == {f.__name__ for f in (queries.op1_html_text, queries.op2_toxicity, queries.op3_licenses, queries.op4_token_counts, queries.op5_bpe_codec, queries.op6_media_flac, queries.op7_ngram_jaccard, queries.op8_decontamination, queries.op9_language_id, queries.op10_suffix_dedup)}
