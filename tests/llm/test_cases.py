"""Odd cases of every operator and stage: clashing names, nulls, repeated rows, long texts, ties; and brute force where SQL can't say it."""

import itertools
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from stowage.llm import bpe_codec, decontaminate, flac, html_text, jaccard, langid, licenses, oracles, queries, suffixes, token_counts, toxicity  # noqa: E402
from stowage.llm.components import components  # noqa: E402

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau".split()
CLASH = "features prediction score predicted _text _keep label margin rawPrediction probability _id id n gid a b tok kept n_bytes n_removed n_spans kept_text ranges _k1 _k2 lang_pred spans held_out page component_id n_shingles item_id ids n_tokens media feature licenses dice".split()


def clashing(spark, rows):
    """(doc_id, text) with a further column of each name that operators use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("mine").alias(c) for c in CLASH))


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: jaccard.jaccard_components(d, 4, 85),
        lambda d: suffixes.remove_repeats(d, 60),
        lambda d: licenses.scan(d),
        lambda d: token_counts.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
        lambda d: bpe_codec.encode(d, public_tokenizers.path("word_bpe_49k.json"), digests=True),
        lambda d: flac.digests(flac.to_media(d)),
        lambda d: langid.identify(d, langid.fit(d.withColumn("lang", F.lit("en")))),
    ],
    ids=["jaccard", "suffixes", "licenses", "token_counts", "bpe_codec", "flac", "langid"],
)
def test_names_repeated_rows_nulls_and_empty_tables(spark, operator):
    text = " ".join(random.Random(1).choices(WORDS, k=40))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "Released under the MIT License.")]
    got = operator(clashing(spark, rows))
    assert got.count() == len(rows)
    plain = operator(spark.createDataFrame(rows, "doc_id long, text string"))
    own = [c for c in plain.columns if c in got.columns]
    assert got.select(*own).exceptAll(plain.select(*own)).count() == 0
    values = {tuple(r[c] for c in own if c not in ("doc_id", "component_id")) for r in got.where("doc_id in (1, 2)").select(*own).toPandas().astype(str).to_dict("records")}
    assert len(values) == 1  # equal texts, equal values
    assert operator(clashing(spark, [])).count() == 0


def test_components_of_random_links(spark):
    r = random.Random(6)
    for n, m in [(1, 0), (60, 40), (200, 260)]:
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(None, 1)]
        own = list(range(n))
        for _ in range(n):
            for a, b in links[:-1]:
                own[a] = own[b] = min(own[a], own[b])
        linked = {x for a, b in links[:-1] if a != b for x in (a, b)}
        got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: own[x] for x in linked}


def test_toxicity_cases(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(WORDS, k=20)) + (" you idiot" if i % 2 else "")) for i in range(80)] + [(None, "you idiot"), (1, "another text")]
    docs = clashing(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (7, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, keep=docs.columns)
    assert got.count() == len(rows) and set(got.columns) == set(docs.columns)
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where("doc_id is null").first()["predicted"] == 1
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.where("score <> 'mine'").count() == 0 and 30 <= kept.count() <= 50
    alone = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {x["score"] for x in toxicity.score(docs, alone).collect()} == {1.0}
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {x["score"] for x in toxicity.score(docs, nothing).collect()} == {0.0}
    long = toxicity.score(spark.createDataFrame([(1, "idiot " * 200_000 + "end"), (2, "idiot " * 200_000 + "end")], "doc_id long, text string"), model).collect()
    assert long[0]["score"] == long[1]["score"]


def test_toxicity_features_by_brute_force():
    lexicon, seeds = frozenset(["idiot", "trash"]), frozenset(["idiot"])
    text = "YOU are an idiot!! i.d.i.o.t and tr4sh, sooo bad? trash"
    f = dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.characters([text])[0].tolist(), lexicon, seeds), strict=True))
    words = "you are an idiot i d i o t and tr sh sooo bad trash".split()
    assert f["words"] == pytest.approx(np.log1p(len(words)))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    near = sum(any(w in toxicity.SECOND and abs(i - j) <= toxicity.NEAR for j, w in enumerate(words)) for i in hits)
    assert (f["lexicon_count"], f["seed_count"]) == (len(hits), 1) and f["near_rate"] == pytest.approx(near / len(words))
    assert f["exclaim_rate"] == pytest.approx(2 / len(words)) and f["question_rate"] == pytest.approx(1 / len(words))
    assert f["obfuscated_lexicon"] == 2 and f["capital_words"] == pytest.approx(1 / len(words))


def host_texts(pages, long):
    """Text of each page by brute force: main text, and open tokens that no run of ``long`` tokens covers that another stream of the host has."""
    streams, hosts = [], []
    for url, page in pages:
        found = html_text.blocks(page)
        beside = [w for z, t in found if z == html_text.ASIDE for w in t.split()]
        streams.append((len(beside), tuple(beside + [w for z, t in found if z == html_text.OPEN for w in t.split()])))
        hosts.append(url)
    grams = {}
    for h, s in {(h, s) for h, s in zip(hosts, streams, strict=True)}:
        for g in {s[1][i : i + long] for i in range(len(s[1]) - long + 1)}:
            grams.setdefault((h, g), set()).add(s)
    out = []
    for (_, page), h, (skip, s) in zip(pages, hosts, streams, strict=True):
        gone = {i + k for i in range(len(s) - long + 1) if len(grams[h, s[i : i + long]]) > 1 for k in range(long)}
        parts, at = [], skip
        for z, t in html_text.blocks(page):
            if z == html_text.MAIN:
                parts.append(t)
            elif z == html_text.OPEN:
                n = len(t.split())
                parts.append(" ".join(w for k, w in enumerate(t.split(), at) if k not in gone))
                at += n
        out.append(" ".join(p for p in parts if p))
    return out


def test_host_suffix_array_by_brute_force(spark):
    r = random.Random(9)
    phrase = lambda n: " ".join(r.choices(WORDS[:6], k=n))
    shared = [phrase(r.randrange(3, 30)) for _ in range(6)]
    pages = []
    for i in range(60):
        parts = [f"<div>{r.choice(shared) if r.random() < 0.5 else phrase(r.randrange(1, 25))}</div>" for _ in range(r.randrange(1, 6))]
        if i % 4 == 0:
            parts.insert(r.randrange(len(parts) + 1), f"<article>{r.choice(shared)} {phrase(5)}</article>")
        if i % 5 == 0:
            parts.append(f"<nav>{r.choice(shared)}</nav>")
        pages.append((f"h{i % 3}", "".join(parts)))
    pages += pages[:4]
    rows = [(i, f"http://{h}/x", p, "t", 1, 2) for i, (h, p) in enumerate(pages)] + [(900, None, None, "t", 1, 2), (901, None, "", "t", 1, 2), (902, None, "<p>" + "word " * 60_000, "t", 1, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, page int, at int").repartition(7)
    got = {x["page_id"]: x for x in html_text.main_text(df, long=4, depth=6).collect()}
    assert [got[i]["text"] for i in range(len(pages))] == host_texts(pages, 4)
    assert (got[900]["text"], got[901]["text"], got[902]["n_chars"]) == ("", "", 5 * 60_000 - 1)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_mirrors_keep_their_text(spark):
    body = "an article that two addresses of one host carry with the very same words and nothing else"
    rows = [(1, "http://h/a", f"<div>{body}</div>"), (2, "http://h/b", f"<div>{body}</div>"), (3, "http://h/c", "<h1>Top</h1><article>text</article>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: body, 2: body, 3: "Top text"}


def test_shared_lengths_by_brute_force():
    r = np.random.default_rng(2)
    token = r.integers(1, 3, (200, 6)).astype(">u4")
    host, page = r.integers(0, 2, 200), r.integers(0, 3, 200)
    order = sorted(range(200), key=lambda i: (host[i], token[i].tobytes(), page[i]))
    host, token, page = host[order], token[order], page[order]
    length, _ = html_text.shared_lengths(host, token, page, 3)

    def common(i, j):
        return 0 if host[i] != host[j] else next((k for k in range(6) if token[i, k] != token[j, k]), 6)

    want = [max((common(i, j) for j in range(200) if page[i] != page[j]), default=0) for i in range(200)]
    assert length.tolist() == [w if w >= 3 else 0 for w in want]


def test_repeated_templates_are_scanned_in_linear_time():
    known = licenses.Templates(licenses.TEMPLATES, licenses.LEAST)
    took = []
    for n in (300, 1200):
        start = time.process_time()
        found = known.every("Released under the MIT License.\n" * n)
        took.append(time.process_time() - start)
        assert len(found) == n and {f[0] for f in found} == {"mit"}
    assert took[1] < 10 * max(took[0], 0.02)


def test_viterbi_by_every_path():
    r = np.random.default_rng(4)
    for n, k in [(1, 3), (2, 2), (5, 3), (7, 2)]:
        score = np.round(r.normal(size=(2 * n, k)) * 6).astype(np.float32)
        got = langid.viterbi(score, np.array([0, n]), np.array([n, n]), 4.0)
        for t in range(2):
            value = lambda path: sum(score[t * n + i, y] for i, y in enumerate(path)) - 4.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))  # noqa: B023, E731
            best = max(value(p) for p in itertools.product(range(k), repeat=n))
            assert value(got[t * n : (t + 1) * n].tolist()) == pytest.approx(best)


def test_many_languages_and_long_words(spark):
    letters = "abcdefghijklmnopqrst"
    word = lambda i: letters[i % 20] * 3 + letters[i // 20] * 3
    data = [(i, " ".join([word(i)] * 30), f"l{i:03d}") for i in range(200)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    tests = [(i, t) for i, t, _ in data] + [(900, data[150][1].replace(" ", "") * 30), (901, "日本語" * 2000), (902, None)]
    got = {r["doc_id"]: r for r in langid.identify(clashing(spark, tests), model).collect()}
    assert all(got[i]["lang_pred"] == f"l{i:03d}" for i in range(200))
    assert got[900]["lang_pred"] == "l150" and got[901]["lang_pred"] != "und" and got[902]["lang_pred"] == "und"


def test_language_spans_in_text_without_spaces(spark):
    data = [(1, "漢字學習" * 20, "zh"), (2, "ひらがなのことば" * 20, "ja"), (3, "words of english text", "en")]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([(1, "漢字學習" * 40 + "ひらがなのことば" * 60)], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "ja" and [s["lang"] for s in got["spans"]] == ["zh", "ja"]
    words = langid.Words(["漢字" * 3 + "abc" + "d" * 60])
    assert [int(x) for x in words.size] == [4, 2, 24, 24, 15]


def test_language_ties_and_unlabelled(spark):
    same = [(1, "one two", "b"), (2, "one two", "a"), (3, "three", None)]
    rows = spark.createDataFrame(same, "doc_id long, text string, lang string")
    assert langid.identify(rows, langid.fit(rows)).where("doc_id < 3").select("lang_pred").distinct().collect() == [("a",)]
    assert {r["lang_pred"] for r in langid.identify(rows, langid.fit(rows.where("lang is null"))).collect()} == {"und"}


def test_decontamination_of_repeated_rows_and_items(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = clashing(spark, [(1, "x " + item), (1, "x " + item), (None, item), (2, "nothing"), (3, "y " * 50_000 + item)])
    bench = spark.createDataFrame([(5, item), (5, item), (6, item), (None, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.matches(docs.drop("item_id"), bench).collect())
    assert got == [(0, 5), (0, 6), (1, 5), (1, 5), (1, 6), (1, 6), (3, 5), (3, 6)]
    kept = decontaminate.clean(docs, bench)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2] and kept.columns == docs.columns


@pytest.mark.parametrize("name", ["op7_ngram_jaccard", "op10_suffix_dedup"])
def test_twins(spark, small, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = duck.execute(queries.oracle_sql()[name]).df().sort_values("doc_id", ignore_index=True)
    got = queries.queries()[name](spark, small).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got[sorted(got.columns)], want[sorted(want.columns)], check_dtype=False)
    assert "{halves}" not in oracles.repeated_bytes()


def stage_rows(spark, texts):
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "mine", "mine") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string")


def test_stages_on_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some benchmark item of a few words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = stage_rows(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, None), (2, None), (3, ""), (4, "x y"), (4, "another text here")])
    for name, stage in pipeline.STAGES[:-1]:
        for docs in (odd, odd.limit(0)):
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == docs.columns, name
            assert got.count() == (0 if docs is not odd else 6 if name == "ngram_jaccard" else 7), name
    assert pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() == 7


def test_run_against_brute_force(spark, tmp_path):
    """Planted cases: what run() keeps is what each rule, applied one after another in plain Python, keeps."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(12)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))
    bench = [text(30) for _ in range(3)]
    passage = text(60)
    texts = [text(r.randrange(40, 90)) for _ in range(120)]
    texts += [t + " end" for t in texts[:6]] + texts[6:9]  # near and exact copies
    texts += [text(20) + " " + passage + " " + text(20) for _ in range(4)]
    texts += [text(20) + " " + b + " " + text(20) for b in bench]
    toxic = {i for i in range(len(texts)) if i % 5 == 3 and i < 120}
    texts = [f"you worthless idiot {t} you stupid trash" if i in toxic else t for i, t in enumerate(texts)]
    stage_rows(spark, list(enumerate(texts))).drop("score", "predicted").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: t for i, t in enumerate(texts) if i not in toxic}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in kept.items() for w in [t.split()]}
    near = {i for i in kept for j in kept if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    kept = {i: t for i, t in kept.items() if i not in near}
    length = pipeline.PASSAGE_BYTES
    seen: dict[str, int] = {}
    for t in kept.values():
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    gone = {i: {k + x for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1 for x in range(length)} for i, t in kept.items()}
    kept = {i: "".join(c for k, c in enumerate(t) if k not in gone[i]) for i, t in kept.items()}
    assert any(gone.values())
    kept = {i: t for i, t in kept.items() if not any(b in t for b in bench)}
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in kept.items()}
    got = {x["doc_id"]: x["n_tokens"] for x in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_few_pairs_take_one_shuffle_for_sketches_and_one_for_sets(spark, monkeypatch):
    """Pairs that may be broadcast; an id with two texts has the links of both."""
    one, two, other = ("a b c d e f g h", "p q r s t u v w", "k l m n o")
    docs = spark.createDataFrame([(1, one), (1, two), (2, one + " i"), (3, two + " x"), (4, other)], "doc_id long, text string")
    classes = jaccard.signatures(docs, 4, 80, "doc_id", "text").withColumnRenamed("id", "gid").cache()
    pairs = spark.createDataFrame([(1, 2, 11, 12), (1, 3, 11, 13), (2, 3, 12, 13), (1, 4, 11, 14), (1, 2, 11, 12)], "a long, b long, u long, v long")
    shuffles, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or cut(df))
    found = jaccard.verified(docs, pairs, classes, 4, 80, "doc_id", "text")
    assert {(r["u"], r["v"]) for r in found.collect()} == {(11, 12), (11, 13)}
    assert shuffles == [1, 1]


def test_tokens_are_counted_only_as_far_as_prefixes_need_them(spark, monkeypatch):
    """A passage that all texts share makes their first tokens frequent; their own tokens beyond what a prefix needs aren't counted."""
    r = random.Random(8)
    passage = [f"common{i}" for i in range(60)]
    texts = [passage + [f"own{d}x{r.randrange(10**9)}" for _ in range(140)] for d in range(60)]
    texts += [[w if k != d % 200 else "edit" for k, w in enumerate(texts[0])] for d in range(70, 90)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    made, map_batches = [], jaccard.map_batches

    def counting(df, step, schema):
        found = map_batches(df, step, schema)
        if schema == "tok long, df long":
            made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "map_batches", counting)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(docs, 5, 80, hot=8).collect()}
    assert got == {i: 0 if i >= 60 else i for i in range(80)}
    own = 60 * 140
    assert 0 < sum(made) < own / 2
