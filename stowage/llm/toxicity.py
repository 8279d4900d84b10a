"""Operator 2: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon of insulting words (fixed seeds, and words that the
labels show to be typical of toxic texts), their nearness to second-person words, rates of
capitals, exclamation marks and other punctuation, and of obfuscated spellings. Trees are
fitted by Spark ML on one part of a bounded sample of labelled rows, as is the lexicon; the
isotonic calibration is fitted on the other part, which neither has seen. A score is the calibrated
one, but for a share of SLOPE that follows the trees' margin, so that texts on one step of the
calibration keep their order.

Cases: null and empty texts have all features 0 and get the score of that point; long texts are
read whole; equal texts get equal scores; rows without a label (or with a null id) are scored
but not learnt from; without both classes in the sample every score is the share of toxic labels
(0 without labels); an empty table gives an empty table; further columns of the input are kept
apart in a struct, so that names like ``features`` or ``prediction`` don't clash; of kept columns
``score`` and ``predicted`` are replaced, and ``clean`` returns the input's own.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import cut, forget, map_batches, slices

#: Labelled rows that are learnt from, at most; words of the learnt lexicon, at most.
SAMPLE_ROWS, MAX_WORDS = 12_000, 400
TREES, DEPTH = 20, 3
#: Share of a score that follows the margin.
SLOPE = 0.01
#: Insults and second-person words of the four languages.
SEEDS = "idiot moron clown loser stupid pathetic worthless disgusting trash garbage dumb fool scum ugly idiota estúpido imbécil inútil basura asqueroso crétin débile stupide nul abruti ordure minable dumm trottel depp versager abschaum ekelhaft erbärmlich wertlos".split()
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Digits and marks that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ["words", "lexicon_rate", "lexicon_any", "lexicon_count", "near_rate", "near_any", "second_rate", "capital_words", "capital_letters", "exclaim_rate", "question_rate", "mark_rate", "run_rate", "obfuscated_rate", "obfuscated_lexicon", "seed_count"]
_words = re.compile(r"[^\W\d_]+").findall
_mixed = re.compile(r"[^\W\d_]+[013457@$!|*]+[^\W\d_]+").findall
_dotted = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_* ]){3,}[^\W\d_](?!\w)").findall
NEAR = 4  # words
LETTER, CAPITAL, JOINT, STAND_IN, MARK = 1, 2, 4, 8, 16
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """What each code point below 2 ** 16 is, as a sum of the constants above."""
    if not _kinds:
        chars = [chr(c) for c in range(1 << 16)]
        rows = ((LETTER, str.isalpha), (CAPITAL, str.isupper), (JOINT, ".-_* ".__contains__), (STAND_IN, "013457@$!|*".__contains__), (MARK, ".,;:|*#_-".__contains__))
        _kinds.append(sum(np.array([bool(test(c)) for c in chars], np.uint8) * np.uint8(flag) for flag, test in rows))
    return _kinds[0]


def characters(texts: list[str]) -> np.ndarray:
    """Of each text: capitals, "!", "?", marks, letters that stand three times, letters joined one by one, and stand-ins inside words (the last two as a first look)."""
    codes = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[np.minimum(codes, (1 << 16) - 1)]
    start = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    letter = (kind & LETTER) > 0
    three = np.zeros(len(codes), bool)
    three[2:] = letter[2:] & (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])
    three[3:] &= ~three[2:-1]
    inside = np.zeros(len(codes), bool)
    inside[1:] = ((kind[1:] & STAND_IN) > 0) & letter[:-1]
    joined = np.zeros(len(codes), bool)  # a letter, a joint, a letter, a joint and a letter
    joint = (kind & JOINT) > 0
    joined[4:] = letter[4:] & joint[3:-1] & letter[2:-2] & joint[1:-3] & letter[:-4]
    flags = ((kind & CAPITAL) > 0, codes == ord("!"), codes == ord("?"), (kind & MARK) > 0, three, joined, inside)
    return np.stack([np.add.reduceat(f, start, dtype=np.int64) for f in flags], 1)


def features(text: str, chars: list[int], lexicon: frozenset[str], seeds: frozenset[str]) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    capitals, exclaims, questions, marks, runs, joined, inside = chars
    cased = _words(text)
    words = " ".join(cased).lower().split(" ") if cased else []
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon] if not lexicon.isdisjoint(words) else []
    second = [i for i, w in enumerate(words) if w in SECOND] if hits else []
    n_second = len(second) if hits else sum(map(SECOND.__contains__, words))
    near = sum(1 for i in hits if second and min(abs(i - j) for j in second[max(0, bisect_left(second, i) - 1) : bisect_left(second, i) + 1]) <= NEAR)
    mixed = _mixed(text) if inside else []
    dotted = _dotted(text) if joined else []
    hidden = sum(1 for w in mixed if w.lower().translate(LOOKALIKE).replace("*", "") in lexicon) + sum(1 for w in dotted if re.sub(r"\W|_", "", w).lower() in lexicon)
    length = max(1, len(text))
    return [
        float(np.log1p(len(words))), len(hits) / n, float(bool(hits)), float(min(len(hits), 50)), near / n, float(near > 0), n_second / n,
        sum(1 for w in cased if w.isupper() and len(w) > 1) / n if capitals else 0.0, capitals / length, exclaims / n, questions / n,
        marks / length, runs / n, (len(mixed) + len(dotted)) / n, float(hidden), float(sum(1 for i in hits if words[i] in seeds)),
    ]


class Model:
    def __init__(self, lexicon: list[str], trees, curve, share: float):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share


def with_features(docs: DataFrame, lexicon: list[str], text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns as one struct, and an array of features. The lexicon has MAX_WORDS words and the seeds at most."""

    def step(batch: pa.RecordBatch):
        words, seeds = frozenset(lexicon), frozenset(SEEDS)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices([len(t) for t in texts]):
            rows = [features(t, c, words, seeds) for t, c in zip(texts[a:b], characters(texts[a:b]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(pa.float64()))], names=["_keep", "features"])

    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_keep"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return map_batches(found, step, StructType([found.schema["_keep"], StructField("features", ArrayType(DoubleType()))]))


def learn_lexicon(sample: DataFrame, text_col: str = "text", label_col: str = "toxic") -> list[str]:
    """The seeds, and words in at least 3 % as many toxic texts as there are, mostly toxic ones."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace(text_col, r"[^\p{L}]+", " ")), " "))).alias("word")
    counts = sample.select(word, F.col(label_col).cast("int").alias("y")).where("word != ''").groupBy("word").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    totals = sample.agg(F.sum(F.col(label_col).cast("int")).alias("bad"), F.count("*").alias("n")).first()
    bad, n = totals["bad"] or 0, totals["n"] or 0
    if not bad or bad == n:
        return sorted(SEEDS)
    rate = bad / n
    found = counts.where((F.col("bad") >= max(3, 0.03 * bad)) & (F.col("bad") / F.col("n") >= min(0.9, 2.5 * rate)))
    score = (F.col("bad") / F.col("n")) * F.log1p("bad")
    return sorted({*SEEDS, *(r["word"] for r in found.orderBy(score.desc(), "word").limit(MAX_WORDS).collect())})


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled rows of those that ``learn`` (a condition on the id) allows."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # sample_rows rows of an id and a label at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    sample = cut(texts.join(F.broadcast(rows), "_id").select("_id", "_text", F.col("_toxic").cast("double").alias("label")))
    calibrate = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(4)) == 0
    lexicon = learn_lexicon(sample.where(~calibrate), "_text", "label")
    points = cut(with_features(sample, lexicon, "_text", ["_id", "label"]).select("_keep.*", "features").select("label", array_to_vector("features").alias("features"), calibrate.alias("calibrate")).coalesce(4))
    forget(sample)
    total = points.agg(F.avg("label").alias("share"), *(F.avg(F.when(F.col("calibrate") == k, F.col("label"))).alias(f"s{k}") for k in (True, False))).first()
    if not all(s is not None and 0 < s < 1 for s in (total["sTrue"], total["sFalse"])):
        forget(points)
        return Model(lexicon, None, None, float(total["share"] or 0.0))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=32, seed=1, checkpointInterval=-1).fit(points.where("not calibrate"))
    margin = vector_to_array("rawPrediction")[1]
    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(trees.transform(points.where("calibrate")).select("label", margin.alias("margin")))
    forget(points)
    return Model(lexicon, trees, curve, float(total["share"]))


def _scored(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns as one struct, and the score."""
    if model.trees is None:
        return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_keep"), F.lit(model.share).alias("score"))
    points = with_features(docs, model.lexicon, text_col, keep).withColumn("features", array_to_vector("features"))
    margins = model.trees.transform(points).select("_keep", vector_to_array("rawPrediction")[1].alias("margin"))
    level = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    # Twice the margin is the log odds.
    return model.curve.transform(margins).select("_keep", ((1 - SLOPE) * level + SLOPE / (1 + F.exp(-2 * F.col("margin")))).alias("score"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id, by default), score and predicted of each text."""
    own = [c for c in keep or [id_col] if c not in ("score", "predicted")]
    return _scored(docs, model, text_col, own).select("_keep.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the texts that the model calls toxic; a model that didn't see both classes rejects nothing."""
    if model.trees is None:
        return docs
    return _scored(docs, model, text_col, docs.columns).where("score < 0.5").select("_keep.*")
