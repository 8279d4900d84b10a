"""Operator 7: n-gram Jaccard join, as a grouped prefix join.

Documents with equal shingle sets are one class. The shingles of a set are put in one global
order, and two sets whose Jaccard index reaches the threshold share a shingle among the first
p = n - ceil(threshold * n) + 1 of each. The order is that of the hashes, with shingles that
very many prefixes hold put last, the rarest of them first, so that no bucket of the join is
large for a common passage.

1. ``signatures``: size, 128-bit key, first shingles and a sketch of each document's set.
2. Classes that also have the same prefix and size form a group, which joins as one.
3. A group's first member is compared with its other members. Groups that share a prefix shingle
   are candidates by their first members: each proposes at most PROPOSE of the groups that have its
   tokens foremost, those that it meets most often. Verified links are joined into components.
4. The groups expand: ROUNDS rounds let each member propose as many centres of its buckets that
   are outside its component; members whose buckets hold one component only are done. What is
   still apart in a bucket then meets in pairs, within bands of sizes. Pairs inside a component can't change the result
   and are never made, nor members of one group times members of another.
   A pair must also have room for its overlap from the token on by which it meets.
5. A sketch bounds the overlap of a candidate pair from above and drops most; the rest are verified
   on whole sets. Sketches and sets are shuffled once, by pair; pairs carry the components that they join.

Cases: null and empty texts, and texts of white space, have no shingles and link with nothing;
texts of fewer words than n are one shingle; long texts are read whole; rows that repeat a
doc_id are one node of the links; a null doc_id is never linked (its component is null); an
empty table gives an empty table; further columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, bounded, cut, encoded, forget, gram_hashes, map_batches, mix, slices, word_hashes, words
from .components import components, relabelled

#: A shingle in so many prefixes is put last in the order.
HOT = 32
#: Rounds in which the rows of a bucket meet a centre, before all pairs that are still apart; centres of similar buckets; proposals of a row in a round.
ROUNDS, CENTRES, PROPOSE = 3, 4, 2
#: Bytes of text that one step makes shingles of.
STEP_BYTES = 1 << 20
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their number per text."""
    joined, _, owner, start, end = words([t.lower() for t in texts])  # bytes.lower() lowers A-Z only
    h = word_hashes(joined, start, end)
    per = np.bincount(owner, minlength=len(texts))
    grams = gram_hashes(h, n)
    if len(grams):
        whole = owner[: len(grams)] == owner[n - 1 :]
        grams, who = grams[whole], owner[: len(whole)][whole]
    else:
        who = np.zeros(0, np.int64)
    first = np.cumsum(per) - per
    for size in range(1, n):  # texts with fewer words: the whole sequence
        if len(short := np.flatnonzero(per == size)):
            x = h[first[short]]
            for k in range(1, size):
                x = mix(x) + h[first[short] + k] * np.uint64(2 * k + 1)
            grams, who = np.concatenate((grams, mix(x + np.uint64(int(_SALT) * size % (1 << 64))))), np.concatenate((who, short))
    order = np.argsort(grams)
    who = who[order].astype(np.int16 if len(texts) < 1 << 15 else np.int64)
    order = order[np.argsort(who, kind="stable")]
    grams = grams[order]
    who = np.sort(who, kind="stable")
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])
        grams, who = grams[new], who[new]
    return grams, np.bincount(who, minlength=len(texts))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-(percent * n) // 100) + 1, 0)


def kept_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first shingles are kept: its prefix and some beyond."""
    p = prefix_size(n, percent)
    return np.minimum(n, p + p // 4 + 4)


def least_overlap(a, b, percent: int):
    """Smallest intersection of sets of these sizes that reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def tokens(grams: np.ndarray) -> np.ndarray:
    """The hashes as signed numbers of the same order."""
    return (grams ^ np.uint64(1 << 63)).view(np.int64)


def sketch(grams: np.ndarray) -> bytes:
    """How many shingles fall into each of about n / 4 buckets; empty if a count needs over a byte."""
    m = 1 << max(3, (len(grams) // 4).bit_length())
    counts = np.bincount((grams & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return b"" if counts.max(initial=0) > 255 else counts.astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int | None:
    """At most so many shingles are in both sets."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, np.uint8).astype(np.uint16), np.frombuffer(b, np.uint8).astype(np.uint16)
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def signatures(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), k1 and k2 (128-bit key of the set), p (prefix size), pre (first tokens, some beyond the prefix), sk."""

    def step(batch: pa.RecordBatch):
        texts = encoded(batch.column(1))
        for a, b in slices([len(t) for t in texts], STEP_BYTES):
            grams, per = shingle_sets(texts[a:b], n)
            stop = np.cumsum(per)
            start = stop - per
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(s))))) for s in (1, 0x9E3779B97F4A7C15)]
            k1, k2 = ((s[stop] - s[start]).astype(np.int64) for s in sums)
            p = prefix_size(per, percent)
            kept = kept_size(per, percent)
            place = np.arange(len(grams)) - np.repeat(start, per)
            pre = tokens(grams[place < np.repeat(kept, per)])
            at = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
            sk = [sketch(grams[i:j]) for i, j in zip(start, stop, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(per, pa.int64()), pa.array(k1), pa.array(k2), pa.array(p, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(pre)), pa.array(sk, pa.binary())], names=["id", "n", "k1", "k2", "p", "pre", "sk"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), step, "id long, n long, k1 long, k2 long, p long, pre array<long>, sk binary")


def _sets(docs: DataFrame, ids: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, grams): whole sets of the documents in ids, as 8-byte hashes in order; docs has each row once."""
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(bounded(ids), "id", "left_semi")

    def step(batch: pa.RecordBatch):
        texts = encoded(batch.column(1))
        for a, b in slices([len(t) for t in texts], STEP_BYTES):
            grams, per = shingle_sets(texts[a:b], n)
            stop = np.cumsum(per)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([grams[i:j].tobytes() for i, j in zip(stop - per, stop, strict=True)], pa.binary())], names=["id", "grams"])

    return map_batches(found, step, "id long, grams binary")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(u, v) of those pairs (a, b, u, v) whose documents a < b reach the threshold. Pairs may repeat; they are cut, and docs has each row once.

    Few pairs are broadcast to sketches and sets, so that only what pairs need is shuffled, and that once, by pair.
    """
    pair = ["a", "b", "u", "v"]

    def sides(pairs: DataFrame) -> DataFrame:
        """(id, other, u, v): each pair from both of its ends."""
        one = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("end"), "u", "v")
        return bounded(one.select("end.*", "u", "v"), MAX_BROADCAST // 2)

    def met(values: DataFrame, ends: DataFrame, value: Column) -> DataFrame:
        """A row for each pair, with the values that its ends have. (An id with several texts has several.)"""
        low = F.col("id") < F.col("other")
        found = values.join(ends, "id").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "u", "v", low.alias("low"), value.alias("value"))
        return found.groupBy(*pair).agg(F.collect_set(F.when(F.col("low"), F.col("value"))).alias("of_a"), F.collect_set(F.when(~F.col("low"), F.col("value"))).alias("of_b"))

    def holds(test: Callable) -> Callable:
        def step(batch: pa.RecordBatch):
            keep = [any(test(x, y) for x in xs for y in ys) for xs, ys in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], names=pair)

        step.__module__ = __name__
        return step

    def bound(x: dict, y: dict) -> bool:
        return (most := overlap_bound(x["sk"], y["sk"])) is None or most >= least_overlap(x["n"], y["n"], percent)

    def exact(s: bytes, t: bytes) -> bool:
        x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    schema = ", ".join(f"{c} long" for c in pair)
    sketches = met(classes.select(F.col("gid").alias("id"), F.struct("n", "sk").alias("value")), sides(pairs), F.col("value"))
    close = cut(map_batches(sketches, holds(bound), schema))
    ends = sides(close)
    sets = met(_sets(docs, ends.select("id"), n, id_col, text_col), ends, F.col("grams"))
    found = cut(map_batches(sets, holds(exact), schema).select("u", "v"))
    forget(close)
    return found


def _windows(wholes: list[bytes], percent: int, a: int, b: int | None = None) -> list[np.ndarray]:
    """Of each whole set the tokens from a to b times the number that its signature keeps, or from there to the end."""
    size = kept_size(np.array([len(w) // 8 for w in wholes]), percent)
    return [tokens(np.frombuffer(w, np.uint64)[a * k : None if b is None else b * k]) for w, k in zip(wholes, size, strict=True)]


def _window_counts(sets: DataFrame, percent: int, a: int, b: int) -> DataFrame:
    """(tok, df): how many of these sets (gid, grams) hold each token in that window of theirs."""

    def count(batch: pa.RecordBatch):
        toks, df = np.unique(np.concatenate(_windows(batch.column(0).to_pylist(), percent, a, b)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(toks), pa.array(df.astype(np.int64))], names=["tok", "df"])

    return map_batches(sets.select("grams"), count, "tok long, df long").groupBy("tok").agg(F.sum("df").alias("df"))


def _window_rows(sets: DataFrame, percent: int, a: int, b: int | None = None) -> DataFrame:
    """(gid, tok): a row for each token of such a window."""

    def spread(batch: pa.RecordBatch):
        each = _windows(batch.column(1).to_pylist(), percent, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in each])), pa.array(np.concatenate(each))], names=["gid", "tok"])

    return map_batches(sets.select("gid", "grams"), spread, "gid long, tok long")


def _lacking(sets: DataFrame, hot_rows: DataFrame, percent: int, b: int) -> DataFrame:
    """Those of the sets (gid, grams) that go on behind this window and hold too few cold tokens for their prefix up to there."""

    def step(batch: pa.RecordBatch):
        keep = []
        for whole, x, h in zip(batch.column(1).to_pylist(), _windows(batch.column(1).to_pylist(), percent, 0, b), batch.column(2), strict=True):
            cold = len(x) - int(np.isin(x, h.values.to_numpy()).sum()) if h.is_valid else len(x)
            keep.append(len(x) < len(whole) // 8 and cold < int(prefix_size(np.array(len(whole) // 8), percent)))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["gid", "grams"])

    lists = _hot_lists(_window_rows(sets, percent, 0, b), hot_rows)
    return map_batches(sets.join(lists, "gid", "left").select("gid", "grams", "hot_tok"), step, "gid long, grams binary")


def _hot_lists(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(gid, hot): the hot tokens among the rows (gid, tok) of each gid, with their counts."""
    found = rows.join(bounded(hot), "tok").groupBy("gid").agg(F.collect_list(F.struct("tok", "df")).alias("hot"))
    return found.select("gid", F.col("hot.tok").alias("hot_tok"), F.col("hot.df").alias("hot_df"))


def _by_order(whole: np.ndarray, hot_tok: np.ndarray, hot_df: np.ndarray) -> np.ndarray:
    """Tokens of a set in the global order: others by themselves, then hot ones by their counts."""
    last = hot_tok[np.lexsort((hot_tok, hot_df))]
    return np.concatenate((whole[~np.isin(whole, hot_tok)], last))


def prefixes(docs: DataFrame, classes: DataFrame, n: int, percent: int, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """(gid, n, pk, toks): the prefix of each class under the order with hot tokens last, rarer ones first, as places and tokens, without tokens that no two prefixes share."""
    pre_rows = classes.select("gid", F.explode("pre").alias("tok"))
    counts = cut(pre_rows.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"))

    def chosen_by(hot_rows: DataFrame) -> DataFrame:
        """The first p cold tokens of each class, or none and short = true where the kept ones don't reach."""

        def choose(batch: pa.RecordBatch):
            toks, short = [], []
            for p, pre, h in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                x = pre.values.to_numpy()
                if h.is_valid:
                    x = x[~np.isin(x, h.values.to_numpy())]
                short.append(h.is_valid and len(x) < p)
                toks.append(x[: 0 if short[-1] else p])
            at = np.concatenate(([0], np.cumsum([len(x) for x in toks]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(toks))), pa.array(short)], names=["gid", "n", "toks", "short"])

        lists = _hot_lists(pre_rows, hot_rows).drop("hot_df")
        return map_batches(classes.select("gid", "n", "p", "pre").join(lists, "gid", "left").select("gid", "n", "p", "pre", "hot_tok"), choose, "gid long, n long, toks array<long>, short boolean")

    hot_rows = cut(counts.where(F.col("df") >= hot))
    chosen = cut(chosen_by(hot_rows))
    found = counts.select("tok")
    if chosen.where("short").limit(1).count():

        def short_sets() -> DataFrame:
            return cut(_sets(docs, chosen.where("short").select(F.col("gid").alias("id")), n, id_col, text_col).withColumnRenamed("id", "gid"))

        # Past the tokens counted so far, a short document's next ones can be as frequent: count as many again, until it has enough rare ones or ends.
        sets, seen = short_sets(), 1
        while sets.limit(1).count():
            again = cut(hot_rows.union(_window_counts(sets, percent, seen, 2 * seen).where(F.col("df") >= hot)).groupBy("tok").agg(F.max("df").alias("df")))
            seen *= 2
            left = cut(_lacking(sets, again, percent, seen))
            forget(hot_rows, sets)
            hot_rows, sets = again, left
        forget(chosen, sets)
        chosen = cut(chosen_by(hot_rows))
        sets = short_sets()

        def extend(batch: pa.RecordBatch):
            toks, size = [], []
            for g, h, df in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                t = tokens(np.frombuffer(g, np.uint64))
                if h.is_valid:
                    t = _by_order(t, h.values.to_numpy(), df.values.to_numpy())
                toks.append(t[: int(prefix_size(np.array(len(t)), percent))])
                size.append(len(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(toks, pa.list_(pa.int64()))], names=["gid", "n", "toks"])

        lists = _hot_lists(_window_rows(sets, percent, 0), hot_rows)
        longer = cut(map_batches(sets.join(lists, "gid", "left").select("gid", "grams", "hot_tok", "hot_df"), extend, "gid long, n long, toks array<long>"))
        # Tokens that only longer prefixes reach have not been counted above.
        found = cut(found.union(longer.select(F.explode("toks").alias("tok"))).distinct())
        whole = chosen.where("not short").drop("short").unionByName(longer)
        used = [sets, longer, found, chosen]
    else:
        whole, used = chosen.drop("short"), [chosen]
    # Two columns at most go through the shuffle of all prefix tokens; a token in one prefix only joins nothing.
    rows = whole.select("gid", F.posexplode("toks").alias("at", "tok")).join(found, "tok", "left_semi")
    shared_toks = rows.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("at", "tok"))).alias("toks"))
    out = cut(whole.select("gid", "n", F.xxhash64("toks").alias("pk")).join(shared_toks, "gid"))
    forget(counts, hot_rows, *used)
    return out


def linked(docs: DataFrame, classes: DataFrame, n: int, percent: int, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """(grp, gid, n, comp) of the classes with a prefix token that others share, as a cut frame; comp is the smallest gid that links of the threshold reach."""
    pre = prefixes(docs, classes, n, percent, id_col, text_col, hot)
    groups = pre.groupBy("n", "pk").agg(F.min(F.struct("gid", "toks")).alias("g")).select("n", "pk", F.col("g.gid").alias("grp"), F.col("g.toks").alias("toks"))
    comp = cut(pre.join(groups.select("n", "pk", "grp"), ["n", "pk"]).select("grp", "gid", "n", F.col("gid").alias("comp")))
    # A group's own token joins its members; a prefix token joins groups.
    rows = cut(groups.select("grp", "n", F.explode("toks").alias("t")).select("grp", "n", "t.tok", "t.at"))
    forget(pre)

    def fits(n1: str, at1: str, n2: str, at2: str) -> Column:
        """Sizes within the threshold; and from this token on, as if it were the first in common, enough shingles in both."""
        sizes = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
        return sizes & (F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2)) * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent)

    def proposals(met: DataFrame) -> DataFrame:
        """Of the pairs (gid, other, u, v) at most PROPOSE for each gid: those that meet in most buckets. At most one pair for each prefix token of a gid."""
        counted = met.repartition("gid").groupBy("gid", "other", "u", "v").agg(F.count("*").alias("k"))
        most = counted.groupBy("gid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "other", "u", "v"))), 1, PROPOSE).alias("best"))
        return most.select("gid", F.explode("best").alias("x")).select(*pair("gid", "x.other", "x.u", "x.v"))

    def pair(a: str, b: str, u: str, v: str) -> list[Column]:
        return [f(x, y).alias(c) for x, y, names in ((a, b, "ab"), (u, v, "uv")) for f, c in zip((F.least, F.greatest), names, strict=True)]

    # What stands first has fewest tokens of its own: of edited copies it is the one most like all others.
    least = rows.groupBy("tok").agg(F.min(F.struct("at", "n", "grp")).alias("m"), F.count("*").alias("size")).where("size > 1")
    star = rows.join(least, "tok").where((F.col("m.grp") != F.col("grp")) & fits("m.n", "m.at", "n", "at")).select(F.col("grp").alias("gid"), F.col("m.grp").alias("other"), F.col("grp").alias("u"), F.col("m.grp").alias("v"))
    inner = comp.where("grp <> gid").select(*pair("grp", "gid", "grp", "gid"))
    near = cut(proposals(star).union(inner))

    def joined(*tables: DataFrame) -> list[DataFrame]:
        """The tables with the components that the pairs in ``near`` join made one, cut anew."""
        found = verified(docs, near, classes, n, percent, id_col, text_col)
        of = components(found, "u", "v")
        out = [cut(relabelled(t, of)) for t in tables]
        forget(near, found, of, *(t for t in tables if hasattr(t, "cut_path")))
        return out

    (comp,) = joined(comp)
    # What is in a component already needs no pair. Each round pairs the rows of a bucket of several components with another centre of it.
    at = cut(rows.drop("n").join(comp, "grp").select("tok", "at", "gid", "n", "comp"))
    for k in range(ROUNDS + 1):
        order = F.struct(F.floor(F.col("at") / 4), F.xxhash64("gid", F.pmod("tok", F.lit(CENTRES)), F.lit(k)))
        mixed = cut(at.groupBy("tok").agg(F.min(F.struct(order.alias("o"), "gid", "n", "comp", "at")).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok", "m"))
        left = cut(at.join(bounded(mixed.select("tok")), "tok", "left_semi"))
        forget(at)
        at = left
        if k == ROUNDS:
            forget(mixed)
            break
        apart = at.join(bounded(mixed, MAX_BROADCAST // 4), "tok").where((F.col("comp") != F.col("m.comp")) & fits("n", "at", "m.n", "m.at"))
        near = cut(proposals(apart.select("gid", F.col("m.gid").alias("other"), F.col("comp").alias("u"), F.col("m.comp").alias("v"))))
        forget(mixed)
        if not near.limit(1).count():
            forget(near)
            break
        comp, at = joined(comp, at)
    # Sizes of a link are of one band or of neighbouring ones, so that a bucket of many sizes falls into smaller ones.
    width = max(1e-6, math.log(100 / percent)) * (1 + 1e-6)
    band = F.floor(F.log("n") / width)
    one, two = (at.select("tok", b.alias("band"), *(F.col(c).alias(f"{c}{k}") for c in ("gid", "n", "comp", "at"))) for k, b in ((1, band), (2, F.explode(F.array(band, band - 1)))))
    rest = one.join(two, ["tok", "band"]).where((F.col("comp1") != F.col("comp2")) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("gid1") < F.col("gid2")))) & fits("n1", "at1", "n2", "at2"))
    near = cut(rest.select(*pair("gid1", "gid2", "comp1", "comp2")).distinct())
    (comp,) = joined(comp)
    forget(at, rows)
    return comp


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_shingles and component_id of each row: documents link when 100 * intersection >= percent * union of their n-word shingle sets."""
    every = cut(signatures(docs, n, percent, id_col, text_col))
    sets = every.where("n > 0 and id is not null")
    key = ["n", "k1", "k2"]
    classes = cut(sets.groupBy(*key).agg(F.min(F.struct("id", "p", "pre", "sk")).alias("m")).select(*key, F.col("m.id").alias("gid"), "m.p", "m.pre", "m.sk"))
    again = cut(sets.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    repeats = again.limit(1).count() > 0
    # Whole sets are made of each row once.
    once = cut(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).distinct()) if repeats else docs
    found = linked(once, classes, n, percent, id_col, text_col, hot)
    comp = cut(classes.select(*key, "gid").join(found.select("gid", "comp"), "gid", "left").select(*key, F.coalesce("comp", "gid").alias("comp")))
    forget(classes, found)
    if repeats:
        # A doc_id that stands in several classes joins them.
        forget(once)
        ids = cut(sets.select("id", *key).join(again, "id", "left_semi").join(comp, key).select("id", "comp"))
        least = ids.groupBy("id").agg(F.min("comp").alias("a"))
        of = components(cut(ids.join(least, "id").where("comp <> a").select("a", F.col("comp").alias("b")).distinct()))
        comp = cut(relabelled(comp, of))
    return every.select("id", *key).join(comp, key, "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
