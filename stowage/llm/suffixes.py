"""Operator 10: suffix-array dedup of byte strings that stand at two places.

Every string of ``length`` bytes that starts at two places, of one text or of two, is removed
wherever it stands. A suffix at each byte would be hundreds of times the input, so the suffix
array is sparse:

1. Sampling. In each window of ``length`` bytes the smallest hash of its SEED-byte strings names
   one suffix, its anchor (the leftmost on ties). Equal windows have equal anchors at equal
   places, so that only suffixes at anchors need sorting. An anchor's context is what its own
   windows span.
2. Pruning. Anchors are counted by seed and context, with partial aggregation. A context that
   stands twice is repeated whole; one whose seed stands nowhere else is unique.
3. Sorting. One copy of each remaining context is range-partitioned by sampled splitters over
   the leading bytes of its suffix; in each bucket a multikey quicksort sorts suffixes and
   reversed left contexts, and the prefixes that neighbours share tell for each window whether
   another one equals it.
4. Seeds with more than ``block_rows`` contexts don't stay in one bucket: their windows become
   rows that are range-partitioned by content, each bucket compares neighbours, and the runs that
   cross a boundary are compared by the rows at the edges of the buckets.

Cases: null and empty texts have nothing to remove, like texts shorter than ``length``; texts of
any length are treated whole; repeated rows (and equal texts) are repeated strings like any other;
an empty table gives an empty table; further columns are kept by ``remove_repeats``, whose own
columns are named ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` and ``kept_text`` and replace
columns of that name, like the keys ``_k1``, ``_k2`` and ``_ranges`` that it works with. One text is worked on in one
task, with some 60 bytes of memory for each of its bytes: 20 MB of text need an executor's 1.2 GB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encoded, forget, inverse_powers, map_batches, mix, prefix_sums, slices, spans_hash

#: Bytes that name an anchor.
SEED = 32
#: Contexts of one seed that a bucket may sort together; more are sorted by window.
BLOCK_ROWS = 16_384
#: Contexts that one step of a bucket works on, beside the block that fills it up.
STEP_ROWS = 8_192
_U = np.uint64


def text_key(column: str) -> list:
    """Two independent 64-bit hashes of a text, under which equal texts meet."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("second"), text).alias("_k2")]


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Anchors of a slice of texts: text, place, first and last window start (all in the slice), hashes of seed and context; and the joined bytes with each text's offset."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    stop = np.cumsum([len(t) for t in texts])
    n = len(joined)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none, joined, stop
    sums = prefix_sums(joined)
    width = length - SEED + 1
    key = mix((sums[SEED:] - sums[:-SEED]) * inverse_powers(n)[: n - SEED + 1])
    key = (key & _U(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=_U)
    done = 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if done < width:
        key = np.minimum(key[: len(key) - (width - done)], key[width - done :])
    place = (key & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    last = np.append(first[1:], len(place)) - 1
    place = place[first]
    # A run of windows may begin in one text and end in the next: keep what lies in the text of its anchor.
    text = np.searchsorted(stop, place, "right")
    first = np.maximum(first, (stop - [len(t) for t in texts])[text])
    last = np.minimum(last, stop[text] - length)
    keep = first <= last
    text, place, first, last = text[keep], place[keep], first[keep], last[keep]
    seed = mix(spans_hash(sums, place, place + SEED)).astype(np.int64)
    context = mix(spans_hash(prefix_sums(joined, 1), first, last + length) + mix((place - first).astype(_U) + _U(1) + ((last - first).astype(_U) << _U(32)))).astype(np.int64)
    return text, place, first, last, seed, context, joined, stop


def _anchor_table(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    """A row for each anchor: key of its text, hashes of seed and context, and in its text the place, the first window and the number of windows."""
    found = docs.select(*text_key(text_col), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = encoded(batch.column(2))
        for a, b in slices([len(t) for t in texts]):
            text, place, first, last, seed, context, _, stop = anchors(texts[a:b], length)
            begin = (stop - [len(t) for t in texts[a:b]])[text]
            rows = pa.array(text + a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(seed), pa.array(context), pa.array(place - begin), pa.array(first - begin), pa.array((last - first + 1).astype(np.int32))], names=["_k1", "_k2", "seed", "context", "place", "first", "windows"])

    return map_batches(found, step, "_k1 long, _k2 long, seed long, context long, place long, first long, windows int")


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian 8-byte words, and the bytes that each shares with the one before.

    Multikey quicksort, all ties of a depth at once: rows that agree on the words so far are
    split by their next word, and only rows that are still tied go on.
    """
    n, depth = rows.shape
    order = np.arange(n)
    shared = np.zeros(n, np.int32)
    group = np.zeros(n, np.int64)  # of each place in the order
    tied = np.arange(n)
    for d in range(depth):
        word = rows[order[tied], d]
        by = np.lexsort((word, group[tied]))
        order[tied] = order[tied][by]
        word = word[by]
        g = group[tied]
        same_group = np.concatenate(([False], (g[1:] == g[:-1]) & (tied[1:] == tied[:-1] + 1)))
        same = same_group.copy()
        same[1:] &= word[1:] == word[:-1]
        split = same_group & ~same
        at = np.flatnonzero(split)
        x = word[at] ^ word[at - 1]
        lead = np.zeros(len(at), np.int32)
        for k in range(1, 8):
            lead += (x >> _U(64 - 8 * k)) == 0
        shared[tied[at]] = 8 * d + lead
        shared[tied[same]] = 8 * (d + 1)
        start = np.where(same, 0, tied)
        group[tied] = np.maximum.accumulate(start)
        more = same.copy()
        more[:-1] |= same[1:]
        tied = tied[more]
        if not len(tied):
            break
    return order, shared


class RangeMin:
    """Smallest of values[i:j] for many i < j."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp((j - i).astype(np.float64))[1] - 1
        out = np.empty(len(i), self.rows[0].dtype)
        for k in np.unique(level):
            has = level == k
            out[has] = np.minimum(self.rows[k][i[has]], self.rows[k][j[has] - (1 << int(k))])
        return out


def _words(parts: list[bytes], width: int) -> np.ndarray:
    """Rows of big-endian words of the parts, filled up with zeros."""
    size = -(-width // 8) * 8
    return np.frombuffer(b"".join([p.ljust(size, b"\0") for p in parts]), ">u8").astype(_U).reshape(len(parts), size // 8)


def repeated_windows(contexts: list[bytes], place: np.ndarray, windows: np.ndarray, block: np.ndarray, length: int) -> np.ndarray:
    """Which windows of each context equal a window of another context of its block: a row of flags, by window.

    The anchor stands at ``place`` of its context; window w begins at byte w.
    """
    n = len(contexts)
    out = np.zeros((n, int(windows.max(initial=0))), bool)
    right = _words([c[p:] for c, p in zip(contexts, place, strict=True)], length)
    left = _words([c[:p][::-1] for c, p in zip(contexts, place, strict=True)], max(1, int(place.max(initial=0))))
    blocks = block.astype(np.int64).view(_U)[:, None]
    order, shared = multikey_sort(np.concatenate((blocks, right), 1))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least = RangeMin(shared - 8)  # bytes of the suffixes themselves; below 0 between blocks
    by_left, left_shared = multikey_sort(np.concatenate((blocks, left), 1))
    left_shared = left_shared - 8
    high, low = place, place - windows + 1  # bytes that a window reaches back from the anchor, at most and at least
    for back in range(int(high.max(initial=0)) + 1):
        # Classes of contexts with the same ``back`` bytes before the anchor.
        cls = np.empty(n, np.int64)
        cls[by_left] = np.cumsum(left_shared < back)
        rows = np.flatnonzero((low <= back) & (back <= high))
        if len(rows) < 2:
            continue
        rows = rows[np.argsort(cls[rows] * n + rank[rows])]
        same = np.flatnonzero(cls[rows[1:]] == cls[rows[:-1]])
        if not len(same):
            continue
        i, j = rank[rows[same]], rank[rows[same + 1]]
        equal = same[least(i + 1, j + 1) >= length - back]
        for x in (rows[equal], rows[equal + 1]):
            out[x, place[x] - back] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of each run of flags."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    return row, begin, np.nonzero(edge == -1)[1]


def _in_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """(seed, context, begin, end): runs of repeated windows of each context whose seed fits one bucket."""

    def run(batches):
        kept: list[pa.RecordBatch] = []
        count = 0

        def flush(table: pa.Table):
            c = table.column("bytes").to_pylist()
            place, windows = (table.column(k).to_numpy().astype(np.int64) for k in ("at", "windows"))
            seed = table.column("seed").to_numpy()
            row, begin, end = _runs(repeated_windows(c, place, windows, seed, length))
            return pa.RecordBatch.from_arrays([pa.array(seed[row]), pa.array(table.column("context").to_numpy()[row]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=["seed", "context", "begin", "end"])

        for batch in batches:
            kept.append(batch)
            count += batch.num_rows
            if count >= STEP_ROWS:  # all but the last seed, whose block may go on
                table = pa.Table.from_batches(kept)
                seed = table.column("seed").to_numpy()
                whole = int(np.flatnonzero(seed != seed[-1])[-1]) + 1 if (seed != seed[-1]).any() else 0
                if whole:
                    yield flush(table.slice(0, whole))
                    kept = table.slice(whole).combine_chunks().to_batches()
                    count -= whole
        if count:
            yield flush(pa.Table.from_batches(kept))

    return contexts.mapInArrow(run, "seed long, context long, begin int, end int")


def equal_neighbours(rows: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Rows (keys and ids) whose keys stand in another row too, by sorted ranges.

    Rows are range-partitioned by keys and ids, so that a very common key spreads over buckets;
    each bucket marks equal neighbours. Only the first and last rows of buckets can have their
    equal elsewhere: these few are compared with each other afterwards.
    """
    placed = rows.repartitionByRange(*keys, *ids).sortWithinPartitions(*keys, *ids)
    names = [*keys, *ids]

    def run(batches):
        last = None  # the row before, and whether it has been marked
        state = {"first": True}

        def emit(batch, marked, edge):
            keep = pa.array(marked | edge)
            return pa.RecordBatch.from_arrays([*(batch.column(k).filter(keep) for k in range(len(names))), pa.array(marked[marked | edge]), pa.array(edge[marked | edge])], names=[*names, "marked", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last[0], batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            same = np.ones(n - 1, bool)
            for k in range(len(keys)):
                x = batch.column(k).to_numpy(zero_copy_only=False)
                same &= x[1:] == x[:-1]
            marked = np.zeros(n, bool)
            marked[1:] |= same
            marked[:-1] |= same
            if last is not None:
                marked[0] |= last[1]
            edge = np.zeros(n, bool)
            edge[0] = state["first"]
            # The last row waits for the next batch.
            yield emit(batch.slice(0, n - 1), marked[:-1], edge[:-1])
            state["first"] = state["first"] and n == 1
            last = (batch.slice(n - 1), bool(marked[-1]))
        if last is not None:
            yield emit(last[0], np.array([last[1]]), np.array([True]))

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = cut(placed.select(*names).mapInArrow(run, ", ".join(f"`{n}` {fields[n]}" for n in names) + ", marked boolean, edge boolean"))
    edges = found.where("edge")
    met = edges.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    crossing = edges.where("not marked").join(met, keys, "left_semi").select(*names)
    return found.where("marked").select(*names).union(crossing)


def _in_windows(contexts: DataFrame, length: int) -> DataFrame:
    """What ``_in_blocks`` returns, for seeds with more contexts than a bucket may hold: a row for each window, which two independent 64-bit hashes stand for."""

    def spread(batch: pa.RecordBatch):
        c = batch.column(3).to_pylist()
        windows = batch.column(2).to_numpy()
        for a, b in slices([32 * int(w) for w in windows]):
            joined = np.frombuffer(b"".join(c[a:b]), np.uint8)
            sums = prefix_sums(joined)
            size = np.array([len(x) for x in c[a:b]])
            base = np.repeat(np.cumsum(size) - size, windows[a:b])
            window = np.arange(len(base)) - np.repeat(np.cumsum(windows[a:b]) - windows[a:b], windows[a:b])
            start = base + window
            prints = [mix(spans_hash(s, start, end)).astype(np.int64) for s, end in ((sums, start + SEED), (sums, start + length), (prefix_sums(joined, 1), start + length))]
            row = pa.array(np.repeat(np.arange(a, b), windows[a:b]))
            yield pa.RecordBatch.from_arrays([*map(pa.array, prints), batch.column(0).take(row), batch.column(1).take(row), pa.array(window.astype(np.int32))], names=["lead", "print", "print_2", "seed", "context", "window"])

    rows = map_batches(contexts.select("seed", "context", "windows", "bytes"), spread, "lead long, print long, print_2 long, seed long, context long, window int")
    found = equal_neighbours(rows, ["lead", "print", "print_2"], ["seed", "context", "window"])
    # At most ``length`` windows to a context.
    return found.groupBy("seed", "context").agg(F.collect_set("window").alias("w")).select("seed", "context", F.explode("w").alias("begin")).withColumn("end", (F.col("begin") + 1).cast("int"))


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The bytes of each wanted context: seed, context, lead (first bytes of the suffix), at, windows, big, bytes; and the cut frame that this reads."""
    packed = cut(wanted.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("seed", "context", "place", "first", "windows", "big")).alias("a")))
    texts = docs.select(*text_key(text_col), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)
    both = texts.join(packed, ["_k1", "_k2"])  # repeated rows of a text repeat its contexts; they are one again below

    def step(batch: pa.RecordBatch):
        texts = encoded(batch.column(0))
        lists = batch.column(1)
        for a, b in slices([len(t) for t in texts]):
            part = lists.slice(a, b - a)
            flat = part.flatten()
            row = np.repeat(np.arange(a, b), np.diff(part.offsets.to_numpy()))
            f = {k: flat.field(k) for k in ("seed", "context", "place", "first", "windows", "big")}
            place, first, windows = (f[k].to_numpy().astype(np.int64) for k in ("place", "first", "windows"))
            cut_out = [texts[r][i : i + w + length - 1] for r, i, w in zip(row, first, windows, strict=True)]
            lead = [int.from_bytes(texts[r][p : p + 8], "big", signed=False) - (1 << 63) for r, p in zip(row, place, strict=True)]
            yield pa.RecordBatch.from_arrays([f["seed"], f["context"], pa.array(lead, pa.int64()), pa.array((place - first).astype(np.int32)), f["windows"], f["big"], pa.array(cut_out, pa.binary())], names=["seed", "context", "lead", "at", "windows", "big", "bytes"])

    return map_batches(both.select("text", "a"), step, "seed long, context long, lead long, at int, windows int, big boolean, bytes binary"), packed


def _merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Ranges of each text in order, those that touch or overlap as one."""
    lists = batch.column(2)
    flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
    row, begin, end = np.repeat(np.arange(len(size)), size), flat.field("begin").to_numpy(), flat.field("end").to_numpy()
    order = np.lexsort((end, begin, row))
    row, begin, end = row[order], begin[order], end[order]
    # Each text lies behind the one before, so that one running maximum serves all.
    shift = row * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(row), bool)
    new[1:] = begin[1:] + shift[1:] > reach[:-1]
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(row)) - 1
    at = np.concatenate(([0], np.cumsum(np.bincount(row[start], minlength=len(size))))).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(begin[start]), pa.array(reach[last] - shift[last])], names=["begin", "end"])
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), found)], names=["_k1", "_k2", "ranges"])


def whole_characters(text: bytes, begin: list[int], end: list[int]) -> str:
    """What stays of a text without the ranges, and without the characters that they cut."""
    pieces, last = [], 0
    for i, j in zip(begin, end, strict=True):
        while i > 0 and text[i] & 0xC0 == 0x80:
            i -= 1
        while j < len(text) and text[j] & 0xC0 == 0x80:
            j += 1
        pieces.append(text[last : max(i, last)])
        last = j
    return b"".join([*pieces, text[last:]]).decode()


def repeated_ranges(docs: DataFrame, length: int, text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_k1, _k2, ranges): for each text with repeated strings, by ``text_key``, the sorted disjoint byte ranges that they cover."""
    if length <= SEED:
        raise ValueError(f"length must be over {SEED}")
    table = cut(_anchor_table(docs, length, text_col))
    # What is joined is cut first: both sides of a join are then plain shuffles, which Spark splits where a key is hot.
    counts = cut(table.groupBy("seed", "context").agg(F.count("*").alias("n")))
    # Of each seed that stands twice: how many contexts it has.
    seeds = cut(counts.groupBy("seed").agg(F.sum("n").alias("total"), F.count("*").alias("contexts")).where("total > 1").select("seed", "contexts"))
    state = table.join(counts.where("n > 1"), ["seed", "context"], "left").join(seeds, "seed").select(table["*"], F.coalesce("n", F.lit(1)).alias("n"), "contexts")
    state = cut(state)
    forget(table, counts, seeds)
    # One place of each context of a seed that has several; those that stand twice are partners only.
    one = state.where("contexts > 1").groupBy("seed", "context").agg(F.min(F.struct("_k1", "_k2", "place", "first", "windows")).alias("m"), F.first("contexts").alias("contexts"))
    wanted = one.select("m._k1", "m._k2", "seed", "context", "m.place", "m.first", "m.windows", (F.col("contexts") > block_rows).alias("big"))
    found, packed = _contexts(docs, wanted, length, text_col)
    contexts = cut(found.dropDuplicates(["seed", "context"]))
    forget(packed)
    small = contexts.where("not big").repartitionByRange("lead", "seed").sortWithinPartitions("lead", "seed")
    found = _in_blocks(small.select("seed", "context", "at", "windows", "bytes"), length)
    big = contexts.where("big")
    if big.limit(1).count():
        found = found.unionByName(_in_windows(big, length))
    found = cut(found)
    forget(contexts)
    whole = state.where("n > 1").select("_k1", "_k2", F.col("first").alias("begin"), (F.col("first") + F.col("windows") - 1 + length).alias("end"))
    part = state.where("n = 1").join(found, ["seed", "context"]).select("_k1", "_k2", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end") - 1 + length).alias("end"))
    # At most one range for each window of a text, and one for each of its anchors as a rule.
    every = whole.union(part).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("begin", "end")).alias("all"))
    ranges = cut(map_batches(every, _merge, "_k1 long, _k2 long, ranges array<struct<begin:bigint,end:bigint>>"))
    forget(state, found)
    return ranges


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_text of each text.

    kept_text lacks the characters of which only some bytes were removed, too.
    """
    own = ["n_bytes", "n_removed", "n_spans", "kept", "kept_text"]
    docs = docs.drop(*own, "_k1", "_k2", "_ranges")
    ranges = repeated_ranges(docs, length, text_col, block_rows)
    names = docs.columns
    marked = docs.select("*", *text_key(text_col)).join(ranges.withColumnRenamed("ranges", "_ranges"), ["_k1", "_k2"], "left").select(*names, F.struct(F.col(text_col).cast("string").alias("text"), F.transform("_ranges", lambda r: r["begin"]).alias("begin"), F.transform("_ranges", lambda r: r["end"]).alias("end")).alias("_work"))
    at = len(names)

    def step(batch: pa.RecordBatch):
        work = batch.column(at)
        rows = []
        for text, begin, end in zip(encoded(work.field("text")), work.field("begin").to_pylist(), work.field("end").to_pylist(), strict=True):
            pieces, last, removed = [], 0, 0
            for i, j in zip(begin or (), end or (), strict=True):
                pieces.append(text[last:i])
                removed += j - i
                last = j
            rows.append((len(text), removed, len(begin or ()), b"".join([*pieces, text[last:]]) if begin else text, whole_characters(text, begin or (), end or ())))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[*names, *own])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(marked, step, f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")


def digests(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, sizes, spans and the SHA-256 of what is kept, of a result of ``remove_repeats``, and the text that is kept."""
    return kept.select(F.col(id_col).cast("long").alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))
