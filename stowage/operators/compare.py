"""Comparison of two inventories: changes, diffs, merges, deletions, counters and their reports.

Inventories have at least path, kind, mtime and ctime; entries meet on (path, kind class). All
joins are equality joins, so one client or one huge generation spreads over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.codec import endfile_size
from stowage.functions.formats import kind_name
from stowage.functions.paths import kind_class, path_key
from stowage.sources.shared import cut

VOLUME = ["v", "V", "u", "U"]
DATA = ["f", "y", "m", "n", "k"]
ENCRYPTED = ["y", "n", "V", "U", "k"]
#: Sent again whole when only the ctime changed: metadata, system files, volume data.
TOUCHED = ["m", "n", "k", *VOLUME]
#: Never sent as a delta, if either side is one of these.
WHOLE = ["m", *ENCRYPTED, *VOLUME]
#: Fixed value: the number of the newest encryption scheme.
LATEST_SCHEME = 2


def _sides(current: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("path", kind_class(F.col("kind")).alias("kind_class"), *(F.col(c).alias(f"{prefix}_{c}") for c in columns))

    return side(current, "cur").join(side(previous, "prev"), ["path", "kind_class"], "full_outer")


def is_compressed(level: Column, datapth: Column) -> Column:
    """Whether stored data is compressed: by its level, or where that is unknown (negative or null) by its name."""
    return F.when(level >= 0, level > 0).otherwise(F.coalesce(datapth.endswith(".gz"), F.lit(False)))


def change_of(delta: bool = True, windows: bool = False, max_size: int | None = None, encryption: bool = False, compression: bool = False, relinked: Column | None = None) -> Column:
    """Class of a joined pair, the first rule that fits: new, same, changed or deleted.

    With ``encryption`` entries of an older scheme (column encryption) are sent again; with
    ``compression`` files whose stored data is compressed and whose level now is 0, or the reverse
    (columns compression and datapth). ``relinked`` says which hard links may take over their
    deleted master's data.
    """
    cur, prev = F.col("cur_kind"), F.col("prev_kind")
    either = lambda kinds: cur.isin(kinds) | prev.isin(kinds)
    same_mtime = F.col("cur_mtime") == F.col("prev_mtime")
    out = F.when(cur.isNull(), "deleted").when(prev.isNull(), "new")
    if relinked is not None:
        out = out.when((cur != prev) & relinked, "same")
    out = out.when(cur != prev, "new")
    if encryption:
        out = out.when(prev.isin(ENCRYPTED) & (prev != "k") & (F.col("prev_encryption") < LATEST_SCHEME), "new")
    out = out.when(same_mtime & (F.col("cur_ctime") == F.col("prev_ctime")), "same")
    out = out.when(same_mtime & either(TOUCHED), "new")
    if not windows:
        out = out.when(same_mtime, "same")
    out = out.when(~cur.isin(DATA + VOLUME), "changed")
    if not delta:
        return out.otherwise("new")
    out = out.when(either(WHOLE), "new")
    if max_size:
        out = out.when((F.col("cur_size") > max_size) | (F.col("prev_size") > max_size), "new")
    if compression:
        was = is_compressed(F.col("prev_compression"), F.col("prev_datapth"))
        out = out.when(was != (F.coalesce(F.col("cur_compression"), F.lit(0)) > 0), "new")
    return out.otherwise("changed")


def relinkable(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, relink): files that were hard links whose master is in the previous inventory with the file's kind and stored data; relink is that data.

    The path that a hard link pointed to may be gone; what it stored is still there, so the file
    needn't be sent again if it is the same inode with the same mtime. Inventories need dev, ino and
    mtime, the previous one link and datapth as well.
    """
    was = previous.where("kind = 'L'").select("path", F.col("dev").alias("_dev"), F.col("ino").alias("_ino"), F.col("mtime").alias("_mtime"), F.col("link").alias("_link"))
    same = (F.col("dev") == F.col("_dev")) & (F.col("ino") == F.col("_ino")) & (F.col("mtime") == F.col("_mtime"))
    files = current.where(F.col("kind").isin("f", "y")).select("path", "kind", "dev", "ino", "mtime").join(was, "path").where(same).select("path", "kind", "_link")
    masters = previous.where(F.col("kind").isin("f", "y") & F.col("datapth").isNotNull()).groupBy(F.col("path").alias("_link")).agg(F.min(F.struct("kind", "datapth")).alias("_m"))
    return files.join(masters, "_link").where("kind = _m.kind").select("path", F.col("_m.datapth").alias("relink"))


def compare(current: DataFrame, previous: DataFrame | None, reset: bool = False, relink: bool = False, **options) -> DataFrame:
    """path, kind_class, kind, prev_kind and change of every entry of either inventory; all new without a previous one or after a reset.

    With ``relink`` also relink: the stored data that a file takes over from a deleted hard-link
    master; such a file is unchanged.
    """
    if previous is None or reset:
        return current.select("path", kind_class(F.col("kind")).alias("kind_class"), "kind", F.lit(None).cast("string").alias("prev_kind"), F.lit("new").alias("change"))
    optional = [c for c in ("encryption", "compression", "datapth") if c in current.columns and c in previous.columns]
    joined = _sides(current, previous, ["kind", "mtime", "ctime", "size", *optional])
    out = ["path", "kind_class", F.coalesce("cur_kind", "prev_kind").alias("kind"), "prev_kind"]
    if relink:
        joined = joined.join(relinkable(current, previous).withColumn("kind_class", F.lit(1)), ["path", "kind_class"], "left")
        return joined.select(*out, change_of(relinked=F.col("relink").isNotNull(), **options).alias("change"), "relink")
    return joined.select(*out, change_of(**options).alias("change"))


def carry_over(current: DataFrame, previous: DataFrame, stored: list[str]) -> DataFrame:
    """Entries of current that are unchanged: new attributes, stored columns from the previous entry."""
    cols = ["kind", "mtime", "ctime", "size"]
    joined = _sides(current, previous.select(*dict.fromkeys([*cols, *stored, "path"])), list(dict.fromkeys([*cols, *stored])))
    return joined.where(change_of() == "same").select("path", F.col("cur_kind").alias("kind"), *(F.col(f"cur_{c}").alias(c) for c in cols[1:] if c not in stored), *(F.col(f"prev_{c}").alias(c) for c in stored))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """sign, path, kind, mtime: "-" for entries gone, "+" for new ones, both where the mtime differs."""
    joined = _sides(new, old, ["kind", "mtime"])
    minus = F.struct(F.lit("-").alias("sign"), F.col("prev_kind").alias("kind"), F.col("prev_mtime").alias("mtime"))
    plus = F.struct(F.lit("+").alias("sign"), F.col("cur_kind").alias("kind"), F.col("cur_mtime").alias("mtime"))
    rows = F.when(F.col("cur_kind").isNull(), F.array(minus)).when(F.col("prev_kind").isNull(), F.array(plus)).when(F.col("cur_mtime") != F.col("prev_mtime"), F.array(minus, plus))
    return joined.select("path", "kind_class", F.explode(rows).alias("r")).select("r.sign", "path", "r.kind", "r.mtime", "kind_class")


def in_order(df: DataFrame, *more: Column) -> DataFrame:
    """Rows in the order of inventories."""
    return df.orderBy(path_key(F.col("path")), *more)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """Rows with their number, from 1, within ``by`` in an order: a range-partitioned sort, plus how many rows earlier partitions hold.

    No window over the rows: a value of ``by`` with most of all rows spreads over partitions as well.
    """
    keys = [F.col(c) for c in by] + order
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")))
    parts = placed.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_n")  # a row for each partition
    found = placed.join(parts.select(*by, "_p", "_first", before.alias("_before")), [*by, "_p"])
    return found.select(*df.columns, (F.col("_i") - F.col("_first") + F.col("_before") + 1).alias(name))


def apply_deletions(manifest: DataFrame, deletions: DataFrame) -> DataFrame:
    keys = deletions.select("path", kind_class(F.col("kind")).alias("_class")).distinct()
    return manifest.withColumn("_class", kind_class(F.col("kind"))).join(keys, ["path", "_class"], "left_anti").select(*manifest.columns)


def merge(changed: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Union of both; on an equal key the changed entry wins."""
    return changed.unionByName(apply_deletions(unchanged, changed))


def counters(changes: DataFrame) -> DataFrame:
    """Entries of each kind by change, and how many the scan saw; a changed file (z) counts to the files."""
    kind = F.when(F.col("kind") == "z", "f").otherwise(F.col("kind")).alias("kind")
    count = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)
    change = F.col("change")
    return changes.groupBy(kind).agg(*(count(change == c, c) for c in ("new", "changed", "same", "deleted")), count(change != "deleted", "scanned"))


def totals(counts: DataFrame) -> DataFrame:
    """Counters with the total "Y" and the grand total "Z", to which alone scanned entries add; warnings and messages are in neither."""
    names = ["new", "changed", "same", "deleted", "scanned"]
    whole = counts.where(~F.col("kind").isin("w", "p")).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names))
    both = whole.select(F.explode(F.array(F.lit("Y"), F.lit("Z"))).alias("kind"), *names)
    return counts.unionByName(both.withColumn("scanned", F.when(F.col("kind") == "Z", F.col("scanned")).otherwise(0)))


def report(counts: DataFrame) -> DataFrame:
    """Rows of the printed report: new, changed, same, deleted, their total without the deleted, and scanned; without kinds of which nothing was scanned or stored."""
    return counts.withColumn("total", F.col("new") + F.col("changed") + F.col("same")).where("total > 0 or scanned > 0")


def byte_sums(manifest: DataFrame, by: list[str]) -> DataFrame:
    """Estimated bytes: sizes of files, encrypted files and system files."""
    return manifest.groupBy(*by).agg(F.sum(F.when(F.col("kind").isin("f", "y", "k"), F.col("size")).otherwise(0)).cast("long").alias("estimated"), F.count("*").alias("entries"))


def stored_bytes(manifest: DataFrame, by: list[str]) -> DataFrame:
    """Bytes by the end lines of new, changed and unchanged entries (column endfile), and the estimate from their sizes."""
    estimated = F.sum(F.when(F.col("kind").isin("f", "y", "k"), F.col("size")).otherwise(0)).cast("long")
    return manifest.groupBy(*by).agg(F.sum(endfile_size(F.col("endfile"))).alias("bytes"), estimated.alias("estimated"))


def fails_on_warning(counts: DataFrame) -> DataFrame:
    """failed: whether there was a warning (columns kind, count)."""
    return counts.agg((F.coalesce(F.sum(F.when(F.col("kind") == "w", F.col("count"))), F.lit(0)) > 0).alias("failed"))


def report_lines(counts: DataFrame) -> DataFrame:
    """kind and line of the printed report: a name and six columns of numbers, of ``report`` rows."""
    name = F.coalesce(kind_name(F.col("kind")), F.when(F.col("kind") == "Z", "grand total"), F.col("kind"))
    numbers = [F.col(c) for c in ("new", "changed", "same", "deleted", "total", "scanned")]
    return report(counts).select("kind", F.format_string("%22s:" + " %9d" * len(numbers), name, *numbers).alias("line"))


def quota(sums: DataFrame, hard: int, soft: int) -> DataFrame:
    """State of each estimate: hard, soft or ok; a limit of 0 is off."""
    over = lambda limit: (F.col("estimated") > limit) if limit else F.lit(False)
    return sums.withColumn("state", F.when(over(hard), "hard").when(over(soft), "soft").otherwise("ok"))
