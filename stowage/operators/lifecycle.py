"""Life cycle of backups: what is deleted by hand, recovered, resumed, published and notified.

Each decision is one Column over a table of clients or backups, or a join on the client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.paths import kind_class, path_key

STAGES = ["working", "finishing", "current"]


def delete_one(backups: DataFrame, wanted: str) -> DataFrame:
    """client, bno, state and is_current of all backups after one of each client is deleted by number or exact text.

    wanted is a stamp (columns client, bno, stamp, deletable) or begins with a number; the first
    match of a client counts. state is deleted, refused (not deletable) or kept. What is current
    moves to the newest backup that stays.
    """
    digits = wanted[: len(wanted) - len(wanted.lstrip("0123456789"))]
    match = (F.col("stamp") == wanted) | (F.col("bno") == int(digits or 0))
    first = backups.where(match).groupBy("client").agg(F.min("bno").alias("_bno"))
    marked = backups.join(first, "client", "left")
    state = F.when(F.col("bno") == F.col("_bno"), F.when(F.col("deletable"), "deleted").otherwise("refused")).otherwise("kept")
    marked = marked.select("client", "bno", state.alias("state"))
    newest = marked.where("state <> 'deleted'").groupBy("client").agg(F.max("bno").alias("_newest"))
    return marked.join(newest, "client", "left").select("client", "bno", "state", F.coalesce(F.col("bno") == F.col("_newest"), F.lit(False)).alias("is_current"))


def stages(log: DataFrame) -> DataFrame:
    """client, bno and the latest stage that each backup reached, by a log of stages (client, bno, stage)."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    reached = log.where(F.col("stage").isin(STAGES)).groupBy("client", "bno").agg(F.max(rank).alias("_r"))
    return reached.select("client", "bno", F.element_at(F.array(*map(F.lit, STAGES)), F.col("_r").cast("int")).alias("stage"))


def listed(backups: DataFrame, staged: DataFrame, logs: DataFrame) -> DataFrame:
    """Backups with their stage as flags, unfinished ones too, and which logs they have.

    Columns of logs: client, bno, name. The newest backup whose stage is current is the current
    one; a backup without a stage was finished long ago.
    """
    names = ["backup", "restore", "verify", "backup_stats", "restore_stats", "verify_stats"]
    have = logs.where(F.col("name").isin(names)).groupBy("client", "bno").agg(F.array_sort(F.collect_set("name")).alias("logs"))
    out = backups.select("client", "bno").join(staged, ["client", "bno"], "left").join(have, ["client", "bno"], "left")
    done = out.where("stage is null or stage = 'current'").groupBy("client").agg(F.max("bno").alias("_newest"))
    out = out.join(done, "client", "left")
    flag = lambda s: F.coalesce(F.col("stage") == s, F.lit(False))
    return out.select("client", "bno", flag("working").alias("working"), flag("finishing").alias("finishing"), F.coalesce(F.col("bno") == F.col("_newest"), F.lit(False)).alias("current"), F.coalesce("logs", F.array().cast("array<string>")).alias("logs"))


def recovery(method: Column, max_attempts: Column) -> Column:
    """What becomes of a client's unfinished backup: start (there is none), complete, delete, resume, refuse or unknown.

    Columns: stage; phase1_tmp, phase1, changed and unchanged (which journals there are); attempts
    (with this one); same_rules (null where the old rules weren't kept); is_super. Where the scan
    didn't end, or after too many attempts, it is deleted whatever the method says.
    """
    c = F.col
    scanned = ~c("phase1_tmp") & (c("phase1") | c("changed") | c("unchanged"))
    spent = (max_attempts > 0) & (c("attempts") > max_attempts)
    resume = F.when(c("is_super"), "refuse").when(F.coalesce(c("same_rules"), F.lit(True)), "resume").otherwise("delete")
    working = F.when(~scanned | spent | (method == "delete"), "delete").when(method == "resume", resume).otherwise("unknown")
    return F.when(c("stage") == "finishing", "complete").when(c("stage") == "working", working).otherwise("start")


def attempts(lines: DataFrame) -> DataFrame:
    """Resume attempts of each client: the lines of its resume file."""
    return lines.groupBy("client").agg(F.count("*").alias("attempts"))


def resume_points(changed: DataFrame) -> DataFrame:
    """client and the place, in the order of inventories, of the last entry of each client's journal of changed entries."""
    place = F.struct(path_key(F.col("path")).alias("key"), kind_class(F.col("kind")).alias("class"))
    return changed.groupBy("client").agg(F.max(place).alias("point"))


def resume(scan: DataFrame, journal: DataFrame, points: DataFrame, after: bool) -> DataFrame:
    """What a resumed backup goes on with: entries of the scan after each client's point, or of a journal up to it.

    With ``after`` the rows of ``scan`` that aren't done yet; without, the rows of ``journal`` that
    were written before the point. A client without a point starts anew.
    """
    rows = scan if after else journal
    place = F.struct(path_key(F.col("path")).alias("key"), kind_class(F.col("kind")).alias("class"))
    joined = rows.withColumn("_place", place).join(points, "client", "left")
    keep = (F.col("_place") > F.col("point")) | F.col("point").isNull() if after else F.col("_place") <= F.col("point")
    return joined.where(keep).select(*rows.columns)


def next_numbers(backups: DataFrame, stored: DataFrame) -> DataFrame:
    """client, next_bno and next_path: the number after the last backup, and after the highest data path (client, number)."""
    number = backups.groupBy("client").agg((F.max("bno") + 1).alias("next_bno"))
    path = stored.groupBy("client").agg((F.max("number") + 1).alias("next_path"))
    return number.join(path, "client", "full_outer").select("client", F.coalesce("next_bno", F.lit(1)).alias("next_bno"), F.coalesce("next_path", F.lit(0)).alias("next_path"))


def notification(failed: Column, warnings: Column, changed: Column, warnings_only: bool = False, changes_only: bool = False) -> Column:
    """failure, success, or null where the rules want no word of a success."""
    wanted = F.lit(not warnings_only and not changes_only)
    if warnings_only:
        wanted = wanted | (warnings > 0)
    if changes_only:
        wanted = wanted | (changed > 0)
    return F.when(failed, "failure").when(wanted, "success")


def without_skipped(entries: DataFrame, skipped: DataFrame) -> DataFrame:
    """Entries but for those whose path either side gave up (column path)."""
    return entries.join(skipped.select("path").distinct(), "path", "left_anti")


#: Where the data of a new version may come from, best first.
SOURCES = ["final", "delta", "fresh", "old", "relink"]


def materialise(entries: DataFrame, places: DataFrame) -> DataFrame:
    """datapth and source of each entry's data: the best place that has it (columns datapth, place), or missing."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("place"))
    best = places.where(F.col("place").isin(SOURCES)).groupBy("datapth").agg(F.min(rank).cast("int").alias("_r"))
    source = F.when(F.col("_r").isNull(), "missing").otherwise(F.element_at(F.array(*map(F.lit, SOURCES)), F.col("_r")))
    return entries.select("datapth").distinct().join(best, "datapth", "left").select("datapth", source.alias("source"))


def patched(made: DataFrame, failed: DataFrame, hardlinked: bool) -> DataFrame:
    """datapth and outcome of the entries made from forward deltas: removed where the patch failed, else with a reverse delta, or none if the previous backup is kept whole."""
    bad = failed.select("datapth", F.lit(True).alias("_bad")).distinct()
    good = F.lit("patched" if hardlinked else "patched, reverse delta")
    return made.where("source = 'delta'").join(bad, "datapth", "left").select("datapth", F.when(F.col("_bad"), "removed").otherwise(good).alias("outcome"))


def clone(files: DataFrame, max_links: int) -> DataFrame:
    """How each file of a backup gets into its clone: linked, or copied where it has all the links it may have."""
    return files.withColumn("how", F.when(F.col("nlink") >= max_links, "copy").otherwise("link"))
