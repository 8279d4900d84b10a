"""Catalogue of backups: positions and flags, retention, schedules, selections and reports.

Backups have client, bno and ts. Windows are over one client's list of backups, which is short;
no plan orders the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(backups: DataFrame) -> DataFrame:
    """index (1 is the oldest), trbno (1 is the newest), prev_bno, next_bno and is_current of each backup."""
    by = Window.partitionBy("client").orderBy("bno")
    whole = Window.partitionBy("client")
    return backups.select(
        "*",
        F.row_number().over(by).cast("long").alias("index"),
        (F.max("bno").over(whole) - F.col("bno") + 1).alias("trbno"),
        F.lag("bno").over(by).alias("prev_bno"),
        F.lead("bno").over(by).alias("next_bno"),
        (F.max("bno").over(whole) == F.col("bno")).alias("is_current"),
    )


def hardlinked(backups: DataFrame, keep: list[int], archive: bool = False) -> DataFrame:
    """Whether each backup is stored whole: always for archives, every keep[0]-th with several keeps, else never."""
    rule = F.lit(True) if archive else (F.pmod(F.col("bno") - 1, F.lit(keep[0])) == 0) if len(keep) > 1 else F.lit(False)
    return backups.withColumn("hardlinked", rule)


def deletable(backups: DataFrame) -> DataFrame:
    """The oldest backup of a client, and those whose predecessor is stored whole."""
    by = Window.partitionBy("client").orderBy("bno")
    return backups.withColumn("deletable", F.coalesce(F.lag("hardlinked").over(by), F.lit(True)))


def normal_keeps(keep: list[int]) -> list[int]:
    """Checked keeps; the last of several counts one more."""
    product = 1
    for k in keep:
        if k <= 0:
            raise ValueError("a keep must be positive")
        product *= k
    if product > 52_560_000:
        raise ValueError("the keeps are too large")
    return keep if len(keep) < 2 else [*keep[:-1], keep[-1] + 1]


def survivors(bnos: list[int], linked: list[bool], keep: list[int]) -> list[int]:
    """Backup numbers that stay. Passes repeat, with flags and positions taken anew, until one deletes nothing."""
    alive = sorted(zip(bnos, linked, strict=True))
    while alive:
        last = alive[-1][0]
        rows = [(last - b + 1, b, i == 0 or alive[i - 1][1]) for i, (b, _) in enumerate(alive)]
        gone: set[int] = set()
        m = 1
        for i, k in enumerate(keep):
            low = m * k
            if i + 1 < len(keep):
                r = low * keep[i + 1]
                while r > low:
                    inside = [x for x in rows if r - low < x[0] <= r and x[1] not in gone]
                    left = len(inside)
                    for tr, b, free in sorted(inside):
                        if left > 1 and free and tr < r:
                            gone.add(b)
                            left -= 1
                    r -= low
            m = low
        if rows[0][0] > m:
            gone.add(rows[0][1])
        if not gone:
            break
        alive = [x for x in alive if x[0] not in gone]
    return [b for b, _ in alive]


def retain(backups: DataFrame, keep: list[int]) -> DataFrame:
    """Backups that retention keeps. One keep is a filter; several need a client's list at once, which is short: each pass deletes by what the last one left.

    Lists of many clients go to Python together, and their kept rows come back without a join.
    """
    if len(keep) == 1:
        trbno = F.max("bno").over(Window.partitionBy("client")) - F.col("bno") + 1
        return backups.withColumn("_t", trbno).where(F.col("_t") <= keep[0]).drop("_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            rows = lists.flatten()
            bnos, linked = rows.field("bno").to_pylist(), rows.field("hardlinked").to_pylist()
            at = [x - lists.offsets[0].as_py() for x in lists.offsets.to_pylist()]
            taken = []
            for i, j in zip(at, at[1:], strict=False):
                alive = set(survivors(bnos[i:j], linked[i:j], keep))
                taken += [k for k in range(i, j) if bnos[k] in alive]
            found = rows.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([found.field(f) for f in names], names=names)

    names = backups.columns
    lists = backups.groupBy("client").agg(F.collect_list(F.struct(*names)).alias("rows")).select("rows")
    return lists.mapInArrow(run, backups.schema)


def in_timeband(moment: Column, bands: list[str]) -> Column:
    """Whether a band names both the day and the hour of a moment, or is "always"; False without bands."""
    day, hour = F.lower(F.date_format(moment, "E")), F.date_format(moment, "HH")
    out = F.lit(False)
    for band in bands:
        text = F.lit(band.lower())
        out = out | (F.lit(band.lower()) == "always") | (text.contains(day) & text.contains(hour))
    return out


def due(latest: DataFrame, now: Column, interval: int, bands: list[str], manual: DataFrame | None = None) -> DataFrame:
    """Whether a backup is due: the moment is in a band, and the last one is missing or older than the interval (seconds); always for clients in ``manual``, which asked for one."""
    old = F.col("last").isNull() | (F.unix_timestamp("last") + interval < F.unix_timestamp(now))
    if manual is None:
        return latest.withColumn("due", in_timeband(now, bands) & old)
    asked = manual.select("client", F.lit(True).alias("_asked")).distinct()
    joined = latest.join(asked, "client", "left")
    return joined.select(*latest.columns, (F.coalesce("_asked", F.lit(False)) | (in_timeband(now, bands) & old)).alias("due"))


def latest(backups: DataFrame, *keep: str) -> DataFrame:
    """The newest backup of each client."""
    return backups.groupBy("client").agg(F.max_by(F.struct("bno", "ts", *keep), F.col("bno")).alias("b")).select("client", "b.*")


def top_n(backups: DataFrame, n: int) -> DataFrame:
    """The n newest backups of each client, with their rank; Spark limits the groups before it shuffles them."""
    return backups.withColumn("rank", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("bno")))).where(F.col("rank") <= n)


def round_robin(rows: DataFrame) -> DataFrame:
    """Rows in turn: the first of each client, then the second of each."""
    return rows.orderBy("rank", "client")


def select_backups(backups: DataFrame, wanted: str) -> DataFrame:
    """By number, "c..." for the current one, "a..." for all, or an exact timestamp."""
    if wanted.startswith("a"):
        return backups
    if wanted.startswith("c"):
        return backups.join(backups.groupBy("client").agg(F.max("bno").alias("bno")), ["client", "bno"], "left_semi")
    if wanted.isdigit():
        return backups.where(F.col("bno") == int(wanted))
    return backups.where(F.date_format("ts", "yyyy-MM-dd HH:mm:ss") == wanted)


def select_for_restore(backups: DataFrame, wanted: str) -> DataFrame:
    """As above, but the latest one where the text is empty or neither a number nor "a..."."""
    return select_backups(backups, wanted if wanted[:1] == "a" or wanted.isdigit() else "c")


def outdated(clients: DataFrame, backups: DataFrame, now: Column, days: int) -> DataFrame:
    """Clients whose last backup is more than so many days ago, or that have none."""
    last = backups.groupBy("client").agg(F.max("ts").alias("last"))
    return clients.join(last, "client", "left").where(F.unix_timestamp(now) - 86400 * days > F.coalesce(F.unix_timestamp("last"), F.lit(0)))


def calendar(backups: DataFrame) -> DataFrame:
    """Distinct days of each client's last month with backups."""
    days = backups.select("client", F.date_trunc("month", "ts").alias("month"), F.to_date("ts").alias("day")).distinct()
    last = days.groupBy("client").agg(F.max("month").alias("month"))
    return days.join(last, ["client", "month"], "left_semi").select("client", "day")


def snapshot(clients: DataFrame, backups: DataFrame) -> DataFrame:
    """client and a line with its last backup, or "0000000 never"."""
    found = clients.join(latest(backups), "client", "left")
    line = F.coalesce(F.concat(F.lpad(F.col("bno").cast("string"), 7, "0"), F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), F.lit("0000000 never"))
    return found.select("client", F.concat(F.lit("last backup: "), line).alias("line"))


def visible(clients: DataFrame, user: str, grants: DataFrame) -> DataFrame:
    """The user's own client, and those that grant the user (client, name)."""
    return clients.where(F.col("client") == user).unionByName(clients.where(F.col("client") != user).join(grants.where(F.col("name") == user), "client", "left_semi"))


def known_clients(*tables: DataFrame) -> DataFrame:
    """Every client that one of the tables names (column client), once."""
    out = tables[0].select("client")
    for t in tables[1:]:
        out = out.union(t.select("client"))
    return out.distinct()


def refreshed(known: DataFrame, snapshot_rows: DataFrame) -> DataFrame:
    """Known backups after a full snapshot: matched ones updated, missing ones dropped, new ones added."""
    flags = snapshot_rows.select("client", "bno", F.col("ts").alias("_ts"))
    return known.join(flags, ["client", "bno"], "right").select("client", "bno", F.col("_ts").alias("ts"), F.col("ts").isNull().alias("is_new"))
