"""What runs leave behind: statistics, journals, audit lines and logs, as rows and as files on any file system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letter of each change in a counter journal, and the statistics file of each action.
JOURNAL = {"new": "n", "changed": "c", "same": "s", "deleted": "d"}
STATISTICS = {"backup": "backup_stats", "restore": "restore_stats", "verify": "verify_stats"}


def journal_line(change: Column, kind: Column, path: Column) -> Column:
    """Line of a counter journal: the change's letter, then the entry's frame; null without a path."""
    letter = F.element_at(F.create_map(*(F.lit(x) for kv in JOURNAL.items() for x in kv)), change)
    return F.concat(letter, kind, F.lpad(F.hex(F.octet_length(path).cast("long")), 4, "0"), path)


def parse_journal(lines: DataFrame, column: str = "value") -> DataFrame:
    """change, kind and path of journal lines."""
    names = F.create_map(*(F.lit(x) for kv in ((v, k) for k, v in JOURNAL.items()) for x in kv))
    line = F.col(column)
    return lines.select(F.element_at(names, F.substring(line, 1, 1)).alias("change"), F.substring(line, 2, 1).alias("kind"), F.substr(line, F.lit(7)).alias("path"))


def write_journal(changes: DataFrame, path: str) -> None:
    """Append the journal lines of changes (change, kind, path)."""
    changes.select(journal_line(F.col("change"), F.col("kind"), F.col("path")).alias("value")).where("value is not null").write.mode("append").text(path)


def write_statistics(counters: DataFrame, folder: str, action: str) -> str:
    """Replace the statistics of an action by these counters, as JSON lines; returns the path."""
    path = f"{folder.rstrip('/')}/{STATISTICS[action]}"
    counters.write.mode("overwrite").json(path)
    return path


def audit_line(stamp: Column, address: Column, client: Column, command: Column) -> Column:
    """Line of a command log."""
    return F.concat_ws(" ", stamp, address, client, command)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append commands (stamp, address, client, command) to a log of each client."""
    line = audit_line(*(F.col(c) for c in ("stamp", "address", "client", "command")))
    rows.select("client", line.alias("value")).write.mode("append").partitionBy("client").text(path)


def first_contacts(commands: DataFrame) -> DataFrame:
    """client and created: when each client was first heard of."""
    return commands.groupBy("client").agg(F.min("stamp").alias("created"))


def log_counters(lines: DataFrame) -> DataFrame:
    """kind, name and count of what is logged: warnings (w) and messages (p), sent or received; they add to no total (columns level, text)."""
    kind = F.when(F.col("level").isin("warning", "error"), "w").otherwise("p")
    counted = lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("count"))
    return counted.select("kind", F.when(F.col("kind") == "w", "warnings").otherwise("messages").alias("name"), "count")
