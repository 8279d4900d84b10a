"""Browsing of inventories and nested JSON of clients, backups and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.paths import path_key

#: Flags of a backup in the order of its JSON, and fields of counters.
FLAGS = ["hardlinked", "deletable", "working", "finishing", "current", "manifest"]
FIELDS = ["new", "changed", "same", "deleted", "scanned"]
HIDDEN = ["m", "n", "v", "V", "u", "U"]


def children(entries: DataFrame, folder: str) -> DataFrame:
    """child, kind and entries below it, of a folder: "." is the folder itself, "*" lists every path, "" the roots.

    A child that only deeper entries name is a directory. Children are grouped with partial
    aggregation, so a folder with very many entries needs no sort.
    """
    shown = entries.where(~F.col("kind").isin(HIDDEN))
    path = F.col("path")
    if folder == "*":
        return shown.select(path.alias("child"), "kind", F.lit(1).cast("long").alias("entries"))
    base = folder.rstrip("/")
    if folder == "":
        rest, here = F.regexp_replace(path, "^/+", ""), F.lit(False)
        shown = shown.withColumn("_rest", F.when(path.startswith("/"), F.lit("/")).otherwise(rest))
        return shown.groupBy(F.substring_index("_rest", "/", 1).alias("child")).agg(F.lit("d").alias("kind"), F.count("*").alias("entries")).withColumn("child", F.when(F.col("child") == "", "/").otherwise(F.col("child")))
    here = path == (base or "/")
    below = shown.where(here | path.startswith(base + "/"))
    rest = F.substr(path, F.lit(len(base) + 2))
    child = F.when(here, ".").otherwise(F.substring_index(rest, "/", 1))
    deeper = ~here & rest.contains("/")
    return below.select(child.alias("child"), "kind", deeper.alias("deeper")).groupBy("child").agg(F.coalesce(F.min(F.when(~F.col("deeper"), F.col("kind"))), F.lit("d")).alias("kind"), F.count("*").alias("entries"))


def listing(entries: DataFrame, folder: str) -> DataFrame:
    """Children in the order of inventories."""
    return children(entries, folder).orderBy(path_key(F.col("child")))


def flag_array(backup: dict[str, Column]) -> Column:
    """Names of the flags that are set, in fixed order."""
    return F.filter(F.array(*(F.when(backup[f], F.lit(f)) for f in FLAGS if f in backup)), lambda x: x.isNotNull())


def catalog_json(backups: DataFrame) -> DataFrame:
    """client and JSON of its backups, newest first (columns client, bno, ts, flags)."""
    entry = F.struct(F.col("bno").alias("number"), F.unix_timestamp("ts").alias("timestamp"), "flags")
    grouped = backups.groupBy("client").agg(F.sort_array(F.collect_list(entry), asc=False).alias("backups"))
    return grouped.select("client", F.to_json(F.struct(F.col("client").cast("string").alias("name"), "backups")).alias("json"))


def counters_json(counts: DataFrame) -> DataFrame:
    """kind and JSON of its counters; rows of zeros only are left out."""
    return counts.where(" + ".join(f"`{f}`" for f in FIELDS) + " > 0").select("kind", F.to_json(F.struct("kind", *FIELDS)).alias("json"))


def single_counters_json(counts: DataFrame) -> DataFrame:
    """kind and JSON of counters of one number (columns name, kind, count): warnings, messages, bytes; without those of 0."""
    return counts.where("count > 0").select("kind", F.to_json(F.struct("name", F.col("kind").alias("type"), "count")).alias("json"))


def parse_catalog(lines: DataFrame, column: str = "json") -> DataFrame:
    """client, number, timestamp and flags of each backup in the JSON of ``catalog_json``."""
    schema = "name string, backups array<struct<number:bigint,timestamp:bigint,flags:array<string>>>"
    return lines.select(F.from_json(column, schema).alias("c")).select(F.col("c.name").alias("client"), F.explode("c.backups").alias("b")).select("client", "b.*")
