"""Inventories, backups and the like made from the driver tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STEP = "CAST(floor(({b} + doc_id % 3) / 3) AS BIGINT)"
#: Columns of an entry in generation {b}; the text runs in Spark and in DuckDB.
ENTRY = {
    "path": "concat('/', source, '/', lang, '/', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.txt.gz' WHEN 1 THEN '.txt' WHEN 2 THEN '.log' ELSE '' END)",
    "kind": "CASE WHEN {b} >= 3 AND doc_id % 17 = 0 THEN 'f' ELSE CASE doc_id % 10 WHEN 0 THEN 'd' WHEN 1 THEN 'l' WHEN 2 THEN 'L' WHEN 3 THEN 'y' WHEN 4 THEN 's' WHEN 5 THEN 'm' ELSE 'f' END END",
    "mtime": f"1700000000 + doc_id * 60 + {_STEP} * 86400",
    "ctime": f"1700000000 + doc_id * 60 + {_STEP} * 86400 + CASE WHEN doc_id % 13 = 0 THEN {{b}} ELSE 0 END",
    "size": f"n_chars + {_STEP}",
    "md5": f"md5(concat(text, CAST({_STEP} AS STRING)))",
    "dev": "doc_id % 5",
    "ino": "doc_id - doc_id % 3",
    "nlink": "1 + doc_id % 3",
    "scan_order": "doc_id",
    "mode": "CASE WHEN doc_id % 10 = 0 THEN 16384 WHEN doc_id % 10 = 1 THEN 40960 ELSE 32768 END + doc_id % 512",
}


def entries_sql(bno: int, *columns: str) -> str:
    """SELECT of one generation."""
    cols = ", ".join(f"{ENTRY[c].format(b=bno)} AS {c}" for c in (columns or ENTRY))
    return f"SELECT {bno} AS bno, {cols} FROM documents WHERE (doc_id + {bno}) % 11 <> 0"


def entries(spark: SparkSession, sf_dir: str, bno: int) -> DataFrame:
    """One generation of the inventory; columns that a plan doesn't use aren't read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"(doc_id + {bno}) % 11 <> 0")
    return docs.selectExpr(f"{bno} AS bno", *(f"{sql.format(b=bno)} AS {c}" for c, sql in ENTRY.items()))


BACKUPS_SQL = "SELECT o_custkey AS client, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bno, o_orderdate AS ts, o_orderkey FROM orders"


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select(F.col("o_custkey").alias("client"), number.cast("long").alias("bno"), F.col("o_orderdate").alias("ts"), "o_orderkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
