"""Deltas and folded reverse deltas on hand-made files, and what of them is shuffled."""

from stowage.operators import contents
from stowage.plans import registry

from .conftest import SMALL


def files(spark, rows):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "id long, content binary")


def made(df):
    return sorted((r["id"], None if r["content"] is None else bytes(r["content"])) for r in df.collect())


def test_delta_finds_the_first_equal_block(spark):
    old, new = files(spark, [(1, b"aabbaab"), (2, b"xx"), (3, b"")]), files(spark, [(1, b"bbaacc"), (1 << 40, b"xx"), (2, b""), (3, b"b")])
    got = sorted((r["id"], r["block"], r["source"], r["from_block"]) for r in contents.delta(old, new, 2).collect())
    assert got == [(1, 0, "copy", 1), (1, 1, "copy", 0), (1, 2, "data", None), (3, 0, "data", None), (1 << 40, 0, "data", None)]


def test_fold_through_generations(spark):
    """A file in every delta, in one only, in none, and one that only a delta still has."""
    versions = {3: [(1, b"aabbcc"), (2, b"zz"), (3, b"same"), (5, b"")], 2: [(1, b"bbaa"), (2, b"zz"), (4, b"gone"), (5, b"")], 1: [(1, b"ccbb"), (2, b"yzz"), (4, b"onge"), (5, b"e")]}
    v = {k: files(spark, rows) for k, rows in versions.items()}
    reverse = lambda a, b: contents.with_data(contents.delta(v[a], v[b], 2), v[b], 2)
    deltas = {2: reverse(3, 2).where("id <> 2"), 1: reverse(2, 1)}
    assert made(contents.fold(v[3], deltas, 1, 2)) == [(1, b"ccbb"), (2, b"yzz"), (3, b"same"), (4, b"onge"), (5, b"e")]
    assert made(contents.fold(v[3], deltas, 2, 2)) == [(1, b"bbaa"), (2, b"zz"), (3, b"same"), (4, b"gone"), (5, b"")]
    assert made(contents.fold(v[3], deltas, 3, 2)) == sorted(versions[3])


def test_patch_without_the_block_to_copy(spark):
    steps = spark.createDataFrame([(1, 0, "copy", 7, None), (2, 1, "data", None, bytearray(b"b")), (2, 0, "copy", 0, None), (3, 0, "copy", 0, None)], "id long, block long, source string, from_block long, data binary")
    assert made(contents.patch(files(spark, [(1, b"aa"), (2, b"aa"), (4, b"dd")]), steps, 2)) == [(1, None), (2, b"aab"), (3, None)]


def test_folded_deltas_shuffle_each_content_once(spark):
    """Three contents, four tables of digests, and the last join's digests and ids."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["folded_deltas"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") <= 9
