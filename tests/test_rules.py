"""Rules by hand-made tables: comparison, retention, requests, globs, life cycle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.operators import catalog, clients, compare, contents, lifecycle, rules
from stowage.sources import files

#: (kind now, kind before, mtime moved, ctime moved) and the change that follows.
CHANGES = [
    ("f", None, 0, 0, "new"), (None, "f", 0, 0, "deleted"), ("f", "f", 0, 0, "same"), ("f", "f", 0, 1, "same"), ("f", "f", 1, 1, "changed"),
    ("f", "y", 0, 0, "new"), ("y", "y", 0, 0, "same"), ("y", "y", 0, 1, "same"), ("y", "y", 1, 1, "new"), ("d", "d", 1, 1, "changed"),
    ("l", "l", 1, 0, "changed"), ("m", "m", 0, 1, "new"), ("m", "m", 1, 1, "new"), ("m", "m", 0, 0, "same"), ("n", "n", 0, 1, "new"),
    ("n", "n", 1, 1, "new"), ("k", "k", 0, 1, "new"), ("k", "k", 1, 1, "new"), ("v", "v", 0, 1, "new"), ("v", "v", 1, 0, "new"),
    ("V", "V", 1, 1, "new"), ("u", "u", 0, 1, "new"), ("U", "U", 1, 1, "new"), ("s", "s", 1, 1, "changed"), ("d", "f", 0, 0, "new"),
]


def sides(spark, rows, **more):
    now = [(f"/{i}", k, 10 + m, 20 + c, 5) for i, (k, _, m, c, *_) in enumerate(rows) if k]
    old = [(f"/{i}", k, 10, 20, 5) for i, (_, k, *_) in enumerate(rows) if k]
    schema = "path string, kind string, mtime long, ctime long, size long"
    return spark.createDataFrame(now, schema), spark.createDataFrame(old, schema)


def test_every_change(spark):
    got = {r["path"]: r["change"] for r in compare.compare(*sides(spark, CHANGES)).collect()}
    assert [got[f"/{i}"] for i in range(len(CHANGES))] == [c[-1] for c in CHANGES]


def test_change_options(spark):
    now, old = sides(spark, [("f", "f", 1, 1), ("y", "y", 0, 0), ("f", "f", 0, 1), ("k", "k", 0, 0)])
    change = lambda **o: [r["change"] for r in compare.compare(now, old, **o).orderBy("path").collect()]
    assert change() == ["changed", "same", "same", "same"]
    assert change(delta=False) == ["new", "same", "same", "same"]
    assert change(windows=True) == ["changed", "same", "changed", "same"]
    assert change(max_size=4) == ["new", "same", "same", "same"] and change(max_size=5) == change()
    scheme = lambda df, n: df.withColumn("encryption", F.lit(n))
    encrypted = lambda n: [r["change"] for r in compare.compare(scheme(now, 2), scheme(old, n), encryption=True).orderBy("path").collect()]
    assert encrypted(1) == ["changed", "new", "same", "same"] and encrypted(2) == change()
    packed = lambda df, n, p: df.withColumn("compression", F.lit(n)).withColumn("datapth", F.lit(p))
    levels = lambda a, b, p: compare.compare(packed(now, a, None), packed(old, b, p), compression=True).orderBy("path").first()["change"]
    assert [levels(9, 0, "x"), levels(9, -1, "x.gz"), levels(0, -1, "x.gz"), levels(0, 0, "x.gz")] == ["new", "changed", "new", "changed"]


def test_relinked_master(spark):
    schema = "path string, kind string, mtime long, ctime long, size long, dev long, ino long, link string, datapth string"
    old = spark.createDataFrame([("/a", "f", 1, 1, 1, 1, 7, None, "t/1"), ("/b", "L", 1, 1, 1, 1, 7, "/a", None), ("/c", "L", 1, 1, 1, 1, 8, "/gone", None)], schema)
    now = spark.createDataFrame([("/b", "f", 1, 9, 1, 1, 7, None, None), ("/c", "f", 1, 9, 1, 1, 8, None, None)], schema)
    got = {r["path"]: (r["change"], r["relink"]) for r in compare.compare(now, old, relink=True).collect()}
    assert got == {"/a": ("deleted", None), "/b": ("same", "t/1"), "/c": ("new", None)}


@pytest.mark.parametrize(
    ("keep", "start", "left"),
    [([4], 7, [4, 5, 6, 7]), ([3, 4], 14, [3, 6, 9, 12, 13, 14])],
)
def test_retention_by_fixed_lists(spark, keep, start, left):
    rows = [(c, b, len(keep) > 1 and b % keep[0] == 0, "x") for c in ("one", "two") for b in range(1, start + 1)]
    got = catalog.retain(spark.createDataFrame(rows, "client string, bno long, hardlinked boolean, more string"), keep)
    assert sorted((r["client"], r["bno"], r["more"]) for r in got.collect()) == [(c, b, "x") for c in ("one", "two") for b in left]


def test_rolling_delta_by_brute_force(spark):
    r = np.random.default_rng(3)
    pairs = []
    for i in range(30):
        old = bytes(r.integers(0, 3, int(r.integers(0, 200)), dtype=np.uint8))
        at = int(r.integers(0, len(old) + 1))
        pairs.append((i, old, old[:at] + bytes(r.integers(0, 3, 5, dtype=np.uint8)) + old[at:]))

    def one(old, new, block):
        known = {old[i : i + block] for i in range(0, len(old) - block + 1, block)}
        i = copied = 0
        while i + block <= len(new):
            hit = new[i : i + block] in known
            copied += block * hit
            i += block if hit else 1
        return copied, len(new) - copied

    df = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, a, b in pairs], "id long, old binary, new binary")
    got = {x["id"]: (x["copied"], x["literal"]) for x in contents.rolling_delta(df, 8).collect()}
    assert got == {i: one(a, b, 8) for i, a, b in pairs}


def test_requests():
    parse = clients.parse_request
    assert parse("c:me:b:3:l:backup") == clients.Request(client="me", backup="3", log="backup")
    assert parse("c:me:p:/a:b/c") == clients.Request(client="me", browse="/a:b/c")
    assert parse("j:pretty-print-on") == clients.Request(command="pretty-print-on")
    assert parse("x:y:c:me") == clients.Request(client="me") and parse("") == clients.Request()


def test_globs(spark):
    paths = ["/a/x.txt", "/a/.x.txt", "/a/b/x.txt", "/b/x.txt", "/a/y.txt", "/a/[x]"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = lambda *g: sorted(r["path"] for r in rules.globbed(df, list(g)).collect())
    assert found("/a/*.txt") == ["/a/x.txt", "/a/y.txt"] and found("/[ab]/[!y]*") == ["/a/[x]", "/a/x.txt", "/b/x.txt"] and found("/?/y.*", "/b/x.txt") == ["/a/y.txt", "/b/x.txt"]


def test_broken_patterns_never_match(spark):
    df = spark.createDataFrame([("/a",)], "path string")
    assert df.where(rules.any_regex(F.col("path"), ["(", "b"])).count() == 0 and df.where(rules.any_regex(F.col("path"), ["(", "a"])).count() == 1


def test_deletion_moves_the_current_backup(spark):
    rows = [("one", 1, "0000001 x", True), ("one", 2, "0000002 x", True), ("two", 1, "0000001 x", True), ("two", 2, "0000002 x", False), ("three", 1, "0000001 x", True)]
    df = spark.createDataFrame(rows, "client string, bno long, stamp string, deletable boolean")
    got = {(r["client"], r["bno"]): (r["state"], r["is_current"]) for r in lifecycle.delete_one(df, "0000002 x").collect()}
    assert got == {("one", 1): ("kept", True), ("one", 2): ("deleted", False), ("two", 1): ("kept", False), ("two", 2): ("refused", True), ("three", 1): ("kept", True)}
    assert lifecycle.delete_one(df, "0").where("state <> 'kept'").count() == 0


def test_windows_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert files.scan(spark, str(tmp_path), "*.txt").count() == 1
    left = contents.not_in_target(spark.createDataFrame([("/a", "f"), ("/b", "f"), ("/d", "d")], "path string, kind string"), spark.createDataFrame([("/a",), ("/d",)], "path string"))
    assert sorted(r["path"] for r in left.collect()) == ["/b", "/d"]


def test_ordering_and_visibility(spark):
    df = spark.createDataFrame([("/d", "d"), ("/d/f", "f"), ("/e", "f")], "path string, kind string")
    assert [r["path"] for r in contents.restore_order(df).collect()] == ["/d/f", "/d", "/e"]
    known = spark.createDataFrame([("one",), ("two",), ("three",)], "client string")
    grants = spark.createDataFrame([("two", "one")], "client string, name string")
    assert {r["client"] for r in clients.permitted(known, "one", grants).collect()} == {"one", "two"}
    assert {r["client"] for r in clients.permitted(known, "one", grants, pretends=True).collect()} == {"one"}


def test_numbers_within_a_hot_group(spark):
    rows = [("hot" if i % 10 else f"c{i}", (i * 7919) % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "kind string, x long").repartition(5)
    got = {(r["kind"], r["x"]): r["n"] for r in compare.numbered(df, ["kind"], [F.col("x")]).collect()}
    want = {}
    for kind in {k for k, _ in rows}:
        want |= {(kind, x): n for n, x in enumerate(sorted(x for k, x in rows if k == kind), 1)}
    assert got == want


def test_report_lines(spark):
    counts = spark.createDataFrame([("f", 1, 2, 3, 4, 6), ("d", 0, 0, 0, 5, 0)], "kind string, new long, changed long, same long, deleted long, scanned long")
    got = compare.report_lines(compare.totals(counts)).orderBy("kind").collect()
    assert [r["kind"] for r in got] == ["Y", "Z", "f"] and got[2]["line"].split() == ["file:", "1", "2", "3", "4", "6", "6"]


def test_settings_sent(spark):
    from stowage.sources import config

    settings = {"include": ["/a", "/b c"], "port": ["1"], "secret": ["x"]}
    sent = config.lines(settings, ["include", "port"])
    assert sent == ["include = /a", "include = /b c", "port = 1"] and config.from_lines([*sent, "secret = y"], ["include", "port"]) == {"include": ["/a", "/b c"], "port": ["1"]}


def test_a_path_met_twice_is_one_entry(spark):
    df = spark.createDataFrame([("/a", "f", 1, 1, 2, 5), ("/a", "f", 1, 1, 2, 1), ("/b", "f", 1, 1, 2, 3)], "path string, kind string, dev long, ino long, nlink long, scan_order long")
    got = {r["path"]: (r["kind"], r["link"]) for r in contents.hard_links(df.withColumn("link", F.lit(None).cast("string"))).collect()}
    assert got == {"/a": ("f", None), "/b": ("L", "/a")}
