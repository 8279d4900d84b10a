"""Tables of expected values of scalar functions and rules, and invariants of the operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stowage.functions import codec, formats, paths
from stowage.operators import browse, catalog, compare, contents, rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b"), [("/some/path", "/someppath"), ("A", "a"), ("/some/path", "/some/path/"), ("/a", "/a/b"), ("/a/b", "/ab"), ("/é", "/e")])
def test_path_order(spark, a, b):
    assert one(spark, paths.path_key(F.lit(a)) < paths.path_key(F.lit(b)))


@pytest.mark.parametrize(("want", "folder", "path"), [(3, "/a/b", "/a/b/c/d"), (0, "/some/path", "/some/pathx"), (2, "/", "/a/b/c"), (3, "/bin/", "/bin/bash"), (2, "/bin", "/bin")])
def test_subdir_depth(spark, want, folder, path):
    assert one(spark, paths.subdir_depth(F.lit(folder), F.lit(path))) == want


@pytest.mark.parametrize(("dot", "absolute", "path"), [(True, False, "foo/../bar"), (False, False, "foo..bar"), (False, True, "C:/foo/bar"), (True, True, "/foo/."), (False, True, "/foo..bar")])
def test_path_checks(spark, dot, absolute, path):
    assert one(spark, paths.has_dot_component(F.lit(path))) == dot
    assert one(spark, paths.is_absolute(F.lit(path))) == absolute


@pytest.mark.parametrize(("value", "text"), [(10000, "CcQ"), (-10000, "-CcQ"), (1404621582, "BTuNMO"), (0, "A"), (2**63 - 1, "H//////////")])
def test_radix64(spark, value, text):
    assert one(spark, codec.radix64(F.lit(value).cast("long"))) == text
    assert one(spark, codec.from_radix64(F.lit(text))) == value


@pytest.mark.parametrize(("size", "block"), [(0, 64), (8192, 96), (55555555, 7456), (55555555555, 131072)])
def test_block_length(spark, size, block):
    assert one(spark, codec.block_length(F.lit(size).cast("long"))) == block


def test_attributes_round_trip(spark):
    random.seed(1)
    rows = [tuple(random.randint(-(2**40), 2**62) for _ in codec.ATTRIBUTES) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{a} long" for a in codec.ATTRIBUTES))
    back = df.withColumn("a", codec.attributes(codec.attribute_line({a: F.col(a) for a in codec.ATTRIBUTES}))).collect()
    assert all(tuple(r["a"]) == tuple(r)[:-1] for r in back)


def test_values(spark):
    cases = [
        (formats.human_bytes(F.lit(1536)), " (1.50 KB)"),
        (formats.human_bytes(F.lit(10)), ""),
        (formats.time_taken(F.lit(93784)), "01:02:03:04"),
        (formats.time_taken(F.lit(61)), "01:01"),
        (formats.interval_seconds(F.lit("2n")), 5184000),
        (formats.interval_seconds(F.lit("2x")), None),
        (formats.size_bytes(F.lit("10Mb")), 10 << 20),
        (formats.version_number(F.lit("3.2.1")), 30201),
        (formats.stamp_seconds(F.lit("0000001 1970-01-02 00:00:00")), 86400),
        (formats.stamp_seconds(F.lit("x")), 0),
        (formats.mode_string(F.lit(0o104755)), "-rwsr-xr-x"),
        (formats.mode_string(F.lit(0o041777)), "drwxrwxrwt"),
        (formats.compression_level(F.lit("gzip5")), 5),
        (formats.in_network(F.lit("10.1.2.3"), "10.1.0.0/16"), True),
        (formats.in_network(F.lit("10.2.2.3"), "10.1.0.0/16"), False),
        (codec.data_path(F.lit(65536 + 255).cast("long")), "0000/0001/00FF"),
        (codec.endfile_size(F.lit("12:ab")), 12),
        (codec.endfile_md5(F.lit("12:ab")), "ab"),
        (paths.strip_components(F.lit("/a/b/c"), 2), "/c"),
        (paths.strip_components(F.lit("/a/b"), 2), None),
        (paths.strip_first(F.lit("/a/b/a"), "/a"), "/b/a"),
    ]
    row = spark.range(1).select(*(c.alias(str(i)) for i, (c, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]


def test_name_parts(spark):
    assert tuple(one(spark, formats.name_parts(F.lit("a.b.12.3")))) == ("a.b", 12, 3)


PATHS = [("/a/x.tar.gz", 5000), ("/a/y.ost", 10), ("/b.d/z", 2000), ("/c/w.txt", 100)]


@pytest.mark.parametrize(("text", "want"), [("file_ext=gz or file_ext=ost and file_size>1k", ["/a/x.tar.gz"]), ("(file_ext=gz or file_ext=ost)", ["/a/x.tar.gz", "/a/y.ost"]), ("not file_ext=gz", ["/a/y.ost", "/b.d/z", "/c/w.txt"]), ("file_ext=ost", []), ("( file_ext=ost or", []), ("path_match=^/c and file_match=w", ["/c/w.txt"]), ("file_ext=tar.gz and file_size>=5000b", ["/a/x.tar.gz"])])
def test_logic(spark, text, want):
    df = spark.createDataFrame([(p, s, "f") for p, s in PATHS], "path string, size long, kind string")
    assert sorted(r["path"] for r in df.where(rules.excluded_by([text], F.col("path"), F.col("size"), F.col("kind"))).collect()) == want


def test_pruning(spark):
    df = spark.createDataFrame([(p, k, d) for p, k, d in [("/a", "d", 1), ("/a/b", "d", 1), ("/a/b/c", "d", 1), ("/a/b/c/f", "f", 1), ("/a/g", "f", 1), ("/a/m", "d", 2), ("/a/m/h", "f", 2)]], "path string, kind string, dev long")
    got = rules.prune_excluded(df, [("/a", True), ("/a/b", False), ("/a/b/c", True)], ~rules.included(F.col("path"), [("/a", True), ("/a/b", False), ("/a/b/c", True)]))
    assert sorted(r["path"] for r in got.collect()) == ["/a", "/a/b/c", "/a/b/c/f", "/a/g", "/a/m", "/a/m/h"]
    assert sorted(r["path"] for r in rules.same_device(df).collect()) == ["/a", "/a/b", "/a/b/c", "/a/b/c/f", "/a/g", "/a/m"]


@pytest.mark.parametrize(("keep", "linked", "n", "want"), [([4], False, 7, [4, 5, 6, 7]), ([3, 4], True, 14, [3, 6, 9, 12, 13, 14]), ([3, 4], False, 14, list(range(3, 15)))])
def test_retention(keep, linked, n, want):
    bnos = list(range(1, n + 1))
    assert catalog.survivors(bnos, [linked and b % 3 == 0 for b in bnos], keep) == want


def test_retention_is_idempotent():
    random.seed(2)
    for _ in range(50):
        bnos = sorted(random.sample(range(1, 60), 30))
        linked = [random.random() < 0.4 for _ in bnos]
        once = catalog.survivors(bnos, linked, [4, 3, 2])
        assert catalog.survivors(once, [linked[bnos.index(b)] for b in once], [4, 3, 2]) == once


def test_keeps():
    assert catalog.normal_keeps([7]) == [7] and catalog.normal_keeps([7, 4]) == [7, 5]
    with pytest.raises(ValueError):
        catalog.normal_keeps([0])


def test_timer(spark):
    df = spark.createDataFrame([("a", "2015-05-06 02:57:26"), ("b", None)], "client string, last string").withColumn("last", F.to_timestamp("last"))
    now = F.lit("2015-05-06 02:57:56").cast("timestamp")
    assert [r["due"] for r in catalog.due(df, now, 30, ["always"]).orderBy("client").collect()] == [False, True]
    assert [r["due"] for r in catalog.due(df, now, 29, ["Wed 02"]).orderBy("client").collect()] == [True, True]
    assert [r["due"] for r in catalog.due(df, now, 29, ["Thu 02"]).orderBy("client").collect()] == [False, False]


def inventory(spark, seed, n=300):
    r = random.Random(seed)
    rows = {(f"/{r.choice('abc')}/{k}", r.choice("fdlsym")): (r.randint(1, 3), r.randint(1, 3)) for k in r.sample(range(400), n)}
    return spark.createDataFrame([(p, k, m, c, 10) for (p, k), (m, c) in rows.items()], "path string, kind string, mtime long, ctime long, size long")


def test_diff_of_itself_is_empty(spark):
    a = inventory(spark, 1)
    assert compare.diff(a, a).count() == 0


def test_compare_rebuilds_the_current_inventory(spark):
    a, b = inventory(spark, 1), inventory(spark, 2)
    changes = compare.compare(b, a)
    kept = {r["path"] for r in changes.where("change <> 'deleted'").collect()}
    assert kept == {r["path"] for r in b.collect()}
    merged = compare.merge(b, a)
    assert merged.groupBy("path", paths.kind_class(F.col("kind"))).count().where("count > 1").count() == 0


@pytest.mark.parametrize(("folder", "want"), [("/path", {"aa": "d", "f": "f"}), ("", {"/": "d"}), ("/", {"path": "d", "patha": "d"}), ("/path/aa", {"file": "f"}), ("/none", {})])
def test_browse(spark, folder, want):
    df = spark.createDataFrame([("/path/aa/file", "f"), ("/path/f", "f"), ("/patha/x", "f"), ("/path/f", "m")], "path string, kind string")
    assert {r["child"]: r["kind"] for r in browse.listing(df, folder).collect()} == want


def test_rolling_delta(spark):
    r = random.Random(3)
    old = bytes(r.randrange(256) for _ in range(1000))
    got = contents.rolling_delta(spark.createDataFrame([(1, old, b"xyz" + old)], "id long, old binary, new binary"), 50).first()
    assert (got["copied"], got["literal"]) == (1000, 3)


def test_representatives_over_salted_parts(spark):
    ids = [*range(0, 5), *range(4096, 4101), *range(9000, 9003)]
    df = spark.createDataFrame([(i, "x", 1) for i in ids], "id long, content string, size long")
    got = {r["id"]: r["representative"] for r in contents.representatives(df, 4).collect()}
    want = {i: chunk[0] for chunk in itertools.batched(ids, 4) if len(chunk) > 1 for i in chunk}
    assert got == want
