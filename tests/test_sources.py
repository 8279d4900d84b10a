"""Round trips of manifests, files, configuration and the stream."""

import gzip

import pytest

from stowage.sources import config, files, manifest, sinks
from stowage.streaming import monitor

ROWS = [
    {"path": "/a/é", "kind": "f", "datapth": "0000/0000/0001", "attr": "B C D", "bytes": 7, "md5": "ab"},
    {"path": "/a/l", "kind": "l", "link": "/a/é", "attr": "B"},
    {"path": "/a/d", "kind": "d", "attr": "A"},
]


def test_manifest_round_trip(spark, tmp_path):
    data = b"".join(map(manifest.encode, ROWS))
    (tmp_path / "one").write_bytes(data)
    (tmp_path / "two.gz.bin").write_bytes(gzip.compress(data))
    got = manifest.read(spark, str(tmp_path))
    assert got.count() == 6
    rows = {r["path"]: r for r in got.where("manifest like '%one'").collect()}
    assert rows["/a/é"]["md5"] == "ab" and rows["/a/é"]["bytes"] == 7 and rows["/a/é"]["ino"] == 2 and rows["/a/é"]["nlink"] is None
    assert rows["/a/l"]["link"] == "/a/é" and rows["/a/d"]["datapth"] is None
    again = manifest.to_frames(spark.createDataFrame([(r["path"], r["kind"], r.get("link"), r.get("datapth"), r["attr"], r.get("bytes"), r.get("md5")) for r in ROWS], "path string, kind string, link string, datapth string, attr string, bytes long, md5 string"))
    assert sorted(bytes(r["native"]) for r in again.collect()) == sorted(map(manifest.encode, ROWS))


def test_torn_manifest():
    data = b"".join(map(manifest.encode, ROWS))
    with pytest.raises(ValueError):
        list(manifest.decode(data[:-3]))
    assert [r[0] for r in manifest.decode(data[:-3], strict=False)][:2] == ["/a/é", "/a/l"]


def test_scan(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/f.txt").write_text("hello")
    got = files.scan(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["size"]) for r in got] == [("f.txt", 5)]
    assert files.with_folders(files.scan(spark, str(tmp_path))).where("kind = 'd'").count() >= 2


def test_config(spark):
    text = "# c\nport = 4971\ninclude = /a\ninclude = '/b c'\nkeep := 7\n"
    got = config.parse(text)
    assert got == {"port": ["4971"], "include": ["/a", "/b c"], "keep": ["7"]}
    assert config.overlay(got, {"include": ["/z"]}, frozenset({"include"}))["include"] == ["/a", "/b c", "/z"]
    assert config.as_rows(spark, got).count() == 4
    assert config.parse("a = 1\n. more\na = 3", {"more": "a = 2\nb = 4"}.__getitem__) == {"a": ["1", "2", "3"], "b": ["4"]}
    with pytest.raises(ValueError):
        config.parse("what")


def test_stream_equals_batch(spark, small):
    batch = monitor.latest(monitor.status(spark.read.parquet(f"{small}/events.parquet")))
    stream = monitor.run_once(spark, f"{small}/events.parquet")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_merge_snapshots(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    snap = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, monitor.merge_snapshots(known, snap, ["k"]).collect())) == [(2, "c", False), (3, "d", True)]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("new", "f", "/a/é"), ("deleted", "d", "/b")], "change string, kind string, path string")
    sinks.write_journal(rows, str(tmp_path / "journal"))
    sinks.write_journal(rows.limit(1), str(tmp_path / "journal"))
    back = sinks.parse_journal(spark.read.text(str(tmp_path / "journal")))
    assert sorted(map(tuple, back.collect())) == [("deleted", "d", "/b"), ("new", "f", "/a/é"), ("new", "f", "/a/é")]
    for n in (1, 2):
        at = sinks.write_statistics(spark.createDataFrame([("f", n)], "kind string, count long"), str(tmp_path), "verify")
    assert [r["count"] for r in spark.read.json(at).collect()] == [2] and at.endswith("/verify_stats")
    sinks.append_audit(spark.createDataFrame([("t", "::1", "me", "list")], "stamp string, address string, client string, command string"), str(tmp_path / "audit"))
    assert spark.read.text(str(tmp_path / "audit")).where("client = 'me'").first()["value"] == "t ::1 me list"


def test_snapshots_and_timer(spark):
    known = spark.createDataFrame([("a", 1), ("b", 1)], "client string, x long")
    now = spark.createDataFrame([("b", 2), ("c", 2)], "client string, x long")
    assert sorted(map(tuple, monitor.merge_snapshots(known, now, ["client"]).collect())) == [("b", 2, False), ("c", 2, True)]
    seen = []
    query = monitor.recheck(spark, lambda: known, lambda df: seen.append(df.count()), 1)
    query.processAllAvailable()
    query.stop()
    assert seen and set(seen) == {2}
