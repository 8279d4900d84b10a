"""Native manifests: frames of one letter, four hexadecimal digits of length, the payload and a line feed.

An entry is [t data path], r attributes, its kind with the path, for links a second frame of that
kind with the target, and [x size:md5]. Reading takes one task for each file, as frames can only be
found from the start; writing gives one file for each partition.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.codec import ATTRIBUTES, attributes

DATA, LINKS, PLAIN = "fymnvVuUk", "lL", "ds"
#: Entries that a task decodes before it hands them on.
STEP = 10_000
COLUMNS = ["path", "kind", "link", "datapth", "attr", "bytes", "md5"]


def frames(data: bytes, strict: bool = True) -> Iterator[tuple[str, str]]:
    """(letter, payload) of each frame; a torn tail ends the stream, or raises ValueError if strict."""
    at = 0
    while at < len(data):
        head = data[at : at + 5]
        try:
            size = int(head[1:5], 16)
        except ValueError:
            size = -1
        if len(head) < 5 or size < 0 or at + 5 + size >= len(data) or data[at + 5 + size] != 10:
            if strict:
                raise ValueError(f"a frame at byte {at} is torn")
            return
        yield chr(head[0]), data[at + 5 : at + 5 + size].decode("utf-8", "surrogateescape")
        at += size + 6


def decode(data: bytes, strict: bool = True) -> Iterator[tuple]:
    """Rows of COLUMNS of a manifest's bytes, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    row: dict = {}
    for letter, text in frames(data, strict):
        if letter == "t":
            yield from _whole(row)
            row = {"datapth": text}
        elif letter == "r":
            if "attr" in row or "path" in row:
                yield from _whole(row)
                row = {}
            row["attr"] = text
        elif letter == "x" and "path" in row:
            size, _, md5 = text.partition(":")
            row |= {"bytes": int(size or 0), "md5": md5}
        elif letter == "c":
            break
        elif letter in LINKS and row.get("kind") == letter and "link" not in row:
            row["link"] = text
        elif letter in DATA + LINKS + PLAIN:
            if any(part in (".", "..") for part in text.split("/")):
                raise ValueError("a path has dot components")
            row |= {"kind": letter, "path": text}
    yield from _whole(row)


def _whole(row: dict) -> Iterator[tuple]:
    if "path" in row:
        yield tuple(row.get(c) for c in COLUMNS)


def frame(letter: str, text: str) -> bytes:
    body = text.encode("utf-8", "surrogateescape")
    if len(body) > 0xFFFF:
        raise ValueError("a payload is too long")
    return b"%s%04X%s\n" % (letter.encode(), len(body), body)


def encode(row: dict) -> bytes:
    out = frame("t", row["datapth"]) if row.get("datapth") else b""
    out += frame("r", row.get("attr") or "") + frame(row["kind"], row["path"])
    if row.get("link"):
        out += frame(row["kind"], row["link"])
    if row.get("md5"):
        out += frame("x", f"{int(row.get('bytes') or 0)}:{row['md5']}")
    return out


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Entries of the manifests under a path, with attributes decoded."""

    def run(pdfs):
        for pdf in pdfs:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = decode(bytes(data), strict)
                while part := list(islice(rows, STEP)):
                    out = pd.DataFrame(part, columns=COLUMNS)
                    out["bytes"] = out["bytes"].astype("Int64")
                    yield out.assign(manifest=name)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, kind string, link string, datapth string, attr string, bytes long, md5 string, manifest string")
    return rows.withColumn("_a", attributes(F.col("attr"))).select("*", *(F.col(f"_a.{a}").alias(a) for a in ATTRIBUTES)).drop("_a", "attr")


def to_frames(entries: DataFrame) -> DataFrame:
    """A column of native bytes for each entry (columns of COLUMNS, missing ones as null)."""
    have = [F.col(c) if c in entries.columns else F.lit(None).alias(c) for c in COLUMNS]

    def run(pdfs):
        for pdf in pdfs:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            yield pd.DataFrame({"path": pdf["path"], "native": [encode(r) for r in rows]})

    return entries.select(*have).mapInPandas(run, "path string, native binary")
