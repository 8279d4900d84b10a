"""Texts of sizes, times, modes, versions and names."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of human-readable sizes, in the order that reports print them.
UNITS = ["KB", "MB", "GB", "TB", "EB", "PB"]
#: Seconds of interval units, bytes of size units.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "n": 2592000}
BYTES = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
#: Kinds of entries by their code.
KINDS = {"f": "file", "y": "encrypted file", "d": "directory", "l": "symbolic link", "L": "hard link", "s": "special file", "m": "metadata", "n": "encrypted metadata", "v": "volume data", "V": "encrypted volume data", "u": "volume footer", "U": "encrypted volume footer", "k": "system file", "w": "warning", "p": "message"}


def human_bytes(n: Column) -> Column:
    """" (1.50 MB)" and the like; empty below 1024."""
    out = F.when(n < 1024, "")
    for k, unit in enumerate(UNITS, 1):
        text = F.format_string(" (%.2f " + unit + ")", F.bround(n / float(1024**k), 2))  # ties to even
        out = out.when(n < float(1024 ** (k + 1)), text) if k < len(UNITS) else out.otherwise(text)
    return out


def time_taken(seconds: Column) -> Column:
    """dd:hh:mm:ss without leading parts that are 0, but at least mm:ss; more digits of days where they need them."""
    s = seconds.cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tail = F.concat(two(m), F.lit(":"), two(s % 60))
    hours = F.concat(two(h), F.lit(":"), tail)
    return F.when(d > 0, F.concat(F.format_string("%02d:", d), hours)).when(h > 0, hours).otherwise(tail)


def interval_seconds(text: Column) -> Column:
    unit = F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv))
    return F.regexp_extract(text, r"^(\d+)[smhdwn]", 1).try_cast("long") * F.element_at(unit, F.nullif(F.regexp_extract(text, r"^\d+([smhdwn])", 1), F.lit("")))


def size_bytes(text: Column) -> Column:
    """Bytes of "10", "10k", "10Mb": only the first letter counts."""
    unit = F.create_map(*(F.lit(x) for kv in BYTES.items() for x in kv))
    letter = F.lower(F.regexp_extract(text, r"^\d+\s*([A-Za-z])", 1))
    return F.regexp_extract(text, r"^(\d+)", 1).try_cast("long") * F.when(letter == "", F.lit(1)).otherwise(F.element_at(unit, letter))


def stamp_seconds(text: Column) -> Column:
    """Seconds of "NNNNNNN YYYY-mm-dd HH:MM:SS[ +zzzz]"; 0 without a space or a time."""
    rest = F.regexp_replace(text, r"^\S*\s", "")
    moment = F.coalesce(F.try_to_timestamp(rest, F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(rest, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(text.contains(" "), F.coalesce(F.unix_timestamp(moment), F.lit(0))).otherwise(0)


def date_or_never(seconds: Column) -> Column:
    """Local date and time of a number of seconds; "never" for 0 or null."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "never").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))


def list_line(path: Column, kind: str = "short", link: Column | None = None, **stat: Column) -> Column:
    """Line of a listed entry: its path; "parseable", as the frame of a file; or "long", with mode, links, owners, size and time.

    A long line needs mode, nlink, uid, gid, size and mtime, and ends in " -> link" where there is one.
    """
    if kind == "short":
        return path
    if kind == "parseable":
        return F.concat(F.lit("f"), F.lpad(F.hex(F.octet_length(path).cast("long")), 4, "0"), path)
    number = lambda name: stat[name].cast("long")
    head = F.format_string("%s %2d %5d %5d %7d ", mode_string(stat["mode"]), number("nlink"), number("uid"), number("gid"), number("size"))
    line = F.concat(head, F.date_format(F.timestamp_seconds(stat["mtime"]), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), path)
    return line if link is None else F.concat(line, F.coalesce(F.concat(F.lit(" -> "), link), F.lit("")))


def stamp(bno: Column, moment: Column) -> Column:
    return F.concat(F.lpad(bno.cast("string"), 7, "0"), F.lit(" "), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))


def mode_string(mode: Column) -> Column:
    """ls-style mode: type and three groups of rwx, with set-id and sticky letters."""
    kind = F.create_map(*(F.lit(x) for kv in {0o040000: "d", 0o120000: "l", 0o020000: "c", 0o060000: "b", 0o010000: "p", 0o140000: "s"}.items() for x in kv))
    bit = lambda b: mode.bitwiseAND(F.lit(b)) != 0
    out = [F.coalesce(F.element_at(kind, mode.bitwiseAND(F.lit(0o170000)).cast("int")), F.lit("-"))]
    for shift, special, letter in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        out += [F.when(bit(4 << shift), "r").otherwise("-"), F.when(bit(2 << shift), "w").otherwise("-")]
        out.append(F.when(bit(special), F.when(bit(1 << shift), letter).otherwise(letter.upper())).otherwise(F.when(bit(1 << shift), "x").otherwise("-")))
    return F.concat(*out)


def version_number(text: Column) -> Column:
    part = F.split(text, r"\.")
    return F.get(part, 0).cast("long") * 10000 + F.get(part, 1).cast("long") * 100 + F.get(part, 2).cast("long")


def name_parts(text: Column) -> Column:
    """Struct of client, pid and bno of "client.pid.bno"; the client may hold dots."""
    pattern = r"^(.*)\.(-?\d+)\.(\d+)$"
    return F.struct(F.regexp_extract(text, pattern, 1).alias("client"), F.regexp_extract(text, pattern, 2).try_cast("long").alias("pid"), F.regexp_extract(text, pattern, 3).try_cast("long").alias("bno"))


def compression_level(text: Column) -> Column:
    return F.regexp_extract(text, r"^(?:gzip|zlib)?(\d)$", 1).try_cast("int")


def tokens(text: Column, delimiters: str = " ,") -> Column:
    return F.filter(F.split(text, "[" + delimiters + "]"), lambda t: t != "")


def short_host(text: Column) -> Column:
    return F.substring_index(text, ".", 1)


def kind_name(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), kind)


def in_network(address: Column, network: str) -> Column:
    """Whether an IPv4 address lies in a network a.b.c.d/bits."""
    base, bits = (network.split("/") + ["32"])[:2]
    number = lambda c: F.aggregate(F.split(c, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long"))
    mask = (0xFFFFFFFF << (32 - int(bits))) & 0xFFFFFFFF
    return number(address).bitwiseAND(F.lit(mask)) == number(F.lit(base)).bitwiseAND(F.lit(mask))


def allowed(address: Column, networks: list[str]) -> Column:
    """Whether an address lies in one of the networks, of either version; all do without networks. A text that is no address doesn't.

    Networks that can't be read raise ValueError where the expression is made.
    """
    if not networks:
        return F.lit(True)
    known = [ipaddress.ip_network(n.strip(), strict=False) for n in networks]
    four, six = [n for n in known if n.version == 4], [n for n in known if n.version == 6]
    out = F.lit(False)
    for n in four:
        out = out | F.coalesce(in_network(address, str(n)), F.lit(False))
    dotted = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    if not six:
        return dotted & out

    def inside(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            try:
                found = ipaddress.ip_address(text or "")
            except ValueError:
                return False
            return found.version == 6 and any(found in n for n in six)

        return texts.map(one).astype(bool)

    return F.when(dotted, out).otherwise(F.pandas_udf(inside, "boolean")(address))
