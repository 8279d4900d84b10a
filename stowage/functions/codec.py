"""Encodings of inventories: radix-64 integers, attribute lines, checksums with sizes, storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of radix-64 integers, and the order of attributes in an attribute line.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ATTRIBUTES = ["dev", "ino", "mode", "nlink", "uid", "gid", "rdev", "size", "blksize", "blocks", "atime", "mtime", "ctime", "flags", "winattr", "compression", "encryption", "salt", "not_winapi"]


def radix64(number: Column) -> Column:
    """Most significant digit first, "-" before negative numbers."""
    digits = F.transform(F.sequence(F.lit(10), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftrightunsigned", F.abs(number), (k * 6).cast("int")).bitwiseAND(F.lit(63)))
    text = F.array_join(F.transform(digits, lambda d: F.substr(F.lit(ALPHABET), d.cast("int") + 1, F.lit(1))), "")
    short = F.regexp_replace(text, "^A+(?=.)", "")
    return F.concat(F.when(number < 0, "-").otherwise(""), short)


def from_radix64(text: Column) -> Column:
    """Value of a radix-64 integer; characters that are no digits are skipped."""
    value = F.aggregate(
        F.filter(F.split(text, ""), lambda c: (F.length(c) > 0) & F.lit(ALPHABET).contains(c)),
        F.lit(0).cast("long"),
        lambda a, c: F.shiftleft(a, 6).bitwiseOR((F.call_function("locate", c, F.lit(ALPHABET)) - 1).cast("long")),
    )
    return F.when(text.startswith("-"), -value).otherwise(value)


def attribute_line(row: dict[str, Column]) -> Column:
    """The attributes given (missing ones as 0) as one line in fixed order."""
    return F.concat_ws(" ", *(radix64(row.get(name, F.lit(0)).cast("long")) for name in ATTRIBUTES))


def attributes(line: Column) -> Column:
    """Struct of attributes of a line; those that a shorter line lacks are null."""
    parts = F.split(line, " ")
    return F.struct(*(from_radix64(F.get(parts, i)).alias(name) for i, name in enumerate(ATTRIBUTES)))


def endfile(size: Column, md5: Column) -> Column:
    return F.concat(size.cast("string"), F.lit(":"), md5)


def endfile_size(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def endfile_md5(text: Column) -> Column:
    return F.substring_index(text, ":", -1)


def data_path(number: Column, compressed: bool = False) -> Column:
    """Storage path of a file's number: three groups of four hexadecimal digits."""
    group = lambda k: F.lpad(F.hex(F.call_function("shiftright", number, F.lit(16 * k)).bitwiseAND(F.lit(0xFFFF))), 4, "0")
    return F.concat_ws("/", group(2), group(1), group(0) if not compressed else F.concat(group(0), F.lit(".gz")))


def data_path_number(path: Column) -> Column:
    return F.conv(F.replace(F.regexp_replace(path, r"\.gz$", ""), F.lit("/"), F.lit("")), 16, 10).cast("long")


def block_length(size: Column) -> Column:
    """Signature block of a file's size: its square root, rounded up to 16, from 64 to 131072."""
    return F.least(F.greatest((F.ceil(F.sqrt(size.cast("double")) / 16) * 16).cast("long"), F.lit(64).cast("long")), F.lit(131072).cast("long"))
