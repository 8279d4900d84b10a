"""Path expressions: the collation of inventories, containment, components, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes in collation order: the separator first, then 0x80-0xFF, then the rest; a proper prefix sorts first.
_ORDER = "/" + "".join(map(chr, [*range(0x80, 0x100), *(c for c in range(1, 0x80) if c != 0x2F)]))
_PLACES = "".join(map(chr, range(1, len(_ORDER) + 1)))


def path_key(path: Column) -> Column:
    """Sort key of a path: the default binary order of keys is the order of inventories."""
    return F.translate(F.decode(F.encode(path, "UTF-8"), "ISO-8859-1"), _ORDER, _PLACES)


def kind_class(kind: Column) -> Column:
    """0 volume header, 1 data, 2 metadata, 3 volume footer; with the path the key of an entry."""
    return F.when(kind.isin("v", "V"), 0).when(kind.isin("m", "n"), 2).when(kind.isin("u", "U"), 3).otherwise(1)


def subdir_depth(folder: Column, path: Column) -> Column:
    """0 if path isn't folder or below it, else 1 + the number of separators in folder."""
    below = (path == folder) | path.startswith(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/")))
    return F.when(below, 1 + F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit("")))).otherwise(0)


def is_below(folder: Column, path: Column) -> Column:
    return subdir_depth(folder, path) > 0


def ancestors(path: Column) -> Column:
    """Array of the proper ancestors of an absolute path, "/" first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit("/")), inner)).otherwise(F.array(F.lit("/")))


def parent(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the last component; null where there is none."""
    name = basename(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def has_dot_component(path: Column) -> Column:
    return path.rlike(r"(^|/)\.{1,2}(/|$)")


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.rlike("^[A-Za-z]:")


def valid_client(name: Column) -> Column:
    """Names of clients: not empty, no leading dot, no separators, no trailing tilde."""
    return (F.length(name) > 0) & ~name.startswith(".") & ~name.contains("/") & ~name.contains("\\") & ~name.endswith("~")


def strip_components(path: Column, n: int) -> Column:
    """Path without its first n components; null where it has too few."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > n, F.concat(F.lit("/"), F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(1))), "/")))


def strip_first(path: Column, part: str) -> Column:
    """Path without the first occurrence of a substring, where the path is longer than it."""
    at = F.instr(path, part)
    rest = F.concat(F.substr(path, F.lit(1), at - 1), F.substr(path, at + len(part)))
    return F.when((at > 0) & (F.length(path) > len(part)), rest).otherwise(path)


def join_paths(prefix: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def swap_prefix(path: Column, old: str, new: str) -> Column:
    """Path moved from below one prefix to below another; others unchanged."""
    rest = F.regexp_replace(F.substr(path, F.lit(len(old) + 1)), "^/+", "")
    return F.when(path.startswith(old), F.concat(F.lit(new.rstrip("/") + "/"), rest)).otherwise(path)


def url_path(url: Column) -> Column:
    """Host and path of an address: without scheme, query and fragment."""
    return F.regexp_replace(url, r"^[a-z]+://|[?#].*$", "")


def restore_target(prefix: str, path: Column) -> Column:
    """Where an entry is restored below a prefix; null for a path whose dot components would leave it."""
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda d, p: F.struct((d["now"] + F.when(p == "..", -1).otherwise(1)).alias("now"), F.least(d["least"], d["now"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    return F.when(depth["least"] >= 0, join_paths(F.lit(prefix), path))


def swap_in_data_path(datapth: Column, old: str, new: str) -> Column:
    """Data path of a tree backup with its file's prefix swapped: after the leading t, the path stands as it is."""
    inner = swap_prefix(F.substr(datapth, F.lit(2)), old, new)
    return F.when(datapth.startswith("t/"), F.concat(F.lit("t"), inner)).otherwise(datapth)


def too_long(path: Column, total: int = 4096, component: int = 255) -> Column:
    return (F.octet_length(path) > total) | F.exists(F.split(path, "/"), lambda p: F.octet_length(p) > component)
