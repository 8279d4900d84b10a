"""Include and exclude rules, compiled into one Column each, and the pruning of directory descents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.kinds import FILE_SYSTEMS
from stowage.functions.paths import ancestors, basename, extension, subdir_depth

_CLASSES = {"[:alpha:]": r"\p{Alpha}", "[:digit:]": r"\d", "[:alnum:]": r"\p{Alnum}", "[:upper:]": r"\p{Upper}", "[:lower:]": r"\p{Lower}", "[:space:]": r"\s", "[:punct:]": r"\p{Punct}"}


def java_pattern(posix: str) -> str:
    """A POSIX extended expression in Java's dialect, as far as bracket classes and word borders go."""
    for name, java in _CLASSES.items():
        posix = posix.replace(name, java)
    return posix.replace(r"\<", r"\b").replace(r"\>", r"\b")


def any_regex(path: Column, patterns: list[str], ignore_case: bool = False, empty: bool = True) -> Column:
    """Whether one of the patterns is found; ``empty`` without patterns. A pattern that isn't one never matches."""
    out = F.lit(empty) if not patterns else F.lit(False)
    for p in map(java_pattern, patterns):
        if _valid(p):
            out = out | path.rlike(("(?i)" if ignore_case else "") + p)
    return out


def included(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Flag of the longest rule that path is in or below; of equally long ones the last in order; False without any."""
    best = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("ord"), F.lit(False).alias("flag"))
    for i, (folder, flag) in enumerate(sorted(rules, key=lambda r: r[0])):
        depth = subdir_depth(F.lit(folder), path)
        best = F.when((depth > 0) & (depth >= best["depth"]), F.struct(depth.alias("depth"), F.lit(i).alias("ord"), F.lit(flag).alias("flag"))).otherwise(best)
    return best["flag"]


def extension_in(path: Column, names: list[str]) -> Column:
    """Whether the last extension is one of the names; False where there is none."""
    return F.coalesce(extension(path).isin([n.lower() for n in names]), F.lit(False))


def size_between(kind: Column, size: Column, least: int = 0, most: int = 0) -> Column:
    """Bounds for files, inclusive, 0 is off; other kinds pass."""
    ok = F.lit(True)
    if least:
        ok = ok & (size >= least)
    if most:
        ok = ok & (size <= most)
    return (~kind.isin("f", "y")) | ok


def compression_for(path: Column, names: list[str], level: int) -> Column:
    return F.when(extension_in(path, names), 0).otherwise(level)


def prefix_match(path: Column, prefixes: list[str]) -> Column:
    """Plain string prefixes, whatever follows; all paths match no prefixes."""
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def _term(token: str, path: Column, size: Column) -> Column:
    if m := re.fullmatch(r"file_ext=(.*)", token):
        return F.lower(path).endswith("." + m[1].lower())
    if m := re.fullmatch(r"path_match=(.*)", token):
        return path.rlike(java_pattern(m[1]))
    if m := re.fullmatch(r"file_match=(.*)", token):
        return basename(path).rlike(java_pattern(m[1]))
    if m := re.fullmatch(r"file_size(<=|>=|<|>|=)(\d+)([bkmg]?).*", token, re.I):
        n = int(m[2]) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[m[3].lower()]
        return {"<": size < n, ">": size > n, "<=": size <= n, ">=": size >= n, "=": size == n}[m[1]]
    return F.lit(False)


def _split(text: str) -> list[str]:
    """Tokens between spaces outside quotes; parentheses are tokens of their own."""
    found = re.findall(r"\(|\)|(?:\\.|\"[^\"]*\"|'[^']*'|[^\s()\"'])+", text)
    return [re.sub(r"\\(.)|[\"']", lambda m: m[1] or "", t) for t in found]


def logic(text: str, path: Column, size: Column, default: bool = False) -> Column:
    """A rule of terms with not, and, or and parentheses, from left to right without precedence.

    A rule of one term, with unbalanced parentheses or of another shape counts as ``default``.
    """
    tokens = _split(text)
    if len(tokens) < 2:
        return F.lit(default)

    def flat(items: list) -> Column | None:
        done: list = []
        negate = False
        for item in items:
            if isinstance(item, str) and item.startswith("not"):
                negate = not negate
                continue
            if isinstance(item, str) and not item.startswith(("and", "or")):
                item = _term(item, path, size)
            if isinstance(item, Column) and negate:
                item, negate = ~item, False
            done.append(item)
        if negate or len(done) % 2 == 0 or not isinstance(done[0], Column):
            return None
        out = done[0]
        for op, right in zip(done[1::2], done[2::2], strict=True):
            if not isinstance(op, str) or not isinstance(right, Column):
                return None
            out = out & right if op.startswith("and") else out | right
        return out

    stack: list[list] = [[]]
    for token in tokens:
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1 or (inner := flat(stack.pop())) is None:
                return F.lit(default)
            stack[-1].append(inner)
        else:
            stack[-1].append(token)
    out = flat(stack[0]) if len(stack) == 1 else None
    return F.lit(default) if out is None else out


def excluded_by(texts: list[str], path: Column, size: Column, kind: Column) -> Column:
    """Files that one of the rules names."""
    out = F.lit(False)
    for text in texts:
        out = out | logic(text, path, size)
    return kind.isin("f", "y") & out


def prune_marked(entries: DataFrame, markers: list[str]) -> DataFrame:
    """Entries without the contents of directories that hold a marker file; the directories stay."""
    marked = entries.where(basename(F.col("path")).isin(markers)).select(F.regexp_replace("path", "/[^/]*$", "").alias("_dir")).distinct()
    return below_none(entries, marked)


def below_none(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries with no ancestor among folders (column _dir). Each row's ancestors join by equality."""
    rows = entries.select("path", F.explode(ancestors(F.col("path"))).alias("_dir"))
    cut_off = rows.join(folders, "_dir", "left_semi").select("path").distinct()
    return entries.join(cut_off, "path", "left_anti")


def prune_excluded(entries: DataFrame, rules: list[tuple[str, bool]], excluded: Column) -> DataFrame:
    """Descent as a scan does it: nothing below an excluded directory, but for folders that an include rule names below it."""
    path = F.col("path")
    folders = entries.where(excluded & (F.col("kind") == "d")).select(path.alias("_dir")).distinct()
    kept = below_none(entries.where(~excluded), folders)
    again = F.lit(False)
    for folder, flag in rules:
        if flag:
            again = again | (subdir_depth(F.lit(folder), path) > 0)
    return kept.unionByName(entries.where(again & ~excluded & included(path, rules)).join(kept.select("path").distinct(), "path", "left_anti"))


def same_device(entries: DataFrame) -> DataFrame:
    """Entries whose device is that of all their ancestors in the inventory; a mount point itself stays."""
    path = F.col("path")
    folder = entries.where("kind = 'd'").select(path.alias("_parent"), F.col("dev").alias("_dev"))
    parent = F.when(F.instr(F.substr(path, F.lit(2)), "/") == 0, F.lit("/")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    mounts = entries.withColumn("_parent", parent).join(folder, "_parent").where("dev <> _dev and kind = 'd'").select(path.alias("_dir")).distinct()
    return below_none(entries, mounts)


def _valid(pattern: str) -> bool:
    """Whether Java reads a pattern; a Spark session must be up."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    try:
        SparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def descended(entries: DataFrame, patterns: list[str], ignore_case: bool = False) -> DataFrame:
    """Entries that one of the patterns finds and a scan reaches: it doesn't go below a folder that none finds. All without patterns."""
    found = any_regex(F.col("path"), patterns, ignore_case)
    closed = entries.where(~found & (F.col("kind") == "d")).select(F.col("path").alias("_dir")).distinct()
    return below_none(entries.where(found), closed)


def without_file_systems(entries: DataFrame, names: list[str]) -> DataFrame:
    """Entries on other file systems than these, by name or as 0x... (column fs, a magic number): what is mounted there isn't descended into, its folder stays."""
    numbers = [int(n, 16) if n.lower().startswith("0x") else FILE_SYSTEMS.get(n, 0) for n in names]
    there = F.col("fs").isin(numbers)
    up = F.when(F.instr(F.substr("path", F.lit(2)), "/") == 0, F.lit("/")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    parents = entries.where("kind = 'd'").select(F.col("path").alias("_parent"), F.col("fs").alias("_fs"))
    mounts = entries.where(there & (F.col("kind") == "d")).withColumn("_parent", up).join(parents, "_parent", "left").where("_fs is null or fs <> _fs").select(F.col("path").alias("_dir")).distinct()
    return below_none(entries, mounts)


def start_folders(includes: DataFrame) -> DataFrame:
    """path, is_start and copies of each included path: the others lie below a start and are only crossed into. copies over 1 is an error of the rules."""
    rows = includes.groupBy("path").agg(F.count("*").alias("copies"))
    above = rows.select("path", F.explode(ancestors(F.col("path"))).alias("_up")).where("path <> _up")
    nested = above.join(rows.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct().withColumn("_nested", F.lit(True))
    return rows.join(nested, "path", "left").select("path", F.col("_nested").isNull().alias("is_start"), "copies")


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """path and copies of each path that stands in the rules more than once with one flag."""
    return rules.groupBy("path", "flag").agg(F.count("*").alias("copies")).where("copies > 1").select("path", "copies").distinct()


def glob_pattern(glob: str) -> str:
    """A shell pattern as an anchored expression: *, ? and brackets don't cross separators or match a leading dot of a name."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        lead = r"(?!\.)" if i == 0 or glob[i - 1] == "/" else ""
        end = glob.find("]", i + 2)
        if c == "*":
            out.append(lead + "[^/]*")
        elif c == "?":
            out.append(lead + "[^/]")
        elif c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(lead + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def globbed(entries: DataFrame, globs: list[str]) -> DataFrame:
    """Distinct paths that one of the shell patterns names."""
    return entries.where(any_regex(F.col("path"), [glob_pattern(g) for g in globs], empty=False)).select("path").distinct()


def by_extension(entries: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, top: list[str] | None = None) -> DataFrame:
    """Entries that a scan with lists of extensions emits.

    With an include list names without an extension go, with an exclude list alone they stay. Folders
    are held to the rules as well, but are descended into whatever they say; the top folders are exempt.
    """
    path = F.col("path")
    keep = F.lit(True)
    if include:
        keep = keep & extension_in(path, include)
    if exclude:
        keep = keep & ~extension_in(path, exclude)
    return entries.where(keep | (path.isin(top) if top else F.lit(False)))


def wanted(path: Column, kind: Column, listed: Column, prefixes: list[str], patterns: list[str], windows: bool = False) -> Column:
    """Whether a restore takes an entry: in the list given, below an include of the server and found by a pattern; volume data only for Windows."""
    out = listed & prefix_match(path, prefixes) & any_regex(path, patterns)
    return out if windows else out & ~kind.isin("v", "V", "u", "U")
