"""Clients as monitors see them: permissions, groups, quota messages, nested JSON and requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.operators.rules import any_regex

#: Logs that can be asked for; fields of a browse entry in their order.
LOGS = ["manifest", "backup", "restore", "verify", "backup_stats", "restore_stats", "verify_stats"]
ENTRY_FIELDS = ["dev", "ino", "mode", "nlink", "uid", "gid", "rdev", "size", "blksize", "blocks", "atime", "ctime", "mtime"]


def permitted(clients: DataFrame, viewer: str, grants: DataFrame, pretends: bool = False) -> DataFrame:
    """Clients that a viewer may see: itself, and those that grant it (client, name); one that pretends to be another sees itself only."""
    own = F.col("client") == viewer
    if pretends:
        return clients.where(own)
    listed = grants.where(F.col("name") == viewer).select("client").distinct()
    return clients.where(own).unionByName(clients.where(~own).join(listed, "client", "left_semi"))


def in_groups(files: DataFrame, members: DataFrame, groups: list[str]) -> DataFrame:
    """Files of the clients of some groups (client, grp), with the group: only contents of one group are shared."""
    return files.join(members.where(F.col("grp").isin(groups)).select("client", "grp").distinct(), "client")


def shared_contents(files: DataFrame) -> DataFrame:
    """grp, size, md5 and number of the files that share a content within a group (columns grp, content, size); contents are hashed before the shuffle."""
    return files.where("size > 0").groupBy("grp", "size", F.md5("content").alias("md5")).agg(F.count("*").alias("files")).where("files > 1")


def selected(clients: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Clients (column client, text) but for those that an exclude expression matches whole and no include expression does."""
    match = lambda names: any_regex(F.col("client"), [f"^(?:{n})$" for n in names or []], empty=False)
    return clients.where(~match(exclude) | match(include))


def parallel(children: DataFrame, limit: int) -> DataFrame:
    """running, and whether one more child may start: children in scanning or backup under the limit, 0 is none (column phase)."""
    busy = F.sum(F.col("phase").isin("scanning", "backup").cast("long"))
    running = children.agg(F.coalesce(busy, F.lit(0)).alias("running"))
    return running.withColumn("free", F.lit(limit == 0) | (F.col("running") < limit))


def last_warnings(logs: DataFrame) -> DataFrame:
    """client, line and text of the warnings in the log of each client's current backup (columns client, bno, line, text)."""
    current = logs.groupBy("client").agg(F.max("bno").alias("bno"))
    return logs.where(F.col("text").contains("WARNING")).join(current, ["client", "bno"], "left_semi").select("client", "line", "text")


def log_counts(logs: DataFrame, patterns: list[str]) -> DataFrame:
    """log, n and hits: the lines of each log, and those in which one of the patterns is found (columns log, text)."""
    hit = any_regex(F.col("text"), patterns, empty=False).cast("int")
    return logs.groupBy("log").agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("hits"))


def last_lines(logs: DataFrame) -> DataFrame:
    """log, line and text of the last line of each log."""
    return logs.groupBy("log").agg(F.max_by(F.struct("line", "text"), "line").alias("r")).select("log", "r.*")


def over_quota(logs: DataFrame) -> DataFrame:
    """client, estimated and quota by the last line of each client's latest log that speaks of a quota (columns client, bno, line, text)."""
    last = logs.groupBy("client").agg(F.max("bno").alias("bno"))
    said = logs.join(last, ["client", "bno"]).where(F.lower("text").contains("quota"))
    line = said.groupBy("client").agg(F.max_by("text", "line").alias("text"))
    number = lambda n: F.regexp_extract("text", r"(\d+)\D+(\d+)", n).try_cast("long")
    return line.select("client", number(1).alias("estimated"), number(2).alias("quota"))


def client_json(clients: DataFrame, labels: DataFrame, running: DataFrame, backups: DataFrame) -> DataFrame:
    """client and JSON of its name, labels, run status, children and backups, newest first.

    Columns: client; client, label; client, pid, phase (one row for each running child); client,
    bno, ts, flags. Labels and children of a client are few, its backups one list.
    """
    tags = labels.groupBy("client").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    kids = running.groupBy("client").agg(F.sort_array(F.collect_list(F.struct("pid", "phase"))).alias("children"))
    entry = F.struct(F.col("bno").alias("number"), F.unix_timestamp("ts").alias("timestamp"), "flags")
    kept = backups.groupBy("client").agg(F.sort_array(F.collect_list(entry), asc=False).alias("backups"))
    joined = clients.select("client").join(tags, "client", "left").join(kids, "client", "left").join(kept, "client", "left")
    none = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
    fields = [
        F.col("client").cast("string").alias("name"), none("labels", "array<string>"),
        F.when(F.col("children").isNull(), "idle").otherwise("running").alias("run_status"), F.lit(1).alias("protocol"), "children",
        none("backups", "array<struct<number:bigint,timestamp:bigint,flags:array<string>>>"),
    ]
    return joined.select("client", F.to_json(F.struct(*fields)).alias("json"))


def backup_json(backups: DataFrame, logs: DataFrame, name: str | None = None, lines: DataFrame | None = None) -> DataFrame:
    """client, bno and JSON of one backup: number, timestamp, flags, which logs there are, and the lines of one of them.

    Columns: client, bno, ts, flags; client, bno, name; client, bno, line, text (of the log that is
    asked for). Without any log the field logs is left out.
    """
    have = logs.where(F.col("name").isin(LOGS[1:])).groupBy("client", "bno").agg(F.array_sort(F.collect_set("name")).alias("list"))
    joined = backups.join(have, ["client", "bno"], "left")
    parts = [F.col("list").alias("list")]
    if name and lines is not None:
        text = lines.groupBy("client", "bno").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("_lines"))
        joined = joined.join(text, ["client", "bno"], "left")
        parts.append(F.when(F.array_contains("list", name), F.coalesce("_lines", F.array().cast("array<string>"))).alias(name))
    found = F.when(F.col("list").isNotNull(), F.struct(*parts)).alias("logs")
    return joined.select("client", "bno", F.to_json(F.struct(F.col("bno").alias("number"), F.unix_timestamp("ts").alias("timestamp"), "flags", found)).alias("json"))


def entry_json(name: Column, link: Column, stat: dict[str, Column]) -> Column:
    """JSON of a browsed entry: name, link ("" without one) and its attributes; missing ones are 0."""
    return F.to_json(F.struct(name.alias("name"), F.coalesce(link, F.lit("")).alias("link"), *(stat.get(f, F.lit(0)).cast("long").alias(f) for f in ENTRY_FIELDS)))


@dataclass(frozen=True)
class Request:
    """A monitor's request: "c:name:b:number:l:log:p:path" or "j:command"."""

    command: str | None = None
    client: str | None = None
    backup: str | None = None
    log: str | None = None
    browse: str | None = None


def parse_request(text: str) -> Request:
    """Fields by their letter, in any order; unknown ones are skipped. The path comes last and may hold colons."""
    letters = {"j": "command", "c": "client", "b": "backup", "l": "log"}
    found: dict[str, str] = {}
    rest = text
    while rest:
        token, _, rest = rest.lstrip(":").partition(":")
        if token == "p":
            found["browse"] = rest
            break
        if token in letters and rest.strip(":"):
            value, _, rest = rest.lstrip(":").partition(":")
            found[letters[token]] = value
    return Request(**found)


def answer(request: Request, clients: DataFrame, backups: DataFrame, logs: DataFrame) -> DataFrame:
    """Rows (client, bno) that a request names, or one row with a warning; columns client, bno, warning."""
    spark = clients.sparkSession
    warn = lambda text: spark.createDataFrame([(None, None, text)], "client string, bno long, warning string")
    if request.command:
        return warn({f"{w}-{s}": f"{w.replace('-', ' ').capitalize()} {s}" for w in ("pretty-print", "response-markers") for s in ("on", "off")}.get(request.command, "Unknown command"))
    rows = backups.select(F.col("client").cast("string").alias("client"), "bno", F.lit(None).cast("string").alias("warning"))
    if request.client:
        rows = rows.where(F.col("client") == request.client)
        if not clients.where(F.col("client").cast("string") == request.client).limit(1).count():
            return warn(f"Could not find client: {request.client}")
        if request.backup:
            number = int("0" + request.backup[: len(request.backup) - len(request.backup.lstrip("0123456789"))])
            if not number:
                return warn("Could not get backup number")
            rows = rows.where(F.col("bno") == number)
            if not rows.limit(1).count():
                return warn("Backup not found")
    log = "manifest" if request.browse is not None else request.log
    if log and log not in LOGS:
        return warn("File not supported")
    if log and log != "manifest":
        rows = rows.join(logs.where(F.col("name") == log).select(F.col("client").cast("string").alias("client"), "bno").distinct(), ["client", "bno"], "left_semi")
    return rows
