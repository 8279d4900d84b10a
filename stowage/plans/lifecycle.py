"""Queries over kinds, life cycle, clients and rules, with their SQL twins; the twins follow the rules' own words, not the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import codec, formats, kinds
from stowage.operators import browse, catalog, clients, compare, contents, lifecycle, rules
from stowage.plans.registry import _B, _bytes, _inv, _joined, _rwx, compare_rows, query
from stowage.sources import sinks
from stowage.plans.views import backups, entries, entries_sql, table

_TYPES = ["regular", "raw", "fifo", "directory", "symlink", "hardlink", "special", "nostat", "noopen", "other"]
_TYPE = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# Kinds and fixed tables


@query(f"""WITH d AS (SELECT doc_id, {_TYPE} AS t FROM documents) SELECT doc_id, CASE WHEN t IN ('regular','raw','fifo') THEN 'y' WHEN t = 'directory' THEN 'd' WHEN t = 'symlink' THEN 'l' WHEN t = 'hardlink' THEN 'L' WHEN t = 'special' THEN 's' END AS kind,
  CASE t WHEN 'nostat' THEN 'Err: Could not stat: /a' WHEN 'noopen' THEN 'Err: Could not open directory: /a' WHEN 'other' THEN 'Err: Unknown file type other: /a' END AS warning FROM d""")
def scan_kinds(spark, sf_dir):
    t = F.expr(_TYPE)
    return _docs(spark, sf_dir).select("doc_id", kinds.entry_kind(t, encrypted=True).alias("kind"), kinds.type_warning(t, F.lit("/a")).alias("warning"))


_SPECIAL = "CASE doc_id % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'fifo' WHEN 2 THEN 'symlink' WHEN 3 THEN 'socket' ELSE 'regular' END AS t, concat('/dev/', CAST(doc_id % 7 AS STRING)) AS path"


@query(f"SELECT doc_id, CASE WHEN t IN ('block','symlink') AND path IN ('/dev/1','/dev/2') THEN 'raw' WHEN t = 'fifo' AND path = '/dev/3' THEN 'fifo' WHEN t IN ('block','fifo','socket') THEN 'special' ELSE t END AS scanned FROM (SELECT doc_id, {_SPECIAL} FROM documents)")
def special_files(spark, sf_dir):
    d = _docs(spark, sf_dir).selectExpr("doc_id", *(x.strip() for x in _SPECIAL.split(" AS t, ")[0:1]), _SPECIAL.split(" AS t, ")[1]).toDF("doc_id", "t", "path")
    return d.select("doc_id", kinds.special_type(F.col("t"), F.col("path"), ["/dev/1", "/dev/2"], ["/dev/3"]).alias("scanned"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 61267 WHEN 1 THEN 26985 WHEN 2 THEN 2435016766 WHEN 3 THEN 4283649346 WHEN 4 THEN 43981 ELSE 0 END AS number FROM documents")
def file_systems(spark, sf_dir):
    name = F.expr("CASE doc_id % 6 WHEN 0 THEN 'ext4' WHEN 1 THEN 'nfs' WHEN 2 THEN 'btrfs' WHEN 3 THEN 'cifs' WHEN 4 THEN '0xABCD' ELSE 'nosuchfs' END")
    return _docs(spark, sf_dir).select("doc_id", kinds.file_system_number(name).cast("long").alias("number"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'backup' WHEN 1 THEN 'backup' WHEN 2 THEN 'restore' WHEN 3 THEN 'diff' ELSE 'unknown' END AS action FROM documents")
def phase_actions(spark, sf_dir):
    phase = F.expr("CASE doc_id % 5 WHEN 0 THEN 'scanning' WHEN 1 THEN 'shuffling' WHEN 2 THEN 'restoring' WHEN 3 THEN 'diffing' ELSE 'asleep' END")
    return _docs(spark, sf_dir).select("doc_id", kinds.phase_action(phase).alias("action"))


@query("SELECT conv_id, turn, concat('p:', printf('%04X', strlen(text)), ':', CASE WHEN regexp_full_match(text, '[ -~\\n]*') THEN text ELSE '(binary data)' END) AS shown FROM conversations")
def printable_frames(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kinds.printable(F.lit("p"), F.col("text")).alias("shown"))


@query(f"{_inv(1)} SELECT path, CASE WHEN (mode & 61440) = 16384 THEN mode ELSE (mode & 4095) | 16384 END AS mode FROM e1")
def fake_directories(spark, sf_dir):
    return entries(spark, sf_dir, 1).select("path", kinds.fake_directory(F.col("mode")).alias("mode"))


@query("""SELECT c_custkey AS client, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 2 = 0 WHEN 1 THEN c_custkey % 2 = 0 AND c_custkey % 5 < 3 ELSE FALSE END AS can_restore, FALSE AS can_force FROM customer""")
def narrowed_rights(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client"))
    own, target, access = F.expr("client % 2 = 0"), F.expr("client % 5 < 3"), F.expr("CASE client % 3 WHEN 0 THEN 'super' WHEN 1 THEN 'restore' ELSE 'none' END")
    return c.select("client", kinds.narrowed("restore", own, target, access).alias("can_restore"), kinds.narrowed("force_backup", own, target, access).alias("can_force"))


@query(f"{_inv(1)} SELECT CAST(max(length(regexp_extract(path, '[.]([^./]*)$', 1))) AS INTEGER) AS longest FROM e1")
def longest_extension(spark, sf_dir):
    from stowage.functions.paths import extension

    return entries(spark, sf_dir, 1).select(F.max(F.length(F.coalesce(extension(F.col("path")), F.lit("")))).alias("longest"))


# Comparison options


_SIDES = f"WITH c AS ({entries_sql(3)}), p AS ({entries_sql(2)})"


@query(f"""{_SIDES} SELECT c.path, CASE WHEN p.path IS NULL OR c.kind <> p.kind THEN 'new' WHEN p.kind = 'y' AND p.size % 3 < 2 THEN 'new' WHEN c.mtime = p.mtime AND c.ctime = p.ctime THEN 'same'
  WHEN c.mtime = p.mtime AND c.kind = 'm' THEN 'new' WHEN c.mtime = p.mtime THEN 'same' WHEN c.kind NOT IN ('f','y','m') THEN 'changed' WHEN c.kind IN ('m','y') THEN 'new'
  WHEN c.size > 1500 OR p.size > 1500 THEN 'new' WHEN (p.size % 2 = 0) <> (c.size % 4 > 0) THEN 'new' ELSE 'changed' END AS change
  FROM c LEFT JOIN p ON c.path = p.path AND (c.kind = 'm') = (p.kind = 'm')""")
def compare_options(spark, sf_dir):
    """Encryption scheme, size bound and compression switch: schemes and levels are made from the size."""
    cur = entries(spark, sf_dir, 3).selectExpr("*", "CAST(2 AS INT) AS encryption", "CAST(size % 4 AS INT) AS compression", "CAST(NULL AS STRING) AS datapth")
    old = entries(spark, sf_dir, 2).selectExpr("*", "CAST(size % 3 AS INT) AS encryption", "-1 AS compression", "CASE WHEN size % 2 = 0 THEN 'a.gz' ELSE 'a' END AS datapth")
    return compare.compare(cur, old, encryption=True, compression=True, max_size=1500).where("change <> 'deleted'").select("path", "change")


_OLD_LINKS = f"SELECT *, lag(path) OVER (PARTITION BY ino ORDER BY scan_order) AS link, CASE WHEN kind IN ('f','y') THEN md5 END AS datapth FROM ({entries_sql(2)})"


@query(f"""WITH p AS ({_OLD_LINKS}), c AS ({entries_sql(3)}), f AS (SELECT path, kind AS k, dev, ino, mtime FROM c WHERE kind IN ('f','y'))
  SELECT f.path, o.datapth AS relink FROM f JOIN p ON f.path = p.path AND p.kind = 'L' AND f.dev = p.dev AND f.ino = p.ino AND f.mtime = p.mtime JOIN p o ON p.link = o.path AND o.kind = f.k AND o.datapth IS NOT NULL""")
def relink_masters(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("path").over(Window.partitionBy("ino").orderBy("scan_order"))
    old = entries(spark, sf_dir, 2).withColumn("link", before).withColumn("datapth", F.when(F.col("kind").isin("f", "y"), F.col("md5")))
    return compare.relinkable(entries(spark, sf_dir, 3), old)


@query(f"{_inv(1)} SELECT kind, CAST(count(*) AS BIGINT) AS entries, CAST(sum(CASE WHEN kind IN ('f','y','k') THEN size ELSE 0 END) AS BIGINT) AS estimated FROM e1 WHERE starts_with(path, '/src1') AND kind <> 'm' GROUP BY kind")
def expected_counts(spark, sf_dir):
    wanted = entries(spark, sf_dir, 1).where(rules.prefix_match(F.col("path"), ["/src1"]) & (F.col("kind") != "m"))
    return compare.byte_sums(wanted, ["kind"]).select("kind", "entries", "estimated")


# Rules


@query(f"{_inv(1)}, s AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM e1 UNION SELECT '/src1'), t AS (SELECT path, path = '/src1' OR NOT starts_with(path, '/src1/') AS is_start FROM s) SELECT path, is_start, CAST(1 AS BIGINT) AS copies FROM t")
def start_folders(spark, sf_dir):
    from stowage.functions.paths import parent

    folders = entries(spark, sf_dir, 1).select(parent(F.col("path")).alias("path")).distinct()
    return rules.start_folders(folders.union(folders.sparkSession.createDataFrame([("/src1",)], "path string")).distinct())


@query("SELECT concat('/', source) AS path, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_rules(spark, sf_dir):
    return rules.duplicate_rules(_docs(spark, sf_dir).select(F.concat(F.lit("/"), "source").alias("path"), F.lit(1).alias("flag")))


@query(f"{_inv(1)} SELECT DISTINCT path FROM e1 WHERE regexp_full_match(path, '/src[12]/e[^/]/[^/.][^/]*[.]txt') OR path = '/src3/fr/7.log'")
def glob_includes(spark, sf_dir):
    return rules.globbed(entries(spark, sf_dir, 1), ["/src[12]/e?/*.txt", "/src3/fr/7.log"])


_TREE = "SELECT concat('/', source, '/', lang, '/d', CAST(doc_id % 9 AS STRING)) AS path, 'd' AS kind FROM documents UNION SELECT concat('/', source, '/', lang, '/d', CAST(doc_id % 9 AS STRING), '/', CAST(doc_id AS STRING)) AS path, 'f' AS kind FROM documents"


def _tree(spark, sf_dir):
    folder = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/d"), (F.col("doc_id") % 9).cast("string"))
    d = _docs(spark, sf_dir)
    return d.select(folder.alias("path"), F.lit("d").alias("kind")).union(d.select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string")), F.lit("f"))).distinct()


@query(f"SELECT path, kind FROM ({_TREE}) WHERE regexp_matches(path, 'd[1-5]|7$') AND regexp_matches(regexp_extract(path, '^/[^/]*/[^/]*/d.'), 'd[1-5]|7$')")
def regex_descent(spark, sf_dir):
    return rules.descended(_tree(spark, sf_dir), ["d[1-5]|7$", "(broken"])


# Life cycle


@query(_B + """, l AS (SELECT client, bno, coalesce((lag(bno) OVER (PARTITION BY client ORDER BY bno) - 1) % 4 = 0, TRUE) AS deletable FROM b), s AS (SELECT client, bno, CASE WHEN bno = 2 AND deletable THEN 'deleted' WHEN bno = 2 THEN 'refused' ELSE 'kept' END AS state FROM l)
  SELECT client, bno, state, coalesce(bno = max(CASE WHEN state <> 'deleted' THEN bno END) OVER (PARTITION BY client), FALSE) AS is_current FROM s""")
def delete_by_number(spark, sf_dir):
    b = catalog.deletable(catalog.hardlinked(backups(spark, sf_dir), [4, 7])).withColumn("stamp", formats.stamp(F.col("bno"), F.col("ts")))
    return lifecycle.delete_one(b, "2")


_LOG = _B + ", l AS (SELECT client, bno, 'working' AS stage FROM b UNION ALL SELECT client, bno, 'finishing' FROM b WHERE o_orderkey % 5 > 0 UNION ALL SELECT client, bno, 'current' FROM b WHERE o_orderkey % 5 > 1)"


def _stage_log(spark, sf_dir):
    b = backups(spark, sf_dir)
    part = lambda name, least: b.where(F.col("o_orderkey") % 5 >= least).select("client", "bno", F.lit(name).alias("stage"))
    return part("working", 0).union(part("finishing", 1)).union(part("current", 2))


@query(_LOG + " SELECT client, bno, CASE max(CASE stage WHEN 'working' THEN 1 WHEN 'finishing' THEN 2 ELSE 3 END) WHEN 1 THEN 'working' WHEN 2 THEN 'finishing' ELSE 'current' END AS stage FROM l GROUP BY client, bno")
def backup_stages(spark, sf_dir):
    return lifecycle.stages(_stage_log(spark, sf_dir))


@query(_B + """, s AS (SELECT client, bno, CASE o_orderkey % 5 WHEN 0 THEN 'working' WHEN 1 THEN 'finishing' ELSE 'current' END AS stage, o_orderkey % 3 AS k FROM b)
  SELECT client, bno, stage = 'working' AS working, stage = 'finishing' AS finishing, coalesce(bno = max(CASE WHEN stage = 'current' THEN bno END) OVER (PARTITION BY client), FALSE) AS current, CASE k WHEN 0 THEN 'backup,verify' WHEN 1 THEN 'backup' ELSE '' END AS logs FROM s""")
def list_with_working(spark, sf_dir):
    b = backups(spark, sf_dir)
    logs = b.where("o_orderkey % 3 < 2").select("client", "bno", F.lit("backup").alias("name")).union(b.where("o_orderkey % 3 = 0").select("client", "bno", F.lit("verify")))
    return lifecycle.listed(b, lifecycle.stages(_stage_log(spark, sf_dir)), logs).withColumn("logs", F.array_join("logs", ","))


_STATE = """c_custkey AS client, CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'finishing' ELSE 'working' END AS stage, c_custkey % 7 = 0 AS phase1_tmp, c_custkey % 5 > 0 AS phase1, c_custkey % 11 = 0 AS changed, FALSE AS unchanged,
  c_custkey % 6 AS attempts, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS same_rules, c_custkey % 13 = 0 AS is_super"""


@query(f"""WITH s AS (SELECT {_STATE} FROM customer) SELECT client, CASE WHEN stage = 'none' THEN 'start' WHEN stage = 'finishing' THEN 'complete' WHEN phase1_tmp OR NOT (phase1 OR changed OR unchanged) THEN 'delete' WHEN attempts > 3 THEN 'delete'
  WHEN is_super THEN 'refuse' WHEN coalesce(same_rules, TRUE) THEN 'resume' ELSE 'delete' END AS action FROM s""")
def recovery_actions(spark, sf_dir):
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey AS client", *(x.strip() for x in _split_columns(_STATE)[1:]))
    return s.select("client", lifecycle.recovery(F.lit("resume"), F.lit(3)).alias("action"))


def _split_columns(text: str) -> list[str]:
    """Columns of a SELECT list without nested commas."""
    return [x for x in text.replace("\n", " ").split(", ")]


@query("SELECT user_id AS client, CAST(count(*) AS BIGINT) AS attempts FROM events GROUP BY user_id")
def resume_attempts(spark, sf_dir):
    return lifecycle.attempts(table(spark, sf_dir, "events").select(F.col("user_id").alias("client")))


_RESUME = f"{_inv(1)}, k AS (SELECT dev AS client, path, kind, translate(path, '/', chr(1)) AS key, CASE WHEN kind = 'm' THEN 2 ELSE 1 END AS cls, scan_order FROM e1), j AS (SELECT * FROM k WHERE scan_order % 3 = 0 AND key < translate('/src2', '/', chr(1)) AND client <> 4), p AS (SELECT client, max(key) AS key FROM j GROUP BY client)"


def _journal(spark, sf_dir):
    e = entries(spark, sf_dir, 1).select(F.col("dev").alias("client"), "path", "kind", "scan_order")
    return e, e.where("scan_order % 3 = 0 AND path < '/src2' AND client <> 4")


@query(_RESUME + " SELECT k.client, k.path FROM k LEFT JOIN p ON k.client = p.client WHERE p.key IS NULL OR k.key > p.key")
def resume_scan(spark, sf_dir):
    scan, journal = _journal(spark, sf_dir)
    return lifecycle.resume(scan, journal, lifecycle.resume_points(journal), after=True).select("client", "path")


@query(_RESUME + " SELECT k.client, k.path FROM k JOIN p ON k.client = p.client WHERE k.key <= p.key")
def resume_journal(spark, sf_dir):
    scan, journal = _journal(spark, sf_dir)
    return lifecycle.resume(journal, scan, lifecycle.resume_points(journal), after=False).select("client", "path")


@query(_B + " SELECT client, max(bno) + 1 AS next_bno, max(CAST(o_orderkey AS BIGINT)) + 1 AS next_path FROM b GROUP BY client")
def next_numbers(spark, sf_dir):
    b = backups(spark, sf_dir)
    stored = b.select("client", codec.data_path_number(codec.data_path(F.col("o_orderkey").cast("long"), compressed=True)).alias("number"))
    return lifecycle.next_numbers(b, stored)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failure' WHEN doc_id % 3 > 0 OR doc_id % 7 > 4 THEN 'success' END AS notify FROM documents")
def notifications(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", lifecycle.notification(F.expr("doc_id % 5 = 0"), F.expr("doc_id % 3"), F.expr("doc_id % 7 - 4"), warnings_only=True, changes_only=True).alias("notify"))


@query(f"{_inv(1)} SELECT path, kind FROM e1 WHERE path NOT IN (SELECT path FROM e1 WHERE scan_order % 19 = 0)")
def skipped_entries(spark, sf_dir):
    e = entries(spark, sf_dir, 1).select("path", "kind", "scan_order")
    return lifecycle.without_skipped(e, e.where("scan_order % 19 = 0")).select("path", "kind")


_PLACED = "SELECT CAST(doc_id AS STRING) AS datapth, CASE WHEN doc_id % 7 = 0 THEN 'final' WHEN doc_id % 5 = 0 THEN 'delta' WHEN doc_id % 3 = 0 THEN 'fresh' WHEN doc_id % 2 = 0 THEN 'old' WHEN doc_id % 11 = 0 THEN 'relink' ELSE 'missing' END AS source, doc_id FROM documents"


def _materialised(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("datapth"), "doc_id")
    places = None
    for place, n in (("relink", 11), ("old", 2), ("fresh", 3), ("delta", 5), ("final", 7)):
        part = d.where(F.col("doc_id") % n == 0).select("datapth", F.lit(place).alias("place"))
        places = part if places is None else places.union(part)
    return lifecycle.materialise(d, places)


@query(f"SELECT datapth, source FROM ({_PLACED})")
def materialised(spark, sf_dir):
    return _materialised(spark, sf_dir)


@query(f"SELECT datapth, CASE WHEN doc_id % 4 = 0 THEN 'removed' ELSE 'patched, reverse delta' END AS outcome FROM ({_PLACED}) WHERE source = 'delta'")
def reverse_deltas(spark, sf_dir):
    failed = _docs(spark, sf_dir).where("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("datapth"))
    return lifecycle.patched(_materialised(spark, sf_dir), failed, hardlinked=False)


@query(f"{_inv(1)} SELECT path, CASE WHEN nlink >= 3 THEN 'copy' ELSE 'link' END AS how FROM e1")
def clone_backup(spark, sf_dir):
    return lifecycle.clone(entries(spark, sf_dir, 1), 3).select("path", "how")


@query("SELECT a.doc_id AS id, CASE WHEN b.doc_id IS NULL THEN FALSE ELSE a.text = b.text END AS equal FROM documents a LEFT JOIN documents b ON a.doc_id = b.doc_id - 1")
def equal_files(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return contents.equal_contents(d.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content")), d.select((F.col("doc_id") - 1).alias("id"), F.col("text").cast("binary").alias("content"))).where("here")\
        .select("id", "equal")


# Clients


@query("SELECT c_custkey AS client FROM customer WHERE c_custkey = 7 OR c_custkey % 10 = 3")
def permitted_clients(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("client"))
    grants = c.where("CAST(client AS BIGINT) % 10 = 3").select("client", F.lit("7").alias("name"))
    return clients.permitted(c, "7", grants).select(F.col("client").cast("long").alias("client"))


@query("SELECT 'g' || CAST(doc_id % 40 % 3 AS STRING) AS grp, n_chars AS size, md5(text) AS md5, CAST(count(*) AS BIGINT) AS files FROM documents WHERE doc_id % 40 % 3 < 2 AND n_chars > 0 GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dedup_by_group(spark, sf_dir):
    files = _docs(spark, sf_dir).select((F.col("doc_id") % 40).alias("client"), F.col("text").cast("binary").alias("content"), F.col("n_chars").alias("size"))
    members = spark.range(40).select(F.col("id").alias("client"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("grp"))
    return clients.shared_contents(clients.in_groups(files, members, ["g0", "g1"]))


@query(_B + " SELECT client, arg_max(o_orderkey, bno) * 10 AS estimated, CAST(500 AS BIGINT) AS quota FROM b GROUP BY client HAVING arg_max(o_orderkey, bno) % 2 = 0")
def quota_exceeded(spark, sf_dir):
    b = backups(spark, sf_dir)
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Err: hard quota exceeded: "), (F.col("o_orderkey") * 10).cast("string"), F.lit(" of 500"))).otherwise("done")
    return clients.over_quota(b.select("client", "bno", F.lit(1).alias("line"), text.alias("text")))


def _flagged_backups(spark, sf_dir):
    return catalog.positions(backups(spark, sf_dir)).select("client", "bno", "ts", browse.flag_array({"current": F.col("is_current"), "manifest": F.lit(True)}).alias("flags"))


@query(_B + """, p AS (SELECT client, CAST(count(*) AS BIGINT) AS n, max(bno) AS last FROM b GROUP BY client) SELECT CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'a,b' ELSE '' END AS labels, CASE WHEN c_custkey % 4 = 0 THEN 'running' ELSE 'idle' END AS run_status,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 9 AS STRING) || ' backup' END AS child, coalesce(n, 0) AS backups, last FROM customer LEFT JOIN p ON c_custkey = client""")
def client_status_json(spark, sf_dir):
    """The nested JSON of all clients, read back."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client"))
    tags = c.where("client % 3 = 0").select("client", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("label"))
    kids = c.where("client % 4 = 0").select("client", (F.col("client") % 9).cast("int").alias("pid"), F.lit("backup").alias("phase"))
    lines = clients.client_json(c, tags, kids, _flagged_backups(spark, sf_dir))
    schema = "name string, labels array<string>, run_status string, protocol int, children array<struct<pid:int,phase:string>>, backups array<struct<number:bigint,timestamp:bigint,flags:array<string>>>"
    j = lines.select(F.from_json("json", schema).alias("j")).select("j.*")
    child = F.when(F.size("children") > 0, F.concat(F.get("children", 0)["pid"].cast("string"), F.lit(" "), F.get("children", 0)["phase"]))
    return j.select("name", F.array_join("labels", ",").alias("labels"), "run_status", child.alias("child"), F.size("backups").cast("long").alias("backups"), F.get("backups", 0)["number"].alias("last"))


@query(_B + " SELECT client, bno AS number, CAST(epoch(ts) AS BIGINT) AS timestamp, CASE WHEN o_orderkey % 2 = 0 THEN 'backup,backup_stats' END AS logs, CASE WHEN o_orderkey % 2 = 0 THEN 'line 1|line 2' END AS lines FROM b")
def backup_log_json(spark, sf_dir):
    b = backups(spark, sf_dir)
    even = b.where("o_orderkey % 2 = 0")
    logs = even.select("client", "bno", F.explode(F.array(F.lit("backup"), F.lit("backup_stats"))).alias("name"))
    text = even.select("client", "bno", F.explode(F.array(F.lit(2), F.lit(1))).alias("line")).withColumn("text", F.concat(F.lit("line "), F.col("line").cast("string")))
    found = clients.backup_json(_flagged_backups(spark, sf_dir), logs, "backup", text)
    j = found.select("client", F.from_json("json", "number bigint, timestamp bigint, logs struct<list:array<string>,backup:array<string>>").alias("j"))
    return j.select("client", "j.number", "j.timestamp", F.array_join("j.logs.list", ",").alias("logs"), F.array_join("j.logs.backup", "|").alias("lines"))


@query(f"{_inv(1)} SELECT path, concat('{{\"name\":\"', path, '\",\"link\":\"\",\"dev\":', dev, ',\"ino\":', ino, ',\"mode\":', mode, ',\"nlink\":', nlink, ',\"uid\":0,\"gid\":0,\"rdev\":0,\"size\":', size, ',\"blksize\":0,\"blocks\":0,\"atime\":0,\"ctime\":', ctime, ',\"mtime\":', mtime, '}}') AS json FROM e1")
def browse_entry_json(spark, sf_dir):
    e = entries(spark, sf_dir, 1)
    return e.select("path", clients.entry_json(F.col("path"), F.lit(None).cast("string"), {c: F.col(c) for c in ("dev", "ino", "mode", "nlink", "size", "ctime", "mtime")}).alias("json"))


@query(_B + " SELECT CAST(client AS STRING) AS client, bno, CAST(NULL AS STRING) AS warning FROM b WHERE client = 7 AND bno = 1 UNION ALL SELECT NULL, NULL, 'Could not find client: none' UNION ALL SELECT NULL, NULL, 'Pretty print on' UNION ALL SELECT NULL, NULL, 'File not supported' UNION ALL SELECT NULL, NULL, 'Backup not found'")
def monitor_requests(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client"))
    b = backups(spark, sf_dir)
    logs = b.select("client", "bno", F.lit("backup").alias("name"))
    out = None
    for text in ("c:7:b:1:l:backup", "c:none", "j:pretty-print-on", "l:secrets", "b:99999:c:7:p:/a:b"):
        found = clients.answer(clients.parse_request(text), c, b, logs)
        out = found if out is None else out.union(found)
    return out


# Journals, deltas and addresses


@query(f"{_joined(3, 2)} SELECT path, CASE change WHEN 'new' THEN 'n' WHEN 'changed' THEN 'c' WHEN 'same' THEN 's' ELSE 'd' END || kind || printf('%04X', strlen(path)) || path AS line FROM ch")
def journal_lines(spark, sf_dir):
    return compare_rows(spark, sf_dir).select("path", sinks.journal_line(F.col("change"), F.col("kind"), F.col("path")).alias("line"))


@query("SELECT conv_id, turn, strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds(CAST(turn AS BIGINT)), '%Y-%m-%d %H:%M:%S') || ' ::1 ' || role || ' ' || substr(text, 1, 5) AS line FROM conversations")
def audit_lines(spark, sf_dir):
    stamp = F.date_format(F.expr("TIMESTAMP '2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, turn)"), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sinks.audit_line(stamp, F.lit("::1"), F.col("role"), F.substring("text", 1, 5)).alias("line"))


@query("SELECT user_id AS client, min(ts) AS created FROM events GROUP BY user_id")
def first_contacts(spark, sf_dir):
    return sinks.first_contacts(table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("ts").alias("stamp")))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'w' ELSE 'p' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'warnings' ELSE 'messages' END AS name, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1, 2")
def log_counters(spark, sf_dir):
    return sinks.log_counters(table(spark, sf_dir, "events").select(F.expr("CASE WHEN event_id % 3 = 0 THEN 'warning' ELSE 'message' END").alias("level"), F.col("event_type").alias("text")))


def _versions(spark, sf_dir):
    """Three generations of each text: as it is, with a tail, and with a head and a tail."""
    old = _bytes(spark, sf_dir)
    middle = old.withColumn("content", F.concat("content", F.lit("tail").cast("binary"))).withColumn("size", F.col("size") + 4)
    new = middle.withColumn("content", F.concat(F.lit("head").cast("binary"), "content")).withColumn("size", F.col("size") + 4)
    return old, middle, new


@query("SELECT doc_id AS id, md5(text || 'tail') AS md5 FROM documents WHERE text IS NOT NULL")
def patched_files(spark, sf_dir):
    old, middle, _ = _versions(spark, sf_dir)
    sent = contents.with_data(contents.delta(old, middle, 256), middle, 256)
    return contents.patch(old, sent, 256).select("id", F.md5("content").alias("md5"))


@query("SELECT doc_id AS id, md5(text) AS md5 FROM documents WHERE text <> ''")
def folded_deltas(spark, sf_dir):
    """The oldest of three versions, from the latest and two reverse deltas."""
    old, middle, new = _versions(spark, sf_dir)
    reverse = lambda a, b: contents.with_data(contents.delta(a, b, 256), b, 256)
    made = contents.fold(new, {2: reverse(new, middle), 1: reverse(middle, old)}, 1, 256)
    return made.select("id", F.md5("content").alias("md5")).join(old.where("size > 0").select("id"), "id", "left_semi")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id % 256 >= 128 WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN TRUE ELSE FALSE END AS ok FROM documents")
def allowed_addresses(spark, sf_dir):
    address = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('10.1.2.', CAST(doc_id % 256 AS STRING)) WHEN 1 THEN '192.168.7.9' WHEN 2 THEN '192.169.0.1' WHEN 3 THEN '2001:db8::17' ELSE 'nowhere' END")
    return _docs(spark, sf_dir).select("doc_id", formats.allowed(address, ["10.1.2.128/25", "192.168.0.0/16", "2001:db8::/32"]).alias("ok"))


@query(f"""{_inv(1)} SELECT path, CASE mode & 61440 WHEN 16384 THEN 'd' WHEN 40960 THEN 'l' ELSE '-' END{_rwx(6)}{_rwx(3)}{_rwx(0)} || printf(' %2d %5d %5d %7d ', nlink, dev, ino, size) || strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || path AS long,
  'f' || printf('%04X', strlen(path)) || path AS parseable FROM e1""")
def list_lines(spark, sf_dir):
    e, c = entries(spark, sf_dir, 1), F.col
    return e.select("path", formats.list_line(c("path"), "long", mode=c("mode"), nlink=c("nlink"), uid=c("dev"), gid=c("ino"), size=c("size"), mtime=c("mtime")).alias("long"), formats.list_line(c("path"), "parseable").alias("parseable"))


@query(_B + " SELECT client, max(ts) AS last, client % 5 = 0 AS due FROM b GROUP BY client")
def timer_manual(spark, sf_dir):
    last = backups(spark, sf_dir).groupBy("client").agg(F.max("ts").alias("last"))
    return catalog.due(last, F.lit("2026-01-01 03:30:00").cast("timestamp"), 86400, ["Mon,04"], last.where("client % 5 = 0"))


@query(f"SELECT path, kind FROM ({_TREE}) WHERE NOT (kind = 'f' AND regexp_matches(path, '/d[25]/'))")
def excluded_file_systems(spark, sf_dir):
    fs = F.when(F.col("path").rlike("/d[2](/|$)"), 0x6969).when(F.col("path").rlike("/d5(/|$)"), 0xFFF1).otherwise(0xEF53)
    return rules.without_file_systems(_tree(spark, sf_dir).withColumn("fs", fs), ["nfs", "0xFFF1"]).select("path", "kind")


# Further rules


@query(f"{_inv(1)} SELECT path FROM e1 WHERE (path LIKE '%.txt' OR path LIKE '%.gz') AND NOT path LIKE '%.log' OR path = '/src1/en/6'")
def scan_extensions(spark, sf_dir):
    return rules.by_extension(entries(spark, sf_dir, 1), ["txt", "GZ"], ["log"], ["/src1/en/6"]).select("path")


@query(f"{_inv(1)} SELECT path, kind FROM e1 WHERE scan_order % 3 > 0 AND starts_with(path, '/src') AND regexp_matches(path, '[0-9]5')")
def restore_wanted(spark, sf_dir):
    return entries(spark, sf_dir, 1).where(rules.wanted(F.col("path"), F.col("kind"), F.expr("scan_order % 3 > 0"), ["/src"], ["[0-9]5"])).select("path", "kind")


@query(f"{_inv(1)} SELECT path, CASE WHEN scan_order % 4 = 1 THEN NULL WHEN scan_order % 4 = 2 THEN '/target' || path || '/../x' ELSE '/target' || path END AS target, CASE WHEN starts_with(path, '/src1/') THEN 't/new' || substr(path, 6) ELSE 't' || path END AS datapth FROM e1")
def restore_targets(spark, sf_dir):
    from stowage.functions import paths

    odd = F.expr("CASE scan_order % 4 WHEN 1 THEN concat('/a/../..', path) WHEN 2 THEN concat(path, '/../x') ELSE path END")
    data = paths.swap_in_data_path(F.concat(F.lit("t"), F.col("path")), "/src1/", "/new/")
    return entries(spark, sf_dir, 1).select("path", paths.restore_target("/target", odd).alias("target"), data.alias("datapth"))


@query("SELECT doc_id FROM documents WHERE doc_id % 8 NOT IN (0, 1, 2, 3, 4) AND n_chars > 0")
def dedupable_files(spark, sf_dir):
    names = F.expr("CASE doc_id % 8 WHEN 0 THEN 'working/a' WHEN 1 THEN 'lockfile' WHEN 2 THEN '0000001/log.gz' WHEN 3 THEN 'deleteme/x' WHEN 4 THEN '0000001/d' WHEN 5 THEN '0000001/data/log' ELSE '0000001/data/t' END")
    d = _docs(spark, sf_dir).select("doc_id", names.alias("path"), F.expr("CASE WHEN doc_id % 8 = 4 THEN 'd' ELSE 'f' END").alias("kind"), F.col("n_chars").alias("size"))
    return contents.dedupable(d).select("doc_id")


@query("""WITH f AS (SELECT doc_id % 2 AS dev, doc_id - doc_id % 4 AS ino, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS nlink, n_chars AS size, md5(text) AS md5 FROM documents WHERE n_chars > 0),
  i AS (SELECT dev, size, md5, ino, count(*) AS names, count(*) >= max(nlink) AS whole FROM f GROUP BY ALL)
  SELECT dev, size, md5, CAST(sum(names) AS BIGINT) AS names, CAST(count(*) AS BIGINT) AS inodes, CAST(count(*) - 1 AS BIGINT) AS duplicates, CAST((sum(CAST(whole AS INTEGER)) - CAST(arg_min(whole, ino) AS INTEGER)) * size AS BIGINT) AS saved FROM i GROUP BY dev, size, md5 HAVING sum(names) > 1""")
def dedup_by_device(spark, sf_dir):
    d = _docs(spark, sf_dir).select((F.col("doc_id") % 2).alias("dev"), (F.col("doc_id") - F.col("doc_id") % 4).alias("ino"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END").alias("nlink"), F.col("text").cast("binary").alias("content"), F.col("n_chars").alias("size"))
    return contents.duplicates_by_device(d, unlink=True)


@query(f"{_inv(2)} SELECT kind, CAST(sum(size + 1) AS BIGINT) AS bytes, CAST(sum(CASE WHEN kind IN ('f','y','k') THEN size ELSE 0 END) AS BIGINT) AS estimated FROM e2 GROUP BY kind")
def stored_bytes(spark, sf_dir):
    e = entries(spark, sf_dir, 2).withColumn("endfile", codec.endfile(F.col("size") + 1, F.col("md5")))
    return compare.stored_bytes(e, ["kind"])


@query("SELECT count(*) FILTER (event_id % 3 = 0) > 0 AS failed FROM events")
def fails_on_warning(spark, sf_dir):
    return compare.fails_on_warning(log_counters(spark, sf_dir))


@query("SELECT c_name AS client FROM customer WHERE NOT regexp_full_match(c_name, '.*[0-4]') OR regexp_full_match(c_name, '.*04')")
def selected_clients(spark, sf_dir):
    return clients.selected(table(spark, sf_dir, "customer").select(F.col("c_name").alias("client")), [".*04"], [".*[0-4]"])


@query("SELECT CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS running, count(*) FILTER (event_type = 'click') < 100 AS free FROM events")
def parallel_limit(spark, sf_dir):
    return clients.parallel(table(spark, sf_dir, "events").select(F.expr("CASE WHEN event_type = 'click' THEN 'backup' ELSE 'idle' END").alias("phase")), 100)


@query(_B + " SELECT client, CAST(k AS INTEGER) AS line, 'WARNING ' || CAST(k AS STRING) AS text FROM b, (SELECT unnest([1, 2]) AS k) WHERE bno = (SELECT max(bno) FROM b x WHERE x.client = b.client)")
def current_warnings(spark, sf_dir):
    b = backups(spark, sf_dir).select("client", "bno", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("line"))
    return clients.last_warnings(b.withColumn("text", F.when(F.col("line") < 3, F.concat(F.lit("WARNING "), F.col("line").cast("string"))).otherwise("done")))


# Streams


@query("SELECT DISTINCT event_id, user_id, event_type, ts FROM events")
def change_log_stream(spark, sf_dir):
    from stowage.streaming.monitor import append_log, source

    return append_log(source(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts"))


@query("SELECT event_id, c_custkey IS NOT NULL AS known FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_with_dimension(spark, sf_dir):
    from stowage.streaming.monitor import source, with_dimension

    load = lambda: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    return with_dimension(source(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id"), load, ["user_id"]).select("event_id", F.coalesce("known", F.lit(False)).alias("known"))
