"""Every query over the driver tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import codec, formats, paths
from stowage.operators import browse, catalog, clients, compare, contents, rules
from stowage.plans.views import BACKUPS_SQL, backups, entries, entries_sql, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
NOW = "2026-01-01 03:30:00"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _all() -> None:
    """Have the other modules add theirs."""
    from stowage.plans import lifecycle  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)


def _cls(kind: str) -> str:
    return f"CASE WHEN {kind} IN ('v','V') THEN 0 WHEN {kind} IN ('m','n') THEN 2 WHEN {kind} IN ('u','U') THEN 3 ELSE 1 END"


def _inv(*bnos: int) -> str:
    return "WITH " + ", ".join(f"e{b} AS ({entries_sql(b)})" for b in bnos)


def _joined(new: int, old: int) -> str:
    return f"""{_inv(new, old)}, j AS (SELECT coalesce(c.path, p.path) AS path, coalesce(c.cls, p.cls) AS kind_class, c.kind AS ck, p.kind AS pk,
      c.mtime AS cm, p.mtime AS pm, c.ctime AS cc, p.ctime AS pc
      FROM (SELECT *, {_cls("kind")} AS cls FROM e{new}) c FULL OUTER JOIN (SELECT *, {_cls("kind")} AS cls FROM e{old}) p ON c.path = p.path AND c.cls = p.cls),
    ch AS (SELECT path, kind_class, coalesce(ck, pk) AS kind, pk AS prev_kind, CASE WHEN ck IS NULL THEN 'deleted' WHEN pk IS NULL THEN 'new' WHEN ck <> pk THEN 'new'
      WHEN cm = pm AND cc = pc THEN 'same' WHEN cm = pm AND ck IN ('n','k','m','v','V','u','U') THEN 'new' WHEN cm = pm THEN 'same'
      WHEN ck NOT IN ('f','y','m','n','k','v','V','u','U') THEN 'changed' WHEN ck IN ('m','y','n','V','U','k','v','u') THEN 'new' ELSE 'changed' END AS change FROM j)"""


_COUNTS = "SELECT kind, " + ", ".join(f"CAST(sum(CASE WHEN change = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for c, n in (("new", '"new"'), ("changed", "changed"), ("same", "same"), ("deleted", "deleted"))) + ", CAST(count(*) - sum(CASE WHEN change = 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS scanned FROM ch GROUP BY kind"


# Comparison


@query(_joined(3, 2) + " SELECT path, kind_class, kind, prev_kind, change FROM ch")
def compare_rows(spark, sf_dir):
    return compare.compare(entries(spark, sf_dir, 3), entries(spark, sf_dir, 2))


@query(f"{_joined(3, 2)}, n AS ({_COUNTS}) SELECT * FROM n" + "".join(f" UNION ALL SELECT '{z}', " + ", ".join(f"CAST(sum({c}) AS BIGINT)" for c in ('"new"', "changed", "same", "deleted", last)) + " FROM n WHERE kind NOT IN ('w','p')" for z, last in (("Y", "0"), ("Z", "scanned"))))
def compare_counters(spark, sf_dir):
    return compare.totals(compare.counters(compare_rows(spark, sf_dir)))


@query(f"{_joined(3, 2)}, n AS ({_COUNTS}) SELECT *, \"new\" + changed + same AS total FROM n WHERE \"new\" + changed + same > 0")
def counters_report(spark, sf_dir):
    return compare.report(compare.counters(compare_rows(spark, sf_dir)))


@query(f"{_inv(1)} SELECT path, {_cls('kind')} AS kind_class, kind, CAST(NULL AS VARCHAR) AS prev_kind, 'new' AS change FROM e1")
def compare_initial(spark, sf_dir):
    return compare.compare(entries(spark, sf_dir, 1), None)


@query(f"{_inv(2)} SELECT kind, CAST(count(*) AS BIGINT) AS n FROM e2 GROUP BY kind")
def compare_vss_reset(spark, sf_dir):
    return compare.compare(entries(spark, sf_dir, 2), entries(spark, sf_dir, 1), reset=True).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{_inv(3, 2)} SELECT c.path, c.kind, p.md5 AS md5, c.size AS size FROM e3 c JOIN e2 p ON c.path = p.path AND {_cls('c.kind')} = {_cls('p.kind')} WHERE c.kind = p.kind AND c.mtime = p.mtime AND (c.ctime = p.ctime OR c.kind <> 'm')")
def carry_over(spark, sf_dir):
    return compare.carry_over(entries(spark, sf_dir, 3), entries(spark, sf_dir, 2), ["md5"]).select("path", "kind", "md5", "size")


_DIFF = _joined(4, 1) + """, d AS (SELECT '-' AS sign, path, pk AS kind, pm AS mtime, kind_class FROM j WHERE pk IS NOT NULL AND (ck IS NULL OR cm <> pm)
  UNION ALL SELECT '+', path, ck, cm, kind_class FROM j WHERE ck IS NOT NULL AND (pk IS NULL OR cm <> pm))"""


@query(_DIFF + " SELECT * FROM d")
def diff_backups(spark, sf_dir):
    return compare.diff(entries(spark, sf_dir, 1), entries(spark, sf_dir, 4))


@query(_DIFF + " SELECT sign, kind, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY sign, kind")
def diff_summary(spark, sf_dir):
    return diff_backups(spark, sf_dir).groupBy("sign", "kind").agg(F.count("*").alias("n"))


@query(f"{_inv(1)} SELECT path, kind, mtime FROM e1 WHERE NOT (ino % 2 = 0 AND kind <> 'm')")
def apply_deletions(spark, sf_dir):
    e = entries(spark, sf_dir, 1)
    return compare.apply_deletions(e, e.where("ino % 2 = 0 AND kind <> 'm'").select("path", "kind")).select("path", "kind", "mtime")


@query(f"{_inv(1, 4)}, c AS (SELECT * FROM e4 WHERE size % 2 = 0) SELECT path, kind, mtime FROM c UNION ALL SELECT path, kind, mtime FROM e1 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = e1.path AND {_cls('c.kind')} = {_cls('e1.kind')})")
def merge_manifests(spark, sf_dir):
    cols = ["path", "kind", "mtime"]
    return compare.merge(entries(spark, sf_dir, 4).where("size % 2 = 0").select(*cols), entries(spark, sf_dir, 1).select(*cols))


@query(f"{_inv(2)} SELECT kind, CAST(sum(CASE WHEN kind IN ('f','y','k') THEN size ELSE 0 END) AS BIGINT) AS estimated, CAST(count(*) AS BIGINT) AS entries FROM e2 GROUP BY kind")
def estimate(spark, sf_dir):
    return compare.byte_sums(entries(spark, sf_dir, 2), ["kind"])


@query("""WITH s AS (SELECT source, CAST(sum(CASE WHEN doc_id % 10 IN (3,6,7,8,9) THEN n_chars ELSE 0 END) AS BIGINT) AS estimated, CAST(count(*) AS BIGINT) AS entries FROM documents GROUP BY source)
  SELECT source, estimated, entries, CASE WHEN estimated > 100000 THEN 'hard' WHEN estimated > 20000 THEN 'soft' ELSE 'ok' END AS state FROM s""")
def quota_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("source", "n_chars AS size", "CASE WHEN doc_id % 10 = 3 THEN 'y' WHEN doc_id % 10 IN (6,7,8,9) THEN 'f' ELSE 'd' END AS kind")
    return compare.quota(compare.byte_sums(docs, ["source"]), 100000, 20000)


# Selection and rules


@query(f"{_inv(1)} SELECT path, kind FROM e1 WHERE path IN (SELECT path FROM e1 WHERE scan_order % 7 = 0)")
def restore_list(spark, sf_dir):
    e = entries(spark, sf_dir, 1)
    return e.join(e.where("scan_order % 7 = 0").select("path").distinct(), "path", "left_semi").select("path", "kind")


@query(f"{_inv(1)} SELECT path, kind FROM e1 WHERE regexp_matches(path, '[0-9]7[.]txt') AND kind <> 'm'")
def restore_select_regex(spark, sf_dir):
    return entries(spark, sf_dir, 1).where(rules.any_regex(F.col("path"), ["[0-9]7[.]txt"]) & (F.col("kind") != "m")).select("path", "kind")


@query(f"{_inv(1)} SELECT path FROM e1 WHERE starts_with(path, '/src1') OR starts_with(path, '/src3/en')")
def restore_prefix(spark, sf_dir):
    return entries(spark, sf_dir, 1).where(rules.prefix_match(F.col("path"), ["/src1", "/src3/en"])).select("path")


@query(f"{_inv(1)} SELECT path FROM e1 WHERE path LIKE '%.txt' OR path LIKE '%.gz'")
def ext_filter(spark, sf_dir):
    return entries(spark, sf_dir, 1).where(rules.extension_in(F.col("path"), ["TXT", "gz"])).select("path")


@query(f"{_inv(1)} SELECT path, CASE WHEN path LIKE '%.gz' THEN 0 ELSE 9 END AS level FROM e1")
def compression_rule(spark, sf_dir):
    return entries(spark, sf_dir, 1).select("path", rules.compression_for(F.col("path"), ["gz"], 9).alias("level"))


@query(f"{_inv(1)} SELECT path, kind, size FROM e1 WHERE kind NOT IN ('f','y') OR size BETWEEN 500 AND 3000")
def size_filter(spark, sf_dir):
    return entries(spark, sf_dir, 1).where(rules.size_between(F.col("kind"), F.col("size"), 500, 3000)).select("path", "kind", "size")


@query(f"""{_inv(1)} SELECT path FROM e1 WHERE CASE WHEN starts_with(path, '/src1/en/') THEN FALSE WHEN starts_with(path, '/src1/') THEN TRUE WHEN starts_with(path, '/src2/') THEN FALSE ELSE TRUE END""")
def incexc_longest_match(spark, sf_dir):
    return entries(spark, sf_dir, 1).where(rules.included(F.col("path"), [("/", True), ("/src1", True), ("/src1/en", False), ("/src2", False)])).select("path")


@query(f"{_inv(1)} SELECT path FROM e1 WHERE kind IN ('f','y') AND ((path LIKE '%.gz' OR path LIKE '%.log') AND size > 1024)")
def logic_filter(spark, sf_dir):
    p = F.col("path")
    return entries(spark, sf_dir, 1).where(rules.excluded_by(["(file_ext=gz or file_ext=log) and file_size>1k"], p, F.col("size"), F.col("kind"))).select("path")


_MARK = "WITH e AS (SELECT CASE WHEN doc_id % 101 = 0 THEN concat('/', source, '/', lang, '/.nobackup') ELSE concat('/', source, '/', lang, '/', CAST(doc_id AS STRING)) END AS path, concat('/', source, '/', lang) AS dir FROM documents)"


@query(_MARK + " SELECT path FROM e WHERE dir NOT IN (SELECT dir FROM e WHERE path LIKE '%/.nobackup')")
def nobackup_prune(spark, sf_dir):
    e = table(spark, sf_dir, "documents").selectExpr("CASE WHEN doc_id % 101 = 0 THEN concat('/', source, '/', lang, '/.nobackup') ELSE concat('/', source, '/', lang, '/', CAST(doc_id AS STRING)) END AS path")
    return rules.prune_marked(e, [".nobackup"])


# Hard links


@query(f"""{_inv(1)}, f AS (SELECT dev, ino, arg_min(path, scan_order) AS master FROM e1 WHERE nlink > 1 AND kind NOT IN ('d','l') GROUP BY dev, ino)
  SELECT e1.path, CASE WHEN nlink > 1 AND kind NOT IN ('d','l') AND e1.path <> master THEN 'L' ELSE kind END AS kind, CASE WHEN nlink > 1 AND kind NOT IN ('d','l') AND e1.path <> master THEN master END AS link FROM e1 LEFT JOIN f ON e1.dev = f.dev AND e1.ino = f.ino""")
def hardlink_master(spark, sf_dir):
    return contents.hard_links(entries(spark, sf_dir, 1).withColumn("link", F.lit(None).cast("string"))).select("path", "kind", "link")


_LINKED = f"""{_inv(1)}, m AS (SELECT path, kind, md5 AS datapth, CASE WHEN kind = 'L' THEN path_of END AS link FROM (SELECT *, lag(path) OVER (PARTITION BY ino ORDER BY scan_order) AS path_of FROM e1))"""


@query(_LINKED + """, s AS (SELECT * FROM m WHERE path LIKE '%1%') SELECT s.path, CASE WHEN s.kind = 'L' AND c.path IS NULL AND o.path IS NOT NULL THEN o.kind ELSE s.kind END AS kind,
  CASE WHEN s.kind = 'L' AND c.path IS NULL AND o.path IS NOT NULL THEN NULL ELSE s.link END AS link, CASE WHEN s.kind = 'L' AND c.path IS NULL AND o.path IS NOT NULL THEN o.datapth ELSE s.datapth END AS datapth
  FROM s LEFT JOIN (SELECT DISTINCT path FROM s) c ON s.link = c.path LEFT JOIN m o ON s.link = o.path AND o.kind <> 'L'""")
def hardlink_substitution(spark, sf_dir):
    before = F.lag("path").over(Window.partitionBy("ino").orderBy("scan_order"))
    m = entries(spark, sf_dir, 1).select("path", "kind", F.col("md5").alias("datapth"), before.alias("_p")).withColumn("link", F.when(F.col("kind") == "L", F.col("_p"))).drop("_p")
    return contents.substitute_links(m.where(F.col("path").contains("1")), m)


# Scalars


@query(f"{_inv(1)} SELECT path, row_number() OVER (PARTITION BY kind ORDER BY translate(path, '/', chr(1))) AS n FROM e1")
def path_order(spark, sf_dir):
    return compare.numbered(entries(spark, sf_dir, 1).select("path", "kind"), ["kind"], [paths.path_key(F.col("path"))]).select("path", "n")


@query(f"{_inv(1)} SELECT path, CASE WHEN starts_with(path, '/src1/') THEN 2 ELSE 0 END AS depth, NOT (starts_with(path, '/src1/en/')) AS outside FROM e1")
def path_depth(spark, sf_dir):
    p = F.col("path")
    return entries(spark, sf_dir, 1).select("path", paths.subdir_depth(F.lit("/src1"), p).alias("depth"), (~paths.is_below(F.lit("/src1/en"), p)).alias("outside"))


@query(f"{_inv(1)} SELECT path, concat('/', split_part(path, '/', 4)) AS stripped, CAST(NULL AS VARCHAR) AS gone FROM e1")
def strip_components(spark, sf_dir):
    return entries(spark, sf_dir, 1).select("path", paths.strip_components(F.col("path"), 2).alias("stripped"), paths.strip_components(F.col("path"), 3).alias("gone"))


def _rwx(shift: int) -> str:
    return "".join(f" || CASE WHEN mode & {b << shift} <> 0 THEN '{c}' ELSE '-' END" for b, c in ((4, "r"), (2, "w"), (1, "x")))


@query(f"{_inv(1)} SELECT path, CASE mode & 61440 WHEN 16384 THEN 'd' WHEN 40960 THEN 'l' ELSE '-' END{_rwx(6)}{_rwx(3)}{_rwx(0)} AS mode FROM e1")
def mode_string(spark, sf_dir):
    return entries(spark, sf_dir, 1).select("path", formats.mode_string(F.col("mode")).alias("mode"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN '' WHEN b < 1048576 THEN printf(' (%.2f KB)', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf(' (%.2f MB)', b / 1048576.0::DOUBLE) ELSE printf(' (%.2f GB)', b / 1073741824.0::DOUBLE) END AS text
  FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 4096 AS b FROM orders)""")
def human_bytes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.human_bytes(F.col("o_orderkey").cast("long") * 4096).alias("text"))


@query("SELECT doc_id, CAST(least(greatest(ceil(sqrt(CAST(n_chars * n_chars AS DOUBLE)) / 16) * 16, 64), 131072) AS BIGINT) AS block FROM documents")
def blocklen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.block_length(F.col("n_chars") * F.col("n_chars")).alias("block"))


@query("SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * (1 - 2 * (CAST(o_orderkey AS BIGINT) % 2)) AS value, CAST(o_orderkey AS BIGINT) * (1 - 2 * (CAST(o_orderkey AS BIGINT) % 2)) AS back FROM orders")
def radix64_roundtrip(spark, sf_dir):
    value = F.col("o_orderkey").cast("long") * (1 - 2 * (F.col("o_orderkey").cast("long") % 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), codec.from_radix64(codec.radix64(value)).alias("back"))


@query("SELECT doc_id, printf('%04X/%04X/%04X', (n >> 32) & 65535, (n >> 16) & 65535, n & 65535) AS path, n + 1 AS next FROM (SELECT doc_id, doc_id * 65521 AS n FROM documents)")
def datapath_next(spark, sf_dir):
    n = F.col("doc_id") * 65521
    return table(spark, sf_dir, "documents").select("doc_id", codec.data_path(n).alias("path"), (codec.data_path_number(codec.data_path(n)) + 1).alias("next"))


@query("SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages")
def url_components(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))


@query("SELECT page_id FROM pages WHERE regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') LIKE '%/en/%'")
def url_prefix_match(spark, sf_dir):
    return url_components(spark, sf_dir).where(rules.any_regex(F.col("path"), ["/en/"])).select("page_id")


# Catalogue

_B = f"WITH b AS ({BACKUPS_SQL})"


@query(_B + " SELECT client, bno, row_number() OVER w AS \"index\", max(bno) OVER (PARTITION BY client) - bno + 1 AS trbno, lag(bno) OVER w AS prev_bno, lead(bno) OVER w AS next_bno, bno = max(bno) OVER (PARTITION BY client) AS is_current FROM b WINDOW w AS (PARTITION BY client ORDER BY bno)")
def backup_index(spark, sf_dir):
    return catalog.positions(backups(spark, sf_dir)).select("client", "bno", "index", "trbno", "prev_bno", "next_bno", "is_current")


@query(_B + " SELECT client, bno, coalesce((lag(bno) OVER (PARTITION BY client ORDER BY bno) - 1) % 4 = 0, TRUE) AS deletable FROM b")
def backup_deletable(spark, sf_dir):
    return catalog.deletable(catalog.hardlinked(backups(spark, sf_dir), [4, 7])).select("client", "bno", "deletable")


@query(_B + " SELECT client, bno, (bno - 1) % 4 = 0 AS hardlinked FROM b")
def hardlink_schedule(spark, sf_dir):
    return catalog.hardlinked(backups(spark, sf_dir), [4, 7]).select("client", "bno", "hardlinked")


@query(_B + " SELECT client, max(bno) AS bno, arg_max(ts, bno) AS ts FROM b GROUP BY client")
def latest_backup(spark, sf_dir):
    return catalog.latest(backups(spark, sf_dir))


@query(_B + " SELECT client, bno FROM (SELECT client, bno, max(bno) OVER (PARTITION BY client) - bno + 1 AS t FROM b) WHERE t <= 7")
def retention_keep7(spark, sf_dir):
    return catalog.retain(backups(spark, sf_dir), [7]).select("client", "bno")


#: Passes as a recursion: each deletes what may go of the ranges of 7 up to 35, but one of a range, and the oldest beyond 35.
_RETAIN = f"""WITH RECURSIVE b AS ({BACKUPS_SQL}), p AS (SELECT 0 AS pass, client, bno FROM b UNION ALL SELECT pass + 1, client, bno FROM (SELECT *, sum(dead) OVER (PARTITION BY client) AS n_dead FROM (
  SELECT *, CASE WHEN tr > 7 AND tr <= 35 AND free AND tr % 7 <> 0 AND row_number() OVER (PARTITION BY client, part, free AND tr % 7 <> 0 ORDER BY tr) < inside THEN 1 WHEN is_oldest AND tr > 35 THEN 1 ELSE 0 END AS dead FROM (
  SELECT *, count(*) OVER (PARTITION BY client, part) AS inside FROM (SELECT *, (tr + 6) // 7 AS part FROM (
  SELECT pass, client, bno, max(bno) OVER (PARTITION BY client) - bno + 1 AS tr, coalesce((lag(bno) OVER (PARTITION BY client ORDER BY bno) - 1) % 7 = 0, TRUE) AS free, bno = min(bno) OVER (PARTITION BY client) AS is_oldest FROM p))))) WHERE n_dead > 0 AND dead = 0)
  SELECT client, bno FROM p WHERE (client, pass) IN (SELECT (client, max(pass)) FROM p GROUP BY client)"""


@query(_RETAIN)
def retention_keep_7_4(spark, sf_dir):
    return catalog.retain(catalog.hardlinked(backups(spark, sf_dir), [7, 4]), catalog.normal_keeps([7, 4])).select("client", "bno")


@query(_B + f" SELECT client, max(ts) AS last, epoch(max(ts)) + 86400 * 400 < epoch(TIMESTAMP '{NOW}') AS due FROM b GROUP BY client")
def timer_due(spark, sf_dir):
    last = backups(spark, sf_dir).groupBy("client").agg(F.max("ts").alias("last"))
    return catalog.due(last, F.lit(NOW).cast("timestamp"), 86400 * 400, ["Mon,Tue,Wed,Thu,Fri,00,01,02,03,04"])


@query("SELECT event_id, strftime(ts, '%a') IN ('Mon','Tue') AND strftime(ts, '%H') IN ('02','03') AS allowed FROM events")
def timebands(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", catalog.in_timeband(F.col("ts"), ["Mon,Tue,02,03"]).alias("allowed"))


@query(_B + " SELECT client, bno FROM b WHERE bno = 2")
def select_by_number(spark, sf_dir):
    return catalog.select_backups(backups(spark, sf_dir), "2").select("client", "bno")


@query(_B + " SELECT client, max(bno) AS bno FROM b GROUP BY client")
def select_for_restore(spark, sf_dir):
    return catalog.select_for_restore(backups(spark, sf_dir), "").select("client", "bno")


# Reports


@query("SELECT o_custkey AS client FROM orders UNION SELECT c_custkey FROM customer")
def clients_union(spark, sf_dir):
    return catalog.known_clients(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client")))


_OUT = " SELECT c.c_custkey AS client, last FROM customer c LEFT JOIN (SELECT client, max(ts) AS last FROM b GROUP BY client) l ON c.c_custkey = l.client"


@query(_B + _OUT + f" WHERE epoch(TIMESTAMP '{NOW}') - 86400 * 1000 > coalesce(epoch(last), 0)")
def outdated_clients_days(spark, sf_dir):
    return catalog.outdated(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client")), backups(spark, sf_dir), F.lit(NOW).cast("timestamp"), 1000)


@query(_B + f" SELECT client, max(ts) AS last, CASE WHEN CAST(max(ts) AS DATE) < DATE '2000-01-01' THEN 'old' ELSE 'ok' END AS state FROM b GROUP BY client")
def outdated_clients(spark, sf_dir):
    return backups(spark, sf_dir).groupBy("client").agg(F.max("ts").alias("last")).withColumn("state", F.when(F.to_date("last") < F.lit("2000-01-01").cast("date"), "old").otherwise("ok"))


@query(_B + " SELECT client, bno, rank FROM (SELECT client, bno, row_number() OVER (PARTITION BY client ORDER BY bno DESC) AS rank FROM b) WHERE rank <= 3")
def verify_top_n(spark, sf_dir):
    return catalog.top_n(backups(spark, sf_dir), 3).select("client", "bno", F.col("rank").cast("long").alias("rank"))


@query(_sql["verify_top_n"] + " ORDER BY rank, client")
def verify_round_robin(spark, sf_dir):
    return catalog.round_robin(verify_top_n(spark, sf_dir))


@query(_B + ", d AS (SELECT DISTINCT client, date_trunc('month', ts) AS m, CAST(ts AS DATE) AS day FROM b) SELECT client, strftime(day, '%Y-%m-%d') AS day FROM d WHERE m = (SELECT max(m) FROM d x WHERE x.client = d.client)")
def backup_calendar(spark, sf_dir):
    return catalog.calendar(backups(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(_B + ", l AS (SELECT client, max(bno) AS bno, arg_max(ts, bno) AS ts FROM b GROUP BY client) SELECT c_custkey AS client, concat('last backup: ', coalesce(printf('%07d', bno) || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S'), '0000000 never')) AS line FROM customer LEFT JOIN l ON c_custkey = client")
def snapshot_summary(spark, sf_dir):
    return catalog.snapshot(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client")), backups(spark, sf_dir))


@query("SELECT conv_id, turn, text FROM conversations c WHERE role = 'user' AND turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'user')")
def last_warnings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return clients.last_lines(c.select(F.col("conv_id").alias("log"), F.col("turn").alias("line"), "text")).toDF("conv_id", "turn", "text")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN text LIKE '%a%' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM conversations GROUP BY conv_id")
def log_lines(spark, sf_dir):
    return clients.log_counts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("log"), "text"), ["a"]).withColumnRenamed("log", "conv_id")


# Contents


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"), F.col("n_chars").alias("size"))


_DUP = "SELECT n_chars AS size, md5(text) AS md5, CAST(count(*) AS BIGINT) AS files, CAST(count(*) - {kept} AS BIGINT) AS duplicates, CAST((count(*) - {kept}) * n_chars AS BIGINT) AS saved FROM documents WHERE n_chars > 0 GROUP BY n_chars, md5(text) HAVING count(*) > 1"


@query(_DUP.format(kept="1"))
def dedup_groups(spark, sf_dir):
    return contents.duplicates(_files(spark, sf_dir))


@query(f"SELECT CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(saved) AS BIGINT) AS saved FROM ({_DUP.format(kept='1')})")
def dedup_saved(spark, sf_dir):
    return dedup_groups(spark, sf_dir).agg(F.sum("duplicates").alias("duplicates"), F.sum("saved").alias("saved"))


@query("SELECT id, representative FROM (SELECT doc_id AS id, min(doc_id) OVER w AS representative, count(*) OVER w AS n FROM (SELECT doc_id, n_chars, md5(text) AS h, (row_number() OVER (PARTITION BY n_chars, md5(text) ORDER BY doc_id) - 1) // 3 AS part FROM documents WHERE n_chars > 0) WINDOW w AS (PARTITION BY n_chars, h, part)) WHERE n > 1")
def dedup_maxlinks(spark, sf_dir):
    return contents.representatives(_files(spark, sf_dir), 3)


@query("SELECT doc_id AS id, CASE WHEN text IS NULL OR doc_id % 11 = 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'no_md5' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM documents")
def verify_md5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return contents.verify(docs.select(F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 11 > 0 THEN text END").alias("content"), F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 5 == 0, F.md5(F.lit("x"))).otherwise(F.md5("text")).alias("md5"))).select("id", "state")


_SIGN = "SELECT doc_id AS id, CAST(k AS BIGINT) AS block, CAST(length(substr(h, k * 2 * {n} + 1, 2 * {n})) // 2 AS BIGINT) AS size, md5(unhex(substr(h, k * 2 * {n} + 1, 2 * {n}))) AS md5 FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 1) // {n} + 1)) AS k FROM (SELECT doc_id, hex(encode({text})) AS h FROM documents) WHERE length(h) > 0)"


def _bytes(spark, sf_dir):
    """Whole texts as UTF-8."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content")).withColumn("size", F.octet_length("content").cast("long"))


@query(_SIGN.format(n=512, text="text"))
def signature_blocks(spark, sf_dir):
    return contents.signature(_bytes(spark, sf_dir), F.lit(512))


@query(f"WITH o AS (SELECT id, md5, size, min(block) AS from_block FROM ({_SIGN.format(n=256, text='text')}) GROUP BY id, md5, size), n AS ({_SIGN.format(n=256, text='text || chr(233) || chr(10)')}) SELECT n.id, n.block, CASE WHEN from_block IS NULL THEN 'data' ELSE 'copy' END AS source, from_block FROM n LEFT JOIN o ON n.id = o.id AND n.md5 = o.md5 AND n.size = o.size")
def delta_blocks(spark, sf_dir):
    old = _bytes(spark, sf_dir)
    return contents.delta(old, old.withColumn("content", F.concat("content", F.lit("\u00e9\n").cast("binary"))), 256)


@query()
def delta_rolling(spark, sf_dir):
    old = _bytes(spark, sf_dir)
    return contents.rolling_delta(old.select("id", F.col("content").alias("old"), F.concat(F.lit("head").cast("binary"), F.col("content")).alias("new")), 64)


_STORE = _B + ", w AS (SELECT client, bno, 'p' || CAST(o_orderkey % 3 AS STRING) AS datapth FROM b), s AS (SELECT * FROM w WHERE bno % 3 = 0), f AS (SELECT w.client, w.bno, w.datapth, min(s.bno) AS found_bno FROM w LEFT JOIN s ON w.client = s.client AND w.datapth = s.datapth AND s.bno >= w.bno GROUP BY ALL)"


def _wanted(spark, sf_dir):
    return backups(spark, sf_dir).select("client", "bno", F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("datapth"))


@query(_STORE + " SELECT * FROM f")
def restore_locate(spark, sf_dir):
    w = _wanted(spark, sf_dir)
    return contents.locate(w, w.where("bno % 3 = 0"))


@query(_STORE + " SELECT f.client, f.bno, f.datapth, f.found_bno, string_agg(CAST(d.bno AS STRING), ',' ORDER BY d.bno DESC) AS chain FROM f JOIN w d ON d.client = f.client AND d.datapth = f.datapth AND d.bno >= f.bno AND d.bno < f.found_bno GROUP BY ALL")
def restore_chain(spark, sf_dir):
    w = _wanted(spark, sf_dir)
    return contents.delta_chain(restore_locate(spark, sf_dir), w).withColumn("chain", F.array_join(F.transform("chain", lambda x: x.cast("string")), ","))


# Browsing


@query(f"{_inv(1)} SELECT split_part(path, '/', 3) AS child, 'd' AS kind, CAST(count(*) AS BIGINT) AS entries FROM e1 WHERE starts_with(path, '/src1/') AND kind <> 'm' GROUP BY 1")
def browse_children(spark, sf_dir):
    return browse.children(entries(spark, sf_dir, 1), "/src1")


@query(f"{_inv(1)} SELECT path AS child, kind, CAST(1 AS BIGINT) AS entries FROM e1 WHERE kind <> 'm'")
def browse_all(spark, sf_dir):
    return browse.children(entries(spark, sf_dir, 1), "*")


def _flagged(spark, sf_dir):
    b = catalog.positions(catalog.deletable(catalog.hardlinked(backups(spark, sf_dir), [4, 7])))
    flags = browse.flag_array({"hardlinked": F.col("hardlinked"), "deletable": F.col("deletable"), "current": F.col("is_current"), "manifest": F.lit(True)})
    return b.select("client", "bno", "ts", flags.alias("flags"))


@query(_B + """ SELECT CAST(client AS STRING) AS client, bno AS number, CAST(epoch(ts) AS BIGINT) AS timestamp, concat_ws(',', CASE WHEN (bno - 1) % 4 = 0 THEN 'hardlinked' END, CASE WHEN coalesce((lag(bno) OVER (PARTITION BY client ORDER BY bno) - 1) % 4 = 0, TRUE) THEN 'deletable' END,
  CASE WHEN bno = max(bno) OVER (PARTITION BY client) THEN 'current' END, 'manifest') AS flags FROM b""")
def catalog_json(spark, sf_dir):
    return browse.parse_catalog(browse.catalog_json(_flagged(spark, sf_dir))).withColumn("flags", F.array_join("flags", ","))


@query(f"{_joined(3, 2)}, n AS ({_COUNTS}) SELECT kind, CAST(\"new\" AS STRING) || ',' || CAST(changed AS STRING) || ',' || CAST(same AS STRING) || ',' || CAST(deleted AS STRING) || ',' || CAST(scanned AS STRING) AS fields FROM n WHERE \"new\" + changed + same + deleted > 0")
def counters_json(spark, sf_dir):
    j = browse.counters_json(compare.counters(compare_rows(spark, sf_dir)))
    return j.select("kind", F.concat_ws(",", *(F.get_json_object("json", f"$.{f}") for f in browse.FIELDS)).alias("fields"))


# Monitor


@query("SELECT user_id AS client, event_id % 4 AS pid, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS phase, max(ts) AS ts FROM events GROUP BY 1, 2")
def monitor_latest(spark, sf_dir):
    from stowage.streaming.monitor import latest, status

    return latest(status(table(spark, sf_dir, "events")))


@query("SELECT phase, CAST(count(*) AS BIGINT) AS clients FROM (SELECT user_id AS client, event_id % 4 AS pid, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS phase FROM events GROUP BY 1, 2) GROUP BY phase")
def monitor_running(spark, sf_dir):
    return monitor_latest(spark, sf_dir).groupBy("phase").agg(F.count("*").alias("clients"))


@query("SELECT user_id AS client, event_id % 4 AS pid, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS phase, max(ts) AS ts FROM events GROUP BY 1, 2")
def client_counters_stream(spark, sf_dir):
    """The same rows by a stream that runs until its input is used up."""
    from stowage.streaming.monitor import run_once

    return run_once(spark, f"{sf_dir}/events.parquet")
