"""Registered queries over versioned logs, and the SQL that says the same.

The log is made of ``events``: a user is a record, an event a version of it (an error deletes it), and the body is
JSON of the event. Results hold plain columns taken from the body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonexpr, jsonschema, keys
from ..operators import conflicts, registry
from ..operators import snapshot as snap
from ..operators.query import Filter, OrderBy, Query

#: Versions that the queries read at.
EARLY, LATE = 3000, 7000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without a zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) / 1000)


def event_log(spark: SparkSession, sf_dir: str, per_commit: int = 1, upto: int | None = None) -> DataFrame:
    """Events as a log; ``per_commit`` of them share a version, told apart by ``seq``.

    ``upto``: the last version wanted. Versions are computed from ids here, so the scan is told in terms of ids.
    """
    e = table(spark, sf_dir, "events")
    if upto is not None:
        e = e.where(F.col("event_id") < upto * per_commit)
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    k = F.regexp_extract("props", r"(\d+)", 1)
    body = F.concat(F.lit('{"event_type":'), text("event_type"), F.lit(',"value":'), F.col("value").cast("string"), F.lit(',"props":'), F.col("props"), F.lit(',"tags":['), k, F.lit(',"x"]'), F.when(F.col("event_id") % 3 == 0, F.lit(',"note":null')).when(F.col("event_id") % 3 == 1, F.lit(',"note":"n"')).otherwise(F.lit("")), F.lit("}"))
    return e.select(
        F.lit("shop").alias("space"), F.lit("users").alias("table_name"), F.col("user_id").cast("string").alias("record_id"),
        (F.floor(F.col("event_id") / per_commit) + 1).alias("commit_version"), (F.col("event_id") % per_commit).cast("int").alias("seq"),
        (F.col("event_type") == "error").alias("deleted"), F.when(F.col("event_type") != "error", body).alias("body"), F.lit(0).alias("schema_version"),
        F.concat(F.lit("t"), F.floor(F.col("event_id") / per_commit).cast("string")).alias("txn_id"), _millis(F.col("ts")).alias("updated_ms"),
    )


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get(jsonexpr.document(F.col("body")), f"$.{path}", kind)


def _plain(records: DataFrame) -> DataFrame:
    return records.select("record_id", "commit_version", _get("event_type", "string").alias("event_type"), _get("value", "double").alias("value"), _get("props.k", "bigint").alias("k"))


#: The same log, and its newest versions at LATE, in SQL.
_LOG = """WITH log AS (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id + 1 AS commit_version, event_type = 'error' AS deleted, event_type, value,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events)"""
_AT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY commit_version DESC) AS rn FROM log WHERE commit_version <= {0}) WHERE rn = 1)"
_SNAP = _LOG + f", s AS (SELECT * FROM {_AT.format(LATE)} WHERE NOT deleted) "
_COLS = "record_id, commit_version, event_type, value, k"
#: The same of the whole log, whatever its length; and versions that are so many tenths of its newest.
_NEWEST = _LOG + f", s AS (SELECT * FROM {_AT.format('(SELECT max(commit_version) FROM log)')} WHERE NOT deleted) "
_TENTHS = "(SELECT max(commit_version) * {0} // 10 FROM log)"
EARLY_TENTHS, LATE_TENTHS = 3, 7


def _tenths(log: DataFrame, *tenths: int) -> list[int]:
    newest = snap.global_version(log).first().version or 0
    return [newest * x // 10 for x in tenths]


@_query(_SNAP + f"SELECT {_COLS} FROM s")
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(snap.snapshot(event_log(spark, sf_dir, upto=LATE), LATE))


@_query(_NEWEST + f"SELECT {_COLS} FROM s")
def snapshot_read_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(snap.snapshot(event_log(spark, sf_dir)))


@_query(_LOG + f", s AS (SELECT * FROM {_AT.format(_TENTHS.format(LATE_TENTHS))} WHERE NOT deleted) SELECT {_COLS} FROM s")
def snapshot_read_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return _plain(snap.snapshot(log, *_tenths(log, LATE_TENTHS)))


@_query(_LOG + f" SELECT record_id, commit_version, deleted FROM {_AT.format(LATE)}")
def snapshot_include_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.snapshot(event_log(spark, sf_dir, upto=LATE), LATE, include_deleted=True).select("record_id", "commit_version", "deleted")


@_query(_LOG + " SELECT record_id, max(commit_version) AS commit_version, arg_max(deleted, commit_version) AS deleted FROM log GROUP BY record_id")
def snapshot_include_deleted_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.snapshot(event_log(spark, sf_dir), include_deleted=True).select("record_id", "commit_version", "deleted")


@_query(_LOG + " SELECT record_id, max(commit_version) AS commit_version, arg_max(event_type, commit_version) AS event_type FROM log GROUP BY record_id HAVING NOT arg_max(deleted, commit_version)")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(snap.snapshot(event_log(spark, sf_dir))).select("record_id", "commit_version", "event_type")


@_query(_SNAP + f"SELECT {_COLS} FROM s WHERE record_id = '8'")
def point_get_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(snap.get(event_log(spark, sf_dir), "8", LATE))


def _diff_sql(early: int | str, late: int | str) -> str:
    return (
        _LOG
        + f", a AS (SELECT * FROM {_AT.format(early)} WHERE NOT deleted), b AS (SELECT * FROM {_AT.format(late)} WHERE NOT deleted) "
        + "SELECT coalesce(a.record_id, b.record_id) AS record_id, a.value AS value_before, b.value AS value_after, CASE WHEN a.record_id IS NULL THEN 'added' WHEN b.record_id IS NULL THEN 'removed' ELSE 'changed' END AS change "
        + "FROM a FULL OUTER JOIN b ON a.record_id = b.record_id WHERE a.commit_version IS DISTINCT FROM b.commit_version AND (a.event_type, a.value, a.k, a.event_id % 3) IS DISTINCT FROM (b.event_type, b.value, b.k, b.event_id % 3)"
    )


def _diff(log: DataFrame, early: int, late: int) -> DataFrame:
    d = snap.diff(log, early, late)
    value = lambda c: F.try_variant_get(jsonexpr.document(F.col(c)), "$.value", "double")
    return d.select("record_id", value("before").alias("value_before"), value("after").alias("value_after"), F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("change"))


@_query(_diff_sql(EARLY, LATE))
def diff_added_removed_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(event_log(spark, sf_dir), EARLY, LATE)


@_query(_diff_sql(_TENTHS.format(EARLY_TENTHS), _TENTHS.format(10)))
def diff_share_to_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return _diff(log, *_tenths(log, EARLY_TENTHS, 10))


def _filtered(name: str, where: str, *filters: Filter) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(Query(filters).matching(snap.snapshot(event_log(spark, sf_dir, upto=LATE), LATE, include_deleted=True)))

    def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(Query(filters).matching(snap.snapshot(event_log(spark, sf_dir), include_deleted=True)))

    run.__name__, newest.__name__ = name, f"{name}_newest"
    _query(_SNAP + f"SELECT {_COLS} FROM s WHERE {where}")(run)
    _query(_NEWEST + f"SELECT {_COLS} FROM s WHERE {where}")(newest)


_filtered("filter_eq_string", "event_type = 'view'", Filter("eq", "event_type", "view"))
_filtered("filter_eq_number", "k = 42", Filter("eq", "props.k", 42))
_filtered("filter_eq_other_kind", "false", Filter("eq", "props.k", 42.0))
_filtered("filter_eq_null", "event_id % 3 = 0", Filter("eq", "note", None))
_filtered("filter_eq_array", "k = 42", Filter("eq", "tags", [42, "x"]))
_filtered("filter_ne", "k <> 42", Filter("ne", "props.k", 42))
_filtered("filter_ne_missing", "event_id % 3 <> 1", Filter("ne", "note", "n"))
_filtered("filter_gt", "value > 50", Filter("gt", "value", 50))
_filtered("filter_ge_lt", "value >= 10 AND value < 60.5", Filter("ge", "value", 10), Filter("lt", "value", 60.5))
_filtered("filter_le", "k <= 50", Filter("le", "props.k", 50))
_filtered("filter_lt_null_is_low", "event_id % 3 = 0", Filter("lt", "note", "a"))
_filtered("filter_ge_mixed_kinds", "true", Filter("ge", "event_type", 5))
_filtered("filter_contains", "contains(event_type, 'ic')", Filter("contains", "event_type", "ic"))
_filtered("filter_exists", "event_id % 3 <> 2", Filter("exists", "note"))
_filtered("filter_array_index", "k >= 50", Filter("ge", "tags.0", 50))
_filtered("filter_and", "event_type = 'click' AND k > 20", Filter("eq", "event_type", "click"), Filter("gt", "props.k", 20))


def _page(name: str, sql: str, query: Query) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(query.run(snap.snapshot(event_log(spark, sf_dir, upto=LATE), LATE, include_deleted=True)))

    def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(query.run(snap.snapshot(event_log(spark, sf_dir), include_deleted=True)))

    run.__name__, newest.__name__ = name, f"{name}_newest"
    _query(_SNAP + f"SELECT {_COLS} FROM s {sql}")(run)
    _query(_NEWEST + f"SELECT {_COLS} FROM s {sql}")(newest)


_page("order_page_asc", "ORDER BY value, record_id LIMIT 20 OFFSET 5", Query(order_by=OrderBy("value"), limit=20, offset=5))
_page("order_page_desc", "WHERE k > 10 ORDER BY event_type DESC, record_id LIMIT 25 OFFSET 3", Query((Filter("gt", "props.k", 10),), OrderBy("event_type", True), 25, 3))
_page("order_by_record_id", "ORDER BY record_id LIMIT 10", Query(limit=10))
_page("order_missing_first", "ORDER BY CASE event_id % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, record_id LIMIT 30", Query(order_by=OrderBy("note"), limit=30))


@_query(_SNAP + "SELECT count(*) AS total_matched, count(*) FILTER (value > 50) AS filtered_count FROM s")
def total_before_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = snap.snapshot(event_log(spark, sf_dir, upto=LATE), LATE)
    return seen.agg(F.count("*").alias("total_matched"), F.count_if(Filter("gt", "value", 50).column(F.col("body"))).alias("filtered_count"))


@_query(_NEWEST + "SELECT count(*) AS total_matched, count(*) FILTER (value > 50) AS filtered_count FROM s")
def total_before_filter_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = snap.snapshot(event_log(spark, sf_dir))
    return seen.agg(F.count("*").alias("total_matched"), F.count_if(Filter("gt", "value", 50).column(F.col("body"))).alias("filtered_count"))


_LEAD = _LOG + ", l AS (SELECT *, lead(commit_version) OVER (PARTITION BY record_id ORDER BY commit_version) AS nx FROM log) "


@_query(_LEAD + f"SELECT record_id, commit_version FROM l WHERE nx IS NULL OR nx > {LATE}")
def gc_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.retained(event_log(spark, sf_dir), LATE).select("record_id", "commit_version")


@_query(_LEAD + "SELECT record_id, commit_version FROM l WHERE nx IS NULL")
def gc_retained_without_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.retained(event_log(spark, sf_dir), None).select("record_id", "commit_version")


@_query(_LEAD + f"SELECT record_id, count(*) FILTER (nx <= {LATE}) AS removed FROM l GROUP BY record_id")
def gc_removed_per_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    low = F.count_if(F.col("commit_version") <= LATE)
    return log.groupBy("record_id").agg(F.greatest(low - 1, F.lit(0)).cast("long").alias("removed"))


@_query(_LOG + " SELECT record_id, count(*) AS n_versions, min(commit_version) AS first_version, max(commit_version) AS last_version FROM log GROUP BY record_id")
def version_chain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.chains(event_log(spark, sf_dir)).select("record_id", "n_versions", "first_version", "last_version")


@_query(_LEAD + "SELECT record_id, commit_version, nx AS replaced_by, deleted FROM l")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.history(event_log(spark, sf_dir)).select("record_id", "commit_version", "replaced_by", "deleted")


@_query(_LOG + " SELECT v.version, count(*) FILTER (NOT x.deleted) AS visible FROM (VALUES (500), (3000), (7000)) v(version) LEFT JOIN (SELECT commit_version, deleted, lead(commit_version) OVER (PARTITION BY record_id ORDER BY commit_version) AS nx FROM log) x ON x.commit_version <= v.version AND (x.nx IS NULL OR x.nx > v.version) GROUP BY v.version")
def visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.visible_at(event_log(spark, sf_dir), spark.createDataFrame([(500,), (3000,), (7000,)], "version int"))


@_query("SELECT max(event_id) + 1 AS version FROM events")
def global_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.global_version(event_log(spark, sf_dir))


@_query(
    "SELECT CAST(user_id AS VARCHAR) AS record_id, event_id // 10 + 1 AS commit_version, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id // 10 + 1 <= 300) WHERE rn = 1 AND event_type <> 'error'"
)
def batch_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(snap.snapshot(event_log(spark, sf_dir, 10, 300), 300)).select("record_id", "commit_version", "event_type", "value")


@_query(
    "SELECT CAST(user_id AS VARCHAR) AS record_id, event_id // 10 + 1 AS commit_version, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"
)
def batch_last_write_wins_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(snap.snapshot(event_log(spark, sf_dir, 10))).select("record_id", "commit_version", "event_type", "value")


@_query(_LOG + f" SELECT DISTINCT s.record_id, n.newest FROM (SELECT DISTINCT record_id FROM log WHERE commit_version > {LATE}) s JOIN (SELECT record_id, max(commit_version) AS newest FROM log GROUP BY record_id) n USING (record_id) WHERE n.newest > {LATE}")
def ww_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    staged = log.where(F.col("commit_version") > LATE).select("space", "table_name", "record_id", F.lit(LATE).alias("snapshot")).distinct()
    return conflicts.write_conflicts(staged, log).select("record_id", "newest")


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events are a transaction that overlaps its neighbours; purchases and errors write."""
    txn = F.floor(F.col("event_id") / 20)
    return table(spark, sf_dir, "events").select(txn.alias("txn"), F.col("user_id").alias("key"), F.col("event_type").isin("purchase", "error").alias("is_write"), txn.alias("begin"), (txn + 3).alias("finish"))


_EDGES = """WITH o AS (SELECT DISTINCT event_id // 20 AS txn, user_id AS key, event_type IN ('purchase', 'error') AS w FROM events),
e AS (SELECT DISTINCT r.txn AS reader, x.txn AS writer FROM o r JOIN o x ON r.key = x.key AND NOT r.w AND x.w AND r.txn <> x.txn AND r.txn < x.txn + 3 AND x.txn < r.txn + 3) """


@_query(_EDGES + "SELECT reader, writer FROM e")
def ssi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.rw_edges(_ops(spark, sf_dir))


@_query(_EDGES + "SELECT a.reader AS a, a.writer AS b FROM e a JOIN e b ON a.reader = b.writer AND a.writer = b.reader WHERE a.reader < a.writer")
def ssi_dangerous_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.dangerous_pairs(_ops(spark, sf_dir))


def _wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events are the log of one transaction."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "begin", "click", "stage", "signup", "committing", "purchase", "committed", "error", "aborted")])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.floor(F.col("event_id") / 10).cast("string")).alias("txn_id"), kind[F.col("event_type")].alias("kind"), F.concat(F.lit("shop/users/"), F.col("user_id").cast("string")).alias("key"))


_WAL = """WITH w AS (SELECT event_id AS seq, 't' || (event_id // 10) AS txn_id, CASE event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'stage' WHEN 'signup' THEN 'committing' WHEN 'purchase' THEN 'committed' ELSE 'aborted' END AS kind, user_id AS key FROM events),
st AS (SELECT txn_id, coalesce(arg_max(kind, seq) FILTER (kind NOT IN ('begin', 'stage')), 'active') AS status FROM w GROUP BY txn_id) """


@_query(_WAL + "SELECT txn_id, status FROM st")
def wal_fold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.transaction_status(_wal(spark, sf_dir))


@_query(
    _WAL
    + ", k AS (SELECT w.txn_id, count(DISTINCT w.key) AS n, count(DISTINCT CASE WHEN l.user_id IS NOT NULL THEN w.key END) AS m FROM w LEFT JOIN (SELECT DISTINCT 't' || (event_id // 10) AS txn_id, user_id FROM events WHERE event_id % 10 < 5) l ON l.txn_id = w.txn_id AND l.user_id = w.key WHERE w.kind = 'stage' GROUP BY w.txn_id) "
    + "SELECT st.txn_id, status, CASE WHEN status IN ('committed', 'aborted') THEN 'skip' WHEN status = 'active' THEN 'abort' WHEN n > 0 AND n = m THEN 'complete' ELSE 'abort' END AS action FROM st LEFT JOIN k ON k.txn_id = st.txn_id"
)
def recovery_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.recovery_actions(_wal(spark, sf_dir), event_log(spark, sf_dir, 10).where("seq < 5"))


@_query(_LOG + " SELECT CAST(commit_version // 1000 AS INTEGER) AS shard, min(record_id) AS key_min, max(record_id) AS key_max, min(commit_version) AS version_min, max(commit_version) AS version_max, count(*) AS n_rows FROM log GROUP BY 1")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.manifest(event_log(spark, sf_dir), F.floor(F.col("commit_version") / 1000)).drop("space", "table_name")


@_query("SELECT s_name AS name, regexp_full_match(s_name, '[A-Za-z0-9._:-]{1,128}') AS valid FROM supplier UNION ALL SELECT p_name, regexp_full_match(p_name, '[A-Za-z0-9._:-]{1,128}') FROM part")
def key_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return names.select("name", keys.valid(F.col("name")).alias("valid"))


@_query("SELECT CAST(user_id AS VARCHAR) AS record_id, substr(sha256('shop/users/' || user_id || '.json'), 1, 24) AS hash FROM (SELECT DISTINCT user_id FROM events)")
def key_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = event_log(spark, sf_dir).select(keys.record_key(F.col("space"), F.col("table_name"), F.col("record_id")).alias("key")).distinct()
    return key.select(keys.parse_record_key(F.col("key")).alias("p"), keys.key_hash(F.col("key")).alias("hash")).select("p.record_id", "hash")


ORDER_SCHEMA = {"type": "object", "required": ["key", "status"], "additionalProperties": False, "properties": {"key": {"type": "integer", "minimum": 10}, "status": {"enum": ["O", "F"]}, "total": {"type": "number", "maximum": 300_000}, "priority": {"type": "string", "minLength": 6, "pattern": "^[1-4]"}}}


@_query(
    "SELECT o_orderkey, CASE WHEN o_orderkey < 10 THEN '$.key' WHEN NOT regexp_matches(o_orderpriority, '^[1-4]') OR length(o_orderpriority) < 6 THEN '$.priority' WHEN o_orderstatus NOT IN ('O', 'F') THEN '$.status' WHEN o_totalprice > 300000 THEN '$.total' END AS fault_path FROM orders"
)
def schema_first_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"))).alias("body"))
    return o.select("o_orderkey", jsonschema.first_fault(ORDER_SCHEMA, F.col("body"))["path"].alias("fault_path"))


def _schema_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang is not null")
    return d.select(F.lit("shop").alias("space"), F.lit("_schema").alias("table_name"), F.concat(F.col("lang"), F.lit("/v"), (F.floor(F.col("doc_id") / 100) + 1).cast("string"), F.lit(".json")).alias("record_id"), F.col("doc_id").alias("commit_version"), F.lit(0).alias("seq"), F.lit(False).alias("deleted"), F.lit("{}").alias("body"), F.lit(0).alias("schema_version"))


@_query("SELECT lang AS name, max(doc_id // 100 + 1) FILTER (doc_id <= 600) AS version FROM documents WHERE doc_id <= 600 AND lang IS NOT NULL GROUP BY lang")
def schema_version_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as schema versions: a language is a name, and every hundredth id begins a version of each."""
    return registry.latest(_schema_log(spark, sf_dir), 600).select("name", F.col("version").cast("long").alias("version"))


@_query("SELECT lang AS name, max(doc_id // 100 + 1) AS version FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL GROUP BY lang")
def schema_version_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(_schema_log(spark, sf_dir)).select("name", F.col("version").cast("long").alias("version"))


#: What a note, the event's kind and its numbers must be; ``value`` falls under additionalProperties.
EVENT_SCHEMA = {"type": "object", "required": ["note", "value"], "properties": {"event_type": {"enum": ["view", "click", "purchase"]}, "note": {"type": "string"}, "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 80}}, "additionalProperties": False}, "tags": {"type": "array", "maxItems": 2, "items": {"type": ["integer", "string"]}}}, "additionalProperties": {"type": "number", "maximum": 60}}


@_query(_LOG + " SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '$.note' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN '$.event_type' WHEN event_id % 3 = 0 THEN '$.note' WHEN k > 80 THEN '$.props.k' WHEN value > 60 THEN '$.value' END AS fault_path FROM log WHERE NOT deleted")
def schema_faults_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing names, nulls, nested and additional properties."""
    log = event_log(spark, sf_dir).where(~F.col("deleted"))
    return log.select((F.col("commit_version") - 1).alias("event_id"), jsonschema.first_fault(EVENT_SCHEMA, F.col("body"))["path"].alias("fault_path"))


@_query("SELECT lang AS name, max(doc_id // 100 + 1) AS version, max(doc_id) AS commit_version FROM documents WHERE lang IS NOT NULL AND doc_id <= (SELECT max(doc_id) * 6 // 10 FROM documents WHERE lang IS NOT NULL) GROUP BY lang")
def schema_listing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schemas visible at six tenths of the newest version, by name."""
    log = _schema_log(spark, sf_dir)
    return registry.latest(log, *_tenths(log, 6)).select("name", F.col("version").cast("long").alias("version"), "commit_version").orderBy("name")


@_query("SELECT event_id, event_id % 5 = 0 AS eq_whole, event_id % 5 = 1 AS eq_fraction, event_id % 5 = 2 AS eq_text, event_id % 5 = 3 AS eq_null, event_id % 5 <> 0 AS ne_whole, event_id % 5 <= 2 AS ge_whole, event_id % 5 = 3 AS lt_whole, event_id % 5 = 2 AS has_text FROM events")
def mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path with whole numbers, fractions, text, null, or nothing there."""
    kinds = F.array(*map(F.lit, ['{"n":1}', '{"n":1.0}', '{"n":"1"}', '{"n":null}', '{"m":1}']))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("body"))
    filters = {"eq_whole": ("eq", 1), "eq_fraction": ("eq", 1.0), "eq_text": ("eq", "1"), "eq_null": ("eq", None), "ne_whole": ("ne", 1), "ge_whole": ("ge", 1), "lt_whole": ("lt", 1), "has_text": ("contains", "1")}
    return rows.select("event_id", *(Filter(op, "n", x).column(F.col("body")).alias(name) for name, (op, x) in filters.items()))


@_query("SELECT event_id FROM events WHERE value > 50")
def json_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a key that a body has twice the last counts."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"value":100,"value":'), F.col("value").cast("string"), F.lit("}")).alias("body"))
    return e.where(Filter("gt", "value", 50).column(F.col("body"))).select("event_id")


@_query(_NEWEST + f"SELECT {_COLS} FROM s WHERE CAST(record_id AS BIGINT) = (SELECT min(CAST(record_id AS BIGINT)) FROM s)")
def point_get_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record's newest version: the visible one of the least user."""
    log = event_log(spark, sf_dir)
    least = snap.snapshot(log).agg(F.min(F.col("record_id").cast("long"))).first()[0]
    return _plain(snap.get(log, str(least)))


@_query("SELECT 't' || user_id AS txn_id, epoch_us(max(ts)) // 1000 AS heartbeat_ms FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error' AND epoch_us(max(ts)) // 1000 < (SELECT epoch_us(max(ts)) // 1000 FROM events) - 60000")
def stale_txn_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(_millis(F.max("ts"))).first()[0] or 0
    txns = e.groupBy("user_id").agg(_millis(F.max("ts")).alias("heartbeat_ms"), F.when(F.max_by("event_type", "event_id") != "error", "active").otherwise("aborted").alias("status")).withColumn("txn_id", F.concat(F.lit("t"), F.col("user_id").cast("string")))
    return conflicts.stale(txns, now, 60_000).select("txn_id", "heartbeat_ms")
