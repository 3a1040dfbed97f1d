"""Named queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions.predicates import predicate
from tagmill.lang.validate import read
from tagmill.operators import extensions
from tagmill.operators.commands import matches, query_frame, query_page
from tagmill.plans.paging import pages_frame
from tagmill.sources.store import EventStore
from tagmill.sources.views import events_view, orders_view

Query = Callable[[SparkSession, str], DataFrame]
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_VIEW = "WITH ev AS (SELECT event_id + 1 AS id, epoch_us(ts) // 1000 AS ts, user_id AS entity_i64, event_type, {k} AS k FROM events)"
_FULL, _SPARSE = _VIEW.format(k=_K), _VIEW.format(k=f"CASE WHEN {_K} < 50 THEN {_K} END")
_COLUMNS = ["id", "ts", "entity_i64", "event_type", "k"]
#: The evening of the middle day of the events' month, and a day later: both within the data at every scale.
_TS0, _TS1 = 1705352400000, 1705438800000

# name: (expression, SQL predicate, sparse, take, cursor)
_FILTERS: dict[str, tuple[str, str, bool, int | None, int | None]] = {
    "tag_eq": ("event_type:purchase", "event_type = 'purchase'", False, None, None),
    "tag_eq_number": ("k:7", "k = 7", False, None, None),
    "tag_eq_number_quoted": ('k:"7"', "k = 7", False, None, None),
    "tag_miss": ("event_type:mars", "event_type = 'mars'", False, None, None),
    "and_": ("event_type:purchase AND k:7", "event_type = 'purchase' AND k = 7", False, None, None),
    "or_": ("event_type:purchase OR event_type:signup", "event_type IN ('purchase', 'signup')", False, None, None),
    "not_": ("NOT event_type:purchase", "event_type <> 'purchase'", False, None, None),
    "not_missing_tag": ("NOT k:7", "k IS DISTINCT FROM 7", True, None, None),
    "double_not": ("NOT (NOT k:7)", "k IS NOT DISTINCT FROM 7", True, None, None),
    "nested": ("event_type:click OR (event_type:view AND (k:3 OR k:5))", "event_type = 'click' OR (event_type = 'view' AND coalesce(k IN (3, 5), false))", True, None, None),
    "precedence": ("event_type:click OR event_type:view AND k:3", "event_type = 'click' OR (event_type = 'view' AND coalesce(k = 3, false))", True, None, None),
    "not_binds_tight": ("NOT event_type:click AND k:3", "event_type <> 'click' AND k = 3", True, None, None),
    "shared_subexpr": ("(event_type:purchase AND k:7) OR event_type:purchase", "event_type = 'purchase'", True, None, None),
    "gt": ("k > 25", "k > 25", True, None, None),
    "gte": ("k >= 25", "k >= 25", True, None, None),
    "lt": ("k < 25", "k < 25", True, None, None),
    "lte": ("k <= 25", "k <= 25", True, None, None),
    "eq_num": ("k = 25", "k = 25", True, None, None),
    "neq_num": ("k != 25", "k <> 25", True, None, None),
    "reversed_cmp": ("25 > k", "25 > k", True, None, None),
    "not_gt": ("NOT (k > 25)", "NOT coalesce(k > 25, false)", True, None, None),
    "ts_gt": (f"ts > {_TS0}", f"ts > {_TS0}", False, None, None),
    "ts_window": (f"ts > {_TS0} AND ts < {_TS1}", f"ts > {_TS0} AND ts < {_TS1}", False, None, None),
    "ts_or_split": (f"ts < {_TS0} OR ts > {_TS1}", f"ts < {_TS0} OR ts > {_TS1}", False, None, None),
    "tag_and_ts": (f"event_type:view AND ts >= {_TS0}", f"event_type = 'view' AND ts >= {_TS0}", False, None, None),
    "take": ("event_type:purchase", "event_type = 'purchase'", False, 50, None),
    "take_default": ("event_type:purchase OR NOT event_type:purchase", "true", False, None, None),
    "take_large": ("event_type:purchase", "event_type = 'purchase'", False, 4294967296, None),
    "cursor": ("event_type:purchase", "event_type = 'purchase'", False, None, 100),
    "take_cursor": ("event_type:purchase", "event_type = 'purchase'", False, 50, 100),
    "entity_filter": ("NOT entity:12 AND event_type:purchase", "entity_i64 IS DISTINCT FROM 12 AND event_type = 'purchase'", False, None, None),
    "entity_eq": ("entity:12", "entity_i64 = 12", False, None, None),
}


def _command(where: str, take: int | None, cursor: int | None) -> str:
    return f"QUERY in:events where:({where})" + (f" take:{take}" if take else "") + (f" cursor:{cursor}" if cursor else "")


def _filter_query(where: str, sparse: bool, take: int | None, cursor: int | None) -> Query:
    command = read(_command(where, take, cursor))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, layout = events_view(spark, sf_dir, sparse)
        return query_frame(command, events, layout).select(*_COLUMNS)

    return run


def _filter_sql(where: str, sparse: bool, take: int | None, cursor: int | None) -> str:
    more = f" AND id >= {cursor}" if cursor else ""
    return f"{_SPARSE if sparse else _FULL} SELECT {', '.join(_COLUMNS)} FROM ev WHERE ({where}){more} ORDER BY id LIMIT {take or 5000}"


def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unpaged selection: what all pages together hold."""
    events, layout = events_view(spark, sf_dir)
    return matches(read(_command("event_type:purchase OR k < 50", None, None)), events, layout).select(*_COLUMNS)


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a selection, each row with its page's number."""
    events, layout = events_view(spark, sf_dir)
    where = predicate(extensions.expression("event_type:purchase AND k < 10"), layout)
    return pages_frame(events, where, 100).select("id", "page")


def next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, layout = events_view(spark, sf_dir)
    got = query_page(read(_command("event_type:purchase", 50, None)), events, layout)
    return spark.createDataFrame([(len(got.rows), got.next_cursor)], "n long, next_cursor long")


def orders_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same language over another table; quoted values keep their case."""
    events, layout = orders_view(spark, sf_dir)
    command = read('QUERY in:orders where:(priority:"1-URGENT" AND NOT status:"F") take:1000')
    return query_frame(command, events, layout).select("id", "entity_i64", "status", "priority")


def _scratch(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def _event_lines(spark: SparkSession, sf_dir: str, ns: str | None) -> DataFrame:
    """The events table as EVENT commands in order of its times; without ns, each event's namespace is its type."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit("EVENT in:"), F.lit(ns) if ns else F.col("event_type"), F.lit(" entity:"), F.col("user_id").cast("string"), F.lit(" event_type:"), F.col("event_type"), F.lit(" k:"), k)
    return raw.select(line.alias("line"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("arrival"), F.lit("t").alias("source"), F.col("event_id").alias("pos"))


def ingest_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written as commands, ingested, and read back through a query."""
    store = EventStore(spark, _scratch(spark))
    store.append(_event_lines(spark, sf_dir, "copy"), "b1")
    events, layout = store.table("copy")
    return events.where(predicate(extensions.expression("event_type:purchase AND NOT k:7"), layout)).select("id", "ts", "entity_i64", F.col("tags")["event_type"].alias("event_type"), F.col("tags_i64")["k"].alias("k"))


def ingest_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids go on across batches, a batch that is replayed changes nothing, nor does merging the batches."""
    store = EventStore(spark, _scratch(spark))
    lines = _event_lines(spark, sf_dir, "copy")
    early, late = lines.where(F.col("arrival") < _TS0), lines.where(F.col("arrival") >= _TS0)
    store.append(early, "b1")
    store.append(late, "b2")
    store.append(late, "b2")
    store.compact("copy")
    store.append(early, "b1")
    return store.namespace("copy").select("id", "ts", "entity_i64", F.col("tags_i64")["k"].alias("k"))


def index_new_ns_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index covers namespaces that begin after it: the late one has it, the early one has not."""
    store = EventStore(spark, _scratch(spark))
    store.append(_event_lines(spark, sf_dir, "early"), "b1")
    store.add_index("k")
    both = _event_lines(spark, sf_dir, "early").unionByName(_event_lines(spark, sf_dir, "late"))
    store.append(both, "b2")
    late, layout = store.table("late")
    assert "k" not in store.table("early")[1].indexes
    found = late.where(predicate(extensions.expression("k > 50"), layout)).select("ns", "id", F.col("idx_k").alias("k"))
    return found.unionByName(store.namespace("early", ["k"]).where("idx_k is not null").select("ns", "id", F.col("idx_k").alias("k")))


def ns_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces number their events by themselves and are read by themselves."""
    store = EventStore(spark, _scratch(spark))
    store.append(_event_lines(spark, sf_dir, None), "b1")
    return store.namespace("purchase").select("ns", "id", "ts", "entity_i64")


def ext_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.count(*events_view(spark, sf_dir), "event_type:purchase AND NOT k:7")


def ext_count_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.count_by(*events_view(spark, sf_dir), "event_type:purchase", "entity_i64")


def ext_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.count_by(*events_view(spark, sf_dir), "event_type:purchase", "entity_i64", 14)


def ext_distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.distinct_entities(events_view(spark, sf_dir)[0]).select("entity_i64")


def _set_algebra(how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, layout = events_view(spark, sf_dir, True)
        left, right = (predicate(extensions.expression(x), layout) for x in ("event_type:view", "k < 20"))
        return extensions.ids(events.where(extensions.combine(how, left, right)))

    return run


def ext_bitmap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinalities of the inverted index by tag value."""
    events, layout = events_view(spark, sf_dir)
    bits = extensions.bitmap_index(events, layout, ["event_type", "k"])
    return bits.groupBy("key", "value").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))


def ext_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, layout = events_view(spark, sf_dir)
    orders, other = orders_view(spark, sf_dir)
    one = events.where(predicate(extensions.expression("event_type:purchase"), layout)).select("id", "entity_i64")
    two = orders.where(predicate(extensions.expression('status:"F"'), other)).select("id", "entity_i64")
    return extensions.across([("events", one), ("orders", two)])


_SQL: dict[str, str] = {
    "all_matches": f"{_FULL} SELECT {', '.join(_COLUMNS)} FROM ev WHERE event_type = 'purchase' OR k < 50",
    "all_pages": f"{_FULL} SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 100 AS INTEGER) AS page FROM ev WHERE event_type = 'purchase' AND k < 10",
    "next_cursor": f"{_FULL}, m AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM ev WHERE event_type = 'purchase') SELECT count(*) FILTER (r <= 50) AS n, max(id) FILTER (r = 51) AS next_cursor FROM m",
    "orders_nested": "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS entity_i64, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IS DISTINCT FROM 'F' ORDER BY id LIMIT 1000",
    "ingest_event_lines": f"{_FULL} SELECT id, ts, entity_i64, event_type, k FROM ev WHERE event_type = 'purchase' AND k IS DISTINCT FROM 7",
    "ingest_two_batches": f"{_FULL} SELECT id, ts, entity_i64, k FROM ev",
    "index_new_ns_only": f"{_FULL} SELECT 'late' AS ns, id, k FROM ev WHERE k > 50",
    "ns_isolation": f"{_FULL} SELECT 'purchase' AS ns, row_number() OVER (ORDER BY id) AS id, ts, entity_i64 FROM ev WHERE event_type = 'purchase'",
    "ext_count": f"{_FULL} SELECT count(*) AS n FROM ev WHERE event_type = 'purchase' AND k IS DISTINCT FROM 7",
    "ext_count_by_entity": f"{_FULL} SELECT entity_i64, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY entity_i64",
    "ext_having": f"{_FULL} SELECT entity_i64, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY entity_i64 HAVING count(*) >= 14",
    "ext_distinct_entities": f"{_FULL} SELECT DISTINCT entity_i64 FROM ev",
    "ext_bitmap_index": f"{_FULL} SELECT 'event_type' AS key, event_type AS value, count(*) AS n FROM ev GROUP BY event_type UNION ALL SELECT 'k', CAST(k AS VARCHAR), count(*) FROM ev WHERE k IS NOT NULL GROUP BY k",
    "ext_across": f"{_FULL} SELECT id, entity_i64, 'events' AS ns FROM ev WHERE event_type = 'purchase' UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT), 'orders' FROM orders WHERE o_orderstatus = 'F'",
}
_ALGEBRA = {
    "and": "event_type = 'view' AND coalesce(k < 20, false)",
    "or": "event_type = 'view' OR coalesce(k < 20, false)",
    "xor": "(event_type = 'view') <> coalesce(k < 20, false)",
    "andnot": "event_type = 'view' AND NOT coalesce(k < 20, false)",
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _filter_query(w, sparse, take, cursor) for name, (w, _, sparse, take, cursor) in _FILTERS.items()}
    out |= {name: globals()[name] for name in _SQL}
    return out | {f"ext_set_{how}": _set_algebra(how) for how in _ALGEBRA}


def oracle_sql() -> dict[str, str]:
    out = {name: _filter_sql(sql, sparse, take, cursor) for name, (_, sql, sparse, take, cursor) in _FILTERS.items()}
    return out | _SQL | {f"ext_set_{how}": f"{_SPARSE} SELECT id FROM ev WHERE {sql}" for how, sql in _ALGEBRA.items()}
