"""Commands end to end: store, pages, indexes, streams."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tagmill.engine import Engine
from tagmill.functions.predicates import Layout, predicate
from tagmill.lang.nodes import Both, Compare, Either, Literal, Not, TagIs
from tagmill.operators import extensions
from tagmill.plans.paging import page
from tagmill.sources.lines import parse_event, parse_lines
from tagmill.sources.store import EventStore
from tagmill.sources.views import events_view
from tagmill.sources.wire import packed
from tagmill.streaming.ingest import ingest_stream, line_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    assert e.execute("INDEX key:price").response() == {"status": "OK"}
    lines = [
        "EVENT in:shop entity:A loc:ca device:phone price:5",
        'EVENT in:shop entity:7 loc:"CA" price:5 code:"5"',
        "EVENT in:shop entity:b loc:ny wifi:true price:9",
        "EVENT in:shop entity:b loc:ca price:12 code:5",
        "EVENT in:shop entity:c device:phone",
        "EVENT in:shop entity:c price:cheap ts:3",
    ]
    assert all(r.error is None for r in e.execute_all(lines, arrival=1000))
    return e


def ids(e, where, rest=""):
    got = e.execute(f"QUERY in:shop where:({where}) {rest}")
    assert got.error is None, got.error
    return got.ids


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("loc:ca", [1, 4]),
        ('loc:"CA"', [2]),
        ("code:5", [2, 4]),
        ('code:"5"', [2, 4]),
        ("loc:ca OR loc:ny", [1, 3, 4]),
        ("loc:ca AND device:phone", [1]),
        ("loc:ny OR (device:phone AND loc:ca)", [1, 3]),
        ("NOT loc:ca", [2, 3, 5, 6]),
        ("NOT device:phone", [2, 3, 4, 6]),
        ("NOT (NOT loc:ca)", [1, 4]),
        ("(loc:ca AND code:5) OR loc:ca", [1, 4]),
        ("loc:mars", []),
        ("price > 5", [3, 4]),
        ("price >= 5", [1, 2, 3, 4]),
        ("price < 9", [1, 2]),
        ("price <= 5", [1, 2]),
        ("price = 5", [1, 2]),
        ("price != 5", [3, 4]),
        ("9 > price", [1, 2]),
        ("9 <= price", [3, 4]),
        ("NOT (price > 5)", [1, 2, 5, 6]),
        ("ts > 999", [1, 2, 3, 4, 5, 6]),
        ("ts > 1000", []),
        ("ts:3", [6]),
        ("entity:a", [1]),
        ("entity:7", [2]),
        ('entity:"7"', []),
    ],
)
def test_filters(filled, where, want):
    assert ids(filled, where) == want


def test_q1_not_covers_the_newest_event_and_no_other_ids(filled):
    assert ids(filled, "NOT loc:ny") == [1, 2, 4, 5, 6]


def test_pages(filled):
    first = filled.execute("QUERY in:shop where:(ts > 0) take:2")
    assert (first.ids, first.next_cursor) == ([1, 2], 3)
    second = filled.execute("QUERY in:shop where:(ts > 0) take:4 cursor:3")
    assert (second.ids, second.next_cursor) == ([3, 4, 5, 6], None)
    assert filled.execute("QUERY in:shop where:(ts > 0) cursor:7").ids == []
    assert len(ids(filled, "ts > 0", "take:4294967296")) == 6  # Q11


def test_objects(filled):
    got = filled.execute("QUERY in:shop where:(entity:7)").response()
    assert got == {"status": "OK", "data": {"objects": [{"id": 2, "in": "shop", "entity": 7, "ts": 1000, "loc": "CA", "price": 5, "code": "5"}]}}
    assert list(got["data"]["objects"][0]) == ["id", "in", "entity", "ts", "loc", "price", "code"]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("QUERY in:nowhere where:(a:b)", "Container does not exist"),
        ("QUERY in:shop where:(size > 5)", "Index does not exist for tag key."),
        ("INDEX key:price", "Duplicate index"),
        ("INDEX key:ts", "Duplicate index"),
        ("NOPE", "Syntax error"),
        ("EVENT in:shop entity:a $", "Unrecognized character or invalid command"),
    ],
)
def test_errors(filled, text, message):
    assert filled.execute(text).response() == {"status": "ERR", "data": {"err_msg": message}}


def test_indexes_begin_with_new_namespaces(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("EVENT in:old entity:a n:5", arrival=1)
    e.execute("INDEX key:n")
    e.execute("EVENT in:old entity:a n:6", arrival=2)
    e.execute("EVENT in:new entity:a n:7", arrival=3)
    assert e.execute("QUERY in:old where:(n > 0)").error == "Index does not exist for tag key."
    assert e.execute("QUERY in:new where:(n > 0)").ids == [1]
    assert e.execute("QUERY in:old where:(ts > 0)").ids == [1, 2]


def test_pipelined_lines_report_their_own_errors(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    got = e.execute_all(["EVENT in:a entity:x", "EVENT in:a", "QUERY in:a where:(ts > 0)"])
    assert [r.error for r in got] == [None, "`entity` tag is required", None]
    assert got[2].ids == [1]


def test_load_and_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(f"EVENT in:n entity:{i} k:{i % 7}" for i in range(1000)) + "\nBROKEN\n")
    e = Engine(spark, str(tmp_path / "s"))
    assert e.load(str(tmp_path / "in"), arrival=5) == 1
    rows = e.store.namespace("n").orderBy("id").select("id", "entity_i64").collect()
    assert [tuple(r) for r in rows] == [(i + 1, i) for i in range(1000)]


def test_stream_is_exactly_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = EventStore(spark, str(tmp_path / "s"))

    def go():
        ingest_stream(store, line_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "c"), refused=str(tmp_path / "bad")).awaitTermination()

    (tmp_path / "in" / "1.txt").write_text("EVENT in:n entity:a\nEVENT in:n entity:b\nnope\n")
    go()
    (tmp_path / "in" / "2.txt").write_text("EVENT in:n entity:c\n")
    go()
    go()
    assert [tuple(r) for r in store.namespace("n").orderBy("id").select("id", "entity_str").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_a_replayed_batch_keeps_its_ids(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    lines = lambda *x: spark.createDataFrame([(f"EVENT in:n entity:{v}", 1, "s", k) for k, v in enumerate(x)], "line string, arrival long, source string, pos long")
    for batch, x in (("1", "ab"), ("2", "cd"), ("2", "cd"), ("1", "ab")):
        store.append(lines(*x), batch)
    assert [tuple(r) for r in store.namespace("n").orderBy("id").select("id", "entity_str").collect()] == list(enumerate("abcd", 1))


def test_pushdown_reaches_the_scan(spark, filled):
    events, layout = filled.store.table("shop")
    plan = events.where(predicate(extensions.expression("price > 5 AND ts > 3"), layout))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ns" in plan
    assert "GreaterThan(idx_price,5)" in plan
    assert "GreaterThan(ts,3)" in plan


_leaf = st.one_of(
    st.builds(TagIs, st.just("event_type"), st.sampled_from(["view", "click", "nope"])),
    st.builds(TagIs, st.just("k"), st.integers(0, 60)),
    st.builds(lambda op, n, swap: Compare(op, Literal(n), Literal("k")) if swap else Compare(op, Literal("k"), Literal(n)), st.sampled_from([">", ">=", "<", "<=", "=", "!="]), st.integers(0, 60), st.booleans()),
)
_tree = st.recursive(_leaf, lambda x: st.one_of(st.builds(Not, x), st.builds(Both, x, x), st.builds(Either, x, x)), max_leaves=8)
_OPS = {">": int.__gt__, ">=": int.__ge__, "<": int.__lt__, "<=": int.__le__, "=": int.__eq__, "!=": int.__ne__}


def selected(e, rows):
    """The set of ids by set algebra."""
    everything = {r["id"] for r in rows}
    match e:
        case TagIs(key, value):
            return {r["id"] for r in rows if r[key] is not None and str(r[key]) == str(value)}
        case Compare(op, Literal(str()), Literal(n)):
            return {r["id"] for r in rows if r["k"] is not None and _OPS[op](r["k"], n)}
        case Compare(op, Literal(n), _):
            return {r["id"] for r in rows if r["k"] is not None and _OPS[op](n, r["k"])}
        case Not(x):
            return everything - selected(x, rows)
        case Both(a, b):
            return selected(a, rows) & selected(b, rows)
        case Either(a, b):
            return selected(a, rows) | selected(b, rows)


@pytest.fixture(scope="module")
def sparse(spark):
    events, layout = events_view(spark, SF, True)
    events = events.where("id <= 300").coalesce(1).cache()
    return events, layout, events.collect()


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(_tree)
def test_predicates_are_set_algebra(sparse, e):
    events, layout, rows = sparse
    assert {r["id"] for r in events.where(predicate(e, layout)).select("id").collect()} == selected(e, rows)


@pytest.mark.parametrize("take", [1, 7, 50, 300])
def test_pages_add_up(sparse, take):
    events, layout, rows = sparse
    where = predicate(extensions.expression("event_type:view OR k < 30"), layout)
    got, cursor = [], None
    while True:
        p = page(events, where, take, cursor)
        got += [r["id"] for r in p.rows]
        cursor = p.next_cursor
        if cursor is None:
            break
        if take == 1 and len(got) >= 5:
            return
    assert got == sorted(r["id"] for r in rows if r["event_type"] == "view" or (r["k"] is not None and r["k"] < 30))


def test_layout_without_columns(spark):
    df = spark.createDataFrame([(1, {"a": "x"}), (2, {}), (3, None)], "id long, tags map<string,string>")
    layout = Layout()
    assert [r["id"] for r in df.where(predicate(extensions.expression("NOT a:x"), layout)).orderBy("id").collect()] == [2, 3]


def _line(rng):
    word = lambda: rng.choice([*["a", "Loc", "x_1", "b", "Z9", "w.w", "k2"] * 6, "5", "007", "5a", "a.b-c", "AND", "count", "in", "9" * 18, "9" * 19, "9" * 20, '"q v"', "-", "_", "x" * 60, "y" * 63, "z" * 129, "é"])
    tags = [f"{word()}:{word()}" for _ in range(rng.choice([0, 1, 2, 3, 40]))]
    return f"{rng.choice(['EVENT', 'event', 'QUERY', 'Event '])} in:{rng.choice(['n', 'N-1', 'system', '5', 'not', 'a.b'])} entity:{word()} " + " ".join(tags) + rng.choice(["", "\n", " ", "\r\n"])


def test_plain_lines_are_cut_up_as_the_parser_does(spark):
    rng = random.Random(1)
    lines = [_line(rng) for _ in range(1500)] + ["EVENT in:a entity:b", "EVENT in:a entity:b k:1 K:2", "EVENT in:a  entity:b k:1", "EVENT in:a entity:b " + " ".join(f"k{i}:{i}" for i in range(32)), "", None]
    df = spark.createDataFrame([(x, 5, "s", k) for k, x in enumerate(lines)], "line string, arrival long, source string, pos long")
    got = {r["pos"]: r.asDict() for r in parse_lines(df).collect()}
    plain = 0
    for k, x in enumerate(lines):
        want = parse_event(x or "")
        if want["error"] is None:
            want |= {"tags": dict(want["tags"]), "tags_i64": dict(want["tags_i64"])}
            plain += 1
        assert {f: got[k][f] for f in want} == want, x
    assert plain > 100


def test_wire(filled):
    got = filled.execute("QUERY in:shop where:(price > 5 OR ts:3) take:2")
    data = got.wire()
    assert data.startswith(b"\x82\xa6status\xa2OK\xa4data\x82\xabnext_cursor\x06\xa7objects\x92\x87\xa2id\x03\xa2in\xa4shop\xa6entity\xa1b")
    assert got.wire_ids() == b"\x82\xa6status\xa2OK\xa4data\x81\xa3ids\x92\x03\x04"
    own = filled.execute("QUERY in:shop where:(ts:3)").wire()  # Q16: the tag ts comes beside the field ts
    assert own.count(b"\xa2ts") == 2 and own.endswith(b"\xa2ts\x03")
    assert filled.execute("NOPE").wire() == b"\x82\xa6status\xa3ERR\xa4data\x81\xa7err_msg\xacSyntax error"
    assert packed((-1, -33, -129, 2**40, "x" * 40, None, True, {"a": 300})) == b"\x98\xff\xd0\xdf\xd1\xff\x7f\xcf\x00\x00\x01\x00\x00\x00\x00\x00\xd9(" + b"x" * 40 + b"\xc0\xc3\x81\xa1a\xcd\x01\x2c"


def test_more_events_than_the_queue_holds(spark, tmp_path):
    e = Engine(spark, str(tmp_path), queue=2)
    got = e.execute_all([f"EVENT in:a entity:{k}" for k in "xyz"])
    assert [r.error for r in got] == [None, None, "Rate limit error, please try again"]
    assert e.execute("QUERY in:a where:(ts > 0)").ids == [1, 2]


def test_merged_batches_keep_ids_and_ignore_replays(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    store.add_index("k")
    lines = lambda n: spark.createDataFrame([(f"EVENT in:n entity:{v} k:{v}", 1, "s", v) for v in range(n)], "line string, arrival long, source string, pos long")
    for batch in "abc":
        store.append(lines(20), batch)
    before = sorted(map(tuple, store.table("n")[0].select("id", "entity_i64", "idx_k").collect()))
    assert (store.compact("n"), store.compact("n")) == (3, 0)
    store.append(lines(20), "b")
    assert sorted(map(tuple, store.table("n")[0].select("id", "entity_i64", "idx_k").collect())) == before
    store.append(lines(3), "d")
    assert sorted(r["id"] for r in store.namespace("n").select("id").collect()) == list(range(1, 64))


def test_a_namespace_opens_its_own_files_only(filled):
    filled.execute("EVENT in:other entity:a", arrival=1)
    files = filled.store.table("shop")[0].inputFiles()
    assert files and all("/ns=shop/" in f for f in files)


@pytest.mark.parametrize("take", [3, 200_000])
def test_large_pages_stay_spread(sparse, take):
    events, layout, rows = sparse
    got = [r["id"] for r in page(events, predicate(extensions.expression("NOT event_type:view"), layout), take).rows]
    assert got == sorted(r["id"] for r in rows if r["event_type"] != "view")[:take]
