"""Snapshots, differences and collection of random histories against a dictionary; transactions on a store."""

import json
import pathlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, NotFound, SchemaViolation, TransactionConflict, TransactionExpired, UnknownTransaction
from tidemark.operators import conflicts
from tidemark.operators import snapshot as snap
from tidemark.operators.query import Filter, OrderBy, Query
from tidemark.schema import LOG
from tidemark.sources.store import Store


def history(seed):
    rng, rows, version = random.Random(seed), [], 0
    for _ in range(rng.randrange(1, 40)):
        version += rng.choice([1, 1, 2])
        for seq in range(rng.choice([1, 1, 3])):
            gone = rng.random() < 0.25
            rows.append(("s", "t", f"r{rng.randrange(6)}", version, seq, gone, None if gone else rng.choice(["1", "1.0", "null", '{"a":1,"b":2}', '{"b":2, "a":1}']), 0, f"t{version}", 0))
    return rows


def model(rows, at):
    out = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        if r[3] <= at:
            out[r[2]] = None if r[5] else r[6]
    return {k: v for k, v in out.items() if v is not None}


@pytest.mark.parametrize("seed", range(6))
def test_random_histories(spark, seed):
    rows = history(seed)
    log, last = spark.createDataFrame(rows, LOG), max(r[3] for r in rows)
    rng = random.Random(seed + 100)
    for _ in range(3):
        a, b = rng.randrange(last + 2), rng.randrange(last + 2)
        assert {r.record_id: r.body for r in snap.snapshot(log, a).collect()} == model(rows, a)
        before, after = model(rows, a), model(rows, b)
        same = lambda x, y: x is not None and y is not None and type(json.loads(x)) is type(json.loads(y)) and json.loads(x) == json.loads(y)
        want = {k: (before.get(k), after.get(k)) for k in before.keys() | after.keys() if not same(before.get(k), after.get(k))}
        assert {r.record_id: (r.before, r.after) for r in snap.diff(log, a, b).collect()} == want
        kept = snap.retained(log, a).collect()
        for at in range(a, last + 1):
            assert model([tuple(r) for r in kept], at) == model(rows, at)
        assert {r.record_id for r in kept} == {r[2] for r in rows}


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert not snap.snapshot(log, 5).count() and not snap.diff(log, 0, 5).count() and not snap.retained(log, 3).count()
    assert snap.global_version(log).first().version == 0


def test_catalogue_against_sql(spark):
    from tidemark.plans import catalogue

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "events orders documents supplier part".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    for name, query in catalogue.QUERIES.items():
        df = query(spark, d)
        got = con.execute(catalogue.ORACLE_SQL[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted((tuple(plain(x) for x in r) for r in got.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want, name


def test_queries_read_the_whole_log(spark):
    """On a table with versions past the constant ones: as the SQL says, and with rows of those versions."""
    from tidemark.plans import catalogue

    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in "events documents".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    names = [x for x in catalogue.QUERIES if x.startswith(("filter_", "order_"))]
    old = [x for x in names if not x.endswith("_newest")]
    assert len(old) == 20 and all(f"{x}_newest" in names for x in old)
    for name in ("snapshot_read_newest", "snapshot_read_share", "snapshot_include_deleted_newest", "diff_share_to_newest", "filter_ge_lt_newest", "order_page_desc_newest", "total_before_filter_newest", "batch_last_write_wins_newest", "schema_version_newest"):
        df = catalogue.QUERIES[name](spark, d)
        got = con.execute(catalogue.ORACLE_SQL[name])
        columns = [x[0] for x in got.description]
        want = sorted((tuple(plain(x) for x in r) for r in got.fetchall()), key=repr)
        rows = df.collect()
        assert want and sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == want, name
        if "commit_version" in columns and name.endswith("_newest"):
            assert max(r.commit_version for r in rows) > (300 if name.startswith("batch") else catalogue.LATE), name


def test_plan_pushes_versions_down(spark, tmp_path):
    """One shuffle, and the version's bound is a filter of the scan."""
    spark.createDataFrame(history(3), LOG).write.parquet(str(tmp_path / "log"))
    plan = snap.snapshot(spark.read.schema(LOG).parquet(str(tmp_path / "log")), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "LessThanOrEqual(commit_version,5)" in plan[plan.index("PushedFilters") :]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ids(frame):
    return [r.record_id for r in frame.collect()]


def batch(spark, **bodies):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "record_id string, body string")


def test_a_harbour_log(store):
    """Ships come and go: schema, filters, sorting, time travel, differences, tombstones."""
    berth = {"type": "object", "required": ["ship"], "properties": {"ship": {"type": "string", "maxLength": 12}, "draught": {"type": "number", "maximum": 20}, "flag": {"enum": ["NO", "GR", None]}}}
    with store.transaction() as t:
        assert t.bind("port", "berths", berth) == 1
    for wrong in ({"ship": "Astrid", "draught": 20.5}, {"draught": 3}, {"ship": "x", "flag": "??"}, ["ship"]):
        with pytest.raises(SchemaViolation):
            store.upsert("port", "berths", wrong)
    empty = store.version()
    fleet = {"north": ("Astrid", 7.5, "NO"), "east": ("Boreas", 12, "GR"), "west": ("Calypso", 4.25, None)}
    for quay, (ship, draught, flag) in fleet.items():
        store.upsert("port", "berths", {"ship": ship, "draught": draught, "flag": flag}, quay)
    deep = store.query("port", "berths", Query((Filter("ge", "draught", 5),), OrderBy("draught", descending=True)))
    assert ids(deep.records) == ["east", "north"] and (deep.total_matched, deep.filtered_count) == (3, 2)
    full = store.version()
    left = store.delete("port", "berths", "east")
    assert store.get("port", "berths", "east") is None and store.get("port", "berths", "east", full)["ship"] == "Boreas"
    gone = store.snapshot("port", "berths", include_deleted=True).where("deleted").collect()
    assert [(r.record_id, r.schema_version) for r in gone] == [("east", 1)]
    assert [(r.record_id, json.loads(r.before)["ship"], r.after) for r in store.diff("port", "berths", full, left).collect()] == [("east", "Boreas", None)]
    assert not store.diff("port", "berths", full, full).count() and not store.snapshot("port", "berths", empty).count()
    with pytest.raises(NotFound):
        store.delete("port", "berths", "south")
    assert store.schema("port", "_table::berths") == berth


def test_schemas_are_listed_by_name(store):
    with store.transaction() as t:
        t.register_schema("a", "zeta", {"type": "string"})
        t.register_schema("a", "alpha", {"type": "integer"})
        t.bind("a", "things", {})
    first = store.version()
    with store.transaction() as t:
        assert t.register_schema("a", "alpha", {"type": "number"}) == 2
    named = lambda at: [(r.name, r.version, r.is_binding) for r in store.schemas("a", at).collect()]
    assert named(None) == [("_table::things", 1, True), ("alpha", 2, False), ("zeta", 1, False)]
    assert named(first)[1] == ("alpha", 1, False) and named(0) == [] and store.schemas("other").count() == 0


def test_order_of_batches_and_records(spark, store):
    """The last write counts, whichever call made it; a transaction reads its own batches."""
    with store.transaction() as t:
        t.upsert_many("s", "t", batch(spark, k="batch", m="batch"))
        assert t.get("s", "t", "k") == "batch"
        t.upsert("s", "t", "later", "k")
        assert t.get("s", "t", "k") == "later"
        t.upsert("s", "t", "first", "n")
        t.upsert_many("s", "t", batch(spark, n="second", o=1))
        t.delete("s", "t", "o")
        assert t.get("s", "t", "n") == "second" and t.get("s", "t", "o") is None
    assert [store.get("s", "t", x) for x in "kmno"] == ["later", "batch", "second", None]
    with pytest.raises(InvalidArgument, match="2 times"):
        store.upsert_many("s", "t", batch(spark, a=1).union(batch(spark, a=2)))
    with pytest.raises(InvalidArgument):
        store.upsert_many("s", "t", spark.createDataFrame([("a/b", "1")], "record_id string, body string"))
    with pytest.raises(InvalidArgument):
        store.upsert_many("s", "t", [])
    with pytest.raises(InvalidArgument):
        store.upsert_many("s", "t", [{"body": 1, "record_id": "fine"}, {"body": 2, "record_id": "not fine"}])
    assert store.version() == 1 and {r.commit_version for r in store.snapshot("s", "t").collect()} == {1}


@pytest.mark.parametrize("batches", [False, True])
@pytest.mark.parametrize("scan", [False, True])
def test_conflicts(spark, store, batches, scan):
    """First committer wins: records that both write, and cycles of reads and writes, by records, batches and queries."""

    def write(t, key, value):
        return t.upsert_many("s", "t", batch(spark, **{key: value})) if batches else t.upsert("s", "t", value, key)

    def read(t):
        return store.query("s", "t", txn=t) if scan else (t.get("s", "t", "x"), t.get("s", "t", "y"))

    store.upsert_many("s", "t", [{"body": 0, "record_id": "x"}, {"body": 0, "record_id": "y"}])
    a, b = store.begin(), store.begin()
    write(a, "k", 1), write(b, "k", 2)
    assert a.commit() == 2 and a.commit() == 2
    with pytest.raises(TransactionConflict):
        b.commit()
    assert b.status == "aborted" and not store.pins
    other = Store(spark, store.path)  # as another process would
    a, b = store.begin(), other.begin()
    read(a), (other.query("s", "t", txn=b) if scan else (b.get("s", "t", "x"), b.get("s", "t", "y")))
    write(a, "x", 1), write(b, "y", 1)
    a.commit()
    with pytest.raises(TransactionConflict):
        b.commit()
    # own reads, disjoint writes and one-sided reads are fine; an empty commit takes no version
    a, b, c = store.begin(), store.begin(), store.begin()
    read(a), write(a, "x", 5), write(b, "z", 5), read(c)
    a.commit(), b.commit()
    at = store.version()
    assert c.commit() == c.snapshot and store.begin().commit() == at == store.version()


def test_random_interleavings(spark, store):
    """Transactions against a model: reads are the snapshot's or own, the last own write counts, cycles and double writes fail."""
    rng, names = random.Random(3), ["p", "q", "r"]
    state, log = {0: {}}, []  # what each version holds; (version, snapshot, reads, writes) of commits
    running = []
    for step in range(40):
        if len(running) < 3:
            running.append((store.begin(), set(), {}))
            continue
        t, reads, writes = rng.choice(running)
        key = rng.choice(names)
        if rng.random() < 0.4:
            assert t.get("s", "t", key) == (writes[key] if key in writes else state[t.snapshot].get(key))
            reads.add(key)
        elif rng.random() < 0.7:
            if rng.random() < 0.3:
                t.upsert_many("s", "t", batch(spark, **{key: step}))
            else:
                t.upsert("s", "t", step, key)
            writes[key] = step
        else:
            running.remove((t, reads, writes))
            later = [c for c in log if c[0] > t.snapshot]
            bad = any(c[3] & writes.keys() or (reads & c[3] and c[2] & writes.keys()) for c in later)
            if bad:
                with pytest.raises(TransactionConflict):
                    t.commit()
            else:
                got, last = t.commit(), max(state)
                assert got == (last + 1 if writes else t.snapshot)
                if writes:
                    state[got] = state[last] | writes
                    log.append((got, t.snapshot, reads, set(writes)))
    assert len(log) > 2
    for at, want in state.items():
        assert {r.record_id: json.loads(r.body) for r in store.snapshot("s", "t", at).collect()} == want


def test_retries_and_reconciling(store):
    for value in (1, 2):
        with store.transaction("order-17") as t:
            t.upsert("s", "t", value, "k")
        assert t.version == 1
    assert store.get("s", "t", "k") == 1 and store.version() == 1
    t = store.begin()
    t.upsert("s", "t", 3, "k")
    real, store._finish = store._finish, lambda *_: None  # the answer is lost after the commit is there
    t.commit()
    store._finish = real
    t.status = "active"
    assert store.reconcile(t) == "committed" and t.version == 2 and store.transaction_by_id(t.txn_id) is t
    t = store.begin()
    t.upsert("s", "t", 4, "k")
    assert store.reconcile(t) == "aborted" and store.get("s", "t", "k") == 3
    t = store.begin()
    t.abort(), t.abort()
    with pytest.raises(UnknownTransaction):
        store.transaction_by_id("none")


def test_hooks(store):
    seen = []
    store.on_commit(lambda version, tables: seen.append((version, tables)))
    store.on_commit(lambda *_: 1 / 0)
    with pytest.warns(UserWarning, match="after version 1"):
        store.upsert("s", "t", 1, "k")
    assert seen == [(1, [("s", "t")])] and store.get("s", "t", "k") == 1


def test_expiry_and_pins(spark, store):
    store.upsert("s", "t", 1, "k")
    t = store.begin()
    assert store.sweep() == 0 and store.sweep(t.heartbeat_ms + 10**6) == 1
    with pytest.raises(TransactionExpired):
        t.upsert("s", "t", 2, "k")
    other = Store(spark, store.path)
    with other.reader() as at:  # vacuum is the first store's
        store.upsert("s", "t", 2, "k")
        store.upsert("s", "t", 3, "k")
        assert store.vacuum() == at == 1 and store.pinned() and not store.pins
        assert other.get("s", "t", "k", at) == 1
    assert not store.pinned()
    store.vacuum()
    assert store.get("s", "t", "k") == 3 and store.log().count() == 1 and not store.commits()
    store.upsert("s", "t", 4, "k")
    assert store.get("s", "t", "k", 3) == 3 and store.get("s", "t", "k") == 4
    with pytest.raises(NotFound):
        store.get("s", "t", "k", 2)
    lost = Store(spark, store.path, lease_ms=-1)
    lost.pin(3)  # its process is gone, and its lease over
    assert store.maintain() == {"expired": 0, "pins": 0, "folded_to": 4, "commits_removed": 1}


def test_folds_answer_as_commits_do(spark, store):
    for i in range(6):
        store.upsert("s", "t" if i % 3 else "u", {"i": i}, f"r{i % 2}")
    store.delete("s", "t", "r1")
    look = lambda: [sorted(tuple(r) for r in store.snapshot("s", t, at, True).collect()) for t in "tu" for at in range(9)] + [store.diff("s", "t", 2, 7).collect()]
    want = look()
    assert store.checkpoint(4) == 4 and look() == want
    assert store.compact() == 7 and look() == want
    store.upsert("s", "t", {"i": 9}, "r9")
    store.delete("s", "t", "r9")
    later = look()
    for x in store._files("_commits"):  # compacted commits are in the fold
        if int(x[:-5]) <= 7:
            store._remove(f"_commits/{x}")
    assert look() == later and Store(spark, store.path).version() == 9


def test_reads_of_a_record_pass_by_other_commits(spark, store):
    for i in range(5):
        store.upsert("s", "t", i, f"r{i % 2}")
    store.upsert_many("s", "t", batch(spark, r0="batch"))
    files = lambda r: len(store.log(None, "s", "t", record_id=r).inputFiles())
    assert files("r1") == 3 and files("r0") == 4 and files("none") == 1  # a batch doesn't say
    assert [store.get("s", "t", r, at) for r in ("r0", "r1", "none") for at in (2, 5, 6)] == [0, 4, "batch", 1, 3, 3, None, None, None]


def test_flush_and_sizes(store):
    store.upsert("s", "t", "x" * 100, "long")
    store.upsert("s", "t", 1, "r")
    store.delete("s", "t", "r")
    assert [tuple(r) for r in store.sizes().collect()] == [("s", "t", 3, 1, 3, 4 + 102 + 64 + 64)]
    assert store.flush(4) == 0 and store.flush(3) == 3 and store.flush(1) == 3
    store.upsert("s", "t", 2, "r")
    assert store.flush(9, 10**6) == 3 and store.flush(9, 0) == 4
    assert store.snapshot("s", "t").count() == 2 and store.log().count() == 4


def test_recovery_and_rebuild(spark, store):
    for i in range(4):
        store.upsert("s", "t", {"i": i}, f"r{i % 2}")
    store.checkpoint()
    store.upsert("s", "t", {"i": 9}, "r9")
    got = {r.record_id: r.body for r in store.snapshot("s", "t").collect()}
    commits = pathlib.Path(store.path, "_commits")
    (commits / f"{6:020d}.json").write_text('{"version": 6, "pa')  # torn, as by a store that writes in place
    (commits / ".aside.tmp").write_text("{}")
    spark.range(1).write.parquet(f"{store.path}/data/lost-1")
    assert {r.record_id: r.body for r in store.snapshot("s", "t").collect()} == got
    assert store.start() == {"completed": 5, "aborted": 1, "torn": 2}
    assert store.upsert("s", "t", 1, "r10")[1] == 6
    got = {r.record_id: r.body for r in store.snapshot("s", "t").collect()}
    for folder in ("_commits", "_folds"):
        for x in store._files(folder):
            store._remove(f"{folder}/{x}")
    fresh = Store(spark, store.path)
    assert fresh.version() == 0 and fresh.start() == {"rebuilt": 6}
    assert {r.record_id: r.body for r in fresh.snapshot("s", "t").collect()} == got
    assert fresh.start() == {"completed": 6, "aborted": 0, "torn": 0}


def test_streams(spark, store, tmp_path):
    """Two streams into one table keep all batches; a batch that comes again after a crash changes nothing."""
    from tidemark.streaming.ingest import into_store

    def run(name):
        stream = spark.readStream.schema("record_id string, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "part-*"))
        into_store(stream, store, "s", "t", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start().awaitTermination(60)

    for name in "pq":
        for i in range(2):
            batch(spark, **{f"{name}{2 * i}": i, f"{name}{2 * i + 1}": i}).coalesce(1).write.parquet(str(tmp_path / name / f"part-{i}"))
        run(name)
    assert sorted(ids(store.snapshot("s", "t"))) == [f"{x}{i}" for x in "pq" for i in range(4)]
    at = store.version()
    store.compact()  # marks outlive the commits' files
    (tmp_path / "p-at" / "commits" / "1").unlink()  # the batch was written, and the stream stopped before it said so
    (tmp_path / "p-at" / "commits" / ".1.crc").unlink(missing_ok=True)
    run("p")
    assert store.version() == at == 4


def test_ssi_edges(spark):
    ops = spark.createDataFrame([(1, "x", False, 0, 9), (1, "y", False, 0, 9), (1, "x", True, 0, 9), (2, "x", False, 0, 9), (2, "y", False, 0, 9), (2, "y", True, 0, 9), (3, "y", True, 20, 21)], "txn int, key string, is_write boolean, begin int, finish int")
    assert [tuple(r) for r in conflicts.dangerous_pairs(ops).collect()] == [(1, 2)]
