"""Versions of tables, exports beside writes, receipts, deliveries with retries, and the older store."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from gistmill.operators import lineage_sets
from gistmill.sources import sqlite_store
from gistmill.sources.catalog import Catalog, Conflict, of_scope, of_user
from gistmill.streaming import deliveries

AT = dt.datetime(2024, 1, 1)


def ids(rows, column="id"):
    return sorted(r[column] for r in rows.select(column).collect())


def test_a_commit_is_seen_whole_or_not(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    assert c.tables() == {} and c.manifest()["number"] == 0
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert c.commit({"a": one(1, 2), "b": one(10)}) == 1
    seen = c.tables()
    stale = c.manifest()
    assert c.commit({"a": one(1, 2, 3)}) == 2
    assert ids(seen["a"]) == [1, 2] and ids(c.tables()["a"]) == [1, 2, 3] and ids(c.tables()["b"]) == [10]
    with pytest.raises(Conflict):  # somebody else committed since
        c.commit({"b": one(11)}, since=stale)
    assert ids(c.tables()["b"]) == [10] and c.numbers() == [1, 2]
    c.restore(1)
    assert ids(c.tables()["a"]) == [1, 2] and c.numbers() == [1, 2, 3]


def test_a_repeated_batch_commits_once(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1,)], "id long")
    assert c.commit({"a": rows}, batch=("s", 0)) == 1 and c.commit({"a": rows.limit(0)}, batch=("s", 0)) == 1
    assert ids(c.tables()["a"]) == [1] and c.commit({"a": rows}, batch=("t", 0)) == 2 and c.manifest()["batches"] == {"s": 0, "t": 0}


MEMORY = "id long, scope_id string, author_id long, subject_id long, text string"


def stored(spark, n):
    """A small store in which every memory has a revision, a source and an edge."""
    rows = range(n)
    make = lambda data, schema: spark.createDataFrame(list(data), schema)
    return {
        "users": make([(1, "u", "secret")], "user_id long, name string, password_hash string"), "api_keys": make([(5, 1, "secret")], "id long, user_id long, key_hash string"), "entities": make([("user1",)], "id string"),
        "memberships": make([("x", 1)], "entity_id string, user_id long"), "messages": make([(i, 1, i % 3, "said") for i in rows], "id long, user_id long, session_id long, content string"),
        "memories": make([(i, "own" if i % 2 else "team", 1 if i % 3 else 2, None, "t") for i in rows], MEMORY), "revisions": make([(i, 1, "t") for i in rows], "memory_id long, revision long, text string"),
        "sources": make([(i, i) for i in rows], "memory_id long, message_id long"), "evidence": make([(i, i) for i in rows], "memory_id long, message_id long"),
        "relations": make([(i, i + 1, "extends") for i in rows], "from_id long, to_id long, relation string"), "attention": make([(1, 1)], "id long, user_id long"), "runs": make([(9, 1)], "id long, user_id long"),
        "feedback": make([(9, i) for i in rows], "run_id long, memory_id long"), "calls": make([(1, 1)], "id long, user_id long"),
    }


def test_an_export_beside_a_write_is_of_one_version(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    c.commit(stored(spark, 12))
    parts = lineage_sets.export(c.tables(), 1, "own", "user1")
    c.commit(stored(spark, 40))  # comes between the export's plan and its reading
    lineage_sets.export_to(parts, str(tmp_path / "export"))
    assert len(parts) == 17
    back = {name: spark.read.json(str(tmp_path / "export" / name)) for name in parts}
    own = set(ids(back["memories"]))
    assert own == {i for i in range(12) if i % 2 or i % 3} and set(ids(back["revisions"], "memory_id")) == set(ids(back["sources"], "memory_id")) == set(ids(back["evidence"], "memory_id")) == own
    assert {(r.from_id, r.to_id) for r in back["relations"].collect()} == {(i, i + 1) for i in range(12) if {i, i + 1} <= own}
    assert back["messages"].count() == 12 and back["sessions"].count() == 3 and set(ids(back["feedback"], "memory_id")) == own and back["run_feedback"].count() == 12
    assert "password_hash" not in back["user"].columns and "key_hash" not in back["api_keys"].columns


def test_receipts_outlive_a_restored_version(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    memories = spark.createDataFrame([(1, "own1", 1, None, "x"), (2, "team", 1, None, "y"), (3, "own2", 2, None, "z")], MEMORY)
    messages = spark.createDataFrame([(1, 1), (2, 2)], "id long, user_id long")
    c.commit({"memories": memories, "messages": messages})
    owners = {"memories": of_scope(), "messages": of_user(), "absent": of_user()}
    assert c.receipts().count() == 0 and ids(c.replayed(owners)["memories"]) == [1, 2, 3]
    c.erase(spark.createDataFrame([(1, "own1", AT)], "user_id long, scope_id string, at timestamp"), owners)
    assert ids(c.tables()["memories"]) == [2, 3] and ids(c.tables()["messages"]) == [2]
    c.restore(1)  # a backup from before the erasure
    assert ids(c.tables()["memories"]) == [1, 2, 3]
    again = c.replayed(owners)
    assert ids(again["memories"]) == [2, 3] and ids(again["messages"]) == [2]
    c.commit(again)
    assert ids(c.tables()["memories"]) == [2, 3] and c.receipts().count() == 1


# --- deliveries

CHANGE = "collection string, entity_id long, id long, operation string, payload string"


class Sink:
    """Remembers what it is given, and refuses some entities a number of times."""

    def __init__(self, spark, refuse):
        self.spark, self.refuse, self.got = spark, dict(refuse), []

    def __call__(self, due):
        failed = []
        for r in due.collect():
            if self.refuse.get(r.entity_id, 0) > 0:
                self.refuse[r.entity_id] -= 1
                failed.append((r.collection, r.entity_id))
            else:
                self.got.append((r.entity_id, r.id, r.operation))
        return self.spark.createDataFrame(failed, "collection string, entity_id long")


def moment(seconds):
    return F.lit(AT + dt.timedelta(seconds=seconds)).cast("timestamp")


def test_deliveries_wait_longer_each_time_and_end(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    folder = str(tmp_path / "changes")
    put = lambda *rows: spark.createDataFrame([("m", *r) for r in rows], CHANGE).coalesce(1).write.mode("append").parquet(folder)
    sink = Sink(spark, {2: 1, 3: 99, 4: 1})

    def run(seconds):
        stream = spark.readStream.schema(CHANGE).parquet(folder)
        deliveries.deliver_stream(stream, c, sink, str(tmp_path / "checkpoint"), lambda: moment(seconds)).awaitTermination()

    put((1, 1, "upsert", "a"), (1, 2, "upsert", "b"), (2, 3, "upsert", "c"), (3, 4, "delete", None), (4, 5, "upsert", "old"))
    run(0)
    assert sink.got == [(1, 2, "upsert")]  # the first change of entity 1 was obsolete
    assert {r.entity_id: (r.attempts, r.due) for r in c.tables()["pending"].collect()} == {k: (1, AT + dt.timedelta(seconds=2)) for k in (2, 3, 4)}
    deliveries.retry(c, sink, moment(1))
    assert sink.got == [(1, 2, "upsert")]  # nothing is due yet
    put((4, 9, "upsert", "new"), (1, 1, "upsert", "late"))
    run(1)
    assert sink.got[1:] == [(4, 9, "upsert")]  # a later change goes out at once in the place of the waiting one; what is older than delivered does not
    deliveries.retry(c, sink, moment(2))
    assert sink.got[2:] == [(2, 3, "upsert")]
    at, waits = 2, []
    for _ in range(20):
        left = c.tables()["pending"].collect()
        if not left:
            break
        nxt = int((left[0].due - AT).total_seconds())
        waits.append(nxt - at)
        at = nxt
        deliveries.retry(c, sink, moment(at))
    assert waits == [4, 8, 16, 32, 64, 128]
    assert [(r.entity_id, r.id, r.attempts) for r in c.tables()["dead"].collect()] == [(3, 4, 8)] and sink.refuse[3] == 91
    assert {r.entity_id: r.id for r in c.tables()["delivered"].collect()} == {1: 2, 2: 3, 4: 9}


def test_a_failed_write_and_a_repeated_batch(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    folder = str(tmp_path / "changes")
    spark.createDataFrame([("m", 1, 1, "upsert", "a")], CHANGE).write.parquet(folder)
    good = Sink(spark, {})
    broken = []

    def sink(due):
        if not broken:
            broken.append(1)
            raise RuntimeError("no connection")
        return good(due)

    start = lambda checkpoint: deliveries.deliver_stream(spark.readStream.schema(CHANGE).parquet(folder), c, sink, str(tmp_path / checkpoint), lambda: moment(0))
    with pytest.raises(Exception, match="no connection"):
        start("x").awaitTermination()
    assert c.numbers() == []
    start("x").awaitTermination()  # the batch again
    assert good.got == [(1, 1, "upsert")] and c.numbers() == [1]
    start("y").awaitTermination()  # a lost checkpoint: the same batch number, and nothing is done
    assert good.got == [(1, 1, "upsert")] and c.numbers() == [1]


# --- the older store


def test_the_older_store_is_read_by_ranges(spark, tmp_path):
    path = str(tmp_path / "old store.db")
    con = sqlite3.connect(path)
    ddl = {
        "sessions": "id TEXT PRIMARY KEY, agent_id TEXT, started_at TEXT", "messages": "id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT", "judge_runs": "id INTEGER PRIMARY KEY, cost_usd REAL",
        "memories": "id TEXT PRIMARY KEY, text TEXT, importance REAL, source_role TEXT, vec BLOB", "memory_revisions": "memory_id TEXT, revision INTEGER, text TEXT, PRIMARY KEY (memory_id, revision)",
        "memory_sources": "memory_id TEXT, message_id INTEGER, PRIMARY KEY (memory_id, message_id)", "memory_evidence": "memory_id TEXT, message_id INTEGER, start_char INTEGER, end_char INTEGER, excerpt_sha256 TEXT",
        "retrieval_feedback": "id INTEGER PRIMARY KEY, memory_id TEXT, useful INTEGER",
    }
    for name, columns in ddl.items():
        con.execute(f"CREATE TABLE {name} ({columns}){' WITHOUT ROWID' if name == 'memory_sources' else ''}")
    con.executemany("INSERT INTO messages VALUES (?,?,?,?)", [(i * 7 + 3, f"s{i % 5}", "user", f"é {i}" if i % 10 else None) for i in range(250)])
    con.executemany("INSERT INTO memories VALUES (?,?,?,?,?)", [(f"m{i}", 5 if i == 1 else "t", 1 if i else 0.5, "user", b"\x00\x01") for i in range(40)])
    con.executemany("INSERT INTO memory_revisions VALUES (?,?,?)", [(f"m{i}", r, "t") for i in range(40) for r in (1, 2)])
    con.executemany("INSERT INTO memory_sources VALUES (?,?)", [(f"m{i}", i) for i in range(40)])
    con.execute("INSERT INTO sessions VALUES ('s0', 'a', '2023')")
    con.commit()
    con.close()
    old = sqlite_store.tables(spark, path, rows=100)
    assert len(old) == 8 and old["messages"].rdd.getNumPartitions() > 10
    assert sorted(map(tuple, old["messages"].select("id", "content").collect()), key=str) == sorted([(i * 7 + 3, f"é {i}" if i % 10 else None) for i in range(250)], key=str)
    first = {r.id: r for r in old["memories"].collect()}
    assert (first["m1"].text, first["m1"].importance, first["m0"].importance, bytes(first["m0"].vec)) == ("5", 1.0, 0.5, b"\x00\x01")
    new = sqlite_store.imported(old, F.lit(7), F.lit("own"), pending=True)
    assert all(r.whole for r in lineage_sets.copied(old, new).collect())
    assert {(r.author_id, r.scope_id, r.review_status) for r in new["memories"].collect()} == {(7, "own", "pending")} and {r.review_status for r in new["memory_revisions"].collect()} == {"confirmed"}
    again = sqlite_store.imported(old, F.lit(7), F.lit("own"), held=new)
    assert all(rows.count() == 0 for rows in again.values())
    half = sqlite_store.imported(old, F.lit(7), F.lit("own"), held={"memories": new["memories"].filter("id < 'm2'"), "memory_revisions": new["memory_revisions"].filter("revision = 1")})
    assert half["memories"].count() == new["memories"].filter("id >= 'm2'").count() and half["memory_revisions"].count() == 40
    with pytest.raises(Exception, match="no table"):
        spark.read.format("sqlite_table").option("path", path).option("table", "none").load()
