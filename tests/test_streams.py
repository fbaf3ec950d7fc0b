"""Streams with keyed state and the growing source: equal to their batch forms, restarts and odd files included."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gistmill.operators import curation
from gistmill.sources.growing import GrowingLines
from gistmill.streaming import sessions

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, STORE)
    yield spark
    spark.conf.unset(key)


def ran(stream, tmp_path, name="out"):
    """Runs a stream over what is there, from its checkpoint, and gives all rows written so far."""
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def fed(spark, schema, batches, tmp_path, make):
    """The rows of a stream that is stopped and started again between batches."""
    folder, out = str(tmp_path / "in"), None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        out = ran(make(spark.readStream.schema(schema).parquet(folder)), tmp_path)
    return out


def test_sessions_keep_who_was_seen_first(stateful, tmp_path):
    rng = random.Random(2)
    schema = "session_id long, id long, user_id long, agent string"
    rows = [(rng.randrange(4), i, rng.choice([7, 7, 7, 8]), rng.choice("aab")) for i in range(60)]
    rng.shuffle(rows)  # later batches hold lower ids
    batches = [rows[:20], rows[20:21], rows[21:]]
    got = fed(stateful, schema, batches, tmp_path, sessions.identified)
    arrived = stateful.createDataFrame([(*r, k) for k, b in enumerate(batches) for r in b], f"{schema}, arrived int")
    want = curation.session_conflicts(arrived, "arrived")
    assert {(r.id, r.reason) for r in got.collect()} == {(r.id, r.reason) for r in want.collect()} and got.count() == 60
    assert {r.reason for r in got.collect()} == {None, "other_user", "other_agent"}


def test_windows_and_jobs_equal_the_batch(stateful, tmp_path):
    rng = random.Random(6)
    schema = "queue string, session_id long, id long, closes boolean, urgent boolean"
    rows = []
    for i in range(400):
        session = rng.randrange(6)
        rows.append((f"q{session % 2}", session, i, i % 37 == 36, i % 29 == 5))
    batches = [rows[:90], rows[90:91], rows[91:300], rows[300:]]
    for b in batches:
        rng.shuffle(b)
    got = fed(stateful, schema, batches, tmp_path, lambda s: sessions.windows(s, 4))
    want = curation.window_jobs(stateful.createDataFrame(rows, schema), 4, 5)
    key = ["queue", "session_id", "win", "n", "first_id", "last_id", "done", "reason"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert {r.reason for r in got.collect()} == {"full", "remember", "closed"}
    # windows into jobs, a second stream behind the first
    done = stateful.readStream.schema(got.schema).parquet(str(tmp_path / "out"))
    jobs = ran(sessions.jobs(done, 5), tmp_path, "jobs")
    assert sorted(map(tuple, jobs.select(*key, "job").collect())) == sorted(map(tuple, want.select(*key, "job").collect()))


def test_urgent_messages(spark):
    said = ["Please REMEMBER this: x", "запомни это", "don't  forget", "dont forget", "note that I moved", "I remember", "nothing", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    assert [r.u for r in rows.select("i", curation.urgent(F.col("t")).alias("u")).orderBy("i").collect()] == [True, True, True, True, True, False, False, False]


def line(i, size=10):
    return json.dumps({"n": i, "x": "é" * size}) + "\n"


def numbers(df):
    return sorted(json.loads(r.line)["n"] for r in df.collect())


@pytest.mark.parametrize("part", [64, 1 << 20])
def test_growing_files_are_read_once(spark, tmp_path, part):
    spark.dataSource.register(GrowingLines)
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    a, b = folder / "a.jsonl", folder / "deep" / "b.jsonl"
    read = lambda: spark.readStream.format("growing_lines").option("path", str(folder)).option("partBytes", part).option("maxLineBytes", 400).load()
    a.write_text("".join(line(i) for i in range(20)) + '{"n": 99')  # the last line goes on later
    (folder / "other.txt").write_text("no transcript\n")
    assert numbers(ran(read(), tmp_path)) == list(range(20))
    assert numbers(ran(read(), tmp_path)) == list(range(20))  # nothing new
    with a.open("a") as f:
        f.write(', "x": 1}\n' + line(21) + line(22, 500) + line(23))  # one is longer than any turn
    b.write_text(line(100))
    want = sorted([*range(20), 99, 21, 23, 100])
    assert numbers(ran(read(), tmp_path)) == want
    b.write_text("")  # truncated
    assert numbers(ran(read(), tmp_path)) == want
    b.write_text(line(200) + line(201))
    want = sorted([*want, 200, 201])
    assert numbers(ran(read(), tmp_path)) == want
    os.rename(b, folder / "deep" / "b.old")  # rotated: another file of that name, and longer
    b.write_text("".join(line(i) for i in range(300, 310)))
    want = sorted([*want, *range(300, 310)])
    out = ran(read(), tmp_path)
    assert numbers(out) == want
    rows = [r for r in out.collect() if r.path.endswith("a.jsonl")]
    whole = a.read_bytes()
    assert all(whole[r.start :].startswith(r.line.encode()) for r in rows) and len({r.start for r in rows}) == len(rows)


def test_a_long_line_over_several_batches(spark, tmp_path):
    spark.dataSource.register(GrowingLines)
    folder = tmp_path / "logs"
    folder.mkdir()
    a = folder / "a.jsonl"
    read = lambda: spark.readStream.format("growing_lines").option("path", str(folder)).option("maxLineBytes", 1000).option("partBytes", 300).load()
    a.write_text(line(1) + "x" * 5000)
    assert numbers(ran(read(), tmp_path)) == [1]
    with a.open("a") as f:
        f.write("y" * 200_000)
    assert numbers(ran(read(), tmp_path)) == [1]
    with a.open("a") as f:
        f.write("\n" + line(2))
    assert numbers(ran(read(), tmp_path)) == [1, 2]
