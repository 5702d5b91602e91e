"""Streams give what the batch forms give, however the input is cut into micro-batches."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import subprocess
import sys
import time

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from threadmine import schemas
from threadmine.operators import conversation as V
from threadmine.sources import store
from threadmine.streaming import queues as U
from threadmine.streaming import state as A

T0 = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


def _feed(spark, tmp_path, rows, schema, n_files):
    """Write rows as ``n_files`` files that arrive one after the other."""
    source = tmp_path / "in"
    for i in range(n_files):
        part = rows[i::n_files]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def _run(spark, tmp_path, stream, schema, make=lambda df: df):
    out = str(tmp_path / "out")
    query = U.write_batches(stream, out, str(tmp_path / "progress"), make)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out).drop("batch_id")


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("n_files", [1, 5])
def test_reassembly(spark, tmp_path, n_files):
    rng, rows = random.Random(n_files), []
    for m in range(12):
        n = rng.randint(1, 6)
        rows += [(f"m{m}", "message_chunk", i, f"<{m}.{i}>", _at(m * 10 + i)) for i in range(1, n + 1)]
        rows.append((f"m{m}", "message_start", 0, "", _at(m * 10)))
        if m % 4:
            rows.append((f"m{m}", "message_end", n + 1, "", _at(m * 10 + n + 1)))
    rng.shuffle(rows)
    schema = "message_id string, type string, seq bigint, content string, ts timestamp"
    late = [("zz", "message_start", 0, "", _at(10_000))]
    stream = _feed(spark, tmp_path, rows, schema, n_files)
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = _run(spark, tmp_path, A.reassemble_stream(stream, delay="1 hour"), "message_id string, n_chunks bigint, content string")
    batch = V.reassemble(spark.createDataFrame(rows, schema)).where("complete").select("message_id", "n_chunks", "content")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == 9


@pytest.mark.parametrize("n_files", [1, 4])
def test_conversation_history(spark, tmp_path, n_files):
    rows = [("a", i, "user" if i % 2 else "assistant", f"t{i}", _at(i)) for i in range(1, 13)]
    rows += [("b", 1, "user", "x", _at(1)), ("b", 2, "disconnect", "", _at(2)), ("b", 3, "user", "y", _at(3))]
    random.Random(3).shuffle(rows)
    schema = "connection_id string, seq bigint, role string, content string, ts timestamp"
    stream = _feed(spark, tmp_path, rows, schema, n_files)
    spark.createDataFrame([("zz", 1, "user", "", _at(10_000))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = _run(spark, tmp_path, A.conversation_stream(stream, "1 hour"), "connection_id string, seq bigint, n_turns bigint, n_kept bigint, roles string")
    got = {(r["connection_id"], r["seq"]): (r["n_turns"], r["n_kept"]) for r in out.collect()}
    assert all(got["a", i] == (i, min(i, 8)) for i in range(1, 13))
    assert got["b", 1] == (1, 1) and got["b", 3] == (1, 1) and ("b", 2) not in got


@pytest.mark.parametrize("n_files", [1, 4])
def test_sessions(spark, tmp_path, n_files):
    day = 86_400
    rows = [("s", 1, "touch", _at(0)), ("s", 2, "create", _at(10)), ("s", 3, "touch", _at(20 * day)),
            ("s", 4, "touch", _at(45 * day)), ("s", 5, "touch", _at(80 * day)), ("t", 6, "touch", _at(5))]
    random.Random(5).shuffle(rows)
    schema = "session_id string, seq bigint, kind string, ts timestamp"
    stream = _feed(spark, tmp_path, rows, schema, n_files)
    spark.createDataFrame([("zz", 9, "touch", _at(300 * day))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = _run(spark, tmp_path, A.session_stream(stream, "100 days"), "session_id string, seq bigint, status string, created_ms bigint")
    got = {r["seq"]: r["status"] for r in out.collect()}
    # the touch on day 20 moves the expiry to day 50, the one on day 45 to day 75
    assert got == {1: "invalid", 2: "new", 3: "valid", 4: "valid", 5: "invalid", 6: "invalid"}


@pytest.mark.parametrize("n_files", [3, 7])
def test_session_stream_equals_its_batch_form(spark, tmp_path, n_files):
    """Random sessions of which many run out, cut into micro-batches; a row behind the watermark is dropped."""
    rng, day = random.Random(n_files), 86_400
    rows = [(rng.choice("abcd"), i, rng.choice(["create", "touch", "touch", "touch"]), _at(rng.randint(0, 40 * day) // 43_200 * 43_200))
            for i in range(160)]
    schema = "session_id string, seq bigint, kind string, ts timestamp"
    stream = _feed(spark, tmp_path, rows, schema, n_files)
    for late in ([("zz", 900, "touch", _at(300 * day))], [("zz", 901, "touch", _at(301 * day))],
                 [("a", 902, "create", _at(day)), ("zz", 903, "touch", _at(302 * day))]):
        spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = _run(spark, tmp_path, A.session_stream(stream, "100 days", keep_days=2), "session_id string, seq bigint, status string, created_ms bigint")
    batch = spark.createDataFrame(rows, schema).withColumn("ms", F.unix_millis("ts")).drop("ts")
    want = {(r.session_id, r.seq, r.status, r.created_ms) for r in V.session_fold(batch, keep_days=2).collect()}
    assert {tuple(r) for r in out.collect() if r.session_id != "zz"} == want
    assert {s for _, _, s, _ in want} == {"new", "valid", "invalid"}


def test_many_sessions_cost_little_state_each(spark, tmp_path):
    """Sessions share groups, null ids and requests without a number too; a group's requests of many days, some in a
    session that lives since an earlier micro-batch, are classified at once. With state of its own for each request this takes minutes."""
    rng, day = random.Random(3), 86_400
    rows = [(rng.choice([None, *range(1_500)]), i, rng.choice(["create", "touch", "touch", None]), _at(rng.randint(0, 30 * day)))
            for i in range(6_000)]
    rows = [(None if k is None else str(k), seq, kind, ts) for k, seq, kind, ts in rows]
    schema = "session_id string, seq bigint, kind string, ts timestamp"
    rows.sort(key=lambda r: r[3])
    stream = _feed(spark, tmp_path, rows[:3_000], schema, 1)
    rows.append(("x", None, "create", _at(20 * day)))
    for part in (rows[3_000:], [("zz", 9, "touch", _at(200 * day))], [("zz", 10, "touch", _at(201 * day))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = time.time()
    out = _run(spark, tmp_path, A.session_stream(stream, "1 day", keep_days=4, groups=7),
               "session_id string, seq bigint, status string, created_ms bigint")
    took = time.time() - start
    batch = spark.createDataFrame(rows, schema).withColumn("ms", F.unix_millis("ts")).drop("ts")
    want = {(r.session_id, r.seq, r.status, r.created_ms) for r in V.session_fold(batch, keep_days=4).collect()}
    got = {tuple(r) for r in out.collect() if r.session_id != "zz"}
    assert got == want
    assert took < 60, took


def test_sessions_go_on_over_a_long_step_of_the_watermark():
    """A session that lives is known to requests that become final long after it would have run out."""
    known = pd.DataFrame({"session_id": ["a", "b"], "created": [1, 2], "last": [90, 10]})
    asked = pd.DataFrame({"session_id": ["a", "a", "b", "a", None], "ms": [150, 100, 300, 400, 5], "seq": [2, 1, 3, 4, 5], "unnumbered": False,
                          "create": [False, False, False, True, False]})
    rows, after = A.classified(asked, known, 100)
    got = {r.seq: (r.status, None if pd.isna(r.created_ms) else r.created_ms) for r in rows.itertuples()}
    assert got == {1: ("valid", 1), 2: ("valid", 1), 3: ("invalid", None), 4: ("new", 400), 5: ("invalid", None)}
    assert after.values.tolist() == [["a", 400, 400]]


@pytest.mark.parametrize("block", [1, 3_600_000, 10**12])
def test_session_fold_equals_plain_loops(spark, block):
    rng, hour = random.Random(7), 3_600_000
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["create", "touch", "touch"]), rng.randint(0, 60) * 12 * hour) for i in range(200)]
    rows += [("hot", 1000 + i, "create" if i == 3 else "touch", i * 60_000) for i in range(400)]
    want, state = [], {}
    for session, seq, kind, ms in sorted(rows, key=lambda r: (r[3], r[1])):
        created, last = state.get(session, (None, None))
        if created is not None and ms > last + 24 * hour:
            created = None
        status = "new" if kind == "create" else "invalid" if created is None else "valid"
        created = ms if kind == "create" and created is None else created
        state[session] = (created, ms)
        want.append((session, seq, status, created))
    got = V.session_fold(spark.createDataFrame(rows, "session_id string, seq bigint, kind string, ms bigint"), 1, block)
    assert sorted(((r.session_id, r.seq, r.status, r.created_ms) for r in got.collect()), key=str) == sorted(want, key=str)


def test_a_message_that_waits_too_long_is_forgotten(spark, tmp_path):
    rows = [("m", "message_start", 0, "", _at(0)), ("m", "message_chunk", 1, "x", _at(1)), ("m", "message_end", 2, "", _at(90_000)),
            ("n", "message_start", 0, "", _at(0)), ("n", "message_chunk", 1, None, _at(2)), ("n", "message_end", 2, "", _at(80_000))]
    schema = "message_id string, type string, seq bigint, content string, ts timestamp"
    stream = _feed(spark, tmp_path, rows, schema, 3)
    spark.createDataFrame([("zz", "message_start", 0, "", _at(500_000))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = _run(spark, tmp_path, A.reassemble_stream(stream, "2 days"), "message_id string, n_chunks bigint, content string")
    assert [tuple(r) for r in got.collect()] == [("n", 1, "")]


def test_queue_decoding_keeps_bad_messages_aside(spark, tmp_path):
    source = tmp_path / "q"
    source.mkdir()
    good = {"connection_id": "c", "domain_name": "d", "stage": "s", "message": "hi", "request_id": "r", "timestamp": "t"}
    (source / "1.txt").write_text(json.dumps(good) + "\n{broken\n")
    (source / "2.txt").write_text(json.dumps({**good, "connection_id": "unknown"}) + "\n" + json.dumps({**good, "stage": ""}) + "\n")
    decoded = U.decode(U.read_queue(spark, str(source), 1), schemas.CHAT_MESSAGE)
    live = spark.createDataFrame([("c", 10), ("old", 5)], "connection_id string, ttl int")
    (source / "3.txt").write_text(json.dumps({**good, "connection_id": "old"}) + "\n")
    sinks, out = U.chat_sinks(live, lambda b: b.select("request_id", "connection_id"), lambda: F.lit(5)), str(tmp_path / "out")
    U.consume(decoded, out, str(tmp_path / "progress"), sinks).awaitTermination()
    answers = U.read_sink(spark, out, "answers", "request_id string, connection_id string")
    assert [tuple(r) for r in answers.drop("batch_id").collect()] == [("r", "c")]
    assert [r["body"] for r in U.read_sink(spark, out, "corrupt", "body string").collect()] == ["{broken"]
    counts = U.read_sink(spark, out, "counts", "processed bigint, failed bigint").groupBy().sum("processed", "failed").first()
    assert tuple(counts) == (4, 1)


def test_sinks_of_a_batch_are_committed_together(spark, tmp_path):
    """A batch that fails at its last sink leaves nothing to read; repeated, each of its rows is there once."""
    source, out = tmp_path / "q", str(tmp_path / "out")
    source.mkdir()
    for i in range(2):
        (source / f"{i}.txt").write_text(json.dumps({"request_id": f"r{i}"}) + "\n")
        os.utime(source / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    fail = {"on": True}

    def sinks(batch):
        rows = batch.select("request_id")
        late = rows.select(F.assert_true(F.lit(not fail["on"]) | (F.col("request_id") == "r0")).cast("string").alias("x"))
        return {"first": rows, "last": late}

    def run():
        decoded = U.decode(U.read_queue(spark, str(source), 1), schemas.CHAT_MESSAGE)
        U.consume(decoded, out, str(tmp_path / "progress"), sinks).awaitTermination()

    with pytest.raises(Exception):
        run()
    assert [r.request_id for r in U.read_sink(spark, out, "first", "request_id string").collect()] == ["r0"]
    fail["on"] = False
    run()
    assert sorted(r.request_id for r in U.read_sink(spark, out, "first", "request_id string").collect()) == ["r0", "r1"]


def test_seen_table_batches(spark, tmp_path):
    out, name = str(tmp_path / "fresh"), "t_seen"
    store.create_seen(spark, name, 3)
    run = U.seen_table_batch(
        spark, name, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), lambda: F.lit(100), days=1)

    def feed(i, ids):
        run(spark.createDataFrame([(x, "f") for x in ids], "id string, subreddit_name string"), i)

    for i, batch in enumerate((["1", "2", "2"], ["2", "3"])):
        feed(i, batch)
    size = spark.table(name).count()
    feed(1, ["2", "3"])  # repeated after a failure: the same rows again
    got = spark.read.schema("id string, subreddit_name string, batch_id int").parquet(out)
    assert sorted((r["id"], r["batch_id"]) for r in got.collect()) == [("1", 0), ("2", 0), ("3", 1)]
    assert size == 3
    before = {tuple(r) for r in spark.table(name).drop("batch").collect()}
    store.compact_seen(spark, name, F.lit(100))
    assert {tuple(r) for r in spark.table(name).drop("batch").collect()} == before and spark.table(name).count() == 3
    # the table's side of the comparison is read by buckets and not shuffled
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = spark.createDataFrame([("9", "f")], "post_id string, subreddit string").join(spark.table(name), store.SEEN_KEYS, "left_anti")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    store.compact_seen(spark, name, F.lit(100 + 86_400))
    assert spark.table(name).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_retention_drops_repeats_and_old_messages(spark, tmp_path):
    rows = [("a", _at(0)), ("a", _at(5)), ("b", _at(1)), ("old", _at(0) - dt.timedelta(days=1))]
    stream = _feed(spark, tmp_path, rows, "request_id string, ts timestamp", 3)
    got = _run(spark, tmp_path, U.with_retention(stream, "ts", U.CHAT_RETENTION, "request_id", F.lit(_at(5))), "request_id string")
    assert sorted(r["request_id"] for r in got.collect()) == ["a", "b"]


def test_a_long_message_is_joined_in_blocks(spark):
    rows = [("m", "message_chunk", i, f"{i},") for i in range(1, 2001)] + [("m", "message_start", 0, "")]
    random.Random(1).shuffle(rows)
    r = V.reassemble(spark.createDataFrame(rows, "message_id string, type string, seq bigint, content string")).first()
    assert r["content"] == "".join(f"{i}," for i in range(1, 2001)) and r["n_chunks"] == 2000 and not r["complete"]


def test_history_of_a_hot_conversation(spark):
    rows = [("hot", i, "user", str(i)) for i in range(5000)] + [("cold", i, "user", str(i)) for i in range(8)]
    turns = spark.createDataFrame(rows, "h string, turn int, role string, content string").repartition(8)
    kept = V.trim_history(turns, ["h"], ["turn"]).collect()
    assert sorted(r["turn"] for r in kept if r["h"] == "hot") == [0, *range(4993, 5000)]
    assert sorted(r["turn"] for r in kept if r["h"] == "cold") == list(range(8))


@pytest.mark.parametrize("processor", [A._Reassembly(1), A._History(1, 3), A._Session(1)])
def test_processors_travel_by_value(tmp_path, processor):
    """The process beside the driver's JVM that opens the state has no package sent to it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = "import pickle, sys; assert pickle.load(sys.stdin.buffer).keep_ms == 1 and 'threadmine' not in sys.modules"
    subprocess.run([sys.executable, "-c", script], input=cloudpickle.dumps(processor), cwd=tmp_path, env=env, check=True)


def test_typed_state_needs_no_setting_of_the_session(spark, tmp_path):
    setting, plain = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(setting)
    spark.conf.set(setting, plain)
    try:
        stream = _feed(spark, tmp_path, [("s", 1, "create", _at(0)), ("s", 2, "touch", _at(5))], "session_id string, seq bigint, kind string, ts timestamp", 1)
        spark.createDataFrame([("zz", 3, "touch", _at(10_000))], stream.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = _run(spark, tmp_path, A.session_stream(stream), "session_id string, seq bigint, status string, created_ms bigint")
        assert {r.seq: r.status for r in out.collect() if r.session_id == "s"} == {1: "new", 2: "valid"}
        assert spark.conf.get(setting) == plain
    finally:
        spark.conf.set(setting, before)
