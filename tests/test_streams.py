"""Windows, order, deadlines, lateness and probes: batch forms against brute force, stream forms against batch forms."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.streaming import streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, tmp_path, batches, make, schema, name, mode="append"):
    """What ``make`` emits over batches that arrive one after the other, as rows of a table in memory."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        src = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = make(src).writeStream.format("parquet").outputMode(mode).option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(f"{tmp_path}/out")


def brute_windows(events, seconds):
    out, opened = {}, None
    for ts, seq, op, path in sorted((ts, seq, op, path) for path, ts, seq, op in events):
        if opened is None or ts - opened >= seconds:
            opened = ts
        out[path, opened] = (ts, seq, op)
    return {(p, o, *v) for (p, o), v in out.items()}


@pytest.mark.parametrize("case", ["dense", "gaps", "edges", "one"])
def test_debounce_against_brute_force(spark, case):
    r = random.Random(case)
    at = {
        "dense": lambda i: i / 50, "gaps": lambda i: r.choice([0, 40, 41.5, 700]) + r.randrange(40) / 4, "edges": lambda i: 3.0 * r.randrange(60) + r.choice([0, 0, 0.000001, 2.999999]), "one": lambda i: 5.0,
    }[case]
    events = [(f"p{r.randrange(5)}", at(i), i, r.choice(["upsert", "delete"])) for i in range(900)]
    df = spark.createDataFrame(events, "path string, ts double, seq long, op string")
    got = streams.debounced(df, 3.0).select("path", "open", "ts", "seq", "op").collect()
    assert {tuple(x) for x in got} == brute_windows(events, 3.0) and len(got) == len(brute_windows(events, 3.0))


def test_debounce_by_watcher(spark):
    r = random.Random(1)
    events = [("ab"[k % 2], f"p{r.randrange(3)}", r.randrange(300) / 10, k, "upsert") for k in range(300)]
    df = spark.createDataFrame(events, "watcher string, path string, ts double, seq long, op string")
    got = {tuple(x) for x in streams.debounced(df, 2.0, ["watcher"]).collect()}
    assert got == {(w, *x) for w in "ab" for x in brute_windows([e[1:] for e in events if e[0] == w], 2.0)}


def test_debounce_stream_has_one_window(spark, tmp_path, rocks):
    """Two interleaved paths: one timer of the watcher flushes both, the last event of each."""
    schema = "watcher string, path string, seq long, op string"
    rows = [("w", "a", 1, "upsert"), ("w", "b", 4, "upsert"), ("w", "a", 3, "delete"), ("w", "b", 2, "delete"), ("v", "a", 9, "upsert")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/0")
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streams.debounce_stream(src, 1).writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    for _ in range(90):
        if spark.table("debounced").count() >= 3:
            break
        time.sleep(1)
    assert {tuple(r) for r in spark.table("debounced").collect()} == {("w", "a", 3, "delete"), ("w", "b", 4, "upsert"), ("v", "a", 9, "upsert")}
    # the next window opens with the next event
    spark.createDataFrame([("w", "a", 11, "upsert")], schema).write.parquet(f"{tmp_path}/in/1")
    for _ in range(90):
        if spark.table("debounced").count() >= 4:
            break
        time.sleep(1)
    q.stop()
    assert ("w", "a", 11, "upsert") in {tuple(r) for r in spark.table("debounced").collect()}


def test_progress_in_order(spark, tmp_path, rocks):
    """Shuffled and repeated events over several batches come out in order, each once, with one terminal event."""
    r = random.Random(2)
    events = [(run, k, "done" if k == 12 else "started" if k == 0 else f"e{k}") for run in ("x", "y") for k in range(13)]
    events += [("x", 13, "e13"), ("x", 14, "failed"), ("z", 1, "e1")]  # after the end; never begun
    sent = events + r.choices(events, k=20)
    r.shuffle(sent)
    out = feed(spark, tmp_path, [sent[k : k + 15] for k in range(0, len(sent), 15)], streams.in_order, "run string, seq long, event string", "ordered")
    got = [tuple(x) for x in out.collect()]
    assert sorted(got) == sorted(e for e in events if e[0] in "xy" and e[1] <= 12)
    assert [x.fault for x in streams.progress_faults(out).collect()] == []


def test_overdue_stream_agrees_with_overdue(spark, tmp_path, rocks):
    limits, base = {"indexing": 600, "failed": 60}, 1_700_000_000
    r = random.Random(3)
    changes = [(f"f{r.randrange(12)}", r.choice(["indexing", "failed", "indexed"]), base + 50 * k) for k in range(60)]
    now = base + 50 * 60 + 300
    schema = "path string, status string, at long"
    timed = lambda df: df.select("path", "status", F.timestamp_seconds("at").alias("ts"))
    batches = [changes[k : k + 12] for k in range(0, 60, 12)] + [[("clock", "indexed", now)], [("clock", "indexed", now + 1)]]
    got = feed(spark, tmp_path, batches, lambda s: streams.overdue_stream(timed(s), limits), schema, "late").collect()
    assert len(got) == len(set(got))
    last = {p: (s, t) for p, s, t in changes}
    final = spark.createDataFrame([(p, s, t) for p, (s, t) in last.items()], "path string, status string, status_updated_at long")
    want = {tuple(x) for x in streams.overdue(final, now, limits).select("path", "status", "status_updated_at").collect()}
    told = {(x.path, x.status, x.status_updated_at) for x in got}
    # all that are overdue in the end were told; what else was told had outlasted its limit before the next change
    assert want <= told and len(want) >= 4
    after = lambda p, t: min((b for q, _, b in changes if q == p and b > t), default=now)
    assert all(after(p, t) - t > limits[s] for p, s, t in told)


def test_posts_late_and_repeated(spark, tmp_path):
    schema = "project_guid string, sha string, posted long, committed_at long"
    posts = lambda s: streams.posted_commits(s.withColumn("posted_at", F.timestamp_seconds("posted")), "100 seconds").select("project_guid", "sha", "posted", "committed_at")
    batches = [[("p", "a", 1000, 5), ("p", "b", 1010, 6), ("p", "a", 1020, 5)], [("p", "a", 1050, 5), ("q", "a", 1060, 5), ("p", "c", 2000, 7)], [("p", "late", 1500, 7), ("p", "d", 1950, 8)]]
    got = {tuple(x)[:3] for x in feed(spark, tmp_path, batches, posts, schema, "posts").collect()}
    assert {(p, s) for p, s, _ in got} == {("p", "a"), ("p", "b"), ("q", "a"), ("p", "c"), ("p", "d")} and len(got) == 5


def test_sync_of_posts_removes_nothing_before_since(spark, tmp_path):
    """A batch that lacks commits removes those within since only, and none of other projects."""
    schema = "project_guid string, sha string, committed_at long"
    stored = spark.createDataFrame([("p", "old", 10), ("p", "gone", 60), ("p", "same", 70), ("q", "other", 90)], schema)
    changes = []
    spark.createDataFrame([("p", "same", 70), ("p", "new", 80)], schema).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run = streams.sync_posts(lambda: stored, 50, lambda df: changes.extend(tuple(x) for x in df.select("project_guid", "sha", "change").collect()))
    src.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert set(changes) == {("p", "gone", "removed"), ("p", "same", "unchanged"), ("p", "new", "indexed")}


def test_sticky_probes(spark, tmp_path, rocks):
    """A failed probe changes nothing; changed and removed stay; in-flight does not; the stream tells what the batch does."""
    r = random.Random(4)
    rows = [("r", f"p{r.randrange(4)}", k, r.choice(["fresh", "fresh", "fresh", "in_flight", "changed", "removed", None])) for k in range(80)]
    schema = "run string, path string, seq long, state string"
    batch = {tuple(x) for x in streams.sticky_probes(spark.createDataFrame(rows, schema)).collect()}
    want, state = set(), {}
    for run, path, seq, s in rows:
        c, d, f = state.get(path, (False, False, False))
        state[path] = c, d, f = (c or s == "changed", d or s == "removed", s == "in_flight" if s else f)
        want.add((run, path, seq, c, d, f))
    assert batch == want
    out = feed(spark, tmp_path, [rows[:30], rows[30:55], rows[55:]], streams.sticky_probe_stream, schema, "probes")
    assert {tuple(x) for x in out.collect()} == want


def test_rates_against_brute_force(spark):
    """The newest sample older than the window, however far back; else the key's first."""
    r = random.Random(6)
    rows = [("hot", t, float(t % 97)) for t in range(0, 3000, 3)]
    rows += [(k, t, r.random()) for k in "abc" for t in r.sample(range(0, 4000), 60)] + [("one", 5, 1.0), ("far", 0, 2.0), ("far", 100_000, 4.0), ("minus", -50, 1.0), ("minus", -10, 3.0)]
    for seconds in (1, 60, 500):
        want = {}
        for k, t, v in rows:
            older = [(b, w) for j, b, w in rows if j == k and b < t - seconds]
            t0, v0 = max(older) if older else min((b, w) for j, b, w in rows if j == k)
            want[k, t] = (v, (v - v0) / (t - t0) if t > t0 else 0.0)
        got = streams.rate(spark.createDataFrame(rows, "key string, t long, value double"), seconds).collect()
        assert len(got) == len(rows) and {(x.key, x.t): (x.value, pytest.approx(x.per_second)) for x in got} == want
    assert streams.rate(spark.createDataFrame([], "key string, t long, value double"), 60).count() == 0
