"""Streaming operators: debounce, progress folding, rates, sessions, deadlines, keyed change application."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import language_of
from ..operators.provenance import settle
from ..operators.reconcile import history_sync


def classify(events: DataFrame) -> DataFrame:
    """Raw file events (kind, path, to) as upserts and deletes: a rename is a delete and an upsert."""
    one = lambda op, path: F.struct(F.lit(op).alias("op"), path.alias("path"))
    each = F.when(F.col("kind") == "rename", F.array(one("delete", F.col("path")), one("upsert", F.col("to")))).when(F.col("kind") == "remove", F.array(one("delete", F.col("path")))).otherwise(F.array(one("upsert", F.col("path"))))
    return events.withColumn("_e", F.explode(each)).select("seq", "ts", "_e.*")


def pending(events: DataFrame) -> DataFrame:
    """Classified events that matter to an index: upserts of files without a known language go, deletes all stay."""
    return classify(events).where((F.col("op") == "delete") | language_of(F.col("path")).isNotNull())


def debounced(events: DataFrame, seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """Batch form: path, open, ts, seq, op (and the columns ``by``: one watcher each; without any there is one).

    A watcher has one window for all its paths. It opens at the first event and does not slide; an event ``seconds`` or
    more after it opens the next. Of a window's events the last of each path is told. Times are taken to microseconds.

    No task sees all events: times fall into buckets as wide as the window, so the next window's opening is found in the
    two buckets that follow. An event after a quiet window opens one whatever was before; from these the openings are
    followed by pointers that double their reach in each round. A pointer of twice the reach is kept only where one of the
    reach before leads, or a window opens for sure: windows that begin at different events soon fall together, so that
    there are ever fewer. Going back from the longest to the shortest, each round finds the openings between those known.
    """
    width, by = max(1, round(seconds * 1_000_000)), list(by)
    bucket = lambda c: F.floor(c / width)
    rows = events.withColumn("_t", F.round(F.col("ts").cast("double") * 1_000_000).cast("long"))
    times = settle(rows.select(*by, "_t").distinct().withColumn("_b", bucket(F.col("_t"))))
    edges = settle(times.groupBy(*by, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last")))
    at = lambda k, **names: edges.select(*by, (F.col("_b") + k).alias("_b"), *[F.col(c).alias(a) for a, c in names.items()])
    # an opening's next one is an event of the next bucket, a window or more later, or else the first of the bucket after
    after = Window.partitionBy(*by, "_b").orderBy("_x").rowsBetween(1, Window.unboundedFollowing)
    asked = times.select(*by, (F.col("_b") + 1).alias("_b"), (F.col("_t") + width - 1).alias("_x"), F.lit(None).cast("long").alias("_e"), F.col("_t").alias("_from"))
    both = asked.unionByName(times.select(*by, "_b", F.col("_t").alias("_x"), F.col("_t").alias("_e"), F.lit(None).cast("long").alias("_from")))
    found = both.withColumn("_next", F.min("_e").over(after)).where("_from is not null").join(at(-1, _then="_first"), [*by, "_b"], "left")
    step = settle(found.select(*by, F.col("_from").alias("_t"), F.coalesce("_next", "_then").alias("_next")).where("_next is not null"))
    before = F.coalesce(F.lag("_t").over(Window.partitionBy(*by, "_b").orderBy("_t")), F.col("_prev"))
    quiet = times.join(at(1, _prev="_last"), [*by, "_b"], "left").withColumn("_before", before)
    opens = settle(quiet.where(F.col("_before").isNull() | (F.col("_t") - F.col("_before") >= width)).select(*by, "_t"))
    # no pointer passes a sure opening, so those that lead to one are not needed
    steps = [settle(step.join(opens.withColumnRenamed("_t", "_next"), [*by, "_next"], "left_anti").select(*by, "_t", "_next"))]
    while not steps[-1].isEmpty():
        step = steps[-1]
        led = step.select(*by, F.col("_next").alias("_t")).unionByName(opens).distinct()
        far = step.select(*by, F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        steps.append(settle(step.join(led, [*by, "_t"]).join(far, [*by, "_next"]).select(*by, "_t", F.col("_far").alias("_next"))))
    for step in reversed(steps[:-1]):
        opens = settle(opens.unionByName(opens.join(step, [*by, "_t"]).select(*by, F.col("_next").alias("_t"))))
    # a bucket has one opening at most; an event lies in the window of its own bucket's or the one before
    own = opens.withColumn("_b", bucket(F.col("_t")))
    placed = rows.withColumn("_b", bucket(F.col("_t")))
    placed = placed.join(own.withColumnRenamed("_t", "_o1"), [*by, "_b"], "left").join(own.select(*by, (F.col("_b") + 1).alias("_b"), F.col("_t").alias("_o0")), [*by, "_b"], "left")
    placed = placed.withColumn("_open", F.when(F.col("_o1") <= F.col("_t"), F.col("_o1")).otherwise(F.col("_o0")))
    last = F.max(F.struct(F.col("ts").cast("double").alias("ts"), F.col("seq").cast("long").alias("seq"), "op")).alias("_l")
    return placed.groupBy(*by, "path", "_open").agg(last).select(*by, "path", (F.col("_open") / 1_000_000).alias("open"), "_l.ts", "_l.seq", "_l.op")


class Debounce(StatefulProcessor):
    """Streaming form: a watcher's first event sets one timer; when it fires, the last event of each path is emitted."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "path string", "seq long, op string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.last.exists()
        for frame in rows:
            newest = frame.sort_values("seq").drop_duplicates("path", keep="last")
            for path, seq, op in zip(newest["path"], newest["seq"], newest["op"]):
                held = self.last.getValue((path,))
                if held is None or held[0] < seq:
                    self.last.updateValue((path,), (int(seq), op))
        if fresh and self.last.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(key[0], k[0], *v) for k, v in self.last.iterator()]
        self.last.clear()
        yield pd.DataFrame(held, columns=["watcher", "path", "seq", "op"])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, by: Sequence[str], processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    """State in RocksDB: the session's ``spark.sql.streaming.stateStore.providerClass`` must name it."""
    return rows.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time)


def debounce_stream(events: DataFrame, millis: int = 1000) -> DataFrame:
    """watcher, path, seq, op. events: path, seq, op, and watcher where there is more than one; a watcher's pending paths
    are the state of one key."""
    named = events if "watcher" in events.columns else events.withColumn("watcher", F.lit(""))
    return _stateful(named.select("watcher", "path", "seq", "op"), ["watcher"], Debounce(millis), "watcher string, path string, seq long, op string", "ProcessingTime")


class Reorder(StatefulProcessor):
    """Holds a run's events until all before them have been told; what follows the terminal one, or repeats, is dropped."""

    def __init__(self, terminal: Sequence[str]):
        self.terminal = tuple(terminal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "seq long", "event string")
        self.next = handle.getValueState("next", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        if at < 0:  # ended
            return
        for frame in rows:
            for seq, event in zip(frame["seq"], frame["event"]):
                if seq >= at and not self.held.containsKey((int(seq),)):
                    self.held.updateValue((int(seq),), (event,))
        out = []
        while at >= 0 and self.held.containsKey((at,)):
            event = self.held.getValue((at,))[0]
            self.held.removeKey((at,))
            out.append((key[0], at, event))
            at = -1 if event in self.terminal else at + 1
        if at < 0:
            self.held.clear()
        self.next.update((at,))
        yield pd.DataFrame(out, columns=["run", "seq", "event"])

    def close(self) -> None:
        pass


def in_order(events: DataFrame, terminal: Sequence[str] = ("done", "failed")) -> DataFrame:
    """A stream of progress events (run, seq from 0, event) in the order of seq, each once, up to the first terminal one.

    They may arrive shuffled and repeated, across batches too. A run's state is what it waits with, and after its end a
    mark.
    """
    return _stateful(events.select("run", F.col("seq").cast("long"), "event"), ["run"], Reorder(terminal), "run string, seq long, event string", "None")


class Deadlines(StatefulProcessor):
    """A timer for each row's status; if it still has that status when event time gets there, the row is overdue."""

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(((int(at), status) for frame in rows for at, status in zip(frame["at"], frame["status"])), default=None)
        if last and (not self.now.exists() or self.now.get()[1] <= last[0]):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.now.update((last[1], last[0]))
            if last[1] in self.limits:
                # the first moment at which the limit is exceeded, in milliseconds
                self.handle.registerTimer((last[0] + self.limits[last[1]]) * 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at = self.now.get()
        self.now.clear()
        yield pd.DataFrame({"path": [key[0]], "status": [status], "status_updated_at": [at]})

    def close(self) -> None:
        pass


def overdue_stream(changes: DataFrame, limits: dict[str, int], late: str = "0 seconds") -> DataFrame:
    """path, status, status_updated_at of rows whose status outlasts its limit in event time, each once: ``overdue`` as a
    stream. changes: path, status, ts (timestamp); a later change of the row takes its timer back."""
    timed = changes.withWatermark("ts", late).select("path", "status", "ts", F.unix_timestamp("ts").alias("at"))
    return _stateful(timed, ["path"], Deadlines(limits), "path string, status string, status_updated_at long", "EventTime")


def posted_commits(posts: DataFrame, late: str) -> DataFrame:
    """A stream of posted commits (project_guid, sha, posted_at as timestamp, and more), each commit once.

    A repeat within ``late`` of the first post is dropped, and so is what arrives later than that; the state forgets a
    commit when the watermark has passed it.
    """
    return posts.withWatermark("posted_at", late).dropDuplicatesWithinWatermark(["project_guid", "sha"])


def sync_posts(stored: Callable[[], DataFrame], since: int, apply: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch of posted commits against what is stored, by ``history_sync``; a project that a batch
    does not name, and what was committed before ``since``, loses nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        own = stored().join(batch.select("project_guid").distinct(), "project_guid", "left_semi")
        apply(history_sync(batch, own, since))

    return run


def sticky_probes(probes: DataFrame) -> DataFrame:
    """run, path, seq, changed, removed, in_flight after each probe (run, path, seq, state).

    changed and removed stay once a probe has shown them, in_flight is that of the last probe. A failed probe (null
    state) leaves all as it was; a path has rows only where it was asked.
    """
    upto = Window.partitionBy("run", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda state: F.coalesce(F.max(F.col("state") == state).over(upto), F.lit(False)).alias(state)
    last = F.coalesce(F.last("state", ignorenulls=True).over(upto) == "in_flight", F.lit(False)).alias("in_flight")
    return probes.select("run", "path", "seq", seen("changed"), seen("removed"), last)


class StickyProbes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "changed boolean, removed boolean, in_flight boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed, removed, in_flight = self.seen.get() if self.seen.exists() else (False, False, False)
        out = []
        for seq, state in sorted((int(s), x) for frame in rows for s, x in zip(frame["seq"], frame["state"].fillna(""))):
            changed, removed = changed or state == "changed", removed or state == "removed"
            in_flight = state == "in_flight" if state else in_flight
            out.append((key[0], key[1], seq, changed, removed, in_flight))
        self.seen.update((bool(changed), bool(removed), bool(in_flight)))
        yield pd.DataFrame(out, columns=["run", "path", "seq", "changed", "removed", "in_flight"])

    def close(self) -> None:
        pass


def sticky_probe_stream(probes: DataFrame) -> DataFrame:
    """The same for a stream whose probes of a path arrive in order."""
    return _stateful(probes.select("run", "path", "seq", "state"), ["run", "path"], StickyProbes(), "run string, path string, seq long, changed boolean, removed boolean, in_flight boolean", "None")


def last_per_flush(events: DataFrame) -> DataFrame:
    """The same within one micro-batch: the last event of each path."""
    return events.groupBy("path").agg(F.max_by(F.struct("seq", "op"), "seq").alias("_l")).select("path", "_l.*")


def flush(apply: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands a batch's upserts and deletes, one per path, to ``apply``."""

    def run(batch: DataFrame, epoch: int) -> None:
        last = last_per_flush(batch)
        apply(last.where("op = 'upsert'"), last.where("op = 'delete'"))

    return run


def rate(samples: DataFrame, seconds: int, key: str = "key") -> DataFrame:
    """key, t, value, per_second: over the window, from the newest sample older than it where there is one, else from the
    key's first. t are whole seconds, each once for a key.

    The older sample is looked up in time buckets as wide as the window: within the one where it must lie, else it is the
    last of the buckets before. So a key's samples are in as many tasks as it has buckets, and only a row per bucket
    meets the key's other ones.
    """
    width, own = max(1, seconds), F.struct("t", "value")
    rows = samples.select(key, "t", "value")
    bucket = lambda c: F.floor(c / width)
    asks = rows.select(key, bucket(F.col("t") - seconds - 1).alias("_b"), (F.col("t") - seconds - 1).alias("_x"), F.lit(1).alias("_ask"), own.alias("_s"))
    both = asks.unionByName(rows.select(key, bucket(F.col("t")).alias("_b"), F.col("t").alias("_x"), F.lit(0).alias("_ask"), own.alias("_s")))
    upto = Window.partitionBy(key, "_b").orderBy("_x", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last(F.when(F.col("_ask") == 0, F.col("_s")), ignorenulls=True).over(upto))
    buckets = both.groupBy(key, "_b").agg(F.max(F.when(F.col("_ask") == 0, F.col("_s"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    firsts = rows.groupBy(key).agg(F.min(own).alias("_first"))
    j = near.where("_ask = 1").join(buckets.select(key, "_b", before.alias("_before")), [key, "_b"]).join(firsts, key)
    old = F.coalesce("_near", "_before", "_first")
    t, v = F.col("_s.t"), F.col("_s.value")
    return j.select(key, t.alias("t"), v.alias("value"), F.when(t > old["t"], (v - old["value"]) / (t - old["t"])).otherwise(0.0).alias("per_second"))


def increase(samples: DataFrame, key: str = "key") -> DataFrame:
    """key, increase of a counter that may restart at zero."""
    before = F.lag("value").over(Window.partitionBy(key).orderBy("t"))
    step = F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value")).otherwise(0)
    return samples.withColumn("_s", step).groupBy(key).agg(F.sum("_s").alias("increase"))


def fold_progress(events: DataFrame) -> DataFrame:
    """Tallies of a run's progress events (run, language, event, chunks)."""
    n = lambda e: F.count_if(F.col("event") == e)
    return events.groupBy("run", "language").agg(n("indexed").alias("indexed"), n("skipped").alias("skipped"), F.coalesce(F.sum(F.when(F.col("event") == "indexed", F.col("chunks"))), F.lit(0)).alias("chunks"), n("error").alias("errors"))


def progress_faults(events: DataFrame, terminal: Sequence[str] = ("done", "failed")) -> DataFrame:
    """run, fault of runs whose events (run, seq, event) do not begin with started, or do not end with the only terminal one."""
    ends = F.col("event").isin(*terminal)
    by = events.groupBy("run").agg(F.min_by("event", "seq").alias("_first"), F.max_by(ends, "seq").alias("_ended"), F.count_if(ends).alias("_ends"))
    fault = F.when(F.col("_first") != "started", "not_started").when(F.col("_ends") == 0, "no_end").when(F.col("_ends") > 1, "several_ends").when(~F.col("_ended"), "events_after_end")
    return by.select("run", fault.alias("fault")).where("fault is not null")


def bucket_quantile(buckets: DataFrame, q: float, key: str = "key") -> DataFrame:
    """key, value: a quantile from cumulative buckets (key, le, count; le null: no bound), linear within a bucket.

    In the last bucket it is the bound below; without any count it is null.
    """
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("le"))
    b = buckets.withColumn("_total", F.max("count").over(Window.partitionBy(key)))
    b = b.withColumn("_low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_before", F.coalesce(F.lag("count").over(w), F.lit(0)))
    rank = F.col("_total") * q
    hit = b.where((F.col("count") >= rank) & (F.col("_before") < rank))
    value = F.when(F.col("le").isNull(), F.col("_low")).otherwise(F.col("_low") + (F.col("le") - F.col("_low")) * (rank - F.col("_before")) / (F.col("count") - F.col("_before")))
    return buckets.select(key).distinct().join(hit.select(key, value.alias("value")), key, "left")


def watermarked(events: DataFrame, late: str | None) -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; with ``late`` a watermark lets a stream close its windows."""
    e = watermarked(events, late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    e = watermarked(events, late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def overdue(files: DataFrame, now: int, limits: dict[str, int]) -> DataFrame:
    """Rows whose status has outlasted its limit in seconds."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col("status")]
    return files.where(F.col("status_updated_at") < F.lit(now) - limit)


def admit(requests: DataFrame, slots: int) -> DataFrame:
    """admitted: the first to arrive gets a file; of those, the first ``slots`` of each project run."""
    first = F.row_number().over(Window.partitionBy("project_guid", "path").orderBy("arrived", "id"))
    claimed = requests.withColumn("_f", first == 1)
    place = F.row_number().over(Window.partitionBy("project_guid", "_f").orderBy("arrived", "id"))
    return claimed.withColumn("admitted", F.col("_f") & (place <= slots)).drop("_f")
