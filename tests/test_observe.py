"""Figures from the pass that does the work, also where tasks fail and run again."""

from __future__ import annotations

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import events
from cairn.operators import observe
from cairn.operators.derive import Busy
from cairn.sources import readers


def test_drops_are_counted_by_the_pass_that_writes(spark, tmp_path):
    rows = spark.createDataFrame([(k, "x" * (k % 5)) for k in range(100)], "k long, t string").repartition(4)
    reason = observe.first_reason({"empty": F.length("t") == 0, "odd": F.col("k") % 2 == 1})
    df, seen = observe.counted_reasons(rows.withColumn("reason", reason), F.col("reason"), ["empty", "odd", "never"])
    df.where("reason is null").write.parquet(f"{tmp_path}/kept")
    assert seen.get == {"kept": 40, "empty": 20, "odd": 40, "never": 0} and spark.read.parquet(f"{tmp_path}/kept").count() == 40


def test_a_walk_counts_its_drops(spark, tmp_path):
    c = spark.createDataFrame([(f"s{k}", k, 1, "subject" if k % 3 else "s", "", [{"path": "a"}]) for k in range(50)], "sha string, committed_at long, parent_count int, subject string, body string, paths array<struct<path: string>>")
    walk = readers.kept_commits(c, 50, None, 40, 3)
    df, seen = observe.counted_reasons(walk, F.col("drop"), ["age", "count", "message", "merge", "scope"])
    df.write.parquet(f"{tmp_path}/w")
    counts = {r.drop: r.n for r in readers.drop_counts(walk).collect()}
    assert seen.get == {"kept": counts[None], "age": 0, "count": 10, "message": counts["message"], "merge": 0, "scope": 0}


def test_metered_embedding(spark, tmp_path):
    mark = str(tmp_path / "busy")

    def model(rows):
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise Busy
        return np.ones((len(rows), 2))

    df = spark.createDataFrame([(str(i), "v") for i in range(25)] + [(None, "v")], "t string, _e string").drop("_e").repartition(1)
    out, seen = observe.metered_embedding(df, "t", "embedding", 2, model, wait_s=0.01)
    assert out.columns == ["t", "embedding"] and len(out.collect()) == 26
    got = seen.get
    assert got["texts"] == got["rows"] == 26 and got["busy"] == 1 and got["calls"] >= 2 and got["millis"] >= 10
    out, seen = observe.metered_embedding(df.limit(0), "t", "embedding", 2, model)
    assert out.collect() == [] and seen.get == {"rows": 0, "calls": 0, "busy": 0, "texts": 0, "millis": 0}


RETRIED = """
import os, sys
import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession
from cairn.operators import observe
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def model(rows):
    here = TaskContext.get()
    if here.attemptNumber() == 0 and here.partitionId() == 1 and "90" in rows:  # after other batches of the task
        raise RuntimeError("lost")
    return np.ones((len(rows), 2))
df = spark.range(0, 100, 1, 2).selectExpr("cast(id as string) t")
out, seen = observe.metered_embedding(df, "t", "v", 2, model)
n = len(out.collect())
print("FIGURES", n, seen.get["rows"], seen.get["texts"], seen.get["calls"])
"""


def test_a_task_that_runs_again_counts_once():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", RETRIED], capture_output=True, text=True, timeout=300, cwd=root, env=os.environ | {"PYTHONPATH": root})
    line = [x for x in got.stdout.splitlines() if x.startswith("FIGURES")]
    assert line == ["FIGURES 100 100 100 10"], got.stderr[-2000:]


def test_payload_faults(spark):
    rows = [("started", '{"files": 1, "symbols_only": true, "vectors_only": false, "more": []}'), ("started", "[1]"), ("started", "{"), ("started", None), ("started", '{"files": 1, "symbols_only": true}'), ("error", '{"code": null, "detail": "d"}'), ("nothing", "{}"), (None, "{}")]
    e = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, event string, payload string")
    assert [tuple(r) for r in events.payloads(e, "started").collect()] == [(0, 1, True, False)]
    got = {(r.event, r.reason): r.n for r in events.rejected(e).collect()}
    assert got == {("started", "no_object"): 1, ("started", "broken"): 2, ("started", "vectors_only is missing"): 1, ("error", "code is missing"): 1, ("nothing", "unknown"): 1, (None, "unknown"): 1}
    with pytest.raises(KeyError):
        events.payloads(e, "nothing")
