"""The keyed table under writes that fail, and the retry queue as a stream."""

import datetime as dt
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from oreframe.sources.keyed import KeyedTable
from oreframe.streaming import retries


def table_rows(table):
    have = table.read()
    return None if have is None else sorted(tuple(r) for r in have.collect())


def slots(path):
    return {f"{d}": os.stat(os.path.join(path, "data", d)).st_mtime_ns for d in os.listdir(os.path.join(path, "data")) if d.startswith("_bucket")}


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ["k"], 8)
    assert table.read() is None
    rows = lambda *x: spark.createDataFrame(x, "k long, at int, x string")
    table.upsert(rows(*[(i, 1, "a") for i in range(100)], (3, 2, "b"), (None, 1, "n")), [F.desc("at")])
    want = sorted(((i, 2 if i == 3 else 1, "b" if i == 3 else "a") for i in range(100)))
    assert table.read().where("k is null").count() == 1
    assert sorted(tuple(r) for r in table.read().where("k is not null").collect()) == want
    before = slots(path)
    table.upsert(rows((5, 9, "new"), (5, 3, "older"), (3, 1, "late")), [F.desc("at")])
    after = slots(path)
    assert 1 <= sum(after[b] != before[b] for b in after) <= 2  # other buckets weren't touched
    got = {r.k: r.x for r in table.read().collect()}
    assert got[5] == "new" and got[3] == "b" and len(got) == 101
    table.upsert(spark.createDataFrame([(5, 10, "x", 1.5)], "k long, at int, x string, more double"), [F.desc("at")])
    assert table.read().where("k = 5").collect()[0].more == 1.5 and table.read().count() == 101
    table.upsert(rows().limit(0), [F.desc("at")])
    with pytest.raises(ValueError):
        KeyedTable(spark, path, ["k"], 9).read()


@pytest.mark.parametrize("when", ["task fails", "killed midway", "before the manifest"])
def test_write_that_ends_midway(spark, tmp_path, when, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    first = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("at"))
    table.upsert(first, [F.desc("at")])
    before = table_rows(table)
    second = spark.range(30, 80).select(F.col("id").alias("k"), F.lit(2).alias("at"))
    if when == "before the manifest":
        with monkeypatch.context() as m:
            m.setattr(KeyedTable, "_commit", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                table.upsert(second, [F.desc("at")])
    elif when == "task fails":
        odd = F.when(F.col("k") == 77, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("at"))
        with pytest.raises(Exception, match="lost"):
            table.merge(second, lambda have, new: have.unionByName(new).withColumn("at", odd))
    else:
        @F.udf("int")
        def slow(x):
            time.sleep(5)
            return x

        failed = []

        def write():
            spark.sparkContext.setJobGroup("doomed", "a write that is killed", interruptOnCancel=True)
            try:
                table.merge(second, lambda have, new: have.unionByName(new).withColumn("at", slow("at")))
            except Exception as e:
                failed.append(e)

        from pyspark import InheritableThread

        t = InheritableThread(target=write)
        t.start()
        time.sleep(6)
        spark.sparkContext.cancelJobGroup("doomed")
        t.join(120)
        assert failed
    assert table_rows(table) == before
    table.upsert(second, [F.desc("at")])
    assert {r.k: r.at for r in table.read().collect()} == {i: 2 if i >= 30 else 1 for i in range(80)}


def test_retry_queue(spark, tmp_path):
    """A filing comes due, is retried and is exhausted; others are parsed, fail for good, or wait."""
    folder, path = tmp_path / "in", str(tmp_path / "queue")
    folder.mkdir()
    t0 = dt.datetime(2024, 1, 1)
    hours = [0]
    for n in range(5):
        hours.append(hours[-1] + 2**n)
    files = [[("a", h, "failed", "llm_api_error:429")] for h in hours]
    files[0] += [("b", 0, "failed", "minimum_data_missing"), ("c", 0, "failed", "503"), ("d", 0, "parsed", None), ("f", 0, "failed", "overloaded")]
    files[1] += [("c", 1, "parsed", None)]
    files[-1] += [("e", hours[-1], "failed", "timeout")]
    files += [[("z", hours[-1], "parsed", None)]]
    for i, rows in enumerate(files):
        f = folder / f"{i}.json"
        f.write_text("".join(json.dumps({"key": k, "at": (t0 + dt.timedelta(hours=h, minutes=i)).isoformat() + "Z", "outcome": o, "error": e}) + "\n" for k, h, o, e in rows))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("key string, at timestamp, outcome string, error string").option("maxFilesPerTrigger", 1).json(str(folder))
    seen = []
    told = retries.retry_queue(stream)
    lock = threading.Lock()

    def note(batch, number):
        with lock:
            seen.extend(batch.collect())

    told.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(300)
    a = [(r.status, r.retry_count) for r in sorted((r for r in seen if r.key == "a"), key=lambda r: (r["at"], r.status != "due"))]
    want = []
    for n in range(1, 6):
        want += [("retry_scheduled", n), ("due", n)]
    assert a == [*want, ("failed", 5)]
    due = {r.retry_count: r["at"] for r in seen if r.key == "a" and r.status == "due"}
    scheduled = {r.retry_count: r.next_retry_at for r in seen if r.key == "a" and r.status == "retry_scheduled"}
    assert due == scheduled
    assert [(r.status, r["at"]) for r in sorted((r for r in seen if r.key == "f"), key=lambda r: r["at"])] == [("retry_scheduled", t0), ("due", t0 + dt.timedelta(hours=1))]  # by its timer alone
    retries.run_queue(told, path, str(tmp_path / "c2")).awaitTermination(300)
    got = {r.key: (r.status, r.retry_count, r.error) for r in KeyedTable(spark, path, ["key"]).read().collect()}
    assert got["a"] == ("failed", 5, "llm_api_error:429:retries_exhausted")
    assert got["b"] == ("failed", 0, "minimum_data_missing") and got["c"][:2] == ("parsed", 0) and got["d"][0] == "parsed" and got["e"] == ("retry_scheduled", 1, "timeout")
    assert got["f"] == ("due", 1, "overloaded")
