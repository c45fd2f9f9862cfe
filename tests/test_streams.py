"""Streams with state: the same rows however they are cut into batches; tables kept by buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.streaming import live, upserts


def low_rule():
    def low(bars):
        """The last close is the lowest of the window, over a mean that is full from 4 bars on."""
        close = bars["close"]
        return (close[:, -1] <= np.nanmin(close, axis=1)) & (close[:, -1] < close[:, -4:].mean(1))

    return low


def arrivals():
    rng, rows, number = random.Random(2), [], 0
    for t in range(60):
        for code in ("a", "b"):
            late = rng.random() < 0.15
            rows.append((code, t - 4 if late and t > 4 else t, float(rng.randint(1, 40)), number))
            number += 1
    return rows


def expected(rows, n):
    out, held = [], {}
    for code, ts, close, number in rows:
        own = held.setdefault(code, {})
        own[ts] = close
        known = [own[t] for t in sorted(own) if t <= ts]
        kept = sorted(own)[-n:]
        last = known[-n:]
        full = len(last) >= 4
        out.append((code, ts, number, full and last[-1] <= min(last) and last[-1] < sum(last[-4:]) / 4))
        held[code] = {t: own[t] for t in kept}
    return sorted(out)


def run(spark, rows, batches, path, n):
    df = spark.createDataFrame(rows, "code string, at long, close double, arrival long").select("code", F.timestamp_seconds("at").alias("ts"), "close", "arrival")
    size = -(-len(rows) // batches)
    for k in range(batches):
        df.filter(f"arrival >= {k * size} and arrival < {(k + 1) * size}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    made = live.live_signals(stream, low_rule(), n, ("close",))
    query = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.code, int(r.at), r.arrival, r.buy) for r in spark.read.parquet(f"{path}/out").select("code", F.unix_seconds("ts").alias("at"), "arrival", "buy").collect())


def test_live_signals_do_not_depend_on_the_batches(spark, tmp_path):
    rows = arrivals()
    want = expected(rows, 8)
    assert sum(r[3] for r in want) > 5
    assert run(spark, rows, 1, tmp_path / "one", 8) == want
    assert run(spark, rows, 4, tmp_path / "four", 8) == want


def test_windows_of_bars_in_order_are_those_one_by_one():
    import pandas as pd

    new = pd.DataFrame({"ts": range(5, 12), "x": np.arange(7.0)})
    held = [(k, float(-k)) for k in range(3)]
    fast, kept = live._windows(list(held), new, ["x"], 4)
    slow, now = [], list(held)
    for k in range(len(new)):
        one, now = live._windows(now, new.iloc[k : k + 1], ["x"], 4)
        slow.append(one["x"][0])
    assert np.array_equal(fast["x"], np.array(slow), equal_nan=True) and [tuple(map(float, x)) for x in kept] == [tuple(map(float, x)) for x in now]


def rows_of(spark, path):
    return sorted(tuple(r) for r in upserts.latest(spark, path).collect())


def versions(path):
    return sorted(str(p.relative_to(path)) for p in path.glob("v*/bucket=*"))


def test_upserts_write_only_touched_buckets(spark, tmp_path):
    path, at = str(tmp_path / "table"), tmp_path / "table"
    schema = "code string, close double, volume long"
    many = spark.createDataFrame([(f"c{k}", 1.0, 1) for k in range(200)], schema)
    assert upserts.latest(spark, path) is None
    assert upserts.upsert(many, 0, path, ["code"], "volume", 16) == 16
    one = spark.createDataFrame([("c7", 2.0, 5), ("c7", 3.0, 4)], schema)
    assert upserts.upsert(one, 1, path, ["code"], "volume", 16) == 1
    assert len([v for v in versions(at) if v.startswith("v000000001")]) == 1
    want = sorted([(f"c{k}", 1.0, 1) for k in range(200) if k != 7] + [("c7", 2.0, 5)])
    assert rows_of(spark, path) == want
    # a batch that is run again, and an older row, change nothing
    before = versions(at)
    assert upserts.upsert(one, 1, path, ["code"], "volume", 16) == 0 and versions(at) == before
    upserts.upsert(spark.createDataFrame([("c7", 9.0, 3)], schema), 2, path, ["code"], "volume")
    assert rows_of(spark, path) == want
    upserts.upsert(spark.createDataFrame([("new", 4.0, 1)], schema), 3, path, ["code"], "volume")
    assert rows_of(spark, path) == sorted([*want, ("new", 4.0, 1)])
    # of c7's bucket, written three times, the oldest versions are gone; two manifests are left
    assert len(list(at.glob("manifest-*.json"))) == 2 and len(versions(at)) <= 18
    assert upserts.upsert(many.limit(0), 4, path, ["code"], "volume") == 0


def test_a_batch_that_failed_half_way_is_written_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    schema = "code string, close double, volume long"
    upserts.upsert(spark.createDataFrame([("a", 1.0, 1)], schema), 0, path, ["code"], "volume", 4)
    batch = spark.createDataFrame([("a", 2.0, 2), ("b", 2.0, 2)], schema)

    def broken(self, name, text):
        raise OSError("no manifest")

    with monkeypatch.context() as m:
        m.setattr(upserts._Folder, "put", broken)
        with pytest.raises(OSError, match="no manifest"):
            upserts.upsert(batch, 1, path, ["code"], "volume")
    assert rows_of(spark, path) == [("a", 1.0, 1)]
    assert upserts.upsert(batch, 1, path, ["code"], "volume") > 0
    assert rows_of(spark, path) == [("a", 2.0, 2), ("b", 2.0, 2)]
