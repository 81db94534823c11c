"""Streams over small files give what the batch operators give."""

import pandas as pd
import pytest

from tracelake.operators import kernels
from tracelake.streaming import sessions


@pytest.fixture
def feed(spark, tmp_path):
    t = [0.0, 0.4, 1.0, 1.9, 2.0, 30.0, 30.5, 31.0, 100.0]
    rows = pd.DataFrame({"session_id": 1, "utc_s": t, "ts": pd.to_datetime(1704067200 + pd.Series(t), unit="s"), "value": range(len(t))})
    for k in range(3):
        spark.createDataFrame(rows.iloc[3 * k : 3 * k + 3]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")), t


def collect(spark, stream, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out").collect()


def test_sessions(spark, feed, tmp_path):
    rows = collect(spark, sessions.sessions(feed[0], late="1 second"), tmp_path)
    assert sorted(r.n for r in rows) == [3, 5]


def test_segments(spark, feed, tmp_path):
    rows = collect(spark, sessions.tumbling(feed[0], late="1 second"), tmp_path)
    assert sorted((r.n, r.largest) for r in rows) == [(3, 7), (5, 4)]


def test_kept_rows(spark, feed, tmp_path):
    stream, t = feed
    rows = collect(spark, sessions.keep_spaced(stream), tmp_path)
    assert sorted(r.utc_s for r in rows) == [x for x, k in zip(t, kernels.keep_spaced(pd.Series(t).to_numpy(), 1.0), strict=True) if k]
