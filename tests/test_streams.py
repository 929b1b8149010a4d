"""Catalog upserts by stream: batches, restarts, whole tables in between, and rows that were there before."""

from __future__ import annotations

import datetime

import pytest

from skuforge.streaming import streams

SCHEMA = "uid long, row_hash string, name string, ts timestamp"


def row(uid, name, hour):
    return uid, f"h{name}", name, datetime.datetime(2024, 1, 1, hour)


def test_upserts_over_restarts(spark, tmp_path):
    source, table, checkpoint = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    with pytest.raises(ValueError):
        streams.current(spark, table)
    streams.start_table(spark.createDataFrame([row(1, "old", 0), row(9, "stays", 0)], SCHEMA), table)
    assert {(r.uid, r.name) for r in streams.current(spark, table).collect()} == {(1, "old"), (9, "stays")}
    steps = [
        ([row(1, "a", 1), row(2, "b", 1), row(2, "b", 1)], {1: "a", 2: "b", 9: "stays"}),
        ([row(2, "d", 3), row(2, "c", 2)], {1: "a", 2: "d", 9: "stays"}),  # the later of a batch
        ([row(1, "e", 4), row(3, "f", 4)], {1: "e", 2: "d", 3: "f", 9: "stays"}),
    ]
    for batch, expected in steps:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streams.upsert_stream(spark, stream, table, checkpoint, late="1 day", every=2).awaitTermination()
        got = streams.current(spark, table).collect()
        assert {r.uid: r["name"] for r in got} == expected and len(got) == len(expected)
    spark.createDataFrame([row(7, "broken off", 5)], SCHEMA).write.parquet(f"{table}/whole/batch=9")  # no mark of its end
    assert {r.uid: r["name"] for r in streams.current(spark, table).collect()} == expected
    assert {r.uid: r["name"] for r in streams.current(spark, table, upto=-1).collect()} == {1: "old", 9: "stays"}
