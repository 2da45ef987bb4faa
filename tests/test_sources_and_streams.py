import os
from datetime import datetime, timedelta
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corvane.sources import binary, text
from corvane.streaming import windows


def test_binary_round_trips(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(7, 3)).astype("f4")
    (tmp_path / "a.vec").write_bytes(binary.vectors_bytes(x))
    (tmp_path / "a.cls").write_bytes(np.arange(7, dtype="<i4").tobytes())
    (tmp_path / "a.mat").write_bytes(binary.sparse_bytes(4, 5, [(0, 1, 2.0), (3, 4, -1.5)]))
    assert np.array([r["x"] for r in binary.read_vectors(spark, f"{tmp_path}/a.vec").orderBy("id").collect()]) == pytest.approx(x)
    assert [r["v"] for r in binary.read_values(spark, f"{tmp_path}/a.cls").orderBy("id").collect()] == list(range(7))
    assert [tuple(r)[1:] for r in binary.read_sparse(spark, f"{tmp_path}/a.mat").orderBy("i").collect()] == [(4, 5, 0, 1, 2.0), (4, 5, 3, 4, -1.5)]
    assert binary.read_fields(spark, f"{tmp_path}/a.vec").count() == 21


def test_big_endian_records(spark, tmp_path):
    part = lambda b: np.array([len(b)], ">i4").tobytes() + b + np.array([len(b)], ">i4").tobytes()
    (tmp_path / "a.pp").write_bytes(b"".join(part(np.array([3, k], ">i4").tobytes()) + part(np.array([1, 2, k], ">f4").tobytes()) for k in range(2)))
    out = binary.read_big_endian_fields(spark, f"{tmp_path}/a.pp", 2).orderBy("record").collect()
    assert [(r["header"], r["data"]) for r in out] == [([3, 0], [1, 2, 0]), ([3, 1], [1, 2, 1])]


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.svm").write_text("1 1:0.5 3:2\n-1 2:1\n\n")
    rows = text.read_svm(spark, f"{tmp_path}/a.svm", missing=-9).orderBy("label").collect()
    assert [(r["label"], r["x"]) for r in rows] == [(-1, [-9, 1, -9]), (1, [0.5, -9, 2])]
    text.write_svm(text.read_svm(spark, f"{tmp_path}/a.svm"), f"{tmp_path}/b.svm")
    assert text.read_svm(spark, f"{tmp_path}/b.svm").orderBy("label").collect() == text.read_svm(spark, f"{tmp_path}/a.svm").orderBy("label").collect()
    (tmp_path / "a.lvq").write_text("2\n1 2 van\n3 4 bus\n")
    assert sorted((r["label"], r["x"]) for r in text.read_lvq(spark, f"{tmp_path}/a.lvq").collect()) == [("bus", [3, 4]), ("van", [1, 2])]
    (tmp_path / "a.meas").write_text("2020/01/02-03:04:05      10.5 -20 1e-3 2e-4\n")
    m = text.read_measurements(spark, f"{tmp_path}/a.meas")
    assert tuple(m.first())[1:] == (10.5, -20, 1e-3, 2e-4)
    text.write_measurements(m, f"{tmp_path}/b.meas")
    assert text.read_measurements(spark, f"{tmp_path}/b.meas").collect() == m.collect()


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    last = run(spark, windows.k_least(stream(), "event_type", "value", 3), "least", "update")
    best = {r["key"]: r["least"] for r in last.groupBy("key").agg(F.min("least").alias("least")).collect()}
    assert best == {r[0]: sorted(r[1])[:3] for r in e.groupBy("event_type").agg(F.collect_list("value")).collect()}
    grid = run(spark, windows.around_grid(stream().withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 day", "1 day", "60 days"), "around", "append")
    assert {"start", "end", "n", "mean"} == set(grid.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_models_come_back(spark, tmp_path):
    from corvane.operators import borders
    from corvane.sources import models

    found = spark.createDataFrame([(0, [0.5, 0.0], [2.0, 1.0]), (1, [0.4, 0.2], [1.5, -1.0])], "k int, border array<double>, grad array<double>")
    probes = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.3])], "id long, x array<double>")
    models.save(f"{tmp_path}/m", "borders", {"borders": found}, {"classes": [0, 1], "variance": 0.5})
    tables, settings = models.load(spark, f"{tmp_path}/m", "borders")
    assert settings == {"classes": [0, 1], "variance": 0.5}
    assert sorted(borders.classify(probes, tables["borders"]).collect()) == sorted(borders.classify(probes, found).collect())
    try:
        models.load(spark, f"{tmp_path}/m", "svm")
        raise AssertionError
    except ValueError:
        pass


def test_shuffled_arrival_equals_sorted_arrival(spark, tmp_path):
    """Files that come in any order, up to two days late, give the recurrence in the order of time; rows too late go."""
    start = datetime(2024, 1, 1)
    rows = [(k, "a" if k % 3 else "b", start + timedelta(hours=k), float(k % 7)) for k in range(120)]
    order = [r for at in range(0, 120, 30) for r in sorted(rows[at : at + 30], key=lambda r: r[0] * 7919 % 31)]
    parts = [*(order[at : at + 10] for at in range(0, 120, 10)), [(500, "b", start + timedelta(days=40), 1.0)], [(501, "a", start, 1000.0), (502, "a", start + timedelta(days=41), 2.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "id long, key string, ts timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/{k:03d}")
        (tmp_path / "in").mkdir(exist_ok=True)
        (file,) = (tmp_path / f"{k:03d}").glob("*.parquet")
        os.utime(file.rename(tmp_path / "in" / f"{k:03d}.parquet"), (10**9 + k, 10**9 + k))
    stream = spark.readStream.schema("id long, key string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(spark, windows.in_time_order(stream, "key", "ts", "v", 0.9, "2 days", "id"), "ordered", "append").collect()
    for key in "ab":
        level, want = 0.0, []
        for _, k, ts, v in rows:
            if k == key:
                level = 0.9 * level + v
                want.append((ts, pytest.approx(level), len(want) + 1))
        assert sorted((r["time"], r["level"], r["n"]) for r in got if r["key"] == key)[: len(want)] == want
    assert len(got) - len(rows) <= 1


def test_streams_of_many_rows_reach_no_driver(spark, tmp_path, monkeypatch):
    """The rows of a stream in time order are files, not a table in the driver's memory; those that wait are bytes; more rows than one piece."""
    from corvane.plans import streams

    spark.range(700).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + (id * 7919) % 700 * 600) AS ts", "id % 3 AS user_id", "concat('k', id % 2) AS event_type", "id / 10 AS value").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(windows, "PIECE", 100)
    monkeypatch.setattr(streams, "replayed", None)
    got = {r["key"]: (r["n"], r["level"]) for r in streams.REGISTRY.queries["stream_in_time_order"](spark, str(tmp_path)).collect()}
    for key in (0, 1):
        rows = sorted(((k * 7919) % 700, k) for k in range(700) if k % 2 == key and (k * 7919) % 700 * 600 < 699 * 600 - 86400)
        level = 0.0
        for _, k in rows:
            level = 0.5 * level + k / 10
        assert got[f"k{key}"] == (len(rows), pytest.approx(level, abs=1e-6))


def test_grid_containers(spark, tmp_path):
    """Round trip, a file as its layout says byte by byte, and only the pages that are asked for."""
    from corvane.sources import container

    path = str(tmp_path / "grid")
    axes = {"lon": [0.0, 10.0, 20.0], "lat": [-90.0, 0.0], "step": [1, 2, 3, 4, 5]}
    cells = spark.range(30).selectExpr("id % 3 AS i0", "id div 3 % 2 AS i1", "id div 6 AS i2", "cast(id AS float) / 2 AS v")
    flags = spark.range(3).where("id <> 1").selectExpr("id AS i0", "cast(7 + id AS int) AS v")
    container.write_container(spark, path, axes, {"q": (["lon", "lat", "step"], cells.selectExpr("i0", "i1", "i2", "cast(v AS float) AS v")), "flag": (["lon"], flags)}, page=7)
    back = container.read_variable(spark, path, "q", page=48)
    assert sorted(map(tuple, back.collect())) == sorted((k % 3, k // 3 % 2, k // 6, k / 2) for k in range(30))
    assert back.rdd.getNumPartitions() == 3
    assert container.read_variable(spark, path, "q", page=8).rdd.getNumPartitions() == 15
    assert [tuple(r) for r in container.read_variable(spark, path, "flag").orderBy("i0").collect()] == [(0, 7), (1, 0), (2, 9)]
    assert [r["v"] for r in container.read_variable(spark, path, "step").orderBy("i0").collect()] == [1, 2, 3, 4, 5]
    some = back.where("i2 >= 3 and i2 < 4 and i0 = 1")
    assert sorted(map(tuple, some.collect())) == [(1, 0, 3, 9.5), (1, 1, 3, 11.0)]
    reader = container._Reader({"path": path, "variable": "q", "page": "24"})
    list(reader.pushFilters([container.GreaterThanOrEqual(("i2",), 3), container.LessThan(("i2",), 4), container.EqualTo(("i0",), 1)]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(18, 24)]
    import struct

    raw = struct.pack("<q", 3) + struct.pack("<q1sq1sq1s", 1, b"t", 1, b"u", 1, b"w") + struct.pack("<qii", 0, 105, 2) + struct.pack("<iidiid", 2000, 0, 1.5, 2001, 0, 0.25)
    raw += struct.pack("<qi", 0, 0) + struct.pack("<qqi", 1, 0, 212) + struct.pack("<2d", 3.0, 4.0)
    (tmp_path / "raw").write_bytes(raw)
    assert [tuple(r) for r in container.read_variable(spark, str(tmp_path / "raw"), "t").orderBy("i0").collect()] == [(0, 2000, 1.5), (1, 2001, 0.25)]
    assert [r["v"] for r in container.read_variable(spark, str(tmp_path / "raw"), "w").orderBy("i0").collect()] == [3.0, 4.0]
