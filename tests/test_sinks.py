"""Writing clip files with commit and abort, streams of clip files, keyed balanced lookups and SQL table functions."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import expr
from cliploom.schema import clip
from cliploom.sources import decode, files, index, load, wav
from cliploom.streaming import stream_clip_files


def clips(spark, n=20, parts=5):
    rows = [(i, [[i / 32.0, -i / 32.0, 0.25]]) for i in range(n)]
    return spark.createDataFrame(rows, "record_key long, a array<array<float>>").repartition(parts).select("record_key", clip(F.col("a"), 8000).alias("clip"))


def found(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names if not n.endswith(".crc"))


@pytest.mark.parametrize("form", ["wav", "flac"])
def test_written_files(spark, tmp_path, form):
    load.register(spark)
    to = str(tmp_path / "out dir")
    clips(spark).write.format("clipfile").option("form", form).mode("append").save(to)
    names = found(to)
    assert sorted(n.split("/")[1] for n in names) == sorted(f"{i}.{form}" for i in range(20)) and len({n.split("/")[0] for n in names}) <= 5
    for n in names:
        i = int(n.split("/")[1].split(".")[0])
        audio, rate = decode.decode(open(f"{to}/{n}", "rb").read())
        assert rate == 8000 and np.allclose(audio, [[i / 32, -i / 32, 0.25]])
    clips(spark, 2).write.format("clipfile").mode("append").save(f"file://{to}")
    assert len(found(to)) == 22
    clips(spark, 3).write.format("clipfile").option("form", form).mode("overwrite").save(to)
    assert sorted(n.split("/")[1] for n in found(to)) == [f"{i}.{form}" for i in range(3)] and not os.path.exists(f"{to}/_temporary")
    with pytest.raises(Exception, match="form"):
        clips(spark, 1).write.format("clipfile").option("form", "mp3").mode("append").save(to)


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    load.register(spark)
    to = str(tmp_path / "out")
    bad = clips(spark).withColumn("clip", F.when(F.col("record_key") != 13, F.col("clip")))
    with pytest.raises(Exception, match="13"):
        bad.write.format("clipfile").mode("append").save(to)
    assert not os.path.exists(to) or found(to) == []
    clips(spark, 4).write.format("clipfile").mode("append").save(to)
    with pytest.raises(Exception, match="13"):
        bad.write.format("clipfile").mode("overwrite").save(to)
    assert len(found(to)) == 4  # what was there stays


def test_a_stream_reads_each_file_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(f"{source}/sub")

    def add(*names):
        for n in names:
            with open(f"{source}/{n}", "wb") as f:
                f.write(wav.encode(np.full((1, 100), 0.5), 8000))

    def run():
        made = stream_clip_files(spark, source, max_bytes=500, sample_rate=None, duration=0.005, offset=0.001)
        q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        rows = spark.read.schema(made.schema).parquet(out).collect()
        assert all(len(r.clip.audio_data[0]) == 40 for r in rows) and len({r.record_key for r in rows}) == len(rows)
        return sorted(r.clip.metadata.filepath.rsplit("/in/", 1)[1] for r in rows), len(q.recentProgress)

    add("a.wav", "b.WAV", "sub/c.wav", "note.txt", "d e.wav", "f+g.wav")
    names, batches = run()
    assert names == ["a.wav", "b.WAV", "d e.wav", "f+g.wav", "sub/c.wav"] and batches >= 3  # 244 bytes a file: two at a time
    assert run()[0] == names
    add("h.wav")
    assert run()[0] == sorted([*names, "h.wav"])


def table(spark, *sizes):
    return spark.createDataFrame([(g * 10, f"g{g}", i % 2, f"p{g}-{i:04d}") for g, n in enumerate(sizes) for i in range(n)], "group_idx int, group_name string, folder_idx int, path string")


def test_keyed_lookup_is_balanced(spark):
    sizes = (3, 10, 1, 64)
    source = index.KeyedBalancedSource(table(spark, *sizes), seed=5)
    rows = sorted(source.first(1300).collect(), key=lambda r: r.record_key)
    assert [r.record_key for r in rows] == list(range(1300)) and all(r.group_idx == r.record_key % 4 * 10 for r in rows)
    orders = {}
    for g, n in enumerate(sizes):
        mine = [r for r in rows if r.group_idx == g * 10]
        for p in range(len(mine) // n):
            own = [r.path for r in mine[p * n : (p + 1) * n]]
            assert len(set(own)) == n and {r["pass"] for r in mine[p * n : (p + 1) * n]} == {p}
            orders.setdefault(g, []).append(own)
    assert len(set(map(tuple, orders[3]))) == len(orders[3]) == 5 and orders[3][0] != sorted(orders[3][0])
    # A record is the same however it is asked for, and far out.
    assert source[7].first() == rows[7]
    far = source.lookup([7, 10**15 + 3, 7]).collect()
    assert sorted(r.record_key for r in far) == [7, 7, 10**15 + 3] and [r for r in far if r.record_key == 7] == [rows[7]] * 2
    assert index.KeyedBalancedSource(table(spark, *sizes), seed=6).first(300).orderBy("record_key").collect() != rows[:300]
    with pytest.raises(ValueError):
        source[-1]
    with pytest.raises(RuntimeError):
        index.KeyedBalancedSource(table(spark, 0))[0]


def test_permutations(spark):
    """Permutations of every size, and places that are spread evenly."""
    rows = spark.range(40).selectExpr("id + 1 AS n").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("seed", F.explode(F.array(*[F.lit(f"s{k}") for k in range(30)])))
    got = rows.select("n", "x", "seed", index.permuted(F.col("x"), F.col("n"), F.col("seed")).alias("y")).collect()
    by = {}
    for r in got:
        by.setdefault((r.n, r.seed), []).append(r.y)
    assert all(sorted(v) == list(range(n)) for (n, _), v in by.items())
    seen = Counter((r.x // 10, r.y // 10) for r in got if r.n == 40)
    assert len(seen) == 16 and min(seen.values()) > 45 and max(seen.values()) < 110  # 75 each


def test_table_functions(spark):
    expr.register_table_functions(spark)
    spark.createDataFrame([(1, [float(i) for i in range(10)]), (2, [1.0]), (3, []), (4, None)], "id long, a array<float>").createOrReplaceTempView("tf")
    got = spark.sql("SELECT id, frame, f.samples FROM tf, LATERAL clip_frames(a, 4, 3) f").collect()
    assert [(r.id, r.frame, r.samples) for r in got] == [(1, i, [float(3 * i + k) for k in range(4)]) for i in range(3)]
    got = spark.sql("SELECT id, start, f.samples FROM tf, LATERAL clip_excerpts(a, 2, 2D) f").collect()
    assert [(r.id, r.start, len(r.samples)) for r in got] == [(1, 0, 4), (1, 4, 4), (1, 8, 2), (2, 0, 1)]
    got = spark.sql("SELECT id, attempt, offset FROM tf, LATERAL clip_tries(cast(id as string), 10D, 2D, 3, 7)").collect()
    assert len(got) == 12 and all(0 <= r.offset < 8 for r in got) and len({r.offset for r in got}) == 12
    plan = spark.sql("SELECT id, frame FROM tf, LATERAL clip_frames(a, 4, 3)")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Join" not in plan.split("Physical Plan")[1]
    assert files.EXTENSIONS == (".wav", ".flac")
