"""Transforms with NumPy bodies, and kernels that run only where they are wanted."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import transforms as t
from cliploom.operators.compose import Choose, Pipeline
from cliploom.schema import clip


class Limits(t.NumpyTransform):
    """Another type in the leaf's place: what the options were."""

    defaults = {"minval": 0.0, "maxval": 1.0}
    on_arrays, result = True, "struct<minval:double,maxval:double>"

    @staticmethod
    def kernel(values, sample_rate, rng, minval, maxval):
        return {"minval": float(minval), "maxval": float(maxval)}


class Add(t.NumpyTransform):
    defaults = {"offset": 1.0}
    on_arrays = True

    @staticmethod
    def kernel(values, sample_rate, rng, offset):
        return values + offset


class Noise(t.NumpyTransform):
    @staticmethod
    def kernel(values, sample_rate, rng):
        return rng.random(values.shape)


class Counting(t.NumpyTransform):
    """Notes each clip it gets in a folder."""

    defaults = {"notes": ""}

    @staticmethod
    def kernel(values, sample_rate, rng, notes):
        open(f"{notes}/{uuid.uuid4().hex}", "w").close()
        return values * 2


def arrays(spark):
    tree = "struct<e:array<double>,f:array<double>>"
    return spark.createDataFrame([(i, [0.0], [0.0], [[0.0], [0.0]], ([0.0], [0.0])) for i in range(3)], f"record_key long, a array<double>, b array<double>, c array<array<double>>, d {tree}")


def clips(spark, n=200):
    return spark.createDataFrame([(i, [[float(i), 1.0]], [[float(-i)]]) for i in range(n)], "record_key long, x array<array<float>>, y array<array<float>>").select(
        "record_key", clip(F.col("x"), 8000).alias("a"), F.array(clip(F.col("x"), 8000), clip(F.col("y"), 8000)).alias("l")
    )


@pytest.mark.parametrize("split", [True, False])
def test_options_by_path_and_another_type(spark, split):
    config = {"b": {"minval": -1, "maxval": 3}, "c": {"maxval": 4}, "d": {"minval": -3, "e": {"minval": -2}, "f": {"maxval": 2}}}
    for r in Limits(config, split_seed=split)(arrays(spark)).collect():
        assert (tuple(r.a), tuple(r.b), tuple(r.c), tuple(r.d.e), tuple(r.d.f)) == ((0, 1), (-1, 3), (0, 4), (-2, 1), (-3, 2))


def test_scope_and_bare_arrays(spark):
    r = Add(scope={"b": {"scope": True}, "d": {"scope": True, "f": {"scope": False}}})(arrays(spark)).first()
    assert (r.a, r.b, r.c, r.d.e, r.d.f) == ([0.0], [1.0], [[0.0], [0.0]], [1.0], [0.0])
    assert Add({"offset": 2.0}, scope={"c": {"scope": True}})(arrays(spark)).first().c == [[2.0], [2.0]]


def test_clips_lists_and_siblings(spark):
    out = Add({"l": {"offset": 5.0}}, output_key=lambda path: f"{path[-1]}_more")(clips(spark, 3)).orderBy("record_key").collect()
    assert [r.a_more.audio_data for r in out] == [[[i + 1.0, 2.0]] for i in range(3)] and out[2].a.audio_data == [[2.0, 1.0]]
    assert [x.audio_data for x in out[2].l_more] == [[[7.0, 6.0]], [[3.0]]]
    assert Limits(scope={"l": {"scope": True}})(clips(spark, 2)).first().l == [(0.0, 1.0), (0.0, 1.0)]


def test_numbers_depend_on_record_and_leaf_only(spark):
    one = {r.record_key: (r.a.audio_data, *[x.audio_data for x in r.l]) for r in Noise(seed=4)(clips(spark, 30)).collect()}
    two = {r.record_key: (r.a.audio_data, *[x.audio_data for x in r.l]) for r in Noise(seed=4)(clips(spark, 30).repartition(7)).collect()}
    assert one == two and len({str(v) for x in one.values() for v in x}) == 90
    shared = Noise(seed=4, split_seed=False)(clips(spark, 2)).first()
    assert shared.a.audio_data == shared.l[0].audio_data
    assert {r.record_key: r.a.audio_data for r in Noise(seed=5)(clips(spark, 30)).collect()} != {k: v[0] for k, v in one.items()}


def counted(tmp_path, make, frame):
    notes = tmp_path / uuid.uuid4().hex
    notes.mkdir()
    rows = make({"notes": str(notes)})(frame).collect()
    return rows, len(os.listdir(notes))


def test_coins_and_choices_spare_kernels(spark, tmp_path):
    frame = clips(spark).select("record_key", "a")
    twice = lambda rows: sum(r.a.audio_data == [[2.0 * r.record_key, 2.0]] for r in rows)
    rows, runs = counted(tmp_path, lambda o: Counting(o, prob=0.3, seed=1), frame)
    assert 30 < twice(rows) == runs < 90 and len(rows) == 200
    rows, runs = counted(tmp_path, lambda o: Choose(Counting(o), t.InvertPhase(), weights=[1.0, 4.0]), frame)
    assert 15 < twice(rows) == runs < 75
    assert sum(r.a.audio_data == [[-float(r.record_key), -1.0]] for r in rows) == 200 - runs
    rows, runs = counted(tmp_path, lambda o: Choose(Pipeline(Counting(o), Add({"offset": 0.0})), t.Identity(), weights=[1.0, 4.0], prob=0.8), frame)
    assert 10 < twice(rows) == runs < 70 and sum(r.a.audio_data == [[float(r.record_key), 1.0]] for r in rows) == 200 - runs
    rows, runs = counted(tmp_path, lambda o: Choose(Choose(Counting(o), t.InvertPhase(), name="In"), t.Identity(), name="Out"), frame)
    assert 20 < twice(rows) == runs < 85
    lists = clips(spark).select("record_key", "l")
    rows, runs = counted(tmp_path, lambda o: Counting(o, prob=0.3, seed=1), lists)
    assert 2 * sum(r.l[0].audio_data == [[2.0 * r.record_key, 2.0]] for r in rows) == runs


def test_measuring_kernels_skip_what_is_not_taken(spark):
    """Branches that measure loudness leave other records' clips as they were."""
    frame = clips(spark, 40).select("record_key", "a")
    out = Choose(t.VolumeNorm({"min_db": -30, "max_db": -20}), t.Resample(4000), t.Identity())(frame).collect()
    kinds = {(r.a.sample_rate, r.a.loudness is not None) for r in out}
    assert kinds == {(8000, True), (4000, False), (8000, False)}
    assert all(r.a.audio_data == [[float(r.record_key), 1.0]] for r in out if (r.a.sample_rate, r.a.loudness) == (8000, None))
