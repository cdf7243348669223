"""Transforms over nested records: structure, scopes, siblings, coins and composition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.functions import expr as e
from cliploom.operators import transforms as t
from cliploom.operators.base import MapTransform, RandomTransform
from cliploom.operators.compose import Choose, Pipeline, ReduceBatch, batch
from cliploom.schema import CLIP, clip, with_fields
from cliploom.streaming import run_transform


def constant(value, n=64, channels=1):
    return clip(F.array(*[F.array_repeat(F.lit(float(value)).cast("float"), n)] * channels), 44100)


def rows(spark, n=1, **trees):
    return spark.range(n).select(F.col("id").alias("record_key"), *[v.alias(k) for k, v in trees.items()])


def first(col):
    return col["audio_data"][0][0]


class Options(MapTransform):
    """Replaces bare array leaves by their options: the leaf changes its type."""

    defaults = {"minval": 0, "maxval": 1}
    on_arrays = True

    def apply(self, value, spot):
        return F.struct(*[F.lit(v).alias(k) for k, v in spot.options.items()])


class AddOne(MapTransform):
    on_arrays = True

    def apply(self, value, spot):
        return F.transform(value, lambda x: x + 1)


class Times(MapTransform):
    defaults = {"factor": 2.0}

    def apply(self, value, spot):
        return with_fields(value, CLIP, audio_data=e.each_sample(value["audio_data"], lambda x: x * spot.options["factor"]))


def arrays(spark):
    v = F.array(F.lit(0.0))
    return rows(spark, a=v, b=v, c=F.array(v, v), d=F.struct(v.alias("e"), v.alias("f")), g=F.array(v, v))


def test_config_reaches_every_leaf(spark):
    config = {"b": {"minval": -1, "maxval": 3}, "c": {"maxval": 4}, "d": {"minval": -3, "e": {"minval": -2}, "f": {"maxval": 2}}}

    class Nested(Options):
        def is_leaf(self, kind):  # here a list of arrays is a list of leaves
            return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)

    r = Nested(config)(arrays(spark)).first()
    assert tuple(r.a) == (0, 1) and tuple(r.b) == (-1, 3) and [tuple(x) for x in r.c] == [(0, 4)] * 2
    assert tuple(r.d.e) == (-2, 1) and tuple(r.d.f) == (-3, 2)


def test_scope(spark):
    class One(AddOne):
        def is_leaf(self, kind):
            return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)

    r = One(scope={"b": {"scope": True}, "d": {"scope": True, "f": {"scope": False}}, "g": {"scope": True}})(arrays(spark)).first()
    assert (r.a, r.b, r.c, r.d.e, r.d.f, r.g) == ([0.0], [1.0], [[0.0], [0.0]], [1.0], [0.0], [[1.0], [1.0]])


def pair(spark):
    return rows(spark, src=F.struct(constant(1).alias("GT")), target=F.struct(constant(2).alias("GT")))


CONFIG = {"src": {"factor": 2.0}, "target": {"factor": 3.0}}


def test_output_key_function(spark):
    r = Times(CONFIG, output_key=lambda p: f"{p[-1]}_modified")(pair(spark)).first()
    assert [first(x) for x in (r.src.GT, r.src.GT_modified, r.target.GT, r.target.GT_modified)] == [1, 2, 2, 6]


def test_output_key_text_and_scope(spark):
    r = Times(CONFIG, output_key="modified", scope={"src": {"scope": True}})(pair(spark)).first()
    assert first(r.src.modified) == 2 and "modified" not in r.target


def test_output_key_of_lists_is_a_sibling_list(spark):
    df = rows(spark, src=F.array(constant(1), constant(2)), target=F.array(constant(3), constant(4)))
    r = Times(output_key="modified", scope={"src": {"scope": True}})(df).first()
    assert [first(x) for x in r.modified] == [2, 4] and [first(x) for x in r.src] == [1, 2] and [first(x) for x in r.target] == [3, 4]


def test_existing_key_keeps_its_value_and_collisions_are_refused(spark):
    with pytest.warns(UserWarning):
        assert first(Times(output_key="target", scope={"src": {"scope": True}})(rows(spark, src=constant(1), target=constant(5))).first().target) == 5
    with pytest.raises(ValueError, match="both write"):
        Times(output_key="same")(rows(spark, a=constant(1), b=constant(1)))


def test_names_that_differ_in_case_only(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = rows(spark, a=F.struct(constant(1).alias("GT"), constant(1).alias("gt")))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    with pytest.raises(ValueError, match="differ only in case"):
        Times()(df)


def test_gain_of_20_db(spark):
    r = t.VolumeChange({"min_db": 20, "max_db": 20})(rows(spark, clip=with_fields(constant(1), CLIP, loudness=F.lit(-30.0)))).first().clip
    assert abs(first(r) - 10) < 1e-6 and abs(r.loudness + 10) < 1e-9
    assert t.VolumeChange()(rows(spark, clip=constant(1))).first().clip.loudness is None


def test_loudness_rules(spark):
    df = rows(spark, clip=with_fields(constant(2, channels=2), CLIP, loudness=F.lit(-5.0)))
    assert t.RescaleAudio()(df).first().clip.loudness is None and first(t.RescaleAudio()(df).first().clip) == 1
    assert t.ToMono()(df).first().clip.loudness is None
    assert t.InvertPhase()(df).first().clip.loudness == -5 and t.SwapStereo()(df).first().clip.loudness == -5
    assert t.Resample(44100)(df).first().clip.loudness == -5 and t.Resample(22050)(df).first().clip.loudness is None
    assert t.ShiftPhase()(df).first().clip.loudness == -5


def noise(spark, n=6, samples=4000):
    rng = np.random.default_rng(0)
    data = [(i, [rng.uniform(-0.5, 0.5, samples).tolist() for _ in range(2)]) for i in range(n)]
    df = spark.createDataFrame(data, "record_key long, a array<array<float>>")
    return df.select("record_key", clip(F.col("a"), 8000).alias("clip"))


def test_norm_then_measure_is_the_target(spark):
    r = Pipeline(t.VolumeNorm({"min_db": -30, "max_db": -20}))(noise(spark))
    again = t.ReplaceLoudness()(r).collect()
    for x, y in zip(r.orderBy("record_key").collect(), sorted(again, key=lambda v: v.record_key), strict=True):
        assert -30 <= x.clip.loudness <= -20 and abs(x.clip.loudness - y.clip.loudness) < 1e-3


def test_norm_measures_even_where_the_coin_says_no(spark):
    r = t.VolumeNorm({"min_db": -30, "max_db": -30}, prob=0.0)(noise(spark, 2)).collect()
    assert all(x.clip.loudness is not None and x.clip.loudness != -30 for x in r)


def test_kernels_on_lists_equal_kernels_on_single_clips(spark):
    df = noise(spark, 3)
    two = df.select("record_key", F.array("clip", F.lit(None).cast(CLIP), "clip").alias("many"), F.col("clip").alias("one"))
    for make in (t.ReplaceLoudness, lambda: t.Resample(4000), lambda: t.CodecEncode(lambda a, r: (a[:, None, :5] * 10).astype(int), 1)):
        for r in make()(two).collect():
            assert r.many[0] == r.one and r.many[2] == r.one and r.many[1] is None
    shifted = t.CorruptPhase(split_seed=False)(two).first()
    assert shifted.many[0].audio_data == shifted.one.audio_data
    own = t.CorruptPhase()(two).first()
    assert own.many[0].audio_data != own.many[2].audio_data
    assert t.CorruptPhase({"amount": 0.0})(two).first().one.audio_data[0][7] == pytest.approx(df.first().clip.audio_data[0][7], abs=1e-6)


def test_involutions_and_null_clips(spark):
    df = noise(spark, 2).unionByName(spark.createDataFrame([(99, None)], T.StructType([T.StructField("record_key", T.LongType()), T.StructField("clip", CLIP)])))
    for one in (t.InvertPhase(), t.SwapStereo()):
        assert Pipeline(one, one)(df).collect() == df.collect()
    everything = Pipeline(t.VolumeChange(), t.VolumeNorm(), t.RescaleAudio(), t.ToMono(), t.Resample(4000), t.CorruptPhase(), t.ShiftPhase(), t.Identity())
    assert {r.record_key: r.clip is None for r in everything(df).collect()} == {0: False, 1: False, 99: True}


def test_results_dont_depend_on_partitions(spark):
    all_random = Pipeline(t.VolumeChange({"min_db": -9, "max_db": 9}, prob=0.5), t.CorruptPhase(prob=0.5), Choose(t.InvertPhase(), t.SwapStereo()))
    df = noise(spark)
    one = sorted(all_random(df.coalesce(1)).collect())
    assert one == sorted(all_random(df.repartition(5)).collect())


class Coin(RandomTransform):
    def apply(self, value, spot):
        return with_fields(value, CLIP, loudness=spot.stream.uniform("x"))


def test_coin_is_shared_by_the_whole_record_or_batch(spark):
    df = rows(spark, 400, a=constant(1, 1), b=F.struct(constant(1, 1).alias("c"))).withColumn("batch_id", F.floor(F.col("record_key") / 10))
    got = Coin(prob=0.3)(df).collect()
    told = [(r.a.loudness is not None, r.b.c.loudness is not None) for r in got]
    assert all(x == y for x, y in told) and 0.2 < np.mean([x for x, _ in told]) < 0.4
    blocks = {}
    for r in Coin(prob=0.5, coin_by="batch_id")(df).collect():
        blocks.setdefault(r.batch_id, set()).add(r.a.loudness is not None)
    assert all(len(v) == 1 for v in blocks.values()) and {x for v in blocks.values() for x in v} == {True, False}


def test_split_seed(spark):
    df = rows(spark, 3, a=constant(1, 1), b=F.array(constant(1, 1), constant(1, 1)))
    r = Coin()(df).first()
    assert len({r.a.loudness, r.b[0].loudness, r.b[1].loudness}) == 3
    r = Coin(split_seed=False)(df).first()
    assert len({r.a.loudness, r.b[0].loudness, r.b[1].loudness}) == 1


def test_prob_with_output_key_gives_null_siblings(spark):
    with pytest.warns(UserWarning):
        out = Coin(prob=0.5, output_key="new")(rows(spark, 50, a=constant(1, 1)))
    assert {r.new is None for r in out.collect()} == {True, False}
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            Coin(prob=bad)


def test_choose_frequencies_and_no_repeats(spark):
    df = rows(spark, 3000, clip=constant(1, 1))
    chosen = [tuple(r.c) for r in df.select(Choose(*[t.Identity()] * 3, c=2, weights=[1, 2, 0]).chosen().alias("c")).collect()]
    assert {frozenset(c) for c in chosen} == {frozenset({0, 1})}
    assert abs(np.mean([c[0] == 1 for c in chosen]) - 2 / 3) < 0.04
    skipped = [len(r.c) for r in df.select(Choose(t.Identity(), t.Identity(), prob=0.25).chosen().alias("c")).collect()]
    assert abs(np.mean(skipped) - 0.25) < 0.04


def test_choose_arguments_and_functions(spark):
    for bad in ({"weights": [1]}, {"c": 3}, {"weights": [1, 0], "c": 2}, {"prob": 2}, {"weights": [1, -1]}):
        with pytest.raises(ValueError):
            Choose(t.Identity(), t.Identity(), **bad)
    out = Choose(lambda v, stream: with_fields(v, CLIP, pitch=F.lit(60.0)))(rows(spark, 2, clip=constant(1, 1)))
    assert [r.clip.pitch for r in out.collect()] == [60.0, 60.0]


def test_choose_with_siblings_unifies_branches(spark):
    df = rows(spark, 60, d=F.struct(constant(1, 1).alias("x")))
    out = Choose(Times(output_key="twice"), t.InvertPhase())(df).collect()
    for r in out:
        assert (r.d.twice is None) == (first(r.d.x) == -1)
    assert {r.d.twice is None for r in out} == {True, False}


def test_choose_among_kernels(spark):
    df = noise(spark, 8)
    out = {r.record_key: r.clip for r in Choose(t.Resample(4000), t.VolumeNorm({"min_db": -30, "max_db": -30}), c=2)(df).collect()}
    assert all(c.sample_rate == 4000 and len(c.audio_data[0]) == 2000 for c in out.values())
    one = Choose(t.Resample(4000), t.CorruptPhase())(df).collect()
    assert {r.clip.sample_rate for r in one} == {4000, 8000}


def test_codec_order_and_shape_check(spark):
    def encode(audio, rate):
        return np.array([[[100 * c + 10 * b + s for s in range(2)] for b in range(3)] for c in range(len(audio))])

    r = t.CodecEncode(encode, 3)(rows(spark, clip=constant(1, 4, channels=2))).first().clip.codes
    assert r == [[0, 1], [100, 101], [10, 11], [110, 111], [20, 21], [120, 121]]
    with pytest.raises(Exception, match="encode gave shape"):
        t.CodecEncode(encode, 2)(rows(spark, clip=constant(1, 4))).collect()


def test_reduce_batch_inverts_batch(spark):
    df = rows(spark, 12, clip=constant(1, 2), other=constant(2, 2))
    again = ReduceBatch(44100)(batch(df, 4))
    assert sorted(again.collect()) == sorted(df.collect())
    with pytest.raises(TypeError):
        ReduceBatch()(df)


@pytest.mark.parametrize("make", [t.Identity, t.VolumeChange, t.VolumeNorm, t.RescaleAudio, t.InvertPhase, t.SwapStereo, t.CorruptPhase, t.ShiftPhase])
def test_every_transform_runs(spark, make):
    options = {"prob": 0.5, "seed": 0} if issubclass(make, RandomTransform) else {}
    r = make(**options)(rows(spark, clip=constant(1, 44100))).first().clip
    assert len(r.audio_data[0]) == 44100 and all(math.isfinite(x) for x in r.audio_data[0][:100])


def test_streams(spark, tmp_path):
    df = noise(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    change = Pipeline(t.VolumeChange({"min_db": -9, "max_db": 9}), t.Resample(4000))
    run_transform(stream, change, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(change(df).collect())


def test_functions(spark):
    r = spark.sql("select 'Zoë😀.WaV' as p, 2.5D as d, array(1f, 2f) as s").select(
        e.encode_path(F.col("p")).alias("codes"), e.decode_path(e.encode_path(F.col("p"))).alias("back"), e.has_extension(F.col("p"), (".wav",)).alias("wav"),
        e.sample_count(F.col("d"), 1).alias("n"), e.from_array(F.col("s"), 1).alias("audio"), e.sinc(F.lit(0.0)).alias("sinc"), e.encode_path(F.repeat(F.lit("x"), 300)).alias("long"),
    ).first()
    assert r.codes[:8] == [ord(c) for c in "Zoë😀.WaV"] and len(r.codes) == 256 and r.back == "Zoë😀.WaV" and r.wav and r.n == 2
    assert r.audio == [[1.0, 2.0]] and r.sinc == 1.0 and len(r.long) == 300
    with pytest.raises(ValueError):
        e.from_array(F.col("s"), 3)
    e.register_sql(spark)
    assert spark.sql("select clip_peak(clip_gain(array(array(0.5f, -1f)), 20D)) p").first().p == pytest.approx(10)
