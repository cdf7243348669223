"""Chunked recordings: whatever the cut, the same as the kernel on the whole clip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import kernels as k
from cliploom.plans import chunked as c
from cliploom.schema import clip

RATES = {1: 8000, 2: 8000, 3: 4000, 4: 8000, 5: 2000, 6: 8000}


def recordings():
    rng = np.random.default_rng(3)
    out = {1: rng.normal(0, 0.1, (1, 20_000)), 2: rng.normal(0, 0.1, (2, 16_001)), 3: rng.normal(0, 0.1, (1, 4_000)), 4: rng.normal(0, 0.1, (3, 700)), 5: np.zeros((1, 5_000)), 6: rng.normal(0, 0.1, (1, 1))}
    out[1][:, 8000:14_000] *= 10.0 ** -np.repeat([1, 2, 3], 2000)
    return {i: x.astype(np.float32).astype(np.float64) for i, x in out.items()}


def chunks(spark, cuts):
    """Recordings cut at places drawn by chance: long and short chunks, some of a single sample."""
    rng = np.random.default_rng(cuts)
    rows = []
    for i, x in recordings().items():
        n = x.shape[1]
        places = sorted({0, n, *rng.integers(0, n + 1, cuts).tolist()}) if cuts else [0, n]
        rows += [(i, a, x[:, a:b].tolist(), RATES[i]) for a, b in zip(places, places[1:], strict=False)]
    rng.shuffle(rows)
    rows = [(int(i), int(a), x, int(r)) for i, a, x, r in rows]
    return spark.createDataFrame([*rows, (7, 0, [[]], 8000)], "record_key long, start long, audio array<array<float>>, sample_rate int").repartition(3)


def whole(frame):
    """Joined by start; chunks must follow each other."""
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.record_key, r.start)):
        have = out.setdefault(r.record_key, [])
        assert r.start == sum(x.shape[1] for x in have)
        have.append(np.array(r.audio))
    return {i: np.concatenate(x, axis=1) for i, x in out.items()}


@pytest.mark.parametrize("cuts", [0, 3, 40])
@pytest.mark.parametrize("new", [12_000, 4_000, 7_350])
def test_resample(spark, cuts, new):
    got = whole(c.resample_chunks(chunks(spark, cuts), new, tile_seconds=1))
    for i, x in recordings().items():
        want = k.resample(x, RATES[i], new)
        assert (i in got) == bool(want.shape[1])
        if i in got:
            assert got[i].shape == want.shape and np.allclose(got[i], want, atol=1e-6)


@pytest.mark.parametrize("cuts", [0, 3, 40])
@pytest.mark.parametrize("tile", [1, 10])
def test_loudness(spark, cuts, tile):
    got = {r.record_key: r.loudness for r in c.chunk_loudness(chunks(spark, cuts), tile_seconds=tile).collect()}
    assert got == {i: pytest.approx(k.integrated_loudness(x, RATES[i]), abs=1e-6) for i, x in recordings().items()}


@pytest.mark.parametrize("cuts", [0, 40])
@pytest.mark.parametrize("frame, hop", [(256, 0.25), (64, 0.5)])
def test_spectra_there_and_back(spark, monkeypatch, cuts, frame, hop):
    monkeypatch.setattr(c, "TILE", 1024)
    made = c.stft_chunks(chunks(spark, cuts), frame, hop)
    z = {}
    for r in made.collect():
        for item in r.spectrum:
            key = r.record_key, item.channel, item.frequency, item.frame
            assert key not in z
            z[key] = complex(item.re, item.im)
    sizes = {}
    for i, x in recordings().items():
        want = k.stft(x, frame, hop)
        sizes[i] = want.size
        assert all(abs(z[i, *at] - v) < 1e-6 for at, v in np.ndenumerate(want))
    assert len(z) == sum(sizes.values())
    # Frames dealt over rows anew: each row has some frames of any tile.
    dealt = made.select("record_key", F.explode("spectrum").alias("s"), "length").groupBy("record_key", F.pmod(F.col("s.frame") * 7, F.lit(3))).agg(F.collect_list("s").alias("spectrum"), F.max("length").alias("length"))
    for spectra in (made, dealt):
        back = whole(c.istft_chunks(spectra, frame, hop, sample_rate=8000))
        for i, x in recordings().items():
            assert back[i].shape == x.shape and np.allclose(back[i], x, atol=1e-5)
    with pytest.raises(ValueError):
        c.stft_chunks(chunks(spark, 0), 64, 0.75)


def test_cutting_and_joining(spark):
    data = [(i, x.tolist(), RATES[i]) for i, x in recordings().items()] + [(8, [], 8000), (9, None, 8000)]
    clips = spark.createDataFrame(data, "record_key long, a array<array<float>>, r int").select("record_key", clip(F.col("a"), F.col("r")).alias("clip"))
    cut = c.cut_clips(clips, 999)
    assert max(len(r.audio[0]) for r in cut.collect()) == 999
    back = {r.record_key: np.array(r.audio) for r in c.join_chunks(cut).collect()}
    assert sorted(back) == sorted(recordings()) and all(np.array_equal(back[i], x) for i, x in recordings().items())


def test_a_tile_is_all_a_task_needs(spark):
    """A recording of many tiles is dealt over tasks; what is sent to tiles is the recording and the halos."""
    x = [[0.1] * 80_000]
    one = spark.createDataFrame([(1, 0, x, 8000)], "record_key long, start long, audio array<array<float>>, sample_rate int")
    sent = c.tiles(one, F.lit(8000), F.lit(100)).collect()
    assert len(sent) == 11 and sum(len(r.audio[0]) for r in sent) == 80_000 + 9 * 100 + 10 * 100  # the last has a halo only
