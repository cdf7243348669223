"""Files, indexes, loading and saliency."""

import glob
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import kernels as k
from cliploom.plans import saliency as sal
from cliploom.schema import clip
from cliploom.sources import decode, files, index, load, stores, wav


def tone(frequency=1000, rate=48000, seconds=1.0, amplitude=0.1, channels=1):
    x = amplitude * np.sin(2 * np.pi * frequency * np.arange(int(rate * seconds)) / rate)
    return np.stack([x * (c + 1) for c in range(channels)])


@pytest.fixture()
def folder(tmp_path):
    made = {"a.wav": tone(), "b.WAV": tone(channels=2), "sub/c.wav": tone(seconds=0.2), "sub/deep/d.wav": tone(60), ".hidden.wav": tone(), "silence.wav": np.zeros((1, 48000))}
    for name, audio in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(wav.encode(audio, 48000))
    (tmp_path / "x.txt").write_text("no clip")
    os.symlink(tmp_path / "a.wav", tmp_path / "link.wav")
    return str(tmp_path)


def names(paths, folder):
    return [p.removeprefix(folder + "/") for p in paths]


def test_find_files(folder, monkeypatch):
    assert names(files.find_files(folder), folder) == [".hidden.wav", "a.wav", "b.WAV", "silence.wav", "sub/c.wav", "sub/deep/d.wav"]
    assert names(files.find_files(folder, max_depth=0), folder) == [".hidden.wav", "a.wav", "b.WAV", "silence.wav"]
    assert names(files.find_files(folder, max_depth=1), folder)[-1] == "sub/c.wav"
    assert "link.wav" in names(files.find_files(folder, follow_symlinks=True), folder)
    assert names(files.find_files(folder, (".TXT",)), folder) == ["x.txt"]
    monkeypatch.setenv("CLIPS", folder)
    assert len(files.find_files("$CLIPS")) == 6
    assert names(files.resolve_entry(f"{folder}/*.txt"), folder) == ["x.txt"] and files.resolve_entry(f"{folder}/none*") == []


def test_remote_listing(spark, folder):
    found = sorted(r.path.rsplit("/", 1)[-1] for r in files.list_remote(spark, folder).collect())
    assert found == [".hidden.wav", "a.wav", "b.WAV", "c.wav", "d.wav", "silence.wav"]
    for base in (folder, f"file:{folder}", f"file://{folder}/"):
        for depth in (0, 1, None):
            for links in (False, True):
                got = sorted((r.path, r.length) for r in files.list_remote(spark, base, max_depth=depth, follow_symlinks=links).collect())
                assert got == [(p, os.path.getsize(p)) for p in files.find_files(folder, max_depth=depth, follow_symlinks=links)]


def test_remote_listing_of_odd_names_and_patterns(spark, tmp_path):
    """Folders that would be patterns of other kinds, names with blanks, signs and percent codes."""
    base = tmp_path / "w+av (1)" / "ev.en"
    names_ = ["a b.wav", "c+d.wav", "e%20f.wav", "g#h?.wav", "é.wav", ".dot.wav"]
    for i, name in enumerate(names_):
        for below in ("", "x", "x/y"):
            (base / below).mkdir(parents=True, exist_ok=True)
            (base / below / name).write_bytes(wav.encode(np.full((1, 100), (i + 1) / 10), 8000, -32))
    assert files.list_remote(spark, str(base), max_depth=0).count() == len(names_)
    assert files.list_remote(spark, str(base)).count() == 3 * len(names_)
    for pattern in ("*.wav", "*/*.wav", "x/*", "?/[xy]/*+*", "none*"):
        got = sorted(r.path for r in index.remote_file_table(spark, {"a": [f"{base}/{pattern}"]}).collect()) if pattern != "none*" else []
        assert got == sorted(p for p in glob.glob(f"{base}/{pattern}") if os.path.isfile(p))
    with pytest.raises(RuntimeError, match="empty"):
        index.remote_file_table(spark, {"full": [str(base)], "empty": [f"{base}/none*"]})
    rows = index.remote_file_table(spark, {"a": [f"file://{base}"]})
    assert rows.columns == ["group_idx", "group_name", "folder_idx", "path", "length"]
    for form in (lambda p: p, lambda p: F.concat(F.lit("file:"), p), lambda p: F.concat(F.lit("file://"), p)):
        ix = index.simple_index(rows.withColumn("path", form(F.col("path"))))
        want = sorted((r.record_key, (names_.index(r.path.rsplit("/", 1)[-1]) + 1) / 10) for r in ix.collect())
        for made in (load.load_index(ix, None, duration=0.01), load.load_index(load.with_content(ix.where("not path like '%/.%'"), str(base)), None, duration=0.01)):
            got = sorted((r.record_key, round(float(r.clip.audio_data[0][5]), 5)) for r in made.collect())
            assert got == want or len(got) == 15 and set(got) <= set(want)
    encoded = ix.where("path like '%a b.wav'").withColumn("path", F.regexp_replace("path", " ", "%20"))
    assert load.load_index(encoded, None, duration=0.01).count() == 3
    gone = ix.limit(1).withColumn("path", F.lit(f"{base}/gone.wav"))
    for lost in (load.load_index(gone, None), load.with_content(gone, str(base))):
        with pytest.raises(Exception, match="gone.wav"):
            lost.collect()


def test_file_table_and_empty_group(spark, folder):
    got = files_of = index.file_table(spark, {"all": [folder, f"{folder}/sub"], "texts": [f"{folder}/*.txt"]})
    assert got.groupBy("group_name").count().orderBy("group_name").collect() == [("all", 8), ("texts", 1)] and files_of is got
    with pytest.raises(RuntimeError, match="none"):
        index.file_table(spark, {"none": [f"{folder}/nothing*"]})


def table(spark, *sizes):
    return spark.createDataFrame([(g, f"g{g}", i % 2, f"p{g}-{i:04d}") for g, n in enumerate(sizes) for i in range(n)], "group_idx int, group_name string, folder_idx int, path string")


def test_simple_index(spark):
    rows = index.simple_index(table(spark, 3, 2), 4).orderBy("record_key").collect()
    assert [(r.record_key, r.path) for r in rows] == [(0, "p0-0000"), (1, "p0-0002"), (2, "p0-0001"), (3, "p1-0000")]
    large = index.large_simple_index(table(spark, 300, 2).repartition(7), 250).select("record_key", "path")
    assert sorted(large.collect()) == sorted(index.simple_index(table(spark, 300, 2), 250).select("record_key", "path").collect())
    source = index.SimpleSource(table(spark, 3, 2))
    assert len(source) == 5 and source[4].first().path == "p1-0001"
    with pytest.raises(RuntimeError):
        len(index.SimpleSource(table(spark, 1), 0))
    with pytest.raises(ValueError):
        source[-1]


@pytest.mark.parametrize("steps", [1, 7, 20, 31])
def test_balanced_index(spark, steps):
    rows = sorted(index.balanced_index(table(spark, 3, 10, 1), steps).collect(), key=lambda r: r.record_key)
    assert [r.record_key for r in rows] == list(range(steps)) and all(r.group_idx == r.record_key % 3 for r in rows)
    shares = np.bincount([r.group_idx for r in rows], minlength=3)
    assert shares.max() - shares.min() <= 1
    sizes, ideal, seed, want = (3, 10, 1), -(-steps // 3), 0, {}
    for g, n in enumerate(sizes):
        for p in range(-(-ideal // n)):
            want[g, p] = seed
            seed += 1
    for g, n in enumerate(sizes):
        mine = [r for r in rows if r.group_idx == g]
        for p in {r["pass"] for r in mine}:
            own = [r.path for r in mine if r["pass"] == p]
            assert len(set(own)) == len(own) <= n and {r.seed for r in mine if r["pass"] == p} == {want[g, p]}


def test_balanced_index_repeats_overlapping_folders(spark):
    twice = table(spark, 2).unionByName(table(spark, 2))
    rows = index.balanced_index(twice, 4).collect()
    assert sorted(r.path for r in rows) == ["p0-0000", "p0-0000", "p0-0001", "p0-0001"]
    assert len(index.BalancedSource(twice, 4)) == 4
    with pytest.raises(ValueError):
        index.balanced_index(twice, 0)


@pytest.mark.parametrize("bits", [8, 16, 24, 32, -32])
@pytest.mark.parametrize("channels", [1, 2])
def test_wav_round_trip(tmp_path, bits, channels):
    x = tone(channels=channels, seconds=0.05)
    path = tmp_path / "x.wav"
    path.write_bytes(wav.encode(x, 48000, bits))
    with open(path, "rb") as f:
        h = wav.probe(f)
    assert (h.channels, h.sample_rate, h.frames) == (channels, 48000, x.shape[1]) and h.duration == pytest.approx(0.05)
    y, rate = decode.decode(path.read_bytes(), 0.01, 0.02)
    assert rate == 48000 and np.allclose(y, x[:, 480:1440], atol=2.0 ** (1 - min(abs(bits), 24)))
    with pytest.raises(ValueError):
        decode.decode(b"nothing")
    with pytest.raises(ValueError):
        decode.decode(b"fLaC1234")


def test_clipfile_reads_pads_trims_mixes_and_resamples(spark, folder):
    load.register(spark)
    read = lambda **o: {r.path.removeprefix(folder + "/"): r for r in spark.read.format("clipfile").options(**o).load(folder).collect()}
    plain = read()
    assert len(plain) == 6 and plain["b.WAV"].sample_rate == 48000 and len(plain["b.WAV"].audio_data) == 2 and plain["a.wav"].metadata.duration == 1.0
    got = read(duration="0.5", offset="0.1", mono="true", sample_rate="24000", max_depth="1")
    assert "sub/deep/d.wav" not in got and {len(r.audio_data[0]) for r in got.values()} == {12000} and {len(r.audio_data) for r in got.values()} == {1}
    short = got["sub/c.wav"]
    assert not any(short.audio_data[0][2500:]) and short.metadata.offset == 0.1 and short.duration is None and short.loudness is None


def test_load_index_from_paths_and_contents(spark, folder):
    ix = index.simple_index(index.file_table(spark, {"g": [f"{folder}/sub"], "h": [f"{folder}/a.wav"]}))
    a = load.load_index(ix, 16000, duration=0.3).orderBy("record_key").collect()
    b = load.load_index(load.with_content(ix, folder), 16000, duration=0.3).orderBy("record_key").collect()
    assert a == b and [len(r.clip.audio_data[0]) for r in a] == [4800] * 3 and a[2].clip.metadata.filepath.endswith("a.wav")


def test_saliency_finds_the_loud_part(spark, tmp_path):
    audio = np.concatenate([np.zeros((1, 48000 * 3)), tone(amplitude=0.5)], axis=1)
    (tmp_path / "x.wav").write_bytes(wav.encode(audio, 48000))
    ix = index.simple_index(index.file_table(spark, {"g": [str(tmp_path)]}))
    params = sal.SaliencyParams(True, 30, -25.0)
    r = load.load_index(ix, None, duration=0.5, saliency=params).first().clip
    assert k.integrated_loudness(np.array(r.audio_data), 48000) > -25 and r.metadata.offset > 2.5
    assert load.load_index(ix, None, duration=0.5, saliency=sal.SaliencyParams()).first().clip.metadata.offset == 0
    with pytest.raises(Exception, match="duration"):
        load.load_index(ix, None, duration=None, saliency=params).collect()


def test_both_forms_of_the_search_agree(spark):
    rng = np.random.default_rng(4)
    data = [(i, [(rng.uniform(-1, 1, 16000) * np.repeat(rng.uniform(0, 0.3, 16), 1000) ** 2).tolist()]) for i in range(6)]
    clips = spark.createDataFrame(data, "record_key long, a array<array<float>>").select("record_key", clip(F.col("a"), 8000).alias("clip"))
    for search in ("uniform", "early"):
        params = sal.SaliencyParams(True, 5, -38.0, search)
        for r in sal.salient_excerpts(clips, 0.5, params, seed=3).collect():
            audio = np.array(np.array(data[r.record_key][1], np.float32), np.float64)
            assert sal.salient(audio, 8000, 0.5, params, 3, r.record_key) == pytest.approx(r.offset, abs=1e-9)
    with pytest.raises(ValueError):
        sal.salient_excerpts(clips, 0.0, params)


def test_random_excerpts(spark):
    clips = spark.createDataFrame([(i, [[float(x) for x in range(100)]]) for i in range(20)], "record_key long, a array<array<float>>").select("record_key", clip(F.col("a"), 10).alias("clip"))
    got = sal.random_excerpts(clips, 2.0, offset=1.0).collect()
    for r in got:
        start = int(r.clip.metadata.offset * 10)
        assert 1.0 <= r.clip.metadata.offset <= 8.0 and r.clip.audio_data[0] == [float(x) for x in range(start, start + 20)]
    assert len({r.clip.metadata.offset for r in got}) == 20
    long = sal.random_excerpts(clips, 30.0).first().clip
    assert long.metadata.offset == 0 and len(long.audio_data[0]) == 300
    with pytest.raises(ValueError):
        sal.random_excerpts(clips, 0.0)


def test_pick_equals_the_loop(spark):
    rng = np.random.default_rng(0)
    table = {i: rng.integers(-5, 5, 6).astype(float).tolist() for i in range(300)}
    rows = [(i, a, x) for i, v in table.items() for a, x in enumerate(v)]
    got = {r.record_key: r.attempt for r in sal.pick(spark.createDataFrame(rows, "record_key long, attempt int, loudness double"), 3.0).collect()}
    for i, v in table.items():
        best, at = -np.inf, 0
        for a, x in enumerate(v):
            if a == 0 or x > best:
                best, at = x, a
            if best > 3.0:
                break
        assert got[i] == at


def test_saliency_arguments():
    assert not sal.SaliencyParams(True, loudness_cutoff=None).active and not sal.SaliencyParams(True, loudness_cutoff=float("nan")).active and sal.SaliencyParams(True).active
    for bad in ({"num_tries": 0}, {"num_tries": None}, {"search_function": "eval"}):
        with pytest.raises(ValueError):
            sal.SaliencyParams(True, **bad)
    assert sal.offset_value("uniform", 0.5, 1.0, 2.0, 1.5, 0, 8) == 1.0
    assert sal.offset_value("early", 1.0, 0.0, 2.0, 10.0, 7, 8) == 2.0 and sal.offset_value("early", 1.0, 0.0, 2.0, 10.0, 0, 1) == 8.0


def test_write_wav(spark, tmp_path):
    clips = spark.createDataFrame([(1, [[0.5, -0.5, 0.25]])], "record_key long, a array<array<float>>").select("record_key", clip(F.col("a"), 8000).alias("clip"))
    load.write_wav(clips, str(tmp_path / "out"))
    audio, rate = decode.decode((tmp_path / "out/1.wav").read_bytes())
    assert rate == 8000 and np.allclose(audio, [[0.5, -0.5, 0.25]], atol=1e-4)


class Counted:
    """A file that notes what is read of it, in a file of its own for each opening."""

    def __init__(self, path, notes):
        self.file, self.note = open(path, "rb"), f"{notes}/{uuid.uuid4().hex}"
        self.bytes = 0

    def read(self, n=-1):
        out = self.file.read(n)
        self.bytes += len(out)
        return out

    def __getattr__(self, name):
        return getattr(self.file, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
        with open(self.note, "w") as f:
            f.write(str(self.bytes))


@pytest.mark.parametrize("form", ["wav", "flac"])
def test_excerpts_read_only_what_they_draw(spark, tmp_path, form):
    rng = np.random.default_rng(2)
    audio = {i: np.round(rng.uniform(-0.5, 0.5, (2, 30_000)) * 32768) / 32768 for i in range(6)}
    clips = spark.createDataFrame([(i, a.tolist()) for i, a in audio.items()], "record_key long, a array<array<float>>").select("record_key", clip(F.col("a"), 8000).alias("clip"))
    load.write_wav(clips, str(tmp_path / "clips"), form=form)
    notes = tmp_path / "notes"
    notes.mkdir()
    opener = lambda path, notes=str(notes): Counted(path, notes)
    ix = index.simple_index(index.remote_file_table(spark, {"g": [str(tmp_path / "clips")]}))
    assert {(r.channels, r.sample_rate, r.bits, r.frames) for r in load.probe_index(ix).collect()} == {(2, 8000, 16, 30_000)}
    got = load.load_excerpts(ix, 0.05, seed=3, opener=opener, task_bytes=2000).collect()
    assert len({r.clip.metadata.offset for r in got}) == 6
    for r in got:
        own = audio[int(r.clip.metadata.filepath.rsplit("/", 1)[-1].split(".")[0])]
        at = int(r.clip.metadata.offset * 8000)
        assert np.array_equal(np.array(r.clip.audio_data), own[:, at : at + 400])
    read = sorted(int(p.read_text()) for p in notes.iterdir())
    assert len(read) == 12 and read[5] <= 60  # six headers
    assert sum(read) <= 6 * (60 + 44 + 1600) if form == "wav" else read[-1] < 6 * 70_000
    # As drawn of clips that are loaded whole.
    whole = {r.record_key: r.clip.metadata.offset for r in sal.random_excerpts(load.load_index(ix, None, mono=False, duration=None), 0.05, seed=3).collect()}
    assert {r.record_key: r.clip.metadata.offset for r in got} == whole
    with pytest.raises(ValueError):
        load.load_excerpts(ix, 0.0)


def test_saliency_reads_only_its_tries(spark, tmp_path):
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips/x.wav").write_bytes(wav.encode(np.concatenate([np.zeros((1, 48000 * 20)), tone(amplitude=0.5, seconds=20)], axis=1), 48000))
    notes = tmp_path / "notes"
    notes.mkdir()
    ix = index.simple_index(index.file_table(spark, {"g": [str(tmp_path / "clips")]}))
    r = load.load_index(ix, None, duration=0.5, saliency=sal.SaliencyParams(True, 30, -25.0), opener=lambda path, notes=str(notes): Counted(path, notes)).first().clip
    assert r.metadata.offset > 19 and max(int(p.read_text()) for p in notes.iterdir()) <= 44 + 30 * 48000


def test_packing(spark):
    rows = spark.range(300).selectExpr("id AS record_key", "concat('p', id) AS path", "cast(if(id = 7, 5000, 10 + id % 20) as long) AS size")
    dealt = stores.packed(rows, "size", 500, open_bytes=0).withColumn("task", F.spark_partition_id())
    sums = [r.s for r in dealt.groupBy("task").agg(F.sum("size").alias("s")).collect()]
    assert dealt.count() == 300 and dealt.columns == ["record_key", "path", "size", "task"] and 10 <= len(sums) <= 22
    assert sorted(sums)[-2] <= 530 and max(sums) < 5600
    assert stores.packed(rows.limit(0), "size").count() == 0
    opened = stores.packed(rows, "size", 100_000, open_bytes=1000).withColumn("task", F.spark_partition_id()).groupBy("task").count()
    assert 3 <= opened.count() <= 4  # files count by being opened, too


def test_salient_excerpts_shuffle_no_audio(spark):
    clips = spark.createDataFrame([(i, [[0.1] * 4000]) for i in range(4)], "record_key long, a array<array<float>>").select("record_key", clip(F.col("a"), 8000).alias("clip"))
    plan = sal.salient_excerpts(clips, 0.2, sal.SaliencyParams(True, 3))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
