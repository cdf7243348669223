"""Loading: files to clip rows, by a Spark data source or from an index.

Offset, duration, mono and rate are applied in the reader: only the frames that are asked for leave the disk.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import kernels as k
from ..operators.arrow import audio_array, clip_arrays
from ..plans.saliency import Draw, SaliencyParams, offset_column, searched
from ..rng import Stream
from ..schema import CLIP, HELPER
from ..shared import cut
from . import decode, flac, stores, wav
from .files import EXTENSIONS, find_files

ENCODERS = {"wav": wav.encode, "flac": flac.encode}
ROW = T.StructType([T.StructField("path", T.StringType()), *CLIP.fields])


def shaped(audio: np.ndarray, rate: int, sample_rate: int | None, mono: bool, duration: float | None) -> tuple[np.ndarray, int]:
    """Mix, resample (no rate: keep the file's) and bring to exactly round(duration * rate) samples."""
    if mono and len(audio) > 1:
        audio = audio.mean(axis=0, keepdims=True)
    if sample_rate is not None and sample_rate != rate:
        audio, rate = k.resample(audio, rate, sample_rate), sample_rate
    if duration is not None:
        n = round(duration * rate)
        audio = np.pad(audio[:, :n], ((0, 0), (0, max(0, n - audio.shape[1]))))
    return audio, rate


def load(file: BinaryIO, key: object, sample_rate: int | None, mono: bool, offset: float, duration: float | None, saliency: SaliencyParams | None, seed: int = 0):
    """One clip of a file: (audio, rate, offset), the excerpt found by saliency if that is on. Only the header and the frames of the excerpts tried are read."""
    h = decode.probe(file)
    piece = lambda at: shaped(decode.excerpt(file, h, at, duration), h.sample_rate, sample_rate, mono, duration)
    if saliency is not None and saliency.active:
        if duration is None or duration <= 0:
            raise ValueError("an excerpt needs a duration")
        offset = searched(lambda at: k.integrated_loudness(*piece(at)), h.duration, duration, saliency, seed, key)
    return *piece(offset), offset


def _rows(paths: list[str], made: list[tuple[np.ndarray, int, float]], duration: float | None, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(paths)
    meta = [{"filepath": p, "offset": o, "duration": duration if duration is not None else a.shape[1] / r, "extra": None} for p, (a, r, o) in zip(paths, made, strict=True)]
    none = lambda kind: pa.nulls(n, kind)
    columns = extra | {
        "path": pa.array(paths, pa.string()), "audio_data": audio_array([a for a, _, _ in made]), "sample_rate": pa.array([r for _, r, _ in made], pa.int32()),
        "loudness": none(pa.float64()), "pitch": none(pa.float64()), "velocity": none(pa.float64()), "duration": none(pa.float64()), "codes": none(pa.list_(pa.list_(pa.int32()))),
        "metadata": pa.array(meta, pa.struct([("filepath", pa.string()), ("offset", pa.float64()), ("duration", pa.float64()), ("extra", pa.map_(pa.string(), pa.string()))])),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


#: Bytes of samples in a batch, about; a longer clip is a batch of its own.
BATCH_BYTES = 8 << 20


def _batched(clips: Iterator[tuple[str, tuple, object]], duration: float | None, key: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (path, clip, record key) of bounded size."""
    held: list[tuple] = []
    size = 0

    def rows() -> pa.RecordBatch:
        extra = {"record_key": pa.array([k for _, _, k in held], pa.int64())} if key else {}
        return _rows([p for p, _, _ in held], [m for _, m, _ in held], duration, extra)

    for path, made, record in clips:
        held.append((path, made, record))
        size += made[0].nbytes
        if size >= BATCH_BYTES or len(held) >= 1000:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


class ClipPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ClipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        o = {x.lower(): v for x, v in options.items()}
        number = lambda name, kind: kind(o[name]) if o.get(name) not in (None, "") else None
        self.path = o.get("path") or ""
        self.rate, self.offset, self.duration = number("sample_rate", int), number("offset", float) or 0.0, number("duration", float)
        self.mono = o.get("mono", "false").lower() in ("true", "1")
        self.depth, self.links = number("max_depth", int), o.get("follow_symlinks", "false").lower() == "true"
        self.extensions = tuple(o.get("extensions", ",".join(EXTENSIONS)).split(","))
        self.files = int(o.get("files_per_partition", "64"))

    def partitions(self) -> list[ClipPartition]:
        found = find_files(self.path, self.extensions, self.depth, self.links)
        return [ClipPartition(found[i : i + self.files]) for i in range(0, len(found), self.files)]

    def read(self, partition: ClipPartition) -> Iterator[pa.RecordBatch]:
        yield from _batched(((path, self._clip(path), None) for path in partition.paths), self.duration, False)

    def _clip(self, path: str) -> tuple[np.ndarray, int, float]:
        with open(path, "rb") as f:
            return load(f, path, self.rate, self.mono, self.offset, self.duration, None)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and its number of files."""

    folder: str | None
    files: int


class ClipWriter(DataSourceArrowWriter):
    """Clip files with commit and abort.

    A task writes into a folder of its own below ``_temporary``; the commit moves the folders of tasks that succeeded to
    ``part-<task>-<job>``, one move a task, and clears the rest. A job that fails leaves no file, and a task that runs twice counts once.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        o = {x.lower(): v for x, v in options.items()}
        self.path, self.form, self.bits, self.overwrite = o.get("path") or "", o.get("form", "wav"), int(o.get("bits", "16")), overwrite
        if self.form not in ENCODERS:
            raise ValueError(f"unknown form {self.form!r}; known are {', '.join(ENCODERS)}")
        self.job = uuid.uuid4().hex

    def _place(self, name: str = "") -> tuple[fs.FileSystem, str]:
        store, base = stores.writable(self.path)
        return store, f"{base.rstrip('/')}/{name}" if name else base

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context, folder, files = TaskContext.get(), None, 0
        for batch in iterator:
            clips = batch.column("clip")
            keys, rates = batch.column("record_key").to_pylist(), clips.field("sample_rate").to_pylist()
            for key, audio, rate in zip(keys, clip_arrays(clips.field("audio_data")), rates, strict=True):
                if folder is None:
                    folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
                    store, base = self._place(f"_temporary/{self.job}/{folder}")
                    store.create_dir(base, recursive=True)
                if audio is None or rate is None:
                    raise ValueError(f"record {key} has no clip")
                with store.open_output_stream(f"{base}/{key}.{self.form}") as f:
                    f.write(ENCODERS[self.form](audio, rate, self.bits))
                files += 1
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._place()
        done = [m.folder for m in messages if m is not None and m.folder]
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.base_name != "_temporary":
                    store.delete_dir(info.path) if info.type == fs.FileType.Directory else store.delete_file(info.path)
        for folder in done:
            store.move(f"{base}/_temporary/{self.job}/{folder}", f"{base}/{folder.rsplit('-', 1)[0]}-{self.job}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, base = self._place("_temporary")
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")
        if store.get_file_info(base).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(base)):
            store.delete_dir(base)


class ClipFiles(DataSource):
    """``spark.read.format("clipfile").option("duration", 1.0).load(directory)``: one row for each file.

    Options: sample_rate, offset, duration, mono, extensions (with commas), max_depth, follow_symlinks,
    files_per_partition. Files are read where the partition runs, so directories must be mounted there;
    for other stores use :func:`load_index`.

    ``df.write.format("clipfile").mode("append").save(directory)`` writes rows (record_key, clip) as <record_key>.wav, into any store that PyArrow
    knows; options are form (wav, flac) and bits. With mode overwrite what was there goes when the job commits.
    """

    @classmethod
    def name(cls) -> str:
        return "clipfile"

    def schema(self) -> T.StructType:
        return ROW

    def reader(self, schema: T.StructType) -> ClipReader:
        return ClipReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ClipWriter:
        if not {"record_key", "clip"} <= set(schema.names):
            raise ValueError("rows to write need record_key and clip")
        return ClipWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipFiles)


def with_content(index: DataFrame, directory: str) -> DataFrame:
    """An index (path) with the files' bytes, read by Spark; an index row whose file isn't below the directory is an error.

    Only for stores that tasks can't open by themselves: Spark lists the whole folder and shuffles the contents. Elsewhere :func:`load_index`
    opens the index's own paths.
    """
    files = index.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    key, missing = f"{HELPER}_path", F.raise_error(F.concat(F.lit("no file "), F.col("path")))
    found = index.withColumn(key, stores.canonical_column(F.col("path"))).join(files.select(stores.canonical_column(F.col("path")).alias(key), "content"), key, "left")
    return found.withColumn("content", F.when(F.col("content").isNull(), missing.cast("binary")).otherwise(F.col("content"))).drop(key)


ROWS = T.StructType([T.StructField("record_key", T.LongType()), *ROW.fields])


def _records(rows: DataFrame, one: Callable, duration: float | None) -> DataFrame:
    """Rows (record_key, clip) made by ``one``, which maps a batch to (path, clip, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((made for batch in batches for made in one(batch)), duration, True)

    return rows.mapInArrow(run, ROWS).select("record_key", F.struct(*[f.name for f in CLIP.fields]).alias("clip"))


def load_index(
    index: DataFrame, sample_rate: int | None = 44100, mono: bool = True, duration: float | None = 1.0, offset: float = 0.0, saliency: SaliencyParams | None = None, seed: int = 0, cpu: bool = True,
    opener: stores.Opener = stores.open_input, task_bytes: int = stores.TASK_BYTES,
) -> DataFrame:
    """Rows (record_key, clip) of an index with record_key, path and, if Spark read the files, content.

    Tasks open the index's own paths in any store that PyArrow knows and read the header and the frames of the excerpt; an index with a
    ``length`` is dealt out by it first. A file that isn't there is an error. With saliency each record's excerpt is searched with
    random numbers of its key; else the clip starts at ``offset``. ``cpu`` is accepted and has no effect.
    """
    has = "content" in index.columns
    source = index.select("record_key", "path", *["content"] * has, *["length"] * ("length" in index.columns and not has))
    if "length" in source.columns:
        source = stores.packed(source, "length", task_bytes)

    def one(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, (key, path) in enumerate(zip(batch.column("record_key").to_pylist(), batch.column("path").to_pylist(), strict=True)):
            with io.BytesIO(batch.column("content")[i].as_py()) if has else opener(path) as f:
                yield path, load(f, key if key is not None else path, sample_rate, mono, offset, duration, saliency, seed), key

    return _records(source, one, duration)


def probe_index(index: DataFrame, opener: stores.Opener = stores.open_input) -> DataFrame:
    """Rows (record_key, path, channels, sample_rate, bits, frames) of an index: tasks read what is before the samples of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column("path").to_pylist():
                with opener(path) as f:
                    h = decode.probe(f)
                heads.append((h.channels, h.sample_rate, h.bits, h.frames))
            columns = [pa.array(c, t) for c, t in zip(zip(*heads, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)] if heads else []
            if heads:
                yield pa.RecordBatch.from_arrays([batch.column("record_key"), batch.column("path"), *columns], ["record_key", "path", "channels", "sample_rate", "bits", "frames"])

    rows = index.select(F.col("record_key").cast("long").alias("record_key"), "path")
    return rows.mapInArrow(run, "record_key long, path string, channels int, sample_rate int, bits int, frames long")


def load_excerpts(
    index: DataFrame, duration: float, search: str | Draw = "uniform", offset: float = 0.0, sample_rate: int | None = None, mono: bool = False, seed: int = 0,
    opener: stores.Opener = stores.open_input, task_bytes: int = stores.TASK_BYTES,
) -> DataFrame:
    """Rows (record_key, clip): a random excerpt of each file of an index (record_key, path), as :func:`random_excerpts` draws it of a clip.

    Headers are probed first and make a table; offsets are drawn from it by Spark, keyed by the record. Then
    tasks of about ``task_bytes`` read the drawn frames, and nothing else of the files. A file that is shorter gives all it has, filled with zeros.
    """
    if duration <= 0:
        raise ValueError("an excerpt needs a duration")
    probed = cut(probe_index(index, opener), "probed")
    u = Stream(seed, F.col("record_key"), "excerpt").uniform("offset")
    at = offset_column(search, u, offset, duration, F.col("frames") / F.col("sample_rate"), F.lit(0), 1)
    size = F.ceil(F.least(F.lit(float(duration)) * F.col("sample_rate"), F.col("frames")) * F.col("channels") * F.col("bits") / 8).cast("long")
    drawn = stores.packed(probed.select("record_key", "path", at.alias("at"), size.alias("size")), "size", task_bytes)

    def one(batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, path, start in zip(*(batch.column(c).to_pylist() for c in ("record_key", "path", "at")), strict=True):
            with opener(path) as f:
                yield path, load(f, key, sample_rate, mono, start, duration, None), key

    return _records(drawn, one, duration)


def write_wav(clips: DataFrame, directory: str, clip_col: str = "clip", bits: int = 16, form: str = "wav") -> None:
    """Write each record's clip as <record_key>.wav (or, with ``form="flac"``, .flac) into a directory that all executors share."""
    encode = ENCODERS[form]
    source = clips.select(F.col("record_key").cast("bigint").alias("k"), F.col(clip_col)["audio_data"].alias("a"), F.col(clip_col)["sample_rate"].alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(directory, exist_ok=True)
        for batch in batches:
            for key, audio, rate in zip(batch.column("k").to_pylist(), clip_arrays(batch.column("a")), batch.column("r").to_pylist(), strict=True):
                to = os.path.join(directory, f"{key}.{form}")
                part = f"{to}.{TaskContext.get().taskAttemptId()}.part"
                with open(part, "wb") as f:  # a task that runs again writes the same file
                    f.write(encode(audio, rate, bits))
                os.replace(part, to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    source.mapInArrow(run, "n long").agg(F.sum("n")).collect()
