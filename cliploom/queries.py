"""One query for each operator, over the supplied tables, and the DuckDB SQL of what it gives.

Embeddings stand in for clips: ``vec_id`` is the record key, the vector the samples, at a nominal
8000 Hz. Audio is reported by its length and a position-weighted sum, as an integer of 1/10000.
"""

from __future__ import annotations

import uuid
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as e
from .functions import kernels as k
from .operators import arrow
from .operators import transforms as t
from .operators.base import MapTransform, RandomTransform
from .operators.compose import Choose, Pipeline, ReduceBatch, batch
from .plans import chunked
from .plans import saliency as sal
from .schema import CLIP, clip
from .shared import mounted_dir, shared_dir
from .sources import files as remote
from .sources import index as ix
from .sources import load

RATE = 8000


# ------------------------------------------------------------------------- inputs
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mono(spark, sf_dir, factor: float = 1.0) -> DataFrame:
    """(record_key, clip): each vector as one channel."""
    samples = F.col("embedding") if factor == 1.0 else F.transform("embedding", lambda x: (x.cast("double") * factor).cast("float"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_key"), clip(e.from_array(samples, 1), RATE).alias("clip"))


def stereo(spark, sf_dir) -> DataFrame:
    """(record_key, clip): vectors 2k and 2k+1 as two channels."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("c"), F.floor(F.col("vec_id") / 2).alias("record_key"), "embedding")
    both = v.groupBy("record_key").agg(F.min_by("embedding", "c").alias("a"), F.max_by("embedding", "c").alias("b"), F.count("*").alias("n")).where("n = 2")
    return both.select("record_key", clip(F.array("a", "b"), RATE).alias("clip"))


def nested(spark, sf_dir) -> DataFrame:
    """(record_key, src, target): each vector and the next one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_key"), clip(e.from_array(F.col("embedding"), 1), RATE).alias("c"))
    after = v.select((F.col("record_key") - 1).alias("record_key"), F.col("c").alias("target"))
    return v.withColumnRenamed("c", "src").join(after, "record_key")


def listed(spark, sf_dir) -> DataFrame:
    """(record_key, pair struct<src: array<clip>, target: clip>)."""
    return nested(spark, sf_dir).select("record_key", F.struct(F.array("src", "target").alias("src"), F.col("target")).alias("pair"))


def files(spark, sf_dir) -> DataFrame:
    """Labels as groups, vectors as files."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("label").alias("group_idx"), F.concat(F.lit("g"), "label").alias("group_name"), (F.col("vec_id") % 2).cast("int").alias("folder_idx"), F.format_string("f%08d", "vec_id").alias("path"))


def long_clips(spark, sf_dir) -> DataFrame:
    """(record_key, clip): each user's values in time order, at 10 Hz."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    return rows.select(F.col("user_id").alias("record_key"), clip(e.from_array(F.transform("v", lambda x: x["value"]), 1), 10).alias("clip"))


def weighted(samples: Column) -> Column:
    """Sum of samples times their 1-based place, in 1/10000."""
    each = F.transform(samples, lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return whole(total)


def whole(value: Column) -> Column:
    return F.floor(value * 10000.0 + 0.5).cast("bigint")


def report(df: DataFrame, *names: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    """record_key, and each named clip's number of samples and weighted sum."""
    columns = []
    for name in names:
        flat = F.flatten(F.col(f"{name}.audio_data"))
        label = name.replace(".", "_")
        columns += [F.size(flat).cast("bigint").alias(f"{label}_n"), weighted(flat).alias(f"{label}_sum")]
    return df.select("record_key", *columns, *extra)


# ------------------------------------------------------------------------ SQL parts
def sql_u(transform: str, leaf: str, purpose: str, i: str = "0", key: str = "k", index: str = "", seed: int = 0) -> str:
    text = f"'{seed}|' || {key} || '|{transform}|{leaf}|{index}|{purpose}|' || {i}"
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0)"


def sql_sum(samples: str) -> str:
    return f"CAST(floor(coalesce(list_sum(list_transform({samples}, lambda x, i: CAST(x AS DOUBLE) * i)), 0) * 10000.0 + 0.5) AS BIGINT)"


def sql_gain(samples: str, db: str) -> str:
    return f"list_transform({samples}, lambda x: CAST(CAST(x AS DOUBLE) * pow(10.0, ({db}) / 20.0) AS FLOAT))"


def sql_report(source: str, *named: str, key: str = "k", extra: str = "", before: str = "") -> str:
    """SELECT of a report; ``named`` are name=expression of flat samples."""
    parts = []
    for item in named:
        name, samples = item.split("=", 1)
        parts += [f"CAST(len({samples}) AS BIGINT) AS {name}_n", f"{sql_sum(samples)} AS {name}_sum"]
    return f"{before} SELECT {key} AS record_key, {', '.join(parts)}{extra} FROM {source}"


MONO = "(SELECT vec_id AS k, embedding AS a FROM embeddings)"
FOURFOLD = "(SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * 4 AS FLOAT)) AS a FROM embeddings)"
STEREO = "(SELECT x.vec_id // 2 AS k, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0)"
NESTED = "(SELECT x.vec_id AS k, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
LONG = "(SELECT user_id AS k, list(CAST(value AS FLOAT) ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)"
FILES = "(SELECT label AS group_idx, 'g' || label AS group_name, CAST(vec_id % 2 AS INT) AS folder_idx, printf('f%08d', vec_id) AS path FROM embeddings)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources and indexes
@query(sql_report(MONO, "clip=a"))
def from_array(spark, sf_dir):
    return report(mono(spark, sf_dir), "clip")


@query(f"SELECT row_number() OVER (ORDER BY group_idx, folder_idx, path) - 1 AS record_key, group_name, path FROM {FILES}")
def simple_index(spark, sf_dir):
    return ix.simple_index(files(spark, sf_dir)).select("record_key", "group_name", "path")


@query(f"SELECT record_key, path FROM (SELECT row_number() OVER (ORDER BY group_idx, folder_idx, path) - 1 AS record_key, path FROM {FILES}) WHERE record_key < 300")
def first_records(spark, sf_dir):
    """The feature ``num_steps``: an index of so many records."""
    return ix.SimpleSource(files(spark, sf_dir), 300).index.select("record_key", "path")


BALANCED = """
WITH f AS ({files}), c AS (SELECT group_idx, count(*) AS n FROM f GROUP BY group_idx),
p AS (SELECT group_idx, n, row_number() OVER (ORDER BY group_idx) - 1 AS g, count(*) OVER () AS ng FROM c),
l AS (SELECT *, (({steps} + ng - 1) // ng + n - 1) // n AS loops FROM p),
s AS (SELECT *, coalesce(sum(loops) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM l),
x AS (SELECT f.*, s.n, s.g, s.ng, unnest(generate_series(0, loops - 1)) AS pass, s0 FROM f JOIN s USING (group_idx)),
r AS (SELECT *, (row_number() OVER (PARTITION BY group_idx, pass ORDER BY md5((s0 + pass)::BIGINT || '|' || folder_idx || '|' || path || '|1')) - 1 + pass * n) * ng + g AS record_key FROM x)
"""


ALL = "(SELECT count(*) FROM embeddings)"


@query(BALANCED.format(files=f"SELECT * FROM {FILES}", steps=ALL) + f"SELECT CAST(record_key AS BIGINT) AS record_key, group_name, path, CAST(s0 + pass AS BIGINT) AS seed FROM r WHERE record_key < {ALL}")
def balanced_index(spark, sf_dir):
    """As many records as there are files."""
    rows = files(spark, sf_dir)
    return ix.balanced_index(rows, rows.count()).select("record_key", "group_name", "path", F.col("seed").cast("bigint").alias("seed"))


@query(f"SELECT k.vec_id AS record_key, path FROM embeddings k JOIN (SELECT row_number() OVER (ORDER BY group_idx, folder_idx, path) - 1 AS record_key, path FROM {FILES}) x ON x.record_key = k.vec_id")
def record_lookup(spark, sf_dir):
    """All ids of the table as keys; those that the index lacks give no row."""
    return ix.lookup(ix.simple_index(files(spark, sf_dir)), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_key"))).select("record_key", "path")


@query(f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY group_idx ORDER BY folder_idx, path) - 1 AS i FROM {FILES}),
c AS (SELECT group_idx, count(*) AS n, row_number() OVER (ORDER BY group_idx) - 1 AS g, count(*) OVER () AS ng FROM f GROUP BY group_idx),
k AS (SELECT vec_id * 3 AS record_key FROM embeddings),
p AS (SELECT record_key, group_idx, n, g, record_key // ng // n AS pass, record_key // ng % n AS place FROM k JOIN c ON c.g = record_key % ng),
w AS (
  SELECT *, list_reduce(list_prepend(place, generate_series(1, CAST(12 + 3 * ceil(log2(n + 1.0)) AS BIGINT))), lambda x, r: CASE WHEN
    ('0x' || substr(md5('0|' || g || '|' || pass || '|' || r || '|' || greatest(x, ((('0x' || substr(md5('0|' || g || '|' || pass || '|' || r), 1, 13))::BIGINT - x) % n + n) % n)), 1, 13))::BIGINT % 2 = 1
    THEN ((('0x' || substr(md5('0|' || g || '|' || pass || '|' || r), 1, 13))::BIGINT - x) % n + n) % n ELSE x END) AS i FROM p)
SELECT record_key, group_name, path, CAST(pass AS BIGINT) AS pass FROM w JOIN f USING (group_idx, i)""")
def balanced_lookup(spark, sf_dir):
    """Every third record of a balanced sequence that is nowhere written, far beyond its first pass."""
    source = ix.KeyedBalancedSource(files(spark, sf_dir))
    return source.lookup(table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("record_key"))).select("record_key", "group_name", "path", "pass")


@query("SELECT page_id, url FROM pages WHERE ends_with(lower(url), '5') OR ends_with(lower(url), 'ref=x')")
def suffix_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(e.has_extension(F.col("url"), ("5", "REF=X"))).select("page_id", "url")


def _wav_folder(clips: DataFrame, below: str | None = None) -> str:
    """Clips as WAV files in a folder that executors and driver share, or in a folder below it."""
    folder = below or f"{mounted_dir(clips.sparkSession)}/wav-{uuid.uuid4().hex}"
    load.write_wav(clips, folder, bits=-32)
    return folder


def _remote_files(spark, sf_dir) -> tuple[str, DataFrame]:
    """Even and odd vectors as two groups of WAV files, listed by Spark."""
    clips, base = mono(spark, sf_dir), f"{mounted_dir(spark)}/wav-{uuid.uuid4().hex}"
    for name, rest in (("even", 0), ("odd", 1)):
        _wav_folder(clips.where(F.col("record_key") % 2 == rest), f"{base}/{name}")
    return base, ix.remote_file_table(spark, {name: [f"{base}/{name}"] for name in ("even", "odd")})


REMOTE = "(SELECT row_number() OVER (ORDER BY vec_id % 2, printf('%d.wav', vec_id)) - 1 AS record_key, CASE vec_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS group_name, printf('%d.wav', vec_id) AS file, embedding FROM embeddings)"


@query(f"SELECT record_key, group_name, file FROM {REMOTE}")
def remote_index(spark, sf_dir):
    index = ix.simple_index(_remote_files(spark, sf_dir)[1])
    return index.select("record_key", "group_name", F.regexp_extract("path", r"[^/]+$", 0).alias("file"))


@query(sql_report(REMOTE, "clip=embedding[9:48]", key="record_key"))
def load_index(spark, sf_dir):
    """Files of an index opened by tasks, and an excerpt of each."""
    index = ix.simple_index(_remote_files(spark, sf_dir)[1])
    return report(load.load_index(index, None, duration=40 / RATE, offset=8 / RATE), "clip")


@query(sql_report(REMOTE, "clip=embedding[9:48]", key="record_key"))
def load_index_content(spark, sf_dir):
    """The same of contents that Spark reads, as for stores that tasks can't open."""
    base, rows = _remote_files(spark, sf_dir)
    return report(load.load_index(load.with_content(ix.simple_index(rows), base), None, duration=40 / RATE, offset=8 / RATE), "clip")


DRAWN = f"(SELECT *, {sql_u('excerpt', '', 'offset', key='record_key')} * (64 / 8000.0::DOUBLE - 40 / 8000.0::DOUBLE) AS o FROM {REMOTE})"


@query(f"SELECT record_key, CAST(len(a) AS BIGINT) AS clip_n, {sql_sum('a')} AS clip_sum, CAST(floor(o * 1e9 + 0.5) AS BIGINT) AS offset_nano FROM (SELECT *, embedding[CAST(floor(o * 8000) AS BIGINT) + 1:CAST(floor(o * 8000) AS BIGINT) + 40] AS a FROM {DRAWN})")
def file_excerpt(spark, sf_dir):
    """A random excerpt of each file: headers probed, offsets drawn, and only the drawn frames read."""
    index = ix.simple_index(_remote_files(spark, sf_dir)[1])
    offset = F.floor(F.col("clip.metadata.offset") * 1e9 + 0.5).cast("bigint").alias("offset_nano")
    return report(load.load_excerpts(index, 40 / RATE), "clip", extra=(offset,))


@query("SELECT printf('%d.flac', vec_id) AS file, 8000 AS sample_rate, 40 AS n, " + sql_sum("list_transform(embedding[9:48], lambda x: CAST(round_even(CAST(x AS DOUBLE) * 32768, 0) / 32768 AS FLOAT))") + " AS total FROM embeddings")
def flac_scan(spark, sf_dir):
    """FLAC files, written and read here: samples of 16 bits come back exactly."""
    load.register(spark)
    folder = f"{mounted_dir(spark)}/flac-{uuid.uuid4().hex}"
    load.write_wav(mono(spark, sf_dir), folder, form="flac")
    rows = spark.read.format("clipfile").option("offset", 8 / RATE).option("duration", 40 / RATE).load(folder)
    flat = F.flatten("audio_data")
    return rows.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "sample_rate", F.size(flat).alias("n"), weighted(flat).alias("total"))


@query("SELECT printf('%d.wav', vec_id) AS file, 8000 AS sample_rate, 40 AS n, " + sql_sum("embedding[9:48]") + " AS total FROM embeddings")
def clipfile_scan(spark, sf_dir):
    load.register(spark)
    rows = spark.read.format("clipfile").option("offset", 8 / RATE).option("duration", 40 / RATE).load(_wav_folder(mono(spark, sf_dir)))
    flat = F.flatten("audio_data")
    return rows.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "sample_rate", F.size(flat).alias("n"), weighted(flat).alias("total"))


@query("SELECT row_number() OVER (ORDER BY printf('%d.wav', vec_id)) - 1 AS record_key, printf('%d.wav', vec_id) AS file FROM embeddings WHERE vec_id % 10 = 5")
def pattern_index(spark, sf_dir):
    """A folder entry with wildcards: its files, whatever their extension, are listed by tasks."""
    base, _ = _remote_files(spark, sf_dir)
    index = ix.simple_index(ix.remote_file_table(spark, {"fives": [f"{base}/o[cd]d/*5.w?v"]}, (".none",)))
    return index.select("record_key", F.regexp_extract("path", r"[^/]+$", 0).alias("file"))


@query("SELECT d AS max_depth, count(*) AS n FROM embeddings, (SELECT unnest([1, 2]) AS d) WHERE d > 0 GROUP BY d UNION ALL SELECT 0, 0")
def depth_listing(spark, sf_dir):
    """How many files lie within so many levels below a folder: none in itself, all in its two folders."""
    base, _ = _remote_files(spark, sf_dir)
    counts = [remote.list_remote(spark, base, max_depth=d).agg(F.lit(d).alias("max_depth"), F.count("*").alias("n")) for d in range(3)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT 'simple' AS source, count(*) AS n FROM embeddings UNION ALL SELECT 'balanced', 2 * count(*) FROM embeddings")
def source_lengths(spark, sf_dir):
    """A simple source is as long as its files, a balanced one as long as it was asked to be."""
    rows = files(spark, sf_dir)
    lengths = [("simple", len(ix.SimpleSource(rows))), ("balanced", len(ix.BalancedSource(rows, 2 * rows.count())))]
    return spark.createDataFrame(lengths, "source string, n long")


@query("SELECT CAST(vec_id % 3 AS INT) AS group_idx, count(*) AS n, NULL AS refused FROM embeddings WHERE vec_id % 3 < 2 GROUP BY 1 UNION ALL SELECT 2, 0, 'group ''none'': no .wav, .flac files in its 2 folders'")
def empty_group(spark, sf_dir):
    """Groups of files; the one whose folders hold none is refused by name."""
    base = f"{mounted_dir(spark)}/wav-{uuid.uuid4().hex}"
    clips = mono(spark, sf_dir)
    found = []
    for g, name in enumerate(("zero", "one")):
        _wav_folder(clips.where(F.col("record_key") % 3 == g), f"{base}/{name}")
        found.append((g, ix.remote_file_table(spark, {name: [f"{base}/{name}"]}).count(), None))
    try:
        ix.remote_file_table(spark, {"zero": [f"{base}/zero"], "none": [f"{base}/none*", f"{base}/*/none"]})
    except RuntimeError as e:
        found.append((2, 0, str(e)))
    return spark.createDataFrame(found, "group_idx int, n long, refused string")


@query("SELECT printf('%d.wav', vec_id) AS file, len(embedding) AS n, " + sql_sum("embedding") + " AS total FROM embeddings")
def clipfile_write(spark, sf_dir):
    """Clips written by the data source, committed by tasks, and read again."""
    load.register(spark)
    folder = f"{mounted_dir(spark)}/written-{uuid.uuid4().hex}"
    mono(spark, sf_dir).write.format("clipfile").option("bits", -32).mode("append").save(folder)
    flat = F.flatten("audio_data")
    return spark.read.format("clipfile").load(folder).select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), F.size(flat).cast("bigint").alias("n"), weighted(flat).alias("total"))


@query("SELECT printf('%d.wav', vec_id) AS file, 40 AS n, " + sql_sum("embedding[9:48]") + " AS total FROM embeddings")
def stream_clip_files(spark, sf_dir):
    """WAV files as a stream: each admitted once, its excerpt read by tasks."""
    from .streaming import stream_clip_files

    base = f"{mounted_dir(spark)}/stream-{uuid.uuid4().hex}"
    clips = stream_clip_files(spark, _wav_folder(mono(spark, sf_dir), f"{base}/in"), sample_rate=None, duration=40 / RATE, offset=8 / RATE)
    clips.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    flat = F.flatten("clip.audio_data")
    return spark.read.schema(clips.schema).parquet(f"{base}/out").select(F.regexp_extract("clip.metadata.filepath", r"[^/]+$", 0).alias("file"), F.size(flat).alias("n"), weighted(flat).alias("total"))


# ------------------------------------------------------------------------- functions
@query("SELECT page_id, CAST(greatest(len(url), 256) AS INT) AS n, CAST(list_sum(list_transform(string_split(url, ''), lambda c, i: unicode(c) * i)) AS BIGINT) AS total FROM pages")
def encode_path(spark, sf_dir):
    codes = e.encode_path(F.col("url"))
    total = F.aggregate(F.transform(codes, lambda c, i: c.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return table(spark, sf_dir, "pages").select("page_id", F.size(codes).alias("n"), total.alias("total"))


@query("SELECT page_id, url || ' é😀' AS back FROM pages")
def decode_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", e.decode_path(e.encode_path(F.concat("url", F.lit(" é😀")))).alias("back"))


@query(sql_report(STEREO, "clip=list_transform(list_zip(a, b), lambda p: CAST((CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) / 2 AS FLOAT))"))
def to_mono(spark, sf_dir):
    return report(t.ToMono()(stereo(spark, sf_dir)), "clip")


@query(sql_report(STEREO, "clip=list_concat(b, a)"))
def swap_stereo(spark, sf_dir):
    return report(t.SwapStereo()(stereo(spark, sf_dir)), "clip")


@query(sql_report(MONO, "clip=list_transform(a, lambda x: -x)"))
def invert_phase(spark, sf_dir):
    return report(t.InvertPhase()(mono(spark, sf_dir)), "clip")


@query(sql_report(f"(SELECT k, a, greatest(1.0, list_max(list_transform(a, lambda x: abs(CAST(x AS DOUBLE))))) AS p FROM {FOURFOLD})", "clip=list_transform(a, lambda x: CAST(CAST(x AS DOUBLE) / p AS FLOAT))"))
def rescale_audio(spark, sf_dir):
    return report(t.RescaleAudio()(mono(spark, sf_dir, 4.0)), "clip")


@query(sql_report(f"(SELECT k, a, greatest(1.0, list_max(list_transform(a, lambda x: abs(CAST(x AS DOUBLE))))) AS p FROM {FOURFOLD})", "clip=list_transform(a, lambda x: CAST(CAST(x AS DOUBLE) / p AS FLOAT))"))
def sql_rescale(spark, sf_dir):
    e.register_sql(spark)
    rows = mono(spark, sf_dir, 4.0).select("record_key", F.expr("clip_rescale(clip.audio_data)").alias("a"))
    return report(rows.select("record_key", F.struct(F.col("a").alias("audio_data")).alias("clip")), "clip")


@query(sql_report(MONO, "clip=a"))
def identity(spark, sf_dir):
    return report(t.Identity()(mono(spark, sf_dir)), "clip")


CHANGE = f"(-12.0 + {sql_u('VolumeChange', 'clip', 'gain')} * 18.0)"


@query(sql_report(MONO, f"clip={sql_gain('a', CHANGE)}"))
def volume_change(spark, sf_dir):
    return report(t.VolumeChange({"min_db": -12, "max_db": 6})(mono(spark, sf_dir)), "clip")


@query(sql_report(MONO, f"clip={sql_gain('a', CHANGE)}"))
def stream_volume_change(spark, sf_dir):
    """The same, as a stream over the table's files."""
    from .streaming import run_transform

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "embeddings")
    source.select(F.col("vec_id").alias("record_key"), clip(e.from_array(F.col("embedding"), 1), RATE).alias("clip")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    run_transform(stream, t.VolumeChange({"min_db": -12, "max_db": 6}), f"{base}/out", f"{base}/state").awaitTermination()
    return report(spark.read.parquet(f"{base}/out"), "clip")


SHARED = f"(-12.0 + {sql_u('VolumeChange', '', 'gain')} * 18.0)"


@query(sql_report(NESTED, f"src={sql_gain('a', SHARED)}", f"target={sql_gain('b', SHARED)}"))
def volume_change_shared_seed(spark, sf_dir):
    return report(t.VolumeChange({"min_db": -12, "max_db": 6}, split_seed=False)(nested(spark, sf_dir)), "src", "target")


def sql_list_gain(samples: str, index: int) -> str:
    return sql_gain(samples, f"(-12.0 + {sql_u('VolumeChange', 'pair/src', 'gain', index=str(index))} * 18.0)")


@query(sql_report(NESTED, f"first={sql_list_gain('a', 0)}", f"second={sql_list_gain('b', 1)}", f"target={sql_gain('b', '(-12.0 + ' + sql_u('VolumeChange', 'pair/target', 'gain') + ' * 18.0)')}"))
def volume_change_list(spark, sf_dir):
    out = t.VolumeChange({"min_db": -12, "max_db": 6})(listed(spark, sf_dir))
    return report(out.select("record_key", F.col("pair.src")[0].alias("first"), F.col("pair.src")[1].alias("second"), F.col("pair.target").alias("target")), "first", "second", "target")


@query(sql_report(NESTED, *(f"{n}=CASE WHEN {sql_u('InvertPhase', '', 'prob')} < 0.3 THEN list_transform({c}, lambda x: -x) ELSE {c} END" for n, c in (("src", "a"), ("target", "b")))))
def prob_gate(spark, sf_dir):
    return report(_RandomInvert(prob=0.3, name="InvertPhase")(nested(spark, sf_dir)), "src", "target")


class _RandomInvert(RandomTransform):
    def apply(self, value, spot):
        return t.InvertPhase.apply(self, value, spot)


class _Add(MapTransform):
    """Adds a constant to every sample."""

    defaults = {"amount": 1.0, "times": 1.0}

    def apply(self, value, spot):
        o = spot.options
        return t.with_fields(value, spot.leaf.kind, audio_data=e.each_sample(value["audio_data"], lambda x: x * o["times"] + o["amount"]))


def _tree(spark, sf_dir) -> DataFrame:
    n = nested(spark, sf_dir)
    return n.select("record_key", F.col("src").alias("a"), F.struct(F.col("src").alias("e"), F.col("target").alias("f")).alias("d"))


@query(sql_report(NESTED, *(f"{n}=list_transform({c}, lambda x: CAST(CAST(x AS DOUBLE) * {m} + {p} AS FLOAT))" for n, c, m, p in (("a", "a", 1.0, 5.0), ("d_e", "a", 2.0, -1.0), ("d_f", "b", 3.0, 5.0)))))
def config_inheritance(spark, sf_dir):
    config = {"amount": 5.0, "d": {"times": 2.0, "e": {"amount": -1.0}, "f": {"times": 3.0}}}
    return report(_Add(config)(_tree(spark, sf_dir)), "a", "d.e", "d.f")


@query(sql_report(NESTED, "a=a", "d_e=list_transform(a, lambda x: CAST(CAST(x AS DOUBLE) * 1.0 + 1.0 AS FLOAT))", "d_f=b"))
def scope_filter(spark, sf_dir):
    return report(_Add(scope={"d": {"scope": True, "f": {"scope": False}}})(_tree(spark, sf_dir)), "a", "d.e", "d.f")


@query(sql_report(NESTED, "d_e=a", "d_e_louder=list_transform(a, lambda x: CAST(CAST(x AS DOUBLE) * 2.0 + 0.0 AS FLOAT))", "d_f=b", "d_f_louder=list_transform(b, lambda x: CAST(CAST(x AS DOUBLE) * 2.0 + 0.0 AS FLOAT))"))
def output_key(spark, sf_dir):
    out = _Add({"amount": 0.0, "times": 2.0}, scope={"d": {"scope": True}}, output_key=lambda path: f"{path[-1]}_louder")(_tree(spark, sf_dir))
    return report(out, "d.e", "d.e_louder", "d.f", "d.f_louder")


class _RandomAdd(RandomTransform):
    defaults = {"amount": 1.0}

    def apply(self, value, spot):
        return t.with_fields(value, spot.leaf.kind, audio_data=e.each_sample(value["audio_data"], lambda x: x + spot.options["amount"]))


@query(f"SELECT k AS record_key, CASE WHEN {sql_u('RandomAdd', '', 'prob')} < 0.3 THEN {sql_sum('list_transform(a, lambda x: CAST(CAST(x AS DOUBLE) + 1.0 AS FLOAT))')} END AS more, 'e,f,e_more' AS fields FROM {NESTED}")
def sibling_by_coin(spark, sf_dir):
    """A sibling is null where the coin says no, and a leaf out of scope gets none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = _RandomAdd(prob=0.3, scope={"d": {"scope": True, "f": {"scope": False}}}, output_key=lambda path: f"{path[-1]}_more", name="RandomAdd")(_tree(spark, sf_dir))
    made = F.when(F.col("d.e_more").isNotNull(), weighted(F.flatten("d.e_more.audio_data")))
    return out.select("record_key", made.alias("more"), F.lit(",".join(out.schema["d"].dataType.names)).alias("fields"))


@query(sql_report(LONG, "long=list_concat(a, list_transform(generate_series(1, 120 - len(a)), lambda i: CAST(0 AS FLOAT)))", "short=a[1:20]"))
def pad_clip(spark, sf_dir):
    out = long_clips(spark, sf_dir)
    return report(out.select("record_key", F.struct(e.pad(F.col("clip.audio_data"), 120).alias("audio_data")).alias("long"), F.struct(e.pad(F.col("clip.audio_data"), 20).alias("audio_data")).alias("short")), "long", "short")


@query("SELECT vec_id AS record_key, CAST(ceil((len(embedding) - 16 + 1) / 8.0) AS INT) AS n, " + sql_sum("list_transform(generate_series(0, 48, 8), lambda s: list_sum(list_transform(embedding[s + 1:s + 16], lambda x: CAST(x AS DOUBLE))))") + " AS total FROM embeddings")
def frame_sums(spark, sf_dir):
    cut = e.frames(F.col("embedding"), 16, 8)
    sums = F.transform(cut, lambda f: F.aggregate(f, F.lit(0.0), lambda a, x: a + x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_key"), F.size(cut).alias("n"), weighted(sums).alias("total"))


@query("SELECT vec_id AS record_key, CAST(f AS INT) AS frame, 16 AS n, " + sql_sum("embedding[f * 8 + 1:f * 8 + 16]") + " AS total FROM embeddings, range(0, 7) r(f)")
def table_frames(spark, sf_dir):
    """Frames from SQL text, by a table function."""
    e.register_table_functions(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("cliploom_vectors")
    rows = spark.sql("SELECT vec_id AS record_key, frame, f.samples FROM cliploom_vectors, LATERAL clip_frames(embedding, 16, 8) f")
    return rows.select("record_key", "frame", F.size("samples").alias("n"), weighted(F.col("samples")).alias("total"))


@query("SELECT vec_id AS record_key, CAST(f * 24 AS INT) AS start, least(24, 64 - f * 24)::INT AS n, " + sql_sum("embedding[f * 24 + 1:f * 24 + 24]") + " AS total FROM embeddings, range(0, 3) r(f)")
def table_excerpts(spark, sf_dir):
    e.register_table_functions(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("cliploom_vectors")
    rows = spark.sql("SELECT vec_id AS record_key, start, f.samples FROM cliploom_vectors, LATERAL clip_excerpts(embedding, 8000, 0.003D) f")
    return rows.select("record_key", "start", F.size("samples").alias("n"), weighted(F.col("samples")).alias("total"))


# -------------------------------------------------------------------------- saliency
def _offsets(search: str) -> str:
    u = sql_u("saliency", "", "offset", "t")
    low, high = "0.0", "greatest(len(a) / 10.0 - 2.0, 0.0)"
    if search == "early":
        high = f"({high} * (1 - t / 3.0) + least({high}, 0.0 + 2.0) * (t / 3.0))"
    return f"SELECT k AS record_key, CAST(t AS INT) AS attempt, CAST(floor(({low} + {u} * ({high} - {low})) * 10000.0 + 0.5) AS BIGINT) AS offset_ FROM (SELECT k, a, unnest(generate_series(0, 3)) AS t FROM {LONG})"


def _drawn(spark, sf_dir, search):
    tries = sal.attempts(long_clips(spark, sf_dir), 2.0, sal.SaliencyParams(True, 4, -40.0, search))
    return tries.select("record_key", "attempt", whole(F.col("offset")).alias("offset_"))


@query(_offsets("uniform"))
def excerpt_offset_uniform(spark, sf_dir):
    return _drawn(spark, sf_dir, "uniform")


@query(_offsets("uniform"))
def table_tries(spark, sf_dir):
    """The same tries from SQL text, by a table function."""
    e.register_table_functions(spark)
    long_clips(spark, sf_dir).createOrReplaceTempView("cliploom_long")
    rows = spark.sql("SELECT record_key, attempt, t.offset FROM cliploom_long, LATERAL clip_tries(cast(record_key as string), size(clip.audio_data[0]) / 10D, 2D, 4, 0) t")
    return rows.select("record_key", "attempt", whole(F.col("offset")).alias("offset_"))


@query(_offsets("early"))
def excerpt_offset_early(spark, sf_dir):
    return _drawn(spark, sf_dir, "early")


@query(sql_report(f"(SELECT k, a[CAST(floor({sql_u('excerpt', '', 'offset')} * (len(a) / 10.0 - 2.0) * 10) AS BIGINT) + 1 : CAST(floor({sql_u('excerpt', '', 'offset')} * (len(a) / 10.0 - 2.0) * 10) AS BIGINT) + 20] AS a FROM {LONG})", "clip=a"))
def random_excerpt(spark, sf_dir):
    return report(sal.random_excerpts(long_clips(spark, sf_dir), 2.0), "clip")


@query("SELECT user_id AS record_key, coalesce(min(event_id) FILTER (WHERE value > 300), arg_max(event_id, {'v': value, 'a': -event_id})) AS attempt FROM events GROUP BY user_id")
def saliency_pick(spark, sf_dir):
    tries = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_key"), F.col("event_id").alias("attempt"), F.col("value").alias("loudness"))
    return sal.pick(tries, 300.0)


def _third(u, offset, duration, total, attempt, tries, low, high):
    """A search that isn't known by name: the first third."""
    return offset, high((total - duration) / 3.0, offset)


@query(f"SELECT k AS record_key, CAST(t AS INT) AS attempt, CAST(floor({sql_u('saliency', '', 'offset', 't')} * greatest((len(a) / 10.0 - 2.0) / 3.0, 0.0) * 10000.0 + 0.5) AS BIGINT) AS offset_ FROM (SELECT k, a, unnest(generate_series(0, 3)) AS t FROM {LONG})")
def excerpt_offset_callable(spark, sf_dir):
    return _drawn(spark, sf_dir, _third)


def _taps_sql(rate: int = RATE, taps: int = 512) -> str:
    """CTE h (j, h): both K-weighting filters as one, from their analog values, by the bilinear transform and the filters' recursions."""
    gain, q1, f1 = k.SHELF
    q2, f2 = k.HIGH_PASS
    return f"""analog AS (SELECT tan(pi() * {f1!r} / {rate}) AS k1, pow(10.0::DOUBLE, {gain!r} / 20) AS v, tan(pi() * {f2!r} / {rate}) AS k2),
norm AS (SELECT *, pow(v, 0.499666774155) AS vb, 1 + k1 / {q1!r} + k1 * k1 AS n1, 1 + k2 / {q2!r} + k2 * k2 AS n2 FROM analog),
filters AS (
  SELECT 1 AS f, (v + vb * k1 / {q1!r} + k1 * k1) / n1 AS b0, 2 * (k1 * k1 - v) / n1 AS b1, (v - vb * k1 / {q1!r} + k1 * k1) / n1 AS b2, 2 * (k1 * k1 - 1) / n1 AS a1, (1 - k1 / {q1!r} + k1 * k1) / n1 AS a2 FROM norm
  UNION ALL SELECT 2, 1.0, -2.0, 1.0, 2 * (k2 * k2 - 1) / n2, (1 - k2 / {q2!r} + k2 * k2) / n2 FROM norm),
response AS (
  SELECT f, 0 AS i, b0::DOUBLE AS y, 0.0::DOUBLE AS y1, b1::DOUBLE AS b1, b2::DOUBLE AS b2, a1::DOUBLE AS a1, a2::DOUBLE AS a2 FROM filters
  UNION ALL SELECT f, i + 1, CASE i WHEN 0 THEN b1 WHEN 1 THEN b2 ELSE 0.0 END - a1 * y - a2 * y1, y, b1, b2, a1, a2 FROM response WHERE i < {taps - 1}),
h AS MATERIALIZED (SELECT x.i + y.i AS j, sum(x.y * y.y) AS h FROM response x JOIN response y ON x.f = 1 AND y.f = 2 GROUP BY x.i + y.i)"""


@query(f"""
WITH RECURSIVE {_taps_sql()},
o AS (SELECT vec_id AS k, t, {sql_u('saliency', '', 'offset', 't', key='vec_id')} * (64 / 8000.0 - 0.005) AS off, embedding FROM embeddings, range(0, 4) r(t)),
x AS (SELECT k, t, off, unnest(generate_series(0, 39)) AS p, unnest(embedding[CAST(floor(off * 8000) AS BIGINT) + 1 : CAST(floor(off * 8000) AS BIGINT) + 40]) AS x FROM o),
y AS (SELECT k, t, off, p + j AS m, sum(CAST(x AS DOUBLE) * h) AS y FROM x, h GROUP BY k, t, off, p + j),
l AS (SELECT k, t, off, round(-0.691 + 10 * log10(sum(y * y) / 3200.0), 9) AS l FROM y GROUP BY k, t, off),
c AS (SELECT k, coalesce(arg_min({{'t': t, 'off': off, 'l': l}}, t) FILTER (WHERE l > -34.0), arg_max({{'t': t, 'off': off, 'l': l}}, {{'l': l, 'a': -t}})) AS b FROM l GROUP BY k)
SELECT k AS record_key, CAST(b.t AS INT) AS attempt, CAST(floor(b.off * 10000000.0 + 0.5) AS BIGINT) AS offset_, CAST(floor(b.l * 10000.0 + 0.5) AS BIGINT) AS loudness FROM c""")
def salient_excerpt(spark, sf_dir):
    """The first of four random excerpts of each clip that is loud enough, or the loudest, by the loudness of its samples.

    Two tries may cut the same samples. Their loudness is one number here, but the order of SQL's sums isn't fixed, so SQL rounds before it compares.
    """
    out = sal.salient_excerpts(mono(spark, sf_dir), 0.005, sal.SaliencyParams(True, 4, -34.0))
    return out.select("record_key", "attempt", F.floor(F.col("offset") * 10000000.0 + 0.5).cast("bigint").alias("offset_"), whole(F.col("loudness")).alias("loudness"))


# ------------------------------------------------------------------------ resampling
def _resample_sql(old: int, new: int, count: str | None = None) -> str:
    """``count``: how many outputs of the first 63 samples; else all whole outputs of all."""
    source = "(SELECT vec_id, embedding[1:63] AS embedding FROM embeddings)" if count else "embeddings"
    count = count or f"{new} * len(embedding) // {old}"
    band = min(old, new) * 0.945
    half = int(np.ceil(24 * old / band))
    return f"""
WITH kern0 AS (
  SELECT j, i, greatest(-24.0, least(24.0, (i / {old}.0 - j / {new}.0) * {band!r})) * pi() AS t
  FROM range(0, {new}) a(j), range({-half}, {half + old}) b(i)),
kern1 AS (SELECT j, i, (CASE WHEN t = 0 THEN 1.0 ELSE sin(t) / t END) * pow(cos(t / 24 / 2), 2) AS v FROM kern0),
kern AS (SELECT j, i, v / sum(v) OVER (PARTITION BY j) AS v FROM kern1),
x AS (SELECT vec_id AS k, unnest(generate_series(0, len(embedding) - 1)) AS p, unnest(embedding) AS x FROM {source} s),
n AS (SELECT vec_id AS k, len(embedding) AS len, unnest(generate_series(0, {count} - 1)) AS m FROM {source} s),
y AS (
  SELECT n.k, n.m, CAST(coalesce(sum(kern.v * CAST(x.x AS DOUBLE)), 0) AS FLOAT) AS y
  FROM n JOIN kern ON kern.j = n.m % {new} LEFT JOIN x ON x.k = n.k AND x.p = (n.m // {new}) * {old} + kern.i GROUP BY n.k, n.m)
SELECT k AS record_key, count(*) AS clip_n, CAST(floor(sum(CAST(y AS DOUBLE) * (m + 1)) * 10000.0 + 0.5) AS BIGINT) AS clip_sum FROM y GROUP BY k
"""


@query(_resample_sql(2, 3))
def resample_up(spark, sf_dir):
    return report(t.Resample(12000)(mono(spark, sf_dir)), "clip")


@query(_resample_sql(2, 1))
def resample_down(spark, sf_dir):
    return report(t.Resample(4000)(mono(spark, sf_dir)), "clip")


def _short(spark, sf_dir) -> DataFrame:
    return mono(spark, sf_dir).select("record_key", clip(e.pad(F.col("clip.audio_data"), 63), RATE).alias("clip"))


@query(_resample_sql(2, 3, "(3 * 63 + 1) // 2"))
def resample_full(spark, sf_dir):
    """One output more where the input has a rest."""
    return report(t.Resample(12000, full=True)(_short(spark, sf_dir)), "clip")


@query(_resample_sql(2, 3, "50"))
def resample_output_length(spark, sf_dir):
    return report(t.Resample(12000, output_length=50)(_short(spark, sf_dir)), "clip")


# --------------------------------------------------------------------------- spectra
def _spectrum_sql(phase: str | None, tail: str) -> str:
    """DFT of frames of 16 with hop 8, phases turned, inverse and overlap-add, as joins."""
    cos, sin = (f"cos({phase})", f"sin({phase})") if phase else ("1.0", "0.0")
    return f"""
WITH w AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 16) AS w FROM range(0, 16) r(n)),
x AS (SELECT vec_id AS k, unnest(generate_series(0, len(embedding) - 1)) AS p, unnest(embedding) AS x FROM embeddings),
fr AS (SELECT x.k, t, w.n, CAST(x.x AS DOUBLE) * w.w AS v FROM range(0, 9) r(t), w, x WHERE x.p = 8 * t + w.n - 8),
z0 AS (SELECT k, t, f, sum(v * cos(2 * pi() * f * n / 16)) / 8.0 AS re, -sum(v * sin(2 * pi() * f * n / 16)) / 8.0 AS im FROM fr, range(0, 9) q(f) GROUP BY k, t, f),
z1 AS (SELECT *, {cos} AS c, {sin} AS s FROM z0),
z AS (SELECT k, t, f, re * c - im * s AS re, re * s + im * c AS im FROM z1),
y AS (
  SELECT k, t, n, 8.0 / 16 * sum((CASE WHEN f IN (0, 8) THEN 1 ELSE 2 END) * (re * cos(2 * pi() * f * n / 16) - im * sin(2 * pi() * f * n / 16))) AS y
  FROM z, range(0, 16) r(n) GROUP BY k, t, n),
o AS (SELECT k, 8 * t + n - 8 AS p, sum(y * w.w) / sum(w.w * w.w) AS y FROM y JOIN w USING (n) WHERE 8 * t + n - 8 BETWEEN 0 AND 63 GROUP BY k, 8 * t + n - 8)
{tail}
"""


OVERLAP = "SELECT k AS record_key, count(*) AS clip_n, CAST(floor(sum(CAST(CAST(y AS FLOAT) AS DOUBLE) * (p + 1)) * 10000.0 + 0.5) AS BIGINT) AS clip_sum FROM o GROUP BY k"


@query(_spectrum_sql(None, "SELECT k AS record_key, CAST(count(*) AS BIGINT) AS n, CAST(floor(sum((re * re + im * im) * (f + 1)) * 10000.0 + 0.5) AS BIGINT) AS power FROM z GROUP BY k"))
def stft_power(spark, sf_dir):
    z = mono(spark, sf_dir).select("record_key", F.explode(arrow.stft(F.col("clip.audio_data"), 16, 0.5)).alias("z"))
    power = F.sum((F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")) * (F.col("z.frequency") + 1))
    return z.groupBy("record_key").agg(F.count("*").alias("n"), whole(power).alias("power"))


@query(sql_report(MONO, "clip=a"))
def istft_identity(spark, sf_dir):
    z = mono(spark, sf_dir).select("record_key", arrow.stft(F.col("clip.audio_data"), 16, 0.5).alias("z"), F.size(F.col("clip.audio_data")[0]).alias("n"))
    return report(z.select("record_key", F.struct(arrow.istft(F.col("z"), F.col("n"), 16, 0.5).alias("audio_data")).alias("clip")), "clip")


@query("SELECT vec_id // 100 AS record_key, CAST(sum(len(embedding)) AS BIGINT) AS clip_n FROM embeddings GROUP BY vec_id // 100")
def istft_default_frame(spark, sf_dir):
    """Clips of up to 6,400 samples through frames of 2,048 at hops of a quarter and a half and back: the lengths where both agree with the clip."""
    rows = _joined(spark, sf_dir, lambda v, i: v)
    samples = F.col("clip.audio_data")
    out = rows
    for name, hop in (("quarter", 0.25), ("half", 0.5)):
        z = out.withColumn("z", arrow.stft(samples, 2048, hop))
        out = z.withColumn(name, arrow.istft(F.col("z"), F.size(samples[0]), 2048, hop)).drop("z")
    near = lambda name: F.forall(F.zip_with(F.flatten(samples), F.flatten(name), lambda a, b: F.abs(a - b) < 1e-4), lambda x: x)
    return out.select("record_key", F.when(near("quarter") & near("half"), F.size(F.flatten("half"))).cast("bigint").alias("clip_n"))


@query(_spectrum_sql("(" + sql_u("CorruptPhase", "clip", "phase", "f") + " * 2 - 1) * pi() * 0.5", OVERLAP))
def corrupt_phase(spark, sf_dir):
    return report(t.CorruptPhase({"amount": 0.5, "frame_length": 16})(mono(spark, sf_dir)), "clip")


class _ShortShift(t.ShiftPhase):
    """Frames that fit clips of 64 samples."""

    frame_length = 16


def _default_frame_sql(phase: str) -> str:
    """The same for frames of 2,048 at hops of a half, over recordings of any length; sines come from a table."""
    return f"""
WITH x AS (SELECT vec_id // 100 AS k, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id, i) - 1 AS p, x FROM (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)),
sine AS MATERIALIZED (SELECT i, cos(2 * pi() * i / 2048) AS c, sin(2 * pi() * i / 2048) AS s FROM range(0, 2048) r(i)),
w AS MATERIALIZED (SELECT i AS n, 0.5 - 0.5 * c AS w FROM sine),
size AS (SELECT k, max(p) + 1 AS n, CAST(ceil(greatest(max(p) + 1, 2048) / 1024) AS BIGINT) AS last FROM x GROUP BY k),
placed AS (SELECT k, p, x, unnest([(p + 1024) // 1024, (p + 1024) // 1024 - 1]) AS t FROM x),
fr AS MATERIALIZED (SELECT k, t, w.n, CAST(x AS DOUBLE) * w AS v FROM placed JOIN size USING (k) JOIN w ON w.n = p + 1024 - 1024 * t WHERE t BETWEEN 0 AND last),
z0 AS (SELECT k, t, f, sum(v * c) / 1024 AS re, -sum(v * s) / 1024 AS im FROM fr, range(0, 1025) q(f) JOIN sine ON sine.i = (f * n) % 2048 GROUP BY k, t, f),
z AS MATERIALIZED (SELECT k, t, f, (CASE WHEN f IN (0, 1024) THEN 1 ELSE 2 END) * (re * cos(a) - im * sin(a)) AS re, (CASE WHEN f IN (0, 1024) THEN 1 ELSE 2 END) * (re * sin(a) + im * cos(a)) AS im FROM (SELECT *, {phase} AS a FROM z0)),
y AS (SELECT k, t, n, sum(re * c - im * s) / 2 AS y FROM z, w JOIN sine ON sine.i = (f * n) % 2048 GROUP BY k, t, n),
o AS (SELECT k, 1024 * t + n - 1024 AS p, sum(y * w) / sum(w * w) AS y FROM y JOIN w USING (n) GROUP BY k, 1024 * t + n - 1024)
SELECT k AS record_key, count(*) AS clip_n, CAST(floor(sum(y * (p % 100 + 1)) * 100.0 + 0.5) AS BIGINT) AS clip_sum FROM o JOIN size USING (k) WHERE p BETWEEN 0 AND size.n - 1 GROUP BY k
"""


def _by_place(df: DataFrame) -> DataFrame:
    flat = F.flatten("clip.audio_data")
    total = F.aggregate(F.transform(flat, lambda x, i: x.cast("double") * (i % 100 + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select("record_key", F.size(flat).cast("bigint").alias("clip_n"), F.floor(total * 100.0 + 0.5).cast("bigint").alias("clip_sum"))


@query(_default_frame_sql("(" + sql_u("CorruptPhase", "clip", "phase", "f") + " * 2 - 1) * pi()"))
def corrupt_phase_default_frame(spark, sf_dir):
    """Recordings of up to 6,400 samples at the default frame."""
    return _by_place(t.CorruptPhase()(_joined(spark, sf_dir, lambda v, i: v)))


@query(_default_frame_sql("(" + sql_u("ShiftPhase", "clip", "phase") + " * 2 - 1) * pi()"))
def shift_phase_default_frame(spark, sf_dir):
    return _by_place(t.ShiftPhase()(_joined(spark, sf_dir, lambda v, i: v)))


@query(_spectrum_sql("(" + sql_u("ShiftPhase", "clip", "phase") + " * 2 - 1) * pi()", OVERLAP))
def shift_phase(spark, sf_dir):
    return report(_ShortShift(name="ShiftPhase")(mono(spark, sf_dir)), "clip")


# -------------------------------------------------------------------------- loudness
def _loudness_sql(tail: str) -> str:
    return f"""
WITH RECURSIVE {_taps_sql()},
x AS (SELECT vec_id AS k, unnest(generate_series(0, len(embedding) - 1)) AS p, unnest(embedding) AS x FROM embeddings),
y AS (SELECT k, p + j AS m, sum(CAST(x AS DOUBLE) * h) AS y FROM x, h GROUP BY k, p + j),
l0 AS (SELECT k, -0.691 + 10 * log10(sum(y * y) / 3200.0) AS l FROM y GROUP BY k),
l AS (SELECT k, CASE WHEN l >= -70 THEN l ELSE -200.0 END AS l FROM l0)
{tail}
"""


@query(_loudness_sql("SELECT k AS record_key, CAST(floor(l * 10000.0 + 0.5) AS BIGINT) AS loudness FROM l"))
def integrated_loudness(spark, sf_dir):
    return t.ReplaceLoudness()(mono(spark, sf_dir)).select("record_key", whole(F.col("clip.loudness")).alias("loudness"))


def _joined(spark, sf_dir, f) -> DataFrame:
    """(record_key, clip): up to 100 neighbouring vectors end to end, each changed by f(vector, its place)."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("record_key"), (F.col("vec_id") % 100).alias("i"), "embedding")
    both = v.groupBy("record_key").agg(F.array_sort(F.collect_list(F.struct("i", "embedding"))).alias("v"))
    return both.select("record_key", clip(F.array(F.flatten(F.transform("v", lambda x: f(x["embedding"], x["i"])))), RATE).alias("clip"))


def _fading(v: Column, i: Column) -> Column:
    """Falling by 40 dB a fifth of a hundred."""
    return F.transform(v, lambda x: (x.cast("double") * F.pow(F.lit(10.0), F.lit(-2.0) * F.floor(i / 20))).cast("float"))


GATED = f"""
WITH RECURSIVE {_taps_sql()},
x AS (
  SELECT vec_id // 100 AS k, (vec_id % 100) * 64 + unnest(generate_series(0, 63)) AS p, CAST(CAST(unnest(embedding) AS DOUBLE) * pow(10.0, -2.0 * ((vec_id % 100) // 20)) AS FLOAT) AS x
  FROM embeddings),
n AS (SELECT k, greatest(max(p) + 1, 3200) AS n, greatest(CAST(round_even((greatest(max(p) + 1, 3200) / 8000.0 - 0.4) / 0.1, 0) AS BIGINT) + 1, 1) AS blocks FROM x GROUP BY k),
y AS (SELECT x.k, p + j AS m, sum(CAST(x AS DOUBLE) * h) AS y FROM x JOIN n USING (k), h WHERE p + j < n GROUP BY x.k, p + j),
z AS (SELECT k, b, sum(y * y) / 3200.0 AS z FROM y JOIN n USING (k), range(0, 5) r(b) WHERE b < blocks AND m >= 800 * b AND m < 800 * b + 3200 GROUP BY k, b),
a AS (SELECT * FROM z WHERE -0.691 + 10 * log10(z) >= -70),
g AS (SELECT k, -0.691 + 10 * log10(avg(z)) - 10 AS gate FROM a GROUP BY k)
SELECT k AS record_key, CAST(floor((-0.691 + 10 * log10(avg(z))) * 10000.0 + 0.5) AS BIGINT) AS loudness FROM a JOIN g USING (k) WHERE -0.691 + 10 * log10(z) > gate GROUP BY k"""


@query(GATED)
def gated_loudness(spark, sf_dir):
    """Five blocks that fall by 40 dB a fifth of the clip: the absolute gate drops the last, the relative one others."""
    return t.ReplaceLoudness()(_joined(spark, sf_dir, _fading)).select("record_key", whole(F.col("clip.loudness")).alias("loudness"))


def _chunks(spark, sf_dir, f) -> DataFrame:
    """Recordings of up to 100 vectors, each vector a chunk of its own, changed by f(vector, its place)."""
    i = F.col("vec_id") % 100
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("record_key"), (i * 64).alias("start"), F.array(f(F.col("embedding"), i)).alias("audio"), F.lit(RATE).alias("sample_rate"))


@query(GATED)
def chunked_loudness(spark, sf_dir):
    """The same loudness, of recordings that lie in rows of 64 samples: parts of blocks are summed up, gates are aggregates."""
    return chunked.chunk_loudness(_chunks(spark, sf_dir, _fading)).select("record_key", whole(F.col("loudness")).alias("loudness"))


def _placed(chunks: DataFrame) -> DataFrame:
    """Number of samples of each recording, and their sum weighted by their place modulo 100."""
    flat = F.flatten("audio")
    each = F.aggregate(F.transform(flat, lambda x, i: x.cast("double") * ((F.col("start") + i) % 100 + 1)), F.lit(0.0), lambda a, x: a + x)
    return chunks.groupBy("record_key").agg(F.sum(F.size(flat)).cast("bigint").alias("clip_n"), whole(F.sum(each)).alias("clip_sum"))


JOINED = "(SELECT vec_id // 100 AS vec_id, flatten(list(embedding ORDER BY vec_id)) AS embedding FROM embeddings GROUP BY vec_id // 100)"


@query(_resample_sql(2, 3).replace("FROM embeddings s", f"FROM {JOINED} s").replace("(m + 1)", "(m % 100 + 1)"))
def chunked_resample(spark, sf_dir):
    """Recordings in rows of 64 samples, resampled by tiles with halos."""
    return _placed(chunked.resample_chunks(_chunks(spark, sf_dir, lambda v, i: v), 12000, tile_seconds=1))


@query("SELECT vec_id // 100 AS record_key, CAST(sum(len(embedding)) AS BIGINT) AS clip_n, true AS same FROM embeddings GROUP BY vec_id // 100")
def chunked_istft(spark, sf_dir):
    """Recordings in rows of 64 samples to spectra of 2,048 and back: frames reach over rows, signals are added up over rows."""
    chunks = _chunks(spark, sf_dir, lambda v, i: v)
    back = chunked.istft_chunks(chunked.stft_chunks(chunks), sample_rate=RATE)
    each = chunks.select("record_key", F.posexplode(F.flatten("audio")).alias("i", "x"), "start").select("record_key", (F.col("start") + F.col("i")).alias("at"), "x")
    again = back.select("record_key", F.posexplode(F.flatten("audio")).alias("i", "y"), "start").select("record_key", (F.col("start") + F.col("i")).alias("at"), "y")
    near = F.coalesce(F.abs(F.col("x") - F.col("y")) < 1e-4, F.lit(False))
    return each.join(again, ["record_key", "at"], "full").groupBy("record_key").agg(F.count("*").alias("clip_n"), F.bool_and(near).alias("same"))


TARGET = f"(-30.0 + {sql_u('VolumeNorm', 'clip', 'target')} * 10.0)"


@query(_loudness_sql(sql_report("l JOIN (SELECT vec_id AS k, embedding AS a FROM embeddings) e USING (k)", f"clip={sql_gain('a', TARGET + ' - l')}", extra=f", CAST(floor({TARGET} * 10000.0 + 0.5) AS BIGINT) AS loudness")))
def volume_norm(spark, sf_dir):
    out = t.VolumeNorm({"min_db": -30, "max_db": -20})(mono(spark, sf_dir))
    return report(out, "clip", extra=(whole(F.col("clip.loudness")).alias("loudness"),))


# -------------------------------------------------------------------------- choosing
def _choose_sql(weights: tuple[float, ...], c: int, prob: float = 1.0, name: str = "Choose") -> str:
    keys = " UNION ALL ".join(f"SELECT k, {i} AS i, -ln(greatest({sql_u(name, '', 'choose', str(i))}, pow(2.0, -53))) / {w} AS key FROM {MONO}" for i, w in enumerate(weights) if w)
    coin = f" AND {sql_u(name, '', 'prob')} < {prob}" if prob < 1 else ""
    return f"(SELECT e.k, e.a, coalesce(string_agg(i, ',' ORDER BY key), '') AS chosen FROM {MONO} e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY key) AS r FROM ({keys})) q ON q.k = e.k AND r <= {c}{coin.replace('|| k ||', '|| e.k ||')} GROUP BY e.k, e.a)"


def _times(factor: float):
    return lambda value, stream: t.with_fields(value, CLIP, audio_data=e.each_sample(value["audio_data"], lambda x: x * factor))


@query(sql_report(_choose_sql((1.0, 1.0, 1.0), 1, 0.8), "clip=CASE chosen WHEN '0' THEN list_transform(a, lambda x: -x) WHEN '1' THEN list_transform(a, lambda x: CAST(CAST(x AS DOUBLE) * 2.0 AS FLOAT)) ELSE a END"))
def choose_one(spark, sf_dir):
    return report(Choose(t.InvertPhase(), _times(2.0), t.Identity(), prob=0.8)(mono(spark, sf_dir)), "clip")


def _two() -> str:
    scale = {"0": "* 2.0", "1": "+ 1.0", "2": "* -3.0"}
    cases = []
    for a in scale:
        for b in scale:
            if a != b:
                cases.append(f"WHEN '{a},{b}' THEN list_transform(a, lambda x: CAST(CAST(CAST(CAST(x AS DOUBLE) {scale[a]} AS FLOAT) AS DOUBLE) {scale[b]} AS FLOAT))")
    return "CASE chosen " + " ".join(cases) + " END"


@query(sql_report(_choose_sql((0.5, 3.0, 1.5, 0.0), 2), f"clip={_two()}"))
def choose_two_weighted(spark, sf_dir):
    out = Choose(_times(2.0), _Add(), _times(-3.0), t.InvertPhase(), c=2, weights=[0.5, 3.0, 1.5, 0.0])(mono(spark, sf_dir))
    return report(out, "clip")


def _scaled(factor: float, more: float = 0.0) -> str:
    return f"list_transform(a, lambda x: CAST(CAST(CAST(CAST(x AS DOUBLE) * {factor} AS FLOAT) AS DOUBLE) * 1.0 + {more} AS FLOAT))"


@query(sql_report(_choose_sql((1.0, 2.0), 1), f"clip=CASE chosen WHEN '0' THEN {_scaled(2.0, 1.0)} ELSE list_transform(a, lambda x: -x) END"))
def choose_chain(spark, sf_dir):
    return report(Choose(Pipeline(_times(2.0), _Add()), t.InvertPhase(), weights=[1.0, 2.0])(mono(spark, sf_dir)), "clip")


@query(
    sql_report(
        f"(SELECT o.k, o.a, o.chosen, i.chosen AS inner_ FROM {_choose_sql((1.0, 1.0), 1, name='Outer')} o JOIN {_choose_sql((1.0, 3.0), 1, 0.7, name='Inner')} i ON i.k = o.k)",
        f"clip=CASE WHEN chosen = '1' THEN {_scaled(3.0, 1.0)} WHEN inner_ = '0' THEN list_transform(a, lambda x: -x) WHEN inner_ = '1' THEN {_scaled(2.0)} ELSE a END",
    )
)
def choose_nested(spark, sf_dir):
    inner = Choose(t.InvertPhase(), _times(2.0), weights=[1.0, 3.0], prob=0.7, name="Inner")
    return report(Choose(inner, Pipeline(_times(3.0), _Add()), name="Outer")(mono(spark, sf_dir)), "clip")


class _Range(t.NumpyTransform):
    """A NumPy body that puts another type in the leaf's place."""

    defaults = {"scale": 1.0}
    result = "struct<low:double,high:double>"

    @staticmethod
    def kernel(values, sample_rate, rng, scale):
        return {"low": float(values.min() * scale), "high": float(values.max() * scale)}


class _Doubled(t.NumpyTransform):
    @staticmethod
    def kernel(values, sample_rate, rng):
        return values * 2


def _of_range(name: str, samples: str, scale: str) -> str:
    each = f"list_transform({samples}, lambda x: CAST(x AS DOUBLE))"
    return ", ".join(f"CAST(floor({f}({each}) * {scale} * 10000.0 + 0.5) AS BIGINT) AS {name}_{c}" for f, c in (("list_min", "low"), ("list_max", "high")))


@query(f"SELECT k AS record_key, {_of_range('src', 'a', '2.0')}, {_of_range('target', 'b', '1.0')} FROM {NESTED}")
def user_kernel(spark, sf_dir):
    """A user's NumPy function as a transform: options by path, and a struct of its own in the leaves' place."""
    out = _Range({"src": {"scale": 2.0}})(nested(spark, sf_dir))
    return out.select("record_key", *[whole(F.col(f"{leaf}.{c}")).alias(f"{leaf}_{c}") for leaf in ("src", "target") for c in ("low", "high")])


@query(sql_report(_choose_sql((1.0, 2.0), 1, 0.7), "clip=CASE chosen WHEN '0' THEN list_transform(a, lambda x: CAST(CAST(x AS DOUBLE) * 2.0 AS FLOAT)) WHEN '1' THEN list_transform(a, lambda x: -x) ELSE a END"))
def choose_user_kernel(spark, sf_dir):
    """A branch with a NumPy body, which runs on the records that take it only."""
    return report(Choose(_Doubled(), t.InvertPhase(), weights=[1.0, 2.0], prob=0.7)(mono(spark, sf_dir)), "clip")


def _quantise(audio: np.ndarray, rate: int) -> np.ndarray:
    """A stand-in for a codec: two codebooks of 8 levels."""
    one = np.floor((audio + 1) * 8).astype(np.int64)
    return np.stack([one, one + 100], axis=1)


TOKENS = "list_transform({0}, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 8) AS INT) + {1})"
CODES = "list_concat(list_concat({0}, {1}), list_concat({2}, {3}))".format(*(TOKENS.format(c, p) for p in (0, 100) for c in "ab"))


@query(f"SELECT k AS record_key, 4 AS n_rows, {sql_sum(CODES)} AS codes FROM {STEREO}")
def codec_tokens(spark, sf_dir):
    out = t.CodecEncode(_quantise, 2)(stereo(spark, sf_dir))
    return out.select("record_key", F.size("clip.codes").alias("n_rows"), weighted(F.flatten("clip.codes")).alias("codes"))


@query(sql_report("(SELECT (vec_id // 10) * count(*) OVER (PARTITION BY vec_id // 10) + row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS k, embedding AS a FROM embeddings)", "clip=a"))
def reduce_batch(spark, sf_dir):
    return report(ReduceBatch(RATE)(batch(mono(spark, sf_dir), 10)), "clip")


# -------------------------------------------------------------------------- flagship
@query(
    BALANCED.format(files=f"SELECT * FROM {FILES}", steps=ALL)
    + f""", cl AS (SELECT record_key AS k, group_name, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * 4 AS FLOAT)) AS a FROM r JOIN embeddings ON printf('f%08d', vec_id) = path WHERE record_key < {ALL}),
gn AS (SELECT k, group_name, {sql_gain('a', CHANGE)} AS a FROM (SELECT CAST(k AS BIGINT) AS k, group_name, a FROM cl)),
pk AS (SELECT group_name, a, greatest(1.0, list_max(list_transform(a, lambda x: abs(CAST(x AS DOUBLE))))) AS p FROM gn),
sc AS (SELECT group_name, list_transform(a, lambda x: CAST(CAST(x AS DOUBLE) / p AS FLOAT)) AS a FROM pk)
SELECT group_name, count(*) AS n, CAST(floor(max(list_max(list_transform(a, lambda x: abs(CAST(x AS DOUBLE))))) * 10000.0 + 0.5) AS BIGINT) AS peak,
  CAST(floor(sum(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * 10000.0 + 0.5) AS BIGINT) AS energy FROM sc GROUP BY group_name"""
)
def balanced_gain_report(spark, sf_dir):
    """A group-balanced sequence of clips: seeded gain, clip protection, peak and energy by group."""
    rows = files(spark, sf_dir)
    index = ix.balanced_index(rows, rows.count()).select("record_key", "group_name", "path")
    audio = mono(spark, sf_dir, 4.0).select(F.format_string("f%08d", "record_key").alias("path"), "clip")
    out = Pipeline(t.VolumeChange({"min_db": -12, "max_db": 6}), t.RescaleAudio())(index.join(audio, "path"))
    a = F.col("clip.audio_data")
    energy = F.aggregate(F.flatten(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    each = out.select("group_name", e.peak(a).alias("peak"), energy.alias("energy"))
    return each.groupBy("group_name").agg(F.count("*").alias("n"), whole(F.max("peak")).alias("peak"), whole(F.sum("energy")).alias("energy"))

