"""Token counts of flat, unindexed token files, by scanning for separators.

A token file is an array of fixed-width unsigned ids in which an end-of-document
id follows each document; no index says where documents begin. Files come as
blocks of any size, cut anywhere. Each block is searched on its own (one vector
comparison); what it can't know - the document's length before its first separator,
and how many documents came before - is a prefix over earlier blocks, taken in two
levels: within super-blocks of ``SUPER`` blocks, then over super-blocks. So no
task ever holds all blocks of a large file.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, default_tokenizer, rank_bytes
from .common import materialize, narrow, partitions, worker

#: Tokens in a block that the writer makes; blocks in a super-block.
BLOCK_TOKENS, SUPER = 1 << 18, 1024
WIDTHS = {2: "<u2", 4: "<u4"}
#: Stores whose files PyArrow can read from any byte on.
RANGED = ("file", "hdfs", "s3", "gs")


def token_stream(docs: DataFrame, ranks: str, pattern: str, eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents into flat token files: rows (file, block, data, ended).

    Each partition of docs is a file, cut into blocks of ``block_tokens`` ids of ``width``
    bytes. ``ended`` lists the ids, as strings, of the documents whose separator lies in the
    block; it is the writer's manifest and the scan doesn't read it. Null and empty
    texts are a separator alone. An ``eod`` that the vocabulary uses, or that ``width`` bytes can't hold, is an error.
    """
    source = narrow(docs, row_id=id_col, text=text_col).withColumn("row_id", F.col("row_id").cast("string"))
    shipped = docs.sparkSession.sparkContext.broadcast(rank_bytes(ranks))
    kind = WIDTHS[width]
    if eod in {int(line.split()[1]) for line in shipped.value.splitlines() if line}:
        raise ValueError(f"{eod} is an id of the vocabulary, so it can't end documents")
    if not 0 <= eod < 1 << 8 * width:
        raise ValueError(f"{eod} doesn't fit into {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value, pattern)
        file, block, size = TaskContext.get().partitionId(), 0, block_tokens * width
        end = np.array([eod], kind).tobytes()
        buffer, ended, marks = bytearray(), [], []

        def cut(n: int):
            nonlocal block
            k = sum(m <= n for m in marks)
            row = pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([bytes(buffer[:n])], pa.binary()), pa.array([ended[:k]], pa.list_(pa.string()))], ["file", "block", "data", "ended"]
            )
            block += 1
            del buffer[:n], ended[:k]
            marks[:] = [m - n for m in marks[k:]]
            return row

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                for row_id, text in zip(part.column("row_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.frombuffer(c.encode_packed(text or ""), "<u4")
                    if width == 2 and len(ids) and ids.max() > 0xFFFF:
                        raise ValueError("an id needs more than 16 bits")
                    buffer += ids.astype(kind).tobytes() + end
                    ended.append(row_id)
                    marks.append(len(buffer))
                    while len(buffer) >= size:
                        yield cut(size)
        if buffer:
            yield cut(len(buffer))

    return source.mapInArrow(worker(run), "file long, block long, data binary, ended array<string>")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files as rows (file string, block, data); files of any size, as each block is a byte range of its own.

    Spark lists the files. Ranges are read where PyArrow knows the store (RANGED); from other stores Spark reads whole files, of
    2 GB at most each. A last block that is no whole number of ids is an error of the scan.
    """
    size = width * block_tokens
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    scheme = F.regexp_extract("path", "^([a-z0-9]+):", 1)
    ranges = files.where(scheme.isin(*RANGED)).select("path", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("block", "start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, start in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "start")), strict=True):
                store, inner = (fs.LocalFileSystem(), unquote(name[5:])) if name.startswith("file:") else fs.FileSystem.from_uri(name)
                with store.open_input_file(inner) as f:
                    yield _block_row(name, block, f.read_at(size, start))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                whole = content.as_buffer()
                for block, start in enumerate(range(0, whole.size, size)):
                    yield _block_row(name, block, whole.slice(start, min(size, whole.size - start)).to_pybytes())

    schema = "file string, block long, data binary"
    spread = ranges.repartition(partitions(spark), "path", "start").mapInArrow(worker(read), schema)
    others = files.where(~scheme.isin(*RANGED))
    if others.select("path").isEmpty():
        return spread
    return spread.unionByName(others.select("path", "content").mapInArrow(worker(cut), schema))


def _block_row(file: str, block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])


def scan_blocks(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """Rows (file, block, n, seps): each block's number of ids and the places of its separators."""
    kind = WIDTHS[width]
    source = blocks.select("file", "block", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, seps = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", kind)
                n.append(len(ids))
                seps.append(np.flatnonzero(ids == eod).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(seps, pa.list_(pa.int32()))], ["file", "block", "n", "seps"])

    return source.mapInArrow(worker(run), f"file {dict(source.dtypes)['file']}, block long, n long, seps array<int>")


def document_counts(blocks: DataFrame, eod: int, width: int = 2, super_blocks: int = SUPER) -> DataFrame:
    """Rows (file, ordinal, n_tokens, terminated): the documents of each file in order.

    Blocks are rows (file, block, data); block numbers order a file's blocks and may have
    gaps; null data counts as no ids. Ids after the last separator are a document that isn't
    terminated; where there are none, there is no such row. Separators side by side give
    documents of no tokens. A file or table without ids gives no row. Repeated block rows
    are an error of the input: their order is not defined.
    """
    scanned = materialize(scan_blocks(blocks, eod, width), "scan")
    meta = scanned.select("file", "block", "n", F.size("seps").cast("long").alias("k"), F.try_element_at("seps", F.lit(-1)).cast("long").alias("last"), F.expr(f"block div {super_blocks}").alias("super"))
    inner = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    meta = meta.withColumn("at", F.coalesce(F.sum("n").over(inner), F.lit(0).cast("long"))).withColumn("seen", F.coalesce(F.sum("k").over(inner), F.lit(0).cast("long")))
    meta = meta.withColumn("end", F.when(F.col("k") > 0, F.col("at") + F.col("last") + 1))  # just after the block's last separator
    meta = meta.withColumn("open", F.max("end").over(inner))
    tops = meta.groupBy("file", "super").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk"), F.max("end").alias("send"))
    outer = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("base", F.coalesce(F.sum("sn").over(outer), F.lit(0).cast("long"))).withColumn("before", F.coalesce(F.sum("sk").over(outer), F.lit(0).cast("long")))
    tops = tops.withColumn("opened", F.coalesce(F.max(F.col("base") + F.col("send")).over(outer), F.lit(0).cast("long")))
    placed = meta.join(tops.select("file", "super", "base", "before", "opened"), ["file", "super"]).select(
        "file", "block", (F.col("base") + F.col("at")).alias("start"), (F.col("before") + F.col("seen")).alias("first"), F.coalesce(F.col("base") + F.col("open"), F.col("opened")).alias("since")
    )
    each = scanned.join(placed, ["file", "block"]).select(
        "file", "first", F.posexplode(F.expr("transform(seps, (s, i) -> if(i = 0, start + s - since, cast(s - seps[i - 1] - 1 as bigint)))")).alias("i", "n_tokens")
    )
    done = each.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    rest = tops.groupBy("file").agg(F.max(F.col("base") + F.col("sn")).alias("total"), F.max("before").alias("b"), F.max_by("sk", "super").alias("k"), F.coalesce(F.max(F.col("base") + F.col("send")), F.lit(0).cast("long")).alias("since"))
    tail = rest.where("total > since").select("file", (F.col("b") + F.col("k")).alias("ordinal"), (F.col("total") - F.col("since")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return done.unionByName(tail)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    ranks, pattern = default_tokenizer()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = materialize(token_stream(docs, ranks, pattern, eod=50256), "tokens", codec="zstd")
    counts = document_counts(stream, eod=50256)
    return named_counts(stream, counts)


def named_counts(stream: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (doc_id, n_tokens): counts under the ids of the writer's manifest, by order within a file."""
    ends = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stream.select("file", "block", F.expr(f"block div {SUPER}").alias("super"), F.size("ended").cast("long").alias("k"), "ended")
    sizes = sizes.withColumn("seen", F.coalesce(F.sum("k").over(ends), F.lit(0).cast("long")))
    tops = sizes.groupBy("file", "super").agg(F.sum("k").alias("sk"))
    outer = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("file", "super", F.coalesce(F.sum("sk").over(outer), F.lit(0).cast("long")).alias("before"))
    names = sizes.join(tops, ["file", "super"]).select("file", (F.col("before") + F.col("seen")).alias("first"), F.posexplode("ended").alias("i", "doc"))
    names = names.select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.col("doc").cast("long").alias("doc_id"))
    return names.join(counts.where("terminated"), ["file", "ordinal"]).select("doc_id", "n_tokens")
