"""Files of any store: one form of a path, opening where a task runs, listing folders, and tasks packed by bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import HELPER
from ..shared import cut

Opener = Callable[[str], BinaryIO]
#: Schemes of stores that tasks open by themselves, and the names PyArrow knows them by. Fixed values.
SCHEMES = {"hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}
#: Bytes of files that a task reads, about, and bytes that opening a file counts for.
TASK_BYTES, OPEN_BYTES = 128 << 20, 1 << 20


def canonical(path: str) -> str:
    """A local path without a scheme, whatever its form was (``/a``, ``file:/a``, ``file:///a``); others stay as they are."""
    return re.sub("^file:/+", "/", path)


def canonical_column(path: Column) -> Column:
    """As :func:`canonical`, of a column."""
    return F.regexp_replace(path, "^file:/+", "/")


def scheme(path: str) -> str | None:
    found = re.match("([A-Za-z][A-Za-z0-9+.-]*)://", canonical(path))
    return found and found[1].lower()


def reachable(path: str) -> bool:
    """Whether tasks can open the path by themselves; what they can't, Spark has to read."""
    return scheme(path) in (None, *SCHEMES)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its name there. Only the store's own part is parsed as a URI, so names may hold any characters."""
    name, rest = path.split("://", 1)
    host, _, inner = rest.partition("/")
    store, base = fs.FileSystem.from_uri(f"{SCHEMES[name.lower()]}://{host}/")
    return store, f"{base.rstrip('/')}/{inner}"


def writable(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path for writing, and the path's name there."""
    path = canonical(path)
    return _store(path) if scheme(path) else (fs.LocalFileSystem(), os.path.abspath(path))


def open_input(path: str) -> BinaryIO:
    """A file for reading at any place. A local name that isn't there but has ``%`` is tried as an encoded one."""
    path = canonical(path)
    if scheme(path):
        store, inner = _store(path)
        return store.open_input_file(inner)
    if "%" in path and not os.path.exists(path):
        path = unquote(path)
    return open(path, "rb")


def entries(folder: str, links: bool) -> Iterator[tuple[str, str, int, bool]]:
    """(path, name, bytes, whether it is a folder) of what lies in a folder. Links count as what they lead to, or not at all."""
    if scheme(folder):
        store, inner = _store(folder)
        for info in store.get_file_info(fs.FileSelector(inner)):
            if info.type in (fs.FileType.File, fs.FileType.Directory):
                yield f"{folder.rstrip('/')}/{info.base_name}", info.base_name, info.size or 0, info.type == fs.FileType.Directory
        return
    with os.scandir(folder) as found:
        for e in found:
            if e.is_dir(follow_symlinks=links):
                yield e.path, e.name, 0, True
            elif e.is_file(follow_symlinks=links):
                yield e.path, e.name, e.stat(follow_symlinks=links).st_size, False


LEVEL = "root int, path string, pattern string, length long, folder boolean"


def list_tree(spark: SparkSession, roots: list[str], extensions: tuple[str, ...], max_depth: int | None = None, links: bool = False) -> DataFrame:
    """Rows (root, path, length) of the files below some folders; root is the place in ``roots``.

    Folders are listed by tasks, a level of all trees at a time, and each level is a table of the shared
    folder: no path comes to the driver, and a lost executor costs some listings. A root with ``*``, ``?`` or ``[`` is a pattern, whose files
    aren't filtered by extension, and whose wildcards pass over names that begin with a dot.
    """
    extensions = tuple(e.lower() for e in extensions)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["root", "path", "pattern", "length", "folder"])
        for batch in batches:
            for root, path, pattern in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "pattern")), strict=True):
                first, _, rest = (pattern or "").partition("/")
                for found, name, size, folder in entries(path, links or pattern is not None):
                    if pattern is not None:
                        if not fnmatchcase(name, first) or name.startswith(".") and not first.startswith(".") or folder != bool(rest):
                            continue
                    elif not folder and not name.lower().endswith(extensions):
                        continue
                    out.append((root, found, rest or None if pattern is not None else None, size, folder))
                    if len(out) >= 10_000:
                        yield table()
                        out = []
        if out:
            yield table()

    starts = []
    for i, root in enumerate(roots):
        base = os.path.abspath(os.path.expanduser(os.path.expandvars(canonical(root)))) if scheme(root) is None else root.rstrip("/")
        plain = re.split(r"(?<=/)(?=[^/]*[*?\[])", base, maxsplit=1)
        starts.append((i, plain[0] if len(plain) > 1 else base, plain[1] if len(plain) > 1 else None))
    now, found, depth, folders = spark.createDataFrame(starts, "root int, path string, pattern string"), None, 0, len(starts)
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    while True:
        here = cut(now.repartition(max(1, min(folders, most))).mapInArrow(level, LEVEL), "level")
        own = here.where("not folder").select("root", "path", "length")
        found = own if found is None else found.unionByName(own)
        now, depth = here.where("folder").select("root", "path", "pattern"), depth + 1
        if max_depth is not None and depth > max_depth or not (folders := now.count()):
            return found


def packed(rows: DataFrame, size: str, task_bytes: int = TASK_BYTES, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """Rows of files dealt to tasks of about ``task_bytes``, where each file counts ``open_bytes`` more; only the rows move, before anything is read.

    Sizes are summed up along a range partitioning, so no task sees all rows. A file larger than that is a task of its own.
    """
    part, place, start, before = (f"{HELPER}_{c}" for c in ("part", "place", "start", "before"))
    own = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long") + open_bytes
    total, count = rows.agg(F.coalesce(F.sum(own), F.lit(0)), F.count("*")).first()
    n = max(1, min(-(-total // task_bytes), count))
    if n == 1:
        return rows.coalesce(1)
    named = rows.withColumn(place, F.xxhash64(*[F.col(f"`{c}`") for c in ("record_key", "path")]))
    named = named.repartitionByRange(place).withColumn(part, F.spark_partition_id())
    upto = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    named = cut(named.withColumn(start, F.coalesce(F.sum(own).over(upto), F.lit(0).cast("long"))), "packed")
    sums = named.groupBy(part).agg(F.sum(own).alias("n"))
    sums = sums.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias(before))
    at = F.least(F.floor((F.col(before) + F.col(start)) / task_bytes), F.lit(n - 1)).cast("int")
    dealt = named.join(F.broadcast(sums), part).repartitionById(n, at)  # a row for each partition
    return dealt.drop(part, place, start, before)
