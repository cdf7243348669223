"""Listing of clip files."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import has_extension
from . import stores

EXTENSIONS = (".wav", ".flac")


def find_files(directory: str, extensions: Sequence[str] = EXTENSIONS, max_depth: int | None = None, follow_symlinks: bool = False) -> list[str]:
    """Regular files below a local directory whose names end in an extension (case doesn't count), sorted.

    ``$VAR`` and ``~`` are expanded. The directory itself has depth 0; nothing below ``max_depth`` is
    looked at. Links are not followed unless asked for.
    """
    root = os.path.abspath(os.path.expanduser(os.path.expandvars(directory)))
    return sorted(_below(root, tuple(e.lower() for e in extensions), max_depth, follow_symlinks, 0))


def _below(directory: str, extensions: tuple[str, ...], max_depth: int | None, links: bool, depth: int) -> Iterator[str]:
    if max_depth is not None and depth > max_depth:
        return
    with os.scandir(directory) as entries:
        for entry in entries:
            if entry.is_file(follow_symlinks=links) and entry.name.lower().endswith(extensions):
                yield entry.path
            elif entry.is_dir(follow_symlinks=links):
                yield from _below(entry.path, extensions, max_depth, links, depth + 1)


def resolve_entry(entry: str, extensions: Sequence[str] = EXTENSIONS) -> list[str]:
    """A directory's clip files; anything else is a glob pattern, whose matches aren't filtered by extension."""
    path = os.path.expanduser(os.path.expandvars(entry))
    return find_files(path, extensions) if os.path.isdir(path) else sorted(glob.glob(path))


def list_remote(spark: SparkSession, directory: str, extensions: Sequence[str] = EXTENSIONS, max_depth: int | None = None, follow_symlinks: bool = False) -> DataFrame:
    """Rows (path, length) of clip files below a directory of any store, listed by tasks as :func:`find_files` lists a local one.

    A directory with wildcards is a pattern. Stores that tasks can't open by themselves (see :data:`stores.SCHEMES`) are listed by Spark on the
    driver, which skips names that begin with ``_`` or ``.`` and follows links. File contents are not read.
    """
    if stores.reachable(directory):
        return stores.list_tree(spark, [directory], tuple(extensions), max_depth, follow_symlinks).select("path", "length")
    any_case = ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + any_case + "}").load(directory).select("path", "length")
    found = found.where(has_extension(F.col("path"), tuple(extensions)))
    if max_depth is not None:
        base = stores.canonical(directory).rstrip("/") + "/"
        below = F.substring(F.col("path"), F.instr(F.col("path"), F.lit(base)) + len(base), F.length("path"))
        found = found.where(F.size(F.split(below, "/")) - 1 <= max_depth)
    return found
