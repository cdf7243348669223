"""Indexes: which file is record k. Both kinds are relational plans over a table of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import HELPER
from ..shared import cut
from . import stores
from .files import EXTENSIONS, list_remote, resolve_entry


def file_table(spark: SparkSession, sources: Mapping[str, Sequence[str]], extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Rows (group_idx, group_name, folder_idx, path) of named groups of folders or globs, in their order.

    Overlapping folders repeat files. A group without files is an error.
    """
    rows = []
    for g, (name, folders) in enumerate(sources.items()):
        found = [(g, name, f, path) for f, folder in enumerate(folders) for path in resolve_entry(folder, extensions)]
        if not found:
            raise RuntimeError(f"group {name!r}: no {', '.join(extensions)} files in its {len(folders)} folders")
        rows += found
    return spark.createDataFrame(rows, "group_idx int, group_name string, folder_idx int, path string")


def remote_file_table(spark: SparkSession, sources: Mapping[str, Sequence[str]], extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """As :func:`file_table`, and the files' length, for folders and patterns of any store.

    Tasks list the folders of all groups level by level, and no path comes to the driver; only stores that tasks can't open are listed there by Spark.
    """
    folders = [(g, name, f, folder) for g, (name, own) in enumerate(sources.items()) for f, folder in enumerate(own)]
    found = spark.createDataFrame([], "group_idx int, group_name string, folder_idx int, path string, length long")
    near = [x for x in folders if stores.reachable(x[3])]
    if near:
        roots = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(near)], "root int, group_idx int, group_name string, folder_idx int")
        found = stores.list_tree(spark, [x[3] for x in near], tuple(extensions)).join(F.broadcast(roots), "root").select(*found.columns)  # a row for each folder given
    for g, name, f, folder in folders:
        if not stores.reachable(folder):
            found = found.unionByName(list_remote(spark, folder, extensions).select(F.lit(g).alias("group_idx"), F.lit(name).alias("group_name"), F.lit(f).alias("folder_idx"), "path", "length"))
    found = cut(found, "files")
    full = {r.group_idx for r in found.select("group_idx").distinct().collect()}  # a row for each group
    for g, (name, own) in enumerate(sources.items()):
        if g not in full:
            raise RuntimeError(f"group {name!r}: no {', '.join(extensions)} files in its {len(own)} folders")
    return found


def numbered(files: DataFrame, order: Sequence[str | Column], name: str = "record_key") -> DataFrame:
    """Number rows from 0 in an order, without bringing all of them to one task.

    Rows are range-partitioned by the order and numbered inside partitions; each partition then starts
    where the ones before it end. Only one count for each partition passes through one task.
    """
    part, place, n, start = (f"{HELPER}_{c}" for c in ("part", "place", "n", "start"))
    rows = files.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    # Ranges are sampled, so the partitioned rows are written: both uses below must see the same ranges.
    rows = cut(rows.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("bigint")), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part).agg(F.count("*").alias(n)).select(part, F.coalesce(F.sum(n).over(before), F.lit(0).cast("bigint")).alias(start))
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(start) + F.col(place) - 1).drop(part, place, start)  # a row for each partition


def simple_index(files: DataFrame, num_steps: int | None = None) -> DataFrame:
    """All groups one after the other: files get keys by group, folder and path; ``num_steps`` keeps the first so many."""
    index = numbered(files, ["group_idx", "folder_idx", "path"])
    return index if num_steps is None else index.where(F.col("record_key") < num_steps)


#: The same; it had a form of its own when simple_index took all files to one task.
large_simple_index = simple_index


def balanced_index(files: DataFrame, num_steps: int) -> DataFrame:
    """Equal shares for all groups: record k is of group k mod G.

    Each group is repeated as often as its share needs, every repetition in an order of its own:
    by md5 of a seed that counts repetitions over all groups, and the file. So any G * n records hold the same number
    of each group, and a group repeats a file only after all its files came. Adds seed and pass.
    """
    if num_steps < 1:
        raise ValueError("num_steps must be positive")
    groups = files.groupBy("group_idx").agg(F.count("*").alias("n"))
    whole = groups.withColumn("g", F.row_number().over(Window.orderBy("group_idx")) - 1).withColumn("ng", F.count("*").over(Window.partitionBy()))
    share = F.expr(f"({num_steps} + ng - 1) div ng")
    whole = whole.withColumn("loops", F.floor((share + F.col("n") - 1) / F.col("n")))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    whole = whole.withColumn("first_seed", F.coalesce(F.sum("loops").over(before), none)).withColumn("first_row", F.coalesce(F.sum(F.col("loops") * F.col("n")).over(before), none))
    # The number of groups bounds this side; Spark broadcasts it if it is small.
    same = Window.partitionBy("group_idx", "folder_idx", "path").orderBy("path")
    files = files.withColumn("occurrence", F.row_number().over(same))
    passes = files.join(whole, "group_idx").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("loops") - 1)))
    passes = passes.withColumn("seed", F.col("first_seed") + F.col("pass"))
    key = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("folder_idx").cast("string"), "path", F.col("occurrence").cast("string")))
    # Passes follow each other in the numbering, and each has all files of its group, so a file's number gives its place in the group.
    rows = numbered(passes.withColumn("shuffle_key", key), ["g", "pass", "shuffle_key"], "row")
    out = rows.withColumn("record_key", (F.col("row") - F.col("first_row")) * F.col("ng") + F.col("g")).where(F.col("record_key") < num_steps)
    return out.select("record_key", "group_idx", *[c for c in files.columns if c not in ("group_idx", "occurrence")], "pass", "seed")


#: Rounds of a permutation, for each bit of the number of places and besides.
ROUNDS_PER_BIT, ROUNDS = 3, 12


def _number(text: Column) -> Column:
    """A number of 52 bits of some text, as :mod:`cliploom.rng` makes them."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def permuted(place: Column, n: Column, seed: Column) -> Column:
    """Where a seeded permutation of 0 .. n-1 sends a place, computed from the place alone.

    In each round a place and its mirror image, at a distance that the round draws, change places or don't, as a bit of both
    says ("swap or not"): every round is its own inverse, so all together are a permutation for any n.
    """
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS) + ROUNDS_PER_BIT * F.ceil(F.log2(n.cast("double") + 1)).cast("int"))

    def step(x: Column, r: Column) -> Column:
        key = F.concat_ws("|", seed, r.cast("string"))
        mirror = F.pmod(_number(key) - x, n)
        swap = _number(F.concat_ws("|", key, F.greatest(x, mirror).cast("string"))) % 2 == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(rounds, place.cast("bigint"), step)


class KeyedBalancedSource:
    """A group-balanced sequence without an end whose records are looked up by their keys.

    As in :func:`balanced_index` record k is of group k mod G, and a group repeats a file only after all its files came, each pass in an order of
    its own. Here that order is a keyed permutation, so record k follows from k and the groups' sizes: files are numbered once, and
    no sequence is sorted or written, however long it is.
    """

    def __init__(self, files: DataFrame, seed: int = 0):
        groups = files.groupBy("group_idx").agg(F.count("*").alias("n"))
        before = Window.orderBy("group_idx").rowsBetween(Window.unboundedPreceding, -1)
        g = (F.row_number().over(Window.orderBy("group_idx")) - 1).cast("bigint")
        # A row for each group.
        groups = cut(groups.select("group_idx", "n", g.alias("g"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("first")), "groups")
        self.seed, self.groups, self.count = seed, groups, groups.count()
        self.files = numbered(files, ["group_idx", "folder_idx", "path"], "file")

    def lookup(self, keys: DataFrame | Sequence[int]) -> DataFrame:
        """Rows (record_key, pass, and the files' columns) of some keys, which can't be negative or null; repeated keys give repeated rows."""
        if not isinstance(keys, DataFrame):
            if any(k < 0 for k in keys):
                raise ValueError("record keys can't be negative")
            keys = self.files.sparkSession.createDataFrame([(int(k),) for k in keys], "record_key bigint")
        if not self.count:
            raise RuntimeError("the source has no records")
        own = keys.select(F.col("record_key").cast("bigint").alias("record_key")).withColumn("g", F.col("record_key") % self.count).withColumn("j", F.floor(F.col("record_key") / self.count))
        sized = own.join(self.groups, "g").withColumn("pass", F.floor(F.col("j") / F.col("n")))
        seed = F.concat_ws("|", F.lit(str(self.seed)), F.col("g").cast("string"), F.col("pass").cast("string"))
        placed = sized.withColumn("file", F.col("first") + permuted(F.col("j") % F.col("n"), F.col("n"), seed)).select("record_key", "pass", "file")
        return placed.join(self.files, "file").drop("file")

    def first(self, num_steps: int) -> DataFrame:
        """The first so many records."""
        return self.lookup(self.files.sparkSession.range(num_steps).withColumnRenamed("id", "record_key"))

    def __getitem__(self, key: int) -> DataFrame:
        return self.lookup([key])


def lookup(index: DataFrame, keys: DataFrame | Sequence[int]) -> DataFrame:
    """The records of some keys. Keys can't be negative; a key that the index lacks gives no row, a repeated key repeated rows."""
    if not isinstance(keys, DataFrame):
        if any(k < 0 for k in keys):
            raise ValueError("record keys can't be negative")
        keys = index.sparkSession.createDataFrame([(int(k),) for k in keys], "record_key bigint")
    return keys.select("record_key").join(index, "record_key")


class SimpleSource:
    """Files of all groups, each with the same weight."""

    def __init__(self, files: DataFrame, num_steps: int | None = None):
        self.index = simple_index(files, num_steps)

    def __len__(self) -> int:
        n = self.index.count()
        if not n:
            raise RuntimeError("the source has no records")
        return n

    def __getitem__(self, key: int) -> DataFrame:
        return lookup(self.index, [key])


class BalancedSource(SimpleSource):
    """Files of all groups, each group with the same weight."""

    def __init__(self, files: DataFrame, num_steps: int):
        self.num_steps, self.index = num_steps, balanced_index(files, num_steps)

    def __len__(self) -> int:
        return self.num_steps
