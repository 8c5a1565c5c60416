"""What the operators of this subpackage share: table access, shared folders, Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, if others differ from them by case alone."""
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return rows.select(*[rows[f"c{df.columns.index(n)}"].alias(n) for n in names])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types; columns that clash in name or case never reach the operators."""
    return only(df, *columns).select(*[F.col(name).cast(kind).alias(name) for name, kind in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets a temporary one; a cluster
    has no folder that it could be, and that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Stored(NamedTuple):
    """A Parquet table in the shared folder, to be dropped when nothing reads it any more."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        context = self.rows.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, what: str, by: Sequence[str] = ()) -> Stored:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, in folders by ``by``. Lost executors only repeat tasks."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def written(df: DataFrame, what: str) -> DataFrame:
    return stored(df, what).rows


def placed(df: DataFrame, groups: Sequence[str], order: Sequence[str], what: str) -> Stored:
    """The rows with place, from 0, in their group by ``order`` (nulls first). Rows are dealt by ranges of group and order, so a
    group of any size is sorted by many tasks; what its earlier ranges hold is counted and added. Equal rows are split as well."""
    keys = [*groups, *order]
    ranged = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    ranges = stored(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), f"{what}-ranges")
    rows = ranges.rows
    counts = rows.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    found = stored(rows.join(counts, same).withColumn("place", F.col("_at") + F.col("_shift")).select(*df.columns, "place"), what)
    ranges.drop()
    return found


def spread_join(rows: DataFrame, one: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """rows joined with ``one``, which has a row for each key. Keys that hold over a ``hot``-th of the rows, so at most ``hot`` keys,
    are joined with a broadcast of their rows of ``one`` and stay where they are; the others are shuffled. rows are read three times."""
    least = max(1, rows.count() // hot)
    crowded = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(key)
    there = F.broadcast(one.join(crowded, key, "left_semi"))
    return rows.join(there, key).unionByName(rows.join(F.broadcast(crowded), key, "left_anti").join(one, key))


def small_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Bounds what one Arrow batch holds, for tables in which some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def total_bytes(df: DataFrame, column: str, per_row: int = 0) -> int:
    """Sum of the column's UTF-8 lengths and ``per_row`` bytes for each row; one row comes to the driver."""
    return df.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + per_row)).first()[0] or 0


def is_held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def crc32_sql(number: str) -> str:
    """DuckDB's expression for the unsigned crc32 of a number's decimal text."""
    step = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce([4294967295] || list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: ascii(x)), lambda c, b: {step}), 4294967295)"


def groups_of(batches: Iterable, limit: int, size) -> Iterator[list]:
    """Rows of Arrow batches in lists of about limit bytes; one row may be larger than that."""
    held, total = [], 0
    for batch in batches:
        for row in batch:
            held.append(row)
            total += size(row)
            if total >= limit:
                yield held
                held, total = [], 0
    if held:
        yield held


def as_bytes(texts: Sequence) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
