"""What the operators of this subpackage share: written intermediate tables and text helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.session import shared_folder

#: The only white space that these operators split on.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, or to ``path``, and reads it again.

    This cuts the lineage like checkpoint() does, survives lost executors, and is columnar, so that
    later reads prune columns and the planner knows the size.
    """
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Removes a written table, once nothing that is still to run reads it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Keys that :func:`join_by_key` sends to every task, at most, and from how many rows on.
HOT_KEYS, HOT_ROWS = 1000, 1000


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row for each key and the number of rows by key in ``count``.

    The rows of the most frequent keys, HOT_KEYS at most, meet a broadcast of these; all others are
    shuffled. So no task gets more than one in HOT_KEYS rows of one key.
    """
    hot = written(keyed.where(F.col(count) >= HOT_ROWS).orderBy(F.desc(count), key).limit(HOT_KEYS).coalesce(1), "hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.drop(count), key)
    return rows.join(F.broadcast(hot.drop(count)), key).unionByName(rest)


#: Shares that the rows of one key are dealt to where the other side has a row by key.
SALTS = 8


def salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def with_all_salts(keyed: DataFrame) -> DataFrame:
    """``keyed`` once for each share, to be joined by a shuffle: the planner's sizes know nothing of the repetition."""
    return keyed.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, however long the texts are.

    Spark reads these settings when a plan runs, which is after the operator returned it, so they stay.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
