"""What the operators share: scratch tables, row keys, sized joins."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without these characters (a Java and DuckDB character class).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join of at most so many narrow rows may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch on its way to Python, about; a longer row travels alone.
ARROW_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if all runs in one process, else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quillbase_dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = sc._quillbase_dir = "file://" + tempfile.mkdtemp(prefix="quillbase-")
    return found.rstrip("/")


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about ARROW_BYTES, to which the session's own bound is lowered."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 over unsigned values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/quillbase/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and no executor's loss undoes it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, which should be stored, with a broadcast hint if it has at most limit rows."""
    return F.broadcast(df) if df.count() <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """df, which has about a row a document, for a join that is a shuffled one at every size: small inputs get the plan of large ones."""
    return df.hint("merge")


def content_key(*cols: Column) -> Column:
    """128 bits that stand for the values of the columns, nulls included."""
    marked = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit("b"), *marked).alias("b"))


def words(text: Column) -> Column:
    """The words of a text in their order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df begins with it, so that longer names are free too."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def drop(*frames: DataFrame) -> None:
    """Deletes the files of tables from stored() that nothing will read again."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
