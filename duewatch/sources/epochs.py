"""Tables written by a stream, one folder per epoch.

A micro-batch writes its own folder, ``epoch=N``, and a replay after a failure
replaces it, so nothing is written twice and nothing has to be read to know
what is there. A folder counts once its writer's ``_SUCCESS`` file stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def committed(spark: SparkSession, path: str, after: int = -1) -> list[int]:
    """Epochs above ``after`` that are fully written, in order; one listing by Hadoop's file system."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "epoch=*/_SUCCESS")) or []
    found = (int(d.getPath().getParent().getName().split("=")[1]) for d in done)
    return sorted(e for e in found if e > after)


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def read_epochs(spark: SparkSession, path: str, schema, after: int = -1) -> DataFrame:
    """Rows of all committed epochs above ``after``; an empty frame if there are none."""
    epochs = committed(spark, path, after)
    if not epochs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/epoch={e}" for e in epochs])


def prune(spark: SparkSession, path: str, upto: int) -> list[int]:
    """Delete committed epochs up to and including ``upto``, once something newer holds what they held."""
    fs, root = _fs(spark, path)
    gone = [e for e in committed(spark, path) if e <= upto]
    for e in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"epoch={e}"), True)
    return gone
