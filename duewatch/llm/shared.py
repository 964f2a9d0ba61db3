"""Helpers the corpus operators share: table access, lineage cuts, fixed-size id filters."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Unset is accepted only for a local master (tests), where a private folder
    is as good; a cluster session without the setting is an error.
    """
    ctx = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir", None) \
        or ctx.getCheckpointDir()
    if not found:
        if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="duewatch-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders by the columns ``folders``, and read it back.

    Cuts the lineage at a place that survives the loss of executors: a later
    failure rereads the table instead of repeating the steps above it.
    """
    path = f"{shared_dir(df.sparkSession)}/duewatch-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uncut(*tables: DataFrame) -> None:
    """Delete the written tables of :func:`cut` that these frames read, once all that is made from them has been cut itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {m[0] for f in df.inputFiles() if (m := re.match(r".*/duewatch-[^/]+-[0-9a-f]{32}(?=/)", f))}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of about 8 MB, so that long texts don't make large ones.

    The size is a session setting, which is lowered here if it is higher.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, "64m").strip().lower().removesuffix("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:] in "kmg" else int(now)
    if size <= 0 or size > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


WORD = 64


def set_bits(cells: DataFrame, cell: str) -> DataFrame:
    """Bit set of the cells in column ``cell`` as rows (word, bits) of 64 cells each."""
    return (cells.groupBy(F.expr(f"`{cell}` div {WORD}").alias("__word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast(`{cell}` % {WORD} as int)))").alias("__bits")))


PACK = 256


def flag_by_bits(rows: DataFrame, words: DataFrame, cell: Column, flag: str) -> DataFrame:
    """Add boolean ``flag``: whether the bit of ``cell`` is set in ``words``.

    ``words`` comes from :func:`set_bits` over a fixed number of cells. It is
    packed into rows of PACK words, 2 KB each, and has at most cells / 2**14 of
    them, whatever the input: that is the bound under which it is broadcast,
    and few rows cost the driver little beside their bytes. ``rows`` are not
    shuffled.
    """
    item = F.struct(F.expr(f"cast(`__word` % {PACK} as int)").alias("i"), F.col("__bits").alias("b"))
    packed = (words.groupBy(F.expr(f"`__word` div {PACK}").alias("__pack")).agg(F.map_from_entries(F.collect_list(item)).alias("m"))
              .select("__pack", F.expr(f"transform(sequence(0, {PACK - 1}), i -> coalesce(m[i], 0L))").alias("__words")))
    tagged = rows.withColumn("__cell", cell)
    joined = tagged.join(F.broadcast(packed), F.expr(f"`__cell` div {PACK * WORD}") == F.col("__pack"), "left")
    hit = F.expr(f"coalesce(shiftrightunsigned(`__words`[cast((`__cell` div {WORD}) % {PACK} as int)], cast(`__cell` % {WORD} as int)) & 1L, 0L) = 1L")
    return joined.withColumn(flag, hit).drop("__cell", "__pack", "__words")


def keep_without(rows: DataFrame, dropped: DataFrame, key: str, bits: int = 23) -> DataFrame:
    """``rows`` whose ``key`` is not in ``dropped`` (one long column of that name).

    A fixed filter of 2**bits cells tells which rows may be dropped; only they
    shuffle for the exact anti-join, the rest pass straight through. Null keys
    are kept.
    """
    ids = dropped.select(F.col(key).alias("gone"))
    cell = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    words = set_bits(ids.select(cell("gone").alias("c")), "c")
    packed = rows.select(F.struct("*").alias("row"), F.col(key).alias("key"))  # no name of a column can clash
    flagged = flag_by_bits(packed, words, cell("key"), "maybe")
    tested = flagged.where("maybe").join(ids, F.col("key") == F.col("gone"), "left_anti")
    return flagged.where("not maybe").select("row.*").unionByName(tested.select("row.*"))
