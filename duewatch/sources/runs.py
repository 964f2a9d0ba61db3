"""The ``runs`` table: schema, readers and schema upgrade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RUNS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("process_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("completed_at", T.TimestampType(), True),
    T.StructField("deadline", T.TimestampType(), True),
    T.StructField("tags", T.StringType(), True),
    T.StructField("context", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("namespace_id", T.LongType(), True),
    T.StructField("deadline_notified_at", T.TimestampType(), True),
    T.StructField("deadline_warned_at", T.TimestampType(), True),
])

# Columns added by later schema versions; older files lack them.
LATE_COLUMNS = ("namespace_id", "deadline_notified_at", "deadline_warned_at")


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read runs Parquet with the full schema; columns missing in older files
    come back null (Parquet resolves columns by name)."""
    return spark.read.schema(RUNS).parquet(path)


def upgrade_runs(df: DataFrame) -> DataFrame:
    """Bring an older runs frame to the current schema (missing → typed null)
    and order the columns as in ``RUNS``."""
    have = set(df.columns)
    return df.selectExpr(*[
        (f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name in have
         else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`") for f in RUNS.fields])


def jdbc_options(url: str, table: str = "processes", *, lower_id: int | None = None,
                 upper_id: int | None = None, partitions: int = 64, fetch_size: int = 500,
                 user: str | None = None, password: str | None = None) -> dict[str, str]:
    """Options for reading runs from a relational database in parallel.

    The id range is split into ``partitions`` slices read by separate tasks;
    filters and column pruning written afterwards are pushed into the SQL.
    """
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if lower_id is not None and upper_id is not None:
        opts.update(partitionColumn="id", lowerBound=str(lower_id), upperBound=str(upper_id),
                    numPartitions=str(partitions))
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    return opts


def load_runs_jdbc(spark: SparkSession, url: str, table: str = "processes", **kwargs) -> DataFrame:
    """Read runs from a database by many tasks, which need the range of ids:
    without bounds, its ends are read first, by one query over the id index."""
    def load(**options) -> DataFrame:
        return spark.read.format("jdbc").options(**jdbc_options(url, **options)).load()
    if kwargs.get("lower_id") is None or kwargs.get("upper_id") is None:
        ends = load(table=f"(SELECT min(id) AS lo, max(id) AS hi FROM {table}) ends",
                    **{k: v for k, v in kwargs.items() if k in ("user", "password")}).first()
        kwargs |= {"lower_id": ends["lo"] or 0, "upper_id": ends["hi"] or 1}
    return upgrade_runs(load(table=table, **kwargs))


FILE_BYTES, MAX_FILES = 256 << 20, 1_000_000
#: Columns that single runs are looked up by. A row group's bloom filter tells that a value isn't in it.
LOOKUP_COLUMNS = ("process_id", "id")


def _input_bytes(df: DataFrame) -> int:
    """Size of what ``df`` reads, from the statistics of its plan: one call, whatever the number of files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(known, 1 << 60)  # a leaf without statistics counts as without bound


def write_parquet(df: DataFrame, path: str, mode: str, partition_by: str | None = None, lookups: tuple[str, ...] = LOOKUP_COLUMNS) -> None:
    """Write with bloom filters on ``lookups``, and instants as microseconds: the old 96-bit ones have no statistics to skip by."""
    writer = df.write.mode(mode)
    for column in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    conf, name = df.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    before = conf.get(name)
    conf.set(name, "TIMESTAMP_MICROS")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        conf.set(name, before)


def write_runs(runs: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """Store runs partitioned by status and range-clustered by time.

    Scans and rollups mostly touch ACTIVE runs, so status partitioning lets
    them skip the (much larger) finished history. Inside a status, rows are
    range-partitioned on a clustering time — the deadline for ACTIVE runs
    (what the deadline scans filter on), the completion time for finished
    ones (what analytics windows filter on) — so every status is spread over
    many tasks (none lands in one task) and each file covers a narrow time
    range that Parquet min/max statistics can skip. Row groups have bloom
    filters on LOOKUP_COLUMNS. ``files`` defaults to the size of what ``runs``
    reads over FILE_BYTES, ``spark.sql.shuffle.partitions`` at least and
    MAX_FILES at most.
    """
    least = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = files or min(max(least, -(-_input_bytes(runs) // FILE_BYTES)), MAX_FILES)
    cluster = F.coalesce(F.col("completed_at"), F.col("deadline"), F.col("started_at"))
    write_parquet(runs.repartitionByRange(n, F.col("status"), cluster, F.col("id"))
                  .sortWithinPartitions(F.col("status"), cluster, F.col("id")), path, mode, "status")


def read_stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by :func:`write_runs` with the canonical schema and
    column order. The schema is given, so no footer is read to infer it;
    ``status`` comes from the partition directories."""
    return upgrade_runs(load_runs(spark, path))
