"""Request bodies (JSON text) → typed rows, as the API would receive them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from duewatch.functions.jsoncols import TAGS, whole_json_sql
from duewatch.functions.text import blank

CREATE_BODY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("deadline", T.LongType()),
    T.StructField("tags", TAGS),
    T.StructField("context", T.MapType(T.StringType(), T.StringType())),
])


def _kind(value: Column) -> Column:
    """``null``, ``scalar``, ``array`` or ``object``: what a variant holds; null if there is none."""
    kind = F.schema_of_variant(value)
    return (F.when(kind == "VOID", F.lit("null")).when(kind.startswith("ARRAY"), F.lit("array"))
            .when(kind.startswith("OBJECT"), F.lit("object")).when(kind.isNotNull(), F.lit("scalar")))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _is(value: Column, *kinds: str) -> Column:
    """An absent or null value, or one of these kinds."""
    return F.coalesce(_kind(value).isin("null", *kinds), F.lit(True))


def _one_object(body: str) -> Column:
    """The body as a variant if it is one JSON object and nothing else, else null."""
    v = F.expr(whole_json_sql(f"`{body}`"))
    return F.when(_kind(v) == "object", v)


def _long(value: Column) -> Column:
    """A whole number in the range of a long, as a number or as its digits."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    digits = (kind == "BIGINT") | ((kind == "STRING") & text.rlike("\\A-?[0-9]{1,19}\\z"))
    return F.when(digits, text.try_cast("long"))


def _tags_fit(value: Column) -> Column:
    """Null, or a list whose elements are null or objects with a plain key and value."""
    def fits(t: Column) -> Column:
        return F.coalesce(_kind(t) == "null", F.lit(True)) | (
            (_kind(t) == "object") & _is(_field(t, "key"), "scalar") & _is(_field(t, "value"), "scalar"))
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(_kind(value) == "null", F.lit(True)) | (
        (_kind(value) == "array") & F.coalesce(F.forall(items, fits), F.lit(False)))


def parse_create_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """``name`` (path) + JSON ``body`` → name, id, deadline (epoch s), tags, context, unreadable.

    A body is unreadable if it is absent or blank, isn't one JSON object with
    nothing behind it, or has a field of another type: ``id`` is a text (a
    number or boolean counts as its text), ``deadline`` a whole number or its
    digits, ``tags`` a list of objects with plain ``key`` and ``value``,
    ``context`` an object. Null or absent fields are readable."""
    v = F.col("_v")
    deadline = _field(v, "deadline")
    fits = (_is(_field(v, "id"), "scalar") & (_is(deadline) | _long(deadline).isNotNull())
            & _tags_fit(_field(v, "tags")) & _is(_field(v, "context"), "object"))
    keep = [F.col(c) for c in raw.columns if c != body]
    b = F.col("_b")
    fields = [b["id"].alias("id"), _long(deadline).alias("deadline"), b["tags"].alias("tags"), b["context"].alias("context")]
    parsed = raw.withColumn("_v", _one_object(body)).withColumn("_ok", F.coalesce(v.isNotNull() & fits, F.lit(False)))
    parsed = parsed.withColumn("_b", F.when(F.col("_ok"), F.from_json(F.col(body), CREATE_BODY)))
    return parsed.select(*keep, *[F.when(F.col("_ok"), f).alias(n) for f, n in zip(fields, CREATE_BODY.names, strict=True)],
                         (~F.col("_ok")).alias("unreadable"))


def parse_complete_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """Missing body or status → COMPLETED; an unreadable body (not one object, or a status
    that isn't a text) has no status and is flagged."""
    v = F.col("_v")
    status = _field(v, "status")
    keep = [F.col(c) for c in raw.columns if c != body]
    text = F.try_variant_get(status, "$", "string")
    readable = v.isNotNull() & (F.coalesce(_kind(status) == "null", F.lit(True)) | (F.schema_of_variant(status) == "STRING"))
    bad = ~blank(F.col(body)) & ~F.coalesce(readable, F.lit(False))
    parsed = raw.withColumn("_v", _one_object(body)).withColumn("_bad", bad)
    return parsed.select(*keep, F.when(~F.col("_bad"), F.coalesce(text, F.lit("COMPLETED"))).alias("status"),
                         F.col("_bad").alias("unreadable"))


def read_request_stream(spark, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Streaming reader for request files (one JSON object per line)."""
    return spark.readStream.format(fmt).schema(schema).load(path)
