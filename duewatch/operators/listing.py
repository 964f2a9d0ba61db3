"""Sorting, paging and the list endpoint."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F, types as T

from duewatch.functions import columns as C
from duewatch.functions.jsoncols import CONTEXT, TAGS, parse_tags, typed_context
from duewatch.functions.time import instant
from duewatch.operators.filters import RunFilter, apply_filter
from duewatch.operators.ordering import top_k

SORT_KEYS = ("started_at", "completed_at", "deadline", "name", "status", "duration")
DEFAULT_LIMIT, MAX_LIMIT = 20, 100


def parse_sort(spec: str | None) -> tuple[str, str]:
    """``"k:dir,..."`` → (k, dir) of the first field; ``"k"`` → asc;
    blank → (started_at, desc)."""
    if spec is None or not spec.strip():
        return "started_at", "desc"
    first = spec.split(",")[0].strip()
    if ":" in first:
        parts = [p for p in first.split(":")]
        while parts and parts[-1] == "":
            parts.pop()
        return (parts[0].strip() if parts else ""), (parts[1].strip() if len(parts) > 1 else "asc")
    return first, "asc"


def sort_expression(key: str, as_of) -> Column:
    if key == "duration":
        return F.unix_micros(F.coalesce(C.completed, instant(as_of))) - F.unix_micros(C.started)
    return F.col(key)


def sort_columns(key: str | None, direction: str | None, as_of) -> list[Column]:
    """Whitelisted key (unknown → started_at); ASC only for 'asc'; nulls last
    both ways; id descending as tiebreak."""
    k = (key or "started_at").lower()
    if k not in SORT_KEYS:
        k = "started_at"
    expr = sort_expression(k, as_of)
    asc = (direction or "").lower() == "asc"
    col = expr.asc_nulls_last() if asc else expr.desc_nulls_last()
    return [col, F.col("id").desc()]


def sort_multi(spec: str, as_of) -> list[Column]:
    """Every ``k[:dir]`` field in order, ascending by default; id desc last."""
    cols = []
    for field in spec.split(","):
        field = field.strip()
        if not field:
            continue
        k, _, d = field.partition(":")
        k = k.strip().lower()
        if k not in SORT_KEYS:
            continue
        expr = sort_expression(k, as_of)
        cols.append(expr.desc_nulls_last() if d.strip().lower() == "desc" else expr.asc_nulls_last())
    return cols + [F.col("id").desc()]


def clamp_page(limit: int | None, offset: int | None) -> tuple[int, int]:
    lim = DEFAULT_LIMIT if limit is None else max(1, min(int(limit), MAX_LIMIT))
    return lim, max(0, int(offset or 0))


def page_by_number(page: int, size: int) -> tuple[int, int]:
    """1-based page/size paging (size at most 50) → (limit, offset)."""
    size = max(1, min(int(size), 50))
    return size, (max(1, int(page)) - 1) * size


def run_response(runs: DataFrame, as_of, *keep: str) -> DataFrame:
    """The per-run response: id, name, status, deadline_status, epoch-second
    times, live duration, typed tags, and the context as a variant, whose
    numbers, booleans and nested objects keep their types."""
    return runs.select(
        *keep, F.col("process_id").alias("id"), "name", "status",
        C.deadline_status(as_of).alias("deadline_status"),
        F.unix_seconds(C.started).alias("started_at"),
        F.unix_seconds(C.completed).alias("completed_at"),
        F.unix_seconds(C.deadline).alias("deadline"),
        C.duration_s(as_of).alias("duration"),
        parse_tags("tags").alias("tags"),
        typed_context("context").alias("context"),
    )


def normalize(resp: DataFrame) -> DataFrame:
    """Fill omitted response fields with defaults: tags → [], context → {}
    (typed: a variant, or a map of texts), leaving every other field as is."""
    out = resp
    if "tags" in resp.columns:
        out = out.withColumn("tags", F.coalesce(F.col("tags"), F.array().cast(TAGS)))
    if "context" in resp.columns:
        variant = isinstance(resp.schema["context"].dataType, T.VariantType)
        out = out.withColumn("context", F.coalesce(F.col("context"), F.parse_json(F.lit("{}")) if variant else F.create_map().cast(CONTEXT)))
    return out


def list_sort(flt: RunFilter) -> tuple[str, str]:
    """Key and direction of a list request that sorts by one field."""
    spec = flt.sort_by
    key, direction = parse_sort(spec)
    direction = direction if spec and ":" in spec else (flt.sort_dir or "desc")
    key = key.lower() if key.lower() in SORT_KEYS else "started_at"
    return key, "asc" if direction.lower() == "asc" else "desc"


def list_order(flt: RunFilter, as_of) -> list[Column]:
    """Order of a list request. A spec of one field, with or without its
    direction, is :func:`parse_sort`'s; one of several is sorted by them all."""
    spec = flt.sort_by
    if spec and len([f for f in spec.split(",") if f.strip()]) > 1:
        return sort_multi(spec, as_of)
    return sort_columns(*list_sort(flt), as_of)


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int | None) -> DataFrame:
    lim, off = clamp_page(limit, offset)
    return top_k(df, order, lim, off)


def list_runs(runs: DataFrame, flt: RunFilter | None, as_of, limit: int | None = None,
              offset: int | None = None) -> DataFrame:
    """Filter → sort → page: the full response, with ``pos`` and the ``total``
    of all matches on each row. A page past the end is one row that has
    nothing but the total."""
    flt = flt or RunFilter()
    matched = apply_filter(runs, flt, as_of)
    columns = list_order(flt, as_of)
    paged = page(matched, columns, limit, offset)
    total = matched.agg(F.count(F.lit(1)).alias("total"))  # one row, which the page's rows join
    rows = normalize(run_response(paged, as_of, "pos"))
    return total.join(rows, F.lit(True), "left").select(*rows.columns, "total")


def keyset_page(runs: DataFrame, flt: RunFilter | None, as_of, after: tuple | None = None,
                limit: int | None = None) -> DataFrame:
    """The page that follows ``after``, the (sort value, id) of the last row
    seen, in the order of the filter's sort field (newest first by default).

    Deep pages cost what the first one costs: the bound is a filter, which for
    a stored column reaches the scan, and no offset is merged. Nulls come last
    both ways and ids descend, as in :func:`sort_columns`."""
    flt = flt or RunFilter()
    key, direction = list_sort(flt)
    matched = apply_filter(runs, flt, as_of)
    if after is not None:
        value, same = sort_expression(key, as_of), F.col("id") < F.lit(after[1])
        if after[0] is None:
            matched = matched.filter(value.isNull() & same)
        else:
            at = instant(after[0]) if key in ("started_at", "completed_at", "deadline") else F.lit(after[0])
            beyond = value > at if direction == "asc" else value < at
            matched = matched.filter(beyond | ((value == at) & same) | value.isNull())
    return top_k(matched, sort_columns(key, direction, as_of), clamp_page(limit, 0)[0])


def paging(total: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One row from a one-row ``total``: total, clamped limit/offset, rows on the page, has_more."""
    lim, off = clamp_page(limit, offset)
    rows = F.greatest(F.lit(0), F.least(F.lit(lim), F.col("total") - F.lit(off)))
    return total.select(
        "total", F.lit(lim).cast("long").alias("limit"), F.lit(off).cast("long").alias("offset"),
        rows.cast("long").alias("rows"), (F.lit(off) + rows < F.col("total")).alias("has_more"))


def page_info(runs: DataFrame, flt: RunFilter | None, as_of, limit: int | None = None,
              offset: int | None = None) -> DataFrame:
    """:func:`paging` of all matches of a filter."""
    return paging(apply_filter(runs, flt, as_of).agg(F.count(F.lit(1)).alias("total")), limit, offset)
