"""Exact percentiles per group, and sums beside them, with bounded memory per task.

A fixed monotone function deals values into narrow ranges. One aggregate by
(group, range), combined in each task before it shuffles, counts the ranges and
adds up whatever else is wanted of the group. The ranges' running counts (a few
thousand rows per group at most) tell which ranges hold the wanted ranks. Only
values of those ranges, about one in a thousand, are read again, counted, and
put in order by a window whose partitions are (group, range). No array or map
is kept per group, a hot group's values are spread over its ranges, and there
is no other path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_PS = (0.5, 0.9, 0.99)
RANGE_RATIO = 1.001


def range_sql(value: str) -> str:
    """SQL text of a number that never falls as ``value`` rises: steps of 0.1 % on either side of zero; null for null."""
    return f"CAST(signum({value}) * floor(ln(abs({value}) + 1.0D) / {RANGE_RATIO - 1.0!r}D) AS BIGINT)"


def _same(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k + "_"])
    return cond


def _ranks(p: float, nearest_rank: bool) -> tuple[str, str, str]:
    """(position, rank below, rank above) among n values, ranks counted from 1."""
    if nearest_rank:
        rank = f"greatest(1L, CAST(ceil({float(p)!r}D * n) AS BIGINT))"
        return "0.0D", rank, rank
    at = f"({float(p)!r}D * (n - 1))"
    return at, f"(CAST(floor({at}) AS BIGINT) + 1)", f"(CAST(ceil({at}) AS BIGINT) + 1)"


def ranged(rows: DataFrame, keys: list[str], value: str, sums: dict[str, str], count: str = "1L") -> DataFrame:
    """One row per (group, range): the range ``_b`` (null: no value), its number of values ``_m``, and ``sums``.

    These rows add up, so they can be stored by day and merged. ``count`` is the
    SQL text of how many rows a row stands for; ``sums`` of what to add up."""
    kept = rows.selectExpr(*[f"`{k}`" for k in keys], f"{range_sql(f'CAST({value} AS DOUBLE)')} AS _b",
                           f"CASE WHEN {value} IS NULL THEN 0L ELSE {count} END AS _m", *[f"{e} AS `{n}`" for n, e in sums.items()])
    return kept.groupBy(*keys, "_b").agg(F.expr("sum(_m)").alias("_m"), *[F.expr(f"sum(`{n}`)").alias(n) for n in sums])


def grouped_stats(rows: DataFrame, keys: list[str], value: str, sums: dict[str, str], ps: Sequence[float] = DEFAULT_PS,
                  nearest_rank: bool = False, count: str = "1L", ranges: DataFrame | None = None) -> DataFrame:
    """``keys``, ``n`` (values), the ``sums`` and ``_q`` (array<double>, one entry per p, null without values), a row per group.

    Interpolated between the values around rank ``p · (n − 1)``, as
    ``percentile`` does, or with ``nearest_rank`` the value at rank
    ``max(1, ceil(p · n))``, as ``percentile_disc`` does. Without keys there is
    one group, and no row if there are no rows. Null keys are a group.
    ``ranges`` are rows of :func:`ranged` that are known already (stored
    partials); ``rows`` is then read for the values of the wanted ranges only.
    """
    one = "_all"
    if not keys:
        rows, keys = rows.withColumn(one, F.lit(0)), [one]
        ranges = None if ranges is None else ranges.withColumn(one, F.lit(0))
    if ranges is None:
        ranges = ranged(rows, keys, value, sums, count)
    else:  # of several days: add them up
        ranges = ranges.groupBy(*keys, "_b").agg(*[F.expr(f"sum(`{c}`)").alias(c) for c in ("_m", *sums)])
    by = ", ".join(f"`{k}`" for k in keys)
    upto = f"OVER (PARTITION BY {by} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ranges = ranges.selectExpr("*", f"sum(_m) OVER (PARTITION BY {by}) AS n", f"sum(_m) {upto} AS _end", f"row_number() {upto} AS _at")
    totals = [f"sum(`{s}`) OVER (PARTITION BY {by}) AS `{s}`" for s in sums]
    ranges = ranges.selectExpr(*[f"`{k}`" for k in keys], "_b", "_m", "n", "_end", "_at", *totals)

    wanted = [r for p in ps for r in _ranks(p, nearest_rank)[1:]]
    hit = " OR ".join(f"({r} > _end - _m AND {r} <= _end)" for r in wanted)
    # Both branches carry the same columns, so that they share one exchange.
    near = ranges.where(f"_m > 0 AND ({hit})").selectExpr(
        *[f"`{k}` AS `{k}_`" for k in keys], "_b AS _b_", "n", "_end - _m AS _before", *[f"`{s}`" for s in sums])
    values = rows.selectExpr(*[f"`{k}`" for k in keys], f"CAST({value} AS DOUBLE) AS _v", f"{count} AS _c").where("_v IS NOT NULL")
    values = values.selectExpr("*", f"{range_sql('_v')} AS _b")
    found = values.join(near, _same(keys, values, near) & (values["_b"] == near["_b_"]))
    carried = ["n", "_before", *sums]
    counted = found.groupBy(*keys, "_b", "_v").agg(F.expr("sum(_c)").alias("_c"), *[F.expr(f"first(`{c}`)").alias(c) for c in carried])
    placed = counted.selectExpr("*", f"_before + sum(_c) OVER (PARTITION BY {by}, _b ORDER BY _v ROWS BETWEEN UNBOUNDED PRECEDING "
                                     "AND CURRENT ROW) AS _last")
    picks = placed.selectExpr(*[f"`{k}`" for k in keys], "n", *[f"`{s}`" for s in sums],
                              *[f"CASE WHEN {r} > _last - _c AND {r} <= _last THEN _v END AS _r{i}" for i, r in enumerate(wanted)])
    whole = ranges.where("_at = 1").selectExpr(*[f"`{k}`" for k in keys], "n", *[f"`{s}`" for s in sums],
                                               *[f"CAST(NULL AS DOUBLE) AS _r{i}" for i in range(len(wanted))])
    got = whole.unionByName(picks).groupBy(*keys).agg(
        *[F.expr(f"max(`{c}`)").alias(c) for c in ("n", *sums)], *[F.expr(f"max(_r{i})").alias(f"_r{i}") for i in range(len(wanted))])
    out = []
    for i, p in enumerate(ps):
        at, lo, hi = _ranks(p, nearest_rank)
        a, b = f"_r{2 * i}", f"_r{2 * i + 1}"
        out.append(f"CASE WHEN {lo} = {hi} THEN {a} ELSE ({hi} - 1 - {at}) * {a} + ({at} - ({lo} - 1)) * {b} END")
    return got.selectExpr(*[f"`{k}`" for k in keys if k != one], "n", *[f"`{s}`" for s in sums],
                          f"CASE WHEN n > 0 THEN array({', '.join(out)}) END AS _q")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: Sequence[float] = DEFAULT_PS,
                      nearest_rank: bool = False) -> DataFrame:
    """``keys``, ``n`` and ``q`` of each group with a value; see :func:`grouped_stats`."""
    return grouped_stats(df, keys, value, {}, ps, nearest_rank).where("n > 0").withColumnRenamed("_q", "q")
