"""SQL twins of the derived views, written for DuckDB.

Each oracle query is ``WITH <views> SELECT ...`` over the driver's tables.
Instants are epoch microseconds (``*_us`` bigint) here, so no time-zone
rendering enters the comparison; Spark results expose epoch seconds.
"""

from __future__ import annotations

from duewatch.sources.fixtures import AS_OF_US, BUDGET_DAYS

AS_OF = str(AS_OF_US)
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _budget_case() -> str:
    whens = " ".join(f"WHEN '{p}' THEN {d}" for p, d in BUDGET_DAYS.items())
    return f"CAST(CASE o_orderpriority {whens} END AS BIGINT)"


RUNS_VIEW = f"""
runs_base AS (
  SELECT o.o_orderkey AS id, o.o_custkey, o.o_orderstatus, o.o_orderpriority,
         lower(c.c_mktsegment) AS name, n.n_name, r.r_name,
         epoch_us(o.o_orderdate) AS started_us,
         {_budget_case()} AS budget_days
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
runs_end AS (
  SELECT *, started_us + budget_days * {DAY_US} AS deadline_us,
         CASE WHEN id % 97 = 0 AND budget_days IS NOT NULL THEN started_us + budget_days * {DAY_US}
              ELSE started_us + ((id * 7919 + o_custkey * 104729) % 207360) * 100000000 END AS end_us
  FROM runs_base
),
runs AS (
  SELECT id, 'run-' || CAST(id AS VARCHAR) AS process_id, name,
         CASE WHEN end_us > {AS_OF} THEN 'ACTIVE' WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
         started_us,
         CASE WHEN end_us <= {AS_OF} THEN end_us END AS completed_us,
         deadline_us,
         CASE WHEN id % 17 = 0 THEN NULL
              WHEN id % 101 = 0 THEN '{{"key":"region","value":"none"}}'
              WHEN id % 103 = 0 THEN 'not json'
              WHEN id % 107 = 0 THEN '[1,{{"key":"region","value":"none"}}]'
              WHEN id % 109 = 0 THEN '[{{"key":"region","value":"none"}}] junk'
              ELSE '[{{"key":"region","value":"' || r_name || '"}},{{"key":"country","value":"' || n_name
                   || '"}},{{"key":"priority","value":"' || o_orderpriority || '"}}]' END AS tags,
         '{{"customer":' || CAST(o_custkey AS VARCHAR)
           || CASE WHEN id % 4 = 1 THEN ',"nested":{{"a":[1,null,"x"]}},"ok":true,"ratio":0.5}}' ELSE '}}' END AS context,
         started_us AS created_us,
         CASE WHEN end_us <= {AS_OF} THEN end_us ELSE started_us END AS updated_us,
         CASE WHEN id % 3 = 0 THEN {AS_OF} - {HOUR_US} END AS notified_us,
         CASE WHEN id % 4 = 0 THEN {AS_OF} - {HOUR_US} END AS warned_us
  FROM runs_end
)"""

# Epoch seconds from micros, floored like Spark's unix_seconds.
def sec(col: str) -> str:
    return f"CAST(floor({col} / 1000000.0) AS BIGINT)"


def round1(expr: str) -> str:
    return f"(floor(({expr}) * 10.0 + 0.5) / 10.0)"


def round1_tolerant(expr: str) -> str:
    return f"(floor(({expr}) * 10.0 + 0.5 + 1e-7) / 10.0)"


def round_int(expr: str) -> str:
    return f"CAST(floor(({expr}) + 0.5) AS BIGINT)"


OUTCOME = f"""CASE
      WHEN status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us < {AS_OF} THEN 'OVERDUE'
      WHEN status = 'ACTIVE' THEN 'ON_TRACK'
      WHEN status = 'FAILED' THEN 'FAILED'
      WHEN deadline_us IS NOT NULL AND completed_us > deadline_us THEN 'COMPLETED_LATE'
      ELSE 'COMPLETED_ON_TIME' END"""

DEADLINE_STATUS = f"""CASE
      WHEN deadline_us IS NULL THEN NULL
      WHEN status = 'ACTIVE' THEN CASE WHEN {AS_OF} > deadline_us THEN 'MISSED' ELSE 'ON_TRACK' END
      WHEN status = 'COMPLETED' AND completed_us IS NOT NULL THEN
           CASE WHEN completed_us <= deadline_us THEN 'COMPLETED_ON_TIME' ELSE 'COMPLETED_LATE' END
      END"""

COMPLETED_DUR = "CASE WHEN status = 'COMPLETED' AND completed_us IS NOT NULL THEN (completed_us - started_us) / 1e6 END"

IS_ARRAY = "(CASE WHEN json_valid(tags) THEN json_type(tags) = 'ARRAY' ELSE false END)"

# An array of objects only: what the typed response takes for tags.
IS_TAGS = (f"({IS_ARRAY} AND len(list_filter(from_json(CASE WHEN {IS_ARRAY} THEN tags END, '[\"JSON\"]'), lambda x: json_type(x) <> 'OBJECT')) = 0)")

PROBLEM = "outcome IN ('OVERDUE','COMPLETED_LATE','FAILED')"


def scope_where(hours: int, name: str | None = None) -> str:
    since = f"{AS_OF} - {hours} * {HOUR_US}"
    w = f"(status = 'ACTIVE' OR (completed_us IS NOT NULL AND completed_us >= {since}))"
    if name is not None:
        w += f" AND name = '{name}'"
    return w


def stats(col: str = "dur") -> str:
    return (f"count({col}) AS dur_count, {round1(f'avg({col})')} AS avg_s, "
            f"{round1(f'quantile_cont({col}, 0.5)')} AS p50_s, "
            f"{round1(f'quantile_cont({col}, 0.9)')} AS p90_s, "
            f"{round1(f'quantile_cont({col}, 0.99)')} AS p99_s")


def with_views(body: str, *extra_views: str) -> str:
    views = [RUNS_VIEW.strip()] + [v.strip() for v in extra_views]
    return "WITH " + ",\n".join(views) + "\n" + body


def classified_view(hours: int, name: str | None = None) -> str:
    return f"""classified AS (
  SELECT tags, {OUTCOME} AS outcome, {COMPLETED_DUR} AS dur
  FROM runs WHERE {scope_where(hours, name)}
)"""


EXPLODED_VIEW = f"""exploded AS (
  SELECT outcome, dur, e.value ->> 'key' AS tag_key, e.value ->> 'value' AS tag_value
  FROM (SELECT outcome, dur, unnest(from_json(tags, '["JSON"]')) AS value FROM classified WHERE {IS_ARRAY}) e
)"""


def tag_rollup_view() -> str:
    return f"""rollup AS (
  SELECT tag_key, tag_value, count(*) AS total,
    count(*) FILTER (WHERE outcome = 'OVERDUE') AS overdue,
    count(*) FILTER (WHERE outcome = 'ON_TRACK') AS on_track,
    count(*) FILTER (WHERE outcome = 'COMPLETED_LATE') AS completed_late,
    count(*) FILTER (WHERE outcome = 'COMPLETED_ON_TIME') AS completed_on_time,
    count(*) FILTER (WHERE outcome = 'FAILED') AS failed,
    count(*) FILTER (WHERE {PROBLEM}) AS problems,
    {stats()}
  FROM exploded GROUP BY tag_key, tag_value
)"""


TAG_ORDER = "problems DESC, total DESC, tag_key ASC NULLS LAST, tag_value ASC NULLS LAST"


def ordered(select_from: str, order: str, limit: int | None = None, offset: int = 0,
            cols: str = "*") -> str:
    """Rows of ``select_from`` with a ``pos`` column matching ``top_k``."""
    return (f"SELECT * FROM (SELECT {cols}, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS pos "
            f"FROM {select_from}) q WHERE pos > {offset}"
            + (f" AND pos <= {offset + limit}" if limit is not None else "") + " ORDER BY pos")


def tag_impact_sql(hours: int, name: str | None = None, cap: int = 100) -> str:
    return with_views(ordered("rollup", TAG_ORDER, cap),
                      classified_view(hours, name), EXPLODED_VIEW, tag_rollup_view())
