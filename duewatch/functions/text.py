"""Display and text columns: durations, relative/absolute times, status
tones, deep links, request-path sanitising and tag-filter parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duewatch.functions.time import instant

# Tone per process / deadline status (anything else is neutral).
STATUS_TONE = {
    "ACTIVE": "blue",
    "COMPLETED": "green",
    "FAILED": "red",
    "ON_TRACK": "green",
    "MISSED": "red",
    "COMPLETED_ON_TIME": "green",
    "COMPLETED_LATE": "amber",
}
NEUTRAL_TONE = "neutral"
EMPTY = "—"

# Path rewrites applied in order before a metric label is made.
PATH_REWRITES = [
    ("/v1/processes/[^/]+/[^/]+", "/v1/processes/{name}/{id}"),
    ("/v1/processes/[^/]+", "/v1/processes/{name}"),
    ("/swagger-ui/.*", "/swagger-ui/**"),
    ("/swagger/.*", "/swagger/**"),
]
MAX_PATH = 100


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _s(x: Column) -> Column:
    return x.cast("string")


def fmt_duration(secs) -> Column:
    """``42s``, ``5m 3s``, ``2h 5m``, ``1d 3h``; a zero minor unit is omitted;
    null → ``—``."""
    s = _c(secs)

    def two(major: Column, unit1: str, minor: Column, unit2: str) -> Column:
        return F.when(minor != 0, F.concat(_s(major), F.lit(unit1 + " "), _s(minor), F.lit(unit2))) \
                .otherwise(F.concat(_s(major), F.lit(unit1)))
    return (F.when(s.isNull(), F.lit(EMPTY))
            .when(s < 60, F.concat(_s(s), F.lit("s")))
            .when(s < 3600, two(F.floor(s / 60), "m", s % 60, "s"))
            .when(s < 86400, two(F.floor(s / 3600), "h", F.floor((s % 3600) / 60), "m"))
            .otherwise(two(F.floor(s / 86400), "d", F.floor((s % 86400) / 3600), "h")))


def fmt_relative(ts_s, as_of) -> Column:
    """``5m ago`` / ``in 2h``: one unit, floored; input and as_of in epoch seconds."""
    diff = F.unix_seconds(instant(as_of)) - _c(ts_s)
    a = F.abs(diff)
    val = (F.when(a < 60, a).when(a < 3600, F.floor(a / 60))
           .when(a < 86400, F.floor(a / 3600)).otherwise(F.floor(a / 86400)))
    unit = F.when(a < 60, F.lit("s")).when(a < 3600, F.lit("m")).when(a < 86400, F.lit("h")).otherwise(F.lit("d"))
    body = F.concat(_s(val), unit)
    return F.when(diff >= 0, F.concat(body, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), body))


def fmt_absolute(ts_s) -> Column:
    """``YYYY-MM-DD HH:MM UTC`` from epoch seconds; null → ``—``."""
    s = _c(ts_s)
    return F.when(s.isNull(), F.lit(EMPTY)).otherwise(
        F.concat(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm"), F.lit(" UTC")))


def status_tone(col) -> Column:
    c = _c(col)
    expr = F.lit(NEUTRAL_TONE)
    for status, tone in reversed(list(STATUS_TONE.items())):
        expr = F.when(c == status, F.lit(tone)).otherwise(expr)
    return expr


def process_url(base: str | None, name="name", process_id="process_id") -> Column:
    """``<base>/?process=<name>/<id>`` with form encoding; null when the base
    is blank or either part is null. Trailing slashes of base are dropped."""
    if base is None or not base.strip():
        return F.lit(None).cast("string")
    root = base.rstrip("/")
    n, p = _c(name), _c(process_id)
    return F.when(n.isNotNull() & p.isNotNull(),
                  F.concat(F.lit(root + "/?process="), F.url_encode(n), F.lit("/"), F.url_encode(p)))


def sanitize_path(col) -> Column:
    c = _c(col)
    out = c
    for pattern, repl in PATH_REWRITES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(repl.replace("$", "\\$")))
    cut = F.when(F.length(out) > MAX_PATH, F.concat(F.substring(out, 1, MAX_PATH), F.lit("..."))).otherwise(out)
    return F.when(c.isNull(), F.lit("unknown")).otherwise(cut)


def parse_tag_filter(text: str | None) -> dict[str, str] | None:
    """``"k1:v1,k2:v2"`` → ``{k1: v1, k2: v2}``: split on ``,`` then on the
    first ``:``; trimmed; empty keys skipped; a later duplicate key wins."""
    if text is None or not text.strip():
        return None
    out: dict[str, str] = {}
    for pair in text.split(","):
        pair = pair.strip()
        if not pair or ":" not in pair:
            continue
        k, v = pair.split(":", 1)
        if k.strip():
            out[k.strip()] = v.strip()
    return out or None


def parse_tag_filter_col(col) -> Column:
    """Column form of :func:`parse_tag_filter`: ``map<string,string>``, or null
    when nothing valid remains. Duplicate keys keep the last value."""
    c = _c(col)
    pairs = F.transform(F.split(c, ","), strip)
    valid = F.filter(pairs, lambda p: (p != "") & F.contains(p, F.lit(":")))
    kv = F.transform(valid, lambda p: F.struct(
        strip(F.substring_index(p, ":", 1)).alias("key"),
        strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value")))
    kept = F.filter(kv, lambda s: s["key"] != "")
    # Last occurrence wins: reverse, keep the first of each key, reverse back.
    rev = F.reverse(kept)
    dedup = F.filter(rev, lambda s, i: ~F.exists(F.slice(rev, 1, i), lambda t: t["key"] == s["key"]))
    entries = F.reverse(dedup)
    return F.when(c.isNotNull() & (F.size(entries) > 0), F.map_from_entries(entries))


def strip(col) -> Column:
    """Without leading and trailing characters up to U+0020, which the service's trim removes."""
    return F.regexp_replace(_c(col), F.lit(r"^[\x00-\x20]+|[\x00-\x20]+$"), F.lit(""))


def blank(col) -> Column:
    """Null, or nothing but characters up to U+0020."""
    c = _c(col)
    return c.isNull() | c.rlike(r"^[\x00-\x20]*$")


def utf16_length(col) -> Column:
    """Length in UTF-16 units, as the service counts: characters beyond U+FFFF are two."""
    c = _c(col)
    return F.length(c) + F.length(F.regexp_replace(c, F.lit(r"[^\x{10000}-\x{10FFFF}]"), F.lit("")))
