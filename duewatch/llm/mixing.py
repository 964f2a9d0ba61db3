"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is wanted r times, r = target / source size, from 0
to 2. Its whole part is given; its fraction is a copy probability. Two
documents with fractional probabilities are paired and mass moves from one to
the other, in a random direction with expectations preserved and the expected
words of the pair unchanged, until one probability is 0 or 1. So a group of
documents ends with at most one fraction. Groups are combined in a reduction
tree over Spark: documents are dealt into groups of bounded size, each group
hands its residual up, and the residuals are paired in the same way, until a
single one per source is left and rounded at random. A source's words then
miss its target by one document at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewatch.llm.hashing import mix
from duewatch.llm.shared import cut

FANOUT = 2000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    """Maximal runs of other bytes than space and 0x09-0x0D; null has none."""
    gaps = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.size(F.filter(gaps, lambda w: w != "")).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, by code point of the source, null last, in no single task.

    Sources are dealt by range, numbered within each range, and the ranges'
    sizes (one row each) are summed up.
    """
    part = cut(sources.withColumn("__null", F.col("source").isNull())
               .repartitionByRange(F.col("__null"), F.col("source"))
               .withColumn("__part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (part.groupBy("__part").agg(F.count("*").alias("n"))
              .select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last()))
    return (part.withColumn("__place", place).join(starts, "__part")
            .withColumn("rank", F.col("__place") - 1 + F.col("__start")).drop("__null", "__part", "__place", "__start"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, units, target) of ``sizes`` (source, size, id).

    Sources share ``share`` of all words by their weights, which repeat in the
    sources' order. A target above ``most`` times its source's size stops
    there, and what it leaves is shared again by weight until none is above:
    each round is one aggregate over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    per = cut(_numbered(per).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)),
              "mix-targets")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        held = F.col("cap") <= F.col("weight") * F.lit(level)
        capped, free = per.agg(F.sum(F.when(held, F.col("cap"))), F.sum(F.when(~held, F.col("weight")))).first()
        now = max(level, (total - (capped or 0.0)) / free) if free else level
        if now == level or not free:
            break
        level = now
    return per.select("source", "source_size", "units",
                      F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _chance(ids: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on ids and seed alone."""
    with np.errstate(over="ignore"):
        h = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot_round(size: np.ndarray, p: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Round ``p`` in order until one fraction at most is left; p * size keeps its sum up to rounding."""
    p = p.copy()
    size = size.astype(float)
    held = -1
    for k in range(p.size):
        if p[k] <= 0.0 or p[k] >= 1.0:
            continue
        if size[k] <= 0:  # no words to share
            p[k] = 1.0 if chance[k] < p[k] else 0.0
            continue
        if held < 0:
            held = k
            continue
        i, j = held, k
        up = min((1.0 - p[i]) * size[i], p[j] * size[j])  # words that may move from j to i
        down = min(p[i] * size[i], (1.0 - p[j]) * size[j])
        moved = up if chance[k] * (up + down) < down else -down
        to_i, to_j = p[i] + moved / size[i], p[j] - moved / size[j]
        p[i] = to_i if 1e-12 < to_i < 1 - 1e-12 else round(to_i)
        p[j] = to_j if 1e-12 < to_j < 1 - 1e-12 else round(to_j)
        held = next((x for x in (i, j) if 0.0 < p[x] < 1.0), -1)
    return p


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                fanout: int = FANOUT, seed: int = 7) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), one row per document.

    ``copies`` is 0, 1 or 2; ``taken`` is copies * size. Rows repeated with
    source and id are one document, whose size is theirs together. Null text
    has no words; documents without words are rounded alone; the null source is
    a source, and one that isn't a text stands by its text. Decisions hang on ids and ``seed`` only, so reruns agree. An
    empty table gives no rows. No task gets more than about ``fanout``
    documents of a group, whatever a source's size.
    """
    sizes = (docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                         word_count(F.col(text_col)).alias("size"))
             .groupBy("source", "id").agg(F.sum("size").alias("size")))
    sizes = cut(sizes, "mix-sizes")
    targets = cut(source_targets(sizes, weights, share, most), "mix-shares")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (sizes.join(F.broadcast(targets) if targets.count() <= 4096 else targets,
                        sizes["source"].eqNullSafe(targets["source"]))
             .select("id", sizes["source"], "size", "source_size", "target",
                     F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"),
                     F.ceil(F.col("units") / fanout).cast("long").alias("groups"),
                     F.xxhash64(F.lit(seed), "id").alias("h"))
             .withColumn("g", F.pmod("h", F.col("groups"))))
    out_schema = ("id {}, source string, size bigint, source_size bigint, target double, whole bigint, p double, "
                  "groups bigint, h bigint, g bigint").format(sizes.schema["id"].dataType.simpleString())

    def settle(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "h"], ascending=[False, True], kind="stable")
            chance = _chance(pdf["h"].to_numpy(), seed * 1000 + level)
            return pdf.assign(p=pivot_round(pdf["size"].to_numpy(), pdf["p"].to_numpy(), chance))
        return run

    # Hashing the group with the source spreads a hot source's groups over all tasks.
    most_groups = targets.agg(F.max(F.ceil(F.col("units") / fanout))).first()[0] or 0
    done, open_, level = [], units, 0
    while True:
        rounded = cut(open_.groupBy("source", "g").applyInPandas(settle(level), out_schema), f"mix-level{level}")
        fraction = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rounded.where(~fraction))
        open_ = rounded.where(fraction).withColumn("g", F.expr(f"g div {fanout}"))
        level += 1
        if most_groups <= 1:
            break
        most_groups = -(-most_groups // fanout)
    lot = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(1 << 30)) / float(1 << 30)
    done.append(open_.withColumn("p", F.when(lot < F.col("p"), 1.0).otherwise(0.0)))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return every.select(F.col("id").alias(id_col), F.col("source").cast(docs.schema[source_col].dataType).alias(source_col), "size", "source_size", "target",
                        copies.alias("copies"), (copies * F.col("size")).alias("taken"))
