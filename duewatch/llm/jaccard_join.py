"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct word shingles. Equal sets are one class, so
copies are compared once. Shingles have one global order, rarest first (by
how often they are repeated, from a fixed-size table over all documents, then
by hash). Two sets of similarity t or more share a shingle within their prefixes of
n - ceil(t * n) + 1, so classes are joined on prefix shingles alone; pairs
outside the length bound, or whose positions leave too little to share, go at
once. So do pairs that a suffix filter tells apart: each set has the parity of
its count in each of 512 hash cells, and two sets differ in at least as many
shingles as parities. What is left is verified once per pair by an exact count.

Joining all classes under a frequent shingle with each other would grow with
the square of a family of near copies, though its members hang together by few
links. So in a fixed number of rounds every class is joined with a few pivots, out of those of
the shingles it is under the ones it shares most with, and components are formed; then only pairs whose ends
are still in different components are formed, all of them. Components come out as if every
pair had been verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewatch.llm import hashing
from duewatch.llm.components import components
from duewatch.llm.exact_dedup import flag_possible_repeats
from duewatch.llm.shared import cut, flag_by_bits, map_batches, set_bits, uncut

COUNT_BITS = 21
BLOCK = 1 << 20
ID_BITS = 23
PARITY_LONGS = 8
PIVOT_ROUNDS, PIVOTS_A_CLASS = 3, 2
TOKEN_BITS = 26
SHORT_LIST = 16
PARITY = [f"q{k}" for k in range(PARITY_LONGS)]


def _document_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) for each row with words."""
    data, offsets = hashing.string_buffers(batch.column(1))
    for a, b in hashing.document_groups(offsets):
        sh, row = hashing.shingles(*hashing.words(data, offsets, a, b), words)
        ends = np.searchsorted(row, np.arange(b - a + 1))
        for i in np.flatnonzero(np.diff(ends)):
            yield a + int(i), np.unique(sh[ends[i]:ends[i + 1]])


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How often shingles are repeated, in a table of 2**COUNT_BITS hash cells of two bytes.

    Tasks go over all documents in blocks of BLOCK shingles, count how many of
    a block's documents have each, and report those that more than one has; so
    a cell holds what is repeated and not the noise of all that occurs once.
    The table orders prefixes; any numbers in it give the same links.
    """
    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        distinct, n = np.unique(np.concatenate(held), return_counts=True)
        cell = (distinct[n > 1] >> np.uint64(64 - COUNT_BITS)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[n > 1].astype(np.int64))], ["cell", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, s in _document_sets(batch, words):
                held.append(s)
                size += s.size
                if size > BLOCK:
                    yield repeated(held)
                    held, size = [], 0
        if held:
            yield repeated(held)

    got = map_batches(docs, count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.uint16)
    out[got.column(0).to_numpy()] = np.minimum(got.column(1).to_numpy(), 65535)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prefixes(docs: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(id, n, s1, s2, parities, prefix): set size, digest of the set in two longs, rarest shingles in order; a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            digest = np.zeros((2, batch.num_rows), np.uint64)
            parity = np.zeros((PARITY_LONGS, batch.num_rows), np.int64)
            prefix: list[np.ndarray] = [np.empty(0, np.int64)] * batch.num_rows
            for i, s in _document_sets(batch, words):
                n[i] = s.size
                digest[:, i] = _digest(s)
                odd = np.bincount(s & np.uint64(64 * PARITY_LONGS - 1), minlength=64 * PARITY_LONGS) & 1
                parity[:, i] = np.packbits(odd.astype(bool)).view(np.int64)
                size = s.size - -(-percent * s.size // 100) + 1
                f = freq[s >> np.uint64(64 - COUNT_BITS)]
                if size < s.size:  # all that are rare enough, then in order
                    rare = f <= np.partition(f, size - 1)[size - 1]
                    s, f = s[rare], f[rare]
                prefix[i] = _signed(s[np.lexsort((s, f))[:size]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(_signed(digest[0])), pa.array(_signed(digest[1])),
                 *map(pa.array, parity), pa.array(prefix, pa.list_(pa.int64()))],
                ["id", "n", "s1", "s2", *PARITY, "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    made = map_batches(docs, run, f"id {kind}, n bigint, s1 bigint, s2 bigint, "
                                + "".join(f"{c} bigint, " for c in PARITY) + "prefix array<bigint>")
    made = cut(made, "jaccard-prefixes")
    shared.destroy()
    return made


def _digest(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Digest of a set of shingles in two longs."""
    return (hashing.mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64), np.bitwise_xor.reduce(hashing.mix(s)))


def _class_key() -> Column:
    """One long for a set; rows of equal sets, and no others, have the same."""
    return F.xxhash64("n", "s1", "s2")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) with the distinct shingles of each document, in their order as unsigned numbers; id is the set's key."""
    def rows(digests: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch:
        s1, s2 = (_signed(np.array(d, np.uint64)) for d in zip(*digests, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([x.size for x in sets], pa.int64()), pa.array(s1), pa.array(s2),
                                           pa.array(sets, pa.list_(pa.int64()))], ["n", "s1", "s2", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sets, size = [], [], 0
            for _, s in _document_sets(batch, words):
                digests.append(_digest(s))
                sets.append(_signed(s))
                size += s.size
                if size > 1 << 20:
                    yield rows(digests, sets)
                    digests, sets, size = [], [], 0
            if sets:
                yield rows(digests, sets)

    return (map_batches(docs, run, "n bigint, s1 bigint, s2 bigint, shingles array<bigint>")
            .select(_class_key().alias("id"), "shingles"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (x.size + y.size - common)


def _verify(pairs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs``, keys of ``classes`` (id, least), that are linked.

    Only the sets of documents that stand in a pair are made and shuffled: a
    fixed-size filter of the least document of each class tells them apart in
    the scan, and the key of the set those that share its id.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    cell = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << ID_BITS))
    held = classes.join(ids, "id", "left_semi").select(F.col("least").alias("id"))
    wanted = flag_by_bits(rows, set_bits(held.select(cell.alias("c")), "c"), cell, "w").where("w").select("id", "t")
    sets = _sets(wanted, words).join(ids, "id", "left_semi").dropDuplicates(["id"])  # one shuffle, for both joins
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xv, xo = x.values.to_numpy().view(np.uint64), x.offsets.to_numpy()
            yv, yo = y.values.to_numpy().view(np.uint64), y.offsets.to_numpy()
            keep = [linked(xv[xo[i]:xo[i + 1]], yv[yo[i]:yo[i + 1]], percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return map_batches(joined, run, "a bigint, b bigint")


def _components(links: DataFrame) -> DataFrame:
    found = components(links)
    out = cut(found, "jaccard-components")
    uncut(found)
    return out


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; ids are longs.

    Words are runs of other bytes than space and 0x09-0x0D, A-Z as a-z; a set
    is the distinct shingles of ``words`` words, or the whole sequence where
    there are fewer. Two documents link when 100 * intersection >=
    ``percent`` * union; component_id is the least id reachable by links. A
    text without words (or null) has n_shingles 0 and links with nothing. Rows
    repeated with one id each appear and share their component, also if their
    texts differ: each text is compared. An empty table gives no rows. Only id and text are read. A row with a null id has a null
    component and takes part in none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if not isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"{id_col} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    prefixes = _prefixes(rows, words, percent, shingle_counts(rows, words))
    # What is needed to the end is small; the prefixes go as soon as the tokens are dealt out.
    found = cut(prefixes.select("id", "n", "s1", "s2"), "jaccard-rows")
    classes = cut(prefixes.where("n > 0 and id is not null").groupBy("n", "s1", "s2")
                  .agg(F.min(F.struct(F.col("id").alias("least"), *PARITY, "prefix")).alias("r"))
                  .select("n", "s1", "s2", _class_key().alias("id"), "r.*"), "jaccard-classes")
    # Each prefix shingle's classes. A fixed-size filter passes over shingles of one class alone.
    # Where there are two, they are a pair at once; up to SHORT_LIST, all are paired; where there
    # are more, its rows get the classes' parities for the rounds below.
    under = flag_possible_repeats(classes.select("id", "n", F.posexplode("prefix").alias("i", "token")), "token", "maybe",
                                  bits=TOKEN_BITS).where("maybe").drop("maybe")
    place = F.struct("id", F.col("n").cast("int").alias("n"), "i")
    under = cut(under, "jaccard-shared")
    slim = cut(classes.drop("prefix"), "jaccard-slim")
    uncut(prefixes, classes)
    classes = slim
    lists = cut(under.groupBy("token").agg(F.count("*").alias("m"), F.min(place).alias("lo"), F.max(place).alias("hi"))
                .where("m > 1"), "jaccard-lists")
    longer = cut(under.join(lists.where("m > 2").select("token", "m"), "token"), "jaccard-longer")
    uncut(under)
    short = longer.where(f"m <= {SHORT_LIST}").drop("m")
    under = cut(longer.where(f"m > {SHORT_LIST}").drop("m").join(classes.select("id", *PARITY), "id"), "jaccard-tokens")

    def needed(n: Column, m: Column) -> Column:
        return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))  # shared shingles of a linked pair

    def near(n: Column, i: Column, m: Column, j: Column) -> Column:
        return ((F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))  # length filter
                & (F.least(n - i, m - j) >= needed(n, m)))  # positional filter

    odd = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "_"))) for c in PARITY), F.lit(0))
    alike = odd <= F.col("n") + F.col("n_") - 2 * needed(F.col("n"), F.col("n_"))  # suffix filter

    def met(left: DataFrame, right: DataFrame, apart: Column) -> DataFrame:
        right = right.select("token", *[F.col(c).alias(c + "_") for c in right.columns if c != "token"])
        reach = near(F.col("n"), F.col("i"), F.col("n_"), F.col("i_")) & alike
        return left.join(right, (left["token"] == right["token"]) & apart & reach)

    ends = [F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")]

    def pairs_of(left: DataFrame, right: DataFrame, apart: Column) -> DataFrame:
        return met(left, right, apart).select(*ends).distinct()

    def best_pivots(rows: DataFrame, pivots: DataFrame, tried: DataFrame | None) -> DataFrame:
        """Each class with the untried pivots that it shares most prefix shingles with, PIVOTS_A_CLASS of them."""
        shared = met(rows, pivots, F.col("c") != F.col("c_")).groupBy("id", "id_").agg(F.count("*").alias("m"))
        if tried is not None:
            shared = shared.select("id", "id_", "m", *ends).join(tried, ["a", "b"], "left_anti")
        first = F.slice(F.sort_array(F.collect_list(F.struct("m", F.xxhash64("id_").alias("h"), "id_")), asc=False), 1, PIVOTS_A_CLASS)
        chosen = shared.groupBy("id").agg(first.alias("p")).select("id", F.explode("p").alias("p")).select("id", F.col("p.id_").alias("id_"))
        return chosen.select(*ends).distinct()

    lo, hi = F.col("lo"), F.col("hi")
    twos = (lists.where("m = 2").where(near(lo["n"], lo["i"], hi["n"], hi["i"]))
            .select(lo["id"].alias("a"), hi["id"].alias("b")).distinct())
    of_a = classes.select(F.col("id").alias("a"), "n", *PARITY)
    of_b = classes.select(F.col("id").alias("b"), *[F.col(c).alias(c + "_") for c in ("n", *PARITY)])
    other = short.select("token", *[F.col(c).alias(c + "_") for c in ("id", "n", "i")])
    few = short.join(other, (short["token"] == other["token"]) & (F.col("id") < F.col("id_"))
                     & near(F.col("n"), F.col("i"), F.col("n_"), F.col("i_")))
    twos = twos.unionByName(few.select(F.col("id").alias("a"), F.col("id_").alias("b"))).distinct()
    twos = twos.join(of_a, "a").join(of_b, "b").where(alike).select("a", "b")
    open_, tried, links, component = under.withColumn("c", F.col("id")), None, None, None
    for step in range(PIVOT_ROUNDS + 1):
        if step < PIVOT_ROUNDS:  # with the smallest set and two others of each shingle, others in each round
            turn = F.struct(F.xxhash64(F.lit(step), "id").alias("h"), "id")
            least = F.min(F.struct("n", "id"))["id"] if step == 0 else F.min(F.struct("c", "id"))["id"]
            chosen = (open_.groupBy("token").agg(F.array_distinct(F.array(least, F.min(turn)["id"], F.max(turn)["id"])).alias("id"))
                      .select("token", F.explode("id").alias("id")))
            pairs = best_pivots(open_, open_.join(chosen, ["token", "id"], "left_semi"), tried)
            pairs = pairs.unionByName(twos).distinct() if step == 0 else pairs
        else:  # all that are still apart
            pairs = pairs_of(open_, open_, (F.col("id") < F.col("id_")) & (F.col("c") != F.col("c_")))
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs, "jaccard-pairs")
        if step == 0:
            uncut(lists, longer)
        elif step == PIVOT_ROUNDS:
            uncut(open_)
        good = cut(_verify(pairs, rows, classes, words, percent), "jaccard-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = good if links is None else links.unionByName(good)
        if component is not None:
            uncut(component)
        component = _components(links)
        if step < PIVOT_ROUNDS:
            named = (under.join(component.withColumnRenamed("component", "c"), "id", "left")
                     .withColumn("c", F.coalesce("c", "id")))
            spread = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
            before, open_ = open_, cut(named.join(spread.select("token"), "token", "left_semi"), "jaccard-open")
            if step:
                uncut(before)
    uncut(under, tried)
    some = found.where("n > 0 and id is not null")
    # Sets of one id are one component. Each one's component is named by the least id of its rows.
    keyed = some.select("id", _class_key().alias("k"))
    shared = (keyed.groupBy("id").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a < z").select("id", "a")
              .join(keyed, "id").where("a != k").select("a", F.col("k").alias("b")).distinct())
    shared = cut(shared, "jaccard-one-id")
    if not shared.isEmpty():
        component = _components(links.unionByName(shared))
    of_class = classes.select("n", "s1", "s2", "id", "least")
    of_class = of_class.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(named, "component").select(
        F.col("n").alias("cn"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), "component_id")
    joined = some.join(of_class, (F.col("n") == F.col("cn")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
    none = found.where("n = 0 or id is null").withColumn("component_id", F.col("id"))
    return (joined.select("id", "n", "component_id").unionByName(none.select("id", "n", "component_id"))
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"))
