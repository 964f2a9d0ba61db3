"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every benchmark item has a 64-bit SimHash over its word shingles, weighted by
how often each occurs. A document's windows of the item's length get theirs
from running sums. As one shingle that is repeated would dominate it, items and
windows with such have a second one over their distinct shingles, and are
candidates by either. The 64 bits are cut into 4 blocks of 16; two fingerprints
within ``radius`` bits differ by at most radius // 4 bits in some block, so an
index from every block value within that of an item's block to the item finds
all items within the radius of a window. Candidates are verified by exact
weighted-shingle similarity: the sum of the smaller counts of each shingle over
the sum of the larger.

A window that shares no shingle with any item has similarity 0 with all, so its
fingerprint is not made. Texts never shuffle: items are the stated query set
and go to the tasks in blocks of bounded number, each block over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewatch.llm import hashing
from duewatch.llm.shared import cut, keep_without, map_batches

BLOCKS, BLOCK_BITS = 4, 16
RADIUS = 19
ITEMS_A_PASS = 1000
STARTS_A_CHUNK = 1 << 14
_BITS = np.arange(64, dtype=np.uint64)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums, one row more than hashes, of +1 and -1 for each bit."""
    votes = ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    out = np.zeros((hashes.size + 1, 64), np.int32)
    np.cumsum(votes, axis=0, out=out[1:])
    return out


def _distinct_sums(sh: np.ndarray, m: int) -> np.ndarray | None:
    """Sums of the bits of each window of ``m`` shingles, each distinct one once; None if no window has one twice."""
    order = np.argsort(sh, kind="stable")
    same = sh[order][1:] == sh[order][:-1]
    before, after = order[:-1][same], order[1:][same]
    if not (after - before < m).any():
        return None
    last, following = np.full(sh.size, -1), np.full(sh.size, 2 * sh.size)
    last[after], following[before] = before, after
    votes = ((sh[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    at = np.arange(sh.size - m)  # from this window to the next: what is new in it comes, what isn't in it any more goes
    out = np.empty((at.size + 1, 64), np.int32)
    out[0] = votes[:m][last[:m] < 0].sum(0)
    out[1:] = votes[m:] * (last[m:] <= at)[:, None] - votes[:at.size] * (following[:at.size] >= at + m)[:, None]
    return np.cumsum(out, axis=0, out=out)


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def near_values(radius: int) -> np.ndarray:
    """All 16-bit masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(BLOCK_BITS), n)],
                    np.int64)


class ItemIndex:
    """Fingerprints, shingle counts and the multi-index of a block of items."""

    def __init__(self, items: pa.Table, words: int, radius: int):
        self.radius = radius
        self.length, self.shingles, self.counts, kept, prints, once = [], [], [], [], [], []
        for at, text in enumerate(items.column(1).to_pylist()):
            data, offsets = hashing.string_buffers(pa.array([text], pa.string()))
            hashes, row = hashing.words(data, offsets, 0, 1, hashing.PUNCTUATION)
            if not hashes.size:
                continue
            sh, _ = hashing.shingles(hashes, row, words)
            distinct, n = np.unique(sh, return_counts=True)
            kept.append(at)
            self.length.append(hashes.size)
            self.shingles.append(distinct)
            self.counts.append(n)
            prints.append(_fingerprints(_bit_sums(sh)[-1:])[0])
            if distinct.size < sh.size:
                once.append((len(kept) - 1, _fingerprints(_bit_sums(distinct)[-1:])[0]))
        self.ids = items.column(0).combine_chunks().take(pa.array(kept, pa.int64()))
        self.length = np.array(self.length, np.int64)
        self.prints = np.array(prints + [f for _, f in once], np.uint64)
        self.item = np.array([*range(len(prints)), *(i for i, _ in once)], np.int64)  # of each fingerprint
        masks = near_values(min(radius // BLOCKS, BLOCK_BITS))
        self.first, self.listed = [], []
        for b in range(BLOCKS):
            value = ((self.prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            keys = (value[:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            self.listed.append(np.repeat(np.arange(self.prints.size, dtype=np.int32), masks.size)[order])
            self.first.append(np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1)))
        #: By shingle size: the items' shingles, a table of their leading bits, and the lengths of the items.
        self.by_size = {}
        for k in sorted({min(words, n) for n in self.length.tolist()}):
            of = [i for i, n in enumerate(self.length) if min(words, n) == k]
            known = np.unique(np.concatenate([self.shingles[i] for i in of]))
            leading = np.zeros(1 << 20, bool)
            leading[known >> np.uint64(44)] = True
            self.by_size[k] = (known, leading, sorted({int(self.length[i]) for i in of}))

    def candidates(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of items of that length within the radius, from the block index."""
        found = []
        for b in range(BLOCKS):
            value = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            lo, hi = self.first[b][value], self.first[b][value + 1]
            n = hi - lo
            window = np.repeat(np.arange(prints.size), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            item = self.listed[b][at]
            same = self.length[self.item[item]] == length
            found.append(window[same] * self.prints.size + item[same])
        both = np.unique(np.concatenate(found))
        window, item = both // self.prints.size, both % self.prints.size
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
        return window[near], self.item[item[near]]

    def similarity(self, window: np.ndarray, item: int) -> float:
        distinct, n = np.unique(window, return_counts=True)
        _, x, y = np.intersect1d(distinct, self.shingles[item], assume_unique=True, return_indices=True)
        common = int(np.minimum(n[x], self.counts[item][y]).sum())
        return common / (window.size + int(self.counts[item].sum()) - common)


def _text_hits(sh: np.ndarray, anchor: np.ndarray, k: int, lengths: list[int], index: ItemIndex, least: float,
               best: dict[int, tuple[float, int]]) -> None:
    """Put into ``best`` the (similarity, first word) of each item that a window of one text holds."""
    seen = np.concatenate(([0], np.cumsum(anchor)))
    for length in lengths:
        m = min(length - k + 1, sh.size)  # a text shorter than the item is one window
        starts = np.flatnonzero(seen[m:] > seen[:seen.size - m])
        while starts.size:
            lo = int(starts[0])
            now = starts[:np.searchsorted(starts, lo + STARTS_A_CHUNK)]
            starts = starts[now.size:]
            sums = _bit_sums(sh[lo:int(now[-1]) + m])
            prints = _fingerprints(sums[now - lo + m] - sums[now - lo])
            found = list(zip(*index.candidates(prints, length), strict=True))
            once = _distinct_sums(sh[lo:int(now[-1]) + m], m)
            if once is not None:
                found += zip(*index.candidates(_fingerprints(once[now - lo]), length), strict=True)
            for w, i in sorted(set(found)):
                s = int(now[w])
                got = index.similarity(sh[s:s + m], int(i))
                if got >= least and (int(i) not in best or (got, -s) > (best[int(i)][0], -best[int(i)][1])):
                    best[int(i)] = (got, s)


def _hits(docs: DataFrame, index: ItemIndex, words: int, least: float, item_type: str) -> DataFrame:
    """Hits of one block of items; a map over ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, offsets = hashing.string_buffers(batch.column(1))
            at, out = [], []
            for a, b in hashing.document_groups(offsets):
                hashes, row = hashing.words(data, offsets, a, b, hashing.PUNCTUATION)
                best: dict[int, dict[int, tuple[float, int]]] = {}
                for k, (known, leading, lengths) in index.by_size.items():
                    sh, of = hashing.shingles(hashes, row, k)
                    maybe = np.flatnonzero(leading[sh >> np.uint64(44)])
                    place = np.minimum(np.searchsorted(known, sh[maybe]), known.size - 1)
                    anchors = maybe[known[place] == sh[maybe]]
                    for r in np.unique(of[anchors]):
                        lo, hi = np.searchsorted(of, (r, r + 1))
                        mark = np.zeros(hi - lo, np.int64)
                        mark[anchors[(anchors >= lo) & (anchors < hi)] - lo] = 1
                        _text_hits(sh[lo:hi], mark, k, lengths, index, least, best.setdefault(int(r), {}))
                for r, items in best.items():
                    for i, (got, s) in sorted(items.items()):
                        at.append(a + r)
                        out.append((i, got, s, min(int(index.length[i]), int((row == r).sum()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), index.ids.take(pa.array([o[0] for o in out], pa.int64())),
                 pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int64()),
                 pa.array([o[3] for o in out], pa.int64())],
                ["id", "item_id", "similarity", "first_word", "n_words"])

    return map_batches(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, item_id {item_type}, "
                                "similarity double, first_word bigint, n_words bigint")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", words: int = 5, least: float = 0.8,
                   radius: int = RADIUS, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(id, item, similarity, first_word, n_words): each item that a document holds, at its best window.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z.
    Items of fewer than ``words`` words are one shingle. Null and empty texts
    and items without words have no hits; repeated rows each have theirs; ties
    go to the first window; an empty table gives no rows; other columns are not
    read. Windows cover whole texts, a bounded number at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t"))
    passes = max(1, -(-items.count() // items_a_pass))
    out = None
    for p in range(passes):
        mine = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(passes)) == p).orderBy("item", "t").toArrow()
        hits = _hits(rows, ItemIndex(mine, words, radius), words, least, items.schema["item"].dataType.simpleString())
        out = hits if out is None else out.unionByName(hits)
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "similarity", "first_word", "n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns are kept. Null ids stay."""
    hits = cut(benchmark_hits(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), "leaked-ids")
    return keep_without(docs, hits, id_col)
