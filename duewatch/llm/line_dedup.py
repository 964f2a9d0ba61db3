"""Line dedup by a segment-partition edit join.

Lines are trimmed, with A-Z as a-z; lengths and edits count UTF-8 bytes. Lines
of equal text collapse first. Two lines are near within ``tau`` edits, and from
LONG_BYTES on within a twentieth of the longer one's bytes.

A line of length L is cut into one segment more than the edits it allows; a
line within them has at least one of the segments as a substring, at a place
that the edits left and right of it allow. So each line puts its segments, with
L and their number, into an index, and probes it for every length from its own
down to tau less with its substrings at those places only. Long lines allow too
many edits to try each length and place: there the index has the first bytes of
each segment, as many as the least segment of a range of lengths has, with the
ranges of its places from the line's start and from its end, and a line probes
with all its substrings of that size for longer lines, at the ranges that the
edits can reach: some segment that a near line has whole has no more edits to its
left than segments, and none more to its right, so that the place from either end
shifts by a twentieth at most. Both ways every near pair meets. Candidates are
verified by furthest-reaching diagonals, then by banded bit-parallel edit distance.

Each distinct line is written once. Keys are tested against filters of fixed size
before they shuffle: probes against that of the index, and the index against that
of the probes left and of the keys that occur in it twice. Lines are taken in
classes of lengths that a filter suffices for, one class after the other, each
from its keys to its links, so that no more than a class's keys, pairs and texts
stand on the disks at a time. As in any family of near copies links are many but
few are needed, each key's lines are first joined with one of them, and then, where
a key has more than two, only lines of different components. Lengths, places and
parities of their byte pairs and of their substrings of SKETCH bytes, as many bits as a
line has bytes, tell most pairs apart before their texts are put beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewatch.llm import hashing
from duewatch.llm.components import components
from duewatch.llm.shared import cut, map_batches, set_bits, uncut

TAU = 2
LEAST_BYTES = 20
LONG_BYTES = 80
SHARE = 20  # a long line allows an edit for so many bytes
GRAM = 16  # at most the shortest segment of a long line
WORD_BITS = 23  # words of 64 bits in a filter: 64 MB
PART_BITS = 17  # of them in a part
PRINT_BITS = 15
BIT_READS = 16  # partitions in which a filter comes to the driver
CLASS_KEYS = 24 << 20  # segments of lines that a filter is for
RANGES_A_FOLDER = 8
FEW = 64  # edits up to which a distance is sought by diagonals
WIDE = 256  # edits up to which pairs are compared together
CELLS_A_GROUP = 1 << 18
CELLS_A_FLUSH = 1 << 22
LINE_BITS = 23
PAIR_LONGS = 4
PAIRS = [f"q{k}" for k in range(PAIR_LONGS)]
SKETCH = 4
MET = "key bigint, h bigint, n int, place int, probe boolean, pivot_h bigint, pivot_n int, pivot_place int, many boolean"
#: While a table is written: shuffle files go at its end, and pages are smaller.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def _kept(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """The table that :func:`cut` writes of ``df``, of which nothing else is made."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        return cut(df, label, *folders)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _diagonals(x: bytes, y: bytes, most: int, few: int) -> int:
    """Edit distance of ``x`` and the no longer ``y`` if at most ``few``, else few + 1; ``most`` bounds the diagonals.

    Of each diagonal that can still end within ``most`` edits, the furthest place
    that so many edits reach is kept.
    """
    m, n = len(x), len(y)
    end, reached = m - n, {0: -1}
    for e in range(few + 1):
        before, reached = reached, {}
        for d in range(max(-e, end - (most - e), -n), min(e, end + most - e) + 1):
            i = max(before.get(d, -2) + 1, before.get(d - 1, -2) + 1, before.get(d + 1, -2))
            last = min(m, n + d)
            i = min(i, last)
            if i < last and i >= 0 and i >= d and x[i] == y[i - d]:
                step = 1
                while i + step <= last and x[i:i + step] == y[i - d:i - d + step]:
                    i += step
                    step *= 2
                while step > 1:
                    step //= 2
                    if i + step <= last and x[i:i + step] == y[i - d:i - d + step]:
                        i += step
            if d == end and i == m:
                return e
            reached[d] = i
    return few + 1


def banded_distance(x: bytes, y: bytes, most: int) -> int:
    """Edit distance of ``x`` and ``y`` if at most ``most``, else most + 1.

    Up to FEW edits are sought by diagonals. For more, common ends are cut off;
    the band of 2 * most + 1 cells around the diagonal is held as bits of the
    vertical differences and moves down a row with each column; the distance is
    read along the band's lower edge, then along the last row.
    """
    if len(x) < len(y):
        x, y = y, x
    m, n = len(x), len(y)
    if m - n > most:
        return most + 1
    few = _diagonals(x, y, most, min(most, FEW))
    if few <= FEW or most <= FEW:
        return few
    a = 0
    while a < n and x[a] == y[a]:
        a += 1
    b = 0
    while b < n - a and x[m - 1 - b] == y[n - 1 - b]:
        b += 1
    x, y = x[a:m - b], y[a:n - b]
    m, n = len(x), len(y)
    if n == 0:
        return m if m <= most else most + 1
    k = min(most, m)
    width = 2 * k + 1
    full = (1 << width) - 1
    edge = 1 << (width - 1)
    at: dict[int, int] = {}  # of each byte: its places in x, moved by k so that no shift is negative
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << (i + k)
    vp, vn = (full >> k) << k, 0
    distance = k
    last = edge
    for j, c in enumerate(y):
        eq = (at.get(c, 0) >> j) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (~(d0 | vp) & full)
        hn = d0 & vp
        if j < m - k:
            distance += not d0 & edge
        else:
            last >>= 1
            distance += bool(hp & last) - bool(hn & last)
        down = d0 >> 1
        vp = hn | (~(down | hp) & full)
        vn = down & hp
    return min(distance, most + 1)


def _within(data: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the texts of ``m`` bytes from ``x`` on are within ``most`` edits of the ``n`` bytes from ``y`` on, pair by pair, as :func:`_diagonals`.

    0 <= m - n <= most <= n; ``data`` has 8 bytes more behind the last text."""
    words = np.ndarray((data.size - 7,), "<u8", data, 0, (1,))
    out = np.zeros(m.size, bool)
    rows, end, k = np.arange(m.size), m - n, int(most.max(initial=0))
    reached = np.full((m.size, 2 * k + 3), -9)
    reached[:, k + 1] = -1
    for e in range(k + 1):
        if not rows.size:
            break
        lo, hi = k + 1 - e, k + 2 + e
        d = np.arange(-e, e + 1)
        last = np.minimum(m[:, None], n[:, None] + d)
        best = np.maximum(np.maximum(reached[:, lo:hi], reached[:, lo - 1:hi - 1]) + 1, reached[:, lo + 1:hi + 1])
        r, c = np.nonzero(np.abs(end[:, None] - d) <= (most - e)[:, None])
        i = np.minimum(best, last)[r, c]
        left, at_x, at_y = last[r, c] - i, x[r] + i, y[r] + i - d[c]
        more = np.flatnonzero(left > 0)
        while more.size:
            other = words[at_x[more]] ^ words[at_y[more]]
            same = np.minimum(np.bitwise_count((other & (~other + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3, left[more])
            for place, step in ((i, same), (at_x, same), (at_y, same), (left, -same)):
                place[more] += step
            more = more[(same == 8) & (left[more] > 0)]
        reached[:, lo:hi] = -9
        reached[r, lo + c] = i
        stay = most > e
        found = r[(d[c] == end[r]) & (i == m[r])]
        out[rows[found]] = True
        stay[found] = False
        if not stay.all():
            reached, rows, x, m, y, n, most, end = (v[stay] for v in (reached, rows, x, m, y, n, most, end))
    return out


def near_pairs(xs: pa.Array, ys: pa.Array, tau: int) -> np.ndarray:
    """Whether the lines of each pair are near."""
    (a, x), (b, y) = hashing.string_buffers(xs), hashing.string_buffers(ys)
    data = np.concatenate((a, b, np.zeros(8, np.uint8)))
    start, size = np.stack((x[:-1], y[:-1] + a.size)), np.stack((np.diff(x), np.diff(y)))
    swap = size[0] < size[1]
    start[:, swap], size[:, swap] = start[::-1, swap], size[::-1, swap]
    most = np.where(size[0] >= long_from(tau), size[0] // SHARE, tau)
    out = np.zeros(most.size, bool)
    some = np.flatnonzero(size[0] - size[1] <= most)
    together = some[(most[some] <= WIDE) & (most[some] <= size[1, some])]
    order = together[np.argsort(most[together], kind="stable")]
    done = 0
    while done < order.size:
        cells = np.arange(1, order.size - done + 1) * (2 * most[order[done:]] + 3)
        few = order[done:done + max(1, int(np.searchsorted(cells, CELLS_A_GROUP, "right")))]
        out[few] = _within(data, start[0, few], size[0, few], start[1, few], size[1, few], most[few])
        done += few.size
    for k in np.setdiff1d(some, together):
        p, q = (data[start[j, k]:start[j, k] + size[j, k]].tobytes() for j in (0, 1))
        out[k] = banded_distance(p, q, int(most[k])) <= most[k]
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, rows, bytes, row bounds, lines before) of groups of texts; a long text comes in pieces of whole lines."""
    for a, b in hashing.document_groups(offsets):
        chunk = data[offsets[a]:offsets[b]]
        if b - a > 1 or chunk.size <= hashing.WINDOW:
            yield a, b - a, chunk, offsets[a:b + 1] - offsets[a], 0
            continue
        before = 0
        for s, e in hashing.window_ends(chunk == 10):
            yield a, 1, chunk[s:e], np.array([0, e - s]), before
            before += int(np.count_nonzero(chunk[s:e] == 10))


def _lines(chunk: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row, number in the row) of the trimmed lines that are not blank."""
    starts, ends, _ = hashing.word_spans(chunk, bounds)
    if not starts.size:
        none = np.empty(0, np.int64)
        return none, none, none, none
    breaks = np.flatnonzero(chunk == 10)
    row = np.searchsorted(bounds, starts, "right") - 1
    line = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[first[1:], starts.size] - 1
    row, line = row[first], line[first]
    return starts[first], ends[last], row, line - np.searchsorted(breaks, bounds[row])


def _segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of segment ``i`` of lines of ``length``; the longer segments are the last."""
    base, more = length // (tau + 1), length % (tau + 1)
    return i * base + np.maximum(0, i - (tau + 1 - more)), base + (i >= tau + 1 - more)


def _key(sums: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return hashing.mix(hashing.span_hash(sums, at, at + size) ^ hashing.mix((length * 16 + i).astype(np.uint64)))


def long_from(tau: int) -> int:
    """The length from which lines allow a SHAREth of their bytes, which is more than ``tau``."""
    return max(LONG_BYTES, (tau + 1) * SHARE)


def edits(length: int, tau: int) -> int:
    """Edits that a pair whose longer line has ``length`` bytes allows."""
    return length // SHARE if length >= long_from(tau) else tau


def index_keys(sums: np.ndarray, starts: np.ndarray, length: np.ndarray, tau: int) -> Iterator[np.ndarray]:
    for i in range(tau + 1):
        at, size = _segment(length, i, tau)
        yield _key(sums, starts + at, size, length, i)


def probe_keys(sums: np.ndarray, starts: np.ndarray, length: np.ndarray, tau: int,
               least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, line) of every substring that may be a segment of a line as long or up to ``tau`` shorter.

    The substrings that are the line's own segments are left out: as index
    keys they meet each other.
    """
    for less in range(tau + 1):
        other = length - less
        for i in range(tau + 1):
            at, size = _segment(other, i, tau)
            for d in range(max(-i, less - (tau - i)), min(i, less + tau - i) + 1):
                if less == 0 and d == 0:
                    continue
                fits = np.flatnonzero((other >= least) & (at + d >= 0) & (at + d + size <= length))
                yield _key(sums, starts[fits] + at[fits] + d, size[fits], other[fits], i), fits


def _length_ranges() -> np.ndarray:
    """Where ranges of lengths begin: a line and another a SHAREth shorter are in one or in neighbours."""
    out = [1]
    while out[-1] < 1 << 32:
        out.append(out[-1] + out[-1] // (SHARE - 1) + 1)
    return np.array(out, np.int64)


_RANGES = _length_ranges()
_REACH = np.r_[(_RANGES[1:] - 1) // SHARE, 0]  # edits that a line of the range allows at most


def _gram_sizes() -> np.ndarray:
    """The least segment of the long lines of each range and of all longer ones."""
    lo = np.maximum(_RANGES[:-1], LONG_BYTES)
    tens = -(-lo // SHARE) * SHARE  # segments are shortest where an edit more is allowed
    least = lambda n: n // (n // SHARE + 1)
    sizes = np.where(tens < _RANGES[1:], np.minimum(least(lo), least(tens)), least(lo))
    return np.r_[np.minimum.accumulate(sizes[::-1])[::-1], sizes[-1]]


_SIZES = _gram_sizes()


_SMALL = np.searchsorted(_RANGES, np.arange(1 << 16), "right") - 1


def range_of(length: np.ndarray) -> np.ndarray:
    if length.size and length.max() < _SMALL.size:
        return _SMALL[length]
    return np.searchsorted(_RANGES, length, "right") - 1


def gram_hashes(sums: np.ndarray, size: int, start: int, end: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place of ``start``:``end`` on."""
    up, _ = hashing.powers(sums.size)
    out = sums[start + size:end + size] - sums[start:end]
    out *= up[start:end]
    out += np.uint64(size)
    return hashing.mix(out)


def _gram_key(gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a gram in ranges of places from the line's start and from its end."""
    return hashing.mix(gram ^ hashing.mix((left << 32 | right + 1).astype(np.uint64)))


def gram_index(sums: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram, key, line, place) of the first bytes of each segment of long lines, as many as their range's least segment has."""
    pieces = length // SHARE + 1
    line = np.repeat(np.arange(starts.size), pieces)
    i = np.arange(line.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place, _ = _segment(length[line], i, (pieces - 1)[line])
    at, size = starts[line] + place, _SIZES[range_of(length)][line]
    up, _ = hashing.powers(sums.size)
    gram = hashing.mix((sums[at + size] - sums[at]) * up[at] + size.astype(np.uint64))
    return gram, _gram_key(gram, range_of(place + 1), range_of(length[line] - place + 1)), line, place


def gram_probes(sums: np.ndarray, starts: np.ndarray, length: np.ndarray, held: np.ndarray,
                least: int, spans: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """(key, line, place) of every substring that may be in the index of a line as long or longer.

    ``starts`` and ``length`` are in order. ``held`` has the grams and the keys of
    the index, whose lines have ``least`` bytes or more and ranges of lengths in
    ``spans``. Segment i of a line that allows k edits is met if i edits at most
    are to its left and k - i to its right; as no segment is shorter than a gram,
    its places p and r from the line's start and end bound them by p // size and
    r // size - 1.
    """
    keys, lines, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    own = range_of(length)
    wanted = [(own + more, (own + more >= spans[0]) & (own + more < spans[1]) & (_RANGES[own + more + 1] > least)) for more in (0, 1)]
    for size in map(int, np.unique(np.concatenate([_SIZES[span[some]] for span, some in wanted]))):
        tried = reduce(np.logical_or, [some & (_SIZES[span] == size) for span, some in wanted])
        some = np.flatnonzero(tried)
        start, end = starts[some[0]], starts[some[-1]] + length[some[-1]] - size + 1
        if end <= start:
            continue
        grams = gram_hashes(sums, size, start, end)
        at = np.flatnonzero(_has(held, grams))
        gram, at = grams[at], at + start
        line = np.searchsorted(starts, at, "right") - 1
        place = at - starts[line]
        fits = np.flatnonzero(tried[line] & (place + size <= length[line]))
        gram, line, place = gram[fits], line[fits], place[fits]
        n, right = length[line], length[line] - place
        left_lo, left_hi = range_of(-(-place * size // (size + 1)) + 1), range_of(place * size // (size - 1) + 1)
        right_lo, right_hi = range_of(-(-(right + 1) * size // (size + 1)) + 1), range_of((right - 1) * size // (size - 1) + 1)
        for p in range(int((left_hi - left_lo).max(initial=-1)) + 1):
            for r in range(int((right_hi - right_lo).max(initial=-1)) + 1):
                a, b = left_lo + p, right_lo + r
                fits = np.flatnonzero((a <= left_hi) & (b <= right_hi) & (_RANGES[a + 1] + _RANGES[b + 1] - 4 >= n)
                                      & (_RANGES[a] + _RANGES[b] - 2 <= n * SHARE // (SHARE - 1)))
                key = _gram_key(gram[fits], a[fits], b[fits])
                hit = _has(held, key)
                keys.append(key[hit])
                lines.append(line[fits][hit])
                places.append(place[fits][hit])
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(places)


def _masks() -> np.ndarray:
    """Four of a word's bits for each of 2**PRINT_BITS prints."""
    bits = np.random.Generator(np.random.PCG64(20240602)).integers(0, 64, (4, 1 << PRINT_BITS), dtype=np.uint64)
    return np.bitwise_or.reduce(np.uint64(1) << bits)


_MASKS = _masks()


def _print(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(WORD_BITS)) & np.uint64((1 << PRINT_BITS) - 1)


def _has(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    mask = _MASKS[_print(key)]
    return words[key & np.uint64((1 << WORD_BITS) - 1)] & mask == mask


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _line_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashing.mix(hashing.span_hash(sums, starts, ends) + np.uint64(1))


def _occurrences(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.string_buffers(batch.column(1))
            for a, _, chunk, bounds, before in _pieces(data, offsets):
                starts, ends, row, number = _lines(chunk, bounds)
                h = _line_hash(hashing.prefix_sums(chunk), starts, ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + a)), pa.array((number + before).astype(np.int32)), _signed(h)],
                    ["id", "line", "h"])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, line int, h bigint")


def _code(ids: np.ndarray, line: np.ndarray, h: np.ndarray) -> np.ndarray:
    return hashing.mix(ids ^ hashing.mix(h + line.astype(np.uint64)))


def _first_lines(rows: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """(h, n, t, r) of the distinct lines of ``least`` bytes or more, in folders of lengths; a written table.

    A fixed filter of the lines' first places tells them; where it errs, or
    rows are repeated, a line comes twice.
    """
    first = _key_bits(_cells(firsts.select(F.xxhash64("first.id").alias("i"), "first.line", "h"), lambda batch: [_code(
        batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))]), "line-firsts")
    shared = _shared_bits((first, "once"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] = lower[97:123]
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            data, offsets = hashing.string_buffers(batch.column(1))
            for a, _, chunk, bounds, before in _pieces(data, offsets):
                starts, ends, row, number = _lines(chunk, bounds)
                h = _line_hash(hashing.prefix_sums(chunk), starts, ends)
                some = np.flatnonzero((ends - starts >= least) & _has(held, _code(ids[a + row], number + before, h)))
                some = some[np.sort(np.unique(h[some], return_index=True)[1])]
                length, chunk = (ends - starts)[some], lower[chunk]
                yield pa.RecordBatch.from_arrays(
                    [_signed(h[some]), pa.array(length), pa.array([chunk[i:j].tobytes() for i, j in zip(starts[some], ends[some], strict=True)], pa.binary()),
                     pa.array(range_of(length).astype(np.int32))], ["h", "n", "t", "r"])

    found = map_batches(rows.select(F.xxhash64("id").alias("i"), "t"), run, "h bigint, n bigint, t binary, r int")
    out = _kept(found.withColumn("folder", F.expr(f"r div {RANGES_A_FOLDER}").cast("int")), "line-distinct", "folder")
    shared.destroy()
    uncut(first)
    return out


def _classes(lines: DataFrame, tau: int) -> list[tuple[int, int]]:
    """Intervals of ranges of lengths whose lines have CLASS_KEYS segments at most, where ranges can be parted; short lines are in the first."""
    least = int(range_of(np.array([long_from(tau)]))[0])
    ends, size = [0], 0
    for r, keys in sorted(tuple(x) for x in lines.groupBy("r").agg(F.sum(F.expr(f"n div {SHARE} + 1"))).collect()):
        if r > least and size and size + keys > CLASS_KEYS:
            ends.append(r)
            size = 0
        size += keys
    return list(zip(ends, [*ends[1:], _RANGES.size], strict=True))


def _between(lines: DataFrame, lo: int, hi: int) -> DataFrame:
    """Lines of ranges from ``lo`` on and below ``hi``; other folders aren't read."""
    return lines.where(F.col("folder").between(lo // RANGES_A_FOLDER, (hi - 1) // RANGES_A_FOLDER) & F.col("r").between(lo, hi - 1)).select("h", "n", "t")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(running sums, hash, start, length) of the lines of ``batch`` (h, n, t), by length."""
    batch = batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))
    data, offsets = hashing.string_buffers(batch.column(2))
    h = batch.column(0).to_numpy().view(np.uint64)
    for a, b in hashing.document_groups(offsets):
        starts = offsets[a:b] - offsets[a]
        yield hashing.prefix_sums(data[offsets[a]:offsets[b]]), h[a:b], starts, np.diff(offsets[a:b + 1])


def _once(key: np.ndarray, line: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key of a line once; place is -1 if it has several."""
    code = key ^ hashing.mix(line.astype(np.uint64) + np.uint64(1))
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.r_[np.ones(min(code.size, 1), bool), code[1:] != code[:-1]])
    if not first.size:
        return key, line, place
    lo, hi = np.minimum.reduceat(place[order], first), np.maximum.reduceat(place[order], first)
    return key[order[first]], line[order[first]], np.where(lo == hi, lo, -1)


def _index_rows(sums: np.ndarray, starts: np.ndarray, length: np.ndarray, tau: int) -> tuple[np.ndarray, ...]:
    """(grams, key, line, place) of the whole index; place is 0 where keys have their place already."""
    short, long = np.flatnonzero(length < long_from(tau)), np.flatnonzero(length >= long_from(tau))
    keys = list(index_keys(sums, starts[short], length[short], tau))
    gram, key, line, place = gram_index(sums, starts[long], length[long])
    return gram, *_once(np.concatenate([*keys, key]), np.concatenate([np.tile(short, tau + 1), long[line]]),
                        np.concatenate([np.zeros(short.size * (tau + 1), np.int64), place]))


def _key_bits(cells: DataFrame, label: str = "line-bits") -> DataFrame:
    """Filters of 2**WORD_BITS words (64 MB), whatever the input, of four bits a key in one word: of ``cells`` (part, cells), and of those in it twice.

    A written table (part, once, twice) of one row for each part, made in tasks."""
    def packed(cells: np.ndarray) -> bytes:
        out = np.zeros(1 << PART_BITS, np.uint64)
        word = cells >> np.uint32(PRINT_BITS)
        first = np.flatnonzero(np.r_[np.ones(min(word.size, 1), bool), word[1:] != word[:-1]])
        if first.size:
            out[word[first]] = np.bitwise_or.reduceat(_MASKS[cells & np.uint32((1 << PRINT_BITS) - 1)], first)
        return out.tobytes()

    def row(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed(cells)], pa.binary()),
                                           pa.array([packed(cells[1:][cells[1:] == cells[:-1]])], pa.binary())], ["part", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and part != now:
                    yield row(now, held)
                    held = []
                now = part
                held.append(np.frombuffer(raw.as_buffer(), np.uint32))
        if held:
            yield row(now, held)

    parts = 1 << (WORD_BITS - PART_BITS)
    return _kept(map_batches(cells.repartition(parts, "part").sortWithinPartitions("part"), run, "part int, once binary, twice binary"), label)


def _shared_bits(*sets: tuple[DataFrame, str]):
    """Broadcast of the OR of filters (table of :func:`_key_bits`, column); the driver holds one, a part at a time comes in."""
    out = np.zeros((1 << (WORD_BITS - PART_BITS), 1 << PART_BITS), np.uint64)
    for table, column in sets:
        for row in table.select("part", column).coalesce(BIT_READS).toLocalIterator(prefetchPartitions=True):
            out[row[0]] |= np.frombuffer(row[1], np.uint64)
    return sets[0][0].sparkSession.sparkContext.broadcast(out.reshape(-1))


def _cells(rows: DataFrame, found) -> DataFrame:
    """(part, cells: word and print) of the keys that ``found`` yields for each batch of ``rows``."""
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        cells = np.sort((keys & np.uint64((1 << WORD_BITS) - 1)) << np.uint64(PRINT_BITS) | _print(keys))
        ends = np.searchsorted(cells, np.arange((1 << (WORD_BITS - PART_BITS)) + 1, dtype=np.uint64) << np.uint64(PART_BITS + PRINT_BITS))
        low = cells.astype(np.uint32)
        parts = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(
            [low[ends[p]:ends[p + 1]].tobytes() for p in parts], pa.binary())], ["part", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for keys in found(batch):
                held.append(keys)
                size += keys.size
                if size > CELLS_A_FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return map_batches(rows, run, "part int, cells binary")


def _index_bits(lines: DataFrame, tau: int) -> DataFrame:
    """Filters of the index's keys and grams, and of what is in it twice."""
    def found(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for sums, _, starts, length in _chunks(batch):
            gram, key, _, _ = _index_rows(sums, starts, length, tau)
            yield np.concatenate((np.unique(gram), key))

    return _key_bits(_cells(lines, found))


def _keys(lines: DataFrame, sets: list[tuple[DataFrame, str]], tau: int, least: int, spans: tuple[int, int], probe: bool) -> DataFrame:
    """(key, h, n, place, probe) of the probes, or of the index, that the filters let pass; a written table."""
    shared = _shared_bits(*sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for sums, h, starts, length in _chunks(batch):
                _, key, line, place = _index_rows(sums, starts, length, tau)
                if probe:
                    own = (key ^ hashing.mix(h[line]))[range_of(length)[line] >= spans[0]]
                    short = np.flatnonzero((length < long_from(tau)) & (spans[0] == 0))
                    wide = np.flatnonzero(length >= max(GRAM, long_from(tau) - edits(long_from(tau), tau)))
                    key, line, place = gram_probes(sums, starts[wide], length[wide], held, long_from(tau), spans)
                    keys, lines, places = [key], [wide[line]], [place]
                    for key, line in probe_keys(sums, starts[short], length[short], tau, least):
                        hit = _has(held, key)
                        keys.append(key[hit])
                        lines.append(short[line[hit]])
                        places.append(np.zeros(int(hit.sum()), np.int64))
                    key, line, place = np.concatenate(keys), np.concatenate(lines), np.concatenate(places)
                    key, line, place = _once(key, line, place)
                    some = ~np.isin(key ^ hashing.mix(h[line]), own)  # keys of one index meet each other
                else:
                    some = _has(held, key)
                key, line, place = key[some], line[some], place[some]
                yield pa.RecordBatch.from_arrays(
                    [_signed(key), _signed(h[line]), pa.array(length[line].astype(np.int32)),
                     pa.array(place.astype(np.int32)), pa.array(np.full(key.size, probe))], ["key", "h", "n", "place", "probe"])

    out = _kept(map_batches(lines, run, "key bigint, h bigint, n int, place int, probe boolean"),
                "line-probes" if probe else "line-index")
    shared.destroy()  # its copies stand on the disks
    return out


def _collect(spark: SparkSession) -> None:
    """Let go of the shuffle files of written tables: they stay until the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def _class_keys(lines: DataFrame, tau: int, least: int, lo: int, hi: int) -> list[DataFrame]:
    """The keys, of probes and of the index, of the lines of ranges from ``lo`` on and below ``hi`` that may meet; a shorter line probes the next range too."""
    own, probing = _between(lines, lo, hi), _between(lines, max(lo - 1, 0), hi)
    indexed = _index_bits(own, tau)
    probes = _keys(probing, [(indexed, "once")], tau, least, (lo, hi), True)
    probed = _key_bits(_cells(probes.select("key"), lambda batch: [batch.column(0).to_numpy().view(np.uint64)]))
    index = _keys(own, [(indexed, "twice"), (probed, "once")], tau, least, (lo, hi), False)
    uncut(indexed, probed)
    _collect(lines.sparkSession)
    return [probes, index]


def _met(keys: DataFrame) -> DataFrame:
    """Rows of keys of different lines, one of which at least is in the index, beside one of those (the pivot); many: the key has more than two lines.

    Of a key with two only the row that isn't the pivot is given. A key's rows
    come one after the other, pivot first; no more than three are held."""
    names = ["key", "h", "n", "place", "probe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, given = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, bool)], False  # first rows of the last key
        for batch in chain(batches, [None]):
            last = batch is None
            if not last:
                held = [np.concatenate((x, c.to_numpy(zero_copy_only=False))) for x, c in zip(held, batch.columns, strict=True)]
            key, h, n, place, probe = held
            if not key.size:
                continue
            fresh = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (probe[1:] != probe[:-1])]
            key, h, n, place, probe = (x[fresh] for x in held)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, key.size])
            group = np.repeat(np.arange(first.size), size)
            pivot, many = first[group], (size > 2)[group]
            out = ~probe[pivot] & (many | (np.arange(key.size) != pivot)) & (size > 1)[group]
            if given:
                out[:min(3, size[0])] = False
            if not last and size[-1] < 3:
                out[first[-1]:] = False
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], h[at], n[at], place[at], probe[at], h[pivot[at]], n[pivot[at]], place[pivot[at]], many[at])],
                                             [*names, "pivot_h", "pivot_n", "pivot_place", "many"])
            given = size[-1] > 2
            held = [x[first[-1]:first[-1] + 3] for x in (key, h, n, place, probe)]

    dealt = keys.select(*names).repartition("key").sortWithinPartitions("key", "probe", F.desc("n"), "h")
    return map_batches(dealt, run, MET)


def _sketch(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of each text: parities of its byte pairs in 64 * PAIR_LONGS bits, and of its substrings of SKETCH bytes in as many bits as it has bytes, up to a power of 2."""
    n = np.diff(offsets)
    line = np.repeat(np.arange(n.size), n)
    left = np.repeat(offsets[1:], n) - np.arange(offsets[0], offsets[-1])
    text = np.r_[data[offsets[0]:offsets[-1]], np.zeros(SKETCH, np.uint8)].astype(np.uint64)
    size = text.size - SKETCH
    pair = ((text[:size] * np.uint64(31) + text[1:size + 1]).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    some = left > 1
    odd = np.bincount(line[some] * (64 * PAIR_LONGS) + pair[some], minlength=n.size * 64 * PAIR_LONGS) & 1
    pairs = np.packbits(odd.astype(bool)).view(np.int64).reshape(-1, PAIR_LONGS)
    gram = reduce(lambda g, k: g << np.uint64(8) | text[k:size + k], range(1, SKETCH), text[:size])
    gram = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
    bits = 64 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)
    base = np.cumsum(bits) - bits
    some = left >= SKETCH
    odd = np.bincount(base[line[some]] + (gram[some] & (bits[line[some]] - 1)), minlength=int(bits.sum())) & 1
    raw = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return pairs, [raw[b >> 3:b + w >> 3] for b, w in zip(base.tolist(), bits.tolist(), strict=True)]


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, n, t, parities of byte pairs, sketch) of the lines in ``wanted`` (h), one row each."""
    words = set_bits(wanted.select(F.pmod(F.col("h"), F.lit(1 << LINE_BITS)).alias("c")), "c").toArrow()
    bits = np.zeros(1 << (LINE_BITS - 6), np.int64)
    bits[words.column("__word").to_numpy()] = words.column("__bits").to_numpy()
    shared = lines.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mask = shared.value, np.uint64((1 << LINE_BITS) - 1)
        for batch in batches:
            cell = batch.column(0).to_numpy().view(np.uint64) & mask
            batch = batch.take(pa.array(np.flatnonzero((held[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1)))
            data, offsets = hashing.string_buffers(batch.column(2))
            for a, b in hashing.document_groups(offsets):
                pairs, sketch = _sketch(data, offsets[a:b + 1])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array(np.ascontiguousarray(x)) for x in pairs.T), pa.array(sketch, pa.binary())],
                                                 ["h", "n", "t", *PAIRS, "s"])

    got = map_batches(lines.select("h", "n", "t"), run, "h bigint, n bigint, t binary, " + ", ".join(f"{c} bigint" for c in PAIRS) + ", s binary")
    return got.join(wanted, "h", "left_semi").dropDuplicates(["h"])


def _edits(n: Column, m: Column, tau: int) -> Column:
    longer = F.greatest(n, m)
    return F.when(longer >= long_from(tau), F.floor(longer / SHARE)).otherwise(tau)


def _reach(n: Column, place: Column, n_: Column, place_: Column, tau: int) -> Column:
    """Whether the edits suffice for the shift of what a pair shares, if each has it once, and for that of the lines' ends."""
    shift = F.when((place >= 0) & (place_ >= 0), place - place_).otherwise(0)
    return F.abs(shift) + F.abs(n - n_ - shift) <= _edits(n, n_, tau)


def _meets(tau: int) -> Column:
    """Whether what an index row (n, place) of a long line shares with a row of another line (n_, place_, probe_) is where that line's edits allow.

    An index row's line may have its key elsewhere too."""
    n, place, n_, place_ = F.col("n"), F.col("place"), F.col("n_"), F.col("place_")
    base = F.expr(f"n div (n div {SHARE} + 1)")
    near = ((F.abs(place_ - place) <= F.floor(place / base)) & (F.abs(n_ - place_ - n + place) <= F.floor((n - place) / base) - 1))
    long = (n >= n_) & (n - n_ <= _edits(n, n_, tau)) & (~F.col("probe_") | (place < 0) | (place_ < 0) | near)
    return F.when(n >= long_from(tau), long).otherwise(_reach(n, place, n_, place_, tau))


def _differ(xs: pa.Array, ys: pa.Array) -> np.ndarray:
    """Bits in which the sketches of each pair differ; the longer is folded to the other's size."""
    (a, x), (b, y) = hashing.string_buffers(xs), hashing.string_buffers(ys)
    words = np.concatenate((a[x[0]:x[-1]], b[y[0]:y[-1]])).view(np.uint64)
    at, size = np.stack((x[:-1] - x[0], y[:-1] - y[0] + x[-1] - x[0])) >> 3, np.stack((np.diff(x), np.diff(y))) >> 3
    out = np.zeros(size.shape[1], np.int64)
    code = size[0] << 32 | size[1]
    for c in np.unique(code):
        some, sizes = np.flatnonzero(code == c), (int(c >> 32), int(c & 0xFFFFFFFF))
        step = max(1, CELLS_A_GROUP // max(sizes))
        for few in (some[k:k + step] for k in range(0, some.size, step)):
            left, right = (np.bitwise_xor.reduce(words[at[j, few, None] + np.arange(sizes[j])].reshape(few.size, -1, min(sizes)), axis=1) for j in (0, 1))
            out[few] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return out


def _alike(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """``pairs`` (a, b) whose parities allow that they are near: an edit takes as many substrings of a size away at most as that, and brings as many."""
    slim = texts.drop("t")
    both = (pairs.join(slim.withColumnRenamed("h", "a"), "a")
            .join(slim.select([F.col(c).alias("b" if c == "h" else c + "_") for c in slim.columns]), "b"))
    odd = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "_"))) for c in PAIRS), F.lit(0))
    most = _edits(F.col("n"), F.col("n_"), tau)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(_differ(batch.column(2), batch.column(3)) <= 2 * SKETCH * batch.column(4).to_numpy()))

    return map_batches(both.where(odd <= 4 * most).select("a", "b", "s", "s_", most.cast("long").alias("most")), run, "a bigint, b bigint")


def _verify(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """``pairs`` (a, b) of near lines; a written table."""
    joined = (_alike(pairs, texts, tau).join(texts.select(F.col("h").alias("a"), F.col("t").alias("x")), "a")
              .join(texts.select(F.col("h").alias("b"), F.col("t").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(near_pairs(batch.column(2), batch.column(3), tau)))

    return _kept(map_batches(joined, run, "a bigint, b bigint"), "line-found")


def _class_links(lines: DataFrame, tau: int, least: int, lo: int, hi: int) -> DataFrame:
    """Links (a, b) by which the components of the near lines of ranges from ``lo`` on and below ``hi``, and of those a range shorter, are found; written tables."""
    made = _class_keys(lines, tau, least, lo, hi)
    under = _kept(_met(reduce(DataFrame.unionByName, made)), "line-under")
    uncut(*made)
    member = [F.col(c).alias(c + "_") for c in ("h", "n", "place", "probe")]
    pivot = [F.col(f"pivot_{c}").alias(c) for c in ("h", "n", "place")]
    ends = [F.least("h", "h_").alias("a"), F.greatest("h", "h_").alias("b")]
    tried = _kept(under.select(*pivot, *member).where("h != h_").where(_meets(tau)).select(*ends).distinct(), "line-pairs")
    many = under.where("many").select("key", "h", "n", "place", "probe")
    wanted = tried.select(F.explode(F.array("a", "b")).alias("h")).unionByName(many.select("h")).distinct()
    texts = _kept(_texts(_between(lines, max(lo - 1, 0), hi), wanted), "line-texts")
    links = _verify(tried, texts, tau)
    component = _kept(components(links), "line-components")
    named = (many.join(component.withColumnRenamed("id", "h"), "h", "left")
             .withColumn("c", F.coalesce("component", "h")).drop("component"))
    spread = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    opened = _kept(named.join(spread, "key", "left_semi"), "line-open")
    uncut(under, component)
    left, right = opened.where("not probe"), opened.select([F.col(c).alias(c + "_") for c in opened.columns])
    pairs = _kept(left.join(right, (F.col("key") == F.col("key_")) & (F.col("c") != F.col("c_")) & _meets(tau))
                  .select(*ends).distinct().join(tried, ["a", "b"], "left_anti"), "line-pairs")
    uncut(opened, tried)
    links = links.unionByName(_verify(pairs, texts, tau))
    uncut(pairs, texts)
    _collect(lines.sparkSession)
    return links


def line_links(rows: DataFrame, firsts: DataFrame, tau: int, least: int) -> DataFrame:
    """(h, component) of the distinct lines of ``rows`` (id, t) that stand in a class with another.

    ``firsts`` (h, first: id, line, h) has the first place of each line."""
    lines = _first_lines(rows, firsts, least)
    links = reduce(DataFrame.unionByName, [_class_links(lines, tau, least, lo, hi) for lo, hi in _classes(lines, tau)])
    uncut(lines)
    return components(links).withColumnRenamed("id", "h")


def line_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU,
                 least: int = LEAST_BYTES) -> DataFrame:
    """(id, line, h, first_id, first_line, first_h, dropped) of every line that is not blank.

    Lines are one class if their trimmed texts, A-Z as a-z, are equal or
    linked through lines of at least ``least`` bytes within ``tau`` edits of
    each other, or from LONG_BYTES on within a SHAREth of the longer one's
    bytes. A class's first line, by id and then line number, stays; a null
    id comes first. Null and empty texts have no lines; rows repeated with one
    id are one document; an empty table gives no rows; only id and text are
    read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = _kept(_occurrences(rows), "lines")
    distinct = _kept(lines.groupBy("h").agg(F.min(F.struct("id", "line", "h")).alias("first")), "line-places")
    linked = _kept(line_links(rows, distinct, tau, least), "line-classes")
    heads = (distinct.join(linked, "h").groupBy("component").agg(F.min("first").alias("head")))
    headed = linked.join(heads, "component").select(F.col("h").alias("h1"), "head")
    own = distinct.join(headed, distinct["h"] == headed["h1"], "left").select(
        F.col("h").alias("h0"), F.coalesce("head", "first").alias("first"))
    return lines.join(own, lines["h"] == own["h0"]).select(
        F.col("id").alias(id_col), "line", "h", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"),
        F.col("first.h").alias("first_h"),
        (~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line") == F.col("first.line")))).alias("dropped"))


def line_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per id: n_lines, n_dropped, n_near (dropped, other text than the line that stays), dropped line numbers."""
    per = line_classes(docs, id_col=id_col, text_col=text_col, **options).groupBy(F.col(id_col).alias("id")).agg(
        F.countDistinct("line").alias("n_lines"),
        F.sort_array(F.collect_set(F.when(F.col("dropped"), F.col("line")))).alias("dropped"),
        F.count_distinct(F.when(F.col("dropped") & (F.col("h") != F.col("first_h")), F.col("line"))).alias("n_near"))
    ids = docs.select(F.col(id_col).alias("id0")).distinct()
    out = ids.join(per, ids["id0"].eqNullSafe(per["id"]), "left")
    return out.select(F.col("id0").alias(id_col), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      F.coalesce("dropped", F.expr("cast(array() as array<int>)")).alias("dropped"))


def drop_lines(docs: DataFrame, digest: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that ``digest`` drops taken out of their texts; other columns and null texts stay."""
    gone = digest.where("n_dropped > 0").select(F.col(id_col).alias("__id"), F.col("dropped").alias("__gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left")
    left = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda _, i: ~F.array_contains(gone["__gone"], i)), "\n")
    text = F.when(gone["__gone"].isNull(), docs[text_col]).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
