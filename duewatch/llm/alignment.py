"""Cross-tokenizer alignment with an inverted index of pair bitmaps.

Two tokenizers cut one byte sequence, a space and the text. Where a token of
both ends, a group ends; every token of the first linked with every token of
the second in its group is a link. The index holds, for each pair of token
ids, which documents link it: documents are numbered, and a pair has one
compressed bitmap for each binary digit (plane) of its number of links in a
document. A container holds two bytes a document or one bit a document of its
unit, whichever is less.

* A task ORs the bitmaps of its batches together into units of at most
  ``UNIT_DOCS`` documents and about ``UNIT_POSTINGS`` postings. Units number
  different documents, so their OR lies side by side and its popcount is the
  sum of theirs: only (unit, pair, popcounts) rows shuffle, no bitmap does.
* The OR of a pair's planes is popcounted to its document count, plane k's
  popcount weighs 2**k in its link count.
* The pairs' counts return to the units, where the postings add them up for
  each document.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewatch.llm.shared import cut, map_batches

UNIT_DOCS = 1 << 16
UNIT_POSTINGS = 4_000_000
#: Text that is tokenized at a time, and link occurrences that are laid out at a time.
PIECE_BYTES, PIECE_LINKS = 512 << 10, 2_000_000
PLANE_BYTES = UNIT_DOCS // 8


# Tokenizers ------------------------------------------------------------------------------------------------------

#: Fixed value: how byte-level BPE parts a text before it merges.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes in that pattern no two regex libraries or Unicode versions read differently.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u024f]*")
PLAIN_CHARS = 200_000


class ByteLevel:
    """Byte-level BPE of a ``tokenizers`` file; special strings in a text are plain text. Encodes space + text.

    Plain texts go through ``tiktoken``, which does the same with the file's
    entries as ranks in a quarter of the time. It is used if the file parts
    texts by :data:`PARTS` and its merges are in order of their entries; other
    characters and very long texts stay with ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 and up, in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        entries = file["model"]["vocab"]
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        made = [entries.get("".join(m), -1) for m in merges]
        parts = file["pre_tokenizer"] or {}
        usual = (parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
                 and not file["normalizer"] and all(a < b for a, b in zip([-1, *made], made, strict=False)))
        self.quick = tiktoken.Encoding("entries", pat_str=PARTS, special_tokens={}, mergeable_ranks={
            self.bytes[i]: i for i in [*(entries[c] for c in byte), *made]}) if usual and all(c in entries for c in byte) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        rest = []
        for k, t in enumerate(texts):
            if self.quick and len(t) <= PLAIN_CHARS and PLAIN.fullmatch(t):
                out[k] = self.quick.encode_ordinary(" " + t)
            else:
                rest.append(k)
        for k, e in zip(rest, self.model.encode_batch_fast([" " + texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


class Pieces:
    """Sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(piece)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_loaded: dict[str, ByteLevel | Pieces] = {}


def tokenizer(path: str) -> ByteLevel | Pieces:
    if path not in _loaded:
        _loaded[path] = (Pieces if path.endswith(".model") else ByteLevel)(path)
    return _loaded[path]


# Bitmaps ---------------------------------------------------------------------------------------------------------

class Bitmaps(NamedTuple):
    """One bitmap over a unit's slots for each of many pairs; a pair is in ``few`` or in ``many``."""

    few: np.ndarray       # pairs whose container is a list of slots
    sizes: np.ndarray     # slots of each
    slots: np.ndarray     # uint16, one after the other
    many: np.ndarray      # pairs whose container is a bit string
    bits: np.ndarray      # uint8, a row for each

    @classmethod
    def of(cls, pair: np.ndarray, slot: np.ndarray, width: int = PLANE_BYTES) -> Bitmaps:
        """From postings sorted by pair and slot, without repeats; ``width``: bytes of a bit string."""
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if pair.size else np.empty(0, np.int64)
        n = np.diff(np.r_[first, pair.size])
        dense = 2 * n > width
        of_dense = np.repeat(dense, n)
        bits = np.zeros((int(dense.sum()), width), np.uint8)
        ends, at, step = np.cumsum(n[dense]), slot[of_dense], max(1, PIECE_LINKS // (8 * width))
        for i in range(0, len(bits), step):
            lo, hi = ends[i - 1] if i else 0, ends[min(i + step, len(bits)) - 1]
            here = np.zeros((min(step, len(bits) - i), 8 * width), bool)
            here[np.repeat(np.arange(len(here)), n[dense][i:i + step]), at[lo:hi]] = True
            bits[i:i + step] = np.packbits(here, axis=1, bitorder="little")
        return cls(pair[first[~dense]], n[~dense].astype(np.int32), slot[~of_dense].astype(np.uint16),
                   pair[first[dense]], bits)

    def popcount(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, set bits of each)"""
        return (np.concatenate([self.few, self.many]),
                np.concatenate([self.sizes.astype(np.int64), np.bitwise_count(self.bits).sum(1, dtype=np.int64)]))

    def postings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pair, slot) of every set bit, in parts of bounded size."""
        yield np.repeat(self.few, self.sizes), self.slots.astype(np.int64)
        step = max(1, PIECE_LINKS // max(8 * self.bits.shape[1], 1))
        for i in range(0, len(self.many), step):
            row, slot = np.nonzero(np.unpackbits(self.bits[i:i + step], axis=1, bitorder="little"))
            yield self.many[i + row], slot


def or_merge(parts: list[Bitmaps], width: int = PLANE_BYTES) -> Bitmaps:
    """The OR of bitmaps, pair by pair."""
    found = [(p << 16) | s for part in parts for p, s in part.postings()]
    key, _ = _counted(np.concatenate(found)) if found else (np.empty(0, np.int64), None)
    return Bitmaps.of(key >> 16, key & 0xFFFF, width)


def _planes(key: np.ndarray, links: np.ndarray) -> list[Bitmaps]:
    """Bitmaps of the binary digits of ``links``, by sorted keys pair << 16 | slot."""
    out, k = [], 0
    while (rest := links >> k).any():
        at = key[(rest & 1) == 1]
        out.append(Bitmaps.of(at >> 16, at & 0xFFFF))
        k += 1
    return out


class Unit:
    """Bitmaps of consecutive documents, from row number ``base`` on, as batches come in."""

    def __init__(self, base: int):
        self.base, self.docs, self.postings, self.parts = base, 0, 0, []

    def add(self, key: np.ndarray, links: np.ndarray) -> None:
        for k, part in enumerate(_planes(key, links)):
            if k == len(self.parts):
                self.parts.append([])
            self.parts[k].append(part)
        self.postings += key.size

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(pairs, document counts, link counts, packed planes)"""
        width = -(-self.docs // 8)
        planes = [or_merge(p, width) for p in self.parts]
        pairs, docs = or_merge(planes, width).popcount()
        order = np.argsort(pairs)
        pairs, docs, links = pairs[order], docs[order], np.zeros(pairs.size, np.int64)
        for k, plane in enumerate(planes):
            p, n = plane.popcount()
            links[np.searchsorted(pairs, p)] += n << k
        packed = io.BytesIO()
        np.savez(packed, **{f"{k}_{name}": x for k, plane in enumerate(planes)
                            for name, x in plane._asdict().items()})
        return pairs, docs, links, packed.getvalue()


def unpacked(planes: bytes) -> list[Bitmaps]:
    with np.load(io.BytesIO(planes)) as z:
        return [Bitmaps(*(z[f"{k}_{name}"] for name in Bitmaps._fields)) for k in range(len(z.files) // 5)]


# Links of a batch ------------------------------------------------------------------------------------------------

def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _counted(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands (``n``: how often each counts)."""
    if not key.size:
        return key, np.empty(0, np.int64)
    if n is None:
        key = np.sort(key)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.diff(np.r_[first, key.size])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


def _paired(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, size_b: int, slot_of: np.ndarray,
            n_a: np.ndarray | None = None, n_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys pair << 16 | slot of all links, and their numbers; tokens lie in order of their groups ``in_a``, ``in_b``.

    Laid out a bounded number at a time, counted as they come.
    """
    lo = np.searchsorted(in_b, in_a, "left")
    reach = np.searchsorted(in_b, in_a, "right") - lo
    ends = np.cumsum(reach)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    i = 0
    while i < a.size:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE_LINKS, "right")))
        at = _spread(lo[i:j], reach[i:j])
        key = (np.repeat(a[i:j] * size_b, reach[i:j]) + b[at]) << 16 | np.repeat(slot_of[in_a[i:j]], reach[i:j])
        n = None if n_a is None else np.repeat(n_a[i:j], reach[i:j]) * n_b[at]
        kept.append(_counted(key, n))
        if sum(k.size for k, _ in kept[1:]) > PIECE_LINKS:
            kept = [_counted(*map(np.concatenate, zip(*kept, strict=True)))]
        i = j
    if len(kept) == 1:
        return kept[0]
    return _counted(*map(np.concatenate, zip(*kept, strict=True))) if kept else _counted(np.empty(0, np.int64))


class Cut(NamedTuple):
    """Both token sequences of some documents, one after the other, and their groups."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray  # group of each token
    in_b: np.ndarray
    doc: np.ndarray   # document of each group


def cut_texts(ids_a: list[list[int]], ids_b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> Cut:
    """Groups of documents whose two byte sequences are equal; ``size_*``: bytes of each id."""
    flat = lambda ids: np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
    a, b = flat(ids_a), flat(ids_b)
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    both_a = np.isin(end_a, end_b, assume_unique=True, kind="sort") if a.size else np.empty(0, bool)
    at = np.searchsorted(end_a[both_a], end_b)
    in_a = np.cumsum(both_a) - both_a
    doc = np.repeat(np.arange(len(ids_a)), [len(x) for x in ids_a])
    return Cut(a, b, in_a, at, doc[both_a])


@functools.cache
def _decimals(digits: int) -> np.ndarray:
    """The decimal digits of 0, 1, ... as characters, with leading zeros."""
    n = np.arange(10 ** digits)
    return np.stack([48 + n // 10 ** k % 10 for k in range(digits - 1, -1, -1)], 1).astype(np.uint8)


def digests(cut_: Cut, n_docs: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document; '' without tokens."""
    groups = cut_.doc.size
    if not groups:
        return [""] * n_docs
    n_a, n_b = np.bincount(cut_.in_a, minlength=groups), np.bincount(cut_.in_b, minlength=groups)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    place_a = np.arange(cut_.a.size) + before_b[cut_.in_a]
    place_b = np.arange(cut_.b.size) + (before_a + n_a)[cut_.in_b]
    ids = np.empty(cut_.a.size + cut_.b.size, np.int64)
    ids[place_a], ids[place_b] = cut_.a, cut_.b
    mark = np.full(ids.size, ord(","), np.uint8)
    mark[before_a + n_a + before_b - 1] = ord("|")
    ends = before_a + n_a + before_b + n_b
    mark[ends - 1] = ord(";")
    # Decimal digits of all ids, right-aligned in a matrix, with the mark behind; leading places drop out.
    digits = len(str(int(ids.max())))
    text = np.empty((ids.size, digits + 1), np.uint8)
    text[:, :digits] = _decimals(digits)[ids]
    text[:, digits] = mark
    length = np.full(ids.size, 2)
    for k in range(1, digits):
        length += ids >= 10 ** k
    shown = text[np.arange(digits + 1) >= (digits + 1 - length)[:, None]]
    stop = np.cumsum(length)[ends - 1]  # end of each group in ``shown``
    last = np.searchsorted(cut_.doc, np.arange(n_docs), "right") - 1
    out, start = [], 0
    for d, g in enumerate(last.tolist()):
        if g >= 0 and cut_.doc[g] == d:
            out.append(hashlib.sha256(shown[start:stop[g] - 1].tobytes()).hexdigest())
            start = int(stop[g])
        else:
            out.append("")
    return out


def postings(cut_: Cut, slot_of: np.ndarray, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, links, whole) of the cut documents; ``whole`` is false if more follows for the same documents.

    Usually one item. Documents whose two tokenizations keep apart for long
    have groups with very many links: their equal ids are counted first, and
    the first tokenizer's ids are then taken in several shares.
    """
    groups = cut_.doc.size
    n_a, n_b = np.bincount(cut_.in_a, minlength=groups), np.bincount(cut_.in_b, minlength=groups)
    if int((n_a * n_b).sum()) <= PIECE_LINKS:
        yield *_paired(cut_.a, cut_.in_a, cut_.b, cut_.in_b, size_b, slot_of), True
        return
    most = int(cut_.a.max()) + 1
    key_a, count_a = _counted(cut_.in_a * most + cut_.a)
    key_b, count_b = _counted(cut_.in_b * size_b + cut_.b)
    in_a, a = np.divmod(key_a, most)
    in_b, b = np.divmod(key_b, size_b)
    total = int((np.bincount(in_a, minlength=groups) * np.bincount(in_b, minlength=groups)).sum())
    shares = -(-total // UNIT_POSTINGS)
    for s in range(shares):
        of = a % shares == s
        yield *_paired(a[of], in_a[of], b, in_b, size_b, slot_of, count_a[of], count_b), s == shares - 1


# Spark -----------------------------------------------------------------------------------------------------------

DOC, PAIR, INDEX = 0, 1, 2


def index(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table with three kinds of rows, made in one pass over the texts without a shuffle.

    ``DOC``: a document's row number, id and counts; ``PAIR``: popcounts of a
    pair in a unit; ``INDEX``: a unit's packed bitmaps. A row of the input is a
    document, so repeated rows are several. Null, empty and unfaithfully
    tokenized texts are documents without tokens. A text's memory is in
    proportion to its length, a unit's is bounded.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()
    fields = ["kind", "row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "unit", "pair", "docs",
              "links", "planes"]
    schema = (f"kind int, row bigint, id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
              " groups_sha256 string, unit bigint, pair bigint, docs bigint, links bigint, planes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizer(path_a), tokenizer(path_b)
        size_a, size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (one, two))
        base = TaskContext.get().partitionId() << 40
        unit, units, row, kinds = Unit(base), 0, base, None

        def batch(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f], kinds[f]) if f in columns else pa.nulls(n, kinds[f])
                                               for f in fields], fields)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal unit, units
            if unit.postings:
                pairs, n_docs, n_links, planes = unit.closed()
                n, number = pairs.size, base + units
                yield batch(n, kind=np.full(n, PAIR), unit=np.full(n, number), pair=pairs, docs=n_docs, links=n_links)
                yield batch(1, kind=[INDEX], unit=[number], row=[unit.base], docs=[unit.docs], planes=[planes])
                units += 1
            unit = Unit(row)

        for b in batches:
            if kinds is None:
                long = pa.int64()
                kinds = dict.fromkeys(fields, long) | {"kind": pa.int32(), "id": b.schema.field(0).type,
                                                       "groups_sha256": pa.string(), "planes": pa.binary()}
            sizes = np.array([len(t.as_buffer()) for t in b.column(1)], np.int64)
            sums, i = np.cumsum(sizes), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + PIECE_BYTES, "right")))
                texts = b.column(1).slice(i, j - i).to_pylist()
                ids_a, ids_b = one.encode(texts), two.encode(texts)
                for k, t in enumerate(texts):
                    want = b" " + t.encode("utf-8", "replace")
                    if not t or b"".join(map(one.bytes.__getitem__, ids_a[k])) != want \
                            or b"".join(map(two.bytes.__getitem__, ids_b[k])) != want:
                        ids_a[k], ids_b[k] = [], []
                made = cut_texts(ids_a, ids_b, size_a, size_b)
                n_a, n_b = (np.bincount(x, minlength=made.doc.size) for x in (made.in_a, made.in_b))
                n_links = np.zeros(j - i, np.int64)
                np.add.at(n_links, made.doc, n_a * n_b)
                if unit.docs + (j - i) > UNIT_DOCS:
                    yield from close()
                slot_of = unit.docs + made.doc
                unit.docs += j - i
                for key, links, whole in postings(made, slot_of, len(two.bytes)):
                    unit.add(key, links)
                    if not whole:  # a share of the same documents follows in a unit of its own
                        now, docs_now = unit.base, unit.docs
                        yield from close()
                        unit.base, unit.docs = now, docs_now
                yield batch(j - i, kind=np.full(j - i, DOC), row=np.arange(row, row + j - i), id=b.column(0).slice(i, j - i),
                            n_a=[len(x) for x in ids_a], n_b=[len(x) for x in ids_b],
                            n_groups=np.bincount(made.doc, minlength=j - i), n_links=n_links,
                            groups_sha256=digests(made, j - i))
                row += j - i
                i = j
                if unit.postings >= UNIT_POSTINGS:
                    yield from close()
        if kinds is not None:
            yield from close()

    return cut(map_batches(rows, run, schema), "pair-index")


def pair_counts(indexed: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, docs, links, best): the alignment table; ``best``: no other b has more documents with this a.

    Popcounts are summed over the units with partial sums in each task. The
    greatest count of each a is broadcast: it has a row for each id of the
    first vocabulary at most.
    """
    counts = (indexed.where(F.col("kind") == PAIR).groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
              .withColumn("a", F.expr(f"pair div {size_b}")).withColumn("b", F.expr(f"pair % {size_b}")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    joined = counts.join(F.broadcast(most), "a")
    return joined.select("pair", "a", "b", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def _return_scores(key, index_rows: pa.Table, scores: pa.Table) -> pa.Table:
    """Add up, over the postings of one unit, the counts of their pairs for each document."""
    base, n = index_rows["row"][0].as_py(), index_rows["docs"][0].as_py()
    pair = scores["pair"].to_numpy()
    order = np.argsort(pair)
    pair, count, best = pair[order], scores["docs"].to_numpy()[order], scores["best"].to_numpy()[order].astype(np.int64)
    sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, plane in enumerate(unpacked(index_rows["planes"][0].as_py())):
        for p, slot in plane.postings():
            at = np.searchsorted(pair, p)
            np.add.at(sums, slot, count[at] << k)
            np.add.at(bests, slot, best[at] << k)
    at = np.flatnonzero(sums)
    return pa.table({"row": base + at, "count_sum": sums[at], "n_best": bests[at]})


def alignment(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    Shuffles: a row per (unit, pair) to its pair and back to its unit, the
    units' bitmaps once, two numbers per document. Cases as in :func:`index`;
    an empty table gives no rows, other columns are not read. Every executor
    needs both vocabulary files.
    """
    size_b = len(tokenizer(path_b).bytes)
    indexed = index(docs, path_a, path_b, id_col=id_col, text_col=text_col)
    counts = pair_counts(indexed, size_b).select("pair", "docs", "best")
    back = indexed.where(F.col("kind") == PAIR).select(F.col("unit").alias("of"), "pair").join(counts, "pair")
    units = indexed.where(F.col("kind") == INDEX).select("unit", "row", "docs", "planes")
    parts = (units.groupBy("unit").cogroup(back.groupBy("of"))
             .applyInArrow(_return_scores, "row bigint, count_sum bigint, n_best bigint"))
    scores = parts.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    rows = indexed.where(F.col("kind") == DOC).select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(scores, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
                                                   zero("n_best"), zero("count_sum"), "groups_sha256")
