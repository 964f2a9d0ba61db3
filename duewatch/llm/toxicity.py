"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's bag holds its character 3- to 5-grams (of bytes, marked where they
touch the word's begin or end) and the word itself, all hashed to buckets. A
window of SPAN words starts at every word. The embeddings of a window's bags
are averaged and go through a linear softmax of two classes; embeddings and
softmax are trained together, so a misspelling that was never seen shares most of its vectors with words that were. A few toxic
words in a long text would drown in one average, so a text is scored by its
most toxic window and the windows of a labelled text are learnt as a bag: the
top windows of a toxic text are its examples, and the hardest windows of clean
texts are theirs.

Training uses a bounded sample. Scoring folds the softmax into one number per
bucket, so each task holds 2**BUCKET_BITS floats, and covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewatch.llm import hashing
from duewatch.llm.shared import map_batches

BUCKET_BITS = 17
GRAMS = (3, 4, 5)
SPAN = 2
DIM = 12
SAMPLE_A_CLASS = 2500
SAMPLE_BYTES = 16_000
_SHIFT = np.uint64(64 - BUCKET_BITS)
_MARK = np.uint64(0x9FB21C651E98DF25)


def _buckets(chunk: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of every subword, one array for each size and one for whole words."""
    sums = hashing.prefix_sums(chunk)
    up, _ = hashing.powers(chunk.size)
    size = ends - starts

    def bucket(lo: np.ndarray, hi: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (((sums[hi] - sums[lo]) * up[lo] + mark.astype(np.uint64) * _MARK)
                * np.uint64(0xD6E8FEB86659FD93) >> _SHIFT).astype(np.int64)

    yield bucket(starts, ends, np.full(starts.size, 7)), np.arange(starts.size)
    for n in GRAMS:
        many = np.maximum(size - n + 1, 0)
        word = np.repeat(np.arange(starts.size), many)
        lo = np.arange(word.size) - np.repeat(np.cumsum(many) - many, many) + starts[word]
        yield bucket(lo, lo + n, 4 * n + (lo == starts[word]) + 2 * (lo + n == ends[word])), word


def _windows(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each window of SPAN words, one from every word that has so many in its row from there on.

    A row of fewer words is one window.
    """
    if not row.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, row.size])
    place = np.arange(row.size) - np.repeat(first, size)
    left = np.repeat(size, size) - place
    at = np.flatnonzero((left >= SPAN) | (place == 0))
    return at, at + np.minimum(left[at], SPAN)


def _sums(x: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of ``x`` over each window."""
    out = np.zeros(at.size, x.dtype)
    for k in range(SPAN):
        some = at + k < end
        out[some] += x[at[some] + k]
    return out


def _pieces(offsets: np.ndarray, a: int, b: int, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row bounds) of rows [a, b); a single long row comes in pieces of whole words that share SPAN - 1 of them."""
    chunk = data[offsets[a]:offsets[b]]
    if b - a > 1 or chunk.size <= hashing.WINDOW:
        yield chunk, offsets[a:b + 1] - offsets[a]
        return
    between = hashing.PUNCTUATION[chunk]
    starts = np.flatnonzero(~between & np.r_[True, between[:-1]])
    first = sent = 0
    for _, e in hashing.window_ends(between):
        words = int(np.searchsorted(starts, e))
        if words == sent or (words - first < SPAN and words < starts.size):
            continue
        yield chunk[starts[first]:e], np.array([0, e - starts[first]])
        sent, first = words, max(0, words - SPAN + 1)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: the softmax folded in, toxic less clean
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest window logit of each row; -inf for rows without words."""
        out = np.full(offsets.size - 1, -np.inf)
        for a, b in hashing.document_groups(offsets):
            for chunk, bounds in _pieces(offsets, a, b, data):
                if not chunk.size:
                    continue
                starts, ends, _ = hashing.word_spans(chunk, bounds, hashing.PUNCTUATION)
                if not starts.size:
                    continue
                row = np.searchsorted(bounds, starts, "right") - 1
                total, n = np.zeros(starts.size), np.zeros(starts.size)
                for bucket, word in _buckets(chunk, starts, ends):
                    total += np.bincount(word, self.weight[bucket], starts.size)
                    n += np.bincount(word, minlength=starts.size)
                at, end = _windows(row)
                np.maximum.at(out, a + row[at], _sums(total, at, end) / _sums(n, at, end) + self.bias)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.slope * self.logits(data, offsets) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


class _Sample:
    """The windows of the sampled texts as lists of buckets."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        data, offsets = hashing.string_buffers(pa.array(texts, pa.string()))
        buckets, firsts, sizes, rows, before = [], [], [], [], 0
        for a, b in hashing.document_groups(offsets):
            chunk, bounds = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            starts, ends, _ = hashing.word_spans(chunk, bounds, hashing.PUNCTUATION)
            if not starts.size:
                continue
            row = np.searchsorted(bounds, starts, "right") - 1
            parts = list(_buckets(chunk, starts, ends))
            word = np.concatenate([w for _, w in parts])
            order = np.argsort(word, kind="stable")
            buckets.append(np.concatenate([x for x, _ in parts])[order].astype(np.int32))
            at, end = _windows(row)
            upto = np.r_[0, np.cumsum(np.bincount(word, minlength=starts.size))]
            firsts.append(upto[at] + before)
            sizes.append(upto[end] - upto[at])
            rows.append(row[at] + a)
            before += word.size
        self.buckets = np.concatenate(buckets) if buckets else np.empty(0, np.int32)
        self.size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        self.row = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.first = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
        self.toxic = toxic

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        upto = np.r_[0.0, np.cumsum(weight[self.buckets], dtype=np.float64)]
        return (upto[self.first + self.size] - upto[self.first]) / self.size + bias

    def take(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the windows, and each one's place in ``windows``."""
        n = self.size[windows]
        of = np.repeat(np.arange(windows.size), n)
        at = np.arange(of.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[windows], n)
        return self.buckets[at], of

    def top(self, logit: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` windows of the highest logit of each of ``rows``."""
        mine = np.flatnonzero(np.isin(self.row, rows))
        order = mine[np.lexsort((-logit[mine], self.row[mine]))]
        first = np.r_[True, self.row[order][1:] != self.row[order][:-1]] if order.size else np.empty(0, bool)
        place = np.arange(order.size) - np.maximum.accumulate(np.where(first, np.arange(order.size), 0))
        return order[place < k]


def _epoch(sample: _Sample, windows: np.ndarray, label: np.ndarray, weight: np.ndarray, params: dict, rate: float,
           rng: np.random.Generator) -> None:
    """One pass of Adagrad over shuffled batches; embeddings and softmax move together."""
    e, w, b = params["e"], params["w"], params["b"]
    order = rng.permutation(windows.size)
    for part in np.array_split(order, max(1, windows.size // 256)):
        bucket, of = sample.take(windows[part])
        n = np.bincount(of, minlength=part.size)[:, None]
        mean = np.add.reduceat(e[bucket], np.r_[0, np.cumsum(n.ravel())[:-1]]) / n
        z = mean @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        p[np.arange(part.size), label[part]] -= 1.0
        p *= weight[part][:, None] / part.size
        back = ((p @ w.T) / n)[of]
        used, place = np.unique(bucket, return_inverse=True)
        grad = np.zeros((used.size, DIM))
        np.add.at(grad, place, back)
        params["ge"][used] += (grad ** 2).mean(1)
        e[used] -= rate * grad / np.sqrt(params["ge"][used] + 1e-10)[:, None]
        for name, g in (("w", mean.T @ p), ("b", p.sum(0))):
            params["g" + name] += g ** 2
            params[name] -= 0.5 * rate * g / np.sqrt(params["g" + name] + 1e-10)


def fit(texts: list[str], toxic: np.ndarray, *, rounds: int = 8, seed: int = 11) -> Model:
    """Train on whole sampled texts and their 0/1 labels.

    Starts from random windows under their text's label; each round then takes
    the top windows of toxic texts and the hardest and some random ones of
    clean texts, by the model so far. Without both labels the model scores all
    alike.
    """
    rng = np.random.default_rng(seed)
    toxic = np.asarray(toxic, np.int64)
    sample = _Sample(texts, toxic)
    params = {"e": rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)), "w": rng.normal(0, 0.1, (DIM, 2)), "b": np.zeros(2),
              "ge": np.zeros(1 << BUCKET_BITS), "gw": np.zeros((DIM, 2)), "gb": np.zeros(2)}
    has = np.unique(sample.row)
    yes, no = has[toxic[has] == 1], has[toxic[has] == 0]
    folded = lambda: (params["e"] @ (params["w"][:, 1] - params["w"][:, 0]), params["b"][1] - params["b"][0])
    if not yes.size or not no.size:
        return Model(np.zeros(1 << BUCKET_BITS), 0.0)
    for step in range(rounds):
        chance = rng.random(sample.row.size)
        some = sample.top(chance, has, 24 if step == 0 else 3)
        if step:
            logit = sample.logits(*folded())
            hard = np.concatenate((sample.top(logit, yes, 1 if step < 4 else 2), sample.top(logit, no, 3)))
            some = some[toxic[sample.row[some]] == 0]
            windows = np.unique(np.concatenate((some, hard)))
        else:
            windows = some
        label = toxic[sample.row[windows]]
        share = np.bincount(label, minlength=2)
        weight = np.where(label == 1, 0.5 / max(share[1], 1), 0.5 / max(share[0], 1)) * label.size
        for _ in range(3):
            _epoch(sample, windows, label, weight, params, 0.3, rng)
    # Calibrate the highest logit of a text: a logistic fit of two numbers, with the classes at equal weight.
    logit = sample.logits(*folded())
    top = np.full(toxic.size, -np.inf)
    np.maximum.at(top, sample.row, logit)
    x, y = top[has], toxic[has]
    cw = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g, h = cw * (p - y), cw * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(hess, [(g * x).sum() + 1e-3 * (slope - 1), g.sum()])
        slope, shift = slope - 0.5 * d[0], shift - 0.5 * d[1]
    return Model(folded()[0].astype(np.float32), float(folded()[1]), float(max(slope, 1e-3)), float(shift))


def learnable(id_col: str = "doc_id"):
    """Whether a row's label may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def training_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", a_class: int = SAMPLE_A_CLASS,
                    most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """At most ``a_class`` texts of each label, of at most ``most_bytes`` each, chosen by hash of the id."""
    known = labels.where(learnable(id_col) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(
        F.max(label_col).alias("__y"))
    texts = docs.where(F.octet_length(F.col(text_col)).between(1, most_bytes)).select(
        F.col(id_col), F.col(text_col).alias("__t"))
    order = F.xxhash64(F.col(id_col), F.lit(5))
    found = []
    for y in (0, 1):  # ids first, so that no more texts than asked for leave the scan; some are too long or missing
        ids = known.where(F.col("__y") == y).orderBy(order, id_col).limit(a_class)
        found += [(r["__t"], y) for r in texts.join(F.broadcast(ids), id_col).dropDuplicates([id_col])
                  .orderBy(order, id_col).select("__t").collect()]
    return [t for t, _ in found], np.array([y for _, y in found], np.int64)


def score_texts(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; texts without words score 0. No shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = hashing.string_buffers(batch.column(1))
            score = np.where(np.diff(offsets) > 0, model.scores(data, offsets), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", threshold: float = 0.7, a_class: int = SAMPLE_A_CLASS) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Labels are learnt from ids outside the held-out third only; several labels
    of an id count as the highest, other values than 0 and 1 are passed over.
    Null and empty texts and texts without words score 0. Repeated rows each
    have a score; an empty table gives no rows; a null id is not held out;
    other columns are not read.
    """
    model = fit(*training_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, a_class=a_class))
    held = F.coalesce(~learnable("id"), F.lit(False))
    return score_texts(docs, model, id_col=id_col, text_col=text_col).select(
        F.col("id").alias(id_col), held.alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
