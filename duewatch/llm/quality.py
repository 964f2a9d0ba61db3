"""Quality by co-training: a text view and a metadata view teach each other, then are combined.

The text view sees shares of odd words (shouted, repeated, strung with symbols,
bare punctuation, digits), word variety and lengths. The metadata view sees
language, source and the declared size in half-octaves, and nothing of the
text. Both are logistic models. In each round each view scores every unlabelled
document of the corpus in tasks, and those of each class whose calibrated
belief it lifts farthest over the class's prior go to the other view's next
training set, by a distributed top-k. They are taught as believed: the label is
the belief itself, and its weight the share of the way from the prior to
certainty, so a view that knows little about a document says little. In the end
the views' calibrated log-odds are combined by a third logistic fit on labelled
documents that neither was trained on; no view's belief can count against itself.

Features are made in tasks, once, into a written table; the driver gets those
of a bounded number of labelled and taught rows. Scoring is one scan without a
shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duewatch.llm import hashing
from duewatch.llm.toxicity import learnable
from duewatch.llm.shared import cut, map_batches, uncut

SAMPLE_A_CLASS = 2000
ROUNDS = 5
TAUGHT_A_ROUND = 400
META_SLOTS, SIZE_SLOTS = 64, 48
META_FEATURES = META_SLOTS + SIZE_SLOTS + 3
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 4 digit, 8 plain punctuation, 16 other symbol
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 4
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 16
_KIND[[ord(c) for c in ".,;:'\"!?-()"]] = 8
_SMOOTH = 12.0
TEXT_FEATURES = 17


def _row_counts(chunk: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of words of each kind, one line per row; counts of pieces of one text add up."""
    rows = bounds.size - 1
    starts, ends, _ = hashing.word_spans(chunk, bounds)
    if not starts.size:
        return np.zeros((rows, 9))
    row = np.searchsorted(bounds, starts, "right") - 1
    kind, size = _KIND[chunk], ends - starts

    def of(bit: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind == bit)))
        return total[ends] - total[starts]

    upper, lower, digit, plain, symbol = of(1), of(2), of(4), of(8), of(16)
    bang = np.concatenate(([0], np.cumsum(chunk == 33)))
    hashes = hashing.span_hash(hashing.prefix_sums(chunk), starts, ends)
    again = np.zeros(starts.size, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])]
    marks = [np.ones(starts.size), size, (upper >= 2) & (lower == 0), symbol >= 2, bang[ends] - bang[starts] >= 2,
             again, (plain + symbol == size), digit * 2 >= size]
    out = [np.bincount(row, m, rows) for m in marks] + [np.bincount(row[order][new], minlength=rows)]
    return np.stack(out, 1)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text view of each row: whole texts, a bounded number of bytes at a time."""
    counts = np.zeros((offsets.size - 1, 9))
    for a, b in hashing.document_groups(offsets):
        chunk = data[offsets[a]:offsets[b]]
        if b - a > 1 or chunk.size <= hashing.WINDOW:
            if chunk.size:
                counts[a:b] = _row_counts(chunk, offsets[a:b + 1] - offsets[a])
        else:
            for s, e in hashing.window_ends(hashing.SPACE[chunk]):
                counts[a] += _row_counts(chunk[s:e], np.array([0, e - s]))[0]
    n = counts[:, 0]
    share = counts[:, 2:8] / (n + _SMOOTH)[:, None]
    few = 1 - counts[:, 8] / np.maximum(n, 1)
    return np.column_stack([share, np.minimum(share * 5, 1), few * n / (n + 100), np.log1p(n) / 10,
                            counts[:, 1] / np.maximum(n, 1) / 20, n == 0, np.ones(n.size)])


def meta_slots(langs: list, sources: list, sizes: np.ndarray) -> np.ndarray:
    """(language slot, source slot, size) of each row: hashes of the values (null is one), the size as its logarithm."""
    out = np.zeros((len(langs), 3))
    for i, pair in enumerate(zip(langs, sources, strict=True)):
        out[i, :2] = [zlib.crc32(f"{name}{value!r}".encode()) % META_SLOTS for name, value in zip("ls", pair, strict=True)]
    out[:, 2] = np.log1p(np.maximum(np.nan_to_num(sizes), 0))
    return out


def meta_features(slots: np.ndarray) -> np.ndarray:
    """The metadata view: language, source and half-octave of the size as indicators, the size and its square."""
    out = np.zeros((len(slots), META_FEATURES))
    row, size = np.arange(len(slots)), slots[:, 2]
    out[row, slots[:, 0].astype(int)] = 1
    out[row, slots[:, 1].astype(int)] = 1
    out[row, META_SLOTS + np.minimum(size * 2 / np.log(2), SIZE_SLOTS - 1).astype(int)] = 1
    out[:, -3], out[:, -2], out[:, -1] = size / 10, size ** 2 / 100, 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge * v @ v / 100)

    at = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w / 100
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1]) / 100
        d = np.linalg.solve(hess, grad)
        step = 1.0
        while step > 1e-3 and loss(w - step * d) > at:
            step /= 2
        w, last, at = w - step * d, at, loss(w - step * d)
        if abs(last - at) < 1e-9:
            break
    return w


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _prob(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


@dataclass
class View:
    weight: np.ndarray
    scale: np.ndarray  # calibration of the log-odds

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(x @ self.weight, -15, 15)
        return _prob(np.column_stack((z, np.ones(z.size))), self.scale)


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray
    taught: list[tuple[int, int]] = field(default_factory=list)  # rows that text and metadata taught in each round

    def combine(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return _prob(np.column_stack((_odds(t), _odds(m), np.ones(t.size))), self.mix)


def _fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> View:
    w = logistic(x, y, weight)
    z = np.clip(cx @ w, -15, 15)
    return View(w, logistic(np.column_stack((z, np.ones(z.size))), cy, np.ones(cy.size)))


def _fit_mix(t: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the views' log-odds; a view that would count against itself is left out."""
    odds, one = [_odds(t), _odds(m)], np.ones(y.size)
    mix = logistic(np.column_stack((*odds, one)), y, one)
    for out, other in ((0, 1), (1, 0)):
        if mix[out] < 0:
            alone = logistic(np.column_stack((odds[other], one)), y, one)
            mix = np.zeros(3)
            mix[other], mix[2] = max(alone[0], 0.0), alone[1]
    return mix


@dataclass
class Lesson:
    """Rows that one view has been taught: the other view's beliefs, and how far they are from the prior."""

    x: np.ndarray
    belief: np.ndarray
    weight: np.ndarray
    ids: set

    def add(self, x: np.ndarray, belief: np.ndarray, weight: np.ndarray, ids: list) -> None:
        self.x, self.belief = np.vstack((self.x, x)), np.concatenate((self.belief, belief))
        self.weight = np.concatenate((self.weight, weight))
        self.ids |= set(ids)


def lift(belief: np.ndarray, prior: float, label: int) -> np.ndarray:
    """Share of the way from the class's prior to certainty; below zero if the belief is under the prior."""
    return (belief - prior) / max(1 - prior, 1e-9) if label else (prior - belief) / max(prior, 1e-9)


def _surest(free: DataFrame, views: tuple[View, View], prior: float, taught: tuple[set, set], most: tuple[int, int]) -> pd.DataFrame:
    """Per teacher and label the free rows of greatest lift that it has not taught, ``most[label]`` at most.

    Every row of ``free`` is scored. A task keeps its own best as batches come
    in; what all tasks hold is ranked again, so the driver gets the best of all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            h = batch.column(1).to_numpy()
            text = np.array(batch.column(2).to_pylist(), float).reshape(len(ids), TEXT_FEATURES)
            slots = np.array(batch.column(3).to_pylist(), float).reshape(len(ids), 3)
            for teacher, x in ((0, text), (1, meta_features(slots))):
                p = views[teacher](x)
                new = np.array([i not in taught[teacher] for i in ids], bool)
                for label in (0, 1):
                    gain = lift(p, prior, label)
                    at = np.flatnonzero(new & (gain > 0))
                    at = at[np.lexsort((h[at], -gain[at]))][:most[label]]
                    held = best.setdefault((teacher, label), [])
                    held += [(float(gain[k]), int(h[k]), ids[k], float(p[k]), text[k], slots[k]) for k in at]
                    held.sort(key=lambda r: (-r[0], r[1]))
                    del held[most[label]:]
        for (teacher, label), held in best.items():
            if held:
                gain, hs, names, p, text, slots = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([teacher] * len(held), pa.int32()), pa.array([label] * len(held), pa.int32()), pa.array(gain), pa.array(hs, pa.int64()),
                     pa.array(names, id_type), pa.array(p), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(slots), pa.list_(pa.float64()))],
                    ["teacher", "label", "gain", "h", "id", "p", "text_view", "slots"])

    id_type = free.limit(0).select("id").toArrow().schema.field(0).type
    kind = free.schema["id"].dataType.simpleString()
    found = map_batches(free.select("id", "h", "text_view", "slots"), run, f"teacher int, label int, gain double, h bigint, id {kind}, p double, "
                        "text_view array<double>, slots array<double>")
    order = Window.partitionBy("teacher", "label").orderBy(F.col("gain").desc(), "h")
    limit = F.when(F.col("label") == 1, most[1]).otherwise(most[0])
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(most)).where(F.col("n") <= limit).orderBy(
        "teacher", "label", "n").toPandas()


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, free: DataFrame | None, *, rounds: int = ROUNDS,
             most: int = TAUGHT_A_ROUND) -> Model:
    """Co-train on labelled rows ``views``, ``y`` and the unlabelled rows of the features table ``free``.

    Every fourth labelled row calibrates."""
    if np.unique(y).size < 2:  # nothing to tell apart: the prior
        p = float(y.mean()) if y.size else 0.5
        flat = [View(np.zeros(v.shape[1]), np.array([0.0, float(_odds(np.array([p]))[0])])) for v in views]
        return Model(flat[0], flat[1], np.array([0.5, 0.5, 0.0]))
    held = np.arange(y.size) % 4 == 3
    if np.unique(y[held]).size < 2 or np.unique(y[~held]).size < 2:
        held[:] = True  # too few rows to set some aside
    own = ~held if not held.all() else held
    prior = float(y.mean())
    # In the proportion of the labelled classes.
    share = (max(1, round(most * (1 - prior))), max(1, round(most * prior)))
    lessons = [Lesson(np.empty((0, v.shape[1])), np.empty(0), np.empty(0), set()) for v in views]  # what each view was taught
    taught = []
    for step in range(rounds + 1):
        fitted = tuple(_fit_view(np.vstack((v[own], k.x)), np.concatenate((y[own], k.belief)), np.concatenate((np.ones(own.sum()), k.weight)),
                                 v[held], y[held]) for v, k in zip(views, lessons, strict=True))
        if step == rounds or free is None:
            break
        got = _surest(free, fitted, prior, (lessons[1].ids, lessons[0].ids), share)
        counts = []
        for teacher in (0, 1):
            rows = got[got["teacher"] == teacher]
            counts.append(len(rows))
            if len(rows):
                x = np.vstack(rows["text_view"].to_list()) if teacher else meta_features(np.vstack(rows["slots"].to_list()))
                lessons[1 - teacher].add(x, rows["p"].to_numpy(), rows["gain"].to_numpy(), rows["id"].to_list())
        taught.append(tuple(counts))
    t, m = fitted[0](views[0][held]), fitted[1](views[1][held])
    return Model(fitted[0], fitted[1], _fit_mix(t, m, y[held]), taught)


def _columns(docs: DataFrame, cols: tuple[str, str, str, str, str]) -> DataFrame:
    id_col, text_col, lang_col, source_col, size_col = cols
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                       F.col(lang_col).cast("string").alias("l"), F.col(source_col).cast("string").alias("s"),
                       F.col(size_col).cast("double").alias("n"))


def _seen(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Text view and metadata slots of a batch, from its text, language, source and size."""
    t, l, s, n = columns
    return (text_features(*hashing.string_buffers(t)),
            meta_slots(l.cast(pa.string()).to_pylist(), s.cast(pa.string()).to_pylist(),
                       n.cast(pa.float64()).to_numpy(zero_copy_only=False)))


def _views(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    text, slots = _seen(columns)
    return text, meta_features(slots)


def _features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m = _seen(batch.columns[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(t), pa.list_(pa.float64())), pa.array(list(m), pa.list_(pa.float64()))],
                ["id", "text_view", "slots"])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text_view array<double>, "
                                "slots array<double>")


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def train(docs: DataFrame, labels: DataFrame, *, cols: tuple[str, str, str, str, str] = COLUMNS,
          label_col: str = "quality", a_class: int = SAMPLE_A_CLASS) -> Model:
    """Co-train on at most ``a_class`` labelled rows of each class, by hash of the id, and on all documents without a label row."""
    rows = _columns(docs, cols)
    known = (labels.where(learnable(cols[0]) & F.col(label_col).isin(0, 1))
             .groupBy(F.col(cols[0]).alias("id")).agg(F.min(label_col).alias("y")))
    order = F.xxhash64(F.col("id"), F.lit(17))
    ids = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(order, "id").limit(a_class)
        ids = some if ids is None else ids.unionByName(some)
    features = cut(_features(rows.where("id is not null")).withColumn("h", order), "quality-features")
    ids = ids.select("id", F.col("y").cast("int").alias("y"))
    got = features.join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy("h", "id").toPandas()
    free = cut(features.join(labels.select(F.col(cols[0]).alias("id")), "id", "left_anti"), "quality-free")
    stack = lambda name, width: np.vstack([np.zeros((0, width)), *got[name].to_list()])
    views = (stack("text_view", TEXT_FEATURES), meta_features(stack("slots", 3)))
    model = co_train(views, got["y"].to_numpy(float), free)
    uncut(features, free)
    return model


def quality_scores(docs: DataFrame, model: Model, *, cols: tuple[str, str, str, str, str] = COLUMNS,
                   least: float = 0.5) -> DataFrame:
    """(id, text_score, meta_score, score, predicted) for every row: calibrated views, their combination, 1 if kept.

    Null text is empty; null language, source or size are values of their own;
    repeated rows each have a score; an empty table gives no rows.
    """
    rows = _columns(docs, cols)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x, y = _views(batch.columns[1:])
            t, m = model.text(x), model.meta(y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(t), pa.array(m), pa.array(model.combine(t, m))],
                ["id", "text_score", "meta_score", "score"])

    out = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text_score double, "
                               "meta_score double, score double")
    return out.select(F.col("id").alias(cols[0]), "text_score", "meta_score", "score",
                      F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def quality_filter(docs: DataFrame, model: Model, *, cols: tuple[str, str, str, str, str] = COLUMNS,
                   least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns as they are; a map."""
    at = [docs.columns.index(c) for c in cols[1:]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x, y = _views([batch.column(i) for i in at])
            keep = model.combine(model.text(x), model.meta(y)) >= least
            yield batch.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)
