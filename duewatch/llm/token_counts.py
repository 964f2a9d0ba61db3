"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a text form a doubly linked list; a heap holds every adjacent
pair that the vocabulary can merge, by rank and then position. The lowest is
popped and merged again and again; the count is the initial symbols less the
merges. No identifiers are made. A character outside the vocabulary starts as
one symbol per UTF-8 byte and never merges.

Only the vocabulary file is read through its library; merging is done here.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewatch.llm.shared import map_batches

SPACE = "▁"
CACHE = 600_000


class PieceMerger:
    """Merge ranks of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = [i for i in range(model.get_piece_size())
                   if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in special}
        # Texts may be cut where no piece has the two characters side by side. That is
        # before a run of spaces and around line feeds, unless this vocabulary says otherwise.
        whole = any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank)
        self.chunks = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall

    def count_chunk(self, chunk: str) -> int:
        rank = self.rank
        if chunk in rank and len(chunk) == 1:
            return 1
        symbols = list(chunk)
        total = sum(1 if s in rank else len(s.encode("utf-8", "replace")) for s in symbols)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := rank.get(symbols[i] + symbols[i + 1])) is not None:
                heap.append((r, i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or after[i] != j or symbols[i] + symbols[j] != piece:
                continue  # one side has merged since
            merges += 1
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(piece + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, k, piece + symbols[k]))
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, i, symbols[h] + piece))
        return total - merges


class _Counts(dict):
    """Counts of chunks seen by this task: two generations of bounded size, so that common chunks stay."""

    def __init__(self, merger: PieceMerger, most: int):
        self.merger, self.most, self.old = merger, most, {}

    def __missing__(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            n = self.merger.count_chunk(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = n
        return n


_merger: dict[str, tuple[PieceMerger, _Counts]] = {}


def count_tokens(text: str, merger: PieceMerger, counts: dict[str, int]) -> int:
    if not text:
        return 0
    return sum(map(counts.__getitem__, merger.chunks(SPACE + text.replace(" ", SPACE))))


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, cache: int = CACHE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row's whole text.

    No shuffle: one scan, one Python worker per task that keeps at most
    2 * ``cache`` counted chunks. Null and empty texts have 0 bytes and tokens;
    repeated rows are each counted; other columns are not read. Every executor
    needs the vocabulary file at ``model_path``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _merger:
            m = PieceMerger(model_path)
            _merger[model_path] = (m, _Counts(m, cache))
        merger, counts = _merger[model_path]
        for batch in batches:
            texts = batch.column(1)
            n = [count_tokens(t.as_py(), merger, counts) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.as_buffer()) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    out = map_batches(rows, run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
