"""Neighbours, prefix trie and cross-tokenizer alignment against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duewatch.llm import alignment, prefix_trie, vantage

from .conftest import EDGE, make_docs

# Nearest neighbours ----------------------------------------------------------------------------------------------


def nearest_brute(rows, k=10, every=100):
    valid = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    ids, vecs = np.array([i for i, _ in valid]), np.array([v for _, v in valid], float)
    out = {}
    for q in {i for i, _ in valid if i % every == 0}:
        own = vecs[np.flatnonzero(ids == q)[0]]
        far = np.sqrt(((vecs - own) ** 2).sum(1))
        by = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(far[j])) for j in by]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def same(got, want):
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w] and np.allclose([s for _, s in got[q]], [s for _, s in w], 1e-12, 1e-12)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    clustered = rng.normal(size=(7, 12))[rng.integers(0, 7, 700)] + 0.2 * rng.normal(size=(700, 12))
    vecs = [v.tolist() for v in clustered.astype(np.float32)]
    vecs[200:420] = [vecs[200]] * 220          # one very common vector, queries among its rows
    vecs[500:503] = [[float(np.float32(1e18))] * 12, [0.0] * 12, [float("nan")] * 12]
    grid = [[float(a), float(b)] + [0.0] * 10 for a in range(1, 9) for b in range(1, 9)]  # many ties
    rows = list(enumerate(vecs + grid))
    return rows + [(None, vecs[0]), (9000, None), (9100, []), (9200, [1.0, None] + [0.0] * 10), (9300, [1.0]), (0, vecs[0])]


SCHEMA = "vec_id long, embedding array<float>, id string, vec string, point string"


def test_neighbours_exact_at_factor_one(spark, vectors):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in vectors], SCHEMA)
    want = nearest_brute(list(dict.fromkeys((i, v if v is None else tuple(v)) for i, v in vectors if i != 9300)))
    for shard, block in ((4096, 16_384), (60, 2)):
        same(answers(vantage.neighbours(df, F.col("id") % 100 == 0, factor=1.0, shard=shard, block=block)), want)


def test_neighbours_recall_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = nearest_brute([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])
    found = vantage.neighbours(df, F.col("id") % 100 == 0)
    got = answers(found)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert {len(g) for g in got.values()} == {10} and got == answers(found)
    few = df.where("vec_id in (0, 1, 2)")
    same(answers(vantage.neighbours(few, F.col("id") % 100 == 0)), {0: want_of(few)})
    assert vantage.neighbours(df.where("vec_id = 0"), F.col("id") % 100 == 0).count() == 0
    assert vantage.neighbours(df.where("false"), F.col("id") % 100 == 0).count() == 0


def want_of(df):
    return nearest_brute([(r.vec_id, r.embedding) for r in df.collect()])[0]


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(300, 8)) * 0.05 + c for c in rng.normal(size=(8, 8)) * 5])
    tree = vantage.Tree(np.arange(len(points)), points, leaf=16)
    seen = []
    leaf = vantage.Walk._leaf
    vantage.Walk._leaf = lambda self, lo, hi, rows: (seen.append((hi - lo) * rows.size), leaf(self, lo, hi, rows))[1]
    try:
        found = vantage.search(vantage.Tree.unpacked(tree.packed()), points[::50], 5, 1.0)
    finally:
        vantage.Walk._leaf = leaf
    far = np.sqrt(((points[::50, None] - points) ** 2).sum(2))
    assert np.allclose(found.far, np.sort(far, 1)[:, :5]) and sum(seen) < 0.3 * far.size


# Prefix trie -----------------------------------------------------------------------------------------------------

def trie_brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(seqs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(words(p[-1][1])) if p else 0
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in cs if built[c] == p))).encode()).hexdigest())
                  for p, cs in members.items())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def trie_rows(df):
    return sorted(tuple(r) for r in df.collect())


def trie(df):
    return prefix_trie.prefix_trie(prefix_trie.with_shared_openings(prefix_trie.sequences(df)))


def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 130), -7, -20, 1000, 1021]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a  b\tc", "", "é one"])))
    rows += [(c, t, "user", "same words here") for c in range(200, 300) for t in range(4)]     # one large group of copies
    rows += [(400, t, "user", f"turn {t}") for t in range(300)] + [(401, t, "user", f"turn {t}") for t in range(280)]
    rows += [(60, None, "user", "first"), (60, 0, None, None), (60, 0, None, None), (None, 0, "user", "lost"), (61, 1, "", "tie"),
             (61, 1, "", "tia"), (500, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("batch", ["3", "17", "10000"])
def test_trie_brute(spark, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn int, role string, text string, conv string, turns string")
    spark.conf.set(name, batch)
    try:
        assert trie_rows(trie(df)) == trie_brute(rows)
    finally:
        spark.conf.set(name, old)


def test_trie_small(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert trie(df).count() == 0
    one = spark.createDataFrame([(21, 0, "user", "a b c")], df.schema)  # crc32 takes its opening from conversation 20, which isn't there
    assert trie_rows(trie(one)) == trie_brute([(21, 0, "user", "a b c")])


def test_range_minima():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 5, 41)
    levels = prefix_trie.sparse_table(values)
    lo = rng.integers(0, 41, 200)
    hi = np.minimum(40, lo + rng.integers(0, 41, 200))
    assert prefix_trie.range_min(levels, lo, hi).tolist() == [values[a:b + 1].min() for a, b in zip(lo, hi, strict=True)]
    at, depth = rng.integers(0, 42, 300), rng.integers(1, 6, 300)
    left, right = prefix_trie.extents(levels, at, depth)
    for i, d, a, b in zip(at, depth, left, right, strict=True):
        want_a = want_b = i
        while want_a and values[want_a - 1] >= d:
            want_a -= 1
        while want_b < 41 and values[want_b] >= d:
            want_b += 1
        assert (a, b) == (want_a, want_b)


# Cross-tokenizer alignment ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def groups_of(a, b, bytes_a, bytes_b):
    ends = [set(np.cumsum([len(t[i]) for i in x]).tolist()) for x, t in ((a, bytes_a), (b, bytes_b))]
    out, sides = [], [[], []]
    for e in sorted(ends[0] & ends[1]):
        group = []
        for x, t, done in ((a, bytes_a, sides[0]), (b, bytes_b, sides[1])):
            ids = []
            while len(done) < len(x) and (sum(done) + len(t[x[len(done)]])) <= e:
                ids.append(x[len(done)])
                done.append(len(t[x[len(done)]]))
            group.append(ids)
        out.append(group)
    return out


def align_brute(texts, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = alignment.ByteLevel(paths[0]), alignment.Pieces(paths[1])
    model_a, model_b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    model_a.encode_special_tokens = True
    links, out, docs = [], [], Counter()
    for t in texts:
        t = t or ""
        a, b = model_a.encode(" " + t, add_special_tokens=False).ids, model_b.encode(t)
        want = (" " + t).encode()
        if not t or b"".join(one.bytes[i] for i in a) != want or b"".join(two.bytes[i] for i in b) != want:
            links.append(Counter())
            out.append((0, 0, 0, 0, ""))
            continue
        groups = groups_of(a, b, one.bytes, two.bytes)
        count = Counter()
        for x, y in groups:
            x, y = Counter(x), Counter(y)
            for i in x:
                for j in y:
                    count[i, j] += x[i] * y[j]
        links.append(count)
        docs.update(count.keys())
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(count.values()), hashlib.sha256(text.encode()).hexdigest()))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [(*o[:4], sum(m for p, m in c.items() if docs[p] == most[p[0]]), sum(m * docs[p] for p, m in c.items()), o[4])
            for o, c in zip(out, links, strict=True)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HOSTILE = ["<|endoftext|> and </s><s> <unk>", "▁under▁", "a\0b", "﻿x", "  two  spaces ", "\n\n\tx\r\n", "日本語テキスト 😀😀", "Zażółć gęślą jaźń",
           "0123456789" * 30, "ﬁ ½ Å", "x" * 3000, "same text twice", "same text twice"]


def test_alignment_brute(spark, paths, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 60").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 4000] + [(1000 + i, t) for i, t in enumerate([*HOSTILE, "", None])]
    want = {i: w for (i, _), w in zip(texts, align_brute([t for _, t in texts], paths), strict=True)}
    got = alignment.alignment(make_docs(spark, texts, ["row", "unit", "pair", "docs", "links", "kind", "planes"]), *paths).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(texts)


def test_alignment_edges(edge, empty, paths):
    rows = alignment.alignment(edge, *paths).collect()
    assert len(rows) == len(EDGE) and {tuple(r[c] for c in COLUMNS) for r in rows if r.doc_id in (2, 3)} == {(0, 0, 0, 0, 0, 0, "")}
    assert [r.n_a for r in rows if r.doc_id == 5][0] > 100_000
    assert len({tuple(r) for r in rows if r.doc_id == 0}) == 1
    assert alignment.alignment(empty, *paths).count() == 0


def test_units_and_shares(spark, paths, monkeypatch):
    """Small limits: many units, and documents whose links come in several shares."""
    texts = [f"word{i % 7} and {'x' * i} number {i}" for i in range(60)] + ["y" * 400]
    one, two = alignment.tokenizer(paths[0]), alignment.tokenizer(paths[1])
    sizes = [np.array([len(x) for x in t.bytes]) for t in (one, two)]
    made = alignment.cut_texts(one.encode(texts), two.encode(texts), *sizes)
    whole = list(alignment.postings(made, made.doc, len(two.bytes)))
    assert len(whole) == 1 and whole[0][2]
    want = dict(zip(whole[0][0].tolist(), whole[0][1].tolist(), strict=True))
    monkeypatch.setattr(alignment, "PIECE_LINKS", 10)
    monkeypatch.setattr(alignment, "UNIT_POSTINGS", 40)
    parts = list(alignment.postings(made, made.doc, len(two.bytes)))
    got = [(k, n) for p in parts for k, n in zip(p[0].tolist(), p[1].tolist(), strict=True)]
    assert len(parts) > 3 and len(got) == len(want) and dict(got) == want


def test_bitmaps():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 6, 9000) << 16 | rng.integers(0, 5000, 9000) % (1 + rng.integers(0, 5000, 9000)))
    halves = [np.sort(rng.choice(key, key.size // 2, replace=False)), np.sort(rng.choice(key, key.size // 2, replace=False))]
    maps = [alignment.Bitmaps.of(h >> 16, h & 0xFFFF, 625) for h in halves]
    assert all(len(m.many) for m in maps)
    for width in (625, 8192):
        merged = alignment.or_merge(maps, width)
        want = Counter((np.unique(np.concatenate(halves)) >> 16).tolist())
        assert dict(zip(*(x.tolist() for x in merged.popcount()), strict=True)) == dict(want)
        back = np.sort(np.concatenate([(p << 16) | s for p, s in merged.postings()]))
        assert np.array_equal(back, np.unique(np.concatenate(halves)))


def test_unit_counts_links():
    unit = alignment.Unit(7)
    key = np.array([3 << 16, 3 << 16 | 1, 4 << 16 | 2])
    unit.add(key, np.array([5, 1, 2]))
    unit.add(np.array([3 << 16 | 3]), np.array([9]))
    unit.docs = 4
    pairs, docs, links, planes = unit.closed()
    assert (pairs.tolist(), docs.tolist(), links.tolist()) == ([3, 4], [3, 1], [15, 2])
    assert len(alignment.unpacked(planes)) == 4
    table = pa.table({"row": [7], "docs": [4], "planes": pa.array([planes], pa.binary())})
    scores = pa.table({"pair": [4, 3], "docs": [10, 3], "best": [True, False]})
    got = alignment._return_scores(None, table, scores).to_pydict()
    assert got == {"row": [7, 8, 9, 10], "count_sum": [15, 3, 20, 27], "n_best": [0, 0, 2, 0]}


def test_quick_encoding_equals_the_library(paths):
    """Every plain character in every kind of neighbourhood, and random texts of them."""
    one = alignment.ByteLevel(paths[0])
    chars = [c for c in map(chr, range(0x300)) if alignment.PLAIN.fullmatch(c)]
    rng = random.Random(6)
    texts = [f"a{c} a{c}a 1{c}1 {c} {c}{c}  {c}!{c}!'{c}'s{c}\n{c}" for c in chars]
    texts += ["".join(rng.choice(chars if rng.random() < 0.5 else "  \n\t'stldvmre1234abc") for _ in range(80)) for _ in range(5000)]
    assert one.quick and len(chars) > 500
    quick = one.encode(texts)
    one.quick = None
    assert quick == one.encode(texts)
