"""Operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duewatch.llm import (chat_format, components, decontaminate, exact_dedup, hashing, jaccard_join, line_dedup, mixing,
                          pii, quality, token_counts, toxicity)
from duewatch.llm.shared import shared_dir

from .conftest import make_docs

SF = "/root/testdata/sf0.01"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture()
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    links += [(999, k) for k in range(1000, 1100)]
    union = Union(range(1200))
    for a, b in links:
        union.join(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: union.find(x) for a, b in links if a != b for x in (a, b)}


def test_components_in_blocks(spark, monkeypatch):
    """Forests of small blocks, which cut across components, leave the components as they are."""
    monkeypatch.setattr(components, "BLOCK", 37)
    rng = random.Random(6)
    links = [(rng.randrange(500), rng.randrange(500)) for _ in range(400)] + [(7000 + rng.randrange(40), 7000 + rng.randrange(40)) for _ in range(3000)]
    union = Union(range(7100))
    for a, b in links:
        union.join(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: union.find(x) for a, b in links if a != b for x in (a, b)}
    a, b = components.forest(np.array([5, 9, 9, 1, 3]), np.array([9, 5, 1, 1, 2]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 2), (5, 1), (9, 1)]


def test_words_and_shingles_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    rows = ["".join(rng.choice("ab C\t\né") for _ in range(rng.randrange(400))) for _ in range(40)] + ["", " ", None]
    data, offsets = hashing.string_buffers(pa.array(rows))
    whole = hashing.words(data, offsets, 0, len(rows))
    monkeypatch.setattr(hashing, "WINDOW", 64)
    parts = [hashing.words(data, offsets, i, i + 1)[0] for i in range(len(rows))]
    assert np.array_equal(np.concatenate(parts), whole[0])
    seen = {}
    for text, hashes in zip(rows, parts, strict=True):
        words = WORDS.findall((text or "").encode().lower())
        assert len(words) == hashes.size
        for w, h in zip(words, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def jaccard_brute(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    held, union = {}, Union(sets)
    for i, s in sorted(sets.items()):
        seen = {}
        for g in s:
            for j in held.setdefault(g, []):
                seen[j] = seen.get(j, 0) + 1
            held[g].append(i)
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, texts, words, percent):
    got = jaccard_join.jaccard_classes(docs, words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_brute(texts, words, percent)


def test_jaccard_family(spark):
    """A large family of drifting near copies: chains of links must hold though not every pair is tried."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    family = [[word() for _ in range(70)]]
    for _ in range(250):
        w = list(rng.choice(family[-60:]))
        w[rng.randrange(70)] = word()
        family.append(w)
    texts = {i: " ".join(w) for i, w in enumerate(family)}
    got = jaccard_join.jaccard_classes(make_docs(spark, list(texts.items()))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_brute(texts, 3, 90)


def test_jaccard_one_id_on_different_texts(spark):
    """Merged sources with their own numbering: each text of an id is compared, and they share a component."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1) + " end"), (1, text(2) + " end"), (1, text(3) + " end"), (5, text(1)), (6, text(2)), (7, text(3)), (8, text(4))]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_classes(make_docs(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (5, 1), (6, 1), (7, 1), (8, 8)]


def test_exact(spark, docs):
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(duckdb.sql(f"SELECT {', '.join(cols)} FROM ({exact_dedup.ORACLE})").fetchall())
    for bits in (26, 6):  # a filter that is far too small changes nothing but what shuffles
        assert sorted(tuple(r[c] for c in cols) for r in exact_dedup.exact_groups(docs, bits=bits).collect()) == want
    kept = sorted(r[0] for r in want if r[3])
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs, bits=6).select("doc_id").collect()) == kept


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii(spark, texts):
    rng = random.Random(3)
    parts = ["a", "b.", "@", "c.d", ".", "1", "23", "255", "-", " ", "+", "(", ")", "_", "%", "é", "😀", "4111 1111 1111 1111",
             "1.2.3.4", "x@y.z", "+1 555 123-4567", "\n", "password=abc12345", "000", " 555-123-4567 ", "ann [at] mail [dot] com"]
    rows = dict(texts)
    for k in range(1500):
        rows[10_000 + k] = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
    for k, t in enumerate(["a" * 150_000 + "@b.c", "1" * 60_000, "1 " * 30_000, "a@b" + ".c" * 30_000, "1.1.1.1 " * 2000]):
        rows[20_000 + k] = t
    got = {r.doc_id: r for r in pii.pii_digest(make_docs(spark, list(rows.items()))).collect()}
    for i, t in rows.items():
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t[:80]
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))
        assert got[i].n_ip == want.count("ip:") and got[i].n_card == want.count("card:")


def test_tokens(spark, texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    rows = dict(texts)
    for k in range(3000):
        rows[10_000 + k] = "".join(rng.choice("ab e  \n\t▁éß日😀.,019<s>/") for _ in range(rng.randrange(60)))
    rows[20_000], rows[20_001] = "a" * 3000, " " * 500
    got = token_counts.token_counts(make_docs(spark, list(rows.items())), path, cache=500).collect()
    for r in got:
        assert r.n_tokens == len(model.encode(rows[r.doc_id])) and r.n_bytes == len(rows[r.doc_id].encode())


def test_line_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(5000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(14)))
        b = bytearray(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2)))
        k = rng.randrange(5)
        assert line_dedup.banded_distance(a, bytes(b), k) == min(plain(a, bytes(b)), k + 1)


def test_lines(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ijkl é") for _ in range(rng.randint(18, 60))).strip() for _ in range(40)]

    def edited(x):
        b = list(x)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b))
            b[at:at + rng.randrange(2)] = rng.choice(["x", "", "z"])
        return "".join(b)

    line = lambda: edited(rng.choice(base)) if rng.random() < 0.8 else rng.choice(
        ["", "  ", "short", "Short ", f"user {rng.randrange(10 ** 6):06d} logged in at home"])
    texts = {i: "\n".join(line() for _ in range(rng.randrange(12))) for i in range(120)} | {500: None, 501: "\n\n"}
    seen = [(i, k, b) for i, t in texts.items() for k, x in enumerate((t or "").split("\n"))
            if (b := x.encode().strip(b" \t\n\x0b\x0c\r").lower())]
    distinct = sorted({b for _, _, b in seen})
    union = Union(distinct)
    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if min(len(a), len(b)) >= 20 and line_dedup.banded_distance(a, b, 2) <= 2:
                union.join(a, b)
    first = {}
    for i, k, b in seen:
        first.setdefault(union.find(b), (i, k))
    docs = make_docs(spark, list(texts.items()))
    got = {(r.doc_id, r.line): (r.first_id, r.first_line) for r in line_dedup.line_classes(docs).collect()}
    assert got == {(i, k): first[union.find(b)] for i, k, b in seen}
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(docs, line_dedup.line_digest(docs)).collect()}
    for i, t in texts.items():
        stays = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in got or got[(i, k)] == (i, k)]
        assert out[i] == (None if t is None else "\n".join(stays))


def test_long_lines(spark):
    """Long lines are near within a twentieth of the longer one's bytes: swapped, added and dropped words."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7)))

    def edited(w):
        w = list(w)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(2)] = rng.choice([[word()], []])
        return w

    base = [[word() for _ in range(n)] for n in (11, 12, 13, 14, 15, 16, 17, 18, 20, 25, 30, 40, 60, 90, 140, 300) for _ in range(3)]
    lines = sorted({" ".join(edited(w)).encode() for w in base for _ in range(9)})
    union = Union(lines)
    wide = 0
    for n, a in enumerate(lines):
        for b in lines[:n]:
            longer = max(len(a), len(b))
            most = longer // 20 if longer >= 80 else 2
            if abs(len(a) - len(b)) <= most and line_dedup.banded_distance(a, b, most) <= most:
                wide += line_dedup.banded_distance(a, b, 2) > 2
                union.join(a, b)
    assert wide > 100
    at = {i: b for i, b in enumerate(rng.sample(lines, len(lines)))}
    first = {}
    for i, b in at.items():
        first.setdefault(union.find(b), i)
    docs = make_docs(spark, [(i, b.decode()) for i, b in at.items()])
    assert {r.doc_id: r.first_id for r in line_dedup.line_classes(docs).collect()} == {i: first[union.find(b)] for i, b in at.items()}


def test_lines_meet_seldom_by_chance(spark, monkeypatch):
    """Long lines of few words, or of one word repeated, write few keys, each line once."""
    rng = random.Random(11)
    few = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(20)})
    lines = [" ".join(rng.choice(few) for _ in range(70)) for _ in range(500)] + [" ".join([w] * 500) for w in few]
    near = lines[3].split()
    near[40] = "zzzz"
    texts = [*lines, " ".join(near), *lines[:40]]
    written = {}

    def counted(df, label, *folders, cut=line_dedup.cut):
        out = cut(df, label, *folders)
        if label in ("line-probes", "line-index"):
            written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    got = {r.doc_id: r.first_id for r in line_dedup.line_classes(make_docs(spark, list(enumerate(texts)))).collect()}
    n = len(lines)
    assert got == {i: i for i in range(n)} | {n: 3} | {n + 1 + i: i for i in range(40)}
    assert sum(written.values()) < 2000, written


def test_lines_with_a_passage_elsewhere(spark, monkeypatch):
    """Lines that have a passage in common, at places that no near lines' edits allow, write no keys for it; near ones meet."""
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = text(200)
    lines = [(p := text(24 + 9 * k)) + passage + text(400 - len(p)) for k in range(30)]
    texts = [*lines, *(x[:300] + text(20) + x[320:] for x in lines)]
    written = {}

    def counted(df, label, *folders, cut=line_dedup.cut):
        out = cut(df, label, *folders)
        if label in ("line-probes", "line-index"):
            written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    got = {r.doc_id: r.first_id for r in line_dedup.line_classes(make_docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: i % 30 for i in range(60)}
    assert sum(written.values()) < 4000, written


def test_near_pairs():
    """Pairs compared together are near as by their distances, also where those are many."""
    rng = random.Random(14)
    pairs = []
    for n in [*range(20, 100, 3), *range(100, 1500, 60), 6000, 7000]:
        a = "".join(rng.choice("abcdé ") for _ in range(n)).encode()
        for share in (0, 0.02, 0.04, 0.05, 0.06, 0.1):
            b = bytearray(a)
            for _ in range(round(share * len(a))):
                at = rng.randrange(len(b))
                b[at:at + rng.randrange(2)] = bytes(rng.choice(b"abz") for _ in range(rng.randrange(2)))
            pairs += [(a, bytes(b)), (bytes(b), a)]
    got = line_dedup.near_pairs(*(pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)), 2)
    want = [line_dedup.banded_distance(a, b, most) <= most for a, b in pairs for most in [line_dedup.edits(max(len(a), len(b)), 2)]]
    assert list(got) == want and 100 < sum(want) < len(want) - 50


def test_lines_in_classes(spark, monkeypatch):
    """Filters for few lines each find the same pairs, also between lines of two classes."""
    monkeypatch.setattr(line_dedup, "CLASS_KEYS", 300)
    rng = random.Random(12)
    lines = []
    for n in range(85, 600, 23):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n - 2)).join("xy")
        at = rng.randrange(n // 2)
        lines += [a, a[:at] + "q" * (n // 21) + a[at:], a[:at] + a[at + n // 20:]]
    docs = make_docs(spark, list(enumerate(lines)))
    got = {r.doc_id: r.first_id for r in line_dedup.line_classes(docs).collect()}
    assert got == {i: i - i % 3 for i in range(len(lines))}


def test_lines_of_two_classes_meet_at_one_place(spark, monkeypatch):
    """A line's own key, too, meets the longer lines of the next class: all but the first segment differ."""
    n = int(next(r for r in line_dedup._RANGES if r > 120 and line_dedup.GRAM <= line_dedup._SIZES[line_dedup.range_of(r)] == line_dedup._SIZES[line_dedup.range_of(r) - 1]))
    k = n // 20
    rng = random.Random(15)
    a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    b = list(a)
    for i in range(1, k + 1):
        place, size = line_dedup._segment(np.array([n]), i, k)
        b[int(place[0]) + int(size[0]) // 2] = "#" if i < k else ""
    assert line_dedup.banded_distance(a.encode(), "".join(b).encode(), k) == k
    monkeypatch.setattr(line_dedup, "CLASS_KEYS", 1)
    got = {r.doc_id: r.first_id for r in line_dedup.line_classes(make_docs(spark, [(0, a), (1, "".join(b))])).collect()}
    assert got == {0: 0, 1: 0}


def test_lines_of_a_class_are_done_before_the_next(spark, monkeypatch):
    """Keys, pairs and texts of one class of lengths stand on the disks at a time; shuffle files go with the tables they are for."""
    monkeypatch.setattr(line_dedup, "CLASS_KEYS", 80)
    rng = random.Random(16)
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(n - 2)).join("xy") for n in range(90, 500, 40)]
    texts = [*lines, *(x[:40] + "##" + x[42:] for x in lines)]
    made, standing = [], []

    def counted(df, label, *folders, cut=line_dedup.cut):
        made.append(label)
        assert df.sparkSession.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
        out = cut(df, label, *folders)
        standing.append(sum(x in now for x in ("line-probes", "line-under", "line-open", "line-texts")
                            for now in os.listdir(shared_dir(spark).removeprefix("file:")) if now not in before))
        return out

    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    monkeypatch.setattr(line_dedup, "cut", counted)
    got = {r.doc_id: r.first_id for r in line_dedup.line_classes(make_docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: i % len(lines) for i in range(len(texts))}
    assert made.count("line-index") > 2 and max(standing) <= 3, standing


def test_lines_met_in_small_batches(spark):
    """Keys of two lines give one row, of more all theirs, also where batches end between or within them."""
    rng = random.Random(17)
    rows = [(key, 100 * h + key, 20 + h, 5, probe) for key in range(120) for probe in (False, True) for h in rng.sample(range(40), rng.choice([0, 0, 1, 1, 2, 5, 12]))]
    rows = list({r[:2]: r for r in rows}.values())
    want = set()
    for key in range(120):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[4], -r[2], r[1]))
        if len(own) > 1 and not own[0][4]:
            want |= {(r, own[0][1], len(own) > 2) for r in own[len(own) == 2:]}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size, repeated in ((1, 0), (2, 0), (3, 0), (7, 0), (10_000, 0), (10_000, 1)):
            spark.conf.set(name, str(size))
            keys = spark.createDataFrame(rows + rows * repeated, "key long, h long, n int, place int, probe boolean")
            got = [((r.key, r.h, r.n, r.place, r.probe), r.pivot_h, r.many) for r in line_dedup._met(keys).collect()]
            assert len(got) == len(set(got)) and set(got) == want, size
    finally:
        spark.conf.set(name, before)


def test_line_sketches():
    """Parities never tell near lines apart, and nearly always lines that have a passage in common."""
    rng = random.Random(18)
    few = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(1500)]
    text = lambda n: " ".join(rng.choice(few) for _ in range(n))
    near, other = [], []
    for n in (5, 12, 20, 30, 60, 100, 250, 900, 3000):
        for _ in range(12):
            a = text(n).encode()
            b = bytearray(a)
            for _ in range(line_dedup.edits(int(len(a) * 0.95), 2)):
                at = rng.randrange(len(b))
                b[at:at + rng.randrange(2)] = bytes(rng.choice(b"abz") for _ in range(rng.randrange(2)))
            near.append((a, bytes(b)))
            c = a[:len(a) // 3] + text(n).encode()
            other.append((a, c[:len(a)].ljust(len(a), b"x")))

    def differ(pairs):
        made = [line_dedup._sketch(*hashing.string_buffers(pa.array([p[i] for p in pairs], pa.binary()))) for i in (0, 1)]
        most = np.array([line_dedup.edits(max(map(len, p)), 2) for p in pairs])
        odd = np.bitwise_count((made[0][0] ^ made[1][0]).view(np.uint64)).sum(axis=1)
        return (odd > 4 * most) | (line_dedup._differ(*(pa.array(m[1], pa.binary()) for m in made)) > 2 * line_dedup.SKETCH * most)

    assert not differ(near).any()
    assert differ([p[::-1] for p in other]).mean() > 0.95


def test_decontaminate(spark, docs, texts):
    bench = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    rng = random.Random(6)
    rows = dict(texts)
    for k in range(60):  # items with one word changed near their end, within other text, in other case
        w = words(rng.choice(list(bench.values())))
        w[-1 if k % 2 else len(w) // 2] = "changed"
        rows[10_000 + k] = "Some text before, " + " ".join(w).upper() + " and after it."
    counts = lambda w: {g: n for g, n in zip(*np.unique([" ".join(w[k:k + 5]) for k in range(len(w) - 4)],
                                                         return_counts=True), strict=True)}
    items = {b: (len(words(t)), counts(words(t))) for b, t in bench.items()}
    known = {g for _, c in items.values() for g in c}
    want = {}
    for i, t in rows.items():
        w = words(t)
        if not any(" ".join(w[k:k + 5]) in known for k in range(len(w) - 4)):
            continue
        for b, (n, c) in items.items():
            best = 0.0
            for s in range(max(1, len(w) - n + 1)):
                x = counts(w[s:s + n])
                both = sum(min(v, c.get(g, 0)) for g, v in x.items())
                best = max(best, both / (sum(x.values()) + sum(c.values()) - both))
            if best >= 0.8:
                want[(i, b)] = round(best, 9)
    got = decontaminate.benchmark_hits(make_docs(spark, list(rows.items())), spark.read.parquet(f"{SF}/benchmark.parquet"),
                                       items_a_pass=15).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    assert any(0.8 <= v < 1 for v in want.values())


def test_decontaminate_run_of_one_word(spark):
    """Copies of long items that end in one repeated word, at similarity just over 0.8."""
    items = [(k, " ".join(f"w{k}x{i}" for i in range(404))) for k in range(8)]
    rows = [(k, " ".join(t.split()[:360] + ["same"] * 44)) for k, t in items]
    got = decontaminate.benchmark_hits(make_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(8)]
    sh = np.random.default_rng(2).integers(1, 9, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    want = [decontaminate._bit_sums(np.unique(sh[s:s + 12]))[-1] for s in range(49)]
    assert np.array_equal(decontaminate._distinct_sums(sh, 12), want)


def test_block_index_finds_all_within_radius(spark):
    rng = np.random.default_rng(3)
    index = decontaminate.ItemIndex(spark.createDataFrame([(0, "a b c d e f g h")], "item long, t string").toArrow(), 5, 19)
    for n in range(20):
        for _ in range(20):
            flips = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64), initial=np.uint64(0))
            assert index.candidates(index.prints ^ flips, 8)[1].tolist() == [0]


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs, fanout=20).toPandas()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in
             duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    assert dict(zip(rows["doc_id"], rows["size"], strict=True)) == words
    per = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"),
                                     most=("size", "max")).sort_index()
    weight = np.array([(3, 1, 2)[k % 3] for k in range(len(per))], float)
    total, target, open_ = 1.5 * per["size"].sum(), np.zeros(len(per)), np.ones(len(per), bool)
    cap = 2.0 * per["size"].to_numpy()
    while True:
        target[open_] = (total - target[~open_].sum()) * weight[open_] / weight[open_].sum()
        over = open_ & (target > cap)
        if not over.any():
            break
        target[over], open_ = cap[over], open_ & ~over
    assert np.allclose(per["target"], target)
    assert (abs(per["taken"] - per["target"]) <= per["most"]).all()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    again = mixing.mix_sources(docs.repartition(7), fanout=20).toPandas()
    key = ["doc_id", "taken"]
    assert rows[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()


def test_pivots_keep_expectations():
    size = np.array([3, 5, 2, 7, 4, 6], float)
    p = np.array([0.3, 0.6, 0.5, 0.2, 0.8, 0.4])
    total = np.zeros(6)
    for seed in range(4000):
        out = mixing.pivot_round(size, p, mixing._chance(np.arange(6), seed))
        assert np.count_nonzero((out > 0) & (out < 1)) <= 1 and abs(out @ size - p @ size) < 1e-6
        total += out
    assert np.allclose(total / 4000, p, atol=0.03)


def test_chat_matches_sql(spark):
    from duewatch.llm import catalog

    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(duckdb.sql(f"SELECT {', '.join(cols)} FROM ({chat_format.ORACLE})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in catalog.op9_chat_format(spark, SF).collect()) == want


def test_chat_round_trip(spark):
    rng = random.Random(9)
    parts = [*chat_format.MARKERS, "\\", "[", "]", "<", "\n", "x", "INST]", "[\\INST]", "\n[SEP]\n", "\n[/INST]"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
    rows = [(c, k, rng.choice(["user", "assistant", "[ROLE]\n"]), text()) for c in range(60) for k in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(df).select("conv_id", chat_format.read_back(chat_format.formatted()).alias("t")).collect()
    want = {}
    for c, _, role, t in rows:
        want.setdefault(c, []).append((role, t))
    assert {r.conv_id: [tuple(x) for x in r.t] for r in got} == want


def held_out(df, labels, col):
    joined = df.join(labels, "doc_id").where(f"{col} is not null").toPandas()
    joined = joined[[zlib.crc32(str(i).encode()) % 3 == 1 for i in joined["doc_id"]]]
    return joined[col].to_numpy(), joined["score"].to_numpy(), joined["predicted"].to_numpy()


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    scores = toxicity.toxicity(docs, labels)
    y, s, p = held_out(scores, labels, "toxic")
    assert (p == y).mean() > 0.96  # in this table some toxic stems are also built by chance in clean words
    assert s[y == 1].mean() > 0.85 > 0.1 > s[y == 0].mean()
    assert scores.where("held_out != (crc32(cast(cast(doc_id as string) as binary)) % 3 = 1)").count() == 0


def test_toxicity_windows_start_at_every_word(monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 90)))
    model = toxicity.Model(np.random.default_rng(12).normal(size=1 << toxicity.BUCKET_BITS), 0.25)
    logits = lambda rows: model.logits(*hashing.string_buffers(pa.array(rows)))
    texts = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 8, 13, 30) for _ in range(4)]
    want = [max(logits([" ".join(w[k:k + 2]) for k in range(max(1, len(w) - 1))])) for w in texts]
    rows = [rng.choice(["", " ", ". "]) + "".join(x + rng.choice([" ", ", ", "." * 70]) for x in w) for w in texts]
    assert np.allclose(logits(rows), want)
    sample = toxicity._Sample(rows, np.zeros(len(rows), int))
    got = np.full(len(rows), -np.inf)
    np.maximum.at(got, sample.row, sample.logits(model.weight, model.bias))
    assert np.allclose(got, want)
    monkeypatch.setattr(hashing, "WINDOW", 64)  # long texts come in pieces
    assert np.allclose(logits(rows), want)


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.train(docs, labels)
    assert len(model.taught) == quality.ROUNDS and all(min(counts) > 100 for counts in model.taught)  # both ways, in every round
    assert min(model.mix[:2]) >= 0
    y, _, p = held_out(quality.quality_scores(docs, model), labels, "quality")
    assert (p == y).mean() > 0.98 and (p[y == 1] == 1).mean() > 0.995


def test_pipeline_stages(spark, texts):
    """Deterministic stages against brute force, each on what the one before kept."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = stages["exact dedup"](spark, docs, SF)
    groups = {}
    for i, t in texts.items():
        key = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        groups[key] = max(groups.get(key, i), i)
    kept = set(groups.values())
    assert {r.doc_id for r in exact.select("doc_id").collect()} == kept
    near = stages["n-gram Jaccard join"](spark, exact, SF)
    classes = jaccard_brute({i: texts[i] for i in kept}, 5, 80)
    kept = {i for i, (_, c) in classes.items() if c == i}
    assert {r.doc_id for r in near.select("doc_id").collect()} == kept
    clean = stages["benchmark decontamination"](spark, near, SF)
    bench = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    assert left == {i for i in kept if not any(b in texts[i] for b in bench)}
    mixed = stages["mixing to target weights"](spark, clean, SF)
    n = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(clean).collect() if r.copies}
    assert n == copies
