"""Each operator and stage: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import os

import pytest
from pyspark.sql import functions as F

from duewatch.llm import (chat_format, decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality,
                          token_counts, toxicity)

from .conftest import EDGE


@pytest.fixture()
def benchmark(spark):
    return spark.createDataFrame([(0, "beta gamma delta epsilon zeta"), (1, None), (2, ""), (3, "one"), (None, "no id here")],
                                 "item_id long, text string")


def by_id(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


def test_line_dedup(edge, empty):
    rows = {r.doc_id: r for r in line_dedup.line_digest(edge).collect()}
    assert len(rows) == 10 and rows[2].n_lines == rows[3].n_lines == rows[4].n_lines == 0
    assert rows[0].n_dropped == 0 and rows[1].dropped == [0] and rows[8].dropped == [0] and rows[5].n_lines == 1
    assert line_dedup.line_digest(empty).count() == 0
    out = line_dedup.drop_lines(edge, line_dedup.line_digest(edge))
    assert out.columns == edge.columns and out.count() == edge.count()


def test_pii(edge, empty):
    rows = pii.pii_digest(edge).collect()
    assert len(rows) == len(EDGE) and all(r.spans == "" for r in rows)
    assert pii.pii_digest(empty).count() == 0


def test_exact(edge, empty):
    rows = by_id(exact_dedup.exact_groups(edge), "doc_id", "keep_id", "group_size", "kept")
    assert len(rows) == len(EDGE)
    assert (0, 1, 3, False) in rows and (1, 1, 3, True) in rows and (2, 3, 2, False) in rows and (6, 8, 2, False) in rows
    assert (None, None, 1, True) in rows
    out = exact_dedup.exact_dedup(edge)
    assert out.columns == edge.columns
    assert by_id(out, "doc_id") == sorted([(1,), (3,), (4,), (5,), (None,), (7,), (8,)], key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_quality(edge, empty, labels):
    model = quality.train(edge, labels)
    scores = quality.quality_scores(edge, model)
    assert scores.count() == len(EDGE) and scores.where("score is null or score < 0 or score > 1").count() == 0
    out = quality.quality_filter(edge, model, least=0.0)
    assert out.columns == edge.columns and out.count() == len(EDGE)
    for model in (quality.train(empty, labels), quality.train(edge, labels.where("false"))):
        assert quality.quality_scores(empty, model).count() == 0
        assert quality.quality_scores(edge, model).count() == len(EDGE)


def test_tokens(edge, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = token_counts.token_counts(edge, path).collect()
    assert len(rows) == len(EDGE) and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert [r.over_limit for r in rows if r.doc_id == 5] == [True]
    assert token_counts.token_counts(empty, path).count() == 0


def test_decontaminate(spark, edge, empty, benchmark):
    hits = by_id(decontaminate.benchmark_hits(edge, benchmark), "doc_id", "item_id", "similarity")
    assert hits == sorted([(0, 0, 1.0), (0, 0, 1.0), (1, 0, 1.0), (6, 3, 1.0), (8, 3, 1.0), (None, None, 1.0)], key=repr)
    out = decontaminate.decontaminate(edge, benchmark)
    assert out.columns == edge.columns
    assert by_id(out, "doc_id") == sorted([(2,), (3,), (4,), (5,), (7,), (None,)], key=repr)
    assert decontaminate.benchmark_hits(empty, benchmark).count() == 0
    assert decontaminate.benchmark_hits(edge, benchmark.where("false")).count() == 0


def test_mixing(edge, empty):
    rows = mixing.mix_sources(edge).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in EDGE}
    assert len(rows) == 10  # the row repeated with source and id is one document
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix_sources(empty).count() == 0
    assert by_id(mixing.mix_sources(edge), "doc_id", "copies") == by_id(mixing.mix_sources(edge), "doc_id", "copies")


def test_jaccard(edge, empty):
    rows = by_id(jaccard_join.jaccard_classes(edge), "doc_id", "n_shingles", "component_id")
    assert len(rows) == len(EDGE)
    assert rows.count((0, 4, 0)) == 2 and (1, 4, 0) in rows and (2, 0, 2) in rows and (8, 1, 6) in rows
    assert (None, 3, None) in rows
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_toxicity(edge, empty, labels):
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(edge, labels.where("false")).count() == len(EDGE)


def test_chat_edges(spark):
    rows = [(1, 1, "user", "b", "z"), (1, 0, "user", None, "z"), (1, 0, "user", "a", "z"), (1, 0, "user", "a", "z"),
            (1, None, None, "x", "z"), (None, 0, "assistant", "[SEP]\\[\\SEP]", "z"), (2, 0, "assistant", "", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    out = chat_format.format_chats(turns)
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in
            out.select("conv_id", chat_format.read_back(chat_format.formatted()).alias("turns")).collect()}
    assert back[1] == [("", "x"), ("user", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert back[None] == [("assistant", "[SEP]\\[\\SEP]")] and back[2] == [("assistant", "")]
    assert chat_format.format_chats(turns.where("false")).count() == 0


def test_stages(spark, edge, empty, labels, benchmark, tmp_path):
    import corpus_pipeline

    for name, df in (("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:len(docs.columns)] == docs.columns
            out.select(F.count("*")).collect()


def test_columns_of_other_types(spark):
    rows = [(1, "a text of five whole words", {"k": 1}, 3, [{"m": 1}]), (2, "A text of five whole words", {"k": 2}, 3, None), (2, "A text of five whole words", None, 4, None),
            (3, None, {}, None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, source int, more array<map<string,int>>")
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and by_id(kept, "doc_id") == [(2,), (3,)] and by_id(kept, "source") == by_id(exact_dedup.exact_dedup(docs), "source")
    mixed = mixing.mix_sources(docs)
    assert mixed.schema["source"].dataType.simpleString() == "int" and {r.source for r in mixed.collect()} == {3, 4, None}
    with pytest.raises(TypeError, match="whole number"):
        jaccard_join.jaccard_classes(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_filters_are_whole(spark):
    """Packed filters flag every set cell, at the ends of words and packs too."""
    from duewatch.llm.shared import PACK, flag_by_bits, set_bits

    cells = [0, 1, 62, 63, 64, 64 * PACK - 1, 64 * PACK, 64 * PACK + 63, 10 ** 6, (1 << 26) - 1]
    words = set_bits(spark.createDataFrame([(c,) for c in cells for _ in range(2)], "c long"), "c")
    near = sorted({max(0, c + d) for c in cells for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(c,) for c in near], "c long")
    got = {r.c: r.hit for r in flag_by_bits(rows, words, F.col("c"), "hit").collect()}
    assert got == {c: c in cells for c in near}


def test_written_tables_go(spark):
    import os

    from duewatch.llm.shared import shared_dir

    def names():
        root = shared_dir(spark).removeprefix("file:")
        return {n.rsplit("-", 1)[0] for n in os.listdir(root) if n.startswith("duewatch-jaccard") or n.startswith("duewatch-edges")}

    def count():
        return len([n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith(("duewatch-jaccard", "duewatch-edges"))])

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = count()
    out = jaccard_join.jaccard_classes(docs)
    assert out.count() == docs.count() and count() - before <= 8 and not names() & {"duewatch-jaccard-prefixes", "duewatch-jaccard-longer", "duewatch-jaccard-pairs"}


def test_long_chats(spark):
    """A conversation of many turns and one of a very long text come back as they were."""
    long = "é[/INST]\\ <s>" * 60_000
    rows = [(1, i, "user" if i % 3 else "assistant", f"turn {i}") for i in range(4000)] + [(2, 0, "user", long), (2, 1, "assistant", long)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.chat_digest(chat_format.format_chats(turns))
    got = {r.conv_id: r for r in out.collect()}
    assert got[1].n_turns == 4000 and got[1].loss_chars == sum(len(t) for _, _, r, t in rows[:4000] if r == "assistant")
    assert got[2].n_turns == 2 and got[2].loss_chars == len(long)


def test_stage_rows(spark, tmp_path):
    """Ties, repeated rows and nulls through each stage: which rows stay."""
    import corpus_pipeline

    from .conftest import make_docs

    text = " ".join(f"word{i}" for i in range(40))
    near = " ".join(f"word{i}" if i else "other" for i in range(40))
    docs = make_docs(spark, [(1, text), (2, text.upper()), (2, text.upper()), (3, near), (4, None), (5, ""), (None, text + " tail"), (6, "leaked " + " ".join(f"item{i}" for i in range(12)))])
    spark.createDataFrame([(0, " ".join(f"item{i}" for i in range(12)))], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    rows = stage["exact dedup"](spark, docs, str(tmp_path))
    assert by_id(rows, "doc_id") == sorted([(2,), (3,), (5,), (None,), (6,)], key=repr)
    rows = stage["n-gram Jaccard join"](spark, rows, str(tmp_path))
    assert by_id(rows, "doc_id") == sorted([(2,), (5,), (None,), (6,)], key=repr)
    rows = stage["benchmark decontamination"](spark, rows, str(tmp_path))
    assert by_id(rows, "doc_id") == sorted([(2,), (5,), (None,)], key=repr)
