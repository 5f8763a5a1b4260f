"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import public_tokenizers
from helpers import LONG, awkward, empty
from pyspark.sql import functions as F

from lexmill.llm import licenses, line_dedup, media, near_copies, packing, piece_encoding, quality, sharding, simhash, suffix_dedup, vantage

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def scored(df):
    labels = df.sparkSession.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return quality.scored(df, quality.fit(df, labels))


#: Operator, and rows for the awkward table (None: one per row).
OPERATORS = {
    "line_dedup": (line_dedup.line_dedup, None), "simhash": (simhash.near_duplicates, None), "near_copies": (near_copies.keep_one, None), "pieces": (lambda d: packing.pieces(d, WORDS), None),
    "pack": (lambda d: packing.pack(d, WORDS), None), "encoded": (lambda d: piece_encoding.encoded(d, PIECES), None), "round_trips": (lambda d: piece_encoding.round_trips(d, PIECES), None),
    "suffix_counted": (suffix_dedup.counted, None), "suffix_dedup": (suffix_dedup.dedup, None), "quality": (scored, None), "licenses": (licenses.scan, None),
    "media": (lambda d: media.features(media.metadata(media.dealt(media.stored(d)))), None), "headers": (lambda d: media.metadata(media.stored(d)), None), "sharding": (sharding.sharded, None),
}
FEWER = {"near_copies"}
MORE = {"pieces", "pack"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    df = awkward(spark)
    out = OPERATORS[name][0](df).collect()
    if name in MORE:
        assert len(out) >= df.count()
    elif name in FEWER:
        assert len(out) < df.count()
    else:
        assert len(out) == df.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name][0](empty(spark)).count() == 0


def test_defined_results(spark):
    df = awkward(spark)
    by = lambda rows, i: [r for r in rows if r.doc_id == i]
    lines = line_dedup.line_dedup(df).collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in by(lines, 2)] == [(1, 0, "")]
    assert len(by(lines, None)) == 3
    near = simhash.near_duplicates(df).collect()
    assert {r.component_id for r in near if r.doc_id in (2, 3, 7)} == {2} and {r.fp for r in by(near, 2)} == {0}
    assert {r.component_id for r in near if r.doc_id in (4, 5)} == {4}
    removed = suffix_dedup.counted(df).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in removed if r.doc_id in (4, 5)] == [(len(LONG), len(LONG), 1)] * 2
    tokens = packing.pack(df, WORDS).collect()
    assert [(r.start, r.length) for r in by(tokens, 3)] == [(0, 1)]
    assert sum(r.length for r in by(tokens, 4)) == 60001
    assert [(r.n_words, r.labels, r.score) for r in by(licenses.scan(df).collect(), 2)] == [(0, "", 0.0)]
    kept = near_copies.keep_one(df).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {1, 2, 4, 8, None}


def test_line_rule_keeps_the_largest_holder(spark):
    line = "This line is long enough to be counted by its key."
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line} \nend") for i in range(6)] + [(9, line), (9, line)]
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: f"own {i}\nend" for i in range(6)} | {9: line}


def test_vectors_without_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vantage.nearest(df).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], "x")], "vec_id long, embedding array<float>, score string")
    assert vantage.nearest(one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in vantage.nearest(two).orderBy("rank").collect()] == [(1, 3, 0.0), (2, 5, 0.0)]


def test_texts_of_one_column_only(spark):
    df = spark.createDataFrame([(1, "a")], "i long, t string").select(F.col("i"), F.col("t"))
    assert line_dedup.line_dedup(df, "i", "t").columns == ["i", "t", "n_lines", "n_dropped"]
    assert simhash.near_duplicates(df, "i", "t").count() == 1
