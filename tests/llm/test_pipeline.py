"""The pipeline's stages against brute force, each on what its predecessor kept."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import pytest
from helpers import awkward, empty
from test_operators import plain_lines, plain_repeats

from lexmill.llm import near_copies
from lexmill.llm.common import written


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        docs = written(stage(spark, docs, small), name)
        if name == "best_fit_packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(before)
            break
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect() if name in ("line_dedup", "suffix_array_dedup"))
        if name == "quality_classifier":
            assert set(kept[name]) < set(before) and all(kept[name][i] == before[i] for i in kept[name])
        elif name == "line_dedup":
            assert kept[name] == {i: text for i, (_, _, text) in plain_lines(before).items()}
        elif name == "simhash_near_dedup":
            assert set(kept[name]) < set(before)
            same = {}
            for i in sorted(before):
                same.setdefault(before[i], i)
            assert set(kept[name]) <= set(same.values())  # of equal texts the smallest id stays
            want = plain_near(before)
            assert len(set(kept[name]) ^ want) <= max(1, len(want) // 100)  # candidates come from masks
        elif name == "suffix_array_dedup":
            gone = plain_repeats(before.values(), 200)
            want = {}
            for (i, text), cut in zip(before.items(), gone, strict=True):
                want[i] = bytes(b for b, c in zip(text.encode(), cut, strict=True) if not c).decode(errors="ignore")
            assert kept[name] == want


def plain_near(docs):
    """The smallest id of each component of texts whose sets of five-word shingles have a similarity of 0.8, by all pairs."""
    sets = {}
    for i, text in docs.items():
        words = text.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in ids if root[i] == i}


@pytest.mark.parametrize("rows", [awkward, empty])
def test_awkward_and_empty_tables(spark, tmp_path, monkeypatch, rows):
    """The run takes them: each stage keeps the columns as they were, and the last gives pieces of what is left."""
    rows(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (3, None, 0)] if rows is awkward else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}

    def kept(out, name):
        seen[name] = written(out, name)
        if name != "best_fit_packing":
            assert out.dtypes == docs.dtypes, name
            found = seen[name].collect()
            assert all(r.score == "x" and r.n_lines == "x" and r.piece == "x" for r in found), name
            assert rows is awkward or not found
        return seen[name]

    monkeypatch.setattr(corpus_pipeline, "written", kept)
    monkeypatch.setattr(corpus_pipeline.quality, "scored", lambda df, model, f=corpus_pipeline.quality.scored: f(df, model, cut=0.0))  # all stay
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "sequence_id" in out.columns and (out.count() > 0) == (rows is awkward)
    if rows is awkward:
        assert [seen[name].count() for name, _ in corpus_pipeline.STAGES[:-1]] == [docs.count()] * 2 + [8] * 2


def test_masks_follow_the_number_of_texts():
    assert near_copies.masks(0) == near_copies.masks(1000) == near_copies.masks(1 << 18) == (14, 44)
    for n in (10**6, 10**8, 10**10):
        bits, tables = near_copies.masks(n)
        assert n / 2**bits <= near_copies.MEMBERS and 1 - (1 - (5 / 6) ** bits) ** tables >= near_copies.RECALL
    assert bits + (tables - 1).bit_length() < 63  # a node's key


def test_run_is_the_stages_in_turn(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
