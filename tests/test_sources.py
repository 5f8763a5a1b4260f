"""Text sources, sinks and the running counter."""

import gzip
from collections import Counter

import pytest

from lexmill.plans import catalog
from lexmill.sources import phrase_table
from lexmill.sources import text as source
from lexmill.streaming import counter


def test_line_numbers_across_splits(spark, tmp_path):
    rows = [f"line {i} " + "x" * (i % 50) for i in range(20000)]
    (tmp_path / "a.txt").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = source.lines(spark, str(tmp_path / "a.txt"))
        assert [r.value for r in found.orderBy("line_no").collect()] == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_compressed_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("one\ntwo\n")
    assert {(r.line_no, r.value) for r in source.lines(spark, str(tmp_path / "a.gz")).collect()} == {(0, "one"), (1, "two")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "line_no long, value string")
    source.write_lines(df, str(tmp_path / "out"), compression="gzip")
    source.write_lines(df, str(tmp_path / "out"), append=True)
    assert spark.read.text(str(tmp_path / "out")).count() == 10
    source.write_chunks(df, str(tmp_path / "chunks"), 2)
    assert sorted(p.name for p in (tmp_path / "chunks").glob("chunk=*")) == [f"chunk={i:010}" for i in (1, 2, 3)]


def test_lines_and_chunks_keep_their_order(spark, tmp_path):
    """From any number of tasks: files in the order of their names give the lines back."""
    rows = [f"line {i} \r{'x' * (i % 37)}" for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(rows)), "line_no long, value string").repartition(13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        source.write_lines(df, str(tmp_path / "lines"), order=["line_no"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "lines").glob("part-*"))
    assert "".join(p.read_bytes().decode() for p in files).split("\n")[:-1] == rows and len(files) > 1
    for size in (7, 100, 5000):
        source.write_chunks(df, str(tmp_path / f"c{size}"), size)
        chunks = sorted((tmp_path / f"c{size}").glob("chunk=*"))
        parts = [list(p.glob("part-*")) for p in chunks]
        assert len(chunks) == -(-1000 // size) and all(len(p) == 1 for p in parts)
        assert [p[0].read_bytes().decode().split("\n")[:-1] for p in parts] == [rows[k : k + size] for k in range(0, 1000, size)]
        again = source.read_chunks(spark, str(tmp_path / f"c{size}"), end="\n").collect()
        assert {(r.chunk - 1) * size + r.line_no: r.value for r in again} == dict(enumerate(rows))


def test_numbers_without_gaps(spark):
    df = spark.createDataFrame([(i * 7 % 1000, "x") for i in range(1000)], "k int, line_no string").repartition(11)
    found = source.numbered(df, "k", name="n").collect()
    assert all(r.n == r.k for r in found) and len(found) == 1000 and source.numbered(df.limit(0), "k", name="n").count() == 0


def test_put_to_a_path_or_standard_output(spark, tmp_path, capsys):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "line_no long, value string").repartition(3)
    source.put(df, order=["line_no"])
    assert capsys.readouterr().out.splitlines() == [f"v{i}" for i in range(5)]
    source.put(df, str(tmp_path / "out.gz"), order=["line_no"])
    assert b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out.gz").glob("part-*.gz"))).decode().split() == [f"v{i}" for i in range(5)]


def test_no_lines_give_one_empty_chunk(spark, tmp_path):
    source.write_chunks(spark.createDataFrame([], "line_no long, value string"), str(tmp_path / "chunks"), 2)
    assert [p.name for p in (tmp_path / "chunks").glob("chunk=*")] == ["chunk=0000000001"]
    assert spark.read.text(str(tmp_path / "chunks" / "chunk=0000000001")).count() == 0


def test_find_takes_folders(spark, tmp_path):
    for name, size in (("a/x/one.txt", 1), ("a/x/y/two.txt", 2), ("b/three.x", 3), ("b/four.txt", 4)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("." * size)
    root = f"file:{tmp_path}"
    assert {r.path.removeprefix(root): r.length for r in source.find(spark, root, "*.txt").collect()} == {"/a/x/one.txt": 1, "/a/x/y/two.txt": 2, "/b/four.txt": 4}
    assert {r.path.removeprefix(root): r.length for r in source.find(spark, root, wanted=lambda p: p.endswith("x")).collect()} == {"/a/x": 3, "/b/three.x": 3}
    assert [(r.path, r.length) for r in source.find(spark, root, wanted=lambda p: p.startswith("file:")).collect()] == [(root, 10)]
    assert source.find(spark, root, wanted=lambda p: p.endswith("none")).isEmpty()


def test_terms_of_a_database(spark, tmp_path):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    url = f"jdbc:derby:{tmp_path}/terms"
    spark.createDataFrame([(i, f"term {i}") for i in range(6)], "id int, word string").write.jdbc(f"{url};create=true", "words")
    assert {r.term for r in source.jdbc_terms(spark, url, "words", "word").collect()} == {f"term {i}" for i in range(6)}
    parts = source.jdbc_terms(spark, url, "words", "word", parts=['"id" < 2', '"id" >= 2'])
    assert parts.rdd.getNumPartitions() == 2 and {r.term for r in parts.collect()} == {f"term {i}" for i in range(6)}


def test_only_asked_terms_are_read(spark, tmp_path, monkeypatch):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    url = f"jdbc:derby:{tmp_path}/terms"
    spark.createDataFrame([(f"term {i}",) for i in range(3000)] + [("it's",)], "word string").write.option("createTableColumnTypes", "word VARCHAR(40)").jdbc(f"{url};create=true", "words")
    asked = spark.createDataFrame([(f"term {i}",) for i in range(0, 6000, 5)] + [("it's",), (None,), ("it's",)], "w string")
    want = {f"term {i}" for i in range(0, 3000, 5)} | {"it's"}
    seen = []
    monkeypatch.setattr(source, "jdbc_terms", lambda *a, f=source.jdbc_terms, **k: seen.append(f(*a, **k)) or seen[-1])
    assert {r.term for r in source.jdbc_lookup(spark, url, "words", "word", asked).collect()} == want
    assert seen[0].count() == len(want) and seen[0].rdd.getNumPartitions() == 3  # rows that the database sent
    monkeypatch.setattr(source, "MOST_ASKED", 100)
    assert {r.term for r in source.jdbc_lookup(spark, url, "words", "word", asked).collect()} == want
    assert seen[1].count() == 3001
    assert source.jdbc_lookup(spark, url, "words", "word", asked.limit(0)).count() == 0


def test_bad_rows(spark):
    df = spark.createDataFrame([("a ||| b ||| 1 2 3 4 5 ||| 0-0 ||| 1 2 3",), ("junk",), ("a ||| b ||| 1 ||| 0-0 ||| x",)], "value string")
    assert [(r.f, r.c_both) for r in phrase_table.parse_phrase_table(df).collect()] == [("a", 3)]
    with pytest.raises(Exception, match="bad line"):
        phrase_table.parse_phrase_table(df, on_bad="fail").collect()


def test_similarity_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("line,x,score\n0,a,0.5\n1,b,0.25\n")
    assert [tuple(r) for r in source.similarity(spark, str(tmp_path / "s.csv")).orderBy("line_no").collect()] == [(0, 0.5), (1, 0.25)]


def test_language_model_lines(spark):
    df = spark.createDataFrame([("-1.5\ta b\t-0.5",), ("0.5\tc",), (" \\data\\ ",)], "value string")
    assert [(r.logp, r.ngram, r.backoff, r.raw.strip()) for r in source.arpa(df).collect()] == [(-1.5, "a b", -0.5, "-1.5\ta b\t-0.5"), (0.5, "c", None, "0.5\tc"), (None, None, None, "\\data\\")]


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([(i % 3,) for i in range(10)], "key int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key int").parquet(str(tmp_path / "in"))
    assert {r.key: r.n for r in counter.snapshot(counter.running_counts(stream, "key")).collect()} == {0: 4, 1: 3, 2: 3}


def test_running_counts_leave_the_driver(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame([(i % 3,) for i in range(10)], "key int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = counter.snapshot(counter.running_counts(stream, "key"))
    assert found.inputFiles()  # a written table, no sink in memory
    assert {r.key: r.n for r in found.collect()} == {0: 12, 1: 9, 2: 9}


def test_batches_rewrite_what_they_touch(spark, tmp_path):
    """Buckets that a batch does not touch stay where they were; a batch that runs again changes nothing."""
    stream = spark.readStream.schema("key int").parquet(str(tmp_path))
    counts = counter.running_counts(stream, "key", buckets=8, path=f"file:{tmp_path}/table")
    batch = lambda keys: spark.createDataFrame([(k,) for k in keys], "key int")
    total, before = Counter(), {}
    for number, keys in enumerate([list(range(50)) * 2, [1, 1, 1], [2, None], [], [60]]):
        for _ in range(2):  # the second run is a repetition
            counts.add(batch(keys), number)
            found = counter.manifest(spark, counts.path, number)
            moved = {k for k, folder in found.items() if before.get(k) != folder}
            assert len(moved) <= len(set(keys)) and all(found[k].endswith(f"batch={number}") for k in moved)
        total.update(keys)
        before = found
        assert {r.key: r.n for r in counts.table().collect()} == total
    held = {p.name for p in (tmp_path / "table").glob("batch=*")}
    assert held >= {folder.rpartition("/")[2] for folder in before.values()}


def test_a_counter_goes_on_where_it_was(spark, tmp_path):
    for part in range(2):
        spark.createDataFrame([(i % 3,) for i in range(10)], "key int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = counter.snapshot(counter.running_counts(stream, "key", path=f"file:{tmp_path}/counts"))
        assert {r.key: r.n for r in found.collect()} == {0: 4 + 4 * part, 1: 3 + 3 * part, 2: 3 + 3 * part}


def test_language_pairs_of_many_languages(spark, tmp_path):
    rows = [(f"l{i:04}",) for i in range(1100)] + [(None,)]
    spark.createDataFrame(rows, "lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()["language_pairs"](spark, str(tmp_path))
    assert found.count() == 1100 * 1101 // 2 and found.filter("l1 > l2").isEmpty()
