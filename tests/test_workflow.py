"""Steps, blocks, pools, processes and file steps."""

import tarfile

import pytest

from lexmill import workflow as w
from lexmill.operators.text import rewritten


def test_order_listing_and_resume():
    flow, seen = w.Workflow(), []
    flow.step("one")(lambda: seen.append(1))
    inner = flow.block("inner")
    inner.step("two")(lambda: seen.append(2))
    inner.block("deep").step("three")(lambda: seen.append(3))
    flow.step("four")(lambda: seen.append(4))
    assert list(flow.listing()) == [("1", "one"), ("2", "inner"), ("2.1", "two"), ("2.2", "deep"), ("2.2.1", "three"), ("3", "four")]
    flow.start()
    flow.start(3)
    assert seen == [1, 2, 3, 4, 4]


def test_failure_stops():
    flow, seen = w.Workflow(), []
    flow.step("bad")(lambda: 1)
    flow.step("never")(lambda: seen.append(1))
    with pytest.raises(w.StepFailed):
        flow.start()
    assert not seen


def test_pool_makes_directories_and_raises(tmp_path):
    flow = w.Workflow()
    flow.pool(3, "pool", lambda i, block: block.add(w.mkdir(str(tmp_path / str(i)))))
    flow.start()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1", "2", "3"]
    bad = w.Workflow()
    bad.pool(2, "pool", lambda i, block: block.add(w.Step("x", lambda: i - 1)))
    with pytest.raises(w.StepFailed):
        bad.start()


def test_file_steps(tmp_path):
    file = tmp_path / "a.txt"
    with pytest.raises(w.StepFailed):
        w.check_exists(str(file)).execute()
    file.write_text("four\nlines\nof\nprose\n")
    w.check_exists(str(file)).execute()
    w.gzip(str(file)).execute()
    assert not file.exists()
    w.gunzip(f"{file}.gz").execute()
    assert file.read_text().startswith("four")
    with pytest.raises(w.StepFailed):
        w.gunzip(str(file))
    with tarfile.open(tmp_path / "t.tar.xz", "w:xz") as tar:
        tar.add(file, "in/a.txt")
    w.untar(str(tmp_path / "t.tar.xz"), str(tmp_path)).execute()
    w.output(str(tmp_path / "in/a.txt")).execute()
    w.rm(str(tmp_path / "in"), recursive=True).execute()
    with pytest.raises(w.StepFailed):
        w.rm(str(tmp_path / "in")).execute()
    w.rm(str(tmp_path / "in"), if_exists=True).execute()


def test_process(tmp_path):
    (tmp_path / "in").write_text("b\na\n")
    w.do("sort", stdin=str(tmp_path / "in"), stdout=str(tmp_path / "out"), env={"LC_ALL": "C"}).execute()
    w.do("sort", stdin=str(tmp_path / "in"), stdout=str(tmp_path / "out"), append=True).execute()
    assert (tmp_path / "out").read_text() == "a\nb\na\nb\n"
    with pytest.raises(w.StepFailed):
        w.do("no-such-program")


def test_one_process_a_task(spark):
    df = spark.range(25000).coalesce(1).selectExpr("cast(id as string) as value")
    assert [r.value.strip() for r in w.pipe(df, ["wc", "-l"]).collect()] == ["25000"]
    assert [r.value for r in w.pipe(df, ["head", "-n", "2"]).collect()] == ["0", "1"]
    assert w.pipe(df, ["cat"]).count() == 25000
    odd = spark.createDataFrame([("a\nb",), (None,), ("é",)], "value string").coalesce(1)
    assert [r.value for r in w.pipe(odd, ["cat"]).collect()] == ["a", "b", "", "é"]
    with pytest.raises(Exception, match="status 1"):
        w.pipe(df, ["false"]).collect()


def test_helpers():
    assert w.language_pair("en", "de") == ("de", "en")
    assert w.groups(7, 3) == [[0, 1, 2], [3, 4], [5, 6]]
    assert w.groups(1, 2) == [[0], []]
    text = w.decoder_config("/m", "/lm", 3)
    assert "[weight-d]" in text and text.endswith("[distortion-limit]\n6\n")
    tuned = w.tuned_weights(["x", "[weight-d]", "1"])
    assert w.decoder_config("/m", "/lm", 3, weights=tuned).endswith("[weight-d]\n1\n")
    assert w.rewrite_config(["a/phrase-table.gz", "b"], {"phrase-table.gz": "new"}) == ["new", "b"]


def test_rewritten_lines(spark):
    df = spark.createDataFrame([("a/phrase-table.gz",), ("b",), (None,)], "value string")
    assert [r.value for r in rewritten(df, {"phrase-table.gz": "new", ".gz": "later"}).collect()] == ["new", "b", None]
