"""Small cases worked out by hand or by plain models."""

import random
import re
from collections import Counter
from itertools import accumulate, groupby
from math import comb

import pytest
from pyspark.sql import functions as F

from lexmill.functions.stats import hypergeometric_tail, tail
from lexmill.functions.text import edit_score, recase, tokens
from lexmill.operators import adjacent, counts, decompose, extract, filters, merge, rank, text
from lexmill.operators.lookup import lookup


def test_counts_of_random_keys(spark):
    rng = random.Random(1)
    keys = [rng.randrange(100) for _ in range(2000)]
    df = spark.createDataFrame([(k,) for k in keys], "key int").repartition(7)
    assert {r.key: r.n for r in counts.count_keys(df, "key").collect()} == Counter(keys)


def pairs(spark, links, src, trg):
    df = spark.createDataFrame([(1, src, trg)], "id int, src string, trg string")
    return extract.aligned(df, spark.createDataFrame([(1, *x) for x in links], "id int, l int, r int"), ["id"])


def test_extraction(spark):
    df = pairs(spark, [(0, 0), (1, 1), (2, 2), (2, 3)], "the red house", "das rote haus da")
    found = {(r.foreign, r.translation): r.n for r in extract.pair_counts(extract.phrases(df)).collect()}
    assert found == {("the", "das"): 1, ("the red", "das rote"): 1, ("the red house", "das rote haus"): 1, ("red", "rote"): 1, ("red house", "rote haus"): 1, ("house", "haus"): 1}


def test_alignment_lines_keep_their_order(spark):
    lines = [(0, "1-0 0-1 2-2", "a b c ||| x y z"), (1, "0-0", "no second side"), (2, "  ", "a ||| x"), (3, "", "a ||| x"), (4, "0-0 1-1", "a b ||| x y")]
    df = spark.createDataFrame(lines, "line_no int, links string, text string")
    found = extract.from_lines(df.selectExpr("line_no", "links as value"), df.selectExpr("line_no", "text as value"))
    assert {r.line_no: [tuple(x) for x in r.links] for r in found.collect()} == {0: [(1, 0), (0, 1), (2, 2)], 3: [], 4: [(0, 0), (1, 1)]}
    pairs_ = {(r.foreign, r.translation): r.n for r in extract.pair_counts(extract.phrases(found)).collect()}
    assert pairs_ == {("b", "x"): 1, ("a b", "x y"): 1, ("a", "y"): 1, ("a", "x"): 1}
    with pytest.raises(Exception, match="bad alignment"):
        extract.from_lines(df.selectExpr("line_no", "'0-a' as value"), df.selectExpr("line_no", "text as value")).collect()


def test_one_link_gives_nothing_unless_repaired(spark):
    df = pairs(spark, [(0, 0)], "a", "b")
    assert extract.phrases(df).count() == 0
    assert extract.phrases(df, repaired=True).count() == 1


@pytest.mark.parametrize(("first", "second", "both", "score"), [(10, 8, 7, 6.1414187e-17), (100, 100, 1, 0.99984033), (1, 1, 1, 2.0020020e-06), (3, 1, 1, 1.2012012e-05)])
def test_hypergeometric_tail(first, second, both, score):
    assert tail(1000, first + 1, second + 1, both) == pytest.approx(score, rel=1e-7)
    exact = sum(comb(first + 1, x) * comb(999 - first, second + 1 - x) for x in range(both + 1, min(first, second) + 2)) / comb(1000, second + 1)
    assert tail(1000, first + 1, second + 1, both) == pytest.approx(exact, rel=1e-9)


def test_hypergeometric_columns(spark):
    rng = random.Random(9)
    for population in (20, 1000, 5_000_000):
        rows = [(0, 0, 0), (population, population, population), (3, 1, 0), (1, 3, 5), (population, 2, 1)]
        for _ in range(400):
            first, second = (int(10 ** rng.uniform(0, 3.5)) for _ in range(2))
            rows.append((first, second, rng.randint(0, min(first, second) + 1)))
        df = spark.createDataFrame(rows, "c_first long, c_second long, c_both long")
        scored = df.withColumn("x", hypergeometric_tail(population)("c_first", "c_second", "c_both"))
        assert "Python" not in scored._jdf.queryExecution().toString() and "Arrow" not in scored._jdf.queryExecution().toString()
        for r in scored.collect():
            want = tail(population, r.c_first + 1, r.c_second + 1, r.c_both)
            assert r.x == pytest.approx(want, abs=1e-9, rel=1e-6 if r.c_both * population > 2 * r.c_first * r.c_second else None), r


def plain_fisher(lines, population, threshold):
    """The program line by line."""
    out, held, f0, t0 = [], [], "", ""

    def closed():
        scores = [tail(population, a + 1, b + 1, c) for _, _, a, b, c in held]
        if any(x < threshold for x in scores):
            out.extend(x[:2] for x, y in zip(held, scores, strict=True) if y < threshold)
        elif held:
            out.append(min(zip(scores, range(len(held), 0, -1), held, strict=True))[2][:2])

    for line in lines:
        f, t, *_ = line
        single = " " not in f and " " not in t
        if f != f0:
            if " " not in f0 and " " not in t0 and f0:
                closed()
            held = []
        held += [line] * single
        f0, t0 = f, t
    return sorted(out)


def test_fisher_filter_of_unsorted_lines(spark):
    rng = random.Random(10)
    lines = [(rng.choice(["a", "b", "c", "c d", ""]), rng.choice(["x", "y", "z", "x y"]), rng.randint(1, 60), rng.randint(1, 60), rng.randint(1, 20)) for _ in range(400)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "line_no int, f string, t string, c_first long, c_second long, c_both long").repartition(5)
    found = sorted((r.f, r.t) for r in filters.fisher_filter(df, 200, 0.05, [], line_no="line_no").collect())
    assert found == plain_fisher(lines, 200, 0.05) and len(found) > 50


def test_merges_of_unsorted_lines(spark):
    """Phrase tables and reordering tables against the programs that read line by line."""
    rng = random.Random(11)
    names = [(f, t) for f in ("", "a", "b c", "d") for t in ("", "x", "y z")]
    for order in ("random", "nearly", "sorted"):
        lines = [(*rng.choice(names), rng.randint(1, 9), rng.randint(1, 9), rng.randint(1, 9)) for _ in range(120)]
        lines = lines if order == "random" else sorted(lines)
        if order == "nearly":
            lines = lines[20:] + lines[:20]
        df = spark.createDataFrame([(i, *x, "0-0", str(i)) for i, x in enumerate(lines)], "line_no int, f string, t string, c_first long, c_second long, c_both long, align string, raw string").repartition(6)
        lexicon = spark.createDataFrame([("a", "x", 0.5)], "w1 string, w2 string, p double")
        groups = [(k, [x[2:] for x in g]) for k, g in groupby(lines, key=lambda x: x[:2])]
        want = [(*k, *map(sum, zip(*g, strict=True))) for k, g in groups[:-1] if k[0]]
        got = merge.merge_phrase_tables(df, lexicon, lexicon, line_no="line_no").collect()
        assert sorted((r.f, r.t, r.c_first, r.c_second, r.c_both) for r in got) == sorted(want)

        table_ = rng.sample(names, 8)
        table_ = table_ if order == "random" else sorted(table_)
        pairs_ = [f"{f} ||| {t} ||| " for f, t in table_]
        want, at = [], 0
        for (f, t), g in groups:
            key = f"{f} ||| {t} ||| "
            while pairs_[at] < key and at + 1 < len(pairs_):
                at += 1
            if f and pairs_[at] == key:
                want.append((f, t, round(sum(x[0] for x in g) / len(g), 9)))
        rot = spark.createDataFrame([(i, f, t, [float(a)]) for i, (f, t, a, _, _) in enumerate(lines)], "line_no int, f string, t string, scores array<double>").repartition(6)
        place = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(table_)], "line_no int, f string, t string").repartition(3)
        got = merge.merge_reordering(rot, place, "line_no").collect()
        assert sorted((r.f, r.t, round(r.scores[0], 9)) for r in got) == sorted(want)


def test_runs_and_running_maxima(spark):
    rng = random.Random(12)
    keys = [rng.choice(["a", "b", None]) for _ in range(300)]
    df = spark.createDataFrame([(3 * i, k, rng.randint(0, 9) + i // 20) for i, k in enumerate(keys)], "line_no long, key string, x int").repartition(9)
    rows = adjacent.runs(df, ["key"]).orderBy("line_no").collect()
    starts = [3 * i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
    assert [r.run for r in rows] == [max(s for s in starts if s <= r.line_no) for r in rows]
    tops = adjacent.running_max(df, F.col("x")).orderBy("line_no").collect()
    assert [r.top for r in tops] == list(accumulate((r.x for r in tops), max))
    assert adjacent.runs(df.limit(0), ["key"]).count() == 0


def test_lookup_deals_hot_keys(spark):
    """Two thirds of all rows ask for one key: no task gets many more rows than the others."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("key"), F.lit(None).alias("z"))
    table_ = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(100)]], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = lookup(rows, table_, ["key"], ["id"], hot=200)
        sizes = sorted(r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        want = rows.join(table_, "key", "left").agg(F.count("v"), F.sum("v"), F.count("*")).first()
        assert found.agg(F.count("v"), F.sum("v"), F.count("*")).first() == want
        assert lookup(rows, table_, ["key"], ["id"], "left_semi", hot=200).count() == want[0] and set(found.columns) == {"id", "key", "z", "v"}
    finally:
        for key, value in (("spark.sql.autoBroadcastJoinThreshold", "10m"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.shuffle.partitions", "4")):
            spark.conf.set(key, value)


def plain_runs(links, most, rate, repaired):
    """Every run of consecutive links that is good, from the definition."""
    last, out = len(links) - (not repaired), []
    good = lambda x: len(set(x)) <= most and (max(x) == min(x) or len(set(x)) >= rate * (max(x) - min(x)))
    for i in range(last):
        for j in range(i, last):
            run = links[i : j + 1]
            if good([x for x, _ in run]) and good([y for _, y in run]):
                out.append(([x for x, _ in run], [y for _, y in run]))
    return out


@pytest.mark.parametrize("repaired", [False, True])
def test_extraction_by_starts(spark, repaired):
    rng = random.Random(13)
    rows = [(k, " ".join(f"s{i}" for i in range(30)), " ".join(f"t{i}" for i in range(30)), rng.sample([(i, j) for i in range(12) for j in range(max(0, i - 3), i + 3)], rng.randint(0, 20))) for k in range(60)]
    rows = [(k, s, t, sorted(x) if k % 2 else x) for k, s, t, x in rows]
    df = spark.createDataFrame(rows, "id int, src string, trg string, links array<struct<l:int,r:int>>")
    for most, rate in ((5, 0.75), (3, 0.5)):
        got = Counter((r.id, tuple(r.f_places), tuple(r.t_places)) for r in extract.phrases(df, most=most, rate=rate, repaired=repaired).collect())
        assert got == Counter((k, tuple(a), tuple(b)) for k, _, _, x in rows for a, b in plain_runs(x, most, rate, repaired))


def test_relative_entropy(spark):
    rows = [
        ("haus", "house", 0.5, 0.4, 5, "0-0"), ("das haus", "the house", 0.5, 0.01, 5, "0-0 1-1"), ("das haus", "the house", 0.5, 0.01, 6, "0-0 1-1"),
        ("das haus", "the big house", 0.9, 0.0001, 9, "0-0"), ("das haus", "the house", 0.5, 0.0, 5, "0-0 1-1"), ("x", "y", 0.0, 0.1, 5, "0-0"),
    ]
    df = spark.createDataFrame(rows, "f string, t string, pft double, lft double, c_both int, align string")
    found = sorted(r.entropy for r in filters.entropy_filter(df, 20).collect())
    assert found == [pytest.approx(23.472138), pytest.approx(121.534264), float("inf")]


def test_phrase_table_merge(spark):
    rows = [("das haus", "the house", "0-0 1-1", 6, 4, 3, "a"), ("das haus", "the house", "0-0 1-1", 10, 12, 5, "b"), ("z", "z", "0-0", 1, 1, 1, "c")]
    df = spark.createDataFrame(rows, "f string, t string, align string, c_first long, c_second long, c_both long, raw string")
    e2f = spark.createDataFrame([("das", "the", 0.4), ("haus", "house", 0.8)], "w1 string, w2 string, p double")
    f2e = spark.createDataFrame([("the", "das", 0.5), ("house", "haus", 0.6)], "w1 string, w2 string, p double")
    (row,) = merge.merge_phrase_tables(df, e2f, f2e).collect()
    assert (row.c_first, row.c_second, row.c_both, row.bias) == (16, 16, 8, 2.718)
    assert [row.pft, row.lft, row.ptf, row.ltf] == [pytest.approx(x) for x in (0.5, 0.32, 0.5, 0.3)]
    assert merge.merge_phrase_tables(df, e2f, f2e, repaired=True).count() == 2


@pytest.mark.parametrize(("values", "asis"), [((0.004, 0.9), 0.45), ((0.9, 0.004), 0.452), ((0.009, 0.009), None)])
def test_lexical_merge(spark, values, asis):
    df = spark.createDataFrame([(i, "a", "b", p) for i, p in enumerate(values)], "shard int, w1 string, w2 string, p double")
    found = [r.p for r in merge.merge_lexical(df, 2).collect()]
    assert found == ([] if asis is None else [pytest.approx(asis)])


def test_reordering_merge_stops_at_the_shortest(spark):
    df = spark.createDataFrame([("f", "t", [1.0, 2.0, 3.0]), ("f", "t", [3.0, 4.0]), ("x", "y", [1.0])], "f string, t string, scores array<double>")
    table = spark.createDataFrame([("f", "t")], "f string, t string")
    assert [(r.f, r.scores) for r in merge.merge_reordering(df, table).collect()] == [("f", [2.0, 3.0])]


def plain_edit(a, b):
    m, n = len(a), len(b)
    d = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m, -1, -1):
        for j in range(n, -1, -1):
            d[i][j] = n - j if i == m else m - i if j == n else min(d[i + 1][j + 1], d[i][j + 1], d[i + 1][j]) + (a[i] != b[j])
    return d[0][0]


def test_edit_score(spark):
    rng = random.Random(2)
    rows = [(list("kitten"), list("sitting")), (["a"], ["a", "a"]), ([], ["x"]), (["x"], [])] + [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    found = [r.d for r in df.select(edit_score(F.col("a"), F.col("b")).alias("d")).collect()]
    assert found == [plain_edit(a, b) for a, b in rows]
    assert found[:3] == [3, 0, 1]


def test_edit_scores_of_awkward_and_long_pairs(spark):
    rng = random.Random(8)
    long = [[rng.choice("abcdefgh") for _ in range(20_000)] for _ in range(2)]
    rows = [(None, ["a"]), (["a"], None), ([], []), (["a", None], ["a", None]), (["x"] * 3, ["x"]), *[(["a", "b"] * k, ["b", "a", "c"] * (9 - k)) for k in range(10)], (long[0], long[0]), (long[0], long[1])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    found = [r.d for r in df.select(edit_score(F.col("a"), F.col("b")).alias("d")).collect()]
    assert found[:5] == [None, None, 0, 1, 0]
    assert found[5:15] == [plain_edit(a, b) for a, b in rows[5:15]]
    assert found[15] == 0 and 0 < found[16] < 20_000
    assert spark.createDataFrame([], "a array<string>, b array<string>").select(edit_score(F.col("a"), F.col("b"))).count() == 0


def test_mean_edit_score_of_nothing_is_nan(spark):
    (row,) = text.mean_edit_score(spark.createDataFrame([], "a string, b string"), "a", "b").collect()
    assert row.score != row.score


def test_top_n(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 2.0)], "line_no long, score double")
    assert {r.line_no for r in rank.top_n(df, 3).collect()} == {0}
    assert {r.line_no for r in rank.top_n(df, 3, repaired=True).collect()} == {0, 1, 2}


@pytest.mark.parametrize(("word", "parts"), [("DAMPFSCHIFFFAHRT", ["DAMPF", "SCHIFF", "FAHRT"]), ("Dampfschifffahrt", ["Dampf", "Schiff", "Fahrt"]), ("dampfschifffahrt", ["dampf", "schiff", "fahrt"])])
def test_recase(spark, word, parts):
    assert [decompose.recased(p, word) for p in ("dampf", "schiff", "fahrt")] == parts
    df = spark.createDataFrame([(p, word) for p in ("dampf", "schiff", "fahrt")], "p string, w string")
    assert [r.x for r in df.select(recase(F.col("p"), F.col("w")).alias("x")).collect()] == parts


def test_recase_goes_by_the_first_letter(spark):
    df = spark.createDataFrame([("haus", "(Hausamt"), ("'haus", "Hausamt"), ("haus", "hausAmt"), ("haus", "(12)")], "p string, w string")
    assert [r.x for r in df.select(recase(F.col("p"), F.col("w")).alias("x")).collect()] == ["Haus", "'Haus", "haus", "HAUS"]
    for part, word in (("haus", "(Hausamt"), ("'haus", "Hausamt"), ("haus", "hausAmt"), ("haus", "(12)")):
        assert decompose.recased(part, word) == {"(Hausamt": "Haus", "Hausamt": "'Haus", "hausAmt": "haus", "(12)": "HAUS"}[word]


TERMS = "dampf schiff fahrt arbeit arbeits amt versicherung haft pflicht tangible intangible fixed asset assets".split()
CASES = [
    ("intangible fixed assets", ["intangible", "fixed", "assets"]), ("Dampfschifffahrt", ["Dampf", "Schiff", "Fahrt"]), ("Haftpflichtversicherung", ["Haft", "Pflicht", "Versicherung"]),
    ("Arbeitsamt", ["Arbeits", "Amt"]), ("Arbeitamt", ["Arbeit", "Amt"]), ("fahrten", ["fahrt"]), ("schiff", ["schiff"]), ("amt amt", ["amt", "amt"]), ("xyz", []),
]


def table(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("language", ["en", "de"])
def test_decomposition(spark, language):
    found = decompose.decompose_best(table(spark, [w for w, _ in CASES], "word"), table(spark, TERMS, "term"), language=language)
    assert {r.word: r.parts for r in found.collect()} == dict(CASES)


def plain_terms(word, terms):
    low = word.lower()
    return {low[i:j] for i in range(len(low) - 2) for j in range(i + 2, len(low) + 1) if low[i:j] in terms}


def plain_segmentations(word, known):
    """Every segmentation, term by term from the front."""

    def of(rest):
        if not rest:
            return {()}
        out = set()
        for term in known:
            if rest.startswith(term):
                after = rest[len(term) :].lstrip()
                tails, extra = of(after), ""
                if not tails and re.match(r"..?\b", after):
                    extra = after[: 2 if len(after) >= 2 and after[1].isalpha() else 1]
                    tails = of(after[len(extra) :].lstrip())
                elif not tails and (glue := re.match("s|e|en|er|n", after)):
                    extra = glue[0]
                    tails = of(after[len(extra) :])
                out |= {(term + extra if extra and term + extra in known else term, *tail) for tail in tails}
        return out

    return of(word.lower())


def plain_merged(parts):
    """Plural endings joined to the part before: as text, one replacement after another."""
    text = f"[{', '.join(parts)}]"
    for ending, close in (("e", ","), ("e", "]"), ("n", ","), ("s", ","), ("s", "]"), ("en", ","), ("en", "]")):
        text = text.replace(f", {ending}{close}", f"{ending}{close}")
    return tuple(text[1:-1].split(", "))


@pytest.mark.parametrize("language", ["en", "de"])
def test_rankings_are_those_of_all_segmentations(spark, language):
    rng = random.Random(3)
    for _ in range(4):
        terms = {"".join(rng.choices("abens", k=rng.randint(2, 4))) for _ in range(14)} | {"en", "an"}
        words = {"".join(rng.choices("abens ABr", (6, 6, 6, 6, 6, 1, 1, 1, 1), k=rng.randint(1, 11))) for _ in range(250)}
        want = {}
        for word in words:
            known = plain_terms(word, terms)
            found = plain_segmentations(word, known)
            found |= {plain_merged(p) for p in found} if language == "de" and "en" in known else set()
            ordered = sorted({tuple(decompose.recased(x, word) for x in p) for p in found}, key=lambda p: (len(p), p))
            want[word] = [(k + 1, 1 / len(p), list(p)) for k, p in enumerate(ordered)]
        df, base = table(spark, words, "word"), table(spark, terms, "term")
        for most in (None, 2):
            got = {w: [] for w in words}
            for r in decompose.decompose_ranked(df, base, language=language, most=most).collect():
                got[r.word].append((r["rank"], r.score, r.parts))
            assert {w: sorted(x) for w, x in got.items()} == {w: x[:most] for w, x in want.items()}
        best = {r.word: r.parts for r in decompose.decompose_best(df, base, language=language).collect()}
        assert best == {w: x[0][2] if x else [] for w, x in want.items()}


def test_plural_endings_join_the_part_before():
    def ranked(parts, word):
        ends = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
        return list(decompose.best_first([(a, b, p) for a, b, p in zip(ends, ends[1:], parts, strict=False)], word, "de"))

    for parts in (("haus", "en", "bau"), ("en", "haus", "en"), ("haus", "en", "en", "bau"), ("haus", "en", "en"), ("haus", "en", "en", "en"), ("en", "en"), ("en",), ("en", "en", "en", "en", "bau", "en")):
        assert set(ranked(parts, "".join(parts))) == {parts, plain_merged(parts)}


def test_long_words_and_large_rankings(spark):
    words, terms = table(spark, ["ab" * 200, "ab" * 12], "word"), table(spark, ["ab", "abab", "ba"], "term")
    assert {len(r.parts) for r in decompose.decompose_best(words, terms).collect()} == {100, 6}
    ranked = decompose.decompose_ranked(words, terms, language="de", most=50).collect()
    assert len(ranked) == 100 and all(sorted(x) == x for x in ([len(r.parts) for r in sorted(ranked, key=lambda r: r["rank"]) if r.word == w] for w in ("ab" * 200, "ab" * 12)))
    every = decompose.decompose_ranked(table(spark, ["ab" * 12], "word"), terms).collect()
    assert {tuple(r.parts) for r in every} == plain_segmentations("ab" * 12, {"ab", "abab", "ba"}) and len(every) == 233


def test_decomposition_of_nothing(spark):
    none, words = table(spark, [], "term"), table(spark, ["", "a", None, "amt"], "word")
    assert {r.word: r.parts for r in decompose.decompose_best(words, none).collect()} == {"": [], "a": [], None: None, "amt": []}
    assert [(r.word, r.score, r.parts) for r in decompose.decompose_ranked(words, none).collect()] == [("", float("inf"), [])]
    assert decompose.decompose_best(table(spark, [], "word"), none).count() == 0


def test_lines_keep_their_other_columns(spark):
    lines = spark.createDataFrame([(1, "Das  Arbeitsamt Arbeitsamt"), (1, None), (2, "")], "n int, value string")
    found = decompose.decompose_lines(lines, table(spark, TERMS, "term")).collect()
    assert sorted((r.n, r.value or "") for r in found) == [(1, ""), (1, "Das  Arbeits Amt Arbeits Amt"), (2, "")]


def test_decomposition_queries(spark):
    words = spark.createDataFrame([("Arbeitsamt",), ("xyz",), (None,)], "word string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    assert {r.word: r.parts for r in decompose.decompose_best(words, terms).collect()} == {"Arbeitsamt": ["Arbeits", "Amt"], "xyz": [], None: None}
    found = [(r.word, r["rank"], r.parts) for r in decompose.decompose_ranked(words, terms).collect()]
    assert ("Arbeitsamt", 1, ["Arbeits", "Amt"]) in found and {w for w, _, _ in found} == {"Arbeitsamt"}
    assert {(r.word, r.term) for r in decompose.filter_terms(words, terms).collect()} == {("Arbeitsamt", "arbeit"), ("Arbeitsamt", "arbeits"), ("Arbeitsamt", "amt")}
    lines = spark.createDataFrame([("Das Arbeitsamt",)], "value string")
    assert decompose.decompose_lines(lines, terms).first().value == "Das Arbeits Amt"


def test_literals(spark):
    df = spark.createDataFrame([(0, 'a "x"@en b "y"@de c "z"'), (1, "none")], "line_no int, value string")
    assert [r.literal for r in text.literals(df).collect()] == ["x", "y", "z"]
    assert [r.literal for r in text.literals(df, lang="en").collect()] == ["x"]
    words = spark.createDataFrame([("x", "eks@de", 0), ("y", "old", 1), ("y", "wai", 2), ("z", "zed", 3)], "label string, translation string, line_no int")
    assert {r.line_no: r.value for r in text.translate_literals(df, words, ["line_no"]).collect()} == {0: "a eks@en b wai@de c zed", 1: "none"}
    odd = spark.createDataFrame([(0, 'a "x" b ""')], "line_no int, value string")
    assert [r.literal for r in text.literals(odd).collect()] == ["x"]
    assert [r.literal for r in text.literals(spark.createDataFrame([('a "" b "x"',)], "value string")).collect()] == [" b "]
    tags = spark.createDataFrame([("x", "eks@EN", 0)], "label string, translation string, line_no int")
    assert text.translate_literals(odd, tags, ["line_no"]).first().value == 'a eks b ""'
    with pytest.raises(Exception, match="no translation"):
        text.translate_literals(df, words.filter("label <> 'z'"), ["line_no"]).collect()


def test_highlight(spark):
    df = spark.createDataFrame([("a b", "b c")], "h string, r string")
    assert text.compared(df, "h", "r").first().shown == "*a* *b* ||| b c"
    assert text.compared(df, "h", "r", repaired=True).first().shown == "a *b* ||| b c"
    mixed = spark.createDataFrame([("A  b\tC ", "c  B")], "h string, r string")
    assert text.compared(mixed, "h", "r", lower=True, repaired=True).first().shown == "A *b* *C* ||| c  B"


def test_tokens_drop_trailing_blanks(spark):
    assert spark.createDataFrame([("a b  ",)], "x string").select(tokens(F.col("x")).alias("n")).first().n == 2


def test_edit_queries_take_whole_texts(spark, small):
    from lexmill.plans import catalog
    from lexmill.plans.fixtures import relation

    rows = relation(spark, small, "pairs").collect()
    assert any(len(r.src.split(" ")) > 12 and len(r.trg.split(" ")) > 12 for r in rows)
    want = {(r.conv_id, r.turn): plain_edit(r.src.split(" "), r.trg.split(" ")) for r in rows}
    assert {(r.conv_id, r.turn): r.edit for r in catalog.queries()["edit_score"](spark, small).collect()} == want
    (mean,) = catalog.queries()["word_error_rate"](spark, small).collect()
    assert mean.score == pytest.approx(sum(want.values()) / len(want), abs=1e-9)
