"""Toxicity, divergence of sources and alignment of tokenizers against plain models."""

import hashlib
import random
import re
import sys
from collections import Counter
from itertools import combinations, product
from pathlib import Path
from zlib import crc32

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import public_tokenizers
import sentencepiece
from helpers import LONG, awkward, empty
from tokenizers import Tokenizer

from lexmill.llm import alignment, divergence, queries, toxicity

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# toxicity


@pytest.mark.parametrize(
    ("symbols", "weight"),
    [("", 0), ("www", 0), ("i", 1), ("ti", 1.5), ("it", 1.5), ("iwwwt", 1.5), ("iwwwwt", 1), ("twwwi", 1.5), ("twwwwi", 1), ("ni", 0.5), ("nwwwi", 0.5), ("nwwwwi", 1), ("swwwwwwi", 0.5), ("tsi", 0.75), ("h", 0), ("th", 1.5), ("ht", 1.5), ("nht", 0.5), ("ii", 2), ("iti", 3), ("nthi", 1.25)],
)
def test_grammar(symbols, weight):
    assert toxicity.clause_weight(symbols) == pytest.approx(weight)


def plain_weight(symbols):
    """The four rules one after another, without machines."""
    total = 0.0
    for k, s in enumerate(symbols):
        if s not in "ih":
            continue
        denied = "n" in symbols[max(0, k - toxicity.REACH) : k] or "s" in symbols[:k]
        near = "t" in symbols[max(0, k - toxicity.REACH) : k] or "t" in symbols[k + 1 : k + 1 + toxicity.REACH]
        total += toxicity.VERDICTS[(s.upper() if denied else s) + ("+" if near else "")]
    return total


def test_composition_equals_the_rules_in_turn():
    for n in range(5):
        for symbols in map("".join, product("ihtnsw", repeat=n)):
            assert toxicity.clause_weight(symbols) == pytest.approx(plain_weight(symbols)), symbols
    rng = random.Random(4)
    for _ in range(3000):
        symbols = "".join(rng.choices("ihtnswww", k=rng.randint(5, 14)))
        assert toxicity.clause_weight(symbols) == pytest.approx(plain_weight(symbols)), symbols


def test_clauses_count_and_not_words():
    model = toxicity.ToxicityModel(("grump", "oaf$"))
    weigh = lambda text: pytest.approx(model.evidence(text))
    assert weigh("You are an idiot.") == 1.5 and weigh("Nobody is an idiot.") == 0.5 and weigh('He said "an IDIOT"') == 0.75
    assert weigh("I will hurt you!") == 1.5 and weigh("Does it hurt? You see.") == 0 and weigh("all is well") == 0
    assert weigh("Ein grumpiger oaf; oafish, ungrump") == 2 and weigh(None) == weigh("") == 0
    assert weigh("idiot " + "w " * 5000 + "idiot") == 2


def test_toxicity_is_learned(spark, small):
    """Invented insults in two forms, one of them inflected, in copies and alone; labels of held-out rows are turned round."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abdefgilmnoprstu", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(1200):
        words, toxic = [word() for _ in range(60)], i % 4 == 0
        if toxic:
            words[rng.randrange(50)] = rng.choice(["quaxel", "zwirk" + word(), "zwirk" + word()])
        for k in range(9, 60, 10):
            words[k] += "."
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if crc32(str(i).encode()) % 5 else int(not toxic)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marked)
    assert set(model.stems) >= {"quaxel$", "zwirk"} and len(model.stems) <= 3
    out = toxicity.scored(docs, model).collect()
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in out)
    assert right >= 0.99 * len(out) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_query(spark, small):
    out = queries.op11_toxicity(spark, small).collect()
    assert len(out) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    named = [r.predicted for r in out if re.search(r"\b(idiot|moron|scum|loser)\b", (texts[r.doc_id] or "").lower())]
    assert named and sum(named) == len(named)


def scores(df):
    labels = df.sparkSession.createDataFrame([(i, 0, i % 2) for i in range(1, 9)] + [(None, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    return toxicity.scored(df, toxicity.fit(df, labels))


def test_odd_rows_of_toxicity(spark):
    out = scores(awkward(spark)).collect()
    assert len(out) == awkward(spark).count() and len({r.score for r in out if not r.text}) == 1
    assert scores(empty(spark)).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(awkward(spark), nothing)
    assert [r.predicted for r in toxicity.scored(spark.createDataFrame([("you idiot",), ("hello",)], "text string"), model).collect()] == [1, 0]


# divergence


def plain_audit(rows, least=10, most=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for text, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(w, r[2]) for w, r in zip(words, rows, strict=True) if r[1] == lang]
        df = Counter(x for w, _ in mine for x in set(w))
        kept = sorted((x for x, n in df.items() if n >= least), key=str.encode)
        counts = {s: Counter(x for w, t in mine if t == s for x in w if df[x] >= least) for s in {s for _, s in mine}}
        whole = sum(counts.values(), Counter())
        share = lambda c: {x: 1 + 1000000000 * (c[x] + 2) // (c.total() + 2 * len(kept)) for x in kept}  # noqa: E731, B023
        far = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(o, sum(far(p[s][x], p[o][x]) for x in kept)) for o in counts if o != s]
            terms = [(x, far(p[s][x], q[x])) for x in kept if counts[s][x] and p[s][x] > q[x]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))[: most if part == "term" else None]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def test_audit(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcXYZéß漢", k=rng.randint(1, 4))) for _ in range(120)] + ["a1b", "x-y", "\x7f"]
    rows = [(None, None, None), ("", "en", ""), (None, "xx", "s"), ("", "xx", "t"), ("b", "xx", None)]
    for _ in range(600):
        lang = rng.choice(["en", "en", "de", None])
        rows.append((" ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=rng.randint(0, 30))), lang, rng.choice(["s0", "s0", "s1", "é", "s2", None]) if lang else f"s{rng.randrange(9)}"))
    df = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, value string").repartition(7)
    want = plain_audit(rows)
    get = lambda: {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df).collect()}
    assert get() == want
    # small arrays, blocks and dictionaries: the same rows
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 40)
    assert get() == want


def test_odd_rows_of_the_audit(spark):
    assert divergence.audit(empty(spark)).count() == 0
    rows = {(r.lang, r.source, r.item, r.value) for r in divergence.audit(awkward(spark)).collect()}
    assert {(s, i) for lang, s, i, _ in rows if lang == "en"} == set(combinations(("", "a"), 2)) | {("a", "")}  # no term is in ten documents
    many = spark.createDataFrame([(LONG if i < 10 else f"{LONG}end",) for i in range(11)], "text string").selectExpr("text", "null as lang", "null as source")
    assert divergence.audit(many).count() == 0


def test_shares_are_exact():
    import numpy as np

    for count, base in ((0, 2), (5, 7), (9 * 10**13 - 2, 9 * 10**13 + 1), (123456789012, 987654321098)):
        assert divergence.shares(np.array([count]), base)[0] == 1 + 10**9 * (count + 2) // base


# alignment


def plain_alignment(texts):
    one, two, e = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), alignment.encoders(BYTES, PIECES)
    one.encode_special_tokens = True
    rows, links = [], []
    for text in texts:
        a, b = one.encode(f" {text}", add_special_tokens=False).ids if text else [], two.encode(text) if text else []
        parts = [[table[i] for i in ids] for table, ids in ((e.bytes_one, a), (e.bytes_two, b))]
        if not text or not b"".join(parts[0]) == b"".join(parts[1]) == f" {text}".encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [{}, {}]
        for side in (0, 1):
            at = 0
            for k, x in enumerate(parts[side]):
                at += len(x)
                ends[side][at] = k
        groups, i, j = [], 0, 0
        for at in sorted(ends[0].keys() & ends[1].keys()):
            groups.append((a[i : ends[0][at] + 1], b[j : ends[1][at] + 1]))
            i, j = ends[0][at] + 1, ends[1][at] + 1
        shown = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(shown.encode()).hexdigest()))
        links.append([(x[-1], y[-1]) for x, y in groups])
    counts, best = Counter(x for found in links for x in found), {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((*r[:3], len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), r[3]) for r, x in zip(rows, links, strict=True))


def digests(df):
    return Counter((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.alignments(df, BYTES, PIECES).collect())


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    odd = [None, "", " ", "a", "  a", " a ", "a\n \n b", "x\t y", "é漢字🎉  und", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "x y　z", "ab" * 3000, "\x00 \x1c a", "don't I'll we'VE 12 345 #$%"]
    bits = ["a", "b", "the", "ing", " ", " ", "\n", "\t", "é", "漢", "🎉", "'s", "12", " ", " ", "\x85", "̀", "!?", "\r"]
    return odd + ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(1500)]


def test_alignment(spark, odd_texts, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string").repartition(4)
    assert digests(df) == plain_alignment(odd_texts)


def test_long_texts_are_read_in_parts(spark, odd_texts, monkeypatch):
    """Parts of a text, and many small blocks, give the same rows."""
    two = alignment.encoders(BYTES, PIECES)
    text = " und ".join(t for t in odd_texts[:400] if t and "▁" not in t)
    df = spark.createDataFrame([(1, text), (2, "a b"), (3, None), (4, text)], "doc_id long, text string")
    want = digests(df)
    assert want == plain_alignment([text, "a b", None, text])
    monkeypatch.setattr(alignment, "BLOCK", 500)
    monkeypatch.setattr(alignment, "MOST_ROWS", 1)
    parts = list(alignment.parts_of(text, two))
    assert len(parts) > 10 and " ".join(parts) == text and digests(df) == want


def test_alignment_query(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = Counter((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op13_tokenizer_alignment(spark, small).collect())
    assert got == plain_alignment(texts)


def test_odd_rows_of_alignment(spark):
    out = alignment.alignments(awkward(spark), BYTES, PIECES).collect()
    assert len(out) == awkward(spark).count()
    assert {tuple(r)[1:] for r in out if r.doc_id in (2, 3)} == {(0, 0, 0, 0, 0, 0, "")}
    assert alignment.alignments(empty(spark), BYTES, PIECES).count() == 0
