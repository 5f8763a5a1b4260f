"""Operators against brute force over the smallest table."""

import hashlib
import json
import random
import re
import struct
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import xxhash
import zstandard

sys.path.insert(0, str(Path(__file__).parent))

import public_tokenizers
from lexmill.llm import licenses, line_dedup, media, near_copies, packing, piece_encoding, queries, sharding, simhash, suffix_dedup, vantage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, small, name):
    return queries.queries()[name](spark, small).collect()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def plain_lines(docs, chars=40, least=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    at = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= chars:
                at[key(x)].add(i)
    out = {}
    for i, t in docs.items():
        kept = [x for x in t.split("\n") if not (len(at[key(x)]) >= least and i != max(at[key(x)]))]
        out[i] = (t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark, small, docs):
    want = {i: (n, d, sha(k)) for i, (n, d, k) in plain_lines(docs).items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows(spark, small, "op1_line_dedup")} == want


def plain_fingerprint(text, words=4):
    w = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, small, docs):
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    groups = plain_components(fps, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, small, "op2_simhash")} == {i: (f"{fps[i]:016x}", groups[i]) for i in fps}


def test_hierarchical_index_on_dense_fingerprints():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 300):
        base = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
        f = base[rng.integers(0, len(base), n)]
        for _ in range(5):
            f = f ^ ((np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * rng.integers(0, 2, n, dtype=np.uint64))
        f = np.unique(f)
        gray = f.copy()
        for by in (1, 2, 4, 8, 16, 32):
            gray ^= gray >> np.uint64(by)
        f = f[np.argsort(gray)]
        got = simhash.linked(f, 4)
        want = plain_components(dict(enumerate(f.tolist())), 4)
        assert got.tolist() == [want[i] for i in range(len(f))]


def test_chain_of_links_in_pieces(spark):
    """A long chain of fingerprints four bits apart is one component."""
    fps = [0]
    for k in range(40):
        fps.append(fps[-1] ^ (0b1111 << (4 * k % 61)))
    df = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(), i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, rep long")
    from lexmill.llm.components import components

    roots = components(simhash.simhash_links(df), "u", "v").collect()
    assert {r.root for r in roots} == {0} and len(roots) == len(set(fps)) - 1


@pytest.mark.parametrize(("hot", "broadcast"), [(25, 1000), (25, 0), (1000, 1000)])
def test_split_nodes_lose_no_link(spark, hot, broadcast, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_LARGE", broadcast)
    from lexmill.llm.components import components

    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = list({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}) for b in base for _ in range(60)})
    df = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(), i) for i, f in enumerate(fps)], "fp long, rep long")
    assert max(r["count"] for r in simhash.dealt(df, 4, hot).groupBy("key").count().collect()) <= hot
    roots = {r.node: r.root for r in components(simhash.simhash_links(df, hot=hot), "u", "v").collect()}
    assert {i: roots.get(i, i) for i in range(len(fps))} == plain_components(dict(enumerate(fps)), 4)


def test_near_copies_find_edited_texts_alone(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts, of = [], {}
    for g in range(30):
        base = [word() for _ in range(300)]
        for _ in range(3):
            copy = list(base)
            for _ in range(g % 2 and 2 or 6):  # similarities of about 0.87, and of about 0.67, which is too little
                copy[rng.randrange(300)] = word()
            of[len(texts)] = g
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = near_copies.near_copies(df).collect()
    assert all(of[r.doc_id] == of[r.component_id] and of[r.doc_id] % 2 for r in gone)
    assert len(gone) >= 28  # of 30
    assert near_copies.keep_one(df).count() == 90 - len(gone)


def edited_copies(seed, n=600, length=120):
    """Copies of one text with 2 to 4 words changed each: most pairs are just below or above 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(length), rng.randint(2, 4)):
            copy[at] = word()
        out.append(" ".join(copy))
    return out


def alike(a, b, least=0.8):
    return len(a & b) >= least * len(a | b)


def plain_groups(sets, linked):
    """Smallest member of the component of each set, with links where ``linked`` says."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if (a := top(i)) != (b := top(j)) and linked(i, j):
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def near_candidates(texts, most=60, tables=44, bits=14):
    """Whether two texts share a mask's bits and differ in at most ``most``."""
    fps = np.array([near_copies.wide_fingerprint(t) for t in texts])
    ones = np.unpackbits(fps.astype(">u8").view(np.uint8), axis=1).astype(np.int16)
    near = ones @ (1 - ones).T + (1 - ones) @ ones.T <= most
    share = np.zeros_like(near)
    for t in range(tables):
        mine = ones[:, np.random.default_rng(1 + t).choice(256, bits, replace=False)]
        share |= (mine[:, None] == mine[None]).all(2)
    return near & share


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_verify_every_candidate(spark, seed):
    texts = edited_copies(seed)
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    may = near_candidates(texts)
    want = plain_groups(sets, lambda i, j: may[i, j] and alike(sets[i], sets[j]))
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == want
    whole = plain_groups(sets, lambda i, j: alike(sets[i], sets[j]))
    assert len(set(want)) <= 1.02 * len(set(whole))  # masks lose few links


def test_large_nodes_are_split_without_loss(spark, monkeypatch):
    texts = edited_copies(3)
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    may = near_candidates(texts)
    want = plain_groups(sets, lambda i, j: may[i, j] and alike(sets[i], sets[j]))
    seen, node = spark.sparkContext.accumulator(0), near_copies.candidates

    def counting(batches, *how):
        def rows():
            for batch in batches:
                if len(batch):
                    seen.add(int(batch.groupby("key").size().max() > 100))
                yield batch

        return node(rows(), *how)

    monkeypatch.setattr(near_copies, "candidates", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(df, hot=60).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == want
    assert seen.value == 0  # no task has a large node whole


def test_repeats_make_no_near_copies_and_hide_none(spark):
    rng = random.Random(7)
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    filler, base = "filler " * 400, some(150)
    often = base + (" " + " ".join(base.split()[:5])) * 300
    texts = [filler + some(100), filler + some(100), base, often]
    found = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.component_id) for r in found] == [(3, 2)]


def test_vantage_points(spark, small):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    found = defaultdict(list)
    for r in sorted(rows(spark, small, "op3_vantage_point"), key=lambda r: r["rank"]):
        found[r.query_id].append((r.score, r.vec_id))
    for q in (i for i in vectors if i % 100 == 0):
        want = sorted((float(np.sqrt(np.cumsum((vectors[q] - vectors[c]) ** 2)[-1])), c) for c in vectors if c != q)[:10]
        assert found[q] == want


def test_vantage_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    data += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] + [1.0] * 7), (2300, [None] + [1.0] * 7), (None, [1.0] * 8), (2400, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    out = {}
    for factor in (1.0, 1.3):
        out[factor] = {(r.query_id, r.vec_id) for r in vantage.nearest(df, factor=factor, shard_rows=400, block_rows=8).collect()}
    assert {q for q, _ in out[1.0]} == set(range(0, 1500, 100))
    x = np.array([np.float32(v) for _, v in data[:1500]], float)
    want = {(q, int(c)) for q in range(0, 1500, 100) for c in [j for j in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable") if j != q][:10]}
    assert out[1.0] == want
    assert len(out[1.3] & want) >= 0.9 * len(want)


def test_vantage_ids_with_several_vectors(spark):
    rng = np.random.default_rng(6)
    data = [(int(i), rng.normal(size=4).tolist()) for i in rng.integers(0, 300, 900)]
    df = spark.createDataFrame(data + data[:50], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in sorted(vantage.nearest(df, shard_rows=100, block_rows=3).collect(), key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, round(r.score, 9)))
    by = defaultdict(list)
    for i, v in data:
        by[i].append(np.array(v))
    for q in (i for i in by if i % 100 == 0):
        want = sorted((min(float(np.sqrt(((a - b) ** 2).sum())) for a in by[q] for b in by[c]), c) for c in by if c != q)[:10]
        assert found[q] == [(c, round(d, 9)) for d, c in want]


def test_trees_survive_packing():
    rng = np.random.default_rng(7)
    for n in (1, 64, 65, 1000):
        tree = vantage.VantageTree(np.arange(n), rng.normal(size=(n, 3)))
        again = vantage.VantageTree.unpacked(tree.packed())
        q = rng.normal(size=(20, 3))
        for one, two in zip(tree.search(q, np.full(20, -1), 5, 1.0), again.search(q, np.full(20, -1), 5, 1.0), strict=True):
            assert np.array_equal(one, two)


def test_tokenizer_is_the_librarys(docs):
    tokens = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    pool = [chr(c) for c in range(0x20, 0x250)] + list("\n\t.,.,'  ")
    texts = [*docs.values(), "<|endoftext|> a", "Ω ΑΣ", "x,, y., _, a_. b. c.\nd", *("".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(3000))]
    for text in texts:
        assert tokens.encode(text) == struct.pack(f"<{len(ids := tokens.library.encode(text, add_special_tokens=False).ids)}I", *ids), text[:80]


def test_packing(spark, small, docs):
    library = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).library
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, small, "op4_best_fit_packing"):
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in docs.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        got = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, a, len(ids[a : a + 2048]), zlib.crc32(struct.pack(f"<{len(ids[a:a + 2048])}I", *ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1


def plain_best_fit(histogram, capacity):
    room = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("kind", ["uniform", "odd", "lognormal", "tight"])
def test_plan_is_never_worse_than_best_fit(kind):
    rng = random.Random(12)
    lengths = {
        "uniform": lambda: rng.randint(1, 512), "odd": lambda: rng.randrange(1, 512, 2), "lognormal": lambda: min(512, max(1, int(rng.lognormvariate(4, 1.2)))), "tight": lambda: rng.randint(100, 260)
    }[kind]
    histogram = Counter(lengths() for _ in range(1500))
    made = packing.plan(dict(histogram), 512)
    assert Counter(n for parts, times in made for n in parts * times) == histogram and all(sum(parts) <= 512 for parts, _ in made)
    assert sum(t for _, t in made) <= plain_best_fit(histogram, 512)


def test_sums_are_those_of_what_remains():
    rng = random.Random(13)
    have = {n: rng.randint(1, 3) for n in rng.sample(range(1, 65), 30)}
    sums = packing.Sums(have, 64)
    for _ in range(40):
        pairs = Counter(a + b for a in have for b in have if a <= b and have[a] + have[b] - (a == b) * (have[a] - (have[a] > 1)) > 1 and (a < b or have[a] > 1))
        assert {s: int(c) for s, c in enumerate(sums.pairs) if c} == dict(pairs)
        gap = rng.randint(1, 64)
        singles = [n for n, c in have.items() for _ in range(min(c, 3))]
        some = gap in have or gap in pairs or any(a + b + c == gap for i, a in enumerate(singles) for j, b in enumerate(singles) if j > i for c in singles[j + 1 :])
        found = sums.exact(gap, ())
        assert (sum(found) == gap and all(have.get(n, 0) >= k for n, k in Counter(found).items())) if some else found == ()
        n = rng.choice(list(have))
        sums.take(n, 1)
        have[n] -= 1
        if not have[n]:
            del have[n]
        if not have:
            break


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 20), 64]) for _ in range(500))
    made = packing.plan(dict(lengths), 64)
    used = Counter()
    for parts, times in made:
        assert sum(parts) <= 64
        for n in parts:
            used[n] += times
    assert used == lengths
    assert sum(t for _, t in made) <= -(-sum(n * c for n, c in lengths.items()) // 64) + 2


def test_pieces_of_the_library(spark, small, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in rows(spark, small, "op5_sentencepiece"):
        text = docs[r.doc_id]
        ids = library.encode(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        # the library's own alignment, but for bytes of a character, of which it gives the last the span
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        whole = [k for k in range(len(ids)) if not library.is_byte(ids[k])]
        mine = piece_encoding.model(path).encode(text)
        assert [mine[k][1:] for k in whole] == [spans[k] for k in whole]
        assert r.spans_sha256 == sha(struct.pack(f"<{2 * len(ids)}q", *(a for _, a, _ in mine), *(b for _, _, b in mine)))


def test_piece_spans_and_random_texts():
    model = piece_encoding.model(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(7)
    pool = [*"abc  \n\t\r.,<>|0x19é▁ß​漢字🎉\x00́", "<s>", "</s>", "<unk>", "<0x41>", "the", " of"]
    long = ["".join(rng.choices("aeinrst漢 ", (9, 9, 9, 9, 9, 9, 9, 1, 1), k=rng.randint(60, 400))).replace(" ", "") for _ in range(200)]
    for text in [*long, "the" * 30000, "", " ", "▁", "  \n  ", *("".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(3000))]:
        ids = library.encode(text)
        ((found, _, _),) = model.encoded([text])
        assert (found.tolist(), model.decimals(found), model.decoded(found)) == (ids, ",".join(map(str, ids)), library.decode(ids))
        spans = model.encode(text)
        assert [i for i, _, _ in spans] == ids
        data, whole = text.encode(), b""
        for (_, a, b), after in zip(spans, [*spans, None][1:], strict=True) if spans else ():
            whole += data[a:b] if after is None or (after[1], after[2]) != (a, b) or a == b else b""
        assert whole == data


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_of_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    blob = dict(piece_encoding.fields(dict(piece_encoding.fields(library.serialized_model_proto()))[3]))[2]
    model = piece_encoding.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    model.map, model.dummy, model.escape, model.squeeze = piece_encoding.CharacterMap(blob), False, False, False
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choices([*"ﬁＡ①é éｶﾞ　㍿Ǆß\t\n…", "abc"], k=rng.randint(1, 12)))
        normal, places = model.normalised(text, align=True)
        assert normal == library.normalize(text)
        assert len(places) == len(normal.encode()) + 1 and places == sorted(places) and places[-1] == len(text.encode())


def plain_repeats(texts, width):
    data = [t.encode() for t in texts]
    seen = Counter(hash(x[i : i + width]) for x in data for i in range(len(x) - width + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if seen[hash(x[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


def held(text, gone):
    data = np.frombuffer(text.encode(), np.uint8)
    return len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(data[~gone].tobytes())


def test_suffix_dedup(spark, small, docs):
    want = {i: held(t, g) for (i, t), g in zip(docs.items(), plain_repeats(docs.values(), 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, small, "op6_suffix_dedup")} == want


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup_on_edited_and_periodic_texts(spark, seed):
    rng = random.Random(seed)
    stock = ["".join(rng.choices("abcdé \n", k=rng.randint(150, 700))) for _ in range(6)]
    texts = ["a" * 1000, "ab" * 450, "a" * 250, "", stock[0] + stock[0]]
    for _ in range(40):
        text = "".join(rng.choice([*stock, "".join(rng.choices("abxyz", k=rng.randint(1, 300)))]) for _ in range(rng.randint(0, 5)))
        at = rng.randrange(len(text)) if text else 0
        texts.append(text[:at] + "#" + text[at + 1 :] if text and rng.random() < 0.5 else text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: held(t, g) for i, (t, g) in enumerate(zip(texts, plain_repeats(texts, 200), strict=True))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.counted(df).collect()} == want


def test_parts_of_a_long_text_own_each_window_once(monkeypatch):
    import pandas as pd

    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh ", k=20000))
    frame = pd.DataFrame({"k": [1], "mark": [2], "text": [text]})
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    starts = []
    for keys, parts in suffix_dedup.portions(iter([frame]), 200):
        runs = suffix_dedup.owned(keys, parts, 200, 48)
        for a, n in zip(runs["start"], runs["length"], strict=True):
            starts += range(a, a + n)
    assert sorted(starts) == list(range(20000 - 199))


def test_quality_on_held_out_rows(spark, small):
    sf = small.replace("0.001", "0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in rows(spark, sf, "op7_quality") if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    good, bad = ([r.predicted for r in found if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2


def test_quality_scores_by_brute_force(spark, small):
    from lexmill.llm import quality

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert quality.fit(docs, labels) == model
    good, bad = (zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False) for d in (model.good, model.bad))
    found = {r.doc_id: (r.score, r.predicted) for r in rows(spark, small, "op7_quality")}
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        a, b, n = len(good.compress(data)), len(bad.compress(data)), len(data)
        x = ((b - a) / n, (b - a) / (a + b), a / n, (a / n) ** 2) if data else (0.0,) * 4
        score = 1 / (1 + np.exp(-np.clip(model.weights[0] + np.dot(x, model.weights[1:]), -40, 40)))
        assert found[r.doc_id][0] == pytest.approx(score, abs=1e-9) and found[r.doc_id][1] == (found[r.doc_id][0] >= 0.3)


def test_quality_sample_is_bounded_and_of_whole_texts(spark, monkeypatch):
    from lexmill.llm import quality

    seen = []
    monkeypatch.setattr(quality.zstandard, "train_dictionary", lambda size, data: seen.append(data) or (_ for _ in ()).throw(zstandard.ZstdError("none")))
    long = "x" * 9000
    texts = spark.createDataFrame([(i, f"{i} {long}") for i in range(1, 60) for _ in range(3)] + [(i, f"{i} z") for i in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    quality.fit(texts, labels, per_class=10, most_bytes=60_000)
    for data in seen:
        assert all(len(x) > 9000 and x.endswith(b"x" * 9000) for x in data)  # one text an id, whole
        assert 1 <= len(data) <= 3 and len(set(data)) == len(data)  # half of what 60,000 bytes hold


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_licenses(text):
    words, places, labels = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOWER)), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, small, docs):
    for r in rows(spark, small, "op8_licenses"):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(docs[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules(spark):
    from lexmill.llm import licenses

    assert len(licenses.rules()) > 200
    cases = {
        "MIT License mit license x": ("mit", "mit"), "Licensed under the Apache License, Version 2.0": ("apache", "apache,apache-2.0"), "CC-BY-SA-4.0": ("cc-by", "cc-by,cc-by-sa-4.0"),
        "SPDX-License-Identifier: GPL-3.0-or-later": ("", "gpl-3.0"), "This is free and unencumbered software released into the public domain.": ("", "unlicense"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)": ("", "mit"),
        "CeCILL license": ("", "cecill"), "Apache-2.0": ("", "apache-2.0"), "GPLv3 or, at your option, any later version": ("", "gpl-3.0"), "LGPLv2.1+": ("", "lgpl-2.1"),
        "mit der Lizenz": ("", ""), "Redistribution and use in source and binary forms, with or without modification, are permitted": ("", "bsd"),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.base_labels, r.labels, r.n_base, r.first_word, r.last_word) for r in licenses.scan(df).collect()}
    assert {i: x[:2] for i, x in got.items()} == dict(enumerate(cases.values()))
    assert got[0][2:] == (2, 0, 2)


def plain_image(data):
    """Width, height, depth and samples of a grey image without filters, read chunk by chunk."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        chunks.append((kind, body))
        at += size + 12
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", dict(chunks)[b"IHDR"])
    assert (colour, *rest) == (0, 0, 0, 0) and chunks[-1] == (b"IEND", b"")
    raw = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    lines = [raw[k : k + width + 1] for k in range(0, len(raw), width + 1)]
    assert len(lines) == height and all(x[0] == 0 for x in lines)
    return width, height, depth, b"".join(x[1:] for x in lines)


def plain_feature(data):
    rows = [data[k : k + 64] for k in range(0, len(data), 64)]
    mean = lambda x: sum(x) / len(x) if len(x) else 0.0
    spread = (sum((b - mean(data)) ** 2 for b in data) / len(data)) ** 0.5
    entropy = -sum(c / len(data) * np.log2(c / len(data)) for c in Counter(data).values())
    each, more = divmod(len(rows), 4)
    cuts = [0]
    for k in range(4):
        cuts.append(cuts[-1] + each + (k < more))
    return [mean(data), spread, entropy, *(mean(b"".join(rows[a:b])) for a, b in zip(cuts, cuts[1:], strict=False))]


def test_media(spark, small, docs):
    stored = media.stored(spark.read.parquet(f"{small}/documents.parquet")).collect()
    images = {}
    for r in stored:
        where, path = media.opened(r.shard)
        with where.open_input_file(path) as f:
            images[r.digest] = f.read_at(r.length, r.offset)
    assert len({(r.shard, r.offset) for r in stored}) == len(set(docs.values()))  # equal texts are stored once
    for r in rows(spark, small, "op9_media"):
        data = docs[r.doc_id].encode()
        full = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), sha(full), zlib.crc32(full[-64:]))
        image = images[r.media_sha256]
        assert plain_image(image) == (r.width, r.height, r.bits, full)
        assert (r.media_bytes, r.media_sha256) == (len(image), sha(image))
        assert [float(x) for x in r.feature.split(";")] == pytest.approx(plain_feature(full), abs=6e-5)


def test_media_headers_and_shared_entries(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, "x" * 100), (3, None), (4, "é" * 40)], "doc_id long, text string").coalesce(1)
    stored = media.stored(df)
    found = {r.doc_id: r for r in media.metadata(stored).collect()}
    assert {i: (r.width, r.height, r.bits) for i, r in found.items()} == {1: (64, 2, 8), 2: (64, 2, 8), 3: (64, 1, 8), 4: (64, 2, 8)}
    assert (found[1].shard, found[1].offset) == (found[2].shard, found[2].offset)
    import tarfile

    where, path = media.opened(found[1].shard)
    with where.open_input_stream(path) as f, tarfile.open(fileobj=f, mode="r|") as tar:
        members = {m.name: (m.offset_data, m.size) for m in tar}
    assert members == {f"{r.digest[:2]}/{r.digest}.png": (r.offset, r.length) for r in found.values()}


def test_sharding(spark, small, docs):
    found = rows(spark, small, "op10_interleaved_sharding")
    assert sorted(r.doc_id for r in found) == sorted(docs)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode()), "rows", None)
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_parts_follow_the_count():
    assert sharding.parts(0, 100) == (0, 1) and sharding.parts(100, 100) == (0, 1) and sharding.parts(1601, 100) == (2, 17)
    assert sharding.parts(10**11, 100_000) == (5, 10**6)


@pytest.mark.parametrize("part_rows", [7, 100_000])
def test_shards_do_not_depend_on_the_parts(spark, small, part_rows):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(sharding.sharded(df, part_rows=part_rows).collect()) == sorted(sharding.sharded(df, part_rows=50).collect())


def test_shards_match_the_mixture_and_sql(spark, small):
    import duckdb

    df = spark.createDataFrame([(i, "t" * (i % 7), "hot" if i % 3 else f"s{i % 8}") for i in range(3200)], "doc_id long, text string, source string")
    found = sharding.sharded(df).collect()
    for source, n in Counter(r.source for r in found).items():
        per = Counter(r.shard for r in found if r.source == source)
        assert all(abs(per[s] - n / 16) <= 2 for s in range(16))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = {r[0]: r[1:] for r in connection.execute(f"select doc_id, size, text_crc32, shard, slot from ({sharding.ORACLE})").fetchall()}
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in rows(spark, small, "op10_interleaved_sharding")} == want


def test_oracles_name_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert json.dumps(sorted(queries.queries()))


def test_plans_come_through_exact_fillings(small):
    """On the tables' own lengths the emitted plan is one of exact fillings, in no more bins than best fit."""
    import pyarrow.parquet as pq

    rng = random.Random(14)
    encode = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode
    histograms = []
    for folder in (small, small.replace("0.001", "0.01")):
        lengths = [len(encode(t or "")) // 4 + 1 for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()]
        histograms.append(Counter(n for x in lengths for n in [2048] * (x // 2048) + [x % 2048] * (x % 2048 > 0)))
    histograms += [Counter(rng.randint(1, 2048) for _ in range(400)), Counter(rng.choice([1000, 1048, 300, 748, 24]) for _ in range(300))]
    for histogram in histograms:
        ways = packing.plans(dict(histogram))
        bins = {name: sum(times for _, times in way) for name, way in ways.items()}
        emitted = packing.plan(dict(histogram))
        name = next(n for n, way in ways.items() if way == emitted)
        assert name != "best fit" and bins[name] == min(bins.values()) <= bins["best fit"]
        assert Counter(n for lengths, times in emitted for n in lengths for _ in range(times)) == +histogram
        exact = sum(times for lengths, times in emitted if sum(lengths) == 2048 and len(lengths) > 1)
        assert exact > 0 and all(sum(lengths) <= 2048 for lengths, _ in emitted)


def test_common_contents_meet_their_keeper_by_content_and_id(spark, monkeypatch):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(60)] + [(None, "same text"), (None, None), (2, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    columns = ["doc_id", "n_bytes", "payload_sha256", "media_sha256", "media_bytes", "feature"]
    get = lambda: Counter(tuple(r) for r in media.features(media.metadata(media.dealt(media.stored(df)))).select(columns).collect())
    want = get()
    monkeypatch.setattr(media, "FEW", 0)
    assert get() == want and sum(want.values()) == 63


def sample_of(pattern, rng):
    """A random text that a rule's pattern takes; the patterns know groups, choices, options, classes and gaps."""
    import re._parser as parser

    def made(parts):
        out = []
        for kind, value in parts:
            kind = str(kind)
            if kind == "LITERAL":
                out.append(chr(value))
            elif kind == "ANY":
                out.append(rng.choice("abc"))
            elif kind == "IN":
                out.append(chr(rng.choice(value)[1]))
            elif kind == "BRANCH":
                out.append(made(rng.choice(value[1])))
            elif kind == "SUBPATTERN":
                out.append(made(value[3]))
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = value
                out.append("".join(made(inner) for _ in range(rng.randint(low, min(high, low + 5)))))
            else:
                raise AssertionError(kind)
        return "".join(out)

    return " ".join(made(parser.parse(pattern)).split())


def test_gates_lose_no_match():
    """Every rule's own matches hold its keyword as a word and its second literal."""
    rng = random.Random(15)
    for label, _, keyword, also, pattern in licenses.rules():
        for _ in range(60):
            text = f" x {sample_of(pattern, rng)} y "
            assert re.search(f"(?<= )(?:{pattern})(?= )", text), (label, pattern, text)
            assert f" {keyword} " in text and also in text, (label, pattern, text)


def test_priority_counts_in_containment(spark):
    rows = [(1, "Released under the FreeBSD BSD License."), (2, "SPDX-License-Identifier: MIT"), (3, "distributed under the boost software licence"), (4, "simplified BSD license"), (5, "GNU General Public License version 2")]
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == ("bsd-2-clause", 0.65) and found[4] == ("bsd-2-clause", 0.65) and found[2] == ("mit", 0.95)
    assert found[3][0] == "boost" and found[3][1] == 0.88 and found[5][0] == "gpl,gpl-2.0"
    spans = [(label, priority, m.start(), m.end()) for label, priority, _, _, pattern in licenses.rules() for m in re.finditer(f"(?<= )(?:{pattern})(?= )", " this program is free software you can redistribute it and or modify it under the terms of the gnu general public license ")]
    kept = {a[0] for a in spans if not any(b != a and b[1] >= a[1] and b[2] <= a[2] and b[3] >= a[3] for b in spans)}
    text = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
    assert set(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels.split(",")) == kept


def test_regions_leave_most_trees_unopened(spark):
    """In clustered vectors a query opens its own region and few others, and finds what all would; one vector that a third
    of all rows hold is dealt over shards."""
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(32, 8)) * 40
    points = np.vstack([centres[rng.integers(32, size=3000)] + rng.normal(size=(3000, 8)), np.tile(centres[:1], (1500, 1))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {}
    for factor in (1.0, 3.0):
        for r in vantage.nearest(df, factor=factor, shard_rows=150).collect():
            got.setdefault(factor, {}).setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for q in range(0, 4500, 100):
        d = np.zeros(len(points))
        for j in range(8):
            d += (points[q, j] - points[:, j]) ** 2
        d = np.sqrt(d)
        want = sorted((x, i) for i, x in enumerate(d.tolist()) if i != q)[:10]
        assert [(x, i) for _, x, i in sorted(got[1.0][q])] == want
    same = sum(len({i for *_, i in got[1.0][q]} & {i for *_, i in got[3.0][q]}) for q in got[1.0])
    assert same >= 0.9 * 10 * len(got[1.0])

    regions = vantage.Regions(points, 30)
    assert 16 <= regions.size <= 30
    home = regions.of(points)
    who, region = regions.open(points[::100], np.full(45, 8.0), 1.0)
    assert set(zip(range(45), home[::100].tolist(), strict=True)) <= set(zip(who.tolist(), region.tolist(), strict=True))
    assert len(who) <= 45 * regions.size / 3
    for q, near in zip(points[::100], range(45), strict=True):  # whatever is within reach is in an open region
        inside = home[np.sqrt(((points - q) ** 2).sum(1)) <= 8.0]
        assert set(inside.tolist()) <= set(region[who == near].tolist())
