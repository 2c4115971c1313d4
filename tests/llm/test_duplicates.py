"""Fingerprints, near duplicates, repeated strings and the pipeline against brute force."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import components, fingerprints, hamming, neardup, suffixes

DOCS = "doc_id long, text string, n_chars long, component_id string, print int"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def corpus():
    base = [prose(RNG.randint(30, 150)) for _ in range(40)]
    texts = list(base)
    for b in base[:12]:  # near copies
        words = b.split()
        for _ in range(3):
            words = list(words)
            words[RNG.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += [base[0]] * 9 + [None, "", "  \t", "One two", "ONE TWO", "a", "é" * 30, "ab " * 300]
    passage = prose(25)
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(6)] + [passage + " " + passage, base[3][10:90], "x" * 200, "x" * 120, "z" + "é" * 60]
    return texts


TEXTS = corpus()


def docs(spark, texts=None):
    texts = TEXTS if texts is None else texts
    return spark.createDataFrame([(i, t, len(t or ""), "c", 1) for i, t in enumerate(texts)], DOCS).repartition(5)


def plain_print(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark)).collect()}
    prints = [plain_print(t) for t in TEXTS]
    assert [got[i].fingerprint for i in range(len(TEXTS))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(TEXTS))] == plain_components(prints, 4)
    kept = neardup.keep_firsts(docs(spark))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(prints, 4))) and kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_near_duplicates_odd_rows(spark):
    assert neardup.near_duplicates(docs(spark, [])).collect() == []
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "q r s t u v"), (2, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1)]
    twice = spark.createDataFrame([(3, "m n o p q", z) for z in ("b", "a", "c")], "doc_id long, text string, z string").repartition(3)
    assert [tuple(r) for r in neardup.keep_firsts(twice).collect()] == [(3, "m n o p q", "a")]
    kept = neardup.keep_firsts(df.unionAll(df.filter("text = 'a b'")))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "a b"), (-1, "a b"), (1, "a b"), (1, "q r s t u v")]


@pytest.mark.parametrize("rows", [8, 2_048])
def test_hot_buckets_are_dealt(spark, rows):
    """Many prints close to each other: cells are salted, and no link is lost."""
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (120, 2))} | {int(x) for x in rng.integers(1 << 62, size=80)}
    prints = sorted(prints)
    df = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")), i, 1 + i % 3) for i, p in enumerate(prints)], "print binary, rep long, docs long")
    old, hamming.CELL_ROWS = hamming.CELL_ROWS, rows
    try:
        found = {r.node: r.component for r in components.components(hamming.star_links(df, 64, 4)).collect()}
        near = {r.rep: r.near for r in hamming.near_counts(df, 64, 4).collect()}
    finally:
        hamming.CELL_ROWS = old
    assert [found.get(i, i) for i in range(len(prints))] == plain_components(prints, 4)
    close = lambda i, j: i != j and (prints[i] ^ prints[j]).bit_count() <= 4
    assert [near.get(i, 0) for i in range(len(prints))] == [sum(1 + j % 3 for j in range(len(prints)) if close(i, j)) for i in range(len(prints))]


def test_tables_grow_with_the_strings():
    for strings in (1, 10**5, 10**8, 10**11):
        found = hamming.tables(64, 4, strings)
        assert strings / 2 ** min(map(len, found)) <= 4 * hamming.BUCKET_ROWS or len(found[0]) > 30
    # Any 4 errors leave some table's key untouched.
    for found in (hamming.tables(64, 4, 1), hamming.tables(64, 4, 10**8)):
        for _ in range(200):
            errors = set(RNG.sample(range(64), 4))
            assert any(not errors & set(key) for key in found)


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(500, 499), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 500: 499}
    assert components.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_fingerprints(spark):
    found = fingerprints.edited_pairs(docs(spark))
    got = {r.doc_id: r for r in found.collect()}
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        own, new, nxt = map(fingerprints.fingerprint, (t, changed, after))
        assert (bytes(r.print), bytes(r.edited_print)) == (own, new)
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, new), fingerprints.likeness(own, nxt))
    near = {bytes(r.print): r.n_near for r in fingerprints.near_documents(found.select("doc_id", "print")).collect()}
    held = [int.from_bytes(fingerprints.fingerprint(t)) for t in texts]
    for p in held:
        assert near[p.to_bytes(16, "big")] == sum((p ^ q).bit_count() <= fingerprints.RADIUS for q in held) - 1


def plain_simhash(text):
    """128 signed votes for each pair of neighbouring words, counted one bit at a time."""
    words = text.encode().split()
    terms = [b" ".join(p) for p in zip(words, words[1:])] or words
    votes = [0.0] * 128
    for term in set(terms):
        weight = 1 + math.log(terms.count(term))
        bits = xxhash.xxh3_128_intdigest(term)
        for b in range(128):
            votes[b] += weight if bits >> (127 - b) & 1 else -weight
    return sum(1 << (127 - b) for b in range(128) if votes[b] > 1e-6)


def test_fingerprints_by_votes(monkeypatch):
    monkeypatch.setattr(fingerprints, "VOTES", 16)
    for text in [t for t in TEXTS if t and len(t) < 2_000]:
        assert int.from_bytes(fingerprints.fingerprint(text)) == plain_simhash(text)
    assert fingerprints.fingerprint("") == fingerprints.fingerprint(None) == fingerprints.fingerprint(" \n") == bytes(16)


def test_fingerprints_odd_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edited_pairs(spark.createDataFrame([], schema)).collect() == []
    lone = fingerprints.edited_pairs(spark.createDataFrame([(5, "abcd")], schema)).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone.near_next == 1
    ties = fingerprints.edited_pairs(spark.createDataFrame([(1, "bb"), (1, "aa"), (None, "cc"), (2, None)], schema)).collect()
    want = {("cc", "ca"), ("aa", "ab"), ("bb", "b"), ("", "")}
    assert {r.edited_sha256 for r in ties} == {hashlib.sha256(x.encode()).hexdigest() for _, x in want} and len(ties) == 4
    many = [(i, f"t{i}") for i in range(2_000)]
    got = fingerprints.edited_pairs(spark.createDataFrame(many, schema).repartition(7)).collect()
    texts = [t for _, t in many] + ["t0"]
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256((t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2]).encode()).hexdigest() for i, t in many}


def plain_removed(rows):
    """rows of (doc_id, octets): the removed places of each."""
    least = {}
    for i, data in rows:
        if i is not None:
            for p in range(len(data) - 49):
                w = data[p : p + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, data in rows:
        gone = set()
        if i is not None:
            for p in range(len(data) - 49):
                if least[data[p : p + 50]] < i:
                    gone.update(range(p, p + 50))
        out.append(gone)
    return out


def plain_digest(rows):
    out = []
    for (i, data), gone in zip(rows, plain_removed(rows)):
        kept = bytes(b for p, b in enumerate(data) if p not in gone)
        out.append((i, len(data), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True, "tree"])
def test_suffixes(spark, small, monkeypatch):
    rows = [(i, (t or "").encode()) for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[1].encode()), (300, TEXTS[1].encode()), (300, TEXTS[1].encode()[5:]), (300, TEXTS[2].encode() * 2), (301, (prose(9) + "é" * 49).encode())]
    if small:  # long texts cross stretches, sorts are cut, groups are many
        monkeypatch.setattr(suffixes, "STRETCH", 256)
        monkeypatch.setattr(suffixes, "SORTED", 64)
        monkeypatch.setattr(suffixes, "plan_sizes", lambda size, parts: (23, 17))
    if small == "tree":  # two levels of buckets before the last
        monkeypatch.setattr(suffixes, "FAN", 4)
    df = spark.createDataFrame([(i, b.decode(), "e") for i, b in rows], "doc_id long, text string, grp string").repartition(4)
    got = sorted(map(tuple, suffixes.digest(df).collect()), key=str)
    assert got == plain_digest(rows)
    clean = suffixes.cleaned(df.withColumn("kind", F.lit(1)))
    assert clean.columns == ["doc_id", "text", "grp", "kind"] and clean.count() == len(rows)


def test_suffixes_odd_rows(spark):
    schema = "doc_id long, text string"
    assert suffixes.digest(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r)[:4] for r in suffixes.digest(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 0, 0)]
    assert suffixes.cleaned(spark.createDataFrame([(1, None)], schema)).first().text is None
    cut = suffixes.cleaned(spark.createDataFrame([(1, "é" * 25), (2, "é" * 25 + "è" + "x" * 9)], schema)).collect()
    assert {r.doc_id: r.text for r in cut} == {1: "é" * 25, 2: "è" + "x" * 9}


def plain_least(data, at, owner):
    least = {}
    for p, o in zip(at, owner):
        w = bytes(data[p : p + 50])
        least[w] = min(o, least.get(w, o))
    return [least[bytes(data[p : p + 50])] for p in at]


def odd_bytes(seed):
    """Bytes with long shared prefixes, runs, and repeats at many distances."""
    rng = np.random.default_rng(seed)
    words = [bytes(rng.integers(97, 100, n).tolist()) for n in (3, 17, 30, 49, 50, 51, 70)]
    parts = [words[i] for i in rng.integers(0, len(words), 60)] + [b"z" * 300, bytes(rng.integers(0, 256, 400).tolist()), b"z" * 120]
    return np.frombuffer(b"".join(parts), np.uint8)


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_are_sorted(seed):
    data = odd_bytes(seed)
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(len(data) - 50, (len(data) - 50) * 2 // 3, replace=False))
    sorter = suffixes.Sorter(data, at)
    order, equal = sorter.order()
    texts = [bytes(data[at[i] : at[i] + 50]) for i in order]
    assert texts == sorted(texts) and equal.tolist() == [a == b for a, b in zip(texts, texts[1:])]
    i, j = rng.integers(0, len(at), (2, 500))
    seed_same = [bytes(data[at[a] : at[a] + suffixes.SEED]) == bytes(data[at[b] : at[b] + suffixes.SEED]) for a, b in zip(i, j)]
    i, j = i[seed_same], j[seed_same]
    common = [len(os.path.commonprefix([bytes(data[at[a] : at[a] + 50]), bytes(data[at[b] : at[b] + 50])])) for a, b in zip(i, j)]
    assert sorter.extension(i, j).tolist() == common
    owner = rng.integers(0, 30, len(at))
    assert suffixes.repeats(data, at, owner).tolist() == plain_least(data, at.tolist(), owner.tolist())


def test_comparisons_decide_the_order(monkeypatch):
    """Without them the runs stay in the order of their first bytes, and verification must sort them."""
    data = odd_bytes(1)
    at = np.arange(len(data) - 50)
    asked = []
    real = suffixes.Sorter.extension
    monkeypatch.setattr(suffixes.Sorter, "extension", lambda self, i, j: asked.append(len(i)) or real(self, i, j))
    suffixes.Sorter(data, at).order()
    assert sum(asked) > 0


@pytest.mark.parametrize("multiplier", [0, 1 << 56])
def test_collisions_are_verified(multiplier, monkeypatch):
    """Every hash collides, or most do: the bytes decide."""
    monkeypatch.setattr(suffixes.Sorter, "hashes", lambda self, i, length, real=suffixes.Sorter.hashes: real(self, i, length) * np.uint64(multiplier))
    data = np.frombuffer(b"a" * 50 + b"b" * 50 + b"a" * 50, np.uint8)
    assert suffixes.repeats(data, np.array([0, 50, 100]), np.array([1, 2, 3])).tolist() == [1, 2, 1]
    for seed in range(3):
        data = odd_bytes(seed)
        at, owner = np.arange(len(data) - 50), np.random.default_rng(seed).integers(0, 9, len(data) - 50)
        assert suffixes.repeats(data, at, owner).tolist() == plain_least(data, at.tolist(), owner.tolist())


@pytest.mark.parametrize("most", [50, 400, 10_000])
def test_keys_of_more_suffixes_than_a_sort_holds(most, monkeypatch):
    monkeypatch.setattr(suffixes, "SORTED", most)
    seen = []
    real = suffixes.Sorter.__init__
    monkeypatch.setattr(suffixes.Sorter, "__init__", lambda self, data, at: seen.append(len(at)) or real(self, data, at))
    data = np.concatenate([odd_bytes(3), np.full(3_000, 120, np.uint8), odd_bytes(3)])
    rng = np.random.default_rng(1)
    # One key for runs of many suffixes; and a key for each first byte, of single suffixes.
    long = np.arange(0, len(data) - 130, 70)
    single = np.arange(len(data) - 50)
    for start, count, key in ((long, np.full(len(long), 70), np.zeros(len(long), np.uint64)), (single, np.ones(len(single), np.int64), data[single].astype(np.uint64))):
        owner, got = rng.integers(0, 50, len(start)), {}
        for places, run, least in suffixes.settled(data, start, count, key, owner):
            assert (start[run] <= places).all() and (places < start[run] + count[run]).all()
            got.update(zip(places.tolist(), least.tolist()))
        at = [int(p) for s, n in zip(start, count) for p in range(s, s + n)]
        assert [got[p] for p in at] == plain_least(data, at, np.repeat(owner, count).tolist())
    assert max(seen) <= 6 * max(most, 70)


def test_a_passage_in_every_group(spark, monkeypatch):
    """One passage in all documents of many groups: no task sorts more than its senders' one copy each."""
    monkeypatch.setattr(suffixes, "plan_sizes", lambda size, parts: (40, 3))
    monkeypatch.setattr(suffixes, "FAN", 5)
    passage = prose(40)
    rows = [(i, (prose(8) + " " + passage + " " + prose(8)).encode()) for i in range(300)] + [(None, passage.encode())] * 50
    df = spark.createDataFrame([(i, b.decode()) for i, b in rows], "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffixes.digest(df).collect()), key=str) == plain_digest(rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from gristmill.llm import common, packing

    rng = random.Random(4)
    junk = [" ".join(w.upper() + "!!$" for w in prose(30).split()) for _ in range(60)]
    good = [prose(rng.randint(20, 120)) for _ in range(140)]
    texts = good + junk + [good[0], good[1] + " tail", prose(10) + " " + good[2][:120] + " " + prose(10)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 140), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.schema.names == df.schema.names
        seen.append({r.doc_id: r.text for r in kept.collect()})
    first, second, third = seen
    assert not set(first) & set(range(140, 200)) and set(range(140)) <= set(first)
    prints = {i: plain_print(t) for i, t in first.items()}
    ids = sorted(prints)
    label = plain_components([prints[i] for i in ids], 4)
    assert set(second) == {ids[x] for x in set(label)} and 200 not in second
    rows = sorted((i, t.encode()) for i, t in second.items())
    assert third == {i: bytes(b for p, b in enumerate(d) if p not in gone).decode("utf-8", "ignore") for (i, d), gone in zip(rows, plain_removed(rows))} and len(third[202]) < len(texts[202])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(third) and all(r.length <= packing.CAPACITY for r in out)
    common.forget(spark)
    assert not common._paths
