import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rangeloom.llm import hyperminhash as hmh
from rangeloom.llm.graph import connected_components
from rangeloom.llm.neardup import near_duplicates, plan_bands
from rangeloom.llm.queries import QUERIES
from rangeloom.llm.shingles import shingle_sets

np.seterr(over="ignore")


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def union_find(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    links, seen = [], set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        links.append((a, b))
    comp = union_find(docs, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in docs}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_shingle_sets_count_like_sets():
    texts = ["", " ", "One", "a B", "a b c", "A b C a b c A B C", "x\x0by\x0cz\tq\r\nw", "é É é É ñ", "\x1ca b c d", "a\xa0b c d e", "w " * 400]
    for k in (1, 3, 5):
        got = shingle_sets(pa.array(texts), k)
        assert [len(x) for x in got] == [len(shingles(t, k)) for t in texts]
    a, b = shingle_sets(pa.array(["One two", "one TWO"]), 3)
    assert (a == b).all()


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(1)
    for n in (3, 20, 200, 5000):
        errors = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[: max(1, int(n * 0.9))], rng.integers(0, 1 << 64, n // 10, dtype=np.uint64)]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(float(hmh.estimate(hmh.registers(x), hmh.registers(y))) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    far = [float(hmh.estimate(hmh.registers(np.unique(rng.integers(0, 1 << 64, 900, dtype=np.uint64))), hmh.registers(np.unique(rng.integers(0, 1 << 64, 900, dtype=np.uint64))))) for _ in range(300)]
    assert np.mean(far) < 0.002


def test_band_plans():
    for percent in (60, 70, 80, 85, 90, 95):
        bands, rows = plan_bands(percent)
        assert bands * rows <= hmh.BUCKETS and (1 - (percent / 100) ** rows) ** bands < 1e-6
    with pytest.raises(ValueError):
        plan_bands(5)


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = union_find({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in comp.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a long, b long")).count() == 0


def variants(rng, n_groups, size, words, edits):
    docs, i = {}, 0
    for _ in range(n_groups):
        base = [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = "z" + str(rng.randrange(10**6))
            docs[i] = " ".join(w)
            i += 1
    return docs


@pytest.mark.parametrize("words,edits,size", [(8, 2, 20), (60, 4, 20), (400, 25, 30), (60, 8, 700)])
def test_near_duplicates_against_brute_force(spark, words, edits, size):
    docs = variants(random.Random(words + size), 12 if size < 100 else 1, size, words, edits)
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    assert result(near_duplicates(df, words=3, percent=85)) == brute(docs, 3, 85)


def test_default_threshold(spark):
    docs = variants(random.Random(8), 12, 25, 90, 5)
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(docs, 5, 80)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one"), (6, "one"), (7, "a b c d " * 30000), (8, "a b c d " * 29999), (9, "one two three"), (None, "one two three")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, component_id int, fp string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words=3, percent=85).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True),
        (7, 4, 7, True), (8, 4, 7, False), (9, 1, 9, True), (None, 1, None, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert result(QUERIES["op2_minhash"](spark, "/root/testdata/sf0.01")) == brute(docs, 3, 85)
