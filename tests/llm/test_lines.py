import hashlib
import random

import pytest

from rangeloom.llm import lines
from rangeloom.llm.lines import SHINGLE, dedup_lines, line_components
from rangeloom.llm.queries import QUERIES


def shingles(line):
    u = line.encode("utf-16-be")
    return {u[2 * i : 2 * i + 2 * SHINGLE] for i in range(max(1, len(u) // 2 - SHINGLE + 1))}


def brute(docs, percent=80):
    """First line of each line's component, by comparing all lines that share a shingle."""
    lines = {(d, n): t for d, text in docs.items() for n, t in enumerate((text or "").split("\n")) if t.strip(" \t\r")}
    sets, by, up = {}, {}, {}
    for k, t in lines.items():
        up.setdefault(t, t)
        if t not in sets:
            sets[t] = shingles(t)
            for s in sets[t]:
                by.setdefault(s, []).append(t)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = set()
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        up[root(a)] = root(b)
    first = {}
    for k in sorted(lines):
        first.setdefault(root(lines[k]), k)
    return {k: first[root(t)] for k, t in lines.items()}


def result(df):
    return {(r.doc_id, r.no): tuple(r.first) for r in df.collect()}


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs.items()], "doc_id long, text string, line string, no int")


@pytest.mark.parametrize("seed,edits", [(1, 1), (2, 4), (3, 10)])
def test_components_against_brute_force(spark, seed, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéfg日") for _ in range(rng.randint(2, 8)))
    bases = [[word() for _ in range(rng.randint(3, 40))] for _ in range(40)]
    docs = {}
    for d in range(60):
        out = []
        for _ in range(8):
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        docs[d] = "\n".join(out)
    got, want = result(line_components(frame(spark, docs))), brute(docs)
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)


def test_one_hot_line_and_chains(spark):
    rng = random.Random(7)
    line = "this very common line of text stands in every single document of them"
    docs = {d: f"{line}\nown {rng.getrandbits(200):x} text {rng.getrandbits(200):x}" for d in range(300)}
    out = {r.doc_id: r for r in dedup_lines(frame(spark, docs)).collect()}
    assert [d for d, r in out.items() if r.text == docs[d]] == [0]
    assert all(r.n_kept == 1 for d, r in out.items() if d)


def test_odd_rows(spark):
    docs = {1: None, 2: "", 3: "\n\n", 4: "a\n\na\n ", 5: "short\nSHORT\nshort", 6: "x" * 100_000 + "\ny", 7: "x" * 90_000, 8: "é" * 20 + "\r\n" + "é" * 20 + "\r", 9: "a"}
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in dedup_lines(frame(spark, docs)).collect()}
    assert got == {
        1: ("", 1, 1), 2: ("", 1, 1), 3: ("\n\n", 3, 3), 4: ("a\n\n ", 4, 3), 5: ("short\nSHORT", 3, 2), 6: (docs[6], 2, 2), 7: ("", 1, 0),
        8: ("é" * 20 + "\r", 2, 1), 9: ("", 1, 0)}
    assert dedup_lines(frame(spark, docs).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "same line here"), (1, "same line here"), (None, "same line here")], "doc_id long, text string")
    assert [r.text for r in dedup_lines(twice).collect()] == ["same line here"] * 3


def test_lines_without_spaces(spark):
    rng = random.Random(11)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(120))
    path = "://" + "".join(rng.choice("abcdefghij/-_0123456789") for _ in range(131))
    row = "\t".join(f"{rng.getrandbits(40):x}" for _ in range(25))
    base64 = "".join(rng.choice("ABCDEFGHabcdefgh0123+/") for _ in range(200))
    pairs = [(chinese, "中" + chinese), ("https" + path, "http" + path), (row, "x" + row), (row.replace("\t", ","), "x" + row.replace("\t", ",")), (base64, "Z" + base64)]
    docs = {2 * i + k: t for i, p in enumerate(pairs) for k, t in enumerate(p)}
    got, want = result(line_components(frame(spark, docs))), brute(docs)
    assert all(want[2 * i + 1, 0] == (2 * i, 0) for i in range(len(pairs)))
    assert got == want


def test_lines_of_few_words(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = {}
    for i in range(300):
        rest = f"{word(5)} in. {word(10)} and."
        docs[2 * i], docs[2 * i + 1] = "T" + rest, "A t" + rest
    similar = [i for i in range(300) if len(shingles(docs[2 * i]) & shingles(docs[2 * i + 1])) >= 0.8 * len(shingles(docs[2 * i]) | shingles(docs[2 * i + 1]))]
    got = result(line_components(frame(spark, docs)))
    assert len(similar) == 300
    assert sum(got[2 * i + 1, 0] != (2 * i, 0) for i in similar) <= 4  # 0.5 expected


def test_independent_minima_on_short_lines(spark):
    rng = random.Random(13)
    docs = {}
    for i in range(4000):  # eight shingles in common of ten: similarity 0.8
        docs[2 * i] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16))
        docs[2 * i + 1] = docs[2 * i][:-1] + "0"
    got = result(line_components(frame(spark, docs)))
    assert sum(got[2 * i + 1, 0] != (2 * i, 0) for i in range(4000)) <= 20  # 7 expected


def test_a_bucket_of_two_is_compared_once(spark, monkeypatch):
    rng = random.Random(14)
    docs = {}
    for i in range(50):
        docs[2 * i] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150))
        docs[2 * i + 1] = docs[2 * i] + "0"
    rows, keep = {}, lines.materialize

    def counted(df, tag):
        out = keep(df, tag)
        rows[tag] = rows.get(tag, 0) + out[0].count()
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    assert result(line_components(frame(spark, docs))) == brute(docs)
    assert rows["links"] == 50 and rows["labelled"] == 0  # each pair is its bucket: nothing is left to compare
    assert rows["minima"] == 100 * lines.GROUPS  # a row for each line and group, and none made twice


def test_rows_are_sifted_before_an_exchange(spark, monkeypatch):
    rng = random.Random(15)
    docs = {i: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60)) for i in range(600)}
    docs |= {600 + i: docs[i] + "0" for i in range(20)}
    kept, sift = [], lines._sift

    def counted(rows, some, key):
        out = sift(rows, some, key)
        kept.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(lines, "_sift", counted)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)  # as if every table were too long
    assert result(line_components(frame(spark, docs))) == brute(docs)
    # Bands of each part, minima and texts: 40 of 620 lines have something in common.
    assert len(kept) == 5 and all(0 < few < 0.1 * all_ for all_, few in kept)


def test_few_keys_and_few_exact_tests(spark, monkeypatch):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    docs = {}
    for _ in range(20):  # families of lines, many of which are about as similar as the threshold
        base = [word() for _ in range(40)]
        for _ in range(30):
            line = list(base)
            for _ in range(rng.randint(1, 3)):
                line[rng.randrange(40)] = word()
            docs[len(docs)] = " ".join(line)
    rows, keys, keep, among = {}, [], lines.materialize, lines._among

    def counted(df, tag):
        out = keep(df, tag)
        rows[tag] = rows.get(tag, 0) + out[0].count()
        return out

    def counted_keys(some_rows, some, on, how="inner"):
        if on == ["key"]:
            keys.append(some_rows.count())
        return among(some_rows, some, on, how)

    monkeypatch.setattr(lines, "materialize", counted)
    monkeypatch.setattr(lines, "_among", counted_keys)
    assert result(line_components(frame(spark, docs))) == brute(docs)
    assert sum(keys) <= 10 * len(docs)  # 25 bands a line before
    assert rows["bits"] <= len(docs)  # of each line once at most
    assert rows["links"] < 2 * len(docs)  # not each pair of two components


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    first = brute(docs)
    got = QUERIES["op3_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and sum(r.n_lines - r.n_kept for r in got) > 0
    for r in got:
        kept = [t for n, t in enumerate((docs[r.doc_id] or "").split("\n")) if first.get((r.doc_id, n), (r.doc_id, n)) == (r.doc_id, n)]
        assert (r.n_kept, r.text_sha256) == (len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
