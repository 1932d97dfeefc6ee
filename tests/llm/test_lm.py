import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rangeloom.llm import lm
from rangeloom.llm.queries import QUERIES


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def discounts(counts):
    n = Counter(counts)
    n1, n2, n3, n4 = (n[k] for k in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0), k) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


class Brute:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            self.bi.update(zip(["<s>", *w], w))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.follow = Counter(b for _, b in self.bi)
        self.d2, self.d1 = discounts(self.bi.values()), discounts(self.follow.values())
        self.total, self.held = Counter(), Counter()
        for (a, _), c in self.bi.items():
            self.total[a] += c
            self.held[a] += self.d2[min(c, 3) - 1]
        self.left = sum(self.d1[min(c, 3) - 1] for c in self.follow.values())

    def p1(self, w):
        all_ = sum(self.follow.values())
        if not all_:
            return 1 / (self.v + 1)
        c = self.follow[w]
        return (c - self.d1[min(c, 3) - 1] if c else 0) / all_ + self.left / all_ / (self.v + 1)

    def p2(self, a, w):
        if not self.total[a]:
            return self.p1(w)
        c = self.bi[a, w]
        return ((c - self.d2[min(c, 3) - 1] if c else 0) + self.held[a] * self.p1(w)) / self.total[a]

    def score(self, text):
        w = tokens(text)
        base = sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(self.uni[x] > 0 for x in w), base, sum(math.log10(self.p2(a, x)) for a, x in zip(["<s>", *w], w))


def check(got, want):
    assert got[:2] == want[:2]
    assert math.isclose(got[2], want[2], rel_tol=1e-9) and math.isclose(got[3], want[3], rel_tol=1e-9)


@pytest.mark.parametrize("shards", [1, 4, 64])
def test_against_brute_force(spark, shards):
    rng = random.Random(shards)
    text = lambda n: " ".join(rng.choice("The a of to cat dog ran é 日本".split()) if rng.random() < 0.7 else f"w{rng.randrange(400)}" for _ in range(n))
    train = [text(rng.randint(0, 60)) for _ in range(150)] + [None, "", " \n", "a " * 700]
    test = train + [text(30) for _ in range(20)] + ["never seen words", "unseen the cat", "x" * 30000]
    frame = lambda t: spark.createDataFrame([(i, x, 1) for i, x in enumerate(t)], "doc_id long, text string, score int")
    model, brute = lm.fit(frame(train), shards=shards), Brute(train)
    assert (model.tokens, model.words) == (brute.n, brute.v)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(frame(test).select("doc_id", "text"), model, carry=("doc_id",)).collect()}
    assert len(got) == len(test)
    for i, t in enumerate(test):
        check(got[i], brute.score(t))
    assert math.isclose(sum(brute.p2("cat", w) for w in brute.uni) + brute.p2("cat", "never"), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit(empty)
    row = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)
    assert lm.score(empty, model).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    brute = Brute([t for i, t in docs.items() if not fold[i]])
    got = QUERIES["op5_language_model"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    for r in got:
        assert (r.held_out, r.train_tokens) == (fold[r.doc_id], brute.n)
        check((r.n_tokens, r.n_known, r.base_score, r.score), brute.score(docs[r.doc_id]))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # it predicts unseen texts better
