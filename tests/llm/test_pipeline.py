import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rangeloom.llm.queries import QUERIES

from test_lines import brute as brute_lines
from test_neardup import brute as brute_near
from test_scans import brute_pii
from test_tokens_audio import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.dtypes == out[0].dtypes
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality(spark, stages):
    keep = {r.doc_id for r in QUERIES["op9_quality"](spark, SF).collect() if r.predicted}
    before = texts(stages[0])
    assert texts(stages[1]) == {i: t for i, t in before.items() if i in keep} and 0 < len(keep) < len(before)


def test_lines(stages):
    before, got = texts(stages[1]), texts(stages[2])
    first, want = brute_lines(before), {}
    for i, t in before.items():
        kept = [x for n, x in enumerate(t.split("\n")) if first.get((i, n), (i, n)) == (i, n)]
        if len(kept) == len(t.split("\n")) or any(x.strip(" \t\r") for x in kept):
            want[i] = "\n".join(kept)
    assert got == want and got != before


def test_copies(stages):
    before, got = texts(stages[2]), texts(stages[3])
    assert got == {i: before[i] for i, (_, _, kept) in brute_near(before, 5, 80).items() if kept}


def test_personal_data(stages):
    before, got = texts(stages[3]), texts(stages[4])
    assert got.keys() == before.keys()
    for i, t in before.items():
        spans = sorted(brute_pii(t), key=lambda s: (s[1], -s[2]))
        out, at = "", 0
        for kind, a, b in spans:
            if a >= at:
                out += t[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        assert got[i] == out + t[at:]
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_packing(stages):
    given = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: given.encode(t, add_special_tokens=False).ids + [1] for i, t in texts(stages[4]).items()}
    pieces = stages[5].collect()
    check_packing(pieces, {i: len(v) for i, v in ids.items()}, 2048, 128, 2048)
    assert all(np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length] for p in pieces)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
