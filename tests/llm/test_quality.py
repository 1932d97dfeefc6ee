import zlib

import numpy as np
import pyarrow as pa
import pytest

from rangeloom.llm import quality
from rangeloom.llm.queries import QUERIES


def test_passages_do_not_depend_on_the_batch():
    texts = ["", "one", " lead and  trail ", "A b. " * 200, "é日本 x", "\n\n", "word " * 49, "x" * 5000]
    whole = [x for x in quality.encode(pa.array(texts))]
    x, sizes = whole[0]
    assert sizes.tolist() == [1, 1, 1, 9, 1, 1, 2, 1] and x.shape[1] == quality.FEATURES
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, t in enumerate(texts):
        (alone, n), = quality.encode(pa.array([t]))
        assert n[0] == sizes[i] and np.allclose(alone, x[at[i] : at[i + 1]])


def test_gradients_lead_to_the_key_passage():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 12, 600)
    x = rng.normal(size=(sizes.sum(), 10)).astype(np.float32)
    label = rng.integers(0, 2, 600)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i in np.flatnonzero(label == 0):  # one odd passage makes the bag a bad one
        x[at[i] + rng.integers(sizes[i]), 3] += 6
    model = quality.train(x, sizes, label)
    right = (model.scores(x, sizes) >= 0.5) == label
    assert right.mean() > 0.95
    share = quality._forward(model.w, (x - model.mean) / model.scale, sizes)["share"]
    bad = np.flatnonzero(label == 0)
    assert np.mean([np.argmax(share[at[i] : at[i + 1]]) == np.argmax(x[at[i] : at[i + 1], 3]) for i in bad]) > 0.9


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x " * 50000, "c"), (None, "hi", "d"), (3, "x " * 50000, "e")], "doc_id long, text string, quality_score string")
    none = spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    got = quality.score(docs, model, carry=("doc_id",)).collect()
    assert len(got) == 5 and all(r.quality_score == 0.5 for r in got)
    both = spark.createDataFrame([(1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, both), carry=("doc_id",)).collect()
    assert all(0 <= r.quality_score <= 1 for r in got)
    assert got[0].quality_score == got[1].quality_score and len({r.quality_score for r in got if r.doc_id == 3}) == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in label if i in got and got[i].held_out]
    good = [got[i].predicted for i in held if label[i] == 1]
    bad = [got[i].predicted for i in held if label[i] == 0]
    print(len(good), np.mean(good), len(bad), np.mean(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25
