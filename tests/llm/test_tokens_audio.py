import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rangeloom.llm import packing, telephony, wordtok
from rangeloom.llm.bytebpe import ByteBPE, decode_documents, encode_documents
from rangeloom.llm.queries import QUERIES
from rangeloom.llm.wordtok import WordTokenizer

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "it's we'RE they'll o''s", "x" * 5000, "ab" * 3000, "  \n\t  leading", "tail   ", "naïve CAFÉ. Straße! ÉÈ,",
    "日本語テキスト with mixed ١٢٣ numbers 12345", "emoji 👩‍👩‍👧 zero​width", "a\x00b\x1cc\x85d\xa0e", "<|endoftext|> and <|startoftext|>x",
    "ΣΑΣ İstanbul ǅ ﬁ é é", "!!??..,,;;--", "def f(x):\n    return x**2\n\n\n", "'s't're've'm'll'd", " " * 3000, "0" * 2000, "»quoted«. x».", "same", "same",
]


def rows(spark, extra="text2 string"):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], f"doc_id long, text string, {extra}")


def documents(spark):
    return [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]


def test_word_ids_are_the_tokenizers(spark):
    own, given = WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    for t in [t or "" for t in ODD] + documents(spark):
        assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == given.encode(t, add_special_tokens=False).ids, t[:80]


def test_word_ids_of_every_character():
    own, given = WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    texts = [f"ad{c}. {c}a, V{c}L{c}; .{c}! {c}" for c in map(chr, [*range(0x21, 0xD800), *range(0xE000, 0x20000)])] + ["Lİ.", "adı VELİ, sonra", "İİ. İ!", "a|b | || <|endoftext|>."]
    for t, ids in zip(texts, own.encode_texts(pa.array(texts))):
        assert ids.tolist() == given.encode(t, add_special_tokens=False).ids, t


def test_word_ids_with_a_tiny_cache_and_long_texts(monkeypatch):
    monkeypatch.setattr(wordtok, "_SLICE", 4096)
    rng, given, own = random.Random(5), Tokenizer.from_file(WORDS), WordTokenizer(WORDS, cache_bytes=1 << 14)
    word = lambda: "".join(rng.choice("aBcdé.,日'") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 40, 5000]))) for _ in range(60)] + ["x" * 20000 + " y", "", " \n"]
    for t, ids in zip(texts, own.encode_texts(pa.array(texts))):
        assert ids.tolist() == given.encode(t, add_special_tokens=False).ids, t[:80]
    assert own.old.size + own.young.size < 4 << 20


def check_packing(pieces, lengths, seq_len, segments, loss):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert {k: sum(p.length for p in v) for k, v in by_doc.items()} == lengths
    for v in by_doc.values():
        at = 0
        for p in sorted(v, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert {p.doc_tokens for p in v} == {at}
    for v in by_seq.values():
        at = 0
        for p in sorted(v, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= seq_len and len(v) <= segments and sum(p.loss_tokens for p in v) <= loss
    return 1 - sum(lengths.values()) / (seq_len * len(by_seq))


def test_packing_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = Tokenizer.from_file(WORDS)
    ids = {r.doc_id: given.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    got = packing.pack_documents(docs, WORDS).collect()
    waste = check_packing(got, {k: len(v) for k, v in ids.items()}, 2048, 128, 2048)
    assert waste < 0.03
    for p in got:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length]


def test_packing_odd_rows_and_crc(spark):
    got = packing.pack_documents(rows(spark), WORDS, seq_len=64, max_segments=3, window=4).withColumn("c", F.crc32("ids")).collect()
    given = Tokenizer.from_file(WORDS)
    want = {i: given.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(ODD)}
    check_packing(got, {k: len(v) for k, v in want.items()}, 64, 3, 64)
    for p in got:
        assert p.c == zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    assert packing.pack_documents(rows(spark).limit(0), WORDS).count() == 0


def test_packing_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    given = Tokenizer.from_file(WORDS)
    ids = {i: given.encode(t, add_special_tokens=False).ids + [1] for i, t in docs.items()}
    got = QUERIES["op1_packing"](spark, "/root/testdata/sf0.001").collect()
    assert check_packing(got, {k: len(v) for k, v in ids.items()}, 2048, 2048, 2048) < 0.03
    for p in got:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())


def test_packing_of_tiny_texts_and_null_ids(spark):
    got = packing.pack_documents(spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).coalesce(1), WORDS).collect()
    assert len(got) == 10_000 and len({p.sequence_id for p in got}) == 5
    got = packing.pack_documents(spark.createDataFrame([(None, "a b"), (None, None), (2, "c")], "doc_id long, text string"), WORDS).collect()
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in got) == [(0, 1), (0, 3), (2, 2)]


def test_packing_conversations_query(spark):
    got = QUERIES["pack_conversations"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for p in got:
        n = by.setdefault(p.sequence_id, [0, 0, 0])
        by[p.sequence_id] = [n[0] + p.length, n[1] + 1, n[2] + p.loss_tokens]
    assert max(n[0] for n in by.values()) <= 2048 and max(n[1] for n in by.values()) <= 32 and max(n[2] for n in by.values()) <= 1536
    talk = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (1, 1, "user", "b"), (1, 0, "user", "c d")], "conv_id long, turn int, role string, text string")
    assert sorted((p.doc_id or 0, p.length, p.loss_tokens) for p in packing.pack_conversations(talk, WORDS).collect()) == [(0, 2, 0), (0, 2, 0), (1, 5, 0)]


def test_packing_repeated_rows(spark):
    got = packing.pack_documents(spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string").coalesce(1), WORDS).collect()
    assert sorted(p.offset for p in got) == [0, 3, 6]


def test_packing_limits_loss_tokens(spark):
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = packing.pack_conversations(talk, WORDS, seq_len=256, max_segments=4, max_loss_tokens=100).collect()
    given, want, loss = Tokenizer.from_file(WORDS), {}, {}
    for r in talk.collect():
        n = len(given.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id] = want.get(r.conv_id, 0) + n
        loss[r.conv_id] = loss.get(r.conv_id, 0) + n * (r.role == "assistant")
    check_packing(got, want, 256, 4, 100)
    by = {}
    for p in got:
        by[p.doc_id] = by.get(p.doc_id, 0) + p.loss_tokens
    assert by == loss


def test_dot_product_beats_naive_order():
    rng, items = random.Random(1), []
    for i in range(400):
        items.append(np.zeros(rng.randint(5, 120), "<u4"))
    p, n = packing.VectorPacker(128, 8, 128, 64), 0
    for i, x in enumerate(items):
        n += sum(1 for _ in p.add(i, x, None))
    n += sum(1 for _ in p.finish())
    assert n <= 1.05 * sum(map(len, items)) / 128 + 1


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_ids_are_those_of_merging_by_rank(spark, reference):
    bpe = ByteBPE.load(RANKS, P.PATTERN)
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghinorst'  -.éß0\n") for _ in range(rng.randint(0, 300))) for _ in range(1500)]
    glued = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 900))) for _ in range(150)]
    for t in [t or "" for t in ODD] + documents(spark) + noise + glued:
        ids = np.frombuffer(bpe.encode(t), "<i4").tolist()
        assert ids == reference.encode_ordinary(t), t[:60]
        assert bpe.decode(ids) == t.encode()


def test_bpe_query(spark, reference):
    got = {r.doc_id: r for r in QUERIES["op8_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_bpe_odd_rows(spark):
    enc = encode_documents(rows(spark), RANKS, P.PATTERN)
    got = {r.doc_id: bytes(r.decoded) for r in decode_documents(enc, RANKS, P.PATTERN).collect()}
    assert got == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert encode_documents(rows(spark).limit(0), RANKS, P.PATTERN).count() == 0


def slow_mulaw(code):
    code = ~code & 255
    size = (((code & 15) * 8 + 132) << ((code >> 4) & 7)) - 132
    return -size if code & 128 else size


def slow_alaw(code):
    code ^= 0x55
    e, m = (code >> 4) & 7, code & 15
    size = m * 16 + 8 if e == 0 else (m * 16 + 264) << (e - 1)
    return size if code & 128 else -size


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            diff = step >> 3
            diff += step if nib & 4 else 0
            diff += step >> 1 if nib & 2 else 0
            diff += step >> 2 if nib & 1 else 0
            value = max(-32768, min(32767, value - diff if nib & 8 else value + diff))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nib & 7]))
            out.append(value)
    return out


def test_tables_and_adpcm():
    assert telephony.MULAW.tolist() == [slow_mulaw(c) for c in range(256)]
    assert telephony.ALAW.tolist() == [slow_alaw(c) for c in range(256)]
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 256, (7, 40), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]


def test_resampling_keeps_samples_and_tones():
    t = np.arange(800)
    tone = (8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    wide = telephony.resample(tone, 2, telephony._phases(2))
    assert (wide[::2] == tone).all()
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert np.abs(wide - want)[40:-40].max() < 40


@pytest.mark.parametrize("codec", ["mixed", *telephony.CODECS])
def test_media_round_trip(spark, codec):
    stored = telephony.store_texts(rows(spark), codec=codec)
    got = telephony.decode_media(stored, carry=("doc_id", "n_bytes")).collect()
    assert len(got) == len(ODD)
    for r in got:
        raw = (ODD[r.doc_id] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert bytes(r.payload) == want and r.n_bytes == len(raw)
        assert codec in ("mixed", r.codec)
        pcm = np.frombuffer(r.pcm, "<i2")[::2].tolist()
        if r.codec == "mulaw":
            assert pcm == [slow_mulaw(c) for c in want]
        elif r.codec == "alaw":
            assert pcm == [slow_alaw(c) for c in want]
        else:
            assert pcm == [x for i in range(0, len(want), 288) for x in slow_adpcm(bytes(4) + want[i : i + 288])]
    assert len({r.feature for r in got if ODD[r.doc_id] == "same"}) == 1
    assert telephony.store_texts(rows(spark).limit(0)).count() == 0


def test_media_query(spark):
    got = QUERIES["op7_telephony"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
