import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from geoweft.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "  a  b ", "a\n\n b\t c", "it's we'll  I'D", "x\x1c y \x1f z", "　a  b", "naïve Ωmega 東京 ñandú 👩‍👩‍👧", "a" * 5000, "ab " * 3000, "\r\n \r\n", "123 4567  89", "é ́"]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_equals_tiktoken(oracle):
    e, r = byte_bpe.encoder(PATH, P.PATTERN), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéèñüß ABC'.,!?\n\t0123東京ж"
    for text in ODD + ["".join(r.choices(letters, k=r.randrange(200))) for _ in range(1500)]:
        ids = memoryview(e.encode(text)).cast("I").tolist() if text else []
        assert ids == oracle.encode_ordinary(text or ""), text


def test_small_state_table_gives_the_same(oracle):
    t = byte_bpe.Transducer(byte_bpe.read_ranks(PATH), max_states=5)
    for w in ("unbelievablement", "Donaudampfschiff", "ononhheration" * 4):
        assert t.encode(w.encode()) == oracle.encode_ordinary(w)


def test_streaming_decode_by_single_tokens(oracle):
    e = byte_bpe.encoder(PATH, P.PATTERN)
    for text in ODD:
        ids = oracle.encode_ordinary(text or "")
        assert "".join(byte_bpe.decode_stream(ids, e.transducer.token, at_once=1)) == (text or "")
    assert "".join(byte_bpe.decode_stream([0], {0: b"a\xc3"})) == "a�"


def test_query_and_columns(spark, oracle):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    rows = byte_bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r.doc_id] or ""
        ids = oracle.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    there = docs.select("text", byte_bpe.decode(byte_bpe.encode(F.col("text"), PATH, P.PATTERN), PATH, P.PATTERN).alias("back"))
    assert all(r.back == (r.text or "") for r in there.collect())
    assert byte_bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
