import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from geoweft.llm import packing

PATH = P.path("word_bpe_49k.json")


def check(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_documents_against_the_library(spark):
    t = Tokenizer.from_file(PATH)
    texts = ["", None, "Hello, world's it!", "a\x1cb c", "Été　NAÏVE ΣΑΣ ό", "<|endoftext|> x", "a<|endoftext|>B.<|ENDOFTEXT|>, <|endoftext|>!? <|startoftext|>\x1cx", "word " * 9000, "x y\nz\t w", "1234 5"] + ["lorem ipsum " * k for k in range(1, 60)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(3, "a\x1cb c", "q"), (None, "z", "q"), (9007199254740993, "z", "q")], "doc_id long, text string, piece string")
    rows = packing.pack_documents(docs, PATH).collect()
    check(rows)
    found = {(r.doc_id, r.piece): r for r in rows}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            one = ids[a : a + 4096]
            r = found.pop((i, p))
            assert (r.start, r.length, r.ids_crc32) == (a, len(one), zlib.crc32(np.array(one, "<u4").tobytes()))
    assert set(found) == {(None, 0), (9007199254740993, 0)} and len([r for r in rows if r.doc_id == 3]) == 2
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
    apart = packing.pack(packing.pieces(docs, PATH)).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(apart, key=str) == sorted(((r.doc_id, r.piece, r.ids_crc32) for r in rows), key=str)


def test_few_sequences_in_many_rounds(spark):
    r = random.Random(9)
    sizes = [r.choice([1, 7, 40, 300, 900, 1500, 2500, 4000, 4096]) for _ in range(3000)]
    parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECE).repartition(16)
    rows = packing.pack(parts, block=100, group=50).collect()
    assert len(rows) == 3000 and check(rows) <= 1.03 * len(packing.best_fit(sizes, 4096))
    big = spark.createDataFrame([(i, 0, 0, 3000, 0) for i in range(500)], packing.PIECE)
    assert check(packing.pack(big, block=50, group=20).collect()) == 500
