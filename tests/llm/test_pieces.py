"""SentencePiece encoding and decoding against the library and against merging pairs as they are defined."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quire.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "\n", "\n\n a", "a", " a", "a  b\n c ▁▁ d ▁e", "▁", "<s> </s> <unk> <0x41>", "ﬁ é́ 日本語😀 \x00﻿​", "Word.Word,word ..., .com 3.14", "tab\there\r\n", "x" * 5000, "aaaaaaab" * 90]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Vocabulary(open(PATH, "rb").read())


def test_random_texts(own, library):
    r = random.Random(3)
    for k in range(4000):
        signs = (" ▁\n\tabcdefghinoprst.,019ABéß日😀\x00<>s/", "aeinrst ▁oul", "the nation of ")[k % 3]
        x = "".join(r.choice(signs) for _ in range(r.randint(0, 60)))
        ids = own.encode(x).tolist()
        assert ids == library.encode(x), x
        assert own.decode(ids) == library.decode(ids)


def test_every_prefix(own):
    r = random.Random(4)
    for _ in range(300):
        x = "▁" + "".join(r.choice("aeinst▁.é日") for _ in range(12))
        last = own.last_pieces(x)
        for n in range(1, len(x) + 1):
            assert own.merge(x[:n])[-1] == own.name(last[n - 1])


def test_decoding_any_ids(own, library):
    r = random.Random(5)
    rows = [[r.choice([r.randrange(32000), r.randrange(259), r.randrange(3, 259), 28705][: 4 - 3 * (k % 2)]) for _ in range(r.randint(0, 12))] for k in range(6000)]
    for ids in rows:
        assert own.decode(ids) == library.decode(ids), ids
    assert own.decoded(pa.array(rows, pa.list_(pa.int32()))[7:]).to_pylist() == [library.decode(x) for x in rows[7:]]


def test_tables(spark, library, tmp_path):
    rows = [(k % 5 if k % 7 else None, x, "own", [1]) for k, x in enumerate([*ODD, *ODD])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    want = [(i, library.encode(x or "")) for i, x, *_ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert all(r.decoded == library.decode(r.ids) for r in got)
    assert pieces.encode(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([3, None, 264],)], "ids array<int>")
    assert [r.text for r in pieces.decode(odd, PATH, out="text").collect()] == [None, "", library.decode([3, 264])]
    docs.select(F.monotonically_increasing_id().alias("doc_id"), "text").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r.doc_id: r for r in queries.op13_sentencepiece(spark, str(tmp_path)).collect()}
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(told[r.doc_id])[1:] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
