"""Packing and byte-level BPE against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from broadsheet.llm import byte_bpe, packing, tokens

ODD = {
    9001: None, 9002: "", 9003: "  \n\t x  don't ''s   ", 9004: "a\x00b\x1c é ß 日本   12 ½ é", 9005: "z" * 30000, 9006: "<|endoftext|> x",
    9007: "a <|endoftext|> b", 9008: "x <|endoftext|><|endoftext|>", 9009: "<|endoftext|>", 9010: "a  <|endoftext|>  \n<|endoftext| >",
}


def _documents(spark):
    from tests.oracle import DATA

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()} | ODD
    return texts, spark.createDataFrame([(k, v, k, "p") for k, v in texts.items()], "doc_id long, text string, ids long, part string").repartition(3)


def test_packing(spark):
    texts, df = _documents(spark)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: t.encode(v or "", add_special_tokens=False).ids + [0] for k, v in texts.items()}
    pieces = packing.digest(df).collect()
    seen = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert (r.start, r.doc_tokens) == (seen.get(r.doc_id, 0), len(own))
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] = r.start + r.length
    assert seen == {k: len(v) for k, v in ids.items()}
    at = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    last = max(at)
    assert sorted(at) == list(range(last + 1)) and all(n == 1024 for s, n in at.items() if s != last) and at[last] <= 1024


def test_sequences(spark):
    _, df = _documents(spark)
    rows = packing.sequences(packing.pack(df, with_ids=True)).collect()
    assert {len(r.ids) for r in rows} == {4096}


def test_bpe_round_trip(spark):
    texts, df = _documents(spark)
    encoder = tokens.encoder(tokens.rank_file(tokens.MULTI))
    assert isinstance(encoder, tiktoken.Encoding)
    rows = byte_bpe.digest(df, limit=100_000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = encoder.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.digest(df).count() == 0
    assert byte_bpe.digest(df).count() == 0


def test_repeated_rows_and_null_id(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert packing.digest(df).count() == 3
    assert {r.n_tokens for r in byte_bpe.digest(df).collect()} == {2} and byte_bpe.digest(df).count() == 3
