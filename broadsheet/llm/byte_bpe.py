"""Byte-level BPE over a global shuffle of distinct words.

1. Every input partition splits its texts into pre-tokens with their positions.  Pre-aggregation: a block of texts keeps its
   distinct words once, sorted, and every document becomes the positions of its pre-tokens in that list.
2. The distinct words of all blocks are shuffled by the hash of the word; there each distinct word is encoded once, and the
   ids go back to the blocks that asked, in the order in which they asked.
3. Ids and documents of a block meet, every document is reassembled by position; decoding joins the token-byte table
   (bounded by the vocabulary) to the ids.

Words and ids travel as one compressed value per block and hash bucket, so a word that occurs everywhere is one entry per block,
and no bucket holds more than its share of the distinct words.  A block holds at most ``BLOCK`` bytes of text or one longer text.

Defined results: a null or empty text has no ids; both checksums are those of the empty string.  Repeated texts and doc_ids
are encoded each for itself.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import tokens
from broadsheet.llm.common import bucketed

BLOCK = 24 << 20
#: text bytes whose distinct words fill one hash bucket
BUCKET_BYTES = 16 << 20

BLOCKS = "block long, bucket int, payload binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _pack_words(words: list[str]) -> bytes:
    body = "".join(words).encode()
    sizes = np.array([len(w.encode()) for w in words], dtype="<u4").tobytes()
    return zstandard.compress(len(words).to_bytes(8, "little") + sizes + body, 3)


def _unpack_words(payload: bytes) -> list[bytes]:
    raw = zstandard.decompress(payload)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64) + 8 + 4 * n
    starts = [8 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist())]


def _pack_ids(ids: list[list[int]]) -> bytes:
    sizes = np.array(list(map(len, ids)), dtype="<u2" if max(map(len, ids), default=0) < 65536 else "<u4")
    flat = array("I", (i for word in ids for i in word))
    head = f"{len(ids)},{sizes.itemsize};".encode()
    return zstandard.compress(head + sizes.tobytes() + np.asarray(flat, dtype="<u2" if max(flat, default=0) < 65536 else "<u4").tobytes(), 3)


def _unpack_ids(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and the ids of all words one after the other."""
    raw = zstandard.decompress(payload)
    head, _, _ = raw.partition(b";")
    n, width = map(int, head.split(b","))
    at = len(head) + 1
    sizes = np.frombuffer(raw, f"<u{width}", n, at).astype(np.int64)
    rest = raw[at + n * width :]
    total = int(sizes.sum())
    return sizes, np.frombuffer(rest, f"<u{len(rest) // total}" if total else "<u2")


def _pack_documents(docs: list[int], lengths: list[int], positions: array) -> bytes:
    """doc ids, pre-tokens per document, and positions as bytes of 7 bits, low first."""
    p = np.asarray(positions, dtype=np.uint32)
    size = 1 + (p >= 1 << 7) + (p >= 1 << 14) + (p >= 1 << 21) + (p >= 1 << 28)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - size
    for k in range(5):
        more = size > k
        out[at[more] + k] = (p[more] >> (7 * k) & 127) | ((size[more] > k + 1) << 7)
    head = json.dumps([len(docs), [k for k, d in enumerate(docs) if d is None]]).encode() + b"\n"
    doc = np.array([d or 0 for d in docs], dtype="<i8")
    return zstandard.compress(head + doc.tobytes() + np.array(lengths, dtype="<u8").tobytes() + out.tobytes(), 3)


def _unpack_documents(payload: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    raw = zstandard.decompress(payload)
    head, _, body = raw.partition(b"\n")
    n, nameless = json.loads(head)
    docs = np.frombuffer(body, "<i8", n).tolist()
    for k in nameless:
        docs[k] = None
    lengths = np.frombuffer(body, "<u8", n, 8 * n).tolist()
    b = np.frombuffer(body, np.uint8, -1, 16 * n).astype(np.uint32)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    p = np.zeros(len(last), np.uint32)
    for k in range(5):
        more = first + k <= last
        p[more] |= (b[first[more] + k] & 127) << (7 * k)
    return docs, lengths, p


def blocks(documents: DataFrame, buckets: int, limit: int = BLOCK) -> DataFrame:
    """Rows of two kinds: bucket -1 holds the documents of a block, the others its distinct words of that hash bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, number = tokens.pieces(), TaskContext.get().partitionId(), 0

        def fresh():
            return [], [], array("I"), defaultdict(count().__next__)

        def flush() -> pa.RecordBatch:
            words = list(seen)
            at = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % buckets
            # words by bucket, sorted: alike words stand together and compress well; rank is the new position of each
            order = sorted(range(len(words)), key=lambda k: (at[k], words[k]))
            by_bucket: dict[int, list[str]] = defaultdict(list)
            for k in order:
                by_bucket[int(at[k])].append(words[k])
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            block = part * (1 << 24) + number
            # positions stay in order of first appearance (small for frequent words); rank leads to the sorted list
            payload = _pack_documents(docs, lengths, positions)
            lead = zstandard.compress(rank.tobytes(), 3)
            rows = [(block, -1, len(payload).to_bytes(8, "little") + payload + lead)]
            rows += [(block, b, _pack_words(ws)) for b, ws in by_bucket.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCKS.types)], schema=_BLOCKS)

        docs, lengths, positions, seen = fresh()
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = split(text)
                docs.append(doc)
                lengths.append(len(found))
                positions.extend(map(seen.__getitem__, found))
                held += len(text)
                if held >= limit:
                    yield flush()
                    docs, lengths, positions, seen = fresh()
                    held, number = 0, number + 1
        if docs:
            yield flush()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def encode_words(words: DataFrame, raw: bytes) -> DataFrame:
    """Per hash bucket: each distinct word is encoded once; every block gets the ids of its words in its order."""
    def run(group: pa.Table) -> pa.Table:
        encoded = tokens.encoder(raw).encode_ordinary
        known: dict[bytes, list[int]] = {}
        out = []
        for k in range(group.num_rows):
            ws = _unpack_words(group.column("payload")[k].as_py())
            for w in ws:
                if w not in known:
                    known[w] = encoded(w.decode())
            out.append(_pack_ids([known[w] for w in ws]))
        return pa.table([group.column("block"), group.column("bucket"), pa.array(out, pa.binary())], schema=_BLOCKS)

    return words.groupBy("bucket").applyInArrow(run, BLOCKS)


def assemble(documents: DataFrame, encoded: DataFrame, raw: bytes) -> DataFrame:
    """Documents of a block with the ids of its words: counts and checksums of ids and of decoded bytes."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = {i: b for b, i in tokens.ranks(raw).items()}
        order = np.argsort(right.column("bucket").to_numpy())
        shown: list[str] = []
        plain: list[bytes] = []
        sizes: list[int] = []
        for k in order.tolist():
            n, ids = _unpack_ids(right.column("payload")[k].as_py())
            ids, at = ids.tolist(), 0
            for m in n.tolist():
                word = ids[at : at + m]
                at += m
                sizes.append(m)
                shown.append(",".join(map(str, word)))
                plain.append(b"".join(map(table.__getitem__, word)))
        rows = []
        for k in range(left.num_rows):
            payload = left.column("payload")[k].as_py()
            n = int.from_bytes(payload[:8], "little")
            docs, lengths, first_seen = _unpack_documents(payload[8 : 8 + n])
            rank = np.frombuffer(zstandard.decompress(payload[8 + n :]), np.uint32)
            positions, at = rank[first_seen] if len(rank) else first_seen, 0
            size = np.array(sizes, np.int64)
            for doc, m in zip(docs, lengths):
                p = positions[at : at + m]
                at += m
                ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
                listed = p.tolist()
                ids_hash.update(",".join(map(shown.__getitem__, listed)).encode())
                text_hash.update(b"".join(map(plain.__getitem__, listed)))
                rows.append((doc, int(size[p].sum()) if m else 0, ids_hash.hexdigest(), text_hash.hexdigest()))
        cols = zip(*rows) if rows else ([] for _ in _DIGEST)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _DIGEST.types)], schema=_DIGEST)

    return documents.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(run, DIGEST)


def digest(documents: DataFrame, raw: bytes | None = None, limit: int = BLOCK) -> DataFrame:
    """The columns of op9: ids of every document, and their decoded bytes, as checksums."""
    raw = tokens.rank_file(tokens.MULTI) if raw is None else raw
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(documents.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES))
    # bucketed by block, so that the documents meet their ids where they lie
    made = bucketed(blocks(documents, buckets, limit), "bpe_blocks", max(documents.sparkSession.sparkContext.defaultParallelism, -(-total // limit)), "block")
    return assemble(made.filter("bucket = -1"), encode_words(made.filter("bucket >= 0"), raw), raw)
