"""Concatenate and cut: two passes of prefix sums give every document its place in one long run of ids, cut at fixed windows.

Pass one encodes each document once and stages its ids with a running total inside its input partition.  One total per
partition is summed over the partitions before it, which gives the global offset of every document.  Pass two reads the
staged ids once and cuts each document at the multiples of the window; a document over several windows yields one boundary
record per piece.  Only the totals (one row per input partition) are ordered in one place; ids are never shuffled.

The vocabulary is the one of ``byte_bpe_50k.json`` by its ranks and added tokens, which gives the same ids as the tokenizers
library: an added token in a text is its own id.  Id 0 ends every document.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id are packed each for itself; a very long
text is cut into as many windows as it needs; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.llm import tokens
from broadsheet.llm.common import stage

WINDOW = 1024
END = 0
ENCODED = "doc_id long, part int, before long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"
#: bytes of ids per output batch
BATCH = 1 << 22


def encode(documents: DataFrame, raw: bytes, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Ids of every document (16 bits each, the end id included) with the ids before it in its partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = tokens.encode_all(raw, added)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = array("H", encoded(text.as_py() or ""))
                ids.append(END)
                out.append((doc, part, before, len(ids), ids.tobytes()))
                before += len(ids)
                held += 2 * len(ids)
                if held > BATCH:
                    yield _batch(out, _ENCODED)
                    out, held = [], 0
            if out:
                yield _batch(out, _ENCODED)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("boundary", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def offsets(encoded: DataFrame) -> DataFrame:
    """Global offset of the first id of every partition: one row per input partition."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    upto = F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    return totals.select("part", (upto - F.col("_n")).alias("base"))


def cut(encoded: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of every document."""
    # the staged table of totals is as small as its file, so the planner decides by size whether to broadcast it
    placed = encoded.join(stage(offsets(encoded), "pack-offsets"), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, at, n, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                wide = memoryview(np.frombuffer(ids.as_buffer(), dtype="<u2").astype("<u4")).cast("B")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = wide[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), n, sequence, offset, length < n)
                    out.append((*row, bytes(piece)) if with_ids else row)
                    start += length
            if out:
                yield _batch(out, _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES)

    return placed.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(documents: DataFrame, raw: bytes | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Encode, stage and cut."""
    added = tokens.plain_added() if raw is None else ()
    raw = tokens.rank_file(tokens.PLAIN) if raw is None else raw
    return cut(stage(encode(documents, raw, added), "pack-ids"), window, with_ids)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Training rows from pieces with ids: the ids of one window, its pieces in order, padded with the end id (one group is one window)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda p: p["ids"]), "")
    rows = pieces.groupBy("sequence_id").agg(joined.alias("_ids"), F.sum("length").alias("n_tokens"))
    return rows.select("sequence_id", "n_tokens", F.unhex(F.rpad("_ids", 8 * window, "0")).alias("ids"))


def digest(documents: DataFrame) -> DataFrame:
    """The columns of op3."""
    return pack(documents)
