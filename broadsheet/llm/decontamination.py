"""Benchmark passages in documents by Wu-Manber search for many strings, with words as letters.

The strings searched for are windows of ten consecutive words of an item (a shorter item is one window).  For every window length
there is a shift table over blocks of two words: how many words the end of a window can at least move on when the search stands
at such a block.  A block that no window holds moves it by nearly a whole window, so most positions of a text are never looked at.
Where the shift is zero, the block's hash and the hash of the whole window select the strings to test, and the bytes are
compared.  Many places of a text are searched side by side, each in its own strip of word positions.

Items are cut into (item, window) pairs; pairs are dealt by hash into blocks of bounded number and size, so an item of any length or a
window that many items share overfills none.  The table of one block is sent to the tasks, and documents are read once per block
without a shuffle; with several blocks the spans found are merged per document.  Long texts are searched in pieces that
overlap by nine words.

Defined results: words are runs of digits, letters and anything beyond ASCII after lower-casing A-Z; a null or empty text has none;
an item without words is none; windows of an item with a null id are hit but name no item; equal windows of several items are
hits of all of them; rows that repeat a doc_id are searched each for itself; an empty benchmark leaves every document clean;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import stage

WINDOW = 10
#: pairs and bytes of windows whose table is sent to the tasks at once
PAIRS, PAIR_BYTES = 1 << 17, 1 << 24
#: bytes of text that are searched at once, and word positions of a strip
PIECE = 1 << 22
STRIP = 512

FOUND = "doc_id long, text_key binary, n_words long, spans array<long>, items array<string>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_HALF = np.uint64(32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _K[2]
    return h ^ (h >> _HALF)


class Words:
    """Word positions of a buffer that holds words, each followed by one blank."""

    def __init__(self, joined: bytes):
        self.raw = joined
        padded = np.frombuffer(joined + bytes(8), np.uint8)
        self.end = np.flatnonzero(padded[: len(joined)] == 32)
        self.start = np.concatenate([[0], self.end[:-1] + 1])
        self._eight = np.ndarray((len(joined) + 1,), "<u8", buffer=padded, strides=(1,))

    def hash(self, at: np.ndarray) -> np.ndarray:
        """Hash of single words from their length and their first and last eight bytes; equal words have equal ones."""
        start, end = self.start[at], self.end[at]
        size = end - start
        short = _MASK[np.minimum(size, 8)]
        return _mix((self._eight[start] & short) * _K[0] ^ _mix((self._eight[np.maximum(end - 8, start)] & short) + size.astype(np.uint64) * _K[1]))

    def run(self, last: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words that end at each position."""
        h = np.zeros(len(last), np.uint64)
        for k in range(n):
            h = _mix(h * _K[0] + self.hash(last - (n - 1 - k)))
        return h

    def bytes_of(self, last: int, n: int) -> bytes:
        return self.raw[self.start[last - n + 1] : self.end[last]]


class Table:
    """Shift table and buckets of the windows of one length."""

    def __init__(self, n: int, windows: list[bytes], items: list[list[str]]):
        self.n, self.block = n, min(2, n)
        text = Words(b" ".join(windows) + b" ")
        last = np.arange(1, len(windows) + 1) * n - 1
        bits = max(12, int(4 * len(windows) * n).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, n - self.block + 1, np.uint8)
        for k in range(n - self.block + 1):  # the block that ends k words before the window's end
            np.minimum.at(self.shift, (text.run(last - k, self.block) & self.mask).astype(np.int64), k)
        whole = text.run(last, n)
        order = np.argsort(whole, kind="stable")
        self.whole, self.windows, self.items = whole[order], [windows[k] for k in order], [items[k] for k in order]

    def ends(self, words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Word positions with shift zero among the strips first..last (positions of window ends)."""
        found = []
        at, stop = first, last
        while len(at):
            step = self.shift[(words.run(at, self.block) & self.mask).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            inside = at <= stop
            at, stop = at[inside], stop[inside]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, words: Words, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """Window ends inside the strips, with the items of the window found."""
        at = self.ends(words, first, last)
        whole = words.run(at, self.n)
        low, high = np.searchsorted(self.whole, whole), np.searchsorted(self.whole, whole, side="right")
        for k in np.flatnonzero(high > low):
            own = words.bytes_of(int(at[k]), self.n)
            for j in range(low[k], high[k]):
                if self.windows[j] == own:
                    yield int(at[k]), self.items[j]


def pairs(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window, n_words) of the benchmark."""
    schema = pa.schema([("item_id", pa.string()), ("window", pa.binary()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words_of(text.as_py())
                n = min(window, len(w))
                for at in range(0, len(w) - n + 1 if n else 0, 4096):
                    found = [b" ".join(w[k : k + n]) for k in range(at, min(at + 4096, len(w) - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array([n] * len(found), pa.int32())], schema=schema)

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item_id string, window binary, n_words int").distinct()


def tables(block: list) -> list[Table]:
    """Search tables of the pairs of one block."""
    by_length: dict[int, dict[bytes, list[str]]] = {}
    for item, window, n in block:
        own = by_length.setdefault(n, {}).setdefault(bytes(window), [])
        if item is not None:
            own.append(item)
    return [Table(n, list(w), list(w.values())) for n, w in sorted(by_length.items())]


def _pieces(raw: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first word, words) of the pieces of a text, each beginning with the last words of the one before."""
    at, first, tail = 0, 0, []
    while at < len(raw):
        stop = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
        stop = len(raw) if stop < 0 else stop
        own = raw[at:stop].split()
        if own or stop == len(raw):
            yield first - len(tail), tail + own
        first, at = first + len(own), stop
        tail = (tail + own)[-overlap:] if overlap else []


def _strips(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Strips of the positions at which a window of n words can end, texts of ``counts`` words lying one after another."""
    before = np.cumsum(counts) - counts
    ends = np.maximum(counts - n + 1, 0)
    strips = -(-ends // STRIP)
    text = np.repeat(np.arange(len(counts)), strips)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(strips) - strips, strips)
    first = before[text] + n - 1 + nth * STRIP
    return first, np.minimum(first + STRIP, before[text] + counts[text]) - 1


def scan(documents: DataFrame, block: list, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, merged spans [first, last, first, last ...] of hit words, and items, of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = tables(sent.value)
        for batch in batches:
            n = batch.num_rows
            keys, n_words, spans, items = [b""] * n, [0] * n, [[] for _ in range(n)], [set() for _ in range(n)]
            held: list[tuple[int, int, list[bytes]]] = []
            size = 0

            def search() -> None:
                words = Words(b" ".join(itertools.chain.from_iterable(h[2] for h in held)) + b" ")
                counts = np.array([len(h[2]) for h in held])
                before = np.cumsum(counts) - counts
                for table in built:
                    for last, named in table.occurrences(words, *_strips(counts, table.n)):
                        k = int(np.searchsorted(before, last, side="right")) - 1
                        doc, first, _ = held[k]
                        end = first + last - int(before[k])
                        spans[doc].append((end - table.n + 1, end))
                        items[doc].update(named)

            for doc, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                keys[doc] = hashlib.blake2b(raw, digest_size=16).digest()
                for first, words in _pieces(raw.translate(_LETTERS), window - 1):
                    n_words[doc] = first + len(words)
                    if words and built:
                        held.append((doc, first, words))
                        size += sum(map(len, words)) + len(words)
                        if size > PIECE:
                            search()
                            held, size = [], 0
            if held:
                search()
            columns = [batch.column(0), keys, n_words, [_merged(s) for s in spans], [sorted(i) for i in items]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _FOUND.types)], schema=_FOUND)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, FOUND)


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans in order, flattened."""
    out: list[int] = []
    for first, last in sorted(spans):
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


def merge(scans: list[DataFrame]) -> DataFrame:
    """The scans of all blocks as one; rows of equal doc_id and text found the same in each of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged([(s[k], s[k + 1]) for s in many for k in range(0, len(s), 2)]) for many in batch.column("_spans").to_pylist()]
            yield batch.drop_columns(["_spans"]).append_column("spans", pa.array(spans, pa.list_(pa.int64())))

    found = F.size("spans") > 0
    marked = [s.withColumn("_own", F.lit(k == 0).cast("long")) if k == 0 else s.filter(found).withColumn("_own", F.lit(0).cast("long")) for k, s in enumerate(scans)]
    rows = functools.reduce(DataFrame.unionByName, marked)
    grouped = rows.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum("_own").alias("_copies"),
        F.collect_set(F.when(found, F.col("spans"))).alias("_spans"),
    )
    merged = grouped.mapInArrow(run, "doc_id long, text_key binary, n_words long, items array<string>, _copies long, spans array<long>")
    return merged.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("doc_id", "text_key", "n_words", "spans", "items")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, at_once: int = PAIRS) -> DataFrame:
    """doc_id, text_key, n_words, spans and items of every document."""
    found = stage(pairs(benchmark, window), "benchmark-windows")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("window")), F.lit(0)).alias("b")).first()
    n_blocks = max(1, -(-size["n"] // at_once), -(-size["b"] // PAIR_BYTES))
    dealt = F.pmod(F.xxhash64("item_id", "window"), F.lit(n_blocks))
    # one block is on the driver at a time; the two constants above bound it, whatever the size of the benchmark
    scans = (scan(documents, [tuple(r) for r in found.filter(dealt == k).collect()], window) for k in range(n_blocks))
    return next(scans) if n_blocks == 1 else merge([stage(s, "benchmark-hits") for s in scans])


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of op11."""
    hit = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda n, x: -n + x)  # last - first of every span, summed
    n_hit = (hit + F.size("spans") / 2).cast("long")
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL of ``digest`` (doc_id names one row there)."""
    letters = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{letters}')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({window}, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
    bi AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b),
    bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM bi),
    di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM di),
    hit AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, win)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
