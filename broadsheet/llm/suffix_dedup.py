"""Removal of repeated passages: every byte covered by a ``LENGTH``-byte string that also starts in a document of smaller id.

Suffixes are compared where they can meet.  Each 50-byte window is named by the least hash of the 32-byte strings inside it;
equal windows have equal names wherever they stand.  Consecutive windows of one name are a run, and equal runs (name and
bytes) cover each other whole:

1. Texts are laid into blocks in a table bucketed by block, so that later passes read them without a shuffle.
2. The runs of a block, equal ones once with their least document, go to buckets of names.  A run whose equal has a smaller
   document is covered.  A run whose name has several contexts may share some of its windows: it is open.
3. The open stretches of a block are sorted by ``linear_grouping.suffix_array``, at most ``SORTED`` bytes at a time, as strings
   of symbols of ``SYMBOL`` bytes.  Suffixes that agree in their first 50 bytes stand side by side; all but those of the least document are covered.
4. The windows of the least documents meet in buckets of window hashes across blocks; where another block has a smaller
   document they are covered, too.
5. Covered bytes are cut out of the texts.

A name that many documents share arrives once per block, or as one mark when a block has over ``CONTEXTS`` contexts of it (its
runs are then open), and a window arrives once per sorted stretch: no key gathers more than a few entries per block.

Hashes have 64 bits within a document and are compared inside their bucket by at least 40 bits of name with 48 of content, or 56
bits and the bucket; equal bytes are always found, and unequal ones meet with a chance below one in ten thousand per terabyte.

Defined results: null and empty texts have no bytes and lose none; texts under 50 bytes lose none; rows with the same doc_id
are one document's parts and do not cover each other; a null doc_id covers nothing and loses nothing; removal is judged on the
input; a text of any length is one row of its block; an empty table gives no rows; ``remove`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from broadsheet.llm.common import bucketed, stage
from broadsheet.llm.linear_grouping import suffix_array

LENGTH = 50
NAME = 32
BLOCK = 8 << 20
#: small enough for the arrays of one sort to stay in the processor's cache
SORTED = 1 << 14
#: bytes of a symbol of the sort, those of a machine word
SYMBOL = 8
CONTEXTS = 64
BUCKET_BYTES = 8 << 20
#: texts are hashed together up to about so many bytes: few calls, and arrays that stay in the cache
JOINED = 1 << 16

_draw = np.random.default_rng(50)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _draw.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ROWS = "block long, bucket int, payload binary"
_ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _dump(value) -> bytes:
    return zstandard.compress(pickle.dumps(value, protocol=5), 3)


def _load(payload: bytes):
    return pickle.loads(zstandard.decompress(payload))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ROWS.types)], schema=_ROWS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def hashes(text: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all substrings of the given lengths, by doubling."""
    powers, h, size = {}, _BYTE[text], 1
    for k in range(max(lengths).bit_length()):
        powers[size] = h
        if 2 * size <= max(lengths) and len(text) >= 2 * size:
            m = len(text) - 2 * size + 1
            h = h[:m] * _FACTOR[k] + h[size : size + m]
            size *= 2
    out = []
    for length in lengths:
        whole, done = None, 0
        for size in sorted((s for s in powers if s & length), reverse=True):
            m = len(text) - done - size + 1
            whole = powers[size] if whole is None else _mix(whole[:m]) * _FACTOR[7] + powers[size][done : done + m]
            done += size
        out.append(_mix(whole[: len(text) - length + 1]))
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    m, size = h, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Names, contents, text numbers, first windows and ends of the runs of texts of at least ``LENGTH`` bytes."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    names, windows = hashes(np.frombuffer(b"".join(texts), np.uint8), NAME, LENGTH)
    name = _least(names, LENGTH - NAME + 1)
    new = np.concatenate([[True], name[1:] != name[:-1]])
    new[ends[:-1]] = new[ends[:-1] - LENGTH + 1] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(name))
    # a run's content is what its windows say, in order
    place = np.arange(len(name), dtype=np.uint64) - np.repeat(start, end - start).astype(np.uint64)
    content = np.add.reduceat(_mix(windows + place * _FACTOR[6]), start)
    number = np.searchsorted(ends, start, "right")
    whole = start + LENGTH <= ends[number]  # windows that reach into the next text are none
    start, end, content, number = start[whole], end[whole], content[whole], number[whole]
    begin = (ends - sizes)[number]
    return name[start], content, number, start - begin, end - begin


def _blocks(documents: DataFrame, limit: int, others: list[str]) -> DataFrame:
    """Texts in blocks: the documents of one, by id, in one value, each with whether it has a text and the values of other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, docs = TaskContext.get().partitionId(), 0, 0, []

        def full() -> tuple:
            docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
            return part * (1 << 24) + number, 0, _dump(docs)

        for batch in batches:
            rest = zip(*(batch.column(k).to_pylist() for k in range(2, batch.num_columns))) if others else iter(lambda: (), None)
            for doc, text, more in zip(batch.column(0).to_pylist(), batch.column(1), rest):
                body = (text.as_py() or "").encode("utf-8", "replace")
                docs.append((doc, body, text.is_valid, more))
                held += len(body) + 64
                if held >= limit:
                    yield _batch([full()])
                    docs, held, number = [], 0, number + 1
        if docs:
            yield _batch([full()])

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(f"`{c}`").alias(f"other_{k}") for k, c in enumerate(others))]
    return documents.select(*columns).mapInArrow(run, ROWS)


def _block_runs(docs: list[tuple]) -> tuple[np.ndarray, ...]:
    """Names, contents, document numbers, first windows and ends of all runs of a block."""
    parts, held, size = [], [], 0
    long = [k for k, (doc, body, *_) in enumerate(docs) if doc is not None and len(body) >= LENGTH]
    for k in long:
        held.append(k)
        size += len(docs[k][1])
        if size >= JOINED or k == long[-1]:
            name, content, number, start, end = runs([docs[i][1] for i in held])
            parts.append((name, content, np.array(held)[number], start, end))
            held, size = [], 0
    if not parts:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts))


def _by_class(name: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Stable order by name and content; contents are compared only where a name repeats."""
    order = np.argsort(name, kind="stable")
    again = name[order][1:] == name[order][:-1]
    at = np.flatnonzero(np.concatenate([again, [False]]) | np.concatenate([[False], again]))
    some = order[at]
    order[at] = some[np.lexsort((content[some], name[some]))]
    return order


def _by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Stable order by bucket; small numbers are sorted by their digits."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


def _classes(name: np.ndarray, content: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal runs of a block: sorted order, class of each sorted run, least id of the class, class firsts, names with too many classes."""
    order = _by_class(name, content)  # a block's documents stand by id, and so do those of a class
    name, content, ids = name[order], content[order], ids[order]
    new_name = np.concatenate([[True], name[1:] != name[:-1]])
    new = new_name | np.concatenate([[True], content[1:] != content[:-1]])
    cls, first = np.cumsum(new) - 1, np.flatnonzero(new)
    group = (np.cumsum(new_name) - 1)[first]
    crowded = np.bincount(group)[group] > CONTEXTS
    return order, cls, ids[first], first, group, crowded


def _entries(docs: list[tuple], buckets: int):
    """The entries of a block by bucket, and for every run (sorted) its entry; entries are classes, or one mark per crowded name."""
    name, content, doc, start, end = _block_runs(docs)
    ids = np.array([d[0] if d[0] is not None else 0 for d in docs], np.int64)
    if not len(name):
        return None
    order, cls, least, first, group, crowded = _classes(name, content, ids[doc])
    # a crowded name keeps its first class as the mark
    lead = np.concatenate([[True], group[1:] != group[:-1]])
    kept = ~crowded | lead
    entry_of_class = np.cumsum(kept) - 1
    n, c = name[order][first][kept], content[order][first][kept]
    low = np.minimum.reduceat(least, np.flatnonzero(kept))
    mark = crowded[kept]
    bucket = (n % np.uint64(buckets)).astype(np.int64)
    return {
        "doc": doc[order], "start": start[order], "end": end[order], "id": ids[doc][order], "entry": entry_of_class[cls],
        "covered": (ids[doc][order] > least[cls]), "name": n, "content": c, "least": low, "mark": mark, "bucket": bucket,
    }


def _name_rows(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(2)):
                e = _entries(_load(payload.as_py()), buckets)
                if e is None:
                    continue
                order = _by_bucket(e["bucket"], buckets)
                cuts = np.flatnonzero(np.diff(e["bucket"][order])) + 1
                rows = []
                for part in np.split(order, cuts):
                    low, which = np.unique(e["least"][part], return_inverse=True)
                    # the upper 40 bits of the names ascend inside a bucket: steps are kept; contents have 6 bytes
                    step = np.diff(e["name"][part] >> np.uint64(24), prepend=np.uint64(0))
                    value = (
                        step.astype(np.uint32 if int(step.max()) < 1 << 32 else np.uint64), (e["content"][part]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                        low, which.astype(np.uint16 if len(low) < 65536 else np.uint32), np.packbits(e["mark"][part]).tobytes(),
                    )
                    rows.append((block, int(e["bucket"][part[0]]), _dump(value)))
                yield _batch(rows)

    return blocks.mapInArrow(run, ROWS)


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _judge_names(rows: DataFrame) -> DataFrame:
    """Per entry: 1 where an equal run has a smaller document, 2 where the name has other contexts."""
    def run(group: pa.Table) -> pa.Table:
        loaded = [_load(p.as_py()) for p in group.column("payload")]
        name = np.concatenate([np.cumsum(v[0], dtype=np.uint64) for v in loaded])
        content = np.concatenate([_wide(v[1], 6) for v in loaded])
        least = np.concatenate([v[2][v[3]] for v in loaded])
        sizes = [len(v[3]) for v in loaded]
        mark = np.concatenate([np.unpackbits(np.frombuffer(v[4], np.uint8), count=n) for v, n in zip(loaded, sizes)]).astype(bool)
        order = _by_class(name, content)
        n, c, low = name[order], content[order], least[order]
        new_name = np.concatenate([[True], n[1:] != n[:-1]])
        new = new_name | np.concatenate([[True], c[1:] != c[:-1]])
        cls, first = np.cumsum(new) - 1, np.flatnonzero(new)
        of = np.cumsum(new_name) - 1
        contexts = np.bincount(of[first]) + np.bincount(of, mark[order])
        at = np.flatnonzero(new_name)
        # one document alone takes nothing from itself; a mark may stand for several
        several = (np.minimum.reduceat(low, at) < np.maximum.reduceat(low, at)) | (np.bincount(of, mark[order]) > 0)
        flag = np.empty(len(n), np.uint8)
        # a mark stands for many contexts, so it is neither covered nor does it say that another is
        plain = np.where(mark[order], np.iinfo(np.int64).max, low)
        best = np.minimum.reduceat(plain, first)
        flag[order] = np.where(~mark[order] & (best[cls] < low), 1, 0) | np.where((contexts[of] > 1) & several[of], 2, 0)
        parts = np.split(flag, np.cumsum(sizes)[:-1])
        return pa.table([group.column("block"), group.column("bucket"), pa.array([zstandard.compress(p.tobytes(), 3) for p in parts], pa.binary())], schema=_ROWS)

    return rows.groupBy("bucket").applyInArrow(run, ROWS)


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """The payloads of a block in bucket order: one per bucket."""
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "payload"))).alias(name))


def _flags(cells: pa.Scalar) -> np.ndarray:
    values = [zstandard.decompress(c["payload"]) for c in cells.as_py() or []]
    return np.frombuffer(b"".join(values), np.uint8)


def _spread(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int]]:
    """Intervals by document, merged where they touch."""
    if not len(doc):
        return []
    order = np.lexsort((start, doc))
    doc, start, stop = (x[order].astype(np.int64) for x in (doc, start, stop))
    # the farthest stop so far; documents ascend, so none reaches over the next one's
    far = np.maximum.accumulate((doc << 32) + stop)
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] << 32) + start[1:] > far[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return list(zip(doc[first].tolist(), start[first].tolist(), (far[last] - (doc[last] << 32)).tolist()))


def sort_stretches(texts: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, window and covered flag of every window of the stretches; covered: an equal window has a smaller owner.

    The symbols sorted are strings of ``SYMBOL`` bytes, one for each place of a text, in the order of their bytes: groups are small
    from the start, and the places at a text's end that only longer symbols reach need none.  Symbol 0 ends a text.
    """
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    count = np.maximum(sizes - SYMBOL + 1, 0)
    text_of = np.repeat(np.arange(len(texts)), count + 1)
    ends = np.cumsum(count + 1)
    offset = np.arange(len(text_of)) - (ends - count - 1)[text_of]
    place = (np.cumsum(sizes) - sizes)[text_of] + offset
    word = np.ndarray(len(joined) + 1, ">u8", joined + bytes(SYMBOL), 0, (1,))[place]
    symbol = np.zeros(len(word), np.int64)
    inner = offset < count[text_of]
    symbol[inner] = np.unique(word[inner], return_inverse=True)[1] + 1
    order = suffix_array(symbol)
    order = order[offset[order] + LENGTH <= sizes[text_of[order]]]  # only windows inside one stretch
    if not len(order):
        none = np.empty(0, np.int64)
        return none, none, none.astype(bool)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), LENGTH)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 1 << 16):
        here = place[order[at : at + (1 << 16)]]
        same[at : at + len(here)] = (view[here] == view[place[order[at - 1 : at - 1 + len(here)]]]).all(axis=1)
    first = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    who = owner[text_of[order]]
    return text_of[order], offset[order], who > np.minimum.reduceat(who, first)[group]


def _sort_rows(blocks: DataFrame, flags: DataFrame, buckets: int) -> DataFrame:
    """Bucket -1: covered intervals of a block and the windows still to be judged; other buckets: those windows' hashes and owners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, cells in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                docs = _load(payload.as_py())
                e = _entries(docs, buckets)
                if e is None:
                    yield _batch([(block, -1, _dump(([], [], [], [])))])
                    continue
                flag = np.empty(len(e["bucket"]), np.uint8)
                flag[_by_bucket(e["bucket"], buckets)] = _flags(cells)
                mine = flag[e["entry"]]
                crowded = e["mark"][e["entry"]]
                covered = e["covered"] | ((mine & 1) > 0)
                open_runs = ~covered & (((mine & 2) > 0) | crowded)
                done = _spread(e["doc"][covered], e["start"][covered], e["end"][covered] + LENGTH - 1)
                # stretches in windows: first window, end of windows
                stretches = _spread(e["doc"][open_runs], e["start"][open_runs], e["end"][open_runs])
                more, doc_of, window_of, hash_of = [], [], [], []
                at = 0
                while at < len(stretches):
                    size, stop = 0, at
                    while stop < len(stretches) and (stop == at or size + stretches[stop][2] - stretches[stop][1] + LENGTH <= SORTED):
                        size += stretches[stop][2] - stretches[stop][1] + LENGTH
                        stop += 1
                    part = stretches[at:stop]
                    at = stop
                    texts = [docs[d][1][a : b + LENGTH - 1] for d, a, b in part]
                    number = np.array([p[0] for p in part])
                    owner = np.array([docs[p[0]][0] for p in part], np.int64)
                    text, offset, hit = sort_stretches(texts, owner)
                    place = offset + np.array([p[1] for p in part])[text]
                    more += _spread(number[text[hit]], place[hit], place[hit] + LENGTH)
                    joined = np.frombuffer(b"\x00".join(texts), np.uint8)
                    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
                    h = hashes(joined, LENGTH)[0][begin[text[~hit]] + offset[~hit]]
                    doc_of.append(number[text[~hit]])
                    window_of.append(place[~hit])
                    hash_of.append(h)
                if not doc_of:
                    yield _batch([(block, -1, _dump((done + more, [], [], [])))])
                    continue
                doc, window, h = np.concatenate(doc_of), np.concatenate(window_of), np.concatenate(hash_of)
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((window, doc, bucket))
                doc, window, h, bucket = doc[order], window[order], h[order], bucket[order]
                rows = [(block, -1, _dump((done + more, doc.astype(np.int32), window.astype(np.int32), [])))]
                ids = np.array([d[0] if d[0] is not None else 0 for d in docs], np.int64)
                for piece in np.split(np.arange(len(h)), np.flatnonzero(np.diff(bucket)) + 1):
                    low, which = np.unique(ids[doc[piece]], return_inverse=True)
                    short = (h[piece] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
                    rows.append((block, int(bucket[piece[0]]), _dump((short, low, which.astype(np.uint16 if len(low) < 65536 else np.uint32)))))
                yield _batch(rows)

    return blocks.join(flags, "block", "left").select("block", "payload", "cells").mapInArrow(run, ROWS)


def _judge_windows(rows: DataFrame) -> DataFrame:
    """Per window: 1 where an equal window has a smaller document."""
    def run(group: pa.Table) -> pa.Table:
        loaded = [_load(p.as_py()) for p in group.column("payload")]
        h = np.concatenate([_wide(v[0], 7) for v in loaded])
        ids = np.concatenate([v[1][v[2]] for v in loaded])
        order = np.lexsort((ids, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        flag = np.empty(len(h), np.uint8)
        flag[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        parts = np.split(flag, np.cumsum([len(v[2]) for v in loaded])[:-1])
        return pa.table([group.column("block"), group.column("bucket"), pa.array([zstandard.compress(p.tobytes(), 3) for p in parts], pa.binary())], schema=_ROWS)

    return rows.groupBy("bucket").applyInArrow(run, ROWS)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut(blocks: DataFrame, local: DataFrame, flags: DataFrame, write: Callable[[list[tuple[tuple, bytes, int]]], pa.RecordBatch], schema) -> DataFrame:
    """Every document of every block with what is kept of it and its number of removed spans, as ``write`` puts it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, own, cells in zip(*(batch.column(k) for k in range(3))):
                docs = _load(payload.as_py())
                done, doc, window, _ = _load(own.as_py())
                if len(doc):
                    hit = _flags(cells).astype(bool)
                    extra = _spread(doc[hit], window[hit].astype(np.int64), window[hit].astype(np.int64) + LENGTH)
                    done = done + extra
                merged: dict[int, list[list[int]]] = {}
                for d, a, b in sorted(done):
                    spans = merged.setdefault(d, [])
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                out = []
                for k, row in enumerate(docs):
                    spans, kept, at = merged.get(k, []), [], 0
                    for a, b in spans:
                        kept.append(row[1][at:a])
                        at = b
                    kept.append(row[1][at:])
                    out.append((row, b"".join(kept), len(spans)))
                yield write(out)

    rows = blocks.join(local.select("block", F.col("payload").alias("own")), "block").join(flags, "block", "left")
    return rows.select("payload", "own", "cells").mapInArrow(run, schema)


def _cleared(documents: DataFrame, others: list[str], write, schema, block: int) -> DataFrame:
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = documents.sparkSession.sparkContext.defaultParallelism
    buckets = max(parallel, -(-total // BUCKET_BYTES))
    blocks = bucketed(_blocks(documents, block, others), "suffix_blocks", max(parallel, -(-total // block)), "block")
    flags = _gathered(_judge_names(_name_rows(blocks, buckets)), "cells")
    sorted_rows = stage(_sort_rows(blocks, flags, buckets), "suffix-sorted")
    judged = _gathered(_judge_windows(sorted_rows.filter("bucket >= 0")), "cells")
    return _cut(blocks, sorted_rows.filter("bucket = -1"), judged, write, schema)


def removed(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document its bytes, removed bytes, spans, and checksum of what is kept."""
    def write(rows: list[tuple[tuple, bytes, int]]) -> pa.RecordBatch:
        out = [(row[0], len(row[1]), len(row[1]) - len(left), n, hashlib.sha256(left).hexdigest()) for row, left, n in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RESULT.types)], schema=_RESULT)

    return _cleared(documents, [], write, RESULT, block)


def remove(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows with the repeated passages cut out of ``text``; characters that a cut has split are dropped, null stays null.

    The other columns wait in the blocks, so rows need not be joined again.
    """
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    schema = documents.select("doc_id", "text", *(f"`{c}`" for c in others)).schema
    plain = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *schema.fields[2:]])
    arrow = to_arrow_schema(plain)

    def write(rows: list[tuple[tuple, bytes, int]]) -> pa.RecordBatch:
        out = [(row[0], left.decode("utf-8", "ignore") if row[2] else None, *row[3]) for row, left, _ in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return _cleared(documents, others, write, plain, block).select(*(F.col(f"`{c}`").cast(documents.schema[c].dataType) for c in documents.columns))


def digest(documents: DataFrame) -> DataFrame:
    """The columns of op6."""
    return removed(documents)
