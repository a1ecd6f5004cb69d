"""Embedding near-duplicates by collision counting on sorted one-dimensional projections.

Unit vectors with cosine ``c`` differ by a normal amount of deviation ``sqrt(2 - 2c)`` on any Gaussian projection, unrelated ones
by about ``sqrt(2)``.  A list sorts the vectors by one projection; a query collides with the vectors inside the window of
half-width ``REACH`` deviations centred on its own value.  One window of a whole list covers a constant share of the table, so
each list is first cut into cells by a few coarser projections (cells of ``WIDTH`` deviations, shifted at random), whose
number grows with the logarithm of the table.  Inside the window the collisions of a pair are counted over ``COUNTED`` projections,
and pairs with at least the calibrated count are verified in double precision.

Calibration: from the normal law follow the chance that a pair at the cosine limit shares a cell and a window of one list, and
the least count that it misses with a chance below ``MISS``.  The number of lists is chosen so that such a pair is found in one
of them with probability ``RECALL``; pairs above the limit are found more surely.

Equal vectors are one class and take part once; every vector's links count all copies.  A pair is verified where it is met, from
the vectors that travel with the lists, and counts in the first of the lists that bring it together, so pairs are neither kept
nor joined: a task hands on how many copies each vector links with and a forest of its links.  A few lists are dealt at a time
and their shuffle files removed after each round, so disk stays at a few copies of the vectors however many lists there are.  Cells
of over ``CELL`` vectors are compared by pairs of blocks; components stay distributed.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different length
do not link; copies of a vec_id are rows of their own; an empty table gives no rows; other columns (labels too) are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import shuffles_removed, stage
from broadsheet.llm.components import components

LIMIT = 0.9
RECALL = 0.9999
MISS = 1e-4
COUNTED = 16
REACH = 2.5
WIDTH = 6.0
#: vectors of a typical cell, and the most that are compared at once
TARGET = 128
CELL = 1024
#: lists dealt at a time (more while they make fewer than so many rows), bytes of a part, rows that are compared at once
LISTS = 4
ROWS = 1 << 20
PART = 8 << 20
STRIP = 128
_NORMAL = NormalDist()


def _inside(width: float, deviation: float) -> float:
    """Chance that a normal difference stays in one cell of a randomly shifted grid."""
    u = width / deviation
    return 1 - 2 * _NORMAL.cdf(-u) - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


def calibrate(n: int, limit: float = LIMIT) -> tuple[float, int, int, int]:
    """Deviation at the limit, cutting projections per list, lists, and the count to reach."""
    near = math.sqrt(2 - 2 * limit)
    cuts = max(0, round(math.log(max(1, n / TARGET)) / -math.log(_inside(WIDTH * near, math.sqrt(2)))))
    window = 1 - 2 * _NORMAL.cdf(-REACH)
    least, missed = COUNTED, 1.0
    while least > 0:
        missed = sum(math.comb(COUNTED, k) * window**k * (1 - window) ** (COUNTED - k) for k in range(least))
        if missed <= MISS:
            break
        least -= 1
    found = _inside(WIDTH * near, near) ** cuts * window * (1 - missed)
    return near, cuts, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - found))), least


def keyed(embeddings: DataFrame) -> DataFrame:
    """vec_id, length, vector and the identity of the vector, null where it links with nothing; single precision where that is exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null component reads as nan
            starts = np.cumsum(sizes) - sizes
            keys, vectors = [None] * len(sizes), [None] * len(sizes)
            for size in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == size)
                x = flat[starts[own][:, None] + np.arange(size)]
                with np.errstate(over="ignore", invalid="ignore"):
                    short, norm = x.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", x, x))
                good, exact = np.isfinite(x).all(axis=1) & np.isfinite(norm) & (norm > 0), (short == x).all(axis=1)
                for k in np.flatnonzero(good).tolist():
                    keys[own[k]] = hashlib.blake2b(x[k].tobytes(), digest_size=16).digest()
                    vectors[own[k]] = (short if exact[k] else x)[k].tobytes()
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "size", "vector", "vec_key"])

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, size int, vector binary, vec_key binary")


class Lists:
    """The drawn projections of the vectors of one length."""

    def __init__(self, size: int, near: float, cuts: int, n_lists: int):
        draw = np.random.default_rng(size)
        self.counted, self.directions = draw.normal(size=(size, COUNTED)), draw.normal(size=(n_lists, size, cuts + 1))
        self.shift, self.factor = draw.uniform(size=(n_lists, cuts)), draw.integers(1, 1 << 62, cuts + 1) * 2 + 1
        self.size, self.cuts, self.width = size, cuts, WIDTH * near

    def place(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells and sorted values of unit vectors in a list."""
        p = x @ self.directions[t]
        grid = np.floor(p[:, : self.cuts] / self.width + self.shift[t]).astype(np.int64)
        with np.errstate(over="ignore"):
            cell = (grid * self.factor[: self.cuts]).sum(axis=1) + (t * 4096 + self.size) * self.factor[-1]
        return cell, p[:, self.cuts].astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and vectors of the vectors of a batch that have the same length and precision."""
    sizes, vectors = batch.column("size").to_numpy(), batch.column("vector")
    widths = np.array([len(v) for v in vectors.to_pylist()], np.int64) // sizes
    for size, width in sorted(set(zip(sizes.tolist(), widths.tolist()))):
        own = np.flatnonzero((sizes == size) & (widths == width))
        flat = b"".join(vectors.take(pa.array(own)).to_pylist())
        yield size, own, np.frombuffer(flat, f"<f{width}").reshape(len(own), size)


def large_cells(classes: DataFrame, near: float, cuts: int, n_lists: int) -> dict[int, int]:
    """Blocks of every cell that may hold over ``CELL`` vectors.

    A task names the cells of which it has its share of ``CELL``; others may hold a little less of them in each task.
    """
    tasks = classes.rdd.getNumPartitions()
    share = max(1, CELL // max(1, tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for size, _, v in _alike(batch):
                held.setdefault(size, []).append(_unit(v))
        for size, parts in held.items():
            lists = Lists(size, near, cuts, n_lists)
            for t in range(n_lists):
                cells, n = np.unique(np.concatenate([lists.place(x, t)[0] for x in parts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells[n >= share]), pa.array(n[n >= share])], names=["cell", "n"])

    found = classes.select("size", "vector").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    most = found.select("cell", (F.col("n") + (tasks - F.col("k")) * (share - 1)).alias("n")).filter(F.col("n") > CELL)
    return {r["cell"]: -(-2 * r["n"] // CELL) for r in most.collect()}


def _record(size: int, width: int) -> np.dtype:
    """A vector in a list: what is compared with it (cell or pair of blocks), its block (-1: compared with all), id, copies, value, components."""
    return np.dtype([("met", "<i8"), ("own", "<i4"), ("id", "<i8"), ("copies", "<i8"), ("value", "<f4"), ("v", f"<f{width}", (size,))])


def _mixed(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def dealt(classes: DataFrame, large: dict[int, int], n_parts: int, some: range, near: float, cuts: int, n_lists: int) -> DataFrame:
    """The vectors in some of the lists, packed by part: what is compared with each other is in one part."""
    big = np.array(sorted(large), np.int64)
    n_blocks = np.array([large[c] for c in sorted(large)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, Lists] = {}
        for batch in batches:
            ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            for size, own, v in _alike(batch):
                lists = drawn[size] if size in drawn else drawn.setdefault(size, Lists(size, near, cuts, n_lists))
                x, width = _unit(v), v.dtype.itemsize
                for t in some:
                    cell, value = lists.place(x, t)
                    times = np.ones(len(own), np.int64)
                    if len(big):
                        at = np.minimum(np.searchsorted(big, cell), len(big) - 1)
                        times = np.where(big[at] == cell, n_blocks[at], 1)
                    row = np.repeat(np.arange(len(own)), times)
                    block = (_mixed(ids[own]) % times.astype(np.uint64)).astype(np.int64)[row]
                    other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    r = np.empty(len(row), _record(size, width))
                    low, high = np.minimum(block, other), np.maximum(block, other)
                    with np.errstate(over="ignore"):
                        r["met"] = np.where(times[row] > 1, _mixed(cell[row].view(np.uint64) + _mixed(low << 32 | high)).view(np.int64), cell[row])
                    r["own"] = np.where(low == high, -1, block)
                    r["id"], r["copies"], r["value"], r["v"] = ids[own][row], copies[own][row], value[row], v[row]
                    part = (_mixed(r["met"]) % np.uint64(n_parts)).astype(np.int32)
                    order = np.argsort(part, kind="stable")
                    r, part = r[order], part[order]
                    ends = [*np.flatnonzero(np.diff(part)) + 1, len(part)]
                    starts = [0, *ends[:-1]]
                    n = len(ends)
                    columns = [pa.array(part[starts]), *(pa.array(np.full(n, k, np.int32)) for k in (t, size, width)), pa.array([r[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "list", "size", "width", "records"])

    return classes.select("id", "copies", "size", "vector").mapInArrow(run, "part int, list int, size int, width int, records binary")


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; every member's root is the least of its set."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root[:] = up


def _earlier(lists: Lists, x: np.ndarray, i: np.ndarray, j: np.ndarray, t: int, reach: np.float32) -> np.ndarray:
    """Whether a list before t brings the unit vectors i and j together."""
    out, left = np.zeros(len(i), bool), np.arange(len(i))
    for k in range(t):
        if not len(left):
            break
        used, at = np.unique(np.concatenate([i[left], j[left]]), return_inverse=True)
        cell, value = lists.place(x[used], k)
        a, b = at[: len(left)], at[len(left) :]
        low, high = np.minimum(value[a], value[b]), np.maximum(value[a], value[b])
        met = (cell[a] == cell[b]) & (high <= low + reach)
        out[left[met]] = True
        left = left[~met]
    return out


def _links(r: np.ndarray, lists: Lists, t: int, reach: np.float32, least: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Copies that each record links with, counted in the first list that brings a pair together, and the root of its links."""
    linked, root = np.zeros(len(r), np.int64), np.arange(len(r))
    raw = r["v"].astype(np.float64)
    norm = np.linalg.norm(raw, axis=1)
    unit = raw / norm[:, None]
    counted = np.ascontiguousarray((unit @ lists.counted).astype(np.float32).T)
    value, own, copies = (np.ascontiguousarray(r[c]) for c in ("value", "own", "copies"))
    # groups stand apart by more than a window, so that one search bounds all windows; rounding is left to the exact test below
    group = np.concatenate([[0], np.cumsum(r["met"][1:] != r["met"][:-1])])
    along = group * (2.0 * float(np.abs(value).max()) + 4 * float(reach) + 1) + value
    last = np.searchsorted(along, along + float(reach) * 1.001, side="right")
    for at in range(0, len(r), STRIP):
        to = min(len(r), at + STRIP)
        stop = int(last[at:to].max())
        if stop <= at + 1:
            continue
        i, j = np.arange(at, to)[:, None], np.arange(at, stop)[None, :]
        hits = np.zeros((to - at, stop - at), np.int8)
        apart, inside = np.empty(hits.shape, np.float32), np.empty(hits.shape, bool)
        for c in counted:
            np.subtract(c[at:to, None], c[None, at:stop], out=apart)
            np.less_equal(np.abs(apart, out=apart), reach, out=inside)
            np.add(hits, inside.view(np.int8), out=hits)
        good = (hits >= least) & (j > i) & (j < last[at:to, None]) & (value[None, at:stop] <= value[at:to, None] + reach)
        good &= (own[at:to, None] < 0) | (own[at:to, None] != own[None, at:stop])  # two blocks: each is compared with itself elsewhere
        p, q = np.nonzero(good)
        for k in range(0, len(p), 8192):
            a, b = p[k : k + 8192] + at, q[k : k + 8192] + at
            near = np.einsum("ij,ij->i", raw[a], raw[b]) / (norm[a] * norm[b]) >= limit
            a, b = a[near], b[near]
            if len(a):
                first = ~_earlier(lists, unit, a, b, t, reach)
                a, b = a[first], b[first]
                np.add.at(linked, a, copies[b])
                np.add.at(linked, b, copies[a])
                _joined(root, a, b)
    return linked, root


def links(rows: DataFrame, near: float, cuts: int, n_lists: int, least: int, limit: float) -> DataFrame:
    """Per vector and list in which it meets others first: the copies it links with, and a vector of the same component."""
    reach = np.float32(REACH * near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, Lists] = {}
        part, held = None, {}

        def compared() -> Iterator[pa.RecordBatch]:
            for (t, size), blobs in held.items():
                lists = drawn[size] if size in drawn else drawn.setdefault(size, Lists(size, near, cuts, n_lists))
                wide = _record(size, max(width for width, _ in blobs))  # vectors of both precisions are compared as the wider
                r = np.concatenate([np.frombuffer(x, _record(size, width)).astype(wide) for width, x in blobs])
                r = r[np.lexsort((r["value"], r["met"]))]
                linked, root = _links(r, lists, t, reach, least, limit)
                some = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(r["id"][some]), pa.array(linked[some]), pa.array(r["id"][root[some]])], names=["id", "linked", "root"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("part", "list", "size", "width")))
            for (here, t, size, width), blob in zip(keys, batch.column("records")):
                if here != part:
                    yield from compared()
                    part, held = here, {}
                held.setdefault((t, size), []).append((width, blob.as_py()))
        yield from compared()

    return rows.mapInArrow(run, "id long, linked long, root long")


def near_duplicates(embeddings: DataFrame, limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    found = keyed(embeddings)
    rows = stage(found.select("vec_id", "vec_key"), "vectors")
    usable = found.filter(F.col("vec_key").isNotNull() & F.col("vec_id").isNotNull())
    merged = usable.groupBy("vec_key").agg(F.min(F.struct("vec_id", "size", "vector")).alias("_l"), F.count(F.lit(1)).alias("copies"))
    with shuffles_removed(embeddings.sparkSession):
        classes = stage(merged.select("vec_key", F.col("_l.vec_id").alias("id"), "_l.size", "_l.vector", "copies"), "vector-classes")
        n, in_bytes = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("vector") + 32), F.lit(0))).first()
        near, cuts, n_lists, least = calibrate(n, limit)
        large = large_cells(classes, near, cuts, n_lists)
        at_once, met = max(LISTS, ROWS // max(1, n)), []
        for first in range(0, n_lists, at_once):
            some = range(first, min(n_lists, first + at_once))
            n_parts = max(2 * embeddings.sparkSession.sparkContext.defaultParallelism, -(-in_bytes * len(some) // PART))
            packed = dealt(classes, large, n_parts, some, near, cuts, n_lists).repartition(n_parts, "part").sortWithinPartitions("part")
            met.append(stage(links(packed, near, cuts, n_lists, least, limit), "vector-links"))
        met = reduce(DataFrame.unionByName, met)
        linked = met.groupBy("id").agg(F.sum("linked").alias("_linked"))
        comp = components(met.filter("id <> root"), "id", "root").select("id", "component")
        resolved = stage(
            classes.select("vec_key", "id", "copies").join(linked, "id", "left").join(comp, "id", "left")
            .select("vec_key", (F.coalesce("_linked", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "id").alias("_c")), "vector-resolved"
        )
    out = rows.select("vec_id", "vec_key").join(resolved, "vec_key", "left")
    component = F.coalesce("_c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def digest(embeddings: DataFrame) -> DataFrame:
    """The columns of op1."""
    return near_duplicates(embeddings)
