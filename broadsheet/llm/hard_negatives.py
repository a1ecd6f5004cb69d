"""Hard negatives by exact Four-Russians scoring of anchors against all rows.

Every component becomes the whole number floor(256 x).  Rows are packed into tiles: per tile the components are written as bit
planes in two's complement, eight dimensions to a byte.  For an anchor the sums of all 256 subsets of eight of its components are
tabulated, one table per group of eight dimensions; a plane's byte of a candidate is the index into that table.  Adding the
looked-up sums over the groups, shifted by the plane (the sign plane counts negative), gives the full inner product: eight
dimensions for one look-up, no multiplication, no rounding.

Anchors are a stated query set against all rows, in blocks: tiles lie in groups of bounded size, blocks of anchors in chunks, and
every chunk meets every group in a task of its own, which holds the group's tiles and takes the blocks one by one; nothing is
broadcast.  A first pass keeps each group's best rows of the anchor's label, a second one, now that the positives' scores are
known, the best rows of other labels inside each positive's range; both are cut again over the groups.  Equal scores are ordered
by vec_id, so copies of a vector make no ambiguity.

Defined results: rows with a null vec_id, a null label, a null vector or a null or non-finite component take no part, nor does a
row with a component of 4096 or more in magnitude (its scores need not fit 64 bits); only vectors of one length are scored
against each other, an empty vector scores 0; rows that repeat a vec_id are rows of their own (an anchor's other rows are all
but itself); anchors without positives or positives without negatives give no rows; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.llm.common import stage

SCALE = 256
LARGEST = 4096 * SCALE
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: a negative's score lies between these hundredths of the positive's
LOW, HIGH = 50, 95
#: rows of a tile (the most that a tile can number is 2 ** 13), anchors of a block, rows that are scored at once
TILE = 4096
BLOCK = 128
STRIP = 512
#: bytes of a group of tiles and of a chunk of anchors that meet in one task
GROUP = 4 << 20
CHUNK = 1 << 20

TILES = "tile long, size int, n int, planes int, ids binary, labels binary, bits binary"
_TILES = pa.schema(
    [("tile", pa.int64()), ("size", pa.int32()), ("n", pa.int32()), ("planes", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("bits", pa.binary())]
)


def bit_planes(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Planes and the bytes [plane, group, row] of whole numbers [row, dimension] in two's complement."""
    planes = 1 + int(max(x.max(initial=0), -x.min(initial=0) - 1, 0)).bit_length()
    packed = [np.packbits(((x >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(planes)]
    return planes, np.ascontiguousarray(np.stack(packed))


def whole_numbers(bits: np.ndarray, size: int, rows: np.ndarray) -> np.ndarray:
    """The numbers [row, dimension] behind the planes, for some rows."""
    out = np.zeros((len(rows), size), np.int64)
    for b in range(len(bits)):
        ones = np.unpackbits(np.ascontiguousarray(bits[b][:, rows].T), axis=1, bitorder="little")[:, :size].astype(np.int64)
        out += -(ones << b) if b == len(bits) - 1 else ones << b
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables [group, 256, anchor]: the sum of the components that a byte's bits choose, in the least type that holds all sums over the groups."""
    n, size = anchors.shape
    groups = -(-size // 8)
    most = int(np.abs(anchors).sum(axis=1).max(initial=0))
    padded = np.zeros((n, groups * 8), np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
    padded[:, :size] = anchors
    out = np.zeros((groups, 256, n), padded.dtype)
    for k in range(8):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + padded[:, k::8].T[:, None, :]
    return out


def scores(bits: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Exact inner products [row, anchor] by look-ups: bits [plane, group, row], tables [group, 256, anchor]."""
    planes, groups, n = bits.shape
    most = int(max(tables.max(initial=0), -int(tables.min(initial=0)))) * groups
    kind = np.int32 if most << planes < 1 << 31 else np.int64
    out = np.zeros((n, tables.shape[2]), kind)
    for at in range(0, n, STRIP):
        piece = bits[:, :, at : at + STRIP].astype(np.intp)
        looked = np.empty((piece.shape[2], tables.shape[2]), tables.dtype)
        plane, total = np.empty_like(looked), out[at : at + STRIP]
        for b in range(planes):
            plane.fill(0)
            for g in range(groups):
                np.take(tables[g], piece[b, g], axis=0, out=looked, mode="clip")
                plane += looked
            shifted = plane.astype(kind) << b
            total += -shifted if b == planes - 1 else shifted
    return out


def tiles(embeddings: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows that take part, packed by length; a tile's rows are in vec_id order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        part, made = TaskContext.get().partitionId(), 0

        def flush(size: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(size)))
            order = np.argsort(ids, kind="stable")
            for at in range(0, len(ids), tile):
                own = order[at : at + tile]
                if len(own) < least:
                    held[size] = [(ids[own], labels[own], x[own])]
                    return
                planes, bits = bit_planes(x[own])
                row = ((part << 24) + made, size, len(own), planes, ids[own].tobytes(), labels[own].tobytes(), bits.tobytes())
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TILES.types)], schema=_TILES)

        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component reads as nan
            starts = np.cumsum(sizes) - sizes
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(SCALE * flat)
                bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LARGEST))])
            good = bad[starts + sizes] == bad[starts]
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for size in np.unique(sizes[good]).tolist():
                own = np.flatnonzero(good & (sizes == size))
                x = flat[starts[own][:, None] + np.arange(size)].astype(np.int64)
                held.setdefault(size, []).append((ids[own], labels[own], x))
                if sum(len(p[0]) for p in held[size]) >= tile:
                    yield from flush(size, tile)
            if sum(len(p[0]) for parts in held.values() for p in parts) > 4 * tile:
                for size in list(held):
                    yield from flush(size, 1)
        for size in list(held):
            yield from flush(size, 1)

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, TILES)


_NONE = np.empty(0, np.int64)


def _open(batch: pa.RecordBatch) -> Iterator[tuple]:
    """tile, size, ids, labels and bits of the tiles of a batch."""
    tile, size, n, planes = (batch.column(c).to_pylist() for c in ("tile", "size", "n", "planes"))
    view = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
    for k in range(batch.num_rows):
        bits = view(batch.column("bits")[k], np.uint8).reshape(planes[k], -(-size[k] // 8), n[k])
        yield tile[k], size[k], view(batch.column("ids")[k], np.int64), view(batch.column("labels")[k], np.int64), bits


def anchors(packed: DataFrame, every: int = EVERY) -> DataFrame:
    """The rows of the query set with their numbers; ``row`` names a row of the table."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, size, ids, labels, bits in _open(batch):
                at = np.flatnonzero(ids % every == 0)
                x = whole_numbers(bits, size, at).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((tile << 13) + at), pa.array(ids[at]), pa.array(labels[at]), pa.array(np.full(len(at), size, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())],
                    schema=schema,
                )

    return packed.mapInArrow(run, "row long, id long, label long, size int, x binary")


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k positions in ``at`` with the highest scores; rows are in vec_id order, so earlier ones win ties."""
    if len(at) > k:
        own = score[at]
        least = np.partition(own, len(own) - k)[len(own) - k]
        above, equal = at[own > least], at[own == least]
        at = np.concatenate([above, equal[: k - len(above)]])
    return at


def _picked(tile: tuple, labels_at: dict[int, np.ndarray], members: dict, here: range, tables: np.ndarray, ranges: bool) -> list[np.ndarray]:
    """Anchor, slot, id and score of the best rows of a tile for the anchors ``here``."""
    number, ids, labels, bits = tile
    found = np.ascontiguousarray(scores(bits, tables).T)
    who, slots, at = [], [], []
    for k, score in zip(here, found):
        row, own = members["row"][k], members["label"][k]
        if not ranges:
            same = labels_at.get(own, _NONE)
            if row >> 13 == number:
                same = same[same != row & 8191]
            picks = [_best(score, same, POSITIVES)]
        else:
            wanted = members["wanted"][k]
            other = labels_at[own] if own in labels_at else labels_at.setdefault(own, labels != own)
            # 100 * score in whole numbers against LOW and HIGH times the positive's
            near = np.flatnonzero((score >= -(-LOW * min(wanted) // 100)) & (score <= HIGH * max(wanted) // 100) & other)
            some = score[near]
            picks = [_best(score, near[(some >= -(-LOW * p // 100)) & (some <= HIGH * p // 100)], NEGATIVES) for p in wanted]
        for slot, best in enumerate(picks):
            if len(best):
                who.append(np.full(len(best), k)), slots.append(np.full(len(best), slot)), at.append(best)
    if not at:
        return [np.empty(0, np.int64)] * 4
    who, slots, at = (np.concatenate(c) for c in (who, slots, at))
    return [who, slots, ids[at], found[who - here.start, at].astype(np.int64)]


def _scored(packed: DataFrame, queries: DataFrame, n_tiles: int, n_blocks: int, ranges: bool) -> DataFrame:
    """Per group of tiles the best rows of each anchor: of its label (slot 0), or of other labels in the range of each positive's score (its slot)."""
    in_bytes = lambda df, *columns: df.agg(F.coalesce(F.sum(sum((F.length(c) for c in columns), F.lit(0))), F.lit(0))).first()[0]
    n_chunks = max(1, min(n_blocks, -(-in_bytes(queries, "x") // CHUNK)))
    n_groups = max(-(-2 * packed.sparkSession.sparkContext.defaultParallelism // n_chunks), -(-in_bytes(packed, "ids", "labels", "bits") // GROUP))
    n_groups = max(1, min(n_tiles, n_groups))
    fields = ["row", "label", "x"] + ["wanted"] * ranges
    blocks = queries.groupBy(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("_block"), "size").agg(F.collect_list(F.struct(*fields)).alias("members"))
    tile, every = F.struct(*packed.columns), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = blocks.select((F.col("_block") % n_chunks).cast("int").alias("_c"), every(n_groups).alias("_g"), F.lit(1).alias("_kind"), "size", "members").withColumn("tile", F.lit(None).cast(packed.select(tile.alias("t")).schema["t"].dataType))
    placed = packed.select(every(n_chunks).alias("_c"), F.pmod(F.xxhash64("tile"), F.lit(n_groups)).cast("int").alias("_g"), F.lit(0).alias("_kind"), "size", tile.alias("tile")).withColumn("members", F.lit(None).cast(blocks.schema["members"].dataType))
    # a task has the tiles of a group before the blocks of a chunk
    met = placed.unionByName(sent).repartition(n_groups * n_chunks, "_g", "_c").sortWithinPartitions("_g", "_c", "_kind").select("_g", "_c", "_kind", "size", "tile", "members")
    schema = pa.schema([("row", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
    kept = NEGATIVES if ranges else POSITIVES

    def judged(group: list[tuple], members: dict, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(x), BLOCK):
            here = range(at, min(len(x), at + BLOCK))
            tables = subset_sums(x[here.start : here.stop])
            parts = [_picked(tile, labels_at, members, here, tables, ranges) for tile, labels_at in group]
            if not parts:
                return
            who, slot, ids, score = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((ids, -score, slot, who))
            who, slot, ids, score = (c[order] for c in (who, slot, ids, score))
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (slot[1:] != slot[:-1])
            start = np.flatnonzero(new)
            good = np.arange(len(who)) - start[np.cumsum(new) - 1] < kept if len(who) else new
            columns = [members["row"][who[good]], slot[good].astype(np.int32), ids[good], score[good]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group = None, {}
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("_g", "_c", "_kind", "size")))
            tile = batch.column("tile")
            for k, (g, c, kind, size) in enumerate(keys):
                if (g, c) != here:
                    here, group = (g, c), {}
                if kind == 0:
                    one = pa.RecordBatch.from_struct_array(tile.slice(k, 1))
                    for number, _, ids, labels, bits in _open(one):
                        ids, labels, bits = ids.copy(), labels.copy(), bits.copy()  # the batch goes
                        labels_at = {} if ranges else {v: np.flatnonzero(labels == v) for v in np.unique(labels).tolist()}
                        group.setdefault(size, []).append(((number, ids, labels, bits), labels_at))
                elif size in group:
                    m = batch.column("members")[k].values
                    x = np.frombuffer(b"".join(m.field("x").to_pylist()), np.int32).reshape(len(m), size).astype(np.int64)
                    members = {f: m.field(f).to_numpy() for f in ("row", "label")} | ({"wanted": m.field("wanted").to_pylist()} if ranges else {})
                    yield from judged(group[size], members, x)

    best = met.mapInArrow(run, "row long, slot int, id long, score long")
    order = W.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept)


def mine(embeddings: DataFrame, every: int = EVERY, tile: int = TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores."""
    packed = stage(tiles(embeddings, tile), "negative-tiles")
    queries = stage(anchors(packed, every), "negative-anchors")
    n_tiles, n_blocks = max(1, packed.count()), max(1, -(-queries.count() // BLOCK))
    positives = stage(_scored(packed, queries, n_tiles, n_blocks, False), "negative-positives")
    wanted = positives.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("wanted"))
    negatives = _scored(packed, queries.join(wanted, "row"), n_tiles, n_blocks, True)
    named = positives.join(queries.select("row", F.col("id").alias("anchor_id")), "row").select(
        "row", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return negatives.select("row", "slot", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        named, ["row", "slot"]
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The columns of op13."""
    return mine(embeddings)


def sql() -> str:
    """DuckDB SQL of ``digest`` (vec_id names one row there)."""
    return f"""WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LARGEST // SCALE})) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
          FROM r a JOIN r b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE label <> own AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= {NEGATIVES}"""
