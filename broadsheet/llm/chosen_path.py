"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Documents with equal sets are one class; only the class's least doc_id
takes part in what follows.

Each class has ``POSITIONS`` minwise tokens.  A tree branches the classes by the tokens at chosen positions: the first level
of each of ``TREES`` independent trees uses a position of its own, and a node that is too large chooses the next position by
a hash of the node, sometimes two, so that the expected number of branches times the similarity stays at one.  A node of at most
``LEAF`` classes is compared exhaustively.  With similarity s a pair shares a first-level node of one of the trees with
probability 1 - (1 - s) ** TREES: over 0.99999999 at s = 0.8.

Two rounds keep large groups linear.  Round one links every class to the least class of its node where half of the trees
agree; groups of near copies become stars.  Nodes that then lie inside one component have nothing left to find.  Round two
compares the others: pairs inside leaves across components, at every level of the branches.  Nodes that are still too large at the
last level hold sets that are alike without being links; they are compared block by block, inside the tasks.  A pair becomes a
link only after the whole sets are compared.

No group is gathered in one task beyond a leaf or a block; documents, links and components never reach the driver.

Defined results: null text and texts without words have an empty set and link with nothing; a text shorter than a shingle is
one shingle; doc_id names one text (repeated rows get the same answer, all kept alike); a null doc_id links with nothing;
very long texts are whole; an empty table gives no rows; other columns are ignored, or kept by ``keep_first``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import bucketed, stage
from broadsheet.llm.components import components

TREES = 12
POSITIONS = 48
LEAF = 48
DEPTH = 3
#: classes that are compared at once where branching does not help
BLOCK = 512
#: sketches of a pair must agree at half of the positions; at similarity 0.8 fewer than one pair in a million do not
AGREE = POSITIONS // 2
_draw = np.random.default_rng(20)
_MULTIPLY = _draw.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(1, 1 << 63, POSITIONS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words_per: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are ASCII lower-cased and split at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(words_per, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * _STEP + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set."""
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        values = ((part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, values.min(axis=1), out=least)
    return least


SETS = "doc_id long, n_shingles long, set_key binary, sketch array<int>, sign binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.list_(pa.int32())), ("sign", pa.binary())])


def sets_of(documents: DataFrame, words_per: int) -> DataFrame:
    """Set size, set identity and minwise tokens of every document, and the low byte of each token as its sign."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches, signs = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words_per)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                least = minwise(s) if len(s) else None
                sketches.append(None if least is None else least.view(np.int32))
                signs.append(None if least is None else (least & 255).astype(np.uint8).tobytes())
            cells = (batch.column(0), sizes, keys, sketches, signs)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _SETS.types)], schema=_SETS)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SETS)


def bodies(documents: DataFrame) -> DataFrame:
    """Compressed texts, to be moved to the pairs that need them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            z = [squeeze((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["doc_id", "body"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, body binary")


def confirm(pairs: DataFrame, documents: DataFrame, words_per: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # ids of pairs grow with the table: they are never broadcast, at any size
    texts = stage(bodies(documents).join(needed.hint("merge"), "doc_id").dropDuplicates(["doc_id"]), "bodies")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b").select("a", "b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, np.ndarray] = {}

        def whole(doc: int, body: pa.Scalar) -> np.ndarray:
            if doc not in opened:
                if len(opened) > 64:
                    opened.clear()
                opened[doc] = shingles(zstandard.decompress(body.as_py()).decode(), words_per)
            return opened[doc]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k in range(len(a)):
                x, y = whole(a[k], batch.column(2)[k]), whole(b[k], batch.column(3)[k])
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def _leaf_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of one leaf that lie in different components and agree in their sketches (nodes: members array)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            members = batch.column(0)
            for k in range(len(members)):
                m = members[k].values
                doc, comp = m.field("doc").to_numpy(), m.field("comp").to_numpy()
                sign = np.frombuffer(b"".join(m.field("sign").to_pylist()), np.uint8).reshape(len(doc), POSITIONS)
                same = (sign[:, None, :] == sign[None, :, :]).sum(axis=2)
                i, j = np.nonzero(np.triu((same >= AGREE) & (comp[:, None] != comp[None, :]), 1))
                out_a += np.minimum(doc[i], doc[j]).tolist()
                out_b += np.maximum(doc[i], doc[j]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return nodes.mapInArrow(run, "a long, b long")


def _with_counts(rows: DataFrame) -> DataFrame:
    """Rows of nodes that span several components, with the node's size."""
    nodes = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")
    )
    return rows.join(nodes.filter("n > 1 AND _lo <> _hi").select("node", "n"), "node")


def _members(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    full = rows.select("node", "doc", "comp").join(sketches.select("doc", "sign"), "doc")
    return full.groupBy("node").agg(F.collect_list(F.struct("doc", "comp", "sign")).alias("members")).select("members")


def _branch(rows: DataFrame, sketches: DataFrame, level: int) -> DataFrame:
    """Children of the nodes: one chosen position, two for a quarter of the nodes."""
    at = lambda salt: F.pmod(F.xxhash64(F.lit(level), F.lit(salt), "node"), F.lit(POSITIONS)).cast("int")
    second = F.pmod(F.xxhash64(F.lit(level), F.lit(2), "node"), F.lit(4)) == 0
    chosen = F.when(second, F.array(at(0), at(1))).otherwise(F.array(at(0)))
    rows = rows.select("node", "doc", "comp", F.explode(F.array_distinct(chosen)).alias("_p")).join(sketches.select("doc", "sketch"), "doc")
    return rows.select(F.xxhash64("node", "_p", F.get("sketch", F.col("_p"))).alias("node"), "doc", "comp")


def _blocks(rows: DataFrame, documents: DataFrame, words_per: int, percent: int) -> DataFrame:
    """Links of nodes that branching did not make small: every pair of blocks of a node is compared where it lies.

    Whole sets are compared inside the task, so pairs that are no links are never written.
    """
    n_blocks = F.ceil(2 * F.col("n") / BLOCK).cast("int")
    own = rows.select("node", "doc", "comp", "n").withColumn("_blocks", n_blocks)
    needed = rows.select(F.col("doc").alias("doc_id")).distinct()
    texts = stage(bodies(documents).join(needed.hint("merge"), "doc_id").dropDuplicates(["doc_id"]), "block-bodies")
    own = own.join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    own = own.withColumn("_own", F.pmod(F.xxhash64(F.lit(5), "doc"), F.col("_blocks")).cast("int"))
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("node", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"), "doc", "comp", "body")

    def run(block: pa.Table) -> pa.Table:
        doc, comp = block.column("doc").to_numpy(), block.column("comp").to_numpy()
        none = np.empty(0, np.int64)
        a, b = _linked(doc, comp, block.column("body").to_pylist(), words_per, percent) if comp.min() < comp.max() else (none, none)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("node", "_x", "_y").applyInArrow(run, "a long, b long")


def _linked(doc: np.ndarray, comp: np.ndarray, bodies_of: list[bytes], words_per: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between components among a block's members, by the sizes of all intersections."""
    sets = [shingles(zstandard.decompress(b).decode(), words_per) for b in bodies_of]
    size = np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[column] > 1  # what one set alone holds is in no intersection
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    good = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    i, j = np.nonzero(np.triu(good & (comp[:, None] != comp[None, :]), 1))
    # one link for each pair of components is enough
    pair = np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])])
    _, first = np.unique(pair, axis=1, return_index=True)
    return np.minimum(doc[i], doc[j])[first], np.maximum(doc[i], doc[j])[first]


def links_between(classes: DataFrame, documents: DataFrame, words_per: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the classes (doc, sketch, sign) into their components."""
    tokens = classes.select(F.col("doc"), F.posexplode(F.slice("sketch", 1, TREES)).alias("tree", "token"))
    rows = tokens.select(F.xxhash64("tree", "token").alias("node"), "doc")
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("leader")).filter("n > 1")
    shared = stage(rows.join(nodes, "node"), "nodes")
    votes = shared.filter("doc <> leader").groupBy("doc", "leader").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("doc").agg(F.max(F.struct("votes", (-F.col("leader")).alias("minus"))).alias("_b")).filter(F.col("_b.votes") * 2 >= TREES)
    first = stage(confirm(best.select((-F.col("_b.minus")).alias("a"), F.col("doc").alias("b")), documents, words_per, percent), "near-1")
    comp = stage(components(first, "a", "b"), "near-comp")

    rows = shared.select("node", "doc").join(comp.select(F.col("id").alias("doc"), "component"), "doc", "left")
    rows = rows.select("node", "doc", F.coalesce("component", "doc").alias("comp"))
    sketches = classes.select("doc", "sketch", "sign")
    found: list[DataFrame] = []
    last: DataFrame | None = None
    for level in range(1, DEPTH + 1):
        open_rows = stage(_with_counts(rows), "open")
        found.append(stage(_leaf_pairs(_members(open_rows.filter(F.col("n") <= LEAF), sketches)), "leaf-pairs"))
        large = open_rows.filter(F.col("n") > LEAF)
        if large.isEmpty():
            break
        if level == DEPTH:
            last = large
            break
        rows = _branch(large, sketches, level)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = stage(pairs.distinct(), "pairs")
    links = first
    if not pairs.isEmpty():
        links = links.unionByName(stage(confirm(pairs, documents, words_per, percent), "near-2"))
    if last is not None:
        now = stage(components(links, "a", "b"), "near-comp-2").select(F.col("id").alias("doc"), F.col("component"))
        left = last.select("node", "doc").join(now, "doc", "left").select("node", "doc", F.coalesce("component", "doc").alias("comp"))
        rest = stage(_with_counts(left), "rest")
        if not rest.isEmpty():
            links = links.unionByName(stage(_blocks(rest, documents, words_per, percent).distinct(), "near-3"))
    return links


def near_duplicates(documents: DataFrame, words_per: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    sets = stage(sets_of(documents, words_per), "sets")
    usable = sets.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    # copies are merged within each task before anything moves
    least = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "sketch", "sign")).alias("_l"))
    classes = least.select("set_key", F.col("_l.doc_id").alias("doc"), F.col("_l.sketch").alias("sketch"), F.col("_l.sign").alias("sign"))
    # every level joins the minwise tokens again: in buckets they stay where they are
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = bucketed(classes.repartition(n, "doc"), "classes", n, "doc")
    links = links_between(classes, documents, words_per, percent)
    comp = components(links, "a", "b").select(F.col("id").alias("doc"), "component")
    resolved = stage(classes.select("set_key", "doc").join(comp, "doc", "left").select("set_key", F.coalesce("component", "doc").alias("_c")), "resolved")
    rows = sets.select("doc_id", "n_shingles", "set_key").join(resolved, "set_key", "left")
    component = F.coalesce("_c", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def keep_first(documents: DataFrame, words_per: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns."""
    dropped = near_duplicates(documents.select("doc_id", "text"), words_per, percent).filter("NOT kept").select(F.col("doc_id").alias("_dropped"))
    return documents.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")


def digest(documents: DataFrame) -> DataFrame:
    """The columns of op10: shingles of four words, 80 percent."""
    return near_duplicates(documents, 4, 80)
