"""Phrases that occur more often than their parts suggest, counted exactly in counting quotient filters.

1. ``encode``: documents become blocks of local word numbers, one language each, with the block's distinct words and their counts.
2. ``vocabulary``: counts are summed per language and word.  A phrase that occurs ``LEAST`` times has only words that do, so the others
   get no number and end a phrase, as punctuation does; the rest are numbered densely over all languages.
3. ``cells``: a phrase of two to four words is its word numbers packed into four fields of equal width.  An invertible mixing (a Feistel
   network over the two halves) scatters the packed numbers evenly; the upper bits of the result are the quotient, the rest
   is the remainder, which is kept in full, so a filter is a lossless table of (phrase, count) sorted by quotient.
   Each block writes its filter cut at quotient ranges.
4. ``merged``: filters of one range are merged as sorted runs, counts of equal entries added.  Ranges are narrowed over several levels
   when one level would cut blocks into crumbs, so the rows sent stay in proportion to the phrases.
5. ``phrases``: what occurs ``LEAST`` times is unmixed back into word numbers; scores, the containment rule and the ranking are
   joins and windows over that table.

A very common word or phrase is one counter per block, never a group of rows.

Defined results: a null language is ``und``; a null or empty text has no words; very long texts are read in slices without an effect
on the phrases; repeated rows count each; a language without candidates gives no rows; an empty table gives none; other
columns are ignored.  More than 2 ** 32 - 1 distinct words that occur ``LEAST`` times do not fit the packing and are refused.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.llm.common import stage

LEAST = 30
LONGEST = 4
TOP = 2000
#: per hundred of a phrase's count that a longer one must reach to replace it
ABSORBED = 80
SCALE = 2_000_000
#: words of a block, bytes of text that are split at once, entries of a merged range, bits by which a level narrows ranges
TOKENS = 1 << 20
SLICE = 1 << 22
RANGE = 1 << 21
LEVEL = 8

_BREAK = b"\xff"  # never part of UTF-8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_ROUNDS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_u = np.uint64


# --- packing and mixing ---------------------------------------------------------------------------------------------
class Packing:
    """Packed phrases of word numbers of ``width`` bits: mixed, and split into the upper 64 bits and the rest."""

    def __init__(self, width: int):
        if width > 32:
            raise ValueError("over 2 ** 32 - 1 distinct frequent words")
        self.width, self.half, self.bits = width, 2 * width, 4 * width
        self.top = min(64, self.bits)  # bits of the first part of a key
        self.low = self.bits - self.top
        self._mask = _u((1 << self.half) - 1)

    def _round(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * _ROUNDS[0]
        x = (x ^ (x >> _u(29))) * _ROUNDS[1]
        return (x ^ (x >> _u(32))) & self._mask

    def mix(self, fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys (upper part, rest) of four fields of word numbers, 0 for none."""
        a, b = ((fields[k] << _u(self.width)) | fields[k + 1] for k in (0, 2))
        for k in _ROUNDS:
            a, b = b, a ^ self._round(b, k)
        if self.low == 0:
            return (a << _u(self.half)) | b, np.zeros(len(a), _u)
        if self.half == 64:
            return a, b
        return (a << _u(64 - self.half)) | (b >> _u(self.low)), b & _u((1 << self.low) - 1)

    def unmix(self, upper: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        """The four fields of keys."""
        if self.low == 0:
            a, b = upper >> _u(self.half), upper & self._mask
        elif self.half == 64:
            a, b = upper, rest
        else:
            a, b = upper >> _u(64 - self.half), ((upper << _u(self.low)) & self._mask) | rest
        for k in reversed(_ROUNDS):
            a, b = b ^ self._round(a, k), a
        field = _u((1 << self.width) - 1)
        return [a >> _u(self.width), a & field, b >> _u(self.width), b & field]


def _sorted(upper: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, counts of equal ones added."""
    order = np.argsort(upper, kind="stable")
    upper, rest = upper[order], rest[order]
    same = upper[1:] == upper[:-1]
    if (same & (rest[1:] != rest[:-1])).any():
        again = np.lexsort((rest, upper))
        upper, rest, order = upper[again], rest[again], order[again]
        same = (upper[1:] == upper[:-1]) & (rest[1:] == rest[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(upper) else np.zeros(0, np.int64)
    return upper[first], rest[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class CountingQuotientFilter:
    """Distinct keys in order with their counts; ``prefix`` upper bits are common to all and not stored.

    Written form: a bit per quotient that occurs, a bit per entry that ends the run of its quotient, the remainders in whole bytes,
    and a byte per counter, 255 standing for a wide one that follows.
    """

    def __init__(self, packing: Packing, prefix_bits: int, upper: np.ndarray, rest: np.ndarray, counts: np.ndarray):
        self.packing, self.prefix_bits = packing, prefix_bits
        self.upper, self.rest, self.counts = upper, rest, counts

    @classmethod
    def of(cls, packing: Packing, upper: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        return cls(packing, 0, *_sorted(upper, rest, counts))

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Filters of one range as one: sorted runs are merged, counts of equal entries added."""
        joined = [np.concatenate([getattr(f, part) for f in filters]) for part in ("upper", "rest", "counts")]
        return cls(filters[0].packing, filters[0].prefix_bits, *_sorted(*joined))

    def cut(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """(prefix, filter) of the ranges of the first ``bits`` bits that hold entries."""
        prefix = self.upper >> _u(self.packing.top - bits) if bits else np.zeros(len(self.upper), _u)
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else []
        for at, stop in zip(starts, [*starts[1:], len(prefix)]):
            yield int(prefix[at]), CountingQuotientFilter(self.packing, bits, self.upper[at:stop], self.rest[at:stop], self.counts[at:stop])

    def _split(self) -> tuple[int, int]:
        """Bits of the quotient and of the stored part of the upper remainder."""
        left = self.packing.top - self.prefix_bits
        q = min(left, max(1, len(self.upper).bit_length()))
        return q, left - q

    def to_bytes(self) -> bytes:
        n, (q, r) = len(self.upper), self._split()
        inner = self.upper & _u((1 << (q + r)) - 1)
        quotient = (inner >> _u(r)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.concatenate([quotient[1:] != quotient[:-1], [True]])
        planes = [_low_bytes(inner & _u((1 << r) - 1), -(-r // 8)), _low_bytes(self.rest, -(-self.packing.low // 8))]
        wide = self.counts >= 255
        parts = [np.uint64(n).tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), *planes]
        return b"".join([*parts, np.where(wide, 255, self.counts).astype(np.uint8).tobytes(), self.counts[wide].astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, packing: Packing, prefix: int, prefix_bits: int, raw: bytes) -> CountingQuotientFilter:
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        f = cls(packing, prefix_bits, np.zeros(n, _u), np.zeros(n, _u), np.zeros(n, np.int64))
        q, r = f._split()
        at = 8

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(raw, np.uint8, size, at - size)

        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)))[: 1 << q])
        ends = np.unpackbits(take(-(-n // 8)))[:n]
        quotient = occupied[np.cumsum(ends) - ends].astype(_u)  # the run an entry lies in, by rank and select
        upper, rest = _from_low_bytes(take(n * -(-r // 8)), n), _from_low_bytes(take(n * -(-packing.low // 8)), n)
        counts = take(n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(raw, "<u8", offset=at).astype(np.int64)
        base = _u(prefix << (packing.top - prefix_bits))
        return cls(packing, prefix_bits, base | (quotient << _u(r) if r < 64 else quotient) | upper, rest, counts)


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low_bytes(raw: np.ndarray, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    if len(raw):
        part = raw.reshape(n, -1)
        wide[:, : part.shape[1]] = part
    return wide.reshape(-1).view("<u8").astype(_u)


# --- words ----------------------------------------------------------------------------------------------------------
BLOCKS = "block long, lang string, n_words long, words array<string>, counts array<long>, codes binary"
_BLOCKS = pa.schema(
    [("block", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())]
)


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text in slices that end at a blank, so that no word is cut."""
    at = 0
    while len(raw) - at > SLICE:
        stop = raw.find(b" ", at + SLICE)
        if stop < 0:
            break
        yield raw[at:stop]
        at = stop
    yield raw[at:]


class _Block:
    """Documents of one language as numbers of the block's words; 0 ends a phrase."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.number[_BREAK]
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        raw = (text or "").encode().translate(_FOLD).replace(b"\t", b" ").replace(_BREAK, b" \xff ")
        for piece in _slices(raw):
            words = [w for w in piece.split(b" ") if w]
            self.codes.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
            self.size += len(words)
        self.codes.append(np.zeros(1, np.uint32))

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.number))[1:]
        words = pa.array(list(self.number)[1:], pa.binary()).cast(pa.string())
        narrow = codes.astype(np.uint16) if len(self.number) <= 1 << 16 else codes
        listed = [pa.ListArray.from_arrays([0, len(words)], v) for v in (words, pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang]), pa.array([int(counts.sum())]), *listed, pa.array([narrow.tobytes()], pa.binary())], schema=_BLOCKS)


def encode(documents: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """Blocks of documents of one language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), itertools.count()
        held: dict[str, _Block] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = held.setdefault(lang, _Block())
                own.add(text.as_py())
                if own.size >= tokens:
                    yield held.pop(lang).row((part << 32) + next(made), lang)
                elif sum(b.size for b in held.values()) >= 2 * tokens:
                    lang = max(held, key=lambda k: held[k].size)
                    yield held.pop(lang).row((part << 32) + next(made), lang)
        for lang, own in held.items():
            yield own.row((part << 32) + next(made), lang)

    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def vocabulary(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, f and a dense number from 1 of the words that occur often enough in their language."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("_w")).select("lang", F.col("_w.words").alias("word"), F.col("_w.counts").alias("_n"))
    often = each.groupBy("lang", "word").agg(F.sum("_n").alias("f")).filter(F.col("f") >= least)
    at = F.monotonically_increasing_id()
    listed = stage(often.select("lang", "word", "f", at.alias("_at")), "phrase-words")
    # one row per partition is ordered in one place
    part = F.shiftright("_at", 33)
    totals = listed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    numbered = listed.withColumn("_part", part).join(stage(before, "phrase-offsets"), "_part")
    return numbered.select("lang", "word", "f", (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).alias("id"))


# --- counting -------------------------------------------------------------------------------------------------------
CELLS = "block long, prefix long, n long, payload binary"
_CELLS = pa.schema([("block", pa.int64()), ("prefix", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])


def _cells(block: int, found: CountingQuotientFilter, bits: int) -> Iterator[pa.RecordBatch]:
    rows = [(block, prefix, len(f.upper), f.to_bytes()) for prefix, f in found.cut(bits)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CELLS.types)], schema=_CELLS)


def cells(blocks: DataFrame, words: DataFrame, packing: Packing, bits: int) -> DataFrame:
    """The filter of every block, cut at the ranges of the first ``bits`` bits."""
    local = blocks.select("block", "lang", F.posexplode("words").alias("_pos", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    numbers = local.groupBy("block").agg(F.collect_list(F.struct("_pos", "id")).alias("numbers"))
    rows = blocks.select("block", F.size("words").alias("n_distinct"), "codes").join(numbers, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, codes, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                known = np.zeros(n + 1, _u)
                known[numbers.values.field(0).to_numpy() + 1] = numbers.values.field(1).to_numpy().astype(_u)
                seq = known[np.frombuffer(codes.as_buffer(), np.uint16 if n < 1 << 16 else np.uint32)]
                fields = [[] for _ in range(LONGEST)]
                for size in range(2, LONGEST + 1):
                    parts = [seq[k : len(seq) - size + 1 + k] for k in range(size)] if len(seq) >= size else [seq[:0]] * size
                    whole = np.logical_and.reduce([p > 0 for p in parts])
                    for k in range(LONGEST):
                        fields[k].append(parts[k][whole] if k < size else np.zeros(int(whole.sum()), _u))
                upper, rest = packing.mix([np.concatenate(f) for f in fields])
                yield from _cells(block, CountingQuotientFilter.of(packing, upper, rest, np.ones(len(upper), np.int64)), bits)

    return rows.mapInArrow(run, CELLS)


def _read(packing: Packing, bits: int, prefix: int, table: pa.Table) -> CountingQuotientFilter:
    return CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(packing, prefix, bits, p.as_py()) for p in table.column("payload")])


def narrowed(rows: DataFrame, packing: Packing, bits: int, step: int, chunks: int) -> DataFrame:
    """The cells of a range merged some blocks at a time and cut again at ``step`` more bits."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = _read(packing, bits, key[0].as_py(), table)
        return pa.Table.from_batches(_cells(table.column("block")[0].as_py(), found, bits + step), schema=_CELLS)

    return rows.groupBy("prefix", F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("_chunk")).applyInArrow(run, CELLS)


def merged(rows: DataFrame, packing: Packing, bits: int, least: int = LEAST) -> DataFrame:
    """(g1, g2, g3, g4, f) of the phrases that occur often enough; a field of 0 is none."""
    schema = pa.schema([(name, pa.int64()) for name in ("g1", "g2", "g3", "g4", "f")])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = _read(packing, bits, key[0].as_py(), table)
        often = found.counts >= least
        fields = packing.unmix(found.upper[often], found.rest[often])
        return pa.Table.from_arrays([*(pa.array(g.astype(np.int64)) for g in fields), pa.array(found.counts[often])], schema=schema)

    return rows.groupBy("prefix").applyInArrow(run, "g1 long, g2 long, g3 long, g4 long, f long")


def count_phrases(blocks: DataFrame, words: DataFrame, n_words: int, n_frequent: int, least: int = LEAST, size: int = RANGE) -> DataFrame:
    """(ids array<long>, f) of all phrases of two to four words that occur often enough."""
    packing = Packing(max(1, n_frequent.bit_length()))
    wanted = min(packing.top, max(0, -(-3 * n_words // size) - 1).bit_length())
    steps = [LEVEL] * (wanted // LEVEL) + [wanted % LEVEL] * (wanted % LEVEL > 0) or [0]
    rows = cells(blocks, words, packing, steps[0])
    bits = steps[0]
    for step in steps[1:]:
        rows = narrowed(rows, packing, bits, step, max(1, -(-3 * n_words // (size << bits))))
        bits += step
    out = merged(rows, packing, bits, least)
    ids = F.filter(F.array("g1", "g2", "g3", "g4"), lambda g: g > 0)
    return out.select(ids.alias("ids"), "f")


# --- scores ---------------------------------------------------------------------------------------------------------
def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with the lowest-scoring cut: ids, a, l, r, score."""
    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f")).select(F.col("ids").alias("part"), F.col("f").alias("_f"))
    size = F.size("ids")
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), F.slice("ids", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("part")),
    )
    looked = cuts.select("ids", "a", "k", F.explode(sides).alias("_s")).select("ids", "a", "k", "_s.left", "_s.part").join(parts, "part")
    both = looked.groupBy("ids", "a", "k").agg(F.max(F.when(F.col("left"), F.col("_f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("_f"))).alias("r"))
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + r) AS LONG)")
    best = both.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    return best.select("ids", "a", "_b.l", "_b.r", "_b.score")


def not_absorbed(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """The candidates that no longer phrase holds ``ABSORBED`` per hundred of."""
    size = F.size("ids")
    spans = [(at, n) for n in (2, 3) for at in range(1, LONGEST - n + 2)]
    inner = F.array(*[F.when((size > n) & (size >= at + n - 1), F.slice("ids", at, n)) for at, n in spans])
    longer = phrases.filter(size > 2).select(F.explode(F.array_distinct(F.array_compact(inner))).alias("ids"), "f")
    most = longer.groupBy("ids").agg(F.max("f").alias("_longer"))
    held = F.coalesce(_exact(F.lit(100)) * _exact(F.col("_longer")) >= _exact(F.lit(ABSORBED)) * _exact(F.col("a")), F.lit(False))
    return candidates.join(most, "ids", "left").filter(~held).drop("_longer")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, tokens: int = TOKENS, size: int = RANGE) -> DataFrame:
    """The first phrases of every language."""
    blocks = stage(encode(documents, tokens), "phrase-blocks")
    words = stage(vocabulary(blocks, least), "phrase-vocabulary")
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    n_words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    phrases = stage(count_phrases(blocks, words, n_words, words.count(), least, size), "phrase-counts")
    kept = stage(not_absorbed(scored(phrases, words), phrases), "phrase-scores")
    spelled = kept.select("ids", F.posexplode("ids").alias("_pos", "id")).join(words.select("id", "lang", "word"), "id")
    texts = spelled.groupBy("ids").agg(
        F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "word"))), lambda w: w["word"]), " ").alias("phrase")
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(texts, "ids").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(documents: DataFrame) -> DataFrame:
    """The columns of op12."""
    return collocations(documents)


def sql(least: int = LEAST, top: int = TOP) -> str:
    """DuckDB SQL of ``digest``."""
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]', chr(10), 'g'), chr(10))) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
          FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {least}),
    x AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS first, array_to_string(w[j + 1 : k], ' ') AS rest
                       FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
    cut AS (SELECT x.lang, x.phrase, a, j, l.f AS l, r.f AS r, CAST({SCALE} * CAST(a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
            FROM x JOIN f l ON l.lang = x.lang AND l.phrase = first JOIN f r ON r.lang = x.lang AND r.phrase = rest),
    s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    i AS (SELECT lang, array_to_string(w[b : b + m - 1], ' ') AS phrase, max(a) AS longer
          FROM (SELECT *, unnest([1, 2, 3, 1, 2]) AS b, unnest([2, 2, 2, 3, 3]) AS m FROM c) WHERE m < k AND b + m - 1 <= k GROUP BY ALL),
    o AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
          FROM s JOIN n ON n.lang = s.lang LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase
          WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {ABSORBED} * CAST(a AS HUGEINT))
    SELECT * FROM o WHERE rank <= {top}"""
