"""Hard negatives by inner product, through rotated one-bit codes.

Vectors are integers, floor(256 * x).  A block of rows keeps, besides its vectors, one
bit per dimension of each: the sign after the block's centre c is subtracted and the rest turned by
a fixed random rotation (random signs, then a Walsh-Hadamard transform; it multiplies
all lengths by sqrt(D), which stays exact in integers).  With y the turned rest of a row and s its
signs, s / sqrt(D) is its code vector, of length 1.  The row stores its alignment
t = <y, s> / sqrt(D) and the residual's length sqrt(|y|^2 - t^2).

For an anchor, turned to z, the code vector's product g = <z, s> / sqrt(D) comes from popcounts of the code
and eight bit planes of z rounded to 256 steps; what rounding can
add is bounded by the sum of the roundings / sqrt(D).  Then <y, z> = t * g + <residual, z>, and the residual is at right angles to the
code vector, so by Cauchy-Schwarz the last term is at most |residual| * sqrt(|z|^2 - g^2).  That
makes an interval that holds the score for certain: <c, anchor> + <y, z> / D.

Rows whose interval can't reach the range asked for, or lies below the intervals of k
others within it, are dropped; those that stay are scored in integers, from the largest upper
end down, until no other can enter the first k.

Mining takes two passes: each anchor's positives (first rows of its label), then for
each positive the first rows of other labels within the range its score sets.  Both deal the
blocks to places and send the anchors, a row each, to every place, where they pass the blocks
one after another: a task holds some blocks and one anchor, neither is gathered or broadcast, no pair
of rows leaves a task, and an anchor takes at most k rows with it (per positive).  The score of the last of them is
the least that the place's next block has to reach.  Blocks are cut from a sort by width and label, so a
frequent label only has more blocks.

Defined cases: rows with a NULL label, a NULL vector, or a NULL or non-finite component take no
part; a NULL id is not divisible by anything, so such a row is never an anchor and keeps its label,
but it can be found, after all others of its score; rows that repeat an id, or are equal, are rows of
their own (an anchor leaves out its own row only), and each is an anchor; empty
vectors score 0 among themselves; vectors of different lengths never meet; scores
must fit 62 bits, or the job fails with a message; anchors without positives, and positives without
negatives, give no row; an empty table gives none; other columns don't matter.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# --- parameters ---
SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies within these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Values of all vectors of a block, and of a group of anchors.
BLOCK_VALUES = 1 << 19
GROUP_VALUES = 1 << 15
# ------------------

#: Blocks that a task holds, more or less, and the places that a core gets if there are blocks enough.
HELD_BLOCKS, PLACES_PER_CORE = 16, 4
#: Rows that a task gathers before it hands them on.
ROWS_OUT = 50_000

#: Which rows change labels, and the number of labels.
MOVED_EVERY, LABELS = 7, 10

PLANES = 8
EXACT_FLOAT = 1 << 53
WORST, BEST = -(1 << 62), 1 << 62


# ------------------------------------------------------------------ codes
def padded_width(width: int) -> int:
    return max(64, 1 << max(width - 1, 0).bit_length())


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Integer vectors turned (and lengthened by sqrt(D)): signs, then Walsh-Hadamard."""
    n, width = vectors.shape
    size = padded_width(width)
    signs = np.random.default_rng(size).integers(0, 2, size) * 2 - 1
    out = np.zeros((n, size), np.int64)
    out[:, :width] = vectors * signs[:width]
    half = 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        half *= 2
    return out


def packed_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class Asked:
    """An anchor's vector made ready for codes: turned, rounded, cut into bit planes."""

    def __init__(self, vector: np.ndarray):
        self.vector = vector
        z = rotated(vector[None, :])[0].astype(np.float64)
        self.length2 = float(z @ z)
        self.low = float(z.min())
        self.step = (float(z.max()) - self.low) / ((1 << PLANES) - 1) or 1.0
        steps = np.rint((z - self.low) / self.step).astype(np.int64)
        self.total = int(steps.sum())
        self.off = float(np.abs(z - (self.low + self.step * steps)).sum()) / np.sqrt(len(z))
        self.planes = packed_bits((steps[None, :] >> np.arange(PLANES)[:, None] & 1).astype(np.uint8))


class Block:
    """Rows of one width: ids, row keys, labels, vectors, centre, codes, alignments."""

    FIELDS = (("keys", np.int64), ("ids", np.int64), ("unnamed", np.bool_), ("labels", np.int64), ("values", np.int64),
              ("centre", np.int64), ("codes", np.uint64), ("along", np.float64), ("beside", np.float64))

    def __init__(self, width: int, **fields: np.ndarray):
        self.width = width
        self.keys, self.ids, self.unnamed, self.labels = (fields[f] for f in ("keys", "ids", "unnamed", "labels"))
        rows = len(self.keys)
        self.values = fields["values"].reshape(rows, width)
        self.centre, self.along, self.beside = fields["centre"], fields["along"], fields["beside"]
        self.codes = fields["codes"].reshape(rows, -1)
        self.largest = int(np.abs(self.values).max(initial=0))
        self.floats = self.values.astype(np.float64)
        self.pops = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)

    @classmethod
    def build(cls, width: int, keys: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, labels: np.ndarray, values: np.ndarray) -> Block:
        order = np.lexsort((keys, ids, unnamed))             # ties of scores go by id, NULL last
        keys, ids, unnamed, labels, values = (x[order] for x in (keys, ids, unnamed, labels, values))
        if int(np.abs(values).max(initial=0)) * max(width, 1) * 4 >= EXACT_FLOAT:
            centre = np.zeros(width, np.int64)               # too large for codes: see ``intervals``
            y = np.zeros((len(keys), padded_width(width)), np.int64)
        else:
            centre = np.rint(values.mean(axis=0)).astype(np.int64)
            y = rotated(values - centre)
        along = np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])
        beside = np.sqrt(np.maximum((y.astype(np.float64) ** 2).sum(axis=1) - along ** 2, 0))
        return cls(width, keys=keys, ids=ids, unnamed=unnamed, labels=labels, values=values, centre=centre,
                   codes=packed_bits((y > 0).astype(np.uint8)), along=along, beside=beside)

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS]

    @classmethod
    def unpack(cls, width: int, *packed: bytes) -> Block:
        return cls(width, **{name: np.frombuffer(b, kind) for (name, kind), b in zip(cls.FIELDS, packed)})

    def bound(self, vector: np.ndarray) -> int:
        """No score of the vector with a row is above this."""
        return self.largest * int(np.abs(vector).max(initial=0)) * max(self.width, 1)

    def intervals(self, asked: Asked | None) -> tuple[np.ndarray, np.ndarray]:
        """Integers that hold each row's score between them; without limits where
        values are too large for exact codes."""
        if asked is None:
            return np.full(len(self.keys), WORST), np.full(len(self.keys), BEST)
        size = asked.planes.shape[1] * 64
        hits = np.zeros(len(self.keys), np.int64)
        for plane in range(PLANES):
            hits += np.bitwise_count(self.codes & asked.planes[plane]).sum(axis=1, dtype=np.int64) << plane
        g = (asked.low * (2 * self.pops - size) + asked.step * (2 * hits - asked.total)) / np.sqrt(size)
        least = np.maximum(np.abs(g) - asked.off, 0)
        reach = self.along * asked.off + self.beside * np.sqrt(np.maximum(asked.length2 - least ** 2, 0))
        # what floating point can lose, generously
        reach += 1e-9 * (self.along + self.beside + 1) * (np.sqrt(asked.length2) + 1)
        middle = self.along * g / size + float(self.centre @ asked.vector)
        return np.ceil(middle - reach / size).astype(np.int64), np.floor(middle + reach / size).astype(np.int64)

    def scored(self, rows: np.ndarray | slice, vector: np.ndarray) -> np.ndarray:
        if self.bound(vector) < EXACT_FLOAT:
            return (self.floats[rows] @ vector.astype(np.float64)).astype(np.int64)
        if self.bound(vector) >= BEST:
            raise ValueError("a score may not fit 62 bits")
        return self.values[rows] @ vector


class Search:
    """Searches of one anchor in one block; scores are computed once per row.  ``asked``
    gives the anchor made ready for codes."""

    def __init__(self, block: Block, vector: np.ndarray, asked: Callable[[], Asked] | None = None):
        self.block, self.vector = block, vector
        # codes and estimates need sums that floating point holds exactly
        exact = block.bound(vector) * padded_width(block.width) * 4 < EXACT_FLOAT and bool(
            int(np.abs(vector).max(initial=0)) * max(block.width, 1) * 4 < EXACT_FLOAT)
        self.low, self.high = block.intervals((asked() if asked else Asked(vector)) if exact else None)
        self.scores = np.zeros(len(block.keys), np.int64)
        self.known = np.zeros(len(block.keys), bool)

    def _score(self, rows: np.ndarray) -> None:
        rows = rows[~self.known[rows]]
        if 2 * len(rows) > len(self.known):                   # the whole block is sooner multiplied than its rows are copied
            rows = slice(None)
        self.scores[rows] = self.block.scored(rows, self.vector)
        self.known[rows] = True

    def _top(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The first k of ``rows``, all scored: by score, then by place."""
        scores = self.scores[rows]
        if len(rows) > k:
            rows = rows[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
        return rows[np.lexsort((rows, -self.scores[rows]))][:k]

    def first(self, allowed: np.ndarray, least: int, most: int, k: int) -> list[tuple[int, int]]:
        """(row, score) of the first k allowed rows with a score from least to most."""
        if least > most:
            return []
        rows = np.flatnonzero(allowed & (self.high >= least) & (self.low <= most))
        if not self.known[rows].all():
            rows = self._scored_first(rows, least, most, k)
        scores = self.scores[rows]
        best = self._top(rows[(scores >= least) & (scores <= most)], k)
        return [(int(r), int(self.scores[r])) for r in best]

    def _scored_first(self, rows: np.ndarray, least: int, most: int, k: int) -> np.ndarray:
        """Those of ``rows`` that the first k can be among, scored."""
        sure = self.low[rows][(self.low[rows] >= least) & (self.high[rows] <= most)]
        if len(sure) > k:
            rows = rows[self.high[rows] >= np.partition(sure, len(sure) - k)[len(sure) - k]]
        reach = np.minimum(self.high[rows], most)
        order = np.argsort(-reach, kind="stable")
        rows, reach = rows[order], reach[order]
        best = np.zeros(0, np.int64)
        at, step = 0, 64
        while at < len(rows):
            some = rows[at:at + step]
            self._score(some)
            some = some[(self.scores[some] >= least) & (self.scores[some] <= most)]
            best = self._top(np.concatenate([best, some]), k)
            at, step = at + step, step * 8
            # an equal score can still win by its id
            if len(best) == k and at < len(rows) and reach[at] < self.scores[best[-1]]:
                break
        return best


class Searches:
    """Searches of one anchor in the ``allowed`` rows of several blocks."""

    def __init__(self, blocks: list[Block], vector: np.ndarray, allowed: Callable[[Block], np.ndarray]):
        asked = functools.cache(lambda: Asked(vector))
        rows = ((block, allowed(block)) for block in blocks)
        self.parts = [(Search(block, vector, asked), some) for block, some in rows if some.any()]

    def first(self, least: int, most: int, k: int) -> Iterator[tuple[int | None, int, int]]:
        """(id, key, score) of the first k rows of all blocks with a score from least to most."""
        best: list[tuple] = []
        for search, allowed in self.parts:
            b = search.block
            # an equal score can still win by its id
            floor = max(least, -best[-1][0]) if len(best) == k else least
            best += [(-score, bool(b.unnamed[r]), int(b.ids[r]), int(b.keys[r])) for r, score in search.first(allowed, floor, most, k)]
            best = sorted(best)[:k]
        return ((None if unnamed else id_, key, -minus) for minus, unnamed, id_, key in best)


def window_of(score: int, least_percent: int, most_percent: int) -> tuple[int, int]:
    """Least and largest s with least_percent * score <= 100 * s <= most_percent * score."""
    return -(-least_percent * score // 100), most_percent * score // 100


# ------------------------------------------------------------------ Spark
def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
              scale: int = SCALE) -> DataFrame:
    """``key`` (of the row), ``id``, ``label``, ``q``: the rows that take part, written once,
    so that keys are the same whenever they are read."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), (F.col("label") if label is None else label).cast("bigint").alias("label"),
                          F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("x"))
    good = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))   # NaN is above infinity
    rows = rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull()).filter(good)
    q = F.transform("x", lambda v: F.floor(v * scale).cast("bigint"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("key"), "id", "label", q.alias("q")), "mining-rows")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), width)


def build_index(rows: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """A row per block: ``width``, ``place`` (a hash) and the packed fields."""
    total = rows.agg(F.coalesce(F.sum(F.greatest(F.size("q"), F.lit(1))), F.lit(0))).first()[0]
    parts = max(1, -(-total // block_values))
    sorted_rows = (rows.select(F.size("q").alias("width"), "label", F.xxhash64("key").alias("place"), "key", "id", "q")
                   .repartitionByRange(parts, "width", "label", "place").sortWithinPartitions("width", "label", "place"))

    def block_of(width: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        key, label, place = (t.column(c).to_numpy() for c in ("key", "label", "place"))
        ids = t.column("id")
        block = Block.build(width, key, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), label,
                            _matrix(t.column("q").combine_chunks(), width))
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([int(place[0])], pa.int64()),
                                           *(pa.array([b], pa.binary()) for b in block.pack())],
                                          names=["width", "place", *(name for name, _ in Block.FIELDS)])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, width = [], 0, -1
        for batch in batches:
            widths = batch.column(0).to_numpy()
            at = 0
            while at < len(widths):
                if n and (widths[at] != width or n >= max(1, block_values // max(width, 1))):
                    yield block_of(width, held)
                    held, n = [], 0
                width = int(widths[at])
                same = int(np.searchsorted(widths, width, side="right")) - at
                take = min(same, max(1, block_values // max(width, 1)) - n)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
        if n:
            yield block_of(width, held)

    fields = ", ".join(f"{name} binary" for name, _ in Block.FIELDS)
    return materialize(sorted_rows.mapInArrow(pack, f"width int, place bigint, {fields}"), "code-index")


def searched(index: DataFrame, anchors: DataFrame, answer, schema: str, group_values: int = GROUP_VALUES) -> DataFrame:
    """``answer(blocks, anchor)`` gives rows of ``schema`` for each of ``anchors`` (a struct
    column ``anchor`` with key and q) and the blocks of its width at a place.

    There are places enough for all cores, and for ``HELD_BLOCKS`` blocks each.  Where blocks are
    fewer than that, anchors are cut into parts of ``group_values`` values at least, and blocks
    copied per part.
    """
    values = anchors.agg(F.coalesce(F.sum(F.greatest(F.size("anchor.q"), F.lit(1))), F.lit(0))).first()[0]
    blocks, wanted = index.count(), PLACES_PER_CORE * anchors.sparkSession.sparkContext.defaultParallelism
    places = max(1, -(-blocks // HELD_BLOCKS), min(blocks, wanted))
    parts = max(1, min(-(-values // group_values), -(-wanted // places)))
    fields = [name for name, _ in Block.FIELDS]

    def spot(place: Column, part: Column) -> Column:
        return (place * F.lit(parts) + part).cast("int").alias("spot")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    held = (index.withColumn("part", every(parts))
            .select(spot(F.pmod("place", F.lit(places)), F.col("part")), F.lit(False).alias("asks"), "width", *fields))
    asked = (anchors.withColumn("spot", every(places))
             .select(spot(F.col("spot"), F.pmod(F.xxhash64("anchor.key"), F.lit(parts))), F.lit(True).alias("asks"),
                     F.size("anchor.q").alias("width"), "anchor"))
    # most spots get a task of their own; the blocks of a spot come before its anchors
    rows = (held.unionByName(asked, allowMissingColumns=True).repartition(4 * places * parts, "spot")
            .sortWithinPartitions("spot", "asks"))
    names = [part.split()[0] for part in schema.split(", ")]

    def out_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at_spot, found = None, {}, []
        for batch in batches:
            spots, asks, widths = (batch.column(c).to_pylist() for c in ("spot", "asks", "width"))
            packed, anchor = [batch.column(c) for c in fields], batch.column("anchor")
            for row, (at, ask, width) in enumerate(zip(spots, asks, widths)):
                if at != here:
                    here, at_spot = at, {}
                if not ask:
                    at_spot.setdefault(width, []).append(Block.unpack(width, *(c[row].as_py() for c in packed)))
                elif width in at_spot:
                    found += answer(at_spot[width], anchor[row].as_py())
                if len(found) >= ROWS_OUT:
                    yield out_of(found)
                    found = []
        if found:
            yield out_of(found)

    return rows.mapInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives(index: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """``key`` of the anchor, ``rank``, ``id`` and ``score``: first other rows of its label."""

    def answer(blocks: list[Block], anchor: dict):
        searches = Searches(blocks, np.array(anchor["q"], np.int64), lambda b: (b.labels == anchor["label"]) & (b.keys != anchor["key"]))
        for found in searches.first(WORST, BEST, k):
            yield anchor["key"], *found

    asked = anchors.select(F.struct("key", "label", "q").alias("anchor"))
    return _first(searched(index, asked, answer, "key bigint, id bigint, row bigint, score bigint"), ["key"], k)


def negatives(index: DataFrame, anchors: DataFrame, found: DataFrame, k: int = NEGATIVES,
              percents: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT)) -> DataFrame:
    """``key`` of the anchor, ``place`` (rank of the positive), ``rank``, ``id`` and ``score``: first rows
    of other labels with a score within ``percents`` of the positive's."""

    def answer(blocks: list[Block], anchor: dict):
        searches = Searches(blocks, np.array(anchor["q"], np.int64), lambda b: b.labels != anchor["label"])
        for one in anchor["found"]:
            for found in searches.first(*window_of(one["score"], *percents), k):
                yield anchor["key"], one["rank"], *found

    asked = (found.groupBy("key").agg(F.collect_list(F.struct("rank", "score")).alias("found"))     # k at most
             .join(anchors, "key").select(F.struct("key", "label", "q", "found").alias("anchor")))
    return _first(searched(index, asked, answer, "key bigint, place bigint, id bigint, row bigint, score bigint"), ["key", "place"], k)


def mined(rows: DataFrame, anchors: DataFrame, positive_count: int = POSITIVES, negative_count: int = NEGATIVES,
          percents: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT)) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``:
    hard negatives of ``anchors``, rows of ``rows`` (key, id, label, q)."""
    index = build_index(rows)
    found = materialize(positives(index, anchors, positive_count), "mining-positives")
    hard = negatives(index, anchors, found, negative_count, percents)
    named = found.select("key", F.col("rank").cast("bigint").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (hard.join(named, ["key", "place"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def mining_report(vectors: DataFrame) -> DataFrame:
    moved = F.coalesce(F.col("vec_id") % MOVED_EVERY == 0, F.lit(False))
    rows = quantised(vectors, label=F.when(moved, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    return mined(rows, rows.filter(F.col("id") % ANCHOR_EVERY == 0))


#: DuckDB twin of ``mining_report``.
MINING_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, b.k, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.k <> b.k AND len(a.q) = len(b.q) WHERE a.vec_id % {ANCHOR_EVERY} = 0
), pos AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place FROM pairs WHERE same)
  WHERE place <= {POSITIVES}
), neg AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM pos p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
    AND {LEAST_PERCENT} * p.score <= 100 * n.score AND 100 * n.score <= {MOST_PERCENT} * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}
"""
