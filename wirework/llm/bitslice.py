"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers, floor(256 * x).  A block of candidate rows is
stored as bit slices: for each component and each binary place one bitmap over the
rows of the block (values are shifted by the component's smallest value in the
block, so all are non-negative).  For a query, each slice counts with the weight
|q| * 2**place; a negative q takes the complement of the slices, and what shifting
and complements add is a constant per query.  The weighted slices are added with
bitmap arithmetic alone: full adders reduce three bitmaps of one weight to a sum
and a carry until one bitmap per weight is left, the slices of the score.

The best rows are selected from the most significant slice downward: rows known to
be among the best, and rows that tie with the boundary so far.  What still ties after the last
slice is resolved by id: rows of a block stand in id order.  Each block gives at
most k rows per query, merged by rank; Spark keeps the k best of each partition
before it shuffles them (WindowGroupLimit).

The index is a table of blocks of about a fixed number of rows each, written once.
Queries stand in groups of some hundreds; a block and a group are one row of a
join, so a block is read once per group, no pair of single rows leaves a task, and nothing is broadcast.

Defined cases: vectors that are NULL, or hold a NULL or non-finite component, and rows
without an id take no part; vectors of different lengths meet only their like, and empty
ones score 0 among themselves; equal vectors are ranked by id; rows that repeat an id are
candidates and queries each, with results of their own (``query_key``): a query leaves out its own row only;
scores must fit 64 bits; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# --- parameters ---
SCALE = 256
TOP_K = 5
QUERY_EVERY = 50
BLOCK_ROWS = 16_384
QUERY_ROWS = 512
# ------------------


# ------------------------------------------------------------------ bitmaps
def bit_slices(column: np.ndarray) -> list[np.ndarray]:
    """Bitmaps (words of 64 rows) of the binary places of non-negative integers."""
    rows = -(-len(column) // 64) * 64
    out = []
    for place in range(int(column.max()).bit_length() if len(column) else 0):
        bits = np.zeros(rows, np.uint8)
        bits[:len(column)] = (column >> place) & 1
        out.append(np.packbits(bits, bitorder="little").view(np.uint64))
    return out


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def add_weighted(parts: dict[int, list[np.ndarray]]) -> list[np.ndarray | None]:
    """Slices of the sum of ``parts``: bitmaps by the binary place they weigh."""
    out: list[np.ndarray | None] = []
    place = 0
    while parts:
        maps = parts.pop(place, [])
        up = parts.setdefault(place + 1, []) if len(maps) > 1 else None
        while len(maps) > 2:
            a, b, c = maps.pop(), maps.pop(), maps.pop()
            ab = a ^ b
            maps.insert(0, ab ^ c)
            up.append((a & b) | (ab & c))
        if len(maps) == 2:
            a, b = maps
            maps = [a ^ b]
            up.append(a & b)
        out.append(maps[0] if maps else None)
        place += 1
    return out


def best_rows(slices: list[np.ndarray | None], valid: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the largest scores among ``valid``, ties to the first rows."""
    sure, tied = np.zeros_like(valid), valid
    have = 0
    for s in reversed(slices):
        ones = tied & s if s is not None else np.zeros_like(valid)
        n = count(ones)
        if have + n > k:
            tied = ones
        else:
            sure, have = sure | ones, have + n
            tied = tied & ~s if s is not None else tied
            if have == k:
                return rows_of(sure)
    return np.concatenate([rows_of(sure), rows_of(tied)[:k - have]])


class Block:
    """The bit-sliced index of a block of rows: keys, ids (ascending), the smallest value
    of each component, and its slices."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, low: np.ndarray, slices: list[list[np.ndarray]]):
        self.keys, self.ids, self.low, self.slices = keys, ids, low, slices
        self.flipped = [[~s for s in one] for one in slices]
        bits = np.zeros(-(-len(ids) // 64) * 64, np.uint8)
        bits[:len(ids)] = 1
        self.all = np.packbits(bits, bitorder="little").view(np.uint64)

    @classmethod
    def build(cls, keys: np.ndarray, ids: np.ndarray, values: np.ndarray) -> Block:
        """From a matrix of integers, a row for each id."""
        low = values.min(axis=0)
        return cls(keys, ids, low, [bit_slices(values[:, d] - low[d]) for d in range(values.shape[1])])

    def pack(self) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        flat = [s for one in self.slices for s in one]
        return (self.keys.astype(np.int64).tobytes(), self.ids.astype(np.int64).tobytes(), self.low.astype(np.int64).tobytes(),
                bytes(len(one) for one in self.slices), b"".join(s.tobytes() for s in flat))

    @classmethod
    def unpack(cls, keys: bytes, ids: bytes, low: bytes, places: bytes, slices: bytes) -> Block:
        own = np.frombuffer(ids, np.int64)
        flat = np.frombuffer(slices, np.uint64).reshape(-1, -(-len(own) // 64))
        ends = np.cumsum([0, *places]).tolist()
        return cls(np.frombuffer(keys, np.int64), own, np.frombuffer(low, np.int64), [list(flat[a:b]) for a, b in zip(ends, ends[1:])])

    def search(self, query: list[int], own: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but the one with the key ``own``."""
        parts: dict[int, list[np.ndarray]] = {}
        constant = 0
        for d, q in enumerate(query):
            constant += q * int(self.low[d])
            if q > 0:
                source = self.slices[d]
            else:
                source = self.flipped[d]
                constant += q * ((1 << len(source)) - 1)
            weight, place = abs(q), 0
            while weight:
                if weight & 1:
                    for j, s in enumerate(source):
                        parts.setdefault(place + j, []).append(s)
                weight >>= 1
                place += 1
        valid = self.all
        for r in np.flatnonzero(self.keys == own).tolist():
            valid = valid.copy()
            valid[r // 64] &= ~np.uint64(1 << (r % 64))
        total = add_weighted(parts)
        out = []
        for r in best_rows(total, valid, k).tolist():
            score = sum(1 << p for p, s in enumerate(total) if s is not None and int(s[r // 64]) >> (r % 64) & 1)
            out.append((int(self.ids[r]), score + constant))
        return out


# ------------------------------------------------------------------ Spark
def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``key`` (of the row), ``id``, ``q`` (array of bigint): the rows that take part, written
    once, so that keys are the same whenever they are read."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))
    rows = rows.filter("id IS NOT NULL AND x IS NOT NULL")
    good = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))   # NaN is above infinity
    q = F.transform("x", lambda v: F.floor(v * scale).cast("bigint"))
    return materialize(rows.filter(good).select(F.monotonically_increasing_id().alias("key"), "id", q.alias("q")), "vectors")


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of ``rows`` (key, id, q): a row per block (and vector length) of about
    ``block_rows`` rows with keys, ids, smallest values, slice counts and slices packed."""
    blocks = max(1, -(-rows.count() // block_rows))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "key"])
        values = np.stack(pdf["q"].to_numpy()).astype(np.int64)
        packed = Block.build(pdf["key"].to_numpy(), pdf["id"].to_numpy(), values).pack()
        return pd.DataFrame([(*map(int, key), *packed)], columns=["block", "width", "keys", "ids", "low", "places", "slices"])

    cut = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"),
                      F.size("q").alias("width"), "key", "id", "q")
    return materialize(cut.groupBy("block", "width").applyInPandas(
        pack, "block int, width int, keys binary, ids binary, low binary, places binary, slices binary"), "bit-index")


def top_k(index: DataFrame, queries: DataFrame, k: int = TOP_K, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_key``, ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k largest
    inner products of every query (key, id, q) with the indexed rows of other keys."""
    groups = max(1, -(-queries.count() // query_rows))
    blocks = index.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    # a group has about query_rows queries, whatever their number
    asked = (queries.select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group"),
                            F.size("q").alias("width"), F.struct("key", "id", "q").alias("one"))
             .groupBy("group", "width").agg(F.collect_list("one").alias("asked")))
    left = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = left.join(right, ["block", "group", "width"]).select("keys", "ids", "low", "places", "slices", "asked")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                *packed, ask = (batch.column(c)[row].as_py() for c in range(6))
                block = Block.unpack(*packed)
                out = [(x["key"], x["id"], v, s) for x in ask for v, s in block.search(x["q"], x["key"], k)]
                columns = zip(*out) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["query_key", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_key bigint, query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(
        "query_key", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_report(vectors: DataFrame) -> DataFrame:
    rows = quantised(vectors)
    return top_k(build_index(rows), rows.filter(F.col("id") % QUERY_EVERY == 0)).drop("query_key")


#: DuckDB twin of ``top_k_report``.
TOP_K_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.k, a.vec_id AS query_id, b.vec_id,
         coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.k <> b.k AND len(a.q) = len(b.q) WHERE a.vec_id % {QUERY_EVERY} = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {TOP_K}
"""
