"""URL filters by a Bloom filter cascade.

A list names keys (host and beginning of the path) to block or allow; a key fits its
host and all subdomains.  The first level of a cascade is a Bloom filter of the listed
keys.  The keys of the corpus that pass it falsely are put into the next level, the
listed keys that pass that one into the next, and so on in turn, until a level
has no false positives.  On every key of the corpus the cascade then answers exactly, although it
holds only bits; URLs are judged without a join.  A second cascade, of blocked keys
against allowed ones, tells the verdict of a listed key.

A URL can only fit keys made of its own parts, and only of the shapes that the list
has (number of host labels, length of path): these are all its keys, and the keys of
all URLs are the universe the cascade is built against.  They pass the first level where they
are read; only what gets through it is made distinct and compared with the list, so
the universe itself is never shuffled.

The first level's rate is |listed| / (sqrt(2) |universe|), the others' 1/2, which is
nearly the smallest cascade: a few bytes per listed key.  A cascade is sent to
all tasks; a list is therefore cut by key hash into parts of at most ``PART_KEYS``
keys (about 15 MB of bits for a universe of 10^12 keys), each with a cascade of its own, and
pages pass the parts one after another through a written table.  A shorter list is one part.

Keys stand as two 64-bit hashes; a false positive is told from a listed key by the
text, and a pair of different keys with equal hashes would raise an error.

Defined cases: a URL that is NULL or has no ``://`` has empty host and path, and no rule fits;
so do URLs without a path, unless a rule has none; of rules that fit, the one of the most characters wins,
then that of the longer host; a key listed both ways is blocked; NULL keys of a list
are ignored; URLs that no rule fits get the verdict of keys not listed, allow; rows that
repeat an id are judged each; extra columns of the pages don't matter; an empty
table of pages or rules gives none, and all allowed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# --- fixed values: the default list --------------------------------------------
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# -------------------------------------------------------------------------------

# --- parameters ---
PART_KEYS = 4_000_000
LATER_RATE = 0.5
# ------------------

#: Levels shrink by half each: this many would mean keys that no level can tell apart.
MOST_LEVELS = 200


# ------------------------------------------------------------------ filters
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shape:
    """Bits and probes of a level's Bloom filter; levels hash apart."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number = number
        self.probes = max(1, round(-math.log2(rate)))
        self.bits = 64 * max(1, math.ceil(keys * self.probes / math.log(2) / 64))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The bits of each key: a row per probe."""
        step = np.uint64((self.number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        a, b = _mixed(h1.view(np.uint64) ^ step), _mixed(h2.view(np.uint64) + step) | np.uint64(1)
        probe = np.arange(self.probes, dtype=np.uint64)[:, None]
        return (a[None, :] + probe * b[None, :]) % np.uint64(self.bits)


class Level:
    def __init__(self, shape: Shape, words: np.ndarray):
        self.shape, self.words = shape, words

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.shape.places(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


class Cascade:
    """Exact membership on the keys it was built from; of other keys, a guess."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def size(self) -> int:
        return sum(level.words.nbytes for level in self.levels)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        # a key that falls through level k is listed if k holds false positives, as odd levels do
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        left = np.arange(len(h1))
        for k, level in enumerate(self.levels):
            through = level.has(h1[left], h2[left])
            out[left[~through]] = k % 2 == 1
            left = left[through]
        return out


def _numpy(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def passes(spark: SparkSession, level: Level) -> Callable[[Column, Column], Column]:
    """A function of (h1, h2): whether a key passes the level."""
    sent = spark.sparkContext.broadcast(level)

    @F.arrow_udf("boolean")
    def test(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(sent.value.has(_numpy(h1), _numpy(h2)), pa.bool_())

    return test


def filled(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """The level of ``keys`` (h1, h2): tasks give the words that they set, Spark joins
    the bits of equal words, and the driver gets each word once."""
    shape = Shape(number, count, rate)

    def set_words(batches):
        for batch in batches:
            at = np.sort(shape.places(_numpy(batch.column(0)), _numpy(batch.column(1))).ravel())
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else word
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = (keys.select("h1", "h2").mapInArrow(set_words, "word bigint, bits bigint")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    words = np.zeros(shape.bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Level(shape, words)


def build_cascade(listed: DataFrame, universe: DataFrame, listed_count: int, universe_count: int) -> Cascade:
    """The cascade of ``listed`` against ``universe`` (both key, h1, h2).  The keys of
    ``listed`` are distinct; those of ``universe`` may repeat and may be listed.
    ``universe_count`` only sets the first level's rate."""
    if not listed_count:
        return Cascade([])
    spark = listed.sparkSession
    rate = min(LATER_RATE, listed_count / (math.sqrt(2) * max(universe_count, 1)))
    levels = [filled(listed, 0, listed_count, rate)]
    through = universe.filter(passes(spark, levels[0])(F.col("h1"), F.col("h2")))
    inside = materialize(through.distinct().join(listed.select("key"), "key", "left_anti"), "cascade-false")
    outside = listed
    while (count := inside.count()):
        if len(levels) == MOST_LEVELS:
            raise ValueError("different keys have equal hashes")
        levels.append(filled(inside, len(levels), count, LATER_RATE))
        test = passes(spark, levels[-1])
        inside, outside = materialize(outside.filter(test(F.col("h1"), F.col("h2"))), "cascade-keys"), inside
    return Cascade(levels)


# ------------------------------------------------------------------ keys
def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = "://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def with_hashes(keys: DataFrame) -> DataFrame:
    h1, h2 = hashes(F.col("key"))
    return keys.select("key", h1.alias("h1"), h2.alias("h2"))


def listed_keys(rules: DataFrame) -> DataFrame:
    """``key``, ``blocked``, ``labels`` and ``chars`` (of the path) of a list (key, verdict)."""
    host, path = F.substring_index("key", "/", 1), F.expr("substring(key, instr(concat(key, '/'), '/'))")
    rows = rules.filter("key IS NOT NULL").select(F.concat(lower_ascii(host), path).alias("key"),
                                                  (F.col("verdict") == "block").alias("blocked"))
    rows = rows.groupBy("key").agg(F.max("blocked").alias("blocked"))
    return rows.select("key", "blocked", F.size(F.split(F.substring_index("key", "/", 1), r"\.")).alias("labels"),
                       F.length(F.expr("substring(key, instr(concat(key, '/'), '/'))")).alias("chars"))


def url_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys of a URL, of the given (labels, characters of the path); the longest
    first, then that of the longer host."""
    labels, chars = F.size(F.split(host, r"\.")), F.length(path)
    found = [F.when((labels >= n) & (chars >= c), F.struct(
        F.substring_index(host, ".", -n).alias("host"), F.substring(path, 1, c).alias("path"))) for n, c in shapes]
    sized = F.transform(F.filter(F.array(*found), lambda x: x.isNotNull()), lambda x: F.struct(
        (-F.length(x["host"]) - F.length(x["path"])).alias("long"), (-F.length(x["host"])).alias("wide"),
        F.concat(x["host"], x["path"]).alias("key")))
    return F.transform(F.array_sort(sized), lambda x: x["key"])


# ------------------------------------------------------------------ verdicts
def judged(pages: DataFrame, rules: DataFrame, part_keys: int = PART_KEYS, url_col: str = "url",
           id_col: str = "page_id") -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule`` (key of the list, or NULL) and ``verdict``."""
    spark = pages.sparkSession
    listed = materialize(listed_keys(rules), "url-list")
    shapes = sorted(tuple(r) for r in listed.select("labels", "chars").distinct().collect())
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    no_rule = (F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    if not shapes:
        return rows.select(F.col("id").alias(id_col), "host", "path", *no_rule)
    keys = url_keys(F.col("host"), F.col("path"), shapes)
    universe = with_hashes(rows.select(F.explode(keys).alias("key")))
    universe_count = universe.agg(F.approx_count_distinct("h1")).first()[0]
    count = listed.count()
    parts = max(1, math.ceil(count / part_keys))
    rows = rows.select("*", F.lit(None).cast("int").alias("best"), F.lit(None).cast("boolean").alias("blocked"))
    for part in range(parts):
        own = F.pmod("h1", F.lit(parts)) == part
        mine = with_hashes(listed).filter(own)
        sides = {flag: with_hashes(listed.filter(F.col("blocked") == flag)).filter(own) for flag in (True, False)}
        counts = {flag: side.count() for flag, side in sides.items()}
        cascades = (build_cascade(mine, universe.filter(own), sum(counts.values()), universe_count // parts),
                    build_cascade(sides[True], sides[False], counts[True], counts[False]))
        rows = _looked_up(rows, keys, cascades, part, parts)
        if part + 1 < parts:
            rows = materialize(rows, "url-part")
    rule = F.when(F.col("best").isNotNull(), F.element_at(keys, F.col("best")))
    verdict = F.when(F.coalesce(F.col("blocked"), F.lit(False)), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _looked_up(rows: DataFrame, keys: Column, cascades: tuple[Cascade, Cascade], part: int, parts: int) -> DataFrame:
    """``best`` (place of the longest listed key so far) and ``blocked`` after one part."""
    sent = rows.sparkSession.sparkContext.broadcast(cascades)

    @F.arrow_udf("struct<best:int,blocked:boolean>")
    def look(first: pa.Array, second: pa.Array) -> pa.Array:
        listed, blocked = sent.value
        h1, h2 = _numpy(first.flatten()), _numpy(second.flatten())
        ends = np.cumsum(first.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.flatnonzero(h1 % parts == part)
        at = at[listed.has(h1[at], h2[at])]
        row = np.searchsorted(ends, at, side="right")
        row, k = np.unique(row, return_index=True)          # the first, so longest, of each row
        at = at[k]
        best, block = np.zeros(len(ends), np.int32), np.zeros(len(ends), bool)
        best[row] = at - np.concatenate([[0], ends])[row] + 1
        block[row] = blocked.has(h1[at], h2[at])
        none = best == 0
        return pa.StructArray.from_arrays([pa.array(best, mask=none), pa.array(block, mask=none)], ["best", "blocked"])

    found = rows.withColumn("now", look(F.transform(keys, lambda k: hashes(k)[0]), F.transform(keys, lambda k: hashes(k)[1])))
    better = F.col("now.best").isNotNull() & (F.col("best").isNull() | (F.col("now.best") < F.col("best")))
    return found.select("id", "host", "path", F.when(better, F.col("now.best")).otherwise(F.col("best")).alias("best"),
                        F.when(better, F.col("now.blocked")).otherwise(F.col("blocked")).alias("blocked"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "key string, verdict string")


def url_report(pages: DataFrame) -> DataFrame:
    return judged(pages, rule_table(pages.sparkSession))


#: DuckDB twin of ``url_report``.
URL_SQL = f"""
WITH rules(host, path, verdict) AS (
  VALUES {", ".join(f"('{k[:k.index('/')]}', '{k[k.index('/'):]}', '{v}')" for k, v in RULES)}
), p AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), f AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM f WHERE place = 1) USING (n)
"""
