"""Exact substring removal with two-stage suffix sorting.

Every byte covered by a 50-byte string that also starts in a document with a smaller
id is removed; matches never cross documents and are judged on the input.

1. Copies of a whole text are settled by digest: only the smallest id of a text goes
   on, every other copy is removed whole (if it has 50 bytes).
2. Each 50-byte string has a minimizer, the smallest hash of its 24-byte strings
   (ties: the first), so equal strings have equal minimizers.  The minimizers of all
   texts are dealt by hash range as packed numbers; those that occur in two
   different texts come back to their texts.
3. The stretches of text around such minimizers (all 50-byte strings that have it)
   are cut out, and equal stretches are pre-aggregated to the smallest id that holds
   them: however often a passage occurs, one row goes on.
4. Distinct stretches are dealt by minimizer, so equal 50-byte strings meet in one
   task, and suffix-sorted there in two stages: suffixes smaller than their successor
   are sorted directly, all others are induced by one scan of the buckets from the
   smallest letter up.  Runs of adjacent suffixes with a common prefix of 50 bytes are
   the repeated strings; each gets the smallest id of its run.  A minimizer whose
   stretches alone exceed ``SORT_BYTES`` isn't sorted: its 50-byte strings are
   aggregated to their smallest id and joined with their places.
5. Stretches meet their occurrences in a join (hot ones are skewed keys that Spark
   splits), removed ranges are united per text, and what is left is digested.

Only 50 bytes of a suffix matter, so direct sorting looks at 56 bytes, and suffixes
that neither start a 50-byte string of their stretch nor induce one are left out.

Defined cases: NULL is an empty text; texts under 50 bytes lose nothing; a NULL id
is larger than any other; rows of equal id never remove each other; an empty table
gives no rows; long texts are single rows and need memory in proportion to their
length; extra columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, temporary_tables
from .ngram_join import bitmap, in_bitmap, mix

# --- parameters ---
SPAN = 50
GRAM = 24                     # bytes of a minimizer
BLOCK_MINIMIZERS = 1_500_000  # minimizers compared by a task at a time
SORT_BYTES = 1_500_000        # of distinct stretches, suffix-sorted together
GROUP_TEXTS = 256
# ------------------

_U = np.uint64
_WINDOW = SPAN - GRAM + 1
_LAST_ID = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ minimizers
def gram_hashes(data: bytes) -> np.ndarray:
    """Hashes of all GRAM-byte strings of ``data``, by doubling."""
    h, power, step, at = np.frombuffer(data, np.uint8).astype(np.uint64) + _U(1), _U(0x9E3779B97F4A7C15), 1, 0
    n = len(data) - GRAM + 1
    out = None
    with np.errstate(over="ignore"):
        while True:
            if GRAM & step:
                piece = h[at:at + n]
                # lengths in binary, the lowest place first: each piece follows those before it
                out = piece if out is None else out * power + piece
                at += step
            if 2 * step > GRAM:
                return mix(out)
            h = h[:-step] * power + h[step:]
            power = power * power
            step *= 2


def minimizer_values(h: np.ndarray) -> np.ndarray:
    """The distinct runs of minimizers of consecutive 50-byte strings."""
    low, width = h, 1
    while 2 * width <= _WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < _WINDOW:
        low = np.minimum(low[:len(low) - (_WINDOW - width)], low[_WINDOW - width:])
    return low[np.r_[True, low[1:] != low[:-1]]]


def minimizer_places(h: np.ndarray) -> np.ndarray:
    """For each 50-byte string, the place of its minimizer (the first, if equal)."""
    low, at, width = h, np.arange(len(h)), 1

    def joined(shift: int):
        right = low[shift:] < low[:-shift]
        return np.where(right, low[shift:], low[:-shift]), np.where(right, at[shift:], at[:-shift])

    while 2 * width <= _WINDOW:
        low, at = joined(width)
        width *= 2
    if width < _WINDOW:
        low, at = joined(_WINDOW - width)
    return at


def _part(h: np.ndarray, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of a minimizer (its leading bits) and the 32 bits that follow."""
    block = (h >> _U(64 - block_bits)) if block_bits else np.zeros(len(h), np.uint64)
    return block.astype(np.int64), ((h >> _U(32 - block_bits)) & _U(0xFFFFFFFF)).astype(np.uint32)


def minimizer_rows(texts: DataFrame, block_bits: int) -> DataFrame:
    """``block``, ``keys`` (16 bytes a text), ``owner`` (which of them), ``hashes``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found = [], []

        def packed() -> pa.RecordBatch:
            h = np.concatenate([*found, np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.uint8)
            block, low = _part(h, block_bits)
            order = np.argsort(block, kind="stable")
            block, low, owner = block[order], low[order], owner[order]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
            out = []
            for a, b in zip(starts, [*starts[1:], len(block)]):
                own, back = np.unique(owner[a:b], return_inverse=True)
                out.append((int(block[a]), b"".join(keys[i] for i in own), back.astype(np.uint8).tobytes(), low[a:b].tobytes()))
            blocks, k, o, v = zip(*out) if out else ((),) * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array(k, pa.binary()), pa.array(o, pa.binary()), pa.array(v, pa.binary())],
                names=["block", "keys", "owner", "hashes"])

        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column(1)[row].as_py()
                if len(data) < SPAN:
                    continue
                keys.append(batch.column(0)[row].as_py())
                found.append(minimizer_values(gram_hashes(data)))
                if len(keys) == GROUP_TEXTS or sum(map(len, found[-1:])) > 1_000_000:
                    yield packed()
                    keys, found = [], []
        yield packed()

    return texts.select("tkey", "data").mapInArrow(run, "block int, keys binary, owner binary, hashes binary")


def shared_minimizers(rows: DataFrame) -> DataFrame:
    """``tkey``, ``block``, ``hashes`` of the minimizers that two texts have."""

    def find(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, "V16") for k in pdf["keys"]])
        first = np.cumsum([0, *(len(k) // 16 for k in pdf["keys"])])[:-1]
        # one number for each minimizer: its hash and the place of its text
        both = np.concatenate([(np.frombuffer(v, np.uint32).astype(np.uint64) << _U(32)) | (np.frombuffer(o, np.uint8) + _U(f))
                               for v, o, f in zip(pdf["hashes"], pdf["owner"], first)])
        del pdf
        tags = np.ascontiguousarray(keys).view(np.uint64)[::2]
        # copies of a text count once
        _, once = np.unique(tags, return_index=True)
        is_first = np.zeros(len(keys), bool)
        is_first[once] = True
        both = both[is_first[both & _U(0xFFFFFFFF)]]
        both.sort()
        low = both >> _U(32)
        start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, int)
        if not len(start):
            return pd.DataFrame({"tkey": [], "block": [], "hashes": []})
        end = np.r_[start[1:], len(low)]
        # sorted by text within a hash: two texts, if the first and the last differ
        shared = np.repeat(both[start] != both[end - 1], end - start)
        both = both[shared]
        both = (both << _U(32)) | (both >> _U(32))
        both.sort()
        owner, low = (both >> _U(32)).astype(np.int64), both.astype(np.uint32)
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
        return pd.DataFrame({"tkey": [keys[owner[a]].tobytes() for a in start], "block": int(key[0]),
                             "hashes": [low[a:b].tobytes() for a, b in zip(start, [*start[1:], len(low)])]})

    return rows.groupBy("block").applyInPandas(find, "tkey binary, block int, hashes binary")


# ------------------------------------------------------------------ stretches
def stretches(texts: DataFrame, block_bits: int) -> DataFrame:
    """``mkey``, ``bytes``, ``doc``, ``tkey``, ``pos``: the stretches around shared
    minimizers of ``texts`` (tkey, doc, data, shared: array of (block, hashes))."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mkey", "bytes", "doc", "tkey", "pos"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row in range(batch.num_rows):
                tkey, doc, data, shared = (c[row].as_py() for c in batch.columns)
                h = gram_hashes(data)
                at = minimizer_places(h)
                start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                end = np.r_[start[1:], len(at)] + SPAN - 1
                value = h[at[start]]
                block, low = _part(value, block_bits)
                own = np.concatenate([np.frombuffer(s["hashes"], np.uint32).astype(np.uint64) | _U(s["block"] << 32) for s in shared])
                keep = np.flatnonzero(np.isin(low.astype(np.uint64) | (block.astype(np.uint64) << _U(32)), own))
                out[0] += value[keep].view(np.int64).tolist()
                out[1] += [data[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())]
                out[2] += [doc] * len(keep)
                out[3] += [tkey] * len(keep)
                out[4] += start[keep].tolist()
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return texts.select("tkey", "doc", "data", "shared").mapInArrow(
        run, "mkey bigint, bytes binary, doc bigint, tkey binary, pos int")


# ------------------------------------------------------------------ suffix sorting
def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, the first one leading."""
    t = np.concatenate([data, np.full(64, 255, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        t = (t[:-shift] << _U(8 * shift)) | t[shift:]
    return t


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The ``wanted`` places (a mask) of ``data`` in the order of the suffixes that
    start there, right for the first ``depth`` bytes.

    The end of the data counts as larger than any byte."""
    n = len(data)
    t = np.concatenate([data.astype(np.int16), [256]])
    step = np.sign(np.diff(t))
    # a suffix compares with its successor as the next unequal neighbours do
    decided = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = np.r_[step[np.minimum(decided, n - 1)] > 0, True]      # the place n: the end itself
    # the next smaller-than-successor place: what a place is induced from, step by step
    source = np.where(smaller, np.arange(n + 1), n + 1)
    source = np.minimum.accumulate(source[::-1])[::-1]
    begin = np.flatnonzero(wanted)
    mark = np.zeros(n + 2, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, source[begin] + 1, -1)
    needed = np.cumsum(mark)[:n + 1] > 0
    # stage 1: direct sorting, eight bytes at a time, ties only
    direct = np.flatnonzero(needed & smaller)
    w = words_at(data)
    key = w[np.minimum(direct, n)]
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    for skip in range(8, depth + 1, 8):
        tied = ~fresh | np.r_[~fresh[1:], False]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(fresh)[at]
        key = w[np.minimum(direct[at] + skip, n)]
        order = np.lexsort((key, group))
        direct[at] = direct[at][order]
        key, group = key[order], group[order]
        fresh[at] |= np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
    # stage 2: buckets by first letter, smallest first; a place whose predecessor is
    # larger puts that predecessor at the end of the induced part of its bucket
    first = t[direct]
    bounds = np.searchsorted(first, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        letters = t[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]]) if len(letters) else []
        for a, b in zip(cuts, [*cuts[1:], len(before)]):
            induced[letters[a]].append(before[a:b])

    for letter in range(257):
        done = 0
        while done < len(induced[letter]):      # runs of one letter come in waves
            wave = induced[letter][done]
            done += 1
            out.append(wave)
            induce(wave)
        own = direct[bounds[letter]:bounds[letter + 1]]
        if len(own):
            out.append(own)
            induce(own)
    places = np.concatenate(out) if out else np.zeros(0, np.int64)
    return places[np.r_[wanted, False][places]]


def adjacent_prefixes(data: np.ndarray, order: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Common prefix (``most`` bytes at most) of each suffix with the one before it."""
    w = words_at(data)
    n = len(data)
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for skip in range(0, most, 8):
        x = w[np.minimum(order[open_] + skip, n)] ^ w[np.minimum(order[open_ - 1] + skip, n)]
        equal = x == 0
        # leading equal bytes of the first different word
        rest = x[~equal]
        lead = np.zeros(len(rest), np.int64)
        for b in range(1, 8):
            lead += (rest >> _U(64 - 8 * b)) == 0
        out[open_[~equal]] = skip + lead
        open_ = open_[equal]
    out[open_] = most
    return np.minimum(out, most)


def repeated_starts(parts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each of ``parts`` (with the smallest id that holds it) the starts of
    50-byte strings that a part of a smaller id holds."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(parts)), lengths)
    wanted = np.arange(len(data)) + SPAN <= (begin + lengths)[owner]
    order = two_stage_order(data, wanted)
    group = np.flatnonzero(adjacent_prefixes(data, order) < SPAN)
    doc = docs[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, group), np.diff([*group, len(order)]))
    hit = np.sort(order[least < doc])
    cut = np.searchsorted(hit, [*begin, len(data)])
    return [hit[a:b] - s for a, b, s in zip(cut, cut[1:], begin)]


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges covered by 50-byte strings at sorted ``starts``."""
    if not len(starts):
        return []
    new = np.r_[True, np.diff(starts) > SPAN]
    return list(zip(starts[new].tolist(), (starts[np.r_[new[1:], True]] + SPAN).tolist()))


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def judged(parts: DataFrame, tasks: int) -> DataFrame:
    """``mkey``, ``h``, ``owner``, ``n``, ``spans`` (removed from the owner) of the
    distinct stretches (mkey, bytes, owner, n) that remove anything."""

    def sort(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(pdf["bytes"].tolist(), pdf["owner"].to_numpy())
        spans = [[{"a": a, "b": b} for a, b in spans_of(s)] for s in found]
        out = pd.DataFrame({"mkey": pdf["mkey"], "h": pdf["h"], "owner": pdf["owner"], "n": pdf["n"], "spans": spans})
        return out[(out["n"] > 1) | out["spans"].map(bool)]

    dealt = parts.withColumn("task", F.pmod("mkey", F.lit(tasks)).cast("int"))
    return dealt.groupBy("task").applyInPandas(
        sort, "mkey bigint, h bigint, owner bigint, n bigint, spans array<struct<a:int,b:int>>")


def judged_apart(parts: DataFrame) -> DataFrame:
    """``judged`` for stretches of hot minimizers: their 50-byte strings are dealt by
    themselves.  The smallest id of a string is a partial aggregate, and it meets the
    string's places in a join, so a string that many stretches hold is split as well."""
    last = F.octet_length("bytes") - SPAN
    one = parts.select("mkey", "h", "owner", F.posexplode(F.transform(
        F.sequence(F.lit(1), last + 1), lambda a: F.substring(F.col("bytes"), a, F.lit(SPAN)))).alias("at", "s"))
    least = one.groupBy("s").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least < most")
    hits = one.join(least, "s").filter("owner > least")
    # the starts in a stretch are less than SPAN apart: one range
    spans = hits.groupBy("mkey", "h", "owner").agg(F.array(F.struct(
        F.min("at").alias("a"), (F.max("at") + SPAN).cast("int").alias("b"))).alias("spans"))
    out = parts.select("mkey", "h", "owner", "n").join(spans, ["mkey", "h", "owner"], "left")
    return (out.filter((F.col("n") > 1) | F.col("spans").isNotNull())
            .withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))))


# ------------------------------------------------------------------ Spark
def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"),
                       F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias("doc"),
                       F.unhex(F.md5(text.cast("binary"))).alias("tkey"))


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose (tkey, doc) may be in ``wanted``, by a bitmap: a few others pass as well,
    but not all copies of a text."""
    bits = bitmap(wanted.select(F.xxhash64("tkey", "doc").alias("k")), "k")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits, batch.column("k").to_numpy())))

    rows = texts.select("tkey", "doc", F.col("text").cast("binary").alias("data"), F.xxhash64("tkey", "doc").alias("k"))
    return rows.mapInArrow(run, rows.schema)


def removed_spans(keyed: DataFrame, base: DataFrame) -> DataFrame:
    """``tkey``, ``doc``, ``spans`` (array of (a, b)) of each text that loses bytes,
    its first document standing for it; whole copies are not listed.  ``base`` has
    the rows (tkey, doc, n_bytes)."""
    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("t")).first()["t"]
    count = 2 * total / (_WINDOW + 1)
    block_bits = max(0, min(24, math.ceil(math.log2(max(count / BLOCK_MINIMIZERS, 1)))))
    units = base.filter(F.col("n_bytes") >= SPAN).groupBy("tkey").agg(F.min("doc").alias("doc"))
    data = keyed.select("tkey", F.col("text").cast("binary").alias("data"))
    with temporary_tables(keyed.sparkSession):
        with temporary_tables(keyed.sparkSession):
            shared = (shared_minimizers(minimizer_rows(data, block_bits)).groupBy("tkey")
                      .agg(F.collect_list(F.struct("block", "hashes")).alias("shared")))   # of one text
            shared = materialize(shared.join(units, "tkey"), "shared-minimizers")
            found = _only(keyed, shared).join(shared, ["tkey", "doc"]).select("tkey", "doc", "data", "shared")
            found = materialize(stretches(found, block_bits), "stretches", keep=True)
        parts = found.groupBy("mkey", "bytes").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("n"))
        parts = materialize(parts.withColumn("h", F.xxhash64("bytes")), "distinct-stretches")
        size = parts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("t")).first()["t"]
        # bounded: at most a minimizer for each SORT_BYTES of distinct stretches
        hot = parts.groupBy("mkey").agg(F.sum(F.octet_length("bytes")).alias("t")).filter(F.col("t") > SORT_BYTES)
        hot = F.broadcast(materialize(hot.select("mkey"), "hot-minimizers"))
        known = judged(parts.join(hot, "mkey", "left_anti"), max(1, math.ceil(size / SORT_BYTES)))
        known = materialize(known.unionByName(judged_apart(parts.join(hot, "mkey", "left_semi"))), "judged-stretches")
        places = found.select("mkey", F.xxhash64("bytes").alias("h"), "doc", "tkey", "pos", F.octet_length("bytes").alias("size"))
        met = places.join(known, ["mkey", "h"]).filter((F.col("doc") > F.col("owner")) | (F.size("spans") > 0))
        whole = F.array(F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("size")).alias("b")))
        own = F.transform("spans", lambda s: F.struct((s["a"] + F.col("pos")).alias("a"), (s["b"] + F.col("pos")).alias("b")))
        ranges = met.select("tkey", "doc", F.when(F.col("doc") > F.col("owner"), whole).otherwise(own).alias("s"))
        ranges = ranges.groupBy("tkey", "doc").agg(F.flatten(F.collect_list("s")).alias("spans"))   # of one text
        return materialize(ranges, "removed", keep=True)


def _base(keyed: DataFrame) -> DataFrame:
    return materialize(keyed.select("doc_id", "doc", "tkey", F.octet_length("text").cast("bigint").alias("n_bytes"),
                                    F.sha2("text", 256).alias("sha256")), "dedup-base")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    keyed = _keyed(docs, id_col, text_col)
    base = _base(keyed)
    spans = removed_spans(keyed, base)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                tkey, data, found = (c[row].as_py() for c in batch.columns)
                runs = united((s["a"], s["b"]) for s in found)
                out.append((tkey, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(data, runs)).hexdigest()))
            k, r, n, h = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(r, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(h, pa.string())], names=["tkey", "r", "s", "h"])

    texts = _only(keyed, spans).dropDuplicates(["tkey", "doc"])
    cut = texts.join(spans, ["tkey", "doc"]).select("tkey", "data", "spans").mapInArrow(
        digest, "tkey binary, r bigint, s bigint, h string")
    first = base.groupBy("tkey").agg(F.min("doc").alias("first"))
    rows = base.join(first.join(cut, "tkey", "left"), "tkey")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= SPAN)
    hit = (F.col("doc") == F.col("first")) & F.col("r").isNotNull()

    def pick(whole: Column, some: str, none: Column) -> Column:
        return F.when(copy, whole).when(hit, F.col(some)).otherwise(none)

    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", "n_bytes", pick(F.col("n_bytes"), "r", zero).alias("n_removed"),
                       pick(F.lit(1).cast("bigint"), "s", zero).alias("n_spans"),
                       pick(F.lit(_EMPTY), "h", F.col("sha256")).alias("kept_sha256"))


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``data`` without the ranges ``runs`` (sorted, apart)."""
    ends = [0, *(b for _, b in runs)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(data)]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text (characters that a cut
    splits go as well); documents that lose their whole text go."""
    keyed = _keyed(docs, id_col, text_col)
    base = _base(keyed)
    spans = removed_spans(keyed, base)
    first = base.groupBy("tkey").agg(F.min("doc").alias("_sd_first"), F.max("n_bytes").alias("_sd_size"))
    first = first.join(spans.select("tkey", F.col("spans").alias("_sd_spans")), "tkey", "left").withColumnRenamed("tkey", "_sd_key")

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(text, found):
            if f is None:
                out.append(t)
            else:
                runs = united((s["a"], s["b"]) for s in f)
                out.append(kept(t.encode(), runs).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    cut = cut.asNondeterministic()      # evaluated once, also for the filter
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID))
    rows = docs.withColumn("_sd_doc", doc).withColumn("_sd_text", F.unhex(F.md5(text.cast("binary"))))
    rows = rows.join(first, F.col("_sd_text") == F.col("_sd_key"))
    rows = rows.filter((F.col("_sd_doc") == F.col("_sd_first")) | (F.col("_sd_size") < SPAN))
    lost = F.col("_sd_spans").isNotNull()
    after = rows.withColumn("_sd_new", cut(F.col(text_col), F.col("_sd_spans")))
    after = after.filter(~lost | (F.col("_sd_new") != "")).withColumn(text_col, F.when(lost, F.col("_sd_new")).otherwise(F.col(text_col)))
    return after.select(*docs.columns)
