"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word 5-grams (its tokens), as 64-bit hashes.
Tokens fall into two classes by the number of documents that hold them: rare and
frequent.  In the order rare before frequent, then by hash, two sets of at least 3/4
Jaccard similarity that lack d = floor(n / 4) tokens of each other at most must
share a signature:

* a set with more than d rare tokens has its first d + 1 as prefix, and every
  single rare token of a prefix is a signature;
* otherwise its rare tokens and the frequent ones up to d + 1 + G tokens in all are
  the prefix.  The frequent tokens of a prefix are dealt into G groups by hash, and
  every pair within a group is a signature (k = 2): of the 1 + G tokens that two
  prefixes must share, one is rare or two fall into one group.

G is an eighth of the size class of the larger set (a power of two), so a set has a
number of pairs in proportion to its tokens; it writes them for its own class and,
where a partner may be of the next class, for that.  Below class 8 frequent tokens
are single signatures too.  Rare tokens that occur in one document alone take their
place in the prefix but are not written (as far as a bitmap of the shared ones tells).

Only sets that share a signature meet; of signatures that the same sets have, one is
enough.  In a round each set is compared with one hub, the first set of the most
frequent signature it has left (later, of any one); linked sets become components, and
signatures whose sets are all in one component are done with.  So a group of thousands
of near copies costs a few comparisons per member, not one per pair.  When hubs settle
little more, sets in different components that share a signature meet inside tasks, block
against block of a signature: sizes, and sketches whose bits differ in no more places than
the sets, show most pairs to be too far apart.  First each signature gives the closest pairs
that join what all its pairs join (a forest, so fewer rows than sets); then all pairs that
are still in different components become rows, each at the first signature that its sets
share.  So no link between different components is lost, and no signature gives a row per
pair of its sets.  Verification counts the common tokens of the whole sets.

Token counts cover all documents: each task sorts the tokens of a batch, deals them
by hash range, and sends them as compressed differences; the frequent ones come back
as a bitmap of fixed size, and the least frequency counted as frequent grows in
powers of two until they fit.  Which class a token is in decides about speed alone.

Equal sets are one node (``sid``, a 64-bit digest of the set, used with its size);
hashes make two different sets equal, or a shingle match wrongly, with a probability
of about 2**-64 per pair compared.

Defined cases: NULL and empty texts, and texts without words, have an empty set and
link with nothing; a text of fewer than five words is one shingle; repeated rows are
members of the same group; a NULL id takes part and is never the smallest id of its
group unless it is alone; an empty table gives no rows; other columns are kept by
``keep_first`` and not read elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, temporary_tables
from .components import components

# --- parameters ---
NGRAM = 5
PERCENT = 75
FREQUENT = 4                # documents that make a token frequent, at least
MOST_FREQUENT = 1 << 24     # tokens of the frequent class
BITMAP_BITS = 27            # of the bitmaps that tasks get
BLOCK_TOKENS = 2_000_000    # tokens counted by a task at a time
STAR_ROUNDS = 6
SMALL_GROUP = 32            # sets of a signature that are compared together with those of others
GROUP_BLOCK = 512           # sets of a signature compared with each other by one task at a time
SKETCH_BITS = 4096          # of a set's sketch, at most
TABLED_BYTES = 64           # of a word, hashed by table; longer words are digested
BLOCK_BYTES = 1 << 18       # of texts cut into words at a time
# ------------------

_U = np.uint64
_FACTOR = [_U(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(NGRAM + 2)]


#: A random number for each byte at each place of a word: the sum of those of a word is its hash.
_TABLE = np.frombuffer(hashlib.shake_256(b"words").digest(TABLED_BYTES * 256 * 8), "<u8")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_INSIDE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def word_hashes(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of ``data`` (bytes of texts that start at ``begin``) and its place."""
    data = _LOWER[data]
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = begin[begin < len(data)]
    first[begin] = inside[begin]
    at = np.flatnonzero(inside)
    word = np.flatnonzero(first[at])
    if not len(word):
        return np.zeros(0, np.uint64), word
    size = np.diff(word, append=len(at))
    place = np.arange(len(at)) - np.repeat(word, size)
    hashes = np.add.reduceat(_TABLE[(np.minimum(place, TABLED_BYTES - 1) << 8) | data[at]], word)
    for k in np.flatnonzero(size > TABLED_BYTES):
        a = at[word[k]]
        hashes[k] = int.from_bytes(hashlib.blake2b(data[a:a + size[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes, at[word]


def token_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct token hashes of each text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data if data is not None else b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1)
        begin = offsets[lo:hi + 1] - offsets[lo]
        w, places = word_hashes(data[offsets[lo]:offsets[hi]], begin)
        ends = np.searchsorted(places, begin).tolist()
        lo = hi
        with np.errstate(over="ignore"):
            # windows across two texts are not used
            h = np.zeros(0, np.uint64)
            if len(w) >= NGRAM:
                h = w[:len(w) - NGRAM + 1] * _FACTOR[1]
                for k in range(1, NGRAM):
                    h = h + w[k:len(w) - NGRAM + 1 + k] * _FACTOR[k + 1]
                h = mix(h)
            for a, b in zip(ends, ends[1:]):
                if b - a >= NGRAM:
                    found = np.sort(h[a:b - NGRAM + 1])
                    yield found[np.r_[True, found[1:] != found[:-1]]]
                elif b > a:
                    yield mix((w[a:b] * np.array(_FACTOR[1:b - a + 1])).sum(keepdims=True, dtype=np.uint64) + _U(b - a))
                else:
                    yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Other columns' values and the token set of each row; text is the last column."""
    for batch in batches:
        *others, text = batch.columns
        yield from zip(*(c.to_pylist() for c in others), token_sets(text))


def members(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``n``, ``sid`` (NULL: empty set) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, key, tokens in _texts(batches):
            rows.append((doc_id, key, len(tokens), set_id(tokens) if len(tokens) else None))
            if len(rows) == 10_000:
                yield _batch(rows, ("doc_id", "text_key", "n", "sid"))
                rows = []
        yield _batch(rows, ("doc_id", "text_key", "n", "sid"))

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, sid bigint")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _longs(*arrays: np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64, copy=False)) for a in arrays], names=list(names))


# ------------------------------------------------------------------ token classes
def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned values as differences, byte planes apart, compressed."""
    diff = np.diff(values, prepend=_U(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(diff.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def token_frequencies(docs: DataFrame, total: int) -> tuple[DataFrame, int]:
    """``key``, ``count`` of the keys (leading bits of tokens) of two
    documents or more, and the number of bits.  32 keys for each token keep chance meetings
    rare at any size."""
    bits = min(60, max(24, math.ceil(math.log2(total + 1)) + 5))
    blocks = 1 << max(4, math.ceil(math.log2(total / BLOCK_TOKENS + 1)))
    shift, span = _U(64 - bits), _U(1 << bits) // _U(blocks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def packed() -> pa.RecordBatch:
            keys = np.sort(np.concatenate([*kept, np.zeros(0, np.uint64)]) >> shift)
            ends = np.searchsorted(keys, np.arange(1, blocks, dtype=np.uint64) * span)
            parts = np.split(keys, ends)
            rows = [(b, pack_sorted(p - _U(b) * span)) for b, p in enumerate(parts) if len(p)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                               pa.array([r[1] for r in rows], pa.binary())], names=["block", "keys"])

        for (tokens,) in _texts(batches):
            kept.append(tokens)
            size += len(tokens)
            if size >= 4_000_000:
                yield packed()
                kept, size = [], 0
        yield packed()

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate([unpack_sorted(d) for d in pdf["keys"]]), return_counts=True)
        many = n > 1
        return pd.DataFrame({"key": (keys[many] + _U(int(key[0])) * span).astype(np.int64), "count": n[many]})

    sent = docs.select("text").mapInArrow(run, "block int, keys binary")
    return sent.groupBy("block").applyInPandas(count, "key bigint, count bigint"), bits


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the low bits of a long column: 2**BITMAP_BITS bits at most, built
    by an aggregate over its words."""
    place = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = (keys.select(place.alias("place")).select(F.shiftright("place", 6).cast("int").alias("word"), bit.alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.view(np.uint64) & _U((1 << BITMAP_BITS) - 1)
    return (bits[place >> _U(6)] >> (place & _U(63))) & _U(1) == 1


def token_classes(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps of the keys of frequent and of shared tokens, and the number of bits of a key."""
    found, bits = token_frequencies(docs, total)
    found = materialize(found, "token-counts")
    sizes = found.groupBy(F.floor(F.log2("count")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, e = FREQUENT, int(math.log2(FREQUENT))
    while sum(r["n"] for r in sizes if r["e"] >= e) > MOST_FREQUENT:
        e += 1
        least = 1 << e
    return bitmap(found.filter(F.col("count") >= least), "key"), bitmap(found, "key"), bits


# ------------------------------------------------------------------ signatures
def size_classes(n: int) -> list[int]:
    """Size classes (powers of two) of the larger set of a pair that a set of n
    tokens may be in."""
    own = 1 << (n.bit_length() - 1)
    return [own, 2 * own] if 100 * n >= PERCENT * 2 * own else [own]


def signatures(tokens: np.ndarray, frequent: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Signatures of a set: sorted tokens, which of them are frequent, and which another
    set may have.  Rare tokens that no other set has fill the prefix but are no signatures."""
    n = len(tokens)
    lack = n - (PERCENT * n + 99) // 100
    rare, known = tokens[~frequent], shared[~frequent]
    out = [rare[:lack + 1][known[:lack + 1]]]
    if len(rare) > lack:
        return out[0]
    often = tokens[frequent]
    for size in size_classes(n):
        if size < 8:
            out.append(often[:lack + 1 - len(rare)])
            continue
        groups = size // 8
        part = often[:lack + 1 - len(rare) + groups]
        # groups by bits that the order doesn't use
        group = mix(part) % _U(groups)
        at = np.lexsort((part, group))
        part, group = part[at], group[at]
        step = 1
        while step < len(part) and (same := group[step:] == group[:-step]).any():
            a, b = part[:-step][same], part[step:][same]
            out.append(mix(a * _FACTOR[2] + b * _FACTOR[3] + _U(size)))
            step += 1
    return np.concatenate(out)


def signature_rows(docs: DataFrame, frequent: np.ndarray, shared: np.ndarray, key_bits: int) -> DataFrame:
    """``sig``, ``n``, ``sid`` of every document's signatures."""
    shift = _U(64 - key_bits)
    names = ("sig", "n", "sid")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            lengths = [len(s) for s in sigs]
            n, sid = np.array(owners, np.int64).reshape(-1, 2).T
            return _longs(np.concatenate([*sigs, np.zeros(0, np.uint64)]).view(np.int64), np.repeat(n, lengths),
                          np.repeat(sid, lengths), names=names)

        with np.errstate(over="ignore"):
            for (tokens,) in _texts(batches):
                if len(tokens):
                    keys = tokens >> shift
                    found = signatures(tokens, in_bitmap(frequent, keys), in_bitmap(shared, keys))
                    if len(found):
                        sigs.append(found)
                        owners.append((len(tokens), set_id(tokens)))
                        size += len(found)
                if size >= 100_000:
                    yield flushed()
                    sigs, owners, size = [], [], 0
            yield flushed()

    return docs.select("text").mapInArrow(run, "sig bigint, n bigint, sid bigint")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """The rows (once each) whose signature another set has too.

    Rows arrive sorted; of a signature that one set alone has had so far, one row is
    held until the next batch."""
    names = ("sig", "n", "sid")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, np.int64)] * 3        # a set that may be alone with its signature
        open_sig, open_sid = None, None           # last signature known to be shared, and its last set
        for batch in batches:
            sig, n, sid = (np.concatenate([a, c.to_numpy()]) for a, c in zip(left, batch.columns))
            if not len(sig):
                continue
            first = np.r_[True, sig[1:] != sig[:-1]]
            again = ~first & np.r_[False, sid[1:] == sid[:-1]]
            group = np.cumsum(first) - 1
            shared = np.zeros(group[-1] + 1, bool)
            shared[group[~first & ~again]] = True
            if open_sig is not None and sig[0] == open_sig:
                shared[0] = True
                again[0] = sid[0] == open_sid
            keep = ~again & shared[group]
            if shared[-1]:
                open_sig, open_sid = sig[-1], sid[-1]
                left = [a[:0] for a in (sig, n, sid)]
            else:
                open_sig = None
                left = [a[-1:] for a in (sig, n, sid)]
            if keep.any():
                yield _longs(sig[keep], n[keep], sid[keep], names=names)

    ordered = rows.repartition("sig").sortWithinPartitions("sig", "n", "sid")
    return ordered.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def without_twins(posts: DataFrame) -> DataFrame:
    """Of signatures that the same sets have, one: a passage or a group of copies gives
    hundreds.  Sets of sets are compared by size and two exclusive sums of hashes."""
    per = posts.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("sid")).alias("x"),
                                   F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"))
    return posts.join(per.groupBy("k", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "k"), "sig")


# ------------------------------------------------------------------ verification
def sets_of(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``sid``, ``tokens`` (binary) of the sets of texts whose key is in the bitmap."""

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(wanted, batch.column(0).to_numpy()))).select([1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, size = [], [], 0
        for (tokens,) in _texts(chosen(batches)):
            if not len(tokens):
                continue
            ids.append(set_id(tokens))
            data.append(tokens.tobytes())
            size += len(data[-1])
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["sid", "tokens"])
                ids, data, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["sid", "tokens"])

    rows = docs.select(F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "sid bigint, tokens binary").dropDuplicates(["sid"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            good = []
            for k in range(batch.num_rows):
                s, t = (np.frombuffer(c[k].as_py(), np.uint64) for c in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                good.append(100 * common >= PERCENT * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


# ------------------------------------------------------------------ what hubs leave
def sketch(tokens: np.ndarray) -> bytes:
    """For each of W buckets of tokens, whether the set has an odd number in it: two sketches
    differ in no more bits than the sets in tokens.  W is the next power of two above the
    set's size (64 to SKETCH_BITS); halves of a sketch combine by xor to one of W / 2."""
    width = min(SKETCH_BITS, max(64, 1 << len(tokens).bit_length()))
    odd = np.bincount((tokens & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(sets: DataFrame) -> DataFrame:
    """``sid``, ``sketch`` of ``sets``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(np.frombuffer(t.as_py(), np.uint64)) for t in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(found, pa.binary())], names=["sid", "sketch"])

    return sets.select("sid", "tokens").mapInArrow(run, "sid bigint, sketch binary")


def similar(n: np.ndarray, c: np.ndarray, apart: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets that ``distances`` has."""
    return distances(n, c, apart, marks)[:2]


def distances(n: np.ndarray, c: np.ndarray, apart: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, ...]:
    """Places (i, j) of the sets of different components ``c`` that sizes and sketches let
    link, and the bits by which these differ: J >= 3/4 leaves a seventh of both sizes as
    tokens of one set only.  Sets meet when one is in part 0 of ``apart`` and the other
    isn't, or all are in part 0."""
    words = [np.frombuffer(m, "<u8") for m in marks]
    width = np.array([len(w) for w in words])
    within = not apart.any()
    found = [np.zeros((3, 0), np.int64)]
    for w in np.unique(width):
        mine, others = np.flatnonzero(width == w), np.flatnonzero(width >= w)
        folded = np.array([np.bitwise_xor.reduce(words[k].reshape(-1, w), axis=0) for k in others])
        own = folded[width[others] == w]
        step = max(1, 1_000_000 // (len(others) * int(w)))
        for at in range(0, len(mine), step):
            i, j = mine[at:at + step, None], others[None, :]
            good = (c[i] != c[j]) & ((width[j] > w) | (i < j))
            good &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
            if not within:
                good &= apart[i] != apart[j]
            x, y = np.nonzero(good)
            if not len(x):
                continue
            differ = np.bitwise_count(own[at:at + step][x] ^ folded[y]).sum(axis=1, dtype=np.int64)
            x, y = mine[at + x], others[y]
            near = (100 + PERCENT) * differ <= (100 - PERCENT) * (n[x] + n[y])
            found.append(np.stack([x[near], y[near], differ[near]]))
    return tuple(np.concatenate(found, axis=1))


def small_distances(ends: np.ndarray, n: np.ndarray, c: np.ndarray, meet: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """As ``distances``, of the sets of each group of at most SMALL_GROUP rows (``ends``: where
    groups begin and end) at once; rows of unequal ``meet`` meet, and all where it is -1."""
    size = np.diff(ends)
    last = np.repeat(ends[1:], size)
    at = np.flatnonzero(np.repeat(size <= SMALL_GROUP, size))
    more = last[at] - at - 1
    x = np.repeat(at, more)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(more) - more, more)
    good = (c[x] != c[y]) & ((meet[x] != meet[y]) | (meet[x] < 0))
    good &= 100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])
    x, y = x[good], y[good]
    width = np.array([len(m) // 8 for m in marks], np.int64)
    least = np.minimum(width[x], width[y])
    found = [np.zeros((3, 0), np.int64)]
    for w in np.unique(least).tolist():
        i, j = x[least == w], y[least == w]
        rows, where = np.unique(np.concatenate([i, j]), return_inverse=True)
        bits = np.empty((len(rows), w), np.uint64)
        for v in np.unique(width[rows]).tolist():
            own = np.flatnonzero(width[rows] == v)
            whole = np.frombuffer(b"".join(marks[k] for k in rows[own].tolist()), "<u8")
            bits[own] = np.bitwise_xor.reduce(whole.reshape(len(own), v // w, w), axis=1)
        differ = np.bitwise_count(bits[where[:len(i)]] ^ bits[where[len(i):]]).sum(axis=1, dtype=np.int64)
        near = (100 + PERCENT) * differ <= (100 - PERCENT) * (n[i] + n[j])
        found.append(np.stack([i[near], j[near], differ[near]]))
    return np.concatenate(found, axis=1)


def forest(x: np.ndarray, y: np.ndarray, cost: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) join all components ``c`` that all pairs join, without a circle,
    the cheapest ones: in a round, each component takes its cheapest pair."""
    order = np.argsort(cost, kind="stable")
    nodes, label = np.unique(np.concatenate([c[x[order]], c[y[order]]]), return_inverse=True)
    a, b = label.reshape(2, -1)
    now, open_, chosen = np.arange(len(nodes)), np.arange(len(order)), [np.zeros(0, np.int64)]
    while True:
        p, q = now[a[open_]], now[b[open_]]
        open_, p, q = open_[p != q], p[p != q], q[p != q]
        if not len(open_):
            return order[np.concatenate(chosen)]
        _, first = np.unique(np.stack([p, q], axis=1).ravel(), return_index=True)
        first = np.unique(first // 2)
        chosen.append(open_[first])
        root, before = np.arange(len(nodes)), None
        while before is None or (root != before).any():
            before = root.copy()
            low = np.minimum(root[p[first]], root[q[first]])
            np.minimum.at(root, p[first], low)
            np.minimum.at(root, q[first], low)
            root = root[root]
        now = root[now]


def met_first(x: np.ndarray, y: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """Which pairs (x, y) of sets have nothing in common in ``before``, a list for each set."""
    keep = np.arange(len(x))
    values, number, count = np.unique(np.concatenate([*before, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    # a bit for each value that two sets have, the most frequent ones first: they settle most pairs
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(values))
    owner = np.repeat(np.arange(len(before)), [len(b) for b in before])
    shared = count[number] > 1
    owner, rank = owner[shared], rank[number[shared]]
    for at in range(0, rank.max(initial=-1) + 1, 512):
        some = (rank >= at) & (rank < at + 512)
        bits = np.zeros((len(before), 512), bool)
        bits[owner[some], rank[some] - at] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        step = 200_000
        left = [k[~(bits[x[k]] & bits[y[k]]).any(axis=1)] for k in (keep[a:a + step] for a in range(0, len(keep), step))]
        keep = np.concatenate([*left, keep[:0]])
        if not len(keep):
            break
    return keep


def similar_pairs(posts: DataFrame, sets: DataFrame, nearest: bool = False) -> DataFrame:
    """``a``, ``b``: sets of different components that share a signature and that sizes and
    sketches let link.  Sets of a signature meet inside tasks, block against block, so only
    pairs that pass become rows, and a hot signature is spread over its pairs of blocks.  Each
    row has the smaller signatures of its set: two sets become a row at the first that they share.
    ``nearest``: of each signature only the closest pairs that join what all its pairs join,
    fewer than it has sets (in a block)."""
    names = ("sig", "p", "q", "part", "sid", "n", "c")
    sizes = posts.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("sid", "sig"), F.col("blocks")).cast("int")
    marks, before = sketches(sets), F.array().cast("array<bigint>")
    if not nearest:
        marks = marks.join(posts.groupBy("sid").agg(F.sort_array(F.collect_set("sig")).alias("sigs")), "sid")   # of one set
        before = F.slice("sigs", F.lit(1), (F.array_position("sigs", F.col("sig")) - 1).cast("int"))
    rows = (posts.join(sizes, "sig").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                    (F.col("own") > F.col("other")).cast("int").alias("part"), "sid", "n", "c")
            .join(marks, "sid").select(*names, "sketch", before.alias("before")))

    def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole groups (sig, p, q) of the sorted rows: many in a table, none cut."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            keys = np.stack([held.column(k).to_numpy() for k in names[:3]])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            if len(cuts):
                yield held.slice(0, int(cuts[-1]) + 1)
                held = held.slice(int(cuts[-1]) + 1)
        if held is not None:
            yield held

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_of(batches):
            sig, p, q, apart, sid, n, c = (part.column(k).to_numpy() for k in names)
            marks, before = part.column("sketch").to_pylist(), part.column("before").combine_chunks()
            cut, before = before.offsets.to_numpy(), before.values.to_numpy()
            first = np.r_[True, (sig[1:] != sig[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            ends = np.r_[np.flatnonzero(first), len(sig)]
            pairs = [small_distances(ends, n, c, np.where(p == q, -1, apart), marks)]
            for lo, hi in zip(ends, ends[1:]):
                # two blocks with rows of one alone have nothing to compare
                if hi - lo > SMALL_GROUP and (p[lo] == q[lo] or 0 < apart[lo:hi].sum() < hi - lo):
                    i, j, differ = distances(n[lo:hi], c[lo:hi], apart[lo:hi], marks[lo:hi])
                    pairs.append(np.stack([lo + i, lo + j, differ]))
            i, j, differ = np.concatenate(pairs, axis=1)
            group = np.searchsorted(ends, i, "right")
            order = np.argsort(group, kind="stable")
            i, j, differ, group = i[order], j[order], differ[order], group[order]
            found = [np.zeros((2, 0), np.int64)]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
            for lo, hi in zip(starts, [*starts[1:], len(group)]):
                x, y = i[lo:hi], j[lo:hi]
                if nearest:
                    once = forest(x, y, differ[lo:hi] / (n[x] + n[y]), c)
                else:
                    rows_, where = np.unique(np.concatenate([x, y]), return_inverse=True)
                    once = met_first(*where.reshape(2, -1), [before[cut[k]:cut[k + 1]] for k in rows_])
                found.append(np.sort(np.stack([sid[x[once]], sid[y[once]]]), axis=0))
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield _longs(a, b, names=("a", "b"))

    ordered = rows.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(rows: DataFrame, a: str, b: str, na: str, nb: str) -> DataFrame:
    close = 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)
    return (rows.filter((F.col(a) != F.col(b)) & close)
            .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())


def set_components(docs: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """``node`` (a sid), ``root`` of every set with a link; ``rows``: the members."""
    posts = materialize(shared_signatures(signature_rows(docs, *token_classes(docs, total))), "postings")
    posts = materialize(without_twins(posts).withColumn("c", F.col("sid")), "signatures")
    texts = rows.select("sid", "text_key").join(posts.select("sid").distinct(), "sid", "left_semi")
    sets = materialize(sets_of(docs, bitmap(texts, "text_key")), "sets")
    roots = before = None
    nearest, turn = False, -1
    while True:
        turn += 1
        # pairs of sets in different components that share a signature
        per = posts.groupBy("sig", "c").agg(F.count(F.lit(1)).cast("double").alias("m"))
        per = per.groupBy("sig").agg(F.sum("m").alias("n"), ((F.pow(F.sum("m"), F.lit(2)) - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs"))
        left, rows_left = per.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
        if not left:
            break
        # hubs go on while they settle a quarter of the pairs; then each signature's nearest
        # pairs join most of what is left, and then all pairs are compared
        last = nearest
        nearest = not last and (turn >= STAR_ROUNDS or left <= 2 * rows_left or (before is not None and left > 0.75 * before))
        before = left
        if last or nearest:
            more = similar_pairs(posts, sets, nearest)
        else:
            # each set meets one hub: that of the most frequent signature it has left, then of any
            # one, as a passage that many texts share may be the most frequent of a group of copies
            hub = F.struct(F.xxhash64("c", F.lit(turn)).alias("o"), "n", "sid", "c") if turn else F.struct("n", "sid", "c")
            met = posts.join(posts.groupBy("sig").agg(F.min(hub).alias("hub")), "sig").filter("c <> hub.c")
            rank = F.xxhash64("sig", F.lit(turn)) if turn else F.col("k")
            met = met.groupBy("sid", "n").agg(F.max_by("hub", F.struct(rank, "sig")).alias("hub"))
            more = _pairs(met.select("sid", "n", F.col("hub.sid").alias("h"), F.col("hub.n").alias("hn")), "sid", "h", "n", "hn")
        # written first: the sets are shuffled when the rows compared are gone from disk
        found = materialize(verified(materialize(more, "pairs"), sets), "links")
        if not found.isEmpty():
            if roots is not None:       # what is known is a star per component already
                found = found.unionByName(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = materialize(components(found), "roots")
        if last:
            break
        if roots is not None:
            posts = posts.drop("c").join(roots.select(F.col("node").alias("sid"), F.col("root").alias("c")), "sid", "left")
            posts = posts.withColumn("c", F.coalesce("c", "sid"))
            # signatures whose sets are all in one component are done with
            apart = posts.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("sig")
            posts = materialize(posts.join(apart, "sig"), "signatures")
    return rows.sparkSession.createDataFrame([], "node bigint, root bigint") if roots is None else roots


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``n``, ``sid``, ``root`` (the group's smallest set) and
    ``component_id`` (its smallest doc_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with temporary_tables(docs.sparkSession):
        rows = materialize(members(docs), "members")
        total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
        if not total:
            out = rows.withColumn("root", F.lit(None).cast("bigint")).withColumn("component_id", F.col("doc_id"))
            return materialize(out, "groups", keep=True)
        roots = materialize(set_components(docs, rows, total), "roots").withColumnRenamed("node", "sid")
        firsts = rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first"))
        named = firsts.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        least = named.groupBy("root").agg(F.min("first").alias("component_id"))
        known = named.select("sid", "root").join(least, "root")
        out = rows.join(known, "sid", "left")
        out = out.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return materialize(out, "groups", keep=True)


def join_report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of every group the row of the
    smallest id stays (one of them, if rows repeat it); rows without words stay."""
    found = groups(docs)
    best = (found.filter("sid IS NOT NULL").groupBy("root")
            .agg(F.min_by(F.struct("doc_id", "text_key"), F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "text_key")).alias("k"))
            .select("k.doc_id", "k.text_key"))
    empty = found.filter("sid IS NULL").select("doc_id", "text_key").distinct()
    keys = best.withColumn("once", F.lit(True)).unionByName(empty.withColumn("once", F.lit(False)))
    keys = keys.select(F.col("doc_id").alias("_nj_id"), F.col("text_key").alias("_nj_key"), F.col("once").alias("_nj_once"))
    marked = docs.withColumn("_nj_text", F.xxhash64("text"))
    marked = marked.join(keys, (F.col("_nj_text") == F.col("_nj_key")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_nj_id")))
    place = F.row_number().over(Window.partitionBy("_nj_key", "_nj_id").orderBy("_nj_once"))
    return marked.withColumn("_nj_place", place).filter("_nj_place = 1 OR NOT _nj_once").select(*docs.columns)


#: DuckDB twin of ``join_report`` (all pairs that share a shingle).
JOIN_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {NGRAM} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {NGRAM} + 2), lambda i: array_to_string(w[i:i + {NGRAM} - 1], ' '))) END) AS s
  FROM d
), sizes AS (
  SELECT d.doc_id, count(s)::BIGINT AS n FROM d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x
)
SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id
"""
