"""Fill-in-middle transformation over a piece table.

A document is a list of descriptors (buffer, start, length in bytes) over two
buffers that are never written: its text and the three sentinels.  Cutting at a code
point splits the descriptor that holds it; an arrangement is a permutation of
descriptors, the sentinels' among them; the output's bytes are the buffers read along
the permuted descriptors, and a digest streams them piece by piece.  To restore a
document, its output is the buffer: it is cut at the sentinels, and the inverse
permutation puts prefix, middle and suffix back in line.

Where a document is cut and how it is arranged (plain, prefix-suffix-middle or
suffix-prefix-middle) follows from a digest of seed and id, in DataFrame functions; so
reruns and lost executors give the same rows.  Only cutting and hashing run in an Arrow
function, a document at a time, without a shuffle.

Sentinels must not be able to arise where two pieces meet: the first character of
each must not stand at a later place of any, and none may be the beginning of another
(``Sentinels`` checks it).  Texts that hold a sentinel stay plain.

Defined cases: a NULL text counts as empty, and empty texts stay plain; a NULL id is
the empty string in the digest; rows that repeat an id get the same draws; characters
are code points, and a text of one gives two empty parts; ``transformed`` replaces the
text column and the columns it adds where the input has columns of these names, all
others are kept whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- parameters ---
SEED = 1
FIM_PERCENT = 90
SPM_PERCENT = 20
# ------------------

#: Bytes looked at together when a code point's byte offset is counted.
STEP = 1 << 16


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(a[0] in b[1:] for a in marks for b in marks):
            raise ValueError("a sentinel must not be empty nor begin with a character that another holds later on")
        if any(a is not b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("no sentinel may be the beginning of another")

    def buffer(self) -> bytes:
        return (self.prefix + self.suffix + self.middle).encode()

    def pieces(self) -> list[Piece]:
        """Descriptors of the three, in the order of ``buffer``."""
        sizes = [len(m.encode()) for m in (self.prefix, self.suffix, self.middle)]
        return [Piece(MARKS, sum(sizes[:k]), size) for k, size in enumerate(sizes)]


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


TEXT, MARKS = 0, 1
#: Arrangements of (prefix, middle, suffix, P, S, M): what stands where in the output.
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)
ARRANGED = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}


# ------------------------------------------------------------------ pieces
def byte_offset(text: memoryview, points: int) -> int:
    """Bytes that the first ``points`` code points of a UTF-8 text take."""
    for at in range(0, len(text), STEP):
        leads = np.flatnonzero((np.frombuffer(text[at:at + STEP], np.uint8) & 0xC0) != 0x80)
        if len(leads) > points:
            return at + int(leads[points])
        points -= len(leads)
    return len(text)


def cut(pieces: list[Piece], offset: int) -> list[Piece]:
    """Split the descriptor that holds byte ``offset`` of the pieces' text; at its ends an
    empty descriptor is split off, so that every cut gives one descriptor more."""
    for k, one in enumerate(pieces):
        if offset <= one.length:
            first = Piece(one.buffer, one.start, offset)
            second = Piece(one.buffer, one.start + offset, one.length - offset)
            return [*pieces[:k], first, second, *pieces[k + 1:]]
        offset -= one.length
    raise ValueError("offset after the end")


def permuted(pieces: list[Piece], order: tuple[int, ...]) -> list[Piece]:
    return [pieces[k] for k in order]


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    back = [0] * len(order)
    for place, k in enumerate(order):
        back[k] = place
    return tuple(back)


def stream(pieces: list[Piece], buffers: tuple[memoryview, ...]) -> Iterator[memoryview]:
    for one in pieces:
        yield buffers[one.buffer][one.start:one.start + one.length]


def digest(pieces: list[Piece], buffers: tuple[memoryview, ...]) -> str:
    h = hashlib.sha256()
    for view in stream(pieces, buffers):
        h.update(view)
    return h.hexdigest()


def arranged(text: memoryview, first: int, second: int, form: str, marks: Sentinels) -> list[Piece]:
    """The output of a text, cut after ``first`` and ``second`` code points, as descriptors."""
    pieces = [Piece(TEXT, 0, len(text))]
    if form == "plain":
        return pieces
    a = byte_offset(text, first)
    pieces = cut(pieces, a)
    pieces = cut(pieces, a + byte_offset(text[a:], second - first))
    return permuted([*pieces, *marks.pieces()], ARRANGED[form])


def restored(output: bytes, form: str, marks: Sentinels) -> list[Piece]:
    """Descriptors over ``output`` that give the text again.

    The output is cut at the sentinels, whose order the form tells; each is found
    as its first occurrence after the one before, since no text between holds any.
    """
    whole = [Piece(TEXT, 0, len(output))]
    if form == "plain":
        return whole
    names = {P: marks.prefix.encode(), S: marks.suffix.encode(), M: marks.middle.encode()}
    pieces, at = [], 0
    for k in ARRANGED[form]:
        if k in names:
            found = output.find(names[k], at)
            if found < 0:
                raise ValueError(f"no {names[k].decode()} in an output of form {form}")
            if pieces:
                pieces.append(Piece(TEXT, at, found - at))     # the part before this sentinel
            pieces.append(Piece(TEXT, found, len(names[k])))
            at = found + len(names[k])
    pieces.append(Piece(TEXT, at, len(output) - at))
    return permuted(pieces, inverse(ARRANGED[form]))[:P]       # prefix, middle, suffix


# ------------------------------------------------------------------ Spark
def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of the digest of seed and id, as numbers."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def plan(id_col: str, text_col: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
         marks: Sentinels = Sentinels()) -> Column:
    """struct<n, form, first, second>: length in code points, form, and both cuts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.length(text).cast("bigint")
    h1, h2, h3, h4 = draws(id_col, seed)
    one, two = F.pmod(h1, n + 1), F.pmod(h2, n + 1)
    held = text.contains(marks.prefix) | text.contains(marks.suffix) | text.contains(marks.middle)
    form = (F.when((n == 0) | (F.pmod(h3, F.lit(100)) >= fim_percent) | held, "plain")
            .when(F.pmod(h4, F.lit(100)) < spm_percent, "spm").otherwise("psm"))
    return F.struct(n.alias("n"), form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))


def _views(texts: pa.Array) -> Iterator[memoryview]:
    for one in texts:
        yield memoryview(one.as_buffer()) if one.is_valid else memoryview(b"")


def _outputs(texts: pa.Array, plans: pa.Array, marks: Sentinels) -> Iterator[tuple[list[Piece], tuple, str]]:
    buffer = memoryview(marks.buffer())
    columns = (plans.field(name).to_pylist() for name in ("first", "second", "form"))
    for text, first, second, form in zip(_views(texts), *columns):
        yield arranged(text, first, second, form, marks), (text, buffer), form


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: Sentinels = Sentinels(),
                form_col: str = "fim_form", **parameters) -> DataFrame:
    """``docs`` with the text replaced by its output, and its form in ``form_col``."""

    @F.arrow_udf("string")
    def output(texts: pa.Array, plans: pa.Array) -> pa.Array:
        return pa.array([b"".join(stream(p, b)) for p, b, _ in _outputs(texts, plans, marks)], pa.binary()).cast(pa.string())

    how = plan(id_col, text_col, marks=marks, **parameters)
    return docs.withColumns({text_col: output(F.col(text_col).cast("string"), how), form_col: how["form"]})


def untransformed(docs: DataFrame, text_col: str = "text", marks: Sentinels = Sentinels(), form_col: str = "fim_form") -> DataFrame:
    """``transformed`` undone, from outputs and forms alone; a NULL text came out empty."""

    @F.arrow_udf("string")
    def text(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        back = []
        for view, form in zip(_views(outputs), forms.to_pylist()):
            back.append(b"".join(stream(restored(bytes(view), form, marks), (view,))))
        return pa.array(back, pa.binary()).cast(pa.string())

    return docs.withColumn(text_col, text(F.col(text_col), F.col(form_col)))


def fim_report(docs: DataFrame, marks: Sentinels = Sentinels(), **parameters) -> DataFrame:
    """Per document: length, form, lengths of prefix and middle (NULL if plain), the
    digest of the output and that of the text restored from output and form."""

    @F.arrow_udf("struct<output_sha256:string,restored_sha256:string>")
    def digests(texts: pa.Array, plans: pa.Array) -> pa.Array:
        rows = []
        for pieces, buffers, form in _outputs(texts, plans, marks):
            output = b"".join(stream(pieces, buffers))
            rows.append((digest(pieces, buffers), digest(restored(output, form, marks), (memoryview(output),))))
        columns = zip(*rows) if rows else ((), ())
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["output_sha256", "restored_sha256"])

    rows = docs.select("doc_id", "text", plan("doc_id", "text", marks=marks, **parameters).alias("how"))
    rows = rows.select("doc_id", "how", digests(F.col("text").cast("string"), F.col("how")).alias("sums"))
    cut_up = F.col("how.form") != "plain"
    return rows.select("doc_id", "how.n", "how.form", F.when(cut_up, F.col("how.first")).alias("prefix_chars"),
                       F.when(cut_up, F.col("how.second") - F.col("how.first")).alias("middle_chars"), "sums.*")


#: DuckDB twin of ``fim_report``; the text is restored from the output here too.
FIM_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
         ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p
), f AS (
  SELECT *, strpos(output, '<P>') AS ip, strpos(output, '<S>') AS is_, strpos(output, '<M>') AS im, length(output) AS l FROM o
), r AS (
  SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substring(output, 4, is_ - 4) || substring(output, im + 3, l - im - 2) || substring(output, is_ + 3, im - is_ - 3)
    ELSE substring(output, ip + 3, im - ip - 3) || substring(output, im + 3, l - im - 2) || substring(output, 4, ip - 4) END AS back FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars, sha256(output) AS output_sha256, sha256(back) AS restored_sha256 FROM r
"""
