"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts a text into chunks wherever the content says so,
so passages that documents share are cut at the same places.  A chunk is encoded
once; a task keeps the encodings of chunks it has met in a table of bounded size
and reuses them in later documents.

A cut may fall anywhere, also within a word, so the ends of a chunk's encoding need
not be those of the text.  Joins are repaired: the stretch between the last sure
boundary before a cut and the first one behind it is encoded anew, and the stretch
grows chunk by chunk until both ends are sure.  Sure is a place where white space
follows something else: the tokenizer's pattern never reaches over it, and matching
begins anew there, so the encodings of both sides agree exactly with that of the
whole text.

Byte-level BPE: the vocabulary and merges are read from a tokenizers file; merges
must stand in id order, so that the lowest id is the first merge.  Strings of added
tokens in a text become their ids, as in the tokenizers library.

Defined cases: NULL is an empty text (no tokens; digests of nothing); a text without
white space is one stretch; repeated rows are encoded each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the byte-level pattern ------------------------------------------
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --- parameters ----------------------------------------------------------------------
CHUNK_BITS = 11                       # a cut every 2048 bytes on average
LEAST_CHUNK = 512
REUSE_BYTES = 32 * 1024 * 1024        # of chunk texts that a task remembers
# --------------------------------------------------------------------------------------

_SURE = re.compile(r"(?<=\S)[ \t\n\r]")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes
    stand for themselves, the others for letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + k)] = b
    return out


def chunk_cuts(data: bytes) -> list[int]:
    """Places (at character starts) where the rolling hash cuts ``data``."""
    if len(data) < 2 * LEAST_CHUNK:
        return []
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    power = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8):
            h = h[:-step] * power + h[step:]
            power = power * power
        h *= np.uint64(0xD6E8FEB86659FD93)
    found = np.flatnonzero((h >> np.uint64(64 - CHUNK_BITS)) == 0) + 16
    out, last = [], 0
    for p in found.tolist():
        while p < len(data) and data[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= LEAST_CHUNK and p < len(data):
            out.append(p)
            last = p
    return out


class Codec:
    """Encodes and decodes texts with a byte-level BPE tokenizer file."""

    def __init__(self, path: str, reuse_bytes: int = REUSE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(ids, ids[1:])):
            raise ValueError("merges don't stand in id order")
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added_re = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        size = max([*ranks.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in ranks.items():
            self.bytes_of[i] = t
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.decimal = [str(i) for i in range(size)]
        self.reuse_bytes, self.used = reuse_bytes, 0
        self.chunks: dict[bytes, tuple[str, list[int] | None, str]] = {}
        self.reused = self.encoded = 0

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.added_re is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.added_re.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

    def _chunk(self, data: bytes) -> tuple[str, list[int] | None, str]:
        """(text before the first sure place, tokens up to the last one, the rest);
        no tokens if there is none."""
        known = self.chunks.get(data)
        if known is not None:
            self.reused += 1
            return known
        text = data.decode()
        first = _SURE.search(text)
        if first is None:
            entry = text, None, ""
        else:
            last, back = first.start(), 64
            while back < 2 * len(text):
                ends = [m.start() for m in _SURE.finditer(text, max(last, len(text) - back))]
                if ends:
                    last = ends[-1]
                    break
                back *= 4
            entry = text[:first.start()], self.bpe.encode_ordinary(text[first.start():last]), text[last:]
        self.encoded += 1
        if self.used > self.reuse_bytes:
            self.chunks.clear()
            self.used = 0
        self.chunks[data] = entry
        # a token is a list entry of 8 bytes; texts are about 3 bytes a token
        self.used += 4 * len(data)
        return entry

    def _plain(self, text: str) -> list[int]:
        data = text.encode()
        cuts = chunk_cuts(data)
        if not cuts:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        seam: list[str] = []       # text since the last sure place
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            head, inner, tail = self._chunk(data[a:b])
            seam.append(head)
            if inner is not None:
                out += self.bpe.encode_ordinary("".join(seam))
                out += inner
                seam = [tail]
        return out + self.bpe.encode_ordinary("".join(seam))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


def _rows(docs: DataFrame, id_col: str, text_col: str, more: Sequence[str] = ()) -> DataFrame:
    return docs.select(*more, F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``ids`` (array of int)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(tokenizer_file)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [codec.encode(t) for t in part["text"]]})

    return _rows(docs, id_col, text_col).mapInPandas(run, "doc_id bigint, ids array<int>")


def training_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                    order: Sequence[str] = ()) -> DataFrame:
    """``encoding_report`` with the ids themselves (array of int), after the bigint
    columns ``order`` of ``docs`` as they are."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(tokenizer_file)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                ids = [codec.encode(t) for t in part["text"]]
                yield pd.DataFrame({c: part[c] for c in order} | {
                    "doc_id": part["doc_id"], "n_tokens": [len(i) for i in ids], "ids": [np.array(i, np.int32) for i in ids],
                    "ids_sha256": [codec.digest(i) for i in ids],
                    "decoded_sha256": [hashlib.sha256(codec.decode(i).encode()).hexdigest() for i in ids]})

    rows = _rows(docs, id_col, text_col, order)
    return rows.mapInPandas(run, "".join(f"{c} bigint, " for c in order)
                            + "doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode_documents(tokens: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per row of ``encode_documents``: ``doc_id``, ``text``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(tokenizer_file)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [codec.decode(i) for i in b["ids"]]})

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, text string")


def encoding_report(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens and digests of the ids and of the decoded text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(tokenizer_file)
        for b in batches:
            out = []
            for t in b["text"]:
                ids = codec.encode(t)
                out.append((len(ids), codec.digest(ids), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
            n, i, d = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": i, "decoded_sha256": d})

    return _rows(docs, id_col, text_col).mapInPandas(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
