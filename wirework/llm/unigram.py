"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at
a place of the text; dynamic programming keeps, per place, the best score and the
number of tokens on the best path, and nothing else.  Tie rule of the tokenizer: a
later candidate must score strictly more, and candidates for a place come from the
longest piece to the shortest, so of equal scores the longest last piece wins.  A
character that is no piece is an unknown candidate with the lowest score minus 10
and becomes one byte token for each of its UTF-8 bytes.

The model is the pieces and scores of a SentencePiece file, read as a unigram model
over text whose spaces are replaced by the word mark, one mark in front, cut before
every mark.  Pieces never reach over a cut, so a text's count is the sum over its
words; a line feed that is in no piece is a cut as well.  A task keeps the counts of
words it has met in a table of bounded size (a speed-up; every word is counted).

Scores are summed as doubles, like the tokenizer does.

Defined cases: NULL and empty texts have 0 tokens; texts without any space are one
long word and take time in proportion to their length; repeated rows are counted
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the tokenizer's constants -------------------------------------
MARK = "▁"
UNKNOWN_PENALTY = 10.0
# --- parameters -------------------------------------------------------------------
REMEMBERED_WORDS = 300_000
# ----------------------------------------------------------------------------------


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores in id order, control, unknown and byte pieces included."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, pieces: list[tuple[str, float]], remember: int = REMEMBERED_WORDS):
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.line_cut = not any("\n" in p for p, _ in pieces)
        self.remember = remember
        self.known = _Known(self)

    def word(self, word: str) -> int:
        """Tokens of one uncut stretch of text."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        at = 0   # places up to here have all their candidates
        for end, (size, score) in self.automaton.iter(word):
            end += 1
            while at < end - 1:          # places that no longer match can change
                at += 1
                self._unknown(word, at, best, count)
            start = end - size
            b = best[start]
            if b is not None and (best[end] is None or b + score > best[end]):
                best[end], count[end] = b + score, count[start] + 1
        while at < n:
            at += 1
            self._unknown(word, at, best, count)
        return count[n]

    def _unknown(self, word: str, end: int, best: list, count: list) -> None:
        """The unknown candidate of the character before ``end``, the shortest and
        so the last to be tried."""
        c = word[end - 1]
        if c not in self.single:
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        known, total = self.known, 0
        if self.line_cut and "\n" in text:
            total += text.count("\n")
            # a line feed is an unknown character of one byte and cuts the text
            for line in text.split("\n"):
                total += self._marked(line, known)
            return total
        return self._marked(text, known)

    def _marked(self, line: str, known: _Known) -> int:
        head, *words = line.split(MARK)
        total = known[head] if head else 0
        return total + sum(map(known.__getitem__, [MARK + w for w in words]))


class _Known(dict):
    """Counts of words met, emptied when full."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) >= self.counter.remember:
            self.clear()
        n = self.counter.word(word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``n_tokens`` of the whole text.  ``model_file`` must be
    readable on every executor."""
    pieces_of = vocabulary

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(pieces_of(model_file))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [counter.text(t) for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(count, "doc_id bigint, n_tokens bigint")
