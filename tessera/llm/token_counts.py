"""Operator 8: exact token count at every prefix of a text, by dynamic programming over the vocabulary's pieces.

``prefix_counts`` stores, for each text, the change of the exact token count from one character to the next, so that
the count at any cut, the longest cut within a budget and the total follow from running sums, without encoding again.

Method. For byte-pair encodings with ranked merges, the encoding of a prefix ends in exactly one piece ``t`` such
that the text before it is encoded by its own prefix solution ending in ``s``, and ``s`` followed by ``t`` stays as
these two pieces when encoded alone. Hence ``count[i] = count[i - len(t)] + 1``. Pieces never run from a letter into a
following space mark, so the program restarts at each word and words that come again are looked up. Characters
outside the vocabulary count as their UTF-8 bytes (byte fallback).

Defined cases: a null or empty text has no characters and 0 tokens. Rows are kept one for one, repeated ids too; the
input's other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SPACES = " " + MARK
SEGMENT = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
#: Words kept for lookup in a worker; the store is emptied when it is full, which changes no result.
STORE = 450_000
#: Longer words are computed each time and not kept.
STORE_CHARS = 48


class PrefixCounter(dict):
    """Word -> bytes of int8: change of the token count at each character of the word.

    A key without a space stands for that word after one space, unless it begins with a line feed, which no piece
    holds, so that a word may be cut before it; other keys are runs as they are in the text.
    """

    def __init__(self, model: str):
        import sentencepiece
        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
                      if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.known: dict[str, tuple[str, int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: For each piece of several characters that encoding can give: the two parts merged last.
        self.parts: dict[str, tuple[str, str]] = {}
        for piece in self.score:
            if len(piece) > 1 and (last := self.last_merge(piece)):
                self.parts[piece] = last
        #: Sizes of the pieces that end in these two characters.
        sizes: dict[str, set[int]] = {}
        for piece in self.parts:
            sizes.setdefault(piece[-2:], set()).add(len(piece))
        self.line_end = " \n" if not any("\n" in piece for piece in self.score) else "\n"
        self.sizes = {k: tuple(sorted(v)) for k, v in sizes.items()}

    def last_merge(self, text: str) -> tuple[str, str] | None:
        """Merge the adjacent pair of best score, the leftmost of equals, until one piece is left; its two parts."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -1e30) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -1e30:
                return None
            at = scores.index(best)
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return None

    def stays(self, left: str, right: str) -> bool:
        """Whether ``left + right`` is encoded as these two pieces.

        Merges run from high scores to low. Undoing them from the last one, no pair of neighbours across the border
        may have a merge that would have come before the one just undone.
        """
        limit, equal_counts = -1e31, False
        while True:
            across = self.score.get(left + right)
            if across is not None and (across > limit or equal_counts and across == limit):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # equal scores are one piece, whose left copy is made first, so the right copy is undone first
            if b is None or a is not None and self.score[left] < self.score[right]:
                limit, equal_counts, left = self.score[left], False, a[1]
            else:
                limit, equal_counts, right = self.score[right], True, b[0]

    def solve(self, word: str) -> list[int]:
        """Token count at each prefix of one word (spaces as marks). Beginnings that words share are looked up."""
        parts, score, sizes, known, pairs = self.parts, self.score, self.sizes, self.known, self.pairs
        if len(known) > STORE:
            known.clear()
        if len(pairs) > STORE:
            pairs.clear()
        states = [("", 0)]
        for end in range(1, len(word) + 1):
            start = word[:end] if end <= STORE_CHARS else None
            state = known.get(start)
            if state is None:
                piece = word[end - 1]
                last, count = states[-1]
                pair = last + "\0" + piece
                stays = pairs.get(pair)
                if stays is None:
                    stays = pairs[pair] = end == 1 or self.stays(last, piece)
                if stays:
                    state = piece, count + (1 if piece in score else len(piece.encode()))
                else:
                    for size in sizes.get(word[end - 2:end], ()):
                        if size > end:
                            break
                        piece = word[end - size:end]
                        if piece not in parts:
                            continue
                        last, count = states[end - size]
                        if last:
                            pair = last + "\0" + piece
                            stays = pairs.get(pair)
                            if stays is None:
                                stays = pairs[pair] = self.stays(last, piece)
                            if not stays:
                                continue
                        state = piece, count + 1
                        break
                if start is not None:
                    known[start] = state
            states.append(state)
        return [count for _, count in states]

    def __missing__(self, word: str) -> bytes:
        count = self.solve(word.replace(" ", MARK) if " " in word else word if word[0] == "\n" else MARK + word)
        steps = bytes((b - a) & 255 for a, b in zip(count, count[1:]))
        if len(word) <= STORE_CHARS:
            if len(self) >= STORE:
                self.clear()
            self[word] = steps
        return steps

    def steps(self, text: str) -> bytes:
        """int8 per character of ``text``; running sums give the count at each prefix."""
        if not text:
            return b""
        if "  " in text or MARK in text or text[0] in " \n" or text[-1] == " " or " \n" in text:
            words = [w[1:] if w[0] in SPACES and len(w) > 1 and w[1] not in SPACES + "\n" else w.replace(MARK, " ")
                     for w in SEGMENT.findall(text)]
            first = SEGMENT.match(text).group()
        else:
            words = text.replace("\n", self.line_end).split(" ")
            first = words[0]
        count = self.solve(MARK + first.replace(" ", MARK))  # the library puts one mark before a text
        count[1] = 0
        head = bytes((b - a) & 255 for a, b in zip(count[1:], count[2:]))
        return head + b"".join(map(self.__getitem__, words[1:]))


@lru_cache(1)
def counter_of(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def prefix_counts(df: DataFrame, model: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_bytes, steps (binary, int8 per character; see module)."""
    cols = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array([counter.steps(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "steps"])

    kind = cols.schema["doc_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"doc_id {kind}, n_bytes long, steps binary")


def token_budget(counts: DataFrame, limit: int) -> DataFrame:
    """Answers from stored prefixes: n_tokens, over_limit, fit_chars (longest prefix with at most ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, fit = [], []
            for steps in b.column(2).to_pylist():
                sums = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
                total.append(int(sums[-1]) if len(sums) else 0)
                within = np.flatnonzero(sums <= limit)
                fit.append(int(within[-1]) + 1 if len(within) else 0)
            n = pa.array(total, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), n, pa.array([t > limit for t in total], pa.bool_()),
                 pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.select("doc_id", "n_bytes", "steps").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
