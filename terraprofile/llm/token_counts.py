"""Token counts by prefix dynamic programming.

For every prefix of a piece exactly one token can come last: the one that ends there,
keeps the best encoding before it, and that the merges do not join differently with its
neighbour. Following it gives the exact count at every prefix in one pass. A text's
prefixes follow from its words', so one stored array answers how many tokens any cut
of the text has, whether it fits a budget, and where to cut for one, without encoding again.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraprofile.llm.tokens import CACHE_CHARS, CACHE_ENTRIES, SAFE_SPACE, Unsafe, Vocabulary, process_wide

DEFAULT_FILE = "byte_bpe_50k.json"
PAIR_ENTRIES = 1_000_000
BATCH_CHARS = 4_000_000
RUN = re.compile(r"\s\s")


class PrefixCounter:
    """Exact token counts at every character prefix of a text."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        if not self.vocabulary.byte_level:
            raise ValueError("prefix counts need a byte-level pair vocabulary without normalizer")
        v = self.vocabulary
        self.names = {i: t for t, i in v.vocab.items()}
        self.ends_here = ahocorasick.Automaton()
        for token, i in v.vocab.items():
            self.ends_here.add_word(token, (i, len(token)))
        self.ends_here.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, list[int]] = {}

    def _follows(self, key: int, left: int, token: int) -> bool:
        """Whether ``token`` may follow ``left`` (-1 for the start) in an encoding."""
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        text = (self.names[left] if left >= 0 else "") + self.names[token]
        known = [t.id for t in self.vocabulary.model.tokenize(text)] == ([left, token] if left >= 0 else [token])
        self.pairs[key] = known
        return known

    def piece(self, piece: str) -> list[int]:
        """Counts at every character prefix of one piece, each taken as a piece itself."""
        s = self.vocabulary.spell(piece) if not piece.isascii() or piece[0] == " " or not piece.isalnum() else piece
        n, pairs = len(s), self.pairs
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, size) in self.ends_here.iter(s):
            end += 1
            if not count[end]:
                start = end - size
                left = last[start]
                key = (left << 32) + token
                known = pairs.get(key)
                if known is None:
                    known = self._follows(key, left, token)
                if known:
                    last[end] = token
                    count[end] = count[start] + 1
        if n == len(piece):
            return count[1:]
        ends, at = [], 0
        for c in piece:
            at += len(c.encode())
            ends.append(count[at])
        return ends

    def _cut(self, text: str) -> list[tuple[str, bool]]:
        """Pieces of a text in order; True marks a special string."""
        v = self.vocabulary
        for t in v.specials:
            if t in text:
                head, tail = text.split(t, 1)
                return [*self._cut(head), (t, True), *self._cut(tail)]
        if v.plain(text):
            return [(p, False) for p in v.pattern.findall(text)]
        return [(text[a:b], False) for _, (a, b) in v.library.pre_tokenizer.pre_tokenize_str(text)]

    def direct(self, text: str) -> np.ndarray:
        """Counts at every prefix of a text that starts at a piece's start."""
        out, done, at, before = np.empty(len(text), np.int32), 0, 0, ("", 0, 0)
        for piece, special in self._cut(text):
            own = [0] * (len(piece) - 1) + [1] if special else self.piece(piece)
            out[at : at + len(piece)] = own
            out[at : at + len(piece)] += done
            # cut inside a special string or contraction (an apostrophe before a letter; a run of
            # marks that begins with one splits like its prefixes), or behind white space, the text splits
            # otherwise: only the piece before is affected, and the two are encoded again
            spaces_before = before[0][-1:].isspace()
            if special or piece[0] == "'" and piece[1:2].isalpha():
                again = range(1, len(piece))
            elif piece[0].isspace() and spaces_before:
                again = range(1, 2) if not piece.isspace() else range(1, len(piece) + 1)
            else:
                again = range(0)
            for k in again:
                out[at + k - 1] = before[2] + len(self.vocabulary.library.encode(before[0] + piece[:k], add_special_tokens=False).ids)
            before = ("" if special else piece, at, done)
            done += own[-1]
            if special:
                before = ("", at, done)
            at += len(piece)
        return out

    def _chunk(self, chunk: str) -> bytes:
        found = self.chunks.get(chunk)
        if found is None:
            found = self.older.get(chunk) or self._new_chunk(chunk)
            if len(chunk) <= CACHE_CHARS:
                if len(self.chunks) >= CACHE_ENTRIES:
                    self.older, self.chunks = self.chunks, {}
                self.chunks[chunk] = found
        return found

    def _new_chunk(self, chunk: str) -> bytes:
        """A chunk's counts from its pieces' where every cut of it splits like the whole."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Unsafe
        v = self.vocabulary
        pair = v.word_and_marks(chunk)
        if pair:
            word, marks = pair
            if not marks:
                return array("i", self.piece(" " + word)).tobytes()
            first, tails = word, [marks]
        elif not v.plain(chunk) or "'" in chunk or RUN.search(chunk):
            return self.direct(" " + chunk).tobytes()
        else:
            first, *tails = v.pattern.findall(" " + chunk)
            if not tails:
                return array("i", self.piece(first)).tobytes()
            first = first[1:]
        out = array("i")
        out.frombytes(self._chunk(first))
        for p in tails:
            own = self.tails.get(p)
            if own is None:
                if len(self.tails) >= CACHE_ENTRIES // 4:
                    self.tails.clear()
                own = self.piece(p)
                if len(p) <= CACHE_CHARS:
                    self.tails[p] = own
            done = out[-1]
            out.extend([done + c for c in own])
        return out.tobytes()

    def prefixes(self, text: str | None) -> np.ndarray:
        """Element i: tokens of the first i + 1 characters; empty for null and ''."""
        if not text:
            return np.empty(0, np.int32)
        first, *rest = text.split(" ")
        try:
            if first == "" or first[-1].isspace():
                raise Unsafe
            parts = [self.direct(first).tobytes(), *map(self._chunk, rest)]
        except Unsafe:
            first, *rest = SAFE_SPACE.split(text)
            parts = [self.direct(first).tobytes(), *(self.direct(" " + c).tobytes() for c in rest)]
        counts = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        totals = counts[np.cumsum(sizes) - 1]
        return counts + np.repeat((np.cumsum(totals) - totals).astype(np.int32), sizes)


def prefix_token_counts(docs: DataFrame, text_col: str = "text", out_col: str = "prefix_tokens", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with an array column: the exact token count of every character prefix of the text.

    Null and empty texts give an empty array. All columns and rows stay; a column named like the
    result is replaced.
    """
    path = tokenizer or public_tokenizers.path(DEFAULT_FILE)
    base = docs.drop(out_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    at = base.columns.index(text_col)

    def run(batches):
        counter = process_wide(PrefixCounter, path)
        for batch in batches:
            texts, start = batch.column(at), 0
            while start < len(texts):
                rows, size, end = [], 0, start
                while end < len(texts) and (size < BATCH_CHARS or end == start):
                    rows.append(counter.prefixes(texts[end].as_py()))
                    size += len(rows[-1])
                    end += 1
                offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                counts = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows), pa.int32()))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, counts], names=[*part.schema.names, out_col])
                start = end

    return base.mapInArrow(run, schema)


def n_tokens(prefixes: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(prefixes, F.lit(-1)), F.lit(0)).cast("long")


def tokens_of_prefix(prefixes: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, or of all if there are fewer."""
    return F.when(n_chars <= 0, F.lit(0)).otherwise(F.coalesce(F.get(prefixes, F.least(n_chars, F.size(prefixes)).cast("int") - 1), F.lit(0)))


def longest_prefix(prefixes: Column, limit: int) -> Column:
    """Characters of the longest prefix with at most ``limit`` tokens."""
    fits = F.transform(prefixes, lambda n, i: F.when(n <= limit, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))
