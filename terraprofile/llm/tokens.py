"""Token ids of whole texts, as the tokenizers library gives them for a vocabulary file.

A byte-level vocabulary whose merges follow from its ranks, which is proved when it is
loaded, is applied by ranks: the same ids in a fraction of the time, without a store of
known words. Everything else (other vocabularies, special strings) goes to the library.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
import types
from functools import cached_property

import numpy as np
import regex
import tiktoken

# the published split of byte-level vocabularies (fixed value)
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
LAST_LATIN = "ɏ"  # up to here the library and regex agree on classes of characters
CACHE_ENTRIES, CACHE_CHARS = 250_000, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Unsafe(Exception):
    """A text in which some space does not stand between two non-space characters."""


class Vocabulary:
    """A tokenizer file with its two ways in: whole texts, and single pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.byte_level = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout")
        )
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        # a special string with a space could lie across two chunks
        self.byte_level &= not any(re.search(r"\s", t) for t in self.specials)
        if self.byte_level:
            self.vocab = model["vocab"]
            self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
            self.model = BPE(vocab=self.vocab, merges=self.merges, cache_capacity=0)
            self.letters = byte_letters()
            self.pattern = regex.compile(PIECES)

    def plain(self, text: str) -> bool:
        """Whether pieces of ``text`` may be cut here instead of in the library."""
        if not text.isascii() and max(text) > LAST_LATIN:
            return False
        for t in self.specials:
            if t in text:
                return False
        return True

    def word_and_marks(self, chunk: str) -> tuple[str, str] | None:
        """A Latin word and the punctuation behind it, which are two pieces; None for other chunks."""
        word = chunk.rstrip(string.punctuation)
        if len(word) + 2 < len(chunk) and not self.plain(chunk):
            return None
        if word.isalpha() and (word.isascii() or max(word) <= LAST_LATIN):
            return word, chunk[len(word) :]
        return None

    def spell(self, piece: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in piece.encode()])

    def ids(self, text: str) -> list[int]:
        """Ids of a text by the library, without added begin or end tokens."""
        if not self.byte_level or not self.plain(text):
            return self.library.encode(text, add_special_tokens=False).ids
        tokenize = self.model.tokenize
        return [t.id for p in self.pattern.findall(text) for t in tokenize(self.spell(p))]


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers.

    ``specials=False`` takes the strings of special tokens inside texts as plain text. The library
    is loaded when a text needs it; a vocabulary by ranks takes a tenth of its memory.
    """

    def __init__(self, path: str, specials: bool = True):
        self.path, self.plain_specials = path, not specials
        vocabulary = Vocabulary(path)
        tokens = vocabulary.library.get_vocab(with_added_tokens=True)
        self.size = max(tokens.values(), default=-1) + 1
        self.special_bytes = {i: t.content.encode() for i, t in vocabulary.library.get_added_tokens_decoder().items()}
        self.specials = vocabulary.specials if specials else []
        self.ranks = self._proved(vocabulary)
        self.ranked = tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=self.ranks, special_tokens={}) if self.ranks else None

    @cached_property
    def library(self):
        library = Vocabulary(self.path).library
        library.encode_special_tokens = self.plain_specials
        return library

    def _proved(self, v: Vocabulary) -> dict[bytes, int] | None:
        """The bytes of the tokens by rank, or None where the merges do not follow from the ranks.

        They do if ids rise with the merges, parts come before what they make, and every token
        encodes to itself: what stands between a token's ends just before its own merge is then
        the pair that this merge joins, so joining whatever ranks lowest takes the same steps.
        """
        if not v.byte_level:
            return None
        made = [v.vocab[a + b] for a, b in v.merges]
        rising = made == sorted(set(made)) and all(max(v.vocab[a], v.vocab[b]) < i for (a, b), i in zip(v.merges, made))
        tokens = {t: i for t, i in v.vocab.items() if t not in v.specials}
        if not rising or len(tokens) != 256 + len(made) or any([x.id for x in v.model.tokenize(t)] != [i] for t, i in tokens.items()):
            return None
        byte = {c: b for b, c in enumerate(v.letters)}
        return {bytes([byte[c] for c in t]): i for t, i in tokens.items()}

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers; null has none."""
        if not text:
            return np.empty(0, np.uint32)
        if self.ranked and not any(t in text for t in self.specials):
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None) -> bytes:
        return self.ids(text).tobytes()

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        out = [b""] * self.size
        if self.ranks:
            tokens = {i: t for t, i in self.ranks.items()}
        else:
            byte = {c: b for b, c in enumerate(byte_letters())}
            tokens = {i: bytes([byte[c] for c in t]) for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        for i, t in (tokens | self.special_bytes).items():
            out[i] = t
        return out


def process_wide(kind: type, *args):
    """One ``kind(*args)`` per Python worker, for all its tasks."""
    held = sys.modules.setdefault("_token_tables", types.ModuleType("_token_tables")).__dict__
    key = f"{kind.__name__} {args}"
    if key not in held:
        held[key] = kind(*args)
    return held[key]
