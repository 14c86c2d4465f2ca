"""Byte-pair token ids from a public vocabulary file, with a cache of pieces."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

#: Where the vocabulary files are; a parameter of every operator that takes token ids.
TOKENIZER_DIR = "/opt/tokenizers"
#: Splits text before merging: contractions, letters, digits, other signs, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Spaced(dict):
    """Ids of a space and a piece, by the piece; starts afresh when it holds ``limit`` pieces, so memory is bounded."""

    limit, longest = 800_000, 48

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        x = array("i", self.encode(" " + piece)).tobytes()
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = x
        return x


class Bpe:
    """Encodes whole texts to int32 bytes, piece by piece where that can't matter.

    A space starts a new unit of PATTERN unless another space comes before it, so
    a text without two spaces in a row is the concatenation of its pieces, each
    with the space before it. Other texts are encoded at once.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = len(ranks)
        self.spaced = _Spaced(self.encoding.encode_ordinary)

    def ids(self, text: str | None) -> bytes:
        """int32 ids of a whole text, as bytes; null has none. Lone surrogates are replaced, as tiktoken does."""
        if not text:
            return b""
        if "  " in text:
            return array("i", self.encoding.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        return array("i", self.encoding.encode_ordinary(first)).tobytes() + b"".join(map(self.spaced.__getitem__, rest))


@lru_cache(maxsize=4)
def bpe(name: str, directory: str = TOKENIZER_DIR) -> Bpe:
    """The tokenizer of this worker process."""
    return Bpe(f"{directory}/{name}.tiktoken")
