"""Tokenizers by name, for chunk sizes: what counts as a token is the user's choice."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

# A word, or a single sign; and the public pre-token pattern of the byte-level rank files.
_WORDS = re.compile(r"\w+|[^\w\s]")
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Words:
    """Words and single signs; the default, it needs no vocabulary."""

    def count(self, text: str) -> int:
        return len(_WORDS.findall(text))

    def pieces(self, text: str, size: int) -> Iterator[str]:
        """Pieces of `size` tokens each; together they are the text."""
        ends = [m.end() for m in _WORDS.finditer(text)][size - 1 :: size]
        edges = sorted({0, *ends, len(text)})
        return (text[a:b] for a, b in zip(edges, edges[1:]))


class RankFile:
    """A byte-level vocabulary of ranks (base64 token and rank per line), where the library for such files is installed."""

    def __init__(self, path: str, pattern: str = _BYTE_LEVEL):
        try:
            import tiktoken
        except ImportError as missing:
            raise RuntimeError("rank files need the tiktoken library; use 'words'") from missing
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.own = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def encode(self, text: str) -> list[int]:
        return self.own.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids)

    def pieces(self, text: str, size: int) -> Iterator[str]:
        """Pieces of about `size` tokens each, cut between characters; together they are the text."""
        ids, raw, start, done = self.encode(text), text.encode("utf-8", "surrogatepass"), 0, 0
        for at in range(size, len(ids), size):
            done += sum(map(len, self.own.decode_tokens_bytes(ids[at - size : at])))
            end = done
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            if end > start:
                yield raw[start:end].decode("utf-8", "surrogatepass")
                start = end
        if start < len(raw):
            yield raw[start:].decode("utf-8", "surrogatepass")


_MAKERS: dict[str, Callable[..., object]] = {"words": Words, "rank_file": RankFile}


def register(name: str, make: Callable[..., object]) -> None:
    """A tokenizer under a name: make(**options) gives an object with count(text) and pieces(text, size)."""
    _MAKERS[name] = make


@functools.lru_cache(maxsize=8)
def _made(name: str, options: tuple) -> object:
    return _MAKERS[name](**dict(options))


def tokenizer(name: str = "words", **options: str):
    """The tokenizer of that name, made once per process; an unknown name is an error."""
    if name not in _MAKERS:
        raise ValueError(f"unknown tokenizer {name!r}; known are {sorted(_MAKERS)}")
    return _made(name, tuple(sorted(options.items())))
