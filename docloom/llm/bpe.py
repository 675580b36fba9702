"""Byte-level BPE with a public vocabulary, run through a sentencepiece model written by hand.

The vocabulary is a rank file (base64 token, rank per line). From it a sentencepiece BPE model is serialised directly:
every token is written with one printable character per byte, its score is its negative rank, and normalisation is the
identity. sentencepiece then merges the adjacent pair of highest score first, the leftmost on ties, which is the rank
order of the byte-level encoder; ids equal ranks. Texts are first cut into pre-tokens by the public pattern and each
distinct pre-token is encoded once per worker.
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
from collections.abc import Iterable

import regex
import sentencepiece

# The public pre-token pattern of byte_bpe_50k, and the same restricted to ASCII texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Distinct pre-tokens a worker keeps; beyond it the memory is emptied and filled anew, results do not change.
CACHE_TOKENS = 400_000

#: Texts over this many characters are worked on in independent pieces, so that memory holds the pre-tokens of one.
LONG_TEXT = 1 << 20


def byte_alphabet() -> list[str]:
    """One printable character per byte: printable Latin-1 stands for itself, the others are shifted past U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = itertools.count(0x100)
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


ALPHABET = byte_alphabet()
TO_CHARS = {b: c for b, c in enumerate(ALPHABET)}
TO_BYTE = {c: b for b, c in enumerate(ALPHABET)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, ordered by rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not contiguous")
    return [ranks[i] for i in range(len(ranks))]


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the id after the last is its unknown piece."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate(TO_CHARS).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))
    trainer = _flag(3, 2) + _flag(4, len(tokens) + 1) + _flag(40, len(tokens))
    out += _field(2, trainer + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43)))
    out += _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return bytes(out)


def model_from_file(path: str = DEFAULT_VOCAB) -> bytes:
    return sentencepiece_model(load_ranks(path))


_ASCII = re.compile(ASCII_PATTERN).findall
_ANY = regex.compile(PATTERN).findall


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text; their concatenation is the text."""
    return _ASCII(text) if text.isascii() else _ANY(text)


class ByteBpe:
    """Encoder of one worker. encode_batch(texts) -> per text its ids; count_batch -> per text the number of ids."""

    _own: dict[int, "ByteBpe"] = {}

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.ids: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}

    @classmethod
    def of(cls, model: bytes) -> "ByteBpe":
        """The encoder of this process, made once per model."""
        key = hash(model)
        if key not in cls._own:
            cls._own[key] = cls(model)
        return cls._own[key]

    def _learn(self, parts: list[list[str]]) -> None:
        if len(self.ids) > CACHE_TOKENS:
            self.ids.clear()
            self.sizes.clear()
        new = [t for t in set().union(*parts) if t not in self.ids]
        if new:
            mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(TO_CHARS) for t in new]
            for token, ids in zip(new, self.processor.encode(mapped, num_threads=1)):
                self.ids[token] = ids
                self.sizes[token] = len(ids)

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[list[int], list[int]]:
        """(all ids in one list, number of ids per text); null and empty texts have none."""
        texts = list(texts)
        if any(t and len(t) > LONG_TEXT for t in texts):
            each = [self._encode_long(t) if t and len(t) > LONG_TEXT else self.encode_batch([t])[0] for t in texts]
            return list(itertools.chain.from_iterable(each)), list(map(len, each))
        parts = [pretokens(t) if t else [] for t in texts]
        self._learn(parts)
        get = self.ids.__getitem__
        flat = list(itertools.chain.from_iterable(map(get, itertools.chain.from_iterable(parts))))
        size = self.sizes.__getitem__
        return flat, [sum(map(size, p)) for p in parts]

    def _encode_long(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in independent_pieces(text, LONG_TEXT // 2):
            parts = [pretokens(piece)]
            self._learn(parts)
            out.extend(itertools.chain.from_iterable(map(self.ids.__getitem__, parts[0])))
        return out

    def count_batch(self, texts: Iterable[str | None]) -> list[int]:
        texts = list(texts)
        if any(t and len(t) > LONG_TEXT for t in texts):
            return [len(self._encode_long(t)) if t and len(t) > LONG_TEXT else self.count_batch([t])[0] for t in texts]
        parts = [pretokens(t) if t else [] for t in texts]
        self._learn(parts)
        size = self.sizes.__getitem__
        return [sum(map(size, p)) for p in parts]

    def decode(self, ids: Iterable[int]) -> str:
        """Inverse of encoding: pieces, their bytes, the text."""
        chars = "".join(self.processor.id_to_piece(list(ids))) if ids else ""
        return bytes(TO_BYTE[c] for c in chars).decode("utf-8", "surrogatepass")


# Between a character that is not white space and one that is, every rule of the pattern ends: no rule takes a white
# space character after another kind, and only runs of white space look ahead. The same holds between a letter and a
# digit, either way round. Such a place is an independent boundary.
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def independent_pieces(text: str, size: int) -> list[str]:
    """Cut a text into pieces of about `size` characters, only where the tokens left and right are independent.

    The pieces' tokens, in order, are the text's tokens. A stretch without any such place stays whole.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out
