"""Problem 7: oversized items cut at natural boundaries, by agglomerative merging of atomic segments."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bpe import DEFAULT_VOCAB, ByteBpe, model_from_file
from docloom.plans.runtime import spread, table, type_of

LIMIT, OVERLAP = 400, 40

#: Tokens of its own that a piece may have at least, however much its neighbours' joining adds.
LEAST_ROOM = 8

_STRETCH = regex.compile(r"[\r\n]+|(?<=[.!?])\s+")

# Boundary kinds from strong to weak; the match's end is the place of the cut.
_KINDS = (
    (5, regex.compile(r"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)\s*")),
    (4, regex.compile(r"(?:\r?\n|\r)")),
    (3, regex.compile(r"[.!?](?=\s)")),
    (2, regex.compile(r"[;:](?=\s)")),
    (1, regex.compile(r",(?=\s)")),
    (0, regex.compile(r"(?<=\S)(?=\s)")),
)
_NATURAL = 3


def forced(text: str, limit: int, count: Callable[[list[str]], list[int]]) -> bool:
    """Whether some stretch of more than `limit` tokens has neither a line break nor a sentence end inside."""
    return max(count(_STRETCH.split(text)), default=0) > limit


def _pieces(part: str, pattern: regex.Pattern) -> list[str]:
    cuts = [m.end() for m in pattern.finditer(part) if 0 < m.end() < len(part)]
    return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])] if part else []


def _natural(text: str) -> list[tuple[str, int]]:
    """(segment, strength of the boundary after it): paragraphs, lines and sentences."""
    out = [(text, 6)]
    for strength, pattern in _KINDS[: 6 - _NATURAL]:
        out = [x for part, after in out for own in (_pieces(part, pattern),) for x in [*((p, strength) for p in own[:-1]), *((p, after) for p in own[-1:])]]
    return out


def _atoms(text: str, room: int, count: Callable[[list[str]], list[int]]) -> list[tuple[str, int, int]]:
    """(segment, tokens, strength of the boundary after it): lines and sentences, cut finer only where they exceed room."""
    whole = _natural(text)
    out: list[tuple[str, int, int]] = []
    for (segment, strong), tokens in zip(whole, count([s for s, _ in whole])):
        todo = [(segment, tokens, strong, 6 - _NATURAL)]
        while todo:
            part, n, after, level = todo.pop()
            if n <= room or len(part) == 1 and level == len(_KINDS):  # a character with more tokens than fit is beyond cutting
                out.append((part, n, after))
                continue
            if level == len(_KINDS):
                own, strength = [part[: len(part) // 2], part[len(part) // 2 :]], -1  # no white space: in halves until it fits
            else:
                strength, pattern = _KINDS[level]
                own, level = _pieces(part, pattern), level + 1
            sizes = [n] if len(own) == 1 else count(own)
            todo += reversed([(p, k, after if i == len(own) - 1 else strength, level) for i, (p, k) in enumerate(zip(own, sizes))])
    return out


def _merge(atoms: list[tuple[str, int, int]], room: int) -> list[tuple[int, int]]:
    """Ranges of atoms: adjacent pairs in a heap, the weakest boundary first, while the combined tokens fit into room."""
    n = len(atoms)
    size = [a[1] for a in atoms]
    after, end, before, alive = [*range(1, n), -1], [*range(1, n + 1)], [-1, *range(n - 1)], [True] * n
    heap = [(atoms[i][2], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, both, a, b = heapq.heappop(heap)
        if not alive[a] or not alive[b] or after[a] != b or size[a] + size[b] != both or both > room:
            continue
        size[a], end[a], after[a], alive[b] = both, end[b], after[b], False
        if after[a] >= 0:
            before[after[a]] = a
            heapq.heappush(heap, (atoms[end[a] - 1][2], size[a] + size[after[a]], a, after[a]))
        if before[a] >= 0:
            p = before[a]
            heapq.heappush(heap, (atoms[end[p] - 1][2], size[p] + size[a], p, a))
    return [(i, end[i]) for i in range(n) if alive[i]]


def _tail(text: str, tokens: int, encoder: ByteBpe) -> str:
    """The text of the last `tokens` tokens, or of a few more where those would begin within a character."""
    ids, _ = encoder.encode_batch([text])
    raw = text.encode("utf-8", "surrogatepass")
    for n in range(tokens, len(ids)):
        size = sum(len(p) for p in encoder.processor.id_to_piece(ids[-n:]))
        if raw[-size] & 0xC0 != 0x80:
            return raw[-size:].decode("utf-8", "surrogatepass")
    return text


def split_text(text: str, encoder: ByteBpe, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[str, int, int, int, bool]], bool]:
    """([(piece, its tokens, characters shared with the piece before, start of the piece in the text, cut naturally before)],
    whether a cut within a natural stretch is forced).

    Every piece has at most `limit` tokens; the pieces without their shared beginnings are the text. A piece of fewer than
    `overlap` tokens is shared as a whole.
    """
    room, strain = limit - overlap, None
    while True:
        atoms = _atoms(text, room, encoder.count_batch)
        if strain is None:  # runs of atoms between natural boundaries; only those that may exceed the limit are measured
            strain, run, size = False, [], 0
            for part, _, after in atoms:
                run.append(part)
                size += len(part)
                if after >= _NATURAL:
                    # a token has one byte at least, a character four at most
                    strain = strain or 4 * size > limit and len("".join(run).encode("utf-8", "surrogatepass")) > limit and forced("".join(run), limit, encoder.count_batch)
                    run, size = [], 0
        ranges = _merge(atoms, room)
        out, at, previous = [], 0, ""
        for a, b in ranges:
            body = "".join(x[0] for x in atoms[a:b])
            shared = _tail(previous, overlap, encoder) if previous else ""
            out.append((shared + body, len(shared), at - len(shared), not a or atoms[a - 1][2] >= _NATURAL))
            at += len(body)
            previous = shared + body
        sizes = encoder.count_batch([p[0] for p in out])
        if max(sizes, default=0) <= limit or room <= LEAST_ROOM:
            return [(p, n, *rest) for (p, *rest), n in zip(out, sizes)], strain
        room = max(LEAST_ROOM, room - (max(sizes) - limit))  # joining changed a count by a little: leave that much more room


def _oversized(chunks: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Rows that can have more than `limit` tokens: a token has one byte at least."""
    return spread(chunks.where(F.octet_length(text_col) > limit).select(id_col, text_col))


def split_pieces(chunks: DataFrame, *, id_col: str = "chunk_no", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id_col, piece_no, n_tokens, start_char, shared_chars, natural, cut, piece) of every text over `limit` tokens.

    piece_no counts from 1; shared_chars is the overlap with the piece before (40 tokens, 0 for the first);
    natural tells whether the cut before the piece is a line break or sentence end; cut is 'forced' for all pieces of a
    text with a stretch of more than `limit` tokens without either, else 'natural'. Null, empty and small texts have
    no pieces; repeated rows give repeated pieces. No shuffle. limit must exceed overlap by 16 or more: a piece then holds
    at least 8 tokens of its own, so that overlap, own tokens and what joining them adds stay within it.
    """
    if limit < overlap + 2 * LEAST_ROOM:
        raise ValueError("limit must exceed overlap by 16 or more")
    model = chunks.sparkSession.sparkContext.broadcast(model_from_file(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe.of(model.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, out = [], []
            for i, n in enumerate(encoder.count_batch(texts)):
                if n > limit:
                    pieces, strain = split_text(texts[i], encoder, limit, overlap)
                    rows += [i] * len(pieces)
                    cut = "forced" if strain else "natural"
                    out += [(k, size, start, shared, natural, cut, p) for k, (p, size, shared, start, natural) in enumerate(pieces, 1)]
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "piece_no", "n_tokens", "start_char", "shared_chars", "natural", "cut", "piece"])

    schema = f"`{id_col}` {type_of(chunks, id_col)}, piece_no int, n_tokens int, start_char int, shared_chars int, natural boolean, cut string, piece string"
    return _oversized(chunks, id_col, text_col, limit).mapInArrow(run, schema)


def cut_kinds(pieces: DataFrame, *, id_col: str = "chunk_no") -> DataFrame:
    """(id_col, cut) of every text that split_pieces has cut, one row per row of its input."""
    return pieces.where("piece_no = 1").select(id_col, "cut")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_kinds(split_pieces(table(spark, sf_dir, "chunks")))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pieces(table(spark, sf_dir, "chunks"))
