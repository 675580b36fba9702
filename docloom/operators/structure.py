"""Structural parsing of a text into cited blocks, and packing of blocks into chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.tokenizers import Words, tokenizer
from docloom.schemas import BLOCK

# The mark before each page of a joined text, and the months as headings write them.
PAGE_MARK = re.compile(r"\f<PAGE\s+(\d+)>\f")
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"

# Heading patterns of the generic parser, tried in this order.
GENERIC = [
    r"(?im)^\s*PART\s+[IVXLC0-9]+\b[^\n]*", r"(?im)^\s*Chapter\s+[IVXLC0-9]+\b[^\n]*", r"(?im)^\s*Section\s+\d+(?:\.\d+)?\b[^\n]*",
    r"(?m)^\s*\d+(?:\.\d+){0,3}\.?\s+[A-Z][^\n]{1,160}$",
]


@dataclass(frozen=True)
class Style:
    """A numbering style: its heading, the kind and citation of its blocks, the parent they hang on, how many it takes."""

    heading: re.Pattern
    kind: str
    cite: Callable[[re.Match], str]
    parent: Callable[[re.Match], str | None] = lambda m: None
    least: int = 2


# The numbering styles. `act` needs the double space of uncleaned texts after the number.
STYLES = {
    "clause": Style(re.compile(rf"(?m)^\s*(\d+(?:\.\d+){{0,3}})\s+(?!(?:{_MONTH})\b)([A-Z][^\n]{{0,200}})$"), "clause", lambda m: f"Clause {m[1]} - {m[2].strip()}", lambda m: f"Clause {m[1].rpartition('.')[0]}" if "." in m[1] else None),
    "guide": Style(re.compile(r"\bRG\s?(\d{1,4})\.(\d+)\b"), "paragraph", lambda m: f"RG {m[1]}.{m[2]}", lambda m: f"RG {m[1]}"),
    "act": Style(re.compile(r"(?m)^\s*(\d{1,4}[A-Z]?)\s{2,}([A-Z][^\n]{0,200})$"), "section", lambda m: f"s.{m[1]} - {m[2].strip()}"),
    "recital": Style(re.compile(r"(?m)^\s*\((\d{1,3})\)\s+(?=[A-Z])"), "recital", lambda m: f"Recital {m[1]}", least=1),
    "article": Style(re.compile(r"(?m)^\s*Article\s+(\d+[a-z]?)\b[^\n]*"), "article", lambda m: f"Article {m[1]}", least=1),
    "annex": Style(re.compile(r"(?m)^\s*ANNEX\s+([IVXLC0-9]+)\b[^\n]*"), "annex", lambda m: f"Annex {m[1]}", least=1),
}


class Pages:
    """Pages of a marked text: the page in force at a place is that of the last mark wholly before it."""

    def __init__(self, text: str):
        self.marks = [(m.end(), int(m[1])) for m in PAGE_MARK.finditer(text)]

    def at(self, place: int) -> int | None:
        known = [page for end, page in self.marks if end <= place]
        return known[-1] if known else None


def without_marks(text: str) -> str:
    return PAGE_MARK.sub("", text).strip()


def _block(text: str, pages: Pages, a: int, b: int, citation: str | None, kind: str, parent: str | None = None) -> dict | None:
    own = without_marks(text[a:b])
    if citation is None:
        citation = own.split("\n", 1)[0].strip()[:160]
    return {"text": own, "citation": citation, "kind": kind, "page_start": pages.at(a), "page_end": pages.at(b), "parent_citation": parent} if own else None


def _cut(text: str, pages: Pages, hits: list[re.Match], end: int, style: Style) -> list[dict | None]:
    edges = [m.start() for m in hits] + [end]
    return [_block(text, pages, m.start(), b, style.cite(m), style.kind, style.parent(m)) for m, b in zip(hits, edges[1:])]


def parse_generic(text: str) -> list[dict]:
    """Sections at the first heading pattern with two matches; without any, the whole as one block."""
    pages = Pages(text)
    for pattern in GENERIC:
        starts = [m.start() for m in re.finditer(pattern, text)]
        if len(starts) > 1:
            edges = [0, *starts, len(text)] if starts[0] else [*starts, len(text)]
            return [b for a, e in zip(edges, edges[1:]) if (b := _block(text, pages, a, e, None, "section"))]
    whole = _block(text, pages, 0, len(text), "(no structure)", "misc")
    return [whole] if whole else []


def parse_numbered(text: str, style: Style) -> list[dict]:
    """A preamble and one block per heading of the style; too few headings fall back to the generic parser."""
    hits, pages = list(style.heading.finditer(text)), Pages(text)
    if len(hits) < style.least:
        return parse_generic(text)
    blocks = [_block(text, pages, 0, hits[0].start(), "Preamble", "preamble"), *_cut(text, pages, hits, len(text), style)]
    return [b for b in blocks if b]


def parse_regulation(text: str) -> list[dict]:
    """Preamble, recitals before the first article, articles before the first annex, annexes."""
    find = lambda name, end=None: list(STYLES[name].heading.finditer(text, 0, len(text) if end is None else end))
    articles, annexes, pages = find("article"), find("annex"), Pages(text)
    if not articles:
        return parse_generic(text)
    body, stop = articles[0].start(), annexes[0].start() if annexes else len(text)
    recitals = find("recital", body)
    blocks = [_block(text, pages, 0, recitals[0].start() if recitals else body, "Preamble", "preamble")]
    blocks += _cut(text, pages, recitals, body, STYLES["recital"])
    blocks += _cut(text, pages, [m for m in articles if m.start() < stop], stop, STYLES["article"])
    blocks += _cut(text, pages, annexes, len(text), STYLES["annex"])
    return [b for b in blocks if b]


PARSERS: dict[str, Callable[[str], list[dict]]] = {
    "generic": parse_generic, "regulation": parse_regulation,
    **{name: (lambda text, s=STYLES[name]: parse_numbered(text, s)) for name in ("clause", "guide", "act")},
}


def register_parser(name: str, parse: Callable[[str], list[dict]]) -> None:
    """Add a parser: text -> blocks with the fields of schemas.BLOCK."""
    PARSERS[name] = parse


WORDS = Words()
count_words = WORDS.count

# What parts paragraphs and sentences.
_PARAGRAPH, _SENTENCE = re.compile(r"\n{2,}"), re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")


def sentences(text: str) -> list[str]:
    return [s for p in _PARAGRAPH.split(text) for s in _SENTENCE.split(p.strip()) if s]


class Packer:
    """Collects items up to a target; `add` gives out what is full."""

    def __init__(self, glue: str):
        self.glue, self.items, self.size, self.head = glue, [], 0, None

    def flush(self) -> list[tuple]:
        out = [(self.head, self.glue.join(self.items))] if self.items else []
        self.items, self.size, self.head = [], 0, None
        return out

    def put(self, item: str, size: int, head=None) -> None:
        if not self.items:
            self.head = head
        self.items.append(item)
        self.size += size


def split_block(text: str, target: int, most: int, tokens=WORDS) -> list[str]:
    """A block over `most` tokens in pieces of whole sentences: a piece ends when it reaches the target, or before it
    would exceed the maximum; a sentence that is too long itself is cut by tokens."""
    pack, out = Packer(" "), []
    for sentence in sentences(text):
        n = tokens.count(sentence)
        if n > most:
            out += [t for _, t in pack.flush()] + list(tokens.pieces(sentence, target))
            continue
        over = pack.size + n > most
        if over:
            out += [t for _, t in pack.flush()]
        pack.put(sentence, n)
        if not over and pack.size >= target:
            out += [t for _, t in pack.flush()]
    return out + [t for _, t in pack.flush()]


def pack_blocks(blocks: list[dict], target: int = 200, most: int = 400, tokens=WORDS) -> list[tuple[dict, str]]:
    """[(leading block, text)]: neighbours with the same parent and kind merge up to the target; larger ones are split."""
    pack, out = Packer("\n\n"), []
    for block in blocks:
        n = tokens.count(block["text"])
        if n > most:
            out += pack.flush() + [(block, t) for t in split_block(block["text"], target, most, tokens)]
            continue
        head = pack.head
        alike = head is not None and (head["parent_citation"], head["kind"]) == (block["parent_citation"], block["kind"])
        if not alike or pack.size + n > target:
            out += pack.flush()
        pack.put(block["text"], n, block)
    return [(b, t.strip()) for b, t in out + pack.flush() if t.strip()]


def chunk_id(doc_id: str, text: str, position: int) -> str:
    """Document, length and digest in hex, and the chunk's position: the same in every run."""
    return f"{doc_id}::{len(text):x}::{hashlib.md5(text.encode('utf-8', 'surrogatepass')).hexdigest()[:4]}::{position}"


def parse_blocks(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parser_col: str | None = None, parser: str = "generic") -> DataFrame:
    """(id_col, block_no, text, citation, kind, page_start, page_end, parent_citation); null and blank texts have none.

    An unknown parser id means the generic one.
    """
    rows = texts.select(F.col(id_col), F.col(text_col).alias("_t"), (F.col(parser_col) if parser_col else F.lit(parser)).alias("_p"))
    names = [f.split()[0] for f in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, out = [], [], {n: [] for n in names}
            for i, (text, name) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for k, block in enumerate(PARSERS.get(name, parse_generic)(text or "")):
                    at.append(i)
                    no.append(k + 1)
                    for n in names:
                        out[n].append(block[n])
            types = {n: pa.int32() if n.startswith("page") else pa.string() for n in names}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), *(pa.array(out[n], types[n]) for n in names)], [id_col, "block_no", *names])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, block_no int, {BLOCK}")


def chunk_documents(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parser_col: str | None = None, parser: str = "generic", target: int = 200, most: int = 400, tokens: str = "words", **options: str) -> DataFrame:
    """Parse and pack in one pass: (id_col, chunk_id, position, citation, parent_citation, kind, page_start, page_end,
    text, n_tokens). Chunks have at most `most` tokens by the named tokenizer (see functions.tokenizers; options such as a
    rank file's path go to it); with a subword one, a piece cut within a sentence can count a token or two more. No shuffle."""
    rows = texts.select(F.col(id_col), F.col(text_col).alias("_t"), (F.col(parser_col) if parser_col else F.lit(parser)).alias("_p"))
    fields = [("chunk_id", pa.string()), ("position", pa.int32()), ("citation", pa.string()), ("parent_citation", pa.string()), ("kind", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokens, **options)
        for batch in batches:
            at, out = [], []
            for i, (doc, text, name) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                for k, (b, t) in enumerate(pack_blocks(PARSERS.get(name, parse_generic)(text or ""), target, most, own), 1):
                    at.append(i)
                    out.append((chunk_id(str(doc), t, k), k, b["citation"], b["parent_citation"], b["kind"], b["page_start"], b["page_end"], t, own.count(t)))
            columns = list(zip(*out)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields))], [id_col, *(n for n, _ in fields)])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, chunk_id string, position int, citation string, parent_citation string, kind string, page_start int, page_end int, text string, n_tokens int")


def chunk_statistics(chunks: DataFrame, by: list[str] = ["kind"]) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"), F.round(F.avg("n_tokens"), 6).alias("mean"))
