"""Problem 6: noise in text from scanned pages.

1. Layout: lines at the pages' edges that recur through a document (compared by glyph skeleton, digits masked) are running
   headers or footers; lines that hold only a number in step with the pages are page numbers. Shapes of headers that many
   documents show serve documents too short to recur.
2. Words: counts over all body text; skip-gram vectors of the frequent words; every word linked to much more frequent
   neighbours that plausible glyph edits lead to.
3. Repair: hyphens at line ends judged by which joined form the corpus knows, misread words corrected by the neighbour that
   fits the context best, furniture removed, lines reflowed into paragraphs.
"""

from __future__ import annotations

import difflib
import functools
import math
import re
import unicodedata
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.runtime import cut_lineage, table

HYPHENS = "-­‐‑¬"
EDGE = 3

#: Words of the skip-gram model at most (the most frequent), and the length of their vectors.
MODEL_WORDS, VECTOR, WINDOW = 50_000, 32, 4

#: Words whose forms a worker remembers.
REMEMBERED = 100_000

#: Lines of one edge that are tried as the header of every other page, those on most pages first.
TRIED = 20

#: A neighbour must be this many times as frequent as the word that is taken for its misreading.
RATIO = 10

# Glyphs that scanners take for one another; each class is written by its first member.
GLYPHS = ("o0", "l1i|!j[]", "s5$", "g9q", "b6h", "ce", "t†+", "z2", "a4@")
SEQUENCES = (("\\/", "v"), ("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"))
_CLASS = {ord(c): own[0] for own in GLYPHS for c in own}
_MARKS = re.compile(r"[̀-ͯ]")


def bare(text: str) -> str:
    """Lower case without diacritics and ligatures."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()


@functools.lru_cache(maxsize=REMEMBERED)
def skeleton(word: str) -> str:
    """What is left of a word when glyphs that look alike are one."""
    word = bare(word)
    for seen, meant in SEQUENCES:
        word = word.replace(seen, meant)
    return word.translate(_CLASS)


_NUMBER = re.compile(r"[0-9lI|oO]*[0-9][0-9lI|oO]*|[lI|]")
_DIGITS = str.maketrans("lI|oO", "11100")


def shape(line: str) -> str:
    """A line by the skeletons of its words, numbers masked."""
    out = []
    for word in line.split():
        plain = _NUMBER.sub("#", word)
        out.append(plain if not any(c.isalpha() for c in plain) else skeleton(word))
    return " ".join(out)


_PAGE = re.compile(r"^\W*?(?:(page|pg|p|seite|s|pagina|página|pag|pág)\b\.?\s*)?([0-9lI|oO]{1,5}|[ivxlc]{1,7})(?:\s*(?:/|\||of|von|de|sur|aus)\s*([0-9lI|oO]{1,5}))?\W*$", re.IGNORECASE)
_ROMAN = re.compile(r"m*(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")


def _roman(text: str) -> int | None:
    if not text or not _ROMAN.fullmatch(text):
        return None
    value = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in text]
    return sum(-v if any(v < w for w in value[i + 1 : i + 2]) else v for i, v in enumerate(value))


def page_numbers(line: str) -> list[tuple[int, str]]:
    """[(number, style)] that a line may print as a page number: arabic first, roman where it can be one."""
    found = _PAGE.match(line.strip())
    if not found:
        return []
    text, out = found.group(2), []
    style = list(line.strip().lower())
    for k in (3, 2):
        if found.group(k):
            style[found.start(k) : found.end(k)] = "#"
    style = "".join(style).replace(" ", "")
    plain = text.translate(_DIGITS)
    if plain.isdigit():
        out.append((int(plain), style))
    roman = _roman(text.lower())
    if roman:
        out.append((roman, style + "roman"))
    return out


class Page:
    def __init__(self, number: int, text: str | None):
        self.number = number
        self.lines = (text or "").split("\n")
        self.kind = ["body" if x.strip() else "blank" for x in self.lines]
        full = [i for i, k in enumerate(self.kind) if k == "body"]
        self.top, self.bottom = full[:EDGE], full[::-1][:EDGE]


KINDS = ("blank", "body", "header", "pageno")


def coded(pages: list[Page]) -> list[bytes]:
    """The kinds of every page's lines, a byte each."""
    return [bytes(KINDS.index(k) for k in p.kind) for p in pages]


def restored(raw: list[dict] | None, kinds: list[bytes]) -> list[Page]:
    """The pages in order with their lines' kinds as coded."""
    pages = _ordered(raw)
    for page, own in zip(pages, kinds):
        page.kind = [KINDS[k] for k in own]
    return pages


def _ordered(pages: list[dict] | None) -> list[Page]:
    known = [p for p in pages or [] if p and p["text"] is not None and p["page"] is not None]
    return [Page(p["page"], p["text"]) for p in sorted(known, key=lambda p: p["page"])]


def _mark_numbers(pages: list[Page]) -> None:
    groups: dict[tuple, dict] = defaultdict(dict)
    for k, page in enumerate(pages):
        for side in ("top", "bottom"):
            for rank, i in enumerate(getattr(page, side)):
                for number, style in page_numbers(page.lines[i]):
                    groups[side, style, number - page.number].setdefault(k, (rank, i))
    for (side, style, offset), hits in sorted(groups.items(), key=lambda g: -len(g[1])):
        nearest = min(rank for rank, _ in hits.values())
        if len(hits) >= 2 and len(hits) * 3 >= len(pages) or len(pages) <= 2 and nearest <= 1 and offset >= 0 and not (offset and style.endswith("roman")):
            for k, (_, i) in hits.items():
                pages[k].kind[i] = "pageno"


def _like(a: str, b: str) -> bool:
    """Shapes of one line: as many characters, nearly all alike."""
    return a == b or len(a) == len(b) >= 8 and sum(x != y for x, y in zip(a, b)) <= 2


def _edges(page: Page) -> Iterator[tuple[str, int]]:
    """Lines of a page from the edges inwards, as long as everything further out is furniture."""
    for side in ("top", "bottom"):
        for i in getattr(page, side):
            if page.kind[i] == "body":
                yield side, i
                break
            if page.kind[i] not in ("header", "pageno"):
                break


def _suffix(line: str) -> str | None:
    """The last word and number of a title line: what documents' headers have in common."""
    words = line.split()
    if 2 <= len(words) <= 9 and line.strip()[:1].isupper() and re.fullmatch(r"#", shape(words[-1])) and any(c.isalpha() for c in words[-2]):
        return "suffix " + skeleton(words[-2])
    return None


def _title(line: str) -> str:
    """The shape without numbers: headers print the page's number on one side or the other."""
    return " ".join(w for w in shape(line).split() if any(c.isalpha() for c in w))


def _titular(line: str) -> bool:
    """Whether a line looks like a title: it starts with no small letter and doesn't end like running text."""
    line = line.strip()
    words = [w for w in line.split() if any(c.isalpha() for c in w)]
    return 2 <= len(words) <= 9 and len(line) >= 8 and not next(c for c in line if c.isalnum()).islower() and line[-1] not in ".,;:" + HYPHENS


def _near(a: str, b: str) -> bool:
    """Titles that may be one line, copies too misread for _like included."""
    if _like(a, b):
        return True
    return len(a.split()) == len(b.split()) and abs(len(a) - len(b)) <= 2 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85


def _alternating(pages: list[Page], heads: list[tuple[str, list]]) -> Iterator[tuple[Page, int, bool]]:
    """(page, line, whether it recurs) of one edge's lines that head every other page.

    A header of the even or the odd pages is judged against the pages where it can stand: those of its parity that have
    lines, the first page left out. Where one of two alternating headers is on all its pages, the other may have one only.
    """
    able = {parity: {p.number for p in pages[1:] if p.top and p.number % 2 == parity} for parity in (0, 1)}
    found: set[int] = set()
    for parity in (0, 1):
        own = [(head, [(p, i) for p, i in members if p.number in able[parity] and _titular(p.lines[i])]) for head, members in heads]
        own = sorted((x for x in own if x[1]), key=lambda x: -len(x[1]))
        best = max(([m for other, members in own if _near(head, other) for m in members] for head, _ in own[:TRIED]), key=len, default=[])
        if len(best) >= 2 and len(best) * 2 >= len(able[parity]):
            found |= {p.number for p, _ in best}
            yield from ((p, i, True) for p, i in best)
    for parity in (0, 1):
        if len(able[parity]) == 1 and len(able[1 - parity]) >= 2 and able[1 - parity] <= found:
            yield from ((p, i, False) for _, members in heads if len(members) == 1 for p, i in members if p.number in able[parity] and _titular(p.lines[i]))


def _keys(line: str) -> list[str]:
    own = _suffix(line)
    return [x for x in (f"shape {shape(line)}", own) if x]


def layout(raw: list[dict] | None, known: set[str] = frozenset()) -> tuple[list[Page], set[str]]:
    """The pages in order, every line's kind set; and the keys of the headers that recur within the document."""
    pages, keys = _ordered(raw), set()
    _mark_numbers(pages)
    for _ in range(EDGE):
        candidates = defaultdict(list)
        for page in pages:
            for side, i in _edges(page):
                candidates[side].append((_title(page.lines[i]), page, i))
        changed = False
        for side, lines in candidates.items():
            heads: list[tuple[str, list]] = []
            for own, page, i in lines:
                if not any(c.isalpha() for c in own):
                    continue
                for head, members in heads:
                    if _like(head, own):
                        members.append((page, i))
                        break
                else:
                    heads.append((own, [(page, i)]))
            for head, members in heads:
                if len(members) >= 2 and len(members) * 2 >= len(pages) - 1:
                    changed = True
                    for page, i in members:
                        keys.update(_keys(page.lines[i]))
                        page.kind[i] = "header"
                elif known:
                    for page, i in members:
                        if any(k in known for k in _keys(page.lines[i])):
                            changed, page.kind[i] = True, "header"
            for page, i, recurs in list(_alternating(pages, heads)):
                if page.kind[i] == "body":
                    changed, page.kind[i] = True, "header"
                    if recurs:
                        keys.update(_keys(page.lines[i]))
        if not changed:
            break
    return pages, keys


# Signs that no word holds between its letters.
_NO_LETTER = re.compile(r"[^\W\d_](?:[|†\ufffd]|\\/)[^\W\d_]")

_OUTER = ".,;:()\"'“”‘’«»?"


@functools.lru_cache(maxsize=REMEMBERED)
def core(word: str) -> str:
    """A word as it is counted: lower case, outer punctuation gone, hyphens alike; '' for what is no word."""
    word = word.strip(_OUTER)
    for h in HYPHENS[1:]:
        word = word.replace(h, "-")
    word = word.strip("-")
    if not any(c.isalpha() for c in word) or not any(c.islower() for c in word) and any(c.isdigit() for c in word):
        return ""
    return word.lower()


class Line:
    """A body line: its words, and how its first or last one is split with a neighbour."""

    __slots__ = ("page", "no", "words", "after", "cut", "text")

    def __init__(self, page: int, no: int, text: str, after_blank: bool):
        self.page, self.no, self.text, self.after = page, no, text.strip(), after_blank
        self.words = self.text.split()
        self.cut = None  # (left, right) where the last word goes on in the next line


def body(pages: list[Page]) -> list[Line]:
    """The body lines in reading order, with the words that are split at their ends."""
    out: list[Line] = []
    for page in pages:
        blank = False
        for i, kind in enumerate(page.kind):
            if kind == "body":
                out.append(Line(page.number, i + 1, page.lines[i], blank))
                blank = False
            blank |= kind == "blank"
    for line, following in zip(out, out[1:] + [None]):
        last = line.words[-1] if line.words else ""
        if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalnum():
            line.cut = (last[:-1], following.words[0] if following and following.words else "")
    return out


def split_forms(left: str, right: str) -> tuple[str, str]:
    """(joined, with hyphen) of a word split over a line end."""
    left = left.lstrip(_OUTER)
    return core(left + right), core(left + "-" + right)


def doc_words(lines: list[Line]) -> tuple[list[str], set[str]]:
    """(words that stand whole, in their order; forms and parts to look up of those that are split)."""
    whole, forms, split_before = [], set(), False
    for line in lines:
        words = line.words[1 if split_before else 0 : -1 if line.cut else None]
        whole += [w for w in map(core, words) if w]
        split_before = bool(line.cut)
        if line.cut:
            forms.update(x for x in (*split_forms(*line.cut), *map(core, line.cut)) if x)
    return whole, forms


def edit_keys(word: str) -> list[str]:
    """Keys that a word shares with those one glyph away, and with those of the same skeleton."""
    keys = {f"s {skeleton(word)}"}
    if len(word) >= 3:
        keys |= {f"w {word[:i]}*{word[i + 1:]}" for i in range(len(word))}
        plain = bare(word)
        keys |= {f"w {plain[:i]}*{plain[i + 1:]}" for i in range(len(plain))}
    return sorted(keys)


def glyph_edit(seen: str, meant: str) -> str | None:
    """How a word was misread: 'same skeleton', 'no letter', or the two letters; None if it can't have been."""
    if seen == meant:
        return None
    if skeleton(seen) == skeleton(meant):
        return "skeleton"
    if len(seen) != len(meant):
        return None
    differ = [(a, b) for a, b in zip(seen, meant) if a != b]
    if any(b == "-" or a == "-" for a, b in differ) or len(differ) > 2:
        return None
    if all(_CLASS.get(ord(a), a) == _CLASS.get(ord(b), b) for a, b in differ):
        return "skeleton"
    if all(not (a.isascii() and a.isalpha()) for a, _ in differ):
        return "sign"
    return "".join(differ[0]) if len(differ) == 1 else None


def _per_doc(batches: Iterator[pa.RecordBatch], make, schema: list[tuple[str, pa.DataType]], some: int = 50) -> Iterator[pa.RecordBatch]:
    """Run make(row) -> rows for every document, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, some):
            part = batch.slice(at, some)
            values = [c.to_pylist() for c in part.columns]
            rows = [out for own in zip(*values) for out in make(dict(zip(part.schema.names, own)))]
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _latest(extracted: DataFrame, id_col: str) -> DataFrame:
    """(doc, pages): each document once, as last extracted; in as many parts as there is work for."""
    session = extracted.sparkSession
    parts = max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    named = extracted.where(F.col(id_col).isNotNull() & F.col("pages").isNotNull()).select(F.col(id_col).alias("doc"), "pages", "extracted_at").repartition(parts, "doc")
    return named.groupBy("doc").agg(F.max_by("pages", F.struct("extracted_at", F.size("pages"))).alias("pages"))


_PAGES = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))


def _laid_out(docs: DataFrame) -> DataFrame:
    """(doc, pages, kinds array<binary>, keys, edges array<string>): every document laid out by itself; keys are those of
    headers that recur within it, edges those of other lines at its pages' edges."""

    def rows(r: dict) -> list[tuple]:
        pages, keys = layout(r["pages"])
        edges = {k for p in pages for i in {*p.top, *p.bottom} if p.kind[i] == "body" for k in _keys(p.lines[i])}
        return [(r["doc"], [x and {"page": x["page"], "text": x["text"]} for x in r["pages"]], coded(pages), sorted(keys), sorted(edges - keys))]

    schema = [("doc", pa.string()), ("pages", _PAGES), ("kinds", pa.list_(pa.binary())), ("keys", pa.list_(pa.string())), ("edges", pa.list_(pa.string()))]
    return cut_lineage(docs.mapInArrow(lambda batches: _per_doc(batches, rows, schema), "doc string, pages array<struct<page: int, text: string>>, kinds array<binary>, keys array<string>, edges array<string>"))


def _known_headers(laid: DataFrame, least_docs: int = 3) -> DataFrame:
    """(doc, known array<string>): header keys at a document's edges that recur within least_docs documents."""
    common = laid.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("key")
    return laid.select("doc", F.explode("edges").alias("key")).join(common, "key", "left_semi").groupBy("doc").agg(F.collect_set("key").alias("known"))


def _worded(laid: DataFrame) -> DataFrame:
    """(doc, kinds, words, own, counts, forms): the final kinds where other documents' headers changed them, else null; the
    body's whole words in their order, its distinct ones with their counts, and what its split words ask for."""

    def rows(r: dict) -> list[tuple]:
        pages, kinds = restored(r["pages"], r["kinds"]), None
        if r["known"]:
            pages, _ = layout(r["pages"], set(r["known"]))
            kinds = coded(pages)
        whole, forms = doc_words(body(pages))
        own = Counter(whole)
        return [(r["doc"], kinds, whole, list(own), list(own.values()), sorted(forms))]

    strings = pa.list_(pa.string())
    schema = [("doc", pa.string()), ("kinds", pa.list_(pa.binary())), ("words", strings), ("own", strings), ("counts", pa.list_(pa.int64())), ("forms", strings)]
    known = laid.select("doc", "pages", "kinds").join(_known_headers(laid), "doc", "left")
    return cut_lineage(known.mapInArrow(lambda batches: _per_doc(batches, rows, schema), "doc string, kinds array<binary>, words array<string>, own array<string>, counts array<bigint>, forms array<string>"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (word, n, key), a row per key."""
    for batch in batches:
        each = [edit_keys(w) for w in batch.column(0).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(each)), list(map(len, each))))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([k for own in each for k in own], pa.string())], ["word", "n", "key"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, meant, n_meant) -> those with a plausible edit, and the edit."""
    for batch in batches:
        edits = pa.array(list(map(glyph_edit, batch.column(0).to_pylist(), batch.column(1).to_pylist())), pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], edits], ["word", "meant", "n_meant", "edit"]).filter(edits.is_valid())


def _links(counts: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, meant, n_meant, edit): words and the much more frequent ones that a plausible glyph edit leads to.

    Words meet at keys: a word with one letter left open, or its skeleton. A key has a plain word per letter at most, or
    those whose letters look alike, so no key is hot, however often its words occur.
    """
    seen = counts.join(forms.select("word").distinct(), "word", "full_outer").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    top = counts.agg(F.max("n")).first()[0] or 0
    # a word with signs, digits or diacritics gives way to a plain one as frequent; a plain one only to a much more frequent
    odd = ~F.col("word").rlike("^[a-z'’-]+$")
    left = seen.where(odd | (F.col("n") <= max(1, top // RATIO))).mapInArrow(_keyed, "word string, n long, key string")
    right = counts.where(F.col("word").rlike("^[a-z]+(-[a-z]+)*$")).select("word", F.col("n").cast("long").alias("n")).mapInArrow(_keyed, "word string, n long, key string")
    right = right.select(F.col("word").alias("meant"), F.col("n").alias("n_meant"), "key")
    rare = (F.col("n_meant") >= 3) & ((F.col("n") <= 1) | (F.col("n_meant") >= RATIO * F.col("n")))
    pairs = left.join(right, "key").where((odd & (F.col("n_meant") >= F.col("n")) | rare) & (F.col("word") != F.col("meant"))).select("word", "meant", "n_meant").distinct()
    judged = cut_lineage(pairs.mapInArrow(_judged, "word string, meant string, n_meant long, edit string"))
    # a letter for a letter beyond the look-alikes must be a habit of the scanner: seen in several words
    habits = judged.where("length(edit) = 2").groupBy("edit").agg(F.count_distinct("meant").alias("words"))
    kept = judged.join(habits, "edit", "left").where("length(edit) > 2 or words >= 5")
    return cut_lineage(kept.select("word", "meant", "n_meant", "edit"))


def _rare_vectors(lines: DataFrame, wanted: DataFrame, vectors: Broadcast) -> DataFrame:
    """(word, vector array<float>) of wanted words that the model has none of: the mean of their neighbours' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for words in batch.column(0).to_pylist():
                own = [vectors.value.get(w) for w in words]
                for i, w in enumerate(words):
                    if own[i] is None:
                        near = [v for v in own[max(0, i - WINDOW) : i] + own[i + 1 : i + 1 + WINDOW] if v is not None]
                        if near:
                            sums[w] = sums.get(w, 0) + sum(near[1:], near[0])
            values = pa.array([v.astype(np.float64).tolist() for v in sums.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), values], ["word", "vector"])

    part = lines.mapInArrow(run, "word string, vector array<double>").join(wanted, "word", "left_semi")
    each = part.select("word", F.posexplode("vector").alias("k", "x")).groupBy("word", "k").agg(F.sum("x").alias("x"))
    return each.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("vector"))


def word_vectors(lines: DataFrame, counts: DataFrame, words: int = MODEL_WORDS, size: int = VECTOR) -> tuple[dict[str, np.ndarray], int]:
    """(skip-gram vectors of the most frequent words, at most `words` of them (their bound on the driver); the least count).

    Words seen once or twice have none. One pass over all lines, which are cut into stretches of 200 words, so a window is
    cut short every 200 words.
    """
    floor = counts.orderBy(F.desc("n")).limit(words + 1).agg(F.min("n"), F.count(F.lit(1))).first()
    if not floor[1]:
        return {}, 3
    least = max(3, floor[0] + 1 if floor[1] > words else floor[0])
    if not counts.where(F.col("n") >= least).head(1):
        return {}, least
    parts = max(1, min(lines.rdd.getNumPartitions(), lines.sparkSession.sparkContext.defaultParallelism))
    model = Word2Vec(vectorSize=size, minCount=least, numPartitions=parts, maxIter=1, windowSize=WINDOW, seed=7, inputCol="words", outputCol="v", maxSentenceLength=200).fit(lines.where(F.size("words") > 0))
    out = {}
    for r in model.getVectors().toLocalIterator():
        v = np.array(r["vector"].toArray(), np.float32)
        out[r["word"]] = v / max(float(np.linalg.norm(v)), 1e-9)
    return out, least


class Judge:
    """Decides the words of one document: known (word -> count), links (word -> [(meant, count, edit)])."""

    def __init__(self, known: dict[str, int], links: dict[str, list[tuple[str, int, str]]], vectors: dict[str, np.ndarray]):
        self.known, self.links, self.vectors = known, links, vectors

    def meant(self, word: str, context: list[str]) -> str | None:
        """The word that a misread one stands for, by count and by how its vector fits the words around; None if none."""
        around = [self.vectors[w] for w in context if w in self.vectors]
        mean = sum(around[1:], around[0]) if around else None
        best, top = None, -math.inf
        for other, n, edit in self.links.get(word, ()):
            fit = float(mean @ self.vectors[other] / max(float(np.linalg.norm(mean)), 1e-9)) if mean is not None and other in self.vectors else 0.0
            if len(edit) == 2 and mean is not None and fit < -0.2:
                continue  # letter for letter, and the context speaks against it
            score = 3 * fit + 0.3 * math.log(n) + (1.0 if edit == "skeleton" else 0.0)
            if score > top:
                best, top = other, score
        return best

    def split(self, left: str, right: str) -> tuple[bool, str, str | None]:
        """(whether the word is written without the hyphen, the form taken, what it is meant to be)."""
        joined, compound = split_forms(left, right)
        a, b = self.known.get(joined, 0), self.known.get(compound, 0)
        if joined in self.links:
            a = 0
        if compound in self.links:
            b = 0
        if max(a, b) >= 2:
            return a >= b, joined if a >= b else compound, None
        link_a, link_b = self.meant(joined, []), self.meant(compound, [])
        if link_a or link_b:
            n_a, n_b = self.known.get(link_a, 1) if link_a else 0, self.known.get(link_b, 1) if link_b else 0
            return n_a >= n_b, joined if n_a >= n_b else compound, link_a if n_a >= n_b else link_b
        if a or b:
            return a >= b, joined if a >= b else compound, None
        whole = self.known.get(core(left), 0) >= 3 and self.known.get(core(right), 0) >= 3
        return not whole, compound if whole else joined, None


def judge_lines(lines: list[Line], judge: Judge) -> tuple[list[tuple[int, int, str]], list[str]]:
    """(faults of body lines (page, line_no, fault), repaired paragraphs)."""
    faults, paragraphs, text, carried = set(), [], [], None
    for k, line in enumerate(lines):
        words = list(line.words)
        if line.after and text and carried is None and text[-1][-1:] in ".:;!?":
            paragraphs.append(" ".join(text))
            text = []
        if carried is not None:
            text[-1] += words.pop(0) if words else ""
            if carried:
                fix, fresh = carried
                text[-1] = _replace(text[-1], fix, fresh)
            carried = None
        cores = [core(w) for w in words]
        for i, (raw, word) in enumerate(zip(words, cores)):
            if line.cut and i == len(words) - 1:
                break
            if word and word in judge.links:
                meant = judge.meant(word, cores[max(0, i - 4) : i] + cores[i + 1 : i + 5])
                if meant:
                    faults.add((line.page, line.no, "char"))
                    words[i] = _replace(raw, word, meant)
            if word and _NO_LETTER.search(word):  # misread for sure, even if the corpus does not know the word
                faults.add((line.page, line.no, "char"))
        if line.cut and words:
            left, right = line.cut
            alone, form, meant = judge.split(left, right)
            if alone:
                faults.add((line.page, line.no, "hyphen"))
            if meant:
                bare_left = core(left)
                following = lines[k + 1] if k + 1 < len(lines) else None
                if not meant.startswith(bare_left):
                    faults.add((line.page, line.no, "char"))
                if following and not meant.endswith(core(right)):
                    faults.add((following.page, following.no, "char"))
            words[-1] = words[-1][:-1] + ("" if alone else "-")
            carried = (form, meant) if meant else ()
        text += words
    if text:
        paragraphs.append(" ".join(text))
    return sorted(faults), paragraphs


def _replace(raw: str, word: str, meant: str) -> str:
    """A word as printed with what it means put in: outer punctuation and a capital stay."""
    at = raw.lower().find(word)
    if at < 0:
        return raw
    fresh = meant.capitalize() if raw[at : at + 1].isupper() else meant
    return raw[:at] + fresh + raw[at + len(word) :]


def repaired(extracted: DataFrame, *, id_col: str = "doc_id", model_words: int = MODEL_WORDS) -> DataFrame:
    """(doc, faults array<struct<page, line_no, fault>>, paragraphs array<string>): every document once.

    Of repeated documents the latest extraction counts. Null, blank and missing pages have no lines; pages are read in
    the order of their numbers; documents without pages or id have no row. Nothing but a document's own links, split forms
    and header keys is brought to it, by joins; the skip-gram vectors are broadcast (their number is bounded), and words
    beyond them that something may be a misreading of bring the mean of their neighbours' vectors along.
    """
    laid = _laid_out(_latest(extracted, id_col))
    worded = _worded(laid)
    counts = cut_lineage(worded.select(F.explode(F.arrays_zip("own", "counts")).alias("w")).groupBy(F.col("w.own").alias("word")).agg(F.sum("w.counts").alias("n")))
    forms = worded.select("doc", F.explode("forms").alias("word"))
    links = _links(counts, forms)
    known, least = word_vectors(worded.select("words"), counts, model_words)
    vectors = extracted.sparkSession.sparkContext.broadcast(known)
    links = links.withColumn("vector", F.lit(None).cast("array<double>"))
    rare = counts.where((F.col("n") >= 3) & (F.col("n") < least)).select("word")
    if known and rare.head(1):
        rare = links.select(F.col("meant").alias("word")).distinct().join(rare, "word", "left_semi")
        means = _rare_vectors(worded.select("words"), rare, vectors).select(F.col("word").alias("meant"), "vector")
        links = cut_lineage(links.drop("vector").join(means, "meant", "left"))
    linked = cut_lineage(links.groupBy("word").agg(F.collect_list(F.struct("meant", "n_meant", "edit", "vector")).alias("links")))
    asked = forms.join(counts, "word").groupBy("doc").agg(F.collect_list("word").alias("asked"), F.collect_list("n").alias("n"))
    said = worded.select("doc", F.explode(F.array_union("own", "forms")).alias("word"))
    own_links = said.join(linked, "word").groupBy("doc").agg(F.collect_list(F.struct("word", "links")).alias("linked"))
    about = worded.select("doc", F.col("kinds").alias("changed")).join(asked, "doc", "left").join(own_links, "doc", "left")

    def rows(r: dict) -> list[tuple]:
        pages = restored(r["pages"], r["changed"] or r["kinds"])
        known = dict(zip(r["asked"] or (), r["n"] or ()))
        own = {x["word"]: [(y["meant"], y["n_meant"], y["edit"]) for y in x["links"]] for x in r["linked"] or ()}
        brought = {y["meant"]: np.array(y["vector"], np.float32) for x in r["linked"] or () for y in x["links"] if y["vector"]}
        for options in own.values():
            for meant, n, _ in options:
                known.setdefault(meant, n)
        held = ChainMap({w: v / max(float(np.linalg.norm(v)), 1e-9) for w, v in brought.items()}, vectors.value) if brought else vectors.value
        faults, paragraphs = judge_lines(body(pages), Judge(known, own, held))
        faults += [(p.number, i + 1, k) for p in pages for i, k in enumerate(p.kind) if k in ("header", "pageno")]
        return [(r["doc"], [dict(zip(("page", "line_no", "fault"), f)) for f in faults], paragraphs)]

    fault = pa.struct([("page", pa.int32()), ("line_no", pa.int32()), ("fault", pa.string())])
    schema = [("doc", pa.string()), ("faults", pa.list_(fault)), ("paragraphs", pa.list_(pa.string()))]
    return laid.select("doc", "pages", "kinds").join(about, "doc").mapInArrow(lambda batches: _per_doc(batches, rows, schema), "doc string, faults array<struct<page: int, line_no: int, fault: string>>, paragraphs array<string>")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired(table(spark, sf_dir, "extracted"))
    return found.select(F.col("doc").alias("doc_id"), F.explode("faults").alias("f")).select("doc_id", "f.page", "f.line_no", "f.fault").distinct()


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of every document, numbered from 1."""
    found = repaired(table(spark, sf_dir, "extracted"))
    return found.select(F.col("doc").alias("doc_id"), F.posexplode("paragraphs").alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("paragraph"), "text")
