"""Problem 9: evaluation texts leaking into training text.

MinHash containment search for short items inside long documents. The signature is taken per window: a window of 12
words is the set of its five-word shingles and its MinHash is the smallest shingle hash. Two equal windows have equal
MinHashes, so a document that contains a window of an item always meets it; a signature of the whole document could not
find one window among thousands. Items are partitioned by size (by powers of two of their text), every partition in blocks
with a filter of MinHashes fitted to its windows, and exact windows; a candidate is verified by exact containment of the
window's words. As one common window is enough, no size excludes another: the partitions lay out the tables, they prune
nothing.

The blocks lie in the shared folder. The documents are read once, whatever the number of items: a worker tests its
documents' MinHashes against the filters of all blocks and opens a block only where one is met. Within a block equal
windows are one, with the list of their items, so that a window of many items costs as much as any other.
"""

from __future__ import annotations

import io
import math
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.hashes import MULT, mix, word_hashes
from docloom.plans.runtime import portions, scratch, spread, table, type_of

RUN, SHINGLE = 12, 5

#: Bytes of item text in one block, about.
BLOCK_BYTES = 8 << 20

#: Characters of text searched at once; a longer document is searched by itself, in sections of so many words.
LONG_TEXT, SECTION = 1 << 21, 250_000

#: Bits of a block's filter per window, at least.
FILTER_BITS = 8

#: Bytes of filters that a worker keeps, and blocks; what is beyond is read again.
KEPT_FILTERS, KEPT_BLOCKS = 128 << 20, 4

#: Pairs of document and item that are counted at once, about.
PAIRS = 4_000_000

_WORD = re.compile(r"\w+")
_WORDS = _WORD.findall


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * MULT + h[k : k + n]
    return mix(out)


def _min_hashes(h: np.ndarray, run: int, shingle: int) -> np.ndarray:
    """The MinHash of every window of `run` words over its shingles."""
    low = _rolled(h, shingle)
    span, width = run - shingle + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


class Windows:
    """The windows of texts given as words: at (place), low (MinHash) and text (which one) of each."""

    def __init__(self, texts: list[list[str]], run: int, shingle: int):
        self.run, self.flat, starts = run, [""], []
        for own in texts:
            starts.append(len(self.flat))
            self.flat += own
            self.flat.append("")  # no window goes beyond its text
        self.h = word_hashes(self.flat)
        gaps = np.concatenate(([0], np.cumsum(self.h == 0)))
        self.at = np.flatnonzero(gaps[run:] == gaps[:-run]) if len(self.flat) >= run else np.zeros(0, np.int64)
        self.low = _min_hashes(self.h, run, shingle)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.text = np.searchsorted(np.array(starts), self.at, "right") - 1
        self._keys: np.ndarray | None = None

    @property
    def keys(self) -> np.ndarray:
        if self._keys is None:
            self._keys = _rolled(self.h, self.run)
        return self._keys


def _expanded(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class ItemBlock:
    """A block of items: its distinct windows in the order of their keys, each with its items."""

    ARRAYS = ("ids", "place", "key", "first", "items")

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, shingle: int = SHINGLE):
        own = Windows([words(t) for _, t in items], run, shingle)
        self.run, self.words = run, {w: i for i, w in enumerate(dict.fromkeys(own.flat))}
        self.ids = np.array([self.words[w] for w in own.flat], np.int32)
        key = own.keys[own.at] if len(own.at) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        key, place, item = key[order], own.at[order], np.array([i for i, _ in items], np.int64)[own.text[order]]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (self._window(place[1:]) != self._window(place[:-1])).any(axis=1)
        pairs = np.unique(np.stack([np.cumsum(new) - 1, item], axis=1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
        self.key, self.place, self.items = key[new], place[new], pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.key) + 1))
        self.filter = np.zeros(max(64, 1 << math.ceil(math.log2(max(1, len(key) * FILTER_BITS)))) // 8, np.uint8)
        np.bitwise_or.at(self.filter, *_bits(self.filter, own.low))

    def _window(self, place: np.ndarray) -> np.ndarray:
        return self.ids[place[:, None] + np.arange(self.run)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        names = np.frombuffer("\n".join(self.words).encode("utf-8", "surrogatepass"), np.uint8)
        np.savez(out, names=names, run=self.run, **{a: getattr(self, a) for a in self.ARRAYS})
        return zlib.compress(out.getvalue(), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> "ItemBlock":
        own = cls.__new__(cls)
        with np.load(io.BytesIO(zlib.decompress(data)), allow_pickle=False) as held:
            for a in cls.ARRAYS:
                setattr(own, a, held[a])
            own.run, names = int(held["run"]), held["names"].tobytes().decode("utf-8", "surrogatepass")
        own.words = {w: i for i, w in enumerate(names.split("\n"))}
        return own

    def found(self, own: Windows, hit: np.ndarray) -> np.ndarray:
        """(text, window of the block), each once, of the texts' windows numbered in hit that are in the block."""
        keys = own.keys[own.at[hit]]
        a, n = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
        n = n - a
        row, hit = _expanded(a, n), np.repeat(hit, n)
        if not len(row):
            return np.zeros((0, 2), np.int64)
        place, get = own.at[hit], self.words.get
        ids, covered = np.full(len(own.flat), -1, np.int32), np.unique(place[:, None] + np.arange(self.run))
        ids[covered] = [get(own.flat[i], -1) for i in covered.tolist()]
        same = np.ones(len(row), bool)
        for k in range(self.run):
            same &= ids[place + k] == self.ids[self.place[row] + k]
        return np.unique(np.stack([own.text[hit[same]], row[same]], axis=1), axis=0)

    def pairs(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, windows of the item found in the text), some texts at a time; found is in the order of texts."""
        n = (self.first[1:] - self.first[:-1])[found[:, 1]]
        total, begin = np.cumsum(n), np.flatnonzero(np.diff(found[:, 0], prepend=-1))
        a = 0
        while a < len(found):  # whole texts; one text meets every entry of the block at most once
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right"))
            k = int(np.searchsorted(begin, b, "right")) - 1
            b = len(found) if b >= len(found) else int(begin[k]) if begin[k] > a else int(begin[k + 1]) if k + 1 < len(begin) else len(found)
            item = self.items[_expanded(self.first[found[a:b, 1]], n[a:b])]
            own, count = np.unique(np.stack([np.repeat(found[a:b, 0], n[a:b]), item], axis=1), axis=0, return_counts=True)
            yield own[:, 0], own[:, 1], count
            a = b


def _bits(held: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte and the bit of a filter that a MinHash sets."""
    spot = low & np.uint64(8 * len(held) - 1)
    return (spot >> np.uint64(3)).astype(np.int64), np.left_shift(1, (spot & np.uint64(7)).astype(np.uint8)).astype(np.uint8)


class Shelf:
    """The blocks in the shared folder, as one worker reads them: filters at once, blocks when they are met."""

    _own: dict[str, "Shelf"] = {}

    def __init__(self, path: str):
        self.path, self.blocks, self.held = path, OrderedDict(), []
        for block, bits in self._read():
            self.held.append((block, bits))
            if sum(len(b) for _, b in self.held) > KEPT_FILTERS:
                self.held = []
                break

    @classmethod
    def at(cls, path: str) -> "Shelf":
        if path not in cls._own:
            cls._own = {path: cls(path)}
        return cls._own[path]

    def _read(self) -> Iterator[tuple[int, np.ndarray]]:
        for part in ds.dataset(self.path, format="parquet").to_batches(columns=["block", "filter"], batch_size=16):
            for row in part.to_pylist():
                yield row["block"], np.frombuffer(row["filter"], np.uint8)

    def filters(self) -> Iterator[tuple[int, np.ndarray]]:
        return iter(self.held) if self.held else self._read()

    def block(self, number: int) -> ItemBlock:
        if number not in self.blocks:
            (row,) = ds.dataset(self.path, format="parquet").to_table(columns=["data"], filter=ds.field("block") == number).to_pylist()
            self.blocks[number] = ItemBlock.from_bytes(row["data"])
            if len(self.blocks) > KEPT_BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(number)
        return self.blocks[number]

    def found(self, own: Windows) -> Iterator[tuple[int, np.ndarray]]:
        """(block, its windows in the texts) of every block that is met."""
        for number, bits in self.filters():
            byte, bit = _bits(bits, own.low)
            hit = np.flatnonzero(bits[byte] & bit)
            if len(hit):
                yield number, self.block(number).found(own, hit)


def _sections(text: str, run: int) -> Iterator[list[str]]:
    """The words of a long text in sections, each beginning with the last run - 1 words of the one before."""
    own: list[str] = []
    for m in _WORD.finditer(text.lower()):
        own.append(m.group())
        if len(own) >= SECTION:
            yield own
            own = own[len(own) - run + 1 :]
    yield own


def item_blocks(items: DataFrame, id_col: str, text_col: str, run: int, shingle: int, block_bytes: int) -> str | None:
    """Write the items' blocks to the shared folder and give the place; None if there is no item with a text."""
    spark = items.sparkSession
    own = items.where(F.octet_length(text_col) > 0).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.floor(F.log2(F.octet_length(text_col))).cast("int").alias("step")).distinct()
    # some dozen rows: a step doubles the size
    totals = {r["step"]: math.ceil(r["n"] / block_bytes) for r in own.groupBy("step").agg(F.sum(F.octet_length("t")).alias("n")).collect()}
    if not totals:
        return None
    starts = dict(zip(sorted(totals), np.cumsum([0, *(totals[k] for k in sorted(totals))]).tolist()))
    pick = lambda values: F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v)))[F.col("step")]
    placed = own.select("i", "t", (pick(starts) + F.pmod(F.xxhash64("i"), pick(totals))).cast("int").alias("block"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        block = ItemBlock(list(zip(part["i"].tolist(), part["t"].tolist())), run, shingle)
        return pd.DataFrame({"block": [int(part["block"].iloc[0])], "filter": [block.filter.tobytes()], "data": [block.to_bytes()]})

    path = scratch(spark, "items")
    placed.repartition(min(sum(totals.values()), 4 * spark.sparkContext.defaultParallelism), "block").groupBy("block").applyInPandas(build, "block int, filter binary, data binary").write.parquet(path)
    return path


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", run: int = RUN, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id bigint, windows int): pairs with at least `run` consecutive words in common.

    Words are runs of letters, digits or underscores, case ignored; windows is the number of the item's distinct
    windows found. Null and empty texts and items of fewer words match nothing; repeated rows count once; empty
    tables give no rows. Every document is read once and where it lies: no shuffle before the found pairs.
    """
    schema = f"`{doc_id}` {type_of(docs, doc_id)}, `{item_id}` long, windows int"
    path = item_blocks(items, item_id, text_col, run, shingle, block_bytes)
    if path is None:
        return docs.sparkSession.createDataFrame([], schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf.at(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts, LONG_TEXT // 2):
                short, long = [t if t and len(t) <= LONG_TEXT else "" for t in texts[a:b]], [i for i in range(a, b) if texts[i] and len(texts[i]) > LONG_TEXT]
                met = [(number, found) for number, found in shelf.found(Windows([words(t) for t in short], run, shingle))]
                for i in long:
                    for own in _sections(texts[i], run):
                        met += [(number, np.unique(np.stack([np.full(len(f), i - a), f[:, 1]], axis=1), axis=0)) for number, f in shelf.found(Windows([own], run, shingle))]
                for number in dict.fromkeys(n for n, _ in met):
                    found = np.unique(np.concatenate([f for n, f in met if n == number]), axis=0)
                    for row, item, n in shelf.block(number).pairs(found):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int32())], [doc_id, item_id, "windows"])

    found = spread(docs.select(doc_id, text_col)).mapInArrow(search, schema)
    return found.groupBy(doc_id, item_id).agg(F.max("windows").alias("windows"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item that leaked: its split, the documents it leaked into and the most windows found in one."""
    items = table(spark, sf_dir, "eval_items")
    found = leaks(table(spark, sf_dir, "documents"), items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("windows").alias("most_windows"))
    return found.join(items.select("item_id", "split", "lang"), "item_id")


_WINDOWS_SQL = r"""iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw))"""

SQL = {
    "p9_found": f"WITH {_WINDOWS_SQL} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p9_items": f"""WITH {_WINDOWS_SQL}, c AS (SELECT doc_id, item_id, count(*) AS n FROM dg JOIN ig USING (g) GROUP BY ALL), f AS (SELECT item_id, count(*) AS n_documents, max(n)::INT AS most_windows FROM c GROUP BY item_id)
SELECT item_id, n_documents, most_windows, split, lang FROM f JOIN eval_items USING (item_id)""",
}
