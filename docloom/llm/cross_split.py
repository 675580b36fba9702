"""Problem 1: the same or nearly the same records across splits.

The passages of the evaluation splits make compressed full-text indexes (FM-indexes over words), one per shard. Training
records are streamed through backward search. Each three-word sequence of a training record has an interval in the
index, whose width is its count there; sequences that follow each other merge into maximal matches. A record whose
sequences occur too rarely in a shard cannot overlap any record of it; for the others, the rarest sequences are located
and the overlaps counted exactly.

Shards hold evidence of similar size, so that a record meets only shards of its own and the neighbouring sizes; of these,
a filter over the shard's sequences tells which records can reach the share there, and only they are searched.
"""

from __future__ import annotations

import io
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.hashes import MULT, mix, word_hashes
from docloom.plans.runtime import cut_lineage, scratch, spread, table

SHARE = 0.7
GRAM = 3

#: Words of one index shard (about 13 bytes each in memory) and of the training block searched at a time.
SHARD_WORDS, BLOCK_WORDS = 1_000_000, 1_000_000

#: Bits of a shard's filter per sequence, at least.
FILTER_BITS = 8

_WORDS = re.compile(r"[^\W_]+").findall


def passage_words(passages: list[str | None] | None) -> list[list[str]]:
    return [_WORDS(p.lower()) for p in passages or [] if p]


class Block:
    """Records side by side: their words, and the distinct three-word sequences of each by 64-bit hashes.

    flat: all words, '' after each passage; owner: the record of each place. of, at, gram: of every record (ascending) and
    distinct sequence, the record, a place where it begins and its hash; sizes: their number per record.
    """

    def __init__(self, records: list[list[list[str]]]):
        self.flat: list[str] = []
        lengths, whose = [], []
        for r, passages in enumerate(records):
            for p in passages:
                self.flat += p
                self.flat.append("")
                lengths.append(len(p) + 1)
                whose.append(r)
        self.n = len(records)
        self.owner = np.repeat(np.array(whose, np.int64), np.array(lengths, np.int64))
        h = word_hashes(self.flat)
        n = max(0, len(h) - GRAM + 1)
        gram, whole = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(GRAM):
            gram = gram * MULT + h[k : k + n]
            whole &= h[k : k + n] != 0
        at = np.flatnonzero(whole)
        gram = mix(gram[at])
        own = self.owner[at]
        first = np.sort(np.unique(gram + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)[1])
        self.of, self.at, self.gram = own[first], at[first], gram[first]
        self.sizes = np.bincount(self.of, minlength=self.n).astype(np.int64)

    def signs(self) -> list[bytes | None]:
        """16 bytes per record that are the same for the same set of sequences; None where there is none."""
        out: list[bytes | None] = [None] * self.n
        begin = np.flatnonzero(np.diff(self.of, prepend=-1))
        if len(begin):
            sums = np.stack([np.add.reduceat(mix(self.gram * m), begin) for m in (MULT, np.uint64(0xC2B2AE3D27D4EB4F))], axis=1)
            for r, own in zip(self.of[begin], np.ascontiguousarray(sums)):
                out[r] = own.tobytes()
        return out

    def part(self, records: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(words, owner, record of each distinct sequence, its place) of some records, numbered as in the block."""
        chosen = np.zeros(self.n + 1, bool)
        chosen[records] = True
        places = np.flatnonzero(chosen[self.owner])
        moved = np.full(len(self.flat), -1, np.int64)
        moved[places] = np.arange(len(places))
        own = chosen[self.of]
        return [self.flat[i] for i in places.tolist()], self.owner[places], self.of[own], moved[self.at[own]]


class FmIndex:
    """FM-index of word sequences: suffixes sorted, the transform, counts per word and the record of each suffix."""

    def __init__(self, records: list[list[list[str]]], bits: int = FILTER_BITS):
        self.words: dict[str, int] = {}
        block = Block(records)
        number = self.words.setdefault
        flat = [number(w, len(self.words) + 2) if w else 1 for w in block.flat]
        text = np.array([*flat, 0], np.int64)
        suffixes = self._suffix_array(text)
        self._index(text[suffixes - 1])
        self.owner = np.append(block.owner, -1).astype(np.int32)[suffixes]
        self.sizes = block.sizes
        self.filter = np.zeros(max(64, 1 << math.ceil(math.log2(max(1, len(block.gram) * bits)))) // 8, np.uint8)
        np.bitwise_or.at(self.filter, *self._bit(block.gram))

    def _bit(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte and the bit of the filter that a sequence sets."""
        spot = gram & np.uint64(8 * len(self.filter) - 1)
        return (spot >> np.uint64(3)).astype(np.int64), np.left_shift(1, (spot & np.uint64(7)).astype(np.uint8)).astype(np.uint8)

    def may_hold(self, gram: np.ndarray) -> np.ndarray:
        """False only for sequences that are not in the index."""
        byte, bit = self._bit(gram)
        return self.filter[byte] & bit != 0

    def _index(self, transform: np.ndarray) -> None:
        """Counts and ranks: for each word the sorted places where it stands in the transform, all in one array."""
        self.n = len(transform)
        symbols = int(transform.max()) + 1
        order = np.argsort(transform, kind="stable")
        self.keys = transform[order] * (self.n + 1) + order
        self.first = np.searchsorted(self.keys, np.arange(symbols + 1) * (self.n + 1))

    @staticmethod
    def _suffix_array(text: np.ndarray) -> np.ndarray:
        rank, width, n = text, 1, len(text)
        while True:
            second = np.full(n, -1, np.int64)
            second[: n - width] = rank[width:] if width < n else rank[:0]
            key = rank * (n + 2) + second + 1 if width > 1 or rank.max() < n + 2 else None
            if key is None:
                rank = np.unique(rank, return_inverse=True)[1]
                continue
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            rank, width = new, width * 2
            if rank[order[-1]] == n - 1 or width >= n:
                return order

    def to_bytes(self) -> bytes:
        """The index as plain arrays; the ranks as the places of each word, four bytes each."""
        out = io.BytesIO()
        symbol = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        names = np.frombuffer("\n".join(self.words).encode("utf-8", "surrogatepass"), np.uint8)
        np.savez(out, names=names, places=(self.keys - symbol * (self.n + 1)).astype(np.int32), first=self.first, owner=self.owner, sizes=self.sizes, filter=self.filter)
        return zlib.compress(out.getvalue(), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> "FmIndex":
        own = cls.__new__(cls)
        with np.load(io.BytesIO(zlib.decompress(data)), allow_pickle=False) as held:
            own.first, own.owner, own.sizes, own.filter, places = (held[k] for k in ("first", "owner", "sizes", "filter", "places"))
            names = held["names"].tobytes().decode("utf-8", "surrogatepass")
        own.words = {w: i + 2 for i, w in enumerate(names.split("\n") if names else [])}
        own.n = len(places)
        own.keys = np.repeat(np.arange(len(own.first) - 1), np.diff(own.first)) * (own.n + 1) + places
        return own

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals: those of the symbol followed by what they stood for."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def intervals(self, ids: np.ndarray, at: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the `size` words beginning at each of the places (empty where a word is unknown: id 1 or less).

        Sequences that occur more than once among the places are searched once.
        """
        low, high, live = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(size):
            live &= ids[at + k] > 1
        kept, code, span = np.flatnonzero(live), np.zeros(live.sum(), np.int64), len(self.words) + 2
        for k in reversed(range(size)):
            _, code = np.unique(code * span + ids[at[kept] + k], return_inverse=True)
        _, one, code = np.unique(code, return_index=True, return_inverse=True)
        begin = at[kept[one]]
        a, b, alive = np.zeros(len(one), np.int64), np.full(len(one), self.n, np.int64), np.arange(len(one))
        for k in reversed(range(size)):
            a[alive], b[alive] = self.step(ids[begin[alive] + k], a[alive], b[alive])
            alive = alive[a[alive] < b[alive]]
        there = np.zeros(len(one), bool)
        there[alive] = True
        kept, code = kept[there[code]], code[there[code]]
        low[kept], high[kept] = a[code], b[code]
        return low, high


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _least(sizes: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(share * sizes - 1e-9).astype(np.int64)


def search(index: FmIndex, block: Block, share: float = SHARE, *, maximal: bool = True) -> list[tuple[int, int, int, int, int, int]]:
    """[(record of the block, record of the index, common sequences, matches, longest match, words matched)].

    The last three, those of the maximal matches, are 0 unless maximal is asked for.
    """
    sizes, least = block.sizes, _least(block.sizes, share)
    fits = (sizes > 0) & (least <= index.sizes.max(initial=0)) & (sizes >= _least(index.sizes, share).min(initial=0))
    tried = fits[block.of]
    maybe = np.bincount(block.of[tried][index.may_hold(block.gram[tried])], minlength=block.n)
    able = np.flatnonzero(fits & (maybe >= least))
    if not len(able):
        return []
    flat, owner, rec, at = block.part(able)
    get = index.words.get
    ids = np.array([get(w, 0) if w else 1 for w in flat], np.int64)
    start, high = index.intervals(ids, at)
    # one row per record and distinct sequence that occurs, rarest first within the record
    there = np.flatnonzero(high > start)
    rec, start, count = rec[there], start[there], (high - start)[there]
    have = np.bincount(rec, minlength=block.n)
    keep = (have >= least)[rec]
    rec, start, count = rec[keep], start[keep], count[keep]
    if not len(rec):
        return []
    order = np.lexsort((start, count, rec))
    rec, start, count = rec[order], start[order], count[order]
    # A record sharing `least` of all sequences shares `part` of the rarest size - least + part; absent ones are rarest.
    part = np.minimum(least, np.maximum(1, (0.3 * sizes).astype(np.int64)))
    taken = sizes - least + part - (sizes - have)
    begin = np.searchsorted(rec, rec)
    probe = np.arange(len(rec)) - begin < taken[rec]
    pair, common = _count_pairs(index, rec[probe], start[probe], count[probe])
    good = common >= part[pair // len(index.sizes)]
    pair = pair[good]
    # exact counts for the remaining candidates, from the located sequences of their records
    wanted = np.isin(rec, pair // len(index.sizes))
    every, common = _count_pairs(index, rec[wanted], start[wanted], count[wanted], only=np.sort(pair))
    r, e = every // len(index.sizes), every % len(index.sizes)
    most = np.maximum(sizes[r], index.sizes[e])
    good = common >= np.ceil(share * most - 1e-9)
    r, e, common = r[good], e[good], common[good]
    own = _maximal(index, ids, owner, np.unique(r), block.n) if maximal else np.zeros((3, block.n), np.int64)
    return list(zip(r.tolist(), e.tolist(), common.tolist(), *(x[r].tolist() for x in own)))


def _count_pairs(index: FmIndex, rec: np.ndarray, start: np.ndarray, count: np.ndarray, only: np.ndarray | None = None, most: int = 20_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (record * records of the index + record of the index) with the number of their distinct common sequences."""
    pairs, counts, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    edges = np.flatnonzero(np.diff(rec)) + 1
    total = np.concatenate(([0], np.cumsum(count)))
    while a < len(rec):  # whole records at a time, about `most` located places together
        b = int(np.searchsorted(total, total[a] + most, "right")) - 1
        k = int(np.searchsorted(edges, b, "right")) - 1
        b = len(rec) if b >= len(rec) else int(edges[k]) if k >= 0 and edges[k] > a else int(edges[np.searchsorted(edges, a, "right")]) if np.searchsorted(edges, a, "right") < len(edges) else len(rec)
        n = count[a:b]
        pair = np.repeat(rec[a:b], n) * len(index.sizes) + index.owner[_ranges(start[a:b], n)]
        which = np.repeat(np.arange(b - a), n)
        if only is not None:
            there = only[np.minimum(np.searchsorted(only, pair), len(only) - 1)] == pair if len(only) else np.zeros(len(pair), bool)
            pair, which = pair[there], which[there]
        order = np.lexsort((which, pair))
        pair, which = pair[order], which[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (which[1:] != which[:-1])  # a sequence may stand twice in a record
        p, c = np.unique(pair[fresh], return_counts=True)
        pairs.append(p)
        counts.append(c)
        a = b
    return np.concatenate(pairs), np.concatenate(counts)


def _maximal(index: FmIndex, ids: np.ndarray, owner: np.ndarray, records: np.ndarray, n: int) -> np.ndarray:
    """For each of n records, if asked for: maximal matches with the whole shard, words of the longest, words in any.

    Matches are grown to the left from every place; the steps of all places together are as many as their lengths.
    """
    chosen = np.zeros(n, bool)
    chosen[records] = True
    end = np.flatnonzero(chosen[owner] & (ids > 1))
    length, at = np.zeros(len(ids), np.int64), end.copy()
    a, b, live = np.zeros(len(end), np.int64), np.full(len(end), index.n, np.int64), np.arange(len(end))
    while len(live):
        a, b = index.step(ids[at[live]], a, b)
        grown = a < b
        live, a, b = live[grown], a[grown], b[grown]
        length[end[live]] += 1
        at[live] -= 1
        more = (at[live] >= 0) & (ids[at[live]] > 1)
        live, a, b = live[more], a[more], b[more]
    # the longest match ending at a place is maximal if the one ending at the next place is not one longer
    longer = np.append(length[1:] == length[:-1] + 1, False)
    top = np.flatnonzero((length >= GRAM) & ~longer)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner[top], length[top])
    size = len(ids) + 1
    inside = np.cumsum(np.bincount(top - length[top] + 1, minlength=size) - np.bincount(top + 1, minlength=size))[:-1] > 0
    return np.stack([np.bincount(owner[top], minlength=n), longest, np.bincount(owner[inside], minlength=n)])


_PASSAGES = "transform(concat(coalesce({a}, array()), coalesce({b}, array())), x -> x.passage)"


def _signed(records: DataFrame, id_col: str) -> DataFrame:
    """(id, is_train, sign, size, words, passages) of records with a sequence; sign is the same for the same sequences."""
    rows = spread(records.where("split is not null").select(F.col(id_col).alias("id"), (F.col("split") == "train").alias("is_train"), F.expr(_PASSAGES.format(a="evidence_a", b="evidence_b")).alias("passages")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                passages = [[w for w in passage_words(p) if len(w) >= GRAM] for p in part.column(2).to_pylist()]
                block = Block(passages)
                plain = pa.array([[" ".join(w) for w in p] for p in passages], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(block.signs(), pa.binary()), pa.array(block.sizes), pa.array([sum(map(len, p)) for p in passages], pa.int64()), plain], ["id", "is_train", "sign", "size", "words", "passages"])

    return rows.mapInArrow(run, "id long, is_train boolean, sign binary, size long, words long, passages array<string>").where("sign is not null")


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("sign")
    index = FmIndex([[p.split(" ") for p in passages] for passages in shard["passages"]])
    row = {k: [int(shard[k].iloc[0])] for k in ("step", "part")}
    return pd.DataFrame(row | {"low": [int(shard["size"].min())], "high": [int(shard["size"].max())], "signs": [b"".join(shard["sign"])], "data": [index.to_bytes()]})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, list[list[str]]]]]:
    block, size = [], 0
    for batch in batches:
        for sign, passages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = [p.split(" ") for p in passages]
            block.append((sign, words))
            size += sum(map(len, words))
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


def near_same(records: DataFrame, *, id_col: str = "record_no", share: float = SHARE, maximal: bool = True, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, matches): members (id, is_train, sign), one row per record with evidence; matches (train, other, common,
    matches, longest, matched), one row per pair of distinct evidences of a train and another record that overlap.

    Records with the same sequences share a sign and are searched once, however many they are. Shards hold evidence of one
    step of sizes (1 / share from one to the next), hashed into parts of about shard_words. A training block reads the
    shards one after the other from the shared folder and passes over those whose sizes or filter exclude it, so memory
    holds one shard and one block.
    """
    spark = records.sparkSession
    signed = cut_lineage(_signed(records, id_col))
    kinds = signed.groupBy("is_train", "sign").agg(F.min_by("passages", "id").alias("passages"), F.first("words").alias("words"), F.first("size").alias("size"))
    step = F.floor(F.log("size") / -math.log(share) + 1e-9).cast("int")
    other = kinds.where("not is_train").withColumn("step", step)
    # some dozen rows: sizes grow by a factor from step to step
    totals = {r["step"]: r["n"] for r in signed.where("not is_train").groupBy(step.alias("step")).agg(F.sum("words").alias("n")).collect()}
    members = signed.select("id", "is_train", "sign")
    schema = "train binary, other binary, common int, matches int, longest int, matched int"
    if not totals:
        return members, spark.createDataFrame([], schema)
    parts = F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, math.ceil(n / shard_words))))[F.col("step")]
    keyed = other.withColumn("part", F.pmod(F.xxhash64("sign"), parts).cast("int"))
    path = scratch(spark, "index")
    shards = sum(math.ceil(n / shard_words) for n in totals.values())
    keyed.repartition(shards, "step", "part").groupBy("step", "part").applyInPandas(_build, "step int, part int, low long, high long, signs binary, data binary").write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _blocks(batches):
            block = Block([w for _, w in own])
            low, high = int(_least(block.sizes, share).min()), int(block.sizes.max() / share + 1)
            wanted = (ds.field("high") >= low) & (ds.field("low") <= high)
            for shard in ds.dataset(path, format="parquet").to_batches(filter=wanted, batch_size=1, batch_readahead=0, fragment_readahead=1):
                for row in shard.to_pylist():
                    index, signs = FmIndex.from_bytes(row["data"]), row["signs"]
                    found = search(index, block, share, maximal=maximal)
                    columns = list(zip(*found)) if found else [()] * 6
                    arrays = [pa.array([own[i][0] for i in columns[0]], pa.binary()), pa.array([signs[16 * e : 16 * e + 16] for e in columns[1]], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(list(c), pa.int32()) for c in columns[2:])], ["train", "other", "common", "matches", "longest", "matched"])

    return members, spread(kinds.where("is_train")).sortWithinPartitions("size").select("sign", "passages").mapInArrow(run, schema)


def overlaps(records: DataFrame, *, id_col: str = "record_no", share: float = SHARE, maximal: bool = True) -> DataFrame:
    """(train_no, other_no, same_id, same_text boolean, matches, longest, matched int): all overlaps of train records
    with records of other splits, by pair_id (ignoring case and outer blanks) or by nearly the same evidence.

    Null ids and evidence without three words equal nothing; a record without split takes no part; repeated records
    pair each; empty tables give no rows. matches, longest and matched are the maximal matches of the training record
    with the index shard (their number, the longest and the words in any of them), null for pairs by id only, 0 if not
    asked for.
    """
    key = F.lower(F.regexp_replace("pair_id", r"(?U)^\s+|\s+$", ""))
    ids = records.where("split is not null and pair_id is not null").select(F.col(id_col).alias("no"), (F.col("split") == "train").alias("is_train"), key.alias("key"))
    left, right = ids.where("is_train").select("key", F.col("no").alias("train_no")), ids.where("not is_train").select("key", F.col("no").alias("other_no"))
    by_id = left.join(right, "key").select("train_no", "other_no", F.lit(True).alias("same_id"), F.lit(False).alias("same_text"), *(F.lit(None).cast("int").alias(c) for c in ("matches", "longest", "matched")))
    members, matches = near_same(records, id_col=id_col, share=share, maximal=maximal)
    train = members.where("is_train").select(F.col("sign").alias("train"), F.col("id").alias("train_no"))
    other = members.where("not is_train").select(F.col("sign").alias("other"), F.col("id").alias("other_no"))
    by_text = matches.join(train, "train").join(other, "other").select("train_no", "other_no", F.lit(False).alias("same_id"), F.lit(True).alias("same_text"), "matches", "longest", "matched")
    return by_id.unionByName(by_text).groupBy("train_no", "other_no").agg(F.max("same_id").alias("same_id"), F.max("same_text").alias("same_text"), *(F.max(c).alias(c) for c in ("matches", "longest", "matched")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "labelled_pairs"), maximal=False)
    return found.select(F.least("train_no", "other_no").alias("record_no_1"), F.greatest("train_no", "other_no").alias("record_no_2"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and issuing body of regime_a: the records that overlap training, and the pairs by id and by evidence."""
    records = table(spark, sf_dir, "labelled_pairs")
    named = records.select(F.col("record_no").alias("other_no"), "split", F.nullif(F.lower(F.trim("regime_a.issuing_body")), F.lit("")).alias("issuing_body"))
    return overlaps(records, maximal=False).join(named, "other_no").groupBy("split", "issuing_body").agg(F.count_distinct("other_no").alias("n_records"), F.count(F.lit(1)).alias("n_pairs"), F.count_if("same_id").alias("by_id"), F.count_if("same_text").alias("by_text"))


def p1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per training record with overlapping evidence: the maximal matches with evaluation evidence of about its size."""
    found = overlaps(table(spark, sf_dir, "labelled_pairs")).where("same_text")
    return found.groupBy(F.col("train_no").alias("record_no")).agg(F.count(F.lit(1)).alias("n_records"), *(F.max(c).alias(c) for c in ("matches", "longest", "matched")))


_PAIRS_SQL = r"""recs AS (SELECT record_no, split, nullif(lower(trim(regime_a.issuing_body)), '') AS issuing_body, split = 'train' AS is_train, lower(trim(pair_id)) AS key, list_transform(list_concat(coalesce(evidence_a, []), coalesce(evidence_b, [])), lambda e: regexp_extract_all(lower(e.passage), '[\p{L}\p{N}]+')) AS ps FROM labelled_pairs WHERE split IS NOT NULL),
ws AS (SELECT record_no, is_train, unnest(ps) AS w FROM recs),
grams AS (SELECT DISTINCT record_no, is_train, g FROM (SELECT record_no, is_train, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g FROM ws WHERE len(w) >= 3)),
sizes AS (SELECT record_no, count(*) AS n FROM grams GROUP BY record_no),
common AS (SELECT a.record_no AS t, b.record_no AS o, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.is_train AND NOT b.is_train GROUP BY ALL),
near AS (SELECT t, o FROM common JOIN sizes x ON t = x.record_no JOIN sizes y ON o = y.record_no WHERE c * 10 >= 7 * greatest(x.n, y.n)),
ids AS (SELECT a.record_no AS t, b.record_no AS o FROM recs a JOIN recs b ON a.key = b.key AND a.is_train AND NOT b.is_train)"""

SQL = {
    "p1_found": f"WITH {_PAIRS_SQL} SELECT least(t, o) AS record_no_1, greatest(t, o) AS record_no_2 FROM (SELECT * FROM near UNION SELECT * FROM ids)",
    "p1_report": f"""WITH {_PAIRS_SQL}, pairs AS (SELECT t, o, max(i) AS i, max(n) AS n FROM (SELECT t, o, FALSE AS i, TRUE AS n FROM near UNION ALL SELECT t, o, TRUE, FALSE FROM ids) GROUP BY ALL)
SELECT split, issuing_body, count(DISTINCT o) AS n_records, count(*) AS n_pairs, count(*) FILTER (i) AS by_id, count(*) FILTER (n) AS by_text FROM pairs JOIN recs ON o = record_no GROUP BY ALL""",
}
