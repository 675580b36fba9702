"""Problem 10: long exact spans shared between records, by content-defined chunking with a gear rolling hash.

Every window of `span` characters has one cut point: the place of the smallest gear hash (over 64 characters) inside
it. The windows with the same cut point follow each other and make one variable chunk, which therefore overlaps the next
one by span - 1 characters, so that no span of that length falls between two chunks. Cut points depend only on the
characters around them: insertions elsewhere move chunks but do not change them. Chunks are deduplicated by digest:

* a cut point of one document only ends there;
* a digest in two documents: all its windows are shared;
* chunks that differ at a cut point of several documents (the edges of a copied passage): their windows are compared in
  ever smaller blocks, where enough around the cut point is alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.plans.runtime import SMALL_ROWS, cut_lineage, if_small, portions, spread, table, type_of

SPAN, GEAR = 200, 64

#: Characters that are hashed at once, about; and the bits that number their places, the same for all batches, so that a
#: window chooses the same cut point wherever it stands.
BATCH_CHARS, PLACE_BITS = 1 << 19, 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    own = _POWERS.get(name)
    if own is None or len(own) < n:
        own = np.ones(max(n, BATCH_CHARS + 1), np.uint64)
        own[1:] = base
        _POWERS[name] = own = np.cumprod(own)
    return own[:n]


class Hashed:
    """Code points of texts, one after the other, with their rolling and prefix hashes."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.n = len(joined)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.mixed = _mix(points.astype(np.uint64) + np.uint64(0x51ED27))
        self.ends = np.cumsum([len(t) for t in texts])
        self._prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.mixed * _powers("up", _BASE, self.n), out=self._prefix[1:])

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit digest of each stretch, the same wherever it stands."""
        return _mix((self._prefix[end] - self._prefix[start]) * _powers("down", _INVERSE, self.n + 1)[start])

    def gear(self, size: int) -> np.ndarray:
        """The gear hash of the `size` characters (a power of two) that begin at each place."""
        g, width = self.mixed, 1
        while width < size and len(g) > width:
            g = (g[: len(g) - width] << np.uint64(width)) + g[width:]
            width *= 2
        return g if width == size else np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def chunk_texts(texts: list[str], span: int = SPAN, gear: int = GEAR, own: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, ...]:
    """(index of the text, cut hash, digest, start, windows, windows before the cut, digest left, digest right, sides).

    own: the first and the last window of each text to be chunked; all, if it is not given.

    The digests left and right are of the half = (span - gear) / 2 characters before and after the gear hash's own: a
    common window needs one of the two alike. Bit 1 of sides tells that the text has a left one, bit 2 a right one.
    """
    hashed = Hashed(texts)
    rolled = hashed.gear(gear)
    if hashed.n < span:
        return tuple(np.zeros(0, np.int64) for _ in range(9))
    if len(rolled) >> PLACE_BITS:
        raise ValueError("too many characters at once")
    bits = np.uint64(PLACE_BITS)
    ranked = (_mix(rolled) >> bits << bits) | np.arange(len(rolled), dtype=np.uint64)
    cut = (_sliding_min(ranked, span - gear + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(cut)]
    begins, ends = np.concatenate(([0], hashed.ends[:-1])), hashed.ends - span
    if own is not None:
        begins, ends = begins + np.array([x for x, _ in own]), begins + np.array([x for _, x in own])
    at_window = np.arange(len(cut))
    inside = (at_window >= begins[text]) & (at_window <= ends[text])
    new = np.ones(len(cut), bool)
    new[1:] = (cut[1:] != cut[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(9))
    owner = text[first]
    begin, end = np.concatenate(([0], hashed.ends[:-1]))[owner], hashed.ends[owner]
    # a chunk's windows end before the next chunk of the same text or with the text's last window
    last = np.minimum(np.append(first[1:] - 1, len(cut)), ends[owner])
    n, at = last - first + 1, cut[first]
    lead, half = at - first, (span - gear) // 2
    digest = hashed.digests(first, last + span) + n.astype(np.uint64) * _BASE + lead.astype(np.uint64)
    left, right = hashed.digests(np.maximum(begin, at - half), at), hashed.digests(at + gear, np.minimum(end, at + gear + half))
    sides = (at - half >= begin) + 2 * (at + gear + half <= end)
    return owner, rolled[at].view(np.int64), digest.view(np.int64), first - begin, n, lead, left.view(np.int64), right.view(np.int64), sides


def _sections(text: str, span: int, most: int) -> Iterator[tuple[int, str, int, int]]:
    """(origin, section, first window, last window) of a text: long ones in sections that see a span around their own."""
    last = len(text) - span
    for a in range(0, max(last, 0) + 1, most):
        b = min(a + most - 1, last)
        origin = max(0, a - span)
        yield origin, text[origin : b + 2 * span], a - origin, b - origin


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, span: int, gear: int, *, full: bool) -> DataFrame:
    """(doc, cut) of every chunk; full: also digest, place (start, windows, windows before the cut in one number), left
    and right (null where the text ends before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sections = [(i, *x) for i, t in enumerate(batch.column(1).to_pylist()) for x in _sections(t, span, BATCH_CHARS)]
            for a, b in portions([x[2] for x in sections], BATCH_CHARS):
                part = sections[a:b]
                row, cut, digest, start, n, lead, left, right, sides = chunk_texts([x[2] for x in part], span, gear, [x[3:] for x in part])
                columns = {"doc": batch.column(0).take(pa.array([part[k][0] for k in row], pa.int64())), "cut": pa.array(cut)}
                if full:
                    start = start + np.array([x[1] for x in part], np.int64)[row] if len(row) else start
                    place = (start << 20) | (n << 10) | lead
                    columns |= {"digest": pa.array(digest), "place": pa.array(place), "left": pa.array(left, mask=sides & 1 == 0), "right": pa.array(right, mask=sides & 2 == 0)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"doc {type_of(docs, id_col)}, cut long" + ", digest long, place long, left long, right long" * full
    return spread(docs.where(F.length(text_col) >= span).select(id_col, text_col)).mapInArrow(run, schema)


def _start(place: F.Column) -> F.Column:
    return F.shiftright(place, 20)


def _windows(place: F.Column) -> F.Column:
    return F.shiftright(place, 10).bitwiseAND(F.lit(1023))


def _stretch(rows: DataFrame, span: int) -> DataFrame:
    """(doc, start, end) of whole chunks."""
    place = F.col("place")
    return rows.select("doc", _start(place).alias("start"), (_start(place) + _windows(place) - 1 + span).alias("end"))


def _cut_out(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(doc, cut, many, start, n, lead, text): the wanted chunks of each document, cut out of its text in one go."""
    rows = docs.where(F.length(text_col) >= span).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc").select("doc", "text", "wanted")
    kinds = {"doc": type_of(docs, id_col), "cut": "long", "many": "boolean", "start": "long", "n": "long", "lead": "long", "text": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, own = batch.column(1)[i].as_py(), batch.column(2)[i].values
                for at in range(0, len(own), 20_000):
                    part = own.slice(at, 20_000).flatten()
                    place = part[1].to_numpy()
                    start, n = place >> 20, place >> 10 & 1023
                    cuts = [text[a:b] for a, b in zip(start.tolist(), (start + n - 1 + span).tolist())]
                    columns = [batch.column(0).take(pa.array(np.full(len(cuts), i))), part[0], part[2], pa.array(start), pa.array(n), pa.array(place & 1023), pa.array(cuts, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, list(kinds))

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def shared_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gear: int = GEAR, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(doc, start, end): places, as code points, of stretches of `span` or more characters found in another document.

    Stretches of one document may overlap or touch. Characters count exactly as they stand. Null and short texts have
    none; a stretch repeated only inside one document is none; rows with the same id are one document; empty tables
    give no rows. span may be up to 1,000 and must exceed gear, a power of two.

    The texts are hashed twice rather than stored: once for the cut points, combined before their shuffle, and once for
    the chunks at cut points of several documents.
    """
    if not gear < span <= 1000:
        raise ValueError("gear < span <= 1000 is needed")
    cuts = chunk_rows(docs, id_col, text_col, span, gear, full=False).groupBy("cut").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("cut")
    met = cut_lineage(chunk_rows(docs, id_col, text_col, span, gear, full=True).join(if_small(cuts, small_rows), "cut"))

    # digests of two documents are shared as a whole
    kinds = met.groupBy("cut", "digest").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min(F.struct("doc", "place")).alias("one"))
    many = cut_lineage(kinds.where("a < b").select("cut", "digest", "one"))
    whole = _stretch(met.join(many, ["cut", "digest"], "left_semi"), span)

    # the other chunks ask for their windows, if half of what a common window needs is alike in two documents; of each
    # shared digest one copy answers
    rest = met.join(many, ["cut", "digest"], "left_anti")
    asked = []
    for side in ("left", "right"):
        alike = met.where(F.col(side).isNotNull()).groupBy("cut", side).agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("cut", side)
        asked.append(rest.join(alike, ["cut", side], "left_semi").select("doc", "cut", "place"))
    asked = cut_lineage(asked[0].unionByName(asked[1]).distinct())
    answers = many.join(asked.select("cut").distinct(), "cut", "left_semi").select("one.doc", "cut", "one.place", F.lit(True).alias("many"))
    requests = cut_lineage(asked.withColumn("many", F.lit(False)).unionByName(answers))
    wanted = requests.groupBy("doc").agg(F.collect_list(F.struct("cut", "place", "many")).alias("wanted"))
    wanted = F.broadcast(wanted) if requests.count() <= small_rows else wanted
    chunks = cut_lineage(_cut_out(docs, wanted, id_col, text_col, span))
    return whole.unionByName(_compared(chunks, span, gear))


def _compared(chunks: DataFrame, span: int, gear: int) -> DataFrame:
    """(doc, start, end) of the stretches of asking chunks that also occur in another document's chunk.

    A window is named by the distance from its start to the cut point. Blocks of 64, then 8, then 1 windows are compared:
    what all windows of a block have in common (its core) must occur in two documents, else the block is done with; if all
    of its text does, all its windows are shared. Only blocks between the two go on, cut finer; shared ones go on with one
    copy that answers the others.
    """
    steps = [s for s in (64, 8, 1) if s == 1 or s <= (span - gear + 1) // 2]
    lead, low = F.col("lead"), F.col("lead") - F.col("n") + 1
    blocks = F.transform(F.sequence(F.floor(low / steps[0]), F.floor(lead / steps[0])), lambda k: F.struct(k.alias("k"), F.col("many").alias("many")))
    rows, found = chunks.withColumn("own", blocks), []
    for size, finer in zip(steps, [*steps[1:], None]):
        each = rows.select("doc", "cut", "start", "n", "lead", "text", F.explode("own").alias("o")).select("doc", "cut", "start", "n", "lead", "text", "o.k", "o.many")
        first, last = F.col("k") * size, F.col("k") * size + size - 1
        a, b = F.greatest(first, low), F.least(last, lead)
        core = F.xxhash64(F.substring("text", lead - first + 1, F.lit(span - size + 1)))
        full = F.when((a == first) & (b == last), F.xxhash64(F.substring("text", lead - last + 1, F.lit(span + size - 1))))
        pieces = cut_lineage(each.select("doc", "cut", "start", "k", "many", core.alias("core"), full.alias("full"), (F.col("start") + lead - b).alias("from"), (F.col("start") + lead - a + span).alias("end")))
        two = lambda by: pieces.groupBy("cut", "k", by).agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.max("many").alias("m"), F.min("many").alias("all_many"))
        alive = two("core").where("not all_many and (x < y or m)").select("cut", "k", "core")
        live = pieces.join(alive, ["cut", "k", "core"], "left_semi")
        if finer is None:
            found.append(live.where("not many"))
            break
        live = cut_lineage(live)
        shared = live.where("full is not null").groupBy("cut", "k", "full").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.max("many").alias("m"), F.min(F.struct("doc", "start")).alias("one")).where("x < y or m")
        shared = cut_lineage(shared.select("cut", "k", "full", "one"))
        found.append(live.where("not many").join(shared.select("cut", "k", "full"), ["cut", "k", "full"], "left_semi"))
        open_ = live.join(shared.select("cut", "k", "full"), ["cut", "k", "full"], "left_anti").select("doc", "start", "k", "many")
        onward = open_.unionByName(shared.select("one.doc", "one.start", "k", F.lit(True).alias("many")))
        children = F.flatten(F.collect_list(F.transform(F.sequence(F.col("k") * (size // finer), (F.col("k") + 1) * (size // finer) - 1), lambda k: F.struct(k.alias("k"), F.col("many").alias("many")))))
        onward = onward.groupBy("doc", "start").agg(children.alias("own"))
        inside = F.filter("own", lambda o: (o["k"] * finer <= lead) & (o["k"] * finer + finer - 1 >= low))
        rows = chunks.drop("many").join(onward, ["doc", "start"]).withColumn("own", inside)
    parts = [f.select("doc", F.col("from").alias("start"), "end") for f in found]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def shared_length(spans: DataFrame) -> DataFrame:
    """(doc, shared int): characters of each document inside at least one span; the spans of a document are its own."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end")))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))

    def add(state: F.Column, x: F.Column) -> F.Column:
        fresh = F.greatest(x["start"], state["end"])
        return F.struct((state["sum"] + F.greatest(F.lit(0).cast("long"), x["end"] - fresh)).alias("sum"), F.greatest(state["end"], x["end"]).alias("end"))

    return spans.groupBy("doc").agg(F.aggregate(ordered, zero, add, lambda s: s["sum"]).cast("int").alias("shared"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc, start, end): the spans of each document, those that overlap or touch as one."""
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("_far", F.max("end").over(before)).withColumn("_new", F.coalesce(F.col("start") > F.col("_far"), F.lit(True)).cast("int"))
    numbered = fresh.withColumn("_island", F.sum("_new").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_length(shared_spans(table(spark, sf_dir, "documents"))).select(F.col("doc").alias("doc_id"), F.col("shared").alias("shared_chars"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared stretches of every document, from start (counted from 0) up to end."""
    return merged_spans(shared_spans(table(spark, sf_dir, "documents"))).select(F.col("doc").alias("doc_id"), "start", "end")


_HITS_SQL = """w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
common AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),"""

SQL = {
    "p10_found": f"""WITH {_HITS_SQL}
hits AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM w SEMI JOIN common USING (h))
SELECT doc_id, sum(least(200, coalesce(following - i, 200)))::INT AS shared_chars FROM hits GROUP BY doc_id""",
    "p10_spans": f"""WITH {_HITS_SQL}
hits AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, TRUE)::INT AS fresh FROM w SEMI JOIN common USING (h)),
islands AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM hits)
SELECT doc_id, min(i) - 1 AS start, max(i) + 199 AS "end" FROM islands GROUP BY doc_id, island""",
}
