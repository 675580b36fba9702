"""Each operator on small fixtures: brute force, round trips, nulls, empty and long texts, ties, repeats, empty tables and
extra columns with clashing names."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import bpe, consensus, cross_split, encode, grouped_splits, leaks, repeated_lines, scanned_pages, shared_spans, split_oversized, token_budget

CLASHING = ["doc", "cut", "digest", "place", "ids", "windows", "source", "cluster", "row", "line", "node", "root", "u", "v", "item", "person", "label", "sign", "token_count", "_row", "_piece", "left", "key", "n", "is_train"]


def clashing(df):
    """The table with columns that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteBpe(bpe.model_from_file())


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(bpe.DEFAULT_VOCAB, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


SAMPLES = ["", " ", "\n\n \t x", "don't we'll I'M", "<|endoftext|> text", "naïve 日本語 текст  x", "\x00\x1c\x1f\x7f a\x85b", "a" * 5000, "12345 6 ½²", "\r\n\r\n", "😀👍🏽 é́", "x  \n  y   "]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_public_encoder(encoder, reference, text):
    ids, sizes = encoder.encode_batch([text])
    assert ids == reference(text) and sizes == [len(ids)]
    assert encoder.decode(ids) == text


@pytest.mark.parametrize("text", SAMPLES)
def test_encoding_samples(encoder, reference, text):
    assert encoder.encode_batch([text])[0] == reference(text)
    assert "".join(bpe.pretokens(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 .\n' é", max_size=120), st.integers(1, 20))
def test_pieces_are_independent(encoder, text, size):
    pieces = bpe.independent_pieces(text, size)
    assert "".join(pieces) == text
    assert sum(encoder.count_batch(pieces)) == encoder.count_batch([text])[0]


def test_encode_and_decode_tables(spark):
    docs = clashing(spark.createDataFrame([(1, None), (2, ""), *((i + 3, t) for i, t in enumerate(SAMPLES)), (3, SAMPLES[0])], "doc_id long, text string"))
    ids = encode.encode_corpus(docs)
    got = {r["doc_id"]: r["text"] for r in encode.decode_corpus(ids).collect()}
    assert ids.count() == docs.count() and got[1] == "" and [got[i + 3] for i in range(len(SAMPLES))] == SAMPLES
    assert encode.encode_corpus(docs.limit(0)).collect() == []


def test_counts_of_long_texts_are_exact(spark, encoder):
    texts = [None, "", "word " * 3000, "字" * 5000, "short", "word " * 3000]
    df = clashing(spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "chunk_no long, text string").drop(*[]))
    df = df.drop("_row", "_piece", "token_count")
    got = sorted((r["chunk_no"], r["token_count"]) for r in token_budget.count_tokens(df, keep=["chunk_no"], long_chars=100).collect())
    assert got == sorted((i // 2, encoder.count_batch([t])[0]) for i, t in enumerate(texts))
    assert token_budget.count_tokens(df.limit(0), keep=["chunk_no"]).collect() == []


def test_wrong_counts(spark, encoder):
    text = "one two three four five six"
    n = encoder.count_batch([text])[0]
    rows = [(1, n, text), (2, None, text), (3, 0, text), (4, 2 * n, text), (5, 2 * n + 1, text), (6, n // 2, text), (7, (n - 1) // 2, text), (8, None, " \n"), (9, None, None)]
    df = clashing(spark.createDataFrame(rows, "chunk_no long, n_tokens int, text string"))
    assert {r[0] for r in token_budget.wrong_counts(df).collect()} == {2, 3, 5, 7}


TEXTS = ["word " * 1500, "One sentence here. " * 300, "line of text\n" * 400, "x" * 9000, "字" * 3000, "a, b; c: " * 700, "Para one. Two!\n\n" * 200, "😀" * 700]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_fit_and_cover(encoder, text):
    pieces, _ = split_oversized.split_text(text, encoder)
    assert "".join(p[shared:] for p, _, shared, _, _ in pieces) == text
    assert all(n <= 400 for _, n, *_ in pieces) and len(pieces) > 1
    for (before, *_), (p, _, shared, start, _) in zip(pieces, pieces[1:]):
        assert before.endswith(p[:shared]) and text[start : start + len(p)] == p
        assert 38 <= encoder.count_batch([p[:shared]])[0] <= 44


def test_pieces_prefer_strong_boundaries(encoder):
    text = "\n\n".join(" ".join(f"Sentence {i} of {j} is here." for i in range(30)) for j in range(4))
    assert all(natural for *_, natural in split_oversized.split_text(text, encoder)[0])


HOSTILE = ["\u0301" * 3000, "\U0001f468\u200d\U0001f469" * 500, "\u0e01\u0e33" * 1500, "\U000e0041" * 900, "a\u0301\U0001f600 " * 900, "\u2028" * 2000, " \n" * 2000, ("x" * 7 + "\U0001f600") * 400]


@pytest.mark.parametrize("text", HOSTILE)
@pytest.mark.parametrize("limit, overlap", [(400, 40), (56, 40)])
def test_hostile_pieces_fit_and_cover(encoder, text, limit, overlap):
    pieces, _ = split_oversized.split_text(text, encoder, limit, overlap)
    assert "".join(p[shared:] for p, _, shared, _, _ in pieces) == text
    assert all(n <= limit and n == encoder.count_batch([p])[0] for p, n, *_ in pieces)


def test_forced_against_stretches(encoder):
    draw = random.Random(3)
    for _ in range(300):
        parts = [draw.choice(["word", "Wort,", "end.", "end. ", "\n", "\r\n", "  \n\n   ", "a!b", "x" * draw.randint(1, 90), " ", "12", "?", "; "]) + draw.choice(["", " "]) for _ in range(draw.randint(20, 400))]
        text = "".join(parts)
        want = max(encoder.count_batch(re.split(r"[\r\n]+|(?<=[.!?])\s+", text))) > 60
        assert split_oversized.split_text(text, encoder, 60, 20)[1] == want


def test_limit_must_leave_room(spark):
    with pytest.raises(ValueError):
        split_oversized.split_pieces(spark.createDataFrame([], "chunk_no long, text string"), limit=50)


def test_split_tables(spark):
    df = clashing(spark.createDataFrame([(1, None), (2, ""), (3, "small"), (4, TEXTS[1]), (4, TEXTS[1]), (5, TEXTS[0])], "chunk_no long, text string"))
    assert sorted(tuple(r) for r in split_oversized.cut_kinds(split_oversized.split_pieces(df)).collect()) == [(4, "natural"), (4, "natural"), (5, "forced")]
    assert split_oversized.split_pieces(df.limit(0)).collect() == []


def grams(text, n=12):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta eins zwei drei vier".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "Ünder_score " * 20)]
    docs = []
    for d in range(80):
        base = [word() for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            w = items[rng.randrange(25)][1].split()
            k = rng.randrange(len(w))
            base[10:10] = w[k : k + rng.choice([11, 12, 30])]
        docs.append((d, ", ".join(base).upper() if d % 2 else " ".join(base)))
    docs += [(200, None), (201, ""), (202, "x ünder_SCORE " + "ünder_score\n" * 30), (202, "x ünder_SCORE " + "ünder_score\n" * 30)]
    want = {(d, i) for d, t in docs for i, u in items if t and u and grams(t) & grams(u)}
    d, i = clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame(items, "item_id long, text string"))
    for size in (1 << 20, 300):  # one block, and many
        rows = leaks.leaks(d, i, block_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    assert leaks.leaks(d, i.limit(0)).collect() == [] and leaks.leaks(d.limit(0), i).collect() == []


def test_one_window_in_many_items(spark):
    """Fifty thousand items hold one window, and so do a few documents; all pairs come out, with their windows."""
    window = " ".join(f"w{i}" for i in range(12))
    items = spark.range(50_000).select(F.col("id").alias("item_id"), F.concat(F.lit(window + " own"), F.col("id").cast("string")).alias("text"))
    docs = spark.createDataFrame([(1, "a " + window + " b"), (2, "x " + window + " own7"), (3, window[3:])], "doc_id long, text string")
    got = leaks.leaks(docs, items)
    assert {tuple(r) for r in got.groupBy("doc_id", "windows").count().collect()} == {(1, 1, 50_000), (2, 1, 49_999), (2, 2, 1)}


def test_filters_beyond_what_is_kept(spark, monkeypatch, tmp_path):
    """Blocks whose filters are read again and again, and opened one at a time, give the same pairs."""
    items = spark.createDataFrame([(i, " ".join(f"v{i}x{j}" for j in range(10 + i))) for i in range(30)], "item_id long, text string")
    path = leaks.item_blocks(items, "item_id", "text", leaks.RUN, leaks.SHINGLE, 200)
    monkeypatch.setattr(leaks, "KEPT_FILTERS", 100)
    monkeypatch.setattr(leaks, "KEPT_BLOCKS", 1)
    shelf, texts = leaks.Shelf(path), [[f"v{i}x{j}" for j in range(10 + i)] for i in range(30)]
    assert not shelf.held
    met = list(shelf.found(leaks.Windows(texts, leaks.RUN, leaks.SHINGLE)))
    got = {(int(t), int(i)) for number, found in met for row, item, _ in shelf.block(number).pairs(found) for t, i in zip(row, item)}
    assert len(met) > 5 and len(shelf.blocks) == 1 and got == {(i, i) for i in range(2, 30)}


def shared_brute(docs, span):
    owner = {}
    for d, t in docs:
        for k in range(len(t or "") - span + 1):
            owner.setdefault(t[k : k + span], set()).add(d)
    out = {}
    for d, t in docs:
        covered = set()
        for k in range(len(t or "") - span + 1):
            if len(owner[t[k : k + span]]) > 1:
                covered.update(range(k, k + span))
        if covered:
            out[d] = len(covered)
    return out


@pytest.mark.parametrize("span, gear", [(200, 64), (40, 16), (20, 4)])
def test_shared_spans_against_brute_force(spark, span, gear):
    rng = random.Random(span)
    text = lambda n, letters="abcdefghij klmnop": "".join(rng.choice(letters) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 5 * span))) for i in range(60)]
    common = text(3 * span)
    for i in range(0, 60, 4):
        a, n, at = rng.randrange(2 * span), rng.randrange(span - 3, span + 40), rng.randrange(10)
        docs[i] = (i, docs[i][1][:at] + common[a : a + n] + docs[i][1][at:])
    docs += [(100, None), (101, ""), (102, "z" * 4 * span), (103, "z" * 2 * span + "y"), (104, "é😀字" * span), (105, "q" + "é😀字" * span), (106, text(3 * span) * 2), (107, common), (108, common), (109, common + "!")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    for small_rows in (shared_spans.SMALL_ROWS, 0):  # sides broadcast, and shuffled
        spans = shared_spans.shared_spans(df, span=span, gear=gear, small_rows=small_rows)
        assert {r["doc"]: r["shared"] for r in shared_spans.shared_length(spans).collect()} == shared_brute(docs, span)
    merged, ends = sorted(tuple(r) for r in shared_spans.merged_spans(spans).collect()), {}
    for doc, start, end in merged:
        assert start > ends.get(doc, -1)
        ends[doc] = end
    assert {d: sum(e - s for x, s, e in merged if x == d) for d in ends} == shared_brute(docs, span)


def test_a_long_document_with_many_requests(spark):
    """One text of ten million characters, of which many others hold some four hundred each: some 10,000 requests to it."""
    rng = np.random.default_rng(4)
    long = rng.integers(97, 122, 10_000_000, np.uint8).tobytes().decode()
    at = rng.choice(9_999, 3_000, replace=False) * 1000
    docs = spark.createDataFrame([(0, "é" + long), *((int(i) + 1, f"<{long[a : a + 400]}>") for i, a in enumerate(at))], "doc_id long, text string")
    got = {r["doc"]: r["shared"] for r in shared_spans.shared_length(shared_spans.shared_spans(docs)).collect()}
    assert got == {0: 400 * 3_000} | {i + 1: 400 for i in range(3_000)}


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    assert shared_spans.shared_spans(df).collect() == [] and shared_spans.shared_spans(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        shared_spans.shared_spans(df, span=50)


def test_many_different_texts_at_one_cut_point(spark):
    """A sentence of 100 characters in many texts: one cut point, chunks all different, nothing long enough shared."""
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefghijklmnop") for _ in range(100))
    docs = [(i, "".join(rng.choice("qrstuvwxyz") for _ in range(300)) + core + "".join(rng.choice("QRSTUVW") for _ in range(300))) for i in range(300)]
    docs.append((999, docs[5][1][:420]))
    got = {r["doc"]: r["shared"] for r in shared_spans.shared_length(shared_spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert got == {5: 420, 999: 420}


def line_key(line):
    return tuple(re.findall(r"[^\W\d_]+", line.lower()))


def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        body = rng.choice([" Site", "SITE ", "site", "Other", None, " "])
        lines = [rng.choice(["Share this (12)", "share THIS: 3", "All rights!", "page 9", "unique " + "".join(rng.choice("abcdef") for _ in range(6)), "", "123", "rare line"]) for _ in range(rng.randrange(0, 5))]
        rows.append((i, rng.choice([f"d{i % 30}", f"d{i % 7}", None]), body, rng.choice(["\n".join(lines), "\r\n".join(lines), None])))
    rows.append((3, "d3", "site", "Share this\nShare this"))
    docs, seen = {}, {}
    norm = lambda b: (b or "").strip().lower()
    for no, doc, body, text in rows:
        if norm(body) and doc is not None:
            docs.setdefault(norm(body), set()).add(doc)
            for line in (text or "").split("\n"):
                if line_key(line):
                    seen.setdefault((norm(body), line_key(line)), set()).add(doc)
    hot = {k for k, s in seen.items() if len(s) >= 4 and 10 * len(s) >= len(docs[k[0]])}
    want = sorted((no, k) for no, doc, body, text in rows for k, line in enumerate((text or "").split("\n"), 1) if norm(body) and (norm(body), line_key(line)) in hot)
    df = clashing(spark.createDataFrame(rows, "chunk_no long, doc_id string, issuing_body string, text string"))
    assert sorted(tuple(r) for r in repeated_lines.repeated_lines(df).collect()) == want and want
    assert repeated_lines.repeated_lines(df.limit(0)).collect() == []
    clean = {r["chunk_no"]: r for r in repeated_lines.without_repeated_lines(df.where("chunk_no <> 3")).collect()}
    assert all("Share this" not in (r["text"] or "") for no, r in clean.items() if norm(rows[no][2]) == "site") and clean[next(n for n, _, _, t in rows if t is None and n != 3)]["text"] is None


def test_repeated_lines_are_counted_once_by_their_letters(spark, monkeypatch):
    """No stage that can change no row; lines with the same lowest words are not counted together."""
    counted, counts = [], repeated_lines._doc_counts
    monkeypatch.setattr(repeated_lines, "_doc_counts", lambda rows, keys: counted.append(keys) or counts(rows, keys))
    df = spark.createDataFrame([(i, f"d{i}", "site", f"all rights\n{'all rights ' * (i % 2 + 2)}\nrights all {i}") for i in range(6)], "chunk_no long, doc_id string, issuing_body string, text string")
    got = sorted(tuple(r) for r in repeated_lines.repeated_lines(df).collect())
    assert counted == [["source_key", "line_key"]]
    assert got == sorted((i, no) for i in range(6) for no in (1, 3))
    keyed, many = repeated_lines._stages(df, "chunk_no", "doc_id", "issuing_body", "text", 4, 10)
    assert keyed.columns == ["row", "line_no", "source_key", "doc_key", "line_key"] and many.count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=3), min_size=1, max_size=5), st.lists(st.lists(st.lists(st.sampled_from("abcde"), max_size=9), max_size=3), max_size=5))
def test_index_search_against_brute_force(records, block):
    index = cross_split.FmIndex.from_bytes(cross_split.FmIndex(records).to_bytes())
    got = {(a, b): c for a, b, c, *_ in cross_split.search(index, cross_split.Block(block))}
    want = {}
    for (a, p), (b, q) in itertools.product(enumerate(block), enumerate(records)):
        x, y = gram_set(p), gram_set(q)
        if x and y and len(x & y) * 10 >= 7 * max(len(x), len(y)):
            want[a, b] = len(x & y)
    assert got == want


def test_backward_search_counts():
    words = "a b a b c a b".split()
    index = cross_split.FmIndex([[words]])
    ids = np.array([index.words[w] for w in "a b".split()])
    low, high = index.intervals(ids, np.array([0]), 2)
    assert high[0] - low[0] == 3
    found = cross_split.search(index, cross_split.Block([[words]]))
    assert found == [(0, 0, len(gram_set([words])), 1, 7, 7)]


def test_maximal_matches_of_each_record():
    index = cross_split.FmIndex([["a b c d e".split()], ["x y z".split()]])
    block = cross_split.Block([["a b c q x y z".split()], ["a b c d".split(), "x y z".split()], [["p"]]])
    words = np.array([index.words.get(w, 0) if w else 1 for w in block.flat])
    got = cross_split._maximal(index, words, block.owner, np.array([0, 1]), block.n)
    assert got.T.tolist() == [[2, 3, 6], [2, 4, 7], [0, 0, 0]]


def test_a_filter_keeps_every_sequence():
    records = [[[f"w{i * k % 97}" for i in range(60)]] for k in range(1, 30)]
    index = cross_split.FmIndex(records)
    assert index.may_hold(cross_split.Block(records).gram).all()
    strange = cross_split.Block([[[f"v{i}" for i in range(3000)]]])
    assert index.may_hold(strange.gram).mean() < 0.3


def test_overlaps_over_many_shards(spark):
    draw, rows = random.Random(5), []
    base = [[f"w{draw.randint(0, 400)}" for _ in range(draw.choice([5, 20, 60, 200]))] for _ in range(40)]
    for i in range(160):
        words = [w if draw.random() > 0.04 else "new" for w in base[i % 40]]
        rows.append((i, draw.choice(["train", "train", "val", "test"]), None, evidence(" ".join(words)), None))
    e = "array<struct<chunk_id:string,source_doc:string,page:int,passage:string>>"
    df = spark.createDataFrame(rows, f"record_no long, split string, pair_id string, evidence_a {e}, evidence_b {e}")
    sets = {r[0]: gram_set(cross_split.passage_words([r[3][0][3]])) for r in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == "train" and b[1] != "train" and len(sets[a[0]] & sets[b[0]]) * 10 >= 7 * max(len(sets[a[0]]), len(sets[b[0]])) > 0}
    for shard_words in (200, 10**6):
        members, matches = cross_split.near_same(df, shard_words=shard_words, maximal=False)
        left, right = members.where("is_train").toDF("t", "x", "train"), members.where("not is_train").toDF("o", "y", "other")
        assert {(r["t"], r["o"]) for r in matches.join(left, "train").join(right, "other").collect()} == want


def gram_set(passages):
    return {tuple(w[i : i + 3]) for w in passages for i in range(len(w) - 2)}


def evidence(*passages):
    return [("c", "s", 1, p) for p in passages]


def test_overlaps(spark):
    e = "array<struct<chunk_id:string,source_doc:string,page:int,passage:string>>"
    long = " ".join(f"w{i}" for i in range(40))
    near = long.replace("w20", "other")
    rows = [(1, "train", "A ", evidence(long), None), (2, "val", " a", None, []), (3, "test", None, evidence("w1 w2"), evidence(long.upper().replace(" ", ", "))), (4, "gold_iaa", "b", None, evidence(near)),
            (5, "train", None, [], []), (6, "test", None, [], None), (7, None, "a", evidence(long), None), (8, "train", "z", evidence(" ".join(long.split()[:20])), None), (9, "val", "y", evidence(None, "x y"), None), (1, "train", "A ", evidence(long), None)]
    df = clashing(spark.createDataFrame(rows, f"record_no long, split string, pair_id string, evidence_a {e}, evidence_b {e}"))
    got = sorted((r["train_no"], r["other_no"], r["same_id"], r["same_text"]) for r in cross_split.overlaps(df).collect())
    assert got == [(1, 2, True, False), (1, 3, False, True), (1, 4, False, True)]
    assert cross_split.overlaps(df.limit(0)).collect() == [] and cross_split.overlaps(df.where("split = 'train'")).collect() == []


@pytest.mark.parametrize("line, want", [("Published on 3 May 2021 by the office of John Q. Smith for all readers", "published on # by the office of @ for all readers"), ("Section Penalties", "section penalties"), ("page 12/34 of the printed edition kept here", "page # of the printed edition kept here"),
                                        ("May contain errors that the office of 2 May 2020 did not see", "may contain errors that the office of # did not see"), ("Mail a@b to the four other people", "mail a b to the four other people"), ("12.05.2020", "#")])
def test_masks(line, want):
    assert " ".join(repeated_lines.masked_words(line)) == want


def test_near_lines_against_brute_force(spark):
    """Planted near-duplicates: found where the brute-force cluster of a planted line is in enough documents."""
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstz"]
    planted = [[rng.choice(vocabulary) for _ in range(24)] for _ in range(12)]
    rows, no = [], 0
    near = set()
    for d in range(60):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 25))) for _ in range(8)]
        for k, base in enumerate(planted):
            if d % 3 == k % 3:  # in a third of the documents, the last word or a number and a name changed
                line = base[:-1] + [rng.choice(vocabulary)] if rng.random() < 0.5 else base[:12] + [str(rng.randrange(99)), "Anna"[: rng.randrange(3, 5)] + " Berg"] + base[12:]
                lines.append(" ".join(line))
                near.add((d, len(lines)))
        rows.append((d, f"d{d}", " Body" if d % 2 else "body ", "\n".join(lines)))
    rows += [(100, None, "body", "x"), (101, "d1", None, "y"), (102, "d2", "body", None), (103, "d3", "body", " \n12\n")]
    df = clashing(spark.createDataFrame(rows, "chunk_no long, doc_id string, issuing_body string, text string"))
    got = {tuple(r) for r in repeated_lines.near_repeated_lines(df).collect()}
    masks = {(r[0], no): repeated_lines.masked_words(line) for r in rows if r[2] and r[3] for no, line in enumerate(r[3].split("\n"), 1) if re.search("[a-z]", line)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in masks.items()}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    clusters = {k: {d for (d, _), other in sets.items() if alike(own, other)} for k, own in sets.items()}
    want = {k for k, docs in clusters.items() if len(docs) >= 6}
    assert near <= want and len(got & near) >= 0.9 * len(near) and got <= want
    assert repeated_lines.near_repeated_lines(df.limit(0)).collect() == []


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("limit", [10**6, 3])
def test_components_against_union_find(spark, limit):
    rng = random.Random(limit)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    edges = chain + [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(60)] + [("lone", "lone"), ("hub", "hub")] + [("hub", f"h{i}") for i in range(30)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, "x"), *edges[:5]], "u string, v string").repartition(6)
    assert {r["node"]: r["root"] for r in grouped_splits.components(df, task_edges=limit).collect()} == union_find(edges)
    assert {r["node"]: r["root"] for r in grouped_splits.components(df, part_edges=3, fan_in=2).collect()} == union_find(edges)


def test_forests_are_merged_level_by_level(spark, monkeypatch):
    """p2_found: sixteen local forests, merged into four, then one."""
    ran, plain = [], type(spark.range(1)).mapInArrow

    def spy(self, *args, **more):
        ran.append(self.rdd.getNumPartitions())
        return plain(self, *args, **more)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", spy)
    assert grouped_splits.p2_found(spark, "/root/testdata/sf0.01").count() > 0
    assert ran == [16, 4, 1, 1]


def test_many_buckets_of_groups(spark):
    df = spark.createDataFrame([(i, (f"R{i if i % 5 else 0}",), None) for i in range(300)], "record_no long, regime_a struct<regime_id:string>, regime_b struct<regime_id:string>")
    got = grouped_splits.assign_splits(df, bucket_groups=7).collect()
    assert len(got) == 300 and {s: sum(r["split"] == s for r in got) for s in grouped_splits.TARGETS} == {"train": 210, "validation": 45, "test": 45}


def test_record_groups_and_splits(spark):
    regime = "struct<regime_id:string>"
    rows = [(1, (" eu-x  1",), ("B",)), (2, ("EU_X_1",), None), (3, ("b",), ("c__c",)), (4, ("?",), (" ",)), (5, None, ("Z",)), (6, ("z ",), (None,)), (7, (None,), None), (8, ("C C",), ("_",)), (8, ("C C",), ("_",))]
    df = clashing(spark.createDataFrame(rows, f"record_no long, regime_a {regime}, regime_b {regime}"))
    got = sorted((r["record_no"], r["group_id"]) for r in grouped_splits.record_groups(df).collect())
    assert got == [(1, "B"), (2, "B"), (3, "B"), (4, None), (5, "Z"), (6, "Z"), (7, None), (8, "B"), (8, "B")]
    assert grouped_splits.record_groups(df.limit(0)).collect() == [] and grouped_splits.assign_splits(df.limit(0)).collect() == []
    many = spark.createDataFrame([(i, (f"R{i if i % 3 else 0}",), None) for i in range(600)], f"record_no long, regime_a {regime}, regime_b {regime}")
    split = grouped_splits.assign_splits(many, targets={"train": 70, "validation": 15, "test": 15}).collect()
    sizes = {s: sum(r["split"] == s for r in split) for s in ("train", "validation", "test")}
    assert len(split) == 600 and sizes == {"train": 420, "validation": 90, "test": 90}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 3000), min_size=1, max_size=6))
def test_plan_is_the_greedy_one(histogram):
    total = sum(k * n for k, n in histogram.items())
    got = grouped_splits.plan(histogram, total)
    lack = {s: total * t / 100 for s, t in grouped_splits.TARGETS.items()}
    for size in sorted(histogram, reverse=True):
        assert sum(got[size].values()) == histogram[size]
        for _ in range(histogram[size]):
            s = max(lack, key=lack.get)
            lack[s] -= size
    for s in lack:
        mine = total * grouped_splits.TARGETS[s] / 100 - sum(size * own[s] for size, own in got.items())
        assert abs(mine - lack[s]) <= 2 * max(histogram)


PASS = "pass_no long, pair_id string, annotator_id string, conflict_type string, revision int, review struct<reviewer_id:string,reviewed_at:string,decision:string,notes:string,original_conflict_type:string,original_severity:string,original_review_status:string>, loaded_at timestamp"


def review(who, decision, was):
    return (who, None, decision, None, was, None, None)


def test_votes(spark):
    a, b, c, d = consensus.CLASSES
    rows = [(1, "p", " a1", b, 1, None, None), (2, "p", "A1 ", " Structural unresolved", 2, None, None), (2, "p", "A1 ", " Structural unresolved", 2, None, None),
            (3, "q", "a2", c, 1, review("a3", "revise", b), None), (4, "r", "a2", d, None, review(" A3", "Accept ", "junk"), None), (5, "s", "a2", d, 1, review("a3", "reject", "needs discussion"), None),
            (6, None, "a1", a, 1, None, None), (7, "t", None, "RECURRING-FRICTION", 1, None, None), (8, "u", "a1", None, 1, None, None)]
    df = clashing(spark.createDataFrame(rows, PASS))
    got = sorted(tuple(r) for r in consensus.votes(df).collect())
    assert got == sorted([("p", "A1", a), ("q", "A2", b), ("q", "A3", c), ("r", "A2", d), ("r", "A3", d), ("t", "?", d)])
    items, people = consensus.consensus(df)
    assert {r["item"] for r in items.collect()} == {"p", "q", "r", "t"} and people.count() == 4
    items, people = consensus.consensus(df.limit(0))
    assert items.collect() == [] and people.collect() == []


def test_consensus_beats_the_majority(spark):
    """Two careful annotators against three who mostly give one label by habit."""
    rng = np.random.default_rng(11)
    k, n = consensus.CLASSES, 400
    truth = rng.choice(4, n, p=[0.25, 0.35, 0.2, 0.2])
    skill = [0.95, 0.9, 0.3, 0.3, 0.25, 0.6]
    habit = [None, None, 1, 1, 1, None]
    rows = []
    for i in range(n):
        for p in rng.choice(6, 5, replace=False):
            label = truth[i] if rng.random() < skill[p] else habit[p] if habit[p] is not None else rng.choice(4)
            rows.append((len(rows), f"p{i}", f"A{p}", k[label], 1, None, None))
    items, people = consensus.consensus(spark.createDataFrame(rows, PASS))
    got = {r["item"]: r["label"] for r in items.collect()}
    votes = {}
    for _, item, _, label, *_ in rows:
        votes.setdefault(item, []).append(label)
    share = lambda said: sum(said[f"p{i}"] == k[truth[i]] for i in range(n)) / n
    majority = share({i: max(sorted(set(v)), key=v.count) for i, v in votes.items()})
    assert share(got) > majority + 0.05 and share(got) > 0.93
    by_joins, people_ = consensus.consensus(spark.createDataFrame(rows, PASS), most_people=5)
    for left, right, key in ((items, by_joins, "item"), (people, people_, "person")):
        own, other = ({r[key]: r.asDict() for r in df.collect()} for df in (left, right))
        assert own.keys() == other.keys()
        assert all(v == (pytest.approx(other[x][c], abs=1e-9) if isinstance(v, float) else other[x][c]) for x, r in own.items() for c, v in r.items())
    reliability = {r["person"]: r["competence"] for r in people.collect()}
    assert min(reliability["A0"], reliability["A1"]) > max(reliability["A2"], reliability["A3"], reliability["A4"])


def test_rounds_by_label_habits_gain(spark):
    """Annotators who confuse labels in their own ways: the first consensus is worse than the one after the rounds."""
    rng, k, n = np.random.default_rng(1), consensus.CLASSES, 1500
    truth, skill, mixed = rng.choice(4, n, p=[0.4, 0.3, 0.2, 0.1]), rng.uniform(0.45, 0.95, 10), [rng.dirichlet(np.full(4, 0.5), 4) for _ in range(10)]
    rows = []
    for i in range(n):
        for p in rng.choice(10, 4, replace=False):
            label = truth[i] if rng.random() < skill[p] else rng.choice(4, p=mixed[p][truth[i]])
            rows.append((len(rows), f"p{i}", f"A{p}", k[label], 1, None, None))
    df = spark.createDataFrame(rows, PASS)
    right = [sum(k[truth[int(r["item"][1:])]] == r["label"] for r in consensus.consensus(df, rounds=x)[0].collect()) / n for x in (0, consensus.ROUNDS)]
    assert right[1] > right[0] + 0.005


def test_agreement_beyond_chance(spark):
    """Krippendorff's alpha from its coincidences."""
    a, b = consensus.CLASSES[:2]
    said = [[a, a], [b, b], [a, b, b], [a, a, a, a], [b]]
    rows = [(10 * i + j, f"p{i}", f"A{j}", label, 1, None, None) for i, own in enumerate(said) for j, label in enumerate(own)]
    got = consensus.overall_agreement(spark.createDataFrame(rows, PASS)).first()
    kept = [own for own in said if len(own) > 1]
    n = sum(map(len, kept))
    observed = sum(sum(x == y for x, y in itertools.permutations(own, 2)) / (len(own) - 1) for own in kept) / n
    flat = [x for own in kept for x in own]
    chance = sum(x == y for x, y in itertools.permutations(flat, 2)) / (n * (n - 1))
    assert (got["n_items"], got["n_votes"]) == (4, n)
    assert (got["observed"], got["chance"], got["alpha"]) == tuple(pytest.approx(x, abs=1e-8) for x in (observed, chance, (observed - chance) / (1 - chance)))
    assert consensus.overall_agreement(spark.createDataFrame([], PASS)).first()["alpha"] is None


PAGES = "doc_id string, pages array<struct<page:int,text:string>>, extracted_at timestamp"
BODY = "the custodian must record every transfer of the register in writing and keep the point-of-sale notice for the supervisor".split()


MISREAD = ["rec0rd", "regi5ter", "wrjting", "tran5fer", "n0tice", "superv|sor"]


def make_pages(seed, n=4, offset=0):
    """(pages, faults) of a made-up scan: header, page number, hyphenated and misread words, one number in the body."""
    rng, pages, faults = random.Random(seed), [], set()
    for p in range(1, n + 1):
        lines = [f"Careful Title Handbook {seed}", ""]
        faults.add((p, 1, "header"))
        for _ in range(8):
            lines.append(" ".join(rng.choice(BODY) for _ in range(7)))
        if p == 2:
            lines[4] = lines[4] + " cus­"
            lines[5] = "todian " + lines[5]
            faults.add((p, 5, "hyphen"))
            lines[7] = lines[7] + f" {MISREAD[seed % len(MISREAD)]} the"
            faults.add((p, 8, "char"))
            lines[8] = "every point-"
            lines[9] = "of-sale notice"
            lines.insert(7, "- 417 -")
            faults = {(a, b + (a == 2 and b > 7), f) for a, b, f in faults}
        lines.append(f"- {p + offset} -")
        faults.add((p, len(lines), "pageno"))
        pages.append((p, "\n".join(lines)))
    rng.shuffle(pages)
    return pages, faults


def test_scanned_pages(spark):
    docs, want = [], set()
    for i in range(6):
        pages, faults = make_pages(i + 1, offset=i)
        docs.append((f"d{i}", pages, None))
        want |= {(f"d{i}", *f) for f in faults}
    docs += [docs[0], ("none", None, None), ("empty", [], None), ("blank", [(1, None), (None, "x"), (2, " ")], None), (None, docs[0][1], None)]
    df = clashing(spark.createDataFrame(docs, PAGES))
    rows = scanned_pages.repaired(df).select("doc", F.explode("faults").alias("f")).select("doc", "f.*").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    text = {r["doc"]: " ".join(r["paragraphs"]) for r in scanned_pages.repaired(df).collect()}
    assert "custodian" in text["d0"] and "point-of-sale" in text["d0"] and MISREAD[1] not in text["d0"] and "Handbook" not in text["d0"] and "- 417 -" in text["d0"]
    assert scanned_pages.repaired(df.limit(0)).collect() == []


@pytest.mark.parametrize("line, number", [("Page 3 of 10", 3), ("- 12 -", 12), ("[7]", 7), ("p. l0", 10), ("l9/21", 19), ("xiv", 14), ("  4", 4)])
def test_page_number_styles(line, number):
    assert number in [n for n, _ in scanned_pages.page_numbers(line)]


@pytest.mark.parametrize("line", ["15.7.", "62(1).", "30 June", "12 days", "", "mild"])
def test_lines_that_are_no_page_numbers(line):
    assert not scanned_pages.page_numbers(line)


@pytest.mark.parametrize("seen, meant, ok", [("rec0rd", "record", True), ("insiired", "insured", True), ("rnust", "must", True), ("go\\/erning", "governing", True), ("comparc", "compare", True), ("conﬁrm", "confirm", True), ("word", "ward", False), ("non-x", "nonxx", False)])
def test_glyph_edits(seen, meant, ok):
    edit = scanned_pages.glyph_edit(seen, meant)
    assert (edit is not None and (len(edit) > 2)) == ok


def test_very_long_texts(spark, encoder, reference, monkeypatch):
    rng = random.Random(6)
    one = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=700_000))
    two = "<" + one[300_000:650_000] + ">" + "".join(rng.choices("ABCDEFGH", k=1000))
    df = spark.createDataFrame([(1, one), (2, two), (3, two[-600:])], "doc_id long, text string")
    got = {r["doc"]: r["shared"] for r in shared_spans.shared_length(shared_spans.shared_spans(df)).collect()}
    assert got == {1: 350_000, 2: 350_600, 3: 600}
    item = " ".join(f"item{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "filler words " * 200_000 + item), (2, "item0")], "doc_id long, text string")
    assert [tuple(r) for r in leaks.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 5, 3)]
    monkeypatch.setattr(bpe, "LONG_TEXT", 50_000)
    assert encoder.encode_batch([one, None, "x"]) == (reference(one) + reference("x"), [len(reference(one)), 0, 1])
    assert encoder.count_batch([one, "", "x"]) == [len(reference(one)), 0, 1]
