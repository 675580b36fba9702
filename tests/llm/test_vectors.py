"""The skip-gram model of the scanned pages has its full size."""

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import scanned_pages


def test_vectors_have_32_numbers_and_windows_4_words(spark):
    lines = spark.createDataFrame([(["trustee", "keeps", "the", "register"],)] * 20, "words array<string>")
    counts = spark.createDataFrame([(w, 20) for w in ("trustee", "keeps", "the", "register")], "word string, n long")
    assert {len(v) for v in scanned_pages.word_vectors(lines, counts)[0].values()} == {32}
    assert scanned_pages.WINDOW == 4


def test_words_beyond_the_model_have_their_neighbours_vectors(spark):
    """A model of few words: the rare ones that misreadings may mean get vectors of their own, and the repair stays right."""
    from test_algorithms import PAGES, make_pages

    lines = spark.createDataFrame([(["the", "rare", "register"],), (["x", "rare"],)], "words array<string>")
    sent = spark.sparkContext.broadcast({"the": np.array([1.0, 0.0]), "register": np.array([0.0, 3.0])})
    wanted = spark.createDataFrame([("rare",), ("absent",)], "word string")
    assert [(r["word"], r["vector"]) for r in scanned_pages._rare_vectors(lines, wanted, sent).collect()] == [("rare", [1.0, 3.0])]
    docs, want = [], set()
    for i in range(6):
        pages, faults = make_pages(i + 1, offset=i)
        docs.append((f"d{i}", pages, None))
        want |= {(f"d{i}", *f) for f in faults}
    rows = scanned_pages.repaired(spark.createDataFrame(docs, PAGES), model_words=5).select("doc", F.explode("faults").alias("f")).select("doc", "f.*").collect()
    assert {tuple(r) for r in rows} == want
