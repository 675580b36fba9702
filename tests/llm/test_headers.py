"""Running headers that stand on every other page."""

import random

import pytest

from docloom.llm import scanned_pages

EVEN, ODD = "Secondary provision objective Rules 184", "Part B - Historical agreement estimate"
WORDS = "trustee register clause months agent margin duty paragraph schedule market reserve custody notice deadline surplus capital premium lender".split()


def document(n: int, misread: dict[int, str] = {}) -> list[dict]:
    head = lambda p: [] if p == 1 else [misread.get(p, ODD if p % 2 else EVEN)]
    rng = random.Random(n)
    text = lambda: [" ".join(rng.choices(WORDS, k=8)) for _ in range(9)]
    return [{"page": p, "text": "\n".join(head(p) + text())} for p in range(1, n + 1)]


def headers(raw: list[dict]) -> set[tuple[int, int]]:
    return {(p.number, i) for p in scanned_pages.layout(raw)[0] for i, kind in enumerate(p.kind) if kind == "header"}


@pytest.mark.parametrize("n", [4, 5, 6, 7, 14])
def test_alternating_headers_are_all_found(n):
    assert headers(document(n)) == {(p, 0) for p in range(2, n + 1)}


def test_copies_too_misread_for_like_are_found():
    misread = {5: "Part B - Hist0rica1 agreernent estirnate", 7: "Part B - Historica| agrecmenf estinate"}
    assert headers(document(9, misread)) == {(p, 0) for p in range(2, 10)}


def test_blank_pages_do_not_count():
    raw = [p if p["page"] != 5 else {"page": 5, "text": " "} for p in document(8)]
    assert headers(raw) == {(p, 0) for p in (2, 3, 4, 6, 7, 8)}


def test_body_lines_stay():
    assert headers([p | {"text": p["text"].partition("\n")[2]} for p in document(14)][1:]) == set()
