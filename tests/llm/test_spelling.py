"""Spelling variants against every pair of words that share a place with one letter left out."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelake.llm import spelling


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain(rows):
    counts = plain_words(rows)
    holes = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holes[w[:k] + "*" + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in counts:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("block_bytes", [spelling.BLOCK_BYTES, 300])
def test_documents(spark, documents, texts, monkeypatch, block_bytes):
    monkeypatch.setattr(spelling, "BLOCK_BYTES", block_bytes)
    expected = plain(texts.items())
    assert found(documents) == expected
    assert sum(r[1] is not None for r in expected) > 20


def test_chains_and_ties(spark):
    """Chains of forms, equal counts, insertions at both ends, letters outside a-z, long words."""
    words = {
        "abcde": 3, "abcdf": 7, "abcdg": 15, "abcdgh": 40, "xabcdgh": 90, "tieaa": 3, "tieab": 8, "tieac": 8,
        "Éclair": 4, "éclair": 9, "naïve": 5, "naive": 11, "×÷×÷×": 3, "×÷×÷×÷": 6, "edcba": 50, "bacde": 20,
        "z" * 3000: 3, "z" * 3001: 6, "z" * 2999 + "y": 4, "longer" * 700: 3, "longer" * 699 + "lonter": 7,
    }
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(rows)
    assert found(df) == expected
    by_word = {r[0]: r for r in expected}
    assert by_word["tieaa"][1] == "tieab" and by_word["abcde"][2] == "xabcdgh"


def test_distances():
    """A product's distances are those of the letter counts, also beyond single precision."""
    for length in (6, 2500):
        draw = np.random.default_rng(length)
        letters = draw.choice(np.frombuffer(b"ab\xe9", np.uint8), (40, length))
        block = spelling.Block(length, letters.tobytes(), np.ones(40, np.int64))
        i, j = spelling.candidates(block, block)
        counts = block.counts
        squared = ((counts[:, None] - counts[None]) ** 2).sum(2)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero((squared <= 2) & (squared > 0)))))


def test_odd_rows(spark, odd, empty):
    assert found(odd) == plain([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert found(empty) == []
