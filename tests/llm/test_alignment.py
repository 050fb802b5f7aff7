"""Token alignment against whole texts encoded at once and all overlaps listed."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelake.llm import alignment, word_ids

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH), alignment.load(A_PATH, B_PATH)[2]


def spans(ids, table):
    at, out = 0, []
    for k in ids:
        out.append((at, at + len(table[k]), k))
        at += len(table[k])
    return out


def plain(texts, coders):
    """Every text as a whole; overlaps by comparing byte ranges."""
    a, b, words = coders
    rows, held = [], []
    for doc_id, text in texts:
        raw = (" " + text).encode() if text else b""
        one = spans(a.encode(" " + text, add_special_tokens=False).ids, words.a) if text else []
        two = spans(b.encode(text), words.b) if text else []
        if b"".join(words.a[k] for *_, k in one) != raw or b"".join(words.b[k] for *_, k in two) != raw:
            one, two = [], []
        links, j = [], 0
        for s, e, k in one:
            while j and two[j - 1][1] > s:
                j -= 1
            while j < len(two) and two[j][0] < e:
                if two[j][1] > s:
                    links.append((k, two[j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in one} & {e for _, e, _ in two})
        groups, begin = [], 0
        inside = lambda part, x, y: ",".join(str(k) for s, e, k in part if x <= s and e <= y)
        if len(raw) < 4_000:
            for end in cuts:
                groups.append(inside(one, begin, end) + "|" + inside(two, begin, end))
                begin = end
        rows.append((doc_id, len(one), len(two), len(cuts), links, groups))
        held.append(set(links))
    counts = Counter(link for links in held for link in links)
    most = {}
    for (k, _), n in counts.items():
        most[k] = max(most.get(k, 0), n)
    return [
        (doc_id, n_a, n_b, cuts, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc_id, n_a, n_b, cuts, links, groups in rows
    ]


def found(df, **options):
    return [tuple(r) for r in alignment.alignment(df, A_PATH, B_PATH, **options).select(*COLUMNS).collect()]


ODD_TEXTS = [
    "trailing space ", " leading", "  two  spaces   ", "a\nb\n\n c", "tab\tx", "<|endoftext|> and <s>", "a▁b", "ﬁ ½ é 中文 字", "　wide",
    " ", "\n", "\x00 nul", "aa" * 3, "don't I'll x's", "🙂 smile🙂", "x" * 3000, "1234567 12", "\x1c x \x1f", "a\xa0b \xa0 c", "é ́",
]


def test_equals_whole_texts(spark, coders):
    texts = list(enumerate(ODD_TEXTS))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(found(df)) == sorted(plain(texts, coders))


@pytest.mark.parametrize("table_pairs", [1 << 19, 40])
def test_documents(spark, documents, texts, coders, table_pairs):
    """The whole table; with a small table of frequent pairs most counts come by the join."""
    mine, theirs = found(documents, table_pairs=table_pairs), plain(texts.items(), coders)
    facts = lambda rows: sorted(r[:7] for r in rows)
    assert facts(mine) == facts(theirs)
    hashes = {r[0]: r[7] for r in theirs if len(texts[r[0]] or "") < 1_500}
    assert {r[0]: r[7] for r in mine if r[0] in hashes} == hashes


def test_identity_map(coders):
    words = coders[2]
    named = [k for k, b in enumerate(words.same) if b >= 0]
    assert len(named) > 5_000 and all(words.a[k] == words.b[words.same[k]] for k in named)
    known = set(words.b)
    assert all(words.same[k] < 0 for k, raw in enumerate(words.a) if raw not in known)


def test_odd_rows(spark, odd, empty, coders):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    key = lambda r: tuple(x is not None and (0, x) or (1, 0) if x is None else (0, x) for x in r[:7])
    assert sorted((r[:7] for r in found(odd)), key=key) == sorted((r[:7] for r in plain(rows, coders)), key=key)
    assert found(empty) == []


def test_words_forgotten(spark, documents, monkeypatch):
    """A worker that forgets its words comes to the same rows."""
    some = documents.where(F.col("doc_id") < 40)
    whole = sorted(found(some))
    monkeypatch.setattr(word_ids, "WORDS_KEPT", 500)
    assert sorted(found(some)) == whole
