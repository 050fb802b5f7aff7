"""Licences, toxicity, personal data, decontamination: brute force, held-out rows, odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import decontaminate, licenses, pii, queries, toxicity

SF = "/root/testdata/sf0.001"


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0])):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(texts):
    draw = random.Random(1)
    odd = ["".join(draw.choice("ab@.1 2+-_%()9") for _ in range(60)) for _ in range(4000)]
    odd += ["4111 1111 1111 1111 4111111111111111", "1.2.3.4.5.6.7.8", "256.1.1.1", "00001.2.3.4", "a@b@c.d a.b+c@d-e.f.g.", "+1 (22) 333.44-55 +12"]
    for text in [*odd, *texts.values()]:
        assert pii.base_spans(text) == brute_spans(text)


def test_adversarial_runs_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 50_000, "a@" * 50_000, "+1" + " " * 100_000, "x=" * 50_000):
        assert isinstance(pii.find_candidates(text), list)


def test_credentials_of_any_length_are_candidates():
    for size in (15, 16, 256, 257, 5000):
        text = "the token=" + "aB3+" * (size // 4) + "x" * (size % 4) + " end"
        found = [(s, e) for kind, s, e, *_ in pii.find_candidates(text) if kind == "secret"]
        assert found == ([(10, 10 + size)] if size >= 16 else [])
    assert isinstance(pii.find_candidates("key=" + "a" * 500_000 + "\n" + "ab=ab-" * 50_000), list)


def test_reliabilities_are_recovered():
    """Votes drawn from known reliabilities: EM finds them and labels better than the majority."""
    draw = np.random.default_rng(7)
    truth = draw.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.55, 0.5])
    said = np.where(draw.random((20_000, 6)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns = {}
    for row in map(tuple, said.tolist()):
        patterns[row] = patterns.get(row, 0) + 1
    prior, chance, belief = pii.estimate_reliabilities(patterns)
    assert abs(prior - 0.4) < 0.03 and np.abs(chance[:, 1, 2] - right).max() < 0.05
    guessed = np.array([belief[tuple(row)] > 0.5 for row in said.tolist()])
    assert (guessed == truth).mean() > max(0.93, ((said.sum(1) > 0) == truth).mean())


def test_personal_data_keeps_base_spans_and_adds_credentials(spark, documents, odd, empty):
    for docs in (documents, odd):
        rows = pii.personal_data(docs).collect()
        texts = sorted(map(repr, ((r.doc_id, sorted(brute_spans(r.text or ""))) for r in docs.collect())))
        assert sorted(repr((r.doc_id, sorted((s.kind, s.start, s.stop) for s in r.base))) for r in rows) == texts
        assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in rows)
    docs = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in pii.personal_data(documents).collect():
        for s in r.spans:
            if s.kind == "secret":
                assert re.search(r"(token|key)\W*$", docs[r.doc_id][: s.start])
        ends = sorted((s.start, s.stop) for s in r.spans)
        added = [tuple(s) for s in r.spans if s not in r.base]
        assert all(not (a < s[2] and s[1] < b) for s in added for a, b in ends if (a, b) != s[1:])
    assert pii.personal_data(empty).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    held = docs.join(labels.where("doc_id % 5 = 0"), "doc_id")
    rows = toxicity.with_severity(held, model).select("toxic", "severity.*").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    caught = sum(r.p_toxic >= toxicity.TOXIC_FROM for r in toxic) / len(toxic)
    wrong = sum(r.p_toxic >= toxicity.TOXIC_FROM for r in clean) / len(clean)
    assert caught > 0.9 and wrong < 0.02
    assert np.mean([r.expected_severity for r in toxic]) > 1 > 0.2 > np.mean([r.expected_severity for r in clean])


def test_thresholds_are_ordered_and_gradients_right():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 3))
    grade = np.digitize(x @ [2.0, -1.0, 0.0] + draw.logistic(size=400), [-1, 1, 2.5])
    row, column = (a.ravel() for a in np.indices(x.shape))
    weights, thresholds = toxicity.fit_ordinal(row, column, x.ravel(), grade, 3, rounds=2000)
    assert (np.diff(thresholds) > 0).all() and abs(weights[0] + 2 * weights[1]) < 0.5 and abs(weights[2]) < 0.3
    assert np.abs(thresholds - [-1, 1, 2.5]).max() < 0.6


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, "x"), (7, 0, "x"), (7, 1, "x"), (9, 0, "x"), (None, 1, "x"), (1, None, "x"), (3, 0, "x")], "doc_id long, toxic int, row string")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.expected_severity <= 3 for r in rows)
    for some in (labels.where("toxic = 0"), labels.where("1 = 0")):
        assert not any(r.toxic for r in toxicity.toxicity(odd, some).collect())
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def brute_distance(item, text):
    """Fewest edits between the item and any run of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(words, draw, k):
    copy = list(words)
    for _ in range(k):
        at, kind = draw.randrange(len(copy)), draw.random()
        if kind < 0.34:
            copy[at] = "zzz"
        elif kind < 0.67:
            del copy[at]
        else:
            copy.insert(at, "qqq")
    return copy


def test_alignment_equals_brute_force():
    draw = random.Random(2)
    for _ in range(200):
        item = [draw.randrange(5) for _ in range(draw.randrange(1, 12))]
        text = [draw.randrange(5) for _ in range(draw.randrange(0, 25))]
        distance, start, stop = decontaminate.fit_distance(np.array(item), np.array(text, np.int64))
        assert distance == brute_distance(item, text)
        assert 0 <= start <= stop <= len(text)
        assert brute_distance(item, text[start:stop]) == distance


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]


def test_edited_copies_reach_the_target_recall(items, texts):
    detector, draw = decontaminate.Detector(items), random.Random(3)
    clean = [decontaminate.words(t)[:80] for t in list(texts.values())[:40]]
    found = 0
    for n in range(200):
        item_id, text = draw.choice(items)
        words = decontaminate.words(text)
        copy = edited(words, draw, decontaminate.allowed(len(words)))
        hits = detector.leaks([" ".join([*draw.choice(clean), *copy, *draw.choice(clean)])])[0]
        found += any(h[0] == item_id for h in hits)
    assert found >= 0.95 * 200


def test_items_of_all_lengths_are_found(items):
    """Items of every length class, edited as far as allowed, are all found, whether or not the walk reaches its target."""
    draw = random.Random(5)
    lengths = (20, 34, 59, 100, 128, 200, 256, 300)
    longer = [(10_000 + n, " ".join(f"w{draw.randrange(3000)}" for _ in range(n))) for n in lengths]
    for benchmark in (items, longer):
        detector = decontaminate.Detector(benchmark)
        for c, (repetitions, recall) in detector.reached.items():
            assert detector.repetitions[c] == (repetitions if recall >= decontaminate.TARGET_RECALL else 0)
        found = {c: [] for c in detector.classes}
        for k, (item_id, symbols) in enumerate(detector.items):
            words = decontaminate.words(dict(benchmark)[item_id])
            for _ in range(2 if benchmark is items else 25):
                copy = edited(words, draw, decontaminate.allowed(len(words)))
                hits = detector.leaks([" ".join(["lead"] * draw.randrange(9) + copy + ["trail"] * draw.randrange(9))])[0]
                found[detector.class_of[k]].append(any(h[0] == item_id for h in hits))
        for c, hits in found.items():
            assert all(hits), (c, np.mean(hits))
        assert 0 in detector.repetitions.values()


def test_leaks_equal_brute_force(spark, documents, texts, items):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    wanted = {(r.item_id, tuple(decontaminate.words(r.text))) for r in benchmark.collect()}
    found = {r.doc_id: {h.item_id for h in r.leaks} for r in decontaminate.contamination(documents, benchmark).collect()}
    for doc_id, text in texts.items():
        words = decontaminate.words(text)
        known = set(words)
        want = set()
        for item_id, item in wanted:
            if sum(w in known for w in item) >= 0.8 * len(item) and brute_distance(item, words) <= decontaminate.allowed(len(item)):
                want.add(item_id)
        assert found[doc_id] == want


def test_blocks_of_items_and_odd_rows(spark, odd, empty, monkeypatch):
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, "!!!"), (None, "word1 word2"), (4, "word5 word6 word7 word8 word9 word10"), (5, "same text here")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    want = {(7, (1,)), (3, (4,)), (4, (4,)), (5, (5,)), (6, (5,))}
    for block in (20_000, 1):
        monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", block)
        found = decontaminate.contamination(odd, benchmark).collect()
        assert len(found) == odd.count()
        assert {(r.doc_id, tuple(sorted(h.item_id for h in r.leaks))) for r in found if r.contaminated} == want
        assert decontaminate.drop_contaminated(odd, benchmark).columns == odd.columns
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, benchmark.where("1 = 0")).collect())


def test_planted_notices_are_found(spark, documents):
    found = {r.doc_id: r for r in licenses.scan_licenses(documents, F.lit("x")).collect()}
    lines = {"MIT": "under the MIT License", "CC-BY-NC-4.0": "under CC BY-NC 4.0", "Apache-2.0": "under the Apache License", "GPL-3.0": "GNU General Public License, version 3"}
    for r in documents.collect():
        want = {name for name, line in lines.items() if line in r.text}
        assert (found[r.doc_id].license in want) if want else found[r.doc_id].license is None
        if want:
            assert lines[found[r.doc_id].license] in r.text[found[r.doc_id].start : found[r.doc_id].stop] + "."


def test_long_licence_files_and_odd_rows(spark, odd, empty):
    long = " ".join(["intro"] * 500) + " " + licenses.TEMPLATES[1][1] + " " + "rest " * 500
    docs = odd.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(50, long, "x")], "doc_id long, text string, row string"))
    rows = licenses.scan_licenses(docs, F.lit(None).cast("string")).collect()
    assert len(rows) == docs.count() and [r.license for r in rows if r.doc_id == 50] == ["MIT"]
    assert {r.license for r in rows if r.doc_id != 50} == {None}
    assert licenses.scan_licenses(empty, F.lit("x")).count() == 0


def test_notices_in_every_document_are_found(spark):
    """The share of documents that carry a notice doesn't decide whether it is found."""
    lines = {k: text for k, (_, text) in enumerate(licenses.TEMPLATES)}
    for share in (1, 3, 10):
        for k, line in lines.items():
            texts = [f"alpha{n} beta{n} gamma{n}. {line} delta{n}" if n % share == 0 else f"under the license, version 2.0, work {n}" for n in range(30)]
            terms, words = licenses.vocabulary(licenses.TEMPLATES), [set(licenses.WORD.findall(t.lower())) for t in texts]
            matcher = licenses.Matcher(licenses.TEMPLATES, {w: sum(w in own for own in words) for w in terms}, len(texts))
            for n, text in enumerate(texts):
                found = matcher.notice(text)
                if n % share == 0:
                    assert found["license"] == licenses.TEMPLATES[k][0] and found["cosine"] == 1
                    assert text[found["start"] : found["stop"]] in line
                else:
                    assert found is None
    rows = [(n, f"# Licensed under the Apache License, Version 2.0.\nx{n} = {n}") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.license for r in licenses.scan_licenses(docs, F.lit("x")).collect()} == {"Apache-2.0"}


def test_inheritance_from_the_nearest_ancestor(spark):
    rows = [("LICENSE", "MIT"), ("a/LICENSE.txt", "ISC"), ("a/COPYING", "GPL-3.0"), ("a/x.py", None), ("a/b/y.py", None), ("a/b/own.py", "BSD-3-Clause"), ("c/d/e.py", None), ("top.py", None), (None, None), (None, "MIT"), ("a/b/notice.py", "MIT")]
    files = spark.createDataFrame(rows, "path string, license string")
    found = {(r.path, r.license): (r.effective, r.from_directory, r.levels) for r in licenses.inherited(files).collect()}
    assert found["a/x.py", None] == ("GPL-3.0", "a", 0) and found["a/b/y.py", None] == ("GPL-3.0", "a", 1)
    assert found["c/d/e.py", None] == ("MIT", "", 2) and found["top.py", None] == ("MIT", "", 0)
    assert found["a/b/own.py", "BSD-3-Clause"] == ("BSD-3-Clause", None, 0) and found[None, None] == (None, None, None)
    assert len(found) == len(rows)


def test_registered_results_have_their_columns(spark):
    rows = queries.op6_pii(spark, SF)
    assert rows.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
