"""Personal data by weak supervision.

Candidates are the strict base matches (e-mail, IP, card, phone) and looser forms: digit
runs like cards, phones without a plus, spelled-out e-mails, account numbers, credentials.
Six labelers vote on every candidate: format, checksum, gazetteer, context words, neighbours
and delimiters; each says yes (1), no (-1) or nothing (0). Expectation-maximisation over the
counts of vote patterns estimates the labelers' reliabilities per kind; its posteriors are
the soft labels of a final span classifier (logistic regression over kind, votes and shape).

Texts are read once. What meets on the driver are counts of feature patterns, a domain of
fixed size; the counts cover every candidate of the corpus. Base matches always stay; the
classifier adds candidates that it is sure of and that overlap no base match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.plans.reuse import materialize

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "id", "secret"]
LABELERS = ["format", "checksum", "gazetteer", "context", "neighbours", "delimiters"]
SURE = 0.9
EM_ROUNDS = 50

# Base patterns. Possessive runs and the look-behind only avoid repeated scans of one run; the matches are the same.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser forms.
LOOSE_PHONE = re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?!\w)")
LOOSE_EMAIL = re.compile(r"(?<!\w)[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,63}){1,4}(?!\w)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
NATIONAL_ID = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
SECRET = re.compile(r"(?<!\w)([A-Za-z_]{2,32}) ?[=:] ?[\"']?([A-Za-z0-9+/_-]{16,}+)")

# Gazetteers (fixed values): common top-level domains, calling codes, card networks' first digits, names of credentials.
TOP_LEVEL = set("com org net edu gov mil int info biz io co de fr es it nl pl uk us ca au ch at be se no fi dk pt ru cn jp kr br mx in eu example".split())
CALLING_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98".split())
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "2", "6011", "65")
CREDENTIALS = set("token key api_key apikey secret password passwd pwd auth access_token bearer private_key".split())
# Words in front of a value that name its kind (fixed values).
CUES = {
    "email": set("email mail e-mail contact write courriel correo kontakt".split()),
    "ip": set("ip host server address addr adresse ping".split()),
    "card": set("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "phone": set("phone tel telephone call fax mobile cell telefon téléphone teléfono".split()),
    "iban": set("iban account bank konto compte cuenta".split()),
    "id": set("ssn social security id passport ausweis".split()),
    "secret": CREDENTIALS,
}
WORD = re.compile(r"[\w-]+")
NEAR = 200


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches: per kind leftmost and without overlap; failing matches are dropped, not retried."""
    spans = []
    at = text.find("@")
    begin = 0  # no match may start earlier: the end of the last match or the last @
    while at >= 0:
        start = begin + len(text[begin:at].rstrip(LOCAL_PART))
        begin = at + 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            spans.append(("email", start, domain.end()))
            begin = domain.end()
        at = text.find("@", begin)
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            spans.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(only_digits(m[0])) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base matches."""
    spans = [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(only_digits(m[0])) <= 19]
    spans += [("phone", m.start(), m.end()) for m in LOOSE_PHONE.finditer(text)]
    spans += [("id", m.start(), m.end()) for m in NATIONAL_ID.finditer(text)]
    spans += [("iban", m.start(), m.end()) for m in IBAN.finditer(text)]
    if "[at]" in text or "(at)" in text:
        spans += [("email", m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        spans += [("secret", m.start(2), m.end(2)) for m in SECRET.finditer(text)]
    return spans


def checksum(kind: str, value: str) -> int:
    """1 passes, -1 fails, 0 the kind has no check."""
    digits = only_digits(value)
    if kind == "card":
        return 1 if luhn(digits) else -1
    if kind == "iban":
        packed = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in packed[4:] + packed[:4])
        return 1 if int(number) % 97 == 1 else -1
    if kind == "id":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 0
    if kind == "phone":
        return 1 if 10 <= len(digits) <= 15 else -1
    if kind == "secret":  # credentials mix letters and digits and seldom repeat
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        return 1 if mixed and len(set(value)) >= 8 else -1
    return 0


def gazetteer(kind: str, value: str, name: str) -> int:
    if kind == "email":
        return 1 if value.rsplit(".", 1)[-1].lower() in TOP_LEVEL else -1
    if kind == "card":
        return 1 if only_digits(value).startswith(CARD_STARTS) else -1
    if kind == "phone":
        code = only_digits(value)[:3]
        return 0 if value[0] != "+" else 1 if any(code.startswith(c) for c in CALLING_CODES) else -1
    if kind == "secret":
        return 1 if name in CREDENTIALS else -1
    if kind == "ip":
        return -1 if value.startswith(("0.", "255.")) else 1
    return 0


def votes(text: str, kind: str, start: int, end: int, base: bool, near: bool) -> tuple[list[int], list[int]]:
    """The labelers' votes on a candidate and its shape (length class, digit share)."""
    value, before = text[start:end], text[max(0, start - 48) : start]
    words = [w.lower() for w in WORD.findall(before)][-5:]
    context = 1 if CUES[kind] & set(words) else -1 if any(c & set(words) for k, c in CUES.items() if k != kind) else 0
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    strict = base or kind in ("iban", "id", "secret")
    said = [1 if strict else -1, checksum(kind, value), gazetteer(kind, value, words[-1] if words else ""), context, int(near), -1 if glued else 1]
    shape = [min(7, len(value) // 5), int(4 * len(only_digits(value)) / len(value))]
    return said, shape


def find_candidates(text: str) -> list[tuple[str, int, int, bool, int, list[int], list[int]]]:
    """All candidates of a text by start and kind: kind, start, end, base, id of the feature pattern's parts."""
    if "@" not in text and "=" not in text and ":" not in text and "(at)" not in text and "[at]" not in text and not re.search("[0-9]", text):
        return []
    base = base_spans(text)
    taken = set(base)
    order = {k: n for n, k in enumerate(KINDS)}
    spans = sorted([(s, order[k], e, True) for k, s, e in base] + [(s, order[k], e, False) for k, s, e in set(loose_spans(text)) - taken])
    places = sorted(s for _, s, _ in base)
    found = []
    for s, k, e, is_base in spans:
        at = np.searchsorted(places, s)
        close = [p for p in places[max(0, at - 1) : at + 2] if p != s and abs(p - s) <= NEAR]
        said, shape = votes(text, KINDS[k], s, e, is_base, bool(close))
        found.append((KINDS[k], s, e, is_base, said, shape))
    return found


SPAN = "struct<kind string, start long, stop long, base boolean, votes string, shape string>"
SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("shape", pa.string())])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its candidates. Null text has none. Written once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = find_candidates(text.as_py() or "")
                rows.append([
                    {"kind": k, "start": s, "stop": e, "base": b, "votes": ",".join(map(str, said)), "shape": ",".join(map(str, shape))}
                    for k, s, e, b, said, shape in found
                ])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN_TYPE))], names=["doc_id", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(narrow.mapInArrow(scan, f"doc_id long, spans array<{SPAN}>"), "pii-candidates")


def estimate_reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns of one kind, as counted.

    Returns the share of true candidates, P(vote | truth) as [labeler, truth, vote + 1], and
    the posterior of each pattern. Starts from the majority of votes; smoothed by one vote each.
    """
    said = np.array(list(patterns), int).reshape(len(patterns), -1)
    count = np.array(list(patterns.values()), float)
    belief = np.clip(0.5 + said.sum(1) / (2 * said.shape[1]), 0.05, 0.95)
    for _ in range(rounds):
        prior = (belief @ count + 1) / (count.sum() + 2)
        odds = np.array([1 - belief, belief]) * count  # [truth, pattern]
        chance = np.stack([[[(odds[t] @ (said[:, j] == v)) + 1 for v in (-1, 0, 1)] for t in (0, 1)] for j in range(said.shape[1])])
        chance /= chance.sum(2, keepdims=True)
        logs = np.log([1 - prior, prior])[:, None] + sum(np.log(chance[j][:, said[:, j] + 1]) for j in range(said.shape[1]))
        belief = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return float(prior), chance, dict(zip(patterns, belief.tolist()))


def feature_row(kind: str, said: tuple[int, ...], shape: tuple[int, ...]) -> list[str]:
    return [f"kind={kind}", *[f"{kind}:{name}={v}" for name, v in zip(LABELERS, said)], f"{kind}:length={shape[0]}", f"{kind}:digits={shape[1]}"]


def fit_span_classifier(counts: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3):
    """Logistic regression on feature patterns with EM posteriors as soft labels, weighted by counts.

    Returns the function (kind, votes, shape) -> probability.
    """
    belief = {}
    for kind, rows in groupby(sorted(counts), key=lambda r: r[0]):
        patterns: dict[tuple[int, ...], int] = {}
        for _, said, _, n in rows:
            patterns[said] = patterns.get(said, 0) + n
        belief |= {(kind, said): p for said, p in estimate_reliabilities(patterns)[2].items()}
    names = sorted({f for kind, said, shape, _ in counts for f in feature_row(kind, said, shape)})
    index = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(counts), len(names)))
    for r, (kind, said, shape, _) in enumerate(counts):
        x[r, [index[f] for f in feature_row(kind, said, shape)]] = 1
    y = np.array([belief[kind, said] for kind, said, _, _ in counts])
    n = np.sqrt(np.array([c for *_, c in counts], float))  # rare patterns count for something
    weights, seen = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(rounds if len(counts) else 0):
        slope = x.T @ (n * (1 / (1 + np.exp(-x @ weights)) - y)) / n.sum() + ridge * weights
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen)

    def probability(kind: str, said: tuple[int, ...], shape: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-sum(weights[index[f]] for f in feature_row(kind, said, shape) if f in index))))

    return probability


def personal_data(docs: DataFrame, sure: float = SURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (array of spans), spans (base and added ones).

    Spans are structs kind, start, stop (code points, stop exclusive) by start and kind.
    Null and empty texts have none; repeated rows and null ids each get a row.
    """
    found = candidates(docs, id_col, text_col)
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count()
    numbers = lambda text: tuple(map(int, text.split(",")))
    counts = sorted((r["kind"], numbers(r["votes"]), numbers(r["shape"]), r["count"]) for r in counted.collect())
    probability = fit_span_classifier(counts)
    accepted = {(k, ",".join(map(str, v)), ",".join(map(str, s))) for k, v, s, _ in counts if probability(k, v, s) >= sure}
    order = {k: n for n, k in enumerate(KINDS)}

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, alls = [], []
            for spans in batch.column(1).to_pylist():
                base = [s for s in spans if s["base"]]
                ends, added = sorted((s["start"], s["stop"]) for s in base), []
                free = 0  # where the last added span ends
                starts = [a for a, _ in ends]
                for s in spans:
                    if s["base"] or (s["kind"], s["votes"], s["shape"]) not in accepted or s["start"] < free:
                        continue
                    at = int(np.searchsorted(starts, s["stop"]))
                    if all(b <= s["start"] for _, b in ends[max(0, at - len(BASE_KINDS) * 2) : at]):
                        added.append(s)
                        free = s["stop"]
                cut = lambda rows: [{"kind": s["kind"], "start": s["start"], "stop": s["stop"]} for s in rows]
                place = lambda s: (s["start"], order[s["kind"]])
                bases.append(cut(sorted(base, key=place)))
                alls.append(cut(sorted(base + added, key=place)))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, kind), pa.array(alls, kind)], names=["doc_id", "base", "spans"])

    out = "array<struct<kind string, start long, stop long>>"
    return found.mapInArrow(settle, f"doc_id long, base {out}, spans {out}")
