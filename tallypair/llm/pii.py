"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried at its first digit only: if that fails, all others do
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
CHUNK = re.compile(r"[^\s]+")
TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|[^\sA-Za-z0-9]")
DIGITS = re.compile(r"[0-9]+")
#: Tokens and characters of a span, tokens that a region for learning has at most.
LONGEST, LONGEST_CHARS, LEARN_TOKENS = 16, 320, 120

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low = 0
    while (at := text.find("@", low)) >= 0:
        a = at
        while a > low and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
        low = m.end() if m else at + 1


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    if not TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Where personal data may be: chunks between white space that hold a digit or an at sign, joined
    with the next ones over one space."""
    if not TRIGGER.search(text):
        return
    held = None
    for m in CHUNK.finditer(text):
        if TRIGGER.search(m[0]):
            if held and m.start() == held[1] + 1 and text[held[1]] == " ":
                held = (held[0], m.end())
            else:
                if held:
                    yield held
                held = m.span()
    if held:
        yield held


def features(region: str, a: int, b: int) -> list[str]:
    """Whole-span features of one candidate segment."""
    s = region[a:b]
    runs = DIGITS.findall(s)
    n = sum(map(len, runs))
    out = ["bias", f"digits={min(n, 20)}", f"at={s.count('@')}", f"letters={any(c.isalpha() for c in s)}"]
    out.append("shape=" + "-".join(str(min(len(r), 17)) for r in runs[:6]))
    out.append("marks=" + "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", s)))))
    if 12 <= n <= 19:
        out.append(f"luhn={luhn(''.join(runs))}")
    if len(runs) == 4:
        out.append(f"bytes={all(len(r) <= 3 and int(r) <= 255 for r in runs)}")
    out.append("first=" + ("+" if s[0] == "+" else "(" if s[0] == "(" else "d" if s[0].isdigit() else "a"))
    before, after = region[a - 1 : a], region[b : b + 1]
    out.append("before=" + ("" if not before or before == " " else "a" if before.isalnum() else before))
    out.append("after=" + ("" if not after or after == " " else "a" if after.isalnum() else after))
    return out


def endings(region: str) -> Iterator[tuple[int, list[tuple[int, int, list[str]]]]]:
    """For each token where it ends, and the candidate segments that end there as (tokens, start,
    features), the longest first. Only the last ``LONGEST`` borders are held, however long the region."""
    starts: deque[int] = deque(maxlen=LONGEST)
    seen = -1
    for n, m in enumerate(TOKEN.finditer(region)):
        start, b = m.span()
        starts.append(start)
        if TRIGGER.search(region, start, b):
            seen = n
        found = []
        if region[b - 1].isalnum():
            for back, a in enumerate(reversed(starts), 1):
                if b - a > LONGEST_CHARS:
                    break
                if seen > n - back and (region[a].isalnum() or region[a] in "+("):
                    found.append((back, a, features(region, a, b)))
        yield b, found[::-1]


class SpanField:
    """A semi-Markov conditional random field: weights of (kind, feature); tokens outside score 0."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}

    def score(self, kind: int, found: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in found)

    def _gradient(self, region: str, gold: set[Span]) -> dict[tuple[int, str], float]:
        """Of the log likelihood of the gold segmentation: observed minus expected features."""
        borders, found = [0], []
        for b, segments in endings(region):
            borders.append(b)
            found += [(len(borders) - 1 - back, len(borders) - 1, fs) for back, _, fs in segments]
        n = len(borders) - 1
        into: list[list] = [[] for _ in range(n + 1)]
        outof: list[list] = [[] for _ in range(n + 1)]
        for i, j, fs in found:
            for kind in range(len(KINDS)):
                edge = (i, j, kind, fs, self.score(kind, fs))
                into[j].append(edge)
                outof[i].append(edge)

        def total(xs: list[float]) -> float:
            top = max(xs)
            return top + math.log(sum(math.exp(x - top) for x in xs))

        ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = total([ahead[j - 1], *(ahead[e[0]] + e[4] for e in into[j])])
        for i in range(n - 1, -1, -1):
            back[i] = total([back[i + 1], *(back[e[1]] + e[4] for e in outof[i])])
        step: dict[tuple[int, str], float] = {}
        for edges in outof:
            for i, j, kind, fs, s in edges:
                change = ((borders[i], kind, borders[j]) in gold) - math.exp(ahead[i] + s + back[j] - ahead[n])
                if abs(change) > 1e-4:
                    for f in fs:
                        step[kind, f] = step.get((kind, f), 0.0) + change
        return step

    def learn(self, samples: list[str], rounds: int = 6, rate: float = 0.5, decay: float = 0.002) -> SpanField:
        for k in range(rounds):
            for region in samples:
                gold, end = set(), 0
                for a, kind, b in base_spans(region):
                    if a >= end:
                        gold.add((a, kind, b))
                        end = b
                for key, change in self._gradient(region, gold).items():
                    w = self.weights.get(key, 0.0)
                    self.weights[key] = w + rate / (1 + k) * (change - decay * w)
        return self

    def decode(self, region: str, least: float = 1.0) -> list[Span]:
        """The best segmentation, spans of at most ``LONGEST`` tokens and ``LONGEST_CHARS`` characters; a span
        has to add ``least``. Held are the scores at the last borders, and the spans chosen up to them."""
        best: deque[float] = deque([0.0], LONGEST)
        paths: deque[tuple | None] = deque([None], LONGEST)
        for b, segments in endings(region):
            top, path = best[-1], paths[-1]
            for back, a, fs in segments:
                scores = [self.score(kind, fs) for kind in range(len(KINDS))]
                kind = max(range(len(KINDS)), key=scores.__getitem__)
                if scores[kind] > least and best[-back] + scores[kind] - least > top:
                    top, path = best[-back] + scores[kind] - least, (paths[-back], (a, kind, b))
            best.append(top)
            paths.append(path)
        out, path = [], paths[-1]
        while path:
            path, span = path
            out.append(span)
        return out


def learn_field(docs: DataFrame, sample: int = 400) -> SpanField:
    """Fit on the regions of ``docs``, their fixed-pattern spans as labels. The driver gets ``sample``
    regions of up to ``LEARN_TOKENS`` tokens, by hash order: a bounded sample; the rest of the work
    covers all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {t[a:b] for t in batch.column(0).to_pylist() if t for a, b in regions(t)}
            found = sorted(x for x in found if len(x) < 6 * LEARN_TOKENS and len(TOKEN.findall(x)) <= LEARN_TOKENS)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["region"])

    rows = docs.select(F.col("text").cast("string")).where(F.col("text").rlike("[0-9@]")).mapInArrow(run, "region string")
    taken = rows.distinct().orderBy(F.xxhash64("region"), "region").limit(sample).collect()
    return SpanField().learn([r.region for r in taken])


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def personal_data(docs: DataFrame, sample: int = 400) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every whole text.

    The fixed patterns give the base spans and counts; the field adds spans that meet no base span.
    Places are code points, ends exclusive. Null or empty text: no spans, the hash of nothing. Repeated
    rows and null ids each get a row; an empty table gives none; other columns are ignored. One narrow
    pass, after the one that draws the sample for learning.
    """
    field = learn_field(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more, taken = [], bytearray(len(text or ""))
                for a, _, b in base:
                    taken[a:b] = b"1" * (b - a)
                for a, b in regions(text) if text else ():
                    for x, kind, y in field.decode(text[a:b]):
                        if not any(taken[a + x : a + y]):
                            more.append((x + a, kind, y + a))
                counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(said(base).encode()).hexdigest(), said(base + more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
