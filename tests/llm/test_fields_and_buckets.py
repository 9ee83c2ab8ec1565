"""The span field's programme and gradient against all segmentations, the fixed patterns against plain
regular expressions, and the refined buckets against the strings themselves."""

import itertools
import math
import random
import re

import numpy as np

from tallypair.llm.pii import KINDS, LONGEST, SpanField, base_spans, endings, luhn
from tallypair.llm.suffix_dedup import refined

REGIONS = ["+1 (23)", "a@b.c 1.2", "12-34 5", "x1@y", "(1) +2", "9"]


def segmentations(field, region):
    """Every way to cut a region: (score, spans)."""
    ends, into = [0], {}
    for b, segments in endings(region):
        ends.append(b)
        for back, a, found in segments:
            into.setdefault(len(ends) - 1, []).append((back, a, b, found))

    def cut(j):
        if not j:
            return [(0.0, ())]
        out = cut(j - 1)
        for back, a, b, found in into.get(j, []):
            for kind in range(len(KINDS)):
                s = field.score(kind, found)
                out = out + [(t + s, (*spans, (a, kind, b))) for t, spans in cut(j - back)]
        return out

    return cut(len(ends) - 1)


def field_of(rng, regions):
    found = {(k, f) for r in regions for _, segments in endings(r) for *_, fs in segments for f in fs for k in range(len(KINDS))}
    return SpanField({key: rng.gauss(0, 1) for key in sorted(found)})


def test_decoding_against_all_segmentations():
    rng = random.Random(6)
    for _ in range(20):
        field = field_of(rng, REGIONS)
        for region in REGIONS:
            best = max(s - len(spans) for s, spans in segmentations(field, region))
            got = sorted(field.decode(region))
            assert all(x[2] <= y[0] for x, y in itertools.pairwise(got))
            scored = {tuple(spans): s - len(spans) for s, spans in segmentations(field, region)}
            assert math.isclose(scored[tuple(got)], best, abs_tol=1e-9)


def test_gradient_against_differences():
    rng = random.Random(7)
    field = field_of(rng, REGIONS)

    def likelihood(region, gold):
        every = segmentations(field, region)
        return next(s for s, spans in every if set(spans) == gold) - math.log(sum(math.exp(s) for s, _ in every))

    for region, gold in [("+1 (23)", {(0, 3, 6)}), ("a@b.c 1.2", {(0, 0, 5)}), ("12-34 5", set())]:
        step = field._gradient(region, gold)
        for key in rng.sample(sorted(step), 12):
            old = field.weights[key]
            field.weights[key] = old + 1e-5
            up = likelihood(region, gold)
            field.weights[key] = old - 1e-5
            slope = (up - likelihood(region, gold)) / 2e-5
            field.weights[key] = old
            assert abs(slope - step[key]) < 2e-3


def test_long_regions_are_streamed():
    region = "12 34-" * 200_000
    seen = list(itertools.islice(endings(region), 50))
    assert all(len(segments) <= LONGEST for _, segments in seen)
    assert [b for b, _ in itertools.islice(endings("7" * 5000 + " 5"), 3)] == [5000, 5001, 5002]
    assert SpanField().decode("1 " * 2000 + "1") == []


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(9)
    for signs in ("01.", "a@.-1 ", "+1 ().-", "4- ", "+0129.@a -é"):
        for _ in range(3000):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
            assert base_spans(text) == plain_spans(text), text


def test_refined_buckets_against_strings():
    rng = random.Random(1)
    for _ in range(150):
        signs = rng.choice([b"a", b"ab", b"\0a", b"\0", bytes(range(5)), b"abcdefgh"])
        any_of = lambda n: bytes(rng.choice(signs) for _ in range(n))  # noqa: E731, B023
        parts = [any_of(rng.randint(1, 150))]
        for _ in range(rng.randint(0, 30)):
            old = rng.choice(parts)
            parts.append(any_of(1) + old[rng.randrange(len(old)) :] + any_of(rng.randint(0, 5)) if rng.random() < 0.5 else any_of(rng.randint(1, 150)))
        size = np.array([len(p) for p in parts])
        ends, width = np.repeat(np.cumsum(size), size), rng.choice([8, 9, 13, 16, 50, 50, 70])
        text = b"".join(parts)
        bucket = refined(np.frombuffer(text, np.uint8), ends, width).tolist()
        of, back = {}, {}
        for i, b in enumerate(bucket):
            assert (b < 0) == (i + width > ends[i])
            if b >= 0:
                string = text[i : i + width]
                assert of.setdefault(string, b) == b and back.setdefault(b, string) == string


def test_field_finds_forms_that_the_patterns_miss():
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda: next(d for d in iter(lambda: digits(16), "") if luhn(d))
    phone = lambda: f"+{rng.randint(1, 9)} ({digits(3)}) {digits(3)}-{digits(4)}"
    address = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    email = lambda: f"{rng.choice('abc')}.{digits(2)}@x{digits(1)}.example"
    makers = [email, address, card, phone, lambda: f"{digits(2)}.{digits(1)}.", lambda: f"k{digits(5)}b{digits(6)}"]
    field = SpanField().learn([rng.choice(makers)() for _ in range(300)])
    for _ in range(50):
        c, p = card(), phone()[1:]
        text = ".".join(c[i : i + 4] for i in range(0, 16, 4))
        assert field.decode(text) == [(0, 2, 19)] and not [s for s in base_spans(text) if s[1] == 2]
        assert field.decode(p) == [(0, 3, len(p))] and not base_spans(p)
