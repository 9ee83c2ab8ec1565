"""Line dedup: undecided buckets, small ones by the sketches of all pairs, crowded ones by their rarest shingles."""

import random
import string

import pytest

from tallypair.llm import line_dedup
from tallypair.llm.line_dedup import remove_repeated_lines


def clusters(rng):
    """Lines of clusters that share half of their shingles, and the numbers of those that stay by all pairs."""
    letters = lambda n: "".join(rng.choices(string.ascii_letters, k=n))
    head, lines = letters(300), []
    for _ in range(30):
        tail = letters(45)
        for _ in range(rng.randint(1, 4)):
            t = list(head + tail)
            for at in rng.sample(range(len(t)), rng.randint(0, 2)):
                t[at] = "#"
            lines.append("".join(t))
    rng.shuffle(lines)
    of, label = [{x[i : i + 12] for i in range(len(x) - 11)} for x in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(of[i] & of[j]) >= 0.8 * len(of[i] | of[j]):
                new, old = sorted((label[i], label[j]))
                label = [new if k == old else k for k in label]
    return lines, set(label)


@pytest.mark.parametrize("crowd", [2048, 4])
def test_lines_of_undecided_buckets(spark, monkeypatch, crowd):
    lines, left = clusters(random.Random(8))
    ranked, candidates = [], line_dedup._candidates
    monkeypatch.setattr(line_dedup, "MORE", 2)
    monkeypatch.setattr(line_dedup, "CROWD", crowd, raising=False)
    monkeypatch.setattr(line_dedup, "_candidates", lambda rows, similar: ranked.append(rows.count()) or candidates(rows, similar))
    got = remove_repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {r.doc_id for r in got.where("n_removed = 0").collect()} == left
    assert (sum(ranked) > 0) == (crowd < len(lines))
