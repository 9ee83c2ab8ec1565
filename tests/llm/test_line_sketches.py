"""Line dedup: recall at the threshold, sketches that never part similar lines, crowded buckets beyond the pivots, blank lines."""

import random
import re
import string

from tallypair.llm import line_dedup
from tallypair.llm.line_dedup import _sketches, lines_of, remove_repeated_lines


def shingles(line):
    return {line[i : i + 12] for i in range(max(len(line) - 11, 1))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def near_pairs(rng, many, low, high):
    """Pairs of lines of a similarity in [low, high), each of letters of its own."""
    out = []
    while len(out) < many:
        one = "".join(rng.choices(string.ascii_letters, k=rng.randint(30, 400)))
        two = list(one)
        for at in rng.sample(range(len(one)), rng.randint(1, 3)):
            two[at] = "#"
        two = "".join(two)
        if low <= jaccard(shingles(one), shingles(two)) < high:
            out.append((one, two))
    return out


def test_recall_at_the_threshold(spark):
    pairs = near_pairs(random.Random(5), 1000, 0.8, 0.86)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    gone = {r.doc_id for r in remove_repeated_lines(docs).where("n_removed > 0").collect()}
    assert len(gone) >= 985 and all(i % 2 for i in gone)


def test_sketches_differ_in_no_more_bits_than_lines_in_shingles(spark):
    rng = random.Random(6)
    lines = [x for p in near_pairs(rng, 20, 0.5, 1.0) for x in p] + ["ab" * 300, "abc" * 300, "ab", "", "x" * 13, "é😀" * 40]
    lines += ["".join(rng.choices("ab", k=3000)), "".join(rng.choices("ab ", k=3000))]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows = {r.id: r for r in _sketches(frame).collect()}
    assert sorted(rows) == list(range(len(lines)))
    of = [shingles(x) for x in lines]
    for i in range(len(lines)):
        assert rows[i].n == max(len(lines[i]) - 11, 1)
        for j in range(i):
            bits = sum(((rows[i][f"s{k}"] ^ rows[j][f"s{k}"]) & (2**64 - 1)).bit_count() for k in range(line_dedup.WIDE))
            assert bits <= len(of[i] ^ of[j])


def test_a_bucket_of_more_lines_than_pivots(spark):
    """Clusters that share half of their shingles: what stays equals all pairs, whatever the pivots decide."""
    rng = random.Random(7)
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
    of, label = [shingles(x) for x in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if jaccard(of[i], of[j]) >= 0.8:
                new, old = sorted((label[i], label[j]))
                label = [new if k == old else k for k in label]
    got = remove_repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {r.doc_id for r in got.where("n_removed = 0").collect()} == set(label)


def test_blank_lines_are_those_without_a_character_but_ascii_space(spark):
    blanks = ["", " ", "\t \x0b\x0c\r", " ", " ", " a", "\x00", "\x1c", "\u0085"]
    docs = spark.createDataFrame([(0, 0, "\n".join(blanks))], "doc_id long, tag long, text string")
    kept = {r.n for r in lines_of(docs).collect()}
    assert kept == {i for i, x in enumerate(blanks) if re.search(r"[^ \t\n\x0b\f\r]", x)}
