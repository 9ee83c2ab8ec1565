"""Vector codes, whitening and packing against plain versions."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from tallypair.llm import packing
from tallypair.llm.queries import OP11_SQL
from tallypair.llm.vector_codes import Cells, compress_vectors
from tallypair.llm.whitening import Centre, leading_pairs, minres, whiten

KIND = "vec_id long, embedding array<double>, label int, error string, n string"


def vectors(n=300, size=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=size) + 3 * (i % 4)).tolist(), [1, 2, None][i % 3], "e", "n") for i in range(n)]
    rows += [(7, rows[7 % n][1], 5, "", ""), (8, rng.normal(size=size).tolist(), 1, "", ""), (None, rows[9 % n][1], None, "", "")]
    rows += [(900, None, 1, "", ""), (901, [None] + [0.5] * (size - 1), 1, "", ""), (902, [float("nan")] * size, 1, "", ""), (903, [float("-inf")] * size, 1, "", "")]
    return rows + [(1000 + i, rows[0][1], 1, "", "") for i in range(n // 2)]


def good(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = good(rows)
    x = np.floor(4096 * np.array([r[1] for r in rows])).astype(np.int64)
    first = sorted((r[0], r[1], k) for k, r in enumerate(rows) if r[0] is not None)[:entries]
    books = [p[[k for *_, k in first]].copy() for p in np.split(x, parts, axis=1)]

    def assign():
        for p, b in zip(np.split(x, parts, axis=1), books, strict=True):
            d = ((p[:, None] - b[None]) ** 2).sum(2)
            yield p, b, d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p, b, best, _ in list(assign()):
            for e in set(best.tolist()):
                b[e] = [sum(c) // len(c) for c in p[best == e].T.tolist()]
    last = list(assign())
    error = sum(d for *_, d in last).tolist()
    label = {}
    for r, e in zip(rows, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted((-1 if r[0] is None else r[0], "".join(f"{c[k]:02x}" for _, _, c, _ in last), error[k], label[r[2]], sha) for k, r in enumerate(rows))


def tuples(frame):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in frame.collect())


def test_codes_against_plain_rounds_and_sql(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, KIND).repartition(5)
    got = tuples(compress_vectors(frame))
    assert got == plain_codes(rows) and len(got) == 453
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    db.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r[:3]) for r in rows])
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in db.execute(OP11_SQL).fetchall()) == got


def test_codes_of_few_none_and_odd_rows(spark):
    few = vectors(5)
    assert tuples(compress_vectors(spark.createDataFrame(few, KIND))) == plain_codes(few)
    assert compress_vectors(spark.createDataFrame([], KIND)).count() == 0
    assert compress_vectors(spark.createDataFrame(few[-1:] * 0 + [(1, None, 1, "", "")], KIND)).count() == 0
    for bad in ([(1, [0.5] * 12, 1, "", "")], [(1, [0.5] * 16, 1, "", ""), (2, [0.5] * 8, 1, "", "")], [(1, [1e30] * 16, 1, "", "")]):
        with pytest.raises(Exception, match="components|lengths|reaches"):
            compress_vectors(spark.createDataFrame(bad, KIND)).collect()


@pytest.mark.parametrize("width", [1, 3, 8])
def test_cells_lose_no_nearest_entry(width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-3000, 3000, (16, width))
    entries[5] = entries[2]
    x = np.vstack([rng.integers(-6000, 6000, (3000, width)), entries, (entries[:8] + entries[8:]) // 2, rng.integers(-500, 500, (3000, width))])
    cells = Cells(entries)
    for shift in (cells.shift - 3, cells.shift):
        cells = Cells(entries)
        cells.shift = shift
        for _ in range(2):  # the second time from memory
            entry, least = cells.nearest(x)
            d = ((x[:, None] - entries) ** 2).sum(2)
            assert (entry == d.argmin(1)).all() and (least == d.min(1)).all()
    assert width == 8 or cells.compared < 12 * cells.rows
    cells.known = {k: (b"other", m) for k, (_, m) in cells.known.items()}  # hashes that meet
    assert (cells.nearest(x)[0] == d.argmin(1)).all()


def test_whitening_against_a_dense_covariance(spark):
    rows = vectors(400, 24)
    got = whiten(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    x = np.floor(64 * np.array([r[1] for r in good(rows)])).astype(np.int64) + 1_000_000
    ids = [r[0] for r in good(rows)]
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    want = (x - s / n) @ u[:, :16] / np.sqrt(e[:16])
    assert len(got) == 16 * len(x) and {r.n for r in got} == {n}
    of = {}
    for r in got:
        of.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, r)
    sign = np.sign([of[ids[0], int(((n * x[0] - s) ** 2).sum())][c + 1].whitened * want[0, c] for c in range(16)])
    for k, i in enumerate(ids):
        own = of[i, int(((n * x[k] - s) ** 2).sum())]
        for c in range(16):
            assert abs(own[c + 1].whitened * sign[c] - want[k, c]) < 1e-9 and abs(own[c + 1].explained / (e[c] / e.sum()) - 1) < 1e-10
    assert max(r.identity_error for r in got) < 1e-12


def test_whitening_of_few_equal_and_no_rows(spark):
    rows = vectors(2, 4)
    three = whiten(spark.createDataFrame([r for r in rows if r[0] in (0, 1, 8)], KIND)).collect()
    assert {r.component for r in three} == {1, 2} and all(abs(r.whitened) < 2 for r in three)
    assert whiten(spark.createDataFrame([rows[0], rows[0]], KIND)).count() == 0
    assert whiten(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(Exception, match="lengths"):
        whiten(spark.createDataFrame([rows[0], (5, [1.0], 1, "", "")], KIND)).collect()


def test_deviations_beyond_64_bits():
    centre = Centre(3_000_000_000, [3_000_000_000 * 5 + 7, 1])
    small, large = centre.deviations(np.array([[5, 0], [50, 0]])), centre.deviations(np.array([[5, 0], [50, 2]]))
    assert small[0] == 49 + 1 == large[0] and large[1] is None


@pytest.mark.parametrize("size", [1, 7, 60, 200])
def test_pairs_of_clustered_and_spread_spectra(size):
    rng = np.random.default_rng(size)
    turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
    for spectrum in (np.linspace(5, 1, size), np.r_[np.full(size // 2, 3.0), np.linspace(2.9, 0, size - size // 2)], np.r_[100.0, np.zeros(size - 1)]):
        v = (turn * spectrum) @ turn.T
        e, u = leading_pairs(lambda b: v @ b, size, 6)  # noqa: B023
        assert np.allclose(e, np.sort(spectrum)[::-1][:6], atol=1e-12 * spectrum.max())
        assert np.abs(v @ u - u * e).max() < 1e-12 * spectrum.max() and np.allclose(u.T @ u, np.eye(len(e)), atol=1e-13)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    a = np.diag(np.r_[np.linspace(-3, -1, 20), np.linspace(1, 4, 20)])
    b = rng.normal(size=(40, 3))
    assert np.allclose(a @ minres(lambda x: a @ x, b, 60, 1e-12), b, atol=1e-9)


TEXTS = [
    "", None, "One two\nthree\t four\r\n  five", "don't WE'LL it's 'tis 're", "naïve ÉCOLE Straße ÿ Œuvre İstanbul ΣΑΣ ς", "e\u0301 a\u030a\u0327 \u1e9b\u0323", "price: $1,234.50!!! 100% <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "\u00a0nbsp\u2003em\x0bvt\x0cff\x1cfs\x85nel\u2028ls", "数学 العربية हिन्दी 😀👍🏽", "x" * 5000, "²³¹¼ ª º µ × ÷ ¡¿ «»", "a.b@c.de http://x.y/z?q=1&r=%20 C:\\dir __init__", "\x00\x01 a\x7fb", "ab " * 6000, "Ȧ ǅ ﬁ ㎏ Å",
]


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_of_awkward_texts(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    rng = random.Random(4)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(2, "again", "s"), (2, "again", "s"), (None, "no id", "s"), (None, None, "s")]
    rows += [(100 + i, " ".join(rng.choice(["river", "stone", "Überall", "x1y2"]) for _ in range(rng.randint(1, 300))), "s") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)
    got = packing.pack_documents(frame, path, room=128, with_ids=True, block=32).collect()
    of = {}
    for r in got:
        of.setdefault((r.doc_id, zlib.crc32(np.array(r.ids, np.uint32).tobytes()) if r.piece == 0 else None), []).append(r)
        assert r.length == len(r.ids) <= 128 and r.ids_crc32 == zlib.crc32(np.array(r.ids, np.uint32).tobytes()) and r.start == 128 * r.piece
    want = sorted((-1 if i is None else i, k, tuple(ids[a : a + 128])) for i, t, _ in rows for ids in [ids_of(library, t)] for k, a in enumerate(range(0, len(ids), 128)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, tuple(r.ids)) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1] and sum(n for _, n in b) <= 128
    assert len(bins) <= -(-sum(len(ids) for *_, ids in want) // 128) + 3  # blocks of 32 pieces
    assert packing.pack_documents(frame.limit(0), path).count() == 0
    small = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.length, r.offset) for r in packing.pack_documents(small, path).collect()] == [(5, 3, 0)]


def test_words_of_every_plain_letter_equal_the_library():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    own = packing.Encoder(path)
    letters = [chr(c) for c in range(0x21, 0x180) if packing.PLAIN(chr(c))]
    rng = random.Random(1)
    said = [w for c in letters for w in (c, f"ab{c}cd", f"{c}{c}", f"A{c}'s9{c}")] + ["".join(rng.choices(letters, k=9)) for _ in range(3000)]
    for w in said:
        assert own.words[w] == np.array(own.library.encode(w, add_special_tokens=False).ids, np.uint32).tobytes(), w


def fewest(lengths, room):
    """By trying everything."""
    best, left = len(lengths), []

    def go(k):
        nonlocal best
        if len(left) >= best:
            return
        if k == len(lengths):
            best = len(left)
            return
        for b in range(len(left)):
            if left[b] >= lengths[k]:
                left[b] -= lengths[k]
                go(k + 1)
                left[b] += lengths[k]
        left.append(room - lengths[k])
        go(k + 1)
        left.pop()

    go(0)
    return best


def test_evolution_finds_the_fewest_bins():
    rng = random.Random(6)
    for seed in range(25):
        lengths = sorted((rng.randint(1, 60) for _ in range(9)), reverse=True)
        own = packing.evolve(lengths, 64, [], (seed,), size=6, children=40)
        assert len(own[0].left) == fewest(lengths, 64)
        for b in own:
            used = np.bincount(b.where, weights=lengths)
            assert (used <= 64).all() and (64 - used).astype(int).tolist() == b.left and (used > 0).all()


def test_children_keep_every_document_and_better_the_parents():
    rng = np.random.default_rng(2)
    lengths = rng.integers(200, 2000, 400).tolist()
    first = packing.evolve(lengths, 4096, [], (1,), children=0)
    later = packing.evolve(lengths, 4096, [b.where for b in first], (2,), children=60)
    assert later[0].fitness() > first[0].fitness()
    assert all(len(b.where) == 400 and (np.bincount(b.where, weights=lengths) <= 4096).all() for b in later)


def test_many_blocks_and_levels(spark, tmp_path):
    rng = np.random.default_rng(9)
    lengths = np.r_[rng.integers(1, 900, 3000), np.full(1500, 333)]
    frame = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "pos long, length long").repartition(6)
    frame.write.parquet(str(tmp_path / "loose"))
    table = spark.read.parquet(str(tmp_path / "loose"))
    got = packing.packed(table, 1024, block=256).collect()
    assert sorted(r.pos for r in got) == list(range(4500))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, int(lengths[r.pos])))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1] and sum(n for _, n in b) <= 1024
    least = -(-int(lengths.sum()) // 1024)
    plain = packing.evolve(lengths.tolist(), 1024, [], (1,), children=0)  # all in one block
    assert least <= len(bins) <= len(plain[0].left) + 4
    assert sorted((r.pos, r.sequence_id, r.offset) for r in packing.packed(table, 1024, block=256).collect()) == sorted((r.pos, r.sequence_id, r.offset) for r in got)
