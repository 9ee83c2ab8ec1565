"""Operators on groups of any size: ranks over stretches, pages, cut samples, numbered lines, typed configs."""

import hashlib
import random

import pytest

from tallypair.functions import user
from tallypair.operators import ranks, sampling, similarity, stats, summaries
from tallypair.sources import files


def rows_of(n=400, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, 0.5, 1.0, round(rng.random(), 2), rng.random()]), i) for i in range(n)]


def test_bh_against_plain_steps(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, "family string, p double, id long").repartition(5)
    got = {r.id: (r.family, r.p, r.p_adjusted) for r in stats.bh_adjust(frame, ["family"], parts=7).collect()}
    assert len(got) == len(rows)
    for family in {r[0] for r in rows}:
        own = sorted((p, i) for f, p, i in rows if f == family and p is not None)
        least = 1.0
        want = {}
        for k in range(len(own), 0, -1):
            least = min(least, own[k - 1][0] * len(own) / k)
            want[own[k - 1][1]] = least
        for f, p, i in rows:
            if f == family:
                assert got[i][:2] == (f, p) and (got[i][2] is None if p is None else abs(got[i][2] - want[i]) < 1e-15)
    assert stats.bh_adjust(frame.limit(0), ["family"]).count() == 0
    one = spark.createDataFrame([("f", 0.3)] * 50, "family string, p double")
    assert {r.p_adjusted for r in stats.bh_adjust(one, ["family"], parts=3).collect()} == {0.3}


def test_no_stretch_holds_a_hot_group(spark):
    frame = spark.createDataFrame([("hot", 1.0)] * 3000, "g string, v double").repartition(4)
    table = ranks.stretches(frame, ["g"], ["v"], 6)
    assert max(r["count"] for r in table.groupBy("_part").count().collect()) < 1500
    got = ranks.ranked(frame, ["g"], ["v"], 6).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001)) and {r.total for r in got} == {3000}


def test_pages_of_clusters_and_texts(spark):
    labels = spark.createDataFrame([("g", 1, 0, i) for i in range(47)] + [(None, 1, 0, 5), (None, 1, 0, 5)], "grp string, level int, cluster_id long, item long").repartition(5)
    got = {(r.grp, r.page): (r.cluster_size, r.members) for r in summaries.cluster_members(labels, ["grp"], "item", 10).collect()}
    assert got == {("g", k): (47, list(range(10 * k, min(10 * k + 10, 47)))) for k in range(5)} | {(None, 0): (2, [5, 5])}
    said = spark.createDataFrame([("c", f"b{i:02}", f"d{i}") for i in range(25)] + [("e", "x", None)], "category string, base string, differences string")
    texts = {(r.category, r.page): (r.n, r.differences) for r in summaries.differences_by_category(said, page=10).collect()}
    assert "\n".join(texts["c", k][1] for k in range(3)) == "\n".join(f"- d{i}" for i in range(25)) and texts["c", 2][0] == 5 and texts["e", 0][0] == 1


def test_summaries_of_clusters_larger_than_a_page(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def run(batch):
            seen.add(max(map(len, batch["texts"]), default=0) > 4)
            return batch.drop(columns="texts").assign(summary=["(" + " ".join(t) + ")" for t in batch["texts"]])

        return run

    rows = spark.createDataFrame([("big", f"{i:02}") for i in range(18)] + [("small", "b"), ("small", "a"), ("one", "z")], "k string, source string").repartition(4)
    got = {r.k: r.summary for r in user.summarize_clusters(rows, load, ["k"], page=4).collect()}
    assert got["small"] == "(a b)" and got["one"] == "(z)" and seen.value == 0
    assert got["big"].replace("(", "").replace(")", "").split() == [f"{i:02}" for i in range(18)] and got["big"].startswith("(((00 01 02 03) (04")


def test_cut_samples_against_sorting(spark):
    rows = [(["hot", "b", None][i % 7 % 3], i) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, id long").repartition(4)
    at = lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i)
    for n in (0, 1, 10, 5000):
        got = sorted((r.g or "", r.id) for r in sampling.sample_n_per_group(frame, n, ["g"], "id").collect())
        assert got == sorted((g or "", i) for g in {r[0] for r in rows} for i in sorted((i for h, i in rows if h == g), key=at)[:n])
    with pytest.raises(Exception, match="too few rows"):
        sampling.sample_n_per_group(frame, 5000, ["g"], "id", strict=True).collect()


def test_samples_compute_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    pairs = spark.range(500).selectExpr("id AS base1", "id + 1 AS base2", "CAST(id % 3 AS STRING) AS status1", "CAST(id % 2 AS STRING) AS status2").mapInPandas(count, "base1 long, base2 long, status1 string, status2 string")
    assert sampling.balanced_sample(pairs, 60).count() == 60 and made.value == 500


def test_line_numbers_over_many_splits(spark, tmp_path):
    names = ["b.txt", "a.txt", "c.txt"]
    for k, name in enumerate(names):
        (tmp_path / name).write_text("".join(f"{k} {i} {i * 2}.5 0{i} {i + 1}\n" + "\n" * (i % 50 == 0) for i in range(700)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = sorted((r.id, r.bedrooms, r.bathrooms, r.zipcode, r.price) for r in files.read_housing(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 10
    assert got == [(1 + f * 700 + i, float(k), float(i), f"0{i}", i + 1.0) for f, k in enumerate((1, 0, 2)) for i in range(700)]


def test_configs_with_typed_values_and_broken_files(spark, tmp_path):
    texts = {
        "a": "when: 2024-05-06\nat: 2024-05-06 07:08:09\nset: !!set {b, a}\n2: two\ntrue: yes\nlist: [1, {3: 2024-01-01}, null]\nempty: {}\ntext: '1'\n", "b": "a: [1", "c": "- 1\n- 2\n", "d": "# nothing\n", "e": "x: !!python/object:os.system {}\n", "f": '{"k": {"d": null}}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    got = {r.path[-6]: (r.props, r.error) for r in files.flatten_configs(spark, str(tmp_path)).collect()}
    assert got["a"][0] == {"when": "2024-05-06", "at": "2024-05-06T07:08:09", "set": '["a", "b"]', "2": "two", "true": "true", "list": '[1, {"3": "2024-01-01"}, null]', "empty": "{}", "text": "1"}
    assert all(got[k][0] is None and got[k][1] for k in "bce") and got["d"] == ({}, None) and got["f"] == ({"k.d": None}, None)


def test_image_paths_by_their_rules(spark):
    paths = {
        "vp/data/abod_enhanced/LAMP_b07_x9.png": ("products", "LAMP", "x9", None, "x9", None, None), "vp/data/shhq_enhanced/m_1.jpg": ("people", "m", "1", None, "1", None, None),
        "vp/data/own/room_2.a.jpeg": ("own", "room", "2.a", None, "2.a", None, None), "vp/cache/houses/h_1_original_vs_22_final_iter10_debiased_2.jpg": ("houses", "h", "22", "1", "22_final", "1_original", 10),
        "vp/cache/houses/h_1_zero-shot_vs_22_final_iter0_debiased_1.png": ("houses", "h", "1", "22", "1_zero-shot", "22_final", 0), "vp/cache/houses/h_1_original_vs_22_final_iter1_debiased_3.jpg": (None,) * 7, "vp/cache/x": (None,) * 7, "": (None,) * 7, None: (None,) * 7,
    }
    frame = spark.createDataFrame([(p,) for p in paths], "image_path string")
    for r in similarity.parse_image_path(frame).collect():
        assert (r.dataset, r.image_class, r.current_base_id, r.other_base_id, r.current_id, r.other_id, r.debiased_iter) == paths[r.image_path], r


def test_columns_of_one_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y", 2)], "id int, v string, w int")
    assert [tuple(r) for r in similarity.first_of_each_name(a.join(b, a["id"] == b["id"])).collect()] == [(1, "x", 2)]


def test_pairs_take_the_two_smallest_paths(spark):
    rows = [("k", 1, f"p{i}", [float(i), 1.0]) for i in (3, 1, 2)] + [("one", 1, "p", [1.0]), ("same", 2, "p", [1.0]), ("same", 2, "p", [1.0])]
    got = {r.pair_key: (r.path_a, r.path_b, round(r.similarity, 6)) for r in similarity.between_pairs(spark.createDataFrame(rows, "pair_key string, debiased_iter int, image_path string, embedding array<double>")).collect()}
    assert got == {"k": ("p1", "p2", round(3 / 10**0.5, 6)), "same": ("p", "p", 1.0)}


def test_clustered_errors_of_nulls_and_of_nothing(spark):
    """Against scores written out; a null cell belongs to no margin, its rows and clusters still count."""
    rng = random.Random(5)
    rows = [(i // 3, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([0, 1])) for i in range(150)]
    frame = spark.createDataFrame(rows, "pair_id long, model string, type string, chosen int").repartition(3)
    got = {r.type: (r.emm, r.se) for r in stats.clustered_se(frame, ["model", "type"], ["type"]).collect()}
    cells = {}
    for _, m, t, c in rows:
        cells.setdefault((m, t), []).append(c)
    mean = {k: sum(v) / len(v) for k, v in cells.items()}
    for t in "xy":
        own = [k for k in cells if k[1] == t]
        u = {}
        for p, m, s, c in rows:
            if s == t and m is not None:
                u[p] = u.get(p, 0) + (c - mean[m, s]) / len(cells[m, s]) / len(own)
        factor = 149 / (150 - len(cells)) * 50 / 49
        assert abs(got[t][0] - sum(mean[k] for k in own) / len(own)) < 1e-12 and abs(got[t][1] - (sum(x * x for x in u.values()) * factor) ** 0.5) < 1e-12
    assert stats.clustered_se(frame.limit(0), ["model", "type"], ["type"]).count() == 0
    assert stats.contrasts(frame.limit(0), ["model", "type"], "type", ["model"], ["x", "y"]).count() == 0
