import hashlib
import struct

import numpy as np
import pytest

from tallypair.functions import labels, user
from tallypair.operators import assembly, helpers, models, pictures, stats, summaries, trees
from tallypair.sources import files


def test_t_distribution():
    p = models.two_sided_p(np.array([2.228139, 12.7062, 0.0, 2.0, 1.959964]), np.array([10, 1, 5, 2, 1e6]))
    assert np.allclose(p, [0.05, 0.05, 1.0, 0.18350342, 0.05], atol=1e-6)
    assert np.allclose(models.t_quantile(np.array([1.0, 10, 100])), [12.7062047, 2.2281389, 1.9839715], atol=1e-5)


def test_intervals_of_bad_rows_are_null(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.5, 10), (2, 1.0, 0.0, 10), (3, None, 0.5, 10), (4, 1.0, 0.5, None)], "k int, estimate double, se double, df int")
    got = {r.k: r for r in models.t_interval_p(rows).collect()}
    assert abs(got[1].p - 0.0733880) < 1e-6 and got[2].p is None and got[3].p is None and got[4].p is None and got[4].low is None


def test_fixed_effects_equal_a_dense_fit(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i // 2), "ab"[rng.integers(2)], "xyz"[rng.integers(3)], "mn"[rng.integers(2)], int(rng.integers(2))) for i in range(400)]
    got = {(r.strategy, r.model): (r.emm, r.se) for r in helpers.fixed_effect_fit(spark.createDataFrame(rows, "pair_id long, strategy string, model string, task string, chosen int"), ["strategy", "model"], "task").collect()}
    combos = sorted({(r[1], r[2]) for r in rows})
    x = np.array([[float((r[1], r[2]) == c) for c in combos] + [float(r[3] == "n")] for r in rows])
    y = np.array([r[4] for r in rows], float)
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    s = np.array([x[np.array([r[0] == g for r in rows])].T @ e[np.array([r[0] == g for r in rows])] for g in range(200)])
    v = bread @ s.T @ s @ bread * 399 / (400 - x.shape[1]) * 200 / 199
    for i, c in enumerate(combos):
        m = np.zeros(len(beta))
        m[i], m[-1] = 1, 0.5
        assert np.allclose(got[c], (m @ beta, np.sqrt(m @ v @ m)))


def test_structural_similarity(spark):
    a = np.random.default_rng(1).uniform(0, 255, (2, 8, 8))
    assert np.allclose(helpers.ssim_of(a, a), 1) and (helpers.ssim_of(a, a[::-1]) < 1).all()
    x, y = a[0][:7, :7], a[1][:7, :7]
    c1, c2 = 2.55**2, 7.65**2
    cov = np.cov(x.ravel(), y.ravel())
    one = (2 * x.mean() * y.mean() + c1) * (2 * cov[0, 1] + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2))
    assert np.isclose(helpers.ssim_of(x[None], y[None])[0], one)
    flat = spark.createDataFrame([([1.0] * 64, [1.0] * 64), (None, [1.0] * 64), ([1.0] * 3, [1.0] * 64)], "a array<double>, b array<double>")
    assert [r[0] for r in flat.select(helpers.ssim("a", "b")).collect()] == [1.0, None, None]


@pytest.mark.parametrize("linkage", ["ward", "average", "complete", "single"])
def test_trees_equal_plain_merging(linkage):
    points = np.random.default_rng(5).normal(size=(23, 4))
    groups = [[i] for i in range(23)]

    def apart(a, b):
        d = np.linalg.norm(points[a][:, None] - points[b][None], axis=-1)
        if linkage == "ward":
            return np.sum((points[a].mean(0) - points[b].mean(0)) ** 2) * len(a) * len(b) / (len(a) + len(b))
        return {"average": d.mean, "complete": d.max, "single": d.min}[linkage]()

    tree = helpers.merges(points, linkage)
    while len(groups) > 1:
        label = helpers.cut(23, tree, len(groups))
        assert sorted(sorted(g) for g in groups) == sorted(np.flatnonzero(label == k).tolist() for k in range(len(groups)))
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: apart(groups[p[0]], groups[p[1]]))
        groups[i] = groups[i] + groups.pop(j) if j > i else groups[i] + groups[j]
        if j < i:
            groups.pop(j)


def test_levels_of_one_and_of_large_groups(spark):
    rows = [("a", 1, [0.0, 1.0]), ("a", 2, None)] + [("b", i, [float(i), 0.0]) for i in range(30)]
    got = trees.hierarchical_levels(spark.createDataFrame(rows, "grp string, item long, embedding array<double>"), ["grp"], "item").collect()
    assert [(r.item, r.level, r.cluster_id) for r in got if r.grp == "a"] == [(1, 1, 0)]
    assert {r.item for r in got if r.grp == "b"} == set(range(30))
    assert [len({r.cluster_id for r in got if r.grp == "b" and r.level == k}) for k in (1, 2, 3, 4, 5)] == [15, 8, 4, 2, 1]
    with pytest.raises(Exception, match="a tree takes 10 at most"):
        trees.hierarchical_levels(spark.createDataFrame(rows, "grp string, item long, embedding array<double>"), ["grp"], "item", "average", most=10).collect()


@pytest.mark.parametrize("linkage", ["ward", "single"])
def test_large_groups_get_the_same_levels(spark, linkage):
    rng = np.random.default_rng(8)
    rows = [(g, int(i), rng.normal(size=3).tolist()) for g, n in (("a", 150), (None, 61), ("c", 9), ("d", 1)) for i in rng.permutation(n)]
    frame = spark.createDataFrame(rows, "grp string, item long, embedding array<double>").repartition(3)
    plain = {(r.grp, r.item, r.level): r.cluster_id for r in trees.hierarchical_levels(frame, ["grp"], "item", linkage).collect()}
    large = {(r.grp, r.item, r.level): r.cluster_id for r in trees.hierarchical_levels(frame, ["grp"], "item", linkage, most=10, block=16).collect()}
    assert plain == large and len(plain) > 800


def test_wards_merges_without_distances():
    points = np.random.default_rng(2).normal(size=(200, 5))
    one, two = helpers.merges(points), trees.ward_merges(points)
    assert np.allclose([m[0] for m in one], [m[0] for m in two])
    for k in (100, 50, 7, 2):
        assert (helpers.cut(200, one, k) == helpers.cut(200, two, k)).all()


def test_configs_and_quoted_results_come_back(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "config.yaml").write_text('{"task": {"name": "hotels"}, "evaluate": {"strategy_name": null, "ids": [1]}}')
    (tmp_path / "m" / "results_pairs.csv").write_text('image_class,base1,base2,choice,reason,completion_tokens,prompt_tokens,total_tokens,reasoning_tokens\nC,1_final,2_final,1_final,"a ""b"",\nc",1,2,3,\n')
    configs = files.flatten_configs(spark, str(tmp_path))
    assert configs.first().props == {"task.name": "hotels", "evaluate.strategy_name": None, "evaluate.ids": "[1]"}
    (row,) = files.combine_pairs(spark, str(tmp_path), configs).collect()
    assert (row.model, row.task_name, row.reason, row.reasoning_tokens) == ("m", "hotels", 'a "b",\nc', None)


def test_nearest_config_is_the_deepest_within_five(spark):
    paths = spark.createDataFrame([("a/b/c/x.csv",), ("a/1/2/3/4/5/x.csv",), ("z/x.csv",)], "path string")
    configs = spark.createDataFrame([("a", "far"), ("a/b", "near")], "dir string, config string")
    assert {r.path: r.config for r in assembly.nearest_config(paths, configs).collect()} == {"a/b/c/x.csv": "near"}


def test_failed_judgements_skip_the_pair(spark):
    def load():
        return lambda b: b.assign(choice=[None if "bad" in x else "first" for x in b["first"]], reason="r", completion_tokens=1, prompt_tokens=1, total_tokens=2, reasoning_tokens=0)

    pairs = spark.createDataFrame([(1, "x", "y"), (2, "bad", "y")], "id int, shown_a string, shown_b string")
    assert [(r.id, r.choice) for r in user.judge_pairs(pairs, load, ["id"]).collect()] == [(1, "inconsistent")]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "task string, strategy string, type string, chosen int, pair_id long, participant_id long")
    assert stats.cell_means(none, ["task"]).count() == 0
    assert models.twoway_clustered_se(none, ["task", "type"], ["type"], "participant_id", "pair_id").count() == 0
    assert helpers.fixed_effect_fit(none, ["strategy"], "task").count() == 0
    names = spark.createDataFrame([(None,), ("",)], "file_name string")
    assert labels.parse_debias_name(names).count() == 0 and labels.parse_final_name(names).count() == 0
    assert summaries.set_task_counts(spark.createDataFrame([], "task string, set_number long"), ["hotels"]).count() == 0


def test_kmeans_against_plain_rounds(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], (rng.normal(size=3) + 4 * (i % 6)).tolist()) for i in range(120)] + [(120, "a", None)]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>")
    got = {r.id: r.label for r in assembly.kmeans_labels(df, 5, "id", "grp", "v", str(tmp_path / "one"), rounds=4).collect()}
    for grp in "ab":
        own = {i: np.array(v) for i, g, v in rows if g == grp and v}
        first = sorted(own, key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))[:5]
        at = {n: own[i] for n, i in enumerate(first)}
        near = lambda v: min(at, key=lambda n: (((v - at[n]) ** 2).sum(), n))  # noqa: B023, E731
        for _ in range(4):
            labels = {i: near(v) for i, v in own.items()}
            at = {n: np.mean([own[i] for i in own if labels[i] == n], axis=0) for n in set(labels.values())}
        assert {i: got[i] for i in own} == {i: near(v) for i, v in own.items()}
    drawn = assembly.density_subsample(df, 5, "id", "grp", "v", str(tmp_path / "two"))
    assert drawn.columns == df.columns and all(0 < r["count"] <= 5 for r in drawn.groupBy("grp").count().collect())


def test_minibatches_against_plain_steps(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, "abc"[min(i % 5, 2)], (rng.normal(size=3) + 4 * (i % 6)).tolist()) for i in range(200)] + [(200, "a", None)]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>").repartition(3)
    got = {r.id: r.label for r in assembly.minibatch_labels(df, 4, "id", "grp", "v", str(tmp_path / "one"), batch=25, steps=6).collect()}
    assert len(got) == 200
    said = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    for grp in "abc":
        own = {i: np.array(v) for i, g, v in rows if g == grp and v}
        at = [own[i] for i in sorted(own, key=lambda i: (said(i), i))[:4]]
        seen, slots = [0] * 4, -(-len(own) // 25)
        near = lambda v: min(range(4), key=lambda n: (((v - at[n]) ** 2).sum(), n))  # noqa: B023, E731
        for step in range(6):
            taken = [v for i, v in own.items() if int(int(said(i)[:12], 16) / 16**12 * slots) == step % slots]
            labels = [near(v) for v in taken]
            for n in set(labels):
                mine = [v for v, x in zip(taken, labels, strict=True) if x == n]
                seen[n] += len(mine)
                at[n] = at[n] + (np.sum(mine, axis=0) - len(mine) * at[n]) / seen[n]
        assert {i: got[i] for i in own} == {i: near(v) for i, v in own.items()}


def test_fixed_effects_of_many_cells(spark):
    """6000 cells, some clusters in many of them, others in one."""
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(40)) if i % 3 else 1000 + i, int(i % 100), int(i // 100 % 60), int(rng.integers(2))) for i in range(12000)]
    got = helpers.fixed_effect_fit(spark.createDataFrame(rows, "pair_id long, strategy long, task long, chosen int"), ["strategy"], "task").orderBy("strategy").collect()
    x = np.zeros((12000, 159))
    x[np.arange(12000), [r[1] for r in rows]] = 1
    for k, r in enumerate(rows):
        if r[2]:
            x[k, 99 + r[2]] = 1
    y = np.array([r[3] for r in rows], float)
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    cluster = np.unique([r[0] for r in rows], return_inverse=True)[1]
    s = np.zeros((cluster.max() + 1, 159))
    np.add.at(s, cluster, x * (y - x @ beta)[:, None])
    g = len(s)
    v = bread @ s.T @ s @ bread * 11999 / (12000 - 159) * g / (g - 1)
    m = np.hstack([np.eye(100), np.full((100, 59), 1 / 60)])
    assert np.allclose([r.emm for r in got], m @ beta) and np.allclose([r.se for r in got], np.sqrt(np.diag(m @ v @ m.T)))


def _bitmap(path, pixels):
    """A picture file of 24 bits a pixel, written plainly."""
    height, width, _ = pixels.shape
    rows = b"".join(row.tobytes() + b"\0" * (-3 * width % 4) for row in pixels[::-1])
    path.write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows)


def test_bicubic_resizing_against_single_sums():
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (11, 9, 2), dtype=np.uint8)
    kernel = lambda x: 1.5 * abs(x) ** 3 - 2.5 * x * x + 1 if abs(x) < 1 else -0.5 * abs(x) ** 3 + 2.5 * x * x - 4 * abs(x) + 2 if abs(x) < 2 else 0.0

    def line(values, new):
        """One row of pixels, each new pixel a sum of its own."""
        scale = len(values) / new
        out = []
        for i in range(new):
            weights = [kernel(((j + 0.5) - (i + 0.5) * scale) / max(scale, 1)) for j in range(len(values))]
            out.append(min(max(int(np.floor(sum(w * v for w, v in zip(weights, values, strict=True)) / sum(weights) + 0.5)), 0), 255))
        return out

    for height, width in ((11, 9), (22, 18), (5, 4), (7, 30), (1, 1)):
        want = np.array([[line(image[r, :, c], width) for c in range(2)] for r in range(11)], int).transpose(0, 2, 1)
        want = np.array([[line(want[:, x, c], height) for c in range(2)] for x in range(width)], int).transpose(2, 0, 1)
        got = pictures.resized(image, height, width)
        assert got.shape == (height, width, 2) and np.abs(got.astype(int) - want).max() <= 1 and (got == want).mean() > 0.97
    assert (pictures.resized(np.full((5, 5, 3), 77, np.uint8), 12, 3) == 77).all()


def test_similarity_of_picture_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    one, two = (rng.integers(0, 256, (20, 24, 3), dtype=np.uint8) for _ in range(2))
    for name, pixels in (("a", one), ("b", two), ("c", one), ("d", np.repeat(np.repeat(one, 2, 0), 2, 1))):
        _bitmap(tmp_path / f"{name}.bmp", pixels)
    (tmp_path / "e.bmp").write_bytes(b"no picture")
    of = lambda n: f"file://{tmp_path}/{n}.bmp"
    pairs = spark.createDataFrame([(of("a"), of(x)) for x in "bcdef"], "path_a string, path_b string")
    plain = {r.path_b[-5]: r.similarity for r in pictures.image_pair_scores(pairs, str(tmp_path), side=None).collect()}
    assert set(plain) == {"b", "c", "d"} and plain["c"] == 1
    assert abs(plain["b"] - helpers.ssim_of(one.transpose(2, 0, 1).astype(float), two.transpose(2, 0, 1).astype(float)).mean()) < 1e-12
    assert 0.9 < plain["d"] < 1  # each pixel doubled: the kernel takes some of its neighbours
    fixed = {r.path_b[-5]: r.similarity for r in pictures.image_pair_scores(pairs, str(tmp_path)).collect()}
    assert fixed["c"] == 1 and fixed["b"] < 0.5 < fixed["d"] <= 1
