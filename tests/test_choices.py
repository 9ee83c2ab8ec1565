from tallypair.functions import parse
from tallypair.operators import sampling, stats, verdicts


def test_item_names(spark):
    names = [("A_1_final.jpg",), ("x_A_2_zero-shot.jpg",), ("A_final.jpg",), ("A_1_other.jpg",)]
    got = parse.parse_item_name(spark.createDataFrame(names, "file_name string")).collect()
    assert sorted((r.category, r.image_id, r.status) for r in got) == [("A", "1", "final"), ("A", "2", "zero-shot")]


def judgements(spark, rows):
    rows = [(c, j, f, x, f"r{j}{'a' if f else 'b'}", 1, 2, 3, None) for c, j, f, x in rows]
    return spark.createDataFrame(rows, "contest_id long, judge_id int, is_a_first boolean, choice string, reason string, completion_tokens int, prompt_tokens int, total_tokens int, reasoning_tokens int")


def test_orders_collapse_and_panel(spark):
    rows = [(1, 0, True, "first"), (1, 0, False, "second"), (1, 1, True, "first"), (1, 1, False, "first"), (2, 0, True, "first"), (2, 0, False, "first")]
    got = {(r.contest_id, r.judge_id): (r.choice, r.reason, r.reasoning_tokens) for r in verdicts.collapse_orders(judgements(spark, rows), ["contest_id", "judge_id"]).collect()}
    assert got == {(1, 0): ("A", "r0a", 0), (1, 1): ("inconsistent", "Judge 1: r1a Judge 2: r1b", 0), (2, 0): ("inconsistent", "Judge 1: r0a Judge 2: r0b", 0)}
    panel = {r.contest_id: (r.winner, r.score, r.consistent) for r in verdicts.judge_panel(judgements(spark, rows)).collect()}
    assert panel == {1: ("A", 1.0, 1), 2: ("A", 0.5, 0)}


def test_quota_of_nothing(spark):
    pairs = spark.createDataFrame([("a", "b", "original", "final"), ("a", "c", "original", "original")], "base1 string, base2 string, status1 string, status2 string")
    assert sampling.balanced_sample(pairs, 1).count() == 0
    assert sampling.balanced_sample(pairs, 2).count() == 2


def test_adjusted_p_is_monotone_and_leaves_nulls(spark):
    rows = [("g", 1, 0.01), ("g", 2, 0.02), ("g", 3, 0.9), ("g", 4, None)]
    got = {r.k: r.p_adjusted for r in stats.bh_adjust(spark.createDataFrame(rows, "g string, k int, p double"), ["g"], "p", "k").collect()}
    assert got[4] is None and abs(got[1] - 0.03) < 1e-12 and abs(got[2] - 0.03) < 1e-12 and abs(got[3] - 0.9) < 1e-12


def test_incomplete_grid_has_no_mean(spark):
    cells = spark.createDataFrame([("x", "p", 0.5), ("x", "q", 1.0), ("y", "p", 0.0)], "type string, task string, cell_mean double")
    assert {r.type: r.emm for r in stats.marginal_means(cells, ["type"], grid=2).collect()} == {"x": 0.75, "y": None}
