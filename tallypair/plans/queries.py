"""The paired-choice operators as registered queries over the given tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypair.fixtures import fixture, sql
from tallypair.functions import parse
from tallypair.operators import pairing, sampling, similarity, stats, verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CELLS = ["model", "task", "strategy", "type"]
LEVELS = ["original", "zero-shot", "final"]


def add(name: str, make: Callable[[Callable[[str], DataFrame]], DataFrame], twin: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(lambda f: fixture(spark, sf_dir, f))
    ORACLES[name] = twin


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- names and choices -------------------------------------------------------------------------
BASE_SQL = "nullif(regexp_extract({0}, '^(.*)_(original|zero-shot|final|distillation)$', {1}), '')"
CLEAN = (
    "(SELECT pair_id, model, task, strategy, iterations, image_class, base1, base2, CASE WHEN choice = base1 THEN base1 WHEN choice = base2 THEN base2 END AS chosen_base, "
    + ", ".join(f"{BASE_SQL.format(f'base{n}', i)} AS {c}{n}" for n in (1, 2) for i, c in ((1, "item"), (2, "type")))
    + f" FROM {sql('verdicts')})"
)
LONG = f"""(SELECT pair_id, model, task, strategy, iterations, image_class, item1 AS item_id, type1 AS type, CAST(chosen_base = base1 AS INTEGER) AS chosen FROM {CLEAN}
  UNION ALL SELECT pair_id, model, task, strategy, iterations, image_class, item2, type2, CAST(chosen_base = base2 AS INTEGER) FROM {CLEAN})"""
KEPT = f"(SELECT * FROM {LONG} WHERE chosen IS NOT NULL)"


def long(get: Callable[[str], DataFrame]) -> DataFrame:
    return parse.choices_long(parse.clean_choices(get("verdicts")))


def kept(get: Callable[[str], DataFrame]) -> DataFrame:
    return parse.prep_choices(long(get))


add("p1_parse_item_name", lambda g: parse.parse_item_name(g("items").select("file_name")), f"""
SELECT * FROM (SELECT file_name, regexp_extract(file_name, '(?:^|_)([^_]+)_([^_]+)_(original|zero-shot|final)\\.jpg$', 1) AS category,
  regexp_extract(file_name, '(?:^|_)([^_]+)_([^_]+)_(original|zero-shot|final)\\.jpg$', 2) AS image_id,
  regexp_extract(file_name, '(?:^|_)([^_]+)_([^_]+)_(original|zero-shot|final)\\.jpg$', 3) AS status FROM {sql('items')}) WHERE status <> ''""")
add("p8_clean_choices", lambda g: parse.clean_choices(g("verdicts")), f"SELECT * FROM {CLEAN}")
add("p9_choices_long", long, f"SELECT * FROM {LONG}")
add("p10_prep_choices", kept, f"""SELECT *, CASE type WHEN 'original' THEN 'Original' WHEN 'zero-shot' THEN 'Zero-shot' WHEN 'final' THEN 'Final' WHEN 'distillation' THEN 'Distilled' END AS type_label,
  CAST(CASE type WHEN 'original' THEN 0 WHEN 'zero-shot' THEN 1 WHEN 'final' THEN 2 WHEN 'distillation' THEN 3 END AS INTEGER) AS type_order FROM {KEPT}""")
add("p12_orient_pairs", lambda g: parse.orient_pairs(g("verdicts").select("pair_id", "base1", "base2"), 42, "pair_id"), f"""
SELECT pair_id, base1, base2, CASE WHEN swap THEN base2 ELSE base1 END AS "left", CASE WHEN swap THEN base1 ELSE base2 END AS "right"
FROM (SELECT *, CAST('0x' || substr(md5('42|' || CAST(pair_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 AS swap FROM {sql('verdicts')})""")

# --- pairs ---------------------------------------------------------------------------------------
J1 = """SELECT a.image_class, a.base AS base1, b.base AS base2, a.status AS status1, b.status AS status2
FROM (SELECT DISTINCT image_class, image_id, status, base FROM {0}) a JOIN (SELECT DISTINCT image_class, image_id, status, base FROM {0}) b
ON a.image_class = b.image_class AND a.base < b.base AND a.image_id <> b.image_id""".format(sql("items"))
add("j1_pairs_within_class", lambda g: pairing.pairs_within_class(g("items")), J1)
add("j2_pairs_cross_status", lambda g: pairing.pairs_within_class(g("items"), cross_status=True), J1 + " AND a.status <> b.status")
add("j3_pairs_cross_strategy", lambda g: pairing.pairs_cross_strategy(g("items")), """
SELECT a.task, a.image_class, a.strategy AS strategy1, a.image_id AS image_id1, b.strategy AS strategy2, b.image_id AS image_id2
FROM {0} a JOIN {0} b ON a.task = b.task AND a.image_class = b.image_class AND a.strategy < b.strategy AND a.image_id <> b.image_id
WHERE a.status = 'final' AND b.status = 'final'""".format(sql("items")))
add("j4_participant_pairs", lambda g: pairing.participant_pairs(g("versions")), f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY category, base_id ORDER BY md5('42|' || category || '|' || base_id || '|' || status), status) AS n FROM {sql('versions')})
SELECT a.category, a.base_id AS id1, a.status AS status1, b.base_id AS id2, b.status AS status2 FROM v a JOIN v b
ON a.category = b.category AND a.base_id < b.base_id AND a.status <> b.status WHERE a.n = 1 AND b.n = 1""")
DRAWN = "CAST(FLOOR(CAST(image_id AS BIGINT) / 9) AS BIGINT)"
add("j4_participant_pairs_strategies", lambda g: pairing.participant_pairs(g("items").selectExpr(f"concat('c', CAST({DRAWN} % 20 AS STRING)) AS category", f"CAST({DRAWN} AS STRING) AS base_id", "strategy"), by="strategy"), f"""
WITH i AS (SELECT DISTINCT concat('c', CAST({DRAWN} % 20 AS VARCHAR)) AS category, CAST({DRAWN} AS VARCHAR) AS base_id, strategy FROM {sql('items')}),
v AS (SELECT *, row_number() OVER (PARTITION BY category, base_id ORDER BY md5('42|' || category || '|' || base_id || '|' || strategy), strategy) AS n FROM i)
SELECT a.category, a.base_id AS id1, a.strategy AS strategy1, b.base_id AS id2, b.strategy AS strategy2 FROM v a JOIN v b
ON a.category = b.category AND a.base_id < b.base_id AND a.strategy <> b.strategy WHERE a.n = 1 AND b.n = 1""")
add("j5_match_original_final", lambda g: pairing.match_original_final(g("versions")), f"""
SELECT * FROM (SELECT category, base_id, max(CASE WHEN status = 'original' THEN path END) AS original_path, max(CASE WHEN status = 'final' THEN path END) AS final_path
FROM {sql('versions')} GROUP BY ALL) WHERE original_path IS NOT NULL AND final_path IS NOT NULL""")
add("j9_pending", lambda g: pairing.pending(g("verdicts").select("image_class", "base1", "base2"), g("verdicts").where("choice <> 'inconsistent'"), ["image_class", "base1", "base2"]), """
SELECT image_class, base1, base2 FROM {0} v WHERE NOT EXISTS (SELECT 1 FROM {0} d WHERE d.choice <> 'inconsistent' AND d.image_class = v.image_class AND d.base1 = v.base1 AND d.base2 = v.base2)""".format(sql("verdicts")))

# --- samples -------------------------------------------------------------------------------------
K1 = f"""
WITH p AS ({J1}), t AS (SELECT *, least(status1, status2) AS t1, greatest(status1, status2) AS t2 FROM p), c AS (SELECT count(*) AS total, count(DISTINCT t1 || t2) AS g FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY t1, t2 ORDER BY md5('42|' || base1 || '|' || base2), base1, base2) AS n FROM t)
SELECT image_class, base1, base2, status1, status2 FROM r, c WHERE total <= {{0}} OR n <= {{0}} // g"""
add("k1_balanced_sample", lambda g: sampling.balanced_sample(pairing.pairs_within_class(g("items")), 600, counts=pairing.pair_counts_within_class(g("items"))), K1.format(600))
add("k1_balanced_sample_large", lambda g: sampling.balanced_sample(pairing.pairs_within_class(g("items")), 7200, counts=pairing.pair_counts_within_class(g("items"))), K1.format(7200))
add("k1_balanced_sample_strategies", lambda g: sampling.balanced_sample(pairing.pairs_cross_strategy(g("items")), 60, by="strategy", keys=("image_id1", "image_id2"), counts=pairing.pair_counts_cross_strategy(g("items"))), f"""
WITH p AS ({ORACLES['j3_pairs_cross_strategy']}), c AS (SELECT count(*) AS total, count(DISTINCT strategy1 || strategy2) AS g FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy1, strategy2 ORDER BY md5('42|' || image_id1 || '|' || image_id2), image_id1, image_id2) AS n FROM p)
SELECT task, image_class, strategy1, image_id1, strategy2, image_id2 FROM r, c WHERE total <= 60 OR n <= 60 // g""")
add("k3_sample_n_per_group", lambda g: sampling.sample_n_per_group(g("items").select("task", "image_id"), 5, ["task"], "image_id"), f"""
SELECT task, image_id FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('42|' || image_id), image_id) AS n FROM {sql('items')}) WHERE n <= 5""")
add("k3_sample_total", lambda g: sampling.sample_n_per_group(g("items").select("task", "image_id"), 16, ["task"], "image_id", total=True, strict=True), f"""
SELECT task, image_id FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('42|' || image_id), image_id) AS n FROM {sql('items')}) WHERE n <= 16 // (SELECT count(DISTINCT task) FROM {sql('items')})""")
add("k5_band_filter", lambda g: sampling.band_filter(g("housing"), ("price", "area")), """
SELECT h.* FROM {0} h, (SELECT avg(price) AS mp, stddev_samp(price) AS sp, avg(area) AS ma, stddev_samp(area) AS sa FROM {0})
WHERE abs(price - mp) <= sp / 2 AND abs(area - ma) <= sa / 2""".format(sql("housing")))
add("k5_band_filter_limited", lambda g: sampling.band_filter(g("housing"), ("price", "area"), most=12, key="id"), ORACLES["k5_band_filter"] + " ORDER BY md5('42|' || CAST(h.id AS VARCHAR)), h.id LIMIT 12")
add("k7_partition_into_sets", lambda g: sampling.partition_into_sets(g("head2head").select("task", "pair_id"), 160, ["task"], "pair_id"), f"""
SELECT task, pair_id, (row_number() OVER (PARTITION BY task ORDER BY md5('42|' || CAST(pair_id AS VARCHAR)), pair_id) - 1) // 160 AS set_number FROM {sql('head2head')}""")
add("k9_repeat_tasks", lambda g: sampling.repeat_tasks(g("head2head").select("task", "pair_id"), 3), f"SELECT task, pair_id, rep FROM {sql('head2head')}, (VALUES (1), (2), (3)) r(rep)")

# --- verdicts ------------------------------------------------------------------------------------
A1 = f"""
SELECT contest_id, judge_id, CASE WHEN a = b THEN a ELSE 'inconsistent' END AS choice,
  CASE WHEN a = b AND a = 'A' THEN r1 WHEN a = b THEN r2 ELSE 'Judge 1: ' || r1 || ' Judge 2: ' || r2 END AS reason, completion_tokens, prompt_tokens, total_tokens, reasoning_tokens, r1
FROM (SELECT contest_id, judge_id, max(CASE WHEN is_a_first THEN item END) AS a, max(CASE WHEN NOT is_a_first THEN item END) AS b,
  max(CASE WHEN is_a_first THEN reason END) AS r1, max(CASE WHEN NOT is_a_first THEN reason END) AS r2, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(CASE WHEN count(reasoning_tokens) = 2 THEN sum(reasoning_tokens) ELSE 0 END AS BIGINT) AS reasoning_tokens
  FROM (SELECT *, CASE WHEN (choice = 'first') = is_a_first THEN 'A' ELSE 'B' END AS item FROM {sql('judgements')}) GROUP BY contest_id, judge_id)"""
add("a1_collapse_orders", lambda g: verdicts.collapse_orders(g("judgements"), ["contest_id", "judge_id"]), f"SELECT * EXCLUDE (r1) FROM ({A1})")
add("a1_collapse_orders_strategies", lambda g: verdicts.collapse_orders(g("judgements"), ["contest_id", "judge_id"], strategies=True), f"""
SELECT a.* EXCLUDE (r1, reason), CASE WHEN choice <> 'inconsistent' THEN r1 ELSE r1 || ' | ' || replace(r1, 'a', 'b') END AS reason FROM ({A1}) a""")
add("a2_judge_panel", lambda g: rounded(verdicts.judge_panel(g("judgements")), "score"), f"""
WITH e AS ({A1}), v AS (SELECT contest_id, count(*) FILTER (choice = 'A') AS a, count(*) FILTER (choice = 'B') AS b FROM e GROUP BY contest_id),
w AS (SELECT *, CASE WHEN b > a THEN 'B' ELSE 'A' END AS winner FROM v)
SELECT w.contest_id, winner, round(CASE WHEN a + b = 0 THEN 0.5 ELSE CAST(greatest(a, b) AS DOUBLE) / (a + b) END, 6) AS score, a + b AS consistent,
  CASE WHEN a + b = 0 THEN 'No consistent preference detected.' ELSE (SELECT string_agg(r1, chr(10) ORDER BY judge_id) FROM e WHERE e.contest_id = w.contest_id AND e.choice = w.winner) END AS feedback FROM w""")
add("a2_judge_panel_random", lambda g: rounded(verdicts.judge_panel(g("judgements"), "random"), "score"), ORACLES["a2_judge_panel"].replace("CASE WHEN b > a THEN 'B' ELSE 'A' END AS winner", "CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' WHEN CAST('0x' || substr(md5('42|' || CAST(contest_id AS VARCHAR)), 1, 1) AS BIGINT) % 2 = 0 THEN 'A' ELSE 'B' END AS winner"))
add("a4_retry_consensus", lambda g: verdicts.retry_consensus(g("judgements")), f"""
SELECT contest_id, coalesce(arg_min(choice, judge_id) FILTER (choice <> 'inconsistent'), 'current_best') AS winner FROM ({A1}) GROUP BY contest_id""")
add("a5_contest_trajectory", lambda g: verdicts.contest_trajectory(g("rounds")), f"""
WITH r AS (SELECT * FROM {sql('rounds')}), h AS (SELECT pair_key, min(round_number) FILTER (round_number >= 10 AND winner_score < 0.51) AS hit FROM r GROUP BY pair_key),
k AS (SELECT r.*, least(coalesce(hit, 30), 30) AS stop, hit IS NOT NULL AND hit <= 30 AS eq FROM r JOIN h USING (pair_key)),
e AS (SELECT *, CASE WHEN round_number < stop OR NOT eq THEN CASE WHEN winner = 'A' THEN 'B' ELSE 'A' END END AS edited FROM k WHERE round_number <= stop)
SELECT pair_key, arg_min(winner, round_number) AS zero_shot_winner, arg_max(winner, round_number) AS final_winner, count(*) AS rounds, bool_or(eq) AS equilibrium,
  count(*) FILTER (edited = 'A') AS edits_a, count(*) FILTER (edited = 'B') AS edits_b, max(round_number) FILTER (winner = 'A') AS champion_a, max(round_number) FILTER (winner = 'B') AS champion_b FROM e GROUP BY pair_key""")
add("a5_contest_edits", lambda g: verdicts.contest_edits(g("rounds")), f"""
WITH r AS (SELECT * FROM {sql('rounds')}), h AS (SELECT pair_key, min(round_number) FILTER (round_number >= 10 AND winner_score < 0.51) AS hit FROM r GROUP BY pair_key),
k AS (SELECT r.*, coalesce(least(hit, 30), 30) AS stop, coalesce(hit, 31) <= 30 AS eq FROM r JOIN h USING (pair_key))
SELECT k.pair_key, k.round_number, CASE k.winner WHEN 'A' THEN 'B' ELSE 'A' END AS side,
  CASE WHEN n.winner IS NULL THEN NULL WHEN n.winner <> k.winner THEN true WHEN k.eq AND n.round_number = k.stop THEN NULL ELSE false END AS won_next_round
FROM k LEFT JOIN k n ON n.pair_key = k.pair_key AND n.round_number = k.round_number + 1 AND n.round_number <= k.stop WHERE k.round_number <= k.stop AND NOT (k.eq AND k.round_number = k.stop)""")
add("a6_descent_trajectory", lambda g: verdicts.descent_trajectory(g("rounds")), f"""
WITH r AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY pair_key ORDER BY round_number ROWS UNBOUNDED PRECEDING) AS island FROM {sql('rounds')} WHERE round_number <= 30),
i AS (SELECT *, sum(CAST(NOT failed AND NOT improved AS INTEGER)) OVER (PARTITION BY pair_key, island ORDER BY round_number ROWS UNBOUNDED PRECEDING) AS idle FROM r),
s AS (SELECT *, min(CASE WHEN idle >= 10 THEN round_number END) OVER (PARTITION BY pair_key) AS stop FROM i)
SELECT pair_key, count(*) AS steps, count(*) FILTER (improved) AS improvements, arg_max(proposed_prompt, round_number) FILTER (improved) AS best_prompt,
  CAST(arg_max(idle, round_number) AS BIGINT) AS rejects_since, bool_or(stop IS NOT NULL) AS out_of_patience,
  coalesce(string_agg(proposed_prompt, chr(10) ORDER BY round_number) FILTER (NOT failed AND NOT improved AND island = top), '') AS history
FROM (SELECT *, max(island) FILTER (stop IS NULL OR round_number <= stop) OVER (PARTITION BY pair_key) AS top FROM s) s WHERE stop IS NULL OR round_number <= stop GROUP BY pair_key""")
add("a10_survey_summary", lambda g: verdicts.survey_summary(g("responses")), f"""
SELECT strategy, task, count(DISTINCT participant_id) AS participants, count(*) AS responses, round(CAST(count(*) AS DOUBLE) / count(DISTINCT participant_id), 6) AS mean_responses
FROM {sql('responses')} GROUP BY GROUPING SETS ((strategy, task), ())""")
add("a12_comparison_type_counts", lambda g: pairing.pair_counts_within_class(g("items")), f"SELECT least(status1, status2) AS type1, greatest(status1, status2) AS type2, count(*) AS n FROM ({J1}) GROUP BY ALL")

# --- statistics ----------------------------------------------------------------------------------
CELL_SQL = f"(SELECT model, task, strategy, type, avg(chosen) AS cell_mean, count(chosen) AS cell_n FROM {KEPT} GROUP BY ALL)"
SCORE_SQL = f"""WITH k AS (SELECT * FROM {KEPT}), c AS (SELECT * FROM {CELL_SQL}), m AS (SELECT strategy, type, avg(cell_mean) AS emm, count(*) AS cells FROM c GROUP BY ALL),
u AS (SELECT pair_id, strategy, type, sum((chosen - cell_mean) / cell_n / cells) AS u FROM k JOIN c USING (model, task, strategy, type) JOIN m USING (strategy, type) GROUP BY ALL),
f AS (SELECT (N - 1) / CAST(N - K AS DOUBLE) * G / CAST(G - 1 AS DOUBLE) AS factor FROM (SELECT count(*) AS N, count(DISTINCT pair_id) AS G FROM k), (SELECT count(*) AS K FROM c))"""
add("m1_cell_means", lambda g: rounded(stats.cell_means(kept(g), CELLS), "cell_mean"), f"SELECT model, task, strategy, type, round(cell_mean, 6) AS cell_mean, cell_n FROM {CELL_SQL}")
add("m2_marginal_means", lambda g: rounded(stats.marginal_means(stats.cell_means(kept(g), CELLS), ["type", "model", "strategy"], grid=4), "emm"), f"""
SELECT type, model, strategy, round(CASE WHEN count(*) = 4 THEN avg(cell_mean) END, 6) AS emm, count(*) AS cells FROM {CELL_SQL} GROUP BY ALL""")
add("m3_clustered_se", lambda g: rounded(stats.clustered_se(kept(g), CELLS, ["strategy", "type"]), "emm", "se"), f"""{SCORE_SQL}
SELECT strategy, type, round(any_value(emm), 6) AS emm, round(sqrt(sum(u * u) * any_value(factor)), 6) AS se FROM u JOIN m USING (strategy, type), f GROUP BY strategy, type""")
add("m6_contrasts", lambda g: rounded(stats.contrasts(kept(g), CELLS, "type", ["strategy"], LEVELS), "estimate", "se"), f"""{SCORE_SQL},
p AS (SELECT * FROM (VALUES ('original', 'zero-shot'), ('original', 'final'), ('zero-shot', 'final')) v(a, b)),
g AS (SELECT DISTINCT pair_id, strategy FROM u), x AS (SELECT strategy, p.a, p.b, sum((coalesce(ub.u, 0) - coalesce(ua.u, 0)) ** 2) AS s
  FROM g CROSS JOIN p LEFT JOIN u ua ON ua.pair_id = g.pair_id AND ua.strategy = g.strategy AND ua.type = p.a LEFT JOIN u ub ON ub.pair_id = g.pair_id AND ub.strategy = g.strategy AND ub.type = p.b GROUP BY ALL)
SELECT x.strategy, x.b || ' - ' || x.a AS contrast, round(mb.emm - ma.emm, 6) AS estimate, round(sqrt(s * factor), 6) AS se
FROM x JOIN m ma ON ma.strategy = x.strategy AND ma.type = x.a JOIN m mb ON mb.strategy = x.strategy AND mb.type = x.b, f""".replace("SELECT strategy, p.a, p.b, sum", "SELECT g.strategy, p.a, p.b, sum"))
add("m6_contrasts_pairwise", lambda g: rounded(stats.contrasts(kept(g), CELLS, "type", ["strategy"], LEVELS, pairwise=True), "estimate", "se"), f"SELECT strategy, split_part(contrast, ' - ', 2) || ' - ' || split_part(contrast, ' - ', 1) AS contrast, -estimate AS estimate, se FROM ({ORACLES['m6_contrasts']})")
add("m7_bh_adjust", lambda g: rounded(stats.bh_adjust(g("verdicts").selectExpr("pair_id", "task", "CASE WHEN pair_id % 10 = 0 THEN NULL ELSE CAST(pair_id * 7919 % 100003 AS DOUBLE) / 100003 END AS p"), ["task"], "p"), "p", "p_adjusted"), f"""
WITH t AS (SELECT pair_id, task, CASE WHEN pair_id % 10 = 0 THEN NULL ELSE CAST(pair_id * 7919 % 100003 AS DOUBLE) / 100003 END AS p FROM {sql('verdicts')}),
r AS (SELECT *, row_number() OVER (PARTITION BY task, p IS NULL ORDER BY p, pair_id) AS k, count(p) OVER (PARTITION BY task, p IS NULL) AS n FROM t)
SELECT pair_id, task, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(min(p * n / k) OVER (PARTITION BY task, p IS NULL ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END, 6) AS p_adjusted FROM r""")
add("m12_head2head_long", lambda g: stats.head2head_long(g("head2head")), """
SELECT pair_id, model, task, strategy1 AS strategy, CAST(choice = 'first' AS INTEGER) AS chosen FROM {0} WHERE choice <> 'inconsistent'
UNION ALL SELECT pair_id, model, task, strategy2, CAST(choice = 'second' AS INTEGER) FROM {0} WHERE choice <> 'inconsistent'""".format(sql("head2head")))
add("m13_mitigation_outcomes", lambda g: stats.mitigation_outcomes(long(g), ["task", "iterations", "pair_id"]), f"""
SELECT task, iterations, pair_id, type, coalesce(chosen, 0) AS chosen FROM {LONG}
UNION ALL SELECT task, iterations, pair_id, 'inconsistent', CAST(max(CAST(chosen IS NULL AS INTEGER)) AS INTEGER) FROM {LONG} GROUP BY task, iterations, pair_id""")
add("m14_human_choices_long", lambda g: stats.human_choices_long(g("responses")), """
SELECT participant_id, strategy, task, image1_status AS type, CAST(choice = 1 AS INTEGER) AS chosen FROM {0} UNION ALL SELECT participant_id, strategy, task, image2_status, CAST(choice = 2 AS INTEGER) FROM {0}""".format(sql("responses")))
SHOWN = ["pair_id AS participant_id", "task", "strategy1 AS image1_strategy", "strategy2 AS image2_strategy", "CASE choice WHEN 'first' THEN 1 WHEN 'second' THEN 2 END AS choice"]
add("m14_human_choices_long_strategies", lambda g: stats.human_choices_long(g("head2head").selectExpr(*SHOWN), "strategy", ["competition", "textgrad"]), f"""
WITH s AS (SELECT {", ".join(SHOWN)} FROM {sql('head2head')}),
l AS (SELECT participant_id, task, choice, nullif(image1_strategy, 'feedback_descent') AS s1, nullif(image2_strategy, 'feedback_descent') AS s2 FROM s),
c AS (SELECT *, CASE choice WHEN 1 THEN s1 WHEN 2 THEN s2 END AS won FROM l)
SELECT participant_id, task, s1 AS strategy, CAST(s1 = won AS INTEGER) AS chosen FROM c UNION ALL SELECT participant_id, task, s2, CAST(s2 = won AS INTEGER) FROM c""")
add("k11_best_level", lambda g: rounded(sampling.best_level(stats.marginal_means(stats.cell_means(kept(g), CELLS), ["type", "model"]), ["model"], "type", "emm"), "emm"), f"""
SELECT type, model, round(emm, 6) AS emm, cells FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY emm DESC, type) AS n FROM (SELECT type, model, avg(cell_mean) AS emm, count(*) AS cells FROM {CELL_SQL} GROUP BY ALL)) WHERE n = 1""")

# --- similarity ----------------------------------------------------------------------------------
META = f"""(SELECT vec_id, image_path, embedding, 'hotels' AS dataset, 'rooms' AS image_class, CASE WHEN o THEN CAST(b AS VARCHAR) WHEN one THEN CAST(b AS VARCHAR) ELSE CAST(b + 1 AS VARCHAR) END AS current_base_id,
  CASE WHEN NOT o THEN CASE WHEN one THEN CAST(b + 1 AS VARCHAR) ELSE CAST(b AS VARCHAR) END END AS other_base_id,
  CASE WHEN o THEN CAST(b AS VARCHAR) WHEN one THEN b || '_original' ELSE (b + 1) || '_final' END AS current_id, CASE WHEN NOT o THEN CASE WHEN one THEN (b + 1) || '_final' ELSE b || '_original' END END AS other_id,
  CASE WHEN NOT o THEN CASE WHEN vec_id % 5 < 3 THEN 1 ELSE 3 END END AS debiased_iter
  FROM (SELECT *, vec_id // 5 AS b, vec_id % 5 = 0 AS o, vec_id % 5 IN (1, 3) AS one FROM {sql('images')}))"""
KEYED = f"(SELECT *, CASE WHEN debiased_iter IS NOT NULL THEN dataset || '_' || least(current_id, other_id) || '_' || greatest(current_id, other_id) || '_' || debiased_iter END AS pair_key FROM {META})"
COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
BETWEEN = f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY image_path) AS n FROM {KEYED} WHERE pair_key IS NOT NULL)
SELECT a.pair_key, a.debiased_iter, a.image_path AS path_a, b.image_path AS path_b, {COS.format('a.embedding', 'b.embedding')} AS similarity FROM r a JOIN r b ON a.pair_key = b.pair_key AND a.n = 1 AND b.n = 2)"""


def images(get: Callable[[str], DataFrame]) -> DataFrame:
    return similarity.parse_image_path(get("images")).withColumn("pair_key", similarity.pair_key())


add("p5_parse_image_path", lambda g: similarity.parse_image_path(g("images")).drop("embedding"), f"SELECT * EXCLUDE (embedding) FROM {META}")
add("v1_pair_key", lambda g: images(g).select("vec_id", "pair_key"), f"SELECT vec_id, pair_key FROM {KEYED}")
add("v2_valid_pairs", lambda g: similarity.valid_pairs(images(g)).select("vec_id", "pair_key"), f"SELECT vec_id, pair_key FROM (SELECT *, count(*) OVER (PARTITION BY pair_key) AS n FROM {KEYED}) WHERE pair_key IS NOT NULL AND n >= 2")
add("j10_between_pairs", lambda g: rounded(similarity.between_pairs(similarity.valid_pairs(images(g))), "similarity"), f"SELECT pair_key, debiased_iter, path_a, path_b, round(similarity, 6) AS similarity FROM {BETWEEN}")
add("j11_from_original", lambda g: rounded(similarity.from_original(images(g)), "similarity"), f"""
WITH v AS (SELECT dataset, current_base_id, debiased_iter, current_id LIKE '%\\_final' ESCAPE '\\' AS is_final, min(image_path) AS p FROM {META} WHERE debiased_iter IS NOT NULL GROUP BY ALL)
SELECT v.current_base_id, v.debiased_iter, is_final, o.image_path AS path_a, i.image_path AS path_b, round({COS.format('o.embedding', 'i.embedding')}, 6) AS similarity
FROM v JOIN {META} o ON o.debiased_iter IS NULL AND o.dataset = v.dataset AND o.current_base_id = v.current_base_id JOIN {META} i ON i.image_path = v.p""")
add("v5_ci95_stats", lambda g: rounded(similarity.ci95_stats(similarity.between_pairs(similarity.valid_pairs(images(g))), ["debiased_iter"]), "mean", "sd", "low", "high"), f"""
SELECT debiased_iter, round(m, 6) AS mean, round(s, 6) AS sd, n, round(m - 1.96::DOUBLE * s / sqrt(n), 6) AS low, round(m + 1.96::DOUBLE * s / sqrt(n), 6) AS high
FROM (SELECT debiased_iter, avg(similarity) AS m, stddev_samp(similarity) AS s, count(similarity) AS n FROM {BETWEEN} GROUP BY debiased_iter)""")
