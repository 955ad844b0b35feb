"""Scaling, metrics, article-aware scores and losses, reports and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from litprops.operators import article_metrics as am
from litprops.operators import batches, grid, metrics, scaling, splits
from litprops.operators.regress import evaluate
from workload.baseline_queries import METRICS
from workload.bindings import REC, SPLIT, records, split
from workload.registry import R, query, rnd, rounded, table


@query(f"WITH {REC} SELECT dataset, part, count(*) AS n, {METRICS} FROM rec GROUP BY ALL")
def regression_metrics(spark, d):
    return rounded(metrics.regression_metrics(records(spark, d), ["dataset", "part"]), "r2", "rmse", "mae")


@query(
    f"""WITH {REC} SELECT dataset, article_key, count(*) AS n,
 CASE WHEN count(*) < 2 THEN 0.0 WHEN max(y) = min(y) THEN CASE WHEN sum((y-p)*(y-p)) = 0 THEN 1.0 ELSE 0.0 END ELSE {R("1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*))", 3)} END AS r2,
 {R("sqrt(avg((y-p)*(y-p)))")} AS rmse, {R("avg(abs(y-p))")} AS mae FROM rec GROUP BY dataset, article_key"""
)
def epoch_metrics(spark, d):
    """Epoch form: R2 is 0 below two rows."""
    out = metrics.regression_metrics(records(spark, d), ["dataset", "article_key"], form="epoch")
    return rounded(rounded(out, "rmse", "mae"), "r2", digits=3)


@query(f"WITH {REC} SELECT dataset, article_key, min(y) AS lo, max(y) AS hi FROM rec WHERE part = 'train' GROUP BY ALL")
def article_ranges(spark, d):
    return am.article_ranges(records(spark, d).filter("part = 'train'"), ["dataset", "article_key"])


_RANGES = f"""{REC}, rg AS (SELECT dataset, article_key, min(y) AS lo, max(y) AS hi FROM rec WHERE part = 'train' GROUP BY ALL HAVING min(y) < max(y)),
sc AS (SELECT rec.*, lo, hi, (p BETWEEN lo AND hi)::INT AS hit, exp(-((p - (lo+hi)/2) * (p - (lo+hi)/2)) / (2 * ((hi-lo)/2) * ((hi-lo)/2))) AS score FROM rec JOIN rg USING (dataset, article_key) WHERE part <> 'train')"""


@query(f"WITH {_RANGES} SELECT dataset, part, count(*) AS eligible, {R('avg(hit)')} AS hit_rate, {R('avg(score)')} AS nars FROM sc GROUP BY ALL")
def range_hit_rate_and_nars(spark, d):
    r = records(spark, d)
    ranges = am.article_ranges(r.filter("part = 'train'"), ["dataset", "article_key"])
    out = am.range_scores(r.filter("part <> 'train'"), ranges, ["dataset", "article_key"], ["dataset", "part"])
    return rounded(out, "hit_rate", "nars")


@query(f"WITH {_RANGES} SELECT row_idx, sc.lo, sc.hi, hit FROM sc")
def range_check(spark, d):
    r = records(spark, d)
    ranges = am.article_ranges(r.filter("part = 'train'"), ["dataset", "article_key"])
    return am.in_range_rows(r.filter("part <> 'train'"), ranges, ["dataset", "article_key"]).select("row_idx", "lo", "hi", "hit")


@query(
    f"""WITH {_RANGES}, m AS (SELECT dataset, count(*) AS n, {METRICS} FROM rec WHERE part = 'test' GROUP BY dataset),
s AS (SELECT dataset, count(*) AS eligible, {R('avg(hit)')} AS hit_rate, {R('avg(score)')} AS nars FROM sc WHERE part = 'test' GROUP BY dataset)
SELECT * FROM m JOIN s USING (dataset)"""
)
def evaluate_split(spark, d):
    """Metrics, hit rate and NARS of the test part."""
    r = records(spark, d)
    out = evaluate(r.filter("part = 'test'"), r.filter("part = 'train'"), ["dataset"])
    return rounded(out, "r2", "rmse", "mae", "hit_rate", "nars")


@query(
    f"""WITH {REC}, a AS (SELECT dataset, article_key, count(*) AS n, var_pop((p-y)/1000) AS v, avg((p-y)/1000) AS m FROM rec GROUP BY ALL)
SELECT dataset, count(*) AS articles, {R("coalesce(avg(CASE WHEN n > 1 THEN v END), 0)")} AS consistency, {R("avg(m*m)")} AS bias FROM a GROUP BY dataset"""
)
def consistency_and_bias(spark, d):
    r = records(spark, d).withColumns({"y": F.col("y") / 1000, "p": F.col("p") / 1000})
    return rounded(am.consistency_and_bias(r, ["article_key"], ["dataset"]), "consistency", "bias")


_BATCH = 64
_POS = f"""{REC}, pos AS (SELECT *, row_number() OVER (ORDER BY substr(md5('7:' || article_key), 1, 13), article_key, substr(md5('7:' || row_idx), 1, 13), row_idx) - 1 AS pos FROM rec),
bat AS (SELECT *, pos // {_BATCH} AS batch_id FROM pos)"""


@query(f"WITH {_POS} SELECT row_idx, article_key, pos, batch_id, md5('7:' || batch_id) AS batch_order FROM bat")
def article_batches(spark, d):
    """Article-grouped batches of one epoch."""
    out = batches.article_batches(records(spark, d).select("row_idx", "article_key"), "article_key", "row_idx", _BATCH, 7)
    return out.select("row_idx", "article_key", "pos", "batch_id", "batch_order")


@query(f"WITH {_POS}, n AS (SELECT batch_id FROM bat GROUP BY 1 HAVING count(*) = {_BATCH}) SELECT row_idx, batch_id FROM bat JOIN n USING (batch_id)")
def article_batches_drop_last(spark, d):
    out = batches.article_batches(records(spark, d).select("row_idx", "article_key"), "article_key", "row_idx", _BATCH, 7, drop_last=True)
    return out.select("row_idx", "batch_id")


_LOSS = f"""{_POS}, z AS (SELECT batch_id, article_key, row_idx, y/100000 AS y, p/100000 AS p FROM bat),
a AS (SELECT batch_id, article_key, count(*) AS n, sum((p-y)*(p-y)) AS sq, CASE WHEN count(*) > 1 THEN var_pop(p-y) END AS v, avg(p-y) AS m FROM z GROUP BY ALL),
pr AS (SELECT batch_id, article_key, avg(ln(1 + exp(greatest(-50, least(50, j.p - i.p))))) AS l FROM z i JOIN z j USING (batch_id, article_key) WHERE i.y > j.y GROUP BY ALL),
los AS (SELECT batch_id, sum(n)::BIGINT AS n, sum(sq)/sum(n) AS mse, coalesce(avg(v), 0) AS consistency, avg(m*m) AS bias, coalesce(avg(l), 0) AS ranking FROM a LEFT JOIN pr USING (batch_id, article_key) GROUP BY batch_id)"""


def _losses(spark, d):
    z = records(spark, d).select("row_idx", "article_key", (F.col("y") / 100000).alias("y"), (F.col("p") / 100000).alias("p"))
    return am.batch_losses(batches.article_batches(z, "article_key", "row_idx", _BATCH, 7))


@query(f"WITH {_LOSS} SELECT batch_id, n, {R('mse', 6)} AS mse, {R('consistency', 6)} AS consistency, {R('bias', 6)} AS bias, {R('ranking', 6)} AS ranking FROM los")
def article_losses(spark, d):
    """MSE, consistency, bias and pairwise ranking loss of every article-grouped batch."""
    return rounded(_losses(spark, d), *am.LOSSES, digits=6)


@query(
    f"""WITH {REC}, z AS (SELECT dataset, article_key % 20 AS article, y/100000 AS y, p/100000 AS p FROM rec),
a AS (SELECT dataset, article, count(*) AS n, sum((p-y)*(p-y)) AS sq, CASE WHEN count(*) > 1 THEN var_pop(p-y) END AS v, avg(p-y) AS m FROM z GROUP BY ALL),
pr AS (SELECT dataset, article, avg(ln(1 + exp(greatest(-50, least(50, j.p - i.p))))) AS l FROM z i JOIN z j USING (dataset, article) WHERE i.y > j.y GROUP BY ALL)
SELECT dataset, count(*) AS articles, sum(n)::BIGINT AS n, {R('sum(sq)/sum(n)', 6)} AS mse, {R('coalesce(avg(v), 0)', 6)} AS consistency, {R('avg(m*m)', 6)} AS bias, {R('coalesce(avg(l), 0)', 6)} AS ranking
FROM a LEFT JOIN pr USING (dataset, article) GROUP BY dataset"""
)
def whole_article_losses(spark, d):
    """The losses over whole articles (here twenty large ones per dataset), every pair of rows compared."""
    z = records(spark, d).select("dataset", (F.col("article_key") % 20).alias("article"), (F.col("y") / 100000).alias("y"), (F.col("p") / 100000).alias("p"))
    return rounded(am.whole_article_losses(z, ["article"], ["dataset"], block_rows=64), *am.LOSSES, digits=6)


@query(
    f"""WITH {_LOSS} SELECT sum(n)::BIGINT AS rows, {R("sum(mse*n)/sum(n)", 6)} AS mse, {R("sum(consistency*n)/sum(n)", 6)} AS consistency, {R("sum(bias*n)/sum(n)", 6)} AS bias,
 {R("sum(ranking*n)/sum(n)", 6)} AS ranking, {R("sum((mse + 0.1*consistency + 0.2*ranking)*n)/sum(n)", 6)} AS total FROM los"""
)
def epoch_loss(spark, d):
    """Size-weighted epoch averages, and the weighted total with a zero bias weight."""
    weights = {"mse": 1.0, "consistency": 0.1, "bias": 0.0, "ranking": 0.2}
    per = _losses(spark, d).withColumn("total", am.weighted_loss(weights))
    return rounded(metrics.epoch_loss(per, losses=[*am.LOSSES, "total"]), *am.LOSSES, "total", digits=6)


@query(
    f"""WITH {_LOSS}, w AS (SELECT unnest([0.0, 0.01, 0.1, 0.2]) AS w), one AS (SELECT sum(mse*n)/sum(n) AS mse, sum(consistency*n)/sum(n) AS c, sum(bias*n)/sum(n) AS b, sum(ranking*n)/sum(n) AS r FROM los)
SELECT a.w::DOUBLE AS w_consistency, b.w::DOUBLE AS w_bias, c.w::DOUBLE AS w_ranking, {R("mse + a.w*c + b.w*b + c.w*r", 6)} AS total FROM one, w a, w b, w c"""
)
def loss_weight_grid(spark, d):
    """Epoch loss for 4 x 4 x 4 weight combinations; the grid meets one aggregated row."""
    one = metrics.epoch_loss(_losses(spark, d), losses=am.LOSSES)
    weights = [0.0, 0.01, 0.1, 0.2]
    return rounded(grid.score_grid(one, {"consistency": weights, "bias": weights, "ranking": weights}, []), "total", digits=6)


_LOG = "CASE WHEN dataset IN ('1-URGENT', '2-HIGH') THEN 'log' ELSE 'identity' END"
_SCALER = f"""{REC}, t AS (SELECT *, {_LOG} AS transform, CASE WHEN {_LOG} = 'log' THEN ln(y) ELSE y END AS t FROM rec),
sc AS (SELECT dataset, transform, avg(t) AS mean, CASE WHEN max(t) = min(t) THEN 1.0 ELSE stddev_pop(t) END AS scale FROM t WHERE part = 'train' GROUP BY ALL)"""


def _with_transform(spark, d):
    return records(spark, d).withColumn("transform", scaling.transform_for("dataset", ["1-URGENT", "2-HIGH"]))


@query(f"WITH {_SCALER} SELECT dataset, transform, {R('mean')} AS mean, {R('scale')} AS scale FROM sc")
def target_scaler(spark, d):
    return rounded(scaling.fit(_with_transform(spark, d).filter("part = 'train'"), ["dataset"]), "mean", "scale")


@query(f"WITH {_SCALER} SELECT row_idx, {R('(t - mean) / scale')} AS y_scaled, {R('y', 3)} AS y_back FROM t JOIN sc USING (dataset, transform)")
def scale_and_inverse(spark, d):
    r = _with_transform(spark, d)
    scaled = scaling.scale(r, scaling.fit(r.filter("part = 'train'"), ["dataset"]), ["dataset"])
    return scaled.select("row_idx", rnd("y_scaled").alias("y_scaled"), rnd(scaling.inverse("y_scaled"), 3).alias("y_back"))


_BAD = "SELECT row_idx, y, CASE WHEN isnan(y) THEN 'not finite' ELSE 'not positive' END AS reason FROM (SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 50 = 3 THEN 'NaN'::DOUBLE ELSE o_totalprice - 20000 END AS y FROM orders) WHERE isnan(y) OR y <= 0"


def _shifted(spark, d):
    y = F.when(F.col("o_orderkey") % 50 == 3, F.lit(float("nan"))).otherwise(F.col("o_totalprice") - 20000)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), y.alias("y"), F.lit("log").alias("transform"))


@query(_BAD)
def bad_targets(spark, d):
    """Targets that are not finite, or not positive under a log transform."""
    return scaling.bad_targets(_shifted(spark, d), "y", "transform")


@query(_BAD + " ORDER BY row_idx LIMIT 10")
def first_bad_targets(spark, d):
    return scaling.first_bad(_shifted(spark, d), "y", "transform")


_SEEDS = f"""{REC}, seeds AS (SELECT dataset, row_idx % 3 AS seed, {METRICS} FROM rec WHERE part = 'test' GROUP BY ALL)"""


def _per_seed(spark, d):
    r = records(spark, d).filter("part = 'test'").withColumn("seed", F.col("row_idx") % 3)
    return rounded(metrics.regression_metrics(r, ["dataset", "seed"]).drop("n"), "r2", "rmse", "mae")


_MEANS = ", ".join(f"{R(f'avg({m})')} AS {m}_mean, {R(f'stddev_pop({m})')} AS {m}_std" for m in ("r2", "rmse", "mae"))


@query(f"WITH {_SEEDS} SELECT dataset, count(*) AS runs, {_MEANS} FROM seeds GROUP BY dataset")
def seed_summary(spark, d):
    out = metrics.seed_summary(_per_seed(spark, d), ["dataset"], ["r2", "rmse", "mae"])
    return rounded(out, *[f"{m}_{s}" for m in ("r2", "rmse", "mae") for s in ("mean", "std")])


_FMT = lambda e: f"printf('%.4f', {e})"


@query(
    f"""WITH {_SEEDS} SELECT dataset, seed::VARCHAR AS seed, {", ".join(f"{_FMT(m)} AS {m}" for m in ("r2", "rmse", "mae"))}, 0 AS row_kind FROM seeds
UNION ALL SELECT dataset, 'mean ± std', {", ".join(f"{_FMT(f'avg({m})')} || ' ± ' || {_FMT(f'stddev_pop({m})')}" for m in ("r2", "rmse", "mae"))}, 1 FROM seeds GROUP BY dataset"""
)
def seed_report(spark, d):
    """Detail rows with the summary row below."""
    return metrics.with_summary_row(_per_seed(spark, d), ["dataset"], ["r2", "rmse", "mae"])


@query(
    f"""WITH {_SEEDS} SELECT dataset, {_FMT('avg(rmse)')} AS mean_text, {_FMT('stddev_pop(rmse)')} AS std_text, dataset AS plain_text, '' AS plain_std FROM seeds GROUP BY dataset"""
)
def metric_text_split(spark, d):
    """``m ± s`` formatted and split again; text without the sign stays whole."""
    s = metrics.seed_summary(_per_seed(spark, d), ["dataset"], ["rmse"]).withColumn("text", metrics.format_mean_std("rmse_mean", "rmse_std"))
    mean, std = metrics.split_mean_std("text")
    plain, none = metrics.split_mean_std("dataset")
    return s.select("dataset", mean.alias("mean_text"), std.alias("std_text"), plain.alias("plain_text"), none.alias("plain_std"))


@query(f"WITH {_SEEDS} SELECT seed, count(*) AS datasets, {', '.join(f'{R(f"avg({m})")} AS {m}' for m in ('r2', 'rmse', 'mae'))} FROM seeds GROUP BY seed")
def joint_score(spark, d):
    """Unweighted mean over datasets."""
    out = metrics.dataset_mean(_per_seed(spark, d), ["seed"], ["r2", "rmse", "mae"])
    return rounded(out, "r2", "rmse", "mae")


def _stages(spark, d):
    """Predictions before and after tuning: the second half the error."""
    r = records(spark, d).filter("part = 'test'")
    two = F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.col("p").alias("q")), F.struct(F.lit("after").alias("stage"), ((F.col("p") + F.col("y")) / 2).alias("q"))))
    rows = r.select("dataset", "y", two.alias("s")).select("dataset", "y", "s.stage", F.col("s.q").alias("p"))
    return metrics.regression_metrics(rows, ["dataset", "stage"]).drop("n")


@query(
    f"""WITH {REC}, st AS (SELECT dataset, 'before' AS stage, y, p FROM rec WHERE part = 'test' UNION ALL SELECT dataset, 'after', y, (p + y) / 2 FROM rec WHERE part = 'test'),
m AS (SELECT dataset, stage, 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae FROM st GROUP BY ALL),
u AS (SELECT * FROM m UNION ALL SELECT dataset, 'improvement', a.r2 - b.r2, b.rmse - a.rmse, b.mae - a.mae FROM m a JOIN m b USING (dataset) WHERE a.stage = 'after' AND b.stage = 'before')
SELECT dataset, stage, {R('r2')} AS r2, {R('rmse')} AS rmse, {R('mae')} AS mae FROM u"""
)
def improvement_rows(spark, d):
    return rounded(metrics.improvement_row(_stages(spark, d), ["dataset"]), "r2", "rmse", "mae")


_TRIALS = f"""{REC}, cfg AS (SELECT (i.v * 3 + j.v)::BIGINT AS trial, [1.0, 0.5][i.v + 1] AS shrink, [0, 1, 2][j.v + 1]::BIGINT AS seed FROM (SELECT unnest([0, 1]) AS v) i, (SELECT unnest([0, 1, 2]) AS v) j),
run AS (SELECT trial, shrink::DOUBLE AS shrink, seed, y, y + (p - y) * shrink AS p FROM rec JOIN cfg ON row_idx % 3 = seed WHERE part = 'val' AND trial <> 4),
sc AS (SELECT trial, shrink, seed, count(*) AS n, {METRICS} FROM run GROUP BY trial, shrink, seed)"""


def _scored_trials(spark, d):
    """Six trials of a small grid, each scored on its validation rows; trial 4 failed and left no result."""
    trials = grid.expand(spark, {"shrink": [1.0, 0.5], "seed": [0, 1, 2]})
    val = records(spark, d).filter("part = 'val'").withColumn("seed", (F.col("row_idx") % 3).cast("int"))
    # Each row is scored under the trials of its seed: the grid's few rows are exploded from a literal, nothing is crossed.
    shrink = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate([1.0, 0.5])]))
    rows = val.select("seed", "y", "p", shrink.alias("g")).select(
        (F.col("g.i") * 3 + F.col("seed")).cast("bigint").alias("trial"), "y", (F.col("y") + (F.col("p") - F.col("y")) * F.col("g.s")).alias("p")
    )
    results = metrics.regression_metrics(rows, ["trial"]).filter("trial <> 4")
    return rounded(grid.trial_results(trials, results), "r2", "rmse", "mae")


@query(f"WITH {_TRIALS} SELECT * FROM sc")
def trial_results(spark, d):
    return _scored_trials(spark, d)


@query(f"WITH {_TRIALS} SELECT * FROM sc ORDER BY rmse, trial LIMIT 1")
def best_trial(spark, d):
    return grid.best_trial(_scored_trials(spark, d), "rmse", larger_is_better=False)


@query(
    """WITH s AS (SELECT DISTINCT p_size AS v FROM part), p AS (SELECT a.v AS d1, b.v AS d2 FROM s a JOIN s b ON a.v = 2 * b.v), g AS (SELECT a.v AS d1, b.v AS d2 FROM s a JOIN s b ON a.v > b.v)
SELECT 'd1_eq_2d2' AS rule, count(*) AS pairs, sum(d1 * 1000 + d2)::BIGINT AS checksum FROM p UNION ALL SELECT 'd1_gt_d2', count(*), sum(d1 * 1000 + d2)::BIGINT FROM g"""
)
def constrained_pairs(spark, d):
    """Constrained grid dimensions whose candidates are the part sizes."""
    sizes = table(spark, d, "part").select("p_size").distinct()
    rows = [
        grid.pair_rows(sizes.toDF("d1"), sizes.toDF("d2"), rule).agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("pairs"), F.sum(F.expr("d1 * 1000 + d2")).cast("bigint").alias("checksum"))
        for rule in ("d1_eq_2d2", "d1_gt_d2")
    ]
    return rows[0].unionByName(rows[1])


@query(
    f"""WITH day AS (SELECT user_id % 5 AS run, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, avg(value) AS val_loss FROM events GROUP BY ALL),
a AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, min(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS best, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM day),
b AS (SELECT *, (prior IS NULL OR val_loss < prior) AS improved FROM a),
c AS (SELECT *, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS waited FROM b),
s AS (SELECT *, min(CASE WHEN waited >= 3 THEN n END) OVER (PARTITION BY run) AS stop_n FROM c)
SELECT run, epoch::INT AS epoch, {R('val_loss')} AS val_loss, {R('best')} AS best, improved, waited::INT AS waited, coalesce(n = stop_n, FALSE) AS stop FROM s WHERE stop_n IS NULL OR n <= stop_n"""
)
def early_stop_trace(spark, d):
    """Running best, patience counter and stop over a daily log."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    log = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("run"), day.alias("epoch")).agg(F.avg("value").alias("val_loss"))
    out = batches.early_stop(log, patience=3)
    return rounded(out.withColumn("waited", F.col("waited").cast("int")), "val_loss", "best")


@query(
    """WITH o AS (SELECT o_orderkey // 100 AS batch_id, o_orderkey AS row_idx FROM orders) SELECT batch_id, count(*) AS n, min(row_idx) AS first_row FROM o GROUP BY batch_id"""
)
def fixed_batches(spark, d):
    b = table(spark, d, "orders").select(batches.fixed_batches("o_orderkey", 100).alias("batch_id"), F.col("o_orderkey").alias("row_idx"))
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"))


@query(f"WITH {SPLIT} SELECT dataset AS property, split_name, part, count(*) AS n, sum(row_idx)::BIGINT AS checksum FROM split WHERE part <> 'test' GROUP BY ALL")
def joint_training_rows(spark, d):
    """Training and validation rows of all properties, stacked with their property."""
    return splits.stacked(records(spark, d).select("dataset", "row_idx", "y"), split(spark, d)).groupBy("property", "split_name", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("row_idx").alias("checksum"))


@query(
    f"""WITH {SPLIT}, u AS (SELECT md5('42:fraction:' || row_idx) AS h, * FROM split),
f AS (SELECT u.*, pct FROM u, (SELECT unnest([20, 40, 60, 80, 100]) AS pct) WHERE part <> 'train' OR (('0x' || substr(h, 1, 13))::BIGINT / 4503599627370496.0) * 100 < pct)
SELECT dataset, CASE WHEN pct = 100 THEN split_name ELSE split_name || '_' || pct || 'pct' END AS split_name, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val, count(*) FILTER (part = 'test') AS test, count(*) AS total FROM f GROUP BY ALL"""
)
def nested_fractions(spark, d):
    """Nested training subsets with unchanged validation and test rows."""
    return splits.sizes(splits.nested_fractions(split(spark, d), ["row_idx"], 42))


@query(
    f"""WITH {SPLIT}, flawed AS (SELECT dataset, split_name, part, row_idx FROM split WHERE row_idx % 11 <> 3 UNION ALL SELECT dataset, split_name, 'test', row_idx FROM split WHERE row_idx % 7 = 2)
SELECT (SELECT count(*) FROM (SELECT 1 FROM flawed GROUP BY dataset, split_name, row_idx HAVING count(DISTINCT part) > 1)) AS overlaps,
 (SELECT count(*) FROM rec JOIN (SELECT DISTINCT dataset, split_name FROM flawed) n USING (dataset) WHERE NOT EXISTS (SELECT 1 FROM flawed f WHERE f.dataset = rec.dataset AND f.split_name = n.split_name AND f.row_idx = rec.row_idx)) AS uncovered,
 (SELECT count(*) FROM split a JOIN split b USING (dataset, row_idx) WHERE a.split_name = 'split_random' AND a.part = 'train' AND b.split_name = 'split_article' AND b.part <> 'train') AS not_nested"""
)
def split_checks(spark, d):
    """Disjointness, coverage and nestedness of splits, as row counts; the first two on a split with rows left out and rows in two parts."""
    s = split(spark, d)
    twice = s.filter("row_idx % 7 = 2").withColumn("part", F.lit("test"))
    flawed = s.filter("row_idx % 11 <> 3").unionByName(twice)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    a = count(splits.overlaps(flawed), "overlaps")
    b = count(splits.uncovered(records(spark, d), flawed), "uncovered")
    c = count(splits.not_nested(s, "split_random", "split_article"), "not_nested")
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(a).join(one(b), "k").join(one(c), "k").drop("k")


@query(
    """WITH a AS (SELECT unnest([0.1, 0.2]) AS lr), b AS (SELECT unnest([{'pool': 'last', 'dim': 128}, {'pool': 'att', 'dim': 64}, {'pool': 'att', 'dim': 128}]) AS g), o AS (SELECT DISTINCT o_orderpriority AS dataset FROM orders)
SELECT dataset, count(*) AS trials, sum((g).dim)::BIGINT AS dims, count(DISTINCT lr) AS rates FROM o, a, b GROUP BY dataset"""
)
def linked_grid(spark, d):
    """A plain and a linked dimension expanded for every dataset found in the records."""
    datasets = records(spark, d).select("dataset").distinct()
    trials = grid.expand(spark, {"lr": [0.1, 0.2]}, {"pooling": (["pool", "dim"], [["last", 128], ["att", 64], ["att", 128]])}, base=datasets)
    return trials.groupBy("dataset").agg(F.count(F.lit(1)).alias("trials"), F.sum("dim").cast("bigint").alias("dims"), F.countDistinct("lr").alias("rates"))


@query("SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM (SELECT o_orderstatus, o_orderkey FROM orders UNION ALL SELECT l_linestatus, l_orderkey FROM lineitem) GROUP BY 1")
def append_rows(spark, d):
    """New rows appended to existing output: a union, never a rewrite."""
    old = table(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    new = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("o_orderstatus"), F.col("l_orderkey").alias("o_orderkey"))
    return old.unionByName(new).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


@query("SELECT trial_name, row_number() OVER (ORDER BY split_part(trial_name, '_', 2)::INT) AS position FROM (SELECT DISTINCT 'trial_' || p_size AS trial_name FROM part)")
def trial_order(spark, d):
    """Trials by number, not by text (a few dozen names)."""
    names = table(spark, d, "part").select(F.concat(F.lit("trial_"), F.col("p_size").cast("string")).alias("trial_name")).distinct()
    return grid.trial_order(names)
