"""Curation, dataset reports, regression and streaming."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from litprops.functions.text import normalize_doi
from litprops.operators import curation, mining, regress, splits, validate, vectors
from litprops.operators.metrics import regression_metrics
from litprops.operators.spread import contiguous_index
from litprops.session import settle, shared_dir
from litprops.sources import records as records_source
from litprops.sources import sinks
from litprops.sources.json_arrays import read_json_arrays
from litprops.streaming import ingest
from workload.bindings import REC, SPLIT, entry_json, records, split
from workload.mining_queries import ERRORS
from workload.registry import R, query, rnd, rounded, table


@query(
    f"""SELECT o_orderkey AS row_idx, {R("CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderstatus WHEN 'O' THEN o_totalprice WHEN 'F' THEN o_totalprice - 273.15 END WHEN o_orderkey % 4 = 1 THEN CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN NULL WHEN 'P' THEN o_totalprice / 1000 END WHEN o_orderkey % 4 = 2 THEN CASE WHEN o_orderstatus = 'P' THEN o_totalprice END ELSE o_totalprice END")} AS value,
 CASE o_orderkey % 4 WHEN 0 THEN '°C' WHEN 1 THEN 'GPa' WHEN 2 THEN 'MPa' END AS unit FROM orders"""
)
def canonical_units(spark, d):
    """Values in the canonical unit of their property; an unknown unit gives NULL."""
    k, s = F.col("o_orderkey") % 4, F.col("o_orderstatus")
    prop = F.when(k == 0, "Tg").when(k == 1, "E").when(k == 2, "UTS").otherwise("n")
    unit = F.when(s == "O", " °C").when(s == "F", "K").otherwise("MPa")
    value, canonical = curation.canonical_value(prop, F.col("o_totalprice"), unit)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), rnd(value).alias("value"), canonical.alias("unit"))


@query("SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE '10.1/a' || o_custkey END AS doi FROM orders")
def normal_dois(spark, d):
    a = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit("https://doi.org/10.1/A"), a))
        .when(k == 1, F.concat(F.lit(" HTTP://DX.DOI.ORG/10.1/a"), a, F.lit(" ")))
        .when(k == 2, F.concat(F.lit("doi: 10.1/a"), a))
        .when(k == 3, F.concat(F.lit("10.1/A"), a))
        .otherwise(F.lit("  "))
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), normalize_doi(raw).alias("doi"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text, lang)")
def exact_duplicates_dropped(spark, d):
    """First of each group of equal records."""
    docs = table(spark, d, "documents")
    return curation.drop_duplicates(docs, ["text", "lang"], "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT min(doc_id) AS first_row, count(*) AS copies FROM documents GROUP BY text")
def duplicate_groups(spark, d):
    return curation.duplicate_groups(table(spark, d, "documents"), ["text"], "doc_id")


@query("SELECT p_partkey, min(l_orderkey) AS first_order FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def ordered_distinct(spark, d):
    """Distinct values by first position."""
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("first_order"))
    return curation.ordered_distinct(line, "p_partkey", "first_order")


@query(
    r"""SELECT doc_id, coalesce(len(list_filter(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda t: t::DOUBLE = doc_id % 50)) > 0, FALSE) AS leaks FROM documents"""
)
def target_leaks(spark, d):
    """Texts that quote their target (here doc_id modulo 50) as a number; whole texts are searched."""
    return table(spark, d, "documents").select("doc_id", curation.leaks_target(F.col("text"), (F.col("doc_id") % 50).cast("double")).alias("leaks"))


@query("SELECT o_orderkey AS row_idx, o_totalprice AS y FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
def range_restriction(spark, d):
    return table(spark, d, "orders").filter(curation.in_range(F.col("o_totalprice"), 100000.0, 200000.0)).select(F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").alias("y"))


@query("SELECT o_orderpriority AS property, count(*) AS records, count(DISTINCT o_custkey) AS articles FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def property_report(spark, d):
    """Records and articles per property, and in total."""
    r = records(spark, d).withColumnRenamed("dataset", "property")
    return curation.property_report(r)


_DOIS = "p AS (SELECT DISTINCT 'd' || o_custkey AS doi, CASE WHEN o_orderpriority = '1-URGENT' THEN 'E' WHEN o_orderpriority = '2-HIGH' THEN 'E' ELSE o_orderpriority END AS property FROM orders WHERE o_orderkey % 9 <> 0)"


@query(f"WITH {_DOIS} SELECT count(*) AS pairs, count(DISTINCT doi) AS articles FROM p")
def publication_pairs(spark, d):
    """Distinct DOI and property, E_article counted as E."""
    prop = F.when(F.col("o_orderpriority") == "1-URGENT", "E").when(F.col("o_orderpriority") == "2-HIGH", "E_article").otherwise(F.col("o_orderpriority"))
    o = table(spark, d, "orders").withColumn("property", prop)
    doi = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("d"), F.col("o_custkey").cast("string")))
    return curation.pair_counts(curation.publication_pairs(o, doi))


@query(
    """WITH u AS (SELECT o_orderkey AS row_idx, o_custkey AS article, ('0x' || substr(md5('3:' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0 AS r, ('0x' || substr(md5('3:' || o_custkey), 1, 13))::BIGINT / 4503599627370496.0 AS a FROM orders)
SELECT row_idx, CASE WHEN r < 0.7 THEN 'train' WHEN r < 0.7 + 0.1 THEN 'val' ELSE 'test' END AS random_part, CASE WHEN a < 0.7 THEN 'train' WHEN a < 0.7 + 0.1 THEN 'val' ELSE 'test' END AS article_part FROM u"""
)
def generated_splits(spark, d):
    """Random and article-disjoint parts by md5."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_idx"), splits.assign_parts("o_orderkey", 3).alias("random_part"), splits.assign_parts("o_custkey", 3).alias("article_part")
    )


@query(
    f"""WITH {REC} SELECT row_idx, article_key, dataset, y, CASE WHEN row_idx % 3 = 0 THEN NULL ELSE dataset || ' "' || row_idx || '}}\\' END AS note,
  CASE WHEN row_idx % 4 = 0 THEN 0 ELSE row_idx % 4 END AS n_monomers, CASE WHEN row_idx % 4 >= 2 THEN 'm' || row_idx || '-1' END AS second, [y, -y] AS "values" FROM rec"""
)
def exported_dataset(spark, d):
    """Final dataset with target, nested monomers and property values, written as JSON lines per dataset without the file name, and read back."""
    folder = f"{shared_dir(spark).rstrip('/')}/litprops-export-{uuid.uuid4().hex}"
    r = _nested_records(spark, d)
    sinks.write_dataset(r.withColumn("filename", F.lit("f")), folder)
    back = records_source.read_records(spark, folder, f"{_NESTED}, filename STRING").filter("filename IS NULL")
    return back.select(
        "row_idx", "article_key", "dataset", "y", "note", F.size("monomers").cast("bigint").alias("n_monomers"), F.get("monomers", F.lit(1))["smiles"].alias("second"), F.col("properties.price.value").alias("values")
    )


_NESTED = "article_key BIGINT, y DOUBLE, note STRING, monomers ARRAY<STRUCT<smiles: STRING, ratio_value: STRING>>, properties STRUCT<price: STRUCT<value: ARRAY<DOUBLE>, unit: STRING>>"


def _nested_records(spark, d):
    """Records with nulls, lists of structures and text that has JSON's own signs in it."""
    k = F.col("row_idx")
    one = lambda i: F.struct(F.concat(F.lit("m"), k.cast("string"), F.lit("-"), i.cast("string")).alias("smiles"), F.when(i == 0, "97-99").alias("ratio_value"))
    monomers = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (k % 4).cast("int")), one)
    note = F.when(k % 3 != 0, F.concat("dataset", F.lit(' "'), k.cast("string"), F.lit("}\\")))
    price = F.struct(F.array("y", -F.col("y")).alias("value"), F.when(k % 2 == 0, "USD").alias("unit"))
    return records(spark, d).select("row_idx", "article_key", "dataset", "y", note.alias("note"), monomers.alias("monomers"), F.struct(price.alias("price")).alias("properties"))


@query(
    f"""WITH {REC} SELECT dataset AS dataset, row_number() OVER (PARTITION BY dataset ORDER BY row_idx) - 1 AS position, row_idx, y,
  CASE WHEN row_idx % 3 <> 0 THEN dataset || ' "' || row_idx || '}}\\' END AS note, (row_idx % 4)::BIGINT AS n_monomers FROM rec"""
)
def record_arrays_read(spark, d):
    """One JSON array per dataset, each in one file, cut into splits and read back with list positions."""
    folder = f"{shared_dir(spark).rstrip('/')}/litprops-arrays-{uuid.uuid4().hex}"
    sinks.write_json_arrays(_nested_records(spark, d), folder, "row_idx", ["row_idx", "dataset", "y", "note", "monomers"])
    back = read_json_arrays(spark, f"{folder}/*/*.txt")
    take = lambda path, kind: F.variant_get("entry", path, kind)
    return back.select(
        take("$.dataset", "string").alias("dataset"), "position", take("$.row_idx", "bigint").alias("row_idx"), take("$.y", "double").alias("y"), F.try_variant_get("entry", "$.note", "string").alias("note"),
        F.size(take("$.monomers", "array<variant>")).cast("bigint").alias("n_monomers"),
    )


# ---- sinks, read back


def _folder(spark, what):
    return f"{shared_dir(spark).rstrip('/')}/litprops-{what}-{uuid.uuid4().hex}"


@query(f"WITH {SPLIT} SELECT dataset, split_name, part, pos, row_idx FROM split")
def splits_written(spark, d):
    """The long split table, written by dataset and split and read back."""
    folder = _folder(spark, "splits")
    sinks.write_splits(split(spark, d), folder)
    return records_source.read_splits(spark, folder).select("dataset", "split_name", "part", "pos", "row_idx")


@query("SELECT filename, count(*) AS times FROM (SELECT 'f' || o_orderkey AS filename FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'f' || o_orderkey FROM orders WHERE o_orderkey % 7 = 0) GROUP BY filename")
def no_data_written(spark, d):
    """Files without data, appended by two runs."""
    folder, k = _folder(spark, "no-data"), F.col("o_orderkey")
    for n in (5, 7):
        sinks.write_no_data(table(spark, d, "orders").filter(k % n == 0).select(F.concat(F.lit("f"), k.cast("string")).alias("filename")), folder)
    return spark.read.schema("filename STRING").json(f"{folder}/no_data").groupBy("filename").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 32 = 7)")
def pending_after_done(spark, d):
    """Work left after two runs marked what they finished."""
    folder, o = _folder(spark, "done"), table(spark, d, "orders")
    sinks.mark_done(o.filter("o_custkey % 3 = 0").select("o_custkey"), folder)
    sinks.mark_done(o.filter("o_orderkey % 32 = 7").select("o_custkey"), folder)
    return mining.pending(o.select("o_custkey").distinct(), spark.read.schema("o_custkey BIGINT").parquet(f"{folder}/done"), "o_custkey")


@query("""SELECT 'f' || o_orderkey AS filename, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS first, o_orderpriority AS reasoning, CASE WHEN o_orderkey % 4 = 0 THEN 'no answer' END AS error FROM orders""")
def trace_written(spark, d):
    """What each stage made of each file, with the model's reasoning."""
    folder, k = _folder(spark, "trace"), F.col("o_orderkey")
    entries = F.when(k % 4 != 0, F.array(F.struct(F.col("o_custkey").alias("n"))))
    stage = table(spark, d, "orders").select(
        F.concat(F.lit("f"), k.cast("string")).alias("filename"), entries.alias("stage1_entries"), entries.alias("stage2_entries"), entries.alias("final_entries"),
        F.col("o_orderpriority").alias("stage1_reasoning"), F.lit("r").alias("stage2_reasoning"), F.when(k % 4 == 0, "no answer").alias("error"),
    )
    sinks.write_trace(stage, folder)
    back = spark.read.schema("filename STRING, final_entries STRING, stage1_reasoning STRING, error STRING").json(f"{folder}/trace")
    return back.select("filename", F.get_json_object("final_entries", "$[0].n").cast("bigint").alias("first"), F.col("stage1_reasoning").alias("reasoning"), "error")


@query(f"WITH {REC} SELECT dataset, part, count(*) AS n, {R('sqrt(avg((y-p)*(y-p)))')} AS rmse, {R('avg(abs(y-p))')} AS mae FROM rec GROUP BY ALL")
def metrics_written(spark, d):
    """Metric rows as CSV, read back unchanged."""
    folder = _folder(spark, "metrics")
    sinks.write_metrics(regression_metrics(records(spark, d), ["dataset", "part"]), folder)
    back = spark.read.option("header", True).schema("dataset STRING, part STRING, n BIGINT, r2 DOUBLE, rmse DOUBLE, mae DOUBLE").csv(folder)
    return rounded(back.drop("r2"), "rmse", "mae")


@query(f"WITH {REC} SELECT row_idx, dataset, y, p, CASE part WHEN 'train' THEN 'before' ELSE 'after' END AS stage FROM rec")
def predictions_written(spark, d):
    """Prediction rows, one folder per stage."""
    folder = _folder(spark, "predictions")
    rows = records(spark, d).select("row_idx", "dataset", "y", "p", F.when(F.col("part") == "train", "before").otherwise("after").alias("stage"))
    sinks.write_predictions(rows, folder, "stage")
    return spark.read.schema("row_idx BIGINT, dataset STRING, y DOUBLE, p DOUBLE, stage STRING").json(folder)


@query("SELECT vec_id // 5 AS row_idx, string_agg(vec_id || '=' || label, ' ' ORDER BY vec_id) AS weights FROM embeddings GROUP BY ALL")
def token_weights_written(spark, d):
    """Weights of every token of a record (here its label), as a list per record."""
    folder = _folder(spark, "weights")
    tokens = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("row_idx"), F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("token"), F.col("label").cast("double").alias("alpha"))
    sinks.write_token_weights(vectors.token_weights(tokens, ["row_idx"]), folder)
    back = spark.read.schema("row_idx BIGINT, weights ARRAY<STRUCT<pos: BIGINT, token: STRING, weight: DOUBLE>>").json(folder)
    return back.select("row_idx", F.array_join(F.transform("weights", lambda w: F.concat(w["token"], F.lit("="), w["weight"].cast("bigint").cast("string"))), " ").alias("weights"))


# ---- regression on vectors (no SQL: iterative or linear-algebra results)


def _regression_rows(spark, d):
    """A record per vector with its customer order as target; two properties."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("pooled"), "label")
    o = records(spark, d).select("row_idx", "article_key", "y", "part")
    return v.join(o, "row_idx").withColumns({"dataset": F.when(F.col("label") < 5, "low").otherwise("high"), "transform": F.lit("identity")})


#: Vectors with their targets; `part` and `dataset` as in `_regression_rows`.
_VECTORS = f"""{REC}, v AS (SELECT rec.row_idx, article_key, y, part, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS dataset,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings JOIN rec ON vec_id = row_idx)"""


def _normal_equations(keys: str, train: str, ridges: str) -> str:
    """CTEs that fit ``train`` (``keys``, x, scaled target t) by the normal equations of all coordinates, solved by elimination.

    Ends in ``fit``: keys, ridge, w, b.
    """
    return f"""tr AS ({train}), co AS (SELECT {keys}, id, t, j, x[j] AS xj FROM (SELECT *, row_number() OVER () AS id FROM tr), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM tr))) AS j)),
mo AS (SELECT {keys}, j, avg(xj) AS m, stddev_pop(xj) AS s, covar_pop(xj, t) / stddev_pop(xj) AS c, avg(t) AS tm FROM co GROUP BY {keys}, j),
cr AS (SELECT {keys}, j, list(r ORDER BY j2) AS r FROM (SELECT {keys}, a.j, b.j AS j2, corr(a.xj, b.xj) AS r FROM co a JOIN co b USING ({keys}, id) GROUP BY {keys}, a.j, b.j) GROUP BY {keys}, j),
st AS (SELECT {keys}, ridge, list(list_append(list_transform(r, lambda e, i: e + CASE WHEN i = j THEN ridge ELSE 0 END), c) ORDER BY j) AS a
  FROM cr JOIN mo USING ({keys}, j), (SELECT unnest({ridges}) AS ridge) GROUP BY {keys}, ridge),
gj AS (SELECT {keys}, ridge, 1 AS k, a FROM st UNION ALL SELECT {keys}, ridge, k + 1, list_transform(a, lambda e, i: CASE WHEN i = k
  THEN list_transform(e, lambda z: z / a[k][k]) ELSE list_transform(e, lambda z, q: z - e[k] * a[k][q] / a[k][k]) END) FROM gj WHERE k <= len(a)),
fi AS (SELECT {keys}, ridge, j, a[j][len(a) + 1] / s AS w, m, tm FROM gj JOIN mo USING ({keys}) WHERE k = len(a) + 1),
fit AS (SELECT {keys}, ridge, list(w ORDER BY j) AS w, any_value(tm) - sum(w * m) AS b FROM fi GROUP BY {keys}, ridge)"""


_SCALED = "SELECT 0 AS f, x, (y - mean) / scale AS t FROM v JOIN sc USING (dataset) WHERE part = 'train'"
_SCALERS = "sc AS (SELECT dataset, avg(y) AS mean, stddev_pop(y) AS scale FROM v WHERE part = 'train' GROUP BY dataset)"
_SCORED = "(list_dot_product(x, w) + b) * scale + mean"
_METRICS = f"count(*) AS n, {R('1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*))')} AS r2, {R('sqrt(avg((y-p)*(y-p)))')} AS rmse, {R('avg(abs(y-p))')} AS mae"


@query(
    f"""WITH RECURSIVE {_VECTORS}, {_SCALERS}, {_normal_equations('f', _SCALED, '[0.01::DOUBLE, 0.1, 1.0]')},
pr AS (SELECT ridge, y, {_SCORED} AS p FROM v JOIN sc USING (dataset), fit WHERE part = 'val')
SELECT (CASE ridge WHEN 0.01 THEN 0 WHEN 0.1 THEN 1 ELSE 2 END)::INT AS trial, ridge, {_METRICS} FROM pr GROUP BY ridge"""
)
def ridge_sweep(spark, d):
    """Validation metrics of three ridge settings from one statistic of the training rows."""
    rows = settle(_regression_rows(spark, d), "regression")
    return rounded(regress.sweep(rows, ["dataset"], [0.01, 0.1, 1.0]), "r2", "rmse", "mae")


@query(
    f"""WITH RECURSIVE {_VECTORS}, {_SCALERS}, {_normal_equations('f', _SCALED, '[0.1::DOUBLE]')},
pr AS (SELECT dataset, article_key, y, {_SCORED} AS p FROM v JOIN sc USING (dataset), fit WHERE part = 'test'),
rg AS (SELECT dataset, article_key, min(y) AS lo, max(y) AS hi FROM v WHERE part = 'train' GROUP BY ALL HAVING min(y) < max(y)),
hits AS (SELECT dataset, count(*) AS eligible, {R('avg((p BETWEEN lo AND hi)::INT)')} AS hit_rate, {R('avg(exp(-((p - (lo+hi)/2) * (p - (lo+hi)/2)) / (2 * ((hi-lo)/2) * ((hi-lo)/2))))')} AS nars
  FROM pr JOIN rg USING (dataset, article_key) GROUP BY dataset)
SELECT m.*, coalesce(eligible, 0) AS eligible, coalesce(hit_rate, 'nan'::DOUBLE) AS hit_rate, coalesce(nars, 'nan'::DOUBLE) AS nars
FROM (SELECT dataset, {_METRICS} FROM pr GROUP BY dataset) m LEFT JOIN hits USING (dataset)"""
)
def joint_ridge_fit(spark, d):
    """One fit over two properties, each with its own scaler; test metrics, hit rate and NARS per property."""
    rows = settle(_regression_rows(spark, d), "regression")
    fitted = regress.fit_predict(rows, ["dataset"], 0.1)
    out = regress.evaluate(fitted.filter("part = 'test'"), rows.filter("part = 'train'"), ["dataset"])
    return rounded(out, "r2", "rmse", "mae", "hit_rate", "nars")


@query(
    f"""WITH RECURSIVE {_VECTORS}, u AS (SELECT *, ('0x' || substr(md5('7:fraction:' || row_idx), 1, 13))::BIGINT / 4503599627370496.0 * 100 AS u FROM v WHERE part = 'train'),
su AS (SELECT dataset, pct, x, y FROM u, (SELECT unnest([40, 70, 100])::INT AS pct) WHERE u < pct),
sc AS (SELECT dataset, pct, avg(y) AS mean, stddev_pop(y) AS scale, count(*) AS n_train FROM su GROUP BY ALL),
{_normal_equations('dataset, pct', 'SELECT dataset, pct, x, (y - mean) / scale AS t FROM su JOIN sc USING (dataset, pct)', '[0.5::DOUBLE, 2.0]')},
pr AS (SELECT dataset, pct, ridge, n_train, y, {_SCORED} AS p FROM v JOIN sc USING (dataset) JOIN fit USING (dataset, pct) WHERE part = 'val')
SELECT dataset, pct, (CASE ridge WHEN 0.5 THEN 0 ELSE 1 END)::INT AS trial, ridge, n_train, {_METRICS} FROM pr GROUP BY dataset, pct, ridge, n_train"""
)
def fraction_sweep(spark, d):
    """Every property on nested training subsets under two ridge settings, from one pass over the training rows."""
    rows = settle(_regression_rows(spark, d), "regression")
    out = regress.fraction_sweep(rows, ["dataset"], ["row_idx"], 7, [40, 70, 100], [0.5, 2.0])
    return rounded(out, "r2", "rmse", "mae")


@query(
    f"""WITH RECURSIVE {_VECTORS}, tn AS (SELECT stage, x, y FROM v, (SELECT unnest(['before', 'after']) AS stage) WHERE part = 'train' AND (dataset = 'low' OR stage = 'after')),
sc AS (SELECT stage, avg(y) AS mean, stddev_pop(y) AS scale FROM tn GROUP BY stage),
{_normal_equations('stage', 'SELECT stage, x, (y - mean) / scale AS t FROM tn JOIN sc USING (stage)', '[0.1::DOUBLE]')},
pr AS (SELECT stage, y, {_SCORED} AS p FROM v, sc JOIN fit USING (stage) WHERE part = 'test' AND dataset = 'high'),
ms AS (SELECT stage, 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae FROM pr GROUP BY stage),
al AS (SELECT * FROM ms UNION ALL SELECT 'improvement', a.r2 - b.r2, b.rmse - a.rmse, b.mae - a.mae FROM ms a, ms b WHERE a.stage = 'after' AND b.stage = 'before')
SELECT stage, {R('r2')} AS r2, {R('rmse')} AS rmse, {R('mae')} AS mae FROM al"""
)
def domain_tuning(spark, d):
    """Before / after: a fit on one domain scored on the other, then on both; with the improvement row."""
    rows = settle(_regression_rows(spark, d), "regression")
    out = regress.tune_domain(rows, F.col("dataset") == "low", F.col("dataset") == "high", 0.1)
    return rounded(out, "r2", "rmse", "mae")


@query("SELECT vec_id AS row_idx, (round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + 1e-7, 4) + 0) AS p FROM embeddings")
def batch_scores(spark, d):
    """A user's scorer over Arrow batches (here the sum of the vector)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").cast("array<double>").alias("vec"))

    def make_scorer():
        return lambda vecs: [float(sum(v)) for v in vecs]

    return regress.score_batches(e, ["row_idx"], "vec", make_scorer, "p").withColumn("p", rnd("p"))


# ---- streaming


@query(
    f"""WITH {ERRORS} SELECT row_idx, CASE row_idx % 23 WHEN 5 THEN 'no_data' WHEN 6 THEN 'failed' ELSE CASE WHEN errors = [] THEN 'extracted' ELSE 'format_errors' END END AS route,
 CASE WHEN row_idx % 23 NOT IN (5, 6) THEN len(errors)::INT END AS n_errors FROM chk"""
)
def streamed_validation(spark, d):
    """Responses arriving as files, parsed, validated and routed by a stream; run twice over a growing folder, each comes out once. Some are
    empty answers, some do not parse."""
    root = f"{shared_dir(spark).rstrip('/')}/litprops-stream-{uuid.uuid4().hex}"
    inbox, out, checkpoint = (os.path.join(root, p) for p in ("inbox", "out", "checkpoint"))
    kind = F.col("row_idx") % 23
    content = F.when(kind == 5, "[]").when(kind == 6, "no answer").otherwise(F.concat(F.lit("[ "), F.col("entry_text"), F.lit(" ]")))
    rows = entry_json(spark, d).select(F.col("row_idx").cast("string").alias("filename"), content.alias("content"), F.lit("").alias("reasoning"))
    late = F.col("filename").cast("bigint") % 2 == 1
    for arrived in (rows.filter(~late), rows.filter(late)):
        arrived.write.mode("append").parquet(inbox)
        ingest.run_routed(ingest.stream_responses(spark, inbox), "price", out, checkpoint)
    back = spark.read.schema("filename STRING, pos INT, entry STRING, errors ARRAY<STRING>, is_valid BOOLEAN, route STRING, batch_id BIGINT").parquet(out)
    return back.select(F.col("filename").cast("bigint").alias("row_idx"), "route", F.when(F.col("errors").isNotNull(), F.size("errors")).alias("n_errors"))


@query(f"WITH {ERRORS} SELECT o_orderpriority, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid FROM chk JOIN orders ON o_orderkey = row_idx GROUP BY 1")
def routed_files(spark, d):
    """Valid and error rows written to two outputs, then counted from what was written."""
    folder = f"{shared_dir(spark).rstrip('/')}/litprops-routed-{uuid.uuid4().hex}"
    entries = entry_json(spark, d).select("row_idx", F.col("o_orderpriority").alias("filename"), F.try_parse_json("entry_text").alias("entry"))
    sinks.write_routed(validate.validate(entries, "entry", "price"), folder)
    back = spark.read.schema("source_file STRING, route STRING").json(folder)
    return back.groupBy(F.col("source_file").alias("o_orderpriority")).agg(F.count_if(F.col("route") == "extracted").alias("valid"), F.count_if(F.col("route") == "format_errors").alias("invalid"))
