"""Datasets, article keys, splits and the article-memorisation baseline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litprops.functions.text import dataset_name
from litprops.operators import articles, baseline, curation, splits
from litprops.operators.spread import contiguous_index
from litprops.plans.jobs import memorisation_baseline
from litprops.sources.records import domain_test_files
from workload.bindings import REC, SPLIT, records, split
from workload.registry import R, query, rounded, table

METRICS = f"""CASE WHEN count(*) < 2 THEN 'NaN'::DOUBLE WHEN max(y) = min(y) THEN CASE WHEN sum((y-p)*(y-p)) = 0 THEN 1.0 ELSE 0.0 END
      ELSE {R("1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*))")} END AS r2,
    CASE WHEN count(*) < 2 THEN 'NaN'::DOUBLE ELSE {R("sqrt(avg((y-p)*(y-p)))")} END AS rmse,
    CASE WHEN count(*) < 2 THEN 'NaN'::DOUBLE ELSE {R("avg(abs(y-p))")} END AS mae"""

_BASE = f"""WITH {SPLIT},
g AS (SELECT s.dataset, s.split_name, s.part, r.article_key, r.y FROM split s JOIN rec r USING (dataset, row_idx)),
art AS (SELECT dataset, split_name, article_key, avg(y) AS mean, median(y) AS median FROM g WHERE part = 'train' GROUP BY ALL),
whole AS (SELECT dataset, split_name, avg(y) AS mean, median(y) AS median, count(*) AS n_train FROM g WHERE part = 'train' GROUP BY ALL),
pred AS (SELECT g.dataset, g.split_name, w.n_train, g.y, coalesce(a.mean, w.mean) AS pm, coalesce(a.median, w.median) AS pd
  FROM g JOIN whole w USING (dataset, split_name) LEFT JOIN art a USING (dataset, split_name, article_key) WHERE g.part = 'test'),
long AS (SELECT dataset, split_name, n_train, 'mean' AS strategy, y, pm AS p FROM pred UNION ALL SELECT dataset, split_name, n_train, 'median', y, pd FROM pred),
res AS (SELECT dataset, split_name, strategy, n_train, count(*) AS n_test, {METRICS} FROM long GROUP BY dataset, split_name, strategy, n_train)"""


@query(_BASE + " SELECT * FROM res")
def article_baseline(spark, d):
    """Baseline of every dataset and split, both strategies."""
    out = memorisation_baseline(records(spark, d).select("dataset", "row_idx", "article_key", "y"), split(spark, d))
    return rounded(out, "r2", "rmse", "mae")


@query(
    _BASE
    + """ SELECT m.dataset, m.split_name, CASE WHEN d.r2 > m.r2 THEN 'median' ELSE 'mean' END AS best_strategy, m.n_train, m.n_test,
 CASE WHEN d.r2 > m.r2 THEN d.r2 ELSE m.r2 END AS r2, CASE WHEN d.r2 > m.r2 THEN d.rmse ELSE m.rmse END AS rmse, CASE WHEN d.r2 > m.r2 THEN d.mae ELSE m.mae END AS mae
 FROM res m JOIN res d USING (dataset, split_name) WHERE m.strategy = 'mean' AND d.strategy = 'median'"""
)
def baseline_best_strategy(spark, d):
    return baseline.best_strategy(article_baseline(spark, d))


@query(
    f"""WITH {REC}, reg AS (SELECT c_custkey AS article_key, r_name AS test_file FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tr AS (SELECT * FROM rec WHERE part = 'train'), art AS (SELECT dataset, article_key, avg(y) AS mean, median(y) AS median FROM tr GROUP BY ALL),
whole AS (SELECT dataset, avg(y) AS mean, median(y) AS median, count(*) AS n_train FROM tr GROUP BY dataset),
pred AS (SELECT rec.dataset, test_file, n_train, y, coalesce(a.mean, w.mean) AS pm, coalesce(a.median, w.median) AS pd FROM rec JOIN reg USING (article_key)
  JOIN whole w USING (dataset) LEFT JOIN art a USING (dataset, article_key) WHERE part = 'test'),
long AS (SELECT dataset, test_file, n_train, 'mean' AS strategy, y, pm AS p FROM pred UNION ALL SELECT dataset, test_file, n_train, 'median', y, pd FROM pred)
SELECT dataset, test_file, strategy, n_train, count(*) AS n_test, {METRICS} FROM long GROUP BY dataset, test_file, strategy, n_train"""
)
def domain_baseline(spark, d):
    """One training pool per dataset, one test file per region."""
    region = (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("article_key"), F.col("r_name").alias("test_file"))
    )
    r = records(spark, d)
    test = r.filter("part = 'test'").join(region, "article_key").select("dataset", "test_file", "article_key", "y")
    train = r.filter("part = 'train'").select("dataset", "article_key", "y")
    out = baseline.pool_baseline(train, test, ["dataset", "test_file"], ["dataset"])
    return rounded(out, "r2", "rmse", "mae")


_PROPS = "STRUCT<properties MAP<STRING, STRUCT<value ARRAY<DOUBLE>, unit STRING>>>"


def _property_maps(spark, d):
    """Records whose JSON holds an empty property first, then the price; one dataset uses its own name as key."""
    key = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).otherwise("price")
    raw = F.concat(
        F.lit('{"properties":{"none":{"unit":null},"'), key, F.lit('":{"value":['), F.format_string("%.2f", "o_totalprice"), F.lit(',1],"unit":null}}}')
    )
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_idx"), F.col("o_orderpriority").alias("dataset"), key.alias("prop"), F.from_json(raw, _PROPS)["properties"].alias("properties")
    )


@query("SELECT o_orderkey AS row_idx, o_totalprice AS y, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS price FROM orders")
def target_extraction(spark, d):
    """First value of the target property; a property a record lacks is NULL."""
    return _property_maps(spark, d).select(
        "row_idx", curation.target_value(F.col("properties"), F.col("prop"), strict=True).alias("y"), curation.target_value(F.col("properties"), "price").alias("price")
    )


@query("SELECT DISTINCT o_orderpriority AS dataset, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority ELSE 'price' END AS property FROM orders")
def property_inference(spark, d):
    """The property a dataset is about, from its first record."""
    first = _property_maps(spark, d).groupBy("dataset").agg(F.min_by("properties", "row_idx").alias("m"))
    own = F.when(F.map_contains_key("m", F.col("dataset")), F.col("dataset"))
    return first.select("dataset", F.coalesce(own, curation.infer_property(F.col("m"), "orders")).alias("property"))


@query(
    """WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'val_' || lang || '_' || doc_id WHEN 1 THEN lang || '_train' WHEN 2 THEN 'val_' || lang || '_article_' || doc_id || '_test' ELSE lang END AS stem, lang FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN lang || '_train' WHEN 2 THEN lang || '_article_' || doc_id || '_test' ELSE lang END AS plain,
 CASE doc_id % 4 WHEN 2 THEN lang || '_article' ELSE lang END AS without_part FROM f"""
)
def dataset_from_file_name(spark, d):
    k, lang = F.col("doc_id"), F.col("lang")
    stem = (
        F.when(k % 4 == 0, F.concat(F.lit("val_"), lang, F.lit("_"), k.cast("string")))
        .when(k % 4 == 1, F.concat(lang, F.lit("_train")))
        .when(k % 4 == 2, F.concat(F.lit("val_"), lang, F.lit("_article_"), k.cast("string"), F.lit("_test")))
        .otherwise(lang)
    )
    path = F.concat(F.lit("/data/x.y/"), stem, F.lit(".json"))
    return table(spark, d, "documents").select("doc_id", dataset_name(path).alias("plain"), dataset_name(path, True).alias("without_part"))


def _papers(spark, d):
    """Records with messy identifiers: mixed case, blanks, missing DOI, missing title, both missing."""
    k, a = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    doi = F.when(k % 5 == 0, F.concat(F.lit(" 10.1/AbC"), a, F.lit("\t"))).when(k % 5 == 1, F.concat(F.lit("10.1/abc"), a)).when(k % 5 == 2, F.lit("  "))
    title = F.when(k % 5 != 4, F.concat(F.lit(" Paper "), a, F.lit("\n"))).otherwise(F.lit(""))
    return table(spark, d, "orders").select(k.alias("row_idx"), doi.alias("doi"), title.alias("title"))


_PAPERS = """papers AS (SELECT o_orderkey AS row_idx, CASE o_orderkey % 5 WHEN 0 THEN '10.1/abc' || o_custkey WHEN 1 THEN '10.1/abc' || o_custkey END AS doi,
  CASE WHEN o_orderkey % 5 <> 4 THEN 'Paper ' || o_custkey END AS title FROM orders)"""


@query(
    f"""WITH {_PAPERS} SELECT by_doi, by_title, count(*) AS n FROM (SELECT coalesce('doi:' || doi, 'title:' || title) AS by_doi, 'title:' || title AS by_title FROM papers) GROUP BY ALL"""
)
def baseline_article_keys(spark, d):
    keyed = _papers(spark, d).select(articles.baseline_key().alias("by_doi"), articles.baseline_key(mode="title").alias("by_title"))
    return keyed.groupBy("by_doi", "by_title").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_PAPERS}, k AS (SELECT row_idx, coalesce(doi, title, '__singleton_' || row_idx || '__') AS article_key FROM papers),
f AS (SELECT article_key, row_number() OVER (ORDER BY min(row_idx)) - 1 AS article_id FROM k GROUP BY article_key)
SELECT row_idx, article_key, article_id FROM k JOIN f USING (article_key)"""
)
def article_numbers(spark, d):
    """Training-flavour keys numbered by first appearance; records without any identifier stand alone."""
    keyed = _papers(spark, d).select("row_idx", articles.training_key().alias("article_key"))
    return articles.article_ids(keyed, "article_key").select("row_idx", "article_key", "article_id")


@query(f"WITH {SPLIT} SELECT s.dataset, s.split_name, s.part, s.pos, s.row_idx, r.y FROM split s JOIN rec r USING (dataset, row_idx)")
def split_gather(spark, d):
    rows = splits.gather(records(spark, d).select("dataset", "row_idx", "y"), split(spark, d))
    return rows.select("dataset", "split_name", "part", "pos", "row_idx", "y")


@query("SELECT l_orderkey + 5 AS row_idx, count(*) AS times FROM lineitem WHERE l_orderkey + 5 NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def split_out_of_range(spark, d):
    """Index rows that point outside the dataset."""
    wanted = table(spark, d, "lineitem").select(F.lit("orders").alias("dataset"), (F.col("l_orderkey") + 5).alias("row_idx"))
    have = table(spark, d, "orders").select(F.lit("orders").alias("dataset"), F.col("o_orderkey").alias("row_idx"))
    return splits.missing_rows(have, wanted).groupBy("row_idx").agg(F.count(F.lit(1)).alias("times"))


@query(
    f"WITH {SPLIT} SELECT dataset, split_name, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val, count(*) FILTER (part = 'test') AS test, count(*) AS total FROM split GROUP BY ALL"
)
def split_sizes(spark, d):
    return splits.sizes(split(spark, d))


@query(
    f"""WITH {SPLIT}, l AS (SELECT dataset, split_name, part, list(row_idx ORDER BY row_idx) AS rows FROM split GROUP BY ALL)
SELECT dataset, split_name, part, unnest(rows) AS row_idx, generate_subscripts(rows, 1) - 1 AS pos FROM l"""
)
def split_positions(spark, d):
    """Positions inside each part, as in an index list: a prefix count per (dataset, split, part), no group on one task."""
    rows = split(spark, d).drop("pos")
    return contiguous_index(rows, "row_idx", "pos", ["dataset", "split_name", "part"])


@query("SELECT DISTINCT 'val_' || lang || '_' || doc_id || '.json' AS file_name FROM documents WHERE lang = 'en' AND doc_id % 2 = 0")
def domain_files(spark, d):
    """Held-out files of one domain: ``val_en_7.json`` but never ``val_en_article_7.json``."""
    k = F.col("doc_id")
    name = F.concat(F.lit("val_"), F.col("lang"), F.when(k % 2 == 0, "_").otherwise("_article_"), k.cast("string"), F.lit(".json"))
    return domain_test_files(table(spark, d, "documents").select(name.alias("file_name")).distinct(), "en")


@query(
    """WITH n AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'split_random' || CASE WHEN o_custkey % 5 = 4 THEN '' ELSE '_' || (o_custkey % 5 + 1) * 20 || 'pct' END
  WHEN 1 THEN 'split_article' || CASE WHEN o_custkey % 5 = 4 THEN '' ELSE '_' || (o_custkey % 5 + 1) * 20 || 'pct' END
  WHEN 2 THEN 'continue_train__' || o_orderpriority ELSE o_orderstatus END AS split_name, o_orderkey % 4 AS k, o_custkey % 5 AS c, o_orderkey % 4 >= 2 AS named FROM orders),
u AS (SELECT split_name, min(k) AS k, min(CASE WHEN named THEN 0 ELSE c END) AS c, bool_and(named) AS named FROM n GROUP BY split_name)
SELECT split_name, row_number() OVER (ORDER BY k, c, CASE WHEN named THEN split_name ELSE '' END) AS position FROM u"""
)
def split_order(spark, d):
    """Semantic order of split names: random fractions, article fractions, domains, others."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 5
    pct = F.when(c == 4, "").otherwise(F.concat(F.lit("_"), ((c + 1) * 20).cast("string"), F.lit("pct")))
    name = (
        F.when(k == 0, F.concat(F.lit("split_random"), pct))
        .when(k == 1, F.concat(F.lit("split_article"), pct))
        .when(k == 2, F.concat(F.lit("continue_train__"), F.col("o_orderpriority")))
        .otherwise(F.col("o_orderstatus"))
    )
    names = table(spark, d, "orders").select(name.alias("split_name")).distinct()  # a handful of names: one small window
    return names.select("split_name", F.row_number().over(Window.orderBy(*splits.split_rank("split_name"))).cast("bigint").alias("position"))
