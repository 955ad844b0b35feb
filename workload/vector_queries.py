"""Token vectors: pooling, normalisation, padding, caches, stream joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from litprops.functions import arrays as A
from litprops.operators import assemble, batches, vectors
from litprops.operators.spread import running_total
from litprops.session import shared_dir
from litprops.sources import vector_cache as cache
from workload.bindings import tokens
from workload.registry import R, query, rnd, table

# Fixed weights of the scoring layer: two hidden units over the first coordinates, the rest zero.
_W1 = [[1.0, -2.0] + [0.0] * 62, [0.5, 0.25, 3.0] + [0.0] * 61]
_B1, _W2, _B2 = [0.1, -0.2], [1.5, -0.75], 0.3
_SCORE = "(1.5 * tanh(1.0 * v[1] - 2.0 * v[2] + 0.1) - 0.75 * tanh(0.5 * v[1] + 0.25 * v[2] + 3.0 * v[3] - 0.2) + 0.3)"

_TOK = "tok AS (SELECT label::BIGINT AS row_idx, vec_id AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS v, (vec_id % 5 <> 0)::INT AS mask FROM embeddings)"
_EXP = "ex AS (SELECT row_idx, pos, mask, unnest(v) AS x, unnest(range(64)) AS dim FROM tok)"


def _long(df, digits: int = 4):
    return df.select("row_idx", F.posexplode("pooled").alias("dim", "value")).select("row_idx", F.col("dim").cast("bigint").alias("dim"), rnd("value", digits).alias("value"))


def _score():
    return vectors.gate_score(F.col("vec"), _W1, _B1, _W2, _B2)


@query(f"WITH {_TOK}, {_EXP} SELECT row_idx, dim, {R('sum(x * mask) / greatest(sum(mask), 1)')} AS value FROM ex GROUP BY row_idx, dim")
def mean_pooling(spark, d):
    return _long(vectors.pool("mean_pooling", tokens(spark, d), ["row_idx"], mask="mask"))


@query(f"WITH {_TOK}, {_EXP} SELECT row_idx, dim, {R('sum(x * mask)')} AS value FROM ex GROUP BY row_idx, dim")
def sum_pooling(spark, d):
    return _long(vectors.pool("sum_pooling", tokens(spark, d), ["row_idx"], mask="mask"))


@query(f"WITH {_TOK}, {_EXP}, l AS (SELECT row_idx, max(pos) FILTER (mask = 1) AS pos FROM tok GROUP BY row_idx) SELECT row_idx, dim, {R('x')} AS value FROM ex JOIN l USING (row_idx, pos)")
def last_token_pooling(spark, d):
    return _long(vectors.pool("last_token", tokens(spark, d), ["row_idx"], mask="mask"))


@query(
    f"""WITH {_TOK}, s AS (SELECT row_idx, pos, exp({_SCORE}) * mask AS e FROM tok), {_EXP} SELECT row_idx, dim, {R('sum(x * e) / sum(e)')} AS value FROM ex JOIN s USING (row_idx, pos) GROUP BY row_idx, dim"""
)
def attention_pooling(spark, d):
    return _long(vectors.pool("attention_pooling", tokens(spark, d), ["row_idx"], score=_score(), bound=vectors.score_bound(_W2, _B2), mask="mask"))


@query(f"WITH {_TOK}, s AS (SELECT row_idx, pos, mask / (1 + exp(-{_SCORE})) AS g FROM tok), {_EXP} SELECT row_idx, dim, {R('sum(x * g)')} AS value FROM ex JOIN s USING (row_idx, pos) GROUP BY row_idx, dim")
def sigmoid_pooling(spark, d):
    return _long(vectors.pool("sigmoid_pooling", tokens(spark, d), ["row_idx"], score=_score(), mask="mask"))


@query(f"WITH {_TOK}, s AS (SELECT row_idx, pos, exp({_SCORE}) * mask AS e FROM tok) SELECT row_idx, pos, {R('e / sum(e) OVER (PARTITION BY row_idx)')} AS alpha FROM s")
def attention_weights(spark, d):
    """The weight of every token."""
    out = vectors.attention_weights(tokens(spark, d), ["row_idx"], _score(), vectors.score_bound(_W2, _B2), "mask")
    return out.select("row_idx", "pos", rnd("alpha").alias("alpha"))


@query(
    f"""WITH {_TOK}, {_EXP}, n AS (SELECT pos, avg(x) AS m, sqrt(var_pop(x) + 1e-5) AS s FROM ex GROUP BY pos) SELECT row_idx, pos, dim, {R('(x - m) / s')} AS value FROM ex JOIN n USING (pos)"""
)
def layer_norm(spark, d):
    n = vectors.normalise_tokens(tokens(spark, d))
    return n.select("row_idx", "pos", F.posexplode("vec").alias("dim", "value")).select("row_idx", "pos", F.col("dim").cast("bigint").alias("dim"), rnd("value").alias("value"))


@query(
    f"""WITH {_TOK}, {_EXP}, n AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM ex GROUP BY dim) SELECT pos, dim, {R('(x - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS value FROM ex JOIN n USING (dim)"""
)
def standardise_columns(spark, d):
    """Column-wise standardisation over all vectors."""
    n = vectors.standardise(tokens(spark, d), ["dataset"])
    return n.select("pos", F.posexplode("vec").alias("dim", "value")).select("pos", F.col("dim").cast("bigint").alias("dim"), rnd("value").alias("value"))


@query(
    """WITH rag AS (SELECT (vec_id + vec_id // 5 * 3) // 7 AS row_idx, count(*) AS n FROM embeddings GROUP BY ALL), b AS (SELECT *, row_idx // 10 AS batch_id FROM rag)
SELECT row_idx, batch_id, n::INT AS real, max(n) OVER (PARTITION BY batch_id)::INT AS width, (max(n) OVER (PARTITION BY batch_id) - n)::INT AS padding FROM b"""
)
def pad_batches(spark, d):
    """Records of uneven length padded to the longest of their batch, with a mask."""
    k = F.col("vec_id")
    t = table(spark, d, "embeddings").select(F.floor((k + F.floor(k / 5) * 3) / 7).alias("row_idx"), k.alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))
    rag = cache.ragged(t, ["row_idx"]).withColumn("batch_id", F.floor(F.col("row_idx") / 10))
    p = vectors.pad_batch(rag, ["batch_id"])
    real = F.aggregate("mask", F.lit(0), lambda s, x: s + x)
    zero = F.size(F.filter("tokens", lambda v: F.forall(v, lambda x: x == 0)))
    return p.select("row_idx", "batch_id", real.alias("real"), F.size("tokens").alias("width"), zero.alias("padding"))


@query(
    """WITH l AS (SELECT doc_id // 50 AS batch_id, doc_id, n_chars FROM documents) SELECT doc_id, batch_id, n_chars, max(n_chars) OVER (PARTITION BY batch_id) AS max_len FROM l"""
)
def batch_max_length(spark, d):
    docs = table(spark, d, "documents").select("doc_id", batches.fixed_batches("doc_id", 50).alias("batch_id"), "n_chars")
    return batches.batch_max(docs, "n_chars", ["batch_id"])


@query(
    """SELECT doc_id, lang, (sum(n_chars) OVER w - n_chars)::BIGINT AS "start", (sum(n_chars) OVER w)::BIGINT AS "end" FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)"""
)
def ragged_offsets(spark, d):
    """Running (start, end) of text lengths per language, without one task per language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    out = running_total(docs, "doc_id", "n_chars", "end", ["lang"])
    return out.select("doc_id", "lang", (F.col("end") - F.col("n_chars")).alias("start"), "end")


@query("SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id))::BIGINT AS \"end\" FROM documents")
def global_offsets(spark, d):
    """The same over the whole table: no partition key, still no single-task window over rows."""
    return running_total(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", "end").select("doc_id", "end")


@query(
    r"""WITH w AS (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')) AS n FROM documents) SELECT lang, count(*) AS records, sum(n)::BIGINT AS n_tokens, max(n)::BIGINT AS longest FROM w GROUP BY lang"""
)
def token_counts(spark, d):
    """Tokens per language and the longest text, over whole texts."""
    words = F.filter(F.split("text", "[ \\n]+"), lambda x: x != "")
    t = table(spark, d, "documents").select("lang", F.size(words).cast("bigint").alias("n"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


# ---- caches


def _typed_tokens(spark, d):
    """Token table with two models and one input type; the record is a run of five vectors."""
    return tokens(spark, d, 5).withColumn("input_type", F.lit("1"))


@query(
    """SELECT vec_id // 5 AS row_idx, count(*) AS n_tokens, (round(sum(embedding[1]::DOUBLE) + 1e-7, 4) + 0) AS checksum FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1"""
)
def cache_round_trip(spark, d):
    """Token rows written as a partitioned cache and one cache read back."""
    folder = f"{shared_dir(spark).rstrip('/')}/litprops-cache-{uuid.uuid4().hex}"
    cache.write_cache(_typed_tokens(spark, d).drop("mask"), folder)
    back = cache.read_cache(spark, folder, "orders", "a", "1")
    return back.groupBy("row_idx").agg(F.count(F.lit(1)).alias("n_tokens"), rnd(F.sum(F.col("vec")[0].cast("double"))).alias("checksum"))


@query("SELECT vec_id // 5 AS row_idx, count(*) FILTER (vec_id % 2 = 0) AS a, count(*) FILTER (vec_id % 2 = 1) AS b FROM embeddings GROUP BY 1")
def tokens_per_record(spark, d):
    t = cache.token_counts(_typed_tokens(spark, d), ["row_idx", "model"])
    return t.groupBy("row_idx").agg(
        F.coalesce(F.sum(F.when(F.col("model") == "a", F.col("n_tokens"))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col("model") == "b", F.col("n_tokens"))), F.lit(0)).alias("b"),
    )


@query(
    """WITH e AS (SELECT label::BIGINT AS row_idx, model, input_type FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(['a', 'b', 'c']) AS model), (SELECT unnest(['1', '9']) AS input_type)),
h AS (SELECT DISTINCT label::BIGINT AS row_idx, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, '1' AS input_type FROM embeddings)
SELECT 'orders' AS dataset, * FROM e EXCEPT SELECT 'orders', * FROM h"""
)
def missing_vectors(spark, d):
    """Expected (record, model, input type) that the token table lacks."""
    t = tokens(spark, d).withColumn("input_type", F.lit("1"))
    want = cache.missing_vectors(t.select("dataset", "row_idx").distinct(), t, {"model": ["a", "b", "c"], "input_type": ["1", "9"]})
    return want.select("dataset", "row_idx", "model", "input_type")


@query(
    """WITH n AS (SELECT count(DISTINCT label) AS records FROM embeddings), c AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, count(DISTINCT label) AS cached FROM embeddings GROUP BY 1)
SELECT 'orders' AS dataset, model, records, cached, records = cached AS complete FROM n, c"""
)
def cache_counts(spark, d):
    t = tokens(spark, d)
    out = cache.check_counts(t.select("dataset", "row_idx").distinct(), t, ["dataset", "model"])
    return out.select("dataset", "model", "records", "cached", "complete")


@query(
    f"""WITH {_TOK}, {_EXP}, w AS (SELECT c_custkey % 10 AS row_idx, count(*) AS customers FROM customer GROUP BY 1) SELECT row_idx, customers, dim, {R('avg(x)')} AS value FROM ex JOIN w USING (row_idx) GROUP BY row_idx, customers, dim"""
)
def cache_view(spark, d):
    """Tokens of the wanted rows, checked to be there, then pooled."""
    wanted = table(spark, d, "customer").groupBy((F.col("c_custkey") % 10).alias("row_idx")).agg(F.count(F.lit(1)).alias("customers"))
    seen = cache.view(wanted, tokens(spark, d).drop("model"), ["row_idx"])
    out = vectors.mean_pooling(seen, ["row_idx", "customers"])
    return out.select("row_idx", "customers", F.posexplode("pooled").alias("dim", "value")).select("row_idx", "customers", F.col("dim").cast("bigint").alias("dim"), rnd("value").alias("value"))


# ---- streams


_STREAM = f"""{_TOK}, {_EXP}, txt AS (SELECT row_idx, dim, avg(x) AS x FROM ex WHERE pos % 2 = 0 GROUP BY ALL), str AS (SELECT row_idx, dim, sum(x) AS x FROM ex WHERE pos % 2 = 1 GROUP BY ALL)"""


def _split_rows(spark, d):
    t = tokens(spark, d).select("dataset", "row_idx").distinct()
    part = F.when(F.col("row_idx") % 10 < 7, "train").when(F.col("row_idx") % 10 == 7, "val").otherwise("test")
    return t, t.withColumns({"split_name": F.lit("split_random"), "part": part, "pos": F.col("row_idx")})


@query(
    f"""WITH {_STREAM} SELECT row_idx, CASE WHEN row_idx % 10 < 7 THEN 'train' WHEN row_idx % 10 = 7 THEN 'val' ELSE 'test' END AS part, dim, {R('txt.x')} AS text_value, {R('str.x')} AS struct_value FROM txt JOIN str USING (row_idx, dim)"""
)
def hybrid_inputs(spark, d):
    """Model inputs of a two-stream configuration: both streams pooled, joined per record, tagged with the split part."""
    t = tokens(spark, d)
    records, split = _split_rows(spark, d)
    config = {"stream": "hybrid", "text_pooling": "mean_pooling", "structure_pooling": "sum_pooling"}
    rows = assemble.model_inputs(records, split, config, t.filter("model = 'a'"), t.filter("model = 'b'"))
    both = F.posexplode(F.arrays_zip("text_vec", "struct_vec")).alias("dim", "z")
    return rows.select("row_idx", "part", both).select(
        "row_idx", "part", F.col("dim").cast("bigint").alias("dim"), rnd("z.text_vec").alias("text_value"), rnd("z.struct_vec").alias("struct_value")
    )


@query(f"WITH {_STREAM} SELECT row_idx, dim, {R('str.x')} AS value FROM str WHERE row_idx % 10 >= 8")
def structure_inputs(spark, d):
    """One structure stream, test rows."""
    records, split = _split_rows(spark, d)
    rows = assemble.model_inputs(records, split, {"stream": "structure", "structure_pooling": "sum_pooling"}, None, tokens(spark, d).filter("model = 'b'"))
    return _long(rows.filter("part = 'test'").withColumnRenamed("struct_vec", "pooled"))


@query(f"WITH {_STREAM} SELECT row_idx, dim, {R('0.25 * txt.x + 0.75 * str.x')} AS value FROM txt JOIN str USING (row_idx, dim)")
def blended_streams(spark, d):
    """Gated blend of the two pooled streams for a given gate."""
    t = tokens(spark, d)
    records, split = _split_rows(spark, d)
    rows = assemble.model_inputs(records, split, {"stream": "hybrid", "structure_pooling": "sum_pooling"}, t.filter("model = 'a'"), t.filter("model = 'b'"))
    return _long(rows.withColumn("pooled", A.blend(F.col("text_vec"), F.col("struct_vec"), F.lit(0.25))))


@query(
    """SELECT p_partkey AS row_idx, dim, (round(CASE WHEN dim < 64 THEN coalesce(embedding[dim + 1]::DOUBLE, 0) WHEN p_partkey % 3 = 0 THEN 0 ELSE [p_size, 1][dim - 63] END + 1e-7, 4) + 0)::DOUBLE AS value
FROM part LEFT JOIN embeddings ON vec_id = p_partkey, (SELECT unnest(range(66)) AS dim)"""
)
def ratio_appended(spark, d):
    """Structure vector plus ratio vector per part; a part without vector or ratio gets zeros of full width."""
    part = table(spark, d, "part")
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    ratio = F.when(F.col("p_partkey") % 3 != 0, F.array(F.col("p_size").cast("double"), F.lit(1.0)))
    joined = part.join(vec, "p_partkey", "left")  # one vector per part: unique keys on both sides
    return _long(joined.select(F.col("p_partkey").alias("row_idx"), vectors.append_ratio(F.col("embedding"), ratio, 64, 2).alias("pooled")))


@query(
    f"""WITH {_TOK.replace('label::BIGINT', 'vec_id // 5')}, s AS (SELECT row_idx, pos, exp({_SCORE}) AS e FROM tok), w AS (SELECT row_idx, pos, e / sum(e) OVER (PARTITION BY row_idx) AS a FROM s)
SELECT row_idx, o_totalprice AS prediction, string_agg(pos || ':' || printf('%.3f', a), ' ' ORDER BY pos) AS weights FROM w JOIN orders ON o_orderkey = row_idx GROUP BY ALL"""
)
def token_weight_report(spark, d):
    """Weights beside their tokens and the record's prediction, in token order."""
    t = vectors.attention_weights(_typed_tokens(spark, d), ["row_idx"], _score(), vectors.score_bound(_W2, _B2))
    lists = vectors.token_weights(t.withColumn("token", F.col("pos").cast("string")), ["row_idx"])
    preds = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").alias("prediction"))
    text = F.array_join(F.transform("weights", lambda w: F.concat(w["token"], F.lit(":"), F.format_string("%.3f", w["weight"]))), " ")
    return lists.join(preds, "row_idx").select("row_idx", "prediction", text.alias("weights"))
