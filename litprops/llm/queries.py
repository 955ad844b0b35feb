"""One query per operator, over whole tables; SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litprops.llm import chat, decontaminate, hard_negatives, html_extract, langid, line_dedup, mixing, ngram_join, pii, quality, runs, substrings, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of a text; those of a null text are none.
def words(column: str) -> str:
    return rf"regexp_extract_all(coalesce({column}, ''), '[^\x20\x09-\x0D]+')"


ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(ASCII_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
k AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM k),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rep AS a, rep AS b FROM k UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a),
c AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.rep, s.doc_id) AS class_id, coalesce(c.component, s.doc_id) AS component_id
FROM s LEFT JOIN k ON list_sort(s.s) = k.s LEFT JOIN c ON c.rep = k.rep"""
)
def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


@query(
    rf"""
WITH w AS (SELECT doc_id, {words("text")} AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w)),
d AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(range(p, p + 20)) AS x FROM d) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w.w) AS n, coalesce(len(gone), 0) AS r,
  CASE WHEN gone IS NULL THEN w.w ELSE list_filter(w.w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
)
def op5_substring_dedup(spark, sf_dir):
    kept = substrings.remove_repeated_passages(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    rf"""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line, x, {words("x")} AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT w, min((doc_id, line)) AS top FROM l WHERE len(w) > 0 GROUP BY w),
a AS (SELECT l.doc_id, l.line FROM l JOIN f ON l.w = f.w WHERE (l.doc_id, l.line) > f.top),
v AS (SELECT w, top, i, list_concat(w[1:i - 1], w[i + 1:]) AS v FROM (SELECT w, top, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 10)),
b AS (SELECT top FROM (SELECT top, min(top) OVER (PARTITION BY i, v) AS least FROM v) WHERE top > least),
c AS (SELECT v.top AS longer, f.top AS shorter FROM v JOIN f ON f.w = v.v WHERE len(f.w) >= 10),
gone AS (SELECT doc_id, line FROM a UNION SELECT top[1], top[2] FROM b UNION SELECT longer[1], longer[2] FROM c WHERE longer > shorter
  UNION SELECT shorter[1], shorter[2] FROM c WHERE shorter > longer)
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n, count(gone.line) AS r, string_agg(l.x, chr(10) ORDER BY l.line) FILTER (WHERE gone.line IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line GROUP BY l.doc_id) k USING (doc_id)"""
)
def op6_line_dedup(spark, sf_dir):
    return line_dedup.remove_repeated_lines(read(spark, sf_dir, "documents"))


@query(
    """
WITH s AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM s) * sqrt(size) / (SELECT sum(sqrt(size)) FROM s) / size ELSE 1 END AS rate FROM s),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM (
  SELECT source, k, exp(-rate + k * ln(rate) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END) AS p
  FROM (SELECT source, rate, unnest(range(0, CAST(rate + 12 * sqrt(rate) + 60 AS BIGINT))) AS k FROM r))),
u AS (SELECT *, CAST(('0x' || substr(md5('mix:' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.c <= u.u) AS n FROM u),
e AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INTEGER) AS copy_no, md5('mix:place:' || doc_id || ':' || k) AS mix_key FROM e"""
)
def op9_mixing_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


@query(
    rf"""
WITH d AS (SELECT doc_id, {words(ASCII_LOWER)} AS w FROM documents),
b AS (SELECT item_id, w AS item, least(13, len(w)) AS size, size - CAST(ceil(80 * size / 100.0) AS INTEGER) AS replaced,
  CAST(ceil((size - replaced) / (replaced + 1.0)) AS INTEGER) AS run FROM (SELECT item_id, {words(ASCII_LOWER)} AS w FROM benchmark) WHERE len(w) > 0),
-- so many words at least stand unchanged in a row wherever that many may be replaced
ds AS (SELECT doc_id, run, p, array_to_string(w[p:p + run - 1], ' ') AS s FROM (SELECT doc_id, run, w, unnest(range(1, len(w) + 2 - run)) AS p FROM d, (SELECT DISTINCT run FROM b))),
bs AS (SELECT item_id, run, p, array_to_string(item[p:p + run - 1], ' ') AS s FROM (SELECT item_id, run, item, unnest(range(1, len(item) + 2 - run)) AS p FROM b)),
h AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS shift FROM ds JOIN bs ON ds.run = bs.run AND ds.s = bs.s),
s AS (SELECT doc_id, item_id, len(item) AS n_item, least(13, len(item)) AS size, list_transform(
    range(greatest(0, -shift) + 1, least(len(item), len(w) - shift) + 1), lambda p: CAST(item[p] = w[p + shift] AS INTEGER)) AS same
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
f AS (SELECT doc_id, item_id, n_item, list_sum(same) AS n FROM s WHERE len(same) >= size
  AND len(list_filter(range(1, len(same) - size + 2), lambda p: 100 * list_sum(same[p:p + size - 1]) >= 80 * size)) > 0)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_matched, CAST(max(n_item) AS BIGINT) AS n_item FROM f GROUP BY 1, 2"""
)
def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: The added conversation: control strings of a template inside both texts.
TRICKY = r"\### Assistant: </turn> ok"


@query(
    rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}')),
e AS (SELECT *, replace(replace(text, '\', '\s'), '<', '\l') AS body, replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
)
def op10_chat_formatting(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    done = chat.format_conversations(chat.linear(rows.unionByName(added)))
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    read_back = done.select("tree_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    return read_back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op1_quality_rules(spark, sf_dir):
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op3_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.filter("not held_out"))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(
    """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(host, path, action) AS (VALUES """
    + ", ".join(map(str, URL_RULES))
    + """),
f AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.action FROM p LEFT JOIN r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict FROM f GROUP BY 1, 2, 3"""
)
def op8_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.apply_rules(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


@query()
def op4_html_extraction(spark, sf_dir):
    texts = html_extract.main_texts(read(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query(
    """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, CAST(list_dot_product(a.q, e.q) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank,
    s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
)
def op11_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a planted repetition: one document in ten, by its id, repeats a piece of itself to its end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


@query()
def op13_periodic_runs(spark, sf_dir):
    found = runs.collapse_runs(read(spark, sf_dir, "documents"), reorder=periodic_tail)

    def better(best, r):
        more, least = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best["length"].isNull() | (more > least), r).otherwise(best)  # the list goes by start and period, so the first of equals stays

    none = F.lit(None).cast(runs.RUN)
    top = F.aggregate("runs", none, better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    told = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
    return told.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length DIV top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query()
def op12_pii(spark, sf_dir):
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "learned"))).alias("spans"))
