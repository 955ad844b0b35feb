"""Sources, sinks, streams and the mining jobs on files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from litprops.operators import composition, curation, mining, prompts, regress, validate
from litprops.plans import jobs
from litprops.session import settle, shared_dir
from litprops.sources import records as src
from litprops.sources import sinks
from litprops.sources import vector_cache as cache
from litprops.streaming import ingest
from tests.conftest import rows
from tests.test_validate import GOOD, broken

RECORD = {**GOOD, "title": "T", "analysis_with_hierarchical_structure": None, "properties": {"Tg": {"value": [1.5], "unit": None}}}


def test_record_arrays(spark, tmp_path):
    for name, n in (("val_Tg_1.json", 3), ("Tm.json", 2)):
        (tmp_path / name).write_text(json.dumps([{**RECORD, "doi": f"{name}{i}"} for i in range(n)], indent=2))
    df = src.read_record_arrays(spark, str(tmp_path))
    assert rows(df.select("dataset", "row_idx", "doi"), "dataset", "row_idx") == [("Tg", i, f"val_Tg_1.json{i}") for i in range(3)] + [("Tm", i, f"Tm.json{i}") for i in range(2)]
    assert df.select(curation.target_value(F.col("properties"), "Tg")).distinct().first()[0] == 1.5
    assert df.select(F.col("chemical_composition.monomers")[0]["ratio_value"]).first()[0] == "97-99"
    assert src.read_record_json(spark, str(tmp_path)).count() == 5
    with pytest.raises(Exception, match="no value"):
        df.select(curation.target_value(F.col("properties"), "E", strict=True)).collect()


def test_dataset_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Tg.json").write_text(json.dumps([{**RECORD, "filename": "x"}] * 3))
    df = src.read_record_arrays(spark, str(tmp_path / "in"))
    sinks.write_dataset(df, str(tmp_path / "out"))
    back = src.read_records(spark, str(tmp_path / "out"))
    assert rows(back.select("dataset", "row_idx", "title", "filename"), "row_idx") == [("Tg", i, "T", None) for i in range(3)]


def test_what_the_validator_accepts_survives(spark, tmp_path):
    entries = [broken(["year"], y) for y in (True, 2000.5, None, 1999)]
    for e, amount in zip(entries, ("3 g", 2.5, None, [1])):
        e["chemical_composition"]["additives"] = [{"name": "a", "type": "t", "amount_value": amount, "amount_unit": None}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Tg.json").write_text(json.dumps(entries))
    read = src.read_record_json(spark, str(tmp_path / "in"))
    assert validate.validate(read, "entry", "Tg").filter("is_valid").count() == 4
    sinks.write_dataset(src.read_record_arrays(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    for df in (src.read_record_arrays(spark, str(tmp_path / "in")), src.read_records(spark, str(tmp_path / "out")), validate.typed(read).withColumn("row_idx", F.col("row_idx"))):
        got = rows(df.select("row_idx", F.to_json("year"), F.to_json(F.col("chemical_composition.additives")[0]["amount_value"]), "properties.Tg.value"), "row_idx")
        assert [r[1] if r[1] not in (None, "null") else None for r in got] == ["true", "2000.5", None, "1999"]
        assert [r[2] if r[2] not in (None, "null") else None for r in got] == ['"3 g"', "2.5", None, "[1]"]
        assert all(r[3] == entries[0]["properties"]["Tg"]["value"] for r in got)


def test_markdown_and_file_lists(spark, tmp_path):
    for d, names in (("pdf", ["a.pdf", "b.pdf", "c.d.pdf", "x.txt"]), ("md", ["b.md"])):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(f"# {n}\nbody")
    assert rows(src.read_titles(spark, str(tmp_path / "md"))) == [("b", "b.md")]
    assert rows(src.pending_files(spark, str(tmp_path / "pdf"), str(tmp_path / "md"))) == [("a",), ("c.d",)]


def test_domain_names(spark):
    names = spark.createDataFrame([("val_E_1.json",), ("val_E_article_1.json",), ("val_E_1.json.bak",), ("val_E_x.json",)], "file_name string")
    assert rows(src.domain_test_files(names, "E")) == [("val_E_1.json",)]
    assert src.domain_namespace("E") != src.domain_namespace("E", "val_E_1")


def test_infer_property(spark):
    df = spark.createDataFrame([({"x": (None, "u"), "Tg": ([1.0], None)}, "Tg"), ({"x": (None, "u"), "y": ([1.0], None)}, "Tg"), ({"x": (None, None)}, "Tg")], "m map<string,struct<value array<double>,unit string>>, d string")
    assert [r[0] for r in df.select(curation.infer_property(F.col("m"), "Tg")).collect()] == ["Tg", "y", "Tg"]
    with pytest.raises(Exception, match="exactly one"):
        df.select(curation.infer_property(F.col("m"), "Tg", "unique")).collect()
    with pytest.raises(Exception, match="no property"):
        df.select(curation.infer_property(F.col("m"), "Tg", "strict")).collect()


def test_metric_and_split_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1 + 0.2)], "k string, v double")
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).schema("k string, v double").csv(str(tmp_path / "m")).first()["v"] == 0.1 + 0.2
    split = spark.createDataFrame([("d", "s", "train", 0, 5)], "dataset string, split_name string, part string, pos long, row_idx long")
    sinks.write_splits(split, str(tmp_path / "s"))
    assert src.read_splits(spark, str(tmp_path / "s")).select("dataset", "split_name", "part", "pos", "row_idx").collect() == split.collect()
    sinks.write_predictions(df.withColumn("stage", F.lit("before")), str(tmp_path / "p"), "stage")
    assert os.path.isdir(tmp_path / "p" / "stage=before")


def test_progress(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",)], "filename string")
    for _ in range(2):
        sinks.mark_done(work.limit(1), str(tmp_path))
    done = spark.read.parquet(str(tmp_path / "done"))
    assert done.count() == 2 and mining.pending(work, done, "filename").count() == 1
    assert mining.pending(work, done, "filename", ignore_progress=True).count() == 2


def _model(answers):
    """A user's model: answers by the words it finds in a prompt; the word ``boom`` makes it fail."""

    def make():
        def call(prompts_):
            if any("boom" in p for p in prompts_):
                raise RuntimeError("model down")
            return [(next((a for w, a in answers.items() if w in p), ""), "thought") for p in prompts_]

        return call

    return make


def test_extract_validate_route(spark, tmp_path):
    good, bad = json.dumps(GOOD), json.dumps(broken(["doi"]))
    arts = spark.createDataFrame([("f1", "P-one"), ("f2", "P-two"), ("f3", "P-three"), ("f4", "boom")], "filename string, text string").repartition(4)
    model = _model({"P-one": f"```json\n[{good}, {bad}]\n```", "P-two": "[]", "P-three": "not json"})
    review = _model({"P-one": f"[{good}]", "P-two": ""})
    stage = settle(jobs.extract(arts, "Tg", model, review), "stage")
    got = {r["filename"]: (None if r["final_entries"] is None else len(r["final_entries"]), r["error"]) for r in stage.select("filename", "final_entries", "error").collect()}
    assert got == {"f1": (1, False), "f2": (0, False), "f3": (None, True), "f4": (None, True)}
    assert rows(mining.no_data(stage)) == [("f2",)]
    valid, errors, counters = jobs.validate_and_route(jobs.extract(arts, "Tg", model), "Tg")
    assert valid.count() == 1 and errors.count() == 1 and tuple(counters.first()) == (4, 2, 1, 1, 1)
    sinks.write_trace(stage, str(tmp_path))
    assert spark.read.json(str(tmp_path / "trace")).count() == 4


def test_titles_join_with_heavy_file(spark, heavy):
    recs = spark.createDataFrame([(i, "hot" if i < 20 else f"f{i}") for i in range(25)], "row_idx int, filename string")
    titles = mining.titles(spark.createDataFrame([("hot", "# H"), ("f21", "no")], "filename string, text string"))
    got = mining.add_titles(recs, titles)
    assert got.count() == 25 and got.filter("title = 'H'").count() == 20
    assert tuple(mining.title_coverage(got, []).first()) == (20, 5)
    assert mining.insert_after(got.withColumn("doi", F.lit(1)), "title", "doi").columns[-2:] == ["doi", "title"]


def test_stream_equals_batch(spark, tmp_path):
    good = json.dumps(GOOD)
    inbox, out, check = (str(tmp_path / p) for p in ("inbox", "out", "check"))
    responses = spark.createDataFrame([(f"f{i}", [f"[{good}]", "[{}]", "nothing", "[]", "[1]"][i % 5], "") for i in range(10)], "filename string, content string, reasoning string")
    for part in (responses.limit(4), responses.subtract(responses.limit(4))):
        part.write.mode("append").parquet(inbox)
        for _ in range(2):  # the second run finds nothing new
            ingest.run_routed(ingest.stream_responses(spark, inbox), "Tg", out, check)
    got = spark.read.parquet(out)
    stage = mining.review_override(mining.stage_entries(responses), responses.limit(0).select("filename", F.lit(None).cast("array<variant>").alias("entries"), "reasoning"))
    valid, errors, _ = jobs.validate_and_route(stage, "Tg")
    per = lambda route: rows(got.filter(F.col("route") == route).select("filename", F.array_join("errors", ";")), "filename")
    assert [f for f, _ in per("extracted")] == [r[0] for r in rows(valid.select("filename"), "filename")] == ["f0", "f5"]
    assert per("format_errors") == rows(errors.select("source_file", F.array_join("errors", ";")), "source_file")
    assert per("no_data") == [(r[0], None) for r in rows(mining.no_data(stage), "filename")] == [("f3", None), ("f8", None)]
    assert per("failed") == [(r[0], None) for r in rows(stage.filter("error").select("filename"), "filename")] == [("f2", None), ("f7", None)]


def test_article_stream(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("# A")
    run = lambda: ingest.run_articles(ingest.stream_articles(spark, str(tmp_path / "md")), mining.titles, str(tmp_path / "out"), str(tmp_path / "check"))
    run()
    (tmp_path / "md" / "b.md").write_text("# B")
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("filename", "title"), "filename") == [("a", "A"), ("b", "B")]


def test_prompts_equal_python(spark):
    entry = {
        "chemical_composition": {
            "monomers": [{"name": "é \"q\"", "smiles": "C:C,\\x", "ratio_value": 50, "ratio_unit": None, "extra": [1e7, 1e-5, -2.5e20, 1.5e-7, 12345678.5, 0.0005, 1.0, 10**30, "1.0E7"]}, {"smiles": "1.0E7", "ratio_value": 1e16, "ratio_unit": "a"}],
            "is_homopolymer": True, "z": None,
        },
        "processing_history": "a: b, \"c\"\n", "hierarchical_structure": None, "properties": {"Tg": {"value": [1], "unit": "°C"}},
        "analysis_with_hierarchical_structure": {"descriptive_text": "D", "reasoning_analysis": "R"},
    }
    df = spark.createDataFrame([(json.dumps(entry, ensure_ascii=False),), (json.dumps({"properties": {}}),)], "e string").select("e", F.lit("Tg").alias("p"))
    dump = lambda d: json.dumps(d, ensure_ascii=False)
    body = {k: entry[k] for k in ("chemical_composition", "processing_history", "hierarchical_structure")}
    small = {"chemical_composition": {"monomers": [{k: m[k] for k in ("smiles", "ratio_value", "ratio_unit")} for m in entry["chemical_composition"]["monomers"]], "is_homopolymer": True}}
    ends = lambda b, u: f"Here is the data of a polymer, {b}, please predict Tg based on the data, in units of {u}"
    got = lambda t: [r[0] for r in df.select(prompts.prompt("e", "p", t)).collect()]
    assert got(1) == [ends(dump(body), "°C"), ends('{"chemical_composition": {}, "processing_history": null, "hierarchical_structure": null}', "")]
    assert got(prompts.STRUCT) == [ends(dump(small), "°C"), ends('{"chemical_composition": {"monomers": [], "is_homopolymer": false}}', "")]
    assert got(7)[0] == "Here is a description and reasoning analysis of a polymer: D R. Please predict Tg based on the above content, in units of °C"
    assert got(4)[0] == "Here is a description of a polymer: . Please predict Tg based on the description, in units of °C"
    with pytest.raises(ValueError):
        prompts.prompt("e", "p", 12)


def test_curation(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(30)], "row_idx long, text string").repartition(5)
    assert [r[0] for r in rows(curation.drop_duplicates(df, ["text"]), "row_idx")] == sorted([1, *range(0, 30, 2)])
    text = spark.createDataFrame([("Tg is 88.0 C", 88.0), ("188 or 8.8", 88.0), ("-88", -88.0), (None, 1.0)], "t string, y double")
    assert [r[0] for r in text.select(curation.leaks_target(F.col("t"), F.col("y"))).collect()] == [True, False, True, False]
    recs = spark.createDataFrame([(i, f"x{i % 20}", f"a{i % 4}") for i in range(60)], "row_idx long, text string, article_key string").withColumn("dataset", F.lit("d"))
    clean, split = jobs.curate(recs, ["text", "article_key"])
    assert clean.count() == 20
    per = split.filter("split_name = 'split_article'").join(clean, ["dataset", "row_idx"]).groupBy("article_key").agg(F.count_distinct("part").alias("n"))
    assert per.filter("n > 1").count() == 0 and split.count() == 40


def test_regression_finds_a_line(spark):
    rows_ = [(i, "d", ["train", "train", "val", "test"][i % 4], [float(i % 13), float(i % 7)], 3.0 * (i % 13) - 2.0 * (i % 7) + 5.0, f"a{i % 10}") for i in range(120)]
    df = spark.createDataFrame(rows_, "row_idx long, dataset string, part string, pooled array<double>, y double, article_key string").withColumn("transform", F.lit("identity"))
    swept = regress.sweep(df, ["dataset"], [1e-6, 10.0]).orderBy("trial").collect()
    assert swept[0]["r2"] > 0.999 > swept[1]["r2"] and swept[0]["n"] == 30
    test = regress.fit_predict(df, ["dataset"], 1e-6).filter("part = 'test'")
    assert regress.evaluate(test, df.filter("part = 'train'"), ["dataset"]).first()["r2"] > 0.999


def test_vector_cache(spark, tmp_path):
    toks = spark.createDataFrame([("d", m, t, r, p, [float(r), float(p)]) for m in "ab" for t in "19" for r in range(3) for p in range(2)], "dataset string, model string, input_type string, row_idx long, pos int, vec array<double>")
    for _ in range(2):
        cache.write_cache(toks, str(tmp_path / "c"))
    one = cache.read_cache(spark, str(tmp_path / "c"), "d", "a", "9")
    assert one.count() == 6 and one.schema["vec"].dataType.simpleString() == "array<float>"
    missing = cache.missing_vectors(spark.range(4).select(F.lit("d").alias("dataset"), F.col("id").alias("row_idx")), one.withColumns({"model": F.lit("a"), "input_type": F.lit("9")}), {"model": ["a"], "input_type": ["9"]})
    assert rows(missing.select("row_idx")) == [(3,)]


def test_features_once_per_structure(spark):
    recs = spark.createDataFrame([(0, [("A ",)]), (1, [("A",), (" ",)]), (2, [])], "row_idx long, monomers array<struct<smiles string>>")
    smi = composition.distinct_smiles(recs)
    assert rows(smi) == [("A",)] and composition.multimer_requests(smi).count() == 3
    assert tuple(composition.smiles_counts(recs, F.col("smiles") == "B").first()) == (1, 0, 1)


def test_settled_table_is_shared(spark):
    df = settle(spark.range(3), "t")
    assert df.count() == 3 and shared_dir(spark).removeprefix("file:") in df.inputFiles()[0]


def test_missing_rows_as_bits(spark):
    have = [(r, m) for r in (-130, -64, -1, 0, 1, 63, 64, 5000, 2**40) for m in "ab" if (r + ord(m)) % 3]
    records = spark.createDataFrame([("d", r) for r in (-130, -64, -1, 0, 1, 63, 64, 5000, 2**40)] * 2 + [("d", None)], "dataset string, row_idx long")
    tokens = spark.createDataFrame([("d", m, "1", r, 0) for r, m in have] * 3, "dataset string, model string, input_type string, row_idx long, pos int")
    got = rows(cache.missing_vectors(records, tokens, {"model": ["a", "b"], "input_type": ["1", "9"]}), "model", "input_type", "row_idx")
    want = [("d", m, t, r) for m in "ab" for t in "19" for r in (-130, -64, -1, 0, 1, 63, 64, 5000, 2**40) if t == "9" or (r, m) not in have]
    assert got == want
    assert cache.missing_vectors(records.limit(0), tokens, {"model": ["a"], "input_type": ["1"]}).count() == 0


def test_stream_without_its_checkpoint(spark, tmp_path):
    """A lost checkpoint, a batch that fails before its commit, and new files: every file comes out once, and nothing is overwritten."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*names):
        spark.createDataFrame([(n, json.dumps([GOOD]), "") for n in names], "filename string, content string, reasoning string").coalesce(1).write.mode("append").parquet(inbox)

    def run(checkpoint):
        ingest.run_routed(ingest.stream_responses(spark, inbox), "Tg", out, str(tmp_path / checkpoint))
        back = spark.read.parquet(out)
        return sorted((r.filename, r.batch_id) for r in back.select("filename", "batch_id").collect())

    arrive("a", "b")
    assert run("first") == [("a", 0), ("b", 0)]
    assert run("lost") == [("a", 0), ("b", 0)]
    arrive("c")
    assert run("lost again") == [("a", 0), ("b", 0), ("c", 1)]
    arrive("d")
    fail = {"now": True}

    def step(batch, folder):
        batch.select("filename").write.mode("overwrite").parquet(folder)
        if fail.pop("now", False):
            raise RuntimeError("executor lost")

    other = str(tmp_path / "other")
    sink = ingest.committed(step, other)
    with pytest.raises(Exception, match="executor lost"):
        ingest.drain(ingest.stream_responses(spark, inbox), sink, str(tmp_path / "x"))
    ingest.drain(ingest.stream_responses(spark, inbox), sink, str(tmp_path / "y"))
    assert sorted(r.filename for r in spark.read.parquet(other).collect()) == ["a", "b", "c", "d"]
    assert ingest.commits(spark, other).count() == 3
