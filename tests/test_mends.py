"""Failures that must be seen or stay small."""

import json

import pytest
from pyspark.sql import functions as F

from litprops.functions import arrays
from litprops.operators import grid, mining, prompts
from litprops.sources import records


def test_layer_norm_of_large_values(spark):
    one = spark.range(1).select(arrays.layer_norm(F.array(F.lit(1e8), F.lit(1e8 + 1), F.lit(1e8 + 2))).alias("v")).first().v
    assert one == pytest.approx([-1.224744, 0.0, 1.224744], abs=1e-4)


def test_one_failing_prompt_empties_one_answer(spark):
    def make():
        def model(texts):
            if any(t == "p3" for t in texts):
                raise RuntimeError("no")
            return [(t.upper(), "") for t in texts]

        return model

    df = spark.range(10).select("id", F.concat(F.lit("p"), F.col("id")).alias("prompt"))
    got = {r.id: r.content for r in mining.map_model(df, "prompt", ["id"], make).collect()}
    assert got == {i: "" if i == 3 else f"P{i}" for i in range(10)}


def test_unknown_property_is_an_error(spark):
    templates = spark.createDataFrame([("a", "Do a.")], "property string, template string")
    df = spark.createDataFrame([("a", "t"), ("b", "t")], "property string, text string")
    assert prompts.extraction_prompt(df.filter("property = 'a'"), templates).first().prompt == "Do a.\nt"
    with pytest.raises(Exception, match="no prompt template for property b"):
        prompts.extraction_prompt(df, templates).collect()


def test_articles_do_not_move_by_property(spark):
    """A property has very many articles, so whole texts are never shuffled by it."""
    templates = spark.createDataFrame([("a", "Do a.")], "property string, template string")
    df = spark.createDataFrame([(i, "a", "t" * i) for i in range(9)], "doc_id int, property string, text string")
    out = prompts.extraction_prompt(df, templates)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == [*df.columns, "prompt"]
    assert {r.doc_id: r.prompt for r in out.collect()} == {i: "Do a.\n" + "t" * i for i in range(9)}


def test_broken_record_file_is_an_error(spark, tmp_path):
    (tmp_path / "tg.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert records.read_record_json(spark, str(tmp_path)).count() == 2
    (tmp_path / "tm.json").write_text('[{"a": 1}')
    with pytest.raises(Exception, match="tm.json"):
        records.read_record_json(spark, str(tmp_path)).collect()


def test_long_strings_and_many_records(spark, tmp_path):
    (tmp_path / "tg.json").write_text('[{"a": "' + "x" * 21_000_000 + '"}, {"a": NaN}]')
    got = records.read_record_json(spark, str(tmp_path)).select("row_idx", F.length(F.to_json("entry")).alias("n")).orderBy("row_idx").collect()
    assert [(r.row_idx, r.n > 21_000_000) for r in got] == [(0, True), (1, False)]


def test_grid_over_a_table(spark):
    base = spark.createDataFrame([("a",), ("b",)], "dataset string")
    trials = grid.expand(spark, {"lr": [0.1, 0.2], "dim": [1, 2, 3]}, base=base)
    assert trials.columns == ["trial", "dataset", "lr", "dim"] and trials.count() == 12
    assert sorted(r.trial for r in trials.filter("dataset = 'b'").collect()) == list(range(6))
    d = spark.range(1, 9).selectExpr("cast(id as int) v")
    for rule in ("d1_gt_d2", "d1_eq_2d2"):
        pairs = grid.pair_rows(d.toDF("d1"), d.toDF("d2"), rule)
        assert sorted([r.d1, r.d2] for r in pairs.collect()) == sorted(grid.pairs(range(1, 9), range(1, 9), rule))
