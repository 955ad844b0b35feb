"""JSON-array files cut into splits of any size, against ``json.loads``."""

import json
import random

import pytest
from pyspark.sql import functions as F

from litprops.sources import records
from litprops.sources.json_arrays import read_json_arrays

NASTY = ['}', '{', '"', '\\', '\\"}', ']', '[', ',', '}{][', 'é漢 ', '\n\t', '\\\\', '"},{"', '']


def entry(rng, depth=0):
    e = {rng.choice("abc") + str(i): rng.choice([rng.choice(NASTY), rng.randint(-5, 5), None, True, 1.5, [], {}, [rng.choice(NASTY), {"x": rng.choice(NASTY)}]]) for i in range(rng.randint(0, 4))}
    if depth < 3 and rng.random() < 0.5:
        e["in" + rng.choice(NASTY)] = entry(rng, depth + 1)
    return e


def read(spark, path, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = read_json_arrays(spark, str(path))
        out = {}
        for r in df.select("name", "position", F.to_json("entry").alias("e")).collect():
            out.setdefault(r.name, []).append((r.position, json.loads(r.e)))
        return {k: [e for _, e in sorted(v, key=lambda x: x[0])] for k, v in out.items()}, {k: sorted(p for p, _ in v) for k, v in out.items()}
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


@pytest.mark.parametrize("split", [7, 64, 1000, 10**6])
def test_any_split_gives_the_same_records(spark, tmp_path, split):
    rng = random.Random(split)
    want = {}
    for i, style in enumerate([{}, {"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}, {"indent": "\t", "ensure_ascii": False}]):
        data = [entry(rng) for _ in range(30)]
        (tmp_path / f"f{i}.json").write_text((" \n" if i == 1 else "") + json.dumps(data, **style) + ("\r\n " if i == 2 else ""), encoding="utf-8")
        want[f"f{i}.json"] = data
    (tmp_path / "none.json").write_text(" [ \n] ")
    (tmp_path / "one.json").write_text("[{}]")
    got, positions = read(spark, tmp_path, split)
    assert got == {**want, "one.json": [{}]}
    assert all(p == list(range(len(p))) for p in positions.values())


def test_one_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "Tg.json").write_text(json.dumps([{"n": i, "s": "x" * 200} for i in range(4000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        text = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert text.select(F.spark_partition_id().alias("p")).distinct().count() > 8
        got = records.read_record_json(spark, str(tmp_path))
        assert got.filter(F.variant_get("entry", "$.n", "bigint") == F.col("row_idx")).count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4MB")


BROKEN = [' ', '{"a":1}', '[{"a":1}', '[{"a":1}]}', '{"a":1}]', '[{"a":1},]', '[,{"a":1}]', '[{"a":1}{"b":2}]', '[{"a":1}] x', 'x [{"a":1}]', '[1]', '[{"a":1}, 2]', '[2, {"a":1}]', '[[{"a":1}]]',
          '[{"a":1}', '[{"a":"}]', '[{"a":1,}]', '[{"a" 1}]', '[{"a":1}]]', '[{"a":1}][{"a":1}]', '[{"a":[1}]', 'null', '"[{}]"']


@pytest.mark.parametrize("split", [5, 10**6])
def test_broken_files_are_named(spark, tmp_path, split):
    for i, text in enumerate(BROKEN):
        folder = tmp_path / f"d{i}"
        folder.mkdir()
        (folder / "good.json").write_text('[{"a":1}, {"b":"}"}]')
        (folder / f"bad{i}.json").write_text(text)
        with pytest.raises(Exception, match=f"bad{i}.json"):
            read(spark, folder, split)
        with pytest.raises(Exception, match=f"bad{i}.json"):
            read_json_arrays(spark, str(folder)).count()


def test_each_dataset_is_written_as_one_file(spark, tmp_path):
    """Rows of a dataset meet in one file, in order, also where a join by dataset is turned into a broadcast while the job runs."""
    from litprops.sources.sinks import write_json_arrays

    data = [(i, None if i % 10 == 9 else f"d {i % 3}", i / 2) for i in range(600)]
    changed = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    old = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        rows = spark.createDataFrame(data, "row_idx long, dataset string, y double").repartition(8)
        write_json_arrays(rows, str(tmp_path / "out"), "row_idx", ["row_idx", "dataset", "y"])
        back = read_json_arrays(spark, str(tmp_path / "out" / "*" / "*.txt")).select("position", F.to_json("entry").alias("e")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    for name in ("d 0", "d 1", "d 2"):
        files = list((tmp_path / "out").glob(f"dataset={name}/*.txt"))
        want = [{"row_idx": i, "dataset": d, "y": y} for i, d, y in data if d == name]
        assert len(files) == 1 and json.loads(files[0].read_text()) == want
    assert len(back) == sum(d is not None for _, d, _ in data)
    assert all(json.loads(r.e)["row_idx"] == [i for i, d, _ in data if d == json.loads(r.e)["dataset"]][r.position] for r in back)


@pytest.mark.parametrize("segments", [1, 3])
def test_no_segment_is_shuffled_or_sorted(spark, tmp_path, segments):
    """Chunks of few segments: objects cross their borders inside a split. Only pieces at borders meet by a shuffle, and no window holds a split's rows."""
    rng = random.Random(segments)
    data = [entry(rng) for _ in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(data), encoding="utf-8")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", segments)
    try:
        df = read_json_arrays(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {r.position: json.loads(r.e) for r in df.select("position", F.to_json("entry").alias("e")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(enumerate(data))
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_lines_are_not_dealt_by_dataset_before_they_go_to_files(spark, tmp_path, monkeypatch):
    """Tasks that make lines are the ranges of the order: by the dataset there would be one task, whose lines are one block of a shuffle."""
    from litprops.sources.sinks import write_json_arrays

    seen, kind = [], type(spark.range(1))
    deal = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, *a: seen.append(self._jdf.queryExecution().executedPlan().toString()) or deal(self, *a))
    write_json_arrays(spark.range(200).selectExpr("id AS row_idx", "'d' AS dataset"), str(tmp_path / "out"), "row_idx", ["row_idx"])
    assert len(seen) == 1 and "hashpartitioning(dataset" not in seen[0] and "hashpartitioning(coalesce(dataset" not in seen[0]
    assert json.loads(next((tmp_path / "out" / "dataset=d").glob("*.txt")).read_text()) == [{"row_idx": i} for i in range(200)]
