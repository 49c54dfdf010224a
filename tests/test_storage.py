"""Sources, sinks, streams and jobs on stored files."""

import json
import pathlib
from types import SimpleNamespace

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import jobs, schemas
from runlens.session import CHECKPOINT_DIR, shared_root, work_path
from runlens.sources import readers, writers
from runlens.streaming import ledger

FAILED_JOB = (PySparkException, Py4JJavaError)
RESULT = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("resolve_rate", T.DoubleType()),
    ]
)


def put(folder: pathlib.Path, name: str, text: str) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_strict_lines(spark, tmp_path):
    path = put(tmp_path / "a", "x.jsonl", '{"instance_id": "a", "resolve_rate": 0.5}\n\n  \n{"instance_id": "b"}\n')
    assert readers.read_jsonl_strict(spark, path, RESULT).count() == 2
    bad = put(tmp_path / "b", "x.jsonl", '{"instance_id": "a"}\n{oops\n')
    with pytest.raises(FAILED_JOB):
        readers.read_jsonl_strict(spark, bad, RESULT).collect()


def test_tolerant_lines(spark, tmp_path):
    lines = ['{"instance_id": "a", "resolve_rate": 1.0}', "", '{"repo": "r"}', "{oops", "  ", '{"instance_id": "b"}']
    path = put(tmp_path, "x.jsonl", "\n".join(lines))
    got = readers.read_jsonl_tolerant(spark, path, RESULT)
    assert got.columns == RESULT.fieldNames()
    assert sorted(r.instance_id for r in got.collect()) == ["a", "b"]
    assert tuple(readers.count_rejects(spark, path, RESULT).first()) == (4, 2)


def test_array_file(spark, tmp_path):
    path = put(tmp_path, "x.json", json.dumps([{"instance_id": "a"}, {"instance_id": "b", "error": "e"}], indent=2))
    got = readers.read_json_array(spark, path, schemas.SAMPLE).orderBy("instance_id").collect()
    assert [(r.instance_id, r.error) for r in got] == [("a", None), ("b", "e")]


def test_prediction_tree(spark, tmp_path):
    put(tmp_path / "a", "prediction.json", json.dumps({"instance_id": "a", "model_patch": "p\nq"}, indent=2))
    put(tmp_path / "b", "prediction.json", "{oops")
    put(tmp_path / "e", "prediction.json", '{"instance_id": "e", "model_patch": "cut')
    put(tmp_path / "c", "prediction.json", '{"model_patch": "p"}')
    put(tmp_path / "d", "report.json", '{"instance_id": "d"}')
    got = readers.read_prediction_tree(spark, str(tmp_path)).collect()
    assert [(r.instance_id, r.model_patch) for r in got] == [("a", "p\nq")]


def test_large_prediction_tree(spark, tmp_path):
    """Neither the driver's list nor the number of tasks grows with the files; ids are written by many tasks."""
    rows = spark.range(3000, numPartitions=1).selectExpr(
        "cast(id as string) as instance_id",
        "to_json(struct(cast(id as string) as instance_id, concat('é\n', id) as model_patch)) as value",
    )
    writers.write_prediction_tree(rows, f"file://{tmp_path}/tree")
    got = readers.read_prediction_tree(spark, f"file://{tmp_path}/tree")
    assert not got.inputFiles()
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert {(r.instance_id, r.model_patch) for r in got.collect()} == {(str(i), f"é\n{i}") for i in range(3000)}


def test_prediction_tree_reads_what_the_file_reader_reads(spark, tmp_path, monkeypatch):
    """Files of any depth, order and encoding, also right below the root; an unreadable one is left out."""
    named = '{{"instance_id": "{0}", "model_patch": "ü"}}'
    put(tmp_path, "prediction.json", named.format("top"))
    put(tmp_path / "a" / "b" / "c", "prediction.json", f"[{named.format('x')}, {named.format('y')}]")
    put(tmp_path / "a" / "b", "other.json", named.format("other"))
    put(tmp_path / "blank é%20", "prediction.json", named.format("blank"))
    put(tmp_path / "empty", "prediction.json", "")
    for name, raw in {
        "wide": named.format("wide").encode("utf-16-le"),
        "broken": named.format("broken").encode("latin-1"),
        "tail": named.format("tail").encode() + b"\n\n",
        "typed": b'{"instance_id": "typed", "model_patch": {"a":1}}',
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "prediction.json").write_bytes(raw)
    got = sorted(tuple(r) for r in readers.read_prediction_tree(spark, str(tmp_path)).collect())
    assert [r[0] for r in got] == ["blank", "tail", "top", "typed", "wide", "x", "y"]
    monkeypatch.setattr(readers, "_mounted", lambda *_: None)
    assert got == sorted(tuple(r) for r in readers.read_prediction_tree(spark, str(tmp_path)).collect())


def test_prediction_tree_has_ids_of_any_name(spark, tmp_path):
    for name in ("_a", ".b", "c=1"):
        put(tmp_path / name, "prediction.json", json.dumps({"instance_id": name}))
    got = readers.read_prediction_tree(spark, str(tmp_path)).collect()
    assert sorted(r.instance_id for r in got) == [".b", "_a", "c=1"]


def test_prompt_map_takes_the_last_line(spark, tmp_path):
    lines = [("a", "old"), ("a", "new"), ("b", ""), ("", "x"), ("c", "one")]
    text = "\n".join(json.dumps({"instance_id": i, "text_inputs": t}) for i, t in lines)
    path = put(tmp_path, "p.jsonl", text)
    stored = spark.read.schema(schemas.PROMPT_LINE).json(path).select("*", "_metadata")
    got = readers.load_prompt_map(readers.with_line_order(stored))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "new"), ("c", "one")]


def test_id_list_and_labels(spark, tmp_path, one):
    path = put(tmp_path, "ids.txt", "a\n b \n\n \nc")
    assert sorted(r[0] for r in readers.read_id_list(spark, path).collect()) == ["a", "b", "c"]
    rows = [('{"repo": "r", "FAIL_TO_PASS": ["t"]}',)]
    got = one(lambda c: readers.parse_label(c, schemas.TASK_LABEL), rows, "l string")[0]
    assert (got.repo, got.FAIL_TO_PASS, got.base_commit) == ("r", ["t"], None)
    loose = one(lambda c: readers.parse_label(c, "k int", strict=False), [(None,), ("{oops",), ('{"k": 1}',)], "l string")
    assert [r.k for r in loose] == [None, None, 1]
    with pytest.raises(FAILED_JOB):
        one(lambda c: readers.parse_label(c, "k int"), [("{oops",)], "l string")


def test_split_reader(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/d/train")
    spark.range(5).write.parquet(f"{root}/d/other")
    assert readers.read_split(spark, root, "d").count() == 3
    assert readers.read_split(spark, root, "d", "other").count() == 5


def test_training_lines_keep_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("a", None)], "instance_id string, base_commit string")
    path = str(tmp_path / "t")
    writers.write_training_jsonl(writers.training_lines(rows, F.lit("p")), path)
    line = spark.read.text(path).first()[0]
    assert json.loads(json.loads(line)["label"]) == {"instance_id": "a", "base_commit": None}


def test_result_tables_leave_out_absent_outputs(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r1", "a", "p", None), ("r2", "b", "q", "log")], "run_id string, instance_id string, model_patch string, logs string"
    )
    writers.write_result_tables(rows, str(tmp_path), {"predictions": ["model_patch"], "logs": ["logs"]})
    assert spark.read.parquet(f"{tmp_path}/predictions").count() == 2
    assert [r.instance_id for r in spark.read.parquet(f"{tmp_path}/logs").collect()] == ["b"]
    assert (tmp_path / "logs" / "run_id=r2").exists()


def test_merge_keeps_dataset_order(spark):
    dataset = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "instance_id string, seq int")
    stored = spark.createDataFrame(
        [("a", None, None), ("b", "p", "m"), ("x", "p", "m")],
        "instance_id string, model_patch string, model_name_or_path string",
    )
    got = [tuple(r) for r in writers.merge_predictions(dataset, stored).collect()]
    assert got == [("b", "p", "m"), ("a", "", "unknown")]


def test_id_list_keeps_its_order(spark, tmp_path):
    ids = spark.range(50).select(F.col("id").cast("string").alias("instance_id"), (-F.col("id")).alias("rank"))
    path = str(tmp_path / "ids")
    writers.write_id_list(ids, ["rank"], path)
    lines = [line for part in sorted(pathlib.Path(path).glob("part-*")) for line in part.read_text().split()]
    assert lines == [str(i) for i in reversed(range(50))]


def session_with(folder, master="local[2]"):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == CHECKPOINT_DIR else default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_root_follows_the_session():
    named = session_with("hdfs://c/shared/")
    assert work_path(named, "x").startswith("hdfs://c/shared/runlens/x-")
    assert work_path(named, "x") != work_path(named, "x")
    local = session_with(None)
    assert shared_root(local) == shared_root(local)
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        shared_root(session_with(None, master="spark://c:7077"))


def lines_of(*ids):
    return "\n".join(json.dumps({"instance_id": i, "repo": "r", "resolve_rate": 0.5}) for i in ids)


@pytest.mark.parametrize("keep_ids", [False, True])
def test_ledger_restarts_without_repeats(spark, tmp_path, keep_ids):
    source, path = tmp_path / "in", str(tmp_path / "ledger")

    def run(checkpoint):
        stream = ledger.stream_results(spark, str(source), RESULT, files_per_trigger=1)
        options = {"keep_ids": keep_ids}
        ledger.run_ledger(stream, path, str(tmp_path / checkpoint), RESULT, **options).awaitTermination()
        return sorted(r.instance_id for r in ledger.read_ledger(spark, path, RESULT).collect())

    put(source, "1.json", lines_of("a", "b", "a"))
    put(source, "2.json", lines_of("b", "c"))
    assert run("cp") == ["a", "b", "c"]
    assert run("cp") == ["a", "b", "c"]
    put(source, "3.json", lines_of("c", "d") + '\n{"repo": "no id"}\n')
    assert run("cp") == ["a", "b", "c", "d"]
    put(source, "4.json", lines_of("e"))
    assert run("other checkpoint") == ["a", "b", "c", "d", "e"]


def test_repeated_batch_writes_the_same(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = spark.createDataFrame([("a", "r", 0.5), ("a", "q", 0.1), ("b", "r", 1.0)], RESULT)
    for _ in range(2):
        ledger.write_batch(batch, "s", 0, path, RESULT, "instance_id")
    ledger.write_batch(batch, "s", 1, path, RESULT, "instance_id")
    ledger.write_batch(batch, "t", 0, path, RESULT, "instance_id")
    got = sorted((r.instance_id, r.repo, r.stream, r.batch_id) for r in ledger.read_ledger(spark, path, RESULT).collect())
    assert got == [("a", "q", "s", 0), ("b", "r", "s", 0)]


def test_progress(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    put(source, "1.json", lines_of("a", "b"))
    put(source, "2.json", lines_of("b", "a", "b"))
    rows = ledger.progress(ledger.stream_results(spark, str(source), RESULT), total=5)
    ledger.run_progress(rows, path, str(tmp_path / "cp")).awaitTermination()
    got = ledger.read_progress(spark, path).first()
    assert (got.done, got.total, got.resolved_any, got.avg_resolve_rate) == (2, 5, 2, 0.5)


def run_record(resolved, steps, tokens, reason):
    return {"resolved": resolved, "steps": steps, "total_tokens": tokens, "reason": reason, "error": None,
            "wall_clock_seconds": 1.5}


def test_analyze_results(spark, tmp_path):
    records = [
        {"instance_id": "a", "repo": "r", "runs": [run_record(True, 2, 10, "submit"), run_record(False, 4, 20, "error")],
         "resolve_rate": 0.5, "avg_steps": 3.0, "avg_tokens": 15.0},
        {"instance_id": "b", "repo": "r", "runs": [], "resolve_rate": 0.0, "avg_steps": 0.0, "avg_tokens": 0.0},
    ]
    source = put(tmp_path / "in", "r.jsonl", "\n".join(json.dumps(r) for r in records))
    paths = jobs.analyze_results(spark, source, str(tmp_path / "out"))
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    overall = tables["overall"].first()
    assert (overall.total_runs, overall.instances, overall.runs_per_instance, overall.any_rate) == (2, 2, 1, 0.5)
    assert [r.instances for r in tables["per_repo"].orderBy("scope").collect()] == [2, 2]
    assert (tables["summary"].first().instances, tables["summary"].first().avg_resolve_rate) == (2, 0.25)
    assert tables["group_signal"].first().mixed == 1 and tables["group_signal"].first().always_fail == 1
    sizes = {r.cohort: r.n for r in tables["distributions"].where("metric = 'steps'").collect()}
    assert sizes == {"non_error": 1, "resolved": 1, "unresolved": 0, "mixed": 2}
    assert tables["outcomes"].count() == 2 and tables["per_repo"].count() == 2


def test_an_id_stored_twice_is_one_instance(spark, tmp_path):
    one = {"instance_id": "a", "runs": [run_record(True, 2, 10, "submit")], "resolve_rate": 1.0, "avg_steps": 2.0, "avg_tokens": 10.0}
    records = [one | {"repo": "r"}, one | {"runs": [run_record(False, 2, 10, "submit")]}]
    source = put(tmp_path / "in", "r.jsonl", "\n".join(json.dumps(r) for r in records))
    paths = jobs.analyze_results(spark, source, str(tmp_path / "out"))
    summary = spark.read.parquet(paths["summary"]).first()
    assert (summary.instances, summary.total_runs) == (1, 2)


def test_build_training_set(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"fix {i}", i) for i in range(9)], "instance_id string, problem_statement string, seq int")
    jobs.build_training_set(rows, str(tmp_path / "a"), limit=4)
    jobs.build_training_set(rows, str(tmp_path / "b"), limit=4, shuffle=True)
    jobs.build_training_set(rows, str(tmp_path / "c"), shuffle=True)

    def ids(name):
        stored = readers.read_jsonl_strict(spark, str(tmp_path / name), schemas.TRAINING_LINE)
        return [r.i for r in stored.select(F.get_json_object("label", "$.instance_id").alias("i")).collect()]

    assert ids("a") == ["0", "1", "2", "3"]
    assert len(ids("b")) == 4 and ids("c")[:4] == ids("b") and sorted(ids("c")) == [str(i) for i in range(9)]


def test_grade_predictions(spark, tmp_path):
    put(tmp_path / "tree" / "a", "prediction.json", json.dumps({"instance_id": "a", "model_patch": "p"}))
    dataset = spark.createDataFrame([("b", 0), ("a", 1)], "instance_id string, seq int")
    results = spark.createDataFrame(
        [("a", True, True, None, 2, True), ("b", None, True, "x", None, None)],
        "instance_id string, resolved boolean, patch_exists boolean, error string, num_turns int, stopped_early boolean",
    )
    paths = jobs.grade_predictions(spark, dataset, str(tmp_path / "tree"), results, str(tmp_path / "out"))
    assert spark.read.parquet(paths["generated"]).first().patches_generated == 1
    assert spark.read.parquet(paths["run_report"]).first().resolve_rate == 1.0
    assert spark.read.parquet(paths["predictions"]).first().model_name_or_path == "unknown"


def test_replay_sessions(spark):
    generations = spark.createDataFrame(
        [("s", 0, "o0"), ("s", 1, "o1"), ("s", 2, "o2"), ("t", 0, "p0")], "session_id string, turn int, output string"
    )
    verdicts = spark.createDataFrame(
        [("s", 0, "a", "ok", 0.5, 1.0), ("s", 1, "a", "ok", 1.0, 1.0), ("s", 2, "a", "ok", 1.0, 1.0),
         ("t", 0, "a", "error", 1.0, 1.0), ("t", 0, "final", "ok", 1.0, 1.0)],
        "session_id string, turn int, name string, status string, score double, pass_threshold double",
    )
    turns, ends = jobs.replay_sessions(generations, verdicts, ["a"], max_turns=3)
    rows = {(r.session_id, r.turn): r for r in turns.collect()}
    assert sorted(rows) == [("s", 0), ("s", 1), ("t", 0)]
    assert rows[("s", 0)].aggregate_score == 0.5 and "FAILED (score: 0.50)" in rows[("s", 0)].feedback
    assert rows[("s", 1)].feedback == "" and "[a] ERROR" in rows[("t", 0)].feedback
    got = sorted(tuple(r) for r in ends.collect())
    assert got == [("s", "o1", 2, True, 1.0), ("t", "p0", 1, False, 1.0)]
    assert [tuple(v) for v in rows[("s", 0)].verifier_results] == [("a", "ok", 0.5, False)]
    assert [tuple(v) for v in rows[("t", 0)].verifier_results] == [("a", "error", 1.0, False)]
    cut, ends = jobs.replay_sessions(generations, verdicts, ["a"], max_turns=1, final=["a"])
    assert {(r.session_id, r.feedback) for r in cut.collect()} == {("s", ""), ("t", "")}
    assert sorted(tuple(r) for r in ends.collect()) == [("s", "o0", 1, False, 0.5), ("t", "p0", 1, False, 0.0)]
    turns, ends = jobs.replay_sessions(generations, verdicts, [], max_turns=3)
    assert turns.count() == 4 and {r.aggregate_score for r in turns.collect()} == {1.0}
    assert sorted(tuple(r) for r in ends.collect())[0] == ("s", "o2", 3, False, 1.0)


def test_object_path():
    assert readers.object_path("s3://b/k/x") == "s3a://b/k/x"
    with pytest.raises(ValueError, match="only s3"):
        readers.object_path("/local/x")


def test_evaluate_samples(spark, tmp_path):
    samples = spark.createDataFrame([("t1", 1, "x"), ("t1", 2, "y"), ("t2", 1, "z")], "task_id string, sample_id int, prediction string")
    problems = spark.createDataFrame([("t1", "test"), ("t2", "test")], "task_id string, test string")
    outcomes = spark.createDataFrame(
        [("t1", 1, False, None), ("t1", 2, False, "boom")], "task_id string, sample_id int, timed_out boolean, failure string"
    )
    paths = jobs.evaluate_samples(samples, problems, outcomes, str(tmp_path / "out"))
    summary = spark.read.parquet(paths["summary"]).first()
    assert (summary.total, summary.passed, summary.failed, summary.pass_rate) == (3, 1, 2, pytest.approx(1 / 3))
    texts = {(r.task_id, r.sample_id): r.result for r in spark.read.parquet(paths["instances"]).collect()}
    assert texts[("t2", 1)] == "timed out" and texts[("t1", 2)] == "failed: boom"
