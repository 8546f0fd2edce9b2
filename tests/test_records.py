"""Reading, resuming, patching and streaming."""

from pyspark.sql import functions as F

from lorescope.session import clear_scratch, scratch_path, shared_dir
from lorescope.sources import records as A
from lorescope.sources import report
from lorescope.sources.tables import table, table_stream
from lorescope.streaming import streams as T

SMALL = "/root/testdata/sf0.001"


def test_read_items_skips_what_is_no_item(spark, tmp_path):
    (tmp_path / "items.json").write_text('{"item_id": 1, "probe_questions": [{"question": "q"}]}\nnot json\n')
    read = A.read_items(spark, str(tmp_path)).cache()
    assert read.filter("_broken is not null").count() == 1
    rows = A.sound_items(read).collect()
    assert [(r["item_id"], r["probe_questions"][0]["question"], r["multihop_question"]) for r in rows] == [(1, "q", None)]


def test_read_annotations_plain_documents(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"m": {"code": {"factuality": [1, 0, -1]}, "math": {"necessity": [0]}}}\n')
    rows = sorted(tuple(r) for r in A.read_annotations(spark, str(tmp_path)).collect())
    assert rows == [("m", "code", "factuality", 0, 1), ("m", "code", "factuality", 1, 0), ("m", "code", "factuality", 2, -1), ("m", "math", "necessity", 0, 0)]


def test_annotations_round_trip_in_chunks(spark, tmp_path):
    rows = [("m", "d", "t", i, i % 2) for i in range(25)]
    labels = spark.createDataFrame(rows, "model string, domain string, task string, idx int, label int")
    A.write_annotations(labels, str(tmp_path / "a"), chunk=10)
    assert sorted(tuple(r) for r in A.read_annotations(spark, str(tmp_path / "a")).collect()) == rows


def test_append_twice_is_once(spark, tmp_path):
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "out")
    A.append_results(rows.filter("id in (1, 2, 7)"), path, ["id"])
    assert A.append_results(rows, path, ["id"]).count() == 10
    assert A.append_results(rows, path, ["id"]).count() == 10


def test_null_keys_are_appended_and_patched_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (None, "x", "b"), (None, None, "c"), (2, "x", "d")], "i int, j string, v string")
    for _ in range(3):
        assert A.append_results(rows, str(tmp_path / "out"), ["i", "j"]).count() == 4
    patched = A.patch_missing(rows, rows.filter("v <> 'd'"), ["i", "j"], lambda missing: missing)
    assert sorted(r["v"] for r in patched.collect()) == ["a", "b", "c", "d"]


def test_a_writer_that_dies_or_loses_leaves_each_key_once(spark, tmp_path, monkeypatch):
    rows, path = spark.range(10).withColumn("v", F.lit("mine")), str(tmp_path / "out")
    claim = A._claim

    def dies(*args):
        raise RuntimeError("the machine went away")

    monkeypatch.setattr(A, "_claim", dies)
    try:
        A.append_results(rows.filter("id < 6"), path, ["id"])
    except RuntimeError:
        pass
    assert A.read_results(spark, path) is None

    def loses(spark, path, number, folder):  # another writer commits just before
        monkeypatch.setattr(A, "_claim", claim)
        A.append_results(rows.filter("id between 3 and 5").withColumn("v", F.lit("other")), path, ["id"])
        return claim(spark, path, number, folder)

    monkeypatch.setattr(A, "_claim", loses)
    stored = A.append_results(rows, path, ["id"])
    assert sorted((r["id"], r["v"]) for r in stored.collect()) == [(i, "other" if 3 <= i <= 5 else "mine") for i in range(10)]
    assert not claim(spark, path, 1, "rows-late") and len(A.drop_uncommitted(spark, path)) == 2
    assert A.read_results(spark, path).count() == 10


def test_patch_fills_gaps_anywhere(spark):
    full = spark.range(6).withColumn("x", F.lit("new"))
    partial = spark.createDataFrame([(1, "old"), (4, "old")], "id bigint, x string")
    out = {r["id"]: r["x"] for r in A.patch_missing(full, partial, ["id"], lambda missing: missing).collect()}
    assert out == {0: "new", 1: "old", 2: "new", 3: "new", 4: "old", 5: "new"}
    ordered = A.patch_missing(full, partial, ["id"], lambda missing: missing, order=["id"]).collect()
    assert [r["id"] for r in ordered] == list(range(6))


def test_stat_is_reloaded_only_under_same_arguments(spark, tmp_path):
    path = str(tmp_path / "s")
    assert A.load_stat(spark, path, {"n": "1"}) is None
    A.save_stat(spark.range(3), path, {"n": "1", "kind": "mean"})
    assert A.load_stat(spark, path, {"n": "1"}) is None
    assert A.load_stat(spark, path, {"n": "2", "kind": "mean"}) is None
    assert A.load_stat(spark, path, {"kind": "mean", "n": "1"}).count() == 3


def test_runs_are_pruned(spark, tmp_path):
    runs = spark.createDataFrame([("grow", "base", i) for i in range(5)] + [("code", "base", 9)], "task string, method string, id int")
    A.write_runs(runs, str(tmp_path / "r"), ["task", "method"])
    grow = A.read_runs(spark, str(tmp_path / "r"), {"task": ["grow", "math"]})
    assert grow.count() == 5
    plan = grow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [task" in plan or "PartitionFilters: [isnotnull(task" in plan
    assert A.read_runs(spark, str(tmp_path / "r"), {"task": ["math"]}).columns == grow.columns


def test_only_wanted_run_folders_are_listed(spark, tmp_path, monkeypatch):
    """300 runs in a path with pattern characters; listing calls are those of the wanted branches."""
    path = str(tmp_path / "r[1]{x}")
    runs = spark.range(300).selectExpr("concat('t/', id % 10) as task", "cast(id % 3 as int) as size", "concat('m', id % 10) as model", "id")
    runs.coalesce(1).write.partitionBy("task", "size", "model").parquet(path)
    listed = []
    children = A.children
    monkeypatch.setattr(A, "children", lambda s, folder: listed.append(folder) or children(s, folder))
    where = {"task": ["t/1", "t/2"], "size": [2, None], "model": ["m1", "m7"]}
    found = A.read_runs(spark, path, where, schema=runs.schema)
    want = runs.filter("task in ('t/1', 't/2') and size = 2 and model in ('m1', 'm7')").collect()
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in want) and found.count() == 10
    assert len(listed) == 1 + 2 + 2  # the table, its two tasks, one size in each
    assert A.read_runs(spark, path, {"size": ["1"]}, schema=runs.schema).count() == 100
    assert A.read_runs(spark, path, {"task": ["nowhere"]}, schema=runs.schema).count() == 0
    assert A.read_runs(spark, path, {"task": [None]}, schema=runs.schema).count() == 0
    assert A.read_runs(spark, path, {}, schema=runs.schema).count() == 300


def test_run_key_from_path(spark):
    paths = [
        "x/eval_results/grow/injection_evaluated/ft_ck_500_qwen-3-1.7b_10.pkl",
        "code/injection/append_t_100_o4-mini_1.parquet",
        "math/other.txt",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    rows = [tuple(r) for r in A.run_key(df, "path").orderBy("i").drop("i", "path").collect()]
    assert rows == [("grow", "ft_ck", 500, "qwen-3-1.7b", 10), ("code", "append_t", 100, "o4-mini", 1), (None, None, None, None, None)]


def test_report_marks_best_and_missing(spark):
    ci = spark.createDataFrame(
        [("A", "m", "x", "hp", 50.0, 2.0), ("A", "m", "y", "hp", 50.000001, 1.0), ("A", "m", "z", "hp", 40.0, 1.0)],
        "task string, model string, method string, metric string, midpoint double, margin double",
    )
    lines = {r["method"]: r["line"] for r in report.emit_table(ci, ["A", "B"], ["hp"]).collect()}
    assert lines["x"] == "m & x & \\textbf{50.0} \\textsubscript{$\\pm$ 2.0} &   \\\\"
    assert lines["y"].startswith("m & y & \\textbf{50.0}") and "textbf" not in lines["z"]


def test_stream_resumes_without_repeats(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(20).withColumn("v", F.col("id") % 3)
    rows.filter("id < 12").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    assert T.append_once(stream, ["id"], sink).count() == 12
    rows.write.mode("append").parquet(source)
    assert T.append_once(stream, ["id"], sink).count() == 20
    assert T.append_once(stream, ["id"], sink).count() == 20


def test_batches_left_behind_are_replaced(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    spark.range(100, 110).write.parquet(f"{path}/data/batch=0")  # a batch that failed halfway
    T.drain(spark.readStream.schema("id bigint").parquet(source), "append", path)
    assert T.batches(spark, path).count() == 5


def test_table_stream_reads_files_and_folders(spark, tmp_path):
    table(spark, SMALL, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for folder in (SMALL, str(tmp_path)):
        path = f"{tmp_path}/out-{len(folder)}"
        T.drain(table_stream(spark, folder, "events"), "append", path)
        assert T.batches(spark, path).count() == 1000


def test_rates_and_one_state_of_two_versions(spark, tmp_path):
    facts = "array<struct<nli_class string>>"
    rows = [(1, "t", True, [("entailment",), ("neutral",)]), (2, "t", True, []), (3, "t", False, [("entailment",)]), (4, "t", True, [("neutral",)])]
    df = spark.createDataFrame(rows, f"item_id bigint, task string, final_answer_correct boolean, required_knowledge {facts}")
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(4, "item_id").write.option("maxRecordsPerFile", 1).parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rates = T.stream_rates(stream, ["task"], path).collect()
    assert [(r["task"], r["n"], r["hp"], r["ap"], r["fke"]) for r in rates] == [("t", 4, 0.25, 0.75, 0.5)]
    assert len(T.state_versions(spark, path)) == 2


def test_a_replayed_batch_leaves_the_same_state(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id bigint").parquet(source)
    spark.range(7).groupBy().agg(F.count("id").alias("n")).write.parquet(f"{path}/state/version=0")  # left by a batch that was not committed
    counted = T.fold(stream, path, lambda b: b.agg(F.count("id").alias("n")), lambda s: s.agg(F.sum("n").alias("n")))
    assert counted.first()["n"] == 30


VOTE = "probe_id bigint, answer string, gt_answer string, verdict_text string"


def _vote(probe, answer, yes):
    return (probe, answer, "t", f"Equivalence: {'Yes' if yes else 'No'}, so.")


def _majorities(df):
    return sorted((r["probe_id"], r["n_votes"], r["n_truth"], r["majority_answer"]) for r in df.collect())


def test_live_votes_write_what_changed_and_resume(spark, tmp_path):
    """Eleven batches over a restart; a batch logs its own probes only, and eight segments become one."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(source)
    votes = [_vote(p, a, a == "t") for p in range(50) for a in ("t", "x", "t")]
    spark.createDataFrame(votes, VOTE).coalesce(1).write.mode("append").parquet(source)
    T.stream_votes(stream, path)
    for i in range(10):
        spark.createDataFrame([_vote(7, "x", False), _vote(100 + i, None, None)], VOTE).coalesce(1).write.mode("append").parquet(source)
        result = T.stream_votes(stream, path)  # starts again from the checkpoint each time
    segments = T.log_segments(spark, path)
    assert segments == [(0, 8), (0, 9), (0, 10), (1, 7)]
    assert [spark.read.parquet(f"{path}/log/0-{n}").count() for n in (8, 9, 10)] == [2, 2, 2]
    found = _majorities(result)
    assert found[7] == (7, 13, 2, "x") and found[8] == (8, 3, 2, "t") and len(found) == 60 and found[-1] == (109, 1, 0, None)
    assert _majorities(T.stream_votes(stream, path)) == found


def test_a_replayed_batch_logs_the_same(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in (*range(8), 7, 8, 8):
        T.change_log(spark.createDataFrame([(n % 3, n)], "k bigint, v bigint"), n, ["k"], path)
    assert T.log_segments(spark, path) == [(0, 8), (1, 7)]
    rows = spark.read.parquet(f"{path}/log/1-7", f"{path}/log/0-8")
    assert sorted((r["k"], r["v"]) for r in T._newest(rows, ["k"]).collect()) == [(0, 6), (1, 7), (2, 8)]


def test_live_votes_are_forgotten(spark, tmp_path):
    import time

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(source)

    def arrive(*votes):
        spark.createDataFrame(list(votes), VOTE).coalesce(1).write.mode("append").parquet(source)
        return _majorities(T.stream_votes(stream, path, forget_after=40))

    assert arrive(_vote(1, "x", False), _vote(1, "x", False), _vote(2, "t", True)) == [(1, 2, 0, "x"), (2, 1, 1, "t")]
    assert arrive(_vote(1, "x", False), _vote(2, "t", True)) == [(1, 3, 0, "x"), (2, 2, 2, "t")]
    time.sleep(41)
    assert arrive(_vote(2, "t", True)) == [(2, 1, 1, "t")]


def test_scratch_is_shared_and_cleared(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(shared_dir(spark))
    spark.range(1).write.parquet(path)
    clear_scratch(spark)
    assert not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(
        spark._jvm.org.apache.hadoop.fs.Path(path)
    )
