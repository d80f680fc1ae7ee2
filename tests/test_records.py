"""Sinks, routers, filters and records that no table of the tests shows in full."""

from pyspark.sql import functions as F

from lakelens.operators import answers, findings, graph, rules
from lakelens.sources import files
from lakelens.streaming import state, windows


def test_upsert_and_delete(spark, tmp_path):
    path, schema = str(tmp_path / "points"), "point_id string, repo_id string, text string"
    files.upsert(spark.createDataFrame([("a", "r1", "1"), ("b", "r1", "2"), ("c", "r2", "3"), ("c", "r2", "3")], schema), path)
    files.upsert(spark.createDataFrame([("b", "r1", "new"), ("d", "r1", "4")], schema), path)
    read = lambda: sorted((r.point_id, r.text) for r in spark.read.parquet(path).collect())
    assert read() == [("a", "1"), ("b", "new"), ("c", "3"), ("d", "4")]
    files.delete_where(spark, path, "repo_id = 'r2' OR text = '4'")
    assert read() == [("a", "1"), ("b", "new")]


def test_read_tree_leaves_folders_and_large_texts(spark, tmp_path):
    for name, text in (("a.py", b"x = 1\n"), ("src/b.js", b"\xff\xfe"), ("src/node_modules/c.js", b"no"), (".git/d", b"no"), ("big.txt", b"y" * 64)):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)
    got = {r.file_path: r for r in files.read_tree(spark, f"file://{tmp_path}", "r", most=60).collect()}
    assert set(got) == {"a.py", "src/b.js", "big.txt"} and got["a.py"].content == "x = 1\n" and got["big.txt"].content is None and got["big.txt"].size_bytes == 64


EVENTS = "event_id long, route string, action string, ref string, repo_id string"
ROWS = [
    (1, "push", None, "refs/heads/main", "r1"), (2, "push", None, "refs/heads/dev", "r1"), (3, "push", None, None, "r1"), (4, "push", None, "refs/heads/main", None), (5, "push", None, "x/main", "gone"),
    (6, "pull_request", "opened", None, "r1"), (7, "pull_request", "closed", None, "r1"), (8, "pull_request", "synchronize", None, "r2"), (9, "pull_request", None, None, "r1"),
    (10, "installation", "deleted", None, "r2"), (11, "installation", "created", None, "r1"), (12, "installation", "x", None, "r1"), (13, "ping", None, None, None), (14, "other", None, None, None),
]
WANT = {1: "reindex_queued", 6: "review_queued", 10: "uninstalled", 11: "installed", 13: "pong"}


def repositories(spark):
    rows = [("r1", "main", "ready", None), ("r2", "main", "pending", None), ("gone", "main", "ready", "2024-01-01 00:00:00")]
    return spark.createDataFrame(rows, "repo_id string, default_branch string, index_status string, at string").select("repo_id", "default_branch", "index_status", F.col("at").cast("timestamp_ntz").alias("deleted_at"))


def test_gates(spark):
    got = {r.event_id: r for r in windows.gated(spark.createDataFrame(ROWS, EVENTS), repositories(spark)).collect()}
    assert {k: r.outcome for k, r in got.items() if r.status == "ok"} == WANT
    assert got[5].reason == "repository not connected" and got[8].reason == "repository not indexed" and got[3].reason == "not default branch" and got[9].reason == "action none not handled"


def test_router_as_a_stream(spark, tmp_path):
    spark.createDataFrame(ROWS, EVENTS).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        windows.run_router(stream, repositories(spark), str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "outcomes"))
    assert {r.event_id: r.outcome for r in got.where("status = 'ok'").collect()} == WANT and got.count() == len(ROWS)
    marked = windows.without_deleted(repositories(spark), got, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).collect()
    assert {r.repo_id: str(r.deleted_at)[:4] for r in marked} == {"r1": "None", "r2": "2024", "gone": "2024"}


def test_append_new_by_partition(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "day string, k int"
    for rows in ([("a", 1), ("b", 1)], [("a", 1), ("a", 2), ("a", 2)]):
        windows.append_new(spark.createDataFrame(rows, schema), path, ["day", "k"], "day")
    assert sorted((r.day, r.k) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_cache_of_values_as_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00', 'x'), ('a', TIMESTAMP '2024-01-01 00:30:00', 'y'), ('a', TIMESTAMP '2024-01-01 02:00:00', 'z'), ('b', TIMESTAMP '2024-01-01 00:00:00', 'w') t(key, at, value)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.cached(stream).writeStream.format("memory").queryName("cache_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.key, r.value, r.hit) for r in spark.table("cache_rows").collect()) == [("a", "x", False), ("a", "x", True), ("a", "z", False), ("b", "w", False)]


def test_cost_tags_and_status(spark):
    one = spark.range(1)
    row = one.select(
        findings.token_cost(F.lit(1000), F.lit(2000), F.lit(None).cast("int")).alias("cost"), findings.regulatory_tags(F.array(F.lit("PII"), F.lit("health"))).alias("tags"), findings.regulatory_tags(F.array(F.lit("health"))).alias("none"),
        findings.run_status(F.array().cast("array<string>"), F.lit(False)).alias("done"), findings.run_status(F.array(F.lit("x")), F.lit(True)).alias("failed"), findings.fix_of(F.lit("env_leaked")).alias("fix"), findings.fix_of(F.lit(None).cast("string")).alias("other"),
    ).first()
    assert row.cost == 50 and row.tags == ["HIPAA", "GDPR", "CCPA"] and row.none == [] and (row.done, row.failed) == ("completed", "failed") and row.fix.startswith("Remove .env") and row.other == findings.NO_FIX


def test_enabled_and_filtered(spark):
    assert [r.rule_id for r in rules.enabled(rules.SCAN_RULES, ["privacy"])] == ["PRIV-001", "PRIV-002"] and rules.enabled(rules.SCAN_RULES, []) == rules.SCAN_RULES
    df = spark.createDataFrame([("a", "x"), ("b", None)], "category string, severity string")
    assert findings.filtered(df, category=None, severity=None).count() == 2 and findings.filtered(df, category="a", severity="x").count() == 1


def test_traces_follow_ten_ways(spark):
    e = spark.createDataFrame([("r", "main", f"f{k:02d}") for k in range(12)] + [("r", "f00", "f01")], "repo_id string, caller string, callee string")
    got = {" ".join(r.path) for r in graph.traces(e, spark.createDataFrame([("r", "main")], "repo_id string, qualified_name string")).collect()}
    assert got == {"main f00 f01", *(f"main f{k:02d}" for k in range(1, 10))}


def test_sections_and_tiers(spark):
    schema = "qa_id long, repo_id string, answer_text string, quoted_spans array<struct<source_id int, quoted_text string, verified boolean>>"
    both = '{"sections": [{"text": "a", "source_ids": [1, 9]}, {"text": "", "source_ids": [1]}, {"text": "b", "source_ids": []}, {"text": "c", "source_ids": [9]}, {"text": "d", "source_ids": [2]}, {"text": "e", "source_ids": [3]}], "unknowns": ["u"]}'
    a = spark.createDataFrame([(1, "r", both, [(1, "load rows", True), (1, "nothing", True), (2, "nowhere", None)]), (2, "r", "plain text", []), (3, "r", 'so: {"sections": [], "unknowns": ["x"]}', None), (4, "r", None, None)], schema)
    s = spark.createDataFrame([(10, 1, 1, "f", "load  rows", 0.5), (11, 1, 2, "g", "x", 0.5), (12, 1, 3, "h", "y", 0.5), (13, 2, 5, "h", "y", 0.5), (14, 2, 4, "h", "y", 0.5)], "source_row_id long, qa_id long, source_index int, file_path string, content string, score double")
    got = [(r.section_no, r.invalid, r.quotes, r.verified, r.verdict) for r in answers.validated_sections(a, s).where("qa_id = 1").orderBy("section_no").collect()]
    assert got == [(0, 1, 2, 1, "verified"), (1, 0, 2, 1, "no_text"), (2, 0, 0, 0, "no_sources"), (3, 1, 0, 0, "invalid_sources"), (4, 0, 1, 0, "rejected"), (5, 0, 0, 0, "unverified")]
    assert {r.qa_id: r.tier for r in answers.derived_tiers(a).collect()} == {1: "high", 2: "low", 3: "insufficient"}
    assert [(r.qa_id, r.shown) for r in answers.degraded(a, s).collect()] == [(2, "4,5")]
