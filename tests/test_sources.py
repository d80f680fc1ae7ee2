import datetime

import pytest
from pyspark.sql import functions as F

from lakelens.operators import routes
from lakelens.sources import files as S
from lakelens.streaming import state


def test_read_tree(spark, tmp_path):
    for p, b in {"src/a.py": b"x = 1\n", "node_modules/b.js": b"x", "src/vendor/c.php": b"x", "bad.txt": b"caf\xff", "big.png": b"\0", "x.min.js": b"a"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = S.read_tree(spark, str(tmp_path), "r")
    assert sorted(r.file_path for r in got.collect()) == ["bad.txt", "big.png", "src/a.py", "x.min.js"]
    assert sorted(r.file_path for r in S.loadable(got).collect()) == ["bad.txt", "src/a.py"]
    assert got.where("file_path = 'bad.txt'").first().content == "caf�"


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("r1", 1), ("r2", 2)], "repo_id string, v int")
    S.replace_by_key(a, str(tmp_path / "t"))
    S.replace_by_key(spark.createDataFrame([("r2", 9)], "repo_id string, v int"), str(tmp_path / "t"))
    assert sorted((r.repo_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("r1", 1), ("r2", 9)]
    S.write_documents(spark.createDataFrame([("A.md", "# x\ny")], "name string, body string"), str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d" / "name=A.md")).collect()] == ["# x", "y"]
    assert S.context_json(a, "repo_id").where("repo_id = 'r1'").first().json == '{"v":1}'
    ids = S.chunk_ids(spark.createDataFrame([("r", "f", 1, "c")], "repo_id string, file_path string, line_start int, content string")).first().point_id
    assert [len(x) for x in ids.split("-")] == [8, 4, 4, 4, 12]
    (tmp_path / "p.json").write_text('{"filename": "a", "status": "added", "patch": "@@"}\n{"filename": "b", "status": "removed"}\n')
    assert [r.filename for r in S.read_patches(spark, str(tmp_path / "p.json")).collect()] == ["a"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Route::get('/users', [UserController::class, 'index'])->name('users.index');", [("GET", "/users", "UserController", "index", "users.index", [])]),
        ("Route::post('x', 'A@store')->middleware(['auth', 'can:x']);", [("POST", "/x", "A", "store", None, ["auth", "can:x"])]),
        ("Route::match(['get', 'post'], '/m', InvokeController::class);", [("GET", "/m", "InvokeController", "__invoke", None, []), ("POST", "/m", "InvokeController", "__invoke", None, [])]),
        ("// Route::get('/no', 'A@b');\nRoute::get('/c', function () { return 1; });", [("GET", "/c", None, "closure", None, [])]),
        ("Route::prefix('admin')->middleware('auth')->group(function () { Route::group(['prefix' => 'v1', 'middleware' => ['x']], function () { Route::delete('/d', [K::class, 'e']); }); });", [("DELETE", "/admin/v1/d", "K", "e", None, ["auth", "x"])]),
        ("Route::controller(OrderController::class)->group(function () { Route::get('/o', 'show'); });", [("GET", "/o", "OrderController", "show", None, [])]),
        ("", []),
    ],
)
def test_routes(text, want):
    assert list(routes.walk(routes.tokens(text), "", [], None)) == want


def test_resources(spark):
    df = spark.createDataFrame([(1, "r.php", "Route::resource('photos', PhotoController::class);"), (2, "s.php", "Route::apiResource('photos', PhotoController::class);"), (3, "t.php", None)], "snapshot_id long, file_path string, content string")
    assert {r.snapshot_id: r["count"] for r in routes.routes(df).groupBy("snapshot_id").count().collect()} == {1: 7, 2: 5}


def stream(spark, tmp_path, rows, schema, f, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    q = f(s).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).orderBy("at").collect()


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_cache(spark, tmp_path):
    got = stream(spark, tmp_path, [("k", at(0), "a"), ("k", at(10), "b"), ("k", at(4000), "c")], "key string, at timestamp, value string", state.cached, "cache_rows")
    assert [(r.value, r.hit) for r in got] == [("a", False), ("a", True), ("c", False)]


def test_breaker(spark, tmp_path):
    rows = [("k", at(n), False) for n in range(6)] + [("k", at(70), True), ("k", at(71), True)]
    got = stream(spark, tmp_path, rows, "key string, at timestamp, ok boolean", state.breaker, "breaker_rows")
    assert [r.state for r in got] == ["closed"] * 5 + ["open", "half_open", "closed"]
    assert [r.allowed for r in got] == [True] * 5 + [False, True, True]


__all__ = ["F"]
