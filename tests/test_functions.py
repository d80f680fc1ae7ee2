import pytest
from pyspark.sql import functions as F

from lakelens import schemas
from lakelens.functions import similarity as S
from lakelens.functions import text as X


def one(spark, column, **cells):
    names = list(cells)
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\rc", ["a", "b", "c"]), ("a\n\nb", ["a", "", "b"])])
def test_universal_lines(spark, text, want):
    assert one(spark, X.lines_universal(F.col("t")), t=text) == want == text.splitlines()


@pytest.mark.parametrize(("secret", "want"), [("abcdefghijklmnop", "abcd********mnop"), ("abcdef", "ab****"), ("a" * 12, "aa" + "*" * 10)])
def test_mask(spark, secret, want):
    assert one(spark, X.mask(F.col("t")), t=secret) == want


def test_redaction(spark):
    t = "x = ghp_" + "a" * 36 + "; password = 'hunter22'; AKIA" + "B" * 16
    assert one(spark, X.redact_tokens(F.col("t")), t=t) == "x = [REDACTED]; [REDACTED]; [REDACTED]"


@pytest.mark.parametrize(
    ("path", "size", "want"),
    [("a/b.py", 10, None), ("a/b.py", 2 << 20, "too_large"), ("x.png", 1, "binary"), ("js/a.min.js", 1, "minified_or_bundle"), ("vendor/x.php", 1, "vendor_or_build_dir"), ("a/Build/x.go", 1, "vendor_or_build_dir"), ("Makefile", 1, "unsupported_language"), ("a/x.yaml", 1, None), (".env", 1, "unsupported_language")],
)
def test_skip_reason(spark, path, size, want):
    assert one(spark, X.path_skip_reason(F.col("p"), F.col("n").cast("long")), p=path, n=str(size)) == want


def test_match_lines(spark):
    def places(p, t):
        return one(spark, X.match_lines(F.regexp_extract_all(F.col("t"), F.lit(p), F.lit(0)), F.split("t", p, -1)), t=t)

    assert places(r"e(val)\(", "eval(\n\n x eval( eval(\nnone") == [1, 3, 3]
    assert places("(?s)a.b", "a\nb\na\nb") == [1, 3]
    assert places("zz", "") == []


def test_trigrams(spark):
    a, b = S.trigrams(F.lit("word")), S.trigrams(F.lit("two words"))
    got = spark.range(1).select((F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("s")).first().s
    assert round(got, 4) == 0.3636


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0]


def test_split_valid(spark):
    df = spark.createDataFrame([(1, "high", "x"), (2, "odd", "x"), (3, None, "x")], "id int, severity string, other string")
    good, bad = schemas.split_valid(df)
    assert sorted(r.id for r in good.collect()) == [1, 3]
    assert [(r.id, r.failed) for r in bad.collect()] == [(2, ["severity"])]


def test_paths_like_posix(spark):
    import posixpath

    paths = ["", ".", "a", "a/b/../c", "../a", "../../a/..", "/..", "/../a", "/a/./b//c/", "a/..", "a/../..", "./x", "//a"]
    got = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string").select("k", X.normpath(F.col("p")).alias("n"), X.join_path(F.lit("r"), F.col("p")).alias("j")).orderBy("k").collect()
    assert [r.n for r in got] == [posixpath.normpath(p).replace("//a", "/a") for p in paths]
    assert [r.j for r in got] == [posixpath.join("r", p) for p in paths]


def test_addresses_and_case(spark):
    urls = ["https://example.com/a/b.git", "git@example.com:a/b", "https://example.com/a/b/tree/main", "nothing"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(X.owner_and_name(F.col("u")).alias("x"), X.is_upper(F.col("u")).alias("up")).collect()
    assert [(r.x.owner, r.x.name) for r in got] == [("a", "b"), ("a", "b"), ("a", "b"), (None, None)] and not any(r.up for r in got)
