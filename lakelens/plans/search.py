from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from .registry import query, quoted, table

GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def grams(t: str) -> str:
    return GRAMS.replace("{t}", f"coalesce({t}, '')").replace("{{", "{").replace("}}", "}")


#: The longest plain word of a question, which symbol search looks for in search texts.
WORD = f"list_filter(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_]*'), lambda w: length(w) > 2 AND lower(w) NOT IN ({quoted(search.STOP)}))"
SYMBOLS = f"""
sq AS (SELECT qa_id AS query_id, {grams('question')} AS g, list_sort(list_transform({WORD}, lambda w: {{n: -length(w), l: lower(w)}}))[1].l AS word FROM qa_results WHERE qa_id % 100 = 0),
so AS (SELECT min(symbol_id) AS item_id, symbol_name AS name, qualified_name AS qualified, concat_ws(' ', symbol_name, signature, docstring) AS search_text FROM symbols GROUP BY ALL),
si AS (SELECT item_id, {grams('name')} AS a, {grams('qualified')} AS b, search_text FROM so),
sp AS (SELECT query_id, item_id, g, a, b, word, search_text, len(list_intersect(g, a)) AS na, len(list_intersect(g, b)) AS nb FROM sq, si),
ss AS (SELECT query_id, item_id, round(greatest(na::DOUBLE / greatest(1, len(g) + len(a) - na), nb::DOUBLE / greatest(1, len(g) + len(b) - nb)), 12) AS score, coalesce(search_text ILIKE '%' || word || '%', false) AS held FROM sp),
sr AS (SELECT query_id, item_id, CASE WHEN score = 0 THEN 0.5 ELSE score END AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM ss WHERE score >= 0.3 OR held) WHERE place <= 10)"""


def questions(spark, d):
    """Every row whose id is divisible by 100 is a query, against all rows."""
    return table(spark, d, "qa_results").where("qa_id % 100 = 0").select(F.col("qa_id").alias("query_id"), F.col("question").alias("text"))


def asked_symbols(spark, d):
    """Questions with the longest of their plain words, ties in alphabetical order."""
    plain = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*search.STOP))
    ordered = F.array_sort(F.transform(plain, lambda w: F.struct((-F.length(w)).alias("n"), F.lower(w).alias("l"))))
    return questions(spark, d).withColumn("word", F.get(ordered, F.lit(0))["l"])


def by_symbol(spark, d, k=10):
    s = table(spark, d, "symbols").select(F.col("symbol_id").alias("item_id"), F.col("symbol_name").alias("name"), F.col("qualified_name").alias("qualified"), F.concat_ws(" ", "symbol_name", "signature", "docstring").alias("search_text"))
    return search.symbol_search(asked_symbols(spark, d), s, 0.3, k)


@query("v1_trigram", f"WITH {SYMBOLS} SELECT query_id, item_id, round(score, 6) AS score, place::INTEGER AS place FROM sr")
def trigram(spark, d):
    """V1: symbols by the similarity of their name or qualified name, or by a word in their search text."""
    return by_symbol(spark, d).withColumn("score", F.round("score", 6))


VECTORS = """
n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM n),
p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, CASE WHEN q.n * i.n = 0 THEN 0.0 ELSE round(list_sum(list_transform(list_zip(q.v, i.v), lambda z: z[1] * z[2])) / (q.n * i.n), 12) END AS score FROM m q, m i WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM p)"""


def by_vector(spark, d, k):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_search(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), k).withColumn("score", F.round("score", 6))


@query("v2_cosine", f"WITH {VECTORS} SELECT query_id, item_id, round(score, 6) AS score, place::INTEGER AS place FROM r WHERE place <= 10")
def cosine(spark, d):
    return by_vector(spark, d, 10)


@query("v4_similar_vectors", f"WITH {VECTORS} SELECT query_id, item_id, round(score, 6) AS score, place::INTEGER AS place FROM r WHERE place <= 5")
def similar_vectors(spark, d):
    """V4: the five vectors most like each vector whose id is divisible by 100, itself included."""
    return by_vector(spark, d, 5)


KEYWORD = r"""
kq AS (SELECT qa_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda w: w <> '')) AS words FROM qa_results WHERE qa_id % 100 = 0 AND question IS NOT NULL),
ko AS (SELECT min(source_row_id) AS item_id, lower(coalesce(symbol_name, '')) AS name, lower(coalesce(content, '')) AS body FROM retrieved_sources GROUP BY symbol_name, content),
kw AS (SELECT query_id, item_id, round((len(list_filter(words, lambda w: contains(body, w))) + CASE WHEN len(list_filter(words, lambda w: contains(name, w))) > 0 THEN 2 ELSE 0 END)::DOUBLE / len(words), 12) AS score FROM kq, ko WHERE len(words) > 0),
kr AS (SELECT query_id, item_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM kw WHERE score > 0) WHERE place <= 10)"""


def by_keyword(spark, d, k=10):
    items = table(spark, d, "retrieved_sources").select(F.col("source_row_id").alias("item_id"), F.col("symbol_name").alias("name"), F.col("content").alias("text"))
    return search.keyword_search(questions(spark, d), items, k)


@query("v3_keyword", f"WITH {KEYWORD} SELECT query_id, item_id, round(score, 6) AS score, place::INTEGER AS place FROM kr")
def keyword(spark, d):
    """V3: words of the question that are part of an item, against all items."""
    return by_keyword(spark, d).withColumn("score", F.round("score", 6))


@query("v6_hybrid", f"""
WITH {SYMBOLS}, {KEYWORD},
a AS (SELECT query_id, coalesce(file_path, '') || ':' || coalesce(line_start, 0) AS place_key, sr.score, item_id, 0 AS list FROM sr JOIN symbols ON symbol_id = item_id),
b AS (SELECT query_id, coalesce(file_path, '') || ':' || coalesce(start_line, 0), kr.score, item_id, 1 FROM kr JOIN retrieved_sources ON source_row_id = item_id),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, place_key ORDER BY list, score DESC, item_id) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT query_id, place_key AS spot, round(score, 6) AS score, item_id, list, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place_key) AS place FROM u WHERE n = 1) WHERE place <= 15""")
def hybrid(spark, d):
    """V6: symbol hits and keyword hits by file and line; symbol hits win where both meet."""
    spot = lambda line: F.concat(F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(line, F.lit(0)).cast("string")).alias("spot")
    s = table(spark, d, "symbols").select(F.col("symbol_id").alias("item_id"), spot("line_start"))
    r = table(spark, d, "retrieved_sources").select(F.col("source_row_id").alias("item_id"), spot("start_line"))
    return search.hybrid(by_symbol(spark, d).join(s, "item_id"), by_keyword(spark, d).join(r, "item_id")).withColumn("score", F.round("score", 6))


@query("v7_deep_retrieval", f"""
WITH {KEYWORD}, h AS (SELECT * FROM kr WHERE place <= 7),
w AS (SELECT query_id, unnest(words) AS word, generate_subscripts(words, 1) AS word_no FROM (SELECT query_id, list_filter(words, lambda w: length(w) > 3) AS words FROM (
 SELECT qa_id AS query_id, list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: w <> '') AS words FROM qa_results WHERE qa_id % 100 = 0 AND question IS NOT NULL))),
c AS (SELECT query_id, word_no, item_id, row_number() OVER (PARTITION BY query_id, word_no ORDER BY item_id) AS n FROM w JOIN ko ON contains(name, w.word)),
x AS (SELECT query_id, item_id, min(word_no) AS place FROM c WHERE n <= 3 AND (query_id, item_id) NOT IN (SELECT (query_id, item_id) FROM h) GROUP BY 1, 2),
u AS (SELECT query_id, item_id, score, 0 AS list, place FROM h UNION ALL SELECT query_id, item_id, 0.5, 1, place FROM x)
SELECT query_id, item_id, round(score, 6) AS score, list, place::INTEGER AS place FROM (SELECT query_id, item_id, score, list, row_number() OVER (PARTITION BY query_id ORDER BY list, place, item_id) AS place FROM u) WHERE place <= 10""")
def deep(spark, d):
    """V7: the seven best keyword hits, and behind them items whose symbol's name holds a word of the question, three a word."""
    from pyspark.sql import Window

    words = F.filter(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), lambda w: F.length(w) > 3)
    # a name that holds a word holds its first four characters: the join is on those, not on all pairs
    w = questions(spark, d).select("query_id", F.posexplode(words).alias("pos", "word")).select("query_id", (F.col("pos") + 1).alias("word_no"), "word", F.left("word", F.lit(4)).alias("gram"))
    one = table(spark, d, "retrieved_sources").groupBy("symbol_name", "content").agg(F.min("source_row_id").alias("item_id")).select("item_id", F.lower("symbol_name").alias("name"))
    grams = one.where(F.length("name") > 3).select("item_id", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 3), lambda i: F.substring("name", i, F.lit(4))))).alias("gram"))
    c = w.join(grams, "gram").where(F.col("name").contains(F.col("word"))).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "word_no").orderBy("item_id"))).where("n <= 3")
    return search.deep_retrieval(by_keyword(spark, d, 7), c).withColumn("score", F.round("score", 6))


@query("f14_keywords")
def keywords(spark, d):
    """All questions; without SQL, for other engines do not know letters of all scripts; tested against a plain search."""
    q = table(spark, d, "qa_results").where("question IS NOT NULL")
    return q.select("qa_id", F.array_join(search.keywords(F.col("question")), " | ").alias("keywords")).where("keywords <> ''")
