"""Retrieval: symbol, keyword and vector search, and their merge.

A stated set of queries is compared with all items in blocks: items are dealt into parts of
bounded size and queries into blocks, each pair of both is one task, and a task hands on only
the best hits of each of its queries. Nothing is left out by a candidate index, so results are
exact; what is shuffled is each item once a block of queries, and a few hits a query and part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S

ITEM_ROWS, QUERY_ROWS, DIGITS = 20_000, 1024, 12
HITS = "query_id long, item_id long, score double"
_HITS = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])
# fixed values: words that carry no meaning in a question
STOP = "the a an is are was were be been how what where when why which who does do did has have had in on at to for of with by can could would should will this that these those it its and or but if then else my your our their i you we they".split()
# fixed values: names and words of a question, in the order in which they are looked for
PATHS = r"[\w./\\-]+\.(?:php|py|js|tsx|ts|jsx|java|go|rs|rb)"
QUALIFIED = r"\b\w+(?:(?:::|\.|\\)\w+)+\b"
DUNDERS = r"__\w+__"
NUMBERED = r"\b[A-Za-z]+\d+\w*\b|\b\d+[A-Za-z]+\w*\b"
CAPITALS = r"\b[A-Z]{2,}\b"
CAMEL = r"\b[a-z]+(?:[A-Z][a-z]+)+\b|\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"
SNAKE = r"\b\w+(?:_\w+)+\b"
PLAIN = r"\b[A-Za-z][A-Za-z0-9]*\b"


def keywords(text: Column, most: int = 10) -> Column:
    """Names and words of a question, the longest first: paths with their stems, qualified names with their parts, dunders, names with digits, capitals, camel and snake names with their parts, plain words. Letters are those of Unicode."""

    def find(pattern: str, within: Column = text) -> Column:
        return F.regexp_extract_all(within, F.lit("(?U)" + pattern), F.lit(0))

    def over(words: Column, n: int) -> Column:
        return F.filter(words, lambda x: F.length(x) > n)

    paths, qualified, camel, snake = find(PATHS), find(QUALIFIED), find(CAMEL), find(SNAKE)
    stems = F.transform(paths, lambda x: F.regexp_extract(x, r"([^/\\]*)\.[^.]*$", 1))
    parts = {
        "qualified": over(F.flatten(F.transform(qualified, lambda x: F.split(x, r"::|\\|\."))), 1),
        "camel": over(F.flatten(F.transform(camel, lambda x: find("[A-Z]?[a-z]+", x))), 2),
        "snake": over(F.flatten(F.transform(snake, lambda x: F.split(x, "_"))), 2),
    }
    every = F.concat(paths, stems, qualified, parts["qualified"], find(DUNDERS), find(NUMBERED), find(CAPITALS), camel, parts["camel"], snake, parts["snake"], over(find(PLAIN), 2))
    kept = F.array_distinct(F.filter(every, lambda x: (x != "") & ~F.lower(x).isin(*STOP)))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct((-F.length(x)).alias("n"), F.lower(x).alias("l"), x.alias("k"))))
    return F.slice(F.transform(ordered, lambda x: x["k"]), 1, most)


def top(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return hits.withColumn("place", place).where(F.col("place") <= k)


def best_of(scores: np.ndarray, ids: np.ndarray, hit: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best hits, ties by id; all that tie with the last one are weighed."""
    at = np.flatnonzero(hit)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def in_blocks(queries: DataFrame, items: DataFrame, prepare: Callable[[pa.Table], Callable[[dict], tuple[np.ndarray, np.ndarray]]], k: int, lift: float = 0.0) -> DataFrame:
    """The k best items of each query. prepare(items) gives a function of one query's columns to scores and hits of all of them.

    Scores are rounded to DIGITS places before they are ranked, so equal items tie; a score of zero becomes `lift` after that.
    """
    parts, blocks = (max(1, math.ceil(df.count() / n)) for df, n in ((items, ITEM_ROWS), (queries, QUERY_ROWS)))
    i = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cell = (F.col("block") * parts + F.col("part")).cast("int")
    i, q = i.withColumn("cell", cell).drop("part", "block"), q.withColumn("cell", cell).drop("part", "block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            score, ids = prepare(left), left["item_id"].to_numpy()
            for row in right.to_pylist():
                scores, hit = score(row)
                scores = np.round(scores, DIGITS)
                out += [(row["query_id"], int(ids[p]), float(scores[p])) for p in best_of(scores, ids, hit, k)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _HITS, strict=True)], schema=_HITS)

    cells = parts * blocks
    hits = i.repartitionById(cells, "cell").groupBy("cell").cogroup(q.repartitionById(cells, "cell").groupBy("cell")).applyInArrow(run, HITS)
    best = top(hits, k)
    return best.withColumn("score", F.when(F.col("score") == 0, lift).otherwise(F.col("score"))) if lift else best


def postings(lists: list[list[str]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entry -> positions of the lists that hold it, and the lengths of the lists."""
    at: dict[str, list[int]] = {}
    for k, own in enumerate(lists):
        for x in own or ():
            at.setdefault(x, []).append(k)
    return {x: np.array(p) for x, p in at.items()}, np.array([len(own or ()) for own in lists])


def _like(pattern: str) -> Callable[[str], bool]:
    """A test for `%pattern%` as SQL reads it, on text in lower case."""
    import re

    if "_" not in pattern and "%" not in pattern:
        return lambda text: pattern in text
    test = re.compile("".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in pattern), re.S).search
    return lambda text: test(text) is not None


def symbol_search(queries: DataFrame, symbols: DataFrame, least: float = 0.3, k: int = 10) -> DataFrame:
    """queries(query_id, text, word), symbols(item_id, name, qualified, search_text) -> the k most similar symbols.

    A symbol is a hit if the trigrams of its name or qualified name are similar enough to the query, or if its
    search text holds the query's word; the score is the greater similarity, 0.5 in place of zero after the cut.
    Symbols of equal names and texts are one entry, named by their smallest id. A null text or word finds nothing.
    """
    one = symbols.groupBy("name", "qualified", "search_text").agg(F.min("item_id").alias("item_id"))
    grams = one.select("item_id", S.trigrams(F.coalesce("name", F.lit(""))).alias("a"), S.trigrams(F.coalesce("qualified", F.lit(""))).alias("b"), F.lower("search_text").alias("low"))
    asked = queries.select("query_id", S.trigrams(F.coalesce("text", F.lit(""))).alias("g"), F.lower("word").alias("word"))

    def prepare(rows: pa.Table):
        sides = [postings(rows[c].to_pylist()) for c in "ab"]
        texts, known = rows["low"].to_pylist(), {}

        def score(q: dict):
            best = np.zeros(rows.num_rows)
            for at, sizes in sides:
                shared = np.zeros(rows.num_rows)
                for g in q["g"]:
                    if g in at:
                        shared[at[g]] += 1
                best = np.maximum(best, shared / np.maximum(1, len(q["g"]) + sizes - shared))
            word = q["word"]
            if word and word not in known:
                test = _like(word)
                known[word] = np.array([x is not None and test(x) for x in texts], bool)
            return best, (best >= least) | known[word] if word else best >= least

        return score

    return in_blocks(asked, grams, prepare, k, 0.5)


def keyword_search(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """queries(query_id, text), items(item_id, name, text): different words of the question that are part of the item's text, two more if its name holds one, over the number of words.

    Items of the same name and text are one entry, named by their smallest id; a question without words finds nothing.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    asked = queries.select("query_id", words.alias("words")).where(F.size("words") > 0)
    one = items.groupBy("name", "text").agg(F.min("item_id").alias("item_id"))
    low = one.select("item_id", F.lower(F.coalesce("name", F.lit(""))).alias("name"), F.lower(F.coalesce("text", F.lit(""))).alias("body"))

    def prepare(rows: pa.Table):
        bodies, names, known = rows["body"].to_pylist(), rows["name"].to_pylist(), {}

        def holds(word: str) -> tuple[np.ndarray, np.ndarray]:
            if word not in known:
                known[word] = np.array([word in x for x in bodies], bool), np.array([word in x for x in names], bool)
            return known[word]

        def score(q: dict):
            each = [holds(w) for w in q["words"]]
            total = np.sum([b for b, _ in each], axis=0) + 2.0 * np.any([n for _, n in each], axis=0)
            return total / len(each), total > 0

        return score

    return in_blocks(asked, low, prepare, k)


def vector_search(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """queries(query_id, vector), items(item_id, vector) -> the k items of highest cosine for each query, exactly. A null or zero vector, or one of another length, has cosine 0."""

    def prepare(rows: pa.Table):
        own = rows["vector"].to_pylist()
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(v) for v in own if v}:
            at = np.array([k for k, v in enumerate(own) if v and len(v) == n])
            m = np.array([[0.0 if x is None else x for x in own[k]] for k in at], float)
            norms = np.linalg.norm(m, axis=1)
            by_size[n] = at, m / np.where(norms == 0, 1, norms)[:, None]

        def score(q: dict):
            scores, v = np.zeros(len(own)), np.array([0.0 if x is None else x for x in q["vector"] or ()], float)
            size = np.linalg.norm(v)
            if size and len(v) in by_size:
                at, m = by_size[len(v)]
                scores[at] = m @ (v / size)
            return scores, np.ones(len(own), bool)

        return score

    return in_blocks(queries.select("query_id", "vector"), items.select("item_id", "vector"), prepare, k)


def search_with_fallback(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """queries(query_id, text, vector), items(item_id, name, text, vector): by vectors where the query and some item have one, else by keywords. Items without a vector are no hits of the former."""
    embedded = items.where("vector IS NOT NULL")
    if embedded.isEmpty():
        return keyword_search(queries, items, k)
    first = vector_search(queries.where("vector IS NOT NULL"), embedded, k)
    return first.unionByName(keyword_search(queries.where("vector IS NULL"), items, k))


def stored_search(queries: DataFrame, path: str, k: int = 10, repo_id: str | None = None) -> DataFrame:
    """The k vectors of a stored table (point_id, repo_id, vector) most like each query; a repository reads its own partition only."""
    stored = queries.sparkSession.read.parquet(path)
    if repo_id is not None:
        stored = stored.where(F.col("repo_id") == repo_id)
    numbered = stored.select("point_id", "vector", F.xxhash64("point_id").alias("item_id"))
    return vector_search(queries, numbered, k).join(numbered.select("item_id", "point_id"), "item_id").select("query_id", "point_id", "score", "place")


def hybrid(first: DataFrame, second: DataFrame, k: int = 15) -> DataFrame:
    """Union of two hit lists (query_id, item_id, score, spot); the first wins where both have a spot; ranked anew and cut."""
    both = first.select("query_id", "spot", "score", "item_id", F.lit(0).alias("list")).unionAll(second.select("query_id", "spot", "score", "item_id", F.lit(1).alias("list")))
    rest = F.struct("list", F.negate("score").alias("worse"), "item_id")
    one = both.groupBy("query_id", "spot").agg(F.min_by(F.struct("score", "item_id", "list"), rest).alias("x")).select("query_id", "spot", "x.score", "x.item_id", "x.list")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "spot"))
    return one.withColumn("place", place).where(F.col("place") <= k)


def deep_retrieval(hits: DataFrame, named: DataFrame, k: int = 10, fixed: float = 0.5) -> DataFrame:
    """hits(query_id, item_id, score, place), named(query_id, item_id, word_no): items whose symbol is named in the question stand behind the hits with a fixed score, without ranking anew; cut at k."""
    extra = named.groupBy("query_id", "item_id").agg(F.min("word_no").alias("place")).join(hits, ["query_id", "item_id"], "left_anti")
    both = hits.select("query_id", "item_id", "score", F.lit(0).alias("list"), "place").unionAll(extra.select("query_id", "item_id", F.lit(fixed).alias("score"), F.lit(1).alias("list"), "place"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("list", "place", "item_id"))
    return both.withColumn("place", order).where(F.col("place") <= k)
