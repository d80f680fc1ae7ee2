"""Answers checked against their sources: quotes, sections, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def quote_found(quote: Column, source: Column) -> Column:
    """As it stands, with white space squashed, or with case folded as well."""
    q, s = X.squash(quote), X.squash(source)
    return F.coalesce(source.contains(quote) | s.contains(q) | F.lower(s).contains(F.lower(q)), F.lit(False))


def short_quote_found(quote: Column, source: Column) -> Column:
    """Quotes of up to three words also pass if each word is one of the source."""
    words = F.split(X.squash(quote), " ")
    return quote_found(quote, source) | (F.size(words) <= 3) & (F.size(F.array_except(words, F.split(X.squash(source), " "))) == 0)


def checked_quotes(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Each quoted span with its source, and why it fails: no such source, or no such text."""
    q = answers.select("qa_id", "repo_id", F.posexplode("quoted_spans").alias("span_no", "span")).select("qa_id", "repo_id", "span_no", F.col("span.source_id").alias("source_index"), F.col("span.quoted_text").alias("quote"), F.col("span.verified").alias("claimed"))
    s = sources.groupBy("qa_id", "source_index").agg(F.min_by(F.struct("content", "file_path", "score"), "source_row_id").alias("s"))
    j = q.join(s, ["qa_id", "source_index"], "left")
    ok = quote_found(F.col("quote"), F.col("s.content"))
    return j.select("qa_id", "repo_id", "span_no", "source_index", "claimed", F.col("s.file_path").alias("file_path"), F.col("s.score").alias("score"), F.when(F.col("s").isNull(), "unknown_source").when(ok, "verified").otherwise("not_in_source").alias("verdict"), (F.col("quote") != "").alias("has_quote"))


def tiers(checked: DataFrame) -> DataFrame:
    """Evidence of each answer and its tier, by verified spans, files and mean score of the cited sources."""
    g = checked.groupBy("qa_id").agg(
        F.countDistinct("source_index").alias("cited"), F.countDistinct("file_path").alias("files"), F.avg("score").alias("mean_score"),
        F.count_if(F.col("verdict") == "verified").alias("verified"), F.count(F.lit(1)).alias("spans"),
    )
    rate = F.col("verified") / F.col("spans")
    mean = F.coalesce("mean_score", F.lit(0.0))
    tier = (
        F.when((F.col("cited") == 0) | (F.col("verified") == 0), "none").when(rate < 0.5, "low")
        .when((F.col("verified") >= 2) & (F.col("files") >= 2) & (rate >= 0.75) & (mean >= 0.5), "high").when(mean < 0.3, "low").otherwise("medium")
    )
    return g.select("qa_id", "cited", "files", "verified", "spans", tier.alias("tier"))


SECTIONS = "struct<sections: array<struct<text: string, source_ids: array<int>>>, unknowns: array<string>>"


def repaired(raw: Column) -> Column:
    """An answer's JSON by the first reading that works: as it stands, from a fence, from the outer braces, with trailing commas dropped."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    mended = F.regexp_replace(outer, r",\s*([}\]])", "$1")
    tries = [F.from_json(t, SECTIONS) for t in (raw, fenced, outer, mended)]
    return F.coalesce(*[F.when(t["sections"].isNotNull(), t) for t in tries])


def sections(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sections of structured answers with the source ids they name that do not exist."""
    s = answers.select("qa_id", repaired(F.col("answer_text")).alias("a")).where("a IS NOT NULL").select("qa_id", F.posexplode("a.sections").alias("section_no", "section"))
    known = sources.groupBy("qa_id").agg(F.collect_set("source_index").alias("known"))
    j = s.join(known, "qa_id", "left")
    ids = F.coalesce("section.source_ids", F.array().cast("array<int>"))
    return j.select("qa_id", "section_no", F.length("section.text").alias("n_chars"), F.size(ids).alias("cited"), F.size(F.array_except(ids, F.coalesce("known", F.array().cast("array<int>")))).alias("invalid"))


def parsed_or_plain(answers: DataFrame) -> DataFrame:
    """qa_id, whether the outermost braces of the answer hold JSON, that JSON, and otherwise a summary of its text. Null answers give no row."""
    a = answers.where("answer_text IS NOT NULL").select("qa_id", "answer_text", F.regexp_extract("answer_text", r"(?s)\{.*\}", 0).alias("json"))
    ok = (F.col("json") != "") & F.try_parse_json("json").isNotNull()
    return a.select("qa_id", ok.alias("parsed"), F.when(ok, F.col("json")).alias("json"), F.when(~ok, F.left("answer_text", F.lit(200))).alias("summary"))


def derived_tiers(answers: DataFrame) -> DataFrame:
    """The tier of an answer by its own citations: unknowns without any is insufficient, three of two sources high, one medium."""
    got = parsed_or_plain(answers).withColumn("a", F.from_json("json", "struct<sections: array<struct<source_ids: array<string>>>, unknowns: array<string>>"))
    ids = F.coalesce(F.flatten(F.transform("a.sections", lambda s: F.coalesce(s["source_ids"], F.array().cast("array<string>")))), F.array().cast("array<string>"))
    unknowns = F.coalesce(F.size("a.unknowns"), F.lit(0))
    n, different = F.size(ids), F.size(F.array_distinct(ids))
    tier = F.when((unknowns > 0) & (n == 0), "insufficient").when((n >= 3) & (different >= 2), "high").when(n >= 1, "medium").otherwise("low")
    return got.select("qa_id", "parsed", n.alias("citations"), different.alias("sources"), F.greatest(unknowns, F.lit(0)).alias("unknowns"), tier.alias("tier"))


def validated_sections(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sections of structured answers with their verdict.

    A section needs text and a source that exists; its quotes are the answer's spans of those sources. With a
    verified quote it is kept, without quotes kept as unverified, with none that holds rejected.
    """
    none = F.array().cast("array<int>")
    s = answers.select("qa_id", repaired(F.col("answer_text")).alias("a")).where("a IS NOT NULL").select("qa_id", F.posexplode("a.sections").alias("section_no", "section"))
    known = sources.groupBy("qa_id").agg(F.collect_set("source_index").alias("known"))
    ids = F.coalesce("section.source_ids", none)
    y = s.join(known, "qa_id", "left").select("qa_id", "section_no", F.coalesce("section.text", F.lit("")).alias("text"), F.size(ids).alias("cited"), F.filter(ids, lambda i: F.array_contains(F.coalesce("known", none), i)).alias("good"))
    spans = checked_quotes(answers, sources).where("has_quote").select("qa_id", "span_no", F.col("source_index").alias("source"), "verdict")
    z = y.select("qa_id", "section_no", F.explode(F.array_distinct("good")).alias("source")).join(spans, ["qa_id", "source"]).groupBy("qa_id", "section_no").agg(F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("verdict") == "verified").alias("verified"))
    j = y.join(z, ["qa_id", "section_no"], "left").withColumn("quotes", F.coalesce("quotes", F.lit(0))).withColumn("verified", F.coalesce("verified", F.lit(0)))
    verdict = (
        F.when(F.col("text") == "", "no_text").when(F.col("cited") == 0, "no_sources").when(F.size("good") == 0, "invalid_sources")
        .when(F.col("quotes") == 0, "unverified").when(F.col("verified") > 0, "verified").otherwise("rejected")
    )
    return j.select("qa_id", "section_no", "cited", (F.col("cited") - F.size("good")).alias("invalid"), "quotes", "verified", verdict.alias("verdict"))


def degraded(answers: DataFrame, sources: DataFrame, shown: int = 3) -> DataFrame:
    """Answers that are no JSON, reduced to their first sources."""
    lost = parsed_or_plain(answers).where("NOT parsed").select("qa_id")
    first = sources.where("source_index IS NOT NULL").groupBy("qa_id").agg(F.slice(F.array_sort(F.collect_set("source_index")), 1, shown).alias("first"))
    return lost.join(first, "qa_id", "left").select("qa_id", F.lit("none").alias("tier"), F.coalesce(F.array_join("first", ","), F.lit("")).alias("shown"))
