from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from .registry import query, table

SQUASH = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
Q, S = SQUASH.format("quote"), SQUASH.format("content")
CHECKED = f"""
e AS (SELECT qa_id, repo_id, unnest(quoted_spans) AS span, generate_subscripts(quoted_spans, 1) - 1 AS span_no FROM qa_results),
q AS (SELECT qa_id, repo_id, span_no::INTEGER AS span_no, span.source_id AS source_index, span.quoted_text AS quote FROM e),
s AS (SELECT qa_id, source_index, arg_min({{c: content, f: file_path, s: score}}, source_row_id) AS s, true AS here FROM retrieved_sources GROUP BY 1, 2),
j AS (SELECT q.*, s.s.c AS content, s.s.f AS file_path, s.s.s AS score, s.here FROM q LEFT JOIN s ON s.qa_id = q.qa_id AND s.source_index = q.source_index),
c AS (SELECT *, CASE WHEN here IS NULL THEN 'unknown_source' WHEN coalesce(contains(content, quote) OR contains({S}, {Q}) OR contains(lower({S}), lower({Q})), false) THEN 'verified' ELSE 'not_in_source' END AS verdict FROM j)"""


def checked(spark, d):
    return answers.checked_quotes(table(spark, d, "qa_results"), table(spark, d, "retrieved_sources"))


@query("a1_quote_match", f"WITH {CHECKED} SELECT qa_id, span_no, source_index, file_path, verdict FROM c")
def quote_match(spark, d):
    return checked(spark, d).select("qa_id", "span_no", "source_index", "file_path", "verdict")


@query("a4_quote_totals", f"WITH {CHECKED} SELECT repo_id, verdict, count(*) AS spans FROM c GROUP BY 1, 2")
def totals(spark, d):
    return checked(spark, d).groupBy("repo_id", "verdict").agg(F.count(F.lit(1)).alias("spans"))


@query("a7_tiers", f"""
WITH {CHECKED}, g AS (SELECT qa_id, count(DISTINCT source_index) AS cited, count(DISTINCT file_path) AS files, coalesce(avg(score), 0) AS m, count(*) FILTER (verdict = 'verified') AS verified, count(*) AS spans FROM c GROUP BY 1)
SELECT qa_id, cited, files, verified, spans, CASE WHEN cited = 0 OR verified = 0 THEN 'none' WHEN verified::DOUBLE / spans < 0.5 THEN 'low' WHEN verified >= 2 AND files >= 2 AND verified::DOUBLE / spans >= 0.75 AND m >= 0.5 THEN 'high' WHEN m < 0.3 THEN 'low' ELSE 'medium' END AS tier FROM g""")
def tiers(spark, d):
    return answers.tiers(checked(spark, d))


@query("a6_sections", r"""
WITH p AS (SELECT qa_id, from_json(answer_text, '{"sections":[{"text":"VARCHAR","source_ids":["INTEGER"]}],"unknowns":["VARCHAR"]}') AS a FROM qa_results WHERE json_valid(answer_text) AND starts_with(trim(answer_text), '{') AND json_type(answer_text, '$.sections') = 'ARRAY'),
s AS (SELECT qa_id, unnest(a.sections) AS section, generate_subscripts(a.sections, 1) - 1 AS section_no FROM p), k AS (SELECT qa_id, list(DISTINCT source_index) AS known FROM retrieved_sources GROUP BY 1)
SELECT s.qa_id, section_no::INTEGER AS section_no, length(section.text)::INTEGER AS n_chars, len(coalesce(section.source_ids, []))::INTEGER AS cited, len(list_filter(list_distinct(coalesce(section.source_ids, [])), lambda x: NOT list_contains(coalesce(k.known, []), x)))::INTEGER AS invalid FROM s LEFT JOIN k USING (qa_id)""")
def sections(spark, d):
    return answers.sections(table(spark, d, "qa_results"), table(spark, d, "retrieved_sources"))


@query("j20_cited_sources", """
SELECT source_row_id, qa_id, source_index, file_path FROM retrieved_sources r WHERE EXISTS (SELECT 1 FROM (SELECT qa_id, unnest(quoted_spans) AS s FROM qa_results) q WHERE q.qa_id = r.qa_id AND q.s.source_id = r.source_index)""")
def cited(spark, d):
    spans = table(spark, d, "qa_results").select("qa_id", F.explode("quoted_spans").alias("s")).select("qa_id", F.col("s.source_id").alias("source_index"))
    return table(spark, d, "retrieved_sources").join(spans, ["qa_id", "source_index"], "left_semi").select("source_row_id", "qa_id", "source_index", "file_path")


@query("so1_best_source_per_place", """
SELECT qa_id, file_path, start_line, source_row_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, source_row_id) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY qa_id, file_path, start_line ORDER BY source_type, source_row_id) AS rn FROM retrieved_sources) WHERE rn = 1) WHERE place <= 15""")
def best_source(spark, d):
    """Trigram hits win over vector hits at the same place; the rest is ranked by score, fifteen at most."""
    from pyspark.sql import Window

    s = table(spark, d, "retrieved_sources")
    one = s.withColumn("rn", F.row_number().over(Window.partitionBy("qa_id", "file_path", "start_line").orderBy("source_type", "source_row_id"))).where("rn = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("qa_id").orderBy(F.desc("score"), "source_row_id"))).where("place <= 15").select("qa_id", "file_path", "start_line", "source_row_id", "place")


@query("a5_citation_bounds", """
SELECT r.source_row_id, f.snapshot_id IS NOT NULL AS file_known, coalesce(r.start_line >= 1 AND r.end_line >= r.start_line AND r.end_line <= len(string_split(f.content, chr(10))), false) AS in_bounds FROM retrieved_sources r LEFT JOIN source_files f USING (snapshot_id)""")
def bounds(spark, d):
    f = table(spark, d, "source_files").select("snapshot_id", F.size(F.split("content", "\n", -1)).alias("n"), F.lit(True).alias("here"))
    j = table(spark, d, "retrieved_sources").join(f, "snapshot_id", "left")
    ok = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.col("n"))
    return j.select("source_row_id", F.coalesce("here", F.lit(False)).alias("file_known"), F.coalesce(ok, F.lit(False)).alias("in_bounds"))


PARSED = r"""
o AS (SELECT qa_id, answer_text, regexp_extract(answer_text, '\{.*\}', 0, 's') AS j FROM qa_results WHERE answer_text IS NOT NULL),
v AS (SELECT *, j <> '' AND json_valid(j) AS ok FROM o),
t AS (SELECT qa_id, ok, CASE WHEN ok THEN list_transform(json_extract(j, '$.sections[*].source_ids[*]'), lambda x: x::VARCHAR) ELSE [] END AS ids, CASE WHEN ok THEN coalesce(json_array_length(j, '$.unknowns'), 0) ELSE 0 END AS unknowns FROM v)"""


@query("a8_derived_tiers", f"""
WITH {PARSED} SELECT qa_id, ok AS parsed, len(ids)::INTEGER AS citations, len(list_distinct(ids))::INTEGER AS sources, unknowns::INTEGER AS unknowns,
CASE WHEN unknowns > 0 AND len(ids) = 0 THEN 'insufficient' WHEN len(ids) >= 3 AND len(list_distinct(ids)) >= 2 THEN 'high' WHEN len(ids) >= 1 THEN 'medium' ELSE 'low' END AS tier FROM t""")
def derived(spark, d):
    """The tier of every answer by its own citations; an answer that is no JSON counts as plain text."""
    return answers.derived_tiers(table(spark, d, "qa_results"))


@query("f20_plain_answers", f"""
WITH {PARSED} SELECT v.qa_id, v.ok AS parsed, CASE WHEN v.ok THEN NULL WHEN length(answer_text) > 200 THEN left(answer_text, 200) ELSE answer_text END AS summary FROM v""")
def plain_answers(spark, d):
    """The outermost braces of an answer if they hold JSON, else its text with a summary of 200 characters."""
    return answers.parsed_or_plain(table(spark, d, "qa_results")).select("qa_id", "parsed", "summary")


VALIDATED = f"""
{CHECKED}, p AS (SELECT qa_id, from_json(answer_text, '{{"sections":[{{"text":"VARCHAR","source_ids":["INTEGER"]}}],"unknowns":["VARCHAR"]}}') AS a FROM qa_results WHERE json_valid(answer_text) AND starts_with(trim(answer_text), '{{') AND json_type(answer_text, '$.sections') = 'ARRAY'),
x AS (SELECT qa_id, unnest(a.sections) AS section, (generate_subscripts(a.sections, 1) - 1)::INTEGER AS section_no FROM p), k AS (SELECT qa_id, list(DISTINCT source_index) AS known FROM retrieved_sources GROUP BY 1),
y AS (SELECT x.qa_id, section_no, coalesce(section.text, '') AS text, coalesce(section.source_ids, []) AS ids, list_filter(coalesce(section.source_ids, []), lambda i: list_contains(coalesce(known, []), i)) AS good FROM x LEFT JOIN k USING (qa_id)),
z AS (SELECT qa_id, section_no, count(*) AS quotes, count(*) FILTER (verdict = 'verified') AS verified FROM (SELECT DISTINCT y.qa_id, section_no, c.span_no, c.verdict FROM y JOIN c ON c.qa_id = y.qa_id AND list_contains(y.good, c.source_index) WHERE c.quote <> '') GROUP BY 1, 2)"""


@query("a6_validated_sections", f"""
WITH {VALIDATED} SELECT y.qa_id, y.section_no, len(ids)::INTEGER AS cited, (len(ids) - len(good))::INTEGER AS invalid, coalesce(quotes, 0) AS quotes, coalesce(verified, 0) AS verified,
CASE WHEN text = '' THEN 'no_text' WHEN len(ids) = 0 THEN 'no_sources' WHEN len(good) = 0 THEN 'invalid_sources' WHEN coalesce(quotes, 0) = 0 THEN 'unverified' WHEN verified > 0 THEN 'verified' ELSE 'rejected' END AS verdict FROM y LEFT JOIN z ON z.qa_id = y.qa_id AND z.section_no = y.section_no""")
def validated(spark, d):
    """Sections with the quotes of the sources they cite: kept as verified or unverified, or dropped with the reason."""
    return answers.validated_sections(table(spark, d, "qa_results"), table(spark, d, "retrieved_sources"))


@query("a11_degraded_answers", f"""
WITH {PARSED}, r AS (SELECT qa_id, list_sort(list(DISTINCT source_index))[:3] AS first FROM retrieved_sources WHERE source_index IS NOT NULL GROUP BY 1)
SELECT t.qa_id, 'none' AS tier, array_to_string(coalesce(first, []), ',') AS shown FROM t LEFT JOIN r USING (qa_id) WHERE NOT ok""")
def degraded(spark, d):
    """Answers that are no JSON, shown as their first three sources."""
    return answers.degraded(table(spark, d, "qa_results"), table(spark, d, "retrieved_sources"))
