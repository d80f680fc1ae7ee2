"""Findings: deduplicated, scored, grouped and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: sensitivity of data kinds, width of flows, exposure of places, weight of severities
SENSITIVITY = {"credentials": 95, "payment_data": 90, "health_data": 95, "student_data": 85, "logs": 40, "public_data": 10, "configuration": 50}
EXPOSURE = {"internet-facing": 90, "authenticated": 60, "internal": 30}
SAFETY = {"critical": 20, "high": 12, "medium": 6, "low": 3, "info": 1}
RANK = {"critical": 3, "warning": 2, "info": 1}
DOWN = {"high": "medium", "medium": "low", "low": "unknown", "unknown": "unknown"}


def mapped(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def has(text: Column, *words: str) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | text.contains(w)
    return test


def dedup_by_region(findings: DataFrame) -> DataFrame:
    """Per rule, file and block of ten lines the most severe finding, then the last line, then the smallest id."""
    region = F.floor(F.col("start_line") / 10) * 10
    order = [F.desc(F.coalesce(mapped(RANK, F.col("severity")), F.lit(0))), F.desc("start_line"), F.asc("match_id")]
    w = Window.partitionBy("rule_id", "file_path", "region").orderBy(*order)
    return findings.withColumn("region", region.cast("long")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def dedup_by_key(matches: DataFrame) -> DataFrame:
    """Per rule, symbol and folder one finding (attributes of the smallest id) with the number of its instances."""
    key = F.sha2(F.concat_ws("|", "rule_id", F.lit(""), F.lit(""), F.coalesce("symbol", F.lit("")), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)), 256)
    first = F.min_by(F.struct("category", "severity", "confidence", "title"), F.col("match_id"))
    return matches.groupBy(key.alias("dedupe_key")).agg(F.count(F.lit(1)).alias("instances"), F.min("match_id").alias("first_match"), first.alias("a")).select("dedupe_key", "first_match", "a.category", "a.severity", "a.confidence", "a.title", "instances")


def complete(path: Column, reason: Column, start: Column, end: Column, snippet: Column) -> Column:
    return F.coalesce((F.length(path) > 0) & (F.length(reason) > 0) & (start > 0) & (end > 0) & (F.length(F.trim(snippet)) > 0), F.lit(False))


def impact(data_types: Column, rule_name: Column, snippet: Column) -> tuple[Column, Column]:
    """Score and flow: the most sensitive kind of data (unknown kinds count 50) and how far it flows."""
    low, name = F.lower(snippet), F.lower(rule_name)
    most = F.coalesce(F.array_max(F.transform(data_types, lambda t: F.coalesce(mapped(SENSITIVITY, F.lower(t)), F.lit(50)))), F.lit(0))
    flow = F.when(has(low, "console.log", "print(", "log(", "logger."), "logged").when(has(low, "http", "api", "fetch", "axios", "requests."), "third_party").when(has(name, "secret", "key"), "direct").otherwise("internal")
    width = mapped({"direct": 90, "logged": 70, "third_party": 60, "internal": 30}, flow)
    return (most * F.lit(0.6) + width * F.lit(0.4)).cast("int"), flow


def exploitability(path: Column, snippet: Column) -> tuple[Column, Column]:
    """Score and exposure; without signs of a login in the code the attack counts as direct."""
    p, s = F.lower(path), F.lower(snippet)
    exposure = F.when(has(p, "routes/", "api/", "controller"), "internet-facing").when(has(p, "internal", "private", "admin"), "internal").otherwise("authenticated")
    effort = F.when(has(s, "auth", "login", "session", "token"), 30).otherwise(90)
    return (mapped(EXPOSURE, exposure) * F.lit(0.6) + effort * F.lit(0.4)).cast("int"), exposure


def confidence(rule_name: Column, snippet: Column) -> Column:
    n = F.lower(rule_name)
    return F.when(has(n, "secret", "key"), 95).when(has(n, "migration") & has(n, "drop"), 90).when(has(n, "middleware"), 85).when(F.length(snippet) > 20, 70).otherwise(50)


def scored(findings: DataFrame) -> DataFrame:
    name, code = F.coalesce("evidence.rule_name", F.lit("")), F.coalesce("evidence.code_snippet", F.lit(""))
    ok = complete(F.col("file_path"), F.col("evidence.rule_trigger_reason"), F.col("start_line"), F.col("end_line"), F.col("evidence.code_snippet"))
    i, flow = impact(F.coalesce("tags", F.array()), name, code)
    e, exposure = exploitability(F.col("file_path"), code)
    return findings.select("match_id", "rule_id", F.when(~ok, F.lit("info")).otherwise(F.col("severity")).alias("severity"), i.alias("impact"), flow.alias("flow"), e.alias("exploitability"), exposure.alias("exposure"), confidence(name, code).alias("confidence_score"))


def stepped_confidence(level: Column, steps: int | Column) -> Column:
    once = F.coalesce(mapped(DOWN, level), level)
    twice = F.coalesce(mapped(DOWN, once), once)
    n = F.lit(steps) if isinstance(steps, int) else steps
    return F.when(n >= 2, twice).when(n == 1, once).otherwise(level)


def safety_score(severity: Column) -> Column:
    """Aggregate: 100 less the weights of all findings, not below zero."""
    return F.greatest(F.lit(0), F.lit(100) - F.sum(F.coalesce(mapped(SAFETY, severity), F.lit(0))))


# fixed values: advice by category, and prices of a thousand tokens
FIXES = {
    "secret_exposure": "Remove the secret from code. Use environment variables instead. Rotate this credential immediately.",
    "private_key_exposed": "Remove private key from repository. Store in secure vault. Regenerate the key.",
    "env_leaked": "Remove .env file from repository. Add .env to .gitignore. Rotate exposed credentials.",
    "migration_destructive": "Review this destructive operation. Ensure backup strategy. Consider reversible migration.",
    "auth_middleware_removed": "Verify this route should be public. The auth middleware was explicitly removed.",
    "dependency_changed": "Review dependency changes for security implications. Run security audit.",
}
NO_FIX = "Review this finding and address if applicable."
TOKEN_RATES = {"embedding": 0.00002, "input": 0.0025, "output": 0.01}


def fix_of(category: Column) -> Column:
    return F.coalesce(mapped(FIXES, category), F.lit(NO_FIX))


def token_cost(embedding: Column, given: Column, produced: Column) -> Column:
    """Cost in hundredths of a cent, cut to a whole number; null counts are none."""
    n = {"embedding": embedding, "input": given, "output": produced}
    total = F.lit(0.0)
    for k, rate in TOKEN_RATES.items():
        total = total + F.coalesce(n[k], F.lit(0)) / F.lit(1000) * F.lit(rate)
    return (total * 10000).cast("long")


def regulatory_tags(data_types: Column) -> Column:
    """Laws that the kinds of data call up, by the exact names of the kinds."""
    low = F.lower(F.array_join(data_types, ","))
    named = lambda t: F.array_contains(data_types, t)
    some = named("PII") | named("health_data") | named("student_data")
    tags = F.array_compact(F.array(F.when(named("health") | low.contains("patient"), F.lit("HIPAA")), F.when(named("student") | low.contains("education"), F.lit("FERPA")), F.when(named("PII"), F.lit("GDPR")), F.when(named("PII"), F.lit("CCPA"))))
    return F.when(some, tags).otherwise(F.array().cast("array<string>"))


def explanation(data_types: Column, most: Column, flow: Column, tags: Column) -> Column:
    """What stands behind an impact score, in words."""
    level = F.when(most >= 85, "high").when(most >= 60, "medium").otherwise("low")
    kinds = F.when(F.size(data_types) > 0, F.concat(F.lit("Data types: "), F.array_join(data_types, ", ")))
    laws = F.when(F.size(tags) > 0, F.concat(F.lit("Regulatory: "), F.array_join(tags, ", ")))
    return F.concat_ws("; ", F.concat(F.lit("Data sensitivity: "), level), kinds, F.concat(F.lit("Flow: "), flow), laws)


def explained(findings: DataFrame) -> DataFrame:
    """match_id with the explanation of its impact and the laws it touches."""
    types = F.coalesce("tags", F.array().cast("array<string>"))
    name, code = F.coalesce("evidence.rule_name", F.lit("")), F.coalesce("evidence.code_snippet", F.lit(""))
    _, flow = impact(types, name, code)
    most = F.coalesce(F.array_max(F.transform(types, lambda t: F.coalesce(mapped(SENSITIVITY, F.lower(t)), F.lit(50)))), F.lit(0))
    laws = regulatory_tags(types)
    return findings.select("match_id", F.array_join(laws, ",").alias("laws"), explanation(types, most, flow, laws).alias("explanation"))


def rationale(confidence: Column, coverage_pct: Column) -> Column:
    return F.struct(F.when(confidence.isin("high", "medium"), "direct").otherwise("heuristic").alias("evidence_strength"), F.lit("none").alias("trace_strength"), F.round(coverage_pct / 100, 2).alias("coverage_factor"), F.lit(0.0).alias("verification_factor"))


def run_status(modes: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(F.size(modes) > 0, "degraded").otherwise("completed")


def filtered(findings: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal to every value that is given; None leaves a column free."""
    for column, value in wanted.items():
        if value is not None:
            findings = findings.where(F.col(column) == value)
    return findings
