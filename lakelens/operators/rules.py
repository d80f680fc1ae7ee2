"""Rules as data, compiled once into column expressions; a file is read once for all of them.

Line rules report the first match of a rule in a line. Scan rules report every match in a text
with its line. Each regex stands behind a cheap literal test, so most texts never reach it, and
all rules of a file are collected in one array that is exploded once: no join with the rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    hints: tuple[str, ...]
    severity: str
    category: str
    name: str = ""
    confidence: str = "high"


# fixed values: line rules
LINE_RULES = [
    Rule("secret_github_pat_classic", r"ghp_[a-zA-Z0-9]{36}", ("ghp_",), "critical", "secret_exposure", "GitHub Personal Access Token"),
    Rule("secret_github_pat_finegrained", r"github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59}", ("github_pat_",), "critical", "secret_exposure", "GitHub Fine-grained PAT"),
    Rule("secret_aws_access_key", r"AKIA[0-9A-Z]{16}", ("AKIA",), "critical", "secret_exposure", "AWS Access Key ID"),
    Rule("secret_stripe_live_key", r"sk_live_[a-zA-Z0-9]{24,}", ("sk_live_",), "critical", "secret_exposure", "Stripe Live Secret Key"),
    Rule("secret_stripe_publishable_key", r"pk_live_[a-zA-Z0-9]{24,}", ("pk_live_",), "warning", "secret_exposure", "Stripe Live Publishable Key"),
    Rule("secret_slack_bot_token", r"xoxb-[0-9]{11,13}-[0-9]{11,13}-[a-zA-Z0-9]{24}", ("xoxb-",), "critical", "secret_exposure", "Slack Bot Token"),
    Rule("secret_slack_user_token", r"xoxp-[0-9]{11,13}-[0-9]{11,13}-[a-zA-Z0-9]{24}", ("xoxp-",), "critical", "secret_exposure", "Slack User Token"),
    Rule("secret_sendgrid_api_key", r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}", ("SG.",), "critical", "secret_exposure", "SendGrid API Key"),
    Rule("secret_twilio_sid", r"AC[a-f0-9]{32}", ("AC",), "warning", "secret_exposure", "Twilio Account SID"),
    Rule("secret_private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", ("PRIVATE KEY",), "critical", "private_key_exposed", "Private Key"),
]
# fixed values: parts of paths that secret rules leave out
UNSCANNED = [".lock", ".min.js", ".min.css", ".map", ".svg", ".png", ".jpg", ".gif", ".ico", ".woff", ".ttf", "/vendor/", "/node_modules/", "/dist/", "/build/", "__pycache__"]
# fixed values: file names that should not be stored, and lock files
FILE_RULES = [
    Rule("file_env_committed", r"^\.env$", (), "critical", "env_leaked", ".env file committed"),
    Rule("file_env_config_committed", r"^\.env\.(local|production|staging)$", (), "critical", "env_leaked", "Environment file committed"),
    Rule("file_ssh_key_committed", r"id_rsa$|id_ed25519$|id_ecdsa$", (), "critical", "private_key_exposed", "SSH private key committed"),
]
LOCKFILES = ["composer.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "poetry.lock"]
# fixed values: scan rules (those that could not match as first written are repaired)
SCAN_RULES = [
    Rule("SEC-001", r"\b(eval|exec)\s*\(", ("eval", "exec"), "high", "security", "Dynamic code execution detected", "medium"),
    Rule("SEC-002", r"\b(os\.system|subprocess\.Popen|subprocess\.run)\s*\(", ("os.system", "subprocess."), "medium", "security", "Shell execution detected", "medium"),
    Rule("SEC-003", r"(?i)(api_key|secret|token|password)\s*=\s*[\"'][^\"']{8,}[\"']", ("api_key", "secret", "token", "password"), "high", "security", "Potential secret in source", "low"),
    Rule("PRIV-001", r"(?i)\b(email|phone|address|dob|ssn|social_security|passport)\b", ("email", "phone", "address", "dob", "ssn", "social_security", "passport"), "medium", "privacy", "Personal data field detected", "low"),
    Rule("PRIV-002", r"(?i)(logger|log)\.(info|debug|warn|error).*\b(email|phone|ssn|address)\b", ("email", "phone", "ssn", "address"), "high", "privacy", "PII in logs", "medium"),
    Rule("PERF-001", r"(?i)SELECT\s+\*", ("select",), "low", "performance", "SELECT * usage detected", "medium"),
    Rule("PERF-002", r"\b(open|read|write)\(|\btime\.sleep\(", ("open(", "read(", "write(", "sleep("), "medium", "performance", "Potential blocking I/O in request path", "low"),
]
# fixed values: destructive changes in migrations, and removed access checks in route files
MIGRATION_RULES = [
    Rule("migration_drop_table", r"(?i)Schema::drop(?:IfExists)?\s*\(\s*['\"](\w+)['\"]", (), "critical", "migration_destructive", "DROP TABLE"),
    Rule("migration_drop_column", r"(?i)\$table->dropColumn\s*\(\s*['\"](\w+)['\"]", (), "critical", "migration_destructive", "DROP COLUMN"),
    Rule("migration_drop_columns", r"(?i)\$table->dropColumn\s*\(\s*\[([^\]]+)\]", (), "critical", "migration_destructive", "DROP COLUMNS"),
    Rule("migration_rename_table", r"(?i)Schema::rename\s*\(()", (), "critical", "migration_destructive", "RENAME TABLE"),
    Rule("migration_rename_column", r"(?i)\$table->renameColumn\s*\(()", (), "critical", "migration_destructive", "RENAME COLUMN"),
]
AUTH_RULE = Rule("auth_middleware_removed", r"(?i)->withoutMiddleware\s*\(\s*['\"](auth|verified|can|admin)['\"]", (), "critical", "auth_middleware_removed", "Auth middleware removed")


def hinted(text: Column, rule: Rule, low: Column | None = None) -> Column:
    """Can the rule match at all? Hints of rules that ignore case are looked for in the text in lower case."""
    test = F.lit(True)
    if rule.pattern.startswith("(?i)"):
        text = F.lower(text) if low is None else low
    if rule.hints:
        test = F.lit(False)
        for h in rule.hints:
            test = test | text.contains(h)
    return test


def unscanned(path: Column) -> Column:
    low = F.lower(path)
    test = F.lit(False)
    for p in UNSCANNED:
        test = test | low.contains(p)
    return test


def line_findings(files: DataFrame, rules: list[Rule] = LINE_RULES, context: int = 3, added_lines: str | None = None, group: int = 0) -> DataFrame:
    """One row per rule and line. added_lines names an array of line numbers to keep; null or empty keeps all."""
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | hinted(F.col("content"), r)
    keep = [added_lines] if added_lines else []
    lines = files.where(wanted).select("snapshot_id", "repo_id", "file_path", *keep, X.lines_nl(F.col("content")).alias("lines"))
    one = lines.select("*", F.posexplode("lines").alias("pos", "line"))
    if added_lines:
        one = one.where(F.col(added_lines).isNull() | (F.size(added_lines) == 0) | F.array_contains(added_lines, F.col("pos") + 1))
    found = F.array_compact(F.array(*[
        F.when(hinted(F.col("line"), r) & F.col("line").rlike(r.pattern), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.regexp_extract("line", r.pattern, group).alias("hit")))
        for r in rules
    ]))
    hit = one.withColumn("f", F.explode(found))
    first = F.greatest(F.col("pos") - context + 1, F.lit(1))
    n = F.col("pos") + context + 1 - first + 1
    frame = F.array_join(F.transform(F.slice("lines", first, n), lambda x, i: F.concat(F.when(first + i == F.col("pos") + 1, F.lit(">>> ")).otherwise(F.lit("    ")), F.lpad((first + i).cast("string"), 4, " "), F.lit(" | "), x)), "\n")
    return hit.select("snapshot_id", "repo_id", "file_path", (F.col("pos") + 1).alias("line_no"), "f.rule_id", "f.rule_name", "f.severity", "f.category", "f.hit", "line", frame.alias("context_lines"))


def secret_lines(files: DataFrame) -> DataFrame:
    """Line findings with the value masked wherever it is shown; a raw value never leaves the operator."""
    got = line_findings(files.where(~unscanned(F.col("file_path"))))
    masked = X.mask(F.col("hit"))
    return got.withColumn("line", F.replace("line", F.col("hit"), masked)).withColumn("context_lines", F.replace("context_lines", F.col("hit"), masked)).withColumn("hit", masked)


def file_findings(files: DataFrame) -> DataFrame:
    name = X.basename(F.col("file_path"))
    found = F.array_compact(F.array(*[F.when(name.rlike(r.pattern), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in FILE_RULES], F.when(name.isin(*LOCKFILES), F.struct(F.lit("dependency_lockfile_changed").alias("rule_id"), F.lit("info").alias("severity")))))
    return files.select("snapshot_id", "repo_id", "file_path", F.explode(found).alias("f")).select("snapshot_id", "repo_id", "file_path", "f.rule_id", "f.severity")


def scan_findings(files: DataFrame, rules: list[Rule] = SCAN_RULES) -> DataFrame:
    """Every match of the scan rules in whole texts, with its line. Matches are looked for once a rule, and the text is cut at them only where there are any."""
    text = F.col("content")
    keys = ("snapshot_id", "repo_id", "file_path")
    low = files.where(F.length(text) > 0).select(*keys, "content", F.lower("content").alias("low"))
    none = F.array().cast("array<string>")
    hits = low.select(*keys, "content", *[F.when(hinted(text, r, F.col("low")), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"hits_{k}") for k, r in enumerate(rules)])
    parts = hits.select(*keys, *[f"hits_{k}" for k in range(len(rules))], *[F.when(F.size(f"hits_{k}") > 0, F.split(text, r.pattern, -1)).otherwise(none).alias(f"parts_{k}") for k, r in enumerate(rules)])

    def placed(k: int, r: Rule) -> Column:
        named = [F.lit(v).alias(n) for n, v in (("rule_id", r.rule_id), ("category", r.category), ("severity", r.severity), ("confidence", r.confidence))]
        return F.zip_with(X.match_lines(F.col(f"hits_{k}"), F.col(f"parts_{k}")), F.col(f"hits_{k}"), lambda n, h: F.struct(*named, n.alias("start_line"), (n + X.newlines(h)).alias("end_line")))

    return parts.select(*keys, F.explode(F.flatten(F.array(*[placed(k, r) for k, r in enumerate(rules)]))).alias("f")).select(*keys, "f.*")


def untimed_requests(files: DataFrame) -> DataFrame:
    got = files.where(F.col("content").contains("requests.")).select("snapshot_id", "file_path", F.posexplode(X.lines_universal(F.col("content"))).alias("pos", "line"))
    return got.where(F.col("line").contains("requests.") & F.col("line").contains("(") & ~F.col("line").contains("timeout=")).select("snapshot_id", "file_path", (F.col("pos") + 1).alias("line_no"), F.trim("line").alias("snippet"))


def large_functions(symbols: DataFrame, least: int = 80) -> DataFrame:
    n = F.col("line_end") - F.col("line_start") + 1
    return symbols.where(F.col("symbol_type").isin("function", "method") & (n >= least)).select("symbol_id", "file_path", "qualified_name", n.alias("n_lines"), F.array_join(F.slice(X.lines_universal(F.coalesce("body", F.lit(""))), 1, 6), "\n").alias("snippet"))


def data_access_in_controllers(files: DataFrame) -> DataFrame:
    t = F.col("content")
    marks = t.contains("SELECT ") | t.contains("session.execute") | t.contains("db.") | t.contains("cursor.")
    return files.where(F.lower("file_path").rlike("routes|controllers|handlers") & marks).select("snapshot_id", "file_path", F.lit(1).alias("line_no"))


@dataclass(frozen=True)
class Check:
    """A file-level implication: some pattern is there and none of the required ones."""

    check_id: str
    severity: str
    patterns: tuple[str, ...]
    required: tuple[str, ...]
    forbidden: tuple[str, ...] = ()


# fixed values: checks that can fire
CHECKS = [
    Check("DP001", "critical", ("email|phone|address|name|ssn|passport|dob|birth", r"user\.email|user\.phone|user\.address", "personal_data|pii|sensitive_data"), ("consent|gdpr_consent|privacy_consent|opt_in", "accept.*terms|agree.*privacy")),
    Check("DP002", "high", ("delete.*user|remove.*account|gdpr.*delete",), ("delete_user_data|erase_personal|forget_me|right_to_erasure", "cascade.*delete|purge.*user")),
    Check("SEC001", "critical", (), (), (r"password\s*=\s*['\"]|md5\(.*password|sha1\(.*password", "base64.*password|encode.*password")),
    Check("SEC002", "critical", ("credit_card|card_number|cvv|ssn|social_security", "health_record|medical|diagnosis|patient"), ("encrypt|aes|cipher|crypto|fernet", "https|tls|ssl"), (r"http://(?!localhost|127\.0\.0\.1)",)),
    Check("SEC003", "critical", (), (), ("cvv|cvc|security_code|card_verification", "full_card|card_number(?!_last4|_token)", r"pan\s*=|primary_account_number")),
    Check("SEC005", "high", ("admin|superuser|root|privileged",), ("@requires_auth|@login_required|@authenticated", "check_permission|has_permission|authorize", "role.*check|rbac|acl")),
    Check("INT001", "high", ("aws|azure|gcp|cloud", "cdn|cloudflare|fastly", "analytics|tracking|third.*party"), ("data_processing_agreement|dpa|scc|standard_contractual", "adequacy|privacy_shield|binding_corporate")),
    Check("HIP001", "critical", ("patient|medical|health|diagnosis|treatment", "prescription|medication|lab_result", "phi|protected_health|hipaa"), ("baa|business_associate|covered_entity",)),
    Check("AI001", "high", ("predict|classify|recommend|score", r"model\.predict|inference|ml_decision", "automated.*decision|algorithm.*decide"), ("explain|interpretab|transparen|ai_disclosure", "human.*review|manual.*override|appeal")),
]


def forbidden_lines(files: DataFrame, checks: list[Check] = CHECKS) -> DataFrame:
    """One row per forbidden pattern and line of a code file; lines are only cut in files where a pattern occurs."""
    pairs = [(c.check_id, k, "(?i)" + p) for c in checks for k, p in enumerate(c.forbidden)]
    some = F.lit(False)
    for _, _, p in pairs:
        some = some | F.col("content").rlike(p)
    lines = files.where(X.is_code(F.col("file_path")) & some).select("snapshot_id", "file_path", F.posexplode(X.lines_nl(F.col("content"))).alias("pos", "line"))
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(i).alias("check_id"), F.lit(k).alias("pattern_no"))) for i, k, p in pairs]))
    return lines.select("snapshot_id", "file_path", (F.col("pos") + 1).alias("line_no"), F.explode(found).alias("f")).select("snapshot_id", "file_path", "line_no", "f.check_id", "f.pattern_no")


def first_line(text: Column, pattern: str) -> Column:
    """Line of the first match of a pattern that matches inside lines only."""
    return X.newlines(F.split(text, pattern, 2)[0]) + 1


def holds(text: Column, low: Column, pattern: str) -> Column:
    """Does the text hold a pattern, case aside? Alternatives that are plain words, or words with anything between, are looked for as words in the text in lower case first."""
    test = F.lit(False)
    for part in [pattern] if "(" in pattern else pattern.split("|"):
        words = re.split(r"\.\*|\\\.", part) if re.fullmatch(r"[a-z0-9_@]+(?:(?:\.\*|\\\.)[a-z0-9_@]+)*", part) else []
        found = text.rlike("(?i)" + part) if len(words) != 1 else F.lit(True)
        for w in reversed(words):
            found = low.contains(w) & found
        test = test | found
    return test


def missing_required(files: DataFrame, checks: list[Check] = CHECKS) -> DataFrame:
    """The first line of each pattern in files that have one and lack everything required with it. Each pattern is tried on the whole text, up to its first match."""
    text, low = F.col("content"), F.col("low")
    out = []
    for c in checks:
        if not (c.patterns and c.required):
            continue
        lacks = F.lit(True)
        for p in c.required:
            lacks = lacks & ~holds(text, low, p)
        for k, p in enumerate(c.patterns):
            out.append(F.when(holds(text, low, p) & lacks, F.struct(F.lit(c.check_id).alias("check_id"), F.lit(k).alias("pattern_no"), first_line(text, "(?i)" + p).alias("line_no"))))
    got = files.where(X.is_code(F.col("file_path"))).select("snapshot_id", "file_path", "content", F.lower("content").alias("low")).select("snapshot_id", "file_path", F.explode(F.array_compact(F.array(*out))).alias("f"))
    return got.select("snapshot_id", "file_path", "f.check_id", "f.pattern_no", "f.line_no")


def is_migration(path: Column) -> Column:
    return F.lower(path).contains("migrations/") & path.endswith(".php")


def is_route_file(path: Column) -> Column:
    return F.lower(path).contains("routes/") & path.endswith(".php")


def enabled(rules: list[Rule], names: list[str] | None) -> list[Rule]:
    """Rules of the categories that are switched on; none named means all. What is off never reaches the plan."""
    return [r for r in rules if not names or r.category in names]


def migration_findings(files: DataFrame) -> DataFrame:
    """Destructive changes, in migration files only, with the table or column they name."""
    return line_findings(files.where(is_migration(F.col("file_path"))), MIGRATION_RULES, group=1)


def removed_access_checks(files: DataFrame) -> DataFrame:
    """Access checks taken off a route, in route files only."""
    return line_findings(files.where(is_route_file(F.col("file_path"))), [AUTH_RULE], group=1)


# fixed values: regulations with the regions and sectors they hold in, and the checks that belong to them
REGULATIONS = [
    ("GDPR", "eu uk global", "all"), ("CCPA", "us", "all"), ("HIPAA", "us", "healthcare"), ("PCI_DSS", "global", "finance ecommerce"),
    ("SOC2", "global", "saas finance"), ("DPDP", "india", "all"), ("LGPD", "brazil", "all"), ("PDPA_SG", "singapore", "all"),
]
CHECK_REGULATIONS = {
    "DP001": "GDPR CCPA DPDP LGPD", "DP002": "GDPR", "DP003": "GDPR CCPA", "SEC001": "PCI_DSS HIPAA SOC2", "SEC002": "PCI_DSS HIPAA SOC2", "SEC003": "PCI_DSS", "SEC004": "HIPAA SOC2",
    "SEC005": "HIPAA PCI_DSS SOC2", "RET001": "GDPR CCPA DPDP", "INT001": "GDPR DPDP", "BRE001": "GDPR HIPAA CCPA", "HIP001": "HIPAA", "AI001": "GDPR EU_AI_ACT",
}


def applicable_regulations(requests: DataFrame) -> DataFrame:
    """requests(region, sector) -> one row for each regulation that holds there; the region `global` meets all of them."""
    code = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.array(*map(F.lit, r.split())).alias("regions"), F.array(*map(F.lit, s.split())).alias("sectors")) for c, r, s in REGULATIONS])).alias("r")
    got = requests.select("*", code)
    region = F.array_contains("r.regions", F.col("region")) | F.array_contains("r.regions", "global") | (F.col("region") == "global")
    sector = F.array_contains("r.sectors", F.col("sector")) | F.array_contains("r.sectors", "all")
    return got.where(region & sector).select(*requests.columns, F.col("r.code").alias("code"))


def applicable_checks(regulations: DataFrame, by: list[str]) -> DataFrame:
    """regulations(code, ...) -> the checks that share a regulation with each group, once: overlap of sets as an equi-join on members."""
    spark = regulations.sparkSession
    members = spark.createDataFrame([(k, c) for k, codes in CHECK_REGULATIONS.items() for c in codes.split()], "check_id string, code string")
    return regulations.join(members, "code").select(*by, "check_id").distinct()
