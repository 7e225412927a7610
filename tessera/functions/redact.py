"""Secret detection and redaction.

One alternation serves both counting and replacing, so the count always equals the number of
replacements and each text is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# name: (pattern, cheap test that every matching text passes).
_RULES: dict[str, tuple[str, str | None]] = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    "cloud_key_id": (r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b", r"A(?:KIA|SIA)[0-9A-Z]"),
    "host_token": (r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"gh[pousr]_"),
    "signed_token": (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", r"eyJ[A-Za-z0-9_-]"),
    "url_credentials": (r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@", r"://"),
    "assignment": (
        r"(?i:(?:key|token|secret|password|passwd)\"?\s*[:=]\s*(?:\"[^\"\n]{6,}\"|'[^'\n]{6,}'))", r"[:=]\s*[\"']",
    ),
}


def register_redaction_rule(name: str, pattern: str, quick_test: str | None = None) -> None:
    """Add or replace a rule; the pattern must not contain capture-group references.

    `quick_test` is a simpler pattern found in every text the rule matches; without one the full
    scan runs on every text.
    """
    _RULES[name] = (pattern, quick_test)


def secret_pattern() -> str:
    return "|".join(f"(?:{rule})" for rule, _ in _RULES.values())


def _may_match(text: Column) -> Column:
    """Most texts fail this and skip the full scan."""
    tests = [test for _, test in _RULES.values()]
    if None in tests:
        return F.lit(True)
    return text.rlike("|".join(f"(?:{t})" for t in tests))


def count_secrets(text: Column) -> Column:
    found = F.when(_may_match(text), F.regexp_count(text, F.lit(secret_pattern()))).otherwise(0)
    return F.coalesce(found, F.lit(0))


def redact(text: Column) -> Column:
    return F.when(_may_match(text), F.regexp_replace(text, secret_pattern(), REDACTED)).otherwise(text)


def redact_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Redact several text columns of a record and count what was found over all of them."""
    total = sum((count_secrets(F.col(f)) for f in fields), F.lit(0))
    return df.withColumn("secrets_redacted", total).withColumns({f: redact(F.col(f)) for f in fields})
