"""Finding and masking sensitive values, cleaning and scoring documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.functions.text import strip

FULL_MASK = ("password", "api_key", "jwt_token")
PART_MASK = ("credit_card", "phone_number")


def _pattern(name: str) -> str:
    return "(?i)" + R.SENSITIVE_PATTERNS[name]


def sensitive_matches(content: Column) -> Column:
    """Map of pattern name to all its matches, only names with a match."""
    pairs = []
    for name, pattern in R.SENSITIVE_PATTERNS.items():
        group = 1 if name in ("password", "api_key") else 0
        pairs += [F.lit(name), F.regexp_extract_all(content, F.lit(_pattern(name)), F.lit(group))]
    return F.map_filter(F.create_map(*pairs), lambda _, found: F.size(found) > 0)


def is_sensitive(content: Column) -> Column:
    return content.rlike("(?i)" + "|".join(f"(?:{p})" for p in R.SENSITIVE_PATTERNS.values()))


def mask_sensitive(content: Column) -> Column:
    """Mask in pattern order: named placeholders, last digits or the mail domain stay."""
    out = content
    for name in R.SENSITIVE_PATTERNS:
        if name in ("password", "api_key"):
            # the value alone is replaced, its label stays
            labelled = _pattern(name).replace(r'([^\s"]+)', "")
            out = F.regexp_replace(out, f"({labelled})" + r'[^\s"]+', f"$1[REDACTED_{name.upper()}]")
        elif name in FULL_MASK:
            out = F.regexp_replace(out, _pattern(name), f"[REDACTED_{name.upper()}]")
        elif name == "credit_card":
            out = F.regexp_replace(out, r"(?i)\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?(\d{4})\b", "****$1")
        elif name == "phone_number":
            out = F.regexp_replace(out, r"(?i)\b\d{3}[-\.\s]?\d{3}[-\.\s]?(\d{4})\b", "****$1")
        elif name == "email":
            out = F.regexp_replace(
                out, r"(?i)\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", "$1***@$2")
        else:
            out = F.regexp_replace(out, _pattern(name), f"[MASKED_{name.upper()}]")
    return out


def sanitize(content: Column) -> Column:
    """Every match, label included, becomes ``[REDACTED_<NAME>]``."""
    return reduce(lambda c, item: F.regexp_replace(c, "(?i)" + item[1], f"[REDACTED_{item[0].upper()}]"),
                  R.SANITIZE_PATTERNS, content)


def mask_field(value: Column) -> Column:
    """First and last two characters stay when the value is longer than four."""
    return F.when(F.length(value) > 4, F.concat(
        F.left(value, F.lit(2)), F.repeat(F.lit("*"), F.length(value) - 4), F.right(value, F.lit(2)))).otherwise("***")


def sensitivity_class(content: Column, critical: Column) -> Column:
    return F.when(is_sensitive(content), "SENSITIVE").when(critical, "CONFIDENTIAL").otherwise("INTERNAL")


def clean_text(content: Column) -> Column:
    """No control characters, one blank between words, none at the ends."""
    plain = F.regexp_replace(content, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(plain, r"\s+", " "))


def clean_documents(df: DataFrame, content: str = "content", least: int | None = None, most: int | None = None) -> DataFrame:
    """Normalize and redact whole texts; adds ``kept`` and, for refused texts, the ``reason``.

    Without bounds every text is kept. Refused rows stay in the result.
    """
    out = df.withColumn(content, clean_text(F.col(content)))
    reason = F.lit(None).cast("string")
    if most is not None:
        reason = F.when(F.length(content) > most, "too long").otherwise(reason)
    if least is not None:
        reason = F.when(F.coalesce(F.length(content), F.lit(0)) < least, "too short").otherwise(reason)
    out = out.withColumn("reason", reason)
    return out.withColumns({"kept": F.col("reason").isNull(), content: sanitize(F.col(content))})


def completeness(required: list[Column], optional: list[Column]) -> Column:
    def share(cols):
        filled = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", 1.0).otherwise(0.0) for c in cols]
        return reduce(lambda a, b: a + b, filled) / len(cols)

    return share(required) * 0.8 + share(optional) * 0.2


def quality_score(parts: dict[str, Column]) -> Column:
    """Weighted sum of completeness, accuracy, consistency, timeliness, relevance."""
    return reduce(lambda a, b: a + b, [parts[name] * weight for name, weight in R.QUALITY_WEIGHTS.items()])
