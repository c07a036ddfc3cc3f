"""Privacy rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions.patterns import matches, utf16_length

WHITE_SPACE = r"[\s\x0B\p{Z}\x{FEFF}]"


def looks_private(text: Column) -> Column:
    return (
        matches(text, fixed.RANDOM_TOKEN)
        | matches(text, fixed.SENSITIVE_WORD)
        | matches(text, fixed.EMAIL_ANYWHERE)
        | matches(text, fixed.JWT_ANYWHERE)
    )


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends; `trim` alone takes spaces only."""
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+\\z", "")


def stable_id(value: Column) -> Column:
    """The trimmed identifier, or null when it is not stable and harmless."""
    text = trimmed(value)
    keep = (
        (F.length(text) > 0)
        & (utf16_length(text) <= fixed.MAX_STABLE_ID_LENGTH)
        & matches(text, fixed.STABLE_ID)
        & ~looks_private(text)
    )
    return F.when(keep, text)


def class_tokens(tokens: Column, mode: str, limit: int | None = None) -> Column:
    """Distinct harmless tokens, sorted; with a `limit`, only so many of the first in document order."""

    def keep(token: Column) -> Column:
        ok = (
            (F.length(token) <= fixed.MAX_CLASS_TOKEN_LENGTH)
            & matches(token, fixed.CLASS_TOKEN)
            & ~looks_private(token)
        )
        return ok & matches(token, fixed.STRICT_CLASS_PREFIX) if mode == "STRICT" else ok

    found = F.array_distinct(F.filter(F.transform(tokens, trimmed), keep))
    return F.array_sort(found if limit is None else F.slice(found, 1, limit))


# The JVM's own word boundary counts letters of all scripts; the published rules mean ASCII words.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _ascii_edges(pattern: str) -> str:
    return pattern.replace(r"\b", _EDGE)


def redact_text(text: Column) -> Column:
    """The five preview replacements, in their fixed order."""
    for _, pattern, replacement in fixed.PREVIEW_RULES:
        text = F.regexp_replace(text, F.lit(_ascii_edges(pattern)), F.lit(replacement))
    return text


# What a text must hold before a rule can fire at all; far cheaper to look for than the rule itself.
_NEEDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "jwt": lambda text: F.contains(text, F.lit("eyJ")),
    "keyed": lambda text: text.rlike("(?i)bearer|token|secret|password"),
    "number": lambda text: text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    "entropy": lambda text: text.rlike("[A-Za-z0-9_-]{48}"),
}


def redaction_stages(frame: DataFrame, column: str) -> DataFrame:
    """Apply the rules one projection at a time, with `n_<rule>` counted on what the earlier rules left."""
    for name, pattern, replacement in fixed.PREVIEW_RULES:
        rule = F.lit(_ascii_edges(pattern))
        needed = _NEEDS[name](F.col(column))
        frame = frame.withColumn(f"n_{name}", F.when(needed, F.regexp_count(F.col(column), rule)).otherwise(0))
        # A rule that found nothing leaves the text as it is: one scan instead of two.
        replaced = F.when(F.col(f"n_{name}") > 0, F.regexp_replace(F.col(column), rule, F.lit(replacement))).otherwise(F.col(column))
        frame = frame.withColumn(column, replaced)
    return frame


def plain_label(text: Column, limit: int = fixed.MAX_LABEL_LENGTH) -> Column:
    """Control characters to spaces, trimmed, cut."""
    return F.substring(trimmed(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")), 1, limit)


def name_token(text: Column, pattern: str = fixed.ROLE_TOKEN) -> Column:
    lowered = F.lower(trimmed(text))
    return F.when(matches(lowered, pattern), lowered)


def safe_context(context: Column) -> Column:
    """Diagnostic context without unsafe keys, with long text cut and locators stripped."""

    def key_ok(key: Column, _: Column) -> Column:
        return matches(key, fixed.CONTEXT_KEY) & ~matches(key, fixed.UNSAFE_CONTEXT_KEY)

    def value_of(key: Column, value: Column) -> Column:
        stripped = F.regexp_replace(value, r"#.*\z", "")
        stripped = F.regexp_replace(stripped, r"\?.+\z", "?redacted")
        stripped = F.regexp_replace(stripped, r"\?\z", "")
        stripped = F.regexp_replace(stripped, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")
        # As an address is written back: lower-case scheme and host, and a path of at least "/".
        head = F.regexp_extract(stripped, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        rest = F.substr(stripped, F.length(head) + 1)
        slash = F.when(F.startswith(rest, F.lit("/")), "").otherwise("/")
        stripped = F.concat(F.lower(head), slash, rest)
        is_locator = key.rlike("(?i)url") & value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
        return F.when(is_locator, stripped).otherwise(F.substring(value, 1, 500))

    return F.transform_values(F.map_filter(context, key_ok), value_of)
