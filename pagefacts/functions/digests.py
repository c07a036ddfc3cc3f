"""Digest and identifier expressions."""

from __future__ import annotations

from collections.abc import Iterable

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefacts import fixed


def digest(column: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def canonical_struct(fields: dict[str, Column]) -> Column:
    """Canonical text of a flat record of strings, integers, booleans, nulls and arrays of them.

    Keys are emitted in order and nulls are kept, so Spark's own JSON text is the canonical one.
    Doubles must go through `canonical_json` instead: Spark prints 100.0 and 1.0E-7.
    """
    ordered = [fields[key].alias(key) for key in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def uuid_of(namespace: Column | str, value: Column) -> Column:
    """UUID text from sha256(namespace, NUL, value): version nibble 5, variant bits 10."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    hexed = F.sha2(F.concat(space, F.lit("\u0000"), value), 256)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]),
                           (F.conv(F.substring(hexed, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws(
        "-",
        F.substring(hexed, 1, 8),
        F.substring(hexed, 9, 4),
        F.concat(F.lit("5"), F.substring(hexed, 14, 3)),
        F.concat(variant, F.substring(hexed, 18, 3)),
        F.substring(hexed, 21, 12),
    )


def node_id(zero_based: Column) -> Column:
    number = (zero_based + 1).cast("string")
    return F.concat(F.lit("node-"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number))


_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _text(value: str) -> str:
    value.encode("utf-8")
    return '"' + "".join(_SHORT.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in value) + '"'


def _number(value: float | int) -> str:
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("NON_FINITE_NUMBER")
        if value.is_integer():
            value = int(value)
    if isinstance(value, int):
        if abs(value) > 2**53 - 1:
            raise ValueError("UNSAFE_INTEGER")
        return str(value)
    mantissa, _, exponent = repr(value).partition("e")
    if not exponent:
        return mantissa
    power = int(exponent)
    if -7 < power < 0:
        digits = mantissa.replace(".", "").lstrip("-")
        return ("-" if value < 0 else "") + "0." + "0" * (-power - 1) + digits
    return f"{mantissa}e{power}"


def canonical_text(value: object, semantic: bool = False) -> str:
    """Canonical text of one parsed JSON value; `semantic` leaves operational facts out."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(canonical_text(item, semantic) for item in value) + "]"
    parts = []
    for key in sorted(value):
        if key in fixed.DANGEROUS_KEYS:
            raise ValueError("UNSAFE_KEY")
        if semantic and key in fixed.OPERATIONAL_KEYS:
            continue
        if semantic and key == "diagnostics" and isinstance(value[key], list):
            kept = [
                {name: item[name] for name in ("code", "severity", "scope", "context")}
                for item in value[key]
                if isinstance(item, dict) and item.get("scope") == "SEMANTIC" and "context" in item
                and isinstance(item.get("code"), str) and isinstance(item.get("severity"), str)
            ]
            parts.append(_text(key) + ":[" + ",".join(sorted(canonical_text(k, True) for k in kept)) + "]")
            continue
        parts.append(_text(key) + ":" + canonical_text(value[key], semantic))
    return "{" + ",".join(parts) + "}"


def _canonical_rows(texts: Iterable[str | None], semantic: bool) -> list[dict[str, str | None]]:
    rows = []
    for text in texts:
        try:
            parsed = None if text is None else canonical_text(json.loads(text), semantic)
            rows.append({"text": parsed, "error": None})
        except UnicodeEncodeError:
            rows.append({"text": None, "error": "INVALID_UNICODE"})
        except json.JSONDecodeError:
            rows.append({"text": None, "error": "MALFORMED"})
        except (ValueError, RecursionError) as problem:
            rows.append({"text": None, "error": str(problem)[:80]})
    return rows


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_RESULT)
def canonical_json(texts: pd.Series) -> pd.DataFrame:
    """Canonical text of free-form JSON (Arrow batches; only for shapes without a fixed schema)."""
    return pd.DataFrame(_canonical_rows(texts, False), columns=["text", "error"])


@F.pandas_udf(_RESULT)
def semantic_json(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_canonical_rows(texts, True), columns=["text", "error"])
