"""Conformance of JSON records with contracts that are data.

A registry of JSON schemas is flattened into a table of rules: one row for each rule of each place, references and `allOf` resolved.  A record is taken
apart once, in one projection, into rows of path, place and value, no deeper than rules go.  Places are paths with `[*]` for the items of an array, so
values and rules meet in a join, whatever the contract; what is violated is a column expression over both sides.  Rules below an alternative
of `anyOf` carry that alternative; an alternative with an issue is out, and where all are out, that is the issue.

Supported: type, enum, const, minLength, maxLength, pattern, format (uuid, date-time), minimum, maximum, minItems, maxItems, uniqueItems, items,
required, properties, additionalProperties, $ref by name, allOf, anyOf.  A contract that refers to itself is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.functions.patterns import utf16_length

RULES = ("contract string, place string, rule string, types array<string>, texts array<string>, number double, "
         "branches array<struct<id:string,alternative:int,alternatives:int,depth:int>>")
#: A place of values under keys that a schema of `additionalProperties` covers.
OTHER = ".*"
_SIZES = {"minLength": "min_length", "maxLength": "max_length", "minimum": "minimum", "maximum": "maximum", "minItems": "min_items", "maxItems": "max_items"}
_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\\z"
_TIME = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:Z|[+-](\d{2}):(\d{2}))\z"


def _written(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _flattened(schema: dict, registry: dict[str, dict], place: str, depth: int, branches: tuple, seen: tuple) -> Iterator[tuple]:
    """(place, rule, types, texts, number, branches) of a schema and all below it."""
    reference = schema.get("$ref")
    if reference is not None:
        if reference in seen:
            raise ValueError(f"contract {reference} refers to itself")
        if reference in registry:
            yield from _flattened(registry[reference], registry, place, depth, branches, (*seen, reference))
        else:
            yield place, "unresolved", None, [reference], None, branches
    for part in schema.get("allOf", ()):
        yield from _flattened(part, registry, place, depth, branches, seen)
    choices = schema.get("anyOf", ())
    for i, part in enumerate(choices):
        here = (f"{place}|{_written(list(choices))}", i, len(choices), depth)
        yield from _flattened(part, registry, place, depth, (*branches, here), seen)
    wanted = schema.get("type")
    types = None if wanted is None else [wanted] if isinstance(wanted, str) else list(wanted)
    if "const" in schema:
        yield place, "const", None, [_written(schema["const"])], None, branches
    if "enum" in schema:
        yield place, "enum", None, [_written(x) for x in schema["enum"]], None, branches
    if types is not None:
        yield place, "type", types, None, None, branches
    if "pattern" in schema:
        yield place, "pattern", types, [schema["pattern"].replace("$", r"\z")], None, branches
    if schema.get("format") in ("uuid", "date-time"):
        yield place, schema["format"].replace("-", "_"), types, None, None, branches
    for name, rule in _SIZES.items():
        if name in schema:
            yield place, rule, types, None, float(schema[name]), branches
    if schema.get("uniqueItems"):
        yield place, "unique_items", types, None, None, branches
    if schema.get("required"):
        yield place, "required", types, list(schema["required"]), None, branches
    known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
    if others is False:
        yield place, "unexpected", types, list(known), None, branches
    elif isinstance(others, dict):
        yield place, "others", types, list(known), None, branches
        yield from _flattened(others, registry, place + OTHER, depth + 1, branches, seen)
    for name, part in known.items():
        yield from _flattened(part, registry, f"{place}.{name}", depth + 1, branches, seen)
    if isinstance(schema.get("items"), dict):
        yield from _flattened(schema["items"], registry, f"{place}[*]", depth + 1, branches, seen)


def contract_rules(spark: SparkSession, registry: dict[str, dict]) -> DataFrame:
    """The rules of all contracts of a registry (name to schema): `contract`, `place`, `rule` and its arguments."""
    rows = [(name, *rule) for name, schema in registry.items() for rule in _flattened(schema, registry, "$", 0, (), (name,))]
    return spark.createDataFrame(rows, RULES)


def _kind(value: Column) -> Column:
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _children(entry: Column, others: dict[str, list[str]]) -> Column:
    """The members of a value's object or array, a second time under `OTHER` where a schema covers keys that are not named."""
    shape = lambda step, place, value: F.struct(
        F.concat(entry["path"], step).alias("path"), F.concat(entry["place"], place).alias("place"), value.alias("value"),
        F.array_append(entry["steps"], step).alias("steps"))
    named = lambda e: F.concat(F.lit("."), e["key"])
    items = lambda: F.transform(F.try_variant_get(entry["value"], "$", "array<variant>"), lambda item, i: shape(
        F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit("[*]"), item))

    def members(fields: Column) -> Column:
        own = F.transform(fields, lambda e: shape(named(e), named(e), e["value"]))
        wild = None
        for place, names in others.items():
            extra = F.transform(F.filter(fields, lambda e: ~F.array_contains(F.array(*map(F.lit, names)).cast("array<string>"), e["key"])),  # noqa: B023
                                lambda e: shape(named(e), F.lit(OTHER), e["value"]))
            here = entry["place"] == place
            wild = F.when(here, F.concat(own, extra)) if wild is None else wild.when(here, F.concat(own, extra))
        return own if wild is None else wild.otherwise(own)

    # A value is an object, an array or neither.
    empty = F.array().cast("array<struct<path:string,place:string,value:variant,steps:array<string>>>")
    fields = F.map_entries(F.try_variant_get(entry["value"], "$", "map<string,variant>"))
    return _once(fields, lambda found: F.when(found.isNotNull(), members(found)).otherwise(F.coalesce(items(), empty)))


def record_values(records: DataFrame, column: str, keep: list[str], depth: int, others: dict[str, list[str]] | None = None) -> DataFrame:
    """`keep`, `path`, `place`, `value` (variant), `steps` of every value of a JSON record down to `depth`; text that is no JSON has no value."""
    def walked(parsed: Column) -> Column:
        root = F.struct(F.lit("$").alias("path"), F.lit("$").alias("place"), parsed.alias("value"), F.array().cast("array<string>").alias("steps"))
        every = F.aggregate(
            F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>"), F.struct(F.array(root).alias("all"), F.array(root).alias("last")),
            lambda done, _: _wider(done, F.flatten(F.transform(done["last"], lambda entry: _children(entry, others or {})))), lambda done: done["all"])
        return F.when(parsed.isNotNull(), every)

    # A record is parsed once: text that is no JSON gives no array, and so no row.
    return records.select(*keep, F.explode(_once(F.try_parse_json(F.col(column)), walked)).alias("_one")).select(*keep, "_one.*")


def _wider(done: Column, found: Column) -> Column:
    return _once(found, lambda last: F.struct(F.concat(done["all"], last).alias("all"), last.alias("last")))


def _valid_time(text: Column) -> Column:
    part = lambda i: F.coalesce(F.regexp_extract(text, _TIME, i).try_cast("int"), F.lit(0))
    year, month, day = part(1), part(2), part(3)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    # The days of a month; year 0 to 99 count as 1900 to 1999 where the days of February are looked up.
    leap = F.when(year < 100, (year % 4 == 0) & (year != 0)).otherwise(leap)
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return (text.rlike(_TIME) & month.between(1, 12) & day.between(1, days) & (part(4) <= 23) & (part(5) <= 59) & (part(6) <= 59)
            & (part(7) <= 23) & (part(8) <= 59))


def _violations() -> Column:
    """Issues of a value (`value`, `_kind`) under a rule, as an array of (suffix of the path, message); null where the rule holds."""
    value, kind = F.col("value"), F.col("_kind")
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_number = kind == "STRING", kind.isin("BIGINT", "DECIMAL", "DOUBLE")
    whole = is_number & (number == F.floor(number))
    named = {"null": kind == "VOID", "object": kind == "OBJECT", "array": kind == "ARRAY", "string": is_text, "boolean": kind == "BOOLEAN", "number": is_number, "integer": whole}

    def of_type(t: Column) -> Column:
        found: Column | None = None
        for name, is_it in named.items():
            found = F.when(t == name, F.coalesce(is_it, F.lit(False))) if found is None else found.when(t == name, F.coalesce(is_it, F.lit(False)))
        return found.otherwise(F.lit(False))

    fits = F.exists("types", of_type)
    same = lambda t: F.when(
        is_number, F.coalesce(t.try_cast("double") == number, F.lit(False))).otherwise(F.to_json(value) == t)
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda item: F.to_json(item))
    repeated = F.filter(F.transform(items, lambda item, i: F.when(F.array_position(items, item) <= i, i)), lambda i: i.isNotNull())
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    one = lambda suffix, message: F.array(F.struct(suffix.alias("suffix"), message.alias("message")))
    here = one(F.lit(""), F.col("rule"))
    each = lambda names: F.transform(names, lambda k: F.struct(F.concat(F.lit("."), k).alias("suffix"), F.col("rule").alias("message")))
    first = F.element_at("texts", 1)
    rule = F.col("rule")
    broken = (
        F.when(rule == "const", ~same(first)).when(rule == "enum", ~F.exists("texts", same)).when(rule == "type", ~fits).when(rule == "unresolved", F.lit(True))
        .when(rule == "pattern", is_text & ~F.rlike(text, first)).when(rule == "uuid", is_text & ~text.rlike(_UUID)).when(rule == "date_time", is_text & ~_valid_time(text))
        .when(rule == "min_length", is_text & (utf16_length(text) < F.col("number"))).when(rule == "max_length", is_text & (utf16_length(text) > F.col("number")))
        .when(rule == "minimum", is_number & (number < F.col("number"))).when(rule == "maximum", is_number & (number > F.col("number")))
        .when(rule == "min_items", F.size(items) < F.col("number")).when(rule == "max_items", F.size(items) > F.col("number")))
    # After a value of the wrong type, a schema's other rules are not asked.
    asked = (rule == "type") | F.col("types").isNull() | fits
    return F.when(asked, F.when(rule == "required", each(F.array_except("texts", keys))).when(rule == "unexpected", each(F.array_except(keys, "texts")))
                  .when(rule == "unique_items", F.when(F.size(repeated) > 0, one(F.concat(F.lit("["), repeated[0].cast("string"), F.lit("]")), F.col("rule"))))
                  .when(F.coalesce(broken, F.lit(False)), here))


def schema_issues(records: DataFrame, column: str, contract: Column, rules: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, `path`, `message` of every issue, once each, of the JSON text in `column` with the contract that `contract` names.

    `keep` identifies a record.  Text that is no JSON has the issue `malformed`, a contract that is not among `rules` (see `contract_rules`) the issue
    `contract_unknown`; both stand at `$`.  A null text is malformed.
    """
    places = [(r.place, r.rule, r.texts, len(r.branches)) for r in rules.select("place", "rule", "texts", "branches").collect()]
    deepest = max((place.count(".") + place.count("[*]") for place, *_ in places), default=0)
    others: dict[str, list[str]] = {}
    for place, rule, texts, _ in places:
        if rule == "others":
            others[place] = sorted({*texts} & {*others[place]} if place in others else {*texts})
    named = records.withColumn("contract", contract)
    known = rules.select("contract").distinct()
    malformed = named.filter(F.try_parse_json(F.col(column)).isNull()).select(*keep, F.lit("$").alias("path"), F.lit("malformed").alias("message"))
    unknown = named.join(F.broadcast(known), "contract", "left_anti").select(*keep, F.lit("$").alias("path"), F.lit("contract_unknown").alias("message"))
    values = record_values(named, column, [*keep, "contract"], deepest, others).withColumn("_kind", _kind(F.col("value")))
    # Rules are as few as the contracts say and were read by the driver above: values are not shuffled to meet them.
    met = values.join(F.broadcast(rules.filter("rule <> 'others'")), ["contract", "place"])
    found = met.select(*keep, "path", "steps", "branches", F.explode(_violations()).alias("_issue")).select(
        *keep, F.concat("path", "_issue.suffix").alias("path"), "steps", "branches", "_issue.message")
    # Where every alternative has an issue, the value has one; the innermost choices are settled first.
    # Issues of other values go through the same grouping, so a record is taken apart once.
    for level in range(max((n for *_, n in places), default=0), 0, -1):
        hit, choice = F.size("branches") == level, F.get("branches", F.size("branches") - 1)
        steps = F.slice("steps", F.lit(1), choice["depth"])
        settled = found.select(
            *keep, F.when(hit, F.concat(F.lit("$"), F.array_join(steps, ""))).otherwise(F.col("path")).alias("path"), F.when(hit, steps).otherwise(F.col("steps")).alias("steps"),
            F.when(hit, F.slice("branches", F.lit(1), F.greatest(F.size("branches") - 1, F.lit(0)))).otherwise(F.col("branches")).alias("branches"),
            F.when(hit, "any_of").otherwise(F.col("message")).alias("message"), F.when(hit, choice["id"]).alias("_id"), F.when(hit, choice["alternatives"]).alias("_n"),
            F.when(hit, choice["alternative"]).alias("_alternative"))
        found = settled.groupBy(*keep, "path", "steps", "branches", "message", "_id", "_n").agg(F.count_distinct("_alternative").alias("_out")).filter(
            "_id IS NULL OR _out = _n").select(*keep, "path", "steps", "branches", "message")
    return found.select(*keep, "path", "message").distinct().unionByName(malformed).unionByName(unknown)
