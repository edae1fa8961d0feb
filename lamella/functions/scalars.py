"""Column functions: durations, backoff, error classes, redaction, JSON in text."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TIMEOUT_MS = 120_000
#: Error classes that are worth another attempt.
TRANSIENT = ("TransientException", "TimeoutException", "InterruptedException", "IOException", "SocketTimeoutException")
TRANSIENT_PREFIXES = ("java.net.", "org.springframework.web.client.")


def timeout_ms(spec: Column) -> Column:
    """`500ms`, `45`, `45s`, `2m`, `1h` in milliseconds; anything else, and nothing above zero, is the default."""
    s = F.lower(F.regexp_replace(spec, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    n = F.regexp_extract(s, r"^([+-]?[0-9]+)(ms|s|m|h)?$", 1).try_cast("bigint")
    unit = F.regexp_extract(s, r"^([+-]?[0-9]+)(ms|s|m|h)?$", 2)
    factor = F.when(unit == "ms", 1).when(unit == "m", 60_000).when(unit == "h", 3_600_000).otherwise(1000).cast("bigint")
    ms = F.try_multiply(n, factor)
    return F.when(ms > 0, ms).otherwise(F.lit(DEFAULT_TIMEOUT_MS).cast("bigint"))


def backoff_ms(attempt: Column, initial_ms: int = 1000, multiplier: float = 2.0) -> Column:
    return F.floor(F.lit(initial_ms) * F.pow(F.lit(multiplier), attempt - 1)).cast("bigint")


def duration_ms(started: Column, ended: Column, now: Column) -> Column:
    """From start to end, or to now where there is no end yet."""
    return F.unix_millis(F.coalesce(ended, now).cast("timestamp")) - F.unix_millis(started.cast("timestamp"))


def workflow_exceeded(elapsed_ms: Column, total_ms: int | None) -> Column:
    return F.lit(False) if total_ms is None else elapsed_ms >= total_ms


def remaining_ms(elapsed_ms: Column, total_ms: int | None) -> Column:
    """Null without a total; never negative."""
    return F.lit(None).cast("bigint") if total_ms is None else F.greatest(F.lit(0).cast("bigint"), F.lit(total_ms) - elapsed_ms)


def is_transient(error_class: Column) -> Column:
    """By the simple or full class name; null and everything unknown is fatal."""
    simple = F.substring_index(error_class, ".", -1)
    prefix = F.lit(False)
    for p in TRANSIENT_PREFIXES:
        prefix |= F.startswith(error_class, F.lit(p))
    return F.coalesce(simple.isin(*TRANSIENT) | prefix, F.lit(False))


def redacted(text: Column, pattern: str = r"sk-[A-Za-z0-9]+", by: str = "sk-***") -> Column:
    return F.regexp_replace(text, pattern, by)


def json_text(text: Column) -> Column:
    """The first fenced body, else from the first { to the last }, else the trimmed text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)\s*```", 1)
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when(fenced != "", fenced).when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1)).otherwise(F.trim(text))


KNOWN = {"$schema", "title", "description", "type", "properties", "required", "enum", "minimum", "maximum", "items"}
TYPES = {"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT%", "array": "ARRAY%", "null": "VOID"}


def json_errors(text: Column, schema: dict[str, Any]) -> Column:
    """What is wrong with JSON text under a schema of the keywords in KNOWN, in the order of the schema; others raise."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(F.array_compact(F.array(F.lit(None).cast("string"), *faults(v, schema, "$"))))


def json_valid(text: Column, schema: dict[str, Any]) -> Column:
    """Whether JSON text meets a schema. Text that isn't JSON is invalid."""
    return F.size(json_errors(text, schema)) == 0


def json_map(text: Column) -> Column:
    """A JSON object as a map of texts; null for anything else."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,string>"))


def faults(v: Column, schema: dict[str, Any], where: str) -> list[Column]:
    """Messages about one value, null where all is well."""
    if more := set(schema) - KNOWN:
        raise ValueError(f"schema keywords {sorted(more)} aren't supported")
    kind, number = F.coalesce(F.schema_of_variant(v), F.lit("MISSING")), F.try_variant_get(v, "$", "double")
    numeric = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    out = []

    def rule(ok: Column, message: str) -> None:
        out.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{where}: {message}")))

    if t := schema.get("type"):
        rule({"number": numeric, "integer": numeric & (number == F.floor(number))}.get(t, kind.like(TYPES.get(t, t))), f"{t} expected")
    if "enum" in schema:
        rule(F.to_json(v).isin(*(json.dumps(x) for x in schema["enum"])), "not in the enumeration")
    if "minimum" in schema:
        rule(~numeric | (number >= schema["minimum"]), f"must be at least {schema['minimum']}")
    if "maximum" in schema:
        rule(~numeric | (number <= schema["maximum"]), f"must be at most {schema['maximum']}")
    child = lambda name: F.try_variant_get(v, f"$['{name}']", "variant")
    is_object = kind.startswith("OBJECT")
    for name in schema.get("required", ()):
        rule(~is_object | child(name).isNotNull(), f"required property {name} is missing")
    for name, inner in schema.get("properties", {}).items():
        out += [F.when(child(name).isNotNull(), c) for c in faults(child(name), inner, f"{where}.{name}")]
    if inner := schema.get("items"):
        items = F.try_variant_get(v, "$", "array<variant>")
        wrong = F.exists(items, lambda x: F.size(F.array_compact(F.array(F.lit(None).cast("string"), *faults(x, inner, "item")))) > 0)
        rule(~kind.startswith("ARRAY") | ~wrong, "an item doesn't meet the schema")
    return out


def retry_prompt(original: Column, schema: dict[str, Any], errors: Column) -> Column:
    """The original prompt behind what went wrong with the last answer."""
    return F.concat(F.lit(f"The last answer didn't meet this schema:\n{json.dumps(schema)}\nErrors:\n- "), F.array_join(errors, "\n- "), F.lit("\n\n"), original)
