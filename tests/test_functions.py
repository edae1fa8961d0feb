import json

import pytest
from pyspark.sql import functions as F

from lamella.functions import scalars as S
from lamella.functions.templates import TemplateError, resolve

SCHEMA = {"type": "object", "required": ["riskLevel"], "properties": {"riskLevel": {"type": "string", "enum": ["LOW", "MEDIUM", "HIGH"]}, "debtRatio": {"type": "number"}}}


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, dict) else 'map<string,string>'}" for k, v in values.items()))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(("spec", "ms"), [(None, 120_000), (" ", 120_000), ("abc", 120_000), ("0s", 120_000), ("-100ms", 120_000), ("120s", 120_000), ("2m", 120_000), ("500ms", 500), ("1h", 3_600_000), ("45", 45_000), ("\t+5S\n", 5000), ("5.5s", 120_000), ("99999999999999999999s", 120_000)])
def test_timeout(spark, spec, ms):
    assert one(spark, S.timeout_ms(F.col("s")), s=spec) == ms


@pytest.mark.parametrize(("name", "yes"), [("TransientException", True), ("java.util.concurrent.TimeoutException", True), ("IOException", True), ("java.net.SocketTimeoutException", True), ("java.net.X", True), ("FatalException", False), ("RuntimeException", False), (None, False)])
def test_classes(spark, name, yes):
    assert one(spark, S.is_transient(F.col("s")), s=name) is yes


@pytest.mark.parametrize(
    ("template", "text"),
    [
        ("s=${context.f.riskScore}, l=${context.f.riskLevel}", "s=88, l=HIGH"),
        ("to ${inputs.supplier}", "to Acme Corp"),
        ("v=[${context.nothing}]", "v=[]"),
        ("plain", "plain"),
        ("", ""),
        (None, ""),
        ("${context.n > 3 ? 'big' : 'small'}", "big"),
        ("${context.nothing ?: 'none'}", "none"),
    ],
)
def test_templates(spark, template, text):
    text_column, gone = resolve(template)
    got = dict(context={"f": json.dumps({"riskScore": 88, "riskLevel": "HIGH"}), "nothing": None, "n": "10"}, inputs={"supplier": "Acme Corp"})
    assert one(spark, text_column, **got) == text
    assert one(spark, gone, **got) is False


def test_missing_key(spark):
    assert one(spark, resolve("${context.gone}")[1], context={"a": "1"}, inputs={"b": "2"}) is True


@pytest.mark.parametrize("template", ["${T(java.lang.System).exit(0)}", "${context.a.length()}", "${new X()}", "${financeAnalysis}"])
def test_forbidden(template):
    with pytest.raises(TemplateError):
        resolve(template)


@pytest.mark.parametrize(("text", "found"), [('x\n```json\n{"a":1}\n```\n', '{"a":1}'), ('text {"a":1} tail', '{"a":1}'), (" no json here ", "no json here"), ("", ""), (None, "")])
def test_json_text(spark, text, found):
    assert one(spark, S.json_text(F.col("s")), s=text) == found


@pytest.mark.parametrize(("text", "valid"), [('{"riskLevel":"HIGH","debtRatio":0.75}', True), ('{"riskLevel":"LOW"}', True), ('{"debtRatio":0.5}', False), ('{"riskLevel":"CRITICAL"}', False), ("no", False), (None, False), ('{"riskLevel":"LOW","debtRatio":"x"}', False)])
def test_json_schema(spark, text, valid):
    assert one(spark, S.json_valid(F.col("s"), SCHEMA), s=text) is valid


def test_unknown_keyword():
    with pytest.raises(ValueError, match="pattern"):
        S.json_valid(F.lit("{}"), {"pattern": "x"})


def test_backoff_and_rest(spark):
    assert [r.v for r in spark.range(1, 3).select(S.backoff_ms(F.col("id"), 100, 1.5).alias("v")).collect()] == [100, 150]
    assert one(spark, S.remaining_ms(F.lit(5000), 2000), s="") == 0
    assert one(spark, S.remaining_ms(F.lit(5000), None), s="") is None
    assert one(spark, S.redacted(F.col("s")), s="secret sk-12345") == "secret sk-***"


@pytest.mark.parametrize(
    ("template", "text"),
    [
        ("${context.a == null ? 'none' : 'some'}", "some"),
        ("${context.n == null ? 'none' : 'some'}", "none"),
        ("${context.n != null ? 'some' : 'none'}", "none"),
        ("${context.a == '1' and inputs.b == '3' ? 'x' : 'y'}", "y"),
        ("${context.a == '1' or inputs.b == '3' ? 'x' : 'y'}", "x"),
        ("${not context.a == '1' ? 'x' : 'y'}", "y"),
        ("${context.a > 0 ? 'a:b' : 'c'}", "a:b"),
    ],
)
def test_tests_in_templates(spark, template, text):
    found, gone = resolve(template)
    values = {"context": {"a": "1", "n": None}, "inputs": {"b": "2"}}
    assert (one(spark, found, **values), one(spark, gone, **values)) == (text, False)


def test_missing_keys_count_where_they_are_read(spark):
    values = {"context": {"a": "1"}, "inputs": {"b": "2"}}
    assert one(spark, resolve("${context.a == '1' ? 'x' : context.gone}")[1], **values) is False
    assert one(spark, resolve("${context.a == '2' ? 'x' : context.gone}")[1], **values) is True


def test_json_errors(spark):
    schema = {"type": "object", "required": ["k", "m"], "properties": {"k": {"type": "integer", "minimum": 3}, "l": {"type": "array", "items": {"type": "string"}}}}
    for text, wrong in (('{"k":5.0,"m":1}', []), ('{"k":1.5}', ["$: required property m is missing", "$.k: integer expected", "$.k: must be at least 3"]), ("x", ["not JSON"]), ("[1]", ["$: object expected"]), ('{"k":4,"m":1,"l":["a",2]}', ["$.l: an item doesn't meet the schema"])):
        assert one(spark, S.json_errors(F.col("s"), schema), s=text) == wrong
    assert one(spark, S.json_map(F.col("s")), s='{"a":1,"b":"x"}') == {"a": "1", "b": "x"} and one(spark, S.json_map(F.col("s")), s="[1]") is None
