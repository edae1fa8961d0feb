import math

import pytest
from pyspark.sql import functions as F

from lamella.operators import channels as C


def writes(spark, values, channel="x", kind="string"):
    return spark.createDataFrame([("r", i, 0, 0, channel, v) for i, v in enumerate(values)], f"run_id string, super_step int, node_ord int, write_ord int, channel string, value {kind}")


def state(spark, value, version=0, channel="x"):
    return spark.createDataFrame([("r", channel, value, version)], "run_id string, channel string, value string, version long")


@pytest.mark.parametrize(
    ("reducer", "before", "values", "value"),
    [
        ("OVERWRITE", None, ["b"], "b"),
        ("OVERWRITE", "a", ["b"], "b"),
        ("OVERWRITE", "a", ["b", None], None),
        ("CONCAT", None, ["solo"], "solo"),
        ("CONCAT", "a", ["b"], "ab"),
        ("MAX", None, ["5"], "5"),
        ("MAX", "9", ["3"], "9"),
        ("MAX", "1.5", ["2.5"], "2.5"),
        ("MAX", "1.5", ["2"], "2"),
        ("MAX", "a", ["b"], "b"),
        ("MAX", "9007199254740993", ["9007199254740992"], "9007199254740993"),
        ("MAX", "9007199254740992", ["9007199254740993"], "9007199254740993"),
        ("CUSTOM", "a", ["b"], "a+b"),
        ("CUSTOM", None, ["solo"], "solo"),
    ],
)
def test_reducers(spark, reducer, before, values, value):
    got = C.fold(writes(spark, values), {"x": reducer}, None if before is None else state(spark, before), {"x": lambda a, b: F.concat(a, F.lit("+"), b)})
    assert [(r.value, r.version) for r in got.collect()] == [(value, len(values) - (before is None))]


def test_four_reducers_at_once(spark):
    w = spark.createDataFrame([("r", 1, n, 0, c, v) for n, vs in ((1, "bb1b"), (0, "cc2c")) for c, v in zip("XYZW", vs, strict=True)], "run_id string, super_step int, node_ord int, write_ord int, channel string, value string")
    got = C.fold(w, {"X": "OVERWRITE", "Y": "CONCAT", "Z": "MAX", "W": "CUSTOM"}, None, {"W": lambda a, b: F.concat(a, F.lit("+"), b)})
    assert {r.channel: r.value for r in got.collect()} == {"X": "b", "Y": "cb", "Z": "2", "W": "c+b"}


@pytest.mark.parametrize(("values", "value"), [([2.0, math.nan, 1.0], 1.0), ([2.0, math.nan], math.nan), ([5.0, None], None), ([5.0, None, 3.0, 4.0], 4.0), ([1.0, 3.0, 2.0], 3.0)])
def test_max_with_odd_numbers(spark, values, value):
    got = C.greatest_write(writes(spark, values, kind="double")).first().value
    assert got == value or (math.isnan(got) and math.isnan(value))


@pytest.mark.parametrize(
    ("values", "value"),
    [(["9", None, "5", "3"], "5"), (["9", "x", "5", "3"], "5"), (["2", "NaN", "1"], "1"), (["1", "1.0"], "1"), (["007", "3"], "007"), (["5", None], None), (["3", "a"], "a"), (["2", "10", "9.5"], "10"), (["2.5", "2.50"], "2.5")],
)
def test_max_is_pairwise(spark, values, value):
    assert C.fold(writes(spark, values), {"x": "MAX"}).first().value == value
    assert C.fold(writes(spark, values[1:]), {"x": "MAX"}, state(spark, values[0])).first().value == value


@pytest.mark.parametrize(
    ("values", "value"),
    [(['"a"', '"b"'], '"ab"'), (["[1]", "[2,3]"], "[1,2,3]"), (["[1]", '"x"'], '[1,"x"]'), (['"x"', "[1]"], '["x",1]'), (["1", "2"], "[1,2]"), (['"a"', None], '["a",null]'), ([None, '"a"', '"b"', "1"], '["ab",1]'), (['{"k":1}', '"a"'], '[{"k":1},"a"]'), (["[1]", "[]"], "[1]")],
)
def test_concat_of_typed_values(spark, values, value):
    for kind in ("list", "json"):
        assert C.fold(writes(spark, values), {"x": "CONCAT"}, types={"x": kind}).first().value == value
    assert C.fold(writes(spark, values[1:]), {"x": "CONCAT"}, state(spark, values[0]), types={"x": "list"}).first().value == value


def test_channel_without_reducer(spark):
    with pytest.raises(ValueError, match="x"):
        C.fold(writes(spark, ["a"]), {"x": None})


def test_lists_stay_in_order(spark):
    assert writes(spark, ["a", None, "c"]).groupBy("run_id").agg(C.listed().alias("v")).first().v == ["a", None, "c"]


def test_custom_without_function(spark):
    with pytest.raises(ValueError, match="x"):
        C.fold(writes(spark, ["a"]), {"x": "CUSTOM"})


def test_empty(spark):
    assert C.fold(writes(spark, []), {"x": "MAX"}).count() == 0


def test_routing_and_versions(spark):
    out = spark.createDataFrame([("r", 0, 0, "n", "c", {"x": "1"}), ("r", 0, 1, "m", "c", {}), ("r", 0, 2, "o", None, None)], "run_id string, super_step int, node_ord int, node_id string, content string, channel_writes map<string,string>")
    assert {(r.channel, r.value) for r in C.routed(out).collect()} == {("x", "1"), ("m", "c")}
    assert [r.version for r in C.versions(writes(spark, ["a", "b"])).orderBy("super_step").collect()] == [0, 1]
    assert [r.version for r in C.versions(writes(spark, ["a", "b"]), ("x",)).orderBy("super_step").collect()] == [1, 2]
