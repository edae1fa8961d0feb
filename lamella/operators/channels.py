"""Channel state: concurrent writes folded in a fixed order by a reducer per channel.

writes: run_id, super_step, node_ord, write_ord, channel, value. state: run_id, channel, value, version. A channel that
isn't declared overwrites. The order of writes is data, never row order. One shuffle on (run_id, channel) folds all
channels; overwriting, maxima and versions combine on the map side, so a channel with very many writes costs one row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("super_step", "node_ord", "write_ord")
KEYS = ("run_id", "channel")
Fold = Callable[[Column, Column], Column]


def reducer_of(reducers: dict[str, str], channel: Column | str = "channel") -> Column:
    """The reducer of a channel; declarations are few and live on the driver."""
    out, c = F.lit("OVERWRITE"), F.col(channel) if isinstance(channel, str) else channel
    for name, reducer in reducers.items():
        out = F.when(c == name, reducer).otherwise(out)
    return out


def position() -> Column:
    return F.struct(*ORDER)


def overwritten(value: str = "value") -> Column:
    """The last write; a last write of null gives null."""
    return F.max_by(value, position())


def in_order(value: str | Column = "value", only: Column | None = None) -> Column:
    """All writes as an array in order, nulls included. This is the size of what CONCAT and CUSTOM return."""
    item = F.struct(*ORDER, (F.col(value) if isinstance(value, str) else value).alias("value"))
    return F.transform(F.array_sort(F.collect_list(F.when(only, item) if only is not None else item)), lambda x: x["value"])


def concatenated(value: str = "value") -> Column:
    """Strings end to end, without a separator; null writes don't count."""
    return F.array_join(in_order(value), "")


def listed(value: str = "value") -> Column:
    """Scalars as one list in order; concat_json joins values that may be lists themselves."""
    return in_order(value)


def joined(a: Column, b: Column) -> Column:
    """Two variants as CONCAT joins them: no value gives way, lists are flattened, two strings become one, anything else is a list of both."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    items = lambda v: F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    text = lambda v: F.try_variant_get(v, "$", "string")
    both = F.when((kind(a) == "STRING") & (kind(b) == "STRING"), F.concat(text(a), text(b)).cast("variant")).otherwise(F.concat(items(a), items(b)).cast("variant"))
    return F.when(kind(a) == "VOID", b).otherwise(both)


def concat_json(value: str | Column = "value", only: Column | None = None) -> Column:
    """CONCAT of values that are JSON text, in order, as JSON text; what isn't JSON counts as null."""
    items = F.transform(in_order(value, only), F.try_parse_json)
    return F.to_json(F.aggregate(items, F.lit(None).cast("variant"), joined))


def folded(fold: Fold, value: str | Column = "value", only: Column | None = None) -> Column:
    """A custom reducer, applied pairwise from the first write on."""
    items = in_order(value, only)
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.try_element_at(items, F.lit(1)), fold)


def after_last(writes: DataFrame, odd: Column) -> DataFrame:
    """writes with `later`: whether no odd write of the same channel comes at or behind it. An odd write replaces what was
    there and gives way to the next one, so a maximum only looks at later writes. Combines on the map side."""
    last = writes.where(odd).groupBy(*KEYS).agg(F.max(position()).alias("_last"))
    seen = writes.join(last, list(KEYS), "left")
    return seen.withColumn("later", F.col("_last").isNull() | (position() > F.col("_last"))).drop("_last")


def back() -> Column:
    """The place of a write counted backwards: of equal values the first is kept."""
    return F.struct(*(-F.col(c) for c in ORDER))


def greatest_write(writes: DataFrame, value: str = "value") -> DataFrame:
    """MAX with the rule for odd numbers: a NaN or a null replaces what was there, and the next write replaces it."""
    seen = after_last(writes, F.col(value).isNull() | F.isnan(F.col(value).cast("double")))
    n = F.count(F.when(F.col("later"), 1))
    return seen.groupBy(*KEYS).agg(F.when(n > 0, F.max(F.when(F.col("later"), F.col(value)))).otherwise(F.max_by(value, position())).alias(value))


def fold(writes: DataFrame, reducers: dict[str, str], state: DataFrame | None = None, custom: dict[str, Fold] | None = None, types: dict[str, str | None] | None = None) -> DataFrame:
    """The state after the writes. Values are text; those of a CONCAT channel whose type is list or json are JSON.

    What was there counts as the first write. MAX compares pairwise: whole numbers exactly, other numbers as doubles,
    the first of equal ones stays; a null, a NaN and text replace what was there and give way to the next write. Text
    CONCAT leaves nulls out. A version is 0 at a channel's first write or input, and one more with every later write.
    A custom channel without a function, and a channel without a reducer, are errors before anything runs.
    """
    custom, types = custom or {}, types or {}
    if missing := [c for c, r in reducers.items() if r is None]:
        raise ValueError(f"no reducer for {missing}")
    if missing := [c for c, r in reducers.items() if r == "CUSTOM" and c not in custom]:
        raise ValueError(f"no custom reducer for {missing}")
    rows = writes.select("run_id", "channel", *ORDER, "value", F.lit(None).cast("long").alias("version"))
    if state is not None:
        rows = rows.unionByName(state.select("run_id", "channel", *(F.lit(-1).alias(c) for c in ORDER), "value", "version"))
    rows = rows.withColumn("reducer", reducer_of(reducers))
    number, exact = F.expr("try_cast(value AS double)"), F.expr("try_cast(value AS bigint)")
    if "MAX" in reducers.values():
        most = F.col("reducer") == "MAX"
        rows = after_last(rows.where(most), number.isNull() | F.isnan(number)).unionByName(rows.where(~most).withColumn("later", F.lit(True)))
    else:
        rows = rows.withColumn("later", F.lit(True))
    later = F.col("later")
    top = F.when(
        F.count(F.when(later, 1)) > 0,
        F.when(F.count(F.when(later, exact)) == F.count(F.when(later, 1)), F.max_by("value", F.when(later, F.struct(exact.alias("n"), back().alias("b"))))).otherwise(
            F.max_by("value", F.when(later, F.struct(number.alias("n"), back().alias("b"))))
        ),
    ).otherwise(overwritten())
    lists = [c for c, r in reducers.items() if r == "CONCAT" and (types.get(c) or "").lower() in ("list", "json")]
    strings = (F.col("reducer") == "CONCAT") & ~F.col("channel").isin(lists)
    own = {**{c: folded(f, only=F.col("channel") == c) for c, f in custom.items() if reducers.get(c) == "CUSTOM"}, **{c: concat_json(only=F.col("channel") == c) for c in lists}}
    out = rows.groupBy(*KEYS, "reducer").agg(
        overwritten().alias("last"),
        top.alias("top") if "MAX" in reducers.values() else F.lit(None).cast("string").alias("top"),
        F.array_join(in_order(only=strings), "").alias("joined"),
        (F.coalesce(F.max("version"), F.lit(-1)) + F.count(F.when(F.col("super_step") >= 0, 1))).alias("version"),
        *(c.alias(f"_own_{i}") for i, c in enumerate(own.values())),
    )
    done = F.when(F.col("reducer") == "CONCAT", F.col("joined")).when(F.col("reducer") == "MAX", F.col("top")).otherwise(F.col("last"))
    for i, c in enumerate(own):
        done = F.when(F.col("channel") == c, F.col(f"_own_{i}")).otherwise(done)
    return out.select("run_id", "channel", done.alias("value"), "version")


def routed(outputs: DataFrame) -> DataFrame:
    """Node outputs (run_id, super_step, node_ord, node_id, content, channel_writes map) as writes.

    Explicit writes suppress the content; content goes to the channel with the node's name; no content, no write.
    """
    own = F.create_map(F.col("node_id"), F.col("content"))
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce(F.size("channel_writes"), F.lit(0)) > 0
    pairs = F.when(given, F.col("channel_writes")).when(F.col("content").isNotNull(), own).otherwise(none)
    return outputs.select("run_id", "super_step", "node_ord", "node_id", F.posexplode(F.map_entries(pairs)).alias("write_ord", "w")).select("run_id", "super_step", "node_ord", "write_ord", "node_id", F.col("w.key").alias("channel"), F.col("w.value").alias("value"))


def versions(writes: DataFrame, inputs: tuple[str, ...] = ()) -> DataFrame:
    """Every write with the version it made; channels that start as inputs begin at 1."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    first = F.when(F.col("channel").isin(*inputs), 0).otherwise(-1) if inputs else F.lit(-1)
    return writes.withColumn("version", (F.row_number().over(w) + first).cast("long"))


def values(state: DataFrame) -> DataFrame:
    """(run_id, context map) of all channels."""
    return state.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "value")))).alias("context"))
