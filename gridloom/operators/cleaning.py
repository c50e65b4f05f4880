"""From raw tables to canonical ones: clocks, contracts, the cleaning chain with its counters, events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normalize_message, normalise_code, strip
from . import islands, telemetry

#: Columns of canonical readings before their channels, and of canonical events, with their types.
IDENTITY = (("source", "string"), ("site", "string"), ("turbine_id", "string"), ("timestamp_utc", "timestamp"))
EVENTS = (
    ("source", "string"), ("site", "string"), ("turbine_id", "string"), ("start_utc", "timestamp"), ("end_utc", "timestamp"),
    ("code", "string"), ("message", "string"), ("category", "string"), ("is_fault", "boolean"), ("raw", "string"),
)
UNMAPPED = "unmapped"


def local_to_utc(text: Column, zone: str = "UTC") -> Column:
    """Instant of a text or local timestamp; null if it can't be parsed, or if zone skips or repeats that local time.

    Text with an offset of its own is taken at its word. Local times are turned
    by civil-time arithmetic, so the session should run in UTC.
    """
    own = text.cast("string").rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})\s*$")
    local = text.try_cast("timestamp_ntz")
    there = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    # another instant an hour or half an hour away with the same label: the label is repeated
    twice = F.lit(False)
    for minutes in (-60, -30, 30, 60):
        twice = twice | (there(F.timestamp_add("MINUTE", F.lit(minutes), utc)) == local)
    clear = (there(utc) == local) & ~twice
    back = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.when(clear, utc)).cast("timestamp")
    return F.when(own, text.try_cast("timestamp")).otherwise(back)


def parse_times(df: DataFrame, column: str, zone: str = "UTC") -> DataFrame:
    """df with column as instants, without the rows that have none."""
    if column not in df.columns:
        raise KeyError(f"there is no column {column!r}")
    return df.withColumn(column, local_to_utc(F.col(column), zone)).where(F.col(column).isNotNull())


def contract_faults(df: DataFrame, wanted: Sequence[tuple[str, str]], numeric: Sequence[str] = ()) -> list[str]:
    """What is wrong with df's schema: absent columns, other types, channels that are no numbers. Reads no rows."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = [f"no column {n}" for n, _ in wanted if n not in kinds] + [f"no channel {c}" for c in numeric if c not in kinds]
    out += [f"{n} is {kinds[n].simpleString()}, not {k}" for n, k in wanted if n in kinds and kinds[n].simpleString() != k]
    return out + [f"{c} is {kinds[c].simpleString()}, not a number" for c in numeric if c in kinds and not isinstance(kinds[c], T.NumericType)]


def validate_readings(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """df, if its schema is that of canonical readings; an error that names all faults otherwise."""
    if faults := contract_faults(df, IDENTITY, channels):
        raise ValueError("; ".join(faults))
    return df


def validate_events(df: DataFrame) -> DataFrame:
    """df, if its schema is that of canonical events; an error that names all faults otherwise."""
    if faults := contract_faults(df, EVENTS):
        raise ValueError("; ".join(faults))
    return df


@dataclass(frozen=True)
class CleanRules:
    """What the cleaning chain does to a source."""

    sentinels: Mapping[str, Sequence[float]] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    floors: Mapping[str, float] = field(default_factory=dict)
    zone: str = "UTC"
    step: int = 600
    drop_empty: bool = False
    duplicates: str = "mean"


def clean(df: DataFrame, keys: list[str], time: str, channels: Sequence[str], rules: CleanRules) -> tuple[DataFrame, DataFrame]:
    """Readings through the whole chain, on the grid of each key, and one row of counters.

    keys name a series and its year. Times are parsed, sentinels go, repeated
    times become their mean (or first row), the grid is laid, bounds and floors
    are applied, and rows without any channel are dropped if asked for. The
    grid's column step has epoch seconds. Counters: rows_in, unparseable,
    repeated, inserted, rows_out, and per channel sentinel_, bounds_ and floor_.
    """
    marks = lambda name, before, after: {f"{name}_{c}": F.count(before(c)) - F.count(after(c)) for c in channels}
    parsed = parse_times(df, time, rules.zone)
    seconds = F.unix_seconds(F.col(time))
    freed = telemetry.drop_sentinels(parsed, rules.sentinels).withColumn("step", seconds)
    grouped = [*keys, "step"]
    if rules.duplicates == "mean":
        single = telemetry.mean_duplicates(freed, grouped, list(channels))
    else:
        single = telemetry.first_duplicates(freed, grouped, [F.monotonically_increasing_id()]).select(*grouped, *channels)
    grid = islands.regular_grid(single, keys, "step", rules.step)
    bounded = telemetry.apply_bounds(grid, rules.bounds)
    out = telemetry.apply_floors(bounded, rules.floors)
    if rules.drop_empty:
        out = out.where(F.coalesce(*[F.col(c).isNotNull() | F.lit(None).cast("boolean") for c in channels], F.lit(False)))
    low = lambda c: F.count_if(F.col(c) < rules.floors[c]) if c in rules.floors else F.lit(0).cast("long")
    first = df.agg(F.count("*").alias("rows_in"))
    second = parsed.agg(F.count("*").alias("_parsed"), *[F.count(c).alias(f"_p_{c}") for c in channels])
    third = freed.agg(*[F.count(c).alias(f"_f_{c}") for c in channels])
    fourth = single.agg(F.count("*").alias("_single"))
    fifth = grid.agg(F.count("*").alias("_grid"), *[F.count(c).alias(f"_g_{c}") for c in channels])
    sixth = bounded.agg(*[F.count(c).alias(f"_b_{c}") for c in channels], *[low(c).alias(f"floor_{c}") for c in channels])
    last = out.agg(F.count("*").alias("rows_out"))
    row = first
    for part in (second, third, fourth, fifth, sixth, last):  # single rows
        row = row.crossJoin(part)
    counts = row.select(
        "rows_in", (F.col("rows_in") - F.col("_parsed")).alias("unparseable"), (F.col("_parsed") - F.col("_single")).alias("repeated"),
        (F.col("_grid") - F.col("_single")).alias("inserted"), "rows_out",
        *[(F.col(f"_p_{c}") - F.col(f"_f_{c}")).alias(f"sentinel_{c}") for c in channels],
        *[(F.col(f"_g_{c}") - F.col(f"_b_{c}")).alias(f"bounds_{c}") for c in channels], *[f"floor_{c}" for c in channels],
    )
    return out, counts


def raw_payload(columns: Sequence[str]) -> Column:
    """A row as compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def normalize_events(df: DataFrame, codes: Sequence[str] = (), categories: Sequence[str] = (), default: bool | None = None) -> DataFrame:
    """Canonical events from a table with some of their columns; others are null, events without a start go.

    Codes and categories are matched in lower case; messages are normalised.
    """
    there = set(df.columns)
    rows = df.withColumns({n: F.lit(None).cast(k) for n, k in EVENTS if n not in there})
    fold = lambda c: F.lower(strip(F.col(c)))
    filled = lambda c: F.when(fold(c) != "", fold(c))
    fault = telemetry.fault_flag(filled("code"), filled("category"), [c.lower() for c in codes], [c.lower() for c in categories], default)
    rows = rows.withColumns(
        {
            "start_utc": local_to_utc(F.col("start_utc")), "end_utc": local_to_utc(F.col("end_utc")), "message": normalize_message(F.col("message")),
            "code": strip(F.col("code").cast("string")), "is_fault": fault,
        }
    )
    return rows.where("start_utc is not null").select(*[F.col(n).cast(k).alias(n) for n, k in EVENTS])


def categorize_status(events: DataFrame, categories: Mapping[str, Sequence[str]], faults: Sequence[str]) -> DataFrame:
    """Events with their category by normalised message, and the provider's own status and availability class out of raw.

    A message that no category lists is UNMAPPED, and whether it is a fault unknown.
    """
    pairs = [(m, c) for c, messages in categories.items() for m in messages]
    table = events.sparkSession.createDataFrame(pairs or [(None, None)], "_m string, _c string")
    table = table.select(normalize_message(F.col("_m")).alias("_m"), "_c").where("_c is not null").dropDuplicates(["_m"])
    named = events.drop("category").join(F.broadcast(table), normalize_message(F.col("message")) == F.col("_m"), "left")
    named = named.withColumn("category", F.coalesce("_c", F.lit(UNMAPPED))).drop("_m", "_c")
    return named.withColumns(
        {
            "provider_status": F.get_json_object("raw", "$.Status"), "provider_iec": F.get_json_object("raw", "$['IEC category']"),
            "is_fault": F.when(F.col("category") != UNMAPPED, F.col("category").isin(*faults)),
        }
    )


def status_summary(events: DataFrame) -> DataFrame:
    """Counts of rows and messages, unmapped ones, and those among stops and forced outages."""
    bare, stop, forced = F.col("category") == UNMAPPED, F.col("provider_status") == "Stop", F.col("provider_iec") == "Forced outage"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return events.agg(
        F.count("*").alias("rows"), n(bare).alias("unmapped_rows"), n(stop).alias("stop_rows"), n(bare & stop).alias("unmapped_stop_rows"),
        n(forced).alias("forced_rows"), n(bare & forced).alias("unmapped_forced_rows"), F.count_distinct("message").alias("messages"),
        F.count_distinct(F.when(bare, F.col("message"))).alias("unmapped_messages"),
    )


def member_flag(df: DataFrame, steps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with name: whether its keys are among steps, which may repeat them."""
    known = steps.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(known, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def in_grid(events: DataFrame, grid: DataFrame, start: str, step: int = 600) -> DataFrame:
    """events(turbine, start) with in_grid: whether the step that start falls in is in grid(turbine, step)."""
    floor = F.col(start) - F.pmod(F.col(start), F.lit(step))
    return member_flag(events.withColumn("step", floor), grid, ["turbine", "step"], "in_grid").drop("step")


def join_labels(df: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of labels by keys; label columns that df has already are replaced."""
    new = [c for c in labels.columns if c not in keys]
    return df.drop(*new).join(labels, keys, "left")


def code_map(df: DataFrame, code: str, description: str, order: str) -> DataFrame:
    """code, description of rows with both; of a repeated code the later row in the given order wins."""
    rows = df.select(normalise_code(F.col(code)).alias("code"), F.col(description).alias("description"), F.col(order).alias("_o"))
    return rows.where("code is not null and description is not null").groupBy("code").agg(F.max_by("description", "_o").alias("description"))
