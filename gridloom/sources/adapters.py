"""Readers of three kinds of published exports into canonical readings and events.

A reader takes a whole folder. Files are grouped by their layout (columns,
delimiter), which their heads tell, and each layout is one scan; columns that a
file lacks are null. Repeats of a key are collapsed and their conflicts are an
error, as no value may be picked.
"""

from __future__ import annotations

import csv
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalise_code, strip
from ..operators import cleaning, telemetry
from ..operators.tables import written
from ..operators.text import evaluated
from .readers import ADAPTERS

HEAD_LINES = 48


class SourceAdapter(Protocol):
    """What a source offers: canonical readings and events of a folder."""

    def readings(self, spark: SparkSession, path: str) -> DataFrame: ...

    def events(self, spark: SparkSession, path: str) -> DataFrame: ...


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_heads(spark: SparkSession, path: str, pattern: str = "*", lines: int = HEAD_LINES) -> DataFrame:
    """file, comments (array of lines that start with #) and header (the first other line) of each text file under path."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n")).where("at = 0")
    comment = F.col("value").startswith("#")
    other = F.when(~comment, F.col("n"))
    first = rows.groupBy("file").agg(F.min("n").alias("first"), F.min(other).alias("_n"), F.min_by("value", other).alias("_h"), F.count_if(comment).alias("_c"))
    first = written(first, "heads")  # a row a file; lines are dealt out only where there are comments, and only these
    header = F.when(F.col("_n") - F.col("first") < lines, F.col("_h")).alias("header")
    if not first.where("_c > 0").limit(1).count():
        return first.select("file", F.array().cast("array<string>").alias("comments"), header)
    said = rows.where(comment).join(first.select("file", "_n", "first"), "file").where(F.col("n") - F.col("first") < lines)
    said = said.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("comments"))
    return first.join(said, "file", "left").where(f"comments is not null or _n - first < {lines}").select("file", F.coalesce("comments", F.array().cast("array<string>")).alias("comments"), header)


def preamble_value(comments: Column, key: str) -> Column:
    """Value of a '# key: value' line, whatever the key's case."""
    pattern = rf"(?i)^#\s*{key}\s*:\s*(.*?)\s*$"
    return F.nullif(F.regexp_extract(F.get(F.filter(comments, lambda c: c.rlike(pattern)), 0), pattern, 1), F.lit(""))


def layout(header: str, comments: Sequence[str], least: int = 3) -> tuple[tuple[str, ...], str, bool]:
    """Column names, delimiter, and whether the header is a line of its own.

    A last comment line of at least least fields is the header, and what
    follows it is data.
    """
    told = comments[-1].lstrip("# ") if comments else ""
    for line, own in ((told, False), (header or "", True)):
        delimiter = max(",;\t", key=line.count)
        names = tuple(n.strip() for n in next(csv.reader([line], delimiter=delimiter), []))
        if own or len(names) >= least:
            return names, delimiter, own
    raise AssertionError("unreachable")


def read_tables(
    spark: SparkSession, path: str, wanted: Sequence[str] | None = None, pattern: str = "*.csv", heads: DataFrame | None = None, ragged: str | None = None
) -> DataFrame:
    """file and the wanted columns (or all) of every file under path that fits pattern, as text; null where a file lacks one.

    A row with too few fields has nulls for them, one with too many loses the
    last; none is dropped. ragged names a column for the whole line of such a
    row, null for others. heads: those of the files, if they were read before.
    The different heads come to the driver. Files of one layout are read as a
    folder; only if there are several, the files' names come to the driver too.
    """
    heads = heads if heads is not None else file_heads(spark, path, pattern)
    told = F.try_element_at("comments", F.lit(-1)).alias("told")
    kinds = {(r["header"], r["told"]): layout(r["header"], [] if r["told"] is None else [r["told"]]) for r in heads.select("header", told).distinct().collect()}
    found: dict[tuple, list[str] | str] = {kind: path for kind in kinds.values()}
    if len(found) > 1:
        found = {kind: [] for kind in found}
        for row in heads.select("file", "header", told).collect():
            found[kinds[row["header"], row["told"]]].append(unquote(row["file"]))  # the names that files are known by are escaped
    out = None
    for (names, delimiter, own), files in sorted(found.items()):
        schema = ", ".join(f"`{n}` string" for n in [*names, *([ragged] if ragged else [])])
        reader = spark.read.schema(schema).options(sep=delimiter, comment="#", header=own, mode="PERMISSIVE", enforceSchema=True)
        if files == path:
            reader = reader.options(recursiveFileLookup=True, pathGlobFilter=pattern)
        if ragged:  # whole lines are parsed for it
            reader = reader.options(columnNameOfCorruptRecord=ragged, columnPruning=False)
        keep = [n for n in names if wanted is None or n in wanted] + ([ragged] if ragged else [])
        some = reader.csv(files).select(F.col("_metadata.file_path").alias("file"), *[f"`{n}`" for n in keep])
        out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], "file string")
    return out.withColumns({n: F.lit(None).cast("string") for n in wanted or () if n not in out.columns})


def ragged_rows(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """file, rows, ragged and empty: how many rows each file under path has, how many with too few or too many fields, and how many without a value."""
    rows = read_tables(spark, path, pattern=pattern, ragged="_line")
    values = [F.col(f"`{c}`") for c in rows.columns if c not in ("file", "_line")]
    ragged = F.count("_line") if "_line" in rows.columns else F.count(F.lit(None))  # no files
    return rows.groupBy("file").agg(F.count("*").alias("rows"), ragged.alias("ragged"), F.count_if(F.coalesce(*values, F.lit(None)).isNull()).alias("empty"))


def collapsed(df: DataFrame, keys: list[str], values: list[str], what: str) -> DataFrame:
    """Rows with a value, one per key; keys with two values are an error."""
    rows = written(telemetry.repeats(df, keys, values), "collapsed")  # files are read once, however often the rows are
    if worst := rows.where("_clash").limit(3).collect():
        raise ValueError(f"{what}: repeated keys disagree, as {[tuple(r[k] for k in keys) for r in worst]}")
    return rows.select(*keys, *[F.col(f"`{c}`") for c in values])


def per_unit(df: DataFrame, channel: str, rated_kw: float | None) -> DataFrame:
    """Power over the machine's rating, where one is declared; else as published."""
    return df if rated_kw is None or channel not in df.columns else df.withColumn(channel, F.col(channel) / F.lit(float(rated_kw)))


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in columns})


def placed(df: DataFrame, source: str, site: str, channels: Sequence[str]) -> DataFrame:
    """Canonical readings from (turbine_id, timestamp_utc, channels), channels that are missing null."""
    there = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in channels]
    return df.select(F.lit(source).alias("source"), F.lit(site).alias("site"), "turbine_id", "timestamp_utc", *there)


def as_events(df: DataFrame, source: str, site: str, raw: Sequence[str], **columns: Column) -> DataFrame:
    """Canonical events; whether one is a fault is left open, as that is a labelling rule's matter."""
    given = {"source": F.lit(source), "site": F.lit(site), "is_fault": F.lit(None), "raw": cleaning.raw_payload(raw), **columns}
    rows = df.select(*[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in cleaning.EVENTS])
    return rows.where("start_utc is not null and turbine_id is not null")


@dataclass(frozen=True)
class CommentedExport:
    """Files with a commented preamble that names their turbine: readings with hundreds of columns, and status lists."""

    source: str
    site: str
    channels: Mapping[str, str]
    rated_kw: float | None = None
    power: str = "power_pu"
    readings_glob: str = "*Turbine_Data*.csv"
    status_glob: str = "*Status*.csv"

    def _turbine(self, heads: DataFrame) -> DataFrame:
        name = F.coalesce(preamble_value(F.col("comments"), "Turbine"), F.regexp_replace(base_name(F.col("file")), r"\.csv$", ""))
        return heads.select("file", name.alias("turbine_id"))

    def readings(self, spark: SparkSession, path: str) -> DataFrame:
        heads = file_heads(spark, path, self.readings_glob)
        columns = list(self.channels.values())
        table = numbers(read_tables(spark, path, ["Date and time", *columns], self.readings_glob, heads), columns)
        single = collapsed(table, ["file", "Date and time"], columns, self.source).withColumnsRenamed({v: k for k, v in self.channels.items()})
        named = single.join(self._turbine(heads), "file").withColumn("timestamp_utc", cleaning.local_to_utc(F.col("Date and time")))
        return per_unit(placed(named.where("timestamp_utc is not null"), self.source, self.site, list(self.channels)), self.power, self.rated_kw)

    def events(self, spark: SparkSession, path: str) -> DataFrame:
        heads = file_heads(spark, path, self.status_glob)
        table = read_tables(spark, path, pattern=self.status_glob, heads=heads)
        if absent := [c for c in ("Timestamp start", "Code", "Message") if c not in table.columns]:
            raise ValueError(f"{self.source}: status files lack {absent}")
        at = lambda c: cleaning.local_to_utc(F.col(f"`{c}`")) if c in table.columns else F.lit(None)
        category = F.col("`IEC category`") if "IEC category" in table.columns else F.col("Status")
        fields = [c for c in table.columns if c != "file"]
        rows = table.join(self._turbine(heads), "file")
        return as_events(
            rows, self.source, self.site, fields, turbine_id=F.col("turbine_id"), start_utc=at("Timestamp start"), end_utc=at("Timestamp end"),
            code=F.col("Code"), message=F.col("Message"), category=F.col("Status") if "Status" in table.columns else category,
        )


@dataclass(frozen=True)
class FarmDatasets:
    """Anonymous datasets in a folder per farm, one machine each, with channels and scales of the farm, and a table of labelled events."""

    source: str
    site: str
    farms: Mapping[str, Mapping] = field(default_factory=dict)  # farm -> directory, channels, scale
    rated_kw: float | None = None

    def _key(self, farm: str, machine: Column, dataset: Column) -> Column:
        return F.concat_ws(":", F.lit(farm), normalise_code(machine), normalise_code(dataset))

    def readings(self, spark: SparkSession, path: str) -> DataFrame:
        out = None
        names = sorted({c for f in self.farms.values() for c in f["channels"]})
        for farm, about in self.farms.items():
            columns = list(about["channels"].values())
            table = numbers(read_tables(spark, f"{path}/{about['directory']}/datasets", ["time_stamp", "asset_id", *columns]), columns)
            single = collapsed(table, ["file", "asset_id", "time_stamp"], columns, f"{self.source} {farm}").withColumnsRenamed({v: k for k, v in about["channels"].items()})
            if mixed := single.groupBy("file").agg(F.count_distinct("asset_id").alias("n")).where("n <> 1").limit(1).collect():
                raise ValueError(f"{mixed[0]['file']} has {mixed[0]['n']} machines, not one")
            single = single.withColumns({c: F.col(c) * F.lit(float(x)) for c, x in about.get("scale", {}).items() if c in single.columns})
            dataset = F.regexp_replace(base_name(F.col("file")), r"\.csv$", "")
            named = evaluated(single.withColumn("turbine_id", self._key(farm, F.col("asset_id"), dataset)), timestamp_utc=cleaning.local_to_utc(F.col("time_stamp")))
            some = placed(named.where("timestamp_utc is not null"), self.source, self.site, names)
            out = some if out is None else out.unionByName(some)
        return out

    def events(self, spark: SparkSession, path: str) -> DataFrame:
        out = None
        for farm, about in self.farms.items():
            table = read_tables(spark, f"{path}/{about['directory']}", pattern="event_info.csv")
            machine = next((c for c in ("asset", "asset_id") if c in table.columns), None)
            if machine is None or "event_label" not in table.columns:
                raise ValueError(f"{self.source} {farm}: the event table lacks its columns")
            label, said = strip(F.col("event_label")), F.nullif(strip(F.col("event_description")), F.lit(""))
            some = as_events(
                table, self.source, self.site, [c for c in table.columns if c != "file"], turbine_id=self._key(farm, F.col(machine), F.col("event_id")),
                start_utc=cleaning.local_to_utc(F.col("event_start")), end_utc=cleaning.local_to_utc(F.col("event_end")), code=label, message=said, category=label,
            )
            out = some if out is None else out.unionByName(some)
        return out


@dataclass(frozen=True)
class MonthlyTables:
    """A file per table and month, named table_YYYY_MM.csv, labelled by the end of each step and keyed by station.

    channels maps a canonical channel to 'table.field'.
    """

    source: str
    site: str
    channels: Mapping[str, str]
    stations: str = "stations.csv"
    alarms: str = "tblAlarmLog"
    daily: str = "tblDailySummary"
    rated_kw: float | None = None
    power: str = "power_pu"
    step: str = "INTERVAL 10 MINUTES"

    def _named(self, spark: SparkSession, path: str, df: DataFrame, station: str) -> DataFrame:
        """df with turbine_id; stations that the station table doesn't list are no turbines, and their rows go."""
        table = read_tables(spark, path, ["Turbine Name", "Station ID"], self.stations)
        table = table.select(normalise_code(F.col("Station ID")).alias("_s"), F.col("Turbine Name").alias("turbine_id")).dropDuplicates(["_s"])
        return df.join(F.broadcast(table), normalise_code(F.col(station)) == F.col("_s")).drop("_s")

    def _table(self, spark: SparkSession, path: str, table: str, columns: Sequence[str], years: Collection[int] | None = None) -> DataFrame:
        """month and columns of one table's files, of the given years by their names."""
        found = read_tables(spark, path, columns, f"{table}_*.csv")
        month = F.regexp_extract(base_name(F.col("file")), r"_(\d{4}_\d{2})\.csv$", 1)
        found = found.withColumn("month", month).where("month <> ''")
        return found if years is None else found.where(F.substring("month", 1, 4).cast("int").isin(*years))

    def _start(self, column: str) -> Column:
        return cleaning.local_to_utc(F.col(column)) - F.expr(self.step)

    def readings(self, spark: SparkSession, path: str) -> DataFrame:
        tables: dict[str, dict[str, str]] = {}
        for channel, place in self.channels.items():
            table, _, column = place.partition(".")
            tables.setdefault(table, {})[column] = channel
        keys, joined = ["month", "TimeStamp", "StationId"], None
        for table, columns in sorted(tables.items()):
            rows = numbers(self._table(spark, path, table, ["TimeStamp", "StationId", *columns]), list(columns))
            single = collapsed(rows, keys, list(columns), table).withColumnsRenamed(columns)
            joined = single if joined is None else joined.join(single, keys, "full")
        named = self._named(spark, path, joined, "StationId").withColumn("timestamp_utc", self._start("TimeStamp"))
        rows = placed(named.where("timestamp_utc is not null"), self.source, self.site, list(self.channels))
        # neighbouring months share their boundary's row
        return per_unit(telemetry.drop_identical(rows, ["turbine_id", "timestamp_utc"], list(self.channels))[0], self.power, self.rated_kw)

    def stop_classes(self, spark: SparkSession, path: str, years: Collection[int], table: str, fields: Sequence[str]) -> DataFrame:
        """turbine_id, timestamp_utc and the timers of the years; identical copies are dropped, others of a key are an error."""
        rows = numbers(self._table(spark, path, table, ["TimeStamp", "StationId", *fields], years), fields)
        rows = self._named(spark, path, rows, "StationId").withColumn("timestamp_utc", self._start("TimeStamp")).where("timestamp_utc is not null")
        kept, clash = telemetry.drop_identical(rows.select("turbine_id", "timestamp_utc", *fields), ["turbine_id", "timestamp_utc"], list(fields))
        if clash.limit(1).count():
            raise ValueError(f"{table}: a step has two sets of timers")
        return kept

    def daily_summary(self, spark: SparkSession, path: str, years: Collection[int], columns: Sequence[str]) -> DataFrame:
        """turbine_id, day and columns; of several rows of a day the first by file stays."""
        rows = numbers(self._table(spark, path, self.daily, ["TimeStamp", "StationId", *columns], years), columns)
        rows = self._named(spark, path, rows, "StationId").withColumn("day", F.date_trunc("day", cleaning.local_to_utc(F.col("TimeStamp")))).where("day is not null")
        return telemetry.first_duplicates(rows, ["turbine_id", "day"], ["month", *columns]).select("turbine_id", "day", *columns)

    def events(self, spark: SparkSession, path: str) -> DataFrame:
        columns = ["TimeOn", "TimeOff", "StationNr", "Alarmcode"]
        rows = self._named(spark, path, self._table(spark, path, self.alarms, columns), "StationNr")
        return as_events(
            rows, self.source, self.site, columns, turbine_id=F.col("turbine_id"), start_utc=cleaning.local_to_utc(F.col("TimeOn")),
            end_utc=cleaning.local_to_utc(F.col("TimeOff")), code=normalise_code(F.col("Alarmcode")),
        )


def downtime(spark: SparkSession, path: str, years: Collection[int] | None = None, pattern: str = "*.csv") -> DataFrame:
    """turbine_id, timestamp_utc, downtime_s of a downtime series; whole files are split by Spark, so nothing is read in one piece."""
    wanted = ["TimeStamp_StartFormat", "TurbineName", "ShutdownDuration"]
    rows = read_tables(spark, path, wanted, pattern)
    out = rows.select(
        F.col("TurbineName").alias("turbine_id"), cleaning.local_to_utc(F.col("TimeStamp_StartFormat")).alias("timestamp_utc"),
        F.col("ShutdownDuration").try_cast("double").alias("downtime_s"),
    ).where("timestamp_utc is not null")
    return out if years is None else out.where(F.year("timestamp_utc").isin(*years))


def ingest(readings: DataFrame, channels: Sequence[str], path: str) -> DataFrame:
    """Writes readings without identical copies, a directory per turbine and year, and returns what was written, counted."""
    kept, differing = telemetry.drop_identical(readings, ["source", "site", "turbine_id", "timestamp_utc"], list(channels))
    from .sinks import write_by

    write_by(kept.withColumn("year", F.year("timestamp_utc")), path, ["turbine_id", "year"])
    spark = readings.sparkSession
    counts = spark.read.parquet(path).groupBy("turbine_id", "year").agg(F.count("*").alias("rows_out"))
    before = readings.groupBy("turbine_id", F.year("timestamp_utc").alias("year")).agg(F.count("*").alias("rows_in"))
    clash = differing.groupBy("turbine_id", F.year("timestamp_utc").alias("year")).agg(F.count("*").alias("keys_differing"))
    return before.join(counts, ["turbine_id", "year"], "left").join(clash, ["turbine_id", "year"], "left").fillna(0)


ADAPTERS.update({"commented_export": CommentedExport, "farm_datasets": FarmDatasets, "monthly_tables": MonthlyTables})
