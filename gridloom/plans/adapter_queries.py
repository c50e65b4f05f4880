"""Queries that write a table as an export's files and read it through an adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tables import new_folder
from ..sources import adapters
from ..sources.sinks import write_lines
from .registry import READ, query, readings


@query("farm_export", f"""WITH {READ} SELECT turbine::VARCHAR AS machine, step, power / 4 AS power_pu, NULL::DOUBLE AS wind_speed_ms FROM g""")
def farm_export(T):
    """Readings written as one CSV file a machine, in a farm's own scale, and read back as canonical readings."""
    g = readings(T)
    folder = new_folder(g.sparkSession, "farm")
    stamp = F.date_format(F.timestamp_seconds("step"), "yyyy-MM-dd HH:mm:ss")
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("turbine"), stamp, F.col("power"))]
    rows = g.select(F.concat(F.lit("machine-"), F.coalesce(F.col("turbine").cast("string"), F.lit("none")), F.lit(".csv")).alias("name"), F.concat_ws(",", *cells).alias("line"))
    write_lines(rows, f"{folder}/Farm/datasets", "asset_id,time_stamp,sensor_50\n")
    farms = {"A": {"directory": "Farm", "channels": {"power_pu": "sensor_50"}, "scale": {"power_pu": 0.25}}}
    read = adapters.FarmDatasets("export", "site", farms).readings(g.sparkSession, folder)
    machine = F.split("turbine_id", ":")[1]
    return read.select(machine.alias("machine"), F.unix_timestamp("timestamp_utc").alias("step"), "power_pu", F.lit(None).cast("double").alias("wind_speed_ms"))
