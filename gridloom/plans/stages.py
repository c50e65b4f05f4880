"""Stages: named transforms whose tables and counts are recorded, chosen and run in order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import islands as I
from ..operators import pages as P
from ..operators import splits as L
from ..operators import telemetry as M
from ..operators import text as X
from ..operators.tables import new_folder
from .registry import HOUR, READ, query, readings
from .text_queries import CLEAN, FRACTIONS, HASH, MASK, REASON, SPLIT, documents


@dataclass(frozen=True)
class Stage:
    """A transform with a name; counters are aggregates over its output, recorded with its row counts."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    counters: dict = field(default_factory=dict)


def canonical_json(payload) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)


def config_hash(payload, length: int = 8) -> str:
    """The first hex digits of the SHA-256 of canonical JSON."""
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()[:length]


def build(stages: Sequence[Stage], selection: str = "all") -> list[Stage]:
    """All stages, or the one of that name; an unknown name is an error."""
    if selection == "all":
        return list(stages)
    if found := [s for s in stages if s.name == selection]:
        return found
    raise ValueError(f"no stage {selection!r} among {[s.name for s in stages]}")


def run(spark: SparkSession, df: DataFrame, stages: Sequence[Stage], folder: str) -> tuple[DataFrame, list[dict]]:
    """The last stage's table, and per stage its name, rows in and out and counters.

    Each stage's table is written under folder and read back, so a later run may
    start at any of them, and counts are taken while it is written.
    """
    from pyspark.sql import Observation

    record, rows_in = [], df.count()
    for stage in stages:
        seen = Observation()
        out = stage.run(df)
        measured = out.observe(seen, F.count("*").alias("rows_out"), *[c.alias(n) for n, c in stage.counters.items()])
        path = f"{folder}/{stage.name}"
        measured.write.mode("overwrite").parquet(path)
        told = seen.get
        record.append({"stage": stage.name, "rows_in": rows_in, **told})
        df, rows_in = spark.read.parquet(path), told["rows_out"]
    return df, record


def counts_frame(spark: SparkSession, record: Sequence[dict]) -> DataFrame:
    """stage, rows_in, rows_out, dropped of a record."""
    rows = [(r["stage"], r["rows_in"], r["rows_out"], r["rows_in"] - r["rows_out"]) for r in record]
    return spark.createDataFrame(rows, "stage string, rows_in long, rows_out long, dropped long")


def reasons_table(df: DataFrame, reason: str) -> DataFrame:
    """reason, n, share of input, of rows with a reason."""
    counts = df.groupBy(reason).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.where(F.col(reason).isNotNull()).crossJoin(F.broadcast(total)).select(reason, "n", (F.col("n") / F.col("_t")).alias("share"))


def text_stages(least: int = 200, most: int = 20000, letters: float = 0.7, repeats: float = 0.3, seed: str = "13") -> list[Stage]:
    """Clean, filter, deduplicate, mask, split documents (doc_id, source, text)."""
    def clean(df: DataFrame) -> DataFrame:
        made = X.evaluated(df.withColumnRenamed("text", "_raw"), text=X.clean(F.col("_raw"), form=None, entities=False)).drop("_raw")
        return made.where("text <> ''")

    def keep(df: DataFrame) -> DataFrame:
        return df.where(X.filter_reason(F.col("text"), least, most, letters, repeats).isNull())

    def dedup(df: DataFrame) -> DataFrame:
        return P.latest_revisions(X.exact_dedup(df, ["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("string")), "src0", "doc_id")

    return [
        Stage("clean", clean, {"chars": F.sum(F.char_length("text"))}), Stage("filter", keep), Stage("dedup", dedup),
        Stage("pii", X.mask_pii, {"emails": F.sum("n_email"), "phones": F.sum("n_phone")}),
        Stage("final", lambda df: X.assign_split(df, seed, FRACTIONS)),
    ]


def telemetry_stages(train_until: int, val_until: int, step: int = HOUR) -> list[Stage]:
    """Clean, filter and finish readings (turbine, year, step, power)."""
    keys = ["turbine", "year"]

    def clean(df: DataFrame) -> DataFrame:
        x = M.apply_bounds(M.drop_sentinels(df, {"power": [100.0]}), {"power": (5.0, 480.0)})
        return I.regular_grid(M.apply_floors(x, {"power": 10.0}), keys, "step", step)

    def keep(df: DataFrame) -> DataFrame:
        return M.drop_short_segments(I.segments(df, keys, "step", F.col("power").isNotNull(), 6 * step), keys, 3)

    def final(df: DataFrame) -> DataFrame:
        x = I.impute(df, keys, "step", "power", 3)
        return L.cut_segments(x.withColumn("split", L.time_split(F.col("step"), train_until, val_until)), keys)

    return [Stage("clean", clean, {"present": F.count("power")}), Stage("filter", keep), Stage("final", final, {"imputed": F.count_if("power__imputed")})]


def _folder(T, name: str) -> tuple[SparkSession, str]:
    spark = T("region").sparkSession
    return spark, new_folder(spark, f"stages-{name}")


TEXT = f"""c AS (SELECT doc_id, source, text FROM (SELECT doc_id, source, {CLEAN} AS text FROM documents) WHERE text <> ''), k AS (SELECT * FROM c WHERE ({REASON}) IS NULL), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id) = 1)"""


@query("text_stage_counts", f"""WITH {TEXT} SELECT 'clean' AS stage, (SELECT count(*) FROM documents) AS rows_in, (SELECT count(*) FROM c) AS rows_out, (SELECT count(*) FROM documents) - (SELECT count(*) FROM c) AS dropped
UNION ALL SELECT 'filter', (SELECT count(*) FROM c), (SELECT count(*) FROM k), (SELECT count(*) FROM c) - (SELECT count(*) FROM k) UNION ALL SELECT 'dedup', (SELECT count(*) FROM k), (SELECT count(*) FROM u), (SELECT count(*) FROM k) - (SELECT count(*) FROM u)
UNION ALL SELECT 'pii', (SELECT count(*) FROM u), (SELECT count(*) FROM u), 0 UNION ALL SELECT 'final', (SELECT count(*) FROM u), (SELECT count(*) FROM u), 0""")
def text_stage_counts(T):
    """The document stages, each written and read again; rows in and out."""
    spark, folder = _folder(T, "text")
    return counts_frame(spark, run(spark, documents(T).select("doc_id", "source", "text"), text_stages(), folder)[1])


@query("text_stage_result", f"WITH {TEXT} SELECT doc_id::VARCHAR AS doc_id, source, md5(text) AS digest, {SPLIT} AS split FROM (SELECT doc_id, source, {MASK} AS text FROM u)")
def text_stage_result(T):
    spark, folder = _folder(T, "text")
    out = run(spark, documents(T).select("doc_id", "source", "text"), text_stages(), folder)[0]
    return out.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"), "split")


@query("drop_reasons", f"WITH c AS (SELECT {CLEAN} AS text FROM documents), r AS (SELECT {REASON} AS reason FROM c) SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 9) AS share FROM r WHERE reason IS NOT NULL GROUP BY 1")
def drop_reasons(T):
    made = X.evaluated(documents(T).select("doc_id", F.col("text").alias("raw")), text=X.clean(F.col("raw"), form=None, entities=False))
    return reasons_table(made.select(X.filter_reason(F.col("text"), 200, 20000, 0.7, 0.3).alias("reason")), "reason").withColumn("share", F.round("share", 9))


TRAIN, VAL = 1705708800, 1706140800


@query("telemetry_stage_counts", f"""WITH {READ}, c AS (SELECT turbine, year, step, CASE WHEN v BETWEEN 5 AND 480 THEN CASE WHEN v < 10 THEN 10.0 ELSE v END END AS power FROM (SELECT *, CASE WHEN NOT abs(power - 100.0) <= 1e-4 THEN power END AS v FROM g)),
a AS (SELECT turbine, year, min(step) AS lo, max(step) AS hi FROM c GROUP BY 1, 2), grid AS (SELECT a.turbine, a.year, x.step, c.power FROM a, LATERAL (SELECT unnest(generate_series(lo, hi, 3600)) AS step) x LEFT JOIN c ON c.turbine = a.turbine AND c.year = a.year AND c.step = x.step),
m AS (SELECT *, CASE WHEN power IS NOT NULL THEN sum(CASE WHEN power IS NOT NULL AND (pp IS NULL OR step - pp > 21600) THEN 1 ELSE 0 END) OVER (PARTITION BY turbine, year ORDER BY step) - 1 END AS id FROM
 (SELECT *, last_value(CASE WHEN power IS NOT NULL THEN step END IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp FROM grid)),
k AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step) AS bk, first_value(id IGNORE NULLS) OVER (PARTITION BY turbine, year ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fw FROM m),
f AS (SELECT * FROM k WHERE bk = fw QUALIFY count(*) OVER (PARTITION BY turbine, year, bk) >= 3)
SELECT 'clean' AS stage, (SELECT count(*) FROM g) AS rows_in, (SELECT count(*) FROM grid) AS rows_out, (SELECT count(*) FROM g) - (SELECT count(*) FROM grid) AS dropped UNION ALL SELECT 'filter', (SELECT count(*) FROM grid), (SELECT count(*) FROM f), (SELECT count(*) FROM grid) - (SELECT count(*) FROM f) UNION ALL SELECT 'final', (SELECT count(*) FROM f), (SELECT count(*) FROM f), 0""")
def telemetry_stage_counts(T):
    """The stages of readings, each written and read again; rows in and out."""
    spark, folder = _folder(T, "telemetry")
    return counts_frame(spark, run(spark, readings(T).select("turbine", "year", "step", "power"), telemetry_stages(TRAIN, VAL), folder)[1])
