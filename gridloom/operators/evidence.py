"""Evidence for labels and channels: cross-checks of alarms, profiles of timers, years of a site, outages, matched comparisons, clocks and scales.

Tables are keyed by turbine and step (epoch seconds). What is decided from a
few aggregated numbers is a column, so a verdict is a row like its evidence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import poisson_interval, rate_ratio, wilson
from . import islands

STEPS_PER_YEAR = 52560.0
DAY = 86400


def share(flag: Column) -> Column:
    """Mean of a condition; unknown counts as false, no rows give null."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def wind_states(events: DataFrame, wind: DataFrame, speed: str, cut_in: float, cut_out: float, step: int = 600) -> DataFrame:
    """events(turbine, start) with state: where the speed of the step that an event starts in lies."""
    lookup = wind.groupBy("turbine", "step").agg(F.first(speed, ignorenulls=True).alias("_v"))
    rows = events.withColumn("step", F.col("start") - F.pmod(F.col("start"), F.lit(step))).join(lookup, ["turbine", "step"], "left")
    state = F.when(F.col("_v").isNull() | F.isnan("_v"), "unknown").when(F.col("_v") < cut_in, "below_cut_in").when(F.col("_v") > cut_out, "above_cut_out").otherwise("inside")
    return rows.withColumn("state", state).drop("_v", "step")


def stopping_check(alarms: DataFrame, down: DataFrame, stopping: Mapping[str, bool], window: int, step: int = 600) -> DataFrame:
    """code, stopping, occurrences, showing, agreeing, agreement of alarms(turbine, code, start, end) against down(turbine, step).

    An alarm shows downtime if a down step lies from the step that it starts in
    to window steps after that in which it ends; no end is the start. Steps are
    counted up to each place, so no pair of alarm and step is formed.
    """
    floor = lambda c: c - F.pmod(c, F.lit(step))
    rows = alarms.where(F.col("code").isin(*stopping)).withColumn("_id", F.monotonically_increasing_id())
    begin, end = floor(F.col("start")), floor(F.coalesce("end", "start")) + window * step
    probes = rows.select("turbine", "code", "_id", F.explode(F.array(F.struct((begin - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(end.alias("at"), F.lit(1).alias("sign")))).alias("p"))
    probes = probes.select("turbine", "code", "_id", F.col("p.at").alias("at"), F.col("p.sign").alias("sign"), F.lit(0).alias("n"))
    marks = down.select("turbine", "step").distinct().select("turbine", F.col("step").alias("at"), F.lit(1).alias("n"))
    upto = F.sum("n").over(W.partitionBy("turbine").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    seen = probes.unionByName(marks, allowMissingColumns=True).withColumn("_c", upto).where("_id is not null")
    shown = seen.groupBy("_id", "code").agg((F.sum(F.col("sign") * F.col("_c")) > 0).alias("shows"))
    told = F.element_at(F.create_map(*[x for k, v in stopping.items() for x in (F.lit(k), F.lit(v))]), F.col("code"))
    out = shown.withColumn("stopping", told).groupBy("code", "stopping").agg(
        F.count("*").alias("occurrences"), F.count_if("shows").alias("showing"), F.count_if(F.col("shows") == F.col("stopping")).alias("agreeing")
    )
    return out.withColumn("agreement", F.col("agreeing") / F.col("occurrences"))


def timer_profiles(state: DataFrame, causes: Mapping[str, str], turbines: int, rotating: float, producing: float, step: int = 600) -> DataFrame:
    """A row per timer of state(turbine, step, timers, telemetry_present, power_pu, rotor_speed_rpm): how long, when and where it runs.

    timer, cause, steps, seconds, median_run_s, p90_run_s, telemetry_missing,
    rotating, producing, turbines_at_once (median over active steps), farm_wide.
    """
    long = state.select(
        "turbine", "step", "telemetry_present", "power_pu", "rotor_speed_rpm",
        F.explode(F.array(*[F.struct(F.lit(t).alias("timer"), F.coalesce(F.col(t), F.lit(0)).cast("double").alias("v")) for t in causes])).alias("x"),
    ).select("*", "x.timer", "x.v").drop("x").where("v > 0")
    half = -(-turbines // 2)
    at_once = F.count("*").over(W.partitionBy("timer", "step"))
    active = long.withColumn("_at", at_once).groupBy("timer").agg(
        F.count("*").alias("steps"), F.sum("v").alias("seconds"), share(~F.col("telemetry_present")).alias("telemetry_missing"),
        share(F.col("rotor_speed_rpm") > rotating).alias("rotating"), share(F.col("power_pu") > producing).alias("producing"),
        F.percentile("_at", F.lit(0.5)).alias("turbines_at_once"), share(F.col("_at") >= half).alias("farm_wide"),
    )
    runs = islands.runs(long, ["timer", "turbine"], "step", step).groupBy("timer", "turbine", "run").agg(F.sum("v").alias("s"))
    lengths = runs.groupBy("timer").agg(F.percentile("s", F.lit(0.5)).alias("median_run_s"), F.percentile("s", F.lit(0.9)).alias("p90_run_s"))
    cause = F.element_at(F.create_map(*[x for k, v in causes.items() for x in (F.lit(k), F.lit(v))]), F.col("timer"))
    return active.join(lengths, "timer").withColumn("cause", cause)


def coverage_steps(df: DataFrame) -> DataFrame:
    """Distinct (turbine, step)."""
    return df.select("turbine", "step").distinct()


def counts_by_period(period: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """period and the rows of each table in it, 0 where it has none."""
    parts = [t.groupBy(period).agg(F.count("*").alias("n")).select(period, F.lit(name).alias("_t"), "n") for name, t in tables.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(period).pivot("_t", list(tables)).agg(F.sum("n")).fillna(0)


def site_years(steps: DataFrame, narrow: DataFrame, broad: DataFrame, period: str, split: Mapping[int, str], least: int = 144) -> DataFrame:
    """A row per period with at least so many grid steps: split, steps, narrow, broad, busiest, busiest_narrow, leading, leading_message.

    steps, narrow and broad have period; narrow has turbine and opening (null:
    none found). The leading message is that whose rate rose most from the
    periods of split train to those of test.
    """
    name = F.element_at(F.create_map(*[x for k, v in split.items() for x in (F.lit(k), F.lit(v))]), F.col(period))
    rows = counts_by_period(period, {"steps": steps, "narrow": narrow, "broad": broad}).where(F.col("steps") >= least).withColumn("split", name)
    per = narrow.groupBy(period, "turbine").agg(F.count("*").alias("n"))
    busiest = per.groupBy(period).agg(F.max_by("turbine", F.struct("n", (-F.col("turbine")).alias("t"))).alias("busiest"), F.max("n").alias("busiest_narrow"))
    opened = narrow.groupBy(period, F.coalesce("opening", F.lit("(none found)")).alias("message")).agg(F.count("*").alias("n")).join(rows.select(period, "split"), period)
    total = lambda s: F.sum(F.when(F.col("split") == s, F.col("steps")))
    exposure = rows.agg(total("train").alias("_train"), total("test").alias("_test"))
    rise = opened.groupBy("message").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in ("train", "test")]).crossJoin(F.broadcast(exposure))
    rise = rise.select("message", (F.col("test") / F.col("_test") - F.col("train") / F.col("_train")).alias("rise")).where("rise is not null")
    lead = rise.agg(F.max(F.struct("rise", "message")).alias("x")).select(F.col("x.message").alias("leading_message"))
    out = rows.join(busiest, period, "left").crossJoin(F.broadcast(lead))
    led = opened.select(period, F.col("message").alias("leading_message"), F.col("n").alias("leading"))
    return out.join(led, [period, "leading_message"], "left").fillna(0, ["leading", "busiest_narrow"])


def pooled(years: DataFrame) -> DataFrame:
    """split, narrow, steps over the periods of each split."""
    return years.groupBy("split").agg(F.sum("narrow").alias("narrow"), F.sum("steps").alias("steps"))


def onset_year(years: DataFrame, period: str, per_year: float = STEPS_PER_YEAR) -> DataFrame:
    """onset: the first later period whose Poisson lower bound exceeds the training rate; routine: the first whose leading message opens more than one event a turbine-year."""
    train = years.where("split = 'train'").agg((F.sum("narrow") / (F.sum("steps") / per_year)).alias("_rate"))
    low, _ = poisson_interval(F.col("narrow"))
    age = F.col("steps") / per_year
    late = F.col("split").isin("val", "test") & (low / age > F.col("_rate"))
    return years.crossJoin(F.broadcast(train)).agg(F.min(F.when(late, F.col(period))).alias("onset"), F.min(F.when(F.col("leading") / age > 1, F.col(period))).alias("routine"))


def turbine_days(steps: DataFrame, channels: Sequence[str], reporting: str, events: DataFrame, kept: Column | None = None) -> DataFrame:
    """turbine, day, steps, kept, reporting, events, and per channel nonnull, nonnull_kept, missing, missing_kept (while reporting)."""
    kept = F.lit(True) if kept is None else kept
    rows = steps.withColumn("day", F.expr(f"step div {DAY}")).withColumn("_k", kept)
    here, k = F.col(reporting).isNotNull(), F.col("_k")
    aggs = [F.count("*").alias("steps"), F.count_if(k).alias("kept"), F.count_if(here).alias("reporting"), F.count_if(here & k).alias("reporting_kept")]
    for c in channels:
        there = F.col(c).isNotNull()
        aggs += [F.count_if(there).alias(f"nonnull_{c}"), F.count_if(there & k).alias(f"nonnull_kept_{c}")]
        aggs += [F.count_if(here & ~there).alias(f"missing_{c}"), F.count_if(here & k & ~there).alias(f"missing_kept_{c}")]
    n = events.select("turbine", F.expr(f"start div {DAY}").alias("day")).groupBy("turbine", "day").agg(F.count("*").alias("events"))
    return rows.groupBy("turbine", "day").agg(*aggs).join(n, ["turbine", "day"], "left").fillna(0, ["events"])


def channel_shares(days: DataFrame, channels: Sequence[str], by: Sequence[str] = (), kept: bool = False, least: int = 0) -> DataFrame:
    """by and the non-null share of each channel over all steps, of groups with at least so many steps."""
    steps, prefix = ("kept", "nonnull_kept") if kept else ("steps", "nonnull")
    out = days.groupBy(*by).agg(F.sum(steps).alias("_n"), *[F.sum(f"{prefix}_{c}").alias(c) for c in channels])
    return out.where(F.col("_n") >= least).select(*by, *[F.try_divide(c, "_n").alias(c) for c in channels])


def matched_ratio(days: DataFrame, channel: str, gap: float = 0.1, kept: bool = False, per_year: float = STEPS_PER_YEAR) -> DataFrame:
    """Event rate of turbine-days with gaps in channel over that of others, crude and matched on calendar month.

    affected_days, crude, crude_low, crude_high, matched, matched_low,
    matched_high, months (with both kinds), reading.
    """
    suffix = "_kept" if kept else ""
    missing, here = F.col(f"missing{suffix}_{channel}"), F.col(f"reporting{suffix}")
    rows = days.withColumn("_a", (here > 0) & (missing > gap * here)).withColumn("month", F.month(F.date_from_unix_date(F.col("day").cast("int"))))
    side = lambda c, flag: F.sum(F.when(flag, c).otherwise(0)).cast("double")
    exposure = F.col("kept" if kept else "steps") / per_year
    a, b = F.col("_a"), ~F.col("_a")
    strata = rows.groupBy("month").agg(
        side(F.col("events"), a).alias("a"), side(exposure, a).alias("at"), side(F.col("events"), b).alias("b"), side(exposure, b).alias("bt"), F.count_if(a).alias("d")
    )
    both = (F.col("at") > 0) & (F.col("bt") > 0)
    t = F.col("at") + F.col("bt")
    only = lambda c: F.sum(F.when(both, c))
    sums = strata.agg(
        F.sum("d").alias("affected_days"), *[F.sum(c).alias(c) for c in ("a", "at", "b", "bt")], F.count_if(both).alias("months"),
        only(F.col("a") * F.col("bt") / t).alias("_r"), only(F.col("b") * F.col("at") / t).alias("_s"),
        only((F.col("a") + F.col("b")) * F.col("at") * F.col("bt") / t / t).alias("_v"),
    )
    crude = rate_ratio(F.col("a"), F.col("at"), F.col("b"), F.col("bt"))
    fine = (F.col("_r") > 0) & (F.col("_s") > 0)
    half = 1.959963984540054 * F.sqrt(F.col("_v") / (F.col("_r") * F.col("_s")))
    ratio = F.when(fine, F.col("_r") / F.col("_s"))
    out = sums.select(
        "affected_days", *[c.alias(n) for c, n in zip(crude, ("crude", "crude_low", "crude_high"), strict=True)], ratio.alias("matched"),
        (ratio * F.exp(-half)).alias("matched_low"), (ratio * F.exp(half)).alias("matched_high"), "months",
    )
    return out.withColumn("reading", read_ratio(F.col("matched"), F.col("matched_low"), F.col("matched_high")))


def read_ratio(ratio: Column, low: Column, high: Column, band: tuple[float, float] = (0.8, 1.25)) -> Column:
    """clears if the interval holds one and lies in the band, 'does not clear' if it doesn't hold one, else inconclusive; 'no events' without a ratio."""
    return (
        F.when(ratio.isNull() | F.isnan(ratio), "no events")
        .when((low > 1) | (high < 1), "does not clear")
        .when((low >= band[0]) & (high <= band[1]), "clears")
        .otherwise("inconclusive")
    )


def channel_verdicts(evidence: DataFrame, core: float = 0.9) -> DataFrame:
    """A row per channel of evidence(channel, role, source, year, share, kept_share, reading, mappable): tier and the first condition that fails.

    role is held_out (one row per year, and one with a null year) or training.
    (a) all held-out shares, of all years, are at least core. (b) the best
    training share outside exclusions is, and none is 0. (c) every training site
    below it clears its control.
    """
    held, train = F.col("role") == "held_out", F.col("role") == "training"
    told = evidence.groupBy("channel").agg(
        F.bool_and("mappable").alias("maps"), F.coalesce(F.bool_and(F.when(held, F.col("share") >= core)), F.lit(True)).alias("a"),
        F.coalesce((F.max(F.when(train, F.col("kept_share"))) >= core) & (F.min(F.when(train, F.col("kept_share"))) > 0), F.lit(False)).alias("b"),
        F.coalesce(F.bool_and(F.when(train & (F.col("kept_share") > 0) & (F.col("kept_share") < core), F.col("reading") == "clears")), F.lit(True)).alias("c"),
    )
    reason = F.when(~F.col("maps"), "maps").when(~F.col("a"), "(a)").when(~F.col("b"), "(b)").when(~F.col("c"), "(c)").otherwise("all hold")
    return told.withColumn("reason", reason).withColumn("tier", F.when(reason == "all hold", "core").otherwise("extended"))


def outage_tally(steps: DataFrame, reporting: str, channels: Sequence[str], start: int, end: int, edge_days: int = 7) -> DataFrame:
    """turbine, inside, reporting, out, before_reporting, before_present, after_reporting, after_present around an outage span.

    out counts reporting steps in the span that miss all of channels; edges are
    the days before and after it, present those with all of channels.
    """
    t, here = F.col("step"), F.col(reporting).isNotNull()
    none, every = F.lit(True), F.lit(True)
    for c in channels:
        none, every = none & F.col(c).isNull(), every & F.col(c).isNotNull()
    inside, week = t.between(start, end), edge_days * DAY
    before, after = (t >= start - week) & (t < start), (t > end) & (t <= end + week)
    return steps.groupBy("turbine").agg(
        F.count_if(inside).alias("inside"), F.count_if(inside & here).alias("reporting"), F.count_if(inside & here & none).alias("out"),
        F.count_if(before & here).alias("before_reporting"), F.count_if(before & here & every).alias("before_present"),
        F.count_if(after & here).alias("after_reporting"), F.count_if(after & here & every).alias("after_present"),
    )


def outage_holds(tally: DataFrame, n_channels: int, out_share: float = 0.99, edge_share: float = 0.5) -> DataFrame:
    """several, site_wide, simultaneous and bounded: what makes an outage one of the site, of one row per turbine with any grid."""
    edge = lambda side: F.coalesce(F.try_divide(F.sum(f"{side}_present"), F.sum(f"{side}_reporting")) > edge_share, F.lit(False))
    return tally.agg(
        F.lit(n_channels >= 2).alias("several"), (F.count_if(F.col("reporting") > 0) == F.count("*")).alias("site_wide"),
        F.coalesce(F.min(F.when(F.col("reporting") > 0, F.col("out") / F.col("reporting"))) >= out_share, F.lit(False)).alias("simultaneous"),
        (edge("before") & edge("after")).alias("bounded"),
    )


def gap_rows(steps: DataFrame, reporting: str, watched: Sequence[str], label: str, by: Sequence[str]) -> DataFrame:
    """by, steps, reporting, missing share of each watched channel while reporting, and known and positive labels on steps with and without a gap."""
    here = F.col(reporting).isNotNull()
    gap = F.lit(False)
    for c in watched:
        gap = gap | F.col(c).isNull()
    known, positive = F.col(label).isNotNull() & here, F.coalesce(F.col(label), F.lit(False)) & here
    return steps.groupBy(*by).agg(
        F.count("*").alias("steps"), F.count_if(here).alias("reporting"),
        *[F.coalesce(F.try_divide(F.count_if(here & F.col(c).isNull()), F.count_if(here)), F.lit(0.0)).alias(f"missing_{c}") for c in watched],
        F.count_if(known & gap).alias("known_missing"), F.count_if(positive & gap).alias("positive_missing"),
        F.count_if(known & ~gap).alias("known_present"), F.count_if(positive & ~gap).alias("positive_present"),
    )


def offset_changes(spark, zone: str, first_year: int, last_year: int) -> DataFrame:
    """year, spring, autumn: instants (epoch seconds) of the years' two changes of a zone's offset, of years that have two."""
    hours = spark.range(first_year, last_year + 1).select(F.col("id").alias("year"), F.explode(F.sequence(F.lit(0), F.lit(366 * 24))).alias("h"))
    start = F.unix_timestamp(F.concat(F.col("year").cast("string"), F.lit("-01-01 00:00:00")))
    at = hours.select("year", (start + F.col("h") * 3600).alias("t"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds("t").cast("timestamp_ntz"))
    offset = F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(F.timestamp_seconds("t").cast("timestamp_ntz").cast("timestamp"))
    rows = at.withColumn("o", offset).withColumn("before", F.lag("o").over(W.partitionBy("year").orderBy("t")))
    rows = rows.where((F.col("before") != F.col("o")) & (F.year(F.timestamp_seconds("t")) == F.col("year")))
    both = rows.groupBy("year").agg(F.array_sort(F.collect_list("t")).alias("ts")).where(F.size("ts") == 2)
    return both.select("year", F.col("ts")[0].alias("spring"), F.col("ts")[1].alias("autumn"))


def affected_labels(instant: Column, zone: str) -> Column:
    """struct(start, width): the local labels (epoch seconds of the label) that a change of offset skips or repeats."""
    local = lambda t: F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds(t).cast("timestamp_ntz")).cast("timestamp"))
    after, shift = local(instant), local(instant) - local(instant - 60) - 60
    return F.struct(F.when(shift > 0, after - shift).otherwise(after).alias("start"), F.abs(shift).alias("width"))


def clock_verdict(fingerprints: DataFrame, zone: str) -> DataFrame:
    """verdict over rows (in_missing_hour, repeated; null where a year can't be tested): UTC, the zone, or unresolved."""
    spring, autumn = F.count("in_missing_hour"), F.count("repeated")
    gaps, repeats = F.count_if(F.col("in_missing_hour") == 0), F.count_if(F.col("repeated") > 0)
    told = fingerprints.agg(spring.alias("spring"), gaps.alias("gaps"), autumn.alias("autumn"), repeats.alias("repeats"))
    tested = (F.col("spring") + F.col("autumn")) > 0
    local = (F.col("spring") > 0) & (F.col("gaps") == F.col("spring")) & (F.col("autumn") > 0) & (F.col("repeats") == F.col("autumn"))
    return told.withColumn("verdict", F.when(tested & (F.col("gaps") == 0) & (F.col("repeats") == 0), "UTC").when(local, zone).otherwise("unresolved"))


def power_scale(df: DataFrame, by: Sequence[str], value: str, rated_kw: float, step_hours: float, tail: float = 0.99, tolerance: float = 1.5) -> DataFrame:
    """tail (median over groups of their tail quantiles) and verdict: kW, kWh per step or unresolved, by which rating it sits on."""
    tails = df.groupBy(*by).agg(F.percentile(value, F.lit(tail)).alias("t"))
    near = lambda rating: (F.col("tail") >= rating / tolerance) & (F.col("tail") <= rating * tolerance)
    kw, kwh = near(rated_kw), near(rated_kw * step_hours)
    verdict = F.when(kw & ~kwh, "kW").when(kwh & ~kw, "kWh per step").otherwise("unresolved")
    return tails.agg(F.percentile("t", F.lit(0.5)).alias("tail")).withColumn("verdict", F.coalesce(verdict, F.lit("unresolved")))


def dataset_intervals(counts: DataFrame, without: str) -> DataFrame:
    """label, farms ('all' or 'without'), datasets, low, high of counts(farm, label, n): the interval that a rate near one half has at that count."""
    kinds = F.array(F.lit("all"), F.when(F.col("farm") != without, "without"))
    rows = counts.select("label", "n", F.explode(F.array_compact(kinds)).alias("farms")).groupBy("label", "farms").agg(F.sum("n").alias("datasets"))
    low, high = wilson(F.round(F.col("datasets") / 2), F.col("datasets"))
    return rows.withColumn("low", low).withColumn("high", high)


def header_presence(headers: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """channel, year, files, with: files of headers(year, columns), and those that carry the channel's column."""
    table = F.array(*[F.struct(F.lit(k).alias("channel"), F.lit(v).alias("column")) for k, v in mapping.items()])
    rows = headers.select("year", "columns", F.explode(table).alias("x"))
    return rows.groupBy("x.channel", "year").agg(F.count("*").alias("files"), F.count_if(F.array_contains("columns", F.col("x.column"))).alias("with"))


def derive_core(maps: DataFrame, training: Sequence[str], held_out: Sequence[str]) -> DataFrame:
    """channel, core of maps(source, channel): whether all training and held-out sources have it."""
    need = [*training, *held_out]
    rows = maps.where(F.col("source").isin(*need)).groupBy("channel").agg(F.count_distinct("source").alias("n"))
    return rows.select("channel", (F.col("n") == len(set(need))).alias("core"))


def pick_column(columns: Sequence[str], hints: Sequence[str]) -> str | None:
    """The first column that holds a hint, hints in their order."""
    return next((c for h in hints for c in columns if h in c.lower()), None)


def text_measures(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """by, rows, distinct, mean_chars, mean_words, once_share (of distinct texts that occur once) of non-empty texts."""
    text = F.trim(F.col(column))
    counts = df.where(text != "").groupBy(*by, text.alias("_t")).agg(F.count("*").alias("n"))
    weigh = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    return counts.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct"), weigh(F.char_length("_t")).alias("mean_chars"),
        weigh(F.regexp_count("_t", F.lit(r"\S+"))).alias("mean_words"), share(F.col("n") == 1).alias("once_share"),
    )


def free_text_verdict(measures: DataFrame, once: float = 0.5, words: float = 4.0) -> DataFrame:
    """measures with verdict: written if texts are mostly their own and of some words, coded if few repeat, none without rows."""
    verdict = F.when(F.col("rows") == 0, "none").when((F.col("once_share") >= once) & (F.col("mean_words") >= words), "written").otherwise("coded")
    return measures.withColumn("verdict", verdict)
