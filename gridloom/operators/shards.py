"""Token shards: numbered steps, running offsets, window indexes, gathering windows, batches of mixed streams.

A shard's order is made from sums over leaves (ranges of its order), so no
shard is sorted in one task. Tokens lie in rows of one step, or in chunks of a
fixed number of tokens, and windows meet them by equality of chunk numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .samplers import mixture_schedule

LEAF = 1 << 16
CHUNK = 4096


def running_offsets(df: DataFrame, keys: Sequence[str], order: str, size: Column, name: str = "offset", leaf: int = LEAF) -> DataFrame:
    """df with name: the sum of size over the rows of its key that come before by order, a whole number (ties in the order of size)."""
    span = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count("*").alias("_n"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.greatest(F.lit(1), F.ceil(F.col("_n") / leaf)))).cast("long")
    rows = df.withColumn("_size", size.cast("long")).join(span.select(*keys, "_lo", width.alias("_w")), list(keys))
    rows = rows.withColumn("_leaf", F.expr(f"({order} - _lo) div _w")).drop("_lo", "_w")
    before = W.partitionBy(*keys).orderBy("_leaf").rowsBetween(W.unboundedPreceding, -1)
    leaves = rows.groupBy(*keys, "_leaf").agg(F.sum("_size").alias("_s"))
    leaves = leaves.select(*keys, "_leaf", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_leaf").orderBy(order, "_size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(leaves, [*keys, "_leaf"])
    return rows.withColumn(name, F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).drop("_size", "_leaf", "_base")


def number_steps(df: DataFrame, shard: Sequence[str], run: Sequence[str], order: str, name: str = "step_no") -> DataFrame:
    """df with name: the place of each row in its shard, whose runs (a turbine's year) follow each other in the order of run."""
    counts = df.groupBy(*shard, *run).agg(F.count("*").alias("_c"))
    before = W.partitionBy(*shard).orderBy(*run).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*shard, *run, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy(*shard, *run).orderBy(order)) - 1
    return df.join(counts, [*shard, *run]).withColumn(name, F.col("_base") + inside).drop("_base")


def split_runs(df: DataFrame, run: Sequence[str], split: str, order: str) -> DataFrame:
    """run, split of splits whose rows aren't one contiguous piece of a run; a shard may not hold such."""
    w = W.partitionBy(*run).orderBy(order)
    fresh = F.when(~F.col(split).eqNullSafe(F.lag(split).over(w)), 1).otherwise(0)
    return df.withColumn("_f", fresh).groupBy(*run, split).agg(F.sum("_f").alias("pieces")).where("pieces > 1")


def window_index(steps: DataFrame, shard: Sequence[str], run: Sequence[str], labels: Sequence[str], admissible: Mapping[str, str], context: int) -> DataFrame:
    """shard, run, start_step, end_step, and per label its value and whether it is known, of steps where a window may end for some label.

    steps has step_no, the labels (null: unknown) and, per label, an admissible flag.
    """
    any_ = F.lit(False)
    for label in labels:
        any_ = any_ | F.col(admissible[label])
    flags = []
    for label in labels:
        known = F.col(admissible[label]) & F.col(label).isNotNull()
        flags += [(known & F.coalesce(F.col(label), F.lit(False))).alias(label), known.alias(f"{label}_known")]
    place = F.col("step_no")
    return steps.where(any_).select(*shard, *run, (place - (context - 1)).alias("start_step"), place.alias("end_step"), *flags)


def write_shards(steps: DataFrame, index: DataFrame, shard: Sequence[str], tokens: str, path: str, per_step: int, bytes_each: int = 2) -> DataFrame:
    """Writes tokens and index under path, a directory per shard, and returns the manifest read back from the files.

    shard, steps, tokens, bytes, windows. Shards whose steps don't number
    0..n-1, or hold other than per_step tokens, are an error.
    """
    spark = steps.sparkSession
    for name, df, by in (("tokens", steps.select(*shard, "step_no", F.col(tokens).alias("tokens")), "step_no"), ("windows", index, "end_step")):
        df.repartitionByRange(*shard, by).sortWithinPartitions(*shard, by).write.mode("overwrite").partitionBy(*shard).parquet(f"{path}/{name}")
    held = spark.read.parquet(f"{path}/tokens")
    sizes = held.groupBy(*shard).agg(
        F.count("*").alias("steps"), F.sum(F.size("tokens")).alias("tokens"), (F.sum(F.size("tokens")) * bytes_each).alias("bytes"),
        ((F.max("step_no") != F.count("*") - 1) | (F.count_distinct("step_no") != F.count("*")) | (F.max(F.size("tokens")) != per_step) | (F.min(F.size("tokens")) != per_step)).alias("bad"),
    )
    if broken := [tuple(r[k] for k in shard) for r in sizes.where("bad").collect()]:
        raise ValueError(f"shards {broken} don't hold their steps in whole")
    windows = spark.read.parquet(f"{path}/windows").groupBy(*shard).agg(F.count("*").alias("windows"))
    return sizes.drop("bad").join(windows, list(shard), "left").fillna(0, ["windows"])


def append_run(runs: DataFrame, shard: Sequence[str], order: str, size: str) -> DataFrame:
    """runs with first_token: where each run's tokens begin in its shard, in the order they are appended."""
    return running_offsets(runs, shard, order, F.col(size), "first_token")


def text_streams(docs: DataFrame, shard: Sequence[str], order: str, ids: str, separator: int, context: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their ids, a separator behind, and first_token; and per shard tokens and windows (at every token). A shard without a window is an error."""
    whole = docs.withColumn(ids, F.concat(ids, F.array(F.lit(separator).cast(docs.schema[ids].dataType.elementType))))
    placed = running_offsets(whole, shard, order, F.size(ids), "first_token")
    totals = whole.groupBy(*shard).agg(F.sum(F.size(ids)).alias("tokens"))
    totals = totals.withColumn("windows", F.greatest(F.lit(0), F.col("tokens") - (context - 1)))
    if short := [tuple(r[k] for k in shard) for r in totals.where("windows = 0").collect()]:
        raise ValueError(f"{short} have fewer than {context} tokens, so no window")
    return placed, totals


def chunked(streams: DataFrame, keys: Sequence[str], first: str, ids: str, size: int = CHUNK) -> DataFrame:
    """keys, chunk, tokens (array of struct(at, id)): stretches of ids that begin at first, cut at multiples of size."""
    cut = streams.select(*keys, F.col(first).alias("_f"), F.col(ids).alias("_ids")).where(F.size("_ids") > 0)
    last = F.col("_f") + F.size("_ids") - 1
    spread = cut.withColumn("chunk", F.explode(F.sequence(F.expr(f"_f div {size}"), F.expr(f"(_f + size(_ids) - 1) div {size}"))))
    low = F.greatest(F.col("_f"), F.col("chunk") * size)
    high = F.least(last, F.col("chunk") * size + (size - 1))
    piece = F.struct(low.alias("at"), F.slice("_ids", (low - F.col("_f") + 1).cast("int"), (high - low + 1).cast("int")).alias("ids"))
    whole = spread.select(*keys, "chunk", piece.alias("p")).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return whole.select(*keys, "chunk", F.col("ps")[0]["at"].alias("at"), F.flatten(F.transform("ps", lambda p: p["ids"])).alias("ids"))


def gather(windows: DataFrame, chunks: DataFrame, keys: Sequence[str], first: str, length: str, size: int = CHUNK, pad_to: int | None = None, pad: int = 0) -> DataFrame:
    """windows with tokens: those from first on, length of them, filled up with pad on the right to pad_to."""
    rows = windows.withColumn("_w", F.monotonically_increasing_id())
    probe = rows.where(F.col(length) > 0).select(
        *keys, "_w", F.col(first).alias("_f"), F.col(length).alias("_n"), F.explode(F.sequence(F.expr(f"{first} div {size}"), F.expr(f"({first} + {length} - 1) div {size}"))).alias("chunk")
    )
    low = F.greatest("_f", "at")
    met = probe.join(chunks, [*keys, "chunk"]).withColumn("_low", low)
    met = met.withColumn("_high", F.least(F.col("_f") + F.col("_n"), F.col("at") + F.size("ids"))).where("_high > _low")
    part = F.struct("_low", F.slice("ids", (F.col("_low") - F.col("at") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int")).alias("ids"))
    found = met.groupBy("_w").agg(F.array_sort(F.collect_list(part)).alias("ps")).select("_w", F.flatten(F.transform("ps", lambda p: p["ids"])).alias("tokens"))
    out = rows.join(found, "_w", "left").drop("_w")
    kind = chunks.schema["ids"].dataType
    tokens = F.coalesce("tokens", F.array().cast(kind))
    if pad_to is not None:
        tokens = F.concat(tokens, F.array_repeat(F.lit(pad).cast(kind.elementType), F.greatest(F.lit(0), pad_to - F.size(tokens)).cast("int")))
    return out.withColumn("tokens", tokens)


def last_real(tokens: Column, pad: int) -> Column:
    """Place of the last token that isn't padding; -1 if all are."""
    return F.array_max(F.concat(F.transform(tokens, lambda x, i: F.when(x != pad, i).otherwise(-1)), F.array(F.lit(-1))))


def tail_anchored(steps: DataFrame, keys: Sequence[str], context_steps: int, context: int, per_step: int) -> DataFrame:
    """steps(step, offset, size) with the window that ends with each: first, length, steps_retained, head_cut, status_tokens.

    A window reaches back context_steps at most, and takes the most whole steps
    whose tokens fit in context; if its own step alone doesn't, it is cut at its head.
    """
    w = W.partitionBy(*keys).orderBy("step")
    rows = steps.withColumn("_stop", F.col("offset") + F.col("size"))
    # the earliest step that begins at or behind stop - context, read in falling order of places
    start = rows.select(*keys, F.lit(None).cast(steps.schema["step"].dataType).alias("step"), F.col("offset").alias("_x"), F.struct("step", "offset").alias("_s"))
    probe = rows.select(*keys, "step", (F.col("_stop") - context).alias("_x")).withColumn("_s", F.lit(None).cast(start.schema["_s"].dataType))
    seen = F.min("_s").over(W.partitionBy(*keys).orderBy(F.desc("_x")).rangeBetween(W.unboundedPreceding, 0))
    fits = probe.unionByName(start).withColumn("_fit", seen).where("step is not null").select(*keys, "step", "_fit")
    early = F.first(F.struct("step", "offset")).over(w.rowsBetween(-(context_steps - 1), 0))
    rows = rows.withColumn("_early", early).join(fits, [*keys, "step"])
    chosen = F.greatest("_fit", "_early")
    rows = rows.withColumn("_c", chosen).withColumn("head_cut", F.coalesce(F.col("_c.step") > F.col("step"), F.lit(True)) | F.col("_fit").isNull())
    rows = rows.withColumn("first", F.when(F.col("head_cut"), F.col("_stop") - context).otherwise(F.col("_c.offset")))
    rows = rows.withColumn("length", F.col("_stop") - F.col("first")).withColumn("steps_retained", F.when(F.col("head_cut"), 0).otherwise(F.col("step") - F.col("_c.step") + 1))
    cut = F.greatest(F.lit(0), F.least(F.lit(per_step), F.col("offset") + per_step - F.col("first")))
    telemetry = F.when(F.col("head_cut"), cut).otherwise(F.col("steps_retained") * per_step)
    return rows.withColumn("status_tokens", F.col("length") - telemetry).drop("_stop", "_early", "_fit", "_c")


def run_step_starts(steps: DataFrame, keys: Sequence[str], run_first: str, run_tokens: str, stride: int, context: int) -> DataFrame:
    """Every stride-th step of each run (keys) whose window of context tokens ends inside the run."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy("offset")) - 1
    fits = F.col("offset") + context <= F.col(run_first) + F.col(run_tokens)
    return steps.withColumn("_n", n).where((F.col("_n") % stride == 0) & fits).drop("_n")


def windows_in_run(starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return starts.groupBy(*keys).agg(F.count("*").alias("windows"))


def stream_order(messages: DataFrame, steps: DataFrame, keys: Sequence[str], shard: Sequence[str]) -> DataFrame:
    """messages(keys, step, start) in the order in which a shard has them: shard, step_no, nth (from 0 within the step).

    steps has keys, step, shard and step_no; messages of other steps go.
    """
    placed = messages.join(steps.select(*keys, "step", *shard, "step_no"), [*keys, "step"])
    return placed.withColumn("nth", F.row_number().over(W.partitionBy(*shard, "step_no").orderBy("start", "message")) - 1)


def step_message_counts(steps: DataFrame, messages: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, messages: how many messages follow each step, 0 for none."""
    return steps.select(*on).join(messages.groupBy(*on).agg(F.count("*").alias("messages")), list(on), "left").fillna(0, ["messages"])


def rank_by_hash(df: DataFrame, by: Sequence[str], text: Column, name: str = "rank", leaf: int = LEAF) -> DataFrame:
    """df with name: the place of each row among those of by, in the order of text's md5; ranks are made inside leaves of the hash."""
    h = df.withColumn("_h", F.md5(text.cast("binary")))
    digits = h.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_d", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / leaf) / 4)).cast("int"))
    h = h.join(digits.select(*by, "_d"), list(by)) if by else h.crossJoin(F.broadcast(digits.select("_d")))
    h = h.withColumn("_leaf", F.expr("substring(_h, 1, _d)"))
    before = W.partitionBy(*by).orderBy("_leaf").rowsBetween(W.unboundedPreceding, -1)
    leaves = h.groupBy(*by, "_leaf").agg(F.count("*").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = F.row_number().over(W.partitionBy(*by, "_leaf").orderBy("_h")) - 1
    return h.join(leaves, [*by, "_leaf"]).withColumn(name, F.col("_base") + inside).drop("_h", "_d", "_leaf", "_base")


def schedule(spark: SparkSession, shares: Mapping[str, float], draws: int) -> DataFrame:
    """draw, stream, nth: the stream of each draw, the furthest behind its share first, and how many draws it had before.

    Shares are ratios, so the order repeats after their common denominator; one
    such period is made on the driver and looked up by every draw.
    """
    ratio = {s: Fraction(x).limit_denominator(10_000) for s, x in shares.items() if x > 0}
    if sum(ratio.values()) != 1:
        raise ValueError(f"shares sum to {float(sum(ratio.values()))}, not 1")
    period = lcm(*[r.denominator for r in ratio.values()])
    order = mixture_schedule(ratio, period)
    seen, before = dict.fromkeys(ratio, 0), []
    for s in order:
        before.append(seen[s])
        seen[s] += 1
    place = (F.col("id") % period).cast("int")
    per = F.create_map(*[x for s, n in seen.items() for x in (F.lit(s), F.lit(n))])
    rows = spark.range(draws).select(F.col("id").alias("draw"), F.array(*map(F.lit, order))[place].alias("stream"), F.array(*map(F.lit, before))[place].alias("_b"))
    return rows.select("draw", "stream", (F.expr(f"draw div {period}") * per[F.col("stream")] + F.col("_b")).alias("nth"))


def mixture_plan(drawn: DataFrame, pools: DataFrame, refuse: bool = True) -> DataFrame:
    """stream, planned, windows: draws of each stream and the windows of its pool(stream, windows). Streams that would repeat are an error."""
    plan = drawn.groupBy("stream").agg(F.count("*").alias("planned")).join(pools, "stream", "left").fillna(0, ["windows"])
    if refuse and (over := plan.where("planned > windows").collect()):
        raise ValueError("; ".join(f"{r['stream']}: {r['planned']} windows planned, {r['windows']} there" for r in over))
    return plan


def mixture_batches(drawn: DataFrame, windows: DataFrame, key: str, seed: int, batch: int) -> DataFrame:
    """drawn with batch and the window (stream, key) of each draw: a stream's windows in a seeded order, anew in each pass."""
    sizes = windows.groupBy("stream").agg(F.count("*").alias("_n"))
    placed = drawn.join(sizes, "stream").withColumn("pass", F.expr("nth div _n")).withColumn("rank", F.expr("nth % _n")).drop("_n")
    passes = placed.groupBy("stream").agg(F.max("pass").alias("_p"))
    ordered = windows.join(passes, "stream").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "_p"))).drop("_p")
    ordered = rank_by_hash(ordered, ["stream", "pass"], F.concat_ws(":", F.lit(str(seed)), "stream", "pass", F.col(key).cast("string")))
    return placed.join(ordered, ["stream", "pass", "rank"]).withColumn("batch", F.expr(f"draw div {batch}"))


def balanced_cycle(df: DataFrame, key: str, label: str, positives: int, size: int, batches: int, seed: int) -> DataFrame:
    """batch, key, label: batches of size with exactly so many positives; each class is used up in a seeded order before it starts anew."""
    spark = df.sparkSession
    flag = F.col(label).cast("int")
    slots = spark.range(batches * size).select(F.expr(f"id div {size}").alias("batch"), F.expr(f"id % {size}").alias("slot"))
    slots = slots.withColumn("stream", F.when(F.col("slot") < positives, "1").otherwise("0"))
    nth = F.when(F.col("slot") < positives, F.col("batch") * positives + F.col("slot")).otherwise(F.col("batch") * (size - positives) + F.col("slot") - positives)
    drawn = slots.select("batch", "stream", nth.alias("nth"), F.expr(f"batch * {size} + slot").alias("draw"))
    rows = df.select(flag.cast("string").alias("stream"), key)
    found = mixture_batches(drawn.drop("batch"), rows, key, seed, size)
    return found.select("batch", key, F.col("stream").cast("int").alias(label))


def missing_share(windows: DataFrame, steps: DataFrame, keys: Sequence[str], start: str, end: str, missing: str, width: int) -> DataFrame:
    """keys, share: of all values in windows (closed step ranges; overlaps count again) those that are missing, by prefix sums.

    steps has keys, step_no and the number of missing values of each step.
    """
    upto = running_offsets(steps, keys, "step_no", F.col(missing), "_before").select(*keys, F.col("step_no").alias("_at"), "_before", (F.col("_before") + F.col(missing)).alias("_after"))
    lower = windows.join(upto.select(*keys, F.col("_at").alias(start), "_before"), [*keys, start])
    both = lower.join(upto.select(*keys, F.col("_at").alias(end), "_after"), [*keys, end])
    return both.groupBy(*keys).agg((F.sum(F.col("_after") - F.col("_before")) / F.sum((F.col(end) - F.col(start) + 1) * width)).alias("share"))


def channel_absence(windows: DataFrame, steps: DataFrame, keys: Sequence[str], start: str, end: str, channels: Sequence[str]) -> DataFrame:
    """keys, channel, step_share (missing among the distinct steps that windows cover), window_share (overlaps counted again), everywhere."""
    w = W.partitionBy(*keys).orderBy("step_no")
    change = windows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("step_no"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("step_no"), F.lit(-1).alias("d")))).alias("x"))
    change = change.select(*keys, "x.step_no", "x.d").groupBy(*keys, "step_no").agg(F.sum("d").alias("_d"))
    times = F.sum(F.coalesce("_d", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = steps.join(change, [*keys, "step_no"], "left").withColumn("_t", times).where("_t > 0")
    long = rows.select(*keys, "_t", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).isNull().cast("long").alias("m")) for c in channels])).alias("x"))
    return long.groupBy(*keys, "x.channel").agg(
        F.avg("x.m").alias("step_share"), (F.sum(F.col("x.m") * F.col("_t")) / F.sum("_t")).alias("window_share"), (F.min("x.m") == 1).alias("everywhere")
    )


def index_counts(index: DataFrame, by: Sequence[str], label: str, block: Column) -> DataFrame:
    """by, windows, positives, blocks, positive_blocks of windows with a known label."""
    rows = index.where(F.col(label).isNotNull()).withColumn("_b", block)
    return rows.groupBy(*by).agg(
        F.count("*").alias("windows"), F.count_if(F.col(label)).alias("positives"), F.count_distinct("_b").alias("blocks"), F.count_distinct(F.when(F.col(label), F.col("_b"))).alias("positive_blocks")
    )


def index_statistics(framed: DataFrame, label: str, context_steps: int) -> DataFrame:
    """kind ('positive', 'negative', 'all'), windows, and of retained steps mean, p5 and least; shares of windows truncated, cut and with messages."""
    rows = framed.withColumn("_k", F.when(F.col(label), "positive").otherwise("negative"))
    spread = rows.withColumn("kind", F.explode(F.array("_k", F.lit("all"))))
    mean = lambda c: F.avg(c.cast("double"))
    return spread.groupBy("kind").agg(
        F.count("*").alias("windows"), F.avg("steps_retained").alias("mean_steps"), F.percentile("steps_retained", F.lit(0.05)).alias("p5_steps"), F.min("steps_retained").alias("least_steps"),
        mean(F.col("steps_retained") < context_steps).alias("truncated"), mean(F.col("head_cut")).alias("cut"), mean(F.col("status_tokens") > 0).alias("with_status"),
    )


def every_kth(df: DataFrame, keys: Sequence[str], order: str, stride: int) -> DataFrame:
    """The first of each key's rows and every stride-th after it."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("_n", n).where(F.col("_n") % stride == 0).drop("_n")


def turbine_years(windows: DataFrame, events: DataFrame, stride: int) -> DataFrame:
    """turbine, year, windows, positives at a stride, rate, events: the candidates for a replay, before any score is read."""
    some = every_kth(windows, ["turbine", "year"], "end_step", stride)
    n = events.groupBy("turbine", "year").agg(F.count("*").alias("events"))
    out = some.groupBy("turbine", "year").agg(F.count("*").alias("windows"), F.count_if("label").alias("positives"))
    return out.withColumn("rate", F.col("positives") / F.col("windows")).join(n, ["turbine", "year"], "left").fillna(0, ["events"])


def choose(candidates: DataFrame, rule: str, target: float = 0.0) -> DataFrame:
    """turbine, criterion, ties, runner_up: the candidate with most events, or whose rate is closest to target; ties to the first turbine."""
    criterion = -F.col("events") if rule == "most_events" else F.abs(F.col("rate") - target)
    rows = candidates.withColumn("criterion", criterion.cast("double"))
    best = rows.agg(F.min("criterion").alias("criterion"), F.slice(F.array_sort(F.collect_list(F.struct("criterion", "turbine"))), 1, 2).alias("two"))
    ties = rows.join(F.broadcast(best.select("criterion")), "criterion").agg((F.count("*") - 1).alias("ties"))
    return best.select(F.col("two")[0]["turbine"].alias("turbine"), "criterion", F.get("two", F.lit(1))["turbine"].alias("runner_up")).crossJoin(ties)
