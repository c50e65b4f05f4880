"""Shards of a mixture of streams, and digests that compare ordered token streams without sorting them.

A mixture has three streams per shard (source, split): readings alone,
readings with the messages of each step behind it (once per convention of
writing them), and text. Tokens are stored in chunks, rows that know where they
begin, and runs say where each piece of a turbine's year lies.

The digest of a stream is a polynomial in two moduli: token + 1 times the base
to the power of the token's place, summed. A chunk gives its part on its own,
parts add up in any order, so equal digests and lengths mean equal streams (up
to chance, 2**-60) however either is cut. Chunk by chunk they say where two
streams differ.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards as H
from .tables import forget, written

#: Moduli (primes under 2**31, so products fit a long) and bases of the two halves of a digest.
MODULI, BASES = ((1 << 31) - 1, (1 << 31) - 19), (1_103_515_245, 134_775_813)
SHARD = ["source", "split"]
RUN = ["turbine", "year", "segment"]


def power_mod(base: int, exponent: Column, modulus: int) -> Column:
    """base ** exponent % modulus for exponents of 0 and more, by the squares of base."""
    squares, x = [], base % modulus
    for _ in range(48):  # places under 2**48
        squares.append(x)
        x = x * x % modulus
    terms = F.transform(F.array(*[F.lit(s).cast("long") for s in squares]), lambda s, i: F.when(F.getbit(exponent, i) == 1, s).otherwise(F.lit(1).cast("long")))
    return F.aggregate(terms, F.lit(1).cast("long"), lambda a, s: a * s % modulus)


def digest_parts(chunks: DataFrame, at: str = "at", ids: str = "ids") -> list[Column]:
    """The two sums of a chunk of ids that begins at place at of its stream."""

    def part(base: int, modulus: int) -> Column:
        inside = F.aggregate(F.reverse(ids), F.lit(0).cast("long"), lambda a, x: (a * base + x + 1) % modulus)
        return inside * power_mod(base, F.col(at).cast("long"), modulus) % modulus

    return [part(base, modulus) for base, modulus in zip(BASES, MODULI, strict=True)]


def stream_digests(chunks: DataFrame, keys: Sequence[str], at: str = "at", ids: str = "ids") -> DataFrame:
    """keys, tokens, digest (16 hex digits) of the streams whose chunks(keys, at, ids) these are; any order, any cut.

    A stream of no tokens has the digest of zeros; null ids count as an empty
    chunk. Chunks that overlap give a digest of no stream, and more tokens than it has.
    """
    x, y = digest_parts(chunks, at, ids)
    rows = chunks.where(F.col(ids).isNotNull()).select(*keys, F.size(ids).alias("_n"), x.alias("_x"), y.alias("_y"))
    sums = rows.groupBy(*keys).agg(F.sum("_n").alias("tokens"), *[(F.sum(c) % m).alias(c) for c, m in zip(("_x", "_y"), MODULI, strict=True)])
    return sums.select(*keys, "tokens", F.lower(F.concat(*[F.lpad(F.hex(c), 8, "0") for c in ("_x", "_y")])).alias("digest"))


def differing_chunks(one: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, chunk of chunks(keys, chunk, at, ids) that only one stream has or that hold other tokens or begin elsewhere."""
    told = []
    for df in (one, other):
        x, y = digest_parts(df)
        told.append(df.select(*keys, "chunk", F.struct("at", F.size("ids").alias("n"), x.alias("x"), y.alias("y")).alias("told")))
    both = told[0].withColumnRenamed("told", "a").join(told[1].withColumnRenamed("told", "b"), [*keys, "chunk"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, "chunk")


def same_prefix(tokens: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, tokens, same: whether the first tokens of a stored stream are those of tokens(keys, at, ids), which begin at 0.

    Both sides are cut at the length of the first; a stream that isn't stored is not the same.
    """
    length = tokens.groupBy(*keys).agg(F.max(F.col("at") + F.size("ids")).alias("_n"))
    head = stored.join(length, list(keys)).where(F.col("at") < F.col("_n"))
    head = head.select(*keys, "at", F.slice("ids", F.lit(1), F.least(F.size("ids"), F.col("_n") - F.col("at")).cast("int")).alias("ids"))
    mine, theirs = stream_digests(tokens, keys), stream_digests(head, keys).withColumnRenamed("tokens", "_t").withColumnRenamed("digest", "_d")
    joined = mine.join(theirs, list(keys), "left")
    return joined.select(*keys, "tokens", F.coalesce((F.col("tokens") == F.col("_t")) & (F.col("digest") == F.col("_d")), F.lit(False)).alias("same"))


def highest_ids(stored: DataFrame, keys: Sequence[str], below: int) -> DataFrame:
    """keys, tokens, highest, inside: the largest id of each stream, and whether all are below a bound."""
    rows = stored.groupBy(*keys).agg(F.sum(F.size("ids")).alias("tokens"), F.max(F.array_max("ids")).alias("highest"), F.min(F.array_min("ids")).alias("_low"))
    return rows.select(*keys, "tokens", "highest", ((F.col("highest") < below) & (F.col("_low") >= 0)).alias("inside"))


def status_stream(steps: DataFrame, messages: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """steps(shard, run, step, ids) with ids and messages, message_tokens: each step's ids, then those of its messages in the order of their start.

    messages(turbine, step, start, message) of steps that are there; encode adds
    ids to a table of different messages, each of which it sees once. Equal
    starts stand in the order of the message.
    """
    coded = encode(messages.select("message").distinct())
    said = messages.join(coded.select("message", F.col("ids").alias("_said")), "message")
    said = said.groupBy("turbine", "step").agg(F.array_sort(F.collect_list(F.struct("start", "message", "_said"))).alias("_m"))
    joined = steps.join(said, ["turbine", "step"], "left")
    more = F.flatten(F.transform("_m", lambda m: m["_said"]))
    more = F.coalesce(more, F.array().cast(steps.schema["ids"].dataType))
    return joined.select(
        *SHARD, *RUN, "step", F.concat("ids", more).alias("ids"), F.coalesce(F.size("_m"), F.lit(0)).alias("_k"), F.size(more).alias("message_tokens")
    ).withColumn("messages", F.greatest("_k", F.lit(0))).drop("_k")


def place_runs(steps: DataFrame, context: int, stride: int) -> tuple[DataFrame, DataFrame]:
    """steps with at, the place of each step's ids in its shard, and the run index.

    Runs follow each other by turbine, year and segment. The index has shard,
    run, first_token, tokens, steps and windows: of every stride-th step of a
    run, those whose window of context tokens ends inside the run.
    """
    sizes = steps.groupBy(*SHARD, *RUN).agg(F.sum(F.size("ids")).alias("tokens"), F.count("*").alias("steps"))
    before = F.coalesce(F.sum("tokens").over(H.W.partitionBy(*SHARD).orderBy(*RUN).rowsBetween(H.W.unboundedPreceding, -1)), F.lit(0))
    runs = written(sizes.withColumn("first_token", before), "runs")
    inside = H.W.partitionBy(*SHARD, *RUN).orderBy("step")
    offset = F.coalesce(F.sum(F.size("ids")).over(inside.rowsBetween(H.W.unboundedPreceding, -1)), F.lit(0))
    placed = steps.withColumns({"_o": offset, "_k": F.row_number().over(inside) - 1}).join(runs, [*SHARD, *RUN])
    starts = (F.col("_k") % stride == 0) & (F.col("_o") + context <= F.col("tokens"))
    placed = written(placed.select(*SHARD, *RUN, "step", "ids", (F.col("first_token") + F.col("_o")).alias("at"), starts.alias("starts")), "placed")
    windows = placed.groupBy(*SHARD, *RUN).agg(F.count_if("starts").alias("windows"))
    return placed.drop("starts"), runs.join(windows, [*SHARD, *RUN])


def store_stream(placed: DataFrame, path: str, size: int = H.CHUNK) -> DataFrame:
    """Writes placed(shard, at, ids) in chunks of size tokens, a folder per shard, and reads them; it is an error if other tokens come back."""
    spark = placed.sparkSession
    chunks = H.chunked(placed, SHARD, "at", "ids", size)
    chunks.repartitionByRange(*SHARD, "chunk").sortWithinPartitions(*SHARD, "chunk").write.mode("overwrite").partitionBy(*SHARD).parquet(path)
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    stored = spark.read.schema(f"chunk long, at long, ids {kinds['ids']}, source {kinds['source']}, split {kinds['split']}").parquet(path)
    wrong = stream_digests(placed, SHARD).exceptAll(stream_digests(stored, SHARD))
    if bad := wrong.limit(20).collect():
        raise ValueError(f"streams {[tuple(r[k] for k in SHARD) for r in bad]} of {path} don't hold the tokens that were written")
    return stored


def build_mixture(
    steps: DataFrame, messages: DataFrame, texts: DataFrame, path: str, conventions: Mapping[str, Callable[[DataFrame], DataFrame]], *,
    step_of: Callable[[Column], Column], context: int, stride: int, text_offset: int, separator: int, joint_separator: int, speaking: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Writes the streams of a mixture under path and returns its tables: tallies, runs (with stream and variant), losses, and chunks per stream.

    steps(source, split, turbine, year, segment, step, ids) are encoded
    readings, each step of a turbine once; messages(turbine, start, message)
    belong to the step that step_of(start) names, if it is there. texts(source,
    split, doc, ids) have local ids and end with separator; they become joint
    ones by text_offset, the separator joint_separator. conventions maps a
    variant's name to the function that encodes different messages.
    speaking: the sources that have messages, all by default.

    tallies: stream, variant, source, split, tokens, steps, messages,
    message_tokens, windows. losses: unmatched (messages without text) and
    dropped (whose step isn't there), of all messages. Empty tables give
    streams without shards.
    """
    held = speaking is None
    spoken = steps if held else steps.where(F.col("source").isin(*speaking))
    found = written(messages.where("message is not null").withColumn("step", step_of(F.col("start"))), "messages")
    there = written(found.join(steps.select("turbine", "step").distinct(), ["turbine", "step"]), "messages")
    streams = {("tel", "-"): steps.withColumns({"messages": F.lit(0), "message_tokens": F.lit(0)})}
    streams |= {("tel+status", name): written(status_stream(spoken, there, encode), "status") for name, encode in conventions.items()}
    out: dict[str, DataFrame] = {}
    tallies, indexes = [], []
    for (stream, variant), rows in streams.items():
        placed, runs = place_runs(rows, context, stride)
        name = stream if variant == "-" else f"{stream}_{variant}"
        out[name] = store_stream(placed, f"{path}/{name}")
        runs.repartitionByRange(*SHARD, *RUN).write.mode("overwrite").partitionBy(*SHARD).parquet(f"{path}/{name}.runs")
        said = rows.groupBy(*SHARD).agg(F.sum("messages").alias("messages"), F.sum("message_tokens").alias("message_tokens"))
        sums = runs.groupBy(*SHARD).agg(*[F.sum(c).alias(c) for c in ("tokens", "steps", "windows")]).join(said, SHARD)
        tallies.append(sums.select(F.lit(stream).alias("stream"), F.lit(variant).alias("variant"), *SHARD, "tokens", "steps", "messages", "message_tokens", "windows"))
        indexes.append(runs.withColumns({"stream": F.lit(stream), "variant": F.lit(variant)}))
    joint = F.transform("ids", lambda x: F.when(x == separator, joint_separator).otherwise(x + text_offset))
    placed = written(H.running_offsets(texts.withColumn("ids", joint), SHARD, "doc", F.size("ids"), "at"), "texts")
    out["txt"] = store_stream(placed, f"{path}/txt")
    sums = placed.groupBy(*SHARD).agg(F.sum(F.size("ids")).alias("tokens"))
    zero = F.lit(0).cast("long")
    tallies.append(
        sums.select(F.lit("txt").alias("stream"), F.lit("-").alias("variant"), *SHARD, "tokens", zero.alias("steps"), zero.alias("messages"), zero.alias("message_tokens"), F.greatest(zero, F.col("tokens") - context + 1).alias("windows"))
    )
    for more in tallies[1:]:
        tallies[0] = tallies[0].unionByName(more)
    for more in indexes[1:]:
        indexes[0] = indexes[0].unionByName(more)
    lost = messages.agg(F.count_if(F.col("message").isNull()).alias("unmatched"), F.count("message").alias("_m"))
    kept = there.agg(F.count("*").alias("_k"))
    losses = lost.select("unmatched", "_m", F.lit(1).alias("_j")).join(kept.withColumn("_j", F.lit(1)), "_j").select("unmatched", (F.col("_m") - F.col("_k")).alias("dropped"))
    out |= {"tallies": written(tallies[0], "tallies"), "runs": indexes[0], "losses": losses}
    forget(found)
    return out
