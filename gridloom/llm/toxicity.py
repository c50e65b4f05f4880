"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Insults come in spellings and inflections that no word list or word count has
seen, so the models predict a word's bytes one by one. For each class c, byte b
and context v (the bytes before it in the word, at most ORDER - 1),

    P_c(b | v) = max(n_c(v, b) - D, 0) / n_c(v) + D * kinds_c(v) / n_c(v) * P(b | v')

where v' is v without its first byte and P the Kneser-Ney model of the next
lower order over continuation counts of both classes. A word counts once for
each different text that has it, so copies and lists don't look like habits. Where a class lacks a
rare expression, the shared counts speak for it and the ratio stays near one.
Of a toxic text's words a share of INSULTS is the first class's and the others
are the second's, so a word with log ratio r counts by log(1 - INSULTS +
INSULTS * exp(r)): ordinary words speak against the class, within bounds. A
passage's sum over its words is the difference of its log-likelihoods under both
classes, and over the number of its words it is normalised by length. A text's
evidence is that of its strongest passage of PASSAGE words (a shorter text is
one). A text without insults has no stronger passages for being long, and one
insulting passage isn't outvoted by the rest. A logistic curve, fitted on
training rows that the counts have not seen, maps the signed root of the
evidence to a score.

A model of at most MOST_GRAMS grams is broadcast to the workers. Larger ones
stay a table: the different words of the texts are joined to their grams, and
texts to their words, with the same result.

The counts of a class are those of all its labelled rows but the held-out ones
and the curve's, the continuation counts those of all texts; both are
aggregates of the executors. Only the curve is fitted on a bounded sample: of
each class the rows of one fold that come first by a hash of their id, at most
max_docs of them. The scores cover all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .textcore import Words, add_column, blocks, free_name, give_back, utf8

D = 0.75
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
ORDER = 6
INSULTS = 0.03
PASSAGE = 64
BEGIN, END = 1, 2
HELD_GRAMS = 1 << 18
MOST_GRAMS = 1 << 24
BROADCAST_ROWS = 1 << 20


def split_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Words object, place of each word among the distinct ones, and the word that first shows each distinct one."""
    words = Words(data, offsets, SEPARATORS, lower=True)
    _, shown, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return words, place, shown


def _letter_keys(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the chosen words: for each byte and the end mark its ORDER last bytes packed, its own lowest; and the bounds of words."""
    length = words.ends[which] - words.starts[which]
    bounds = np.append(0, np.cumsum(length + 1))
    text = np.full(bounds[-1], END, np.uint8)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length + 1)
    text[inside] = words.data[(np.repeat(words.starts[which], length + 1) + at)[inside]]
    keys = text.astype(np.uint64)
    for back in range(1, ORDER):
        old = np.zeros(len(text), np.uint64)
        old[back:] = text[:-back]
        old[at == back - 1] = BEGIN
        old[at < back - 1] = 0
        keys |= old << np.uint64(8 * back)
    return keys, bounds


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the sorted table; its length for those that it lacks."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    at[table[at] != keys] = len(table)
    return at


def _block_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter grams of a block of texts, and how often its words have them; a word counts once a text."""
    words, place, shown = _distinct_words(*utf8(column))
    if not len(shown):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, bounds = _letter_keys(words, shown)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    once = np.unique(doc * len(shown) + place) % len(shown)
    times = np.repeat(np.bincount(once, minlength=len(shown)), np.diff(bounds))
    grams, where = np.unique(keys, return_inverse=True)
    return grams, np.bincount(where, times).astype(np.int64)


def count_grams(texts: DataFrame) -> DataFrame:
    """gram, toxic, ordinary: the distinct letter grams of texts(toxic, text), and how often each class has them. A null class only shows grams."""

    def run(batches):
        held = {c: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for c in (1, 0, -1)}

        def rows():
            for c, (grams, often) in held.items():
                none = np.zeros(len(grams), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.astype(np.int64)), pa.array(often if c == 1 else none), pa.array(often if c == 0 else none)], ["gram", "toxic", "ordinary"]
                )
                held[c] = (grams[:0], often[:0])

        for part in blocks(batches):
            toxic = part.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
            for c in held:
                if (toxic == c).any():
                    found = _block_grams(part.column("text").filter(pa.array(toxic == c)))
                    grams, where = np.unique(np.concatenate([held[c][0], found[0]]), return_inverse=True)
                    held[c] = grams, np.bincount(where, np.concatenate([held[c][1], found[1]]), len(grams)).astype(np.int64)
            if sum(len(grams) for grams, _ in held.values()) > HELD_GRAMS:
                yield from rows()
        yield from rows()

    rows = texts.select("toxic", "text").mapInArrow(run, "gram long, toxic long, ordinary long")
    return rows.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _last(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))


def shared_probability(grams: DataFrame) -> DataFrame:
    """gram, p: P(b | v') of the distinct grams without their first byte, by continuation counts of all lower orders."""
    levels, longer = [], grams
    for order in range(ORDER - 1, 0, -1):
        longer = longer.groupBy(_last(order).alias("gram")).agg(F.count("*").alias("n"))
        levels.append(longer)
    context = Window.partitionBy("context")
    p = None
    for order, level in enumerate(reversed(levels), 1):
        level = level.withColumn("context", F.shiftright("gram", 8)).select(
            "gram", "n", F.sum("n").over(context).alias("total"), F.count("*").over(context).alias("variety"), _last(order - 1).alias("lower")
        )
        level = level.withColumn("rest", F.lit(1 / 256)) if p is None else level.join(p.select(F.col("gram").alias("lower"), F.col("p").alias("rest")), "lower")
        told = F.greatest(F.col("n") - D, F.lit(0.0)) / F.col("total") + D * F.col("variety") / F.col("total") * F.col("rest")
        p = level.select("gram", told.alias("p"))
    return p


def log_ratios(grams: DataFrame) -> DataFrame:
    """gram, ratio, context_ratio of the grams(gram, toxic, ordinary) that a class has; of all others the ratio is their context's."""
    shared = shared_probability(grams).withColumnRenamed("gram", "lower")
    context = Window.partitionBy("context")
    rows = grams.where("toxic + ordinary > 0").withColumn("context", F.shiftright("gram", 8)).withColumn("lower", _last(ORDER - 1))
    for c in ("toxic", "ordinary"):
        rows = rows.withColumn(f"{c}_total", F.sum(c).over(context)).withColumn(f"{c}_kinds", F.count(F.when(F.col(c) > 0, 1)).over(context))
        rows = rows.withColumn(f"{c}_rest", F.when(F.col(f"{c}_total") > 0, D * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0))
    rows = rows.join(shared, "lower")
    told = lambda c: F.greatest(F.col(c) - D, F.lit(0.0)) / F.greatest(F.col(f"{c}_total"), F.lit(1)) + F.col(f"{c}_rest") * F.col("p")
    return rows.select(
        "gram", (F.log(told("toxic")) - F.log(told("ordinary"))).alias("ratio"), (F.log("toxic_rest") - F.log("ordinary_rest")).alias("context_ratio")
    )


class KneserNey:
    """Log ratios, first class over second, of the keys and contexts that the classes hold."""

    def __init__(self, rows: pa.Table):
        """Of the rows that log_ratios gives."""
        gram, ratio, context_ratio = (rows.column(c).to_numpy() for c in ("gram", "ratio", "context_ratio"))
        order = np.argsort(gram)
        self.keys = gram[order].astype(np.uint64)
        self.contexts, at = np.unique(self.keys >> np.uint64(8), return_index=True)
        self.ratio = np.append(ratio[order], 0.0)
        self.context_ratio = np.append(context_ratio[order][at], 0.0)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Evidence for the first class in each text; 0 without words."""
        batches = iter([pa.RecordBatch.from_arrays([column], ["text"])])
        return np.concatenate([np.zeros(0), *[self._evidence(*utf8(part.column("text"))) for part in blocks(batches)]])

    def _evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, place, shown = _distinct_words(data, offsets)
        if not len(shown):
            return np.zeros(len(offsets) - 1)
        keys, bounds = _letter_keys(words, shown)
        at = _lookup(self.keys, keys)
        ratio = self.ratio[at]
        new = np.flatnonzero(at == len(self.keys))
        ratio[new] = self.context_ratio[_lookup(self.contexts, keys[new] >> np.uint64(8))]
        by_word = _word_value(np.add.reduceat(ratio, bounds[:-1]))[place]
        return strongest_passages(by_word, words.first)


def _word_value(ratio: np.ndarray) -> np.ndarray:
    """What a word with that log ratio adds to a toxic text's evidence."""
    return np.log1p(INSULTS * np.expm1(np.minimum(ratio, 500)))


def strongest_passages(by_word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signed root of PASSAGE times the greatest mean of PASSAGE adjacent words of each text, of all words of a shorter one; 0 without words."""
    sums = np.append(0.0, np.cumsum(by_word))
    begin, end = first[:-1], first[1:]
    best = (sums[end] - sums[begin]) * (PASSAGE / np.maximum(end - begin, 1))
    long = np.flatnonzero(end - begin > PASSAGE)
    if len(long):
        passages = sums[PASSAGE:] - sums[:-PASSAGE]
        # to the last passage that begins in the text and ends in it, then on to the next text's first
        bounds = np.stack([begin[long], end[long] - PASSAGE + 1], axis=1).ravel()
        best[long] = np.maximum.reduceat(np.append(passages, -np.inf), bounds)[::2]
    return np.sign(best) * np.sqrt(np.abs(best))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton steps; where y has one class, its share alone, and 0 without rows."""
    rate = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
    w = np.array([0.0, np.log(rate / (1 - rate))])
    if len(np.unique(y)) < 2:
        return 0.0, float(w[1])
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        move = np.linalg.solve(hess, g)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def training_rows(labels: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, toxic) of the rows that are counted, and of those that fit the curve: at most max_docs of a class, the first by hash of the id.

    An id with both labels is toxic.
    """
    rows = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("fold", split_of(F.col("doc_id")))
        .where("fold <> 2")
    )
    picked = None
    for toxic in (0, 1):
        some = rows.where((F.col("toxic") == toxic) & (F.col("fold") == 3)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        picked = some if picked is None else picked.union(some)
    curve = materialize(picked.select("doc_id", "toxic"), "toxicity-curve")
    return rows.join(F.broadcast(curve.select("doc_id")), "doc_id", "left_anti").select("doc_id", "toxic"), curve


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows; a larger one is joined by a shuffle, before which Spark filters by its Bloom filter."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def one_of_each(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """toxic, text: each different text of texts(doc_id, text) once per class, by hashes of 128 bits, so texts are not shuffled."""
    marked = texts.select("*", F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), "text").alias("_g"))
    known = materialize(marked.join(small(counted), "doc_id").select("doc_id", "toxic", "_h", "_g"), "toxicity-texts")
    first = materialize(known.groupBy("toxic", "_h", "_g").agg(F.min("doc_id").alias("doc_id")), "toxicity-firsts")
    rows = marked.join(small(first), ["doc_id", "_h", "_g"])
    if known.groupBy("doc_id", "_h", "_g").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["toxic", "_h", "_g"])  # some rows repeat both id and text
    return rows.select("toxic", "text")


def _word_rows(batches):
    """row, word, places: the different words of each text, and where it has them."""
    for part in blocks(batches):
        words, place, shown = _distinct_words(*utf8(part.column("text")))
        rows = np.repeat(np.arange(part.num_rows), np.diff(words.first))
        at = np.arange(len(place)) - words.first[rows] if len(place) else place
        order = np.lexsort([at, place, rows])
        rows, place, at = rows[order], place[order], at[order]
        cut = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(place) != 0))) if len(rows) else np.zeros(0, int)
        heads = shown[place[cut]]
        spelled = [words.data[a:b].tobytes() for a, b in zip(words.starts[heads].tolist(), words.ends[heads].tolist(), strict=True)]
        places = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
        ids = part.column("row").take(pa.array(rows[cut]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(spelled, pa.binary()), places], ["row", "word", "places"])


def _word_grams(batches):
    """word and its letter grams."""
    for batch in batches:
        data, offsets = utf8(batch.column("word"))
        # words stand one after the other, none holds a separator
        spans = Words(np.append(data, np.uint8(32)), offsets)
        keys, bounds = _letter_keys(spans, np.arange(len(spans.starts)))
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.astype(np.int64)))], ["word", "grams"])


def table_evidence(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """row, x: the evidence of rows(row, text) under a model that stays a table of log_ratios(); row tells rows apart, texts without words are left out."""
    held = materialize(rows.select("row", "text").mapInArrow(_word_rows, "row long, word binary, places array<int>"), "toxicity-words")
    grams = held.select("word").distinct().mapInArrow(_word_grams, "word binary, grams array<long>").select("word", F.posexplode("grams").alias("i", "gram"))
    contexts = ratios.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.first("context_ratio").alias("context_ratio"))
    told = grams.withColumn("context", F.shiftright("gram", 8)).join(ratios.select("gram", "ratio"), "gram", "left").join(contexts, "context", "left")
    values = told.groupBy("word").agg(F.sum(F.coalesce("ratio", "context_ratio", F.lit(0.0))).alias("ratio"))
    spread = held.join(values, "word").groupBy("row").agg(F.collect_list(F.struct("places", "ratio")).alias("words"))  # the words of one text

    def measure(batches):
        for batch in batches:
            x = []
            for words in batch.column("words").to_pylist():
                by_word = np.zeros(sum(len(w["places"]) for w in words))
                for w in words:
                    by_word[w["places"]] = w["ratio"]
                x.append(strongest_passages(_word_value(by_word), np.array([0, len(by_word)]))[0])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(x, pa.float64())], ["row", "x"])

    return spread.mapInArrow(measure, "row long, x double")


def add_evidence(docs: DataFrame, model, column: str) -> DataFrame:
    """All columns of docs, and column: the evidence of text. model is a broadcast KneserNey, or the table of one."""
    if not isinstance(model, DataFrame):
        return add_column(docs, column, "double", lambda batch: pa.array(model.value.evidence(batch.column("text"))))
    row, mine = free_name(docs, "_row"), free_name(docs, "_id")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "toxicity-rows")  # written, so that numbers stay
    found = table_evidence(rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), model).withColumnsRenamed({"row": mine, "x": column})
    return rows.join(found, F.col(row) == F.col(mine), "left").withColumn(column, F.coalesce(column, F.lit(0.0))).drop(row, mine)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, most_grams: int = MOST_GRAMS):
    """The model (broadcast, or beyond most_grams as a table), slope and intercept, from rows whose crc32(doc_id) mod 4 is not 2.

    The model has the grams of labelled texts, so it doesn't grow with the
    corpus. The curve is fitted on rows of remainder 3, its classes weighted
    back to their shares among all labels; all other rows are counted.
    """
    shares = dict(
        labels.where("toxic in (0, 1)").where(split_of(F.col("doc_id")) != 2).groupBy(F.col("toxic").cast("int").alias("t")).count().collect()
    )
    counted, curve = training_rows(labels, max_docs)
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    classed = one_of_each(texts, materialize(counted, "toxicity-labels"))
    grams = materialize(count_grams(classed.union(texts.select(F.lit(None).cast("int").alias("toxic"), "text"))), "toxicity-grams")
    ratios = log_ratios(grams)
    if grams.where("toxic + ordinary > 0").count() > most_grams:
        model = materialize(ratios, "toxicity-model")
    else:
        model = docs.sparkSession.sparkContext.broadcast(KneserNey(ratios.toArrow()))
        give_back()
    told = add_evidence(texts.join(F.broadcast(curve), "doc_id"), model, "x")
    rows = told.groupBy("doc_id", "toxic").agg(F.avg("x").alias("x")).select("toxic", "x").toArrow()  # a row for each id of the sample
    x, y = (rows.column(c).to_numpy().astype(float) for c in ("x", "toxic"))
    slope, intercept = fit_logistic(x, y)
    if 0 < y.sum() < len(y):
        intercept += np.log(max(shares.get(1, 0), 1) / max(shares.get(0, 0), 1)) - np.log(y.sum() / (len(y) - y.sum()))
    return model, slope, float(intercept)


def add_score(docs: DataFrame, labels: DataFrame, column: str, max_docs: int = 3000, most_grams: int = MOST_GRAMS) -> DataFrame:
    """All columns of docs, and column: struct(score, evidence)."""
    model, slope, intercept = fit(docs, labels, max_docs, most_grams)
    if isinstance(model, DataFrame):
        x = free_name(docs, "_x")
        score = 1 / (1 + F.exp(-(F.col(x) * slope + intercept)))
        return add_evidence(docs, model, x).withColumn(column, F.struct(score.alias("score"), F.col(x).alias("evidence"))).drop(x)

    def measure(batch: pa.RecordBatch) -> pa.Array:
        x = model.value.evidence(batch.column("text"))
        score = 1 / (1 + np.exp(-(x * slope + intercept)))
        return pa.StructArray.from_arrays([pa.array(score), pa.array(x)], ["score", "evidence"])

    return add_column(docs, column, "struct<score:double,evidence:double>", measure)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, threshold: float = 0.3, most_grams: int = MOST_GRAMS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of docs(doc_id, text).

    Null and empty texts have evidence 0. A null doc_id is scored and not held
    out. Repeated rows are scored each. Without labels of both classes every
    score is the share of toxic ones among them, 0 (to 1e-6) without any, so
    that nothing is predicted toxic. Other columns are ignored.
    """
    scored = add_score(docs.select("doc_id", "text"), labels, "_t", max_docs, most_grams)
    return scored.select(
        "doc_id", F.coalesce(split_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "_t.score",
        (F.col("_t.score") >= threshold).cast("int").alias("predicted"), "_t.evidence",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    name = free_name(docs, "_t")
    return add_score(docs, labels, name, max_docs).where(F.col(f"{name}.score") < threshold).drop(name)
