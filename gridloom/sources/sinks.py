"""Sinks: partitioned Parquet, JSON lines, token shards, Markdown, manifests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 5_000_000) -> None:
    """One directory per key; rows of a key go to few files without gathering a large key in one task."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).parquet(path)


def write_lines(df: DataFrame, folder: str, header: str = "") -> int:
    """Writes lines(name, line) as a text file per name in one folder of their own and returns how many there are.

    A file is made in the one task that has all its lines, sorted by themselves,
    and gets its name when it is whole. Spark's own writer makes a folder for
    each and moves them twice. Names are dealt to a fixed number of tasks, as
    a file costs far more than its lines.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out = name = own = None
        files = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0)
            turns = pc.indices_nonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1))).to_pylist()
            bounds = [0, *[t + 1 for t in turns], len(names)]
            for low, high in zip(bounds, bounds[1:], strict=False):
                if (told := names[low].as_py()) != name:
                    if out is not None:
                        out.close()
                        fs.move(own, f"{root}/{name}")
                    else:
                        fs.create_dir(root)
                    name, own, files = told, f"{root}/_{uuid.uuid4().hex}", files + 1
                    out = fs.open_output_stream(own)
                    out.write(header.encode())
                out.write(("\n".join(batch.column(1).slice(low, high - low).to_pylist()) + "\n").encode())
        if out is not None:
            out.close()
            fs.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("name", "line").where("name is not null and line is not null").repartition(tasks, "name").sortWithinPartitions("name", "line")
    return dealt.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def write_json_lines(df: DataFrame, path: str) -> int:
    """Writes, and returns the number of records, counted as they pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_token_shards(df: DataFrame, path: str) -> None:
    """Rows (source, split, step_no, tokens) in stream order, a directory per source and split."""
    df.repartitionByRange("source", "split", "step_no").sortWithinPartitions("source", "split", "step_no").write.mode("overwrite").partitionBy("source", "split").parquet(path)


def markdown(rows: list, columns: list[str]) -> str:
    """A Markdown table of a report's few rows."""
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line(r[c] for c in columns) for r in rows]])


def download_plan(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """key, action of wanted rows that are not held(key, verified) verified: fetch what was never held, again what failed."""
    rows = wanted.join(held, key, "left").where("verified is null or not verified")
    return rows.select(key, F.when(F.col("verified").isNull(), "fetch").otherwise("again").alias("action"))


def upsert(manifest: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """manifest with records put in by key: a record replaces the row of its key, others stay."""
    return manifest.join(records.select(key), key, "left_anti").unionByName(records)


def all_verified(manifest: DataFrame, flag: str = "verified") -> bool:
    """Whether every row is; a manifest without rows isn't."""
    row = manifest.agg(F.bool_and(F.coalesce(flag, F.lit(False))).alias("ok")).first()
    return bool(row["ok"])


def assemble(staged: dict[str, DataFrame], name: str, path: str, key: str = "file") -> int:
    """Writes the union of staged sources as JSON lines in the order of source and file, and returns the number of records."""
    whole = None
    for source, df in sorted(staged.items()):
        some = df.withColumn("source", F.lit(source))
        whole = some if whole is None else whole.unionByName(some, allowMissingColumns=True)
    return write_json_lines(whole.repartitionByRange("source", key).sortWithinPartitions("source", key), f"{path}/{name}")


def write_scores(scores: DataFrame, path: str) -> None:
    """Scored windows (set, end, logit, label), sorted inside their set's files."""
    scores.select("set", "end", "logit", "label").repartition("set").sortWithinPartitions("set", "end").write.mode("overwrite").parquet(path)


def write_trace(trace: DataFrame, path: str, decimals: dict[str, int]) -> None:
    """A trace as CSV with fixed decimals; missing values are blank."""
    columns = [F.format_number(F.col(c), decimals[c]).alias(c) if c in decimals else F.col(c).cast("string").alias(c) for c in trace.columns]
    plain = [F.replace(c, F.lit(","), F.lit("")).alias(n) for c, n in zip(columns, trace.columns, strict=True)]
    trace.select(*plain).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_trace(spark, path: str, schema: str) -> DataFrame:
    """A written trace with typed columns; blanks are null."""
    return spark.read.option("header", True).schema(schema).csv(path)


MARKER = "COMMITTED"


def _content(df: DataFrame) -> str:
    """Rows and an order-free digest of them."""
    hashed = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    row = df.agg(F.count("*"), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(hashed)).first()
    return f"{row[0]}:{row[1]}:{row[2]}"


def write_once(df: DataFrame, path: str) -> bool:
    """Writes a table that is never changed again; False if it was there with the same rows, an error if with others.

    Rows go to a folder of their own, whose name and digest a marker file
    commits. The marker comes into being whole and at most once: by a hard link
    on a local file system, elsewhere by a rename, which Hadoop's file systems
    refuse where the target exists (an object store needs a file system that
    does so too). Of writers at the same time one commits; the others compare.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = f"rows-{uuid.uuid4().hex}"
    own = f"{path.rstrip('/')}/{name}"
    df.write.parquet(own)
    told = f"{name} {_content(spark.read.parquet(own))}"
    new_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = new_path(path).getFileSystem(conf)
    draft, marker = new_path(f"{own}/_marker"), new_path(f"{path.rstrip('/')}/{MARKER}")
    out = fs.create(draft)
    out.write(told.encode())
    out.close()
    if fs.getUri().getScheme() == "file":
        place = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI(f"file://{p.toUri().getPath()}"))
        try:
            jvm.java.nio.file.Files.createLink(place(marker), place(draft))
            committed = True
        except Exception as refused:
            if "FileAlreadyExists" not in str(refused):
                raise
            committed = False
    else:
        committed = not fs.exists(marker) and fs.rename(draft, marker)
    if committed:
        return True
    held = committed_marker(spark, path)
    fs.delete(new_path(own), True)
    if held.split(" ", 1)[1] != told.split(" ", 1)[1]:
        raise ValueError(f"{path} is committed with other rows")
    return False


def committed_marker(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(f"{path.rstrip('/')}/{MARKER}").collect()  # one line
    return rows[0]["value"]


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of a table of write_once(); an error if none are."""
    return spark.read.parquet(f"{path.rstrip('/')}/{committed_marker(spark, path).split(' ', 1)[0]}")
