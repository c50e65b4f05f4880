"""Readers: commented CSV, archives, JSON lines, adapters by name."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sniff_csv(head: str, probe: int = 40) -> tuple[int, list[str] | None, str]:
    """Lines before the data's header, a header that is itself a comment (else null), and the delimiter."""
    lines = head.splitlines()[:probe]
    skip = 0
    while skip < len(lines) and lines[skip].startswith("#"):
        skip += 1
    commented = None
    sample = lines[skip] if skip < len(lines) else ""
    delimiter = max(",;\t", key=lambda d: (sample.count(d), d == ","))
    if skip:
        last = next(csv.reader([lines[skip - 1].lstrip("# ")], delimiter=delimiter))
        if len(last) > 1 and len(last) == len(next(csv.reader([sample], delimiter=delimiter))):
            commented = last
    return skip, commented, delimiter


def preamble(head: str) -> dict[str, str]:
    """'# key: value' lines with keys under 40 characters."""
    out = {}
    for line in head.splitlines():
        if not line.startswith("#"):
            break
        key, colon, value = line.lstrip("# ").partition(":")
        if colon and 0 < len(key.strip()) < 40:
            out[key.strip()] = value.strip()
    return out


def read_commented_csv(spark: SparkSession, path: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """All columns as text, or the wanted ones that exist. The head of one file gives the layout of all under path."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(41).collect())
    skip, commented, delimiter = sniff_csv(head)
    names = commented or next(csv.reader([head.splitlines()[skip]], delimiter=delimiter))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("sep", delimiter).option("comment", "#").option("mode", "PERMISSIVE")
    df = reader.option("header", commented is None).option("enforceSchema", True).csv(path)
    return df if wanted is None else df.select(*[f"`{c}`" for c in wanted if c in names])


def read_zip_members(spark: SparkSession, path: str, pattern: str = r"\.(csv|txt|tsv)$") -> DataFrame:
    """archive, member, content of the matching members of all archives under path; an archive is one task's work."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for member in archive.namelist():
                        if re.search(pattern, member):
                            yield pd.DataFrame({"archive": [name], "member": [member], "content": [archive.read(member)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def decode_bytes(content: Column) -> Column:
    """UTF-8 where valid, else Windows-1252."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "windows-1252"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, fields beyond the schema dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def file_inventory(spark: SparkSession, path: str, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """path, kind, size, sha256 of every file; the first pattern that its name matches gives the kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = None
    for pattern, label in kinds:
        kind = F.when(name.rlike(pattern), label) if kind is None else kind.when(name.rlike(pattern), label)
    return files.select("path", kind.otherwise("other").alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def map_channels(df: DataFrame, mapping: Mapping[str, str | None]) -> DataFrame:
    """Canonical columns from provider columns; unmapped or absent ones are null; bad numbers too."""
    there = {c.lower(): c for c in df.columns}
    pick = lambda p: F.col(f"`{there[p.lower()]}`").try_cast("double") if p and p.lower() in there else F.lit(None).cast("double")
    return df.withColumns({canonical: pick(provider) for canonical, provider in mapping.items()})


ADAPTERS: dict[str, Callable[..., DataFrame]] = {}


def adapter(name: str):
    """Registers a reader under a source's name."""

    def add(f):
        ADAPTERS[name] = f
        return f

    return add


@adapter("commented_csv")
def _commented(spark, path, **options):
    return read_commented_csv(spark, path, **options)


@adapter("json_lines")
def _json(spark, path, **options):
    return read_json_lines(spark, path, **options)


def robots_allow(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Longest matching rule decides, allow wins a tie, no match allows. rules: (allow or disallow, pattern with * and $)."""
    best = F.struct(F.lit(-1).alias("n"), F.lit(True).alias("ok"))
    for verdict, pattern in rules:
        text = "^" + "".join(".*" if c == "*" else "$" if c == "$" and k == len(pattern) - 1 else re.escape(c) for k, c in enumerate(pattern))
        found = F.when(path.rlike(text), F.struct(F.lit(len(pattern)).alias("n"), F.lit(verdict == "allow").alias("ok")))
        best = F.greatest(best, found)
    return best["ok"]
