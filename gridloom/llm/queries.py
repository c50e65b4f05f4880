"""Queries that apply the operators of this subpackage to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, hnsw, licenses, minhash, mixing, packing, repetition, segment, tokenfiles, toxicity, trie, urlrules

def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file, the same on all executors: in folder, or where its package has it."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"{folder}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge_repeats(repetition.measure_repeats(table(spark, sf_dir, "documents")))
    return judged.drop("spans", "n_maximal")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    thousands, hundreds = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100)
    path = F.concat_ws("/", "source", thousands.cast("string"), hundreds.cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.link_embeddings(table(spark, sf_dir, "embeddings"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, bad: the number in a page's path is the doc_id of its article, which labels judges."""
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract(F.coalesce("url", F.lit("")), "/([0-9]+)", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.join(labels, "doc_id").select("url", "bad")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), labelled_pages(spark, sf_dir))


def llm_listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7's fixed list says of every page."""
    return urlrules.listed_urls(table(spark, sf_dir, "pages"))


def op8_gumbel_segments(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return segment.digest(segment.sample_segmentations(docs, tokenizer_file("piece_bpe_32k.model", folder), k=2, with_ids=False))


def op9_token_files(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json", folder))


def llm_token_order(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Documents in the order in which op9's files hold them, by their places alone."""
    rows = op9_token_files(spark, sf_dir, folder)
    before = rows.select(F.col("start").alias("s"), F.col("n_tokens").alias("n"))
    follows = rows.join(before, F.col("start") == F.col("s") + F.col("n"), "left")
    return follows.select("doc_id", (F.col("start") == 0).alias("is_first"), (F.col("s").isNotNull() | (F.col("start") == 0)).alias("follows_another"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.read_conversations(chat.format_conversations(turns)))


def op11_harmonic_packing(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json", folder)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.share_beginnings(trie.number_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_repetition": op2_repetition,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_gumbel_segments": op8_gumbel_segments,
    "op9_token_files": op9_token_files,
    "op10_chat_format": op10_chat_format,
    "op11_harmonic_packing": op11_harmonic_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_trie": op13_conversation_trie,
    "llm_listed_urls": llm_listed_urls,
    "llm_token_order": llm_token_order,
}
ORACLES = {
    "op1_minhash_dedup": minhash.ORACLE,
    "op2_repetition": repetition.ORACLE,
    "op3_license_scan": licenses.oracle(),
    "op4_embedding_dedup": hnsw.ORACLE,
    "op5_source_mix": mixing.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_conversation_trie": trie.ORACLE,
    "llm_listed_urls": urlrules.list_oracle(),
    "llm_token_order": "SELECT doc_id, doc_id = (SELECT min(doc_id) FROM documents) AS is_first, true AS follows_another FROM documents",
}
