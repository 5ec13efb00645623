"""The queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.bpe_automaton import bpe_decode, bpe_encode
from cladeframe.llm.chat_format import mask_text, perspectives
from cladeframe.llm.decontamination import contamination
from cladeframe.llm.html_extract import extract
from cladeframe.llm.mixing import Mixture
from cladeframe.llm.prefix_trie import numbered_turns, prefix_trie, share_heads
from cladeframe.llm.quality import BASE, quality
from cladeframe.llm.secret_scan import digest, secret_spans
from cladeframe.llm.simhash import hex_fingerprint, near_duplicates
from cladeframe.llm.substring_dedup import substring_dedup
from cladeframe.llm.token_alignment import align
from cladeframe.llm.token_counts import EDITS, apply_edits, with_trees
from cladeframe.llm.url_filter import language_redirects, url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "perspective", "n_turns", "rendered", mask_text(F.col("masks")).alias("masks"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(c.alias(n) for n, c in digest(F.col("spans")).items()))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(_table(spark, sf_dir, "documents")).taken()


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_redirect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the pages with a table of redirects, so that classes decide."""
    pages = _table(spark, sf_dir, "pages")
    return url_verdicts(pages, redirects=language_redirects(pages)).select("page_id", "host", "path", "rule", "verdict")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every text: a deletion, an insertion and a replacement."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, removed, inserted: F.struct(F.floor(at).cast("int").alias("at"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(n / 5, 7, ""), edit(n / 2, 0, " amended, 42 "), edit(n * 9 / 10, 11, "x")).cast(EDITS)
    before = with_trees(docs).withColumn("n_tokens", F.col("tree.sums")[1].cast("long")).withColumn("edits", edits)
    after = apply_edits(before)
    return after.select("doc_id", "n_tokens", F.col("tree.sums")[1].cast("long").alias("n_tokens_edited"), "n_encoded", F.length("text").cast("long").alias("n_chars_edited"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*share_heads(numbered_turns(_table(spark, sf_dir, "conversations"))))


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, its ids decoded again."""
    ids = bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return bpe_decode(ids).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_secret_scans": op4_secret_scans,
    "op5_source_mixing": op5_source_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "url_redirect_classes": url_redirect_classes,
    "op8_token_counts": op8_token_counts,
    "op9_html_extraction": op9_html_extraction,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bpe_automaton": op13_bpe_automaton,
}
