"""Named queries of the operators over whole tables, with SQL counterparts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    credentials, html_ttr, language_ppm, line_frequency, masked_lm, nbest, norm_topk, positional,
    prefix_trie, pu_quality, simhash_golay, structure_repair, warc_zip)
from .common import fold, settled, table
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(settled(spark), sf_dir)
    return fn


@query
def op1_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4)
    model = language_ppm.fit(docs, part != 2)
    return language_ppm.identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    found = warc_zip.round_trip(pages, spark)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast(kind).alias("refers_to"))


@query
def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, net, coded = masked_lm.fit(table(spark, sf_dir, "documents"))
    return masked_lm.score(coded, net).drop("thash")


@query
def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality(table(spark, sf_dir, "documents")).drop("thash")


@query
def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nbest.encode(table(spark, sf_dir, "documents"), with_ids=False)
    return found.select("doc_id", "n_pieces", "ids_sha256", "scores", "edits", "round_trip")


@query
def op6_html_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_ttr.extract(table(spark, sf_dir, "pages"))


@query
def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents")).drop("thash")


@query
def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query
def op9_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scanned(table(spark, sf_dir, "documents")).drop("thash")


@query
def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = pu_quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return pu_quality.score(docs, net).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return prefix_trie.trie(*prefix_trie.branched(turns, heads, F.col("conv") - F.col("conv") % 5, 8))


@query
def op12_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = norm_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "rank", "vec_id", "score")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults, by a hash of conversation and turn."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv", "", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    turns = turns.withColumn("kind", kind).filter("kind <> 0")
    turns = turns.withColumn("o_copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return turns.withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))}).drop("kind")


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    made = structure_repair.repair(structure_repair.in_order(rows, change=damaged))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = {"audit": "", "repaired_sha256": structure_repair.EMPTY_SHA}
    return every.join(made, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in made.columns if c != "conv"))


def oracles() -> dict[str, str]:
    return dict(ORACLES)
