"""Queries of the text problems 7 to 9 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootstock.llm import leakage, moderation, packing, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Problem 7


def _capacity(spark: SparkSession, sf: str, name: str) -> int:
    return table(spark, sf, "pack_size").where(F.col("pack_name") == name).first()["capacity_tokens"]


def _packed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(tokens.token_sizes(documents, "text"), "n_tokens", _capacity(spark, sf, name), n_items=documents.count())


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's pieces and their containers of medium capacity."""
    return _packed(spark, sf, "medium")


def p7_packed_short(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "short")


def p7_packed_long(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "long")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and share of used space at medium capacity."""
    return packing.fill_report(_packed(spark, sf, "medium"), _capacity(spark, sf, "medium"))


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity what must hold of every packing: all documents are in it, none in part or twice, none cut that needn't be, no container above its capacity."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    sizes, n, out = tokens.token_sizes(documents, "text"), documents.count(), []
    for name in ("short", "medium", "long"):
        capacity = _capacity(spark, sf, name)
        pieces = packing.pack(sizes, "n_tokens", capacity, n_items=n)
        whole = pieces.groupBy("doc_id").agg(F.first("n_tokens").alias("n"), F.sum("length").alias("held"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("first").alias("places"), F.max(F.col("container").isNull()).alias("none"))
        bad = (F.col("held") != F.col("n")) | (F.col("pieces") != F.col("places")) | (F.col("none") & (F.col("n") > 0))
        cut = (F.col("pieces") > 1) & (F.col("n") <= capacity)
        told = whole.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("none").alias("n_empty"), F.count_if(bad).alias("n_broken"), F.count_if(cut).alias("n_cut_in_vain"))
        full = pieces.where("container is not null").groupBy("container").agg(F.sum("length").alias("held")).agg(F.count_if(F.col("held") > capacity).alias("n_above"))
        out.append(told.withColumn("n_above", full.scalar()).select(F.lit(name).alias("pack_name"), "*"))
    return out[0].unionByName(out[1]).unionByName(out[2])


# Problem 8


def _leaked(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_item"), doc_id="doc_id", text="text", item="item_no", passage="passage")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Items and the documents that hold their passages."""
    return _leaked(spark, sf).select(F.col("item").alias("item_no"), "doc_id").distinct()


def p8_method(spark: SparkSession, sf: str) -> DataFrame:
    """Items and documents by the method's own threshold: tiles of three and more words, in whatever order, cover half of the passage."""
    found = leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_item"), doc_id="doc_id", text="text", item="item_no", passage="passage", coverage=0.5)
    return found.select(F.col("item").alias("item_no"), "doc_id").distinct()


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per benchmark and split: items, leaked items and documents that hold any."""
    found = _leaked(spark, sf).select("item", "doc_id").distinct()
    items = table(spark, sf, "eval_item").select("item_no", "benchmark", "split")
    joined = items.join(found, items["item_no"] == found["item"], "left")
    return joined.groupBy("benchmark", "split").agg(F.count_distinct("item_no").alias("n_items"), F.count_distinct("item").alias("n_leaked"), F.count_distinct("doc_id").alias("n_documents"))


# Problem 9


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document for abusive, hateful or explicit wording."""
    return moderation.moderated(table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "moderation_sample"), text="text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    return p9_scores(spark, sf).where("flagged").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates per source."""
    return moderation.rates(p9_scores(spark, sf), "source")


QUERIES = {
    "p7_packed": p7_packed,
    "p7_packed_short": p7_packed_short,
    "p7_packed_long": p7_packed_long,
    "p7_fill": p7_fill,
    "p7_audit": p7_audit,
    "p8_method": p8_method,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
ORACLES: dict[str, str] = {
    "p7_audit": "select pack_name, count(*) as n_documents, count(*) filter (coalesce(text, '') = '') as n_empty, cast(0 as bigint) as n_broken, cast(0 as bigint) as n_cut_in_vain, cast(0 as bigint) as n_above from documents cross join pack_size where pack_name in ('short', 'medium', 'long') group by pack_name",
}
