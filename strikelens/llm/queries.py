"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelens.llm import (
    centroids, licenses, mixing, perplexity, pii, prefix_trie, sampling, simhash, substrings, token_codec, topk, toxicity, warc,
)
from strikelens.llm.common import shared_folder

#: How often a source may be repeated, for the query and for the pipeline.
REPEAT, PIPELINE_REPEAT = 4.0, 2.0
BLOCK_TOKENS = 200_000
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    """Low quality, then kinds of toxic documents, by groups of words found in the labelled rows,
    then toxic at all; the last one decides."""
    bad = F.col("toxic") == 1
    kinds = [(f"kind_{k}", bad & toxicity.holds_any(words)) for k, words in enumerate(toxicity.word_groups(docs, labels), 1)]
    links = (("low_quality", F.col("quality") == 0), *kinds, ("toxic", bad))
    return toxicity.fit_on(docs, labels, links, chosen_by=("low_quality", "toxic"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.fit_on(docs))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "corpus")
    token_codec.write_corpus(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_codec.read_corpus(spark, path, with_ids=False)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repeat=REPEAT, block_tokens=BLOCK_TOKENS)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return found.withColumnRenamed("kept", "kept_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sampling.sample_encodings(table(spark, sf_dir, "documents"), model, keep_ids=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).drop("text", "lang", "source", "n_chars")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_token_files, op3_licenses, op4_simhash, op5_mixing, op6_substrings, op7_quality, op8_topk,
        op9_sampling, op10_toxicity, op11_prefix_trie, op12_warc, op13_centroids,
    )
}
