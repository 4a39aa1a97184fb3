"""Registered queries of the corpus operators and their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline.llm import decontaminate, licences, merkle, mixing, neighbours, packing, quality, secrets, simhash, substrings, toxicity, trie, warc
from boxline.llm.common import table


def op1_licence_scan(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents"), threshold=0.8)


def op2_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), least=1000)


def tokenizer_path() -> str:
    """Place of the public byte-level vocabulary that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op4_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op5_suffix_array_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_first=False, least=200)


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op7_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def op9_secret_scan(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op11_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


def op12_prefix_trie(spark, sf_dir):
    return trie.build(table(spark, sf_dir, "conversations"), heads=6, span=100)


def op13_merkle_manifest(spark, sf_dir):
    without_breaks = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), changed={"text": without_breaks})


QUERIES = {
    "op1_licence_scan": op1_licence_scan,
    "op2_warc": op2_warc,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_source_mixing": op11_source_mixing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op1_licence_scan": licences.oracle(),
    "op2_warc": warc.ORACLE,
    "op8_benchmark_decontamination": decontaminate.oracle(),
    "op9_secret_scan": secrets.oracle(),
    "op12_prefix_trie": trie.oracle(),
    "op13_merkle_manifest": merkle.oracle(),
}
