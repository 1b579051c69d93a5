"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann_search, bpe_codec, exact_dedup, lexical_search, packing, quality, sharding, simhash, spelling, substring_dedup, token_counts, topk_search, url_filter
from .common import table
from .tokens import default_path


def op1_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", sharding.shard_names(), sharding.SLOTS).select("doc_id", "slot", "shard")


def op5_bpe_codec(spark, sf_dir):
    return bpe_codec.digests(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), default_path("byte_bpe_50k.tiktoken"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.cut_repeats(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), default_path("byte_bpe_50k.tiktoken"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ann_search(spark, sf_dir):
    return ann_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_topk_search, op2_exact_dedup, op3_quality, op4_sharding, op5_bpe_codec, op6_url_filter, op7_simhash, op8_packing, op9_substring_dedup, op10_token_counts, op11_lexical_search, op12_ann_search, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk_search.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE, "op4_sharding": sharding.ORACLE, "op11_lexical_search": lexical_search.ORACLE}
