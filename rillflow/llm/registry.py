"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers

from rillflow.llm import decontaminate, near_dup, suffix_dedup, topk
from rillflow.llm.common import table
from rillflow.llm.lm import lm_scores
from rillflow.llm.packing import pack
from rillflow.llm.sharding import balanced_shards
from rillflow.llm.token_counts import token_counts
from rillflow.llm.toxicity import toxicity
from rillflow.llm.url_filter import url_filter


def op1_near_duplicates(spark, d):
    return near_dup.near_duplicates(table(spark, d, "documents"))


def op2_token_counts(spark, d):
    return token_counts(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_top_k(spark, d):
    return topk.top_k(table(spark, d, "embeddings"))


def op4_sharding(spark, d):
    return balanced_shards(table(spark, d, "documents"))


def op5_lm_scores(spark, d):
    return lm_scores(table(spark, d, "documents"))


def op6_url_filter(spark, d):
    return url_filter(table(spark, d, "pages"))


def op7_toxicity(spark, d):
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_decontamination(spark, d):
    return decontaminate.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_packing(spark, d):
    return pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_suffix_dedup(spark, d):
    return suffix_dedup.suffix_digests(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_token_counts, op3_top_k, op4_sharding, op5_lm_scores, op6_url_filter, op7_toxicity, op8_decontamination, op9_packing, op10_suffix_dedup)}
ORACLE_SQL = {"op1_near_duplicates": near_dup.SQL, "op3_top_k": topk.SQL, "op8_decontamination": decontaminate.SQL, "op10_suffix_dedup": suffix_dedup.SQL}
