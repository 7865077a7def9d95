"""The opN_ queries and their SQL; each is a thin use of one operator of this subpackage."""

from __future__ import annotations

from astrel.llm import _spark as S
from astrel.llm import decontamination, exact_dedup, html_text, mixing, ngram_join, pii, substring_dedup, token_counts, toxicity, url_filter


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(S.table(spark, sf_dir, "documents"))


def op1_mixing(spark, sf_dir):
    return mixing.mix(S.table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(S.table(spark, sf_dir, "documents")).drop("text_key", "group_id")


def tokenizer_path(name="byte_bpe_50k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(S.table(spark, sf_dir, "documents"), tokenizer_path())


def op3_html_text(spark, sf_dir):
    return html_text.html_text(S.table(spark, sf_dir, "pages"))


def op4_pii(spark, sf_dir):
    return pii.find_pii(S.table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontamination.decontaminate(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_url_filter(spark, sf_dir):
    return url_filter.url_filter(S.table(spark, sf_dir, "pages"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(S.table(spark, sf_dir, "documents")).drop("kept_text")


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    return {"op1_mixing": mixing.oracle(), "op2_ngram_join": ngram_join.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
