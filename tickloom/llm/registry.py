"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, line_dedup, lm_scoring, minhash, mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash, spelling_variants, suffix_dedup, url_filters, vector_codes


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_url_filters": url_filters.op9_url_filters,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_minhash_near_dedup": minhash.op11_minhash_near_dedup,
        "op12_spelling_variants": spelling_variants.op12_spelling_variants,
        "op13_vector_codes": vector_codes.op13_vector_codes,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict:
    return {
        "op3_source_mixing": mixing.ORACLE,
        "op6_quality_rules": quality_rules.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op9_url_filters": url_filters.ORACLE,
        "op11_minhash_near_dedup": minhash.ORACLE,
        "op12_spelling_variants": spelling_variants.ORACLE,
        "op13_vector_codes": vector_codes.ORACLE,
    }
