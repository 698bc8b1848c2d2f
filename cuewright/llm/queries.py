"""The numbered operators as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import align, ann, fertility, fim, langid, licenses, merges, mixing, neardup, oracle, packing, quality, sharding, toxicity


def queries() -> dict:
    return {
        "op1_robust_graph_ann": ann.query,
        "op2_ftrl_toxicity": toxicity.query,
        "op3_fourier_quality": quality.query,
        "op4_rare_token_licenses": licenses.query,
        "op5_hypergeometric_shards": sharding.query,
        "op6_tokeniser_fertility": fertility.query,
        "op7_pfair_mixing": mixing.query,
        "op8_subword_language": langid.query,
        "op9_superminhash": neardup.query,
        "op10_best_fit_packing": packing.query,
        "op11_token_alignment": align.query,
        "op12_fill_in_middle": fim.query,
        "op13_sentencepiece": merges.query,
        "pipeline": pipeline,
    }


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
