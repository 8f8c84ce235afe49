"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentrylake.llm import archives, classifier, fim, lm, merkle, minhash, mixing, packing, quality_rules, secrets, sharding, simhash, sketches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_lm_scores": lm.op3,
    "op4_archives": archives.op4,
    "op5_simhash": simhash.op5,
    "op6_fingerprints": sketches.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_quality_classifier": classifier.op8,
    "op9_secrets": secrets.op9,
    "op10_sharding": sharding.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_fill_in_middle": fim.op12,
    "op13_minhash": minhash.op13,
}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op4_archives": archives.OP4_SQL, "op10_sharding": sharding.op10_sql(), "op11_merkle_manifest": merkle.OP11_SQL, "op12_fill_in_middle": fim.OP12_SQL}
