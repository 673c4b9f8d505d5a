"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, dedup, fingerprints, jaccard, knn, language, lm, mixing, packing, pii, records, resampling, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn": knn.op1_knn,
    "op2_pii": pii.op2_pii,
    "op3_suffix_dedup": dedup.op3_suffix_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_records": records.op5_records,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_language": language.op8_language,
    "op9_secrets": secrets.op9_secrets,
    "op10_packing": packing.op10_packing,
    "op11_resampling": resampling.op11_resampling,
    "op12_lm": lm.op12_lm,
    "op13_repair": conversations.op13_repair,
}
SQL: dict[str, str] = {"op1_knn": knn.SQL, "op4_mixing": mixing.SQL, "op11_resampling": resampling.SQL, "op13_repair": conversations.SQL}
