"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, jaccard, linededup, media, quality, ranking, recurrent, repair, suffixdedup, tokenfiles, vantage

OPERATORS = [suffixdedup.op1_suffix_dedup, tokenfiles.op2_training_order, linededup.op3_line_dedup, bpe.op4_byte_bpe, quality.op5_quality_classifier, decontaminate.op6_decontamination, recurrent.op7_lm_scoring, jaccard.op8_ngram_jaccard_join, jaccard.op8_link_counts, media.op9_media_columns, tokenfiles.op10_token_counts, ranking.op11_lexical_search, vantage.op12_vantage_search, repair.op13_structure_repair]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": linededup.OP3_SQL, "op6_decontamination": decontaminate.OP6_SQL, "op11_lexical_search": ranking.OP11_SQL, "op13_structure_repair": repair.OP13_SQL}
