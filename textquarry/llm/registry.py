"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import ORACLE_SQL, run
from textquarry.llm.bpe import op3_bpe_roundtrip
from textquarry.llm.cotraining import op2_cotraining_quality
from textquarry.llm.fim import SQL as FIM_SQL
from textquarry.llm.fim import op11_rope_fill_in_middle
from textquarry.llm.hard_negatives import SQL as NEGATIVES_SQL
from textquarry.llm.hard_negatives import op13_product_quantised_negatives
from textquarry.llm.langid import op7_language_id
from textquarry.llm.licenses import op5_license_scan
from textquarry.llm.media import op4_interleaved_media
from textquarry.llm.neardup import op8_dart_minhash_dedup
from textquarry.llm.packing import op9_best_fit_packing
from textquarry.llm.simhash import op12_covering_simhash
from textquarry.llm.spotsigs import op1_spotsigs_fingerprints
from textquarry.llm.token_shards import op6_token_index
from textquarry.llm.toxicity import op10_toxicity_grammar


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_spotsigs_fingerprints,
        op2_cotraining_quality,
        op3_bpe_roundtrip,
        op4_interleaved_media,
        op5_license_scan,
        op6_token_index,
        op7_language_id,
        op8_dart_minhash_dedup,
        op9_best_fit_packing,
        op10_toxicity_grammar,
        op11_rope_fill_in_middle,
        op12_covering_simhash,
        op13_product_quantised_negatives,
    )
    return {f.__name__: f for f in ops} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    sql = {op11_rope_fill_in_middle.__name__: FIM_SQL, op13_product_quantised_negatives.__name__: NEGATIVES_SQL}
    return sql | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
