"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dialogue, interpolation, langid, mixing, mtree, packing, pii, quality, secret_scan, simhash, suffixes
from . import whitening, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_language_id": langid.op10_language_id,
    "op1_packing": packing.op1_packing,
    "op2_deleted_interpolation": interpolation.op2_deleted_interpolation,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_mtree_search": mtree.op6_mtree_search,
    "op7_pii_pseudonyms": pii.op7_pii_pseudonyms,
    "op9_html_extraction": wrappers.op9_html_extraction,
    "op8_quality_rules": quality.op8_quality_rules,
    "op11_suffix_arrays": suffixes.op11_suffix_arrays,
    "op12_whitening": whitening.op12_whitening,
    "op13_conversation_repair": dialogue.op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op6_mtree_search": mtree.SQL,
    "op8_quality_rules": quality.SQL,
    "op11_suffix_arrays": suffixes.SQL,
    "op13_conversation_repair": dialogue.SQL,
}
