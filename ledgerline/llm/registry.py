"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kneser_ney, minhash, packing, page_diff, pii_spans, quality_ledger, secret_spans, set_join, spaced_seeds, spelling_groups, suffix_dedup, token_alignment, url_lists


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_page_diff": page_diff.op1_page_diff,
        "op2_kneser_ney": kneser_ney.op2_kneser_ney,
        "op3_quality_ledger": quality_ledger.op3_quality_ledger,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_spaced_seeds": spaced_seeds.op5_spaced_seeds,
        "op6_secret_spans": secret_spans.op6_secret_spans,
        "op7_url_lists": url_lists.op7_url_lists,
        "op8_set_join": set_join.op8_set_join,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_pii_spans": pii_spans.op10_pii_spans,
        "op11_spelling_groups": spelling_groups.op11_spelling_groups,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_minhash": minhash.op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_ledger": quality_ledger.ORACLE, "op7_url_lists": url_lists.ORACLE, "op8_set_join": set_join.ORACLE, "op10_pii_spans": pii_spans.ORACLE, "op13_minhash": minhash.ORACLE}
