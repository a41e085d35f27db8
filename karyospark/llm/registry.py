"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, divergence, exact_dedup, html_text, interactions, langid, licenses, quality_model, quality_rules, secrets, simhash, token_counts

MODULES = (simhash, quality_model, bpe, secrets, langid, licenses, token_counts, html_text, quality_rules, decontaminate, exact_dedup, interactions, divergence)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {k: f for m in MODULES for k, f in m.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
