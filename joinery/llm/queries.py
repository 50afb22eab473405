"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from joinery.llm import op01_pivots, op02_licenses, op03_langid, op04_bpe, op05_counts, op06_quality, op07_shards, op08_simhash, op09_packing, op10_urls, op11_exact, op12_sources, op13_resampling

_MODULES = (op01_pivots, op02_licenses, op03_langid, op04_bpe, op05_counts, op06_quality, op07_shards, op08_simhash, op09_packing, op10_urls, op11_exact, op12_sources, op13_resampling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _MODULES if getattr(m, "SQL", None)}
