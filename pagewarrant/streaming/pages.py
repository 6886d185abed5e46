"""Micro-batches of pages, and audit rules by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import ground, pages
from ..sources import dom

_RULES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_rule(name: str, rule: Callable[[DataFrame], DataFrame]) -> None:
    """Name a rule: a table in, violations (doc_id, rule_id, evidence) out."""
    _RULES[name] = rule


def run_rules(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Violations of the named rules, or all."""
    out = None
    for name in names if names is not None else sorted(_RULES):
        found = _RULES[name](table).select("doc_id", "rule_id", "evidence")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no rule is registered")
    return out


def ground_batch(claims: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over new pages (page_id, url, html): writes the claims of those pages with their verdicts.

    A batch that is tried again replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = claims.join(batch.select("page_id"), "page_id", "left_semi")
        ground.ground_text(own, pages.segments(dom.explode_dom(batch))).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
