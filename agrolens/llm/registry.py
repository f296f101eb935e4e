"""All queries of the subpackage, by name."""

from agrolens.llm import best_fit, bpe, centroid_tree, chat_format, decontaminate, license_scan, line_dedup, maxent_lm, periodic_runs, quality_rules, secret_scan, simhash, suffix_dedup  # noqa: F401
from agrolens.llm.common import QUERIES

__all__ = ["QUERIES"]
