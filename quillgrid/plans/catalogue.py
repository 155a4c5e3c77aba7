"""All named queries and their SQL."""

from __future__ import annotations

from quillgrid.plans import cascade_queries, evaluation_queries, learning_queries, match_queries, names_queries, notation_queries, report_queries, review_queries, similarity_queries, stream_queries, summary_queries, workbook_queries  # noqa: F401  they register themselves
from quillgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
