"""All queries of this package, by name."""

from __future__ import annotations

from stockloom.llm import decontaminate, html_extract, line_dedup, packing, pii, resampling, secrets, simhash, topk, toxicity, url_filter, warc, whitening  # noqa: F401
from stockloom.llm.common import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
