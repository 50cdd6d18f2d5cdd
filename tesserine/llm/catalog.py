"""Imports every module of this subpackage that registers a query."""

from __future__ import annotations

from tesserine.llm import (  # noqa: F401
    chat, decontamination, fill_in_middle, html_text, line_dedup, near_duplicates, packing, quality, secrets, sharding, toxicity, vector_codes, warc,
)
from tesserine.llm.common import ORACLES, QUERIES
from tesserine.llm.sql import SQL

ORACLES.update(SQL)

__all__ = ["ORACLES", "QUERIES"]
