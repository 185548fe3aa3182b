"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from streakline.llm import (
    chat,
    decontamination,
    fill_middle,
    host_rules,
    language_id,
    packing,
    setsketch,
    substring_dedup,
    token_orc,
    toxicity,
    url_cascade,
    warc,
    whitening,
)

MODULES = (
    substring_dedup,
    host_rules,
    decontamination,
    token_orc,
    warc,
    setsketch,
    packing,
    toxicity,
    chat,
    url_cascade,
    language_id,
    fill_middle,
    whitening,
)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
