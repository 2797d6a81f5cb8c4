"""Queries and oracle SQL of all operators of this subpackage."""

from __future__ import annotations

from . import chat, jaccard, langid, licences, pieces, quality, rules, secretscan, suffixes, tiling

MODULES = (langid, tiling, chat, quality, secretscan, pieces, suffixes, rules, jaccard, licences)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
