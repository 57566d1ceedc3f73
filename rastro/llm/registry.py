"""The queries of this package and, where SQL can say the same, their DuckDB texts."""

from __future__ import annotations

from rastro.llm import ann, bpe, chat, decontaminate, langid, licenses, linededup, neardup, quality, secrets, spelling, structure, urls

_MODULES = (secrets, chat, bpe, licenses, linededup, langid, quality, neardup, urls, decontaminate, ann, structure, spelling)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
