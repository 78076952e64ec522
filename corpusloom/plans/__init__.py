"""The registered queries of the engine's operators and the SQL each is checked against."""

from __future__ import annotations

from . import arithmetic, cleaning, extraction, files, logs, masks, sampling, streams, tokenization

_MODULES = (cleaning, extraction, tokenization, masks, logs, sampling, arithmetic, streams, files)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
