"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import files, genes, likelihood, model, samples, signals

_MODULES = (signals, samples, genes, model, likelihood, files)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
