"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from millweir.queries import checks, engine, transforms

QUERIES = {**checks.QUERIES, **transforms.QUERIES, **engine.QUERIES}
ORACLES = {**checks.ORACLES, **transforms.ORACLES, **engine.ORACLES}
flagship = transforms.QUERIES["flagship"]
