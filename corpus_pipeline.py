"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL``; see ``sluice.llm.pipeline``."""

from sluice.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
