"""Documents to packed training sequences; the stages themselves are in ``plateworks.llm.pipeline``."""

from plateworks.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
