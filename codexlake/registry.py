"""Every query of the library's own operators, with its SQL."""

from codexlake.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
