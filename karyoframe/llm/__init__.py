"""Operations of training-data pipelines; nothing else in the library imports this subpackage."""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
