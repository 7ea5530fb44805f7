from .catalog import QUERIES
from .oracle import ORACLE

__all__ = ["QUERIES", "ORACLE"]
