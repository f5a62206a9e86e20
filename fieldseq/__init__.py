"""Event-sequence search and analytics on PySpark.

Functions here take DataFrames and column names and give DataFrames. Nothing is
executed until the caller writes or collects a result.
"""

from fieldseq.spec import DEFAULT_GRID, GridSpec

__all__ = ["DEFAULT_GRID", "GridSpec"]
