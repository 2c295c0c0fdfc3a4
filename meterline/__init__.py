"""Spark-native cost, usage and storage analytics for analytics-platform workspaces.

Every operator takes and returns DataFrames, handles all workspaces in one
plan, reads no clock (``as_of`` is a parameter) and never collects rows to the
driver.
"""

from meterline.config import EngineConfig

__all__ = ["EngineConfig"]
