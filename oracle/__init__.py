"""Independent SQL for the checks: each answer is derived from the base tables by CTEs."""

from oracle.build import sql

__all__ = ["sql"]
