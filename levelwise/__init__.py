"""Cohort statistics over wide tables, as Spark DataFrame operators."""

from levelwise.cohort import Cohort
from levelwise.levels import LevelBook
from levelwise.roles import RoleSchema

__all__ = ["Cohort", "LevelBook", "RoleSchema"]
