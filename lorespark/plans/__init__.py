"""Registered queries over the driver tables, with their SQL."""

from . import notes, python, replies, rollups, scalars, timeline
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "notes", "python", "replies", "rollups", "scalars", "timeline"]
