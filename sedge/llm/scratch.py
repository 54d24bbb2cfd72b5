"""Intermediate tables in the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from sedge.session import materialized, scratch_path

__all__ = ["materialized", "scratch_path"]
