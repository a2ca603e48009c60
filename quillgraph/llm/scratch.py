"""Shared scratch tables; see ``quillgraph.shared``."""

from __future__ import annotations

from ..shared import fresh_dir, shared_dir, written

__all__ = ["fresh_dir", "shared_dir", "written"]
