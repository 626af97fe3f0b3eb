"""The folder that driver and executors share, and tables written there (see plans.shared)."""

from ..plans.shared import drop, folder, kept

__all__ = ["drop", "folder", "kept"]
