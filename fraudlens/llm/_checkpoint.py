"""The library's helpers for cutting lineage, under the names the operators use."""

from ..lineage import checkpoint, checkpoint_dir, release, scratch, stored

__all__ = ["checkpoint", "checkpoint_dir", "release", "scratch", "stored"]
