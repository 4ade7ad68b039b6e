"""Cutting lineage through the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from auditloom.sources.shared import forget, new_path, shared_dir, stash, stash_at

__all__ = ["forget", "new_path", "shared_dir", "stash", "stash_at"]
