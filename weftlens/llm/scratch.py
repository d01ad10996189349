"""Intermediate tables in the folder that the cluster shares, under the names the operators use."""

from weftlens.sources.shared import drop, folder, new_path, store

__all__ = ["drop", "folder", "new_path", "store"]
