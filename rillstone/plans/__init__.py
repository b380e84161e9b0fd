"""Plan decisions made before a DataFrame is built, and actions side by side."""

from .index import Index, dense_index
from .jobs import Jobs

__all__ = ["Index", "Jobs", "dense_index"]
