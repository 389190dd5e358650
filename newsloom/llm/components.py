"""Connected components, shared with the similarity of articles."""

from newsloom.operators.components import connected

__all__ = ["connected"]
