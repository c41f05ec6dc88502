"""Media-catalogue analytics on PySpark: fact graphs, hybrid vector search, work lists, curation."""

from catalograph.session import build_session

__all__ = ["build_session"]
