"""heddle: retrieval over document corpora and analytics over tables, on Spark."""

from heddle.session import get_session, ship

__all__ = ["get_session", "ship"]
