"""Caption and vector data preparation as Spark DataFrame jobs."""

from captionloom.session import build_session

__all__ = ["build_session"]
