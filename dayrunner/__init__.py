"""dayrunner: transit-schedule analytics as plain Spark DataFrame jobs."""

from dayrunner.feed import Feed

__all__ = ["Feed"]
