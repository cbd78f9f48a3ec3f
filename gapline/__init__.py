"""gapline: episode, window and label operators for irregular event timelines on Spark."""

__version__ = "0.1.0"
