"""Indexed streams over Spark DataFrames."""

from .operators import Collector, Ordered, Statistics, Stream, Unordered, Windowed
from .operators.ordered import value

__all__ = ["Collector", "Ordered", "Statistics", "Stream", "Unordered", "Windowed", "value"]
