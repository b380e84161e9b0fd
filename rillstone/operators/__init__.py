"""Streams, their materialisations and terminals."""

from .collectors import Collector
from .ordered import Ordered, Unordered
from .stats import Statistics
from .stream import Stream
from .windows import Windowed

__all__ = ["Collector", "Ordered", "Statistics", "Stream", "Unordered", "Windowed"]
