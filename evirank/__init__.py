"""evirank: evidence-to-concept retrieval, fusion and evaluation as Spark jobs."""

from evirank.domain import DomainConfig

__all__ = ["DomainConfig"]
