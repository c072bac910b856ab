"""The graph of relations: staging, intermediate and mart models over the source tables."""

from . import intermediate, marts, staging  # noqa: F401  they register their models
from .registry import MODELS, Graph, Model

__all__ = ["MODELS", "Graph", "Model"]
