"""All queries of the library: importing this module registers them."""

from . import corpus_queries, correlation_queries, diagnostic_queries, extra_queries, forensic_queries, fusion_queries, graph_queries, mail_queries, metric_queries, text_queries  # noqa: F401
from .registry import REGISTRY  # noqa: F401
