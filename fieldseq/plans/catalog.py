"""All registered queries. Importing the modules fills the registry."""

from fieldseq.plans import (audit_queries, evaluation_queries, ingest_queries, model_queries,  # noqa: F401
                            quality_queries,
                            result_queries, search_queries, text_queries,
                            translation_queries)
from fieldseq.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
