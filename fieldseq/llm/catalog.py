"""All registered queries of this package. Importing the modules fills the registry."""

from fieldseq.llm import (archives, centroids, decontaminate, divergence, exact_dedup, language,  # noqa: F401
                          mixing, ngram_join, ngram_lm, quality_crf, secrets, url_filter, vector_join)
from fieldseq.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
