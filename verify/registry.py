"""All registered queries."""

from verify import answer_queries, chain_queries, corpus_queries, dictionary_queries, function_queries, match_queries, score_queries, stat_queries, text_queries  # noqa: F401
from verify.base import ORACLES, QUERIES  # noqa: F401
