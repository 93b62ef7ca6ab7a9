"""All registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from tidemark.plans import answers, feeds, oracle, queries

QUERIES = queries.QUERIES | feeds.FEED_QUERIES | answers.ANSWER_QUERIES
SQL = oracle.SQL | feeds.FEED_SQL | answers.ANSWER_SQL
