"""Named queries and the SQL that they are checked against."""

from tallyspan.plans import answer_queries, core_problems, evaluation_queries, observation_queries, question_queries, retrieval_queries

MODULES = (core_problems, observation_queries, retrieval_queries, evaluation_queries, answer_queries, question_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
