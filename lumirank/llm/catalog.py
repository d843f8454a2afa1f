"""All registered queries of the subpackage."""

import corpus_pipeline
from lumirank.llm.queries import QUERIES as _OPERATORS, SQL

QUERIES = {**_OPERATORS, "pipeline": corpus_pipeline.run}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["QUERIES", "SQL"]
