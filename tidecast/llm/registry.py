"""What the driver contract adds: the operators' queries, the pipeline, and SQL."""

import corpus_pipeline
from tidecast.llm.oracle import ORACLE as OPERATORS_SQL
from tidecast.llm.queries import QUERIES as OPERATORS

QUERIES = {**OPERATORS, "pipeline": corpus_pipeline.run}
ORACLE = dict(OPERATORS_SQL)

__all__ = ["ORACLE", "QUERIES"]
