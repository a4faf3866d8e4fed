"""Spark-native positional, weighted full-text retrieval.

    from spindex import Engine, parse
    engine = Engine(spark, "hdfs:///index")
    engine.add_documents(docs, text_col="text")
    engine.flush()
    top = engine.query_top('spark AND "full text"', 20)

Queries are trees of Kw, And, Or, Not, Exact and Approx nodes; a result is an
ordinary DataFrame of documents and relevances.
"""

from spindex.engine import Engine
from spindex.plans.nodes import And, Approx, Exact, Kw, Node, Not, Or
from spindex.plans.parser import parse

__all__ = ["And", "Approx", "Engine", "Exact", "Kw", "Node", "Not", "Or", "parse"]
