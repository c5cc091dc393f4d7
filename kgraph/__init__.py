"""kgraph: a two-layer knowledge graph over course catalogues, as Spark DataFrames.

Every operator takes and returns DataFrames. A request of one course, one
student or one query is a one-row table; the operators answer whole tables of
requests in one plan.
"""

__version__ = "0.1.0"
