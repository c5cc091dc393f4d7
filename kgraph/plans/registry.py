"""All registered queries: name -> (query(spark, folder), check SQL or None)."""

from __future__ import annotations

from kgraph.plans import queries_advise, queries_align, queries_catalogue, queries_evaluate, queries_infer

REGISTRY = {
    **queries_advise.QUERIES,
    **queries_infer.QUERIES,
    **queries_align.QUERIES,
    **queries_evaluate.QUERIES,
    **queries_catalogue.QUERIES,
}
