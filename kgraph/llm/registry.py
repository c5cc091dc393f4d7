"""The corpus operators' queries: name -> (query(spark, folder), check SQL or None)."""

from __future__ import annotations

from kgraph.llm import (
    bpe, decontaminate, hard_negatives, katz, language, licenses, merkle, near_dup, neighbours, quality, secrets, shard, url_filter,
)

QUERIES = {
    **bpe.QUERIES,
    **decontaminate.QUERIES,
    **hard_negatives.QUERIES,
    **katz.QUERIES,
    **language.QUERIES,
    **licenses.QUERIES,
    **merkle.QUERIES,
    **near_dup.QUERIES,
    **neighbours.QUERIES,
    **quality.QUERIES,
    **secrets.QUERIES,
    **shard.QUERIES,
    **url_filter.QUERIES,
}
