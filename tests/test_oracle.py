"""Registered queries against their check SQL on the smallest tables."""

import os

import pytest

import check
from kgraph.plans.registry import REGISTRY

FOLDER = "/root/testdata/sf0.001"
PICKED = [
    "rank_courses", "thin_coverage", "declared_pairs_between", "readiness_batch", "overlap_batch", "unlock",
    "prereq_prior", "dependency_candidates", "dependency_blocks", "similarity_profile", "strong_components",
    "topk_cosine", "rerank", "select_units", "split_sizes", "prf_bands", "prf_by_area", "ablation",
    "alignment_precision", "course_pages", "prereq_grammar", "syllabus_pages", "payload_coercion", "upsert_latest",
    "fingerprint_counts", "guard_patterns",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, db, name):
    assert check.compare(db, spark, FOLDER, name) is None


def test_all_names_are_plain():
    assert all(name.isidentifier() for name in REGISTRY)
    assert set(PICKED) <= set(REGISTRY)
