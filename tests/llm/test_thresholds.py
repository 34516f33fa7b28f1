"""Thresholds and labels of op5 use every labelled document."""

from __future__ import annotations

import random

from sparkwell.llm import quality_rules as Q


def test_learned_threshold_equals_the_search_on_the_driver(spark):
    rng = random.Random(5)
    mixed = [(rng.randrange(-60, 60) + 25 * g, bool(g)) for g in (rng.randrange(2) for _ in range(400))]
    cases = [[(0, False), (1, True), (2, False), (20, True), (21, True)], [(3, True), (3, False)], [(5, True)], [(-9, False), (-4, True)], mixed]
    for scores in cases:
        assert Q.learned_threshold(spark.createDataFrame(scores, "score long, good boolean")) == Q.best_threshold(scores)


def test_no_labelled_document_is_left_out(spark):
    """The labels once stopped at about 50,000."""
    trusted, others = Q.labelled_ids(spark.range(120_000).selectExpr("id AS doc_id", "1 AS quality"))
    assert trusted.count() + others.count() == 120_000
