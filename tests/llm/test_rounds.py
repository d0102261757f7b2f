"""What components and raking ask of Spark: rounds and jobs, which the driver keeps account of task by task."""

import numpy as np
import pytest

from quarry.llm import components as graph
from quarry.llm import mixing
from quarry.llm.common import materialize


@pytest.mark.parametrize(
    ("links", "rounds", "want"),
    [([(0, k) for k in range(1, 40)] + [(60, k) for k in range(61, 70)], 0, {**dict.fromkeys(range(40), 0), **dict.fromkeys(range(60, 70), 60)}), ([(9, 4), (9, 5), (4, 9), (3, 3)], 1, {4: 4, 5: 4, 9: 4}), ([], 0, {})],
)
def test_no_round_without_a_change(spark, monkeypatch, links, rounds, want):
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert len(written) == 1 + rounds


def test_chains_and_hubs(spark):
    rng = np.random.default_rng(3)
    links = [(k, k + 1) for k in range(1000, 1200)] + [(999_999, k) for k in range(50)] + [tuple(map(int, x)) for x in rng.integers(2000, 2300, (200, 2))]
    root = {x: x for p in links for x in p}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()} == {x: y for x, y in root.items() if x not in loops}


def test_most_off_is_one_query(spark):
    cells = materialize(spark.createDataFrame([("a", "x", "t", 10), ("a", "y", "t", 30), ("b", "x", "u", 60)], "m_source string, m_lang string, m_topic string, tokens long").withColumn("w", mixing.F.col("tokens") / 100), "cells")
    goal = materialize(spark.createDataFrame([("m_source", "a", 0.5), ("m_source", "b", 0.5), ("m_lang", "x", 0.35), ("m_lang", "y", 0.15), ("m_topic", "t", 0.4), ("m_topic", "u", 0.6)], "margin string, value string, share double"), "goal")
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("most_off", "")
    try:
        assert abs(mixing.most_off(cells, goal) - 0.1) < 1e-12
    finally:
        jobs = status.getJobIdsForGroup("most_off")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8
