"""Components of links: against union-find on random and long shapes, and in few stages."""

import random

import numpy as np
import pytest
from paramill.llm import components as module
from paramill.llm.components import components, least_reached, stars

SHAPES = ["random", "path", "path of shuffled nodes", "hub", "tree"]


def links(shape):
    draw = random.Random(5)
    ids = list(range(-150, 150))
    if shape == "random":
        return [(draw.choice(ids), draw.choice(ids)) for _ in range(180)]
    if shape == "path of shuffled nodes":
        draw.shuffle(ids)
    if shape == "hub":
        return [(149, i) for i in ids] * 2
    if shape == "tree":
        return [(ids[i], ids[draw.randrange(i)]) for i in range(1, 300)]
    return list(zip(ids, ids[1:], strict=False))


def least(pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for a, b in pairs if a != b for x in (a, b)}


@pytest.mark.parametrize("shape", SHAPES)
def test_stars_join_what_links_join(shape):
    pairs = [p for p in links(shape) if p[0] != p[1]]
    u, v = stars(*np.array(pairs, dtype=np.int64).T)
    expected = least(pairs)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: r for x, r in expected.items() if x != r}
    assert len(u) == len(set(u.tolist()))


def test_no_links():
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in stars(none, none)] == [0, 0]
    assert least_reached(np.zeros((0, 2), dtype=np.int64), 3).tolist() == [0, 1, 2]


@pytest.mark.parametrize("shape", SHAPES)
def test_components_over_many_tasks_that_hold_little(spark, monkeypatch, shape):
    monkeypatch.setattr(module, "LINKS_HELD", 3)
    pairs = links(shape)
    table = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "u long, v long").repartition(6)
    got = components(table).collect()
    assert {r.node: r.component for r in got} == least(pairs)
    assert len(got) == len(least(pairs))


def test_a_long_path_takes_few_tasks(spark):
    """Every stage has a task per partition, and the driver keeps a record of each."""
    table = spark.createDataFrame(links("path of shuffled nodes"), "u long, v long").repartition(6)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("path", "components of a path")
    try:
        assert {r.component for r in components(table).collect()} == {-150}
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("path")]
        stages = {s for j in jobs for s in j.stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks}
        assert len(stages) <= 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_links_are_read_by_one_python_step(spark, monkeypatch):
    """A second one in a stage would double the workers beside an executor, and star rounds read their input often."""
    steps = []

    def told(df, label):
        steps.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return written(df, label)

    written = module.written
    monkeypatch.setattr(module, "written", told)
    monkeypatch.setattr(module, "LINKS_HELD", 3)
    pairs = links("path of shuffled nodes")
    table = spark.createDataFrame(pairs, "u long, v long").repartition(6)
    assert {r.node: r.component for r in components(table.mapInArrow(lambda batches: batches, "u long, v long")).collect()} == least(pairs)
    assert len(steps) > 2 and max(steps) == 1
