"""Tasks that loops over small tables run where the session has many shuffle partitions: the driver keeps a record of each."""

from contextlib import contextmanager

import pytest

from skein.llm.ngram_join import components
from skein.llm.quality import keep_good

PARTITIONS = 120


@contextmanager
def counted(spark):
    """Gets the number of tasks of all stages that run inside, with PARTITIONS shuffle partitions that aren't merged."""
    conf = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    bus = spark.sparkContext._jsc.sc().listenerBus()
    out = []
    first = spark.sparkContext._jsc.sc().newRddId()
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    bus.waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    for i in range(stages.size()):
        stage = stages.apply(i)
        if any(stage.rddIds().apply(k) > first for k in range(stage.rddIds().size())):
            out.append(stage.numCompleteTasks())


def test_quality_tasks(spark, docs):
    with counted(spark) as tasks:
        kept = keep_good(docs).collect()
    assert kept and 0 < sum(tasks) < 20 * PARTITIONS, (len(tasks), sum(tasks))


@pytest.mark.parametrize("links", [[(0, i) for i in range(1, 50)], [(i, i + 1) for i in range(12)]])
def test_components_tasks(spark, links):
    with counted(spark) as tasks:
        got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(b, 0) for _, b in links}
    assert 0 < sum(tasks) < 20 * PARTITIONS, (len(tasks), sum(tasks))
