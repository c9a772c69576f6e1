"""What the fits of the classifiers send to the driver."""

import random

import pytest

from pagemill.llm import ftrl_toxicity, zstd_quality


def result_bytes(spark):
    """Bytes of results that the tasks so far sent to the driver."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = context._gateway.new_array(context._gateway.jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).resultSize() for k in range(stages.size()))


@pytest.mark.parametrize("trainer", [zstd_quality, ftrl_toxicity])
def test_neither_texts_nor_features_reach_the_driver(spark, docs, labels, trainer):
    rnd = random.Random(9)
    frame = docs([(k, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(1000)) + " bozo" * (k % 2)) for k in range(400)])
    known = labels([(k, k % 2, k % 2) for k in range(400)])
    before = result_bytes(spark)
    assert trainer.train(frame, known) is not None
    assert result_bytes(spark) - before < 1_000_000
