"""Components leave one table behind."""

import os
import random

from glossa import session
from glossa.llm.components import components
from tests.llm.test_operators import roots


def test_rounds_are_forgotten(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)]
    base = session.shared_base(spark).removeprefix("file://")
    os.makedirs(base, exist_ok=True)
    before = set(os.listdir(base))
    got = components(spark.createDataFrame(edges, "a long, b long"))
    want = roots(1201, edges)
    assert {r.node: r.root for r in got.collect()} == {k: v for k, v in enumerate(want) if k != v}
    assert len(set(os.listdir(base)) - before) == 1
