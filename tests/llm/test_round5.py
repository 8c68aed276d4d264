"""What stays on disk while components are found."""

from __future__ import annotations

import os
import random
from urllib.parse import urlparse

from sequor.llm import common


def test_components_keep_one_round_on_disk(spark):
    at = urlparse(common.checkpoint_folder(spark)).path
    before = set(os.listdir(at))
    place = list(range(60))
    random.Random(3).shuffle(place)
    edges = [(a, b) for a, b in zip(place, place[1:], strict=False)] + [(100, 101), (7, 7), (200, 200)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    left = set(os.listdir(at)) - before
    assert {r.node: r.root for r in got.collect()} == {k: 0 for k in range(1, 60)} | {101: 100}
    assert len(left) == 1  # of all rounds' tables
    none = common.connected_components(spark.createDataFrame([(5, 5)], "a long, b long"), "a", "b")
    assert none.columns == ["node", "root"] and none.count() == 0
