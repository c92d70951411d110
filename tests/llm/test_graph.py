import numpy as np
import pytest

from larder.llm import graph


def plain(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = start
                todo += near[x]
    return least


def shuffled(seed, links):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) if rng.random() < 0.5 else (int(b), int(a)) for a, b in rng.permutation(np.array(links, np.int64))]


PATH = [(i * 7919 % 1009 - 500, (i + 1) * 7919 % 1009 - 500) for i in range(600)]
HUB = [(5_000 + i, 9_000) for i in range(300)]
PAIRS = [(-(1 << 62) + 2 * i, -(1 << 62) + 2 * i + 1) for i in range(200)]


@pytest.mark.parametrize("links", [PATH, HUB, PAIRS, PATH + HUB + PAIRS])
def test_stars_join_up_all_links(links):
    links = shuffled(len(links), links)
    node, root = graph.stars(*np.array(links).T)
    want = plain(links)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: c for x, c in want.items() if x != c}


def test_no_links():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in graph.stars(none, none)] == [0, 0]


@pytest.mark.parametrize("share", [1 << 18, 150])
def test_components_over_shares(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "SHARE", share)
    links = shuffled(share, PATH + HUB + PAIRS) + [(77_777, 77_777)]
    frame = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long").repartition(12)
    got = {r.node: r.component for r in graph.components(frame).collect()}
    assert got == plain(links[:-1])
    assert graph.components(frame.where("a > 1000000")).collect() == []
