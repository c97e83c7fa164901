"""Components of all frames against a flood fill."""

from tarn.plans.catalog import QUERIES, blocks

from .conftest import SF


def test_components_of_all_frames(spark):
    free = {(r.frame, r.by, r.bx) for r in blocks(spark, SF).collect() if r.v > 56000}
    assert {f for f, _, _ in free} == set(range(1, 8))
    want = []
    while free:
        first = min(free)
        group, edge = set(), [first]
        free.remove(first)
        while edge:
            f, y, x = edge.pop()
            group.add((f, y, x))
            near = {(f, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & free
            free -= near
            edge += near
        if len(group) > 1:
            want.append((*min(group), len(group)))
    assert sorted(tuple(r) for r in QUERIES["k9_all_components"](spark, SF).collect()) == sorted(want)
    assert {w[0] for w in want} - {1, 2, 3}
