"""The subspace join against all pairs."""

import numpy as np
import pytest

from chronoweave.llm import subspace_join as sj

SCHEMA = "vec_id long, embedding array<{}>, label int, c long, n string, block int, v int"


def brute(rows, least=0.93):
    ids, ok = [r[0] for r in rows], []
    for _, e, label, *_ in rows:
        good = label is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
        ok.append(np.array(e, float) / np.linalg.norm(np.array(e, float)) if good else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least_key = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least_key[find(i)] = min(least_key.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i], links[i], c := least_key.get(find(i)), ids[i] == c) for i in range(len(rows))), key=str)


def vectors(seed, dim, spread):
    """Loose and tight groups, chains, copies, and what can't be compared."""
    rng = np.random.default_rng(seed)
    rows, key = [], 0
    for group in range(12):
        centre = rng.normal(size=dim)
        for i in range(int(rng.integers(1, 25))):
            centre = centre + (rng.normal(size=dim) * 0.1 if group % 3 == 0 else 0)  # every third is a chain
            e = (centre + rng.normal(size=dim) * rng.uniform(0, spread)) * rng.choice([1e-3, 1, 50])
            key += 1
            rows.append((int(1000 - key), [float(np.float32(x)) for x in e], int(group % 2), 1, "n", 2, 3))
    rows += [rows[i] for i in (0, 0, 5)] + [(2000 + i, rows[7][1], rows[7][2], 1, "n", 2, 3) for i in range(4)]
    one = rows[0][1]
    rows += [(3000, None, 0, 1, "n", 2, 3), (3001, [0.0] * dim, 0, 1, "n", 2, 3), (3002, [float("nan"), *one[1:]], 0, 1, "n", 2, 3), (3003, [float("inf"), *one[1:]], 0, 1, "n", 2, 3), (3004, [None, *one[1:]], 0, 1, "n", 2, 3), (3005, one, None, 1, "n", 2, 3), (3006, [], 0, 1, "n", 2, 3), (None, one, 0, 1, "n", 2, 3), (3007, [1.0, 2.0, 2.0], 0, 1, "n", 2, 3), (3008, [1.0, 2.0, 2.1], 0, 1, "n", 2, 3)]
    return rows


@pytest.mark.parametrize("seed, dim, spread, most, element", [(1, 64, 0.4, 4096, "float"), (2, 64, 0.4, 9, "float"), (3, 10, 0.5, 4096, "double"), (4, 1, 1.0, 16, "double"), (5, 130, 0.35, 20, "float")])
def test_all_pairs(spark, seed, dim, spread, most, element):
    rows = vectors(seed, dim, spread)
    df = sj.near_vectors(spark.createDataFrame(rows, SCHEMA.format(element)), most=most)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)


def test_nothing(spark):
    assert sj.near_vectors(spark.createDataFrame([], SCHEMA.format("float"))).collect() == []
    assert [tuple(r) for r in sj.near_vectors(spark.createDataFrame([(7, None, None, 1, "n", 2, 3)], SCHEMA.format("float"))).collect()] == [(7, 0, 7, True)]


def test_close_pairs_are_close_in_a_block():
    """No pair at the bound escapes all blocks; a turn keeps lengths."""
    rng = np.random.default_rng(2)
    a = sj.units(rng.normal(size=(4000, 48)))
    side = rng.normal(size=a.shape)
    side = sj.units(side - (side * a).sum(1)[:, None] * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    y, z = sj.rotated(a), sj.rotated(b)
    assert np.allclose((y * y).sum(1) / sj.UNIT**2, 1, atol=1e-4)
    shares = np.stack([((y - z)[:, i:j] ** 2).sum(1) <= r * r for (i, j), r in zip(sj.cuts(64, 8), sj.radii(64, 8, 0.93))])
    assert shares.any(0).all()
