"""Hierarchical density clustering against brute force: neighbours, spanning tree, condensed tree and selection."""

from __future__ import annotations


import numpy as np
import pytest

from tessera.operators import hierarchy, metric


def _points(n, dims, seed):
    """Three clouds of different density, a few far points, and repeated places."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.2, (n // 4, dims)), rng.normal(3, 0.6, (n // 3, dims)), rng.normal(-4, 1.0, (n // 4, dims))]
    rest = n - sum(map(len, parts))
    x = np.concatenate([*parts, rng.uniform(-9, 9, (rest, dims))])
    x[5:8] = x[4]
    return x


def _frame(spark, x):
    names = [f"f{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], "pid long, " + ", ".join(f"{f} double" for f in names)), names


def _reach(x, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min_samples - 1]
    return d, core, np.maximum(np.maximum(core[:, None], core[None]), d)


def _prim(r):
    """Lengths of a least spanning tree's edges."""
    inside, best, total = np.zeros(len(r), bool), np.full(len(r), np.inf), []
    q = 0
    for _ in range(len(r) - 1):
        inside[q] = True
        best = np.where(inside, np.inf, np.minimum(np.where(inside, np.inf, best), r[q]))
        q = int(np.argmin(best))
        total.append(best[q])
    return total


def _brute(x, min_size, min_samples, epsilon=0.0):
    """Top-down, from the definition: cut all edges at least as long as a level; parts of enough points are clusters."""
    _, _, r = _reach(x, min_samples)

    def parts(points, below):
        out, free = [], np.zeros(len(x), bool)
        free[points] = True
        while free.any():
            seen = np.zeros(len(x), bool)
            todo = [int(np.argmax(free))]
            free[todo[0]] = False
            while todo:
                p = todo.pop()
                seen[p] = True
                near = np.flatnonzero(free & (r[p] < below))
                free[near] = False
                todo += near.tolist()
            out.append(np.flatnonzero(seen).tolist())
        return out

    levels = sorted(set(_prim(r)), reverse=True)
    tree, leave = {}, {}

    def descend(points, name, birth, levels):
        """The cluster's points leave one level after the other."""
        mass, kids, now, top = 0.0, [], points, 0.0
        for k, level in enumerate(levels):
            split = parts(now, level)
            if len(split) == 1:
                continue
            density = 1 / max(level, hierarchy.SHORTEST)
            big = [s for s in split if len(s) >= min_size]
            for s in split:
                if len(s) < min_size or len(big) > 1:
                    mass += len(s) * density
                    top = max(top, density)
                if len(s) < min_size:
                    for p in s:
                        leave[p] = (name, density)
            if len(big) > 1 or not big:
                for s in big:
                    kids.append(descend(s, name + (min(s),), density, levels[k + 1:]))
                break
            now = big[0]
        stability = mass - len(points) * birth
        below = sum(max(t[0], t[1]) for t in (tree[c] for c in kids))
        tree[name] = (stability, below, birth, kids, top)
        return name

    root = descend(list(range(len(x))), (), 0.0, levels)
    chosen = {}

    def pick(name, kept):
        stability, below, _, kids, _ = tree[name]
        if kept is None and name != root and stability >= below:
            kept = name
        chosen[name] = kept
        for c in kids:
            pick(c, kept)

    pick(root, None)
    if epsilon:
        for name, kept in list(chosen.items()):
            if kept is not None and 1 / tree[kept][2] < epsilon:
                while len(kept) > 1 and 1 / tree[kept][2] <= epsilon:
                    kept = kept[:-1]
                chosen[name] = kept
    label = [chosen.get(leave[p][0]) if p in leave else None for p in range(len(x))]
    member = [0.0 if c is None else min(leave[p][1] / tree[c][4], 1.0) for p, c in enumerate(label)]
    return label, member


def _same_parts(a, b):
    """Equal up to the clusters' names."""
    pairs = set(zip(a, b))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_neighbours_are_all_pairs(spark):
    x = _points(150, 20, 1)
    df, names = _frame(spark, x)
    places = hierarchy.places_of(df, names)
    d, core, _ = _reach(x, 4)
    got = {r["pid"]: r["core"] for r in metric.core_distances(places, names, 4).collect()}
    assert len(got) == 147
    for p, c in got.items():
        assert c == pytest.approx(core[p])
    near = {}
    for r in metric.knn(places, names, 3).collect():
        near.setdefault(r["pid"], []).append((r["rank"], r["dist"]))
    for p, rows in near.items():
        others = sorted(d[p][[q for q in range(150) if q != p and q not in (5, 6, 7) or (q == 4 != p)]]) if p != 4 else sorted(
            d[p][[q for q in range(150) if q not in (4, 5, 6, 7)]])
        assert [v for _, v in sorted(rows)] == pytest.approx(others[:len(rows)])


def test_spanning_tree_has_the_least_weight(spark):
    x = _points(120, 6, 2)
    df, names = _frame(spark, x)
    places = metric.core_distances(hierarchy.places_of(df, names), names, 4)
    tree = hierarchy.spanning_tree(places, names).collect()
    _, _, r = _reach(x, 4)
    total = _prim(r)
    assert len(tree) == 116  # 117 places
    # edges inside the repeated place aside (they are as long as its core distance)
    want = sorted(total)
    for e in sorted(row["w"] for row in tree):
        assert min(abs(e - w) for w in want) < 1e-9
    assert sum(row["w"] for row in tree) == pytest.approx(sum(total) - 3 * _reach(x, 4)[1][4])


@pytest.mark.parametrize(("n", "dims", "min_size", "epsilon", "block"), [(500, 3, 12, 0.0, 200_000), (160, 2, 5, 0.9, 40)])
def test_clusters_are_brute_force(spark, n, dims, min_size, epsilon, block):
    x = _points(n, dims, 3)
    df, names = _frame(spark, x)
    rows = sorted(hierarchy.hierarchical_clusters(df, names, min_size, 4, epsilon, block).collect())
    label, member = _brute(x, min_size, 4, epsilon)
    got = [None if r["cluster"] < 0 else r["cluster"] for r in rows]
    assert len({c for c in label if c}) >= 2
    assert _same_parts(got, label)
    assert [r["membership"] for r in rows] == pytest.approx(member)
    assert all(0 <= r["outlier_score"] <= 1 for r in rows)


def test_small_inputs(spark):
    df, names = _frame(spark, np.zeros((0, 2)))
    assert hierarchy.hierarchical_clusters(df, names).count() == 0
    df, names = _frame(spark, np.array([[1.0, 2.0]]))
    assert [tuple(r) for r in hierarchy.hierarchical_clusters(df, names).collect()] == [(0, -1, 0.0, 0.0)]
    df, names = _frame(spark, np.array([[1.0, 2.0]] * 6 + [[5.0, 5.0]] * 6 + [[9.0, 9.0]]))
    rows = sorted(hierarchy.hierarchical_clusters(df, names, 5, 3).collect())
    assert [r["cluster"] for r in rows] == [0] * 6 + [1] * 6 + [-1]


def test_partitionings_agree(spark):
    x = np.array([[i % 7, i // 7] for i in range(49)] + [[20 + i % 5, i // 5] for i in range(25)], float)  # many equal lengths
    df, names = _frame(spark, x)
    a = sorted(hierarchy.hierarchical_clusters(df.repartition(1), names, 5, 3).collect())
    b = sorted(hierarchy.hierarchical_clusters(df.repartition(6), names, 5, 3, block=10).collect())
    assert a == b and len({r["cluster"] for r in a}) >= 2
