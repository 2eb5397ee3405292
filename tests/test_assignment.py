import itertools

import numpy as np

from touchline.operators.assignment import assign, match_few, match_gated, match_sparse


def test_assign_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        m = int(rng.integers(n, 7))
        c = rng.random((n, m))
        a = assign(c)
        assert len(set(a)) == n
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert abs(c[np.arange(n), a].sum() - best) < 1e-9


def test_gated_matches_most_then_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = (int(v) for v in rng.integers(1, 5, 2))
        c, ok = rng.random((n, m)), rng.random((n, m)) < 0.5
        got = match_gated(c, ok)
        assert all(ok[i, j] for i, j in got)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        best = (0, 0.0)
        edges = list(zip(*np.nonzero(ok)))
        for k in range(len(edges) + 1):
            for pick in itertools.combinations(edges, k):
                if len({i for i, _ in pick}) == len({j for _, j in pick}) == k:
                    best = min(best, (-k, sum(c[i, j] for i, j in pick)))
        assert -len(got) == best[0]
        assert abs(sum(c[i, j] for i, j in got) - best[1]) < 1e-9


def test_sparse_agrees_with_the_dense_solver():
    rng = np.random.default_rng(2)
    for trial in range(300):
        n, m = (int(v) for v in rng.integers(1, 9 if trial < 250 else 60, 2))
        c, ok = rng.random((n, m)) * 5 + 1, rng.random((n, m)) < (0.4 if trial < 250 else 0.08)
        edges = {i: [(int(j), float(c[i, j])) for j in np.flatnonzero(ok[i])] for i in range(n) if ok[i].any()}
        got = match_sparse(edges, 1e6)
        assert all(ok[i, j] for i, j in got.items()) and len(set(got.values())) == len(got)
        want = match_gated(c, ok)
        assert len(got) == len(want)
        assert abs(sum(c[i, j] for i, j in got.items()) - sum(c[i, j] for i, j in want)) < 1e-6


def test_few_pairs_are_matched_as_the_arrays_are():
    rng = np.random.default_rng(11)
    for n in range(400):
        cost = rng.integers(0, 6, (rng.integers(1, 9), rng.integers(1, 7))) / (1.0 if n % 2 else 3.0)  # many ties
        ok = rng.random(cost.shape) < rng.choice([0.15, 0.4, 0.8])
        pairs = {(int(r), int(c)): float(cost[r, c]) for r, c in zip(*np.nonzero(ok))}
        assert match_few(pairs) == match_gated(cost, ok)
