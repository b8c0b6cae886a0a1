"""Graph algorithms on named small graphs, and against plain Python on random ones."""

import random
from collections import Counter, deque

import pytest

from veldt.operators.shortest_paths import UNREACHABLE

SQUARE = [(1, 2), (1, 3), (2, 4), (3, 4)]


def values(df, column):
    rows = df.collect()
    out = {r.id: r[column] for r in rows}
    assert len(out) == len(rows)
    return out


def both(edges):
    return edges + [(b, a) for a, b in edges]


def random_graph(seed, n=40, m=70):
    r = random.Random(seed)
    return list(range(n)), [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def test_pagerank_keeps_sinks(graph):
    r = values(graph([1, 2, 3, 4], SQUARE).pagerank().tol(1e-6).run().df, "pagerank")
    for i, want in zip((1, 2, 3, 4), (0.13750, 0.19594, 0.19594, 0.47061), strict=True):
        assert abs(r[i] - want) < 0.0015
    assert abs(sum(r.values()) - 1) < 1e-9


@pytest.mark.parametrize("hubs", [None, 3])
def test_pagerank_against_plain_iteration(graph, hubs):
    ids, edges = random_graph(3)
    outs = Counter(s for s, _ in edges)
    rank, delta = dict.fromkeys(ids, 0.15), dict.fromkeys(ids, 0.15)
    for _ in range(5):
        new = dict.fromkeys(ids, 0.0)
        for s, d in edges:
            new[d] += 0.85 * delta[s] / outs[s]
        rank, delta = {i: rank[i] + new[i] for i in ids}, new
    total = sum(rank.values())
    got = values(graph(ids, edges).pagerank().max_iter(5).tol(0.0).hub_rows(hubs).run().df, "pagerank")
    assert all(abs(got[i] - rank[i] / total) < 1e-9 for i in ids)


SP = [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (1, 4), (4, 1)]


def test_shortest_paths_two_landmarks(graph):
    df = graph([1, 2, 3, 4], SP).shortest_paths([4, 1, 4]).run().df
    assert df.columns == ["id", "dist_1", "dist_4"]
    assert values(df, "dist_1") == {1: 0, 2: 1, 3: 2, 4: 1} and values(df, "dist_4") == {1: 1, 2: 2, 3: 1, 4: 0}


@pytest.mark.parametrize("to", [False, True])
def test_shortest_paths_against_search(graph, to):
    ids, edges = random_graph(5, 30, 45)
    near = {}
    for a, b in edges:
        near.setdefault(b if to else a, []).append(a if to else b)
    want, queue = {0: 0}, deque([0])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in want:
                want[y] = want[x] + 1
                queue.append(y)
    got = values(graph(ids, edges).shortest_paths([0]).to_landmarks(to).run().df, "dist_0")
    assert got == {i: want.get(i, UNREACHABLE) for i in ids}


def test_shortest_paths_need_landmarks(graph):
    with pytest.raises(ValueError, match="landmarks"):
        graph([1], []).shortest_paths([])


CORES = {
    "pair": ([1, 2], [(1, 2)], {1: 1, 2: 1}),
    "reciprocal": ([1, 2], [(1, 2), (2, 1)], {1: 1, 2: 1}),
    "triangle": ([1, 2, 3], [(1, 2), (2, 3), (3, 1)], {1: 2, 2: 2, 3: 2}),
    "star": ([1, 2, 3, 4], [(1, 2), (1, 3), (1, 4)], {1: 1, 2: 1, 3: 1, 4: 1}),
    "chain": ([1, 2, 3, 4], [(1, 2), (2, 3), (3, 4)], dict.fromkeys((1, 2, 3, 4), 1)),
    "tail": ([1, 2, 3, 4, 5], [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], {1: 2, 2: 2, 3: 2, 4: 1, 5: 1}),
    "edgeless": ([1, 2], [], {1: 0, 2: 0}),
    "loop": ([1], [(1, 1)], {1: 0}),
}


def disjoint(graphs):
    """One graph of many, ids of the k-th shifted by 1000 k."""
    ids, edges = [], []
    for k, (i, e) in enumerate(graphs):
        ids += [1000 * k + x for x in i]
        edges += [(1000 * k + x, 1000 * k + y) for x, y in e]
    return ids, edges


def test_k_core_named(graph):
    got = values(graph(*disjoint([c[:2] for c in CORES.values()])).k_core().run().df, "kcore")
    assert got == {1000 * k + i: c for k, x in enumerate(CORES.values()) for i, c in x[2].items()}


@pytest.mark.parametrize("hubs", [None, 9])
def test_k_core_against_peeling(graph, hubs):
    ids, edges = random_graph(8, 30, 110)
    near = {i: set() for i in ids}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    left, k, want = {i: set(x) for i, x in near.items()}, 0, {}
    while left:
        low = [i for i in left if len(left[i]) <= k]
        if not low:
            k += 1
        for i in low:
            want[i] = k
            for j in left.pop(i):
                left.get(j, set()).discard(i)
    assert values(graph(ids, edges).k_core().hub_rows(hubs).run().df, "kcore") == want


CHAIN = [(1, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize(("hops", "want"), [(0, (1, 1, 1, 1)), (2, (1, 2, 3, 3)), (6, (1, 2, 3, 4))])
def test_hyperanf_chain(graph, hops, want):
    got = values(graph([1, 2, 3, 4], CHAIN).hyperanf().n_hops(hops).run().df, "neighborhood_size")
    assert all(abs(got[i + 1] - w) < 0.5 for i, w in enumerate(want))


def test_hyperanf_undirected_and_diamond(graph):
    got = values(graph([1, 2, 3, 4], CHAIN).hyperanf().n_hops(1).directed(False).run().df, "neighborhood_size")
    assert [round(got[i]) for i in (1, 2, 3, 4)] == [2, 3, 3, 2]
    got = values(graph([1, 2, 3, 4], SQUARE).hyperanf().n_hops(2).lg_k(8).run().df, "neighborhood_size")
    assert [round(got[i]) for i in (1, 2, 3, 4)] == [1, 2, 2, 4]


def test_hyperanf_rejects_lg_k(graph):
    for k in (3, 22):
        with pytest.raises(ValueError, match="lg_k"):
            graph([1], []).hyperanf().lg_k(k)


def propagate(ids, arcs, rounds):
    label = {i: i for i in ids}
    for _ in range(rounds):
        got = {i: Counter() for i in ids}
        for s, d in arcs:
            got[d][label[s]] += 1
        label = {i: min(c, key=lambda x: (-c[x], x)) if c else label[i] for i, c in got.items()}
    return label


def test_label_propagation_two_triangles(graph):
    e = both([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)])
    got = values(graph(range(1, 7), e).label_propagation().bidirectional(False).max_iter(3).run().df, "community")
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


@pytest.mark.parametrize("directed", [True, False])
def test_label_propagation_against_plain(graph, directed):
    ids, edges = random_graph(11)
    arcs = edges if directed else both([e for e in edges if e[0] != e[1]])
    for hubs in (None, 6):
        got = values(graph(ids, edges).label_propagation().bidirectional(not directed).max_iter(4).hub_rows(hubs).run().df, "community")
        assert got == propagate(ids, arcs, 4)


def components(ids, edges):
    up = {i: i for i in {*ids, *(x for e in edges for x in e)}}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    groups = {}
    for i in ids:
        groups.setdefault(top(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_components_empty_and_edgeless(graph):
    assert values(graph([], []).connected_components().run().df, "component") == {}
    assert values(graph([7, -2], [(7, 7)]).connected_components().run().df, "component") == {7: 7, -2: -2}


def test_components(graph):
    """Small cases, a long path and random graphs in one run, with and without labels."""
    cases = [([7], [(7, 7)]), ([1, 2], [(2, 1)]), ([1, 2, 3, 10, 11], [(1, 2), (2, 3), (10, 11)]), ([5, 6], [(5, 99), (99, 6)]), ([-3, -9, 4], [(-3, -9)]), (range(60), [(i, i + 1) for i in range(59)]), random_graph(1, 80, 70), random_graph(2, 80, 70)]
    ids, edges = disjoint(cases)
    g, want = graph(ids, edges), components(ids, edges)
    assert values(g.connected_components().seed(1).run().df, "component") == want  # all within the remainder
    whole = g.connected_components().seed(3).remainder(0).run()
    assert values(whole.df, "component") == want and whole.iterations > 2
    mixed = g.connected_components().seed(4).remainder(90).run()
    assert values(mixed.df, "component") == want and 1 < mixed.iterations <= whole.iterations
    raw = values(g.connected_components().seed(2).remainder(20).use_labels(False).run().df, "component")
    assert len({(raw[i], want[i]) for i in ids}) == len(set(raw.values())) == len(set(want.values()))


INDEPENDENT = {
    "complete": (range(5), [(a, b) for a in range(5) for b in range(a)], (1, 1)),
    "cycle": (range(6), [(i, (i + 1) % 6) for i in range(6)], (2, 3)),
    "path": (range(6), [(i, i + 1) for i in range(5)], (2, 3)),
    "isolated": ([1, 2, 3, 9], [(1, 2)], (3, 3)),
    "edgeless": ([1, 2, 3], [], (3, 3)),
    "empty": ([], [], (0, 0)),
    "dangling": ([1], [(1, 99)], (1, 1)),
    "loop": ([1], [(1, 1)], (1, 1)),
}


def test_independent_set(graph):
    ids, edges = disjoint([x[:2] for x in INDEPENDENT.values()])
    got = [r.id for r in graph(ids, edges).maximal_independent_set().seed(7).run().df.collect()]
    assert len(got) == len(set(got))
    for k, (least, most) in enumerate(x[2] for x in INDEPENDENT.values()):
        assert least <= sum(i // 1000 == k for i in got) <= most
    near = {i: {b for a, b in both(edges) if a == i and b != i} for i in ids}
    assert all(not near[i] & set(got) for i in got)
    assert all(i in got or near[i] & set(got) for i in ids)
    again = [r.id for r in graph(ids, edges).maximal_independent_set().seed(7).run().df.collect()]
    assert sorted(again) == sorted(got)
