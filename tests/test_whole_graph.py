"""The graph operators over every row of the edges table, against SQL and plain Python."""

from collections import Counter, defaultdict, deque

import duckdb
import pytest

import __spark_entry__
from veldt.operators.shortest_paths import UNREACHABLE
from veldt.queries.graph import LINKS_LANDMARKS

WITH_SQL = sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("links_"))


@pytest.fixture(scope="module")
def rows(data):
    con = duckdb.connect()
    edges = con.execute(f"SELECT src, dst FROM '{data}/edges.parquet' WHERE src IS NOT NULL AND dst IS NOT NULL").fetchall()
    ids = {i for (i,) in con.execute(f"SELECT DISTINCT id FROM '{data}/vertices.parquet' WHERE id IS NOT NULL").fetchall()}
    return ids.union(*edges), edges


def run(spark, data, name):
    return __spark_entry__.queries()[name](spark, data)


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("edges", "vertices"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = run(spark, data, name)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]}) x").fetchall()
    exact = lambda found: sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in found), key=str)
    got, want = exact(got.collect()), exact(want)
    assert len(got) == len(want) and all(a == b or any(isinstance(v, float) for v in a) and a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_every_edge_and_the_hub(spark, data, rows):
    ids, edges = rows
    assert run(spark, data, "links_num_edges").collect()[0].edges == len(edges)
    degrees = {r.id: r.in_degree for r in run(spark, data, "links_in_degrees").collect()}
    assert degrees == Counter(b for _, b in edges) and max(degrees.values()) > len(edges) / 20


@pytest.mark.parametrize("name", ["links_shortest_paths", "links_shortest_paths_to"])
def test_paths(spark, data, rows, name):
    ids, edges = rows
    near = defaultdict(list)
    for a, b in edges:
        if name.endswith("_to"):
            a, b = b, a
        near[a].append(b)
    found = []
    for start in LINKS_LANDMARKS:
        far, todo = {start: 0} if start in ids else {}, deque([start])
        while todo:
            a = todo.popleft()
            for b in near[a]:
                if b not in far:
                    far[b] = far[a] + 1
                    todo.append(b)
        found.append(far)
    assert max(map(len, found)) > len(ids) / 10
    got = {r[0]: tuple(r[f"dist_{x}"] for x in LINKS_LANDMARKS) for r in run(spark, data, name).collect()}
    assert got == {i: tuple(far.get(i, UNREACHABLE) for far in found) for i in ids}


def test_components_and_cores(spark, data, rows):
    ids, edges = rows
    near = {i: set() for i in ids}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    group = {}
    for i in sorted(ids):
        todo = [i] if i not in group else []
        while todo:
            a = todo.pop()
            if a not in group:
                group[a] = i
                todo += near[a] - group.keys()
    assert {r.id: r.component for r in run(spark, data, "links_wcc").collect()} == group
    sizes = Counter(Counter(group.values()).values())
    assert {r[0]: r[1] for r in run(spark, data, "links_wcc_partition").collect()} == sizes
    core, left, k = {}, {i: set(n) for i, n in near.items()}, 0
    while left:
        low = [i for i, n in left.items() if len(n) <= k]
        if not low:
            k += 1
        for i in low:
            core[i] = k
            for j in left.pop(i):
                left[j].discard(i) if j in left else None
    assert {r.id: r[1] for r in run(spark, data, "links_kcore").collect()} == core


@pytest.mark.parametrize("name", ["links_hyperanf_hops2", "links_hyperanf_undirected"])
def test_neighbourhoods(spark, data, rows, name):
    ids, edges = rows
    ball = {i: {i} for i in ids}
    for _ in range(2 if name.endswith("hops2") else 1):
        old = {i: set(b) for i, b in ball.items()}
        for a, b in edges:
            ball[b] |= old[a]
            if name.endswith("undirected"):
                ball[a] |= old[b]
    got = {r[0]: r[1] for r in run(spark, data, name).collect()}
    assert got.keys() == ids and all(abs(got[i] - len(ball[i])) <= max(1, 0.1 * len(ball[i])) for i in ids)
