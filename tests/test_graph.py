"""Graph operators on small invented graphs."""

import math
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import shortest
from graphloom.operators import community as C
from graphloom.operators import graph as G
from graphloom.operators import paths
from graphloom.operators.components import components
from graphloom.operators.numbering import dense_number, renumber
from graphloom.plans.bgd import betweenness
from graphloom.plans.connectivity import DynamicConnectivity

EDGES = "u long, v long, weight double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_loops_and_parallel_edges(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 4.0), (3, 3, 5.0), (1, 3, None)], EDGES)
    adj = G.symmetrize(e)
    assert adj.count() == 8
    assert {r["node"]: r["k"] for r in G.weighted_degree(adj).collect()} == {1: 6.0, 2: 5.0, 3: 11.0}
    assert G.graph_total(adj).first()[0] == 22.0 and G.graph_total(adj.limit(0)).first()[0] == 1.0
    simple = G.simple_graph(e.withColumn("line", F.monotonically_increasing_id()).withColumn("w_uv", F.coalesce("weight", F.lit(1.0))), F.col("line"))
    assert {(r["u"], r["v"]): round(r["len"], 4) for r in simple.collect()} == {(1, 2): 0.25, (1, 3): 1.0}


def test_missing_vectors_are_zero(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (3, [1.0]), (9, [5.0, 5.0]), (2, None)], "node long, z array<double>")
    assert {r["node"]: r["z"] for r in G.align_vectors(nodes, vectors, 2).collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    with pytest.raises(ValueError):
        G.align_vectors(nodes, vectors.limit(0))
    adj = G.symmetrize(spark.createDataFrame([(1, 2, 2.0)], EDGES))
    z = G.align_vectors(nodes, vectors, 2)
    for phi, w in (("cosine", 0.0), ("pearson", 0.0), ("sigmoid", 1.0)):
        assert [r["w_uv"] for r in G.reweight(adj, z, phi).collect()] == [w, w]
    assert [r["w_uv"] for r in G.reweight(adj, z, "cosine", "nophi").collect()] == [2.0, 2.0]
    t = G.totals(G.reweight(adj, z, "sigmoid"))
    assert (t.two_m, t.two_m_w, t.g_average) == (4.0, 2.0, 0.5)
    assert G.totals(G.reweight(adj.limit(0), z, "sigmoid")).g_average == 1.0


def test_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0), (9, 9, 1.0), (7, 6, 1.0)] + [(i, i + 1, 1.0) for i in range(100, 160)], EDGES)
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 9: 9} | {i: 100 for i in range(100, 161)}
    assert components(e.limit(0)).count() == 0


def test_dense_numbers(spark):
    names = [f"n{i}" for i in random.Random(0).sample(range(5000), 700)]
    got = dense_number(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert {r["name"]: r["number"] for r in got} == {n: i for i, n in enumerate(sorted(names))}
    assert dense_number(spark.createDataFrame([], "name string"), "name").count() == 0
    part = spark.createDataFrame([(1, 30), (2, 10), (3, 30), (4, 20)], "node long, community long")
    assert rows(renumber(part)) == [(1, 2), (2, 0), (3, 2), (4, 1)]


def test_contract_and_compose(spark):
    adj = G.symmetrize(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (1, 4, 4.0), (3, 3, 9.0)], EDGES)).withColumnRenamed("weight", "w_uv")
    part = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 20)], "node long, community long")
    assert rows(C.contract(adj, part)) == [(10, 20, 6.0), (20, 10, 6.0)]
    up = spark.createDataFrame([(10, 7), (20, 7)], "node long, community long")
    assert rows(C.compose(part, up)) == [(1, 7), (2, 7), (3, 7), (4, 7)]
    weights = {(r["node"], r["community"]): r["w"] for r in C.node_community_weight(adj, part).collect()}
    assert weights == {(1, 10): 1.0, (1, 20): 4.0, (2, 10): 1.0, (2, 20): 2.0, (3, 10): 2.0, (3, 20): 21.0, (4, 20): 3.0, (4, 10): 4.0}


GRAPHS = {
    "square": [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 4, 1.0)],
    "path": [(1, 2, 1.0), (2, 3, 0.5), (3, 4, 2.0), (4, 5, 1.0)],
    "star": [(1, i, 1.0) for i in range(2, 8)],
    "grid": [(3 * i + j, 3 * i + j + 1, 1.0) for i in range(3) for j in range(2)] + [(3 * i + j, 3 * i + j + 3, 1.0) for i in range(2) for j in range(3)],
    "parts": [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 3.0), (7, 8, 1.0)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_betweenness(spark, name):
    e = GRAPHS[name]
    near = defaultdict(dict)
    for u, v, x in e:
        near[u][v] = near[v][u] = x
    # every simple path of least length, by enumeration
    want, sigma = defaultdict(float), {}
    for s in near:
        best = defaultdict(list)
        stack = [(s, (s,), 0.0)]
        while stack:
            at, path, d = stack.pop()
            best[at].append((d, path))
            stack += [(v, (*path, v), d + x) for v, x in near[at].items() if v not in path]
        for t, found in best.items():
            least = min(d for d, _ in found)
            short = [p for d, p in found if d < least + 1e-12]
            sigma[s, t] = len(short)
            for p in short:
                for a, b in zip(p, p[1:]):
                    want[min(a, b), max(a, b)] += 1 / len(short)
    edges = spark.createDataFrame(e, "u long, v long, len double")
    sources = edges.select(F.explode(F.array("u", "v")).alias("s")).distinct()
    got = {(r["u"], r["v"]): r["bet"] for r in paths.edge_betweenness(edges, sources).collect()}
    assert got == pytest.approx(dict(want))
    assert dict(betweenness(near, list(near))) == pytest.approx(dict(want))
    dist = paths.shortest_distances(edges, sources)
    counts = paths.path_counts(paths.tight_steps(edges, dist), sources)
    assert {(r["s"], r["v"]): r["sigma"] for r in counts.collect()} == sigma


def test_rank_and_sources(spark):
    e = spark.createDataFrame([(2, 3, 1.0), (1, 2, 5.0), (1, 3, 1.0)], "u long, v long, bet double")
    assert [tuple(r) for r in C.rank_edges(e).orderBy("rank").collect()] == [(1, 2, 5.0, 1), (1, 3, 1.0, 2), (2, 3, 1.0, 3)]
    first = [r["s"] for r in paths.sample_sources(e, 2, 1).collect()]
    assert len(first) == 2 and first == [r["s"] for r in paths.sample_sources(e, 2, 1).collect()]


def test_dynamic_connectivity():
    rng = random.Random(3)
    g, edges = DynamicConnectivity(), set()
    for u in range(25):
        g.add_node(u)
    for _ in range(300):
        u, v = rng.sample(range(25), 2)
        u, v = min(u, v), max(u, v)
        if (u, v) in edges:
            edges.discard((u, v))
            g.delete(u, v)
        else:
            edges.add((u, v))
            g.insert(u, v)
        up = list(range(25))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[find(a)] = find(b)
        a, b = rng.sample(range(25), 2)
        assert g.connected(a, b) == (find(a) == find(b))
        assert g.component_count() == len({find(x) for x in range(25)})


def _random_lengths(seed):
    rng = random.Random(seed)
    ends = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(55)} | {(100, i) for i in range(101, 130)}
    return [(u, v, rng.choice((1.0, 0.5, 2.0))) for u, v in sorted(ends)]


@pytest.mark.parametrize("seed", range(2))
def test_path_routes_agree(spark, monkeypatch, seed):
    """In workers and as tables; sources outside of the graph reach themselves."""
    edges = spark.createDataFrame(_random_lengths(seed), "u long, v long, len double").cache()
    sources = edges.select(F.col("u").alias("s")).distinct().unionByName(spark.createDataFrame([(999,)], "s long"))
    monkeypatch.setattr(paths, "GROUP", 20)
    monkeypatch.setattr(paths, "WIDTH", 7)
    found = []
    for most in (paths.LOCAL_EDGES, 0):
        monkeypatch.setattr(paths, "LOCAL_EDGES", most)
        found.append([{tuple(r)[:2]: pytest.approx(r[2]) for r in f(edges, sources).collect()} for f in (paths.shortest_distances, paths.count_paths, paths.edge_betweenness)])
    assert found[0] == [{k: x.expected for k, x in part.items()} for part in found[1]]
    assert (999, 999) in found[0][0] and (999, 999) in found[0][1]


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def _chain(spark):
    """A path of 120 nodes: rounds as tables would be jobs for each of its steps."""
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(119)], "u long, v long, len double")
    return edges, spark.createDataFrame([(0,), (60,)], "s long")


def test_edge_betweenness_needs_few_jobs(spark):
    edges, sources = _chain(spark)
    got, jobs = _jobs(spark, "edge_betweenness", lambda: {r["u"]: r["bet"] for r in paths.edge_betweenness(edges, sources).collect()})
    assert got == {i: 119 - i + (i + 1 if i < 60 else 119 - i) for i in range(119)} and jobs < 25


def test_count_paths_needs_few_jobs(spark):
    """A ladder of 60 squares in a row: the number of paths doubles with each."""
    rows = [(3 * i + a, 3 * i + b, 1.0) for i in range(60) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    edges = spark.createDataFrame(rows, "u long, v long, len double")
    got, jobs = _jobs(spark, "count_paths", lambda: {r["v"]: r["sigma"] for r in paths.count_paths(edges, spark.createDataFrame([(0,)], "s long")).collect()})
    assert len(got) == 181 and all(got[3 * i] == 2.0**i for i in range(61)) and jobs < 25


def test_rank_edges_of_betweenness_needs_few_jobs(spark):
    edges, sources = _chain(spark)
    got, jobs = _jobs(spark, "rank_edges", lambda: [tuple(r) for r in C.rank_edges(paths.edge_betweenness(edges, sources)).orderBy("rank").collect()])
    assert [r[0] for r in got] == sorted(range(119), key=lambda i: (-(119 - i + (i + 1 if i < 60 else 119 - i)), i)) and [r[3] for r in got] == list(range(1, 120))
    assert jobs < 40


def test_shortest_distances_need_few_jobs(spark):
    edges, sources = _chain(spark)
    got, jobs = _jobs(spark, "shortest_distances", lambda: {(r["s"], r["v"]): r["dist"] for r in paths.shortest_distances(edges, sources).collect()})
    assert got == {(s, v): float(abs(s - v)) for s in (0, 60) for v in range(120)} and jobs < 25


def _random_links(n=4_000, m=12_000, seed=5):
    rng = np.random.default_rng(seed)
    u, v = np.unique(np.sort(rng.integers(0, n, (m, 2)), axis=1), axis=0).T
    u, v = u[u != v], v[u != v]
    return shortest.Links.of(n, u, v, 1 + rng.random(len(u)) / 2), len(u)


def test_sweeps_go_in_blocks_that_fit_a_cache():
    links, _ = _random_links()
    starts = np.arange(100)
    tracemalloc.start()
    dist = shortest.distances(links, starts, starts, 100)
    peak = tracemalloc.get_traced_memory()[1] - dist.nbytes
    tracemalloc.stop()
    assert peak < 6e6  # 24,000 links times 100 sources are 19 MB


def test_steps_of_a_round_lie_side_by_side():
    links, _ = _random_links()
    starts = np.arange(100)
    for _, part in shortest.steps(links, shortest.distances(links, starts, starts, 100)):
        assert len(part.rounds) < 30
        assert np.array_equal(np.concatenate([np.arange(len(part.a))[r] for r in part.rounds]), np.arange(len(part.a)))
        last = np.full(len(part.sigma), -1)
        for k, r in enumerate(part.rounds):
            assert (last[part.a[r]] < k).all()
            last[part.b[r]] = k


@pytest.mark.parametrize("small", (1e-9, 1.0))
def test_betweenness_of_hubs(monkeypatch, small):
    """More links to a node than a block goes through; lengths alike and far apart."""
    e = {(a, i): 1.0 for i in range(2, 50) for a in (0, 1)} | {(50, 51): small, (2, 50): 1.0, (51, 52): 2.0}
    u, v = np.array(sorted(e)).T
    links = shortest.Links.of(53, u, v, np.array([e[x] for x in sorted(e)]))
    found = []
    for fold, block in ((256, 50_000), (3, 60)):
        monkeypatch.setattr(shortest, "FOLD", fold)
        monkeypatch.setattr(shortest, "BLOCK", block)
        found.append(np.zeros(len(u)))
        shortest.add_betweenness(links, np.arange(53), np.arange(53), 53, found[-1])
    near = defaultdict(dict)
    for (a, b), x in e.items():
        near[a][b] = near[b][a] = x
    # each source by itself: distances by relaxing all edges until nothing changes, then paths in order of distance
    want = defaultdict(float)
    for s in near:
        d = dict.fromkeys(near, math.inf) | {s: 0.0}
        while any(d[a] + x < d[b] - 1e-12 for a in near for b, x in near[a].items()):
            d |= {b: min([d[b], *(d[a] + x for a, x in near[b].items())]) for b in near}
        sigma, flow, order = {s: 1.0}, defaultdict(float), sorted(near, key=d.get)
        back = {b: [a for a, x in near[b].items() if d[a] < d[b] and abs(d[a] + x - d[b]) < 1e-12] for b in near}
        for b in order[1:]:
            sigma[b] = sum(sigma[a] for a in back[b])
        for b in reversed(order[1:]):
            for a in back[b]:
                x = sigma[a] / sigma[b] * (1 + flow[b])
                flow[a] += x
                want[min(a, b), max(a, b)] += x
    for got in found:
        assert dict(zip(sorted(e), got.tolist())) == pytest.approx({x: want[x] for x in e})


def test_links_take_twenty_bytes():
    links, _ = _random_links()
    assert sum(x.nbytes for x in (links.src, links.dst, links.length, links.edge)) == 20 * len(links.src)


@pytest.fixture
def star(spark, monkeypatch):
    """2,100,000 edges at one node, the only source; paths as tables are refused."""
    for name in ("swept_distances", "swept_betweenness"):
        monkeypatch.setattr(paths, name, lambda *_: pytest.fail("swept as tables"))
    return spark.range(1, 2_100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"), F.lit(1.5).alias("len")), spark.createDataFrame([(0,)], "s long")


def test_edge_betweenness_of_millions_of_edges_makes_no_tables(star):
    assert tuple(paths.edge_betweenness(*star).agg(F.count("*"), F.min("bet"), F.max("bet"), F.sum("v")).first()) == (2_100_000, 1.0, 1.0, 2_100_000 * 2_100_001 // 2)


def test_rank_edges_of_millions_of_edges_makes_no_tables(star):
    got = C.rank_edges(paths.edge_betweenness(*star)).agg(F.count("*"), F.max("rank"), F.count_if(F.col("v") == F.col("rank"))).first()
    assert tuple(got) == (2_100_000,) * 3


def test_distances_over_millions_of_edges_make_no_tables(star):
    assert tuple(paths.shortest_distances(*star).agg(F.count("*"), F.sum("dist")).first()) == (2_100_001, 3_150_000.0)


def test_counts_over_millions_of_edges_make_no_tables(star):
    assert tuple(paths.count_paths(*star).agg(F.count("*"), F.sum("sigma")).first()) == (2_100_001, 2_100_001.0)


@pytest.mark.parametrize("phi", ("cosine", "pearson", "sigmoid"))
def test_similarities_by_blocks_are_those_of_the_join(spark, monkeypatch, phi):
    """Bit for bit for cosine and Pearson; a zero vector, loops, ends that are null or have no vector."""
    rng = random.Random(7)
    z = spark.createDataFrame([(i, [rng.gauss(0, 1) if i else 0.0 for _ in range(9)]) for i in range(700)], "node long, z array<double>")
    ends = [(rng.randrange(720), rng.randrange(720), rng.random()) for _ in range(3000)] + [(5, 5, 1.0), (0, 0, 2.0), (None, 1, 1.0), (2, None, 1.0)]
    adj = G.symmetrize(spark.createDataFrame(ends, EDGES)).cache()
    joined = rows(G.reweight(adj, z, phi))
    monkeypatch.setattr(G, "JOINED", 0)
    blocks = G.reweight(adj, z, phi)
    assert "FlatMapCoGroupsInArrow" in blocks._jdf.queryExecution().toString()
    got = rows(blocks)
    assert got == joined if phi != "sigmoid" else all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-15) for a, b in zip(got, joined, strict=True))
