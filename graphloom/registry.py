"""Every query of the library by name, with its SQL where SQL can express it.

Single-operator queries use fixed anchors and the partition ``node % 7``, so that each is
checked on its own; solvers run on calibrated anchors."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import oracles as O
from graphloom.functions import kernels as K
from graphloom.model import Config, Objective
from graphloom.operators import calibrate as A
from graphloom.operators import community as C
from graphloom.operators import graph as G
from graphloom.operators import objective as Q
from graphloom.operators import pairs as P
from graphloom.operators import paths
from graphloom.operators.components import components
from graphloom.operators.numbering import dense_number, renumber
from graphloom.plans.connectivity import DynamicConnectivity
from graphloom.plans.detect import detect
from graphloom.plans.mga import run_mga
from graphloom.sources import derived, sinks, text
from graphloom.storage import fresh_path, written

Query = Callable[[SparkSession, str], DataFrame]
rnd = lambda c, n=6: F.round(F.col(c) if isinstance(c, str) else c, n)


def t35(spark: SparkSession, sf: str) -> DataFrame:
    return derived.threshold_graph(spark, sf, 0.35)


def _reweighted(spark: SparkSession, sf: str, edges: DataFrame, mode: str = "kmeans") -> DataFrame:
    return G.reweight(G.symmetrize(edges), derived.embeddings(spark, sf), "cosine", mode)


def graph_edges(spark, sf):
    return G.symmetrize(t35(spark, sf))


def top_strength(spark, sf):
    return G.top_strength(_reweighted(spark, sf, t35(spark, sf)), 20).select("node", rnd("strength").alias("strength"))


def graph_parallel_selfloop(spark, sf):
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(O.LITERAL_EDGES)], "line long, u long, v long, weight double")
    degree = G.weighted_degree(G.symmetrize(edges)).select(F.lit("degree").alias("what"), F.col("node").alias("a"), F.col("node").alias("b"), rnd("k").alias("x"))
    length = G.simple_graph(edges.withColumn("w_uv", F.col("weight")), F.col("line")).select(F.lit("length").alias("what"), F.col("u").alias("a"), F.col("v").alias("b"), rnd("len").alias("x"))
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), (2 * F.col("line")).alias("at")), F.struct(F.col("v").alias("node"), (2 * F.col("line") + 1).alias("at")))))
    number = dense_number(ends.groupBy("node").agg(F.min("at").alias("at")), "at").select(F.lit("number").alias("what"), F.col("node").alias("a"), F.col("number").alias("b"), F.lit(0.0).alias("x"))
    return degree.unionByName(length).unionByName(number)


def _next_pairs(spark, sf, **columns: Callable[[Column, Column], Column]) -> DataFrame:
    e = derived.embeddings(spark, sf)
    b = e.select((F.col("node") - 1).alias("u"), F.col("node").alias("v"), F.col("z").alias("zb"))
    joined = e.select(F.col("node").alias("u"), F.col("z").alias("za")).join(b, "u")
    return joined.select("u", "v", *[rnd(f(F.col("za"), F.col("zb"))).alias(n) for n, f in columns.items()])


def phi_zero_vector(spark, sf):
    zero = lambda f: lambda a, b: f(F.transform(a, lambda x: x * 0), b)
    return _next_pairs(spark, sf, **{n: zero(f) for n, f in K.SIMILARITIES.items()})


def stable_sigmoid(spark, sf):
    return spark.range(-800, 801, 50).select(F.col("id").alias("x"), rnd(K.stable_sigmoid(F.col("id").cast("double")), 9).alias("y"))


def centroids(spark, sf):
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    three, one = F.lit(3), F.lit(1)
    return _next_pairs(spark, sf, plain=lambda a, b: total(K.centroid(a, three)), without=lambda a, b: total(K.centroid_without(a, three, b, one))).select(F.col("u").alias("node"), "plain", "without")


def embedding_zero_fill(spark, sf):
    have = derived.embeddings(spark, sf).filter("node % 3 <> 0")
    aligned = G.align_vectors(G.nodes_of(derived.supplier_graph(spark, sf)), have)
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + x)
    return aligned.select("node", rnd(total).alias("total"), F.size("z").cast("long").alias("width"), (~F.exists("z", lambda x: x != 0)).alias("filled"))


def weighted_degree(spark, sf):
    return G.weighted_degree(G.symmetrize(derived.supplier_graph(spark, sf)))


def graph_totals(spark, sf):
    return G.graph_total(G.symmetrize(derived.supplier_graph(spark, sf)))


def edge_reweight(spark, sf):
    return _reweighted(spark, sf, t35(spark, sf)).select("src", "dst", "weight", rnd("sim").alias("sim"), rnd("w_uv").alias("w_uv"))


def weighted_totals(spark, sf):
    return G.weighted_totals(_reweighted(spark, sf, t35(spark, sf))).select(rnd("two_m", 4).alias("two_m"), rnd("two_m_w", 4).alias("two_m_w"), rnd("g_average").alias("g_average"))


def pairs_exhaustive(spark, sf):
    return P.pair_rows(derived.embeddings(spark, sf), "cosine").select("u", "v", rnd("d").alias("d"), rnd("sim").alias("sim"))


def _sample(spark, sf) -> DataFrame:
    """As many pairs as the method looks at."""
    vectors = derived.embeddings(spark, sf)
    n = vectors.count()
    found = P.sampled_pairs(vectors, P.sample_size(n, O.SAMPLING)[0], O.SEED, n)
    a, b = F.col("a.z"), F.col("b.z")
    return found.select("r", F.col("a.node").alias("u"), F.col("b.node").alias("v"), K.vec_dist(a, b).alias("d"), K.cosine_sim_01(a, b).alias("sim"))


def pairs_sampled(spark, sf):
    return _sample(spark, sf).select("r", "u", "v", rnd("d").alias("d"), rnd("sim").alias("sim"))


def subsample_sorted(spark, sf):
    return P.subsample(_sample(spark, sf), seed=O.SEED).select("r", rnd("d").alias("d"))


def sample_size(spark, sf):
    n = derived.embeddings(spark, sf).count()
    return spark.createDataFrame([(n, P.sample_size(n, O.SAMPLING)[0])], "n long, wanted long")


def _center_rows(spark, centers: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(centers)], "c long, center double").select("c", rnd("center").alias("center"))


def kmeans_seed_quantile(spark, sf):
    return _center_rows(spark, A.seed_quantile(_sample(spark, sf), O.FIXED_K))


def kmeans_step(spark, sf):
    return A.lloyd_step(_sample(spark, sf), list(O.CENTERS)).select("c", rnd("center").alias("center"), "n")


def kmeans_fixed_iters(spark, sf):
    rows = written(_sample(spark, sf).select("d"), "distances")
    centers = A.seed_quantile(rows, O.FIXED_K)
    for _ in range(O.FIXED_ROUNDS):
        centers = A.moved(centers, A.lloyd_step(rows, centers))
    return _center_rows(spark, centers)


def kmeans_wcss(spark, sf):
    return A.wcss(_sample(spark, sf), list(O.CENTERS)).select(rnd("wcss", 4).alias("wcss"))


def kmeans_plusplus(spark, sf):
    return _center_rows(spark, A.seed_plusplus(written(_sample(spark, sf).select("r", "d"), "distances"), O.FIXED_K, O.SEED))


def silhouette_1d(spark, sf):
    rows = written(P.subsample(_sample(spark, sf), seed=O.SEED), "distances")
    return A.silhouette(rows, K.bin_of(F.col("d"), A.midpoints(list(O.CENTERS))), len(O.CENTERS)).select(rnd("score").alias("score"))


def gd_bin_means(spark, sf):
    return A.bin_means(_sample(spark, sf), list(O.GAPPED)).select(F.col("c").cast("long").alias("c"), "center", rnd("mean_sim").alias("mean_sim"))


def gd_interp(spark, sf):
    return _sample(spark, sf).select("r", rnd(K.g_interp(F.col("d"), O.ANCHORS)).alias("g"))


def calibration(spark, sf):
    anchors, _ = A.calibrate(derived.embeddings(spark, sf), Config())
    return spark.createDataFrame(list(zip(range(len(anchors.centers)), anchors.centers, anchors.means)), "c int, center double, mean_sim double").select("c", rnd("center").alias("center"), rnd("mean_sim").alias("mean_sim"))


def _g5(spark, sf, mode: str = "kmeans"):
    """(adjacency with weights, degrees, vectors, objective) of G5 with the fixed anchors."""
    adjacency = written(G.symmetrize(derived.neighbour_graph(spark, sf)), "g5")
    vectors = derived.embeddings(spark, sf)
    rw = written(G.reweight(adjacency, vectors, "cosine", mode), "g5-reweighted")
    return rw, G.weighted_degree(adjacency), vectors, Objective(mode, O.GAMMA, G.totals(rw), O.ANCHORS)


def _by_seven(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", (F.col("node") % 7).alias("community"))


def objective(mode: str, spark, sf):
    rw, degrees, vectors, o = _g5(spark, sf, mode)
    found = Q.quality(rw, degrees, vectors, _by_seven(degrees), o)
    return found.select(rnd("within", 4).alias("within_weight"), rnd("penalty", 4).alias("pair_penalty"), rnd("q").alias("q"))


def node_comm_weight(spark, sf):
    rw, degrees, _, _ = _g5(spark, sf)
    return C.node_community_weight(rw, _by_seven(degrees)).select("node", "community", rnd("w").alias("w"))


def _with_comms(spark, sf):
    rw, degrees, vectors, o = _g5(spark, sf)
    part, stats = _by_seven(degrees), C.node_stats(degrees, vectors)
    comms = C.community_stats(stats, part).select("community", F.struct("sum_z", "sum_k", "cnt").alias("c"))
    nodes = stats.select("node", F.struct("sum_z", "sum_k", "cnt").alias("n"))
    return rw, part, nodes, comms, o


def penalty_join(spark, sf):
    rw, part, nodes, comms, o = _with_comms(spark, sf)
    around = C.node_community_weight(rw, part).join(part.withColumnRenamed("community", "own"), "node").filter("community <> own")
    return around.join(nodes, "node").join(comms, "community").select("node", "community", rnd(C.penalty_join(o)).alias("penalty"))


def penalty_exclude(spark, sf):
    _, part, nodes, comms, o = _with_comms(spark, sf)
    return part.join(nodes, "node").join(comms, "community").select("node", "community", rnd(C.penalty_exclude(o)).alias("penalty"))


def best_move(spark, sf):
    rw, degrees, vectors, o = _g5(spark, sf)
    found = C.best_moves(C.moves(rw, _by_seven(degrees), C.node_stats(degrees, vectors), o))
    return found.select("node", "own", "community", rnd("gain").alias("gain"), rnd("stay").alias("stay"))


def contract_graph(spark, sf):
    rw, degrees, _, _ = _g5(spark, sf)
    return C.contract(rw, _by_seven(degrees)).filter("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), rnd("w_uv", 4).alias("w_uv"))


def supernode_stats(spark, sf):
    _, degrees, vectors, _ = _g5(spark, sf)
    found = C.supernode_stats(C.node_stats(degrees, vectors), _by_seven(degrees))
    return found.select(F.col("node").alias("community"), rnd("sum_k", 4).alias("sum_k"), "cnt", F.posexplode("sum_z").alias("pos", "x")).withColumn("x", rnd("x")).withColumn("pos", F.col("pos").cast("long"))


def compose_labels(spark, sf):
    part = _by_seven(G.nodes_of(derived.neighbour_graph(spark, sf)))
    level = spark.range(7).select(F.col("id").alias("node"), (F.col("id") % 3).alias("community"))
    return C.compose(part, level)


def renumbered(spark, sf):
    nodes = G.nodes_of(derived.neighbour_graph(spark, sf))
    return renumber(nodes.select("node", (F.col("node") % 7 * 10 + 3).alias("community")))


def connected_components(spark, sf):
    return components(t35(spark, sf))


def _t40_lengths(spark, sf) -> DataFrame:
    rw = _reweighted(spark, sf, derived.threshold_graph(spark, sf, 0.40))
    return written(G.simple_graph(rw.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w_uv")), "t40")


def _every(edges: DataFrame) -> DataFrame:
    return written(edges.select(F.explode(F.array("u", "v")).alias("s")).distinct(), "sources")


def edge_length(spark, sf):
    rw = _reweighted(spark, sf, t35(spark, sf))
    return G.simple_graph(rw.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w_uv")).select("u", "v", rnd("len").alias("len"))


def sssp(spark, sf):
    edges = _t40_lengths(spark, sf)
    return paths.shortest_distances(edges, _every(edges)).select("s", "v", K.rounded(F.col("dist")).alias("dist"))


def path_counts(spark, sf):
    edges = _t40_lengths(spark, sf)
    return paths.count_paths(edges, _every(edges))


def edge_betweenness(spark, sf):
    edges = _t40_lengths(spark, sf)
    return paths.edge_betweenness(edges, _every(edges)).select("u", "v", rnd("bet").alias("bet"))


def rank_edges(spark, sf):
    return C.rank_edges(edge_betweenness(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def split_delta(spark, sf):
    rw, degrees, vectors, o = _g5(spark, sf)
    members = degrees.join(vectors, "node").select("node", F.when(F.col("node") % 10 < 4, 1).otherwise(2).alias("side"), "k", "z")
    return Q.split_delta(rw, members, o).select(rnd("weight_change", 4).alias("weight_change"), rnd("penalty_change", 4).alias("penalty_change"))


def mga(spark, sf):
    return detect(derived.neighbour_graph(spark, sf), derived.embeddings(spark, sf), Config()).partition


def mga_bulk(spark, sf):
    rw, degrees, vectors, o = _g5(spark, sf, "nog")
    return run_mga(rw, degrees, vectors, o, solver="bulk")


def bgd(spark, sf):
    return detect(derived.threshold_graph(spark, sf, 0.40), derived.embeddings(spark, sf), Config(algorithm="BGD")).partition


def partition_sink(spark, sf):
    nodes = G.nodes_of(t35(spark, sf))
    return sinks.partition_lines(_by_seven(nodes), nodes.select("node", F.concat(F.lit("n"), F.col("node").cast("string")).alias("name")))


def run_log(spark, sf):
    """Runs that are logged one after the other, and the log read back (times left out)."""
    log, edges = fresh_path(spark, "summary"), written(t35(spark, sf), "t35")
    done = {}
    for network, gamma, g in O.RUNS:
        config = Config(gamma=gamma, g=g)
        if config not in done:
            done[config] = detect(edges, derived.embeddings(spark, sf), config)
        sinks.log_run(spark, log, network, config, done[config].bins, done[config].precompute_s, done[config].algorithm_s)
    times = F.abs(F.col("Total_Time") - F.col("Precompute_Time") - F.col("Algorithm_Time")) < 1e-3
    return sinks.read_log(spark, log).filter(times).select(*[c for c in sinks.LOG_COLUMNS if not c.endswith("_Time")])


def text_sources(spark, sf):
    """An edge list and a vector file, written as text, read and encoded."""
    paths_ = []
    for name, lines in (("network", O.NETWORK), ("embedding", O.EMBEDDING)):
        paths_.append(fresh_path(spark, name))
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(paths_[-1])
    edges, vectors, nodes = text.load_graph(spark, *paths_)
    side = lambda k: nodes.join(vectors, "node", "left").select(F.col("node").alias(k), F.col("name").alias(f"{k}_name"), F.get("z", F.lit(0)).alias(f"z{k}"))
    return edges.join(side("u"), "u").join(side("v"), "v").select("u_name", "v_name", "u", "v", "weight", "zu", "zv")


def dynamic_connectivity(spark, sf):
    graph, rows = DynamicConnectivity(), []
    for _, u, v in O.CONNECTIVITY:
        graph.add_node(u)
        graph.add_node(v)
    for step, (op, u, v) in enumerate(O.CONNECTIVITY):
        if op != "ask":
            getattr(graph, op)(u, v)
        rows.append((step, op, u, v, graph.connected(u, v), graph.component_count()))
    return spark.createDataFrame(rows, "step int, op string, u int, v int, connected boolean, components long")


def cliques(spark, sf, **config):
    edges = spark.createDataFrame([(u, v, 1.0) for u, v in O.CLIQUES], "u long, v long, weight double")
    vectors = spark.createDataFrame([(i, list(z)) for i, z in O.CLIQUE_VECTORS], "node long, z array<double>")
    return detect(edges, vectors, Config(g=2, **config)).partition


def queries() -> dict[str, Query]:
    plain = (
        top_strength, graph_edges, graph_parallel_selfloop, phi_zero_vector, stable_sigmoid, centroids, embedding_zero_fill, weighted_degree, graph_totals, edge_reweight, weighted_totals,
        pairs_exhaustive, pairs_sampled, subsample_sorted, sample_size, kmeans_seed_quantile, kmeans_step, kmeans_fixed_iters, kmeans_wcss, kmeans_plusplus, silhouette_1d, gd_bin_means, gd_interp, calibration,
        node_comm_weight, penalty_join, penalty_exclude, best_move, contract_graph, supernode_stats, compose_labels, connected_components, edge_length, sssp, path_counts, edge_betweenness, rank_edges,
        split_delta, mga, mga_bulk, bgd, partition_sink, run_log, text_sources, dynamic_connectivity,
    )
    return {f.__name__: f for f in plain} | {
        "vec_dist": partial(_next_pairs, dist_sq=K.dist_sq, dist=K.vec_dist),
        "phi_cosine": partial(_next_pairs, phi=K.cosine_sim_01),
        "phi_pearson": partial(_next_pairs, phi=K.pearson_sim_01),
        "phi_sigmoid": partial(_next_pairs, phi=K.sigmoid_sim),
        "renumber": renumbered,
        "mga_cliques": cliques,
        "mga_bulk_cliques": partial(cliques, solver="bulk"),
        "bgd_cliques": partial(cliques, algorithm="BGD"),
        **{f"objective_{m}": partial(objective, m) for m in ("kmeans", "nog", "nokk2m", "nophi", "gaverage")},
    }


def oracle_sql() -> dict[str, str]:
    return O.oracle_sql()
