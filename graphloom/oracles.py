"""DuckDB SQL of the queries, composed of the same definitions as the graphs and kernels."""

from __future__ import annotations

from graphloom.model import Anchors
from graphloom.operators.pairs import PAIR_CAP, SUBSAMPLE_CAP

#: The fixed curve, partition and parameters that single-operator queries use.
ANCHORS = Anchors((1.1, 1.25, 1.4, 1.6), (0.70, 0.61, 0.52, 0.38))
GAMMA = 1.0
SEED = 42
SAMPLING = 0.3
CENTERS = (0.95, 1.2, 1.35, 1.45, 1.6)
#: Centers whose second and fourth bins are empty.
GAPPED = (0.2, 0.6, 1.2, 1.4, 3.0)
FIXED_K = 4
FIXED_ROUNDS = 5

E = "e AS (SELECT vec_id AS node, embedding::DOUBLE[] AS z FROM embeddings)"
COS = "list_dot_product(a.z, b.z) / (sqrt(list_dot_product(a.z, a.z)) * sqrt(list_dot_product(b.z, b.z)))"


def threshold(least: float) -> str:
    return f"{E}, g AS (SELECT a.node AS u, b.node AS v, 1.0::DOUBLE AS weight FROM e a JOIN e b ON a.node < b.node WHERE {COS} >= {least})"


G5 = f"""{E}, near AS (SELECT a.node AS u, b.node AS v, row_number() OVER (PARTITION BY a.node ORDER BY {COS} DESC, b.node) AS rank
  FROM e a JOIN e b ON a.node <> b.node AND a.node % 5 = b.node % 5),
g AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v, 1.0::DOUBLE AS weight FROM near WHERE rank <= 10)"""
SUP = """s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
g AS (SELECT a.l_suppkey AS u, b.l_suppkey AS v, count(*)::DOUBLE AS weight FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)"""
ADJ = "adj AS (SELECT u AS src, v AS dst, weight FROM g UNION ALL SELECT v, u, weight FROM g)"
DEG = "deg AS (SELECT src AS node, sum(weight) AS k FROM adj GROUP BY src)"


def cosine01(a: str, b: str) -> str:
    size = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(CASE WHEN {size} > 0 THEN greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / {size})) ELSE -1.0 END + 1) / 2"


def center(a: str) -> str:
    return f"list_transform({a}, lambda x: x - list_avg({a}))"


def sigmoid(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END"


def dist(a: str, b: str) -> str:
    return f"list_distance({a}, {b})"


def interp(d: str, anchors: Anchors = ANCHORS) -> str:
    c, m = anchors.centers, anchors.means
    steps = "".join(f" WHEN {d} < {c[i + 1]}::DOUBLE THEN {m[i]}::DOUBLE + ({d} - {c[i]}::DOUBLE) * (({m[i + 1]}::DOUBLE - {m[i]}::DOUBLE) / ({c[i + 1]}::DOUBLE - {c[i]}::DOUBLE))" for i in range(len(c) - 1))
    return f"CASE WHEN {d} <= {c[0]}::DOUBLE THEN {m[0]}::DOUBLE WHEN {d} >= {c[-1]}::DOUBLE THEN {m[-1]}::DOUBLE{steps} END"


def bins(d: str, mids: list[str]) -> str:
    return "CASE" + "".join(f" WHEN {d} < {m} THEN {i}" for i, m in enumerate(mids)) + f" ELSE {len(mids)} END"


def mids(centers: tuple[float, ...]) -> list[str]:
    return [f"({0.5 * (a + b)!r}::DOUBLE)" for a, b in zip(centers, centers[1:])]


RW = f"rw AS (SELECT src, dst, weight, {cosine01('a.z', 'b.z')} AS sim, weight * ({cosine01('a.z', 'b.z')}) AS w_uv FROM adj JOIN e a ON a.node = src JOIN e b ON b.node = dst)"
RW_PLAIN = RW.replace("weight * (", "weight * 1.0 + 0 * (")
TOT = "tot AS (SELECT sum(weight) AS two_m, sum(w_uv) AS two_m_w, avg(sim) AS g_average FROM rw)"
PART = "part AS (SELECT node, node % 7 AS community FROM deg)"
#: Draws of the seeded sample, from hex digits of md5; as many as the method looks at.
WANTED = f"least(trunc(n * (n - 1) / 2.0 * {SAMPLING}), {PAIR_CAP})::BIGINT"
DRAW = """many AS (SELECT n, {wanted} AS wanted FROM (SELECT count(*) AS n FROM e)),
d AS (SELECT r, ('0x' || substr(md5('{seed}:' || r || ':u'), 1, 8))::BIGINT % n AS u, ('0x' || substr(md5('{seed}:' || r || ':v'), 1, 8))::BIGINT % n AS v
  FROM (SELECT n, unnest(range(2 * wanted + 64)) AS r FROM many)),
pick AS (SELECT r, u, v FROM d WHERE u <> v ORDER BY r LIMIT (SELECT wanted FROM many)),
sam AS (SELECT r, u, v, list_distance(a.z, b.z) AS d, {cos} AS sim FROM pick JOIN e a ON a.node = u JOIN e b ON b.node = v)"""


def sample() -> str:
    return f"{E}, " + DRAW.format(seed=SEED, wanted=WANTED, cos=cosine01("a.z", "b.z"))


SUB = f"sub AS (SELECT r, d FROM sam ORDER BY md5('{SEED}:sub:' || r), r LIMIT {SUBSAMPLE_CAP})"


def lloyd_list(xs: str, c: str, k: str) -> str:
    """The centers after a round, of a list of values and a list of centers."""
    inside = f"lambda x: (j = 1 OR x >= ({c}[j - 1] + {c}[j]) / 2) AND (j = {k} OR x < ({c}[j] + {c}[j + 1]) / 2)"
    return f"list_sort(list_transform(range(1, {k} + 1), lambda j: coalesce(list_avg(list_filter({xs}, {inside})), {c}[j])))"


def quantile_list(xs: str, k: str) -> str:
    at = f"((j + 0.5) / {k} * (len({xs}) - 1))"
    return f"list_transform(range(0, {k}), lambda j: {xs}[floor({at})::INT + 1] + ({at} - floor({at})) * ({xs}[floor({at})::INT + 2] - {xs}[floor({at})::INT + 1]))"


def plusplus_sql() -> str:
    """The race of each center, one after the other."""
    parts = []
    for i in range(FIXED_K):
        u = f"((('0x' || substr(md5('{SEED}:{i}:' || r), 1, 8))::BIGINT + 0.5) / {1 << 32}.0)"
        w = "least(" + ", ".join(f"(d - s{j}.c) ^ 2" for j in range(i)) + ")" if i else "1.0"
        parts.append(f"s{i} AS (SELECT arg_min(d, -ln(u) / w) AS c FROM (SELECT d, {u} AS u, {w} AS w FROM sam{''.join(f', s{j}' for j in range(i))}) WHERE w > 0)")
    picked = ", ".join(f"(SELECT c FROM s{i})" for i in range(FIXED_K))
    return f"WITH {sample()}, {', '.join(parts)}, c AS (SELECT list_sort([{picked}]) AS c) SELECT i - 1 AS c, round(c.c[i], 6) AS center FROM c, range(1, {FIXED_K + 1}) t(i)"


def calibration_sql() -> str:
    """k by silhouette over the subsample, then the centers and mean similarities of all distances."""
    which = lambda c, d: f"len(list_filter(range(1, k), lambda j: {d} >= ({c}[j] + {c}[j + 1]) / 2))"
    return f"""WITH RECURSIVE {sample()}, {SUB}, few AS (SELECT list(d ORDER BY d) AS xs FROM sub), most AS (SELECT list(d ORDER BY d) AS xs FROM sam),
ks AS (SELECT k, xs FROM few, range(2, 16) t(k)),
km AS (SELECT k, 0 AS i, {quantile_list('xs', 'k')} AS c FROM ks UNION ALL SELECT km.k, i + 1, {lloyd_list('xs', 'c', 'km.k')} FROM km JOIN ks ON ks.k = km.k WHERE i < 29),
placed AS (SELECT k, r, d, {which('c', 'd')} AS b FROM km, sub WHERE i = 29),
bin AS (SELECT k, b, count(*) AS m, avg(d) AS mean FROM placed GROUP BY ALL),
own AS (SELECT x.k, x.r, x.b, any_value(x.d) AS d, sum(abs(x.d - y.d)) / (count(*) - 1) AS a FROM placed x JOIN placed y ON x.k = y.k AND x.b = y.b GROUP BY x.k, x.r, x.b HAVING count(*) > 1),
near AS (SELECT own.k, r, any_value(a) AS a, min(abs(d - mean)) AS o FROM own JOIN bin ON bin.k = own.k AND bin.b <> own.b GROUP BY own.k, r),
best AS (SELECT k FROM (SELECT k, avg(CASE WHEN greatest(a, o) > 0 THEN (o - a) / greatest(a, o) ELSE 0 END) AS score FROM near GROUP BY k) ORDER BY score DESC, k LIMIT 1),
kf AS (SELECT k, 0 AS i, {quantile_list('xs', 'k')} AS c FROM best, most UNION ALL SELECT k, i + 1, {lloyd_list('xs', 'c', 'k')} FROM kf, most WHERE i < 50),
fin AS (SELECT k, c FROM kf WHERE i = 50),
per AS (SELECT {which('c', 'd')} AS b, avg(sim) AS m FROM sam, fin GROUP BY 1),
every AS (SELECT j - 1 AS b, c[j] AS center FROM (SELECT c, unnest(range(1, k + 1)) AS j FROM fin))
SELECT b::INT AS c, round(center, 6) AS center, round(coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY b), 0), 6) AS mean_sim FROM every LEFT JOIN per USING (b)"""


def connectivity_sql() -> str:
    """Reachability over the edges that are there after each step."""
    ops = ", ".join(f"({t}, '{op}', {u}, {v})" for t, (op, u, v) in enumerate(CONNECTIVITY))
    return f"""WITH RECURSIVE ops AS (SELECT * FROM (VALUES {ops}) t(step, op, u, v)), node AS (SELECT DISTINCT unnest([u, v]) AS x FROM ops),
last AS (SELECT t.step AS t, o.u, o.v, arg_max(o.op, o.step) AS op FROM ops t JOIN ops o ON o.step <= t.step AND o.op <> 'ask' GROUP BY ALL),
link AS (SELECT t, u, v FROM last WHERE op = 'insert' UNION ALL SELECT t, v, u FROM last WHERE op = 'insert'),
reach AS (SELECT step AS t, x AS a, x AS b FROM ops, node UNION SELECT reach.t, a, v FROM reach JOIN link ON link.t = reach.t AND link.u = b),
low AS (SELECT t, a, min(b) AS root FROM reach GROUP BY ALL)
SELECT step, op, ops.u, ops.v, x.root = y.root AS connected, (SELECT count(DISTINCT root) FROM low WHERE low.t = step) AS components
FROM ops JOIN low x ON x.t = step AND x.a = ops.u JOIN low y ON y.t = step AND y.a = ops.v"""


def literal_rows(rows: list[tuple], names: str) -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") t({names})"


def objective(mode: str) -> str:
    g = {"nog": "1.0", "gaverage": "g_average"}.get(mode, interp("list_distance(a.z, b.z)"))
    p = f"{GAMMA} * ({g})" + ("" if mode == "nokk2m" else " * da.k * db.k / two_m")
    return f"""WITH {G5}, {ADJ}, {DEG}, {RW_PLAIN if mode == 'nophi' else RW}, {TOT}, {PART},
w AS (SELECT coalesce(sum(w_uv), 0) AS within FROM rw JOIN part a ON a.node = src JOIN part b ON b.node = dst WHERE a.community = b.community),
p AS (SELECT 2 * sum({p}) AS penalty FROM part pa JOIN part pb ON pa.community = pb.community AND pa.node < pb.node
  JOIN e a ON a.node = pa.node JOIN e b ON b.node = pb.node JOIN deg da ON da.node = pa.node JOIN deg db ON db.node = pb.node, tot)
SELECT round(within, 4) AS within_weight, round(penalty, 4) AS pair_penalty, round((within - penalty) / two_m_w, 6) AS q FROM w, p, tot"""


STATS = f"""{G5}, {ADJ}, {DEG}, {RW}, {TOT}, {PART},
csum AS (SELECT community, sum(k) AS sum_k, count(*) AS cnt FROM part JOIN deg USING (node) GROUP BY community),
cz AS (SELECT community, i, sum(z[i]) AS x FROM part JOIN e USING (node), range(1, 65) t(i) GROUP BY ALL),
comm AS (SELECT community, sum_k, cnt, sum_z FROM csum JOIN (SELECT community, list(x ORDER BY i) AS sum_z FROM cz GROUP BY community) USING (community)),
ncw AS (SELECT src AS node, community, sum(w_uv) AS w FROM rw JOIN part ON part.node = dst GROUP BY ALL),
cand AS (SELECT n.node, p.community AS own, n.community, n.w, {GAMMA} / two_m * d.k * c.sum_k * ({interp("list_distance(e.z, list_transform(c.sum_z, lambda x: x / c.cnt))")}) AS pen
  FROM ncw n JOIN part p USING (node) JOIN deg d ON d.node = n.node JOIN e ON e.node = n.node JOIN comm c ON c.community = n.community, tot WHERE n.community <> p.community),
stay AS (SELECT p.node, p.community, CASE WHEN c.cnt <= 1 THEN 0 ELSE {GAMMA} / two_m * d.k * (c.sum_k - d.k) * ({interp("list_distance(e.z, list_transform(list_zip(c.sum_z, e.z), lambda x: (x[1] - x[2]) / (c.cnt - 1)))")}) END AS pen, coalesce(n.w, 0) AS w
  FROM part p JOIN deg d USING (node) JOIN e ON e.node = p.node JOIN comm c ON c.community = p.community LEFT JOIN ncw n ON n.node = p.node AND n.community = p.community, tot)"""

#: Every simple path between two nodes; the shortest of them, within the tolerance, count.
PATHS = f"""RECURSIVE {threshold(0.40)}, {ADJ}, {RW},
len AS (SELECT src, dst, 1 / (1e-8 + w_uv) AS l FROM rw),
p AS (SELECT src AS s, src AS v, 0.0::DOUBLE AS d, [src] AS path FROM (SELECT DISTINCT src FROM len)
  UNION ALL SELECT s, dst, d + l, list_append(path, dst) FROM p JOIN len ON src = v WHERE NOT list_contains(path, dst)),
best AS (SELECT s, v, min(d) AS dist FROM p GROUP BY ALL),
short AS (SELECT p.s, p.v, path, count(*) OVER (PARTITION BY p.s, p.v) AS n FROM p JOIN best USING (s, v) WHERE d < dist + 1e-12)"""


def lloyd_chain() -> str:
    """Quantile seeds and then unrolled rounds, each a pair of CTEs."""
    qs = ", ".join(f"quantile_cont(d, {(i + 0.5) / FIXED_K!r})" for i in range(FIXED_K))
    parts = [f"c0 AS (SELECT [{qs}] AS c FROM sam)"]
    for r in range(FIXED_ROUNDS):
        case = bins("d", [f"0.5 * (c[{i + 1}] + c[{i + 2}])" for i in range(FIXED_K - 1)])
        parts.append(f"b{r} AS (SELECT {case} AS b, avg(d) AS m FROM sam, c{r} GROUP BY 1)")
        parts.append(f"c{r + 1} AS (SELECT list_sort([{', '.join(f'coalesce((SELECT m FROM b{r} WHERE b = {i}), c[{i + 1}])' for i in range(FIXED_K))}]) AS c FROM c{r})")
    return ", ".join(parts)


LITERAL_EDGES = ((1, 2, 1.0), (2, 3, 2.0), (2, 1, 4.0), (3, 3, 5.0), (4, 1, 0.5), (1, 2, 0.25))
LITERAL = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {u}, {v}, {w}::DOUBLE)" for i, (u, v, w) in enumerate(LITERAL_EDGES)) + ") t(line, u, v, weight))"


#: Two cliques of five with one edge between them, and a vector for each clique.
CLIQUES = tuple((a, b) for g in (range(5), range(5, 10)) for a in g for b in g if a < b) + ((4, 5),)
CLIQUE_VECTORS = tuple((i, (1.0, 0.0) if i < 5 else (0.0, 1.0)) for i in range(10))
#: Steps on a graph that gains and loses edges.
CONNECTIVITY = (
    ("insert", 1, 2), ("insert", 2, 3), ("insert", 3, 1), ("ask", 1, 4), ("insert", 4, 5), ("insert", 3, 4), ("ask", 1, 5), ("delete", 1, 2), ("delete", 3, 4), ("ask", 1, 5), ("ask", 1, 2),
    ("insert", 5, 1), ("delete", 2, 3), ("ask", 2, 5), ("ask", 4, 3), ("delete", 3, 1), ("insert", 2, 3), ("insert", 3, 4), ("ask", 2, 1), ("delete", 4, 5), ("ask", 2, 1),
)
#: An edge list and a vector file with the cases that readers have to stand, and what they hold.
NETWORK = ("a b", "b c 2.5", "", "   ", "c  a\t0.5x", "lone", "a b 4", "d d -1e1 more")
EMBEDDING = ("a 1 2", "", "b 3 4 5", "c 0.5 -1", "a 7 8", "e 1", "d 2 2 2")
READ_ROWS = [("a", "b", 0, 1, 1.0, 7.0, None), ("b", "c", 1, 2, 2.5, None, 0.5), ("c", "a", 2, 0, 0.5, 0.5, 7.0), ("lone", "", 3, 4, 1.0, None, None), ("a", "b", 0, 1, 4.0, 7.0, None), ("d", "d", 5, 5, -10.0, None, None)]
#: The runs of the log: (network, gamma, number of g).
RUNS = (("T35", 1.0, 2), ("T35", 1.0, 2), ("T35", 0.5, 5), ("T35", 1.0, 2))


def runs_sql() -> str:
    mode = {2: "nog", 5: "gaverage"}
    rows, seen = [], {}
    for network, gamma, g in RUNS:
        folder = f"{network}_MGA_cosine_g{mode[g]}_bin5_gamma{gamma:g}_samp0.3"
        seen[folder] = seen.get(folder, 0) + 1
        rows.append((network, "MGA", "cosine", f"{gamma:g}", "0.3", mode[g], 5, seen[folder], folder))
    return literal_rows(rows, "Dataset, Algorithm, Phi, Gamma, Sampling, Bin_Method, Bin_Num, Idx, Run_Dir")


def adjacent_pairs(select: str) -> str:
    return f"WITH {E} SELECT a.node AS u, b.node AS v, {select} FROM e a JOIN e b ON b.node = a.node + 1"


def oracle_sql() -> dict[str, str]:
    zero = "list_transform(a.z, lambda x: x * 0)"
    return {
        "top_strength": f"WITH {threshold(0.35)}, {ADJ}, {RW} SELECT node, round(strength, 6) AS strength FROM (SELECT src AS node, sum(w_uv) AS strength FROM rw GROUP BY src ORDER BY strength DESC, node LIMIT 20)",
        "graph_edges": f"WITH {threshold(0.35)}, {ADJ} SELECT src, dst, weight FROM adj",
        "graph_parallel_selfloop": f"""WITH {LITERAL}, {ADJ}, {DEG},
simple AS (SELECT least(u, v) AS u, greatest(u, v) AS v, arg_max(1 / (1e-8 + weight), line) AS len FROM g WHERE u <> v GROUP BY 1, 2),
seen AS (SELECT node, row_number() OVER (ORDER BY min(place)) - 1 AS number FROM (SELECT u AS node, 2 * line AS place FROM g UNION ALL SELECT v, 2 * line + 1 FROM g) GROUP BY node)
SELECT 'degree' AS what, node AS a, node AS b, round(k, 6) AS x FROM deg UNION ALL SELECT 'length', u, v, round(len, 6) FROM simple UNION ALL SELECT 'number', node, number, 0 FROM seen""",
        "vec_dist": adjacent_pairs("round(list_distance(a.z, b.z) ^ 2, 6) AS dist_sq, round(list_distance(a.z, b.z), 6) AS dist"),
        "phi_cosine": adjacent_pairs(f"round({cosine01('a.z', 'b.z')}, 6) AS phi"),
        "phi_pearson": adjacent_pairs(f"round({cosine01(center('a.z'), center('b.z'))}, 6) AS phi"),
        "phi_sigmoid": adjacent_pairs(f"round({sigmoid('list_dot_product(a.z, b.z)')}, 6) AS phi"),
        "phi_zero_vector": adjacent_pairs(f"round({cosine01(zero, 'b.z')}, 6) AS cosine, round({cosine01(center(zero), center('b.z'))}, 6) AS pearson, round({sigmoid(f'list_dot_product({zero}, b.z)')}, 6) AS sigmoid"),
        "stable_sigmoid": f"SELECT i AS x, round({sigmoid('i::DOUBLE')}, 9) AS y FROM range(-800, 801, 50) t(i)",
        "centroids": f"WITH {E} SELECT a.node, round(list_sum(list_transform(a.z, lambda x: x / 3)), 6) AS plain, round(list_sum(list_transform(list_zip(a.z, b.z), lambda x: (x[1] - x[2]) / (3 - 1))), 6) AS without FROM e a JOIN e b ON b.node = a.node + 1",
        "embedding_zero_fill": f"WITH {SUP}, {E}, have AS (SELECT * FROM e WHERE node % 3 <> 0), n AS (SELECT u AS node FROM g UNION SELECT v FROM g) SELECT n.node, round(coalesce(list_sum(z), 0), 6) AS total, coalesce(len(z), 64) AS width, z IS NULL AS filled FROM n LEFT JOIN have USING (node)",
        "weighted_degree": f"WITH {SUP}, {ADJ}, {DEG} SELECT node, k FROM deg",
        "graph_totals": f"WITH {SUP}, {ADJ} SELECT sum(weight) AS two_m FROM adj",
        "edge_reweight": f"WITH {threshold(0.35)}, {ADJ}, {RW} SELECT src, dst, weight, round(sim, 6) AS sim, round(w_uv, 6) AS w_uv FROM rw",
        "weighted_totals": f"WITH {threshold(0.35)}, {ADJ}, {RW}, {TOT} SELECT round(two_m, 4) AS two_m, round(two_m_w, 4) AS two_m_w, round(g_average, 6) AS g_average FROM tot",
        "pairs_exhaustive": f"WITH {E} SELECT a.node AS u, b.node AS v, round(list_distance(a.z, b.z), 6) AS d, round({cosine01('a.z', 'b.z')}, 6) AS sim FROM e a JOIN e b ON a.node < b.node",
        "pairs_sampled": f"WITH {sample()} SELECT r, u, v, round(d, 6) AS d, round(sim, 6) AS sim FROM sam",
        "subsample_sorted": f"WITH {sample()}, {SUB} SELECT r, round(d, 6) AS d FROM sub",
        "sample_size": f"SELECT n, {WANTED} AS wanted FROM (SELECT count(*) AS n FROM embeddings)",
        "kmeans_plusplus": plusplus_sql(),
        "calibration": calibration_sql(),
        "run_log": runs_sql(),
        "text_sources": literal_rows(READ_ROWS, "u_name, v_name, u, v, weight, zu, zv"),
        "dynamic_connectivity": connectivity_sql(),
        **{n: literal_rows([(i, i // 5) for i in range(10)], "node, community") for n in ("mga_cliques", "mga_bulk_cliques", "bgd_cliques")},
        "kmeans_seed_quantile": f"WITH {sample()}, c AS (SELECT [{', '.join(f'quantile_cont(d, {(i + 0.5) / FIXED_K!r})' for i in range(FIXED_K))}] AS c FROM sam) SELECT i - 1 AS c, round(c.c[i], 6) AS center FROM c, range(1, {FIXED_K + 1}) t(i)",
        "kmeans_step": f"WITH {sample()} SELECT {bins('d', mids(CENTERS))} AS c, round(avg(d), 6) AS center, count(*) AS n FROM sam GROUP BY 1",
        "kmeans_fixed_iters": f"WITH {sample()}, {lloyd_chain()} SELECT i - 1 AS c, round(c[i], 6) AS center FROM c{FIXED_ROUNDS}, range(1, {FIXED_K + 1}) t(i)",
        "kmeans_wcss": f"WITH {sample()}, b AS (SELECT d, {bins('d', mids(CENTERS))} AS c FROM sam) SELECT round(sum((d - ([{', '.join(f'{c}::DOUBLE' for c in CENTERS)}])[c + 1]) ^ 2), 4) AS wcss FROM b",
        "silhouette_1d": f"""WITH {sample()}, {SUB}, x AS (SELECT r, d, {bins('d', mids(CENTERS))} AS c FROM sub), size AS (SELECT c, count(*) AS m FROM x GROUP BY c),
pair AS (SELECT a.r, a.c, b.c AS other, sum(abs(a.d - b.d)) AS total, count(*) AS n FROM x a CROSS JOIN x b GROUP BY ALL),
ab AS (SELECT r, max(CASE WHEN pair.c = other THEN total / (n - 1) END) AS a, min(CASE WHEN pair.c <> other THEN total / n END) AS b FROM pair JOIN size ON size.c = pair.c WHERE m > 1 GROUP BY r)
SELECT round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS score FROM ab""",
        "gd_bin_means": f"""WITH {sample()}, per AS (SELECT {bins('d', mids(GAPPED))} AS c, avg(sim) AS m FROM sam GROUP BY 1), every AS (SELECT i AS c, ([{', '.join(f'{c}::DOUBLE' for c in GAPPED)}])[i + 1] AS center FROM range({len(GAPPED)}) t(i))
SELECT c, center, round(coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY c), 0), 6) AS mean_sim FROM every LEFT JOIN per USING (c)""",
        "gd_interp": f"WITH {sample()} SELECT r, round({interp('d')}, 6) AS g FROM sam",
        **{f"objective_{mode}": objective(mode) for mode in ("kmeans", "nog", "nokk2m", "nophi", "gaverage")},
        "node_comm_weight": f"WITH {STATS} SELECT node, community, round(w, 6) AS w FROM ncw",
        "penalty_join": f"WITH {STATS} SELECT node, community, round(pen, 6) AS penalty FROM cand",
        "penalty_exclude": f"WITH {STATS} SELECT node, community, round(pen, 6) AS penalty FROM stay",
        "best_move": f"""WITH {STATS}, gain AS (SELECT c.node, c.own, c.community, c.w - c.pen AS gain, s.w - s.pen AS stay FROM cand c JOIN stay s USING (node)),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, community) AS rank FROM gain WHERE gain > stay) SELECT node, own, community, round(gain, 6) AS gain, round(stay, 6) AS stay FROM r WHERE rank = 1""",
        "contract_graph": f"WITH {STATS} SELECT least(a.community, b.community) AS u, greatest(a.community, b.community) AS v, round(sum(w_uv) / 2, 4) AS w_uv FROM rw JOIN part a ON a.node = src JOIN part b ON b.node = dst WHERE a.community <> b.community GROUP BY 1, 2",
        "supernode_stats": f"WITH {STATS} SELECT community, round(sum_k, 4) AS sum_k, cnt, i - 1 AS pos, round(sum_z[i], 6) AS x FROM comm, range(1, 65) t(i)",
        "compose_labels": f"WITH {G5}, {ADJ}, {DEG}, {PART} SELECT node, community % 3 AS community FROM part",
        "renumber": f"WITH {G5}, {ADJ}, {DEG} SELECT node, dense_rank() OVER (ORDER BY node % 7 * 10 + 3) - 1 AS community FROM deg",
        "connected_components": f"WITH RECURSIVE {threshold(0.35)}, {ADJ}, r AS (SELECT src AS node, src AS c FROM adj UNION SELECT dst, c FROM r JOIN adj ON src = node) SELECT node, min(c) AS component FROM r GROUP BY node",
        "edge_length": f"WITH {threshold(0.35)}, {ADJ}, {RW} SELECT src AS u, dst AS v, round(1 / (1e-8 + w_uv), 6) AS len FROM rw WHERE src < dst",
        "sssp": f"WITH {PATHS} SELECT s, v, round(dist, 6) AS dist FROM best",
        "path_counts": f"WITH {PATHS} SELECT s, v, max(n)::DOUBLE AS sigma FROM short GROUP BY ALL",
        "edge_betweenness": f"""WITH {PATHS}, step AS (SELECT path[i] AS a, path[i + 1] AS b, 1.0 / n AS share FROM short, range(1, 1000) t(i) WHERE i < len(path))
SELECT least(a, b) AS u, greatest(a, b) AS v, round(sum(share), 6) AS bet FROM step GROUP BY 1, 2""",
        "split_delta": f"""WITH {G5}, {ADJ}, {DEG}, {RW}, {TOT}, side AS (SELECT node, CASE WHEN node % 10 < 4 THEN 1 ELSE 2 END AS s FROM deg),
cut AS (SELECT sum(w_uv) AS w FROM rw JOIN side a ON a.node = src JOIN side b ON b.node = dst WHERE a.s = 1 AND b.s = 2),
crossed AS (SELECT sum({GAMMA} * da.k * db.k / two_m * ({interp('list_distance(x.z, y.z)')})) AS p FROM side a JOIN side b ON a.s = 1 AND b.s = 2 JOIN e x ON x.node = a.node JOIN e y ON y.node = b.node JOIN deg da ON da.node = a.node JOIN deg db ON db.node = b.node, tot)
SELECT round(-2 * w, 4) AS weight_change, round(-2 * p, 4) AS penalty_change FROM cut, crossed""",
        "rank_edges": f"""WITH {PATHS}, step AS (SELECT path[i] AS a, path[i + 1] AS b, 1.0 / n AS share FROM short, range(1, 1000) t(i) WHERE i < len(path)),
bet AS (SELECT least(a, b) AS u, greatest(a, b) AS v, round(sum(share), 6) AS bet FROM step GROUP BY 1, 2) SELECT u, v, bet, row_number() OVER (ORDER BY bet DESC, u, v) AS rank FROM bet""",
        "partition_sink": f"WITH {threshold(0.35)}, {ADJ}, {DEG} SELECT 'n' || node || ' ' || node % 7 AS value FROM deg",
    }
