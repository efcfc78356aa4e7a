"""Pairs of nodes: all of them, or a seeded sample.

``vectors(node, z)``. All pairs are worked out a pair of blocks at a time: nodes are dealt
to blocks by a hash, a block is one row with its vectors packed, each pair of blocks meets
in one place (a pair (i, j) with i <= j once), and numpy works on runs of rows of the two
matrices. The number of blocks follows the size of the vectors and the cores, the pairs of blocks are spread
over tasks by an explicit repartition, and only what the caller's function returns leaves
a pair of blocks: a sum, the pairs over a threshold, the nearest few. Sums over dimensions
run in order, one dimension at a time, so a value does not depend on where its pair is.

Samples come from md5 of (seed, draw), so every engine draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.functions import kernels as K
from graphloom.operators.numbering import dense_number
from graphloom.storage import partitions

PAIR_CAP = 5_000_000
SUBSAMPLE_CAP = 5_000
#: Numbers in a block's vectors, and the fewest rows for which a block is cut to give more cores work.
PACK, LEAST_BLOCK = 1 << 20, 128
#: Rows of a block that the caller's function gets at a time.
BLOCK = 1_024
#: Rows of those that are worked on at a time, and chunks in which draws are counted.
TILE, DRAW_CHUNKS = 256, 4_096
#: Links whose vectors are laid side by side at a time.
LINKS = 4_096
#: How far a product of matrices can be from a sum in order, with room to spare.
ROUGH = 1e-9


def sample_size(n: int, sampling: float, cap: int = PAIR_CAP) -> tuple[int, bool]:
    """(number of pairs to look at, whether these are all there are)."""
    every = n * (n - 1) // 2
    wanted = min(int(every * sampling), cap)
    return (every, True) if every <= wanted else (wanted, False)


class Block:
    """Rows of a block in order of node: ``node``, ``z`` (a matrix) and the other columns by name."""

    def __init__(self, rows: pa.StructScalar) -> None:
        fields = rows.values
        order = np.argsort(fields.field("node").to_numpy(zero_copy_only=False), kind="stable")
        self.columns = {f.name: fields.field(f.name).to_numpy(zero_copy_only=False)[order] for f in fields.type if f.name != "z"}
        self.node = self.columns["node"]
        flat = fields.field("z").flatten().to_numpy(zero_copy_only=False)
        self.z = flat.reshape(len(order), -1)[order]

    def __len__(self) -> int:
        return len(self.node)

    def tiles(self) -> list[Block]:
        """The block in runs of up to ``BLOCK`` rows."""
        if len(self) <= BLOCK:
            return [self]
        out = []
        for i in range(0, len(self), BLOCK):
            part = object.__new__(Block)
            part.columns = {k: x[i : i + BLOCK] for k, x in self.columns.items()}
            part.node, part.z = part.columns["node"], self.z[i : i + BLOCK]
            out.append(part)
        return out


def _summed(a: np.ndarray, b: np.ndarray, step: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for i in range(0, len(a), TILE):
        part, acc = a[i : i + TILE], out[i : i + TILE]
        held = np.empty_like(acc)
        for d in range(a.shape[1]):
            step(part[:, d, None], columns[d][None, :], held)
            acc += held
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of a with all rows of b."""
    return _summed(a, b, lambda x, y, out: np.multiply(x, y, out=out))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a from all rows of b."""

    def step(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
        np.subtract(x, y, out=out)
        np.multiply(out, out, out=out)

    return np.sqrt(_summed(a, b, step))


def similarities(phi: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``kernels.similarity``, for all rows of a with all rows of b."""
    if phi == "sigmoid":
        x = dots(a, b)
        e = np.exp(-np.abs(x))
        return np.where(x >= 0, 1 / (1 + e), e / (1 + e))
    if phi == "pearson":
        a, b = (x - (np.cumsum(x, axis=1)[:, -1:] / x.shape[1]) for x in (a, b))
    norm = lambda x: np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    size = norm(a)[:, None] * norm(b)[None, :]
    raw = np.clip(dots(a, b) / np.where(size > 0, size, 1.0), -1.0, 1.0)
    return (np.where(size > 0, raw, -1.0) + 1) / 2


def _blocks(rows: DataFrame, within: str | None, size: int | None) -> tuple[DataFrame, int | None]:
    """``(w, n, i, rows)``: block i of the n of group w; and n where there are no groups. A
    block has up to some ``size`` rows, ``PACK`` numbers unless that is given: rows travel to
    every block that theirs meets, so few large blocks travel least."""
    n, r = None, F.struct("node", "z", *[c for c in rows.columns if c not in ("node", "z")]).alias("r")
    most = F.lit(size) if size else F.greatest(F.floor(F.lit(PACK) / F.greatest(F.max(F.size("z")), F.lit(1))), F.lit(1))
    if within is None:
        found, cores = rows.agg(F.count("*").alias("n"), most.alias("most")).first(), rows.sparkSession.sparkContext.defaultParallelism
        n = found["n"]
        n = max(1, -(-n // (found["most"] or 1)), min(-(-n // LEAST_BLOCK), math.isqrt(16 * cores) + 1))
        dealt = rows.select(F.lit(0).cast("long").alias("w"), F.lit(n).alias("n"), r)
    else:
        sizes = rows.groupBy(F.col(within).alias("w")).agg(F.ceil(F.count("*") / F.least(most, F.lit(size or BLOCK))).cast("int").alias("n"))
        dealt = rows.join(sizes, F.col(within) == F.col("w")).select(F.col("w").cast("long").alias("w"), "n", r)
    return dealt.groupBy("w", "n", F.pmod(F.xxhash64("r.node"), F.col("n")).cast("int").alias("i")).agg(F.collect_list("r").alias("rows")), n


def _tiled(a: Block, b: Block, same: bool, fn: Callable[[Block, Block, bool], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """What ``fn`` returns for every two runs of rows of two blocks."""
    for i, x in enumerate(a.tiles()):
        for j, y in enumerate(b.tiles()):
            if (not same or i <= j) and (out := fn(x, y, same and i == j)) is not None:
                yield from out.to_batches()


def _met(blocks: DataFrame, meetings: int | None, fn: Callable[[Block, Block, bool], pa.Table | None], schema: str) -> DataFrame:
    """``fn`` of every two blocks of ``(w, p, q, side, rows)`` with one (w, p, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, None
        for batch in batches:
            w, p, q, side = (batch.column(c).to_pylist() for c in ("w", "p", "q", "side"))
            for k, rows in enumerate(batch.column("rows")):
                where, block = (w[k], p[k], q[k]), Block(rows)
                if side[k] == 2:
                    yield from _tiled(block, block, True, fn)
                elif side[k] == 0:
                    first, held = where, block
                elif first == where:
                    yield from _tiled(held, block, False, fn)

    spark = blocks.sparkSession
    tasks = max(partitions(spark), spark.sparkContext.defaultParallelism) * (16 if meetings else 4)
    spread = blocks.repartition(min(tasks, 2 * meetings) if meetings else tasks, "w", "p", "q")
    return spread.sortWithinPartitions("w", "p", "q", "side").mapInArrow(run, schema)


def pairs_of_blocks(rows: DataFrame, fn: Callable[[Block, Block, bool], pa.Table | None], schema: str, within: str | None = None, size: int | None = None) -> DataFrame:
    """The tables that ``fn(a, b, same)`` returns for every two runs of up to ``BLOCK`` rows of
    ``rows(node, z, ...)`` (of one value of ``within``), and for each with itself (``same``). Rows without a
    vector or a node are left out."""
    blocks, n = _blocks(rows.filter("node is not null and z is not null"), within, size)
    i, j = F.col("i"), F.col("j")
    meets = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    side = F.when(i == j, 2).otherwise((i > j).cast("int"))
    return _met(meets.select("w", F.least(i, j).alias("p"), F.greatest(i, j).alias("q"), side.alias("side"), "rows"), n and n * (n + 1) // 2, fn, schema)


def pairs_across(left: DataFrame, right: DataFrame, fn: Callable[[Block, Block, bool], pa.Table | None], schema: str, size: int | None = None) -> DataFrame:
    """As ``pairs_of_blocks`` for every block of ``left`` with every block of ``right``."""
    (one, m), (two, n) = (_blocks(x.filter("node is not null and z is not null"), None, size) for x in (left, right))
    every_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = one.select("w", F.col("i").alias("p"), every_of(n).alias("q"), F.lit(0).alias("side"), "rows")
    two = two.select("w", every_of(m).alias("p"), F.col("i").alias("q"), F.lit(1).alias("side"), "rows")
    return _met(one.unionByName(two), m * n, fn, schema)


def every(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of all pairs, of a block with itself each once."""
    if same:
        return np.triu_indices(len(a), 1)
    return np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))


def ends(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of pairs at positions i in a and j in b, u the smaller."""
    x, y = a.node[i], b.node[j]
    return np.minimum(x, y), np.maximum(x, y)


def pair_rows(vectors: DataFrame, phi: str, size: int | None = None) -> DataFrame:
    """``(u, v, d, sim)`` of all pairs, u < v."""

    def run(a: Block, b: Block, same: bool) -> pa.Table:
        i, j = every(a, b, same)
        u, v = ends(a, b, i, j)
        return pa.table({"u": u, "v": v, "d": distances(a.z, b.z)[i, j], "sim": similarities(phi, a.z, b.z)[i, j]})

    return pairs_of_blocks(vectors.select("node", "z"), run, "u long, v long, d double, sim double", size=size)


def cosines(a: Block, b: Block) -> np.ndarray:
    """Cosines of all rows of a with all rows of b; norms are taken once a vector."""
    norm = lambda x: np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    with np.errstate(invalid="ignore"):  # a zero vector has no cosine
        return dots(a.z, b.z) / (norm(a.z)[:, None] * norm(b.z)[None, :])


def _near(a: Block, b: Block, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs whose cosine can be ``least`` or more, by a product of matrices:
    its sums are in no known order, so they only leave out what is far below."""
    with np.errstate(all="ignore"):
        one, two = (x.z / np.sqrt(np.cumsum(x.z * x.z, axis=1)[:, -1:]) for x in (a, b))
        return np.nonzero(~(one @ two.T < least - ROUGH))


def _cosines_at(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``cosines`` of pairs at positions i in a and j in b, to the last bit."""
    norm = lambda x: np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    with np.errstate(all="ignore"):
        return np.cumsum(a.z[i] * b.z[j], axis=1)[:, -1] / (norm(a.z)[i] * norm(b.z)[j])


def similar_links(links: DataFrame, vectors: DataFrame, phi: str) -> DataFrame:
    """``links(src, dst, weight)`` with ``sim``, that of the vectors of the ends; links without
    both go. A link travels once, to where the blocks of its ends meet, and brings no vector."""
    blocks, n = _blocks(vectors.filter("node is not null and z is not null").select("node", "z"), None, None)
    block_of = lambda c: F.pmod(F.xxhash64(F.col(c).cast(vectors.schema["node"].dataType)), F.lit(n)).cast("int")
    place = lambda a, b: (F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    i, j = F.col("i"), F.col("j")
    meets = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).select(*place(i, j), "rows").repartition(n * (n + 1), "p", "q")
    names = ["src", "dst", "weight"]
    dealt = links.filter("src is not null and dst is not null").select(*place(block_of("src"), block_of("dst")), *names).repartition(n * (n + 1), "p", "q")
    kinds = [links.schema[c].dataType.simpleString() for c in names]
    out = pa.schema([*zip(names, to_arrow_schema(links.select(*names).schema).types), ("sim", pa.float64())])

    def run(mine: pa.Table, met: pa.Table) -> pa.Table:
        if not (mine.num_rows and met.num_rows):
            return out.empty_table()
        ends_, parts = _Ends(phi, [Block(x) for x in met.column("rows")]), []
        for batch in mine.select(names).to_batches(LINKS):
            keep, sim = ends_.similarity(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst")))
            parts.append(pa.Table.from_arrays([*batch.filter(pa.array(keep)).columns, pa.array(sim, pa.float64())], schema=out))
        return pa.concat_tables(parts)

    return dealt.groupBy("p", "q").cogroup(meets.groupBy("p", "q")).applyInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds)) + ", sim double")


class _Ends:
    """Vectors of blocks by node, with similarities as ``kernels.similarity_of`` has them."""

    def __init__(self, phi: str, blocks: list[Block]) -> None:
        node, z = np.concatenate([b.node for b in blocks]), np.concatenate([b.z for b in blocks])
        order = np.argsort(node, kind="stable")
        self.phi, self.node, self.z = phi, node[order], z[order]
        if phi == "pearson":
            self.z = self.z - np.cumsum(self.z, axis=1)[:, -1:] / self.z.shape[1]
        self.size = np.sqrt(np.cumsum(self.z * self.z, axis=1)[:, -1])

    def similarity(self, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which links have both ends here, their similarities)."""
        i, j = (np.minimum(np.searchsorted(self.node, x), len(self.node) - 1) for x in (src, dst))
        keep = (self.node[i] == src) & (self.node[j] == dst)
        i, j = i[keep], j[keep]
        x = np.cumsum(self.z[i] * self.z[j], axis=1)[:, -1]
        if self.phi == "sigmoid":
            e = np.exp(-np.abs(x))
            return keep, np.where(x >= 0, 1 / (1 + e), e / (1 + e))
        size = self.size[i] * self.size[j]
        with np.errstate(all="ignore"):
            raw = x / size
        raw = np.where(np.isnan(raw), 1.0, np.clip(raw, -1.0, 1.0))  # Spark has NaN above all numbers
        return keep, (np.where(size <= 0, -1.0, raw) + 1) / 2


def cosine_over(vectors: DataFrame, least: float, size: int | None = None) -> DataFrame:
    """``(u, v, cos)`` of the pairs, u < v, with a cosine of ``least`` or more; no other pair
    leaves its blocks."""

    def run(a: Block, b: Block, same: bool) -> pa.Table:
        i, j = _near(a, b, least)
        if same:
            i, j = i[i < j], j[i < j]
        cos = np.concatenate([_cosines_at(a, b, i[k : k + PACK // 64], j[k : k + PACK // 64]) for k in range(0, len(i) or 1, PACK // 64)])
        i, j, cos = i[cos >= least], j[cos >= least], cos[cos >= least]
        u, v = ends(a, b, i, j)
        return pa.table({"u": u, "v": v, "cos": cos})

    return pairs_of_blocks(vectors.select("node", "z"), run, "u long, v long, cos double", size=size)


def nearest(vectors: DataFrame, k: int, within: str | None = None, size: int | None = None) -> DataFrame:
    """``(u, v, cos)``: for each u at least the k others of largest cosine (ties by smaller v),
    k of each block that it meets; the caller ranks them."""

    def best(x: Block, y: Block, cos: np.ndarray) -> pa.Table:
        order = np.argsort(-cos, axis=1, kind="stable")[:, :k]  # columns are in order of node
        i = np.repeat(np.arange(len(x)), order.shape[1])
        j = order.ravel()
        found = np.isfinite(cos[i, j])
        i, j = i[found], j[found]
        return pa.table({"u": x.node[i], "v": y.node[j], "cos": cos[i, j]})

    def run(a: Block, b: Block, same: bool) -> pa.Table:
        cos = cosines(a, b)
        if same:
            np.fill_diagonal(cos, -np.inf)
            return best(a, b, cos)
        return pa.concat_tables([best(a, b, cos), best(b, a, cos.T)])

    return pairs_of_blocks(vectors.select("node", "z", *([within] if within else [])), run, "u long, v long, cos double", within, size)


def _hex8(text: Column) -> Column:
    """The first 8 hex digits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def draw(seed: int, r: Column, side: str, n: int) -> Column:
    return F.pmod(_hex8(F.concat(F.lit(f"{seed}:"), r.cast("string"), F.lit(f":{side}"))), F.lit(n))


def _last_draw(draws: Callable[[int], DataFrame], wanted: int, n: int) -> tuple[int, int]:
    """(length of a range of draws that suffices, the ``wanted``-th draw that counts).

    Draws are counted by chunks of the range; only the chunk with the last one is sorted."""
    spare = int(wanted * n / (n - 1) * 1.1) + 64
    while True:
        chunk = -(-spare // DRAW_CHUNKS)
        counts = sorted((r["c"], r["n"]) for r in draws(spare).groupBy(F.floor(F.col("r") / chunk).alias("c")).agg(F.count("*").alias("n")).collect())  # DRAW_CHUNKS rows at most
        left = wanted
        for c, count in counts:
            if left <= count:
                inside = draws(spare).filter((F.col("r") >= c * chunk) & (F.col("r") < (c + 1) * chunk))
                return spare, sorted(r["r"] for r in inside.select("r").collect())[left - 1]  # one chunk
            left -= count
        spare *= 2


def sampled_pairs(vectors: DataFrame, wanted: int, seed: int, n: int | None = None) -> DataFrame:
    """``(r, a, b)``: ``wanted`` draws of two nodes with replacement, the first by r.

    Draws of a node with itself are dropped, and later draws take their place. One node or
    none gives no pairs. Other columns of ``vectors`` come along in ``a`` and ``b``."""
    n = vectors.count() if n is None else n
    if n < 2 or wanted < 1:
        return vectors.limit(0).select(F.lit(0).cast("long").alias("r"), F.struct(*vectors.columns).alias("a"), F.struct(*vectors.columns).alias("b"))

    def draws(length: int) -> DataFrame:
        rows = vectors.sparkSession.range(length).select(F.col("id").alias("r"))
        return rows.withColumn("i", draw(seed, F.col("r"), "u", n)).withColumn("j", draw(seed, F.col("r"), "v", n)).filter("i <> j")

    length, last = _last_draw(draws, wanted, n)
    numbered = dense_number(vectors, "node", name="number")
    side = lambda s, k: numbered.select(F.col("number").alias(k), F.struct(*vectors.columns).alias(s))
    return draws(length).filter(F.col("r") <= last).join(side("a", "i"), "i").join(side("b", "j"), "j").select("r", "a", "b")


def subsample(distances: DataFrame, cap: int = SUBSAMPLE_CAP, seed: int = 42, key: str = "r") -> DataFrame:
    """At most ``cap`` rows without replacement, those of smallest md5 of (seed, key), sorted by d."""
    return distances.orderBy(F.md5(F.concat(F.lit(f"{seed}:sub:"), F.col(key).cast("string")).cast("binary")), key).limit(cap).orderBy("d", key)
