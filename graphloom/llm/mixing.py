"""Mixing sources to target weights by systematic sampling (operator 8).

A document's size is its number of words. Every source has a target (in words), and each
of its documents the same expected number of copies, target / source size. Within a
source the expected copies are prefix-summed, one random offset (a seeded hash of the
source) is added, and a document is emitted once per integer boundary that its interval
crosses. Documents run in order of size, so neighbours on the line weigh alike and the
words taken stay near the target.

Defined results: null or blank text has size 0 and takes nothing; a null source is a
source of its own, ordered last; repeated rows are documents of their own; a source of
size 0 has target 0; an empty table gives an empty mix; other columns are ignored by
``mix`` and kept by ``mixed_rows``.

Scale: the prefix sum is two-level. Documents fall in cells (source, size class, hash
bucket) of some thousands of rows; cells are counted with map-side combine, the running
count over cells is a window over that small table alone, and ranks inside cells are
local, so a source with a third of all rows is split over many tasks (rows without an id
are one cell of their source and size class). ``mix`` shuffles (id, size, source), never
text; ``mixed_rows`` shuffles each row that it takes once. The table of sources has one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

CELL_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share
    ``budget`` times all sizes. No target passes ``most`` times its source's size; the
    excess is shared again by weight. In order of cap / weight, the sources that are
    capped come first: source k is capped if, with those before it capped, the level
    that the rest would share reaches its cap. One row per source is sorted here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("rest") * F.col("w") < F.col("cap") * F.col("rest_w"), F.col("rest") / F.col("rest_w")))
        .withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return per.select("source", "source_size", F.coalesce(F.col("level") * F.col("w"), F.col("cap")).alias("target"))


def _md5_number(text: Column) -> Column:
    """The first 8 hex digits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def copies(sized: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``sized(doc_id, size, source, ...)`` with ``source_size``, ``target`` and ``n_copies``;
    other columns break ties of size and id, in their order, and stay."""
    more = [c for c in sized.columns if c not in ("doc_id", "size", "source")]
    rows = sized.count()
    buckets = max(1, -(-rows // CELL_ROWS))
    grade = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 2)).otherwise(F.lit(-1)).cast("int")
    cells = sized.withColumn("grade", grade).withColumn("bucket", (_md5_number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % buckets).cast("int"))
    count = cells.groupBy("source", "grade", "bucket").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source").orderBy("grade", "bucket")
    start = count.withColumn("before", F.sum("n").over(run) - F.col("n")).drop("n")
    place = Window.partitionBy("source", "grade", "bucket").orderBy("size", "doc_id", *more)
    ranked = cells.withColumn("at", F.row_number().over(place))

    def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
        cond = F.lit(True)
        for n in names:
            cond = cond & a[n].eqNullSafe(b[n])
        return cond

    placed = ranked.join(start, same(ranked, start, "source", "grade", "bucket"), "left").select(*[ranked[c] for c in ("doc_id", "size", "source", *more)], (F.col("at") + F.col("before")).alias("place"))
    rated = placed.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, placed["source"].eqNullSafe(plan["source"]), "left").select(placed["*"], plan["source_size"], plan["target"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _md5_number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source").cast("string"), F.lit("\n")))) / F.lit(float(1 << 32))
    return rated.withColumn("n_copies", (F.floor(offset + rate * F.col("place")) - F.floor(offset + rate * (F.col("place") - 1))).cast("long")).drop("place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, n_copies, taken)`` per document."""
    sized = written(docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source")), "mix-sizes")
    plan = written(targets(sized, **options), "mix-targets")
    return copies(sized, plan, seed).select("doc_id", "size", "source_size", "target", "n_copies", (F.col("size") * F.col("n_copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are numbered once, in a written table, and meet their number of copies by it, so
    neither a null nor a repeated id gathers rows. Rows of one size and id are taken in order
    of a hash of their text; what is equal in all three is one text."""
    rows = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "mix-rows")
    of = lambda c: F.col("row")[c]
    sized = written(rows.select(of(id_col).alias("doc_id"), word_count(of(text_col)).alias("size"), of(source_col).alias("source"), F.xxhash64(of(text_col)).alias("version"), "number"), "mix-sizes")
    plan = written(targets(sized, **options), "mix-targets")
    taken = copies(sized, plan, seed).filter("n_copies > 0").select("number", "n_copies")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))
    return rows.join(taken, "number").select("row", times).select("row.*")
