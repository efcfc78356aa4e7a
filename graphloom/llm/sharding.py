"""Sharding by extendible hashing (operator 2).

Every row has 60 hash bits: 40 from the md5 of its id and 20 from its place in the input,
which tell rows of one id apart. A directory maps hash prefixes to buckets; a bucket over
the byte limit, and only such a bucket, splits on one more bit, until every shard fits.
So a shard is the shortest prefix of a row's bits whose rows together fit the limit. A
single document over the limit is a shard of its own and flagged.

Defined results: null text has 0 bytes, a null id hashes as the empty string; repeated
rows are rows of their own and split on the last 20 bits; an empty table has no shards;
other columns are kept, whatever their names (those of this operator start with ``__``).

Scale: sizes are summed once, with map-side combine, into cells of a depth chosen from
the total (eight to sixteen cells a shard); the directory is worked out from the cells,
not from the rows. Only rows in cells that are still too large at that depth are counted
again, ten bits deeper. Rows meet the directory in a join on their cell: broadcast while
it has few cells by count, else shuffled; a cell has no more rows than fit a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ID_BITS, ROW_BITS = 40, 20
BITS = ID_BITS + ROW_BITS
STEP = 10
#: Rows up to which a side of a join is broadcast (a few MB).
BROADCAST_ROWS = 50_000


def hash_bits(key: Column) -> Column:
    """40 bits of the md5 of a key's text, then 20 of the row's place."""
    head = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 10), 16, 10).cast("bigint")
    return F.shiftleft(head, ROW_BITS) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))


def directory(sized: DataFrame, limit_bytes: int) -> DataFrame:
    """``(cell_depth, cell, depth, shard, shard_bytes, shard_docs)``: for each cell of the
    hash space the shard that covers it. ``sized(bits, n_bytes)`` has a row a document."""
    total = int(sized.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0)
    depth = min(BITS, max(1, (8 * total // limit_bytes).bit_length()))
    top, rest, found = 0, sized, None
    while True:
        cells = written(rest.groupBy(F.shiftright("bits", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "shard-cells")
        # every prefix of each cell, and what lies under it
        up = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"))
        up = up.withColumn("shard", F.expr(f"shiftright(cell, {depth} - depth)"))
        sums = up.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fit = sums.filter((F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS))
        first = up.select("cell", "depth", "shard").join(fit.hint("shuffle_hash"), ["depth", "shard"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("s"))
        here = written(first.select(F.lit(depth).alias("cell_depth"), "cell", "s.*"), "shard-directory")
        found = here if found is None else found.unionByName(here)
        large = written(cells.join(here, "cell", "left_anti").select(F.col("cell").alias("__cell")), "shard-large")
        if large.isEmpty():
            return found
        rest = rest.join(bounded(large), F.shiftright("bits", BITS - depth) == F.col("__cell"), "left_semi")
        top, depth = depth + 1, min(BITS, depth + STEP)


def bounded(df: DataFrame) -> DataFrame:
    """A written table as one side of a join: broadcast if it has few rows, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 1 << 20) -> DataFrame:
    """``(row, n_bytes, depth, shard, shard_bytes, shard_docs)``: each row of ``docs`` as a
    struct, with its shard (the prefix as a number). The rows are written with their bits
    once, since their places are only fixed then."""
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    return _sharded(docs.select(F.struct(*docs.columns).alias("row"), hash_bits(F.col(id_col)).alias("bits"), n_bytes), limit_bytes)


def _sharded(rows: DataFrame, limit_bytes: int) -> DataFrame:
    keyed = written(rows, "shard-rows")
    found = directory(keyed.select("bits", "n_bytes"), limit_bytes)
    depths = sorted(r["cell_depth"] for r in found.select("cell_depth").distinct().collect())  # BITS / STEP rows at most
    names = ("depth", "shard", "shard_bytes", "shard_docs")
    if not depths:
        kinds = ("int", "long", "long", "long")
        return keyed.drop("bits").select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds)])
    out = None
    for d in depths:
        part = written(found.filter(F.col("cell_depth") == d).select("cell", *names), "shard-cells")
        here = keyed.join(bounded(part), F.shiftright("bits", BITS - d) == F.col("cell")).drop("cell", "bits")
        out = here if out is None else out.unionByName(here)
    return out


def shard_name() -> Column:
    """The shard's prefix as a string of 0 and 1."""
    return F.when(F.col("depth") > 0, F.lpad(F.bin("shard"), F.col("depth"), F.lit("0"))).otherwise(F.lit(""))


def shard_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 1 << 20) -> DataFrame:
    """``(doc_id, n_bytes, depth, shard, shard_docs, shard_bytes, oversized)``; shard is the
    hash prefix as a string of ``depth`` bits. Only ids and sizes leave the scan."""
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    found = _sharded(docs.select(F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col)).alias("bits"), n_bytes), limit_bytes)
    return found.select("doc_id", "n_bytes", F.col("depth").cast("long").alias("depth"), shard_name().alias("shard"), "shard_docs", "shard_bytes", (F.col("shard_bytes") > limit_bytes).alias("oversized"))
