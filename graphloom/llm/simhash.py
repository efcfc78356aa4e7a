"""SimHash near-duplicates by tiled exact comparison (operator 9).

A fingerprint has bit k set if over half of the document's shingle hashes (XXH64,
seed 42, of space-joined word triples, repeats included) have it set. Distinct
fingerprints are dealt to tiles by their population count; a pair of tiles is compared
only if the counts differ by the radius at most, since the Hamming distance is never
smaller than that difference. Inside a pair of tiles the same bound, taken over the
counts of the four 16-bit words, skips blocks; what is left is compared in full with
numpy exclusive-or and bit counts. A pair of tiles returns a spanning forest of its
links, never all pairs, so groups of copies stay linear.

Defined results: null or blank text has fingerprint zero and is linked like any other;
a null id is never a component's name unless no member has an id; repeated rows each
get a row; an empty table gives an empty result; other columns are ignored.

Scale: the comparison is quadratic in distinct fingerprints (the method's nature), with
tiles of a fixed size spread over tasks; the shuffle carries 8-byte fingerprints only, a
tile's 128 KB to each of its pairs, which is one byte for about a thousand comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, as_bytes, components, written

TILE = 16384
BLOCK = 256
#: A fingerprint is common if it has more than one in so many rows, so there are fewer than that.
COMMON = 1000


def simhash(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_digest
    if len(words) <= shingle:
        grams = [join(words)]
    else:
        grams = [join(t) for t in zip(*(words[i:] for i in range(shingle)))]
    hashes = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, version: bool = False) -> DataFrame:
    """``(doc_id long, fp long)``; fp holds the unsigned bits. With ``version`` also a hash
    of the text, ``version long``."""
    more = [F.xxhash64(text_col).alias("version")] if version else []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t, shingle) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *(["version"] if version else [])])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return arrow_map(rows, run, "doc_id long, fp long" + (", version long" if version else ""))


def _blocks(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in order of their words' population counts, and the least and most
    count of each word in each block."""
    counts = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    fps, counts = fps[order], counts[order]
    at = np.arange(0, len(fps), BLOCK)
    return fps, np.minimum.reduceat(counts, at, axis=0), np.maximum.reduceat(counts, at, axis=0)


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles of distinct fingerprints (of the
    links inside one tile if ``same``), as pairs of fingerprints."""
    a, a_low, a_high = _blocks(left)
    b, b_low, b_high = (a, a_low, a_high) if same else _blocks(right)
    shift = 0 if same else len(a)
    label = np.arange(len(a) + (0 if same else len(b)))
    gap = np.zeros((len(a_low), len(b_low)), np.int16)
    for word in range(4):
        gap += np.maximum(0, np.maximum(a_low[:, None, word] - b_high[None, :, word], b_low[None, :, word] - a_high[:, None, word]))
    near = gap <= radius
    if same:
        near &= np.arange(len(a_low))[:, None] <= np.arange(len(b_low))[None, :]
    links = []
    for i, j in zip(*np.nonzero(near)):
        rows, cols = slice(i * BLOCK, min((i + 1) * BLOCK, len(a))), slice(j * BLOCK, min((j + 1) * BLOCK, len(b)))
        linked = np.bitwise_count(a[rows, None] ^ b[None, cols]) <= radius
        if not linked.any():
            continue
        off = slice(cols.start + shift, cols.stop + shift)
        while (open_ := linked & (label[rows, None] != label[None, off])).any():
            x, y = divmod(int(open_.argmax()), open_.shape[1])
            x, y = x + rows.start, y + cols.start
            links.append((int(a[x]), int(b[y])))
            one, two = label[x], label[y + shift]
            label[label == max(one, two)] = min(one, two)
    return links


def _links(distinct: DataFrame, radius: int) -> DataFrame:
    """``(a, b)`` links that connect what is within ``radius`` bits; ``distinct(fp)``."""
    ones = F.bit_count("fp").cast("int")
    counts = {r["p"]: r["n"] for r in distinct.groupBy(ones.alias("p")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    tiles_of = {p: -(-counts.get(p, 0) // TILE) for p in range(65 + radius)}

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "t": pa.array([key[1].as_py()], pa.int32()), "fps": pa.array([np.sort(t["fp"].to_numpy()).tobytes()], pa.binary())})

    per_ones = F.element_at(F.create_map(*[F.lit(int(x)) for p in tiles_of for x in (p, max(1, tiles_of[p]))]), ones)
    tiles = (
        distinct.select(ones.alias("p"), F.pmod(F.xxhash64("fp"), per_ones).cast("int").alias("t"), "fp")
        .groupBy("p", "t").applyInArrow(pack, "p int, t int, fps binary")
    )

    def meet(batch: pa.RecordBatch) -> pa.Table:
        """Each tile goes to every pair that it is part of."""
        rows = []
        for p, t, fps in zip(*(batch.column(c).to_pylist() for c in ("p", "t", "fps"))):
            rows += [(p, t, q, u, 0, fps) for q in range(p, p + radius + 1) for u in range(tiles_of[q]) if (p, t) <= (q, u)]
            rows += [(q, u, p, t, 1, fps) for q in range(max(0, p - radius), p + 1) for u in range(tiles_of[q]) if (q, u) < (p, t)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("p", "t", "q", "u", "side", "fps"), kinds))})

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        sides = {s: np.frombuffer(f, np.uint64) for s, f in zip(t["side"].to_pylist(), t["fps"].to_pylist())}
        same = key[0].as_py() == key[2].as_py() and key[1].as_py() == key[3].as_py()
        links = tile_links(sides[0], sides[0] if same else sides[1], radius, same) if same or len(sides) == 2 else []
        pair = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    return arrow_map(tiles, meet, "p int, t int, q int, u int, side int, fps binary").groupBy("p", "t", "q", "u").applyInArrow(compare, "a long, b long")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """``distinct(fp, ...)`` with the ``root`` of each fingerprint's component."""
    roots = written(components(_links(distinct.select("fp"), radius)), "simhash-roots")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: component_id is the smallest id among the
    documents reachable over links of ``radius`` or fewer differing bits."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    rooted = _rooted(distinct, radius)
    named = written(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "n", "component_id"), "simhash-named")
    # fingerprints of very many rows do not meet their names by a shuffle: at most COMMON of them are broadcast
    rows = named.agg(F.sum("n").alias("n")).first()["n"] or 0
    common, other = (F.broadcast(named.filter(F.col("n") * COMMON > rows)), named.filter(F.col("n") * COMMON <= rows))
    met = fps.join(common, "fp").unionByName(fps.join(common.select("fp"), "fp", "left_anti").join(other, "fp"))
    return met.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document with the
    smallest id (none is larger than any), then the smallest hash of its text, stays (one row
    of it). Rows that share an id but not the text are documents of their own."""
    doc = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(int(NO_ID)))
    least = F.min(F.struct(doc("doc_id").alias("doc"), "version")).alias("least")
    distinct = written(fingerprints(docs, id_col, text_col, shingle, version=True).groupBy("fp").agg(least), "simhash-distinct")
    keep = _rooted(distinct, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc(id_col).alias("doc"), F.xxhash64(text_col).alias("version"))
    return rows.join(keep, ["doc", "version"], "left_semi").dropDuplicates(["doc", "version"]).select("row.*")
