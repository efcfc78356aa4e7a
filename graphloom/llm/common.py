"""What several operators of this subpackage share.

* tables in the shared folder of the cluster, and connected components, both from the
  graph engine,
* batches: documents dealt evenly by a hash of their id, so that work on whole
  texts can be pre-aggregated per batch and addressed again later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import components as graph_components
from graphloom.storage import fresh_path, shared_dir, table, written

#: White space that separates words, as a character class body for Java, RE2 and Python.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id where ids are compared as integers: no id is larger.
NO_ID = np.iinfo(np.int64).max
#: Bytes of documents that a task packs at a time.
PACK_BYTES = 32 << 20


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 without decoding them; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def in_batches(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> tuple[DataFrame, int]:
    """``(batch, packed)``, partitioned by batch and read back by ``unpacked``; and the number
    of batches.

    Batches hold about ``batch_bytes`` of text each, whatever the input size; a hash of
    id and text deals them, so one hot source or group of copies does not fill one. Texts
    of a batch are packed and compressed together before they are shuffled."""
    total = docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(total) // batch_bytes))
    batch = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")
    rows = docs.select(batch.alias("batch"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().sort_by("batch")
            where = t["batch"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
            blobs = []
            for i, j in zip(cuts, cuts[1:]):
                sink, part = pa.BufferOutputStream(), t.slice(i, j - i).select(["doc_id", "text"])
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(part.take(list(range(part.num_rows))))
                blobs.append(sink.getvalue().to_pybytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["batch", "packed"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
                if size > PACK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.mapInArrow(pack, "batch int, packed binary").repartitionById(n, F.col("batch")), n


def unpacked(table: pa.Table) -> pa.Table:
    """``(doc_id, text)`` of a batch's rows."""
    parts = [pa.ipc.open_stream(p).read_all() for p in table["packed"].to_pylist()]
    return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, root)``, root the
    smallest node reachable. Nodes without an edge to another are absent."""
    found = graph_components(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.select("node", F.col("component").alias("root"))


__all__ = ["arrow_map", "as_bytes", "components", "fresh_path", "in_batches", "shared_dir", "table", "unpacked", "word_count", "written"]
