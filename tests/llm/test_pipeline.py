"""The pipeline against a brute-force version, and the registration of the queries."""

import random
import struct

import corpus_pipeline
import duckdb
import xxhash
from graphloom.llm import oracles, queries

from .cases import DOCS, documents, words
from .test_grouped import fingerprint, union
from .test_row_local import WORD, hits_by_hand


def kept_by_rules(texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    return dict(con.execute(f"SELECT doc_id, kept FROM ({oracles.quality_sql()})").fetchall())


def test_pipeline(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "SHARD_BYTES", 4000)
    rng = random.Random(12)
    items = [(i, words(rng, 25)) for i in range(6)]
    rows = documents(120, 21)  # with null and repeated ids
    rows += [(None, words(rng, n), "en", "src1", 9) for n in (31, 47)] + [(8000, words(rng, n), None, "src2", 9) for n in (33, 52)]
    rows += [(6000 + i, words(rng, 30) + " " + t + " " + words(rng, 30), "en", "src2", 9) for i, (_, t) in enumerate(items)]
    rows += [(7000 + i, " ".join(w + "$$$" for w in words(rng, 40).split()), "en", "src1", 9) for i in range(5)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    verdict = kept_by_rules([r[1] for r in rows])
    kept = [r for i, r in enumerate(rows) if verdict[i]]
    fps = [fingerprint(r[1]) for r in kept]
    root = union([(i, j) for i in range(len(kept)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(kept)))
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(kept[i])
    signed = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t, 42)))[0]
    single = [min(g, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]))) for g in groups.values()]
    assert sum(r[0] is None for r in single) >= 2 and sum(r[0] == 8000 for r in single) == 2
    clean = [r for r in single if not hits_by_hand(r[1], items)[-1]]
    assert len(rows) > len(kept) > len(single) > len(clean) > 50

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in clean])
    taken = {(d, size): n for d, size, n in con.execute(f"SELECT doc_id, size, n_copies FROM ({oracles.mixing_sql()})").fetchall()}
    assert len(taken) == len(clean)
    times = lambda r: taken[r[0], len(WORD.findall(r[1]))]
    con.execute("DELETE FROM documents")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in clean for _ in range(times(r))])
    shard = dict(con.execute(f"SELECT doc_id, shard FROM ({oracles.sharding_sql(4000)})").fetchall())
    want = [(*r, shard[r[0]]) for r in clean for _ in range(times(r))]

    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[:5] == [c.split()[0] for c in DOCS.split(", ")]
    plain = lambda rs: sorted(tuple(str(x) for x in r) for r in rs)
    assert plain(tuple(r)[:6] for r in got.collect()) == plain(want)

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if i < 4:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_every_operator_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and set(queries.oracle_sql()) == set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
