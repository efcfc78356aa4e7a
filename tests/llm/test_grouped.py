"""Operators that compare or group rows, against brute force."""

import base64
import gzip
import hashlib
import random
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from graphloom.llm import common, linededup, mixing, repeats, sharding, simhash, suffix, warc

from .cases import DOCS, documents, same, words
from .test_row_local import WORD


def frame(spark, rows=None):
    return spark.createDataFrame([(*r, 7) for r in (documents() if rows is None else rows)], DOCS + ", size long")


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 300)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = union(edges, {x for e in edges for x in e})
    least = {}
    for n, r in root.items():
        least[r] = min(n, least.get(r, n))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    same(got.collect(), [(n, least[r]) for n, r in root.items() if n in linked])
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash


def fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_groups(spark):
    rows = documents()
    fps = [fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = union(links, range(len(rows)))
    ids = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            ids[r] = min(rows[i][0], ids.get(r, rows[i][0]))
    df = frame(spark)
    same(simhash.simhash_groups(df).collect(), [(rows[i][0], f"{fps[i]:016x}", ids.get(root[i])) for i in range(len(rows))])
    assert simhash.simhash_groups(df.limit(0)).count() == 0
    kept = simhash.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(ids.values()))
    assert kept.filter("doc_id is null").count() == 0  # both are copies of documents with an id


def test_one_of_each_group_with_repeated_ids(spark):
    rng = random.Random(31)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(7, a), (7, b), (7, b), (3, b), (8, c), (8, d), (9, c), (2, e), (7, e), (7, "x"), (None, a)]
    kept = simhash.one_of_each_group(frame(spark, [(*r, "en", "src0", 1) for r in rows])).select("doc_id", "text")
    same(kept.collect(), [(7, a), (3, b), (8, c), (8, d), (2, e), (7, "x")])
    rows = [(1, a), (1, b), (2, c), (None, d), (None, d), (None, e), (None, None), (None, "")]
    kept = simhash.one_of_each_group(frame(spark, [(*r, "en", "src0", 1) for r in rows])).select("doc_id", "text").collect()
    assert len(kept) == 6  # a null and an empty text are one group
    same([r for r in kept if r["text"]], [(1, a), (1, b), (2, c), (None, d), (None, e)])


@pytest.mark.parametrize("n", [1, 5, 700])
def test_tiles_lose_no_link(n, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 64, n, np.uint64)
    near = fps[rng.integers(0, n, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    every = np.unique(np.concatenate([fps, near]))
    a, b = every[::2].copy(), every[1::2].copy()
    links = simhash.tile_links(a, a, 3, True) + (simhash.tile_links(b, b, 3, True) + simhash.tile_links(a, b, 3, False) if len(b) else [])
    x = [int(v) for v in every]
    got = union(links, x)
    want = union([(p, q) for i, p in enumerate(x) for q in x[:i] if (p ^ q).bit_count() <= 3], x)
    assert len(links) < 3 * len(x)
    assert {frozenset(k for k in x if got[k] == r) for r in got.values()} == {frozenset(k for k in x if want[k] == r) for r in want.values()}


def test_simhash_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rows = documents(120, 9)
    fps = {fingerprint(r[1]) for r in rows}
    got = simhash.simhash_groups(frame(spark, rows))
    root = union([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3], fps)
    assert got.select("component_id").distinct().count() == len(set(root.values()))


# ---- exact repeats


def removed(rows, window=50):
    first = {}
    for i, *_ in rows:
        pass
    top = float("inf")
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            first[w] = min(first.get(w, top), top if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < (top if i is None else i):
                gone[k : k + window] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("batch_bytes, hot_bytes", [(1 << 24, repeats.HOT), (4000, repeats.HOT), (4000, 0), (4000, 1500)])
def test_repeats(spark, batch_bytes, hot_bytes):
    rows = [(r[0], r[1]) for r in documents()]
    rng = random.Random(8)
    pieces = [words(rng, 14) for _ in range(6)]
    rows += [(8000 + i, "".join(rng.choice(pieces)[rng.randint(0, 9) :] + rng.choice("xyz") for _ in range(5))) for i in range(25)]
    rows += [(9000 + i, "a" * (40 + 7 * i)) for i in range(6)] + [(9100, "ab" * 60), (9101, "ba" * 50), (9102, "é" * 49), (9103, "é" * 30), (9104, "\x00" * 60 + "z"), (9105, "\x00" * 55)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    same(repeats.repeat_table(df, batch_bytes=batch_bytes, hot_bytes=hot_bytes).collect(), list(removed(rows)))
    assert repeats.repeat_table(df.limit(0)).count() == 0


@pytest.mark.parametrize("size,memory", [(2, 64), (5, 1 << 20), (40, 256), (200_000, 1 << 26)])
def test_suffix_order(size, memory):
    rng = random.Random(size)
    for n in (1, 2, 3, 10, 60, 150):
        for sigma in (1, 2, 4, 40):
            text = [rng.randint(1, sigma) for _ in range(n)] + [0]
            if n == 150:
                text = text[:30] * 5 + [0]
            with suffix.Scratch() as scratch:
                got = suffix.sort_suffixes(np.array(text), max(text) + 1, scratch, size, memory)
            assert list(got) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("size,memory", [(2, 64), (7, 1 << 20), (200_000, 1 << 26)])
def test_common_prefixes(size, memory):
    rng = random.Random(size)
    for n in (1, 2, 3, 10, 40, 120):
        for sigma in (1, 2, 3, 30):
            text = [rng.randint(1, sigma) for _ in range(n)]
            text = (text[:25] * 5 if n == 120 else text) + [0]
            for cap in (1, 9, 50):
                with suffix.Scratch() as scratch:
                    order, shared = suffix.suffixes_and_prefixes(np.array(text), max(text) + 1, cap, scratch, size, memory)
                assert list(order) == sorted(range(len(text)), key=lambda i: text[i:])
                for i, (a, b) in enumerate(zip(order, order[1:]), 1):
                    same = 0
                    while same < cap and text[a + same] == text[b + same]:
                        same += 1
                    assert shared[i] == same, (text, i)


# ---- lines


def kept_lines(rows):
    """(id, text) -> numbers of the lines that stay, by comparing all pairs of lines."""
    places = {}
    docs = sorted({(float("inf") if i is None else i, t) for i, t in rows}, key=lambda r: (r[0], common.F is None, r[1] or ""))
    for i, t in docs:
        for n, x in linededup.lines_of((t or "").encode()):
            places.setdefault(x.decode(), []).append((i, n, t))
    lines = list(places)
    sets = [linededup.shingles(x) for x in lines]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if linededup.alike(sets[a], sets[b])]
    root = union(pairs, range(len(lines)))
    groups = {}
    for k, r in root.items():
        groups.setdefault(r, []).extend(places[lines[k]])
    return groups


def test_line_dedup(spark):
    rng = random.Random(6)
    base = [words(rng, rng.randint(4, 40)) for _ in range(60)]
    near = []
    for x in base:
        w = x.split()
        w[rng.randrange(len(w))] = "zz"
        near.append(" ".join(w))
    texts = ["\n".join(rng.sample(base + near, 8)) for _ in range(40)] + [None, "", "\n \n", "abc\nabc\nabd", "x" * 20000 + "\n" + "x" * 19999]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line long")
    got = linededup.line_table(df).collect()
    assert len(got) == len(rows)
    groups = kept_lines(rows)
    kept = {}
    for r in got:
        for n in r["kept_lines"]:
            kept.setdefault((float("inf") if r["doc_id"] is None else r["doc_id"], n), 0)
    firsts = {min((i, n) for i, n, _ in g) for g in groups.values()}
    # banding may miss a pair at the threshold; it can only keep more
    assert firsts <= set(kept) and len(kept) <= len(firsts) + 2
    texts_out = linededup.without_alike_lines(df).collect()
    assert len(texts_out) == len(rows) and {r["doc_id"]: r["text"] for r in texts_out}[43] == "abc\nabd"
    assert linededup.line_table(df.limit(0)).count() == 0


def test_hashed_sets_compare_exactly():
    rng = random.Random(11)
    for _ in range(3000):
        x = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefgh é") for _ in range(rng.randint(5, 60)))
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 2)] = rng.choice(["", "z", "ab", "q" * 5])
        y = "".join(y) if len(y) > 4 else x
        if len(y) >= 5:
            lines = linededup.Lines({1: x.encode(), 2: y.encode()})
            assert lines.alike(1, 2) == linededup.alike(linededup.shingles(x), linededup.shingles(y))


def test_line_recall():
    """Share of near pairs at 0.8 to 0.9 that share a band."""
    rng = random.Random(7)
    found = total = 0
    for _ in range(400):
        x = words(rng, rng.randint(12, 60))
        y = x.split()
        for _ in range(max(1, len(y) // 30)):
            y[rng.randrange(len(y))] = "q"
        y = " ".join(y)
        if linededup.alike(linededup.shingles(x), linededup.shingles(y)):
            keys = linededup.band_keys(linededup.signatures([x, y]))
            total += 1
            found += bool((keys[0] == keys[1]).any())
    assert total > 200 and found >= 0.99 * total


@pytest.mark.parametrize("n", [9, 18, 27, 36, 45, 63, 90, 135, 270])
def test_line_recall_by_length(n):
    """Pairs of n shingles each at similarity exactly 0.8."""
    rng = random.Random(n)
    some = lambda k: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(k))
    left = [some(n + 4) for _ in range(4000)]
    right = [x[: -(n // 9)] + some(n // 9) for x in left]
    a, b = (linededup.shingles(x[0]) for x in (left, right))
    assert len(a) == len(b) == n and 10 * len(a & b) == 8 * len(a | b)
    found = (linededup.band_keys(linededup.signatures(left)) == linededup.band_keys(linededup.signatures(right))).any(axis=1)
    assert found.mean() > 0.993


def test_large_bucket_in_tiles(spark):
    """A bucket above the tile size is verified whole."""
    rng = random.Random(10)
    text = words(rng, 80)
    rows = [(i, text + f" {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.line_table(df, tile=8).collect()
    assert sorted(r["doc_id"] for r in got if r["n_kept"]) == [0]


# ---- mixing and sharding


def test_targets(spark):
    sizes = [("a", 100), ("b", 10), ("c", 50), (None, 40), ("d", 0), ("B", 300), ("a", 20)]
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    names = sorted({s for s, _ in sizes if s is not None}) + [None]
    size = {n: sum(x for s, x in sizes if s == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 2 * size[n]}
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 2.0 * size[n]
            left -= target[n]
        open_ -= over
    for n in names:
        assert got[n]["source_size"] == size[n] and got[n]["target"] == pytest.approx(target[n])


def test_mix(spark):
    rows = documents(200)
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", target long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    same([(r["doc_id"], r["size"]) for r in got], [(r[0], len(WORD.findall(r[1] or ""))) for r in rows])
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["n_copies"] for r in got)
    per = {}
    for r in got:
        per.setdefault((r["source_size"], r["target"]), []).append(r)
    for (_, target), rs in per.items():
        assert abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs)
    same([tuple(r) for r in mixing.mix(df).collect()], [tuple(r) for r in got])
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns and out.count() == sum(r["n_copies"] for r in got)
    # rows of equal id and size, with the operator's own names as columns: reruns agree, and values stay
    odd = [(None, f"{w} b c", "s", i, 5) for i, w in enumerate("abcdefghij")] + [(7, f"{w} c d e", "s", i, 6) for i, w in enumerate("abcdefghij")]
    twin = spark.createDataFrame(odd, "doc_id long, text string, source string, number long, size long")
    runs = [mixing.mixed_rows(twin.repartition(n), budget=0.9, most=0.9).collect() for n in (1, 3)]
    same(runs[0], runs[1])
    assert 8 <= len(runs[0]) < 20 and {tuple(r) for r in runs[0]} <= set(odd)


def test_sharding(spark, monkeypatch):
    rows = documents(150)
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(77, "dup " * 50, None, None, 1, 1)] * 40, DOCS + ", shard long")
    limit = 2500
    got = sharding.shard_table(df, limit_bytes=limit).collect()
    assert len(got) == df.count()
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard inside another
    for name, rs in shards.items():
        size = sum(r["n_bytes"] for r in rs)
        assert size == rs[0]["shard_bytes"] and len(rs) == rs[0]["shard_docs"] and rs[0]["depth"] == len(name)
        assert size <= limit or len(rs) == 1
        if name:  # it was split for a reason: the bucket one bit shorter is over the limit
            assert sum(r["n_bytes"] for r in got if r["shard"].startswith(name[:-1])) > limit
    assert sharding.shard_table(df.limit(0)).count() == 0
    whole = sharding.shard_table(df, limit_bytes=1 << 30).collect()
    assert {r["shard"] for r in whole} == {""}
    rows = sharding.shards(df, limit_bytes=limit).select("row.*").collect()
    same(rows, df.collect())
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    same(sharding.shard_table(df, limit_bytes=limit).drop("shard", "depth", "shard_docs", "shard_bytes", "oversized").collect(), [(r["doc_id"], r["n_bytes"]) for r in got])


# ---- WARC


def pages():
    big = "<p>" + "x" * 200 + "é</p>"
    return [(3, "http://a/", big), (1, "http://b/\r\nX: y", big), (2, None, big), (2, None, big), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "n", big), (9, "\u00e9", "y" * 100), (10, "z", "y" * 100), (11, "z", "w" * 99), (12, "z", "w" * 99), (13, "l", "q" * 300000)]


def test_warc(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(df, archive_bytes=1000)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        equal = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        revisit = len(raw) >= 100 and i != min(equal)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(equal) if revisit else None))
    same(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), want)
    assert warc.round_trip(df.limit(0)).count() == 0
    manifest = warc.write_archives(df, common.fresh_path(spark, "warc-test"))
    back = warc.read_archives(manifest).filter("record_type = 'response'").collect()
    assert {r["payload"].decode() for r in back} == {h or "" for _, _, h in rows}
    shuffled = warc.marked(df, "page_id", "url", "html", 100)
    assert shuffled.filter("revisit").count() == sum(w[3] == "revisit" for w in want)


def test_zip64_and_damage(tmp_path):
    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"first")
        with z.open("b", "w", force_zip64=True) as f:
            f.write(b"second")
        z.writestr("c", b"third" * 20, zipfile.ZIP_DEFLATED)
    raw = path.read_bytes()
    # the same archive with a ZIP64 end of directory and a ZIP64 field for the offset of "b"
    end = raw.rfind(b"PK\x05\x06")
    count, size, offset = struct.unpack_from("<HII", raw, end + 10)
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, offset)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    wide = tmp_path / "wide.zip"
    wide.write_bytes(raw[:end] + record + locator + raw[end : end + 8] + struct.pack("<HHIIH", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    for p in (path, wide):
        file = warc.RangeFile(str(p))
        members = warc.ZipDirectory(file)
        assert set(members.members) == {"a", "b", "c"}
        for name, text in (("a", b"first"), ("b", b"second")):
            at, n = members.stored(name)
            assert file.read(at, n) == text
        with pytest.raises(ValueError):
            members.stored("c")
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        warc.ZipDirectory(warc.RangeFile(str(tmp_path / "no.zip")))


def test_range_reads_only_what_is_asked(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "".join(random.Random(i).choices("abcdefgh", k=50_000))) for i in range(20)], "page_id long, url string, html string")
    manifest = warc.write_archives(df.coalesce(1), f"file://{tmp_path}/w").collect()
    file = warc.RangeFile(manifest[0]["path"])
    members = warc.ZipDirectory(file)
    members.stored(warc.INDEX)
    assert file.bytes_read < file.size / 2
    assert pa.__version__


def foreign_record(kind, url, payload, digest=None):
    http = b"HTTP/1.1 200 OK\r\ncontent-type:text/html\r\n\r\n" + payload if kind != "warcinfo" else payload
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-URI: {url}\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "") + f"Content-Length:{len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_archives_of_others(tmp_path):
    """Several members, CDXJ lines with keys, compressed indexes, SHA-1, an unindexed member."""
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    first = [gzip.compress(foreign_record("response", "http://a/", b"one", sha1)), gzip.compress(foreign_record("response", "http://b/", b"two" * 3000))]
    plain = [foreign_record("warcinfo", "", b"software: x"), foreign_record("response", "http://c/", b"\r\n\r\nthree")]
    alone = [gzip.compress(foreign_record("warcinfo", "", b"made by hand")), gzip.compress(foreign_record("response", "http://d/", b"four" * 100_000))]
    loose = [foreign_record("response", f"http://e/{'x' * 5000}", b"five"), foreign_record("warcinfo", "", b"y")]
    together = [foreign_record("response", "http://f/", b"six"), foreign_record("response", "http://g/", b"")]
    line = lambda name, at, n: f'com,a)/ 20200101000000 {{"url": "u", "filename": "{name}", "offset": "{at}", "length": "{n}"}}'
    index = ["!meta 0 {}", line("a.warc.gz", 0, len(first[0])), line("a.warc.gz", len(first[0]), len(first[1])), line("archive/b.warc", len(plain[0]), len(plain[1])), ""]
    path = tmp_path / "others.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        for name, records in (("a.warc.gz", first), ("b.warc", plain), ("c.warc.gz", alone), ("d.warc", loose), ("e.warc.gz", [gzip.compress(b"".join(together))])):
            z.writestr(f"archive/{name}", b"".join(records))
        z.writestr("indexes/index.cdx.gz", b"".join(gzip.compress(x.encode()) for x in ("\n".join(index[:2]) + "\n", "\n".join(index[2:]))))
        z.writestr("indexes/again.cdxj", index[1])
    got = [(r["url"][:9], r["payload"], r["payload_digest"]) for r in warc.read_records(str(path))]
    want = [("http://a/", b"one"), ("http://b/", b"two" * 3000), ("http://c/", b"\r\n\r\nthree"), ("http://d/", b"four" * 100_000), ("http://e/", b"five"), ("http://f/", b"six"), ("http://g/", b"")]
    assert sorted(got) == [(u, p, hashlib.sha256(p).hexdigest()) for u, p in want]
    with zipfile.ZipFile(path, "a", zipfile.ZIP_STORED) as z:
        z.writestr("indexes/wrong.cdxj", line("z.warc.gz", 0, 5))
    with pytest.raises(ValueError):
        list(warc.read_records(str(path)))
    with pytest.raises(ValueError):
        warc.parse_record(foreign_record("response", "u", b"other", sha1))
    with pytest.raises(ValueError):
        list(warc.unpacked(iter([first[0][:-9]])))


def near_line(rng, x, least):
    """A line at similarity ``least`` or more to ``x``, and under 1, by edits at random places."""
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    for _ in range(200):
        y = list(x)
        for _ in range(max(1, len(x) // rng.randint(20, 60))):
            at = rng.choice([0, len(y), rng.randrange(len(y) + 1)])
            y[at : at + rng.randint(0, 1)] = rng.choice("abcdefgh ")
        y = "".join(y)
        a, b = grams(x), grams(y)
        if a != b and min(len(x), len(y)) >= 5 and len(a & b) >= least * len(a | b):
            return y
    return None


@pytest.mark.parametrize("low, high", [(10, 20), (20, 40), (40, 80), (80, 160), (160, 600)])
def test_line_recall_by_class(low, high):
    """Of pairs at similarity 0.8 to 1 that are edits of lines of words, by length, those that
    share a band; shingles are made here, not by the module."""
    rng = random.Random(low)
    left, right = [], []
    while len(left) < 1500:
        n = rng.randint(low, high - 1)
        x = (words(rng, n // 3 + 2) + "x" * n)[:n]
        if y := near_line(rng, x, 0.8):
            left.append(x)
            right.append(y)
    found = (linededup.band_keys(linededup.signatures(left)) == linededup.band_keys(linededup.signatures(right))).any(axis=1)
    assert found.mean() >= 0.985, found.mean()


def test_line_sets_of_large_alphabets():
    """Beyond the alphabet that fits a number, sets are sets of strings, with the same answers."""
    rng = random.Random(3)
    some = "".join(chr(0x4E00 + i) for i in range(8000))
    x = "".join(rng.choice(some) for _ in range(60))
    lines = {1: x, 2: x[:-2] + "ab", 3: "ab" + x[30:], 4: some}
    wide = linededup.Lines({i: t.encode() for i, t in lines.items()})
    small = linededup.Lines({i: t.encode() for i, t in lines.items() if i < 4})
    assert isinstance(wide.sets[1], set) and not isinstance(small.sets[1], set)
    for i, j in ((1, 2), (1, 3), (2, 3)):
        assert wide.alike(i, j) == small.alike(i, j) == ((i, j) == (1, 2))


def test_large_buckets_of_different_components(spark, monkeypatch):
    """All lines in one bucket: links between tiles are found although the first lines of
    their components are not alike."""
    monkeypatch.setattr(linededup, "band_keys", lambda sig: np.full((len(sig), linededup.BANDS), 7, np.uint64))
    rng = random.Random(14)
    base = [words(rng, 12) for _ in range(5)]
    rows = []
    for i, x in enumerate(base * 6):
        y = x
        for _ in range(i // 5):  # chains: far ends of a group are not alike
            at = rng.randrange(len(y))
            y = y[:at] + rng.choice("qz") + y[at + 1 :]
        rows.append((i, y))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in linededup.line_table(df, tile=4).collect() if r["n_kept"])
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    near = lambda a, b: 10 * len(grams(a) & grams(b)) >= 8 * len(grams(a) | grams(b))
    root = union([(i, j) for i, x in rows for j, y in rows if i < j and near(x, y)], range(len(rows)))
    assert got == sorted({min(i for i in root if root[i] == r) for r in root.values()})
