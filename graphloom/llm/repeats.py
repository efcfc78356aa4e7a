"""Exact repeats by suffix sorting (operator 6).

Every byte covered by a ``window``-byte string that also starts in a document with a
smaller id is removed. Strings are judged on the input; matches never cross documents.

A window's key is the smallest hash of the 16-byte strings in it. Equal windows have
equal keys, so windows are dealt to shards by key, and neighbouring windows of one key
travel as one region of text. Keys that only one document has are dropped first (only
hashes are shuffled for that), and equal regions of a batch of documents travel once,
with the batch's smallest id. In a shard, regions whose key has a single text need no
search, nor do regions without a window whose hash occurs twice; all others form the
shard's text, its suffixes are sorted by external induction
(``suffix.py``: disk-backed queues, recursion), and neighbours that share ``window`` bytes
form the groups whose smallest id decides. Results go back to the batches that asked.

Defined results: null text is empty; a null id is larger than any id, and documents of
equal id do not remove from each other; texts shorter than the window lose nothing;
repeated rows each get a row; an empty table gives an empty result; other columns are
ignored.

Scale: documents are dealt to batches by a hash, so a hot source or group of copies
spreads out, and keys to as many parts as there are batches, both of a fixed size. A key
with very much text (a common string in very many contexts) is cut up: its windows are
dealt one by one, by a hash of all their bytes. Each shuffle carries at most one entry for each key or region of a batch,
so a passage in a third of all documents is as many entries as there are batches. The
documents' own exchange is shared by the three steps that need texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix
from .common import NO_ID, as_bytes, in_batches, unpacked

GRAM = 16
CHUNK = 1 << 20
#: Bytes of regions that are sorted together; one key's regions are never parted.
SHARD = 2 << 20
#: Bytes of different regions under one key beyond which its windows are dealt one by one.
HOT = 32 << 20
#: Odd constants of the hash, and 64 random bits for each byte value.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BYTES = np.random.default_rng(6).integers(0, 1 << 64, 256, np.uint64)


def window_keys(data: np.ndarray, window: int) -> np.ndarray:
    """Key of the window that starts at each byte; fewer than ``window - 1`` ends are left out."""
    h, width = _BYTES[data], 1
    for k in range(GRAM.bit_length() - 1):
        h = h[:-width] * _MIX[k] + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX[4]
    h ^= h >> np.uint64(29)
    need, have = window - GRAM + 1, 1
    while 2 * have <= need:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if need > have:
        h = np.minimum(h[: -(need - have)], h[need - have :])
    return h


def regions(texts: list[bytes], window: int):
    """For each part of the texts: (first text's number, its texts' bytes as one array,
    offsets of the texts, region starts, region window counts, region keys, text number of
    each region). Regions are maximal runs of windows with one key."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        lengths = np.array([len(t) for t in texts[at:end]], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        whole = lengths >= window
        if whole.any():
            keys = window_keys(data, window)
            valid = np.zeros(len(data) + 1, np.int8)
            np.add.at(valid, offsets[:-1][whole], 1)
            np.add.at(valid, offsets[1:][whole] - window + 1, -1)
            valid = np.cumsum(valid[: len(keys)], dtype=np.int64) > 0
            first = np.zeros(len(keys), bool)
            first[offsets[:-1][whole]] = True
            new = valid.copy()
            new[1:] &= first[1:] | (keys[1:] != keys[:-1]) | ~valid[:-1]
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            counts = np.bincount(run[valid], minlength=len(starts))
            yield at, data, offsets, starts, counts, keys[starts], np.searchsorted(offsets, starts, side="right") - 1
        else:
            yield at, data, offsets, *(np.empty(0, np.int64) for _ in range(2)), np.empty(0, np.uint64), np.empty(0, np.int64)
        at = end


def _rows(table: pa.Table) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    """A batch's ids, ids with null as the largest, and texts, in an order of their own."""
    rows = unpacked(table)
    ids, texts = rows["doc_id"].to_pylist(), as_bytes(rows["text"])
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64), [texts[i] for i in order]


def _batch_keys(table: pa.Table, window: int, parts: int) -> pa.Table:
    """The distinct keys of a batch for each part, and a weight of each: one more than the
    logarithm of the bytes of its regions, and 64 more if two documents have it."""
    batch = table["batch"][0].as_py()
    _, ids, texts = _rows(table)
    keys, docs, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, _, _, _, counts, k, doc in regions(texts, window):
        keys.append(k)
        docs.append(ids[at + doc] if len(k) else np.empty(0, np.int64))
        sizes.append(counts + window - 1)
    key, doc, size = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes)
    order = np.argsort(key, kind="stable")
    key, doc, size = key[order], doc[order], size[order]
    if not len(key):
        return pa.table({"part": pa.array([], pa.int32()), "batch": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "weights": pa.array([], pa.binary())})
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
    weight = (1 + np.log2(np.add.reduceat(size, new)).astype(np.uint8) + 64 * many).astype(np.uint8)
    key = key[new]
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    key, weight, cuts = key[order], weight[order], np.searchsorted(part[order], np.arange(parts + 1))
    at = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    return pa.table({
        "part": pa.array(at, pa.int32()), "batch": pa.array([batch] * len(at), pa.int32()),
        "keys": pa.array([key[cuts[p] : cuts[p + 1]].tobytes() for p in at], pa.binary()), "weights": pa.array([weight[cuts[p] : cuts[p + 1]].tobytes() for p in at], pa.binary()),
    })


def _shared_keys(table: pa.Table, hot_bytes: int) -> pa.Table:
    """Of one part's keys those that two documents have, for each batch that has them, and
    which of them have regions of more than about ``hot_bytes``."""
    each = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
    weight = np.concatenate([np.frombuffer(m, np.uint8) for m in table["weights"].to_pylist()])
    key = np.concatenate(each)
    order = np.argsort(key, kind="stable")
    key, many, size = key[order], weight[order] > 64, np.left_shift(np.int64(1), weight[order].astype(np.int64) % 64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    wanted = (np.diff(np.append(new, len(key))) > 1) | np.logical_or.reduceat(many, new)
    shared, hot = key[new][wanted], key[new][wanted & (np.add.reduceat(size, new) > hot_bytes)]
    found = [k[np.isin(k, shared, assume_unique=True)] for k in each]
    some = pa.array([len(f) > 0 for f in found], pa.bool_())
    return pa.table({"batch": table["batch"], "keys": pa.array([f.tobytes() for f in found], pa.binary()), "hot": pa.array([f[np.isin(f, hot, assume_unique=True)].tobytes() for f in found], pa.binary())}).filter(some)


def window_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """A hash of the window that starts at each byte; the last ``window - 1`` are left out."""
    h, width = _BYTES[data], 1
    while 2 * width <= window:
        h = h[:-width] * _MIX[0] + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    if width < window:
        h = h[: -(window - width)] * _MIX[1] + h[window - width :]
    return h


def _parted(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, key: np.ndarray, doc: np.ndarray, hot: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Regions with those under hot keys cut in their windows, each a region whose key is a
    hash of all its bytes, so that one hot key is as many keys as it has windows."""
    many = np.isin(key, hot)
    if not many.any():
        return starts, counts, key, doc
    times = np.where(many, counts, 1)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    starts, single, doc = np.repeat(starts, times) + step, np.repeat(many, times), np.repeat(doc, times)
    counts, key = np.where(single, 1, np.repeat(counts, times)), np.repeat(key, times)
    key[single] = window_hashes(data, window)[starts[single]]
    return starts, counts, key, doc


def _shared_regions(docs: pa.Table, wanted: pa.Table, window: int):
    """The batch's rows, its distinct regions under shared keys in order of appearance
    (text -> number), their keys and smallest ids, and per part of the batch where they are."""
    ids, order_ids, texts = _rows(docs)
    shared, too_many = (np.sort(np.concatenate([np.frombuffer(k, np.uint64) for k in wanted[c].to_pylist()] or [np.empty(0, np.uint64)])) for c in ("keys", "hot"))
    number: dict[bytes, int] = {}
    keys: list[int] = []
    least: list[int] = []
    places = []
    for at, data, offsets, starts, counts, key, doc in regions(texts, window):
        at_key = np.searchsorted(shared, key)
        hit = np.flatnonzero((at_key < len(shared)) & (shared[np.minimum(at_key, len(shared) - 1)] == key)) if len(shared) else np.empty(0, np.int64)
        raw, which = data.tobytes(), []
        starts, counts, key, doc = _parted(data, starts[hit], counts[hit], key[hit], doc[hit], too_many, window)
        for s, n, k, d in zip(starts.tolist(), counts.tolist(), key.tolist(), order_ids[at + doc].tolist() if len(doc) else []):
            text = raw[s : s + n + window - 1]
            i = number.setdefault(text, len(number))
            if i == len(keys):
                keys.append(k)
                least.append(d)
            elif d < least[i]:
                least[i] = d
            which.append(i)
        places.append((at, len(data), offsets, starts, counts, doc, np.array(which, np.int64)))
    return ids, order_ids, texts, number, np.array(keys, np.uint64), np.array(least, np.int64), places


def _send_regions(docs: pa.Table, wanted: pa.Table, window: int, parts: int) -> pa.Table:
    names = ("part", "batch", "numbers", "keys", "sizes", "least", "texts")
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    rows: list[list] = [[] for _ in names]
    if docs.num_rows and wanted.num_rows:
        batch = docs["batch"][0].as_py()
        _, _, _, number, keys, least, _ = _shared_regions(docs, wanted, window)
        texts = list(number)
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[cuts[p] : cuts[p + 1]]
            if len(mine):
                own = [texts[i] for i in mine.tolist()]
                for column, x in zip(rows, (p, batch, mine.astype(np.int32).tobytes(), keys[mine].tobytes(), np.array([len(t) for t in own], np.int32).tobytes(), least[mine].tobytes(), pa.compress(b"".join(own), "zstd", asbytes=True))):
                    column.append(x)
    return pa.table({n: pa.array(r, k) for n, k, r in zip(names, kinds, rows)})


def shards(key: np.ndarray, texts: list[bytes], window: int):
    """Numbers of the distinct regions to search, and of each the first and last window to
    search, in shards of about ``SHARD`` bytes.

    A key with one text is out, and so is a region without a window whose hash occurs in
    another region of its key: neither has a window in common with others. The ends of a
    region whose windows occur once are left off. Regions of one key are in one shard,
    however large, since equal windows have equal keys."""
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[inverse] > 1)
    some = some[np.argsort(key[some], kind="stable")]
    at = 0
    while at < len(some):
        end, size = at, 0
        while end < len(some) and (size <= SHARD or key[some[end]] == key[some[end - 1]]):
            size += len(texts[some[end]])
            end += 1
        mine = some[at:end]
        lengths = np.array([len(texts[i]) for i in mine.tolist()], np.int64)
        data = np.frombuffer(b"".join([texts[i] for i in mine.tolist()]), np.uint8)
        h = window_hashes(data, window)
        owner = np.repeat(np.arange(len(mine)), lengths)
        ends = np.cumsum(lengths)
        inside = np.arange(len(h)) + window <= ends[owner[: len(h)]]
        where = owner[: len(inside)][inside]
        shared_place = np.flatnonzero(inside) - (ends - lengths)[where]
        h = h[inside]
        order = np.argsort(h, kind="stable")
        h = h[order]
        twice = np.concatenate([[False], h[1:] == h[:-1], [False]])
        shared = order[twice[1:] | twice[:-1]]
        which, place = where[shared], shared_place[shared]
        low, high = np.full(len(mine), -1, np.int64), np.full(len(mine), -1, np.int64)
        if len(which):
            order = np.lexsort([place, which])
            which, place = which[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            low[which[first]], high[which[first]] = place[first], place[np.append(first[1:], len(which)) - 1]
            found = np.flatnonzero(low >= 0)
            yield mine[found], low[found], high[found]
        at = end


def smallest_ids(texts: list[bytes], least: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each of these distinct texts the smallest id of the texts that
    hold it, by sorting the suffixes of all of them together."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = b"\x00".join(texts) + b"\x00"
    data, n = np.frombuffer(joined, np.uint8), len(joined)
    with suffix.Scratch() as scratch:
        symbols = data.astype(np.int64) + 2
        symbols[starts[1:] - 1] = 1
        order, shared = suffix.suffixes_and_prefixes(np.append(symbols, 0), 258, window, scratch)
        room = np.zeros(n + 1, bool)  # windows that stay in their text; nothing else shares one with them
        for s, length in zip(starts[:-1].tolist(), lengths.tolist()):
            room[s : s + length - window + 1] = True
        group = np.cumsum(shared < window)
        keep = room[order]
        order, group = np.asarray(order)[keep], group[keep]
        group = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
        owner = np.searchsorted(starts, order, side="right") - 1
        smallest = np.full(int(group[-1]) + 1, NO_ID, np.int64)
        np.minimum.at(smallest, group, least[owner])
        found = np.empty(n, np.int64)
        found[order] = smallest[group]
    return [found[s : s + length - window + 1] for s, length in zip(starts[:-1].tolist(), lengths.tolist())]


def _judge_regions(table: pa.Table, window: int) -> pa.Table:
    """One part's regions: for each batch, runs of windows with a smaller id elsewhere."""
    number: dict[bytes, int] = {}
    keys: list[int] = []
    least: list[int] = []
    asked = []
    for batch, numbers, key, sizes, ids, texts in zip(*(table[c].to_pylist() for c in ("batch", "numbers", "keys", "sizes", "least", "texts"))):
        at, which = 0, []
        own = np.frombuffer(ids, np.int64)
        texts = pa.decompress(texts, int(np.frombuffer(sizes, np.int32).sum(dtype=np.int64)), "zstd", asbytes=True)
        for size, k, d in zip(np.frombuffer(sizes, np.int32).tolist(), np.frombuffer(key, np.uint64).tolist(), own.tolist()):
            i = number.setdefault(texts[at : at + size], len(number))
            at += size
            if i == len(keys):
                keys.append(k)
                least.append(d)
            elif d < least[i]:
                least[i] = d
            which.append(i)
        asked.append((batch, np.frombuffer(numbers, np.int32), own, np.array(which, np.int64)))
    key, low, texts = np.array(keys, np.uint64), np.array(least, np.int64), list(number)
    windows: dict[int, np.ndarray] = {}
    for several, begin, end in shards(key, texts, window):
        parts: dict[bytes, int] = {}
        lows: list[int] = []
        of = []
        for i, x, y in zip(several.tolist(), begin.tolist(), end.tolist()):
            j = parts.setdefault(texts[i][x : y + window], len(parts))
            if j == len(lows):
                lows.append(least[i])
            lows[j] = min(lows[j], least[i])
            of.append(j)
        best = smallest_ids(list(parts), np.array(lows, np.int64), window)
        for i, j, x, y in zip(several.tolist(), of, begin.tolist(), end.tolist()):
            windows[i] = np.full(len(texts[i]) - window + 1, least[i], np.int64)
            windows[i][x : y + 1] = best[j]
    out: list[list] = [[] for _ in range(4)]
    for batch, numbers, own, which in asked:
        region, cuts, ids = [], [], []
        for no, d, i in zip(numbers.tolist(), own.tolist(), which.tolist()):
            if i not in windows:
                if least[i] < d:
                    region.append(no)
                    cuts.append(0)
                    ids.append(least[i])
                continue
            best = windows[i]
            if (best < d).any():
                for at in np.flatnonzero(np.diff(best, prepend=best[0] - 1)).tolist():
                    region.append(no)
                    cuts.append(at)
                    ids.append(int(best[at]))
        if region:
            for column, x in zip(out, (batch, np.array(region, np.int32).tobytes(), np.array(cuts, np.int32).tobytes(), np.array(ids, np.int64).tobytes())):
                column.append(x)
    return pa.table({n: pa.array(c, k) for n, k, c in zip(("batch", "region", "cut", "least"), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), out)})


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _cut(docs: pa.Table, wanted: pa.Table, judged: pa.Table, window: int) -> pa.Table:
    """The batch's documents without what starts in a document of smaller id."""
    ids, order_ids, texts, number, _, least, places = _shared_regions(docs, wanted, window)
    join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in judged[c].to_pylist()] or [np.empty(0, t)])
    region, cut, low = join("region", np.int32), join("cut", np.int32), join("least", np.int64)
    order = np.lexsort([cut, region])
    region, cut, low = region[order], cut[order], low[order]
    begin = np.searchsorted(region, np.arange(len(number) + 1))
    spans: list[list] = [[] for _ in texts]
    kept: list[bytes] = []
    for at, size, offsets, starts, counts, doc, which in places:
        cover = np.zeros(size + 1, np.int64)
        for s, n, d, i in zip(starts.tolist(), counts.tolist(), order_ids[at + doc].tolist() if len(doc) else [], which.tolist()):
            if least[i] < d:  # another document of this batch has the whole region
                cover[s] += 1
                cover[s + n + window - 1] -= 1
                continue
            for j in range(begin[i], begin[i + 1]):
                if low[j] < d:
                    end = cut[j + 1] if j + 1 < begin[i + 1] else n
                    cover[s + cut[j]] += 1
                    cover[s + end + window - 1] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        for k in range(len(offsets) - 1):
            text = texts[at + k]
            mask = gone[offsets[k] : offsets[k + 1]]
            if not mask.any():
                kept.append(text)
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            spans[at + k] = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
            kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batch_bytes: int = 16 << 20, hot_bytes: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: the removed byte spans of each document and its
    remaining bytes."""
    if not GRAM <= window <= 255:
        raise ValueError(f"windows have {GRAM} to 255 bytes")
    batched, n = in_batches(docs, id_col, text_col, batch_bytes)
    by_batch = lambda df: df.groupBy("batch")
    by_part = lambda df: df.repartitionById(n, F.col("part")).groupBy("part")
    keys = by_batch(batched).applyInArrow(lambda t: _batch_keys(t, window, n), "part int, batch int, keys binary, weights binary")
    shared = by_part(keys).applyInArrow(lambda t: _shared_keys(t, hot_bytes), "batch int, keys binary, hot binary").repartitionById(n, F.col("batch"))
    sent = by_batch(batched).cogroup(by_batch(shared)).applyInArrow(lambda d, w: _send_regions(d, w, window, n), "part int, batch int, numbers binary, keys binary, sizes binary, least binary, texts binary")
    judged = by_part(sent).applyInArrow(lambda t: _judge_regions(t, window), "batch int, region binary, cut binary, least binary")
    # the last step takes the shared keys and the judgements together
    both = shared.unionByName(judged, allowMissingColumns=True).repartitionById(n, F.col("batch"))

    def finish(d: pa.Table, more: pa.Table) -> pa.Table:
        is_key = more["keys"].is_valid()
        return _cut(d, more.filter(is_key), more.filter(more["region"].is_valid()), window)

    return by_batch(batched).cogroup(by_batch(both)).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def repeat_table(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
