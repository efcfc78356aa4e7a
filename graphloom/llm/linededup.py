"""Fuzzy line dedup by MinHash (operator 1).

Lines are alike if the Jaccard similarity of their sets of 5-character shingles is 0.8 or
more; of every connected component of alike lines the first occurrence stays (smallest
document id, then line number), the others go.

1. Signatures: one hash per shingle, its high bits choose one of 120 bins, the least hash
   of each bin is the signature; each empty bin borrows from a filled one in an order of
   its own.
2. Banding: 20 bands of 6 bins; a pair at similarity 0.8 shares a band with probability
   0.998, at 0.85 with 0.9999.
3. Verification: lines of one band bucket come together with their texts, and the
   similarity of pairs is computed on the whole shingle sets. Pairs that are connected
   already are skipped, so a bucket returns a spanning forest of its links and never all
   pairs. A bucket of more than ``tile`` lines is verified in tiles; then one line of each
   component meets the others of its bucket; then tiles that are not connected yet meet
   pair by pair. No line is dropped from a bucket of any size.
4. Union-find: distributed star contraction over the verified links.

Equal lines are one line before all this: a line's name is its XXH3 of 128 bits. Band
buckets and links carry 64 of them, links the others as well, so that a line is only taken
for one of a component if all 128 agree. Blank lines are no lines. Lines of fewer than 5
characters are alike only if equal.

Defined results: null text has no lines; a null id is larger than any id; rows that share
id and text are one document and get the same answer; an empty table gives an empty
result; other columns are ignored (``without_alike_lines`` keeps them).

Scale: documents are dealt to batches by a hash, and band keys to as many parts as there
are batches, both of a fixed size; band keys travel once for each distinct line of a batch;
texts travel only for lines in buckets with two lines, once for each distinct set of lines,
and from any of the batches that have the line. Per-line decisions are narrow rows,
pre-aggregated by line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, as_bytes, components, in_batches, unpacked, written

SHINGLE, BINS, ROWS = 5, 120, 6
BANDS = BINS // ROWS
TILE = 2048
#: Groups over which the sets of one lead are spread.
SALT = 4
#: Alphabets of which a shingle's code fits 64 bits.
MOST_CHARACTERS = int(2 ** (64 / SHINGLE))
_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
CHUNK = 1 << 17
#: [r, j]: bin that comes at place r in the order of bin j, itself first; and its inverse, [bin, j].
_ORDER = np.array([[j, *(b for b in np.random.default_rng(j + 1).permutation(BINS) if b != j)] for j in range(BINS)]).T
_RANK = np.argsort(_ORDER, axis=0).astype(np.uint8)
_AT_RANK = np.ascontiguousarray(_ORDER.T).astype(np.uint8)


def lines_of(text: bytes) -> list[tuple[int, bytes]]:
    """(number, line) of every line that is not blank."""
    return [(i, x) for i, x in enumerate(text.split(b"\n")) if x and not x.isspace()]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_id(line: bytes) -> tuple[int, int]:
    """The two signed 64-bit halves of a line's name."""
    h = xxhash.xxh3_128_intdigest(line)
    return _signed(h & 0xFFFFFFFFFFFFFFFF), _signed(h >> 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines, and the line of each, in order; each line
    has ``SHINGLE`` characters at least."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) for x in lines], np.int64)
    h = points[: len(points) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h *= _M[0]
        h += points[k : len(points) - SHINGLE + 1 + k]
    h ^= h >> np.uint64(30)
    h *= _M[1]
    h ^= h >> np.uint64(27)
    h *= _M[2]
    h ^= h >> np.uint64(31)
    row = np.repeat(np.arange(len(lines)), lengths)[: len(h)]
    inside = np.ones(len(points), bool)
    ends = np.cumsum(lengths)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    inside = inside[: len(h)]
    return h[inside], row[inside]


def _sources(filled: np.ndarray) -> np.ndarray:
    """(lines, BINS) bin that each bin takes its hash from: the filled one of least rank.

    Ranks are an order of all bins for each bin by itself, which it leads, so what one bin
    borrows tells nothing of what another one does."""
    width = filled.sum(axis=1)
    order = np.argsort(-width, kind="stable")
    row, full = np.nonzero(filled[order])
    width = width[order]
    start = np.cumsum(width) - width
    least = _RANK[full[start]]
    for k in range(1, int(width.max(initial=0))):
        n = np.searchsorted(-width, -k)
        np.minimum(least[:n], _RANK[full[start[:n] + k]], out=least[:n])
    out = np.empty(filled.shape, np.int64)
    out[order] = _AT_RANK[np.arange(BINS), least]
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BINS) least hashes; each line has ``SHINGLE`` characters at least."""
    h, row = shingle_hashes(lines)
    bins = (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    none = np.iinfo(np.uint64).max
    sig = np.full(len(lines) * BINS, none, np.uint64)
    np.minimum.at(sig, row * BINS + bins, h)
    sig = sig.reshape(len(lines), BINS)
    filled = sig != none
    short = np.flatnonzero(~filled.all(axis=1))
    sig[short] = np.take_along_axis(sig[short], _sources(filled[short]), axis=1)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys."""
    bands = sig.reshape(len(sig), ROWS, BANDS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _M[0], (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = _mix(key ^ bands[:, k]) * _M[0]
    return _mix(key)


def _distinct(texts: list[bytes]) -> dict[int, bytes]:
    return {line_id(x)[0]: x for x in {x for t in texts for _, x in lines_of(t)}}


def _batch_bands(table: pa.Table, parts: int) -> pa.Table:
    batch = table["batch"][0].as_py()
    lines = [(i, s) for i, x in _distinct(as_bytes(unpacked(table)["text"])).items() if len(s := x.decode("utf-8", "replace")) >= SHINGLE]
    ids = np.array([i for i, _ in lines], np.int64)
    keys, at = [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end][1]) <= CHUNK) and end - at < 50_000:
            size += len(lines[end][1])
            end += 1
        keys.append(band_keys(signatures([s for _, s in lines[at:end]])))
        at = end
    rows: list[list] = [[], [], [], []]
    if keys:
        key = np.concatenate(keys).ravel()
        owner = np.repeat(ids, BANDS)
        part = (key % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[cuts[p] : cuts[p + 1]]
            if len(mine):
                for column, x in zip(rows, (p, batch, key[mine].tobytes(), owner[mine].tobytes())):
                    column.append(x)
    return pa.table({n: pa.array(r, k) for n, k, r in zip(("part", "batch", "keys", "ids"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), rows)})


def _buckets(table: pa.Table, tile: int) -> pa.Table:
    """Of one part the sets of lines to verify together: buckets of two lines or more, larger
    ones in tiles, with the bucket's key as ``hot`` and the tile's number. A set is named by a
    hash of its members. A line that several batches have is asked of any of them."""
    each = [(b, np.frombuffer(k, np.uint64), np.frombuffer(i, np.int64)) for b, k, i in zip(*(table[c].to_pylist() for c in ("batch", "keys", "ids")))]
    names, kinds = ("name", "ids", "batches", "hot", "tile"), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
    if not each:
        return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
    key, ids = np.concatenate([k for _, k, _ in each]), np.concatenate([i for _, _, i in each])
    batch = np.repeat([b for b, _, _ in each], [len(k) for _, k, _ in each])
    order = np.lexsort([_mix(ids.view(np.uint64) ^ (batch.astype(np.uint64) * _M[0])), ids, key])
    key, ids, batch = key[order], ids[order], batch[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
    key, ids, batch = key[once], ids[once], batch[once]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))

    # buckets of two, most of all, together
    two = start[size == 2]
    pair, owner = np.stack([ids[two], ids[two + 1]], axis=1), np.stack([batch[two], batch[two + 1]], axis=1).astype(np.int32)
    hashes = (_mix(pair[:, 0].astype(np.uint64) * _M[0] ^ _mix(pair[:, 1].astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
    hashes, first = np.unique(hashes, return_index=True)
    raw, raw_owner = pair[first].tobytes(), owner[first].tobytes()
    out = [hashes.tolist(), [raw[i : i + 16] for i in range(0, len(raw), 16)], [raw_owner[i : i + 8] for i in range(0, len(raw_owner), 8)], [None] * len(hashes), [None] * len(hashes)]
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        hot = None if n <= tile else int(key[s].view(np.int64))
        for number, at in enumerate(range(s, s + n, tile)):
            members = slice(at, min(at + tile, s + n))
            name = set_name(ids[members] if hot is None else np.append(ids[members], hot))
            for column, x in zip(out, (name, ids[members].tobytes(), batch[members].astype(np.int32).tobytes(), hot, number if hot is not None else None)):
                column.append(x)
    return pa.table({n: pa.array(r, k) for n, k, r in zip(names, kinds, out)})


def set_name(ids: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1


def _requests(batch: pa.RecordBatch) -> pa.Table:
    """A set's members, asked for from the batches that hold them; ``lead`` is the first of them."""
    out: list[list] = [[], [], [], []]
    for name, ids, batches in zip(*(batch.column(c).to_pylist() for c in ("name", "ids", "batches"))):
        i, b = np.frombuffer(ids, np.int64), np.frombuffer(batches, np.int32)
        for x in set(b.tolist()):
            for column, y in zip(out, (x, name, int(i[0]), i[b == x].tobytes())):
                column.append(y)
    return pa.table({n: pa.array(r, k) for n, k, r in zip(("batch", "name", "lead", "ids"), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), out)})


def _answers(docs: pa.Table, asked: pa.Table) -> pa.Table:
    out: list[list] = [[], [], [], []]
    if docs.num_rows and asked.num_rows:
        lines = _distinct(as_bytes(unpacked(docs)["text"]))
        for name, lead, ids in zip(*(asked[c].to_pylist() for c in ("name", "lead", "ids"))):
            for column, y in zip(out, (name, lead, ids, [lines[i] for i in np.frombuffer(ids, np.int64).tolist()])):
                column.append(y)
    return pa.table({"name": pa.array(out[0], pa.int64()), "lead": pa.array(out[1], pa.int64()), "ids": pa.array(out[2], pa.binary()), "texts": pa.array(out[3], pa.list_(pa.binary()))})


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def alike(a: set, b: set) -> bool:
    """Jaccard similarity of 0.8 or more."""
    if 10 * min(len(a), len(b)) < 8 * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 10 * both >= 8 * (len(a) + len(b) - both)


class Lines:
    """Shingle sets of lines by id, with union-find over them and the links that were found.

    A set is a sorted array of codes, one for each different shingle: the shingle's
    characters, numbered among those of all the lines, as the digits of a number. Where
    there are too many different characters for that, sets are sets of strings."""

    def __init__(self, texts: dict[int, bytes]) -> None:
        self.sets: dict[int, np.ndarray | set] = {}
        self.up: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []
        lines = {i: t.decode("utf-8", "replace") for i, t in texts.items()}
        alphabet = np.array(sorted({ord(c) for x in lines.values() for c in set(x)}), np.uint32)
        if len(alphabet) > MOST_CHARACTERS:
            self.sets = {i: shingles(x) for i, x in lines.items()}
            return
        for i, x in lines.items():
            digits = np.searchsorted(alphabet, np.frombuffer(x.encode("utf-32-le"), np.uint32)).astype(np.uint64)
            code = digits[: len(digits) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                code *= np.uint64(len(alphabet))
                code += digits[k : len(digits) - SHINGLE + 1 + k]
            code.sort()
            self.sets[i] = code[np.concatenate([[True], code[1:] != code[:-1]])]

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> None:
        self.up[self.root(b)] = self.root(a)
        self.found.append((a, b))

    def alike(self, i: int, j: int) -> bool:
        """Jaccard similarity of 0.8 or more."""
        a, b = self.sets[i], self.sets[j]
        if isinstance(a, set):
            return alike(a, b)
        n, m = len(a), len(b)
        if 10 * min(n, m) < 8 * max(n, m):
            return False
        every = np.concatenate([a, b])
        every.sort()
        both = int(np.count_nonzero(every[1:] == every[:-1]))
        return 10 * both >= 8 * (n + m - both)

    def verify(self, ids: list[int]) -> None:
        """Adds links until all alike lines of ``ids`` are connected.

        What is connected already is one group. First the groups' first members meet; then
        the groups that are left meet, pair by pair, until a link joins them."""
        groups: dict[int, list[int]] = {}
        for i in ids:
            groups.setdefault(self.root(i), []).append(i)
        left: list[list[int]] = []
        for g in groups.values():
            for other in left:
                if self.alike(other[0], g[0]):
                    self.link(other[0], g[0])
                    other.extend(g)
                    break
            else:
                left.append(g)
        for x, g in enumerate(left):
            for other in left[x + 1 :]:
                if len(g) + len(other) > 2 and self.root(g[0]) != self.root(other[0]):
                    pair = next(((i, j) for i in g for j in other if self.alike(i, j)), None)
                    if pair:
                        self.link(*pair)


def _verified(table: pa.Table) -> pa.Table:
    """Links of the sets of a group of sets; sets with one lead are in one group, so a pair
    that several of them hold is compared once."""
    members: dict[int, list[int]] = {}
    texts: dict[int, bytes] = {}
    for name, ids, own_texts in zip(*(table[c].to_pylist() for c in ("name", "ids", "texts"))):
        own = np.frombuffer(ids, np.int64).tolist()
        members.setdefault(name, []).extend(own)
        texts.update(zip(own, own_texts))
    lines = Lines(texts)
    for _, ids in sorted((min(x), x) for x in members.values()):
        lines.verify(sorted(ids))
    check = {i: line_id(texts[i])[1] for pair in lines.found for i in pair}
    return pa.table({n: pa.array(c, pa.int64()) for n, c in (
        ("a", [a for a, _ in lines.found]), ("b", [b for _, b in lines.found]), ("a_check", [check[a] for a, _ in lines.found]), ("b_check", [check[b] for _, b in lines.found]),
    )})


LINKS = "a long, b long, a_check long, b_check long"


def _once(sets: DataFrame) -> DataFrame:
    rest = [c for c in sets.columns if c != "name"]
    return sets.groupBy("name").agg(F.min(F.struct(*rest)).alias("s")).select("name", "s.*")


def _links(sets: DataFrame, batched: DataFrame, n: int) -> DataFrame:
    """Verified links of ``sets(name, ids, batches)`` with different names."""
    asked = arrow_map(sets.select("name", "ids", "batches"), _requests, "batch int, name long, lead long, ids binary").repartitionById(n, F.col("batch"))
    texts = batched.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(_answers, "name long, lead long, ids binary, texts array<binary>")
    some = texts.withColumn("some", F.pmod(F.xxhash64("lead", F.pmod("name", F.lit(SALT))), F.lit(n)).cast("int")).repartitionById(n, F.col("some"))
    return some.groupBy("some").applyInArrow(_verified, LINKS)


def _members(hot: DataFrame) -> DataFrame:
    """``(hot, tile, id, batch)`` of every line of the tiles of large buckets."""

    def run(b: pa.RecordBatch) -> pa.Table:
        each = list(zip(*(b.column(c).to_pylist() for c in ("hot", "tile", "ids", "batches"))))
        sizes = [len(x[2]) // 8 for x in each]
        join = lambda k, t: np.concatenate([np.frombuffer(x[k], t) for x in each] or [np.empty(0, t)])
        return pa.table({"hot": pa.array(np.repeat(np.array([x[0] for x in each], np.int64), sizes)), "tile": pa.array(np.repeat(np.array([x[1] for x in each], np.int32), sizes)), "id": join(2, np.int64), "batch": join(3, np.int32)})

    return arrow_map(hot, run, "hot long, tile int, id long, batch int")


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links.select("a", "b")).select(F.col("node").alias("id"), "root")
    return members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _as_set(key: tuple, t: pa.Table) -> pa.Table:
    ids = t["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])] if len(order) else order
    ids, batches = ids[order], t["batch"].to_numpy()[order].astype(np.int32)
    return pa.table({"name": pa.array([set_name(ids)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "batches": pa.array([batches.tobytes()], pa.binary())})


def _across_tiles(members: DataFrame, links: DataFrame, batched: DataFrame, n: int, tile: int) -> DataFrame:
    """Links between the tiles of large buckets, beyond ``links`` inside them."""
    sets = "name long, ids binary, batches binary"
    # one line of each component of a bucket meets the others, in tiles of their own
    one = _rooted(members, links).groupBy("hot", "root").agg(F.min(F.struct("id", "batch")).alias("m")).select("hot", "m.*")
    several = one.groupBy("hot").agg((F.count("*") / tile).cast("int").alias("tiles"), F.count("*").alias("n")).filter("n > 1")
    firsts = one.join(several, "hot").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles") + 1)).groupBy("hot", "tile").applyInArrow(_as_set, sets)
    links = links.unionByName(written(_links(_once(firsts), batched, n), "line-links"))
    # tiles with lines of different components meet pair by pair
    rooted = written(_rooted(members, links), "line-members")
    tiles = rooted.groupBy("hot", "tile").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = tiles.groupBy("hot").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("hot")
    tiles = tiles.join(mixed, "hot")
    other = tiles.select("hot", F.col("tile").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    apart = tiles.join(other, "hot").filter("tile < other and not (low = high and other_low = other_high and low = other_low)")
    ends = apart.select("hot", F.explode(F.array("tile", "other")).alias("tile"), F.struct("tile", "other").alias("pair"))
    meeting = rooted.join(ends, ["hot", "tile"]).groupBy("hot", "pair").applyInArrow(_as_set, sets)
    return links.unionByName(written(_links(_once(meeting), batched, n), "line-links"))


def alike_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, batch_bytes: int = 16 << 20) -> DataFrame:
    """Verified links ``(a, b, a_check, b_check)`` between line ids that connect all alike
    lines found."""
    batched, n = in_batches(docs, id_col, text_col, batch_bytes)
    bands = batched.groupBy("batch").applyInArrow(lambda t: _batch_bands(t, n), "part int, batch int, keys binary, ids binary")
    buckets = bands.repartitionById(n, F.col("part")).groupBy("part").applyInArrow(lambda t: _buckets(t, tile), "name long, ids binary, batches binary, hot long, tile int")
    once = _once(buckets)
    tiles = once.filter("hot is not null").select("hot", "tile", "ids", "batches")
    # links and the tiles of large buckets, in one job that shares its exchanges
    both = written(_links(once, batched, n).unionByName(tiles, allowMissingColumns=True), "line-links")
    links, hot = both.filter("a is not null").select("a", "b", "a_check", "b_check"), both.filter("hot is not null")
    return links if hot.isEmpty() else _across_tiles(written(_members(hot), "line-members"), links, batched, n, tile)


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, version, of, at, line, line_check)`` of every line: document, hash of its text,
    number of its lines, number of this one, and its name."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        names = []
        for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            lines = lines_of(text)
            for column, y in zip(out, ([NO_ID if doc is None else doc] * len(lines), [version] * len(lines), [len(lines)] * len(lines), [n for n, _ in lines])):
                column.extend(y)
            names += [xxhash.xxh3_128_digest(x) for _, x in lines]
        name = np.frombuffer(b"".join(names), ">i8").reshape(-1, 2).astype(np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(out, kinds)], pa.array(name[:, 1]), pa.array(name[:, 0])], ["doc", "version", "of", "at", "line", "line_check"])

    return arrow_map(rows, run, "doc long, version long, of long, at int, line long, line_check long")


def first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None, **options) -> DataFrame:
    """``(doc, version, at)`` of the line that stays of every component; ``lines``: the
    occurrences, if they are at hand."""
    links = alike_lines(docs, id_col, text_col, **options)
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("line"), F.col("a_check").alias("line_check")), F.struct(F.col("b").alias("line"), F.col("b_check").alias("line_check"))))).distinct()
    roots = components(links.select("a", "b")).join(ends, F.col("node") == F.col("line")).select("line", "line_check", "root")
    roots = written(roots, "line-roots")
    lines = occurrences(docs, id_col, text_col) if lines is None else lines
    first = lines.groupBy("line", "line_check").agg(F.min(F.struct("doc", "version", "at")).alias("first"))
    rooted = first.join(roots, ["line", "line_check"], "left")
    alone = F.when(F.col("root").isNull(), F.col("line_check")).alias("alone")  # not alike to any line, whatever 64 bits of its name say
    return rooted.groupBy(F.coalesce("root", "line").alias("root"), alone).agg(F.min("first").alias("first")).select("first.*")


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, n_lines, n_kept, kept_lines)`` per document: the numbers of the lines that
    stay, from 0, among all that a split at line feeds gives."""
    lines = occurrences(docs, id_col, text_col)
    kept = first_lines(docs, id_col, text_col, lines, **options).groupBy("doc", "version").agg(F.sort_array(F.collect_list("at")).alias("kept_lines"))
    counted = lines.groupBy("doc", "version").agg(F.max("of").alias("n_lines"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc"), F.xxhash64(text_col).alias("version"))
    both = rows.join(counted, ["doc", "version"], "left").join(kept, ["doc", "version"], "left")
    numbers = F.coalesce("kept_lines", F.expr("cast(array() as array<int>)"))
    return both.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(numbers).cast("long").alias("n_kept"), numbers.alias("kept_lines"))


def without_alike_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text of each row cut to the lines that stay and its blank lines."""
    kept = first_lines(docs, id_col, text_col, **options).groupBy("doc", "version").agg(F.collect_list("at").alias("kept"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc"), F.xxhash64(text_col).alias("version"))
    both = row.join(kept, ["doc", "version"], "left")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n", -1)
    blank = lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]", "") == ""
    keep = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: blank(s["x"]) | F.array_contains(F.coalesce("kept", F.expr("cast(array() as array<int>)")), s["i"]))
    cut = F.when(text.isNotNull(), F.array_join(F.transform(keep, lambda s: s["x"]), "\n"))
    return both.select(*[(cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
