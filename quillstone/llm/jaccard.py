"""Near duplicates by Jaccard similarity of word shingles: a grouped prefix join, exact at any size of group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, byte_runs, small, tidy
from .components import components

WORDS = 5
CELL_BITS, CHUNK = 19, 1024  # the frequency sketch has 2**19 cells, moved in rows of 1,024
BITS = 1024  # of the parity sketch of a set
SKETCH = [f"s{k}" for k in range(BITS // 64)]
TURNS, PIVOTS, FEW = 3, 8, 8  # most turns of pairing with pivots, random orders that give the pivots of a turn, and candidates a token row from which turns go on
PIECE, BUCKET, OFTEN = 1 << 19, 1 << 18, 16  # tokens dealt together, tokens that meet in a bucket, and groups of a piece from which a token is frequent
SLICE, BYTES = 1 << 20, 8 << 20  # hashes of a piece of the texts, and bytes of text whose hashes meet in a bucket, where hashes of several sets are found
NEAREST = 4  # pivots of a group that are looked at in a turn
REMEMBERED = 200_000  # group or set hashes that a task remembers
BASE = 0x9E3779B97F4A7C15  # 5 modulo 8, so that differences of words don't vanish in a power of two
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
IN_WORD = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LETTER = np.array([(c + 32 if 65 <= c <= 90 else c) + 1 for c in range(256)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= P2
    h ^= h >> np.uint64(29)
    return h


class Shingler:
    """64-bit hashes of the 5-word shingles of UTF-8 texts, a run of texts at a time; A-Z in lower case, words apart at ASCII white space.

    The hash of a word is a difference of a running sum over the run, brought back to the word's own start.
    """

    LONG = 1 << 20  # a text beyond is taken in pieces that end between words

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _words(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, first word of each text and the number of all)."""
        n = len(raw)
        if len(self.power) < n + 1:
            self.power, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)])) for base in (BASE, pow(BASE, -1, 1 << 64)))
        word = IN_WORD[raw]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        full = bounds[:-1] < bounds[1:]
        first, last = bounds[:-1][full], bounds[1:][full] - 1
        start[first], end[last] = word[first], word[last]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTER[raw] * self.power[:n], out=run[1:])
        return _mix((run[e] - run[s]) * self.inverse[s]), np.searchsorted(s, bounds)

    def _long_words(self, raw: np.ndarray) -> np.ndarray:
        parts, at = [], 0
        while at < len(raw):
            cut = min(len(raw), at + self.LONG)
            while cut < len(raw) and IN_WORD[raw[cut]]:  # to the end of the word
                gap = np.flatnonzero(~IN_WORD[raw[cut : cut + 4096]])
                cut = cut + int(gap[0]) if len(gap) else min(len(raw), cut + 4096)
            parts.append(self._words(raw[at:cut], np.array([0, cut - at]))[0])
            at = cut
        return np.concatenate(parts)

    def shingles(self, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Hashes of each text, which may repeat. Fewer than five words: one hash for the whole sequence; no words: none."""
        if len(bounds) == 2 and len(raw) > self.LONG:
            words = self._long_words(raw)
            at = np.array([0, len(words)])
        else:
            words, at = self._words(raw, bounds)
        many = max(0, len(words) - WORDS + 1)
        h = words[:many].copy()
        for k in range(1, WORDS):
            h *= P1
            h += words[k : many + k]
        h = _mix(h)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(h[a : b - WORDS + 1])
            elif b > a:
                out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        return out


#: A row of a piece of the texts, as its packs hold it.
ROW = np.dtype([("id", "<i8"), ("named", "?"), ("t", "<i8"), ("n", "<i8"), ("key", "<u8"), ("shared", "<i8")])


def _spread_out(buckets: int):
    """(id, t, text) to packs of a piece: for each bucket the lower halves of the hashes that fall to it, once a piece and in order of sets, and the set of each.

    ``home`` has the piece's rows, with the count of a set's hashes that others of the piece have too; of these one goes out, for no set.
    """

    def packs(at: int, rows: list[tuple], sets: list[np.ndarray], place: dict[int, int]) -> pa.RecordBatch:
        sizes = [len(x) for x in sets]
        h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        of = np.repeat(np.arange(1, len(sets) + 1, dtype=np.int32), sizes)  # 0: no set
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], np.diff(h[order]) != 0]) if len(h) else np.empty(0, bool)
        one = new & np.concatenate([new[1:], [True]]) if len(h) else new
        shared = np.bincount(of[order[~one]], minlength=len(sets) + 1)
        owner = of.copy()
        owner[order[~one]] = 0
        out = np.sort(order[new])
        to = ((h[out] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        out, to = out[(by := np.argsort(to, kind="stable"))], np.sort(to)
        low, owner = h[out].astype(np.uint32), owner[out]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(to) != 0])) if len(to) else np.empty(0, np.int64)
        home = np.array([(i or 0, i is not None, t, n, key, shared[place[key]] if n else 0) for i, t, n, key in rows], ROW)
        ends = [*starts[1:].tolist(), len(to)]
        columns = [
            pa.array([-1, *to[starts].tolist()], pa.int32()),
            pa.array([at] * (len(starts) + 1), pa.int64()),
            pa.array([None, *[owner[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=False)]], pa.binary()),
            pa.array([home.tobytes(), *[low[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=False)]], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "piece", "owner", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, at = Shingler(), TaskContext.get().partitionId() << 32
        rows, sets, place, size = [], [], {}, 0
        for batch in batches:
            ids, ts = (batch.column(c).to_pylist() for c in (0, 1))
            for k, raw, bounds in byte_runs(batch.column(2)):
                for h in shingler.shingles(raw, bounds):
                    h = np.unique(h)
                    key = xxhash.xxh3_64_intdigest(h.tobytes())
                    rows.append((ids[k], ts[k], len(h), key))
                    if len(h) and key not in place:
                        sets.append(h)
                        place[key] = len(sets)
                    size, k = size + len(h) + 16, k + 1
                if size >= SLICE:
                    yield packs(at, rows, sets, place)
                    rows, sets, place, size, at = [], [], {}, 0, at + 1
        if rows:
            yield packs(at, rows, sets, place)

    return run


@tidy
def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of some buckets to (piece, home, sets): the sets of a piece whose hashes other pieces have too, once for each such hash. Homes go through."""
    held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def out(home: bool, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([home] * len(rows), pa.bool_()), pa.array([r[1] for r in rows], pa.binary())], ["piece", "home", "sets"])

    for batch in batches:
        homes = []
        for bucket, piece, owner, low in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
            if bucket < 0:
                homes.append((piece, low))
            else:
                held.setdefault(bucket, []).append((piece, np.frombuffer(owner, np.int32), np.frombuffer(low, np.uint32)))
        yield out(True, homes)
    for bucket in list(held):
        packs = held.pop(bucket)
        low = np.concatenate([x for _, _, x in packs])
        order = np.argsort(low, kind="stable")
        again = np.diff(low[order]) == 0
        more = np.zeros(len(low), bool)
        more[order[1:][again]] = more[order[:-1][again]] = True
        found = np.split(more, np.cumsum([len(x) for _, _, x in packs])[:-1])
        yield out(False, [(piece, sets.tobytes()) for (piece, owner, _), m in zip(packs, found, strict=True) if len(sets := owner[m & (owner > 0)])])


@tidy
def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What came back for some pieces, to their rows (id, t, n, key, may): at least three quarters of a set's hashes are shared, or it has no partner."""
    homes: dict[int, np.ndarray] = {}
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for piece, home, x in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
            if home:
                homes[piece] = np.frombuffer(x, ROW)
            else:
                sets, count = np.unique(np.frombuffer(x, np.int32), return_counts=True)
                found.setdefault(piece, []).append(np.stack([sets, count]))
    for piece in list(homes):
        x, more = homes.pop(piece), found.pop(piece, [])
        _, first, at = np.unique(np.where(x["n"] > 0, x["key"], 0), return_index=True, return_inverse=True)
        first = np.sort(first[x["n"][first] > 0])
        number = np.zeros(len(x), np.int64)
        number[first] = np.arange(1, len(first) + 1)
        of = np.zeros(at.max() + 1, np.int64)
        of[at[first]] = number[first]
        shared = np.zeros(len(first) + 1, np.int64)
        for sets, count in more:
            shared[sets] += count
        may = (x["n"] > 0) & (4 * (x["shared"] + shared[of[at]]) >= 3 * x["n"])
        plain = lambda c: pa.array(x[c].copy().view(np.int64))  # noqa: B023, E731
        ids = pa.array(x["id"].copy(), mask=~x["named"])
        yield pa.RecordBatch.from_arrays([ids, plain("t"), plain("n"), plain("key"), pa.array(may)], ["id", "t", "n", "key", "may"])


def judged(texts: DataFrame) -> DataFrame:
    """(id, t, n, key, may) of (id, t, text): hash of the text, set size, hash of the set, and if the set may link with another at all.

    Linked sets share three quarters of the elements of each, so what has fewer in common with all others together is put aside. Each piece of the
    table sends every hash once, 32 bits of it to the bucket that the others give; what comes back is a number for each hash that other pieces have. Hashes that
    collide can only keep a set in.
    """
    held = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-held // BYTES))
    home = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    packs = texts.mapInArrow(tidy(_spread_out(buckets)), "bucket int, piece bigint, owner binary, low binary").repartition(buckets, home)
    back = packs.mapInArrow(_several, "piece bigint, home boolean, sets binary").repartition(buckets, "piece")
    return back.mapInArrow(_judge, "id bigint, t bigint, n bigint, key bigint, may boolean")


def _sets(texts: DataFrame) -> DataFrame:
    """(key, items): the hashes of each text's set, packed; a set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for batch in batches:
            for _, raw, bounds in byte_runs(batch.column(0)):
                found = [np.unique(h).tobytes() for h in shingler.shingles(raw, bounds)]
                keys = [xxhash.xxh3_64_intdigest(x) for x in found]
                new = pa.array(_first_times(keys, seen))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)).filter(new), pa.array(found, pa.binary()).filter(new)], ["key", "items"])

    return texts.select("text").mapInArrow(tidy(run), "key bigint, items binary")


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        for _, raw, _ in byte_runs(batch.column(0)):
            cells += np.bincount((raw.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
    rows = cells.reshape(-1, CHUNK)
    full = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([rows[k].tobytes() for k in full], pa.binary())], ["chunk", "cells"])


@tidy
def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(cells, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "cells"])


def shingle_frequencies(sets: DataFrame) -> np.ndarray:
    """Counts of the shingles of sets by hash cell. The sketch has a fixed size (4 MB), whatever the number of documents.

    Each task counts into its own sketch; the sketches are summed by chunk, as a stream. The estimates only fix the global
    order of shingles (rare first); any order gives right results, this one keeps frequent shingles out of prefixes.
    """
    parts = sets.select("items").mapInArrow(_sketch, "chunk int, cells binary").repartition(16, "chunk").mapInArrow(_add_up, "chunk int, cells binary")
    cells = np.zeros((1 << CELL_BITS) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    for k, x in parts.collect():  # 512 rows of 8 kB at most
        cells[k] += np.frombuffer(x, np.int64)
    return np.minimum(cells.ravel(), 2**31 - 1).astype(np.int32)


def prefix_length(n: int) -> int:
    """Two sets of n or more shingles that reach 0.75 share one of their first n - ceil(0.75 n) + 1 in any common order."""
    return n - -(-3 * n // 4) + 1


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Bit k tells if an odd number of hashes fall to k: where two sketches differ, the sets differ in one element at least."""
    return np.packbits((np.bincount((h & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _first_times(hashes: list[int], seen: set[int]) -> list[bool]:
    out = []
    for h in hashes:
        out.append(h not in seen)
        if len(seen) >= REMEMBERED:
            seen.clear()
        seen.add(h)
    return out


def _prefixes(sets: DataFrame, cells: np.ndarray) -> DataFrame:
    """(key, n, grp, prefix, sketch columns): hash of the set, its size, hash of prefix and size, the prefix for the first of a group in a task, and the sketch."""
    shared = sets.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, freq = set(), shared.value
        for batch in batches:
            for at, raw, bounds in byte_runs(batch.column(1)):
                sizes, grps, prefixes, sketches = [], [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    h = raw[a:b].view(np.uint64)
                    n = len(h)
                    f = freq[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    first = h[np.argsort(f, kind="stable")[: prefix_length(n)]]  # ties by hash, as h is in order
                    sizes.append(n)
                    grps.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=n))
                    prefixes.append(first.tobytes())
                    sketches.append(parity_sketch(h))
                prefixes = [p if new else None for p, new in zip(prefixes, _first_times(grps, seen), strict=True)]
                columns = [batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(np.array(grps, np.uint64).view(np.int64)), pa.array(prefixes, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in np.array(sketches).T.copy()]], ["key", "n", "grp", "prefix", *SKETCH])

    schema = "key bigint, n bigint, grp bigint, prefix binary, " + ", ".join(f"{c} bigint" for c in SKETCH)
    return sets.select("key", "items").mapInArrow(tidy(run), schema)


def _linked(na, nb, common):
    """100 * intersection >= 75 * union; numbers, numpy arrays or columns."""
    return 7 * common >= 3 * (na + nb)


def _deal(buckets: int):
    """(grp, n, prefix) to packed rows by token bucket, a piece of the table at a time.

    A token that over OFTEN groups of a piece have goes out as ``known``, in packs that may go anywhere; two of its rows go to
    its bucket, to meet the token's rows of other pieces. So no bucket fills with one token.
    """

    def pack(bucket: int, known: bool, part: list[np.ndarray]):
        return bucket, known, *[x.tobytes() for x in part]

    def rows(held: list[list[np.ndarray]], turn: int) -> pa.RecordBatch:
        t, g, n, pos = (np.concatenate(x) for x in held)
        order = np.argsort(t, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0]))
        count = np.diff(np.concatenate([first, [len(t)]]))
        place = np.arange(len(t)) - np.repeat(first, count)
        often = np.repeat(count > OFTEN, count)
        known, usual = order[often], np.sort(order[~often | (place < 2)])  # in order of text, which compresses
        out = [pack((k + turn) % buckets, True, [x[known[k : k + (1 << 16)]] for x in (t, g, n, pos)]) for k in range(0, len(known), 1 << 16)]
        at = ((t[usual] * P1 >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        usual, at = usual[(by := np.argsort(at, kind="stable"))], at[by]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0])) if len(at) else []
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            out.append(pack(int(at[a]), False, [x[usual[a:b]] for x in (t, g, n, pos)]))
        kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["bucket", "known", "t", "g", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [[], [], [], []], 0, 0
        for batch in batches:
            for g, n, prefix in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                t = np.frombuffer(prefix, np.uint64)
                for to, x in zip(held, (t, np.full(len(t), g, np.int64), np.full(len(t), n, np.int32), np.arange(len(t), dtype=np.int32)), strict=True):
                    to.append(x)
                size += len(t)
                if size >= PIECE:
                    yield rows(held, turn)
                    held, size, turn = [[], [], [], []], 0, turn + 1
        if size:
            yield rows(held, turn)

    return run


def _spread(g: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """A random order of groups for each ``turn``."""
    return _mix((g.view(np.uint64) + turn.astype(np.uint64) * P1) * P1)


def _stars(t: np.ndarray, g: np.ndarray, n: np.ndarray, pos: np.ndarray, known: bool) -> list[pa.RecordBatch]:
    """Rows of tokens that several groups have, and the pairs of a group and its token's pivot that can reach the similarity."""
    order = np.lexsort((_spread(g, t % np.uint64(PIVOTS)), t))
    t, g, n, pos = t[order], g[order], n[order], pos[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    again = np.concatenate([[False], ~new[1:] & (g[1:] == g[:-1])])
    t, g, n, pos = t[~again], g[~again], n[~again], pos[~again]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    count = np.diff(np.concatenate([first, [len(t)]]))
    keep = np.repeat(count > 1, count) | known
    pivot = np.repeat(first, count)
    pair = keep & (pivot != np.arange(len(t))) & _linked(n, n[pivot], 1 + np.minimum(n - pos - 1, n[pivot] - pos[pivot] - 1))
    ends = np.unique(np.stack([g[pivot[pair]], g[pair]], 1), axis=0) if pair.any() else np.empty((0, 2), np.int64)
    batch = lambda kind, a, b, c: pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], ["kind", "token", "grp", "pos"])
    return [batch(0, t[keep].view(np.int64), g[keep], pos[keep].astype(np.int32)), batch(1, ends[:, 0].copy(), ends[:, 1].copy(), np.zeros(len(ends), np.int32))]


@tidy
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of some buckets to (0, token, grp, pos) of shared tokens and (1, pivot, grp, 0) of pairs."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for bucket, known, *packs in zip(*[batch.column(c).to_pylist() for c in range(6)], strict=True):
            part = [np.frombuffer(x, k) for x, k in zip(packs, (np.uint64, np.int64, np.int32, np.int32), strict=True)]
            if known:
                yield from _stars(*part, True)
            else:
                held.setdefault(bucket, []).append(part)
    for bucket in list(held):
        yield from _stars(*[np.concatenate(x) for x in zip(*held.pop(bucket), strict=True)], False)


@tidy
def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) to the (a, b) whose sets reach the similarity."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            good.append(bool(_linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _may_link() -> Column:
    """Linked sets of n1 and n2 differ in (n1 + n2) / 7 elements at most, and their sketches in no more bits: what has more can't link."""
    return 7 * _differ() <= F.col("n1") + F.col("n2")


def _differ() -> Column:
    differ = F.lit(0)
    for c in SKETCH:
        differ = differ + F.bit_count(F.col(c + "1").bitwiseXOR(F.col(c + "2")))
    return differ


def verify(pairs: DataFrame, sets: DataFrame, room: int, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b, n1: size of a) whose whole sets reach the similarity.

    The set of a goes to b's task with each pair, and the set of b once. Pairs are taken in as many slices as it takes to send
    about ``room`` elements each; a slice's files are gone before the next one.
    """
    n, held = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    slices, out = max(1, -(-held // max(room, 1 << 20))), None
    for k in range(slices):
        part = pairs.where(F.pmod(F.xxhash64("b"), F.lit(slices)) == k).select("a", "b")
        left = sets.select(F.col("key").alias("a"), F.col("items").alias("x")).join(small(part, n), "a")
        right = sets.join(small(part.select(F.col("b").alias("key")).distinct(), n), "key", "left_semi").select(F.col("key").alias("b"), F.col("items").alias("y"))
        found = scratch.save(left.join(right, "b").select("a", "b", "x", "y").mapInArrow(_check, "a bigint, b bigint"))
        out = found if out is None else out.union(found)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row; see ``near_duplicate_rows``."""
    return near_duplicate_rows(docs, key, text).drop("text_hash")


def near_duplicate_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, n_shingles, component_id) of each row; texts with Jaccard >= 0.75 on 5-word shingles are linked.

    Rows are collapsed to classes (equal sets). Sets of which under three quarters are found in any others are put aside (``judged``), the rest
    collapsed to groups (equal prefix and size). Groups that share a prefix shingle are paired with one pivot, the least by one of eight random orders; group pairs pass the size and position filters, are expanded to
    classes, and pass the parity sketch (all three filters are exact). In a turn the nearest pivot of each class, of those that
    its group shares most tokens with, is verified on whole sets and joins components. Turns go on until token rows have few candidates each, or three are done; then all pairs of groups across components
    are filtered (those of one class each by their sketches too, where tokens meet, so that pairs that can't link become no rows), expanded and verified. Pairs inside a component change nothing, so thousands of near copies cost about one pair
    each, and no link between components is lost. Links inside a component are not listed: this is a join into classes.

    Sets are compared by 64-bit hashes of shingles, and equal sets found by a 64-bit hash of the set. Null and empty
    texts have an empty set and link with nothing; a text of under five words is one shingle. Repeated rows are copies, and rows that
    share a key are judged apart. component_id is the least key that links reach; rows without a key take part, but never name a
    component (null if no row of theirs has a key). Keys are whole numbers. ``text_hash`` is xxhash64 of the text as bytes.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("t"), "text")
    rows = scratch.save(judged(texts))
    classes = scratch.save(rows.where("n > 0").groupBy("n", "key").agg(F.min("id").alias("rep"), F.min(F.when(F.col("may"), F.struct("id", "t"))).alias("at")))
    n_classes, n_asked = classes.agg(F.count(F.lit(1)), F.count("at")).first()
    asked = classes.where("at is not null").select(F.col("at.id").alias("own"), F.col("at.t").alias("same"))
    wanted = texts.join(small(asked, n_asked), (F.col("t") == F.col("same")) & F.col("id").eqNullSafe(F.col("own")), "left_semi")
    sets = scratch.save(_sets(wanted))  # all that may have a partner
    wide = scratch.save(_prefixes(sets, shingle_frequencies(sets)))
    buckets = max(1, -(-(wide.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 4) // BUCKET))
    prefixes = wide.where("prefix is not null").select("grp", "n", "prefix")
    met = prefixes.mapInArrow(tidy(_deal(buckets)), "bucket int, known boolean, t binary, g binary, n binary, pos binary").repartition(buckets, "bucket")
    met = scratch.save(met.mapInArrow(_meet, "kind int, token bigint, grp bigint, pos int"))
    tokens = met.where("kind = 0").select("token", "grp", "pos")

    whole = wide.groupBy("n", "key", "grp").agg(*[F.first(c).alias(c) for c in SKETCH])
    several = wide.select("key", "grp").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("grp")
    busy = scratch.save(tokens.select("grp").union(several).distinct())
    n_busy = busy.count()
    members = scratch.save(whole.join(small(busy, n_busy), "grp", "left_semi"))  # all that have a candidate
    scratch.drop(wide)
    narrow = members.select("grp", "key", "n")
    n_members, room = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)) / 2).first()

    side = lambda c, t: members.select(F.col("key").alias(c), *[F.col(x).alias(x + t) for x in ("n", *SKETCH)])
    near = lambda pairs: pairs.join(side("a", "1"), "a").join(side("b", "2"), "b").where(_may_link())
    comps, tried = narrow.withColumn("comp", F.col("key")), None
    turn, left = 0, None

    def linked(links: DataFrame) -> DataFrame:
        """``comps`` after more links, of which only the ends' components are looked at."""
        if tried is not None:
            for c in ("a", "b"):
                links = links.join(small(comps.select(F.col("key").alias(c), F.col("comp").alias("to")), n_members), c).drop(c).withColumnRenamed("to", c)
        found = components(links, scratch).select(F.col("node").alias("comp"), "root")
        return scratch.save(comps.join(small(found, n_members), "comp", "left").select("grp", "key", "n", F.coalesce("root", "comp").alias("comp")))

    while True:
        heads = comps.groupBy("grp").agg(F.min_by("key", F.struct(F.xxhash64("key", F.lit(turn)), "key")).alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("n").alias("n"))
        heads = scratch.save(heads)
        inside = comps.select("grp", "key").join(small(heads.where("lo < hi").select("grp", "head"), n_busy), "grp").where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
        if turn == 0:
            stars = met.where("kind = 1").select(F.col("token").alias("pivot"), "grp")
        else:
            at = (tokens if left is None else left).join(small(heads.select("grp", "n", "lo", "hi"), n_busy), "grp")
            spans = at.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count(F.lit(1)).alias("c")).where("l < h")
            spans = scratch.save(spans.select("token", "c"))
            n_spans, ends, ahead = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0))).first()
            new = scratch.save((tokens if left is None else left).join(small(spans.select("token"), n_spans), "token", "left_semi"))
            scratch.drop(met, *([] if left is None else [left]))
            left = new
            if turn == TURNS or ahead <= FEW * ends:
                break
            at = left.join(small(heads.select("grp", "n", "lo", "hi"), n_busy), "grp")
            order = F.struct(F.xxhash64("grp", F.pmod("token", F.lit(PIVOTS)), F.lit(turn)), F.col("grp").alias("pivot"), "n", "pos", "lo", "hi")
            best = at.groupBy("token").agg(F.min(order).alias("p")).select("token", "p.pivot", *[F.col(f"p.{c}").alias(c + "_p") for c in ("n", "pos", "lo", "hi")])
            apart = (F.col("grp") != F.col("pivot")) & ~((F.col("lo") == F.col("hi_p")) & (F.col("hi") == F.col("lo_p")))
            stars = at.join(best, "token").where(apart & _linked(F.col("n"), F.col("n_p"), 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n_p") - F.col("pos_p") - 1)))
            stars = stars.select("pivot", "grp")
        often = W.partitionBy("grp").orderBy(F.desc("c"), F.xxhash64("pivot", F.lit(turn)))
        stars = stars.groupBy("grp", "pivot").agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.row_number().over(often)).where(F.col("k") <= NEAREST).select("pivot", "grp")
        stars = stars.join(small(heads.select(F.col("grp").alias("pivot"), F.col("head").alias("b")), n_busy), "pivot")
        pairs = stars.join(small(comps.select("grp", F.col("key").alias("a")), n_members), "grp").select("a", "b").union(inside).where("a <> b").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        how_near = F.struct((_differ() / (F.col("n1") + F.col("n2"))).alias("d"), "b", "n1")
        pairs = scratch.save(near(pairs).groupBy("a").agg(F.min(how_near).alias("x")).select("a", "x.b", "x.n1"))
        comps = linked(verify(pairs, sets, int(room), scratch))
        tried = pairs if tried is None else tried.union(pairs)
        turn += 1

    sketches = members.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in SKETCH]).where("c = 1").drop("c")  # a group of several classes has none
    at = left.join(small(heads.select("grp", "n", "lo", "hi"), n_busy), "grp").join(sketches, "grp", "left")
    end = lambda rows, t, *by: rows.select(*by, *[F.col(c).alias(c + t) for c in rows.columns if c not in by])
    bound = 1 + F.least(F.col("n1") - F.col("pos1") - 1, F.col("n2") - F.col("pos2") - 1)
    apart = (F.col("grp1") < F.col("grp2")) & ~((F.col("lo1") == F.col("hi2")) & (F.col("hi1") == F.col("lo2")))
    groups = end(at, "1", "token").join(end(at, "2", "token"), "token").where(apart & _linked(F.col("n1"), F.col("n2"), bound) & F.coalesce(_may_link(), F.lit(True))).select("grp1", "grp2").distinct()
    one, two = end(comps.select("grp", "key", "comp"), "1"), end(comps.select("grp", "key", "comp"), "2")
    across = groups.join(small(one, n_members), "grp1").join(small(two, n_members), "grp2")
    within = comps.join(small(heads.where("lo < hi").select("grp"), n_busy), "grp", "left_semi").select("grp", "key", "comp")
    within = end(within, "1", "grp").join(end(within, "2", "grp"), "grp").where("key1 < key2")
    pairs = across.select("key1", "comp1", "key2", "comp2").union(within.select("key1", "comp1", "key2", "comp2")).where("comp1 <> comp2")
    pairs = near(pairs.select(F.col("key1").alias("a"), F.col("key2").alias("b")))
    less = F.col("n1") <= F.col("n2")  # the smaller set is sent with each pair
    pairs = pairs.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("b"), F.least("n1", "n2").alias("n1")).distinct()
    pairs = scratch.save(pairs)
    found = linked(verify(pairs, sets, int(room), scratch)).where("key <> comp").select("key", F.col("comp").alias("root"))
    root = classes.select("n", "key", "rep").join(small(found, n_members), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = scratch.save(root.groupBy("root").agg(F.min("rep").alias("component_id")))
    final = scratch.save(root.join(small(least, n_classes), "root").select("n", "key", "component_id"))
    scratch.keep_only(rows, final)
    out = rows.join(small(final, n_classes), ["n", "key"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("t").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"))
