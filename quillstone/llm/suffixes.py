"""Removal of repeated 50-byte strings, decided by suffix arrays over candidate passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, byte_runs, slices, small, tidy

LENGTH, GRAM = 50, 16  # bytes of a repeated string, and of the gram that anchors it
SPAN = LENGTH - GRAM + 1  # grams in a string
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
HOT, WIDTHS = 4096, (7, 1)  # distinct passages of one anchor from which they are split by context, and places of the anchor in a string that a split keeps together
BATCH = 1 << 17  # bytes of passages that are sorted together
RUN = 1 << 16  # bytes of texts that are hashed together
PASSAGE = ["id", "k", "h", "start", "passage"]


def suffix_array(text: list[int]) -> list[int]:
    """0-based suffix array by grouping suffixes by their Lyndon prefixes.

    Groups are processed from the highest down. The suffixes of a group point to the nearest position on their left that
    is in a lower group (found over links that skip finished positions); what is pointed to equally often, and was in one
    group, becomes the group next above its old one, as its Lyndon prefix grows by theirs. At the end the groups stand
    in order. Then suffixes are put in order from the smallest: whoever's Lyndon prefix ends where a placed suffix starts takes
    the next free place of its group.
    """
    n = len(text)
    marks = sorted(set(text))
    code = {c: k for k, c in enumerate(marks)}
    group = [-1, *(code[c] for c in text)]  # position 0 stands left of all
    member: list[list[int]] = [[] for _ in marks]
    for i in range(1, n + 1):
        member[group[i]].append(i)
    alive = [len(m) for m in member]
    below, above = [k - 1 for k in range(len(marks))], [k + 1 for k in range(len(marks))]
    left, size = list(range(n + 1)), [1] * (n + 1)
    done: list[list[int]] = []
    g = len(marks) - 1
    while g >= 0:
        now = member[g]
        if len(now) > alive[g]:
            now = [i for i in now if group[i] == g]
        if now:
            done.append(now)
            for i in now:
                left[i] = i - 1
            hits: dict[int, int] = {}
            for i in now:
                p = left[i]
                while left[p] != p:
                    left[p] = p = left[left[p]]
                left[i] = p
                size[p] += size[i]
                hits[p] = hits.get(p, 0) + 1
            hits.pop(0, None)
            times = {1} if len(hits) == len(now) else set(hits.values())
            for times_hit in sorted(times, reverse=True):
                moved: dict[int, list[int]] = {}
                for p, k in hits.items():
                    if k == times_hit:
                        moved.setdefault(group[p], []).append(p)
                for old, ps in moved.items():
                    if len(ps) < alive[old]:
                        new = len(member)
                        alive[old] -= len(ps)
                        alive.append(len(ps))
                        member.append(ps)
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = new
                        if up < len(below):
                            below[up] = new
                        for p in ps:
                            group[p] = new
        member[g] = []
        g = below[g]
    front, at = [0] * len(member), 0
    for now in reversed(done):
        front[group[now[0]]] = at
        at += len(now)
    ends = np.arange(1, n + 1) + np.array(size[1:], np.int64)
    by_end = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[by_end], np.arange(n + 3)).tolist()
    by_end = (by_end + 1).tolist()
    order = [0] * n
    start = n + 1
    for k in range(n + 1):
        for i in by_end[first[start] : first[start + 1]]:
            g = group[i]
            order[front[g]] = i
            front[g] += 1
        if k < n:
            start = order[k]
    return [i - 1 for i in order]


def anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 50-byte window of the texts between ``bounds`` its anchor is the gram with the least hash, the leftmost if several.

    (text, hash, packed) of the anchors, in order. ``packed`` is position in the text << 12 | steps from the first window << 6 | steps from
    the last window that it anchors. The texts are hashed in one go; windows that reach into the next text are left out.
    """
    n = len(raw)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (n - 7,), (1,))
    m = n - GRAM + 1
    h = word[:m] * MIX
    part = word[8 : 8 + m] * MIX2
    part >>= np.uint64(29)
    h ^= part
    np.left_shift(word[8 : 8 + m], np.uint64(17), out=part)
    h ^= part
    np.right_shift(h, np.uint64(32), out=part)
    h ^= part
    h *= MIX2
    np.right_shift(h, np.uint64(29), out=part)
    h ^= part
    np.bitwise_and(h, np.uint64(0xFFFFFFFF00000000), out=part)
    part |= np.arange(m, dtype=np.uint64)
    low, width = part, 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    at = np.ones(len(low), bool)
    for end in bounds[1:-1].tolist():
        at[max(0, end - LENGTH + 1) : end] = False
    at = np.flatnonzero(at)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    best = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1])
    last = np.concatenate([first[1:], [len(best)]]) - 1
    p = best[first]
    text = np.searchsorted(bounds, p, "right") - 1
    return text, h[p], p - bounds[text] << 12 | p - at[first] << 6 | p - at[last]


@tidy
def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, text) to (h, k, p, known), pieces of bounded size at a time.

    What a piece already shows to be in several texts goes out as ``known`` = h under a key of its text; two of its rows only go to
    meet the same anchor of other tasks. So an anchor that a third of all texts have sends few rows to one place.
    """

    def rows(h, k, p):
        h, k, p = (np.concatenate(x) for x in (h, k, p))
        # in order of the upper bits of h, then of text: where the lower bits differ, an anchor's rows may make up several groups, and fewer go out as known
        index = np.uint64((1 << len(h).bit_length()) - 1)
        order = (np.sort(h & ~index | np.arange(len(h), dtype=np.uint64)) & index).astype(np.int64)
        hs, ks = h[order], k[order]
        first = np.concatenate([[True], hs[1:] != hs[:-1]])
        other = np.concatenate([[False], (hs[1:] == hs[:-1]) & (ks[1:] != ks[:-1])])
        begin = np.flatnonzero(first)
        before = np.cumsum(other)
        size = np.diff(begin, append=len(h))
        before -= np.repeat(before[begin], size)  # other texts of the anchor so far
        shared = np.repeat(np.logical_or.reduceat(other, begin), size)
        free = np.zeros(len(h), bool)
        free[order] = shared & ~first & ~(other & (before == 1))
        spread = np.where(free, k.view(np.uint64) * MIX, h).view(np.int64)  # rows stay in order of text, which compresses
        return pa.RecordBatch.from_arrays([pa.array(spread), pa.array(k), pa.array(p), pa.array(h.view(np.int64), mask=~free)], ["h", "k", "p", "known"])

    for batch in batches:
        hs, ks, ps, held = [], [], [], 0
        keys = batch.column(0).to_numpy()
        for row, raw, bounds in byte_runs(batch.column(1), RUN):
            text, h, p = anchors(raw, bounds)
            if len(h):
                hs.append(h)
                ks.append(keys[row + text])
                ps.append(p)
                held += len(h)
            if held > 2_000_000:
                yield rows(hs, ks, ps)
                hs, ks, ps, held = [], [], [], 0
        if hs:
            yield rows(hs, ks, ps)


@tidy
def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k, text, marks of (h, p)) to (id, k, h, start, passage): the bytes of all windows of an anchor, about 16 MB of them at a time."""
    for batch in slices(batches, 128):
        marks = batch.column(3)
        row = np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy())
        h, packed = (x.to_numpy() for x in marks.flatten().flatten())
        p = packed >> 12
        start, end = p - (packed >> 6 & 63), p - (packed & 63) + LENGTH
        size = np.cumsum(end - start)
        for _, raw, bounds in byte_runs(batch.column(2), 1 << 62):
            text, begin, k = raw.tobytes(), bounds[row], 0
            while k < len(row):
                to = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + (1 << 24), "right")))
                x = slice(k, to)
                out = [text[a:b] for a, b in zip((begin[x] + start[x]).tolist(), (begin[x] + end[x]).tolist(), strict=True)]
                at = pa.array(row[x])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h[x]), pa.array(start[x]), pa.array(out, pa.binary())], PASSAGE)
                k = to


def _batch(out) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], PASSAGE)


def _window_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each 50-byte window, by differences of a running sum."""
    power = np.cumprod(np.full(len(raw), MIX | np.uint64(1), np.uint64))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[::-1])])
    h = (run[LENGTH:] - run[:-LENGTH]) * power[: len(raw) - LENGTH + 1]
    return h ^ h >> np.uint64(32)


def earlier_strings(group: np.ndarray, ids: np.ndarray, raw: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, lo, hi), in order: the ranges covered by 50-byte strings that a passage of the same group with a smaller id has too.

    The passages are distinct in their group and lie in ``raw`` between ``offset``. First, windows whose hash occurs once in their group are
    put aside: they can't recur. Each passage is cut to what is left, equal cuts are merged, and a group with one cut needs no order. All others
    are joined, sorted by ``suffix_array``, and neighbours with 50 equal bytes make up one class, with its least id.
    """
    none = np.empty(0, np.int64)
    windows = np.maximum(np.diff(offset) - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(windows)), windows)
    if not len(owner):
        return none, none, none
    where = np.arange(len(owner)) + np.repeat(offset[:-1] - np.cumsum(windows) + windows, windows)
    h = _window_hashes(raw)[where] + np.repeat(group.view(np.uint64) * MIX2, windows)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.flatnonzero(again)
    if not len(hit):
        return none, none, none
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner[hit])) + 1])
    last = np.concatenate([first[1:], [len(hit)]]) - 1
    who, begin, end = owner[hit[first]], where[hit[first]], where[hit[last]] + LENGTH
    data, id_of = raw.tobytes(), ids[who].tolist()
    cuts: dict[tuple[int, bytes], list[int]] = {}
    for j, (g, a, b) in enumerate(zip(group[who].tolist(), begin.tolist(), end.tolist(), strict=True)):
        cuts.setdefault((g, data[a:b]), []).append(j)
    several: dict[int, int] = {}
    for g, _ in cuts:
        several[g] = several.get(g, 0) + 1
    out: list[tuple[int, int, int]] = []  # j, and the range in its cut
    joined: list[tuple[bytes, list[int], int]] = []
    for (g, cut), js in cuts.items():
        least = min(id_of[j] for j in js)
        out += [(j, 0, len(cut)) for j in js if id_of[j] > least]
        if several[g] > 1:
            joined.append((cut, [j for j in js if id_of[j] == least], least))
    if joined:
        sizes = np.array([len(cut) for cut, _, _ in joined])
        base = np.cumsum(sizes + 1) - sizes - 1
        symbols = np.zeros(len(sizes) + sizes.sum(), np.int16)
        inside = np.ones(len(symbols), bool)
        inside[base + sizes] = False
        symbols[inside] = np.frombuffer(b"".join(cut for cut, _, _ in joined), np.uint8).astype(np.int16) + 1
        windows = sizes - LENGTH + 1
        window_of = np.repeat(np.arange(len(sizes)), windows)
        window_at = np.arange(len(window_of)) + np.repeat(base - np.cumsum(windows) + windows, windows)
        window_id = np.repeat(np.array([least for _, _, least in joined], np.int64), windows)
        index = np.full(len(symbols), -1)
        index[window_at] = np.arange(len(window_at))
        ranked = index[np.array(suffix_array(symbols.tolist()))]
        ranked = ranked[ranked >= 0]
        rows = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH)[window_at[ranked]]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
        least = np.minimum.reduceat(window_id[ranked], np.flatnonzero(new))[np.cumsum(new) - 1]
        covered = np.zeros(len(window_at), bool)
        covered[ranked] = least < window_id[ranked]
        at = np.flatnonzero(covered)
        if len(at):
            q, lo = window_of[at], window_at[at]
            ends = np.flatnonzero(np.append((lo[1:] - lo[:-1] > LENGTH) | (q[1:] != q[:-1]), True))
            starts = np.append(0, ends[:-1] + 1)
            q, lo, hi = q[starts], lo[starts], lo[ends] + LENGTH
            for x, a, b in zip(q.tolist(), (lo - base[q]).tolist(), (hi - base[q]).tolist(), strict=True):
                out += [(j, a, b) for j in joined[x][1]]
    if not out:
        return none, none, none
    j, lo, hi = np.array(out, np.int64).T
    order = np.lexsort((lo, j))
    shift = begin[j] - offset[who[j]]
    return who[j][order], (lo + shift)[order], (hi + shift)[order]


FOUND = "h bigint, sid bigint, first_id bigint, spans array<struct<lo:int,hi:int>>"


@tidy
def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sid, first_id, n, passage), groups of h together, to FOUND. Groups are gathered to about BATCH bytes before they are sorted.

    A passage that is alone in its group has no string of another: it is passed on if it has copies, and never unpacked.
    """
    names = ["h", "sid", "first_id", "spans"]
    spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first_id, n = (batch.column(c).to_numpy() for c in (0, 2, 3))
        row, lo, hi = earlier_strings(h, first_id, *next(byte_runs(batch.column(4), 1 << 62))[1:])
        size = np.bincount(row, minlength=len(h))
        kept = (n > 1) | (size > 0)
        to = np.append(0, np.cumsum(size[kept])).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (lo, hi)], ["lo", "hi"])
        return pa.RecordBatch.from_arrays([*batch.filter(pa.array(kept)).columns[:3], pa.ListArray.from_arrays(pa.array(to), found)], names)

    rest = None
    for batch in batches:
        h, n = (batch.column(c).to_numpy() for c in (0, 3))
        alone = np.zeros(len(h), bool)
        alone[1:-1] = (h[1:-1] != h[:-2]) & (h[1:-1] != h[2:])  # the first and last row may go on in another batch
        lone = batch.filter(pa.array(alone & (n > 1)))
        yield pa.RecordBatch.from_arrays([*lone.columns[:3], pa.array([[]] * lone.num_rows, spans)], names)
        batch = batch.filter(pa.array(~alone))
        batch = pa.concat_batches([rest, batch]) if rest is not None else batch
        h, held = batch.column(0).to_numpy(), np.append(0, np.cumsum(pc.binary_length(batch.column(4)).to_numpy()))
        begin = 0
        for end in (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist():
            if held[end] - held[begin] >= BATCH:
                yield flush(batch.slice(begin, end - begin))
                begin = end
        rest = batch.slice(begin)
    if rest is not None and rest.num_rows:
        yield flush(rest)


def _split(width: int):
    """(id, k, h, passage) to (id, k, h, start, passage): the strings of a passage by where they hold the anchor, ``width`` places together.

    Strings that hold it at places o to o + width - 1 share o bytes before it and SPAN - width - o bytes behind it; these make up the new h.
    Equal strings hold their anchor at the same place, so they meet again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, k, h, t in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                at = int(anchors(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[2][0]) >> 12
                for low in range(0, SPAN, width):
                    a, b = max(0, at - min(low + width, SPAN) + 1), min(len(t) - LENGTH, at - low)
                    if a <= b:
                        core = t[at - low : at + LENGTH - min(low + width, SPAN) + 1]
                        new = xxhash.xxh3_64_intdigest(core, seed=(h ^ low * 0x9E3779B1) & (1 << 64) - 1) - (1 << 63)
                        for to, v in zip(out, (i, k, new, a, t[a : b + LENGTH]), strict=True):
                            to.append(v)
            yield _batch(out)

    return run


def _left(texts: pa.Array, spans: pa.Array) -> Iterator[tuple[pa.ListArray, pa.Array]]:
    """What spans (lo, hi) leave of texts, some texts at a time: the union of the spans as maximal runs (start, end), and the other bytes."""
    for k, raw, bounds in byte_runs(texts):
        own = spans.slice(k, len(bounds) - 1)
        row = np.repeat(np.arange(len(own)), pc.fill_null(own.value_lengths(), 0).to_numpy())
        shift = bounds[row] + row  # texts stand one byte apart, so that no run goes from one to the next
        lo, hi = (x.to_numpy().astype(np.int64) + shift for x in own.flatten().flatten())
        order = np.argsort(lo)
        lo, hi, row = lo[order], np.maximum.accumulate(hi[order]), row[order]
        first = np.ones(len(lo), bool)
        first[1:] = lo[1:] > hi[:-1]
        at = np.flatnonzero(first)
        row, lo, hi = row[at], lo[at], hi[np.append(at[1:], len(hi)) - 1] if len(at) else hi
        to = np.append(0, np.cumsum(np.bincount(row, minlength=len(own)))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(to), pa.StructArray.from_arrays([pa.array(x - bounds[row] - row) for x in (lo, hi)], ["start", "end"]))
        step = np.zeros(len(raw) + 1, np.int8)
        np.add.at(step, lo - row, -1)
        np.add.at(step, hi - row, 1)
        stays = np.cumsum(step[:-1], dtype=np.int8) == 0
        gone = np.append(0, np.cumsum(np.bincount(row, weights=hi - lo, minlength=len(own)))).astype(np.int64)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(bounds - gone), pa.py_buffer(raw[stays])])
        yield runs, kept.cast(pa.binary())


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans of (lo, hi)) to (id, n_bytes, spans as maximal runs, kept bytes)."""
    for batch in batches:
        at = 0
        for runs, kept in _left(batch.column(1), batch.column(2)):
            part = batch.slice(at, len(kept))
            yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), runs, kept], ["id", "n_bytes", "spans", "kept"])
            at += len(kept)


def _found_spans(found: DataFrame, scratch: Scratch, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Passages (id, k, h, start, passage) to (k, spans): what strings with a smaller id cover.

    Equal passages of an anchor are one; those of an anchor go to one task and are sorted there, HOT at most. Where there are more, they
    are split by the context of the anchor and resolved the same way; the last split leaves single strings, so it needs no other.
    """
    distinct = found.groupBy("h", "passage").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    distinct = scratch.save(distinct.select("h", F.xxhash64("passage").alias("sid"), "first_id", "n", "passage"))
    hot = scratch.save(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("h"))
    n_hot = hot.count() if widths else 0
    usual = distinct.join(small(hot, n_hot), "h", "left_anti") if n_hot else distinct
    earlier = scratch.save(usual.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_groups, FOUND))
    held = [distinct, hot, earlier]
    if n_hot:
        many = distinct.join(small(hot, n_hot), "h", "left_semi").withColumn("k", F.xxhash64("h", "sid"))
        parts = scratch.save(many.select(F.col("first_id").alias("id"), "k", "h", "passage").mapInArrow(tidy(_split(widths[0])), "id bigint, k bigint, h bigint, start bigint, passage binary"))
        again = _found_spans(parts, scratch, widths[1:])
        back = many.join(again, "k", "left").where("spans is not null or n > 1").select("h", "sid", "first_id", F.coalesce("spans", F.array()).cast("array<struct<lo:int,hi:int>>").alias("spans"))
        earlier = earlier.unionByName(back)
        held += [parts, again]
    place = found.select("id", "k", "start", "h", F.xxhash64("passage").alias("sid"), F.length("passage").alias("size"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("size").alias("hi")))
    spans = F.when(F.col("id") > F.col("first_id"), whole).otherwise(F.col("spans"))
    spans = F.transform(spans, lambda s: F.struct((F.col("start") + s["lo"]).alias("lo"), (F.col("start") + s["hi"]).alias("hi")))
    out = scratch.save(place.join(earlier, ["h", "sid"]).select("k", F.explode(spans).alias("s")).groupBy("k").agg(F.collect_list("s").alias("spans")))
    scratch.drop(*held)
    return out


def repeated_spans(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column]:
    """(id, text: binary) to (k, spans), the byte ranges to remove, and the row key k.

    The key is the id; if an id comes with several texts, it is the id mixed with a hash of the text, so these stay apart.
    """
    whole = scratch.save(texts.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.length("text"), "text").alias("t2"), F.length("text").alias("n")))
    several = whole.select("id", "t1", "t2").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    key = F.col("id") if several.isEmpty() else F.xxhash64("id", F.xxhash64("text"))
    key_of_copy = F.col("id") if several.isEmpty() else F.xxhash64("id", "t1")
    firsts = whole.groupBy("t1", "t2").agg(F.min("id").alias("first"))
    copies = whole.join(firsts, ["t1", "t2"]).where(F.col("id") > F.col("first"))
    copies = scratch.save(copies.select(key_of_copy.alias("k"), "n").distinct())
    originals = texts.withColumn("k", key).join(small(copies.select("k"), copies.count()), "k", "left_anti")

    marks = originals.select("k", "text").mapInArrow(_anchor_rows, "h bigint, k bigint, p bigint, known bigint")
    over = W.partitionBy("h")
    marks = marks.withColumns({"lo": F.min("k").over(over), "hi": F.max("k").over(over)}).where("lo < hi or known is not null")
    marks = marks.select(F.coalesce("known", "h").alias("h"), "k", "p")
    marks = scratch.save(marks)

    by_text = marks.groupBy("k").agg(F.collect_list(F.struct("h", "p")).alias("marks"))
    found = originals.join(by_text, "k").select("id", "k", "text", "marks").mapInArrow(_passages, "id bigint, k bigint, h bigint, start bigint, passage binary")
    found = scratch.save(found)
    scratch.drop(marks)

    spans = _found_spans(found, scratch)
    scratch.drop(found)
    full = copies.where(F.col("n") >= LENGTH).select("k", F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n").cast("bigint").alias("hi"))).alias("spans"))
    out = scratch.save(spans.unionByName(full))
    scratch.keep_only(out)
    return out, key


def texts_id(key: str) -> Column:
    return F.col(f"`{key}`").cast("bigint").alias("id")


def texts_bytes(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept): each text without the bytes covered by a 50-byte string that starts in a document with a smaller key too.

    Texts are UTF-8 bytes (null: empty), strings never cross documents, overlaps count, and strings are judged on the
    input. ``spans`` are the maximal removed runs (start, end in bytes), ``kept`` the other bytes, joined.

    Copies of whole texts are found by hash. Every window of 50 bytes has an anchor, its 16-byte gram with the least hash, so
    equal windows have equal anchors: only anchors that several texts share are kept, with the bytes around them (passages).
    Equal passages are collapsed to their least key before they are brought together by anchor, and suffix arrays
    over the passages of an anchor find the classes of equal strings. Passages are grouped, never whole texts, and an anchor with
    more than HOT distinct passages is split by the bytes around it, so a string in a third of all texts fills no task.

    Texts under 50 bytes stay whole. Repeated rows (same key and text) are one document; rows that share a key but
    not a text are judged apart, none as smaller than the other. Null keys are never smaller, and keep their text.
    """
    texts = docs.select(texts_id(key), texts_bytes(text))
    spans, row_key = repeated_spans(texts.where("id is not null"), Scratch(docs.sparkSession))
    rows = texts.withColumn("k", row_key).join(spans, "k", "left").select("id", "text", "spans")
    out = rows.mapInArrow(_cut, "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", key)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated strings of ``remove_repeats`` cut out of its text column, all other columns and every row as they are.

    A character that loses some of its bytes goes whole. Null texts stay null.
    """

    @F.arrow_udf("string")
    def left(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t.decode("utf-8", "ignore") for _, kept in _left(texts, spans) for t in kept.to_pylist()], pa.string())

    texts = docs.select(texts_id(key), texts_bytes(text))
    spans, row_key = repeated_spans(texts.where("id is not null"), Scratch(docs.sparkSession))
    inner = [f"_in{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner, strict=True)], texts_id(key), texts_bytes(text)).withColumn("k", row_key)
    rows = rows.join(spans, "k", "left")
    at = inner[docs.columns.index(text)]
    new = F.when(F.col(at).isNotNull(), F.when(F.col("spans").isNull(), F.col(at)).otherwise(left(F.col("text"), F.col("spans"))))
    return rows.select(*[(new if i == at else F.col(i)).alias(c) for c, i in zip(docs.columns, inner, strict=True)])
