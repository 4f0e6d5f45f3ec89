"""Line dedup: which lines of each document stay, as compressed bitmaps.

Keys of lines (stripped of white space, A-Z lower-cased) are range-partitioned by (hash, document, position), so a key that
stands in a third of all documents is spread over many ranges; a task streams its sorted range and holds one key at a time. What a range can't
know, whether its first key began in an earlier range, is settled by the first and last key of every range: two rows a range.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import Scratch, byte_runs, fresh, small, tidy

#: Keys of fewer code points never lose a line.
LEAST = 10
SPACE = b" \t\n\x0b\x0c\r"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
NO_ID = (1 << 63) - 1
KEYS = "h1 bigint, h2 bigint, doc bigint, t bigint, pos int"
FOUND = "kind int, h1 bigint, h2 bigint, doc bigint, t bigint, pos int"
DROP, OPEN, EDGE = 0, 1, 2


def _line_keys(batches, most: int = 100_000):
    """A row (hash of 128 bits, document, hash of its text, position) for each line with a long enough key."""
    for batch in batches:
        docs, texts = (batch.column(k).to_numpy() for k in (0, 1))
        digests, at, pos = [], [], []
        for first, data, bounds in byte_runs(batch.column(2)):
            data = data.tobytes().translate(FOLD)
            for k in range(len(bounds) - 1):
                for p, line in enumerate(data[bounds[k] : bounds[k + 1]].split(b"\n")):
                    key = line.strip(SPACE)
                    if len(key) >= LEAST and (len(key) >= 4 * LEAST or len(key.decode()) >= LEAST):
                        digests.append(xxhash.xxh3_128_digest(key))
                        at.append(first + k)
                        pos.append(p)
                        if len(pos) == most:
                            yield _keyed(digests, docs[np.array(at, np.int64)], texts[np.array(at, np.int64)], pos)
                            digests, at, pos = [], [], []
        yield _keyed(digests, docs[np.array(at, np.int64)], texts[np.array(at, np.int64)], pos)


def _keyed(digests, doc, t, pos):
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    columns = [np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), doc, t, np.array(pos, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc", "t", "pos"])


def _found(kind, h1, h2, doc, t, pos):
    names = ["kind", "h1", "h2", "doc", "t", "pos"]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), kind, np.int32)), *(pa.array(x) for x in (h1, h2, doc, t, pos))], names)


def _stream(batches):
    """One sorted range: lines that an earlier document of the range holds go (DROP); lines of the first document of the
    range's first key stay OPEN; an EDGE names the first document here of the range's first and last key."""
    key, owner, inside = None, 0, True  # inside: still in the range's first key
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, t, pos = (c.to_numpy() for c in batch.columns)
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        owners, first = doc[starts].copy(), starts[:1]
        if key is None:
            yield _found(EDGE, h1[first], h2[first], doc[first], t[first], pos[first])
        elif key == (h1[0], h2[0]):
            owners[0] = owner
        else:
            inside = False
        held = np.repeat(owners, np.diff(np.r_[starts, len(doc)]))
        gone = np.flatnonzero(doc != held)
        yield _found(DROP, h1[gone], h2[gone], doc[gone], t[gone], pos[gone])
        if inside:
            end = starts[1] if len(starts) > 1 else len(doc)
            same = np.flatnonzero(doc[:end] == held[:end])
            yield _found(OPEN, h1[same], h2[same], doc[same], t[same], pos[same])
            inside = len(starts) == 1
        key, owner = (h1[-1], h2[-1]), owners[-1]
    if key is not None:
        end = [np.array([x]) for x in (*key, owner)]
        yield _found(EDGE, *end, np.zeros(1, np.int64), np.zeros(1, np.int32))


@F.arrow_udf(BinaryType())
def _pack(dropped: pa.Array) -> pa.Array:
    def one(x):
        bits = np.ones(max(x) // 8 * 8 + 8, np.uint8)
        bits[np.asarray(x)] = 0
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)

    return pa.array([one(x) for x in dropped.to_pylist()], pa.binary())


@F.arrow_udf(StringType())
def _kept(text: pa.Array, keep: pa.Array) -> pa.Array:
    def one(t, k):
        if not t or not k:
            return t
        lines, bits = t.split("\n"), np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), bitorder="little")
        return "\n".join([line for p, line in enumerate(lines) if p >= len(bits) or bits[p]])

    return pa.array([one(t, k) for t, k in zip(text.to_pylist(), keep.to_pylist(), strict=True)], pa.string())


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that the bitmap ``keep`` keeps, joined by line feeds."""
    return _kept(text, keep)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines`` (of the text as it is), ``n_dropped`` and ``keep``; columns of these names are replaced.

    ``keep`` is a zlib-compressed bitmap, lowest bit first, one bit a line (1: it stays). It ends with the byte of the last line that goes,
    so lines behind its end stay, and it is empty where all lines stay. Select without the text, and no text is shuffled.

    A key of at least ten code points in two documents or more loses all its lines but those of the smallest id. Ids are whole
    numbers; rows of one id are one document, which never takes lines from itself, and a null id counts as larger than
    all others (rows without an id are one document). Null and empty texts are one empty line. Repeated rows get
    the same bitmap. An empty table gives an empty result. Keys are compared by 128-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    key = [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(f"`{text}`", F.lit(""))).alias("t")]
    rows = docs.where(F.length(f"`{text}`") >= LEAST).select(*key, F.col(f"`{text}`").alias("text"))
    order = ["h1", "h2", "doc", "t", "pos"]
    ranges = rows.mapInArrow(tidy(_line_keys), KEYS).repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.save(ranges.mapInArrow(_stream, FOUND))
    edges = scratch.save(found.where(f"kind = {EDGE}").groupBy("h1", "h2").agg(F.min("doc").alias("owner")))
    late = found.where(f"kind = {OPEN}").join(small(edges, edges.count()), ["h1", "h2"]).where("doc > owner")
    gone = found.where(f"kind = {DROP}").select("doc", "t", "pos").union(late.select("doc", "t", "pos"))
    doc, t, n, bits, key_ = fresh(docs, "doc", "t", "gone", "bits", "key")
    maps = gone.groupBy("doc", "t").agg(F.collect_set("pos").alias("pos"))
    maps = scratch.save(maps.select(F.col("doc").alias(doc), F.col("t").alias(t), F.size("pos").alias(n), _pack("pos").alias(bits)))
    scratch.keep_only(maps)
    lines = F.when(F.length(f"`{text}`") > 0, F.regexp_count(f"`{text}`", F.lit("\n")) + 1).otherwise(1)
    had = docs.drop("n_lines", "n_dropped", "keep").withColumn(key_, F.struct(*key))
    joined = had.join(maps, (F.col(f"{key_}.doc") == F.col(doc)) & (F.col(f"{key_}.t") == F.col(t)), "left")
    named = {"n_lines": lines.cast("long"), "n_dropped": F.coalesce(n, F.lit(0)).cast("long"), "keep": F.coalesce(bits, F.lit(b""))}
    return joined.withColumns(named).drop(key_, doc, t, n, bits)
