"""Spelling variants: words one edit apart, by permuterm rotations.

Every word with a terminator behind it has a rotation for each place to begin. The rotation that begins behind a letter ends with that letter, so
words that differ in it only share all but the last symbol of that rotation; a word without the letter has just these symbols as a whole rotation.
So a row (those symbols, word) for each letter and each whole rotation, sorted, brings near words together. Such a group has
at most one word for each letter of the alphabet (90) and one without, and a scan gives each member its neighbours in it as a count and a best one.
Rotations are compared by 128 bits, worked out from sums over the word, so a long word costs its length and not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, order_ids, runs, small, tidy

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run of letters in so many loses a letter.
ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent as its variant.
TIMES = 2
ROTATIONS = "k1 bigint, k2 bigint, rank bigint, kind tinyint"
WHOLE, AGAIN, FIRST = 0, 1, 2
NONE = np.int64((1 << 63) - 1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(word, n) of all texts: lower-cased runs of letters, of which one in ``ONE_IN`` (by its crc32 with the id) loses a letter."""
    doc, run = fresh(docs, "doc", "run")
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias(doc), F.explode(F.split(f"`{text}`", f"[^{LETTERS}]+")).alias(run))
    rows = rows.where(F.length(run) >= LEAST_LENGTH)
    low = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    rows = rows.select(doc, low.alias("w")).withColumn("h", F.crc32(F.encode(F.concat_ws(":", doc, "w"), "UTF-8")))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    word = F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("w"))
    return rows.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rotation_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """(k1, k2, index of the word, kind) of the rotations of ``words`` without their last letters, and of their whole rotations.

    A letter equal to the one before it gives ``AGAIN``: it stands for replacements, but leaving it out is the same as leaving out the FIRST.
    """
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    p = np.arange(len(letters)) - begin[of]
    n = size[of]
    kind = np.full(len(letters), FIRST, np.int8)
    kind[1:][(letters[1:] == letters[:-1]) & (p[1:] > 0)] = AGAIN
    out = []
    for base in BASES:
        power = lambda b, most=int(size.max()) + 2: np.multiply.accumulate(np.r_[np.uint64(1), np.full(most, b, np.uint64)])
        up, down = power(base), power(pow(base, -1, 1 << 64))
        end = _mix(np.zeros(1, np.uint64), base)[0]
        term = _mix(letters, base) * up[p]
        total = np.cumsum(term, dtype=np.uint64)
        head = total - term
        before = head - head[begin[of]]
        whole = (total - head[begin[of]])[begin + size - 1]
        rest = whole[of] - before
        skipped = (rest - term) * down[p + 1] + end * up[n - p - 1] + before * up[n - p]
        turned = rest * down[p] + end * up[n - p] + before * up[n - p + 1]
        out.append(np.concatenate([skipped, turned, end + whole * up[1]]).view(np.int64))
    return *out, np.concatenate([of, of, np.arange(len(words))]), np.concatenate([kind, np.full(len(letters) + len(words), WHOLE, np.int8)])


def _rotations(batches):
    for batch in batches:
        ranks, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for b, e in runs(words, 100_000):
            k1, k2, of, kind = rotation_keys(words[b:e])
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ranks[b:e][of]), pa.array(kind)], ["k1", "k2", "rank", "kind"])


def scan_groups(k1, k2, rank, kind):
    """(rank, near, best) of the members of whole, sorted groups: how many other members are one edit away, and the best rank of these."""
    starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k1)]))
    cut, first = kind != WHOLE, kind == FIRST
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)[of]
    least = lambda mask: np.minimum.reduceat(np.where(mask, rank, NONE), starts)[of]
    best = least(cut)
    other = np.where(rank == best, least(cut & (rank != best)), best)
    near = np.where(cut, total(cut) - 1 + np.where(first, total(~cut), 0), total(first))
    best = np.where(cut, np.minimum(other, np.where(first, least(~cut), NONE)), least(first))
    met = np.flatnonzero(near)
    return rank[met], near[met], best[met]


def _scan(batches):
    held = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        others = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        end = others[-1] + 1 if len(others) else 0  # the last group may go on in the next batch
        held = [x[end:] for x in rows]
        if end:
            yield _met(*scan_groups(*(x[:end] for x in rows)))
    if held is not None:
        yield _met(*scan_groups(*held))


def _met(rank, near, best):
    return pa.RecordBatch.from_arrays([pa.array(rank), pa.array(near), pa.array(best)], ["rank", "near", "best"])


def _last(arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """(rank, root): the end of the chain of arcs (rank, to). Counts double along a chain, so six doublings of the pointers reach its end."""
    n = arcs.count()
    while True:
        then = small(arcs.select(F.col("rank").alias("to"), F.col("to").alias("then")), n)
        longer = scratch.save(arcs.join(then, "to", "left").select("rank", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("on")))
        scratch.drop(arcs)
        if longer.where("on").isEmpty():
            return longer.select("rank", F.col("to").alias("root"))
        arcs = longer


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least five letters that occurs three times or more in ``docs``.

    A word's form is the most frequent word one edit away (ties: the first in code-point order), if it is at least twice as frequent; the root is the
    last of the chain of forms. Null texts have no words; a null id is written as nothing in front of the colon. Rows are counted
    as they come, repeated ones too. Words may have any length. No words: an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.save(words_of(docs, doc_id, text))
    words = scratch.save(order_ids(counted, [F.desc("n"), F.asc("word")], "rank"))
    rotations = words.select("rank", "word").mapInArrow(tidy(_rotations), ROTATIONS)
    met = rotations.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(tidy(_scan), "rank bigint, near bigint, best bigint")
    near = scratch.save(met.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))
    many = words.count()
    named = lambda rank, word, n: small(words.select(F.col("rank").alias(rank), F.col("word").alias(word), F.col("n").alias(n)), many)
    found = words.join(small(near, many), "rank", "left").join(named("best", "form", "form_n"), "best", "left")
    is_form: Column = F.col("form_n") >= TIMES * F.col("n")
    found = scratch.save(found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n"))))
    ends = _last(scratch.save(found.where("best is not null").select("rank", F.col("best").alias("to"))), scratch)
    out = found.join(small(ends, many), "rank", "left").join(named("root", "last", "last_n"), "root", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
