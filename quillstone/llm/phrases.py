"""Phrase collocations by relational set mining (SETM).

A relation holds the occurrences of all frequent phrases of one length, sorted by piece and position, and is written before the next length is
begun. It is kept as blocks of phrase numbers: neighbours in a block stand at adjacent positions of one piece, and a zero ends each such run, so pieces and
positions need no columns, and the merge join of a relation with itself at the next position is a shift by one. Its pairs are counted by group, and
the relation of the next length is the semi-join of the pairs with the frequent groups: by a broadcast table where its checked
size allows it, else by a shuffle join and a regrouping of the blocks. Occurrences that nothing frequent adjoins are left out, as they can't grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .common import Scratch, byte_runs, order_ids, small, tidy

LEAST, LONGEST, TOP = 100, 5, 2000
SPACE, STOP = 32, 10
#: A-Z in small letters, tabs as blanks, and everything that ends a piece as a line feed.
FOLD = bytes(c + 32 if 65 <= c <= 90 else SPACE if c == 9 else STOP if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: So many pairs are counted together in a task.
PAIRS = 1_000_000
#: Places of a block that a join takes apart.
SPAN = 1 << 16
PACKED = 1 << 31


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, text of each, whether the next word follows it in the same piece) of texts that lie in ``data`` one after another."""
    b = np.frombuffer(data.tobytes().translate(FOLD), np.uint8)
    gap = (b == SPACE) | (b == STOP)
    begins = np.zeros(len(b), bool)
    begins[bounds[:-1][bounds[:-1] < len(b)]] = True
    starts = np.flatnonzero(~gap & (begins | np.r_[True, gap[:-1]][: len(b)]))
    offsets = np.r_[np.cumsum(~gap)[starts] - 1, np.count_nonzero(~gap)].astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(b[~gap].tobytes()))
    of, stops = np.searchsorted(bounds, starts, "right") - 1, np.cumsum(b == STOP)[starts]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (of[1:] == of[:-1]) & (stops[1:] == stops[:-1])
    return found, of, follows


def _texts(batches):
    """(languages, language of each word, different words, index of each word, whether the next word follows it) of runs of texts."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        codes, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        for first, data, bounds in byte_runs(batch.column(1), 1 << 20):
            found, of, follows = words(data, bounds)
            if len(found):
                coded = found.dictionary_encode()
                yield names, codes[first + of], coded.dictionary, coded.indices.to_numpy(), follows


def _count_words(batches):
    for names, lang, different, index, _ in _texts(batches):
        keys, n = np.unique(lang.astype(np.int64) * len(different) + index, return_counts=True)
        langs = pa.DictionaryArray.from_arrays(pa.array(keys // len(different)), names).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs, different.take(pa.array(keys % len(different))).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])


def _block(numbers: np.ndarray, follows: np.ndarray):
    """A block of the occurrences that have a frequent neighbour; ``numbers`` is zero at those that aren't frequent."""
    on = np.zeros(len(numbers), bool)
    on[:-1] = follows[:-1] & (numbers[:-1] > 0) & (numbers[1:] > 0)
    met = on.copy()
    met[1:] |= on[:-1]
    values, ends = numbers[met], ~on[met]
    out = np.zeros(len(values) + np.count_nonzero(ends), np.int64)
    out[np.arange(len(values)) + np.cumsum(ends) - ends] = values
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))], ["g"]) if len(out) else None


def _name_words(known):
    def run(batches):
        tables = known.value
        for names, lang, different, index, follows in _texts(batches):
            number = np.zeros((len(names), len(different)), np.int64)
            for k in np.unique(lang):
                if names[k] in tables:
                    values, ids = tables[names[k]]
                    at = pc.index_in(different, value_set=values)
                    number[k] = np.where(at.is_valid().to_numpy(zero_copy_only=False), ids[pc.fill_null(at, 0).to_numpy()], 0)
            if (block := _block(number[lang, index], follows)) is not None:
                yield block

    return run


def _steps(follows: np.ndarray) -> np.ndarray:
    """Positions that rise by one inside a run and by two after it."""
    return np.arange(len(follows)) + np.r_[0, np.cumsum(~follows)[:-1]]


def _word_rows(batches):
    """(block, position, language, word), for a join."""
    part, k = TaskContext.get().partitionId() << 32, 0
    for names, lang, different, index, follows in _texts(batches):
        langs = pa.DictionaryArray.from_arrays(pa.array(lang), names).cast(pa.string())
        columns = [pa.array(np.full(len(index), part + k)), pa.array(_steps(follows)), langs, different.take(pa.array(index)).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "pos", "lang", "word"])
        k += 1


def _pairs(batch) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, places where a pair of adjacent occurrences begins) of a batch of blocks."""
    g = batch.column(batch.num_columns - 1).flatten().to_numpy()
    return g, np.flatnonzero((g[:-1] > 0) & (g[1:] > 0))


def _count_pairs(batches):
    held, n = [], 0

    def counted():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        if max(a.max(), b.max()) < PACKED:
            keys, c = np.unique((a << 32) | b, return_counts=True)
            a, b = keys >> 32, keys & (PACKED * 2 - 1)
        else:
            keys, c = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
            a, b = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["x", "y", "n"])

    for batch in batches:
        g, at = _pairs(batch)
        if len(at):
            held.append((g[at], g[at + 1]))
            n += len(at)
        if n >= PAIRS:
            yield counted()
            held, n = [], 0
    if n:
        yield counted()


def _name_pairs(known):
    def run(batches):
        keys, ids = known.value
        for batch in batches:
            g, at = _pairs(batch)
            if len(at):
                want = (g[at] << 32) | g[at + 1]
                place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                number = np.zeros(len(g), np.int64)
                number[at] = np.where(keys[place] == want, ids[place], 0)
                if (block := _block(number, np.ones(len(g), bool))) is not None:
                    yield block

    return run


def _pair_rows(batches):
    """(block, position, x, y), for a join. A block has the runs that begin in ``SPAN`` places."""
    part, k = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        g, at = _pairs(batch)
        if len(at):
            begins = np.r_[0, np.flatnonzero(g == 0) + 1]
            span = begins[np.searchsorted(begins, at, "right") - 1] // SPAN
            yield pa.RecordBatch.from_arrays([pa.array(part + k + span), pa.array(at), pa.array(g[at]), pa.array(g[at + 1])], ["block", "pos", "x", "y"])
            k += int(span[-1]) + 1


def _regrouped(batches):
    """Blocks again, from numbers in order of block and position. The run that a batch ends in is held until it ends."""
    held, last = [], (-1, -1)
    for batch in batches:
        if not batch.num_rows:
            continue
        block, pos, number = (c.to_numpy() for c in batch.columns)
        goes_on = (block == np.r_[last[0], block[:-1]]) & (pos == np.r_[last[1], pos[:-1]] + 1)
        last = block[-1], pos[-1]
        begins = np.flatnonzero(~goes_on)
        cut = begins[-1] if len(begins) else len(block)
        held.append((number[:cut], goes_on[:cut]))
        if len(begins):
            yield from _held(held)
            held = [(number[cut:], goes_on[cut:])]
    yield from _held(held)


def _held(parts):
    if parts:
        number, goes_on = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(number) and (block := _block(number, np.r_[goes_on[1:], False])) is not None:
            yield block


def _joined(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Blocks of what ``rows`` has of ``groups``: sorted by Spark, which spills, so that no task holds a whole block."""
    named = rows.join(groups.select(*key, "id"), key).select("block", "pos", "id")
    return named.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(tidy(_regrouped), "g array<bigint>")


def _numbered(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``groups``, written, with ``id``: 1 and up without gaps, so that two fit into 64 bits."""
    rows = scratch.save(groups.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("part", before.alias("before")))  # a row for each written partition
    out = scratch.save(rows.withColumn("part", part).join(parts, "part").withColumn("id", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at", "part", "before"))
    scratch.drop(rows)
    return out


def _first_relation(docs: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Occurrences of frequent words."""
    if n > common.BROADCAST_ROWS:
        rows = docs.mapInArrow(tidy(_word_rows), "block bigint, pos bigint, lang string, word string")
        return _joined(rows, groups.withColumnRenamed("last", "word"), ["lang", "word"])
    table, known = groups.select("lang", "last", "id").toArrow(), {}
    for lang in table["lang"].unique().to_pylist():
        own = table.filter(pc.equal(table["lang"], lang))
        known[lang] = (own["last"].combine_chunks().cast(pa.large_string()), own["id"].to_numpy())
    return docs.mapInArrow(tidy(_name_words(docs.sparkSession.sparkContext.broadcast(known))), "g array<bigint>")


def _next_relation(relation: DataFrame, groups: DataFrame, n: int, before: int) -> DataFrame:
    """Occurrences of frequent phrases a word longer; ``before``: how many groups ``relation`` has."""
    if n > common.BROADCAST_ROWS or before >= PACKED:
        return _joined(relation.mapInArrow(tidy(_pair_rows), "block bigint, pos bigint, x bigint, y bigint"), groups, ["x", "y"])
    table = groups.select("x", "y", "id").toArrow()
    keys, ids = (table["x"].to_numpy() << 32) | table["y"].to_numpy(), table["id"].to_numpy()
    order = np.argsort(keys)
    return relation.mapInArrow(tidy(_name_pairs(relation.sparkSession.sparkContext.broadcast((keys[order], ids[order])))), "g array<bigint>")


def _score(total: Column) -> Column:
    """The lowest floor(1000 * a * total / (l * r)) over all cuts, with k, l and r; 38 digits hold the products."""
    d = lambda c: c.cast("decimal(18,0)")

    def cut(head: Column, k: Column) -> Column:
        tail = F.element_at("tails", -(k + 1).cast("int"))
        score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (d(F.col("a")) * d(total)), d(head) * d(tail))
        return F.struct(score.alias("score"), (k + 1).alias("k"), head.alias("l"), tail.alias("r"))

    return F.array_min(F.transform("heads", cut))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the ``top`` phrases of two to ``longest`` words that occur ``least`` times or more.

    Words stand in pieces; a phrase never leaves its piece. n: words of the language; a: occurrences of the phrase; l, r: of its two parts at the cut with the
    lowest score. A phrase inside a longer one that is as frequent is left out. Ties of scores go by a, then by phrase. Languages that are null count as
    ``und``. Null and empty texts have no words; repeated rows count as often as they come. No frequent phrase: an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    counted = scratch.save(rows.mapInArrow(tidy(_count_words), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("a")))
    totals = scratch.save(counted.groupBy("lang").agg(F.sum("a").alias("n")))
    none = F.array().cast("array<bigint>")
    frequent = counted.where(F.col("a") >= least).select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails"))
    groups = _numbered(frequent, scratch)
    n, before, levels, relation = groups.count(), 0, [], None
    for _ in range(2, longest + 1):
        if not n:
            break
        old, relation = relation, scratch.save(_first_relation(rows, groups, n) if relation is None else _next_relation(relation, groups, n, before))
        if old is not None:
            scratch.drop(old)
        pairs = relation.mapInArrow(tidy(_count_pairs), "x bigint, y bigint, n bigint").groupBy("x", "y").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        side = lambda key, *more: small(groups.select(F.col("id").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in more)), n)  # noqa: B023, E731
        longer = scratch.save(pairs).join(side("x", "lang", "phrase", "a", "heads"), "x").join(side("y", "last", "a", "tails"), "y").select(
            F.col("x_lang").alias("lang"), F.concat_ws(" ", "x_phrase", "y_last").alias("phrase"), F.col("y_last").alias("last"), "a",
            F.concat("x_heads", F.array("x_a")).alias("heads"), F.concat("y_tails", F.array("y_a")).alias("tails"), "x", "y",
        )
        longer = _numbered(longer, scratch)
        if levels:
            inside = longer.select(F.explode(F.array("x", "y")).alias("id"), "a").distinct()
            levels[-1] = levels[-1].join(inside, ["id", "a"], "left_anti")
        levels.append(longer)
        groups, before = longer, n
        n = groups.count()
    found = [x.select("lang", "phrase", "a", "heads", "tails") for x in levels] or [groups.select("lang", "phrase", "a", "heads", "tails")]
    for x in found[1:]:
        found[0] = found[0].union(x)
    scored = found[0].join(small(totals, totals.count()), "lang").withColumn("cut", _score(F.col("n")))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    placed = scratch.save(order_ids(scored, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")], "at")).withColumn("part", F.shiftright("at", 33))
    cells = placed.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    earlier = F.coalesce(F.sum("c").over(W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = scratch.save(cells.select("lang", "part", (earlier + 1 - F.col("first")).alias("shift")))
    out = placed.join(small(cells, cells.count()), ["lang", "part"]).withColumn("rank", F.col("at") + F.col("shift")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
