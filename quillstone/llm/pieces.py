"""SentencePiece encoding and decoding of text columns: batched Viterbi over the pieces of a model file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import runs

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # piece types of the file format
UNKNOWN_PENALTY = 10.0
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
KNOWN_UNITS = 300_000  # encoded units that a task remembers


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """Pieces of a model file. ``keys`` are the sorted hashes of the normal pieces; ``order`` gives their ids."""

    raw: list[bytes]
    kinds: np.ndarray
    keys: np.ndarray
    order: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: list[int]
    unknown: int
    penalty: np.float32
    prefix: bool

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        names, scores, kinds, prefix = [], [], [], True
        for field, value in _fields(data):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(np.frombuffer(piece[2], "<f4")[0])
                kinds.append(piece[3])
            elif field == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(1, b"identity") != b"identity" or spec.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps white space is supported")
        kinds, scores = np.array(kinds), np.array(scores, np.float32)
        normal = np.flatnonzero(kinds == NORMAL)
        if any(SPACE in names[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece spans two words: texts can't be cut into units")
        keys = np.array([int(_run(np.array([[ord(c) for c in names[i]]], np.uint64))[0, -1]) for i in normal], np.uint64)
        order = np.argsort(keys)
        byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)] if (kinds == BYTE).any() else []
        raw = [bytes([byte_ids.index(i)]) if kinds[i] == BYTE else names[i].replace(SPACE, " ").encode() if kinds[i] == NORMAL else b"" for i in range(len(names))]
        unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        return cls(raw, kinds, keys[order], normal[order], scores[normal[order]], max(len(names[i]) for i in normal), byte_ids, unknown, np.float32(scores[normal].min() - UNKNOWN_PENALTY), prefix)

    def viterbi(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit's segmentation with the highest sum of scores; of equal ones that with the longest last piece.

        Units of one length advance together: for each end all starts are probed at once, and the first maximum is kept.
        """
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(units)
        lengths: dict[int, list[int]] = {}
        for k, unit in enumerate(units):
            lengths.setdefault(len(unit), []).append(k)
        for n, at in lengths.items():
            step = max(1, 500_000 // (n + 1))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                self._equal(n, part, [units[p] for p in part], out)
        return out

    def _equal(self, n: int, at: list[int], units: list[str], out: list[np.ndarray]) -> None:
        if not n:
            return
        w = len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(w, n)
        run = _run(chars.astype(np.uint64))
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.longest, BASE, np.uint64)]))
        best = np.zeros((w, n + 1), np.float32)
        start, piece = np.zeros((w, n + 1), np.int32), np.zeros((w, n + 1), np.int32)
        rows = np.arange(w)
        for end in range(1, n + 1):
            low = max(0, end - self.longest)
            probe = run[:, end : end + 1] - run[:, low:end] * power[end - low : 0 : -1]
            where = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            found = self.keys[where] == probe
            value = np.where(found, self.scores[where], np.float32(-np.inf))
            value[:, -1] = np.where(found[:, -1], value[:, -1], self.penalty)
            value = best[:, low:end] + value
            choice = np.argmax(value, axis=1)
            best[:, end] = value[rows, choice]
            start[:, end] = choice + low
            piece[:, end] = np.where(found[rows, choice], self.order[where[rows, choice]], -1)
        ids, begins = np.full((w, n), -2, np.int32), np.full(w, n)
        for col in range(n - 1, -1, -1):
            live = np.flatnonzero(begins > 0)
            if not len(live):
                break
            ids[live, col] = piece[live, begins[live]]
            begins[live] = start[live, begins[live]]
        unknown = (ids == -1).any(1)
        used = n - (ids != -2).sum(1)
        for r, k in enumerate(at):
            own = ids[r, used[r] :]
            out[k] = self._fall_back(units[r], own) if unknown[r] else own

    def _fall_back(self, unit: str, ids: np.ndarray) -> np.ndarray:
        """Unknown characters as the ids of their bytes, or as the unknown piece."""
        out, at = [], 0
        for i in ids.tolist():
            if i < 0:
                out += [self.byte_ids[b] for b in unit[at].encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
                at += 1
            else:
                out.append(i)
                at += len(self.raw[i].decode())
        return np.array(out, np.int32)

    def units(self, text: str) -> list[str]:
        """White-space runs with the word behind them; no piece spans two units."""
        return UNIT.findall((" " * self.prefix + text).replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        data = b"".join([self.raw[i] for i in ids])
        return data[self.prefix and data[:1] == b" " :].decode("utf-8", "replace")


def _run(chars: np.ndarray) -> np.ndarray:
    """Running polynomial hashes of rows of code points, from 0."""
    out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    for k in range(chars.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + (chars[:, k] + np.uint64(1))
    return out


def encode_ids(text: Column, path: str) -> Column:
    """array<int> of the piece ids of each text, by the model file at ``path`` (a place that all executors have).

    Whole texts; a null text gives null and an empty one no ids. Characters without a piece fall back to bytes. A task
    remembers encoded units, up to KNOWN_UNITS of them.
    """
    state: dict = {}

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        model = state.get("model") or state.setdefault("model", PieceModel.load(path))
        known = state.setdefault("known", {})
        texts_, data, sizes = texts.to_pylist(), [], []
        for begin, end in runs(texts_):
            part = [model.units(t) if t else [] for t in texts_[begin:end]]
            if len(known) > KNOWN_UNITS:
                known.clear()
            new = list(set().union(*part).difference(known))
            known.update(zip(new, (x.tobytes() for x in model.viterbi(new)), strict=True))
            for units in part:
                ids = b"".join([known[u] for u in units])
                data.append(ids)
                sizes.append(len(ids) // 4)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        values = pa.array(np.frombuffer(b"".join(data), np.int32))
        return pa.ListArray.from_arrays(ends, values, mask=texts.is_null())

    return encode(text)


def decode_ids(ids: Column, path: str) -> Column:
    """The texts of arrays of piece ids; null stays null."""
    state: dict = {}

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        model = state.get("model") or state.setdefault("model", PieceModel.load(path))
        return pd.Series([model.decode(x if x is None else x.tolist()) for x in rows], dtype=object)

    return decode(ids)
