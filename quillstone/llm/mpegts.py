"""MPEG transport streams as binary columns: writing payloads, and parsing streams back."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 0x100, 0x101, 1, 0x06, 0xBD
UNIT, GROUP, TICKS = 8192, 8, 3600  # bytes in an access unit, units from one random-access point to the next, 90 kHz ticks a unit
PARSED = (
    "payload binary, packets bigint, bad_sync bigint, cc_errors bigint, crc_errors bigint, programs string, "
    "pts array<bigint>, random_access array<bigint>, unit_bytes array<bigint>"
)


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, most significant bit first, no reflection and no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def _section(table: int, ext: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ext.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return pat, pmt


def _table_packet(pid: int, section: bytes, cc: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | cc & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def _unit_packets(data: bytes, pts: int, key: bool, cc: int) -> np.ndarray:
    """The packets of one elementary packet; a random-access point carries the flag and the clock."""
    pes = np.frombuffer(b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data, np.uint8)
    first = min(len(pes), 176 if key else 184)
    rest = len(pes) - first
    n = 1 + -(-rest // 184)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (cc + np.arange(n)) & 15
    whole = rest // 184
    out[1 : 1 + whole, 4:] = pes[first : first + 184 * whole].reshape(whole, 184)
    ends = [(0, pes[:first])] + ([(n - 1, pes[first + 184 * whole :])] if rest > 184 * whole else [])
    for row, part in ends:
        out[row, PACKET - len(part) :] = part
        if free := 184 - len(part):
            out[row, 3] |= 0x20
            out[row, 4] = free - 1
            if free > 1:
                out[row, 5] = 0
    if key:
        base = pts & (1 << 33) - 1
        out[0, 5] = 0x50
        out[0, 6:12] = np.frombuffer((base << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    return out


def write_stream(payload: bytes | None) -> bytes | None:
    """A stream of one program with one private-data stream that holds ``payload``. None gives None; an empty payload gives its tables alone."""
    if payload is None:
        return None
    parts, cc, tables = [], 0, 0
    pat, pmt = _tables()
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        if key := k % GROUP == 0:
            parts += [_table_packet(0, pat, tables), _table_packet(PMT_PID, pmt, tables)]
            tables += 1
        if data := payload[at : at + UNIT]:
            packets = _unit_packets(data, k * TICKS, key, cc)
            cc += len(packets)
            parts.append(packets.tobytes())
    return b"".join(parts)


def _sections(body: bytes, starts: list[int]) -> list[bytes]:
    """Sections that begin at the pointers of unit starts; a section may span packets."""
    out = []
    for at in starts:
        at += 1 + (body[at] if at < len(body) else 0)
        while at + 3 <= len(body) and body[at] != 0xFF:
            size = 3 + (int.from_bytes(body[at + 1 : at + 3], "big") & 0xFFF)
            if at + size > len(body):
                break
            out.append(body[at : at + size])
            at += size
    return out


def _gather(packets: np.ndarray, offset: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload bytes in order, and where each packet's begin."""
    body = packets[np.arange(PACKET) >= offset[:, None]].tobytes()
    return body, np.concatenate([[0], np.cumsum(PACKET - offset)])[:-1]


def parse_stream(stream: bytes | None) -> dict | None:
    """Program tables, continuity counters, elementary packets, timestamps and random-access points of a stream.

    Packets without the sync byte are counted and left out, as is a cut last packet; sections with a wrong checksum are
    counted and left out; a counter that isn't the next of its PID (and no repeated packet) counts as an error.
    ``payload`` joins the elementary data of all streams that the program tables name, in order. None gives None.
    """
    if stream is None:
        return None
    whole = len(stream) // PACKET
    packets = np.frombuffer(stream, np.uint8, whole * PACKET).reshape(whole, PACKET)
    good = packets[:, 0] == SYNC
    bad = int(whole - good.sum()) + (len(stream) % PACKET > 0)
    packets = packets[good]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    start, control = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3
    field = np.where(control & 2 > 0, packets[:, 4].astype(np.int32) + 1, 0)
    offset = np.where(control & 1 > 0, np.minimum(4 + field, PACKET), PACKET)
    key = (control & 2 > 0) & (field > 1) & (packets[:, 5] & 0x40 > 0)
    cc_errors = crc_errors = 0
    for p in np.unique(pid):
        at = np.flatnonzero((pid == p) & (control & 1 > 0))
        step = np.diff(packets[at, 3].astype(np.int32) & 15) & 15
        same = (packets[at[1:]] == packets[at[:-1]]).all(1) if (step == 0).any() else np.zeros(len(step), bool)
        cc_errors += int(((step != 1) & ~same).sum())

    def tables(p: int, table: int) -> list[bytes]:
        nonlocal crc_errors
        at = pid == p
        body, begins = _gather(packets[at], offset[at])
        found = [s for s in _sections(body, begins[start[at]].tolist()) if s[0] == table and len(s) > 11]
        ok = [s for s in found if crc32_mpeg(s[:-4]) == int.from_bytes(s[-4:], "big")]
        crc_errors += len(found) - len(ok)
        return list(dict.fromkeys(ok))

    programs: dict[int, dict[int, int]] = {}
    for s in tables(0, 0):
        for k in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[k : k + 2], "big"):
                streams = programs.setdefault(number, {})
                for m in tables(int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF, 2):
                    j = 12 + (int.from_bytes(m[10:12], "big") & 0xFFF)
                    while j + 5 <= len(m) - 4:
                        streams[int.from_bytes(m[j + 1 : j + 3], "big") & 0x1FFF] = m[j]
                        j += 5 + (int.from_bytes(m[j + 3 : j + 5], "big") & 0xFFF)
    parts, pts, sizes, points = [], [], [], []
    for p in sorted({x for streams in programs.values() for x in streams}):
        at = np.flatnonzero(pid == p)
        body, begins = _gather(packets[at], offset[at])
        first = np.flatnonzero(start[at])
        for k, b, e in zip(at[first], begins[first], [*begins[first][1:], len(body)][: len(first)], strict=True):
            pes = body[b:e]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                bad += 1
                continue
            size = int.from_bytes(pes[4:6], "big")
            data = pes[9 + pes[8] : 6 + size if size else len(pes)]
            h = pes[9:14]
            stamp = (h[0] >> 1 & 7) << 30 | h[1] << 22 | h[2] >> 1 << 15 | h[3] << 7 | h[4] >> 1 if pes[7] & 0x80 and len(h) == 5 else -1
            if key[k]:
                points.append(len(pts))
            parts.append(data)
            pts.append(stamp)
            sizes.append(len(data))
    named = ";".join(f"{n}:" + "+".join(f"{p:x}/{t:x}" for p, t in sorted(s.items())) for n, s in sorted(programs.items()))
    return {"payload": b"".join(parts), "packets": whole, "bad_sync": bad, "cc_errors": cc_errors, "crc_errors": crc_errors, "programs": named, "pts": pts, "random_access": points, "unit_bytes": sizes}


def to_stream(payload: Column) -> Column:
    """A transport stream (binary) for each payload (binary); null stays null. Row by row, no shuffle."""

    @F.pandas_udf("binary")
    def write(payloads: pd.Series) -> pd.Series:
        return pd.Series([write_stream(x) for x in payloads], dtype=object)

    return write(payload)


def from_stream(stream: Column) -> Column:
    """What ``parse_stream`` finds, as a struct; a null stream gives a struct of nulls."""
    names = [x.split()[0] for x in PARSED.split(", ")]

    @F.pandas_udf(PARSED)
    def parse(streams: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_stream(x) or dict.fromkeys(names) for x in streams], columns=names, dtype=object)

    return parse(stream)
