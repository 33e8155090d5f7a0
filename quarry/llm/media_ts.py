"""Media columns: MPEG transport streams (ISO/IEC 13818-1) in binary columns.

``mux`` stores a payload as a single-programme stream: a PAT and a PMT, then PES packets of a private
stream, each an access unit of up to ``UNIT`` bytes with a PTS and a PCR, cut into 188-byte packets with
continuity counters; every ``GOP``-th unit sets the random-access indicator. ``demux`` reads any transport stream back: it checks sync bytes,
reassembles the sections of the PAT and the PMT, over several packets where they are longer, follows them to the first elementary stream of the first programme,
checks continuity counters (packets without payload don't count, one repetition is legal and dropped, a signalled discontinuity
is no error), drops adaptation fields, reassembles PES packets of any stream, bounded or not, and returns the payload, the timestamps, the clock references and
the random-access points.

Edge cases: null and empty texts become one block of 64 zero bytes; very long texts are one stream, of as many units; equal texts give equal bytes;
``demux`` raises ``ValueError`` naming the fault of a damaged stream, and in a column such a row, like a null one, has its ``error`` and no results; repeated rows give a
row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_batches

# Fixed values of the standard and of this profile.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD
UNIT, GOP, TICKS = 16384, 8, 3003
PES_HEADER, PCR_FIELD = 14, 8
#: Stream ids whose packets have no optional header.
BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
PADDING = 0xBE
CRC_POLY = 0x04C11DB7


class Stream(NamedTuple):
    payload: bytes
    pts: list[int | None]
    access_points: list[int]
    packets: int
    program: int
    es_pid: int
    pcr: list[int]


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        r = byte << 24
        for _ in range(8):
            r = (r << 1 ^ CRC_POLY if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        out.append(r)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = (r << 8 & 0xFFFFFFFF) ^ _CRC[r >> 24 ^ b]
    return r


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _pts_of(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _pcr_bytes(base: int) -> bytes:
    """A clock reference of 90 kHz ticks, without the 27 MHz extension."""
    return bytes([base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0])


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + PES_HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(k * TICKS) + unit
        # Every unit's first packet has an adaptation field with its flags and the clock reference; the last one is stuffed.
        first = pes[: 184 - PCR_FIELD]
        rest = pes[184 - PCR_FIELD :]
        n = 1 + -(-len(rest) // 184)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = ES_PID >> 8
        packets[:, 2] = ES_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4] = 183 - len(first)
        packets[0, 5] = 0x50 if k % GOP == 0 else 0x10
        packets[0, 6:12] = np.frombuffer(_pcr_bytes(k * TICKS), np.uint8)
        packets[0, PACKET - len(first) :] = np.frombuffer(first, np.uint8)
        whole = len(rest) // 184
        body = np.frombuffer(rest, np.uint8)
        packets[1 : 1 + whole, 4:] = body[: whole * 184].reshape(whole, 184)
        if left := len(rest) - whole * 184:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - left
            if left < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - left :] = body[whole * 184 :]
        out.append(packets.tobytes())
    return b"".join(out)


def _table(packets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> tuple[int, bytes]:
    """``(number, body)`` of the first whole, valid and current section of a table."""
    held, seen = b"", False
    for packet in packets[pid == wanted]:
        seen = True
        raw = packet.tobytes()
        control = raw[3] >> 4 & 3
        if not control & 1:
            continue
        body = raw[4 + (1 + raw[4] if control & 2 else 0) :]
        parts = [(held, body)]
        if raw[1] & 0x40:  # the pointer says where a section begins; what is before it ends the last one
            skip = 1 + body[0] if body else 1
            parts = [(held, body[1:skip]), (b"", body[skip:])]
        for before, more in parts:
            held = before + more if before or raw[1] & 0x40 else b""
            while len(held) >= 3 and held[0] != 0xFF:
                end = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)
                if len(held) < end:
                    break
                section, held = held[:end], held[end:]
                if section[0] == table_id and end > 12 and section[5] & 1 and not crc_mpeg(section):
                    return int.from_bytes(section[3:5], "big"), section[8:-4]
    raise ValueError(f"damaged table {table_id}" if seen else f"no table {table_id}")


def demux(data: bytes) -> Stream:
    """Reads a transport stream back; raises ``ValueError`` on any fault."""
    if not data or len(data) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any() or (p[:, 1] & 0x80).any():
        raise ValueError("lost sync or transport error")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    _, pat = _table(p, pid, PAT_PID, 0x00)
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(pat) - 3, 4)]
    program, pmt_pid = next(((n, x) for n, x in programs if n), (0, 0))
    if not program:
        raise ValueError("no program")
    _, pmt = _table(p, pid, pmt_pid, 0x02)
    skip = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
    if len(pmt) < skip + 5:
        raise ValueError("no elementary stream")
    pcr_pid, es_pid = int.from_bytes(pmt[:2], "big") & 0x1FFF, int.from_bytes(pmt[skip + 1 : skip + 3], "big") & 0x1FFF
    e = p[pid == es_pid]
    if not len(e):
        raise ValueError("no elementary packets")
    control = e[:, 3] >> 4 & 3
    adapted = control & 2 > 0
    if (control == 0).any() or (adapted & (e[:, 4] > np.where(control == 3, 183, 184))).any():
        raise ValueError("damaged adaptation field or elementary packet without payload and field")
    flags = np.where(adapted & (e[:, 4] > 0), e[:, 5], 0)
    loaded = np.flatnonzero(control & 1)
    if not len(loaded):
        raise ValueError("packet without payload")
    breaks = np.cumsum(flags & 0x80 > 0)
    step = np.diff((e[loaded, 3] & 15).astype(np.int16)) % 16
    told = np.diff(breaks[loaded]) > 0
    again = (step == 0) & ~told
    # One repetition of a packet is legal if all but its clock reference is the same.
    if again.any():
        clock = (flags & 0x10 > 0)[:, None] & (np.arange(PACKET) >= 6) & (np.arange(PACKET) < 12)
        same = ((e[loaded[1:]] == e[loaded[:-1]]) | clock[loaded[1:]]).all(axis=1)
        again &= same & ~np.concatenate([[False], again[:-1] & same[:-1]])
    if ((step != 1) & ~told & ~again).any():
        raise ValueError("continuity counter error")
    loaded = loaded[np.concatenate([[True], ~again])]
    flags = flags[loaded]
    e, control = e[loaded], control[loaded]
    begin = np.where(control == 3, 5 + e[:, 4].astype(np.int32), 4)
    starts = np.flatnonzero(e[:, 1] & 0x40)
    if not len(starts) or starts[0]:
        raise ValueError("stream begins inside a packet")
    elementary = e[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    offsets = np.concatenate([[0], np.cumsum(PACKET - begin)])
    units, pts, access = [], [], []
    for s, a, z in zip(starts.tolist(), offsets[starts].tolist(), [*offsets[starts[1:]].tolist(), len(elementary)]):
        head = elementary[a : min(a + PES_HEADER, z)]
        length = int.from_bytes(head[4:6], "big")
        if len(head) < 6 or head[:3] != b"\x00\x00\x01" or length and length + 6 > z - a:
            raise ValueError("damaged elementary packet")
        end = a + 6 + length if length else z
        if head[3] == PADDING:
            continue
        skip = 6
        stamp = None
        if head[3] not in BARE:
            skip = 9 + head[8] if len(head) > 8 else 9
            if len(head) < 9 or head[6] & 0xC0 != 0x80 or a + skip > end or head[7] & 0x80 and (head[8] < 5 or len(head) < PES_HEADER):
                raise ValueError("damaged elementary packet")
            stamp = _pts_of(head[9:14]) if head[7] & 0x80 else None
        if flags[s] & 0x40:
            access.append(len(pts))
        pts.append(stamp)
        units.append(elementary[a + skip : end])
    return Stream(b"".join(units), pts, access, len(p), program, es_pid, _clock(p[pid == pcr_pid]))


def _clock(packets: np.ndarray) -> list[int]:
    """The clock references of a stream's packets, in 90 kHz ticks."""
    held = packets[(packets[:, 3] & 0x20 > 0) & (packets[:, 4] >= 7) & (packets[:, 5] & 0x10 > 0)].astype(np.int64)
    return (held[:, 6] << 25 | held[:, 7] << 17 | held[:, 8] << 9 | held[:, 9] << 1 | held[:, 10] >> 7).tolist()


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's payload as a transport stream in a binary column."""

    def run(batch):
        texts = batch.column(1).to_pylist()
        n = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts]
        return {"doc_id": batch.column(0), "n_bytes": pa.array(n, pa.int64()), "media": pa.array([mux(payload_of(t)) for t in texts], pa.binary())}

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(in_batches(run, 64), "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Parses a ``media`` column: digests, packet counts, ``pts`` of all access units, the clock references, the numbers of
    the units that are random-access points, and the ``error`` of a stream that can't be read, whose results are null."""
    kinds = {
        "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
        "packets": pa.int64(), "pts": pa.list_(pa.int64()), "pcr": pa.list_(pa.int64()), "access_points": pa.list_(pa.int64()), "error": pa.string(),
    }

    def run(batch):
        rows = []
        for i, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
            try:
                s = demux(data or b"")
                rows.append((i, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), *stored, s.packets, s.pts, s.pcr, s.access_points, None, s.payload))
            except ValueError as fault:
                rows.append((i, n, None, None, None, *stored, None, None, None, None, "no stream" if data is None else str(fault), None))
        out = {k: pa.array([r[j] for r in rows], t) for j, (k, t) in enumerate(kinds.items())}
        return out | ({"payload": pa.array([r[-1] for r in rows], pa.binary())} if keep_payload else {})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, pts array<long>, pcr array<long>, access_points array<long>, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(in_batches(run, 64), schema + ", payload binary" * keep_payload)
