"""MPEG transport streams as a media column.

A payload is cut into access units; each is one PES packet with a presentation time stamp, carried by
188-byte packets of one PID. Every `gop` units the program tables (PAT and PMT, with their CRC) come again and the unit
is marked as a random-access point. The reader trusts nothing but the bytes: it parses the tables, checks the continuity
counters, joins the elementary packets and reads the time stamps.

Defined results: a null text is the empty payload, padded like any other; a null doc_id is kept; repeated rows give
equal media; an empty table gives an empty table; only doc_id and text are read. A damaged stream is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelore.llm.common import tune

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, STREAM_TYPE, STREAM_ID = 188, 0x47, 0, 0x06, 0xBD
#: Choices of this muxer.
PMT_PID, MEDIA_PID, PROGRAM, UNIT, GOP, TICKS = 0x1000, 0x0100, 1, 16384, 8, 3600


def crc32_mpeg(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


def section(table_id: int, key: int, body: bytes) -> bytes:
    """A program-table section: header, body and CRC."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")


def table_packet(pid: int, data: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15])
    return (head + b"\0" + data).ljust(PACKET, b"\xff")


def time_stamp(mark: int, ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([mark << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def mux(payload: bytes, *, unit: int = UNIT, gop: int = GOP) -> bytes:
    """The transport stream that carries payload."""
    out, counter, tables = [], 0, 0
    for k, start in enumerate(range(0, len(payload), unit)):
        access = k % gop == 0
        if access:
            out += [table_packet(PAT_PID, PAT, tables), table_packet(PMT_PID, PMT, tables)]
            tables += 1
        body = payload[start : start + unit]
        pts = k * TICKS
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + time_stamp(2, pts) + body
        clock = pts & (1 << 33) - 1
        field = bytes([7, (0x40 if access else 0) | 0x10]) + (clock << 15 | 0x7E00).to_bytes(6, "big")  # random access, PCR
        first = PACKET - 4 - len(field)
        rest = max(0, len(pes) - first)
        n = 1 + -(-rest // 184)
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        data = np.frombuffer(pes, np.uint8)
        if len(data) < first:  # all in one packet: the adaptation field takes the room that is left
            field = bytes([field[0] + first - len(data)]) + field[1:] + b"\xff" * (first - len(data))
        rows[0, 3] |= 0x20
        rows[0, 4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
        rows[0, 4 + len(field) :] = data[: PACKET - 4 - len(field)]
        data = data[PACKET - 4 - len(field) :]
        whole = len(data) // 184
        rows[1 : 1 + whole, 4:] = data[: whole * 184].reshape(whole, 184)
        if (tail := data[whole * 184 :]).size:
            room = 184 - tail.size
            rows[-1, 3] |= 0x20
            rows[-1, 4] = room - 1
            if room > 1:
                rows[-1, 5] = 0
            rows[-1, PACKET - tail.size :] = tail
        out.append(rows.tobytes())
    return b"".join(out)


class Damaged(ValueError):
    pass


def table_of(rows: np.ndarray, pid: int) -> bytes | None:
    """The section that packets of pid carry; all must carry the same, with a good CRC."""
    found = {bytes(r) for r in rows}
    if len(found) > 1:
        raise Damaged(f"tables of PID {pid} differ")
    for row in found:
        if row[3] & 0x20 or not row[1] & 0x40:
            raise Damaged("a table must begin in a packet of its own")
        at = 5 + row[4]
        data = row[at : at + 3 + (int.from_bytes(row[at + 1 : at + 3], "big") & 0xFFF)]
        if crc32_mpeg(data):
            raise Damaged(f"CRC of PID {pid}")
        return data
    return None


_TABLES: dict[bytes, int] = {}


def media_pid(rows: np.ndarray, pids: np.ndarray) -> int:
    """The elementary PID that the program tables name."""
    at = np.flatnonzero(pids == PAT_PID)
    if not at.size:
        raise Damaged("no PAT")
    pats = rows[at].copy()
    pats[:, 3] &= 0xF0
    pmt_at = int.from_bytes(bytes(pats[0, 15:17]), "big") & 0x1FFF
    pmts = rows[pids == pmt_at].copy()
    pmts[:, 3] &= 0xF0
    key = pats.tobytes() + pmts.tobytes()
    if (pid := _TABLES.get(key)) is None:
        pat = table_of(pats, PAT_PID)
        pmt = table_of(pmts, int.from_bytes(pat[10:12], "big") & 0x1FFF)
        if pmt is None:
            raise Damaged("no PMT")
        at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
        pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
        if len(_TABLES) > 1000:
            _TABLES.clear()
        _TABLES[key] = pid
    return pid


def demux(media: bytes) -> tuple[bytes, list[tuple[int, int, bool]]]:
    """The payload, and (time stamp, packet number, random access) of each access unit."""
    if len(media) % PACKET:
        raise Damaged("not whole packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if not len(rows):
        return b"", []
    if (rows[:, 0] != SYNC).any():
        raise Damaged("sync byte")
    pids = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    pid = media_pid(rows, pids)
    for each in np.unique(pids):
        counters = rows[pids == each, 3] & 15
        if ((counters[1:] - counters[:-1]) & 15 != 1).any():
            raise Damaged(f"continuity of PID {each}")
    at = np.flatnonzero(pids == pid)
    own = rows[at]
    adapted = own[:, 3] & 0x20 > 0
    begin = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    units, out = [], []
    for i, s in enumerate(starts.tolist()):
        a = int(ends[s - 1]) if s else 0
        b = int(ends[starts[i + 1] - 1]) if i + 1 < len(starts) else len(data)
        head = data[a : a + 14]
        if head[:3] != b"\0\0\1" or int.from_bytes(head[4:6], "big") != b - a - 6:
            raise Damaged("PES packet")
        p = head[9:14]
        pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1
        units.append((pts, int(at[s]), bool(flags[s] & 0x40)))
        out.append(data[a + 9 + head[8] : b])
    return b"".join(out), units


def padded(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8")
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a transport stream."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.selectExpr("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, payload, units array<struct<pts,packet,random_access>> from the stored streams."""
    tune(stored.sparkSession)
    unit = pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [demux(m) for m in batch.column("media").to_pylist()]
            units = [[{"pts": p, "packet": k, "random_access": r} for p, k, r in u] for _, u in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d for d, _ in got], pa.binary()), pa.array(units, pa.list_(unit))], ["doc_id", "payload", "units"])

    shape = f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, payload binary, units array<struct<pts:bigint,packet:bigint,random_access:boolean>>"
    return stored.select("doc_id", "media").mapInArrow(run, shape)


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of the stored streams, from the bytes that come back out of them."""
    tune(stored.sparkSession)
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def one(media: bytes) -> tuple:
        payload, units = demux(media)
        points = sum(r for _, _, r in units)
        said = f"packets={len(media) // PACKET};units={len(units)};access={points};last_pts={units[-1][0] if units else 0}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(m) for m in batch.column("media").to_pylist()]
            columns = list(zip(*got, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True))], ["doc_id", "n_bytes", *kinds])

    shape = f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, shape)
