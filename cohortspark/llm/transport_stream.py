"""MPEG transport streams as a media column.

The writer stores bytes losslessly as packetized elementary packets of one private-data stream
(access units of ``UNIT_BYTES``, one each 1/25 s on the 90 kHz clock). Every
``UNITS_PER_ACCESS_POINT``-th unit is a random-access point: a program association table and a
program map table come before it, and it has a program clock reference. The reader trusts nothing
of that: it follows the program tables to the elementary streams, checks table checksums and
continuity counters (a packet may be sent twice; the second one is passed over), reassembles
elementary packets and returns their bytes with time stamps and random-access points.

Defined results: a null text is empty (its payload is the 64 bytes of padding); equal texts give
equal media; repeated rows give repeated rows; an empty table gives no rows. Null or malformed
media read as null fields with ``error`` set; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PACKET = 188
UNIT_BYTES = 16_000
UNITS_PER_ACCESS_POINT = 8
TICKS_PER_UNIT = 3_600
PMT_PID, STREAM_PID, PRIVATE_DATA = 0x1000, 0x0100, 0x06
PAD = 64


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for byte in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ byte]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0])
    data = head + body
    return data + section_crc(data).to_bytes(4, "big")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


_PROGRAMS = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_STREAMS = _section(
    2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
)


@lru_cache(16)
def _tables(counter: int) -> bytes:
    return _table_packet(0, counter, _PROGRAMS) + _table_packet(PMT_PID, counter, _STREAMS)


def _stamp(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | (t >> 30) << 1, t >> 22 & 255, 1 | (t >> 15 & 127) << 1, t >> 7 & 255, 1 | (t & 127) << 1])


def pad(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD if data else PAD)


def write_stream(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    parts, counter = [], 0
    for unit, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        body = payload[at : at + UNIT_BYTES]
        pes = b"\x00\x00\x01\xbd" + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(unit * TICKS_PER_UNIT) + body
        access = unit % UNITS_PER_ACCESS_POINT == 0
        # The first packet has an adaptation field if the unit is a random-access point: flags and clock.
        if access:
            parts.append(_tables(unit // UNITS_PER_ACCESS_POINT & 15))
            base = (unit * TICKS_PER_UNIT) & 0x1FFFFFFFF
            field = bytes([0x50]) + (base << 15 | 0x7E00).to_bytes(6, "big")
        else:
            field = b""
        room = PACKET - 4 - (1 + len(field) if field else 0)
        first, rest = pes[:room], pes[room:]
        if len(first) < room:
            field = (field or b"\x00") + b"\xff" * (room - len(first) - (0 if access else 2)) if access or room - len(first) > 1 else b""
            head = bytes([0x47, 0x40 | STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter, len(field)])
        elif field:
            head = bytes([0x47, 0x40 | STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter, len(field)])
        else:
            head = bytes([0x47, 0x40 | STREAM_PID >> 8, STREAM_PID & 255, 0x10 | counter])
        parts.append(head + field + first)
        counter = (counter + 1) & 15
        whole = len(rest) // (PACKET - 4)
        if whole:
            rows = np.empty((whole, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
            rows[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            rows[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, PACKET - 4)
            parts.append(rows.tobytes())
            counter = (counter + whole) & 15
        tail = rest[whole * (PACKET - 4) :]
        if tail:
            stuffing = PACKET - 5 - len(tail)
            field = b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b""
            parts.append(bytes([0x47, STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter, stuffing]) + field + tail)
            counter = (counter + 1) & 15
    return b"".join(parts)


def _sections(packets: np.ndarray, starts: np.ndarray, data_at: np.ndarray) -> Iterator[bytes]:
    """The checked sections of one PID, each within its packet or over several; a repeated one once."""
    held, seen = b"", set()
    for row, start, at in zip(packets, starts, data_at, strict=True):
        data = row[at:].tobytes()
        if start:
            data = data[1 + data[0] :]
            held = b""
        held += data
        while len(held) >= 3 and held[0] != 0xFF:
            length = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < length:
                break
            section, held = held[:length], held[length:]
            if section not in seen:
                if section_crc(section) != 0:
                    raise ValueError("a table's checksum is wrong")
                seen.add(section)
                yield section


def read_stream(media: bytes) -> dict:
    """``payload``, ``programs``, ``streams``, ``packets``, ``units``, ``pts`` (list), ``random_access``
    (indices of units that are random-access points), ``discontinuities`` (count of lost counters)."""
    if len(media) % PACKET or not media:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    starts = packets[:, 1] & 0x40 != 0
    control = packets[:, 3] >> 4 & 3
    has_data, has_field = control & 1 != 0, control & 2 != 0
    data_at = 4 + np.where(has_field, 1 + packets[:, 4].astype(np.int32), 0)
    counters = packets[:, 3] & 15

    def tables(pid: int) -> Iterator[bytes]:
        own = (pids == pid) & has_data
        return _sections(packets[own], starts[own], data_at[own])

    programs: dict[int, int] = {}
    for s in tables(0):
        if s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                if number := s[i] << 8 | s[i + 1]:
                    programs[number] = (s[i + 2] & 0x1F) << 8 | s[i + 3]
    streams: dict[int, int] = {}
    for pid in programs.values():
        for s in tables(pid):
            if s[0] == 2:
                i = 12 + ((s[10] & 15) << 8 | s[11])
                while i < len(s) - 4:
                    streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                    i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    lost, payload, stamps, access = 0, [], [], []
    for pid in sorted(streams):
        own = np.flatnonzero((pids == pid) & has_data)
        if not len(own):
            continue
        steps = np.diff(counters[own].astype(np.int16)) & 15
        again = np.flatnonzero(steps == 0) + 1
        again = again[(packets[own[again]] == packets[own[again - 1]]).all(axis=1)]
        if len(again):
            own = np.delete(own, again)
            steps = np.diff(counters[own].astype(np.int16)) & 15
        lost += int((steps != 1).sum())
        firsts = np.flatnonzero(starts[own])
        for a, b in zip(firsts, [*firsts[1:], len(own)], strict=True):
            rows, ats = own[a:b], data_at[own[a:b]]
            # Runs of plain packets are copied at once.
            pieces, plain = [packets[rows[0], ats[0] :].tobytes()], 1
            while plain < len(rows) and ats[plain] == 4:
                plain += 1
            pieces.append(packets[rows[1:plain], 4:].tobytes())
            pieces += [packets[r, at:].tobytes() for r, at in zip(rows[plain:], ats[plain:], strict=True)]
            pes = b"".join(pieces)
            if pes[:3] != b"\x00\x00\x01":
                raise ValueError("an elementary packet lacks its start code")
            length = pes[4] << 8 | pes[5]
            pes = pes[: 6 + length] if length else pes
            if length and len(pes) < 6 + length:
                raise ValueError("an elementary packet is cut short")
            if pes[7] & 0x80:
                p = pes[9:14]
                stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
            if has_field[rows[0]] and packets[rows[0], 4] and packets[rows[0], 5] & 0x40:
                access.append(len(payload))
            payload.append(pes[9 + pes[8] :])
    return {
        "payload": b"".join(payload),
        "programs": len(programs),
        "streams": len(streams),
        "packets": len(packets),
        "units": len(payload),
        "pts": stamps,
        "random_access": access,
        "discontinuities": lost,
    }


def store_streams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, media``: every whole text, padded, as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, sizes, ids, at = [], [], [], 0
            # Large media leave in batches of their own, so memory follows one text, not many.
            for row, value in enumerate(batch.column(1)):
                data = (value.as_py() or "").encode()
                sizes.append(len(data))
                held.append(write_stream(pad(data)))
                at += len(held[-1])
                if at >= 8 << 20 or row + 1 == batch.num_rows:
                    ids = batch.column(0).slice(row + 1 - len(held), len(held))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=[key, "n_bytes", "media"])
                    held, sizes, at = [], [], 0

    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(key, text).mapInArrow(run, schema)


_FEATURES = [
    ("payload_bytes", pa.int64(), T.LongType()),
    ("payload_sha256", pa.string(), T.StringType()),
    ("tail_crc32", pa.int64(), T.LongType()),
    ("media_bytes", pa.int64(), T.LongType()),
    ("media_sha256", pa.string(), T.StringType()),
    ("programs", pa.int32(), T.IntegerType()),
    ("packets", pa.int64(), T.LongType()),
    ("units", pa.int64(), T.LongType()),
    ("pts", pa.list_(pa.int64()), T.ArrayType(T.LongType())),
    ("random_access", pa.list_(pa.int64()), T.ArrayType(T.LongType())),
    ("discontinuities", pa.int64(), T.LongType()),
    ("error", pa.string(), T.StringType()),
]


def stream_features(media: bytes | None) -> dict:
    if media is None:
        return {"error": "no media"}
    try:
        found = read_stream(media)
    except (ValueError, IndexError) as e:
        return {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "error": str(e)}
    payload = found.pop("payload")
    return found | {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-PAD:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
    }


def read_streams(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media: str = "media") -> DataFrame:
    """``keep`` and the features of every stored stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stream_features(x.as_py()) for x in batch.column(len(keep))]
            columns = [pa.array([r.get(name) for r in rows], kind) for name, kind, _ in _FEATURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *(f[0] for f in _FEATURES)])

    schema = T.StructType([*(stored.schema[k] for k in keep), *(T.StructField(n, t) for n, _, t in _FEATURES)])
    return stored.select(*keep, media).mapInArrow(run, schema)
