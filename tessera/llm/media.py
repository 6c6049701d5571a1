"""MPEG transport streams as a binary column (operator 8).

``mux`` stores a payload as elementary packets with timestamps in 188-byte
transport packets, behind a program association and a program map table; every
fourth elementary packet is a random-access point with a clock reference.
``demux`` reads such a stream (or another's): it parses the tables and checks
their checksums, checks the continuity counters per packet id, reassembles the
elementary packets of the first stream and lists their timestamps and
random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.words import blocks, column, lean, small_batches

# Fixed values of the format.
PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, PMT_PID, DATA_PID, PRIVATE_DATA, PRIVATE_STREAM = 0, 0x1000, 0x100, 0x06, 0xBD
CRC_POLYNOMIAL, CLOCK = 0x04C11DB7, 90_000

UNIT = 576
#: Units in an elementary packet, samples a second, elementary packets from one random-access point to the next.
UNITS, RATE, RAP_EVERY = 4, 8000, 4
#: Rows and bytes of text whose streams are made at once.
STORE_ROWS, STORE_BYTES = 64, 32 << 20


def crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (CRC_POLYNOMIAL if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


CRC_TABLE = crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, bytes([STUFFING]))


def tables() -> bytes:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _clock(pcr: int) -> bytes:
    return bytes([(pcr >> 25) & 0xFF, (pcr >> 17) & 0xFF, (pcr >> 9) & 0xFF, (pcr >> 1) & 0xFF, (pcr & 1) << 7 | 0x7E, 0])


def mux(payload: bytes, head: bytes | None = None) -> bytes:
    """The payload (a multiple of UNIT) as a transport stream. head: what ``tables()`` gives."""
    out, counter = [head if head is not None else tables()], 0
    step = UNIT * UNITS
    first = (0x4000 | DATA_PID).to_bytes(2, "big")
    rest = DATA_PID.to_bytes(2, "big")
    for k, at in enumerate(range(0, len(payload), step)):
        unit = payload[at : at + step]
        pts = (at * CLOCK // RATE) & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        i = 0
        while i < len(pes):
            extra = b""
            if i == 0 and k % RAP_EVERY == 0:
                extra = b"\x50" + _clock(pts)  # random access and clock reference
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            part = pes[i : i + room]
            lack = room - len(part)
            if lack and not extra:
                extra = b"" if lack == 1 else b"\x00" + bytes([STUFFING]) * (lack - 2)
                field_ = bytes([len(extra)]) + extra
            elif extra:
                extra += bytes([STUFFING]) * lack
                field_ = bytes([len(extra)]) + extra
            else:
                field_ = b""
            out.append(bytes([SYNC]) + (first if i == 0 else rest) + bytes([(0x30 if field_ else 0x10) | counter]) + field_ + part)
            counter = (counter + 1) & 15
            i += len(part)
    return b"".join(out)


@dataclass
class Stream:
    """What demux finds. units: (pts, random access, first packet, bytes) of each elementary packet."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    bad_tables: int = 0
    bad_counters: int = 0
    repeated: int = 0
    lost_sync: int = 0
    clocks: int = 0
    units: list[tuple[int | None, bool, int, int]] = field(default_factory=list)
    payload: bytes = b""


def demux(data: bytes) -> Stream:
    """Parses a stream of whole packets; bytes that don't start with the sync byte are skipped to the next one that does."""
    s, counters, last = Stream(), {}, {}
    parts: list[bytearray] = []
    marks: list[tuple[bool, int]] = []
    at, n = 0, len(data)
    while at + PACKET <= n:
        if data[at] != SYNC:
            s.lost_sync += 1
            at = data.find(bytes([SYNC]), at)
            if at < 0:
                break
            continue
        b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
        pid, start, control, counter = (b1 & 0x1F) << 8 | b2, b1 & 0x40, b3 >> 4 & 3, b3 & 15
        begin, end, random = at + 4, at + PACKET, False
        packet, at = s.packets, at + PACKET
        s.packets += 1
        if pid == 0x1FFF or b1 & 0x80:
            continue
        jump = False
        if control & 2:
            size = data[begin]
            if size:
                flags = data[begin + 1]
                random, jump = bool(flags & 0x40), bool(flags & 0x80)
                s.clocks += flags >> 4 & 1
            begin += size + 1
        if not control & 1:
            continue
        if pid in counters and not jump:
            if counter == counters[pid] and data[begin:end] == last.get(pid):
                s.repeated += 1
                continue
            if counter != (counters[pid] + 1) & 15:
                s.bad_counters += 1
        counters[pid] = counter
        body = data[begin:end]
        last[pid] = body
        if pid == PAT_PID or pid in s.programs.values():
            if start:
                _read_table(s, pid, body[1 + body[0] :])
        elif pid == next(iter(s.streams), None):
            if start:
                parts.append(bytearray(body))
                marks.append((random, packet))
            elif parts:
                parts[-1] += body
    whole = []
    for pes, (random, packet) in zip(parts, marks, strict=True):
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            s.bad_tables += 1
            continue
        length, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        pts = None
        if pes[7] & 0x80:
            p = pes[9:14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1
        unit = bytes(pes[head : 6 + length if length else len(pes)])
        s.units.append((pts, random, packet, len(unit)))
        whole.append(unit)
    s.payload = b"".join(whole)
    return s


def _read_table(s: Stream, pid: int, section: bytes) -> None:
    length = (section[1] & 0x0F) << 8 | section[2]
    section = section[: 3 + length]
    if len(section) < 3 + length or section_crc(section):
        s.bad_tables += 1
        return
    if section[0] == 0 and pid == PAT_PID:
        for i in range(8, len(section) - 4, 4):
            number = int.from_bytes(section[i : i + 2], "big")
            if number:
                s.programs[number] = (section[i + 2] & 0x1F) << 8 | section[i + 3]
    elif section[0] == 2:
        i = 12 + ((section[10] & 0x0F) << 8 | section[11])
        while i + 5 <= len(section) - 4:
            s.streams[(section[i + 1] & 0x1F) << 8 | section[i + 2]] = section[i]
            i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])


def padded(text: bytes) -> bytes:
    """The bytes, filled with 255 up to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


def _store(batches):
    """Streams in batches of at most STORE_ROWS rows and, but for a single longer one, STORE_BYTES of text."""
    head = tables()
    for batch in batches:
        data, offs = column(batch, "text")
        for a, b in blocks(offs, STORE_BYTES, STORE_ROWS):
            media = [mux(padded(data[offs[r] : offs[r + 1]].tobytes()), head) for r in range(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offs[a : b + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stream) of every row of ``docs`` (doc_id, text, any others); a null text is empty."""
    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(_store), f"doc_id {kind}, n_bytes long, media binary")


def _read(batches):
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access")}
        for media in batch.column(2):
            media = media.as_py() or b""
            s = demux(media)
            stamps = [u[0] for u in s.units if u[0] is not None]
            access = [u[2] for u in s.units if u[1]]
            out["payload_bytes"].append(len(s.payload))
            out["payload_sha256"].append(hashlib.sha256(s.payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(s.payload[-32:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(f"packets={s.packets};programs={len(s.programs)};streams={','.join(f'{p:04x}:{t:02x}' for p, t in s.streams.items())};pes={len(s.units)};pts={min(stamps, default='')}-{max(stamps, default='')};random_access={len(access)};clocks={s.clocks};counter_errors={s.bad_counters};table_errors={s.bad_tables};repeated={s.repeated}")
            out["pts"].append(stamps)
            out["random_access"].append(access)
        types = {c: pa.string() for c in ("payload_sha256", "media_sha256", "feature")} | {c: pa.list_(pa.int64()) for c in ("pts", "random_access")}
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, types.get(c, pa.int64())) for c, v in out.items())], names=["doc_id", "n_bytes", *out])


_FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"


def features(media: DataFrame) -> DataFrame:
    """What the stored streams (doc_id, n_bytes, media) hold, read from their bytes; pts and random_access list every elementary packet."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(_read), f"doc_id {dict(media.dtypes)['doc_id']}, {_FEATURES}")


def report(docs: DataFrame) -> DataFrame:
    """``features`` of the ``stored`` texts of every row of ``docs``, without the lists; streams are stored and read back within one task.

    A null text is empty; a null doc_id stays null. One row's stream has to stay
    below 2 GB.
    """

    def work(batches):
        yield from _read(_store(batches))

    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(work), f"doc_id {dict(docs.dtypes)['doc_id']}, {_FEATURES}").drop("pts", "random_access")
