"""MPEG transport streams in a media column: program tables, continuity, elementary packets, timestamps, random access.

The header fields of all packets of a stream are read at once as columns of a matrix of 188-byte rows. Sections are put together
and their CRC is checked; the program map that is valid at a packet's place gives its elementary stream, whatever version came before or later.
A gap in a stream's continuity counter ends the packet under way, which is marked as broken; a duplicate packet is skipped. Timestamps are
unwrapped beyond their 33 bits, so that a program's time goes on. The muxer makes the streams that the tests and the query read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import core

PACKET, SYNC, CLOCK = 188, 0x47, 90_000
SCHEMA = "program int, pid int, stream_type int, unit int, position int, pts long, dts long, pcr long, random_access boolean, broken boolean, n_bytes int, payload binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int32()] * 5 + [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()]
PMT_PID, FIRST_PID, STREAM_TYPE = 0x1000, 0x100, 0x06

_CRC = np.zeros(256, np.uint64)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c


def crc32(data: bytes) -> int:
    """The CRC of program tables; 0 over a section with its own CRC."""
    table, crc = _CRC.tolist(), 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ table[crc >> 24 ^ b]
    return crc


# --- writing -------------------------------------------------------------------------------------------------------------


def section(table: int, number: int, body: bytes, version: int = 0) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, len(body) + 9 & 0xFF]) + number.to_bytes(2, "big") + bytes([0xC1 | version << 1, 0, 0])
    return head + body + crc32(head + body).to_bytes(4, "big")


def packets(pid: int, unit: bytes, counter: int, random_access: bool = False) -> list[bytes]:
    """A unit in packets from the given counter on; the last, and the first if it is an access point, have an adaptation field."""
    out, at, first = [], 0, True
    while at < len(unit) or first:
        room, flags = PACKET - 4, 0x40 if first and random_access else 0
        need = 2 if flags else 0
        part = unit[at : at + room - need]
        stuffing = room - len(part)
        head = bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 0xFF])
        if stuffing:
            field = bytes([stuffing - 1]) + (bytes([flags]) + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
            out.append(head + bytes([0x30 if part else 0x20 | 0x10]) + field + part)
        else:
            out.append(head + bytes([0x10]) + part)
        out[-1] = out[-1][:3] + bytes([out[-1][3] | (counter + len(out) - 1) & 0xF]) + out[-1][4:]
        at, first = at + len(part), False
    return out


def stamp(mark: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


def elementary(payload: bytes, pts: int | None, dts: int | None = None) -> bytes:
    """A private-stream elementary packet; its length field is 0, as for video, where it can't hold the length."""
    stamps = b"" if pts is None else stamp(2, pts) if dts is None else stamp(3, pts) + stamp(1, dts)
    flags = 0 if pts is None else 0x80 if dts is None else 0xC0
    size = 3 + len(stamps) + len(payload)
    return b"\x00\x00\x01\xbd" + (size if size < 65536 else 0).to_bytes(2, "big") + bytes([0x80, flags, len(stamps)]) + stamps + payload


def mux(units: list[tuple[int, int | None, int | None, bool, bytes]], program: int = 1, version: int = 0, kind: int = STREAM_TYPE) -> bytes:
    """A stream of one program from (track, pts, dts, random access, payload) in order, the tables first."""
    tracks = sorted({u[0] for u in units})
    pat = section(0, 1, program.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    each = b"".join(bytes([kind]) + (0xE000 | FIRST_PID + t).to_bytes(2, "big") + b"\xf0\x00" for t in tracks)
    pmt = section(2, program, (0xE000 | FIRST_PID + tracks[0] if tracks else 0xFFFF).to_bytes(2, "big") + b"\xf0\x00" + each, version)
    out = packets(0, b"\x00" + pat, 0) + packets(PMT_PID, b"\x00" + pmt, 0)
    counter: dict[int, int] = {}
    for track, pts, dts, key, payload in units:
        made = packets(FIRST_PID + track, elementary(payload, pts, dts), counter.get(track, 0), key)
        counter[track] = counter.get(track, 0) + len(made)
        out += made
    return b"".join(out)


# --- reading -------------------------------------------------------------------------------------------------------------


def aligned(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The packets as rows, and the byte that each begins at. Bytes without sync are skipped up to where two packets in a row begin."""
    raw, at, parts, places = np.frombuffer(data, np.uint8), 0, [], []
    while at + PACKET <= len(raw):
        n = (len(raw) - at) // PACKET
        rows = raw[at : at + n * PACKET].reshape(n, PACKET)
        good = int(np.argmin(np.append(rows[:, 0] == SYNC, False)))
        if good:
            parts.append(rows[:good])
            places.append(at + PACKET * np.arange(good))
            at += good * PACKET
            if good == n:
                break
        sync = np.flatnonzero(raw[at + 1 :] == SYNC) + at + 1
        last = sync + PACKET >= len(raw)
        sync = sync[np.where(last, sync + PACKET == len(raw), raw[np.minimum(sync + PACKET, len(raw) - 1)] == SYNC)]
        if not len(sync):
            break
        at = int(sync[0])
    if not parts:
        return np.zeros((0, PACKET), np.uint8), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(places)


def sections(rows: np.ndarray, start: np.ndarray, begin: np.ndarray, place: np.ndarray) -> list[tuple[int, bytes]]:
    """(byte of the packet that ends it, section) of the whole sections of one PID that are in force and whose CRC is right."""
    out, buffer = [], None
    for row, first, at, where in zip(rows, start.tolist(), begin.tolist(), place.tolist()):
        part = row[at:].tobytes()
        if first and part:
            point = 1 + part[0]
            if buffer is not None:
                buffer += part[1:point]
            parts = [buffer, part[point:]]
        else:
            parts = [None if buffer is None else buffer + part]
        for i, buffer in enumerate(parts):
            while buffer and len(buffer) >= 3 and buffer[0] != 0xFF:
                size = 3 + ((buffer[1] & 0xF) << 8 | buffer[2])
                if len(buffer) < size:
                    break
                # The lowest bit of this byte is 0 in a table that is announced for later.
                if size > 9 and buffer[5] & 1 and crc32(buffer[:size]) == 0:
                    out.append((where, buffer[:size]))
                buffer = buffer[size:]
    return out


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def unwrapped(t: int, near: int | None) -> int:
    """t, or of the times that differ from it by a multiple of 2 ** 33 the one nearest to near."""
    return t if near is None else t + ((near - t + (1 << 32)) >> 33 << 33)


def demux(data: bytes) -> list[tuple]:
    """The elementary packets in order of their first byte, as rows of NAMES.

    unit counts the packets of a PID from 0. pts, dts and pcr (in units of the 90 kHz clock, of the unit's first packet, null where it has none) are unwrapped: each is
    taken nearest to the program's time before it, so that they go on when the 33 bits overflow. A packet belongs to the program and type of the last
    program map before it, of the first map if none is before. broken: packets of the transport stream were lost, scrambled or marked as wrong inside it, its length isn't the
    one it states, or it has no header. Data of a PID before its first unit start are dropped; a stream without tables has none.
    """
    rows, place = aligned(data)
    if not len(rows):
        return []
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    start, wrong = rows[:, 1] & 0x40 > 0, (rows[:, 1] & 0x80 > 0) | (rows[:, 3] & 0xC0 > 0)
    field, loaded, counter = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0, rows[:, 3] & 0xF
    length = np.where(field, rows[:, 4], 0).astype(np.int32)
    flags = np.where(field & (length > 0), rows[:, 5], 0)
    begin = np.minimum(4 + field * (length + 1), PACKET)
    begin = np.where(loaded, begin, PACKET)

    def tables(of: int):
        mine = np.flatnonzero((pid == of) & ~wrong)
        return sections(rows[mine], start[mine], begin[mine], place[mine])

    maps = {}
    for _, s in tables(0):
        if s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                number, to = int.from_bytes(s[i : i + 2], "big"), int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
                if number:
                    maps[to] = True
    #: PID -> (byte from which on, program, type), ascending
    streams: dict[int, list[tuple[int, int, int]]] = {}
    for to in maps:
        for where, s in tables(to):
            if s[0] == 2:
                i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
                while i + 5 <= len(s) - 4:
                    streams.setdefault(int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF, []).append((where, int.from_bytes(s[3:5], "big"), s[i]))
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)

    out = []
    for stream, history in streams.items():
        history.sort()
        mine = np.flatnonzero((pid == stream) & loaded)
        if not len(mine):
            continue
        count = counter[mine].astype(np.int32)
        step = np.append(1, np.diff(count)) & 0xF
        same = (step == 0) & np.append(False, (rows[mine[1:], 4:] == rows[mine[:-1], 4:]).all(1))
        jump = (flags[mine] & 0x80) > 0
        lost = (step != 1) & ~same & ~jump
        mine, lost = mine[~same], lost[~same] | wrong[mine[~same]]
        heads = np.flatnonzero(start[mine])
        for unit, (i, j) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(mine)])):
            # A gap before the first packet of a unit broke the one before it, if any.
            part, broken = mine[i:j], bool(lost[i + 1 : j].any() or wrong[mine[i]] or (j < len(mine) and lost[j]))
            body = b"".join(rows[r, begin[r] :].tobytes() for r in part.tolist())
            pts = dts = pcr = None
            if flags[part[0]] & 0x10 and length[part[0]] >= 7:
                high = rows[part[0], 6:11].tobytes()
                pcr = int.from_bytes(high, "big") >> 7
            if len(body) < 9 or body[:3] != b"\x00\x00\x01":
                payload, broken = body, True
            else:
                stated, marks, extra = int.from_bytes(body[4:6], "big"), body[7] >> 6, body[8]
                stamps, payload = body[9 : 9 + extra], body[9 + extra :]
                broken |= bool(stated) and len(body) - 6 != stated
                if marks & 2 and len(stamps) >= 5:
                    pts = _time(stamps)
                    dts = _time(stamps[5:]) if marks == 3 and len(stamps) >= 10 else pts
            at = int(place[part[0]])
            _, program, kind = next((x for x in reversed(history) if x[0] <= at), history[0])
            out.append([program, stream, kind, unit, at, pts, dts, pcr, bool(flags[part[0]] & 0x40), broken, len(payload), payload])
    out.sort(key=lambda x: (x[4], x[1]))
    time: dict[int, int] = {}
    for x in out:
        if x[7] is not None:
            x[7] = unwrapped(x[7], time.get(x[0]))
        if x[6] is not None:
            x[6] = unwrapped(x[6], x[7] if x[7] is not None else time.get(x[0]))
            x[5] = unwrapped(x[5], x[6])
        now = x[6] if x[6] is not None else x[7]
        if now is not None:
            time[x[0]] = now
    return [tuple(x) for x in out]


def packets_of(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id_col and the columns of SCHEMA for every elementary packet of the streams in media_col.

    Null and empty streams, and bytes without sync or tables, have none, nor has an empty table; repeated rows are each read. A stream is one value of the column and
    is read whole; of packets that begin at one byte there are none. Other columns are not read; id_col must not be a name of SCHEMA.
    """
    if id_col in NAMES:
        raise ValueError(f"the id column must not have a name of the result: {id_col}")
    core.ship(media.sparkSession)
    data = media.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").cast("binary").alias("media"))

    def load(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = demux(batch["media"][i].as_py() or b"")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch["id"][i], len(found)), *(pa.array(x, t) for x, t in zip(zip(*found), TYPES))], ["id", *NAMES])

    kind = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(core.tidy(load), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def conversation_streams(conversations: DataFrame) -> DataFrame:
    """(conv_id, media): each conversation as a stream with a track for each role, an elementary packet a turn, one second a turn; even turns are access points."""
    core.ship(conversations.sparkSession)
    turns = conversations.select("conv_id", "turn", "role", F.col("text").cast("binary").alias("text")).where("conv_id is not null and turn is not null")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("role", "ascending"), ("text", "ascending")])
        roles = {r: i for i, r in enumerate(sorted({r or "" for r in table["role"].to_pylist()}))}
        units = [(roles[r["role"] or ""], r["turn"] * CLOCK, None, r["turn"] % 2 == 0, r["text"] or b"") for r in table.to_pylist()]
        return pa.table({"conv_id": table["conv_id"].slice(0, 1), "media": pa.array([mux(units)], pa.binary())})

    return turns.groupBy("conv_id").applyInArrow(build, "conv_id long, media binary")


def query(spark, sf_dir: str) -> DataFrame:
    """All conversations as media, read back to their elementary packets."""
    media = conversation_streams(core.read(spark, sf_dir, "conversations"))
    return packets_of(media, "conv_id", "media").select("conv_id", "pid", "stream_type", (F.col("pts") / CLOCK).cast("long").alias("turn"), "pts", "random_access", "broken", F.col("n_bytes").cast("long").alias("n_bytes"), F.md5("payload").alias("payload_md5"))


ORACLE = f"""SELECT conv_id,
  CAST({FIRST_PID} + dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS INTEGER) AS pid,
  {STREAM_TYPE} AS stream_type, turn, turn * {CLOCK} AS pts, turn % 2 = 0 AS random_access, FALSE AS broken,
  CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS payload_md5
FROM conversations"""
