"""MPEG audio as a media column: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

parse() walks the frame headers of any layer and version, finds them again after damage, and verifies the checksums of
protected Layer III frames. wrap() stores bytes losslessly in Layer III frames, 576 in each, behind empty side
information, so that players hear silence and unwrap() gives the bytes back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the format: kbit/s by (version 1 or lower, layer), Hz by version code, samples by (version 1, layer).
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
UNIT = 576

_CRC = np.zeros(256, dtype=np.uint16)
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1) ^ (0x8005 if _c & 0x8000 else 0)
    _CRC[_i] = _c & 0xFFFF


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's checksum of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, dtype=np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


@lru_cache(maxsize=4096)
def header(word: bytes) -> tuple[int, int, int, int, int, bool, int, int] | None:
    """(length, samples, Hz, channels, layer, protected, side information, kbit/s) of a frame header; None if it is none."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, bits, mode = word[2] >> 2 & 3, word[2] >> 4, word[3] >> 6
    if version == 1 or layer == 4 or rate == 3 or bits in (0, 15) or word[3] & 3 == 2:
        return None
    one, hz = version == 3, RATES[version][rate]
    kbit, pad = KBITS[one, layer][bits], word[2] >> 1 & 1
    samples = SAMPLES[one, layer]
    length = (12 * kbit * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + pad
    channels = 1 if mode == 3 else 2
    side = ((17, 32) if one else (9, 17))[channels - 1] if layer == 3 else 0
    return length, samples, hz, channels, layer, not word[1] & 1, side, kbit


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)  # of a variable-bitrate header: kind, frames, bytes, toc
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # of the frames that hold sound
    samples: int = 0
    hz: int = 0
    channels: int = 0
    kbits: tuple[int, ...] = ()
    protected: int = 0
    damaged: int = 0  # protected frames whose checksum differs
    resyncs: int = 0
    skipped: int = 0  # bytes that belong to no frame and no tag

    @property
    def micros(self) -> int:
        """Length in microseconds, rounded down; samples / hz is exact."""
        return self.samples * 1_000_000 // self.hz if self.hz else 0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2.3 or 2.4 tag, and where it ends; 0 if there is none."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return {}, 0
    end, tags, at = 10 + _syncsafe(data[6:10]), {}, 10
    if data[5] & 0x40 and at + 4 <= len(data):  # an extended header
        at += _syncsafe(data[at : at + 4]) if data[3] == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    while at + 10 <= min(end, len(data)) and data[at : at + 1] != b"\0":
        name, size = data[at : at + 4].decode("latin-1"), _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            if name == "TXXX" and "\0" in text:
                name, text = text.split("\0", 1)
            tags[name] = text
        at += 10 + size
    return tags, end + (10 if data[5] & 0x10 else 0)


def _vbr(data: bytes, at: int, info: tuple) -> dict[str, object]:
    """The variable-bitrate table in a first frame, if it has one."""
    for kind in (b"Xing", b"Info"):
        p = at + 4 + 2 * info[5] + info[6]
        if data[p : p + 4] in (kind,) or (info[5] and data[p - 2 : p + 2] == kind and (p := p - 2)):
            flags, q, out = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(data[q : q + 4], "big")
                    q += 4
            if flags & 4:
                out["toc"] = list(data[q : q + 100])
            return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and len(data) >= p + 26:
        size, frames, n, scale, width, _ = struct.unpack(">IIHHHH", data[p + 10 : p + 26])
        toc = [int.from_bytes(data[p + 26 + i * width : p + 26 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return {}


def parse(data: bytes | None) -> Audio:
    """What MPEG audio bytes hold. Null, empty and other bytes give no frames, with all bytes skipped."""
    data, a = data or b"", Audio()
    a.tags, at = _id3v2(data)
    end = len(data)
    tag = end - 128 if end - at >= 128 and data[-128:-125] == b"TAG" else -1  # an ID3v1 tag, unless a frame holds this place
    found, infos, synced = [], [], False
    while at < end:
        if at == tag:
            for name, p, q in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
                if text := data[tag + p : tag + q].split(b"\0")[0].decode("latin-1").strip():
                    a.tags[name] = text
            break
        info = header(data[at : at + 4])
        ok = info is not None and at + info[0] <= end
        if ok and (not synced or at < tag < at + info[0]):  # such a header counts only if another, or the end, is where it says
            after = at + info[0]
            ok = after in (end, tag) or (header(data[after : after + 4]) or (0, 0, -1))[2] == info[2]
        if ok:
            found.append(at)
            infos.append(info)
            at, synced = at + info[0], True
            continue
        a.resyncs += bool(found) and synced
        synced, here = False, at
        stop = tag if at < tag else end
        at = data.find(b"\xff", at + 1, stop)
        at = stop if at < 0 else at
        a.skipped += at - here
    if not found:
        return a
    a.table = _vbr(data, found[0], infos[0])
    if a.table:
        found, infos = found[1:], infos[1:]
    a.offsets = np.array(found, dtype=np.int64)
    a.samples = sum(i[1] for i in infos)
    if infos:
        a.hz, a.channels, a.kbits = infos[0][2], infos[0][3], tuple(sorted({i[7] for i in infos}))
    view = np.frombuffer(data, dtype=np.uint8)
    for side in {i[6] for i in infos if i[5] and i[4] == 3}:
        at_ = np.array([o for o, i in zip(found, infos) if i[5] and i[4] == 3 and i[6] == side], dtype=np.int64)
        for k in range(0, len(at_), 65536):
            p = at_[k : k + 65536, None]
            rows = view[p + np.concatenate(([2, 3], np.arange(6, 6 + side)))]
            given = view[p + [4, 5]].astype(np.uint16)
            a.damaged += int((crc16(rows) != (given[:, 0] << np.uint16(8) | given[:, 1])).sum())
        a.protected += len(at_)
    return a


# 44.1 kHz, one channel, 192 kbit/s, Layer III of version 1, protected: 626 bytes, of which 603 are free
_HEAD = bytes((0xFF, 0xFA, 0xB0, 0xC0))
_LENGTH, _SIDE, _FREE = header(_HEAD)[0], 17, 23
_EMPTY = _HEAD + int(crc16(np.frombuffer(_HEAD[2:] + bytes(_SIDE), dtype=np.uint8)[None])[0]).to_bytes(2, "big") + bytes(_SIDE)


def pad(data: bytes) -> bytes:
    """The payload: bytes 255 are added up to a positive multiple of 576."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def wrap(data: bytes) -> bytes:
    """An MPEG file whose frames hold the padded bytes; its tag names their number before padding."""
    payload = np.frombuffer(pad(data), dtype=np.uint8).reshape(-1, UNIT)
    n = len(payload)
    frames = np.zeros((n, _LENGTH), dtype=np.uint8)
    frames[:, :_FREE] = np.frombuffer(_EMPTY, dtype=np.uint8)
    frames[:, _FREE : _FREE + UNIT] = payload
    text = b"\x03payload_bytes\0" + str(len(data)).encode()
    body = b"TXXX" + _safe(len(text)) + b"\0\0" + text
    total = (n + 1) * _LENGTH
    toc = bytes(min(255, (i * n // 100 + 1) * _LENGTH * 256 // total) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, total) + toc
    first = _EMPTY + info + bytes(_LENGTH - _FREE - len(info))
    return b"ID3\x04\0\0" + _safe(len(body)) + body + first + frames.tobytes()


def _safe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def unwrap(data: bytes, audio: Audio | None = None) -> bytes:
    """The padded bytes that wrap() has stored."""
    audio = audio or parse(data)
    view = np.frombuffer(data, dtype=np.uint8)
    return b"".join(view[audio.offsets[k : k + 8192, None] + np.arange(_FREE, _FREE + UNIT)].tobytes() for k in range(0, len(audio.offsets), 8192))


def feature(a: Audio) -> str:
    """One line of what a file holds: exact length, bitrates, table, checksums and a checksum of its seek offsets."""
    table = f"{a.table.get('kind', 'none')}:{a.table.get('frames', '')}:{a.table.get('bytes', '')}:{zlib.crc32(bytes(x & 255 for x in a.table.get('toc', [])))}"
    return f"frames={len(a.offsets)};samples={a.samples};hz={a.hz};channels={a.channels};kbits={','.join(map(str, a.kbits))};micros={a.micros};table={table};protected={a.protected};damaged={a.damaged};resyncs={a.resyncs};skipped={a.skipped};offsets={zlib.crc32(a.offsets.astype('<i8').tobytes())}"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes as an MPEG file; a null text is empty. Other columns are not read."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                media = [wrap((t or "").encode("utf-8")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def describe_media(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows of ``media`` with a struct ``audio`` of what parse() finds in the column: null for null bytes."""
    kind = "struct<frames:long,samples:long,hz:int,channels:int,micros:long,kbits:array<int>,tags:map<string,string>,table_kind:string,table_frames:long,table_bytes:long,protected:long,damaged:long,resyncs:long,skipped:long,offsets:array<long>>"

    @F.pandas_udf(kind)
    def described(s):
        import pandas as pd

        out = []
        for x in s:
            a = parse(x) if x is not None else None
            out.append({k: None for k in ("frames", "samples", "hz", "channels", "micros", "kbits", "tags", "table_kind", "table_frames", "table_bytes", "protected", "damaged", "resyncs", "skipped", "offsets")} if a is None else {"frames": len(a.offsets), "samples": a.samples, "hz": a.hz, "channels": a.channels, "micros": a.micros, "kbits": list(a.kbits), "tags": a.tags, "table_kind": a.table.get("kind"), "table_frames": a.table.get("frames"), "table_bytes": a.table.get("bytes"), "protected": a.protected, "damaged": a.damaged, "resyncs": a.resyncs, "skipped": a.skipped, "offsets": a.offsets.tolist()})
        return pd.DataFrame(out)

    return media.withColumn("audio", described(F.col(column)))


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each row.

    Each text is stored as by store_texts(); everything returned is read from the stored bytes. Equal texts give equal
    values; a null text counts as empty; repeated rows give a row each; an empty table gives no rows.
    """

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t in part.column("text").to_pylist():
                    media = wrap((t or "").encode("utf-8"))
                    audio = parse(media)
                    payload = unwrap(media, audio)
                    rows.append((int(audio.tags["payload_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio)))
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
