"""MPEG audio columns: frame headers with resynchronisation, tags, variable-bitrate tables, checksums, seek offsets.

`parse` reads any MPEG-1/2/2.5 layer I-III stream with stated bitrates (not the free format). `write_payload` stores bytes
in a valid variable-bitrate MPEG-1 layer III stream: its frames are silent (no coded spectrum) and carry the bytes in the room
that the format leaves after the coded part, so a player plays silence and `parse` gives every byte back. The stream ends
with a tag of its own, so no payload is taken for one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept, small_batches

# Fixed values of the MPEG audio format: kbit/s by bitrate index 1 to 14, sample rates by index.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005
# How many layer II subbands have so many bits of allocation, by table of the format.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}
TAG_KEY = "payload_bytes"


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ (CRC_POLYNOMIAL if c & 0x8000 else 0)
        table.append(c & 0xFFFF)
    return table


_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _TABLE[(c >> 8) ^ b]
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum of the first `bits` bits."""
    c, whole = 0xFFFF, bits // 8
    for b in data[:whole]:
        c = ((c << 8) & 0xFFFF) ^ _TABLE[(c >> 8) ^ b]
    for k in range(bits % 8):
        bit = data[whole] >> (7 - k) & 1
        c = ((c << 1) & 0xFFFF) ^ (CRC_POLYNOMIAL if (c >> 15) ^ bit else 0)
    return c


def allocation_bits(word: bytes, body: bytes, head: tuple) -> int:
    """Bits after the checksum that it covers in a layer I or II frame: the allocation and, in layer II, 2 more for each subband in use."""
    version, layer, _, kbps, hz, _, _, mono = head
    if layer == 1:
        widths = [4] * 32
    else:
        each = kbps if mono else kbps // 2
        name = "lsf" if version != 1 else ("d" if hz == 32000 else "c") if each <= 48 else "a" if hz == 48000 or each <= 80 else "b"
        widths = [w for n, w in ALLOCATION[name] for _ in range(n)]
    bound = 4 * (word[3] >> 4 & 3) + 4 if word[3] >> 6 == 1 else 32  # joint stereo shares the allocation above it
    number, size, at, used = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for band, w in enumerate(widths):
        for _ in range(1 if mono or band >= bound else 2):
            if at + w <= size and number >> (size - at - w) & ((1 << w) - 1):
                used += 2 if band >= bound and not mono else 1
            at += w
    return at + 2 * used * (layer == 2)


def checksum_ok(data: bytes, at: int, head: tuple) -> bool:
    """Whether a protected frame's checksum fits its header and what follows the checksum."""
    body = at + 6
    if head[1] == 3:
        found = crc16(data[at + 2 : at + 4] + data[body : body + side_bytes(head[0], head[7])])
    else:
        part = data[body : at + min(head[5], 70)]  # allocation and selection take 64 bytes at most
        bits = allocation_bits(data[at : at + 4], part, head)
        found = crc16_bits(data[at + 2 : at + 4] + part, 16 + min(bits, 8 * len(part)))
    return found == int.from_bytes(data[at + 4 : at + 6], "big")


@lru_cache(maxsize=4096)
def header(word: bytes) -> tuple | None:
    """(version, layer, protected, kbps, rate, frame bytes, samples, mono) of four header bytes; None if they aren't one."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(word[1] >> 3 & 3), {1: 3, 2: 2, 3: 1}.get(word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if not version or not layer or not 0 < index < 15 or rate == 3 or word[3] & 3 == 2:
        return None
    kbps, hz, pad = KBPS[min(2, int(version)), layer][index - 1], RATES[version][rate], word[2] >> 1 & 1
    if layer == 1:
        samples, size = 384, (12_000 * kbps // hz + pad) * 4
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        size = samples * 125 * kbps // hz + pad
    return version, layer, not word[1] & 1, kbps, hz, size, samples, word[3] >> 6 == 3


def side_bytes(version: float, mono: bool) -> int:
    return (17 if mono else 32) if version == 1 else (9 if mono else 17)


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def read_tags(data: bytes) -> tuple[dict[str, str], dict[str, str], int, int]:
    """Text tags at the start (ID3v2) and at the end (ID3v1), and where audio begins and ends. Broken tags give none."""
    tags, last, begin, end = {}, {}, 0, len(data)
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= end:
        size, major = _synchsafe(data[begin + 6 : begin + 10]), data[begin + 3]
        at, stop = begin + 10, min(begin + 10 + size, end)
        while major in (3, 4) and at + 10 <= stop and data[at]:
            name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
            n = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
            body = data[at + 10 : min(at + 10 + n, stop)]
            if name[0] == "T" and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                parts = body[1:].decode(coding, "replace").rstrip("\0").split("\0", 1)
                tags[parts[0] if name == "TXXX" else name] = parts[-1]
            at += 10 + n
        begin = stop
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        tag, end = data[end - 128 : end], end - 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if value := tag[a:b].split(b"\0")[0].decode("latin-1").strip():
                last[name] = value
    return tags, last, begin, end


def vbr_table(data: bytes, at: int, head: tuple) -> dict | None:
    """Frames and bytes that the stream itself claims, from a Xing/Info or VBRI table in its first frame."""
    version, _, protected, _, _, size, _, mono = head
    spot = at + 4 + 2 * protected + side_bytes(version, mono)
    if data[spot : spot + 4] in (b"Xing", b"Info"):
        flags, spot, out = int.from_bytes(data[spot + 4 : spot + 8], "big"), spot + 8, {"kind": data[spot : spot + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], spot = int.from_bytes(data[spot : spot + 4], "big"), spot + 4
        if flags & 4:
            out["toc"] = list(data[spot : spot + 100])
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big")}
    return None


def find_frame(data: bytes, at: int, end: int, like: tuple | None) -> int:
    """The next offset from `at` where a header stands whose frame ends at the end, or at another fitting header; -1 if none."""
    while 0 <= (at := data.find(b"\xff", at, end)):
        head = header(data[at : at + 4])
        if head and at + head[5] <= end and (not like or (head[0], head[1], head[4]) == (like[0], like[1], like[4])):
            after = at + head[5]
            follow = header(data[after : after + 4])
            if after == end or follow and (follow[0], follow[1], follow[4]) == (head[0], head[1], head[4]):
                return at
        at += 1
    return -1


def parse(data: bytes) -> dict:
    """Frames, exact duration in samples, checksum counts, tags and what was skipped to find frames again.

    What looks like a tag at the end but lies inside a frame that ends with the data is part of that frame. Bytes that belong to no whole frame are counted as skipped; a stream without a frame has 0 frames and 0 samples.
    `offsets` are the audio frames' byte offsets (the frame of a variable-bitrate table holds no audio).
    """
    tags, last, at, end = read_tags(data)
    offsets, bodies, rates, like, table = [], [], set(), None, None
    out = {"tags": tags, "skipped": 0, "resyncs": 0, "crc_ok": 0, "crc_bad": 0, "samples": 0, "rate": 0, "audio_bytes": end - at}
    while at < end:
        head = header(data[at : at + 4])
        if head and like and end < at + head[5] == len(data):
            last, end = {}, len(data)
            out["audio_bytes"] += 128
        if not head or at + head[5] > end or like and (head[0], head[1], head[4]) != (like[0], like[1], like[4]) or not like and find_frame(data, at, end, None) != at:
            found = find_frame(data, at + 1, end, like)
            out["resyncs"] += found >= 0
            out["skipped"] += (found if found >= 0 else end) - at
            at = found
            if found < 0:
                break
            continue
        version, layer, protected, kbps, hz, size, samples, mono = head
        if not like:
            table = vbr_table(data, at, head) if layer == 3 else None
        if like or not table:
            if protected:
                out["crc_ok" if checksum_ok(data, at, head) else "crc_bad"] += 1
            body = at + 4 + 2 * protected + (side_bytes(version, mono) if layer == 3 else 0)
            offsets.append(at)
            bodies.append((body, at + size))
            rates.add(kbps)
            out["samples"] += samples
        like = like or head
        out["rate"] = hz
        at += size
    for name, value in last.items():
        tags.setdefault(name, value)
    out |= {"frames": len(offsets), "offsets": offsets, "bodies": bodies, "kbps": sorted(rates), "table": table, "layer": like[1] if like else 0, "version": float(like[0]) if like else 0.0}
    out["table_ok"] = table is None or table.get("frames", len(offsets)) == len(offsets)
    return out


RATE_INDEX, SIDE = 2, 17  # 32 kHz, where every bitrate gives a whole number of bytes; mono


def _frame_starts() -> list[tuple[int, bytes]]:
    """(room for bytes, header with checksum and empty side information) for each bitrate."""
    out = []
    for i, kbps in enumerate(KBPS[1, 3], 1):
        tail = bytes([i << 4 | RATE_INDEX << 2, 0xC4])
        out.append((1152 * 125 * kbps // 32000 - 6 - SIDE, b"\xff\xfa" + tail + crc16(tail + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)))
    return out


_STARTS = _frame_starts()


def write_payload(payload: bytes) -> bytes:
    """A variable-bitrate stream that holds payload: tag with its length, Xing table, frames of the largest size, a fitting last one, empty end tag."""
    room, start = _STARTS[-1]
    frames, at, n = [], 0, len(payload)
    while n - at > room:
        frames.append(start + payload[at : at + room])
        at += room
    room, start = next(s for s in _STARTS if s[0] >= n - at)
    frames.append(start + payload[at:].ljust(room, b"\0"))
    body = b"\0" + TAG_KEY.encode() + b"\0" + str(n).encode()
    tag = b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body
    size = len(tag)
    lead = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag
    first = len(_STARTS[0][1]) + _STARTS[0][0]  # the table's frame has the lowest bitrate and no checksum
    total = first + sum(map(len, frames))
    large = len(frames[0])
    toc = bytes(min(255, 256 * (first + large * (p * len(frames) // 100)) // total) for p in range(100))
    xing = (b"\xff\xfb" + bytes([1 << 4 | RATE_INDEX << 2, 0xC4]) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc).ljust(first, b"\0")
    return b"".join([lead, xing, *frames, b"TAG", bytes(124), b"\xff"])


def read_payload(media: bytes, found: dict) -> bytes:
    """The bytes that write_payload stored, from what parse found."""
    return b"".join(media[a:b] for a, b in found["bodies"])[: int(found["tags"].get(TAG_KEY, 0))]


def feature(found: dict) -> str:
    """Codec, frames, exact duration, checksums and a digest of the seek offsets."""
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in found["offsets"]))
    return f"mpeg{found['version']:g} layer{found['layer']} frames={found['frames']} samples={found['samples']}/{found['rate']} kbps={'/'.join(map(str, found['kbps']))} crc={found['crc_ok']}+{found['crc_bad']}bad table={'ok' if found['table_ok'] else 'bad'} skipped={found['skipped']} seek={seek:08x}"


COLUMNS = "n_frames long, n_samples long, sample_rate int, duration_s double, kbps_min int, kbps_max int, crc_ok long, crc_bad long, skipped_bytes long, table string, table_ok boolean, tags map<string,string>, seek_offsets array<long>"


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the columns of COLUMNS for its binary column of MPEG audio; same-named columns are replaced.

    A null or frameless value has 0 frames, 0 samples, no offsets and a null bitrate. Values are read whole; repeated rows give
    repeated rows and an empty table an empty one. Columns of these names, in any case of letters, are replaced.
    """
    small_batches(df.sparkSession, 256)
    new = [c.split()[0] for c in COLUMNS.split(", ")]
    keep = kept(df, new)
    base = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = base.select("*", *[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in COLUMNS.split(", ")]).schema
    types = {"map<string,string>": pa.map_(pa.string(), pa.string()), "array<long>": pa.list_(pa.int64()), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [types[c.split(" ", 1)[1]] for c in COLUMNS.split(", ")]
    spot = keep.index(media)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(spot).to_pylist():
                x = parse(value or b"")
                rows.append((x["frames"], x["samples"], x["rate"], x["samples"] / x["rate"] if x["rate"] else 0.0, min(x["kbps"], default=None), max(x["kbps"], default=None), x["crc_ok"], x["crc_bad"], x["skipped"], x["table"] and x["table"]["kind"], x["table_ok"], list(x["tags"].items()), x["offsets"]))
            columns = list(zip(*rows)) if rows else [[] for _ in new]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(v), type=t) for v, t in zip(columns, kinds)]], names=[*keep, *new])

    return base.mapInArrow(read, schema)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's padded bytes stored as a stream and read back: sizes, digests and features.

    A null text counts as empty; its payload is 64 zero bytes. Texts of any length are stored whole, as many frames as they need.
    A null key stays, repeated rows give repeated rows, equal texts equal values, and an empty table an empty one. Other columns of docs
    are left out. A key named like an output, in any case of letters, is an error.
    """
    if key.lower() in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"):
        raise ValueError(f"the key {key} has the name of an output column")
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("binary").alias(f"{key}_bytes"))
    schema = slim.select(key).withColumns({"n_bytes": F.lit(0).cast("long"), "payload_bytes": F.lit(0).cast("long"), "payload_sha256": F.lit(""), "tail_crc32": F.lit(0).cast("long"), "media_bytes": F.lit(0).cast("long"), "media_sha256": F.lit(""), "feature": F.lit("")}).schema

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                raw = raw or b""
                media = write_payload(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))
                found = parse(media)
                payload = read_payload(media, found)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)))
            columns = list(zip(*rows)) if rows else [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(v), type=pa.string() if isinstance(f.dataType.typeName(), str) and f.dataType.typeName() == "string" else pa.int64()) for v, f in zip(columns, schema.fields[1:])]], names=schema.names)

    return slim.mapInArrow(through, schema)
