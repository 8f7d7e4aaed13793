"""MPEG audio as media columns: exact durations, seek offsets, verified checksums.

``parse`` reads any MPEG-1/2/2.5 audio stream: it skips and reads tags (ID3v2 before,
ID3v1 and APE after the audio; what looks like one inside a chain of frames that ends with
the stream is audio), resynchronises on frame headers (a header counts if the
next frame's header, the end or a tag follows where its length says), reads Xing, Info
and VBRI tables with their seek points, verifies checksums (Layer III: header and side
information; Layers I and II: header, bit allocation and scale factor selection), and keeps
every frame's offset and the exact number of samples.

``encode`` stores bytes losslessly in such a stream: a text's payload is the main data of
Layer III frames (32 kHz, mono, checksummed), at most five units of 192 bytes a frame;
side information states each granule's exact length in bits, so the payload is read back
from the stored frames alone.  A variable-bitrate table precedes the frames, a tag with
the unpadded length precedes that.

Defined results: null text counts as empty; an empty text is one unit of spaces; repeated
rows get equal results; a stream without a frame has no duration and no offsets; a long text
is one stream of as many frames as it needs, held once in a worker; of two places that could
begin a frame the first counts; other columns than doc_id and text are ignored, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ids_and_texts, map_batches, read_table, texts_of

UNIT = 192
#: Layer III bitrates (kbit/s) for 1 to 5 units a frame at 32 kHz, fixed by the format.
_UNITS_TO_KBPS = {1: 48, 2: 96, 3: 160, 4: 192, 5: 224}
#: Bitrates by index, fixed by the format: (version 1 or 2, layer) to kbit/s.
_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@lru_cache(maxsize=4096)
def header(word: bytes) -> tuple[int, int, int, int, bool, int, int] | None:
    """(length, samples, rate, layer, checksummed, side information bytes, kbit/s) of a
    frame whose header these 4 bytes are; None if they are no header."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate_index, pad, mono = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1, word[3] >> 6 == 3
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    first = version == 3
    kbps, rate = _KBPS[1 if first else 2, layer][index], _RATES[version][rate_index]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return length, samples, rate, layer, not word[1] & 1, side, kbps


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out[i] = c
    return out


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's checksum of each row of bytes."""
    table, crc = _crc_table(), np.full(len(rows), 0xFFFF, dtype=np.uint16)
    for j in range(rows.shape[1]):
        crc = (crc << np.uint16(8)) ^ table[(crc >> np.uint16(8)).astype(np.uint8) ^ rows[:, j]]
    return crc


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes that the tag before the audio takes, and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, at, tags = min(len(data), 10 + size), 10, {}
    while at + 10 <= end and data[at : at + 1].isalnum():
        name = data[at : at + 4].decode("latin-1")
        raw = data[at + 4 : at + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if data[3] >= 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            text = body[1:].decode("utf-16" if body[0] in (1, 2) else "utf-8" if body[0] == 3 else "latin-1", "replace")
            key, _, value = text.partition("\x00") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\x00")
        at += 10 + n
    return end, tags


def _tail(data: bytes, start: int) -> tuple[int, dict[str, str]]:
    """Where tags after the audio would begin, and their text."""
    end, tags = len(data), {}
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            tags[name] = data[end + a : end + b].split(b"\x00")[0].decode("latin-1").strip()
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        end = max(start, end - size - (32 if data[end - 9] & 0x80 else 0))
    return end, tags


def _frames(data: bytes, start: int, end: int) -> tuple[list[int], list[tuple], int, bool]:
    """Offsets and headers of the frames, skipped bytes, and whether the last frame ends
    with the data and begins where a frame or the tag before the audio ends."""
    at, skipped = start, 0
    offsets, kinds = [], []
    synced = chained = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and at + h[0] <= end:
            nxt = at + h[0]
            alike = synced and kinds[-1][2:4] == h[2:4]  # a stream keeps its rate and layer
            if alike or nxt == end or header(data[nxt : nxt + 4]):
                offsets.append(at)
                kinds.append(h)
                chained = nxt == end and (synced or at == start)
                at, synced = nxt, True
                continue
        synced = False
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        skipped += found - at
        at = found
    return offsets, kinds, skipped + end - at, chained


def parse(data: bytes) -> dict:
    """Tags, table, frames' offsets, samples, checksum counts and skipped bytes."""
    start, tags = _id3v2(data)
    end, after = _tail(data, start)
    offsets, kinds, skipped, chained = _frames(data, start, len(data))
    if end < len(data) and not chained:
        offsets, kinds, skipped, _ = _frames(data, start, end)
        tags = after | tags
    else:
        end = len(data)
    out = {"tags": tags, "skipped": skipped, "table": None, "start": start, "end": end}
    if offsets:
        at, h = offsets[0], kinds[0]
        mark = at + 4 + h[5]
        if data[mark : mark + 4] in (b"Xing", b"Info"):
            out["table"] = _xing(data, mark)
        elif data[at + 36 : at + 40] == b"VBRI":
            out["table"] = _vbri(data, at + 36)
        if out["table"]:
            offsets, kinds = offsets[1:], kinds[1:]
    out["offsets"] = np.array(offsets, dtype=np.int64)
    out["kinds"] = kinds
    out["samples"] = sum(k[1] for k in kinds)
    out["rate"] = kinds[0][2] if kinds else 0
    ok = bad = 0
    raw = np.frombuffer(data, dtype=np.uint8)
    for side in {k[5] for k in kinds if k[3] == 3 and k[4]}:
        mine = np.array([o for o, k in zip(offsets, kinds, strict=True) if k[3] == 3 and k[4] and k[5] == side], dtype=np.int64)
        mine = mine[mine + 6 + side <= len(raw)]
        covered = np.concatenate([[2, 3], 6 + np.arange(side)])
        stored = raw[mine + 4].astype(np.uint16) << np.uint16(8) | raw[mine + 5]
        same = int((crc16(raw[mine[:, None] + covered]) == stored).sum())
        ok, bad = ok + same, bad + len(mine) - same
    for at, k in zip(offsets, kinds, strict=True):
        if k[3] != 3 and k[4] and at + k[0] <= len(data):
            same = _allocation_crc(data[at : at + k[0]], k) == int.from_bytes(data[at + 4 : at + 6], "big")
            ok, bad = ok + same, bad + (not same)
    return out | {"crc_ok": ok, "crc_bad": bad}


def _vbri(data: bytes, at: int) -> dict:
    """A VBRI table: sizes, and ``points``, the place of every so many frames in the stream."""
    number = lambda a, n: int.from_bytes(data[at + a : at + a + n], "big")
    entries, scale, width, step = number(18, 2), number(20, 2), number(22, 2), number(24, 2)
    raw = data[at + 26 : at + 26 + entries * width]
    steps = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw) - width + 1, width)] if width else []
    points = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64) if steps else np.zeros(0, dtype=np.int64)
    return {"kind": "VBRI", "bytes": number(10, 4), "frames": number(14, 4), "toc": b"", "points": points, "frames_a_point": step}


def _bits_crc(bits: str) -> int:
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) != int(b) else 0)) & 0xFFFF
    return crc


def _allocation_bits(k: tuple, channels: int) -> list[int]:
    """Bits of each subband's allocation, fixed by the format: by layer, version and, for the first
    version's Layer II, rate and bitrate of a channel."""
    _, _, rate, layer, _, _, kbps = k
    if layer == 1:
        return [4] * 32
    if rate < 32000:  # low sampling rates
        return [4] * 4 + [3] * 7 + [2] * 19
    each = kbps // channels
    if rate == 48000 and each >= 56 or 56 <= each <= 80:
        return [4] * 11 + [3] * 12 + [2] * 4
    if rate != 48000 and each >= 96:
        return [4] * 11 + [3] * 12 + [2] * 7
    return [4] * 2 + [3] * (10 if rate == 32000 else 6)


def _allocation_crc(frame: bytes, k: tuple) -> int:
    """The checksum of a Layer I or II frame: header, bit allocation and, for Layer II, the
    selection bits of the subbands that have an allocation.  From the bound of joint stereo on,
    both channels share one allocation."""
    mode = frame[3] >> 6
    channels = 1 if mode == 3 else 2
    widths = _allocation_bits(k, channels)
    bound = min(len(widths), 4 * ((frame[3] >> 4 & 3) + 1)) if mode == 1 else len(widths)
    bits = "".join(f"{b:08b}" for b in frame[6 : 6 + 64])
    at, selected = 0, 0
    for band, n in enumerate(widths):
        own = channels if band < bound else 1
        for _ in range(own):
            used = "1" in bits[at : at + n]
            selected += (channels if own == 1 and channels == 2 else 1) if used else 0
            at += n
    if k[3] == 2:
        at += 2 * selected
    return _bits_crc(f"{frame[2]:08b}{frame[3]:08b}" + bits[:at])


def _xing(data: bytes, at: int) -> dict:
    flags, p, out = int.from_bytes(data[at + 4 : at + 8], "big"), at + 8, {"kind": data[at : at + 4].decode(), "frames": None, "bytes": None, "toc": b""}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(data[p : p + 4], "big")
            p += 4
    if flags & 4:
        out["toc"] = data[p : p + 100]
    return out


@lru_cache(maxsize=8)
def _frame_head(units: int) -> bytes:
    """Header, checksum and side information of a frame that holds so many units."""
    word = bytes([0xFF, 0xFA, _KBPS[1, 3].index(_UNITS_TO_KBPS[units]) << 4 | 2 << 2, 0xC0])
    granule = units * UNIT // 2 * 8  # bits of main data in each of the two granules
    bits = "0" * 18 + (format(granule, "012b") + "0" * 47) * 2
    side = int(bits, 2).to_bytes(17, "big")
    crc = int(crc16(np.frombuffer(word[2:] + side, dtype=np.uint8)[None, :])[0])
    return word + crc.to_bytes(2, "big") + side


def encode(payload: bytes, n_bytes: int) -> bytes:
    """An MPEG stream that holds the payload, a positive multiple of 192 bytes."""
    units = len(payload) // UNIT
    whole, rest = divmod(units, 5)
    head = _frame_head(5)
    size = header(head[:4])[0]
    block = np.zeros((whole, size), dtype=np.uint8)
    block[:, : len(head)] = np.frombuffer(head, dtype=np.uint8)
    block[:, len(head) : len(head) + 5 * UNIT] = np.frombuffer(payload, dtype=np.uint8, count=whole * 5 * UNIT).reshape(whole, 5 * UNIT)
    audio = block.tobytes()
    if rest:
        head = _frame_head(rest)
        audio += (head + payload[whole * 5 * UNIT :]).ljust(header(head[:4])[0], b"\x00")
    frames = whole + bool(rest)
    value = b"\x00n_bytes\x00" + str(n_bytes).encode()
    tag = b"TXXX" + len(value).to_bytes(4, "big") + b"\x00\x00" + value
    n = len(tag)
    tag = b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag
    word = bytes([0xFF, 0xFB, _KBPS[1, 3].index(48) << 4 | 2 << 2, 0xC0])
    lead = header(word)[0]
    total = lead + len(audio)
    place = lambda i: lead + min(frames * i // 100 * size, len(audio))
    toc = bytes(min(255, place(i) * 256 // total) for i in range(100))
    xing = word + b"\x00" * 17 + b"Xing" + (15).to_bytes(4, "big") + frames.to_bytes(4, "big") + min(total, 2**32 - 1).to_bytes(4, "big") + toc + (50).to_bytes(4, "big")
    return tag + xing.ljust(lead, b"\x00") + audio


def payload_of(data: bytes, parsed: dict) -> bytes:
    """The main data of all Layer III mono frames whose side information begins at 0."""
    out = []
    for at, k in zip(parsed["offsets"].tolist(), parsed["kinds"], strict=True):
        begin = at + (6 if k[4] else 4)
        side = int.from_bytes(data[begin : begin + 17], "big")
        n = (side >> 106 & 0xFFF) + (side >> 47 & 0xFFF)
        out.append(data[begin + 17 : begin + 17 + n // 8])
    return b"".join(out)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def features(payload: bytes, p: dict) -> str:
    """Of the stored form and of its samples (8 bits, 128 is silence)."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int16) - 128
    energy = float(np.square(x, dtype=np.int32).astype(np.float64).sum()) / max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    kbits = sum(k[6] * k[1] for k in p["kinds"])
    return (
        f"frames={len(p['kinds'])};samples={p['samples']};rate={p['rate']};table={(p['table'] or {}).get('kind', 'none')}:{(p['table'] or {}).get('frames')}"
        f";kbps={kbits // max(1, p['samples'])};crc_ok={p['crc_ok']};crc_bad={p['crc_bad']};skipped={p['skipped']};rms={energy**0.5:.3f};crossings={crossings}"
    )


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, duration_s double, seek_offsets array<long>"


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for every row of docs: the stored stream's digests, features, duration and
    the offset of every frame."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            payload, n = padded(t)
            data = encode(payload, n)
            p = parse(data)
            back = payload_of(data, p)
            rows.append(
                (i, int(p["tags"]["n_bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                 features(back, p), p["samples"], p["rate"], p["samples"] / p["rate"] if p["rate"] else None, p["offsets"])
            )
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()))
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_batches(ids_and_texts(docs), run, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))
