"""Telephony audio: mu-law and A-law by tables, IMA ADPCM blocks side by side, PCM stored resampled.

Sound columns are WAV files in a binary column. Companded bytes are looked up
in 256-entry tables made from the rule of G.711; ADPCM is sequential inside a
block, so all blocks of a batch advance by one nibble together in numpy.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_arrow, removed, shared_dir, written, written_path

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
RATE, RESAMPLED = 8000, 16000
BLOCK = 192
#: How hard stored PCM is packed, and the parts that media are turned into PCM by.
LEVEL, SLICES = 9, 4

# The step sizes and index changes of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


@functools.cache
def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@functools.cache
def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, low + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


@functools.cache
def adpcm_moves() -> np.ndarray:
    """How far each code moves the sample at each step index; row: index, column: code."""
    step, code = np.array(STEPS, np.int32)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(n, size) bytes to (n, 2 * size - 7) samples: each block starts with its first sample, its step index and a spare byte."""
    moves, changes = adpcm_moves().reshape(-1), np.array(CHANGES, np.int32)
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2").reshape(n).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((2 * size - 7, n), np.int16)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (size - 4)):
        code = (columns[k >> 1] >> (4 * (k & 1))).astype(np.int32) & 15
        value = np.clip(value + moves[index * 16 + code], -32768, 32767)
        index = np.clip(index + changes[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; as many samples as the new rate has in the same time."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        wide = np.append(pcm, pcm[-1]).astype(np.int32)
        out = np.empty(2 * len(pcm), np.int16)
        out[::2], out[1::2] = pcm, (wide[:-1] + wide[1:]) >> 1
        return out
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(pcm) - 1)
    return ((pcm[left].astype(np.int64) * (to - part) + pcm[right].astype(np.int64) * part) // to).astype(np.int16)


def wav(data: bytes, tag: int = MULAW, rate: int = RATE, align: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file around the bytes."""
    extra = struct.pack("<HH", 2, 2 * align - 7) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_second = rate * 2 if tag == PCM else rate
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(tag, rate, align, data) by walking the chunks; ValueError if they are not a whole WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            break
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and fmt:
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without its data")


def expand(tag: int, align: int, data: bytes) -> np.ndarray:
    """16-bit samples of stored bytes; a short last ADPCM block is filled with zero bytes."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return mulaw_table()[raw]
    if tag == ALAW:
        return alaw_table()[raw]
    if tag == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    if tag == ADPCM and align > 4:
        return adpcm_blocks(np.pad(raw, (0, -len(raw) % align)).reshape(-1, align)).reshape(-1)
    raise ValueError(f"format {tag} is not known")


def as_pcm(media: bytes, to: int) -> bytes:
    """A WAV file in any of the four formats as one of 16-bit samples at the rate ``to``; ValueError or struct.error if it cannot be read."""
    tag, rate, align, data = read_wav(media)
    return wav(resample(expand(tag, align, data), rate, to).astype("<i2").tobytes(), PCM, to, 2, 16)


def store_pcm(rows: DataFrame, id_col: str, media_col: str, to: int = RESAMPLED) -> DataFrame:
    """id, pcm (binary WAV of 16-bit samples at the rate ``to``), error of WAV files in any of the four formats.

    Null media, and files that cannot be read, give a null pcm and a stated
    error; rows that repeat give a row each. Other columns are not carried. Each
    row stands alone: nothing is shuffled, and a task holds an Arrow batch and
    one row's samples.
    """

    def start():
        def one(media):
            if media is None:
                return None, "null"
            try:
                return as_pcm(media, to), None
            except (ValueError, struct.error) as e:
                return None, str(e)

        def run(batch):
            pcm, errors = zip(*map(one, batch.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pcm, pa.binary()), pa.array(errors, pa.string())], ["id", "pcm", "error"])

        return run

    kind = rows.select(id_col).schema[0].dataType.simpleString()
    return map_arrow(rows.select(id_col, media_col), start, f"id {kind}, pcm binary, error string")


def payload_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes, filled with blanks to a positive multiple of BLOCK, as mu-law samples of a WAV file. Null counts as empty."""

    def start():
        def run(batch):
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [wav(x + b" " * (-len(x) % BLOCK or (0 if x else BLOCK))) for x in raw]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        return run

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), start, "doc_id long, n_bytes long, media binary")


class Heard:
    """What is told of samples, which may come in turns: the mean square, the sign changes, and the CRC-32 of the little-endian PCM."""

    def __init__(self):
        self.n, self.squares, self.changes, self.crc, self.last = 0, 0, 0, 0, None

    def add(self, pcm: np.ndarray) -> Heard:
        if len(pcm):
            wide, signs = pcm.astype(np.int64), np.signbit(pcm)
            self.n += len(pcm)
            self.squares += int((wide * wide).sum())
            self.changes += int(np.count_nonzero(signs[1:] != signs[:-1])) + (self.last is not None and bool(signs[0]) != self.last)
            self.crc, self.last = zlib.crc32(pcm.astype("<i2", copy=False).tobytes(), self.crc), bool(signs[-1])
        return self

    def __str__(self) -> str:
        return f"{self.squares // max(1, self.n)},{self.changes},{self.crc:08x}"


#: ADPCM blocks that are decoded side by side; 377 samples each.
TOGETHER = 8192


def heard_as_adpcm(data: list[bytes], together: int = TOGETHER) -> list[Heard]:
    """What is heard of each row's bytes as ADPCM blocks of BLOCK bytes. Blocks of many rows are decoded at once; a row of more than that many goes on in the next turn."""
    out = [Heard() for _ in data]
    todo = [(i, at, min(at + together * BLOCK, len(x))) for i, x in enumerate(data) for at in range(0, len(x), together * BLOCK)]
    first = 0
    while first < len(todo):
        last, size = first, 0
        while last < len(todo) and (last == first or size + todo[last][2] - todo[last][1] <= together * BLOCK):
            size, last = size + todo[last][2] - todo[last][1], last + 1
        turn = todo[first:last]
        pcm = adpcm_blocks(np.frombuffer(b"".join(data[i][a:b] for i, a, b in turn), np.uint8).reshape(-1, BLOCK))
        at = 0
        for i, a, b in turn:
            out[i].add(pcm[at : at + (b - a) // BLOCK].reshape(-1))
            at += (b - a) // BLOCK
        first = last
    return out


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def stored_pcm(media: DataFrame, to: int = RESAMPLED) -> DataFrame:
    """Digests of payload_media's files, as read back; ``others``, what is heard of their bytes as A-law, resampled to ``to``, and as ADPCM blocks; and ``pcm``, the mu-law samples as a WAV file resampled to ``to``."""

    def start():
        def run(batch):
            files = batch.column(2).to_pylist()
            data = [read_wav(x)[3] for x in files]
            digest = lambda x: hashlib.sha256(x).hexdigest()
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(x) for x in data], pa.int64()),
                pa.array([digest(x) for x in data]),
                pa.array([zlib.crc32(x[-16:]) for x in data], pa.int64()),
                pa.array([len(x) for x in files], pa.int64()),
                pa.array([digest(x) for x in files]),
                pa.array([f"alaw:{Heard().add(resample(expand(ALAW, 1, x), RATE, to))}|adpcm:{y}" for x, y in zip(data, heard_as_adpcm(data), strict=True)]),
                pa.array([as_pcm(x, to) for x in files], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in f"{STORED}, others, pcm".split(", ")])

        return run

    return map_arrow(media, start, f"{STORED}, others string, pcm binary")


def media_features(stored: DataFrame) -> DataFrame:
    """The digests of stored_pcm, and ``feature``: of the stored PCM, as read back, and of the same bytes as A-law and as ADPCM, in whole numbers the mean square, the sign changes, and the CRC-32. One form for texts of all lengths."""

    def start():
        def run(batch):
            heard = [Heard().add(np.frombuffer(read_wav(x)[3], "<i2")) for x in batch.column(8).to_pylist()]
            feature = pa.array([f"mulaw:{h}|{o}" for h, o in zip(heard, batch.column(7).to_pylist(), strict=True)])
            return pa.RecordBatch.from_arrays([*batch.columns[:7], feature], [*batch.schema.names[:7], "feature"])

        return run

    return map_arrow(stored, start, f"{STORED}, feature string")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_features of stored_pcm of payload_media, each written to the shared folder and read back by the next.

    Media are written in SLICES parts by task; each goes when its PCM is written,
    so that the two hardly ever take up room at once.
    Null and empty texts are one block of blanks; rows that repeat, and rows with
    a null id, give a row each; equal texts give equal values. Empty tables give
    no rows. Other columns are not carried.
    """
    media = written(payload_media(docs, id_col, text_col).withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES))), "media", by="slice")
    spark, path = media.sparkSession, shared_dir(media.sparkSession, "pcm")
    for k in range(SLICES):
        stored = stored_pcm(media.where(F.col("slice") == k).drop("slice"))
        stored.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(f"{path}/slice={k}")
        removed(spark, f"{written_path(media)}/slice={k}")
    dropped(media)
    return media_features(spark.read.schema(stored.schema).parquet(path).drop("slice"))
