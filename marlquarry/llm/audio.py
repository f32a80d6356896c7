"""Media columns: texts as lossless 8-bit audio, and features of audio.

Samples are stored as 8-bit PCM in a RIFF container and read back from it. Features come from the samples: a
polyphase resampler, overlapped log-mel frames, segments of energy with hysteresis, and for each segment a tensor of one
shape with its time span. Media and tensors are Arrow files, the tensors of Arrow's fixed-shape type. Resampling and
frames run in blocks; what is held at once is a slice of texts, and of its longest sound the samples and log-mel frames.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.textvec import chunks
from marlquarry.llm.workspace import Workspace, with_temp_dir


@dataclass(frozen=True)
class AudioConfig:
    """open_db, close_db: decibels from the median energy at which a segment opens and under which it closes. taps: input
    samples (at the lower of both rates) on each side of an output sample that its filter reaches."""

    rate: int = 16_000
    target: int = 8_000
    taps: int = 8
    frame: int = 256
    hop: int = 128
    mels: int = 32
    open_db: float = 0.4
    close_db: float = -0.2
    least_frames: int = 2
    steps: int = 16
    block: int = 4096
    #: Bytes of text, about, whose media and tensors make one record batch of the files.
    batch_bytes: int = 4 << 20


def pad_payload(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def encode_wav(payload: bytes, rate: int) -> bytes:
    """8-bit unsigned mono PCM; each byte of payload is a sample."""
    body = payload + bytes(len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + body


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of 8-bit mono PCM, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(8)
def _phases(rate: int, target: int, taps: int) -> tuple[int, int, np.ndarray]:
    """Interpolation and decimation factors, and the windowed-sinc filter as one row for each phase."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    cut = min(1.0, up / down)
    half = int(taps / cut)
    apart = np.arange(up)[:, None] / up + half - np.arange(2 * half + 1)[None, :]
    rows = np.sinc(apart * cut) * (1 + np.cos(np.pi * apart / (half + 1)))
    return up, down, (rows / rows.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, start: int, stop: int, cfg: AudioConfig) -> np.ndarray:
    """Output samples start:stop of x at cfg.target; x beyond its ends is silent."""
    up, down, rows = _phases(cfg.rate, cfg.target, cfg.taps)
    per = rows.shape[1]
    out = np.zeros(stop - start, dtype=np.float32)
    for phase in range(up):
        at = np.arange(start, stop)
        at = at[(at * down) % up == phase]
        if not len(at):
            continue
        first = at * down // up - per // 2
        # Outputs of a phase lie down inputs apart, so each tap is one strided slice of the padded input.
        low, high = int(first[0]), int(first[-1]) + per
        part = np.zeros(high - low, dtype=np.float32)
        a, b = max(low, 0), min(high, len(x))
        if b > a:
            part[a - low : b - low] = x[a:b]
        total = np.zeros(len(at), dtype=np.float32)
        for tap in range(per):
            total += rows[phase, tap] * part[tap : tap + (len(at) - 1) * down + 1 : down]
        out[at - start] = total
    return out


@lru_cache(8)
def _filters(cfg: AudioConfig) -> np.ndarray:
    """Triangles on the mel scale, bins by filters."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(cfg.target / 2), cfg.mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(cfg.frame, 1 / cfg.target)[:, None]
    left, middle, right = points[:-2], points[1:-1], points[2:]
    return np.maximum(0, np.minimum((bins - left) / (middle - left), (right - bins) / (right - middle))).astype(np.float32)


def log_mel(samples: np.ndarray, cfg: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames, mels) and their energies in decibels; the last frame is padded with silence."""
    n = -(-len(samples) * cfg.target // cfg.rate)
    count = max(1, -(-max(n - cfg.frame, 0) // cfg.hop) + 1)
    window = np.hanning(cfg.frame + 1)[:-1].astype(np.float32)
    mels, energy = [], []
    for first in range(0, count, cfg.block):
        last = min(count, first + cfg.block)
        start, stop = first * cfg.hop, (last - 1) * cfg.hop + cfg.frame
        y = np.zeros(stop - start, dtype=np.float32)
        y[: max(0, min(stop, n) - start)] = resample(samples, start, min(stop, n), cfg)
        frames = np.lib.stride_tricks.sliding_window_view(y, cfg.frame)[:: cfg.hop]
        frames = (frames - frames.mean(1, keepdims=True)) * window
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
        mels.append(10 * np.log10(power @ _filters(cfg) + 1e-8))
        energy.append(10 * np.log10((frames**2).mean(1) + 1e-8))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, cfg: AudioConfig) -> np.ndarray:
    """Frame spans [start, end) that open at the upper threshold and last until the lower one is passed."""
    middle = float(np.median(energy))
    mark = np.where(energy >= middle + cfg.open_db, 1, np.where(energy < middle + cfg.close_db, -1, 0))
    # Between the thresholds the last decided state lasts.
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate(([False], (at >= 0) & (mark[np.maximum(at, 0)] > 0), [False]))
    edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    return edge[edge[:, 1] - edge[:, 0] >= cfg.least_frames]


def tensors(mels: np.ndarray, spans: np.ndarray, cfg: AudioConfig) -> np.ndarray:
    """(segments, steps, mels): each segment's frames pooled to cfg.steps means."""
    sums = np.concatenate((np.zeros((1, cfg.mels)), np.cumsum(mels, axis=0, dtype=np.float64)))
    cuts = spans[:, :1] + (spans[:, 1:] - spans[:, :1]) * np.arange(cfg.steps + 1)[None, :] // cfg.steps
    low = np.minimum(cuts[:, :-1], len(mels) - 1)
    high = np.maximum(cuts[:, 1:], low + 1)
    return ((sums[high] - sums[low]) / (high - low)[:, :, None]).astype(np.float32)


def describe(media: bytes, cfg: AudioConfig) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Samples read back from media, time spans in milliseconds and tensors of its segments, and the tensor of the whole."""
    rate, payload = decode_wav(media)
    if rate != cfg.rate:
        raise ValueError(f"{rate} samples a second, not {cfg.rate}")
    samples = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(samples, cfg)
    spans = segments(energy, cfg)
    ms = 1000 / cfg.target
    times = np.stack([spans[:, 0] * cfg.hop * ms, ((spans[:, 1] - 1) * cfg.hop + cfg.frame) * ms], axis=1)
    return payload, times, tensors(mels, spans, cfg), tensors(mels, np.array([[0, len(mels)]]), cfg)


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _schemas(cfg: AudioConfig) -> tuple[pa.Schema, pa.Schema]:
    """Of a media file, and of its tensor file. row counts the rows of a media file; segment -1 is the whole sound."""
    media = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])
    tensor = pa.fixed_shape_tensor(pa.float16(), [cfg.steps, cfg.mels])
    return media, pa.schema([("row", pa.int64()), ("segment", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("tensor", tensor)])


FILES = "media string, tensors string, n_rows long"


def store_media(documents: DataFrame, folder: str | None = None, cfg: AudioConfig | None = None) -> DataFrame:
    """Write the sounds of documents (doc_id, text) and their segments' tensors; a row for each pair of files.

    A null text is empty and gives one block of zero bytes; repeated rows are stored each; an empty table writes no rows.
    Record batch i of a tensor file belongs to record batch i of the media file. Files have names of their own for
    each attempt of a task; only those in the returned table count. folder is a URI that all executors share.
    """
    cfg = cfg or AudioConfig()
    spark = documents.sparkSession
    folder = folder or with_temp_dir(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name, row = uuid.uuid4().hex, 0
        media_schema, tensor_schema = _schemas(cfg)
        paths = [f"{name}.media.arrow", f"{name}.tensors.arrow"]
        options = ipc.IpcWriteOptions(compression="zstd")
        with files.open_output_stream(f"{root}/{paths[0]}", compression=None) as a, files.open_output_stream(f"{root}/{paths[1]}", compression=None) as b:
            with ipc.new_file(a, media_schema, options=options) as media_file, ipc.new_file(b, tensor_schema, options=options) as tensor_file:
                for batch in batches:
                    for at, texts in chunks(batch.column("text"), cfg.batch_bytes):
                        sounds, sizes, owners, numbers, times, cubes = [], [], [], [], [], []
                        for text in texts:
                            data = (text.as_py() or "").encode()
                            sound = encode_wav(pad_payload(data), cfg.rate)
                            _, spans, cube, whole = describe(sound, cfg)
                            owners += [row + len(sounds)] * (len(spans) + 1)
                            numbers += range(-1, len(spans))
                            times += [np.array([[0.0, len(data) * 1000 / cfg.rate]]), spans]
                            cubes += [whole, cube]
                            sounds.append(sound)
                            sizes.append(len(data))
                        first = np.arange(row, row + len(sounds))
                        media_file.write(pa.RecordBatch.from_arrays([pa.array(first), batch.column("doc_id").slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(sounds, pa.large_binary())], schema=media_schema))
                        values = pa.array(np.concatenate(cubes).astype(np.float16).reshape(-1))
                        tensors = pa.ExtensionArray.from_storage(tensor_schema.field("tensor").type, pa.FixedSizeListArray.from_arrays(values, cfg.steps * cfg.mels))
                        spans = np.concatenate(times)
                        tensor_file.write(pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(numbers, pa.int32()), pa.array(spans[:, 0]), pa.array(spans[:, 1]), tensors], schema=tensor_schema))
                        row += len(sounds)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}"]) for p in paths] + [pa.array([row])], names=[x.split()[0] for x in FILES.split(", ")])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return Workspace(spark, "media-files").table(docs.mapInArrow(run, FILES), "files")


def read_media(files: DataFrame, cfg: AudioConfig | None = None) -> DataFrame:
    """Checks of stored sounds and a digest of their stored tensors (MEDIA), from the files that store_media() names."""
    cfg = cfg or AudioConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media_path, tensor_path in zip(batch.column("media").to_pylist(), batch.column("tensors").to_pylist(), strict=True):
                files, a = fs.FileSystem.from_uri(media_path)
                b = fs.FileSystem.from_uri(tensor_path)[1]
                with files.open_input_file(a) as x, files.open_input_file(b) as y:
                    media_file, tensor_file = ipc.open_file(x), ipc.open_file(y)
                    for i in range(media_file.num_record_batches):
                        yield digested(media_file.get_batch(i), tensor_file.get_batch(i))

    def digested(media: pa.RecordBatch, tensors: pa.RecordBatch) -> pa.RecordBatch:
        first = np.searchsorted(tensors.column("row").to_numpy(), media.column("row").to_numpy())
        ends = np.append(first[1:], tensors.num_rows)
        cubes = tensors.column("tensor").to_numpy_ndarray()
        spans = np.stack([tensors.column(c).to_numpy() for c in ("start_ms", "end_ms")], 1)
        rows = []
        for k, (sound, a, b) in enumerate(zip(media.column("media"), first, ends, strict=True)):
            stored = sound.as_py()
            rate, payload = decode_wav(stored)
            if rate != cfg.rate:
                raise ValueError(f"{rate} samples a second, not {cfg.rate}")
            sums = [zlib.crc32(np.round(x.astype(np.float64) * scale).astype("<i8").tobytes()) for x, scale in ((spans[a + 1 : b], 1), (cubes[a + 1 : b], 2), (cubes[a : a + 1], 2))]
            feature = ":".join([str(b - a - 1), *(f"{x:08x}" for x in sums)])
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([media.column("doc_id"), media.column("n_bytes"), *arrays], names=[x.split()[0] for x in MEDIA.split(", ")])

    return files.repartitionByRange(max(1, files.count()), "media").mapInArrow(run, MEDIA)


def media_digests(documents: DataFrame, cfg: AudioConfig | None = None) -> DataFrame:
    """One row for every row of documents (doc_id, text): checks of the stored sound and a digest of its stored features.

    Sounds and tensors are written and read back, see store_media(). Equal texts have equal rows but for doc_id; very long
    texts are one sound each. feature has the count of segments, the checksum of their spans and those of their tensors
    and of the whole's, in half decibels.
    """
    cfg = cfg or AudioConfig()
    return read_media(store_media(documents, cfg=cfg), cfg)


def audio_segments(media: DataFrame, cfg: AudioConfig | None = None) -> DataFrame:
    """id, segment, start_ms, end_ms and tensor for each segment of the 8-bit PCM files in media (id, media).

    A tensor is a list of steps * mels floats; as_tensors() gives the column its fixed shape. Null media have no rows.
    """
    cfg = cfg or AudioConfig()
    schema = "id long, segment int, start_ms double, end_ms double, tensor array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, sound in zip(batch.column("id").to_pylist(), batch.column("media"), strict=True):
                if not sound.is_valid:
                    continue
                _, times, cube, _ = describe(sound.as_py(), cfg)
                n, width = len(times), cfg.steps * cfg.mels
                tensor = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(cube.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(times[:, 0]), pa.array(times[:, 1]), tensor],
                    names=["id", "segment", "start_ms", "end_ms", "tensor"],
                )

    return media.select(F.col("id").cast("long").alias("id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, schema)


def as_tensors(column: pa.ChunkedArray, cfg: AudioConfig | None = None) -> pa.FixedShapeTensorArray:
    """The tensor column of audio_segments() as a fixed-shape Arrow tensor array."""
    cfg = cfg or AudioConfig()
    width = cfg.steps * cfg.mels
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    storage = pa.FixedSizeListArray.from_arrays(values.cast(pa.float32()), width)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), [cfg.steps, cfg.mels]), storage)
