"""Media columns: log-mel features and speech-like segments of audio, with time spans.

A recording (WAV, or raw 8-bit PCM) is resampled by a polyphase filter, cut into
overlapping frames, and turned into log-mel energies; frames are stored by fixed
windows as float32 tensors of one shape, each an Arrow record batch whose column
is of the fixed-shape tensor type. Segments are found on the frame energy
with two limits: one opens above the higher and closes below the lower.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SOURCE_RATE, RATE = 22_050, 16_000
FRAME, HOP, FFT, MELS, WINDOW = 400, 160, 512, 40, 128
TAPS, HIGH_DB, LOW_DB, SHORTEST, FLOOR = 16, 6.0, 3.0, 5, 1e-10
_BLOCK = 4096
#: Outputs below which filters are gathered for each output, instead of one product for each phase.
_FEW = 50_000
_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
_COLUMNS = [("window", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int64()), ("tensor", pa.binary()), ("segments", _SPANS)]
_SCHEMA = "window long, start_s double, end_s double, frames long, tensor binary, segments array<struct<start_s:double,end_s:double>>"
TENSOR = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS), dim_names=("frame", "mel"))
_BYTES = WINDOW * MELS * 4


def decode(data: bytes, rate: int = SOURCE_RATE) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1) of one channel (the mean of several), and their rate.

    RIFF/WAVE with 8-, 16- or 32-bit integer PCM is read by its header; anything
    else is taken as unsigned 8-bit PCM of `rate`. A header without samples, or
    of another coding, gives none.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128, rate
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and form and form[0] in (1, 0xFFFE) and form[1] and form[2] and form[5] in (8, 16, 32):
            kind = {8: np.uint8, 16: np.dtype("<i2"), 32: np.dtype("<i4")}[form[5]]
            width = form[1] * form[5] // 8
            x = np.frombuffer(body[: len(body) // width * width], kind).astype(np.float32)
            x = (x - 128) / 128 if form[5] == 8 else x / float(1 << (form[5] - 1))
            return x.reshape(-1, form[1]).mean(axis=1), form[2]
        at += 8 + size + size % 2
    return np.zeros(0, np.float32), rate


@lru_cache(16)
def phases(up: int, down: int) -> np.ndarray:
    """The filter of each of `up` phases: a Kaiser-windowed sinc that passes what both rates can hold, each phase of sum 1."""
    cut = min(1.0, up / down)
    half = int(np.ceil(TAPS / 2 / cut))
    k = np.arange(-half + 1, half + 1)
    t = k[None, :] - np.arange(up)[:, None] / up
    h = np.sinc(t * cut) * np.i0(8.0 * np.sqrt(np.maximum(0, 1 - (t / half) ** 2)))
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, source: int, target: int = RATE) -> np.ndarray:
    """x at another rate: output n lies at source place n * down / up, and uses the filter of its phase."""
    g = gcd(source, target)
    up, down = target // g, source // g
    if up == down or not len(x):
        return x
    h = phases(up, down)
    half = h.shape[1] // 2
    count = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(half - 1, np.float32), x, np.zeros(half + down + 1, np.float32)))
    views = np.lib.stride_tricks.sliding_window_view(padded, h.shape[1])
    if count < _FEW:
        at = np.arange(count) * down
        return np.einsum("nt,nt->n", views[at // up], h[at % up])
    out = np.empty(count, np.float32)
    for first in range(min(up, count)):
        base, phase = divmod(first * down, up)
        n = -(-(count - first) // up)
        out[first::up] = views[base : base + (n - 1) * down + 1 : down] @ h[phase]
    return out


@lru_cache(4)
def mel_bank(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles that are even on the mel scale, from 0 to half the rate: (bins, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def frames_of(n: int) -> int:
    """Frames of n samples: all that begin inside; the last are padded with silence."""
    return -(-n // HOP)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies of each frame, frame energy in dB)."""
    n = frames_of(len(y))
    mel, level = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    padded = np.concatenate((y, np.zeros(FRAME, np.float32)))
    views = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:n] if n else None
    for i in range(0, n, _BLOCK):
        part = views[i : i + _BLOCK] * _HANN
        power = np.abs(np.fft.rfft(part, FFT)) ** 2
        mel[i : i + _BLOCK] = np.log(power.astype(np.float32) @ mel_bank() + FLOOR)
        level[i : i + _BLOCK] = 10 * np.log10((part * part).mean(axis=1) + FLOOR)
    return mel, level


def segments(level: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Runs of frames [start, end) that rise above median + high and last until they fall below median + low; shorter ones are dropped."""
    if not len(level):
        return []
    base = float(np.median(level))
    above, over = level >= base + low, level > base + high
    edge = np.flatnonzero(np.diff(np.concatenate(([False], above, [False])).astype(np.int8)))
    seen = np.concatenate(([0], np.cumsum(over)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if seen[b] > seen[a] and b - a >= shortest]


def as_tensor(values: bytes) -> pa.ExtensionArray:
    """float32 values in row order as an array of TENSOR."""
    flat = pa.array(np.frombuffer(values, np.float32))
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, WINDOW * MELS))


@lru_cache(1)
def _frame() -> tuple[bytes, bytes]:
    """What comes before and after the values in an Arrow stream of one tensor: shape and type are always the same."""
    mark = np.arange(1, WINDOW * MELS + 1, dtype=np.float32).tobytes()
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([as_tensor(mark)], ["tensor"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    whole = sink.getvalue().to_pybytes()
    at = whole.index(mark)
    return whole[:at], whole[at + len(mark) :]


def features(data: bytes, rate: int = SOURCE_RATE) -> Iterator[tuple]:
    """(window, start, end, frames, tensor, segments) of a recording; the last window is padded with the energy of silence."""
    mel, level = log_mel(resample(*decode(data, rate)))
    found = segments(level)
    second = HOP / RATE
    before, after = _frame()
    for w in range(-(-len(mel) // WINDOW)):
        part = mel[w * WINDOW : (w + 1) * WINDOW]
        full = np.full((WINDOW, MELS), np.log(FLOOR), np.float32)
        full[: len(part)] = part
        first, last = w * WINDOW, w * WINDOW + len(part)
        own = [{"start_s": max(a, first) * second, "end_s": min(b, last) * second} for a, b in found if a < last and b > first]
        yield w, first * second, last * second, len(part), before + full.tobytes() + after, own


def audio_features(media: DataFrame, id_col: str = "id", audio_col: str = "audio", rate: int = SOURCE_RATE) -> DataFrame:
    """(id, window, start_s, end_s, frames, tensor, segments): WINDOW x MELS log-mel tensors of each recording, in order.

    `tensor` is an Arrow stream of one row whose column has the fixed-shape
    tensor type TENSOR (`tensors` reads a column of them as one array); `frames`
    says how many rows of it are sound. `segments` are the loud spans inside the
    window, cut at its ends. Null, empty and unreadable recordings have no
    window. Rows are worked on one by one: null and repeated ids are reported as
    they come, ids are of any type. An empty table gives no rows.
    """
    some = media.select(F.col(id_col).alias("id"), F.col(audio_col).cast("binary").alias("audio")).where("audio is not null")
    kind = some.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, data in zip(*batch.columns, strict=True):
                for window in features(data.as_py(), rate):
                    rows.append((i.as_py(), *window))
                    if len(rows) == 256:
                        yield emit(rows)
                        rows = []
            if rows:
                yield emit(rows)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)

    return some.mapInArrow(run, f"id {kind.simpleString()}, {_SCHEMA}")


def tensors(column: pa.Array | pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """The `tensor` column as one array of Arrow's fixed-shape tensor type."""
    before = len(_frame()[0])
    return as_tensor(b"".join(v.as_py()[before : before + _BYTES] for v in column))


def write_tensors(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows of `audio_features` to Arrow files in the shared folder `path`; (file, rows) of each.

    The tensor column is Arrow's fixed-shape tensor type, the time spans lie
    beside it. `path` is a URI of any file system that Arrow opens (file, hdfs,
    s3, ...) and must be one that all executors share. A task writes one file
    under a name of its own and moves it into place when done, so that a task
    which runs again leaves no half file.
    """
    uri = path if "://" in path else f"file://{os.path.abspath(path)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, rows, out = TaskContext.get(), 0, None
        where, folder = fs.FileSystem.from_uri(uri)
        name = f"{folder}/part-{task.partitionId():05d}.arrow"
        scratch = f"{folder}/.{task.taskAttemptId()}.arrow"
        where.create_dir(folder, recursive=True)
        for batch in batches:
            at = batch.schema.get_field_index("tensor")
            whole = pa.record_batch([tensors(c) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
            if out is None:
                sink = where.open_output_stream(scratch)
                out = pa.ipc.new_file(sink, whole.schema)
            out.write_batch(whole)
            rows += batch.num_rows
        if out:
            out.close()
            sink.close()
            where.move(scratch, name)
            yield pa.record_batch([pa.array([name]), pa.array([rows], pa.int64())], names=["file", "rows"])

    return df.mapInArrow(run, "file string, rows long")
