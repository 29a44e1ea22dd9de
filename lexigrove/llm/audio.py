"""Media columns: texts stored as 8-bit audio, read back, and turned into log-mel tensors and energy segments.

``encode_audio`` builds a WAV file (one channel, 8-bit samples) of each text's UTF-8 bytes with JVM expressions;
``audio_features`` reads such files, resamples them by a polyphase filter, takes overlapped log-mel filterbanks and splits
the signal by energy with hysteresis. Tensors have one fixed shape, ``FRAMES`` x ``BANDS``, each with its time span.
``store_features`` writes them as Arrow files, in Arrow's fixed-shape tensor type, and ``read_features`` reads these back.
Many recordings are computed at once, parted by silence longer than the filter, so that none touches another. Taps are whole
multiples of a power of two, so filtered samples are exact, and log values are whole multiples of ``QUANTUM`` before they are
compared or summed: equal recordings have equal features, whatever they are computed with.

A task writes a file under a name of its own and moves it into place when it is whole; the manifest names the files of the tasks
that counted, so what a lost executor or a second attempt leaves is never read.

Defined results: a null text is an empty one; an empty text is 64 bytes of 0; each row gives a row, repeated rows too;
an empty table gives no rows; further columns can be kept by name, but for those that have the name of a new one, which raise an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import arrow_map
from .shared import batches, materialize, refuse_clashes

UNIT = 64
HEADER = 44
RATE = 16_000
#: Resampling ratio: UP output samples for DOWN input samples.
UP, DOWN = 1, 2
TAPS = 32
SIZE, HOP = 128, 64  # samples of a frame and between frames, after resampling
BANDS, FRAMES = 16, 16
#: A task reads so many bytes of stored features, if there are more of them than cores.
READ_BYTES = 128 << 20
#: A segment begins where energy is so many dB over the recording's mean, and ends where it is so many below.
ON_DB, OFF_DB = 0.5, -0.5

#: Log values are rounded to multiples of it.
QUANTUM = 1e-4

TENSOR = pa.fixed_shape_tensor(pa.float16(), (FRAMES, BANDS), dim_names=("frame", "band"))
FEATURES = (
    "n_frames long, mean_db double, band_means array<double>, "
    "tensors array<struct<start_ms: double, end_ms: double, values: array<float>>>, segments array<struct<start_ms: double, end_ms: double>>"
)


def _le32(n: Column) -> Column:
    """A number as four little-endian bytes."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, p, 2) for p in (7, 5, 3, 1)]))


def encode_audio(docs: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, n_bytes, media): each text's UTF-8 bytes, with zeros up to a positive multiple of ``UNIT``, as a WAV file."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    refuse_clashes(docs.select(*keep), "raw", "n_bytes", "media")
    size = F.octet_length("raw").cast("long")
    full = F.greatest(F.ceil(size / UNIT), F.lit(1)) * UNIT
    head = (F.lit(b"RIFF"), _le32(full + HEADER - 8), F.lit(b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0]) + 2 * RATE.to_bytes(4, "little") + bytes([1, 0, 8, 0]) + b"data"), _le32(full))
    zeros = F.unhex(F.repeat(F.lit("00"), (full - size).cast("int")))
    return docs.select(*keep, raw.alias("raw")).select(*keep, size.alias("n_bytes"), F.concat(*head, F.col("raw"), zeros).alias("media"))


def payload(media: Column) -> Column:
    """The samples of a file made by ``encode_audio``."""
    return F.substring(media, HEADER + 1, 2**31 - 1 - HEADER)


def samples(media: bytes) -> np.ndarray:
    """The unsigned 8-bit samples of a WAV file; its chunks are walked, not assumed."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"data":
            return np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def polyphase(up: int = UP, down: int = DOWN, taps: int = TAPS, block: int = 64) -> np.ndarray:
    """A windowed-sinc low-pass as a matrix: ``block * down`` input samples and ``taps`` before them give ``block * up`` output samples.

    Column n holds the phase of the filter that output n needs; the zeros that upsampling would insert are never formed.
    """
    cutoff, half = min(1 / up, 1 / down), up * taps // 2
    k = np.arange(-half, half + 1)
    filt = np.round(np.sinc(k * cutoff) * cutoff * np.hamming(len(k)) * up * 2**20) / 2**20
    matrix = np.zeros((taps + block * down, block * up))
    for n in range(block * up):
        centre = n * down / up + taps / 2
        for row in range(matrix.shape[0]):
            at = round((row - centre) * up) + half
            if 0 <= at < len(filt):
                matrix[row, n] = filt[at]
    return matrix


def resample(signal: np.ndarray, block: int = 64) -> np.ndarray:
    """``signal``, of a length divisible by ``block * DOWN``, at UP/DOWN of its rate."""
    matrix = polyphase(block=block)
    padded = np.concatenate((np.zeros(TAPS // 2), signal, np.zeros(TAPS - TAPS // 2)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, matrix.shape[0])[:: block * DOWN][: len(signal) // (block * DOWN)]
    return (rows @ matrix).ravel()


@cache
def mel_filters(rate: float = RATE * UP / DOWN, size: int = SIZE, bands: int = BANDS) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a real FFT of ``size`` samples."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(size // 2 + 1) * rate / size
    rise = (bins[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    fall = (hz[2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None) + 1e-9


def hysteresis(energy: np.ndarray, first: np.ndarray, on: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which frames are active: from one at ``on`` or more until one below ``off``; ``first`` marks where a recording begins."""
    event = np.where(energy >= on, 1, np.where(energy < off, -1, 0))
    event[first & (event == 0)] = -1
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), 0))
    return event[last] == 1


def log_mel(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-mel frames, their energy in dB, both in multiples of ``QUANTUM``; number of frames of each recording) of 8-bit recordings, all at once."""
    step = HOP * DOWN // UP
    frames = np.array([-(-len(x) // step) for x in recordings])
    # silence after each: at least the filter's length and a frame's overlap
    room = frames * step + 2 * step
    starts = np.concatenate(([0], np.cumsum(room)))
    signal = np.zeros(starts[-1])
    for at, x in zip(starts.tolist(), recordings, strict=False):
        signal[at : at + len(x)] = (x.astype(np.float64) - 128) / 128
    low = resample(signal, HOP)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((low, np.zeros(SIZE))), SIZE)[::HOP]
    which = np.concatenate([np.arange(n) + at // step for n, at in zip(frames.tolist(), starts.tolist(), strict=False)])
    power = np.abs(np.fft.rfft(windows[which] * np.hanning(SIZE), axis=1)) ** 2
    quantized = lambda x: np.rint(x / QUANTUM).astype(np.int64)
    return quantized(np.log10(power @ mel_filters() + 1e-6)), quantized(10 * np.log10(power.mean(1) + 1e-6)), frames


def tensor_array(values: np.ndarray) -> pa.Array:
    """Tensors of ``FRAMES`` x ``BANDS`` values as Arrow's fixed-shape tensors."""
    flat = pa.array(np.ascontiguousarray(values, np.float16).ravel())
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, FRAMES * BANDS))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def features(recordings: list[np.ndarray]) -> list[pa.Array]:
    """The columns of ``STORED`` for 8-bit recordings."""
    mel, energy, frames = log_mel(recordings)
    owner = np.repeat(np.arange(len(frames)), frames)
    at = np.concatenate(([0], np.cumsum(frames)[:-1]))
    nth = np.arange(len(owner)) - at[owner]
    total = np.add.reduceat(energy, at)
    bands = np.add.reduceat(mel, at) * QUANTUM / frames[:, None]
    step_ms = 1000 * HOP * DOWN / UP / RATE
    # tensors: frames in rows of FRAMES, the last one of a recording filled with its floor
    counts = -(-frames // FRAMES)
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    tensors = np.full((counts.sum() * FRAMES, BANDS), -6.0, np.float16)
    tensors[base[owner] * FRAMES + nth] = mel * QUANTUM
    t_owner = np.repeat(np.arange(len(counts)), counts)
    t_nth = np.arange(len(t_owner)) - base[t_owner]
    ends = np.minimum((t_nth + 1) * FRAMES, frames[t_owner])
    spans = pa.StructArray.from_arrays([pa.array(t_nth * FRAMES * step_ms), pa.array(ends * step_ms), tensor_array(tensors.reshape(-1, FRAMES, BANDS))], names=["start_ms", "end_ms", "values"])
    # energy against the mean and so many dB: both times the number of frames, in whole numbers
    over = energy * frames[owner] - total[owner]
    active = hysteresis(over, nth == 0, np.rint(ON_DB / QUANTUM).astype(np.int64) * frames[owner], np.rint(OFF_DB / QUANTUM).astype(np.int64) * frames[owner])
    begin = active & ((nth == 0) | ~np.concatenate(([False], active[:-1])))
    stop = active & (np.concatenate((nth[1:] == 0, [True])) | ~np.concatenate((active[1:], [False])))
    segments = pa.StructArray.from_arrays([pa.array(nth[begin] * step_ms), pa.array((nth[stop] + 1) * step_ms)], names=["start_ms", "end_ms"])
    return [
        pa.array(frames),
        pa.array(total * QUANTUM / frames),
        _lists(np.full(len(frames), BANDS), pa.array(bands.ravel())),
        _lists(counts, spans),
        _lists(np.bincount(owner[begin], minlength=len(frames)), segments),
    ]


NAMES = ("n_frames", "mean_db", "band_means", "tensors", "segments")
MANIFEST = "path string, rows long, bytes long"


def plain(tensors: pa.Array) -> pa.Array:
    """A column of lists of spans with tensors, with the tensors as lists of numbers."""
    spans = tensors.flatten()
    held = spans.field(2)
    if held.type != TENSOR:
        raise ValueError(f"not tensors of {FRAMES} x {BANDS}")
    values = held.storage.flatten().cast(pa.float32())
    lists = _lists(np.full(len(spans), FRAMES * BANDS), values)
    fields = [pa.field("start_ms", pa.float64()), pa.field("end_ms", pa.float64()), pa.field("values", pa.list_(pa.float32()))]
    return _lists(tensors.value_lengths().to_numpy(), pa.StructArray.from_arrays([spans.field(0), spans.field(1), lists], fields=fields))


def _computed(stream: Iterator[pa.RecordBatch], keep: int) -> Iterator[list[pa.Array]]:
    for batch in batches(stream, 2 << 20):
        if batch.num_rows:
            yield [*batch.columns[:keep], *features([samples(x.as_py()) for x in batch.column(keep)])]


def _schema(kept: DataFrame) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), FEATURES])


def audio_features(media: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, ``FEATURES``) of ``media(media binary, ...)``: one row for each recording."""
    kept = media.select(*keep)
    refuse_clashes(kept, *NAMES)

    def compute(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _computed(stream, len(keep)):
            columns[len(keep) + 3] = plain(columns[len(keep) + 3])
            yield pa.RecordBatch.from_arrays(columns, [*keep, *NAMES])

    return arrow_map(media.select(*keep, "media"), compute, _schema(kept))


def store_features(media: DataFrame, folder: str, *keep: str) -> DataFrame:
    """Write (kept columns, features) of ``media`` as Arrow files below ``folder``, a URI that all executors share; the files, as ``MANIFEST``."""
    refuse_clashes(media.select(*keep), *NAMES)

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        path, out, rows = f"{root}/{uuid.uuid4().hex}.arrow", None, 0
        for columns in _computed(stream, len(keep)):
            batch = pa.RecordBatch.from_arrays(columns, [*keep, *NAMES])
            if out is None:
                sink = where.open_output_stream(path + ".part", compression=None)
                out = pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            out.write_batch(batch)
            rows += batch.num_rows
        done = []
        if out:
            out.close()
            size = sink.tell()
            sink.close()
            where.move(path + ".part", path)
            done = [{"path": path, "rows": rows, "bytes": size}]
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())]))

    return materialize(arrow_map(media.select(*keep, "media"), write, MANIFEST), "manifest")


def read_features(manifest: DataFrame, folder: str, kept: DataFrame) -> DataFrame:
    """The rows of the files that ``manifest`` names: the columns of ``kept``, and ``FEATURES``."""

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(folder)
        for paths in stream:
            for path in paths.column(0).to_pylist():
                with where.open_input_stream(path, compression=None) as source:
                    for batch in pa.ipc.open_stream(source):
                        columns = [plain(c) if n == "tensors" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    total = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = min(total[0], max(2 * manifest.sparkSession.sparkContext.defaultParallelism, -(-(total[1] or 0) // READ_BYTES)))
    return arrow_map(manifest.select("path").repartition(max(1, tasks)), read, _schema(kept))
