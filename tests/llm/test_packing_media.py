import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from lexigrove.llm import audio, packing

PATH = public_tokenizers.path(packing.__dict__.get("VOCABULARY", "word_bpe_49k.json"))
DOCS = [(1, "The quick brown fox, don't stop!", "x"), (2, None, "x"), (3, "", "x"), (4, "word ** !! 12½ éàÎ ΑΣ ας " * 900, None), (5, "a", "y"), (5, "a", "y"), (6, "x" * 9000, "z"), (None, "no id", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*d, 0, 1, "clash") for d in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, start int, shard int, sequence_id string")


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_against_search(lengths):
    lengths = sorted(lengths, reverse=True)
    room: list[int] = []
    where, offsets = packing.best_fit_decreasing(lengths, 64)
    for n, w, at in zip(lengths, where, offsets, strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[w] == min(fits) and at == 64 - room[w]
        else:
            assert w == len(room) and at == 0
            room.append(64)
        room[w] -= n


@given(st.text(st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    ids = packing.word_ids(PATH)
    assert ids.of(text) == ids.fresh(text)


def test_ids_of_every_letter():
    """Each letter alone, doubled and within a word, also those whose lower case is another number of characters."""
    ids = packing.word_ids(PATH)
    letters = [c for c in map(chr, range(0x20000)) if c.isalpha()]
    for made in ("{0}", "{0}{0}", "a{0}b", "{0}s,"):
        words = [made.format(c) for c in letters]
        fresh = ids.tokenizer.encode_batch(words, add_special_tokens=False)
        wrong = [w for w, f in zip(words, fresh, strict=True) if ids.of(w) != np.array(f.ids, "<u4").tobytes()]
        assert not wrong, wrong[:20]
    assert ids.of("\u0130stanbul") == ids.fresh("\u0130stanbul")


def test_repeated_rows_share_no_shard(spark):
    """Rows alike in everything are dealt over the shards."""
    rows = [(None, 0, 600, 7, 600)] * 4000
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), shards=8)
    shards = {r["sequence_id"] >> 32 for r in packed.select("sequence_id").distinct().collect()}
    assert packed.count() == 4000 and len(shards) == 8


def test_pieces(docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(PATH).encode
    rows = packing.pack_documents(docs, PATH).collect()
    want = {}
    for doc, text, _ in DOCS:
        want.setdefault(doc, []).append([*encode(text or "", add_special_tokens=False).ids, 1])
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
        ids = want[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(want[r["doc_id"]][0])
    assert {d: sum(r["length"] for r in x) for d, x in got.items()} == {d: sum(map(len, x)) for d, x in want.items()}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_padding_and_lengths(spark):
    rng = np.random.default_rng(0)
    rows = [(k, 0, int(n), 0, int(n)) for k, n in enumerate(rng.integers(1, 2048, 3000))]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), shards=2)
    sums = packing.sequence_lengths(packed).agg(F.sum("filled"), F.sum("padded")).first()
    assert sums[0] / sums[1] > 0.97
    one = packing.pack(spark.createDataFrame([(1, 0, 1024, 0, 1024), (2, 0, 2000, 0, 2000)], packing.PIECES))
    assert sorted((r["filled"], r["padded"]) for r in packing.sequence_lengths(one).collect()) == [(1024, 1024), (2000, 2048)]


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).count() == 0
    assert audio.audio_features(audio.encode_audio(none, "doc_id"), "doc_id").count() == 0


def test_audio_round_trip(docs):
    media = audio.encode_audio(docs, "doc_id", "lang")
    for r in media.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r["text"] or "").encode()
        data = audio.samples(bytes(r["media"])).tobytes()
        assert r["n_bytes"] == len(raw) and len(data) == max(64, -(-len(raw) // 64) * 64)
        assert data == raw + bytes(len(data) - len(raw)) and len(r["media"]) == len(data) + 44
    found = media.select("*", F.sha2(audio.payload(F.col("media")), 256).alias("sha")).where("doc_id = 5").collect()
    assert {r["sha"] for r in found} == {hashlib.sha256(b"a" + bytes(63)).hexdigest()}


def test_audio_features(docs):
    rows = audio.audio_features(audio.encode_audio(docs, "doc_id"), "doc_id").collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert len(r["tensors"]) == -(-r["n_frames"] // audio.FRAMES) and all(len(t["values"]) == audio.FRAMES * audio.BANDS for t in r["tensors"])
        spans = [(s["start_ms"], s["end_ms"]) for s in r["segments"]]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    twice = [r for r in rows if r["doc_id"] == 5]
    assert twice[0]["tensors"] == twice[1]["tensors"]


def test_equal_recordings_have_equal_features_whatever_is_beside_them():
    rng = np.random.default_rng(1)
    recordings = [rng.integers(0, 256, int(n)).astype(np.uint8) for n in rng.integers(1, 4000, 60)]

    def of(xs):
        columns = audio.features(xs)
        columns[3] = audio.plain(columns[3])
        return list(zip(*(c.to_pylist() for c in columns), strict=True))

    alone = [of([x])[0] for x in recordings]
    assert of(recordings) == alone and of(recordings[::-1])[::-1] == alone


def test_log_mel_against_the_formula():
    """Direct convolution, a plain DFT and loops over bands give the same frames, energies and segments."""
    rng = np.random.default_rng(3)
    data = (128 + 60 * np.sin(np.arange(3000) * 0.2) * (np.arange(3000) % 1500 < 700) + rng.integers(-20, 20, 3000)).astype(np.uint8)
    mel, energy, frames = audio.log_mel([data])
    x = (data.astype(float) - 128) / 128
    half = audio.UP * audio.TAPS // 2
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / 2) / 2 * np.hamming(len(k))
    wide = np.concatenate([np.zeros(half), x, np.zeros(2000)])
    low = np.array([sum(taps[j] * wide[2 * n + j] for j in range(len(k))) for n in range(-(-len(x) // 2) + 200)])
    assert frames.tolist() == [-(-len(x) // 128)]
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * np.log10(1 + 4000 / 700)
    edges = [hz(top * b / 17) for b in range(18)]
    for n in range(frames[0]):
        piece = low[64 * n : 64 * n + 128] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 127))
        power = np.array([abs(sum(piece * np.exp(-2j * np.pi * f * np.arange(128) / 128))) ** 2 for f in range(65)])
        assert energy[n] * audio.QUANTUM == pytest.approx(10 * np.log10(power.mean() + 1e-6), abs=0.02)
        for b in range(16):
            weights = [max(0, min((f * 62.5 - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - f * 62.5) / (edges[b + 2] - edges[b + 1]))) for f in range(65)]
            assert mel[n, b] * audio.QUANTUM == pytest.approx(np.log10(power @ weights + 1e-6), abs=0.02)
    level = energy * audio.QUANTUM
    want, on = [], False
    for n, e in enumerate(level):
        now = e >= level.mean() + 0.5 or (on and e >= level.mean() - 0.5)
        if now and not on:
            want.append([8.0 * n, 0])
        if now:
            want[-1][1] = 8.0 * (n + 1)
        on = now
    assert [[s["start_ms"], s["end_ms"]] for s in audio.features([data])[4][0].as_py()] == want and len(want) > 1


def test_tensors_are_stored(spark, docs, tmp_path):
    """Files hold Arrow's fixed-shape tensors with spans; what is read back is what was computed."""
    media = audio.encode_audio(docs, "doc_id", "lang")
    folder = f"file://{tmp_path}/tensors"
    manifest = audio.store_features(media, folder, "doc_id", "lang")
    files = sorted((tmp_path / "tensors").glob("*"))
    assert files and {str(f) for f in files} == {r["path"] for r in manifest.collect()} and all(f.suffix == ".arrow" for f in files)
    schema = pa.ipc.open_stream(files[0].read_bytes()).schema
    assert schema.field("tensors").type.value_type.field("values").type == audio.TENSOR
    back = audio.read_features(manifest, folder, media.select("doc_id", "lang"))
    key = lambda r: repr(r)
    assert sorted(back.collect(), key=key) == sorted(audio.audio_features(media, "doc_id", "lang").collect(), key=key)
    with pytest.raises(ValueError, match="media"):
        audio.encode_audio(docs.withColumn("Media", F.lit(1)), "doc_id", "Media")


def test_resampling_is_a_filter():
    x = np.sin(np.arange(1280) * 2 * np.pi * 500 / audio.RATE)
    y = audio.resample(x)
    want = np.sin(np.arange(640) * 2 * np.pi * 500 / (audio.RATE / 2))
    assert np.abs(y[40:-40] - want[40:-40]).max() < 0.02
    assert np.abs(audio.resample(np.sin(np.arange(1280) * 2 * np.pi * 7000 / audio.RATE))[40:-40]).max() < 0.05


def test_hysteresis_and_tensors():
    energy = np.array([0, 2, 1, 1, 0, 1, 2, 1])
    assert audio.hysteresis(energy, np.arange(8) == 0, 2, 1).tolist() == [False, True, True, True, False, False, True, True]
    held = audio.tensor_array(np.zeros((3, audio.FRAMES, audio.BANDS)))
    assert isinstance(held, pa.FixedShapeTensorArray) and held.to_numpy_ndarray().shape == (3, audio.FRAMES, audio.BANDS)
