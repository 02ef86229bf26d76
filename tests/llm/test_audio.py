import hashlib
import zlib

import numpy as np

from graftline.llm import audio


def test_payload_and_wav():
    for t, n in [(None, 576), ("", 576), ("é" * 288, 576), ("a" * 577, 1152)]:
        p = audio.payload(t)
        assert len(p) == n and p.startswith((t or "").encode()) and set(p[len((t or "").encode()) :]) <= {255}
        assert audio.from_wav(audio.to_wav(p)) == (16000, p)
    assert audio.from_wav(audio.to_wav(b"abc", 8000)) == (8000, b"abc")


def test_resample_keeps_a_tone():
    t = np.arange(16000) / 16000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 16000, 12000)
    assert len(y) == 12000
    spectrum = np.abs(np.fft.rfft(y))
    assert spectrum.argmax() == 440
    direct = np.sin(2 * np.pi * 440 * np.arange(12000) / 12000)
    lag = np.argmax([np.dot(y[100:-100], np.roll(direct, k)[100:-100]) for k in range(-12, 13)]) - 12
    assert np.dot(y[100:-100], np.roll(direct, lag)[100:-100]) > 0.95 * np.dot(direct[100:-100], direct[100:-100])
    high = audio.resample(np.sin(2 * np.pi * 7500 * t).astype(np.float32), 16000, 12000)
    assert np.abs(high[100:-100]).max() < 0.1


def test_segments_have_hysteresis():
    p = audio.AudioFeatures(open_db=3, close_db=1)
    e = np.array([0, 0, 0, 4, 2, 2, 0, 2, 4, 0, 0, 0], float)
    assert audio.segments(e, p) == [(3, 6), (8, 9)]


def naive_mel(samples, rate, p):
    """Log-mel energies by their definitions: a sum over taps for each output sample, and over samples for each frequency."""
    up, down = p.target // np.gcd(p.target, rate), rate // np.gcd(p.target, rate)
    x = (np.asarray(samples, float) - 128) / 128
    n = up * p.taps
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / up, 1 / down)
    h = cut * np.sinc(cut * t) * np.kaiser(n, 8.0)
    h *= up / h.sum()
    y = list(x) if up == down else []
    for m in range(-(-len(x) * up // down) if up != down else 0):
        centre, phase = divmod(m * down, up)
        y.append(sum(h[phase + up * k] * x[centre + p.taps // 2 - k] for k in range(p.taps) if 0 <= centre + p.taps // 2 - k < len(x)))
    count = 1 + max(0, -(-(len(y) - p.window) // p.hop))
    y = np.concatenate([y, np.zeros(max(0, (count - 1) * p.hop + p.window - len(y)))])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(p.target / 2), p.mels + 2) / 2595) - 1)
    out, energy = np.zeros((count, p.mels)), np.zeros(count)
    k = np.arange(p.window)
    for i in range(count):
        frame = y[i * p.hop : i * p.hop + p.window] * np.hanning(p.window)
        energy[i] = 10 * np.log10((frame**2).mean() + 1e-9)
        for b in range(p.fft // 2 + 1):
            f = b * p.target / p.fft
            power = abs((frame * np.exp(-2j * np.pi * b * k / p.fft)).sum()) ** 2
            for j in range(p.mels):
                lo, mid, hi = edges[j : j + 3]
                out[i, j] += power * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
    return np.log(out + 1e-6), energy


def naive_segments(energy, p):
    on, out, mid = False, [], np.median(energy)
    for k, e in enumerate([*energy, -np.inf]):
        if not on and e >= mid + p.open_db:
            on = True
            out.append([k, None])
        elif on and e < mid + p.close_db:
            on = False
            out[-1][1] = k
    return [tuple(x) for x in out]


def test_against_definitions():
    rng = np.random.default_rng(3)
    small = audio.AudioFeatures(window=60, hop=24, fft=64, mels=6, frames=8)
    for n in (1, 40, 79, 80, 81, 700):
        for rate in (16_000, 12_000, 8_000):
            samples = (128 + 60 * np.sin(np.arange(n) / rng.integers(2, 9)) + rng.integers(-40, 40, n)).astype(np.uint8)
            want, loud = naive_mel(samples, rate, small)
            for block in (1, 3, 1024):
                mel, energy = audio.log_mel(samples, rate, small, block)
                assert mel.dtype == np.float16 and np.allclose(mel, want, atol=0.02) and np.allclose(energy, loud, atol=1e-3)
    for _ in range(200):
        e = rng.normal(0, 2, rng.integers(1, 30))
        assert audio.segments(e, small) == naive_segments(e, small)


def test_features(spark):
    texts = [(1, "Hello there " * 300), (2, None), (3, ""), (4, "Hello there " * 300), (None, "é"), (1, "z" * 300_000)]
    docs = spark.createDataFrame([(a, b, 0, 0) for a, b in texts], "doc_id long, text string, media int, n_bytes int").repartition(2)
    stored = audio.features(audio.media_table(docs))
    got, sums = ({(r.doc_id, r.n_bytes): r for r in x.collect()} for x in (stored, audio.summary(stored)))
    assert len(got) == len(sums) == 6
    p = audio.AudioFeatures()
    for d, t in texts:
        r, s = got[d, len((t or "").encode())], sums[d, len((t or "").encode())]
        raw = audio.payload(t)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert r.media_bytes == len(raw) + 44 and r.media_sha256 == hashlib.sha256(audio.to_wav(raw)).hexdigest()
        batch = audio.from_arrow(bytes(r.tensors))
        kind, tensors = batch.schema.field("tensor").type, batch.column(3).to_numpy_ndarray()
        assert kind.extension_name == "arrow.fixed_shape_tensor" and list(kind.shape) == [64, 32] and tensors.shape[1:] == (64, 32)
        mel, energy = audio.log_mel(np.frombuffer(raw, np.uint8), 16_000, p)
        frames = tensors.reshape(-1, 32)
        assert len(mel) == r.n_frames == sum(batch.column(2).to_pylist()) and (frames[: len(mel)] == mel).all() and not frames[len(mel) :].any()
        assert (len(tensors), s.n_tensors) == (-(-len(mel) // 64),) * 2 and np.allclose(s.mel_mean, mel.mean(axis=0, dtype=float))
        assert batch.column(0).to_pylist() == [i * 640.0 for i in range(len(tensors))] and batch.column(1)[-1].as_py() >= 1000 * len(raw) / 16_000 - 1
        assert [(x.start_ms, x.end_ms) for x in r.segments] == [(a * 10.0, (b - 1) * 10.0 + 25.0) for a, b in audio.segments(energy, p)]
    assert got[1, 3600][2:] == got[4, 3600][2:]
    rows = audio.tensor_rows(stored).filter("doc_id = 4").collect()
    assert len(rows) == 1 and len(rows[0]["values"]) == 2048 and rows[0].valid == got[4, 3600].n_frames
    empty = audio.features(audio.media_table(docs.limit(0)))
    assert empty.collect() == [] and audio.summary(empty).collect() == []
