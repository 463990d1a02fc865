"""Audio against independent computations, and streams against batch runs."""

import numpy as np

from voxspark.operators import audio
from voxspark.plans import registry


def test_mel_against_plain_dft():
    rnd = np.random.default_rng(1)
    a = (rnd.standard_normal(2000) * 0.1).astype(np.float32)
    got = audio.mel_frames(a)
    assert got.shape == (2000 // 160 + 1, 128)
    x = np.concatenate((a[:1], a[1:] - 0.97 * a[:-1])).astype(np.float64)
    x = np.concatenate((np.zeros(256), x, np.zeros(256)))
    window = np.zeros(512)
    window[56:456] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 399)
    k = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(512)) / 512)
    for f in (0, 5):
        power = np.abs(k @ (x[160 * f:160 * f + 512] * window)) ** 2
        assert np.allclose(got[f], np.log(audio._mel_filters().astype(np.float64) @ power + 2.0**-24), atol=2e-3)


def _chunks(*parts, rate=48_000):
    wave = np.concatenate([level * np.sin(2 * np.pi * 220 * np.arange(int(s * rate)) / rate) for level, s in parts]).astype(np.float32)
    step = int(0.128 * rate)
    return [wave[i:i + step] for i in range(0, len(wave), step)]


def _segments(*parts):
    s = audio.Segmenter(48_000)
    return [r for c in _chunks(*parts) for r in s.push(c)] + s.finish()


def test_segmenter_cases():
    assert len(_segments((0.15, 1.5), (0, 0.9))) == 1
    assert len(_segments(*[(0.15, 1.2), (0, 0.9)] * 3)) == 3
    assert _segments((0, 3)) == []
    assert len(_segments((0.15, 29.5))) == 2
    twenty = _segments((0.15, 20))
    assert len(twenty) == 2 and abs(sum(b - a for _, a, b, _ in twenty) / 48_000 - 20) < 0.2 and twenty[0][3]
    assert len(_segments((0.008, 1.5), (0, 0.9))) == 1  # a quiet microphone


def test_stream_equals_batch(spark, sf):
    q = registry.queries()
    batch = {(r.session_id, r.seg_idx, r.start_sample, r.end_sample, r.forced) for r in q["c06_segment_by_energy"](spark, sf).collect()}
    stream = {(r.session_id, r.seg_idx, r.start_sample, r.end_sample, r.forced) for r in q["g01_stream_segments"](spark, sf).where("kind = 'segment'").collect()}
    assert batch == stream and batch
    joined = {r.session_id: r.text for r in q["b03_join_segments"](spark, sf).collect()}
    assert {r.session_id: r.text for r in q["g03_partial_transcripts"](spark, sf).collect()} == joined
