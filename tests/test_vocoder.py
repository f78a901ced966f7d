"""The phase vocoder in tiles against one traversal of the whole clip, with free and with locked phases."""

from fractions import Fraction

import numpy as np
import pytest

from wavespark.config import StftConfig
from wavespark.operators import transforms as X

CFG = StftConfig(fft=32, hop=8)


def traversal(z, cfg, num, den, locked):
    """Frame by frame: each bin's phase goes on by its own frequency; bins of a peak's region keep their distance to it."""
    frames, bins = z.shape
    z = np.concatenate([z, np.zeros((2, bins))])
    size, angle = np.abs(z), np.angle(z)
    omega, phase, out = 2 * np.pi * np.arange(bins) * cfg.hop / cfg.fft, np.angle(z[0]).copy(), []
    for i in range(-(-frames * den // num)):
        f, part = i * num // den, i * num % den / den
        if locked:
            peaks = [k for k in range(bins) if all(size[f, k] > size[f, j] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < bins)]
            for k in range(bins) if peaks else ():
                near = min(peaks, key=lambda q: (abs(q - k), -q))
                if k not in peaks:
                    phase[k] = phase[near] + angle[f, k] - angle[f, near]
        out.append(((1 - part) * size[f] + part * size[f + 1]) * np.exp(1j * phase))
        turn = angle[f + 1] - angle[f] - omega
        phase = phase + omega + turn - 2 * np.pi * np.rint(turn / (2 * np.pi))
    return np.array(out)


@pytest.mark.parametrize("locked", [False, True])
@pytest.mark.parametrize("rate", [(1, 1), (4, 3), (3, 7), (5, 1)])
def test_tiles_equal_one_traversal(spark, locked, rate):
    rng = np.random.default_rng(sum(rate))
    t = np.arange(900)
    rows = [(1, 0, np.sin(0.3 * t) + 0.5 * np.sin(0.9 * t + 1) + 0.01 * rng.normal(size=900)), (1, 1, rng.normal(size=130)), (2, 0, np.zeros(40)), (3, 0, rng.normal(size=3))]
    clips = spark.createDataFrame([(k, c, 8000, len(x), x.tolist()) for k, c, x in rows], "clip_id bigint, channel int, sample_rate int, n bigint, samples array<double>")
    z = X.stft(clips, CFG)
    got = {}
    for r in X.phase_vocoder(z, CFG, Fraction(*rate), locked, frames_per_tile=7).collect():
        got.setdefault((r.clip_id, r.channel), {})[r.frame] = np.array(r.re) + 1j * np.array(r.im)
    own = {}
    for r in z.collect():
        own.setdefault((r.clip_id, r.channel), {})[r.frame] = np.array(r.re) + 1j * np.array(r.im)
    assert set(got) == set(own)
    for key, frames in own.items():
        want = traversal(np.array([frames[f] for f in sorted(frames)]), CFG, *rate, locked)
        assert sorted(got[key]) == list(range(len(want)))
        assert np.allclose(np.array([got[key][f] for f in range(len(want))]), want, atol=1e-7)


def test_regions_part_halfway():
    assert X.regions(np.array([1.0, 5, 1, 0, 0, 1, 9, 1])).tolist() == [1, 1, 1, 1, 6, 6, 6, 6]
    assert X.regions(np.ones(5)).tolist() == [0, 1, 2, 3, 4]


def test_a_locked_stretch_keeps_a_tone(spark):
    """A tone that the bins of two frames share stays one tone of its frequency and twice its length."""
    t = np.arange(4000)
    clips = spark.createDataFrame([(1, 0, 8000, 4000, np.sin(2 * np.pi * 0.11 * t).tolist())], "clip_id bigint, channel int, sample_rate int, n bigint, samples array<double>")
    y = np.array(X.time_stretch(clips, StftConfig(fft=256, hop=64), Fraction(1, 2), locked=True).first().samples)
    assert len(y) == 8000
    spectrum = np.abs(np.fft.rfft(y[1000:7000] * np.hanning(6000)))
    assert abs(np.argmax(spectrum) / 6000 - 0.11) < 2e-4 and 0.8 < np.sqrt((y[1000:7000] ** 2).mean() * 2) < 1.2
