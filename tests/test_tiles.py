"""Separation, medians and phase reconstruction in tiles against the same over a whole clip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.config import StftConfig
from wavespark.functions import columns as C
from wavespark.operators import transforms as X

SCHEMA = "clip_id bigint, channel int, sample_rate int, n bigint, samples array<double>"


def clips_of(spark, *sizes, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, 0, 8000, n, rng.normal(size=n).tolist()) for i, n in enumerate(sizes)], SCHEMA)


def by_clip(rows, *columns):
    out = {}
    for r in rows.collect():
        out.setdefault(r.clip_id, {})[r.frame] = [r[c] for c in columns]
    for k, frames in out.items():
        assert sorted(frames) == list(range(len(frames)))
        out[k] = [np.array([frames[f][i] for f in range(len(frames))]) for i in range(len(columns))]
    return out


@pytest.mark.parametrize("kernel", [(31, 5), (4, 7), (1, 1)])
@pytest.mark.parametrize("per", [5, 16, 1000])
def test_masks_in_tiles(spark, kernel, per):
    s = X.power_spectrum(clips_of(spark, 700, 33, 7), StftConfig(fft=32, hop=4), 1.0)
    got, median = by_clip(X.hpss_masks(s, kernel, margin=(1.0, 2.0), frames_per_tile=per), "harmonic", "percussive"), by_clip(X.median_time(s, kernel[0], per), "s")
    own = by_clip(s, "s")
    assert set(got) == set(median) == set(own) == {0, 1, 2}
    for k, (x,) in own.items():
        pad = np.pad(x, ((kernel[0] // 2, kernel[0]), (0, 0)), "symmetric")
        h = np.array([np.sort(pad[f : f + kernel[0]], axis=0)[kernel[0] // 2] for f in range(len(x))])
        pad = np.pad(x, ((0, 0), (kernel[1] // 2, kernel[1])), "symmetric")
        p = np.array([np.sort(pad[:, b : b + kernel[1]], axis=1)[:, kernel[1] // 2] for b in range(x.shape[1])]).T
        assert np.array_equal(median[k][0], h)
        assert np.allclose(got[k][0], h**2 / (h**2 + p**2)) and np.allclose(got[k][1], p**2 / (p**2 + (2 * h) ** 2))


def test_parts_of_a_transform(spark):
    cfg, clips = StftConfig(fft=32, hop=8), clips_of(spark, 500, 60, 0)
    parts = {(r.clip_id, r.part): np.array(r.samples) for r in X.hpss_parts(clips, cfg, kernel=(5, 7), frames_per_tile=9).collect()}
    assert set(parts) == {(k, p) for k in range(3) for p in ("harmonic", "percussive")}
    for r in clips.collect():
        assert np.allclose(parts[r.clip_id, "harmonic"] + parts[r.clip_id, "percussive"], r.samples, atol=1e-10)
    for name, of in zip(("harmonic", "percussive"), X.hpss(clips, cfg, kernel=(5, 7)), strict=True):
        assert all(np.allclose(parts[r.clip_id, name], r.samples) for r in of.collect())
    z = X.stft(clips, cfg)
    rows = X.hpss_of_stft(z, (5, 7)).where("part = 'harmonic'").withColumn("m", C.magnitude("re", "im"))
    want = by_clip(X.hpss_of_spectrogram(z.select("clip_id", "channel", "frame", C.magnitude("re", "im").alias("s")), (5, 7)), "harmonic")
    assert all(np.allclose(m[0], want[k][0]) for k, m in by_clip(rows, "m").items())


def whole_clip(s, cfg, iterations, momentum, phase):
    """Signal by plain overlap-add at the frames' length, padded by numpy, transformed frame by frame."""
    w, n = cfg.weights(), (len(s) - 1) * cfg.hop + cfg.fft - cfg.left - cfg.right
    z, before, beta = s * np.exp(1j * phase), np.zeros(s.shape, complex), momentum / (1 + momentum)
    for _ in range(iterations if n > 0 else 0):
        y, q = np.zeros((len(s) - 1) * cfg.hop + cfg.fft), np.zeros((len(s) - 1) * cfg.hop + cfg.fft)
        for f, row in enumerate(z):
            at = slice(f * cfg.hop, f * cfg.hop + cfg.fft)
            y[at] += np.fft.irfft(row, cfg.fft) * w
            q[at] += w * w
        y = (y / np.where(q == 0, 1, q))[cfg.left : cfg.left + n]
        mode = {"zero": "constant", "reflect": "reflect", "edge": "edge"}[cfg.pad]
        y = np.pad(y, (cfg.left, cfg.right), mode)
        c = np.array([np.fft.rfft(y[f * cfg.hop : f * cfg.hop + cfg.fft] * w) for f in range(len(s))])
        moved = c - beta * before
        before = c
        z = s * np.where(np.abs(moved) > 0, moved / np.abs(moved), 1)
    return z


@pytest.mark.parametrize("options", [{}, {"pad": "edge"}, {"pad": "zero"}, {"alignment": "left"}, {"alignment": "right", "pad": "zero"}, {"fft": 15, "hop": 4}])
def test_griffin_lim_in_tiles(spark, options):
    cfg, rng = StftConfig(**({"fft": 16, "hop": 5} | options)), np.random.default_rng(2)
    clips = clips_of(spark, 400, 90, 21)
    s = X.power_spectrum(clips, cfg, 1.0)
    own = by_clip(s, "s")
    for init in (False, True):
        phase = {k: rng.uniform(-3, 3, x.shape) if init else np.zeros(x.shape) for k, (x,) in own.items()}
        rows = spark.createDataFrame([(k, 0, f, v.tolist(), phase[k][f].tolist()) for k, (x,) in own.items() for f, v in enumerate(x)], "clip_id bigint, channel int, frame bigint, s array<double>, phase array<double>")
        for per, together in ((6, 2), (1000, 5)):
            got = by_clip(X.griffin_lim(rows, cfg, 5, 0.9, "phase" if init else None, per, together), "re", "im")
            for k, (x,) in own.items():
                want = whole_clip(x, cfg, 5, 0.9, phase[k])
                assert np.allclose(got[k][0] + 1j * got[k][1], want, atol=1e-6), (options, init, per, k)


def test_griffin_lim_without_a_signal(spark):
    """A single centered frame covers no sample: the first phases come back, whatever is iterated."""
    row = [0.5 * i for i in range(9)]
    s = spark.createDataFrame([(1, 0, 0, row, [0.0] * 9)], "clip_id bigint, channel int, frame bigint, s array<double>, phase array<double>")
    got = X.griffin_lim(s, StftConfig(fft=16, hop=4), 3, init="phase").first()
    assert got.re == row and got.im == [0.0] * 9
    assert X.griffin_lim(s.where(F.lit(False)), StftConfig(fft=16, hop=4), 3).count() == 0
