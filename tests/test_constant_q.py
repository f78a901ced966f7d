"""Constant-Q transforms: tiles, octaves, folds and parameters (values at the full rate are held against SQL in test_signal)."""

import numpy as np
import pytest

from wavespark.config import CqtConfig
from wavespark.operators import constant_q as Q
from wavespark.operators import frames as O

from test_signal import clips, noise, rows_of

CFG = CqtConfig(n_bins=12, bins_per_octave=4, fmin=1000.0, hop=8)


@pytest.mark.parametrize("pad", ["zero", "reflect", "edge"])
def test_values_do_not_depend_on_tiles(spark, pad):
    cfg = CqtConfig(n_bins=12, bins_per_octave=4, fmin=1000.0, hop=8, pad=pad)
    assert [o.level for o in cfg.octaves()] == [0, 1, 2]
    c = clips(spark, noise(3001), noise(700, 5), [1.0], [])
    whole = rows_of(Q.cqt(c, cfg, 4096), "re", "im")
    for tile in (1, 50):
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(rows_of(Q.cqt(c, cfg, tile), "re", "im"), whole, strict=True))
    counts = {r.clip_id: r["count"] for r in Q.cqt(c, cfg).groupBy("clip_id").count().collect()}
    assert counts == {0: 1 + 3001 // 8, 1: 1 + 700 // 8, 2: 1}


def test_halved_octaves_read_what_the_full_rate_reads(spark):
    t = np.arange(6000)
    signals = [np.sin(2 * np.pi * f * t / 22050) for f in (1000.0, 2000.0, 4000.0)]
    got = {r.clip_id: np.array(r.s) for r in Q.cqt_power(clips(spark, *signals), CqtConfig(n_bins=12, bins_per_octave=4, fmin=1000.0, hop=8, scale=False), 1.0).where("frame = 375").collect()}
    odd = {r.clip_id: np.array(r.s) for r in Q.cqt_power(clips(spark, *signals), CqtConfig(n_bins=12, bins_per_octave=4, fmin=1000.0, hop=3, scale=False), 1.0).where("frame = 1000").collect()}
    for i, peak in enumerate((0, 4, 8)):
        assert got[i].argmax() == odd[i].argmax() == peak
        assert abs(got[i][peak] / odd[i][peak] - 1) < 0.05


def test_early_halving_keeps_magnitudes(spark):
    x = np.sin(2 * np.pi * 500 * np.arange(8000) / 22050)
    for scale in (True, False):
        early, late = (CqtConfig(n_bins=4, bins_per_octave=4, fmin=500.0, hop=h, scale=scale) for h in (16, 15))
        assert early.early > 0 and late.early == 0
        a, b = (np.array(Q.cqt_power(clips(spark, x), c, 1.0).where(f"frame = {4080 // c.hop}").first().s) for c in (early, late))
        assert abs(a[0] / b[0] - 1) < 0.05


def test_fold(spark):
    c = clips(spark, noise(900))
    for norm in (None, 2.0, "none"):
        fused = rows_of(Q.chroma_cqt(c, CFG, 4, norm), "s")[0]
        apart = rows_of(Q.chroma_of_cqt(Q.cqt_power(c, CFG, 1.0), CFG, 4, norm), "s")[0]
        assert np.allclose(fused, apart)
    assert (CFG.chroma_weights(4).sum(axis=0) == 1).all() and CqtConfig().chroma_weights()[0, 0] == 1


def test_ladder_and_parameters():
    cfg = CqtConfig()
    assert np.allclose(cfg.frequencies(), 32.70319566257483 * 2 ** (np.arange(84) / 12))
    assert np.allclose(cfg.filter_lengths() * cfg.frequencies(), cfg.filter_lengths()[0] * cfg.frequencies()[0])
    assert (CqtConfig(gamma="erb").filter_lengths() < cfg.filter_lengths()).all()
    for bad in (dict(n_bins=0), dict(fmin=-1.0), dict(n_bins=120), dict(gamma="no"), dict(gamma=-1.0), dict(pad="no"), dict(hop=0)):
        with pytest.raises(ValueError):
            CqtConfig(**bad)
    with pytest.raises(ValueError):
        cfg.chroma_weights(5)


def test_characters_are_read_once(spark):
    """Texts become samples in one pass, not once for each expression that needs their length."""
    docs = spark.createDataFrame([(0, "a\u00e9\u4e2d\U0001f600b"), (1, None), (2, ""), (3, "x\u0000y"), (4, "z" * 3000)], "doc_id bigint, text string")
    signals = O.code_point_signals(docs, "doc_id", "text")
    got = {r.clip_id: (r.n, r.samples) for r in signals.collect()}
    assert got == {0: (5, [97.0, 233.0, 20013.0, 128512.0, 98.0]), 1: (0, []), 2: (0, []), 3: (2, [120.0, 121.0]), 4: (3000, [122.0] * 3000)}
    plan = Q.cqt_power(signals, CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("MapInArrow") == 2
