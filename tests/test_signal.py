"""Signal operators against plain NumPy and against the registered SQL."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from wavespark.config import ChromaConfig, MelConfig, StftConfig, Window
from wavespark.functions import columns as C
from wavespark.jobs.queries import ORACLE_SQL, QUERIES
from wavespark.operators import frames as O
from wavespark.operators import transforms as X

SF = "/root/testdata/sf0.001"


def noise(n, seed=20250803):
    out, s = np.empty(n), seed
    for i in range(n):
        s = (1103515245 * s + 12345) % 2**31
        out[i] = s / 2**30 - 1
    return out


def clips(spark, *signals):
    rows = [(i, 0, 22050, len(x), [float(v) for v in x]) for i, x in enumerate(signals)]
    return spark.createDataFrame(rows, "clip_id bigint, channel int, sample_rate int, n bigint, samples array<double>")


def framed(x, cfg):
    modes = {"reflect": "reflect", "zero": "constant", "edge": "edge"}
    p = np.pad(x, (cfg.left, cfg.right), mode=modes[cfg.pad])
    return np.lib.stride_tricks.sliding_window_view(p, cfg.fft)[:: cfg.hop]


def rows_of(df, *arrays):
    rows = sorted(df.collect(), key=lambda r: (r.clip_id, r.frame))
    return [np.array([r[a] for r in rows]) for a in arrays]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want


def test_decibels_of_odd_values(spark, tmp_path):
    con = duckdb.connect()
    odd = "0.0, -3.5, NULL, 'nan'::DOUBLE, 'inf'::DOUBLE, '-inf'::DOUBLE, 1e-7, 5e-7, 1e-11, 1e300, 1.0000005, 2.5000005"
    con.execute(f"""create table events as select row_number() over () as event_id, value from (
      select unnest([{odd}])::DOUBLE as value union all select ((i * 7919 * 104729) % 5000000000 + 0.5) / 1e6 from range(0, 30000) t(i) union all select i / 1e7 from range(0, 30000) t(i))""")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = QUERIES["decibels"](spark, str(tmp_path))
    want = sorted(map(repr, con.execute(ORACLE_SQL["decibels"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_decibels_of_signed_zeros_and_extremes(spark, tmp_path):
    """Bit for bit: negative zeros, values that overflow when scaled, and frequencies that underflow."""
    con = duckdb.connect()
    odd = "-0.0, 0.0, -1e-9, -4e-7, -5e-7, 1 - 1e-9, 1 + 1e-9, 1e303, -1e303, 1.7e308, 5e-324, -5e-324, 1e-310, 4503599627.370497"
    con.execute(f"create table events as select row_number() over () as event_id, value from (select unnest([{odd}])::DOUBLE as value)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = QUERIES["decibels"](spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, con.execute(ORACLE_SQL["decibels"]).fetchall()))


@pytest.mark.parametrize("pad", ["reflect", "zero", "edge"])
@pytest.mark.parametrize("tile", [1, 7, 4096])
def test_stft_does_not_depend_on_tiles(spark, pad, tile):
    cfg = StftConfig(fft=16, hop=5, pad=pad, window=Window("hamming"))
    x = noise(150)
    re, im = rows_of(X.stft(clips(spark, x), cfg, tile), "re", "im")
    want = np.fft.rfft(framed(x, cfg) * cfg.weights(), axis=1)
    assert np.allclose(re + 1j * im, want, atol=1e-12)


def test_range_is_the_full_transform_cut(spark):
    cfg, x = StftConfig(fft=16, hop=4), noise(200)
    full = {r.frame: r.re for r in X.stft(clips(spark, x), cfg, 8).collect()}
    part = {r.frame: r.re for r in X.stft_range(clips(spark, x), cfg, 5, 21, 8).collect()}
    assert part == {f: full[f] for f in range(5, 21)}


def test_short_and_empty_clips(spark):
    cfg = StftConfig(fft=16, hop=4)
    got = X.power_spectrum(clips(spark, [], [2.0], noise(3)), cfg)
    counts = {r["clip_id"]: r["count"] for r in got.groupBy("clip_id").count().collect()}
    assert counts == {1: 1, 2: 1}
    assert np.allclose(rows_of(got.where("clip_id = 1"), "s")[0][0], np.abs(np.fft.rfft(np.full(16, 2.0) * cfg.weights())) ** 2)


def test_inverse(spark):
    cfg, x, y = StftConfig(fft=32, hop=8), noise(301), noise(40, 7)
    c = clips(spark, x, y)
    got = {r.clip_id: np.array(r.samples) for r in X.istft(X.stft(c, cfg, 10), c, cfg).collect()}
    assert np.allclose(got[0], x, atol=1e-12) and np.allclose(got[1], y, atol=1e-12)


def test_separation_adds_up(spark):
    cfg, x = StftConfig(fft=32, hop=8), noise(400)
    c = clips(spark, x)
    h, p = (np.array(d.first().samples) for d in X.hpss(c, cfg, kernel=(5, 7)))
    assert np.allclose(h + p, x, atol=1e-10)
    masks = X.hpss_masks(X.power_spectrum(c, cfg, 1.0), kernel=(4, 6), margin=(1.0, 2.0))
    a, b = rows_of(masks, "harmonic", "percussive")
    assert (a >= 0).all() and (a <= 1).all() and (b <= 1).all()


def test_median_in_columns_equals_helper(spark):
    s = np.abs(noise(60)).reshape(6, 10)
    df = spark.createDataFrame([(0, 0, i, [float(v) for v in r]) for i, r in enumerate(s)], "clip_id bigint, channel int, frame bigint, s array<double>")
    for k in (3, 4, 5):
        assert np.allclose(rows_of(X.median_time(df, k), "s")[0], X._median_filter(s, k, 0))
        assert np.allclose(rows_of(df.withColumn("s", C.median_freq("s", k)), "s")[0], X._median_filter(s, k, 1))


def test_stretch_and_resample_lengths(spark):
    cfg, x = StftConfig(fft=32, hop=8), noise(500)
    assert X.time_stretch(clips(spark, x), cfg, Fraction(3, 2)).first().n == round(500 * 2 / 3)
    t = np.arange(4000)
    sine = np.sin(2 * np.pi * t / 50)
    for block in (65536, 333):
        got = np.array(X.resample(clips(spark, sine), 3, 2, "fast", block).first().samples)
        assert len(got) == -(-4000 * 2 // 3)
        inner = slice(200, -200)
        assert np.abs(got - np.sin(2 * np.pi * np.arange(len(got)) * 1.5 / 50))[inner].max() < 1e-4


def test_griffin_lim_descends(spark):
    cfg, c = StftConfig(fft=32, hop=8), clips(spark, noise(400))
    s = X.power_spectrum(c, cfg, 1.0)
    gaps = [X.spectral_convergence(X.power_spectrum(X.istft(X.griffin_lim(s, cfg, n), c, cfg), cfg, 1.0), s).first().convergence for n in (1, 20)]
    assert gaps[1] < gaps[0]


def test_blocks_and_seek(spark):
    x = noise(1000)
    blocks = O.to_blocks(clips(spark, x, []), 64)
    got = sorted(O.seek(blocks, 100, 300).collect(), key=lambda r: r.start)
    assert np.allclose(np.concatenate([r.samples for r in got]), x[100:400])


def test_parameters_are_checked():
    for bad in (lambda: Window("no"), lambda: Window("kaiser"), lambda: StftConfig(fft=0), lambda: StftConfig(pad="no"), lambda: MelConfig(f_max=20000).weights(64), lambda: MelConfig(n_mels=400).weights(64)):
        with pytest.raises(ValueError):
            bad()
    assert np.allclose(Window("hann").values(8), np.hanning(9)[:8])
    assert np.allclose(Window("kaiser", 8.6).values(9, False), np.kaiser(9, 8.6))
    assert np.allclose(Window("tukey", 1.0).values(9, False), np.hanning(9))
    assert ChromaConfig().weights(64).shape == (12, 33)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_a_null_key_is_a_clip_of_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(None, 2, 3.0), (None, 1, 4.0), (5, 1, 6.0)], "k bigint, at bigint, x double")
    got = {r.clip_id: r.samples for r in O.blocks_from_table(rows, "k", ["at"], "x", f"{tmp_path}/rows").collect()}
    assert got == {None: [4.0, 3.0], 5: [6.0]}
