"""Streamed transforms: kernels over any chunking, streams against batch results, and lost, late and repeated chunks."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.config import ChromaConfig, CqtConfig, MelConfig, StftConfig
from wavespark.functions import columns as C
from wavespark.operators import constant_q as Q
from wavespark.operators import frames as O
from wavespark.operators import transforms as X
from wavespark.streaming import frames as S
from wavespark.streaming import kernels as K
from wavespark.streaming import ordered as R

RATE = 22050
MEL = MelConfig(sample_rate=RATE, n_mels=4)
CONFIGS = [StftConfig(fft=16, hop=4), StftConfig(fft=16, hop=5, alignment="left"), StftConfig(fft=16, hop=3, alignment="right", pad="zero"), StftConfig(fft=9, hop=11, pad="edge")]
CQTS = [CqtConfig(n_bins=12, bins_per_octave=4, fmin=1000.0, sample_rate=RATE, hop=8), CqtConfig(n_bins=8, bins_per_octave=4, fmin=2000.0, sample_rate=RATE, hop=5, pad="reflect")]


def through(kernel, parts):
    """A kernel's rows, its state written and read between chunks."""
    kernel.load(*kernel.fresh())
    out = []
    for x in parts:
        out += kernel.step(x)
        numbers, values = kernel.dump()
        kernel.load([int(n) for n in numbers], np.frombuffer(np.ascontiguousarray(values, float).tobytes(), float))
    return out + kernel.flush()


def same(a, b):
    assert [r[0] for r in a] == [r[0] for r in b]
    assert all(np.allclose(x, y, atol=1e-12) for r, q in zip(a, b, strict=True) for x, y in zip(r[1:], q[1:], strict=True))


def joined(rows):
    assert [r[0] for r in rows] == np.cumsum([0, *(len(r[1]) for r in rows)])[:-1].tolist()
    return np.concatenate([r[1] for r in rows] or [np.zeros(0)])


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40, 900])
def test_any_chunking_gives_the_same_rows(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    cuts = [np.sort(rng.integers(0, n + 1, 6)), np.arange(1, n)]
    for cfg in CONFIGS:
        frames = K.FrameKernel(cfg, "x array<double>", lambda f: (f,))
        whole = through(frames, [x])
        z = [np.concatenate([r[1], -r[1]])[: 2 * cfg.bins] for r in whole]
        for at in cuts:
            same(through(frames, np.split(x, at)), whole)
            for lag in (1, 3):
                same(through(K.OnsetKernel(cfg, MEL, lag), np.split(x, at)), through(K.OnsetKernel(cfg, MEL, lag), [x])) if cfg.fft == 16 else None
            if cfg.hop <= cfg.fft and z:
                parts = [np.concatenate(p) for p in np.array_split(np.array(z), min(len(z), 3))]
                got = joined(through(K.InverseKernel(cfg), z))
                assert np.allclose(got, joined(through(K.InverseKernel(cfg), [p.ravel() for p in parts])))
                assert len(got) == max(0, (len(z) - 1) * cfg.hop + cfg.fft - cfg.left - cfg.right)
    for rates in ((3, 2), (2, 3), (44100, 16000)):
        kernel = K.ResampleKernel(*rates, "fast")
        whole = joined(through(kernel, [x]))
        assert len(whole) == -(-n * kernel.up // kernel.down)
        for at in cuts:
            assert np.allclose(joined(through(kernel, np.split(x, at))), whole, atol=1e-12)
    for cfg in CQTS:
        kernel = K.CqtKernel(cfg, "re array<double>, im array<double>", lambda z: (z.real, z.imag))
        for at in cuts:
            same(through(kernel, np.split(x, at)), through(kernel, [x]))


def clips_of(spark, rows):
    return spark.createDataFrame([(k, c, RATE, len(x), x) for k, c, x in rows], "clip_id bigint, channel int, sample_rate int, n bigint, samples array<double>")


def streamed(spark, folder, files, schema, of):
    """What of(stream) gives, one file a batch, in their order."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    for i in range(len(files)):  # the source reads files by their time
        for p in sorted(folder.glob(f"in/{i}/part-*")):
            p.rename(folder / f"in/{i}.parquet")
            os.utime(folder / f"in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    out = of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*.parquet"))
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out"), query


CHUNKS = "clip_id bigint, channel int, seq bigint, samples array<double>, last boolean"


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, k % 2, rng.normal(size=n).tolist()) for k, n in ((1, 2), (2, 60), (3, 17))]
    clips, cfg = clips_of(spark, rows), StftConfig(fft=16, hop=4)
    parts = [(k, c, s, x[s * 7 : s * 7 + 7], (s + 1) * 7 >= len(x)) for k, c, x in rows for s in range(-(-len(x) // 7))]
    rng.shuffle(parts)
    files = [[tuple(p) for p in parts[i::2]] for i in range(2)]
    files = [[(int(k), int(c), int(s), list(x), bool(e)) for k, c, s, x, e in f] for f in files]
    keyed = lambda df, *columns: {(r.clip_id, r.channel, r[columns[0]]): [np.array(r[c]) for c in columns[1:]] for r in df.collect()}

    def close(got, want):
        assert set(got) == set(want) and all(np.allclose(a, b, atol=1e-9) for k in want for a, b in zip(got[k], want[k], strict=True))

    mel_db = X.mel_spectrogram(clips, cfg, MEL).withColumn("s", F.transform("s", lambda x: C.power_to_db(x)))
    chroma = ChromaConfig(sample_rate=RATE)
    cases = [
        (lambda c: S.stream_onset(c, cfg, MEL, 2), O.onset_strength(mel_db, cfg, 2), ("frame", "onset")),
        (lambda c: S.stream_cqt(c, CQTS[0]), Q.cqt(clips, CQTS[0]), ("frame", "re", "im")),
        (lambda c: S.stream_chroma(c, cfg, chroma), X.chroma_stft(clips, cfg, chroma), ("frame", "s")),
        (lambda c: O.spectral_shape(S.stream_power(c, cfg, 1.0), cfg.frequencies(RATE)), O.spectral_shape(X.power_spectrum(clips, cfg, 1.0), cfg.frequencies(RATE)), ("frame", "centroid", "rolloff")),
    ]
    for i, (of, want, columns) in enumerate(cases):
        close(keyed(streamed(spark, tmp_path / str(i), files, CHUNKS, of)[0], *columns), keyed(want, *columns))
    got = streamed(spark, tmp_path / "r", files, CHUNKS, lambda c: S.stream_resample(c, 3, 2, "fast"))[0].collect()
    for r in X.resample(clips, 3, 2, "fast").collect():
        own = sorted((g.start, g.samples) for g in got if g.clip_id == r.clip_id)
        assert np.allclose(joined(own), r.samples)
    z = X.stft(clips, cfg).withColumn("last", F.col("frame") == F.max("frame").over(O.Window.partitionBy("clip_id", "channel"))).select("clip_id", "channel", "frame", "re", "im", "last")
    spectra = [tuple(r) for r in z.collect()]
    got = streamed(spark, tmp_path / "i", [spectra[::2], spectra[1::2]], z.schema, lambda c: S.stream_istft(c, cfg))[0].collect()
    lengths = clips.withColumn("n", F.floor(F.col("n") / 4) * 4)  # as far as the frames cover
    for r in X.istft(z.drop("last"), lengths, cfg).collect():
        assert np.allclose(joined(sorted((g.start, g.samples) for g in got if g.clip_id == r.clip_id)), r.samples)


def test_lost_late_and_repeated_chunks(spark, tmp_path):
    """The right rejects, what is there is made, and no state is left."""
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    c = lambda k, seq, minutes, last=False: (k, 0, seq, [float(seq)] * 4, last, at(minutes))
    files = [
        [c(1, 0, 0), c(1, 1, 0), c(1, 1, 0), c(2, 0, 0), c(3, 0, 0), c(4, 1, 0), c(5, 0, 0, True)],  # 1: a repeated one; 4: in the wrong order
        [c(1, 3, 1), c(1, 4, 1), c(1, 3, 1), c(2, 1, 1, True), c(4, 0, 1), c(4, 2, 1, True)],  # 1: chunk 2 is lost
        [c(2, 0, 2)],  # 2: one after the end
        [c(9, 0, 30, True)],  # time passes
        [c(9, 1, 31)],  # and the gap of 1 is closed
        [c(1, 2, 32), c(1, 5, 32, True)],  # the lost one after all, and the end
        [c(10, 0, 300, True)],  # 3 never ended
        [c(10, 1, 300), c(11, 0, 600, True)],
        [c(12, 0, 900, True)],
        [c(12, 1, 1200)],
    ]
    rows, query = streamed(spark, tmp_path, files, CHUNKS + ", ts timestamp", lambda s: S.stream_rms(s, 4, 4, whole=True, patience="10 minutes", idle="2 hours"))
    rows = rows.cache()
    got = sorted((r.clip_id, r.segment, r.reject, r.seq, r.until) for r in R.rejects(rows).collect())
    assert [g for g in got if g[0] < 9] == [
        (1, 0, "gap", 2, 2), (1, 0, "repeated", 1, 1), (1, 0, "repeated", 3, 3), (1, 1, "late", 2, 2), (2, 0, "after_end", 0, 0), (3, 0, "unfinished", 1, 1)
    ]
    frames = {}
    for r in R.taken(rows).orderBy("frame").collect():
        frames.setdefault((r.clip_id, r.segment), []).append(r.rms)
    assert {k: len(v) for k, v in frames.items() if k[0] < 9} == {(1, 0): 3, (1, 1): 4, (2, 0): 3, (3, 0): 2, (4, 0): 4, (5, 0): 2}
    assert frames[4, 0] == pytest.approx([0, 0.5**0.5, 2.5**0.5, 2**0.5])
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "clip").load()
    assert progress and {r.key.clip_id for r in state.select("key").collect()} <= {12}
    waiting = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "early").load()
    assert waiting.count() == 0


def test_a_stream_needs_typed_state(spark, tmp_path):
    chunks = spark.readStream.schema(CHUNKS).parquet(str(tmp_path))
    spark.conf.set(R.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError):
        S.stream_rms(chunks, 4, 4)
    spark.conf.set(R.PROVIDER, R.ROCKSDB)


def test_a_whole_clip_takes_few_state_calls_and_one_step():
    import pandas as pd

    calls, steps = [], []

    class State:
        def __getattr__(self, name):
            return lambda *a: (calls.append(name), None)[1]

    class Handle(State):
        getValueState = getMapState = lambda self, *a: State()  # noqa: E731, N815

    class Now:
        getCurrentWatermarkInMs = lambda self: 0  # noqa: E731, N815

    kernel = K.FrameKernel(StftConfig(fft=16, hop=4), "x array<double>", lambda f: (f,))
    step = kernel.step
    kernel.step = lambda x: (steps.append(len(x)), step(x))[1]
    made = R.Ordered(kernel, ["clip_id", "channel", "segment", "frame", "x", "reject", "seq", "until"], 10, 10, True)
    made.init(Handle())
    x = np.arange(64.0)
    rows = pd.DataFrame([(i, x[10 * i : 10 * i + 10], i == 6, i) for i in (3, 0, 1, 2, 6, 5, 4)], columns=["seq", "samples", "last", "at"])
    out = pd.concat(made.handleInputRows((1, 0), iter([rows]), Now()))
    assert steps == [64] and sorted(calls) == ["get", "registerTimer", "update"]
    want = through(K.FrameKernel(StftConfig(fft=16, hop=4), "x array<double>", lambda f: (f,)), [x])
    assert out["frame"].tolist() == [r[0] for r in want] and all(np.allclose(a, r[1]) for a, r in zip(out["x"], want, strict=True)) and out["reject"].isna().all()
