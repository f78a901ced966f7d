import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.config import StftConfig
from wavespark.operators import transforms as X
from wavespark.sources import audio
from wavespark.streaming import frames as S


def _clips(spark, rows):
    return spark.createDataFrame([(k, c, 8000, len(x), x) for k, c, x in rows], "clip_id bigint, channel int, sample_rate int, n bigint, samples array<double>")


@pytest.mark.parametrize("encoding,error", [("pcm16", 2**-16), ("pcm24", 2**-24), ("pcm32", 2**-32), ("float32", 1e-7), ("float64", 0)])
def test_wav_round_trip(spark, tmp_path, encoding, error):
    rng = np.random.default_rng(1)
    rows = [(1, 0, rng.uniform(-0.9, 0.9, 50).tolist()), (1, 1, rng.uniform(-0.9, 0.9, 50).tolist()), (2, 0, [0.0])]
    made = audio.write_audio(_clips(spark, rows), str(tmp_path), encoding).collect()
    assert sorted(r.clip_id for r in made) == [1, 2]
    clips, rejects = audio.read_audio(spark, str(tmp_path))
    got = {(int(r.clip_id.split("/")[-1][:-4]), r.channel): r.samples for r in clips.collect()}
    assert rejects.count() == 0 and set(got) == {r[:2] for r in rows}
    for k, c, x in rows:
        assert np.allclose(got[k, c], x, rtol=0, atol=error)


def test_pcm_saturates_and_rejects(spark, tmp_path):
    audio.write_audio(_clips(spark, [(1, 0, [2.0, -2.0])]), str(tmp_path)).collect()
    assert audio.read_audio(spark, str(tmp_path))[0].collect()[0].samples == [32767 / 32768, -1.0]
    whole = (tmp_path / "1.wav").read_bytes()
    (tmp_path / "2.wav").write_bytes(whole[:-2])
    (tmp_path / "3.wav").write_bytes(b"text")
    (tmp_path / "4.wav").write_bytes(whole[:20] + b"\x07\x00" + whole[22:])
    clips, rejects = audio.read_audio(spark, str(tmp_path))
    assert clips.count() == 1
    got = {r.path.split("/")[-1]: (r.kind, r.expected, r.read) for r in rejects.collect()}
    assert got == {"2.wav": ("truncated", 4, 2), "3.wav": ("unrecognized_format", None, None), "4.wav": ("unsupported", None, None)}
    names = spark.createDataFrame([("a.WAV",), ("b.flac",), ("c",)], "p string").select(audio.format_of_path(F.col("p"))).collect()
    assert [r[0] for r in names] == ["wav", "flac", None]


def test_stream_power_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, 0, rng.normal(size=n).tolist()) for k, n in ((1, 1), (2, 30), (3, 7))]
    cfg = StftConfig(fft=8, hop=3)
    parts = [(k, c, s, x[s * 4 : s * 4 + 4], (s + 1) * 4 >= len(x)) for k, c, x in rows for s in range(-(-len(x) // 4))]
    spark.createDataFrame(parts[::-1], "clip_id bigint, channel int, seq bigint, samples array<double>, last boolean").write.parquet(f"{tmp_path}/c")
    chunks = spark.readStream.schema("clip_id bigint, channel int, seq bigint, samples array<double>, last boolean").parquet(f"{tmp_path}/c")
    q = S.stream_power(chunks, cfg).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/k").start()
    q.awaitTermination()
    got = {(r.clip_id, r.frame): r.s for r in spark.table("streamed").collect()}
    want = {(r.clip_id, r.frame): r.s for r in X.power_spectrum(_clips(spark, rows), cfg).collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k]) for k in want)
