"""Headers and samples by ranged reads."""

import struct

import numpy as np
import pytest

from wavespark.operators import frames as O
from wavespark.operators import transforms as X
from wavespark.sources import audio

SCHEMA = "clip_id bigint, channel int, sample_rate int, n bigint, samples array<double>"


def clips_of(spark, *rows, rate=8000):
    return spark.createDataFrame([(k, c, rate, len(x), np.asarray(x, float).tolist()) for k, c, x in rows], SCHEMA)


def header(n_bytes, channels=1, bits=16, tag=1, rate=8000, before=b""):
    width = channels * bits // 8
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, channels, rate, rate * width, width, bits)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + before + fmt + struct.pack("<4sI", b"data", n_bytes)


def joined(blocks):
    """Samples of each file and channel, from blocks that follow without a gap."""
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: r.start):
        x = out.setdefault((r.clip_id.rsplit("/", 1)[-1], r.channel), [])
        assert r.start == len(x) and r.block == (r.start // len(r.samples) if r.start else 0) or r.start + len(r.samples) == r.n
        x.extend(r.samples)
    return out


@pytest.mark.parametrize("encoding", ["pcm16", "pcm24", "float64"])
def test_blocks_equal_whole_files(spark, tmp_path, encoding):
    rng = np.random.default_rng(4)
    audio.write_audio(clips_of(spark, *((k, c, rng.uniform(-1, 1, n)) for k, n in ((1, 103), (2, 1), (3, 40)) for c in (0, 1))), str(tmp_path), encoding).collect()
    whole = {(r.clip_id.rsplit("/", 1)[-1], r.channel): r.samples for r in audio.read_audio(spark, str(tmp_path))[0].collect()}
    blocks, rejects = audio.read_audio_blocks(spark, str(tmp_path), 7)
    assert joined(blocks) == whole and rejects.count() == 0
    ranges = audio.audio_ranges(audio.audio_info(spark, str(tmp_path)), 10, 2).where("start >= 40 and start < 80")
    assert sorted({r.start for r in audio.read_ranges(ranges, 10, tasks=3).collect()}) == [40, 50, 60, 70]


def test_mono_and_rate_while_reading(spark, tmp_path):
    rng = np.random.default_rng(5)
    clips = clips_of(spark, *((k, c, rng.normal(size=n)) for k, n in ((1, 333), (2, 1)) for c in range(3)))
    audio.write_audio(clips, str(tmp_path), "float64").collect()
    for target in (5000, 12000, 8000):
        blocks, rejects = audio.read_audio_blocks(spark, str(tmp_path), 50, target, mono=True, quality="fast")
        want = {(f"{r.clip_id}.wav", 0): r.samples for r in X.resample(O.downmix(clips), 8000, target, "fast").collect()}
        got = joined(blocks)
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in want) and rejects.count() == 0
        assert {r.sample_rate for r in blocks.collect()} == {target}


def test_rejects(spark, tmp_path):
    files = {
        "ok.wav": header(4) + bytes(4), "empty.wav": b"", "text.wav": b"text" * 9, "short.wav": header(8) + bytes(6), "odd.wav": header(3) + bytes(3), "tag.wav": header(4, tag=7) + bytes(4),
        "none.wav": header(0), "rate.wav": header(4, rate=1_999_999_973) + bytes(4), "late.wav": header(4, before=struct.pack("<4sI", b"LIST", 5001) + bytes(5002)) + bytes(4), "nodata.wav": header(0)[:-8],
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in audio.audio_info(spark, str(tmp_path), 16000).collect()}
    kinds = {k: r.error and r.error.kind for k, r in got.items()}
    assert kinds == {
        "ok.wav": None, "text.wav": "unrecognized_format", "short.wav": "truncated", "odd.wav": "truncated", "tag.wav": "unsupported",
        "none.wav": None, "rate.wav": "unsupported", "late.wav": None, "nodata.wav": "truncated",
    }
    assert (got["short.wav"].error.expected, got["short.wav"].error.read) == (8, 6) and (got["ok.wav"].n, got["none.wav"].n, got["late.wav"].n) == (2, 0, 2)
    paths = spark.createDataFrame([(f"{tmp_path}/absent.wav",), (None,), (str(tmp_path),), (f"{tmp_path}/empty.wav",), (f"{tmp_path}/ok.wav",)], "path string")
    assert [r.error and r.error.kind for r in audio.audio_info_of(paths).orderBy("path").collect()] == ["not_found", "io", "not_found", "unrecognized_format", None]
    blocks, rejects = audio.read_audio_blocks(spark, str(tmp_path), sample_rate=16000)
    assert {r.clip_id.rsplit("/", 1)[-1] for r in blocks.collect()} == {"ok.wav", "late.wav"} and rejects.count() == 6


def test_packed_clips_are_a_file_a_task(spark, tmp_path):
    rng = np.random.default_rng(8)
    clips = clips_of(spark, *((k, c, rng.normal(size=n)) for k, n in ((k, k % 41) for k in range(1, 300)) for c in (0, 1)))
    index = audio.write_packed(clips, f"{tmp_path}/files", "float64")
    index.write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.count() == 299 and len(list((tmp_path / "files").iterdir())) == index.select("path").distinct().count() <= 4
    info = audio.audio_info_of(index)
    assert {(r.clip_id, r.n, r.channels) for r in info.collect()} == {(k, k % 41, 2) for k in range(1, 300)} and info.where("error is not null").count() == 0
    want = {(r.clip_id, r.channel): r.samples for r in clips.collect() if r.n}
    got = {}
    for r in sorted(audio.read_ranges(audio.audio_ranges(info, 7), 7).collect(), key=lambda r: r.start):
        got.setdefault((r.clip_id, r.channel), []).extend(r.samples)
    assert got == want
    other = audio.read_ranges(audio.audio_ranges(audio.audio_info_of(index, 12000), 7, sample_rate=12000), 7, 12000, quality="fast")
    assert other.count() == sum(-(-(-(-n * 3 // 2)) // 7) for n in map(len, want.values()))
    # a part that ends early is truncated, whatever stands behind it
    short = audio.audio_info_of(index.where("clip_id in (3, 40)").selectExpr("clip_id", "path", "at", "bytes - 1 as bytes")).collect()
    assert [r.error.kind for r in short] == ["truncated"] * 2
    gone = audio.audio_info_of(index.limit(1).selectExpr("clip_id", "concat(path, 'x') as path", "at", "bytes")).collect()
    assert [r.error.kind for r in gone] == ["not_found"]


def test_short_blocks_are_summed_as_long_ones(monkeypatch):
    rng = np.random.default_rng(9)
    for rate, target in ((3, 2), (2, 3), (44100, 16000)):
        up, down, reach, h = X.resample_filter(rate, target, "fast")
        x = rng.normal(size=2 * reach + 200)
        for first, count in ((0, 10), (7, 1), (3, 50)):
            monkeypatch.setattr(X, "AT_ONCE", 0)
            want = X.resampled(x, -reach, first, count, up, down, reach, h)
            monkeypatch.undo()
            assert np.allclose(X.resampled(x, -reach, first, count, up, down, reach, h), want, rtol=0, atol=1e-14)


def test_headers_are_read_by_few_bytes():
    for before in (b"", struct.pack("<4sI", b"LIST", 100_000) + bytes(100_000)):
        data, seen = header(4, channels=2, before=before) + bytes(4), []

        def read(at, n, data=data, seen=seen):
            seen.append(n)
            return data[at : at + n]

        assert audio._header(read, len(data)) == (2, 8000, 4, "pcm16", len(data) - 4, 4) and sum(seen) < 4096
    long = 5_000_000_000  # its size stands in a chunk of its own
    head = b"RF64" + header(0xFFFFFFFF, before=struct.pack("<4sIQQQI", b"ds64", 28, 0, long, 0, 0))[4:]
    assert audio._header(lambda at, n: head[at : at + n], len(head) + long)[4:] == (len(head), long)


def test_a_long_file_is_read_in_parts(spark, tmp_path):
    """Three gigabytes, most of them a hole: many ranges, of which the last is read."""
    path, n = tmp_path / "long.wav", 1_500_000_000
    with open(path, "wb") as f:
        f.write(header(2 * n))
        f.seek(44 + 2 * n - 4)
        f.write(struct.pack("<hh", 16384, -16384))
    info = audio.audio_info(spark, str(tmp_path))
    ranges = audio.audio_ranges(info)
    assert info.first().n == n and ranges.count() == -(-n // (65536 * 16))
    last = audio.read_ranges(ranges.where(f"start >= {n - 65536 * 16}")).orderBy("start").collect()[-1]
    assert last.start + len(last.samples) == n and last.samples[-2:] == [0.5, -0.5]
