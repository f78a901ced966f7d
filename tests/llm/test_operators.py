"""The ten operators and the pipeline on small tables, against brute force."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from wavespark.llm import bpe, langid, lines, lm, matroska, packing, simhash, substring, topk, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_lines int, packets int, kept_text string, n_words int"
LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(70))
ODD = [None, "", "   \n\t", "x" * 5000, "don't 12 élan naïve  日本語 🙂!! \r\n  end ", PASSAGE, "a " + PASSAGE + " b", "a " + PASSAGE + " b", LONG]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "old", 1, 1, "old", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_bpe(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    df = docs_of(spark, [*ODD, "same", "same"], [*range(len(ODD)), 7, None])
    rows = bpe.bpe_encode(df, path, P.PATTERN).withColumn("back", bpe.bpe_decode(F.col("ids"), path)).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids), bytes(r.back)) for r in rows)
    want = sorted((i if i is not None else -1, known.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip([*range(len(ODD)), 7, None], [*ODD, "same", "same"], strict=True))
    assert got == want
    assert bpe.bpe_encode(df.limit(0), path, P.PATTERN).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # words go on from batch to batch, or start anew
    every = bpe.known_words(df, path, P.PATTERN, rows=np.inf, share=1)
    some = bpe.known_words(df, path, P.PATTERN, rows=np.inf, share=0.5)
    assert len(every.word) == len(every.size) > len(some.word) > 0
    assert len(bpe.known_words(df.limit(0), path, P.PATTERN).word) == 0 == len(bpe.known_words(df, path, P.PATTERN, rows=np.inf, most=0).word)
    for w, ids in zip(every.word.to_pylist(), np.split(every.ids, np.cumsum(every.size)[:-1]), strict=True):
        assert ids.tolist() == known.encode_ordinary(w.decode())
    for words, given in ((bpe.WORDS, None), (3, None), (bpe.WORDS, some), (3, some), (bpe.WORDS, every), (3, every)):
        rows = bpe.bpe_encode(df.coalesce(1), path, P.PATTERN, words=words, known=given).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in rows) == [w[:2] for w in want]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bpe_long_words(spark):
    path, rng = P.path("byte_bpe_50k.tiktoken"), np.random.default_rng(8)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    letters = lambda of, n: "".join(rng.choice(list(of), n))
    texts = [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (193, 100_000, 1_000_000)]
    texts += ["x" * 5000, " " * 3001, "ab" * 2000, "aba" * 1500, "=-" * 900, "the" * 3000, letters("日本語中文字符漢", 3000), letters("acgt", 20_000), "\n" * 999 + "a" + "\t" * 700]
    df = docs_of(spark, texts).repartition(4)
    got = {r.doc_id: r.ids for r in bpe.bpe_encode(df, path, P.PATTERN).collect()}
    assert got == {i: known.encode_ordinary(t) for i, t in enumerate(texts)}


def _naive_segments(x):
    """Ruzzo and Tompa's definition: the best segment, then the same on both sides."""
    best, at = 0.0, None
    for i in range(len(x)):
        for j in range(i + 1, len(x) + 1):
            if sum(x[i:j]) > best + 1e-12:
                best, at = sum(x[i:j]), (i, j)
    if at is None:
        return []
    a, b = at
    return _naive_segments(x[:a]) + [at] + [(i + b, j + b) for i, j in _naive_segments(x[b:])]


def test_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-5, 6, rng.integers(0, 14)).astype(float) + rng.random()
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(x)]
        assert sorted(got) == sorted(_naive_segments(list(x)))


def test_maximal_segments_take_linear_time():
    """A million tokens whose sums fall on, so that no candidate is ever joined; and random ones."""
    rng = np.random.default_rng(7)
    fall = np.where(np.arange(1_000_000) % 2, -2.0, 1.0)
    began = time.process_time()
    assert len(toxicity.maximal_segments(fall)) == 500_000
    assert toxicity.maximal_segments(rng.normal(-0.1, 1, 1_000_000))
    assert time.process_time() - began < 30


def test_toxicity_learns_from_few_rows_of_an_id(spark):
    """Rows of one id are one row of the fit, so the sample stays within its bound; clashing columns are left alone."""
    df = docs_of(spark, ["quiet words"] * 3000 + ["vilething text", "quiet text", None], [1] * 3000 + [2, 3, None])
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(df, labels, F.lit(True), rows=2)
    assert model.prior == pytest.approx(1.5 / 3 if model.log_odds[-1].sum() == 4 else model.prior) and model.log_odds[-1].sum() <= 2 * 2
    rows = toxicity.score_toxicity(df, model).collect()
    assert len(rows) == 3003 and rows[0].n_words == 1 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity(spark):
    clean = [f"plain words number {i} of a quiet text" for i in range(60)]
    bad = [f"plain words number {i} vilething text vilething" for i in range(30)]
    df = docs_of(spark, [*clean, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(60 <= i < 90)) for i in range(90) if i % 3], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(df, labels, ~toxicity.held_out())
    rows = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    assert len(rows) == 92 and all(0 <= r.score <= 1 for r in rows.values())
    assert all((rows[i].score >= 0.5) == (60 <= i < 90) for i in range(92))
    assert rows[60].passages and not rows[0].passages
    for taught in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        nothing = toxicity.fit_toxicity(df, taught, F.lit(True))
        assert toxicity.score_toxicity(df, nothing).where("score < 0.5").count() == 92
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_language(spark):
    texts = {"en": "the weather is thinking of rather those things", "de": "das wetter ist schön und nicht schlecht zwischen", "fr": "le temps est très beau et les oiseaux chantent", "es": "el tiempo está muy bueno y los pájaros cantan"}
    rows = [(i, f"{t} {i}", lang if i % 5 else None) for i, (lang, t) in enumerate(list(texts.items()) * 20)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !!", "en"), (902, "", None)], "doc_id bigint, text string, lang string")
    model = langid.fit_languages(df, ~langid.held_out())
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = {r.doc_id: r for r in langid.predict_languages(df.drop("lang"), model).collect()}
    assert all(got[i].lang_pred == list(texts)[i % 4] and 0 <= got[i].score <= 1 for i in range(80))
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    same = spark.createDataFrame([(None, texts["en"], "en")] * 300 + [(5, texts["fr"], "fr")] * 300, "doc_id bigint, text string, lang string")
    few = langid.fit_languages(same, F.lit(True), rows=40)
    assert few.families == {"germanic": ["en"], "romance": ["fr"]}
    none = langid.fit_languages(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict_languages(df, none).collect()} == {"und"}


def _brute_windows(rows, size):
    """(id, kept text, words, removed words) of every row, in order."""
    first, out = {}, []
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - size + 1 if i is not None else 0):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        out.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("options", [{}, {"sent": 0}, {"group": 3}, {"group": 3, "sent": 0}, {"group": 0}])
@pytest.mark.parametrize("window, anchor, prefixes", [(50, 16, (8, 24)), (6, 3, (2, 4))])
def test_substring(spark, options, window, anchor, prefixes):
    rng = np.random.default_rng(3)
    texts = [*ODD, *(" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 60))) for _ in range(30)), " ".join(["z"] * 200), " ".join(["z"] * 120)]
    other = " ".join(f"o{i}" for i in range(60))
    # rows of one id with different texts, repeated rows, null ids
    texts, ids = [*texts, PASSAGE, PASSAGE, other, other, other, other + " x", PASSAGE, None], [*range(len(texts)), 101, 105, 105, 109, 109, 105, None, None]
    df = docs_of(spark, texts, ids)
    got = [(r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in substring.remove_repeats(df, window, anchor, prefixes=prefixes, **options).collect()]
    assert _sorted(got) == _sorted(_brute_windows(list(zip(ids, texts, strict=True)), window))
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_lm(spark):
    df = docs_of(spark, [*["good text about rivers and hills"] * 20, *["noise zzz qqq"] * 20, None, ""])
    df = df.withColumn("target", F.col("doc_id") < 20)
    out = {r.doc_id: r for r in lm.cross_entropy_difference(df, lm.fit_models(df)).collect()}
    assert out[0].score > out[25].score and out[40].n_tokens == out[41].n_tokens == 0 and out[40].score == 0
    assert abs(out[0].score - (out[0].background_loss - out[0].target_loss)) < 1e-12
    assert lm.cross_entropy_difference(df.limit(0), lm.fit_models(df.limit(0))).count() == 0


def test_lm_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)  # many blocks and ranges
    rng = np.random.default_rng(7)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 200_000, 400)) for _ in range(1000)]  # far more pairs than any small table of buckets holds apart
    df = docs_of(spark, [*texts, "v1 v1 v2", None]).withColumn("target", F.col("doc_id") % 3 == 0)
    words, pairs = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, t in enumerate([*texts, "v1 v1 v2"]):
        w = t.split()
        for m in (0, 1) if i % 3 == 0 else (0,):
            words[m].update(w)
            pairs[m].update(zip([None, *w], w, strict=False))
    other = docs_of(spark, ["v1 v1 v2 unseen"])
    models = lm.fit_models(df)
    got = {r.doc_id: r for r in lm.cross_entropy_difference(df, models).collect()}
    assert len(got) == 1002

    def loss(w, m):
        total = words[m].total()
        p = [lm.WEIGHTS[0] * pairs[m][a, b] / max(words[m][a] if a else total, 1) + lm.WEIGHTS[1] * words[m][b] / total + lm.WEIGHTS[2] / (len(words[0]) + 1) for a, b in zip([None, *w], w, strict=False)]
        return -np.log(p).mean()

    cases = [(got[i], t) for i, t in enumerate(texts[:20])] + [(lm.cross_entropy_difference(other, models).first(), "v1 v1 v2 unseen")]
    for row, t in cases:
        assert abs(row.background_loss - loss(t.split(), 0)) < 1e-9 and abs(row.target_loss - loss(t.split(), 1)) < 1e-9


def test_lm_rows_grow_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    for n in (100, 400):
        models = lm.fit_models(docs_of(spark, ["one two " * 10] * n).withColumn("target", F.lit(False)))  # five keys, whatever the block
        blocks, rows = models.counts.agg(F.count_distinct("__block"), F.count("*")).first()
        assert models.ranges > n / 20 and blocks <= rows <= 5 * blocks


def test_lm_query_with_null_and_repeated_ids(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1500)
    rows = [(None, f"void w{i % 7} end", "en") for i in range(300)] + [(1, "good good text", "en")] * 50 + [(2, None, "en"), (3, "", "en"), (4, "other text", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = lm.op5_lm(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    words = len({w for _, t, _ in rows for w in (t or "").split()})
    first = 0.5 * 50 / 150 + 0.45 * 100 / 150 + 0.05 / (words + 1)  # the word that begins a document is held against all tokens
    pair = 0.5 * 50 / 100 + 0.45 * 100 / 150 + 0.05 / (words + 1)
    last = 0.5 * 50 / 100 + 0.45 * 50 / 150 + 0.05 / (words + 1)
    loss = -(math.log(first) + math.log(pair) + math.log(last)) / 3
    assert all(abs(r.target_loss - loss) < 1e-9 for r in got if r.doc_id == 1)
    assert all(r.n_tokens == 0 and r.score == 0 for r in got if r.doc_id in (2, 3))
    assert all(r.score < 0 for r in got if r.doc_id is None)


def test_lines(spark):
    header = "Posted by {} on the old board today"
    texts = [header.format(f"user{i}") + f"\nown line number of text {'abcdefghijkl'[i]} x\n" for i in range(8)] + [None, "", "\n\n", "Posted by user3 on the old board today"]
    got = {r.doc_id: r for r in lines.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert got[0].n_dropped == 0 and got[0].text == texts[0]
    assert all(got[i].n_dropped >= 1 and "Posted" not in got[i].text for i in (*range(1, 8), 11))
    assert got[8].text is None and got[8].n_lines == 0 and got[9].text == "" and got[9].n_lines == 1 and got[10].text == "\n\n"
    assert lines.drop_recurring_lines(docs_of(spark, texts).limit(0)).count() == 0
    assert lines.drop_recurring_lines(docs_of(spark, texts, [None] * len(texts))).agg(F.sum("n_dropped")).first()[0] == 0


def _word(i):
    return "".join("abcdefghij"[int(d)] for d in str(i))


def test_lines_with_recurring_values(spark):
    rng = np.random.default_rng(9)  # 5000 documents of one template, two fields of 100 words
    texts = [f"Filed with us by member {_word(b)} on the {_word(a)} board" for a, b in rng.integers(100, 200, (5000, 2))]
    got = {r.doc_id: r.n_dropped for r in lines.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert got[0] == 0 and all(got[i] == 1 for i in range(1, 5000))


def test_lines_keeps_clean_lines(spark):
    rng = np.random.default_rng(10)
    numbers = ["\n".join([f"{a} {b} {c}", f"{a}", f"{a}-{b} {c} {a} {b} {c}"]) for a, b, c in rng.integers(0, 10**6, (300, 3))]
    short = [f"It was a {_word(a)} {_word(b)}\nIt was {_word(a)}\nAnd then she {_word(b)}" for a, b in zip(range(300, 600), range(600, 900), strict=True)]
    prose = [" ".join(["It", "was", "a", *(f"{_word(x)}" for x in rng.integers(0, 3000, 9))]) for _ in range(300)]
    rows = lines.drop_recurring_lines(docs_of(spark, [*numbers, *short, *prose, *["Read more"] * 9])).collect()
    assert sum(r.n_dropped for r in rows if r.doc_id < 900) == 0 and sum(r.n_dropped for r in rows) == 8


def _check_pieces(rows, want):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == np.array(want[doc], "<u4").tobytes()
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1]) and {r.doc_tokens for r in parts} == {len(want[doc])}
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])
        total = sum(r.length for r in parts)
        assert total == 1024 or total & (total - 1) == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [*ODD, "<|endoftext|> as text", "two  <|endoftext|><|endoftext|>  \n", "<|endoftext|>", "<|endoftext"]
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    _check_pieces(packing.pack(docs_of(spark, texts), path, P.PATTERN).collect(), want)
    assert packing.pack(docs_of(spark, texts).limit(0), path, P.PATTERN).count() == 0


def test_packing_keeps_the_windows_of_the_rule():
    rng = np.random.default_rng(6)
    sizes = [int(n) for n in rng.integers(1, 1024, 1000)]
    ruled, packer, pieces = {}, packing.Packer(1024), []
    for i, n in enumerate(sizes):
        pieces += packer.add(i, np.full(n, i, np.int32))
        for number, parts in packer.open.items():
            ruled.update({p[0]: number for p in parts})
        ruled.update({p[0]: p[3] for p in pieces if p[0] not in ruled})
    pieces += packer.close()
    windows = collections.defaultdict(int)
    for p in pieces:
        windows[p[3]] += len(p[2])
    assert all(n == 1024 or n & (n - 1) == 0 for n in windows.values()) and sum(n < 1024 for n in windows.values()) <= 10
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
    assert all(sum(len(p[2]) for p in by_doc[i]) == n for i, n in enumerate(sizes))
    kept = sum(n for i, n in enumerate(sizes) if len(by_doc[i]) == 1 and by_doc[i][0][3] == ruled[i])
    assert kept > 0.9 * sum(sizes)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(5)
    packer, levels, full = packing.Packer(32), collections.Counter(), 0
    for i in range(400):
        size = int(rng.integers(1, 32))
        options = []
        for level in [0, *sorted(levels)]:
            if level + size <= 32 and (level == 0 or levels[level]):
                after = collections.Counter(levels)
                if level:
                    after[level] -= 1
                if level + size < 32:
                    after[level + size] += 1
                options.append((sum(v * v for v in after.values()), -level, after))
        packer.add(i, np.zeros(size, np.int32))
        levels = +min(options, key=lambda o: o[:2])[2]
        assert {h: int(c) for h, c in enumerate(packer.count) if c} == dict(levels)


def test_matroska_round_trip_and_lacings(spark):
    for n in (192, 192 * 7, 192 * 8, 192 * 1000):
        data = bytes(i * 7 % 256 for i in range(n))
        media = matroska.mux(data)
        packets, cues, clusters, error = matroska.parse(media)
        assert error is None and b"".join(media[o : o + s] for _, _, o, s, _ in packets) == data
        assert [t for _, t, *_ in packets] == [24 * i for i in range(n // 192)] and len(cues) == clusters
        assert all(media[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in cues)
    E = matroska.element
    frames = [b"a" * 300, b"b" * 5, b"c" * 255, b"d"]
    for lacing in (1, 3):
        body = b"\x81\x00\x05" + bytes([matroska.lacing_bits(lacing)]) + matroska.lace(frames, lacing)
        group = E(matroska.GROUP, E(matroska.BLOCK, body) + E(matroska.REFERENCE, 1))
        unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + E(matroska.TIME, 100) + group
        media = E(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + unknown
        packets, _, clusters, error = matroska.parse(media)
        assert error is None and clusters == 2 and [media[o : o + s] for _, _, o, s, _ in packets] == frames * 2
        assert {(t, k) for _, t, _, _, k in packets} == {(105, False)}
    good = matroska.mux(b"q" * 1920)
    df = spark.createDataFrame([(0, None), (1, b""), (2, b"junk" * 9), (3, bytearray(good[:-900])), (4, bytearray(good))], "id int, media binary")
    got = {r.id: r for r in matroska.read_track(matroska.packet_table(df)).collect()}
    assert all(got[i].error and not got[i].packets for i in (0, 1, 2)) and got[3].error and got[4].error is None
    assert bytes(got[4].samples) == b"q" * 1920
    assert matroska.packet_table(df.limit(0)).count() == 0


def _stored(media):
    """The frames of a file of mux, by an own reading of its bytes: element by element, no recursion."""
    out, at = [], 0
    while at < len(media):
        first = media[at]
        n = next(w for w in range(1, 5) if first >> (8 - w))
        kind, at = media[at : at + n].hex(), at + n
        n = next(w for w in range(1, 9) if media[at] >> (8 - w))
        size, at = int.from_bytes(media[at : at + n], "big") - (1 << 7 * n), at + n
        if kind in ("18538067", "1f43b675"):
            continue  # what follows is inside
        body, at = media[at : at + size], at + size
        if kind == "a3":
            flags, data = body[3] & 6, body[4:]
            if flags == 6:  # sizes in front: the first, then differences, of which all are zero
                count, n = data[0] + 1, next(w for w in range(1, 9) if data[1] >> (8 - w))
                assert set(data[1 + n : 1 + n + count - 2]) <= {0xBF}
                data = data[1 + n + count - 2 :]
            elif flags == 4:
                data = data[1:]
            out.append(data)
    return b"".join(out)


def test_op8_contract(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in matroska.op8_matroska(spark, sf).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        media = matroska.mux(payload)
        x = np.frombuffer(payload, np.uint8).astype(int) - 128
        feature = f"mean={x.sum() * 1000 // len(x)},power={(x * x).sum() // len(x)},crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))},low={x.min()},high={x.max()}"
        assert _stored(media) == payload and r.feature == feature
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-16:]), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()


def test_hostile_files(spark):
    E, head = matroska.element, matroska.element(matroska.EBML, b"")
    nested = b""
    for _ in range(3000):
        nested = E(matroska.GROUP, nested)
    group = E(matroska.BLOCK, b"\x81\x00\x00\x00abc")
    files = [head + nested]
    for time in (b"\xff" * 8, b"\x01" + bytes(8), b"\x01" * 30):
        files.append(head + E(matroska.SEGMENT, E(matroska.CLUSTER, E(matroska.TIME, time) + E(matroska.GROUP, group))))
    files.append(head + E(matroska.SEGMENT, E(matroska.TRACKS, E(matroska.TRACK, E(matroska.NUMBER, 1) + E(matroska.DURATION, b"\xff" * 8)))))
    files.append(head + E(matroska.SEGMENT, E(matroska.CUES, E(matroska.CUE, E(matroska.CUE_AT, E(matroska.CUE_CLUSTER, b"\xff" * 8))))))
    rng = np.random.default_rng(12)
    good = matroska.mux(bytes(range(192)) * 20)
    for _ in range(200):  # random damage
        bad = bytearray(good)
        for at in rng.integers(0, len(bad), 4):
            bad[at] = int(rng.integers(256))
        files.append(bytes(bad[: int(rng.integers(1, len(bad)))]))
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "id int, media binary")
    got = {r.id: r.error for r in matroska.packet_table(df).collect()}
    assert len(got) == len(files) and all(got[i] for i in range(6))


def _simhash(text, k=3):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in ODD:
        assert simhash.fingerprint(text, 3) == _simhash(text)


@pytest.mark.parametrize("radius, spare", [(2, 4), (5, 3)])
def test_bit_sliced_groups(spark, radius, spare):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:4]:  # one base has hundreds of neighbours
        for _ in range(300 if b == base[0] else 10):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, radius + 3), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    values = np.unique(np.array(fps, np.uint64))
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    want = {frozenset(int(np.int64(values.view(np.int64)[j])) for j in range(len(values)) if find(j) == r) for r in {find(i) for i in range(len(values))}}
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    from wavespark.llm.components import connected_components

    groups = collections.defaultdict(set)
    for r in connected_components(simhash.near_links(df, radius, spare)).collect():
        groups[r.component].add(r.node)
    assert {frozenset(g) for g in groups.values()} == {w for w in want if len(w) > 1}
    assert all(c == min(g) for c, g in groups.items())


def test_near_duplicates(spark):
    text = " ".join(f"t{i}" for i in range(300))
    near = text.replace("t150 ", "changed ")
    texts = [*ODD, text, near, text, "short one", "short one", None]
    df = docs_of(spark, texts)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(df).collect()}
    assert groups[11] == groups[9] == 9 and groups[13] == 12 and groups[14] == groups[0] == 0
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert 9 in kept and 11 not in kept and 10 not in kept and 13 not in kept and {3, 4, 8, 12} <= kept and 14 not in kept
    assert simhash.near_duplicate_groups(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def _shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _greedy(texts, similarity=0.8):
    """Ids that stay when each document goes that is similar to a smaller one that stays."""
    stay = []
    for i, s in ((i, _shingles(t)) for i, t in enumerate(texts)):
        if all(len(s & o) < similarity * len(s | o) for _, o in stay):
            stay.append((i, s))
    return {i for i, _ in stay}


def test_near_duplicates_recall(spark):
    rng = np.random.default_rng(4)
    texts = []
    for c in range(60):
        base = [f"c{c}w{x}" for x in rng.integers(0, 10_000, 200)]
        for _ in range(4):
            own = list(base)
            for at in rng.choice(200, rng.integers(1, 7), replace=False):
                own[at] = f"new{rng.integers(0, 10**9)}"
            texts.append(" ".join(own))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect()}
    assert kept == _greedy(texts)


def test_near_duplicates_many_classes(spark):
    passage = " ".join(f"p{i % 300}" for i in range(900))  # one repeated passage: fingerprints alike, sets not
    texts = [f"{passage} " + " ".join(f"k{c}x{i}" for i in range(100)) for c in range(8) for _ in range(3)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect()}
    assert kept == _greedy(texts) == set(range(0, 24, 3))


def test_values_apart_estimates_the_similarity(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    texts = [" ".join(base)] + [" ".join(f"x{x}" if rng.random() < share else w for x, w in enumerate(base)) for share in (0.005, 0.02, 0.04, 0.1, 0.5, 1.0)]
    rows = simhash.minhash_bands(docs_of(spark, texts).select(F.col("doc_id").alias("id"), "text"), 5)
    first = rows.where("id = 0").select(F.col("planes").alias("other"))
    got = dict(rows.join(first.hint("merge")).select("id", simhash.values_apart(F.col("planes"), F.col("other"))).collect())
    own = _shingles(texts[0])
    for i, text in enumerate(texts):
        alike = len(own & _shingles(text)) / len(own | _shingles(text))
        assert abs(got[i] / 144 - (1 - alike) * 15 / 16) < 0.17
        assert alike < 0.8 or got[i] <= simhash.most_apart(0.8)
    assert got[0] == 0


def test_wide_fingerprints_are_compared_bit_sliced(spark, monkeypatch):
    rng = np.random.default_rng(10)
    texts = []
    for c in range(40):
        base = [f"c{c}w{x}" for x in rng.integers(0, 10_000, 200)]
        texts += [" ".join(base), " ".join(f"new{c}" if x in (50, 120, 190)[: 1 + c % 3] else w for x, w in enumerate(base))]
    rows = simhash.wide_fingerprints(docs_of(spark, texts).select(F.col("doc_id").alias("id"), "text"), 5)
    words = {r.id: np.array(r.words, np.int64).view(np.uint64) for r in rows.collect()}
    apart = lambda i, j: int(np.bitwise_count(words[i] ^ words[j]).sum())
    assert max(apart(2 * c, 2 * c + 1) for c in range(40)) <= simhash.most_bits_apart(0.8) < min(apart(2 * c, 2 * c + 2) for c in range(39))
    first = rows.where("id = 0").select(F.col("words").alias("other"))
    got = dict(rows.join(first.hint("merge")).select("id", simhash.bits_apart(F.col("words"), F.col("other"))).collect())
    assert got == {i: apart(0, i) for i in words}
    # groups under keys link exactly those within the radius, over more than one word
    prints = rows.select(F.col("id").alias("node"), "words")
    radius = simhash.most_bits_apart(0.8, simhash.SENT)
    links = {tuple(r) for r in simhash.links_of_groups(simhash.fingerprint_keys(prints), ["w0", "w1"], radius).distinct().collect()}
    near = {(j, i) for i in words for j in words if i < j and int(np.bitwise_count(words[i][:2] ^ words[j][:2]).sum()) <= radius}
    assert links <= near and {(2 * c + 1, 2 * c) for c in range(40)} <= links
    used, write = [], simhash.links_of_groups
    monkeypatch.setattr(simhash, "links_of_groups", lambda *args: (used.append(1), write(*args))[1])
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect()} == set(range(0, 80, 2)) and used == [1]


def test_near_duplicates_of_one_site_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    page = [f"s{x}" for x in rng.integers(0, 10**6, 200)]  # pages alike but not similar, and two copies at the end
    texts = []
    for d in range(600):
        at = set(rng.choice(200, 9, replace=False).tolist())
        texts.append(" ".join(f"d{d}x{i}" if i in at else w for i, w in enumerate(page)))
    texts += [texts[5] + " more", texts[599] + " other"]
    rounds, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: (rounds.append(1) if name == "firsts" else None, write(df, name))[1])
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect()}
    assert kept == _greedy(texts)
    assert len(rounds) <= 5  # 1, 8, 64, 512 documents of a key, and perhaps the rest


def test_near_duplicates_hand_on_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    page = [f"s{x}" for x in rng.integers(0, 10**6, 200)]  # one large group of near copies, each in most tables with most others
    texts = []
    for d in range(400):
        at = set(rng.choice(200, 1 + d % 9, replace=False).tolist())
        texts.append(" ".join(f"d{d}x{i}" if i in at else w for i, w in enumerate(page)))
    rows, write = [], simhash.materialize

    def counted(df, name):
        out = write(df, name)
        if name in ("firsts", "met", "left"):
            rows.append((name, out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect()}
    assert kept == _greedy(texts)
    assert all(n == distinct for name, n, distinct in rows if name != "left")
    first, *_ = (n for name, n, _ in rows if name == "met")
    assert first <= 400 * 12  # not a pair for each of 88 tables, nor for each two members
    # a document that is decided leaves all its keys behind; of the others only keys under which they may have more come back
    assert sum(n for name, n, _ in [r for r in rows if r[0] == "left"][1:]) < 400 * 44


@pytest.mark.parametrize("small", [1, 16, 10**6])
def test_smallest_near_by_brute_force(small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "PAIRS", 10**6 if small > 16 else 500)
    rng = np.random.default_rng(small)
    size = np.array([2, 3, 150, 17, 64, 65, 1, 90])
    first = np.cumsum(size) - size
    many = size > 1
    fps = np.concatenate([np.repeat(rng.integers(0, 2**63, (1, 8), dtype=np.uint64), n, axis=0) for n in size])
    for i in range(len(fps)):
        for bit in rng.choice(512, rng.integers(0, 90), replace=False):
            fps[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    sizes, asks, t = rng.integers(90, 130, len(fps)), rng.random(len(fps)) < 0.7, np.repeat(rng.integers(0, 88, len(size)), size)
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    taken, near, here = simhash._taken(), {}, {}
    for lo, n in zip(first, size, strict=True):
        for i in (i for i in range(lo, lo + n) if asks[i]):
            near[i] = [j for j in range(lo, i) if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) and (bits[i] != bits[j]).sum() <= simhash.most_bits_apart(0.8)]
            here[i] = [not (bits[i] == bits[j])[taken[: t[i]]].all(axis=1).any() for j in near[i]]
    for most in (1, 8, 1000):
        a, b, more = simhash._smallest_near(fps, t, sizes, asks, first[many], size[many], 0.8, most)
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        assert got == {(i, j) for i in near for j, h in zip(near[i][:most], here[i][:most], strict=True) if h} and len(a) == len(got)
        assert {i for i in near if any(here[i][most:])} <= set(more.tolist()) <= {i for i in near if len(near[i]) >= most}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [[float(v) for v in rng.normal(0, 0.3, 8)] for _ in range(600)] + [[0.5] * 8] * 300
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1003, [float("inf")] * 8)]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 900, 50):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:5]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)]
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == want
    monkeypatch.setattr(topk, "LEAF", 40)  # many levels and blocks
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()) == want
    tree = topk.grow(x.astype(float), 900, leaf=40)
    assert len(tree.leaves()) > 10 and max(len(tree.path(int(i))) for i in tree.leaves()) > 2
    assert topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0, 5).count() == 2
    assert topk.top_k(df.limit(0), F.lit(True), 5).count() == 0


def test_top_k_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1e7, -1e7]), (3, [1e7, 1e7]), (None, [1.0, 1.0]), (4, [])]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    whole = [(i, [int(np.floor(256 * c)) for c in v] + [0] * (2 - len(v))) for i, v in rows if i is not None]
    for q in (0, 3):
        v = dict(whole)[q]
        want = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q))[:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == q, 5).collect())
        assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
