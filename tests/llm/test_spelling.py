"""Spelling variants against all pairs of words, and against the query's SQL."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from wavespark.llm import spelling
from wavespark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string"
COLUMNS = ("form", "root", "n", "n_near", "form_n")


def vocabulary(docs):
    count = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] and len(a) == len(b)


def expected(docs):
    n = vocabulary(docs)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def made(spark, folder, docs, schema=SCHEMA):
    spark.createDataFrame(docs, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = QUERIES["op13_spelling"](spark, str(folder)).collect()
    assert len({r.word for r in out}) == len(out)
    return {r.word: tuple(r[c] for c in COLUMNS) for r in out}


def test_forms_equal_all_pairs(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 8))) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 50, 400])]) + rng.choice([" ", ", ", "\n", "1"]) for _ in range(150))) for i in range(60)]
    docs += [(None, None), (None, "AÉBCD aébcd Aébcd"), (61, ""), (62, "×÷×÷× ×÷×÷× ×÷×÷×"), (62, "ÀÿÀÿÀ ÀÿÀÿÀ ÀÿÀÿÀ"), (62, "ÀÿÀÿÀ ÀÿÀÿÀ ÀÿÀÿÀ"), (63, "日本語abcab😀abcab日abcab")]
    assert made(spark, tmp_path, docs) == expected(docs)
    wide = [(*d, 1, "x", 2, 3) for d in docs]
    assert made(spark, tmp_path, wide, SCHEMA + ", n int, word string, h int, id int") == expected(docs)


def test_chains_ties_and_no_words(spark, tmp_path):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbc": 96, "bbbbbb": 192, "ccccc": 5, "ccccd": 9, "xyzzy": 4}
    docs = [(i, w) for i, w in enumerate(w for w, n in counts.items() for _ in range(n))]
    want = expected(docs)
    assert want["aaaaa"][1] not in ("aaaaa", want["aaaaa"][0]) and made(spark, tmp_path, docs) == want
    for none in ([], [(1, None)], [(1, "abcd abcd abcd")], [(1, "abcde abcde")]):
        assert made(spark, tmp_path, none) == {}
    assert made(spark, tmp_path, [(4, "abcdef"), (4, "abcdef"), (4, "abcdef"), (5, "other")] * 2) == expected([(4, "abcdef"), (4, "abcdef"), (4, "abcdef"), (5, "other")] * 2)


def test_words_of_a_million_letters_and_shared_beginnings(spark, tmp_path):
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefgh"), 1_000_000))
    near = long[:999_990] + "z" + long[999_991:]
    same = "q" * 300  # each of its beginnings is a word: as many levels as letters
    docs = [(i, t) for i, t in enumerate([long] * 3 + [near] * 7 + [long + "k"] * 3)]
    docs += [(100 + i, " ".join(same[:n] for n in range(5, 60))) for i in range(4)]
    got = made(spark, tmp_path, docs)
    want = {w: n for w, n in vocabulary(docs).items()}
    assert {w: r[2] for w, r in got.items()} == want
    assert got[long][3] == 2 and got[near][3] == 1 and got[long + "k"][3] == 1
    assert (got[long][0] == near) == (want[near] >= 2 * want[long])
    for n in range(6, 59):
        assert got[same[:n]][3] == sum(same[:k] in want for k in (n - 1, n + 1))


def test_checksums_of_many_ranges():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.choice([0, 1, 5, 63, 64, 65, 900], 300)
    state = np.array([zlib.crc32(str(i).encode()) for i in range(300)], np.uint32)
    want = [zlib.crc32(data[s:e].tobytes(), int(c)) for s, e, c in zip(start, end, state, strict=True)]
    assert spelling._checksums(data, start, end, state).tolist() == want
    words, n = spelling.counted_words(pa.array(["Élan élan abcde", None, "abcde ABCDE"]), ["1", "2", "3"], 5)
    assert sum(n.tolist()) == 3


def test_the_sql_gives_the_same(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op13_spelling"](spark, folder).select("word", *COLUMNS).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = con.sql(f"SELECT word, {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_spelling']})").fetchall()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str) and len(want) > 1000
