"""Each stage of the pipeline on an awkward table, against brute force."""

import collections

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavespark.llm import lines, toxicity

from test_operators import LONG, ODD, PASSAGE, _brute_windows, _check_pieces, _greedy, _naive_segments, _sorted

#: Columns of documents, and others that have the names of the operators' results.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, passages string, n_words int, kept_text string, n_removed string, n_lines int, n_dropped int, ids string, id int, `a b` int"
HEADER = "Posted by {} on the old board today"


def _texts():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    clean = [" ".join(word() for _ in range(40)) for _ in range(40)]
    bad = [" ".join([*(word() for _ in range(30)), *["vilething"] * 3]) for _ in range(20)]
    headed = [HEADER.format(f"user{i}") + "\n" + " ".join(word() for _ in range(20)) for i in range(12)]
    near = " ".join(word() for _ in range(200))
    copies = [near, near.replace(near.split()[100], "changed"), near, clean[0], clean[0]]
    return [*ODD, *clean, *bad, *headed, *copies, PASSAGE + " " + " ".join(word() for _ in range(60)), "", None]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    ids = [*range(len(texts) - 2), None, None]
    ids[70] = ids[71] = 3  # rows of one id
    rows = [(i, t, "en", "s", None if t is None else len(t), None if i is None else i / 7, "p", 5, "kept", "r", 6, 7, "i", n, n) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows.append(rows[20])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    path = str(tmp_path_factory.mktemp("tables"))
    n = len(ODD)
    labels = [(i, int(n + 40 <= i < n + 60)) for i in range(n, n + 60)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _others(rows, but=()):
    """The rows less the columns that a stage may change."""
    return _sorted([tuple(v for c, v in r.asDict().items() if c not in but) for r in rows])


def _plain_score(text, model):
    """A document's score by the definition: bytes of words, chained rates, best and further segments."""
    import pyarrow as pa

    score = []
    for _, _, _, levels in toxicity._buckets(pa.array([text], pa.string())):
        for at in zip(*levels, strict=True):
            rate = model.prior
            for bucket, counts in zip(at, model.log_odds, strict=True):
                rate = (counts[bucket, 1] + toxicity.STRENGTH * rate) / (counts[bucket].sum() + toxicity.STRENGTH)
            score.append(np.log(rate / (1 - rate)) - np.log(model.prior / (1 - model.prior)) - toxicity.DRIFT)
    n = len(score)
    found = [sum(score[a:b]) for a, b in _naive_segments(score)] if n <= 60 else [s for _, _, s in toxicity.maximal_segments(np.array(score))]
    log_e = sorted(np.log(model.k * n) - model.lam * s for s in found)
    x = -log_e[0] + sum(-e for e in log_e[1:] if e < np.log(toxicity.SIGNIFICANT)) if found else -np.log(model.k * max(n, 1))
    return 1 / (1 + np.exp(-(model.slope * np.clip(x, -30, 60) + model.intercept)))


def test_toxicity_stage(spark, docs, folder):
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out())
    rows = docs.collect()
    short = [r for r in rows if r.text != LONG]
    got = [r for r in corpus_pipeline.toxicity(spark, docs, folder).collect() if r.text != LONG]
    assert _others(got) == _others([r for r in short if _plain_score(r.text, model) < 0.5])
    n = len(ODD)
    assert not {r.doc_id for r in got} & set(range(n + 40, n + 60)) and {r.doc_id for r in got} >= set(range(n + 5, n + 40))


@pytest.mark.parametrize("label", [None, 0, 1])
def test_toxicity_stage_keeps_all_where_nothing_is_learned(spark, docs, tmp_path, label):
    labels = spark.createDataFrame([] if label is None else [(i, label) for i in range(20)], "doc_id bigint, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert _others(corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()) == _others(docs.collect())


def _plain_lines(rows):
    """(id, text) of each row after line dedup, by counting templates in dictionaries."""
    def tokens(line):
        return [None if any(c in "0123456789" for c in w) else w for w in line.split()]

    of = collections.defaultdict(set)  # (leaf, place, token) and leaf: documents
    parsed = {}
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else ():
            w = tokens(line)
            if w:
                leaf = (len(w), *w[: lines.DEPTH])
                parsed.setdefault((i, line), (leaf, w))
                of[leaf].add((i, tuple(w)))
                for p, x in enumerate(w):
                    of[leaf, p, x].add((i, tuple(w)))
    reached = {leaf: len({i for i, _ in s}) for leaf, s in of.items() if not (len(leaf) == 3 and isinstance(leaf[0], tuple))}
    has = collections.defaultdict(set)
    marks = {}
    for (i, line), (leaf, w) in parsed.items():
        if reached[leaf] < lines.MIN_DOCUMENTS:
            continue
        whole, found = len(of[leaf]), []
        for share in lines.SHARES:
            fixed = [p for p, x in enumerate(w) if x is not None and len(of[leaf, p, x]) >= max(lines.MIN_DOCUMENTS, share * whole)]
            beyond = sum(p >= lines.DEPTH for p in fixed)
            if len(fixed) >= lines.CONSTANT * len(w) and beyond >= max(lines.BEYOND, lines.CONSTANT * (len(w) - lines.DEPTH)):
                found.append((leaf, share, tuple((p, w[p]) for p in fixed)))
        if None not in w:
            found.append((leaf, "whole", tuple(w)))
        marks[i, line] = found
        for m in found:
            has[m].add(i)
    out = []
    for i, t in rows:
        if t is None or i is None:
            out.append((i, t))
            continue
        gone = lambda line: any(len(has[m]) >= lines.MIN_DOCUMENTS and i > min(has[m]) for m in marks.get((i, line), ()))  # noqa: B023, E731
        out.append((i, "\n".join(x for x in t.split("\n") if not gone(x))))
    return out


def test_line_stage(spark, docs, folder):
    rows, got = docs.collect(), corpus_pipeline.line_dedup(spark, docs, folder).collect()
    assert _sorted([(r.doc_id, r.text) for r in got]) == _sorted(_plain_lines([(r.doc_id, r.text) for r in rows]))
    assert _others(got, ("text", "n_chars")) == _others(rows, ("text", "n_chars"))
    assert sum("Posted by" in (r.text or "") for r in got) == 2 and all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_near_stage(spark, docs, folder):
    one_text = docs.where("doc_id is not null and doc_id <> 3")  # which text of an id counts is not said
    texts = {r.doc_id: r.text for r in one_text.collect()}
    order = sorted(texts)
    stay = {order[i] for i in _greedy([texts[i] for i in order])}
    got = corpus_pipeline.near_dedup(spark, one_text, folder).collect()
    assert _others(got) == _others([r for r in one_text.collect() if r.doc_id in stay])
    kept = corpus_pipeline.near_dedup(spark, docs, folder)
    assert kept.where("doc_id is null").count() == docs.where("doc_id is null").count()


def test_substring_stage(spark, docs, folder):
    rows, got = docs.collect(), corpus_pipeline.substring_dedup(spark, docs, folder).collect()
    want = [(i, kept if gone else r.text) for r, (i, kept, _, gone) in zip(rows, _brute_windows([(r.doc_id, r.text) for r in rows], 50), strict=True)]
    assert _sorted([(r.doc_id, r.text) for r in got]) == _sorted(want)
    assert _others(got, ("text", "n_chars")) == _others(rows, ("text", "n_chars"))


def test_packing_stage(spark, docs, folder):
    from tokenizers import Tokenizer

    t, unique = Tokenizer.from_file(P.path("byte_bpe_50k.json")), docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in unique.collect()}
    pieces = corpus_pipeline.pack(unique, P.path("byte_bpe_50k.json"), P.PATTERN)
    _check_pieces(pieces.collect(), ids)
    out = corpus_pipeline.packing(spark, docs, folder)
    assert out.agg(F.sum("length")).first()[0] == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = corpus_pipeline.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert 0.6 * docs.count() < rows.select("doc_id").distinct().count() <= docs.count()
