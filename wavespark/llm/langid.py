"""Language identification in two levels: family first, then its languages.

Each decision between two classes is a linear support vector machine over the
frequencies of hashed byte trigrams of the lower-cased text; classes of a level
vote pairwise (one against one). Families come from a table of language codes;
a code that is not in it is a family of its own. The machines are fitted on a
bounded sample of the labelled rows and have a fixed size; prediction is narrow
and reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, materialize, table
from .textbytes import chunks

#: The sample that the machines are fitted on, about: rows of each language, rows and bytes of texts of all; longer texts are not learned from.
ROWS_PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_BYTES, LONGEST = 1_500, 6_000, 50_000_000, 1_000_000
BITS = 13
EPOCHS, REGULARIZATION, SEED = 15, 1e-4, 7

#: Families of common language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"),
    "sinitic": ("zh", "yue"),
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0] in codes), lang)


@dataclass(frozen=True)
class Machine:
    """Separates class a (positive) from class b; weights end with the bias."""

    a: str
    b: str
    weights: np.ndarray


@dataclass(frozen=True)
class LanguageModel:
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def _features(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte; the last two take spaces after them."""
    x = np.concatenate([data, [32, 32]]).astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _texts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    import pyarrow.compute as pc

    for lo, hi, data, offsets in chunks(pc.utf8_lower(texts)):
        yield lo, hi, _features(data), offsets


def _vectors(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), (1 << BITS) + 1), np.float32)
    for lo, hi, at, offsets in _texts(pa.array(texts, pa.string())):
        for i in range(hi - lo):
            own = at[offsets[i] : offsets[i + 1]]
            out[lo + i, :-1] = np.bincount(own, minlength=1 << BITS) / max(len(own), 1) * 100
    out[:, -1] = 1
    return out


def _svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear SVM over some rows of x, by averaged stochastic subgradients in mini-batches, classes weighted alike."""
    rng = np.random.default_rng(SEED)
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    w, mean, t = np.zeros(x.shape[1], np.float64), np.zeros(x.shape[1]), 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            rate = 1 / (REGULARIZATION * (t + 1000))
            bad = at[y[at] * (x[rows[at]] @ w) < 1]
            w *= 1 - rate * REGULARIZATION
            if len(bad):
                w += rate / len(at) * ((y[bad] * weight[bad]) @ x[rows[bad]]) / 100
            mean += (w - mean) / t
    scale = np.mean([np.abs(x[rows[lo : lo + 256]] @ mean).mean() for lo in range(0, len(rows), 256)]) or 1.0
    return mean / scale


def _pairs(x: np.ndarray, y: np.ndarray, classes: list[str]) -> list[Machine]:
    """A machine for each two classes, fitted on their rows, which are not copied."""
    out = []
    for a, b in combinations(sorted(classes), 2):
        rows = np.flatnonzero((y == a) | (y == b))
        out.append(Machine(a, b, _svm(x, rows, np.where(y[rows] == a, 1.0, -1.0)).astype(np.float32)))
    return out


def fit_languages(docs: DataFrame, train: Column, rows: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on about `rows` documents of each language for which the condition `train` holds, fewer where there are many languages or long texts.

    Rows without text or lang are not learned from; the sample is drawn by rows, so
    repeated ids or texts and null ids neither all pass nor all fail. With no
    labelled row nothing can be predicted and every result is und; with one language
    all is that one.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(train)
    known = known.select("text", "lang", F.octet_length("text").alias("size")).where(F.col("size") <= LONGEST)
    count = known.groupBy("lang").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).toPandas()  # one row a language
    each = min(rows, SAMPLE_ROWS // max(len(count), 1), int(SAMPLE_BYTES / max(count["mean"].sum(), 1)) if len(count) else rows)
    # an even chance for each row of a language, so that about `each` of them pass
    share = docs.sparkSession.createDataFrame([(lang, each / n) for lang, n in zip(count["lang"], count["n"].tolist(), strict=True)], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.octet_length("text")), F.lit(1_000_000))
    drawn = known.withColumn("chance", chance).join(F.broadcast(share), "lang").where(F.col("chance") < F.col("share") * 1_000_000)
    sample = materialize(drawn.select("lang", "text"), "lang-train").toPandas()
    y = sample["lang"].to_numpy(str)
    x = _vectors(sample["text"].tolist())
    families: dict[str, list[str]] = {}
    for lang in sorted(set(y)):
        families.setdefault(family(lang), []).append(lang)
    own = np.array([family(lang) for lang in y])
    return LanguageModel(families, _pairs(x, own, list(families)), {f: _pairs(x, y, langs) for f, langs in families.items()})


def _vote(machines: list[Machine], classes: list[str], margins: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner (number in classes) by votes, margins on ties, and its weakest confidence."""
    votes, sums, least = np.zeros((rows, len(classes))), np.zeros((rows, len(classes))), np.full((rows, len(classes)), 20.0)
    for m, margin in zip(machines, margins, strict=True):
        for name, sign in ((m.a, 1), (m.b, -1)):
            c = classes.index(name)
            votes[:, c] += sign * margin > 0
            sums[:, c] += sign * margin
            least[:, c] = np.minimum(least[:, c], sign * margin)
    best = np.argmax(votes + 0.5 * np.tanh(sums / 10), axis=1)
    return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(rows), best], -6, 6)))


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    A text that is null or has no letter gives und and score 0. Rows are kept as
    they are; columns of docs named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    names = list(model.families)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def margins(machines: list[Machine], at: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        size, out = np.diff(offsets), []
        for m in machines:
            sums = np.concatenate([[0.0], np.cumsum(m.weights[at], dtype=np.float64)])
            out.append((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1) * 100 + m.weights[-1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for lo, hi, at, offsets in _texts(b.column("__text")) if names else ():
                n = hi - lo
                fam, sure = _vote(own.between, names, margins(own.between, at, offsets), n)
                for f, name in enumerate(names):
                    rows = np.flatnonzero(fam == f)
                    if len(rows):
                        langs = own.families[name]
                        best, p = _vote(own.within[name], langs, margins(own.within[name], at, offsets), n)
                        pred[lo + rows], score[lo + rows] = np.array(langs, object)[best[rows]], (sure * p)[rows]
            letters = b.column("__letters").to_numpy(zero_copy_only=False)
            pred[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names[:-2], "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("lang_pred string, score double").fields])
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__text": text, "__letters": text.rlike(r"\p{L}")}).mapInArrow(run, schema)


def held_out(col: str = "doc_id") -> Column:
    return fold_of(F.col(col), 4) == 2


def op3_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs, ~held_out())
    return predict_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
