"""Language identification by hierarchical discrimination.

A text's hashed byte trigrams (lower-cased ASCII, other ASCII as blanks) are
looked up in weight tables. Linear support vector machines, one for each pair of
classes, first decide between language families and then, within the family
chosen, between its languages. Training fits on a bounded sample of labelled
rows; prediction covers every byte of every text, without a shuffle.

Defined cases: a null text, or one without any letter, is ``und`` with score 0.
Without labelled training rows all texts are ``und``; with one language all
others get that one. Repeated rows and null ids are predicted like any others;
languages that no family lists are families of their own. predict_language() keeps
every column but those of the names it is given for its results, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fabula.llm import words as W
from fabula.llm.cluster import materialize

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}
BITS = 12
#: Labelled rows of one language that training uses at most.
ROWS_PER_LANGUAGE = 400
#: Languages that are learned at most, the most frequent labels first.
LANGUAGES = 256
_SCALE = 100.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams and the text each belongs to."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[data].astype(np.uint32)
    code = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = owner[:-2] == owner[2:]
    return code[inside].astype(np.int64), owner[:-2][inside]


def has_letter(texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[at[1:]] > seen[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


@dataclass
class SparseRows:
    """Rows of a matrix: column numbers and values one after the other, and where each row begins."""

    code: np.ndarray
    value: np.ndarray
    at: np.ndarray
    width: int

    def times(self, z: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * z[self.code])])
        return total[self.at[1:]] - total[self.at[:-1]]

    def transposed_times(self, s: np.ndarray) -> np.ndarray:
        return np.bincount(self.code, self.value * np.repeat(s, np.diff(self.at)), self.width)


def fit_svm(x: SparseRows, y: np.ndarray, c: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge) by accelerated gradient steps; y is 1 or -1. Classes
    weigh the same."""
    share = c / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    v = np.ones(x.width)
    for _ in range(10):
        v = x.transposed_times(share * x.times(v))
        top = float(np.linalg.norm(v))
        v /= top or 1
    step = 1 / (2 * (top + c) + 0.01)
    w = z = np.zeros(x.width)
    b = zb = 0.0
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x.times(z) + zb)) * y * share
        new, nb = z + step * (2 * x.transposed_times(slack) - 0.001 * z), zb + step * 2 * float(slack.sum())
        k = t / (t + 3)
        z, zb = new + k * (new - w), nb + k * (nb - b)
        w, b = new, nb
    return w, b


def held_out(id_col: str = "doc_id", of: int = 4, rest: int = 2) -> Column:
    """crc32 of the id as text, modulo ``of``, is ``rest``; a null id never is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(-1)) % of == rest


@dataclass
class Hierarchy:
    """Weight tables (a column per machine) and which classes each machine separates."""

    families: dict[str, list[str]]
    machines: list[tuple[str, str]]  # (positive, negative): families "f:..." or languages
    weights: np.ndarray
    biases: np.ndarray

    def choose(self, margins: np.ndarray, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Votes of the pairs among ``classes``; ties go to the larger mean probability."""
        if len(classes) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        place = {c: i for i, c in enumerate(classes)}
        total = np.zeros((len(margins), len(classes)))
        votes = np.zeros_like(total)
        for j, (a, b) in enumerate(self.machines):
            if a in place and b in place:
                p = 1 / (1 + np.exp(-np.clip(2 * margins[:, j], -50, 50)))
                total[:, place[a]] += p
                total[:, place[b]] += 1 - p
                votes[:, place[a]] += p >= 0.5
                votes[:, place[b]] += p < 0.5
        mean = total / (len(classes) - 1)
        best = np.argmax(votes + mean / 2, axis=1)
        return best, mean[np.arange(len(mean)), best]

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = sorted(self.families)
        family, p = self.choose(margins, [f"f:{n}" for n in names])
        lang = np.empty(len(margins), object)
        score = np.zeros(len(margins))
        for i, name in enumerate(names):
            rows = np.flatnonzero(family == i)
            if len(rows):
                inner, q = self.choose(margins[rows], self.families[name])
                lang[rows] = np.array(self.families[name], object)[inner]
                score[rows] = p[rows] * q
        return lang, score


def _sample(docs: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """At most ``most`` rows of each language, by the hash of id and text."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 3.0 * most / n))).otherwise(share)
    near = docs.withColumn("place", place).where(F.col("place") <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank", "place")


def _trigram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shares of a text's trigrams, and those of a stretch of 80 bytes of it."""
    for batch in batches:
        rows: list[tuple] = []
        for part in W.slices(batch, "text", 1 << 20):
            data, at = W.buffers(part.column("text"))
            for i, lang in enumerate(part.column("lang").to_pylist()):
                text = data[at[i] : at[i + 1]]
                middle = len(text) // 2
                for piece in (text, text[middle : middle + 80]):
                    code, n = np.unique(features(piece, np.array([0, len(piece)]))[0], return_counts=True)
                    if len(code):
                        rows.append((lang, code.astype(np.int16).tobytes(), (n * (_SCALE / n.sum())).astype(np.float32).tobytes()))
        kinds = [pa.string(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["lang", "codes", "shares"])
        W.release()


def fit_hierarchy(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES, languages: int = LANGUAGES) -> Hierarchy | None:
    """Trains on rows (doc_id, text, lang), of the most frequent ``languages``. Each sampled
    text gives its own features and those of a stretch of 80 bytes, so that short texts are
    known as well. Every machine is fitted by a task of its own; only weights come back."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return None
    rows = materialize(_sample(labelled, counts, rows_per_language).mapInArrow(_trigram_rows, "lang string, codes binary, shares binary"), "trigrams")
    of = {lang: name for name, langs in families.items() for lang in langs}
    tree: dict[str, list[str]] = {}
    for lang in sorted(r["lang"] for r in rows.select("lang").distinct().collect()):
        tree.setdefault(of.get(lang, lang), []).append(lang)
    if not tree:
        return None
    machines = [("f:" + a, "f:" + b) for a, b in combinations(sorted(tree), 2)] + [x for langs in tree.values() for x in combinations(langs, 2)]
    classes = {lang: {lang, "f:" + name} for name, langs in tree.items() for lang in langs}
    takes = {lang: [j for j, x in enumerate(machines) if classes[lang] & set(x)] for lang in classes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = [takes[lang] for lang in batch.column("lang").to_pylist()]
            row = np.repeat(np.arange(len(batch)), [len(m) for m in many])
            machine = pa.array([j for m in many for j in m], pa.int32())
            yield pa.RecordBatch.from_arrays([machine, *(c.take(pa.array(row)) for c in batch.columns)], names=["machine", *batch.schema.names])

    def fit(table: pa.Table) -> pa.Table:
        given = sorted(table.select(["lang", "codes", "shares"]).to_pylist(), key=lambda r: (r["lang"], r["codes"], r["shares"]))
        j = table.column("machine")[0].as_py()
        codes = [np.frombuffer(r["codes"], np.int16) for r in given]
        x = SparseRows(np.concatenate(codes).astype(np.int64), np.concatenate([np.frombuffer(r["shares"], np.float32) for r in given]).astype(np.float64), np.concatenate([[0], np.cumsum([len(c) for c in codes])]), 1 << BITS)
        w, bias = fit_svm(x, np.array([1.0 if machines[j][0] in classes[r["lang"]] else -1.0 for r in given]))
        W.release()
        return pa.table({"machine": pa.array([j], pa.int32()), "weights": pa.array([(w * _SCALE).astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    dealt = rows.mapInArrow(deal, "machine int, lang string, codes binary, shares binary")
    fitted = sorted(dealt.groupBy("machine").applyInArrow(fit, "machine int, weights binary, bias double").collect()) if machines else []
    weights = np.stack([np.frombuffer(r["weights"], np.float32) for r in fitted], 1) if fitted else np.zeros((1 << BITS, 0), np.float32)
    return Hierarchy(tree, machines, weights, np.array([r["bias"] for r in fitted]))


def predict_language(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The rows with ``lang_col`` and ``score_col``, in place of any columns of these names;
    all others are kept."""
    made = (lang_col, score_col)
    kept = [i for i, name in enumerate(docs.columns) if name not in made]
    out = StructType([*(docs.schema[i] for i in kept), StructField(lang_col, StringType()), StructField(score_col, DoubleType())])
    at_text = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in W.slices(numbered, f"c{at_text}", 1 << 20):
                texts = part.column(at_text)
                data, at = W.buffers(texts)
                n = len(part)
                lang, score = np.full(n, "und", object), np.zeros(n)
                if model is not None:
                    code, owner = features(data, at)
                    total = np.maximum(np.bincount(owner, minlength=n), 1)
                    margins = np.stack([np.bincount(owner, model.weights[:, j][code], n) / total + model.biases[j] for j in range(len(model.machines))], 1) if model.machines else np.zeros((n, 0))
                    known = has_letter(texts, data, at)
                    lang[known], score[known] = (x[known] for x in model.predict(margins))
                arrays = [*(part.column(i) for i in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)
            W.release()

    return docs.mapInArrow(predict, out)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", of: int = 4, rest: int = 2) -> DataFrame:
    """Trains on the rows that are not held out and predicts all: doc_id, held_out,
    lang_pred, score."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col, of, rest).alias("held_out"))
    model = fit_hierarchy(d.where(~F.col("held_out")).drop("held_out"))
    return predict_language(d.drop("lang"), model).drop("text")
