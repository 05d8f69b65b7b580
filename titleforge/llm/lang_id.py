"""Operator 5: language identification by string kernels.

Kernel: blended spectrum of presence, k(x, z) = shared n-grams / sqrt(n-grams of x * n-grams of z), n-grams of 1 to 3 letters
hashed to a fixed number of features. Nyström: documents of the sample serve as landmarks; with K the kernel matrix among
them, phi(x) = K^(-1/2) k(x). One-versus-rest kernel ridge regression on phi gives a column of weights for each language.
Prediction is two matrix products for a batch of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import modest_batches

#: Number of hashed n-gram features.
FEATURES = 8192
#: Bound of the labelled sample that the classifier is fitted on, over all languages, and of the landmarks among it.
SAMPLE, LANDMARKS = 1600, 160
RIDGE = 1e-3
UNDETERMINED = "und"
#: From this score on a language claims a text: regression value 0, halfway between a language's own texts and others'.
CLAIM = 0.5

_WORDLIKE = re.compile(r"[^\W\d_]")
_LATIN = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; numerals such as a superscript two or a half are none."""
    return text is not None and any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed n-grams of its lower-case letters it has."""
    found = np.zeros((len(texts), FEATURES), np.float32)
    coded = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    row = 0
    while row < len(coded):  # long texts by themselves, short ones together
        until, total = row, 0
        while until < len(coded) and (until == row or total + len(coded[until]) < 200_000):
            total += len(coded[until]) + 2
            until += 1
        group = [x for c in coded[row:until] for x in (c, np.array([32, 32], np.uint32))]
        letters = np.concatenate(group)
        low = letters < 0x250
        letters = np.where(low, _LATIN[np.where(low, letters, 0)], letters)
        rows = np.repeat(np.arange(row, until), [len(c) + 2 for c in coded[row:until]])
        flat = found.reshape(-1)
        base = rows * FEATURES
        hashed = letters * np.uint32(0x9E3779B1)
        for n in (1, 2, 3):
            if n > 1:
                hashed = (hashed[:-1] ^ (letters[n - 1 :] + np.uint32(n))) * np.uint32(0x85EBCA6B)
                hashed ^= hashed >> np.uint32(15)
            within = rows[: len(hashed)] == rows[n - 1 :]  # no n-gram reaches into the next text
            flat[(base[: len(hashed)] + (hashed >> np.uint32(19)).astype(np.int64))[within]] = 1.0
        row = until
    return found


def _kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(x.sum(1), 1.0))[:, None] * np.sqrt(np.maximum(z.sum(1), 1.0))[None, :]
    return (x @ z.T) / sizes


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text. The score is the best regression value, from -1 to 1, brought to 0 to 1."""
        lettered = [i for i, t in enumerate(texts) if has_letter(t)]
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if self.languages:
            for at in range(0, len(lettered), 64):
                part = lettered[at : at + 64]
                values = _kernel(presence([texts[i] for i in part]), self.landmarks) @ self.weights
                for i, best in zip(part, values.argmax(1).tolist(), strict=True):
                    labels[i] = self.languages[best]
                for i, value in zip(part, values.max(1).tolist(), strict=True):
                    scores[i] = round(min(1.0, max(0.0, (value + 1) / 2)), 6)
        return labels, scores


def fit(features: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From the presence rows of a labelled sample, in a fixed order. Every language gets landmarks."""
    languages = sorted(set(labels), key=lambda x: x.encode())
    if not languages:
        return Model([], np.zeros((0, FEATURES), np.float32), np.zeros((0, 0), np.float32))
    chosen = [i for lang in languages for i in [j for j, x in enumerate(labels) if x == lang][: max(1, landmarks // len(languages))]]
    z = features[chosen]
    values, vectors = np.linalg.eigh(_kernel(z, z).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # K^(-1/2) up to a rotation
    phi = _kernel(features, z).astype(np.float64) @ root
    targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    counts = np.maximum((targets > 0).sum(0), 1)  # languages count alike
    each = (1.0 / counts)[np.array([languages.index(x) for x in labels])] * len(labels) / len(languages)
    weighed = phi * each[:, None]
    solved = np.linalg.solve(phi.T @ weighed + ridge * len(labels) * np.eye(phi.shape[1]), weighed.T @ targets)
    return Model(languages, z, (root @ solved).astype(np.float32))


def held_out(doc_id: F.Column) -> F.Column:
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """From at most `sample` documents with a language, spread evenly over the languages and chosen by a hash of their id.

    Ids are ranked first, without texts; only the chosen texts are read, and only their feature bits reach the driver.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    names = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not names:
        return fit(np.zeros((0, FEATURES), np.float32), [])
    each = max(1, sample // len(names))
    place = F.xxhash64("doc_id")
    ranked = labelled.select("doc_id", "lang", place.alias("place")).withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id")))
    ids = [r[0] for r in ranked.filter(F.col("nth") <= each).select("doc_id").distinct().collect()]

    def bits(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                packed = [np.packbits(row > 0).tobytes() for row in presence([t if has_letter(t) else "" for t in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])

    chosen = labelled.filter(F.col("doc_id").isin(ids)).select("doc_id", "lang", "text").mapInArrow(bits, "doc_id long, lang string, bits binary")
    rows = chosen.groupBy("doc_id").agg(F.min(F.struct("lang", "bits")).alias("row")).collect()
    rows = sorted((hash_order(r["doc_id"]), r["row"]["lang"], r["row"]["bits"]) for r in rows)
    features = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for _, _, b in rows]).astype(np.float32) if rows else np.zeros((0, FEATURES), np.float32)
    return fit(features, [lang for _, lang, _ in rows], landmarks)


def hash_order(doc_id: int) -> tuple[int, int]:
    """A fixed order without regard to how rows arrive."""
    return (doc_id * 0x9E3779B97F4A7C15 & (2**64 - 1), doc_id)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Returns for each row of docs: doc_id, held_out, lang_pred, score.

    Null text or text without a letter: und, score 0. Without any labelled document all are und. Empty and very long texts are
    taken whole. Equal texts get equal predictions; id, language and source are no inputs. Other columns are ignored.
    """
    model = model or train(docs)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                labels, scores = model.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return modest_batches(docs).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")


def settle(stated: str | None, predicted: str, score: float, languages: list[str]) -> str:
    """The language of a text with letters. The predicted one, if it claims the text; otherwise the stated one, or und. A stated
    language that was never learned stays, as no prediction can be that one. With fewer than two learned languages there is
    nothing to tell apart: then a stated one stays and a missing one is filled in."""
    if stated is not None and (score < CLAIM or stated not in languages or len(languages) < 2):
        return stated
    return predicted if score >= CLAIM or len(languages) < 2 else UNDETERMINED


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without those that have no text or no letter; lang becomes what `settle` says: what the text shows wins over what was
    stated."""
    model = model or train(docs)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            names = batch.schema.names
            at_text, at_lang = names.index("text"), names.index("lang")
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(at_text).to_pylist()
                labels, scores = model.predict(texts)
                stated = part.column(at_lang).to_pylist()
                langs = [settle(*row, model.languages) for row in zip(stated, labels, scores, strict=True)]
                kept = pa.array([has_letter(t) for t in texts], pa.bool_())
                columns = [pa.array(langs, pa.string()) if i == at_lang else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names).filter(kept)

    return modest_batches(docs).mapInArrow(batches, docs.schema)
