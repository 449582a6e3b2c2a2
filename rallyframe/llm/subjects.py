"""Subject areas of documents.

Method: one-versus-rest linear classifiers on hashed word n-grams, one per
subject, that judge single sentences.  The labels are weak: a document's label
holds for its sections, not for each sentence, so training alternates between
fitting the classifiers and giving each sentence of a labelled document those
of the document's subjects that the classifiers see in it.  Sentences of test
items serve as examples of no subject.  Thresholds are calibrated per subject on
held-out labelled documents, for the document rule: a subject counts if enough
sentences deal with it, or all that deal with anything.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallyframe.llm.text_forms import folded
from rallyframe.util import shuffle_partitions, widened

BITS = 17
MAX_LABELLED = 4000
MAX_NEGATIVE = 2000
MAX_CHARACTERS = 64_000_000
ENOUGH = 3
LONG = 36
STRETCH = 13
ROUNDS = 4
STEPS = 60
RIDGE = 1e-5
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_BREAK = re.compile(r"(?<=[.!?])[\"”’')]*\s+|\n\s*\n")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text that hold letters; markup is dropped, a blank line ends a sentence.

    Text that runs on for more than ``LONG`` words without a full stop is cut
    into stretches of ``STRETCH`` words, about a sentence each.
    """
    if not text:
        return []
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    parts = []
    for part in _BREAK.split(text):
        words = part.split()
        step = len(words) if len(words) <= LONG else STRETCH
        parts += [" ".join(words[k : k + step]) for k in range(0, len(words), max(step, 1))]
    return [x for x in parts if any(c.isalpha() for c in x)]


class Hasher:
    """Word 1- and 2-grams of a sentence as hashed indices; numbers are alike."""

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1
        self.codes: dict[str, int] = {}

    def __call__(self, sentence: str) -> np.ndarray:
        codes = []
        for w in _TOKEN.findall(folded(sentence)):
            w = "0" if w[0].isdigit() else w
            code = self.codes.get(w)
            if code is None:
                if len(self.codes) > 500_000:
                    self.codes.clear()
                code = self.codes[w] = zlib.crc32(w.encode())
            codes.append(code)
        one = np.array(codes, dtype=np.int64)
        two = (one[:-1] * 31 + one[1:]) * 2654435761 >> 7
        return np.unique(np.concatenate([one, two]) & self.mask)


def rows_of(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    return flat, np.repeat(np.arange(len(features)), sizes)


@dataclass
class SubjectModel:
    """Weights (features x subjects), bias, and the sentence threshold of each subject."""

    subjects: list[str]
    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        """Probability of each subject for each sentence."""
        flat, row = rows_of(features)
        z = np.zeros((len(features), len(self.subjects)))
        size = np.sqrt(np.maximum(np.bincount(row, minlength=len(features)), 1))
        for c in range(len(self.subjects)):
            z[:, c] = np.bincount(row, self.weights[flat, c], len(features)) / size + self.bias[c]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def subjects_of(self, scores: np.ndarray, doc: np.ndarray, docs: int, enough: int = ENOUGH) -> np.ndarray:
        """(docs, subjects) verdicts from the scores of sentences and the document of each."""
        best = scores / self.thresholds
        deals = (best >= 1) & (best >= best.max(axis=1, keepdims=True))
        count = np.zeros((docs, len(self.subjects)))
        np.add.at(count, doc, deals)
        dealt = np.bincount(doc, deals.any(axis=1), docs)
        return (count >= enough) | ((count > 0) & (count == dealt[:, None]))


def _fit_one(flat: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic fit of one subject by Adagrad over the whole sample: (used features, their weights, bias)."""
    n = len(y)
    size = np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    order = np.argsort(flat, kind="stable")
    of = row[order]
    used, sorted_place = np.unique(flat[order], return_inverse=True)
    place = np.empty_like(sorted_place)
    place[order] = sorted_place
    x, bias = np.zeros(len(used)), -1.0
    gx, gb = np.full(len(used), 1e-6), 1e-6
    for _ in range(STEPS):
        z = np.bincount(row, x[place], n) / size + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(sorted_place, (error / size)[of], len(used)) / n + RIDGE * x
        gx += g * g
        x -= 0.5 * g / np.sqrt(gx)
        db = error.sum() / n
        gb += db * db
        bias -= 0.5 * db / np.sqrt(gb)
    return used, x, bias


class LocalFits:
    """One-versus-rest fits of all subjects on a sample, one after the other."""

    def __init__(self, flat: np.ndarray, row: np.ndarray):
        self.flat, self.row = flat, row

    def __call__(self, y: np.ndarray, weight: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((1 << bits, y.shape[1]), np.float32), np.zeros(y.shape[1])
        for c, (used, x, bias) in self.fits(y, weight):
            w[used, c], b[c] = x, bias
        return w, b

    def fits(self, y: np.ndarray, weight: np.ndarray):
        for c in range(y.shape[1]):
            yield c, _fit_one(self.flat, self.row, y[:, c], weight[:, c])


class SparkFits(LocalFits):
    """The same fits, one task a subject, over the broadcast sample (bounded by ``MAX_LABELLED`` and ``MAX_CHARACTERS``)."""

    def __init__(self, spark: SparkSession, flat: np.ndarray, row: np.ndarray):
        self.spark = spark
        self.sample = spark.sparkContext.broadcast((flat.astype(np.int32), row.astype(np.int32)))

    def fits(self, y: np.ndarray, weight: np.ndarray):
        sample, marks = self.sample, self.spark.sparkContext.broadcast((y.astype(np.float32), weight.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, row = (x.astype(np.int64) for x in sample.value)
            for batch in batches:
                for c in batch.column(0).to_pylist():
                    used, x, bias = _fit_one(flat, row, *(m[:, c].astype(float) for m in marks.value))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c]), pa.array([used.astype(np.int32).tobytes()]), pa.array([x.tobytes()]), pa.array([bias])], names=["c", "used", "x", "bias"]
                    )

        k = y.shape[1]
        rows = self.spark.range(0, k, 1, k).mapInArrow(run, "c bigint, used binary, x binary, bias double")
        for r in rows.collect():  # one row a subject, at most 2 ** BITS weights each
            yield r.c, (np.frombuffer(r.used, np.int32), np.frombuffer(r.x), r.bias)
        marks.unpersist()


Sample = list[tuple[list[np.ndarray], set[str]]]


def train_subjects(labelled: Sample, negatives: list[list[np.ndarray]], subjects: list[str], bits: int = BITS, spark: SparkSession | None = None) -> SubjectModel:
    """Fit on (features of sentences, subjects) of documents; ``negatives`` are sentences of texts of no subject."""
    index = {s: i for i, s in enumerate(subjects)}
    features, doc, own = [], [], []
    for d, (parts, names) in enumerate(labelled):
        mark = np.zeros(len(subjects), bool)
        mark[[index[s] for s in names if s in index]] = True
        features += parts
        doc += [d] * len(parts)
        own += [mark] * len(parts)
    for parts in negatives:
        features += parts
        doc += [-1] * len(parts)
        own += [np.zeros(len(subjects), bool)] * len(parts)
    own, doc = np.array(own).reshape(-1, len(subjects)), np.array(doc)
    flat, row = rows_of(features)
    fits = SparkFits(spark, flat, row) if spark else LocalFits(flat, row)
    single = own.sum(axis=1) == 1
    y = own.astype(float)
    weight = np.where((own & ~single[:, None]), 0.0, 1.0)  # which of several subjects: not yet known
    model = SubjectModel(subjects, *fits(y, weight, bits), np.full(len(subjects), 0.5), bits)
    for _ in range(ROUNDS - 1):
        p = model.scores(features)
        inside = np.where(own, p, 0.0)
        best = inside >= inside.max(axis=1, keepdims=True)
        alien = (p >= 0.5) & ~own & (p > 2 * inside.max(axis=1, keepdims=True))
        y = (own & best & (inside > 0.2)).astype(float)
        weight = np.where(own & best & (inside <= 0.5) & (inside > 0.2), 0.5, 1.0)
        weight = np.where(alien.any(axis=1, keepdims=True), 0.0, weight)  # a passing sentence, or a wrong label
        weight[doc < 0] = 1.0
        model.weights, model.bias = fits(y, weight, bits)
    return model


def calibrate(model: SubjectModel, held_out: Sample) -> SubjectModel:
    """Choose each subject's threshold by the F1 of the document rule on ``held_out``."""
    parts = [p for p, _ in held_out]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    scores = model.scores([f for p in parts for f in p])
    truth = np.array([[s in names for s in model.subjects] for _, names in held_out]).reshape(-1, len(model.subjects))
    grid = (0.5, 0.4, 0.6, 0.3, 0.7)
    best = model.thresholds.copy()
    for c in range(len(model.subjects)):
        top = -1.0
        for value in grid:
            model.thresholds = best.copy()
            model.thresholds[c] = value
            got = model.subjects_of(scores, doc, len(parts))[:, c]
            hit = (got & truth[:, c]).sum()
            f1 = 2 * hit / max(1, got.sum() + truth[:, c].sum())
            if f1 > top + 1e-3:
                top, keep = f1, value
        best[c] = keep
    model.thresholds = best
    return model


def featured(text: str | None, hasher: Hasher) -> list[np.ndarray]:
    return [hasher(s) for s in sentences(text)]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        parts = [[f.tolist() for f in featured(t, hasher)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.list_(pa.int32()))), batch.column(2)], names=["id", "parts", "subjects"])


def _sample(rows: DataFrame, bound: int) -> Sample:
    """Features of at most ``bound`` rows (id, text, subjects) and ``MAX_CHARACTERS`` of text, taken by a hash of their id."""
    order = [F.xxhash64("id"), F.col("id")]
    chosen = rows.orderBy(*order).limit(bound)  # bounded sample for fitting only
    so_far = F.sum(F.length("text")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1))  # at most ``bound`` rows
    chosen = chosen.withColumn("so_far", F.coalesce(so_far, F.lit(0))).where(F.col("so_far") < MAX_CHARACTERS)
    chosen = chosen.select("id", "text", "subjects").repartition(shuffle_partitions(rows.sparkSession))
    held = chosen.mapInArrow(_featured, "id bigint, parts array<array<int>>, subjects array<string>").toPandas()
    held = held.sort_values("id", key=lambda x: x * 2654435761 % (1 << 31))  # an order that does not depend on arrival
    return [([np.asarray(f, np.int64) for f in p], set(s)) for p, s in zip(held["parts"], held["subjects"])]


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Sample:
    """Features and subjects of at most ``bound`` labelled documents, chosen by a hash of their id."""
    marks = labels.where("doc_id is not null and subject is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.collect_set("subject").alias("subjects"))
    rows = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return _sample(rows.join(marks, "id"), bound)


def document_subjects(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, test_items: DataFrame | None = None,
    max_labelled: int = MAX_LABELLED, max_negative: int = MAX_NEGATIVE, judged: DataFrame | None = None,
) -> DataFrame:
    """Subjects of every document: doc_id, subject, score (the best sentence's).

    The classifiers are fitted on at most ``max_labelled`` labelled documents
    (a fifth of them calibrates the thresholds) and ``max_negative`` test items,
    of at most ``MAX_CHARACTERS`` each; every document is judged, whole, or those
    of ``judged`` (doc_id, text) if given.  A subject counts if three sentences
    deal with it, or all sentences that deal with any.  Null, empty and blank
    texts, texts without letters and texts without words on any subject give no
    row.  Labels of unknown documents or subjects and null labels are ignored;
    without any label nothing is assigned.  Further columns are ignored.
    """
    spark = documents.sparkSession
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().collect())
    sample = labelled_sample(documents, labels, max_labelled)
    out = "doc_id bigint, subject string, score double"
    if not sample or not names:
        return spark.createDataFrame([], out)
    negatives = []
    if test_items is not None:
        nothing = F.array().cast("array<string>").alias("subjects")
        held = test_items.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("id"), "text", nothing)
        negatives = [p for p, _ in _sample(held, max_negative)]
    cut = max(1, len(sample) // 5)
    model = calibrate(train_subjects(sample[cut:] or sample, negatives, names, spark=spark), sample[:cut])
    weights = model.weights.astype(np.float16)
    rest = (model.subjects, model.bias, model.thresholds, model.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = SubjectModel(rest[0], weights.astype(np.float32), *rest[1:])
        hasher = Hasher(judge.bits)
        for batch in batches:
            parts = [[hasher(s) for s in sentences(t)] for t in batch.column(1).to_pylist()]
            doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            if not len(doc):
                continue
            scores = judge.scores([f for p in parts for f in p])
            d, c = np.nonzero(judge.subjects_of(scores, doc, len(parts)))
            top = np.zeros((len(parts), len(judge.subjects)))
            np.maximum.at(top, doc, scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(d)), pa.array([judge.subjects[x] for x in c], pa.string()), pa.array(top[d, c])],
                names=["doc_id", "subject", "score"],
            )

    slim = (documents if judged is None else judged).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return widened(slim).mapInArrow(run, out)
