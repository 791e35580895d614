"""Toxicity scores from a counterfactual-regularised linear classifier.

A text is a bag of words and word starts (hashed), weighted by log(1 + count) and scaled to unit length. Logistic regression is
trained on a bounded sample of labelled texts. Where a labelled text names a group of people, a counterfactual copy is made in which each
identity term is swapped for another of its set, and the squared difference of the two scores is added to the loss, so that
naming a group does not move the score. The scores are calibrated on a part of the sample that training does not
see. The sample is bounded in rows and bytes and is fitted in one task; the driver gets the weights only. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from leadspark.llm.common import fresh, text_mark, whole_text

SAMPLE = 12_000         # most labelled texts that training sees
SAMPLE_BYTES = 1 << 26  # most bytes of text that training sees; the fitting task holds their words as numbers
BLOCK = 1 << 18         # entries summed at a time
KNOWN_WORDS = 200_000   # words whose weight a task keeps
FEATURES = 1 << 18
RIDGE = 3e-5
FAIRNESS = 1.0          # weight of the counterfactual penalty
STEPS = 80
RATE = 0.3
THRESHOLD = 0.3
CALIBRATION = 5         # one text in so many calibrates

IDENTITY_SETS = (  # Fixed values: terms of one set are swapped for each other
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "refugees"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str) -> Counter:
    """Lower-cased words and how often they occur."""
    return Counter(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def features(word: bytes) -> list[int]:
    """Feature numbers of a word: the word and its starts of 4 to 8 bytes."""
    out = [crc32(word) % FEATURES]
    for k in range(4, min(9, len(word))):
        out.append(crc32(word[:k], k) % FEATURES)
    return out


def terms_of(sets: tuple[tuple[str, ...], ...] = IDENTITY_SETS) -> dict[bytes, tuple[int, tuple[bytes, ...]]]:
    """Each identity term to its place in its set and the set."""
    return {t.encode(): (i, tuple(x.encode() for x in terms)) for terms in sets for i, t in enumerate(terms)}


def counterfactual(bag: Counter, terms: dict[bytes, tuple[int, tuple[bytes, ...]]], turn: int) -> Counter:
    """The words with each identity term swapped for another of its set; ``turn`` says which. Empty without any term."""
    out: Counter = Counter()
    if any(w in terms for w in bag):
        for w, n in bag.items():
            i, own = terms.get(w, (0, (w,)))
            out[own[(i + 1 + turn % max(1, len(own) - 1)) % len(own)]] += n
    return out


def _training_rows(terms: dict[bytes, tuple[int, tuple[bytes, ...]]]):
    """Arrow mapper from (label, mark, text) to words and counts; the counterfactual ones are empty without identity terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [words(text) for text in batch.column(2).to_pylist()]
            others = [counterfactual(bag, terms, xxhash.xxh32_intdigest(text.encode("utf-8", "replace")))
                      for bag, text in zip(bags, batch.column(2).to_pylist())]
            columns = [pa.array(map(part, some), kind) for some in (bags, others)
                       for part, kind in ((list, pa.list_(pa.binary())), (lambda bag: list(bag.values()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["label", "mark", "words", "counts", "other_words", "other_counts"])
    return run


class Bags:
    """Bags of words as sparse rows over a vocabulary: for each entry its word number, value and row number.

    A row has unit length over the features of its words, so a feature's weight counts for every word that has it.
    """

    def __init__(self, word: np.ndarray, count: np.ndarray, row: np.ndarray, n: int, vocabulary: Vocabulary):
        value = np.log1p(count.astype(np.float32))
        norm = np.sqrt(np.bincount(row, weights=value * value * vocabulary.width[word], minlength=n))
        self.word, self.row, self.n = word, row, n
        self.value = value / np.maximum(1e-9, norm)[row].astype(np.float32)

    def logits(self, word_weights: np.ndarray) -> np.ndarray:
        return self._sums(self.row, self.value, word_weights, self.word, self.n)

    def pull(self, errors: np.ndarray, size: int) -> np.ndarray:
        """What each word gathers from the errors of its rows."""
        return self._sums(self.word, self.value, errors, self.row, size)

    @staticmethod
    def _sums(into: np.ndarray, value: np.ndarray, other: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for lo in range(0, len(into), BLOCK):       # temporary arrays stay small
            part = slice(lo, lo + BLOCK)
            out += np.bincount(into[part], weights=value[part] * other[at[part]], minlength=n)
        return out


class Vocabulary:
    """The features of numbered words as sparse rows."""

    def __init__(self, all_words: list[bytes]):
        sizes = np.fromiter(map(len, all_words), dtype=np.int32, count=len(all_words))
        self.width = 1 + np.clip(sizes, 4, 9) - 4
        self.feature = np.fromiter((f for w in all_words for f in features(w)), dtype=np.int32, count=int(self.width.sum()))
        self.word = np.repeat(np.arange(len(all_words), dtype=np.int32), self.width)
        if not len(all_words):
            self.width = np.zeros(1, dtype=np.int32)
        self.size = len(self.width)

    def weights(self, weights: np.ndarray) -> np.ndarray:
        """The weight of each word."""
        return np.bincount(self.word, weights=weights[self.feature], minlength=self.size)

    def gradient(self, word_gradient: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, weights=word_gradient[self.word], minlength=FEATURES)


def fit(vocabulary: Vocabulary, x: Bags, y: np.ndarray, first: Bags, second: Bags, fairness: float = FAIRNESS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias. ``x``: a row for each label; ``first`` and ``second``: texts and their counterfactuals, row by row."""
    weights, bias = np.zeros(FEATURES), -1.0
    mean, spread = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, steps + 1):
        of_word = vocabulary.weights(weights)
        error = 1 / (1 + np.exp(-(x.logits(of_word) + bias))) - y
        pull = x.pull(error, vocabulary.size) / max(1, x.n)
        if first.n:
            gap = (first.logits(of_word) - second.logits(of_word)) * (2 * fairness / first.n)
            pull += first.pull(gap, vocabulary.size) - second.pull(gap, vocabulary.size)
        gradient = np.append(vocabulary.gradient(pull) + RIDGE * weights, error.mean() if x.n else 0.0)
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.99 * spread + 0.01 * gradient ** 2
        step = RATE * (mean / (1 - 0.9 ** t)) / (np.sqrt(spread / (1 - 0.99 ** t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, bias


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits; 1 and 0 where one class is missing."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):     # Newton steps on two numbers
        p = 1 / (1 + np.exp(-(a * logits + b)))
        g = np.array([((p - target) * logits).sum(), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * logits * logits).sum(), (s * logits).sum()], [(s * logits).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - move[0], b - move[1]
    return (a, b) if a > 0 else (1.0, 0.0)


class Model:
    """Weights with bias and calibration folded in."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)


def train(labelled: DataFrame, fairness: float = FAIRNESS, sets: tuple[tuple[str, ...], ...] = IDENTITY_SETS) -> Model:
    """A model from all rows of ``labelled`` (text, label 0/1); ``labelled_rows`` bounds their number.

    A null text counts as empty, repeated rows count as often as they occur. Without any row the model scores everything alike and low.
    """
    rows = labelled.select(F.col("label").cast("int").alias("label"), text_mark().alias("mark"), whole_text().alias("text")).mapInArrow(
        _training_rows(terms_of(sets)), "label int, mark long, words array<binary>, counts array<int>, other_words array<binary>, other_counts array<int>")
    got = rows.repartition(1).mapInArrow(_fitted(fairness), "weights binary, bias double").first()
    return Model(np.frombuffer(got["weights"], dtype=np.float64), got["bias"]) if got else Model(np.zeros(FEATURES), -1.0)


def _fitted(fairness: float):
    """Arrow mapper from all training rows to one row: weights and bias, calibrated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            weights, bias = _model(pa.Table.from_batches(parts).sort_by([("mark", "ascending"), ("label", "ascending")]).combine_chunks(), fairness)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])
    return run


def _model(got: pa.Table, fairness: float) -> tuple[np.ndarray, float]:
    """Weights and bias from the training rows, which come in the order of their marks."""
    y, fold = got.column("label").to_numpy().astype(np.int64), got.column("mark").to_numpy() % CALIBRATION
    flat = [_flat(got, c) for c in ("words", "other_words")]
    coded = pa.chunked_array([f for f, _ in flat], pa.binary()).dictionary_encode().combine_chunks()
    code = coded.indices.to_numpy().astype(np.int32) if len(coded) else np.zeros(0, np.int32)
    vocabulary = Vocabulary(coded.dictionary.to_pylist() if len(coded) else [])
    counts = [_flat(got, c)[0].to_numpy().astype(np.int32) for c in ("counts", "other_counts")]
    entries = [(code[:len(flat[0][0])], counts[0], flat[0][1]), (code[len(flat[0][0]):], counts[1], flat[1][1])]

    def bags(which: int, chosen: np.ndarray) -> Bags:
        number = np.full(len(y), -1, dtype=np.int32)
        number[chosen] = np.arange(len(chosen), dtype=np.int32)
        word, count, row = entries[which]
        keep = number[row] >= 0
        return Bags(word[keep], count[keep], number[row[keep]], len(chosen), vocabulary)

    learn, check = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    swapped = np.intersect1d(learn, np.unique(flat[1][1]))
    weights, bias = fit(vocabulary, bags(0, learn), y[learn], bags(0, swapped), bags(1, swapped), fairness)
    a, b = calibrate(bags(0, check).logits(vocabulary.weights(weights)) + bias, y[check])
    return a * weights, float(a * bias + b)


def _flat(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """All entries of a list column and the row number of each."""
    column = table.column(name)
    parts = column.chunks or [pa.array([], column.type)]
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in parts])
    return pa.concat_arrays([c.flatten() for c in parts]), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _scorer(weights, bias: float, name: str):
    """Arrow mapper: the columns as they come and the score. The text is the last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value.tolist().__getitem__
        numbers: dict[bytes, int] = {}
        sums, counts = np.zeros(1 << 16), np.zeros(1 << 16)

        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1):
                bag = words(text.as_py() or "")
                for new in [w for w in bag if w not in numbers]:
                    own, k = features(new), len(numbers)
                    if k == len(sums):
                        sums, counts = np.resize(sums, 2 * k), np.resize(counts, 2 * k)
                    numbers[new], sums[k], counts[k] = k, sum(map(weight, own)), len(own)
                at = np.fromiter(map(numbers.__getitem__, bag), dtype=np.int64, count=len(bag))
                value = np.log1p(np.fromiter(bag.values(), dtype=np.float64, count=len(bag)))
                norm = math.sqrt((value * value) @ counts[at])
                logit = bias + (value @ sums[at] / norm if norm else 0.0)
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))))
                if len(numbers) > KNOWN_WORDS:
                    numbers.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])
    return run


def scored(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with the score added, and the name of its column."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)      # FEATURES numbers, whatever the data
    text, score = fresh(docs, "_text", "_score")
    wide = docs.withColumn(text, whole_text())
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in wide.schema]).add(score, T.DoubleType())
    return wide.mapInArrow(_scorer(weights, model.bias, score), schema), score


def held_out() -> F.Column:
    """Rows that learning never sees."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, label) of at most ``sample`` labelled documents that are not held out, those with the smallest hashes of doc_id.

    They hold at most ``sample_bytes`` bytes together; a text above a 64th of that is left to scoring. One label and one text for each doc_id: the
    larger label and the text with the smallest hash, if they differ. Only narrow columns are shuffled to find the sample; it is
    bounded, so its broadcast is.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sizes = docs.select("doc_id", F.octet_length(whole_text()).cast("long").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    few = marks.join(sizes.filter(F.col("size") <= sample_bytes // 64), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    so_far = W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)       # over ``sample`` rows at most
    few = few.withColumn("so_far", F.sum("size").over(so_far)).filter(F.col("so_far") <= sample_bytes).select("doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(
        F.min("label").alias("label"), F.min_by("text", text_mark()).alias("text")).select("text", "label")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    A null text counts as empty. A null doc_id is never labelled and not held out. Repeated rows have equal scores. Only doc_id and text of ``docs`` are read.
    """
    rows, score = scored(docs.select("doc_id", "text"), train(labelled_rows(docs, labels)))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col(score).alias("score"),
                       (F.col(score) >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``, all columns unchanged.

    A null text counts as empty, texts of any length are scored whole, repeated rows go or stay together, and a null doc_id is never
    labelled. Without labels nothing goes. An empty table gives an empty result.
    """
    rows, score = scored(docs, train(labelled_rows(docs, labels)))
    return rows.filter(F.col(score) < threshold).select(*docs.columns)
