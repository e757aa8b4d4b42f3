"""Toxicity by multiple-instance learning.

Labels belong to documents, scores to sentences. A sentence's score is logistic in its
words and the beginnings of its words, by their hash; a document is toxic unless none of its sentences is: p = 1 - (1 - leak) *
prod(1 - p_s) (noisy-or). The gradient of the document's likelihood reaches the
sentences through that product, so training on document labels finds the sentences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, gather, lengths_to_starts, merged, require, utf8

TRAIN_DOCS = 5_000
TRAIN_BYTES = 64 << 20
STEPS = 200
# Texts that training takes apart at a time.
FIT_CHUNK = 256
# A word's features: its first letters (bytes) up to these lengths, and the word.
PREFIXES = (3, 4, 5, 6, 7)
# Features that training looks at: in so many texts at least, and tied to the label at
# least so strongly (standard deviations from what chance gives).
LEAST_TEXTS = 4
LEAST_DEVIATIONS = 4.0
THRESHOLD = 0.3
SENTENCE = 0.5
# Sentences end at . ! ? and line ends; other ASCII but letters and digits parts words.
_SPLIT = bytes(
    10 if c in b".!?\n\r" else c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def sentences(text: bytes) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    return [words for words in map(bytes.split, text.translate(_SPLIT).split(b"\n")) if words]


def features(word: bytes) -> list[int]:
    """The features of a word. Beginnings are kept apart from words that are as long."""
    return [zlib.crc32(word, 1)] + [zlib.crc32(word[:n]) for n in PREFIXES if n <= len(word)]


class Model:
    """The features that have a weight, in ascending order, and their weights."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        self.known, self.weights, self.bias, self.leak = known, weights, bias, leak

    def of(self, found: np.ndarray) -> np.ndarray:
        """The weight of each feature, 0 if it has none."""
        if not len(self.known):
            return np.zeros(len(found))
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        return np.where(self.known[at] == found, self.weights[at], 0.0)


class Sentences:
    """The sentences of several texts, end to end, and the features of each distinct word."""

    def __init__(self, texts: list[bytes]):
        split = [sentences(t) for t in texts]
        self.words = Words([s for text in split for s in text])
        lists = [features(w) for w in self.words.distinct]
        self.features = np.array([f for x in lists for f in x], np.int64)
        self.features_at = lengths_to_starts(np.array([len(x) for x in lists], np.int64))
        self.per_text = np.array([len(t) for t in split], np.int64)

    def scores(self, model: Model) -> np.ndarray:
        """The probability of each sentence; 0 for one without any feature that has a weight.

        What training left to such sentences is the bias; in a text of thousands of them it
        would add up, and the leak already stands for labels without a reason in the text.
        """
        if not self.words.lengths.size:
            return np.zeros(0)
        per_word = np.add.reduceat(model.of(self.features), self.features_at[:-1])
        sums = np.add.reduceat(per_word[self.words.codes], self.words.starts[:-1])
        return np.where(sums > 0, 1 / (1 + np.exp(-np.clip(model.bias + sums, -30, 30))), 0.0)


def noisy_or(p: np.ndarray, per_text: np.ndarray, leak: float) -> np.ndarray:
    """The probability of each text from those of its sentences; the leak alone without any."""
    starts = lengths_to_starts(per_text)
    logs = lengths_to_starts_float(np.log1p(-np.minimum(p, 1 - 1e-9)))
    return 1 - (1 - leak) * np.exp(logs[starts[1:]] - logs[starts[:-1]])


def lengths_to_starts_float(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(values)])


def _chunks(rows: list[tuple[bytes, int]]) -> Iterator[tuple[Sentences, np.ndarray]]:
    """A few texts at a time, with the text (within them) of each word."""
    for a in range(0, len(rows), FIT_CHUNK):
        view = Sentences([t for t, _ in rows[a : a + FIT_CHUNK]])
        text = np.repeat(np.arange(len(view.per_text)), view.per_text)
        yield view, np.repeat(text, view.words.lengths)


def _spread(view: Sentences, owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner of a word as the owner of the word's features."""
    many = np.diff(view.features_at)[code]
    return np.repeat(owner, many), view.features[gather(view.features_at[code], many)]


def informative(rows: list[tuple[bytes, int]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features in ``LEAST_TEXTS`` texts or more whose share of toxic texts is far from the
    mean, and the log odds of toxic against other texts of each."""
    found, labels, start = [np.zeros(0, np.uint32)], [np.zeros(0, bool)], 0
    for view, text in _chunks(rows):
        distinct = max(1, len(view.words.distinct))
        words = np.unique(text * distinct + view.words.codes)
        owner, feature = _spread(view, words // distinct, words % distinct)
        pairs = np.unique(owner << 32 | feature)
        found.append((pairs & 0xFFFFFFFF).astype(np.uint32))
        labels.append(y[start + (pairs >> 32)] > 0)
        start += len(view.per_text)
    features, toxic_text = np.concatenate(found), np.concatenate(labels)
    known, texts = np.unique(features, return_counts=True)
    toxic = np.zeros(len(known))
    in_toxic, count = np.unique(features[toxic_text], return_counts=True)
    toxic[np.searchsorted(known, in_toxic)] = count
    mean = y.mean()
    away = (toxic - texts * mean) / np.sqrt(np.maximum(texts * mean * (1 - mean), 1e-9))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((texts - toxic + 0.5) / (len(y) - y.sum() + 1))
    chosen = (texts >= LEAST_TEXTS) & (np.abs(away) >= LEAST_DEVIATIONS)
    return known[chosen].astype(np.int64), odds[chosen]


def fit(rows: list[tuple[bytes, int]], steps: int = STEPS, rate: float = 1.0, l1: float = 1e-6) -> Model:
    """The model by proximal AdaGrad over all texts at once.

    Weights are not negative: no word takes back what another one says. The l1 term keeps
    those of features that labels do not speak of at zero, so that long texts are not
    toxic for their length.
    """
    y = np.array([label for _, label in rows], np.float64)
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(none, none, -30.0, float(y.mean()) if len(y) else 0.0)
    known, odds = informative(rows, y)
    # Of all texts only this stays: which sentence has which of the features, once each.
    per_text, pairs, before = [], [], 0
    for view, _ in _chunks(rows):
        lookup = Model(known, np.arange(1, len(known) + 1), 0.0, 0.0)
        heard = np.add.reduceat(lookup.of(view.features), view.features_at[:-1])[view.words.codes] > 0 if len(view.features) else np.zeros(0, bool)
        sentence = np.repeat(np.arange(len(view.words.lengths)), view.words.lengths)
        distinct = max(1, len(view.words.distinct))
        once = np.unique(sentence[heard] * distinct + view.words.codes[heard])
        owner, raw = _spread(view, once // distinct, once % distinct)
        place = lookup.of(raw).astype(np.int64)
        pairs.append(np.stack([owner[place > 0] + before, place[place > 0] - 1]))
        before += len(view.words.lengths)
        per_text.append(view.per_text)
    per_text = np.concatenate(per_text)
    sentence, feature = np.concatenate(pairs, axis=1)
    text_of = np.repeat(np.arange(len(y)), per_text)
    n, total = len(y), len(text_of)
    # Each feature starts with half of what it says alone.
    weights, bias, leak_logit = np.maximum(odds / 2, 0), -6.0, -4.0
    squares, bias_squares, leak_squares = np.full(len(known), 1e-8), 1e-8, 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, weights=weights[feature], minlength=total), -30, 30)))
        leak = 1 / (1 + np.exp(-leak_logit))
        doc = np.clip(noisy_or(p, per_text, leak), 1e-9, 1 - 1e-9)
        # d(-log likelihood)/dz: p_s for label 0, -p_s (1 - p) / p for label 1.
        pull = np.where(y > 0, -(1 - doc) / doc, 1.0)
        slope = p * pull[text_of] / n
        gradient = np.bincount(feature, weights=slope[sentence], minlength=len(known))
        squares += gradient**2
        step = rate / np.sqrt(squares)
        weights = np.maximum(weights - step * (gradient + l1), 0)
        bias_slope, leak_slope = slope.sum(), (leak * pull / n).sum()
        bias_squares += bias_slope**2
        leak_squares += leak_slope**2
        bias -= 0.3 * bias_slope / np.sqrt(bias_squares)
        leak_logit = np.clip(leak_logit - 0.2 * leak_slope / np.sqrt(leak_squares), -9, 0)
    kept = weights > 0
    return Model(known[kept], weights[kept], float(bias), float(1 / (1 + np.exp(-leak_logit))))


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS,
    most_bytes: int = TRAIN_BYTES,
) -> Model:
    """The model from at most about ``most`` labelled documents, chosen by the hash of their id.

    ``learn`` is a condition on ``id_col`` that labels must meet. Labels that are neither 0
    nor 1, or whose id is null, are left out; several labels of one id count as toxic if
    one is. Without usable labels the model has no weights. The chosen ids, at most
    ``most``, are broadcast, so texts are not shuffled; one task fits the model. It gets one
    text of an id (the first by its bytes) and ``most_bytes`` of text in all, in the order
    in which ids are chosen; a text of over a sixteenth of that is not learned from.
    """
    require(labels, id_col, label_col)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn)
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("content"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("content").alias("content"), F.first("label").alias("label"))
    # A window over at most ``most`` rows.
    so_far = F.sum(F.octet_length("content").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id"))
    rows = rows.filter(F.octet_length("content") <= most_bytes // 16).withColumn("so_far", so_far).filter(F.col("so_far") <= most_bytes).drop("so_far").withColumn("all", F.lit(0))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("content", "ascending")])
        model = fit(list(zip(table.column("content").to_pylist(), table.column("label").to_pylist())))
        return pa.table({"known": [model.known.tolist()], "weights": [model.weights.tolist()], "bias": [model.bias], "leak": [model.leak]}, schema=kind)

    kind = pa.schema([("known", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64()), ("leak", pa.float64())])
    found = rows.groupBy("all").applyInArrow(run, "known array<long>, weights array<double>, bias double, leak double").first()
    if found is None:
        return Model(np.zeros(0), np.zeros(0), -30.0, 0.0)
    return Model(np.array(found["known"], np.int64), np.array(found["weights"], np.float64), found["bias"], found["leak"])


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", spans: bool = False) -> DataFrame:
    """The columns ``keep`` as the struct ``row``, and each row's ``score``; null texts count as empty.

    With ``spans``, also ``sentences``: number, words and score of the sentences of
    ``SENTENCE`` and more, that is, those that offend. Numbers count sentences with words.
    """
    require(docs, text_col, *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), utf8(text_col).alias("content"))
    found = pa.list_(pa.struct([("number", pa.int64()), ("words", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for table in merged(batches, "content"):
            texts = table.column("content").to_pylist()
            view = Sentences(texts)
            p = view.scores(known)
            columns = [table.column("row"), pa.array(noisy_or(p, view.per_text, known.leak))]
            if spans:
                starts = lengths_to_starts(view.per_text)
                columns.append(pa.array([
                    [{"number": int(i - a), "words": b" ".join(sentences(t)[i - a]).decode("utf-8", "replace"), "score": float(p[i])} for i in np.flatnonzero(p[a:b] >= SENTENCE) + a]
                    for t, a, b in zip(texts, starts[:-1], starts[1:])
                ], found))
            yield from pa.Table.from_arrays(columns, ["row", "score", "sentences"][: len(columns)]).to_batches()

    extra = ", sentences array<struct<number:long,words:string,score:double>>" if spans else ""
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double{extra}")


def not_held_out(id_col: str = "doc_id") -> Column:
    """Learning rows: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted, n_sentences, sentences_sha256`` per row: the last two are
    how many sentences offend, and the digest of their numbers and words.

    Empty and null texts have the score of the leak; repeated rows and other columns
    change nothing; an empty table has an empty result. A row without id is not held out.
    """
    require(docs, id_col, text_col)
    model = train(docs, labels, not_held_out(id_col), id_col, text_col)
    rows = score(docs, model, [id_col], text_col, spans=True).select(F.col("row").getField(id_col).alias(id_col), "score", "sentences")
    located = F.array_join(F.transform("sentences", lambda x: F.concat_ws(" ", x["number"].cast("string"), x["words"])), "\n")
    return rows.select(
        id_col, F.coalesce(~not_held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("sentences").cast("long").alias("n_sentences"), F.sha2(located, 256).alias("sentences_sha256"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, that score below the threshold."""
    model = train(docs, labels, not_held_out(id_col), id_col, text_col)
    return score(docs, model, docs.columns, text_col).filter(F.col("score") < threshold).select("row.*")
