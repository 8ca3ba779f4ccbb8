"""Toxicity: a logistic classifier regularised by counterfactuals.

Features of a text are the distinct words in it and their first 4, 5 and 6
bytes (a stem covers endings that the labels don't show).  Those that occur far
more often in toxic than in other labelled texts are kept, and a logistic
regression over their presence is fitted with an L1 penalty.

Counterfactuals: in every labelled sentence that mentions a group, the mention is
swapped for another group of the same kind, and the squared change of the
sentence's score is added to the loss.  Weight that a group's name would get from
its neighbourhood in the labels moves to the words around it, so neutral
mentions of a group aren't taken for toxic ones.

The fit uses at most SAMPLE rows of each label, the first by a hash of doc_id.
Counting features over them is a Spark aggregation; the driver gets the kept
features (at most FEATURES) and, per sampled text, which of them it has.  Every
text is scored whole.

Defined results: null text counts as empty and gets the score of a text without
known features; a doc_id with several labels is toxic if one says so; null
labels and doc_ids teach nothing, and a null doc_id isn't held out; rows that
repeat a doc_id are all scored; without labels of both kinds every score is
near 0, or near 1 if all labels are toxic; other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ddlscope.llm import tables
from ddlscope.llm.textbytes import WordHasher, blocks, small_batches

#: Bounds of the fit: labelled rows of each kind, features kept.
SAMPLE, FEATURES = 6000, 4096
#: A feature needs so many toxic texts and so many times the rate of other texts.
LEAST_TEXTS, LEAST_LIFT = 3, 20.0
STEMS = (4, 5, 6)
L1, COUNTERFACTUAL, ROUNDS = 5e-5, 1.0, 400
THRESHOLD = 0.5

#: Names of groups by kind; a mention is swapped for the next name of its row.
GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "natives", "refugees", "citizens"), ("blind", "deaf", "disabled", "sighted"), ("old", "young", "elderly"),
)
_NEXT = {name: row[(i + 1) % len(row)] for row in GROUPS for i, name in enumerate(row)}
_MENTION = re.compile(r"(?i)(?<![^\W_])(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")(?![^\W_])")
_SENTENCE = re.compile(r"[^.!?\n]+")


def swapped(sentence: str) -> str:
    """The sentence with every group's name replaced by the next of its kind."""
    return _MENTION.sub(lambda m: _NEXT[m[0].lower()], sentence)


def letters() -> np.ndarray:
    """Separator bytes: all but ASCII letters and bytes of letters beyond ASCII."""
    separator = np.ones(256, bool)
    separator[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return separator


def block_features(hasher: WordHasher, buf: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number in the block, feature hash) of every word and stem."""
    start, end, whole = hasher.words(buf, doc_start)
    doc = np.searchsorted(doc_start, start, side="right") - 1
    stems = [hasher.prefix_hash(buf, start, end, n) for n in STEMS]
    long = [end - start >= n for n in STEMS]
    return (np.concatenate([doc, *(doc[k] for k in long)]), np.concatenate([whole, *(s[k] for s, k in zip(stems, long))]))


def text_features(texts: list[str | None], hasher: WordHasher):
    """Yield (row numbers, features) of portions of the texts; a long text comes in several."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for buf, doc_start, docs in blocks(raw, hasher.separator):
        if len(buf):
            doc, feature = block_features(hasher, buf, doc_start)
            yield np.asarray(docs, np.int64)[doc], feature


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # in ascending order
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0

    def found(self, rows: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature number) of the model's features, each once a row."""
        if not len(self.features):
            return rows[:0], rows[:0]
        likely = np.zeros(1 << 16, bool)
        likely[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True
        some = likely[(feature & np.uint64(0xFFFF)).astype(np.int64)]
        rows, feature = rows[some], feature[some]
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        both = np.unique(rows[hit] * len(self.features) + at[hit])
        return both // len(self.features), both % len(self.features)

    def present(self, texts: list[str | None], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.found(*x) for x in text_features(texts, hasher)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = max(1, len(self.features))
        both = np.unique(np.concatenate([r * width + f for r, f in parts]))
        return both // width, both % width

    def scores(self, texts: list[str | None], hasher: WordHasher) -> np.ndarray:
        rows, features = self.present(texts, hasher)
        logit = self.bias + np.bincount(rows, self.weights[features], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(letters())
    for batch in batches:
        toxic = batch.column(0).to_numpy()
        for rows, feature in text_features(batch.column(1).to_pylist(), hasher):
            order = np.lexsort((feature, rows))
            rows, feature = rows[order], feature[order]
            once = np.concatenate([[True], (rows[1:] != rows[:-1]) | (feature[1:] != feature[:-1])])[:len(rows)]
            value, at = np.unique(feature[once], return_inverse=True)
            mark = toxic[rows[once]]
            yield pa.RecordBatch.from_arrays([
                pa.array(value.view(np.int64)), pa.array(np.bincount(at, mark == 1, len(value)).astype(np.int64)),
                pa.array(np.bincount(at, mark == 0, len(value)).astype(np.int64))], ["feature", "toxic", "other"])


def _fit_rows(model: Model):
    """Per text its label and features; per sentence with a mention those of both versions, signed."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(letters())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            label = batch.column(0).to_pylist()
            kinds, plus, minus = [], [], []
            for name, column in (("text", texts), ("swap", [s for t in texts for s in _SENTENCE.findall(t) if _MENTION.search(s)])):
                sides = [column] if name == "text" else [column, [swapped(s) for s in column]]
                lists = []
                for side in sides:
                    r, f = model.present(side, hasher)
                    cut = np.searchsorted(r, np.arange(len(side) + 1))
                    lists.append([f[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])])
                kinds += label if name == "text" else [-1] * len(column)
                plus += lists[0]
                minus += lists[1] if name == "swap" else [[]] * len(column)
            keep = [i for i, k in enumerate(kinds) if k >= 0 or plus[i] != minus[i]]
            yield pa.RecordBatch.from_arrays([
                pa.array([kinds[i] for i in keep], pa.int32()), pa.array([plus[i] for i in keep], pa.list_(pa.int64())),
                pa.array([minus[i] for i in keep], pa.list_(pa.int64()))], ["kind", "plus", "minus"])
    return rows


def _pairs(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), size), np.array([x for some in lists for x in some], np.int64)


def fit(rows: list[tuple[int, list[int], list[int]]], n_features: int, l1: float = L1,
        counterfactual: float = COUNTERFACTUAL, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, bias) by accelerated proximal gradient steps on

    mean log-loss (both labels with equal total weight) + counterfactual * mean squared score change + l1 * |w|.
    """
    texts, swaps = [r for r in rows if r[0] >= 0], [r for r in rows if r[0] < 0]
    y = np.array([r[0] for r in texts], np.float64)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    at, col = _pairs([r[1] for r in texts])
    at2, col2 = _pairs([r[1] + r[2] for r in swaps])
    sign = np.array([s for r in swaps for s in [1.0] * len(r[1]) + [-1.0] * len(r[2])])
    per_swap = counterfactual / max(1, len(swaps))
    # largest curvature of the loss: of the squared rows of the texts and of the swaps
    row_norm = 1 + np.bincount(at, minlength=len(texts))
    swap_norm = np.bincount(at2, minlength=len(swaps))
    step = 1 / (0.25 * float((share * row_norm).sum()) + 2 * per_swap * float(swap_norm.sum()) + 1e-9)
    step *= 8  # these sums bound the curvature loosely; steps that overshoot are halved
    w, b = np.zeros(n_features), 0.0

    def loss_and_slope(w: np.ndarray, b: float):
        z = b + np.bincount(at, w[col], len(texts))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        error = share * (p - y)
        change = np.bincount(at2, sign * w[col2], len(swaps))
        loss = float((share * (np.logaddexp(0, z) - y * z)).sum() + per_swap * (change ** 2).sum())
        slope = np.bincount(col, error[at], n_features) + np.bincount(col2, 2 * per_swap * change[at2] * sign, n_features)
        return loss, slope, float(error.sum())

    look_w, look_b, t = w, b, 1.0
    for _ in range(rounds):
        loss, slope, slope_b = loss_and_slope(look_w, look_b)
        while True:
            new_w = look_w - step * slope
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
            new_b = look_b - step * slope_b
            d, d_b = new_w - look_w, new_b - look_b
            if loss_and_slope(new_w, new_b)[0] <= loss + slope @ d + slope_b * d_b + (d @ d + d_b * d_b) / (2 * step) + 1e-12:
                break
            step /= 2
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look_w, look_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text)."""
    marks = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("labelled"))
             .agg(F.max((F.col("toxic") != 0).cast("int")).alias("mark")))
    picked = [marks.filter(F.col("mark") == m).orderBy(F.xxhash64("labelled"), "labelled").limit(sample) for m in (0, 1)]
    # at most 2 * sample rows
    chosen = tables.written(picked[0].union(picked[1]), "labels")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("mark", "text")
    texts = tables.written(texts, "labelled")
    n = {r["mark"]: r["count"] for r in texts.groupBy("mark").count().collect()}
    if len(n) < 2:
        return Model(bias=30.0 if n.get(1) else -30.0)
    counts = texts.mapInArrow(_count_features, "feature long, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    rate = (F.col("toxic") / n[1], (F.col("other") + 0.5) / n[0])
    kept = (counts.filter((F.col("toxic") >= LEAST_TEXTS) & (rate[0] >= LEAST_LIFT * rate[1]))
            .orderBy((rate[0] - rate[1]).desc(), "feature").limit(FEATURES).select("feature").collect())
    model = Model(np.sort(np.array([r["feature"] for r in kept], np.int64).view(np.uint64)))
    rows = texts.mapInArrow(_fit_rows(model), "kind int, plus array<long>, minus array<long>").collect()
    model.weights, model.bias = fit([tuple(r) for r in rows], len(model.features), counterfactual=counterfactual)
    used = model.weights != 0
    return Model(model.features[used], model.weights[used], model.bias)


def _scorer(features: np.ndarray, weights: np.ndarray, bias: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = WordHasher(letters()), Model(features, weights, bias)
        for batch in small_batches(batches):
            at = batch.schema.get_field_index("text")
            scores = model.scores(batch.column(at).to_pylist(), hasher)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])
    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column score; the texts in them come back as they are."""
    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    return docs.mapInArrow(_scorer(model.features, model.weights, model.bias), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
