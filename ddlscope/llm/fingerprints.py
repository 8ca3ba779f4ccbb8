"""Document fingerprints by consistent weighted sampling.

A document is a bag of words with their counts as weights.  For each of K
samples every (word, weight) draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from
generators seeded by the word and the sample, takes t = floor(ln(weight)/r + b)
and a = c * exp(-r (t - b) - r); the sample is the (word, t) with the least a.
Two bags have the same sample with probability sum(min) / sum(max) of their
weights, the generalised Jaccard similarity, so the share of equal samples
estimates it with a standard deviation of sqrt(J (1 - J) / K).

Draws depend on (word, weight) only, so a block of documents draws once for each
distinct pair and then takes minima over documents.

The query also needs each document's neighbour in descending doc_id order.
Documents are dealt into ranges of doc_id, several for each shuffle partition,
and sorted; a range also gets the first document of the next range as its last
row, so every neighbour is found in one pass without a global window.

Defined results: null text counts as empty; a text without words has an empty
fingerprint, with likeness 1 to another empty one and 0 to all others; rows that
repeat a doc_id are in the order of their texts; null doc_ids come last; a lone
document is its own neighbour; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables
from ddlscope.llm.textbytes import WordHasher, mix64, word_stream

SAMPLES = 64
#: Ranges of doc_id for each shuffle partition, and at the most.
RANGES, MOST_RANGES = 4, 16384
STEP = 0x9E3779B97F4A7C15


def draws(word: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """For each (word, weight) the sample k: ln(a) as an ordered 32-bit integer << 32 | hash of (word, t)."""
    with np.errstate(over="ignore"):
        first = mix64(word ^ np.uint64((STEP * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF))
        second = mix64(first + np.uint64(STEP))

        def uniform(bits: np.ndarray, shift: int) -> np.ndarray:
            """24 bits as a number in (0, 1)."""
            return ((bits >> np.uint64(shift) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -24)

        r = -np.log(uniform(first, 0) * uniform(first, 24))
        c = -np.log(uniform(second, 0) * uniform(second, 24))
        b = uniform((first >> np.uint64(48)) | (second >> np.uint64(48) << np.uint64(16)), 0)
        t = np.floor(np.log(weight.astype(np.float32)) / r + b)
        ln_a = np.log(c) - r * (t - b) - r
        bits = ln_a.astype(np.float32).view(np.int32)
        ordered = np.where(bits < 0, ~bits & 0x7FFFFFFF | -0x80000000, bits).astype(np.int64)
        # of equal values the smaller hash wins, alike everywhere
        return ordered << 32 | (mix64(first + t.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def fingerprints(bags: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """(len(bags), samples) 16-bit samples of bags of word hashes; none of them empty."""
    if not bags:
        return np.zeros((0, samples), np.uint16)
    words, at = np.unique(np.concatenate(bags), return_inverse=True)
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    entry, weight = np.unique(doc * len(words) + at, return_counts=True)
    doc, word = entry // len(words), entry % len(words)
    most = int(weight.max()) + 1
    pair, at = np.unique(word * most + weight, return_inverse=True)
    pair_word, pair_weight = words[pair // most], pair % most
    first = np.searchsorted(doc, np.arange(len(bags)))
    out = np.empty((len(bags), samples), np.uint16)
    for k in range(samples):
        out[:, k] = np.minimum.reduceat(draws(pair_word, pair_weight, k)[at], first) & 0xFFFF
    return out


def texts_fingerprints(texts: list[str], hasher: WordHasher, samples: int) -> list[np.ndarray | None]:
    bags = dict(word_stream([t.encode("utf-8", "surrogatepass") for t in texts], hasher))
    docs = sorted(d for d, b in bags.items() if len(b))
    out: list[np.ndarray | None] = [None] * len(texts)
    for d, row in zip(docs, fingerprints([bags[d] for d in docs], samples)):
        out[d] = row
    return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third replaced by as many first characters of the following text (or all it has)."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _rows(samples: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        last = None  # the row whose neighbour is still to come: (is it a guest, doc_id, text, fingerprint)
        for some in _portions(batches):
            prints = texts_fingerprints([t for _, _, t in some], hasher, samples)
            now = ([last] if last else []) + [(*row, p) for row, p in zip(some, prints)]
            last = now[-1]
            pairs = [(a, b) for a, b in zip(now, now[1:]) if not a[0]]
            changed = [edited(a[2], b[2]) for a, b in pairs]
            marks = texts_fingerprints(changed, hasher, samples)
            hexed = [["" if p is None else p.astype(">u2").tobytes().hex() for p in column] for column in ([a[3] for a, _ in pairs], marks)]
            yield pa.RecordBatch.from_arrays([
                pa.array([a[1] for a, _ in pairs], pa.int64()), pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array(hexed[0], pa.string()), pa.array(hexed[1], pa.string()),
                pa.array([likeness(a[3], m) for (a, _), m in zip(pairs, marks)], pa.float64()),
                pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return rows


def _portions(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20):
    some, size = [], 0
    for batch in batches:
        for guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            some.append((guest, doc, text or ""))
            size += len(some[-1][2])
            if size >= chars:
                yield some
                some, size = [], 0
    if some:
        yield some


def ranged(docs: DataFrame) -> DataFrame:
    """(range, guest, place, doc_id, text): ranges in descending doc_id order, each with the next one's first row as a guest."""
    spark = docs.sparkSession
    least = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", F.coalesce("doc_id", F.lit(least)))
    n = min(MOST_RANGES, RANGES * tables.shuffle_partitions(spark))
    cuts = np.array(sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else [], np.float64)

    @F.pandas_udf("long")
    def number(place: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, place.to_numpy(np.float64), side="left"))

    rows = docs.withColumn("range", number("place")).withColumn("guest", F.lit(False))
    # one id per range, as many as ranges at the most
    first = sorted((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.max("place").alias("first")).collect())
    to = [(first[i - 1][0], first[i][1]) for i in range(len(first))]  # the first range's first row ends the last range
    guests = (docs.join(F.broadcast(spark.createDataFrame(to, "range long, first long")), F.col("place") == F.col("first"))
              .select("doc_id", "text", "place", "range", F.lit(True).alias("guest")))
    return rows.unionByName(guests)


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    rows = ranged(docs).repartition(tables.shuffle_partitions(docs.sparkSession), "range")
    in_order = rows.sortWithinPartitions("range", "guest", F.col("place").desc(), "text").select("guest", "doc_id", "text")
    return in_order.mapInArrow(
        _rows(samples), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def op7_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(tables.documents(spark, sf_dir))
