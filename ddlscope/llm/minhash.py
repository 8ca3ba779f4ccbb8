"""Near-duplicate documents: SuperMinHash signatures, banding, verification, grouping.

1. Sketch: one pass over the texts gives each document's number of distinct
   word shingles, a 128-bit print of that set and a SuperMinHash signature.
   For element x and step j = 0, 1, ... a generator seeded by x gives the next
   place of a random permutation of the K signature places and a random
   fraction r; the place keeps the least j + r.  As step j only gives values in
   [j, j + 1), a document stops at the first step that leaves no place empty.
2. Documents with the same set become one class, held by the smallest id, so a
   group of copies is one row in all that follows.
3. Banding: classes that share a band of ROWS signature places are candidates.
   At similarity 0.85, 24 bands of 5 miss a pair with probability 8e-7 (at 0.8:
   7e-5).  A 4-bit signature compared by XOR drops pairs that are more than
   five standard deviations below the threshold.
4. Links are confirmed on the full sets.  Every class is compared with the
   leaders of its buckets: a bucket's leader is the member that shares buckets
   with the most others (a group of edited copies has its original there), so one
   comparison a member joins most of a group.  A class that isn't linked to the
   leader but to a linked member lies within twice the linking distance of the
   leader; those are found from the differences to the leader's set alone, which
   are small, in blocks of bounded size.  What is left are candidate pairs of
   classes that aren't linked to their bucket's leader and are still in
   different components: these are confirmed one by one.  So no pair inside a
   component is built, and no candidate pair across components is left out.
5. Star contractions group the confirmed links (components.py).

Defined results: null text counts as empty; a document without words has no
shingles and is linked with nothing; rows that repeat a doc_id are one node (with
all their texts) and each row is returned; a null doc_id is linked with nothing, has a null
component and is kept; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables
from ddlscope.llm.components import components
from ddlscope.llm.textbytes import WordHasher, mix64, small_batches, word_stream

PLACES, BANDS, ROWS = 128, 24, 5
STEP = 0x9E3779B97F4A7C15
EMPTY = np.iinfo(np.int64).max


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words make one shingle."""
    if len(words) == 0:
        return words
    n = min(size, len(words))
    count = len(words) - n + 1
    h = np.full(count, len(words) if n < size else size, np.uint64)
    for j in range(n):
        h = mix64(h * np.uint64(STEP) + words[j:j + count])
    return np.unique(h)


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash signature (step << 32 | fraction) of each non-empty set, all sets together step by step."""
    sig = np.full(len(sets) * places, EMPTY, np.int64)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = None
    for j in range(places):
        draw = mix64(x + np.uint64((STEP * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = (((draw >> np.uint64(32)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64) + j
        value = (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) | (j << 32)
        if perm is None:
            place = at
        else:
            every = np.arange(len(x))
            place = perm[every, at].astype(np.int64)
            perm[every, at] = perm[:, j]
        np.minimum.at(sig, doc * places + place, value)
        unfilled = (sig.reshape(-1, places) == EMPTY).any(axis=1)
        if not unfilled.any():
            break
        on = unfilled[doc]
        if perm is None:
            perm = np.broadcast_to(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (int(on.sum()), places)).copy()
            every = np.arange(len(perm))
            perm[every, at[on]] = perm[:, 0]
        elif not on.all():
            perm = perm[on]
        x, doc = x[on], doc[on]
    return sig.reshape(-1, places)


def _sketcher(size: int, places: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in small_batches(batches):
            ids = batch.column(0)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for some in _portions(word_stream(texts, hasher), len(texts)):
                docs = [d for d, _ in some]
                sets = [shingles(w, size) for _, w in some]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full], places)
                keys = band_keys(sig, bands, rows)
                nibbles = packed(sig)
                prints, band_lists, small = [None] * len(docs), [None] * len(docs), [None] * len(docs)
                for k, i in enumerate(full):
                    prints[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    band_lists[i], small[i] = keys[k], nibbles[k]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(docs, pa.int64())), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.binary()), pa.array(band_lists, pa.list_(pa.int64())),
                    pa.array(small, pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "set_print", "bands", "small"])
    return sketch


def _portions(stream, n_docs: int, words: int = 1 << 16):
    """Documents in portions of about so many words; those without any come last."""
    seen, held, size = set(), [], 0
    for doc, w in stream:
        seen.add(doc)
        held.append((doc, w))
        size += len(w)
        if size >= words:
            yield held
            held, size = [], 0
    none = np.zeros(0, np.uint64)
    held += [(d, none) for d in range(n_docs) if d not in seen]
    if held:
        yield held


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = mix64(h * np.uint64(STEP) + sig[:, b * rows + r].astype(np.uint64))
        keys[:, b] = h
    return keys.view(np.int64)


def packed(sig: np.ndarray) -> np.ndarray:
    """Four bits of each place, sixteen places to a 64-bit integer."""
    four = (mix64(sig.astype(np.uint64)) & np.uint64(15)).reshape(len(sig), sig.shape[1] // 16, 16)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def unequal_places(a: Column, b: Column, places: int = PLACES) -> Column:
    """How many of the 4-bit places differ."""
    total = F.lit(0)
    for i in range(places // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def most_unequal(percent: int, places: int = PLACES) -> int:
    """Five standard deviations over the expected unequal places at the threshold."""
    p = (100 - percent) / 100 * 15 / 16
    return int(places * p + 5 * (places * p * (1 - p)) ** 0.5) + 1


def _comparer(size: int, percent: int):
    """(a, b, text_a, text_b) -> pairs at twice the linking distance at most: linked or not, size of b, difference of the sets."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        kept_id, kept = object(), None
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in range(2))
            rows = []
            for i in range(len(a)):
                if kept_id != a[i]:
                    kept_id, kept = a[i], _set_of(batch.column(2)[i].as_py(), hasher, size)
                other = _set_of(batch.column(3)[i].as_py(), hasher, size)
                both = _common(kept, other)
                either = len(kept) + len(other) - both
                if 100 * both >= (2 * percent - 100) * either:
                    linked = 100 * both >= percent * either
                    rows.append((a[i], b[i], linked, len(other), np.setxor1d(kept, other, assume_unique=True).view(np.int64)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.list_(pa.int64()))], ["a", "b", "linked", "n", "unlike"])
    return compare


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _set_of(text: str | None, hasher: WordHasher, size: int) -> np.ndarray:
    words = [w for _, w in word_stream([(text or "").encode("utf-8", "surrogatepass")], hasher)]
    return shingles(words[0], size) if words else np.zeros(0, np.uint64)


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    with_b = pairs.join(texts.toDF("b", "text_b"), "b")
    return with_b.join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")


def _tile(percent: int):
    """Strays of a leader against a block of its linked members; (leader, stray) where one is similar enough.

    |x ^ y| of two sets is |X ^ Y| of their differences X, Y from the leader's set,
    so the small differences are compared by way of an inverted index.
    """
    def settle(strays: pa.Table, core: pa.Table) -> pa.Table:
        a, b = [], []
        if strays.num_rows and core.num_rows:
            n = core.column("n").to_numpy()
            lists = core.column("unlike").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            value = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), size)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            for leader, doc, m, unlike in zip(*(strays.column(c).to_pylist() for c in ("a", "b", "n", "unlike"))):
                own = np.array(unlike, np.int64)
                low, high = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
                hits = np.concatenate([owner[i:j] for i, j in zip(low, high)]) if len(own) else owner[:0]
                shared = np.bincount(hits, minlength=len(n))
                both = (n + m - (size + len(own) - 2 * shared)) // 2
                if (100 * both >= percent * (n + m - both)).any():
                    a.append(leader)
                    b.append(doc)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return settle


def _linked_to_core(compared: DataFrame, percent: int, block: int = 4096) -> DataFrame:
    """(leader, stray) where a class not linked to the leader is linked to a class that is.

    By the triangle inequality of the Jaccard distance such a class is within
    twice the linking distance of the leader, so ``compared`` has it.  Members and
    strays of a leader meet in blocks of bounded size.
    """
    number = (compared.groupBy("a").agg(F.count_if("linked").alias("core"), F.count_if(~F.col("linked")).alias("strays"))
              .filter("core > 0 and strays > 0")
              .select("a", F.ceil(F.col("core") / block).alias("cores"), F.ceil(F.col("strays") / block).alias("others")))
    rows = compared.join(number, "a")

    def dealt(df, own, own_n, other, other_n):
        return (df.withColumn(own, F.pmod(F.xxhash64("b"), F.col(own_n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)))
                .select("a", "b", "n", "unlike", "cb", "sb").toDF("a", "b", "n", "unlike", "cb", "sb"))

    strays = dealt(rows.filter(~F.col("linked")), "sb", "others", "cb", "cores")
    core = dealt(rows.filter("linked"), "cb", "cores", "sb", "others")
    keys = ["a", "cb", "sb"]
    return strays.groupBy(*keys).cogroup(core.groupBy(*keys)).applyInArrow(_tile(percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, unique_ids: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Links: 100 * |intersection| >= percent * |union| of the distinct ``size``-word shingles.
    ``unique_ids``: no doc_id is repeated, so none links rows with other texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = tables.written(
        docs.mapInArrow(_sketcher(size, PLACES, BANDS, ROWS),
                        "doc_id long, n_shingles long, set_print binary, bands array<long>, small array<long>"),
        "sketches")
    n_rows = sketches.count()
    named = sketches.filter(F.col("doc_id").isNotNull() & F.col("set_print").isNotNull())
    # written, so that joins with it are of two tables and adaptive execution can split a large class
    classes = tables.written(named.groupBy("set_print").agg(F.min("doc_id").alias("holder")), "holders", n_rows)
    # one row per class: the holder's own sketch (rows that repeat a doc_id may differ, so the print must match)
    holders = tables.written(
        named.join(classes.select(F.col("set_print").alias("p"), "holder"),
                   (F.col("doc_id") == F.col("holder")) & (F.col("set_print") == F.col("p")), "left_semi")
        .dropDuplicates(["doc_id", "set_print"]).select("doc_id", "n_shingles", "bands", "small"), "classes", n_rows)
    n_bands = BANDS * holders.count()

    banded = holders.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = tables.written(banded.join(sizes, "bucket"), "buckets", n_bands)
    popular = members.groupBy("doc_id").agg(F.sum("n").alias("met"))
    leaders = (members.join(popular, "doc_id").groupBy("bucket")
               .agg(F.max(F.struct("met", (-F.col("doc_id")).alias("neg"))).alias("top"))
               .select("bucket", (-F.col("top.neg")).alias("leader")))
    led = tables.written(members.select("bucket", "doc_id").join(leaders, "bucket").filter("leader <> doc_id"), "led", n_bands)
    n_led = led.count()
    small = holders.select("doc_id", "small", "n_shingles")

    # every class with the leaders of its buckets: links, and differences of those near enough to matter
    stars = (led.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
             .join(small.toDF("b", "small_b", "n_b"), "b").join(small.toDF("a", "small_a", "n_a"), "a")
             .filter(unequal_places(F.col("small_a"), F.col("small_b")) <= most_unequal(2 * percent - 100)).select("a", "b"))
    compared = tables.written(_with_texts(stars, docs).mapInArrow(
        _comparer(size, percent), "a long, b long, linked boolean, n long, unlike array<long>"), "compared", 5 * n_led)
    n_compared = compared.count()
    linked = compared.filter("linked").select("a", "b")
    links = linked.union(_linked_to_core(compared, percent))
    if not unique_ids:
        # rows that repeat a doc_id with other texts make one node: their classes' holders are linked
        placed_rows = named.select("doc_id", "set_print").join(classes, "set_print")
        spread = (placed_rows.groupBy("doc_id").agg(F.min("holder").alias("low"), F.max("holder").alias("high"))
                  .filter("low < high").select("doc_id", "low"))
        links = links.union(placed_rows.join(spread, "doc_id").select(F.col("low").alias("a"), F.col("holder").alias("b")))
    grouped = components(links, rows=5 * n_compared)

    # then the candidate pairs of classes that aren't linked to their bucket's leader and are still apart
    strays = (led.join(linked.toDF("leader", "doc_id"), ["leader", "doc_id"], "left_anti").select("bucket", "doc_id")
              .join(grouped, F.col("doc_id") == F.col("node"), "left")
              .select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    mixed = (strays.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter("low <> high").select("bucket"))
    apart = tables.written(strays.join(mixed, "bucket").join(holders, "doc_id"), "apart", n_bands)
    a = apart.toDF(*[f"{c}_a" for c in apart.columns])
    b = apart.toDF(*[f"{c}_b" for c in apart.columns])
    first_bucket = F.coalesce(*[F.when(F.col("bands_a")[i] == F.col("bands_b")[i], F.col("bands_a")[i]) for i in range(BANDS)])
    across = (a.join(b, (F.col("bucket_a") == F.col("bucket_b")) & (F.col("doc_id_a") < F.col("doc_id_b"))
                     & (F.col("component_a") != F.col("component_b"))
                     & (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
                     & (unequal_places(F.col("small_a"), F.col("small_b")) <= most_unequal(percent))
                     & (first_bucket == F.col("bucket_a")))
              .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct())
    more = _with_texts(across, docs).mapInArrow(_comparer(size, percent), "a long, b long, linked boolean, n long, unlike array<long>")
    joined = components(more.filter("linked").select("a", "b").union(grouped.toDF("a", "b")), rows=5 * n_led)

    of_class = tables.written(classes.join(joined, F.col("holder") == F.col("node"), "left")
                              .select("set_print", F.coalesce("component", "holder").alias("component")), "of-class", n_rows)
    rows = sketches.select("doc_id", "n_shingles", "set_print").join(of_class, "set_print", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                       F.when(F.col("doc_id").isNull(), True).otherwise(F.col("doc_id") == component).alias("kept"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tables.documents(spark, sf_dir), size=3, percent=85)
