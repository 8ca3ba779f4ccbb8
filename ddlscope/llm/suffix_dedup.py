"""Removal of every byte that lies in a long string which occurs more than once.

A byte goes when it is covered by a string of ``length`` bytes that starts
anywhere else too, in any document.  Strings never cross documents, overlaps
count, and all is judged on the input.

1. Segments.  Every string of ``length`` bytes has an anchor: its 64-byte gram
   with the least hash.  Equal strings have equal anchors at equal places, so the
   strings of an anchor can be settled apart from all others.  The strings of one
   anchor occurrence start at neighbouring bytes and make one segment; a
   document has one about every 170 bytes, and each string is in exactly one.
2. Segments whose anchor occurs once hold no repeat.  Equal segments of an anchor
   are counted before anything is moved: copies make one variant with a count.
3. Variants of anchors that have several go to shards of bounded size.  A shard
   builds the suffix array of its variants by induced sorting and the permuted
   common prefixes (suffix_array.py); strings that share ``length`` bytes with
   their neighbour in the order repeat.  All strings of a variant that has copies
   repeat as well.
4. An anchor with more variant bytes than one shard holds (a passage in very
   many contexts) is settled exactly by counting its strings instead, one row per
   string, with map-side aggregation.
5. The repeated starts go back to their documents.

Defined results: a null text counts as empty; rows that repeat a doc_id or whole
rows are documents of their own (their strings repeat in each other); a null
doc_id is a document like any other; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables
from ddlscope.llm.suffix_array import repeated_starts
from ddlscope.llm.textbytes import BLOCK, WordHasher, mix64, small_batches

LENGTH, GRAM = 400, 64
SHARD_BYTES = 4 << 20
#: Odd multiplier (fixed, arbitrary) of the grams' hash; it only chooses anchors, so grams that it takes for one do no harm.
BASE = 0x9E3779B97F4A7C15
SEGMENT = ("doc_id long, print long, start long, n_starts int, anchor_at int, anchor long, digest long")


class Segmenter:
    """Segments of byte blocks; ``length`` and ``gram`` as above."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, min(gram, length)
        size = BLOCK + 1
        with np.errstate(over="ignore"):
            self.up, self.down = np.ones(size, np.uint64), np.ones(size, np.uint64)
            self.up[1:], self.down[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        self.value = mix64(np.arange(1, 257, dtype=np.uint64))
        self.hasher = WordHasher(fold=False)

    def segments(self, buf: np.ndarray, bounds: np.ndarray):
        """(start, number of starts, anchor place, anchor hash, segment hash); documents lie between ``bounds``."""
        n, grams, window = len(buf), len(buf) - self.gram + 1, self.length - self.gram + 1
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none, none, none
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.value[buf] * self.up[:n], out=total[1:])
            gram = mix64((total[self.gram:] - total[:grams]) * self.down[:grams])
            # the least hash, the leftmost of equal ones, and its place in one number
            low = np.uint64((1 << 21) - 1)
            key = (gram & ~low) | np.arange(grams, dtype=np.uint64)
            anchor = (_sliding_min(key, window) & low).astype(np.int64)  # of the string at each place
            room = np.repeat(bounds[1:], np.diff(bounds))[:len(anchor)]
            valid = np.arange(len(anchor)) + self.length <= room
            anchor[~valid] = -1
            cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            number = np.diff(np.append(cut, len(anchor)))
            at = anchor[cut]
            cut, number, at = cut[at >= 0], number[at >= 0], at[at >= 0]
            end = cut + number - 1 + self.length
            digest = mix64(self.hasher.between(buf, cut, end) + (at - cut).astype(np.uint64))
        return cut, number, at - cut, gram[at].view(np.int64), digest.view(np.int64)


def _sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    n = len(x) - window + 1
    rows = -(-len(x) // window)
    padded = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    grid = padded.reshape(rows, window)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[window - 1:window - 1 + n])


def _byte_blocks(texts: list[bytes], length: int):
    """(document numbers, their first byte in the block, buf, bounds); pieces of a long text overlap by length - 1."""
    held, size = [], 0

    def joined():
        bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in held])]).astype(np.int64)
        return held, [0] * len(held), np.frombuffer(b"".join(texts[i] for i in held), np.uint8), bounds

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > BLOCK:
            for at in range(0, len(text) - length + 1, BLOCK - length):
                piece = np.frombuffer(text[at:at + BLOCK - 1], np.uint8)
                yield [i], [at], piece, np.array([0, len(piece)], np.int64)
            continue
        if size + len(text) > BLOCK:
            yield joined()
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        yield joined()


def _utf8(column) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _segment_rows(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segmenter(length, gram)
        for batch in small_batches(batches):
            texts = _utf8(batch.column(2))
            for docs, base, buf, bounds in _byte_blocks(texts, length):
                start, number, at, anchor, digest = cutter.segments(buf, bounds)
                which = np.searchsorted(bounds, start, side="right") - 1
                row = pa.array(np.asarray(docs, np.int64)[which])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(row), batch.column(1).take(row),
                    pa.array(start - bounds[which] + np.asarray(base, np.int64)[which]),
                    pa.array(number.astype(np.int32)), pa.array(at.astype(np.int32)),
                    pa.array(anchor), pa.array(digest),
                ], ["doc_id", "print", "start", "n_starts", "anchor_at", "anchor", "digest"])
    return rows


def _cut_rows(length: int):
    """(doc_id, print, text, wanted) -> a variant's bytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = _utf8(texts.slice(i, 1))[0]
                some = wanted[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([w["anchor"] for w in some], pa.int64()), pa.array([w["digest"] for w in some], pa.int64()),
                    pa.array([w["n"] for w in some], pa.int64()), pa.array([w["anchor_at"] for w in some], pa.int32()),
                    pa.array([text[w["start"]:w["start"] + w["n_starts"] + length - 1] for w in some], pa.binary()),
                ], ["anchor", "digest", "n", "anchor_at", "bytes"])
    return rows


def _shard_rows(length: int):
    """Suffix array of a shard's variants; their repeated starts as runs [from, to)."""
    def settle(table: pa.Table) -> pa.Table:
        variant = {}
        for a, d, n, b in zip(*(table.column(c).to_pylist() for c in ("anchor", "digest", "n", "bytes"))):
            variant.setdefault((a, d), (n, b))
        keys = sorted(variant)
        sizes = np.array([len(variant[k][1]) for k in keys], np.int64)
        # byte values from 1, and 0 after each variant: a string within one holds no 0
        buf = np.frombuffer(b"".join(variant[k][1] + b"\0" for k in keys), np.uint8) + np.uint16(1)
        first = np.cumsum(sizes + 1) - sizes - 1
        buf[first + sizes] = 0
        found = repeated_starts(buf, length)
        runs = []
        for k, at, size in zip(keys, first, sizes):
            starts = int(size) - length + 1
            runs.append(_runs(found[at:at + starts]) if variant[k][0] < 2 else [(0, starts)])
        return _run_table(keys, runs)
    return settle


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _run_table(keys, runs) -> pa.Table:
    keep = [i for i, r in enumerate(runs) if r]
    pair = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    return pa.table([
        pa.array([keys[i][0] for i in keep], pa.int64()), pa.array([keys[i][1] for i in keep], pa.int64()),
        pa.array([[{"from": a, "to": b} for a, b in runs[i]] for i in keep], pa.list_(pair)),
    ], names=["anchor", "digest", "runs"])


RUNS = "anchor long, digest long, runs array<struct<from:long,to:long>>"


def _string_rows(length: int):
    """One row per string of a variant: its place relative to the anchor and its hash."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, d, n, at, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                count = len(text) - length + 1
                prints = [hashlib.blake2b(text[i:i + length], digest_size=16).digest() for i in range(count)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([a] * count, pa.int64()), pa.array([d] * count, pa.int64()), pa.array([n] * count, pa.int64()),
                    pa.array(range(count), pa.int64()), pa.array(prints, pa.binary()),
                ], ["anchor", "digest", "n", "at", "string"])
    return rows


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, print, runs): byte positions [from, to) of a document whose strings of ``length`` bytes repeat."""
    segments = tables.written(
        docs.select("doc_id", "print", "text").mapInArrow(_segment_rows(length, gram), SEGMENT), "segments", 25 * docs.count())
    n_segments = segments.count()
    # written, so that the join below is one of two tables and adaptive execution can split a frequent anchor
    often = tables.written(segments.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), "often", n_segments)
    shared = tables.written(segments.join(often, "anchor"), "shared", n_segments)
    variants = tables.written(
        shared.groupBy("anchor", "digest")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "print", "start", "n_starts", "anchor_at")).alias("held"))
        .select("anchor", "digest", "n", "held.*"), "variants", n_segments)
    n_bytes = F.col("n_starts") + (length - 1)
    by_anchor = (variants.groupBy("anchor").agg(F.count("*").alias("variants"), F.sum(n_bytes).alias("bytes"))
                 .filter("variants > 1").select("anchor", "bytes"))
    several = variants.join(by_anchor, "anchor")
    wanted = (several.withColumn("doc", F.col("doc_id")).groupBy("doc", F.col("print").alias("of"))
              .agg(F.collect_list(F.struct("anchor", "digest", "n", "start", "n_starts", "anchor_at", "bytes")).alias("wanted")))
    held = (docs.select("doc_id", "print", "text")
            .join(wanted, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("print") == F.col("of")))
            .select("text", "wanted"))

    def cut(large: bool) -> DataFrame:
        some = held.select("text", F.filter("wanted", lambda w: (w["bytes"] > shard_bytes) == F.lit(large)).alias("wanted"))
        return some.filter(F.size("wanted") > 0).mapInArrow(
            _cut_rows(length), "anchor long, digest long, n long, anchor_at int, bytes binary")

    total, largest = several.agg(F.sum(n_bytes), F.max("bytes")).first()
    n_shards = max(1, -(-(total or 0) // shard_bytes))
    settled = (cut(False).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
               .groupBy("shard").applyInArrow(_shard_rows(length), RUNS))
    if (largest or 0) > shard_bytes:
        settled = settled.union(_counted(cut(True), length))
    # anchors whose segments are all alike
    alike = (variants.join(by_anchor, "anchor", "left_anti")
             .select("anchor", "digest", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_starts").cast("long").alias("to"))).alias("runs")))
    results = tables.written(settled.union(alike), "runs", 10 * variants.count())
    marks = shared.select("doc_id", "print", "start", "anchor", "digest").join(results, ["anchor", "digest"])
    moved = F.transform("runs", lambda r: F.struct((r["from"] + F.col("start")).alias("from"), (r["to"] + F.col("start")).alias("to")))
    return (marks.select(F.col("doc_id").alias("doc"), F.col("print").alias("of"), moved.alias("runs"))
            .groupBy("doc", "of").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def _counted(cuts: DataFrame, length: int) -> DataFrame:
    """The exact way for anchors beyond a shard: strings counted by (anchor, hash)."""
    strings = cuts.dropDuplicates(["anchor", "digest"]).mapInArrow(
        _string_rows(length), "anchor long, digest long, n long, at long, string binary")
    many = strings.groupBy("anchor", "string").agg(F.sum("n").alias("times")).filter("times > 1").select("anchor", "string")
    return (strings.join(many, ["anchor", "string"]).groupBy("anchor", "digest")
            .agg(F.collect_list(F.struct(F.col("at").alias("from"), (F.col("at") + 1).alias("to"))).alias("runs")))


def _removed(runs, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs from repeated starts."""
    spans = []
    for a, b in sorted((r["from"], r["to"]) for r in runs or ()):
        b = min(n, b + length - 1)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no UTF-8 character is cut."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))


def with_runs(docs: DataFrame, length: int, **more) -> DataFrame:
    """``docs`` (with the column print) and the runs of each."""
    runs = repeated_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "print", "text"), length, **more)
    return docs.join(runs, docs["doc_id"].eqNullSafe(runs["doc"]) & (docs["print"] == runs["of"]), "left").drop("doc", "of", "print")


def _digest_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                text = _utf8(batch.column(1).slice(i, 1))[0]
                spans = _removed(runs, len(text), length)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(columns[k], pa.int64()) for k in range(3)), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return rows


def _text_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, runs in enumerate(batch.column(batch.schema.get_field_index("runs")).to_pylist()):
                if runs:
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    kept, last = [], 0
                    for a, b in _whole_characters(raw, _removed(runs, len(raw), length)):
                        kept.append(raw[last:a])
                        last = b
                    texts[i] = b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")
            arrays = [pa.array(texts, batch.column(at).type) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays[:-1], batch.schema.names[:-1])
    return rows


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text and others) with every repeated string taken out of the texts, in whole characters."""
    inner = tables.inner(docs)
    found = with_runs(keyed(inner), length, gram=gram)
    return tables.outer(found.select(*inner.columns, "runs").mapInArrow(_text_rows(length), inner.schema), docs)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(keyed(tables.documents(spark, sf_dir).select("doc_id", "text")), LENGTH)
    return found.select("doc_id", "text", "runs").mapInArrow(
        _digest_rows(LENGTH), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
