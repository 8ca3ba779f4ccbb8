"""Alignment of two tokenizers' tokens, with external counting of the id pairs.

A text is encoded by A (byte-level BPE) with a blank in front and by B
(SentencePiece), which adds the blank itself.  Where a token of A and one of B end at
the same byte the two are linked, and the text is cut there into groups.

Encoding: a text is a run of units, white space and what follows it.  No token of A
goes on from a character into white space, by its pattern, and none of B, by its
vocabulary (which is looked through when it is loaded; white space that a piece does
go on into, such as a carriage return, doesn't end a unit), so every unit's end is a
cut, and ids, groups and links of a unit are worked out once per worker, kept under
the unit's own text and joined for a document.  Texts whose units aren't reproduced
byte by byte go to the tokenizers whole, which decides whether they have tokens.

Counting, with memory that does not grow with the corpus:

1. the task that encodes a portion of documents sorts its (pair, document, number)
   records side-major, B's id first, cuts them by radix (a hash of B's id) and writes
   each cut as a run of zstd frames: one row per radix and portion;
2. the runs of a radix are dealt to one group for each ``TARGET`` records and merged
   there: a heap holds the last pair of each run's present frame, and what lies up to
   the smallest of them is complete.  Each group gives a count for each pair, which
   Spark adds up; the largest for each B id comes from those sums;
3. the counts go back to the groups of their radix, where the runs are merged once
   more in the same order, and each record adds to its document: its number times
   the pair's count, and its number if the count is the largest of its B id.

A pair is in a document's records once however often it occurs there, a radix with
many records has many groups, and a task holds a frame of each run of its group and
the counts of one radix (bounded by the two vocabularies, not by the corpus).

Defined results: a text that is null or empty, or that one of the tokenizers doesn't
reproduce, has no tokens, zeros and an empty groups_sha256; special tokens' strings
are plain text; texts are taken whole, however long; every row of a repeated doc_id
is a document of its own; a null doc_id stays null; of equal counts all are the
largest; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables

MARK = "▁"
#: Fixed value: the characters of Unicode's property White_Space, which the pattern of A takes for white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Radices of B's ids; records that one group merges; records of a frame; characters of a portion; units and their characters that a worker keeps.
RADICES, TARGET, FRAME, PORTION, KEPT_UNITS, KEPT_CHARS = 32, 4 << 20, 1 << 14, 4 << 20, 1 << 18, 1 << 25
#: A pair is B's id and A's in so many bits each, a record the pair and the document's number in its portion.
ID_BITS, DOC_BITS = 20, 24
RECORDS = "radix int, n long, run binary, key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def printable_bytes() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies are written in: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class SideA:
    """Byte-level BPE from a tokenizer file, run by the library of ranks: the rank of a token is its id."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        of_char, special = printable_bytes(), {t["content"] for t in spec["added_tokens"] if t["special"]}
        entries = {bytes(of_char[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = {i: b for b, i in entries.items()}
        self.n_ids = 1 + max(spec["model"]["vocab"].values())
        self.encode = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=entries, special_tokens={}).encode_ordinary


class SideB:
    """SentencePiece pieces; ``unit``: white space and what follows it, up to white space that no piece goes on into."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_ids = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.n_ids)]
        self.bytes = {}
        for i, piece in enumerate(pieces):
            if self.model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            else:
                self.bytes[i] = b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace(MARK, " ").encode()
        entered = {x for p in pieces for x in re.findall(f"(?<=[^{WHITE}])[{WHITE}]", p.replace(MARK, " "))}
        goes_on = f"(?:[{re.escape(''.join(sorted(entered)))}][{WHITE}]*[^{WHITE}]*)*" if entered else ""
        self.unit = re.compile(f"[{WHITE}]+[^{WHITE}]*{goes_on}")
        self.lead = self.model.piece_to_id(MARK + "a")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def inner(self, units: list[str]) -> list[list[int]]:
        """Ids of units that stand inside a text: a letter in front keeps the library from adding its blank to the unit."""
        found = self.encode(["a" + u for u in units])
        return [ids[1:] if ids and ids[0] == self.lead else [] for ids in found]


class Aligner:
    """Groups and links of texts; a unit's are found once and kept."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        if max(self.a.n_ids, self.b.n_ids) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.text: list[str] = []
        self.sizes: list[tuple[int, int, int]] = []
        self.links: list[np.ndarray] = []

    def groups(self, ids_a: list[int], ids_b: list[int], raw: bytes) -> tuple[str, tuple[int, int, int], np.ndarray] | None:
        """(groups as text, (tokens of A, of B, groups), linked pairs); None if one side's bytes aren't ``raw``."""
        bytes_a, bytes_b = [self.a.bytes[i] for i in ids_a], [self.b.bytes[i] for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        text, pairs = [], []
        i = j = at_a = at_b = from_a = from_b = 0
        n_a, n_b = len(ids_a), len(ids_b)
        while i < n_a or j < n_b:
            if j >= n_b or i < n_a and at_a <= at_b:
                at_a += len(bytes_a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b and i > from_a and j > from_b:
                text.append(",".join(map(str, ids_a[from_a:i])) + "|" + ",".join(map(str, ids_b[from_b:j])))
                pairs.append(ids_b[j - 1] << ID_BITS | ids_a[i - 1])
                from_a, from_b = i, j
        return ";".join(text), (n_a, n_b, len(text)), np.array(pairs, np.uint64)

    def learn(self, units: list[str]) -> None:
        for unit, ids_b in zip(units, self.b.inner(units)):
            found = self.groups(self.a.encode(unit), ids_b, unit.encode())
            self.known[unit] = len(self.text) if found else -1
            self.chars += len(unit)
            if found:
                for held, x in zip((self.text, self.sizes, self.links), found):
                    held.append(x)

    def whole(self, text: str):
        return self.groups(self.a.encode(text), self.b.encode([text[1:]])[0], text.encode())

    def documents(self, texts: list[str]) -> list[tuple[str, tuple[int, int, int], np.ndarray] | None]:
        """What ``groups`` gives for each text, None for one without tokens."""
        if len(self.known) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self._forget()
        cut = [self.b.unit.findall(" " + t) if t else [] for t in texts]
        new = set().union(*cut) - self.known.keys() if cut else set()
        if new:
            self.learn(sorted(new))
        out = []
        for text, units in zip(texts, cut):
            number = [self.known[u] for u in units]
            if not text:
                out.append(None)
            elif min(number) < 0:
                out.append(self.whole(" " + text))
            else:
                sizes = [self.sizes[k] for k in number]
                out.append((";".join([self.text[k] for k in number]), tuple(map(sum, zip(*sizes))), np.concatenate([self.links[k] for k in number])))
        return out


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker: later tasks in the same worker know the units of earlier ones."""
    held = sys.modules.setdefault("_llm_aligners", types.ModuleType("_llm_aligners")).__dict__
    if (path_a, path_b) not in held:
        held[path_a, path_b] = Aligner(path_a, path_b)
    return held[path_a, path_b]


# ---- runs ------------------------------------------------------------------

def radix_of(pairs: np.ndarray) -> np.ndarray:
    """Radix of each pair: the upper bits of a product of B's id."""
    side = (pairs >> np.uint64(ID_BITS)).astype(np.uint32)
    return ((side * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(RADICES)


def write_run(pairs: np.ndarray, docs: np.ndarray, numbers: np.ndarray) -> bytes:
    """Sorted records as zstd frames: each has its length in bytes, its number of records, and their columns."""
    import zstandard

    pack, out = zstandard.ZstdCompressor(level=3), []
    for at in range(0, len(pairs), FRAME):
        some = slice(at, at + FRAME)
        p = pairs[some]
        body = pack.compress(np.diff(p, prepend=np.uint64(0)).tobytes() + docs[some].astype("<u4").tobytes() + numbers[some].astype("<u4").tobytes())
        out.append(np.array([len(body), len(p)], "<u4").tobytes() + body)
    return b"".join(out)


def read_run(run: bytes, base: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, document keys, numbers) frame by frame."""
    import zstandard

    unpack, at = zstandard.ZstdDecompressor(), 0
    while at < len(run):
        size, n = np.frombuffer(run, "<u4", 2, at).tolist()
        raw = unpack.decompress(run[at + 8:at + 8 + size], max_output_size=16 * n)
        at += 8 + size
        yield (np.cumsum(np.frombuffer(raw, np.uint64, n), dtype=np.uint64), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64) + base,
               np.frombuffer(raw, "<u4", n, 12 * n).astype(np.int64))


def merged(runs: list[Iterator]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The records of sorted runs in the order of their pairs, a portion at a time; a frame of each run is held."""
    held, heap = {}, []

    def fill(i: int) -> None:
        frame = next(runs[i], None)
        if frame is None:
            held.pop(i, None)
        else:
            held[i] = frame
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in range(len(runs)):
        fill(i)
    while heap:
        last = heap[0][0]
        taken = []
        for k, (pairs, docs, numbers) in list(held.items()):
            n = int(np.searchsorted(pairs, np.uint64(last), "right"))
            if n:
                taken.append((pairs[:n], docs[:n], numbers[:n]))
                held[k] = pairs[n:], docs[n:], numbers[n:]
        used = []
        while heap and heap[0][0] == last:
            used.append(heapq.heappop(heap)[1])
        for k in used:  # the next frame, which may hold nothing but the same pair again
            fill(k)
        columns = [np.concatenate(c) for c in zip(*taken)]
        order = np.argsort(columns[0], kind="stable")
        yield tuple(c[order] for c in columns)


def _aligning(path_a: str, path_b: str):
    """Tasks of the first pass: a row for each document and a run for each radix and portion."""
    names = ["radix", "n", "run", "key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, base = worker_aligner(path_a, path_b), TaskContext.get().partitionId() << 40

        def portion(ids, texts, base):
            found = aligner.documents(texts)
            out = []
            for i, (doc_id, x) in enumerate(zip(ids, found)):
                n_a, n_b, n = x[1] if x else (0, 0, 0)
                out.append((None, None, None, base + i, doc_id, n_a, n_b, n, n, hashlib.sha256(x[0].encode()).hexdigest() if x else ""))
            records = [x[2] << np.uint64(DOC_BITS) | np.uint64(i) for i, x in enumerate(found) if x]
            if records:
                record, number = np.unique(np.concatenate(records), return_counts=True)
                pairs, docs = record >> np.uint64(DOC_BITS), record & np.uint64((1 << DOC_BITS) - 1)
                radix = radix_of(pairs)
                for r in np.unique(radix).tolist():
                    some = radix == r
                    out.append((r, int(some.sum()), write_run(pairs[some], docs[some], number[some]), base, *[None] * 6))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        ids, texts, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(d)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= PORTION or len(ids) >= 1 << DOC_BITS:
                    yield portion(ids, texts, base)
                    ids, texts, size, base = [], [], 0, base + len(ids)
        if ids:
            yield portion(ids, texts, base)
    return rows


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(counts, runs) of each group of rows, which come sorted by (radix, salt, counts first)."""
    now, counts, runs = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            if now != (r["radix"], r["salt"]):
                if runs:
                    yield counts, runs
                now, counts, runs = (r["radix"], r["salt"]), [], []
            if r["run"] is None:
                counts.append((r["pair"], r["count"], r["most"]))
            else:
                runs.append(read_run(r["run"], r["key"]))
    if runs:
        yield counts, runs


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, runs in _groups_of(batches):
        for pairs, _, numbers in merged(runs):
            at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at].astype(np.int64)), pa.array(np.add.reduceat(numbers, at))], ["pair", "count"])


def _contributing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for counts, runs in _groups_of(batches):
        pair, count, most = (np.array(c) for c in zip(*counts))
        order = np.argsort(pair)
        pair, count, most = pair[order], count[order], most[order]
        held, size = [], 0

        def added():
            keys, sums, best = (np.concatenate(c) for c in zip(*held))
            unique, inverse = np.unique(keys, return_inverse=True)
            out = [np.zeros(len(unique), np.int64) for _ in range(2)]
            np.add.at(out[0], inverse, sums)
            np.add.at(out[1], inverse, best)
            return unique, *out

        for pairs, docs, numbers in merged(runs):
            at = np.searchsorted(pair, pairs.astype(np.int64))
            held.append((docs, numbers * count[at], numbers * most[at]))
            size += len(docs)
            if size > 1 << 20:
                held, size = [added()], 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], ["key", "count_sum", "n_best"])


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligning(path_a, path_b), RECORDS)
    first = tables.written(rows, "aligned")
    runs, documents = first.filter(F.col("radix").isNotNull()), first.filter(F.col("radix").isNull())
    # one row for each radix, RADICES at the most
    salts = runs.groupBy("radix").agg(F.ceil(F.sum("n") / TARGET).cast("long").alias("salts"))
    salted = runs.join(F.broadcast(salts), "radix").select(
        "radix", F.pmod(F.xxhash64("key"), "salts").cast("int").alias("salt"), "key", "run",
        *(F.lit(None).cast(t).alias(c) for c, t in (("pair", "long"), ("count", "long"), ("most", "boolean"))))
    n = tables.shuffle_partitions(docs.sparkSession)
    groups = salted.repartition(n, "radix", "salt").sortWithinPartitions("radix", "salt")
    counts = groups.mapInArrow(_counting, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = tables.written(counts.withColumn("side", F.shiftright("pair", ID_BITS).cast("int")), "pair-counts")
    largest = counts.groupBy("side").agg(F.max("count").alias("largest"))
    side = F.col("side").cast("long")
    radix = (F.shiftright((side * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF)), 16) % RADICES).cast("int")
    back = counts.join(largest, "side").select(radix.alias("radix"), "pair", "count", (F.col("count") == F.col("largest")).alias("most"))
    back = back.join(F.broadcast(salts), "radix").select(
        "radix", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("run"), "pair", "count", "most")
    both = salted.union(back).repartition(n, "radix", "salt").sortWithinPartitions("radix", "salt", F.col("run").isNotNull())
    added = (both.mapInArrow(_contributing, "key long, count_sum long, n_best long")
             .groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    return documents.join(added, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(tables.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
