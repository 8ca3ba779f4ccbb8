"""Token ids of documents in wavelet files, written in document order and read back.

Texts are dealt into ranges of doc_id and sorted; each range is tokenised and
written as files of about FILE_IDS ids, numbered (range, file).  The files are
rows (part, file, content) of a table in the shared folder, so Spark's committer
and file systems carry them: a lost executor's files are written again, and any
store that Spark reads will do.  Places before a document come from the files'
sizes: a running sum over the ranges (as many as shuffle partitions) and over
the files of a range.

The tokenizer drops white space and never joins across it, nor a word and the
marks beside it, so a text's ids are those of its units in turn; each distinct
unit is encoded once by the library (UnitEncoder).

Defined results: null text counts as empty and holds the end id only; null
doc_ids come first; rows that repeat a doc_id are in the order of their texts and
each has its own row; other columns may have any name.
"""

from __future__ import annotations

import os
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ddlscope.llm import tables
from ddlscope.llm.idstore import IdStore, room
from ddlscope.llm.textbytes import WordHasher, blocks
from ddlscope.llm.wavelet import WaveletMatrix, encode

END_ID = 1
FILE_IDS = 1 << 20
#: Distinct units a worker remembers (about 50 bytes each); beyond it the memory starts anew.
REMEMBERED = 1 << 21
#: Slots of the table of units seen last.
SLOT_BITS = 21
NO_ID = -(1 << 63)
#: Other characters of ASCII that a unit of letters holds.
PLAIN = frozenset("0123456789'")


class UnitEncoder:
    """Ids of texts by way of their distinct units.

    A unit is a run of ASCII marks or a run of other characters, without white
    space; upper and lower case are the same to the tokenizer.  Units are told
    apart by 64-bit hashes of their bytes, so a block of texts costs a few numpy
    passes, a sort, and the library's encoding of the units not seen before.

    Cutting at a mark is exact beside a letter or digit.  Where a unit touches
    another with an apostrophe or a sign beyond ASCII, also one that only the
    tokenizer's normal form has, or holds a control character or a special
    token's bracket, the whole document goes to the library instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.hasher = WordHasher()
        kind = np.full(256, 2, np.uint8)  # 0 white space, 1 marks, 2 the rest
        kind[:128] = 1
        kind[[*range(48, 58), *range(65, 91), *range(97, 123), ord("'")]] = 2
        kind[self.hasher.separator] = 0
        self.kind = kind
        self._forget()

    def _forget(self) -> None:
        self.store = IdStore()
        self.flag = np.zeros(1 << 16, np.uint8)
        # the last unit seen of each slot: most units are found here without a sort
        self.slot_hash, self.slot_unit = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)

    def _numbers(self, hashes: np.ndarray, raw, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The unit of each hash; new ones are encoded by the library."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        number = self.slot_unit[slot].astype(np.int64)
        rest = np.flatnonzero((self.slot_hash[slot] != hashes) | (hashes == 0))
        if len(rest):
            unit, where, inverse = np.unique(hashes[rest], return_index=True, return_inverse=True)
            new = self.store.missing(unit)
            if new.any():
                at = rest[where[new]]
                units = [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist())]
                first = self.store.learn(unit[new], [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)])
                self.flag = room(self.flag, len(self.store))
                self.flag[first:first + len(units)] = [_flag(u) for u in units]
            found = self.store.numbers(unit)
            number[rest] = found[inverse]
            slot = (unit >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.slot_hash[slot], self.slot_unit[slot] = unit, found
        return number

    def _block(self, buf: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each document, documents that need the library) of a block."""
        kind = self.kind[buf]
        edge = np.concatenate([[True], kind[1:] != kind[:-1]])
        edge[doc_start[doc_start < len(buf)]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(buf))
        solid = kind[start] > 0
        start, end = start[solid], end[solid]
        number = self._numbers(self.hasher.between(buf, start, end), memoryview(buf), start, end)
        ids, upto = self.store.joined(number)
        first = np.searchsorted(start, np.append(doc_start, len(buf)))
        per_doc = np.diff(np.concatenate([[0], upto])[first])
        touch = np.concatenate([[False], start[1:] == end[:-1]])
        touch[first[:-1][first[:-1] < len(touch)]] = False  # not across documents
        touch |= np.concatenate([touch[1:], [False]])
        flag = self.flag[number]
        odd = (flag == 1) | (flag == 2) & touch
        return ids, per_doc, np.diff(np.concatenate([[0], np.cumsum(odd)])[first]) > 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        if len(self.store) > REMEMBERED:
            self._forget()
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        library = set()
        for buf, doc_start, docs in blocks(raw, self.hasher.separator):
            if not len(buf):
                continue
            ids, sizes, odd = self._block(buf, doc_start)
            ends = np.cumsum(sizes)
            for k, doc in enumerate(docs):
                parts[doc].append(ids[ends[k] - sizes[k]:ends[k]])
                if odd[k]:
                    library.add(doc)
        for doc in library:
            parts[doc] = [np.array(self.tokenizer.encode(texts[doc], add_special_tokens=False).ids, np.uint32)]
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


def _flag(unit: str) -> int:
    """1: its document needs the library; 2: does so if it touches another unit."""
    if "<|" in unit or "|>" in unit or any(c < " " or c == "\x7f" for c in unit):
        return 1
    if unit[0] == "'" or unit[-1] == "'" or not unit.isascii() and any(not c.isalpha() and c not in PLAIN for c in unit + _normal(unit)):
        return 2
    return 0


def _normal(unit: str) -> str:
    """As the tokenizer sees it: some letters become a letter and a combining mark there."""
    return unicodedata.normalize("NFC", unit).lower()


def worker_encoder(path: str) -> UnitEncoder:
    """The encoder of this Python worker: later tasks in the same worker know the units of earlier ones."""
    held = sys.modules.setdefault("_llm_unit_encoders", types.ModuleType("_llm_unit_encoders")).__dict__
    if path not in held:
        held[path] = UnitEncoder(path)
    return held[path]


def _portions(batches: Iterator[pa.RecordBatch], chars: int = 4 << 20):
    """(doc ids, texts) of about so many characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(NO_ID if d is None else d)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _writer(path: str, end_id: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, file = worker_encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        held_ids, held, size = [], [], 0

        def row():
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            content = encode(np.concatenate(held), np.array(held_ids, np.int64), starts)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int64()), pa.array([size], pa.int64()),
                                               pa.array([content], pa.binary())], ["part", "file", "n_ids", "content"])

        for ids, texts in _portions(batches):
            for d, tokens in zip(ids, encoder.encode(texts)):
                held_ids.append(d)
                held.append(np.concatenate([tokens, end]))
                size += len(held[-1])
                if size >= file_ids:
                    yield row()
                    held_ids, held, size, file = [], [], 0, file + 1
        if held:
            yield row()
    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """The table of files (part, file, n_ids, content), in ascending doc_id order, as read back from the shared folder."""
    n = tables.shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    in_order = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = in_order.mapInArrow(_writer(tokenizer_path, end_id, file_ids), "part int, file long, n_ids long, content binary")
    return tables.written(files, "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            file = WaveletMatrix(batch.column(3)[k].as_py())
            raw = memoryview(file.decode().astype("<u4").tobytes())
            at = file.starts
            n = len(file.doc_ids)
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            ids = pa.array(file.doc_ids, mask=file.doc_ids == NO_ID)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([k] * n, pa.int64())), batch.column(1).take(pa.array([k] * n, pa.int64())),
                ids, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64()),
            ], ["part", "file", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per range, as many as shuffle partitions
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    sizes = files.select("part", "file", "n_ids").join(before_part, "part")
    before = sizes.select("part", "file", (F.col("before") - F.col("n_ids") + F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("file"))).alias("before"))
    rows = files.select("part", "file", "n_ids", "content").mapInArrow(
        _read, "part int, file long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (rows.join(before, ["part", "file"])
            .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(tables.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(files)
