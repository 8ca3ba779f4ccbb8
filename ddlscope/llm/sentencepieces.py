"""SentencePiece encoding and decoding of documents by a shared-prefix forward pass.

A text becomes marked words: blanks are written as the mark, one mark stands in
front, and a word runs from its marks to the next mark (no piece of the model
goes on past that).  The distinct marked words of a portion of texts are sorted,
which walks their trie depth-first; the forward values of a word's prefixes are
kept on a stack, and the next word goes on from the prefix that both share.

The given model file is a BPE model, whose pieces have merge priorities and no
probabilities, so a forward value is not a sum of scores: it is the last piece of
the prefix's encoding.  A piece can end a prefix exactly if the prefix before it
ends with a piece that it stands beside unmerged, that is, if encoding those two
pieces together gives the two again.  At most one piece of the vocabulary does,
which makes the pass a Viterbi search whose scores are 0 and minus infinity, and
gives the ids of the model's own encoder.

Characters without a piece become bytes.  Decoding joins the pieces' bytes, turns
marks into blanks and drops the first; a mark character in a text decodes as a
blank, everything else comes back as it was.

Defined results: null text counts as empty and has no ids; repeated rows are all
returned; a null doc_id stays null; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables
from ddlscope.llm.idstore import IdStore
from ddlscope.llm.textbytes import WordHasher, blocks

MARK = "▁"
#: Words and pairs of pieces that a task remembers at the most.
REMEMBERED = 1 << 20


class PieceModel:
    """The normal pieces of a BPE model file, their priorities, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.priority: dict[str, float] = {}
        raw = []
        byte_ids = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                self.ids[piece] = i
                self.priority[piece] = model.get_score(i)
                raw.append(piece.replace(MARK, " ").encode())
        self.byte_ids = [byte_ids[b] for b in range(256)]
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            sizes.setdefault(p[-1], {1}).add(len(p))
        self.ends = {c: sorted(s, reverse=True) for c, s in sizes.items()}  # sizes of the pieces that end with a character
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self._beside: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by repeated merging: the pair whose union has the highest priority first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = self.priority.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or p > best):
                    best, at = p, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _ends_first(self, piece: str) -> bool:
        """Is a piece its own encoding?"""
        if len(piece) == 1:
            return True
        if piece not in self._alone:
            self._alone[piece] = self.merged(piece) == [piece]
        return self._alone[piece]

    def _stands_beside(self, left: str, right: str) -> bool:
        if len(self._beside) > REMEMBERED:
            self._beside.clear()
        fits = self._beside[left, right] = bool(left) and self.merged(left + right) == [left, right]
        return fits

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted distinct ``words``."""
        out, last, before = [], [""], ""
        ids, ends, beside, stands, alone = self.ids, self.ends, self._beside, self._stands_beside, self._ends_first
        for word in words:
            n, shared = min(len(word), len(before)), 0
            while shared < n and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:]
            for i in range(shared + 1, len(word) + 1):
                found = ""
                for size in ends.get(word[i - 1], (1,)):
                    if size > i:
                        continue
                    piece = word[i - size:i]
                    if size > 1 and piece not in ids:
                        continue
                    if size == i:
                        fits = alone(piece)
                    else:
                        left = last[i - size]
                        fits = beside.get((left, piece))
                        if fits is None:
                            fits = stands(left, piece)
                    if fits:
                        found = piece
                        break
                last.append(found)
            before = word
            out.append(self._back(word, last))
        return out

    def _back(self, word: str, last: list[str]) -> list[int]:
        parts, i = [], len(word)
        while i and last[i]:
            parts.append(last[i])
            i -= len(last[i])
        if i:  # no piece fits: merge the word by itself
            parts = self.merged(word)[::-1]
        ids = []
        for part in reversed(parts):
            if part in self.ids:
                ids.append(self.ids[part])
            else:
                ids.extend(self.byte_ids[b] for b in part.encode("utf-8", "replace"))
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        if not len(size):
            return b""
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1])].tobytes()[1:]


class WordIds:
    """Ids of texts; each distinct word is searched once and remembered by the hash of its bytes."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.store = IdStore()
        blank = np.zeros(256, bool)
        blank[32] = True
        self.hasher = WordHasher(blank, fold=False)
        # a character that no piece holds stands alone, so a line end may end a word as well
        self.line_end = not any("\n" in p for p in model.ids)

    def _block(self, buf: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each document's ids start) of a block of texts that start with a blank."""
        blank = buf == 32
        cut = np.concatenate([[True], blank[1:] & ~blank[:-1]])
        if self.line_end:
            end = buf == 10
            cut |= end
            cut[1:] |= end[:-1]
        cut[doc_start[doc_start < len(buf)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        unit, where, inverse = np.unique(self.hasher.between(buf, start, end), return_index=True, return_inverse=True)
        new = self.store.missing(unit)
        if new.any():
            raw = buf.tobytes()
            words = [raw[start[i]:end[i]].decode("utf-8", "replace").replace(" ", MARK) for i in where[new]]
            order = sorted(range(len(words)), key=words.__getitem__)
            lists: list[list[int]] = [[]] * len(words)
            for i, ids in zip(order, self.model.words([words[i] for i in order])):
                lists[i] = ids
            self.store.learn(unit[new], lists)
        ids, ends = self.store.joined(self.store.numbers(unit)[inverse])
        first = np.searchsorted(start, np.append(doc_start, len(buf)))
        return ids, np.concatenate([[0], ends])[first]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.store) > REMEMBERED:
            self.store.clear()
        raw = [(" " + t.replace(MARK, " ")).encode("utf-8", "replace") if t else b"" for t in texts]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for buf, doc_start, docs in blocks(raw, self.hasher.separator):
            if len(buf):
                ids, at = self._block(buf, doc_start)
                for k, doc in enumerate(docs):
                    parts[doc].append(ids[at[k]:at[k + 1]])
        return [np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


def worker_words(path: str) -> WordIds:
    """The words of this Python worker: later tasks in the same worker know those of earlier ones."""
    held = sys.modules.setdefault("_llm_word_ids", types.ModuleType("_llm_word_ids")).__dict__
    if path not in held:
        held[path] = WordIds(PieceModel(path))
    return held[path]


def _rows(path: str, chars: int = 4 << 20):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_words(path)

        def done(some):
            ids = coder.encode([t for _, t in some])
            return pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in some], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(coder.model.decode(x)).hexdigest() for x in ids], pa.string()),
            ], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

        some, size = [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some.append((d, t or ""))
                size += len(some[-1][1])
                if size >= chars:
                    yield done(some)
                    some, size = [], 0
        if some:
            yield done(some)
    return rows


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, text)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_words(model_path)
        for batch in batches:
            ids = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def op4_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, crc32 of the ids as little-endian 32-bit integers, sha256 of the text decoded from them."""
    docs = tables.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_rows(public_tokenizers.path("piece_bpe_32k.model")),
                           "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
