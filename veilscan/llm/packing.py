"""Packing by vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces of documents) and loss-bearing tokens.  Examples
wait in a window of bounded size; an open sequence repeatedly takes the waiting one that fits and whose demand
vector, each part divided by its limit, has the largest dot product with what is left of the limits.  When none
fits, one is cut to fill the rest exactly.  A sequence that must stay short (the last of a partition, or one
whose segments are used up) is cut back to a power of two, so that it needs no padding.

Each partition packs its own rows, so there is no shuffle and no limit on the number of rows; a partition ends
with at most a few short sequences.  A sequence's id is its partition's number and its own number within it.

Defined results: a null text is empty and still has the end token; repeated rows are packed one by one; an empty
table gives an empty result; a piece may be as short as one token; columns other than ``doc_id`` and ``text``
(and ``loss`` where asked for) are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import slices
from veilscan.llm.scripts import LETTERS, NUMBERS, SPACE, byte_letters, is_plain

END_ID = 1
#: The window of waiting examples; it bounds a task's memory.
WINDOW = 192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_PIECES = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048


class _Merger:
    """Ids of single words for a vocabulary whose words end in a marked letter.

    Merging by the rank of what is merged gives the library's ids if every token of the vocabulary is what its own
    letters merge to: a span that the merges leave whole is then merged as it is alone, which only one pair ends.
    That is tested when a vocabulary is loaded; where it fails, the library's model is asked for each word.
    """

    END = b"\xff"  # a byte that UTF-8 never has stands for the mark

    def __init__(self, tokenizer, path: str) -> None:
        import tiktoken
        from tokenizers import models

        self.model = tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        letters = byte_letters()
        self.to_letters = {b: c for c, b in letters.items()}
        mark = spec["end_of_word_suffix"] or ""

        def raw(token: str) -> bytes:
            ended = bool(mark) and token.endswith(mark)
            return bytes(letters[c] for c in (token.removesuffix(mark) if ended else token)) + (self.END if ended else b"")

        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        made = {a + b: raw(a + b) for a, b in merges}
        inner = models.BPE(vocab=spec["vocab"], merges=[tuple(m) for m in merges])  # without the mark

        def whole(token: str) -> bool:
            pieces = self.model.tokenize(token.removesuffix(mark)) if token.endswith(mark) else inner.tokenize(token)
            return len(pieces) == 1 and pieces[0].value == token

        self.exact = bool(mark) and all(map(whole, made))
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + self.END for b in range(255)]
        first = set(order)
        order += [r for r in dict.fromkeys(made.values()) if r not in first]
        by_raw = {raw(t): i for t, i in spec["vocab"].items() if all(c in letters for c in t.removesuffix(mark))}
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks={r: k for k, r in enumerate(order)}, special_tokens={})._core_bpe
        self.packed = [struct.pack("<I", by_raw.get(r, 0)) for r in order]

    def ids(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        if self.exact:
            return b"".join([self.packed[i] for i in self.core.encode_single_piece(data + self.END)])
        pieces = self.model.tokenize(data.decode("latin-1").translate(self.to_letters))
        return struct.pack(f"<{len(pieces)}I", *(p.id for p in pieces))


class _Known(dict):
    """Ids, as little-endian bytes, of what stands between white space; found when first asked for."""

    def __init__(self, merger: _Merger) -> None:
        super().__init__()
        self.merge = merger.ids

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            ids = self.merge(chunk)
        else:
            ids = b"".join([self.merge(w) for w in _PIECES.findall(chunk)])
        self[chunk] = ids
        return ids


class WordIds:
    """Ids of texts as the ``tokenizers`` library gives them.

    Plain texts are normalised and cut at white space here, as the vocabulary file states, and each such part is
    merged once while it is remembered; any other text goes through the library as a whole.
    """

    MAX_WORDS = 150_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(_Merger(self.tokenizer, path))
        # separators that are white space to Python only, and special strings
        self.other = [*"\x1c\x1d\x1e\x1f", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if not is_plain(text) or any(s in text for s in self.other):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        chunks = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        if len(self.known) > self.MAX_WORDS:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), dtype="<u4")


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker: tasks that follow in it find the words of those before."""
    return WordIds(path)


@dataclass
class Example:
    """What is left to place of a document: ids from ``start`` on, and running sums of its loss-bearing tokens."""

    doc: int | None
    start: int
    ids: np.ndarray
    total: int
    loss: np.ndarray | None = None  # loss[i]: loss-bearing tokens among the first i ids left; None: all are

    def loss_of(self, n: int) -> int:
        return n if self.loss is None else int(self.loss[n])

    def longest(self, tokens: int, loss: int) -> int:
        """The most of its first ids that keep to both bounds."""
        n = min(tokens, len(self.ids))
        return min(n, loss) if self.loss is None else min(n, int(np.searchsorted(self.loss, loss, side="right")) - 1)

    def split(self, n: int) -> tuple[Example, Example]:
        head, tail = (None, None) if self.loss is None else (self.loss[: n + 1], self.loss[n:] - self.loss[n])
        return Example(self.doc, self.start, self.ids[:n], self.total, head), Example(self.doc, self.start + n, self.ids[n:], self.total, tail)


class Packer:
    """Places examples; finished sequences are handed out as lists of pieces."""

    def __init__(self, limits: Limits = Limits(), window: int = WINDOW) -> None:
        self.limits, self.window = limits, window
        self.waiting: list[Example] = []
        self.sizes = np.zeros((2, 2 * window + 4096), dtype=np.int64)  # tokens, loss-bearing tokens
        self.tokens = 0

    def add(self, example: Example) -> None:
        if len(self.waiting) == self.sizes.shape[1]:
            self.sizes = np.hstack([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[:, len(self.waiting)] = len(example.ids), example.loss_of(len(example.ids))
        self.waiting.append(example)
        self.tokens += len(example.ids)

    def _take(self, k: int) -> Example:
        out = self.waiting[k]
        last = self.waiting.pop()
        if last is not out:
            self.waiting[k] = last
            self.sizes[:, k] = self.sizes[:, len(self.waiting)]
        self.tokens -= len(out.ids)
        return out

    def put(self, example: Example) -> Iterator[list[Example]]:
        """Add a document; hand out the sequences that can be closed."""
        limit = self.limits.tokens
        while len(example.ids) >= limit and example.loss_of(limit) <= self.limits.loss_tokens:
            whole, example = example.split(limit)
            yield [whole]
        if len(example.ids):
            self.add(example)
        while len(self.waiting) >= self.window and self.tokens >= limit:
            yield self.sequence(limit)

    def finish(self) -> Iterator[list[Example]]:
        while self.waiting:
            yield self.sequence(min(self.limits.tokens, 1 << (self.tokens.bit_length() - 1)))

    def sequence(self, capacity: int) -> list[Example]:
        """One sequence of at most ``capacity`` tokens, by the dot-product heuristic."""
        limits = self.limits
        left, segments, loss = capacity, limits.segments, limits.loss_tokens
        out: list[Example] = []
        while left and segments and self.waiting:
            tokens, weights = self.sizes[:, : len(self.waiting)]
            fits = (tokens <= left) & (weights <= loss)
            if fits.any():
                value = tokens * (left / limits.tokens**2) + weights * (loss / limits.loss_tokens**2) + segments / limits.segments**2
                piece = self._take(int(np.argmax(np.where(fits, value, -1.0))))
            else:
                k = int(np.argmax(tokens))
                n = self.waiting[k].longest(left, loss)
                if n < 1:
                    break
                example = self._take(k)
                piece, rest = example.split(n)
                if len(rest.ids):
                    self.add(rest)
            out.append(piece)
            left, segments, loss = left - len(piece.ids), segments - 1, loss - piece.loss_of(len(piece.ids))
        used = capacity - left
        spare = used - (1 << (used.bit_length() - 1)) if used < limits.tokens else 0
        while spare:  # back to a power of two; what is cut off waits for another sequence
            piece = out.pop()
            cut = min(spare, len(piece.ids))
            head, tail = piece.split(len(piece.ids) - cut)
            if len(head.ids):
                out.append(head)
            self.add(tail)
            spare -= cut
        return out


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = END_ID, loss_from: str | None = None) -> DataFrame:
    """Pieces of all documents of ``docs`` and where they lie; see ``SCHEMA``.

    ``path`` is the vocabulary file, read on the executors.  ``loss_from`` names an integer column: the document's
    tokens from that number on bear loss (an instruction's answer); without it, or where it is null, all do.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(path), Packer(limits)
        task, end = TaskContext.get(), np.array([end_id], dtype="<u4")
        number = (task.partitionId() if task else 0) << 40

        def rows(sequences: Iterator[list[Example]]) -> Iterator[tuple]:
            nonlocal number
            for pieces in sequences:
                at = 0
                for p in pieces:
                    yield p.doc, p.start, len(p.ids), zlib.crc32(p.ids), p.total, number, at, p.loss_of(len(p.ids))
                    at += len(p.ids)
                number += 1

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        for batch in slices(batches):
            firsts = batch.column(2).to_pylist() if loss_from else [None] * batch.num_rows
            out: list[tuple] = []
            for doc, text, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), firsts, strict=True):
                ids = np.append(words.encode(text), end)
                loss = None if first is None else np.maximum(np.arange(len(ids) + 1) - first, 0)
                out += rows(packer.put(Example(doc, 0, ids, len(ids), loss)))
            if out:
                yield table(out)
        if out := list(rows(packer.finish())):
            yield table(out)

    chosen = [F.col("doc_id").cast("long").alias("doc_id"), "text"] + ([F.col(loss_from).cast("long").alias("first")] if loss_from else [])
    return docs.select(*chosen).mapInArrow(run, SCHEMA)
