"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For a word (a piece that the tokenizer's pattern cuts out), every prefix has exactly one possible last token:
the token that ends there and whose neighbour before it, the last token of the shorter prefix, is one that the
merges leave beside it.  So one pass over the word gives the exact token count at each of its prefixes, and
sums over words give the count at each prefix of the text.  Truncation ("the longest prefix within a budget")
and budget questions are look-ups and one word's table; nothing is encoded again.

Only the merges of two neighbouring tokens' bytes are ever replayed, once for each pair of tokens met.  Words
are remembered within a bound.  The result equals the library's for the same file, special strings inside texts
being one token each, as is the library's default.

Defined results: null counts as empty, with 0 bytes and 0 tokens; repeated rows are counted one by one; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import slices
from veilscan.llm.scripts import LETTERS, NUMBERS, SPACE, byte_letters, is_plain

LIMIT = 1024
#: Fixed: how the byte-level vocabularies cut text before merging, for any text and for plain characters.
_ANY = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_PLAIN = re.compile(rf"""'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+""")


_CHUNK = regex.compile(r"(\s*+)(\S+)|\s+")


class PrefixCounter:
    """Exact token counts of texts and of their prefixes for one vocabulary file."""

    MAX_WORDS = 400_000
    MAX_PAIRS = 1_000_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.mark = os.path.commonprefix(special)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.known: dict[str, int] = {}
        self.beside: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merges replayed over a few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _can_meet(self, a: int, b: int) -> bool:
        """Whether the merges leave token ``b`` beside token ``a``."""
        pair = a << 20 | b
        known = self.beside.get(pair)
        if known is None:
            if len(self.beside) > self.MAX_PAIRS:
                self.beside.clear()
            left, right = self.tokens[a], self.tokens[b]
            known = self.beside[pair] = self.merged(left + right) == [left, right]
        return known

    def _extend(self, data: bytes, counts: list[int], last: list[int]) -> None:
        """Carry the tables of a prefix of ``data`` on to all of it: the dynamic programme's step for each longer prefix."""
        vocab, beside, longest = self.vocab, self.beside, self.longest
        for end in range(len(counts), len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = vocab.get(data[start:end])
                if token is not None and (not start or ((ok := beside.get(last[start] << 20 | token)) or ok is None and self._can_meet(last[start], token))):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break

    def word_table(self, data: bytes) -> list[int]:
        """Token counts of all prefixes of one word's bytes, from the empty one on."""
        counts, last = [0], [-1]
        self._extend(data, counts, last)
        return counts

    def learn(self, words: Iterable[str]) -> None:
        """Remember the counts of words; in sorted order each goes on from the prefix it shares with the one before."""
        before, counts, last = b"", [0], [-1]
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            same = 0
            for x, y in zip(before, data, strict=False):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self._extend(data, counts, last)
            self.known[word] = counts[len(data)]
            before = data

    def split(self, text: str) -> list[str]:
        return _PLAIN.findall(text) if is_plain(text) else _ANY.findall(text)

    def word_counts(self, words: list[str]) -> list[int]:
        if len(self.known) > self.MAX_WORDS:
            self.known.clear()
        self.learn(set(words).difference(self.known))
        return list(map(self.known.__getitem__, words))

    def count_all(self, texts: list[str | None], characters: int = 4_000_000) -> list[int]:
        """Tokens of each whole text; words of several texts, up to about so many characters, are learned at once."""
        out: list[int] = []
        while len(out) < len(texts):
            held, size = [], 0
            while len(out) + len(held) < len(texts) and (not held or size < characters):
                text = texts[len(out) + len(held)] or ""
                size += len(text)
                pieces = [(part, special) for part, special in self._stretches(text)]
                held.append((sum(special for _, special in pieces), [self.split(part) for part, special in pieces if not special]))
            if len(self.known) > self.MAX_WORDS:
                self.known.clear()
            self.learn(set().union(*(words for _, parts in held for words in parts)).difference(self.known))
            out += (n + sum(sum(map(self.known.__getitem__, words)) for words in parts) for n, parts in held)
        return out

    def _stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special and self.mark in text else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        return sum(1 if special else sum(self.word_counts(self.split(part))) for part, special in self._stretches(text or ""))

    def prefix_counts(self, text: str | None) -> list[int]:
        """The exact count of text[:i], for each i from 0 to len(text), by the words' tables."""
        out = [0]
        for part, special in self._stretches(text or ""):
            base = out[-1]
            if not special:
                tail_base, tail = base, ""
                for space, solid in self._chunks(part):
                    tail_base, tail = out[-1], space + solid
                    out += self._table(out[-1], space, solid)
                continue
            if len(out) == 1 or not tail:
                tail_base, tail = base, ""
            # a special string that is cut short is plain text, cut into words together with what it follows
            short, at = [tail_base], tail + part[:-1]
            for space, solid in self._chunks(at):
                short += self._table(short[-1], space, solid)
            out += short[len(tail) + 1 :]
            out.append(base + 1)
            tail = ""
        return out

    def _chunks(self, part: str) -> Iterator[tuple[str, str]]:
        """White space and what follows it up to the next, one after the other: no word reaches from one chunk into another."""
        for m in _CHUNK.finditer(part):
            yield (m.group(1), m.group(2)) if m.group(2) else (m.group(), "")

    def _pieces(self, space: str, solid: str) -> tuple[list[str], list[str]]:
        """The words of a chunk: of its white space, and the rest, to whose first word a last blank belongs."""
        if not solid:
            return [space] if space else [], []
        lead = space[-1:] if space.endswith(" ") else ""
        alone = [space[:-1]] if lead else [space[:-1], space[-1:]]
        return [w for w in alone if w], self.split(lead + solid)

    def _total(self, space: str, solid: str) -> int:
        before, words = self._pieces(space, solid)
        return sum(self.word_counts(before + words))

    def _table(self, base: int, space: str, solid: str) -> list[int]:
        """The counts at each prefix of a chunk that ``base`` tokens come before."""
        # white space that nothing follows yet is one word
        out = self._inside(base, space) if space else []
        before, words = self._pieces(space, solid)
        base += sum(self.word_counts(before)) if solid else 0
        for k, word in enumerate(words):
            if word[0] == "'" and word[1:].isalpha():  # a contraction is none until its last letter is there
                quote = self.word_counts(["'"])[0]
                out.append(base + quote)
                out += [base + quote + n for n in self.word_counts([word[1:2]] if len(word) == 3 else [])]
                out.append(base + self.word_counts([word])[0])
            else:
                own = self._inside(base, word)
                out += own[1:] if not k and space.endswith(" ") else own
            base = out[-1]
        return out

    def _inside(self, base: int, word: str) -> list[int]:
        table, at, out = self.word_table(word.encode("utf-8", "surrogatepass")), 0, []
        for char in word:
            at += len(char.encode("utf-8", "surrogatepass"))
            out.append(base + table[at])
        return out

    def truncation(self, text: str | None, limit: int) -> int:
        """The length of the longest prefix with at most ``limit`` tokens.

        Whole chunks are summed up; each has a token at least, so the cut falls into the last one that begins below the
        limit, or a special string behind it, and this one's table tells where.
        """
        base = at = 0
        last = (0, 0, "")  # the chunk that the longest prefix may end in: tokens and characters before it, its text
        for part, special in self._stretches(text or ""):
            if special:  # its beginning may go on with white space or signs before it
                last = (*last[:2], last[2] + part)
                if base >= limit:
                    break
                base, at = base + 1, at + len(part)
                continue
            for space, solid in self._chunks(part):
                if base >= limit:
                    break
                last = (base, at, space + solid)
                base, at = base + self._total(space, solid), at + len(space) + len(solid)
            else:
                continue
            break
        else:
            if base <= limit:
                return at
        counts = self.prefix_counts(last[2])
        return last[1] + max((i for i, n in enumerate(counts) if last[0] + n <= limit), default=0)


@lru_cache(maxsize=1)
def prefix_counter(path: str) -> PrefixCounter:
    """One for each worker: tasks that follow in it find the words of those before."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text.  ``path`` is read on the executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in slices(batches, 1_024):  # more words are new at once, so more share a beginning
            texts = batch.column(1).to_pylist()
            counts = counter.count_all(texts)
            sizes = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and counts, the exact token count at every code-point prefix of its text (counts[i] for text[:i])."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in slices(batches, 16):
            tables = [counter.prefix_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, counts array<int>")
