"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context.

The lexicon is a trie of terms (whole words) and stems (word beginnings), each with its own number of allowed
edits.  All terms' Levenshtein automata are run over a word at once: a state is the set of (trie node, edits)
pairs that the letters read so far can reach, and states and transitions are made when first needed and kept,
so a word costs one table look-up per letter.  Each hit is weighed by a window of words around it: a hit
between quotation marks, or after a reporting verb, counts as quotation, which never speaks for abuse, one with a
person addressed nearby as abuse.  A ridge logistic model over these sums gives the score.

Lexicon and weights are learned from labelled rows only: of a bounded sample, words and word beginnings that
(almost) only toxic rows have, chosen greedily by how many toxic rows they newly explain, then those that stand out
beyond chance though others explain their rows.  A beginning that clean rows have too, now and then, is judged by
its share: it counts only in texts where at least two different words, and a learned share of all different words,
begin so.  What is learned is added to the default lexicon, which always holds.

Defined results: a null or empty text has no hits and gets the model's base score; rows are scored one by one,
so repeated rows get equal scores; an empty table gives an empty result; without labels the default lexicon and
default weights hold; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import bounded_sample, map_batches, slices

#: At most so many labelled rows are used to learn lexicon and weights.
SAMPLE_ROWS = 12_000
#: Words on either side of a hit that its context score looks at.
CONTEXT_WORDS = 6
THRESHOLD = 0.3
#: Word beginnings of these lengths, and whole words, may become entries.
PREFIX_LENGTHS = range(4, 11)
MAX_ENTRIES = 400
#: Shares, in thousandths of a text's different words, that the words with one beginning may have to reach.
SHARES = (4, 8, 16, 32)
#: So many toxic rows have to have a gram, at the least; a share already takes two different words in each.
LEAST_ROWS, LEAST_SHARE_ROWS = 3, 2
#: A gram that clean rows have too has to be so many times as frequent in toxic rows.
PURER = 20
#: Always in the lexicon; labels add to it.
DEFAULT_TERMS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "retard")
#: Words that report what somebody else said, and words that address or point at a person.
REPORTING = frozenset("said says called calls wrote writes quote quoted quotes word term phrase heard reads titled sagte schrieb nannte zitat wort dit écrit appelé mot cité dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your youre u he she they him her them these those du dich dir ihr euch sie tu te toi vous ton votre eres tú usted ustedes".split())
TOKEN = re.compile(r"\w+(?:[*@$]+\w+)*")
QUOTE_OPEN, QUOTE_CLOSE = "\"“„«‹", "\"”“»›"
_QUOTE_SPAN = 160
FEATURES = ("exact", "near", "quoted", "addressed", "distinct")
#: Prior means of the weights (base score first); learning shrinks towards them.
PRIOR = (-3.0, 2.5, 1.2, -0.5, 0.5, 1.0)


@dataclass(frozen=True)
class Entry:
    """A lexicon entry; ``stem`` entries match the beginning of a word.

    With a ``share`` (thousandths) a stem's hits count only where two different words, and that share of the text's
    different words, begin with it.
    """

    text: str
    edits: int
    stem: bool
    weight: float = 1.0
    share: int = 0


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class LexiconAutomaton:
    """The entries' Levenshtein automata run over a trie, as a lazily built deterministic automaton."""

    entries: list[Entry]
    max_states: int = 60_000
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def __post_init__(self) -> None:
        self.ends: dict[int, list[int]] = {}
        for k, entry in enumerate(self.entries):
            at = 0
            for char in entry.text:
                if char not in self.nodes[at]:
                    self.nodes[at][char] = len(self.nodes)
                    self.nodes.append({})
                at = self.nodes[at][char]
            self.ends.setdefault(at, []).append(k)
        self.budget = [0] * len(self.nodes)  # the most edits any entry below a node allows
        for node in range(len(self.nodes) - 1, -1, -1):  # children have larger numbers
            own = max((self.entries[k].edits for k in self.ends.get(node, ())), default=-1)
            self.budget[node] = max([own, *(self.budget[c] for c in self.nodes[node].values())])
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stems: list[tuple[tuple[int, int], ...]] = []
        self.wholes: list[tuple[tuple[int, int], ...]] = []
        self._state({(0, 0)})

    def _state(self, reached: Iterable[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(reached)
        while todo:  # a letter of the entry that the word lacks costs one edit
            node, edits = todo.pop()
            if edits > self.budget[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += ((child, edits + 1) for child in self.nodes[node].values())
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(k, e) for node, e in best.items() for k in self.ends.get(node, ()) if e <= self.entries[k].edits]
            self.stems.append(tuple(h for h in hits if self.entries[h[0]].stem))
            self.wholes.append(tuple(h for h in hits if not self.entries[h[0]].stem))
        return self.ids[key]

    def _move(self, state: int, char: str) -> int:
        out = []
        for node, edits in self.sets[state]:
            out.append((node, edits + 1))  # a letter too many in the word
            for letter, child in self.nodes[node].items():
                out.append((child, edits + (letter != char)))
        self.moves[state][char] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """The (entry, edits) with the fewest edits that ``word`` matches, else None."""
        if len(self.sets) > self.max_states:
            self.reset()
        state, best = 0, None
        for char in word:
            to = self.moves[state].get(char)
            state = self._move(state, char) if to is None else to
            if not self.sets[state]:
                return best
            for k, e in self.stems[state]:
                if best is None or (e, k) < (best[1], best[0]):
                    best = k, e
        for k, e in self.wholes[state]:
            if best is None or (e, k) < (best[1], best[0]):
                best = k, e
        return best


@dataclass(frozen=True)
class Model:
    entries: tuple[Entry, ...]
    weights: tuple[float, ...] = PRIOR


class Scorer:
    """Scores texts with a model; keeps what it has found out about words, within a bound."""

    MAX_WORDS = 120_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.plain = [e for e in model.entries if not e.share]
        self.automaton = LexiconAutomaton(self.plain)
        self.shared = {e.text: e for e in model.entries if e.share}
        self.lengths = sorted({len(t) for t in self.shared}, reverse=True)
        self.known: dict[str, tuple[Entry, int] | str | None] = {}

    def _match(self, word: str) -> tuple[Entry, int] | str | None:
        """The word's entry and edits, or the beginning whose share decides."""
        found = self.automaton.match(word)
        if found is not None:
            return self.plain[found[0]], found[1]
        return next((word[:k] for k in self.lengths if word[:k] in self.shared), None)

    def hits(self, words: set[str]) -> dict[str, tuple[Entry, int]]:
        known = self.known
        if len(known) > self.MAX_WORDS:
            known.clear()
        for word in words.difference(known):
            known[word] = self._match(word)
        found = {w: h for w in words if (h := known[w])}
        if not self.shared:
            return found
        sizes = Counter(word[:k] for word in found for k in self.lengths if k <= len(word) and word[:k] in self.shared)
        enough = {t for t, n in sizes.items() if n >= 2 and 1000 * n >= self.shared[t].share * len(words)}
        out = {}
        for w, h in found.items():
            if not isinstance(h, str):
                out[w] = h
            elif (t := next((w[:k] for k in self.lengths if w[:k] in enough), None)) is not None:
                out[w] = self.shared[t], 0
        return out

    def spans(self, text: str | None) -> list[dict]:
        """Every hit of the text: start, end, word, entry, edits, quoted, addressed."""
        lower = (text or "").lower()
        found = self.hits(set(TOKEN.findall(lower)))
        if not found:
            return []
        tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(lower)]
        out = []
        for i, (word, start, end) in enumerate(tokens):
            if word not in found:
                continue
            around = [t[0] for t in tokens[max(0, i - CONTEXT_WORDS) : i]], [t[0] for t in tokens[i + 1 : i + 1 + CONTEXT_WORDS]]
            before, after = lower[max(0, start - _QUOTE_SPAN) : start], lower[end : end + _QUOTE_SPAN]
            quoted = self._in_quotes(before, after) or not REPORTING.isdisjoint(around[0])
            entry, edits = found[word]
            out.append({"start": start, "end": end, "word": word, "entry": entry.text, "edits": edits, "weight": entry.weight, "quoted": quoted, "addressed": not ADDRESS.isdisjoint(around[0] + around[1])})
        return out

    @staticmethod
    def _in_quotes(before: str, after: str) -> bool:
        before, after = before.rpartition("\n")[2], after.partition("\n")[0]
        opened = max((before.rfind(c) for c in QUOTE_OPEN), default=-1)
        if opened < 0 or not any(c in after for c in QUOTE_CLOSE):
            return False
        if before[opened] == '"':
            return before.count('"') % 2 == 1
        return not any(c in before[opened + 1 :] for c in QUOTE_CLOSE)

    def features(self, text: str | None) -> list[float]:
        spans = self.spans(text)
        own = [s for s in spans if not s["quoted"]]
        return [
            float(np.log1p(sum(s["weight"] for s in own if not s["edits"]))),
            float(np.log1p(sum(s["weight"] for s in own if s["edits"]))),
            float(np.log1p(sum(s["weight"] for s in spans if s["quoted"]))),
            float(np.log1p(sum(s["addressed"] for s in own if not s["edits"]))),
            float(np.log1p(max(0, len({s["entry"] for s in own if not s["edits"]}) - 1))),
        ]

    def score(self, features: list[float]) -> float:
        z = self.model.weights[0] + float(np.dot(self.model.weights[1:], features))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _grams(text: str | None) -> set[str]:
    """Word beginnings of the text, its whole words with a ``$`` behind, and beginnings with ``%`` and a share reached."""
    words = set(TOKEN.findall((text or "").lower()))
    out, begun = set(), Counter()
    for word in words:
        if len(word) > 3:
            if len(word) <= 40:
                out.add(word + "$")
            begun.update(word[:k] for k in PREFIX_LENGTHS if k <= len(word))
    out.update(begun)
    out.update(f"{g}%{s}" for g, n in begun.items() if n > 1 for s in SHARES if 1000 * n >= s * len(words))
    return out


def entry_of(gram: str) -> Entry:
    """The lexicon entry that a gram stands for."""
    if gram.endswith("$"):
        return Entry(gram[:-1], allowed_edits(len(gram) - 1), False)
    text, _, share = gram.partition("%")
    return Entry(text, 0, True, 1.0, int(share or 0))


def least_rows(gram: str) -> int:
    return LEAST_SHARE_ROWS if "%" in gram else LEAST_ROWS


def _counted(texts: DataFrame, keep: frozenset[str] | None) -> DataFrame:
    """How many texts have each gram (of ``keep``, where given): counted in parts of bounded size, then summed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])
            seen.clear()
            return out

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                grams = _grams(text)
                seen.update(grams if keep is None else grams & keep)
                if len(seen) > 100_000:
                    yield counts()
        yield counts()

    return texts.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _contexts(texts: DataFrame, keep: frozenset[str]) -> DataFrame:
    """In how many contexts, pairs of the words before and after, the grams of ``keep`` (without shares) occur."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: set[tuple[str, int]] = set()
        for text in batch.column(0).to_pylist():
            words = ["", *TOKEN.findall((text or "").lower()), ""]
            for before, word, after in zip(words, words[1:], words[2:], strict=False):
                if 3 < len(word):
                    held = keep.intersection((word + "$", *(word[:k] for k in PREFIX_LENGTHS if k <= len(word))))
                    if held:
                        seen.update((g, xxhash.xxh3_64_intdigest(f"{before} {after}") >> 1) for g in held)
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int64())], names=["gram", "context"])

    return map_batches(texts.select("text"), run, "gram string, context long").distinct().groupBy("gram").agg(F.count("*").alias("n"))


def default_entries() -> list[Entry]:
    return [Entry(t, allowed_edits(len(t)), False) for t in DEFAULT_TERMS]


def chance_rows(counts: Iterable[int], share: float) -> int:
    """So many rows that of grams in ``counts`` rows hardly one in all is in toxic rows only by chance, if ``share`` are toxic."""
    held = Counter(counts)
    left, rows = held.total(), 1
    while left * share**rows > 0.05:
        left -= held[rows]
        rows += 1
    return rows


def choose_entries(positive: dict[int, set[str]], good: dict[str, int], beyond_chance: int, given: Iterable[Entry] = ()) -> list[Entry]:
    """Entries that add to those ``given``, by greedy cover of the positive rows: each is the gram that explains the
    most rows not yet explained, while there are enough of these; then come the grams that only occur where others do
    and are worth (``good``) at least ``beyond_chance`` rows."""
    known = {e.text for e in given}
    rows: dict[str, set[int]] = {}
    covered: set[int] = set()
    for i, grams in positive.items():
        if any(t + "$" in grams for t in known):
            covered.add(i)
        for g in grams & good.keys():
            rows.setdefault(g, set()).add(i)
    gain = {g: n for g, ids in rows.items() if (n := len(ids - covered)) >= least_rows(g)}
    # of equals the one that more rows have, a whole word before a share (of two words each), that before a stem, the more specific
    kind = {g: 2 if g.endswith("$") else 1 if "%" in g else 0 for g in rows}
    chosen: list[Entry] = []

    def admit(g: str) -> None:
        entry = entry_of(g)
        chosen.append(entry)
        known.add(entry.text)
        for other in [f"{entry.text}%{s}" for s in SHARES] if entry.share else [g]:  # a beginning has one share
            rows.pop(other, None)
            gain.pop(other, None)

    while gain and len(chosen) < MAX_ENTRIES:
        g = max(gain, key=lambda g: (gain[g], len(rows[g]), kind[g], len(g), g))
        new = rows[g] - covered
        covered |= new
        admit(g)
        for other in set().union(*(positive[i] & gain.keys() for i in new)):
            gain[other] -= len(rows[other] & new)
            if gain[other] < least_rows(other):
                del gain[other]
    for g in sorted(rows, key=lambda g: (-good[g], -kind[g], -len(g), g)):
        if len(chosen) >= MAX_ENTRIES or g not in rows or good[g] < beyond_chance:
            continue
        text = entry_of(g).text
        if not any(text.startswith(t) or t.startswith(text) for t in known):
            admit(g)
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method, shrunk towards ``prior``."""
    data, w0 = np.hstack([np.ones((len(x), 1)), x]), np.asarray(prior)
    w = w0.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        gradient = data.T @ (p - y) + ridge * (w - w0)
        step = np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + ridge * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` rows of ``labels`` (doc_id, toxic) and their documents' texts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") == 1).alias("is_toxic"))
    sample = bounded_sample(known, "doc_id", sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows ids
    # of rows that repeat an id the least text counts, so there are no more rows than labels and reruns agree
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", "is_toxic")).alias("row")).select("doc_id", "row.*").persist()
    try:
        sizes = {r["is_toxic"]: r["n"] for r in texts.groupBy("is_toxic").agg(F.count("*").alias("n")).collect()}
        n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
        entries = default_entries()
        if n_pos and n_neg:
            least = F.when(F.col("gram").contains("%"), LEAST_SHARE_ROWS).otherwise(LEAST_ROWS)
            in_pos = {r["gram"]: r["n"] for r in _counted(texts.where("is_toxic"), None).where(F.col("n") >= least).collect()}
            in_neg = {r["gram"]: r["n"] for r in _counted(texts.where("not is_toxic"), frozenset(in_pos)).collect()}

            def pure(n: dict[str, int]) -> dict[str, int]:
                return {g: k for g, k in n.items() if k >= least_rows(g) and (g not in in_neg or (k + 0.5) / (n_pos + 1) > PURER * (in_neg[g] + 0.5) / (n_neg + 1))}

            # rows that copy one passage tell no more than one does: a gram is worth no more rows than it has contexts
            good = pure(in_pos)
            contexts = {r["gram"]: r["n"] for r in _contexts(texts.where("is_toxic"), frozenset(g.partition("%")[0] for g in good)).collect()}
            good = pure({g: min(n, contexts[g.partition("%")[0]]) for g, n in good.items()})
            keep = frozenset(good) | {e.text + "$" for e in entries}
            beyond_chance = chance_rows((n + in_neg.get(g, 0) for g, n in in_pos.items()), n_pos / (n_pos + n_neg))

            def grams_of(batch: pa.RecordBatch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(_grams(t) & keep) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "grams"])

            held = map_batches(texts.where("is_toxic").select("doc_id", "text"), grams_of, "doc_id long, grams array<string>").collect()
            entries += choose_entries({r["doc_id"]: set(r["grams"]) for r in held}, good, beyond_chance, entries)
        if not (n_pos and n_neg):
            return Model(tuple(entries))
        measured = features(texts.select("doc_id", "text"), Model(tuple(entries))).join(F.broadcast(sample), "doc_id").limit(sample_rows).toPandas()
        measured = measured.sort_values("doc_id", kind="stable")
        weights = fit_weights(np.array(measured["features"].tolist()), measured["is_toxic"].to_numpy(dtype=float))
        # evidence must not count against a text, nor quotation for one
        return Model(tuple(entries), (weights[0], *(min(0.0, w) if name == "quoted" else max(0.0, w) for name, w in zip(FEATURES, weights[1:], strict=True))))
    finally:
        texts.unpersist()


def _scored(docs: DataFrame, model: Model, schema: str, make) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            yield make(scorer, batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def features(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the features of its text."""

    def make(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "features"])

    return _scored(docs, model, "doc_id long, features array<double>", make)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the number of hits of each row's whole text."""

    def make(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [scorer.features(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(f) for f in each], pa.float64())], names=["doc_id", "score"])

    return _scored(docs, model, "doc_id long, score double", make)


def hits(docs: DataFrame, model: Model) -> DataFrame:
    """One row per hit: doc_id, start, end (code points of the lower-cased text), word, entry, edits, quoted, addressed."""
    kinds = {"start": pa.int32(), "end": pa.int32(), "word": pa.string(), "entry": pa.string(), "edits": pa.int32(), "quoted": pa.bool_(), "addressed": pa.bool_()}

    def make(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in scorer.spans(t)]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), *(pa.array([s[k] for _, s in rows], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return _scored(docs, model, "doc_id long, start int, end int, word string, entry string, edits int, quoted boolean, addressed boolean", make)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores below ``threshold``."""
    position = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.score(scorer.features(t)) < threshold for t in batch.column(position).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
