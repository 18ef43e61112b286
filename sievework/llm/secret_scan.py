"""Secrets in texts: fixed patterns, and formats learnt from them.

Method: grammar inference. The values that the base patterns find are labelled credentials. Per kind, a prefix tree of their
characters (in classes) is folded by merging states whose outgoing frequencies are statistically compatible (Hoeffding bound, the
ALERGIA test, in the usual red and blue order), which gives a probabilistic automaton of the format. Every other run of `LEAST` or
more characters of the value alphabet in every text is a candidate, and so are its parts between `.`, `/` and `=`. A candidate's
score under a kind is its log-likelihood ratio of the automaton against a model of all candidates, over the root of its length; it
becomes a span of kind `format` from the kind's margin on, a part only if the whole does not. The margin is where labelled values,
each scored by an automaton of the other half, are best told from the candidates of all texts (highest F1 by numbers of both), so
most labelled credentials clear it if they differ from ordinary words at all.

The automata are fitted on at most `SAMPLE` values of each kind (the least by hash) with `CHARACTERS` characters together; values
are taken whole or not at all. The search and the model of candidates cover all texts.
Results: null or empty texts have no spans; repeated rows get equal results; without any base match nothing is added; an empty
table gives an empty result. Extra columns are ignored. Places are code points.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "format")
BASE = KINDS[:3]
#: Documented bounds of the fit, by kind: values, and their characters together.
SAMPLE, CHARACTERS = 2000, 200_000
#: Confidence of the merge test; least characters of a candidate, as of a value of the base; width of a step of scores.
ALPHA, LEAST, STEP = 0.05, 6, 0.05
#: Entries that a task holds at once in a table of patterns.
HELD = 1 << 17

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"(?P<k>[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?(?P<v>[A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as runs can't end inside a match
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PART = re.compile(r"[A-Za-z0-9+_-]{6,}")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed patterns."""
    out = []
    lower = text.encode().lower()
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign", m["v"]) for m in _ASSIGN.finditer(text) if len(m["v"]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list) -> list[list[tuple[int, int, str]]]:
    """Runs of the value alphabet that no base span touches, without dots at the ends; each is followed by its parts."""
    out = []
    for m in _TOKEN.finditer(text):
        start, end, run = m.start(), m.end(), m[0]
        if base and any(s < end and start < e for s, e, *_ in base):
            continue
        if run[-1] == "." or run[0] == ".":
            start, run = start + len(run) - len(run.lstrip(".")), run.strip(".")
        if len(run) >= LEAST:
            parts = [(start + p.start(), start + p.end(), p[0]) for p in _PART.finditer(run)] if "." in run or "/" in run or "=" in run else []
            out.append([(start, start + len(run), run), *(p for p in parts if p[2] != run)])
    return out


def symbol(c: str) -> str:
    """The class of a character: hexadecimal letters and digits are told from others, marks stand for themselves."""
    if c.isdigit():
        return "0"
    if c in "abcdef":
        return "a"
    if c in "ABCDEF":
        return "A"
    return "z" if c.islower() else "Z" if c.isupper() else c


CLASSES = str.maketrans({chr(c): symbol(chr(c)) for c in range(128)})
#: So many characters of each class share its probability.
WIDTH = {"0": 10, "a": 6, "A": 6, "z": 20, "Z": 20}


class Automaton:
    """A probabilistic automaton by state merging; words are strings of classes."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for w in words:
            q = 0
            for s in w + "$":
                self.count[q][s] += 1
                if s != "$":
                    if s not in self.next[q]:
                        self.next[q][s] = len(self.next)
                        self.next.append({})
                        self.count.append(Counter())
                    q = self.next[q][s]
        self._merge()
        self.totals = [c.total() for c in self.count]

    def _alike(self, p: int, q: int) -> bool:
        """Hoeffding's test on the outgoing frequencies, and on those of all states that a merge would join."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.count[p].total(), self.count[q].total()
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.count[p][s] / n - self.count[q][s] / m) > bound for s in self.count[p].keys() | self.count[q].keys()):
                return False
            todo += [(self.next[p][s], self.next[q][s]) for s in self.next[p].keys() & self.next[q].keys() if self.next[p][s] != self.next[q][s]]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.count[p].update(self.count[q])
            for s, t in self.next[q].items():
                if s in self.next[p]:
                    todo.append((self.next[p][s], t))
                else:
                    self.next[p][s] = t

    def _merge(self) -> None:
        red = [0]
        while blue := [(p, s) for p in red for s, q in sorted(self.next[p].items()) if q not in red]:
            p, s = blue[0]
            q = self.next[p][s]
            for r in red:
                if self._alike(r, q):
                    self.next[p][s] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)

    def score(self, word: str) -> float:
        """Log-likelihood, with a little mass for what was never seen."""
        q, total = 0, 0.0
        for s in word + "$":
            n = self.totals[q] if q >= 0 else 0
            p = (self.count[q][s] + 0.01) / (n + 0.1) if n else 0.001
            total += math.log(p / WIDTH.get(s, 1))
            q = self.next[q].get(s, -1) if q >= 0 else -1
        return total


class Words:
    """Ordinary tokens: pairs of character classes, from counts."""

    def __init__(self, pairs: dict[tuple[str, str], int]) -> None:
        self.pairs, self.first = Counter(pairs), Counter()
        for (a, _), n in pairs.items():
            self.first[a] += n

    def score(self, word: str) -> float:
        s = f"^{word}$"
        return sum(math.log((self.pairs[a, b] + 1) / (self.first[a] + 12) / WIDTH.get(b, 1)) for a, b in zip(s, s[1:], strict=False))


class Model:
    """Automata by kind, the words they are held against, and the margin of each kind."""

    def __init__(self, automata: dict[str, Automaton], words: Words, margins: dict[str, float]) -> None:
        self.automata, self.words, self.margins, self.known = automata, words, margins, {}

    def scores(self, word: str) -> dict[str, float]:
        ordinary, root = self.words.score(word), math.sqrt(len(word) + 1)
        return {k: (a.score(word) - ordinary) / root for k, a in self.automata.items()}

    def judge(self, token: str) -> tuple[float, bool]:
        """The highest score, and whether a kind's margin is reached."""
        word = token.translate(CLASSES)
        if (out := self.known.get(word)) is None:
            if len(self.known) >= HELD:
                self.known.clear()
            by_kind = self.scores(word)
            out = self.known[word] = max(by_kind.values()), any(v >= self.margins[k] for k, v in by_kind.items())
        return out


def _seen(source: DataFrame) -> DataFrame:
    """kind, value, n: the labelled values of all texts, and the classes of the candidates as kind `format`."""

    def run(batches):
        held: Counter = Counter()

        def batch():
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string()), pa.array(list(held.values()), pa.int64())], ["kind", "value", "n"])

        for b in batches:
            for text in b.column("_text"):
                text = text.as_py()
                found = base_spans(text)
                held.update((k, v.strip(".")) for _, _, k, v in found)
                held.update(("format", t.translate(CLASSES)) for group in candidates(text, found) for _, _, t in group)
                if len(held) >= HELD:
                    yield batch()
                    held.clear()
        yield batch()

    return source.mapInArrow(common.tidy(run), "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def _pairs(other: DataFrame) -> dict[tuple[str, str], int]:
    """Pairs of classes over all candidates: a few dozen rows."""

    def run(batches):
        pairs: Counter = Counter()
        for b in batches:
            for word, n in zip(b.column("value").to_pylist(), b.column("n").to_pylist(), strict=True):
                s = f"^{word}$"
                for pair in zip(s, s[1:], strict=False):
                    pairs[pair] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in pairs], pa.string()), pa.array([k[1] for k in pairs], pa.string()), pa.array(list(pairs.values()), pa.int64())], ["a", "b", "n"])

    return {(r.a, r.b): r.n for r in other.mapInArrow(common.tidy(run), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def margin(labelled: list[float], rows: int, other: dict[int, int]) -> float:
    """The score, of those that labelled values have, with the highest F1: `labelled` stands for `rows` values; `other` counts all
    candidates by step of score."""
    above, total, best = dict(other), len(labelled), (-1.0, math.inf)
    steps = sorted(above, reverse=True)
    i = seen = 0
    for j, t in enumerate(sorted(labelled, reverse=True), 1):
        while i < len(steps) and steps[i] >= math.floor(t / STEP):
            seen += above[steps[i]]
            i += 1
        hit = rows * j / total
        best = max(best, (2 * hit / (hit + seen + rows), -math.floor(t / STEP) * STEP))
    return -best[1]


def learn(source: DataFrame) -> Model | None:
    """The model of the labelled values and candidates of all texts; None without labelled values."""
    seen = common.settled(_seen(source), "secrets")
    labelled, fitted = seen.where("kind <> 'format'"), {}
    rows = {r.kind: r.n for r in labelled.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    for kind in rows:  # bounded: SAMPLE values and CHARACTERS characters each
        drawn = labelled.where((F.col("kind") == kind) & (F.char_length("value") <= CHARACTERS)).orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
        total = F.sum(F.char_length("value")).over(Window.orderBy(F.xxhash64("value"), "value").rowsBetween(Window.unboundedPreceding, 0))
        if words := [r.value.translate(CLASSES) for r in drawn.withColumn("total", total).where(F.col("total") <= CHARACTERS).orderBy("total").collect()]:
            fitted[kind] = words
    if not fitted:
        return None
    other = seen.where("kind = 'format'").select("value", "n")
    model = Model({kind: Automaton(words) for kind, words in fitted.items()}, Words(_pairs(other)), {})
    held = source.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        counts, model = Counter(), pickle.loads(held.value)
        for b in batches:
            for word, n in zip(b.column("value").to_pylist(), b.column("n").to_pylist(), strict=True):
                for k, v in model.scores(word).items():
                    counts[k, math.floor(v / STEP)] += n
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([v for _, v in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["kind", "step", "n"])

    steps = other.mapInArrow(common.tidy(run), "kind string, step long, n long").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect()  # scores in steps
    for kind, words in fitted.items():
        halves = (words[::2], words[1::2]) if len(words) > 1 else (words, words)
        gains = [g for i in (0, 1) for a in [Model({kind: Automaton(halves[i])}, model.words, {})] for w in halves[1 - i] for g in a.scores(w).values()]
        model.margins[kind] = margin(gains, rows[kind], {r.step: r.n for r in steps if r.kind == kind})
    return model


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans (`kind:start:end`, comma-joined), best (the highest format score)."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    # by value, so executors don't need the package
    held = source.sparkSession.sparkContext.broadcast(cloudpickle.dumps(learn(source.select("_text"))))

    def run(batches):
        model = pickle.loads(held.value)
        for b in batches:
            counts, digests, joined, best = defaultdict(list), [], [], []
            for text in b.column("_text"):
                text = text.as_py()
                found = base_spans(text)
                spans, top = [s[:3] for s in found], None
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in spans))
                digests.append(hashlib.sha256(_listed(spans).encode()).hexdigest())
                for group in candidates(text, found) if model else []:
                    for i, (start, end, token) in enumerate(group):
                        score, reached = model.judge(token)
                        top = score if top is None else max(top, score)
                        if reached:
                            spans.append((start, end, "format"))
                            if not i:
                                break
                joined.append(_listed(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))))
                best.append(top)
            columns = [b.column("_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "best"])

    schema = f"id {id_type}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, best double"
    return source.mapInArrow(common.tidy(run), schema).withColumnRenamed("id", id_col)


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
