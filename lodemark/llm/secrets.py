"""Secret scans by grammar inference.

Base findings come from three patterns (FIXED below). A bounded sample of them,
labelled by kind, becomes one prefix tree per kind, and a sample of ordinary
tokens another, as the background. States whose outgoing frequencies agree
within a Hoeffding bound, down the tree, are merged: first those of one depth,
layer by layer, then those of different depths if both were visited at least
MIN_VISITS times, as a bound on few visits accepts every merge. What is left is
a probabilistic automaton that keeps prefixes, lengths and the characters of
each place. Every maximal run of credential characters, as short as a base
finding may be or longer, is a candidate: its score is its mean log-likelihood
per character under a kind's automaton less that under the background, and it
is a ``format`` finding if that passes the kind's threshold, which best parts
held-out credentials from held-out ordinary tokens.

The sample is at most SAMPLE tokens a kind, those of lowest hash over the whole
table, so it does not depend on partitions; one pass gathers it. Inference runs
on the driver on that bounded sample; the scan is one pass over whole texts.

Defined results: null and empty texts have no findings; kinds with fewer than
MIN_SAMPLE distinct tokens share one automaton, and without any credential
there is none; repeated rows are scanned alike, each for itself; ties of the
hash go to the lesser token; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

# The base patterns, with the least length of what the match must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "format")

SAMPLE = 1000
#: Kinds with fewer distinct credentials share one automaton.
MIN_SAMPLE = 20
#: Visits of both states for a merge across depths.
MIN_VISITS = 100
#: Confidence of the compatibility test: smaller merges more.
ALPHA = 0.05
#: Every fifth token of the sample is held out for the threshold.
HELD = 5
#: Of the held-out ordinary tokens at most this share may pass a threshold.
FALSE_SHARE = 0.01
#: Verdicts on tokens that a task keeps.
KNOWN_TOKENS = 200_000
#: The kind of ordinary tokens in a sample.
PLAIN = "plain"
_SMOOTHING = 0.5
_ALPHABET = 68
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")  # runs are maximal: as long as the least base finding, without an upper bound

_assign = re.compile(ASSIGN, re.I | re.A)
_access = re.compile(ACCESS)
_hex = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so short ones need not be matched to be dropped
_HINTS = ("password", "passwd", "secret", "token", "api")


def base_findings(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential), leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _access.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _hex.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


class Automaton:
    """ALERGIA: a prefix tree of strings whose compatible states are merged, layers first, then across depths."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, least: int = MIN_VISITS):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.ends, self.visits = [0], [0]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.ends.append(0)
                    self.visits.append(0)
                at = self.next[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        letters = Counter(chain.from_iterable(strings))
        size = sum(letters.values()) + len(strings) + _ALPHABET
        self._every, self._unseen, self._end = {c: (n + 1) / size for c, n in letters.items()}, 1 / size, (len(strings) + 1) / size
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._is = list(range(len(self.next)))  # what a state was merged into
        self.states = self._infer(least)
        self.next = [{c: self._of(t) for c, t in x.items()} for x in self.next]
        del self._is

    def _of(self, state: int) -> int:
        while self._is[state] != state:
            self._is[state] = self._is[self._is[state]]
            state = self._is[state]
        return state

    def _differ(self, x: int, nx: int, y: int, ny: int) -> bool:
        return abs(x / nx - y / ny) > self._bound * (1 / math.sqrt(nx) + 1 / math.sqrt(ny))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the ends and next characters of two states agree, and of all pairs that the same characters lead to."""
        pairs, seen = [(a, b)], {(a, b)}
        while pairs:
            a, b = pairs.pop()
            na, nb = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            if any(self._differ(self.count[a].get(c, 0), na, self.count[b].get(c, 0), nb) for c in self.count[a].keys() | self.count[b].keys()):
                return False
            for c in self.next[a].keys() & self.next[b].keys():
                pair = (self._of(self.next[a][c]), self._of(self.next[b][c]))
                if pair[0] != pair[1] and pair not in seen:
                    seen.add(pair)
                    pairs.append(pair)
        return True

    def _merge(self, a: int, b: int) -> None:
        """Make b, and all that follows it, one with a and what follows that."""
        pairs = [(a, b)]
        while pairs:
            a, b = map(self._of, pairs.pop())
            if a == b:
                continue
            self._is[b] = a
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    pairs.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _infer(self, least: int) -> int:
        """Merge; gives the number of states left."""
        layer, kept = [0], []
        while layer:
            own: list[int] = []
            for s in sorted(layer, key=lambda x: -self.visits[x]):
                to = next((r for r in own if self._compatible(r, s)), None)
                own.append(s) if to is None else self._merge(to, s)
            own = list(dict.fromkeys(map(self._of, own)))
            kept += own
            layer = list(dict.fromkeys(self._of(t) for s in own for t in self.next[s].values()))
        for i, s in enumerate(kept):
            for r in kept[:i]:
                r, t = self._of(r), self._of(s)
                if r != t and min(self.visits[r], self.visits[t]) >= least and self._compatible(r, t):
                    self._merge(r, t)
                    break
        return len({self._of(s) for s in kept})

    def score(self, text: str) -> float:
        """Mean log-likelihood per character; the end counts as one. A state's frequencies are smoothed with those of all
        characters of the sample, which also stand for what no state has seen."""
        at, total, every = 0, 0.0, self._every
        for c in text:
            low = every.get(c, self._unseen)
            if at >= 0:
                total += math.log((self.count[at].get(c, 0) + _SMOOTHING * low) / (self.visits[at] + _SMOOTHING))
                at = self.next[at].get(c, -1)
            else:
                total += math.log(low)
        ends = (self.ends[at] + _SMOOTHING * self._end) / (self.visits[at] + _SMOOTHING) if at >= 0 else self._end
        return (total + math.log(ends)) / (len(text) + 1)


class Formats:
    """Automata of the kinds, the background, and each kind's threshold."""

    def __init__(self, sample: list[tuple[str, str]]):
        by = defaultdict(list)
        for kind, c in sorted(set(sample)):
            by[kind].append(c)
        plain = by.pop(PLAIN, [])
        rare = [k for k in by if len(by[k]) < MIN_SAMPLE]
        shared = sorted({c for k in rare for c in by.pop(k)})
        if shared:
            by["rare"] = shared
        self.plain = Automaton(plain[::2] if len(plain) > 1 else plain)
        self.automata: dict[str, Automaton] = {}
        self.thresholds: dict[str, float] = {}
        for kind, strings in by.items():
            many = len(strings) >= MIN_SAMPLE
            self.automata[kind] = Automaton([s for i, s in enumerate(strings) if i % HELD] if many else strings)
            self.thresholds[kind] = self._threshold(kind, strings[::HELD] if many else strings, plain[1::2])

    def _threshold(self, kind: str, held: list[str], plain: list[str]) -> float:
        """The score from which the share of held-out credentials less that of ordinary tokens is greatest, of those that few
        ordinary tokens pass; no token passes if there is none. The sample of ordinary tokens may hold a few bare credentials."""
        yes, no = sorted(self.score(kind, s) for s in held), sorted(self.score(kind, s) for s in plain)
        above = lambda scores, t: (len(scores) - bisect_left(scores, t)) / len(scores) if scores else 0.0
        fits = [t for t in yes if above(no, t) <= FALSE_SHARE]
        return max(fits, key=lambda t: (above(yes, t) - above(no, t), -t), default=math.inf)

    def score(self, kind: str, token: str) -> float:
        return self.automata[kind].score(token) - self.plain.score(token)

    def match(self, token: str) -> bool:
        if not self.automata:
            return False
        least = self.plain.score(token)
        return any(a.score(token) - least >= self.thresholds[k] for k, a in self.automata.items())


def _free(text: str, base: list) -> Iterator[tuple[int, int, str]]:
    """Candidates that no base finding overlaps, as (start, end, token): the ordinary tokens to learn from."""
    taken, k, reach = sorted((s, e) for s, e, _, _ in base), 0, 0
    for m in _CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= m.start():
            yield m.start(), m.end(), m[0]


def _spans_of(text: str | None, formats: Formats, known: dict[str, bool]) -> tuple[list, list]:
    if not text:
        return [], []
    base = base_findings(text)
    found = list(base)
    named = {(s, e) for s, e, _, _ in base}
    for m in _CANDIDATE.finditer(text):
        start, end, token = m.start(), m.end(), m[0]
        if (start, end) in named:
            continue
        hit = known.get(token)
        if hit is None:
            hit = formats.match(token)
            if len(known) < KNOWN_TOKENS and len(token) <= 64:
                known[token] = hit
        if hit:
            found.append((start, end, "format", token))
    return base, sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def credential_sample(documents: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(kind, credential): at most `sample` distinct base credentials of each kind and as many ordinary tokens (kind PLAIN), those
    of lowest hash. A task passes on its own `sample` lowest of each kind, so the tables after it are small."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        lowest: dict[str, dict[str, int]] = defaultdict(dict)
        for batch in batches:
            for t in batch["text"]:
                if t:
                    base = base_findings(t)
                    for kind, c in [*((kind, c) for _, _, kind, c in base), *((PLAIN, c) for _, _, c in _free(t, base))]:
                        of = lowest[kind]
                        if c not in of:
                            of[c] = xxhash.xxh64_intdigest(c)
                            if len(of) > 20 * sample:
                                lowest[kind] = dict(sorted(of.items(), key=lambda x: (x[1], x[0]))[:sample])
        rows = [(k, c, h >> 1) for k, of in lowest.items() for c, h in sorted(of.items(), key=lambda x: (x[1], x[0]))[:sample]]
        yield pd.DataFrame(rows, columns=["kind", "credential", "h"])

    found = documents.select(F.col(text).alias("text")).mapInPandas(run, "kind string, credential string, h long")
    found = checkpoint(found.distinct())
    parts = [found.filter(F.col("kind") == k).orderBy("h", "credential").limit(sample) for k in (*LEAST, PLAIN)]
    return reduce(DataFrame.unionByName, parts).select("kind", "credential")


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)


def scan_secrets(documents: DataFrame, formats: Formats, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format; spans are kind:start:end in code points."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(formats)  # bounded by the sample
    kind_of = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for batch in batches:
            rows = [_spans_of(t, shared.value, known) for t in batch["text"]]
            out = batch[["doc_id"]].copy()
            for kind in LEAST:
                out[f"n_{kind}"] = [sum(x[2] == kind for x in base) for base, _ in rows]
            out["base_sha256"] = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows]
            out["spans"] = [_joined(every) for _, every in rows]
            out["n_format"] = [len(every) - len(base) for base, every in rows]
            yield out

    got = documents.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    got = got.mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind_of))


def redact(documents: DataFrame, formats: Formats, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every finding replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(formats)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            out, at = [], 0
            for s, e, _, _ in _spans_of(t, shared.value, {})[1]:
                if s >= at:
                    out += [t[at:s], mask]
                at = max(at, e)
            return t if t is None else "".join(out) + t[at:]

        return texts.map(one, na_action="ignore")

    return documents.withColumn(text, clean(F.col(text)))
