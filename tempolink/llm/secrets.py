"""Secret scans by grammar inference.

Fixed rules find the base spans in all texts.  The credentials that those rules
label, a bounded sample of them, make a prefix tree for each kind.  Level by
level, states whose continuations are statistically compatible (ALERGIA's test
with the Hoeffding bound, whose width follows from both states' visits) are
merged into the best supported one, down through their trees, into a
probabilistic automaton: prefixes, alphabets, separators and lengths are its
states.  Then states of unlike depth merge where many credentials show that not
only what follows but how much still follows is alike: a format of any length
becomes a loop, one of a fixed length stays a chain.  Beside a loop goes the range
of the lengths.

Every run of credential symbols of every text, and where it isn't likely itself
its pieces between ``=``, ``/`` and ``.``, is then scored by how likely the
automaton writes it, its end included, against how likely ordinary text does, as
a chain of letter pairs or a plain number.  Likely ones outside base spans are
added as kind ``grammar``; base spans have the score of their credential.  Pieces
that belong together are scored from each start in one sweep over what follows.

The automaton has the first ``LEARNED`` symbols of credentials; what follows them
is one state of its own, which counts symbols in any order.  So all symbols are
learned and scored, and yet no labelled value, however long, makes an automaton
grow; sums over this last state are differences of running sums.

Defined cases: null and empty texts have no spans; a null doc_id stays null;
repeated rows are each scanned; without labelled credentials only base spans
come out, with score 0; an empty table gives no rows; a text of any length is
scanned whole.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .shared import pick, small_batches

#: Credentials of each kind that the automata are inferred from.
SAMPLE_CREDENTIALS = 600
#: Symbols of a credential that the automaton has; those that follow are counted alike.
LEARNED = 128
ALPHA = 0.05
#: Widest bound by which states of unlike depth may merge: it takes some thirty credentials each.
EVIDENCE = 0.5
#: Least gain over ordinary text, in nats a symbol and in all, for a span to be added.
GAIN = 0.5
GAIN_IN_ALL = 12.0
#: How far, in nats a symbol, a candidate's likelihood may lie below three deviations from the labelled credentials' mean.
BELOW = 0.3

KINDS = ("assign", "access", "hex")
# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs of the symbols and the least length that the rules give a credential, and what is between a run's partings.
SHORTEST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
PIECE = re.compile(r"[^=/.]+")
CLASSES = {c: i for i, run in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_.=-")) for c in run}
CLASS_SIZES = (10, 26, 26, 6)
CODES = {c: i for i, c in enumerate(CLASSES)}
#: What a number costs in ordinary text, besides its digits.
NUMBER = math.log(0.02)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, where the credential itself starts), by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


@dataclass(slots=True)
class State:
    visits: int = 0
    ends: int = 0
    counts: Counter = field(default_factory=Counter)
    to: dict = field(default_factory=dict)


def prefix_tree(words: list[str]) -> list[State]:
    states = [State()]
    for word in words:
        at = 0
        for c in word:
            s = states[at]
            s.visits += 1
            s.counts[c] += 1
            if c not in s.to:
                s.to[c] = len(states)
                states.append(State())
            at = s.to[c]
        states[at].visits += 1
        states[at].ends += 1
    return states


def compatible(states: list[State], a: int, b: int, alpha: float = ALPHA) -> bool:
    """Whether two trees may be one: no continuation differs beyond the Hoeffding bound."""
    waiting = [(a, b)]
    while waiting:
        p, q = (states[i] for i in waiting.pop())
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(p.visits) + 1 / math.sqrt(q.visits))
        if bound >= 1:
            continue
        if abs(p.ends / p.visits - q.ends / q.visits) > bound:
            return False
        for c in p.counts.keys() | q.counts.keys():
            if abs(p.counts[c] / p.visits - q.counts[c] / q.visits) > bound:
                return False
        waiting += [(p.to[c], q.to[c]) for c in p.to.keys() & q.to.keys()]
    return True


def merge(states: list[State], a: int, b: int) -> None:
    """Folds the tree of ``b`` into that of ``a``."""
    waiting = [(a, b)]
    while waiting:
        p, q = (states[i] for i in waiting.pop())
        p.visits += q.visits
        p.ends += q.ends
        p.counts.update(q.counts)
        for c, t in q.to.items():
            if c in p.to:
                waiting.append((p.to[c], t))
            else:
                p.to[c] = t


def _remaining(states: list[State]) -> list[list[float]]:
    """For each state of an automaton without loops, the shares of credentials by how many symbols still follow."""
    out: list[list[float]] = [[] for _ in states]
    for i in range(len(states) - 1, -1, -1):  # states stand by depth
        s = states[i]
        shares = [s.ends / s.visits]
        for c, t in s.to.items():
            shares += [0.0] * (len(out[t]) + 1 - len(shares))
            for k, share in enumerate(out[t]):
                shares[k + 1] += share * s.counts[c] / s.visits
        out[i] = shares
    return out


def looped(states: list[State], alpha: float = ALPHA) -> list[State]:
    """Merges states of unlike depth, where enough credentials show that they are alike in all that follows and in how much does.

    States stand by depth.  A merge takes along what the two lead to, and is made
    if every pair passes: the shares of symbols and ends, and the distributions of
    what remains, each within its bound.  The two themselves need a bound below
    ``EVIDENCE``; of what they lead to, what is too rare to tell passes.
    """
    left, group = _remaining(states), list(range(len(states)))
    sums = [State(s.visits, s.ends, Counter(s.counts), dict(s.to)) for s in states]

    def top(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    def alike(a: int, b: int, most: float) -> bool:
        p, q = sums[a], sums[b]
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(p.visits) + 1 / math.sqrt(q.visits))
        if bound >= most:  # too few to tell
            return most >= 1
        if abs(p.ends / p.visits - q.ends / q.visits) > bound:
            return False
        if any(abs(p.counts[c] / p.visits - q.counts[c] / q.visits) > bound for c in p.counts.keys() | q.counts.keys()):
            return False
        gap, n = 0.0, max(len(left[a]), len(left[b]))
        for x, y in zip(left[a] + [0.0] * (n - len(left[a])), left[b] + [0.0] * (n - len(left[b]))):
            gap += x - y
            if abs(gap) > bound:
                return False
        return True

    for t in range(1, len(states)):
        if top(t) != t:
            continue
        for k in (i for i in range(1, t) if top(i) == i):
            pairs, seen, waiting = [], set(), [(k, t)]
            while waiting:
                a, b = sorted(map(top, waiting.pop()))
                if a == b or (a, b) in seen:
                    continue
                if not alike(a, b, 1.0 if pairs else EVIDENCE):
                    break
                seen.add((a, b))
                pairs.append((a, b))
                waiting += [(sums[a].to[c], sums[b].to[c]) for c in sums[a].to.keys() & sums[b].to.keys()]
            else:
                waiting = list(pairs)
                while waiting:  # merges may bring further targets of one symbol together
                    a, b = sorted(map(top, waiting.pop()))
                    if a != b:
                        group[b], p, q = a, sums[a], sums[b]
                        p.visits, p.ends = p.visits + q.visits, p.ends + q.ends
                        p.counts.update(q.counts)
                        for c, to in q.to.items():
                            waiting += [(p.to[c], to)] if c in p.to else []
                            p.to.setdefault(c, to)
                break
    order = [i for i in range(len(states)) if top(i) == i]
    names = {s: i for i, s in enumerate(order)}
    return [State(s.visits, s.ends, s.counts, {c: names[top(t)] for c, t in s.to.items()}) for s in (sums[i] for i in order)]


def infer(words: list[str], alpha: float = ALPHA) -> list[State]:
    """A probabilistic automaton of the words' format; state 0 is its start."""
    words = [w[:LEARNED] for w in words]
    states = prefix_tree(words)
    order, level = [0], [0]
    while level:
        kept: list[int] = []
        for parent, c, t in sorted(((p, c, t) for p in level for c, t in states[p].to.items()), key=lambda e: (-states[e[2]].visits, e)):
            like = next((k for k in sorted(kept, key=lambda k: -states[k].visits) if compatible(states, k, t, alpha)), None)
            if like is None:
                kept.append(t)
            else:
                merge(states, like, t)
                states[parent].to[c] = like
        level = kept
        order += kept
    names = {s: i for i, s in enumerate(order)}
    return looped([State(s.visits, s.ends, s.counts, {c: names[t] for c, t in s.to.items()}) for s in (states[r] for r in order)], alpha)


@dataclass
class Grammar:
    """An automaton, its longest and shortest credential, and the least likelihood it accepts."""

    automaton: list[State]
    longest: int = 0
    least: float = 0.0
    shortest: int = 0
    #: symbols beyond the first ``LEARNED``, and how many credentials have such
    tail: Counter = field(default_factory=Counter)
    tails: int = 0

    def symbol(self, at: int, c: str, without: int = 0) -> float:
        """Log-probability of a symbol in a state; what the state never saw goes by kinds of symbols.

        ``without``: how many times to leave this symbol out of the counts.
        """
        s = self.automaton[at]
        kind = CLASSES[c]
        alike = sum(n for d, n in s.counts.items() if CLASSES[d] == kind) - without
        usual = (alike + 0.1) / (sum(s.counts.values()) - without + 0.4) / CLASS_SIZES[kind]
        k = max(1, len(s.counts))
        return math.log((s.counts[c] - without + k * usual) / (s.visits - without + k))

    def end(self, at: int, without: int = 0) -> float:
        s = self.automaton[at]
        return math.log((s.ends - without + 0.01) / (s.visits - without + 1))

    def next(self, at: int, c: str) -> int:
        """Where a symbol leads; one never seen, where most lead."""
        s = self.automaton[at]
        return s.to[c] if c in s.to else max(s.to.values(), key=lambda t: (self.automaton[t].visits, -t), default=at)

    def after(self, less: Counter | None = None) -> tuple[dict[str, float], float]:
        """Log-probabilities of symbols beyond the automaton's and of the end there; ``less``: those of a credential to leave out."""
        counts = {c: max(0, self.tail[c] - (less[c] if less else 0)) for c in CODES}
        n, ends, k = sum(counts.values()), max(0, self.tails - bool(less)), max(1, sum(m > 0 for m in counts.values()))
        alike = [sum(m for c, m in counts.items() if CLASSES[c] == kind) for kind in range(len(CLASS_SIZES))]
        usual = [(alike[kind] + 0.1) / (n + 0.4) / size for kind, size in enumerate(CLASS_SIZES)]
        return {c: math.log((m + k * usual[CLASSES[c]]) / (n + ends + k)) for c, m in counts.items()}, math.log((ends + 0.01) / (n + ends + 1))

    def likelihood(self, word: str, without: int = 0, rest: Counter | None = None) -> float:
        """Mean log-probability of a word's symbols and end; ``rest`` are its symbols beyond ``LEARNED``, if the word hasn't them."""
        at, total, rest, word = 0, 0.0, Counter(word[LEARNED:]) if rest is None else rest, word[:LEARNED]
        for c in word:
            total += self.symbol(at, c, without)
            at = self.next(at, c)
        total += self.end(at, without)
        if rest:
            costs, end = self.after(rest if without else None)
            total += sum(costs[c] * n for c, n in rest.items()) + end
        return total / (len(word) + rest.total() + 1)

    @functools.cached_property
    def beyond(self) -> tuple[np.ndarray, float]:
        """``after`` by byte."""
        costs, end = self.after()
        by_byte = np.zeros(128)
        by_byte[[ord(c) for c in costs]] = list(costs.values())
        return by_byte, end

    @functools.cached_property
    def tables(self) -> tuple[array, array, array]:
        """Log-probabilities and places of the next state's row, by state's row and symbol, and ends by state."""
        size, places = len(CODES), range(len(self.automaton))
        steps = array("d", (self.symbol(at, c) for at in places for c in CODES))
        return steps, array("q", (self.next(at, c) * size for at in places for c in CODES)), array("d", map(self.end, places))

    @functools.cached_property
    def loops(self) -> bool:
        """Whether some state can come again, so that the automaton alone knows no length."""
        return any(t <= i for i, s in enumerate(self.automaton) for t in s.to.values())

    def fits(self, length: int) -> bool:
        """Whether lengths like this were learned, as far as the automaton doesn't tell itself."""
        if length > LEARNED:
            return self.tails > 0 and 0.8 * self.shortest <= length <= 1.2 * self.longest
        return not self.loops or 0.8 * self.shortest <= length <= 1.2 * self.longest

    def total(self, word: str) -> float:
        """As ``likelihood``, the sum, by tables."""
        at, total, (steps, to, ends) = 0, 0.0, self.tables
        for c in word[:LEARNED]:
            at += CODES[c]
            total += steps[at]
            at = to[at]
        total += ends[at // len(CODES)]
        if len(word) > LEARNED:
            costs, end = self.beyond
            total += float(np.bincount(np.frombuffer(word[LEARNED:].encode(), np.uint8), minlength=128) @ costs) + end
        return total

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tables", "loops", "beyond")}


@dataclass
class Model:
    grammars: dict[str, Grammar]
    #: log-probabilities of letter pairs in ordinary text, 128 by 128, every other byte being 127
    pairs: list[float]
    #: runs that a task knows to hold no credential
    dull: set[str] = field(default_factory=set, repr=False, compare=False)

    @functools.cached_property
    def longest(self) -> int:
        return max((g.longest for g in self.grammars.values()), default=0)

    def usual(self, word: str) -> float:
        """How likely ordinary text writes the word: by letter pairs, or as a number."""
        total, before = 0.0, 32
        if len(word) <= LEARNED:
            for b in word.encode():
                total += self.pairs[before << 7 | b]
                before = b
            total += self.pairs[before << 7 | 32]
        else:
            letters = np.frombuffer(f" {word} ".encode(), np.uint8)
            for at in range(0, len(letters) - 1, 1 << 16):
                part = letters[at : at + (1 << 16) + 1].astype(np.int64)
                total += float(self.pair_array[part[:-1] << 7 | part[1:]].sum())
        return max(total, NUMBER - len(word) * math.log(10)) if word.isdigit() else total

    @functools.cached_property
    def pair_array(self) -> np.ndarray:
        return np.asarray(self.pairs)

    def gain(self, word: str) -> tuple[float, float]:
        """(nats over ordinary text, likelihood above the least that its grammar accepts), of the best grammar."""
        usual = self.usual(word)
        found = [(total - usual, total / (len(word) + 1) - g.least) for g in self.grammars.values() if g.fits(len(word)) for total in (g.total(word),)]
        return max(found, key=lambda f: (f[1] >= 0, f[0]), default=(0.0, -1.0))

    @staticmethod
    def odds(gain: float, above: float, length: int) -> float:
        return min(gain - GAIN_IN_ALL, 20 * (gain / length - GAIN), 20 * above)

    def score(self, word: str) -> float:
        """How likely the word is a credential, 0 to 1; 0.5 and more are added."""
        if not self.grammars or not word:
            return 0.0
        return _logistic(self.odds(*self.gain(word), len(word)))

    def holds(self, text: str) -> bool:
        """Whether any run of the text holds a credential; runs that don't are remembered."""
        new = set(CANDIDATE.findall(text)).difference(self.dull)
        dull = [run for run in new if not _best(run, 0, len(run), self)]
        if len(self.dull) > REMEMBERED:
            self.dull.clear()
        self.dull.update(run for run in dull if len(run) <= 64)
        return len(dull) < len(new)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pair_array"} | {"dull": set()}


def _logistic(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def _smallest(words: dict[str, tuple[str, int, str]], most: int) -> dict[str, tuple[str, int, str]]:
    """The ``most`` words of smallest hash, as hash to word."""
    return {o: words[o] for o in heapq.nsmallest(most, words)} if len(words) > most else words


def train(docs: DataFrame, per_kind: int = SAMPLE_CREDENTIALS) -> Model:
    """Infers one automaton for each kind from credentials that the base rules label in any document.

    One pass reads all texts; a task gives its counts of letter pairs in texts
    without base spans, and its ``per_kind`` distinct credentials of smallest
    hash, of which the smallest of all tasks are learned from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, tuple[str, int, str]]] = {kind: {} for kind in KINDS}
        pairs = np.zeros(1 << 14, np.int64)
        for batch in batches:
            plain = []
            for text in batch.column(1).fill_null("").to_pylist():
                spans = base_spans(text)
                if not spans:
                    plain.append(text)
                for _, end, kind, at in spans:
                    word = text[at:end]
                    rest = " ".join(f"{c}{n}" for c, n in sorted(Counter(word[LEARNED:]).items()))
                    known[kind][hashlib.md5(word.encode()).hexdigest()] = word[:LEARNED], len(word), rest
            letters = np.minimum(np.frombuffer(" ".join(["", *plain, ""]).encode(), np.uint8), 127).astype(np.int64)
            letters[(letters < 32)] = 32
            pairs += np.bincount(letters[:-1] << 7 | letters[1:], minlength=1 << 14)
            known = {kind: _smallest(words, per_kind) for kind, words in known.items()}
        rows = [(kind, o, *word) for kind, words in known.items() for o, word in words.items()]
        rows += [("pair", str(i), "", int(pairs[i]), "") for i in np.flatnonzero(pairs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(5)], names=["kind", "o", "word", "n", "rest"])

    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(pick(docs, doc_id="long", text="string").mapInArrow(run, "kind string, o string, word string, n long, rest string"))
    wanted = found.where("kind = 'pair'").groupBy("kind", "o").agg(F.lit("").alias("word"), F.sum("n").alias("n"), F.lit("").alias("rest"))
    for kind in KINDS:
        wanted = wanted.unionByName(found.where(F.col("kind") == kind).distinct().orderBy("o").limit(per_kind))
    credentials: dict[str, list[tuple[str, int, str]]] = {}
    counts = np.ones((128, 128))
    for r in sorted(wanted.collect()):
        if r["kind"] == "pair":
            counts[divmod(int(r["o"]), 128)] += r["n"]
        else:
            credentials.setdefault(r["kind"], []).append((r["word"], r["n"], r["rest"]))
    scratch.drop(found)
    grammars = {}
    for kind, labelled in sorted(credentials.items()):
        known, lengths, rests = zip(*labelled)
        rests = [Counter({part[0]: int(part[1:]) for part in rest.split()}) for rest in rests]
        g = Grammar(infer(known), max(lengths), shortest=min(lengths), tail=sum(rests, Counter()), tails=sum(map(bool, rests)))
        # each credential's likelihood by what the others say
        likely = [g.likelihood(word, 1, rest) for word, rest in zip(known, rests)]
        g.least = float(np.mean(likely) - 3 * np.std(likely)) - BELOW
        grammars[kind] = g
    return Model(grammars, np.log(counts / counts.sum(axis=1, keepdims=True)).ravel().tolist())


#: Runs that a task remembers.
REMEMBERED = 200_000
SPANS = "array<struct<kind: string, start: long, end: long, score: double>>"
_STRUCT = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
MASK = "[SECRET]"


def _best(text: str, a: int, b: int, model: Model) -> list[tuple[float, int, int]]:
    """(score, start, end) of the run at ``a`` to ``b`` if it is a credential, else of those of its pieces, joined or not, that are.

    Joined pieces, as of a credential with a slash in it, go before single ones
    that score less; those chosen don't overlap.
    """
    end = a + len(text[a:b].rstrip(".=-"))
    score = model.score(text[a:end])
    if score >= 0.5:
        return [(score, a, end)]
    pieces = [m.span() for m in PIECE.finditer(text, a, b)]
    if len(pieces) == 1 and pieces[0] == (a, end):
        return []
    found = (_joins if len(pieces) <= FEW else _many_joins)(text, pieces, model)
    chosen: list[tuple[int, int, float]] = []
    waiting = [(-score, start, -end) for score, start, end in found]
    heapq.heapify(waiting)
    while waiting:
        score, start, end = (abs(x) for x in heapq.heappop(waiting))
        i = bisect.bisect(chosen, (start, end, math.inf))
        if i and chosen[i - 1][1] > start:
            continue
        if i == len(chosen) or end <= chosen[i][0]:
            chosen.insert(i, (start, end, score))
        elif end - start > LEARNED:  # the start's best long join runs into a chosen one: its best of those that don't
            some = pieces[bisect.bisect_left(pieces, (start,)) : bisect.bisect_left(pieces, (chosen[i][0],))]
            for again in _joins(text, some, model, 1):
                if again[2] - start > LEARNED:
                    heapq.heappush(waiting, (-again[0], start, -again[2]))
    return [(score, start, end) for start, end, score in chosen]


#: Pieces of a run up to which its joins are scored start by start, starts that advance together beyond, and long joins scored at a time.
FEW, STARTS, JOINS = 32, 1 << 15, 1 << 17


def _ends(text: str, pieces: list[tuple[int, int]]) -> list[int]:
    """Where joins may end: behind each piece that isn't hyphens only, without its last hyphens."""
    return [start + n for start, end in pieces if (n := len(text[start:end].rstrip("-")))]


def _sums(text: str, lo: int, hi: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a run, and running sums of what its letter pairs cost in ordinary text and of its digits."""
    letters = np.frombuffer(text[lo:hi].encode(), np.uint8)
    chain = np.concatenate([[0.0], np.cumsum(model.pair_array[letters[:-1].astype(np.int64) << 7 | letters[1:]])])
    return letters, chain, np.concatenate([[0], np.cumsum((letters >= 48) & (letters <= 57))])


def _window_most(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The greatest of the values from each ``first`` up to each ``last``; none is minus infinity."""
    most, level = np.full(len(first), -np.inf), 0
    size = last - first
    while (now := size >= 1 << level).any():
        at = np.flatnonzero(now & (size < 2 << level))
        most[at] = np.maximum(values[first[at]], values[last[at] - (1 << level)])
        values = np.maximum(values[: -(1 << level)], values[1 << level :])
        level += 1
    return most


def _beyond(sums: tuple, ends: np.ndarray, starts: np.ndarray, heads: np.ndarray, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, odds) of each start's likeliest join of more than ``LEARNED`` symbols, of those alike the longest, if it is likely.

    ``heads`` are what each grammar's automaton says of the starts' first symbols.
    All ends are scored, but those of starts from which none can gain enough, as
    the greatest sum over their ends tells.  A start has one row, so that memory doesn't grow with the joins.
    """
    letters, chain, digits = sums
    lows, highs = np.searchsorted(ends, starts + LEARNED, "right"), np.searchsorted(ends, starts + int(model.longest * 1.2), "right")
    usual_end = chain[ends - 1] + model.pair_array[letters[ends - 1].astype(np.int64) << 7 | 32]
    usual_start = model.pair_array[32 << 7 | letters[starts].astype(np.int64)] - chain[starts]
    grammars, tails, enough = list(model.grammars.values()), [], np.zeros(len(starts), bool)
    heads = heads.copy()
    for g, head in zip(grammars, heads):
        costs, last = g.beyond
        tails.append(np.concatenate([[0.0], np.cumsum(costs[letters])]))
        head += last - tails[-1][np.minimum(starts + LEARNED, len(letters))]
        if g.tails:
            enough |= head - usual_start + GAIN * starts + _window_most(tails[-1][ends] - usual_end - GAIN * ends, lows, highs) >= -1e-6
    found, waiting = [], np.flatnonzero(enough & (highs > lows))
    while len(waiting):
        many = np.cumsum(highs[waiting] - lows[waiting])
        now = waiting[: max(1, int(np.searchsorted(many, JOINS, "right")))]
        waiting = waiting[len(now) :]
        sizes = highs[now] - lows[now]
        begins = np.cumsum(sizes) - sizes
        who = np.repeat(now, sizes)
        place = np.arange(len(who)) + np.repeat(lows[now] - begins, sizes)
        a, b = starts[who], ends[place]
        n = b - a
        usual = usual_start[who] + usual_end[place]
        usual = np.where(digits[b] - digits[a] == n, np.maximum(usual, NUMBER - n * math.log(10)), usual)
        best, odds = np.full(len(n), -np.inf), np.full(len(n), -np.inf)
        for g, head, tail in zip(grammars, heads, tails):
            whole = head[who] + tail[b]
            gain, above = whole - usual, whole / (n + 1) - g.least
            better = (above >= 0) & (g.tails > 0) & (n >= 0.8 * g.shortest) & (n <= 1.2 * g.longest) & (gain > best)
            best = np.where(better, gain, best)
            odds = np.where(better, np.minimum(np.minimum(gain - GAIN_IN_ALL, 20 * (gain / n - GAIN)), 20 * above), odds)
        # odds beyond 50 are one score
        odds = np.minimum(odds, 50.0)
        most = np.maximum.reduceat(odds, begins)
        last_best = np.maximum.reduceat(np.where(odds == np.repeat(most, sizes), np.arange(len(n)), -1), begins)
        found += [(int(a[j]), int(b[j]), float(odds[j])) for j in last_best[most >= 0]]
    return found


def _joins(text: str, pieces: list[tuple[int, int]], model: Model, n_starts: int | None = None) -> list[tuple[float, int, int]]:
    """(score, start, end) of the likely joins of neighbouring pieces; each start is swept once, whatever ends it has.

    Of a start's joins of more than ``LEARNED`` symbols, its likeliest.  ``n_starts``: how many of the pieces to start from.
    """
    ends, size, reach = _ends(text, pieces), len(CODES), int(model.longest * 1.2)
    best: dict[tuple[int, int], tuple[float, float]] = {}
    far, heads = [], []
    for start, _ in pieces[:n_starts]:
        mine = ends[bisect.bisect_right(ends, start) : bisect.bisect_right(ends, start + reach)]
        if not mine:
            continue
        head = []
        for g in model.grammars.values():
            at, total, i, (steps, to, last) = 0, 0.0, 0, g.tables
            for k, c in enumerate(text[start : min(mine[-1], start + LEARNED)], start + 1):
                at += CODES[c]
                total += steps[at]
                at = to[at]
                if i < len(mine) and k == mine[i]:
                    i += 1
                    whole = total + last[at // size]
                    above = whole / (k - start + 1) - g.least
                    if above >= 0 and k - start >= SHORTEST and g.fits(k - start):
                        gain = whole - model.usual(text[start:k])
                        best[start, k] = max(best.get((start, k), (-math.inf, 0.0)), (gain, model.odds(gain, above, k - start)))
            head.append(total + last[at // size])
        if mine[-1] - start > LEARNED:
            far.append(start)
            heads.append(head)
    found = [(_logistic(odds), a, b) for (a, b), (_, odds) in best.items() if odds >= 0]
    if far and any(g.tails for g in model.grammars.values()):
        lo = pieces[0][0]
        long = _beyond(_sums(text, lo, ends[-1], model), np.array(ends) - lo, np.array(far) - lo, np.array(heads).T, model)
        found += [(_logistic(odds), lo + a, lo + b) for a, b, odds in long]
    return found


def _many_joins(text: str, pieces: list[tuple[int, int]], model: Model) -> list[tuple[float, int, int]]:
    """``_joins`` of a run of many pieces: all starts advance together, a symbol at a time, up to ``LEARNED``; what is beyond goes by running sums."""
    lo, hi = pieces[0][0], pieces[-1][1]
    code_of = np.zeros(128, np.int64)
    code_of[[ord(c) for c in CODES]] = list(CODES.values())
    letters, chain, digits = sums = _sums(text, lo, hi, model)
    codes, pairs = code_of[letters], model.pair_array
    ends = np.array(_ends(text, pieces), dtype=np.int64) - lo
    if not len(ends):
        return []
    is_end = np.zeros(len(letters) + 1, bool)
    is_end[ends] = True
    starts, reach, found = np.array([a for a, _ in pieces]) - lo, int(model.longest * 1.2), []
    for first in range(0, len(starts), STARTS):
        mine = starts[first : first + STARTS]
        places = np.searchsorted(ends, mine + reach, "right") - 1
        longest = np.where(places >= 0, ends[np.maximum(places, 0)], 0)
        rows, far = [], np.flatnonzero(longest > mine + LEARNED)
        heads = np.full((len(model.grammars), len(mine)), -np.inf)
        for g, head in zip(model.grammars.values(), heads):
            steps, to, last = (np.frombuffer(t, t.typecode) for t in g.tables)
            who = np.flatnonzero(longest > mine)
            at, total = np.zeros(len(who), np.int64), np.zeros(len(who))
            for k in range(1, LEARNED + 1):
                going = mine[who] + k <= longest[who]
                if not going.all():
                    who, at, total = who[going], at[going], total[going]
                if not len(who):
                    break
                here = mine[who] + k
                at = at + codes[here - 1]
                total = total + steps[at]
                at = to[at]
                ending = np.flatnonzero(is_end[here])
                if not len(ending) or k < SHORTEST or not g.fits(k):
                    continue
                a, b = mine[who[ending]], here[ending]
                whole = total[ending] + last[at[ending] // len(CODES)]
                above = whole / (k + 1) - g.least
                usual = pairs[32 << 7 | letters[a].astype(np.int64)] + chain[b - 1] - chain[a] + pairs[letters[b - 1].astype(np.int64) << 7 | 32]
                usual = np.where(digits[b] - digits[a] == k, np.maximum(usual, NUMBER - k * math.log(10)), usual)
                gain = whole - usual
                odds = np.minimum(np.minimum(gain - GAIN_IN_ALL, 20 * (gain / k - GAIN)), 20 * above)
                for j in np.flatnonzero(above >= 0):
                    rows.append((int(a[j]), int(b[j]), float(gain[j]), float(odds[j])))
            if len(who):
                head[who] = total + last[at // len(CODES)]
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for a, b, gain, odds in rows:
            best[a, b] = max(best.get((a, b), (-math.inf, 0.0)), (gain, odds))
        found += [(_logistic(odds), lo + a, lo + b) for (a, b), (_, odds) in best.items() if odds >= 0]
        if len(far) and any(g.tails for g in model.grammars.values()):
            found += [(_logistic(odds), lo + a, lo + b) for a, b, odds in _beyond(sums, ends, mine[far], heads[:, far], model)]
    return found


def find_spans(text: str, model: Model) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, by start and kind."""
    base = base_spans(text)
    spans = [(kind, a, b, model.score(text[at:b])) for a, b, kind, at in base]
    k, taken = 0, []  # what base spans take of the text, as ascending parts
    for a, b, *_ in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for m in CANDIDATE.finditer(text) if model.grammars and (base or model.holds(text)) else ():
        at, stop = m.span()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        free, j = [], k
        while j < len(taken) and taken[j][0] < stop:
            free.append((at, taken[j][0]))
            at = taken[j][1]
            j += 1
        for a, b in [*free, (at, stop)]:
            if b - a >= SHORTEST:
                spans += [("grammar", x, y, score) for score, x, y in _best(text, a, b, model)]
    order = {k: i for i, k in enumerate((*KINDS, "grammar"))}
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every secret replaced by a mark; overlapping spans are one."""
    out, at = [], 0
    for _, a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, model: Model, with_text: bool = False) -> DataFrame:
    """(doc_id, spans) of each row; with ``with_text`` also its redacted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                found = [find_spans(t or "", model) for t in texts]
                spans = pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in x] for x in found], pa.list_(_STRUCT))
                out = {"doc_id": part.column(0), "spans": spans}
                if with_text:
                    out["redacted"] = pa.array([redact(t, s) if s else t for t, s in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = f"doc_id long, spans {SPANS}" + (", redacted string" if with_text else "")
    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns, secrets in ``text`` masked and ``n_chars``, if there, counted anew."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            texts = columns[at].to_pylist()
            counts = columns[n_chars].to_pylist() if n_chars is not None else None
            for i, text in enumerate(texts):
                if text and (spans := find_spans(text, model)):
                    texts[i] = redact(text, spans)
                    if counts:
                        counts[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if counts is not None:
                columns[n_chars] = pa.array(counts, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs, train(docs))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("grammar"))
