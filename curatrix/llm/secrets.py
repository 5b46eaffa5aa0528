"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Inference (after Carrasco and Oncina's state merging): the labelled credentials of a kind form a prefix tree over
character classes; its states are folded into one another, in breadth-first order, wherever the Hoeffding bound finds their
end and transition frequencies compatible, all the way down.  The result is a deterministic probabilistic
automaton of the format.  Any token of the text that may be a credential, alone or joined to names, paths and full stops,
is scored by every automaton: the mean log-likelihood by character against that of a class model of ordinary words.  It is reported where that exceeds the kind's threshold,
which the labelled credentials themselves set, and it overlaps no pattern match; of tokens that overlap the likeliest stays, a whole run without a full stop behind it first.

Labelled credentials may be given; by default they are drawn, with a fixed seed, from the public formats in FORMATS.
Automata have one size whatever the input; they are sent to the tasks, and no row is shuffled.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive; texts are read whole; repeated rows
and null doc_ids are answered one by one; with no labelled credentials only patterns are reported; extra columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curatrix.llm._run import map_batches, sql_text, table

#: Kinds of pattern spans, in their order.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of the class is matched whole, so this drops the shorter ones

#: Tokens that are scored: their least length. At least one digit and one letter are asked for besides.
SHORTEST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Characters by which a run joins a credential to a name, a path or a sentence; how far a token behind one reaches, in longest labelled credentials.
_JOINTS, REACH = frozenset("=/.+_-"), 4
#: Confidence of the compatibility test, credentials of a kind drawn by default, share of these that the threshold passes.
CONFIDENCE, DRAWN, PASSED = 0.05, 200, 0.99

_UP, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM, _HEXDIGIT, _BASE32 = _UP + _UP.lower() + _DIGIT, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Public formats of credentials: literal text, or (alphabet, least length, most length).
FORMATS = {
    "access_key": ["AKIA", (_BASE32, 16, 16)],
    "git_token": ["ghp_", (_ALNUM, 36, 36)],
    "chat_token": ["xoxb-", (_DIGIT, 11, 12), "-", (_DIGIT, 11, 12), "-", (_ALNUM, 24, 24)],
    "pay_key": ["sk_live_", (_ALNUM, 24, 24)],
    "web_token": ["eyJ", (_ALNUM + "-_", 20, 30), ".", "eyJ", (_ALNUM + "-_", 30, 60), ".", (_ALNUM + "-_", 43, 43)],
    "digest": [(_HEXDIGIT, 32, 64)],
    "base64_key": [(_ALNUM + "+/", 38, 42), "="],
}


def labelled(formats: dict = FORMATS, each: int = DRAWN, seed: int = 5) -> list[tuple[str, str]]:
    """(kind, credential) rows drawn from formats."""
    rng = random.Random(seed)
    return [(kind, "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2]))) for p in parts)) for kind, parts in formats.items() for _ in range(each)]


def symbol(c: str) -> str:
    """The class of a character: lower-case hex letters, other lower-case, upper-case, digits, others as they are."""
    if "0" <= c <= "9":
        return "9"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if "A" <= c <= "Z":
        return "A"
    return c


_SYMBOLS = {c: symbol(c) for c in _ALNUM + "+/_.=-"}
#: Characters of a class, over which a class is shared out evenly.
_SHARE = {"9": 10, "a": 6, "g": 20, "A": 26}


class Automaton:
    """A deterministic probabilistic automaton, inferred by merging compatible states of a prefix tree."""

    def __init__(self, words: Iterable[str], confidence: float = CONFIDENCE):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[Counter] = [Counter()]
        self.ends, self.visits = [0], [0]
        for word in words:
            at = 0
            self.visits[0] += 1
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(Counter())
                    self.ends.append(0)
                    self.visits.append(0)
                self.seen[at][c] += 1
                at = self.next[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / confidence))
        self._merge()

    def _differs(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo, done = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in done:
                continue
            done.add((a, b))
            if self._differs(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differs(self.seen[a][c], self.visits[a], self.seen[b][c], self.visits[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree to a state and its successors."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            self.seen[a].update(self.seen[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self) -> None:
        red, blue = [0], deque((0, c) for c in sorted(self.next[0]))
        while blue:
            parent, c = blue.popleft()
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    blue.extend((q, x) for q in red for x in sorted(self.next[q]) if self.next[q][x] not in red and (q, x) not in blue)
                    break
            else:
                red.append(state)
                blue.extend((state, x) for x in sorted(self.next[state]))
        self.states = len(red)
        self.step: dict[int, dict[str, tuple[float, int]]] = {}
        for r in red:
            n, kinds = self.visits[r], len(self.next[r]) + 1
            self.step[r] = {c: (math.log((self.seen[r][c] + 0.2) / (n + 0.2 * kinds) / _SHARE.get(c, 1)), to) for c, to in self.next[r].items()}
            self.step[r][""] = (math.log((self.ends[r] + 0.2) / (n + 0.2 * kinds)), r)

    def score(self, word: str) -> float:
        """Log-likelihood of a word of classes; minus infinity where the automaton has no way."""
        at, total = 0, 0.0
        for c in word:
            if c not in self.step[at]:
                return -math.inf
            p, at = self.step[at][c]
            total += p
        return total + self.step[at][""][0]


#: Ordinary text by class and character: lower-case letters as in prose, others rare.
_PLAIN = {"a": 0.30 / 6, "g": 0.60 / 20, "A": 0.02 / 26, "9": 0.02 / 10}
_PLAIN_LOG = {c: math.log(_PLAIN.get(s, 0.005)) for c, s in _SYMBOLS.items()}


class Scanner:
    """Patterns and automata of some labelled credentials."""

    def __init__(self, credentials: list[tuple[str, str]]):
        kinds: dict[str, list[str]] = {}
        for kind, value in credentials:
            if value and all(c in _SYMBOLS for c in value):
                kinds.setdefault(kind, []).append(value)
        self.automata, self.longest = [], max((len(v) for values in kinds.values() for v in values), default=0)
        for kind, values in sorted(kinds.items()):
            learn, hold = values[: -max(1, len(values) // 4)] or values, values[-max(1, len(values) // 4) :]
            automaton = Automaton("".join(_SYMBOLS[c] for c in v) for v in learn)
            scores = sorted(self.gain(automaton, v) for v in hold)
            least = scores[int(len(scores) * (1 - PASSED))]
            self.automata.append((kind, automaton, max(0.0, least - 0.1 * abs(least)) if math.isfinite(least) else 0.0))

    @staticmethod
    def gain(automaton: Automaton, value: str) -> float:
        """Mean log-likelihood ratio by character."""
        return (automaton.score("".join(_SYMBOLS[c] for c in value)) - sum(_PLAIN_LOG[c] for c in value)) / len(value)

    def format_of(self, value: str) -> tuple[str, float] | None:
        """The likeliest kind of a token, if any passes its threshold."""
        best = max(((self.gain(a, value), kind) for kind, a, least in self.automata if self.gain(a, value) >= least), default=None)
        return best and (best[1], best[0])

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """Start, kind's number and end of the pattern spans."""
        low = text.casefold()
        out = []
        if "pass" in low or "secret" in low or "token" in low or "key" in low:
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(out)

    def added(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, str, int, float]]:
        """Start, kind, end and score of the tokens that an automaton accepts and no pattern covers."""
        taken, out = deque(sorted((a, b) for a, _, b in base)), []
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            while taken and taken[0][1] <= a and taken[0][0] < a:
                taken.popleft()
            covered, ends = list(base_overlaps(taken, b)), []
            for _, kind, x, y, gain in sorted(self.tokens(m[0]), key=lambda f: (f[3] - f[2] < b - a or m[0][-1] == ".", -f[0], f[2], f[3], f[1])):
                x, y = x + a, y + a
                if not any(p < y and q > x for p, q in covered) and not any(p < y and q > x for p, q in ends):
                    ends.append((x, y))
                    out.append((x, kind, y, gain))
        return sorted(out)

    def tokens(self, run: str) -> Iterator[tuple[float, str, int, int, float]]:
        """Log-likelihood ratio, kind, start, end and score of the tokens of a run that pass: between its ends and its joints."""
        n, classes = len(run), [_SYMBOLS[c] for c in run]
        starts = [0, *(k for k in range(1, n) if run[k - 1] in _JOINTS)]
        ends = {n, *(k for k in range(n) if run[k] in _JOINTS), *(k for k in range(1, n) if run[k - 1] == "=")}
        plain = list(accumulate((_PLAIN_LOG[c] for c in run), initial=0.0))
        digits = list(accumulate((c == "9" for c in classes), initial=0))
        letters = list(accumulate((c in "agA" for c in classes), initial=0))
        for kind, automaton, least in self.automata:
            for x in starts:
                at, total = 0, 0.0
                # what begins behind a joint is followed over a multiple of the labelled lengths, so that time grows with the run only
                for y in range(x, min(n, x + REACH * self.longest) if x else n):
                    if classes[y] not in automaton.step[at]:
                        break
                    p, at = automaton.step[at][classes[y]]
                    total += p
                    if (size := y + 1 - x) >= SHORTEST and y + 1 in ends and digits[y + 1] > digits[x] and letters[y + 1] > letters[x]:
                        gain = (total + automaton.step[at][""][0] - plain[y + 1] + plain[x]) / size
                        if gain >= least:
                            yield gain * size, kind, x, y + 1, gain


def base_overlaps(taken: Iterable[tuple[int, int]], end: int) -> Iterator[tuple[int, int]]:
    """The leading spans that begin before end."""
    for a, b in taken:
        if a >= end:
            return
        yield a, b


def scan(docs: DataFrame, credentials: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, base and added: arrays of the spans found by patterns (start, kind, end) and by automata (with score)."""
    scanner = Scanner(labelled() if credentials is None else credentials)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                own = scanner.base(text)
                base.append([{"start": a, "kind": BASE[k], "end": b, "score": 1.0} for a, k, b in own])
                added.append([{"start": a, "kind": k, "end": b, "score": s} for a, k, b, s in scanner.added(text, own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))], ["doc_id", "base", "added"])

    spans = "array<struct<start: long, kind: string, end: long, score: double>>"
    return map_batches(docs.select("doc_id", sql_text().alias("text")), run, f"doc_id {kind}, base {spans}, added {spans}")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of the scan."""
    count = lambda k: f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}"
    text = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    # by start, then kind as listed, added kinds behind
    order = "array_sort(concat(base, added), (x, y) -> case when x.start <> y.start then cast(sign(x.start - y.start) as int) else cast(sign(r(x) - r(y)) as int) end)"
    for v in "xy":
        order = order.replace(f"r({v})", f"coalesce(nullif(array_position(array('assign', 'access', 'hex'), {v}.kind), 0), 9)")
    return found.selectExpr("doc_id", *(count(k) for k in BASE), f"sha2(cast({text('base')} as binary), 256) as base_sha256", f"{text(order)} as spans")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return digests(scan(table(spark, sf_dir, "documents")))


QUERIES = {"op9_secrets": op9_secrets}
ORACLE_SQL: dict[str, str] = {}
