"""Secrets in whole texts: fixed patterns, and probabilistic automata inferred from known credentials.

For each kind, the credentials that the patterns find in a bounded sample of documents are the labelled
strings. Their prefix tree becomes a probabilistic automaton by merging states of a level whose outgoing
frequencies agree (Hoeffding's bound at each state and, recursively, at those that both lead to). Every token of
eight or more characters that a credential may have is scored, in every text, by its log-likelihood a character.
Those join the spans that are as likely as held-out credentials of the format are, but for one odd symbol, and
whose likelihood is exp(`margin`) times that under an automaton of ordinary tokens: about 1,100 times, as credentials
are rare among tokens. A dot that ends a token is left out where the token fits without it.

Null and empty texts have no spans, an empty table gives an empty one; without a labelled string of a kind, that kind
has no automaton. Each row of a repeated id has its own result. Texts are read whole, however long. Where a token fits
several kinds, the likeliest holds, of equal ones the first in KINDS. Only doc_id and text are read, so that further
columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.spans import Span, joined, scan, sha256
from riskframe.llm.tables import drop_written, written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")
END = "$"
#: Rows of the sample that the automata are inferred from, and labelled strings of a kind among them.
SAMPLE_ROWS, SAMPLE_STRINGS = 20_000, 400
#: Ordinary tokens that theirs is inferred from: more, as numbers and addresses are few among the words.
SAMPLE_ORDINARY = 4_000
#: Characters read as themselves, levels kept apart, symbols read before and after PREFIX (the end is one), and what is
#: added to the count of each.
PREFIX, LEVELS, READ, READ_LATER, ADDED = 6, 128, 69, 11, 0.1
CLASSES = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")})
#: Share of held-out credentials that may be less likely than asked for, and the log-likelihood that a token may lack:
#: about that of one symbol (an end, say) that no labelled string has at its place.
HELD_SHARE, SLACK = 0.02, 7.0


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    found.sort()
    return found


def symbols(string: str) -> str:
    """What the automata read: the first characters as themselves, as formats have prefixes; then classes of letters
    and digits (a-f apart), with marks as themselves."""
    return string[:PREFIX] + string[PREFIX:].translate(CLASSES)


class Automaton:
    """A probabilistic automaton: counts and targets of the symbols that leave each state.

    States of different levels (characters read so far) stay apart, so that prefixes and lengths are part of a format;
    from LEVELS characters on, a state leads to itself.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05) -> None:
        self.count: list[Counter] = [Counter()]
        self.to: list[dict[str, int]] = [{}]
        for string in strings:
            state = 0
            for place, c in enumerate(symbols(string)):
                self.count[state][c] += 1
                if place >= LEVELS:
                    self.to[state][c] = state
                elif c not in self.to[state]:
                    self.to[state][c] = len(self.to)
                    self.to.append({})
                    self.count.append(Counter())
                state = self.to[state][c]
            self.count[state][END] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        levels = self.infer()
        self.logs: list[dict[str, float]] = []
        self.unseen: list[float] = []
        for level, states in enumerate(levels):
            for state in states:
                counts = self.count[state]
                total = sum(counts.values()) + ADDED * (READ if level < PREFIX else READ_LATER)
                self.logs.append({c: math.log((n + ADDED) / total) for c, n in counts.items()})
                self.unseen.append(math.log(ADDED / total))
        #: Where an unseen symbol leads: to the state of the next level that most strings reach.
        self.usual = [max(states, key=lambda s: (sum(self.count[s].values()), -s)) for states in levels]

    def alike(self, a: int, b: int) -> bool:
        """Whether the frequencies of the states, and of those that they lead to, are compatible."""
        pairs = deque([(a, b)])
        while pairs:
            a, b = pairs.popleft()
            n, m = sum(self.count[a].values()), sum(self.count[b].values())
            if not n or not m:
                continue
            most = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most >= 1:  # no difference is too large, here or below
                continue
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a][c] / n - self.count[b][c] / m) > most:
                    return False
                if c in self.to[a] and c in self.to[b] and self.to[b][c] != b:
                    pairs.append((self.to[a][c], self.to[b][c]))
        return True

    def merge(self, a: int, b: int) -> None:
        """Folds the tree below b into a."""
        pairs = deque([(a, b)])
        while pairs:
            a, b = pairs.popleft()
            self.count[a].update(self.count[b])
            for c, target in self.to[b].items():
                if target == b:
                    self.to[a][c] = a
                elif c in self.to[a]:
                    pairs.append((self.to[a][c], target))
                else:
                    self.to[a][c] = target

    def infer(self) -> list[list[int]]:
        """Level by level, promotes the states that the last level leads to or merges them with promoted ones, those of
        the most strings first. Returns the states of each level, renumbered in that order."""
        levels = [[0]]
        while True:
            edges = [(-self.count[s][c], s, c) for s in levels[-1] for c in self.to[s] if self.to[s][c] != s]
            if not edges:
                break
            promoted: list[int] = []
            for _, source, c in sorted(edges):
                state = self.to[source][c]
                home = next((p for p in promoted if self.alike(p, state)), None)
                if home is None:
                    promoted.append(state)
                else:
                    self.to[source][c] = home
                    self.merge(home, state)
            levels.append(promoted)
        states = [s for level in levels for s in level]
        place = {old: new for new, old in enumerate(states)}
        self.count = [self.count[s] for s in states]
        self.to = [{c: place[t] for c, t in self.to[s].items()} for s in states]
        return [[place[s] for s in level] for level in levels]

    def score(self, string: str) -> float:
        """Log-likelihood a character, the end among them."""
        state, total, last = 0, 0.0, len(self.usual) - 1
        for place, c in enumerate(symbols(string)):
            total += self.logs[state].get(c, self.unseen[state])
            state = self.to[state].get(c, self.usual[min(place + 1, last)])
        return (total + self.logs[state].get(END, self.unseen[state])) / (len(string) + 1)


def labelled_strings(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_strings: int = SAMPLE_STRINGS) -> dict[str, list[str]]:
    """Credentials by kind ("0", ...) and ordinary tokens ("-"), in order, from some sample_rows documents chosen by a hash."""

    def rows_of():
        def rows(columns: list) -> list[list]:
            known, other = [], []
            for text in columns[0]:
                matches = base_matches(text or "")
                known.append(sorted({f"{k}{s}" for _, k, _, s in matches}))
                other.append(sorted({m[0] for m in CANDIDATE.finditer(text or "") if not any(a < m.end() and m.start() < b for a, _, b, _ in matches)}))
            return [known, other]

        return rows

    every = max(1, docs.count() // sample_rows)
    found = scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), ("text",), "known array<string>, other array<string>", rows_of)
    tokens = found.select(F.explode("known").alias("t"), F.lit(True).alias("known")).union(found.select(F.explode("other"), F.lit(False)))
    tokens = written(tokens.distinct().select("t", F.when(F.col("known"), F.substring("t", 1, 1)).otherwise("-").alias("kind")), "tokens")
    strings: dict[str, list[str]] = {}
    for kind in ("0", "1", "2", "-"):
        for (t,) in tokens.where(F.col("kind") == kind).orderBy(F.xxhash64("t"), "t").limit(SAMPLE_ORDINARY if kind == "-" else sample_strings).select("t").collect():
            strings.setdefault(kind, []).append(t)
    drop_written(tokens)
    return {kind: sorted(x if kind == "-" else x[1:] for x in own) for kind, own in strings.items()}


def automata_of(strings: dict[str, list[str]]) -> tuple[dict[int, Automaton], Automaton | None]:
    """An automaton for each kind that has labelled strings, and one of ordinary tokens."""
    automata = {k: Automaton(strings[str(k)]) for k in range(len(KINDS)) if str(k) in strings}
    return automata, Automaton(strings["-"]) if "-" in strings else None


def infer(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_strings: int = SAMPLE_STRINGS) -> tuple[dict[int, Automaton], Automaton | None]:
    """automata_of() the labelled strings of some sample_rows documents."""
    return automata_of(labelled_strings(docs, sample_rows, sample_strings))


def least_likely(strings: dict[str, list[str]]) -> dict[int, float]:
    """Of each kind the log-likelihood a character that all but HELD_SHARE of its strings reach, those of a quarter of
    them under an automaton of the others."""
    out = {}
    for k in range(len(KINDS)):
        if own := strings.get(str(k)):
            automaton = Automaton([x for i, x in enumerate(own) if i % 4] or own)
            likely = sorted(automaton.score(x) for x in own[::4])
            out[k] = likely[int(HELD_SHARE * len(likely))]
    return out


def find(docs: DataFrame, margin: float = 7.0, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the number of pattern matches of each kind, base_sha256 of them, and spans: all, as kind:start:end."""
    strings = labelled_strings(docs, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((*automata_of(strings), least_likely(strings)))

    def rows_of():
        kinds, plain, least = shared.value
        known: dict[str, tuple[int, int] | None] = {}

        def fits(token: str) -> tuple[int, int] | None:
            """The kind and the length of the credential that a token is."""
            if token not in known:
                if len(known) > 100_000:
                    known.clear()
                found = None
                for own in dict.fromkeys((token.rstrip("."), token)):
                    if len(own) >= 8 and not found:
                        slack, gain = SLACK / (len(own) + 1), margin / (len(own) + 1)
                        best = max(((x, -k) for k, a in kinds.items() if (x := a.score(own)) >= least[k] - slack), default=None)
                        found = (-best[1], len(own)) if best and best[0] >= plain.score(own) + gain else None
                known[token] = found
            return known[token]

        def rows(columns: list) -> list[list]:
            out: list[list] = [columns[0], [], [], [], [], []]
            for text in columns[1]:
                text = text or ""
                base: list[Span] = [m[:3] for m in base_matches(text)]
                spans = base
                if plain and kinds:
                    more = [(m.start(), x[0], m.start() + x[1]) for m in CANDIDATE.finditer(text) if (x := fits(m[0]))]
                    more = [x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
                    spans = sorted(base + more) if more else base
                counts = [0, 0, 0]
                for _, kind, _ in base:
                    counts[kind] += 1
                said = joined(base, KINDS)
                for x, value in zip(out[1:], (*counts, sha256(said), said if spans is base else joined(spans, KINDS)), strict=True):
                    x.append(value)
            return out

        return rows

    return scan(docs.withColumn("doc_id", docs["doc_id"].cast("long")), ("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", rows_of)
