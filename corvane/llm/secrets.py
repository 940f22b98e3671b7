"""Secret scans: fixed patterns, and formats learnt by grammar inference.

Labelled credentials, and ordinary long tokens, each make a prefix tree; merging states whose outcomes are
statistically compatible (Hoeffding bounds) gives a probabilistic automaton of each label. Labels are the corpus's
own: what the patterns for assignments and access keys find in it (a hex run tells no format beyond its alphabet, which
its pattern finds whole), and made-up credentials of published formats. Ordinary tokens are made up, and taken from
the corpus: tokens that touch no span of the patterns and that automata without them don't score high. Samples of the
corpus are the `per_label` distinct tokens of least hash, from all texts.

Every candidate token is scored by the log-likelihood ratio of the best label's automaton and the ordinary one. The
spans of the fixed patterns stay; a token that scores high and touches none of them is added as `format`. Tokens are
what the fixed patterns leave of a run of token characters: all its pieces from the start of a word to the end of a
word, and all of it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex", "format")
#: The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
SHORTEST = 20
_WORD = re.compile(r"[A-Za-z0-9]+")
_JOINED = re.compile(r"[A-Za-z0-9_-]*")
_SLICE = 1 << 20

#: The log-probability of what a state has not seen; what stands for letters and digits, and how many each is.
UNSEEN = math.log(1e-4)
_KINDS = str.maketrans(string.digits + string.ascii_uppercase + string.ascii_lowercase, "9" * 10 + "A" * 26 + "a" * 26)
_MANY = {"9": math.log(10), "A": math.log(26), "a": math.log(26)}

Automaton = list[tuple[float, dict[str, tuple[int, float]]]]  # per state: the log-probabilities to end, and of each symbol


def symbols(token: str) -> list[str]:
    """The first four characters as they are, as formats are told by their fronts; then classes of characters."""
    return [*(f"={c}" for c in token[:4]), *token[4:].translate(_KINDS)]


def classes(token: str) -> list[str]:
    """Classes of characters only: any front is ordinary."""
    return list(token.translate(_KINDS))


class Inference:
    """A prefix tree of samples, and its merging."""

    def __init__(self, samples: list[list[str]], alpha: float):
        self.alpha = alpha
        self.next: list[dict[str, int]] = [{}]
        self.count, self.ends = [0], [0]
        for sample in samples:
            at = 0
            self.count[0] += 1
            for x in sample:
                if x not in self.next[at]:
                    self.next[at][x] = len(self.next)
                    self.next.append({})
                    self.count.append(0)
                    self.ends.append(0)
                at = self.next[at][x]
                self.count[at] += 1
            self.ends[at] += 1

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(math.log(2 / self.alpha) / 2) * (n1**-0.5 + n2**-0.5)

    def compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            if self.differ(self.ends[a], self.count[a], self.ends[b], self.count[b]):
                return False
            for x in self.next[a].keys() | self.next[b].keys():
                i, j = self.next[a].get(x), self.next[b].get(x)
                if self.differ(self.count[i] if i else 0, self.count[a], self.count[j] if j else 0, self.count[b]):
                    return False
                if i and j and i != j:
                    pairs.append((i, j))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree at b to a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            for x, j in self.next[b].items():
                if x in self.next[a]:
                    if self.next[a][x] != j:
                        pairs.append((self.next[a][x], j))
                else:
                    self.next[a][x] = j

    def automaton(self) -> list[dict[str, int]]:
        """The moves of each state, after merging: frontier states, those seen most first, merge with the kept state
        compatible with them that is seen most, or are kept."""
        kept, settled = [0], {0}
        frontier = [(0, x) for x in sorted(self.next[0])]
        while frontier:
            frontier.sort(key=lambda e: -self.count[self.next[e[0]][e[1]]])
            parent, x = frontier.pop(0)
            state = self.next[parent][x]
            if state in settled:
                continue
            same = [k for k in kept[1:] if self.compatible(k, state)]
            if same:
                into = max(same, key=lambda k: self.count[k])
                self.next[parent][x] = into
                self.fold(into, state)
                frontier += [(into, y) for y in sorted(self.next[into]) if self.next[into][y] not in settled and (into, y) not in frontier]
            else:
                kept.append(state)
                settled.add(state)
                frontier += [(state, y) for y in sorted(self.next[state])]
        number = {k: i for i, k in enumerate(kept)}
        return [{x: number[j] for x, j in self.next[k].items() if j in number} for k in kept]


def learnt(samples: list[str], alpha: float = 0.05, code: Callable[[str], list[str]] = symbols) -> Automaton:
    """A probabilistic automaton of the samples. A class that a state lacks, but others have, costs UNSEEN and leads
    where it mostly leads; states of fronts lack classes, and where all is classes no state does."""
    coded = [code(s) for s in samples]
    merged = Inference(coded, alpha).automaton()
    # Merging moves counts about; the transition probabilities are set from the samples' own paths.
    ends, goes = [0.0] * len(merged), [dict.fromkeys(moves, 0.0) for moves in merged]
    leads: dict[str, Counter[int]] = {}
    for sample in coded:
        at = 0
        for x in sample:
            if x not in merged[at]:
                break
            goes[at][x] += 1
            at = merged[at][x]
            if len(x) == 1:
                leads.setdefault(x, Counter())[at] += 1
        else:
            ends[at] += 1
    out: Automaton = []
    for state, moves in enumerate(merged):
        total = ends[state] + sum(goes[state].values()) + 1
        seen = {x: (to, math.log((goes[state][x] + 1e-3) / total)) for x, to in moves.items()}
        lacked = {x: (to.most_common(1)[0][0], UNSEEN) for x, to in leads.items()} if code is classes or any(len(x) == 1 for x in moves) else {}
        out.append((math.log((ends[state] + 1e-3) / total), lacked | seen))
    return out


def likelihood(automaton: Automaton, coded: list[str], unseen: float = UNSEEN) -> float:
    """The log-probability of a symbol string; a symbol that a state lacks costs `unseen` and leaves the state."""
    at, total = 0, 0.0
    for x in coded:
        move = automaton[at][1].get(x)
        if move is None:
            total += unseen
        else:
            at, total = move[0], total + move[1]
    return total + automaton[at][0]


def labelled_credentials(each: int = 60, seed: int = 3) -> list[str]:
    """Made-up credentials of public formats, so many of each."""
    rng = random.Random(seed)
    upper, alnum, hexa = string.ascii_uppercase + "234567", string.ascii_letters + string.digits, "0123456789abcdef"
    url = alnum + "-_"
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    #: Fronts and lengths of published credential formats.
    made = {
        "access key": lambda: rng.choice(("AKIA", "ASIA")) + some(upper, 16),
        "code host": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + some(alnum, 36),
        "code host, fine-grained": lambda: "github_pat_" + some(alnum, 22) + "_" + some(alnum, 59),
        "chat": lambda: rng.choice(("xoxb", "xoxp")) + f"-{some(string.digits, 12)}-{some(string.digits, 12)}-{some(alnum, 24)}",
        "payment": lambda: rng.choice(("sk_live_", "rk_live_")) + some(alnum, 24),
        "maps": lambda: "AIza" + some(url, 35),
        "package host": lambda: "npm_" + some(alnum, 36),
        "web token": lambda: f"eyJhbGciOi{some(url, 26)}.eyJ{some(url, 40)}.{some(url, 43)}",
        "mail": lambda: f"SG.{some(url, 22)}.{some(url, 43)}",
        "code host, other": lambda: "glpat-" + some(url, 20),
    }
    return [f() for f in made.values() for _ in range(each)]


def ordinary_tokens(n: int = 900, seed: int = 4) -> list[str]:
    """Long tokens that are no credentials: joined words, paths, names, numbers, hosts, rules."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    made = [
        lambda: "-".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))),
        lambda: ".".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "_".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "".join(word() for _ in range(rng.randint(3, 6))).capitalize(),
        lambda: "".join(word() for _ in range(rng.randint(3, 6))).upper(),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 6))),
        lambda: "".join(rng.choice(string.digits) for _ in range(rng.randint(20, 30))),
        lambda: rng.choice("-=_.") * rng.randint(20, 60),
        lambda: f"www.{word()}.example.{rng.choice(('com', 'org', 'net'))}/{word()}/{rng.randint(1, 9999)}",
        lambda: f"{word()}.{word()}{rng.randint(1, 99)}/{word()}-{rng.randint(1900, 2030)}",
    ]
    tokens = [rng.choice(made)() for _ in range(n)]
    return [t for t in tokens if len(t) >= 20]


class Ratio:
    """The automata of the labels and the ordinary one run side by side: a node is a label, its state and the ordinary
    state, a move changes the log-likelihood ratio. A node's moves are made when they are first gone."""

    def __init__(self, labels: list[Automaton], ordinary: Automaton):
        self.labels, self.ordinary = labels, ordinary
        self.roots = range(len(labels))
        self.pairs = [(k, 0, 0) for k in self.roots]
        self.number = {pair: i for i, pair in enumerate(self.pairs)}
        self.moves: list[dict[str, tuple[int, float]]] = [{} for _ in labels]
        self.ending = [label[0][0] - ordinary[0][0] for label in labels]

    def move(self, node: int, x: str) -> tuple[int, float]:
        """The next node, and what it adds. In ordinary tokens all characters of a class are as likely."""
        found = self.moves[node].get(x)
        if found is None:
            k, c, o = self.pairs[node]
            kind = x[-1].translate(_KINDS)
            c, up = self.labels[k][c][1].get(x, (c, UNSEEN))
            o, down = self.ordinary[o][1].get(kind, (o, UNSEEN))
            pair = k, c, o
            if pair not in self.number:
                self.number[pair] = len(self.pairs)
                self.pairs.append(pair)
                self.moves.append({})
                self.ending.append(self.labels[k][c][0] - self.ordinary[o][0])
            found = self.moves[node][x] = self.number[pair], up - down + (_MANY.get(kind, 0.0) if len(x) == 2 else 0.0)
        return found

    def along(self, root: int, coded: list[str]) -> tuple[int, float]:
        node, total = root, 0.0
        for x in coded:
            node, more = self.move(node, x)
            total += more
        return node, total

    def of(self, token: str) -> float:
        """The ratio of the label that the token is likeliest in."""
        coded = symbols(token)
        ends = [self.along(root, coded) for root in self.roots]
        return max(total + self.ending[node] for node, total in ends)

    def known(self, front: str) -> bool:
        """Whether the first characters are likelier in a credential than at random."""
        return any(self._front(label, front) > -len(front) * math.log(64) for label in self.labels)

    @staticmethod
    def _front(label: Automaton, front: str) -> float:
        at, total = 0, 0.0
        for c in front:
            at, more = label[at][1].get(f"={c}", (at, UNSEEN))
            total += more
        return total

    def pieces(self, text: str, start: int, end: int, margin: float) -> list[tuple[int, int]]:
        """The pieces of text[start:end], apart from each other, whose ratios exceed the margin by the most in sum. A
        piece has a known front, and reaches from the start of a word to the end of a word. Pieces that meet in a node
        go on alike, so only the best of them does, and the time is in proportion to the length."""
        words = [m.span() for m in _WORD.finditer(text, start, end)]
        enter = {s + SHORTEST: s for s, _ in words if s + SHORTEST <= end and self.known(text[s : s + 4])}
        if not enter:
            return []
        first, ends, starts = min(enter) - SHORTEST, {e for _, e in words}, set(enter.values())
        kinds = text[first:end].translate(_KINDS)
        best: tuple[float, tuple | None] = 0.0, None  # the sum so far; the last piece (start, end, those before)
        before: dict[int, tuple[float, tuple | None]] = {}
        active: dict[int, tuple[float, int]] = {}
        for at in range(first, end + 1):
            if active:
                x, gone = kinds[at - 1 - first], {}
                for node, (total, since) in active.items():
                    node, more = self.moves[node].get(x) or self.move(node, x)
                    if node not in gone or total + more > gone[node][0]:
                        gone[node] = total + more, since
                active = gone
            if at in enter:
                since, coded = enter[at], symbols(text[enter[at] : at])
                for root in self.roots:
                    node, total = self.along(root, coded)
                    total += before[since][0] - margin
                    if node not in active or total > active[node][0]:
                        active[node] = total, since
            if at in ends:
                for node, (total, since) in active.items():
                    if total + self.ending[node] > best[0]:
                        best = total + self.ending[node], (since, at, before[since][1])
            if at in starts:
                before[at] = best
        out, last = [], best[1]
        while last:
            out.append((last[0], last[1]))
            last = last[2]
        return out[::-1]


class Scanner:
    """Finds spans (kind, start, end) in texts; positions in code points, ends exclusive. labelled: credentials by
    label, beside those of published formats; ordinary: tokens that may be ordinary, beside those made up."""

    def __init__(self, margin: float = 6.0, labelled: dict[str, list[str]] | None = None, ordinary: list[str] | None = None):
        self.margin = margin
        labels = [learnt(labelled_credentials(120)), *(learnt(tokens) for _, tokens in sorted((labelled or {}).items()) if tokens)]
        made = ordinary_tokens(2000)
        self.ratio = Ratio(labels, learnt(made, code=classes))
        if ordinary:
            # What scores high already is a credential that no pattern has labelled.
            self.ratio = Ratio(labels, learnt(made + [t for t in ordinary if not self.is_credential(t)], code=classes))

    def is_credential(self, token: str) -> bool:
        """Whether the log-likelihood ratio of the token's likeliest label is above the margin."""
        return self.ratio.of(token) > self.margin

    @staticmethod
    def base(text: str, assign: bool = True, access: bool = True, hexa: bool = True) -> list[tuple[str, int, int]]:
        out = []
        if assign:
            out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        if access:
            out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        if hexa:
            out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
        return sorted(out, key=_order)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        out, later, upto = [], 0, 0
        taken = sorted((s, e) for _, s, e in base)
        for m in CANDIDATE.finditer(text):
            upto = max(upto, m.start())
            while later < len(taken) and taken[later][0] < m.end():
                s, e = taken[later]
                if s > upto:
                    out += self.tokens(text, upto, s)
                upto, later = max(upto, e), later + 1
            if upto < m.end():
                out += self.tokens(text, upto, m.end())
        return out

    def tokens(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """The credentials in a run of token characters: all of it, if it scores high and no piece tells a later start;
        or else pieces of it."""
        token = text[start:end]
        token = token.rstrip(".-=_/+") if not token.endswith("==") else token
        start, end = start + len(token) - len(token.lstrip(".-=_/+")), start + len(token)
        if end - start < SHORTEST:
            return []
        pieces = self.ratio.pieces(text, start, end, self.margin)
        if (not pieces or pieces[0][0] == start) and self.is_credential(text[start:end]):
            pieces = [(start, end)]
        out = []
        for (s, e), limit in zip(pieces, [*(s for s, _ in pieces[1:]), end], strict=False):
            # Formats have - and _ inside: what they join to the piece is its own, if it still scores high.
            joined = e + len(_JOINED.match(text, e, limit)[0].rstrip("-_"))
            out.append(("format", s, joined if self.is_credential(text[s:joined]) else e))
        return out


def _order(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


_HEX = _class("0123456789abcdef")
_TOKEN = _class(string.ascii_letters + string.digits + "+/_=.-")


def _with_runs(data: np.ndarray, ends: np.ndarray, table: np.ndarray, least: int) -> set[int]:
    """The texts (by number) in which such a run may be; a run may reach over from the text before."""
    mask = table[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= least
    first, last = np.searchsorted(ends, starts[long], side="right"), np.searchsorted(ends, stops[long] - 1, side="right")
    return {t for a, b in zip(first.tolist(), last.tolist(), strict=True) for t in range(a, b + 1)}


def _with_base(texts: list[bytes]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Those texts that may have a candidate or a base span, with their base spans."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    hexa, long = _with_runs(data, ends, _HEX, LEAST["hex"]), _with_runs(data, ends, _TOKEN, SHORTEST)
    for i, raw in enumerate(texts):
        low = raw.lower()
        assign, access = any(h in low for h in _HINTS), b"AKIA" in raw
        if assign or access or i in long:
            text = raw.decode("utf-8", "replace")
            yield text, Scanner.base(text, assign, access, i in hexa)


def spans_of(texts: list[bytes], scanner: Scanner) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base and added spans of each text. What can't be in a text isn't looked for there."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    hexa, long = _with_runs(data, ends, _HEX, LEAST["hex"]), _with_runs(data, ends, _TOKEN, SHORTEST)
    for i, raw in enumerate(texts):
        low = raw.lower()
        assign, access = any(h in low for h in _HINTS), b"AKIA" in raw
        if not (assign or access or i in hexa or i in long):
            yield [], []
            continue
        text = raw.decode("utf-8", "replace")
        base = scanner.base(text, assign, access, i in hexa)
        yield base, scanner.added(text, base) if i in long else []


def _tokens_of(text: str, scanner_base: list[tuple[str, int, int]]) -> Iterator[tuple[str, str]]:
    """(label, token) for what a text has to learn from."""
    taken = sorted((s, e) for _, s, e in scanner_base)
    for kind, s, e in scanner_base:
        if kind == "assign":
            yield kind, ASSIGN.match(text, s, e)[2]
        elif kind == "access":
            yield kind, text[s:e]
    later = 0
    for m in CANDIDATE.finditer(text):
        while later < len(taken) and taken[later][1] <= m.start():
            later += 1
        if later == len(taken) or taken[later][0] >= m.end():
            yield "ordinary", m[0].strip(".-=_/+")


def samples(docs: DataFrame, per_label: int = 500, longest: int = 256) -> dict[str, list[str]]:
    """For each label, and `ordinary`, the per_label distinct tokens of SHORTEST to `longest` characters with the least
    hash. Each task hands on its own per_label least, so nothing grows with the corpus but the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, bytes]] = {}
        for batch in batches:
            for _, texts in _slices(batch, 0):
                for text, base in _with_base(texts):
                    for label, token in _tokens_of(text, base):
                        if SHORTEST <= len(token) <= longest:
                            of = least.setdefault(label, {})
                            of[token] = hashlib.blake2b(token.encode(), digest_size=16).digest()
                            if len(of) > 4 * per_label:
                                least[label] = dict(sorted(of.items(), key=lambda e: e[1])[:per_label])
        rows = [(label, at, token) for label, of in sorted(least.items()) for token, at in sorted(of.items(), key=lambda e: e[1])[:per_label]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], names=["label", "at", "token"])

    found = materialize(docs.select("text").mapInArrow(run, "label string, at binary, token string").distinct(), "tokens")
    return {label: [r["token"] for r in found.where(F.col("label") == label).orderBy("at").limit(per_label).collect()] for label in ("access", "assign", "ordinary")}


def fitted(docs: DataFrame, per_label: int = 500) -> Scanner:
    """The scanner that has learnt from docs."""
    got = samples(docs, per_label)
    ordinary = got.pop("ordinary")
    return Scanner(labelled=got, ordinary=ordinary)


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of some rows at a time, with the first row's number."""
    at, size, texts = 0, 0, []
    for text in batch.column(column):
        texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        size += len(texts[-1])
        if size >= _SLICE:
            yield at, texts
            at, size, texts = at + len(texts), 0, []
    if texts:
        yield at, texts


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs, which the automata learn from.

    A null text is empty and has no spans. Rows with a null or repeated doc_id come out once each. Other columns play
    no part. Empty input: no rows.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    scanner = fitted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch, 1):
                columns: list[list] = [batch.column(0).slice(at, len(texts)).to_pylist(), [], [], [], [], []]
                for base, added in spans_of(texts, scanner):
                    for c, kind in enumerate(KINDS[:3], start=1):
                        columns[c].append(sum(k == kind for k, _, _ in base))
                    columns[4].append(hashlib.sha256(_written(base).encode()).hexdigest())
                    columns[5].append(_written(sorted(base + added, key=_order)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by [kind]; overlapping spans by that of the first. Other columns,
    rows and null texts stay as they are; so do repeated rows. The automata learn from these texts. Empty input: no rows."""
    at = docs.columns.index(text_col)
    scanner = fitted(docs.select(F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raws in _slices(batch, at):
                part = batch.slice(start, len(raws))
                texts = part.column(at)
                found = list(spans_of(raws, scanner))
                if any(base or added for base, added in found):
                    out = []
                    for text, (base, added) in zip(texts.to_pylist(), found, strict=True):
                        pieces, upto = [], 0
                        for kind, s, e in sorted(base + added, key=_order):
                            if s >= upto:
                                pieces += [text[upto:s], f"[{kind}]"]
                            upto = max(upto, e)
                        out.append("".join([*pieces, text[upto:]]) if pieces else text)
                    texts = pa.array(out, texts.type)
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return docs.mapInArrow(run, docs.schema).select(*[F.col(c) for c in docs.columns])
