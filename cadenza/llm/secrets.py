"""Secrets: three base patterns, and formats learned from what they find.

Grammar inference: the credentials that the base patterns label are laid into a
prefix tree per kind, over classes of characters. States that the data cannot
tell apart (their frequencies of ending and of each next class agree within a
Hoeffding bound, and so do those of their successors) are merged, which turns
the tree into a probabilistic automaton with loops. Every candidate token of
every text is scored by the likelihood per character its best automaton gives it,
against what characters of tokens in general would. Candidates are the runs of
token characters and, where a run does not pass, its parts between `=`, `/` and
`.`, down to 16 characters or the shortest credential that was labelled.

Texts are scanned twice, on their bytes, to label and to score; only the rows
with a keyword or a long enough run are looked at closer.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.tokens import PIECE, buffers

KINDS = ("assign", "access", "hex")
LEARNED = "learned"

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SIGNS = "+/_.=-"
#: What joins a credential to other things in a run, in the order in which runs are taken apart.
JOINTS = "=/."
_SIGNS = re.compile(r"[+/_.=-]+")
_WORD = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*")
#: Shortest candidate, where none shorter was labelled.
LEAST = 16
#: Credentials per kind that the automata are fitted on, chosen by hash: a bound on what the driver holds.
SAMPLE = 2000
#: Confidence of the test that keeps two states apart.
ALPHA = 0.05
#: A candidate is a secret from the score that this share of the labelled credentials reaches, 0 (chance) at least.
SHARE_REACHED = 0.98


def _class(c: str) -> str:
    """Symbols of the automata: digits, hex letters, other letters by case, and signs as they are."""
    if c.isdigit():
        return "0"
    if c in "abcdef":
        return "a"
    if c.islower():
        return "g"
    if c in "ABCDEF":
        return "A"
    if c.isupper():
        return "G"
    return c


_WIDTH = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}  # characters of a class


class Automaton:
    """A deterministic probabilistic automaton inferred from strings by state merging."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[int] = [0]
        self.ends: list[int] = [0]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        for word in words:
            self._add([_class(c) for c in word])
        self._merge()

    def _add(self, symbols: list[str]) -> None:
        at = 0
        self.seen[0] += 1
        for s in symbols:
            self.count[at][s] += 1
            if s not in self.next[at]:
                self.next[at][s] = len(self.next)
                self.next.append({})
                self.seen.append(0)
                self.ends.append(0)
                self.count.append(defaultdict(int))
            at = self.next[at][s]
            self.seen[at] += 1
        self.ends[at] += 1

    def _apart(self, f: int, n: int, g: int, m: int) -> bool:
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(f / n - g / m) > bound

    def _compatible(self, a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            if self._apart(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if self._apart(self.count[a].get(s, 0), self.seen[a], self.count[b].get(s, 0), self.seen[b]):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    waiting.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add what the tree below b has seen to a and its successors."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for s, n in self.count[b].items():
                self.count[a][s] += n
            for s, to in self.next[b].items():
                if s in self.next[a]:
                    waiting.append((self.next[a][s], to))
                else:
                    self.next[a][s] = to

    def _merge(self) -> None:
        """Settled states in turn take in the states next to them that agree with one of them."""
        settled = [0]
        fringe = [(0, s) for s in sorted(self.next[0])]
        while fringe:
            at, s = fringe.pop(0)
            to = self.next[at][s]
            if to in settled:
                continue
            same = next((r for r in settled if self._compatible(r, to)), None)
            if same is None:
                settled.append(to)
                fringe += [(to, x) for x in sorted(self.next[to])]
            else:
                self.next[at][s] = same
                self._fold(same, to)
                known = set(fringe)
                fringe += [(r, x) for r in settled for x in sorted(self.next[r]) if self.next[r][x] not in settled and (r, x) not in known]

    def score(self, word: str) -> float:
        """Mean log-likelihood ratio per character, against all token characters alike."""
        at, total = 0, 0.0
        for c in word:
            s = _class(c)
            n = self.count[at].get(s, 0)
            if not n:
                return -math.inf
            total += math.log(n / self.seen[at] / _WIDTH.get(s, 1)) + math.log(67)
            at = self.next[at][s]
        if not self.ends[at]:
            return -math.inf
        return (total + math.log(self.ends[at] / self.seen[at])) / len(word)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end and value of the base patterns, leftmost and non-overlapping per kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return found


def _wordlike(run: str) -> bool:
    """Words joined by signs, or figures: nothing tells them from a text's own."""
    return all(_WORD.fullmatch(part) for part in _SIGNS.split(run)) or not any(c.isalpha() for c in run)


def found_in(run: str, at: int, accept, joints: str = JOINTS) -> list[tuple[int, int, float]]:
    """Start, end and score of what `accept` scores above minus infinity: the run, without signs at its ends, or its parts."""
    a = at + len(run) - len(run.lstrip(SIGNS))
    for start, word in ((at, run), (at, run.rstrip(SIGNS)), (a, run.lstrip(SIGNS)), (a, run.strip(SIGNS))):
        if (score := accept(start, word)) > -math.inf:
            return [(start, start + len(word), score)]
    for k, joint in enumerate(joints):
        if joint in run:
            found, start = [], at
            for part in run.split(joint):
                found += found_in(part, start, accept, joints[k + 1 :])
                start += len(part) + 1
            return found
    return []


def _runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of marked bytes begin and end; none goes across a cut."""
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def _suspect(data: np.ndarray, starts: np.ndarray, least: int | None) -> np.ndarray:
    """Rows with a run of `least` token characters, if any are asked for, or a run that a hex span may be."""
    cuts = starts[(starts > 0) & (starts < len(data))]
    digit = data - np.uint8(0x30) < 10
    first, last = _runs(digit | (data - np.uint8(0x61) < 6), cuts)
    at = first[last - first >= 24]
    if least is not None:
        lower = data | np.uint8(0x20)
        token = digit | (lower - np.uint8(0x61) < 26) | np.isin(data, np.frombuffer(SIGNS.encode(), np.uint8))
        begin, end = _runs(token, cuts)
        at = np.concatenate((at, begin[end - begin >= least]))
    out = np.zeros(len(starts) - 1, bool)
    out[np.searchsorted(starts, at, "right") - 1] = True
    return out


def _close(column: pa.Array, least: int | None) -> Iterator[str]:
    """Each row's text, empty for one that no span can be in."""
    data, starts = buffers(column)
    rows = len(starts) - 1
    close = np.zeros(rows, bool)
    at = 0
    while at < rows:  # in pieces, so that the masks stay small
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE, "right")) - 1)
        close[at:to] = _suspect(data[starts[at] : starts[to]], starts[at : to + 1] - starts[at], least)
        at = to
    for row in range(rows):
        raw = data[starts[row] : starts[row + 1]].tobytes()
        low = raw.lower()
        yield raw.decode("utf-8", "replace") if close[row] or b"AKIA" in raw or any(k in low for k in KEYWORDS) else ""


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [(k, v) for text in _close(batch.column(0), None) for k, _, _, v in base_spans(text)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([v for _, v in own], pa.string())], ["kind", "value"])


class Formats:
    """An automaton per kind of credential, and the score from which a candidate counts as one."""

    def __init__(self, labelled: dict[str, list[str]]):
        self.automata = {k: Automaton(v) for k, v in sorted(labelled.items()) if v}
        self.least = {}
        self.shortest = {k: min(LEAST, *map(len, labelled[k])) for k in self.automata}
        for kind, automaton in self.automata.items():
            scores = sorted(automaton.score(w) for w in labelled[kind])
            self.least[kind] = max(0.0, scores[int(len(scores) * (1 - SHARE_REACHED))])

    def score(self, word: str) -> float:
        """The best score of the kinds whose threshold it reaches, minus infinity for none."""
        scores = ((a.score(word), self.least[k]) for k, a in self.automata.items() if len(word) >= self.shortest[k])
        return max((x for x, least in scores if x >= least), default=-math.inf)


def learn_formats(texts: DataFrame) -> Formats:
    """Automata from the distinct base values of all texts, SAMPLE of each kind by hash."""
    values = texts.select("text").mapInArrow(_labelled, "kind string, value string").distinct()
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    chosen = values.withColumn("order", order).where(F.col("order") <= SAMPLE).select("kind", "value").collect()
    labelled: dict[str, list[str]] = defaultdict(list)
    for kind, value in sorted((r["kind"], r["value"]) for r in chosen):
        labelled[kind].append(value)
    return Formats(labelled)


def _digest(formats: Formats):
    least = min(formats.shortest.values(), default=None)
    run = re.compile(rf"[A-Za-z0-9+/_.=-]{{{least},}}") if least is not None else None

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            hashes, listed, scores = [], [], []
            for text in _close(batch.column(1), least):
                own = sorted((a, KINDS.index(k), b) for k, a, b, _ in base_spans(text))
                for k in range(3):
                    counts[k].append(sum(o[1] == k for o in own))
                spans = [f"{KINDS[k]}:{a}:{b}" for a, k, b in own]
                hashes.append(hashlib.sha256(",".join(spans).encode()).hexdigest())

                def accept(start: int, word: str, own=own) -> float:
                    if len(word) < least or any(start < b and a < start + len(word) for a, _, b in own) or _wordlike(word):
                        return -math.inf
                    return formats.score(word)

                loose = [c for m in run.finditer(text) for c in found_in(m[0], m.start(), accept)] if run else []
                more = [(a, len(KINDS), b) for a, b, _ in loose]
                best = max((score for _, _, score in loose), default=0.0)
                names = (*KINDS, LEARNED)
                listed.append(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(own + more)))
                scores.append(best)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(listed, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "learned_score"])

    return digest


def scan_secrets(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, learned_score.

    Spans the method adds are of kind `learned`: candidates outside all base
    spans whose score reaches the threshold. A null or empty text has no span;
    null ids and repeated rows are rows like any other; where no text has a base
    span nothing is learned. An empty table gives an empty result.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    formats = learn_formats(texts)
    return texts.mapInArrow(_digest(formats), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, learned_score double")
