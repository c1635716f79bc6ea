"""Secret scans: patterns give candidates, a random forest removes the false ones.

Candidates are values assigned to secret-sounding names, values of providers' own shapes, and long strings of
mixed characters, each of any length. The forest sees a candidate's length, how likely its character transitions are in words, how much of it
dictionary words cover, its path and the words beside it (what labelled findings have beside them is learnt, too), and is
trained here from labelled findings.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.llm.common import slices

#: Labelled findings that a forest is fitted on at most, the least by hash.
SAMPLE_ROWS = 20_000
STEP_BYTES = 4 << 20
#: Code points beside a candidate that count as its neighbourhood.
NEAR = 48

ASSIGNED = re.compile(r"(?:passw(?:or)?d|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|client[_-]?key)(?P<rest>[\w.-]{0,40})[\"']?\s{0,4}(?:=>|:=|==?|:)\s{0,4}(?P<q>[\"'`]?)(?P<value>[^\s\"'`<>|,;(){}\[\]]{6,})", re.I)
SHAPED = re.compile(r"(?<![A-Za-z0-9])(?:(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})|(?P<github>gh[opsur]_[A-Za-z0-9]{36,})|(?P<slack>xox[abprs]-[A-Za-z0-9-]{10,})|(?P<google>AIza[A-Za-z0-9_-]{35})|(?P<stripe>[rs]k_(?:live|test)_[A-Za-z0-9]{16,})|(?P<jwt>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))(?![A-Za-z0-9])")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = ("assigned", "aws", "github", "slack", "google", "stripe", "jwt", "long")
FOR = re.compile(r"\b(?:passw(?:or)?d|pwd|secret|token|credentials?|api|auth\w*|bearer|private|access|login|key)\b", re.I)
AGAINST = re.compile(r"\b(?:example|sample|placeholder|dummy|fake|changeme|test|todo|sha\d*|md5|hash|checksum|digest|commit|revision|integrity|etag|uuid|guid|build|version|fingerprint|your|xxx+)\b", re.I)
TEST_PATH = re.compile(r"(?:^|[/_.-])(?:tests?|spec|fixtures?|examples?|samples?|docs?|mocks?)(?:[/_.-]|$)", re.I)
LOCK_PATH = re.compile(r"(?:lock(?:file)?|\.sum|\.lock|integrity|checksums?|\.min\.\w+)(?:$|[/.])", re.I)


@dataclass
class Words:
    """A dictionary and the letter transitions of its words."""

    known: frozenset[str]
    step: np.ndarray = field(default_factory=lambda: np.zeros((27, 27)))

    @classmethod
    def load(cls, vocabulary: str) -> Words:
        """From a tokenizer's vocabulary file: its whole-word entries of letters."""
        with open(vocabulary, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        words = sorted(w for e in entries if e.endswith("</w>") and len(w := e[:-4]) >= 4 and w.isascii() and w.isalpha())
        counts = np.ones((27, 27))
        for w in words:
            at = [26, *(ord(c) - 97 for c in w.lower()), 26]
            np.add.at(counts, (at[:-1], at[1:]), 1)
        return cls(frozenset(w.lower() for w in words), np.log2(counts / counts.sum(axis=1, keepdims=True)))

    def transition(self, value: str) -> float:
        """Mean log-likelihood of the value's letter transitions; what is no letter ends a word."""
        at = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in value.lower()]
        return float(self.step[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of the value that dictionary words cover, longest first from the left."""
        text, covered = value.lower(), 0
        for run in re.findall(r"[a-z]{4,}", text):
            i = 0
            while i < len(run) - 3:
                for n in range(min(len(run) - i, 20), 3, -1):
                    if run[i : i + n] in self.known:
                        covered += n
                        i += n
                        break
                else:
                    i += 1
        return covered / len(text) if text else 0.0


@lru_cache(maxsize=2)
def _words(vocabulary: str) -> Words:
    return Words.load(vocabulary)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, in order; of overlapping ones the earlier kind in KINDS stays.

    Those that begin at one place are one, with the end of the longest, so that nothing of a value stands after its end.
    """
    found = [(m.start("value"), m.end("value"), "assigned") for m in ASSIGNED.finditer(text)]
    found += [(m.start(), m.end(), m.lastgroup) for m in SHAPED.finditer(text)]
    found += [(m.start(), m.end(), "long") for m in LONG.finditer(text)]
    ends: dict[int, int] = {}
    for a, b, _ in found:
        ends[a] = max(b, ends.get(a, 0))
    found = [(a, ends[a], kind) for a, _, kind in found]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda c: (KINDS.index(c[2]), c[0])):
        if all(b <= x or y <= a for x, y, _ in out[-200:]) if len(found) <= 200 else True:
            out.append((a, b, kind))
    if len(found) > 200:  # many in one text: sweep instead of comparing each with each
        taken = np.zeros(len(text) + 1, bool)
        out, every = [], out
        for a, b, kind in every:
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((a, b, kind))
    return sorted(out)


_NEIGHBOUR = re.compile(r"[a-z][a-z0-9]*", re.I)


def neighbours(text: str, start: int, end: int) -> frozenset[str]:
    """The words beside a candidate; a compound name gives its parts. Words that the neighbourhood cuts off don't count."""
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    if start > NEAR:
        before = re.sub(r"^[A-Za-z0-9]+", "", before)
    if end + NEAR < len(text):
        after = re.sub(r"[A-Za-z0-9]+$", "", after)
    return frozenset(w.lower() for side in (before, after) for w in _NEIGHBOUR.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", side.replace("_", " "))))


@dataclass
class Beside:
    """How often each word stands beside true and beside false findings of the training rows."""

    true: dict[str, int] = field(default_factory=dict)
    false: dict[str, int] = field(default_factory=dict)
    n_true: int = 0
    n_false: int = 0

    def add(self, words: frozenset[str], label: int) -> None:
        counts = self.true if label else self.false
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        self.n_true, self.n_false = self.n_true + label, self.n_false + 1 - label

    def odds(self, words: frozenset[str], own: int | None = None) -> tuple[float, float, float]:
        """Sum, greatest and least of the words' smoothed log-odds; a training row (own: its label) doesn't count itself."""
        found = []
        for w in words:
            a, b = self.true.get(w, 0) - (own == 1), self.false.get(w, 0) - (own == 0)
            if a + b > 1:
                found.append(math.log((a + 0.5) / (self.n_true + 1)) - math.log((b + 0.5) / (self.n_false + 1)))
        return (sum(found), max(found), min(found)) if found else (0.0, 0.0, 0.0)


FEATURES = ("length", "entropy", "transition", "coverage", "digits", "upper", "lower", "other", "classes", "hex", "runs", "distinct", "quoted", "word_before", "for_near", "against_near", "against_value", "beside_sum", "beside_most", "beside_least", "test_path", "lock_path", *(f"is_{k}" for k in KINDS))


def features(text: str, start: int, end: int, kind: str, path: str, words: Words, known: Beside, own: int | None = None) -> list[float]:
    """One candidate's row; own is its label if it is a training row."""
    value = text[start:end]
    n = len(value)
    counts = {c: value.count(c) for c in set(value)}
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    digits, upper, lower = (sum(map(f, value)) / n for f in (str.isdigit, str.isupper, str.islower))
    classes = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    beside = f"{before} {after}"
    row = [n, -sum(k / n * math.log2(k / n) for k in counts.values()), words.transition(value), words.coverage(value), digits, upper, lower, 1 - digits - upper - lower]
    row += [sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n, bool(re.fullmatch(r"[0-9a-fA-F-]+", value)), max(len(m[0]) for m in re.finditer(r"(.)\1*", value, re.S)) / n, len(counts) / n]
    row += [before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before), words.coverage(before[-NEAR:]), len(FOR.findall(beside)), len(AGAINST.findall(beside)), len(AGAINST.findall(re.sub(r"[_\W]+", " ", value))), *known.odds(neighbours(text, start, end), own)]
    row += [bool(TEST_PATH.search(path)), bool(LOCK_PATH.search(path)), *(kind == k for k in KINDS)]
    return [float(x) for x in row]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, left child (right is the next), share of true findings; and the words learnt beside findings."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    beside: Beside = field(default_factory=Beside)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 4, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        some = max(1, int(math.sqrt(x.shape[1])))
        out = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            feature, threshold, left, share = [-1], [0.0], [0], [0.0]
            open_ = [(0, rows, 0)]
            while open_:
                at, rows, level = open_.pop()
                hits = y[rows].sum()
                share[at] = (hits + 0.5) / (len(rows) + 1)
                if level >= depth or len(rows) < 2 * least or hits in (0, len(rows)):
                    continue
                best = (1e-9, -1, 0.0)
                whole = hits * (len(rows) - hits) / len(rows)
                for f in rng.choice(x.shape[1], some, replace=False):
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    v, ones = x[order, f], np.cumsum(y[order])
                    k = np.flatnonzero(v[:-1] < v[1:])
                    k = k[(k + 1 >= least) & (len(rows) - k - 1 >= least)]
                    if len(k):
                        a, b = k + 1.0, len(rows) - k - 1.0
                        gain = whole - ones[k] * (a - ones[k]) / a - (hits - ones[k]) * (b - hits + ones[k]) / b
                        i = int(gain.argmax())
                        best = max(best, (float(gain[i]), int(f), float((v[k[i]] + v[k[i] + 1]) / 2)))
                if best[1] < 0:
                    continue
                feature[at], threshold[at], left[at] = best[1], best[2], len(feature)
                goes = x[rows, best[1]] <= best[2]
                for part in (rows[goes], rows[~goes]):
                    open_.append((len(feature), part, level + 1))
                    for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (share, 0.0)):
                        a.append(v)
            out.append((np.array(feature), np.array(threshold), np.array(left), np.array(share)))
        return cls(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of true findings over the trees."""
        if not self.trees:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for feature, threshold, left, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                f = at[rows]
                at[rows] = left[f] + (x[rows, feature[f]] > threshold[f])
            total += share[at]
        return total / len(self.trees)


def made_findings(n: int = 4_000, seed: int = 7, vocabulary: str | None = None) -> list[tuple[str, str, int]]:
    """(path, text around one candidate, is it a secret), made by rule for corpora that bring no labelled findings."""
    rng = random.Random(seed)
    letters, hex_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    words = sorted(_words(vocabulary).known)[:: 7] if vocabulary else ["report", "value", "window", "market", "letter", "garden"]
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    names = ("token", "api_key", "password", "secret", "client_secret", "access_key", "db_password", "auth_token", "private_key")
    paths = ("src/app.py", "config/settings.yaml", "src0", "src12", "", "deploy/main.tf", "lib/client.js")
    quiet = (*paths, "tests/test_client.py", "docs/setup.md", "package-lock.json", "go.sum", "examples/config.yml")
    out = []
    for i in range(n):
        true = i % 2
        if true:
            value = rng.choice((lambda: pick(hex_, rng.choice((32, 40, 40, 64))), lambda: pick(letters, rng.randint(16, 60)), lambda: pick(letters + "+/", rng.choice((24, 40, 44))), lambda: "ghp_" + pick(letters, 36), lambda: "AKIA" + pick(letters[:26] + letters[52:], 16), lambda: pick(letters + "!@#$%^&*", rng.randint(9, 18))))()
            around = rng.choice((f'{rng.choice(names)} = "{value}"', f"{rng.choice(names)}: {value}", f'{rng.choice(names).upper()}="{value}"', f'"{rng.choice(names)}": "{value}"'))
            path = rng.choice(paths)
        else:
            word = rng.choice(words)
            around = rng.choice((
                lambda: f'{rng.choice(names)} = "your_{word}_here"', lambda: f"{rng.choice(names)}: {rng.choice(('changeme', 'example', 'placeholder', 'xxxxxxxxxx', 'test1234', 'dummy_value'))}",
                lambda: f"{rng.choice(names)} = os.environ.{word.upper()}", lambda: f"{rng.choice(names)}={word}_{rng.choice(words)}", lambda: f"commit {pick(hex_, 40)}", lambda: f"sha256 checksum {pick(hex_, 64)}",
                lambda: f"md5 hash: {pick(hex_, 32)}", lambda: f"uuid {pick(hex_, 8)}-{pick(hex_, 4)}-{pick(hex_, 4)}-{pick(hex_, 4)}-{pick(hex_, 12)}", lambda: f'"integrity": "sha512-{pick(letters + "+/", 86)}=="', lambda: f"{word}-{rng.choice(words)}-{rng.choice(words)}-v{rng.randint(1, 99)}",
                lambda: f"assets/{word}/{rng.choice(words)}/{rng.choice(words)}_{rng.randint(10, 9999)}", lambda: f"{pick('0123456789', rng.randint(20, 30))}", lambda: f"the {rng.choice(names)}: {word}{rng.choice(words)}",
            ))()
            path = rng.choice(quiet)
        out.append((path, f"{prose(rng.randint(0, 6))} {around} {prose(rng.randint(0, 6))}", true))
    return out


def train(findings: DataFrame, vocabulary: str, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """From rows path, text, label (1 true, 0 false): each row's first candidate counts; rows without one, or with nulls, don't."""
    rows = findings.where("text is not null and label is not null").select(F.coalesce("path", F.lit("")).alias("path"), "text", F.col("label").cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("path", "text"), "label").limit(sample_rows).toArrow().to_pydict()
    words, known, first = _words(vocabulary), Beside(), []
    for path, text, label in zip(rows["path"], rows["text"], rows["label"], strict=True):
        if found := candidates(text):
            first.append((text, *found[0], path, label))
            known.add(neighbours(text, *found[0][:2]), label)
    x, y = [features(*row[:-1], words, known, row[-1]) for row in first], [row[-1] for row in first]
    if len(set(y)) < 2:
        return Forest([])
    forest = Forest.fit(np.array(x), np.array(y))
    forest.beside = known
    return forest


def scan(docs: DataFrame, forest: Forest, vocabulary: str, path_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), kind, masked, value_sha256, score, predicted (score >= 0.5).

    The value itself stays in its text: masked shows at most its first four characters. Null and empty texts have no
    candidates, a null path counts as empty. Rows that repeat give repeated findings. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary)
        for part in slices(batches, "text", STEP_BYTES):
            found, x = [], []
            for doc, path, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                for a, b, kind in candidates(text):
                    value = text[a:b]
                    found.append((doc, a, b, kind, value[: min(4, len(value) // 4)] + "***", hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()))
                    x.append(features(text, a, b, kind, path, words, forest.beside))
            if found:
                score = forest.score(np.array(x))
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "start", "end", "kind", "masked", "value_sha256", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, kind string, masked string, value_sha256 string, score double, predicted int")


def made_table(spark: SparkSession, vocabulary: str, n: int = 4_000) -> DataFrame:
    return spark.createDataFrame(made_findings(n, vocabulary=vocabulary), "path string, text string, label int")
