"""Secret scan: candidates by a pattern, false positives removed by a random forest.

A candidate is a run of at least ``MIN_LENGTH`` key characters with a digit, or whatever stands after a credential
name and an assignment (or after ``Bearer``): up to the closing quote, or without a quote up to the next blank or
quote, at least ``NAMED_LENGTH`` characters of any kind. Its features are length, how often the kind of character
changes, spread of characters, coverage by a dictionary of plain words, signs of a path, what stands before it (an
assignment, a quote, a credential word) and after it. The forest is trained in numpy from labelled findings.

The forest's verdict stands for every candidate. ``fit`` takes labelled findings. ``weak_labels`` derives labels from the
corpus where there are none, for training only: a value of a credential name is a secret if it is quoted or mixes digits and
letters; numbers, paths, UUIDs, placeholders and values of an id's name are none. All others are undecided and not trained on.

Training takes at most ``MAX_TRAIN`` findings of each label, the first by hash of their value and context; the
dictionary is of the words around these. The scan covers every whole text.

* Null text has no finding. Repeated rows give their findings once each. Null ids are carried along.
* With fewer than ``MIN_TRAIN`` findings of a label there is no forest; then the derived labels are the verdicts, and
  undecided candidates stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molaris.llm.common import written

MIN_LENGTH = 16
NAMED_LENGTH = 4
CONTEXT = 48
MAX_TRAIN = 2_000
MIN_TRAIN = 12
#: A word that stands near fewer findings tells nothing.
MIN_SEEN = 4
DICTIONARY = 2_000
TREES = 24
DEPTH = 7
MASK = "<SECRET>"

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=\-]{%d,}" % MIN_LENGTH)
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_ASSIGNED = re.compile(r"[A-Za-z_][\w.\-]*\s{0,3}[:=]\s{0,3}[\"'`]?$")
_WORDS = r"(?i:token(?!i[sz]|s\b)|secret(?!ar)|passw|pwd|api.?key|access.?key|private.?key|auth(?!ors?\b|orit)|credential|bearer)"
_CREDENTIAL = re.compile(_WORDS)
_BEGINS = ("token", "secret", "passw", "pwd", "key", "auth", "credential", "bearer")
# what stands between a credential word and its value
_UP_TO = r"(?:%s[\w.\-]{0,64}[\"'`]?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}[\"'`]?(?:(?i:bearer|basic)[ \t]{1,3})?|\b(?i:bearer)[ \t]{1,3})" % _WORDS
_NAMED = re.compile(_UP_TO)
_NAMED_END = re.compile(_UP_TO + r"[\"'`]?$")
_QUOTED = {q: re.compile(rf"[^{q}\n]*(?={q})") for q in "\"'`"}
_BARE = re.compile(r"[^\s\"'`]*")
_PLACEHOLDER = re.compile(r"(?i)\$[({]|\{\{|<|(?:none|null|true|false|x+|\*+)$")
_NUMBER = re.compile(r"[0-9+\-=_/]+$")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_PATH_PART = re.compile(r"[A-Za-z]?[a-z_\-]+$|[0-9]+$")
_ID_NAME = re.compile(r"(?i)(?:\b|_|\b\w{0,24})(id|uuid|guid|sha[0-9]*|md5|hash|digest|checksum|commit|rev|revision|etag|version)[\"'`]?\s{0,3}[:=]\s{0,3}[\"'`]?$")


def _named(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the values of credential names."""
    low = text.lower()
    if not any(w in low for w in _BEGINS):  # much faster than the pattern
        return
    done = 0
    for hit in _NAMED.finditer(text):
        start = hit.end()
        quote = text[start - 1]
        if quote not in _QUOTED and text[start:start + 1] in _QUOTED:  # after a scheme
            quote, start = text[start], start + 1
        if start < done:
            continue
        inside = _QUOTED[quote].match(text, start) if quote in _QUOTED else None
        value = inside.group() if inside else _BARE.match(text, start).group().rstrip(".,;:?)]}>")
        done = start + len(value)
        if len(value) >= NAMED_LENGTH:
            yield start, done


def found_in(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the candidates of a text, in order and apart. Signs of an assignment at either end are not part of one."""
    runs = []
    for hit in CANDIDATE.finditer(text):
        value = hit.group()
        start = hit.start() + len(value) - len(value.lstrip("=/-"))
        value = value.lstrip("=/-")
        if len(value) >= MIN_LENGTH and _DIGIT.search(value):
            runs.append((start, start + len(value)))
    at = 0
    for start, end in _named(text):
        while at < len(runs) and runs[at][1] <= start:
            yield runs[at]
            at += 1
        more = at
        while more < len(runs) and runs[more][0] < end:
            more += 1
        if more > at and re.search(r"\s", text[start:end]):
            continue  # a quoted sentence around other candidates
        at = more
        # a run may go on after a value
        if at and runs[at - 1][0] < end < runs[at - 1][1]:
            end = runs[at - 1][1]
        yield start, end
    yield from runs[at:]


def assigned_name(before: str) -> str:
    """The name that a value is assigned to, or nothing."""
    hit = _ASSIGNED.search(before)
    return hit.group() if hit else ""


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def weak_label(value: str, before: str) -> int | None:
    """1: a secret, 0: none, by how it is written down; nothing if that does not tell."""
    if _NAMED_END.search(before) or _CREDENTIAL.search(assigned_name(before)):
        if _PLACEHOLDER.match(value):
            return 0
        if len(set(value)) <= 5 or re.search(r"\s", value) or re.match(r"[.~]{0,2}/|\w+://", value):
            return None
        mixed = len(value) >= 8 and _DIGIT.search(value) and re.search(r"[^\W\d_]", value)
        return 1 if mixed or before[-1:] in tuple("\"'`") else None
    if _NUMBER.match(value) or _UUID.match(value) or _ID_NAME.search(before) or before[-1:] in tuple("/\\"):
        return 0
    parts = value.split("/")
    return 0 if len(parts) > 2 and 2 * sum(bool(_PATH_PART.match(p)) for p in parts) > len(parts) else None


def features(value: str, before: str, after: str, dictionary: dict[str, float]) -> list[float]:
    """dictionary: the words around findings, and how much more often each stands near secrets (log odds)."""
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(value) - 1)
    counts = np.array(list(Counter(value).values())) / len(value)
    pieces = words_of(value)
    covered = sum(len(w) for w in pieces if w in dictionary) / len(value)
    near = words_of(before[-CONTEXT // 2:])
    plain = [w for w in near if not _CREDENTIAL.search(w)]
    name = assigned_name(before)
    return [
        float(len(value)), changes, float(-(counts * np.log2(counts)).sum()), covered,
        kinds.count("d") / len(value), kinds.count("u") / len(value),
        float(len(set(value.lower()) - set("0123456789abcdef")) == 0),
        value.count("/") / len(value), float(before[-1:] in tuple("/\\.@")), float(after[:1] in tuple("/\\.@")),
        sum(w in dictionary for w in plain) / max(1, len(plain)),
        float(bool(name)), float(bool(_CREDENTIAL.search(name))), float(before[-1:] in tuple("\"'`")),
        sum(dictionary.get(w, 0.0) for w in plain), sum(dictionary.get(w, 0.0) for w in words_of(after[:CONTEXT // 2])),
        float(any(_CREDENTIAL.search(w) for w in near)), float(bool(_ID_NAME.search(before))), float(bool(_UUID.match(value))),
    ]


# forest


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), bound, children and share of secrets of each node."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    dictionary: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, bound, child, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = child[node] + (x[inner, feature[node]] > bound[node])
            total += share[at]
        return total / max(1, len(self.trees))


def _best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
    best, found = 1e-9, None
    n, ones = len(y), y.sum()
    parent = ones * (n - ones) / n
    for column in columns:
        order = np.argsort(x[:, column], kind="stable")
        value, label = x[order, column], y[order]
        left_n, left = np.arange(1, n), np.cumsum(label)[:-1]
        impurity = left * (left_n - left) / left_n + (ones - left) * (n - left_n - ones + left) / (n - left_n)
        impurity[value[1:] == value[:-1]] = np.inf
        at = int(impurity.argmin())
        if parent - impurity[at] > best:
            best, found = parent - impurity[at], (int(column), float((value[at] + value[at + 1]) / 2))
    return found


def grown(x: np.ndarray, y: np.ndarray, dictionary: dict[str, float], seed: int = 0) -> Forest:
    rng = np.random.default_rng(seed)
    some = max(1, int(np.sqrt(x.shape[1])))
    trees = []
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        feature, bound, child, share = [], [], [], []

        def node(rows: np.ndarray) -> int:
            feature.append(-1)
            bound.append(0.0)
            child.append(0)
            share.append(float(y[rows].mean()))
            return len(feature) - 1

        todo = [(node(rows), rows, 0)]
        while todo:
            at, rows, depth = todo.pop()
            if depth == DEPTH or len(rows) < 4 or share[at] in (0.0, 1.0):
                continue
            split = _best_split(x[rows], y[rows], rng.choice(x.shape[1], some, replace=False))
            if split is None:
                continue
            right = x[rows, split[0]] > split[1]
            feature[at], bound[at] = split
            first, second = node(rows[~right]), node(rows[right])
            child[at] = first  # the right child follows
            todo += [(first, rows[~right], depth + 1), (second, rows[right], depth + 1)]
        trees.append((np.array(feature), np.array(bound), np.array(child), np.array(share)))
    return Forest(trees, dictionary)


# Spark

_FINDING = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def candidates(text: Column) -> Column:
    """Every candidate of a text with its place (in characters) and context."""

    @F.arrow_udf(_FINDING)
    def find(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch:
            s = t.as_py() or ""
            out.append([
                {"start": a, "end": b, "value": s[a:b], "before": s[max(0, a - CONTEXT):a], "after": s[b:b + CONTEXT]}
                for a, b in found_in(s)])
        fields = [("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())]
        return pa.array(out, pa.list_(pa.struct(fields)))

    return find(text)


def weak_labels(findings: DataFrame) -> DataFrame:
    """Label findings (value, before, after) by how they are written down; null if undecided."""

    @F.arrow_udf("int")
    def label(value: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array(list(map(weak_label, value.to_pylist(), before.to_pylist())), pa.int32())

    return findings.withColumn("label", label("value", "before"))


def fit(labelled: DataFrame) -> Forest | None:
    """Train on a bounded number of labelled findings (value, before, after, label)."""
    columns = ["value", "before", "after"]
    rows = []
    for label in (0, 1):
        some = labelled.filter(F.col("label") == label).select(*columns, "label")
        rows += some.orderBy(F.xxhash64(*columns), *columns).limit(MAX_TRAIN).collect()
    y = np.array([float(r["label"]) for r in rows])
    if min((y == 0).sum(), (y == 1).sum()) < MIN_TRAIN:
        return None
    seen = [Counter(w for r in rows if r["label"] == label for w in {*words_of(r["before"]), *words_of(r["after"])}
                    if not _CREDENTIAL.search(w)) for label in (0, 1)]
    common = sorted((seen[0] + seen[1]).items(), key=lambda x: (-x[1], x[0]))[:DICTIONARY]
    n = [(y == 0).sum() + 2, (y == 1).sum() + 2]
    dictionary = {w: float(np.log((seen[1][w] + 1) / n[1]) - np.log((seen[0][w] + 1) / n[0])) if k >= MIN_SEEN else 0.0 for w, k in common}
    x = np.array([features(r["value"], r["before"], r["after"], dictionary) for r in rows])
    return grown(x, y, dictionary)


def _probability(forest: Forest | None, spans: list[tuple[str, str, str]]) -> np.ndarray:
    if forest is None:
        return np.array([float(weak_label(value, before) == 1) for value, before, _ in spans])
    if not spans:
        return np.zeros(0)
    return forest.probability(np.array([features(*s, forest.dictionary) for s in spans]))


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", forest: Forest | None = None) -> tuple[DataFrame, Forest | None]:
    """(doc_id, start, length, value, probability, is_secret) for every candidate, and the forest used."""
    every = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(candidates(F.col(f"`{text}`"))).alias("f"))
    findings = written(every.select("doc_id", "f.*"), "findings")
    forest = forest or fit(weak_labels(findings))

    @F.arrow_udf("double")
    def probability(value: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        return pa.array(_probability(forest, list(zip(value.to_pylist(), before.to_pylist(), after.to_pylist()))), pa.float64())

    scored = findings.withColumn("probability", probability("value", "before", "after"))
    return scored.select(
        "doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "value", "probability",
        (F.col("probability") >= 0.5).alias("is_secret")), forest


def redacted(text: Column, forest: Forest | None) -> Column:
    """The text with every secret replaced; a null text stays null."""

    @F.arrow_udf("string")
    def redact(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch:
            s = t.as_py()
            spans = list(found_in(s or ""))
            p = _probability(forest, [(s[a:b], s[max(0, a - CONTEXT):a], s[b:b + CONTEXT]) for a, b in spans])
            done, parts = 0, []
            for (a, b), secret in zip(spans, p >= 0.5):
                if secret:
                    parts += [s[done:a], MASK]
                    done = b
            out.append(s if not done else "".join([*parts, s[done:]]))
        return pa.array(out, pa.string())

    return redact(text)
