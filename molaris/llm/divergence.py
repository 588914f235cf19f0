"""Source divergence audit: how far the words of one source of a language are from those of each other, exactly.

Terms are runs of letters (``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased). A language keeps the V terms that
stand in at least ``LEAST`` of its documents. A group is a (language, source) that occurs; it gives each kept term
p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), N the sum of its counts. The distance of two groups is the
sum of abs(p - p') over all kept terms; a term stands out in a group as far as its p is above the whole language's.

Method. The kept terms of a language are numbered, and the counts of a group are the leaves of a segment tree over the
numbers. Nodes are hash-consed: a node is the pair of its children, a leaf its count, so equal subtrees, of one group or
of several, at any place, are one node. Two trees are walked at the same time from their roots, level by level; equal
pairs of nodes of the same two groups are priced once, and prices are summed on the way back.

The trees are cut into subtrees over hash buckets of the terms, of ``CELLS`` leaves for all groups of a language together;
within a bucket, terms are numbered by their count in the language, so that the rare ones, with few different counts,
share nodes. A bucket is one piece of work; Spark sums the prices of the subtrees and ranks the best terms of each.
Words are counted per task before they are shuffled, so a common word or a large source sends one row for each task.

* Null text, language and source count as ''. Rows are documents: equal rows count each for itself; ids are not read.
* A group without a kept term has N = 0, a language without one has V = 0 and distances of 0 and no ``term`` rows.
* Ties rank by the item's UTF-8 bytes. All sums are whole numbers; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molaris.llm.common import written

LEAST = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Leaves of the subtrees of one bucket, and rows of counts that a task holds before it hands them on.
CELLS = 65_536
HELD = 400_000
#: Languages, one row each, that are broadcast; with more of them the joins by language are shuffled.
LANGUAGES = 10_000
#: Pairs of nodes that are walked at the same time.
PAIRS = 1_000_000

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


# words


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """(group, term, n, docs): how often each group of the batch has each term, and in how many rows."""
    lists = [(raw or b"").translate(_PLAIN).split() for raw in batch["text"].cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    terms = pa.array(chain.from_iterable(lists), pa.binary(), size=int(sizes.sum())).dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(len(terms.dictionary), 1)
    places, n = np.unique(np.repeat(np.arange(len(lists)), sizes) * width + codes, return_counts=True)
    names = pa.table([batch["lang"], batch["source"]], ["lang", "source"])
    group, first = _numbered(names)
    keys, inverse, docs = np.unique(group[places // width] * width + places % width, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, n, minlength=len(keys)).astype(np.int64)
    own = names.take(pa.array(first[keys // width]))
    found = terms.dictionary.take(pa.array(keys % width)).cast(pa.string())
    return pa.table([own["lang"], own["source"], found, pa.array(total), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _numbered(names: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, and the first row of each group."""
    lang, source = (names[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    codes = lang.indices.to_numpy().astype(np.int64) * (len(source.dictionary) + 1) + source.indices.to_numpy()
    _, first, number = np.unique(codes, return_index=True, return_inverse=True)
    return number, first


def _summed(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        parts.append(_batch_counts(batch))
        held += parts[-1].num_rows
        if held > HELD:
            parts = [_summed(parts)]
            held = parts[0].num_rows
            if held > HELD // 2:
                yield from parts[0].to_batches(max_chunksize=50_000)
                parts, held = [], 0
    if parts:
        yield from _summed(parts).to_batches(max_chunksize=50_000)


def counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """(lang, source, term, n): counts of the terms that their language keeps."""
    named = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
                        for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = named.mapInArrow(_count_words, _COUNTS)
    # one shuffle serves the sums of a term in a group and in its language; tasks have summed their own
    dealt = found.repartition("lang", "term")
    own = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return own.withColumn("all", everywhere).filter(F.col("all") >= least).select("lang", "source", "term", "n")


# trees


class Nodes:
    """Hash-consed nodes, level by level: a leaf is its count, any other node the pair of its children."""

    def __init__(self, leaves: np.ndarray) -> None:
        """leaves: one row for each tree, its width a power of two."""
        self.counts, level = np.unique(leaves, return_inverse=True)
        level = level.reshape(leaves.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while level.shape[1] > 1:
            width = level.max() + 1
            made, level = np.unique(level[:, ::2] * width + level[:, 1::2], return_inverse=True)
            level = level.reshape(len(leaves), -1)
            self.children.append((made // width, made % width))
        self.roots = level[:, 0]

    def prices(self, first: np.ndarray, second: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
        """The distance of each pair of trees; total has the sum of the counts of each tree's group."""
        pairs = np.arange(len(first))
        left, right = self.roots[first], self.roots[second]
        back = []
        for a, b in reversed(self.children):
            owner = np.concatenate([pairs, pairs])
            x, y = np.concatenate([a[left], b[left]]), np.concatenate([a[right], b[right]])
            # equal pairs of nodes of the same two trees go on as one
            width = len(self.counts) + max((len(c[0]) for c in self.children), default=0)
            _, once, again = np.unique((owner * width + x) * width + y, return_index=True, return_inverse=True)
            pairs, left, right = owner[once], x[once], y[once]
            back.append(again.reshape(2, -1))
        x, y = self.counts[left], self.counts[right]
        price = np.abs(chances(x, total[first[pairs]], kept) - chances(y, total[second[pairs]], kept))
        price[x < 0] = 0
        for again in reversed(back):
            price = price[again[0]] + price[again[1]]
        return price


def chances(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), exact for counts of any size."""
    n, below = np.broadcast_arrays(np.asarray(n, dtype=np.int64), np.asarray(total, dtype=np.int64) + SMOOTH * kept)
    whole, rest = (n + SMOOTH) // below, (n + SMOOTH) % below
    if rest.size and rest.max() > (1 << 62) // SCALE:
        small = rest.astype(object) * SCALE // below.astype(object)
        return 1 + whole * SCALE + small.astype(np.int64)
    return 1 + whole * SCALE + rest * SCALE // below


def _subtree(rows: pd.DataFrame) -> pd.DataFrame:
    """Prices of all pairs of a language's groups, and the best terms of each group, over the terms of one bucket."""
    frame = rows[rows["term"].isna()].sort_values("source")
    cells = rows[rows["term"].notna()]
    lang, bucket, kept, whole = frame["lang"].iat[0], frame["bucket"].iat[0], int(frame["kept"].iat[0]), int(frame["whole"].iat[0])
    sources, total = frame["source"].to_numpy(), frame["total"].to_numpy(dtype=np.int64)
    out = []

    def emit(part: str, tree: np.ndarray, item: np.ndarray, value: np.ndarray) -> None:
        out.append(pd.DataFrame({"lang": lang, "source": sources[tree], "part": part, "item": item, "value": value}))

    first, second = np.triu_indices(len(sources), 1)
    if not len(cells):
        if bucket == 0:  # a language without kept terms still has its pairs
            for a, b in ((first, second), (second, first)):
                emit("pair", a, sources[b], np.zeros(len(a), dtype=np.int64))
        return pd.concat(out) if out else pd.DataFrame(columns=["lang", "source", "part", "item", "value"])
    by_term = cells.groupby("term", sort=True)["n"].sum()
    terms, all_n = by_term.index.to_numpy(), by_term.to_numpy(dtype=np.int64)
    order = np.argsort(-all_n, kind="stable")
    place = np.empty(len(terms), dtype=np.int64)
    place[order] = np.arange(len(terms))
    column = place[np.searchsorted(terms, cells["term"].to_numpy())]
    tree = np.searchsorted(sources, cells["source"].to_numpy())
    width = 1 << (len(terms) - 1).bit_length()
    # a leaf past the last term is -1 in every tree and costs nothing
    leaves = np.full((len(sources), width), -1, dtype=np.int64)
    leaves[:, :len(terms)] = 0
    n = cells["n"].to_numpy(dtype=np.int64)
    leaves[tree, column] = n
    nodes = Nodes(leaves)
    step = max(1, PAIRS // width)
    for at in range(0, len(first), step):
        a, b = first[at:at + step], second[at:at + step]
        price = nodes.prices(a, b, total, kept)
        emit("pair", a, sources[b], price)
        emit("pair", b, sources[a], price)
    above = chances(n, total[tree], kept) - chances(all_n[order], whole, kept)[column]
    good = np.flatnonzero((above > 0) & (n > 0))
    best = pd.DataFrame({"tree": tree[good], "value": above[good], "item": terms[order[column[good]]]})
    best = best.sort_values(["tree", "value", "item"], ascending=[True, False, True])
    best = best[best.groupby("tree").cumcount() < TOP]
    emit("term", best["tree"].to_numpy(), best["item"].to_numpy(), best["value"].to_numpy())
    return pd.concat(out)


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows with the distance to every other source of the language,
    the farthest first, and the ``TOP`` ``term`` rows of each group."""
    cells = written(counts(df, text, lang, source, least), "divergence")
    named = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))])
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total"])
    terms = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.count(F.lit(1)).alias("groups"))
    langs = langs.join(terms, "lang", "left").fillna(0, ["kept"]).withColumn(
        "buckets", F.expr(f"CAST(greatest(1, ceil(kept * groups / {CELLS})) AS INT)"))
    langs = written(langs, "languages")
    near = F.broadcast(langs) if langs.count() <= LANGUAGES else langs
    frame = groups.join(near, "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), "total", "whole", "kept",
        F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("total", "whole", "kept")]
    dealt = cells.join(near.select("lang", "buckets"), "lang").select(
        "lang", "source", "term", "n", *none, F.expr("CAST(pmod(xxhash64(term), buckets) AS INT)").alias("bucket"))
    parts = frame.unionByName(dealt).groupBy("lang", "bucket").applyInPandas(
        _subtree, "lang string, source string, part string, item string, value bigint")
    # pairs meet over their subtrees, a term is in one of them
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(place))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= TOP))
