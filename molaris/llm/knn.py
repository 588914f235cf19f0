"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots are rows of the data. Queries and data fall to the cell of their nearest pivot. Small summaries per cell (radius,
count, and the k closest members with their distances) give two bounds:

* a query of cell i (pivot p, radius r) has k candidates that score at least the k-th largest of
  ``p.q - r|q| - s|p| - rs`` over the summarised members, s from pivot q; and it has those that it scores itself with the
  members of its own cell and of the ``NEAR`` cells next to it. The cell's threshold is the larger bound, by its least query;
* a row x scores at most ``p.x + r|x|`` with a query of cell i. It goes to the cells whose threshold it can reach.

Query cells are put together in groups of bounded size (a cell with more queries is dealt over several). Each
group's replicas are dealt in blocks of bounded size, as many as they need; its queries go to these blocks only, each is
solved by a matrix product, and the best k of the blocks of a query are merged. Only per-cell summaries reach the driver,
of ``MAX_PIVOTS`` cells at most; with more rows cells get larger.

Scores are integers. Components are floor(scale * x); products are exact up to 2^53, and computed modulo 2^64
beyond. Vectors of unequal length count as padded with zeros. Vectors that are null, or hold a null or
non-finite component, and rows with a null id take no part. A repeated id counts once, with its smallest
vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from molaris.llm.common import written

SCALE = 64
K = 20
#: Cells: the root of the rows, within these. The driver holds their pivots, a matrix of their products, and k members of each.
MIN_PIVOTS = 8
MAX_PIVOTS = 4096
#: Queries of a group and replicas of a block, about.
GROUP_QUERIES = 1024
BLOCK_ROWS = 8192
#: Cells beside its own whose closest members a query is scored with beforehand.
NEAR = 4


def prepared(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): rows that take part, with integer components; one row for each id."""
    whole = f"""`{vec_id}` IS NOT NULL AND `{vector}` IS NOT NULL AND forall(`{vector}`,
        x -> coalesce(NOT isnan(x) AND abs(x) < double('Infinity'), false))"""
    rows = df.filter(whole).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"),
        F.expr(f"transform(`{vector}`, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))").alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, by floating point where that is exact."""
    high = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if high < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _squared(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances to every pivot."""
    p, q = points.astype(np.float64), pivots.astype(np.float64)
    return np.maximum((p * p).sum(1)[:, None] - 2 * (p @ q.T) + (q * q).sum(1)[None, :], 0)


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add cell and distance to its pivot."""
    width = pivots.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _squared(matrix(batch["v"], width), pivots)
                batch["cell"] = far.argmin(axis=1).astype(np.int32)
                batch["far"] = np.sqrt(far.min(axis=1))
                yield batch

    return rows.mapInPandas(assign, "id bigint, v array<bigint>, cell int, far double")


def thresholds(pivots: np.ndarray, radius: np.ndarray, close: dict[int, list[float]], k: int) -> np.ndarray:
    """A score that k candidates of every query of a cell reach (its own row is allowed for)."""
    points = pivots.astype(np.float64)
    norms = np.sqrt((points * points).sum(1))
    dots = points @ points.T
    out = np.full(len(pivots), -np.inf)
    for i in np.flatnonzero(radius >= 0):
        lower = np.concatenate([
            dots[i, j] - radius[i] * norms[j] - np.array(far) * norms[i] - radius[i] * np.array(far)
            for j, far in close.items()
        ])
        if len(lower) > k:
            out[i] = np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1]
    return out


def scored_beforehand(pivots: np.ndarray, members: dict[int, np.ndarray], k: int, width: int):
    """(cell, least) of queries: what k candidates of a query reach among the closest members of cells near it (its own
    row is allowed for)."""
    cells = np.array(sorted(members))
    dots = pivots.astype(np.float64) @ pivots.astype(np.float64).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cell, own in batch.groupby("cell"):
                near = cells[np.argsort(-dots[cell, cells], kind="stable")[:NEAR]]
                some = np.concatenate([members[c] for c in dict.fromkeys([int(cell), *near.tolist()])])
                if len(some) > k:
                    score = products(matrix(own["v"], width), some)
                    out.append(pd.DataFrame({"cell": np.int32(cell), "least": np.partition(score, len(some) - k - 1, axis=1)[:, len(some) - k - 1]}))
            if out:
                yield pd.concat(out)

    return run


def grouped_cells(counts: dict[int, int], pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each cell. Cells near each other share a group; a large one has several."""
    first, parts = np.full(len(pivots), -1), np.ones(len(pivots), dtype=np.int64)
    left = dict(counts)
    group, load = 0, 0
    at = min(left, default=None)
    while at is not None:
        n = left.pop(at)
        if load and load + n > GROUP_QUERIES:
            group, load = group + 1, 0
        first[at], parts[at] = group, ceil(n / GROUP_QUERIES)
        load += n
        if parts[at] > 1:
            group, load = group + int(parts[at]), 0
        cells = np.array(sorted(left), dtype=np.int64)
        at = int(cells[_squared(pivots[at:at + 1], pivots[cells])[0].argmin()]) if len(cells) else None
    return first, parts


def top_k(df: DataFrame, is_query: str, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the SQL condition on ``id`` holds, the k rows of
    other ids with the largest inner products, ties to the smaller id."""
    spark = df.sparkSession
    rows = written(prepared(df, vec_id, vector, scale), "vectors")
    schema = "query_id bigint, vec_id bigint, score bigint"
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    n_pivots, width = min(MAX_PIVOTS, max(MIN_PIVOTS, ceil(sqrt(size["n"])))), size["width"]
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(n_pivots).collect()
    pivots = matrix([r["v"] for r in chosen], width)
    data = written(in_cells(rows, pivots), "cells")
    queries = data.filter(is_query)

    # the k + 1 closest members of each cell; the window's limit is applied before the shuffle
    order = W.partitionBy("cell").orderBy("far", "id")
    nearest = data.select("cell", "far", "v", F.row_number().over(order).alias("n")).filter(F.col("n") <= k + 1)
    close: dict[int, list[float]] = {}
    vectors: dict[int, list] = {}
    for r in nearest.select("cell", "far", "v").collect():
        close.setdefault(r["cell"], []).append(r["far"])
        vectors.setdefault(r["cell"], []).append(r["v"])
    members = {cell: matrix(v, width) for cell, v in vectors.items()}
    radius, counts = np.full(len(pivots), -1.0), {}
    for r in queries.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], counts[r["cell"]] = r["radius"], r["n"]
    reach = thresholds(pivots, radius, close, k)
    least = queries.select("cell", "v").mapInPandas(scored_beforehand(pivots, members, k, width), "cell int, least bigint")
    for r in least.groupBy("cell").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")).collect():
        if r["n"] == counts[r["cell"]]:
            reach[r["cell"]] = max(reach[r["cell"]], r["least"])
    first, parts = grouped_cells(counts, pivots)
    n_groups = int((first + parts)[radius >= 0].max(initial=0))
    active = np.flatnonzero(radius >= 0)
    if not len(active):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"], width).astype(np.float64)
            best = x @ pivots[active].astype(np.float64).T + np.sqrt((x * x).sum(1))[:, None] * radius[active][None, :]
            # a little slack for rounding
            wanted = best + 1e-6 * (1 + np.abs(best)) >= reach[active][None, :]
            to = np.zeros((len(batch), n_groups), dtype=bool)
            for column, cell in enumerate(active):
                to[:, first[cell]:first[cell] + parts[cell]] |= wanted[:, column:column + 1]
            for group in range(n_groups):
                part = batch.loc[to[:, group], ["id", "v"]]
                if len(part):
                    yield part.assign(grp=np.int32(group))

    replicas = written(data.select("id", "v").mapInPandas(replicate, "id bigint, v array<bigint>, grp int"), "replicas")
    # one small row for each group
    blocks = replicas.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    replicas = replicas.join(blocks, "grp").select("id", "v", "grp", F.expr("CAST(pmod(xxhash64(id, 7), blocks) AS INT)").alias("block"))
    of_cell = F.create_map(*[F.lit(int(x)) for c in active for x in (c, first[c])])
    split = F.create_map(*[F.lit(int(x)) for c in active for x in (c, parts[c])])
    asked = queries.select(
        "id", "v", (of_cell[F.col("cell")] + F.pmod(F.xxhash64("id"), split[F.col("cell")])).cast("int").alias("grp"),
    ).join(blocks, "grp").select("id", "v", "grp", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        x = x.sort_values("id", kind="stable")
        ids, own = x["id"].to_numpy(), q["id"].to_numpy()
        score = products(matrix(q["v"], width), matrix(x["v"], width))
        out = []
        for row in range(len(own)):
            others = np.flatnonzero(ids != own[row])
            s = score[row, others]
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                keep = np.flatnonzero(s >= edge)
                others, s = others[keep], s[keep]
            best = np.argsort(-s, kind="stable")[:k]
            out.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[others[best]], "score": s[best]}))
        return pd.concat(out)

    solved = asked.groupBy("grp", "block").cogroup(replicas.groupBy("grp", "block")).applyInPandas(solve, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = solved.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
