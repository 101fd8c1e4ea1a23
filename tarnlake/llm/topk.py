"""Exact top-k inner products by pivot-table elimination.

Each vector's distances to a set of pivots are computed once (the pivot table). For a query q and a
candidate x, the largest |d(q,p) - d(x,p)| over the pivots is a lower bound of d(q,x), and as
2 q.x = |q|^2 + |x|^2 - d(q,x)^2, it gives an upper bound of the score. Candidates are evaluated in bound
order, in growing runs, until the next bound is below the k-th best score: then no other can enter.

Candidates are dealt to blocks by their nearest pivot. A query first meets the block that it lies in itself, whose k-th
best score is a floor for all others; the pivots' least and largest distances in a block bound its best score, and
the query goes only to blocks that can reach the floor. A block's k best go into one ranking per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.scratch import Scratch

_LAST = 2**63 - 1  # stands for a null id, which loses every tie
FOUND = "query_row long, query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, scale: int = 64) -> DataFrame:
    """(row, vec_id, ints): floor(scale * x) of each component as double. Vectors that are null, or hold a
    null, NaN or infinite component, take no part. An integer beyond a long is the nearest long."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale))
    kept = df.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_LAST)).alias("vec_id"), "embedding").filter(F.col("embedding").isNotNull() & ~bad)
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("ints"))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists as rows; shorter vectors are padded with zeros."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    sizes = np.diff(flat.offsets.to_numpy())
    width = max(width or 0, int(sizes.max(initial=0)))
    values = flat.flatten().to_numpy()
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=values.dtype)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart rows of the sample: each next pivot is the one farthest from those chosen."""
    x = sample.astype(np.float64)
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds dist (float array, one for each pivot), norm2 and cell (the nearest pivot)."""
    width = pivots.shape[1] if pivots.ndim == 2 else 0
    norms = (pivots**2).sum(1)

    def measure(batches):
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(2)]), width).astype(np.float64)
            p = np.zeros((len(pivots), x.shape[1]))
            p[:, :width] = pivots
            n2 = (x**2).sum(1)
            dist = np.sqrt(np.maximum(n2[:, None] + norms[None] - 2 * x @ p.T, 0)).astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(p), dist.reshape(-1))
            cell = dist.argmin(axis=1).astype(np.int32) if len(p) else np.zeros(len(x), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(n2), pa.array(cell)], ["row", "vec_id", "ints", "dist", "norm2", "cell"])

    return vectors.mapInArrow(measure, "row long, vec_id long, ints array<long>, dist array<float>, norm2 double, cell int")


def exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """The cheapest number type in which every inner product is exact."""
    widest = lambda v: max(1, abs(int(v.min(initial=0))), int(v.max(initial=0)))
    peak = widest(q) * widest(x) * max(1, x.shape[1])
    return np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else object


def slack_of(q_norm2: np.ndarray, c_norm2: np.ndarray) -> float:
    """float32 distances are off by some 1e-7 of their size; bounds are raised by more than that can matter."""
    return 1e-5 * (float(np.max(c_norm2, initial=0)) + float(np.max(q_norm2, initial=0)) + 1) + 1


def block_topk(q: dict, c: dict, k: int, first: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of each query's k best in one candidate block, those below the
    query's "floor" left out."""
    kind = exact_type(q["ints"], c["ints"])
    x, queries = c["ints"].astype(kind), q["ints"].astype(kind)
    dist, n = np.ascontiguousarray(c["dist"].T), len(x)
    half = (c["norm2"] / 2).astype(np.float64)
    slack = slack_of(q["norm2"], c["norm2"])
    low, step = np.empty(n, np.float32), np.empty(n, np.float32)
    out_q, out_c, out_s = [], [], []
    by_id = np.lexsort((c["row"], c["vec_id"]))
    rank_of = np.empty(n, np.int64)
    rank_of[by_id] = np.arange(n)
    for i in range(len(queries)):
        low.fill(0)
        for p in range(len(dist)):
            np.subtract(dist[p], q["dist"][i, p], out=step)
            np.abs(step, out=step)
            np.maximum(low, step, out=low)
        bound = half + (q["norm2"][i] / 2 + slack) - low.astype(np.float64) ** 2 / 2
        bound[c["row"] == q["row"][i]] = -np.inf
        at = np.empty(0, np.int64)
        score = np.empty(0, kind)
        todo, run = np.flatnonzero((bound > -np.inf) & (bound >= q["floor"][i])), first
        while len(todo):
            if run < len(todo):
                part = np.argpartition(-bound[todo], run - 1)
                now, todo = todo[part[:run]], todo[part[run:]]
            else:
                now, todo = todo, todo[:0]
            got = (x @ queries[i])[now] if 2 * len(now) > n else x[now] @ queries[i]
            at, score = np.concatenate([at, now]), np.concatenate([score, got])
            if len(score) > k:
                kth = np.partition(score.astype(np.float64) if kind is object else score, len(score) - k)[len(score) - k]
                near = score >= kth
                at, score = at[near], score[near]
                todo = todo[bound[todo] >= float(kth)]
            run *= 8
        best = np.lexsort((rank_of[at], -score.astype(np.float64) if kind is object else -score))[:k]
        out_q.append(np.full(len(best), i))
        out_c.append(at[best])
        out_s.append(np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score[best]], dtype=np.int64) if kind is object else score[best].astype(np.int64))
    return tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in (out_q, out_c, out_s))  # type: ignore[return-value]


def deal_cells(cells: dict[int, int], block: int) -> tuple[dict[int, int], dict[int, int], int]:
    """(first block of each cell, its number of blocks, all blocks): a cell over ``block`` rows has several, which its rows
    are dealt to by hash; smaller ones share a block while they fit, as each block costs every group of queries."""
    first, blocks, n_blocks, room = {}, {}, 0, 0
    for cell, n in sorted(cells.items()):
        if n > room:
            blocks[cell] = -(-n // block)
            first[cell], n_blocks = n_blocks, n_blocks + blocks[cell]
            room = block - n if n <= block else 0
        else:
            first[cell], blocks[cell] = n_blocks - 1, 1
            room -= n
    return first, blocks, n_blocks


def block_ranges(dealt: DataFrame, pivots: int) -> dict[str, np.ndarray]:
    """cb, low and high (distances to each pivot) and norm2 (largest) of each block."""
    ends = [f(F.get("dist", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(pivots)]
    found = dealt.groupBy("cb").agg(F.max("norm2").alias("norm2"), *ends).toArrow()
    columns = {n: np.stack([found[f"{n}{i}"].to_numpy() for i in range(pivots)], axis=1) if pivots else np.zeros((found.num_rows, 0)) for n in ("low", "high")}
    return columns | {"cb": found["cb"].to_numpy(), "norm2": found["norm2"].to_numpy()}


def blocks_to_meet(dist: np.ndarray, norm2: float, floor: float, own: int, ranges: dict[str, np.ndarray]) -> np.ndarray:
    """The blocks, other than its own, in which a query's floor can be reached."""
    d = dist.astype(np.float64)
    apart = np.maximum(np.maximum(ranges["low"] - d, d - ranges["high"]).max(axis=1, initial=0), 0)
    bound = (norm2 + ranges["norm2"]) / 2 + slack_of(np.array([norm2]), ranges["norm2"]) - apart**2 / 2
    return ranges["cb"][(bound >= floor) & (ranges["cb"] != own)]


def search(df: DataFrame, k: int = 20, every: int = 20, pivots: int = 32, block: int = 8192, together: int = 2, most_ranges: int = 1 << 16) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the k best others.

    Ties go to the smaller vec_id. Rows that repeat an id are queries and candidates of their own. A null id is a
    candidate only. A score beyond a long is the nearest long. An empty table gives no rows; other columns take no
    part. Up to ``most_ranges`` blocks their ranges reach every task; beyond, queries go to all blocks.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = integer_vectors(df)
    # a bounded sample serves to choose the pivots only
    sample = vectors.orderBy(F.xxhash64("vec_id", "ints"), "vec_id").limit(512).select("ints").toArrow()
    chosen = choose_pivots(matrix(sample["ints"]) if sample.num_rows else np.empty((0, 0)), pivots)
    table = scratch.table(pivot_table(vectors, chosen), "pivots")
    is_query = (F.col("vec_id") % every == 0) & (F.col("vec_id") != _LAST)

    # a row for each pivot
    cells = {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, blocks, n_blocks = deal_cells(cells, block)
    at = lambda of: F.element_at(F.create_map(*[F.lit(x) for c, v in of.items() for x in (c, v)]), F.col("cell")) if of else F.lit(0)
    dealt = table.withColumn("cb", (at(first) + F.pmod(F.xxhash64("row"), at(blocks))).cast("int")).withColumn("asks", is_query)
    dealt = scratch.table(dealt, "dealt", keep=True)
    ranges = block_ranges(dealt, len(chosen)) if n_blocks <= most_ranges else None

    def found_in(rows: pa.Table, asks: np.ndarray, offers: np.ndarray, floor: np.ndarray) -> pa.Table:
        width = int(np.diff(rows["ints"].combine_chunks().offsets.to_numpy()).max(initial=0))
        all_of = {"ints": matrix(rows["ints"], width), "dist": matrix(rows["dist"]), "floor": floor} | {c: rows[c].to_numpy() for c in ("row", "vec_id", "norm2")}
        q, c = ({name: v[side] for name, v in all_of.items()} for side in (asks, offers))
        i, j, s = block_topk(q, c, k)
        return pa.table({"query_row": q["row"][i], "query_id": q["vec_id"][i], "vec_id": c["vec_id"][j], "score": s})

    def at_home(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        return found_in(rows, rows["asks"].to_numpy(), np.ones(n, dtype=bool), np.full(n, -np.inf))

    home = scratch.table(dealt.groupBy("cb").applyInArrow(at_home, FOUND), "home", keep=True)
    floors = home.groupBy("query_row").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least"))
    floors = floors.select("query_row", F.when(F.col("_n") >= k, F.col("_least")).alias("least"))
    asked = dealt.filter("asks").join(floors, F.col("row") == F.col("query_row"), "left").select("row", "vec_id", "ints", "dist", "norm2", F.col("cb").alias("home"), F.col("least").cast("double").alias("floor"))

    def send(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("dist", "norm2", "floor", "home")]
            to = []
            for dist, norm2, floor, own in zip(*columns, strict=True):
                least = -np.inf if floor is None else floor
                to.append(blocks_to_meet(np.array(dist), norm2, least, own, ranges) if ranges is not None else np.array([b for b in range(n_blocks) if b != own]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int32()))], [*batch.schema.names, "to"])

    kinds = "row long, vec_id long, ints array<long>, dist array<float>, norm2 double, home int, floor double"
    asked = scratch.table(asked.mapInArrow(send, f"{kinds}, to array<int>"), "asked", keep=True)
    shared = ["row", "vec_id", "ints", "dist", "norm2", "floor", "asks", "qb", "cb"]
    sent = asked.withColumns({"cb": F.explode("to"), "qb": F.floor(F.col("home") / together).cast("int"), "asks": F.lit(True)}).select(*shared)
    # a block goes only to the groups of queries that some query of theirs meets it in
    meetings = scratch.table(sent.select("qb", "cb").distinct(), "meetings", keep=True)
    offered = dealt.drop("asks").join(meetings, "cb").withColumns({"asks": F.lit(False), "floor": F.lit(None).cast("double")}).select(*shared)

    def abroad(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy()
        return found_in(rows, asks, ~asks, np.nan_to_num(rows["floor"].to_numpy().astype(np.float64), nan=-np.inf))

    met = home.unionByName(sent.unionByName(offered).groupBy("qb", "cb").applyInArrow(abroad, FOUND))
    order = Window.partitionBy("query_row", "query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    scratch.drop("pivots")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif(F.col("vec_id"), F.lit(_LAST)).alias("vec_id"), "score")
