"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists, for blocks of queries.

Candidates are put in order of their components' signs and cut into blocks of
bounded size. A block is one row: its vectors and, for each dimension, the list
of its rows by their component, sorted once. A block's lists are read from their
ends, for each dimension from the end or ends that the queries' signs ask for;
what comes up is scored whole for all queries that go on, and a query stops when
its k-th score is above the bound: its product with the components that the
lists have come to, which no row still unread can exceed. Each query is searched
in the block that it stands in first; the k-th score from there is what it
starts with in all others, so that it passes by whole blocks that cannot beat it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, map_arrow, small_batches, written

CANDIDATES, QUERIES = 16_384, 512
#: How far each list is read at first; each turn reads twice as far.
FIRST = 64
NONE = np.iinfo(np.int64).min
#: Components up to which products of two, summed over a vector of up to 512, are exact as floats.
SMALL = 1 << 22


def sorted_lists(rows: np.ndarray) -> np.ndarray:
    """The rows' places by each component, rising, equal ones by place."""
    return np.argsort(rows, axis=0, kind="stable")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of whole vectors. By floats where those are exact, by longs where they cannot overflow, else by numbers of any size; OverflowError if a product does not fit a long."""
    big = lambda a: int(np.abs(a.astype(object)).max(initial=0)) if (a == NONE).any() else int(np.abs(a).max(initial=0))
    high, width = big(q) * big(x) * max(1, q.shape[1]), q.shape[1]
    if high < 1 << 52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if high < 1 << 62:
        return q @ x.T
    fits = lambda a: ((a < SMALL) & (a > -SMALL)).all(axis=1) & (width <= 512)
    small_q, small_x = fits(q), fits(x)
    out = np.zeros((len(q), len(x)), np.int64)
    out[np.ix_(small_q, small_x)] = products(q[small_q], x[small_x])
    for a, b in ((small_q, ~small_x), (~small_q, small_x), (~small_q, ~small_x)):
        exact = q[a].astype(object) @ x[b].astype(object).T
        if exact.size and (exact.max() > np.iinfo(np.int64).max or exact.min() < NONE):
            raise OverflowError("a score does not fit a long")
        out[np.ix_(a, b)] = exact.astype(np.int64)
    return out


def threshold_topk(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, first: int = FIRST, lists: np.ndarray | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, places, rows scored) of each query's k best rows, by score and then by place; place -1 where there are fewer.

    ``own`` holds, for each query, the first of the places that it must not find
    and the one behind the last. ``floor`` is a score that k rows elsewhere have:
    rows below it need not be found, and the search may end without them.
    """
    n, _ = rows.shape
    lists = sorted_lists(rows) if lists is None else lists
    floor = np.full(len(queries), NONE) if floor is None else floor
    best, place = np.full((len(queries), k), NONE), np.full((len(queries), k), n, np.int64)
    unread, at, to, scored = np.ones(n, bool), 0, 0, 0
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    active = np.arange(len(queries)) if n else np.zeros(0, np.int64)
    while True:
        # before anything is read, the bound is of the lists' very ends
        low, top = (rows[lists[i], np.arange(rows.shape[1])].astype(np.float64) for i in (max(0, to - 1), min(n - 1, n - max(1, to)))) if n else (0, 0)
        if len(active) and to < n:
            bound = up[active] @ top + down[active] @ low
            bound += (up[active] @ np.abs(top) - down[active] @ np.abs(low)) * 2.0**-40  # for what floats round off
            active = active[np.maximum(best[active, -1], floor[active]) <= bound]
        if not len(active) or to >= n:
            return best, np.where(place == n, -1, place), scored
        at, to = to, min(n, max(first, 2 * to))
        rise, fall = (queries[active] > 0).any(axis=0), (queries[active] < 0).any(axis=0)
        ends = [lists[n - to : n - at][:, rise].ravel(), lists[at:to][:, fall].ravel()]
        if to >= n or not (rise.any() or fall.any()):
            ends, to = [np.arange(n)], n
        come = np.unique(np.concatenate(ends))
        come = come[unread[come]]
        unread[come] = False
        scored += len(come) * len(active)
        if not len(come):
            continue
        score = products(queries[active], rows[come])
        taken = np.broadcast_to(come, score.shape)
        score = np.where((taken >= own[active, :1]) & (taken < own[active, 1:]), NONE, score)
        if len(come) > 4 * k:  # those below the k-th of the new ones are out; its equals stay, as the place decides
            kth = np.partition(score, len(come) - k, axis=1)[:, len(come) - k]
            keep = score >= np.maximum(np.maximum(kth, best[active, -1]), floor[active])[:, None]
            pick = picked(keep, max(1, int(keep.sum(axis=1).max(initial=0))))
            score = np.where(pick >= 0, np.take_along_axis(score, np.maximum(pick, 0), 1), NONE)
            taken = come[np.maximum(pick, 0)]
        score, taken = np.hstack([best[active], score]), np.hstack([place[active], np.where(score == NONE, n, taken)])
        order = np.lexsort((taken, ~score), axis=1)[:, :k]
        best[active], place[active] = np.take_along_axis(score, order, 1), np.take_along_axis(taken, order, 1)


def picked(keep: np.ndarray, most: int) -> np.ndarray:
    """The column of each kept cell, row by row, filled with -1."""
    row, column = np.nonzero(keep)
    counts = np.bincount(row, minlength=len(keep))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.full((len(keep), most), -1, np.int64)
    out[row, rank] = column
    return out


# The letters of whole numbers of 2, 4 and 8 bytes, which a packed vector starts with.
KINDS = {b"h": "<i2", b"i": "<i4", b"q": "<i8"}


def packed_vector(v: np.ndarray) -> bytes:
    """Whole numbers in the least of KINDS that holds them all, so that equal vectors are equal bytes."""
    low, high = v.min(initial=0), v.max(initial=0)
    kind = next(k for k, t in KINDS.items() if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return kind + v.astype(KINDS[kind]).tobytes()


def unpacked(vectors: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors side by side; shorter ones are filled with zeros."""
    read = [np.frombuffer(v, KINDS[v[:1]], offset=1) for v in vectors]
    out = np.zeros((len(read), max((len(v) for v in read), default=0) if width is None else width), np.int64)
    for row, v in zip(out, read):
        row[: len(v)] = v
    return out


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, vec: floor(scale * component), packed; signs: a bit for each of the first 62 that is above zero. Rows with a null id, and vectors that are null or hold null or non-finite components, are left out; an empty vector is one of zeros. OverflowError if a component does not fit a long."""

    def start():
        def run(batch):
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            values = np.full(len(flat), np.nan) if flat.type == pa.null() else flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            finite = np.isfinite(values)
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~finite)])
            whole = np.floor(np.where(finite, values, 0) * scale)
            ids, out, signs = [], [], []
            for key, real, a, b in zip(batch.column(0).to_pylist(), lists.is_valid().to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                if key is not None and real and bad[a] == bad[b]:
                    if (np.abs(whole[a:b]) >= 2.0**63).any():
                        raise OverflowError("a component does not fit a long")
                    own = whole[a:b].astype(np.int64)
                    ids.append(key)
                    out.append(packed_vector(own))
                    signs.append(int((own[:62] > 0) @ (1 << np.arange(len(own[:62])))))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(signs, pa.int64())], ["id", "vec", "signs"])

        return run

    vectors = rows.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return map_arrow(vectors, start, "id long, vec binary, signs long")


def own_places(ids: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where the rows of each query's id stand among the rising ids."""
    return np.stack([np.searchsorted(ids, asked), np.searchsorted(ids, asked, side="right")], axis=1)


PARTS = "kind string, block long, id long, vec binary, ids binary, width int, lists binary, floor long, found array<struct<vec_id: long, score: long>>"


def blocks_of(stream: DataFrame, k: int, candidates: int) -> DataFrame:
    """The rows of ``stream`` (id, vec, times: how often it is a candidate, ask) in the order that they come: a row of kind block for about so many candidates, fewer where more than a sixteenth as many ask, with their ids, vectors and lists; and a row of kind query for each asked one, with the k best of its block and the score that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("vec", pa.binary()), ("ids", pa.binary()), ("width", pa.int32()), ("lists", pa.binary()), ("floor", pa.int64()), ("found", pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])))])

        def block(held: list, asked: list) -> pa.RecordBatch:
            number = part << 32 | made
            held.sort(key=lambda r: r[0])
            ids, raw = np.array([r[0] for r in held], np.int64), [r[1] for r in held]
            asked_ids = np.array([r[0] for r in asked], np.int64)
            width = max((len(np.frombuffer(v, KINDS[v[:1]], offset=1)) for v in [*raw, *(r[1] for r in asked)]), default=0)
            rows = unpacked(raw, width)
            lists = sorted_lists(rows)
            score, place, _ = threshold_topk(unpacked([r[1] for r in asked], width), rows, own_places(ids, asked_ids), k, lists=lists)
            out = [{"kind": "query", "block": number, "id": i, "vec": v, "floor": int(s[-1]), "found": [{"vec_id": int(ids[p]), "score": int(x)} for x, p in zip(s, ps) if p >= 0]} for (i, v), s, ps in zip(asked, score, place, strict=True)]
            kind = packed_vector(rows.reshape(-1))
            out.append({"kind": "block", "block": number, "vec": kind, "ids": ids.tobytes(), "width": width, "lists": lists.astype("<u2" if len(ids) <= 1 << 16 else "<u4").tobytes()})
            return pa.RecordBatch.from_pylist(out, schema)

        held, asked = [], []
        for batch in batches:
            for i, v, times, ask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ask:
                    asked.append((i, v))
                held += [(i, v)] * times
                if len(held) >= candidates or len(asked) >= max(1, candidates // 16):
                    yield block(held, asked)
                    held, asked, made = [], [], made + 1
        if held or asked:
            yield block(held, asked)

    small_batches(stream.sparkSession)
    return stream.mapInArrow(run, PARTS)


def searched(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, query, vec_id, score: what queries find in blocks that are not their own."""
    out = [pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query", "vec_id", "score")})]
    for _, b in x.iterrows():
        mine = q[q["block"] != b["block"]]
        ids = np.frombuffer(b["ids"], np.int64)
        if not len(mine) or not len(ids):
            continue
        width, n = int(b["width"]), len(ids)
        rows = unpacked([b["vec"]])[0].reshape(n, width)
        lists = np.frombuffer(b["lists"], "<u2" if n <= 1 << 16 else "<u4").reshape(n, width).astype(np.int64)
        asked = unpacked(list(mine["vec"]))[:, :width]  # what is beyond meets zeros
        asked = np.pad(asked, ((0, 0), (0, width - asked.shape[1])))
        asked_ids = mine["id"].to_numpy()
        score, place, _ = threshold_topk(asked, rows, own_places(ids, asked_ids), k, lists=lists, floor=mine["floor"].to_numpy())
        row, column = np.nonzero(place >= 0)
        out.append(pd.DataFrame({"query_id": asked_ids[row], "query": mine["key"].to_numpy()[row], "vec_id": ids[place[row, column]], "score": score[row, column]}))
    return pd.concat(out)


def top_k(rows: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of each row whose id passes ``is_query`` (a function of the id column).

    All rows but those of the query's id are candidates; equal scores go by
    smaller id. Of rows with equal vectors only those of the k + 1 smallest ids
    can be found, of a row that repeats only k times it, and only those go on,
    cut before the shuffle, so that a common vector is no hot group. A vector
    shorter than another counts as filled with zeros, and an empty one as zeros.
    Rows that repeat are candidates each; a query that repeats is asked once, a
    query id with several vectors once for each. Null ids, and null vectors or
    such with null or non-finite components, take no part; an empty table gives
    no rows. Only row counts reach the driver. A component or a score that does
    not fit a long is an error.
    """
    vectors = written(whole_vectors(rows, id_col, vector_col, scale), "vectors")
    known = vectors.groupBy("vec", "id", "signs").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    cand = known.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_n") <= k + 1).drop("_n")
    asked = known.where(is_query(F.col("id"))).withColumn("times", F.lit(0))
    stream = written(cand.withColumn("ask", F.lit(False)).union(asked.select("vec", "id", "signs", "times", F.lit(True).alias("ask"))), "candidates")
    spread = F.xxhash64("vec", "id")
    dealt = stream.withColumn("spread", spread).repartitionByRange(max(1, math.ceil(stream.count() / candidates)), "signs", "spread").sortWithinPartitions("signs", "spread")
    made = written(blocks_of(dealt.select("id", "vec", "times", "ask"), k, candidates), "blocks", by="kind")
    blocks = made.where(F.col("kind") == "block").select("block", "ids", "vec", "width", "lists")
    asks = made.where(F.col("kind") == "query").select("block", "id", "vec", "floor", F.xxhash64("vec").alias("key"), "found")
    parts, turns = max(1, blocks.count()), max(1, math.ceil(asks.count() / queries))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asks.drop("found").select(F.pmod(F.xxhash64("vec", "id"), F.lit(turns)).cast("int").alias("turn"), every(parts).alias("part"), "block", "id", "vec", "floor", "key")
    right = blocks.select(every(turns).alias("turn"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "block", "ids", "vec", "width", "lists")
    others = left.groupBy("turn", "part").cogroup(right.groupBy("turn", "part")).applyInPandas(lambda q, x: searched(q, x, k), "query_id long, query long, vec_id long, score long")
    same = asks.select(F.col("id").alias("query_id"), F.col("key").alias("query"), F.explode("found").alias("f")).select("query_id", "query", "f.vec_id", "f.score")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    out = others.union(same).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    dropped(vectors, stream)
    return out
