"""Rank correlations of pairs of columns over all rows, whatever their number.

A pair's ranks are among the rows where both its columns have a value. Each
column is sorted once for all its pairs, as an outer sort is made: a task sorts
the columns of a block of rows and writes them as runs; runs are cut at the
bounds of ranges, and a range is ranked in one task; ranks go back to their
block, where they meet. What moves is a piece of a run in a row, with a byte or
two a number, for rows of values by themselves take up several times as much disk.

Ranges come from a sample and decide only which task ranks a value: how many
rows lie below a range is counted from all runs. A value that fills ranges of
its own has one rank, which follows from the counts; its rows needn't meet.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import SEGMENT_ROWS
from .scratch import materialize

#: Ranks of a block, and of a range, about: a row of a block has two for each pair, a value of a range one for each column of the other side.
BLOCK_RANKS, RANGE_RANKS = 2**22, 2**20
#: Up to this size, settled values are counted in units of their tenth digit.
NEAR = 2.0**50 / 1e10

RUN = pa.schema([("_k", pa.int32()), ("_block", pa.int64()), ("_n", pa.int32()), ("_first", pa.int64()), ("_steps", pa.binary()), ("_at", pa.binary()), ("_marks", pa.binary()), ("_points", pa.list_(pa.int64()))])
COUNT = pa.schema([("_k", pa.int32()), ("_m", pa.int32()), ("_j", pa.int32()), ("_n", pa.int64())])
PIECE = pa.schema([("_k", pa.int32()), ("_m", pa.int32()), ("_part", pa.int32()), ("_block", pa.int64()), ("_n", pa.int32()), ("_first", pa.int64()), ("_steps", pa.binary()), ("_at", pa.binary()), ("_marks", pa.binary())])
RANKED = pa.schema([("_block", pa.int64()), ("_k", pa.int32()), ("_n", pa.int32()), ("_at", pa.binary()), ("_first", pa.list_(pa.int64())), ("_steps", pa.binary())])
SUM = pa.schema([("_i", pa.int32()), ("_j", pa.int32()), ("_n", pa.int64()), ("_ab", pa.float64()), ("_aa", pa.float64()), ("_bb", pa.float64())])


def narrow(a: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()))).tobytes()


def wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"u{len(b) // n}").astype(np.int64)


def steps(a: np.ndarray) -> np.ndarray:
    """A rising row's (or rows') differences, 0 first."""
    return np.diff(a, prepend=a[..., :1])


def whole(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of settled values, equal where these are: units of the tenth digit, for large values the bits of the double. NaN is highest."""
    far = ~(np.abs(v) < NEAR)
    out = np.rint(np.where(far, 0.0, v) * 1e10).astype(np.int64)
    size = np.where(np.isnan(v[far]), np.nan, np.abs(v[far]))
    bits = size.view(np.int64) - np.float64(NEAR).view(np.int64) + 2**50 + 1
    out[far] = np.where(v[far] < 0, -bits, bits)
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _marks(b: bytes, n: int) -> np.ndarray:
    """A row of 0 and 1 for each column of the other side: whether the value's row has it."""
    return np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, -(-n // 8)), axis=1, count=n)


def _values(r: dict) -> np.ndarray:
    return r["_first"] + np.cumsum(wide(r["_steps"], r["_n"]))


def _opened(batches) -> Iterator[dict]:
    """Rows of runs, unpacked from their store."""
    for batch in batches:
        for r in batch.to_pylist():
            yield r | {c: zlib.decompress(r[c]) for c in ("_steps", "_at", "_marks") if c in r}


def sorted_runs(data: DataFrame, xs: list[str], ys: list[str], step: int) -> DataFrame:
    """A row for each block and column: its values that have a partner, sorted; their places in the block; and each step-th value."""
    columns = [*xs, *ys]
    sides = [range(len(xs)), range(len(xs), len(columns))]
    most = BLOCK_RANKS // (2 * len(xs) * len(ys))

    def block(batches: list, number: int) -> pa.Table:
        table, rows = pa.Table.from_batches(batches), []
        held = [pc.is_valid(table[c].combine_chunks()).to_numpy(zero_copy_only=False) for c in columns]
        for k, c in enumerate(columns):
            others = np.array([held[o] for o in sides[k < len(xs)]])
            at = np.flatnonzero(held[k] & others.any(axis=0))
            if len(at):
                v = whole(table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float)[at])
                order = np.argsort(v, kind="stable")
                v, at = v[order], at[order]
                start = int(np.random.default_rng([number, k]).integers(step))
                packed = [zlib.compress(b, 1) for b in (narrow(steps(v)), narrow(at), np.packbits(others[:, at], axis=1).tobytes())]
                rows.append((k, number, len(v), v[0], *packed, v[start::step]))
        return _table(rows, RUN)

    def run(batches):
        # the runs are written by one stage, where these numbers are a task's own
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if n + batch.num_rows > most and n:
                yield from block(held, number).to_batches()
                number, held, n = number + 1, [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from block(held, number).to_batches()

    return materialize(data.select(*columns).mapInArrow(run, _ddl(RUN)), "runs")


def range_edges(runs: DataFrame, columns: int, rows: int) -> list[np.ndarray]:
    """For each column the values at which ranges of about `rows` rows begin; a value that fills a range is one by itself."""
    most = runs.groupBy("_k").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = math.ceil(most / rows)
    edges = [np.zeros(0, np.int64)] * columns
    if parts > 1:
        shares = [p / parts for p in range(1, parts)]
        for k, found in runs.select("_k", F.explode("_points").alias("v")).groupBy("_k").agg(F.percentile_approx("v", shares, max(10_000, 50 * parts))).collect():
            some, times = np.unique(np.array(found, np.int64), return_counts=True)
            edges[k] = np.unique(np.r_[some, some[times > 1] + 1])
    return edges


def rank_correlations(data: DataFrame, xs: list[str], ys: list[str], rows: int = SEGMENT_ROWS) -> DataFrame:
    """i, j, n and corr: Spearman's correlation of the i-th of xs and the j-th of ys over the n rows that have both; null for a constant side, no row without a pair.

    The columns are settled doubles. A range holds about `rows` rows.
    """
    rows = min(rows, max(1, RANGE_RANKS // max(len(xs), len(ys))))
    runs = sorted_runs(data, xs, ys, max(1, rows // 256))
    edges = range_edges(runs, len(xs) + len(ys), rows)

    def cuts(v: np.ndarray, k: int) -> np.ndarray:
        return np.r_[0, np.searchsorted(v, edges[k]), len(v)]

    def count(batches):
        total: dict = {}
        for r in _opened(batches):
            upto = np.cumsum(np.pad(_marks(r["_marks"], r["_n"]), ((0, 0), (1, 0))), axis=1, dtype=np.int64)
            total[r["_k"]] = total.get(r["_k"], 0) + np.diff(upto[:, cuts(_values(r), r["_k"])], axis=1)
        yield from _table([(k, m, j, n) for k, t in total.items() for j, line in enumerate(t) for m, n in enumerate(line)], COUNT).to_batches()

    # rows of each range, for each column of the other side: a few numbers a range
    total = [np.zeros((len(ys) if k < len(xs) else len(xs), len(e) + 1), np.int64) for k, e in enumerate(edges)]
    counted = runs.select("_k", "_n", "_first", "_steps", "_marks").mapInArrow(count, _ddl(COUNT))
    for k, m, j, n in counted.groupBy("_k", "_m", "_j").agg(F.sum("_n")).collect():
        total[k][j, m] = n
    below = [np.cumsum(t, axis=1) - t for t in total]

    def one_value(k: int, m: int) -> bool:
        return 0 < m < len(edges[k]) and edges[k][m] - edges[k][m - 1] == 1

    def cut(batches):
        for r in _opened(batches):
            k, n, out = r["_k"], r["_n"], []
            v, at, marks = _values(r), wide(r["_at"], n), _marks(r["_marks"], n)
            ends = cuts(v, k)
            for m in np.flatnonzero(np.diff(ends)).tolist():
                here = slice(ends[m], ends[m + 1])
                parts = math.ceil(total[k][:, m].max() / rows) if one_value(k, m) else 1
                part = (r["_block"] + (r["_block"] >> 32)) % parts
                out.append((k, m, part, r["_block"], ends[m + 1] - ends[m], v[here][0], narrow(steps(v[here])), narrow(at[here]), np.packbits(marks[:, here], axis=1).tobytes()))
            yield from _table(out, PIECE).to_batches()

    def rank(table: pa.Table) -> pa.Table:
        pieces = table.to_pylist()
        k, m = pieces[0]["_k"], pieces[0]["_m"]
        ends = np.cumsum([0, *[p["_n"] for p in pieces]])
        # twice the ranks: whole numbers, that rise along each piece
        if one_value(k, m):
            twice = np.repeat((2 * below[k][:, m] + total[k][:, m] + 1)[:, None], ends[-1], axis=1)
        else:
            v = np.concatenate([_values(p) for p in pieces])
            order = np.argsort(v, kind="stable")
            new = np.diff(v[order], prepend=v[order[0]] - 1) > 0
            held = np.add.reduceat(np.concatenate([_marks(p["_marks"], p["_n"]) for p in pieces], axis=1)[:, order].astype(np.int64), np.flatnonzero(new), axis=1)
            twice = np.empty((len(held), len(v)), np.int64)
            twice[:, order] = (2 * (below[k][:, m, None] + np.cumsum(held, axis=1) - held) + held + 1)[:, np.cumsum(new) - 1]
        lines = [twice[:, a:b] for a, b in zip(ends, ends[1:])]
        return _table([(p["_block"], k, p["_n"], p["_at"], t[:, 0], narrow(steps(t))) for p, t in zip(pieces, lines)], RANKED)

    def meet(table: pa.Table) -> pa.Table:
        pieces = [p | {"_at": wide(p["_at"], p["_n"])} for p in table.to_pylist()]
        size = 1 + max(int(p["_at"].max()) for p in pieces)
        # 0 where the row has no value
        twice = [np.zeros((len(t), size), np.int64) for t in total]
        for p in pieces:
            first = np.array(p["_first"])[:, None]
            twice[p["_k"]][:, p["_at"]] = first + np.cumsum(wide(p["_steps"], first.size * p["_n"]).reshape(first.size, -1), axis=1)
        out = []
        for i in range(len(xs)):
            for j in range(len(ys)):
                a, b = twice[i][j], twice[len(xs) + j][i]
                both = (a > 0) & (b > 0)
                # ranks less their mean, (n + 1) / 2
                a, b = ((x[both] - (int(total[i][j].sum()) + 1)) / 2 for x in (a, b))
                if len(a):
                    out.append((i, j, len(a), a @ b, a @ a, b @ b))
        return _table(out, SUM)

    pieces = runs.select("_k", "_block", "_n", "_first", "_steps", "_at", "_marks").mapInArrow(cut, _ddl(PIECE))
    ranked = pieces.groupBy("_k", "_m", "_part").applyInArrow(rank, _ddl(RANKED))
    sums = ranked.groupBy("_block").applyInArrow(meet, _ddl(SUM)).groupBy("_i", "_j").agg(*[F.sum(c).alias(c) for c in ("_n", "_ab", "_aa", "_bb")])
    return sums.select(F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("_n").alias("n"), F.try_divide("_ab", F.sqrt("_aa") * F.sqrt("_bb")).alias("corr"))
