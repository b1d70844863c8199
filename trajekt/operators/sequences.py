"""I: monotone alignment of a recording's segments to a specification's movements, in blocks that meet in an associative scan.

A row of the cumulative cost table follows from the row before by a min-plus linear map, so the rows of a block together are one
small matrix, and matrices combine in any grouping. Sums are whole numbers of UNIT: grouping then changes no bit of them and no tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

UNIT = 1e-9
#: No way there: above every sum of costs, with room to add two of them.
FAR = 1 << 60
BLOCK_SEGMENTS, FAN = 1024, 128


def whole(costs) -> np.ndarray:
    """Costs in units; missing, NaN and infinite ones are FAR."""
    raw = np.asarray(costs, np.float64)
    return np.where(np.isfinite(raw), np.rint(np.where(np.isfinite(raw), raw, 0.0) / UNIT), FAR).astype(np.int64)


def first_row(movements: int, penalty: int | None) -> np.ndarray:
    """The table's row before any segment: movements can only be skipped."""
    return np.arange(movements + 1, dtype=np.int64) * penalty if penalty is not None else np.concatenate(([0], np.full(movements, FAR)))


def table_rows(state: np.ndarray, costs: np.ndarray, penalty: int | None) -> Iterator[np.ndarray]:
    """The row after each segment. `state` may hold several start rows at once, one in each of its rows."""
    for cost in costs:
        pass_on = cost if penalty is None else np.minimum(cost, penalty)
        row = np.full_like(state, FAR)
        base = np.minimum(state[..., 1:], state[..., :-1]) + cost
        if pass_on.max(initial=0) < FAR:
            # a run to the left adds what lies between: a running minimum after taking the prefix sums off
            ahead = np.cumsum(pass_on)
            row[..., 1:] = np.minimum.accumulate(base - ahead, axis=-1) + ahead
        else:
            for j in range(1, base.shape[-1]):
                base[..., j] = np.minimum(base[..., j], base[..., j - 1] + pass_on[j])
            row[..., 1:] = base
        state = np.minimum(row, FAR)
        yield state


def transfer(costs: np.ndarray, penalty: int | None) -> np.ndarray:
    """Min-plus matrix of a block: row k is the row after it if only column k was reached before, at no cost."""
    start = np.where(np.eye(costs.shape[1] + 1, dtype=bool), 0, FAR)
    for start in table_rows(start, costs, penalty):
        pass
    return start


def through(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """`state` (or each row of several) after a block with that matrix."""
    return np.minimum((state[..., :, None] + matrix).min(axis=-2), FAR)


class Walk:
    """Where the way back leads from each cell of a block, whose first row came after the row `before`.

    A skip is taken only where it is strictly cheaper; ties prefer the diagonal, then the segment before, then the movement before. The way
    ends at column 0.
    """

    def __init__(self, before: np.ndarray, costs: np.ndarray, penalty: int | None):
        rows = np.stack([before, *table_rows(before, costs, penalty)])
        self.last = rows[-1]
        up, diagonal, left = rows[:-1, 1:], rows[:-1, :-1], rows[1:, :-1]
        match = np.minimum(np.minimum(np.minimum(up, diagonal), left) + costs, FAR)
        self.skip = np.zeros(rows[1:].shape, bool)
        if penalty is not None:
            self.skip[:, 1:] = np.minimum(left + penalty, FAR) < match
        best = np.minimum(np.minimum(up, diagonal), left)
        #: the column at which a way that enters a row at j leaves it upwards, and the column it has in the row above
        self.leave, self.land = np.zeros(rows[1:].shape, np.int64), np.zeros(rows[1:].shape, np.int64)
        for j in range(1, rows.shape[1]):
            stays = self.skip[:, j] | ((diagonal[:, j - 1] != best[:, j - 1]) & (up[:, j - 1] != best[:, j - 1]))
            self.leave[:, j] = np.where(stays, self.leave[:, j - 1], j)
            self.land[:, j] = np.where(stays, self.land[:, j - 1], np.where(diagonal[:, j - 1] == best[:, j - 1], j - 1, j))

    def back(self) -> np.ndarray:
        """Column in the row before the block for each column at its end."""
        at = np.arange(self.land.shape[1])
        for row in self.land[::-1]:
            at = row[at]
        return at

    def cells(self, at: int) -> tuple[list[tuple[int, int]], list[int], int]:
        """(segment of the block, movement) pairs and skipped movements of the way back from column `at`, and where it comes out."""
        pairs, skipped = [], []
        for i in range(len(self.land) - 1, -1, -1):
            if at == 0:
                break
            for j in range(at, max(int(self.leave[i, at]), 1) - 1, -1):
                skipped.append(j - 1) if self.skip[i, j] else pairs.append((i, j - 1))
            at = int(self.land[i, at])
        return pairs[::-1], skipped[::-1], at


def _nothing(names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object) for c in names})


def scan(maps: DataFrame, keys: Sequence[str], compose: Callable[[np.ndarray, np.ndarray], np.ndarray], apply: Callable[[np.ndarray, np.ndarray], np.ndarray], start: list[int], fan: int = FAN) -> DataFrame:
    """(keys, blk, state): the state after block blk, from `maps` (keys, blk, map) with blk = 0, 1, 2, ... within the keys.

    Groups of `fan` maps become one, level by level, and states come back down, so no task holds more than `fan` maps and their state, however
    many blocks a key has. compose(a, b) is a followed by b; apply(state, map) the state after it. Arrays travel flat.
    """
    keys = list(keys)
    kinds = dict(maps.dtypes)
    own = ", ".join(f"{k} {kinds[k]}" for k in keys)
    most = maps.agg(F.max("blk")).first()[0] or 0
    grouped = maps.withColumn("grp", F.floor(F.col("blk") / fan).cast("long"))

    def states(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        rows, out = rows.sort_values("blk"), []
        for m in rows["map"]:
            state = apply(state, np.asarray(m, np.int64))
            out.append(state.ravel())
        return rows[[*keys, "blk"]].assign(state=out)

    schema = f"{own}, blk long, state array<long>"
    if most < fan:
        return grouped.groupBy(*keys).applyInPandas(lambda rows: states(rows, np.asarray(start, np.int64)), schema)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = [np.asarray(m, np.int64) for m in rows.sort_values("blk")["map"]]
        out = ordered[0]
        for m in ordered[1:]:
            out = compose(out, m)
        return rows[[*keys, "grp"]].head(1).rename(columns={"grp": "blk"}).assign(map=[out.ravel()])

    upper = materialise(grouped.groupBy(*keys, "grp").applyInPandas(joined, f"{own}, blk long, map array<long>"), "scan")
    above = scan(upper, keys, compose, apply, start, fan).withColumn("grp", F.col("blk") + 1).drop("blk")

    def down(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return _nothing([*keys, "blk", "state"])
        return states(rows, np.asarray(before["state"].iloc[0] if len(before) else start, np.int64))

    return grouped.groupBy(*keys, "grp").cogroup(above.groupBy(*keys, "grp")).applyInPandas(down, schema)


def _square(flat: np.ndarray) -> np.ndarray:
    width = int(len(flat) ** 0.5 + 0.5)
    return flat.reshape(width, width)


def align_segments(costs: DataFrame, session: str, ordinal: str, penalty: str | None = None, block: int = BLOCK_SEGMENTS, fan: int = FAN) -> DataFrame:
    """Cheapest monotone alignment: rows (session, segment, movement, cost, total_cost); a skipped movement has no segment and no cost.

    `costs` has one row for each segment, numbered 0, 1, 2, ... by `ordinal` within its session, with an array of costs, one for each movement
    of the session's specification (null, NaN, infinite: the pair has nothing to compare), and a skip penalty for the session if movements may be
    skipped. Every movement and segment lies on the way; with skips a movement may be left out where that is strictly cheaper.

    Recordings of one block are solved as they are. Of longer ones each block gives its transfer matrix, a scan the row before each block, each
    block its map of columns backwards, a scan from the end the column at which the way leaves it, and then its own part of the way.
    """
    kinds = dict(costs.dtypes)
    columns = [session, ordinal, "costs", *([penalty] if penalty else [])]
    sizes = costs.groupBy(session).agg((F.max(ordinal) + 1).alias("n"))
    rows = costs.select(*columns, F.floor(F.col(ordinal) / block).cast("long").alias("blk")).join(sizes, session)
    rows = materialise(rows.withColumn("final", F.floor((F.col("n") - 1) / block).cast("long")), "costs")
    own = f"{session} {kinds[session]}"

    def block_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int | None, int, bool]:
        pdf = pdf.sort_values(ordinal)
        limit = int(whole(pdf[penalty].iloc[0])) if penalty else None
        return pdf, np.stack([whole([np.nan if v is None else v for v in c]) for c in pdf["costs"]]), limit, int(pdf["blk"].iloc[0]), bool(pdf["blk"].iloc[0] == pdf["final"].iloc[0])

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, table, limit, blk, _ = block_of(pdf)
        out = transfer(table, limit)
        if blk == 0:
            # whatever the scan starts from, the row after the first block is that after the table's first row
            out = np.broadcast_to(through(first_row(table.shape[1], limit), out), out.shape)
        return pd.DataFrame({session: [pdf[session].iloc[0]], "blk": [blk], "map": [np.ascontiguousarray(out).ravel()]})

    def walk_of(pdf: pd.DataFrame, before: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int | None, bool, Walk]:
        pdf, table, limit, blk, final = block_of(pdf)
        row = before["state"].iloc[0] if len(before) else None
        row = first_row(table.shape[1], limit) if row is None else np.asarray(row, np.int64)
        return pdf, table, limit, final, Walk(row, table, limit)

    def backward(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return _nothing([session, "blk", "map"])
        pdf, table, _, final, walk = walk_of(pdf, before)
        back = walk.back()
        if final:
            back = np.full_like(back, back[table.shape[1]])
        return pd.DataFrame({session: [pdf[session].iloc[0]], "blk": [int(pdf["final"].iloc[0] - pdf["blk"].iloc[0])], "map": [back]})

    schema = f"{own}, segment bigint, movement int, cost double, total_cost double"
    names = [session, "segment", "movement", "cost", "total_cost"]

    def way(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return _nothing(names)
        pdf, table, limit, final, walk = walk_of(pdf, before)
        here = before["at"].iloc[0] if len(before) else np.nan
        exit_at = table.shape[1] if final or here is None or here != here else int(here)
        pairs, skipped, out = walk.cells(exit_at)
        if pdf["blk"].iloc[0] == 0 and limit is not None:
            skipped = [*range(out), *skipped]
        order, raw, who = pdf[ordinal].to_numpy(), pdf["costs"].to_list(), pdf[session].iloc[0]
        total = float(walk.last[-1]) * UNIT if walk.last[-1] < FAR else float("inf")
        found = [(who, int(order[i]), j, raw[i][j]) for i, j in pairs] + [(who, None, j, None) for j in skipped]
        out = pd.DataFrame(found, columns=names[:4]).assign(total_cost=total if final else np.nan)
        # a block without a pair still hands over the total, if it is the last
        if final and out.empty:
            out = pd.DataFrame([(who, None, None, None, total)], columns=names)
        return out.astype({"segment": "Int64", "movement": "Int32", "cost": "float64"})

    long = rows.where("final > 0")
    if long.isEmpty():
        found = rows.groupBy(session, "blk").applyInPandas(lambda pdf: way(pdf, pdf.head(0)), schema)
        return found.where("movement is not null")
    matrices = materialise(long.where("blk < final").groupBy(session, "blk").applyInPandas(matrix, f"{own}, blk long, map array<long>"), "matrices")
    entries = scan(matrices, [session], lambda a, b: through(_square(a), _square(b)).ravel(), lambda s, m: through(s, _square(m)) if len(s) > 1 else _square(m)[0], [0], fan)
    entries = materialise(entries.select(session, (F.col("blk") + 1).alias("blk"), "state"), "entries")
    backs = materialise(long.where("blk > 0").groupBy(session, "blk").cogroup(entries.groupBy(session, "blk")).applyInPandas(backward, f"{own}, blk long, map array<long>"), "backs")
    exits = scan(backs, [session], lambda a, b: b[a], lambda s, m: m[s], [0], fan)
    finals = long.select(session, "final").distinct()
    exits = exits.join(finals, session).select(session, (F.col("final") - F.col("blk") - 1).alias("blk"), F.col("state")[0].alias("at"))
    known = entries.join(exits, [session, "blk"], "full")
    found = materialise(rows.groupBy(session, "blk").cogroup(known.groupBy(session, "blk")).applyInPandas(way, schema), "way")
    totals = found.groupBy(session).agg(F.max("total_cost").alias("total_cost"))
    return found.where("movement is not null").drop("total_cost").join(totals, session).select(*names)
