"""Which blocks of a very large group need to be compared at all.

The vectors of a group are dealt to the nearest of some pivots: vectors of the group, a sample by hash, of which each next
pivot is the one farthest from those before. Angles between
vectors obey the triangle inequality, so the angle between a vector of one cell and a vector of another is at least that between
their pivots less both cells' radii, and at most that plus them. Once each block has been compared with itself,
a pair of cells whose smallest possible angle is no better than what every vector in both has already is skipped: no
result changes. A block holds some cells that lie together, or a part of a large one; two blocks are compared if any two of their cells
must be.

Tasks hold one slice of a group and its pivots, or the pivots alone; both are bounded by the block size and the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmine.functions.vectors import NORM_FLOOR
from pairmine.session import materialise

# Cells for each block, and vectors that each pivot is picked from.
FINER, SAMPLE = 32, 4
# Beyond so many pivots cells are only cut into more blocks.
_PIVOTS = 1024
# Added to bounds on angles: the arc cosine of a cosine near 1 is known to about 1e-8 only.
_SLACK = 1e-6


def run_tables(keys: list[str]):
    """A function from sorted batches to one table per run of equal keys. Self-contained, so that workers need no package."""

    def read(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def changes(table):
            change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
            for k in keys:
                column = table.column(k).combine_chunks()
                a, b = column[1:], column[:-1]
                equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                change |= ~equal.to_numpy(zero_copy_only=False)
            return np.flatnonzero(change) + 1

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
                if len(changes(edge)):
                    yield pa.Table.from_batches(held)
                    held = []
            cuts = changes(pa.Table.from_batches([batch]))
            start = 0
            for cut in cuts.tolist():
                yield pa.Table.from_batches([*held, batch.slice(start, cut - start)])
                held, start = [], cut
            held.append(batch.slice(start))
        if held:
            yield pa.Table.from_batches(held)

    return read


def _units(vector: str):
    """A function from a table to its vectors, scaled to length one."""
    floor = NORM_FLOOR

    def read(table):
        import numpy as np

        column = table.column(vector).combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = flat.reshape(len(column), -1)
        return rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), floor)[:, None]

    return read


def _pivots_task(keys: list[str], vector: str, out: list[str]):
    """Pivots from a group's sample, each the farthest from those before; ``_home`` is the nearest of the first ``_blocks``."""
    read_runs, units, finer, most = run_tables(keys), _units(vector), FINER, _PIVOTS

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for run in read_runs(batches):
            rows, blocks = units(run), run.column("_blocks")[0].as_py()
            nearest = np.full(len(rows), -np.inf)
            chosen = [0]
            while len(chosen) < min(finer * blocks, most, len(rows)):
                nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
                nearest[chosen] = np.inf
                chosen.append(int(nearest.argmin()))
            part = run.take(pa.array(chosen)).combine_chunks()
            made = {"_cell": np.arange(len(chosen)), "_home": (rows[chosen] @ rows[chosen[:blocks]].T).argmax(axis=1)}
            columns = [pa.array(made[n], pa.int64()) if n in made else part.column(n).combine_chunks() for n in out]
            yield pa.RecordBatch.from_arrays(columns, out)

    return task


def _assign_task(keys: list[str], vector: str, out: list[str]):
    """Rows of a slice (``_pivot`` -1) after the group's pivots: each gets its nearest cell and the angle to it."""
    read_runs, units = run_tables([*keys, "_slice"]), _units(vector)

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for run in read_runs(batches):
            pivot = run.column("_pivot").combine_chunks().to_numpy(zero_copy_only=False)
            places = np.flatnonzero(pivot < 0)
            if not len(places):
                continue
            mine = units(run)
            centres, number = mine[pivot >= 0], pivot[pivot >= 0]
            cell, angle = np.zeros(len(places), dtype=np.int64), np.zeros(len(places))
            for start in range(0, len(places), 1024):
                part = slice(start, start + 1024)
                sims = mine[places[part]] @ centres.T
                best = sims.argmax(axis=1)
                cell[part] = number[best]
                angle[part] = np.arccos(np.clip(sims[np.arange(len(best)), best], -1, 1))
            rows = run.take(pa.array(places)).combine_chunks()
            made = {"_cell": pa.array(cell), "_angle": pa.array(angle)}
            columns = [made[n] if n in made else rows.column(n).combine_chunks() for n in out]
            yield pa.RecordBatch.from_arrays(columns, out)

    return task


def _bounds():
    """A function to the lowest and highest similarity that members of blocks ``start:stop`` can have with all others."""
    slack = _SLACK

    def bounds(centres, radii, start, stop):
        import numpy as np

        angle = np.arccos(np.clip(centres[start:stop] @ centres.T, -1, 1))
        both = radii[start:stop, None] + radii[None, :] + slack
        return np.cos(np.minimum(angle + both, np.pi)), np.cos(np.maximum(angle - both, 0))

    return bounds


def _pairs_task(keys: list[str], vector: str, lowest: bool, out: list[str], first: bool):
    """Pairs of blocks to compare, from one row per cell and block of a group.

    ``first``: for each cell the one that promises most; else all that may still change a result. Numbers that are not a
    number never let a pair be skipped.
    """
    read_runs, units, bounds = run_tables(keys), _units(vector), _bounds()

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for run in read_runs(batches):
            block, radius, high, low = (
                run.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("_block", "_radius", "_high", "_low")
            )
            centres, head = units(run), run.slice(0, 1)
            for start in range(0, len(block), 256):
                stop = min(start + 256, len(block))
                least, most = bounds(centres, radius, start, stop)
                elsewhere = block[start:stop, None] != block[None, :]
                wanted = elsewhere & ~((most <= high[start:stop, None]) & (most <= high[None, :]))
                promising = [np.where(wanted, most, -np.inf)]
                if lowest:
                    lower = elsewhere & ~((most <= 0) | ((least >= low[start:stop, None]) & (least >= low[None, :])))
                    aside = np.abs(centres[start:stop] @ centres.T)
                    # best: only positive similarities, and small ones; else a right angle between the pivots
                    promising.append(np.where(lower, np.where(least > 0, -most, -10 - aside), -np.inf))
                    wanted |= lower
                if first:
                    own = np.arange(stop - start)
                    wanted = np.zeros_like(wanted)
                    for score in promising:
                        best = score.argmax(axis=1)
                        wanted[own, best] |= ~np.isneginf(score[own, best])
                a, b = np.nonzero(wanted)
                pairs = np.unique(np.sort(np.stack([block[a + start], block[b]], axis=1), axis=1), axis=0)
                a, b = pairs[:, 0], pairs[:, 1]
                made = {"_lo": a, "_hi": b}
                again = pa.array(np.zeros(len(a), np.int64))
                columns = [
                    pa.array(made[n], pa.int64()) if n in made else head.column(n).combine_chunks().take(again) for n in out
                ]
                yield pa.RecordBatch.from_arrays(columns, out)

    return task


def _fields(df: DataFrame, columns: list[str], **more: T.DataType) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + [T.StructField(n, t) for n, t in more.items()])


def deal_to_cells(vectors: DataFrame, keys: list[str], vector: str, rep: str, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each vector with its cell and the angle to the cell's pivot, and the pivots (``_cell``, ``_home``, vector).

    ``facts``: per group ``_f_`` keys, ``_distinct`` vectors, ``_blocks`` wanted and ``_least``, the smallest hash of ``rep``,
    so that every group has a pivot.
    """
    on = F.lit(True)
    for k in keys:
        on = on & vectors[k].eqNullSafe(facts["_f_" + k])
    mark = F.xxhash64(rep)
    sized = vectors.join(facts, on).drop(*["_f_" + k for k in keys])
    # every group has a vector in its sample, and SAMPLE times its pivots are expected
    chosen = (mark == F.col("_least")) | (F.pmod(mark, F.col("_distinct")) < SAMPLE * F.least(FINER * F.col("_blocks"), F.lit(_PIVOTS)))
    sample = sized.filter(chosen).select(*keys, "_blocks", vector, rep)
    schema = _fields(sample, [*keys, "_blocks", vector], _cell=T.LongType(), _home=T.LongType())
    ordered = sample.repartition(*keys).sortWithinPartitions(*keys, rep)
    pivots = materialise(ordered.mapInArrow(_pivots_task(keys, vector, [f.name for f in schema]), schema))

    columns = [c for c in vectors.columns]
    slices = sized.withColumn("_slice", F.pmod(F.xxhash64(F.lit(7), rep), F.col("_blocks")).cast("int"))
    rows = slices.select(*columns, "_slice", F.lit(-1).cast("bigint").alias("_pivot"))
    spread = pivots.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)))
    blank = [F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in columns if c not in (*keys, vector)]
    centres = spread.select(*keys, vector, *blank, "_slice", F.col("_cell").alias("_pivot"))
    both = rows.unionByName(centres)
    schema = _fields(vectors, columns, _cell=T.LongType(), _angle=T.DoubleType())
    task = _assign_task(keys, vector, [f.name for f in schema])
    ordered = both.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", F.desc("_pivot"))
    return ordered.mapInArrow(task, schema), pivots.drop("_blocks")


def block_pairs(parts: DataFrame, keys: list[str], vector: str, lowest: bool, first: bool) -> DataFrame:
    """(keys, _lo, _hi) from ``parts``, one row per cell and block: keys, ``_block``, the cell's pivot vector, ``_radius``, ``_high``, ``_low``.

    ``_high`` is the smallest of the highest similarities that the part's vectors have so far, ``_low`` the
    greatest of their lowest positive ones.
    """
    schema = _fields(parts, keys, _lo=T.LongType(), _hi=T.LongType())
    task = _pairs_task(keys, vector, lowest, [f.name for f in schema], first)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema).distinct()
