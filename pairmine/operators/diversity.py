"""Embedding diversity of candidates inside their prompt group.

Similarities are never written out as pairs. Each group is worked on as one block in one task, by a
matrix product, and every candidate comes back once with its extremes. Groups larger than a
block are found first; their equal vectors are merged, the distinct vectors are dealt into blocks (by direction
for the cosine, by hash for a plug-in), and each pair of blocks becomes one bounded piece of work, so that no group passes
through a single task, however large it is. For the cosine, pairs of blocks that cannot change a result are
left out (see ``cells``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmine.functions.vectors import NORM_FLOOR, round6
from pairmine.operators import cells
from pairmine.schemas import require
from pairmine.session import materialise

BLOCK_ROWS = 4096
# At most this many large groups are broadcast; beyond, they are joined by shuffle.
_BROADCAST_GROUPS = 100_000
_FEW_BLOCKS = 4
# A large group is cut into so many blocks, as long as one block stays below these rows and bytes: each vector is sent
# once for each block that its own is compared with, so that their number must not grow with the group.
_BLOCKS, _MOST_ROWS, _MOST_BYTES = 64, 8 * BLOCK_ROWS, 1 << 26
# Rows multiplied at a time, so that the products stay in the processor's cache.
_CHUNK_ROWS = 128


def group_columns(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def attach_embeddings(
    candidates: DataFrame,
    embeddings: DataFrame | Callable[[DataFrame], DataFrame],
    key: str = "word",
    vector: str = "embedding",
) -> DataFrame:
    """Put the vector of each candidate beside it; NULL where there is none.

    ``embeddings`` has one row per distinct word; a word listed twice is an error, found by one count over the words at once. Where no such table exists, pass a function that
    makes one: it gets the distinct words, and what it makes is written once, so that a model sees
    each word a single time.
    """
    if callable(embeddings):
        embeddings = materialise(embeddings(candidates.select(key).distinct()))
    require(embeddings, key, vector)
    twice = embeddings.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").first()
    if twice is not None:
        raise ValueError(f"the embeddings list this word twice: {twice[0]!r}")
    return candidates.join(embeddings.select(key, vector), key, "left")


def _profile_task(
    keys: list[str], vector: str, out: list[str], similarity: Callable | None, lowest: bool, summary: bool = False
):
    """Body of the similarity tasks, for rows sorted by ``keys``.

    A run of equal keys is one piece of work: a whole group, or two blocks of a large one (columns
    ``_block``, ``_lo``, ``_hi``, ``_copies``). ``summary`` gives one row per whole group, with the extremes of all its rows and what
    its average needs. Self-contained, so that workers need no package.
    """
    floor, chunk = NORM_FLOOR, _CHUNK_ROWS

    def task(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def numbers(column):
            return column.combine_chunks().to_numpy(zero_copy_only=False)

        def run_starts(table):
            change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
            for k in keys:
                column = table.column(k).combine_chunks()
                a, b = column[1:], column[:-1]
                equal = pc.fill_null(pc.equal(a, b), False)
                both_null = pc.and_(pc.is_null(a), pc.is_null(b))
                change |= ~pc.or_(equal, both_null).to_numpy(zero_copy_only=False)
            return np.flatnonzero(change) + 1

        def compare(a, b):
            return a @ b.T if similarity is None else np.array(similarity(a, b), dtype=np.float64)

        def extremes(a, b, same):
            high_a, low_a = np.full(len(a), -np.inf), np.full(len(a), np.inf)
            high_b, low_b = np.full(len(b), -np.inf), np.full(len(b), np.inf)
            if len(a) == 0 or len(b) == 0:
                return high_a, low_a, high_b, low_b
            mirrored = same or similarity is None
            for start in range(0, len(a), chunk):
                rows = slice(start, start + chunk)
                sims = compare(a[rows], b)
                if same:
                    own = np.arange(len(sims))
                    sims[own, own + start] = -np.inf
                elif mirrored:
                    high_b = np.maximum(high_b, sims.max(axis=0))
                high_a[rows] = sims.max(axis=1)
                if lowest:
                    sims[sims <= 0] = np.inf
                    low_a[rows] = sims.min(axis=1)
                    if not same and mirrored:
                        low_b = np.minimum(low_b, sims.min(axis=0))
            if not mirrored:  # a plug-in need not be symmetric: the other rows are asked on their own
                for start in range(0, len(b), chunk):
                    rows = slice(start, start + chunk)
                    sims = compare(b[rows], a)
                    high_b[rows] = sims.max(axis=1)
                    if lowest:
                        sims[sims <= 0] = np.inf
                        low_b[rows] = sims.min(axis=1)
            return high_a, low_a, high_b, low_b

        def with_copies(rows, copies, high, low):
            # a vector that occurs again is a partner of itself
            again = copies > 1
            if again.any():
                places = np.flatnonzero(again)
                own = np.array([compare(rows[[i]], rows[[i]])[0, 0] for i in places])
                high[again] = np.maximum(high[again], own)
                if lowest:
                    low[again] = np.minimum(low[again], np.where(own <= 0, np.inf, own))

        def unit_sums(flat, ends):
            longest = int(np.diff(ends).max())
            total, own = np.zeros(longest), 0.0
            if (np.diff(ends) == longest).all():
                rows = flat[ends[0] : ends[-1]].reshape(-1, longest)
                rows = rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), floor)[:, None]
                total, own = rows.sum(axis=0), float(np.einsum("ij,ij->", rows, rows))
            else:  # a shorter vector has no part in the last dimensions
                for start, stop in zip(ends[:-1], ends[1:]):
                    row = flat[start:stop] / max(np.sqrt(flat[start:stop] @ flat[start:stop]), floor)
                    total[: stop - start] += row
                    own += float(row @ row)
            return float(total @ total), own

        def profiles(table, bounds):
            column = table.column(vector).combine_chunks()
            missing = pc.is_null(column).to_numpy(zero_copy_only=False)
            high, low = np.full(table.num_rows, -np.inf), np.full(table.num_rows, np.inf)
            square_of_sum, sum_of_squares = [], []
            present = int((~missing).sum())
            if present:
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                begin = np.concatenate([[0], np.cumsum(sizes)])
                dealt = "_block" in table.column_names
                if dealt:
                    block, lo = numbers(table.column("_block")), numbers(table.column("_lo"))
                    hi, copies = numbers(table.column("_hi")), numbers(table.column("_copies"))
                for first, last in zip(bounds[:-1], bounds[1:]):
                    span, size = slice(first, last), sizes[first]
                    if summary:
                        whole, own = unit_sums(flat, begin[first : last + 1])
                        square_of_sum.append(whole)
                        sum_of_squares.append(own)
                    if missing[span].any() or size == 0 or (sizes[span] != size).any():
                        continue  # one vector that is missing or of another length leaves the group without scores
                    mine = flat[begin[first] : begin[last]].reshape(last - first, size)
                    if similarity is None:
                        norms = np.sqrt(np.einsum("ij,ij->i", mine, mine))
                        mine = mine / np.maximum(norms, floor)[:, None]
                    if not dealt or lo[first] == hi[first]:
                        h, m, _, _ = extremes(mine, mine, True)
                        if dealt:
                            with_copies(mine, copies[span], h, m)
                        high[span], low[span] = h, m
                    else:
                        left = block[span] == lo[first]
                        at = np.arange(first, last)
                        ha, la, hb, lb = extremes(mine[left], mine[~left], False)
                        high[at[left]], low[at[left]] = ha, la
                        high[at[~left]], low[at[~left]] = hb, lb
            if summary:
                high, low = np.maximum.reduceat(high, bounds[:-1]), np.minimum.reduceat(low, bounds[:-1])
                table = table.take(pa.array(bounds[:-1]))
            made = {
                "max_sim": pa.array(high, mask=np.isneginf(high)),
                "min_positive_sim": pa.array(low, mask=np.isposinf(low)),
            }
            if summary:
                made |= {"_n": pa.array(np.diff(bounds)), "_whole": pa.array(square_of_sum, pa.float64()), "_own": pa.array(sum_of_squares, pa.float64())}
            columns = [made[n] if n in made else table.column(n).combine_chunks() for n in out]
            return pa.RecordBatch.from_arrays(columns, out)

        carried = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table])
            starts = run_starts(table)
            if len(starts) == 0:
                carried = table
                continue
            done = int(starts[-1])
            carried = table.slice(done)
            yield profiles(table.slice(0, done), [0, *starts.tolist()])
        if carried is not None and carried.num_rows:
            yield profiles(carried, [0, carried.num_rows])

    return task


def _run_tasks(
    df: DataFrame,
    keys: list[str],
    vector: str,
    out: list[str],
    similarity: Callable | None,
    lowest: bool,
    tasks: int | None = None,
    summary: bool = False,
) -> DataFrame:
    """``tasks`` keeps adaptive execution from merging partitions, which it judges by bytes alone."""
    fields = [df.schema[c] for c in out] + [T.StructField("_n", T.LongType())] * summary
    figures = (("_whole", "_own") if summary else ()) + ("max_sim", "min_positive_sim")
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in figures])
    task = _profile_task(keys, vector, [f.name for f in schema.fields], similarity, lowest, summary)
    spread = df.repartition(*keys) if tasks is None else df.repartition(tasks, *keys)
    return spread.sortWithinPartitions(*keys).mapInArrow(task, schema)


def _matches(df: DataFrame, other: DataFrame, keys: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(other[prefix + k])
    return condition


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    for k in keys:
        df = df.withColumnRenamed(k, prefix + k)
    return df


def similarity_profile(
    df: DataFrame,
    group: str | list[str] = "prompt_id",
    id: str = "sample_idx",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    group_sizes: DataFrame | None = None,
    similarity: Callable | None = None,
    lowest: bool = True,
) -> DataFrame:
    """Per candidate: ``max_sim`` and ``min_positive_sim`` to all *other* candidates of its group.

    Takes the place of the table of all ordered pairs: every pair is compared, none is emitted.
    NULL stands for no partner, no positive similarity, or a group in which a vector is missing, empty or
    of another length. A similarity that is not a number makes both figures of its candidates NaN.
    The columns of ``df`` stay, except the vector. ``id`` is unique within its group.

    ``similarity(a, b)`` may replace the cosine: it gets two numpy blocks of vectors and returns
    the matrix of similarities of each row of ``a`` to each of ``b``; it need not be symmetric. ``group_sizes`` may name a cheaper table to count groups on.
    ``lowest=False`` leaves ``min_positive_sim`` out (NULL), which halves the work.

    One pass over the group columns runs at once, to find groups above ``block_rows``. Groups of many different vectors get larger
    blocks, so that there are 64 of them, up to 8 * ``block_rows`` or 8 * ``BLOCK_ROWS`` rows (64 MB of numbers).
    """
    keys = group_columns(group)
    require(df, *keys, id, vector)
    kept = [c for c in df.columns if c != vector]
    usual, hot, small = _split_by_size(df, keys, block_rows, group_sizes)
    scored = _run_tasks(usual, keys, vector, kept, similarity, lowest)
    if hot is None:
        return scored
    large = _large_groups(hot, keys, id, vector, block_rows, similarity, lowest, small)
    return scored.unionByName(large.select(*kept, "max_sim", "min_positive_sim"))


def _split_by_size(
    df: DataFrame, keys: list[str], block_rows: int, group_sizes: DataFrame | None
) -> tuple[DataFrame, DataFrame | None, Callable[[DataFrame], DataFrame]]:
    """Rows of groups up to ``block_rows``, those of larger groups (None if there are none), and how to join per-group tables."""
    counted = (df if group_sizes is None else group_sizes).groupBy(*keys).agg(F.count("*").alias("_n"))
    large = counted.filter(F.col("_n") > block_rows).drop("_n")
    found = large.limit(_BROADCAST_GROUPS + 1).collect()
    few = len(found) <= _BROADCAST_GROUPS

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    if not found:
        return df, None, small
    if few:
        large = df.sparkSession.createDataFrame(found, large.schema)
    large = _prefixed(large, keys, "_l_")
    usual = df.join(small(large), _matches(df, large, keys, "_l_"), "left_anti")
    return usual, df.join(small(large), _matches(df, large, keys, "_l_"), "left_semi"), small


def _large_groups(
    hot: DataFrame,
    keys: list[str],
    id: str,
    vector: str,
    block_rows: int,
    similarity: Callable | None,
    lowest: bool,
    small: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    distinct, parts = _large_parts(hot, keys, id, vector, block_rows, similarity, lowest, small)
    undefined = F.bool_or(F.isnan("min_positive_sim"))  # one NaN makes the result NaN, as within a block
    whole = parts.groupBy(*keys, "_rep").agg(
        F.max("max_sim").alias("max_sim"),
        F.when(undefined, F.lit(float("nan"))).otherwise(F.min("min_positive_sim")).alias("min_positive_sim"),
    )
    whole = _prefixed(whole.withColumnRenamed("_rep", "_w_rep"), keys, "_w_")
    of_rep = _matches(distinct, whole, keys, "_w_") & (distinct["_rep"] == whole["_w_rep"])
    by_vector = distinct.join(whole, of_rep).select(
        *[F.col(k).alias("_v_" + k) for k in keys],
        F.col(vector).alias("_v_vector"),
        "max_sim",
        "min_positive_sim",
    )
    of_vector = _matches(hot, by_vector, keys, "_v_") & (hot[vector] == by_vector["_v_vector"])
    return hot.join(by_vector, of_vector, "left")


def _large_parts(
    hot: DataFrame,
    keys: list[str],
    id: str,
    vector: str,
    block_rows: int,
    similarity: Callable | None,
    lowest: bool,
    small: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """The different vectors of large groups with their copies, and extremes of each for every pair of blocks it was in."""
    # Copies of a vector are merged (before the shuffle already) and compared once. The distinct
    # vectors are written: they are counted, dealt into blocks and joined back.
    distinct = materialise(
        hot.groupBy(*keys, vector).agg(F.min(id).alias("_rep"), F.count("*").alias("_copies"))
    )
    facts = distinct.groupBy(*keys).agg(
        F.count("*").alias("_distinct"),
        F.count_if(F.col(vector).isNull()).alias("_missing"),
        F.min(F.size(vector)).alias("_shortest"),
        F.max(F.size(vector)).alias("_longest"),
        F.min(F.xxhash64("_rep")).alias("_least"),
    )
    whole = (F.col("_missing") == 0) & (F.col("_shortest") == F.col("_longest")) & (F.col("_shortest") > 0)
    most = F.greatest(F.least(F.lit(_MOST_ROWS), F.lit(_MOST_BYTES) / (8 * F.col("_longest"))), F.lit(8 * block_rows))
    rows = F.least(F.greatest(F.col("_distinct") / _BLOCKS, F.lit(block_rows)), most)
    facts = _prefixed(facts.filter(whole), keys, "_f_").withColumn("_rows", rows)
    facts = facts.withColumn("_blocks", F.ceil(F.col("_distinct") / F.col("_rows")).cast("int"))
    facts = materialise(facts.select(*["_f_" + k for k in keys], "_distinct", "_blocks", "_rows", "_least"))
    # of a few blocks, finding out which need not be compared costs more than comparing them
    if similarity is None and not facts.filter(F.col("_blocks") > _FEW_BLOCKS).isEmpty():
        parts = _compare_cells(distinct, keys, vector, lowest, small, facts)
    else:
        parts = _compare_all_blocks(distinct, keys, vector, similarity, lowest, small(facts))
    return distinct, parts


def _tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _compare_all_blocks(
    distinct: DataFrame, keys: list[str], vector: str, similarity: Callable | None, lowest: bool, facts: DataFrame
) -> DataFrame:
    """Extremes per vector and pair of blocks, where every pair is compared."""
    dealt = (
        distinct.join(facts, _matches(distinct, facts, keys, "_f_"), "inner")
        .withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_lo", F.least("_block", "_other"))
        .withColumn("_hi", F.greatest("_block", "_other"))
        .select(*keys, "_lo", "_hi", "_block", "_copies", "_rep", vector)
    )
    return _run_tasks(dealt, [*keys, "_lo", "_hi"], vector, [*keys, "_rep"], similarity, lowest, _tasks_of(distinct))


def _bests(results: DataFrame, keys: list[str], centres: DataFrame) -> DataFrame:
    """Per cell and block what all its vectors have at least (``_high``) and at most (``_low``), beside the cell's centre."""
    per_vector = results.groupBy(*keys, "_block", "_cell", "_rep").agg(
        F.max("max_sim").alias("max_sim"), F.min("min_positive_sim").alias("min_positive_sim")
    )
    bests = per_vector.groupBy(*keys, "_block", "_cell").agg(
        F.min(F.coalesce("max_sim", F.lit(-2.0))).alias("_high"),
        F.max(F.coalesce("min_positive_sim", F.lit(2.0))).alias("_low"),
    )
    renamed = _prefixed(centres, keys, "_c_").withColumnRenamed("_cell", "_c_cell")
    own = _matches(bests, renamed, keys, "_c_") & (F.col("_cell") == F.col("_c_cell"))
    return bests.join(renamed, own).drop(*["_c_" + k for k in keys], "_c_cell")


def _compare_cells(
    distinct: DataFrame,
    keys: list[str],
    vector: str,
    lowest: bool,
    small: Callable[[DataFrame], DataFrame],
    facts: DataFrame,
) -> DataFrame:
    """Extremes per vector and pair of blocks, for cosine: only pairs of blocks that may change a result.

    Each block with itself first, then with those that promise most, then with all whose bounds still allow a
    better value. Of 10**6 different vectors in 64 blocks, each is sent once to find its cell, and then once per block that its
    own is compared with: a few times where vectors lie in clusters, 64 times at worst, as without bounds.
    """
    known = ["_rep", "_copies", vector]
    placed, pivots = cells.deal_to_cells(distinct.select(*keys, *known), keys, vector, "_rep", small(facts))
    placed = materialise(placed)
    sizes = placed.groupBy(*keys, "_cell").agg(F.count("*").alias("_size"), F.max("_angle").alias("_radius"))
    sizes = _prefixed(sizes, keys, "_s_").withColumnRenamed("_cell", "_s_cell")
    of_pivot = _matches(pivots, sizes, keys, "_s_") & (pivots["_cell"] == sizes["_s_cell"])
    wide = pivots.join(sizes, of_pivot).drop(*["_s_" + k for k in keys], "_s_cell")
    rows = _prefixed(facts.select(*[F.col("_f_" + k).alias(k) for k in keys], "_rows"), keys, "_f_")
    wide = wide.join(small(rows), _matches(wide, rows, keys, "_f_")).drop(*["_f_" + k for k in keys])
    # cells around one pivot after those around another fill the blocks; there are at most some thousand cells in a group
    before = Window.partitionBy(*keys).orderBy("_home", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(before), F.lit(0))
    first, last = F.floor(start / F.col("_rows")), F.floor((start + F.col("_size") - 1) / F.col("_rows"))
    wide = wide.withColumn("_first", first).withColumn(
        "_pieces", F.when(F.col("_size") > F.col("_rows"), last - first + 1).otherwise(1)
    )
    centres = materialise(wide.select(*keys, "_cell", "_radius", "_first", "_pieces", vector))
    where = _prefixed(centres.select(*keys, "_cell", "_first", "_pieces"), keys, "_s_").withColumnRenamed("_cell", "_s_cell")
    of_cell = _matches(placed, where, keys, "_s_") & (placed["_cell"] == where["_s_cell"])
    block = F.col("_first") + F.pmod(F.xxhash64(F.lit(11), "_rep"), F.col("_pieces"))
    dealt = materialise(placed.join(where, of_cell).select(*keys, block.alias("_block"), "_cell", *known))
    centres = centres.drop("_first", "_pieces")

    out, tasks = [*keys, "_block", "_cell", "_rep"], _tasks_of(distinct)
    own = dealt.withColumn("_lo", F.col("_block")).withColumn("_hi", F.col("_block"))
    done = materialise(_run_tasks(own, [*keys, "_lo", "_hi"], vector, out, None, lowest, tasks))
    seen = None
    for first in (True, False):
        pairs = cells.block_pairs(_bests(done, keys, centres), keys, vector, lowest, first)
        if seen is not None:
            pairs = pairs.join(seen, [F.col(c).eqNullSafe(F.col("_p_" + c)) for c in seen_columns], "left_anti")
        pairs = materialise(pairs)
        seen_columns = [*keys, "_lo", "_hi"]
        seen = pairs.select(*[F.col(c).alias("_p_" + c) for c in seen_columns])
        both = pairs.withColumn("_own", F.explode(F.array("_lo", "_hi")))
        both = _prefixed(both, keys, "_b_")
        met = dealt.join(both, _matches(dealt, both, keys, "_b_") & (dealt["_block"] == both["_own"]))
        met = met.select(*keys, "_lo", "_hi", "_block", "_cell", *known)
        done = done.unionByName(materialise(_run_tasks(met, [*keys, "_lo", "_hi"], vector, out, None, lowest, tasks)))
    return done


def _partial_sums_task(keys: list[str], vector: str, weight: str | None, out: list[str]):
    """Per batch and group: number, sum of unit vectors, sum of their squares. Self-contained, as workers need no package."""
    floor = NORM_FLOOR

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("_row", pa.array(np.arange(batch.num_rows)))
            groups = table.select([*keys, "_row"]).group_by(keys).aggregate([("_row", "list")])
            column = batch.column(batch.schema.get_field_index(vector))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            times = np.ones(batch.num_rows) if weight is None else table.column(weight).to_numpy().astype(np.float64)
            counts, sums, squares = [], [], []
            for rows in groups.column("_row_list"):
                places = np.array(rows.values)
                starts, sizes = ends[places], ends[places + 1] - ends[places]
                longest = int(sizes.max())
                # a shorter vector has no part in the last dimensions
                inside = np.arange(longest)[None, :] < sizes[:, None]
                block = np.where(inside, flat[np.minimum(starts[:, None] + np.arange(longest), max(len(flat) - 1, 0))], 0.0) if longest else np.zeros((len(places), 0))
                block = block / np.maximum(np.sqrt(np.einsum("ij,ij->i", block, block)), floor)[:, None]
                counts.append(int(times[places].sum()))
                sums.append((times[places] @ block).tolist())
                squares.append(float(times[places] @ np.einsum("ij,ij->i", block, block)))
            made = {"_n": pa.array(counts, pa.int64()), "_sum": pa.array(sums, pa.list_(pa.float64())), "_own": pa.array(squares, pa.float64())}
            columns = [made[n] if n in made else groups.column(n).combine_chunks() for n in out]
            yield pa.RecordBatch.from_arrays(columns, out)

    return task


def _add_sums_task(keys: list[str], out: list[str]):
    """Sums of sorted partial sums: one row per group."""
    read_runs = cells.run_tables(keys)

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for run in read_runs(batches):
            parts = [np.array(x) for x in run.column("_sum").to_pylist()]
            total = np.zeros(max(len(x) for x in parts))
            for part in parts:
                total[: len(part)] += part
            made = {"_n": [sum(run.column("_n").to_pylist())], "_whole": [float(total @ total)], "_own": [sum(run.column("_own").to_pylist())]}
            head = run.slice(0, 1)
            columns = [pa.array(made[n], pa.int64() if n == "_n" else pa.float64()) if n in made else head.column(n).combine_chunks() for n in out]
            yield pa.RecordBatch.from_arrays(columns, out)

    return task


def unit_sums(df: DataFrame, keys: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """Per group ``_n``, ``_whole`` (the squared length of the sum of unit vectors) and ``_own`` (the sum of their squared lengths).

    Each batch of rows becomes one row per group before the shuffle. ``weight`` counts a row more than once; vectors are not null.
    """
    fields = [df.schema[k] for k in keys]
    partial = T.StructType(
        [*fields, T.StructField("_n", T.LongType()), T.StructField("_sum", T.ArrayType(T.DoubleType())), T.StructField("_own", T.DoubleType())]
    )
    final = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("_n", T.LongType()), ("_whole", T.DoubleType()), ("_own", T.DoubleType())))])
    rows = df.select(*keys, vector, *([weight] if weight else []))
    parts = rows.mapInArrow(_partial_sums_task(keys, vector, weight, [f.name for f in partial]), partial)
    ordered = parts.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_add_sums_task(keys, [f.name for f in final]), final)


def average_of_sums(n: Column, whole: Column, own: Column) -> Column:
    """Mean similarity of all ordered pairs of different rows; 0.0 below two rows."""
    rows = n.cast("double")
    return F.when(rows < 2, 0.0).otherwise((whole - own) / (rows * (rows - 1)))


def group_spread(
    df: DataFrame,
    group: str | list[str] = "run",
    id: str = "word",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    group_sizes: DataFrame | None = None,
) -> DataFrame:
    """Per group of rows with a vector: ``n``, ``avg_similarity``, ``max_sim`` and ``min_positive_sim`` of all its pairs.

    One shuffle of the vectors: the task that compares a group's rows also adds up its unit vectors. Of groups above
    ``block_rows`` the extremes come from blocks, the sums from their different vectors. Extremes are NULL as in
    :func:`similarity_profile`.
    """
    keys = group_columns(group)
    require(df, *keys, id, vector)
    present = df.filter(F.col(vector).isNotNull()).select(*keys, id, vector)
    usual, hot, small = _split_by_size(present, keys, block_rows, group_sizes)
    figures = _run_tasks(usual, keys, vector, keys, None, True, summary=True)
    if hot is not None:
        distinct, parts = _large_parts(hot, keys, id, vector, block_rows, None, True, small)
        undefined = F.bool_or(F.isnan("min_positive_sim"))
        extremes = parts.groupBy(*keys).agg(
            F.max("max_sim").alias("max_sim"),
            F.when(undefined, F.lit(float("nan"))).otherwise(F.min("min_positive_sim")).alias("min_positive_sim"),
        )
        sums = _prefixed(unit_sums(distinct, keys, vector, "_copies"), keys, "_u_")
        own = _matches(extremes, sums, keys, "_u_")
        large = sums.join(extremes, own, "left").select(
            *[F.col("_u_" + k).alias(k) for k in keys], "_n", "_whole", "_own", "max_sim", "min_positive_sim"
        )
        figures = figures.unionByName(large)
    average = average_of_sums(F.col("_n"), F.col("_whole"), F.col("_own"))
    return figures.select(*keys, F.col("_n").alias("n"), average.alias("avg_similarity"), "max_sim", "min_positive_sim")


def max_sim_diversity(
    df: DataFrame,
    group: str | list[str] = "prompt_id",
    id: str = "sample_idx",
    vector: str = "embedding",
    score: Callable[[Column, Column], Column] | None = None,
    **options,
) -> DataFrame:
    """Add ``diversity`` = 1 − the highest similarity to another candidate; between 0 and 2.

    0 for the only candidate of a group and for every candidate of a group in which a vector is
    missing, empty or of another length. Rounded to six places, so that summation order cannot decide a ranking. The vector
    column is dropped. ``score(max_sim, min_positive_sim)`` may replace the formula; ``options`` go
    to :func:`similarity_profile`.
    """
    profile = similarity_profile(df, group, id, vector, lowest=score is not None, **options)
    highest = F.col("max_sim")
    value = 1 - highest if score is None else score(highest, F.col("min_positive_sim"))
    value = F.when(highest.isNull(), F.lit(0.0)).otherwise(F.coalesce(round6(value), F.lit(0.0)))
    return profile.withColumn("diversity", value).drop("max_sim", "min_positive_sim")
