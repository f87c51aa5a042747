"""Operator 10: scoring texts with an n-gram model that is kept as an Elias-Fano trie.

Tokens are the words of the lower-cased text and one end per document, which also stands before the first word. Counts of
words, of pairs and so on up to ``order`` come from Spark aggregates over all the training documents. The levels of the
trie are sorted by range and written to the shared folder, a file per range:

* level 1: the hashes of the words, as an Elias-Fano sequence; a word's id is its place;
* level k: its n-grams as one ascending sequence of context * width + successor. The context is the place of
  the first k - 1 words on level k - 1, and the successor is relative to it: the place of the last word among those
  that follow the words between. Ascending pointers give the first successor of each context.

Tasks add up what repeats in their portions of the texts; one range shuffle brings equal n-grams together. Ranges hold about ``RANGE_ROWS``
n-grams and are cut anywhere, so a context's successors may go over several: each file tells of its first and last context, and what is taken
from these is added up over the files. Pointer and weight of a context are read in the first range that has it.

Probabilities are interpolated, with discounts from the counts of counts (modified Kneser-Ney discounts over plain counts); each
level keeps them quantised to 256 values, of equal shares of the tokens, and so the weight that a context leaves to the shorter one. All n-grams
are kept, so that the counts of counts are those of the whole text; a ``min_count`` above 1 leaves out rarer ones of two words and more, and
what that takes from a context goes to its shorter one.

Scoring reads each document where it is stored: a portion's distinct n-grams are looked up range by range, by successor search in the
memory-mapped file; only the pages that are touched are read, and a bounded number of files is open at a time.

Defined results: a null text is empty, and has the end as its one token; a text of any length is one sequence; rows that repeat others
count and score alike; without training documents every token is unknown and scores as in a model of nothing; an
empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from pairmine.llm.common import buckets_for, whole
from pairmine.llm.eliasfano import Ascending, coded, group, map_arrays, named, read_arrays, write_arrays
from pairmine.session import remove_folder, shared_folder

ORDER = 3
MIN_COUNT = 1
RANGE_ROWS = 1_000_000
_LONG_WORD = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_PIECE_BYTES = 500_000
_BATCH_TOKENS = 1_000_000
_BATCH_CODES = 1_000_000
_ROWS_OUT = 100_000


@dataclass(frozen=True)
class Range:
    """A stretch of a level: its file, first and last context and code (level 1: hash), number of entries before it and in it."""

    path: str
    first: int
    last: int
    low: int
    high: int
    before: int
    n: int


@dataclass(frozen=True)
class Model:
    tokens: int
    vocabulary: int
    levels: tuple[tuple[Range, ...], ...]
    widths: tuple[int, ...]  # of the successors, per level

    @property
    def log_unit(self) -> float:
        """log10 of what one count is worth on level 1, where every word has one more than it has been seen."""
        return -float(np.log10(self.tokens + self.vocabulary + 1))


def _mixed(state: np.ndarray) -> np.ndarray:
    """Each number to another, one to one, so that near numbers lie far apart (the finaliser of SplitMix64)."""
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return state ^ (state >> np.uint64(31))


def _hashes(words: pa.StringArray) -> np.ndarray:
    """63-bit hashes of words, all at once: the length, then eight bytes after eight. Words over ``_LONG_WORD`` bytes: XXH64."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.zeros(int(lengths.sum()) + 8, dtype=np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(words.buffers()[2], dtype=np.uint8, count=len(data) - 8)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    state = _mixed(lengths.astype(np.uint64))
    long = np.flatnonzero(lengths > _LONG_WORD)
    for i in long:
        state[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    lengths[long] = 0
    for done in range(0, int(lengths.max(initial=0)), 8):
        left = np.flatnonzero(lengths > done)
        own = eights[starts[left] + done] & _MASKS[np.minimum(lengths[left] - done, 8)]
        state[left] = _mixed(state[left] ^ own)
    return (state >> np.uint64(1)).astype(np.int64)


#: No word has white space inside, so nothing else has this hash but by chance.
END = int(_hashes(pa.array([" "]))[0])


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of stretches with about ``_PIECE_BYTES`` of text, one row at least."""
    sums = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(sums // _PIECE_BYTES, prepend=0)).tolist() if len(sums) else []
    begins = [0, *(c for c in cuts if c), len(sums)]
    for begin, end in zip(begins, begins[1:], strict=False):
        if end > begin:
            yield begin, end - begin


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' hashes of some texts with an end before and after each, and each text's number of them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at a text's ends leaves empty ones
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))[real]
    hashes = np.full(len(row) + 2 * len(texts), END, dtype=np.int64)
    hashes[np.arange(len(row)) + 2 * row + 1] = _hashes(words)[real]
    return hashes, np.bincount(row, minlength=len(texts)) + 2


def _sequences(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows in portions: the rows, their tokens' hashes with an end before and after each row, and the rows' lengths."""
    rows, parts, lengths, size = [], [], [], 0
    for batch in batches:
        for begin, n in _pieces(batch.column(text_at)):
            rows.append(batch.slice(begin, n))
            hashes, own = _tokens(rows[-1].column(text_at))
            parts.append(hashes)
            lengths.append(own)
            size += len(hashes)
            if size >= _BATCH_TOKENS:
                yield rows, np.concatenate(parts), np.concatenate(lengths)
                rows, parts, lengths, size = [], [], [], 0
                pa.default_memory_pool().release_unused()
    if parts:
        yield rows, np.concatenate(parts), np.concatenate(lengths)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the place of each value among them. For values that repeat: only distinct ones are sorted."""
    encoded = pa.array(values).dictionary_encode()
    found = encoded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[encoded.indices.to_numpy()]


def _find(level: tuple[Range, ...], values: np.ndarray) -> np.ndarray:
    """Places on a level of sorted values; -1 for none."""
    found = np.full(len(values), -1, dtype=np.int64)
    for part in level:
        lo, hi = np.searchsorted(values, part.low), np.searchsorted(values, part.high, side="right")
        if lo < hi:
            at = Ascending.of_parts(group(map_arrays(part.path), "s.")).find(values[lo:hi])
            found[lo:hi] = np.where(at >= 0, at + part.before, -1)
    return found


def _split(level: tuple[Range, ...], values: np.ndarray, by_context: bool) -> Iterator[tuple[Range, np.ndarray]]:
    """Each range that is the first to hold any of the values (contexts, or places on the level), with where those values stand."""
    begins = np.array([p.first if by_context else p.before for p in level], dtype=np.int64)
    ends = np.array([p.last + 1 if by_context else p.before + p.n for p in level], dtype=np.int64)
    owner = np.searchsorted(ends, values, side="right").astype(np.int16 if len(level) < 2**15 else np.int64)
    order = np.argsort(owner, kind="stable") if len(level) > 1 else np.arange(len(values))
    cuts = np.searchsorted(owner[order], np.arange(len(level) + 1)) if len(level) > 1 else (0, len(values))
    for i, part in enumerate(level):
        at = order[cuts[i] : cuts[i + 1]]
        at = at[(values[at] >= begins[i]) & (values[at] < ends[i])]
        if len(at):
            yield part, at


def _take(level: tuple[Range, ...], places: np.ndarray, table: str) -> np.ndarray:
    """What a level has in ``table`` at the given places."""
    found = np.zeros(len(places))
    for part, at in _split(level, places, by_context=False):
        arrays = map_arrays(part.path)
        found[at] = arrays[f"{table}.table"][arrays[f"{table}.code"][places[at] - part.before]]
    return found


def _first_of(level: tuple[Range, ...], contexts: np.ndarray) -> np.ndarray:
    """The place of each context's first successor on the level."""
    distinct, back = _distinct(contexts)
    first = np.zeros(len(distinct), dtype=np.int64)
    for part, at in _split(level, distinct, by_context=True):
        pointers = Ascending.of_parts(group(map_arrays(part.path), "p."))
        first[at] = pointers.access(distinct[at] - part.first) + part.before
    return first[back]


def _weight_of(level: tuple[Range, ...], contexts: np.ndarray) -> np.ndarray:
    """log10 of the weight that each context leaves to the shorter one; 0 for a context without successors."""
    weight = np.zeros(len(contexts))
    for part, at in _split(level, contexts, by_context=True):
        arrays = map_arrays(part.path)
        weight[at] = arrays["w.table"][arrays["w.code"][contexts[at] - part.first]]
    return weight


def _places(model: Model, hashes: np.ndarray, levels: int) -> list[np.ndarray]:
    """Per level, the place of the n-gram that ends at each token of a portion; -1 for none.

    N-grams over the border of two rows are found too; whoever asks knows the rows and skips them.
    """
    words, back = _distinct(hashes)
    found = [_find(model.levels[0], words)[back]]
    for k in range(2, levels + 1):
        context = np.concatenate([[-1], found[-1][:-1]])
        at, fits = _codes(model, found, context, k)
        here = np.full(len(hashes), -1, dtype=np.int64)
        if len(at):
            codes, back = np.unique(at, return_inverse=True)
            here[fits] = _find(model.levels[k - 1], codes)[back]
        found.append(here)
    return found


def _codes(model: Model, found: list[np.ndarray], context: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes on level k of the n-grams that end at each token, where context and successor are known, and where that is."""
    last = found[-1]  # the place of the last k - 1 words
    fits = np.flatnonzero((context >= 0) & (last >= 0))
    successor = last[fits]
    if k > 2:  # relative to the words between: its place among those that follow them
        successor = successor - _first_of(model.levels[k - 2], found[-2][fits - 1])
    return context[fits] * model.widths[k - 1] + successor, fits


def _inside(lengths: np.ndarray) -> np.ndarray:
    """For each token of a portion, its place in its row."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def _counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    for at in range(0, len(values), _ROWS_OUT):
        columns = [pa.array(values[at : at + _ROWS_OUT]), pa.array(n[at : at + _ROWS_OUT].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["code", "n"])


def _portions(docs: DataFrame, model: Model | None, k: int) -> DataFrame:
    """(code, n): how often each n-gram of order k occurs in a portion of the texts; level 1 codes are hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, hashes, lengths in _sequences(batches, 0):
            at = _inside(lengths)
            if k == 1:
                part = hashes[at > 0]
            else:
                found = _places(model, hashes, k - 1)
                part, fits = _codes(model, found, np.concatenate([[-1], found[-1][:-1]]), k)
                part = part[at[fits] >= k - 1]
            parts.append(part)
            size += len(part)
            if size >= _BATCH_CODES:
                yield from _counted(parts)
                parts, size = [], 0
        if size:
            yield from _counted(parts)

    return docs.select("text").mapInArrow(run, "code long, n long")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct codes of some (codes, counts), and the sum of each one's counts."""
    codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(n[order], starts)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when each ends, not when the driver next cleans up: a level's would lie beside the next one's."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _merge(parts: DataFrame, rows: int, k: int, width: int, min_count: int, folder: str) -> list[Row]:
    """Brings equal n-grams together by ranges of their codes, and writes a file per range; a row per file, in order.

    Only the first and last context of a file (``edges``) may have successors in others too: their numbers of successors, sums, and
    numbers of counts 1, 2 and more are told, to be added up. ``counts``: distinct n-grams, rare ones too, with counts 1 to 4, and the sum of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            waiting += batch.num_rows
            if waiting > max(RANGE_ROWS, len(held[0][0])):  # a frequent n-gram comes once from each portion
                held, waiting = [_summed(held)], 0
        codes, n = _summed(held)
        del held
        if not len(codes):
            return
        counts = [*(int((n == c).sum()) for c in range(1, 5)), int(n.sum())]
        often = n >= min_count
        codes, n = codes[often], n[often]
        path, first, last, widest, edges = None, 0, 0, 1, []
        if len(codes):
            arrays: dict[str, np.ndarray] = {}
            arrays["c.table"], arrays["c.code"] = coded(n)
            first, last = int(codes[0]) // width, int(codes[-1]) // width
            arrays |= named("s.", Ascending.build(codes, int(codes[-1]) + 1, int(codes[0])).parts())
            if k > 1:
                begins = np.searchsorted(codes // width, np.arange(first, last + 2))
                widest = int(np.diff(begins).max())
                arrays |= named("p.", Ascending.build(begins, len(codes) + 1).parts())
                for context in sorted({first, last}):
                    own = n[begins[context - first] : begins[context - first + 1]]
                    edges += [context, len(own), int(own.sum()), *(int(x.sum()) for x in (own == 1, own == 2, own > 2))]
            path = f"{folder}/level{k}-{uuid.uuid4().hex}.bin"
            write_arrays(path, arrays)
        row = [path, first, last, int(codes[0]) if path else 0, int(codes[-1]) if path else 0, len(codes), widest]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (edges, counts)]
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), *(pa.array([x]) for x in row[1:]), *lists], names=names)

    names = ["path", "first", "last", "low", "high", "n", "widest", "edges", "counts"]
    schema = "path string, first long, last long, low long, high long, n long, widest long, edges array<long>, counts array<long>"
    with shuffles_removed(parts.sparkSession):
        dealt = parts.repartitionByRange(buckets_for(rows, RANGE_ROWS), "code")
        return sorted(dealt.mapInArrow(run, schema).collect(), key=lambda r: r["low"])  # a row per file


def _add_chances(
    spark: SparkSession, files: list[Row], model: Model, k: int, width: int, discounts: tuple[float, ...], folder: str
) -> tuple[list[str], int]:
    """Writes each file of a level again with probabilities and weights; the new files, and the most successors of a context."""
    edges: dict[int, list[np.ndarray]] = {}
    for file in files:
        for context, *told in np.array(file["edges"]).reshape(-1, 6).tolist():
            edges.setdefault(context, []).append(np.array(told))
    over = {context: sum(told) for context, told in edges.items() if len(told) > 1}
    taken = {context: float(x[1] - np.dot(x[2:], discounts[1:])) for context, x in over.items()}
    widest = max([1, *(f["widest"] for f in files), *(int(x[0]) for x in over.values())])

    def finish(path: str, known: tuple[float | None, float | None]) -> str:
        arrays = read_arrays(path)
        codes = Ascending.of_parts(group(arrays, "s.")).values()
        n = arrays["c.table"][arrays["c.code"]]
        contexts = codes // width
        first, last = int(contexts[0]), int(contexts[-1])
        at = contexts - first
        less = n - np.array(discounts)[np.minimum(n, 3)]
        taken = np.bincount(at, weights=less)
        for place, whole_context in zip((0, last - first), known, strict=True):
            if whole_context is not None:
                taken[place] = whole_context
        own = np.unique(at)
        size, left = np.ones(last + 1 - first), np.ones(last + 1 - first)
        size[own] = _take(model.levels[k - 2], own + first, "c")
        left[own] = np.maximum(1 - taken[own] / size[own], 1e-9)
        chance = less / size[at] + left[at] * 10.0 ** _shorter(model, k, contexts, codes % width)
        arrays["l.table"], arrays["l.code"] = coded(np.log10(chance), 256, n)
        arrays["w.table"], arrays["w.code"] = coded(np.log10(left), 256, size)
        done = f"{folder}/level{k}-{uuid.uuid4().hex}.bin"
        write_arrays(done, arrays)
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                done = finish(row["path"], (row["known_first"], row["known_last"]))
                yield pa.RecordBatch.from_pydict({"at": [row["at"]], "done": [done]})

    if not files:
        return [], widest
    told = [(i, f["path"], taken.get(f["first"]), taken.get(f["last"])) for i, f in enumerate(files)]
    tasks = spark.createDataFrame(told, "at long, path string, known_first double, known_last double")
    found = tasks.repartitionByRange(len(files), "at").mapInArrow(run, "at long, done string").collect()  # a row per file
    return [r["done"] for r in sorted(found, key=lambda r: r["at"])], widest


def _shorter(model: Model, k: int, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """log10 of the chance of each successor after the context less its first word."""
    if k == 2:
        return np.log10(_take(model.levels[0], successors, "c") + 1.0) + model.log_unit
    # The context's own last word as an n-gram: its code on its level names the words between and the last one.
    level = model.levels[k - 2]
    return _take(level, _first_of(level, _between(model, k, contexts)) + successors, "l")


def _between(model: Model, k: int, contexts: np.ndarray) -> np.ndarray:
    """The place on level k - 2 of each context (a place on level k - 1) without its first word."""
    level, width = model.levels[k - 2], model.widths[k - 2]
    codes = np.zeros(len(contexts), dtype=np.int64)
    for part, at in _split(level, contexts, by_context=False):
        codes[at] = Ascending.of_parts(group(map_arrays(part.path), "s.")).access(contexts[at] - part.before)
    if k == 3:
        return codes % width
    above = _between(model, k - 1, codes // width)
    return _first_of(model.levels[k - 3], above) + codes % width


def _discounts(counts_of_counts: list[int]) -> tuple[float, ...]:
    """What is taken from counts 1, 2 and more (at places 1, 2 and 3)."""
    n1, n2, n3, n4 = (max(x, 1) for x in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return (0.0, *(min(max(d, 0.1), c - 0.1) for c, d in enumerate(found, start=1)))


def train(docs: DataFrame, *, order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    """Learns from the texts of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(whole("text").alias("text"))
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    model, width = None, 1
    for k in range(1, order + 1):
        if model is not None:
            width = max(width, 1) if k > 2 else max(model.vocabulary, 1)
            if sum(part.n for part in model.levels[-1]) * width >= 2**63:
                raise ValueError("this level's n-grams do not fit into 63 bits; take a larger min_count or a smaller order")
            model = Model(model.tokens, model.vocabulary, model.levels, (*model.widths, width))
        seen = Observation()
        counted = _portions(texts, model, k).observe(seen, F.count(F.lit(1)).alias("rows"))
        # A portion's codes ascend: kept as differences they take about half the disk.
        counted.write.option("parquet.writer.version", "v2").parquet(f"{folder}/portions{k}")
        parts = spark.read.schema(counted.schema).parquet(f"{folder}/portions{k}")
        found = _merge(parts, seen.get["rows"], k, width, min_count if k > 1 else 1, folder if k == 1 else f"{folder}/merged{k}")
        remove_folder(spark, f"{folder}/portions{k}")
        *ns, total = np.array([r["counts"] for r in found], dtype=np.int64).reshape(-1, 5).sum(axis=0).tolist()
        files = [r for r in found if r["path"] is not None]
        paths = [r["path"] for r in files]
        if model is None:
            model = Model(total, sum(r["n"] for r in files), (), (1,))
        else:
            paths, width = _add_chances(spark, files, model, k, width, _discounts(ns), folder)
            remove_folder(spark, f"{folder}/merged{k}")
        ranges, before = [], 0
        for path, r in zip(paths, files, strict=True):
            ranges.append(Range(path, r["first"], r["last"], r["low"], r["high"], before, r["n"]))
            before += r["n"]
        model = Model(model.tokens, model.vocabulary, (*model.levels, tuple(ranges)), model.widths)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (both log10) of every row of ``docs``."""
    log_unit = model.log_unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, lengths in _sequences(batches, 1):
            at = _inside(lengths)
            found = _places(model, hashes, len(model.levels))
            known = found[0] >= 0
            n = np.zeros(len(hashes))
            n[known] = _take(model.levels[0], found[0][known], "c")
            base = np.log10(n + 1.0) + log_unit
            best = base.copy()
            # A token's longest known n-gram has the whole chance: below it nothing is looked up.
            longest = np.ones(len(hashes), dtype=np.int8)
            for k in range(2, len(model.levels) + 1):
                longest[(at >= k - 1) & (found[k - 1] >= 0)] = k
            for k in range(2, len(model.levels) + 1):
                context = np.concatenate([[-1], found[k - 2][:-1]])
                shorter = np.flatnonzero((longest < k) & (at >= k - 1) & (context >= 0))
                best[shorter] += _weight_of(model.levels[k - 1], context[shorter])
                here = np.flatnonzero(longest == k)
                best[here] = _take(model.levels[k - 1], found[k - 1][here], "l")
            row = np.repeat(np.arange(len(lengths)), lengths)[at > 0]
            total = lambda x: np.bincount(row, weights=x[at > 0], minlength=len(lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([r.column(0) for r in rows]),
                    pa.array(lengths - 1),
                    pa.array(total(known.astype(float)).astype(np.int64)),
                    pa.array(total(base)),
                    pa.array(total(best)),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
