"""Operator 6: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in three bits or fewer, one
segment differs in one bit at most. Every segment is indexed by its 32 variants with one bit taken out, so
that the two meet under an equal key: (segment, place of the missing bit, the other 31 bits). What meets is verified on
all 64 bits.

Fingerprints are made distinct first: exact copies never meet each other. Under one key the fingerprints are compared in
blocks inside the task, and only links that join different parts come out, at most one less than there are
fingerprints: what is needed for the components, not all pairs. A key with more than ``BLOCK`` fingerprints is
put aside and dealt into blocks, each pair of blocks being one bounded piece of work for any task.

Defined results: a null or empty text, or one without words, has fingerprint zero, which is linked like any other; one or two
words are a single shingle; rows that repeat a doc_id keep a row each; a null doc_id is never the smallest, unless a
component has no other (then component_id is null); an empty table gives an empty table. Other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import whole
from pairmine.llm.components import components
from pairmine.session import materialise

SHINGLE = 3
SEED = 42
BITS = 3
BLOCK = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text, unsigned."""
    # bytes.split() without an argument cuts at exactly the six white-space bytes.
    found = text.encode("utf-8").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) < shingle:
        pieces = [b" ".join(found)]
    else:
        pieces = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, print long")


def variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 64 one-bit-deleted segments of each fingerprint, and the fingerprints beside them."""
    keys = []
    for segment in range(2):
        half = (prints >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
        for place in range(32):
            low = half & np.uint64((1 << place) - 1)
            high = half >> np.uint64(place + 1)
            keys.append((high << np.uint64(place)) | low | np.uint64((segment * 32 + place) << 31))
    return np.concatenate(keys), np.tile(prints, 64)


def spanning(a: np.ndarray, b: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Links of ``bits`` differing bits or fewer that span what they connect: within ``a``, or between ``a`` and ``b``."""
    nodes = a if b is None else np.concatenate([a, b])
    parent = list(range(len(nodes)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i in range(len(a)):
        start = i + 1 if b is None else len(a)
        close = np.flatnonzero(np.bitwise_count(nodes[start:] ^ a[i]) <= bits)
        for j in close + start:
            x, y = top(i), top(int(j))
            if x != y:
                parent[x] = y
                found.append((i, int(j)))
    return [(int(nodes[i].view(np.int64)), int(nodes[j].view(np.int64))) for i, j in found]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Runs of equal keys of a sorted partition, over the borders of batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        changed = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
        for column in columns[:keys]:
            changed |= column[1:] != column[:-1]
        cuts = np.flatnonzero(changed) + 1
        if len(cuts):
            yield cuts, [c[: cuts[-1]] for c in columns]
            held = [c[cuts[-1] :] for c in columns]
        else:
            held = columns
    if held is not None and len(held[0]):
        yield np.array([len(held[0])]), held


def links(prints: DataFrame, *, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in ``bits`` bits or fewer and span the components.

    ``prints``: one column of distinct fingerprints. Three bits are what two segments with one missing bit can find.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one missing bit find at most three differing bits")
    schema = "key long, print long"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(values), 4096):
                keys, owners = variants(values[start : start + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], names=["key", "print"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cuts, (keys, owners) in _runs(batches, 1):
            first, second, aside = [], [], []
            starts = np.concatenate([[0], cuts[cuts < len(keys)]])
            ends = np.append(starts[1:], len(keys))
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                if e - s > block:
                    aside.append((keys[s], owners[s:e]))
                    continue
                for x, y in spanning(owners[s:e].view(np.uint64), None, bits):
                    first.append(x)
                    second.append(y)
            a = np.concatenate([np.array(first, dtype=np.int64), *(own for _, own in aside)])
            b = np.concatenate([np.array(second, dtype=np.int64), *(np.zeros(len(own), np.int64) for _, own in aside)])
            key = np.concatenate([np.full(len(first), -1), *(np.full(len(own), k) for k, own in aside)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key)], names=["a", "b", "key"])

    indexed = prints.select("print").mapInArrow(index, schema)
    met = materialise(
        indexed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, key long")
    )
    near = met.filter("key = -1").select("a", "b").distinct()
    aside = met.filter("key <> -1").select("key", F.col("a").alias("print"))
    if aside.isEmpty():
        return near
    return near.union(_in_blocks(aside, bits, block)).distinct()


def _in_blocks(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """Links under keys with very many fingerprints: (key, print) dealt into blocks, a pair of blocks at a time."""
    blocks = materialise(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    dealt = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "print"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cuts, (_, low, high, own, prints) in _runs(batches, 3):
            found = []
            starts = np.concatenate([[0], cuts[cuts < len(own)]])
            for s, e in zip(starts, np.append(starts[1:], len(own)), strict=True):
                here, side = prints[s:e].view(np.uint64), own[s:e]
                if low[s] == high[s]:
                    found += spanning(here, None, bits)
                else:
                    found += spanning(here[side == low[s]], here[side == high[s]], bits)
            both = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    sorted_pairs = pairs.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return sorted_pairs.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, print, component_id) for each row of ``docs``: component_id is the smallest doc_id reachable."""
    prints = materialise(fingerprints(docs, shingle))
    distinct = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    found = materialise(components(links(distinct, bits=bits, block=block)))
    rooted = materialise(
        distinct.join(found, F.col("print") == F.col("node"), "left").select(
            "print", "first", F.coalesce("root", "print").alias("root")
        )
    )
    smallest = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = materialise(rooted.join(smallest, "root").select("print", "component_id"))
    return prints.join(classes, "print").select("doc_id", "print", "component_id")


def one_of_each(docs: DataFrame, *, shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    A null doc_id comes last; of rows with this doc_id and other texts, the one with the smallest hash of the text stays. Rows
    that share a doc_id, or have none, are documents of their own; only those that repeat doc_id and text are one. Of these the row
    with the smallest hash of the other columns stays (columns that hold maps do not count). Columns of any name are kept.
    """
    own = "simhash_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = f"_{own}"
    known = [own + name for name in ("none", "id", "mark", "rest")]
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind]
    ident = F.col("doc_id").cast("long")
    named = docs.select(
        "*",
        ident.isNull().alias(known[0]),
        F.coalesce(ident, F.lit(0)).alias(known[1]),
        F.xxhash64(whole("text")).alias(known[2]),
        F.xxhash64(F.lit(0), *others).alias(known[3]),
    )
    texts = named.select(F.struct(*known).alias("own"), whole("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["own", "print"]
            )

    schema = f"own struct<{known[0]}: boolean, {known[1]}: long, {known[2]}: long, {known[3]}: long>, print long"
    distinct = materialise(texts.mapInArrow(run, schema).groupBy("print").agg(F.min("own").alias("own")))
    found = materialise(components(links(distinct, bits=bits, block=block)))
    rooted = distinct.join(found, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    keepers = materialise(rooted.groupBy("root").agg(F.min("own").alias("own")).select("own.*"))
    kept = named.join(keepers, known, "left_semi").dropDuplicates(known)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
