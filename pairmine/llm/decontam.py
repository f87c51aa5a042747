"""Operator 5: benchmark decontamination by template canonicalisation.

A word becomes a token without its outer punctuation and in lower case, or a typed placeholder: a number, a name (a
capitalised word that does not begin a sentence) or a unit (a listed word after a number). Windows of five tokens of
the whole document are joined by hash with those of the benchmark items, and the tokens of both are compared, so that a
hash alone decides nothing. Matches of a document with an item are lined up by the difference of their places.

A document leaks an item if it holds ``SHARE`` of the item's windows, or an unbroken run of ``RUN_WORDS`` words of it (or all the
item, if that is shorter), counting only lines whose slots are consistent: a value of the item stands for the same
value of the document throughout. A question with other numbers and names is caught; text that only looks alike in its
placeholders is not.

Beside the templates, the words themselves are joined: runs of ``RUN_WORDS`` lower-cased words without placeholders (or all the
item, if that is shorter), whatever they are. So a copy in other case, or an item of names and numbers only, is a leak too.

The documents are sifted before the join by a bitmap of the benchmark's window hashes. It has 2**FILTER_BITS bits whatever
the benchmark's size; a larger benchmark lets more windows through to the join, and the result is the same.

Defined results: a null or empty text on either side has no tokens; an item below five tokens is one window as long as itself;
an item of fewer than ``LEAST_WORDS`` words is leaked only by a
document that has just these words; templates without ``MIN_LITERALS`` plain tokens say nothing; rows that repeat a doc_id with another text are documents of their
own; an empty table on either side gives no leaks. Other columns of the inputs are ignored, and kept by ``remove_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairmine.llm.common import whole
from pairmine.session import materialise

WINDOW = 5
SHARE = 0.8
RUN_WORDS = 13
MIN_LITERALS = 2
LEAST_WORDS = 3
CONSISTENT = 0.8
FILTER_BITS = 22
BROADCAST_WINDOWS = 100_000

PLACEHOLDERS = ("", "<number>", "<name>", "<unit>")
#: Words that are a unit when they follow a number.
UNITS = frozenset(
    """% percent kg g mg lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yd yards s sec second seconds min minute
    minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents $ € £
    l ml liter liters litre litres gallon gallons mph km/h degree degrees meter meters metre metres kilometer
    kilometers kilogram kilograms gram grams pound pounds ounce ounces""".split()
)
_NUMBER = r"^(?:[$€£+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)$"
_ENDS = r"(?s)(?:[.!?:]|[.!?].)$"
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%") + "“”‘’«»¿¡…–—"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(WINDOW, 0, -1)], dtype=np.uint64)
_PORTION = 2_000_000

_SCHEMA = "id long, mark long, at int, size int, exact boolean, hash long, template string, values array<string>, words int, windows int"


class Canonical:
    """Some texts as tokens: all words of all texts in one go, each different word looked at once.

    ``begin``: for each text the place of its first word, and one more. Words that are only punctuation are no words.
    ``tokens`` are hashes of the words or kinds of placeholders (places in ``PLACEHOLDERS``; 0 is a plain word), ``bare`` hashes of
    the words themselves.
    """

    def __init__(self, texts: pa.Array) -> None:
        by_text = pc.split_pattern(texts, "\n")
        by_line = pc.ascii_split_whitespace(by_text.flatten())
        pieces = by_line.flatten()
        some = pc.greater(pc.binary_length(pieces), 0)
        upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        lines = upto[by_line.offsets.to_numpy()]
        ends = lines[by_text.offsets.to_numpy()]
        coded = pieces.filter(some).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        different = coded.dictionary
        trimmed = pc.utf8_trim(different, characters=_OUTER)
        self._plain = pc.utf8_lower(trimmed)
        flags = (
            pc.match_substring_regex(self._plain, pattern=_NUMBER),
            pc.is_in(self._plain, value_set=pa.array(sorted(UNITS))),
            pc.utf8_is_upper(pc.utf8_slice_codeunits(trimmed, 0, 1)),
            pc.match_substring_regex(different, pattern=_ENDS),
            pc.greater(pc.binary_length(trimmed), 0),
        )
        number, unit, capital, stop, keep = (f.to_numpy(zero_copy_only=False).astype(bool)[at] for f in flags)
        first = np.zeros(len(at) + 1, dtype=bool)
        first[ends] = True
        begins = np.zeros(len(at) + 1, dtype=bool)
        begins[lines] = True
        begins[1:] |= stop
        measured = np.zeros(len(at), dtype=bool)
        measured[1:] = unit[1:] & number[:-1] & ~first[1:-1]
        named = capital & ~number & ~begins[:-1]
        kinds = np.where(number, 1, np.where(measured, 3, np.where(named, 2, 0))).astype(np.int8)
        self.begin = np.concatenate([[0], np.cumsum(keep)])[ends]
        self._at = at[keep]
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self._plain.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        self.kinds, self.bare = kinds[keep], hashes[self._at]
        self.tokens = np.where(self.kinds == 0, self.bare, self.kinds.astype(np.uint64))

    def plain(self, start: int, stop: int) -> list[str]:
        return self._plain.take(pa.array(self._at[start:stop])).to_pylist()


def canonical(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a text that are more than punctuation: bare forms, token hashes, kinds and hashes of the bare forms."""
    made = Canonical(pa.array([text], pa.string()))
    return made.plain(0, len(made.bare)), made.tokens, made.kinds, made.bare


def windows(hashes: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of ``size`` tokens that have plain tokens enough."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mixed = np.full(n, size, dtype=np.uint64)
    plain = np.zeros(n, dtype=np.int64)
    for k in range(size):
        mixed += hashes[k : k + n] * _FACTORS[k]
        plain += kinds[k : k + n] == 0
    mixed ^= mixed >> np.uint64(29)
    at = np.flatnonzero(plain >= min(MIN_LITERALS, size))
    return at, mixed[at]


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, dtype=np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


def exact_windows(words: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, the hashes of all runs of that many words, modulo 2**64 from running sums."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
    back = _powers(_INVERSE, len(words))
    for size in sizes:
        n = max(len(words) - size + 1, 0)
        mixed = (sums[size : size + n] - sums[:n]) * back[:n]
        yield size, mixed ^ (mixed >> np.uint64(29))


def _extract(sizes: tuple[tuple[int, ...], tuple[int, ...]] | None, bitmap: np.ndarray | None):
    """Rows of windows: all of them for items (``sizes`` None), those the bitmap lets through for documents.

    ``sizes``: those of the templates, and those of the exact runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for idents, marks, texts in _portions(batch):
                made = Canonical(texts)
                for k, (ident, mark) in enumerate(zip(idents, marks, strict=True)):
                    begin, total_words = int(made.begin[k]), int(made.begin[k + 1] - made.begin[k])
                    own = slice(begin, begin + total_words)
                    few, runs = sizes or ((min(WINDOW, max(total_words, 1)),), (min(RUN_WORDS, max(total_words, 1)),))
                    found = [(False, size, *windows(made.tokens[own], made.kinds[own], size)) for size in few]
                    found += [(True, size, np.arange(len(mixed)), mixed) for size, mixed in exact_windows(made.bare[own], runs)]
                    for exact, size, at, mixed in found:
                        total = len(at)
                        if bitmap is not None:
                            low = mixed & np.uint64(2**FILTER_BITS - 1)
                            word = bitmap[(low >> np.uint64(6)).astype(np.int64)]
                            hit = (word >> (low & np.uint64(63))) & np.uint64(1) == 1
                            at, mixed = at[hit], mixed[hit]
                        for i, h in zip(at.tolist(), mixed.view(np.int64).tolist(), strict=True):
                            plain = made.plain(begin + i, begin + i + size)
                            kinds = made.kinds[begin + i : begin + i + size].tolist()
                            template = " ".join(plain if exact else [PLACEHOLDERS[n] or w for w, n in zip(plain, kinds, strict=True)])
                            values = [] if exact else [w for w, n in zip(plain, kinds, strict=True) if n]
                            rows.append((ident, mark, i, size, exact, h, template, values, total_words, total))
                    if len(rows) >= 20_000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return run


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list, pa.Array]]:
    """The batch's columns in pieces whose texts have about ``_PORTION`` bytes together, or are one text."""
    sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= _PORTION or i == len(sizes) - 1:
            part = batch.slice(start, i + 1 - start)
            yield part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)
            start, total = i + 1, 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32())
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _marked(table: DataFrame, ident: str) -> DataFrame:
    text = whole("text")
    return table.select(F.col(ident).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _bitmap(items: DataFrame) -> np.ndarray:
    """The low bits of all window hashes of the benchmark, as a bitmap of fixed size."""
    low = F.col("hash").bitwiseAND(2**FILTER_BITS - 1)
    found = (
        items.select(F.shiftright(low, 6).cast("int").alias("at"), low.bitwiseAND(63).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    bitmap = np.zeros(2 ** (FILTER_BITS - 6), dtype=np.int64)
    for row in found.collect():  # at most 2**(FILTER_BITS - 6) rows
        bitmap[row["at"]] = row["bits"]
    return bitmap.view(np.uint64)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per leaking document and item: doc_id, mark (hash of the text), item_id, matched, windows, run_words, slots.

    The figures are those of the templates, or of the exact runs if only those tell.
    """
    items = materialise(_marked(benchmark, "item_id").mapInArrow(_extract(None, None), _SCHEMA))
    counted = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("exact", "size")).alias("sizes")).first()
    few, runs = (tuple(sorted(r["size"] for r in counted["sizes"] if r["exact"] == kind)) for kind in (False, True))
    sizes = (few, runs)
    sifted = _marked(docs, "doc_id").mapInArrow(_extract(sizes, _bitmap(items)), _SCHEMA)
    item_side = items.select(
        F.col("id").alias("item_id"),
        F.col("mark").alias("item_mark"),
        F.col("at").alias("item_at"),
        F.col("hash").alias("item_hash"),
        F.col("template").alias("item_template"),
        F.col("values").alias("item_values"),
        F.col("words").alias("item_words"),
        F.col("windows").alias("item_windows"),
        "size",
        "exact",
    )
    if counted["n"] <= BROADCAST_WINDOWS:
        item_side = F.broadcast(item_side)
    doc_side = sifted.select(
        F.col("id").alias("doc_id"), "mark", "at", F.col("hash").alias("item_hash"), "template", "values", "size", "exact", "words"
    )
    met = doc_side.join(item_side, ["item_hash", "size", "exact"]).filter(F.col("template") == F.col("item_template"))
    met = met.filter((F.col("item_words") >= LEAST_WORDS) | (F.col("words") == F.col("item_words")))
    key = ["doc_id", "mark", "item_id", "item_mark", "item_words", "item_windows", "size", "exact"]
    # Rows that repeat others on either side are met once.
    met = materialise(
        met.select(*key, "item_at", (F.col("at") - F.col("item_at")).alias("line"), "values", "item_values").distinct()
    )
    line = [*key, "line"]
    order = Window.partitionBy(*line).orderBy("item_at")
    runs = (
        met.withColumn("island", F.col("item_at") - F.row_number().over(order))
        .groupBy(*line, "island")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*line)
        .agg(F.max("n").alias("run"))
    )
    slots = (
        met.select(*line, F.explode_outer(F.arrays_zip("item_values", "values")).alias("slot"))
        .groupBy(*line)
        .agg(F.size(F.collect_set("slot")).alias("pairs"), F.size(F.collect_set("slot.item_values")).alias("slots"))
        .filter((F.col("pairs") == 0) | (F.col("slots") >= CONSISTENT * F.col("pairs")))
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in line]
    sound = runs.alias("a").join(slots.alias("b"), same).select("a.*", "slots")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in line]
    held = (
        met.select(*line, "item_at")
        .alias("a")
        .join(sound.alias("b"), same)
        .groupBy(*(F.col(f"a.{c}") for c in key))
        .agg(
            F.size(F.collect_set("a.item_at")).cast("long").alias("matched"),
            (F.max("b.run") + F.col("a.size") - 1).cast("long").alias("run_words"),
            F.max("b.slots").cast("long").alias("slots"),
        )
    )
    leaked = (F.col("matched") >= SHARE * F.col("item_windows")) | (
        F.col("run_words") >= F.least(F.lit(RUN_WORDS), F.col("item_words"))
    )
    told = ["matched", F.col("item_windows").cast("long").alias("windows"), "run_words", "slots"]
    one = held.filter(leaked).groupBy("doc_id", "mark", "item_id", "item_mark").agg(F.min(F.struct("exact", *told)).alias("told"))
    return one.select("doc_id", "mark", "item_id", "told.matched", "told.windows", "told.run_words", "told.slots")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    leaks = materialise(
        find_leaks(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("mark").alias("leak_mark")).distinct()
    )
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("leak_id")) & (F.xxhash64(whole(docs["text"])) == F.col("leak_mark"))
    return docs.join(leaks, same, "left_anti")
