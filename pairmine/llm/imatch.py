"""Operator 1: I-Match fingerprints with randomised lexicons.

A document keeps its distinct terms whose inverse document frequency lies in a band (neither in every other document nor
almost unique), in sorted order, and hashes them: once whole (the classic fingerprint) and once per randomised lexicon
subset. The subsets are ``CHAINS`` families, each a nested series that keeps a half, an eighth, … of all terms by a hash of
the term. Two fingerprints are alike in a family if they agree on any subset that is not empty for them, so
the likeness is the share of families that agree: a change to some terms leaves the subsets that miss them.

Documents are counted per term (its 64-bit hash) over the whole corpus. The terms inside the band, at most e**7 times the mean number of
distinct terms of a document however large the corpus is, form a Bloom filter of ``TERM_BITS`` bits or more each and
``PROBES`` probes: the one thing that reaches the driver and every task. No term of the band is lost; of the others less than
one in 4,000 is let in.

The next document is found by cutting the order of doc_id into buckets at values that Spark's range partitioning gives, and
sending a copy of the first row of a bucket to the bucket before it; each text is shuffled once.

Only DataFrame functions are used. Defined results: a null text is empty; a text without a term in the band uses all
its distinct terms; without any term the fingerprint is all zero, and two such are alike; rows that repeat a doc_id
follow each other by a hash of their text; a null doc_id comes last; a single document is its own next; an
empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairmine.llm.common import whole
from pairmine.session import materialise

#: Terms stand between these two inverse document frequencies (natural logarithms): about 5 % and 0.1 % of the documents.
IDF_BAND = (3.0, 7.0)
#: Bits of the filter per term of the lexicon, and bits that are looked at.
TERM_BITS, PROBES = 32, 4
#: Families of subsets; each looks at bits of its own of a term's 64-bit hash.
CHAINS = 6
CHAIN_BITS = 10
#: How many of a family's bits must be zero: the subsets keep 1/2, 1/8, 1/32, 1/128 and 1/512 of all terms.
LEVELS = (1, 3, 5, 7, 9)
_SEPARATORS = r"[\s\p{Punct}]+"
_LAST = 2**63 - 1


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    found = F.filter(F.split(F.lower(text), _SEPARATORS), lambda t: t != "")
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def band_terms(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(term, n): hashes of the terms in the band, with the number of documents that hold them."""
    found = docs.select(F.explode(terms(whole("text"))).alias("term"))
    total = docs.count()
    least, most = total * math.exp(-band[1]), total * math.exp(-band[0])
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.col("n") <= most))


def places(h: Column, mask: int) -> list[Column]:
    """The bits of a term, by a hash of its own in steps of another."""
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(h.bitwiseAND(mask) + i * step).bitwiseAND(mask) for i in range(PROBES)]


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> list[int]:
    """The bitmap of the terms in the band, as longs; at least ``TERM_BITS`` bits per term."""
    kept = materialise(band_terms(docs, band).select("term"))
    size = max(10, math.ceil(math.log2(max(1, kept.count()) * TERM_BITS)))
    spots = kept.select(F.explode(F.array(*places(F.col("term"), 2**size - 1))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    bitmap = [0] * 2 ** (size - 6)
    for row in words.collect():  # at most 2**(size - 6) rows
        bitmap[row["at"]] = row["bits"]
    return bitmap


def fingerprint(text: Column, bitmap: list[int]) -> Column:
    """An array of longs: the hash of the whole set of terms, then one per family and subset; 0 for an empty subset."""
    bits = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")

    def inside(h: Column) -> Column:
        found = F.lit(True)
        for spot in places(h, 64 * len(bitmap) - 1):
            own = F.get(bits, F.shiftrightunsigned(spot, 6).cast("int"))
            found = found & (F.getbit(own, spot.bitwiseAND(63).cast("int")) == 1)
        return found

    def digest(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(hashes))

    def families(every: Column) -> Column:
        """Nested: each subset is taken from the one before it."""
        parts = [F.array(digest(every))]
        parts += [_series(every, chain, LEVELS, digest) for chain in range(CHAINS)]
        return F.concat(*parts)

    def chosen(every: Column) -> Column:
        return _let(F.filter(every, inside), lambda band: F.sort_array(F.when(F.size(band) == 0, every).otherwise(band)))

    return _let(terms(text), lambda every: _let(chosen(every), families))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _series(kept: Column, chain: int, levels: tuple[int, ...], digest) -> Column:
    mask = ((1 << levels[0]) - 1) << (chain * CHAIN_BITS)

    def with_rest(own: Column) -> Column:
        first = F.array(digest(own))
        return F.concat(first, _series(own, chain, levels[1:], digest)) if levels[1:] else first

    return _let(F.filter(kept, lambda h: h.bitwiseAND(F.lit(mask)) == 0), with_rest)


def likeness(a: Column, b: Column) -> Column:
    """Share of the families that agree on a subset which is not empty; 1 for equal fingerprints."""
    agree = F.lit(0)
    for chain in range(CHAINS):
        same = F.lit(False)
        for level in range(len(LEVELS)):
            at = 1 + chain * len(LEVELS) + level
            same = same | ((F.get(a, F.lit(at)) == F.get(b, F.lit(at))) & (F.get(a, F.lit(at)) != 0))
        agree = agree + F.when(same, 1).otherwise(0)
    return F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), F.lit(1.0)).otherwise(agree / F.lit(float(CHAINS)))


def as_text(prints: Column) -> Column:
    """The whole hash with 16 hexadecimal digits, then 8 of each subset."""
    first = F.lower(F.lpad(F.hex(F.get(prints, F.lit(0))), 16, "0"))
    rest = F.transform(
        F.slice(prints, 2, CHAINS * len(LEVELS)), lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(2**32 - 1)), 8, "0"))
    )
    return F.concat(first, F.array_join(rest, ""))


def _bucket_count(rows: int) -> int:
    """A bucket has 2,000 rows up to a million rows in all, and never more than 100,000 on average."""
    return max(1, math.ceil(rows / 100_000), min(math.ceil(rows / 2000), 500))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) with next_text, by descending doc_id; those with guard 1 only mark the end of a bucket."""
    order = F.coalesce(F.bitwise_not("doc_id"), F.lit(_LAST))
    rows = docs.select("doc_id", "text").withColumns({"k": order, "t": F.xxhash64("text")})
    count = _bucket_count(docs.count())
    edges = rows.select("k").repartitionByRange(count, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k"))
    lows = sorted(row["k"] for row in edges.collect())[1:]  # one per bucket
    step = max(1, math.isqrt(len(lows)))
    groups = [lows[i : i + step] for i in range(0, len(lows), step)]

    def longs(values: list[int]) -> str:
        return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)" if values else "array()"

    if lows:
        heads = longs([g[0] for g in groups])
        inner = "array(" + ",".join([longs([])] + [longs(g) for g in groups]).replace("array()", "cast(array() as array<bigint>)") + ")"
        rows = rows.withColumn("g", F.expr(f"size(filter({heads}, e -> e <= k))")).withColumn(
            "b", F.expr(f"g * {step + 1} + size(filter(get({inner}, g), e -> e <= k))")
        ).drop("g")
    else:
        rows = rows.withColumn("b", F.lit(0))
    first = rows.groupBy("b").agg(F.min(F.struct("k", "t")).alias("first"))
    everywhere = Window.partitionBy()
    before = F.coalesce(F.lag("b").over(everywhere.orderBy("b")), F.max("b").over(everywhere))
    heads = materialise(first.select("first", F.col("b").alias("hb"), before.alias("before")))
    heads = heads.select("hb", "before", F.col("first.k").alias("hk"), F.col("first.t").alias("ht"))
    dealt = rows.join(
        heads, (F.col("b") == F.col("hb")) & (F.col("k") == F.col("hk")) & (F.col("t") == F.col("ht")), "left"
    )
    # The copy that goes to the bucket before (or, for a single bucket, to its own end) comes after all the rows there.
    two = F.posexplode(F.when(F.col("before").isNull(), F.array("b")).otherwise(F.array("b", "before"))).alias("guard", "at")
    dealt = dealt.select("doc_id", "text", "k", "t", two)
    window = Window.partitionBy("at").orderBy("guard", "k", "t")
    return dealt.withColumn("next_text", F.lead("text").over(window))


def edited(text: Column, other: Column, n_chars: Column) -> Column:
    """The last third of a text replaced by the beginning of another."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n_chars.cast("int") - third), F.substr(other, F.lit(1), third))


def edited_fingerprints(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of its edited text, and how alike they and the next document's are."""
    plain = docs.select("doc_id", whole("text").alias("text"))
    bitmap = lexicon(plain, band)
    rows = (
        with_next(plain)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", edited(F.col("text"), F.col("next_text"), F.col("n_chars")))
        .select(
            "doc_id", "n_chars", "at", "guard", "k", "t",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("text"), bitmap).alias("own"),
            F.when(F.col("guard") == 0, fingerprint(F.col("edited"), bitmap)).alias("changed"),
        )
    )
    window = Window.partitionBy("at").orderBy("guard", "k", "t")
    return (
        rows.withColumn("after", F.lead("own").over(window))
        .filter("guard = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("after")).alias("near_next"),
        )
    )
