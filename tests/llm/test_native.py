"""Operators 1, 2, 3 and 9: brute force, SQL, and rows that are out of the ordinary."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import compare
from pairmine.llm import imatch, lines, mixing, queries, sharding
from pairmine.llm.common import held_out, running_before
from pairmine.llm.sql import oracle_sql

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 int, before string, b int"


def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns with names the operators use."""
    rows = [
        (5, "One shared line here\nown line of five", "en", "a", 3, 1, "x", 1),
        (5, "One shared line here\nown line of five", "en", "a", 3, 1, "x", 1),
        (4, "ONE SHARED LINE HERE \n\nshort", "en", None, 3, 1, None, None),
        (None, "one shared line here", None, None, None, None, None, None),
        (7, None, "en", "b", 0, 1, "x", 1),
        (8, "", "en", "b", 0, 1, "x", 1),
        (9, "long word " * 40000 + "\n" + "y" * 100000, "en", "b", 0, 1, "x", 1),
        (2, " \t\n\x0b ", "", "", 0, 1, "x", 1),
        (1, "Éa É😀 b", "fr", "é", 0, 1, "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    con = compare.connect(FOLDER)
    df = queries.queries()[name](spark, FOLDER)
    cursor = con.execute(oracle_sql()[name])
    theirs = compare.canonical(cursor.fetchall(), [c[0] for c in cursor.description])
    assert compare.canonical([tuple(r) for r in df.collect()], df.columns) == theirs


def plain_lines(docs):
    last = 2**63 - 1
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(last if i is None else i)
    found = []
    for i, text in docs:
        every = (text or "").split("\n")
        own = last if i is None else i
        kept = [x for x in every if len(holders[key(x)]) < 2 or min(holders[key(x)]) == own]
        found.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return sorted(found, key=repr)


def test_lines_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = [tuple(r) for r in lines.dedup_lines(docs).select("doc_id", "kept", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_with_a_higher_threshold(spark):
    docs = spark.createDataFrame([(i, "a line of text\nb line of text" if i < 2 else "a line of text") for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in lines.dedup_lines(docs, min_documents=3).collect()}
    assert got == {0: "a line of text\nb line of text", 1: "b line of text", 2: "", 3: ""}


def test_water_filling(spark):
    sources = spark.createDataFrame([("a", 1.0, 10), ("b", 1.0, 100), ("c", 8.0, 20), ("d", 0.0, 50)], "mix_source string, mix_weight double, mix_source_size long")
    targets = lambda total: {r.mix_source: r.mix_target for r in mixing.water_fill(sources, total, 3).collect()}
    assert targets(20) == {"a": 2, "b": 2, "c": 16, "d": 0}
    assert targets(100) == {"a": 20, "b": 20, "c": 60, "d": 0}
    assert targets(200) == {"a": 30, "b": 110, "c": 60, "d": 0}
    assert targets(10_000) == {"a": 30, "b": 300, "c": 60, "d": 0}
    assert targets(0) == {"a": 0, "b": 0, "c": 0, "d": 0}


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in got:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += r.mix_size
    taken = Counter()
    for r in got:
        assert r.mix_source_size == sizes[r.source] and 0 <= r.mix_taken <= 3 * r.mix_size
        taken[r.source] += r.mix_taken
    for r in got:
        assert abs(taken[r.source] - r.mix_target) <= 0.5
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.repeat_documents(docs)
    assert mixed.columns == docs.columns
    assert mixing.repeat_documents(docs.limit(0)).count() == 0


def test_mix_in_many_buckets(spark, monkeypatch):
    docs = spark.range(500).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
    )
    columns = ["doc_id", "mix_target", "mix_taken"]
    one = sorted(map(tuple, mixing.mix(docs).select(columns).collect()))
    monkeypatch.setattr(mixing, "buckets_for", lambda rows, each=0: 37)
    assert sorted(map(tuple, mixing.mix(docs).select(columns).collect())) == one
    copies = Counter(r.doc_id for r in mixing.repeat_documents(docs).collect())
    for r in mixing.mix(docs).collect():
        assert abs(copies[r.doc_id] * r.mix_size - r.mix_taken) <= r.mix_size / 2


def check_shards(rows, shards, source="source"):
    by = defaultdict(list)
    for r in rows:
        by[r.shard_no].append(r)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s, own in by.items():
        assert sorted(r.shard_slot for r in own) == list(range(len(own)))
    total = Counter(r[source] for r in rows)
    for own in by.values():
        here = Counter(r[source] for r in own)
        for name, n in total.items():
            # A stretch of the order holds its part of each source, give or take what the phases of the others shift.
            assert abs(here[name] - n * len(own) / len(rows)) <= 2 + math.sqrt(len(total))


@pytest.mark.parametrize("buckets", [1, 29])
def test_interleaving(spark, monkeypatch, buckets):
    docs = spark.range(700).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    monkeypatch.setattr(sharding, "buckets_for", lambda rows, each=0: buckets)
    rows = sharding.interleave(docs, 24).collect()
    check_shards(rows, 24)
    again = sharding.interleave(docs.repartition(7), 24).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_interleaving_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = sharding.interleave(docs, 4).collect()
    assert len(rows) == docs.count()
    assert max(Counter(r.shard_no for r in rows).values()) - min(Counter(r.shard_no for r in rows).values()) <= 1
    assert sharding.interleave(docs, 4).columns == [*docs.columns, "shard_no", "shard_slot"]
    assert sharding.interleave(docs.limit(0), 4).count() == 0
    assert {(r.doc_id, r.size, r.text_crc32) for r in sharding.sized(docs).collect()} == {
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()
    }


def test_shards_of_the_table(spark):
    rows = queries.op9_interleaved_shards(spark, FOLDER).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def plain_terms(text):
    return list(dict.fromkeys(xxhash.xxh64_intdigest(t.encode(), 42) for t in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if t))


def in_filter(h, bitmap):
    mask = 64 * len(bitmap) - 1
    spots = [((h & mask) + i * (h >> 32 | 1)) & mask for i in range(imatch.PROBES)]
    return all(bitmap[spot >> 6] >> (spot & 63) & 1 for spot in spots)


def plain_print(text, bitmap):
    """The definition, term by term."""
    every = plain_terms(text)
    band = [h for h in every if in_filter(h, bitmap)] or every

    def digest(hashes):
        if not hashes:
            return 0
        seed = 42
        for h in sorted(hashes, key=lambda x: x - 2**64 if x >= 2**63 else x):
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    found = [digest(band)]
    for chain in range(imatch.CHAINS):
        kept = band
        for bits in imatch.LEVELS:
            kept = [h for h in kept if not h >> (chain * imatch.CHAIN_BITS) & ((1 << bits) - 1)]
            found.append(digest(kept))
    return found


def as_text(prints):
    return f"{prints[0]:016x}" + "".join(f"{p % 2**32:08x}" for p in prints[1:])


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    n = len(imatch.LEVELS)
    agree = sum(any(a[i] == b[i] != 0 for i in range(1 + c * n, 1 + c * n + n)) for c in range(imatch.CHAINS))
    return agree / imatch.CHAINS


def check_imatch(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    bitmap = [b % 2**64 for b in imatch.lexicon(docs)]
    want = []
    for i, (ident, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = (plain_print(t, bitmap) for t in (text, edited, following))
        want.append((ident, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), plain_likeness(a, b), plain_likeness(a, c)))
    got = [tuple(r) for r in imatch.edited_fingerprints(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("buckets", [1, 9])
def test_imatch_against_brute_force(spark, monkeypatch, buckets):
    monkeypatch.setattr(imatch, "_bucket_count", lambda rows: buckets)
    check_imatch(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_imatch_of_odd_documents(spark):
    docs = odd_documents(spark).filter("doc_id is null or doc_id <> 9")
    check_imatch(spark, docs)
    check_imatch(spark, docs.filter("doc_id = 1"))
    assert imatch.edited_fingerprints(docs.limit(0)).count() == 0
    assert imatch.edited_fingerprints(odd_documents(spark)).count() == 9


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_lexicon_is_the_band_by_term(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = Counter(h for r in docs.select("text").collect() for h in plain_terms(r.text or ""))
    total = docs.count()
    band = {h for h, n in counts.items() if total * math.exp(-7) <= n <= total * math.exp(-3)}
    assert {r.term % 2**64: r.n for r in imatch.band_terms(docs).collect()} == {h: counts[h] for h in band}
    bitmap = [b % 2**64 for b in imatch.lexicon(docs)]
    let_in = {h for h in counts if in_filter(h, bitmap)}
    assert band <= let_in and len(let_in) - len(band) <= 0.01 * len(band)


def test_lexicon_band(spark):
    rng = random.Random(0)
    texts = [" ".join(["the", f"rare{i}", f"mid{rng.randrange(30)}"]) for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bitmap = [b % 2**64 for b in imatch.lexicon(docs)]
    inside = lambda t: in_filter(xxhash.xxh64_intdigest(t.encode(), 42), bitmap)
    assert inside("mid3") and not inside("the")
    assert sum(inside(f"rare{i}") for i in range(300)) < 10


def test_helpers(spark):
    ids = spark.createDataFrame([(1,), (2,), (None,), (40,)], "doc_id long")
    assert [r[0] for r in ids.select(held_out("doc_id", 4)).collect()] == [
        zlib.crc32(b"1") % 4 == 2, zlib.crc32(b"2") % 4 == 2, False, zlib.crc32(b"40") % 4 == 2,
    ]
    counts = spark.createDataFrame([(0, 5), (2, 7), (9, 1)], "b int, n long")
    assert {r.b: r.before for r in running_before(counts, "b", "n").collect()} == {0: 0, 2: 5, 9: 12}
