from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pairmine.llm import simhash
from pairmine.llm.components import components

FOLDER = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=3):
    """{id: print} -> {id: smallest id reachable}, by comparing all pairs."""
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def signed(n):
    return n - 2**64 if n >= 2**63 else n


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "a b c", "a b c a b c", "É x É x y z " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_components(prints)
    got = {r.doc_id: (r["print"] % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
    stay = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert stay == sorted(set(want.values()))


@pytest.mark.parametrize("block", [4096, 3])
def test_links_of_a_dense_group(spark, block):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre, 0, 2**64 - 1, rng.getrandbits(64)}
    for _ in range(150):
        changed = centre
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            changed ^= 1 << bit
        prints.add(changed)
    table = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    links = simhash.links(table, block=block)
    pairs = links.collect()
    assert all((p.a ^ p.b).bit_count() <= 3 if p.a * p.b >= 0 else bin((p.a ^ p.b) % 2**64).count("1") <= 3 for p in pairs)
    roots = {r.node: r.root for r in components(links).collect()}
    want = plain_components({signed(p): p for p in prints})
    assert {i: roots.get(i, i) for i in want} == want


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, " ", 7), (None, "x y z w", 8), (9, "x " * 60000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print long")
    got = sorted(
        ((r.doc_id, r["print"], r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr
    )
    assert [g for g in got if g[1] == 0] == [(1, 0, 1), (2, 0, 1), (2, 0, 1), (None, 0, 1)]
    assert [g[2] for g in got if g[1] != 0 and g[0] is None] == [None]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "9", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.filter("doc_id > 99")).count() == 0


def test_texts_that_stay(spark):
    text = lambda i: " ".join(f"{w}{i}" for w in "abcdefgh")
    rows = [(None, text(i)) for i in range(40)]  # unrelated, without an id
    rows += [(1, text(100)), (7, text(100)), (7, text(101)), (7, text(102))]  # of id 7, one is a copy of another document
    rows += [(8, text(103)), (8, text(103)), (None, text(0)), (None, text(103))]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = [*rows[:40], (1, text(100)), (7, text(101)), (7, text(102)), (8, text(103))]
    assert sorted(map(repr, map(tuple, simhash.one_of_each(docs).collect()))) == sorted(map(repr, want))
    odd = spark.createDataFrame([(None, " "), (None, "x y z w"), (3, "")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(odd).collect()) == ["", "x y z w"]


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(14)]
    hub = [(1000, 1001 + i) for i in range(300)]
    links = spark.createDataFrame(path + hub + [(7, 7), (2000, 2000)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {i: 0 for i in range(15)} | {1000 + i: 1000 for i in range(301)}
    assert components(links.filter(F.lit(False))).count() == 0
