"""Operator 11: plain patterns on every text, what is scanned in later runs, and rows out of the ordinary."""

from __future__ import annotations

import hashlib
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pairmine.llm import queries, secrets

FOLDER = "/root/testdata/sf0.01"


def plain_spans(text):
    """The three kinds as they are defined, without a length in the pattern."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, kind, e) for s, _, kind, e in sorted(found)]


def spans(row):
    return [tuple(f) for f in row.findings]


TEXTS = [
    None,
    "",
    "password = hunter22 and PASSWD:'abcdef",
    "paſsword=longenough ToKen=longenough",  # letters that only folding makes alike
    "password: token: abcdefgh",  # the first match is too short and takes the second's place
    "api_key=" + "0123456789abcdef" * 3 + " apikey:short",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 14,
    "é\U0001f600 " + "ab" * 12 + " " + "ab" * 11 + "a",
    "secret" + " " * 5000 + "= value1 " + "deadbeef" * 5000,
    'token = "' + "f" * 40 + '"',
]


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op11_secret_ledger(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = ",".join(f"{kind}:{s}:{e}" for s, kind, e in plain_spans(texts[r.doc_id]))
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
    assert any(r.spans for r in rows)


def test_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, blob string")
    rows = {r.doc_id: spans(r) for r in secrets.scan(docs, str(tmp_path / "ledger")).collect()}
    assert rows == {i: plain_spans(t or "") for i, t in enumerate(TEXTS)}
    assert rows[6] == [(20, "access", 40), (41, "access", 63)] and len(rows[4]) == 0 and rows[8]


def test_history(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    history = [("a", 1, "token=first1"), ("a", 2, "token=second2"), ("b", 1, "token=first1"), ("c", 1, None)]
    versions = spark.createDataFrame(history, "path string, version int, text string")
    ledger = secrets.open_ledger(spark, folder)
    blobs = versions.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    assert secrets.unseen(blobs, ledger).count() == 3

    def scanned():
        return sum(len(r.scanned) for r in secrets.open_ledger(spark, folder).collect())

    first = secrets.scan(versions, folder, path=("path", "version"))
    assert {(r.path, r.version): spans(r) for r in first.collect()} == {
        ("a", 1): [(0, "assign", 12)], ("a", 2): [(0, "assign", 13)], ("b", 1): [(0, "assign", 12)], ("c", 1): []
    }
    assert scanned() == 3 * 3  # three texts, three rules
    more = versions.union(spark.createDataFrame([("d", 1, "token=second2"), ("d", 2, "deadbeef" * 3)], versions.schema))
    second = secrets.scan(more, folder, path=("path", "version"))
    assert {r.path + str(r.version): spans(r) for r in second.collect()}["d2"] == [(0, "hex", 24)]
    assert scanned() == 4 * 3  # one new text
    assert secrets.scan(more, folder, path=("path", "version")).count() == 6 and scanned() == 12

    assign, access, hexes = secrets.RULES
    changed = [replace(assign, version=2, least=7), access, hexes, secrets.Rule("word", 1, "second", 1)]
    third = {r.path + str(r.version): spans(r) for r in secrets.scan(more, folder, rules=changed, path=("path", "version")).collect()}
    assert scanned() == 12 + 4 * 2  # a rule's new version and a new rule, for each text
    assert third == {
        "a1": [], "a2": [(0, "assign", 13), (6, "word", 12)], "b1": [], "c1": [], "d1": [(0, "assign", 13), (6, "word", 12)],
        "d2": [(0, "hex", 24)],
    }
    # what is written twice, as by two runs at once, is found once
    secrets.open_ledger(spark, folder).write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(folder)
    again = secrets.scan(more, folder, rules=changed, path=("path", "version")).collect()
    assert {r.path + str(r.version): spans(r) for r in again} == third


def test_copies_and_empty_tables(spark, tmp_path):
    copies = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("api_key: abcdef").alias("text"))
    found = secrets.scan(copies.repartition(8), str(tmp_path / "ledger"))
    assert found.groupBy("findings").count().collect()[0]["count"] == 3000
    assert secrets.open_ledger(spark, str(tmp_path / "ledger")).count() == 1
    assert secrets.scan(copies.limit(0), str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="blob"):
        secrets.scan(copies.withColumn("blob", F.lit(1)), str(tmp_path / "none"), path=("blob",))
