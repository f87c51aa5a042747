"""Operator 10: Elias-Fano sequences against plain arrays, the model against a plain one, and odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairmine.llm import eliasfano, ngram, queries

FOLDER = "/root/testdata/sf0.01"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 40), st.lists(st.integers(0, 300000), max_size=50))
def test_sequences(values, shift, asked):
    values = np.sort(np.array(values, dtype=np.int64)) << shift
    coded = eliasfano.Ascending.build(values, (5001 << shift) + 1)
    assert coded.access(np.arange(len(values))).tolist() == coded.values().tolist() == values.tolist()
    asked = np.sort(np.concatenate([np.array(asked, dtype=np.int64), values, values + 1]))
    asked = asked[asked <= 5001 << shift]
    assert coded.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    held = set(values.tolist())
    assert [i >= 0 for i in coded.find(asked).tolist()] == [x in held for x in asked.tolist()]


def test_large_numbers():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 2**63 - 1, 20000))
    coded = eliasfano.Ascending.build(values, 2**63)
    assert (coded.access(np.arange(len(values))) == values).all() and (coded.find(values) == np.arange(len(values))).all()
    assert (coded.find(values + 1) == -1).sum() > 19000


def test_files_round_trip(tmp_path):
    arrays = dict(eliasfano.named("s.", eliasfano.Ascending.build(np.arange(0, 999, 3), 1000).parts())) | {"x": np.array([1.5, 2.5])}
    uri = f"file:{tmp_path}/a/b.bin"
    eliasfano.write_arrays(uri, arrays)
    back = eliasfano.map_arrays(uri)
    assert {k: v.tolist() for k, v in eliasfano.read_arrays(uri).items()} == {k: v.tolist() for k, v in back.items()}
    assert back["x"].tolist() == [1.5, 2.5]
    assert eliasfano.Ascending.of_parts(eliasfano.group(back, "s.")).find(np.array([3, 4, 996])).tolist() == [1, -1, 332]


def test_few_files_stay_open(tmp_path, monkeypatch):
    monkeypatch.setattr(eliasfano, "OPEN_FILES", 3)
    eliasfano._OPEN.clear()
    for i in range(8):
        eliasfano.write_arrays(f"file:{tmp_path}/{i}.bin", {"x": np.arange(i + 1)})
    held = eliasfano.map_arrays(f"file:{tmp_path}/0.bin")["x"]
    for _ in range(2):
        for i in range(8):
            assert eliasfano.map_arrays(f"file:{tmp_path}/{i}.bin")["x"].tolist() == list(range(i + 1))
            assert len(eliasfano._OPEN) <= 3
    mapped = open("/proc/self/maps").read()
    assert sum(f"{tmp_path}/{i}.bin" in mapped for i in range(8)) == 4 and held.tolist() == [0]  # three, and the one in use


def test_quantisation():
    values = np.random.default_rng(0).normal(size=5000)
    table, codes = eliasfano.coded(values, 256)
    assert len(table) <= 256 and codes.dtype == np.uint8 and np.abs(table[codes] - values).mean() < 0.02
    table, codes = eliasfano.coded(np.array([7, 7, 9, 1000]))
    assert table[codes].tolist() == [7, 7, 9, 1000]


WORD = st.text(alphabet="abAB\u00e9\u6f22\x1c \t\n\x0b", max_size=90)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORD | st.integers(60, 70).map("x".__mul__), max_size=12), st.integers(1, 60))
def test_token_hashes(texts, piece):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram, "_PIECE_BYTES", piece)
        got = list(ngram._sequences(iter([batch, batch.slice(len(texts) // 2)]), 0))
    want = [[None, *tokens(t)] for t in [*texts, *texts[len(texts) // 2 :]]]
    assert [n for _, _, lengths in got for n in lengths] == [len(w) for w in want]
    pairs = set(zip([w for row in want for w in row], [h for _, hashes, _ in got for h in hashes.tolist()], strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert all((w is None) == (h == ngram.END) and 0 <= h < 2**63 for w, h in pairs)


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


class Plain:
    """The same model in dictionaries, without quantisation."""

    def __init__(self, texts, order, least):
        self.order, self.least = order, least
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            row = [None, *tokens(text)]
            for k in range(1, order + 1):
                for i in range(max(1, k - 1), len(row)):
                    self.counts[k][tuple(row[i - k + 1 : i + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.less, self.left = {}, {}
        kept = [None, self.counts[1]]
        for k in range(2, order + 1):
            # An n-gram can only be kept on top of its kept context and ending.
            found = {g: n for g, n in self.counts[k].items() if g[:-1] in kept[-1] and g[1:] in kept[-1]}
            self.less[k] = ngram._discounts([sum(n == c for n in found.values()) for c in range(1, 5)])
            kept.append({g: n for g, n in found.items() if n >= least})
            taken = defaultdict(float)
            for g, n in kept[k].items():
                taken[g[:-1]] += n - self.less[k][min(n, 3)]
            self.left |= {g: max(1 - t / kept[k - 1][g], 1e-9) for g, t in taken.items()}
        self.kept = kept

    def chance(self, gram):
        k = len(gram)
        if k == 1:
            return (self.kept[1].get(gram, 0) + 1) / (self.n + self.v + 1)
        shorter = self.left.get(gram[:-1], 1.0) * self.chance(gram[1:])
        n = self.kept[k].get(gram)
        return shorter + ((n - self.less[k][min(n, 3)]) / self.kept[k - 1][gram[:-1]] if n else 0.0)

    def score(self, text):
        row = [None, *tokens(text)]
        return sum(math.log10(self.chance(tuple(row[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(row)))


@pytest.mark.parametrize("order, least", [(1, 1), (2, 1), (3, 1), (2, 2), (4, 2)])
def test_against_a_plain_model(spark, order, least):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 150").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    plain = Plain([t for i, t in rows.items() if i % 5], order, least)
    assert ngram.MIN_COUNT == 1, "all n-grams are kept unless asked otherwise"
    model = ngram.train(docs.filter("doc_id % 5 <> 0"), order=order, min_count=least)
    assert (model.tokens, model.vocabulary) == (plain.n, plain.v)
    assert [sum(r.n for r in level) for level in model.levels] == [len(x) for x in plain.kept[1:]]
    for r in ngram.score(docs, model).collect():
        found = tokens(rows[r.doc_id])
        assert r.n_tokens == len(found)
        assert r.n_known == sum((w,) in plain.counts[1] for w in found)
        base = sum(math.log10((plain.counts[1][(w,)] + 1) / (plain.n + plain.v + 1)) for w in found)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain.score(rows[r.doc_id]), abs=0.02 * len(found) + 0.05)


def test_the_query_keeps_every_ngram(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    plain = Plain([t for i, t in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2], 3, 1)
    assert all(plain.kept[k] == plain.counts[k] for k in (2, 3))
    got = queries.op10_trie_language_model(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(tokens(rows[r.doc_id]))
        assert r.score == pytest.approx(plain.score(rows[r.doc_id]), abs=0.02 * n + 0.05)


def test_chances_add_up(spark):
    texts = ["a b a c", "a b a b", "b a b c c", "a b a c"]
    plain = Plain(texts, 3, 2)
    words = [g[0] for g in plain.counts[1]]
    for context in [("a", "b"), ("b",), (None, "a"), ()]:
        total = sum(plain.chance((*context, w)) for w in words)
        assert total == pytest.approx(1 - 1 / (plain.n + plain.v + 1) * math.prod([plain.left.get(context[i:], 1.0) for i in range(len(context))]))


def test_many_small_ranges(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")
    one = {r.doc_id: r for r in ngram.score(docs, ngram.train(docs)).collect()}
    monkeypatch.setattr(ngram, "RANGE_ROWS", 300)
    model = ngram.train(docs)
    assert len(model.levels[0]) > 5 and len(model.levels[1]) > 1
    for level in model.levels:
        assert all(a.high < b.low and a.last <= b.first for a, b in zip(level, level[1:]))
    assert any(a.last == b.first for a, b in zip(model.levels[1], model.levels[1][1:])), "a frequent word goes over ranges"
    assert max(r.n for r in model.levels[1]) < 1000
    folder = Path(model.levels[0][0].path.removeprefix("file:")).parent
    assert {p.name.split("-")[0] for p in folder.iterdir()} <= {"level1", "level2", "level3"}, "counts go with their level"
    for r in ngram.score(docs, model).collect():
        assert (r.n_known, r.base_score) == (one[r.doc_id].n_known, pytest.approx(one[r.doc_id].base_score))
        assert r.score == pytest.approx(one[r.doc_id].score, abs=0.02 * r.n_tokens + 0.05)


def test_odd_rows(spark):
    rows = [(1, "a b a b"), (2, None), (3, ""), (3, ""), (None, " A\tB "), (4, "zz " * 300000), (5, "É é 漢")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, code string, n int")
    got = sorted(map(tuple, ngram.score(docs, ngram.train(docs)).collect()), key=repr)
    assert [(g[0], g[1], g[2]) for g in got] == [(1, 5, 5), (2, 1, 1), (3, 1, 1), (3, 1, 1), (4, 300001, 300001), (5, 4, 4), (None, 3, 3)]
    nothing = ngram.train(docs.limit(0))
    assert {(r.n_known, round(r.base_score, 6)) for r in ngram.score(docs, nothing).collect()} == {(0, 0.0)}
    assert ngram.score(docs.limit(0), nothing).count() == 0


def test_held_out_documents(spark):
    rows = queries.op10_trie_language_model(spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_numbers_far_from_zero():
    """Numbers that lie together keep few low bits, wherever they begin; what is below them is not found."""
    values = 2**60 + np.arange(0, 30000, 3)
    coded = eliasfano.Ascending.build(values, int(values[-1]) + 1, int(values[0]))
    assert coded.low_bits <= 2 and (coded.values() == values).all() and (coded.access(np.arange(9)) == values[:9]).all()
    asked = np.concatenate([[0, 2**60 - 1], values[:50], values[:50] + 1, [2**61]])
    assert coded.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    assert coded.find(asked).tolist() == [-1, -1, *range(50), *[-1] * 51]


def test_files_of_a_level_keep_bits_by_their_own_range(spark, monkeypatch):
    """A file's sequence begins at its first code: else its low bits, and the steps of a search, grow with the number of files."""
    monkeypatch.setattr(ngram, "RANGE_ROWS", 300)
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 60))) for i in range(60)]
    model = ngram.train(spark.createDataFrame(docs, "doc_id long, text string"))
    assert all(len(level) > 1 for level in model.levels[1:])
    for level in model.levels:
        for part in level:
            n, low_bits = eliasfano.map_arrays(part.path)["s.shape"][:2].tolist()
            assert n == part.n and 2**low_bits <= max(1, (part.high - part.low + 1) // n), (part, low_bits)
