"""Filter audit, substring dedup and whitening against brute force, the SQL and numpy's own decompositions."""

import glob
import hashlib
import os
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import audit, queries, substring, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_substring_dedup"])
def test_query_matches_sql(spark, db, name):
    found = queries.QUERIES[name](spark, SF)
    expected = db.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert expected and sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


# --- filter audit ---------------------------------------------------------------------------------------------------

ODD = [
    (1, "same " * 250, "a", 0), (2, "same " * 250, "b", 0), (2, "same " * 250, "b", 0), (None, "same " * 250, None, 0), (3, None, None, 0), (4, "", "", 0),
    (5, " ".join(f"w{i}" for i in range(300)), "a", 0), (6, " ".join(f"W{i}" for i in range(300)) + " 5%", "a", 0), (7, "É" * 40_000, "a", 0), (None, None, "c", 0),
]


def failures(rows):
    smallest = {}
    for d, t, *_ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    for d, t, source, *_ in rows:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > smallest[t]}
        yield d, source or "", {f for f, bad in fails.items() if bad}


def test_filter_audit_against_brute_force(spark):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string, mask int")
    found = audit.filter_audit(audit.failure_cells(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    good, toxic = {d for d, q, _ in labels if q == 1 and d}, {d for d, _, t in labels if t == 1 and d}
    judged = list(failures(ODD))
    expected = {}
    for part in {s for _, s, _ in judged}:
        shapley = defaultdict(int)
        rows = {}
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[1] == part]
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[2]]
                early = [j for j in judged if j[1] == part and f in j[2] and j not in left]
                left = [j for j in left if f not in j[2]]
                sole = sum(1 for j in judged if j[1] == part and j[2] == {f})
                shapley[f] += len(gone)
                rows["".join(order), step] = (len(left), len(gone), len(early), sole, sum(j[0] in good for j in gone), sum(j[0] in toxic for j in gone), f)
        expected |= {(part, *k): (*v[:6], shapley[v[6]]) for k, v in rows.items()}
    assert len(found) == len(expected) == 600 * len({s for _, s, _ in judged})
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found} == expected


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.filter_audit(audit.failure_cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    with pytest.raises(ValueError, match="different"):
        audit.filter_audit(docs, "AA")


def test_survivors_of_random_cells():
    cells = np.random.default_rng(1).integers(0, 50, (3, 16, 2))
    left = audit.survivors(cells)
    for s in range(16):
        assert (left[:, s] == cells[:, [m for m in range(16) if not m & s]].sum(axis=1)).all()


# --- substring dedup ------------------------------------------------------------------------------------------------


def cut(rows, window):
    first = {}
    for d, t in rows:
        ws = WORD.findall(t or "")
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s : s + window])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        ws = WORD.findall(t or "")
        gone = set()
        for s in range(len(ws) - window + 1):
            if d is not None and first[tuple(ws[s : s + window])] < d:
                gone |= set(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((-1 if d is None else d, len(ws), len(gone), kept, spans))
    return sorted(out, key=repr)


def made(df):
    rows = df.select("doc_id", "n_words", "n_removed", "kept_text", "removed").collect()
    return sorted(((-1 if d is None else d, n, g, t, [[s["start"], s["end"]] for s in spans]) for d, n, g, t, spans in rows), key=repr)


def random_texts(seed, n, shared):
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"p{k}_{i}" for i in range(rng.integers(5, 40))) for k in range(shared)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.integers(0, 6)):
            parts.append(passages[rng.integers(shared)] if rng.random() < 0.6 else " ".join(f"{'éÉ'[d % 2]}{rng.integers(9)}" for _ in range(rng.integers(1, 30))))
        rows.append((int(rng.integers(n)), ["  ", "\n", "\t ", "  "][d % 4].join(parts)))
    return rows


@pytest.mark.parametrize(("window", "slice_bytes"), [(3, 3_000_000), (12, 2_000), (50, 3_000_000), (1, 900)])
def test_repeats_against_brute_force(spark, monkeypatch, window, slice_bytes):
    monkeypatch.setattr(substring, "SLICE_BYTES", slice_bytes)
    rows = random_texts(window, 120, 9) + [(7, None), (None, "p0_0 p0_1 " * 30), (None, None), (8, ""), (900, "x " * 500), (901, "x " * 400 + "end"), (902, "x " * 20), (3, "z" * 100_000 + " y"), (950, "lone")]
    rows += [(500 + i, "copy " + " ".join(f"c{j}" for j in range(80))) for i in range(40)] + [(500, "copy " + " ".join(f"c{j}" for j in range(80)))] * 3
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, kept_text string, spans int").repartition(7)
    found = substring.remove_repeats(docs, window)
    assert found.columns == ["doc_id", "text", "spans", "n_words", "n_removed", "removed", "kept_text"]
    assert made(found) == cut(rows, window)


def test_frequent_anchors_change_nothing(spark, monkeypatch):
    rows = random_texts(5, 200, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    expected = cut(rows, 10)
    assert made(substring.remove_repeats(docs, 10)) == expected
    monkeypatch.setattr(substring, "FREQUENT", 1e-9)
    monkeypatch.setattr(substring, "SAMPLE_ROWS", 50)
    assert made(substring.remove_repeats(docs, 10)) == expected


def test_repeats_of_nothing(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_are_hashed_in_pieces(monkeypatch):
    powers = substring.Powers()
    texts = pa.array(["ab " * 50 + "q" * 700, None, "é tail", ""])
    data, offsets = substring.flat_texts(texts)
    starts, ends, first = substring.word_places(data, offsets)
    whole = substring.word_codes(data, starts, ends, powers)
    monkeypatch.setattr(substring, "PIECE_BYTES", 11)
    assert (substring.word_codes(data, starts, ends, powers) == whole).all()
    assert first.tolist() == [0, 51, 51, 53, 53]
    assert len(set(whole.tolist())) == 4


def test_digest_is_of_the_kept_words(spark):
    rows = queries.op12_substring_dedup(spark, SF).filter("n_removed = 0 AND n_words = 1").limit(1).collect()
    assert all(len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest()) for r in rows)


# --- whitening ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_components_against_numpy(n):
    rng = np.random.default_rng(n)
    k = min(8, n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    spectra = [rng.standard_normal((n, n + 3)) @ rng.standard_normal((n + 3, n)), np.eye(n), np.diag(np.arange(n) // 2 + 1.0), np.zeros((n, n)), q @ np.diag([5.0] * min(3, n) + [1.0] * (n - min(3, n))) @ q.T, np.diag(10.0 ** -np.arange(n))]
    for a in spectra:
        a = (a + a.T) / 2
        values, vectors = whitening.leading_components(a, k)
        size = max(np.abs(a).max(), 1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-13 * size * n)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * size * n


def plain_rows(vectors):
    sound = [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in sound], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in sound], n, deviation, centred @ u[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / e.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(c) for c in rng.standard_normal(12) * np.arange(1, 13) / 12]) for i in range(400)]
    vectors += [(5, vectors[0][1]), (None, vectors[1][1]), (900, None), (901, [None] + [0.5] * 11), (902, [float("nan")] + [0.5] * 11), (903, [float("inf")] * 12), (904, [0.0] * 12)]
    table = spark.createDataFrame([(i, v, "clash", 1.5) for i, v in vectors], "vec_id long, embedding array<float>, n string, column double").repartition(5)
    found = whitening.whiten(table)
    assert found.columns == ["vec_id", "embedding", "column", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = sorted(whitening.component_rows(found).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"]))
    ids, n, deviation, w, explained = plain_rows(vectors)
    order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i]))
    assert len(rows) == 8 * n and rows[0]["identity_error"] < 1e-9
    assert {r["n"] for r in rows} == {n}
    for c in range(8):
        mine = np.array([r["whitened"] for r in rows if r["component"] == c + 1])
        other = w[order, c]
        # rows with one id come in any order, both with sorted values
        assert min(np.abs(np.sort(mine) - np.sort(sign * other)).max() for sign in (1, -1)) < 1e-8
        assert abs(rows[c]["explained"] - explained[c]) < 1e-9
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(deviation)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    nothing = whitening.whiten(spark.createDataFrame([], schema))
    assert nothing.count() == 0 and "identity_error" in nothing.columns
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))
    assert [(r["deviation"], r["whitened"], r["identity_error"]) for r in same.collect()] == [(0, [], 0.0)] * 2
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [1.0]), (4, []), (5, [1e30, 1.0])], schema))
    assert sorted(r["vec_id"] for r in ragged.collect()) == [1, 2]
    assert {len(r["whitened"]) for r in ragged.collect()} == {1}


def test_deviation_beyond_a_long_is_null(spark):
    rows = whitening.whiten(spark.createDataFrame([(1, [4e9]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in rows] == [None, None]
    exact = whitening.whiten(spark.createDataFrame([(1, [1e6]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in exact] == [1_024_000_000**2] * 2


def test_query_covers_every_vector(spark):
    rows = queries.op13_whitening(spark, SF)
    assert rows.count() == 8 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert rows.selectExpr("max(identity_error)").first()[0] < 1e-6
