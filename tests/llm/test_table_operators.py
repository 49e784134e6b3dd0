"""URL filter, fingerprints, near-duplicates, embeddings, mixing and the pipeline against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import common, components, fingerprint, forest, mixing, simhash, urlfilter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- URL filter -----------------------------------------------------------------------------------------------------


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for verdict, rule in sorted(urlfilter.RULES, key=lambda r: len(r[1])):
        at, _, tail = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail):
            best = (rule, verdict)
    return (host, path, *best)


def test_url_filter_against_python(spark):
    odd = [None, "", "no scheme", "http://", "http://ORG/x", "x://a.example.ORG/es/1?q=/de/", "http://example.org?x=/es/", "ftp://é.com/fr/Ü#1", "http://a.com/de/", "http://aorg/", "http://b.org", "http://x.com/" + "p" * 20_000, "a://b://c.org/"]
    rows = [(i, u, "clash") for i, u in enumerate(odd)] + [(4, odd[4], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").unionByName(spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id") + 100, "url", F.lit("x").alias("host")).toDF("page_id", "url", "host"))
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    got = urlfilter.filter_urls(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        host, path, rule, verdict = judged(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow")) and 0 < r["block_score"] < 1
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_url_regression_learns_and_generalises(spark):
    weights = urlfilter.train(urlfilter.labelled_urls(spark))
    score = urlfilter.score(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url")), weights)
    known = urlfilter.labelled_urls(spark).select("blocked", score.alias("s")).collect()
    assert all((r["s"] >= 0.5) == r["blocked"] for r in known)
    new = [("http://m.cheap-pills.example.net/fr/4", 1), ("https://casino-bets.example.com/de/", 1), ("http://blog.thther.example.net/en/83", 0), ("https://www.library.example.com/es/1", 0)]
    assert all((r["s"] >= 0.5) == r["blocked"] for r in spark.createDataFrame(new, "url string, blocked int").select("blocked", score.alias("s")).collect())
    assert set(urlfilter.train(urlfilter.labelled_urls(spark).limit(0))) == {0.0}


def test_url_regression_equals_plain_descent(spark):
    labelled = urlfilter.labelled_urls(spark)
    buckets = urlfilter.gram_buckets(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url")))
    rows = labelled.select("blocked", F.array_distinct(buckets).alias("b")).collect()
    x, y = np.zeros((len(rows), urlfilter.BUCKETS + 1)), np.array([r["blocked"] for r in rows], float)
    for i, r in enumerate(rows):
        x[i, r["b"]] = 1 / np.sqrt(max(1, len(r["b"])))
    x[:, -1] = 1.0
    w = np.zeros(urlfilter.BUCKETS + 1)
    for _ in range(urlfilter.EPOCHS):
        p = 1 / (1 + np.exp(-x @ w))
        w = w * (1 - urlfilter.SHRINK) + urlfilter.RATE / len(rows) * (y - p) @ x
    assert np.allclose(urlfilter.train(labelled), w, atol=1e-9)


def test_url_regression_on_held_out_urls(spark):
    rows = [(r["url"], r["blocked"]) for r in urlfilter.labelled_urls(spark).collect()]
    right = 0
    for fold in range(4):
        weights = urlfilter.train(spark.createDataFrame([r for i, r in enumerate(rows) if i % 4 != fold], "url string, blocked int"))
        score = urlfilter.score(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url")), weights)
        held = spark.createDataFrame([r for i, r in enumerate(rows) if i % 4 == fold], "url string, blocked int")
        right += sum((r["s"] >= 0.5) == r["blocked"] for r in held.select("blocked", score.alias("s")).collect())
    assert right >= 0.75 * len(rows)


# --- fingerprints ---------------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_fingerprints_against_python(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 25)
    odd = [(10_000, None, 1), (10_001, "", 1), (10_003, "é" * 5, 1), (10_007, " \n ", 1), (20_000, "one two three four five six " * 3000, 1), (20_001, "😀 x", 1)]
    table = docs.select("doc_id", "text", F.lit(1).alias("n_chars")).unionByName(spark.createDataFrame(odd, "doc_id long, text string, n_chars int"))
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(table).collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in table.collect())
    assert len(got) == len(rows)
    errors = []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= r[name] <= 1 and abs(r[name] - true) < 0.25
            errors.append(r[name] - true)
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.05
    by_text = {}
    for doc, text in rows:
        assert by_text.setdefault(text, got[doc]["fingerprint"]) == got[doc]["fingerprint"]


def test_neighbours_of_few_rows(spark):
    one = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert fingerprint.edited_fingerprints(one).first()["near_next"] == 1.0
    assert fingerprint.edited_fingerprints(one.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (2, "c")], "doc_id long, text string")
    assert {(r["text"], r["next_text"]) for r in fingerprint.neighbours(ties, ["text"]).collect()} == {("z", "a"), ("a", "b"), ("b", "c"), ("c", "z")}


def test_neighbours_when_many_rows_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 20)
    rows = [(i if i % 4 == 0 else 7 if i % 4 == 1 else None, f"text {i} {i * i}") for i in range(800)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"]: (r["doc_id"], r["next_text"]) for r in fingerprint.neighbours(table, ["text"]).collect()}
    assert len(got) == 800
    key = {t: (d is not None, d or 0, xxhash.xxh64_intdigest(t.encode(), 42) >> 1) for d, t in rows}
    order = sorted(key, key=key.get)
    assert all(got[t][1] == after for t, after in zip(order, order[1:] + order[:1], strict=True))
    cuts = common.id_ranges(table, "doc_id", 20)
    tie = F.shiftrightunsigned(F.xxhash64("text"), 1)
    spread = table.groupBy("doc_id").agg(F.count_distinct(common.range_of(F.col("doc_id"), cuts, tie)).alias("n")).filter("doc_id IS NULL OR doc_id = 7").collect()
    assert all(r["n"] > 5 for r in spread)


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("cell_rows", [2048, 8])
def test_simhash_against_python(spark, docs, cell_rows):
    odd = [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "Two Words"), (9004, "two words"), (9005, "É é x"), (9006, "w " * 30_000), (9006, "w " * 30_000)]
    near = [(9100 + i, " ".join(f"w{j}" for j in range(400)) + f" end{i}") for i in range(60)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd + near, "doc_id long, text string")).withColumn("fp", F.lit("clash"))
    rows = sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=lambda r: r[0])
    prints = [plain_simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = groups_of(len(rows), links)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table, cell_rows=cell_rows).collect())
    assert got == sorted((d, f"{p:016x}", rows[g][0]) for (d, _), p, g in zip(rows, prints, group, strict=True))


def test_more_slices_find_the_same_links(spark, docs):
    assert [simhash.slices_for(n, 3) for n in (0, 10**7, 10**9, 10**11)] == [2, 2, 3, 4]
    table = docs.select("doc_id", "text")
    two, four = (sorted(map(tuple, simhash.near_duplicates(table, agree=a).collect())) for a in (2, 4))
    assert two == four


def test_simhash_nulls_and_empty(spark):
    table = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(table).collect())
    assert got == Counter({(None, 2): 1, (2, 2): 1, (None, None): 1})
    assert simhash.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_distances(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.array([int(b) ^ sum(1 << int(k) for k in r.choice(64, int(r.integers(0, 9)), replace=False)) for b in base for _ in range(60)] + [0, 0, (1 << 64) - 1], dtype=np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    seen = {int(i): hit for q, block in simhash.within(fps, radius) for i, hit in zip(q, block, strict=True)}
    for i in range(len(fps)):
        assert (seen[i] == close[i]).all() if i in seen else close[i].sum() == 1
    ids = np.arange(len(fps))[::-1].copy()
    roots = simhash.local_roots(fps, ids, radius)
    group = np.array(groups_of(len(fps), list(zip(*np.nonzero(close), strict=True))))
    for g in np.unique(group):
        assert set(roots[group == g]) == {ids[group == g].min()}


def test_components_of_a_long_chain(spark):
    edges = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(1000, 1000), (2000, 1500), (None, 3)], "u long, v long"))
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, 2000: 1500}
    assert components.connected_components(edges.limit(0)).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------------


def test_forest_against_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((900, 24))
    near = base[r.integers(0, 900, 900)] + 0.05 * r.standard_normal((900, 24))
    hot = base[0] + 0.02 * r.standard_normal((200, 24))
    x = np.concatenate([base, near, hot, np.repeat(base[5:6], 50, axis=0), -base[:3], 3.5 * base[7:9]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(90_000, None), (90_001, []), (90_002, [0.0] * 24), (90_003, [float("nan")] * 24), (90_004, [float("inf")] + [1.0] * 23), (90_005, [None] * 24), (90_006, [1.0, 2.0]), (90_007, [2.0, 4.0])]
    table = spark.createDataFrame(rows + [(i, v, 1) for i, v in bad] + [(None, rows[0][1], 2)], "vec_id long, embedding array<float>, n_links int")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    group = groups_of(len(x), [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i > j])
    got = forest.near_duplicate_vectors(table, leaf_rows=64).collect()
    assert len(got) == table.count()
    by_id = {g["vec_id"]: g for g in got}
    links = np.array([by_id[i]["n_links"] for i in range(len(x))])
    assert (links <= close.sum(axis=1)).all() and links.sum() >= 0.95 * close.sum()
    assert np.mean([by_id[i]["component_id"] == group[i] for i in range(len(x))]) > 0.99
    assert all(by_id[i]["kept"] == (by_id[i]["component_id"] == i) for i in range(len(x)))
    assert all((by_id[i]["n_links"], by_id[i]["component_id"], by_id[i]["kept"]) == (0, i, True) for i, _ in bad[:6])
    assert by_id[90_006]["n_links"] == 1 and by_id[90_007]["component_id"] == 90_006
    assert (by_id[None]["n_links"], by_id[None]["component_id"], by_id[None]["kept"]) == (0, None, False)
    assert forest.near_duplicate_vectors(table.limit(0)).count() == 0


def test_one_tree_parts_few_pairs_at_the_threshold():
    r = np.random.default_rng(8)
    x = forest.units(r.standard_normal((20_000, 32)))
    aside = r.standard_normal(x.shape)
    aside = forest.units(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * aside
    loss = 1 - (1 - forest.LOSS) ** (1 / 5)
    for tree in range(3):
        grown = forest.Forest(4, 23).grown(pa.Table.from_pylist([dict(zip(("tree", "node", "low", "high"), s, strict=True)) for s in forest.fit_splits(x[:2048], tree, 1, len(x), 23, 640, 0.95, loss)]))
        assert len(grown.keys) >= 15
        homes = []
        for z in (x, y):
            at, codes = grown.leaves(z)
            homes.append(set(zip(at[codes % 4 == tree].tolist(), codes[codes % 4 == tree].tolist(), strict=True)))
        together = {at for at, _ in homes[0] & homes[1]}
        assert len(together) >= (1 - forest.LOSS - 0.05) * len(x)


def test_signs_keep_close_pairs():
    r = np.random.default_rng(9)
    x = forest.units(r.standard_normal((20_000, 48)))
    y = forest.units(x + 0.3286 * forest.units(r.standard_normal(x.shape)))
    near = (x * y).sum(axis=1) >= 0.95
    differ = np.bitwise_count((forest.signs_of(x, 1) ^ forest.signs_of(y, 1)).view(np.uint64)).sum(axis=1)
    assert near.sum() > 5000 and (differ[near] <= forest.sign_limit(0.95)).mean() > 0.9995


def test_pairs_count_once_across_cells():
    r = np.random.default_rng(9)
    x = r.standard_normal((40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, ones = np.arange(40), np.ones(40)
    codes = np.stack([np.zeros(40, int), np.ones(40, int)], axis=1)
    first, _ = forest.leaf_links(x, ids, ones, codes, 0, None, 0.3)
    again, _ = forest.leaf_links(x, ids, ones, codes, 1, None, 0.3)
    side = ids % 2
    across, _ = forest.leaf_links(x, ids, ones, codes, 0, side, 0.3)
    close = x @ x.T >= 0.3
    np.fill_diagonal(close, False)
    assert (first == close.sum(axis=1)).all() and not again.any()
    assert (across == (close & (side[:, None] != side[None, :])).sum(axis=1)).all()


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_mix_against_python(spark, docs):
    odd = [(900, "one two", None), (901, None, None), (902, "", "zz"), (903, "a\u00a0b c", "é"), (904, "w " * 4000, "big"), (904, "w " * 4000, "big"), (None, "x y z", "big")]
    table = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string")).withColumn("size", F.lit("clash"))
    rows = mixing.mix(table, shard_rows=8).collect()
    assert len(rows) == table.count()
    sizes = Counter()
    for r in table.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = plain.targets(dict(sizes))
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + mixing.BLOCK_WORDS
    again = mixing.mix(table.repartition(7), shard_rows=8).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(table.limit(0)).count() == 0


def test_apportionment_equals_seat_by_seat(spark):
    r = np.random.default_rng(6)
    for trial in range(3):
        share = [int(v) for v in r.integers(1, 1000, 9)] + [0]
        seats, cap = int(r.integers(5, 300)), 1000
        rows = spark.createDataFrame([(0, k, s, seats, cap) for k, s in enumerate(share)], "g int, k int, s long, seats long, cap long")
        got = {x["k"]: x["quota"] for x in mixing.apportioned(rows, ["g"], "k", "s", "seats", "cap").collect()}
        plain = dict.fromkeys(range(10), 0)
        for _ in range(seats):
            best = max((k for k in plain if share[k]), key=lambda k: (share[k] / (2 * plain[k] + 1), -k))
            plain[best] += 1
        assert got == plain, trial


def test_mixed_documents_repeat_rows(spark, docs):
    table = docs.withColumns({"_copies": F.lit("mine"), "_copy": F.lit("mine"), "size": F.lit("mine"), "total": F.lit("mine")})
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns and out.filter("_copies = 'mine' AND _copy = 'mine' AND size = 'mine'").count() == out.count()
    times = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert times == Counter({d: c for d, _, _, _, c in plain.mix([(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]) if c})
    assert mixing.mixed_documents(table.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_copies_equal_the_decision_whatever_the_partitions(spark, monkeypatch, parts):
    monkeypatch.setattr(mixing, "ENTRY_ROWS", 100)
    texts = [("same words here", i % 3) for i in range(1001)] + [(f"w{i} x y", 0) for i in range(700)] + [("equal in everything", 5)] * 301
    rows = spark.createDataFrame([(1, "a", t, m) for t, m in texts] + [(None, None, f"n{i % 9} b c", i % 2) for i in range(400)], "doc_id long, source string, text string, more int").repartition(parts)
    wanted = {(r["doc_id"], r["source"]): r["n"] for r in mixing.mix(rows).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    out = mixing.mixed_documents(rows)
    got = Counter(map(tuple, out.collect()))
    have = Counter(map(tuple, rows.collect()))
    assert {k: sum(n for r, n in got.items() if r[:2] == k) for k in wanted} == wanted
    assert got == Counter(map(tuple, mixing.mixed_documents(rows.repartition(3)).collect()))
    for r, n in have.items():  # even shares: the copies of equal rows differ by one at most
        base = wanted[r[:2]] // sum(m for x, m in have.items() if x[:2] == r[:2])
        assert base * n <= got[r] <= (base + 1) * n


@pytest.mark.parametrize(("buckets", "seed"), [(4096, 1), (3, 2), (1, 3)])
def test_seats_go_to_the_highest_quotients(spark, monkeypatch, buckets, seed):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    r = np.random.default_rng(seed)
    rows = [(g, k, int(r.integers(0, 4) * 50 if g == 2 else r.integers(0, 900)), [0, 37, 300, 5000][g]) for g in range(4) for k in range(30 * g + 1)]
    table = spark.createDataFrame([(*x, int(x[2] // 3 + 5)) for x in rows], "g int, k int, share long, seats long, cap long").repartition(5)
    got = {(x["g"], x["k"]): x["quota"] for x in mixing.apportioned(table, "g", "k", "share", "seats", "cap").collect()}
    for g in range(4):
        bids = sorted(((-s / (2 * i + 1), k, i) for h, k, s, _ in rows if h == g and s for i in range(s // 3 + 5)))[: [0, 37, 300, 5000][g]]
        assert {k: got[g, k] for h, k, *_ in rows if h == g} == {k: 0 for h, k, *_ in rows if h == g} | Counter(k for _, k, _ in bids)


def test_mixed_documents_decide_row_by_row(spark):
    r = np.random.default_rng(2)
    rows = [(None if k % 3 else 4, "a" if k % 2 else "b", " ".join(f"w{v}" for v in r.integers(0, 99, int(r.integers(1, 60))))) for k in range(400)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), shard_rows=50)
    have, taken = Counter((s, t) for _, s, t in rows), Counter((x["source"], x["text"]) for x in out.collect())
    assert all(taken[k] <= 2 * have[k] for k in taken)
    sizes = {s: sum(len(WORD.findall(t)) for _, x, t in rows if x == s) for s in "ab"}
    for s, target in plain.targets(sizes).items():
        assert abs(sum(len(WORD.findall(t)) * n for (x, t), n in taken.items() if x == s) - target) < 0.1 * target


def test_mix_of_one_doc_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ENTRY_ROWS", 100)
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") < 2000, "same three words").otherwise(F.repeat(F.lit("w "), F.pmod("id", F.lit(9)).cast("int"))).alias("text"))
    got = mixing.mix(rows).collect()
    assert len(got) == 3000 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= mixing.BLOCK_WORDS and got[0]["source_size"] == sum(r["size"] for r in got)


@pytest.mark.parametrize("spread", [0.0325, 0.0307])
def test_forest_keeps_links_of_a_loose_group(spark, spread):
    r = np.random.default_rng(3)
    base = r.standard_normal(64)
    x = base / np.linalg.norm(base) + spread * r.standard_normal((20_000, 64))
    x = np.concatenate([x, r.standard_normal((2000, 64))]).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = np.concatenate([(unit[a : a + 500] @ unit.T >= 0.95).sum(axis=1) - 1 for a in range(0, len(x), 500)])
    assert 0.1 < links.sum() / 20_000**2 < 0.4
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {g["vec_id"]: g["n_links"] for g in forest.near_duplicate_vectors(table).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
