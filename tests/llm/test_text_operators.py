"""SentencePiece, token files, token counts and the trained classifiers against libraries and held-out labels."""

import json
import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from corpusloom.llm import common, langid, pieces, quality, tokencount, tokenfile

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "   a  b ", "\n\n x\ty", "a" * 3000, " " * 90, "日本語 テキスト 😀😀", "Ünïcödé é̂ x", "<s> </s> <unk> <0x41>", "it's I'LL we're",
    "<|endoftext|>hello <|endoftext|>", "a,b .x, ,. A's It's., é,́ x.\x1c y\tz w,. 12, 3. Ⅷ. İ İ, Aİ. µΣ ΑΣ. ß ÀÉ. ÿ, Ÿ", "aaaa" * 50 + " zzzz", "\r\n \u00a0x\u2003y", "word " * 5000,
]
SCHEMA = "doc_id long, text string, n_tokens string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "xx") for i, t in enumerate(ODD)] + [(3, ODD[3], "clash", "xx"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return [r["text"] for r in docs.orderBy("doc_id").collect()] + ODD


def test_pieces_equal_the_library(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, library = pieces.model(path), pieces.load(path)
    ids = model.encode(texts)
    assert [i.tolist() for i in ids] == library.encode([t or "" for t in texts])
    assert [model.decode(i) for i in ids] == [library.decode(i.tolist()) for i in ids] == [t or "" for t in texts]


def test_pieces_of_random_texts_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, library, r = pieces.model(path), pieces.load(path), random.Random(2)
    texts = ["".join(r.choice("aAbeinrstéñ  \n\t▁.,1日😀<|>") for _ in range(r.randrange(30))) for _ in range(6000)]
    ids = model.encode(texts)
    assert [i.tolist() for i in ids] == library.encode(texts)
    assert [model.decode(i) for i in ids] == [library.decode(i.tolist()) for i in ids]


def test_unigram_search_finds_the_best_score(texts):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pieces.UNIGRAM
    for i, p in enumerate(proto.pieces):
        if p.type == pieces.NORMAL:
            p.score = -(4 + i * 0.00025)
    import sentencepiece

    model, library = pieces.Pieces(proto.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def total(ids):
        return sum(proto.pieces[i].score for i in ids)

    plain = [t for t in texts[:60] if t and "\n" not in t] + ["unhappiness of the others", "a b c", "thethethe"]
    for ours, theirs in zip(model.encode(plain), library.encode(plain), strict=True):
        assert total(ours.tolist()) == pytest.approx(total(theirs), abs=1e-2)


def test_piece_frames(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode_pieces(pieces.encode_pieces(odd, path), path)
    assert [r["decoded"] for r in back.collect()] == [t or "" for t in ODD] + [ODD[3], "no id"]
    made = pieces.digests(odd, path)
    assert made.columns.count("n_tokens") == 1 and made.filter("round_trip").count() == len(ODD) + 2
    assert pieces.digests(odd.limit(0), path).count() == 0


def test_token_counts_equal_the_library(spark, odd, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokencount.MergeCounter(path).count(texts).tolist() == expected
    rows = {r["doc_id"]: r for r in tokencount.count_tokens(odd, path).filter("doc_id IS NOT NULL").collect()}
    assert [rows[i]["n_tokens"] for i in range(len(ODD))] == expected[-len(ODD) :]
    assert all(rows[i]["n_bytes"] == len((t or "").encode()) and rows[i]["over_limit"] == (rows[i]["n_tokens"] > 1024) for i, t in enumerate(ODD))
    assert tokencount.count_tokens(odd.limit(0), path).count() == 0


def test_merging_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    r, library = random.Random(3), Tokenizer.from_file(path)
    words = ["".join(r.choice("aabehtn é'1 ") for _ in range(r.randint(1, 40))) for _ in range(400)] + ["a" * 4001, "ab" * 3000]
    assert tokencount.MergeCounter(path).count(words).tolist() == [len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}, {"model": {"ignore_merges": True}}])
def test_other_vocabulary_files_raise(change):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    tokencount._check(spec)
    spec |= {k: spec[k] | v if k == "model" else v for k, v in change.items()}
    with pytest.raises(ValueError):
        tokencount._check(spec)


def test_forgetting_words_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(tokencount, "KEEP_BYTES", 0)
    path, other = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    counter, fresh = tokencount.MergeCounter(path), tokencount.MergeCounter(path)
    model = pieces.model(other)
    monkeypatch.setattr(model.known, "keep_bytes", 0)
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        assert counter.count(part).tolist() == fresh.count(part).tolist()
        assert [i.tolist() for i in model.encode(part)] == pieces.load(other).encode([t or "" for t in part])


def test_code_lengths_are_optimal_and_limited():
    import heapq

    r = np.random.default_rng(1)
    counts = np.bincount(np.minimum(r.zipf(1.3, 50_000), 3_000).astype(np.int64))
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    free = tokenfile.code_lengths(counts, 40).astype(np.int64)
    assert (counts * free).sum() == cost
    for bits in (13, 18):
        short = tokenfile.code_lengths(counts, bits).astype(np.int64)
        assert short.max() <= bits and (0.5 ** short[short > 0]).sum() <= 1 and (counts * short).sum() >= cost
    assert tokenfile.code_lengths(np.array([0, 7])).tolist() == [0, 1] and tokenfile.code_lengths(np.zeros(0, np.int64)).tolist() == []
    with pytest.raises(ValueError):
        tokenfile.code_lengths(np.ones(9, np.int64), 3)


def test_pack_and_unpack():
    r = np.random.default_rng(2)
    counts = np.bincount(np.minimum(r.zipf(1.2, 50_000), 40_000).astype(np.int64))
    lengths = tokenfile.code_lengths(counts)
    for n in (1, 255, 256, 257, 5000):
        ids = r.choice(np.flatnonzero(counts), n).astype(np.uint32)
        data, at = tokenfile.pack(ids, tokenfile.canonical(lengths), lengths)
        lanes = at[:: tokenfile.CHECKPOINT]
        sizes = np.diff(np.append(np.arange(0, n, tokenfile.CHECKPOINT), n))
        assert (tokenfile.unpack(data, lanes, sizes, tokenfile.decode_table(lengths)) == ids).all()


def test_rows_begin_with_bytes_of_their_own():
    r = np.random.default_rng(4)
    counts = np.bincount(np.minimum(r.zipf(1.3, 20_000), 3_000).astype(np.int64))
    lengths = tokenfile.code_lengths(counts)
    codes = tokenfile.canonical(lengths)
    sizes = r.integers(1, 700, 50)
    ids = r.choice(np.flatnonzero(counts), int(sizes.sum())).astype(np.uint16)
    data, first, inside = tokenfile.pack_rows(ids, sizes, codes, lengths)
    ends = np.cumsum(sizes)
    for k, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        alone, at = tokenfile.pack(ids[a:b], codes, lengths)
        assert data[first[k] : first[k + 1]] == alone and (inside[a:b] == at).all()


def test_word_ids_equal_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    words = tokenfile.WordIds(path)
    flat, n = words.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    got = [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]
    assert words.folds and got == [e.ids for e in words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_ids_of_random_texts_equal_the_library():
    r = random.Random(1)
    letters = "aAbBzZßẞİıſKÅÉéñÑÀàÿŸΣςσʼnǰΐªºµ×÷\u0327\u0301\u0307,.,.,.'’-_ \n\t 12Ⅷ日😀<|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(6000)] + ["a<|endoftext|>.", "ALİ. b"]
    words = tokenfile.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    flat, n = words.encode(pa.array(texts, pa.string()))
    got = [part.tolist() for part in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    words.known.held = words.known.keep_bytes + 1  # forgetting what was learned changes nothing
    assert (words.encode(pa.array(texts, pa.string()))[0] == flat).all()


def test_token_files_round_trip(spark, docs, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "RANGE_ROWS", 30)
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 5000)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    both = docs.select("doc_id", "text").unionByName(odd.filter("doc_id IS NOT NULL").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    tokenfile.write_token_files(both, vocabulary, f"{tmp_path}/f")
    library = Tokenizer.from_file(vocabulary)
    rows = sorted((r["doc_id"], r["text"] or "") for r in both.collect())
    expected, start = [], 0
    for (doc, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], dtype="<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfile.digest_token_files(spark, f"{tmp_path}/f").collect())) == expected
    ids = {r["doc_id"]: r["ids"] for r in tokenfile.read_token_files(spark, f"{tmp_path}/f").collect()}
    assert all(zlib.crc32(np.array(ids[d], "<u4").tobytes()) == c for d, _, _, c in expected)
    tokenfile.write_token_files(both.limit(0), vocabulary, f"{tmp_path}/none")
    assert tokenfile.digest_token_files(spark, f"{tmp_path}/none").count() == 0


def test_token_files_when_all_rows_share_an_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "RANGE_ROWS", 20)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.range(600).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" more"), F.pmod("id", F.lit(7)).cast("int"))).alias("text"))
    tokenfile.write_token_files(rows, vocabulary, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f/blocks").select("range").distinct().count() > 10
    got = sorted(tokenfile.digest_token_files(spark, f"{tmp_path}/f").collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist() and len(got) == 600
    library = Tokenizer.from_file(vocabulary)
    expected = [zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes()) for e in library.encode_batch([r["text"] for r in rows.collect()], add_special_tokens=False)]
    assert sorted(r["ids_crc32"] for r in got) == sorted(expected)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    found = langid.identify_languages(docs, docs.filter(fold != 1)).filter(fold == 1)
    row = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a"), F.min("lang_score").alias("s")).first()
    assert row["a"] >= 0.97 and row["s"] > 0


def test_languages_of_odd_rows(spark, docs, odd):
    found = langid.identify_languages(odd, docs)
    rows = {r["doc_id"]: r for r in found.collect()}
    for i, t in enumerate(ODD):
        assert (rows[i]["lang_pred"] == "und") == (not t or not any(map(str.isalpha, t))) and 0 <= rows[i]["lang_score"] <= 1
    nothing = langid.identify_languages(odd, odd.limit(0))
    assert {(r["lang_pred"], r["lang_score"]) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.identify_languages(odd.limit(0), docs).count() == 0


def test_network_equals_plain_convolution(docs):
    net = langid.train(docs, rows=60)
    some = [r["text"] for r in docs.orderBy("doc_id").limit(12).collect()] + ["é", "1 2 3", None, ""]
    langs, scores = langid.predict(net, some)
    for text, lang, p in zip(some, langs, scores, strict=True):
        other, q = plain.language(net, text)
        assert lang == other and p == pytest.approx(q, abs=1e-4)


def test_gradients_equal_finite_differences():
    net = langid.ByteCNN(["a", "b", "c"], seed=3)
    r = np.random.default_rng(1)
    x, y = r.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    for k in ("emb", "conv", "bias", "out", "out_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    net.bias += 0.3

    def loss():
        z = (net._patches(x) @ net.conv).max(axis=1) + net.bias
        logits = np.maximum(z, 0) @ net.out + net.out_bias
        return float(np.mean(np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(x)), y]))

    g = net.gradients(x, y)
    for k in ("emb", "conv", "bias", "out", "out_bias"):
        w = getattr(net, k)
        places = np.argwhere(net.mask) if k == "conv" else np.argwhere(np.ones_like(w))
        for at in map(tuple, r.permutation(places)[:25]):
            old, step = w[at], 1e-6
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * step), abs=1e-5), (k, at)


def test_network_learns():
    net = langid.ByteCNN(["a", "b"])
    r = np.random.default_rng(0)
    x = r.integers(0, 256, (200, langid.WINDOW)).astype(np.uint8)
    y = np.arange(200) % 2
    x[y == 1, ::5] = 7
    net.fit(x, y, steps=150)
    assert (net.logits(x).argmax(axis=1) == y).mean() > 0.95


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    scored = quality.classify_quality(docs.select("doc_id", "text"), labels.filter(fold != 0), rows=3000).filter(fold == 0).join(labels, "doc_id").toPandas()
    s, y = scored["quality_score"].to_numpy(), scored["quality"].to_numpy()
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.98 and ((s >= 0.3) == y).mean() > 0.96


def test_quality_equals_plain_ftrl(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    weights = plain.ftrl([t for d, t in rows if d in labels], [labels[d] for d, _ in rows if d in labels])
    odd = [(9_000 + i, t) for i, t in enumerate(ODD)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    scored = quality.classify_quality(table, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), training=docs)
    got = {r["doc_id"]: r["quality_score"] for r in scored.collect()}
    assert all(got[d] == pytest.approx(plain.quality_score(weights, t), abs=1e-4) for d, t in rows + odd)


def test_training_samples_are_bounded(spark):
    rows = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.pmod("id", F.lit(100)).cast("string")).alias("text"), F.lit("en").alias("lang"))
    sample = common.bounded_sample(rows, 300, 400)
    assert 0 < len(sample) <= 100 and sample["text"].str.len().sum() <= 400 and not sample.duplicated().any()
    assert len(common.bounded_sample(rows, 7, 10**6)) == 7 and common.bounded_sample(rows.limit(0), 7, 100).empty
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert 800 < common.thinned(many, ["doc_id"], 100).count() < 2400 and len(common.bounded_sample(many, 100, 10**6)) == 100


def test_training_samples_are_full_where_labels_are_sparse(spark):
    few = spark.range(400_000).filter("id % 100 = 0").select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    assert len(common.bounded_sample(few, 3000, 10**9)) == 3000
    # one id for all rows, and a text that most rows share
    one = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.greatest(F.lit(190_000), "id").cast("string")).alias("text"))
    assert len(common.bounded_sample(one, 3000, 10**9)) == 3000
    letters = one.withColumn("lang", F.lit("en"))
    assert {r["lang_pred"] for r in langid.identify_languages(one.limit(50), letters, rows=20).collect()} == {"en"}


def test_quality_learns_from_labels_that_have_documents(spark, monkeypatch):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(2)).cast("int").alias("quality"))
    docs = spark.range(0, 60_000, 10).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, marks: seen.append(len(texts)))
    quality.train(docs, labels, rows=6000)
    quality.train(docs, labels, rows=2000)
    assert seen == [6000, 2000]


def test_quality_of_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1), (1, None), (2, 9), (None, 1)], "doc_id long, quality int")
    scored = quality.classify_quality(odd, labels, training=docs, rows=50).collect()
    assert len(scored) == len(ODD) + 2 and all(0 <= r["quality_score"] <= 1 and r["quality_pred"] == (r["quality_score"] >= 0.3) for r in scored)
    assert {r["quality_score"] for r in quality.classify_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify_quality(odd.limit(0), labels).count() == 0
