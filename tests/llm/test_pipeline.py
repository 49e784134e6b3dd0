"""The pipeline's stages against plain versions of their own, on the small tables."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from plain import WORD, classes_at, ftrl, language, mix, quality_score
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import langid, similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of every stage over the small tables, written and read again."""
    root, docs, seen = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{root}/{name}"))
        docs = seen[name][1]
    return seen


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_first_stages_keep_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_language_stage(stages):
    before, after = stages["language_id"]
    net = langid.train(before)
    found = {r["doc_id"]: language(net, r["text"]) for r in before.collect()}
    assert ids(after) == sorted(d for d, (lang, p) in found.items() if lang != "und" and p >= 0.5)


def test_quality_stage(spark, stages):
    before, after = stages["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    known = [(t, labels[d]) for d, t in rows if d in labels]
    weights = ftrl([t for t, _ in known], [y for _, y in known])
    assert ids(after) == [d for d, t in rows if quality_score(weights, t) >= 0.3]


def test_dedup_stage(stages):
    before, after = stages["simhash_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    group = classes_at([t for _, t in rows])
    assert ids(after) == [d for i, (d, _) in enumerate(rows) if group[i] == i]


def test_mixing_stage(stages):
    before, after = stages["source_mixing"]
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"]))) for r in before.collect()]
    assert Counter(ids(after)) == Counter({d: c for d, _, _, _, c in mix(rows) if c})


def test_encoding_stage(stages):
    before, after = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = {r["doc_id"]: len(library.encode(r["text"])) for r in before.collect()}
    assert all(r["n_tokens"] == n[r["doc_id"]] and r["round_trip"] for r in after.collect()) and after.count() == before.count()


def test_run_equals_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids_crc32", "round_trip"]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, stages["sentencepiece"][1].collect()))


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    odd = spark.createDataFrame([(None, docs.first()["text"] + " no id here", "en", "s", 10), (77_001, None, None, None, None), (77_002, "", "fr", None, 0)], docs.schema)
    clash = {"lang_score": "mine", "lang_pred": "mine", "quality_score": "mine", "quality_pred": "mine", "_copies": "mine", "_copy": "mine", "_row": "mine", "_fp": "mine", "size": "mine", "column_1": "mine"}
    table = docs.unionByName(odd).withColumns({k: F.lit(v) for k, v in clash.items()})
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = seen[name] = stage(spark, table, SF)
        assert set(table.columns) == {*docs.columns, *clash}, name
        assert all(r[c] == "mine" for r in table.collect() for c in clash), name
    kept = {r["doc_id"] for r in seen["language_id"].collect()}
    assert None in kept and not kept & {77_001, 77_002}  # no letter, no language
    assert stages["sentencepiece"](spark, table, SF).filter("round_trip").count() == table.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_each_row_of_a_group_stands_for_itself(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, base), (5, base), (None, base), (5, other), (None, other), (7, "alone here"), (None, None), (8, ""), (None, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in similar.one_of_each(docs).collect())
    assert got == Counter([(5, base), (5, other), (7, "alone here"), (8, ""), (None, "x y z")])
    assert similar.one_of_each(docs.limit(0)).count() == 0


def edited(words, at, r):
    near = list(words)
    for k in at:
        near[k] = f"x{r.randrange(10**6)}"
    return " ".join(near)


@pytest.mark.parametrize("star_rows, cell_rows", [(2048, 1024), (3, 4)])
def test_dedup_against_brute_force_similarity(spark, monkeypatch, star_rows, cell_rows):
    monkeypatch.setattr(similar, "STAR_ROWS", star_rows)
    monkeypatch.setattr(similar, "CELL_ROWS", cell_rows)
    r, rows = random.Random(5), []
    for _ in range(40):
        words = [f"w{r.randrange(4000)}" for _ in range(200)]
        rows.append(" ".join(words))
        rows += [edited(words, r.sample(range(5, 195), edits), r) for edits in (1, 2, 3, 4, 6)]
    # a template whose first half all share: candidates of one another that do not link, but for some pairs
    template = [f"t{i}" for i in range(100)]
    for k in range(60):
        own = template + [f"k{k}_{i}" for i in range(100)]
        rows.append(" ".join(own))
        if k % 6 == 0:
            rows.append(edited(own, [150], r))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    group = classes_at(rows)
    kept = [d for d, g in enumerate(group) if d == g]
    assert ids(similar.one_of_each(docs)) == kept
