"""The five stages, alone on odd tables and together."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_dropped int, score double, _doc int"
WORDS = [f"{a}{b}{c}{d}" for a in "bdkl" for b in "aeiou" for c in "mnrst" for d in "aeiou"]
BENCH = " ".join(f"bench{i}" for i in range(40))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    body = lambda i: " ".join(random.Random(i).choices(WORDS, k=60))
    rows = [(i, body(i) + (" idiot scum" if i % 10 == 1 else "") + f"\n{body(i + 500)}", "en", "s", None, 5, 0.1, 1) for i in range(120)]
    rows += [(900, body(2) + f"\n{body(502)}", "en", "s", 1, 5, 0.1, 1), (901, body(3) + "\n" + body(503).rsplit(" ", 1)[0] + " other", "en", "s", 1, 5, 0.1, 1)]
    rows += [(902, f"{body(777)} {BENCH}", "en", "s", 1, 5, 0.1, 1), (903, None, None, None, None, None, None, None), (904, "", "en", "s", 0, 5, 0.1, 1), (None, "no number at all here", "en", "s", 1, 5, 0.1, 1)]
    license_ = "this line stands in many documents and is dropped from all but the first of them"
    rows += [(950 + i, f"{license_}\n{body(300 + i)}", "en", "s", 1, 5, 0.1, 1) for i in range(4)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 1)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), f"test-{k}")
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i in range(120) if i % 10 == 1}
    left = set(kept["toxicity"])
    assert not toxic & left and {0, 2, 3, 900, 901, 902, 903, 904, None} <= left
    cut = kept["line dedup"]
    assert set(cut) == left and cut[951].text.count("\n") == 0 and cut[950].text.count("\n") == 1 and cut[951].n_chars == len(cut[951].text) and cut[951].n_dropped == 5
    assert cut[900].text == kept["toxicity"][900].text  # a whole copy is left to the next stage
    near = set(kept["n-gram jaccard join"])
    assert near == left - {900, 901}
    assert set(kept["decontamination"]) == near - {902}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(p.doc_id or -1 for p in packed) == sorted(i or -1 for i in near - {902})


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) > 90 and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
