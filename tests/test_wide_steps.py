"""Steps over wide rows and many models: what is shuffled, and rows as by the plain way."""

import pytest
from pyspark.sql import functions as F

from tagtide.operators import maxent
from tagtide.operators.model import apply_majorities, apply_majority, fit_majority
from tagtide.plans import base, catalog

SENTENCES = [("en", 1, 0, ["Ann", "saw", "Rome"], ["B-PER", "O", "B-LOC"]), ("en", 1, 1, ["the", "the", "Cat"], ["O", "O", "B-ORG"]),
             ("es", 2, 0, ["Rome", "the"], ["B-ORG", "O"]), ("es", 2, 1, [], [])]
SCHEMA = "lang string, doc_id bigint, line_no bigint, words array<string>, gold array<string>"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Documents of all languages; ``odd`` has an id that comes twice, a null text and an empty line."""
    root = tmp_path_factory.mktemp("wide")
    rows = [(i, lang, f"The {i} cat\n\nAnn of Rome  number{i} saw")
            for i, lang in enumerate(["en", "fr", "de", "es"] * 40)]
    odd = [*rows, (0, "en", "Twice 7"), (3, "es", None)]
    for name, table in (("plain", rows), ("odd", odd)):
        spark.createDataFrame(table, "doc_id bigint, lang string, text string").write.parquet(f"{root}/{name}/documents.parquet")
    return root


@pytest.mark.parametrize("name", ["plain", "odd"])
def test_encoded_rows_equal_aligning_before_the_splits(spark, docs, name):
    sf = f"{docs}/{name}"
    got = base.with_splits(spark, sf)
    want = base.assign_splits(base.aligned(spark, sf), base.DEFAULT_TARGETS)
    keyed = ["doc_id", "line_no", "lang", "split", "words", "gold", "pred", "pieces", "word_ids", "labels", "pred_labels", "ents"]
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(*keyed).collect())
    assert rows(got) == rows(want) and got.count() > 400


def test_encode_sorts_and_shuffles_no_aligned_row(spark, docs, monkeypatch):
    seen = []
    align = base.align
    monkeypatch.setattr(base, "align", lambda s, **k: seen.append(s.columns) or align(s, **k))
    base.encode_corpus(spark, f"{docs}/plain")
    assert len(seen) == 1 and {"split", "split_ord"} <= set(seen[0])


@pytest.mark.parametrize("name", ["plain", "odd"])
def test_mix_sentences_equal_the_join_by_key(spark, docs, name):
    sf, key = f"{docs}/{name}", ["lang", "doc_id", "line_no"]
    want = catalog.experiment_grid(spark, sf).join(base.with_splits(spark, sf).select(*key, "words", "gold"), key)
    cols = ["target_lang", *key, "words", "gold"]
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert rows(catalog._mix_sentences(spark, sf)) == rows(want)


def test_majorities_in_one_lookup_equal_one_at_a_time(spark):
    s = spark.createDataFrame([*SENTENCES, ("en", 1, 0, ["the", "Cat", "Ann"], ["B-PER", "O", "B-LOC"])], SCHEMA)
    model = fit_majority(s.withColumn("t", F.col("lang")), by="t")
    each = s.withColumn("t", F.explode(F.array(F.lit("en"), F.lit("es"), F.lit("xx"))))
    rows = lambda df: sorted(str(tuple(r)) for r in df.select("t", "lang", "doc_id", "line_no", "gold", "pred").collect())
    assert rows(apply_majorities(model, s, ["en", "es", "xx"], "t")) == rows(apply_majority(model, each, by="t"))


def test_models_are_looked_up_once_a_word(spark, monkeypatch):
    """Weights meet the distinct words, not every context under every model."""
    rows = {}

    def counted(r, table, keys, how="left", real=maxent.lookup):
        rows[tuple(keys)] = r.count()
        return real(r, table, keys, how)

    s = spark.createDataFrame(SENTENCES, SCHEMA).withColumn("key", F.col("lang"))
    weights, _ = maxent.train(maxent.context_counts(maxent.word_contexts(s, ["key"])), 1)
    counts = maxent.context_counts(maxent.word_contexts(s, []), ())
    monkeypatch.setattr(maxent, "lookup", counted)
    scored = maxent.score_contexts(weights, counts)
    contexts, words = counts.count(), counts.select("word").distinct().count()
    assert rows == {("feature",): 5 * words, ("prev",): contexts}
    assert scored.count() == 4 * contexts and scored.where("epoch = 0 AND s0 <> 0").count() == 0


def test_span_errors_cut_no_sentence_of_equal_tags(spark):
    from tagtide.operators.metrics import span_errors
    rows = [(1, ["B-PER", "O"], ["B-PER", "O"]), (2, ["B-PER", "O"], ["O", "B-LOC"]), (3, [], []), (4, None, None), (5, ["O"], None)]
    df = spark.createDataFrame(rows, "k int, gold array<string>, pred array<string>")
    out = span_errors(df, ["k"])
    assert {(r.k, r.kind, r.type, r.b, r.e) for r in out.collect()} == {(2, "fn", "PER", 0, 0), (2, "fp", "LOC", 1, 1)}
    assert "<=>" in out._jdf.queryExecution().optimizedPlan().toString()
