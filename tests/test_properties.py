"""Properties: sample sizes, plan-shape invariance, streams equal batches."""

import pytest
from pyspark.sql import functions as F

from tagtide.operators.metrics import with_span_counts
from tagtide.plans import base
from tagtide.plans.catalog import QUERIES, _split_samples
from tagtide.sources.corpus import language_counts, tagged_sentences

from conftest import MEDIUM, SMALL


def test_samples_have_quota_rows_unless_short(spark):
    train, test = _split_samples(spark, MEDIUM, "all")
    sizes = {r.split: r.n for r in base.sizes(spark, MEDIUM).groupBy("split").agg(F.min("n").alias("n")).collect()}
    for df, split in ((train, "train"), (test, "test")):
        for r in df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short")).collect():
            assert r.n == sizes[split] or r.short


def test_sample_keeps_a_prefix_of_each_class(spark):
    train, _ = _split_samples(spark, MEDIUM, "all")
    full = base.with_splits(spark, MEDIUM).where("split = 'train'")
    for lang in ("en", "fr"):
        kept = {r.split_ord for r in train.where(F.col("lang") == lang).collect()}
        rows = full.where(F.col("lang") == lang).select("split_ord", "ents").orderBy("split_ord").collect()
        for cls in (True, False):
            ords = [r.split_ord for r in rows if (r.ents > 0) == cls]
            flags = [o in kept for o in ords]
            assert flags == sorted(flags, reverse=True)   # kept ones come first


def test_two_level_order_independent_of_chunking(spark):
    a = base.assign_splits(base.aligned(spark, SMALL), base.DEFAULT_TARGETS, chunk_docs=3)
    b = base.assign_splits(base.aligned(spark, SMALL), base.DEFAULT_TARGETS, chunk_docs=100000)
    cols = ["lang", "doc_id", "line_no", "split", "split_ord", "part_ord"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_results_independent_of_shuffle_partitions(spark):
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out.append(sorted(QUERIES["iob_sentences"](spark, SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out[0] == out[1]


def test_true_positives_bounded(spark):
    c = with_span_counts(tagged_sentences(spark, SMALL))
    assert c.where((F.col("tp") > F.col("n_pred")) | (F.col("tp") > F.col("n_gold"))).count() == 0


def test_fixture_counts_at_sf001(spark):
    r = QUERIES["score_overall"](spark, MEDIUM).first()
    assert (r.n_pred, r.n_gold, r.tp) == (31319, 26896, 25268)
    assert (r.n_tok, r.n_eq) == (390171, 382279)


def test_seeded_shuffle_is_a_permutation_of_the_mix(spark):
    a = QUERIES["seeded_shuffle"](spark, SMALL)
    b = QUERIES["train_mix_all"](spark, SMALL)
    assert sorted(a.select("lang", "doc_id", "line_no").collect()) == \
        sorted(b.select("lang", "doc_id", "line_no").collect())
    keys = a.select("shuffle_key").collect()
    assert len({k.shuffle_key for k in keys}) == len(keys)
    assert sorted(a.collect()) == sorted(QUERIES["seeded_shuffle"](spark, SMALL).collect())


def test_model_selection_keeps_best(spark):
    from tagtide.operators.model import select_model
    train, test = _split_samples(spark, SMALL, "all")
    sp = base.with_splits(spark, SMALL).select("lang", "doc_id", "line_no", "words", "gold")
    keys = ["lang", "doc_id", "line_no"]
    model, scores = select_model(train.select(*keys).join(sp, keys), test.select(*keys).join(sp, keys),
                                 iterations=(2, 8))
    assert [i for i, _ in scores] == [2, 8]
    assert model is not None and all(0.0 <= f <= 1.0 for _, f in scores)


def test_watcher_stops_when_all_jobs_terminal(spark):
    from tagtide.session import read_table, scratch_path
    from tagtide.streaming.status import watch_until_terminal
    events = read_table(spark, SMALL, "events")
    src, table, ckpt = (scratch_path(spark, n) for n in ("w-src", "w-table", "w-ckpt"))
    events.write.parquet(src)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    all_types = [r.event_type for r in events.select("event_type").distinct().collect()]
    watch_until_terminal(spark, src, schema, table, ckpt, terminal=all_types, poll="1 second",
                         timeout_s=120)
    assert spark.read.parquet(table).count() == events.select("user_id").distinct().count()


def test_one_model_per_target(spark):
    from tagtide.operators.model import fit_per_target
    from tagtide.plans.catalog import experiment_grid
    grid = experiment_grid(spark, SMALL)
    sp = base.with_splits(spark, SMALL).select("lang", "doc_id", "line_no", "words", "gold")
    _, test = _split_samples(spark, SMALL, "all")
    keys = ["lang", "doc_id", "line_no"]
    res = fit_per_target(grid, sp, test.select(*keys).join(sp, keys), max_iter=3).collect()
    assert sorted(r.target_lang for r in res) == ["en", "es"]
    assert all(0.0 <= r.f1 <= 1.0 and r.n_train_tokens > 0 for r in res)


def test_predictions_with_empty_sentences_read_back_as_written(spark, tmp_path):
    from tagtide.sources.iob import read_predictions, sentence_block, write_predictions

    rows = [(0, ["a"], ["O"], ["O"]), (1, [], [], []), (2, [], [], []), (3, ["b", "c#"], ["B-PER", "O"], ["O", "O"])]
    df = spark.createDataFrame(rows, "k int, words array<string>, pred array<string>, gold array<string>")
    write_predictions(df.select("k", sentence_block().alias("block")), f"{tmp_path}/p", ["k"], num_files=1)
    back = read_predictions(spark, f"{tmp_path}/p").orderBy("sent_ord").collect()
    assert [(r.words, r.pred, r.gold) for r in back] == [r[1:] for r in rows]


def test_corpus_load_by_manifest(spark, tmp_path):
    from tagtide.sources.corpus import load_corpus, of_languages
    for name, words in (("en-train", "a b"), ("en-test", "c"), ("fr-train", "d")):
        text = "".join(f"{i + 1}\t{w}\tO\t-\t-\n" for i, w in enumerate(words.split()))
        (tmp_path / f"{name}.iob2").write_text(text + "\n" + text + "\n")
    files = [(lang, part, f"{tmp_path}/{lang}-{part}.iob2") for lang in ("en", "fr") for part in ("train", "test")]
    s, failed = load_corpus(spark, files)
    got = sorted((r.lang, r.part, r.sent_ord, " ".join(r.words)) for r in s.collect())
    assert got == [("en", "test", 0, "c"), ("en", "test", 1, "c"), ("en", "train", 0, "a b"), ("en", "train", 1, "a b"),
                   ("fr", "train", 0, "d"), ("fr", "train", 1, "d")]
    assert failed == [("fr", "test", f"{tmp_path}/fr-test.iob2")]
    s, failed = load_corpus(spark, files, "EN")
    assert s.count() == 4 and failed == []
    assert of_languages(load_corpus(spark, files)[0], "FR").count() == 2
    assert of_languages(load_corpus(spark, files)[0]).count() == 6
    with pytest.raises(ValueError):
        load_corpus(spark, files, ["en", "xx"])
    with pytest.raises(FileNotFoundError):
        load_corpus(spark, files[3:], "fr")


def test_published_batches(spark, tmp_path):
    from tagtide.streaming.status import publish_to, read_published
    table = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        read_published(spark, table)
    put = publish_to(table)
    for b in (0, 1, 1, 2):
        put(spark.range(b + 1), b)
        assert read_published(spark, table).count() == b + 1
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["batch_id=1", "batch_id=2"]
    (tmp_path / "t" / "batch_id=3").mkdir()  # a batch cut off while it was written
    assert read_published(spark, table).count() == 3


def test_collate_pads_to_the_longest_of_a_batch(spark):
    from tagtide.operators.align import collate
    rows = spark.createDataFrame([(0, [1, 2, 0, 0], 2), (0, [3, 0, 0, 0], 1), (1, [4, 5, 6, 7], 4)],
                                 "b int, x array<int>, n int")
    got = sorted((r.b, r.x, r.width, r.n_pad) for r in collate(rows, "b", ["x"], F.col("n")).collect())
    assert got == [(0, [1, 2], 2, 0), (0, [3, 0], 2, 1), (1, [4, 5, 6, 7], 4, 0)]


def test_majority_tagger(spark):
    from tagtide.operators.model import apply_majority, fit_majority
    train = spark.createDataFrame([("en", 1, 0, ["Ann", "ann", "ran"], ["B-PER", "O", "O"]), ("fr", 2, 0, ["ran"], ["B-LOC"])],
                                  "lang string, doc_id long, line_no long, words array<string>, gold array<string>")
    model = fit_majority(train)
    assert {(r.lang, r.word): r.tag for r in model.collect()} == {("en", "ann"): "O", ("en", "ran"): "O", ("fr", "ran"): "B-LOC"}
    test = spark.createDataFrame([("fr", 3, 0, ["RAN", "new"], ["O", "B-PER"])], train.schema)
    r = apply_majority(model, test).first()
    assert (r.gold, r.pred) == (["O", "B-PER"], ["B-LOC", "O"])


def test_changed_documents_are_read_anew(spark, tmp_path):
    from tagtide.plans.base import corpus
    import shutil
    shutil.copyfile(f"{SMALL}/documents.parquet", tmp_path / "documents.parquet")
    sf = str(tmp_path)
    first = corpus(spark, sf)
    assert corpus(spark, sf).inputFiles() == first.inputFiles()
    kept = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 50").toPandas()
    kept.to_parquet(tmp_path / "documents.parquet")
    assert corpus(spark, sf).select("doc_id").distinct().count() < first.select("doc_id").distinct().count()


@pytest.mark.parametrize("lang", ["it", None])
def test_unregistered_languages_raise_and_are_reported(spark, lang):
    docs = spark.createDataFrame([(1, "en", "One line"), (2, lang, "Una riga")], "doc_id bigint, lang string, text string")
    assert {tuple(r) for r in language_counts(docs).collect()} == {("en", True, 1), (lang, False, 1)}
    for read in (lambda s: s.count(), lambda s: s.select("doc_id").collect()):
        with pytest.raises(Exception, match="not in the registry: " + (lang or "null")):
            read(tagged_sentences(spark, SMALL, documents=docs))


def test_held_out_loss_is_the_mean_over_the_test_tokens(spark):
    from math import log
    from pyspark.ml.linalg import Vectors
    from tagtide.operators.model import held_out_loss, train_and_score
    p = spark.createDataFrame([(Vectors.dense([0.5, 0.5]), 0.0), (Vectors.dense([0.2, 0.8]), 1.0)], ["probability", "label"])
    assert abs(held_out_loss(p).first().test_loss - (-log(0.5) - log(0.8)) / 2) < 1e-12
    s = tagged_sentences(spark, SMALL).where("doc_id < 12")
    r = train_and_score(s.where("doc_id < 8"), s.where("doc_id >= 8"), max_iter=2).first()
    assert r.test_loss > 0
