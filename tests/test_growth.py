"""Steps whose shuffled, spilled and written bytes must not outgrow their input."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import tagtide.operators.islands as islands
import tagtide.sources.corpus as corpus_source
from tagtide.sources.iob import read_sentences


def _kept(monkeypatch, module):
    """Names and columns of the tables that ``module`` stores, as they are stored."""
    seen, store = {}, module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: seen.setdefault(name, store(df, name)))
    return seen


SENTENCES = [("en", 0, 1, d, n, ws, ["O"] * len(ws))
             for d in (1, 2) for n, ws in enumerate([["a", "b#"], [], ["#c"], ["d"] * 7])]
SCHEMA = "lang string, part_rank int, part int, doc_id bigint, line_no bigint, words array<string>, gold array<string>"


def test_files_are_written_from_one_row_a_sentence(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "files"), spark.createDataFrame(SENTENCES, SCHEMA).coalesce(1)
    dealt, repartition = [], type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda df, *by: dealt.append(df.count()) or repartition(df, *by))
    corpus_source.write_corpus_files(rows, root)
    want = []
    for _, _, _, d, n, ws, tags in SENTENCES:
        want += [f"# sent_id = {d}-{n}", *[f"{i}\t{w}\t{t}\t-\t-" for i, (w, t) in enumerate(zip(ws, tags), 1)], ""]
    assert sorted(r.value for r in spark.read.text(root).collect()) == sorted(want)
    assert dealt == [len(SENTENCES)]


@pytest.mark.parametrize("batch", [2, 3, 10_000])
def test_comments_between_words_come_back_in_place(spark, tmp_path, batch):
    lines = ["# a", "1\tx\tO", "# b", "# c", "2\ty\tO", "# d", "", "# alone", "", "3\tz\tO", "", "", "# end"]
    (tmp_path / "f").write_text("\n".join(lines) + "\n")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, batch)
    try:
        got = read_sentences(spark, str(tmp_path / "f")).orderBy("sent_ord").collect()
    finally:
        spark.conf.unset(conf)
    assert [(r.words, r.raw) for r in got] == [
        (["x", "y"], ["# a", "x", "# b", "# c", "y", "# d"]), ([], ["# alone"]), (["z"], ["z"])]
    rows = spark.createDataFrame([Row(file=1, n=i, value=v) for i, v in enumerate(lines)])
    got = islands.group_sentences(rows, ["file"], ["n"], [F.expr(f"n div {batch}")]).orderBy("sent_ord").collect()
    assert [(r.words, r.raw) for r in got] == [
        (["x", "y"], ["# a", "x", "# b", "# c", "y", "# d"]), ([], ["# alone"]), (["z"], ["z"])]


def test_fragments_hold_a_word_once_and_offsets_are_few(spark, tmp_path, monkeypatch):
    seen = _kept(monkeypatch, islands)
    lines = ["# s", "1\tx\tO", ""] * 40
    (tmp_path / "f").write_text("\n".join(lines) + "\n")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, 7)
    try:
        assert read_sentences(spark, str(tmp_path / "f"), empty_files=False).count() == 40
    finally:
        spark.conf.unset(conf)
    # one split, however many batches: no offset at all, and no word stored a second time in a raw view
    assert seen["offsets"].count() == 0
    assert "raw" not in seen["fragments"].columns


def test_whole_files_are_not_shuffled_for_their_offsets(spark, monkeypatch):
    seen = _kept(monkeypatch, islands)
    rows = spark.createDataFrame([Row(file=f, n=i, value=v) for f in range(30) for i, v in enumerate(["# s", "1\tx\tO", ""])])
    out = islands.group_sentences(rows, ["file"], ["n"], [F.expr("n div 256")])
    assert out.count() == 30 and seen["offsets"].count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_small_vocabularies_are_matched_where_the_words_stand(spark, monkeypatch):
    import tagtide.functions.vocab as vocab
    looked = []
    plain = vocab.lookup
    monkeypatch.setattr(vocab, "lookup", lambda *a: looked.append(1) or plain(*a))
    words = spark.createDataFrame([(w,) for w in ["abcab", "", "xy", "abx", "c", "abcab"]], "word string")
    pieces = spark.createDataFrame([(p,) for p in ["ab", "abc", "##a", "##ab", "c", "##c", "x", "##x"]], "piece string")
    found = [sorted(tuple(r) for r in vocab.longest_matches(words.where("word <> ''").distinct(), pieces, "##", most).collect())
             for most in (100, 0)]
    assert found[0] == found[1] and looked == [1]
    got = {r.word: (r.n, r.pieces) for r in vocab.split_distinct(words, pieces).collect()}
    assert got == {"abcab": (2, ["abc", "##ab"]), "": (1, []), "xy": (1, ["[UNK]"]), "abx": (1, ["ab", "##x"]), "c": (1, ["c"])}
    assert looked == [1]


def test_features_of_a_word_come_without_its_sentence(spark):
    from tagtide.operators.model import token_features
    ws = ["Ünder", "z9", "A-b1", "éX", "d", "٣x", "ß"]
    f = token_features(spark.createDataFrame([("en", 1, 0, ws, ["O"] * 7), ("en", 1, 1, [], [])],
                                             "lang string, doc_id long, line_no long, words array<string>, gold array<string>"))
    rows = f.orderBy("pos").collect()
    assert [r.w_shape for r in rows] == ["Xxxxx", "xd", "X-xd", "xX", "x", "٣x", "x"]
    assert [r.w_title for r in rows] == ["true", "false", "true", "false", "false", "false", "false"]
    assert [r.w_digit for r in rows] == ["false", "true", "true", "false", "false", "false", "false"]
    assert [r.w_prev for r in rows] == ["<s>", "ünder", "z9", "a-b1", "éx", "d", "٣x"]
    assert [r.w_next for r in rows] == ["z9", "a-b1", "éx", "d", "٣x", "ß", "</s>"]


def test_tags_need_a_digit_search_only_in_lines_with_one(spark):
    from tagtide.sources.corpus import tagged_sentences
    text = "Über Über émile Émile 7up a1b longlonglonglong Zed\nplain Upper elevenchars twelvecharsx\n\n 9"
    docs = spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string")
    got = [(r.gold, r.pred) for r in tagged_sentences(spark, "", docs).orderBy("line_no").collect()]
    assert got == [(["O", "B-PER", "O", "B-PER", "B-LOC", "I-LOC", "B-ORG", "B-PER"],
                    ["O", "O", "O", "O", "B-LOC", "I-LOC", "B-ORG", "B-PER"]),
                   (["O", "B-PER", "O", "B-ORG"], ["O", "B-PER", "B-ORG", "I-ORG"]), ([], []), (["B-LOC"], ["B-LOC"])]


def test_classifier_hashes_training_tokens_once_and_predicts_test_tokens_once(spark, monkeypatch):
    from tagtide.operators import model
    from tagtide.operators.metrics import score
    rows = [("en", d, n, ["Ann", f"of{d}", "Rome", "9"][: n + 2], ["B-PER", "O", "B-LOC", "O"][: n + 2]) for d in range(8) for n in range(3)]
    s = spark.createDataFrame(rows, "lang string, doc_id bigint, line_no bigint, words array<string>, gold array<string>")
    train, test = s.where("doc_id < 5"), s.where("doc_id >= 5")
    fit = model.build(4).fit(model.token_features(train))
    plain = fit.transform(model.token_features(test))
    want, loss = score(model.predicted_sentences(plain)).first(), model.held_out_loss(plain).first().test_loss
    seen, featured, features = _kept(monkeypatch, model), [], model.token_features
    monkeypatch.setattr(model, "token_features", lambda df, *a: featured.append(df) or features(df, *a))
    monkeypatch.setattr(model, "held_out_loss", None)
    got = model.train_and_score(train, test, 4).first()
    assert {k: df.columns for k, df in seen.items()} == {"train-features": ["features", "label"]} and len(featured) == 2
    assert (got.n_train_tokens, got.n_test_tokens) == (45, 27) and (got.precision, got.f1) == (want.precision, want.f1)
    assert got.test_loss == pytest.approx(loss) and got.final_loss == pytest.approx(fit.stages[-1].summary.objectiveHistory[-1])
