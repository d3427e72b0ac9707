"""Hand cases of FIXTURES.md section 3, one or more tests per rule."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tagtide.functions.spans import spans
from tagtide.functions.tags import id_tag, tag_id
from tagtide.operators.align import align, entity_count
from tagtide.operators.metrics import score
from tagtide.operators.predict import argmax, compat_lines, masked_pairs
from tagtide.operators.sample import sample_preserving_density
from tagtide.operators.splits import assign_splits, quotas, smallest_sets, split_sizes
from tagtide.sources.iob import read_sentences

CASE1 = ("#c\n1\tHi\tO\t-\t-\n2\tBob\tB-PER\t-\t-\n\n1\tSee\tO\t-\t-\n2\t#tag\tB-OTH\t-\t-\n"
         "\n\n1\tEnd\tO\t-\t-\n\n\n")


def _file(text, name="a.iob2"):
    d = tempfile.mkdtemp(prefix="tagtide-test-")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def _sents(spark, paths, **kw):
    return [(r.words, r.tags, r.raw) for r in read_sentences(spark, paths, **kw).orderBy("sent_ord").collect()]


def test_case1_islands_and_trailing_blanks(spark):
    s = _sents(spark, [_file(CASE1)])
    assert [w for w, _, _ in s] == [["Hi", "Bob"], ["See", "#tag"], [], ["End"]]
    assert s[1][1] == ["O", "B-OTH"]


def test_case2_comment_anywhere_drops_token(spark):
    s = _sents(spark, [_file(CASE1)], comment="anywhere")
    assert [w for w, _, _ in s] == [["Hi", "Bob"], ["See"], [], ["End"]]


def test_case3_raw_view_keeps_comments(spark):
    assert _sents(spark, [_file(CASE1)])[0][2] == ["#c", "Hi", "Bob"]


def test_case4_empty_file_is_one_empty_sentence(spark):
    assert _sents(spark, [_file("", "empty.iob2")]) == [([], [], [])]


def test_islands_independent_of_split_size(spark):
    body = "".join(f"# s {i}\n" + "".join(f"{j + 1}\tw{i}_{j}\tO\t-\t-\n" for j in range(i % 5))
                   + ("\n\n" if i % 7 == 0 else "\n") for i in range(200))
    p = _file(body, "big.iob2")
    results = []
    for mpb in ("128MB", "97", "40"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", mpb)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        results.append(_sents(spark, [p]))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # sentences over several batches
    results.append(_sents(spark, [p]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert results[0] == results[1] == results[2] == results[3]
    assert len(results[0]) == 200 + 200 // 7 + 1 - 0  # one extra empty sentence per double blank


def _spans_of(spark, tags):
    df = spark.createDataFrame([(tags,)], "t array<string>")
    return [(x.type, x.b, x.e) for x in df.select(spans("t").alias("s")).first().s]


def _roundtrip(spark, tags, mode):
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    return [r.d for r in df.select(id_tag(tag_id(F.col("tag"), mode), mode).alias("d")).collect()]


def test_case5_reference_tag_map_swaps_oth(spark):
    dec = _roundtrip(spark, ["B-OTH", "I-OTH"], "reference")
    assert dec == ["I-PER", "B-PER"]
    assert _spans_of(spark, dec) == [("PER", 0, 0), ("PER", 1, 1)]


def test_case6_clean_tag_map(spark):
    dec = _roundtrip(spark, ["B-OTH", "I-OTH"], "clean")
    assert dec == ["B-PER", "I-PER"]
    assert _spans_of(spark, dec) == [("PER", 0, 1)]


def test_unknown_tag_raises(spark):
    df = spark.createDataFrame([("B-XYZ",)], "tag string")
    with pytest.raises(Exception, match="unknown tag"):
        df.select(tag_id(F.col("tag"))).collect()


def _aligned(spark, words, tags):
    df = spark.createDataFrame([(words, tags)], "words array<string>, gold array<string>")
    return align(df).first()


def test_case7_first_piece_labels(spark):
    r = _aligned(spark, ["Argentinian", "is"], ["B-LOC", "O"])
    assert r.pieces[:6] == ["[CLS]", "Arge", "ntin", "ian", "is", "[SEP]"]
    assert r.labels == [-100, 5, -100, -100, 0, -100] + [-100] * 58
    assert r.attention_mask == [1] * 6 + [0] * 58
    assert r.word_ids[:6] == [None, 0, 0, 0, 1, None]


def test_case8_cut_at_64(spark):
    words = [f"w{i}" for i in range(61)] + ["abcdefghijk", "z"]
    r = _aligned(spark, words, ["B-LOC"] * 63)
    assert len(r.labels) == 64
    assert r.labels[62] == 5          # word 61 (3 pieces) keeps its first piece
    assert r.word_ids[62] == 61 and 62 not in r.word_ids
    assert r.lost == 3


def test_case9_empty_sentence(spark):
    r = _aligned(spark, [], [])
    assert r.labels == [-100] * 64 and sum(r.attention_mask) == 2


def _sample(spark, ents, size, chunk=None):
    rows = [("g", i, e, size) for i, e in enumerate(ents)]
    df = spark.createDataFrame(rows, "g string, ord bigint, ents bigint, size bigint")
    ch = [F.floor(F.col("ord") / chunk)] if chunk else [F.lit(0)]
    out = sample_preserving_density(df, ["g"], ["ord"], ch).collect()
    return sorted(r.ord for r in out), {r.short for r in out}


@pytest.mark.parametrize("chunk", [None, 2])
def test_case10_density_sample(spark, chunk):
    assert _sample(spark, [2, 0, 1, 0, 3, 0], 4, chunk)[0] == [0, 1, 2, 4]


@pytest.mark.parametrize("chunk", [None, 1])
def test_case11_need_above_size(spark, chunk):
    assert _sample(spark, [1, 1, 1, 9], 2, chunk)[0] == [0, 1]


def test_case12_short_sample(spark):
    assert _sample(spark, [9, 1, 1, 1], 2) == ([0], {True})


def test_case13_no_entities(spark):
    assert _sample(spark, [0, 0, 0], 2)[0] == [0, 1]


def test_case14_whole_group(spark):
    assert _sample(spark, [3, 0, 1], 3) == ([0, 1, 2], {False})


def _one_file_corpus(spark, lang, n):
    rows = [(lang, "full", 0, i, 0) for i in range(n)]
    return spark.createDataFrame(rows, "lang string, part string, part_rank int, doc_id bigint, line_no bigint")


@pytest.mark.parametrize("targets,train", [(["xx"], 5), (["yy"], 3)])
def test_case15_ratio_split(spark, targets, train):
    s = assign_splits(_one_file_corpus(spark, "xx", 7), targets).collect()
    assert sum(r.split == "train" for r in s) == train
    assert sorted(r.split_ord for r in s if r.split == "test") == list(range(7 - train))


def _registry(spark):
    return spark.createDataFrame([("slk", 0), ("eng", 1), ("swe", 2)], "lang string, ord int")


def test_case16_smallest_set_tie(spark):
    sizes = spark.createDataFrame([("slk", "train", 5), ("eng", "train", 3), ("swe", "train", 3)],
                                  "lang string, split string, n bigint")
    r = smallest_sets(sizes, _registry(spark)).first()
    assert (r.lang, r.n) == ("eng", 3)


def _score(spark, gold, pred):
    df = spark.createDataFrame([(gold, pred)], "gold array<string>, pred array<string>")
    return score(df).first()


def test_case17_score(spark):
    r = _score(spark, ["B-PER", "I-PER", "O", "B-LOC"], ["B-PER", "I-PER", "O", "B-ORG"])
    assert (r.tp, r.n_pred, r.n_gold) == (1, 2, 2)
    assert r.precision == r.recall == r.f1 == 0.5 and r.accuracy == 0.75


def test_case18_to_20_span_starts(spark):
    assert _spans_of(spark, ["O", "I-LOC", "I-LOC", "O"]) == [("LOC", 1, 2)]
    assert _spans_of(spark, ["B-PER", "I-LOC"]) == [("PER", 0, 0), ("LOC", 1, 1)]
    assert _spans_of(spark, ["B-LOC", "B-LOC"]) == [("LOC", 0, 0), ("LOC", 1, 1)]


def test_case21_no_predicted_span(spark):
    r = _score(spark, ["B-PER", "O"], ["O", "O"])
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_case22_masked_pairs(spark):
    df = spark.createDataFrame([([0, 1, 2], [0, 1, 2]), ([0, 0, 1], [0, 0, -100])],
                               "p array<int>, g array<int>")
    r = masked_pairs(df, "p", "g").collect()
    assert [x.pred_tags for x in r] == [["O", "B-ORG", "I-ORG"], ["O", "O"]]
    assert [x.gold_tags for x in r] == [["O", "B-ORG", "I-ORG"], ["O", "O"]]


def test_case23_compat_shift(spark):
    df = spark.createDataFrame([(0, ["a", "b"], ["x1", "x2"]), (1, ["c"], ["x3"])],
                               "s bigint, w array<string>, p array<string>")
    df = df.withColumn("g", F.col("p"))
    out = compat_lines(df, ["s"], ["s"], [F.lit(0)], words="w", pred="p", gold="g")
    got = [r.value for r in out.orderBy("k").collect()]
    assert got == ["1\ta\tx1\tx1", "1\tb\tx2\tx2", ""]


def test_case24_argmax_tie_first(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],)], "s array<double>")
    assert df.select(argmax("s").alias("a")).first().a == 1


def _sizes(spark):
    return spark.createDataFrame([("slk", "train", 50), ("slk", "test", 10), ("eng", "train", 40),
                                  ("eng", "test", 12), ("swe", "train", 30), ("swe", "test", 20)],
                                 "lang string, split string, n bigint")


def test_case25_k_above_smallest_test(spark):
    with pytest.raises(Exception, match="greater than the smallest test set"):
        quotas(_sizes(spark), ["eng"], "eng", k=11).collect()


def test_case26_unknown_target(spark):
    with pytest.raises(ValueError):
        quotas(_sizes(spark), ["eng"], "deu", k=5)


def test_quota_rules(spark):
    q = {r.lang: (r.train_quota, r.test_quota)
         for r in quotas(_sizes(spark), ["eng", "swe"], "eng", k=5).collect()}
    assert q == {"eng": (30, 10), "slk": (5, 10), "swe": (5, 10)}
    q = {r.lang: r.train_quota for r in quotas(_sizes(spark), ["eng"], "all", 5).collect()}
    assert q == {"eng": 30, "slk": 30, "swe": 30}


def test_entity_count_ignores_specials(spark):
    df = spark.createDataFrame([([-100, 0, 3, -100, 5],)], "labels array<tinyint>")
    assert df.select(entity_count("labels").alias("n")).first().n == 2


def test_split_sizes_three_files(spark):
    rows = ([("en", "train", 1, i, 0) for i in range(4)] + [("en", "dev", 2, i, 0) for i in range(2)]
            + [("en", "test", 3, i, 0) for i in range(3)])
    df = spark.createDataFrame(rows, "lang string, part string, part_rank int, doc_id bigint, line_no bigint")
    assert {(r.split, r.n) for r in split_sizes(df, ["en"]).collect()} == {("train", 6), ("test", 3)}
    s = assign_splits(df, ["en"]).where("part = 'dev'").collect()
    assert sorted(r.split_ord for r in s) == [4, 5]


def test_vocab_splitter_greedy_longest_match(spark):
    from tagtide.functions.vocab import greedy_pieces, vocab_splitter
    vocab = frozenset(["Argent", "Arg", "##inian", "##in", "##ian", "is", "[UNK]"])
    assert greedy_pieces("Argentinian", vocab) == ["Argent", "##inian"]
    assert greedy_pieces("Argxyz", vocab) == ["[UNK]"]
    split = vocab_splitter(spark, vocab)
    df = spark.createDataFrame([(["Argentinian", "is"], ["B-LOC", "O"])], "words array<string>, gold array<string>")
    r = align(df, pieces=split("words")).first()
    assert r.pieces[:5] == ["[CLS]", "Argent", "##inian", "is", "[SEP]"]
    assert r.labels[:5] == [-100, 5, -100, 0, -100]


def test_flat_reader_strict_fields(spark):
    from tagtide.sources.iob import read_flat
    good = _file("#c\n1\tHi\tO\t-\t-\n\n1\tBob\tB-PER\t-\t-\n")
    rows = read_flat(spark, good).orderBy("block_start", "line_id").collect()
    assert [(r.word, r.tag) for r in rows] == [("Hi", "O"), ("Bob", "B-PER")]
    bad = _file("1\tHi\tO\n")
    with pytest.raises(Exception, match="expected 5 fields"):
        read_flat(spark, bad).collect()


def test_prediction_blocks_from_tokens(spark):
    from tagtide.sources.iob import prediction_blocks
    toks = spark.createDataFrame([(0, 1, "b", "O", "O"), (0, 0, "a", "B-PER", "B-LOC")],
                                 "s bigint, pos int, word string, pred string, gold string")
    r = prediction_blocks(toks, ["s"]).first()
    assert r.block == "1\ta\tB-PER\tB-LOC\n1\tb\tO\tO"


def test_tag_dimension_equals_map_literal(spark):
    from tagtide.functions.tags import tag_dim
    toks = spark.createDataFrame([("B-PER",), ("O",), ("I-OTH",)], "tag string")
    joined = toks.join(F.broadcast(tag_dim(spark)), "tag").select("tag", "tag_id")
    mapped = toks.select("tag", tag_id(F.col("tag")).cast("int").alias("tag_id"))
    assert sorted(joined.collect()) == sorted(mapped.collect())


@pytest.mark.parametrize("levels,fanout", [(2, 1024), (3, 2), (4, 2)])
def test_running_sums_levels_agree(spark, levels, fanout):
    from tagtide.operators.order import running_sums
    df = spark.range(0, 500).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"),
                                    (F.col("id") % 7).alias("v"))
    out = running_sums(df, ["g"], ["o"], [F.floor(F.col("o") / 10)], {"v": F.col("v")},
                       levels=levels, fanout=fanout)
    got = {(r.g, r.o): r.v_before for r in out.collect()}
    for g in (0, 1):
        acc = 0
        for o in range(g, 500, 2):
            assert got[(g, o)] == acc
            acc += o % 7
