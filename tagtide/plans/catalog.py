"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (mostly ``documents`` through the tagged
corpus) and runs over all of it; result columns are aliased and cast so that
they line up with the SQL oracle of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagtide.functions.tags import NUM_LABELS, id_tag, tag_id
from tagtide.operators.align import collate, decoded_words
from tagtide.operators.flat import flat_rows
from tagtide.operators.islands import group_sentences
from tagtide.operators.metrics import score, score_by_type, span_errors as span_error_rows, span_rows
from tagtide.operators.order import doc_chunk, ordinal
from tagtide.operators.predict import argmax, compat_lines, masked_pairs
from tagtide.operators.report import density, density_from_counts, density_rollup
from tagtide.operators.sample import sample_preserving_density
from tagtide.operators.splits import quotas, smallest_sets
from tagtide.plans.base import (LINE_CHUNK, ORDER, corpus, corpus_files_root, corpus_path, joined, sizes,
                                split_chunk, with_splits)
from tagtide.session import materialize, read_table, scratch_path, small_table
from tagtide.sources.corpus import (DEFAULT_TARGETS, PART_SUFFIXES, corpus_files, iob_lines, language_counts, load_corpus,
                                    of_languages, registry, tagged_tokens)
from tagtide.sources.iob import read_predictions, sentence_block, write_predictions
from tagtide.sources.stored import pair, store
from tagtide.streaming.feeds import LINE_SCHEMA, conversation_lines, stream_lines, stream_score
from tagtide.streaming.jobs import job_runs, read_runs, stream_runs
from tagtide.streaming.status import (EVENT_TERMINAL_STATES, all_terminal, first_state, job_events,
                                      latest_state, read_published, stream_latest_state, stream_watch)
from tagtide.streaming.tail import stream_tail

SPLIT_ORDER = ["part_rank", "doc_id", "line_no"]
MIX_K = 10
GRID_TARGET = "en"
SHUFFLE_SEED = 42
BATCH_SIZE = 8
CORPUS_ROOT = "corpus"


# ---- sources: IOB2 lines -> sentences, flat sequences, manifests ------------

def iob_sentences(spark: SparkSession, sf: str) -> DataFrame:
    lines = iob_lines(corpus(spark, sf), "gold")
    s = group_sentences(lines, ["file"], ["line_no", "idx"],
                        chunk=[F.expr(f"line_no div {LINE_CHUNK}")])
    return s.select(F.col("file").cast("bigint").alias("file"), "sent_ord",
                    F.size("words").cast("bigint").alias("n_words"),
                    joined("words").alias("words"), joined("tags").alias("tags"),
                    joined("raw").alias("raw"))


def iob_file_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as IOB2 text files, loaded by the manifest of every file that
    may exist; language and part come from the path, the key from the comment."""
    s, _ = load_corpus(spark, corpus_files(corpus_files_root(spark, sf)))
    head = F.coalesce(F.get(F.col("raw"), 0), F.lit(""))
    return s.select(
        "lang", "part",
        F.regexp_extract(head, r"^# sent_id = ([0-9]+)-[0-9]+$", 1).try_cast("bigint").alias("doc_id"),
        F.regexp_extract(head, r"^# sent_id = [0-9]+-([0-9]+)$", 1).try_cast("bigint").alias("line_no"),
        F.size("words").cast("bigint").alias("n_words"),
        joined("words").alias("words"), joined("tags").alias("tags"))


def corpus_load_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences, words and files missing per (lang, part) of the target languages, loaded from files."""
    files = corpus_files(corpus_files_root(spark, sf))
    s, failed = load_corpus(spark, files, [t.upper() for t in DEFAULT_TARGETS])
    found = s.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n_sent"), F.sum(F.size("words")).cast("bigint").alias("n_words"),
                                          F.lit(0).alias("missing"))
    gone = spark.createDataFrame([(lang, part, 0, 0, 1) for lang, part, _ in failed],
                                 "lang string, part string, n_sent bigint, n_words bigint, missing int")
    return found.unionByName(gone)


def target_language_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The encoded sentences of one language, its code in upper case; only its partitions are read."""
    s = of_languages(with_splits(spark, sf), GRID_TARGET.upper())
    return s.select("lang", "split", "doc_id", "line_no", F.size("words").cast("bigint").alias("n_words"))


def iob_sentences_hash_anywhere(spark: SparkSession, sf: str) -> DataFrame:
    """The loader that drops every line holding a ``#``, wherever it stands."""
    lines = iob_lines(corpus(spark, sf), "gold")
    s = group_sentences(lines, ["file"], ["line_no", "idx"], chunk=[F.expr(f"line_no div {LINE_CHUNK}")],
                        comment="anywhere")
    return s.select(F.col("file").cast("bigint").alias("file"), "sent_ord",
                    F.size("words").cast("bigint").alias("n_words"), joined("words").alias("words"),
                    joined("tags").alias("tags"))


def iob_flat_sequence(spark: SparkSession, sf: str) -> DataFrame:
    # a sentence's lines come out of its row together, so its line number is their block
    lines = iob_lines(corpus(spark, sf), "gold").select(
        "file", F.col("line_no").alias("block_start"), F.col("idx").alias("line_id"), "value")
    chunks = flat_rows(lines, seq_len=128)
    return chunks.select(F.col("file").cast("bigint").alias("file"), "seq", "n_pieces",
                         F.array_join("labels", ",").alias("labels"))


def corpus_failed_files(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", F.lit(CORPUS_ROOT), F.concat(F.col("path_prefix"), F.col("suffix")))
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(x).alias("suffix")) for p, _, x in PART_SUFFIXES])
    manifest = (registry(spark).select("lang", "path_prefix", F.explode(parts).alias("p"))
                .select("lang", "p.part", "p.suffix", "path_prefix")
                .select("lang", "part", "suffix", path.alias("path")))
    found = (corpus(spark, sf).select("lang", "part").distinct()
             .join(F.broadcast(manifest), ["lang", "part"]).select("path"))
    failed = manifest.where(F.col("suffix") != "").join(found, "path", "left_anti")
    return failed.select(
        F.regexp_extract("path", r"/([a-z]+)_docs-ud", 1).alias("lang"),
        F.coalesce(F.nullif(F.regexp_extract("path", r"-(train|dev|test)\.iob2$", 1), F.lit("")),
                   F.lit("full")).alias("part"),
        "path")


def corpus_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents a language, and whether the registry has it; the corpus raises on one that it has not."""
    return language_counts(read_table(spark, sf, "documents"))


# ---- tags, pieces, alignment -------------------------------------------------

def tag_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    tok = tagged_tokens(corpus(spark, sf))
    sides = tok.select(F.lit("gold").alias("side"), F.col("gold").alias("tag")).unionByName(
        tok.select(F.lit("pred").alias("side"), F.col("pred").alias("tag")))
    counts = sides.groupBy("side", "tag").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.select("side", "tag", tag_id(F.col("tag")).cast("bigint").alias("tag_id"),
                         id_tag(tag_id(F.col("tag"))).alias("decoded"), "n")


def align_first_piece(spark: SparkSession, sf: str) -> DataFrame:
    a = with_splits(spark, sf)
    return a.select("doc_id", "line_no", F.col("n_pieces").cast("bigint").alias("n_pieces"),
                    F.expr("size(filter(labels, x -> x <> -100))").cast("bigint").alias("n_labelled"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"),
                                lambda acc, x: acc + x).alias("mask_sum"),
                    F.array_join("labels", ",").alias("labels"))


def truncation_loss(spark: SparkSession, sf: str) -> DataFrame:
    a = with_splits(spark, sf)
    return a.where(F.col("lost") > 0).select(
        "lang", "doc_id", "line_no", F.col("n_pieces").cast("bigint").alias("n_pieces"),
        F.col("lost").cast("bigint").alias("lost"))


def sentence_entities(spark: SparkSession, sf: str) -> DataFrame:
    d = density(with_splits(spark, sf), ["lang", "part"])
    return d.select("lang", "part", "n_sent", "with_entities", "without_entities", "n_entities")


def entity_density_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    d = density(with_splits(spark, sf), ["lang", "split"])
    return d.select("lang", "split", "n_sent", "n_tokens", "n_entities", "density")


def entity_density_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Densities with per-language and overall totals (ROLLUP)."""
    return density_rollup(with_splits(spark, sf)).select(
        "lang", "split", "n_sent", "n_tokens", "n_entities", "density")


# ---- splits and sizes --------------------------------------------------------

def set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sizes(spark, sf)


def smallest_sets_q(spark: SparkSession, sf: str) -> DataFrame:
    return smallest_sets(sizes(spark, sf), registry(spark)).select("split", "lang", "n")


def smallest_target_sets(spark: SparkSession, sf: str) -> DataFrame:
    return smallest_sets(sizes(spark, sf), registry(spark), DEFAULT_TARGETS).select("split", "lang", "n")


def ratio_split(spark: SparkSession, sf: str) -> DataFrame:
    s = with_splits(spark, sf).where(F.col("part") == "full")
    return s.select("lang", "doc_id", "line_no", "split", "split_ord")


def train_dev_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = with_splits(spark, sf)
    return s.select("lang", "part", "doc_id", "line_no", "split", "split_ord")


# ---- density-preserving samples and training mixes ---------------------------

def density_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every language sampled to the size of the smallest language."""
    a = with_splits(spark, sf).select("lang", "doc_id", "line_no", "ents")
    size = small_table(a.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
                       .groupBy().agg(F.min("n").alias("size"))).first()["size"]
    a = a.withColumn("size", F.lit(size).cast("bigint"))
    s = sample_preserving_density(a, ["lang"], ORDER, [doc_chunk("doc_id")])
    return s.select("lang", "doc_id", "line_no", F.col("ents").cast("bigint").alias("ents"),
                    F.col("short").cast("int").alias("short"))


def _split_samples(spark: SparkSession, sf: str, target: str = "all", k: int = MIX_K,
                   carry: tuple[str, ...] = ()):
    """(train sample, test sample); ``carry`` names extra columns the samples keep."""
    sp = with_splits(spark, sf).select("lang", "split", "part_rank", "doc_id", "line_no",
                                       "split_ord", "ents", *carry)
    q = F.broadcast(small_table(quotas(sizes(spark, sf), DEFAULT_TARGETS, target, k)))
    train = (sp.where(F.col("split") == "train")
             .join(q.select("lang", F.col("train_quota").alias("size")), "lang")
             .where(F.col("size") > 0))
    test = sp.where(F.col("split") == "test").join(q.select("lang", F.col("test_quota").alias("size")), "lang")
    group = ["lang", "split"]
    return (sample_preserving_density(train, group, SPLIT_ORDER, split_chunk()),
            sample_preserving_density(test, group, SPLIT_ORDER, split_chunk()))


def train_mix_all(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split_samples(spark, sf, "all")
    return train.select("lang", "doc_id", "line_no", "split_ord")


def train_mix_target(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split_samples(spark, sf, GRID_TARGET, MIX_K)
    return train.select("lang", "doc_id", "line_no", "split_ord")


def test_balanced(spark: SparkSession, sf: str) -> DataFrame:
    _, test = _split_samples(spark, sf, "all")
    return test.select("lang", "doc_id", "line_no", "split_ord")


def _grid(spark: SparkSession, sf: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The training mix of every target language, built in one pass; ``carry`` names extra columns it keeps."""
    sz = sizes(spark, sf)
    grid = None
    for t in DEFAULT_TARGETS:
        g = quotas(sz, DEFAULT_TARGETS, t, MIX_K).select(
            F.lit(t).alias("target_lang"), "lang", F.col("train_quota").alias("size"))
        grid = g if grid is None else grid.unionByName(g)
    grid = F.broadcast(small_table(grid.where(F.col("size") > 0)))
    sp = with_splits(spark, sf).where(F.col("split") == "train").select(
        "lang", "split", "part_rank", "doc_id", "line_no", "ents", *carry)
    # one copy of a language per distinct quota (at most two), not per target
    per_size = sp.join(grid.select("lang", "size").distinct(), "lang")
    s = sample_preserving_density(per_size, ["lang", "split", "size"], SPLIT_ORDER, split_chunk())
    return s.join(grid, ["lang", "size"]).select("target_lang", "lang", "doc_id", "line_no", *carry)


def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf)


def _mix_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The words and gold tags of every target's training mix.

    The mixes carry them, so nothing is shuffled to join them back.  A document
    whose id comes twice in its language has no key of its own: then every mix
    row takes all sentences of its key, by that join."""
    from tagtide.operators.model import KEY
    first = corpus(spark, sf).where(F.col("line_no") == 0)
    if first.groupBy("lang", "doc_id").count().where(F.col("count") > 1).isEmpty():
        return _grid(spark, sf, ("words", "gold"))
    return experiment_grid(spark, sf).join(with_splits(spark, sf).select(*KEY, "words", "gold"), KEY)


def density_report_sampled_vs_entire(spark: SparkSession, sf: str) -> DataFrame:
    # the samples carry their entity counts, so no join back to the corpus is needed
    sp = with_splits(spark, sf)
    train, test = _split_samples(spark, sf, "all")
    cols = ["lang", "split", "ents"]
    entire = sp.select(F.lit("entire").alias("scope"), *cols)
    sampled = train.select(*cols).unionByName(test.select(*cols)).select(F.lit("sampled").alias("scope"), *cols)
    d = density_from_counts(entire.unionByName(sampled), ["lang", "scope", "split"])
    return d.select("lang", "scope", "split", "n_sent", "n_tokens", "n_entities", "density")


def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """The train mix in a seeded random order: md5 of the row key and the seed
    sorts the rows, and a row's position is its rank.  The leading hex digits
    of the key deal the order over chunks of like size."""
    train, _ = _split_samples(spark, sf, "all")
    key = F.md5(F.concat_ws("|", "lang", "doc_id", "line_no", F.lit(str(SHUFFLE_SEED))))
    train = materialize(train.select("lang", "doc_id", "line_no", key.alias("shuffle_key")), "shuffle-keys")
    o = ordinal(train.withColumn("_all", F.lit(0)), ["_all"], ["shuffle_key"],
                [F.conv(F.substring("shuffle_key", 1, 5), 16, 10).cast("bigint")], name="position", levels=3)
    return o.select("lang", "doc_id", "line_no", "shuffle_key", F.col("position").cast("bigint").alias("position"))


def _batches(spark: SparkSession, sf: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The train mix in registry and file order, cut into batches."""
    train, _ = _split_samples(spark, sf, "all", carry=carry)
    # the prefix reads its input twice: write the sample once instead of sampling twice
    train = materialize(train.select("lang", "doc_id", "line_no", "split_ord", *carry), "train-mix")
    t = train.join(F.broadcast(registry(spark).select("lang", "ord")), "lang").withColumn("_all", F.lit(0))
    o = ordinal(t, ["_all"], ["ord", "split_ord"],
                [F.col("ord"), F.expr("split_ord div 4096")], name="row", levels=3)
    return o.select("lang", "doc_id", "line_no", F.expr(f"row div {BATCH_SIZE}").alias("batch_id"), *carry)


def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _batches(spark, sf)


def batch_collate(spark: SparkSession, sf: str) -> DataFrame:
    """Batches padded to their longest row instead of the fixed width."""
    kept = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    c = collate(_batches(spark, sf, ("labels", "attention_mask")), "batch_id", ["labels"], kept)
    return c.select("batch_id", "lang", "doc_id", "line_no", "width", "n_pad",
                    F.array_join("labels", ",").alias("labels"))


# ---- predictions, labels and scores ------------------------------------------

def argmax_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as class scores: the largest entry is the predicted class.
    Classes fold onto the tag ids; a row without a label is masked."""
    e = read_table(spark, sf, "embeddings").where(F.col("label").isNotNull())
    out = e.select("vec_id", argmax(F.col("embedding")).alias("pred_id"), F.col("label").alias("gold_id"))
    return out.select("vec_id", F.col("pred_id").cast("bigint").alias("pred_id"),
                      id_tag(F.col("pred_id") % NUM_LABELS).alias("pred_tag"),
                      id_tag(F.col("gold_id") % NUM_LABELS).alias("gold_tag"))


def masked_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    m = masked_pairs(with_splits(spark, sf), "pred_labels", "labels")
    return m.select("doc_id", "line_no", joined("pred_tags").alias("pred_tags"),
                    joined("gold_tags").alias("gold_tags"))


def entity_spans(spark: SparkSession, sf: str) -> DataFrame:
    return span_rows(corpus(spark, sf), ORDER).select(
        "doc_id", "line_no", "side", "type", F.col("b").cast("bigint").alias("b"),
        F.col("e").cast("bigint").alias("e"))


def span_errors(spark: SparkSession, sf: str) -> DataFrame:
    return span_error_rows(corpus(spark, sf), ORDER).select(
        "doc_id", "line_no", "kind", "type", F.col("b").cast("bigint").alias("b"),
        F.col("e").cast("bigint").alias("e"))


SCORE_COLS = ["n_pred", "n_gold", "tp", "n_tok", "n_eq", "precision", "recall", "f1", "accuracy"]


def score_overall(spark: SparkSession, sf: str) -> DataFrame:
    return score(corpus(spark, sf)).select(*SCORE_COLS)


def score_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return score(corpus(spark, sf), ["lang"]).select("lang", *SCORE_COLS)


def score_by_type_q(spark: SparkSession, sf: str) -> DataFrame:
    """Per entity type (an extension: the overall figures drop these)."""
    return score_by_type(corpus(spark, sf)).select("type", "n_pred", "n_gold", "tp",
                                                   "precision", "recall", "f1")


def _test_split(spark: SparkSession, sf: str) -> DataFrame:
    """The test split of every language, with the language's registry position."""
    return with_splits(spark, sf).where(F.col("split") == "test").join(
        F.broadcast(registry(spark).select("lang", F.col("ord").alias("lang_ord"))), "lang")


def prediction_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = _test_split(spark, sf)
    return s.select("lang", "doc_id", "line_no", sentence_block("words", "pred", "gold").alias("block"))


def prediction_lines_compat(spark: SparkSession, sf: str) -> DataFrame:
    s = masked_pairs(_test_split(spark, sf), "pred_labels", "labels")
    s = s.withColumn("out_words", decoded_words("pieces", "word_ids"))
    # an empty sentence decodes to one empty word, which the writer also prints blank
    s = s.withColumn("out_words", F.when(F.size("out_words") == 0, F.array(F.lit("")))
                     .otherwise(F.col("out_words")))
    # the global prefix reads its input at every level: write it once
    s = materialize(s.select(*ORDER, "lang_ord", "split_ord", "out_words", "pred_tags", "gold_tags"), "compat-input")
    lines = compat_lines(s, ORDER, ["lang_ord", "split_ord"], [F.col("lang_ord"), F.expr("split_ord div 4096")])
    return lines.select(F.col("k").cast("bigint").alias("k"), "value")


def prediction_file_score(spark: SparkSession, sf: str) -> DataFrame:
    """Write the test predictions of all languages as IOB2 text, read the files back, score them."""
    s = _test_split(spark, sf).select("lang_ord", "split_ord", sentence_block("words", "pred", "gold").alias("block"))
    path = scratch_path(spark, "predictions")
    write_predictions(s, path, ["lang_ord", "split_ord"])
    back = read_predictions(spark, path)
    return score(back, gold="gold", pred="pred").select(*SCORE_COLS)


# ---- language features -------------------------------------------------------

# Three-letter codes of the feature rows, by embedding label 0..9.
FEATURE_CODES = ["eng", "fra", "deu", "spa", "slk", "swe", "nor", "heb", "ron", "por"]


def feature_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Mean feature vector of every code (all vectors of its label), looked up
    by language; languages outside the registry's codes have no row there, and
    codes without a corpus language are kept.  Entries are summed in millionths,
    so a sum does not depend on its order."""
    e = read_table(spark, sf, "embeddings")
    codes = spark.createDataFrame(list(enumerate(FEATURE_CODES)), "label int, iso string")
    entry = e.join(F.broadcast(codes), "label").select(
        "iso", F.posexplode("embedding").alias("dim", "x")).groupBy("iso", "dim").agg(
        F.sum(F.round(F.col("x").cast("double") * 1e6).cast("bigint")).alias("total"), F.count("x").alias("n"))
    mean = F.col("total").cast("double") / (F.col("n").cast("double") * 1e6)
    feats = entry.groupBy("iso").agg(F.max("n").alias("n_vectors"), F.count(F.lit(1)).alias("n_features"),
                                     F.min(mean).alias("f_min"), F.max(mean).alias("f_max"))
    langs = corpus(spark, sf).select("lang").distinct().join(
        F.broadcast(registry(spark).select("lang", "iso")), "lang")
    return langs.join(feats, "iso", "full").select(
        "lang", "iso", "n_vectors", "n_features", "f_min", "f_max")


# ---- job state and streams ---------------------------------------------------

def latest_state_q(spark: SparkSession, sf: str) -> DataFrame:
    return latest_state(job_events(read_table(spark, sf, "events")))


def all_terminal_q(spark: SparkSession, sf: str) -> DataFrame:
    return all_terminal(latest_state(job_events(read_table(spark, sf, "events"))), EVENT_TERMINAL_STATES)


def first_state_q(spark: SparkSession, sf: str) -> DataFrame:
    return first_state(job_events(read_table(spark, sf, "events")))


def _event_files(spark: SparkSession, sf: str) -> tuple[str, StructType]:
    """Events dropped into a folder as files, in order of time."""
    events = read_table(spark, sf, "events")
    src = scratch_path(spark, "events-src")
    events.repartitionByRange(F.col("ts"), F.col("event_id")).write.parquet(src)
    return src, events.schema


def stream_latest_state_q(spark: SparkSession, sf: str) -> DataFrame:
    """Event files drained by the streaming aggregate."""
    src, schema = _event_files(spark, sf)
    table, ckpt = (scratch_path(spark, n) for n in ("latest", "latest-ckpt"))
    stream_latest_state(spark, src, schema, table, ckpt)
    return read_published(spark, table)


def stream_watch_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every job watched to its first terminal state."""
    src, schema = _event_files(spark, sf)
    table, ckpt = (scratch_path(spark, n) for n in ("watch", "watch-ckpt"))
    stream_watch(spark, src, schema, table, ckpt, EVENT_TERMINAL_STATES)
    return read_published(spark, table)


def _in_micros(runs: DataFrame) -> DataFrame:
    return runs.withColumns({c: F.unix_micros(c) for c in ("started", "last_ts")})


def job_runs_q(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of every job: to a terminal event, or to a day of silence."""
    return _in_micros(job_runs(job_events(read_table(spark, sf, "events"), zoned=True), EVENT_TERMINAL_STATES))


def stream_job_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same runs, found by a stream whose state ends with them."""
    src, schema = _event_files(spark, sf)
    table, ckpt = (scratch_path(spark, n) for n in ("runs", "runs-ckpt"))
    stream_runs(spark, src, schema, table, ckpt, EVENT_TERMINAL_STATES)
    return _in_micros(read_runs(spark, table))


def stream_lines_q(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns rolled into line files and tailed by the file stream."""
    lines = conversation_lines(read_table(spark, sf, "conversations"))
    src, table, ckpt = (scratch_path(spark, n) for n in ("lines-src", "lines", "lines-ckpt"))
    lines.write.json(src)
    stream_lines(spark, src, table, ckpt)
    return spark.read.parquet(table)


def stream_score_q(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences arriving as files, scored by a running streaming sum."""
    # the materialised corpus folder is the stream source: its files arrive as they are written
    src = corpus_path(spark, sf)
    table, ckpt = (scratch_path(spark, n) for n in ("score", "score-ckpt"))
    stream_score(spark, src, table, ckpt)
    return read_published(spark, table).select(*SCORE_COLS)


def stream_score_once(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences delivered, scored, delivered again in new files and scored
    on: the second delivery changes nothing."""
    sents = corpus(spark, sf).select("lang", "doc_id", "line_no", "gold", "pred")
    src, table, ckpt = (scratch_path(spark, n) for n in ("once-src", "once", "once-ckpt"))
    for _ in range(2):
        sents.write.mode("append").parquet(src)
        stream_score(spark, src, table, ckpt, once_within="1 day")
    return read_published(spark, table).select(*SCORE_COLS)


def stream_tail_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation lines as records of text files that are followed by byte."""
    lines = conversation_lines(read_table(spark, sf, "conversations"))
    src, table, ckpt = (scratch_path(spark, n) for n in ("tail-src", "tail", "tail-ckpt"))
    record = F.to_json(F.struct(*lines.columns), {"ignoreNullFields": "false"})
    lines.select(record.alias("value")).write.text(src)
    stream_tail(spark, src, table, ckpt)
    return spark.read.parquet(table).select(F.from_json("line", LINE_SCHEMA).alias("r")).select("r.*")


def stored_score(spark: SparkSession, sf: str) -> DataFrame:
    """Gold and predicted tags stored apart and paired again by position."""
    key = ["lang", "part_rank", "doc_id", "line_no"]
    c = corpus(spark, sf)
    gold, pred = (spark.table(store(c.select(*key, side), side, key)) for side in ("gold", "pred"))
    return score(pair(gold, pred, key), ["lang"]).select("lang", *SCORE_COLS)


# ---- token classifier ----------------------------------------------------------

def token_features_q(spark: SparkSession, sf: str) -> DataFrame:
    """What the classifier sees of every word of the corpus."""
    from tagtide.operators.model import FEATURES, token_features
    f = token_features(corpus(spark, sf))
    return f.select("lang", "doc_id", "line_no", F.col("pos").cast("bigint").alias("pos"), "word", *FEATURES, "tag",
                    F.col("label").cast("bigint").alias("label"))


def majority_tagger(spark: SparkSession, sf: str) -> DataFrame:
    """One closed-form tagger per language: commonest tag of a word in the whole
    train split, scored on the whole test split."""
    from tagtide.operators.model import apply_majority, fit_majority
    s = with_splits(spark, sf)
    model = fit_majority(s.where(F.col("split") == "train"))
    return score(apply_majority(model, s.where(F.col("split") == "test")), ["lang"]).select("lang", *SCORE_COLS)


def per_target_tagger(spark: SparkSession, sf: str) -> DataFrame:
    """One closed-form tagger per target language, each trained on that target's
    mix, all in one pass, and scored on the whole test split."""
    from tagtide.operators.model import KEY, apply_majorities, fit_majority
    model = fit_majority(_mix_sentences(spark, sf), by="target_lang")
    test = with_splits(spark, sf).where(F.col("split") == "test").select(*KEY, "words", "gold")
    tagged = apply_majorities(model, test, DEFAULT_TARGETS, "target_lang")
    return score(tagged, ["target_lang"]).select("target_lang", *SCORE_COLS)


TRAIN_EPOCHS = 3


def _target_models(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights and losses of a tagger per target language, trained together on
    the targets' mixes, and the test split's sentences."""
    from tagtide.operators import maxent
    from tagtide.operators.model import KEY
    s = with_splits(spark, sf)
    words = maxent.word_contexts(_mix_sentences(spark, sf).withColumnRenamed("target_lang", "key"), ["key"])
    weights, losses = maxent.train(maxent.context_counts(words), TRAIN_EPOCHS)
    return weights, losses, s.where(F.col("split") == "test").select(*KEY, "words", "gold")


def target_training_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Mean training and held-out loss by epoch of every target's tagger, all trained in one pass an epoch."""
    from tagtide.operators import maxent
    weights, losses, test = _target_models(spark, sf)
    held = materialize(maxent.context_counts(maxent.word_contexts(test, []), ()), "held-out-contexts")
    return losses.join(maxent.held_out_losses(weights, held), ["key", "epoch"]).select(
        F.col("key").alias("target_lang"), F.col("epoch").cast("bigint").alias("epoch"), "n_train", "train_loss", "test_loss")


def target_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Every epoch of every target's tagger scored on the whole test split in one pass, and the best of each."""
    from tagtide.operators import maxent
    from tagtide.operators.model import KEY
    weights, _, test = _target_models(spark, sf)
    scored = maxent.choose(maxent.span_scores(weights, test, KEY), ["model_key"])
    return scored.select(F.col("model_key").alias("target_lang"), F.col("epoch").cast("bigint").alias("epoch"), *SCORE_COLS, "best")


def vocab_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word of the corpus cut by a vocabulary: the affixes of the benchmark's words."""
    from tagtide.functions.vocab import affix_vocab, split_distinct
    known = read_table(spark, sf, "benchmark").select(F.explode(F.split("text", "[ \n]")).alias("word"))
    cut = split_distinct(corpus(spark, sf).select(F.explode("words").alias("word")), affix_vocab(known))
    return cut.select("word", "n", F.size("pieces").cast("bigint").alias("n_pieces"), joined("pieces").alias("pieces"))


def token_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Train on the balanced train mix, score on the balanced test sets."""
    from tagtide.operators.model import train_and_score
    # the samples carry words and tags, so no join back to the corpus is needed
    train, test = _split_samples(spark, sf, "all", carry=("words", "gold"))
    cols = ["lang", "doc_id", "line_no", "words", "gold"]
    return train_and_score(train.select(*cols), test.select(*cols), model_path=scratch_path(spark, "model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "iob_sentences": iob_sentences,
    "iob_file_sentences": iob_file_sentences,
    "target_language_sentences": target_language_sentences,
    "corpus_load_targets": corpus_load_targets,
    "iob_sentences_hash_anywhere": iob_sentences_hash_anywhere,
    "iob_flat_sequence": iob_flat_sequence,
    "corpus_failed_files": corpus_failed_files,
    "corpus_languages": corpus_languages,
    "tag_encode_decode": tag_encode_decode,
    "align_first_piece": align_first_piece,
    "truncation_loss": truncation_loss,
    "sentence_entities": sentence_entities,
    "entity_density_by_lang": entity_density_by_lang,
    "entity_density_rollup": entity_density_rollup,
    "set_sizes": set_sizes,
    "smallest_sets": smallest_sets_q,
    "smallest_target_sets": smallest_target_sets,
    "ratio_split": ratio_split,
    "train_dev_merge": train_dev_merge,
    "density_sample": density_sample,
    "train_mix_all": train_mix_all,
    "train_mix_target": train_mix_target,
    "test_balanced": test_balanced,
    "experiment_grid": experiment_grid,
    "density_report_sampled_vs_entire": density_report_sampled_vs_entire,
    "seeded_shuffle": seeded_shuffle,
    "batch_assign": batch_assign,
    "batch_collate": batch_collate,
    "argmax_labels": argmax_labels,
    "masked_label_pairs": masked_label_pairs,
    "entity_spans": entity_spans,
    "span_errors": span_errors,
    "score_overall": score_overall,
    "score_by_lang": score_by_lang,
    "score_by_type": score_by_type_q,
    "prediction_lines": prediction_lines,
    "prediction_lines_compat": prediction_lines_compat,
    "prediction_file_score": prediction_file_score,
    "feature_lookup": feature_lookup,
    "latest_state": latest_state_q,
    "all_terminal": all_terminal_q,
    "first_state": first_state_q,
    "stream_latest_state": stream_latest_state_q,
    "stream_watch": stream_watch_q,
    "job_runs": job_runs_q,
    "stream_job_runs": stream_job_runs,
    "stream_lines": stream_lines_q,
    "stream_score": stream_score_q,
    "stream_score_once": stream_score_once,
    "stream_tail_lines": stream_tail_lines,
    "stored_score": stored_score,
    "majority_tagger": majority_tagger,
    "per_target_tagger": per_target_tagger,
    "target_training_loss": target_training_loss,
    "target_best_epoch": target_best_epoch,
    "vocab_pieces": vocab_pieces,
    "token_features": token_features_q,
    "token_classifier": token_classifier,
}
