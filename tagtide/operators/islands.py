"""Sentences from IOB2 line rows: blank lines end sentences (gaps and islands).

A line's sentence number is the count of blank lines before it in its file.
Lines are cut into bounded *chunks* and folded into fragments, the part of a
sentence inside one chunk; a small per-chunk table of blank counts gives the
offsets.  Only fragments at a chunk edge, at most two per chunk, are regrouped
to stitch sentences that cross a chunk boundary.

Two ways lead to the fragments.  Lines that come from a scan in file order
(``fold_scan``) are folded where they are read, an Arrow batch at a time, the
split being the chunk: no line is shuffled.  Lines in any other layout (``group_sentences``)
are windowed per (file, chunk) and grouped inside the same partitioning.

Blank lines are grouped with the sentence they end, so empty sentences in the
middle of a file survive; empty sentences at the end of a file are dropped,
and a file without words keeps its first (empty) sentence.  A sentence is one
row: a file without blank lines is a single sentence, and as large as that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.session import materialize


def classify_lines(lines: DataFrame, comment: str = "start", word_field: int = 1,
                   tag_field: int = 2, strict_fields: int | None = None,
                   extra: dict[str, int] | None = None) -> DataFrame:
    """Add ``kind`` ('b' blank, 'c' comment, 'w' word), ``word`` and ``tag``.

    comment="start": a line starting with '#' is a comment, kept in the raw view.
    comment="anywhere": a line containing '#' anywhere is dropped (loader variant).
    strict_fields: fail unless a word line has exactly that many tab fields.
    """
    v = F.col("value")
    if comment == "start":
        is_comment = v.startswith("#")
    elif comment == "anywhere":
        is_comment = F.instr(v, "#") > 0
    else:
        raise ValueError(f"unknown comment rule {comment!r}")
    kind = F.when(v == "", "b").when(is_comment, "c").otherwise("w")
    fields = F.split(v, "\t")
    if strict_fields is not None:
        fields = F.when(F.size(fields) == strict_fields, fields).otherwise(
            F.raise_error(F.concat(F.lit(f"expected {strict_fields} fields: "), v)).cast("array<string>"))
    out = lines.select("*", kind.alias("kind"))
    out = out.select("*",
                     F.when(F.col("kind") == "w", fields[word_field]).alias("word"),
                     F.when(F.col("kind") == "w", fields[tag_field]).alias("tag"),
                     *[F.when(F.col("kind") == "w", fields[i]).alias(name) for name, i in (extra or {}).items()])
    if comment == "anywhere":
        out = out.where(F.col("kind") != "c")
    return out


def group_sentences(lines: DataFrame, file_cols: Sequence[str], order: Sequence[str],
                    chunk: Sequence[Column] | None = None, comment: str = "start",
                    word_field: int = 1, tag_field: int = 2,
                    extra: dict[str, int] | None = None) -> DataFrame:
    """sentence(file..., sent_ord, words, tags, raw, extra...) from line rows.

    ``order`` gives the line order inside a file; ``chunk`` must be
    non-decreasing along it and bounded (defaults to the whole file).
    """
    files = list(file_cols)
    chunk = list(chunk) if chunk else [F.lit(0)]
    chunk_cols = [f"_c{i}" for i in range(len(chunk))]
    extra = extra or {}
    okeys = [f"_o{i}" for i in range(len(order))]
    # a line is shuffled whole and taken apart afterwards: one text is less than its fields
    lines = lines.select(*files, *[c.alias(n) for c, n in zip(chunk, chunk_cols)],
                         *[F.col(o).alias(n) for o, n in zip(order, okeys)], "value").repartition(*files, *chunk_cols)
    rows = classify_lines(lines, comment, word_field, tag_field, extra=extra)
    # one text per line: the word of a word line, the line itself for a
    # comment (the raw view), nothing for a blank
    text = F.when(F.col("kind") == "c", F.col("value")).otherwise(F.col("word"))
    rows = rows.select(*files, *chunk_cols, *okeys, "kind", text.alias("text"), "tag", *extra)
    w = (Window.partitionBy(*files, *chunk_cols).orderBy(*okeys)
         .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_local", F.coalesce(
        F.sum(F.when(F.col("kind") == "b", 1).otherwise(0)).over(w), F.lit(0)).cast("bigint"))
    # fragments: the window output is clustered by (file, chunk), so grouping
    # by (file, chunk, local) needs no new exchange
    item = F.struct(*[F.col(k) for k in okeys], "kind", "text", "tag", *extra)
    frags = rows.groupBy(*files, *chunk_cols, "_local").agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.max(F.when(F.col("kind") == "b", 1).otherwise(0)).alias("_closed"),
        F.max(F.when(F.col("kind") == "w", 1).otherwise(0)).alias("_has_words"))
    words = F.filter("_items", lambda x: x["kind"] == "w")
    # the blank of a fragment is its last line: before the k-th comment stand its place less k words
    notes = F.filter(F.transform("_items", lambda x, i: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), i.alias("at"))),
                     lambda x: x["kind"] == "c")
    frags = frags.select(
        *files, *chunk_cols, "_local", "_closed", "_has_words",
        ((F.col("_local") == 0) | (F.col("_closed") == 0)).cast("int").alias("_edge"),
        F.transform(words, _field("text")).alias("words"), F.transform(words, _field("tag")).alias("tags"),
        F.transform(notes, _field("text")).alias("_notes"), F.transform(notes, lambda x, k: x["at"] - k).alias("_note_at"),
        *[F.transform(words, _field(name)).alias(name) for name in extra])
    return stitch(frags, files, chunk_cols, list(extra))


def fold_scan(lines: DataFrame, comment: str = "start", word_field: int = 1, tag_field: int = 2,
              extra: dict[str, int] | None = None) -> DataFrame:
    """sentence(file, sent_ord, words, tags, raw, extra...) from the rows of
    ``sources.iob.read_lines``, taken directly after the scan: file,
    block_start, line_id, value, each split's lines standing together in order."""
    fields = {"words": word_field, "tags": tag_field, **(extra or {})}
    if comment not in ("start", "anywhere"):
        raise ValueError(f"unknown comment rule {comment!r}")

    def lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, behind = None, 0  # the split that the last batch ended in, and the blanks of it so far
        for batch in batches:
            value = batch.column("value")
            marked = pc.starts_with(value, "#") if comment == "start" else pc.match_substring(value, "#")
            if comment == "anywhere":
                batch = batch.filter(pc.invert(marked))
                value, marked = batch.column("value"), None
            if not len(batch):
                continue
            blank = pc.equal(value, "").to_numpy(zero_copy_only=False)
            is_note = np.zeros(len(batch), bool) if marked is None else ~blank & marked.to_numpy(zero_copy_only=False)
            is_word = ~blank & ~is_note
            file = batch.column("file").dictionary_encode().indices.to_numpy()
            block = batch.column("block_start").to_numpy()
            other = np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]
            starts = np.flatnonzero(other | np.r_[False, blank[:-1]])
            frag = np.cumsum(other | np.r_[False, blank[:-1]]) - 1
            run = np.maximum.accumulate(np.where(other, np.arange(len(batch)), 0))  # the first line here of a line's split
            before = np.cumsum(blank) - blank
            local = before - before[run]
            if (batch.column("file")[0].as_py(), block[0]) == split:
                local = local + np.where(run == 0, behind, 0)
            split, behind = (batch.column("file")[len(batch) - 1].as_py(), block[-1]), int(local[-1] + blank[-1])
            n_words = np.bincount(frag[is_word], minlength=len(starts))
            cells = pc.split_pattern(value.filter(pa.array(is_word)), "\t")
            if len(cells) and pc.min(pc.list_value_length(cells)).as_py() <= max(fields.values()):
                raise ValueError(f"a word line has no field {max(fields.values())}")
            texts = {name: pc.list_element(cells, k) for name, k in fields.items()}
            words_before = np.cumsum(is_word) - is_word
            closed = blank[np.r_[starts[1:], len(batch)] - 1]
            n_notes = np.bincount(frag[is_note], minlength=len(starts))
            note_at = (words_before - words_before[starts][frag])[is_note]
            columns = {
                "file": batch.column("file").take(pa.array(starts)), "_c0": pa.array(block[starts]),
                "_line": pa.array(batch.column("line_id").to_numpy()[starts]),
                "_local": pa.array(local[starts].astype(np.int64)),
                "_closed": pa.array(closed.astype(np.int32)),
                "_has_words": pa.array((n_words > 0).astype(np.int32)),
                # a batch may begin or end inside a sentence
                "_edge": pa.array(np.where(other[starts] | ~closed, 2, 0).astype(np.int32)),
                **{name: lists(n_words, x) for name, x in texts.items()},
                "_notes": lists(n_notes, value.filter(pa.array(is_note))),
                "_note_at": lists(n_notes, pa.array(note_at.astype(np.int32)))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    frags = lines.select("file", "block_start", "line_id", "value").mapInArrow(fold, ", ".join([
        "file string, _c0 bigint, _line bigint, _local bigint, _closed int, _has_words int, _edge int",
        *[f"`{name}` array<string>" for name in fields], "_notes array<string>, _note_at array<int>"]))
    return stitch(frags, ["file"], ["_c0"], list(extra or {}), ["_line"])


def _raw() -> Column:
    """The words of a fragment with its comments where they stood."""
    n = F.size("_notes")
    start = lambda k: F.when(k > 0, F.get("_note_at", k - 1)).otherwise(0)
    upto = F.flatten(F.transform("_notes", lambda x, k: F.concat(
        F.slice("words", start(k) + 1, F.get("_note_at", k) - start(k)), F.array(x))))
    rest = F.slice("words", start(n) + 1, F.size("words") - start(n))
    return F.when(n == 0, F.col("words")).otherwise(F.concat(upto, rest))


def stitch(frags: DataFrame, files: Sequence[str], chunk_cols: Sequence[str], extra: Sequence[str] = (),
           order: Sequence[str] = ()) -> DataFrame:
    """Sentences from fragments (file..., chunk..., order...: the order inside a
    chunk, _local: blanks before it in its chunk, _closed: ends in a blank,
    _has_words, _edge: 1 if it may go on in a neighbouring chunk, 2 if inside
    its own too, words, tags, _notes: comments, _note_at: words before each, extra...)."""
    files, chunk_cols = list(files), list(chunk_cols)
    arrays = ["words", "tags", "raw", *extra]
    # the fragments feed the chunk totals, whole sentences and edges: written
    # once to the shared folder, so that what made them runs a single time
    frags = materialize(frags.dropna(subset=[*files, *chunk_cols]), "fragments")
    totals = frags.groupBy(*files, *chunk_cols).agg(
        F.sum("_closed").alias("_blanks"), F.max("_local").alias("_most"),
        F.max(F.when(F.col("_has_words") == 1, F.col("_local"))).alias("_word_local"))
    file_w = Window.partitionBy(*files)
    ow = file_w.orderBy(*chunk_cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*files, *chunk_cols, "_word_local", "_most",
                            F.coalesce(F.sum("_blanks").over(ow), F.lit(0)).cast("bigint").alias("_off"))
    # empty sentences at the end of a file are dropped; a file without words
    # keeps its first sentence
    offsets = offsets.withColumn("_last", F.coalesce(F.max(F.col("_off") + F.col("_word_local")).over(file_w), F.lit(0)))
    # a file of one chunk that drops nothing needs no row; stored, the table's
    # size is known, and while it is small the fragments are not shuffled for it
    offsets = offsets.withColumn("_chunks", F.count(F.lit(1)).over(file_w)).where("_chunks > 1 or _most > _last")
    offsets = materialize(offsets.select(*files, *chunk_cols, "_off", "_last", "_chunks"), "offsets")
    numbered = (frags.withColumn("raw", _raw()).join(offsets, [*files, *chunk_cols], "left")
                .withColumn("sent_ord", F.coalesce("_off", F.lit(0)) + F.col("_local"))
                .where(F.col("_last").isNull() | (F.col("sent_ord") <= F.col("_last"))))
    # a fragment at an edge may continue in a neighbouring chunk; everything
    # else, and what has no neighbour, is a whole sentence
    edge = (F.col("_edge") == 2) | ((F.col("_edge") == 1) & (F.coalesce("_chunks", F.lit(1)) > 1))
    whole = numbered.where(~edge).select(*files, "sent_ord", *arrays)
    stitched = (numbered.where(edge).groupBy(*files, "sent_ord")
                .agg(F.array_sort(F.collect_list(F.struct(*chunk_cols, *order, *arrays))).alias("_parts"))
                .select(*files, "sent_ord",
                        *[F.flatten(F.transform("_parts", _field(name))).alias(name) for name in arrays]))
    return whole.unionByName(stitched)


def _field(name: str):
    return lambda x: x[name]
