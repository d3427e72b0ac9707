"""A file as one flat sequence of pieces, cut into fixed-width rows.

The sequence ignores sentences: the pieces of all words of a file follow one
another, a row holds ``seq_len - 2`` of them between two specials, and a word
cut by a row edge is labelled again at the start of the next row.

The lines are folded where the scan reads them: a run of lines of one Arrow
batch becomes one *chunk*, its tag ids and piece counts as two arrays.  Where a
chunk begins in the sequence follows from a table with one number per chunk;
with that, every chunk cuts its own rows.  Only the rows at a chunk's two ends
are put together with its neighbours'.  No line and no word is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.pieces import DEFAULT_WIDTH
from tagtide.functions.tags import IGNORE_ID, tag_ids
from tagtide.session import materialize

DEFAULT_SEQ_LEN = 128


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def fold_words(lines: DataFrame, comment: str = "start", word_field: int = 1, tag_field: int = 2,
               strict_fields: int | None = 5, width: int = DEFAULT_WIDTH, mode: str = "reference") -> DataFrame:
    """chunk(file, _c0, _c1, n, tags, sizes) from (file, block_start, line_id,
    value), the lines of a block standing together in order, as a scan reads them.

    ``n`` counts the pieces of the chunk; ``tags`` has the tag id of every word,
    ``sizes`` the number of its pieces.  Comments and blank lines are skipped.
    A word line without ``strict_fields`` fields, or with an unknown tag, raises."""
    if comment not in ("start", "anywhere"):
        raise ValueError(f"unknown comment rule {comment!r}")
    ids = tag_ids(mode)
    known, numbers = pa.array(list(ids)), np.array(list(ids.values()), np.int32)
    least = max(word_field, tag_field) + 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column("value")
            if not len(value):
                continue
            marked = pc.starts_with(value, "#") if comment == "start" else pc.match_substring(value, "#")
            is_word = pc.invert(pc.or_(marked, pc.equal(value, "")))
            cells = pc.split_pattern(value.filter(is_word), "\t")
            n_fields = pc.list_value_length(cells).to_numpy(zero_copy_only=False)
            bad = n_fields != strict_fields if strict_fields is not None else n_fields < least
            if bad.any():
                raise ValueError(f"expected {strict_fields or least} fields: {value.filter(is_word)[int(np.argmax(bad))]}")
            letters = pc.utf8_length(pc.list_element(cells, word_field)).to_numpy(zero_copy_only=False)
            place = pc.index_in(pc.list_element(cells, tag_field), known)
            if place.null_count:
                raise ValueError(f"unknown tag {pc.list_element(cells, tag_field).filter(pc.is_null(place))[0]}")
            file = batch.column("file").dictionary_encode().indices.to_numpy()
            block, line = batch.column("block_start").to_numpy(), batch.column("line_id").to_numpy()
            # a chunk goes on through the next block of its file where nothing can stand between
            step = block[1:] - block[:-1]
            starts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (step < 0) | (step > 1)])
            at = np.flatnonzero(is_word.to_numpy(zero_copy_only=False))
            sizes = -(-letters // width)
            words = np.diff(np.searchsorted(at, np.r_[starts, len(value)]))
            total = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(words)]]
            yield pa.RecordBatch.from_arrays([
                batch.column("file").take(pa.array(starts)), pa.array(block[starts], pa.int64()),
                pa.array(line[starts], pa.int64()), pa.array(np.diff(total), pa.int64()),
                _lists(words, numbers[place.to_numpy(zero_copy_only=False)], pa.int32()),
                _lists(words, sizes, pa.int32())], names=["file", "_c0", "_c1", "n", "tags", "sizes"])

    kind = lines.schema["file"].dataType.simpleString()
    rows = lines.select("file", F.col("block_start").cast("bigint").alias("block_start"),
                        F.col("line_id").cast("bigint").alias("line_id"), "value")
    return rows.mapInArrow(fold, f"file {kind}, _c0 bigint, _c1 bigint, n bigint, tags array<int>, sizes array<int>")


def cut_rows(chunks: DataFrame, room: int) -> DataFrame:
    """(file, seq, j, labels): the rows of every chunk of (file, before, tags,
    sizes), cut at multiples of ``room``; ``j`` is a part's place in its row."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, first, labels, lengths = [], [], [], []
            for k, (before, tags, sizes) in enumerate(zip(*(batch.column(c) for c in ("before", "tags", "sizes")))):
                before, tags, sizes = before.as_py(), tags.values.to_numpy(), sizes.values.to_numpy()
                total = int(sizes.sum())
                if not total:
                    continue
                own = np.full(total, IGNORE_ID, np.int32)
                own[(np.cumsum(sizes) - sizes)[sizes > 0]] = tags[sizes > 0]
                edges = np.arange(-before % room, total, room)  # where rows begin
                own[edges] = np.repeat(tags, sizes)[edges]
                bounds = np.unique(np.r_[0, edges, total])
                place.append(np.full(len(bounds) - 1, k))
                first.append(before + bounds[:-1])
                lengths.append(np.diff(bounds))
                labels.append(own)
            if place:
                at = np.concatenate(first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("file").take(pa.array(np.concatenate(place))), pa.array(at // room, pa.int64()),
                    pa.array(at % room, pa.int32()), _lists(np.concatenate(lengths), np.concatenate(labels), pa.int32())],
                    names=["file", "seq", "j", "labels"])

    kind = chunks.schema["file"].dataType.simpleString()
    return chunks.select("file", "before", "tags", "sizes").mapInArrow(
        cut, f"file {kind}, seq bigint, j int, labels array<int>")


def flat_rows(lines: DataFrame, seq_len: int = DEFAULT_SEQ_LEN, **options) -> DataFrame:
    """(file, seq, n_pieces, labels): the rows of every file's sequence, each
    ``[start] pieces [end]`` padded to ``seq_len``; ``options`` as for ``fold_words``.

    A file without words has no row."""
    room = seq_len - 2
    chunks = materialize(fold_words(lines, **options), "flat-chunks")
    place = ["file", "_c0", "_c1"]
    ahead = Window.partitionBy("file").orderBy("_c0", "_c1").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(*place, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rows = cut_rows(chunks.join(offsets, place), room)
    whole = (F.col("j") == 0) & (F.size("labels") == room)
    rows = materialize(rows, "flat-rows")
    ends = rows.where(~whole).groupBy("file", "seq").agg(
        F.array_sort(F.collect_list(F.struct("j", "labels"))).alias("parts")).select(
        "file", "seq", F.flatten(F.transform("parts", lambda x: x["labels"])).alias("labels"))
    ign = F.array(F.lit(IGNORE_ID))
    return rows.where(whole).select("file", "seq", "labels").unionByName(ends).select(
        "file", "seq", F.size("labels").cast("bigint").alias("n_pieces"),
        F.concat(ign, "labels", ign, F.array_repeat(F.lit(IGNORE_ID), F.lit(room) - F.size("labels"))).alias("labels"))
