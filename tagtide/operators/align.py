"""Word labels -> fixed-width piece labels (first piece of a word only).

Each sentence becomes ``[start] pieces [end]`` cut to ``max_pieces`` and padded
to it.  The first piece of a word carries the word's tag id; later pieces,
specials and padding carry the ignore id.  Words whose first piece falls
beyond the cut lose their label.  All work is array-local to the sentence row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.pieces import END_PIECE, PAD_PIECE, START_PIECE, fixed_width_sql
from tagtide.functions.tags import IGNORE_ID, tag_id_sql

DEFAULT_MAX_PIECES = 64


def align(sentences: DataFrame, words: str = "words", tags: dict[str, str] | None = None,
          max_pieces: int = DEFAULT_MAX_PIECES, width: int = 4, mode: str = "reference",
          keep: Sequence[str] | None = None, pieces: Column | None = None) -> DataFrame:
    """Add pieces, word_ids, attention_mask, one label array per tag column,
    ``n_pieces`` (before the cut) and ``lost`` (pieces cut away).

    ``tags`` maps output label column -> tag array column, default
    ``{"labels": "gold"}``.  ``pieces`` optionally gives the pieces of every
    word (array<array<string>>, e.g. from ``functions.vocab``); by default
    words are cut into ``width``-character pieces.
    """
    tags = tags or {"labels": "gold"}
    room = max_pieces - 2
    if pieces is None:
        nested = f"transform(`{words}`, w -> {fixed_width_sql('w', width)})"
        df = sentences.withColumn("_nested", F.expr(nested))
    else:
        df = sentences.withColumn("_nested", pieces)
    flat = ("flatten(transform(_nested, "
            "(ps, i) -> transform(ps, (p, j) -> named_struct('wid', i, 'first', j = 0, 'piece', p))))")
    df = df.withColumn("_flat", F.expr(flat)).drop("_nested")
    df = df.withColumn("_kept", F.expr(f"slice(_flat, 1, {room})"))
    pad = f"{room} - size(_kept)"
    ign = f"cast({IGNORE_ID} as tinyint)"
    cols = {
        "pieces": f"concat(array('{START_PIECE}'), transform(_kept, x -> x.piece), array('{END_PIECE}'), "
                  f"array_repeat('{PAD_PIECE}', {pad}))",
        "word_ids": f"concat(array(cast(null as int)), transform(_kept, x -> x.wid), "
                    f"array(cast(null as int)), array_repeat(cast(null as int), {pad}))",
        "attention_mask": f"concat(array_repeat(cast(1 as tinyint), size(_kept) + 2), "
                          f"array_repeat(cast(0 as tinyint), {pad}))",
        "n_pieces": "size(_flat)",
        "lost": f"greatest(size(_flat) + 2 - {max_pieces}, 0)",
    }
    for out, tag_col in tags.items():
        cols[out] = (f"concat(array({ign}), transform(_kept, x -> CASE WHEN x.first "
                     f"THEN {tag_id_sql(f'`{tag_col}`[x.wid]', mode)} ELSE {ign} END), "
                     f"array({ign}), array_repeat({ign}, {pad}))")
    df = df.select("*", *[F.expr(v).alias(k) for k, v in cols.items()]).drop("_flat", "_kept")
    if keep is not None:
        df = df.select(*keep, *cols.keys())
    return df


def entity_count_sql(labels: str = "labels") -> str:
    """SQL text: labelled positions that are not O."""
    return f"size(filter(`{labels}`, x -> x <> {IGNORE_ID} AND x <> 0))"


def entity_count(labels: str = "labels"):
    return F.expr(entity_count_sql(labels))


def decoded_words(pieces: str = "pieces", word_ids: str = "word_ids") -> F.Column:
    """Words rebuilt from the kept pieces (specials skipped), as the model saw them."""
    return F.expr(
        f"transform(array_distinct(filter(`{word_ids}`, x -> x IS NOT NULL)), "
        f"w -> array_join(transform(filter(arrays_zip(`{pieces}`, `{word_ids}`), z -> z.`{word_ids}` = w), "
        f"z -> z.`{pieces}`), ''))")


def collate(rows: DataFrame, batch: str, columns: Sequence[str], size: Column) -> DataFrame:
    """Cut the padded array ``columns`` of every batch to its longest row.

    ``size`` is a row's own length; adds ``width`` (of the batch) and ``n_pad``.
    A batch is a few rows, so the window's groups are small.
    """
    df = rows.withColumn("_size", size).withColumn("width", F.max("_size").over(Window.partitionBy(batch)))
    cut = {c: F.slice(c, F.lit(1), F.col("width").cast("int")) for c in columns}
    return df.withColumns({**cut, "n_pad": F.col("width") - F.col("_size")}).drop("_size")
