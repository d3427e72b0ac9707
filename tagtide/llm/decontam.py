"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations.

A fixed mask takes some positions of a token window and ignores the others,
so a hash of what it takes survives substitutions at the others.  Test and
training hashes are joined; a hit aligns a test item with a document, and the
alignment is verified token by token around it: it counts if some window of
the aligned tokens matches in at least ``min_match`` of ``window`` positions.

The masks of a size reach every window of it that the verification accepts
(tests/llm enumerates them).  Items shorter than the window have masks of
their own and fewer substitutions; the shortest must match whole.

The tokens of a document are hashed once; positions are generated and masked
in generated code, and only hits carry tokens on.  The test set's seeds are
broadcast after a check of their number; beyond it the hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import materialize, pick

#: token positions that each mask takes, for items of a window or more
MASKS = ((0, 1, 2, 4, 6), (0, 1, 3, 6, 7), (0, 2, 3, 5, 8), (0, 2, 8, 9, 10))
#: masks by the size of shorter items
SHORT_MASKS = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),),
    5: ((0, 1, 2, 3, 4),), 6: ((0, 1, 2, 3, 4, 5),), 7: ((0, 1, 3, 4),),
    8: ((0, 1, 3, 4, 5), (0, 1, 3, 4, 7)), 9: ((0, 1, 2, 4, 5), (0, 3, 4, 5, 6), (0, 1, 3, 6, 7), (0, 1, 2, 3, 5)),
    10: ((0, 1, 3, 4, 5), (0, 1, 2, 6, 8), (0, 3, 5, 8, 9)), 11: ((0, 1, 3, 5, 6), (0, 3, 6, 7, 8)),
    12: ((0, 1, 2, 4, 5), (0, 2, 4, 7, 9))}
WINDOW, MIN_MATCH = 13, 10
WHOLE = 6  # items of up to so many tokens must match whole
#: a letter of a script without spaces between words, a token of its own
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
BROADCAST_SEEDS = 500_000  # seeds of 28 bytes


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; letters of
    scripts without spaces are a token each."""
    low = F.lower(text)
    apart = F.when(low.rlike(UNSPACED), F.regexp_replace(low, UNSPACED, " $1 ")).otherwise(low)
    return F.transform(F.array_remove(F.split(apart, r"[^\p{L}\p{N}]+"), ""), lambda t: F.xxhash64(t))


def allowed(size: int, window: int = WINDOW, min_match: int = MIN_MATCH) -> int:
    """Substitutions allowed in ``size`` tokens, in proportion to a full
    window's: 3 in 13, 2 from 9, 1 from 7, none in those that must match whole."""
    return size * (window - min_match) // window if size > WHOLE else 0


def seeds(rows: DataFrame, masks: dict[tuple[int, ...], list[int]], window: int | None = None) -> DataFrame:
    """One row per token position and mask that fits: the columns of ``rows``
    (with a token hash array ``th``), pos, seed.  ``masks`` has the item sizes
    that each mask is for; with a ``window`` rows of other sizes (cut to it) do
    not get the mask."""
    if not masks:
        return rows.where("false").select("*", F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("seed"))
    shortest = min(max(m) + 1 for m in masks)
    fits = F.when(F.size("th") >= shortest, F.sequence(F.lit(0), F.size("th") - shortest))
    at = rows.withColumn("pos", F.explode(fits))  # a filter on the size would hash the tokens twice
    masked = []
    for k, (m, sizes) in enumerate(masks.items()):
        use = F.col("pos") + max(m) < F.size("th")
        use = use if window is None else use & F.least(F.lit(window), F.size("th")).isin(sizes)
        masked.append(F.when(use, F.xxhash64(F.lit(k), *[F.get("th", F.col("pos") + o) for o in m])))
    return at.withColumn("seed", F.explode(F.array(*masked))).where("seed is not null")


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW,
             min_match: int = MIN_MATCH, broadcast_seeds: int = BROADCAST_SEEDS,
             short_masks: dict[int, tuple[tuple[int, ...], ...]] = SHORT_MASKS) -> DataFrame:
    """(id, ver, item, doc_start, item_start, matched, n_tokens) for every
    document (id, text) and test item (item, text) that overlap: the best
    window, the earliest of equals.  ver is a hash of the document's text.  An
    item of fewer than ``window`` tokens needs all but ``allowed`` of its
    tokens; a null or wordless one overlaps nothing."""
    d = docs.select("id", F.xxhash64("text").alias("ver"), token_hashes(F.col("text")).alias("th"))
    t = materialize(items.select("item", token_hashes(F.col("text")).alias("th")).where(F.size("th") > 0).distinct(), "test-items")
    size = F.least(F.lit(window), F.size("th"))
    use: dict[tuple[int, ...], list[int]] = {}  # only the masks that some item needs
    for (n,) in t.select(size).distinct().sort(size).collect():  # ``window`` rows at most
        for m in masks if n >= window else short_masks[n]:
            use.setdefault(m, []).append(n)
    spare = F.array(*[F.lit(allowed(n, window, min_match)) for n in range(window + 1)])
    test = seeds(t, use, window).select("seed", F.col("item"), F.size("th").alias("m"), F.col("pos").alias("at"),
                                  F.xxhash64("th").alias("item_ver")).distinct()
    diag = (F.col("pos") - F.col("at")).alias("diag")
    if test.count() <= broadcast_seeds:
        hits = seeds(d, use).join(F.broadcast(test), "seed").select(
            "id", "ver", "item", "item_ver", diag,
            _aligned(F.col("th"), F.col("pos") - F.col("at"), F.col("m")).alias("part"))
        hits = hits.groupBy("id", "ver", "item", "item_ver", "diag").agg(F.any_value("part").alias("part"))
    else:
        found = seeds(d, use).select("id", "ver", "pos", "seed").join(test, "seed").select(
            "id", "ver", "item", "item_ver", "m", diag).distinct()
        hits = found.withColumnRenamed("id", "i").withColumnRenamed("ver", "v").join(
            d, F.col("i").eqNullSafe(F.col("id")) & (F.col("v") == F.col("ver"))).drop("i", "v").dropDuplicates(
            ["id", "ver", "item", "item_ver", "diag"]).withColumn(
            "part", _aligned(F.col("th"), F.col("diag"), F.col("m"))).drop("th", "m")
    first = F.greatest(F.lit(0), -F.col("diag"))  # item position of the aligned part
    both = hits.join(t.withColumn("item_ver", F.xxhash64("th")), ["item", "item_ver"]).withColumn("first", first)
    same = both.withColumn("same", F.zip_with("part", F.slice("th", F.col("first") + 1, F.size("part")),
                                              lambda a, b: F.when(a == b, 1).otherwise(0)))
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("size")),
        lambda s: F.struct(F.aggregate(F.slice("same", s + 1, F.col("size")), F.lit(0), lambda a, x: a + x).alias("n"),
                           (-s).alias("back"))))
    ranked = (same.withColumn("size", size).where(F.size("same") >= F.col("size")).withColumn("best", best)
              .where(F.col("best.n") >= F.col("size") - F.get(spare, F.col("size")))
              .withColumn("item_start", F.col("first") - F.col("best.back"))
              .withColumn("doc_start", F.col("item_start") + F.col("diag")))
    top = F.max(F.struct(F.col("best.n").alias("n"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"),
                         F.col("size").alias("size")))
    return ranked.groupBy("id", "ver", "item").agg(top.alias("top")).select(
        "id", "ver", "item", (-F.col("top.d")).cast("bigint").alias("doc_start"),
        (-F.col("top.i")).cast("bigint").alias("item_start"), F.col("top.n").cast("bigint").alias("matched"),
        F.col("top.size").cast("bigint").alias("n_tokens"))


def _aligned(th: Column, diag: Column, m: Column) -> Column:
    """The document's tokens beside an item of m tokens on a diagonal."""
    lo = F.greatest(F.lit(0), diag)
    return F.slice(th, lo + 1, F.least(F.size(th), diag + m) - lo)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", **settings: int) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, matched, n_tokens): one row per
    document and test item that overlap, of whole texts on both sides.

    Null and empty texts overlap nothing.  Repeated rows of an id give its
    best window once; a null document id is reported as null, and an item
    without an id is not tested.  Other columns are not read."""
    d = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint"))
    t = pick(benchmark, item=item_col, text=item_text_col).withColumn("item", F.col("item").cast("bigint")).where(
        "item is not null")
    rows = overlaps(d, t, **settings)
    top = F.max(F.struct("matched", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "n_tokens"))
    return rows.groupBy("id", "item").agg(top.alias("top")).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), (-F.col("top.d")).alias("doc_start"),
        (-F.col("top.i")).alias("item_start"), F.col("top.matched").alias("matched"),
        F.col("top.n_tokens").alias("n_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_tokens: int = 1, **settings: int) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no test item of ``min_tokens``
    or more: raise it where short ones (names, common phrases) stand in clean
    texts too."""
    text = F.col(f"`{text_col}`").cast("string")
    hit = overlaps(docs.select(F.xxhash64(F.lit(5), text).alias("id"), text.alias("text")),
                   benchmark.select(F.col("item_id").alias("item"), "text").where("item is not null"), **settings)
    bad = hit.where(F.col("n_tokens") >= min_tokens).select(F.col("ver").alias("__v1"), F.col("id").alias("__v2")).distinct()
    return docs.join(bad, (F.xxhash64(text) == F.col("__v1")) & (F.xxhash64(F.lit(5), text) == F.col("__v2")), "left_anti")
