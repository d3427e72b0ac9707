"""Tag vocabulary and tag <-> id columns.

Fixed values (must equal the labelled data's convention):

    O 0, B-ORG 1, I-ORG 2, B-OTH 3, I-OTH 4, I-PER 3, B-PER 4, B-LOC 5, I-LOC 6

Ids are decoded by inverting that list in its written order, so a later tag
overwrites an earlier one with the same id: 3 decodes to I-PER and 4 to B-PER.
This makes B-OTH/I-OTH come back as I-PER/B-PER ("reference" mode).  The
"clean" mode maps B-OTH to the B-PER id and I-OTH to the I-PER id instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
REFERENCE_TAG_IDS = [
    ("O", 0),
    ("B-ORG", 1), ("I-ORG", 2),
    ("B-OTH", 3), ("I-OTH", 4), ("I-PER", 3), ("B-PER", 4),
    ("B-LOC", 5), ("I-LOC", 6),
]
CLEAN_TAG_IDS = [
    ("O", 0),
    ("B-ORG", 1), ("I-ORG", 2),
    ("B-OTH", 4), ("I-OTH", 3), ("I-PER", 3), ("B-PER", 4),
    ("B-LOC", 5), ("I-LOC", 6),
]
IGNORE_ID = -100          # label of special tokens, padding and later pieces
NUM_LABELS = 7
# -------------------------------------------------------------------------


def tag_ids(mode: str = "reference") -> dict[str, int]:
    if mode == "reference":
        return dict(REFERENCE_TAG_IDS)
    if mode == "clean":
        return dict(CLEAN_TAG_IDS)
    raise ValueError(f"unknown tag_map mode {mode!r}")


def id_tags(mode: str = "reference") -> dict[int, str]:
    """Inverse map; a later entry with the same id wins."""
    pairs = REFERENCE_TAG_IDS if mode == "reference" else CLEAN_TAG_IDS
    inverse: dict[int, str] = {}
    for tag, idx in pairs:
        inverse[idx] = tag
    return inverse


def _sql_map(d: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in d.items()) + ")"


def tag_id_sql(expr: str, mode: str = "reference") -> str:
    """SQL text: tag -> id, raising on a tag outside the vocabulary."""
    m = _sql_map(tag_ids(mode))
    return (f"coalesce(cast(element_at({m}, {expr}) as tinyint), "
            f"cast(raise_error(concat('unknown tag: ', coalesce({expr}, 'NULL'))) as tinyint))")


def id_tag_sql(expr: str, mode: str = "reference") -> str:
    """SQL text: id -> tag (null for the ignore id)."""
    return f"element_at({_sql_map(id_tags(mode))}, cast({expr} as int))"


def tag_id(col: str | Column, mode: str = "reference") -> Column:
    name = col if isinstance(col, str) else None
    if name is None:
        m = F.create_map(*[x for k, v in tag_ids(mode).items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(m[col].cast("tinyint"),
                          F.raise_error(F.concat(F.lit("unknown tag: "), col)).cast("tinyint"))
    return F.expr(tag_id_sql(f"`{name}`", mode))


def id_tag(col: str | Column, mode: str = "reference") -> Column:
    m = F.create_map(*[x for k, v in id_tags(mode).items() for x in (F.lit(k), F.lit(v))])
    c = F.col(col) if isinstance(col, str) else col
    return m[c.cast("int")]


def tag_dim(spark: SparkSession, mode: str = "reference") -> DataFrame:
    """The vocabulary as a (tag, tag_id) dimension; 9 rows, safe to broadcast."""
    return spark.createDataFrame(list(tag_ids(mode).items()), "tag string, tag_id int")
