"""The flat sequence folded in the scan against a plain loop over the lines."""

import random

import pytest

from tagtide.functions.tags import tag_ids
from tagtide.operators.flat import flat_rows
from tagtide.sources.iob import read_flat_rows, read_lines


def plain(text, room, width=4):
    """Labels row by row, a piece at a time."""
    ids, rows, row = tag_ids(), [], []
    for line in text.split("\n"):
        if not line or line.startswith("#"):
            continue
        _, word, tag, *_ = line.split("\t")
        for k in range(-(-len(word) // width)):
            if len(row) == room:
                rows.append(row)
                row = []
            row.append(ids[tag] if k == 0 or not row else -100)
    if row:
        rows.append(row)
    return [(k, len(r), [-100, *r, -100, *[-100] * (room - len(r))]) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = {}
    for name in "abc":
        lines = []
        for s in range(12 if name != "c" else 1):
            lines.append(f"# sent {s} é")
            for w in range(rng.randrange(0, 12)):
                lines.append(f"{w}\t{'wörd日本x' * rng.choice([1, 1, 2, 9])}\t{rng.choice(['O', 'B-PER', 'I-LOC'])}\t-\t-")
            lines.append("")
        out[name] = "\n".join(lines)
    out["d"] = "# nothing\n\n"
    return out


@pytest.mark.parametrize("split,batch,seq_len", [("128m", 10_000, 128), ("128m", 3, 12), ("150", 10_000, 12), ("400", 2, 7)])
def test_flat_rows_equal_a_plain_loop(spark, tmp_path, texts, split, batch, seq_len):
    for name, text in texts.items():
        (tmp_path / f"{name}.iob2").write_text(text)
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1",
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = read_flat_rows(spark, str(tmp_path), seq_len).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by_file = {}
    for r in got:
        by_file.setdefault(r.file.rsplit("/", 1)[1][0], []).append((r.seq, r.n_pieces, r.labels))
    assert {k: sorted(v) for k, v in by_file.items()} == {k: plain(t, seq_len - 2) for k, t in texts.items() if plain(t, seq_len - 2)}


def test_flat_rows_raise_on_bad_lines(spark, tmp_path):
    for name, line, said in (("few", "1\tword\tO\t-", "expected 5 fields"), ("tag", "1\tword\tB-XX\t-\t-", "unknown tag")):
        (tmp_path / name).write_text(line + "\n")
        with pytest.raises(Exception, match=said):
            read_flat_rows(spark, str(tmp_path / name)).collect()


def test_flat_rows_shuffle_no_words(spark, tmp_path, texts):
    """Below the written chunks there is a scan and the fold alone."""
    from tagtide.operators.flat import fold_words
    (tmp_path / "a.iob2").write_text(texts["a"])
    plan = fold_words(read_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    assert flat_rows(read_lines(spark, str(tmp_path)).limit(0)).count() == 0
