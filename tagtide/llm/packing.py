"""Sum-of-squares packing of tokenised documents into fixed windows.

Every task packs the documents of its own partition online (Csirik et al.,
2006): N[h] counts the partially filled windows of fill level h, and a piece
of length s goes to the level h whose step h -> h + s makes the sum of the
squared counts smallest (opening a window is the step 0 -> s).  Documents
longer than a window fill whole windows first.  When a task ends, the pieces
of its open windows go, with those of up to FAN tasks, through a second level
array, longest first, and what that leaves open through a third; no document
is shuffled but those pieces.  What is open then is poured together, cut where
a window is full, so that a group of tasks leaves at most one remainder; it is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import ids_as_text, materialize, pick, ship

WINDOW = 2048
END_ID = 1
FAN = 8       # tasks whose open windows are packed together
ROUNDS = 2    # level arrays that these pass through
#: fixed value: the pieces of a byte-level BPE
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = ("doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to the uint32 ids that the tokenizer file at ``path`` gives with
    add_special_tokens=False.  One per worker and file.

    The ids of ``tokenizers`` define the result.  Where the file is a plain
    byte-level BPE whose merges stand in id order, the same merges run in
    tiktoken's engine (several times faster, ids equal: checked here on the
    file's merges, and in the tests on whole tables); any other file, and a
    text that engine refuses, goes through ``tokenizers`` itself."""
    if path not in _encoders:
        _encoders[path] = _load(path)
    return _encoders[path]


def _load(path: str) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    def plain(text: str) -> np.ndarray:
        return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, merges = model.get("vocab"), model.get("merges") or []
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if not (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and spec.get("normalizer") is None
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))):
        return plain
    import tiktoken

    # the printable stand-ins of the 256 bytes in a byte-level BPE file
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    engine = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def fast(text: str) -> np.ndarray:
        try:
            return engine.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except BaseException as error:  # the engine panics on single pieces of millions of characters
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return plain(text)

    probe = "It's 12 o'clock,\n\n  caf\u00e9 \u4f60\u597d!"
    return fast if np.array_equal(fast(probe), plain(probe)) else plain


class Packer:
    """Windows of one task.  A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.next = window, first_sequence
        self.count = np.zeros(window + 1, np.int64)  # the level array
        self.open: dict[int, list[list]] = defaultdict(list)
        self.rows: list[tuple] = []

    def add(self, doc: str | None, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n // w * w
        for start in range(0, whole, w):
            self._close([(doc, start, ids[start:start + w], n)])
        if n > whole:
            self.place((doc, whole, ids[whole:].copy(), n))

    def place(self, piece: tuple) -> None:
        s, w, count = len(piece[2]), self.window, self.count
        levels = np.flatnonzero(count[:w - s + 1])  # fill levels with room
        # change of the sum of squares: N[h] falls by one, N[h + s] grows by one (a full window is not counted)
        gain = np.where(levels + s == w, 0, 2 * count[np.minimum(levels + s, w - 1)] + 1) - 2 * count[levels] + 1
        fresh = 2 * count[s] + 1 if s < w else 0
        if len(levels) and gain.min() <= fresh:
            h = int(levels[len(levels) - 1 - np.argmin(gain[::-1])])  # the fullest of equals
            pieces = self.open[h].pop()
            count[h] -= 1
        else:
            h, pieces = 0, []
        pieces.append(piece)
        if h + s == w:
            self._close(pieces)
            return
        self.open[h + s].append(pieces)
        count[h + s] += 1

    def left(self) -> list[tuple]:
        """The pieces of the open windows, which are emptied."""
        pieces = [x for level in sorted(self.open) for window in self.open[level] for x in window]
        self.open.clear()
        self.count[:] = 0
        return pieces

    def pour(self) -> None:
        """Close every open window: fill windows from their pieces, fullest first."""
        held: list[tuple] = []
        room = self.window
        for level in sorted(self.open, reverse=True):
            for pieces in self.open[level]:
                for doc, start, ids, n in pieces:
                    while len(ids):
                        held.append((doc, start, ids[:room], n))
                        start, ids, room = start + len(held[-1][2]), ids[room:], room - len(held[-1][2])
                        if not room:
                            self._close(held)
                            held, room = [], self.window
        self.open.clear()
        self.count[:] = 0
        left = self.window - room
        size = 1 << max(0, left.bit_length() - 1)
        part: list[tuple] = []
        need = size
        for doc, start, ids, n in held:
            while len(ids):
                part.append((doc, start, ids[:need], n))
                took = len(part[-1][2])
                start, ids, need, left = start + took, ids[took:], need - took, left - took
                if not need:
                    self._close(part)
                    part, need = [], 1 << max(0, left.bit_length() - 1)

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next, at))
            at += len(ids)
        self.next += 1

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                           "offset"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A null text is empty and still has its end id.  Repeated rows are packed
    each.  A null id stays null.  Other columns are not read.  A sequence id
    is the number of the task, or of the group of tasks, times 2^32 plus a
    counter, so a lost task that runs again gives the same rows."""
    ship(docs.sparkSession)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        packer = Packer(window, part << 32)
        end = np.array([end_id], np.uint32)
        for b in batches:
            for doc, text in zip(b["id"], b["text"]):
                packer.add(doc, np.concatenate([encode(text), end]))
            yield packer.take().assign(ids=None, team=None)
        rest = packer.left()
        for lo in range(0, len(rest), 1024):
            yield pd.DataFrame([(doc, start, len(ids), None, n, None, None, ids.astype("<u4").tobytes(), part // FAN)
                                for doc, start, ids, n in rest[lo:lo + 1024]], columns=[*columns, "ids", "team"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, now = None, None

        def done() -> pd.DataFrame:
            for _ in range(ROUNDS - 1):
                for piece in sorted(packer.left(), key=lambda p: -len(p[2])):  # of equals in the order they stand
                    packer.place(piece)
            packer.pour()
            return packer.take()

        for b in batches:  # the pieces of a team stand together, the longest first
            for doc, start, ids, n, team in zip(b["doc_id"], b["start"], b["ids"], b["doc_tokens"], b["team"]):
                if team != now:
                    if packer is not None:
                        yield done()
                    packer, now = Packer(window, (1 << 58) + (int(team) << 32)), team
                packer.place((doc, int(start), np.frombuffer(ids, "<u4"), int(n)))
            if packer is not None:
                yield packer.take()
        if packer is not None:
            yield done()

    first = pick(docs, id=id_col, text=text_col).select(
        ids_as_text("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(
        run, f"{SCHEMA}, ids binary, team bigint")
    first = materialize(first, "packing")
    rest = first.where("team is not null").repartition(F.col("team")).sortWithinPartitions(
        "team", F.desc("length"), "doc_id", "start", "ids")
    return first.where("team is null").select(*columns).unionByName(rest.mapInPandas(gather, SCHEMA)).withColumn(
        "doc_id", F.col("doc_id").cast("bigint"))
