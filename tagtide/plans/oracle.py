"""DuckDB SQL oracles of the registered queries.

Written independently of the Spark plans: token rows from ``unnest``, plain
window functions over whole partitions (lag, row_number, running sums), and
joins where the Spark side works inside arrays.  Tables ``documents``,
``embeddings`` etc. are views over the same parquet files.
"""

from __future__ import annotations

from tagtide.functions.tags import id_tags, tag_ids
from tagtide.sources.corpus import (DEFAULT_TARGETS, GOLD_RULE, PART_LAYOUT, PART_SUFFIXES,
                                    PRED_RULE, REGISTRY)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tag_id(col: str) -> str:
    return "(CASE " + " ".join(f"WHEN {col} = {_q(t)} THEN {i}" for t, i in tag_ids().items()) + " END)"


def _id_tag(col: str) -> str:
    return "(CASE " + " ".join(f"WHEN {col} = {i} THEN {_q(t)}" for i, t in id_tags().items()) + " END)"


def _part_case() -> str:
    out = []
    for lang, ranges in PART_LAYOUT.items():
        inner = " ".join(f"WHEN doc_id % 10 BETWEEN {lo} AND {hi} THEN {_q(p)}" for lo, hi, p in ranges)
        out.append(f"WHEN lang = {_q(lang)} THEN (CASE {inner} END)")
    return "(CASE " + " ".join(out) + " END)"


def _rank_case(col: str) -> str:
    return "(CASE " + " ".join(f"WHEN {col} = {_q(p)} THEN {r}" for p, r, _ in PART_SUFFIXES) + " END)"


def _typer(rule: dict) -> str:
    return (f"CASE WHEN regexp_matches(word, {_q(rule['digit'])}) THEN 'LOC' "
            f"WHEN pos > 0 AND regexp_matches(word, {_q(rule['upper'])}) THEN 'PER' "
            f"WHEN length(word) >= {rule['long']} THEN 'ORG' ELSE 'O' END")


TARGETS = "(" + ", ".join(_q(t) for t in DEFAULT_TARGETS) + ")"
REG = "reg(lang, ord, path_prefix, iso) AS (VALUES " + ", ".join(
    f"({_q(a)}, {b}, {_q(c)}, {_q(d)})" for a, b, c, d in REGISTRY) + ")"

# sentences, tokens with gold/pred tags, piece counts and piece start offsets
BASE = f"""WITH {REG},
doc_lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE lang IN (SELECT lang FROM reg)),
sent AS (
  SELECT doc_id, lang, {_part_case()} AS part, CAST(line_no AS BIGINT) AS line_no,
         list_filter(string_split(line, ' '), lambda x: x <> '') AS words
  FROM doc_lines),
sentr AS (SELECT *, {_rank_case('part')} AS part_rank FROM sent),
tok0 AS (
  SELECT doc_id, lang, part, line_no, unnest(words) AS word, unnest(range(len(words))) AS pos
  FROM sent),
tok1 AS (SELECT *, {_typer(GOLD_RULE)} AS gt, {_typer(PRED_RULE)} AS pt FROM tok0),
tok2 AS (
  SELECT doc_id, lang, part, line_no, pos, word,
         CASE WHEN gt = 'O' THEN 'O' WHEN lag(gt) OVER w = gt THEN 'I-' || gt ELSE 'B-' || gt END AS gold,
         CASE WHEN pt = 'O' THEN 'O' WHEN lag(pt) OVER w = pt THEN 'I-' || pt ELSE 'B-' || pt END AS pred,
         len(regexp_extract_all(word, '(?s).{{1,4}}')) AS np
  FROM tok1 WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)),
tok AS (
  SELECT *, COALESCE(sum(np) OVER (PARTITION BY doc_id, line_no ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps
  FROM tok2),
sagg AS (
  SELECT doc_id, line_no, CAST(sum(np) AS BIGINT) AS n_pieces,
         CAST(count_if(ps < 62 AND gold <> 'O') AS BIGINT) AS ents,
         CAST(count_if(ps < 62) AS BIGINT) AS n_kept_words
  FROM tok GROUP BY doc_id, line_no),
sents AS (
  SELECT s.*, COALESCE(a.n_pieces, 0) AS n_pieces, COALESCE(a.ents, 0) AS ents,
         COALESCE(a.n_kept_words, 0) AS n_kept_words
  FROM sentr s LEFT JOIN sagg a USING (doc_id, line_no))"""

# language/split assignment by the number of files found
SPLITS = f"""{BASE},
files0 AS (
  SELECT lang, part, part_rank, count(*) AS n_part FROM sents GROUP BY lang, part, part_rank),
files1 AS (
  SELECT *, count(*) OVER (PARTITION BY lang) AS n_files,
         row_number() OVER (PARTITION BY lang ORDER BY part_rank) AS file_rank FROM files0),
files2 AS (
  SELECT *, CASE WHEN n_files = 1 THEN NULL WHEN n_files = 2 AND file_rank = 1 THEN 'train'
                 WHEN n_files = 2 THEN 'test' WHEN file_rank <= 2 THEN 'train' ELSE 'test' END AS fsplit,
         CAST(floor((CASE WHEN lang IN {TARGETS} THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)
                    * CAST(n_part AS DOUBLE)) AS BIGINT) AS train_n
  FROM files1),
files AS (
  SELECT *, COALESCE(sum(n_part) OVER (PARTITION BY lang, fsplit ORDER BY part_rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS split_offset
  FROM files2),
sp0 AS (
  SELECT *, row_number() OVER (PARTITION BY lang, part ORDER BY doc_id, line_no) - 1 AS part_ord FROM sents),
spl AS (
  SELECT sp0.*,
         CASE WHEN f.n_files = 1 THEN (CASE WHEN part_ord < f.train_n THEN 'train' ELSE 'test' END)
              ELSE f.fsplit END AS split,
         CAST(CASE WHEN f.n_files = 1 THEN (CASE WHEN part_ord < f.train_n THEN part_ord
                                                  ELSE part_ord - f.train_n END)
              ELSE f.split_offset + part_ord END AS BIGINT) AS split_ord
  FROM sp0 JOIN files f ON sp0.lang = f.lang AND sp0.part = f.part),
sizes AS (SELECT lang, split, CAST(count(*) AS BIGINT) AS n FROM spl GROUP BY lang, split),
small AS (
  SELECT split, lang, n FROM (
    SELECT s.*, row_number() OVER (PARTITION BY split ORDER BY n, r.ord) AS rn
    FROM sizes s JOIN reg r USING (lang)) WHERE rn = 1),
small_t AS (
  SELECT split, lang, n FROM (
    SELECT s.*, row_number() OVER (PARTITION BY split ORDER BY n, r.ord) AS rn
    FROM sizes s JOIN reg r USING (lang) WHERE s.lang IN {TARGETS}) WHERE rn = 1)"""


def _sample(src: str, name: str, group: list[str], order: list[str]) -> str:
    """CTEs ``{name}`` = density-preserving sample of ``src`` (needs size, ents)."""
    g = ", ".join(group)
    o = ", ".join(order)
    on = " AND ".join(f"x.{c} = st.{c}" for c in group)
    on2 = " AND ".join(f"r.{c} = nd.{c}" for c in group)
    return f"""
{name}_x AS (SELECT *, ents > 0 AS cls FROM {src}),
{name}_st AS (
  SELECT {g}, count(*) AS n, sum(ents) AS e, sum(CASE WHEN NOT cls THEN 1 ELSE 0 END) AS n_free,
         max(size) AS sz
  FROM {name}_x GROUP BY {g}),
{name}_r AS (
  SELECT x.*, st.n, st.n_free, st.sz,
         CAST(floor(CAST(st.sz * 64 AS DOUBLE) * (CAST(st.e AS DOUBLE) / CAST(st.n * 64 AS DOUBLE))) AS BIGINT) AS req,
         row_number() OVER (PARTITION BY {', '.join('x.' + c for c in group)}, x.cls ORDER BY {', '.join('x.' + c for c in order)}) - 1 AS cls_ord,
         COALESCE(sum(x.ents) OVER (PARTITION BY {', '.join('x.' + c for c in group)}, x.cls ORDER BY {', '.join('x.' + c for c in order)}
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {name}_x x JOIN {name}_st st ON {on}),
{name}_nd AS (
  SELECT {g}, count_if(cls AND before < req) AS need FROM {name}_r GROUP BY {g}),
{name} AS (
  SELECT r.*, nd.need,
         CAST(n <> sz AND (least(nd.need, sz) + least(n_free, greatest(sz - nd.need, 0))) < sz AS INT) AS short
  FROM {name}_r r JOIN {name}_nd nd ON {on2}
  WHERE CASE WHEN n = sz THEN true
             WHEN cls THEN before < req AND cls_ord < sz
             ELSE cls_ord < sz - nd.need END)"""


def _quota(target: str, k: int) -> str:
    train = "(SELECT n FROM small WHERE split = 'train')"
    train_t = "(SELECT n FROM small_t WHERE split = 'train')"
    test = "(SELECT n FROM small WHERE split = 'test')"
    if target == "all":
        tq = train
    else:
        tq = f"CASE WHEN lang = {_q(target)} THEN {train_t} ELSE {k} END"
    return f"SELECT DISTINCT lang, CAST({tq} AS BIGINT) AS train_quota, CAST({test} AS BIGINT) AS test_quota FROM sizes"


def _split_samples(target: str = "all", k: int = 10) -> str:
    return f"""{SPLITS},
q AS ({_quota(target, k)}),
tr_src AS (SELECT spl.*, q.train_quota AS size FROM spl JOIN q USING (lang) WHERE split = 'train' AND q.train_quota > 0),
te_src AS (SELECT spl.*, q.test_quota AS size FROM spl JOIN q USING (lang) WHERE split = 'test'),
{_sample('tr_src', 'trs', ['lang', 'split'], ['part_rank', 'doc_id', 'line_no'])},
{_sample('te_src', 'tes', ['lang', 'split'], ['part_rank', 'doc_id', 'line_no'])}"""


def _spans(side: str, src: str = "tok") -> str:
    """Span rows of one tag column from token rows (lag over the sentence)."""
    return f"""
{side}_f AS (
  SELECT doc_id, lang, line_no, pos, {side} AS t, substr({side}, 1, 1) AS p,
         CASE WHEN {side} = 'O' THEN '_' ELSE substr({side}, 3) END AS ty,
         lag(substr({side}, 1, 1), 1, 'O') OVER w AS pp,
         lag(CASE WHEN {side} = 'O' THEN '_' ELSE substr({side}, 3) END, 1, '') OVER w AS pty
  FROM {src} WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)),
{side}_g AS (
  SELECT *, sum(CASE WHEN p = 'B' OR (p = 'I' AND pp = 'O') OR (p <> 'O' AND pty <> ty) THEN 1 ELSE 0 END)
              OVER (PARTITION BY doc_id, line_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sid
  FROM {side}_f),
{side}_spans AS (
  SELECT doc_id, lang, line_no, min(ty) AS type, CAST(min(pos) AS BIGINT) AS b, CAST(max(pos) AS BIGINT) AS e
  FROM {side}_g WHERE t <> 'O' GROUP BY doc_id, lang, line_no, sid)"""


def _spans_block(head: str, src: str = "tok") -> str:
    return f"""{head},{_spans('gold', src)},{_spans('pred', src)},
tp_spans AS (
  SELECT g.* FROM gold_spans g JOIN pred_spans p
  ON g.doc_id = p.doc_id AND g.line_no = p.line_no AND g.type = p.type AND g.b = p.b AND g.e = p.e)"""


SPANS = _spans_block(BASE)


def _score(group: str = "", head: str = BASE, src: str = "tok") -> str:
    sel = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    on = f"USING ({group})" if group else "ON true"

    def cnt(t: str, name: str) -> str:
        return f"(SELECT {sel}CAST(count(*) AS BIGINT) AS {name} FROM {t} {by})"
    toks = f"(SELECT {sel}CAST(count(*) AS BIGINT) AS n_tok, CAST(count_if(gold = pred) AS BIGINT) AS n_eq FROM {src} {by})"
    return f"""{_spans_block(head, src)},
c AS (
  SELECT {sel}COALESCE(a.n_pred, 0) AS n_pred, COALESCE(b.n_gold, 0) AS n_gold, COALESCE(d.tp, 0) AS tp,
         t.n_tok, t.n_eq
  FROM {toks} t LEFT JOIN {cnt('pred_spans', 'n_pred')} a {on} LEFT JOIN {cnt('gold_spans', 'n_gold')} b {on}
  LEFT JOIN {cnt('tp_spans', 'tp')} d {on}),
r AS (
  SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
            CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0.0 END AS recall FROM c)
SELECT {sel}n_pred, n_gold, tp, n_tok, n_eq, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall,
       CAST(CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS DOUBLE) AS f1,
       CAST(CASE WHEN n_tok > 0 THEN n_eq / n_tok ELSE 0.0 END AS DOUBLE) AS accuracy
FROM r"""


def _score_by_type() -> str:
    return f"""{SPANS},
types AS (SELECT type FROM gold_spans UNION SELECT type FROM pred_spans),
c AS (
  SELECT t.type,
         CAST((SELECT count(*) FROM pred_spans p WHERE p.type = t.type) AS BIGINT) AS n_pred,
         CAST((SELECT count(*) FROM gold_spans g WHERE g.type = t.type) AS BIGINT) AS n_gold,
         CAST((SELECT count(*) FROM tp_spans x WHERE x.type = t.type) AS BIGINT) AS tp
  FROM types t),
r AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0.0 END AS recall FROM c)
SELECT type, n_pred, n_gold, tp, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall,
       CAST(CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS DOUBLE) AS f1
FROM r"""


def _labels_sql() -> str:
    """CTE ``lab``: per sentence, the 64 gold label ids and 64 predicted label ids."""
    return f"""
pl AS (
  SELECT doc_id, line_no, pos, ps, np,
         list_transform(range(np), lambda k: CASE WHEN k = 0 THEN {_tag_id('gold')} ELSE -100 END) AS gl,
         list_transform(range(np), lambda k: CASE WHEN k = 0 THEN {_tag_id('pred')} ELSE -100 END) AS pl
  FROM tok),
pls AS (
  SELECT doc_id, line_no, flatten(list(gl ORDER BY pos)) AS gfl, flatten(list(pl ORDER BY pos)) AS pfl
  FROM pl GROUP BY doc_id, line_no),
lab AS (
  SELECT s.doc_id, s.line_no, s.lang, s.part, s.n_pieces,
         list_concat([-100], list_slice(COALESCE(p.gfl, []), 1, 62), [-100],
                     list_transform(range(62 - least(len(COALESCE(p.gfl, [])), 62)), lambda k: -100)) AS labels,
         list_concat([-100], list_slice(COALESCE(p.pfl, []), 1, 62), [-100],
                     list_transform(range(62 - least(len(COALESCE(p.pfl, [])), 62)), lambda k: -100)) AS pred_labels
  FROM sents s LEFT JOIN pls p USING (doc_id, line_no))"""


def _iob_sentences() -> str:
    return f"""{BASE},
last AS (SELECT doc_id, max(CASE WHEN len(words) > 0 THEN line_no END) AS lst FROM sents GROUP BY doc_id)
SELECT CAST(s.doc_id AS BIGINT) AS file, s.line_no AS sent_ord, CAST(len(words) AS BIGINT) AS n_words,
       array_to_string(words, ' ') AS words,
       COALESCE((SELECT string_agg(gold, ' ' ORDER BY pos) FROM tok t
                 WHERE t.doc_id = s.doc_id AND t.line_no = s.line_no), '') AS tags,
       array_to_string(list_concat(['# sent_id = ' || CAST(s.line_no AS VARCHAR)], words), ' ') AS raw
FROM sents s JOIN last l USING (doc_id)
WHERE s.line_no <= COALESCE(l.lst, 0)"""


def _hash_anywhere() -> str:
    # a sentence whose words all hold a '#' stays, empty; trailing empty ones of a file go
    return f"""{BASE},
kept AS (SELECT doc_id, line_no, pos, word, gold FROM tok WHERE NOT contains(word, '#')),
s AS (SELECT x.doc_id, x.line_no, count(k.word) AS n, string_agg(k.word, ' ' ORDER BY k.pos) AS words,
             string_agg(k.gold, ' ' ORDER BY k.pos) AS tags
      FROM sents x LEFT JOIN kept k USING (doc_id, line_no) GROUP BY x.doc_id, x.line_no),
last AS (SELECT doc_id, max(CASE WHEN n > 0 THEN line_no END) AS lst FROM s GROUP BY doc_id)
SELECT CAST(s.doc_id AS BIGINT) AS file, s.line_no AS sent_ord, CAST(n AS BIGINT) AS n_words,
       COALESCE(words, '') AS words, COALESCE(tags, '') AS tags
FROM s JOIN last l USING (doc_id) WHERE s.line_no <= COALESCE(l.lst, 0)"""


def _file_sentences() -> str:
    return f"""{BASE}
SELECT s.lang, s.part, s.doc_id, s.line_no, CAST(len(words) AS BIGINT) AS n_words,
       array_to_string(words, ' ') AS words,
       COALESCE((SELECT string_agg(gold, ' ' ORDER BY pos) FROM tok t
                 WHERE t.doc_id = s.doc_id AND t.line_no = s.line_no), '') AS tags
FROM sents s"""


def _flat() -> str:
    return f"""{BASE},
kst AS (
  SELECT *, COALESCE(sum(np) OVER (PARTITION BY doc_id ORDER BY line_no, pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0
  FROM tok),
pc AS (SELECT doc_id, g0, gold, unnest(range(np)) AS k FROM kst),
pcs AS (
  SELECT doc_id, (g0 + k) // 126 AS seq, (g0 + k) % 126 AS j,
         CASE WHEN k = 0 OR (g0 + k) % 126 = 0 THEN {_tag_id('gold')} ELSE -100 END AS label
  FROM pc)
SELECT CAST(doc_id AS BIGINT) AS file, CAST(seq AS BIGINT) AS seq, CAST(count(*) AS BIGINT) AS n_pieces,
       '-100,' || string_agg(CAST(label AS VARCHAR), ',' ORDER BY j) || ',-100'
       || repeat(',-100', CAST(126 - count(*) AS BIGINT)) AS labels
FROM pcs GROUP BY doc_id, seq"""


def _failed_files() -> str:
    parts = "parts(part, part_rank, suffix) AS (VALUES " + ", ".join(
        f"({_q(p)}, {r}, {_q(s)})" for p, r, s in PART_SUFFIXES) + ")"
    return f"""{BASE}, {parts},
manifest AS (SELECT r.lang, p.part, p.suffix, 'corpus/' || r.path_prefix || p.suffix AS path FROM reg r, parts p),
found AS (SELECT DISTINCT lang, part FROM sents)
SELECT m.lang, m.part, m.path FROM manifest m
WHERE m.suffix <> '' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.lang = m.lang AND f.part = m.part)"""


def _tag_codes() -> str:
    return f"""{BASE},
sides AS (SELECT 'gold' AS side, gold AS tag FROM tok UNION ALL SELECT 'pred' AS side, pred AS tag FROM tok)
SELECT side, tag, CAST({_tag_id('tag')} AS BIGINT) AS tag_id, {_id_tag(_tag_id('tag'))} AS decoded,
       CAST(count(*) AS BIGINT) AS n
FROM sides GROUP BY side, tag"""


def _align() -> str:
    return f"""{BASE},{_labels_sql()}
SELECT doc_id, line_no, n_pieces,
       CAST(len(list_filter(labels, lambda x: x <> -100)) AS BIGINT) AS n_labelled,
       CAST(least(n_pieces, 62) + 2 AS BIGINT) AS mask_sum,
       array_to_string(labels, ',') AS labels
FROM lab"""


def _density(group: str, src: str) -> str:
    return f"""SELECT {group}, CAST(count(*) AS BIGINT) AS n_sent, CAST(count(*) * 64 AS BIGINT) AS n_tokens,
       CAST(sum(ents) AS BIGINT) AS n_entities,
       CAST(sum(ents) AS DOUBLE) / CAST(count(*) * 64 AS DOUBLE) AS density
FROM {src} GROUP BY {group}"""


def _density_sample() -> str:
    return f"""{BASE},
dsz AS (SELECT min(n) AS size FROM (SELECT lang, count(*) AS n FROM sents GROUP BY lang)),
ds_src AS (SELECT sents.*, dsz.size FROM sents, dsz),
{_sample('ds_src', 'ds', ['lang'], ['doc_id', 'line_no'])}
SELECT lang, doc_id, line_no, ents, short FROM ds"""


def _grid() -> str:
    parts = []
    for t in DEFAULT_TARGETS:
        parts.append(f"SELECT {_q(t)} AS target_lang, lang, CASE WHEN lang = {_q(t)} THEN "
                     f"(SELECT n FROM small_t WHERE split = 'train') ELSE 10 END AS size FROM (SELECT DISTINCT lang FROM sizes)")
    return f"""{SPLITS},
grid AS ({' UNION ALL '.join(parts)}),
gsz AS (SELECT DISTINCT lang, size FROM grid WHERE size > 0),
g_src AS (SELECT spl.*, gsz.size FROM spl JOIN gsz USING (lang) WHERE split = 'train'),
{_sample('g_src', 'gs', ['lang', 'split', 'size'], ['part_rank', 'doc_id', 'line_no'])}
SELECT g.target_lang, gs.lang, gs.doc_id, gs.line_no FROM gs JOIN grid g ON g.lang = gs.lang AND g.size = gs.size"""


def _report() -> str:
    return f"""{_split_samples('all')},
scopes AS (
  SELECT 'entire' AS scope, lang, split, ents FROM spl
  UNION ALL SELECT 'sampled' AS scope, lang, split, ents FROM trs
  UNION ALL SELECT 'sampled' AS scope, lang, split, ents FROM tes)
{_density('lang, scope, split', 'scopes')}"""


def _compat() -> str:
    # decoded words are the kept pieces of each word; every sentence adds one blank line
    return f"""{SPLITS},
et AS (SELECT spl.*, r.ord AS lang_ord FROM spl JOIN reg r USING (lang) WHERE split = 'test'),
kw AS (
  SELECT t.doc_id, t.line_no, t.pos, left(t.word, CAST(4 * least(t.np, 62 - t.ps) AS BIGINT)) AS w,
         {_id_tag(_tag_id('t.pred'))} AS p, {_id_tag(_tag_id('t.gold'))} AS g
  FROM tok t JOIN et USING (doc_id, line_no) WHERE t.ps < 62),
so AS (
  SELECT doc_id, line_no, lang_ord, split_ord, greatest(n_kept_words, 1) + 1 AS n_lines, n_kept_words AS n_labels FROM et),
off AS (
  SELECT *, COALESCE(sum(n_lines) OVER (ORDER BY lang_ord, split_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
            COALESCE(sum(n_labels) OVER (ORDER BY lang_ord, split_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bo
  FROM so),
kwr AS (SELECT kw.*, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) - 1 AS j FROM kw),
lines AS (
  SELECT o.lo + k.j AS k, k.w AS line FROM kwr k JOIN off o USING (doc_id, line_no)
  UNION ALL SELECT lo + n_lines - 1 AS k, NULL AS line FROM off
  UNION ALL SELECT lo AS k, '' AS line FROM off WHERE n_labels = 0),
labels AS (SELECT o.bo + k.j AS k, k.p, k.g FROM kwr k JOIN off o USING (doc_id, line_no))
SELECT CAST(l.k AS BIGINT) AS k,
       CASE WHEN l.line IS NULL OR l.line = '' THEN '' ELSE '1' || chr(9) || l.line || chr(9) || b.p || chr(9) || b.g END AS value
FROM lines l JOIN labels b USING (k)"""


def _features() -> str:
    from tagtide.plans.catalog import FEATURE_CODES
    codes = "codes(label, iso) AS (VALUES " + ", ".join(f"({i}, {_q(c)})" for i, c in enumerate(FEATURE_CODES)) + ")"
    return f"""WITH {REG}, {codes},
entry AS (
  SELECT c.iso, u.dim, CAST(sum(CAST(round(CAST(u.x AS DOUBLE) * 1e6) AS BIGINT)) AS DOUBLE) AS total, count(*) AS n
  FROM embeddings e JOIN codes c USING (label), unnest(e.embedding) WITH ORDINALITY AS u(x, dim) GROUP BY c.iso, u.dim),
feats AS (
  SELECT iso, max(n) AS n_vectors, count(*) AS n_features, min(total / (CAST(n AS DOUBLE) * 1e6)) AS f_min,
         max(total / (CAST(n AS DOUBLE) * 1e6)) AS f_max
  FROM entry GROUP BY iso),
langs AS (SELECT DISTINCT d.lang, r.iso FROM documents d JOIN reg r USING (lang))
SELECT l.lang, iso, CAST(n_vectors AS BIGINT) AS n_vectors, CAST(n_features AS BIGINT) AS n_features, f_min, f_max
FROM langs l FULL JOIN feats f USING (iso)"""


LATEST = """
SELECT job, state, n_events FROM (
  SELECT user_id AS job, event_type AS state,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
         CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n_events
  FROM events) WHERE rn = 1"""


def _all_terminal() -> str:
    from tagtide.streaming.status import EVENT_TERMINAL_STATES
    cond = " OR ".join(f"split_part(state, ' ', 1) = {_q(t)}" for t in EVENT_TERMINAL_STATES)
    return f"""WITH latest AS ({LATEST})
SELECT CAST(count(*) AS BIGINT) AS n_jobs, CAST(count_if({cond}) AS BIGINT) AS n_terminal,
       CAST(COALESCE(bool_and({cond}), true) AS INT) AS all_done FROM latest"""


def _watch() -> str:
    from tagtide.streaming.status import EVENT_TERMINAL_STATES
    cond = " OR ".join(f"split_part(event_type, ' ', 1) = {_q(t)}" for t in EVENT_TERMINAL_STATES)
    return f"""WITH e AS (SELECT user_id AS job, event_type, ts, event_id, CAST({cond} AS INT) AS t FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t DESC, CASE WHEN t = 1 THEN ts END, CASE WHEN t = 1 THEN event_id END,
                                   ts DESC, event_id DESC) AS rn FROM e)
SELECT job, event_type AS state, t AS ended FROM k WHERE rn = 1"""


def _runs() -> str:
    """Runs of a job by plain windows over all its events."""
    from tagtide.streaming.jobs import DELAY_HOURS, SILENCE_HOURS
    from tagtide.streaming.status import EVENT_TERMINAL_STATES
    cond = " OR ".join(f"split_part(event_type, ' ', 1) = {_q(t)}" for t in EVENT_TERMINAL_STATES)
    return f"""WITH e AS (SELECT user_id AS job, event_type AS state, ts, event_id, epoch_us(ts) AS us, {cond} AS term FROM events),
s AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR lag(term) OVER w OR us - lag(us) OVER w > {SILENCE_HOURS} * 3600000000
                     THEN 1 ELSE 0 END AS starts FROM e WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY job ORDER BY ts, event_id) AS run FROM s),
g AS (SELECT job, run, arg_min(event_id, us) AS first_event, min(us) AS started, max(us) AS last_us, arg_max(state, us) AS state,
             count(*) AS n_events, bool_or(term) AS term, max(run) OVER (PARTITION BY job) AS runs FROM r GROUP BY job, run)
SELECT job, first_event, started, last_us AS last_ts, state, n_events,
       CASE WHEN term THEN 'ended' WHEN run < runs OR last_us // 1000 + {SILENCE_HOURS} * 3600000 <
            (SELECT max(us) // 1000 FROM e) - {DELAY_HOURS} * 3600000 THEN 'silent' ELSE 'open' END AS status FROM g"""


FIRST = """
WITH f AS (
  SELECT user_id AS job, trim(event_type) AS state,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE trim(event_type) <> ''),
jobs AS (SELECT DISTINCT user_id AS job FROM events)
SELECT j.job, COALESCE(f.state, 'UNKNOWN') AS state FROM jobs j LEFT JOIN f ON f.job = j.job AND f.rn = 1"""

LINES = """
SELECT conv_id, turn, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM conversations)"""


def _load_targets() -> str:
    parts = "parts(part) AS (VALUES " + ", ".join(f"({_q(p)})" for p, *_ in PART_SUFFIXES) + ")"
    return f"""{BASE}, {parts}
SELECT r.lang, p.part, CAST(count(s.doc_id) AS BIGINT) AS n_sent, CAST(COALESCE(sum(len(s.words)), 0) AS BIGINT) AS n_words,
       CAST(count(s.doc_id) = 0 AS INT) AS missing
FROM reg r CROSS JOIN parts p LEFT JOIN sents s ON s.lang = r.lang AND s.part = p.part
WHERE r.lang IN {TARGETS} GROUP BY r.lang, p.part"""


def _collate() -> str:
    return f"""{_split_samples('all')},{_labels_sql()},
b AS (
  SELECT t.lang, t.doc_id, t.line_no, CAST((row_number() OVER (ORDER BY r.ord, t.split_ord) - 1) // 8 AS BIGINT) AS batch_id
  FROM trs t JOIN reg r USING (lang)),
w AS (
  SELECT b.*, l.labels, least(l.n_pieces, 62) + 2 AS kept,
         max(least(l.n_pieces, 62) + 2) OVER (PARTITION BY b.batch_id) AS width
  FROM b JOIN lab l USING (doc_id, line_no))
SELECT batch_id, lang, doc_id, line_no, CAST(width AS BIGINT) AS width, CAST(width - kept AS BIGINT) AS n_pad,
       array_to_string(list_slice(labels, 1, width), ',') AS labels FROM w"""


def _token_features() -> str:
    shape = r"regexp_replace(regexp_replace(regexp_replace(word, '\p{Lu}', 'X', 'g'), '\p{Ll}', 'x', 'g'), '[0-9]', 'd', 'g')"
    return f"""{BASE}
SELECT lang, doc_id, line_no, CAST(pos AS BIGINT) AS pos, word, lower(word) AS w_lower, lower(left(word, 3)) AS w_prefix,
       lower(right(word, 3)) AS w_suffix, {shape} AS w_shape,
       CAST(regexp_matches(word, '^\\p{{Lu}}') AS VARCHAR) AS w_title, CAST(regexp_matches(word, '[0-9]') AS VARCHAR) AS w_digit,
       CAST(pos = 0 AS VARCHAR) AS w_first, COALESCE(lower(lag(word) OVER w), '<s>') AS w_prev,
       COALESCE(lower(lead(word) OVER w), '</s>') AS w_next, gold AS tag, CAST({_tag_id('gold')} AS BIGINT) AS label
FROM tok WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)"""


def _majority() -> str:
    head = f"""{SPLITS},
tks AS (SELECT t.*, s.split, lower(t.word) AS lw FROM tok t JOIN (SELECT doc_id, line_no, split FROM spl) s USING (doc_id, line_no)),
mc AS (SELECT lang, lw, gold, count(*) AS n FROM tks WHERE split = 'train' GROUP BY lang, lw, gold),
mj AS (
  SELECT lang, lw, gold AS tag FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, lw ORDER BY n DESC, {_tag_id('gold')}) AS rn FROM mc) WHERE rn = 1),
tok_m AS (
  SELECT t.doc_id, t.lang, t.line_no, t.pos, t.gold, COALESCE(m.tag, 'O') AS pred
  FROM tks t LEFT JOIN mj m ON t.lang = m.lang AND t.lw = m.lw WHERE t.split = 'test')"""
    return _score("lang", head, "tok_m")


def _per_target() -> str:
    # the span windows go by (doc_id, line_no): a test sentence is one per target
    nos = "tg(target_lang, no) AS (VALUES " + ", ".join(f"({_q(t)}, {i})" for i, t in enumerate(DEFAULT_TARGETS)) + ")"
    ctes, last = _grid().rsplit("\nSELECT ", 1)
    head = f"""{ctes},
mix AS (SELECT {last}),
{nos},
mc AS (
  SELECT m.target_lang, lower(t.word) AS lw, t.gold, count(*) AS n
  FROM tok t JOIN mix m USING (doc_id, line_no) GROUP BY ALL),
mj AS (
  SELECT target_lang, lw, gold AS tag FROM (
    SELECT *, row_number() OVER (PARTITION BY target_lang, lw ORDER BY n DESC, {_tag_id('gold')}) AS rn FROM mc) WHERE rn = 1),
tok_m AS (
  SELECT t.doc_id * {len(DEFAULT_TARGETS)} + tg.no AS doc_id, tg.target_lang AS lang, t.line_no, t.pos, t.gold,
         COALESCE(m.tag, 'O') AS pred
  FROM tok t JOIN spl s USING (doc_id, line_no) CROSS JOIN tg
  LEFT JOIN mj m ON tg.target_lang = m.target_lang AND lower(t.word) = m.lw WHERE s.split = 'test')"""
    return f"SELECT lang AS target_lang, * EXCLUDE (lang) FROM ({_score('lang', head, 'tok_m')})"


def _target_models() -> str:
    """Iterative scaling, epoch by epoch: weights wt0..wt3, losses and the
    scores of all test contexts under every epoch (held)."""
    from tagtide.operators.maxent import MAX_LENGTH, SMOOTHING
    from tagtide.plans.catalog import TRAIN_EPOCHS
    k = range(7)
    shape = r"regexp_replace(regexp_replace(regexp_replace(word, '\p{Lu}', 'X', 'g'), '\p{Ll}', 'x', 'g'), '[0-9]', 'd', 'g')"
    feats = (f"['w=' || lower(word), 'p=' || lower(left(word, 3)), 's=' || lower(right(word, 3)), 'h=' || {shape}, "
             f"'v=' || prev, 'l=' || least(length(word), {MAX_LENGTH})]")
    ns = ", ".join(f"n{c}" for c in k)
    top = "greatest(" + ", ".join(f"s{c}" for c in k) + ")"
    exps = ", ".join(f"exp((s{c} - {top})::DOUBLE / 1000000.0) AS x{c}" for c in k)
    total = " + ".join(f"x{c}" for c in k)
    loss = " + ".join(f"CASE WHEN n{c} > 0 THEN floor(-ln(x{c} / z) * n{c} * 1000000 + 0.5)::BIGINT ELSE 0 END" for c in k)
    ctes, last = _grid().rsplit("\nSELECT ", 1)
    out = f"""{ctes},
mix AS (SELECT {last}),
shaped AS (SELECT doc_id, line_no, pos, word, gold, {_tag_id('gold')} AS tid, {shape} AS sh FROM tok),
ctx AS MATERIALIZED (SELECT *, COALESCE(lag(sh) OVER (PARTITION BY doc_id, line_no ORDER BY pos), '<s>') AS prev FROM shaped),
ex AS MATERIALIZED (SELECT target_lang AS key, word, prev, count(*) AS n, {', '.join(f'count_if(tid = {c}) AS n{c}' for c in k)}
       FROM ctx JOIN mix USING (doc_id, line_no) GROUP BY ALL),
exf AS MATERIALIZED (SELECT *, unnest({feats}) AS f FROM ex),
tex AS MATERIALIZED (SELECT word, prev, count(*) AS n, {', '.join(f'count_if(tid = {c}) AS n{c}' for c in k)}
        FROM ctx JOIN (SELECT doc_id, line_no FROM spl WHERE split = 'test') USING (doc_id, line_no) GROUP BY ALL),
texf AS MATERIALIZED (SELECT *, unnest({feats}) AS f FROM tex),
obs AS MATERIALIZED (SELECT key, f, {', '.join(f'sum(n{c}) AS o{c}' for c in k)} FROM exf GROUP BY key, f),
keys AS (SELECT DISTINCT key FROM ex),
wt0 AS MATERIALIZED (SELECT key, f, {', '.join(f'0::BIGINT AS w{c}' for c in k)} FROM obs)"""
    for e in range(TRAIN_EPOCHS + 1):
        sums = ", ".join(f"sum(COALESCE(w{c}, 0))::BIGINT AS s{c}" for c in k)
        out += f""",
sc{e} AS MATERIALIZED (SELECT *, {total} AS z FROM (SELECT *, {exps} FROM (
  SELECT key, word, prev, n, {ns}, {sums} FROM exf JOIN wt{e} USING (key, f) GROUP BY key, word, prev, n, {ns}))),
ls{e} AS (SELECT key, {e} AS epoch, sum(n)::BIGINT AS n_train, sum({loss})::DOUBLE / (sum(n)::DOUBLE * 1000000.0) AS train_loss
  FROM sc{e} GROUP BY key),
held{e} AS MATERIALIZED (SELECT *, {total} AS z FROM (SELECT *, {exps} FROM (
  SELECT g.key, {e} AS epoch, word, prev, n, {ns}, {sums} FROM texf CROSS JOIN keys g LEFT JOIN wt{e} w ON w.key = g.key AND w.f = texf.f
  GROUP BY g.key, word, prev, n, {ns})))"""
        if e < TRAIN_EPOCHS:
            want = ", ".join(f"sum(floor(x{c} / z * n * 1000000 + 0.5)::BIGINT) AS e{c}" for c in k)
            new = ", ".join(f"(w{c} + floor(ln((o{c} + {SMOOTHING}::DOUBLE) / (e{c}::DOUBLE / 1000000.0 + {SMOOTHING}::DOUBLE)) * 1000000 / 6 + 0.5))::BIGINT AS w{c}"
                            for c in k)
            out += f""",
want{e} AS (SELECT key, f, {want} FROM (SELECT *, unnest({feats}) AS f FROM sc{e}) GROUP BY key, f),
wt{e + 1} AS MATERIALIZED (SELECT key, f, {new} FROM wt{e} JOIN want{e} USING (key, f) JOIN obs USING (key, f))"""
    epochs = range(TRAIN_EPOCHS + 1)
    return out + f""",
losses AS ({' UNION ALL '.join(f'SELECT * FROM ls{e}' for e in epochs)}),
held AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM held{e}' for e in epochs)}),
held_loss AS (SELECT key, epoch, sum({loss})::DOUBLE / (sum(n)::DOUBLE * 1000000.0) AS test_loss FROM held GROUP BY key, epoch)"""


def _training_loss() -> str:
    return f"""{_target_models()}
SELECT key AS target_lang, epoch::BIGINT AS epoch, n_train, train_loss, test_loss FROM losses JOIN held_loss USING (key, epoch)"""


def _best_epoch() -> str:
    best = "CASE " + " ".join(f"WHEN s{c} = greatest({', '.join(f's{i}' for i in range(7))}) THEN {c}" for c in range(7)) + " END"
    # the span windows go by (doc_id, line_no): a test sentence is one per model
    head = f"""{_target_models()},
models AS (SELECT key, epoch, row_number() OVER (ORDER BY key, epoch) - 1 AS no, count(*) OVER () AS k
           FROM (SELECT DISTINCT key, epoch FROM held)),
tok_b AS (
  SELECT m.key || '|' || m.epoch AS lang, t.doc_id * m.k + m.no AS doc_id, t.line_no, t.pos, t.gold, h.pred
  FROM (SELECT c.* FROM ctx c JOIN spl s USING (doc_id, line_no) WHERE s.split = 'test') t
  JOIN (SELECT key, epoch, word, prev, {_id_tag(best)} AS pred FROM held) h USING (word, prev)
  JOIN models m ON m.key = h.key AND m.epoch = h.epoch)"""
    return f"""SELECT split_part(lang, '|', 1) AS target_lang, split_part(lang, '|', 2)::BIGINT AS epoch, n_pred, n_gold, tp, n_tok, n_eq,
       precision, recall, f1, accuracy, CAST(row_number() OVER (PARTITION BY split_part(lang, '|', 1)
       ORDER BY f1 DESC, split_part(lang, '|', 2)::BIGINT) = 1 AS INT) AS best FROM ({_score('lang', head, 'tok_b')})"""


def _vocab_pieces() -> str:
    cand = lambda k: f"CASE WHEN ws = 0 THEN substr(word, 1, {k}) ELSE '##' || substr(word, ws + 1, {k}) END"
    best = "COALESCE(" + ", ".join(f"v{k}.piece" for k in range(6, 0, -1)) + ")"
    joins = " ".join(f"LEFT JOIN vocab v{k} ON v{k}.piece = {cand(k)}" for k in range(6, 0, -1))
    return f"""{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)},
known AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]')) AS w FROM benchmark) WHERE w <> ''),
vocab AS (
  SELECT DISTINCT left(w, k) AS piece FROM (SELECT w, unnest(range(1, least(length(w), 6) + 1)) AS k FROM known)
  UNION SELECT DISTINCT '##' || right(w, k) FROM (SELECT w, unnest(range(1, least(length(w) - 1, 4) + 1)) AS k FROM known)),
cnt AS (SELECT word, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY word),
cut AS (
  SELECT word, 0 AS ws, CAST([] AS VARCHAR[]) AS pieces, FALSE AS lost FROM cnt
  UNION ALL
  SELECT word, CASE WHEN p IS NULL THEN length(word) WHEN ws = 0 THEN length(p) ELSE ws + length(p) - 2 END,
         list_append(pieces, p), p IS NULL
  FROM (SELECT word, ws, pieces, {best} AS p FROM cut {joins} WHERE ws < length(word))),
done AS (
  SELECT word, CASE WHEN lost THEN ['[UNK]'] ELSE pieces END AS pieces FROM cut WHERE ws >= length(word))
SELECT word, n, CAST(len(pieces) AS BIGINT) AS n_pieces, array_to_string(pieces, ' ') AS pieces FROM done JOIN cnt USING (word)"""


def oracle_sql() -> dict[str, str]:
    spl_cols = "lang, doc_id, line_no, split_ord"
    return {
        "iob_sentences": _iob_sentences(),
        "iob_file_sentences": _file_sentences(),
        "corpus_load_targets": _load_targets(),
        "target_language_sentences": f"""{SPLITS}
SELECT lang, split, doc_id, line_no, CAST(len(words) AS BIGINT) AS n_words FROM spl WHERE lang = 'en'""",
        "iob_sentences_hash_anywhere": _hash_anywhere(),
        "iob_flat_sequence": _flat(),
        "corpus_failed_files": _failed_files(),
        "tag_encode_decode": _tag_codes(),
        "align_first_piece": _align(),
        "truncation_loss": f"""{BASE}
SELECT lang, doc_id, line_no, n_pieces, CAST(n_pieces + 2 - 64 AS BIGINT) AS lost FROM sents WHERE n_pieces + 2 > 64""",
        "sentence_entities": f"""{BASE}
SELECT lang, part, CAST(count(*) AS BIGINT) AS n_sent, CAST(count_if(ents > 0) AS BIGINT) AS with_entities,
       CAST(count_if(ents = 0) AS BIGINT) AS without_entities, CAST(sum(ents) AS BIGINT) AS n_entities
FROM sents GROUP BY lang, part""",
        "entity_density_by_lang": f"{SPLITS}\n{_density('lang, split', 'spl')}",
        "entity_density_rollup": f"{SPLITS}\n{_density('lang, split', 'spl').replace('GROUP BY lang, split', 'GROUP BY ROLLUP (lang, split)')}",
        "set_sizes": f"{SPLITS}\nSELECT lang, split, n FROM sizes",
        "smallest_sets": f"{SPLITS}\nSELECT split, lang, n FROM small",
        "smallest_target_sets": f"{SPLITS}\nSELECT split, lang, n FROM small_t",
        "ratio_split": f"{SPLITS}\nSELECT lang, doc_id, line_no, split, split_ord FROM spl WHERE part = 'full'",
        "train_dev_merge": f"{SPLITS}\nSELECT lang, part, doc_id, line_no, split, split_ord FROM spl",
        "density_sample": _density_sample(),
        "train_mix_all": f"{_split_samples('all')}\nSELECT {spl_cols} FROM trs",
        "train_mix_target": f"{_split_samples('en', 10)}\nSELECT {spl_cols} FROM trs",
        "test_balanced": f"{_split_samples('all')}\nSELECT {spl_cols} FROM tes",
        "experiment_grid": _grid(),
        "density_report_sampled_vs_entire": _report(),
        "batch_assign": f"""{_split_samples('all')}
SELECT t.lang, t.doc_id, t.line_no,
       CAST((row_number() OVER (ORDER BY r.ord, t.split_ord) - 1) // 8 AS BIGINT) AS batch_id
FROM trs t JOIN reg r USING (lang)""",
        "batch_collate": _collate(),
        "seeded_shuffle": f"""{_split_samples('all')}
SELECT lang, doc_id, line_no, shuffle_key, CAST(row_number() OVER (ORDER BY shuffle_key) - 1 AS BIGINT) AS position
FROM (SELECT lang, doc_id, line_no, md5(lang || '|' || doc_id || '|' || line_no || '|42') AS shuffle_key FROM trs)""",
        "argmax_labels": f"""
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS pred_id,
       {_id_tag('(list_position(embedding, list_max(embedding)) - 1) % 7')} AS pred_tag, {_id_tag('label % 7')} AS gold_tag
FROM embeddings WHERE label IS NOT NULL""",
        "masked_label_pairs": f"""{BASE},
mp AS (
  SELECT doc_id, line_no, string_agg({_id_tag(_tag_id('pred'))}, ' ' ORDER BY pos) AS pred_tags,
         string_agg({_id_tag(_tag_id('gold'))}, ' ' ORDER BY pos) AS gold_tags
  FROM tok WHERE ps < 62 GROUP BY doc_id, line_no)
SELECT s.doc_id, s.line_no, COALESCE(mp.pred_tags, '') AS pred_tags, COALESCE(mp.gold_tags, '') AS gold_tags
FROM sents s LEFT JOIN mp USING (doc_id, line_no)""",
        "entity_spans": f"""{SPANS}
SELECT doc_id, line_no, 'gold' AS side, type, b, e FROM gold_spans
UNION ALL SELECT doc_id, line_no, 'pred' AS side, type, b, e FROM pred_spans""",
        "span_errors": f"""{SPANS}
SELECT doc_id, line_no, 'fp' AS kind, type, b, e FROM (SELECT doc_id, line_no, type, b, e FROM pred_spans
  EXCEPT SELECT doc_id, line_no, type, b, e FROM gold_spans)
UNION ALL SELECT doc_id, line_no, 'fn' AS kind, type, b, e FROM (SELECT doc_id, line_no, type, b, e FROM gold_spans
  EXCEPT SELECT doc_id, line_no, type, b, e FROM pred_spans)""",
        "score_overall": _score(),
        "score_by_lang": _score("lang"),
        "score_by_type": _score_by_type(),
        "prediction_lines": f"""{SPLITS}
SELECT s.lang, s.doc_id, s.line_no, COALESCE(
       string_agg('1' || chr(9) || t.word || chr(9) || t.pred || chr(9) || t.gold, chr(10) ORDER BY t.pos), '') AS block
FROM spl s LEFT JOIN tok t USING (doc_id, line_no) WHERE s.split = 'test'
GROUP BY s.lang, s.doc_id, s.line_no""",
        "prediction_lines_compat": _compat(),
        "prediction_file_score": _score_en_test(),
        "feature_lookup": _features(),
        "latest_state": LATEST,
        "all_terminal": _all_terminal(),
        "first_state": FIRST,
        "stream_latest_state": LATEST,
        "stream_watch": _watch(),
        "job_runs": _runs(),
        "stream_job_runs": _runs(),
        "stream_lines": LINES,
        "stream_score": _score(),
        "stream_score_once": _score(),
        "stream_tail_lines": LINES,
        "stored_score": _score("lang"),
        "corpus_languages": f"""WITH {REG}
SELECT lang, COALESCE(lang IN (SELECT lang FROM reg), FALSE) AS registered, COUNT(*) AS n_docs
FROM documents GROUP BY lang""",
        "token_features": _token_features(),
        "majority_tagger": _majority(),
        "per_target_tagger": _per_target(),
        "target_training_loss": _training_loss(),
        "target_best_epoch": _best_epoch(),
        "vocab_pieces": _vocab_pieces(),
    }


def _score_en_test() -> str:
    head = f"""{SPLITS},
tok_en AS (SELECT t.* FROM tok t JOIN spl s USING (doc_id, line_no) WHERE s.split = 'test')"""
    return _score("", head, "tok_en")
