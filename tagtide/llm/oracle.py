"""DuckDB SQL for the queries that SQL can express.

op3, op4, op7, op9 and op12 (tree scoring, trained models, tokeniser, rolling
hashes) have none; op2 and op8 are iterative (components) and op10 makes
base-32 digests: they are held against brute force in tests/llm.
"""

from __future__ import annotations

from tagtide.llm.decontam import MASKS, MIN_MATCH, WINDOW
from tagtide.llm.licenses import COPYRIGHT_LINE, EQUIVALENT, PUNCTUATION
from tagtide.llm.license_texts import NOTICES, TEXTS


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(col: str) -> str:
    out = f"regexp_replace(lower({col}), {_quote(COPYRIGHT_LINE)}, ' ', 'g')"
    for old, new in EQUIVALENT:
        out = f"replace({out}, {_quote(old)}, {_quote(new)})"
    return f"trim(regexp_replace({out}, {_quote(PUNCTUATION)}, ' ', 'g'))"


def _license_sql() -> str:
    rows = [(k, t) for k, t in TEXTS.items()] + [(k, t) for k, v in NOTICES.items() for t in v]
    values = ", ".join(f"({_quote(k)}, {_quote(t)})" for k, t in rows)
    return f"""
with known as (select sha256({_canonical('t')}) as digest, min(license_id) as license_id
               from (values {values}) v(license_id, t) group by 1),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
whole as (select r, doc_id, sha256({_canonical('text')}) as digest from docs),
lines as (select distinct r, unnest(string_split(text, chr(10))) as line from docs),
notes as (select r, string_agg(distinct license_id, ',' order by license_id) as notices
          from (select r, sha256({_canonical('line')}) as digest from lines) l join known using (digest) group by r)
select doc_id, whole.digest, license_id, coalesce(notices, '') as notices
from whole left join known on whole.digest = known.digest left join notes using (r)
"""


def _decontam_sql() -> str:
    keys = " union all ".join(
        f"select {{cols}}, p - 1 as pos, {k} as mask, ["
        + ", ".join(f"th[p + {o}]" for o in m)
        + f"] as seed from {{rows}}, range(1, len(th) - {max(m) + 1} + 2) g(p)" for k, m in enumerate(MASKS))
    tokens = "[x for x in string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') if x <> '']"
    return f"""
with d as (select doc_id, text, {tokens} as th from documents where text is not null),
t as (select distinct item_id, {tokens} as th from benchmark where item_id is not null and text is not null),
ds as ({keys.format(cols='doc_id, text', rows='d')}),
ts as ({keys.format(cols='item_id, th', rows='t')}),
hits as (select distinct ds.doc_id, ds.text, ts.item_id, ts.th as ith, ds.pos - ts.pos as diag
         from ds join ts on ds.mask = ts.mask and ds.seed = ts.seed),
cells as (select h.*, greatest(0, -diag) as lo, least(len(ith), len(d.th) - diag) as hi, d.th as dth,
                 least({WINDOW}, len(ith)) as size
          from hits h join d on h.doc_id is not distinct from d.doc_id and h.text = d.text),
same as (select doc_id, item_id, diag, lo, size, len(ith) as m,
                [case when ith[j + 1] = dth[j + diag + 1] then 1 else 0 end for j in range(lo, hi)] as same
         from (select distinct * from cells)),
wins as (select doc_id, item_id, diag, lo, size, s, list_sum(same[s + 1:s + size]) as n
         from same, range(0, len(same) - size + 1) w(s)),
best as (select doc_id, item_id, lo + s + diag as doc_start, lo + s as item_start, n, size,
                row_number() over (partition by doc_id, item_id order by n desc, lo + s + diag, lo + s, size desc) as k
         from wins where n >= size - {WINDOW - MIN_MATCH})
select doc_id, item_id, cast(doc_start as bigint) as doc_start, cast(item_start as bigint) as item_start,
       cast(n as bigint) as matched, cast(size as bigint) as n_tokens from best where k = 1
"""


def _lines_sql() -> str:
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select r, doc_id, i, lines[i] as line, translate(trim(lines[i], {blank}), '{upper}', '{lower}') as key
         from docs, range(1, len(lines) + 1) g(i)),
often as (select key, max(doc_id) as last from line where length(key) >= 40 and doc_id is not null
          group by key having count(distinct doc_id) >= 5),
kept as (select r, doc_id, i, line, last is not null and doc_id is not null and doc_id <> last as gone
         from line left join often using (key))
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from kept group by r, doc_id
"""


def _spelling_sql() -> str:
    """crc32 bit by bit over the bytes; near words by the rest that a deletion
    leaves: one word is the other's rest, or both leave one rest at one place."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive found as (select coalesce(cast(doc_id as varchar), '') as id,
                      unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')) as run from documents),
runs as (select id, translate(run, '{upper}', '{lower}') as run, count(*) as k from found group by 1, 2
         having length(run) >= 6),
bytes as (select id, run, k, hex(encode(id || ':' || run)) as x from runs),
hashes as (select id, run, k, xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], [('0x' || x[2 * i + 1:2 * i + 2])::bigint for i in range(0, length(x) // 2)]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: case when s & 1 = 1
        then xor(s >> 1, 3988292384::bigint) else s >> 1 end))) as h from bytes),
words as (select word, cast(sum(k) as bigint) as n from (
    select k, case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word
    from hashes) where length(word) >= 6 group by word having sum(k) >= 5),
rests as (select word, n, p, word[:p] || word[p + 2:] as rest from words, range(0, length(word)) g(p)),
shorter as (select distinct r.word as a, r.n as an, w.word as b, w.n as bn from rests r join words w on w.word = r.rest),
near as (select a as word, b as near, bn as near_n from shorter union all select b, a, an from shorter
         union all select x.word, y.word, y.n from rests x join rests y
         on x.p = y.p and x.rest = y.rest and x.word <> y.word),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, encode(near))) as near, max(near_n) as near_n
         from near group by word),
forms as (select w.word, n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * n then near end as form,
                 case when near_n >= 5 * n then near_n end as form_n from words w left join best b on w.word = b.word),
steps as (select word, word as here, 0 as k from forms
          union all select s.word, f.form, k + 1 from steps s join forms f on f.word = s.here where f.form is not null),
last as (select word, arg_max(here, k) as root from steps group by word)
select word, form, root, n, n_near, form_n from forms join last using (word)
"""


def _search_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tokens = f"[t for t in string_split_regex(translate(text, '{upper}', '{lower}'), " \
             "'[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') if t <> '']"
    return f"""
with docs as (select row_number() over () as r, doc_id, {tokens} as terms from documents where text is not null),
sized as (select r, doc_id, terms, len(terms) as n from docs where len(terms) > 0),
total as (select count(*) as nd, sum(n)::bigint as nt from sized),
tf as (select r, term, count(*) as tf from (select r, unnest(terms) as term from sized) group by r, term),
df as (select term, count(*) as df from tf group by term),
item as (select distinct item_id, unnest({tokens}) as term from benchmark where text is not null),
scored as (select item_id, r, cast(sum(floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::bigint
                  * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) as bigint) as score
           from item join df using (term) join tf using (term) join sized using (r), total group by item_id, r),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank,
                  doc_id, score from scored join sized using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50
"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": _decontam_sql(),
    "op5_license_scan": _license_sql(),
    "op6_line_dedup": _lines_sql(),
    "op11_spelling_variants": _spelling_sql(),
    "op13_ranked_search": _search_sql(),
}
