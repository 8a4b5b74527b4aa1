"""DuckDB SQL for the queries that SQL can express, by plain definitions instead of the operators'
methods."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = f"""
with texts as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from texts where len(w) >= 20),
duplicates as (
  select doc_id, s
  from (select doc_id, s, row_number() over (partition by array_to_string(w[s : s + 19], ' ') order by doc_id, s) as n from starts)
  where n > 1
),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from duplicates),
placed as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from texts),
kept as (
  select placed.doc_id, count(gone.p) as n_removed,
         string_agg(word, ' ' order by placed.p) filter (gone.p is null) as kept
  from placed left join gone on placed.doc_id = gone.doc_id and placed.p = gone.p group by placed.doc_id
)
select t.doc_id, len(t.w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts t left join kept k on t.doc_id = k.doc_id"""

JACCARD = f"""
with recursive texts as (
  select doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents
),
starts as (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as s from texts where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[s : s + 2], ' ') as shingle from starts),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as n
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
),
links as (
  select x, y from common c join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * c.n >= 90 * (a.n + b.n - c.n)
),
either as (select x, y from links union all select y, x from links),
reached as (
  select doc_id, doc_id as origin from sizes
  union
  select e.y, r.origin from reached r join either e on e.x = r.doc_id
),
least as (select doc_id, min(origin) as component_id from reached group by doc_id)
select t.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.component_id, t.doc_id) as component_id
from texts t left join sizes s on s.doc_id = t.doc_id left join least l on l.doc_id = t.doc_id"""

# CRC-32 by its polynomial, a byte at a time.
SHARDING = """
with steps as (
  select list_transform(range(256), lambda i:
    list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
texts as (
  select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + 16 as size,
         hex(encode(coalesce(text, ''))) as digits from documents
),
sums as (
  select doc_id, text, size, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(size - 16), lambda i: cast('0x' || substr(digits, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) as text_crc32
  from texts, steps
),
placed as (
  select *, coalesce(sum(size) over (order by substr(md5(text), 1, 15), doc_id rows between unbounded preceding and 1 preceding), 0) as start,
         sum(size) over () as total, row_number() over (order by substr(md5(text), 1, 15), doc_id) as place
  from sums
),
dealt as (select *, cast(start * 40 // total as integer) as shard from placed)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by place) - 1 as slot, cast(null as integer) as grown_shard
from dealt"""


SUFFIX_SORT = """
with texts as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
),
strings as (
  select doc_id, s, substr(h, 2 * s + 1, 100) as x
  from (select doc_id, h, unnest(range(n - 49)) as s from texts where n >= 50)
),
least as (select x, min(doc_id) as source from strings group by x having min(doc_id) < max(doc_id)),
gone as (select doc_id, s from strings join least using (x) where doc_id > source),
spans as (
  select doc_id, min(s) as start, max(s) + 50 as stop
  from (
    select doc_id, s, sum(first) over (partition by doc_id order by s) as span
    from (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 50 then 0 else 1 end as first from gone)
  )
  group by doc_id, span
),
pieces as (
  select doc_id, coalesce(lag(stop) over (partition by doc_id order by start), 0) as start, start as stop from spans
  union all
  select doc_id, max(stop), null from spans group by doc_id
),
kept as (
  select p.doc_id, string_agg(substr(h, 2 * p.start + 1, 2 * (coalesce(p.stop, n) - p.start)), '' order by p.start) as h
  from pieces p join texts t on t.doc_id = p.doc_id group by p.doc_id
),
sums as (select doc_id, sum(stop - start) as n_removed, count(*) as n_spans from spans group by doc_id)
select t.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k.h, t.h))) as kept_sha256
from texts t left join kept k on k.doc_id = t.doc_id left join sums s on s.doc_id = t.doc_id"""

SPELLING = f"""
with recursive steps as (
  select list_transform(range(256), lambda i:
    list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
runs as (
  select doc_id, run, count(*) as n
  from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00c0-\u00ff]+')) as run
    from documents
  )
  where length(run) >= 6 group by all
),
bytes as (
  select run, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as digits from runs
),
hashed as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(digits) // 2), lambda i: cast('0x' || substr(digits, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) as h
  from bytes, steps
),
words as (
  select word, cast(sum(n) as bigint) as n
  from (
    select n, case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
    from hashed
  )
  where length(word) >= 6 group by word having sum(n) >= 5
),
shorter as (select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as p from words)),
near as (
  select a.word, b.word as near, b.n as near_n from shorter a join shorter b on a.p = b.p and a.rest = b.rest and a.word <> b.word
  union
  select s.word, w.word, w.n from shorter s join words w on w.word = s.rest
  union
  select w.word, s.word, s.n from shorter s join words w on w.word = s.rest
),
best as (
  select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as place from near
),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * w.n then near end as form, case when near_n >= 5 * w.n then near_n end as form_n
  from words w left join best b on b.word = w.word and place = 1
),
chains as (
  select word, word as root, form as next from forms
  union all
  select c.word, f.word, f.form from chains c join forms f on f.word = c.next
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f join chains c on c.word = f.word and c.next is null"""

def all_oracles() -> dict[str, str]:
    return {
        "op1_substrings": SUBSTRINGS,
        "op4_sharding": SHARDING,
        "op5_jaccard": JACCARD,
        "op12_suffix_sort": SUFFIX_SORT,
        "op13_spelling": SPELLING,
    }
