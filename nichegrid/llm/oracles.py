"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
}
_CUTS = "900,700,500,400,300,250,200,150,100,80,60,40,20"
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

# counts per document, then the exact binomial test by summing its terms, as the operator defines it
_QUALITY = rf"""
with d as (
  select row_number() over () as r, doc_id, lang, text, {_WORDS} as w, string_split(text, chr(10)) as l from documents),
tri as (
  select r, i, w[i:i+2] as t from d, unnest(range(1, greatest(len(w) - 1, 1))) as u(i) where len(w) >= 3),
rep as (select r, i from (select r, i, count(*) over (partition by r, t) as n from tri) where n > 1),
hit as (select r, count(distinct i + o) as n from rep, (values (0), (1), (2)) as v(o) group by r),
ln as (select r, x from d, unnest(l) as u(x) where regexp_matches(x, '[^\x20\x09-\x0D]')),
lines as (select r, count(*) as n, count(distinct x) as k from ln group by r),
f as (
  select d.r, doc_id, lang as stratum, coalesce(len(w), 0) as n_words,
    coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0) as word_chars,
    coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) as n_symbols,
    coalesce(lines.n - lines.k, 0) as n_dup_lines, coalesce(hit.n, 0) as n_repeat_words,
    coalesce(lines.n, 0) as n_lines,
    coalesce(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')), 0) as n_upper
  from d left join hit on d.r = hit.r left join lines on d.r = lines.r),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
known as (
  select doc_id, min(quality) = 1 as good from labels where doc_id is not null and quality is not null
  group by doc_id having min(quality) = max(quality)),
rule as ({" union all ".join(f"select r, doc_id, stratum, '{k}' as rule, {n} as num, {m} as den from b where not base_failed" for k, (n, m) in _RULES.items())}),
cut as (select unnest([{_CUTS}]) as cut, unnest(range(1, 14)) as pos),
lab as (
  select coalesce(rule.stratum, '') as s, rule, num, den, good, (md5(doc_id::varchar) < '8')::int as part
  from rule join known using (doc_id)),
n as (
  select s, count(*) filter (good and part = 1) as nc, count(*) filter (good and part = 0) as ng,
    count(*) filter (not good) as nb, count(*) over () as strata
  from lab where rule = 'symbols' group by s),
k as (
  select s, rule, cut, pos, count(*) filter (good and part = 1 and num * 1000 > cut * den) as kc,
    count(*) filter (good and part = 0 and num * 1000 > cut * den) as kg,
    count(*) filter (not good and num * 1000 > cut * den) as kb
  from lab, cut group by s, rule, cut, pos),
tail as (
  select s, rule, pos, sum(exp(lgamma(nc + 1) - lgamma(i + 1) - lgamma(nc - i + 1)
      + i * ln(0.01::double) + (nc - i) * ln(0.99::double))) as p
  from (select k.*, nc from k join n using (s) where nc > 0 and kc <= 0.01 * nc), unnest(range(0, kc + 1)) as u(i)
  group by s, rule, pos),
ok as (
  select k.*, n.ng, n.nb,
    bool_and(coalesce(p <= 0.05 / (strata * 4), false)) over (partition by k.s, k.rule order by k.pos) as certified
  from k join n using (s) left join tail using (s, rule, pos) where nb > 0),
best as (
  select s, rule, arg_max(cut, (kb * greatest(ng, 1) - 10 * kg * nb) * 100 - pos) as cut
  from ok where certified and kb * greatest(ng, 1) - 10 * kg * nb > 0 group by s, rule),
cuts as (
  select s, max(cut) filter (rule = 'symbols') as cut_symbols, max(cut) filter (rule = 'dup_lines') as cut_dup_lines,
    max(cut) filter (rule = 'repeats') as cut_repeats, max(cut) filter (rule = 'upper') as cut_upper
  from best group by s)
select doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper,
  cut_symbols, cut_dup_lines, cut_repeats, cut_upper, base_failed,
  not base_failed and not coalesce(n_symbols * 1000 > cut_symbols * word_chars, false)
    and not coalesce(n_dup_lines * 1000 > cut_dup_lines * n_lines, false)
    and not coalesce(n_repeat_words * 1000 > cut_repeats * n_words, false)
    and not coalesce(n_upper * 1000 > cut_upper * word_chars, false) as kept
from b left join cuts on cuts.s = coalesce(stratum, '')
"""

_SHARDING = """
with recursive shard as (
  select i, ('0x' || substr(md5('shard-' || i || '/start'), 1, 15))::bigint % 4099 as start,
    ('0x' || substr(md5('shard-' || i || '/step'), 1, 15))::bigint % 4098 + 1 as step
  from range(40) as t(i)),
fill(turn, owners) as (
  select 0::bigint, list_transform(range(4099), lambda x: -1::bigint)
  union all
  select turn + 1, list_concat(list_concat(list_slice(owners, 1, spot), [turn % 40]), list_slice(owners, spot + 2, 4099)) from (
    select turn, owners, list_extract(list_filter(
        list_transform(range(4099), lambda j: (start + j * step) % 4099),
        lambda p: owners[p + 1] = -1), 1) as spot
    from fill join shard on i = turn % 40 where turn < 4099)),
slots as (select unnest(owners) as owner, unnest(range(4099)) as slot from fill where turn = 4099)
select doc_id, slot::int as slot, 'shard-' || owner as shard
from (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, 'text:' || coalesce(text, ''))), 1, 15))::bigint % 4099
  as slot from documents) join slots using (slot)
"""

_CUT = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_DECONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_CUT}, []) as w from documents),
i as (select item_id, {_CUT} as w from benchmark),
win as (
  select distinct item_id, w[s:s + 9] as win from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(s)
  where len(w) > 0),
lengths as (select distinct len(win) as n from win),
place as (
  select r, s, w[s:s + n - 1] as win from d, lengths, unnest(range(1, len(w) - n + 2)) as u(s) where len(w) >= n),
found as (select distinct r, s, len(win) as n, item_id from place join win using (win)),
hit as (select r, count(distinct s + o) as n from found, unnest(range(0, n)) as u(o) group by r),
item as (
  select r, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct r, item_id from found) group by r)
select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(item.n, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (r) left join item using (r)
"""

_COLLOCATIONS = r"""
with d as (
  select coalesce(lang, 'und') as lang,
    regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces
  from documents),
p as (select lang, unnest(pieces) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
f as (
  select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase, count(*) as c
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from w, (values (1), (2), (3)) as s(size)
        where len(w) >= size)
  group by all),
total as (select lang, sum(c)::bigint as n from f where size = 1 group by lang),
found as (select lang, size, phrase, c as a, string_split(phrase, ' ') as q from f where size > 1 and c >= 10),
cut as (
  select found.lang, found.phrase, found.size, a, k, l.c as l, r.c as r,
    (1000000::hugeint * a * a) // (l.c::hugeint * r.c) as score
  from (select *, unnest(range(1, size)) as k from found) as found
  join f as l on l.lang = found.lang and l.size = k and l.phrase = array_to_string(q[1:k], ' ')
  join f as r on r.lang = found.lang and r.size = found.size - k and r.phrase = array_to_string(q[k + 1:], ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
within as (
  select lang, phrase, max(a) as most
  from (select lang, a, array_to_string(q[o:o + 1], ' ') as phrase from found, (values (1), (2)) as v(o) where size = 3)
  group by all),
ranked as (
  select best.*, row_number() over (partition by best.lang order by score desc, a desc, best.phrase) as rank
  from best left join within using (lang, phrase) where most is null or 100 * most < 50 * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": _DECONTAMINATION,
    "op2_quality_rules": _QUALITY,
    "op4_sharding": _SHARDING,
    "op13_collocations": _COLLOCATIONS,
}
