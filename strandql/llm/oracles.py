"""SQL of the training-data operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CURRICULUM = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('mix:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as n from d group by source),
w as (select *, (n - 1) % 3 + 1 as w, 3 * source_size as bound from s),
c as (select *, sum(source_size) over () as total, sum(w) over () as all_w, coalesce(sum(bound) over least_first, 0) as above, coalesce(sum(w) over least_first, 0) as above_w
  from w window least_first as (order by bound * (6 // w), n rows between unbounded preceding and 1 preceding)),
r as (select *, cast(total - above as double) / cast(all_w - above_w as double) as rate from c),
t as (select source, source_size, cast(w as double) as w, least(cast(bound as double), w * (select rate from r where w * rate <= bound order by bound * (6 // w), n limit 1)) as target from r),
p as (select doc_id, size, source_size, target, w, cast(floor(target) as bigint) as wanted, cast(sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding) - size as bigint) as before
  from d join t on d.source is not distinct from t.source),
k as (select *, case when size > 0 and wanted > before then (wanted - before - 1) // source_size + 1 else 0 end as n_draws, before / target * w as y, case w when 1 then 1.5 * w when 2 then w else 0.5 * w end as w0, w as w1, case w when 1 then 0.5 * w when 2 then w else 1.5 * w end as w2 from p),
g as (select *, (w0 + w1) / 2 * 0.5 as half from k),
f as (select *, case when y < half then 0.0 else 0.5 end as t0, case when y < half then w0 else w1 end as a, case when y < half then (w1 - w0) / 0.5 else (w2 - w1) / 0.5 end as slope, case when y < half then y else y - half end as rest from g)
select doc_id, size, source_size, target, cast(case when n_draws > 0 then (n_draws - 1) * size + least(size, wanted - (n_draws - 1) * source_size - before) else 0 end as bigint) as taken, cast(n_draws as integer) as n_draws,
  case when n_draws > 0 then round(case when rest <= 0 then t0 else least(t0 + 0.5, t0 + 2 * rest / (a + sqrt(greatest(0.0, a * a + 2 * slope * rest)))) end, 6) end as first_position from f"""

RESAMPLE = rf"""with crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as ubigint), list_transform(range(8), lambda x: cast(x as ubigint))),
    lambda c, k: case when c & 1 = 1 then xor(cast(3988292384 as ubigint), c >> 1) else c >> 1 end)) as tab),
words as (select r, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from (select text, row_number() over () as r from documents)),
aims as (select unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
hexed as (select word, hex(encode(word)) as h from (select word from words union select word from aims)),
bytes as (select word, list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as bigint), 2) as ubigint)) as b from hexed),
hashed as (select word, xor(list_reduce(list_prepend(cast(4294967295 as ubigint), b), lambda c, x: xor(c >> 8, tab[cast((xor(c, x) & 255) + 1 as bigint)])), cast(4294967295 as ubigint)) % 10000 as bucket from bytes, crc),
raw as (select bucket, count(*) as s from words join hashed using (word) group by bucket),
aim as (select bucket, count(*) as t from aims join hashed using (word) group by bucket),
gain as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from words) + 10000.0::double) / ((s + 1.0::double) * ((select count(*) from aims) + 10000.0::double)))) as bigint) as gain from raw left join aim using (bucket)),
summed as (select r, count(*) as n, cast(sum(gain) as bigint) as weight from words join hashed using (word) join gain using (bucket) group by r),
scored as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) as score
  from (select doc_id, row_number() over () as r from documents) left join summed using (r)),
ranked as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as size from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * size // 100 then place end as rank from ranked"""

LEXICAL = rf"""with words as (select r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select doc_id, text, row_number() over () as r from documents)),
own as (select distinct i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select item_id, text, row_number() over () as i from benchmark)),
sizes as (select r, doc_id, count(*) as n from words group by r, doc_id),
stats as (select count(*) as docs, cast(sum(n) as bigint) as total from sizes),
tfs as (select r, term, count(*) as tf from words where term in (select term from own) group by r, term),
w as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from tfs, stats group by term, docs),
shares as (select tfs.r, doc_id, tfs.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) as share from tfs join sizes using (r) join w using (term), stats),
scores as (select i, item_id, r, doc_id, cast(sum(share) as bigint) as score from own join shares using (term) group by i, item_id, r, doc_id having sum(share) > 0),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scores)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50"""

SQL = {"op11_curriculum": CURRICULUM, "op12_resample": RESAMPLE, "op13_lexical": LEXICAL}
