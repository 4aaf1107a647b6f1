"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import (
    conversations,
    fingerprints,
    jaccard,
    licenses,
    mixing,
    phrases,
    pivots,
    quality,
    ranking,
    sentencepieces,
    sharding,
    substrings,
    toxicity,
)
from siftlake.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(_table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_fingerprints": op5_fingerprints,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_embeddings": op7_embeddings,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_ranked_search": op11_ranked_search,
    "op12_decontamination": op12_decontamination,
    "op13_conversation_repair": op13_conversation_repair,
}

# Words by the bytes that separate them. DuckDB's regular expressions know \x escapes.
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x09-\x0D\x20]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op3_mixing": r"""
with d as (
  select doc_id, source, md5('0:' || doc_id) as place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents
),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from d group by source
),
o as (
  select *, 3 * source_size as cap,
         sum(source_size) over () - coalesce(sum(3 * source_size) over (
           order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_over,
         sum(weight) over (
           order by 3 * source_size / weight, source nulls last rows between current row and unbounded following) as weights
  from s
),
c as (select *, cap * weights <= left_over * weight as capped from o),
t as (
  select source, source_size,
         case when capped then cast(cap as double)
              else cast(weight as double) * cast(max(left_over) filter (not capped) over () as double)
                   / cast(sum(weight) filter (not capped) over () as double) end as target
  from c
),
e as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then cast(floor(t.target / t.source_size) as bigint) else 0 end as repeats,
         coalesce(sum(d.size) over (partition by d.source order by place, doc_id, size
                  rows between unbounded preceding and 1 preceding), 0) as base
  from d join t on d.source is not distinct from t.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(repeats * size + greatest(0, least(size, cast(round(target - repeats * source_size) as bigint) - base)) as bigint) as taken
from e
""",
    "op6_substring_dedup": f"""
with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as words from documents),
b as (
  select doc_id, unnest(generate_series(1, len(words) - 49)) as start, words from w where len(words) >= 50
),
h as (select doc_id, start, md5(array_to_string(words[start:start + 49], ' ')) as block from b),
f as (select block, min(doc_id) as first_id from h group by block),
s as (select h.doc_id, list(h.start) as starts from h join f using (block) where f.first_id < h.doc_id group by h.doc_id),
c as (select doc_id, list_distinct(flatten(list_transform(starts, lambda s: generate_series(s, s + 49)))) as gone from s),
k as (
  select w.doc_id, len(words) as n_words, coalesce(len(gone), 0) as n_removed,
         case when gone is null then words
              else list_filter(words, lambda x, i: not list_contains(gone, i)) end as kept
  from w left join c using (doc_id)
)
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
""",
    "op7_embeddings": """
with recursive v as (
  select vec_id, label, embedding::double[] as e,
         embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
         and list_bool_or(list_transform(embedding, lambda x: x <> 0)) as usable
  from embeddings
),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b
  on a.label = b.label and a.vec_id <> b.vec_id and a.usable and b.usable and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
),
r(vec_id, reached) as (
  select vec_id, vec_id from v union select r.vec_id, l.b from r join l on l.a = r.reached
),
n as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, any_value(coalesce(n_links, 0)) as n_links, min(reached) as component_id, vec_id = min(reached) as kept
from r left join n using (vec_id) group by vec_id
""",
    "op10_ngram_jaccard": f"""
with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as words from documents),
s as (
  select doc_id, case when len(words) = 0 then []
    when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' '))) end as grams
  from w
),
n as (select doc_id, len(grams) as n from s),
g as (select doc_id, unnest(grams) as gram from s),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2
),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * common >= 80 * (x.n + y.n - common)
),
e as (select a, b from l union select b, a from l),
r(doc_id, reached) as (
  select doc_id, doc_id from n union select r.doc_id, e.b from r join e on e.a = r.reached
)
select doc_id, any_value(n) as n_shingles, min(reached) as component_id
from r join n using (doc_id) group by doc_id
""",
    "op11_ranked_search": f"""
with t as (select doc_id, unnest({_TERMS}) as term from documents),
f as (select doc_id, term, count(*) as tf from t group by all),
n as (select doc_id, count(*) as n from t group by doc_id),
a as (select count(*) as n_all, cast(sum(n) as bigint) as l_all from n),
w as (select term, cast(floor(1000 * ln((2 * n_all + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from f, a group by term, n_all),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
s as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_all) // l_all))))) as bigint) as score
  from q join f using (term) join w using (term) join n using (doc_id), a group by item_id, doc_id
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
""",
    "op12_decontamination": rf"""
with i as (select item_id, {_TERMS} as words from benchmark),
j as (select item_id, words, least(10, len(words)) as n from i where len(words) > 0),
w as (
  select distinct item_id, n, array_to_string(words[pos:pos + n - 1], ' ') as phrase
  from (select *, unnest(range(1, len(words) - n + 2)) as pos from j)
),
d as (select doc_id, {_TERMS} as words from documents),
p as (
  select doc_id, n, pos, array_to_string(words[pos:pos + n - 1], ' ') as phrase
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as pos from d, (select distinct n from w))
),
m as (select doc_id, pos, n, item_id from p join w using (n, phrase)),
h as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as place from m) group by doc_id),
s as (select doc_id, list_sort(list(distinct item_id::varchar)) as names from m group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(names), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(names, ','), '')) as items_sha256, n_hit is not null as contaminated
from d left join h using (doc_id) left join s using (doc_id)
""",
    "op13_conversation_repair": r"""
with recursive bits as (
  select list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as steps
),
named as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations
),
coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::bigint),
           lambda c, x: xor(steps[xor(c & 255, x) + 1], c >> 8), 4294967295), 4294967295) % 20 as kind
  from named, bits
),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from coded
),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(role || chr(0) || text), copy) as pos from damaged
),
marked as (
  select *, left(role, 1) as initial,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
              when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault
  from placed
),
stats as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated
  from marked group by conv_id
),
pairs as (
  select conv_id, initial || lead(initial) over (partition by conv_id order by pos) as pair from marked
),
wrong as (select conv_id, count(*) as illegal from pairs where pair not in ('su', 'ua', 'au') group by conv_id),
-- The cheapest repair of the rows from ``pos`` on, by state of the grammar: cost, edits, lines.
costs(conv_id, pos, s, o, u, a) as (
  select conv_id, n + 1, {'c': 0, 'e': '', 't': ''}, {'c': 4, 'e': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)},
         {'c': 2, 'e': 'I', 't': 'assistant:' || chr(10)}, {'c': 0, 'e': '', 't': ''}
  from stats
  union all
  select conv_id, pos,
         least(s, {'c': 2 + u2.c, 'e': 'I' || u2.e, 't': 'user:' || chr(10) || u2.t}),
         least(o, {'c': 2 + u2.c, 'e': 'I' || u2.e, 't': 'user:' || chr(10) || u2.t}), u2,
         least(a, {'c': 2 + u.c, 'e': 'I' || u.e, 't': 'user:' || chr(10) || u.t})
  from (
    select *, least(u, {'c': 2 + a.c, 'e': 'I' || a.e, 't': 'assistant:' || chr(10) || a.t}) as u2 from (
      select m.conv_id, m.pos,
        least({'c': 3 + c.s.c, 'e': 'D' || c.s.e, 't': c.s.t},
          case when gone then never when initial = 's' then {'c': late + c.o.c, 'e': 'K' || c.o.e, 't': line || c.o.t}
               when initial = 'u' then {'c': late + c.u.c, 'e': 'K' || c.u.e, 't': line || c.u.t} else never end,
          case when gone then never else {'c': 2 + late + c.u.c, 'e': 'R' || c.u.e, 't': 'user:' || text || chr(10) || c.u.t} end) as s,
        least({'c': 3 + c.o.c, 'e': 'D' || c.o.e, 't': c.o.t},
          case when gone then never when initial = 'u' then {'c': late + c.u.c, 'e': 'K' || c.u.e, 't': line || c.u.t} else never end,
          case when gone then never else {'c': 2 + late + c.u.c, 'e': 'R' || c.u.e, 't': 'user:' || text || chr(10) || c.u.t} end) as o,
        least({'c': 3 + c.u.c, 'e': 'D' || c.u.e, 't': c.u.t},
          case when gone then never when initial = 'a' then {'c': late + c.a.c, 'e': 'K' || c.a.e, 't': line || c.a.t} else never end,
          case when gone then never else {'c': 2 + late + c.a.c, 'e': 'R' || c.a.e, 't': 'assistant:' || text || chr(10) || c.a.t} end) as u,
        least({'c': 3 + c.a.c, 'e': 'D' || c.a.e, 't': c.a.t},
          case when gone then never when initial = 'u' then {'c': late + c.u.c, 'e': 'K' || c.u.e, 't': line || c.u.t} else never end,
          case when gone then never else {'c': 2 + late + c.u.c, 'e': 'R' || c.u.e, 't': 'user:' || text || chr(10) || c.u.t} end) as a
      from costs c join (
        select *, fault in ('b', 'd') as gone, (fault = 't')::int as late, role || ':' || text || chr(10) as line,
               {'c': 1000000000, 'e': '', 't': ''} as never from marked
      ) m on m.conv_id is not distinct from c.conv_id and m.pos = c.pos - 1
    )
  )
)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(c.s.c, 0) as bigint) as cost,
       coalesce(c.s.e, '') as audit, sha256(coalesce(left(c.s.t, length(c.s.t) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join stats on stats.conv_id is not distinct from i.conv_id
left join wrong on wrong.conv_id is not distinct from i.conv_id
left join costs c on c.conv_id is not distinct from i.conv_id and c.pos = 1
""",
}
