"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

#: Operator 10: groups by the normalised text itself.
OP10 = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') norm from documents)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size,
       doc_id is not distinct from min(doc_id) over w kept, sha256(norm) text_sha256
from n window w as (partition by norm)
"""

#: Operator 4: payloads, and the smallest page of equal ones of 100 bytes or more.
OP4 = r"""
with p as (select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) payload_bytes from pages),
g as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by html) end first from p)
select page_id, payload_bytes, sha256(html) payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end record_type,
       case when first <> page_id then first end refers_to
from g
"""

#: Operator 1: windows of item words by length, joined with the document windows of the same lengths.
OP1 = r"""
with d as (select row_number() over () row_id, doc_id, regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from documents),
i as (select item_id, regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from benchmark),
starts as (select item_id, words, least(10, len(words)) width, unnest(range(1, len(words) - least(10, len(words)) + 2)) pos
        from i where len(words) > 0),
wanted as (select distinct item_id, width, array_to_string(words[pos:pos + width - 1], ' ') passage from starts),
places as (select row_id, words, width, unnest(range(1, len(words) - width + 2)) pos
        from d, (select distinct width from wanted) where len(words) >= width),
seen as (select row_id, width, pos, array_to_string(words[pos:pos + width - 1], ' ') passage from places),
found as (select row_id, item_id, width, pos from seen join wanted using (width, passage)),
hits as (select row_id, count(distinct place) n_hit
        from (select row_id, unnest(range(pos, pos + width)) place from (select distinct row_id, pos, width from found)) group by row_id),
items as (select row_id, count(*) n_items, string_agg(item, ',' order by item) list
        from (select distinct row_id, item_id::varchar item from found where item_id is not null) group by row_id)
select doc_id, coalesce(len(words), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(list, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (row_id) left join items using (row_id)
"""

#: Operator 6: shared shingles of every pair of different sets, and the smallest id reached over links.
OP6 = r"""
with recursive w as (select row_number() over () row_id, doc_id, regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') words from documents),
s as (select row_id, doc_id, case when coalesce(len(words), 0) = 0 then []::varchar[] else list_sort(list_distinct(list_transform(
        range(1, greatest(1, len(words) - 2) + 1), lambda k: array_to_string(words[k:least(k + 2, len(words))], ' ')))) end shingles from w),
sets as materialized (select row_number() over () node, shingles, len(shingles) n, min(doc_id) first_id
        from s where len(shingles) > 0 group by shingles),
parts as materialized (select node, n, unnest(shingles) shingle from sets),
links as materialized (select a.node u, b.node v from parts a join parts b
        on a.shingle = b.shingle and a.node < b.node and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        group by a.node, b.node, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
pairs as materialized (select u, v from links union all select v, u from links),
reach(node, other) as (select node, node from sets union select reach.node, pairs.v from reach join pairs on reach.other = pairs.u),
least_id as (select reach.node, min(first_id) component from reach join sets on reach.other = sets.node group by reach.node)
select doc_id, len(s.shingles)::bigint n_shingles, coalesce(component, doc_id) component_id,
       doc_id is not distinct from coalesce(component, doc_id) kept
from s left join sets on s.shingles = sets.shingles left join least_id using (node)
"""

#: Operator 9: every window of 50 words by its text; those that start in a document of a smaller id cover their words.
OP9 = r"""
with d as (select row_number() over () row_id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) words from documents),
starts as (select row_id, doc_id, words, unnest(range(1, len(words) - 48)) pos from d where len(words) >= 50),
windows as materialized (select row_id, doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) passage from starts),
firsts as (select passage, min(doc_id) first_id from windows group by passage),
covered as (select distinct row_id, unnest(range(pos, pos + 50)) place
        from windows join firsts using (passage) where first_id < doc_id),
kept as (select row_id, string_agg(word, ' ' order by place) text, count(*) n
        from (select row_id, unnest(words) word, unnest(range(1, len(words) + 1)) place from d)
        anti join covered using (row_id, place) group by row_id)
select doc_id, len(words)::bigint n_words, (len(words) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(kept.text, '')) kept_sha256
from d left join kept using (row_id)
"""

#: Operator 11: all products of queries and candidates, as whole numbers.
OP11 = r"""
with v as materialized (select row_number() over () row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) e from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.row_id, q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint score
        from v q join v c on q.vec_id % 20 = 0 and q.row_id <> c.row_id),
r as (select *, row_number() over (partition by row_id order by score desc, vec_id nulls last) "rank" from s)
select query_id, "rank"::int "rank", vec_id, score from r where "rank" <= 20
"""

#: Operator 12: all products of anchors and rows, then positives, then the window of each positive.
OP12 = r"""
with v as materialized (select row_number() over () row_id, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end label,
        list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.row_id, a.vec_id anchor_id, a.label own, c.vec_id, c.label, list_dot_product(a.e, c.e)::bigint score
        from v a join v c on a.vec_id % 100 = 0 and a.row_id <> c.row_id),
p as (select *, row_number() over (partition by row_id order by score desc, vec_id nulls last) nth from s where label = own),
n as (select p.row_id, p.anchor_id, p.vec_id positive_id, p.nth, p.score positive_score, s.vec_id negative_id, s.score negative_score,
        row_number() over (partition by p.row_id, p.nth order by s.score desc, s.vec_id nulls last) "rank"
        from p join s on s.row_id = p.row_id and s.label <> p.own and 80 * p.score <= 100 * s.score and s.score <= p.score
        where p.nth <= 5)
select anchor_id, positive_id, "rank"::int "rank", negative_id, positive_score, negative_score from n where "rank" <= 5
"""

ORACLE = {
    "op1_decontamination": OP1,
    "op4_warc": OP4,
    "op6_minhash": OP6,
    "op9_substring_dedup": OP9,
    "op10_exact_dedup": OP10,
    "op11_top_inner_products": OP11,
    "op12_hard_negatives": OP12,
}
