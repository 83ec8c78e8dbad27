"""The queries that apply these operators to whole tables."""

from __future__ import annotations

from graftline.llm.decontamination import op8_decontamination
from graftline.llm.jaccard_join import op10_jaccard
from graftline.llm.language_model import op1_language_model
from graftline.llm.line_dedup import op6_lines
from graftline.llm.packing import op4_packing
from graftline.llm.pii import op7_pii
from graftline.llm.quality import op3_quality
from graftline.llm.repeats import op9_repeats
from graftline.llm.sharding import op2_shards
from graftline.llm.url_filter import RULES, op5_urls

QUERIES = {f.__name__: f for f in (op1_language_model, op2_shards, op3_quality, op4_packing, op5_urls, op6_lines, op7_pii, op8_decontamination, op9_repeats, op10_jaccard)}

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_sql() -> str:
    longest = sorted(RULES, key=lambda r: (len(r.name), r.host), reverse=True)
    return "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.name}'" for r in longest) + " end"


#: The rules, and on tables whose pages link to no other address (as the test tables) the whole result.
URLS_SQL = f"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UP}', '{LOW}') host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
q as (select page_id, host, path, {_rule_sql()} as rule from p)
select page_id, host, path, rule, case when rule in ({", ".join(f"'{r.name}'" for r in RULES if r.verdict == "block")}) then 'block' else 'allow' end verdict from q"""

#: Sets, every pair that shares a shingle, and what links reach.
JACCARD_SQL = f"""
with recursive t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
w as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from t),
g as (select doc_id, i, count(*) over (partition by doc_id) n, concat_ws(' ', w, lead(w, 1) over k, lead(w, 2) over k, lead(w, 3) over k, lead(w, 4) over k) g from w window k as (partition by doc_id order by i)),
u as (select distinct doc_id, g from g where i <= greatest(n - 4, 1)),
s as (select doc_id, count(*) n from u group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) n from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select p.x, p.y from p join s a on a.doc_id = p.x join s b on b.doc_id = p.y where 100 * p.n >= 80 * (a.n + b.n - p.n)),
e as (select x, y from l union all select y, x from l),
c(doc_id, r) as (select doc_id, doc_id from documents union select c.doc_id, e.y from c join e on c.r = e.x)
select d.doc_id, coalesce(s.n, 0) n_shingles, m.component_id from documents d left join s on d.doc_id = s.doc_id join (select doc_id, min(r) component_id from c group by doc_id) m on d.doc_id = m.doc_id"""

#: What the others compute (hashes, fitted models, iterations) isn't in SQL; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {"op5_urls": URLS_SQL, "op10_jaccard": JACCARD_SQL}
