"""Registered queries of the operators, with the parameters they run with in production."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from noonward.llm import (
    bpe,
    chat,
    decontaminate,
    embedding_dedup,
    jaccard_join,
    lexical_search,
    license_scan,
    line_dedup,
    pii,
    quality_rules,
    source_divergence,
    token_counts,
    url_filter,
)
from noonward.llm.common import table
from noonward.llm.registry import ORACLE, QUERIES, query
from noonward.session import shared_folder

__all__ = ["ORACLE", "QUERIES"]

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTED_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 1024


@query("op1_bpe")
def op1_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = bpe.encode_and_decode(docs, BPE_RANKS, public_tokenizers.PATTERN)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


CONTROL_TEXT = r"\### Assistant: </turn> ok"
OP2_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
    sum(length('<turn>') + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + 1
      + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + length('</turn>') + 1)
      over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as ends
  from t window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, max(n) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(ends) filter (role = 'assistant' or pos = n) as bigint) as formatted_chars
from s group by conv_id
"""


@query("op2_chat", OP2_SQL)
def op2_chat(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    control = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), role, F.lit(CONTROL_TEXT))
    said = chat.read_back(chat.expand(turns.union(control)))
    each = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    trained = F.array_join("trained", "")
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op5_token_counts")
def op5_token_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cache = shared_folder(spark) + "/token_counts"
    made = token_counts.token_counts(docs, COUNTED_TOKENIZER, public_tokenizers.PATTERN, cache)
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


URL_PREFIXES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Host and path divided by #; blocked unless a prefix rule says otherwise.
URL_GLOBS = ["adult*#*", "*.adult*#*", "*casino*#*", "*-bets.*#*", "*porn*#*", "*#*/ads/*", "*#*.exe"]


def _url_sql() -> str:
    longest = sorted(URL_PREFIXES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in longest]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (h, p, _) in zip(fits, longest))
    verdict = " ".join(f"when {f} then '{v}'" for f, (_, _, v) in zip(fits, longest))
    globs = " or ".join(f"host || '#' || path glob '{g}'" for g in URL_GLOBS)
    return f"""
        with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages)
        select *, case {rule} end as rule, case {verdict} when {globs} then 'block' else 'allow' end as verdict from u
    """


@query("op10_url_filter", _url_sql())
def op10_url_filter(spark, folder):
    rules = [r for prefix in URL_PREFIXES for r in url_filter.prefix_rules(*prefix)]
    rules += [url_filter.Rule(g, "block") for g in URL_GLOBS]
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


@query("op9_quality_rules")
def op9_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality_rules.judge(quality_rules.measure(docs).drop("text"))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *own, "base_failed", "kept", F.round("p_good", 9).alias("p_good"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_groups(docs, jaccard_join.Settings(words=4, percent=85))


@query("op6_decontamination")
def op6_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, folder, "benchmark"))


@query("op8_pii")
def op8_pii(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_spans(pii.detect(docs).drop("text"))
    counts = [F.size(pii.of_kind("base", k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.sha2(pii.listed(F.col("base")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


REPEATED_WORDS = 20
OP3_SQL = f"""
with t as (
  select doc_id, text, unnest(regexp_extract_all(text, '\\n|[^\\n.!?]*[.!?]+|[^\\n.!?]+')) as part,
    generate_subscripts(regexp_extract_all(text, '\\n|[^\\n.!?]*[.!?]+|[^\\n.!?]+'), 1) as pos
  from documents where text <> ''
), u as (
  select doc_id, pos, part, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[ \\t-\\r]+', ' ', 'g'), ' ') as unit,
    sum(length(part)) over (partition by doc_id order by pos) - length(part) as low
  from t
), own as (
  select *, length(unit) - length(replace(unit, ' ', '')) + 1 as words,
    low + length(part) - length(ltrim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as a,
    low + length(rtrim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as b,
    row_number() over (partition by unit order by doc_id nulls last, pos) > 1 as gone
  from u where unit <> ''
), runs as (
  select *, sum(case when gone and lag_gone then 0 else 1 end) over (partition by doc_id order by pos) as run
  from (select *, coalesce(lag(gone) over (partition by doc_id order by pos), false) as lag_gone from own)
), spans as (
  select doc_id, cast(min(a) as bigint) as a, cast(max(b) as bigint) as b from runs where gone
  group by doc_id, run having sum(words) >= {REPEATED_WORDS}
), cut as (
  select doc_id, string_agg(a || ':' || b, ',' order by a) as removed, cast(sum(b - a) as bigint) as removed_chars
  from spans group by doc_id
), starts as (
  select doc_id, 0 as low from documents union all select doc_id, b from spans
), rest as (
  select s.doc_id, s.low, coalesce((select min(a) from spans e where e.doc_id = s.doc_id and e.a >= s.low), 1000000000) as ends from starts s
), kept as (
  select r.doc_id, string_agg(substring(d.text, cast(low + 1 as int), cast(ends - low as int)), '' order by low) as kept
  from rest r join documents d on d.doc_id = r.doc_id group by r.doc_id
)
select d.doc_id, coalesce(removed_chars, 0) as removed_chars, coalesce(removed, '') as removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join cut c on d.doc_id = c.doc_id left join kept k on d.doc_id = k.doc_id
"""


@query("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = line_dedup.remove_repeats(docs, REPEATED_WORDS)
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s.start, s.end)), ",")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s.end - s.start))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return made.select("doc_id", gone.alias("removed_chars"), spans.alias("removed"), kept.alias("kept_sha256"))


@query("op4_license_scan")
def op4_license_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    told = F.transform("licenses", lambda m: F.concat_ws(":", m.license, m.start, m.end, m.matched))
    found = license_scan.scan(docs)
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(told, ",").alias("licenses"))


OP11_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a
), comp as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e left join counts c on c.a = e.vec_id left join comp p on p.a = e.vec_id
"""


@query("op11_embedding_dedup", OP11_SQL)
def op11_embedding_dedup(spark, folder):
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


RANKED = 50
OP12_SQL = f"""
with t as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents
), tf as (select doc_id, term, count(*) as tf from t group by all),
len as (select doc_id, sum(tf) as n from tf group by all),
total as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from len),
df as (select term, count(*) as df from tf group by all),
w as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint) as w from df, total),
m as (select doc_id, cast(50 + (50 * n * big_n) // big_l as bigint) as m from len, total),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark
), scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from q join w using (term) join tf using (term) join m using (doc_id) group by all
), ranked as (
  select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= {RANKED}
"""


@query("op12_lexical_search", OP12_SQL)
def op12_lexical_search(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lexical_search.ranked_search(docs, table(spark, folder, "benchmark"), RANKED)


KEPT_FROM, TOP_TERMS = 3, 200
OP13_SQL = f"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as row
  from documents
), t as (
  select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d
), kept as (
  select lang, term, count(*) as n from t group by all having count(distinct row) >= {KEPT_FROM}
), langs as (
  select lang, coalesce(v, 0) as v, coalesce(total, 0) as total from (select distinct lang from d)
  left join (select lang, count(*) as v, cast(sum(n) as bigint) as total from kept group by lang) using (lang)
), counts as (
  select lang, source, term, count(*) as n from t join (select lang, term from kept) using (lang, term) group by all
), groups as (
  select lang, source, coalesce(total, 0) as total, v from (select distinct lang, source from d)
  left join (select lang, source, cast(sum(n) as bigint) as total from counts group by all) using (lang, source)
  join (select lang, v from langs) using (lang)
), p as (
  select g.lang, g.source, k.term, c.n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (total + v) as p,
    1 + (1000000000 * (k.n + 1)) // (lang_total + v) as q
  from groups g join (select lang, total as lang_total from langs) using (lang) join kept k on k.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), sums as (
  select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q
), ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
  from (select * from pairs union all select * from terms)
)
select * from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""


@query("op13_source_divergence", OP13_SQL)
def op13_source_divergence(spark, folder):
    return source_divergence.audit(table(spark, folder, "documents"), KEPT_FROM, TOP_TERMS)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
