"""Registered queries of the operators in this package, and their DuckDB oracles.

Each query applies its operator with production parameters to a whole table and derives the result
columns from the operator's output.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbook.llm import (bpe, chat, decontaminate, html_text, jaccard, langid, phrases, quality, repair, secret_ledger,
                          token_rollup, toxicity, vectors)
from riskbook.llm.common import remainder_is, table
from riskbook.session import materialize, scratch_folder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~remainder_is("doc_id", 5, 0))
    out = langid.identify(docs, model, with_spans=False)
    return out.select(F.col("id").alias("doc_id"), remainder_is("id", 5, 0).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    usable = F.col("doc_id").isNotNull() & ~remainder_is("doc_id", 3, 1)
    model = quality.fit(docs.select("doc_id", "text").join(labels.where(usable & F.col("quality").isNotNull()), "doc_id"), usable)
    out = quality.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), remainder_is("id", 3, 1).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; the ledger starts empty."""
    docs = table(spark, sf_dir, "documents")
    ledger = secret_ledger.BlobLedger(spark, scratch_folder(spark, "blob-ledger"))
    ledger.ingest(docs, "batch-1")
    found = ledger.by_path(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    out = vectors.link_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    out = jaccard.jaccard_links(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, segment, n_turns, n_same, turns_here, text."""
    return chat.format_chats(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, version, n_docs, n_tokens after four batches: all documents by length in characters
    over 6 as a first estimate; the counts revised to words; a second tokenizer version; copies of a text
    taken back (the smallest id stays). The second batch is delivered twice."""
    docs = table(spark, sf_dir, "documents")
    versions = {v: f(F.coalesce("text", F.lit(""))) for v, f in token_rollup.TOKENIZERS.items()}
    names = {v: v.replace("-", "_") for v in versions}
    counted = materialize(docs.select(
        "doc_id", "source", "lang", F.floor(F.coalesce(F.length("text"), F.lit(0)) / 6).alias("estimate"),
        *[c.alias(names[v]) for v, c in versions.items()],
        F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2")), "counts")
    rollup = token_rollup.TokenRollup(spark, scratch_folder(spark, "token-rollup"))
    words, marks = F.col("words_1"), F.col("marks_1")
    rollup.commit("estimate", token_rollup.changes(counted, 1, {"words-1": F.col("estimate")}))
    revised = (token_rollup.changes(counted, -1, {"words-1": F.col("estimate")})
               .unionByName(token_rollup.changes(counted, 1, {"words-1": words})))
    for _ in range(2):
        rollup.commit("revise", revised)
    rollup.commit("marks", token_rollup.changes(counted, 1, {"marks-1": marks}))
    first = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    copies = counted.join(first.select("doc_id"), "doc_id", "left_anti")
    rollup.commit("copies", token_rollup.changes(copies, -1, {"words-1": words, "marks-1": marks}))
    return rollup.totals()


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers
    ranks = bpe.load_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern or public_tokenizers.PATTERN)
    out = bpe.decode(coded, ranks)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.with_decision(found).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~remainder_is("doc_id", 5, 0))
    out = toxicity.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), remainder_is("id", 5, 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    chats = table(spark, sf_dir, "conversations")
    out = repair.repair(repair.damage(chats))
    every = chats.select("conv_id").distinct()
    found = every.join(out, every["conv_id"].eqNullSafe(out["conv"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality, op3_secret_scan, op4_vector_dedup, op5_jaccard_join, op6_chat_format, op7_token_counts,
    op8_bpe_roundtrip, op9_decontaminate, op10_html_text, op11_phrases, op12_toxicity, op13_chat_repair)}

_KINDS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
_LEAST = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}
_FOUND = " union all ".join(f"""
  select doc_id, {no} as no, '{kind}' as kind, unnest(range(1, len(m) + 1)) as i, m, g, q, {_LEAST[kind][1]} as least from (
    select doc_id, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {_LEAST[kind][0]}) as q,
           regexp_split_to_array(t, '{p}') as g from d)""" for no, (kind, p) in enumerate(_KINDS.items()))



def _edit(old: str, letters: str, cost: str) -> str:
    """A state of the repair with edits behind it: ten digits of cost, then the edits."""
    return f"lpad((left({old}, 10)::bigint + {cost})::varchar, 10, '0') || substr({old}, 11) || '{letters}'"


_CLOSED = f"""f0 as c0, f1 as c1, least(f2, {_edit('f0', 'I', '2')}, {_edit('f1', 'I', '2')}, {_edit('f3', 'I', '2')}) as c2,
        least(f3, {_edit('f2', 'I', '2')}, {_edit('f0', 'II', '4')}, {_edit('f1', 'II', '4')}) as c3"""
_STEP = {q: [_edit(f"c{q}", "D", "3")] for q in range(4)}
for _q, _from, _initial in ((1, (0,), "s"), (2, (0, 1, 3), "u"), (3, (2,), "a")):
    _STEP[_q] += [f"case when stays and initial = '{_initial}' then {_edit(f'c{x}', 'K', 'cut')} end" for x in _from]
    if _initial != "s":
        _STEP[_q] += [f"case when stays then {_edit(f'c{x}', 'R', '2 + cut')} end" for x in _from]

ORACLES = {
    "op3_secret_scan": f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
places as (select doc_id, no, kind, i, length(q[i]) as checked, least, length(m[i]) as chars,
    sum(length(g[i]) + length(m[i])) over (partition by doc_id, no order by i) as stop from ({_FOUND})),
f as (select doc_id, no, kind, (stop - chars)::bigint as start, stop::bigint as stop from places where checked >= least),
per as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) as spans
    from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join per using (doc_id)""",
    "op4_vector_dedup": """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
usable as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x != 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id != b.vec_id
    where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select a as node, b as other from link union select r.node, l.b from reach r join link l on r.other = l.a),
comp as (select node, least(node, min(other)) as component_id from reach group by node),
deg as (select a, count(*) as n from link group by a)
select v.vec_id, coalesce(n, 0) as n_links, coalesce(component_id, v.vec_id) as component_id,
    coalesce(component_id, v.vec_id) = v.vec_id as kept
from v left join deg on v.vec_id = deg.a left join comp on v.vec_id = comp.node""",
    "op5_jaccard_join": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') as words from documents),
s as (select doc_id, unnest(list_distinct(case when len(words) = 0 then []::varchar[] when len(words) < 5 then [array_to_string(words, ' ')]
        else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by all),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select a as node, b as other from link union select r.node, l.b from reach r join link l on r.other = l.a),
comp as (select node, least(node, min(other)) as component_id from reach group by node)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join comp on w.doc_id = comp.node""",
    "op6_chat_format": r"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from t),
whole as (select conv_id, count(*) as n, list([role, text] order by pos) as turns from p group by conv_id),
same as (select min(conv_id) as conv_id, n, turns, count(*) as n_same from whole group by n, turns),
kept as (select conv_id, n, n_same from same s where not exists (select 1 from same l where l.n > s.n and l.turns[1:s.n] = s.turns))
select k.conv_id, (pos - 1) // 256 as segment, k.n as n_turns, n_same, count(*) as turns_here,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by pos) as text
from kept k join p using (conv_id) group by all""",
    "op7_token_counts": r"""
with c as (select doc_id, text, source, lang, unnest([
    {v: 'words-1', n: len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))},
    {v: 'marks-1', n: len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]'))}]) as x from documents),
first as (select min(doc_id) as doc_id from documents group by text)
select source, lang, x.v as version, count(*) as n_docs, sum(x.n)::bigint as n_tokens
from c where doc_id in (select doc_id from first) group by all""",
    "op9_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from (
    select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct k from win),
grams as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (
    select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)),
occ as (select doc_id, item_id, i, k from grams join win using (k, g)),
hit as (select doc_id, count(distinct j) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as j from occ) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as xs from (select distinct doc_id, item_id::varchar as x from occ) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(xs, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)""",
    "op11_phrases": r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents),
w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') as w from piece),
total as (select lang, sum(len(w))::bigint as n from w group by lang),
f as (select lang, g, k, count(*)::hugeint as f from (
    select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as g
    from w, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k) group by lang, g, k),
c as (select lang, g, k, f, string_split(g, ' ') as w from f where k > 1 and f >= 30),
cuts as (select lang, g, f as a, i, array_to_string(w[1:i], ' ') as head, array_to_string(w[i + 1:k], ' ') as rest
    from (select *, unnest(range(1, k)) as i from c)),
cut as (select t.lang, t.g, a, i, h.f as l, r.f as r, 2000000 * a // (h.f + r.f) as score
    from cuts t join f h on h.lang = t.lang and h.g = t.head join f r on r.lang = t.lang and r.g = t.rest),
best as (select *, row_number() over (partition by lang, g order by score, i) as place from cut),
inside as (select lang, p as g, max(f) as longer from (
    select lang, f, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) as p
    from c, (select unnest([2, 3]) as s) where s < k) group by all),
kept as (select b.* from best b left join inside i on b.lang = i.lang and b.g = i.g where place = 1 and not coalesce(100 * longer >= 80 * a, false)),
ranked as (select lang, g as phrase, a, l, r, score from kept)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
    a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join total using (lang)) where rank <= 2000""",
    "op13_chat_repair": rf"""
with recursive base as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
crc as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 as fault from base),
rows as (select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when fault = 3 then 2 else 1 end)) as copy from crc where fault != 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text), copy) as i,
    left(role, 1) as initial, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') as bare from rows),
named as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(initial) over (partition by conv_id order by i) as prior from placed),
marked as (select *, bare != '' and not again as stays, (right(bare, 1) not in ('.', '!', '?'))::bigint as cut from named),
steps as (
    select conv_id, 0::bigint as i, '0000000000' as f0, null::varchar as f1, null::varchar as f2, null::varchar as f3 from (select distinct conv_id from marked)
    union all
    select conv_id, i, {', '.join(f"least({', '.join(x)})" for x in _STEP.values())} from (
        select m.conv_id, m.i, stays, initial, cut, {_CLOSED} from steps s join marked m on m.conv_id is not distinct from s.conv_id and m.i = s.i + 1)),
ends as (select conv_id, least(c0, c3) as e from (select conv_id, {_CLOSED} from steps s
    where i = (select count(*) from marked m where m.conv_id is not distinct from s.conv_id))),
letters as (select conv_id, unnest(string_split(substr(e, 11), '')) as x, unnest(range(1, length(e) - 9)) as p from ends where length(e) > 10),
placed_letters as (select *, sum((x != 'I')::int) over w as i, sum((x != 'D')::int) over w as o from letters window w as (partition by conv_id order by p)),
made as (select a.*, m.role, m.text, m.initial from placed_letters a left join marked m on x != 'I' and m.conv_id is not distinct from a.conv_id and m.i = a.i where x != 'D'),
lines as (select *, max((o = 1 and x = 'K' and initial = 's')::int) over (partition by conv_id) as begun from made),
whole as (select conv_id, string_agg(case when x = 'K' then role when (o - begun) % 2 = 1 then 'user' else 'assistant' end || ':' ||
    case when x = 'I' then '' else text end, chr(10) order by p) as repaired from lines group by conv_id),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (bare = '') as blank,
    count(*) filter (bare != '' and again) as duplicate, count(*) filter (stays and cut = 1) as truncated,
    count(*) filter (prior is not null and (prior || initial) not in ('su', 'ua', 'au')) as illegal from marked group by conv_id)
select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(left(e, 10)::bigint, 0) as cost, coalesce(substr(e, 11), '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from base) b left join counted c on c.conv_id is not distinct from b.conv_id
left join ends e on e.conv_id is not distinct from b.conv_id left join whole w on w.conv_id is not distinct from b.conv_id""",
}
