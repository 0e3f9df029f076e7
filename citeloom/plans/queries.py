"""One query an operator over the generic tables, each beside SQL that says the same.

Floats are rounded to six digits on both sides, as engines add in other orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import agreement as AG
from citeloom.operators import calibration as CA
from citeloom.operators import evaluation as EV
from citeloom.operators import pools as PO
from citeloom.operators import reports as RP
from citeloom.operators import resample as RS
from citeloom.operators import retrieval as RT
from citeloom.operators import selection as SE
from citeloom.plans import bindings as B
from citeloom.sources import articles as AR
from citeloom.sources import judgements as JU

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TOPIC = ["qa_id"]
CELL = ["qa_id", "sentence_id", "class"]
DATA_CUES = [r"\bwas the\b", r"\bthat was\b", r"\bit is\b"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# ---- shared SQL -------------------------------------------------------------
S_SENT = r"""sent AS (SELECT qa_id, (generate_subscripts(parts, 1) - 1)::INT AS sentence_id, unnest(parts) AS sentence_text FROM (
  SELECT item_id::VARCHAR AS qa_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM benchmark))"""
S_CORPUS = "corpus AS (SELECT doc_id::VARCHAR AS pmid, text AS contents FROM documents)"
S_REL = r"""rel AS (SELECT DISTINCT item_id::VARCHAR AS qa_id, pmid FROM corpus JOIN benchmark ON contains(' ' || trim(regexp_replace(contents, '\s+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' '))"""
S_POST = S_CORPUS + """, toks AS (SELECT pmid, regexp_extract_all(lower(contents), '[a-z0-9]+') AS ts FROM corpus),
post AS (SELECT pmid, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT pmid, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY pmid, term)"""
S_QREL = """qrels AS (SELECT l_orderkey::VARCHAR AS qa_id, l_linenumber AS sentence_id, l_partkey::VARCHAR AS pmid,
  CASE l_returnflag WHEN 'R' THEN 'contradict' WHEN 'A' THEN 'support' ELSE 'partial_support' END AS class, 1 AS relevance,
  CASE WHEN l_linestatus = 'F' THEN 'human' ELSE 'llm' END AS source, l_discount AS confidence, l_extendedprice * 100 + l_suppkey AS ord FROM lineitem)"""
S_POS = S_QREL + """, pos AS (SELECT setting, qa_id, sentence_id, class, pmid, arg_max(source, ord) AS source FROM (
  SELECT 'strict' AS setting, qa_id, sentence_id, class, pmid, source, ord FROM qrels WHERE class IN ('support', 'contradict')
  UNION ALL SELECT 'relaxed', qa_id, sentence_id, replace(class, 'partial_', ''), pmid, source, ord FROM qrels) GROUP BY setting, qa_id, sentence_id, class, pmid)"""
S_PRED = """pred AS (SELECT run, l_orderkey::VARCHAR AS qa_id, l_linenumber AS sentence_id, CASE WHEN l_quantity >= 25 THEN 'support' ELSE 'contradict' END AS class, l_partkey::VARCHAR AS pmid
  FROM lineitem, (VALUES ('a'), ('b')) r(run) WHERE (run = 'a' AND l_discount >= 0.05) OR (run = 'b' AND l_tax >= 0.04)),
cells AS (SELECT DISTINCT l_orderkey::VARCHAR AS qa_id, l_linenumber AS sentence_id, class FROM lineitem, (VALUES ('support'), ('contradict')) c(class)),
runs AS (SELECT * FROM (VALUES ('a'), ('b')) r(run)), settings AS (SELECT * FROM (VALUES ('strict'), ('relaxed')) s(setting))"""


def s_prf(keys: str, zero: bool) -> str:
    using = keys.replace(" ", "")
    return f"""prf AS (SELECT run, setting, {keys}, n_pred, n_pos, tp, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS P, CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END AS R,
  CASE WHEN tp > 0 THEN 2.0 * tp / (n_pred + n_pos) ELSE 0.0 END AS F1 FROM (
  SELECT run, setting, {keys}, coalesce(n_pred, 0) AS n_pred, coalesce(n_pos, 0) AS n_pos, coalesce(tp, 0) AS tp
  FROM (SELECT DISTINCT {keys} FROM cells) CROSS JOIN runs CROSS JOIN settings
  LEFT JOIN (SELECT run, {keys}, count(DISTINCT pmid) AS n_pred FROM pred GROUP BY ALL) USING (run, {using})
  LEFT JOIN (SELECT setting, {keys}, count(DISTINCT pmid) AS n_pos FROM pos GROUP BY ALL) USING (setting, {using})
  LEFT JOIN (SELECT run, setting, {keys}, count(*) AS tp FROM (SELECT DISTINCT run, {keys}, pmid FROM pred) JOIN (SELECT DISTINCT setting, {keys}, pmid FROM pos) USING ({using}, pmid) GROUP BY ALL) USING (run, setting, {using})
  ) WHERE n_pos > 0 OR ({zero} AND n_pred > 0))"""


S_MACRO = """macro AS (SELECT run, setting, class, coalesce(avg(P), 0) AS P, coalesce(avg(R), 0) AS R, coalesce(avg(F1), 0) AS F1
  FROM runs CROSS JOIN settings CROSS JOIN (VALUES ('support'), ('contradict')) c(class) LEFT JOIN prf USING (run, setting, class) GROUP BY ALL)"""
S_ALL = f"WITH {S_POS}, {S_PRED}, {s_prf('qa_id, sentence_id, class', True)}"
S_STANCE = """st AS (SELECT (l_partkey % 500)::VARCHAR AS qa_id, l_linenumber AS sentence_id, l_suppkey::VARCHAR AS pmid, l_discount * 10 AS ent, l_tax * 12.5 AS con, l_extendedprice AS bm, l_orderkey AS rk FROM lineitem)"""
S_UNIT = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0)"
S_REC = f"""rec AS (SELECT source AS qa_id, doc_id, backend, CASE quality WHEN 1 THEN 'Supports' ELSE 'Contradicts' END AS gold,
  CASE (CASE WHEN {S_UNIT.format("'p' || backend || '|' || doc_id")} < 0.2 THEN 1 - quality ELSE quality END) WHEN 1 THEN 'Supports' ELSE 'Contradicts' END AS pred,
  round({S_UNIT.format("backend || '|' || doc_id")}, 3) AS confidence, n_chars AS input_tokens, 30 AS output_tokens, CASE WHEN toxic = 1 THEN 'empty_abstract' END AS skip_reason
  FROM labels JOIN documents USING (doc_id), (VALUES ('openai-gpt-4o-mini'), ('hf-llama-3.3-70b')) b(backend))"""

# ---- text -------------------------------------------------------------------


@query("sentence_split", f"WITH {S_SENT} SELECT qa_id, sentence_id, sentence_text FROM sent")
def _(s, d):
    return B.sentences(s, d)


@query("term_vectors", f"WITH {S_POST} SELECT pmid, term, tf, dl FROM post")
def _(s, d):
    return RT.postings(B.corpus(s, d)).withColumn("dl", F.col("dl").cast("long"))


@query("cue_filter", r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)\bwas the\b|\bthat was\b|\bit is\b')")
def _(s, d):
    return B.table(s, d, "conversations").filter(T.cue_match(F.col("text"), DATA_CUES)).select("conv_id", "turn")


@query("cue_filter_counts", r"SELECT count(*) FILTER (k)::BIGINT AS kept, count(*) FILTER (NOT k)::BIGINT AS dropped, count(*)::BIGINT AS total FROM (SELECT regexp_matches(text, '(?i)\bwas the\b|\bthat was\b|\bit is\b') AS k FROM documents)")
def _(s, d):
    return RP.filter_counts(B.table(s, d, "documents"), T.cue_match(F.col("text"), DATA_CUES))


@query("audit_sample", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)\bwas the\b|\bthat was\b|\bit is\b') ORDER BY md5('audit|' || doc_id), doc_id LIMIT 50")
def _(s, d):
    return RP.audit_sample(B.table(s, d, "documents").filter(~T.cue_match(F.col("text"), DATA_CUES)), "doc_id").select("doc_id")


@query("truncate_tokens", r"""SELECT doc_id, CASE WHEN len(w) <= 30 THEN t ELSE array_to_string(w[1:30], ' ') END AS head FROM (
  SELECT doc_id, t, regexp_split_to_array(t, '\s+') AS w FROM (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM documents))""")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", T.truncate_tokens(F.col("text"), 30).alias("head"))


@query("fold_assign", "SELECT c_name AS qa_id, (('0x' || substr(sha1(c_name), 1, 16))::UBIGINT % 5)::INT AS fold FROM customer")
def _(s, d):
    return B.table(s, d, "customer").select(F.col("c_name").alias("qa_id"), T.fold_of(F.col("c_name"), 5).alias("fold"))


S_REPLY = r"""reply AS (SELECT event_id, CASE event_id % 8
  WHEN 0 THEN '{"label": "Supports", "confidence": ' || '0.' || lpad((event_id % 100)::VARCHAR, 2, '0') || '}' WHEN 1 THEN 'Answer: {"label": "contradicts.", "confidence": "0.25"} done' WHEN 2 THEN '{"confidence": ' || '0.' || lpad((event_id % 100)::VARCHAR, 2, '0') || '}'
  WHEN 3 THEN 'I think it ' || event_type WHEN 4 THEN '{"label": "Not relevant", "confidence": ' || (1 + event_id) || '}' WHEN 5 THEN '{"label": "Supp' WHEN 6 THEN '{"label": "' || event_type || '", "confidence": -1}'
  ELSE '{"label": "neutral", "confidence": "high"}' END AS reply FROM events)"""


@query("json_label_parse", f"""WITH {S_REPLY}, j AS (SELECT event_id, CASE WHEN json_valid(regexp_extract(reply, '(?s)\\{{.*\\}}')) THEN regexp_extract(reply, '(?s)\\{{.*\\}}') END AS doc FROM reply),
f AS (SELECT event_id, doc, lower(trim(json_extract_string(doc, '$.label'), ' .')) AS l, try_cast(json_extract_string(doc, '$.confidence') AS DOUBLE) AS c FROM j)
SELECT event_id, CASE WHEN l LIKE 'supports%' THEN 'Supports' WHEN l LIKE 'contradicts%' THEN 'Contradicts' WHEN l LIKE 'not%' THEN 'Not relevant' ELSE 'Neutral' END AS label, CASE WHEN doc IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce(c, 0.0))) END::DOUBLE AS confidence FROM f""")
def _(s, d):
    e, n, v = B.table(s, d, "events"), F.col("event_id") % 8, F.concat(F.lit("0."), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    reply = F.when(n == 0, F.concat(F.lit('{"label": "Supports", "confidence": '), v, F.lit("}"))).when(n == 1, F.lit('Answer: {"label": "contradicts.", "confidence": "0.25"} done')).when(n == 2, F.concat(F.lit('{"confidence": '), v, F.lit("}")))
    reply = reply.when(n == 3, F.concat(F.lit("I think it "), "event_type")).when(n == 4, F.concat(F.lit('{"label": "Not relevant", "confidence": '), (1 + F.col("event_id")).cast("string"), F.lit("}"))).when(n == 5, F.lit('{"label": "Supp'))
    reply = reply.when(n == 6, F.concat(F.lit('{"label": "'), "event_type", F.lit('", "confidence": -1}'))).otherwise(F.lit('{"label": "neutral", "confidence": "high"}'))
    p = T.parse_judgement(reply)
    return e.select("event_id", p["label"].alias("label"), p["confidence"].alias("confidence"))


@query("prompt_keys", "SELECT item_id, sha1(encode(text) || '\\x00'::BLOB || encode(text)) AS prompt_key FROM benchmark")
def _(s, d):
    return B.table(s, d, "benchmark").select("item_id", T.prompt_key(F.col("text"), F.col("text")).alias("prompt_key"))


@query("l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS s FROM embeddings")
def _(s, d):
    v = B.table(s, d, "embeddings").select("vec_id", T.l2_normalise(F.col("embedding")).alias("u"))
    return rounded(v.select("vec_id", F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("s")))


@query("html_ingest", r"""SELECT page_id, title, len(ps)::INT AS n_paragraphs, coalesce(list_sum(list_transform(ps, lambda x: length(x))), 0)::INT AS chars FROM (
  SELECT page_id, strip(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: strip(x)) AS ps FROM pages)""".replace("strip(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))", "X").replace("strip(x)", "Y").replace("X", "trim(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&'))").replace("Y", "trim(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&'))"))
def _(s, d):
    return AR.html_paragraphs(B.table(s, d, "pages"))


@query("pubdate_normalise", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN y || '-' || m WHEN 1 THEN y ELSE substr(y || ' Spring', 1, 7) END AS pubdate FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m FROM orders)")
def _(s, d):
    o = B.table(s, d, "orders")
    y, m, k = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MMM"), F.col("o_orderkey") % 3
    return o.select("o_orderkey", T.pubdate(F.when(k < 2, y), F.when(k == 0, m), F.concat(y, F.lit(" Spring"))).alias("pubdate"))


@query("collection", "SELECT doc_id::VARCHAR AS id, md5(trim(source || ' ' || text)) AS h FROM documents")
def _(s, d):
    a = B.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.col("source").alias("title"), F.col("text").alias("abstract"))
    return AR.to_collection(a).select("id", F.md5("contents").alias("h"))


# ---- retrieval --------------------------------------------------------------
S_STATS = "stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"


def s_bm25(name: str, weights: str, by: str, k: int) -> str:
    return f"""{name}s AS (SELECT {by}, pmid, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) AS bm25_score
  FROM {weights} JOIN dfs USING (term) JOIN post USING (term), stats GROUP BY {by}, pmid),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(bm25_score, 9) DESC, pmid) AS rank FROM {name}s QUALIFY rank <= {k})"""


S_Q = "qt AS (SELECT qa_id, term, count(*)::DOUBLE AS weight FROM (SELECT item_id::VARCHAR AS qa_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)"
S_BASE = f"WITH {S_POST}, {S_STATS}, {S_Q}"
OUT_BM = "SELECT qa_id, pmid, rank::INT AS rank, round(bm25_score, 6) AS bm25_score FROM "


def _qt(s, d):
    return RT.query_terms(B.queries(s, d), TOPIC)


@query("bm25_topk", f"{S_BASE}, {s_bm25('hit', 'qt', 'qa_id', 100)} {OUT_BM} hit")
def _(s, d):
    return rounded(RT.bm25(_qt(s, d), B.corpus(s, d), TOPIC, 100))


@query("bm25_by_sentence", f"""WITH {S_POST}, {S_STATS}, {S_SENT}, st AS (SELECT qa_id, sentence_id, term, count(*)::DOUBLE AS weight FROM (SELECT qa_id, sentence_id, unnest(regexp_extract_all(lower(sentence_text), '[a-z0-9]+')) AS term FROM sent) GROUP BY ALL),
{s_bm25('hit', 'st', 'qa_id, sentence_id', 10)} SELECT qa_id, sentence_id, pmid, rank::INT AS rank, round(bm25_score, 6) AS bm25_score FROM hit""")
def _(s, d):
    by = ["qa_id", "sentence_id"]
    return rounded(RT.bm25(RT.query_terms(B.sentences(s, d), by, "sentence_text"), B.corpus(s, d), by, 10))


S_RM1 = """fbs AS (SELECT qa_id, term, sum(tf / dl) / any_value(nd) AS w FROM {0} JOIN (SELECT qa_id, count(DISTINCT pmid) AS nd FROM {0} GROUP BY 1) USING (qa_id) JOIN post USING (pmid) GROUP BY qa_id, term),
fb AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY round(w, 9) DESC, term) AS term_rank FROM fbs {1} QUALIFY term_rank <= 10)"""


@query("rm1_terms", f"WITH {S_POST}, {S_REL}, {S_RM1.format('rel', '')} SELECT qa_id, term, round(w, 6) AS w, term_rank::INT AS term_rank FROM fb")
def _(s, d):
    rel = B.relevant(s, d)
    return rounded(RT.rm1_terms(rel, RT.vectors_of(rel, B.corpus(s, d)), TOPIC))


@query("rm3_expanded_topk", f"""{S_BASE}, {s_bm25('first', 'qt', 'qa_id', 10)}, {S_RM1.format('first', '')},
mix AS (SELECT qa_id, term, sum(weight) AS weight FROM (SELECT qa_id, term, 0.5 * weight / sum(weight) OVER (PARTITION BY qa_id) AS weight FROM qt UNION ALL SELECT qa_id, term, 0.5 * w / sum(w) OVER (PARTITION BY qa_id) FROM fb) GROUP BY ALL),
{s_bm25('hit', 'mix', 'qa_id', 50)} {OUT_BM} hit""")
def _(s, d):
    return rounded(RT.rm3(_qt(s, d), B.corpus(s, d), TOPIC, 50))


@query("prf_filtered_topk", f"""{S_BASE}, {S_REL},
{s_bm25('first', 'qt', 'qa_id', 30)}, acc AS (SELECT qa_id, pmid FROM first SEMI JOIN rel USING (qa_id, pmid)),
own AS (SELECT DISTINCT item_id::VARCHAR AS qa_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM benchmark), {S_RM1.format('acc', 'ANTI JOIN own USING (qa_id, term)')},
grown AS (SELECT qa_id, term, sum(weight) AS weight FROM (SELECT * FROM qt SEMI JOIN first USING (qa_id) UNION ALL SELECT qa_id, term, 1.0 FROM fb) GROUP BY ALL),
{s_bm25('hit', 'grown', 'qa_id', 50)} {OUT_BM} hit""")
def _(s, d):
    return rounded(RT.filtered_feedback(B.queries(s, d), B.relevant(s, d), B.corpus(s, d), TOPIC, 50))


def _variants(s, d):
    q = B.queries(s, d)
    return q.select("qa_id", F.posexplode(F.array("query", F.substring("query", 1, 80), F.substring("query", 40, 80))).alias("variant", "query"))


@query("rewrite_fusion", f"""WITH {S_POST}, {S_STATS}, v AS (SELECT item_id::VARCHAR AS qa_id, unnest([0, 1, 2]) AS variant, unnest([text, substr(text, 1, 80), substr(text, 40, 80)]) AS query FROM benchmark),
vt AS (SELECT qa_id, variant, term, count(*)::DOUBLE AS weight FROM (SELECT qa_id, variant, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM v) GROUP BY ALL), {s_bm25('hit', 'vt', 'qa_id, variant', 30)},
f AS (SELECT qa_id, pmid, sum(1.0 / (60 + rank)) AS rrf_score FROM hit GROUP BY ALL)
SELECT qa_id, pmid, round(rrf_score, 6) AS rrf_score, row_number() OVER (PARTITION BY qa_id ORDER BY round(rrf_score, 9) DESC, pmid)::INT AS rank FROM f QUALIFY rank <= 30""")
def _(s, d):
    return rounded(RT.rewrite_fusion(_variants(s, d), B.corpus(s, d), TOPIC, 30).drop("query"))


S_VEC = """vec AS (SELECT vec_id::VARCHAR AS pmid, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v, vec_id FROM embeddings),
dense AS (SELECT q.pmid AS qa_id, d.pmid, list_dot_product(q.v, d.v) AS score, row_number() OVER (PARTITION BY q.pmid ORDER BY round(list_dot_product(q.v, d.v), 9) DESC, d.pmid) AS rank FROM vec q, vec d WHERE q.vec_id % 20 = 0 QUALIFY rank <= 25)"""


def _dense(s, d):
    v = B.vectors(s, d)
    return RT.dense_topk(v.filter("cast(pmid as long) % 20 = 0").withColumnRenamed("pmid", "qa_id"), v, TOPIC, 25)


@query("dense_topk", f"WITH {S_VEC} SELECT qa_id, pmid, round(score, 6) AS score, rank::INT AS rank FROM dense")
def _(s, d):
    return rounded(_dense(s, d))


@query("hybrid_rrf", f"""{S_BASE}, {S_VEC}, {s_bm25('hit', 'qt', 'qa_id', 25)}, f AS (SELECT qa_id, pmid, sum(1.0 / (60 + rank)) AS rrf_score FROM (SELECT qa_id, pmid, rank FROM hit UNION ALL SELECT qa_id, pmid, rank FROM dense) GROUP BY ALL)
SELECT qa_id, pmid, round(rrf_score, 6) AS rrf_score, row_number() OVER (PARTITION BY qa_id ORDER BY round(rrf_score, 9) DESC, pmid)::INT AS rank FROM f QUALIFY rank <= 25""")
def _(s, d):
    return rounded(RT.hybrid(RT.bm25(_qt(s, d), B.corpus(s, d), TOPIC, 25), _dense(s, d), TOPIC, 25))


@query("rrf_fuse", """WITH r AS (SELECT l_orderkey AS qa_id, l_partkey AS pmid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank FROM lineitem UNION ALL
  SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) FROM lineitem), f AS (SELECT qa_id, pmid, sum(1.0 / (60 + rank)) AS rrf_score FROM r GROUP BY ALL)
SELECT qa_id, pmid, round(rrf_score, 6) AS rrf_score, row_number() OVER (PARTITION BY qa_id ORDER BY round(rrf_score, 9) DESC, pmid)::INT AS rank FROM f QUALIFY rank <= 5""")
def _(s, d):
    li = B.table(s, d, "lineitem").withColumnsRenamed({"l_orderkey": "qa_id", "l_partkey": "pmid"})
    one, two = (EV.cell_ranks(li, TOPIC, [F.desc(c), "pmid", "l_linenumber"]).select("qa_id", "pmid", "rank") for c in ("l_extendedprice", "l_quantity"))
    return rounded(RT.rrf(one.unionByName(two), TOPIC, top=5))


@query("rerank_topk", f"WITH {S_STANCE} SELECT qa_id, sentence_id, pmid, rk, round(ent, 6) AS ce_score, row_number() OVER (PARTITION BY qa_id, sentence_id ORDER BY round(ent, 9) DESC, rk, pmid)::INT AS rank_after_rerank FROM st QUALIFY rank_after_rerank <= 3")
def _(s, d):
    st = B.stance(s, d).select("qa_id", "sentence_id", "pmid", F.col("bm25_rank").alias("rk"), F.col("entailment_prob").alias("ce_score"))
    return rounded(RT.rerank_topk(st, ["qa_id", "sentence_id"], 3, ["rk", "pmid"]))


@query("passthrough_rerank", f"{S_BASE}, {s_bm25('hit', 'qt', 'qa_id', 100)} SELECT qa_id, pmid, rank::INT AS rank, round(bm25_score, 6) AS bm25_score, round(bm25_score, 6) AS ce_score, rank::INT AS rank_after_rerank FROM hit WHERE rank <= 30")
def _(s, d):
    return rounded(RT.passthrough_rerank(RT.bm25(_qt(s, d), B.corpus(s, d), TOPIC, 100), TOPIC, 30))


@query("top_n_docs", f"WITH {S_POST} SELECT pmid, sum(tf)::BIGINT AS score FROM post GROUP BY pmid ORDER BY score DESC, pmid LIMIT 100")
def _(s, d):
    return RT.top_n_docs(RT.postings(B.corpus(s, d)), 100)


# ---- contradiction path and selection ---------------------------------------


@query("pair_join", f"WITH {S_SENT}, {S_QREL} SELECT q.qa_id, q.sentence_id, q.pmid, sentence_text FROM qrels q LEFT JOIN sent s ON q.qa_id = s.qa_id AND q.sentence_id = s.sentence_id")
def _(s, d):
    return B.qrels(s, d).select("qa_id", "sentence_id", "pmid").join(B.sentences(s, d).dropDuplicates(["qa_id", "sentence_id"]), ["qa_id", "sentence_id"], "left")


@query("max_pool", f"WITH {S_STANCE} SELECT qa_id, sentence_id, pmid, round(max(con), 6) AS contradict_score, min(rk) AS bm25_rank, round(max(bm), 6) AS bm25_score FROM st GROUP BY ALL")
def _(s, d):
    return rounded(RT.max_pool(B.stance(s, d).withColumnRenamed("contradict_score", "contradiction_prob"), ["qa_id", "sentence_id", "pmid"]))


@query("threshold_candidates", f"WITH {S_STANCE} SELECT qa_id, sentence_id, pmid, rk FROM st WHERE ent >= 0.5")
def _(s, d):
    return B.stance(s, d).filter("entailment_prob >= 0.5").select("qa_id", "sentence_id", "pmid", F.col("bm25_rank").alias("rk"))


def s_greedy(existing: bool) -> str:
    drop = "ANTI JOIN ex USING (qa_id, sentence_id, pmid)" if existing else ""
    return f"""WITH RECURSIVE {S_STANCE}, ex AS (SELECT DISTINCT qa_id, sentence_id, pmid FROM st WHERE rk % 17 = 0),
pool AS (SELECT qa_id, sentence_id, c, pmid, min(ord) AS ord FROM (SELECT qa_id, sentence_id, 0 AS c, pmid, -round(ent, 9) AS ord FROM st WHERE ent >= 0.5 UNION ALL SELECT qa_id, sentence_id, 1, pmid, rk FROM st WHERE con >= 0.5) {drop} GROUP BY ALL),
seq AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY sentence_id, c, ord, pmid) AS i FROM pool),
go AS (
  SELECT qa_id, i, sentence_id, c, pmid, true AS take, 1 AS n, [pmid] AS used FROM seq WHERE i = 1
  UNION ALL
  SELECT qa_id, i, sentence_id, c, pmid, take, n0 + take::INT, CASE WHEN take THEN list_append(used, pmid) ELSE used END FROM (
    SELECT s.*, g.used, CASE WHEN s.sentence_id = g.sentence_id AND s.c = g.c THEN g.n ELSE 0 END AS n0,
      (CASE WHEN s.sentence_id = g.sentence_id AND s.c = g.c THEN g.n ELSE 0 END) < 3 AND NOT list_contains(g.used, s.pmid) AS take
    FROM go g JOIN seq s ON s.qa_id = g.qa_id AND s.i = g.i + 1))
SELECT qa_id, sentence_id, CASE c WHEN 0 THEN 'support' ELSE 'contradict' END AS class, row_number() OVER (PARTITION BY qa_id, sentence_id, c ORDER BY i)::INT AS pos, pmid FROM go WHERE take"""


def _select(s, d, existing: bool = True):
    st = B.stance(s, d)
    ex = st.filter("bm25_rank % 17 = 0") if existing else None
    return SE.greedy_select(st, st, ex)


@query("greedy_select", s_greedy(True))
def _(s, d):
    return _select(s, d)


@query("greedy_select_allow_existing", s_greedy(False))
def _(s, d):
    return _select(s, d, False)


@query("validate_violations", f"""WITH {S_STANCE}, p AS (SELECT qa_id, sentence_id, CASE WHEN ent >= 0.5 THEN 'support' ELSE 'contradict' END AS class, pmid FROM st),
n AS (SELECT qa_id, sentence_id, class, pmid, count(*) AS n FROM p GROUP BY ALL)
SELECT qa_id, sentence_id, class, NULL AS pmid, 'over_cap' AS rule FROM n GROUP BY ALL HAVING sum(n) > 3 UNION ALL SELECT qa_id, sentence_id, class, pmid, 'duplicate' FROM n WHERE n > 1
UNION ALL SELECT qa_id, sentence_id, class, pmid, 'reused' FROM n WHERE (qa_id, pmid) IN (SELECT (qa_id, pmid) FROM n GROUP BY qa_id, pmid HAVING count(*) > 1)
UNION ALL SELECT qa_id, sentence_id, class, pmid, 'not_in_corpus' FROM n WHERE pmid NOT IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 10 <> 0)
UNION ALL SELECT qa_id, sentence_id, class, pmid, 'existing' FROM n SEMI JOIN (SELECT DISTINCT qa_id, sentence_id, pmid FROM st WHERE rk % 17 = 0) USING (qa_id, sentence_id, pmid)""")
def _(s, d):
    st = B.stance(s, d)
    picks = st.withColumn("class", F.when(F.col("entailment_prob") >= 0.5, "support").otherwise("contradict"))
    corpus = B.table(s, d, "supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").cast("string").alias("pmid"))
    return SE.violations(picks, corpus, st.filter("bm25_rank % 17 = 0"))


@query("order_violations", "SELECT qa_id, pos, sentence_id FROM (SELECT conv_id AS qa_id, turn AS pos, length(text) AS sentence_id, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS b FROM conversations) WHERE b >= sentence_id")
def _(s, d):
    c = B.table(s, d, "conversations").select(F.col("conv_id").alias("qa_id"), F.struct("turn", F.length("text")).alias("pos"), F.length("text").cast("long").alias("sentence_id"))
    return SE.order_violations(c).withColumn("pos", F.col("pos.turn"))


@query("submission_write", f"""WITH g AS (SELECT * FROM ({s_greedy(True)})), {S_STANCE} SELECT qa_id, count(*)::BIGINT AS n_sentences, sum(n)::BIGINT AS n_ids FROM (
  SELECT s.qa_id, s.sentence_id, (SELECT count(*) FROM g WHERE g.qa_id = s.qa_id AND g.sentence_id = s.sentence_id) AS n FROM (SELECT DISTINCT qa_id, sentence_id FROM st) s WHERE s.qa_id IN (SELECT qa_id FROM g)) GROUP BY qa_id""")
def _(s, d):
    st = B.stance(s, d)
    sents = st.select("qa_id", "sentence_id").distinct().select("qa_id", F.lit("q").alias("question"), "sentence_id", F.lit("t").alias("sentence_text"), F.array(F.lit("7"), F.lit("x")).alias("existing"))
    out = JU.official_submission(sents, _select(s, d))
    n = F.aggregate("answer", F.lit(0), lambda a, x: a + F.size(x["supported_citations"]) + F.size(x["contradicted_citations"]))
    return out.select("meta_data.qa_id", F.size("answer").cast("long").alias("n_sentences"), n.cast("long").alias("n_ids"))


# ---- evaluation -------------------------------------------------------------


RUNS = ["a", "b"]


def _prf(s, d, deal=None):
    return EV.prf_cells(B.cells(s, d, repeated=True), B.predictions(s, d), EV.marked(B.qrels(s, d)), CELL, run=["run"], names=[(r,) for r in RUNS], deal=deal)


def _topics(s, d):
    return EV.per_topic(_prf(s, d, TOPIC), ["run"])


def _runs(s):
    return s.createDataFrame([(r,) for r in RUNS], "run string")


def _macro(s, d, level="sentence"):
    return EV.evaluate(B.cells(s, d, repeated=True), B.predictions(s, d), B.qrels(s, d), level, run=["run"], runs=_runs(s))


@query("qrels_strict_relaxed", f"WITH {S_POS} SELECT setting, class, count(*) AS n, count(*) FILTER (source = 'human') AS human FROM pos GROUP BY ALL")
def _(s, d):
    return EV.positives(B.qrels(s, d)).groupBy("setting", "class").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "human").alias("human"))


@query("positives_by_source", f"WITH {S_POS} SELECT setting, qa_id, sentence_id, class, pmid FROM pos WHERE source = 'human'")
def _(s, d):
    return EV.positives(B.qrels(s, d), "human").drop("source")


@query("prf_cells", f"{S_ALL} SELECT run, setting, qa_id, sentence_id, class, n_pred, n_pos, tp, round(P, 6) AS P, round(R, 6) AS R, round(F1, 6) AS F1 FROM prf")
def _(s, d):
    return rounded(_prf(s, d))


@query("macro_sentence", f"{S_ALL}, {S_MACRO} SELECT run, setting, class, round(P, 6) AS P, round(R, 6) AS R, round(F1, 6) AS F1 FROM macro")
def _(s, d):
    return rounded(_macro(s, d))


@query("macro_question", f"WITH {S_POS}, {S_PRED}, {s_prf('qa_id, class', False)}, {S_MACRO} SELECT run, setting, class, round(P, 6) AS P, round(R, 6) AS R, round(F1, 6) AS F1 FROM macro")
def _(s, d):
    return rounded(_macro(s, d, "question"))


S_TOPIC = """topics AS (SELECT run, qa_id, setting, class, coalesce(avg(P), 0) AS P, coalesce(avg(R), 0) AS R, coalesce(avg(F1), 0) AS F1, count(prf.tp) AS n_cells
  FROM (SELECT DISTINCT run, qa_id FROM prf) CROSS JOIN settings CROSS JOIN (VALUES ('support'), ('contradict')) c(class) LEFT JOIN prf USING (run, qa_id, setting, class) GROUP BY ALL),
delta AS (SELECT a.qa_id, a.F1 - b.F1 AS delta FROM topics a JOIN topics b USING (qa_id, setting, class) WHERE a.run = 'a' AND b.run = 'b' AND setting = 'strict' AND class = 'support')"""


@query("per_topic_f1", f"{S_ALL}, {S_TOPIC} SELECT run, qa_id, setting, class, round(P, 6) AS P, round(R, 6) AS R, round(F1, 6) AS F1, n_cells FROM topics")
def _(s, d):
    return rounded(_topics(s, d))


def _delta(s, d):
    return EV.run_delta(_topics(s, d), *RUNS)


@query("topic_delta", f"{S_ALL}, {S_TOPIC} SELECT qa_id, round(delta, 6) AS delta FROM delta")
def _(s, d):
    return rounded(_delta(s, d))


@query("select_three", f"""{S_ALL}, {S_TOPIC}, dd AS (SELECT qa_id, round(delta, 9) AS d, qa_id::BIGINT AS n FROM delta), p AS (SELECT qa_id FROM dd ORDER BY d DESC, n LIMIT 1), m AS (SELECT qa_id FROM dd ORDER BY d, n LIMIT 1)
SELECT (SELECT qa_id FROM p) AS positive, (SELECT qa_id FROM dd WHERE qa_id NOT IN (SELECT * FROM p) AND qa_id NOT IN (SELECT * FROM m) ORDER BY abs(d), n LIMIT 1) AS neutral, (SELECT qa_id FROM m) AS negative""")
def _(s, d):
    return EV.select_three(_delta(s, d))


@query("by_topic_matrix", f"{S_ALL}, {S_TOPIC} SELECT qa_id, round(max(F1) FILTER (run = 'a') * 100, 4) AS a, round(max(F1) FILTER (run = 'b') * 100, 4) AS b FROM topics WHERE setting = 'strict' AND class = 'support' GROUP BY qa_id")
def _(s, d):
    return EV.by_topic_matrix(_topics(s, d), RUNS)


@query("leaderboard", f"{S_ALL}, {S_MACRO} SELECT run, round(s, 4) AS support, round(c, 4) AS contradict, s >= 60 AND c >= 10 AS passed FROM (SELECT run, max(F1) FILTER (class = 'support') * 100 AS s, max(F1) FILTER (class = 'contradict') * 100 AS c FROM macro WHERE setting = 'strict' GROUP BY run)")
def _(s, d):
    return EV.leaderboard(_macro(s, d))


@query("baseline_gate", f"{S_ALL}, {S_MACRO} SELECT run, abs(s - 44.34) <= 2 AND abs(c - 4.67) <= 2 AS within FROM (SELECT run, max(F1) FILTER (class = 'support') * 100 AS s, max(F1) FILTER (class = 'contradict') * 100 AS c FROM macro WHERE setting = 'strict' GROUP BY run)")
def _(s, d):
    return EV.baseline_gate(_macro(s, d))


@query("run_diff", f"""WITH {S_QREL}, {S_PRED}, u AS (SELECT qa_id, sentence_id, class, pmid, bool_or(run = 'a') AS a, bool_or(run = 'b') AS b FROM pred GROUP BY ALL HAVING a <> b),
j AS (SELECT qa_id, sentence_id, pmid, replace(class, 'partial_', '') AS base, arg_max({{'class': class, 'source': source, 'confidence': confidence}}, (CASE WHEN class IN ('support', 'contradict') THEN 1 ELSE 0 END, ord)) AS j FROM qrels GROUP BY ALL)
SELECT u.qa_id, u.sentence_id, u.class, u.pmid, CASE WHEN a THEN 'a' ELSE 'b' END AS side, CASE WHEN j IS NULL THEN '<unjudged>' WHEN j['class'] = u.class THEN u.class ELSE u.class || ' (relaxed)' END AS judgement, j['source'] AS source, j['confidence'] AS confidence
FROM u LEFT JOIN j ON u.qa_id = j.qa_id AND u.sentence_id = j.sentence_id AND u.pmid = j.pmid AND u.class = j.base""")
def _(s, d):
    return EV.run_diff(B.predictions(s, d), B.qrels(s, d), "a", "b")


# ---- pools ------------------------------------------------------------------


@query("novel_triples", f"WITH {S_QREL}, {S_PRED} SELECT DISTINCT qa_id, sentence_id, pmid FROM pred WHERE run = 'a' AND (qa_id, sentence_id, pmid) NOT IN (SELECT (qa_id, sentence_id, pmid) FROM qrels WHERE source = 'human')")
def _(s, d):
    return PO.novel_triples(B.predictions(s, d).filter("run = 'a'"), B.qrels(s, d).filter("source = 'human'"))


@query("candidate_triples", f"""WITH {S_QREL}, r AS (SELECT l_orderkey::VARCHAR AS qa_id, l_linenumber AS sentence_id, l_partkey::VARCHAR AS pmid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS k2 FROM lineitem)
SELECT DISTINCT qa_id, sentence_id, pmid FROM r WHERE (k <= 2 OR k2 <= 2) AND (qa_id, sentence_id, pmid) NOT IN (SELECT (qa_id, sentence_id, pmid) FROM qrels WHERE source = 'human')""")
def _(s, d):
    li = B.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("qa_id"), F.col("l_linenumber").alias("sentence_id"), F.col("l_partkey").cast("string").alias("pmid"), "l_partkey", "l_extendedprice", "l_quantity")
    a = EV.cell_ranks(li, TOPIC, [F.desc("l_extendedprice"), "l_partkey"])
    b = EV.cell_ranks(li, TOPIC, [F.desc("l_quantity"), "l_partkey", "sentence_id"])
    return PO.candidate_triples([a, b], B.qrels(s, d).filter("source = 'human'"), 2)


def _judged(s, d):
    q = B.qrels(s, d).filter("source = 'llm'")
    lab = F.when(F.col("confidence") < 0.02, "Neutral").otherwise(T.class_to_label(F.col("class")))
    return q.select("qa_id", "sentence_id", "pmid", lab.alias("label"), F.lit("hf-qwen-2.5-72b").alias("backend"), "confidence")


@query("expanded_pool", f"""WITH {S_QREL} SELECT qa_id, sentence_id, pmid, class, relevance, source, confidence FROM qrels WHERE source = 'human' UNION ALL
SELECT qa_id, sentence_id, pmid, CASE class WHEN 'contradict' THEN 'contradict' ELSE 'support' END, 1, 'hf-qwen-2.5-72b', round(confidence, 4) FROM qrels WHERE source = 'llm' AND confidence >= 0.02""")
def _(s, d):
    return PO.expanded_pool(B.qrels(s, d).filter("source = 'human'"), _judged(s, d))


S_INP = S_QREL + """, i0 AS (SELECT qa_id, sentence_id, pmid, class, relevance, source FROM qrels WHERE confidence <= 0.08), i1 AS (SELECT qa_id, sentence_id, pmid, class, relevance, source FROM qrels WHERE confidence >= 0.02), i2 AS (SELECT qa_id, sentence_id, pmid, class, relevance, source FROM qrels WHERE confidence >= 0.04),
c0 AS (SELECT DISTINCT qa_id, sentence_id, pmid, class FROM i0 WHERE source <> 'human' AND class = 'contradict'), c1 AS (SELECT DISTINCT qa_id, sentence_id, pmid, class FROM i1 WHERE source <> 'human' AND class = 'contradict'), c2 AS (SELECT DISTINCT qa_id, sentence_id, pmid, class FROM i2 WHERE source <> 'human' AND class = 'contradict'),
pool AS (SELECT * FROM i0 WHERE source = 'human' UNION ALL SELECT * FROM i0 WHERE source <> 'human' AND class IN ('support', 'partial_support')
  UNION ALL SELECT qa_id, sentence_id, pmid, class, relevance, 'llm-intersection' FROM i0 SEMI JOIN c1 USING (qa_id, sentence_id, pmid, class) SEMI JOIN c2 USING (qa_id, sentence_id, pmid, class) WHERE source <> 'human')"""


def _inputs(s, d):
    q = B.qrels(s, d)
    cols = ["qa_id", "sentence_id", "pmid", "class", "relevance", "source"]
    return [q.filter("confidence <= 0.08").select(*cols), q.filter("confidence >= 0.02").select(*cols), q.filter("confidence >= 0.04").select(*cols)]


@query("intersection_pool", f"WITH {S_INP} SELECT * FROM pool")
def _(s, d):
    return PO.intersection_pool(_inputs(s, d))


@query("intersection_counts", f"""WITH {S_INP}, b AS (SELECT count(*) FILTER (source = 'human') AS human_before, count(*) FILTER (source <> 'human' AND class LIKE '%support') AS support_before, count(*) FILTER (source <> 'human' AND class = 'contradict') AS contradict_before FROM i0),
a AS (SELECT count(*) FILTER (source = 'human') AS human_after, count(*) FILTER (source <> 'human' AND class LIKE '%support') AS support_after, count(*) FILTER (source <> 'human' AND class = 'contradict') AS contradict_after FROM pool)
SELECT *, round(CASE WHEN contradict_before > 0 THEN 100.0 * (contradict_before - contradict_after) / contradict_before ELSE 0.0 END, 4)::DOUBLE AS dropped_pct FROM b, a""")
def _(s, d):
    i = _inputs(s, d)
    return PO.intersection_counts(i, PO.intersection_pool(i))


@query("pairwise_intersections", f"WITH {S_INP} SELECT 0 AS a, 1 AS b, (SELECT count(*) FROM c0 SEMI JOIN c1 USING (qa_id, sentence_id, pmid, class)) AS n UNION ALL SELECT 0, 2, (SELECT count(*) FROM c0 SEMI JOIN c2 USING (qa_id, sentence_id, pmid, class)) UNION ALL SELECT 1, 2, (SELECT count(*) FROM c1 SEMI JOIN c2 USING (qa_id, sentence_id, pmid, class))")
def _(s, d):
    return PO.pairwise_intersections(_inputs(s, d))


# ---- agreement and calibration ----------------------------------------------
S_SCORES = """sc AS (SELECT l.label, backend, count(*) FILTER (gold = l.label) AS support, count(*) FILTER (pred = l.label) AS predicted, count(*) FILTER (gold = l.label AND pred = l.label) AS tp FROM rec, (VALUES ('Supports'), ('Contradicts'), ('Neutral'), ('Not relevant')) l(label) GROUP BY ALL),
sf AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM sc)"""


@query("confusion", f"WITH {S_REC} SELECT gold, pred, count(*) AS n FROM rec GROUP BY ALL")
def _(s, d):
    return AG.confusion(B.records(s, d))


@query("label_scores", f"WITH {S_REC}, {S_SCORES} SELECT backend, label, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(f1, 6) AS f1, support FROM sf")
def _(s, d):
    return rounded(AG.label_scores(B.records(s, d), by=["backend"]))


@query("weighted_f1", f"WITH {S_REC}, {S_SCORES} SELECT backend, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM sf GROUP BY ALL")
def _(s, d):
    return rounded(AG.weighted_f1(AG.label_scores(B.records(s, d), by=["backend"]), ["backend"]))


@query("gate", f"WITH {S_REC}, {S_SCORES}, g AS (SELECT backend, sum(f1 * support) / sum(support) AS w, bool_and(support = 0 OR f1 >= 0.05) AS floors_met FROM sf GROUP BY ALL) SELECT backend, round(w, 6) AS weighted_f1, floors_met, w >= 0.85 AND floors_met AS passed FROM g")
def _(s, d):
    return rounded(AG.gate(AG.label_scores(B.records(s, d), by=["backend"]), by=["backend"]))


@query("cohens_kappa", f"""WITH {S_REC}, t AS (SELECT backend, count(*) AS n, count(*) FILTER (gold = pred) / count(*) AS po FROM rec GROUP BY ALL), e AS (SELECT backend, sum(a * b) AS e FROM (SELECT backend, gold AS l, count(*) AS a FROM rec GROUP BY ALL) JOIN (SELECT backend, pred AS l, count(*) AS b FROM rec GROUP BY ALL) USING (backend, l) GROUP BY ALL)
SELECT backend, n, round(po, 6) AS agreement, round(CASE WHEN e / (n * n) >= 1 THEN 1 ELSE (po - e / (n * n)) / (1 - e / (n * n)) END, 6) AS kappa FROM t JOIN e USING (backend)""")
def _(s, d):
    r = B.records(s, d).select("backend", F.col("gold").alias("a"), F.col("pred").alias("b"))
    return rounded(AG.cohens_kappa(r, ["backend"]))


@query("pairwise_agreement", f"""WITH {S_REC}, m AS (SELECT a.pred AS x, b.pred AS y FROM rec a JOIN rec b USING (doc_id) WHERE a.backend = 'hf-llama-3.3-70b' AND b.backend = 'openai-gpt-4o-mini'), t AS (SELECT count(*) AS n, count(*) FILTER (x = y) / count(*) AS po FROM m), e AS (SELECT sum(p * q) AS e FROM (SELECT x AS l, count(*) AS p FROM m GROUP BY x) JOIN (SELECT y AS l, count(*) AS q FROM m GROUP BY y) USING (l))
SELECT 'hf-llama-3.3-70b' AS a_rater, 'openai-gpt-4o-mini' AS b_rater, n, round(po, 6) AS agreement, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM t, e""")
def _(s, d):
    r = B.records(s, d).select("doc_id", F.col("backend").alias("rater"), F.col("pred").alias("label"), F.lit(0).alias("ord"))
    return rounded(AG.pairwise_agreement(r, ["doc_id"]))


@query("krippendorff_alpha", """WITH l AS (SELECT user_id AS unit, floor(value)::BIGINT % 4 AS label FROM events WHERE value IS NOT NULL), c AS (SELECT unit, label, count(*)::DOUBLE AS n FROM l GROUP BY ALL), u AS (SELECT unit, sum(n) AS m, sum(n * n) AS s FROM c GROUP BY ALL),
a AS (SELECT sum(m) AS n, sum((m * m - s) / (m - 1)) FILTER (m > 1) AS d FROM u), b AS (SELECT sum(x * x) AS cc FROM (SELECT sum(n) AS x FROM c GROUP BY label))
SELECT n::BIGINT AS n, round(1 - d / n / ((n * n - cc) / (n * (n - 1))), 6) AS alpha FROM a, b""")
def _(s, d):
    return rounded(AG.krippendorff_alpha(B.table(s, d, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("coder"), (F.floor("value") % 4).alias("label"))))


S_BINS = """bins AS (SELECT backend, bin, count(confidence) AS n, coalesce(avg(confidence), 0) AS mean_conf, coalesce(avg(CASE WHEN gold = pred THEN 1.0 WHEN gold IS NULL THEN NULL ELSE 0.0 END), 0) AS mean_correct FROM (SELECT DISTINCT backend FROM rec) b CROSS JOIN range(10) r(bin) LEFT JOIN (SELECT *, least(9, greatest(0, trunc(confidence * 10.0)))::BIGINT AS bin FROM rec) USING (backend, bin) GROUP BY ALL)"""


def _pairs(s, d):
    return B.records(s, d).withColumn("correct", F.when(F.col("gold") == F.col("pred"), 1).otherwise(0))


@query("reliability_bins", f"WITH {S_REC}, {S_BINS} SELECT backend, bin::INT AS bin, n, round(mean_conf, 6) AS mean_conf, round(mean_correct, 6) AS mean_correct FROM bins")
def _(s, d):
    return rounded(CA.reliability_bins(_pairs(s, d), by=["backend"]))


@query("ece", f"WITH {S_REC}, {S_BINS} SELECT backend, round(sum(n * abs(mean_conf - mean_correct)) / sum(n), 6) AS ece FROM bins GROUP BY ALL")
def _(s, d):
    return rounded(CA.ece(CA.reliability_bins(_pairs(s, d), by=["backend"]), ["backend"]))


def s_iso(rows: str, g: str) -> str:
    return f"""tied AS (SELECT {g}, confidence AS x, count(*) AS n, sum(correct) AS s FROM {rows} GROUP BY ALL),
pt AS (SELECT {g}, x, n, s, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM tied WINDOW w AS (PARTITION BY {g} ORDER BY x)),
up AS (SELECT {g}, p.i, max((p.cs - j.cs + j.s) / (p.cn - j.cn + j.n)) AS up FROM pt p JOIN pt j USING ({g}) WHERE j.i <= p.i GROUP BY ALL),
dn AS (SELECT {g}, p.i, min((k.cs - p.cs) / (k.cn - p.cn)) AS dn FROM pt p JOIN pt k USING ({g}) WHERE k.i > p.i GROUP BY ALL),
iso AS (SELECT {g}, x, (cs - coalesce(lag(cs) OVER w, 0)) / (cn - coalesce(lag(cn) OVER w, 0)) AS y FROM (SELECT pt.* FROM pt JOIN up USING ({g}, i) LEFT JOIN dn USING ({g}, i) WHERE dn IS NULL OR up <= dn) WINDOW w AS (PARTITION BY {g} ORDER BY i))"""


S_CAL = "cal AS (SELECT r.*, CASE WHEN lo IS NULL THEN hi.y WHEN hi IS NULL THEN lo.y ELSE lo.y + (hi.y - lo.y) * (confidence - lo.x) / (hi.x - lo.x) END AS calibrated FROM (SELECT r.*, (SELECT max({{'x': x, 'y': y}}) FROM iso WHERE iso.{1} = r.{1} AND x <= confidence) AS lo, (SELECT min({{'x': x, 'y': y}}) FROM iso WHERE iso.{1} = r.{1} AND x > confidence) AS hi FROM {0} r) r)"
S_RC = "rc AS (SELECT *, CASE WHEN gold = pred THEN 1 ELSE 0 END AS correct FROM rec)"


@query("isotonic_fit", f"WITH {S_REC}, {S_RC}, {s_iso('rc', 'backend')} SELECT backend, x, round(y, 6) AS y FROM iso")
def _(s, d):
    return rounded(CA.isotonic_fit(_pairs(s, d), ["backend"]))


@query("isotonic_apply", f"WITH {S_REC}, {S_RC}, {s_iso('rc', 'backend')}, {S_CAL.format('rc', 'backend')} SELECT backend, doc_id, round(calibrated, 6) AS calibrated FROM cal")
def _(s, d):
    p = _pairs(s, d)
    return rounded(CA.isotonic_apply(p, CA.isotonic_fit(p, ["backend"]), ["backend"]).select("backend", "doc_id", "calibrated"))


@query("kfold_ece", f"""WITH {S_REC}, one AS (SELECT (('0x' || substr(sha1(qa_id), 1, 16))::UBIGINT % 5)::INT AS fold, confidence, CASE WHEN gold = pred THEN 1 ELSE 0 END AS correct FROM rec WHERE backend = 'openai-gpt-4o-mini'),
tr AS (SELECT h.fold, o.confidence, o.correct FROM one o JOIN (SELECT DISTINCT fold FROM one) h ON h.fold <> o.fold), {s_iso('tr', 'fold')}, {S_CAL.format('one', 'fold')},
e AS (SELECT fold, sum(n) AS n, sum(n * abs(a - c)) / sum(n) AS raw FROM (SELECT fold, count(*) AS n, avg(confidence) AS a, avg(correct) AS c FROM one GROUP BY fold, least(9, trunc(confidence * 10.0))) GROUP BY fold),
f AS (SELECT fold, sum(n * abs(a - c)) / sum(n) AS cal FROM (SELECT fold, count(*) AS n, avg(calibrated) AS a, avg(correct) AS c FROM cal GROUP BY fold, least(9, trunc(calibrated * 10.0))) GROUP BY fold)
SELECT count(*) AS k, sum(n)::BIGINT AS n, round(avg(raw), 6) AS raw_mean, round(stddev_pop(raw), 6) AS raw_std, round(avg(cal), 6) AS cal_mean, round(stddev_pop(cal), 6) AS cal_std FROM e JOIN f USING (fold)""")
def _(s, d):
    return rounded(CA.kfold_ece(B.records(s, d).filter("backend = 'openai-gpt-4o-mini'")))


@query("calibration_summary", f"""WITH {S_REC}, {S_RC}, {S_BINS}, {s_iso('rc', 'backend')}, {S_CAL.format('rc', 'backend')},
f AS (SELECT backend, sum(n * abs(a - c)) / sum(n) AS cal FROM (SELECT backend, count(*) AS n, avg(calibrated) AS a, avg(correct) AS c FROM cal GROUP BY backend, least(9, trunc(calibrated * 10.0))) GROUP BY backend)
SELECT backend, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence, (SELECT round(sum(n * abs(mean_conf - mean_correct)) / sum(n), 6) FROM bins b WHERE b.backend = rc.backend) AS ece_raw, (SELECT round(cal, 6) FROM f WHERE f.backend = rc.backend) AS ece_in_sample FROM rc GROUP BY backend""")
def _(s, d):
    return rounded(CA.calibration_summary(_pairs(s, d).drop("qa_id")))


# ---- resampling -------------------------------------------------------------
S_HASH = "('0x' || substr(md5({0}), 1, 12))::BIGINT"
S_ONE = "one AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM rec WHERE backend = 'openai-gpt-4o-mini')"


def _one(s, d):
    return B.records(s, d).filter("backend = 'openai-gpt-4o-mini'")


@query("bootstrap_mean_ci", f"""WITH {S_REC}, {S_ONE}, dr AS (SELECT it, {S_HASH.format("'0|' || it || '|' || d")} % (SELECT count(*) FROM one) AS i FROM range(1000) a(it), range((SELECT count(*) FROM one)) b(d)),
m AS (SELECT it, avg(confidence) AS mean FROM dr JOIN one USING (i) GROUP BY it), v AS (SELECT list_sort(list(mean)) AS v FROM m) SELECT round(v[26], 6) AS lo, round(v[976], 6) AS hi FROM v""")
def _(s, d):
    return rounded(RS.percentile_ci(RS.bootstrap_mean(_one(s, d), "confidence", ["doc_id"]), "mean"))


@query("bootstrap_wf1_ci", f"""WITH {S_REC}, {S_ONE}, dr AS (SELECT it, {S_HASH.format("'0|' || it || '|' || d")} % (SELECT count(*) FROM one) AS i FROM range(1000) a(it), range((SELECT count(*) FROM one)) b(d)), sm AS (SELECT it, gold, pred FROM dr JOIN one USING (i)),
sc AS (SELECT it, l.label, count(*) FILTER (gold = l.label) AS support, count(*) FILTER (pred = l.label) AS predicted, count(*) FILTER (gold = l.label AND pred = l.label) AS tp FROM sm, (VALUES ('Supports'), ('Contradicts')) l(label) GROUP BY ALL),
m AS (SELECT it, sum(CASE WHEN tp > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END * support) / sum(support) AS w FROM sc GROUP BY it), v AS (SELECT list_sort(list(w)) AS v FROM m) SELECT round(v[26], 6) AS lo, round(v[976], 6) AS hi FROM v""")
def _(s, d):
    return rounded(RS.percentile_ci(RS.bootstrap_weighted_f1(_one(s, d), ["doc_id"]), "weighted_f1"))


@query("subsample", f"SELECT c_custkey FROM customer ORDER BY {S_HASH.format(chr(39) + '5|' + chr(39) + ' || c_custkey')}, c_custkey LIMIT (SELECT round_even(count(*) * 0.35, 0)::BIGINT FROM customer)")
def _(s, d):
    return RS.subsample(B.table(s, d, "customer"), 0.35, ["c_custkey"], 5).select("c_custkey")


@query("percentile_ci", "SELECT l_returnflag, round(v[greatest(0, trunc(0.025 * len(v)))::INT + 1], 6) AS lo, round(v[least(len(v) - 1, trunc(0.975 * len(v)))::INT + 1], 6) AS hi FROM (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)")
def _(s, d):
    return rounded(RS.percentile_ci(B.table(s, d, "lineitem"), "l_extendedprice", by=["l_returnflag"]))


def _curve(s, d):
    """Whole tables, all fractions and draws; too many rows for SQL, so the tests hold pool_coverage against a brute-force version."""
    pool = EV.positives(B.qrels(s, d)).filter("setting = 'relaxed'").select(*CELL, "pmid")
    cells, pred = B.cells(s, d), B.predictions(s, d)
    return RS.pool_coverage(cells, pred, pool, RS.FRACTIONS, RS.ITERATIONS, runs=["a", "b"])


@query("pool_coverage_curve")
def _(s, d):
    return rounded(_curve(s, d))


@query("pool_bias_delta")
def _(s, d):
    m = _curve(s, d).groupBy("run", "fraction", "class").agg(F.avg("f1").alias("mean"))
    return rounded(RS.bias_delta(m))


# ---- reports ----------------------------------------------------------------
S_BIAS = """jd AS (SELECT (l_partkey % 100)::VARCHAR AS qa_id, CASE WHEN l_returnflag = 'R' THEN 'contradict' ELSE 'support' END AS class, l_discount AS confidence, l_linestatus AS st FROM lineitem),
bias AS (SELECT qa_id, support, contradict, coalesce(human_support, 0) AS human_support, coalesce(human_contradict, 0) AS human_contradict, mean_conf, median_conf, min_conf, support / (contradict + 1) AS ratio FROM
 (SELECT qa_id, count(*) FILTER (class = 'support') AS support, count(*) FILTER (class = 'contradict') AS contradict, avg(confidence) AS mean_conf, median(confidence) AS median_conf, min(confidence) AS min_conf FROM jd WHERE st <> 'F' GROUP BY 1)
 LEFT JOIN (SELECT qa_id, count(*) FILTER (class = 'support') AS human_support, count(*) FILTER (class = 'contradict') AS human_contradict FROM jd WHERE st = 'F' GROUP BY 1) USING (qa_id))"""


def _bias(s, d):
    j = B.table(s, d, "lineitem").select((F.col("l_partkey") % 100).cast("string").alias("qa_id"), F.when(F.col("l_returnflag") == "R", "contradict").otherwise("support").alias("class"), F.col("l_discount").alias("confidence"), "l_linestatus")
    return RP.topical_bias(j.filter("l_linestatus <> 'F'"), j.filter("l_linestatus = 'F'"))


@query("topical_bias_pivot", f"WITH {S_BIAS} SELECT qa_id, support, contradict, human_support, human_contradict, round(mean_conf, 6) AS mean_conf, round(median_conf, 6) AS median_conf, round(min_conf, 6) AS min_conf, round(ratio, 6) AS ratio FROM bias")
def _(s, d):
    return rounded(_bias(s, d))


@query("topical_extremes", f"WITH {S_BIAS} SELECT 'top' AS side, qa_id, round(ratio, 6) AS ratio FROM (SELECT * FROM bias ORDER BY round(ratio, 9) DESC, qa_id LIMIT 10) UNION ALL SELECT 'bottom', qa_id, round(ratio, 6) FROM (SELECT * FROM bias ORDER BY round(ratio, 9), qa_id LIMIT 10)")
def _(s, d):
    return rounded(RP.topical_extremes(_bias(s, d)))


@query("topical_summary", f"WITH {S_BIAS} SELECT count(*) AS n, round(avg(ratio), 6) AS mean_ratio, round(median(ratio), 6) AS median_ratio, round(quantile_cont(ratio, 0.25), 6) AS q25, round(quantile_cont(ratio, 0.75), 6) AS q75, count(*) FILTER (support >= 30 AND contradict <= 1) AS one_sided, round(avg(CASE WHEN mean_conf < 0.7 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS low_share FROM bias")
def _(s, d):
    return rounded(RP.topical_summary(_bias(s, d)))


@query("cost_rollup", f"WITH {S_REC} SELECT backend, count(*) AS calls, count(skip_reason) AS skipped, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(round((input_tokens * CASE backend WHEN 'openai-gpt-4o-mini' THEN 0.15::DOUBLE ELSE 0.59 END + output_tokens * CASE backend WHEN 'openai-gpt-4o-mini' THEN 0.6::DOUBLE ELSE 0.79 END) / 1e6, 6)), 6) AS cost_usd FROM rec GROUP BY backend")
def _(s, d):
    r = B.records(s, d).withColumn("cost_usd", T.judge_cost(F.col("backend"), F.col("input_tokens"), F.col("output_tokens")))
    return RP.cost_rollup(r)


@query("phase_totals", "SELECT o_orderpriority AS run, round(sum(o_totalprice), 2) AS seconds, max(o_totalprice) AS vram_gib FROM orders GROUP BY 1")
def _(s, d):
    return RP.phase_totals(B.table(s, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_totalprice").alias("seconds"), F.col("o_totalprice").alias("vram_gib"))).withColumn("seconds", F.round("seconds", 2))


@query("run_summary", f"""WITH {S_POS.replace('pos AS', 'pos_all AS')}, {S_PRED}, pos AS (SELECT * FROM pos_all), {s_prf('qa_id, sentence_id, class', True)}, {S_MACRO},
pos2 AS (SELECT * FROM pos_all WHERE source = 'human'), {s_prf('qa_id, sentence_id, class', True).replace('prf AS', 'prf2 AS').replace('FROM pos GROUP', 'FROM pos2 GROUP').replace('pmid FROM pos)', 'pmid FROM pos2)')}, {S_MACRO.replace('macro AS', 'macro2 AS').replace('JOIN prf USING', 'JOIN prf2 USING')},
w AS (SELECT run, round(max(b.F1) FILTER (class = 'support') * 100, 4) AS official_support, round(max(b.F1) FILTER (class = 'contradict') * 100, 4) AS official_contradict, round(max(a.F1) FILTER (class = 'support') * 100, 4) AS expanded_support, round(max(a.F1) FILTER (class = 'contradict') * 100, 4) AS expanded_contradict FROM macro a JOIN macro2 b USING (run, setting, class) WHERE setting = 'strict' GROUP BY run)
SELECT *, round(expanded_support - official_support, 4) AS delta_support, round(expanded_contradict - official_contradict, 4) AS delta_contradict FROM w""")
def _(s, d):
    prf = EV.prf_cells(B.cells(s, d, repeated=True), B.predictions(s, d), EV.marked_pools(B.qrels(s, d)), CELL, run=["run"], names=[(r,) for r in RUNS], settings=("expanded", "official"))
    both = EV.macro(prf, _runs(s), ["run"], ("expanded", "official"))
    return EV.run_summary(both.withColumnRenamed("setting", "pool").withColumn("setting", F.lit("strict")))


@query("flagship")
def flagship(s, d):
    """The baseline run end to end, with its default depths: sentences, BM25, reranking, a stance stand-in, the cue filter, selection, and scores against documents that hold the passage."""
    from citeloom.plans.pipeline import BASELINE, run_evidence

    topics = B.sentences(s, d).withColumn("question", F.lit("")).withColumn("existing", F.array().cast("array<string>"))
    rel = B.relevant(s, d).select("qa_id", "pmid", F.lit("support").alias("class"), F.lit(1).alias("relevance"), F.lit("human").alias("source"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("ord"))
    pool = topics.select("qa_id", "sentence_id").join(rel, "qa_id")
    return rounded(run_evidence(topics, B.corpus(s, d), pool, BASELINE).scores)
