"""Queries over joins, conversations, quizzes, citations and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations as L
from ..operators import languages as G
from ..operators import relational as K
from .views import chunks, docs, lines, messages, queries, query, table

# Transcripts derived from lineitem: an order is a recording, its lines are segments and turns.
SEGMENTS = "SELECT l_orderkey AS recording, l_linenumber::BIGINT AS seg, l_linenumber * 10.0::DOUBLE AS s0, l_linenumber * 10.0::DOUBLE + 4 + l_quantity / 10 AS s1 FROM lines"
TURNS = "SELECT l_orderkey AS recording, l_linenumber::BIGINT AS turn, l_suppkey % 3 AS speaker, l_linenumber * 12.0::DOUBLE AS t0, l_linenumber * 12.0::DOUBLE + 3 + l_discount * 40 AS t1 FROM lines WHERE l_orderkey % 9 <> 0"


def _segments(spark, d):
    l = lines(spark, d)  # noqa: E741
    return l.select(F.col("l_orderkey").alias("recording"), F.col("l_linenumber").cast("long").alias("seg"), (F.col("l_linenumber") * 10.0).alias("start"), (F.col("l_linenumber") * 10.0 + 4 + F.col("l_quantity") / 10).alias("end"), F.col("l_returnflag").alias("text"))


def _turns(spark, d):
    l = lines(spark, d).filter("l_orderkey % 9 <> 0")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("recording"), F.col("l_linenumber").cast("long").alias("turn"), (F.col("l_suppkey") % 3).alias("speaker"), (F.col("l_linenumber") * 12.0).alias("start"), (F.col("l_linenumber") * 12.0 + 3 + F.col("l_discount") * 40).alias("end"))


SPEAKERS = f"""WITH s AS ({SEGMENTS}), t AS ({TURNS}),
o AS (SELECT recording, seg, speaker FROM (SELECT s.recording, s.seg, t.speaker, row_number() OVER (PARTITION BY s.recording, s.seg ORDER BY least(s1, t1) - greatest(s0, t0) DESC, t.turn) AS k FROM s JOIN t USING (recording) WHERE least(s1, t1) - greatest(s0, t0) > 0) WHERE k = 1),
n AS (SELECT recording, seg, speaker FROM (SELECT s.recording, s.seg, t.speaker, row_number() OVER (PARTITION BY s.recording, s.seg ORDER BY abs((s0 + s1) / 2 - (t0 + t1) / 2), t.turn) AS k FROM s JOIN t USING (recording) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.recording = s.recording AND o.seg = s.seg)) WHERE k = 1)
SELECT s.recording, s.seg, 'Speaker ' || (coalesce(o.speaker, n.speaker) + 1) AS label FROM s LEFT JOIN o USING (recording, seg) LEFT JOIN n USING (recording, seg)"""


@query("assign_speakers", SPEAKERS, "lines")
def assign_speakers(spark, d):
    return K.assign_speakers(_segments(spark, d), _turns(spark, d))


CLOCK = "printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000)"


@query("subtitle_rows", f"WITH s AS ({SEGMENTS.replace('FROM lines', ', l_returnflag AS text FROM lines')}), c AS (SELECT recording, seg, text, round(s0 * 1000)::BIGINT AS a, round(s1 * 1000)::BIGINT AS b, row_number() OVER (PARTITION BY recording ORDER BY seg) AS n FROM s) SELECT recording, md5(string_agg(n || chr(10) || {CLOCK.replace('ms', 'a')} || ' --> ' || {CLOCK.replace('ms', 'b')} || chr(10) || text || chr(10), chr(10) ORDER BY n)) AS body_md5 FROM c GROUP BY recording", "lines")
def subtitle_rows(spark, d):
    s = _segments(spark, d).withColumn("label", F.lit(None).cast("string"))
    return K.subtitle_rows(s).select("recording", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("parse_clock", "SELECT DISTINCT l_linenumber, 3600 + l_linenumber + 0.25::DOUBLE AS seconds FROM lines", "lines")
def parse_clock(spark, d):
    n = lines(spark, d).select("l_linenumber").distinct()
    return n.select("l_linenumber", K.parse_clock(F.format_string("01:00:%02d,25", F.col("l_linenumber"))).alias("seconds"))


# Aggregates


@query("document_language", "WITH c AS (SELECT doc_id, count(*) FILTER (l IS NOT NULL) AS known, count(*) FILTER (l = 'de') AS de, count(*) FILTER (l = 'en') AS en FROM (SELECT doc_id, CASE WHEN ordinal % 7 = 3 THEN NULL WHEN ordinal % 4 = 1 THEN 'other' ELSE language END AS l FROM chunks) GROUP BY 1) SELECT docs.doc_id, CASE WHEN coalesce(known, 0) = 0 THEN NULL WHEN de / known >= 0.7 THEN 'de' WHEN en / known >= 0.7 THEN 'en' ELSE 'mixed' END AS language FROM docs LEFT JOIN c USING (doc_id)", "docs", "chunks")
def document_language(spark, d):
    c = chunks(spark, d).withColumn("language", F.when(F.col("ordinal") % 7 == 3, F.lit(None)).when(F.col("ordinal") % 4 == 1, "other").otherwise(F.col("language")))
    return K.document_language(docs(spark, d), c)


@query("conversation_list", "SELECT conv_id, max(CASE WHEN created_at < 6 THEN created_at END) AS last_activity, count(*) FILTER (created_at < 6) AS message_count FROM messages GROUP BY conv_id", "messages")
def conversation_list(spark, d):
    m = messages(spark, d)
    conv = m.groupBy("conv_id").agg(F.min("created_at").alias("created_at"))
    return K.conversation_list(conv, m.filter("created_at < 6"))


CITED = "SELECT message_id, (conv_id * 100000 + created_at) AS chunk_id, created_at / 10.0 AS score FROM messages WHERE role = 'assistant'"


@query("conversation_transcript", f"SELECT m.message_id, m.conv_id, m.role, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.created_at, m.message_id) AS turn, (SELECT count(*) FROM ({CITED}) c WHERE c.message_id = m.message_id) AS n_citations, (SELECT min(k.doc_id) FROM ({CITED}) c JOIN chunks k USING (chunk_id) WHERE c.message_id = m.message_id) AS first_doc FROM messages m", "messages", "chunks")
def conversation_transcript(spark, d):
    m = messages(spark, d)
    cited = m.filter("role = 'assistant'").select("message_id", (F.col("conv_id") * 100000 + F.col("created_at")).alias("chunk_id"), (F.col("created_at") / 10).alias("score"))
    out = K.conversation_transcript(m, cited, chunks(spark, d))
    return out.select("message_id", "conv_id", "role", "turn", F.col("n_citations").cast("long").alias("n_citations"), F.array_min(F.transform("citations", lambda c: c.doc_id)).alias("first_doc"))


# Quizzes derived from orders and lineitem: a customer is a deck, an order an attempt, a part a question.
ATTEMPTS = "SELECT o_orderkey AS attempt_id, o_custkey AS deck_id, (o_totalprice::BIGINT % 11) AS score, 10 AS total, epoch(o_orderdate)::BIGINT AS started_at, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 THEN epoch(o_orderdate)::BIGINT + o_orderkey % 900 END AS finished_at FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice) AS o_totalprice, o_orderdate, o_orderstatus FROM orders)"


def _attempts(spark, d):
    o = table(spark, d, "orders")
    start = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("deck_id"), (F.floor("o_totalprice") % 11).alias("score"), F.lit(10).alias("total"), start.alias("started_at"), F.when((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 5 != 0), start + F.col("o_orderkey") % 900).alias("finished_at"))


@query("deck_list", f"WITH a AS ({ATTEMPTS}) SELECT c_custkey AS deck_id, count(finished_at) AS attempts, arg_max(score, (finished_at, attempt_id)) FILTER (finished_at IS NOT NULL) AS last_score, max(finished_at) AS last_finished FROM customer LEFT JOIN a ON deck_id = c_custkey GROUP BY 1")
def deck_list(spark, d):
    return K.deck_list(table(spark, d, "customer").select(F.col("c_custkey").alias("deck_id")), _attempts(spark, d))


@query("attempt_history", f"WITH a AS ({ATTEMPTS}) SELECT attempt_id, percent, CASE WHEN percent >= 80 THEN 'good' WHEN percent >= 50 THEN 'mid' ELSE 'low' END AS tone, finished_at - started_at AS duration, row_number() OVER (PARTITION BY deck_id ORDER BY finished_at DESC NULLS LAST, started_at DESC, attempt_id DESC) AS place FROM (SELECT *, round(100.0 * score / total)::BIGINT AS percent FROM a)")
def attempt_history(spark, d):
    return K.attempt_history(_attempts(spark, d)).select("attempt_id", "percent", "tone", "duration", "place")


def _answers(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("question_id"), (F.floor("l_quantity") % 5).cast("int").alias("selected_index"))


def _questions(spark, d):
    return table(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("question_id"), (F.col("p_size") % 4).alias("correct_index"))


ANSWERS = "SELECT l_orderkey AS attempt_id, l_partkey AS question_id, floor(l_quantity)::BIGINT % 5 AS selected, p_size % 4 AS correct FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 10 <> 0"


@query("score_attempts", f"SELECT attempt_id, count(*) AS total, count(*) FILTER (selected = correct) AS score FROM ({ANSWERS}) WHERE correct IS NOT NULL AND selected <= 3 GROUP BY 1")
def score_attempts(spark, d):
    return K.score_attempts(_answers(spark, d), _questions(spark, d))[0]


@query("rejected_answers", f"SELECT attempt_id, question_id, CASE WHEN correct IS NULL THEN 'unknown-question' ELSE 'index-out-of-range' END AS reason FROM ({ANSWERS}) WHERE correct IS NULL OR selected > 3")
def rejected_answers(spark, d):
    return K.score_attempts(_answers(spark, d), _questions(spark, d))[1]


def _raw_questions(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey") % 8)
    options = F.array(F.col("p_brand"), F.when(F.col("k") == 1, F.upper("p_brand")).otherwise(F.concat("p_brand", F.lit(" b"))), F.when(F.col("k") == 2, "  ").otherwise(F.concat("p_type", F.lit(" c"))), F.when(F.col("k") == 3, "All of the above!").otherwise(F.concat("p_type", F.lit(" d"))))
    return p.select(
        F.col("p_partkey").alias("question_id"), F.when(F.col("k") == 4, " ").otherwise(F.col("p_name")).alias("stem"), F.when(F.col("k") == 5, F.slice(options, 1, 3)).otherwise(options).alias("options"),
        F.when(F.col("k") == 3, 3).when(F.col("k") == 6, 4).otherwise(F.col("p_size") % 3).alias("correct_index"), F.when(F.col("k") == 7, "").otherwise(F.col("p_type")).alias("explanation"),
        F.array(F.col("p_partkey"), F.col("p_partkey") + 1).alias("source_chunk_ids"), F.array(F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(5), F.lit(9).cast("long")).alias("allowed_ids"),
    )


@query("validate_questions", "SELECT p_partkey AS question_id, CASE p_partkey % 8 WHEN 1 THEN 'options-not-distinct' WHEN 2 THEN 'empty-option' WHEN 3 THEN 'lazy-correct-option' WHEN 4 THEN 'empty-stem' WHEN 5 THEN 'options-length' WHEN 6 THEN 'correct-index' WHEN 7 THEN 'empty-explanation' END AS reject_reason, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 WHEN p_partkey IN (8, 9) THEN 9 ELSE p_partkey + 5 END AS first_source FROM part")
def validate_questions(spark, d):
    return K.validate_questions(_raw_questions(spark, d)).select("question_id", "reject_reason", F.get("sources", F.lit(0)).alias("first_source"))


@query("extract_json_objects")
def extract_json_objects(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit("Sure: ["), F.array_join(F.sort_array(F.collect_list("props")), ", "), F.lit(', {"k": ')).alias("raw"))
    return K.extract_json_objects(e, "user_id", "raw")


def _stems(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_size") % 7).cast("long").alias("deck_id"), (F.col("p_partkey") % 5).alias("unit"), F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("question_id"), F.col("p_type").alias("stem"))


@query("dedup_stems")
def dedup_stems(spark, d):
    return K.dedup_stems(_stems(spark, d))


@query("regenerate_plan", f"WITH a AS ({ATTEMPTS}) SELECT count(*) AS attempts FROM a WHERE deck_id % 4 <> 0")
def regenerate_plan(spark, d):
    decks = table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("deck_id"))
    return K.regenerate_plan(_stems(spark, d), _attempts(spark, d), decks)[1].agg(F.count("*").alias("attempts"))


@query("per_document_cap", "SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, chunk_id) AS n FROM chunks) WHERE n <= 3", "chunks")
def per_document_cap(spark, d):
    from ..operators.lexical import top_per_group

    return top_per_group(chunks(spark, d), ["doc_id"], [F.desc(F.length("text")), "chunk_id"], 3).select("chunk_id")


@query("chunk_counts", "SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id", "chunks")
def chunk_counts(spark, d):
    return chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))


# Text expressions


@query("content_tokens", "SELECT query_id, array_to_string(t, ' ') AS tokens FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(query), '[^a-zA-Z0-9äöüß]+'), lambda t: t <> '' AND NOT list_contains(['the','a','an','and','or','of','to','in','on','for','with','is','are','was','were','be','by','at','as','it','der','die','das','den','dem','des','ein','eine','einer','eines','und','oder','von','zu','im','auf','für','mit','ist','sind'], t)) AS t FROM queries)", "queries")
def content_tokens(spark, d):
    return queries(spark, d).select("query_id", F.array_join(X.content_tokens("query"), " ").alias("tokens"))


ASKED = ["how many documents do i have about ", "list all files on ", "summarize ", "which documents does chapter 3 mention for ", "fasse das bitte zusammen: ", "compare the parts of ", "wie viele meiner dokumente behandeln ", "what is "]
BREADTH = ["focused", "broad", "summary", "focused", "summary", "broad", "focused", "focused"]
INTENT = ["count", "list", None, None, None, None, "count", None]
_LIST = "[" + ", ".join(f"'{a}'" for a in ASKED) + "]"


def _asked(spark, d):
    b = table(spark, d, "benchmark")
    head = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("item_id") % 8 + 1).cast("int"))
    word = F.regexp_extract("text", "([A-Za-z]{9,})", 1)
    return b.select(F.col("item_id").alias("query_id"), F.concat(head, F.lit("zzz "), word).alias("query"))


def _case(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query("query_breadth", f"SELECT item_id AS query_id, {_case(BREADTH)}[(item_id % 8 + 1)::INT] AS breadth FROM benchmark")
def query_breadth(spark, d):
    return _asked(spark, d).select("query_id", X.query_breadth("query").alias("breadth"))


@query("adaptive_k", f"SELECT item_id AS query_id, {_case([{'focused': 3, 'broad': 8, 'summary': 12}[b] for b in BREADTH])}[(item_id % 8 + 1)::INT] AS k FROM benchmark")
def adaptive_k(spark, d):
    return _asked(spark, d).select("query_id", X.adaptive_k("query").alias("k"))


@query("corpus_intent", f"SELECT item_id AS query_id, {_case(INTENT)}[(item_id % 8 + 1)::INT] AS intent FROM benchmark")
def corpus_intent(spark, d):
    return _asked(spark, d).select("query_id", X.corpus_intent("query").alias("intent"))


_NO_THEME = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS + X.CORPUS_WORDS) + "]"


@query("theme_tokens", f"SELECT item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(lower(({_LIST})[(item_id % 8 + 1)::INT] || text), '[^a-zA-Z0-9äöüß]+'), lambda t: t <> '' AND NOT list_contains({_NO_THEME}, t)), ' ') AS tokens FROM benchmark")
def theme_tokens(spark, d):
    head = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("item_id") % 8 + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(X.theme_tokens(F.concat(head, "text")), " ").alias("tokens"))


@query("split_questions", "SELECT item_id AS query_id, n + 1 AS seq, part FROM (SELECT item_id, unnest(range(0, 2)) AS n, unnest([substring(text, 1, length(text) // 2) || '?', substring(text, length(text) // 2 + 1) || '?']) AS part FROM (SELECT item_id, 'a' || regexp_replace(text, '[?\\s]+', 'x', 'g') AS text FROM benchmark))")
def split_questions(spark, d):
    b = table(spark, d, "benchmark").withColumn("text", F.concat(F.lit("a"), F.regexp_replace("text", r"[?\s]+", "x")))
    half = F.floor(F.length("text") / 2).cast("int")
    both = F.concat(F.substring("text", F.lit(1), half), F.lit("? ok? "), F.substring("text", half + 1, F.length("text")), F.lit("?"))
    return b.select(F.col("item_id").alias("query_id"), F.posexplode(X.split_questions(both)).alias("n", "part")).select("query_id", (F.col("n") + 1).cast("long").alias("seq"), "part")


@query("guess_de_en", "SELECT doc_id, CASE WHEN regexp_matches(s, '[äöüßÄÖÜ]') OR regexp_matches(s, '(^|[^A-Za-z0-9_])(?i:was|wie|wer|wo|wann|warum|welche|der|die|das|ist|sind|und|nicht|ein|eine)($|[^A-Za-z0-9_])') THEN 'de' ELSE 'en' END AS lang FROM (SELECT doc_id, text AS s FROM docs)", "docs")
def guess_de_en(spark, d):
    return docs(spark, d).select("doc_id", X.guess_de_en("text").alias("lang"))


TARGETS = """WITH q AS (SELECT doc_id AS query_id, 'summarize src' || (doc_id % 20) || ' ' || (doc_id * 3 % 400) AS query FROM docs),
qt AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^a-zA-Z0-9äöüß]+'), lambda t: t NOT IN ('', 'summarize'))) AS token FROM q),
tt AS (SELECT doc_id, token, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(title, '\\.[a-zA-Z]{1,8}$', '')), '[^a-zA-Z0-9äöüß]+'), lambda t: t <> '')) AS token FROM docs)),
c AS (SELECT query_id, doc_id, count(*) / min(n) AS coverage FROM qt JOIN tt USING (token) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, doc_id) AS k, lead(coverage) OVER (PARTITION BY query_id ORDER BY coverage DESC, doc_id) AS second FROM c),
r AS (SELECT q.query_id, CASE WHEN coalesce(coverage, 0) < 0.5 THEN 'none' WHEN coverage < second * 2 THEN 'ambiguous' ELSE 'resolved' END AS kind, doc_id FROM q LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (query_id))"""


def _targets(spark, d):
    x = docs(spark, d)
    q = F.concat(F.lit("summarize src"), (F.col("doc_id") % 20).cast("string"), F.lit(" "), (F.col("doc_id") * 3 % 400).cast("string"))
    return x.select(F.col("doc_id").alias("query_id"), q.alias("query"))


@query("resolve_target_document", TARGETS + " SELECT query_id, kind, CASE WHEN kind = 'resolved' THEN doc_id END AS doc_id FROM r", "docs")
def resolve_target_document(spark, d):
    return L.resolve_target_document(_targets(spark, d), docs(spark, d))


@query("route_queries", TARGETS + " SELECT query_id, CASE WHEN query_id % 20 = 0 OR kind = 'resolved' OR (kind = 'none' AND query_id % 30 = 0) THEN 'doc_summary' ELSE 'retrieval' END AS route, CASE WHEN query_id % 20 = 0 THEN query_id WHEN kind = 'resolved' THEN doc_id WHEN kind = 'none' AND query_id % 30 = 0 THEN 7 END AS doc_id FROM r", "docs")
def route_queries(spark, d):
    q = _targets(spark, d).withColumn("focus", F.when(F.col("query_id") % 20 == 0, F.array("query_id"))).withColumn("pinned", F.when(F.col("query_id") % 30 == 0, F.lit(7).cast("long")))
    return L.route_queries(q, docs(spark, d))


@query("detect_language")
def detect_language(spark, d):
    """Profiles learnt from two thirds of the documents, by a hash of the id; all documents detected."""
    texts = docs(spark, d)
    learnt = texts.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    detect = G.detector(G.learn_profiles(learnt))
    return texts.select("doc_id", "lang", detect("text").alias("d")).select("doc_id", "lang", "d.language", G.chunk_language(F.col("d.language")).alias("detected"))


@query("deck_language", "WITH f AS (SELECT d.doc_id, substring(d.title || ' ' || coalesce((SELECT arg_min(c.text, c.ordinal) FROM chunks c WHERE c.doc_id = d.doc_id), ''), 1, 600) AS s FROM docs d), g AS (SELECT doc_id, regexp_matches(s, '[äöüßÄÖÜ]') OR regexp_matches(s, '(^|[^A-Za-z0-9_])(?i:was|wie|wer|wo|wann|warum|welche|der|die|das|ist|sind|und|nicht|ein|eine)($|[^A-Za-z0-9_])') AS de FROM f) SELECT source AS deck_id, CASE WHEN bool_or(de) THEN 'de' ELSE 'en' END AS language FROM docs JOIN g USING (doc_id) GROUP BY source", "docs", "chunks")
def deck_language(spark, d):
    decks = docs(spark, d).groupBy(F.col("source").alias("deck_id")).agg(F.sort_array(F.collect_list("doc_id")).alias("document_ids"))
    return L.deck_language(decks, docs(spark, d), chunks(spark, d), X.guess_de_en)


# Citations: messages with markers put between their sentences.
def _cited(spark, d):
    m = messages(spark, d).filter("role = 'assistant'")
    mark = F.concat(F.lit(" [doc:"), F.col("conv_id").cast("string"), F.lit(", chunk:"), (F.col("conv_id") * 100000 + F.col("created_at")).cast("string"), F.lit("]"))
    other = F.lit(" [doc:999999, chunk:1]")
    half = F.floor(F.length("content") / 2).cast("int")
    return m.select("message_id", "conv_id", "created_at", F.concat(F.substring("content", F.lit(1), half), mark, F.lit(". "), F.substring("content", half + 1, F.length("content")), other, mark).alias("content"))


MARK = "' [doc:' || conv_id || ', chunk:' || (conv_id * 100000 + created_at) || ']'"
CITED_TEXT = f"SELECT message_id, conv_id, conv_id * 100000 + created_at AS chunk_id, length(content) // 2 AS a, length({MARK}) AS m, length(content) - length(content) // 2 AS b, substring(content, 1, length(content) // 2) AS x, substring(content, length(content) // 2 + 1) AS y FROM messages WHERE role = 'assistant'"


@query("extract_citations", f"WITH t AS ({CITED_TEXT}) SELECT message_id, 0::BIGINT AS seq, conv_id AS doc_id, chunk_id, (a + 1)::BIGINT AS start, (a + m)::BIGINT AS \"end\" FROM t UNION ALL SELECT message_id, 1, 999999, 1, a + m + 2 + b + 1, a + m + 2 + b + 22 FROM t UNION ALL SELECT message_id, 2, conv_id, chunk_id, a + m + 2 + b + 22 + 1, a + m + 2 + b + 22 + m FROM t", "messages")
def extract_citations(spark, d):
    return L.extract_citations(_cited(spark, d))


@query("number_citations", f"WITH t AS ({CITED_TEXT}) SELECT message_id, conv_id AS doc_id, chunk_id, 2::BIGINT AS mentions, 1 AS index FROM t", "messages")
def number_citations(spark, d):
    allowed = _cited(spark, d).select("message_id", F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 100000 + F.col("created_at")).alias("chunk_id"))
    return L.number_citations(L.extract_citations(_cited(spark, d)), allowed).select("message_id", "doc_id", "chunk_id", "mentions", "index")


@query("reconcile_citations", f"WITH t AS ({CITED_TEXT}) SELECT message_id, conv_id AS doc_id, chunk_id, 'persisted' AS state FROM t UNION ALL SELECT message_id, 999999, 1, 'hallucinated' FROM t UNION ALL SELECT message_id, conv_id, chunk_id + 1, 'unused' FROM t", "messages")
def reconcile_citations(spark, d):
    c = _cited(spark, d)
    fed = c.select("message_id", F.col("conv_id").alias("doc_id"), F.explode(F.array(F.col("conv_id") * 100000 + F.col("created_at"), F.col("conv_id") * 100000 + F.col("created_at") + 1)).alias("chunk_id"))
    return L.reconcile_citations(fed, L.extract_citations(c))


@query("strip_citations", f"WITH t AS ({CITED_TEXT}) SELECT message_id, x || ' . ' || y || '  ' AS content FROM t", "messages")
def strip_citations(spark, d):
    return _cited(spark, d).select("message_id", X.strip_citations("content").alias("content"))


@query("citation_snippets")
def citation_snippets(spark, d):
    return L.citation_snippets(_cited(spark, d))


def _snippets(spark, d):
    c = chunks(spark, d)
    part = lambda a, n: F.array_join(F.slice(F.split("text", " "), a, n), " ")
    return c.select(F.col("chunk_id").alias("snippet_id"), "chunk_id", F.concat(part(3, 5), F.lit(" qqqq "), part(12, 4)).alias("snippet"))


@query("shingle_overlap")
def shingle_overlap(spark, d):
    return L.shingle_overlap(_snippets(spark, d), chunks(spark, d))


LITERAL = "WITH s AS (SELECT doc_id, lower(text) AS t, 'the ' AS n FROM docs), p AS (SELECT doc_id, string_split(t, n) AS parts FROM s), k AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM p) SELECT doc_id, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 3)::BIGINT AS start, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + i * 3)::BIGINT AS \"end\" FROM k"


@query("literal_spans", LITERAL.replace("'the '", "'the'"), "docs")
def literal_spans(spark, d):
    return L.literal_spans(docs(spark, d).withColumn("needle", F.lit(" The ")), "doc_id", "text", "needle")


@query("apply_spans", "SELECT message_id, x.start::BIGINT AS start, x.part AS part, x.h AS highlighted FROM (SELECT message_id, unnest([{'start': 0, 'part': substring(content, 1, 4), 'h': false}, {'start': 4, 'part': substring(content, 5, 6), 'h': true}, {'start': 10, 'part': substring(content, 11, 5), 'h': false}, {'start': 15, 'part': substring(content, 16, 5), 'h': true}, {'start': 20, 'part': substring(content, 21), 'h': false}]) AS x FROM messages WHERE length(content) > 30)", "messages")
def apply_spans(spark, d):
    m = messages(spark, d).filter("length(content) > 30")
    spans = m.select("message_id", F.inline(F.array(F.struct(F.lit(4).cast("long").alias("start"), F.lit(10).cast("long").alias("end")), F.struct(F.lit(15).cast("long").alias("start"), F.lit(20).cast("long").alias("end")))))
    return L.apply_spans(m, spans, "message_id", "content")


@query("normalise_key", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def normalise_key(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalise_key(X.compatible(F.concat_ws(" - ", "p_name", "p_brand"))).alias("key"))


@query("strip_think", r"SELECT message_id, regexp_replace(substring(content, 1, 20) || substring(content, 41), '^\s+|\s+$', '', 'g') AS content FROM messages", "messages")
def strip_think(spark, d):
    raw = F.concat(F.substring("content", 1, 20), F.lit("<think>"), F.substring("content", 21, 20), F.lit("\n</think>"), F.substring("content", F.lit(41), F.length("content")))
    return messages(spark, d).select("message_id", X.strip_think(raw).alias("content"))


@query("condense", r"SELECT message_id, CASE WHEN length(t) <= 50 THEN t ELSE substring(t, 1, 49) || '…' END AS content FROM (SELECT message_id, regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM messages)", "messages")
def condense(spark, d):
    return messages(spark, d).select("message_id", X.condense("content", 50).alias("content"))


@query("clean_rewrite", "SELECT item_id, regexp_replace(text, '[^A-Za-z]+', 'x', 'g') AS cleaned FROM benchmark")
def clean_rewrite(spark, d):
    word = F.regexp_replace("text", "[^A-Za-z]+", "x")
    return table(spark, d, "benchmark").select("item_id", X.clean_rewrite(F.concat(F.lit('\n  "Query: '), word, F.lit('"\nmore'))).alias("cleaned"))


@query("clean_hypothesis", "SELECT item_id, regexp_replace(text, '[^A-Za-z]+', 'x', 'g') AS cleaned FROM benchmark")
def clean_hypothesis(spark, d):
    word = F.regexp_replace("text", "[^A-Za-z]+", "x")
    return table(spark, d, "benchmark").select("item_id", X.clean_hypothesis(F.concat(F.lit("<think>a</think> Translation: "), word)).alias("cleaned"))


@query("expand_variants_filter", "SELECT query_id, turn, variant FROM (SELECT query_id, unnest([1, 2]) AS turn, unnest(['about ' || query_id, 'more on ' || query_id]) AS variant FROM queries)", "queries")
def expand_variants_filter(spark, d):
    id = F.col("query_id").cast("string")
    raw = F.concat_ws("\n", F.concat(F.lit("- about "), id), F.concat(F.lit("1. ABOUT  "), id), F.lit("ab"), X.collapse("query"), F.concat(F.lit("* more on "), id), F.concat(F.lit("third for "), id))
    return L.expand_variants_filter(queries(spark, d).withColumn("raw", raw))


@query("history_window", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC, message_id DESC) AS back FROM messages) SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || CASE WHEN length(content) > 600 THEN substring(content, 1, 600) || '…' ELSE content END, chr(10) ORDER BY back DESC) FILTER (back <= 6)) AS history_md5, ceil(sum(least(length(content), 1500) + 12) / 3.5)::BIGINT AS tokens FROM r GROUP BY conv_id", "messages")
def history_window(spark, d):
    return L.history_window(messages(spark, d)).select("conv_id", F.md5(F.col("history").cast("binary")).alias("history_md5"), "tokens")
