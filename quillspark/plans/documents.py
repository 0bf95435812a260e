"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import extract, graph, quality, retrieval, timeline, versions
from quillspark.session import Kept
from quillspark.sources.tables import table

SQUEEZE = "trim(regexp_replace({}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', ' ', 'g'))"
PARTS = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def content_hash_dupes(spark: SparkSession, d: str) -> DataFrame:
    return versions.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


def sentence_table(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.posexplode(X.sentences(F.col("text"))).alias("chunk_index", "content"))


def citation_ids(spark: SparkSession, d: str) -> DataFrame:
    """A citation id for each sentence. Ordinals are counted by document, so a document's sentences meet in one task."""
    rows = versions.chunk_ordinals(sentence_table(spark, d), "document_id", "content", "chunk_index")
    key = F.concat(F.lit("doc:"), F.col("document_id").cast("string"))
    return rows.select("document_id", "chunk_index", F.col("ordinal").cast("int").alias("ordinal"), X.citation_id(key, F.col("content"), F.col("ordinal")).alias("citation_id"))


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return versions.near_duplicate_pairs(table(spark, d, "documents"), "doc_id", "text", ["lang", "source"])


def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kept = Kept(spark, "components")
    links = versions.near_duplicate_links(docs, "doc_id", "text", ["lang", "source"])
    return versions.duplicate_clusters(links, docs.select("doc_id"), kept, "doc_id")


def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", X.content_hash(F.col("text")).alias("cluster"))
    best = docs.groupBy("cluster").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.count("*").alias("copies"))
    return best.select("doc_id", "copies")


def audit_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(quality.audit(table(spark, d, "documents"), "doc_id", "text"))


def source_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.source_ref(F.col("url")).alias("source_ref"), F.col("url").contains("?").alias("had_query"))


def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", X.pii_findings(F.col("text")).alias("f"), F.size(F.regexp_extract_all("text", F.lit(r"[0-9]{3}-[0-9]{4}"), F.lit(0))).alias("number_shapes"))
    return found.select("doc_id", F.size("f").alias("findings"), F.array_join("f", "|").alias("masked"), "number_shapes")


def benchmark_containment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a whole test item, word for word. Items and documents meet on runs of eight words (or the item's first
    words, if fewer), and the whole item is then looked for."""
    grams = 8
    words = lambda c: F.split(X.squeeze(F.col(c)), " ")
    items = table(spark, d, "benchmark").where(F.trim("text") != "").select("item_id", X.squeeze(F.col("text")).alias("item"), F.least(F.size(words("text")), F.lit(grams)).alias("m"), F.array_join(F.slice(words("text"), 1, grams), " ").alias("head"))
    items = items.select("item_id", "item", "m", F.xxhash64("m", "head").alias("k"))
    lengths = [r["m"] for r in items.select("m").distinct().orderBy("m").collect()]  # eight at most
    docs = table(spark, d, "documents").select("doc_id", X.squeeze(F.col("text")).alias("doc"))
    none = F.expr("cast(array() as array<bigint>)")

    def runs_of(w: F.Column, m: int) -> F.Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda i: F.xxhash64(F.lit(m), F.array_join(F.slice(w, i, F.lit(m)), " ")))
        return F.when(F.size(w) >= m, each).otherwise(none)

    # the words are bound to a lambda's variable, so that the text is split once
    bound = F.transform(F.array(F.split("doc", " ")), lambda w: F.flatten(F.array(*[runs_of(w, m) for m in lengths])) if lengths else none)
    meet = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(bound))).alias("k")).join(items.select("item_id", "k"), "k").select("doc_id", "item_id").distinct()
    whole = meet.join(items.select("item_id", "item"), "item_id").join(docs, "doc_id")
    blank = F.lit(" ")
    return whole.where(F.contains(F.concat(blank, "doc", blank), F.concat(blank, "item", blank))).select("doc_id", "item_id")


TERMS = ["the", "that", "with"]


def query_snippet(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    terms = F.array(*[F.lit(t) for t in TERMS])
    out = docs.select("doc_id", X.best_sentence(F.col("s"), terms).alias("sentence"), "s")
    return out.where("sentence >= 0").select("doc_id", F.col("sentence").cast("int").alias("sentence"), F.substring(F.get("s", F.col("sentence")), 1, 160).alias("snippet"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_search(table(spark, d, "documents"), "the that-with", "doc_id", "text")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunk(table(spark, d, "documents"), "doc_id", "text")


def proper_phrases(spark: SparkSession, d: str) -> DataFrame:
    return extract.proper_phrases(table(spark, d, "documents"), "text")


LICENSE = r"(?i)\b(gnu general public license|apache license|mit license|mozilla public license|bsd license)\b"


def matter_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    refs = graph.matter_refs(docs, "doc_id", "text", LICENSE).join(docs.select("doc_id", "source"), "doc_id")
    voted = refs.where("source = 'src0'").select("matter", F.col("doc_id").alias("day"))
    return graph.roll_up_matters(voted, refs.where("source <> 'src0'").select("matter", F.col("doc_id").alias("day")))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return retrieval.context_window(rows, "conv_id", "turn", 1, "text").select("conv_id", "turn", "context")


def run_merge(spark: SparkSession, d: str) -> DataFrame:
    return timeline.runs(table(spark, d, "conversations"), "conv_id", ["turn"], "role")


def adjacent_response(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return timeline.responses(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "next_label", "next_text")


def unique_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Opening words of turns that only one role uses."""
    words = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 2), " ")
    rows = table(spark, d, "conversations").select(words.alias("phrase"), F.col("role").alias("subject")).where("phrase <> ''")
    return graph.unique_names(rows, "phrase", "subject")


def citations_verified(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers that cite their conversation's first turn; those of conversations without one are unknown."""
    conv = table(spark, d, "conversations")
    cite = F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 8)
    sentence = F.when(F.col("role") == "assistant", F.concat(F.lit("[#q"), cite, F.lit("]"))).otherwise(F.col("text"))
    answers = conv.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("position"), sentence.alias("sentence"))
    known = conv.where("role = 'system' or turn >= 3").select(cite.alias("citation_id"))
    return retrieval.verify_citations(answers, known).select("answer_id", "position")


QUERIES = {f.__name__: f for f in (content_hash_dupes, citation_ids, near_duplicate_pairs, duplicate_components, canonical_documents, audit_issues, source_refs, pii_scan, benchmark_containment, query_snippet, keyword_search, chunk_documents, proper_phrases, matter_rollup, context_window, run_merge, adjacent_response, unique_phrases, citations_verified)}

_PAIRS = """
t AS (SELECT doc_id, lang, source, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL),
ok AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, source, t) AS rep FROM t WHERE len(t) >= 30),
r AS (SELECT * FROM ok WHERE rep = doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS u
      FROM r a JOIN r b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id),
pairs AS (SELECT a, b, round(i / u, 6) AS jaccard FROM p WHERE 100 * i >= 85 * u UNION ALL SELECT rep, doc_id, 1.0 FROM ok WHERE rep <> doc_id)"""

ORACLES = {
    "content_hash_dupes": f"SELECT sha256({SQUEEZE.format('text')}) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "citation_ids": f"""
WITH s AS (SELECT doc_id AS document_id, {PARTS} AS s FROM documents),
e AS (SELECT document_id, i - 1 AS chunk_index, s[i] AS content FROM s, unnest(range(1, len(s) + 1)) AS t(i)),
n AS (SELECT *, replace(lower({SQUEEZE.format('content')}), 'ß', 'ss') AS form FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id, form ORDER BY chunk_index) - 1 AS ordinal FROM n)
SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(ordinal AS INTEGER) AS ordinal,
       substr(sha256('doc:' || document_id || chr(10) || form || CASE WHEN ordinal > 0 THEN chr(10) || '#' || ordinal ELSE '' END), 1, 8) AS citation_id FROM o""",
    "near_duplicate_pairs": """
WITH t AS (SELECT doc_id, lang, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL),
ok AS (SELECT * FROM t WHERE len(t) >= 30),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS u
      FROM ok a JOIN ok b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id)
SELECT a, b, round(i / u, 6) AS jaccard FROM p WHERE 100 * i >= 85 * u""",
    "duplicate_components": f"""
WITH RECURSIVE {_PAIRS},
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT a AS doc_id, min(b) AS cluster FROM reach GROUP BY a""",
    "canonical_documents": f"""
WITH h AS (SELECT doc_id, n_chars, sha256({SQUEEZE.format('text')}) AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY k) AS copies FROM h)
SELECT doc_id, copies FROM r WHERE n = 1""",
    "audit_issues": """
WITH i AS (
SELECT doc_id, 'empty' AS issue FROM documents WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT doc_id, 'control_characters' FROM documents WHERE regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')
UNION ALL SELECT doc_id, 'mojibake' FROM documents WHERE regexp_matches(text, 'Ã[\\x{80}-\\x{BF}©¨¤¶¼]|â€|\\x{FFFD}')
UNION ALL SELECT doc_id, 'exotic' FROM documents WHERE length(text) > 0 AND (length(text) - length(regexp_replace(text, '[\\x{250}-\\x{1FFF}\\x{2070}-\\x{10FFFF}]', '', 'g'))) / length(text) > 0.05
UNION ALL SELECT doc_id, 'pii' FROM documents WHERE regexp_matches(text, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b') OR regexp_matches(text, '(?i)\\b(?:dob|date of birth|born)\\W{1,3}[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\\b')
UNION ALL SELECT doc_id, 'contact' FROM documents WHERE contains(text, '@')
UNION ALL SELECT doc_id, 'advocacy' FROM documents WHERE regexp_matches(lower(text), '\\b(vote (yes|no) on|paid for by|support our campaign)\\b'))
SELECT issue, count(*) AS n, min(doc_id) AS first_id FROM i GROUP BY issue""",
    "source_refs": """
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
       || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS source_ref, contains(url, '?') AS had_query FROM pages""",
    "pii_scan": """
WITH f AS (SELECT doc_id, list_transform(list_concat(regexp_extract_all(text, '\\b([0-9]{3}-[0-9]{2}-[0-9]{4})\\b', 1),
  regexp_extract_all(text, '(?i)\\b((?:dob|date of birth|born)\\W{1,3}[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})\\b', 1)), lambda x: regexp_replace(x, '[0-9]', 'X', 'g')) AS f,
  len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS k FROM documents)
SELECT doc_id, CAST(len(f) AS INTEGER) AS findings, coalesce(array_to_string(f, '|'), '') AS masked, CAST(k AS INTEGER) AS number_shapes FROM f""",
    "benchmark_containment": f"""
SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(' ' || {SQUEEZE.format('d.text')} || ' ', ' ' || {SQUEEZE.format('b.text')} || ' ') WHERE trim(b.text) <> ''""",
    "query_snippet": f"""
WITH s AS (SELECT doc_id, {PARTS} AS s FROM documents),
e AS (SELECT doc_id, i - 1 AS i, s[i] AS x FROM s, unnest(range(1, len(s) + 1)) AS t(i)),
k AS (SELECT *, {' + '.join(f"CAST(contains(lower(x), '{t}') AS INTEGER)" for t in TERMS)} AS a, {' + '.join(f"(len(string_split(lower(x), '{t}')) - 1)" for t in TERMS)} AS h FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC, h DESC, i) AS n FROM k)
SELECT doc_id, CAST(i AS INTEGER) AS sentence, substr(x, 1, 160) AS snippet FROM r WHERE n = 1 AND a > 0""",
    "keyword_search": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'that')) AS b, len(list_filter(w, lambda x: x = 'with')) AS c FROM w)
SELECT doc_id AS id, round((a + b + c) / (1 + log10(n)), 9) AS score FROM c WHERE a > 0 AND b > 0 AND c > 0 ORDER BY score DESC, id LIMIT 50""",
    "proper_phrases": """
WITH r AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1)) AS r FROM documents),
w AS (SELECT string_split(r, ' ') AS w FROM r),
g AS (SELECT array_to_string(w[i : i + n - 1], ' ') AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS k(n), unnest(range(1, len(w) - n + 2)) AS t(i))
SELECT phrase, count(*) AS n FROM g GROUP BY phrase""",
    "matter_rollup": """
WITH m AS (SELECT doc_id, source, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\b(gnu general public license|apache license|mit license|mozilla public license|bsd license)\\b', 1), lambda x: lower(x)))) AS matter FROM documents)
SELECT matter, count(*) FILTER (source = 'src0') AS actions, count(*) FILTER (source <> 'src0') AS "references", max(doc_id) AS last_day FROM m WHERE source IS NOT NULL GROUP BY matter""",
    "context_window": """
SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' | ') AS context FROM conversations""",
    "run_merge": """
WITH m AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS s FROM conversations),
r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM m)
SELECT conv_id, run, min(role) AS role, count(*) AS n FROM r GROUP BY conv_id, run""",
    "adjacent_response": """
SELECT conv_id, turn, role, lead(role) OVER w AS next_label, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "unique_phrases": """
WITH p AS (SELECT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:2], ' ') AS phrase, role AS subject FROM conversations)
SELECT phrase, min(subject) AS subject, CASE WHEN contains(phrase, ' ') THEN 'strong' ELSE 'review' END AS strength FROM p WHERE phrase <> '' GROUP BY phrase HAVING count(DISTINCT subject) = 1""",
    "citations_verified": """
WITH k AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system' OR turn >= 3)
SELECT conv_id AS answer_id, turn AS position FROM conversations
WHERE (role = 'assistant' AND conv_id IN (SELECT conv_id FROM k)) OR (role <> 'assistant' AND len(regexp_split_to_array(trim(text), '\\s+')) <= 8)""",
}
