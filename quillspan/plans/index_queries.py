"""Registered queries over the index state, the service and the stages, each with the SQL that gives the same rows."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encoders, evaluation, filters, lifecycle, query_plan
from ..sources import files
from . import compare, service, stages
from .queries import CHUNKS, EVAL, FILTERS, FORMS, SUFFIX, TODAY, bm25_sql, chunks_of, item_queries, life_of, load, long, query, tok, LIFE


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a local one on a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillspan-")
    return f"{root.rstrip('/')}/quillspan/{name}-{uuid.uuid4().hex}"



@query("""SELECT doc_id, unnest(['file_extension','source_path','created_at','created_at','created_at','created_at']) AS field, unnest(['equals','ends_with','gte','lt','gte','lt']) AS operator,
unnest(['.md','report'||doc_id||'.md','2025-03-01','2025-04-01','2026-05-01','2026-06-01']) AS value, unnest(['explicit','explicit','explicit','explicit','inferred','inferred']) AS source, unnest([true,true,true,true,false,false]) AS is_active FROM documents""")
def planned_filters(spark, sf_dir):
    said = F.concat(F.lit("markdown files like Report"), F.col("doc_id").cast("string"), F.lit(".md or ext:md from March 2025, last May or march 2025"))
    docs = load(spark, sf_dir, "documents").select("doc_id", query_plan.metadata_filters(said, TODAY).alias("all"))
    kept = docs.select("doc_id", F.explode("all").alias("f"), filters.active(F.col("all")).alias("active"))
    return kept.select("doc_id", "f.field", "f.operator", F.lower("f.value").alias("value"), "f.source", F.exists("active", lambda a: (a["field"] == F.col("f.field")) & (a["value"] == F.col("f.value"))).alias("is_active"))


@query("SELECT doc_id, least(length(text), doc_id%97) AS chars FROM documents")
def byte_offsets(spark, sf_dir):
    text = F.col("text")
    n_bytes = F.octet_length(F.substring(text, F.lit(1), (F.col("doc_id") % 97).cast("int")))
    return load(spark, sf_dir, "documents").select("doc_id", T.bytes_to_chars(text, n_bytes).cast("long").alias("chars"))


@query(r"""SELECT 'c'||conv_id||'.docx' AS source_path, 'Paragraph '||(row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS section, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE regexp_matches(text, '\S')""")
def docx_blocks(spark, sf_dir):
    """Conversations written as DOCX files, a paragraph for each turn, and read back."""
    told = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for conv, turns in zip(frame["conv_id"], frame["turns"], strict=True):
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t["text"])}</w:t></w:r></w:p>' for t in turns)
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
                made.append((f"c{conv}.docx", out.getvalue()))
            yield pd.DataFrame(made, columns=["path", "content"])

    return files.paged_blocks(told.mapInPandas(write, "path string, content binary"), "docx").select("source_path", "section", "text")


@query(f"WITH {CHUNKS}, f AS (SELECT * FROM chunks WHERE {SUFFIX}='.pdf' AND created_at>='2026-03-01' AND created_at<'2026-07-01'), {bm25_sql('r', 'f')} SELECT qid, chunk_id, round(score,9) AS score, rank FROM r WHERE rank<=7")
def stage_filtered(spark, sf_dir):
    found = stages.search(chunks_of(spark, sf_dir), item_queries(spark, sf_dir), "bm25", 7, FILTERS)
    return found.select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"))


@query(f"""WITH {CHUNKS}, {FORMS}, {bm25_sql('hb', queries='SELECT qid, query FROM qv')}, n AS (SELECT qid//10 AS item, count(DISTINCT qid) AS forms FROM hb WHERE rank<=10 GROUP BY 1),
l AS (SELECT qid//10 AS item, qid%10 AS form, chunk_id, rank, score FROM hb WHERE rank<=10),
one AS (SELECT item, chunk_id, score, rank FROM l JOIN n USING (item) WHERE forms=1),
f AS (SELECT item, chunk_id, list_sum(list(1.0::DOUBLE/(60.0::DOUBLE+rank) ORDER BY form)) AS score, min(rank) AS best FROM l JOIN n USING (item) WHERE forms>1 GROUP BY item, chunk_id),
two AS (SELECT item, chunk_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, best, chunk_id) AS rank FROM f)
SELECT a.item AS qid, a.chunk_id, round(a.score,9) AS score, a.rank, c.source_path, 'bm25' AS source, (SELECT count(*) FROM qv WHERE qid//10=a.item) AS n_variants,
array_to_string(list_sort(list_intersect(list_distinct({tok("(SELECT string_agg(query, ' ') FROM qv WHERE qid//10=a.item)")}), list_distinct({tok('c.text')}))), ' ') AS matched_terms FROM (SELECT * FROM one UNION ALL SELECT * FROM two WHERE rank<=10) a JOIN chunks c USING (chunk_id)""")
def service_search(spark, sf_dir):
    found = service.answer_search(chunks_of(spark, sf_dir), item_queries(spark, sf_dir), TODAY)
    return found.select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"), "source_path", "source", F.size("query_variants").cast("long").alias("n_variants"), F.array_join(F.array_sort("matched_terms"), " ").alias("matched_terms"))


@query(f"""WITH {LIFE}, a AS (SELECT st.source_path, st.document_id, st.checksum, st.versions FROM st),
j AS (SELECT inc.source_path, coalesce(a.document_id, inc.document_id) AS document_id, inc.checksum, inc.versions, a.checksum AS was, a.versions AS wv, CAST(inc.source_path AS BIGINT)%5=0 AS bad FROM inc LEFT JOIN a USING (source_path)),
b AS (SELECT source_path, document_id, checksum, versions FROM j WHERE NOT bad AND NOT coalesce(was=checksum AND wv=versions, false)),
fin AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE source_path NOT IN (SELECT source_path FROM b))
SELECT source_path, document_id, checksum, versions FROM fin WHERE CAST(source_path AS BIGINT)%11<>0""")
def lifecycle_state(spark, sf_dir):
    """Two batches through a stored state, the second with failures, and a deletion: what the state holds then."""
    first, second = life_of(spark, sf_dir)
    state = lifecycle.IndexState(spark, scratch(spark, "state"))
    state.apply(first.withColumn("cancelled", F.lit(False)))
    bad = F.col("source_path").cast("long") % 5 == 0
    state.apply(second.select("*", F.when(bad, 0).otherwise(2).alias("n_chunks"), F.lit(0).alias("n_vectors"), F.lit(False).alias("cancelled")))
    state.delete(state.source_paths().where(F.col("source_path").cast("long") % 11 == 0))
    return state.sources().select("source_path", "document_id", "checksum", "versions")


@query(f"""WITH {LIFE}, a AS (SELECT source_path, 'ready' AS status FROM st),
j AS (SELECT inc.source_path, CASE WHEN CAST(inc.source_path AS BIGINT)%5=0 THEN 'failed' ELSE 'ready' END AS status, coalesce(st.checksum=inc.checksum AND st.versions=inc.versions, false) AS same FROM inc LEFT JOIN st USING (source_path)),
n AS (SELECT source_path, CASE WHEN CAST(source_path AS BIGINT)%10=1 THEN 'failed' ELSE status END AS status FROM j WHERE NOT same)
SELECT * FROM n UNION ALL SELECT * FROM a WHERE source_path NOT IN (SELECT source_path FROM n)""")
def lifecycle_attempts(spark, sf_dir):
    """The latest attempt of each source, after failures and cancellations."""
    first, second = life_of(spark, sf_dir)
    state = lifecycle.IndexState(spark, scratch(spark, "state"))
    state.apply(first.withColumn("cancelled", F.lit(False)))
    n = F.col("source_path").cast("long")
    state.apply(second.select("*", F.when(n % 5 == 0, 0).otherwise(2).alias("n_chunks"), F.lit(0).alias("n_vectors"), (n % 10 == 1).alias("cancelled")))
    return state.attempts().select("source_path", "status")


def indexed(spark: SparkSession, sf_dir: str) -> lifecycle.IndexState:
    """Documents through three commits: all of them, then some with other texts, then without some."""
    state = lifecycle.IndexState(spark, scratch(spark, "index"))
    n, number = F.col("doc_id"), F.regexp_extract("document_id", r"^doc-(-?\d+)$", 1).cast("long")
    docs = chunks_of(spark, sf_dir).where("document_id is not null").withColumn("doc_id", number)
    later = docs.where(n % 7 == 0).withColumn("text", F.concat_ws(" ", F.col("text"), F.lit("amended"), F.col("language")))
    for rows in (docs, later):
        cut = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in lifecycle.names(lifecycle.CHUNKS)])
        come = rows.select("source_path", "document_id", F.sha2("text", 256).alias("checksum"), F.lit("1").alias("versions"), F.lit(1).alias("n_chunks"), F.lit(0).alias("n_vectors"), F.lit(False).alias("cancelled"))
        state.apply(come, cut)
    state.delete(docs.where(n % 11 == 0))
    return state


AMENDED = f"""{CHUNKS}, numbered AS (SELECT *, CAST(regexp_extract(document_id,'[0-9]+') AS BIGINT) AS id FROM chunks),
amended AS (SELECT * REPLACE (CASE WHEN id%7=0 THEN text||' amended '||language ELSE text END AS text) FROM numbered), left_over AS (SELECT * FROM amended WHERE id%11<>0)"""


@query(f"WITH {AMENDED}, {bm25_sql('r', 'left_over')} SELECT qid, chunk_id, round(score,9) AS score, rank, matched AS matched_terms FROM r WHERE rank<=10")
def bm25_indexed(spark, sf_dir):
    """BM25 from the stored postings, after additions, updates and deletions."""
    found = indexed(spark, sf_dir).pin().bm25(item_queries(spark, sf_dir), 10)
    return found.select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"), F.array_join("matched_terms", " ").alias("matched_terms"))


@query(f"""WITH {AMENDED}, v AS (SELECT 1 AS version, chunk_id, text FROM chunks UNION ALL SELECT 2, chunk_id, text FROM amended UNION ALL SELECT 3, chunk_id, text FROM left_over)
SELECT version, chunk_id, sha256(text) AS text_sha256, len({tok('text')}) AS n_tokens FROM v""")
def index_history(spark, sf_dir):
    """The chunks of every version, read after the last was committed."""
    state = indexed(spark, sf_dir)
    each = [state.at(v).stored_chunks().select(F.lit(v).cast("long").alias("version"), "chunk_id", F.sha2("text", 256).alias("text_sha256"), long("n_tokens")) for v in (1, 2, 3)]
    return each[0].union(each[1]).union(each[2])


@query("""WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id%6=0 THEN text||' again' ELSE text END AS text FROM documents),
u AS (SELECT 1 AS step, text, doc_id FROM a UNION ALL SELECT 2, text, doc_id FROM b), f AS (SELECT text, min(step) AS step, count(DISTINCT doc_id) AS n FROM u GROUP BY text)
SELECT f.step, doc_id, length(u.text) AS characters FROM u JOIN f USING (text) WHERE u.step=2""")
def vectors_by_content(spark, sf_dir):
    """Two commits of embedded documents: each one's vector now, and the step at which its text was embedded."""
    state, docs = lifecycle.IndexState(spark, scratch(spark, "vectors")), load(spark, sf_dir, "documents").select("doc_id", "text")
    again = docs.withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))
    path, step = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), 0
    for step, rows in enumerate((docs, again), 1):
        model = "characters"
        keyed = rows.withColumn("vector_key", lifecycle.vector_key(F.col("text"), model))
        pinned = state.pin()
        fresh = pinned.unseen(keyed.select(F.col("vector_key").alias("key"), "text")).dropDuplicates(["key"])
        made = encoders.embedded_texts(fresh, lambda texts, step=step: [[float(step), float(len(t))] for t in texts]).select("key", F.lit(model).alias("model"), "vector")
        made = state.versions.staged(made)  # a text is embedded once
        cut = keyed.select(F.concat(path, F.lit(":0")).alias("chunk_id"), path.alias("document_id"), path.alias("source_path"), F.lit(0).alias("ordinal"), "text", "vector_key", *[F.lit(None).alias(c) for c in lifecycle.names(lifecycle.CHUNKS)[5:]])
        come = rows.select(path.alias("source_path"), path.alias("document_id"), F.sha2("text", 256).alias("checksum"), F.lit("1").alias("versions"), F.lit(1).alias("n_chunks"), F.lit(1).alias("n_vectors"), F.lit(False).alias("cancelled"))
        state.apply(come, cut, made, on=pinned)
    found = state.vectors("characters")
    return found.select(F.col("vector")[0].cast("long").alias("step"), F.regexp_extract("source_path", r"(\d+)", 1).cast("long").alias("doc_id"), F.col("vector")[1].cast("long").alias("characters"))


#: What comes before each item's text by its number, the suffix that it asks for, and the month.
ASKS = ("", "PDF files: ", "python files of March 2026: ", "in May 2026: ", "ext:md ")
ASKED = f"""asked AS (SELECT item_id, item_id%5 AS kind, list_extract([{", ".join(f"'{a}'" for a in ASKS)}], item_id%5+1)||trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark WHERE regexp_matches(text, '\\S')),
met AS (SELECT c.chunk_id, k.kind FROM chunks c JOIN (SELECT unnest(range(0,5)) AS kind) k ON (k.kind=0) OR (k.kind=1 AND source_path LIKE '%.pdf') OR (k.kind=2 AND source_path LIKE '%.py' AND created_at>='2026-03-01' AND created_at<'2026-04-01') OR (k.kind=3 AND created_at>='2026-05-01' AND created_at<'2026-06-01') OR (k.kind=4 AND source_path LIKE '%.md')),
pf AS (SELECT item_id, kind, text AS o, trim(regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_./\\\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM asked),
pv AS (SELECT item_id*10 AS qid, kind, o AS query FROM pf UNION ALL SELECT item_id*10+1, kind, x FROM pf WHERE x<>'' AND x<>o)"""


def kind_sql(kind: int) -> str:
    """BM25 of one kind's forms over the chunks that meet its filters."""
    return f"e{kind} AS (SELECT c.* FROM chunks c JOIN met ON met.chunk_id=c.chunk_id AND met.kind={kind}), {bm25_sql(f'p{kind}', f'e{kind}', f'SELECT qid, query FROM pv WHERE kind={kind}')}"


PLANNED = f"""{ASKED}, {", ".join(kind_sql(k) for k in range(5))},
pl AS (SELECT qid//10 AS item, qid%10 AS form, chunk_id, rank, score FROM ({" UNION ALL ".join(f"SELECT qid, chunk_id, rank, score FROM p{k} WHERE rank<=3" for k in range(5))})),
pn AS (SELECT item, count(DISTINCT form) AS forms FROM pl GROUP BY 1),
ps AS (SELECT item, chunk_id, list_sum(list(1.0::DOUBLE/(60.0::DOUBLE+rank) ORDER BY form)) AS score, min(rank) AS best FROM pl JOIN pn USING (item) WHERE forms>1 GROUP BY item, chunk_id),
planned AS (SELECT item AS qid, chunk_id, score, rank FROM pl JOIN pn USING (item) WHERE forms=1 UNION ALL SELECT * FROM (SELECT item, chunk_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, best, chunk_id) AS rank FROM ps) WHERE rank<=3)"""


def asked_of(spark: SparkSession, sf_dir: str):
    """The items as queries that name kinds of files and months."""
    ask = F.element_at(F.array(*map(F.lit, ASKS)), (F.col("qid") % len(ASKS) + 1).cast("int"))
    return item_queries(spark, sf_dir).where(F.col("query").rlike(r"\S")).select("qid", F.concat(ask, T.collapse(F.col("query"))).alias("query"))


@query(f"WITH {CHUNKS}, {PLANNED} SELECT qid, chunk_id, round(score,9) AS score, rank FROM planned")
def planned_search(spark, sf_dir):
    """Queries with filters of their own, each over what it leaves and with the statistics of that, in one pass."""
    found = compare.planned_search(chunks_of(spark, sf_dir), asked_of(spark, sf_dir), "bm25", 3, TODAY)
    return found.select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"))


@query(f"""{EVAL}, {PLANNED}, {bm25_sql('rw', queries='SELECT item_id AS qid, text AS query FROM asked')},
both_modes AS (SELECT 'raw' AS query_mode, qid AS case_id, chunk_id, rank FROM rw WHERE rank<=3 UNION ALL SELECT 'processed', qid, chunk_id, rank FROM planned),
modes AS (SELECT unnest(['raw','processed']) AS query_mode),
each_case AS (SELECT m.query_mode, g.case_id, count(b.rank)/count(*) AS recall, coalesce(1.0::DOUBLE/min(b.rank), 0) AS rr FROM g CROSS JOIN modes m LEFT JOIN both_modes b ON b.query_mode=m.query_mode AND b.case_id=g.case_id AND b.chunk_id=g.chunk_id GROUP BY 1,2)
SELECT 'bm25' AS stage, query_mode, round(avg(recall),9) AS recall, round(avg(rr),9) AS mrr, bool_and(recall=1 AND rr=1) AS no_headroom FROM each_case GROUP BY query_mode""")
def stage_compare(spark, sf_dir):
    facts = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("fact"))
    found = T.texts_with_facts(chunks_of(spark, sf_dir), facts, "chunk_id", "qid").groupBy("qid").agg(F.collect_list("chunk_id").alias("relevant_chunk_ids"))
    gold = asked_of(spark, sf_dir).join(found, "qid")
    out = compare.compare(chunks_of(spark, sf_dir), gold, today=TODAY)
    return out.select("stage", "query_mode", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), "no_headroom")


@query("""WITH f AS (SELECT page_id, 'p/'||page_id||'.txt' AS source_path, html FROM pages), u AS (SELECT *, sha256(html) AS checksum FROM f WHERE strlen(html)>0 AND regexp_matches(html, '\\S'))
SELECT source_path, checksum, 'local-'||left(sha256(source_path||checksum),16) AS document_id, 'added' AS action FROM u""")
def ingest_files(spark, sf_dir):
    """Pages as text files through reading, chunking and the state: what is stored of each that has chunks."""
    from . import ingestion

    state = lifecycle.IndexState(spark, scratch(spark, "ingest"))
    pages = load(spark, sf_dir, "pages")
    rows = pages.select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("source_path"), F.lit("text/plain").alias("media_type"), F.encode("html", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))
    done = ingestion.add_files(state, rows)
    stored = state.chunks().select("source_path").distinct()
    return state.sources().join(stored, "source_path", "left_semi").join(done.select("source_path", "action"), "source_path").select("source_path", "checksum", "document_id", "action")


@query("""WITH o AS (SELECT o_custkey AS case_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
g AS (SELECT * FROM o WHERE o_orderkey%3=0), e AS (SELECT case_id, sum(CASE WHEN rank<=3 THEN 1 ELSE 0 END)/count(*) AS recall, coalesce(1.0::DOUBLE/min(CASE WHEN rank<=3 THEN rank END), 0) AS reciprocal_rank FROM g GROUP BY case_id)
SELECT case_id, round(recall,9) AS recall, round(reciprocal_rank,9) AS reciprocal_rank FROM e""")
def order_eval(spark, sf_dir):
    from ..operators.ranking import ranked

    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderkey").alias("n"))
    results = ranked(o.select(F.col("case_id").alias("qid"), "chunk_id", (-F.col("n")).alias("score"))).select(F.col("qid").alias("case_id"), "chunk_id", "rank")
    return evaluation.evaluate_retrieval(o.where("n % 3 = 0").select("case_id", "chunk_id"), results, 3).select("case_id", F.round("recall", 9).alias("recall"), F.round("reciprocal_rank", 9).alias("reciprocal_rank"))
