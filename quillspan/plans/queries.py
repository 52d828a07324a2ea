"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, citations, dense, encoders, evaluation, filters, fusion, lexical, lifecycle, query_plan, ranking, selection
from ..sources import files
from ..sources.corpus import chunk_table
from . import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TODAY = date(2026, 9, 22)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(load(spark, sf_dir, "documents"))


def item_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def long(c: str):
    return F.col(c).cast("long").alias(c)


def tok(x: str) -> str:
    return rf"regexp_extract_all(replace(lower({x}),'ß','ss'), '[\p{{L}}\p{{N}}_.\-]+')"


CHUNKS = """chunks AS (SELECT 'doc-'||doc_id||':000' AS chunk_id, 'doc-'||doc_id AS document_id, 0 AS ordinal, text,
 source||'/'||lang||'/'||doc_id||(CASE doc_id%4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '.py' END) AS source_path,
 doc_id%7+1 AS page, lang AS language,
 CASE WHEN doc_id%5=0 THEN NULL ELSE strftime(DATE '2026-01-01' + CAST(doc_id%365 AS INT), '%Y-%m-%d') END AS created_at FROM documents)"""
SUFFIX = r"lower(regexp_extract(source_path, '[^/]*[^/](\.[^./]+)$', 1))"


def bm25_sql(name: str, source: str = "chunks", queries: str = "SELECT item_id AS qid, text AS query FROM benchmark", k1: float = 1.5, b: float = 0.75) -> str:
    """Common table expressions that end in {name}: qid, chunk_id, score, matched, rank."""
    p = name
    return f"""{p}_q AS ({queries}),
{p}_qt AS (SELECT qid, term, min(pos) AS pos FROM (SELECT qid, unnest(tk) AS term, generate_subscripts(tk,1) AS pos FROM (SELECT qid, {tok('query')} AS tk FROM {p}_q)) GROUP BY qid, term),
{p}_tok AS (SELECT chunk_id, {tok('text')} AS tk FROM {source}),
{p}_st AS (SELECT count(*) AS n, avg(len(tk)) AS a FROM {p}_tok),
{p}_tf AS (SELECT chunk_id, n_tokens, term, count(*) AS tf FROM (SELECT chunk_id, len(tk) AS n_tokens, unnest(tk) AS term FROM {p}_tok) WHERE term IN (SELECT term FROM {p}_qt) GROUP BY chunk_id, n_tokens, term),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf GROUP BY term),
{p}_hit AS (SELECT qid, chunk_id, pos, term, ln(1+(n-df+0.5::DOUBLE)/(df+0.5::DOUBLE))*(tf*{k1 + 1}::DOUBLE)/(tf+{k1}::DOUBLE*(1-{b}::DOUBLE+{b}::DOUBLE*(n_tokens/a))) AS part FROM {p}_tf JOIN {p}_df USING (term) JOIN {p}_qt USING (term), {p}_st),
{p}_sc AS (SELECT qid, chunk_id, list_sum(list(part ORDER BY pos)) AS score, array_to_string(list(term ORDER BY pos), ' ') AS matched FROM {p}_hit GROUP BY qid, chunk_id),
{p} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {p}_sc)"""


# sources


@query(f"WITH {CHUNKS} SELECT chunk_id, document_id, text, source_path, page, language, created_at FROM chunks")
def scan_documents(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("chunk_id", "document_id", "text", "source_path", long("page"), "language", "created_at")


@query(r"""WITH p AS (SELECT page_id, '..\'||replace(url,'/','\')||'/./x//'||page_id AS path FROM pages)
SELECT page_id, array_to_string(list_filter(string_split(replace(path,'\','/'),'/'), lambda x: x NOT IN ('','.','..')),'/') AS safe FROM p""")
def path_sanitize(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    raw = F.concat(F.lit("..\\"), F.replace("url", F.lit("/"), F.lit("\\")), F.lit("/./x//"), F.col("page_id").cast("string"))
    return pages.select("page_id", T.safe_path(raw).alias("safe"))


@query(f"""WITH {CHUNKS} SELECT chunk_id, {SUFFIX} AS suffix,
CASE {SUFFIX} WHEN '.pdf' THEN 'pdf' ELSE 'text' END AS route,
CASE {SUFFIX} WHEN '.pdf' THEN 'application/pdf' WHEN '.md' THEN 'text/markdown' WHEN '.txt' THEN 'text/plain' ELSE 'text/x-python' END AS media_type FROM chunks""")
def file_route(spark, sf_dir):
    path = F.col("source_path")
    kind = files.media_type(path, F.lit(None).cast("string"))
    return chunks_of(spark, sf_dir).select("chunk_id", T.path_suffix(path).alias("suffix"), files.route(path, kind).alias("route"), kind.alias("media_type"))


@query(f"WITH {CHUNKS}, d AS (SELECT chunk_id, source_path, sha256(text) AS checksum FROM chunks) SELECT chunk_id, checksum, 'local-'||left(sha256(source_path||checksum),16) AS document_id FROM d")
def checksum_ids(spark, sf_dir):
    digest = files.checksum(F.encode("text", "UTF-8"))
    return chunks_of(spark, sf_dir).select("chunk_id", digest.alias("checksum"), files.document_id(F.col("source_path"), digest).alias("document_id"))


@query("SELECT page_id, page_id%10<>3 AS valid, CASE WHEN page_id%10<>3 THEN strlen(html) END AS n_bytes FROM pages")
def upload_decode(spark, sf_dir):
    encoded = F.concat(F.base64(F.encode("html", "UTF-8")), F.when(F.col("page_id") % 10 == 3, "!").otherwise(""))
    content = files.decode_upload(encoded)
    return load(spark, sf_dir, "pages").select("page_id", content.isNotNull().alias("valid"), F.length(content).cast("long").alias("n_bytes"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '^\s+|\s+$', '', 'g') AS body FROM pages)
SELECT page_id, 'paragraph' AS kind, length(body) AS char_end, length(body)-length(replace(body, chr(10), ''))+1 AS line_end FROM t""")
def text_documents(spark, sf_dir):
    raw = load(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("").alias("media_type"), F.encode("html", "UTF-8").alias("content"))
    docs = files.text_documents(raw)
    return docs.select(F.regexp_extract("source_path", r"(\d+)\.html", 1).cast("long").alias("page_id"), "kind", long("char_end"), long("line_end"))


@query("""WITH f AS (SELECT doc_id, (CASE doc_id%6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/dist/' ELSE 'b/' END)||doc_id||(CASE doc_id%5 WHEN 0 THEN '.exe' WHEN 1 THEN '' ELSE '.TXT' END) AS path,
 CASE WHEN doc_id%7=0 THEN 0 WHEN doc_id%11=0 THEN 20971521 ELSE strlen(text) END AS size, CASE WHEN doc_id%2=0 THEN '' ELSE 'application/x' END AS kind FROM documents)
SELECT doc_id, CASE WHEN doc_id%6=0 THEN 'ignored folder: node_modules' WHEN doc_id%6=1 THEN 'ignored folder: dist' WHEN size=0 THEN 'empty file' WHEN size>20971520 THEN 'larger than the 20 MB per-file limit'
 WHEN doc_id%5=0 THEN 'unsupported file type: .exe' WHEN doc_id%5=1 THEN 'unsupported file type: '||(CASE WHEN kind<>'' THEN kind ELSE 'unknown' END) END AS reason FROM f""")
def admission_filter(spark, sf_dir):
    n = F.col("doc_id")
    path = F.concat(F.when(n % 6 == 0, "node_modules/").when(n % 6 == 1, "a/dist/").otherwise("b/"), n.cast("string"), F.when(n % 5 == 0, ".exe").when(n % 5 == 1, "").otherwise(".TXT"))
    size = F.when(n % 7 == 0, 0).when(n % 11 == 0, files.MAX_BYTES + 1).otherwise(F.octet_length("text"))
    kind = F.when(n % 2 == 0, "").otherwise("application/x")
    return load(spark, sf_dir, "documents").select("doc_id", files.skip_reason(path, size, kind).alias("reason"))


@query("SELECT conv_id AS document_id, (turn//2)::BIGINT AS ordinal, count(*) AS n FROM conversations GROUP BY conv_id, turn//2 HAVING count(*) > 1")
def unique_ordinals(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.floor(F.col("turn") / 2).cast("long").alias("ordinal"))
    return lifecycle.duplicate_ordinals(rows)


# filters

FILTERS = [{"field": "file_extension", "operator": "equals", "value": ".PDF"}, {"field": "created_at", "operator": "gte", "value": "2026-03-01"}, {"field": "created_at", "operator": "lt", "value": "2026-07-01"}]


@query(f"WITH {CHUNKS} SELECT chunk_id, source_path, created_at FROM chunks WHERE {SUFFIX}='.pdf' AND created_at>='2026-03-01' AND created_at<'2026-07-01'")
def metadata_filter(spark, sf_dir):
    return filters.filter_chunks(chunks_of(spark, sf_dir), FILTERS).select("chunk_id", "source_path", "created_at")


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE source_path LIKE '%/de/%1.md'")
def path_filter(spark, sf_dir):
    ends = filters.filter_chunks(chunks_of(spark, sf_dir), [{"field": "source_path", "operator": "ends_with", "value": "1.MD"}])
    return filters.filter_chunks(ends, {"language": "de"}).select("chunk_id")


@query(f"WITH {CHUNKS} SELECT chunk_id, language FROM chunks WHERE created_at IS NULL AND language='fr'")
def mapping_filter(spark, sf_dir):
    return filters.filter_chunks(chunks_of(spark, sf_dir), {"created_at": None, "language": "fr"}).select("chunk_id", "language")


@query(f"WITH {CHUNKS} SELECT source_path, {SUFFIX} AS suffix FROM chunks")
def file_extension(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("source_path", T.path_suffix(F.col("source_path")).alias("suffix"))


@query(f"WITH {CHUNKS} SELECT chunk_id, source_path, ordinal::BIGINT AS ordinal FROM chunks ORDER BY source_path, ordinal")
def snapshot_order(spark, sf_dir):
    return lifecycle.snapshot(chunks_of(spark, sf_dir)).select("chunk_id", "source_path", long("ordinal"))


# query planning


@query(r"""WITH q AS (SELECT page_id, trim(regexp_replace(url, '\s+', ' ', 'g')) AS o FROM pages),
e AS (SELECT page_id, o, trim(regexp_replace(regexp_replace(regexp_replace(o, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_./\\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM q)
SELECT page_id, CASE WHEN o='' THEN '' WHEN x=o OR x='' THEN o ELSE o||'|'||x END AS variants FROM e""")
def query_expand(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(query_plan.expand_query(F.col("url")), "|").alias("variants"))


@query("""WITH d AS (SELECT doc_id, doc_id%12+1 AS m, 2020+doc_id%7 AS y, doc_id%3 AS how FROM documents),
r AS (SELECT doc_id, m, how, CASE WHEN how=0 THEN y WHEN how=1 THEN 2026 - (CASE WHEN m>=9 THEN 1 ELSE 0 END) ELSE 2026 END AS year FROM d)
SELECT doc_id, unnest(['gte','lt']) AS operator, strftime(unnest([make_date(year::INT,m::INT,1), CAST(make_date(year::INT,m::INT,1)+INTERVAL 1 MONTH AS DATE)]), '%Y-%m-%d') AS value, CASE WHEN how=0 THEN 'explicit' ELSE 'inferred' END AS source FROM r""")
def month_range_filter(spark, sf_dir):
    n = F.col("doc_id")
    name = F.initcap(F.element_at(F.array(*map(F.lit, query_plan.MONTHS)), (n % 12 + 1).cast("int")))
    said = F.concat(F.lit("notes from "), F.when(n % 3 == 1, "last ").otherwise(""), name, F.when(n % 3 == 0, F.concat(F.lit(" "), (2020 + n % 7).cast("string"))).otherwise(""))
    found = load(spark, sf_dir, "documents").select("doc_id", F.explode(query_plan.month_filters(said, TODAY)).alias("f"))
    return found.select("doc_id", "f.operator", "f.value", "f.source")


@query("""WITH d AS (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN ['.docx'] WHEN 1 THEN ['.md'] WHEN 2 THEN ['.py'] ELSE ['.rst','.json'] END AS v FROM documents)
SELECT doc_id, unnest(v) AS value, 'explicit' AS source FROM d""")
def file_type_filters(spark, sf_dir):
    n = F.col("doc_id")
    said = F.when(n % 4 == 0, "find docx files").when(n % 4 == 1, "a Markdown file").when(n % 4 == 2, "ext: .PY please").otherwise("type:rst or json")
    found = load(spark, sf_dir, "documents").select("doc_id", F.explode(query_plan.file_type_filters(said)).alias("f"))
    return found.select("doc_id", "f.value", "f.source")


@query("""SELECT doc_id, CASE WHEN doc_id%2=0 THEN 'about '||lang||' fetch_retries.py' ELSE 'Fetch_Retries.py again' END AS protected FROM documents""")
def variant_protect(spark, sf_dir):
    n = F.col("doc_id")
    variant = F.when(n % 2 == 0, F.concat(F.lit("  about   "), "lang")).otherwise("Fetch_Retries.py again")
    return load(spark, sf_dir, "documents").select("doc_id", query_plan.protect_variant(variant, F.array(F.lit("fetch_retries.py"))).alias("protected"))


@query(r"""WITH n AS (SELECT page_id, trim(regexp_replace('find PDF files about '||chr(39)||page_id||chr(39)||' in '||url||' from last March', '\s+', ' ', 'g')) AS o, regexp_replace(url, '[.,;:!?]+$', '') AS u FROM pages),
e AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(o, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_./\\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM n)
SELECT page_id, o AS normalized_query, CASE WHEN x=o THEN o ELSE o||'|'||x END AS search_queries, page_id||'|'||u AS exact_terms,
'.pdf|'||(CASE WHEN regexp_extract(regexp_replace(replace(u,'\','/'),'/+$',''), '[^/]*[^/](\.[^./]+)$', 1)<>'' THEN replace(u,'\','/')||'|' ELSE '' END)||'2026-03-01|2026-04-01' AS filters, CASE WHEN x=o THEN 'normalize' ELSE 'normalize|identifier_expansion' END AS transformations FROM e""")
def plan_queries(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("  find PDF files about '"), F.col("page_id").cast("string"), F.lit("' in "), "url", F.lit(" from last March")).alias("query"))
    planned = query_plan.plan_queries(pages, TODAY)
    listed = lambda c: F.array_join(c, "|")
    return planned.select("page_id", "normalized_query", listed("search_queries").alias("search_queries"), listed("exact_terms").alias("exact_terms"), listed("filters.value").alias("filters"), listed("transformations.kind").alias("transformations"))


# text


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY doc_id, term")
def tokenize_counts(spark, sf_dir):
    terms = load(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"""WITH a AS (SELECT item_id, list_distinct({tok('text')}) AS t FROM benchmark), b AS (SELECT doc_id, list_distinct({tok('text')}) AS t FROM documents),
x AS (SELECT item_id, unnest(t) AS term FROM a), y AS (SELECT doc_id, unnest(t) AS term FROM b),
o AS (SELECT item_id, doc_id, count(*) AS n FROM x JOIN y USING (term) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(n/(len(a.t)+len(b.t)-n), 9) AS similarity FROM o JOIN a USING (item_id) JOIN b USING (doc_id) WHERE n/(len(a.t)+len(b.t)-n) >= 0.1""")
def jaccard_pairs(spark, sf_dir):
    a = load(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokenize(F.col("text"))).alias("t"))
    b = load(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokenize(F.col("text"))).alias("u"))
    x = a.select("item_id", F.size("t").alias("na"), F.explode("t").alias("term"))
    y = b.select("doc_id", F.size("u").alias("nb"), F.explode("u").alias("term"))
    # enough terms in common, counted where a document lies; what is left is compared as sets
    both = y.repartition("doc_id").join(x, "term").groupBy("doc_id", "item_id", "na", "nb").agg(F.count("*").alias("n"))
    near = both.where(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")) >= 0.0999).select("doc_id", "item_id")
    value = T.jaccard(F.col("t"), F.col("u"))
    return near.join(a, "item_id").join(b, "doc_id").where(value >= 0.1).select("item_id", "doc_id", F.round(value, 9).alias("similarity"))


STOP = ",".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH c AS (SELECT a.conv_id, a.turn, list_distinct(list_filter({tok('a.text')}, lambda x: x NOT IN ({STOP}))) AS t, list_distinct({tok('b.text')}) AS u
 FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND a.turn=b.turn+1)
SELECT conv_id, turn, len(t)>0 AND len(list_intersect(t,u)) >= (CASE WHEN len(t)<=2 THEN 1 ELSE (len(t)+1)//2 END) AS supported FROM c""")
def lexical_support(spark, sf_dir):
    a = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("claim"))
    b = load(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.has_support(F.col("claim"), F.col("text")).alias("supported"))


NORM = r"trim(regexp_replace(replace(lower({}),'ß','ss'), '\s+', ' ', 'g'))"


@query(f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON {NORM.format('b.text')}<>'' AND contains({NORM.format('d.text')}, {NORM.format('b.text')})")
def contains_fact(spark, sf_dir):
    facts = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("fact"))
    return T.texts_with_facts(load(spark, sf_dir, "documents"), facts, "doc_id", "item_id")


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_extract(text||' see', '[^.!?\n]*$'), '^[ ,;:\-]+|[ ,;:\-]+$', '', 'g') AS claim, 'doc-'||conv_id||':000' AS chunk_id FROM conversations""")
def claim_extract(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    told = turns.select(F.struct("conv_id", "turn").alias("answer_id"), F.concat("text", F.lit(" see [doc-"), F.col("conv_id").cast("string"), F.lit(":000]")).alias("text"))
    return citations.markers(told).select("answer_id.conv_id", "answer_id.turn", "claim", "chunk_id")


@query("SELECT doc_id, length(text)-length(replace(text, chr(10), '')) AS n_lines FROM documents")
def line_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).cast("long").alias("n_lines"))


# chunking


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text)/500) AS BIGINT)))) AS chunk_no FROM documents)
SELECT doc_id, chunk_no, chunk_no*500 AS start, least(chunk_no*500+500, length(text)) AS "end", text[chunk_no*500+1:chunk_no*500+500] AS chunk_text FROM w WHERE regexp_matches(text[chunk_no*500+1:chunk_no*500+500], '\\S')""")
def window_chunks(spark, sf_dir):
    cut = chunking.windows(load(spark, sf_dir, "documents").select("doc_id", "text"), 500)
    return cut.select("doc_id", long("chunk_no"), long("start"), long("end"), "chunk_text")


BLOCKS = """blocks AS (SELECT conv_id, turn, text, CASE WHEN role='system' THEN 'heading' WHEN turn%5=3 THEN 'code' ELSE 'paragraph' END AS kind,
 CASE WHEN turn%4=1 THEN NULL ELSE turn//3 END AS page, CASE WHEN turn%6<2 THEN NULL ELSE 's'||(turn//4) END AS section FROM conversations),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS group_no FROM (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR kind='code' OR lag(kind) OVER w='code' OR kind='heading' OR lag(page) OVER w<>page OR lag(section) OVER w<>section THEN 1 ELSE 0 END AS opens
 FROM blocks WHERE regexp_matches(text,'\\S') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))),
spans AS (SELECT *, coalesce(sum(length(text)+2) OVER (PARTITION BY conv_id, group_no ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS s FROM grouped)"""


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), turn.alias("block_no"), "text",
        F.when(F.col("role") == "system", "heading").when(turn % 5 == 3, "code").otherwise("paragraph").alias("kind"),
        F.when(turn % 4 != 1, F.floor(turn / 3)).alias("page"),
        F.when(turn % 6 >= 2, F.concat(F.lit("s"), F.floor(turn / 4).cast("string"))).alias("section"),
        F.lit(1).alias("line_start"), F.lit(0).alias("char_start"),
    )


@query(f"WITH {BLOCKS} SELECT conv_id AS document_id, turn AS block_no, kind, group_no::BIGINT AS group_no, s AS span_start, s+length(text) AS span_end FROM spans")
def prose_groups(spark, sf_dir):
    spans = chunking.group_spans(chunking.prose_groups(blocks_of(spark, sf_dir)))
    return spans.select("document_id", "block_no", "kind", long("group_no"), long("span_start"), long("span_end"))


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = chunking.group_spans(chunking.prose_groups(blocks_of(spark, sf_dir)))
    cut = chunking.windows(chunking.group_texts(spans), 300).select("document_id", "group_no", "chunk_no", "start", "end")
    return chunking.project_spans(cut, spans)


PROJECTED = f"""{BLOCKS},
gt AS (SELECT conv_id, group_no, string_agg(text, chr(10)||chr(10) ORDER BY turn) AS body FROM grouped GROUP BY conv_id, group_no),
cut AS (SELECT conv_id, group_no, chunk_no, chunk_no*300 AS a, least(chunk_no*300+300, length(body)) AS b FROM (SELECT *, unnest(range(0, CAST(ceil(length(body)/300) AS BIGINT))) AS chunk_no FROM gt) WHERE regexp_matches(body[chunk_no*300+1:chunk_no*300+300], '\\S')),
pr AS (SELECT conv_id, group_no, chunk_no, turn, page, section, text, greatest(a,s)-s AS x, least(b,s+length(text))-s AS y FROM cut JOIN spans USING (conv_id, group_no) WHERE greatest(a,s)<least(b,s+length(text))),
loc AS (SELECT *, 1+length(text[1:x])-length(replace(text[1:x],chr(10),'')) AS l0, length(text[x+1:y])-length(replace(text[x+1:y],chr(10),'')) AS dl, CASE WHEN suffix(text[x+1:y],chr(10)) THEN 1 ELSE 0 END AS nl FROM pr)"""


@query(f"WITH {PROJECTED} SELECT conv_id AS document_id, group_no::BIGINT AS group_no, chunk_no, turn AS block_no, x AS char_start, y AS char_end, l0 AS line_start, l0+dl-nl AS line_end FROM loc")
def span_projection(spark, sf_dir):
    return projected(spark, sf_dir).select("document_id", long("group_no"), long("chunk_no"), "block_no", long("char_start"), long("char_end"), long("line_start"), long("line_end"))


@query(f"""WITH {PROJECTED} SELECT conv_id AS document_id, group_no::BIGINT AS group_no, chunk_no, CASE WHEN count(DISTINCT page)=1 THEN min(page) END AS page, CASE WHEN count(DISTINCT section)=1 THEN min(section) END AS section,
min(l0) AS line_start, max(l0+dl-nl) AS line_end, min(x) AS char_start, max(y) AS char_end, count(*) AS n_locations FROM loc GROUP BY conv_id, group_no, chunk_no""")
def metadata_merge(spark, sf_dir):
    merged = chunking.merge_locations(projected(spark, sf_dir), "document_id", "group_no", "chunk_no")
    return merged.select("document_id", long("group_no"), long("chunk_no"), long("page"), "section", long("line_start"), long("line_end"), long("char_start"), long("char_end"), "n_locations")


def packs_sql(source: str, size: int, overlap: int) -> str:
    """Common table expressions that end in ct: document_id, text, cuts; of a source with document_id and text."""
    return rf"""se AS (SELECT document_id, text, regexp_extract_all(text, '(?s).+?(?:[.!?] |\n|$)') AS parts FROM {source} WHERE text<>''),
sb AS (SELECT document_id, text, len(parts) AS m, list_transform(range(1, len(parts)+1), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p)))::BIGINT) AS ends, list_transform(parts, lambda p: length(p)) AS sizes FROM se),
wk AS (SELECT document_id, 0::BIGINT AS k, 1::BIGINT AS ps, []::STRUCT(a BIGINT, b BIGINT)[] AS cuts FROM sb
 UNION ALL SELECT document_id, j, CASE WHEN big THEN j+1 WHEN ps=j OR ends[j]-(ends[ps]-sizes[ps])<={size} THEN ps ELSE coalesce(list_filter(range(ps, j), lambda i: ends[j-1]-(ends[i]-sizes[i])<={overlap} AND ends[j]-(ends[i]-sizes[i])<={size})[1], j) END,
  CASE WHEN big THEN list_concat(CASE WHEN ps<j THEN list_append(cuts, {{'a': ends[ps]-sizes[ps], 'b': ends[j-1]}}) ELSE cuts END, list_transform(range(ends[j]-sizes[j], ends[j], {size}), lambda a: {{'a': a, 'b': least(a+{size}, ends[j])}}))
  WHEN ps=j OR ends[j]-(ends[ps]-sizes[ps])<={size} THEN cuts ELSE list_append(cuts, {{'a': ends[ps]-sizes[ps], 'b': ends[j-1]}}) END
  FROM (SELECT wk.*, wk.k+1 AS j, sb.m, sb.ends, sb.sizes, sb.sizes[wk.k+1]>{size} AS big FROM wk JOIN sb USING (document_id) WHERE wk.k<sb.m)),
ct AS (SELECT wk.document_id, sb.text, CASE WHEN ps<=m THEN list_append(cuts, {{'a': ends[ps]-sizes[ps], 'b': ends[m]}}) ELSE cuts END AS cuts FROM wk JOIN sb USING (document_id) WHERE wk.k=sb.m)"""


@query(rf"""WITH RECURSIVE {CHUNKS}, {packs_sql("chunks", 500, 50)}, u AS (SELECT document_id, text, unnest(cuts) AS c, generate_subscripts(cuts, 1)-1 AS chunk_no FROM ct)
SELECT document_id, chunk_no, c.a AS start, c.b AS "end", text[c.a+1:c.b] AS chunk_text FROM u WHERE regexp_matches(text[c.a+1:c.b], '\S')""")
def sentence_chunks(spark, sf_dir):
    policy = chunking.ChunkingPolicy(target_size=500, overlap=50)
    groups = chunks_of(spark, sf_dir).select("document_id", F.lit(1).cast("long").alias("group_no"), F.lit("paragraph").alias("kind"), "language", "source_path", "text")
    return chunking.chunk_groups(groups, policy).select("document_id", long("chunk_no"), long("start"), long("end"), "chunk_text")


POLICY_400 = chunking.ChunkingPolicy(target_size=400, overlap=40)


@query(rf"""WITH RECURSIVE {BLOCKS}, gx AS (SELECT conv_id, group_no, min(kind) AS kind, string_agg(text, chr(10)||chr(10) ORDER BY turn) AS body FROM grouped GROUP BY conv_id, group_no),
gp AS (SELECT conv_id||'/'||group_no AS document_id, body AS text FROM gx WHERE kind<>'code'), {packs_sql("gp", 400, 40)},
al AS (SELECT conv_id, group_no, body, 'sentence' AS chunker, cuts FROM gx JOIN ct ON ct.document_id=gx.conv_id||'/'||gx.group_no WHERE kind<>'code'
 UNION ALL SELECT conv_id, group_no, body, 'blank-lines', list_transform(range(0, length(body), 400), lambda a: {{'a': a, 'b': least(a+400, length(body))}}) FROM gx WHERE kind='code'),
uc AS (SELECT conv_id, group_no, body, chunker, unnest(cuts) AS c, generate_subscripts(cuts, 1) AS n FROM al),
kc AS (SELECT conv_id, group_no, chunker, n, c.a AS a, c.b AS b, body[c.a+1:c.b] AS chunk_text, row_number() OVER (PARTITION BY conv_id ORDER BY group_no, n)-1 AS ordinal FROM uc WHERE regexp_matches(body[c.a+1:c.b], '\S')),
pg AS (SELECT kc.conv_id, kc.group_no, kc.n, CASE WHEN count(DISTINCT page)=1 THEN min(page) END AS page, CASE WHEN count(DISTINCT section)=1 THEN min(section) END AS section FROM kc JOIN spans USING (conv_id, group_no) WHERE greatest(a,s)<least(b,s+length(text)) GROUP BY kc.conv_id, kc.group_no, kc.n)
SELECT conv_id::VARCHAR||':'||left(sha256(to_json({{'chunk_text': chunk_text, 'document_id': conv_id::VARCHAR, 'ordinal': ordinal, 'policy': '{POLICY_400.version}'}})::VARCHAR),16) AS chunk_id, conv_id::VARCHAR AS document_id, ordinal::BIGINT AS ordinal, chunk_text, page::BIGINT AS page, section, chunker FROM kc JOIN pg USING (conv_id, group_no, n)""")
def chunk_documents(spark, sf_dir):
    blocks = blocks_of(spark, sf_dir).withColumns({"document_id": F.col("document_id").cast("string"), "source_path": F.lit("a.txt"), "language": F.lit(None).cast("string")})
    return chunking.chunk_documents(blocks, POLICY_400).select("chunk_id", "document_id", long("ordinal"), "chunk_text", long("page"), "section", "chunker")


@query(r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS l FROM documents), u AS (SELECT doc_id, text, len(l) AS n, generate_subscripts(l,1)-1 AS k, unnest(l) AS s FROM p),
o AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS e, length(regexp_extract(s, '\S+')) AS w FROM u),
a AS (SELECT doc_id, text, n, k//80 AS chunk_no, e-w AS start FROM o WHERE k%80=0 AND (k=0 OR k<n-20))
SELECT a.doc_id, a.chunk_no, a.start, b.e AS "end", least(100, a.n-a.chunk_no*80) AS n_tokens, sha256(a.text[a.start+1:b.e]) AS text_sha256 FROM a JOIN o b ON b.doc_id=a.doc_id AND b.k=least(a.n, a.chunk_no*80+100)-1""")
def token_windows(spark, sf_dir):
    """Windows of 100 tokens, 20 of them the last ones before, over whole documents; words are the tokens."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("group_no"), "text")
    found = chunking.token_windows(docs, chunking.word_offsets, 100, 20)
    return found.select(F.col("document_id").alias("doc_id"), long("chunk_no"), long("start"), long("end"), long("n_tokens"), F.sha2("chunk_text", 256).alias("text_sha256"))


def vowels(texts: list[str]) -> list[list[float]]:
    """Stand-in for an embedding: how often each vowel stands in a text."""
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


COUNTS = ", ".join(f"length(s)-length(replace(s,'{c}','')) AS v{c}" for c in "aeiou")
SUMS = ", ".join(f"sum(v{c}) OVER w AS s{c}" for c in "aeiou")
LIKENESS = "({}) / sqrt((({})*({}))::DOUBLE)".format(*["+".join(f"{a}{c}*{b}{c}" for c in "aeiou") for a, b in ("sv", "ss", "vv")])


@query(rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s).+?(?:[.!?] |\n|\z)') AS l FROM documents), u AS (SELECT doc_id, generate_subscripts(l,1)-1 AS sent_no, unnest(l) AS s FROM p),
c AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, {COUNTS} FROM u),
w AS (SELECT *, {SUMS} FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY sent_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE WHEN sa IS NOT NULL AND sa+se+si+so+su>0 AND va+ve+vi+vo+vu>0 THEN {LIKENESS} END AS similarity FROM w)
SELECT doc_id, sent_no, start, round(similarity,9) AS similarity, sum(CASE WHEN similarity>=0.8 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_no)::BIGINT AS topic FROM n""")
def semantic_boundaries(spark, sf_dir):
    """Where sentences turn to another topic, by a stand-in embedding, over whole documents."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("group_no"), "text")
    found = chunking.semantic_boundaries(docs, vowels, 0.8, 3)
    return found.select(F.col("document_id").alias("doc_id"), long("sent_no"), long("start"), F.round("similarity", 9).alias("similarity"), long("topic"))


SUFFIXES = (*chunking.CODE_LANGUAGES, ".txt", ".md")
LANGUAGES = " ".join(f"WHEN {n} THEN '{chunking.CODE_LANGUAGES[s]}'" for n, s in enumerate(SUFFIXES) if s in chunking.CODE_LANGUAGES)


@query(f"SELECT doc_id, CASE doc_id%{len(SUFFIXES)} {LANGUAGES} END AS language FROM documents")
def code_language(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    path = F.concat(F.lit("src/a.b"), F.col("doc_id").cast("string"), F.upper(suffix))
    return load(spark, sf_dir, "documents").select("doc_id", chunking.suffix_language(path).alias("language"))


# retrieval


@query(f"WITH {CHUNKS} SELECT count(*) AS n_chunks, round(avg(len({tok('text')})), 9) AS avg_tokens FROM chunks")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(chunks_of(spark, sf_dir)).select("n_chunks", F.round("avg_tokens", 9).alias("avg_tokens"))


@query(f"WITH {CHUNKS}, {bm25_sql('r')} SELECT qid, chunk_id, round(score,9) AS score, rank FROM r WHERE rank<=10")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(chunks_of(spark, sf_dir), item_queries(spark, sf_dir), 10).select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"))


@query(f"WITH {CHUNKS}, f AS (SELECT * FROM chunks WHERE {SUFFIX}='.pdf' AND created_at>='2026-03-01' AND created_at<'2026-07-01'), {bm25_sql('r', 'f')} SELECT qid, chunk_id, round(score,9) AS score, rank FROM r WHERE rank<=10")
def bm25_filtered(spark, sf_dir):
    kept = filters.filter_chunks(chunks_of(spark, sf_dir), FILTERS)
    return lexical.bm25(kept, item_queries(spark, sf_dir), 10).select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"))


@query(f"WITH {CHUNKS}, {bm25_sql('r')} SELECT qid, chunk_id, matched AS matched_terms FROM r WHERE rank<=5")
def matched_terms(spark, sf_dir):
    return lexical.bm25(chunks_of(spark, sf_dir), item_queries(spark, sf_dir), 5).select("qid", "chunk_id", F.array_join("matched_terms", " ").alias("matched_terms"))


VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


DENSE = f"""{VECTORS}, dn AS (SELECT q.vec_id AS qid, lpad(v.vec_id::VARCHAR,12,'0') AS chunk_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1]*p[2])) AS score FROM v q, v WHERE q.vec_id%20=0),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM dn)"""


@query(f"WITH {DENSE} SELECT qid, chunk_id, round(score,6) AS score, rank FROM dr WHERE rank<=10")
def dense_topk(spark, sf_dir):
    return dense.dense(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("qid", "chunk_id", F.round("score", 6).alias("score"), long("rank"))


@query("SELECT 'doc-'||doc_id||':000' AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, sf_dir):
    have = load(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc-"), F.col("vec_id").cast("string"), F.lit(":000")).alias("chunk_id"))
    return dense.missing_vectors(chunks_of(spark, sf_dir), have)


def weights_of(df: DataFrame, key: str) -> DataFrame:
    """Stand-in for learned weights: the logarithm of one more than the term's count."""
    terms = df.select(F.col(key), F.explode(T.tokenize(F.col("text"))).alias("term"))
    return terms.groupBy(key, "term").agg(F.round(F.log(1.0 + F.count("*")), 6).alias("weight"))


@query(f"""WITH {CHUNKS}, cw AS (SELECT chunk_id, term, round(ln(1.0::DOUBLE+count(*)),6) AS w FROM (SELECT chunk_id, unnest({tok('text')}) AS term FROM chunks) GROUP BY chunk_id, term),
qw AS (SELECT qid, term, round(ln(1.0::DOUBLE+count(*)),6) AS u FROM (SELECT item_id AS qid, unnest({tok('text')}) AS term FROM benchmark) GROUP BY qid, term),
h AS (SELECT qid, chunk_id, list_sum(list(w*u ORDER BY term)) AS score FROM cw JOIN qw USING (term) GROUP BY qid, chunk_id),
a AS (SELECT b.item_id AS qid, c.chunk_id, coalesce(h.score, 0) AS score FROM benchmark b CROSS JOIN chunks c LEFT JOIN h ON h.qid=b.item_id AND h.chunk_id=c.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM a)
SELECT qid, chunk_id, round(score,9) AS score, rank FROM r WHERE rank<=10""")
def sparse_dot(spark, sf_dir):
    chunks, items = chunks_of(spark, sf_dir), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    found = dense.sparse(weights_of(chunks, "chunk_id"), weights_of(items, "qid"), chunks, items, 10)
    return found.select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"))


META = f"""mt AS (SELECT chunk_id, unnest(list_distinct({tok("concat_ws(' ', source_path, language, created_at)")})) AS term FROM chunks),
mq AS (SELECT page_id AS qid, unnest(list_distinct({tok("'notes de '||replace(url,'/',' ')||' 2026-03-09 src3'")})) AS term FROM pages),
ms AS (SELECT qid, chunk_id, count(*)::DOUBLE AS score FROM mt JOIN mq USING (term) GROUP BY qid, chunk_id),
mr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM ms)"""


@query(f"WITH {CHUNKS}, {META} SELECT qid, chunk_id, score, rank FROM mr WHERE rank<=10")
def metadata_overlap(spark, sf_dir):
    said = F.concat(F.lit("notes de "), F.replace("url", F.lit("/"), F.lit(" ")), F.lit(" 2026-03-09 src3"))
    asked = load(spark, sf_dir, "pages").select(F.col("page_id").alias("qid"), said.alias("query"))
    return dense.metadata_leg(chunks_of(spark, sf_dir), asked, ["source_path", "language", "created_at"], 10).select("qid", "chunk_id", "score", long("rank"))


@query("SELECT o_custkey AS qid, o_orderkey::VARCHAR AS chunk_id, o_totalprice AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS rank FROM orders) WHERE rank<=3")
def rank_candidates(spark, sf_dir):
    scored = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_totalprice").alias("score"))
    return ranking.ranked(scored, 3).select("qid", "chunk_id", "score", long("rank"))


# fusion


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = chunks_of(spark, sf_dir), item_queries(spark, sf_dir)
    counts = lexical.counted(chunks, asked)  # the same for both
    one = lexical.bm25(chunks, asked, 20, counts=counts).select("qid", F.lit("a").alias("list"), "chunk_id", "rank", "score")
    two = lexical.bm25(chunks, asked, 20, k1=0.9, b=0.3, counts=counts).select("qid", F.lit("b").alias("list"), "chunk_id", "rank", "score")
    return one.union(two)


def fused_sql(weights: str = "1.0", name: str = "fu", constant: int = 60) -> str:
    return f"""{bm25_sql('ra')}, {bm25_sql('rb', k1=0.9, b=0.3)},
li AS (SELECT qid, 'a' AS list, chunk_id, rank, score FROM ra WHERE rank<=20 UNION ALL SELECT qid, 'b', chunk_id, rank, score FROM rb WHERE rank<=20),
fs AS (SELECT qid, chunk_id, list_sum(list(({weights})::DOUBLE/({constant}.0::DOUBLE+rank) ORDER BY list)) AS score, min(rank) AS best, count(*) AS n_lists FROM li GROUP BY qid, chunk_id),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best, chunk_id) AS rank FROM fs)"""


@query(f"WITH {CHUNKS}, {fused_sql()} SELECT qid, chunk_id, round(score,12) AS score, best AS best_rank, rank FROM fu WHERE rank<=15")
def rrf_fuse(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(ranked_lists(spark, sf_dir), 15).select("qid", "chunk_id", F.round("score", 12).alias("score"), long("best_rank"), long("rank"))


@query(f"WITH {CHUNKS}, {fused_sql(chr(39).join(['CASE list WHEN ', 'b', ' THEN 0.25 ELSE 2.0 END']), constant=10)} SELECT qid, chunk_id, round(score,12) AS score, rank FROM fu WHERE rank<=15")
def rrf_weighted(spark, sf_dir):
    found = fusion.reciprocal_rank_fusion(ranked_lists(spark, sf_dir), 15, 10, {"a": 2.0, "b": 0.25})
    return found.select("qid", "chunk_id", F.round("score", 12).alias("score"), long("rank"))


@query(f"WITH {CHUNKS}, {fused_sql()}, t AS (SELECT qid, chunk_id FROM fu WHERE rank<=15) SELECT qid, chunk_id, list, rank AS list_rank, round(score,9) AS raw_score, round(1.0::DOUBLE/(60.0::DOUBLE+rank),12) AS contribution FROM li JOIN t USING (qid, chunk_id)")
def rrf_signals(spark, sf_dir):
    found = fusion.reciprocal_rank_fusion(ranked_lists(spark, sf_dir), 15).select("qid", "chunk_id", F.explode("signals").alias("s"))
    return found.select("qid", "chunk_id", "s.list", F.col("s.rank").cast("long").alias("list_rank"), F.round("s.raw_score", 9).alias("raw_score"), F.round("s.rrf_contribution", 12).alias("contribution"))


@query(f"""WITH {CHUNKS}, {fused_sql()},
one AS (SELECT qid, chunk_id, round(score,9) AS score, rank FROM ra WHERE rank<=10 AND qid%2=0), two AS (SELECT qid, chunk_id, round(score,9) AS score, rank FROM fu WHERE rank<=10 AND qid%2=1)
SELECT * FROM one UNION ALL SELECT * FROM two""")
def variant_fusion(spark, sf_dir):
    lists = ranked_lists(spark, sf_dir).where("list = 'a' or qid % 2 = 1")
    return fusion.fuse_variants(lists, 10).select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"))


@query(f"""WITH {CHUNKS}, {bm25_sql('ra')}, s AS (SELECT qid, chunk_id, rank AS pre_rank, (hash_key*7919%1000)/1000.0::DOUBLE AS score FROM (SELECT *, CAST(regexp_extract(chunk_id,'[0-9]+') AS BIGINT)+qid AS hash_key FROM ra WHERE rank<=10))
SELECT qid, chunk_id, score, pre_rank, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s""")
def rerank_order(spark, sf_dir):
    found = lexical.bm25(chunks_of(spark, sf_dir), item_queries(spark, sf_dir), 10).select("qid", "chunk_id", "score", "rank")
    new = ((F.regexp_extract("chunk_id", "[0-9]+", 0).cast("long") + F.col("qid")) * 7919 % 1000) / 1000.0
    out = fusion.rerank(found, found.select("qid", "chunk_id", new.alias("new_score")))
    return out.select("qid", "chunk_id", "score", long("pre_rank"), long("rank"))


def candidates_of(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    found = lexical.bm25(chunks, item_queries(spark, sf_dir), limit).select("qid", "chunk_id", "score", "rank")
    return found.join(chunks.select("chunk_id", F.concat(F.lit("g"), (F.regexp_extract("chunk_id", "[0-9]+", 0).cast("long") % 3).cast("string")).alias("document_id"), "text", "source_path", "page"), "chunk_id")


CAND = f"""{bm25_sql('ra')}, ca AS (SELECT qid, rank, chunk_id, score, 'g'||(CAST(regexp_extract(chunk_id,'[0-9]+') AS BIGINT)%3) AS document_id, text, source_path, page, list_distinct({tok('text')}) AS t FROM ra JOIN chunks USING (chunk_id) WHERE rank<=10)"""
SIM = "(CASE WHEN len({a})=0 OR len({b})=0 THEN 0.0::DOUBLE ELSE len(list_intersect({a},{b}))/(len({a})+len({b})-len(list_intersect({a},{b}))) END)"
NEAR = f"""pairs AS MATERIALIZED (SELECT x.qid, x.rank AS r1, y.rank AS r2 FROM ca x JOIN ca y ON x.qid=y.qid AND x.rank<y.rank WHERE {SIM.format(a='x.t', b='y.t')} >= 0.5),
walk AS (SELECT qid, 1::BIGINT AS r, [1::BIGINT] AS acc FROM ca WHERE rank=1
 UNION ALL SELECT w.qid, c.rank, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.qid=w.qid AND p.r2=c.rank AND list_contains(w.acc, p.r1)) THEN w.acc ELSE list_append(w.acc, c.rank) END FROM walk w JOIN ca c ON c.qid=w.qid AND c.rank=w.r+1),
kept AS (SELECT qid, unnest(acc) AS rank FROM (SELECT qid, arg_max(acc, r) AS acc FROM walk GROUP BY qid))"""


@query(f"WITH RECURSIVE {CHUNKS}, {CAND}, {NEAR} SELECT qid, chunk_id, rank FROM kept JOIN ca USING (qid, rank)")
def neardup_filter(spark, sf_dir):
    return selection.near_duplicates_out(candidates_of(spark, sf_dir), 0.5).select("qid", "chunk_id", long("rank"))


@query(f"WITH {CHUNKS}, {CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY rank)>1 AS again FROM ca) SELECT qid, chunk_id, rank, row_number() OVER (PARTITION BY qid ORDER BY again, rank) AS position FROM n")
def document_first(spark, sf_dir):
    return selection.document_first(candidates_of(spark, sf_dir)).select("qid", "chunk_id", long("rank"), long("position"))


FILL = """fill AS (SELECT qid, 0::BIGINT AS p, 0::BIGINT AS used, []::BIGINT[] AS took FROM (SELECT DISTINCT qid FROM ord)
 UNION ALL SELECT f.qid, o.position, CASE WHEN f.used+length(o.text)<=4000 THEN f.used+length(o.text) ELSE f.used END, CASE WHEN f.used+length(o.text)<=4000 THEN list_append(f.took, o.position) ELSE f.took END FROM fill f JOIN ord o ON o.qid=f.qid AND o.position=f.p+1),
done AS (SELECT qid, unnest(took) AS position, generate_subscripts(took,1) AS context_order FROM (SELECT qid, arg_max(took, p) AS took FROM fill GROUP BY qid))"""


@query(f"WITH RECURSIVE {CHUNKS}, {CAND}, ord AS (SELECT *, rank AS position FROM ca), {FILL} SELECT qid, chunk_id, position, length(text) AS cost, context_order FROM done JOIN ord USING (qid, position)")
def budget_fill(spark, sf_dir):
    found = selection.fill_budget(candidates_of(spark, sf_dir).withColumn("position", F.col("rank")), 4000)
    return found.select("qid", "chunk_id", long("position"), "cost", long("context_order"))


@query(f"""WITH RECURSIVE {CHUNKS}, {CAND}, {NEAR}, n AS (SELECT ca.*, row_number() OVER (PARTITION BY qid, document_id ORDER BY rank)>1 AS again FROM kept JOIN ca USING (qid, rank)),
ord AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY again, rank) AS position FROM n), {FILL} SELECT qid, chunk_id, position, length(text) AS cost, context_order FROM done JOIN ord USING (qid, position)""")
def select_context(spark, sf_dir):
    found = selection.select_context(candidates_of(spark, sf_dir), 4000, 0.5)
    return found.select("qid", "chunk_id", long("position"), "cost", long("context_order"))


MMR = f"""cn AS (SELECT qid, rank, chunk_id, t, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score-min(score) OVER w)/(max(score) OVER w-min(score) OVER w) END AS rel FROM ca WINDOW w AS (PARTITION BY qid)),
sm AS MATERIALIZED (SELECT x.qid, x.rank AS r1, y.rank AS r2, {SIM.format(a='x.t', b='y.t')} AS s FROM cn x JOIN cn y ON x.qid=y.qid AND x.rank<>y.rank),
st AS (SELECT qid, 0 AS n, []::BIGINT[] AS took, NULL::BIGINT AS pick, NULL::DOUBLE AS value FROM (SELECT DISTINCT qid FROM cn)
 UNION ALL SELECT qid, n+1, list_append(took, b.pick), b.pick, b.value FROM (SELECT s.qid, s.n, s.took, (SELECT {{'pick': c.rank, 'value': 0.8::DOUBLE*c.rel-(1.0::DOUBLE-0.8::DOUBLE)*coalesce((SELECT max(sm.s) FROM sm WHERE sm.qid=c.qid AND sm.r1=c.rank AND list_contains(s.took, sm.r2)),0.0::DOUBLE)}}
  FROM cn c WHERE c.qid=s.qid AND NOT list_contains(s.took, c.rank) ORDER BY 0.8::DOUBLE*c.rel-(1.0::DOUBLE-0.8::DOUBLE)*coalesce((SELECT max(sm.s) FROM sm WHERE sm.qid=c.qid AND sm.r1=c.rank AND list_contains(s.took, sm.r2)),0.0::DOUBLE) DESC, c.rank LIMIT 1) AS b FROM st s WHERE s.n<5) WHERE b IS NOT NULL)"""


@query(f"WITH RECURSIVE {CHUNKS}, {CAND}, {MMR} SELECT st.qid, cn.chunk_id, round(st.value, 9) AS diversity_score, st.n::BIGINT AS rank FROM st JOIN cn ON cn.qid=st.qid AND cn.rank=st.pick WHERE st.n>0")
def mmr_diversify(spark, sf_dir):
    return selection.diversify(candidates_of(spark, sf_dir), 5).select("qid", "chunk_id", F.round("diversity_score", 9).alias("diversity_score"), long("rank"))


FORMS = r"""qf AS (SELECT item_id, o, trim(regexp_replace(regexp_replace(regexp_replace(o, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_./\\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS o FROM benchmark)),
qv AS (SELECT item_id*10 AS qid, o AS query FROM qf WHERE o<>'' UNION ALL SELECT item_id*10+1, x FROM qf WHERE o<>'' AND x<>'' AND x<>o)"""
HYBRID = f"""{FORMS}, {bm25_sql('hb', queries='SELECT qid, query FROM qv')},
hmt AS (SELECT chunk_id, unnest(list_distinct({tok("concat_ws(' ', source_path, language, created_at)")})) AS term FROM chunks),
hmq AS (SELECT qid, unnest(list_distinct({tok('query')})) AS term FROM qv),
hm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, count(*)::DOUBLE AS score FROM hmt JOIN hmq USING (term) GROUP BY qid, chunk_id)),
hcw AS (SELECT chunk_id, term, round(ln(1.0::DOUBLE+count(*)),6) AS w FROM (SELECT chunk_id, unnest({tok('text')}) AS term FROM chunks) GROUP BY chunk_id, term),
hqw AS (SELECT item_id, term, round(ln(1.0::DOUBLE+count(*)),6) AS u FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY item_id, term),
hh AS (SELECT item_id, chunk_id, list_sum(list(w*u ORDER BY term)) AS score FROM hcw JOIN hqw USING (term) GROUP BY item_id, chunk_id),
hs AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT v.qid, c.chunk_id, coalesce(hh.score, 0) AS score FROM qv v CROSS JOIN chunks c LEFT JOIN hh ON hh.item_id=v.qid//10 AND hh.chunk_id=c.chunk_id)),
hl AS (SELECT qid//10 AS qid, 'query_'||(qid%10)||':bm25' AS list, chunk_id, rank FROM hb WHERE rank<=50 UNION ALL SELECT qid//10, 'query_'||(qid%10)||':metadata', chunk_id, rank FROM hm WHERE rank<=50 UNION ALL SELECT qid//10, 'query_'||(qid%10)||':sparse', chunk_id, rank FROM hs WHERE rank<=50),
hf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best, chunk_id) AS rank FROM (SELECT qid, chunk_id, list_sum(list(1.0::DOUBLE/(60.0::DOUBLE+rank) ORDER BY list)) AS score, min(rank) AS best FROM hl GROUP BY qid, chunk_id))"""


@query(f"WITH {CHUNKS}, {HYBRID} SELECT qid, chunk_id, round(score,12) AS score, rank FROM hf WHERE rank<=10")
def hybrid_pipeline(spark, sf_dir):
    chunks, asked = chunks_of(spark, sf_dir), item_queries(spark, sf_dir)
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    models = stages.Models(chunk_weights=weights_of(chunks, "chunk_id"), query_weights=weights_of(items, "qid"))
    return stages.search(chunks, asked, "hybrid", 10, models=models).select("qid", "chunk_id", F.round("score", 12).alias("score"), long("rank"))


VOWELS = "+".join("(length({0}.text)-length(replace({0}.text,'%s','')))*(length({1}.text)-length(replace({1}.text,'%s','')))" % (c, c) for c in "aeiou")
FOUR_LEGS = HYBRID.replace("\nhl AS (", f"""
hv AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT v.qid, c.chunk_id, {VOWELS.format('c', 'b')} AS score FROM qv v JOIN benchmark b ON b.item_id=v.qid//10, chunks c)),
hl AS (SELECT qid//10 AS qid, 'query_'||(qid%10)||':vector' AS list, chunk_id, rank FROM hv WHERE rank<=50 UNION ALL """)


def four_legs(spark: SparkSession, sf_dir: str, stage: str, limit: int) -> DataFrame:
    """A stage with words, metadata, learned weights and vectors, and a reranker; stand-ins for the models."""
    chunks, asked = chunks_of(spark, sf_dir), item_queries(spark, sf_dir)
    models = stages.Models(
        chunk_weights=weights_of(chunks, "chunk_id"), query_weights=weights_of(asked.withColumnRenamed("query", "text"), "qid"),
        chunk_vectors=encoders.embedded(chunks, "chunk_id", "text", vowels), query_vectors=encoders.embedded(asked, "qid", "query", vowels),
        rerankers={"rerank_bge": lambda queries, texts: [(len(t) * 7919 + len(q)) % 1000 / 1000 for q, t in zip(queries, texts, strict=True)]},
    )
    return stages.search(chunks, asked, stage, limit, models=models)


@query(f"WITH {CHUNKS}, {FOUR_LEGS} SELECT qid, chunk_id, round(score,12) AS score, rank FROM hf WHERE rank<=10")
def hybrid_vectors(spark, sf_dir):
    return four_legs(spark, sf_dir, "hybrid", 10).select("qid", "chunk_id", F.round("score", 12).alias("score"), long("rank"))


@query(f"""WITH RECURSIVE {CHUNKS}, {FOUR_LEGS},
ca AS MATERIALIZED (SELECT qid, chunk_id, score, t, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT h.qid, h.chunk_id, (length(c.text)*7919+length(b.text))%1000/1000.0::DOUBLE AS score, list_distinct({tok('c.text')}) AS t FROM hf h JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id=h.qid WHERE h.rank<=50)), {MMR}
SELECT st.qid, ca.chunk_id, round(ca.score,9) AS score, st.n::BIGINT AS rank FROM st JOIN ca ON ca.qid=st.qid AND ca.rank=st.pick WHERE st.n>0""")
def rerank_diversified(spark, sf_dir):
    """Fused candidates of four legs, reranked by a model and then diversified."""
    return four_legs(spark, sf_dir, "rerank_bge", 5).select("qid", "chunk_id", F.round("score", 9).alias("score"), long("rank"))


# answers and evaluation


@query(rf"""WITH {CHUNKS}, m AS (SELECT conv_id, turn, regexp_replace(regexp_extract(text||' see', '[^.!?\n]*$'), '^[ ,;:\-]+|[ ,;:\-]+$', '', 'g') AS claim, 'doc-'||conv_id||':000' AS chunk_id FROM conversations),
j AS (SELECT m.*, c.text AS body FROM m LEFT JOIN (SELECT * FROM chunks WHERE page<6) c USING (chunk_id)),
k AS (SELECT *, list_distinct(list_filter({tok('claim')}, lambda x: x NOT IN ({STOP}))) AS t, list_distinct({tok("coalesce(body,'')")}) AS u FROM j)
SELECT conv_id, turn, chunk_id, claim, CASE WHEN body IS NULL THEN 'cited chunk ID is not present in selected evidence' WHEN claim='' THEN 'cited chunk ID has no associated claim'
 WHEN NOT (len(t)>0 AND len(list_intersect(t,u)) >= (CASE WHEN len(t)<=2 THEN 1 ELSE (len(t)+1)//2 END)) THEN 'cited chunk does not support its associated claim' ELSE 'ok' END AS status FROM k""")
def citation_check(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    told = turns.select(F.struct("conv_id", "turn").alias("answer_id"), F.concat("text", F.lit(" see [doc-"), F.col("conv_id").cast("string"), F.lit(":000]")).alias("text"), F.concat(F.lit("doc-"), F.col("conv_id").cast("string"), F.lit(":000")).alias("chunk_id"))
    have = chunks_of(spark, sf_dir).where("page < 6").select("chunk_id", "text", "source_path", "page", F.lit(None).cast("string").alias("section"))
    evidence = told.select("answer_id", "chunk_id").join(have, "chunk_id")
    return citations.check_citations(told.select("answer_id", "text"), evidence).select("answer_id.conv_id", "answer_id.turn", "chunk_id", "claim", "status")


GOLD = f"g AS (SELECT b.item_id AS case_id, c.chunk_id FROM benchmark b JOIN chunks c ON {NORM.format('b.text')}<>'' AND contains({NORM.format('c.text')}, {NORM.format('b.text')}))"
EVAL = f"""WITH {CHUNKS}, {GOLD}, {bm25_sql('ra')}, top AS (SELECT qid AS case_id, chunk_id, rank FROM ra WHERE rank<=3),
ev AS (SELECT case_id, count(rank)/count(*) AS recall, coalesce(1.0::DOUBLE/min(rank), 0) AS reciprocal_rank FROM g LEFT JOIN top USING (case_id, chunk_id) GROUP BY case_id)"""


def cases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("fact"))
    gold = T.texts_with_facts(chunks_of(spark, sf_dir), facts, "chunk_id", "case_id")
    found = lexical.bm25(chunks_of(spark, sf_dir), item_queries(spark, sf_dir), 3).select(F.col("qid").alias("case_id"), "chunk_id", "rank")
    return evaluation.evaluate_retrieval(gold, found, 3)


@query(f"{EVAL} SELECT case_id, round(recall,9) AS recall, round(reciprocal_rank,9) AS reciprocal_rank FROM ev")
def retrieval_eval(spark, sf_dir):
    return cases_of(spark, sf_dir).select("case_id", F.round("recall", 9).alias("recall"), F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


@query(f"{EVAL} SELECT round(avg(recall),9) AS recall, round(avg(reciprocal_rank),9) AS mrr, bool_and(recall=1 AND reciprocal_rank=1) AS no_headroom FROM ev")
def macro_eval(spark, sf_dir):
    return evaluation.macro(cases_of(spark, sf_dir)).select(F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), "no_headroom")


@query("""WITH e AS (SELECT user_id, event_id AS n, value FROM events), f AS (SELECT user_id, arg_min(value, n) AS first_ms, min(n) AS n0 FROM e GROUP BY user_id)
SELECT user_id, round(first_ms,9) AS first_ms, round(coalesce(median(value) FILTER (WHERE n>n0),0),9) AS warm_median_ms FROM e JOIN f USING (user_id) GROUP BY user_id, first_ms""")
def latency_summary(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("n"), F.col("value").alias("ms"))
    runs = evaluation.latencies(e, "user_id")
    return runs.select("user_id", F.round("first_ms", 9).alias("first_ms"), F.round("warm_median_ms", 9).alias("warm_median_ms"))


@query(f"""WITH {CHUNKS}, b AS (SELECT item_id, item_id%5=4 AS abstained, text, 'doc-'||(item_id*3)||':000' AS want, 'doc-'||(item_id*3+CASE WHEN item_id%3=0 THEN 1 ELSE 0 END)||':000' AS got FROM benchmark),
e AS (SELECT b.*, c.text AS body, c.source_path, c.page FROM b LEFT JOIN chunks c ON c.chunk_id=b.got),
w AS (SELECT *, list_distinct(list_filter({tok('text')}, lambda x: x NOT IN ({STOP}))) AS t, list_distinct({tok("coalesce(body,'')")}) AS u,
 contains({NORM.format("coalesce(body,'')")}, {NORM.format('text')}) AS in_evidence FROM e)
SELECT item_id AS case_id, want=got AS retrieval_found_evidence, CASE WHEN NOT abstained THEN in_evidence END AS answer_used_evidence,
 CASE WHEN NOT abstained THEN body IS NOT NULL AND len(t)>0 AND len(list_intersect(t,u)) >= (CASE WHEN len(t)<=2 THEN 1 ELSE (len(t)+1)//2 END) END AS answer_supported,
 CASE WHEN NOT abstained THEN coalesce(page <= 5, false) END AS citations_correct,
 array_to_string(list_filter([CASE WHEN want<>got THEN 'not retrieved: '||want END, CASE WHEN abstained THEN 'no answer was given: use, support and citations have no score' WHEN NOT in_evidence THEN 'a required fact is missing from the answer or from the evidence' END,
 CASE WHEN NOT abstained AND body IS NULL THEN 'cited without being selected: '||got END, CASE WHEN NOT abstained AND page>5 THEN 'cited at another place than its own: '||got END,
 CASE WHEN NOT abstained AND body IS NOT NULL AND NOT (len(t)>0 AND len(list_intersect(t,u)) >= (CASE WHEN len(t)<=2 THEN 1 ELSE (len(t)+1)//2 END)) THEN 'cited for a claim that it doesn''t bear out: '||got END], lambda x: x IS NOT NULL), '; ') AS notes FROM w""")
def rag_case_eval(spark, sf_dir):
    n = F.col("item_id")
    name = lambda k: F.concat(F.lit("doc-"), k.cast("string"), F.lit(":000"))
    items = load(spark, sf_dir, "benchmark").select(n.alias("case_id"), "text", (n % 5 == 4).alias("abstained"), name(n * 3).alias("want"), name(n * 3 + F.when(n % 3 == 0, 1).otherwise(0)).alias("got"))
    gold = items.select("case_id", F.array("want").alias("relevant_chunk_ids"), F.array("text").alias("required_facts"))
    have = chunks_of(spark, sf_dir).select("chunk_id", F.col("text").alias("body"), "source_path", "page")
    evidence = items.join(have, F.col("got") == F.col("chunk_id")).select("case_id", "chunk_id", F.col("body").alias("text"), "source_path", "page", F.lit(None).cast("string").alias("section"))
    cited = items.join(have, F.col("got") == F.col("chunk_id"), "left").select("case_id", F.lit(0).alias("pos"), F.col("text").alias("claim"), F.col("got").alias("chunk_id"), "source_path", F.when(F.col("page") <= 5, F.col("page")).otherwise(99).alias("page"), F.lit(None).cast("string").alias("section"))
    out = evaluation.evaluate_answers(gold, items.select("case_id", "text", "abstained"), items.select("case_id", F.col("got").alias("chunk_id")), evidence, cited)
    return out.withColumn("notes", F.array_join("notes", "; "))


# lifecycle

def life_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is indexed, from each user's first event, and what comes in, from the second."""
    e = load(spark, sf_dir, "events")
    n = F.col("user_id")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    s = e.select("user_id", "event_id", order.alias("n"))
    state = s.where("n = 1 and user_id % 7 <> 0").select(n.cast("string").alias("source_path"), F.concat(F.lit("d"), n.cast("string")).alias("document_id"), F.concat(F.lit("c"), n.cast("string")).alias("checksum"), (n % 3).cast("string").alias("versions"), F.lit(2).alias("n_chunks"), F.lit(2).alias("n_vectors"))
    incoming = s.where("n = 2").select(n.cast("string").alias("source_path"), F.concat(F.lit("n"), n.cast("string")).alias("document_id"), F.when(n % 2 == 0, "x").otherwise(F.concat(F.lit("c"), n.cast("string"))).alias("checksum"), F.lit("1").alias("versions"))
    return state, incoming


LIFE = """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
st AS (SELECT user_id::VARCHAR AS source_path, 'd'||user_id AS document_id, 'c'||user_id AS checksum, (user_id%3)::VARCHAR AS versions FROM s WHERE n=1 AND user_id%7<>0),
inc AS (SELECT user_id::VARCHAR AS source_path, 'n'||user_id AS document_id, CASE WHEN user_id%2=0 THEN 'x' ELSE 'c'||user_id END AS checksum, '1' AS versions FROM s WHERE n=2)"""


@query(f"""WITH {LIFE} SELECT inc.source_path, coalesce(st.document_id, inc.document_id) AS document_id,
CASE WHEN st.checksum IS NULL THEN 'added' WHEN st.checksum=inc.checksum AND st.versions=inc.versions THEN 'skipped' WHEN st.checksum<>inc.checksum THEN 'updated' ELSE 'rebuilt' END AS action FROM inc LEFT JOIN st USING (source_path)""")
def lifecycle_actions(spark, sf_dir):
    state, incoming = life_of(spark, sf_dir)
    return lifecycle.plan_changes(incoming, state).select("source_path", "document_id", "action")


@query(f"WITH {LIFE} SELECT source_path FROM st WHERE source_path NOT IN (SELECT source_path FROM inc WHERE checksum<>'x')")
def snapshot_prune(spark, sf_dir):
    state, incoming = life_of(spark, sf_dir)
    return lifecycle.prune(state, incoming.where("checksum <> 'x'"))


@query(f"WITH {LIFE} SELECT inc.source_path, CASE WHEN st.source_path IS NULL THEN 'missing' ELSE 'deleted' END AS action, CASE WHEN st.source_path IS NULL THEN 0 ELSE 2 END::BIGINT AS n_chunks FROM inc LEFT JOIN st USING (source_path)")
def delete_actions(spark, sf_dir):
    state, incoming = life_of(spark, sf_dir)
    return lifecycle.plan_deletes(incoming, state).select("source_path", "action", long("n_chunks"))


from . import index_queries  # noqa: E402, F401  registers its queries
