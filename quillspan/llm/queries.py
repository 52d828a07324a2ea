"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, jaccard, language, lengths, packing, periodic, planes, sharding, suffixes, vectors, warc
from .common import table


def held_out():
    """Whether a document is kept from the language models."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language.fit_models(docs.where(~held_out()))
    found = language.identify(docs.select("doc_id", "text", held_out().alias("held_out")), models)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_bits").alias("bits"), F.col("lang_rejected").alias("rejected"))


def op2_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digest_windows(chat.format_conversations(rows))


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_table(lengths.length_histogram(table(spark, sf_dir, "documents")))


def op6_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_archives(table(spark, sf_dir, "pages"))


def op9_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.ids_through_files(table(spark, sf_dir, "documents"))


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op11_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic.with_planted_run(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.run_digests(periodic.find_runs(planted, least=24, times=3))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.with_labels(audit.text_failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return audit.audit_filters(rows, {x: F.col(x) for x in "ABCDE"}, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


def op13_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"), least=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kneser_ney_language": op1_kneser_ney_language,
        "op2_cutting_stock_packing": op2_cutting_stock_packing,
        "op3_chat_windows": op3_chat_windows,
        "op4_cgk_decontamination": op4_cgk_decontamination,
        "op5_token_counts": op5_token_counts,
        "op6_pca_tiles": op6_pca_tiles,
        "op7_token_group_join": op7_token_group_join,
        "op8_warc_transactions": op8_warc_transactions,
        "op9_plane_files": op9_plane_files,
        "op10_hash_tree_shards": op10_hash_tree_shards,
        "op11_harmonic_runs": op11_harmonic_runs,
        "op12_filter_audit": op12_filter_audit,
        "op13_suffix_family": op13_suffix_family,
    }


OP6 = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x*x))) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x)))=0),
k AS (SELECT * FROM u WHERE n>0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM k a JOIN k b ON a.vec_id<b.vec_id AND len(a.e)=len(b.e) WHERE list_sum(list_transform(list_zip(a.e,b.e), lambda p: p[1]*p[2]))/(a.n*b.n)>=0.9),
d AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, d.j FROM r JOIN d ON d.i=r.seen)
SELECT r.node AS vec_id, (SELECT count(*) FROM d WHERE d.i=r.node) AS n_links, min(seen) AS component_id, min(seen)=r.node AS kept FROM r GROUP BY r.node"""

OP7 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t)>=3 THEN list_distinct(list_transform(range(1,len(t)-1), lambda i: t[i]||' '||t[i+1]||' '||t[i+2])) WHEN len(t)>0 THEN [array_to_string(t,' ')] ELSE []::VARCHAR[] END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM e a JOIN e b ON a.x=b.x AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT i, j FROM p JOIN s a ON a.doc_id=i JOIN s b ON b.doc_id=j WHERE 100*c>=90*(len(a.sh)+len(b.sh)-c)),
d AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, d.j FROM r JOIN d ON d.i=r.seen)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id FROM s JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node=s.doc_id"""

OP8 = """WITH h AS (SELECT page_id, coalesce(html,'') AS b FROM pages),
x AS (SELECT page_id, b, sha1(b) AS s, min(page_id) OVER (PARTITION BY b) AS f FROM h)
SELECT page_id, strlen(b) AS payload_bytes,
 array_to_string(list_transform(range(0,32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1+CAST((('0x'||substr(s, 1+5*CAST(i//4 AS INT), 5))::BIGINT >> (15-5*CAST(i%4 AS INT))) & 31 AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id=f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id<>f THEN f END AS refers_to FROM x"""


OP11 = """WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i,0,0,0,0,0,0,0,0], lambda c, x: CASE WHEN c&1=1 THEN xor(c>>1, 3988292384) ELSE c>>1 END) AS v FROM (SELECT range AS i FROM range(256)))),
k AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+') AS w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(doc_id::VARCHAR)+1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT), lambda c, b: xor(c>>8, t[xor(c, b)%256+1])), 4294967295) AS h FROM documents, tab),
g AS (SELECT *, len(w) AS n, (h//10)%greatest(len(w),1) AS a FROM k),
p AS (SELECT *, 1+(n-a)//(3+(h//10)%8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN h%10=0 AND n>0 THEN list_transform(range(0,n), lambda i: w[CASE WHEN i<a THEN i ELSE a+(i-a)%p END+1]) ELSE w END AS w FROM p),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(0,n)) AS i FROM d),
e AS (SELECT l.doc_id, r.i-l.i AS q, l.i AS i FROM u l JOIN u r ON l.doc_id=r.doc_id AND l.x=r.x AND r.i>l.i AND 3*(r.i-l.i)<=l.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*)+q AS length FROM (SELECT *, i-row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length>=greatest(24,3*q) GROUP BY 1,2,3),
c AS (SELECT doc_id, i, x FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id=u.doc_id AND u.i>=r.start+r.period AND u.i<r.start+r.length)),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start||','||length||','||period||chr(10), '' ORDER BY start, period) AS lines, list({'s':start,'l':length,'p':period} ORDER BY length::DOUBLE/period DESC, start, period)[1] AS b FROM r GROUP BY 1),
t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs,0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000*b.l//b.p AS exponent_milli, sha256(coalesce(lines,'')) AS runs_sha256, sha256(coalesce(t.text,'')) AS collapsed_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN t USING (doc_id)"""


OP12 = """WITH w AS (SELECT doc_id, coalesce(lang,'') AS part, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text,'')) AS first FROM documents),
l AS (SELECT doc_id, max((quality=1)::INT) AS good, max((toxic=1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good,0) AS good, coalesce(toxic,0) AS toxic, [len(ws)<200, 100*len(list_distinct(ws))<50*len(ws), 100*(length(t)-length(regexp_replace(t,'[A-Z]','','g')))>3*length(t), regexp_matches(t,'[#$%&*|]'), w.doc_id>first] AS x FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, x, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1,2),
i AS (SELECT range AS i FROM range(1,6)),
o AS (SELECT [a.i,b.i,c.i,d.i,e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i,b.i,c.i,d.i,e.i]))=5),
s AS (SELECT array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, i::INT AS step, o[i] AS f, o[:i-1] AS before FROM o, i),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT x[f] AND NOT p THEN n ELSE 0 END) AS kept, sum(CASE WHEN x[f] AND NOT p THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN x[f] AND p THEN n ELSE 0 END) AS redundant, sum(CASE WHEN x[f] AND len(list_filter(x, lambda v: v))=1 THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN x[f] AND NOT p THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN x[f] AND NOT p THEN toxic ELSE 0 END) AS toxic_lost
 FROM (SELECT *, len(list_filter(before, lambda k: x[k]))>0 AS p FROM c, s) GROUP BY 1,2,3,4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f) AS shapley FROM g"""


OP13 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(x)//2-99)) AS i, x FROM d WHERE len(x)>=200),
h AS (SELECT doc_id, i, md5(substr(x, (2*i+1)::INT, 200)) AS h FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM h) WHERE nth>1),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i>before+100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
s AS (SELECT doc_id, min(i) AS low, max(i)+100 AS high FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, high AS low, coalesce(lead(low) OVER (PARTITION BY doc_id ORDER BY low), 1000000000) AS high FROM (SELECT doc_id, low, high FROM s UNION ALL SELECT doc_id, -1, 0 FROM d)),
t AS (SELECT doc_id, string_agg(substr(x, (2*low+1)::INT, (2*(high-low))::INT), '' ORDER BY low) AS x FROM k JOIN d USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_spans, sum(high-low) AS n_removed FROM s GROUP BY 1)
SELECT d.doc_id, len(d.x)//2 AS n_bytes, coalesce(n_removed,0) AS n_removed, coalesce(n_spans,0) AS n_spans, sha256(unhex(t.x)) AS kept_sha256 FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_pca_tiles": OP6, "op7_token_group_join": OP7, "op8_warc_transactions": OP8, "op11_harmonic_runs": OP11, "op12_filter_audit": OP12, "op13_suffix_family": OP13}
