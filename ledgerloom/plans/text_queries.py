"""Text, identifier and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..session import table

QUERY = "open threshold of the residual stress in copper foam"


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokenize(F.col("text")))).alias("n_distinct"))


def title_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    grams = table(spark, sf, "papers").select(F.explode(T.char_ngrams(F.col("title"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def normal_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "papers")
    return p.select("uid", T.norm_arxiv(F.col("arxiv_id")).alias("arxiv"), T.norm_doi(F.col("doi")).alias("doi"), T.norm_title(F.col("title")).alias("norm_title"), T.content_hash(F.col("title"), F.col("abstract")).alias("fingerprint"), "retrieved_at")


def normal_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each id's first delivery in one schema."""
    p = table(spark, sf, "papers")
    first = p.groupBy("id").agg(F.min_by(F.struct("uid", "title", "abstract", "authors", "year", "published", "venue"), F.struct("retrieved_at", "uid")).alias("r"))
    year = F.coalesce(F.col("r.year"), F.year("r.published"))
    return first.select("id", F.col("r.uid").alias("uid"), T.clean_ws(F.col("r.title")).alias("title"), T.clean_ws(F.col("r.abstract")).alias("abstract"), F.coalesce(F.size("r.authors"), F.lit(0)).alias("n_authors"), year.alias("year"), T.clean_ws(F.col("r.venue")).alias("venue"))


def df_idf(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1, 6).alias("idf"))


def _weights(spark: SparkSession, sf: str) -> R.BigramWeights:
    return R.BigramWeights(table(spark, sf, "documents"), "doc_id", "text")


def doc_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    top = _weights(spark, sf).top_terms(3)
    return top.select(F.col("id").alias("doc_id"), "term", F.round("weight", 5).alias("weight"), "place")


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return R.postings(table(spark, sf, "papers").groupBy("uid").agg(F.min("title").alias("title"), F.min("abstract").alias("abstract")), "uid", {"title": 3, "abstract": 1})


def _scored(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("uid"), F.round("score", 6).alias("score"), "place")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(R.top_k(R.bm25(_posts(spark, sf), QUERY), 20))


def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(_weights(spark, sf).cosine_to_query(QUERY), 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "place")


def grep_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(R.top_k(R.token_presence(_posts(spark, sf), QUERY), 20))


def rrf_topk(spark: SparkSession, sf: str) -> DataFrame:
    posts = _posts(spark, sf)
    return _scored(R.top_k(R.fuse_ranks([R.bm25(posts, QUERY), R.token_presence(posts, QUERY)]), 20))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The fused ranking with the papers that cite or are cited by its best five."""
    posts, p = _posts(spark, sf), table(spark, sf, "papers")
    ids = p.select("id", "uid").distinct()
    cites = p.select(F.col("uid").alias("src"), F.explode("reference_ids").alias("id")).join(ids, "id").select("src", F.col("uid").alias("dst")).distinct()
    fused = R.fuse_ranks([R.bm25(posts, QUERY), R.token_presence(posts, QUERY)])
    return _scored(R.top_k(R.with_neighbours(fused, cites), 20))


def budget_topk(spark: SparkSession, sf: str) -> DataFrame:
    ranked = R.top_k(R.bm25(_posts(spark, sf), QUERY), 200)
    size = table(spark, sf, "papers").groupBy(F.col("uid").alias("id")).agg(F.length(F.concat_ws(" ", F.min("title"), F.min("abstract"))).alias("cost"))
    return R.within_budget(size.join(F.broadcast(ranked), "id"), "cost", 4000).select(F.col("id").alias("uid"), F.round("score", 6).alias("score"), "place", "cost")


def number_census(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("kind", F.explode(T.extract_numbers(F.col("text"))).alias("number"))
    return d.groupBy("kind", "number").agg(F.count(F.lit(1)).alias("n"))


def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.contains_entity(F.col("text"), F.lit("copper foam")).alias("has_entity"), F.coalesce(T.year_of(F.col("text")), F.lit(0)).alias("first_year")).filter("has_entity OR first_year > 0")


_TOK = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda t: length(t) >= {1})"
_STOP = "('a','an','and','for','from','in','of','on','the','to','with')"
_WORDS = "['" + "','".join(R.query_terms(QUERY)) + "']"
_POSTS = f"""p AS (SELECT uid, min(title) AS title, min(abstract) AS abstract FROM papers GROUP BY 1),
posts AS (SELECT id, term, sum(w) AS tf FROM (SELECT uid AS id, unnest({_TOK.format('title', 2)}) AS term, 3.0::DOUBLE AS w FROM p UNION ALL SELECT uid, unnest({_TOK.format('abstract', 2)}), 1.0::DOUBLE FROM p) GROUP BY 1, 2),
len AS (SELECT id, sum(tf) AS l FROM posts GROUP BY 1), whole AS (SELECT count(*) AS n, avg(l) AS m FROM len),
hits AS (SELECT * FROM posts WHERE term IN (SELECT unnest({_WORDS}))), hdf AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))) AS score FROM hits JOIN hdf USING (term) JOIN len USING (id), whole GROUP BY 1),
gr AS (SELECT id, count(*)::DOUBLE AS score FROM hits GROUP BY 1)"""
_TOP = "SELECT id AS uid, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS place FROM {} WHERE score > 0 ORDER BY place LIMIT 20"
_TFIDF = f"""tk AS (SELECT doc_id, {_TOK.format('text', 2)} AS t FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tk)) GROUP BY 1, 2),
nn AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
dfs AS (SELECT term, df, n FROM (SELECT term, count(*) AS df FROM cnt GROUP BY 1), nn WHERE df >= 2 AND df <= 0.9 * n),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM cnt JOIN dfs USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
_ARXIV = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(arxiv_id)), '^(https?://)?(www\.)?arxiv\.org/(abs|pdf)/', ''), '^arxiv:\s*', ''), '\.pdf$', ''), 'v[0-9]+$', '')), '')"
_DOI = r"nullif(trim(regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://)?(dx\.)?doi\.org/', ''), '^doi:\s*', '')), '')"
_WS = r"nullif(trim(regexp_replace({0}, '\s+', ' ', 'g')), '')"

QUERIES = {f.__name__: f for f in (doc_tokens, title_ngrams, normal_ids, normal_records, df_idf, doc_top_terms, bm25_topk, tfidf_topk, grep_topk, rrf_topk, hybrid_topk, budget_topk, number_census, entity_mentions)}
ORACLE = {
    "doc_tokens": f"SELECT doc_id, CAST(len({_TOK.format('text', 2)}) AS INT) AS n_tokens, CAST(len(list_distinct({_TOK.format('text', 2)})) AS INT) AS n_distinct FROM documents",
    "title_ngrams": r"""WITH s AS (SELECT trim(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g')) AS s FROM papers)
SELECT gram, count(*) AS n FROM (SELECT substr(s, unnest(range(1, greatest(length(s) - 3, 1) + 1)), 4) AS gram FROM s WHERE s <> '') GROUP BY 1""",
    "normal_ids": f"SELECT uid, {_ARXIV} AS arxiv, {_DOI} AS doi, array_to_string(list_filter({_TOK.format('title', 1)}, lambda t: t NOT IN {_STOP}), ' ') AS norm_title, sha1(coalesce(title, '') || chr(0) || coalesce(abstract, '') || chr(0)) AS fingerprint, retrieved_at FROM papers",
    "normal_records": f"""SELECT id, r.uid AS uid, {_WS.format('r.title')} AS title, {_WS.format('r.abstract')} AS abstract, CAST(coalesce(len(r.authors), 0) AS INT) AS n_authors, CAST(coalesce(r.year, year(r.published)) AS INT) AS year, {_WS.format('r.venue')} AS venue
FROM (SELECT id, arg_min({{'uid': uid, 'title': title, 'abstract': abstract, 'authors': authors, 'year': year, 'published': published, 'venue': venue}}, {{'a': retrieved_at, 'b': uid}}) AS r FROM papers GROUP BY id)""",
    "df_idf": f"SELECT term, count(*) AS df, round(ln((1.0 + n) / (1.0 + count(*))) + 1, 6) AS idf FROM (SELECT doc_id, unnest(list_distinct({_TOK.format('text', 2)})) AS term FROM documents), (SELECT count(*) AS n FROM documents) GROUP BY term, n",
    "doc_top_terms": f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 5) AS weight, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS INT) AS place FROM weights) WHERE place <= 3",
    "bm25_topk": f"WITH {_POSTS} {_TOP.format('bm')}",
    "grep_topk": f"WITH {_POSTS} {_TOP.format('gr')}",
    "tfidf_topk": f"WITH {_TFIDF}, sc AS (SELECT doc_id, sum(weight) / sqrt({len(R.query_terms(QUERY))}) AS score FROM weights WHERE term IN (SELECT unnest({_WORDS})) GROUP BY 1) SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS place FROM sc WHERE score > 0 ORDER BY place LIMIT 20",
    "rrf_topk": f"WITH {_POSTS}, ranks AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM gr), fused AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM ranks GROUP BY 1) {_TOP.format('fused')}",
    "number_census": r"SELECT kind, number, count(*) AS n FROM (SELECT kind, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?')) AS number FROM documents) GROUP BY 1, 2",
    "entity_mentions": f"SELECT * FROM (SELECT doc_id, contains(' ' || array_to_string({_TOK.format('text', 1)}, ' ') || ' ', ' copper foam ') AS has_entity, coalesce(TRY_CAST(list_filter(regexp_extract_all(text, '[0-9]{{4}}'), lambda y: CAST(y AS INT) BETWEEN 1500 AND 2100)[1] AS INT), 0) AS first_year FROM documents) WHERE has_entity OR first_year > 0",
}
