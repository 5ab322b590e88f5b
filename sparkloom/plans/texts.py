"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.languages import analysed, fit_language_profiles
from sparkloom.functions.vectors import projection_hash, projection_matrix
from sparkloom.operators.aggregates import document_frequency
from sparkloom.operators.similarity import greedy_dedup, similar_pairs
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(r"select doc_id, regexp_replace(text, '[\p{P}\p{S}\p{N}]+', ' ', 'g') as cleaned from documents")
def regexp_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), {_quoted(text.TOKEN)}), lambda x: not regexp_matches(x, {_quoted(text.URL_TOKEN)})), ' ') as words from documents")
def url_free(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.without_urls(F.col("text")).alias("words"))


@query(r"""with t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents)
select doc_id, array_to_string(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), '|') as grams from t""")
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    return d.select("doc_id", F.array_join(text.ngrams(F.col("ws")), "|").alias("grams"))


@query(r"""with t as (select unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as term, n_chars from documents),
c as (select term, count(*) as n, max(n_chars) as ts from t group by 1)
select term, round(n / sum(n) over (), 8) as freq, ts from c qualify n / sum(n) over () > 0.0002""")
def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("n_chars", text.tokens(F.col("text")).alias("ws"))
    out = text.term_frequencies(d, "ws", [0.0002], timestamp="n_chars")
    return out.select(F.col("Term").alias("term"), F.round("Freq", 8).alias("freq"), F.col("Timestamp").alias("ts"))


@query(r"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents)
select term, count(*) as n, count(distinct doc_id) as documents from t group by 1 having count(distinct doc_id) >= 3""")
def document_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return document_frequency(table(spark, sf, "documents").select(text.tokens(F.col("text")).alias("ws")), "ws", 3).withColumn("n", F.col("n").cast("bigint"))


@query(r"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents),
v as (select term, row_number() over (order by n desc, term) as i from (select term, count(*) as n from t group by 1) qualify i <= 50),
c as (select doc_id, term, count(*) as n from t group by 1, 2)
select doc_id, string_agg(cast(coalesce(c.n, 0) as double)::varchar, ',' order by i) as counts from (select doc_id from documents) d cross join v left join c using (doc_id, term) group by 1""")
def count_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    d = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("ws"))
    out = text.count_vectors(d, "ws", text.fit_vocabulary(d, "ws", 50), "counts")
    return out.select("doc_id", F.array_join(vector_to_array("counts").cast("array<string>"), ",").alias("counts"))


_MATRIX = projection_matrix(64, 8, 0.5, 7)


def _bits(v: str) -> str:
    rows = [f"case when list_sum(list_transform(list_zip({v}, {row}), lambda p: p[1] * p[2])) > 0 then {1 << i} else 0 end" for i, row in enumerate(_MATRIX)]
    return " + ".join(rows)


@query(f"select vec_id, cast({_bits('cast(embedding as double[])')} as bigint) as hash from embeddings")
def projection_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", projection_hash(F.col("embedding").cast("array<double>"), _MATRIX).alias("hash"))


@query(f"""with e as (select vec_id, cast(embedding as double[]) as v, cast({_bits('cast(embedding as double[])')} as bigint) % 16 as h from embeddings)
select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 5) as similarity from e a join e b on a.h = b.h and a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.3""")
def lsh_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    h = e.withColumn("h", projection_hash(F.col("v"), _MATRIX) % 16)
    return similar_pairs(h, "vec_id", "v", "h", 0.3).withColumn("similarity", F.round("similarity", 5))


@query()
def lsh_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    h = e.withColumn("h", projection_hash(F.col("v"), _MATRIX))
    return greedy_dedup(h, "vec_id", "v", "h", 0.9).select("vec_id", "h")


@query()
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return fit_language_profiles(d).transform(d).select("doc_id", "lang", "language")


@query()
def analyse_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", analysed(F.col("text"), F.col("lang")).alias("stems"))
