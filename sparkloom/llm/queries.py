"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, media, quality
from sparkloom.llm.chat import format_chats
from sparkloom.llm.common import table
from sparkloom.llm.line_dedup import dedup_lines
from sparkloom.llm.mixing import mixed_stream
from sparkloom.llm.near_dedup import near_duplicates
from sparkloom.llm.nn_descent import near_neighbours
from sparkloom.llm.packing import pack
from sparkloom.llm.pii import find_personal_data


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


#: For turns without markers or backslashes, as here; tests/llm cover those that need escaping.
_OP1 = """
select conv_id, cast(count(*) as integer) as n_turns, 0 as n_escaped,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce("text", '') || '<|im_end|>' || chr(10), '' order by turn nulls first, role, "text") as "text"
from conversations group by conv_id
"""


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_neighbours(table(spark, sf_dir, "embeddings"))


_OP2 = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
p as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as a, vec_id as b from v union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as class_id from r group by a),
n as (select a, count(*) as n_links from p group by a)
select c.a as vec_id, c.class_id, coalesce(n.n_links, 0) as n_links from c left join n on c.a = n.a
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


_OP6 = """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, i, trim(ls[i], ' ') || chr(10) || trim(ls[i + 1], ' ') || chr(10) || trim(ls[i + 2], ' ') as k
      from (select doc_id, ls, unnest(range(1, len(ls) - 1)) as i from l)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id nulls first, i) as nth from w where k <> chr(10) || chr(10)) where nth > 1),
gone as (select distinct doc_id, i + j as i from later cross join (select unnest([0, 1, 2]) as j)),
x as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from l)
select x.doc_id, string_agg(x.line, chr(10) order by x.i) as text, cast(length(string_agg(x.line, chr(10) order by x.i)) as bigint) as n_chars
from x left join gone on x.doc_id = gone.doc_id and x.i = gone.i where gone.i is null group by x.doc_id
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed_stream(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", *[F.col(c).cast("bigint").alias(c) for c in ("copy", "tokens", "block", "slot")])


#: With the default budget the repetition of a source is (largest / own tokens) ^ (1 - exponent), so the exponent has a closed form.
_OP9 = """
with d as (select doc_id, source, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as tokens from documents),
s as (select source, sum(tokens) as n from d where tokens > 0 group by source),
e as (select case when max(n) <= 1.5 * min(n) then 0.0 else 1 - ln(1.5) / ln(max(n) / min(n)) end as a from s),
w as (select source, n, n ^ a / sum(n ^ a) over () as weight from s, e),
b as (select max(n / weight) as budget, greatest(1, ceil(max(n / weight) / 65536)) as blocks from w),
p as (select source, n, weight * budget as quota, cast(floor(weight * budget / n + 1e-9) as bigint) as passes, blocks from w, b),
c as (select doc_id, d.source, tokens, n, quota, passes, greatest(quota - passes * n, 0) as rest, blocks, unnest(range(0, passes + 1)) as copy
      from d join p on d.source is not distinct from p.source where tokens > 0),
a as (select *, sum(tokens) over (partition by source, copy order by md5('11:' || copy || ':' || doc_id)) as upto from c where copy < passes or rest > 0),
k as (select doc_id, source, copy, tokens, cast(least(blocks, greatest(1, ceil((copy * n + upto) / quota * blocks - 1e-9))) - 1 as bigint) as block from a where copy < passes or upto <= rest)
select doc_id, source, copy, tokens, block, row_number() over (partition by block order by md5('11:block:' || block || ':' || copy || ':' || doc_id), source, tokens) - 1 as slot from k
"""


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = media.with_pictures(table(spark, sf_dir, "embeddings"))
    return media.decode_column(pictures, "id", "jpeg").withColumnRenamed("id", "vec_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat, op2_nn_descent, op3_packing, op4_near_dedup, op5_quality, op6_line_dedup, op7_pii, op8_langid, op9_mixing, op10_media, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": _OP1, "op2_nn_descent": _OP2, "op6_line_dedup": _OP6, "op9_mixing": _OP9}
