"""Registered queries of the corpus operators; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import ann, balanced, centroids, htmltext, langid, linededup, neardup, ngramjoin, packing, pieces, pii, quality, veccodes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


QUERIES["op5_pii"] = op5_pii


def held_out(n: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder`` modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n == remainder


QUALITY_THRESHOLD = 0.7


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(4, 2)))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


QUERIES["op3_quality"] = op3_quality


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(3, 1)))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES["op9_language"] = op9_language


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES["op4_packing"] = op4_packing


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.remove_boilerplate(docs).select("doc_id", "text", "n_lines", "n_removed")


QUERIES["op7_line_dedup"] = op7_line_dedup
ORACLES["op7_line_dedup"] = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents where text is not null
), common as (
  select trim(line) as t, min(struct_pack(d := doc_id, p := pos)) as f from lines
  where length(trim(line)) >= 16 group by trim(line) having count(distinct source) >= 10
), marked as (
  select doc_id, pos, line, t is not null and (f.d <> doc_id or f.p <> pos) as gone
  from lines left join common on trim(line) = t
), rebuilt as (
  select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text,
         count(*) as n_lines, count(*) filter (where gone) as n_removed
  from marked group by doc_id
)
select d.doc_id, r.text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed
from documents d left join rebuilt r using (doc_id)
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES["op6_sentencepiece"] = op6_sentencepiece


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES["op8_near_vectors"] = op8_near_vectors


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES["op10_nearest"] = op10_nearest


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES["op1_ngram_join"] = op1_ngram_join


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES["op2_html_text"] = op2_html_text


def op11_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES["op11_balanced_packing"] = op11_balanced_packing


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


# Whole vectors, and squared distances of two lists of whole numbers.
_WHOLE = "select vec_id, label, row_number() over () as rn, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_FAR = "cast(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
_MEAN = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"


def _centroids_sql(k: int = 16, rounds: int = 3) -> str:
    parts = [f"v as ({_WHOLE.format(scale=64)} and len(embedding) = 64)", f"c0 as (select row_number() over (order by h, q) - 1 as c, q from (select sha256('1:' || vec_id) as h, q from v where vec_id is not null order by h, q limit {k}))"]
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select rn, any_value(v.q) as q, min(struct_pack(d := {_FAR.format('v.q', 'c.q')}, c := c.c)) as m from v, c{i} c group by rn)")
        if i < rounds:
            parts.append(f"s{i} as (select c, list(cast(x as bigint) order by p) as q from (select c, p, {_MEAN} as x from (select m.c as c, unnest(q) as x, unnest(range(64)) as p from a{i}) group by c, p) group by c)")
            parts.append(f"c{i + 1} as (select c.c, coalesce(s.q, c.q) as q from c{i} c left join s{i} s using (c))")
    last = rounds
    return f"""with {", ".join(parts)}
select v.vec_id, cast(m.c as int) as cluster, m.d as distance, cast(sum(m.d) over (partition by m.c) as bigint) as cluster_inertia, cast(sum(m.d) over () as bigint) as inertia,
       sha256(array_to_string(c{last}.q, ',')) as centroid_sha256
from a{last} a join v using (rn) join c{last} on c{last}.c = a.m.c"""


QUERIES["op12_centroids"] = op12_centroids
ORACLES["op12_centroids"] = _centroids_sql()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.encode(table(spark, sf_dir, "embeddings"))


def _codes_sql(n: int = 16, entries: int = 64, rounds: int = 2) -> str:
    parts = [
        f"v as ({_WHOLE.format(scale=256)})",
        f"w as (select rn, p, list_slice(q, p * (len(q) // {n}) + 1, (p + 1) * (len(q) // {n})) as q from (select rn, q, unnest(range({n})) as p from v))",
        f"c0 as (select p, e, w.q from (select rn, row_number() over (order by vec_id nulls last, q) - 1 as e from v order by e limit {entries}) join w using (rn))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select rn, w.p, any_value(w.q) as q, min(struct_pack(d := {_FAR.format('w.q', 'c.q')}, e := c.e)) as m from w join c{i} c on c.p = w.p group by rn, w.p)")
        if i < rounds:
            parts.append(f"s{i} as (select p, e, list(cast(x as bigint) order by j) as q from (select p, e, j, {_MEAN} as x from (select p, m.e as e, unnest(q) as x, unnest(range(len(q))) as j from a{i}) group by p, e, j) group by p, e)")
            parts.append(f"c{i + 1} as (select c.p, c.e, coalesce(s.q, c.q) as q from c{i} c left join s{i} s using (p, e))")
    last = rounds
    return f"""with {", ".join(parts)},
done as (select rn, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error from a{last} group by rn)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(q, ','), ',' order by p, e)) from c{last}) as codebooks_sha256
from done join v using (rn)"""


QUERIES["op13_vector_codes"] = op13_vector_codes
ORACLES["op13_vector_codes"] = _codes_sql()
