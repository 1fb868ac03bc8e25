"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .audio_prints import align, fingerprints, sung_texts
from .bpe import encode_bytes
from .language_id import learn_languages, predict_language, training_rows
from .line_dedup import line_dedup_digest
from .mixing import mix_sources
from .near_dedup import near_duplicate_groups
from .neighbours import nearest_vectors
from .phrases import collocations
from .quality_lm import quality_by_perplexity
from .recurrent_lm import score_documents
from .shared import bucket_of, importable, stored
from .toxicity import learn_toxicity, score_toxicity, training_labels
from .vector_codes import compress_vectors
from .warc_zip import round_trip

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in groups linked by 80 % of their 2-word shingles: doc_id, n_shingles, component_id, kept. See ``near_duplicate_groups``."""
    return near_duplicate_groups(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out (null for a null id), score, predicted, and counts of hits. See ``score_toxicity``."""
    docs = _table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, training_labels(_table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model, threshold=0.3).withColumn("held_out", bucket_of("doc_id", 4) == 2)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text and digests of ids and of the decoded bytes. See ``encode_bytes``."""
    return encode_bytes(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op4_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records into ZIP files and read back by range. See ``write_packages`` and ``read_packages``."""
    return round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op5_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings derived from all conversation turns, fingerprinted and aligned. See ``fingerprints`` and ``align``."""
    return align(stored(fingerprints(sung_texts(_table(spark, sf_dir, "conversations"))), "audio-prints"), every=50)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out (null for a null id), lang_pred, score, rejected. See ``predict_language``."""
    docs = _table(spark, sf_dir, "documents")
    return predict_language(docs, learn_languages(training_rows(docs))).withColumn("held_out", bucket_of("doc_id", 3) == 1)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to at most two passes a source, with block, pass and order. See ``mix_sources``."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"), max_passes=2.0, seed=17)
    return mixed.select("doc_id", "source", "mix_pass", "mix_block", "mix_key")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each whose id is divisible by 20. See ``nearest_vectors``."""
    return nearest_vectors(_table(spark, sf_dir, "embeddings"), top=20, every=20)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text, how many repeat an earlier run of 20 words, and a digest of the rest. See ``dedup_lines``."""
    return line_dedup_digest(_table(spark, sf_dir, "documents"), least_words=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every text under a model of trusted ones, and whether it is kept. See ``quality_by_perplexity``."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return quality_by_perplexity(_table(spark, sf_dir, "documents"), trusted, quantile=0.99)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of 2 to 5 words. See ``collocations``."""
    return collocations(_table(spark, sf_dir, "documents"), support=100, top=2000)


def op12_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every text under word counts and a gated recurrent model. See ``score_documents``."""
    return score_documents(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes and errors of every vector. See ``compress_vectors``."""
    return compress_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc_packages": op4_warc_packages,
    "op5_audio_fingerprints": op5_audio_fingerprints,
    "op6_language": op6_language,
    "op7_mix_sources": op7_mix_sources,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_recurrent_lm": op12_recurrent_lm,
    "op13_vector_codes": op13_vector_codes,
}


def _codebook_rounds(rounds: int = 6) -> str:
    """CTEs b<i> (entries) and a<i> (nearest entry of every part) of Lloyd's rounds."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rn, pos, part, min({{'d': d, 'k': k}}) AS best FROM (
    SELECT rn, p.pos, part, k, list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{i} b ON b.pos = p.pos)
  GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.pos, b.k, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (
    SELECT pos, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
      SELECT pos, k, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT pos, best.k AS k, unnest(part) AS x, generate_subscripts(part, 1) AS j FROM a{i}) GROUP BY ALL)
    GROUP BY ALL) m ON m.pos = b.pos AND m.k = b.k)""")
    return ",\n".join(steps)

ORACLES: dict[str, str] = {
    "op11_collocations": r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(str_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
s AS (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
c AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, f, str_split(phrase, ' ') AS ws FROM c WHERE f >= 100),
u AS (SELECT lang, phrase, f, ws, unnest(generate_series(1, k - 1)) AS j FROM f WHERE k > 1),
v AS (
  SELECT u.lang, u.phrase, u.f AS a, u.j, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * u.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM u JOIN n ON n.lang = u.lang JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:j], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[j + 1:], ' ')),
best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_size AS (SELECT lang, ws, f, k, unnest(generate_series(2, k - 1)) AS size FROM f WHERE k > 2),
inner_at AS (SELECT lang, ws, f, size, unnest(generate_series(1, k - size + 1)) AS i FROM inner_size),
covered AS (SELECT lang, array_to_string(ws[i : i + size - 1], ' ') AS phrase, max(f) AS longer FROM inner_at GROUP BY ALL)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000""",
    "op13_vector_codes": rf"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, pos, v[pos * (len(v) // 8) + 1 : (pos + 1) * (len(v) // 8)] AS part FROM e, (SELECT unnest(range(8)) AS pos)),
b0 AS (SELECT pos, rn - 1 AS k, part AS c FROM p WHERE rn <= 16),
{_codebook_rounds()},
t AS (SELECT rn, string_agg(printf('%02x', best.k), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM a6 GROUP BY rn),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, k, j)) AS codebooks_sha256 FROM (SELECT pos, k, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM b6))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN t USING (rn), h""",
    "op9_line_dedup": r"""
WITH u AS (
  SELECT doc_id, pos, unit, trim(unit, chr(32) || chr(9) || chr(10) || chr(13)) AS line, len(regexp_extract_all(unit, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS pos
        FROM (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\n.!?]*[.!?]*[ \t]*\n*'), lambda x: x <> '') AS us FROM documents))),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM u),
fw AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos < a.pos + 200 AND b.upto - a.upto + a.words >= 20 GROUP BY 1, 2),
bw AS (
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.pos <= b.pos AND a.pos > b.pos - 200 AND b.upto - a.upto + a.words >= 20 GROUP BY 1, 3),
w AS (SELECT * FROM fw UNION SELECT doc_id, s, e FROM bw),
t AS (
  SELECT w.doc_id, w.s, w.e, string_agg(c.line, chr(31) ORDER BY c.pos) AS content FROM w JOIN c ON c.doc_id = w.doc_id AND c.pos BETWEEN w.s AND w.e GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS k FROM t),
g AS (SELECT DISTINCT c.doc_id, c.pos FROM f JOIN c ON c.doc_id = f.doc_id AND c.pos BETWEEN f.s AND f.e WHERE f.k > 1),
r AS (
  SELECT u.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN unit END, '' ORDER BY u.pos), '') AS kept
  FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.pos = u.pos GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op7_mix_sources": r"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
sizes AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM slim GROUP BY source),
one AS (SELECT sum(tokens)::DOUBLE AS total, min(tokens)::DOUBLE / sum(tokens) AS lo_share, max(tokens)::DOUBLE / sum(tokens) AS hi_share FROM sizes WHERE tokens > 0),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, pow(lo_share / hi_share, (lo + hi) / 2 - 1) > 2.0 AS over FROM bis, one WHERE i < 60)),
ex AS (SELECT hi AS alpha FROM bis WHERE i = 60),
nm AS (SELECT total, hi_share, alpha, sum(pow(tokens / total, alpha)) AS norm FROM sizes, one, ex WHERE tokens > 0 GROUP BY 1, 2, 3),
plan AS (
  SELECT source, tokens, round(pow(tokens / total, alpha) / norm * (total * hi_share * norm / pow(hi_share, alpha)))::BIGINT AS budget
  FROM sizes, nm WHERE tokens > 0
  UNION ALL SELECT source, tokens, NULL FROM sizes WHERE tokens = 0),
full_plan AS (
  SELECT source, coalesce(budget // tokens, 1) AS passes, coalesce(budget % tokens, 0) AS left_over FROM plan),
whole AS (
  SELECT doc_id, source, unnest(generate_series(1, passes)) AS mix_pass FROM slim JOIN full_plan USING (source)),
part AS (
  SELECT doc_id, source, mix_pass, sum(tokens) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto, left_over
  FROM (SELECT doc_id, source, tokens, left_over, passes + 1 AS mix_pass,
          substr(md5('17|' || (passes + 1) || '|' || source || '|' || substr(md5(source || '|' || doc_id), 1, 3)), 1, 12) || substr(md5('17|' || (passes + 1) || '|' || source || '|' || doc_id), 1, 24) AS key
        FROM slim JOIN full_plan USING (source) WHERE left_over > 0)),
taken AS (
  SELECT doc_id, source, mix_pass FROM whole UNION ALL SELECT doc_id, source, mix_pass FROM part WHERE upto <= left_over)
SELECT doc_id, source, mix_pass, block AS mix_block, substr(md5('17|' || mix_pass || '|' || source || '|' || block), 1, 12) || substr(md5('17|' || mix_pass || '|' || source || '|' || doc_id), 1, 24) AS mix_key
FROM (SELECT *, substr(md5(source || '|' || doc_id), 1, 3) AS block FROM taken)""",
    "op4_warc_packages": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN d USING (html)""",
    "op1_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id""",
}
