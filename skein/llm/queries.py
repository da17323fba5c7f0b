"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(_docs(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(_docs(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect

    return detect(_docs(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(_docs(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(_docs(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_packages, write_packages

    return read_packages(write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify
    from .shared import crc_mod

    docs = _docs(spark, sf_dir)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.cross_entropy", "language.rejected")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_docs(spark, sf_dir))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import edits

    return edits(_docs(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_docs(spark, sf_dir))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_join import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import rank

    return rank(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_pii, op3_token_counts, op4_lm_scoring, op5_substring_dedup, op6_bpe, op7_ngram_jaccard_join, op8_warc, op9_language_id, op10_winnowing, op11_spelling_variants, op12_minhash_dedup, op13_ranked_search, pipeline)}


#: A text's runs of letters, letters deleted by the checksum (crc32, bit by bit), near words by open places and deletions.
_SPELLING = """
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{7,}')) AS run FROM documents)
  GROUP BY ALL),
bits AS (
  SELECT run, c, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128
    THEN [unicode(x), -1, -1, -1, -1, -1, -1, -1, -1] ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, unicode(x) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END)) AS steps
  FROM runs),
summed AS (
  SELECT run, c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, steps::BIGINT[]),
    lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) ELSE xor(h >> 1, 3988292384 * (h & 1)) END)) AS h
  FROM bits),
edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM summed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
open AS (SELECT word, n, word[:i] || '*' || word[i + 2:] AS k FROM places),
cut AS (SELECT DISTINCT word, n, word[:i] || word[i + 2:] AS k FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM open a JOIN open b USING (k) WHERE a.word <> b.word
  UNION ALL SELECT cut.word, w.word, w.n FROM cut JOIN words w ON w.word = cut.k
  UNION ALL SELECT w.word, cut.word, cut.n FROM cut JOIN words w ON w.word = cut.k),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, other := other)) AS b FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.other END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, arg_max(root, step) AS root FROM forms JOIN chain USING (word) GROUP BY ALL
"""

#: Exact sets and links of documents with equal or fewer shingles; components by the least id that spreads along links.
_MINHASH = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM split),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
rows AS (SELECT rep, n, unnest(s) AS x FROM classes),
seen AS (SELECT x, count(*) AS c FROM rows GROUP BY x),
ordered AS (SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY c, x) AS place FROM rows JOIN seen USING (x) ),
prefix AS (SELECT rep, n, x FROM ordered WHERE place <= n - (80 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b USING (x) WHERE a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (SELECT a, b, x.n AS n, y.n AS m, len(list_intersect(x.s, y.s)) AS shared FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b)
  WHERE 100 * shared >= 80 * (n + m - shared)),
ties AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, t.b FROM reach r JOIN ties t ON t.a = r.b),
least AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least USING (rep)
"""

_RANKED = """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
every AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
found AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found, every GROUP BY term, docs),
gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS gain FROM found JOIN weights USING (term) JOIN sizes USING (doc_id), every),
scores AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_spelling_variants": _SPELLING, "op12_minhash_dedup": _MINHASH, "op13_ranked_search": _RANKED}
