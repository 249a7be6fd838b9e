"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import (
    bpe, collocations, fill_middle, language, minhash, neighbours, packing, quality, repeats, simhash, token_counts,
    token_files, url_filter)
from stayline.llm.common import shared_folder, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: The rules that op8 applies.
URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


def held_out(folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from learning; a null doc_id is in no fold."""
    mark = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(mark == fold, F.lit(False))


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    both = bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "found.n_bytes", "found.n_removed", "found.n_spans",
                        F.sha2("found.kept", 256).alias("kept_sha256"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.filter(~held_out()))
    found = language.predictor(docs, model)(F.col("text"))
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("found")) \
        .select("doc_id", "held_out", "found.lang_pred", "found.score")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    place, tokenizer = shared_folder(spark), public_tokenizers.path(BYTE_BPE)
    shards = token_files.write_token_files(table(spark, folder, "documents"), place, tokenizer, end_id=2)
    found = token_files.read_token_files(spark, place, shards, token_files.id_type(tokenizer, 2))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = minhash.compare_with_edits(table(spark, folder, "documents"), ranges)
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out(3, 1)
    found = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), ~out)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(whole.cast("binary"), 256).alias("restored_sha256"))


_OP8_SQL = """
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages
), rest AS (
  SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM cut
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_OP11_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), pieces AS (
  SELECT lang, [w for w in regexp_split_to_array(piece, '[ \t]+') if w <> ''] AS words
  FROM (SELECT lang, unnest(pieces) AS piece FROM docs)
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words)
), counts AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cand AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM counts WHERE k >= 2
), inside AS (
  SELECT DISTINCT c.lang, array_to_string(c.words[i:i + m - 1], ' ') AS phrase, max(c.a) AS around
  FROM cand c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS m)
  WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL
), free AS (
  SELECT c.* FROM cand c LEFT JOIN inside b ON b.lang = c.lang AND b.phrase = c.phrase
  WHERE b.around IS NULL OR 100 * b.around < 100 * c.a
), cuts AS (
  SELECT f.lang, f.phrase, f.a, cut, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:k], ' ') AS tail
  FROM free f, (SELECT unnest([1, 2, 3, 4]) AS cut) WHERE cut < f.k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, t.n,
    ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM scored
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best WHERE pick = 1
)
SELECT * FROM ranked WHERE rank <= 2000
"""

_OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), marks AS (
  SELECT doc_id, text, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn
), cut AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM marks
), parts AS (
  SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_packing, op2_bpe, op3_repeats, op4_language, op5_simhash, op6_neighbours,
        op7_token_files, op8_urls, op9_token_counts, op10_fingerprints, op11_collocations, op12_quality,
        op13_fill_middle)
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return {"op8_urls": _OP8_SQL, "op11_collocations": _OP11_SQL, "op13_fill_middle": _OP13_SQL}
