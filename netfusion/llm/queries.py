"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netfusion.llm.common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_order")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents
), s AS (SELECT src, count(*) AS n_docs, sum(n)::BIGINT AS tokens FROM d GROUP BY src
), a AS (SELECT sum(tokens)::BIGINT AS total, list(tokens::DOUBLE ORDER BY tokens) AS each FROM s WHERE tokens > 0
), b AS (SELECT total, list_transform(each, lambda t: t / total) AS shares FROM a
), e AS (
  SELECT total, shares, CASE WHEN pow(shares[1], -1.0) / len(shares) <= 1.25 THEN 0.0 ELSE
    list_reduce(list_transform(range(20), lambda i: {'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}), lambda x, y:
      CASE WHEN pow(shares[1], (x.lo + x.hi) / 2 - 1) / list_sum(list_transform(shares, lambda p: pow(p, (x.lo + x.hi) / 2))) > 1.25
           THEN {'lo': (x.lo + x.hi) / 2, 'hi': x.hi} ELSE {'lo': x.lo, 'hi': (x.lo + x.hi) / 2} END, {'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}).hi END AS ex
  FROM b
), z AS (SELECT total, ex, list_sum(list_transform(shares, lambda p: pow(p, ex))) AS z FROM e
), w AS (
  SELECT src, n_docs, tokens, floor(round(pow(tokens / total, ex) / z, 9) * total)::BIGINT AS budget FROM s, z WHERE tokens > 0
), p AS (
  SELECT src, tokens, least(65536, ceil(n_docs / 256))::BIGINT AS n_blocks, budget // tokens AS fulls, budget - (budget // tokens) * tokens AS rest FROM w WHERE budget > 0
), t AS (
  SELECT d.*, p.*, ('0x' || substr(md5('7|block|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % n_blocks AS block, md5('7|doc|' || coalesce(doc_id::VARCHAR, '')) AS dh
  FROM d JOIN p USING (src)
), bt AS (
  SELECT src, block, any_value(fulls) AS fulls, any_value(rest) AS rest, sum(n) AS n, md5('7|' || any_value(fulls) || '|' || src || '|' || block) AS h FROM t GROUP BY src, block
), c AS (SELECT *, sum(n) OVER (PARTITION BY src ORDER BY h, block) - n AS before FROM bt
), cutb AS (SELECT src, block AS cut_block, h AS cut_hash, rest - before AS lft FROM c WHERE before <= rest AND before + n > rest AND rest > 0
), dd AS (
  SELECT src, dh, any_value(lft) AS lft, sum(n) AS n FROM t JOIN cutb USING (src) WHERE block = cut_block GROUP BY src, dh
), cutd AS (SELECT src, max(dh) AS cut_doc FROM (SELECT *, sum(n) OVER (PARTITION BY src ORDER BY dh) AS upto FROM dd) WHERE upto <= lft GROUP BY src
), r AS (
  SELECT t.*, cut_hash, cut_block, coalesce(cut_doc, '') AS cut_doc, md5('7|' || fulls || '|' || src || '|' || block) AS ph,
         fulls + CASE WHEN rest > 0 THEN ('0x' || substr(cut_hash, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE ELSE 0 END AS epochs
  FROM t LEFT JOIN cutb USING (src) LEFT JOIN cutd USING (src)
), k AS (
  SELECT *, fulls + CASE WHEN rest > 0 AND (ph < cut_hash OR (ph = cut_hash AND block < cut_block) OR (block = cut_block AND dh <= cut_doc)) THEN 1 ELSE 0 END AS copies FROM r
), x AS (
  SELECT *, unnest(range(copies::BIGINT)) AS epoch FROM k
), y AS (
  SELECT *, epoch + ('0x' || substr(md5('7|' || epoch || '|' || src || '|' || block), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS pos FROM x
)
SELECT doc_id, source, n AS mix_tokens, epoch AS mix_epoch, block AS mix_block, round(least(1.0, pos / greatest(epochs, pos)), 9) AS mix_order FROM y
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.decontam import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id AS id, TRUE AS is_doc, text FROM documents UNION ALL SELECT item_id, FALSE, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
), w AS (
  SELECT id, is_doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t WHERE text IS NOT NULL
), k AS (SELECT DISTINCT least(5, len(ws)) AS k FROM w WHERE NOT is_doc AND len(ws) > 0
), s AS (
  SELECT DISTINCT id, is_doc, ws[i : i + k - 1] AS g FROM w, k, unnest(range(1, len(ws) - k + 2)) AS u(i) WHERE len(ws) > 0 AND (is_doc OR k = least(5, len(ws)))
), q AS (SELECT id, count(*) AS n FROM s WHERE NOT is_doc GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(q.n) AS n_shingles, count(*) AS n_shared, count(*) / any_value(q.n) AS containment
FROM s AS b JOIN s AS d ON b.g = d.g AND d.is_doc AND NOT b.is_doc JOIN q ON q.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(q.n) - 1e-9
"""


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from netfusion.llm.tokens import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, ws[i : i + 2] AS g FROM d, unnest(range(1, len(ws) - 1)) AS u(i)
), dup AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, unnest([0, 1, 2]) AS u(o) GROUP BY doc_id
), tw AS (
  SELECT doc_id, max(n) AS n FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w) GROUP BY doc_id
), s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(tw.n, 0) AS top_word,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
         len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) AS n_wordlike
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN tw USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 5 * n_upper > 2 * n_letters OR 2 * n_dup_lines > n_lines
         OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * top_word > 3 * n_words OR 10 * n_wordlike < 7 * n_words) AS kept
FROM b
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.chat import digest, format_conversations

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_conversations(rows.unionByName(extra)))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS ends,
         replace(text, '<|', '<||') AS e, replace(role, '<|', '<||') AS er
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(e) + CASE WHEN opens THEN 16 + length(er) ELSE 8 END + CASE WHEN ends THEN 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from netfusion.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), o AS (SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l
), d AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, pos) AS place FROM (SELECT ws, min((doc_id, pos)) AS f, f[1] AS doc_id, f[2] AS pos FROM o WHERE len(ws) > 0 GROUP BY ws)
), v AS (
  SELECT place, len(ws) AS n, i, ws[: i - 1] || ws[i + 1 :] AS k FROM d, unnest(range(1, len(ws) + 1)) AS u(i) WHERE len(ws) > 1
), near AS (
  SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY n, i, k) AS e FROM v) WHERE e < place
  UNION SELECT v.place FROM v JOIN d ON d.ws = v.k AND d.place < v.place
  UNION SELECT d.place FROM v JOIN d ON d.ws = v.k AND v.place < d.place
), j AS (
  SELECT o.*, len(o.ws) > 0 AND (d.doc_id IS DISTINCT FROM o.doc_id OR d.pos <> o.pos OR d.place IN (SELECT place FROM near)) AS gone
  FROM o LEFT JOIN d ON o.ws = d.ws AND len(o.ws) > 0
), k AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE len(ws) > 0) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, FALSE)), '') AS kept FROM j GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5 FROM k
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from netfusion.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.jaccard_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n AS p ON p.doc_id = a.doc_id JOIN n AS q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))
), r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netfusion.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM w, unnest([1, 2, 3, 4, 5]) AS u(k), unnest(range(1, len(ws) - k + 2)) AS v(i)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100
), inner_ AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(f) AS g FROM c, unnest([2, 3, 4]) AS u(m), unnest(range(1, k - m + 2)) AS v(i) WHERE m < k GROUP BY ALL
), alone AS (
  SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE g IS NULL OR 100 * g < 100 * f
), cuts AS (
  SELECT a.lang, a.phrase, a.f AS a, j, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * a.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM alone) AS a JOIN n USING (lang)
  JOIN f AS l ON l.lang = a.lang AND l.phrase = array_to_string(a.ws[: a.j], ' ') JOIN f AS r ON r.lang = a.lang AND r.phrase = array_to_string(a.ws[a.j + 1 :], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_token_ids": op5_token_ids,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_quality_rules": op7_quality_rules,
        "op8_language_id": op8_language_id,
        "op9_chat_format": op9_chat_format,
        "op10_line_dedup": op10_line_dedup,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1_SQL, "op3_decontamination": OP3_SQL, "op7_quality_rules": OP7_SQL, "op9_chat_format": OP9_SQL, "op10_line_dedup": OP10_SQL, "op12_ngram_jaccard_join": OP12_SQL, "op13_collocations": OP13_SQL}
