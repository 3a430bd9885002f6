"""Registered queries of the corpus operators, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asnwatch.llm.common import id_bucket, read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.licenses import license_scan

    base = F.filter("spans", lambda s: s["base"])
    return license_scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        "expression",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.quality_rules import BASE, DEFAULT, apply_policy, ledger

    entries = apply_policy(ledger(read(spark, sf_dir, "documents")), DEFAULT)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0).alias("base_failed"),
        "kept", "fail_bits", "policy_version",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.langid import identify, train

    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(id_bucket(4) == 2, F.lit(False))
    predicted = identify(docs, train(docs.filter(id_bucket(4) != 2)))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "log_prob_per_byte")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.toxicity import score, train

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(id_bucket(3) == 1, F.lit(False))
    scored = score(docs, train(docs, labels.filter(id_bucket(3) != 1)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.quality_model import score, train

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(id_bucket(3) == 1, F.lit(False))
    scored = score(docs, train(docs, labels.filter(id_bucket(3) != 1)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.jaccard_join import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.sentencepiece_fst import encode

    return encode(read(spark, sf_dir, "documents"), digest=True)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.packing import pack, token_pieces

    return pack(token_pieces(read(spark, sf_dir, "documents")))


def op9_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.ppm import score

    held_out = F.coalesce(id_bucket(10) == 0, F.lit(False))
    scored = score(read(spark, sf_dir, "documents"), id_bucket(10) != 0)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.hamming_search import top_k

    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.conversation_repair import damaged, repair

    return repair(damaged(read(spark, sf_dir, "conversations")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.lexical_search import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asnwatch.llm.token_codes import read_documents, shared_folder, write_documents

    path = shared_folder(spark)
    write_documents(read(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_quality_model": op5_quality_model,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_ppm_scoring": op9_ppm_scoring,
    "op10_hamming_search": op10_hamming_search,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_codes": op13_token_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d
        ), windows AS (
            SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
        ), again AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM windows) WHERE n > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
        ), m AS (
            SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
                len(lines) AS n_lines, strlen(text) AS n_bytes, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
                strlen(regexp_replace(text, '[\x00-@\x5B-`{-\x7F]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_shouts,
                length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, coalesce(list_max(list_transform(words, lambda x: strlen(x))), 0) AS longest,
                len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutters
            FROM w LEFT JOIN covered c USING (doc_id)
        ), bits AS (
            SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) + 4 * CAST(n_symbols > 0.1 * greatest(n_words, 1) AS BIGINT)
                + 8 * CAST(n_dup_lines >= 4 AND n_dup_lines > 0.5 * n_lines AS BIGINT) + 16 * CAST(n_upper > 0.5 * greatest(n_letters, 1) AS BIGINT)
                + 32 * CAST(n_shouts > 0.1 * greatest(n_words, 1) AS BIGINT) + 64 * CAST(word_chars < 2.5 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) AS BIGINT)
                + 128 * CAST(longest > 1000 AS BIGINT) + 256 * CAST(n_digits > 0.3 * greatest(n_bytes, 1) AS BIGINT) + 512 * CAST(n_stutters > 0.2 * greatest(n_words, 1) AS BIGINT) AS fail_bits FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 1 AS policy_version FROM bits
    """,
    "op10_hamming_search": """
        WITH bits AS (
            SELECT vec_id, [CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding] AS b FROM embeddings
        ), codes AS (
            SELECT vec_id, CAST(array_to_string(b, '') AS BIT) AS code FROM bits
        ), pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, bit_count(xor(q.code, v.code)) AS distance
            FROM codes q JOIN codes v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
        ), kinds AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
                lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 20 AS kind FROM named
        ), rows_left AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM rows_left
        ), judged AS (
            SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS previous, NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') AS blank,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[.!?][ \t\n\x0B\f\r]*\z') AS cut FROM placed
        ), inserts(here, there, cost, edits, said) AS (
            VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
                (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
        ), changes(here, there, cost, edit, role) AS (
            VALUES (0, 0, 3, 'D', NULL), (1, 1, 3, 'D', NULL), (2, 2, 3, 'D', NULL), (3, 3, 3, 'D', NULL), (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a'),
                (0, 2, 2, 'R', 'user'), (1, 2, 2, 'R', 'user'), (3, 2, 2, 'R', 'user'), (2, 3, 2, 'R', 'assistant')
        ), best AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, {'cost': 0, 'edits': '', 'said': []::VARCHAR[]} AS way FROM conversations
            UNION ALL
            SELECT b.conv_id, j.k, c.there, min({'cost': (b.way).cost + i.cost + c.cost + CASE WHEN c.edit <> 'D' AND j.cut THEN 1 ELSE 0 END, 'edits': (b.way).edits || i.edits || c.edit,
                'said': list_concat(list_concat((b.way).said, i.said), CASE c.edit WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [c.role || ':' || j.text] END)})
            FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.k = b.k + 1 JOIN inserts i ON i.here = b.state
                JOIN changes c ON c.here = i.there AND (c.edit = 'D' OR (NOT j.blank AND NOT j.again AND (c.edit = 'R' OR c.role = j.initial)))
            GROUP BY b.conv_id, j.k, c.there
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id
        ), ended AS (
            SELECT b.conv_id, min({'cost': (b.way).cost + i.cost, 'edits': (b.way).edits || i.edits, 'said': list_concat((b.way).said, i.said)}) AS way
            FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id JOIN inserts i ON i.here = b.state WHERE b.k = coalesce(c.n, 0) AND i.there IN (0, 3) GROUP BY b.conv_id
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST((e.way).cost AS BIGINT) AS cost, (e.way).edits AS audit, sha256(array_to_string((e.way).said, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), i AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), stats AS (
            SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
        ), tf AS (
            SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term
        ), w AS (
            SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term
        ), scored AS (
            SELECT i.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * n_docs) // n_terms))))::BIGINT AS score
            FROM i JOIN tf USING (term) JOIN w USING (term), stats GROUP BY i.item_id, tf.doc_id
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
    """,
}
