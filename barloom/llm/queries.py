"""The registered queries of the text operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table

#: The id by which the vocabulary byte_bpe_50k ends a text.
END_OF_TEXT = 50256


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document: the ids of its whole text and the text they decode to; null is empty, repeated rows stay."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from barloom.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page, from archives that are written and read back."""
    from pyspark.sql import functions as F

    from barloom.llm.common import cut, scratch_path
    from barloom.llm.warc import captures, read_archives, resolve_revisits, write_archives

    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = cut(read_archives(spark, path, payloads=False))  # the archives are walked once
    found = resolve_revisits(cut(captures(records)))
    page = lambda metadata: F.try_element_at(metadata["fields"], F.lit("page-id")).try_cast("long")
    return found.select(
        page(F.col("metadata")).alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page(F.col("original.metadata")).alias("refers_to"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document; empty and null texts get the score of an empty text."""
    from pyspark.sql import functions as F

    from barloom.llm.common import held_out
    from barloom.llm.quality import learn, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged) per document; flagged goes by the threshold of its language."""
    from pyspark.sql import functions as F

    from barloom.llm.common import held_out
    from barloom.llm.toxicity import learn, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = score_toxicity(docs, *learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "flagged")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, n_tokens, shard, bin, start): the place of each piece of each document, its lengths in tokens of the byte-level BPE."""
    import public_tokenizers

    from barloom.llm.packing import documents_as_lengths, pack

    return pack(documents_as_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document; null is empty."""
    from barloom.llm.phrases import with_edits

    return with_edits(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from a store that is written and read back."""
    import public_tokenizers

    from barloom.llm.common import scratch_path
    from barloom.llm.token_store import read_checksums, write_store

    path = scratch_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return read_checksums(spark, path)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per document; counts and spans hold plain and disguised ones."""
    from pyspark.sql import functions as F

    from barloom.llm.pii import KINDS, find_pii

    found = find_pii(table(spark, sf_dir, "documents"))

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(digest(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document: sets of four words, similarity of 0.85 or more."""
    from barloom.llm.ngram_join import ngram_groups

    return ngram_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per document: texts that are equal but for white space."""
    from barloom.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op11_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of the 50 best documents of each benchmark item.

    Null texts hold nothing; an item's repeated rows count as one item with all their terms; of equal scores the smaller
    doc_id is first, rows without one last, and rows that repeat are documents of their own.
    """
    from barloom.llm.common import scratch_path
    from barloom.llm.lexical import build_index, search

    path = scratch_path(spark, "sketches")
    build_index(table(spark, sf_dir, "documents"), path)
    return search(spark, path, table(spark, sf_dir, "benchmark"), top=50)


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per distinct beginning of rebuilt conversations.

    Null roles and texts are empty; turns of equal number go by role and text, rows that repeat are turns of their own;
    rows without conv_id belong to no conversation; an empty table has no node.
    """
    from barloom.llm.turn_trie import rebuilt, trie

    return trie(rebuilt(table(spark, sf_dir, "conversations")))


def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document; rows that repeat stay, null texts are empty.

    n_base, first_word and last_word go by the base phrases alone; score is that of the best place, 0 where there is none.
    """
    from pyspark.sql import functions as F

    from barloom.llm.licences import scan_licences

    found = scan_licences(table(spark, sf_dir, "documents")).withColumn("base", F.filter("places", lambda p: p["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    first = F.transform("base", lambda p: p["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": r"""
            WITH p AS (
                SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
            SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
                array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    CAST(1 + ((CAST('0x' || substr(sha1(body), CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
                CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> first THEN first END AS refers_to
            FROM p""",
        "op10_exact_dedup": r"""
            WITH d AS (
                SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
            SELECT doc_id,
                first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY body) AS group_size,
                doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS kept,
                sha256(body) AS text_sha256
            FROM d""",
        "op11_max_sketch_search": r"""
            WITH terms AS MATERIALIZED (
                SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)),
            sizes AS (SELECT r, count(*) AS n FROM terms GROUP BY r),
            whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM sizes),
            held AS (SELECT doc_id, r, term, count(*) AS tf FROM terms GROUP BY ALL),
            weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term),
            asked AS (
                SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
            scored AS (
                SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens)))) AS BIGINT) AS score
                FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (r), whole GROUP BY item_id, r, doc_id)
            SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k FROM scored WHERE score > 0) WHERE k <= 50""",
        "op12_turn_trie": r"""
            WITH t AS (
                SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS own
                FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
            bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS b),
            crc AS (
                SELECT t.*, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, b[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295::BIGINT) % 4 AS BIGINT) AS h
                FROM t, bits),
            r AS (SELECT c.conv_id, list_concat(coalesce(b.own, c.own[1:0])[1:h], c.own[h + 1:]) AS seq FROM crc c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20),
            p AS (SELECT conv_id, seq, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth FROM r),
            nodes AS (
                SELECT depth, seq[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
                FROM p GROUP BY depth, seq[1:depth]),
            linked AS (
                SELECT c.*, u.conv_id AS parent_conv_id, CASE WHEN c.depth > 0 THEN len(regexp_extract_all(c.path[-1].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
                FROM nodes c LEFT JOIN nodes u ON u.depth = c.depth - 1 AND u.path = c.path[1:c.depth - 1]),
            kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
            whole AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (depth, conv_id)),
            below AS (
                SELECT e AS depth, path[1:e] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
                FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM whole) GROUP BY e, path[1:e])
            SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM whole JOIN below USING (depth, path)""",
    }
