"""The registered queries: each applies one operator to its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.llm.backoff import score_texts
from tokentide.llm.collocations import collocations
from tokentide.llm.decontaminate import find_contamination
from tokentide.llm.fim import fill_in_middle, restored
from tokentide.llm.linededup import dedup_lines
from tokentide.llm.mixing import mix
from tokentide.llm.outliers import judge_texts
from tokentide.llm.passages import repeated_passages
from tokentide.llm.ranking import CUT, learn, score_documents
from tokentide.llm.scratch import new_path
from tokentide.llm.simhash import near_duplicates
from tokentide.llm.topk import top_k
from tokentide.llm.warc import read_archive, write_archive
from tokentide.llm.wordpiece import byte_level_pieces, count_pieces, read_ranked_vocabulary

#: Public byte-level vocabulary of the token counts; a parameter, read by the driver alone.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(divisor: int) -> Column:
    """Rows that learning leaves out; a null id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 2, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a null id count as one in ``n_items`` and are left out of ``items_sha256``, as in the SQL."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), null_items=True)
    items = F.sha2(F.array_join("hit_items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_texts(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "distance")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    records = read_archive(spark, path)
    digest = F.sha2("record", 256).alias("record_sha256")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", digest)


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", "text")


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out(7)).alias("learn"))
    scored = score_texts(docs, "learn")
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def learnt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(~held_out(4))


def op8_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, learnt_labels(spark, sf_dir))
    scored = score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, continuing = byte_level_pieces(read_ranked_vocabulary(VOCABULARY))
    return count_pieces(table(spark, sf_dir, "documents"), initial, continuing, mark=b" ")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_robust_outliers": op2_robust_outliers,
    "op3_warc_archive": op3_warc_archive,
    "op4_paragraph_minhash": op4_paragraph_minhash,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_backoff_automaton": op6_backoff_automaton,
    "op7_line_dedup": op7_line_dedup,
    "op8_bradley_terry": op8_bradley_terry,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        i AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS gram
            FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        grams AS (
            SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
        hits AS (SELECT doc_id, grams.size, p, item_id FROM grams JOIN windows USING (size, gram)),
        words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_warc_archive": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS hex,
                min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
        q AS (
            SELECT *, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                    1 + ((('0x' || hex[5 * (i // 4) + 1:5 * (i // 4) + 5])::INT >> (15 - 5 * (i % 4))) & 31)]), '') AS digest,
                page_id <> first_id AS again, md5('record:' || page_id) AS a, md5('record:' || first_id) AS b, chr(13) || chr(10) AS nl FROM p),
        h AS (
            SELECT *, 'WARC/1.1' || nl || 'WARC-Type: ' || if(again, 'revisit', 'response') || nl
                || 'WARC-Record-ID: <urn:uuid:' || concat_ws('-', a[1:8], a[9:12], a[13:16], a[17:20], a[21:32]) || '>' || nl
                || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || url || nl || 'WARC-Payload-Digest: sha1:' || digest || nl
                || if(again, 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl
                || 'WARC-Refers-To: <urn:uuid:' || concat_ws('-', b[1:8], b[9:12], b[13:16], b[17:20], b[21:32]) || '>' || nl, '')
                || 'X-Page-ID: ' || page_id || nl || if(again, 'X-Refers-To-Page-ID: ' || first_id || nl, '') || 'X-Payload-Length: ' || bytes || nl
                || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || if(again, 0, bytes) || nl || nl AS header FROM q)
        SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, if(again, 'revisit', 'response') AS record_type,
            if(again, first_id, NULL) AS refers_to, true AS verified, sha256(header || if(again, '', body) || nl || nl) AS record_sha256 FROM h""",
    "op5_poisson_mixing": """
        WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        t AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS weights FROM n),
        rates AS (SELECT source, 1.0::DOUBLE * (total / weights) / n AS rate FROM n, t),
        terms AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates),
        cdf AS (
            SELECT source, k, sum(exp(log_term)) OVER (PARTITION BY source ORDER BY k) AS cdf
            FROM (SELECT source, k, -rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k) AS log_term FROM terms)),
        draws AS (SELECT doc_id, source, text, ('0x' || md5('17:' || doc_id)[1:13])::BIGINT / 4503599627370496.0 AS u FROM documents),
        copies AS (SELECT doc_id, draws.source, text, count(*) FILTER (WHERE u >= cdf) AS copies FROM draws JOIN cdf USING (source) GROUP BY ALL)
        SELECT doc_id, source, copy::INT AS copy, md5('18:' || doc_id || ':' || copy) AS shuffle_key, text
        FROM (SELECT *, unnest(range(0, copies)) AS copy FROM copies)""",
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
        FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id""",
    "op11_fill_in_middle": r"""
        WITH u AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
        d AS (
            SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                    WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        c AS (
            SELECT *, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
                array_to_string(w[greatest(a, b) + 1:], '') AS s FROM d)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM c""",
    "op12_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
        scored AS (
            SELECT q.vec_id AS query_id, q.v, c.vec_id, coalesce(list_inner_product(q.v, c.v), 0)::BIGINT AS score
            FROM q JOIN v AS c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id)
        SELECT query_id, rank::INT AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT row_number() OVER () AS piece_id, * FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        w AS (
            SELECT piece_id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i
            FROM (SELECT piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
        runs AS (
            SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM w WINDOW p AS (PARTITION BY piece_id ORDER BY i)),
        grams AS (
            SELECT lang, w1 AS p FROM runs UNION ALL SELECT lang, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
            UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
            UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL),
        f AS MATERIALIZED (SELECT lang, p, string_split(p, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, p),
        found AS MATERIALIZED (SELECT * FROM f WHERE len(w) > 1 AND f >= 30),
        heads AS (
            SELECT lang, p, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, len(w))) AS k FROM found)),
        cuts AS (
            SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
            FROM heads AS c JOIN f AS x ON x.lang = c.lang AND x.p = c.head JOIN f AS y ON y.lang = c.lang AND y.p = c.tail),
        scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        inner_f AS (
            SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS p, max(f) AS f
            FROM (SELECT lang, w, f, size, unnest(range(1, len(w) - size + 2)) AS i FROM found, range(2, 4) AS s(size) WHERE size < len(w)) GROUP BY ALL),
        kept AS (
            SELECT s.* FROM scored AS s LEFT JOIN inner_f AS o ON o.lang = s.lang AND o.p = s.p WHERE o.f IS NULL OR 100 * o.f::HUGEINT < 80 * s.a::HUGEINT),
        n AS (SELECT lang, count(*)::BIGINT AS n FROM w GROUP BY lang)
        SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000""",
}
