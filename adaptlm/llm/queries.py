"""The check queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.suffixes import repeated_spans

    found = repeated_spans(_table(spark, sf_dir, "documents"))
    n = F.octet_length("text").cast("long")
    return found.select("doc_id", n.alias("n_bytes"), (n - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.mixing import mix
    from adaptlm.llm.quality import train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return mix(docs, model).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.quality import scored, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op5_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from adaptlm.llm.separators import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256)


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.blocks import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from adaptlm.llm.mixing import CYCLE
    from adaptlm.llm.packing import pack_digests

    return pack_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), weights=CYCLE)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.codes import code_digests

    return code_digests(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.interpolation import scored_texts

    return scored_texts(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adaptlm.llm.whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffixes": op1_suffixes,
    "op2_mixing": op2_mixing,
    "op3_neighbours": op3_neighbours,
    "op4_quality": op4_quality,
    "op5_separators": op5_separators,
    "op6_rules": op6_rules,
    "op7_warc": op7_warc,
    "op8_neardup": op8_neardup,
    "op9_blocks": op9_blocks,
    "op10_packing": op10_packing,
    "op11_codes": op11_codes,
    "op12_interpolation": op12_interpolation,
    "op13_whitening": op13_whitening,
}



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds of assignment and floored means as steps of a WITH list, a row for each component; vectors of the table's one width."""
    steps = [f"""k AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT rid, unnest(e) AS c, generate_subscripts(e, 1) - 1 AS d, len(e) // {parts} AS w FROM k),
x AS (SELECT rid, d // w AS p, d % w AS j, floor({scale} * c::DOUBLE)::BIGINT AS x FROM u),
b0 AS (SELECT p, rid - 1 AS i, j, x AS c FROM x WHERE rid <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT rid, p, i, sum((x - c) * (x - c))::BIGINT AS far FROM x JOIN b{r} USING (p, j) GROUP BY ALL),
a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY far, i) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, i, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (rid, p) GROUP BY ALL),
b{r + 1} AS (SELECT p, i, j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{r} LEFT JOIN m{r} USING (p, i, j))""")
    return "WITH " + ",\n".join(steps) + f""",
v AS (SELECT rid, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, i, j)) FROM b{rounds}) AS codebooks_sha256 FROM v JOIN k USING (rid)"""


_W = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op11_codes": _codes_sql(),
    "op6_rules": rf"""
WITH x AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS ls FROM x),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) u(i)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, range(5) r(j) GROUP BY rid),
line AS (SELECT rid, doc_id, host, l, len(regexp_extract_all(l, '{_W}')) AS n, trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM w, unnest(ls) u(l)),
lim AS (SELECT host, greatest(20, count(DISTINCT coalesce('d' || doc_id, 'r' || rid)) * 0.01) AS lim FROM x GROUP BY host),
freq AS (SELECT host, norm, count(DISTINCT coalesce('d' || doc_id, 'r' || rid)) AS n FROM line GROUP BY 1, 2),
common AS (SELECT f.host, f.norm FROM freq f JOIN lim l ON f.host IS NOT DISTINCT FROM l.host WHERE f.n > l.lim),
lost AS (SELECT rid, sum(n) AS gone FROM line l JOIN common c ON l.norm = c.norm AND l.host IS NOT DISTINCT FROM c.host GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
(len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0) AS gone FROM w LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - gone >= 10 AND gone <= 0.5 * n_words AS kept FROM m""",
    "op7_warc": """
WITH x AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT rid, page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM x),
f AS (SELECT *, first_value(rid) OVER w AS first_rid, first_value(page_id) OVER w AS first_page FROM d WINDOW w AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST, rid))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND rid <> first_rid THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND rid <> first_rid THEN first_page END AS refers_to FROM f""",
}
