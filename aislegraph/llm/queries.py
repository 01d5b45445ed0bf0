"""The registered queries of the package: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(column: str, parts: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, then everything in reach of each document.
NEAR_COPIES = f"""WITH RECURSIVE read AS (
    SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS words FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS h
    FROM read, unnest(range(1, greatest(len(words) - 3, 2))) t(i) WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.low AS component_id, r.low = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id"""

#: Every window of 35 words of every document.
REPEATS = f"""WITH read AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents
), windows AS (
    SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM read, unnest(range(1, len(words) - 33)) t(i) WHERE len(words) >= 35
), repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), covered AS (SELECT DISTINCT r, i + d AS p FROM windows JOIN repeated USING (h) CROSS JOIN range(0, 35) t(d)
), places AS (
    SELECT read.r, p, words[p] AS word FROM read, unnest(range(1, len(words) + 1)) t(p)
), kept AS (
    SELECT r, count(*) AS n, array_to_string(list(word ORDER BY p), ' ') AS text FROM places ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM read LEFT JOIN kept USING (r)"""


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.token_files import read_documents, shared_folder, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), shared_folder(spark, "token-files"), tokenizer("word_bpe_49k.json"))
    return read_documents(files)


@query("op10_language_filters")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.language import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    return predict(docs, train(docs.where(~F.col("held_out")))).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_repeated_windows", REPEATS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op9_deleted_interpolation")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"), lambda doc_id: zlib.crc32(str(doc_id).encode()) % 5 == 1)


@query("op3_multi_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.multi_index import search

    return search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


@query("op4_benchmark_leaks")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.leaks import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_near_copies", NEAR_COPIES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.near_copies import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.secret_scan import scan_secrets, secret_digest

    return secret_digest(scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.personal_data import find_personal_data, personal_data_digest

    return personal_data_digest(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def clustering_sql(k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64) -> str:
    """Plain assignment to every centroid, round by round."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS c, v AS m FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) <= {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
            SELECT vec_id, v, b.c AS c, b.d AS d FROM (
                SELECT kept.vec_id, any_value(kept.v) AS v,
                       min({{'d': CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (kept.v[i] - c{r}.m[i]) * (kept.v[i] - c{r}.m[i]))) AS BIGINT), 'c': c{r}.c}}) AS b
                FROM kept CROSS JOIN c{r} GROUP BY kept.vec_id))"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
            SELECT c{r}.c, coalesce(moved.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
                    SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, {dims + 1}) t(i) GROUP BY c, i) GROUP BY c
            ) moved ON c{r}.c = moved.c)"""
            )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, a{rounds}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


@query("op11_threshold_clusters", clustering_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.clustering import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_quality_machine")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.quality import score, train

    docs, labels, metadata = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["n_chars"]
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    judged = score(docs, train(docs, labels.where(~held_out), metadata=metadata), metadata)
    return judged.select("doc_id", held_out, "score", "predicted")


@query("op13_merge_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aislegraph.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def _base_spans_sql(kinds: list[tuple[str, str, str]], order: str) -> str:
    """Leftmost matches of (kind, pattern, condition on v or its group g), counted and digested for each document."""
    parts = [
        f"""m{k} AS (
    SELECT r, {k} AS rank, '{kind}' AS kind, v, g, sum(length(gap) + length(v)) OVER (PARTITION BY r ORDER BY i) - length(v) AS start
    FROM (SELECT r, unnest(range(1, len(regexp_extract_all(text, {pattern})) + 1)) AS i,
                 unnest(regexp_extract_all(text, {pattern})) AS v, unnest(regexp_extract_all(text, {pattern}, 1)) AS g,
                 unnest(string_split_regex(text, {pattern})[1:len(regexp_extract_all(text, {pattern}))]) AS gap FROM read)
), k{k} AS (SELECT * FROM m{k} WHERE {condition})"""
        for k, (kind, pattern, condition) in enumerate(kinds)
    ]
    every = " UNION ALL ".join(f"SELECT r, rank, kind, CAST(start AS BIGINT) AS start, CAST(start + length(v) AS BIGINT) AS stop FROM k{k}" for k in range(len(kinds)))
    counts = ", ".join(f"count(*) FILTER (rank = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(kinds))
    return f"""WITH read AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), {", ".join(parts)}, spans AS ({every}), told AS (
    SELECT r, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}) AS listed FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in kinds)}, sha256(coalesce(listed, '')) AS base_sha256
FROM read LEFT JOIN told USING (r)"""


SECRETS = _base_spans_sql([
    ("assign", r"""'(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""", "length(g) >= 6"),
    ("access", "'(AKIA[A-Z0-9]+)'", "length(v) >= 20"),
    ("hex", "'([0-9a-f]+)'", "length(v) >= 24"),
], "start, rank")

_NUMERALS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(0, length({_NUMERALS})), lambda j: CASE WHEN j % 2 = 0 THEN CAST({_NUMERALS}[length({_NUMERALS}) - j] AS INT) "
    f"WHEN CAST({_NUMERALS}[length({_NUMERALS}) - j] AS INT) > 4 THEN 2 * CAST({_NUMERALS}[length({_NUMERALS}) - j] AS INT) - 9 "
    f"ELSE 2 * CAST({_NUMERALS}[length({_NUMERALS}) - j] AS INT) END)) % 10 = 0"
)
PRIVATE = _base_spans_sql([
    ("email", r"'([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)'", "true"),
    ("ip", r"'([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)'", "len(list_filter(string_split(v, '.'), lambda x: coalesce(try_cast(x AS BIGINT), 256) > 255)) = 0"),
    ("card", r"'([0-9](?:[\x20-]?[0-9])+)'", f"length({_NUMERALS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"'(\+[0-9][\x20().0-9-]+[0-9])'", f"length({_NUMERALS}) BETWEEN 9 AND 15"),
], "rank, start")


# What SQL can say of two operators: the columns of their fixed patterns, from the operators' own results.
@query("secret_base_spans", SECRETS)
def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


@query("personal_base_spans", PRIVATE)
def personal_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
