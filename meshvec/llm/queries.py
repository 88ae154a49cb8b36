"""The queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshvec.llm import alignment, chat, extraction, fingerprint, infill, media, mixing, neardup, packing, pii, quality, simhash, toxicity
from meshvec.llm.common import table

#: Target weights of the characters by source; all other sources share OTHER_WEIGHT.
MIX_WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.05}
OTHER_WEIGHT = 0.60
MIX_SEED = 17


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, other=OTHER_WEIGHT, seed=MIX_SEED)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_snapshots(table(spark, sf_dir, "conversations"))


def remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a vocabulary file lies, on the driver as on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024, end_id=2)


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op6_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_semi_markov_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.detect_pii(docs, pii.train_pii(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op11_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), words=4, radius=4)


def op12_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer_alignment(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_marker_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    lengths = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return made.select("doc_id", "n", "form", *lengths, *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_poisson_mix, op2_order_minhash, op3_best_two_fit, op4_parity_join, op5_media_sequences, op6_factorization_machine, op7_snapshot_collapse, op8_additive_model,
        op9_semi_markov_crf, op10_tree_scoring, op11_pivot_simhash, op12_interval_alignment, op13_marker_infill,
    )
    return {f.__name__: f for f in every}


_WEIGHTS_SQL = ", ".join(f"('{s}', {w})" for s, w in MIX_WEIGHTS.items())

ORACLE_SQL = {
    "op1_poisson_mix": f"""
WITH weights(source, weight) AS (VALUES {_WEIGHTS_SQL}),
d AS (SELECT documents.*, w.source AS class FROM documents LEFT JOIN weights w ON documents.source = w.source),
sizes AS (SELECT class, sum(length(coalesce(text, ''))) AS size FROM d GROUP BY class),
wanted AS (SELECT s.class, s.size, coalesce(w.weight, {OTHER_WEIGHT}) AS weight
           FROM sizes s LEFT JOIN weights w ON s.class = w.source WHERE s.size > 0),
rates AS (SELECT class, (SELECT sum(size) FROM sizes) * (weight / (SELECT sum(weight) FROM wanted)) / size AS rate FROM wanted),
steps AS (SELECT class, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, range(0, 400) t(k)),
cdf AS (SELECT class, k, sum(p) OVER (PARTITION BY class ORDER BY k) AS c FROM steps),
drawn AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.class,
          ('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null ' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
copies AS (SELECT r.doc_id, r.text, r.lang, r.source, r.n_chars, c.k AS copy
           FROM drawn r JOIN cdf c ON r.class IS NOT DISTINCT FROM c.class AND c.c <= r.u)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5('order{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, ''))) || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM copies
""",
    "op7_snapshot_collapse": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
r AS (SELECT t.*, '<|' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') || '|>' || chr(10)
             || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || chr(10) || '<|end|>' || chr(10) AS line FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(role || chr(0) || text ORDER BY pos) AS turns, string_agg(line, '' ORDER BY pos) AS rendered
      FROM r WHERE conv_id IS NOT NULL GROUP BY conv_id
      UNION ALL SELECT DISTINCT NULL, 1, [role || chr(0) || text], line FROM r WHERE conv_id IS NULL),
d AS (SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns)
SELECT c.conv_id, c.n_turns, c.rendered FROM c JOIN d ON c.turns = d.turns AND c.conv_id IS NOT DISTINCT FROM d.conv_id
WHERE NOT EXISTS (SELECT 1 FROM d o WHERE len(o.turns) > c.n_turns AND o.turns[1:c.n_turns] = c.turns)
""",
    "op13_marker_infill": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digits FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(digits, 1, 8))::BIGINT AS h1, ('0x' || substr(digits, 9, 8))::BIGINT AS h2,
             ('0x' || substr(digits, 17, 8))::BIGINT AS h3, ('0x' || substr(digits, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '{infill.PREFIX}') OR contains(text, '{infill.SUFFIX}') OR contains(text, '{infill.MIDDLE}')
                       OR h3 % 100 >= {infill.PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {infill.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
             coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{infill.PREFIX}' || p || '{infill.SUFFIX}' || s || '{infill.MIDDLE}' || m
                   ELSE '{infill.SUFFIX}' || s || '{infill.PREFIX}' || p || '{infill.MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
