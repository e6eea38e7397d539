"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file is: in ``POLYCAT_TOKENIZERS``, or else where the installed files are."""
    folder = os.environ.get("POLYCAT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.langid import identify, train
    from polycat.llm.shared import fold

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.importance import resample

    labels = _table(spark, sf_dir, "labels")
    share = labels.agg(F.avg("quality")).first()[0]
    good = labels.where("quality = 1").select("doc_id")
    return resample(_table(spark, sf_dir, "documents"), good, share=share if share is not None else 1.0)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


# Slot by slot.  A weight is the root of a source's rows, times 2^40 and rounded down, so all is exact.  t(j / w) is the sum over all
# sources of the lesser of (weight * j) / w and blocks: when block j is released, and with j + 1 its deadline.
OP4_SQL = """
WITH RECURSIVE named AS (SELECT doc_id, source, coalesce('{"s":"' || source || '"}', '{}') AS s, md5(coalesce(doc_id::VARCHAR, '') || ':0') AS h FROM documents),
block_of AS (SELECT greatest(16, (count(*) + 1048575) // 1048576) AS n FROM documents),
size AS (SELECT s, ceil(count(*) / (SELECT n FROM block_of))::HUGEINT AS l, floor(sqrt(count(*)) * 1099511627776)::HUGEINT AS w FROM named GROUP BY s),
timed AS (
  SELECT a.s, a.j, a.w, list_reduce(list(least(b.w * a.j, b.l * a.w)), lambda x, y: x + y) AS total
  FROM (SELECT s, w, l, unnest(generate_series(0, l::BIGINT))::HUGEINT AS j FROM size) a, size b GROUP BY a.s, a.j, a.w),
window_of AS (
  SELECT x.s, x.j, x.total // x.w AS released, (y.total + y.w - 1) // y.w AS deadline FROM timed x JOIN timed y ON y.s = x.s AND y.j = x.j + 1),
slot AS (
  SELECT -1::BIGINT AS t, NULL::VARCHAR AS pick, (SELECT list({'s': s, 'q': q}) FROM (SELECT s, list({'d': deadline, 'r': released} ORDER BY j) AS q FROM window_of GROUP BY s)) AS live
  UNION ALL
  SELECT t, pick, list_filter(list_transform(live, lambda x: {'s': x.s, 'q': CASE WHEN x.s = pick THEN x.q[2:] ELSE x.q END}), lambda x: len(x.q) > 0)
  FROM (SELECT t + 1 AS t, live, list_sort(list_transform(list_filter(live, lambda x: x.q[1].r <= t + 1), lambda x: {'d': x.q[1].d, 's': x.s}))[1].s AS pick
        FROM slot WHERE len(live) > 0)),
block AS (SELECT t, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS block FROM slot WHERE t >= 0),
ranked AS (SELECT doc_id, source, s, n, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS rank FROM named, block_of)
SELECT doc_id, source, t AS mix_slot, rank % n AS mix_offset, row_number() OVER (ORDER BY t, rank % n) - 1 AS mix_position
FROM ranked JOIN block ON block.pick = ranked.s AND block.block = rank // n
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.shared import fold
    from polycat.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    model = train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.tokens import compiled, token_counts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, compiled(tokenizer_path(TOKENIZER)), limit=1024)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.minhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=85)
    # The operator keeps one row of each group; this query's rows are kept by their id.
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.leaks import find_leaks

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", F.inline("leaks"))
    return found.select("doc_id", "item_id", "cosine", "share", "start")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.fingerprints import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.lines import apply_bitmaps, shared_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, shared_lines(docs, least=40, copies=5))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), sha.alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
shared AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, shared.key IS NOT NULL AND k.doc_id <> shared.top AS gone FROM k LEFT JOIN shared ON k.key = shared.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.chat import digests, format_chats

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    tricky = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digests(format_chats(turns.unionByName(tricky)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last,
    length(text) + len(regexp_extract_all(text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*<ANS>>|<\\*<ROLE>>|<\\*</ROLE>>|<\\*</TURN>>'))
      + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 18 WHEN 'assistant' THEN 13 ELSE 26 + length(role) END AS formatted
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                WHEN role = 'user' THEN before IN ('assistant', 'system')
                WHEN role = 'assistant' THEN before = 'user' ELSE false END
           AND (NOT last OR role = 'assistant')) AS valid
FROM t GROUP BY conv_id
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.infill import digests, fill_in_middle

    return digests(fill_in_middle(_table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
u AS (
  SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<P>|<S>|<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polycat.llm.sketches import with_edits

    return with_edits(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_importance_resampling": op2_importance_resampling,
        "op3_toxicity": op3_toxicity,
        "op4_mix_sources": op4_mix_sources,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_decontaminate": op7_decontaminate,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_chat_format": op9_chat_format,
        "op10_token_counts": op10_token_counts,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_document_fingerprints": op12_document_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express; the others are tested against brute force or held-out rows."""
    return {"op4_mix_sources": OP4_SQL, "op5_minhash_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_fill_in_middle": OP11_SQL}
