"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.llm import chat, crf, fill_middle, minhash, mixing, packing, pseudo_likelihood, quality_classifier, quality_rules, ranked_search, simhash, substring_dedup, warc
from lanegraph.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crf.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.group_documents(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_edited(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


#: A conversation of control strings, added to all others.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast(talks.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(talks.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return chat.digest(chat.format_conversations(talks.unionByName(probe)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= quality_classifier.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["length"])
    return made.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {
        "op1_crf_language": op1_crf_language,
        "op2_simhash": op2_simhash,
        "op3_minhash": op3_minhash,
        "op4_warc": op4_warc,
        "op5_packing": op5_packing,
        "op6_chat": op6_chat,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_quality_rules": op9_quality_rules,
        "op10_pseudo_likelihood": op10_pseudo_likelihood,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_ranked_search": op12_ranked_search,
        "op13_fill_middle": op13_fill_middle,
    }


#: Base32 of the SHA-1: every five hex digits are four letters.
_DIGIT = "(instr('0123456789abcdef', substr(h, i * 5 + {}, 1)) - 1)"
_TWENTY = " + ".join(f"{_DIGIT.format(k + 1)} * {16 ** (4 - k)}" for k in range(5))
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_TWENTY}) // {32 ** k}) % 32 + 1, 1)" for k in (3, 2, 1, 0))

OP4_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
 lead AS (SELECT t, max(page_id) AS leader FROM p GROUP BY t HAVING count(*) > 1),
 d AS (SELECT page_id, octet_length(encode(p.t)) AS n, sha1(p.t) AS h, CASE WHEN leader <> page_id THEN leader END AS refers_to FROM p LEFT JOIN lead USING (t))
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: {_LETTERS}), '') AS payload_digest,
 CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM d"""

#: Lengths follow from the template: opening and closing strings, and a backslash after each control character of a text.
OP6_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}'),
 f AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '<', ''), '[', ''), '\', '')) + CASE role {" ".join(f"WHEN '{r}' THEN {len(x['open']) + len(x['close'])}" for r, x in chat.TEMPLATE["roles"].items())}
 ELSE {len(chat.TEMPLATE["other"]["open"]) - len("{role}") + len(chat.TEMPLATE["other"]["close"])} + length(role) + length(role) - length(replace(replace(replace(role, '<', ''), '[', ''), '\', '')) END AS n FROM t)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n) AS BIGINT) AS formatted_chars, regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text), '(system )?user assistant( user assistant)*') AS valid FROM f GROUP BY conv_id"""


#: Windows of 13 words by their own text, the smallest id of each, and the words that no later window covers.
OP11_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 s AS (SELECT doc_id, i AS pos, array_to_string(words[i:i + 12], ' ') AS x FROM w, unnest(range(1, len(words) - 11)) AS t(i)),
 hit AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY x) AS least FROM s) WHERE least < doc_id),
 gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM hit, unnest(range(0, 13)) AS t(k)),
 one AS (SELECT doc_id, i AS pos, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
 r AS (SELECT one.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY one.pos) FILTER (gone.pos IS NULL) AS kept FROM one LEFT JOIN gone ON gone.doc_id = one.doc_id AND gone.pos = one.pos GROUP BY one.doc_id)
 SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)"""

OP12_SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
 c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
 m AS (SELECT doc_id, 25 + ((75 * n * docs) // terms) AS m FROM len, c),
 p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
 w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
 s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
 SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 10"""

#: The units matched one by one, the parts joined from them; what is restored is the text itself.
OP13_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
 u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
 f AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
 c AS (SELECT *, array_to_string(units[1:lo], '') AS a, array_to_string(units[lo + 1:hi], '') AS b, array_to_string(units[hi + 1:], '') AS z FROM f)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express: the others use XXH64, trained models, sub-word merges or packing; tests compare those with brute force."""
    return {"op4_warc": OP4_SQL, "op6_chat": OP6_SQL, "op11_substring_dedup": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_fill_middle": OP13_SQL}
