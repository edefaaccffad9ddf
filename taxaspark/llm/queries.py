"""The registered queries of the corpus operators, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.llm import bpe, chat, decontaminate, linealign, linehash, packing, phrases, pii, quality, repair, simhash, sitetree, toxicity
from taxaspark.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity.toxicity(F.col("text"), scorer).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linehash.substring_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), spans.alias("spans"),
                      F.array_join(F.transform("first_docs", lambda x: x.cast("string")), ",").alias("first_docs"), F.sha2(F.coalesce("deduped", F.lit("")), 256).alias("text_sha256"))


#: A conversation that spells control strings.
SPELLED = r"### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPELLED).alias("text"))
    out = chat.format_chat(turns.unionByName(own)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linealign.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",")
    return out.select("doc_id", "partners", F.size("removed_lines").cast("long").alias("n_removed"), lines.alias("removed_lines"), F.sha2(F.coalesce("deduped", F.lit("")), 256).alias("text_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", F.round("loss", 6).alias("loss"))


def op7_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a twentieth each of their rows dropped, emptied, cut, repeated and given to the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = repair.repair(damaged(turns))
    hashes = repair.digests(out.turns, F.concat("role", F.lit(":"), "text"))
    own = lambda df, name: (df.withColumnRenamed("conv_id", name), F.col("conv_id").eqNullSafe(F.col(name)), "left")
    all_ids = turns.select("conv_id").distinct().join(*own(out.audits, "_audited")).join(*own(hashes, "_hashed"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode("text", path, public_tokenizers.PATTERN).alias("ids"))
    written = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2(bpe.decode("ids", path), 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_personal_data, op3_substring_dedup, op4_chat_format, op5_line_dedup,
        op6_quality_rules, op7_site_tree, op8_best_fit_packing, op9_simhash_near_dedup, op10_decontamination,
        op11_conversation_repair, op12_collocations, op13_byte_bpe,
    )
}
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = f"list_filter(string_split_regex(translate(coalesce(text, ''), {_UPPER}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FULL = "regexp_matches(x, '[^\\x20\\x09-\\x0D]')"
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_SYMBOLS = f"(length({{0}}) - length(regexp_replace({{0}}, {_quoted(quality.SYMBOLS)}, '', 'g')))"
_PASSES = f"""((regexp_matches(x, {_quoted(quality.TERMINAL)}) OR regexp_matches(x, {_quoted(quality.SENTENCE)})) AND {_SYMBOLS.format("x")} <= length(x) * 0.08
   AND length(x) - length(replace(x, '!!', '')) <= greatest(4, length(x) * 0.08) AND NOT regexp_matches(x, {_quoted(quality.BOILERPLATE)}) AND NOT regexp_matches(lower(x), {_quoted(quality.NAVIGATION)}))"""

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": """WITH l AS (SELECT doc_id, pos, x, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(x) - 1 AS a, pos = max(pos) OVER (PARTITION BY doc_id) AS last
   FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
  u AS (SELECT *, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS k FROM l),
  f AS (SELECT *, len(string_split(k, ' ')) >= 5 AND k <> '' AND row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS gone, first_value(doc_id) OVER (PARTITION BY k ORDER BY doc_id, pos) AS first FROM u)
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(x)) FILTER (gone), 0)::BIGINT AS removed_chars,
   coalesce(string_agg(a::BIGINT || ':' || (a + length(x))::BIGINT, ',' ORDER BY pos) FILTER (gone), '') AS spans,
   coalesce(list_aggregate(list_sort(list(DISTINCT first) FILTER (gone)), 'string_agg', ','), '') AS first_docs,
   sha256(coalesce(string_agg(x || CASE WHEN last THEN '' ELSE chr(10) END, '' ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256 FROM f GROUP BY doc_id""",
    "op4_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{SPELLED}' UNION ALL SELECT -7, 1, 'assistant', '{SPELLED}'),
  n AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS joined, lead(role) OVER w IS NOT DISTINCT FROM role AS more FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
   sum(length({_ESC.format("text")}) + CASE WHEN joined THEN 6 ELSE 7 + length({_ESC.format("role")}) END + CASE WHEN more THEN 0 ELSE 8 END)::BIGINT AS formatted_chars FROM n GROUP BY conv_id""",
    "op6_quality_rules": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d))),
  r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY 1),
  e AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_SYMBOLS.format("text")} AS n_symbols, list_filter(lines, lambda x: {_FULL}) AS full_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
  v AS (SELECT *, list_filter(full_lines, lambda x: NOT {_PASSES}) AS failed FROM e),
  s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN length(regexp_replace(array_to_string(list_filter(failed, lambda x: NOT regexp_matches(x, {_quoted(quality.BOILERPLATE)})), ''), '[\\x20\\x09-\\x0D]+', '', 'g')) / word_chars ELSE 0.0 END AS loss FROM v)
  SELECT doc_id, n_words, word_chars, n_symbols, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND loss <= 0.6 AS kept, len(failed) AS n_lines_removed, round(loss, 6) AS loss FROM s""",
    "op10_decontamination": f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
  i AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
  x AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i))),
  h AS (SELECT doc_id, item_id, s, n FROM x JOIN i USING (n, k)),
  p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) GROUP BY 1),
  t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
  FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_collocations": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_UPPER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
  g AS (SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, range(1, 6) AS r(m) WHERE len(w) >= m)),
  f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100), t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
  c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
  k AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
  s AS (SELECT k.lang, k.phrase, a, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score, k FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y JOIN t ON t.lang = k.lang),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  i AS (SELECT DISTINCT o.lang, o.phrase FROM (SELECT lang, a, m, unnest(flatten(list_transform(range(2, m), lambda z: list_transform(range(1, m - z + 2), lambda q: array_to_string(ws[q:q + z - 1], ' '))))) AS phrase FROM c) l JOIN c o USING (lang, phrase) WHERE 100 * l.a >= 100 * o.a)
  SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN i USING (lang, phrase)) WHERE rank <= 2000""",
}
