"""Queries of this subpackage, by key, and their SQL where SQL can express them."""

from pyspark.sql import functions as F

from rotorwatch.llm import (
    byte_bpe, conversation_repair, decontaminate, line_dedup, pii_crf, piece_codec, sharding, simhash_dedup, token_counts, toxicity_fm, url_templates, vector_codes, weak_quality,
)
from rotorwatch.llm.common import table


# The rule list of the query: a rule is host and path start.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_path_template_tree(spark, sf_dir):
    """A url ends in the number of the document that the page shows; a page is bad if that document's quality is 0."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    number = F.regexp_extract(url_templates.split_url(F.col("url"))[1], "/([0-9]{1,18})(?:[/.]|$)", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    quality = table(spark, sf_dir, "labels", "doc_id", "quality").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = shown.join(quality, "doc_id").groupBy("page_id").agg((1 - F.min("quality")).alias("bad"))
    return url_templates.judge_urls(pages, labels, URL_RULES)


def op2_skip_chain_crf(spark, sf_dir):
    return pii_crf.find(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_sampled_splitter_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_weak_supervision(spark, sf_dir):
    return weak_quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_latent_retrieval(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_segment_popcount_simhash(spark, sf_dir):
    return simhash_dedup.near_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_factorization_machine(spark, sf_dir):
    return toxicity_fm.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op8_fuzzy_lines(spark, sf_dir):
    lines = line_dedup.line_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return lines.drop("text_id", "first_text_id")


def op9_streaming_viterbi_codec(spark, sf_dir):
    coded = piece_codec.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return coded.select("doc_id", "n_ids", "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "round_trip")


def op10_count_only_viterbi(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_checkpointed_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_repair.repair_summary(conversation_repair.damaged(rows))


def op12_value_dictionary_codes(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", vector_codes.hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op13_word_shuffle_bpe(spark, sf_dir):
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_path_template_tree, op2_skip_chain_crf, op3_sampled_splitter_shards, op4_weak_supervision, op5_latent_retrieval, op6_segment_popcount_simhash, op7_factorization_machine, op8_fuzzy_lines,
    op9_streaming_viterbi_codec, op10_count_only_viterbi, op11_checkpointed_repair, op12_value_dictionary_codes, op13_word_shuffle_bpe,
)}


def _url_sql() -> str:
    """The template tree level by level, as common table expressions."""
    t = url_templates
    rules = "".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'\n"
        for r, _ in sorted(URL_RULES, key=lambda r: -len(r[0])))
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES)
    levels = "".join(f"""
r{k} AS (SELECT *, parts[{k + 1}] AS part FROM p{k}),
b{k} AS (SELECT host, template, part, count(*) AS n, count(bad) AS l, coalesce(sum(bad), 0) AS b FROM r{k} GROUP BY ALL),
q{k} AS (SELECT host, template, sum(l) AS pl, sum(b) AS pb FROM b{k} GROUP BY ALL),
k{k} AS (SELECT host, template, part, true AS own FROM b{k} JOIN q{k} USING (host, template)
  WHERE part IS NOT NULL AND n >= {t.LEAST_PAGES} AND l >= {t.LEAST_LABELS}
    AND abs(b / l - pb / pl) > {t.Z:e} * sqrt(pb / pl * (1 - pb / pl) * (1 / l + 1 / pl))),
p{k + 1} AS (SELECT page_id, host, path, bad, parts, CASE WHEN part IS NULL THEN template
    ELSE concat(template, '/', CASE WHEN own THEN part ELSE '*' END) END AS template
  FROM r{k} LEFT JOIN k{k} USING (host, template, part)),""" for k in range(t.LEVELS))
    return f"""
WITH cut AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{t.CAPITALS}', '{t.CAPITALS.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
plain AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda x: x <> '') AS every,
    nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1), '') AS number FROM cut),
p0 AS (SELECT page_id, host, path, 1 - q.quality AS bad, '' AS template, CASE WHEN len(every) > {t.LEVELS}
    THEN list_append(every[1:{t.LEVELS - 1}], array_to_string(every[{t.LEVELS}:], '/')) ELSE every END AS parts
  FROM plain LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q
    ON CAST(number AS BIGINT) = q.doc_id),{levels}
whole AS (SELECT (coalesce(sum(bad), 0) + 1) / (count(bad) + 4) AS prior FROM p{t.LEVELS}),
shares AS (SELECT host, template, (coalesce(sum(bad), 0) + {t.PRIOR_PAGES:e} * max(prior)) / (count(bad) + {t.PRIOR_PAGES:e}) AS share
  FROM p{t.LEVELS}, whole GROUP BY host, template),
ruled AS (SELECT *, CASE {rules} END AS rule FROM p{t.LEVELS} JOIN shares USING (host, template))
SELECT page_id, host, path, rule,
  coalesce(CASE rule {verdicts} END, CASE WHEN share >= {t.REJECT_FROM:e} THEN 'block' ELSE 'allow' END) AS verdict,
  template, 1 - share AS purity FROM ruled"""


def _codes_sql() -> str:
    """The rounds as common table expressions, over all pairs of a part and an entry of its codebook."""
    v = vector_codes
    near = """n{k} AS MATERIALIZED (SELECT r, p, min({{'d': CAST(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': e}}) AS m
  FROM parts JOIN b{k} USING (p) GROUP BY r, p)"""
    rounds = ",\n".join(near.format(k=k) + f""",
m{k} AS (SELECT p, e, list(x ORDER BY pos) AS fresh FROM (SELECT p, m.e AS e, pos, CAST(floor(sum(part[pos]) / count(*)) AS BIGINT) AS x
  FROM n{k} JOIN parts USING (r, p), places GROUP BY ALL) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(fresh, entry) AS entry FROM b{k} LEFT JOIN m{k} USING (p, e))""" for k in range(v.ROUNDS))
    return f"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({v.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT CAST(max(len(whole)) // {v.PARTS} AS BIGINT) AS w FROM rows),
places AS (SELECT unnest(range(1, (SELECT w FROM wide) + 1)) AS pos),
parts AS MATERIALIZED (SELECT r, p, whole[p * w + 1:(p + 1) * w] AS part FROM rows, wide, range({v.PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, part AS entry FROM parts WHERE r <= {v.ENTRIES}),
{rounds},
{near.format(k=v.ROUNDS)},
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n{v.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM b{v.ROUNDS}) AS codebooks_sha256
FROM rows JOIN coded USING (r)"""


def _repair_sql() -> str:
    """Damage, faults, and the dynamic program backward over rows; a state holds its cost, nine digits wide, and its edits as one text."""
    r = conversation_repair

    def plus(state, cost, edit):
        return f"concat(lpad(CAST(CAST(left({state}, 9) AS INT) + {cost} AS VARCHAR), 9, '0'), '{edit}', substr({state}, 10))"

    def base(q):
        extra = f"CASE fault WHEN 1 THEN {r.TRUNCATED} ELSE 0 END"
        options, n = [f"WHEN fault >= 2 THEN {plus(f's{q}', r.DELETE, 'D')}"], r.NEXT[q]
        common = f"{plus(f's{q}', r.DELETE, 'D')}, {plus(f's{n}', f'{r.REROLE} + {extra}', 'R')}"
        for (state, initial), after in r.KEPT.items():
            if state == q:
                options.append(f"WHEN initial = '{initial}' THEN least({common}, {plus(f's{after}', extra, 'K')})")
        return f"CASE {' '.join(options)} ELSE least({common}) END AS b{q}"

    user, assistant = f"least(b2, {plus('b3', r.INSERT, 'I')})", f"least(b3, {plus('b2', r.INSERT, 'I')})"
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, LATERAL (SELECT unnest(CASE kind WHEN 3 THEN [0, 1] WHEN 0 THEN [] ELSE [0] END)) copies),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
lines AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 2
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
      WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
    concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i), left(role, 1)) AS pair FROM placed),
states AS (SELECT conv_id, max(i) AS i, '000000000' AS s0, '000000010II' AS s1, '000000005I' AS s2, '000000000' AS s3 FROM lines GROUP BY conv_id
  UNION ALL SELECT conv_id, i - 1, least(b0, {plus(user, r.INSERT, 'I')}), least(b1, {plus(user, r.INSERT, 'I')}), {user}, {assistant}
  FROM (SELECT s.conv_id, s.i, {', '.join(map(base, range(4)))} FROM states s JOIN lines l ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.i = s.i)),
plans AS MATERIALIZED (SELECT conv_id, CAST(left(s0, 9) AS BIGINT) AS cost, substr(s0, 10) AS audit FROM states WHERE i = 0),
edits AS (SELECT *, sum(CASE edit WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS i
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(len(audit))) AS j FROM plans)),
given AS (SELECT e.conv_id, edit, role, text, initial, row_number() OVER (PARTITION BY e.conv_id ORDER BY j) AS k
  FROM edits e LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.i = e.i AND edit <> 'I' WHERE edit <> 'D'),
roles AS (SELECT *, (k + max(CASE WHEN k = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) % 2 = 1 AS is_user FROM given),
hashes AS (SELECT conv_id, sha256(string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN is_user THEN 'user' ELSE 'assistant' END, ':', coalesce(text, '')), chr(10) ORDER BY k))
  AS repaired_sha256 FROM roles GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 2) AS blank,
    count(*) FILTER (WHERE fault = 3) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated,
    count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""


# The others have hashes, fitted models or iterations that SQL does not express; their tests compare with brute force.
ORACLE_SQL = {"op1_path_template_tree": _url_sql(), "op11_checkpointed_repair": _repair_sql(), "op12_value_dictionary_codes": _codes_sql()}
