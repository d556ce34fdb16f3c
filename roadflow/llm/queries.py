"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.llm import decontaminate, jaccard, language, line_dedup, mixing, neighbours, pieces, preferences, scoring, shared_search, sharding, turn_repair, weak_labels
from roadflow.llm.registry import QUERIES, SQL, query, table
from roadflow.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION_SQL = rf"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
iw AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS ph
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM i WHERE len(w) > 0)),
dw AS (
    SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS ph
    FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s
          FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT r, s, k, item_id FROM dw JOIN iw USING (k, ph)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


@query("op8_decontamination", DECONTAMINATION_SQL)
def op8_decontamination(spark, folder):
    found = decontaminate.find_passages(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep_columns=["doc_id"])
    return found.select(
        "doc_id",
        "hits.n_words",
        decontaminate.hit_count().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
    )

SHARD_LIMIT = 32 << 20

SHARDING_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS row_bytes,
           ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) << 30)
           + (('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT >> 2) AS h
    FROM documents),
b AS (
    SELECT h, depth, h >> (60 - depth) AS prefix,
           sum(row_bytes) OVER w AS shard_bytes, min(h) OVER w AS low, max(h) OVER w AS high
    FROM d, (SELECT unnest(generate_series(0, 60)) AS depth)
    WINDOW w AS (PARTITION BY depth, h >> (60 - depth))),
leaf AS (
    SELECT h, min(depth) AS depth, arg_min(shard_bytes, depth) AS shard_bytes
    FROM b WHERE shard_bytes <= {SHARD_LIMIT} OR low = high GROUP BY h)
SELECT doc_id, row_bytes, depth::INTEGER AS shard_depth, shard_bytes::BIGINT AS shard_bytes,
       CASE WHEN depth > 0 THEN lpad(bin(h >> (60 - depth)), depth::INTEGER, '0') ELSE '' END AS shard
FROM d JOIN leaf USING (h)
"""


@query("op1_sharding", SHARDING_SQL)
def op1_sharding(spark, folder):
    return sharding.shard(table(spark, folder, "documents"), SHARD_LIMIT).select(
        "doc_id", "shard", "shard_depth", "shard_bytes", "row_bytes")


MIXING_SQL = """
WITH RECURSIVE s AS (
    SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (SELECT sum(n) FROM s) / ((SELECT sum(w) FROM s) * n) AS rate FROM s),
c AS (
    SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM r
    UNION ALL
    SELECT source, rate, k + 1, log_p + ln(rate / (k + 1)), total + exp(log_p + ln(rate / (k + 1)))
    FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
k AS (
    SELECT *, row_number() OVER () AS r, coalesce(doc_id::VARCHAR,
           'null:' || md5(':' || coalesce(text, '') || ':' || coalesce(lang, '') || ':' || coalesce(source, '') || ':' || coalesce(n_chars::VARCHAR, ''))
           || ':' || row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars)) AS key
    FROM documents),
d AS (SELECT *, ('0x' || substr(md5('9:' || key), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM k),
n AS (
    SELECT d.r, count(*) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.total <= d.u GROUP BY d.r)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       ('0x' || substr(md5('9:' || key || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT d.*, unnest(generate_series(1, copies)) AS copy FROM d JOIN n ON d.r = n.r)
"""


@query("op9_mixing", MIXING_SQL)
def op9_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))

@query("op2_language")
def op2_language(spark, folder):
    docs = table(spark, folder, "documents")
    model = language.learn(docs)
    held = docs.select("doc_id", language.held_out("doc_id").alias("held_out"), "text")
    return language.predict(held, model, keep_columns=["doc_id", "held_out"])


@query("op3_jaccard")
def op3_jaccard(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark, folder):
    return pieces.count_tokens(table(spark, folder, "documents"), keep_columns=["doc_id"])


@query("op7_neighbours")
def op7_neighbours(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


PREFERENCES_SQL = """
WITH t AS (
    SELECT conv_id AS conv, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, 'unknown'), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
p AS (
    SELECT min(conv) AS c, max(conv) AS r FROM (SELECT DISTINCT conv FROM t)
    GROUP BY floor(conv / 2) HAVING min(conv) <> max(conv)),
w AS (
    SELECT c, r, 'chosen' AS part, place, role, text FROM p JOIN t ON t.conv = c
    UNION ALL
    SELECT c, r, 'rejected', place, role, text FROM p JOIN t ON t.conv = r),
x AS (
    SELECT c, r, coalesce(min(CASE WHEN n < 2 OR k > 1 THEN place END) - 1, max(place)) AS n_prompt
    FROM (SELECT c, r, place, count(*) AS n, count(DISTINCT (role, text)) AS k FROM w GROUP BY c, r, place) GROUP BY c, r),
o AS (
    SELECT c, r, n_prompt, CASE WHEN place <= n_prompt THEN 'prompt' ELSE part END AS part, place, (place - 1) // 256 AS chunk,
           '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS out,
           CASE WHEN place > n_prompt AND role = 'assistant' THEN length(text) + 10 ELSE 0 END AS loss
    FROM w JOIN x USING (c, r) WHERE part = 'chosen' OR place > n_prompt),
e AS (
    SELECT *, sum(length(out)) OVER (PARTITION BY c, r, part, chunk ORDER BY place) - 1 AS till FROM o)
SELECT c AS chosen_id, r AS rejected_id, part, chunk::BIGINT AS chunk, any_value(n_prompt)::BIGINT AS n_prompt, count(*)::BIGINT AS n_turns,
       string_agg(out, '' ORDER BY place) AS text,
       coalesce(string_agg(CASE WHEN loss > 0 THEN (till - loss)::BIGINT || '-' || till::BIGINT END, ',' ORDER BY place), '') AS loss_spans
FROM e GROUP BY c, r, part, chunk
"""


@query("op10_preferences", PREFERENCES_SQL)
def op10_preferences(spark, folder):
    conversations = table(spark, folder, "conversations")
    rows = preferences.preference_examples(
        preferences.numbered_turns(conversations), preferences.consecutive_pairs(conversations))
    return rows.withColumn("loss_spans", F.array_join(
        F.transform("loss_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","))


@query("op6_line_dedup")
def op6_line_dedup(spark, folder):
    cleaned = line_dedup.without_repeated_lines(table(spark, folder, "documents"), least_equal=1)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op5_scoring")
def op5_scoring(spark, folder):
    docs = table(spark, folder, "documents")
    counts = cut_lineage(scoring.word_counts(docs))
    words = scoring.vocabulary(docs, counts=counts)
    return scoring.score(docs, words, scoring.train(docs, words), keep_columns=["doc_id"], counts=counts)


SEARCH_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL),
i AS (
    SELECT row_number() OVER () AS i, item_id,
           regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM i) GROUP BY i, term),
s AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
tf AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM it) GROUP BY r, term),
df AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY term, nn),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w)::BIGINT * nn) // ll AS m FROM d, s WHERE len(w) > 0),
sc AS (
    SELECT i, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM tf JOIN df USING (term) JOIN m USING (r) JOIN it USING (term) GROUP BY i, r HAVING score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc JOIN m USING (r))
JOIN i USING (i) WHERE rank <= 20
"""


@query("op11_search", SEARCH_SQL)
def op11_search(spark, folder):
    return shared_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: crc32 bit by bit: DuckDB has no function for it. The key is ASCII.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

REPAIR_SQL = rf"""
WITH RECURSIVE c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
    FROM conversations),
d AS (
    SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN fate = 0 THEN [] WHEN fate = 3 THEN [1, 2] ELSE [1] END)
    FROM c),
n AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
           row_number() OVER w AS k,
           lag(left(role, 1)) OVER w AS earlier
    FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank'
           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM n),
t AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
    FROM f GROUP BY conv_id),
-- Up to two inserts before each row and behind the last, then the row's edit; of one place the cheapest and least audit goes on.
grow AS (SELECT * FROM (VALUES ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')) AS g(pl, put, goal)),
p AS (
    SELECT conv_id, 0::BIGINT AS k, '' AS pl, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM t
    UNION ALL
    SELECT conv_id, k, pl, cost, audit, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, pl ORDER BY cost, audit) AS best FROM (
            SELECT conv_id, k, e.pl AS pl, (cost + e.cost)::BIGINT AS cost, audit || e.edit AS audit, lines || e.line AS lines FROM (
            SELECT i.conv_id, i.k + 1 AS k, i.cost, i.audit, i.lines,
                   unnest(CASE WHEN f.fault IN ('blank', 'duplicate') THEN [{{'pl': i.pl, 'cost': 2, 'edit': 'D', 'line': []::VARCHAR[]}}]
                       ELSE [{{'pl': i.pl, 'cost': 2, 'edit': 'D', 'line': []::VARCHAR[]}},
                             {{'pl': g.goal, 'cost': CASE f.fault WHEN '' THEN 1 ELSE 6 END, 'edit': 'R',
                              'line': [CASE g.goal WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text]}}]
                       || CASE WHEN f.initial = g.goal OR (i.pl = '' AND f.initial = 's')
                          THEN [{{'pl': f.initial, 'cost': CASE f.fault WHEN '' THEN 0 ELSE 5 END, 'edit': 'K', 'line': [f.role || ':' || f.text]}}]
                          ELSE [] END END) AS e
            FROM (
                SELECT conv_id, k, pl, cost, audit, lines FROM p
                UNION ALL
                SELECT conv_id, k, g.goal, cost + 5, audit || 'I', lines || [CASE g.put WHEN 'u' THEN 'user:' ELSE 'assistant:' END]
                FROM p JOIN grow g USING (pl)
                UNION ALL
                SELECT conv_id, k, h.goal, cost + 10, audit || 'II',
                       lines || [CASE g.put WHEN 'u' THEN 'user:' ELSE 'assistant:' END, CASE h.put WHEN 'u' THEN 'user:' ELSE 'assistant:' END]
                FROM p JOIN grow g USING (pl) JOIN grow h ON h.pl = g.goal) i
            JOIN f ON f.conv_id IS NOT DISTINCT FROM i.conv_id AND f.k = i.k + 1 JOIN grow g ON g.pl = i.pl))) WHERE best = 1),
z AS (
    SELECT conv_id, k, CASE WHEN pl IN ('', 'a') THEN cost WHEN pl = 'u' THEN cost + 5 ELSE cost + 10 END AS cost,
           CASE WHEN pl IN ('', 'a') THEN audit WHEN pl = 'u' THEN audit || 'I' ELSE audit || 'II' END AS audit,
           CASE WHEN pl IN ('', 'a') THEN lines WHEN pl = 'u' THEN lines || ['assistant:'] ELSE lines || ['user:', 'assistant:'] END AS lines
    FROM p),
r AS (
    SELECT z.conv_id, arg_min({{'cost': cost, 'audit': audit, 'lines': lines}}, {{'cost': cost, 'audit': audit}}) AS best
    FROM z JOIN t ON t.conv_id IS NOT DISTINCT FROM z.conv_id AND z.k = t.n_rows GROUP BY z.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query("op13_repair", REPAIR_SQL)
def op13_repair(spark, folder):
    turns = table(spark, folder, "conversations")
    edits, summary = turn_repair.repair(turn_repair.damage(turns))
    asked = turns.select("conv_id").distinct().withColumn("key", turn_repair.conversation_key())
    found = asked.join(summary, "key", "left").join(turn_repair.digests(edits), "key", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op12_toxicity")
def op12_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = weak_labels.learn(docs, table(spark, folder, "labels"))
    held = docs.select("doc_id", weak_labels.held_out("doc_id").alias("held_out"), "text")
    return weak_labels.score(held, model, keep_columns=["doc_id", "held_out"])


__all__ = ["QUERIES", "SQL"]
