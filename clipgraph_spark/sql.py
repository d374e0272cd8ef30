"""SQL of the registered queries, for comparison on the same tables."""

from __future__ import annotations

_CHUNKS = r"""
l AS (SELECT doc_id AS job_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
c0 AS (SELECT job_id, line, trim(regexp_replace(raw, '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM l),
c1 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY line) - 1 AS chunk_idx, len(string_split(text, ' ')) AS n FROM c0 WHERE text <> ''),
c2 AS (SELECT *, sum(n) OVER (PARTITION BY job_id ORDER BY chunk_idx) AS u FROM c1),
chunks AS (SELECT job_id, chunk_idx::INTEGER AS chunk_idx, 'c' || chunk_idx AS chunk_id, (u - n)::DOUBLE / 2.5::DOUBLE AS start_s, u::DOUBLE / 2.5::DOUBLE AS end_s, text FROM c2)
"""
_SENTENCES = (
    _CHUNKS
    + r""",
s0 AS (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM chunks),
s1 AS (SELECT * EXCLUDE (s, text), greatest(len(s), 1) AS n_sent, unnest(CASE WHEN len(s) = 0 THEN [''] ELSE s END) AS sentence, unnest(range(greatest(len(s), 1))) AS sent_idx FROM s0)
"""
)
_HOOK = "regexp_matches(lower(sentence), '^(the|of|and|in|to|le|la|de|die|der|el|en)\\s')"
_ENDING = "(regexp_matches(lower(sentence), '(the|of|and|in|la|de|die|der)\\.$') OR regexp_matches(lower(sentence), '(er|on)\\.$'))"
_SEGMENTS = (
    _SENTENCES
    + f""",
s2 AS (SELECT *, greatest(end_s - start_s, 0.1::DOUBLE) / n_sent AS step FROM s1),
segments AS (
  SELECT job_id, 'seg_' || chunk_id || '_' || sent_idx AS segment_id, round(start_s + sent_idx * step, 3) AS start_s,
         round(least(end_s, start_s + sent_idx * step + step), 3) AS end_s, sentence AS text,
         CASE WHEN sent_idx = 0 AND {_HOOK} THEN 'hook' WHEN sent_idx = n_sent - 1 AND {_ENDING} THEN 'ending' ELSE 'body' END AS kind,
         (row_number() OVER (PARTITION BY job_id ORDER BY chunk_idx, sent_idx) - 1)::INTEGER AS ord
  FROM s2)
"""
)
_FEATURES = (
    _SEGMENTS
    + r""",
f0 AS (SELECT *, end_s - start_s AS d, CASE WHEN trim(text) = '' THEN [] ELSE string_split(trim(text), ' ') END AS w FROM segments),
f1 AS (
  SELECT job_id, segment_id, ord, kind, round(least(greatest(length(trim(text)) / 200::DOUBLE, 0.05::DOUBLE), 1::DOUBLE), 4) AS audio_intensity,
         round(least(greatest(len(w) / greatest(d, 0.1::DOUBLE) / 3::DOUBLE, 0.05::DOUBLE), 1::DOUBLE), 4) AS text_density,
         CASE kind WHEN 'hook' THEN CASE WHEN d <= 5 THEN 0.9 WHEN d <= 10 THEN 0.7 ELSE 0.5 END
                   WHEN 'ending' THEN CASE WHEN d <= 8 THEN 0.85 WHEN d <= 15 THEN 0.7 ELSE 0.5 END
                   ELSE CASE WHEN d BETWEEN 10 AND 45 THEN 0.7 WHEN d BETWEEN 5 AND 60 THEN 0.5 ELSE 0.3 END END::DOUBLE AS structure_score,
         round(least(greatest(0.4::DOUBLE + len(list_distinct(w))::DOUBLE / greatest(len(w), 1) * 0.5::DOUBLE
               + (CASE WHEN contains(text, '?') THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN regexp_matches(text, '\p{Nd}') THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN len(w) <= 10 THEN 0.05::DOUBLE ELSE 0::DOUBLE END), 0.1::DOUBLE), 1::DOUBLE), 4) AS pattern_score,
         len(w)::INTEGER AS word_count, round(greatest(d, 0.1::DOUBLE), 4) AS duration_seconds
  FROM f0),
features AS (SELECT *, floor((audio_intensity + text_density + structure_score + pattern_score) / 4 * 10000 + 0.500001::DOUBLE) / 10000 AS total_score FROM f1)
"""
)
_PRUNED = (
    _FEATURES
    + """,
p0 AS (SELECT s.*, total_score AS score, row_number() OVER (PARTITION BY s.job_id, s.kind ORDER BY total_score DESC, s.ord)::INTEGER AS rank
       FROM segments s JOIN features f USING (job_id, segment_id) WHERE total_score >= 0.2),
pruned AS (SELECT * FROM p0 WHERE rank <= CASE kind WHEN 'hook' THEN 15 WHEN 'body' THEN 40 ELSE 10 END)
"""
)
_TRIPLES = (
    _PRUNED
    + """,
triples AS (
  SELECT h.job_id, h.segment_id AS h_id, b.segment_id AS b_id, e.segment_id AS e_id, h.start_s AS h_start, h.end_s AS h_end, b.start_s AS b_start, b.end_s AS b_end, e.start_s AS e_start, e.end_s AS e_end,
         h.text AS h_text, b.text AS b_text, e.text AS e_text, h.score AS h_score, b.score AS b_score, e.score AS e_score, h.rank AS h_rank, b.rank AS b_rank, e.rank AS e_rank
  FROM pruned h JOIN pruned b ON h.job_id = b.job_id AND h.kind = 'hook' AND b.kind = 'body' AND h.start_s <= b.start_s AND h.end_s <= b.start_s AND b.start_s - h.end_s <= 30
       JOIN pruned e ON e.job_id = b.job_id AND e.kind = 'ending' AND b.start_s <= e.start_s AND b.end_s <= e.start_s AND e.start_s - b.end_s <= 30)
"""
)
_CLIPS = (
    _TRIPLES
    + """,
k0 AS (SELECT *, greatest(e_end - h_start, 1::DOUBLE) AS dur, round(greatest(0.1::DOUBLE, 0.95::DOUBLE - least(0.6::DOUBLE, (greatest(b_start - h_end, 0::DOUBLE) + greatest(e_start - b_end, 0::DOUBLE)) / 300)), 4) AS flow_score FROM triples),
k1 AS (SELECT *, (h_score * 0.35::DOUBLE + b_score * 0.25::DOUBLE + e_score * 0.2::DOUBLE + flow_score * 0.2::DOUBLE)
        * CASE WHEN dur < 15 THEN 0.5 WHEN dur < 30 THEN 0.8 WHEN dur <= 60 THEN 1.0 WHEN dur <= 90 THEN 0.9 ELSE 0.7 END::DOUBLE AS total FROM k0),
k2 AS (SELECT *, floor(total * 10000 + 0.500001::DOUBLE) / 10000 AS total_score FROM k1 WHERE round(total, 9) >= 0.35),
k3 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY total_score DESC, h_rank, b_rank, e_rank)::INTEGER AS rank FROM k2),
clips AS (SELECT *, concat_ws('_', 'clip', h_id, b_id, e_id) AS id, round(dur, 3) AS duration FROM k3 WHERE rank <= 20)
"""
)
_SETS = """
li AS (SELECT l_orderkey, list_sort(list_distinct(list((l_partkey % {m})::VARCHAR))) AS event_ids FROM lineitem GROUP BY 1),
sets AS (SELECT o_custkey AS job_id, lpad(o_orderkey::VARCHAR, 12, '0') AS id, o_orderkey AS ord, event_ids, round(o_totalprice / 500000, 4) AS score FROM orders JOIN li ON o_orderkey = l_orderkey)
"""
_EVENTS = """
ev AS (SELECT event_id AS seq, ts, user_id AS key, user_id AS job_id, event_type AS stage, event_type AS name, value * 10 AS elapsed_ms, floor(value)::BIGINT AS tokens,
              event_type <> 'error' AS ok, value > 40 AS rate_limited FROM events)
"""
_VECTORS = """
v AS (SELECT label AS job_id, vec_id AS ord, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
pairs AS (SELECT job_id, ord, i, e, lag(e) OVER (PARTITION BY job_id ORDER BY ord) AS p FROM v),
sims AS (SELECT job_id, i - 1 AS idx, i AS start_ord, ord, list_cosine_similarity(e, p) AS sim, sqrt(list_inner_product(e, e)) AS norm FROM pairs WHERE p IS NOT NULL),
smoothed AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY job_id) < 3 THEN sim ELSE avg(sim) OVER (PARTITION BY job_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS smoothed FROM sims)
"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


B_TEXT = _with(
    _CHUNKS,
    r"""
SELECT job_id, chunk_idx, len(list_filter(string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INTEGER AS n_sentences,
       array_to_string(string_split(text, ' ')[1:5], ' ') AS snippet,
       round(least(greatest((length(regexp_replace(text, '[^\p{L}]', '', 'g')) + 0.2::DOUBLE * length(regexp_replace(text, '[^ ]', '', 'g'))) / greatest(length(text), 1), 0.1::DOUBLE), 1::DOUBLE), 6) AS speech_density,
       len(string_split(text, ' '))::INTEGER AS words, round(len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' ')), 6) AS unique_ratio,
       regexp_matches(text, '\p{Nd}') AS has_digit, contains(lower(text), 'ion') OR contains(lower(text), 'schw') AS has_sub,
       list_has_any(string_split(lower(text), ' '), ['the', 'der']) AS has_token, starts_with(lower(text), 'the') OR starts_with(lower(text), 'la') AS starts,
       len(list_filter(string_split(text, ' '), lambda t: length(t) > 2 AND regexp_matches(t, '^\p{Lu}')))::INTEGER AS titles,
       greatest(1, length(text) // 3)::BIGINT AS tokens3, greatest(1, length(text) // 4)::BIGINT AS tokens4, round(least(greatest(start_s / 60, 0::DOUBLE), 1::DOUBLE), 6) AS energy,
       len(list_distinct(list_filter(string_split(lower(text), ' '), lambda t: t NOT IN ('the', 'of', 'and'))))::INTEGER AS content,
       chunk_id || ':' || substr(md5(replace(text, ' ', '|')), 1, 12) AS signature
FROM chunks""",
)
B_JACCARD = _with(
    _SETS.format(m=50),
    """SELECT id, round(len(list_intersect(event_ids, p))::DOUBLE / len(list_distinct(event_ids || p)), 6) AS jaccard
FROM (SELECT *, lag(event_ids) OVER (PARTITION BY job_id ORDER BY ord) AS p FROM sets) WHERE p IS NOT NULL""",
)
B_COSINE = _with(_VECTORS, "SELECT ord, round(sim, 6) AS cosine, round(norm, 6) AS norm FROM sims")
B_HASH = _with(
    _CHUNKS,
    """, t AS (SELECT job_id, md5(unnest(string_split(lower(text), ' '))) AS m FROM chunks)
SELECT job_id, (((('0x' || substr(m, 1, 16))::UBIGINT % 384) * 256 + ('0x' || substr(m, 17, 16))::UBIGINT % 384) % 384)::INTEGER AS bucket, count(*) AS n FROM t GROUP BY ALL""",
)
_MEDIA = _CHUNKS + ", media AS (SELECT job_id, max(end_s) AS duration FROM chunks GROUP BY 1), plan AS (SELECT *, CASE WHEN duration < 600 THEN 30 WHEN duration < 3600 THEN 45 ELSE 90 END AS chunk_s, 3 AS overlap_s, CASE WHEN duration < 600 THEN 3 ELSE 5 END AS workers FROM media)"
C_PLAN = _with(_MEDIA, "SELECT job_id, duration, chunk_s, overlap_s, workers FROM plan")
C_RANGES = _with(
    _MEDIA,
    """, r AS (SELECT *, unnest(range(greatest(1, ceil((duration - chunk_s) / (chunk_s - overlap_s)) + 1)::BIGINT)) AS idx FROM plan)
SELECT job_id, idx::INTEGER AS idx, (idx * (chunk_s - overlap_s))::DOUBLE AS start_s, least(idx * (chunk_s - overlap_s) + chunk_s, duration)::DOUBLE AS end_s FROM r""",
)
C_MERGE = _with(
    _SENTENCES,
    """, k AS (SELECT *, row_number() OVER (PARTITION BY job_id, lower(trim(sentence)) ORDER BY chunk_idx, sent_idx) AS n FROM s1 WHERE sentence <> '')
SELECT job_id, string_agg(sentence, ' ' ORDER BY chunk_idx, sent_idx) AS merged_text FROM k WHERE n = 1 GROUP BY 1""",
)
C_SEGMENTS = _with(_SEGMENTS, "SELECT * FROM segments")
C_ENGLISH = _with(
    _SENTENCES,
    r""", k AS (SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY chunk_idx, sent_idx) - 1)::INTEGER AS ord, lower(sentence) AS t, sent_idx = 0 AS f, sent_idx = n_sent - 1 AS z FROM s1),
q AS (SELECT job_id, ord, CASE WHEN f AND (regexp_matches(t, '^((what|how|why|when|where|who)\s|did you know|have you ever|imagine|here''s the thing|let me tell you|the secret is|nobody talks about|question:|challenge:|problem:|you need to know|listen to this)') OR regexp_matches(t, 'what|how|why|imagine')) THEN 'hook'
  WHEN z AND regexp_matches(t, 'so|therefore|in summary|that''s why|the takeaway is|subscribe|follow|like this|comment below|share this|next time|see you|thanks for watching|until next time|that is why') THEN 'ending' ELSE 'body' END AS kind FROM k)
SELECT job_id, ord, kind FROM q""",
)
C_SHORT = _with(
    _SEGMENTS,
    """, g0 AS (SELECT *, (end_s - start_s >= 1.2::DOUBLE)::INTEGER AS big FROM segments),
g AS (SELECT *, greatest(sum(big) OVER (PARTITION BY job_id ORDER BY ord), 1) AS grp FROM g0)
SELECT job_id, arg_min(segment_id, (1 - big) * 1000000000::BIGINT + ord) AS segment_id, min(start_s) AS start_s, arg_max(end_s, ord) AS end_s, string_agg(text, ' ' ORDER BY ord) AS text,
       arg_min(kind, (1 - big) * 1000000000::BIGINT + ord) AS kind, min((1 - big) * 1000000000::BIGINT + ord)::BIGINT % 1000000000 AS ord FROM g GROUP BY job_id, grp""",
)
C_ROLE = _with(
    _SEGMENTS,
    """SELECT job_id, ord, CASE WHEN ord = 0 OR contains(text, '?') OR regexp_matches(lower(text), 'secret|truth|why') THEN 'hook'
 WHEN ord = max(ord) OVER (PARTITION BY job_id) OR regexp_matches(lower(text), 'so|therefore|subscribe') THEN 'ending' WHEN regexp_matches(lower(text), 'haha|lol|omg') THEN 'reaction' ELSE 'body' END AS role FROM segments""",
)
C_PAYLOAD = """
WITH t AS (SELECT doc_id AS job_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END::BIGINT AS input_tokens, (length(text) % 3000)::BIGINT AS output_tokens FROM documents)
SELECT *, CASE WHEN input_tokens > 1000 THEN 'PAYLOAD_TOO_LARGE' WHEN output_tokens > 2500 THEN 'OUTPUT_TOO_LARGE' WHEN input_tokens + output_tokens > 3500 THEN 'PAYLOAD_EXCEEDS_LIMIT' END AS error_code,
       CASE WHEN input_tokens > 1000 THEN greatest(2, ceil(input_tokens / 900::DOUBLE))::BIGINT END AS split_hint FROM t"""
_BATCHES = (
    _SEGMENTS
    + """,
bk AS (SELECT job_id, ord // 25 AS block_idx, list(segment_id ORDER BY ord) AS ids FROM segments GROUP BY ALL),
bn AS (SELECT *, coalesce(lag(ids) OVER w, []) AS prev, coalesce(lead(ids) OVER w, []) AS next FROM bk WINDOW w AS (PARTITION BY job_id ORDER BY block_idx)),
ba AS (SELECT *, unnest(range(0, len(ids), 8)) AS start FROM bn)
"""
)
C_BATCHES = _with(
    _BATCHES,
    """SELECT job_id, block_idx::INTEGER AS block_idx, (start // 8)::INTEGER AS batch_idx, array_to_string(ids[start + 1 : start + 10], ',') AS segment_ids,
 array_to_string(prev[-2:] || CASE WHEN start = 0 THEN [] ELSE ids[start - 1 : start] END, ',') AS context_before, array_to_string(ids[start + 11 : start + 12] || next[1:2], ',') AS context_after,
 CASE WHEN block_idx < 3 THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM ba""",
)
C_PROMPT = _with(
    _BATCHES,
    """, ln AS (SELECT job_id, segment_id, '[' || segment_id || ' | ' || round(start_s::DECIMAL(18, 3), 1) || '-' || round(end_s::DECIMAL(18, 3), 1) || 's] ' || text AS line FROM segments),
pt AS (SELECT job_id, block_idx, start, 0 AS part, prev[-2:] || CASE WHEN start = 0 THEN [] ELSE ids[start - 1 : start] END AS s FROM ba
       UNION ALL SELECT job_id, block_idx, start, 1, ids[start + 11 : start + 12] || next[1:2] FROM ba UNION ALL SELECT job_id, block_idx, start, 2, ids[start + 1 : start + 10] FROM ba),
px AS (SELECT job_id, block_idx, start, part, unnest(s) AS segment_id, unnest(range(len(s))) AS pos FROM pt),
pg AS (SELECT job_id, block_idx, start, string_agg(line, chr(10) ORDER BY pos) FILTER (part = 0) AS a, string_agg(line, chr(10) ORDER BY pos) FILTER (part = 1) AS b, string_agg(line, chr(10) ORDER BY pos) FILTER (part = 2) AS c
       FROM px JOIN ln USING (job_id, segment_id) GROUP BY ALL),
sm AS (SELECT job_id, substr(text, 1, 40) AS summary FROM segments WHERE ord = 0 AND job_id % 2 = 0)
SELECT job_id, block_idx::INTEGER AS block_idx, (start // 8)::INTEGER AS batch_idx,
  'Annotate.' || chr(10) || concat_ws(chr(10) || chr(10), 'Full transcript summary:' || chr(10) || nullif(summary, ''), 'Previous context:' || chr(10) || a, 'Following context:' || chr(10) || b, 'Segments:' || chr(10) || c) AS prompt
FROM pg LEFT JOIN sm USING (job_id)""",
)
C_PARSE = _with(
    _SEGMENTS,
    """SELECT job_id, segment_id, '' AS story_id, 't' || ord % 5 AS topic, '' AS subtopic, CASE WHEN ord % 3 = 0 THEN 'body' ELSE kind END AS story_role, 'explain' AS intent, '' AS speaker_intent, 'neutral' AS emotion,
 'low' AS context_dependency, '' AS previous_segment_dependency, '' AS next_segment_expectation, CASE WHEN ord % 3 = 0 THEN 0.5 ELSE round(least(1::DOUBLE, ord / 7::DOUBLE), 6) END::DOUBLE AS emotion_intensity,
 CASE WHEN ord % 3 = 0 THEN 0.5 ELSE least(1::DOUBLE, ord / 10::DOUBLE) END::DOUBLE AS importance_score, CASE WHEN ord % 3 = 0 THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, (ord - 3) / 5::DOUBLE)) END::DOUBLE AS hook_strength,
 CASE WHEN ord % 3 = 0 THEN 0 ELSE round(least(1::DOUBLE, end_s / 100), 6) END::DOUBLE AS ending_strength, 0::DOUBLE AS curiosity_score, 0::DOUBLE AS information_density,
 CASE WHEN ord % 3 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS standalone_score, 0.5::DOUBLE AS completeness_score, 0.5::DOUBLE AS confidence_score, ord % 3 <> 0 AND ord % 2 = 0 AS topic_transition,
 CASE WHEN ord % 3 = 0 THEN '' ELSE array_to_string(string_split(text, ' ')[1:2], ',') END AS key_entities, '' AS keywords
FROM segments WHERE ord % 11 <> 10""",
)
C_RELATIONS = _with(
    _SEGMENTS,
    """SELECT * FROM (SELECT job_id, segment_id AS source_id, lead(segment_id) OVER (PARTITION BY job_id ORDER BY ord) AS target_id, CASE WHEN ord > 0 THEN 'follows' END AS relation_type,
 CASE WHEN ord % 2 = 0 THEN ord / 8::DOUBLE ELSE 0.5 END::DOUBLE AS confidence, '' AS reason FROM segments) WHERE target_id IS NOT NULL AND relation_type IS NOT NULL""",
)
C_BAD = _with(
    _SEGMENTS,
    """SELECT DISTINCT job_id, -1 AS place, 'invalid_json' AS reason FROM segments WHERE job_id % 10 = 0
UNION ALL SELECT job_id, ord, 'no_segment_id' FROM segments WHERE job_id % 10 <> 0 AND ord % 11 = 10
UNION ALL SELECT job_id, ord, 'no_relation' FROM segments WHERE job_id % 10 <> 0 AND (ord = 0 OR ord = (SELECT max(ord) FROM segments z WHERE z.job_id = segments.job_id))""",
)
C_WINDOWS = "WITH RECURSIVE " + _SEGMENTS.lstrip() + """,
d AS MATERIALIZED (SELECT *, end_s - start_s AS d, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1 AS i FROM segments),
w AS (SELECT job_id, i, d AS s, 0 AS bin FROM d WHERE i = 0
      UNION ALL SELECT d.job_id, d.i, CASE WHEN w.s + d.d > 120 THEN d.d ELSE w.s + d.d END, w.bin + (w.s + d.d > 120)::INTEGER FROM w JOIN d ON d.job_id = w.job_id AND d.i = w.i + 1)
SELECT job_id, bin AS window_idx, arg_min(start_s, ord) AS start_s, arg_max(end_s, ord) AS end_s, round(sum(d ORDER BY ord), 3) AS duration, count(*) AS n_segments, string_agg(segment_id, ',' ORDER BY ord) AS segment_ids,
 string_agg(text, ' ' ORDER BY ord) AS text, len(string_split(trim(string_agg(text, ' ' ORDER BY ord)), ' '))::INTEGER AS word_count, 0.5::DOUBLE AS audio_energy, 2.5::DOUBLE AS pace, 3 AS signal_count
FROM w JOIN d USING (job_id, i) GROUP BY job_id, bin"""
C_PIECES = """WITH RECURSIVE
p0 AS (SELECT doc_id AS job_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS part, unnest(range(len(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))))) AS ord FROM documents),
d AS MATERIALIZED (SELECT *, greatest(1, length(part) // 3) AS t, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1 AS i FROM p0 WHERE trim(part, ' ') <> ''),
w AS (SELECT job_id, i, t AS s, 0 AS bin FROM d WHERE i = 0
      UNION ALL SELECT d.job_id, d.i, CASE WHEN w.s + d.t > 400 THEN d.t ELSE w.s + d.t END, w.bin + (w.s + d.t > 400)::INTEGER FROM w JOIN d ON d.job_id = w.job_id AND d.i = w.i + 1),
g AS (SELECT job_id, bin AS piece_idx, string_agg(part, chr(10) || chr(10) ORDER BY ord) AS text FROM w JOIN d USING (job_id, i) GROUP BY job_id, bin),
t AS (SELECT *, greatest(1, length(text) // 3) AS tokens FROM g),
a AS (SELECT *, greatest(50, floor(2000 * tokens / sum(tokens) OVER (PARTITION BY job_id)))::BIGINT AS allocated, count(*) OVER (PARTITION BY job_id) AS n_pieces FROM t)
SELECT *, coalesce(sum(allocated) OVER (PARTITION BY job_id ORDER BY piece_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS out_start,
 (sum(allocated) OVER (PARTITION BY job_id ORDER BY piece_idx))::BIGINT AS out_end FROM a"""
C_CONFIDENCE = _with(_EVENTS, "SELECT job_id, stage AS chunk_id, round(least(greatest(1 + avg(-elapsed_ms / 500), 0::DOUBLE), 1::DOUBLE), 6) AS confidence FROM ev GROUP BY ALL")
C_RTF = _with(
    _EVENTS,
    "SELECT job_id, round(avg(elapsed_ms / 1000 / (tokens + 1)), 6) AS avg_rtf, round(max(elapsed_ms / 1000 / (tokens + 1)), 6) AS peak_rtf, round(avg(elapsed_ms), 6) AS avg_ms, sum(tokens)::BIGINT AS inference_ms, sum(tokens + 1)::DOUBLE AS audio_s, count(*) AS n_chunks FROM ev GROUP BY 1",
)
D_FEATURES = _with(_FEATURES, "SELECT job_id, segment_id, ord, audio_intensity, text_density, structure_score, pattern_score, 'text_heuristic' AS audio_energy_source, word_count, duration_seconds, total_score, 0 AS non_fallback_count FROM features")
D_PRIORITY = _with(
    _SEGMENTS,
    """, b AS (SELECT job_id, ord // 25 AS block_idx, min(start_s) AS s, max(end_s) AS e, avg(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END) AS w, bool_or(contains(text, '?')) AS q, bool_or(regexp_matches(text, '\\p{Nd}')) AS d FROM segments GROUP BY ALL),
c AS (SELECT *, round(CASE WHEN e - s BETWEEN 10 AND 45 THEN 0.3 WHEN e - s BETWEEN 5 AND 60 THEN 0.2 ELSE 0.1 END::DOUBLE + CASE WHEN w BETWEEN 10 AND 40 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN q THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN d THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN s > 30 AND e < 180 THEN 0.1 ELSE 0 END::DOUBLE, 4) AS score FROM b)
SELECT job_id, block_idx::INTEGER AS block_idx, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS priority,
       row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN score >= 0.6 THEN 0 WHEN score >= 0.4 THEN 1 ELSE 2 END, block_idx)::INTEGER AS rank FROM c""",
)
_TOKENS = _SEGMENTS + ", tk AS (SELECT job_id, ord, unnest(string_split(text, ' ')) AS t, unnest(range(len(string_split(text, ' ')))) AS pos FROM segments WHERE text <> '')"
D_TERMS = _with(
    _TOKENS,
    """, n AS (SELECT job_id, lower(t) AS term, count(*) AS n, min(ord * 1000000::BIGINT + pos) AS first FROM tk WHERE length(t) > 3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, first)::INTEGER AS rank FROM n) SELECT job_id, rank, term, n FROM r WHERE rank <= 5""",
)
D_ENTITIES = _with(
    _TOKENS,
    r""", n AS (SELECT DISTINCT job_id, t AS entity FROM tk WHERE length(t) > 2 AND regexp_matches(t, '^\p{Lu}')),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY entity)::INTEGER AS rank FROM n) SELECT job_id, rank, entity FROM r WHERE rank <= 3""",
)
D_SYNOPSIS = _with(
    _TOKENS,
    r""", tb AS (SELECT *, ord // 25 AS b FROM tk),
n AS (SELECT job_id, b, lower(t) AS term, count(*) AS n, min(ord * 1000000::BIGINT + pos) AS first FROM tb WHERE length(t) > 3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, b ORDER BY n DESC, first) AS rank FROM n),
te AS (SELECT job_id, b, string_agg(term, ', ' ORDER BY rank) AS terms FROM r WHERE rank <= 5 GROUP BY 1, 2),
ne AS (SELECT *, row_number() OVER (PARTITION BY job_id, b ORDER BY entity) AS rank FROM (SELECT DISTINCT job_id, b, t AS entity FROM tb WHERE length(t) > 2 AND regexp_matches(t, '^\p{Lu}'))),
en AS (SELECT job_id, b, string_agg(entity, ', ' ORDER BY rank) AS entities FROM ne WHERE rank <= 3 GROUP BY 1, 2),
g AS (SELECT job_id, ord // 25 AS b, max(end_s) - min(start_s) AS seconds, count(*) AS n, substr(arg_min(text, ord), 1, 100) AS f, substr(arg_max(text, ord), 1, 100) AS l FROM segments GROUP BY ALL)
SELECT job_id, b::INTEGER AS block_idx, 'Duration: ' || round(seconds::VARCHAR::DECIMAL(38, 17), 1) || 's, Segments: ' || n || '. Starts: ' || f || ' Ends: ' || l || ' Terms: ' || coalesce(terms, '') || ' Entities: ' || coalesce(entities, '') AS synopsis
FROM g LEFT JOIN te USING (job_id, b) LEFT JOIN en USING (job_id, b)""",
)
D_EXCERPT = _with(
    _VECTORS,
    """, x AS (SELECT job_id, unnest(e) AS u, unnest(range(len(e))) AS dim FROM v), a AS (SELECT job_id, dim, avg(u) AS u FROM x GROUP BY ALL),
c AS (SELECT job_id, list(u ORDER BY dim) AS c FROM a GROUP BY 1), k AS (SELECT job_id, ord, round(list_cosine_similarity(e, c), 9) AS cos FROM v JOIN c USING (job_id)),
b AS (SELECT *, max(cos) OVER (PARTITION BY job_id) AS best FROM k)
SELECT job_id, min(ord)::VARCHAR AS segment_id, 'vector ' || min(ord) AS excerpt FROM b WHERE cos >= best - 0.02::DOUBLE GROUP BY 1""",
)
E_ADJACENT = _with(_VECTORS, "SELECT job_id, idx::INTEGER AS idx, round(sim, 6) AS sim, round(smoothed, 6) AS smoothed FROM smoothed")
E_BOUNDARIES = _with(
    _VECTORS,
    """, m AS (SELECT *, avg(smoothed) OVER (PARTITION BY job_id) AS m, stddev_pop(smoothed) OVER (PARTITION BY job_id) AS sd FROM smoothed)
SELECT job_id, start_ord::INTEGER AS at, round(least(1::DOUBLE, (m - smoothed) / sd / 3), 5) AS structural_confidence, round((m - smoothed) / sd, 5) AS z_score FROM m WHERE smoothed < m - 1.5::DOUBLE * sd
UNION ALL SELECT DISTINCT job_id, 0, 1.0::DOUBLE, 0.0::DOUBLE FROM smoothed""",
)
E_CENTROID = _with(
    _VECTORS,
    """, x AS (SELECT job_id, unnest(e) AS v, unnest(range(len(e))) AS dim FROM v), a AS (SELECT job_id, dim, avg(v) AS v FROM x GROUP BY ALL)
SELECT job_id, dim::INTEGER AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY job_id)), 6) AS v FROM a""",
)
F_NODES = _with(_FEATURES, "SELECT s.job_id, segment_id AS node_id, start_s, end_s, total_score AS score FROM segments s JOIN features f USING (job_id, segment_id)")
F_EDGES = _with(_SEGMENTS, "SELECT * FROM (SELECT job_id, segment_id AS source_id, lead(segment_id) OVER (PARTITION BY job_id ORDER BY ord) AS target_id, 'next' AS type FROM segments) WHERE target_id IS NOT NULL")
G_PRUNE = _with(_PRUNED, "SELECT job_id, segment_id, kind, score, rank FROM pruned")
G_STATS = _with(
    _PRUNED,
    """, b AS (SELECT job_id, count(*) FILTER (kind = 'hook') AS hook_before, count(*) FILTER (kind = 'body') AS body_before, count(*) FILTER (kind = 'ending') AS ending_before FROM segments GROUP BY 1),
a AS (SELECT job_id, count(*) FILTER (kind = 'hook') AS hook_after, count(*) FILTER (kind = 'body') AS body_after, count(*) FILTER (kind = 'ending') AS ending_after FROM pruned GROUP BY 1),
j AS (SELECT b.*, coalesce(hook_after, 0) AS hook_after, coalesce(body_after, 0) AS body_after, coalesce(ending_after, 0) AS ending_after FROM b LEFT JOIN a USING (job_id)),
k AS (SELECT *, hook_before * body_before * ending_before AS combinations_before, hook_after * body_after * ending_after AS combinations_after FROM j)
SELECT *, round(CASE WHEN combinations_before > 0 THEN 100 * (1 - combinations_after / combinations_before::DOUBLE) ELSE 0 END, 1) AS reduction_pct FROM k""",
)
F_EVIDENCE = C_WINDOWS.rpartition("\nSELECT job_id, bin AS window_idx")[0] + " SELECT job_id, 'node_' || i AS node_id, segment_id, bin AS window_idx FROM w JOIN d USING (job_id, i)"
F_TEMPORAL = F_EDGES.replace("'next' AS type", "'temporal' AS type")
G_TRIPLES = _with(_TRIPLES, "SELECT job_id, h_id AS h_segment_id, b_id AS b_segment_id, e_id AS e_segment_id, h_start AS h_start_s, e_end AS e_end_s FROM triples")
G_CANDIDATES = _with(_CLIPS, "SELECT job_id, id, duration, flow_score, total_score, array_to_string(string_split(concat_ws(' ', h_text, b_text, e_text), ' ')[1:24], ' ') AS snippet, rank FROM clips")
G_STRATEGIES = _with(
    _SEGMENTS,
    """, s AS (SELECT *, lead(end_s, 2) OVER w AS e2, lead(segment_id, 1) OVER w AS i1, lead(segment_id, 2) OVER w AS i2, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, count(*) OVER (PARTITION BY job_id) AS n
 FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY ord))
SELECT job_id, 'story_' || ord AS candidate_id, ord AS pos, segment_id || ',' || i1 || ',' || i2 AS segment_ids, start_s, e2 AS end_s, text || ' ' || t1 || ' ' || t2 AS text, 'story' AS strategy, 0 AS strategy_rank FROM s WHERE ord % 2 = 0 AND ord < n - 2
UNION ALL SELECT job_id, 'hook_' || ord, ord, segment_id, start_s, end_s, text, 'hook', 1 FROM s WHERE contains(text, '?') OR regexp_matches(lower(text), 'secret|truth|why|how')""",
)
H_OBJECTIVES = _with(
    _CLIPS,
    """, o AS (SELECT job_id, id,
 least(1::DOUBLE, 0.5::DOUBLE + CASE WHEN contains(h_text, '?') THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN list_contains(string_split(lower(h_text), ' '), 'you') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(lower(h_text), 'secret|truth|why|how|never|always') THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN len(string_split(h_text, ' ')) <= 10 THEN 0.1 ELSE 0 END::DOUBLE) AS hook_delivery,
 CASE WHEN len(string_split(b_text, ' ')) >= 10 THEN 0.8 ELSE 0.5 END::DOUBLE AS standalone,
 CASE WHEN regexp_matches(lower(e_text), 'so|therefore|that''s|subscribe|follow') THEN 0.85 ELSE 0.5 END::DOUBLE AS ending,
 CASE WHEN e_end - h_start BETWEEN 15 AND 45 THEN 1.0 WHEN e_end - h_start < 15 THEN 0.5 ELSE 0.7 END::DOUBLE AS dead_time,
 1::DOUBLE / 3 AS narrative_coherence,
 CASE WHEN len(string_split(b_text, ' ')) / greatest(e_end - h_start, 0.1::DOUBLE) BETWEEN 2.5 AND 3.5 THEN 0.9 ELSE 0.5 END::DOUBLE AS information_density,
 CASE WHEN e_end - h_start BETWEEN 20 AND 60 THEN 0.9 ELSE 0.5 END::DOUBLE AS temporal_flow, 0.6::DOUBLE AS emotional_arc, 0.5::DOUBLE AS creator_fit, 0.5::DOUBLE AS visual_quality FROM clips)
SELECT * REPLACE (round(narrative_coherence, 6) AS narrative_coherence, round(hook_delivery, 6) AS hook_delivery),
 round((hook_delivery + standalone + ending + dead_time + narrative_coherence + information_density + temporal_flow + emotional_arc + creator_fit + visual_quality) / 10, 4) AS overall_score FROM o""",
)
_GREEDY = "WITH RECURSIVE " + _SETS.format(m=500).lstrip() + """,
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord, id) AS i FROM sets),
g AS (SELECT DISTINCT job_id, 0::BIGINT AS i, []::STRUCT(id VARCHAR, v VARCHAR[])[] AS kept, NULL::VARCHAR AS id, NULL::VARCHAR AS similar_to, NULL::DOUBLE AS similarity FROM o
  UNION ALL
  SELECT job_id, i, CASE WHEN f IS NULL THEN list_append(kept, {'id': id, 'v': event_ids}) ELSE kept END, id, f.id, len(list_intersect(f.v, event_ids))::DOUBLE / len(list_distinct(f.v || event_ids))
  FROM (SELECT g.job_id, o.i, g.kept, o.id, o.event_ids, list_filter(g.kept, lambda k: round(len(list_intersect(k.v, o.event_ids))::DOUBLE / len(list_distinct(k.v || o.event_ids)), 9) >= 0.1)[1] AS f
        FROM g JOIN o ON o.job_id = g.job_id AND o.i = g.i + 1))
"""
I_GREEDY = _GREEDY + "SELECT job_id, id, similar_to, round(similarity, 6) AS similarity FROM g WHERE similar_to IS NOT NULL"
I_KEPT = _GREEDY + "SELECT job_id, id FROM g WHERE i > 0 AND similar_to IS NULL"
_MMR = "WITH RECURSIVE " + _SETS.format(m=500).lstrip() + """,
o AS MATERIALIZED (SELECT job_id, id, score, event_ids AS v, row_number() OVER (PARTITION BY job_id ORDER BY ord::DOUBLE, id) AS pos, count(*) OVER (PARTITION BY job_id) AS n FROM sets),
p AS (SELECT DISTINCT job_id, 0 AS step, []::STRUCT(id VARCHAR, v VARCHAR[])[] AS taken FROM o WHERE n > 5
  UNION ALL
  SELECT p.job_id, p.step + 1, list_append(p.taken, (SELECT arg_min({'id': o.id, 'v': o.v}, {'a': -round(0.5::DOUBLE * o.score - 0.5::DOUBLE * coalesce(list_max(list_transform(p.taken, lambda t: round(len(list_intersect(t.v, o.v))::DOUBLE / len(list_distinct(t.v || o.v)), 9))), 0), 9), 'b': o.pos})
    FROM o WHERE o.job_id = p.job_id AND NOT list_contains(list_transform(p.taken, lambda t: t.id), o.id)))
  FROM p WHERE p.step < 5),
c AS (SELECT job_id, unnest(list_transform(taken, lambda t: t.id)) AS id FROM p WHERE step = 5 UNION ALL SELECT job_id, id FROM o WHERE n <= 5),
x AS (SELECT o.*, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, pos)::INTEGER AS final_rank FROM o JOIN c USING (job_id, id))
"""
N_PORTFOLIO = _MMR + "SELECT job_id, id, final_rank, pos::INTEGER AS narrative_pos FROM x"
N_SUMMARY = _MMR + """, q AS (SELECT a.job_id, avg(len(list_intersect(a.v, b.v))::DOUBLE / len(list_distinct(a.v || b.v))) AS sim FROM x a JOIN x b ON a.job_id = b.job_id AND a.id < b.id GROUP BY 1),
s AS (SELECT job_id, avg(score) AS m, count(*) AS k, any_value(n) AS n FROM x GROUP BY 1)
SELECT job_id, round(m, 4) AS mean_score, k AS selected, n - k AS rejected, round(1 - coalesce(sim, 0), 4) AS diversity FROM s LEFT JOIN q USING (job_id)"""
I_CONTENT = "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS id, count(*) AS \"references\" FROM documents GROUP BY 1"
_PAIR = "('0x' || substr(h, {i}, 2))::INTEGER"
_p = lambda i: _PAIR.format(i=2 * i + 1)
_STORIES = (
    _SEGMENTS
    + f""",
sh AS (SELECT *, md5(job_id || ':' || segment_id) AS h FROM segments),
an AS (SELECT job_id, segment_id, {_p(0)} / 255.0::DOUBLE AS hook_strength, {_p(1)} / 255.0::DOUBLE AS ending_strength, {_p(5)} / 255.0::DOUBLE AS confidence,
              't' || {_p(6)} % 7 AS topic, CASE WHEN {_p(8)} % 5 = 0 THEN 'neutral' ELSE 'e' || {_p(8)} % 5 END AS emotion, kind AS role, {_p(9)} % 3 <> 0 AS depends FROM sh),
bo AS (SELECT *, ord // 5 AS idx, ord - CASE WHEN {_p(12)} < 20 THEN 2 ELSE 0 END AS k, unnest(range(CASE WHEN {_p(13)} < 20 THEN 2 ELSE 1 END)) AS copy FROM sh WHERE {_p(11)} >= 40),
ca AS (SELECT job_id, idx, segment_id, start_s, end_s, dense_rank() OVER (PARTITION BY job_id ORDER BY idx) AS c,
              row_number() OVER (PARTITION BY job_id, idx ORDER BY k, ord, copy) AS pos FROM bo),
lagged AS (SELECT *, lag(segment_id) OVER w AS before, lag(end_s) OVER w AS before_end FROM ca WINDOW w AS (PARTITION BY job_id, c ORDER BY pos)),
ve AS (SELECT job_id, c, list_concat(CASE WHEN bool_or(start_s < before_end - 0.5) THEN ['timestamp_overlap'] ELSE [] END,
              coalesce(list('gap_at_' || before ORDER BY pos) FILTER (start_s - before_end > 5), []), CASE WHEN count(DISTINCT segment_id) < count(*) THEN ['duplicate_segments'] ELSE [] END,
              CASE WHEN count(*) < 3 THEN ['too_few_segments'] ELSE [] END) AS issues FROM lagged GROUP BY 1, 2),
q0 AS (SELECT job_id, c, count(*) AS n, count(DISTINCT topic) AS dt, coalesce(max(hook_strength) FILTER (role = 'hook'), 0.5::DOUBLE) AS hook_quality,
              coalesce(max(ending_strength) FILTER (role = 'ending'), 0.5::DOUBLE) AS ending_quality, count(*) FILTER (depends) AS d, count(DISTINCT emotion) FILTER (emotion <> 'neutral') AS e
       FROM ca JOIN an USING (job_id, segment_id) GROUP BY 1, 2),
q1 AS (SELECT *, 1::DOUBLE AS completeness, 1::DOUBLE - dt / n AS coherence, CASE WHEN n >= 2 THEN least(1::DOUBLE, 0.3::DOUBLE + d / n) ELSE 0.5 END AS continuity,
              CASE WHEN e > 0 THEN least(1::DOUBLE, e / 4) ELSE 0.3 END AS emotional_arc FROM q0),
q2 AS (SELECT * EXCLUDE (completeness, coherence, hook_quality, ending_quality, continuity, emotional_arc), hook_quality AS hq, ending_quality AS eq, coherence AS co, completeness,
              floor((completeness * 0.25 + coherence * 0.25 + hook_quality * 0.15 + ending_quality * 0.15 + continuity * 0.1 + emotional_arc * 0.1) * 10000 + 0.500001) / 10000 AS score,
              floor(coherence * 10000 + 0.500001) / 10000 AS coherence, floor(hook_quality * 10000 + 0.500001) / 10000 AS hook_quality, floor(ending_quality * 10000 + 0.500001) / 10000 AS ending_quality,
              floor(continuity * 10000 + 0.500001) / 10000 AS continuity, floor(emotional_arc * 10000 + 0.500001) / 10000 AS emotional_arc FROM q1)
"""
)
C_BOUNDARIES = _with(
    _STORIES,
    """, g AS (SELECT job_id, idx, string_agg(segment_id, ',' ORDER BY k, ord, copy) AS segments, arg_min(segment_id, (k, ord, copy)) AS first FROM bo GROUP BY ALL)
SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1)::INTEGER AS idx, (idx % 3)::INTEGER AS block_ids, segments, 'Story ' || idx AS name, CASE WHEN idx % 2 = 0 THEN 'summary' ELSE '' END AS summary,
 CASE WHEN idx % 2 = 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS start_confidence, 0.8::DOUBLE AS end_confidence, CASE WHEN idx % 2 = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS boundary_confidence, 0.5::DOUBLE AS structural_confidence,
 CASE WHEN idx % 2 = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS semantic_confidence, CASE WHEN idx % 2 = 1 THEN first ELSE '' END AS ambiguous_segments FROM g""",
)
K_VERIFY = _with(_STORIES, "SELECT job_id, printf('cand_%03d', c) AS candidate_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS verified FROM ve")
K_QUALITY = _with(
    _STORIES,
    """SELECT job_id, printf('story_%03d', c) AS story_id, completeness, coherence, hook_quality, ending_quality, continuity, emotional_arc, score AS story_quality_score,
 coalesce(nullif(concat_ws('; ', CASE WHEN co < 0.3 THEN 'low coherence' END, CASE WHEN hq < 0.3 THEN 'weak hook' END, CASE WHEN eq < 0.3 THEN 'weak ending' END), ''), 'acceptable') AS quality_explanation,
 CASE WHEN score < 0.3 THEN 'quality_too_low' WHEN hook_quality < 0.2 THEN 'weak_hook' WHEN ending_quality < 0.2 THEN 'weak_ending' ELSE '' END AS reason FROM q2""",
)
K_COVERAGE = _with(
    _STORIES,
    """SELECT job_id, total_segments, covered_segments, fully_covered, partially_covered, unused, unused_segments, unused_duration, unused_stories,
 floor(covered_segments / total_segments * 10000 + 0.500001) / 10000 AS coverage_score, floor(unused_duration / 30)::INTEGER AS potential_shorts
 FROM (SELECT job_id, count(*) AS total_segments, count(n) AS covered_segments, count(*) FILTER (n = 1) AS fully_covered, count(*) FILTER (n > 1) AS partially_covered, count(*) FILTER (n IS NULL) AS unused,
  coalesce(string_agg(segment_id, ',' ORDER BY segment_id) FILTER (n IS NULL), '') AS unused_segments, coalesce(round(sum(end_s - start_s) FILTER (n IS NULL), 3), 0) AS unused_duration
  FROM segments LEFT JOIN (SELECT job_id, segment_id, count(*) AS n FROM ca GROUP BY 1, 2) USING (job_id, segment_id) GROUP BY 1)
 LEFT JOIN (SELECT job_id, count(*) AS bad FROM ve WHERE len(issues) > 0 GROUP BY 1) USING (job_id), LATERAL (SELECT coalesce(bad, 0) AS unused_stories)""",
)
L_BUILD = _with(
    _STORIES,
    """SELECT job_id, 'bp_' || s || '_1_' || m AS blueprint_id, s AS story_id, coalesce(o, first_id) AS opening_segment, coalesce(z, last_id) AS ending_segment, start_time, end_time, n_cuts, cut_sum, cut_confidence,
 score AS blueprint_confidence, s || ':' || substr(md5(ids), 1, 12) AS signature, arc_size
 FROM (SELECT job_id, c, printf('story_%03d', c) AS s, count(*) AS m, arg_min(segment_id, pos) AS first_id, arg_max(segment_id, pos) AS last_id, arg_min(segment_id, pos) FILTER (pos <= 3 AND hook_strength > 0.5) AS o,
   arg_max(segment_id, pos) FILTER (pos > size - 3 AND ending_strength > 0.5) AS z, arg_min(start_s, pos) AS start_time, arg_max(end_s, pos) AS end_time, (count(*) FILTER (role <> before))::INTEGER AS n_cuts,
   coalesce(round(sum(start_s) FILTER (role <> before), 3), 0) AS cut_sum, floor(avg(confidence) * 10000 + 0.500001) / 10000 AS cut_confidence, string_agg(segment_id, '|' ORDER BY pos) AS ids, count(DISTINCT segment_id)::INTEGER AS arc_size
  FROM (SELECT *, lag(role) OVER (PARTITION BY job_id, c ORDER BY pos) AS before, count(*) OVER (PARTITION BY job_id, c) AS size FROM ca JOIN an USING (job_id, segment_id)) GROUP BY 1, 2)
 JOIN q2 USING (job_id, c)""",
)
M_CONSTRAINTS = _with(
    _CLIPS,
    """SELECT job_id, id, array_to_string(list_filter([CASE WHEN duration < 15 THEN 'duration_too_short' WHEN duration > 90 THEN 'duration_too_long' END,
 CASE WHEN NOT (h_start <= b_start AND b_start <= e_start) THEN 'non_chronological' END, CASE WHEN h_end > b_start OR b_end > e_start THEN 'segment_overlap' END,
 CASE WHEN b_start - h_end > 30 OR e_start - b_end > 30 THEN 'excessive_gap' END, CASE WHEN total_score < 0.15 THEN 'score_too_low' END], lambda x: x IS NOT NULL), ',') AS reasons FROM clips""",
)
M_FUNNEL = _with(
    _CLIPS,
    """, ok AS (SELECT job_id, duration BETWEEN 15 AND 90 AND h_start <= b_start AND b_start <= e_start AND h_end <= b_start AND b_end <= e_start
  AND b_start - h_end <= 30 AND e_start - b_end <= 30 AND total_score >= 0.15 AS ok FROM clips)
SELECT job_id, count(*) AS n_in, count(*) FILTER (ok) AS n_passed, least(count(*) FILTER (ok), 5) AS n_ranked FROM ok GROUP BY 1""",
)
_STOP = "'the a an is are was were in on at to for of and or but it that this with as by from be been being have has had do does did will would can could may might shall should not no nor so if then than too very just about also more some any each every all both few most other into over such only own same'"
M_STAGES = _with(
    _CLIPS,
    rf""", t AS (SELECT *, string_split(lower(h_text), ' ') AS hw, string_split(lower(b_text), ' ') AS bw, string_split(lower(e_text), ' ') AS ew, (b_start - h_end + e_start - b_end) / 2 AS gap, round(b_start - h_end, 9) AS g1, round(h_end - h_start, 9) AS hd,
  concat_ws(' ', h_text, b_text, e_text) AS al, ['he','she','it','they','him','her','his','their'] AS pr, string_split({_STOP}, ' ') AS st FROM clips),
u AS (SELECT *, len(string_split(h_text, ' ')) AS hn, len(string_split(al, ' ')) / greatest(duration, 0.1::DOUBLE) AS pace, contains(h_text, '?') AS ask, list_contains(hw, 'you') AS you, regexp_matches(lower(h_text), 'secret|truth|why|how|never|always|actually') AS cur,
  list_has_any(ew, ['subscribe','follow','like','comment','share','so','therefore','that''s','basically']) AS closes FROM t)
SELECT job_id, id,
 floor(least(1::DOUBLE, CASE WHEN gap < 2 THEN 0.4 WHEN gap < 5 THEN 0.3 WHEN gap < 10 THEN 0.2 ELSE 0.1 END::DOUBLE + CASE WHEN list_has_any(hw, pr) AND list_has_any(bw, pr) AND NOT list_has_any(list_intersect(hw, pr), list_intersect(bw, pr)) THEN 0 ELSE 0.3 END::DOUBLE
   + CASE WHEN len(list_filter(list_intersect(hw, bw), lambda x: NOT list_contains(st, x))) > 0 THEN 0.3 ELSE 0.1 END::DOUBLE) * 10000 + 0.500001::DOUBLE) / 10000 AS context_score, 0.75::DOUBLE AS context_confidence,
 floor((least(1::DOUBLE, CASE WHEN hd BETWEEN 3 AND 7 THEN 0.25 WHEN hd BETWEEN 2 AND 10 THEN 0.15 ELSE 0.05 END::DOUBLE + CASE WHEN ask THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN you THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN cur THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN hn <= 10 THEN 0.15 WHEN hn <= 15 THEN 0.1 ELSE 0.05 END::DOUBLE)) * 10000 + 0.500001::DOUBLE) / 10000 AS hook_quality_score,
 floor((list_avg(list_filter([CASE WHEN hd BETWEEN 3 AND 7 THEN 0.9 WHEN hd BETWEEN 2 AND 10 THEN 0.7 ELSE 0.4 END::DOUBLE, CASE WHEN ask THEN 0.95::DOUBLE END, CASE WHEN you THEN 0.85::DOUBLE END, CASE WHEN cur THEN 0.8::DOUBLE END, CASE WHEN hn <= 10 THEN 0.9 WHEN hn <= 15 THEN 0.75 ELSE 0.5 END::DOUBLE], lambda x: x IS NOT NULL))) * 10000 + 0.500001::DOUBLE) / 10000 AS hook_quality_confidence,
 floor((least(1::DOUBLE, CASE WHEN pace BETWEEN 2.5 AND 3.5 THEN 0.9 WHEN pace BETWEEN 1.5 AND 4.5 THEN 0.7 WHEN pace BETWEEN 1 AND 5 THEN 0.5 ELSE 0.3 END::DOUBLE + CASE WHEN regexp_matches(al, '\p{{Nd}}') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN len(list_filter(string_split(al, ' '), lambda x: length(x) > 2 AND regexp_matches(x, '^\p{{Lu}}'))) > 0 THEN 0.05 ELSE 0 END::DOUBLE)) * 10000 + 0.500001::DOUBLE) / 10000 AS density_score, 0.8::DOUBLE AS density_confidence,
 floor((least(1::DOUBLE, CASE WHEN duration BETWEEN 30 AND 60 THEN 0.3 WHEN duration BETWEEN 20 AND 75 THEN 0.2 WHEN duration BETWEEN 15 AND 90 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN closes THEN 0.25 ELSE 0.1 END::DOUBLE + flow_score * 0.25::DOUBLE + CASE WHEN g1 < 1 THEN 0.2 WHEN g1 < 3 THEN 0.15 ELSE 0.05 END::DOUBLE)) * 10000 + 0.500001::DOUBLE) / 10000 AS retention_score,
 floor(((CASE WHEN duration BETWEEN 30 AND 60 THEN 0.85 WHEN duration BETWEEN 20 AND 75 THEN 0.7 WHEN duration BETWEEN 15 AND 90 THEN 0.5 ELSE 0.3 END::DOUBLE + CASE WHEN closes THEN 0.8 ELSE 0.5 END::DOUBLE + 0.7::DOUBLE + CASE WHEN g1 < 1 THEN 0.9 WHEN g1 < 3 THEN 0.75 ELSE 0.4 END::DOUBLE) / 4) * 10000 + 0.500001::DOUBLE) / 10000 AS retention_confidence
FROM u""",
)
O_RECORDS = _with(_SETS.format(m=500), "SELECT job_id, id AS clip_id, 'generated' AS lifecycle, score AS overall_score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, id)::INTEGER AS portfolio_rank FROM sets")
O_TRUTH = "SELECT d.doc_id::VARCHAR AS clip_id, CASE WHEN l.doc_id IS NULL THEN 'generated' ELSE 'edited' END AS lifecycle, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"
O_ANALYTICS = _with(
    _CLIPS,
    """, m AS (SELECT job_id, max(end_s) AS seconds, count(*) AS chunks FROM chunks GROUP BY 1), c AS (SELECT job_id, count(*) AS n, count(*) FILTER (rank <= 3) AS k FROM clips GROUP BY 1)
SELECT job_id, chunks, coalesce(n, 0) AS candidates, coalesce(k, 0) AS clips, round(least(1::DOUBLE, chunks / CASE WHEN seconds < 600 THEN 3 ELSE 5 END::DOUBLE), 6) AS utilisation, seconds FROM m LEFT JOIN c USING (job_id)""",
)
A_PENDING = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
A_BATCHES = """SELECT batch, doc_id FROM (SELECT (d.doc_id // 3)::BIGINT AS batch, d.doc_id, bool_and(l.doc_id IS NOT NULL) OVER (PARTITION BY d.doc_id // 3) AS done FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE NOT done"""
A_SNAPSHOT = _with(_CHUNKS, "SELECT 'chunks' AS stage, job_id, count(*) AS n_rows FROM chunks GROUP BY 2")
A_MEDIA = "SELECT page_id, url || ['.mp4', '.MOV', '.txt', '.webm', '.html'][page_id % 5 + 1] AS path, (length(html) * (page_id % 3))::BIGINT AS length FROM pages WHERE page_id % 5 IN (0, 1, 3) AND length(html) * (page_id % 3) > 0"
P_LATENCY = _with(
    _EVENTS,
    """, r AS (SELECT stage, elapsed_ms, row_number() OVER (PARTITION BY stage ORDER BY elapsed_ms) AS i, count(*) OVER (PARTITION BY stage) AS n FROM ev)
SELECT stage, max(n) AS n, (max(elapsed_ms) FILTER (i = (n - 1) // 2 + 1) + max(elapsed_ms) FILTER (i = n // 2 + 1)) / 2 AS p50, max(elapsed_ms) FILTER (i = greatest(0, n * 95 // 100 - 1) + 1) AS p95, max(elapsed_ms) AS max FROM r GROUP BY 1""",
)
_BUDGET = _EVENTS + ", bu AS (SELECT *, CASE stage WHEN 'view' THEN 100 WHEN 'error' THEN 200 WHEN 'click' THEN 50 ELSE 1000 END::DOUBLE AS budget_ms FROM ev), bs AS (SELECT *, CASE WHEN elapsed_ms / budget_ms > 1 THEN 'exceeded' WHEN elapsed_ms / budget_ms > 0.8::DOUBLE THEN 'warning' ELSE 'ok' END AS status FROM bu)"
P_BUDGET = _with(_BUDGET, "SELECT seq, stage, budget_ms, status FROM bs")
P_ENFORCE = _with(_BUDGET, "SELECT seq, warnings, warnings >= 3 AS disabled FROM (SELECT seq, (sum((status <> 'ok')::INTEGER) OVER (PARTITION BY stage ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS warnings FROM bs)")
P_RUNS = _with(_EVENTS, "SELECT key AS run_id, round(sum(elapsed_ms), 3) AS total_ms, count(*) AS executed, count(*) FILTER (stage NOT IN ('error', 'view')) AS succeeded, count(*) FILTER (stage = 'error') AS failed, count(*) FILTER (stage = 'view') AS skipped FROM ev GROUP BY 1")
P_USAGE = _with(
    _EVENTS,
    """, u AS (SELECT seq, (sum(tokens) OVER w)::BIGINT AS tokens_60s, count(*) OVER w AS requests_60s FROM ev WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))
SELECT *, greatest(0::DOUBLE, 4800::DOUBLE - tokens_60s) AS token_room, greatest(0::DOUBLE, 21::DOUBLE - requests_60s) AS request_room FROM u""",
)
_REQUESTS = _EVENTS + ", rq AS (SELECT seq, ts, key, strftime(ts, '%Y-%m-%d') AS request_id, CASE name WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'queued' ELSE 'failed' END AS name FROM ev)"
P_QUEUE = _with(
    _REQUESTS,
    """, r AS (SELECT key, request_id, min(epoch_us(ts)) FILTER (name = 'queued') / 1000 AS q, min(epoch_us(ts)) FILTER (name = 'started') / 1000 AS s, min(epoch_us(ts)) FILTER (name = 'completed') / 1000 AS c FROM rq GROUP BY ALL)
SELECT key, count(*) AS requests, round(avg(s - q), 3) AS wait_ms, round(avg(c - s), 3) AS run_ms FROM r GROUP BY 1""",
)
P_DEPTH = _with(
    _REQUESTS,
    """, d AS (SELECT *, sum(CASE name WHEN 'queued' THEN 1 WHEN 'started' THEN 0 ELSE -1 END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS depth FROM rq)
SELECT key, greatest(0, max(depth))::BIGINT AS peak_depth, count(*) FILTER (name = 'queued') AS submitted, count(*) FILTER (name = 'completed') AS completed, count(*) FILTER (name = 'failed') AS failed FROM d GROUP BY 1""",
)
P_FAILURES = _with(
    _EVENTS,
    """, r AS (SELECT *, (sum(ok::INTEGER) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM ev)
SELECT key, run, sum(CASE WHEN rate_limited THEN 2 ELSE 1 END)::BIGINT AS weight, count(*) AS failures FROM r WHERE NOT ok GROUP BY ALL HAVING sum(CASE WHEN rate_limited THEN 2 ELSE 1 END) >= 3""",
)
P_STATUS = _with(
    _EVENTS,
    """, x AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS i, CASE name WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM ev)
SELECT job_id, status, round(least(greatest(elapsed_ms / 200, 0::DOUBLE), 1::DOUBLE), 6) AS progress, status IN ('complete', 'failed') AS done FROM x WHERE i = 1""",
)
P_COUNTS = _with(_EVENTS, "SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS window_start, name, count(*) AS n FROM ev GROUP BY ALL")
P_SESSIONS = _with(
    _EVENTS,
    """, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM ev),
h AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT job_id, min(epoch_us(ts)) AS session_start, count(*) AS n_events, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us FROM h GROUP BY job_id, s""",
)
C_BAD_BOUNDARIES = f"SELECT DISTINCT job_id, -1 AS place, 'invalid_json' AS reason FROM ({C_BOUNDARIES}) WHERE job_id % 10 = 0"
C_PIECE_BINS = C_PIECES[: C_PIECES.index("g AS (")].rstrip().rstrip(",") + " SELECT job_id, ord::INTEGER AS ord, bin FROM w JOIN d USING (job_id, i)"
B_TASKS = "SELECT conv_id AS job_id, turn, conv_id || '_annotate_' || substr(md5(coalesce(text, '')), 1, 8) || '_' || turn AS task_id FROM conversations"
E_STORED = "SELECT conv_id AS job_id, turn, length(coalesce(text, ''))::DOUBLE AS chars, len(string_split(coalesce(text, ''), ' '))::DOUBLE AS pieces FROM conversations"
A_TRANSCRIPTS = _with(_CHUNKS, "SELECT job_id::VARCHAR AS job_id, chunk_idx, chunk_id, start_s, end_s, text, 0::DOUBLE AS confidence FROM chunks")
A_REPLACED = "SELECT lang, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS version, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE lang IS NOT NULL GROUP BY ALL"
H_FAILING = _with(
    _CLIPS,
    """, o AS (SELECT job_id, id, floor(e_end - h_start)::BIGINT % 4 AS d FROM clips)
SELECT job_id, id, CASE WHEN d = 0 THEN 0.5 ELSE round(1::DOUBLE / d, 6) END::DOUBLE AS ratio, CASE WHEN d = 0 THEN 'error' ELSE 'success' END AS ratio_status, 'error' AS lost_status,
 round((CASE WHEN d = 0 THEN 0.5 ELSE 1::DOUBLE / d END::DOUBLE + 0.5::DOUBLE + 0.5::DOUBLE) / 3, 4) AS overall_score FROM o""",
)
P_ALARMS = _with(
    _EVENTS,
    """, o AS (SELECT *, CASE WHEN ok THEN 0 WHEN rate_limited THEN 2 ELSE 1 END AS own, sum(ok::INTEGER) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM ev),
w AS (SELECT *, (sum(own) OVER (PARTITION BY key, run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::INTEGER AS weight FROM o)
SELECT key, seq, weight FROM w WHERE NOT ok AND weight >= 3 AND weight - own < 3 AND epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM ev) - 600000""",
)
P_ENFORCE_STREAM = _with(
    _BUDGET,
    """SELECT stage, seq, warnings, warnings >= 3 AS disabled FROM (SELECT stage, seq, ts, (sum((elapsed_ms > 0.8::DOUBLE * budget_ms)::INTEGER) OVER (PARTITION BY stage ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::INTEGER AS warnings FROM bs)
WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM ev) - 600000""",
)
A_LINEAGE = """WITH h AS (SELECT substr(sha256(coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(30)), coalesce(text::VARCHAR, chr(30)), coalesce(lang::VARCHAR, chr(30)), coalesce(source::VARCHAR, chr(30)), coalesce(n_chars::VARCHAR, chr(30)))), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR || ':' || count(*)), 1, 16) AS output_hash FROM documents)
SELECT 'documents' AS stage, 1 AS version, substr(sha256(':documents:1:' || output_hash), 1, 16) AS artifact_id, '' AS parent_id, '' AS parent_hash, output_hash FROM h"""
