"""The same results in SQL, for comparison."""

from __future__ import annotations

from workload.queries import BASE_PROMPTS, COMMON_WORDS, PROMPT_LENGTH
from workload.tables import MAX_TOKENS, VOWELS

_STRIP = """'.,;:!?"''()[]{}<>'"""


def _r6(expression: str) -> str:
    return f"(CASE WHEN round({expression}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expression}, 6) END)"


def _last_word(text: str) -> str:
    return f"trim(regexp_extract({text}, '(\\S+)\\s*$', 1), {_STRIP})"


_LINES = """lines AS (
  SELECT doc_id AS prompt_id, lang, unnest(string_split(text, chr(10))) AS text,
         CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS sample_idx
  FROM documents)"""

_WRITTEN = f"""{_LINES},
written AS (
  SELECT DISTINCT prompt_id, {_last_word('text')} AS word FROM lines
  WHERE {_last_word('text')} <> '')"""

_CANDIDATES = f"""{_LINES},
cleaned AS (SELECT prompt_id, sample_idx, lower({_last_word('text')}) AS word FROM lines),
candidates AS (
  SELECT prompt_id, word, min(sample_idx) AS sample_idx FROM cleaned WHERE word <> ''
  GROUP BY prompt_id, word)"""

_LEXICON = """lexicon AS (
  SELECT word, CASE WHEN length(word) % 2 = 0 THEN 'n' ELSE 'v' END AS first_pos
  FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark))"""

_NAMES = """names AS (
  SELECT DISTINCT lower(word) AS word FROM (
    SELECT unnest(regexp_extract_all(text, '[A-Z][A-Za-z]*')) AS word FROM benchmark
    UNION ALL SELECT n_name FROM nation))"""

_VOCAB = f"""vocab AS (
  SELECT word, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS word FROM documents)
  GROUP BY word ORDER BY n DESC, word LIMIT {COMMON_WORDS})"""

_TAGS = """tags AS (
  SELECT word, CASE length(word) % 4 WHEN 1 THEN 'NNP' WHEN 2 THEN 'NNS' ELSE 'NN' END AS tag
  FROM (SELECT DISTINCT word FROM written))"""

_FORMAT_OK = "(length(trim(word)) > 0 AND NOT contains(trim(word), ' ') AND NOT contains(trim(word), '-'))"
_TAG_OK = """coalesce(tag = 'NN' AND NOT (length(word) > 1 AND regexp_matches(word, '^\\p{Lu}') AND tag <> 'NNP'), false)"""

_SCORED = f"""{_CANDIDATES}, {_LEXICON}, {_NAMES},
scored AS (
  SELECT *, CASE WHEN reason = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality FROM (
    SELECT c.*, CASE WHEN NOT (length(c.word) > 0 AND NOT contains(c.word, ' ') AND NOT contains(c.word, '-')) THEN 'format'
                     WHEN coalesce(l.first_pos, '') <> 'n' THEN 'not noun'
                     WHEN n.word IS NOT NULL THEN 'known name' ELSE 'ok' END AS reason
    FROM candidates c LEFT JOIN lexicon l ON c.word = l.word LEFT JOIN names n ON c.word = n.word))"""


def _unit(e: str) -> str:
    return f"list_transform({e}, lambda x: x / greatest(sqrt(list_dot_product({e}, {e})), 1e-12))"


_UNIT = f"""unit AS (
  SELECT vec_id, label, {_unit('e')} AS u FROM (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""

_PROFILE = f"""{_UNIT},
profile AS (
  SELECT a.label, a.vec_id, max(list_dot_product(a.u, b.u)) AS max_sim,
         min(list_dot_product(a.u, b.u)) FILTER (list_dot_product(a.u, b.u) > 0) AS min_positive_sim
  FROM unit a LEFT JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  GROUP BY a.label, a.vec_id)"""

_DIVERSE = f"""{_PROFILE},
diverse AS (
  SELECT p.label AS prompt_id, p.vec_id AS sample_idx, CAST(p.vec_id AS VARCHAR) AS word,
         CAST(l.quality AS DOUBLE) AS quality, coalesce(l.quality, 0) >= 1 AS is_good,
         coalesce({_r6('1 - max_sim')}, 0.0) AS diversity
  FROM profile p LEFT JOIN labels l ON l.doc_id = p.vec_id)"""


def _pick(side: str, keys: str, source: str) -> str:
    good, order = ("", "diversity DESC") if side == "chosen" else ("NOT ", "diversity")
    return f"""{side}_pick AS (
  SELECT {keys}, word AS {side}, sample_idx AS {side}_idx, diversity AS {side}_diversity
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, sample_idx) AS rn
        FROM {source} WHERE {good}is_good) WHERE rn = 1)"""


_PICKS = f"""{_DIVERSE},
{_pick('chosen', 'prompt_id', 'diverse')},
{_pick('rejected', 'prompt_id', 'diverse')}"""
_PAIRS = f"{_PICKS}, pairs AS (SELECT * FROM chosen_pick JOIN rejected_pick USING (prompt_id))"

def _tokens(word: str) -> str:
    return f"(len(regexp_extract_all({word}, '{VOWELS}')) + 1)"


_WORD_NUMBER = "CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)"


def _word_diverse(source: str) -> str:
    """Similarities between the vectors once, then the best partner per word."""
    return f"""{_UNIT},
placed AS (SELECT c.*, {_WORD_NUMBER} AS vec_id FROM {source} c),
vec_sims AS (
  SELECT a.vec_id AS va, b.vec_id AS vb, list_dot_product(a.u, b.u) AS sim FROM unit a, unit b),
word_diverse AS (
  SELECT a.prompt_id, a.word, coalesce({_r6('1 - max(s.sim)')}, 0.0) AS diversity
  FROM placed a LEFT JOIN placed b ON a.prompt_id = b.prompt_id AND a.word <> b.word
  LEFT JOIN vec_sims s ON s.va = a.vec_id AND s.vb = b.vec_id
  GROUP BY a.prompt_id, a.word)"""


_SCORED_WORDS = f"""{_SCORED}, {_word_diverse('candidates')},
scored_words AS (
  SELECT s.*, s.quality >= 1 AS is_good, d.diversity
  FROM scored s JOIN word_diverse d USING (prompt_id, word))"""

_AUDIT = f"""{_SCORED_WORDS},
audit AS (
  SELECT prompt_id, count(*) AS candidates, count(*) FILTER (is_good) AS n_good,
         count(*) FILTER (NOT is_good) AS n_bad,
         CASE WHEN count(*) FILTER (is_good) = 0 THEN 'no good' ELSE 'no bad' END AS no_pair_reason
  FROM scored_words GROUP BY prompt_id
  HAVING count(*) FILTER (is_good) = 0 OR count(*) FILTER (NOT is_good) = 0)"""

_LOGPS = """pair_logps AS (
  SELECT l_orderkey AS batch_id, l_linenumber, l_partkey, l_suppkey,
         -ln(1 + l_quantity) AS pc, -ln(l_extendedprice) / 3 AS pr,
         ln(l_discount) AS rc, -ln(2 + 100 * l_tax) AS rr
  FROM lineitem WHERE l_discount > 0),
logits AS (SELECT *, (pc - pr) - (rc - rr) AS logits FROM pair_logps)"""

# Every line; without a discount it has no reference log-probability, and so none of the terms.
_ALL_LOGPS = _LOGPS.replace("ln(l_discount)", "CASE WHEN l_discount > 0 THEN ln(l_discount) END").replace(" WHERE l_discount > 0", "")


def _terms(beta: float, logps: str = _LOGPS) -> str:
    x = f"({beta} * logits)"
    return f"""{logps},
terms AS (
  SELECT *, greatest(-{x}, 0) + ln(1 + exp(-abs({x}))) AS sigmoid, CASE WHEN logits IS NOT NULL THEN greatest(1 - {x}, 0) END AS hinge,
         {beta} * (pc - rc) AS reward_chosen, {beta} * (pr - rr) AS reward_rejected
  FROM logits)"""


def _batch(loss: str, beta: float) -> str:
    def mean(expression: str, name: str) -> str:
        return f"coalesce({_r6(f'avg({expression})')}, 0.0) AS {name}"

    return f"""{_terms(beta)},
metrics AS (
  SELECT o.o_orderkey AS batch_id, {mean(loss, 'loss')}, {mean('reward_chosen', 'rewards_chosen')},
         {mean('reward_rejected', 'rewards_rejected')},
         {mean('CASE WHEN reward_chosen > reward_rejected THEN 1.0::DOUBLE WHEN reward_chosen IS NOT NULL THEN 0.0::DOUBLE END', 'rewards_accuracy')},
         {mean('reward_chosen - reward_rejected', 'rewards_margins')},
         {mean('pr', 'logps_rejected')}, {mean('pc', 'logps_chosen')}, {mean('logits', 'logits')},
         {_r6('count(t.batch_id) / 14.0::DOUBLE')} AS valid_pairs_frac
  FROM orders o LEFT JOIN terms t ON t.batch_id = o.o_orderkey GROUP BY o.o_orderkey)"""


_RUNS = f"""{_LINES},
runs AS (
  SELECT lang AS run, sample_idx,
         CASE WHEN regexp_extract(text, '(\\S+)\\s*$', 1) = '' THEN '[empty]'
              ELSE lower({_last_word('text')}) END AS word
  FROM lines)"""

_VECTOR_STATS = f"""{_PROFILE},
stats AS (
  SELECT CAST(p.label AS VARCHAR) AS run, s.avg_similarity, min(p.min_positive_sim) AS min_positive_similarity,
         1 - s.avg_similarity AS diversity_avg, 1 - max(p.max_sim) AS diversity_max, s.n
  FROM profile p JOIN (
    SELECT a.label, avg(list_dot_product(a.u, b.u)) AS avg_similarity, count(DISTINCT a.vec_id) AS n
    FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label) s
  ON s.label = p.label GROUP BY p.label, s.avg_similarity, s.n)"""

_FIGURES = ("avg_similarity", "min_positive_similarity", "diversity_avg", "diversity_max")


def _report(baseline: str) -> str:
    """Over ``report``: the figures and the differences to the baseline."""
    rounded = ", ".join(f"{_r6('r.' + f)} AS {f}" for f in _FIGURES)
    deltas = ", ".join(f"{_r6(f'r.{f} - b.{f}')} AS {f}_delta" for f in _FIGURES)
    return f"""SELECT r.run, '{baseline}' AS baseline, r.total_words, r.unique_words, r.missing_vectors, {rounded},
       r.total_words - b.total_words AS total_words_delta,
       r.unique_words - b.unique_words AS unique_words_delta, {deltas}
FROM report r JOIN report b ON b.run = '{baseline}'"""


_UNIQUE = "count(DISTINCT word) FILTER (word <> '[empty]')"
_WORD_REPORT = f"""{_UNIT},
summary AS (SELECT run, count(*) AS total_words, {_UNIQUE} AS unique_words FROM runs GROUP BY run),
words AS (SELECT DISTINCT run, word, {_WORD_NUMBER} AS vec_id FROM runs WHERE word <> '[empty]'),
held AS (SELECT run, vec_id, count(*) AS c FROM words GROUP BY run, vec_id),
sims AS (
  SELECT a.run, a.vec_id AS va, b.vec_id AS vb, a.c AS ca, b.c AS cb, list_dot_product(x.u, y.u) AS sim
  FROM held a JOIN held b ON a.run = b.run JOIN unit x ON x.vec_id = a.vec_id JOIN unit y ON y.vec_id = b.vec_id),
extremes AS (
  SELECT run, sum(sim * CASE WHEN va = vb THEN ca * (ca - 1) ELSE ca * cb END)
              / sum(CASE WHEN va = vb THEN ca * (ca - 1) ELSE ca * cb END) AS avg_similarity,
         min(sim) FILTER (sim > 0 AND (va <> vb OR ca > 1)) AS min_positive_similarity,
         max(sim) FILTER (va <> vb OR ca > 1) AS max_similarity
  FROM sims GROUP BY run),
report AS (
  SELECT s.*, e.avg_similarity, e.min_positive_similarity, 1 - e.avg_similarity AS diversity_avg,
         1 - e.max_similarity AS diversity_max,
         CAST(s.unique_words - (SELECT sum(h.c) FROM held h JOIN unit USING (vec_id) WHERE h.run = s.run) AS BIGINT) AS missing_vectors
  FROM summary s JOIN extremes e USING (run))"""


def _aligned(table: str, columns: str, key: str, base: str, device: int) -> str:
    """Rows in key order, from the start again until the aligned count is reached."""
    effective = device * 8
    return f"""WITH numbered AS (
  SELECT {columns}, row_number() OVER (ORDER BY {key}) - 1 AS pos, count(*) OVER () AS total FROM {table}),
sized AS (SELECT *, greatest({base} // {effective} * {effective}, {effective}) AS target FROM numbered),
copies AS (SELECT *, unnest(range(pos, target, total)) AS idx FROM sized)
SELECT {columns}, idx, idx // {device} AS batch_id, idx // {effective} AS step FROM copies"""


_EVENTS = """samples AS (
  SELECT make_timestamp(CAST(floor(epoch(ts) / 604800) AS BIGINT) * 604800000000) AS window_start, ts,
         user_id AS prompt_id, event_id AS sample_idx, regexp_extract(props, '(\\d+)', 1) AS word
  FROM events),
latest AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events),
words AS (
  SELECT window_start, prompt_id, word, min(sample_idx) AS sample_idx FROM samples
  GROUP BY window_start, prompt_id, word)"""


def _event_pairs(condition: str) -> str:
    keys = "window_start, prompt_id"
    return f"""WITH {_EVENTS}, {_UNIT},
scored AS (
  SELECT w.*, u.u, coalesce(l.quality, 0) >= 1 AS is_good FROM words w
  LEFT JOIN unit u ON CAST(u.vec_id AS VARCHAR) = w.word
  LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = w.word),
diverse AS (
  SELECT a.window_start, a.prompt_id, a.word, a.sample_idx, a.is_good,
         coalesce({_r6('1 - max(list_dot_product(a.u, b.u))')}, 0.0) AS diversity
  FROM scored a LEFT JOIN scored b
    ON a.window_start = b.window_start AND a.prompt_id = b.prompt_id AND a.word <> b.word
  GROUP BY ALL),
{_pick('chosen', keys, 'diverse')}, {_pick('rejected', keys, 'diverse')}
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, prompt_id, chosen, rejected
FROM chosen_pick JOIN rejected_pick USING (window_start, prompt_id) {condition}"""


def _padded(ids: str, side: str, pad: int) -> str:
    kept = f"{ids}[1:{PROMPT_LENGTH}]"
    fill = f"list_transform(range(greatest({PROMPT_LENGTH} - len({ids}), 0)), lambda x: {pad})"
    return f"list_concat({fill}, {kept})" if side == "left" else f"list_concat({kept}, {fill})"


def _ids(column: str) -> str:
    return f"list_transform(string_split({column}, ' '), lambda x: length(x))"


_ONES = "list_transform(ids, lambda x: 1)"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["a1_repeat_prompts"] = """
SELECT item_id AS prompt_id, text AS prompt, r.i AS copy FROM benchmark, range(8) r(i)"""
    order = ("orders", "o_orderkey, o_orderpriority", "o_orderkey")
    sql["a2_align_to_batch"] = _aligned(*order, str(BASE_PROMPTS), 1)
    sql["a2_align_small_base"] = _aligned(*order, "3", 1)
    sql["a2_align_whole_table"] = _aligned(*order, "total", 2)
    sql["a2_align_repeating"] = _aligned(
        "(SELECT item_id AS prompt_id FROM benchmark)", "prompt_id", "prompt_id", str(BASE_PROMPTS), 1
    )
    sql["a2_align_string_key"] = _aligned("customer", "c_name, c_custkey", "c_name", "total", 2)
    keys = "o_orderpriority, o_orderkey"
    sql["a2_align_composite_key"] = _aligned("orders", keys, keys, "total", 2)
    sql["a3_route_prompts"] = """
SELECT item_id AS prompt_id, 'mine' AS route,
       '<|user|>' || chr(10) || text || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS text
FROM benchmark"""
    sql["a3_route_pairs"] = f"""WITH {_PAIRS}
SELECT prompt_id, 'ready' AS route, chosen || '|' || rejected AS text FROM pairs"""
    turns = """turns AS (
  SELECT t.conv_id, t.turn, t.role, t.text, p.role AS role_before, p.text AS text_before
  FROM conversations t LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1)"""

    def message(role: str, text: str) -> str:
        return f"'<|' || {role} || '|>' || chr(10) || {text} || '<|end|>' || chr(10)"

    sql["a4_render_chat"] = f"""WITH {turns}
SELECT conv_id, turn, CASE
  WHEN role = 'system' OR coalesce(role_before, '') = 'system' THEN text
  WHEN role_before IS NULL THEN {message('role', 'text')} || '<|assistant|>' || chr(10)
  ELSE {message('role_before', 'text_before')} || {message('role', 'text')} || '<|assistant|>' || chr(10)
  END AS prompt FROM turns"""
    rows = f"rows AS (SELECT doc_id, {_ids('text')} AS ids FROM documents)"
    sql["a5_fixed_length_ids"] = f"""WITH {rows}
SELECT doc_id, array_to_string({_padded('ids', 'left', 0)}, ',') AS ids_left,
       array_to_string({_padded(_ONES, 'left', 0)}, ',') AS mask_left,
       array_to_string({_padded('ids', 'right', 0)}, ',') AS ids_right,
       array_to_string({_padded(_ONES, 'right', 0)}, ',') AS mask_right FROM rows"""
    sql["a6_prompt_length"] = f"""WITH {rows}
SELECT doc_id,
       CAST(len(list_filter({_padded('ids', 'left', 2)}, lambda x: x <> 2)) AS INTEGER) AS length_left,
       CAST(list_sum({_padded(_ONES, 'right', 0)}) AS INTEGER) AS length_right FROM rows"""
    sql["a7_collate_to_longest"] = f"""WITH rows AS (SELECT conv_id, turn, {_ids('text')} AS ids FROM conversations),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS longest FROM rows)
SELECT conv_id, turn,
       array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0)), ',') AS ids,
       array_to_string(list_concat({_ONES}, list_transform(range(longest - len(ids)), lambda x: 0)), ',') AS mask
FROM sized"""
    sql["a8_gazetteer"] = f"WITH {_NAMES} SELECT word FROM names"
    sql["a9_top_n_vocab"] = f"WITH {_VOCAB} SELECT word, n FROM vocab"

    sql["b1_expand_samples"] = """
SELECT item_id AS prompt_id, text AS prompt, CAST(r.i AS INTEGER) AS sample_idx FROM benchmark, range(64) r(i)"""
    outputs = f"""{turns},
outputs AS (
  SELECT conv_id, turn, role, text_before, CASE conv_id % 3 WHEN 0 THEN text_before || ' ' || text
         WHEN 1 THEN text || ' ' || text_before ELSE text END AS output
  FROM turns WHERE text_before IS NOT NULL),
answers AS (
  SELECT conv_id, turn, role, trim(CASE WHEN starts_with(output, text_before)
    THEN substr(output, length(text_before) + 1) ELSE replace(output, text_before, '') END,
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS answer FROM outputs)"""
    sql["b2_strip_prompt_echo"] = f"WITH {outputs} SELECT conv_id, turn, answer FROM answers"
    sql["b3_last_word"] = f"WITH {_LINES} SELECT prompt_id, sample_idx, {_last_word('text')} AS word FROM lines"
    sql["b4_normalise_train"] = f"WITH {_CANDIDATES} SELECT prompt_id, sample_idx, word FROM cleaned WHERE word <> ''"
    sql["b4_normalise_eval"] = f"""WITH {_LINES}
SELECT prompt_id, sample_idx, CASE WHEN regexp_extract(text, '(\\S+)\\s*$', 1) = '' THEN '[empty]'
       ELSE lower({_last_word('text')}) END AS word FROM lines"""
    sql["b5_dedupe_keep_first"] = f"WITH {_CANDIDATES} SELECT prompt_id, word, sample_idx FROM candidates"
    sql["b6_candidate_census"] = f"""WITH {_CANDIDATES},
counts AS (
  SELECT prompt_id, count(*) AS generated, count(*) FILTER (word <> '') AS non_empty,
         count(DISTINCT word) FILTER (word <> '') AS unique_words FROM cleaned GROUP BY prompt_id)
SELECT o.o_orderkey AS prompt_id, coalesce(generated, 0) AS generated, coalesce(non_empty, 0) AS non_empty,
       coalesce(unique_words, 0) AS unique_words,
       CASE WHEN coalesce(generated, 0) = 0 THEN 'no completions' WHEN unique_words = 0 THEN 'no words'
            ELSE 'ok' END AS status
FROM orders o LEFT JOIN counts c ON c.prompt_id = o.o_orderkey"""

    sql["c1_format_ok"] = f"""
SELECT word, count(*) AS n, {_FORMAT_OK} AS format_ok FROM (
  SELECT p_name AS word FROM part UNION ALL SELECT p_brand FROM part
  UNION ALL SELECT o_orderpriority FROM orders) GROUP BY word"""
    sql["c2_lexicon_noun"] = f"""WITH {_CANDIDATES}, {_LEXICON}
SELECT prompt_id, c.word, coalesce(first_pos = 'n', false) AS is_noun
FROM candidates c LEFT JOIN lexicon l ON l.word = c.word"""
    sql["c3_not_in_gazetteer"] = f"""WITH {_CANDIDATES}, {_NAMES}
SELECT prompt_id, c.word, n.word IS NULL AS not_a_name
FROM candidates c LEFT JOIN names n ON n.word = c.word"""
    sql["c4_in_common_vocab"] = f"""WITH {_CANDIDATES}, {_VOCAB}
SELECT prompt_id, c.word, v.word IS NOT NULL AS is_common
FROM candidates c LEFT JOIN vocab v ON v.word = c.word"""
    sql["c5_tag_rule"] = f"""WITH {_WRITTEN}, {_TAGS}
SELECT prompt_id, word, {_TAG_OK} AS tag_ok FROM written LEFT JOIN tags USING (word)"""
    sql["c6_quality_lexicon"] = f"WITH {_SCORED} SELECT prompt_id, word, quality, reason FROM scored"
    sql["c6_quality_common"] = f"""WITH {_WRITTEN}, {_TAGS}, {_VOCAB},
reasons AS (
  SELECT prompt_id, w.word, CASE WHEN NOT {_FORMAT_OK.replace('word', 'w.word')} THEN 'format'
    WHEN v.word IS NULL THEN 'not common'
    WHEN NOT {_TAG_OK.replace('word', 'w.word')} THEN 'tag' ELSE 'ok' END AS reason
  FROM written w LEFT JOIN tags t ON t.word = w.word LEFT JOIN vocab v ON v.word = lower(w.word))
SELECT prompt_id, word, CASE WHEN reason = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality, reason FROM reasons"""
    vowel = "right(word, 1) IN ('a', 'e', 'i', 'o', 'u')"
    sql["c6_quality_custom"] = f"""WITH {_CANDIDATES}
SELECT prompt_id, word, CASE WHEN {vowel} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS quality,
       CASE WHEN {vowel} THEN 'ok' ELSE 'custom rule' END AS reason FROM candidates"""
    sql["c7_quality_reasons"] = f"WITH {_SCORED} SELECT reason, count(*) AS n FROM scored GROUP BY reason"

    sql["d1_attach_embeddings"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS word, CAST(coalesce(len(embedding), -1) AS INTEGER) AS dim,
       {_r6('coalesce(list_sum(CAST(embedding AS DOUBLE[])), 0.0)')} AS total
FROM labels LEFT JOIN embeddings ON vec_id = doc_id"""
    sql["d2_l2_normalise"] = f"""WITH {_UNIT}
SELECT sample_idx, dim, {_r6('x')} AS x FROM (
  SELECT vec_id AS sample_idx, unnest(u) AS x, CAST(unnest(range(len(u))) AS INTEGER) AS dim FROM unit)"""
    sql["d3_similarity_profile"] = f"""WITH {_PROFILE}
SELECT label AS prompt_id, vec_id AS sample_idx, {_r6('max_sim')} AS max_sim,
       {_r6('min_positive_sim')} AS min_positive_sim FROM profile"""
    pair = "list_dot_product(a.u, b.u)"
    sql["d3_blocks"] = f"""WITH {_UNIT}
SELECT a.vec_id AS sample_idx, {_r6(f'max({pair})')} AS max_sim, {_r6(f'min({pair}) FILTER ({pair} > 0)')} AS min_positive_sim
FROM unit a LEFT JOIN unit b ON a.vec_id <> b.vec_id GROUP BY a.vec_id"""
    sql["d4_max_sim_diversity"] = f"WITH {_DIVERSE} SELECT prompt_id, sample_idx, diversity FROM diverse"
    sql["d4_blocks"] = f"""WITH {_UNIT}
SELECT a.vec_id AS sample_idx, coalesce({_r6('1 - max(list_dot_product(a.u, b.u))')}, 0.0) AS diversity
FROM unit a LEFT JOIN unit b ON a.vec_id <> b.vec_id GROUP BY a.vec_id"""
    sql["d4_word_diversity"] = f"""WITH {_CANDIDATES}, {_word_diverse('candidates')}
SELECT prompt_id, word, sample_idx, diversity FROM candidates JOIN word_diverse USING (prompt_id, word)"""
    sql["d5_diversity_fallback"] = f"""WITH {_UNIT},
members AS (
  SELECT doc_id AS sample_idx, doc_id // 7 AS prompt_id, u FROM labels LEFT JOIN unit ON vec_id = doc_id),
whole AS (SELECT prompt_id, count(*) = count(u) AS complete FROM members GROUP BY prompt_id),
best AS (
  SELECT a.prompt_id, a.sample_idx, {_r6('1 - max(list_dot_product(a.u, b.u))')} AS diversity
  FROM members a LEFT JOIN members b ON a.prompt_id = b.prompt_id AND a.sample_idx <> b.sample_idx
  GROUP BY a.prompt_id, a.sample_idx)
SELECT sample_idx, prompt_id, CASE WHEN complete THEN coalesce(diversity, 0.0) ELSE 0.0 END AS diversity
FROM best JOIN whole USING (prompt_id)"""

    sql["e1_split_quality"] = f"WITH {_DIVERSE} SELECT prompt_id, sample_idx, is_good FROM diverse"
    sql["e2_pick_chosen"] = f"WITH {_PICKS} SELECT * FROM chosen_pick"
    sql["e3_pick_rejected"] = f"WITH {_PICKS} SELECT * FROM rejected_pick"
    sql["e4_mine_pairs"] = f"WITH {_PAIRS} SELECT * FROM pairs"
    sql["e5_max_target_filter"] = f"""WITH {_PAIRS},
tokens AS (SELECT doc_id, CAST(length({_last_word('text')}) AS INTEGER) AS n FROM documents)
SELECT prompt_id, chosen, rejected, coalesce(c.n, length(chosen))::INTEGER AS chosen_tokens,
       coalesce(r.n, length(rejected))::INTEGER AS rejected_tokens
FROM pairs LEFT JOIN tokens c ON c.doc_id = chosen_idx LEFT JOIN tokens r ON r.doc_id = rejected_idx
WHERE coalesce(c.n, length(chosen)) <= 7 AND coalesce(r.n, length(rejected)) <= 7"""
    sql["e6_pair_audit"] = f"WITH {_AUDIT} SELECT prompt_id, candidates, n_good, n_bad, no_pair_reason FROM audit"
    sql["e6_audit_lines"] = f"""WITH {_AUDIT}
SELECT prompt_id, sample_idx, no_pair_reason, candidates, format('{{}}({{:.1f}})', word, quality) AS quality_text,
       CASE WHEN candidates > 1 THEN format('{{}}({{:.3f}})', word, round(diversity, 3)) ELSE 'N/A' END AS diversity_text
FROM scored_words JOIN audit USING (prompt_id)"""
    sql["text_to_pairs"] = f"""WITH {_SCORED_WORDS},
{_pick('chosen', 'prompt_id', 'scored_words')}, {_pick('rejected', 'prompt_id', 'scored_words')}
SELECT * FROM chosen_pick JOIN rejected_pick USING (prompt_id)
WHERE {_tokens('chosen')} <= {MAX_TOKENS} AND {_tokens('rejected')} <= {MAX_TOKENS}"""

    sql["f1_sequence_logp"] = f"""
SELECT l_orderkey, {_r6("sum(CASE WHEN l_returnflag <> 'R' THEN -l_discount ELSE 0 END)")} AS sequence_logp
FROM lineitem GROUP BY l_orderkey"""
    sql["f1_sequence_logp_arrays"] = f"""WITH {rows}
SELECT doc_id, {_r6('coalesce(list_sum(list_transform(ids, lambda x: CASE WHEN x > 3 THEN -x / 10.0::DOUBLE ELSE 0.0::DOUBLE END)), 0)')} AS sequence_logp
FROM rows"""
    key = "batch_id, l_linenumber, l_partkey, l_suppkey"
    sql["f2_dpo_logits"] = f"WITH {_ALL_LOGPS} SELECT {key}, {_r6('logits')} AS logits FROM logits"
    for loss, name in (("sigmoid", "f3_dpo_loss_sigmoid"), ("hinge", "f4_dpo_loss_hinge")):
        sql[name] = f"WITH {_terms(0.1, _ALL_LOGPS)} SELECT {key}, {_r6(loss)} AS loss FROM terms"
    sql["f5_rewards"] = f"""WITH {_terms(0.1, _ALL_LOGPS)}
SELECT {key}, {_r6('reward_chosen')} AS reward_chosen, {_r6('reward_rejected')} AS reward_rejected,
       {_r6('reward_chosen - reward_rejected')} AS margin, reward_chosen > reward_rejected AS accurate FROM terms"""
    sql["f6_batch_metrics"] = f"WITH {_batch('sigmoid', 0.1)} SELECT * FROM metrics"
    sql["f6_batch_metrics_hinge"] = f"WITH {_batch('hinge', 0.5)} SELECT * FROM metrics"
    x = "(0.1 * logits)"

    def mean(expression: str, name: str) -> str:
        return f"coalesce({_r6(f'avg({expression})')}, 0.0) AS {name}"

    sql["f6_step_metrics"] = f"""WITH {_SCORED_WORDS},
{_pick('chosen', 'prompt_id', 'scored_words')}, {_pick('rejected', 'prompt_id', 'scored_words')},
logps AS (
  SELECT prompt_id, -ln(2 + length(chosen)) AS pc, -ln(3 + length(rejected)) AS pr,
         -ln(4 + l.quality) AS rc, -ln(5 + l.toxic) AS rr
  FROM chosen_pick JOIN rejected_pick USING (prompt_id) JOIN labels l ON l.doc_id = prompt_id
  WHERE {_tokens('chosen')} <= {MAX_TOKENS} AND {_tokens('rejected')} <= {MAX_TOKENS}),
numbered AS (
  SELECT doc_id AS prompt_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM documents),
aligned AS (SELECT prompt_id, idx // 4 AS batch_id FROM numbered WHERE idx < total // 8 * 8),
joined AS (
  SELECT *, (pc - pr) - (rc - rr) AS logits, 0.1 * (pc - rc) AS reward_chosen, 0.1 * (pr - rr) AS reward_rejected
  FROM aligned LEFT JOIN logps USING (prompt_id))
SELECT batch_id, {mean(f'greatest(-{x}, 0) + ln(1 + exp(-abs({x})))', 'loss')},
       {mean('reward_chosen', 'rewards_chosen')}, {mean('reward_rejected', 'rewards_rejected')},
       {mean('CASE WHEN reward_chosen > reward_rejected THEN 1.0::DOUBLE WHEN pc IS NOT NULL THEN 0.0::DOUBLE END', 'rewards_accuracy')},
       {mean('reward_chosen - reward_rejected', 'rewards_margins')}, {mean('pr', 'logps_rejected')},
       {mean('pc', 'logps_chosen')}, {mean('logits', 'logits')},
       {_r6('count(pc) / CAST(count(*) AS DOUBLE)')} AS valid_pairs_frac
FROM joined GROUP BY batch_id"""
    sql["f7_zero_pair_batches"] = f"WITH {_batch('sigmoid', 0.1)} SELECT * FROM metrics WHERE valid_pairs_frac = 0"
    sql["f8_sample_pairs_log"] = f"""WITH {_terms(0.1)},
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank,
         avg(CASE WHEN reward_chosen > reward_rejected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY batch_id) AS accuracy,
         avg(reward_chosen - reward_rejected) OVER (PARTITION BY batch_id) AS margin
  FROM terms WHERE batch_id % 50 = 0)
SELECT {key}, rank, {_r6('accuracy')} AS accuracy, {_r6('margin')} AS margin FROM ranked WHERE rank <= 3"""

    sql["g1_vocabulary_summary"] = f"""WITH {_RUNS}
SELECT run, count(*) AS total_words, {_UNIQUE} AS unique_words FROM runs GROUP BY run"""
    sql["g1_vocabulary_list"] = f"""WITH {_RUNS}
SELECT run, word, count(*) AS n FROM runs WHERE word <> '[empty]' GROUP BY run, word"""
    sql["g2_avg_pairwise_similarity"] = f"WITH {_VECTOR_STATS} SELECT run, n, {_r6('avg_similarity')} AS avg_similarity FROM stats"
    sql["g3_min_positive_similarity"] = f"""WITH {_VECTOR_STATS}
SELECT run, {_r6('min_positive_similarity')} AS min_positive_similarity FROM stats"""
    sql["g3_blocks"] = f"""WITH {_UNIT}, docs AS (SELECT DISTINCT doc_id FROM documents)
SELECT 'all' AS run, {_r6(f'min({pair}) FILTER ({pair} > 0)')} AS min_positive_similarity,
       (SELECT count(*) FROM docs WHERE doc_id NOT IN (SELECT vec_id FROM unit)) AS missing_vectors
FROM unit a JOIN unit b ON a.vec_id < b.vec_id
WHERE a.vec_id IN (SELECT doc_id FROM docs) AND b.vec_id IN (SELECT doc_id FROM docs)"""
    for mode in ("avg", "max"):
        sql[f"g4_diversity_score_{mode}"] = f"""WITH {_VECTOR_STATS}
SELECT run, {_r6('diversity_' + mode)} AS diversity_score FROM stats"""
    sql["g5_vocabulary_compare"] = f"""WITH {_RUNS}
SELECT word, CASE WHEN bool_or(run = 'en') AND bool_or(run = 'fr') THEN 'both'
                  WHEN bool_or(run = 'en') THEN 'only_a' ELSE 'only_b' END AS side
FROM runs WHERE run IN ('en', 'fr') AND word <> '[empty]' GROUP BY word"""
    sql["g6_run_report"] = f"""WITH {_VECTOR_STATS},
report AS (SELECT *, n AS total_words, n AS unique_words, CAST(0 AS BIGINT) AS missing_vectors FROM stats) {_report('0')}"""
    sql["g6_run_report_words"] = f"WITH {_RUNS}, {_WORD_REPORT} {_report('en')}"
    sql["g6_report_on_outputs"] = f"""WITH {outputs},
runs AS (
  SELECT role AS run, CASE WHEN regexp_extract(answer, '(\\S+)\\s*$', 1) = '' THEN '[empty]'
         ELSE lower({_last_word('answer')}) END AS word FROM answers), {_WORD_REPORT} {_report('user')}"""

    sql["h1_window_pairs"] = _event_pairs("")
    sql["h1_stream_pairs"] = sql["h1_window_pairs"]
    beta = 0.1
    sql["h2_step_metrics"] = f"""WITH prompts AS (
  SELECT date_trunc('hour', ts) AS w, event_type <> 'error' AS found, -ln(1 + abs(value)) AS pc,
         -ln(3 + user_id) AS pr, -ln(length(event_type)) AS rc, -ln(length(props)) AS rr
  FROM events),
logits AS (SELECT *, (pc - pr) - (rc - rr) AS logits FROM prompts),
valid AS (SELECT * FROM logits WHERE found),
means AS (
  SELECT w, {mean(f'greatest(-{x}, 0) + ln(1 + exp(-abs({x})))', 'loss')},
         {mean(f'{beta} * (pc - rc)', 'rewards_chosen')},
         {mean(f'{beta} * (pr - rr)', 'rewards_rejected')},
         {mean(f'CASE WHEN {beta} * (pc - rc) > {beta} * (pr - rr) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 'rewards_accuracy')},
         {mean(f'{beta} * (pc - rc) - {beta} * (pr - rr)', 'rewards_margins')},
         {mean('pr', 'logps_rejected')}, {mean('pc', 'logps_chosen')}, {mean('logits', 'logits')}
  FROM valid GROUP BY w),
shares AS (SELECT w, {_r6('avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS valid_pairs_frac FROM prompts GROUP BY w)
SELECT CAST(epoch(w) AS BIGINT) AS window_start, valid_pairs_frac,
       {', '.join(f'coalesce({m}, 0.0) AS {m}' for m in ('loss', 'rewards_chosen', 'rewards_rejected', 'rewards_accuracy', 'rewards_margins', 'logps_rejected', 'logps_chosen', 'logits'))}
FROM shares LEFT JOIN means USING (w)"""

    figures = ("loss", "rewards_chosen", "rewards_rejected", "rewards_accuracy", "rewards_margins", "logps_rejected", "logps_chosen", "logits")
    means = ", ".join(mean(f"coalesce({m}, 0.0)", m) for m in figures)
    for name, window in (("h2_step_windows", 10), ("h2_batch_windows", 70)):
        sql[name] = f"""WITH {_terms(0.1)},
per_batch AS (
  SELECT batch_id AS batch, avg(sigmoid) AS loss, avg(reward_chosen) AS rewards_chosen, avg(reward_rejected) AS rewards_rejected,
         avg(CASE WHEN reward_chosen > reward_rejected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rewards_accuracy,
         avg(reward_chosen - reward_rejected) AS rewards_margins, avg(pr) AS logps_rejected, avg(pc) AS logps_chosen,
         avg(logits) AS logits
  FROM terms GROUP BY 1),
shares AS (
  SELECT l_orderkey AS batch, avg(CASE WHEN l_discount > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS valid_pairs_frac
  FROM lineitem GROUP BY 1)
SELECT batch // {window} * 10 AS first_step, {mean('valid_pairs_frac', 'valid_pairs_frac')}, {means}
FROM shares LEFT JOIN per_batch USING (batch) GROUP BY 1"""
    sql["h2_stream_windows"] = f"""WITH prompts AS (
  SELECT date_trunc('day', ts) AS w, user_id AS batch, event_type <> 'error' AS found, -ln(1 + abs(value)) AS pc,
         -ln(3 + user_id) AS pr, -ln(length(event_type)) AS rc, -ln(length(props)) AS rr
  FROM events),
logits AS (SELECT *, (pc - pr) - (rc - rr) AS logits, {beta} * (pc - rc) AS rewc, {beta} * (pr - rr) AS rewr FROM prompts),
per_batch AS (
  SELECT w, batch, avg(greatest(-{x}, 0) + ln(1 + exp(-abs({x})))) FILTER (found) AS loss, avg(rewc) FILTER (found) AS rewards_chosen,
         avg(rewr) FILTER (found) AS rewards_rejected,
         avg(CASE WHEN rewc > rewr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (found) AS rewards_accuracy,
         avg(rewc - rewr) FILTER (found) AS rewards_margins, avg(pr) FILTER (found) AS logps_rejected,
         avg(pc) FILTER (found) AS logps_chosen, avg(logits) FILTER (found) AS logits,
         avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS valid_pairs_frac
  FROM logits GROUP BY w, batch)
SELECT CAST(epoch(w) AS BIGINT) AS window_start, {mean('valid_pairs_frac', 'valid_pairs_frac')}, {means}
FROM per_batch WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY w"""

    sql["i1_write_pairs"] = f"""WITH {_PAIRS}
SELECT CAST(prompt_id AS VARCHAR) AS prompt, chosen, rejected, CAST(prompt_id // 4 AS BIGINT) AS step FROM pairs"""
    sql["i1_rewrite_step"] = f"""WITH {_PAIRS}
SELECT CAST(prompt_id AS VARCHAR) AS prompt, CASE WHEN prompt_id // 4 < 2 THEN rejected ELSE chosen END AS chosen,
       CASE WHEN prompt_id // 4 < 2 THEN chosen ELSE rejected END AS rejected, CAST(prompt_id // 4 AS BIGINT) AS step FROM pairs"""
    sql["i2_write_metrics"] = sql["f6_batch_metrics"]
    return sql
