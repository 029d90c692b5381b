"""SQL counterparts of the named queries, for an engine with RE2 patterns and list functions.

RE2 has no look-around and its word boundary is ASCII, so boundaries are spelled out.
"""

from __future__ import annotations

from twinline.functions import rules as R
from twinline.functions.text import SPACE, WHITESPACE
from twinline.operators import bleu, split, subword
from twinline.plans import queries as named
from twinline.plans import views as V


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_NON_WORD = r"[^\p{L}\p{N}_]"
_START, _END = rf"(?:\A|{_NON_WORD})", rf"(?:{_NON_WORD}|\z)"


def _strip(c: str) -> str:
    return f"trim({c}, {_text(WHITESPACE)})"


def _filled(c: str) -> str:
    return f"coalesce({_strip(c)} <> '', false)"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[{SPACE}]+'), lambda w: w <> '')"


def _count(c: str) -> str:
    return f"len({_words(c)})"


def _fold(c: str) -> str:
    # Exact for the given tables, whose letters are Latin-1 in composed form.
    return f"replace(lower(nfc_normalize({c})), 'ß', 'ss')"


def _joined(c: str) -> str:
    return f"array_to_string({c}, ' ')"


def _quoted(c: str) -> str:
    return f"""'"' || replace({c}, '"', '""') || '"'"""


_LINE = "strpos(text, chr(10))"
_PAIRS = f"""pairs AS (
  SELECT u.conv_id * (SELECT max(turn) + 1 FROM conversations) + u.turn AS id, u.text AS dialect, a.text AS english
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
_CHAT = f"""chat AS (
  SELECT id AS ord, {_strip('dialect')} AS src, {_strip('english')} AS tgt FROM pairs
  WHERE {_filled('dialect')} AND {_filled('english')})"""
_RAW = f"""raw_docs AS (
  SELECT doc_id AS ord, lang AS category, source,
    CASE WHEN {_LINE} > 0 THEN substr(text, 1, {_LINE} - 1) ELSE '' END AS src,
    CASE WHEN {_LINE} > 0 THEN substr(text, {_LINE} + 1) ELSE '' END AS tgt
  FROM documents)"""
_DOCS = f"""{_RAW}, docs AS (
  SELECT ord, category, source, {_strip('src')} AS src, {_strip('tgt')} AS tgt FROM raw_docs
  WHERE {_filled('src')} AND {_filled('tgt')})"""
_CATS = f"{_DOCS}, cats AS (SELECT category || '/' || source AS category, ord, src, tgt FROM docs)"
_LOG = f"""log AS (
  SELECT event_type AS run, date_diff('day', DATE '{V.FIRST_DAY}', CAST(ts AS DATE)) + 1 AS epoch,
    event_id AS step, event_id // 16 AS batch, value AS loss FROM events)"""

_MIXED = (
    f"len(list_filter(string_split_regex({{c}}, '{_NON_WORD}+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+')"
    f" AND regexp_matches(w, '[{R.DIGITS}]') AND regexp_matches(w, '[A-Za-z]'))) > 0"
)
_EMOJI = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in R.EMOJI)


def _match(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_text(pattern)})"


def _mixed(c: str) -> str:
    return _MIXED.replace("{c}", c)


def _url(c: str) -> str:
    return _match(c, rf"(?i)https?://|www\.|\.(?:com|net|org){_END}")


def _symbol(c: str) -> str:
    return _match(c, "[@#]")


def _http(c: str) -> str:
    return _match(c, f"(?i){_START}http{_END}")


def _emoji(c: str) -> str:
    return _match(c, f"[{_EMOJI}]")


def _noise(c: str) -> str:
    return f"({_symbol(c)} OR {_url(c)} OR {_http(c)} OR {_emoji(c)})"


def _marker(c: str, terms=R.MARKERS) -> str:
    choices = "|".join(f"[{SPACE}]*".join(term) for term in terms)
    return _match(c, f"(?i){_START}(?:{choices}){_END}")


_RULE = f"""CASE WHEN {_count('src')} < 3 OR {_count('tgt')} < 3 THEN 1 WHEN {_mixed('tgt')} THEN 2
  WHEN {_noise('src')} OR {_noise('tgt')} THEN 3 WHEN {_marker('src')} OR {_marker('tgt')} THEN 4 ELSE 0 END"""
_FIRST = f"""{_DOCS}, firsts AS (
  SELECT *, count(*) OVER (PARTITION BY lower(src), lower(tgt)) AS n_copies FROM docs
  QUALIFY row_number() OVER (PARTITION BY lower(src), lower(tgt) ORDER BY ord) = 1)"""

_STACK = """(SELECT ord, 'src' AS side, src AS text FROM {t} UNION ALL
  SELECT ord, 'tgt', tgt FROM {t})"""

_HEADS = f"""{_CATS}, heads AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS position,
    count(*) OVER (PARTITION BY category) AS n FROM cats),
splits AS (
  SELECT CASE WHEN position <= 8 THEN 'train' WHEN position = 9 THEN 'val' ELSE 'test' END AS split,
    category, CAST(position AS INTEGER) AS position, ord, src, tgt
  FROM heads WHERE position <= {split.SPLIT_SIZE} AND n >= {split.SPLIT_SIZE})"""

_SOURCES = f"""{_PAIRS}, {_CHAT}, {_DOCS}, sources AS (
  SELECT 'field' AS source, ord, src, tgt FROM chat UNION ALL
  SELECT 'base', ord, src, tgt FROM docs)"""
_COPIES = f"""mixed AS (
  SELECT s.source, s.ord, s.src, s.tgt, CAST(c.copy AS INTEGER) AS copy
  FROM sources s JOIN (SELECT unnest(range(1, {max(named.WEIGHTS.values()) + 1})) AS copy) c
    ON c.copy <= CASE s.source WHEN 'field' THEN {named.WEIGHTS['field']} ELSE {named.WEIGHTS['base']} END)"""
_KEYS = f"""keyed AS (
  SELECT *, md5('{named.SEED}|' || source || '|' || ord || '|' || copy) AS shuffle_key FROM mixed)"""
_MIX = f"{_SOURCES}, {_COPIES}"
_KEYED = f"{_MIX}, {_KEYS}"
# The feed: the train split, and the clean pairs that are not held out.
_FEED_KEYED = f"""{_HEADS}, {_FIRST.removeprefix(_DOCS + ', ')}, sources AS (
  SELECT 'field' AS source, ord, src, tgt FROM splits WHERE split = 'train' UNION ALL
  SELECT 'base', ord, src, tgt FROM firsts WHERE {_RULE} = 0
    AND (lower(src), lower(tgt)) NOT IN (SELECT (lower(src), lower(tgt)) FROM splits WHERE split <> 'train')),
{_COPIES}, {_KEYS}"""


def _batches(size: int, keyed: str = _KEYED) -> str:
    return f"""{keyed}, indexed AS (
  SELECT *, row_number() OVER (ORDER BY shuffle_key, source, ord, copy) - 1 AS i,
    count(*) OVER () // {size} AS n_full FROM keyed),
batched AS (
  SELECT source, ord, copy, i // {size} AS batch_id, CAST(i % {size} AS INTEGER) AS pos
  FROM indexed WHERE i // {size} < n_full)"""


_FRAMED = """framed AS (
  SELECT source, ord, side, list_concat(b, list_transform(range(0, 32 - len(b)), lambda x: 0)) AS p FROM (
    SELECT source, ord, side, list_concat([2], ids[1:30], [3]) AS b FROM sides))"""

#: The vocabulary that the recursion is fit for; the tests run the queries with it.
SMALL_VOCAB = 128

# Merge learning as recursion: each step counts adjacent pairs and joins the top one.
_O, _C, _U = "\x01", "\x02", "\x03"
_PROTECTED = ", ".join(map(_text, subword.PROTECTED))
_ALL_WORDS = f"""{_DOCS}, raw_words AS (
  SELECT unnest(string_split_regex(text, '[ \\t\\n\\f\\r]+')) AS raw FROM {_STACK.format(t='docs')})"""
_FREQ = f"""{_ALL_WORDS}, {_FIRST.removeprefix(_DOCS + ', ')}, cleaned AS (SELECT ord, src, tgt FROM firsts WHERE {_RULE} = 0),
clean_words AS (
  SELECT unnest(string_split_regex(text, '[ \\t\\n\\f\\r]+')) AS raw FROM {_STACK.format(t='cleaned')}),
words AS (
  SELECT {_fold('raw')} AS word, count(*) AS freq FROM clean_words WHERE raw <> '' GROUP BY 1)"""
_CHARS = f"""{_FREQ}, char_freq AS (
  SELECT char, CAST(sum(freq) AS BIGINT) AS freq FROM (
    SELECT unnest(string_split('{subword.WORD_MARK}' || word, '')) AS char, freq FROM words) GROUP BY 1),
chars AS (
  SELECT char, freq, CAST(row_number() OVER (ORDER BY freq DESC, char) AS INTEGER) AS char_rank,
    coalesce(sum(freq) OVER (ORDER BY freq DESC, char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      < {subword.COVERAGE} * sum(freq) OVER () AS kept
  FROM char_freq)"""
# Words to segment: those learned from, at their counts; others may be added at count 0.
_LEARN_WORDS = f"""to_segment AS (SELECT word, freq FROM words UNION ALL
  SELECT DISTINCT {_fold('raw')}, 0 FROM raw_words WHERE raw <> '' AND {_fold('raw')} NOT IN (SELECT word FROM words))"""
_SEGMENTS = f"""{_CHARS}, {_LEARN_WORDS}, alphabet AS (
  SELECT char FROM chars WHERE kept UNION SELECT unnest([{_PROTECTED}, '{subword.WORD_MARK}'])),
start AS (
  SELECT word, array_to_string(list_transform(string_split('{subword.WORD_MARK}' || word, ''),
      lambda c: '{_O}' || CASE WHEN list_contains(known, c) THEN c ELSE '{_U}' END || '{_C}'), '') AS seg,
    freq FROM to_segment, (SELECT list(char) AS known FROM alphabet))"""
_FREE = f"l NOT IN ({_PROTECTED}, '{_U}') AND r NOT IN ({_PROTECTED}, '{_U}')"


def _pair_counts(table: str) -> str:
    return f"""(SELECT l, r, CAST(sum(freq) AS BIGINT) AS f FROM (
    SELECT p[1] AS l, p[2] AS r, freq FROM (
      SELECT unnest(list_zip(s[:-2], s[2:])) AS p, freq FROM (
        SELECT string_split(seg[2:-2], '{_C}{_O}') AS s, freq FROM {table}) WHERE len(s) > 1))
  WHERE {_FREE} GROUP BY l, r HAVING sum(freq) > 0)"""


_SEEDS = len(subword.SPECIALS) + len(subword.PROTECTED)
_SLACK = 8  # extra steps for merges that repeat a piece
_LEARNED = f"""{_SEGMENTS}, room AS (
  SELECT {SMALL_VOCAB - _SEEDS} - count(*) AS n FROM chars WHERE kept AND char NOT IN ({_PROTECTED})),
steps(step, word, seg, freq, l, r, f) AS (
  SELECT 0, word, seg, freq, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT FROM start
  UNION ALL
  SELECT s.step + 1, s.word,
    replace(s.seg, '{_O}' || b.l || '{_C}{_O}' || b.r || '{_C}', '{_O}' || b.l || b.r || '{_C}'),
    s.freq, b.l, b.r, b.f
  FROM steps s, (SELECT * FROM {_pair_counts('steps')} ORDER BY f DESC, l, r LIMIT 1) b
  WHERE s.step < (SELECT n FROM room) + {_SLACK}),
ranked AS (SELECT DISTINCT step, l, r, f FROM steps WHERE step > 0),
pieces AS (
  SELECT l || r AS piece, min(step) AS step FROM ranked
  WHERE l || r NOT IN (SELECT char FROM alphabet) GROUP BY 1
  ORDER BY 2 LIMIT (SELECT n FROM room)),
merges AS (SELECT * FROM ranked WHERE step <= (SELECT max(step) FROM pieces)),
vocab AS (
  SELECT CAST(i AS INTEGER) AS id, piece, 'special' AS kind
  FROM (VALUES {', '.join(f"({i}, {_text(p)})" for i, p in subword.SPECIALS)}) t(i, piece)
  UNION ALL SELECT CAST({len(subword.SPECIALS)} + i - 1 AS INTEGER), piece, 'protected'
  FROM (SELECT unnest([{_PROTECTED}]) AS piece, unnest(range(1, {len(subword.PROTECTED) + 1})) AS i)
  UNION ALL SELECT CAST({_SEEDS} + row_number() OVER (ORDER BY char_rank) - 1 AS INTEGER), char, 'char'
  FROM chars WHERE kept AND char NOT IN ({_PROTECTED})
  UNION ALL SELECT CAST({SMALL_VOCAB} - (SELECT n FROM room) + row_number() OVER (ORDER BY step) - 1 AS INTEGER), piece, 'merge'
  FROM pieces)"""


def _encoded(table: str) -> str:
    """Ids of both sides: the segmentation after the last merge, runs of unknowns as one."""
    return f"""{_LEARNED}, ids AS (
  SELECT w.word, list(coalesce(v.id, 1) ORDER BY w.i) AS ids FROM (
    SELECT word, i, sym FROM (
      SELECT word, unnest(string_split(seg[2:-2], '{_C}{_O}')) AS sym,
        unnest(range(1, len(string_split(seg[2:-2], '{_C}{_O}')) + 1)) AS i
      FROM steps WHERE step = (SELECT max(step) FROM merges))
    QUALIFY sym <> '{_U}' OR coalesce(lag(sym) OVER (PARTITION BY word ORDER BY i), '') <> '{_U}') w
  LEFT JOIN vocab v ON v.piece = w.sym AND v.kind <> 'special' GROUP BY 1),
tokens AS (
  SELECT source, ord, side, unnest(ws) AS raw, unnest(range(1, len(ws) + 1)) AS i FROM (
    SELECT source, ord, side, list_filter(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda w: w <> '') AS ws
    FROM (SELECT source, ord, 'src' AS side, src AS text FROM {table} UNION ALL
          SELECT source, ord, 'tgt', tgt FROM {table}))),
sides AS (
  SELECT source, ord, side, flatten(list(ids ORDER BY i)) AS ids FROM (
    SELECT t.source, t.ord, t.side, t.i, d.ids FROM tokens t JOIN ids d ON d.word = {_fold('t.raw')}) GROUP BY 1, 2, 3),
encoded AS (
  SELECT s.source, s.ord, s.ids AS src_ids, t.ids AS tgt_ids FROM sides s
  JOIN sides t ON t.source = s.source AND t.ord = s.ord WHERE s.side = 'src' AND t.side = 'tgt')"""


_PIECES = "list_transform({c}, lambda i: listed[i + 1])"
_LISTED = "(SELECT list(piece ORDER BY id) AS listed FROM vocab)"


def _tokens_13a(c: str) -> str:
    for found, put in bleu.LITERALS_13A:
        c = f"replace({c}, {_text(found)}, {_text(put)})"
    c = f"' ' || {c} || ' '"
    for pattern, put in bleu.PATTERNS_13A:
        c = f"regexp_replace({c}, {_text(pattern)}, {_text(put.replace('$', chr(92)))}, 'g')"
    return _words(c)


_SEGS = """segs AS (
  SELECT doc_id AS seg_id, lang AS category, string_split(text, chr(10))[1] AS src, text AS reference,
    array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % (doc_id % 5 + 3) <> 0), ' ') AS hypothesis
  FROM documents)"""
_COUNTS = f"""toks AS (
  SELECT seg_id, 1 AS in_hyp, {_tokens_13a('hypothesis')} AS t FROM segs UNION ALL
  SELECT seg_id, 0, {_tokens_13a('reference')} FROM segs),
listed AS (SELECT seg_id, in_hyp, unnest(t) AS t1, unnest(range(1, len(t) + 1)) AS i FROM toks),
ahead AS (
  SELECT *, lead(t1, 1) OVER w AS t2, lead(t1, 2) OVER w AS t3, lead(t1, 3) OVER w AS t4
  FROM listed WINDOW w AS (PARTITION BY seg_id, in_hyp ORDER BY i)),
grams AS (
  SELECT seg_id, CAST(n AS INTEGER) AS n, gram, CAST(sum(in_hyp) AS BIGINT) AS hyp_count,
    CAST(sum(1 - in_hyp) AS BIGINT) AS ref_count
  FROM (SELECT seg_id, in_hyp, 1 AS n, t1 AS gram FROM ahead UNION ALL
    SELECT seg_id, in_hyp, 2, t1 || ' ' || t2 FROM ahead WHERE t2 IS NOT NULL UNION ALL
    SELECT seg_id, in_hyp, 3, t1 || ' ' || t2 || ' ' || t3 FROM ahead WHERE t3 IS NOT NULL UNION ALL
    SELECT seg_id, in_hyp, 4, t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 FROM ahead WHERE t4 IS NOT NULL)
  GROUP BY 1, 2, 3)"""
_GRAMS = f"""{_SEGS}, {_COUNTS},
clipped AS (
  SELECT n, CAST(sum(least(hyp_count, ref_count)) AS BIGINT) AS matches,
    CAST(sum(hyp_count) AS BIGINT) AS hyp_total, CAST(sum(ref_count) AS BIGINT) AS ref_total FROM grams GROUP BY 1)"""


def _rule(test: str) -> str:
    return f"SELECT doc_id, {test} AS hit FROM documents"


LEARNED = (
    "pack_sequences", "shift_targets", "padding_mask", "learn_bpe", "bpe_vocab", "vocab_report", "encode_pairs", "unk_rate",
    "decode_pieces", "shared_pieces", "finetune_feed", "write_feed", "validation_feed",
)


def _all_sql() -> dict[str, str]:
    raw_stack, doc_stack = _STACK.format(t="raw_docs"), _STACK.format(t="docs")
    feed = f"""WITH RECURSIVE {_batches(named.VAL_BATCH, _FEED_KEYED)},
        {_encoded('sources').removeprefix(_DOCS + ', ').replace(_FIRST.removeprefix(_DOCS + ', ') + ', ', '')}, {_FRAMED}
        SELECT b.batch_id, b.pos, b.source, b.ord, b.copy, {_joined('s.p')} AS src_ids, {_joined('t.p')} AS tgt_ids
        FROM batched b JOIN framed s ON s.source = b.source AND s.ord = b.ord AND s.side = 'src'
        JOIN framed t ON t.source = b.source AND t.ord = b.ord AND t.side = 'tgt'"""
    sql = {
        "scan_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
        "write_clean": f"WITH {_FIRST} SELECT src, tgt FROM firsts",
        "read_pairs_csv": f"WITH {_DOCS} SELECT src, tgt FROM docs",
        "quarantine_rows": f"""WITH {_DOCS} SELECT CASE WHEN bad THEN 'bad' ELSE 'good' END AS outcome, category,
            CASE WHEN NOT bad THEN src END AS src, CASE WHEN NOT bad THEN tgt END AS tgt,
            CASE WHEN ord % 7 = 0 THEN {_quoted('category')} || ',' || {_quoted('src')}
              WHEN bad THEN {_quoted('category')} || ',' || {_quoted('src')} || ',' || {_quoted('tgt')} || ',surplus' END AS raw
            FROM (SELECT *, ord % 7 = 0 OR ord % 5 = 0 AS bad FROM docs)""",
        "write_splits": f"WITH {_HEADS} SELECT split, category, src, tgt FROM splits",
        "write_corpus": f"""WITH {_DOCS} SELECT line, count(*) AS n_lines FROM (
            SELECT unnest(string_split(text, chr(10))) AS line FROM {doc_stack}) GROUP BY 1""",
        "sink_report": f"""WITH {_FIRST} SELECT count(*) AS n_rows, CAST(sum(strlen({_quoted('src')})
            + strlen({_quoted('tgt')}) + 2) AS BIGINT) AS body_bytes FROM firsts""",
        "normalize_pairs": f"""WITH {_PAIRS}
            SELECT id AS ord, {_strip('dialect')} AS src, {_strip('english')} AS tgt FROM pairs""",
        "nonempty_pairs": f"WITH {_RAW} SELECT ord, src, tgt FROM raw_docs WHERE {_filled('src')} AND {_filled('tgt')}",
        "word_counts": f"""WITH {_DOCS} SELECT ord, CAST({_count('src')} AS INTEGER) AS src_words,
            CAST({_count('tgt')} AS INTEGER) AS tgt_words FROM docs""",
        "pack_sequences": f"""WITH RECURSIVE {_encoded('docs')}, {_FRAMED}
            SELECT ord, side, {_joined('p')} AS packed, CAST(len(p) AS INTEGER) AS size FROM framed""",
        "shift_targets": f"""WITH RECURSIVE {_encoded('docs')}, {_FRAMED} SELECT ord, {_joined('p[1:31]')} AS decoder_input,
            {_joined('p[2:32]')} AS decoder_target FROM framed WHERE side = 'tgt'""",
        "padding_mask": f"""WITH RECURSIVE {_encoded('docs')}, {_FRAMED} SELECT ord, side,
            {_joined('list_transform(p, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END)')} AS mask FROM framed""",
        "nfkc_fold": f"""WITH {_ALL_WORDS} SELECT DISTINCT raw, {_fold('raw')} AS folded FROM raw_words WHERE raw <> ''""",
        "rule_min_words": _rule(f"{_count('text')} >= 3"),
        "rule_mixed_digits": _rule(_mixed("text")),
        "rule_url": _rule(_url("text")),
        "rule_at_hash": _rule(_symbol("text")),
        "rule_http": _rule(_http("text")),
        "rule_emoji": _rule(_emoji("text")),
        "rule_noise": _rule(_noise("text")),
        "rule_markers": _rule(_marker("text", named.MARKERS)),
        "dedup_pairs": f"WITH {_FIRST} SELECT ord, src, tgt, n_copies FROM firsts",
        "clean_pairs": f"WITH {_FIRST} SELECT ord, src, tgt FROM firsts WHERE {_RULE} = 0",
        "cleaning_funnel": _funnel(),
        "profile_pairs": f"""WITH {_RAW} SELECT count(*) AS n_pairs, count(*) FILTER (NOT {_filled('src')}) AS empty_src,
            count(*) FILTER (NOT {_filled('tgt')}) AS empty_tgt,
            count(*) FILTER (NOT {_filled('src')} OR NOT {_filled('tgt')}) AS empty_either,
            'ord,src,tgt' AS columns FROM raw_docs""",
        "sample_pairs": f"WITH {_DOCS} SELECT ord, src, tgt FROM docs ORDER BY ord LIMIT 5",
        "stack_sides": f"WITH {_RAW} SELECT * FROM {raw_stack} WHERE {_filled('text')}",
        "corpus_sides": f"WITH {_RAW} SELECT side, count(*) AS n_sentences FROM {raw_stack} WHERE {_filled('text')} GROUP BY 1",
        "length_profile": f"""WITH {_DOCS} SELECT side, count(*) AS n_sentences, quantile_cont(n, 0.5) AS p50,
            quantile_cont(n, 0.99) AS p99, max(n) AS longest, round(avg(CASE WHEN n > 30 THEN 1 ELSE 0 END), 6) AS cut_share
            FROM (SELECT side, CAST({_count('text')} AS INTEGER) AS n FROM {doc_stack}) GROUP BY 1""",
        "word_vocab_size": f"""WITH {_DOCS} SELECT side, count(DISTINCT word) AS n_words
            FROM (SELECT side, unnest({_words('text')}) AS word FROM {doc_stack}) GROUP BY 1""",
        "stratified_split": f"WITH {_HEADS} SELECT * FROM splits",
        "skipped_categories": f"""WITH {_CATS} SELECT category, count(*) AS n_pairs FROM cats GROUP BY 1
            HAVING count(*) < {split.SPLIT_SIZE}""",
        "category_report": f"""WITH {_CATS} SELECT category, count(*) AS n_pairs, count(*) < 10 AS skipped,
            CASE WHEN count(*) < 10 THEN count(*) ELSE count(*) - 10 END AS n_unused FROM cats GROUP BY 1""",
        "split_report": f"""WITH {_HEADS} SELECT split, count(*) AS n_pairs,
            count(DISTINCT category) AS n_categories FROM splits GROUP BY 1""",
        "split_leakage": f"""WITH {_HEADS}, test AS (SELECT * FROM splits WHERE split = 'test'),
            train AS (SELECT lower(src) AS s, lower(tgt) AS t FROM splits WHERE split = 'train')
            SELECT 'test' AS check, count(*) AS n_rows FROM test UNION ALL
            SELECT 'in_train_by_src', count(*) FROM test WHERE lower(src) IN (SELECT s FROM train) UNION ALL
            SELECT 'in_train_by_pair', count(*) FROM test WHERE (lower(src), lower(tgt)) IN (SELECT (s, t) FROM train)""",
        "weighted_mix": f"WITH {_MIX} SELECT source, ord, src, tgt, copy FROM mixed",
        "mix_report": f"""WITH {_SOURCES}, counted AS (SELECT source, count(*) AS n_pairs,
              CASE source WHEN 'field' THEN {named.WEIGHTS['field']} ELSE {named.WEIGHTS['base']} END AS weight
              FROM sources GROUP BY 1)
            SELECT source, n_pairs, weight, n_pairs * weight AS n_samples FROM counted UNION ALL
            SELECT '(total)', CAST(sum(n_pairs) AS BIGINT), NULL, CAST(sum(n_pairs * weight) AS BIGINT) FROM counted""",
        "shuffled_mix": f"WITH {_KEYED} SELECT source, ord, copy, shuffle_key FROM keyed ORDER BY shuffle_key",
        "batch_assign": f"WITH {_batches(named.TRAIN_BATCH)} SELECT source, ord, copy, batch_id, pos FROM batched",
        "batch_assign_ordered": f"""WITH {_DOCS} SELECT ord, i // {named.VAL_BATCH} AS batch_id,
            CAST(i % {named.VAL_BATCH} AS INTEGER) AS pos
            FROM (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS i FROM docs)""",
        "word_freq": f"WITH {_FREQ} SELECT word, freq FROM words",
        "char_coverage": f"WITH {_CHARS} SELECT char, freq, char_rank, kept FROM chars",
        "bpe_pair_counts": f'WITH {_SEGMENTS} SELECT l AS "left", r AS "right", f AS freq FROM {_pair_counts("start")}',
        "learn_bpe": f"""WITH RECURSIVE {_LEARNED} SELECT CAST(step - 1 AS INTEGER) AS rank, l AS "left",
            r AS "right", f AS freq FROM merges""",
        "bpe_vocab": f"WITH RECURSIVE {_LEARNED} SELECT id, piece, kind FROM vocab",
        "vocab_report": f"""WITH RECURSIVE {_LEARNED} SELECT count(*) AS n_pieces,
            count(*) FILTER (kind = 'protected' AND id > 3) AS n_protected,
            (SELECT count(*) FROM words) AS n_words, (SELECT count(*) FROM words) - count(*) AS reduction FROM vocab""",
        "encode_pairs": f"""WITH RECURSIVE {_encoded('docs')} SELECT ord, {_joined('src_ids')} AS src_ids,
            {_joined('tgt_ids')} AS tgt_ids FROM encoded""",
        "unk_rate": f"""WITH RECURSIVE {_encoded('docs')} SELECT side,
            CAST(sum(len(list_filter(ids, lambda i: i = 1))) AS BIGINT) AS n_unk,
            CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM sides GROUP BY 1""",
        "decode_pieces": f"""WITH RECURSIVE {_encoded('docs')}
            SELECT ord, {_joined(_PIECES.replace('{c}', 'src_ids'))} AS src_pieces,
            {_joined(_PIECES.replace('{c}', 'tgt_ids'))} AS tgt_pieces FROM encoded, {_LISTED}""",
        # Decoding gives the folded text back, whatever was merged: only characters outside the vocabulary are lost.
        "decode_text": f"""WITH {_CHARS}, known AS (SELECT list(char) AS known FROM (
              SELECT char FROM chars WHERE kept UNION SELECT unnest([{_PROTECTED}]))),
            shown AS (SELECT raw, regexp_replace(array_to_string(list_transform(string_split('{subword.WORD_MARK}' || {_fold('raw')}, ''),
                lambda c: CASE WHEN list_contains(known, c) THEN c ELSE '{_U}' END), ''), '{_U}+', {_text(subword.UNKNOWN_TEXT)}, 'g') AS t
              FROM (SELECT DISTINCT raw FROM raw_words WHERE raw <> ''), known),
            tokens AS (SELECT ord, side, unnest(ws) AS raw, unnest(range(1, len(ws) + 1)) AS i FROM (
              SELECT ord, side, list_filter(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda w: w <> '') AS ws FROM {doc_stack})),
            sides AS (SELECT ord, side, regexp_replace(replace(string_agg(t, '' ORDER BY i), '{subword.WORD_MARK}', ' '), '^ ', '') AS t
              FROM tokens JOIN shown USING (raw) GROUP BY 1, 2)
            SELECT s.ord, s.t AS src_text, t.t AS tgt_text FROM sides s JOIN sides t ON t.ord = s.ord AND t.side = 'tgt' WHERE s.side = 'src'""",
        "shared_pieces": f"""WITH RECURSIVE {_encoded('docs')}, both_sides AS (
            SELECT ord, list_sort(list_distinct(list_intersect(src_ids, tgt_ids))) AS ids FROM encoded)
            SELECT ord, {_joined('ids')} AS shared_ids, {_joined(_PIECES.replace('{c}', 'ids'))} AS shared FROM both_sides, {_LISTED}""",
        "epoch_loss": f"""WITH {_LOG} SELECT run, CAST(epoch AS INTEGER) AS epoch, round(avg(loss), 6) AS avg_loss,
            count(*) AS n_batches FROM log GROUP BY 1, 2""",
        "val_loss": f"""WITH {_LOG}, b AS (SELECT run, epoch, batch, avg(loss) AS loss FROM log GROUP BY ALL)
            SELECT run, CAST(epoch AS INTEGER) AS epoch, round(avg(loss), 6) AS avg_val_loss, count(*) AS n_batches
            FROM b GROUP BY 1, 2""",
        "running_loss": f"""WITH {_LOG} SELECT run, CAST(epoch AS INTEGER) AS epoch, step, loss,
            round(running, 6) AS running_avg FROM (SELECT *, avg(loss) OVER (PARTITION BY run, epoch ORDER BY step
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM log)
            WHERE step % {named.REPORT_EVERY} = 0""",
        "best_checkpoint": f"""WITH {_LOG}, e AS (
              SELECT run, epoch, round(round(avg(loss), 6)) AS loss FROM log GROUP BY 1, 2),
            b AS (SELECT run, epoch, batch, avg(loss) AS loss FROM log GROUP BY ALL),
            v AS (SELECT run, epoch, round(round(avg(loss), 6)) AS loss FROM b GROUP BY 1, 2),
            first AS (SELECT run, CAST(min(epoch) AS INTEGER) AS first_epoch, loss AS best_loss FROM e
              WHERE (run, loss) IN (SELECT (run, min(loss)) FROM e GROUP BY run) GROUP BY run, loss),
            last AS (SELECT run, CAST(max(epoch) AS INTEGER) AS last_epoch, loss AS best_val_loss FROM v
              WHERE (run, loss) IN (SELECT (run, min(loss)) FROM v GROUP BY run) GROUP BY run, loss)
            SELECT run, first_epoch, best_loss, last_epoch, best_val_loss FROM first JOIN last USING (run)""",
        "latest_checkpoint": f"""WITH {_LOG} SELECT run, CAST(max(epoch) AS INTEGER) AS resume_epoch FROM log
            WHERE epoch BETWEEN 1 AND 20 GROUP BY 1""",
        "provenance_rollup": f"""WITH {_DOCS} SELECT category, source, CAST(GROUPING(category, source) AS INTEGER) AS level,
            count(*) AS n_pairs FROM docs GROUP BY ROLLUP (category, source)""",
        "consent_filter": f"""WITH {_DOCS} SELECT source AS session_id, ord, category, src, tgt FROM docs
            WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY 1
              HAVING avg(toxic) > {V.WITHHELD_ABOVE})""",
        "finetune_feed": feed,
        "write_feed": feed,
        "validation_feed": f"""WITH RECURSIVE {_HEADS}, val AS (
              SELECT *, 'val' AS source, row_number() OVER (ORDER BY ord) - 1 AS i FROM splits WHERE split = 'val'),
            {_encoded('val').removeprefix(_DOCS + ', ')}, {_FRAMED}
            SELECT v.i // {named.VAL_BATCH} AS batch_id, CAST(v.i % {named.VAL_BATCH} AS INTEGER) AS pos, v.ord,
              {_joined('s.p')} AS src_ids, {_joined('t.p')} AS tgt_ids
            FROM val v JOIN framed s ON s.ord = v.ord AND s.side = 'src'
            JOIN framed t ON t.ord = v.ord AND t.side = 'tgt'""",
        "bleu_tokenize": f"SELECT doc_id, {_joined(_tokens_13a('text'))} AS tokens FROM documents",
        "ngram_counts": f"""WITH {_SEGS}, {_COUNTS} SELECT seg_id, n, count(*) AS n_grams,
            CAST(sum(hyp_count) AS BIGINT) AS hyp_count, CAST(sum(ref_count) AS BIGINT) AS ref_count,
            max(ref_count) AS most FROM grams GROUP BY 1, 2""",
        "clipped_matches": f"WITH {_GRAMS} SELECT * FROM clipped",
        "bleu_corpus": _bleu(),
        "eval_table": f"WITH {_SEGS} SELECT seg_id, category, src, reference, hypothesis FROM segs ORDER BY seg_id",
        "quarantine_report": f"""WITH {_DOCS}, n AS (SELECT count(*) FILTER (ord % 7 = 0) AS few,
              count(*) FILTER (ord % 7 <> 0 AND ord % 5 = 0) AS many, count(*) AS n FROM docs)
            SELECT 'well formed' AS reason, n - few - many AS n_rows FROM n UNION ALL SELECT 'empty', 0 UNION ALL
            SELECT 'too many fields', many FROM n UNION ALL SELECT 'too few fields', few FROM n""",
        "field_log": f"""SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS session, source, lang AS category, consent,
            CAST(count(*) AS INTEGER) AS n_pairs FROM documents LEFT JOIN (
              SELECT source, avg(toxic) <= {V.WITHHELD_ABOVE} AS consent FROM documents JOIN labels USING (doc_id) GROUP BY 1)
            USING (source) GROUP BY ALL""",
        "clean_stream": f"WITH {_DOCS} SELECT ord, src, tgt FROM docs WHERE {_RULE} = 0",
        "sketched_sentences": f"WITH {_DOCS} SELECT side, CAST(count(*) AS BIGINT) AS n_sentences FROM {doc_stack} GROUP BY 1",
        "term_hits": _term_hits(),
        "leak_report": f"""WITH {_FEED_KEYED}, held AS (SELECT split, ord, lower(src) AS s, lower(tgt) AS t FROM splits WHERE split <> 'train'),
            corpora AS (SELECT 'train' AS corpus, lower(src) AS s, lower(tgt) AS t FROM splits WHERE split = 'train' UNION ALL
              SELECT 'feed', lower(src), lower(tgt) FROM sources),
            checks AS (SELECT * FROM (VALUES ('train'), ('feed')) c(corpus), held)
            SELECT corpus, split, 'src' AS by, count(*) AS n_held_out,
              count(*) FILTER ((corpus, s) IN (SELECT (corpus, s) FROM corpora)) AS n_found FROM checks GROUP BY ALL UNION ALL
            SELECT corpus, split, 'pair', count(*),
              count(*) FILTER ((corpus, s, t) IN (SELECT (corpus, s, t) FROM corpora)) FROM checks GROUP BY ALL""",
        "feed_report": f"""WITH {_FEED_KEYED}, n AS (SELECT (SELECT count(*) FROM mixed) AS n_samples,
              (SELECT count(*) FROM splits WHERE split = 'val') AS n_val_samples)
            SELECT *, n_samples // {named.VAL_BATCH} AS steps_per_epoch, n_samples // {named.VAL_BATCH} * {named.EPOCHS} AS total_steps,
              CAST({named.VAL_BATCH * named.ACCUMULATE} AS BIGINT) AS effective_batch FROM n""",
    }
    return sql


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL over the given tables. Queries of the learned vocabulary have none: their recursion ends for small ones only."""
    return {k: v for k, v in _all_sql().items() if k not in LEARNED}


def learned_sql() -> dict[str, str]:
    """SQL of the queries of the learned vocabulary, for one of ``SMALL_VOCAB`` pieces."""
    return {k: _all_sql()[k] for k in LEARNED}


def _term_hits() -> str:
    words = lambda c, keep: f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_{keep}]+'), lambda w: w <> '')"
    return f"""WITH b AS (SELECT {words('text', '')} AS w FROM benchmark),
      terms AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b)),
      segments AS (SELECT doc_id, {_words('s')} AS w FROM (SELECT doc_id, unnest({words('text', SPACE)}) AS s FROM documents)),
      paths AS (SELECT DISTINCT doc_id, unnest(w) AS p FROM segments UNION
        SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM segments)),
      spelt AS (SELECT a, b, a || ' ' || b AS p FROM terms UNION SELECT a, b, a || b FROM terms)
      SELECT doc_id, count(*) AS n_terms FROM (SELECT DISTINCT doc_id, a, b FROM paths JOIN spelt USING (p)) GROUP BY 1"""


def _funnel() -> str:
    names = ["duplicate", *R.RULE_NAMES.values()]
    steps = [f"SELECT 0 AS step, 'original' AS rule, 0 AS removed, original AS remaining FROM c"]
    for i, name in enumerate(names, 1):
        steps.append(f"SELECT {i}, '{name}', {name}, original - {' - '.join(names[:i])} FROM c")
    total = " + ".join(names)
    steps.append(f"SELECT {len(names) + 1}, 'total', {total}, original - ({total}) FROM c")
    counted = ", ".join(f"count(*) FILTER (rule = {k}) AS {n}" for k, n in R.RULE_NAMES.items())
    return f"""WITH {_FIRST}, c AS (
      SELECT CAST(sum(n_copies) AS BIGINT) AS original, CAST(sum(n_copies - 1) AS BIGINT) AS duplicate, {counted}
      FROM (SELECT n_copies, {_RULE} AS rule FROM firsts))
    SELECT step, rule, CAST(removed AS BIGINT) AS removed, round(100.0 * removed / original, 1) AS removed_pct,
      remaining, round(100.0 * remaining / original, 1) AS remaining_pct
    FROM ({' UNION ALL '.join(steps)}), (SELECT original FROM c)"""


def _bleu() -> str:
    bands = "".join(f" WHEN bleu >= {low} THEN '{name}'" for low, name in bleu.BANDS)
    return f"""WITH {_GRAMS}, ranked_orders AS (
      SELECT *, sum(CASE WHEN matches = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS zeros FROM clipped),
    sums AS (
      SELECT sum(ln(CASE WHEN matches = 0 THEN pow(2.0, -zeros) ELSE matches END / hyp_total)) AS logs,
        max(CASE WHEN n = 1 THEN hyp_total END) AS hyp_len, max(CASE WHEN n = 1 THEN ref_total END) AS ref_len
      FROM ranked_orders),
    scored AS (
      SELECT CASE WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len) ELSE 1.0 END AS bp, * FROM sums),
    final AS (SELECT round(100 * bp * exp(logs / 4), 6) AS bleu, round(bp, 6) AS brevity_penalty, hyp_len, ref_len FROM scored)
    SELECT bleu, brevity_penalty, hyp_len, ref_len, CASE{bands} END AS band FROM final"""
