"""The same results as SQL for DuckDB, one string per query. Written apart from the Spark code; only fixed values and
patterns are shared."""

from __future__ import annotations

from siftwell.functions import patterns as P
from siftwell.plans.inputs import PHONES
from siftwell.plans.queries import AND, NAMES, POOL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES: dict[str, str] = {}

DOCS = "docs AS (SELECT doc_id AS msg_id, source AS dataset, lang, text FROM documents)"
LAB = """lab AS (SELECT d.doc_id AS msg_id, d.source AS dataset, l.toxic AS label, d.text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn, role, text FROM conversations)"
LATIN, ACCENTED = P.SCRIPTS["latin"], P.SCRIPTS["accented"]
SPACES = q(P.SPACES)


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(P.WORD)})"


def hash_number(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def fold(key: str, k: int = 5, seed: int = 1) -> str:
    return f"({hash_number(f'{q(str(seed) + chr(124))} || {key}')} % {k})::INT"


def oracle(name: str, sql: str, *ctes: str) -> None:
    ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql.strip()


def oracle_r(name: str, sql: str, *ctes: str) -> None:
    ORACLES[name] = "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + sql.strip()


NL, BREAK, SUBJECT = "chr(10)", f" {P.NEWLINE}{P.END}  ", f" {P.SUBJECT}{P.END}  "
BLANKED = "replace(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), 'the ', 'the' || chr(10) || chr(10) || chr(10))"

HEAD = """'[' || (conv_id % 28 + 1) || '.' || (conv_id % 12 + 1) || '.2024, ' || (turn % 24) || ':' || (conv_id % 60) || ':'
  || (turn % 60) || '] ' || role || ': '"""
LINES = f"""ls AS (SELECT *, string_split(text, chr(10)) AS parts FROM turns),
lines AS (SELECT 'chat_' || conv_id || '.txt' AS path, turn AS block, role, {HEAD} AS head,
  unnest(range(len(parts)))::INT AS line_no, unnest(parts) AS line FROM ls)"""

# sources and sinks

oracle(
    "chat_export_messages",
    """SELECT 'chat_' || conv_id || '.txt' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_no,
  role AS sender, strftime(make_timestamp(2024, conv_id % 12 + 1, conv_id % 28 + 1, turn % 24, conv_id % 60,
  (turn % 60)::DOUBLE), '%Y-%m-%d %H:%M:%S') AS sent_at, text AS body FROM conversations""",
)
oracle(
    "mailbox_messages",
    f"""SELECT msg_id AS msg_no, replace(substr(text, 1, 20), chr(10), ' ') AS subject,
  replace(substr(text, 1, 20), chr(10), ' ') || {q(SUBJECT)} || text AS body FROM docs
  WHERE lang <> 'es' AND NOT (lang = 'fr' AND msg_id % 3 = 2 AND regexp_matches(text, '[^\x00-\x7f]'))""",
    DOCS,
)
oracle(
    "mailbox_rejects",
    """SELECT msg_id AS msg_no, CASE WHEN lang = 'es' THEN 'no plain text' ELSE 'UnicodeDecodeError' END AS error FROM docs
  WHERE lang = 'es' OR (lang = 'fr' AND msg_id % 3 = 2 AND regexp_matches(text, '[^\x00-\x7f]'))""",
    DOCS,
)
oracle(
    "labelled_lines",
    f"""SELECT msg_id, dataset, label, trim(replace(text, chr(10), ' '), {SPACES}) AS text FROM lab
  WHERE trim(replace(text, chr(10), ' '), {SPACES}) <> ''""",
    LAB,
)
TAGGED = f"""{TURNS}, ls AS (SELECT *, string_split(text, chr(10)) AS parts FROM turns),
sl AS (SELECT msg_id, role, unnest(range(len(parts)))::INT AS line_no, unnest(list_transform(parts, lambda s: {words("s")})) AS w FROM ls),
sn AS (SELECT *, (row_number() OVER (PARTITION BY msg_id ORDER BY line_no) - 1)::INT AS sent_no FROM sl WHERE len(w) > 0),
tg AS (SELECT msg_id, sent_no, unnest(range(1, len(w) + 1))::INT AS tok_no, unnest(w) AS word, role AS pos FROM sn),
toks AS (SELECT *, (tok_no // 2)::INT AS head, 'r' || (length(word) % 5) AS rel FROM tg)"""
oracle("tagged_tokens", "SELECT msg_id, sent_no, tok_no, word, pos, head, rel FROM toks", TAGGED)
oracle(
    "tagged_plain_text",
    f"""SELECT msg_id, array_to_string(list_filter(flatten(list_transform(string_split(text, chr(10)),
  lambda s, i: CASE WHEN i > 1 THEN list_concat(['.'], {words("s")}) ELSE {words("s")} END)), lambda w: w <> ''), ' ') AS text
  FROM turns""",
    TURNS,
)
MASKED_BREAKS = r"regexp_replace(regexp_replace({}, '\r?\n\z', ''), '\r?\n', " + q(BREAK) + ", 'g')"
oracle(
    "sentence_round_trip",
    f"""SELECT msg_id, len(string_split(m, {q(P.NEWLINE + P.END)}))::BIGINT AS n_sentences, m AS text
  FROM (SELECT msg_id, {MASKED_BREAKS.format("text")} AS m FROM docs)""",
    DOCS,
)
oracle("text_sink", f"SELECT dataset, label, trim(replace(text, chr(10), ' '), {SPACES}) AS text FROM lab", LAB)

# cleaning

oracle("chat_header_strip", "SELECT path, block, line_no, line FROM lines", TURNS, LINES)
oracle(
    "system_lines",
    """SELECT path, block, line_no, CASE WHEN line_no = 0 THEN head || line ELSE line END AS line FROM lines
  WHERE NOT (role = 'system' AND line_no = 0)""",
    TURNS,
    LINES,
)
ONCE = r"regexp_replace({}, '([^\n])\n\n([^\n])', '\1' || chr(1) || '\2', 'g')"
oracle(
    "blank_line_split",
    f"""SELECT msg_id, unnest(range(len(p)))::INT AS part_no, unnest(p) AS text FROM
  (SELECT msg_id, string_split({ONCE.format(ONCE.format(BLANKED))}, chr(1)) AS p FROM docs)""",
    DOCS,
)
oracle(
    "separator_rows",
    """SELECT msg_id, (len(t) - len(replace(t, chr(2), '')))::INT AS n_plus_rows, unnest(range(len(p)))::INT AS part_no,
  unnest(p) AS text FROM (SELECT msg_id, t, string_split(replace(t, chr(2), chr(1)), chr(1)) AS p FROM (
  SELECT msg_id, replace(replace(replace(text, '.' || chr(10), '.' || chr(1)), chr(10) || 'Th', chr(2) || 'Th'),
  chr(1) || 'Th', chr(1) || chr(2) || 'Th') AS t FROM docs))""",
    DOCS,
)
oracle(
    "blank_line_squeeze",
    f"""SELECT msg_id, replace(replace(replace(text, 'the ', 'the' || chr(1) || chr(1)), '.' || chr(10), '.' || chr(10)),
  chr(1), chr(10)) AS text FROM docs""",
    DOCS,
)
oracle("script_filter", f"SELECT msg_id, dataset FROM docs WHERE regexp_matches(text, '[{ACCENTED}]')", DOCS)
oracle(
    "tagger_rejects",
    """SELECT dataset, count(*) FILTER (lang = 'de') AS n_rejected, count(*) FILTER (lang <> 'de') AS n_kept FROM docs
  GROUP BY dataset""",
    DOCS,
)
oracle(
    "script_gate",
    f"""SELECT msg_id, CASE WHEN ok THEN len({words("text")}) ELSE 0 END::INT AS n_words,
  CASE WHEN ok THEN len(regexp_extract_all(text, '[0-9]')) ELSE 0 END::INT AS n_digits
  FROM (SELECT *, regexp_matches(text, '[{ACCENTED}]') AS ok FROM docs)""",
    DOCS,
)
oracle(
    "class_caps",
    """SELECT msg_id, dataset, label FROM lab
  QUALIFY row_number() OVER (PARTITION BY dataset, label ORDER BY msg_id) <= CASE WHEN label = 1 THEN 2 ELSE 10 END""",
    LAB,
)
oracle(
    "dataset_prune",
    """SELECT msg_id, dataset, label FROM lab WHERE dataset IN (SELECT dataset FROM lab GROUP BY dataset
  HAVING count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label = 1) > 0)""",
    LAB,
)
PADDED = r"regexp_replace(text, '([.:?!,])', ' \1 ', 'g')"
oracle("punctuation_pad", f"SELECT msg_id, {PADDED} AS text FROM docs", DOCS)
oracle(
    "blank_squeeze",
    rf"SELECT msg_id, regexp_replace(regexp_replace({PADDED}, ' +', ' ', 'g'), '\t+', chr(9), 'g') AS text FROM docs",
    DOCS,
)

# joins, duplicates, sampling

oracle(
    "annotation_lookup",
    """SELECT d.doc_id AS msg_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
oracle(
    "dataset_union",
    """SELECT 'both' AS dataset, label, text, min(msg_id) AS msg_id, count(*) AS n_copies FROM (
  SELECT (lang <> 'en')::INT AS label, text, msg_id FROM docs UNION ALL
  SELECT (role = 'system')::INT, text, msg_id + 1000000000 FROM turns) GROUP BY label, text""",
    DOCS,
    TURNS,
)
oracle("exact_dedup", "SELECT text, min(msg_id) AS msg_id, count(*) AS n_copies FROM docs GROUP BY text", DOCS)
oracle("dedup_counts", "SELECT count(*) AS n_before, count(DISTINCT text) AS n_after FROM docs", DOCS)
oracle("distinct_messages", "SELECT count(DISTINCT text) AS n_distinct FROM documents")
oracle(
    "class_conflicts",
    """SELECT text, count(*) FILTER (len(dataset) % 2 = 0) AS n_non_spam, count(*) FILTER (len(dataset) % 2 = 1) AS n_spam
  FROM docs GROUP BY text HAVING count(DISTINCT len(dataset) % 2) = 2""",
    DOCS,
)
oracle("seeded_shuffle", "SELECT msg_id, md5('1|' || msg_id) AS shuffle_key FROM docs", DOCS)
oracle(
    "stratified_holdout",
    """SELECT msg_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('1|' || msg_id))
  <= floor(count(*) OVER (PARTITION BY label) * 0.25 + 0.5))::INT AS is_test FROM lab""",
    LAB,
)
oracle("k_folds", f"SELECT msg_id, {fold('msg_id')} AS fold FROM docs", DOCS)

# censoring


def per_word(text: str, case: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({text}, {q(P.WORD + "|" + P.SPACE + "+")}),
    lambda w: CASE WHEN w LIKE '%{P.END}' THEN w {case} ELSE w END), '')"""


LINK_VALUE = f"coalesce(nullif(regexp_extract(w, {q('https?:.*')}), ''), w)"
LINK_CASE = f"""WHEN NOT regexp_matches(w, {q(P.EMAIL_ADDRESS)}) AND regexp_matches(w, {q(P.LINK_HINT)}) THEN
    substr(w, 1, length(w) - length({LINK_VALUE})) || ' {P.LINK}' || length({LINK_VALUE}) || '{P.END}  '"""
DIGITS = "length(regexp_replace(w, '[^0-9]', '', 'g'))"
PHONE_CASE = f"""WHEN regexp_matches(w, {q(P.PHONE_SHAPE)}) AND {DIGITS} IN (4, 9, 10, 12) THEN
    regexp_extract(w, {q("^([^0-9|*+@]*)")}, 1) || ' {P.PHONE}' || CASE WHEN regexp_matches(w, '^1.00') THEN '1'
    WHEN {DIGITS} = 4 THEN '2' WHEN {DIGITS} = 9 THEN '3' WHEN {DIGITS} = 10 THEN '4' WHEN contains(w, '@') THEN '@'
    WHEN contains(w, '+') THEN '5' ELSE '0' END || '{P.END}  ' || regexp_extract(w, {q("([^0-9|*+@]*)$")}, 1)"""
PHONE_LIST = "[" + ", ".join(q(p) for p in PHONES) + "]"


def with_phone_and_link(src: str) -> str:
    phone = f"{PHONE_LIST}[msg_id % {len(PHONES)} + 1]"
    return f"""(SELECT * REPLACE (text || ' call ' || {phone} || ' or (' || {phone} || '), see:http://x.example/' || msg_id
    || ' www.x.example' AS text) FROM {src})"""


EMAILED = f"regexp_replace(text, {q(P.EMAIL_ADDRESS)}, ' {P.EMAIL}{P.END}  ', 'g')"


def censored(src: str, name: str = "cen", glyphs: str | None = P.SYMBOL_GLYPHS) -> str:
    """CTEs that end in `name`, the censored rows of src."""
    last = EMAILED
    if glyphs:
        last = rf"regexp_replace({last}, '([{glyphs}])', ' {P.EMOJI}\1{P.END} ', 'g')"
    return f"""{name}1 AS (SELECT * REPLACE (trim({MASKED_BREAKS.format("text")}, {SPACES}) AS text) FROM {src}),
{name}2 AS (SELECT * REPLACE ({per_word("text", LINK_CASE)} AS text) FROM {name}1),
{name}3 AS (SELECT * REPLACE ({per_word("text", PHONE_CASE)} AS text) FROM {name}2),
{name} AS (SELECT * REPLACE (trim({last}, {SPACES}) AS text) FROM {name}3)"""


CEN = censored(with_phone_and_link("docs"))
oracle(
    "link_mask",
    f"""SELECT page_id, {per_word("(html || ' go ' || url || ' x:' || url || ' a@b.co.il shop.co.il, end')", LINK_CASE)} AS text
  FROM pages""",
)
oracle("phone_mask", f"SELECT msg_id, {per_word('text', PHONE_CASE)} AS text FROM {with_phone_and_link('docs')}", DOCS)
oracle("email_mask", f"SELECT msg_id, {EMAILED} AS text FROM docs", DOCS)
NAME_LIST, POOL_LIST = "[" + ", ".join(map(q, NAMES)) + "]", "[" + ", ".join(map(q, POOL)) + "]"
CORE = "regexp_replace(w, '[^A-Za-z]+', '', 'g')"


def picked(x: str) -> str:
    number = hash_number(f"'1|' || {x}")
    return f"{POOL_LIST}[{number} % {len(POOL)} + 1]"


BARE = f"substr({CORE}, {len(AND) + 1})"
NAME_CASE = f"""WHEN list_contains({NAME_LIST}, {CORE}) THEN replace(w, {CORE}, {picked(CORE)})
    WHEN starts_with({CORE}, {q(AND)}) AND list_contains({NAME_LIST}, {BARE}) THEN replace(w, {BARE}, {picked(BARE)})"""
oracle("name_mask", f"SELECT msg_id, {per_word('text', NAME_CASE)} AS text FROM docs", DOCS)
oracle(
    "glyph_mask",
    rf"SELECT msg_id, regexp_replace(text, '([{P.SYMBOL_GLYPHS}])', ' {P.EMOJI}\1{P.END} ', 'g') AS text FROM docs",
    DOCS,
)
oracle("break_markers", f"SELECT msg_id, dataset || {q(SUBJECT)} || {MASKED_BREAKS.format('text')} AS text FROM docs", DOCS)
oracle(
    "dedup_after_censor",
    "SELECT dataset, label, text, min(msg_id) AS msg_id, count(*) AS n_copies FROM cen GROUP BY dataset, label, text",
    LAB,
    censored("lab", glyphs=None),
)
oracle("censor_chain", "SELECT msg_id, text FROM cen", DOCS, CEN)
MARKED = f"""mk AS (SELECT msg_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS word FROM
  (SELECT msg_id, {words("text")} AS w FROM cen))"""
oracle(
    "marker_extraction",
    f"""SELECT msg_id, regexp_extract(word, {q(P.MARKER)}, 1) AS kind, regexp_extract(word, {q(P.MARKER)}, 2) AS payload, pos
  FROM mk WHERE regexp_matches(word, {q(P.MARKER)})""",
    DOCS,
    CEN,
    MARKED,
)
oracle(
    "glyph_inventory",
    f"""SELECT glyph, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[{P.SYMBOL_GLYPHS}]')) AS glyph FROM docs)
  GROUP BY glyph""",
    DOCS,
)

# scalar functions


def script_only(text: str, script: str = LATIN) -> str:
    return f"ltrim(regexp_replace(regexp_replace({text}, '[^{script} ]', '', 'g'), ' +', ' ', 'g'))"


oracle("script_letters", f"SELECT msg_id, {script_only('text')} AS text FROM docs", DOCS)
oracle("sign_letters", f"SELECT msg_id, regexp_replace(text, {q(f'[^{P.SIGNS}]')}, '', 'g') AS signs FROM docs", DOCS)
oracle(
    "ascii_rest",
    r"""SELECT msg_id, regexp_matches(text, '^[\x00-\x7f]*$')::INT AS is_ascii,
  regexp_replace(text, '[\x00-\x7f]', '', 'g') AS rest FROM docs""",
    DOCS,
)
oracle(
    "mean_of_positive",
    """SELECT dataset, round(coalesce(avg(n) FILTER (n > 0), 0), 6) AS mean_positive FROM
  (SELECT dataset, length(text) - length(replace(text, '|', '')) AS n FROM docs) GROUP BY dataset""",
    DOCS,
)
oracle(
    "ranked_words",
    f"""SELECT word, count(*) AS n FROM (SELECT unnest({words("text")}) AS word FROM docs) GROUP BY word
  ORDER BY n DESC, word LIMIT 50""",
    DOCS,
)

# n-grams, vocabularies, class words


def normalised(text: str) -> str:
    has = " ".join(f"WHEN contains(w, '{k}') THEN '{k}'" for k in (P.LINK, P.EMOJI, P.PHONE))
    return f"""list_transform({words(text)}, lambda w: CASE WHEN NOT contains(w, '{P.END}') THEN w {has} ELSE w END)"""


def _grams(name: str, kind: str, cols: str, source: str, blank: str, sizes: tuple[int, ...]) -> str:
    """source is a SELECT of cols, list AS w. N-grams by lead() over the exploded list; msg_id is unique."""
    joined = [f" || {q(blank)} || ".join(["a", "b", "c"][:n]) if blank else " || ".join(["a", "b", "c"][:n]) for n in sizes]
    parts = [
        f"SELECT {cols}, '{kind}' AS kind, {n} AS n, {j} AS term FROM {name}_l WHERE {'abc'[n - 1]} IS NOT NULL"
        for n, j in zip(sizes, joined, strict=True)
    ]
    return f"""{name}_x AS (SELECT {cols}, unnest(range(len(w))) AS i, unnest(w) AS a FROM ({source})),
{name}_l AS MATERIALIZED (SELECT {cols}, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM {name}_x
  WINDOW o AS (PARTITION BY msg_id ORDER BY i)),
{name} AS ({" UNION ALL ".join(parts)})"""


def word_grams(src: str, name: str, cols: str, sizes: tuple[int, ...] = (1, 2, 3)) -> str:
    return _grams(name, "word", cols, f"SELECT {cols}, {normalised('text')} AS w FROM {src}", " ", sizes)


def letter_grams(src: str, name: str, cols: str) -> str:
    return _grams(name, "letter", cols, f"SELECT {cols}, string_split(text, '') AS w FROM {src}", "", (1, 2, 3))


oracle(
    "word_ngrams", "SELECT kind, n, term, count(*) AS cnt FROM g GROUP BY kind, n, term", DOCS, CEN, word_grams("cen", "g", "msg_id")
)
oracle("letter_ngrams", "SELECT kind, n, term, count(*) AS cnt FROM g GROUP BY kind, n, term", DOCS, letter_grams("docs", "g", "msg_id"))
ROLES = """r AS (SELECT conv_id, role AS a, lead(role) OVER w AS b, lead(role, 2) OVER w AS c FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
oracle(
    "tag_ngrams",
    """SELECT term, count(*) AS n FROM (SELECT a AS term FROM r UNION ALL SELECT a || ' ' || b FROM r UNION ALL
  SELECT a || ' ' || b || ' ' || c FROM r) WHERE term IS NOT NULL GROUP BY term""",
    ROLES,
)
SENT_TAGS = """st AS (SELECT msg_id, sent_no, pos AS a, lead(pos) OVER w AS b, lead(pos, 2) OVER w AS c FROM toks
  WINDOW w AS (PARTITION BY msg_id, sent_no ORDER BY tok_no)),
sg AS (SELECT msg_id, sent_no, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS term FROM st)"""
oracle("tag_ngrams_from_text", "SELECT term, count(*) AS n FROM sg WHERE term IS NOT NULL GROUP BY term", TAGGED, SENT_TAGS)
oracle(
    "tag_ngram_sentences",
    "SELECT msg_id, term, count(DISTINCT sent_no) AS n FROM sg WHERE term IS NOT NULL GROUP BY msg_id, term",
    TAGGED,
    SENT_TAGS,
)
TRAIN = f"fo AS (SELECT *, {fold('msg_id')} AS fold FROM lab), tr AS (SELECT * FROM fo WHERE fold <> 0), te AS (SELECT * FROM fo WHERE fold = 0)"
VOCAB = """vc AS (SELECT kind, term, count(*) AS n FROM (SELECT kind, term FROM tw UNION ALL SELECT kind, term FROM tl)
  GROUP BY kind, term)"""
oracle(
    "train_vocabulary",
    "SELECT kind, term, n, row_number() OVER (ORDER BY substr(md5(kind || '|' || term), 1, 3), kind, term) - 1 AS idx FROM vc",
    LAB,
    TRAIN,
    word_grams("tr", "tw", "msg_id"),
    letter_grams("tr", "tl", "msg_id"),
    VOCAB,
)
oracle(
    "token_presence",
    """SELECT DISTINCT msg_id, g.kind, g.term, 1.0::DOUBLE AS value FROM (SELECT msg_id, kind, term FROM ew UNION
  SELECT msg_id, kind, term FROM el) g JOIN vc ON g.kind = vc.kind AND g.term = vc.term""",
    LAB,
    TRAIN,
    word_grams("tr", "tw", "msg_id"),
    letter_grams("tr", "tl", "msg_id"),
    VOCAB,
    word_grams("te", "ew", "msg_id"),
    letter_grams("te", "el", "msg_id"),
)
oracle(
    "substring_presence",
    """SELECT te.msg_id, v.term, 1.0::DOUBLE AS value FROM te, (SELECT DISTINCT term FROM tw) v WHERE contains(te.text, v.term)""",
    LAB,
    TRAIN,
    word_grams("tr", "tw", "msg_id"),
)


FOLDED = f"fo AS (SELECT *, {fold('msg_id')} AS fold FROM lab)"
FOLD_VOCAB = """fv AS MATERIALIZED (SELECT kind, term, count(*) AS n, bit_or(1::BIGINT << fold) AS folds FROM
  (SELECT kind, term, fold FROM fw UNION ALL SELECT kind, term, fold FROM fl) GROUP BY kind, term)"""
ALL_GRAMS = (word_grams("fo", "fw", "msg_id, fold"), letter_grams("fo", "fl", "msg_id, fold"))
oracle("fold_vocabularies", "SELECT kind, term, n, folds FROM fv", LAB, FOLDED, *ALL_GRAMS, FOLD_VOCAB)
oracle(
    "token_presence_all_folds",
    """SELECT msg_id, g.kind, g.term, 1.0::DOUBLE AS value FROM (SELECT msg_id, fold, kind, term FROM fw UNION
  SELECT msg_id, fold, kind, term FROM fl) g JOIN fv ON g.kind = fv.kind AND g.term = fv.term WHERE folds & ~(1::BIGINT << fold) <> 0""",
    LAB,
    FOLDED,
    *ALL_GRAMS,
    FOLD_VOCAB,
)
oracle(
    "substring_presence_all_folds",
    """SELECT fo.msg_id, v.term, 1.0::DOUBLE AS value FROM fo, (SELECT term, bit_or(1::BIGINT << fold) AS folds FROM fw GROUP BY term) v
  WHERE folds & ~(1::BIGINT << fold) <> 0 AND contains(fo.text, v.term)""",
    LAB,
    FOLDED,
    word_grams("fo", "fw", "msg_id, fold"),
)


def class_words(src: str, name: str) -> str:
    flat = "replace(text, chr(10), ' ')"
    return f"""{name}_t AS (SELECT label, unnest({words(script_only(flat))}) AS word FROM {src}),
{name}_n AS (SELECT label, word, count(*) AS n FROM {name}_t WHERE length(word) > 1 GROUP BY label, word HAVING count(*) >= 5),
{name} AS (SELECT a.label, a.word, a.n FROM {name}_n a ANTI JOIN {name}_n b ON a.word = b.word AND a.label <> b.label
  QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY a.n DESC, a.word) <= 2500)"""


oracle("class_words", "SELECT label, word, n FROM cw", LAB, class_words("lab", "cw"))
oracle(
    "class_word_hits",
    f"""SELECT msg_id, count(*) FILTER (cw.label = 0) AS non_spam_words, count(*) FILTER (cw.label = 1) AS spam_words FROM
  (SELECT msg_id, unnest(CASE WHEN len(w) = 0 THEN [''] ELSE w END) AS word FROM (SELECT msg_id,
  {words(script_only("replace(text, chr(10), ' ')"))} AS w FROM fo)) t LEFT JOIN cw ON t.word = cw.word GROUP BY msg_id""",
    LAB,
    TRAIN,
    class_words("tr", "cw"),
)
oracle("tag_counts", "SELECT conv_id AS msg_id, role AS pos, count(*) AS n FROM conversations GROUP BY conv_id, role")
oracle(
    "tag_count_columns",
    """SELECT conv_id AS msg_id, count(*) FILTER (role = 'user') AS pos_user, count(*) FILTER (role = 'assistant') AS
  pos_assistant, count(*) FILTER (role = 'system') AS pos_system FROM conversations GROUP BY conv_id""",
)

# trees


def walked(src: str) -> str:
    """Nodes below the root of each tree, by recursion from the root."""
    return f"""roots AS (SELECT msg_id, sent_no, max(tok_no) AS tok_no FROM {src} WHERE head = 0 GROUP BY msg_id, sent_no),
nodes AS (SELECT t.*, 0 AS level FROM {src} t JOIN roots r USING (msg_id, sent_no, tok_no)
  UNION ALL SELECT c.*, p.level + 1 FROM {src} c JOIN nodes p ON c.msg_id = p.msg_id AND c.sent_no = p.sent_no AND c.head = p.tok_no)"""


CONV = """conv AS (SELECT conv_id AS msg_id, 0 AS sent_no, (turn + 1)::INT AS tok_no, role AS pos, ((turn + 1) // 2)::INT AS head,
  role AS rel FROM conversations)"""
CHILDREN = """(SELECT msg_id, max(k) AS most_children FROM (SELECT msg_id, sent_no, head, count(*) FILTER (head > 0) AS k
  FROM nodes GROUP BY msg_id, sent_no, head) GROUP BY msg_id)"""
oracle_r("tree_nodes", "SELECT msg_id, tok_no, head, level FROM nodes", CONV, walked("conv"))
oracle_r("tree_depths", "SELECT msg_id, max(level) + 1 AS depth FROM nodes GROUP BY msg_id", CONV, walked("conv"))
oracle_r("tree_most_children", f"SELECT * FROM {CHILDREN}", CONV, walked("conv"))
oracle_r("tree_relations", "SELECT msg_id, count(DISTINCT rel) AS n_relations FROM nodes GROUP BY msg_id", CONV, walked("conv"))
oracle_r(
    "tree_shape_of_tagged_text",
    f"""SELECT a.msg_id, depth, most_children, n_relations FROM (SELECT msg_id, max(level) + 1 AS depth,
  count(DISTINCT rel) AS n_relations FROM nodes GROUP BY msg_id) a JOIN {CHILDREN} b ON a.msg_id = b.msg_id""",
    TAGGED,
    walked("toks"),
)
PATHS = """paths AS (SELECT n.msg_id, n.sent_no, unnest([n.rel, p.rel || ' ' || n.rel, g.rel || ' ' || p.rel || ' ' || n.rel]) AS term
  FROM nodes n LEFT JOIN nodes p ON n.msg_id = p.msg_id AND n.sent_no = p.sent_no AND n.head = p.tok_no
  LEFT JOIN nodes g ON n.msg_id = g.msg_id AND n.sent_no = g.sent_no AND p.head = g.tok_no)"""
oracle_r(
    "tree_path_ngrams",
    "SELECT msg_id, term, count(*) AS n FROM paths WHERE term IS NOT NULL GROUP BY msg_id, term",
    CONV,
    walked("conv"),
    PATHS,
)
oracle_r(
    "tree_path_vocabulary",
    "SELECT term, count(DISTINCT msg_id || '/' || sent_no) AS n FROM paths WHERE term IS NOT NULL GROUP BY term",
    CONV,
    walked("conv"),
    PATHS,
)

# statistics and style

CENLAB = censored(with_phone_and_link("lab"))
LINK_N = f"regexp_extract_all(text, '{P.LINK}([0-9]+){P.END}', 1)"
oracle(
    "class_statistics",
    f"""SELECT label, round(coalesce(avg(a) FILTER (a > 0), 0), 6) AS link_length, round(coalesce(avg(b) FILTER (b > 0), 0), 6)
  AS n_links, round(coalesce(avg(c) FILTER (c > 0), 0), 6) AS n_emoji, round(coalesce(avg(d) FILTER (d > 0), 0), 6) AS n_breaks
  FROM (SELECT label, list_avg(list_filter(list_transform({LINK_N}, lambda x: x::DOUBLE), lambda x: x > 0)) AS a,
  len({LINK_N}) AS b, len(regexp_extract_all(text, '{P.EMOJI}.{P.END}')) AS c,
  len(regexp_extract_all(text, '{P.NEWLINE}')) AS d FROM cen) GROUP BY label""",
    LAB,
    CENLAB,
)
oracle(
    "class_glyphs",
    f"""SELECT label, glyph, count(*) AS n FROM (SELECT label, unnest(regexp_extract_all(text, '{P.EMOJI}(.){P.END}', 1)) AS glyph
  FROM cen) GROUP BY label, glyph""",
    LAB,
    censored("lab"),
)


def starts(kind: str, payload: str = "") -> str:
    return f"len(list_filter(w, lambda x: regexp_matches(x, '^{kind}{payload}{P.END}')))"


STYLE = f"""sw AS (SELECT msg_id, {words("text")} AS w FROM cen),
sp AS (SELECT msg_id, w, list_filter(w, lambda x: NOT contains(x, '{P.END}')) AS p FROM sw),
sx AS (SELECT *, array_to_string(p, '') AS letters, {starts(P.LINK, "[0-9]+")} AS n_links, {starts(P.EMOJI, ".")} AS n_emoji,
  {starts(P.EMAIL)} AS n_emails, {starts(P.PHONE, "[0-9@]")} AS n_phones,
  list_filter(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '^{P.LINK}[0-9]+{P.END}') THEN (i - 1)::DOUBLE / len(w) END),
    lambda x: x IS NOT NULL) AS places,
  list_transform(list_filter(w, lambda x: regexp_matches(x, '^{P.LINK}[0-9]+{P.END}')),
    lambda x: regexp_extract(x, '^{P.LINK}([0-9]+)', 1)::DOUBLE) AS sizes FROM sp),
sy AS (SELECT *, length(letters) + n_emoji AS n_letters FROM sx)"""


def count(pattern: str) -> str:
    return f"len(regexp_extract_all(letters, {q(pattern)}))"


def share(a: str, b: str) -> str:
    return f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 6)"


def style(name: str, columns: str) -> None:
    oracle(name, f"SELECT msg_id, {columns} FROM sy", DOCS, CEN, STYLE)


style(
    "style_sizes",
    """(len(p) + n_emails + n_links + n_phones)::BIGINT AS n_words, n_letters::BIGINT AS n_letters,
  coalesce(list_max(list_transform(p, lambda x: length(x))), 0)::BIGINT AS longest_word""",
)
style(
    "style_links",
    """n_links::BIGINT AS n_links, round(coalesce(list_avg(sizes), 0), 6) AS link_length,
  round(coalesce(list_avg(places), 0), 6) AS link_place""",
)
style("style_phones", ", ".join(f"{starts(P.PHONE, c)}::BIGINT AS phone_{'at' if c == '@' else c}" for c in "12345@"))
style(
    "style_signs",
    f"""{count(f"[{P.SIGNS}]")}::BIGINT AS n_signs, {share(count(f"[{P.SIGNS}]"), "n_letters")} AS sign_share,
  {count(f"[{P.PUNCTUATION}]")}::BIGINT AS n_punctuation""",
)
style("style_glyphs", f"n_emoji::BIGINT AS n_emoji, {share('n_emoji', 'n_letters')} AS emoji_share")
style(
    "style_script",
    f"""{share(count(f"[{ACCENTED}]"), count(r"\p{L}"))} AS script_share,
  {share(count(f"[{ACCENTED}]"), count(f"[{LATIN}]"))} AS script_ratio""",
)
style(
    "style_sentences",
    f"""(1 + len(list_filter(range(2, len(w) + 1), lambda i: starts_with(w[i], '{P.NEWLINE}{P.END}')
  AND NOT regexp_matches(w[i - 1], '^({P.NEWLINE}|{P.SUBJECT}){P.END}'))))::BIGINT AS n_sentences""",
)
style("style_digits", f"{count('[0-9]')}::BIGINT AS n_digits, {share(count('[0-9]'), 'n_letters')} AS digit_share")

# assembly

oracle(
    "sparse_vectors",
    """SELECT msg_id, count(*)::INT AS n_slots, sum(idx)::BIGINT AS idx_sum, min(idx) AS first_idx, max(idx) AS last_idx
  FROM (SELECT DISTINCT msg_id, kind, term FROM g) JOIN (SELECT kind, term,
  row_number() OVER (ORDER BY substr(md5(kind || '|' || term), 1, 3), kind, term) - 1 AS idx FROM (SELECT DISTINCT kind, term FROM g))
  USING (kind, term) GROUP BY msg_id""",
    LAB,
    word_grams("lab", "g", "msg_id", (1,)),
)
FLAT_TURNS = "ft AS (SELECT msg_id, role, (role = 'user')::INT AS label, replace(text, chr(10), ' ') AS text FROM turns)"
TURN_STYLE = STYLE.replace("FROM cen)", "FROM ft)")
STYLE_VALUES = {
    "n_words": "len(p)", "n_letters": "length(letters)", "longest_word": "list_max(list_transform(p, lambda x: length(x)))",
    "n_signs": count(f"[{P.SIGNS}]"), "sign_share": share(count(f"[{P.SIGNS}]"), "n_letters"),
    "n_punctuation": count(f"[{P.PUNCTUATION}]"), "script_share": share(count(f"[{LATIN}]"), count(r"\p{L}")),
    "script_ratio": share(count(f"[{LATIN}]"), count(f"[{LATIN}]")), "n_sentences": "1", "n_digits": count("[0-9]"),
    "digit_share": share(count("[0-9]"), "n_letters"),
}
STYLE_UNION = " UNION ALL ".join(
    f"SELECT msg_id, 'style' AS kind, '{k}' AS term, ({v})::DOUBLE AS value FROM sy" for k, v in STYLE_VALUES.items()
)
oracle_r(
    "feature_blocks",
    f"""SELECT msg_id, kind, term, round(value, 6) AS value FROM (
  SELECT DISTINCT msg_id, 'word' AS kind, term, 1.0::DOUBLE AS value FROM g UNION ALL {STYLE_UNION}
  UNION ALL SELECT msg_id, 'class_words', CASE WHEN cw.label = 0 THEN 'non_spam_words' ELSE 'spam_words' END, count(*)
    FROM (SELECT msg_id, unnest({words(script_only("text"))}) AS word FROM ft) t JOIN cw ON t.word = cw.word GROUP BY msg_id, cw.label
  UNION ALL SELECT msg_id, 'tag', pos, count(*) FROM toks GROUP BY msg_id, pos
  UNION ALL SELECT msg_id, 'tag_ngram', term, count(DISTINCT sent_no) FROM sg WHERE term IS NOT NULL GROUP BY msg_id, term
  UNION ALL SELECT msg_id, 'tree', 'depth', max(level) + 1 FROM nodes GROUP BY msg_id
  UNION ALL SELECT msg_id, 'tree', 'n_relations', count(DISTINCT rel) FROM nodes GROUP BY msg_id
  UNION ALL SELECT msg_id, 'tree', 'most_children', most_children FROM {CHILDREN}
  UNION ALL SELECT msg_id, 'tree_ngram', term, count(*) FROM paths WHERE term IS NOT NULL GROUP BY msg_id, term
  ) WHERE value <> 0 AND msg_id IN (SELECT msg_id FROM ft WHERE regexp_matches(text, '[{LATIN}]'))""",
    TAGGED,
    SENT_TAGS,
    FLAT_TURNS,
    TURN_STYLE,
    word_grams("ft", "g", "msg_id", (1,)),
    class_words("ft", "cw"),
    walked("toks"),
    PATHS,
)

# classifiers


def bayes(src: str) -> str:
    """src(msg_id, fold, label, text) to nb(msg_id, fold, label, score0, score1)."""
    return f"""{word_grams(src, "g", "msg_id, fold, label", (1,))},
d AS (SELECT DISTINCT msg_id, fold, label, term FROM g),
folds AS (SELECT DISTINCT fold FROM {src} WHERE fold >= 0),
tc AS (SELECT f.fold, term, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM folds f JOIN d ON d.fold <> f.fold
  GROUP BY f.fold, term),
tot AS (SELECT fold, sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM tc GROUP BY fold),
pr AS (SELECT f.fold, ln(count(*) FILTER (label = 0) / count(*)) AS p0, ln(count(*) FILTER (label = 1) / count(*)) AS p1
  FROM folds f JOIN {src} m ON m.fold <> f.fold GROUP BY f.fold),
ss AS (SELECT d.msg_id, sum(ln((n0 + 1) / (t0 + v))) AS s0, sum(ln((n1 + 1) / (t1 + v))) AS s1 FROM d
  JOIN tc ON d.fold = tc.fold AND d.term = tc.term JOIN tot ON tot.fold = d.fold GROUP BY d.msg_id),
nb AS (SELECT m.msg_id, m.fold, m.label, coalesce(s0, 0) + p0 AS score0, coalesce(s1, 0) + p1 AS score1 FROM {src} m
  LEFT JOIN ss ON ss.msg_id = m.msg_id JOIN pr ON pr.fold = m.fold)"""


PER_CLASS = "SELECT min(msg_id) AS msg_id, label, text FROM {} GROUP BY label, text"
CENFOLD = f"cf AS (SELECT *, {fold('text')} AS fold FROM ({PER_CLASS.format("cen")}))"
oracle(
    "naive_bayes_scores",
    """SELECT msg_id, fold, label, (score1 > score0)::INT AS predicted, round(score0, 3) AS score0, round(score1, 3) AS score1
  FROM nb""",
    LAB,
    censored("lab", glyphs=None),
    CENFOLD,
    bayes("cf"),
)
HOLD = f"""ho AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('1|' || text))
  <= floor(count(*) OVER (PARTITION BY label) * 0.25 + 0.5))::INT - 1 AS fold FROM ({PER_CLASS.format("lab")}))"""
oracle(
    "naive_bayes_holdout",
    """SELECT msg_id, label, (score1 > score0)::INT AS predicted, round(score0, 3) AS score0, round(score1, 3) AS score1 FROM nb""",
    LAB,
    HOLD,
    bayes("ho"),
)
NEAR = f"""em AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, {fold("vec_id")} AS fold FROM embeddings),
k AS (SELECT a.fold, 3 * floor(sqrt(count(*)))::INT AS k FROM (SELECT DISTINCT fold FROM em) a JOIN em b ON a.fold <> b.fold GROUP BY a.fold),
nn AS (SELECT a.id AS test_id, a.fold, b.id AS train_id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY
  round(greatest(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 0), 9), b.id)
  AS rank FROM em a JOIN em b ON a.fold <> b.fold WHERE a.fold IN (:folds) QUALIFY rank <= (SELECT k FROM k WHERE k.fold = a.fold))"""
for name, folds in (("", "0"), ("_all_folds", "0, 1, 2, 3, 4")):
    near = NEAR.replace(":folds", folds)
    oracle(f"nearest_neighbours{name}", "SELECT test_id, train_id, rank::INT AS rank FROM nn", near)
    oracle(
        f"nearest_neighbour_votes{name}",
        """SELECT test_id, label AS predicted FROM (SELECT test_id, label, count(*) AS n FROM nn GROUP BY test_id, label)
  QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY n DESC, label) = 1""",
        near,
    )
oracle(
    "boosting_stump_errors",
    """SELECT term, (e <= 0.5)::INT AS present, round(least(e, 1 - e), 6) AS error FROM (
  SELECT term, (sum(CASE WHEN label = 0 THEN w ELSE 0 END) + any_value(t1) - sum(CASE WHEN label = 1 THEN w ELSE 0 END)) / any_value(t) AS e
  FROM (SELECT DISTINCT msg_id, label, term FROM g) JOIN (SELECT msg_id, CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM lab)
  USING (msg_id), (SELECT sum(CASE WHEN label = 1 THEN 3.0 ELSE 0 END)::DOUBLE AS t1,
  sum(CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END)::DOUBLE AS t FROM lab) GROUP BY term)""",
    LAB,
    word_grams("lab", "g", "msg_id, label", (1,)),
)


NUMBERS = f"""nu AS MATERIALIZED (SELECT msg_id, 'style:' || term AS term, value FROM ({STYLE_UNION}))"""
LAB_STYLE = STYLE.replace("FROM cen)", "FROM (SELECT msg_id, label, replace(text, chr(10), ' ') AS text FROM lab))")


def cuts_of(weighed: str) -> str:
    """(term, cut, p0, p1) of every threshold of the numbers, from rows(msg_id, label, w)."""
    return f"""SELECT term, (value + lead(value) OVER d) / 2 AS cut, sum(p0) OVER d AS p0, sum(p1) OVER d AS p1 FROM (
    SELECT term, value, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS p0, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS p1
    FROM nu JOIN {weighed} USING (msg_id) GROUP BY term, value) WINDOW d AS (PARTITION BY term ORDER BY value DESC)"""


oracle(
    "boosting_cut_errors",
    f"""SELECT term, round(cut, 9) AS cut, (e <= 0.5)::INT AS present, round(least(e, 1 - e), 6) AS error FROM (
  SELECT term, cut, (p0 + t1 - p1) / t AS e FROM ({cuts_of("w1")}), (SELECT sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS t1, sum(w) AS t FROM w1)
  WHERE cut IS NOT NULL)""",
    LAB,
    LAB_STYLE,
    NUMBERS,
    "w1 AS (SELECT msg_id, label, CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM lab)",
)


def boosted(rounds: int) -> str:
    """CTEs b1..bN: the best stump of each round over terms and thresholds of numbers; s1..sN: what it says."""
    out = ["wt AS MATERIALIZED (SELECT DISTINCT msg_id, label, term FROM g)", "w1 AS (SELECT msg_id, label, 1.0::DOUBLE AS w FROM lab)"]
    for i in range(1, rounds + 1):
        out.append(f"""q{i} AS (SELECT term, NULL::DOUBLE AS cut, sum(CASE WHEN wt.label = 0 THEN w ELSE 0 END) AS p0,
    sum(CASE WHEN wt.label = 1 THEN w ELSE 0 END) AS p1 FROM wt JOIN w{i} USING (msg_id) GROUP BY term
    UNION ALL SELECT * FROM ({cuts_of(f"w{i}")}) WHERE cut IS NOT NULL),
e{i} AS (SELECT term, cut, (p0 + t1 - p1) / t AS e FROM q{i},
    (SELECT sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS t1, sum(w) AS t FROM w{i})),
b{i} AS MATERIALIZED (SELECT term, cut, present, error, ln((1 - error) / error) AS alpha FROM (SELECT term, cut, (e <= 0.5)::INT AS present,
    round(least(e, 1 - e), 9) AS error FROM e{i}) ORDER BY error, term, cut NULLS FIRST LIMIT 1),
s{i} AS (SELECT l.msg_id, alpha, CASE WHEN h.value > coalesce(cut, 0) THEN present ELSE 1 - present END AS said FROM lab l, b{i}
    LEFT JOIN (SELECT msg_id, term, 1.0 AS value FROM wt UNION ALL FROM nu) h ON h.msg_id = l.msg_id AND h.term = b{i}.term),
w{i + 1} AS MATERIALIZED (SELECT w.msg_id, w.label, w.w * CASE WHEN s.said <> w.label THEN exp(s.alpha) ELSE 1 END AS w
    FROM w{i} w JOIN s{i} s USING (msg_id))""")
    return ",\n".join(out)


BOOSTING_ROUNDS = 50
oracle(
    "boosting_predictions",
    f"""SELECT msg_id, round(sum(CASE WHEN said = 1 THEN alpha ELSE -alpha END), 6) AS margin,
  (sum(CASE WHEN said = 1 THEN alpha ELSE -alpha END) > 0)::INT AS predicted
  FROM ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, BOOSTING_ROUNDS + 1))}) GROUP BY msg_id""",
    LAB,
    LAB_STYLE,
    NUMBERS,
    word_grams("lab", "g", "msg_id, label", (1,)),
    boosted(BOOSTING_ROUNDS),
)

# evaluation

oracle(
    "baseline_accuracy",
    """SELECT count(DISTINCT text) FILTER (label = 0) AS n_non_spam, count(DISTINCT text) AS n_distinct,
  round(count(DISTINCT text) FILTER (label = 0) / count(DISTINCT text), 6) AS baseline FROM lab""",
    LAB,
)
RULES = f"""pd AS (SELECT msg_id, {fold("msg_id")} AS fold, label, 'long' AS model, (length(text) > 4000)::INT AS predicted FROM lab
  UNION ALL SELECT msg_id, {fold("msg_id")}, label, 'worthless', contains(text, 'worthless')::INT FROM lab
  UNION ALL SELECT msg_id, {fold("msg_id")}, label, 'hash', ({fold("msg_id", 7, 2)} = 0)::INT FROM lab),
cm AS (SELECT model, fold, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM pd GROUP BY model, fold),
lam AS (SELECT unnest([1, 99, 999]) AS lm),
f1p AS (SELECT *, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision FROM cm),
sc AS (SELECT f1p.*, 2 * precision * recall / nullif(precision + recall, 0) AS f1, lm,
  (lm * tn + tp) / nullif(lm * (tn + fp) + tp + fn, 0) AS wacc, (tp + fn) / nullif(lm * fp + fn, 0) AS tcr FROM f1p, lam)"""
oracle(
    "accuracy_margin",
    """SELECT model, fold, round(avg((label = predicted)::INT), 6) AS accuracy, round(avg((label = predicted)::INT)
  - (SELECT count(DISTINCT text) FILTER (label = 0) / count(DISTINCT text) FROM lab), 6) AS margin FROM pd GROUP BY model, fold""",
    LAB,
    RULES,
)
oracle("confusion_matrix", "SELECT model, fold, tn, fp, fn, tp FROM cm", LAB, RULES)
F1 = """SELECT model, fold, tn, fp, fn, tp, round(r, 6) AS recall, round(p, 6) AS precision,
  round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM"""
oracle("f1_paper", f"{F1} (SELECT *, recall AS r, precision AS p FROM f1p)", LAB, RULES)
oracle("f1_as_written", f"{F1} (SELECT *, tn / nullif(tn + fp, 0) AS r, tp / nullif(tp + fn, 0) AS p FROM cm)", LAB, RULES)
oracle(
    "weighted_scores_paper",
    """SELECT model, fold, lm AS "lambda", round(wacc, 6) AS wacc, round(tcr, 6) AS tcr FROM sc""",
    LAB,
    RULES,
)
oracle(
    "weighted_scores_as_written",
    """SELECT model, fold, lm AS "lambda", round((lm * tn + tp) / nullif(lm * (tn + fn) + tp + fp, 0), 6) AS wacc,
  round((tp + fp) / nullif(lm * fn + fp, 0), 6) AS tcr FROM cm, lam""",
    LAB,
    RULES,
)
PER_CLASS_SCORES = """hits AS (SELECT model, c.class, count(*) FILTER (label = c.class AND predicted = c.class) AS hit,
  count(*) FILTER (predicted = c.class) AS called, count(*) FILTER (label = c.class) AS support
  FROM pd, (SELECT unnest([0, 1]) AS class) c GROUP BY model, c.class),
pq AS (SELECT model, class::VARCHAR AS class, coalesce(hit / nullif(called, 0), 0) AS precision,
  coalesce(hit / nullif(support, 0), 0) AS recall, support FROM hits),
pc AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pq)"""
oracle(
    "class_report",
    """SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support
  FROM (SELECT model, class, precision, recall, f1, support FROM pc
  UNION ALL SELECT model, 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM pc GROUP BY model
  UNION ALL SELECT model, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM pc GROUP BY model)""",
    LAB,
    RULES,
    PER_CLASS_SCORES,
)


def mean_low(c: str, where: str = "", name: str = "") -> str:
    x = f"{c}) FILTER ({where}" if where else c
    return f"round(avg({x}), 4) AS {name or c}_mean, round(min({x}), 4) AS {name or c}_low"


FOLD_SUMMARY = f"SELECT model, lm AS \"lambda\", {mean_low('f1')}, {mean_low('wacc')}, {mean_low('tcr')} FROM sc GROUP BY model, lm"
oracle("fold_summary", FOLD_SUMMARY, LAB, RULES)
BY_LAMBDA = ", ".join(mean_low(c, f"lm = {x}", f"{c}_{x}") for x in (1, 99, 999) for c in ("wacc", "tcr"))
oracle("summary_by_lambda", f"SELECT model, {mean_low('f1', 'lm = 1')}, {BY_LAMBDA} FROM sc GROUP BY model", LAB, RULES)
oracle("folds_above_one", """SELECT model, lm AS "lambda", count(*) FILTER (tcr > 1) AS n_folds FROM sc GROUP BY model, lm""", LAB, RULES)
oracle(
    "error_report",
    "SELECT msg_id, predicted, model, count(*) AS n FROM pd WHERE label <> predicted GROUP BY msg_id, predicted, model",
    LAB,
    RULES,
)
SCORED = """pd AS (SELECT 'MultinomialNB' AS model, msg_id, fold, label, (score1 > score0)::INT AS predicted FROM nb),
cm AS""" + RULES.split("cm AS", 1)[1]
oracle(
    "dataset_build",
    "SELECT DISTINCT 'sms' AS dataset, label, text FROM cen WHERE text <> ''",
    f"""pt AS (SELECT conv_id, unnest(string_split({ONCE.format(ONCE.format("text"))}, chr(1))) AS text FROM conversations
  WHERE regexp_matches(string_split({ONCE.format(ONCE.format("text"))}, chr(1))[1], '[{P.SCRIPTS["latin"]}]')),
src AS (SELECT DISTINCT (conv_id % 2)::INT AS label, text FROM pt)""",
    censored("src", glyphs=None),
)
oracle("spam_scores", FOLD_SUMMARY, LAB, censored("lab", glyphs=None), CENFOLD, bayes("cf"), SCORED)


def sections(rows: str, model: str, item: str, **columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS section, {model} AS model, ({item})::VARCHAR AS item, round(({c})::DOUBLE, 4) AS value FROM {rows}"
        for name, c in columns.items()
    )


oracle(
    "run_report",
    " UNION ALL ".join([
        sections("base", "''", "''", baseline="b"),
        sections("ac", "model", "fold", accuracy="a", margin="a - b"),
        sections("cr", "model", "class", precision="precision", recall="recall", f1="f1", support="support"),
        sections(f"({FOLD_SUMMARY})", "model", '"lambda"', **{c: c for c in ("f1_mean", "f1_low", "wacc_mean", "wacc_low", "tcr_mean", "tcr_low")}),
        sections("(SELECT model, lm, count(*) FILTER (tcr > 1) AS n FROM sc GROUP BY model, lm)", "model", "lm", folds_above_one="n"),
        sections("pd", "model", "msg_id || ' ' || predicted", error="1") + " WHERE label <> predicted",
    ]),
    LAB,
    censored("lab", glyphs=None),
    CENFOLD,
    bayes("cf"),
    SCORED,
    "base AS (SELECT count(DISTINCT text) FILTER (label = 0) / count(DISTINCT text) AS b FROM cen)",
    "ac AS (SELECT model, fold, avg((label = predicted)::INT) AS a, any_value(b) AS b FROM pd, base GROUP BY model, fold)",
    PER_CLASS_SCORES,
    """cr AS (SELECT model, class, precision, recall, f1, support FROM pc
  UNION ALL SELECT model, 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM pc GROUP BY model
  UNION ALL SELECT model, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM pc GROUP BY model)""",
)


N_SCALARS = 24

def all_folds(sql: str, *ctes: str, src: str = "lab", k: int = 5) -> str:
    """The rows of all folds of src. fl holds each text once per class; in sql and ctes, :fold stands for the fold."""
    folded = f"{fold('text', k)} AS fold" if k > 1 else HOLD[HOLD.index("(row_number") : HOLD.index(" FROM (SELECT min")]
    parts = [
        f"""fl AS ({PER_CLASS.format(f"(SELECT msg_id, label, replace(text, chr(10), ' ') AS text FROM {src})")}),
fo AS (SELECT *, {folded} FROM fl), tr AS (SELECT * FROM fo WHERE fold <> :fold), te AS (SELECT * FROM fo WHERE fold = :fold)""",
        STYLE.replace("FROM cen)", "FROM fl)"),
        word_grams("fl", "gw", "msg_id"),
        letter_grams("fl", "gl", "msg_id"),
        class_words("tr", "cw"),
        f"""ff AS MATERIALIZED (SELECT DISTINCT msg_id, kind || ':' || term AS f, 1.0::DOUBLE AS v FROM (FROM gw UNION ALL FROM gl)
  UNION ALL SELECT msg_id, 'style:' || term, value FROM ({STYLE_UNION})
  UNION ALL SELECT msg_id, 'class:' || cw.label, count(*) FROM (SELECT msg_id, unnest({words(script_only("text"))}) AS word FROM fl) t
    JOIN cw ON t.word = cw.word GROUP BY msg_id, cw.label)""",
        *ctes,
    ]
    whole = "WITH " + ",\n".join(parts) + "\n" + sql.strip()
    return "\nUNION ALL\n".join(f"SELECT * FROM ({whole.replace(':fold', str(f))})" for f in range(max(k, 1)))


def model_oracle(name: str, sql: str, *ctes: str) -> None:
    oracle(name, all_folds(sql, *ctes), LAB)


FULL_BAYES = (
    f"""SELECT msg_id, 'MultinomialNB' AS model, :fold::INT AS fold, label, (s1 > s0)::INT AS predicted FROM (
  SELECT te.msg_id, te.label,
    any_value(ln((d0 + 1) / (d0 + d1 + 2))) + sum(v * ln((coalesce(n0, 0) + 1) / (t0 + width + {N_SCALARS}))) AS s0,
    any_value(ln((d1 + 1) / (d0 + d1 + 2))) + sum(v * ln((coalesce(n1, 0) + 1) / (t1 + width + {N_SCALARS}))) AS s1
  FROM te JOIN ff ON ff.msg_id = te.msg_id LEFT JOIN nt ON nt.f = ff.f,
    (SELECT count(*) FILTER (label = 0) AS d0, count(*) FILTER (label = 1) AS d1 FROM tr),
    (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) FILTER (f LIKE 'word:%' OR f LIKE 'letter:%') AS width FROM nt)
  WHERE (ff.f NOT LIKE 'word:%' AND ff.f NOT LIKE 'letter:%') OR nt.f IS NOT NULL GROUP BY te.msg_id, te.label)""",
    """nt AS MATERIALIZED (SELECT f, sum(CASE WHEN label = 0 THEN v ELSE 0 END) AS n0, sum(CASE WHEN label = 1 THEN v ELSE 0 END) AS n1
  FROM ff JOIN tr ON ff.msg_id = tr.msg_id GROUP BY f)""",
)
model_oracle("model_naive_bayes", *FULL_BAYES)
model_oracle("naive_bayes_full_features", *FULL_BAYES)

def grid_run(run_id: int, name: str, k: int, cap: int | None, union: bool) -> str:
    """Summary rows of one run and dataset, self-contained below the CTE `hv`."""
    rows = f"""SELECT msg_id, dataset, label, text FROM hv
    QUALIFY label = 1 OR row_number() OVER (PARTITION BY dataset, label ORDER BY msg_id) <= {cap or 1 << 40}"""
    if not union:
        rows = f"SELECT * FROM ({rows}) WHERE dataset = '{name}'"
    rows = PER_CLASS.format(f"({rows})") if union else rows
    return f"""SELECT {run_id}::INT AS run_id, '{name}' AS dataset, {k}::INT AS k, 0.25::DOUBLE AS split, {str(union).lower()} AS is_union,
  false AS is_morphological, false AS has_tags, false AS has_trees,
  -1::INT AS spam_cap, {cap or -1}::INT AS non_spam_cap, * FROM (WITH rw AS MATERIALIZED ({rows}),
pd AS MATERIALIZED ({all_folds(*FULL_BAYES, src="rw", k=k)}),
cm AS{RULES.split("cm AS", 1)[1]} SELECT * FROM ({FOLD_SUMMARY}), (SELECT count(*) AS n_messages, count(*) FILTER (label = 1) AS n_spam,
  count(*) FILTER (label = 0) AS n_non_spam FROM rw))"""


oracle(
    "experiment_grid",
    " UNION ALL ".join(
        [grid_run(i, n, 5, cap, False) for i, cap in ((0, None), (1, 100)) for n in ("sms", "email")]
        + [grid_run(2, "both", 1, None, True)]
    ),
    LAB,
    "hv AS (SELECT * REPLACE (CASE WHEN len(dataset) % 2 = 0 THEN 'sms' ELSE 'email' END AS dataset, replace(text, chr(10), ' ') AS text) FROM lab)",
)

model_oracle(
    "model_k_neighbours",
    """SELECT te.msg_id, 'KNeighbors' AS model, :fold::INT AS fold, te.label, v.predicted FROM te JOIN (
  SELECT a AS msg_id, label AS predicted FROM (SELECT a, label, count(*) AS n FROM (
    SELECT te.msg_id AS a, tr.label, row_number() OVER (PARTITION BY te.msg_id ORDER BY
      round(x.s + y.s - 2 * coalesce(d.s, 0), 9), tr.msg_id) AS r
    FROM te JOIN nm x ON x.msg_id = te.msg_id, tr JOIN nm y ON y.msg_id = tr.msg_id
    LEFT JOIN dt d ON d.a = te.msg_id AND d.b = tr.msg_id)
    WHERE r <= 3 * floor(sqrt((SELECT count(*) FROM tr))) GROUP BY a, label)
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1) v ON v.msg_id = te.msg_id""",
    """nm AS MATERIALIZED (SELECT msg_id, sum(v * v) AS s FROM ff GROUP BY msg_id),
dt AS MATERIALIZED (SELECT p.msg_id AS a, q.msg_id AS b, sum(p.v * q.v) AS s FROM ff p JOIN ff q ON p.f = q.f
  WHERE p.msg_id IN (SELECT msg_id FROM te) AND q.msg_id IN (SELECT msg_id FROM tr) GROUP BY p.msg_id, q.msg_id)""",
)

oracle_r(
    "annotation_terms",
    f"""SELECT t.msg_id, depth, most_children, n_relations, term, n FROM (
  SELECT msg_id, 'tag:' || pos AS term, count(*) AS n FROM toks GROUP BY msg_id, pos
  UNION ALL SELECT msg_id, 'tag_ngram:' || term, count(DISTINCT sent_no) FROM sg WHERE term IS NOT NULL GROUP BY msg_id, term
  UNION ALL SELECT msg_id, 'tree_ngram:' || term, count(*) FROM paths WHERE term IS NOT NULL GROUP BY msg_id, term) t
  JOIN (SELECT msg_id, max(level) + 1 AS depth, count(DISTINCT rel) AS n_relations FROM nodes GROUP BY msg_id) a ON a.msg_id = t.msg_id
  JOIN {CHILDREN} b ON b.msg_id = t.msg_id""",
    TAGGED,
    SENT_TAGS,
    walked("toks"),
    PATHS,
)
