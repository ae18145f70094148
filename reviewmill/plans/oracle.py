"""DuckDB SQL that states each registered query a second time.

The SQL is written in other forms than the Spark side where possible: lag windows
for the scorer, a recursive query for k-means, explicit windows for coherence.
``BASE`` names the shared steps; a query only pays for the steps it uses.
"""

from __future__ import annotations

from reviewmill.config import CONTRACTIONS, NOUN_ENDINGS
from reviewmill.functions.text import EMOJI_PATTERN
from reviewmill.plans import fixtures as fx

_LETTER = r"[\p{L}\p{N}_]"
_NO_LETTER = r"[^\p{L}\p{N}_]"
_NON_SPACE = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def _strings(words) -> str:
    return ", ".join(f"'{word}'" for word in words)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def _brands(text: str) -> str:
    """Whole-word rewrites; twice each, since a match eats its right neighbour."""
    out = f"lower({text})"
    groups: list[tuple[str, list[str]]] = []
    for word, target in fx.BRANDS:
        if groups and groups[-1][0] == target:
            groups[-1][1].append(word)
        else:
            groups.append((target, [word]))
    for target, listed in groups:
        pattern = f"(^|{_NO_LETTER})(?:{'|'.join(listed)})($|{_NO_LETTER})"
        for _ in range(2):
            out = f"regexp_replace({out}, '{pattern}', '\\1{target}\\2', 'g')"
    return out


def _urls(text: str) -> str:
    return f"regexp_replace({text}, '(?:http|www){_NON_SPACE}+', '', 'g')"


def _plain_words(text: str) -> str:
    out = f"trim(regexp_replace({text}, '[^a-zA-Z0-9]+', ' ', 'g'))"
    for head, tail in CONTRACTIONS:
        out = f"regexp_replace({out}, '\\b{head}{tail}\\b', '{head} {tail}', 'g')"
    return out


def _emoji(text: str) -> str:
    return f"regexp_replace({text}, '{EMOJI_PATTERN}', '', 'g')"


def _cleaned_words(text: str) -> str:
    return _plain_words(_urls(_emoji(_brands(text))))


def _word_rows(name: str, source: str, id_col: str, words: str, drop) -> str:
    """CTEs <name>(id, pos, w): words of a text in order, without the dropped ones."""
    keep = f"AND w NOT IN ({_strings(drop)})" if drop else ""
    return f"""
{name}_raw AS (
  SELECT {id_col}, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
  FROM (SELECT {id_col}, string_split({words}, ' ') AS ws FROM {source})),
{name} AS (
  SELECT {id_col}, row_number() OVER (PARTITION BY {id_col} ORDER BY p) - 1 AS pos, w
  FROM {name}_raw WHERE w <> '' {keep})"""


def _compound(name: str, texts: str, words: str, id_col: str) -> str:
    """CTE <name>(id, compound) from word rows."""
    return f"""
{name}_ctx AS (
  SELECT {id_col}, w AS w0, lag(w, 1) OVER k AS p1, lag(w, 2) OVER k AS p2, lag(w, 3) OVER k AS p3, lead(w, 1) OVER k AS n1
  FROM {words} WINDOW k AS (PARTITION BY {id_col} ORDER BY pos)),
{name}_0 AS (
  SELECT c.*, CASE WHEN p1 = 'no' OR p2 = 'no' OR (p3 = 'no' AND p1 IN ('or', 'nor')) THEN l.valence * -0.74
    WHEN w0 = 'no' AND n1 IN (SELECT term FROM lex) THEN 0.0 ELSE l.valence END AS s
  FROM {name}_ctx c JOIN lex l ON l.term = c.w0
  WHERE w0 NOT IN (SELECT term FROM boost)),
{name}_1 AS (
  SELECT c.* EXCLUDE (s), CASE WHEN p1 IS NULL OR p1 IN (SELECT term FROM lex) THEN s
    ELSE (s + coalesce(b.increment, 0) * CASE WHEN s < 0 THEN -1 ELSE 1 END)
      * CASE WHEN p1 IN (SELECT term FROM neg) THEN -0.74 ELSE 1 END END AS s
  FROM {name}_0 c LEFT JOIN boost b ON b.term = p1),
{name}_2 AS (
  SELECT c.* EXCLUDE (s), CASE WHEN p2 IS NULL OR p2 IN (SELECT term FROM lex) THEN s
    ELSE (s + coalesce(b.increment, 0) * 0.95 * CASE WHEN s < 0 THEN -1 ELSE 1 END)
      * CASE WHEN p2 IN (SELECT term FROM neg) THEN -0.74 ELSE 1 END END AS s
  FROM {name}_1 c LEFT JOIN boost b ON b.term = p2),
{name}_3 AS (
  SELECT c.* EXCLUDE (s), CASE WHEN p3 IS NULL OR p3 IN (SELECT term FROM lex) THEN s
    ELSE (s + coalesce(b.increment, 0) * 0.9 * CASE WHEN s < 0 THEN -1 ELSE 1 END)
      * CASE WHEN p1 IN ('so', 'this') THEN 1.25 WHEN p3 IN (SELECT term FROM neg) THEN -0.74 ELSE 1 END END AS s
  FROM {name}_2 c LEFT JOIN boost b ON b.term = p3),
{name}_sum AS (SELECT {id_col}, sum(s) AS s FROM {name}_3 GROUP BY 1),
{name} AS (
  SELECT t.{id_col}, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15.0), 4) AS compound
  FROM {texts} t LEFT JOIN {name}_sum x USING ({id_col}))"""


def _kmeans(name: str, scores: str) -> str:
    """CTE <name>(a, b, c): centroids after a fixed number of Lloyd steps."""
    return f"""
{name}_hist AS MATERIALIZED (SELECT round(compound, 4) AS x, count(*)::DOUBLE AS n FROM {scores} GROUP BY 1),
{name}_steps AS (
  SELECT 0 AS i, (SELECT min(x) FROM {name}_hist) AS a,
    (SELECT min(x) FROM (SELECT x, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total FROM {name}_hist) WHERE upto >= total / 2) AS b,
    (SELECT max(x) FROM {name}_hist) AS c
  UNION ALL
  SELECT i + 1,
    coalesce(sum(CASE WHEN x <= (a + b) / 2 THEN n * x END) / sum(CASE WHEN x <= (a + b) / 2 THEN n END), a),
    coalesce(sum(CASE WHEN x > (a + b) / 2 AND x <= (b + c) / 2 THEN n * x END) / sum(CASE WHEN x > (a + b) / 2 AND x <= (b + c) / 2 THEN n END), b),
    coalesce(sum(CASE WHEN x > (b + c) / 2 THEN n * x END) / sum(CASE WHEN x > (b + c) / 2 THEN n END), c)
  FROM {name}_steps, {name}_hist WHERE i < 60 GROUP BY i, a, b, c),
{name} AS (SELECT a, b, c FROM {name}_steps WHERE i = 60)"""


def _labelled(name: str, scores: str, centres: str) -> str:
    return f"""
{name} AS (
  SELECT s.*, CASE WHEN compound <= (a + b) / 2 THEN 'negative' WHEN compound <= (b + c) / 2 THEN 'neutral' ELSE 'positive' END AS sentiment
  FROM {scores} s, {centres})"""


_STOP = fx.STOP_WORDS + fx.CUSTOM_STOP_WORDS
_LABEL = "CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'Neutral' END"
_LONG = "length(regexp_extract_all(text, '\\S+')) >= 15"
_LETTERS = r"' ' || trim(regexp_replace(lower(clean), '[^\p{L}]+', ' ', 'g')) || ' '"

def _noun_candidates() -> str:
    """Rewrites of word w by each ending rule, as UNION ALL branches with an order."""
    parts = ["SELECT word, word AS form, 0 AS ord FROM words"]
    for i, (ending, new) in enumerate(NOUN_ENDINGS, 1):
        stem = f"left(word, length(word) - {len(ending)})"
        parts.append(f"SELECT word, {stem} || '{new}', {i} FROM words WHERE word LIKE '%{ending}'")
    return " UNION ALL ".join(parts)


def _grams(name: str, texts: str) -> list[str]:
    """CTEs up to <name>_grams(doc_id, lang, n_chars, gram)."""
    return [
        f"{name}_letters AS MATERIALIZED (SELECT doc_id, lang, length(trim(clean)) AS n_chars, {_LETTERS} AS l FROM {texts})",
        f"""{name}_letter_rows AS (
  SELECT doc_id, lang, n_chars, unnest(string_split(l, '')) AS c, generate_subscripts(string_split(l, ''), 1) AS i
  FROM {name}_letters WHERE trim(l) <> '')""",
        f"""{name}_grams AS MATERIALIZED (
  SELECT doc_id, lang, n_chars, gram FROM (
    SELECT doc_id, lang, n_chars, c || lead(c, 1) OVER k || lead(c, 2) OVER k AS gram FROM {name}_letter_rows WINDOW k AS (PARTITION BY doc_id ORDER BY i))
  WHERE gram IS NOT NULL)""",
    ]


def _detected(name: str, out: str, table: str = "lang_lp") -> list[str]:
    """CTE <out>(doc_id, detected_lang) from <name>_grams."""
    return [
        f"""{name}_score AS (
  SELECT g.doc_id, x.lang, sum(g.c * x.lp) AS s
  FROM (SELECT doc_id, gram, count(*) AS c FROM {name}_grams WHERE n_chars >= 10 GROUP BY 1, 2) g JOIN {table} x USING (gram) GROUP BY 1, 2)""",
        f"""{name}_best AS (
  SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 6) DESC, lang) AS rn FROM {name}_score) WHERE rn = 1)""",
        f"{out} AS (SELECT d.doc_id, coalesce(b.lang, 'unknown') AS detected_lang FROM documents d LEFT JOIN {name}_best b USING (doc_id))",
    ]


BASE = ",\n".join(
    part.strip()
    for part in (
        f"lex AS (SELECT term, valence::DOUBLE AS valence FROM (VALUES {_values(fx.VALENCES)}) AS t(term, valence))",
        f"boost AS (SELECT term, increment::DOUBLE AS increment FROM (VALUES {_values(fx.BOOSTERS)}) AS t(term, increment))",
        f"neg AS (SELECT * FROM (VALUES {_values((w,) for w in fx.NEGATORS)}) AS t(term))",
        # marked: one row per document with its duplicate flags
        f"""marked AS (
  SELECT *, is_long AND row_number() OVER (PARTITION BY text, is_long ORDER BY doc_id) > 1 AS is_repeat
  FROM (SELECT *, {_LONG} AS is_long FROM documents))""",
        # all_w: clean words of every document
        _word_rows("all_w", "documents", "doc_id", _cleaned_words("text"), _STOP),
        """all_t AS (
  SELECT d.doc_id, d.lang, d.text, coalesce(t.clean, '') AS clean
  FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS clean FROM all_w GROUP BY 1) t USING (doc_id))""",
        # language grams of the clean texts; profiles come from the training half
        *_grams("all", "all_t"),
        "profile AS MATERIALIZED (SELECT lang, gram, count(*) AS n FROM all_grams WHERE substr(md5(doc_id::VARCHAR), 1, 1) < '8' GROUP BY 1, 2)",
        """lang_size AS (
  SELECT lang, sum(n) + 0.5 * (SELECT count(DISTINCT gram) FROM profile) AS size FROM profile GROUP BY 1)""",
        """lang_lp AS MATERIALIZED (
  SELECT z.lang, v.gram, ln((coalesce(p.n, 0) + 0.5) / z.size) AS lp
  FROM (SELECT DISTINCT gram FROM all_grams) v CROSS JOIN lang_size z LEFT JOIN profile p ON p.gram = v.gram AND p.lang = z.lang)""",
        *_detected("all", "detected"),
        # lemmas, and the languages of the lemmatised texts
        "words AS (SELECT DISTINCT w AS word FROM all_w)",
        f"""lemma_map AS MATERIALIZED (
  SELECT word, form AS lemma FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(form), ord) AS rn
    FROM ({_noun_candidates()}) WHERE form IN (SELECT word FROM words))
  WHERE rn = 1 AND form <> word)""",
        "lem_w AS MATERIALIZED (SELECT doc_id, pos, coalesce(lemma, w) AS w FROM all_w LEFT JOIN lemma_map ON word = w)",
        """lem_t AS (
  SELECT d.doc_id, d.lang, d.text, coalesce(t.clean, '') AS clean
  FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS clean FROM lem_w GROUP BY 1) t USING (doc_id))""",
        *_grams("lem", "lem_t"),
        """lem_lp AS MATERIALIZED (
  SELECT z.lang, v.gram, ln((coalesce(p.n, 0) + 0.5) / z.size) AS lp
  FROM (SELECT DISTINCT gram FROM lem_grams) v CROSS JOIN lang_size z LEFT JOIN profile p ON p.gram = v.gram AND p.lang = z.lang)""",
        *_detected("lem", "lem_detected", "lem_lp"),
        # kept: de-duplicated, non-empty, in the wanted languages
        """kept AS MATERIALIZED (
  SELECT m.doc_id, t.clean, m.text, x.detected_lang FROM marked m JOIN lem_t t USING (doc_id) JOIN lem_detected x USING (doc_id)
  WHERE NOT is_repeat AND trim(t.clean) <> '' AND detected_lang <> 'es')""",
        "kept_w AS MATERIALIZED (SELECT doc_id, pos, w FROM lem_w WHERE doc_id IN (SELECT doc_id FROM kept))",
        _compound("score", "kept", "kept_w", "doc_id"),
        _kmeans("km", "score"),
        _labelled("sent", "score", "km"),
        # the second platform
        "turns AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)",
        f"""turns_first AS (
  SELECT turn_id, text FROM (SELECT *, {_LONG} AS is_long, row_number() OVER (PARTITION BY text ORDER BY turn_id) AS rn FROM turns)
  WHERE NOT is_long OR rn = 1)""",
        _word_rows("turn_w", "turns_first", "turn_id", _cleaned_words("text"), _STOP),
        "turns_kept AS (SELECT DISTINCT turn_id FROM turn_w)",
        _compound("tscore", "turns_kept", "turn_w", "turn_id"),
        _kmeans("tkm", "tscore"),
        _labelled("tsent", "tscore", "tkm"),
        """platforms AS (
  SELECT 'documents' AS platform, doc_id AS id, sentiment FROM sent
  UNION ALL SELECT 'conversations', turn_id, sentiment FROM tsent)""",
        """platform_w AS (
  SELECT 'documents' AS platform, doc_id AS id, w FROM kept_w UNION ALL SELECT 'conversations', turn_id, w FROM turn_w)""",
        # human labels
        f"truth AS (SELECT doc_id, {_LABEL} AS sentiment_true FROM labels)",
        """gold AS (
  SELECT doc_id, CASE lower(sentiment_true) WHEN 'negative' THEN 'negative' WHEN 'positive' THEN 'positive' WHEN 'neutral' THEN 'neutral' END AS label
  FROM truth WHERE sentiment_true IS NOT NULL)""",
        "judged AS (SELECT g.label AS t, s.sentiment AS p FROM gold g JOIN sent s USING (doc_id))",
        """per_class AS (
  SELECT label, tp, support,
    CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
    CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (predicted + support) END AS f1
  FROM (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label) AS support,
          count(*) FILTER (p = label) AS predicted
        FROM judged, (SELECT t AS label FROM judged UNION SELECT p FROM judged) GROUP BY label))""",
        # term statistics
        "all_tc AS MATERIALIZED (SELECT doc_id, w AS term, count(*) AS tf FROM all_w WHERE length(w) >= 2 GROUP BY 1, 2)",
        """feat_w AS (
  SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt
  FROM (SELECT * FROM all_w WHERE length(w) >= 2 AND w NOT IN ('no', 'not', 'or')))""",
        """feat_c AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, w AS term FROM feat_w UNION ALL SELECT doc_id, w || ' ' || nxt FROM feat_w WHERE nxt IS NOT NULL) GROUP BY 1, 2)""",
        """feat_v AS MATERIALIZED (
  SELECT term, df, corpus_tf, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS corpus_tf FROM feat_c GROUP BY 1) WHERE df >= 3
  ORDER BY corpus_tf DESC, term LIMIT 5000)""",
        "dict_n AS (SELECT count(*) AS n FROM documents)",
        """dict AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id, term, df
  FROM (SELECT w AS term, count(DISTINCT doc_id) AS df FROM all_w GROUP BY 1)
  WHERE df >= 10 AND df <= floor(0.5 * (SELECT n FROM dict_n)))""",
        # phrases over the kept documents
        """tm_w AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos, w
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
        FROM (SELECT doc_id, regexp_extract_all(clean, '[a-z_]+') AS ws FROM kept))
  WHERE length(w) BETWEEN 2 AND 15 AND w NOT LIKE '\\_%' ESCAPE '\\')""",
        """tm_p AS MATERIALIZED (
  SELECT doc_id, pos, a, b FROM (SELECT doc_id, pos, w AS a, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tm_w) WHERE b IS NOT NULL)""",
        "tm_1 AS (SELECT w, count(*) AS n FROM tm_w GROUP BY 1)",
        "tm_2 AS (SELECT a, b, count(*) AS n FROM tm_p GROUP BY 1, 2)",
        "tm_size AS (SELECT (SELECT count(*) FROM tm_1) + (SELECT count(*) FROM tm_2) AS v)",
        """phr AS MATERIALIZED (
  SELECT a, b, p.n, (p.n - 10)::DOUBLE / x.n / y.n * (SELECT v FROM tm_size) AS score
  FROM tm_2 p JOIN tm_1 x ON x.w = a JOIN tm_1 y ON y.w = b WHERE (p.n - 10)::DOUBLE / x.n / y.n * (SELECT v FROM tm_size) > 10)""",
        # documents with a topic; vectors are TF-IDF sums over the bits of the terms' MD5
        "topic_docs AS (SELECT doc_id, text, CASE WHEN right(source, 1) = '9' THEN -1 ELSE right(source, 1)::INTEGER END AS topic FROM documents)",
        """term_idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM all_tc GROUP BY 1)""",
        """term_w AS MATERIALIZED (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
  FROM (SELECT doc_id, term, tf * idf AS w FROM all_tc JOIN term_idf USING (term)))""",
        """term_bits AS MATERIALIZED (
  SELECT term, i AS dimension, 1 - 2 * ((('0x' || substr(md5(term), 1 + i // 4, 1))::INTEGER >> (i % 4)) & 1) AS sign
  FROM (SELECT term, unnest(generate_series(0, 15)) AS i FROM term_idf))""",
        """doc_vec AS MATERIALIZED (
  SELECT d.doc_id, d.dimension, coalesce(v.value, 0) AS value
  FROM (SELECT doc_id, unnest(generate_series(0, 15)) AS dimension FROM documents) d
  LEFT JOIN (SELECT doc_id, dimension, sum(weight * sign) AS value FROM term_w JOIN term_bits USING (term) GROUP BY 1, 2) v
    ON v.doc_id = d.doc_id AND v.dimension = d.dimension)""",
        "topic_tc AS MATERIALIZED (SELECT topic, w AS term, count(*) AS n FROM all_w JOIN topic_docs USING (doc_id) GROUP BY 1, 2)",
    )
)


def _q(sql: str) -> str:
    return f"WITH RECURSIVE {BASE}\n{sql.strip()}"


def _class_tfidf(source: str) -> str:
    return f"""
  SELECT topic, term, n / size * ln(1 + mean_size / f) AS weight
  FROM (SELECT * FROM {source}) c
  JOIN (SELECT term, sum(n) AS f FROM (SELECT * FROM {source}) GROUP BY 1) USING (term)
  JOIN (SELECT topic, size, avg(size) OVER () AS mean_size FROM (SELECT topic, sum(n) AS size FROM (SELECT * FROM {source}) GROUP BY 1)) USING (topic)"""


def _split(rows: str, id_col: str, label: str) -> str:
    """CTEs quota and ranked of an exact 80/20 split."""
    return f"""
, counts AS (SELECT {label} AS label, count(*) AS n_rows FROM ({rows}) GROUP BY 1)
, shares AS (SELECT *, n_rows * ceil(round(0.2 * sum(n_rows) OVER (), 6)) / sum(n_rows) OVER () AS share, ceil(round(0.2 * sum(n_rows) OVER (), 6)) AS n_test FROM counts)
, quota AS (SELECT label, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label) <= n_test - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM shares)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat({id_col}, '-42')), {id_col}) AS rn FROM ({rows}))
, parts AS (SELECT r.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part FROM ranked r JOIN quota q ON q.label = r.{label})"""


def _with_split(sql: str, rows: str, id_col: str, label: str) -> str:
    return f"WITH RECURSIVE {BASE}{_split(rows, id_col, label)}\n{sql}"


_COLUMNS = (
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
    ("sentiment_true", "string"),
)
_WITH_TRUTH = "(SELECT d.*, t.sentiment_true FROM documents d LEFT JOIN truth t USING (doc_id))"
_TOKENS = f"string_split({_plain_words('lower(text)')}, ' ')"
_REPORT_AVG = "SELECT '{label}' AS label, {p} AS precision, {r} AS recall, {f} AS f1, sum(support)::BIGINT AS support FROM per_class"
_TOPIC_VALUES = _values((t, w) for t, listed in fx.COHERENCE_TOPICS for w in listed)
_CENTRES = """
, dims AS (SELECT {key} AS topic, i, avg(x) AS m FROM (SELECT {key}, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM {source}) GROUP BY 1, 2)
, centre AS (SELECT topic, list(m ORDER BY i) AS m FROM dims GROUP BY 1)"""

_COHERENCE = """
, sizes AS (SELECT doc_id, count(*) AS n FROM all_w GROUP BY 1)
, occ AS (SELECT doc_id, w, pos, n FROM all_w JOIN sizes USING (doc_id) WHERE w IN (SELECT word FROM topics))
, total AS (SELECT sum(greatest(n - 109, 1))::DOUBLE AS t FROM (SELECT DISTINCT doc_id, n FROM occ))
, wins AS (SELECT DISTINCT doc_id, w, unnest(range(greatest(pos - 109, 0), greatest(least(pos, n - 110), 0) + 1)) AS s FROM occ)
, single AS (SELECT w, count(*) / (SELECT t FROM total) AS p FROM wins GROUP BY 1)
, pairs AS (SELECT x.w AS a, y.w AS b, count(*) / (SELECT t FROM total) AS p FROM wins x JOIN wins y ON x.doc_id = y.doc_id AND x.s = y.s GROUP BY 1, 2)
, cells AS (
  SELECT i.topic, i.word AS w, j.word AS v,
    CASE WHEN si.p IS NULL OR sj.p IS NULL THEN 0.0 ELSE ln((coalesce(q.p, 0) + 1e-12) / (si.p * sj.p)) / -ln(coalesce(q.p, 0) + 1e-12) END AS m
  FROM topics i JOIN topics j USING (topic) LEFT JOIN single si ON si.w = i.word LEFT JOIN single sj ON sj.w = j.word
  LEFT JOIN pairs q ON q.a = i.word AND q.b = j.word)
, sums AS (SELECT topic, v, sum(m) AS total FROM cells GROUP BY 1, 2)
, cosines AS (
  SELECT topic, w, coalesce(sum(m * total) / nullif(sqrt(sum(m * m)) * sqrt(sum(total * total)), 0), 0) AS c
  FROM cells JOIN sums USING (topic, v) GROUP BY 1, 2)
SELECT topic, round(avg(c), 6) AS coherence FROM cosines GROUP BY 1"""

# Distances to the ten nearest different vectors, core distances of five rows, mutual reachability.
_REACHABILITY = """
, point AS MATERIALIZED (SELECT v, min(doc_id) AS node, count(*) AS weight FROM (
  SELECT doc_id, list(round(value, 6) + 0.0 ORDER BY dimension) AS v FROM doc_vec GROUP BY 1) GROUP BY v)
, near AS MATERIALIZED (SELECT * FROM (
  SELECT p.node, o.node AS other, p.weight, o.weight AS others, list_distance(p.v, o.v) AS d,
    row_number() OVER (PARTITION BY p.node ORDER BY list_distance(p.v, o.v), o.node) AS nth
  FROM point p, point o WHERE p.node <> o.node) WHERE nth <= 10)
, core AS MATERIALIZED (SELECT node, CASE WHEN any_value(weight) >= 5 THEN 0.0 ELSE coalesce(min(d) FILTER (near_rows >= 5), max(d)) END AS core FROM (
  SELECT *, weight + sum(others) OVER (PARTITION BY node ORDER BY d, other) AS near_rows FROM near) GROUP BY 1)
, reach AS MATERIALIZED (SELECT least(n.node, n.other) AS a, greatest(n.node, n.other) AS b, min(greatest(n.d, c.core, o.core)) AS w
  FROM near n JOIN core c ON c.node = n.node JOIN core o ON o.node = n.other GROUP BY 1, 2)
"""

ORACLE: dict[str, str] = {
    "scan_reviews": "SELECT doc_id, source, text FROM documents",
    "head_rows": "SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 5",
    "tail_rows": "SELECT doc_id, source, text FROM documents ORDER BY doc_id DESC LIMIT 5",
    "column_profile": _q(
        " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, '{kind}' AS data_type, count({name}) AS non_null FROM {_WITH_TRUTH}"
            for name, kind in _COLUMNS
        )
    ),
    "null_counts": _q(
        " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, count(*) - count({name}) AS n_null FROM {_WITH_TRUTH}" for name, _ in _COLUMNS
        )
    ),
    "source_counts": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "stage_counts": _q(
        """
SELECT position, stage, n_before, n_after, n_before - n_after AS n_removed FROM (
  SELECT unnest([1, 2, 3]) AS position, unnest(['long_duplicates', 'empty_text', 'language']) AS stage,
    unnest([a, b, c]) AS n_before, unnest([b, c, d]) AS n_after
  FROM (SELECT count(*) AS a, count(*) FILTER (NOT is_repeat) AS b, count(*) FILTER (NOT is_repeat AND trim(clean) <> '') AS c,
          count(*) FILTER (NOT is_repeat AND trim(clean) <> '' AND detected_lang <> 'es') AS d
        FROM marked JOIN (SELECT doc_id, clean FROM all_t) USING (doc_id) JOIN detected USING (doc_id)))"""
    ),
    "long_short_split": _q("SELECT doc_id, is_long FROM marked"),
    "raw_duplicates": "SELECT doc_id, text, n_copies FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n_copies FROM documents) WHERE n_copies > 1",
    "long_duplicates": f"SELECT doc_id, text, n_copies FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE {_LONG}) WHERE n_copies > 1",
    "duplicate_groups": f"""
SELECT group_id, doc_id, n_copies FROM (
  SELECT min(doc_id) OVER t AS group_id, doc_id, count(*) OVER t AS n_copies FROM documents WHERE {_LONG} WINDOW t AS (PARTITION BY text))
WHERE n_copies > 1""",
    "dedup_long": _q("SELECT doc_id, text FROM marked WHERE is_long AND NOT is_repeat"),
    "dedup_reviews": _q("SELECT doc_id, text FROM marked WHERE NOT is_repeat"),
    "normalize_brands": f"SELECT doc_id, {_brands('text')} AS text_out FROM documents",
    "strip_emoji": "SELECT doc_id, replace(replace(text, ', ', ''), '.', '') AS text_out FROM documents",
    "strip_urls": f"SELECT page_id, {_urls('html')} AS text_out FROM pages",
    "tokenize": f"SELECT doc_id, array_to_string(t, '|') AS tokens, len(t)::INTEGER AS n_tokens FROM (SELECT doc_id, list_filter({_TOKENS}, lambda w: w <> '') AS t FROM documents)",
    "remove_stopwords": f"SELECT doc_id, array_to_string(list_filter({_TOKENS}, lambda w: w <> '' AND w NOT IN ({_strings(fx.STOP_WORDS)})), '|') AS tokens FROM documents",
    "lemmatize_tokens": _q("SELECT word, lemma FROM lemma_map"),
    "clean_text": _q("SELECT doc_id, clean AS review_cleaned FROM lem_t"),
    "clean_reviews": _q("SELECT doc_id, clean AS review_cleaned, detected_lang FROM kept"),
    "drop_empty": _q("SELECT doc_id FROM all_t WHERE trim(clean) <> ''"),
    "topic_tokens": f"""
SELECT doc_id, array_to_string(t, '|') AS tokens, len(t)::INTEGER AS n_tokens FROM (
  SELECT doc_id, list_filter(regexp_extract_all(translate(lower(text), '{_ACCENTED}', '{_PLAIN}'), '[\\p{{L}}_]+'),
    lambda w: length(w) BETWEEN 2 AND 15 AND left(w, 1) <> '_') AS t FROM documents)""",
    "language_profiles": _q("SELECT lang, gram, n FROM profile"),
    "detect_language": _q("SELECT doc_id, detected_lang FROM detected"),
    "language_counts": _q("SELECT detected_lang, count(*) AS n FROM detected GROUP BY 1"),
    "language_filter": _q("SELECT doc_id, detected_lang FROM detected WHERE detected_lang NOT IN ('es')"),
    "top_words": _q("SELECT w AS word, count(*) AS n FROM kept_w GROUP BY 1 ORDER BY n DESC, word LIMIT 20"),
    "top_words_by_sentiment": _q(
        """
SELECT sentiment, word, n, rank FROM (
  SELECT sentiment, w AS word, count(*) AS n, row_number() OVER (PARTITION BY sentiment ORDER BY count(*) DESC, w)::INTEGER AS rank
  FROM kept_w JOIN sent USING (doc_id) GROUP BY 1, 2) WHERE rank <= 10"""
    ),
    "word_weights": _q(
        """
SELECT sentiment, word, n, rank, round(n / max(n) OVER (PARTITION BY sentiment), 6) AS weight FROM (
  SELECT sentiment, w AS word, count(*) AS n, row_number() OVER (PARTITION BY sentiment ORDER BY count(*) DESC, w)::INTEGER AS rank
  FROM kept_w JOIN sent USING (doc_id) GROUP BY 1, 2) WHERE rank <= 200"""
    ),
    "compound_box_stats": _q(
        """
SELECT sentiment, n_rows, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(compound) FILTER (compound >= q1 - 1.5 * (q3 - q1) AND compound <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(compound) FILTER (compound >= q1 - 1.5 * (q3 - q1) AND compound <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (NOT (compound >= q1 - 1.5 * (q3 - q1) AND compound <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM sent JOIN (SELECT sentiment, count(*) AS n_rows, quantile_cont(compound, 0.25) AS q1, quantile_cont(compound, 0.5) AS median,
  quantile_cont(compound, 0.75) AS q3 FROM sent GROUP BY 1) USING (sentiment) GROUP BY sentiment, n_rows, q1, median, q3"""
    ),
    "platform_sentiment_share": _q(
        """
SELECT platform, sentiment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY platform), 6) AS share
FROM platforms GROUP BY 1, 2"""
    ),
    "platform_top_words": _q(
        """
SELECT platform, word, n, rank FROM (
  SELECT platform, w AS word, count(*) AS n, row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, w)::INTEGER AS rank
  FROM platform_w GROUP BY 1, 2) WHERE rank <= 20"""
    ),
    "sentiment_compound": _q("SELECT doc_id, compound FROM score"),
    "kmeans_centroids": _q(
        """
SELECT s AS sentiment, round(v, 6) AS centroid, (SELECT count(*) FROM sent WHERE sentiment = s) AS n
FROM (SELECT unnest(['negative', 'neutral', 'positive']) AS s, unnest([a, b, c]) AS v FROM km)"""
    ),
    "sentiment_label": _q("SELECT doc_id, compound, sentiment FROM sent"),
    "sentiment_counts": _q("SELECT sentiment, count(*) AS n FROM sent GROUP BY 1"),
    "sentiment_subsets": _q(
        """
SELECT platform, sentiment, count(*) AS n, sum(words)::BIGINT AS n_words FROM platforms
JOIN (SELECT platform, id, count(*) AS words FROM platform_w GROUP BY 1, 2) USING (platform, id) GROUP BY 1, 2"""
    ),
    "standardize_labels": _q(
        f"""
SELECT doc_id, sentiment_true, lower(sentiment_true) AS sentiment_true_clean,
  CASE WHEN sentiment_true = 'positive' THEN NULL ELSE lower(sentiment_true) END AS strict_clean FROM {_WITH_TRUTH}"""
    ),
    "unmapped_labels": _q(
        f"""
SELECT DISTINCT sentiment_true, 'loose' AS preset FROM {_WITH_TRUTH} WHERE sentiment_true IS NULL
UNION ALL SELECT DISTINCT sentiment_true, 'strict' FROM {_WITH_TRUTH} WHERE sentiment_true = 'positive'"""
    ),
    "gold_rows": _q("SELECT doc_id, label AS sentiment_true_clean FROM gold"),
    "label_totals": _q(
        """
SELECT count(*) FILTER (sentiment_true IN ('Negative', 'Neutral')) AS n_labelled, count(*) FILTER (sentiment_true = 'Negative') AS n_negative,
  count(*) FILTER (sentiment_true = 'Neutral') AS n_neutral, count(*) FILTER (sentiment_true = 'Positive') AS n_positive FROM truth"""
    ),
    "stratified_split": _with_split(
        "SELECT doc_id, sentiment_true_clean, part FROM parts",
        "SELECT doc_id, label AS sentiment_true_clean FROM gold", "doc_id", "sentiment_true_clean",
    ),
    "split_by_human_label": _with_split(
        "SELECT doc_id, sentiment_true_clean, part FROM parts",
        "SELECT doc_id, label AS sentiment_true_clean FROM gold JOIN sent USING (doc_id) WHERE label IS NOT NULL", "doc_id", "sentiment_true_clean",
    ),
    "split_by_derived_label": _with_split(
        "SELECT doc_id, sentiment, part FROM parts", "SELECT doc_id, sentiment FROM sent", "doc_id", "sentiment"
    ),
    "split_distribution": _with_split(
        "SELECT part, lang, count(*) AS n FROM parts GROUP BY 1, 2", "SELECT doc_id, lang FROM documents", "doc_id", "lang"
    ),
    "label_index": _q("SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS label_id FROM (SELECT DISTINCT label FROM gold)"),
    "class_weights": _q(
        "SELECT label, count(*) AS n_rows, round((SELECT count(*) FROM gold) / ((SELECT count(DISTINCT label) FROM gold) * count(*)), 6) AS class_weight FROM gold GROUP BY 1"
    ),
    "eval_overall": _q(
        """
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(avg(f1), 6) AS f1_macro, sum(support)::BIGINT AS n_rows FROM per_class"""
    ),
    "classification_report": _q(
        "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (SELECT label, precision, recall, f1, support FROM per_class UNION ALL "
        + " UNION ALL ".join(
            (
                _REPORT_AVG.format(label="accuracy", p="sum(tp) / sum(support)", r="sum(tp) / sum(support)", f="sum(tp) / sum(support)"),
                _REPORT_AVG.format(label="macro avg", p="avg(precision)", r="avg(recall)", f="avg(f1)"),
                _REPORT_AVG.format(
                    label="weighted avg", p="sum(precision * support) / sum(support)",
                    r="sum(recall * support) / sum(support)", f="sum(f1 * support) / sum(support)",
                ),
            )
        )
        + ")"
    ),
    "confusion_counts": _q(
        """
SELECT position, true_label, count(*) FILTER (t = true_label AND p = 'negative') AS negative,
  count(*) FILTER (t = true_label AND p = 'neutral') AS neutral, count(*) FILTER (t = true_label AND p = 'positive') AS positive
FROM judged, (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) AS l(position, true_label) GROUP BY 1, 2"""
    ),
    "confusion_row_pct": _q(
        """
SELECT position, true_label, round(100.0 * count(*) FILTER (t = true_label AND p = 'negative') / nullif(count(*) FILTER (t = true_label), 0), 6) AS negative,
  round(100.0 * count(*) FILTER (t = true_label AND p = 'neutral') / nullif(count(*) FILTER (t = true_label), 0), 6) AS neutral,
  round(100.0 * count(*) FILTER (t = true_label AND p = 'positive') / nullif(count(*) FILTER (t = true_label), 0), 6) AS positive
FROM judged, (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) AS l(position, true_label) GROUP BY 1, 2"""
    ),
    "tfidf_vocab": _q("SELECT term, df, corpus_tf, round(idf, 6) AS idf FROM feat_v"),
    "tfidf_weights": _q(
        """
SELECT doc_id, term, tf, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS weight
FROM feat_c JOIN feat_v USING (term)"""
    ),
    "tfidf_nmf_weights": _q(
        """
SELECT doc_id, term, tf, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS weight
FROM all_tc JOIN (SELECT term, ln((1.0 + (SELECT n FROM dict_n)) / (1.0 + count(*))) + 1.0 AS idf FROM all_tc GROUP BY 1
  HAVING count(*) >= 10 AND count(*) <= 0.95 * (SELECT n FROM dict_n)) USING (term)"""
    ),
    "row_numbers": "SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS row_number FROM documents",
    "argmax_class": f"""
SELECT vec_id, (list_position(s, list_max(s)) - 1)::INTEGER AS predicted FROM (
  SELECT vec_id, list(embedding[i]::DOUBLE - 0.5 * embedding[i + {fx.N_SCORES}]::DOUBLE ORDER BY i) AS s
  FROM embeddings, range(1, {fx.N_SCORES + 1}) AS r(i) GROUP BY 1)""",
    "phrase_scores": _q("SELECT a, b, n, round(score, 6) AS score FROM phr"),
    # Non-overlapping from the left: in a run of neighbouring hits every second one, from the first.
    "merge_phrases": _q(
        """
, hits AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM tm_p JOIN phr USING (a, b))
, taken AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS k FROM hits) WHERE k % 2 = 1)
, merged AS (
  SELECT t.doc_id, t.pos, CASE WHEN h.pos IS NULL THEN t.w ELSE t.w || '_' || n.w END AS w
  FROM tm_w t LEFT JOIN taken h ON h.doc_id = t.doc_id AND h.pos = t.pos LEFT JOIN tm_w n ON n.doc_id = t.doc_id AND n.pos = t.pos + 1
  LEFT JOIN taken e ON e.doc_id = t.doc_id AND e.pos = t.pos - 1 WHERE e.pos IS NULL)
SELECT k.doc_id, coalesce(m.merged, '') AS merged FROM kept k
LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS merged FROM merged GROUP BY 1) m USING (doc_id)"""
    ),
    "vocabulary": _q("SELECT term_id::INTEGER AS term_id, term, df FROM dict"),
    "bag_of_words": _q("SELECT doc_id, w AS term, count(*) AS n FROM all_w WHERE w IN (SELECT term FROM dict) GROUP BY 1, 2"),
    "topic_coherence": _q(f", topics AS (SELECT * FROM (VALUES {_TOPIC_VALUES}) AS t(topic, word))" + _COHERENCE),
    "embedding_coherence": _q(
        f"""
, topics AS (SELECT topic, term AS word FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM ({_class_tfidf('topic_tc')})) WHERE rank <= 8)"""
        + _COHERENCE
    ),
    "reassign_topics": _q(
        """
, centre AS (SELECT topic, list(m ORDER BY dimension) AS m FROM (
  SELECT topic, dimension, avg(value) AS m FROM doc_vec JOIN topic_docs USING (doc_id) WHERE topic <> -1 GROUP BY 1, 2) GROUP BY 1)
, docv AS (SELECT doc_id, list(value ORDER BY dimension) AS v FROM doc_vec GROUP BY 1)
SELECT doc_id, topic::INTEGER AS topic FROM (
  SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_distance(v, m), 6), topic) AS rn FROM docv, centre) WHERE rn = 1"""
    ),
    "class_tfidf_words": _q(
        f"""
SELECT topic, rank, term, round(weight, 6) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term)::INTEGER AS rank FROM ({_class_tfidf('topic_tc')}))
WHERE rank <= 15"""
    ),
    "merge_topic_step": _q(
        f"""
, real AS (SELECT * FROM topic_tc WHERE topic <> -1)
, cw AS MATERIALIZED ({_class_tfidf('real')})
, small AS (SELECT topic FROM real GROUP BY 1 ORDER BY sum(n), topic DESC LIMIT 1)
SELECT (SELECT topic FROM small)::INTEGER AS merged, o.topic::INTEGER AS into, round(sum(o.weight * coalesce(s.weight, 0)) / (sqrt(sum(o.weight * o.weight))
  * (SELECT sqrt(sum(weight * weight)) FROM cw WHERE topic = (SELECT topic FROM small))), 6) AS similarity
FROM cw o LEFT JOIN (SELECT term, weight FROM cw WHERE topic = (SELECT topic FROM small)) s USING (term)
WHERE o.topic <> (SELECT topic FROM small) GROUP BY o.topic ORDER BY similarity DESC, into LIMIT 1"""
    ).replace(" AS into", ' AS "into"').replace("DESC, into", 'DESC, "into"'),
    "topic_sizes": _q("SELECT topic, count(*) AS n FROM topic_docs GROUP BY 1"),
    "doc_vectors": _q("SELECT doc_id, dimension::INTEGER AS dimension, round(value, 6) AS value FROM doc_vec"),
    "representative_docs": _q(
        """
, centre AS (SELECT topic, list(m ORDER BY dimension) AS m FROM (
  SELECT topic, dimension, avg(value) AS m FROM doc_vec JOIN topic_docs USING (doc_id) GROUP BY 1, 2) GROUP BY 1)
, docv AS (SELECT doc_id, list(value ORDER BY dimension) AS v FROM doc_vec GROUP BY 1)
SELECT topic, rank, doc_id, similarity, substr(text, 1, 200) AS text FROM (
  SELECT topic, doc_id, text, similarity, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, doc_id)::INTEGER AS rank
  FROM (SELECT d.topic, doc_id, text, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 THEN 0 ELSE round(list_cosine_similarity(v, m), 6) END AS similarity
        FROM topic_docs d JOIN docv USING (doc_id) JOIN centre c ON c.topic = d.topic WHERE d.topic <> -1)) WHERE rank <= 3"""
    ),
    "reachability_graph": _q(f"{_REACHABILITY} SELECT a, b, round(w, 6) AS w FROM reach"),
    "reachability_components": _q(
        f"""{_REACHABILITY}
, low AS MATERIALIZED (SELECT a, b FROM reach WHERE w <= (SELECT avg(w) FROM reach))
, links AS MATERIALIZED (SELECT a, b FROM low UNION SELECT b, a FROM low)
, met(node, other) AS (SELECT DISTINCT a, a FROM links UNION SELECT m.node, l.b FROM met m JOIN links l ON l.a = m.other)
SELECT node, min(other) AS root FROM met GROUP BY 1"""
    ),
    "topic_membership": _q(
        _CENTRES.format(key="label", source="embeddings")
        + """
, z AS (SELECT vec_id, topic, exp(-list_distance(embedding::DOUBLE[], m)) AS e FROM embeddings, centre)
SELECT vec_id, topic, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM z"""
    ),
}
