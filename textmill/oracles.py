"""DuckDB SQL of the refiner's queries. Lines of the added text end with \\n only, so they are split there."""

from __future__ import annotations

import re

from textmill import semantics as S
from textmill.operators.refine import COUNTERS
from textmill.plans import retrieval as P
from textmill.queries import DIRT

D = f"d AS (SELECT doc_id, {DIRT} AS text FROM documents)"
C = "d AS (SELECT doc_id, text FROM documents)"


def _lines(source: str = "d", out: str = "l") -> str:
    parts = f"SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts FROM {source} WHERE text <> ''"
    return f"{out} AS (SELECT doc_id, (i - 1)::INT AS line_idx, parts[i] AS line FROM ({parts}), unnest(range(1, len(parts) + 1)) AS u(i))"


LINES = f"WITH {D}, {_lines()}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def has(x: str, pattern: str, options: str = "") -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}'{f', {chr(39)}{options}{chr(39)}' if options else ''})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def gone(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


def digest(name: str, x: str) -> str:
    return f"length({x})::INT AS {name}_len, md5({x}) AS {name}_md5"


BARE = strip("line")
PRIVATE, ZERO_WIDTH, REPLACED, CONTROL = "[\\x{E000}-\\x{F8FF}]", "[\\x{200B}-\\x{200D}\\x{2060}]", "[\\x{FFFD}\\x{FFFE}]", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
INVISIBLE = "[\\x{AD}\\x{FEFF}\\x{FE00}-\\x{FE0F}]"
POLLUTION = {"glyphs": count("text", S.GLYPH), "escaped_glyphs": count("text", S.GLYPH_ESCAPED), "privates": count("text", PRIVATE), "cids": count("text", S.CID), "replacements": count("text", REPLACED), "entities": count("text", S.ENTITY)}

BOILERPLATE = has(BARE, S.BOILERPLATE, "i")
SINGLE = has(BARE, "^[\\p{L}\\p{N}]$")


def share(part: str, x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN 0.0 ELSE ({part})::DOUBLE / length({x}) END)"


def letters(x: str) -> str:
    return count(x, "\\p{L}")


def digits(x: str) -> str:
    return count(x, "\\p{Nd}")


def punctuation(x: str) -> str:
    return count(x, "[^\\p{L}\\p{N}\\s]")


_MARKS, _LETTERS = share(f"{digits(BARE)} + {punctuation(BARE)}", BARE), share(letters(BARE), BARE)
AXIS = (
    f"(length({BARE}) >= 12 AND NOT {has(BARE, S.CAPTION, 'i')} AND NOT {has(BARE, S.UNITS, 'i')} AND {count(BARE, '[A-Za-z]{3,}')} < 3 AND "
    f"(({count(BARE, chr(92) + 's')} <= 1 AND length({BARE}) >= 36 AND {_MARKS} >= 0.75 AND {_LETTERS} <= 0.10) OR ({_MARKS} >= 0.85 AND {_LETTERS} <= 0.08)))"
)
_WORD = "[A-Za-z0-9][A-Za-z0-9&/\\-]*"


def navigation(x: str) -> str:
    upper = f"len(list_filter(regexp_extract_all(c, '{_WORD}'), lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]') AND length(w) >= 3)) > 0"
    return f"(len(list_filter(string_split_regex({strip(x)}, '\\s{{2,}}'), lambda c: c <> '' AND {upper})) >= 3)"


DOTTED = has(BARE, S.DOTTED)
NAMES = "(" + ", ".join(f"'{n}'" for n in S.REFERENCE_NAMES) + ")"
HEAD = has(BARE, "^(references|bibliography|références)([^\\p{L}\\p{N}_]|$)", "i")
MARKER, SEPARATOR, ENTRY = has(BARE, S.PAGE_MARKER, "i"), has(BARE, S.SEPARATOR), has(BARE, S.REFERENCE_ENTRY)
TABLE = has("line", "^\\s*\\|.*\\|", "s")
TERMINAL_PATTERN = "[.?!:;)\\]}\"'']\\s*$"


def terminal(x: str) -> str:
    return f"regexp_matches({x}, '{TERMINAL_PATTERN}')"


def split_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


_W = split_words(BARE)
TITLE = (
    f"(length({BARE}) BETWEEN 3 AND 90 AND right({BARE}, 1) <> '-' AND NOT {terminal(BARE)} AND NOT {TABLE} AND NOT {has(BARE, S.CAPTION, 'i')} AND (lower({BARE}) IN {NAMES} OR "
    f"(len({_W}) <= 8 AND regexp_matches({BARE}, '^\\P{{L}}*(\\p{{Lu}}|\\p{{Lt}}|\\p{{Lm}}|\\p{{Lo}})') AND {_LETTERS} >= 0.55 AND {digits(BARE)} <= greatest(3, length({BARE}) // 12) AND "
    f"(len({_W}) <= 3 OR len(list_filter({_W}, lambda w: regexp_matches(w, '^\\p{{Lu}}')))::DOUBLE / greatest(len({_W}), 1) >= 0.85) AND len(list_filter({_W}, lambda w: length(w) >= 5)) <= 3)))"
)
KEY = f"regexp_replace({BARE}, '[ \\t]+', ' ', 'g')"


def guarded(x: str) -> str:
    w = split_words(x)
    return (
        f"(CASE WHEN {has(x, S.CAPTION, 'i')} OR {has(x, S.DOTTED)} THEN true WHEN regexp_matches({x}, '[.?!;]$') THEN false WHEN len({w}) < 1 OR len({w}) > 6 THEN false "
        f"WHEN length({x}) < 8 THEN true ELSE NOT contains({x}, '://') AND regexp_matches({x}, '^\\p{{L}}') AND NOT regexp_matches({x}, ' (\\||-|--|/) ') AND {letters(x)} > 0 "
        f"AND {share(letters(x), x)} >= 0.65 AND {digits(x)} <= 3 AND len({w}) <= 4 END)"
    )


BULLET = "^\\s*[•*·∙‧■▪●◦—-]\\s*"
RUNS = (
    "{l}k AS (SELECT *, CASE WHEN " + SINGLE + " THEN 'single' WHEN " + AXIS + " THEN 'axis' ELSE 'other' END AS kind FROM {l}), "
    "{l}r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_idx) AS run FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY line_idx) <> kind THEN 1 ELSE 0 END AS new FROM {l}k)), "
    "{l}n AS (SELECT *, run_length >= CASE kind WHEN 'single' THEN 8 WHEN 'axis' THEN 4 ELSE 1000000000 END AS noise FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS run_length FROM {l}r))"
)
BLOCKS = (
    "{l}a AS (SELECT *, " + BARE + " = '' AS blank FROM {l}), "
    "{l}b AS (SELECT *, " + SEPARATOR + " OR (blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_idx), false)) AS ends FROM {l}a), "
    "{l}c AS (SELECT *, sum(CASE WHEN ends OR " + MARKER + " THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS island FROM {l}b), "
    "{l}d AS (SELECT *, count(*) FILTER (NOT blank AND NOT ends) OVER (PARTITION BY doc_id, island) AS n, count(*) FILTER (NOT blank AND NOT ends) OVER (PARTITION BY doc_id, island ORDER BY line_idx) AS before FROM {l}c), "
    "{l}e AS (SELECT doc_id, line_idx, line, blank, (dense_rank() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INT AS block FROM {l}d WHERE NOT ends AND before > 0 AND n >= 12)"
)
HEADERS = (
    BLOCKS + ", {l}f AS (SELECT doc_id, line_idx, block, " + KEY + " AS key FROM {l}e WHERE NOT blank), "
    "{l}g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_idx) AS top, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_idx DESC) AS bottom FROM {l}f), "
    "{l}h AS (SELECT *, (top <= 2 OR bottom <= 2) AND length(key) BETWEEN 12 AND 160 AND NOT " + has("key", S.CAPTION, "i") + " AND NOT " + guarded("key") + " AND NOT " + navigation("key") + " AS edge FROM {l}g), "
    "{l}i AS (SELECT doc_id, key, count(DISTINCT block) AS everywhere, count(DISTINCT block) FILTER (edge) AS edges FROM {l}h GROUP BY ALL), "
    "{l}j AS (SELECT doc_id, max(block) + 1 AS blocks FROM {l}h GROUP BY doc_id), "
    "{l}x AS (SELECT doc_id, line_idx, block, everywhere::INT AS repeat_count, round(edges / blocks, 9) AS edge_hit_ratio FROM {l}h JOIN {l}i USING (doc_id, key) JOIN {l}j USING (doc_id) "
    "WHERE edge AND blocks >= 2 AND edges >= 6 AND edges = everywhere AND edges / blocks >= 0.8)"
)
DECIDED = (
    LINES + ", p0 AS (SELECT * FROM l WHERE NOT " + BOILERPLATE + "), " + RUNS.replace("{l}", "p0") + ", p1 AS (SELECT doc_id, line_idx, line FROM p0n WHERE NOT noise), "
    "p2 AS (SELECT * FROM p1 WHERE NOT " + navigation("line") + "), " + HEADERS.replace("{l}", "p2") + ", p3 AS (SELECT * FROM p2 ANTI JOIN p2x USING (doc_id, line_idx)), "
    "p4 AS (SELECT *, max(CASE WHEN " + HEAD + " THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS refs FROM p3), "
    "c AS (SELECT l.doc_id, l.line_idx, l.line, CASE WHEN p0.line IS NULL THEN 'boilerplate' WHEN p1.line IS NULL THEN 'layout_noise' WHEN p2.line IS NULL THEN 'toc_navigation' "
    "WHEN p4.line IS NULL THEN 'header_footer' WHEN p4.refs = 1 THEN 'references_section' WHEN " + DOTTED.replace("line", "l.line") + " THEN 'toc' ELSE 'other' END AS category "
    "FROM l LEFT JOIN p0 USING (doc_id, line_idx) LEFT JOIN p1 USING (doc_id, line_idx) LEFT JOIN p2 USING (doc_id, line_idx) LEFT JOIN p4 USING (doc_id, line_idx))"
)
CHUNKS = "{o} AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_index, s::INT AS start_char, least(s + 900, length(text))::INT AS end_char, substring(text, s + 1, 900) AS chunk FROM {i}, unnest(range(0, length(text), 780)) AS u(s) WHERE regexp_matches(substring(text, s + 1, 900), '\\S'))"


def embedding(source: str, ids: str, text: str, out: str) -> str:
    token = f"SELECT {ids}, lower(unnest(regexp_extract_all({text}, '{P.TOKEN}'))) AS t FROM {source}"
    signed = f"SELECT {ids}, (('0x' || substr(sha1(t), 1, 8))::BIGINT % 768)::INT AS dim, (CASE WHEN ('0x' || substr(sha1(t), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE * (1.0 + least(length(t), 20)::DOUBLE / 40.0) AS v FROM ({token})"
    sums = f"SELECT {ids}, dim, sum(v) AS w FROM ({signed}) GROUP BY ALL"
    return f"{out} AS (SELECT {ids}, dim, CASE WHEN norm > 0 THEN w / norm ELSE 0.0 END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {ids})) AS norm FROM ({sums})))"


TOPK = (
    f"WITH {C}, {CHUNKS.replace('{i}', 'd').replace('{o}', 'k')}, {embedding('k', 'doc_id, chunk_index', 'chunk', 'v')}, q0 AS (SELECT item_id AS qid, text FROM benchmark), {embedding('q0', 'qid', 'text', 'q')}, "
    "s AS (SELECT qid, doc_id, chunk_index, round(sum(q.weight * v.weight), 9) AS score FROM q JOIN v USING (dim) GROUP BY ALL), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_index) AS rank FROM s QUALIFY rank <= 10)"
)
UNIQUE = TOPK + ", b AS (SELECT qid, doc_id, min(rank) AS best FROM t GROUP BY ALL), r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY best) AS rank FROM b)"
SENTENCE_CTES = (
    f"z0 AS (SELECT doc_id, string_split(regexp_replace({strip('regexp_replace(replace(text, chr(10), chr(32)), chr(91) || chr(32) || chr(9) || chr(93) || chr(43), chr(32), chr(103))')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d), "
    "s AS (SELECT doc_id, (i - 1)::INT AS pos, parts[i] AS sentence FROM z0, unnest(range(1, len(parts) + 1)) AS u(i) WHERE regexp_matches(parts[i], '\\S')), "
    f"k AS (SELECT *, regexp_extract_all(sentence, '{P.TOKEN}') AS t FROM s)"
)
SENTENCES = f"WITH {C}, {SENTENCE_CTES}"
_ACRONYM = "regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*$') AND length(x) > 1"
INFORMATIVE = (
    f"CASE WHEN len(t) BETWEEN 12 AND 30 AND NOT regexp_matches(lower(sentence), '{P.BOILERPLATE_TERMS}') THEN round(0.4::DOUBLE * len(list_filter(t, lambda x: regexp_matches(x, '^[A-Z]'))) + 0.9::DOUBLE * len(list_filter(t, lambda x: {_ACRONYM})) "
    "+ 0.8::DOUBLE * len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) + 0.2::DOUBLE * len(list_filter(t, lambda x: length(x) >= 7)) + len(list_distinct(list_transform(t, lambda x: lower(x)))) / greatest(len(t), 1), 6) ELSE -1.0 END"
)
_SCORED = (
    f"{{{{'s': -round((CASE WHEN regexp_matches(x, '^[A-Z]') THEN 1.0 ELSE 0.0 END + CASE WHEN {_ACRONYM} THEN 1.2 ELSE 0.0 END + CASE WHEN regexp_matches(x, '[0-9]') THEN 1.1 ELSE 0.0 END)::DOUBLE + least(length(x), 12) / 20, 6), 'l': lower(x), 't': x}}}}"
).replace("{{", "{").replace("}}", "}")
_STOP = "(" + ", ".join(f"'{w}'" for w in P.STOPLIST) + ")"
_BEST = f"list_transform(list_sort(list_transform(list_filter(t, lambda x: lower(x) NOT IN {_STOP}), lambda x: {_SCORED}))[1:8], lambda x: x.t)"
FOCUS = f"array_to_string(CASE WHEN len({_BEST}) > 0 THEN {_BEST} ELSE t[1:8] END, ' ')"
SAFE_LINE = f"regexp_replace(CASE WHEN {TABLE} THEN line ELSE regexp_replace(line, '[ \\t]+', ' ', 'g') END, '\\s+$', '')"


def _safe(source_lines: str) -> str:
    return f"SELECT doc_id, regexp_replace(string_agg({SAFE_LINE}, chr(10) ORDER BY line_idx), '^\\n+|\\n+$', '', 'g') AS safe FROM {source_lines} GROUP BY doc_id"


PROFILE = (
    "{0}, m AS (SELECT doc_id, count(*) AS n, sum(length(b)) / count(*) AS mean, count(*) FILTER (length(b) >= 120) AS long, count(*) FILTER (length(b) < 45) / count(*) AS short, count(*) FILTER (length(b) = 1) / count(*) AS single "
    "FROM (SELECT doc_id, " + BARE + " AS b FROM l) WHERE b <> '' GROUP BY doc_id), "
    "f AS (SELECT doc_id, length(text) AS size, " + " + ".join(f"({POLLUTION[c]} > 0)::INT" for c in list(POLLUTION)[:5]) + f" + ({POLLUTION['entities']} >= 4)::INT AS signals, "
    + count("text", "-\\n[a-z]") + " AS hyphens, " + count("text", S.BROKEN_WORDS) + " AS broken, " + count("text", "[\\p{Cf}\\p{Co}\\x00-\\x08\\x0e-\\x1b\\x7f]") + " / greatest(length(text), 1) AS odd, "
    "(" + " + ".join(count("text", f"{c}{{5,}}") for c in [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789=_#%!&<>,:; ", "\\.", "\\*", "\\$", "-"]) + ") AS runs FROM d), "
    "g AS (SELECT doc_id, CASE WHEN size < 240 OR coalesce(n, 0) < 8 THEN 'unknown' "
    "WHEN long >= 3 AND short <= 0.30 AND mean >= 85 AND signals = 0 AND hyphens = 0 AND odd < 0.0005 AND runs = 0 AND broken <= 1 AND single <= 0.02 THEN 'clean_web' "
    "WHEN signals >= 2 OR (signals >= 1 AND hyphens >= 2) THEN 'pdf_like' "
    "WHEN (odd >= 0.0025 AND short >= 0.45) OR (runs >= 3 AND short >= 0.40) OR (broken >= 6 AND short >= 0.45) OR (single >= 0.10 AND short >= 0.55) THEN 'ocr_like' ELSE 'unknown' END AS profile FROM f LEFT JOIN m USING (doc_id))"
)
def gated(test: str) -> str:
    return {"on": "true", "off": "false", "auto": "scanned"}[test]


def unescaped(x: str) -> str:
    for name, c in (("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&quot;", "chr(34)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {c})"
    return x


TYPOGRAPHIC = "translate({0}, '" + S.TYPE_FROM + "', '" + S.TYPE_TO.replace("'", "''") + "')"
EXTRACTED = gone(TYPOGRAPHIC.format(f"translate({gone(unescaped('text'), S.GLYPH, S.CID)}, '{S.PRIVATE_BULLETS}', '{'•' * len(S.PRIVATE_BULLETS)}')"), PRIVATE, ZERO_WIDTH, INVISIBLE, CONTROL, REPLACED)
POLLUTED = "(" + " OR ".join(f"{POLLUTION[c]} > 0" for c in list(POLLUTION)[:5]) + f" OR {POLLUTION['entities']} >= 3)"


def title_of(x: str) -> str:
    return re.sub(r"\bline\b", x, TITLE)


def table_of(x: str) -> str:
    return re.sub(r"\bline\b", x, TABLE)


def folded(source: str, out: str, tables: bool) -> str:
    """Wrapped lines of source (doc_id, i from 1 without gaps, line) joined: out (doc_id, i, line, ev), a row per paragraph; ev counts (hyphens, merges)."""
    tail, head = strip("n.line"), strip("r.cur")
    either = f"{table_of('r.cur')} OR {table_of('n.line')} OR " if tables else ""
    apart = f"(r.cur LIKE '## %' OR {tail} LIKE '## %' OR {either}{title_of('r.cur')} OR {title_of('n.line')})"
    lefts, rights = "regexp_replace(n.line, '^\\s+', '')", "regexp_replace(r.cur, '\\s+$', '')"
    hyphen = f"(right({head}, 1) = '-' AND regexp_matches({lefts}, '^\\p{{Ll}}'))"
    merge = f"(NOT {terminal('r.cur')} AND regexp_matches(n.line, '^[^\\p{{L}}\\p{{Nd}}]*\\p{{Ll}}'))"
    return (
        f"{out}r AS (SELECT doc_id, i, line AS cur, 1 AS part, 0 AS hy, 0 AS me FROM {source} WHERE i = 1 UNION ALL "
        f"SELECT doc_id, i, CASE k WHEN 1 THEN left(rs, length(rs) - 1) || ls WHEN 2 THEN rs || ' ' || ls ELSE line END, part + (k = 0)::INT, hy + (k = 1)::INT, me + (k = 2)::INT FROM "
        f"(SELECT n.doc_id, n.i, n.line, r.part, r.hy, r.me, {lefts} AS ls, {rights} AS rs, CASE WHEN {apart} THEN 0 WHEN {hyphen} THEN 1 WHEN {merge} THEN 2 ELSE 0 END AS k FROM {out}r r JOIN {source} n ON n.doc_id = r.doc_id AND n.i = r.i + 1)), "
        f"{out} AS (SELECT doc_id, part AS i, arg_max(cur, i) AS line, max(hy) AS hy, max(me) AS me FROM {out}r GROUP BY doc_id, part)"
    )


def refined(out: str, profile: str = "safe", extracted: str = "auto", noise: str = "auto", repeated: str = "off", references: str = "off", structure: str = "off", collapse: bool = True, pre: str = "") -> str:
    """CTEs after PROFILE's (d, l, m, f, g): {out} (doc_id, text, input_len, counters.., hy, me) of a preset. pre: names them apart."""
    q = pre + out
    ext = {"auto": f"(profile IN ('pdf_like', 'ocr_like') OR {POLLUTED})", "on": "true", "off": "false"}[extracted]
    keeps = profile != "strict"
    drops = DOTTED if profile != "markdown_safe" else "false"
    bullet = "-" if profile == "markdown_safe" else "•"
    line = f"regexp_replace(CASE WHEN {TABLE} THEN line ELSE regexp_replace(line, '[ \\t]+', ' ', 'g') END, '\\s+$', '')"
    ctes = [
        f"{q}x AS (SELECT d.doc_id, text, coalesce(profile, 'unknown') AS profile, text <> '' AND {ext} AS ext FROM d LEFT JOIN g USING (doc_id))",
        f"{q}b AS (SELECT doc_id, ext, profile, {gone(f'CASE WHEN ext THEN {EXTRACTED} ELSE {TYPOGRAPHIC.format(chr(116) + chr(101) + chr(120) + chr(116))} END', PRIVATE, CONTROL, ZERO_WIDTH)} AS text FROM {q}x)",
        _lines(f"{q}b", f"{q}l"),
        f"{q}t AS (SELECT {q}l.*, ext, profile, ext AND profile IN ('pdf_like', 'ocr_like') AS scanned FROM {q}l JOIN {q}x USING (doc_id))",
        f"{q}p AS (SELECT * FROM {q}t WHERE NOT (ext AND {BOILERPLATE}))",
        RUNS.replace("{l}", f"{q}p"),
        f"{q}q AS (SELECT doc_id, line_idx, line, ext, profile, scanned FROM {q}pn WHERE NOT ({gated(noise)} AND noise))",
        f"{q}u AS (SELECT * FROM {q}q WHERE NOT (ext AND profile <> 'clean_web' AND {navigation('line')}))",
        HEADERS.replace("{l}", f"{q}u"),
        f"{q}v AS (SELECT * FROM {q}u WHERE NOT ({gated(repeated)} AND (doc_id, line_idx) IN (SELECT (doc_id, line_idx) FROM {q}ux)))",
        f"{q}w AS (SELECT *, max(CASE WHEN {gated(references)} AND {HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS refs FROM {q}v)",
        f"{q}y AS (SELECT doc_id, line_idx, regexp_replace(line, '{BULLET}', '{bullet} ') AS line FROM {q}w WHERE refs = 0 AND NOT {drops})",
        f"{q}n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS i, line FROM {q}y)",
    ]
    last = f"{q}n"
    if structure != "off":
        ctes.append(folded(last, f"{q}o", keeps))
        last = f"{q}o"
    else:
        ctes.append(f"{q}o AS (SELECT *, 0 AS hy, 0 AS me FROM {last})")
        last = f"{q}o"
    if structure == "aggressive":
        ctes += [
            f"{q}ma AS (SELECT *, {title_of('line')} AND coalesce({strip('lag(line) OVER (PARTITION BY doc_id ORDER BY i)')} <> '## SECTION: ' || {BARE}, true) AS titled FROM {last})",
            f"{q}mb AS (SELECT doc_id, i, 1 AS part, line FROM {q}ma UNION ALL SELECT doc_id, i, 0, '## SECTION: ' || {BARE} FROM {q}ma WHERE titled)",
            f"{q}mc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS i, count(*) OVER (PARTITION BY doc_id) AS n, line FROM {q}mb)",
            f"{q}md AS (SELECT doc_id, coalesce(min(i) FILTER (lower({BARE}) IN {NAMES}), CASE WHEN count(*) FILTER (i > n - 50 AND {ENTRY}) >= 5 THEN min(i) FILTER (i > n - 50 AND {ENTRY}) END) AS at FROM {q}mc GROUP BY doc_id)",
            f"{q}me AS (SELECT doc_id, i, 1 AS part, line, 0 AS hy, 0 AS me FROM {q}mc UNION ALL SELECT doc_id, {q}md.at, 0, '## REFERENCES', 0, 0 FROM {q}md WHERE {q}md.at IS NOT NULL)",
        ]
        last = f"{q}me"
    order = "i, part" if structure == "aggressive" else "i"
    ctes.append(f"{q}j AS (SELECT doc_id, string_agg({line if keeps else 'line'}, chr(10) ORDER BY {order}) AS text FROM {last} GROUP BY doc_id)")
    text = "regexp_replace(text, '^\\n+|\\n+$', '', 'g')" if keeps else strip("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')")
    if collapse:
        text = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    gap = lambda a, b: f"coalesce((SELECT count(*) FROM {q}{a} z WHERE z.doc_id = {q}x.doc_id), 0) - coalesce((SELECT count(*) FROM {q}{b} z WHERE z.doc_id = {q}x.doc_id), 0)"
    ctes.append(
        f"{out} AS (SELECT {q}x.doc_id, coalesce({gone(text.replace('text', f'{q}j.text', 1), PRIVATE, CONTROL, ZERO_WIDTH, REPLACED)}, '') AS text, length({q}x.text)::INT AS input_len, ext AS normalized_extracted, profile AS text_profile, "
        f"({gap('t', 'p')})::INT AS removed_boilerplate_lines, ({gap('p', 'q')})::INT AS removed_layout_noise_lines, ({gap('u', 'v')})::INT AS removed_header_footer_lines, ({gap('u', 'v')})::INT AS removed_repeated_lines, "
        f"coalesce((SELECT sum(refs) FROM {q}w z WHERE z.doc_id = {q}x.doc_id), 0)::INT AS removed_references_lines, (coalesce((SELECT count(*) FROM {q}w z WHERE z.doc_id = {q}x.doc_id AND refs = 0), 0) - coalesce((SELECT count(*) FROM {q}y z WHERE z.doc_id = {q}x.doc_id), 0))::INT AS removed_toc_lines, "
        f"(SELECT count(*) FROM {q}t z WHERE z.doc_id = {q}x.doc_id) AS n_lines, coalesce((SELECT max(hy) FROM {q}o z WHERE z.doc_id = {q}x.doc_id), 0) AS hy, coalesce((SELECT max(me) FROM {q}o z WHERE z.doc_id = {q}x.doc_id), 0) AS me FROM {q}x LEFT JOIN {q}j USING (doc_id))"
    )
    return ", ".join(ctes)


def refined_sql(select: str = "", **setting: str) -> str:
    columns = "doc_id, text, input_len, length(text)::INT AS output_len, normalized_extracted, text_profile, " + ", ".join(c for c in COUNTERS)
    recursive = PROFILE.replace("{0}", LINES).replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{recursive}, {refined('z', **setting)} SELECT {select or columns} FROM z"


def questions() -> str:
    """CTEs over d (doc_id, text): qs (qid, doc_id, question, answer)."""
    tokens = lambda x: f"regexp_extract_all({x}, '{P.TOKEN}')"
    return (
        f"{SENTENCE_CTES}, qa AS (SELECT *, lower(sentence) AS low, {INFORMATIVE} AS score FROM k), "
        "qb AS (SELECT *, max(score) OVER (PARTITION BY doc_id, low) AS best, row_number() OVER (PARTITION BY doc_id, low ORDER BY score DESC, pos) AS copy FROM qa), "
        f"qc AS (SELECT *, best < 0 AND len(t) BETWEEN 10 AND 35 AND NOT regexp_matches(lower(sentence), '{P.BOILERPLATE_TERMS}') AND regexp_matches(sentence, '\\S') AS spare FROM qb), "
        "qd AS (SELECT * FROM qc WHERE copy = 1 AND (score >= 0 OR spare)), "
        "qe AS (SELECT *, count(*) FILTER (score >= 0) OVER (PARTITION BY doc_id) AS strong, row_number() OVER (PARTITION BY doc_id ORDER BY spare, CASE WHEN NOT spare THEN -score END, pos) AS n FROM qd), "
        f"qf AS (SELECT *, row_number() OVER (ORDER BY doc_id, n) AS number FROM qe WHERE n <= CASE WHEN strong >= {P.LEAST} THEN least(strong, {P.WANTED}) ELSE {P.LEAST} END), "
        f"qg AS (SELECT qf.*, {tokens('CASE WHEN instr(text, sentence) > 0 THEN substring(text, instr(text, sentence), 1200) ELSE sentence END')} AS tail FROM qf JOIN d USING (doc_id)), "
        "qs AS (SELECT format('q{:04d}', number) AS qid, doc_id, CASE number % 3 " + " ".join(f"WHEN {i} THEN '{a}' || {FOCUS} || '{b}'" for i, (a, b) in enumerate(P.TEMPLATES)) + " END AS question, "
        "array_to_string(CASE WHEN len(tail) >= 20 THEN tail[1:28] WHEN len(t) >= 20 THEN t[1:40] WHEN len(list_concat(t, tail)) >= 20 THEN list_concat(t, tail)[1:20] ELSE list_concat(t, tail) END, ' ') AS answer FROM qg)"
    )


NOISE = f"({SINGLE} OR (length({BARE}) >= 12 AND (({count(BARE, chr(92) + 's')} <= 1 AND length({BARE}) >= 30 AND {_MARKS} >= 0.65) OR ({_MARKS} >= 0.75 AND {_LETTERS} <= 0.10))))"
OVERVIEW = (
    LINES + ", " + BLOCKS.replace("{l}", "l") + f", e0 AS (SELECT doc_id, text FROM documents), {_lines('e0', 'k')}, "
    "pk AS (SELECT doc_id, block, line_idx, " + KEY + " AS key FROM le WHERE " + KEY + " <> ''), "
    "pe AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_idx) AS top, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_idx DESC) AS bottom FROM pk), "
    "pp AS (SELECT doc_id, key, count(DISTINCT block) FILTER (top <= 2 OR bottom <= 2) AS edges, count(DISTINCT block) AS pages FROM pe GROUP BY ALL), "
    "b AS (SELECT doc_id, " + KEY + " AS key, count(*) AS n FROM l WHERE length(" + KEY + ") >= 2 GROUP BY ALL), a AS (SELECT doc_id, " + KEY + " AS key, count(*) AS n FROM k WHERE length(" + KEY + ") >= 2 GROUP BY ALL), "
    "x AS (SELECT doc_id, key AS line, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(edges, 0) AS edges, coalesce(pages, 0) AS pages FROM a FULL JOIN b USING (doc_id, key) LEFT JOIN pp USING (doc_id, key) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)), "
    "y AS (SELECT *, n_before > 0 AND n_after = 0 AS removed FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (n_before > 0 AND n_after = 0) DESC, abs(n_before - n_after) DESC, n_before DESC, line DESC) <= 400) "
    "SELECT doc_id, line AS key, n_before, n_after, removed, CASE WHEN " + DOTTED + " THEN 'toc' WHEN " + BOILERPLATE + " THEN 'boilerplate' WHEN pages > 0 AND edges / pages >= 0.6 AND n_before >= 3 THEN 'header_footer' ELSE 'other' END AS category FROM y"
)
FLAGS = {
    "boilerplate": BOILERPLATE, "single": SINGLE, "axis": AXIS, "navigation": navigation("line"), "dotted": DOTTED, "page_marker": MARKER, "separator": SEPARATOR, "reference_head": HEAD,
    "reference_name": f"lower({BARE}) IN {NAMES}", "reference_entry": ENTRY, "is_table": TABLE, "terminal": terminal("line"), "lower_start": "regexp_matches(line, '^[^\\p{L}\\p{Nd}]*\\p{Ll}')",
}


def oracle_sql() -> dict[str, str]:
    polluted = " OR ".join(f"{POLLUTION[c]} > 0" for c in list(POLLUTION)[:5])
    removed = gone("text", S.GLYPH, S.CID, INVISIBLE, PRIVATE, CONTROL, ZERO_WIDTH, REPLACED)
    typo = f"translate(text, '{S.TYPE_FROM}', '{S.TYPE_TO.replace(chr(39), chr(39) * 2)}')"
    strict = strip("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')")
    gaps = "regexp_replace({0}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    drop = "|".join(["send offprint requests to:", "article number, page \\d+ of \\d+"])
    titles = f"e0 AS (SELECT doc_id AS qid, doc_id AS expected, substring(string_split(text, chr(10))[1], 1, 120) AS title FROM d WHERE doc_id % 50 = 0), e AS (SELECT * FROM e0 WHERE {strip('title')} <> '')"
    top = (
        f"WITH {C}, {CHUNKS.replace('{i}', 'd').replace('{o}', 'k')}, {embedding('k', 'doc_id, chunk_index', 'chunk', 'v')}, {titles}, {embedding('e', 'qid', 'title', 'q')}, "
        "s AS (SELECT qid, doc_id, chunk_index, round(sum(q.weight * v.weight), 9) AS score FROM q JOIN v USING (dim) GROUP BY ALL), "
        "t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_index) AS rank FROM s QUALIFY rank <= 10), "
        "b AS (SELECT qid, doc_id, min(rank) AS best FROM t GROUP BY ALL), r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY best) AS rank FROM b), "
    )
    placed = lambda table: f"m AS (SELECT e.qid, expected, min(rank) FILTER (doc_id = expected) AS place FROM e LEFT JOIN {table} x USING (qid) GROUP BY ALL), x AS (SELECT qid, expected, coalesce(1.0::DOUBLE / place, 0) AS mrr, " + ", ".join(f"coalesce((place <= {k})::INT, 0) AS recall_{k}" for k in (1, 5, 10)) + " FROM m)"
    light = {"collapse": False, "repeated": "auto"}
    three = (
        PROFILE.replace("{0}", LINES) + f", {refined('vs')}, {refined('vl', **light)}, "
        "va AS (SELECT 'raw' AS variant, doc_id, text, length(text)::INT AS input_len, false AS normalized_extracted, 0 AS removed_toc_lines, 0 AS removed_header_footer_lines, 0 AS removed_layout_noise_lines FROM d UNION ALL "
        + " UNION ALL ".join(f"SELECT '{v}', doc_id, text, input_len, normalized_extracted, removed_toc_lines, removed_header_footer_lines, removed_layout_noise_lines FROM {t}" for v, t in (("safe", "vs"), ("light", "vl"))) + ")"
    )
    settings = {"plain": {}, "light": light, "aggressive": {"structure": "aggressive"}, "drops": {"repeated": "auto", "references": "auto"}, "structure": {"structure": "light", "noise": "off"}}

    def some(names: tuple[str, ...]) -> str:
        columns = "doc_id, text, input_len, normalized_extracted, removed_header_footer_lines AS removed_header_footer, removed_layout_noise_lines AS removed_layout_noise, hy::INT AS n_hyphen_fix, me::INT AS n_paragraph_merge, n_lines"
        parts = [f"SELECT '{v}' AS variant, {columns} FROM v{i}" for i, v in enumerate(names)]
        ctes = ", ".join(refined(f"v{i}", **settings[v]) for i, v in enumerate(names))
        raw = "SELECT 'raw' AS variant, doc_id, text, length(text)::INT AS input_len, false AS normalized_extracted, 0 AS removed_header_footer, 0 AS removed_layout_noise, 0 AS n_hyphen_fix, 0 AS n_paragraph_merge, 0 AS n_lines FROM d"
        return PROFILE.replace("{0}", LINES).replace("WITH ", "WITH RECURSIVE ", 1) + f", {ctes}, va AS ({' UNION ALL '.join([raw, *parts])})"

    evaluated = (
        f"{three}, {questions()}, va2 AS (SELECT variant || '/' || doc_id AS doc_id, text FROM va), {CHUNKS.replace('{i}', 'va2').replace('{o}', 'ck')}, {embedding('ck', 'doc_id, chunk_index', 'chunk', 'ev')}, eqs AS (SELECT * FROM qs WHERE substring(qid, 2)::BIGINT % 50 = 0), {embedding('eqs', 'qid', 'question', 'eq')}, "
        "es AS (SELECT qid, doc_id, chunk_index, round(sum(eq.weight * ev.weight), 9) AS score FROM eq JOIN ev USING (dim) GROUP BY ALL), "
        "et AS (SELECT qid, split_part(doc_id, '/', 1) AS variant, split_part(doc_id, '/', 2)::BIGINT AS doc, row_number() OVER (PARTITION BY qid, split_part(doc_id, '/', 1) ORDER BY score DESC, split_part(doc_id, '/', 2)::BIGINT, chunk_index) AS rank FROM es QUALIFY rank <= 10), "
        "ea AS (SELECT qid, variant, doc, min(rank) AS best FROM et GROUP BY ALL), eb AS (SELECT qid, variant, doc, row_number() OVER (PARTITION BY qid, variant ORDER BY best) AS rank FROM ea), "
        "ep AS (SELECT eqs.qid, u.v AS variant, eqs.doc_id, (SELECT min(rank) FROM eb WHERE eb.qid = eqs.qid AND eb.variant = u.v AND eb.doc = eqs.doc_id) AS place FROM eqs, unnest(['raw', 'safe', 'light']) AS u(v)), "
        "x AS (SELECT qid, variant, doc_id, coalesce(1.0::DOUBLE / place, 0) AS mrr, " + ", ".join(f"coalesce((place <= {k})::INT, 0) AS recall_{k}" for k in (1, 5, 10)) + " FROM ep), "
        "c AS (SELECT x.*, b.mrr AS raw_mrr, b.recall_1 AS raw_recall_1, x.mrr - b.mrr AS delta FROM x JOIN x b ON x.qid = b.qid AND b.variant = 'raw' AND x.variant <> 'raw')"
    )
    return {
        "retrieval_variants": f"{evaluated}, a AS (SELECT variant, avg(mrr) AS mrr, avg(recall_1) AS recall_1, avg(recall_5) AS recall_5, avg(recall_10) AS recall_10, count(*) AS count FROM x GROUP BY variant) "
        "SELECT variant, round(mrr, 9) AS mrr, round(recall_1, 9) AS recall_1, round(recall_5, 9) AS recall_5, round(recall_10, 9) AS recall_10, round(mrr - (SELECT mrr FROM a WHERE variant = 'raw'), 9) AS delta_mrr_vs_raw, count FROM a",
        "retrieval_losses": f"{evaluated} SELECT qid, variant, round(delta, 9) AS delta FROM c WHERE raw_recall_1 > recall_1",
        "retrieval_wins": f"{evaluated} SELECT qid, c.doc_id, round(delta, 9) AS delta, normalized_extracted, removed_header_footer_lines AS removed_header_footer, removed_layout_noise_lines AS removed_layout_noise, 0 AS n_hyphen_fix, 0 AS n_paragraph_merge, "
        "length(text)::INT AS output_len FROM c JOIN va ON c.doc_id = va.doc_id AND c.variant = va.variant WHERE c.variant = 'light' AND delta > 0",
        "retrieval_extremes": f"{evaluated}, z AS (SELECT qid, variant, round(delta, 9) AS delta FROM c), i AS (SELECT 'improvements' AS section, variant, row_number() OVER (PARTITION BY variant ORDER BY delta DESC, qid)::INT AS n, qid, delta FROM z UNION ALL SELECT 'regressions', variant, row_number() OVER (PARTITION BY variant ORDER BY delta, qid)::INT, qid, delta FROM z) SELECT * FROM i WHERE n <= 10",
        "retrieval_best_variant": f"{evaluated} SELECT variant, round(avg(mrr), 9) AS mrr FROM x GROUP BY variant ORDER BY round(avg(mrr), 12) DESC, variant LIMIT 1",
        "variant_summary": f"{three} SELECT variant, count(*) AS docs, sum(input_len)::BIGINT AS input_len, sum(length(text))::BIGINT AS output_len, sum(removed_toc_lines)::BIGINT AS toc_lines, count(*) FILTER (normalized_extracted) AS extracted FROM va GROUP BY variant",
        "variant_documents": some(tuple(settings)) + " SELECT doc_id, variant, input_len, length(text)::INT AS output_len, normalized_extracted, removed_header_footer, removed_layout_noise, n_hyphen_fix, n_paragraph_merge FROM va",
        "variant_export": some(("plain", "drops", "structure")) + " SELECT doc_id, variant, input_len, length(text)::INT AS output_len, md5(text) AS text_md5, CASE WHEN n_lines > 0 THEN (n_lines + n_hyphen_fix + n_paragraph_merge)::INT END AS n_decisions FROM va WHERE variant <> 'raw'",
        "variant_removed": PROFILE.replace("{0}", LINES) + f", {refined('v', **settings['drops'])}, raw AS (SELECT l.*, vt.line AS clean, CASE WHEN vp.line IS NULL THEN 'boilerplate' WHEN vq.line IS NULL THEN 'layout_noise' WHEN vu.line IS NULL THEN 'toc_navigation' WHEN vw.line IS NULL THEN 'header_footer' "
        f"WHEN refs = 1 THEN 'references_section' WHEN vy.line IS NULL THEN 'toc' END AS removal_type FROM l JOIN vt USING (doc_id, line_idx) LEFT JOIN vp USING (doc_id, line_idx) LEFT JOIN vq USING (doc_id, line_idx) LEFT JOIN vu USING (doc_id, line_idx) LEFT JOIN vw USING (doc_id, line_idx) LEFT JOIN vy USING (doc_id, line_idx)) "
        "SELECT doc_id, line_idx, removal_type, line AS raw_text, CASE WHEN contains(line, chr(39)) AND NOT contains(line, chr(34)) THEN chr(34) || line || chr(34) ELSE chr(39) || replace(replace(line, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) || chr(39) END AS repr_text FROM raw WHERE removal_type IS NOT NULL",
        "retrieval_metrics": f"{top}{placed('r')} SELECT qid, expected, round(mrr, 9) AS mrr, recall_1, recall_5, recall_10 FROM x",
        "retrieval_titles": f"{top}{placed('r')} SELECT round(avg(mrr), 9) AS mrr, round(avg(recall_1), 9) AS recall_1, round(avg(recall_5), 9) AS recall_5, round(avg(recall_10), 9) AS recall_10, count(*) AS n_queries FROM x",
        "retrieval_chunk_metrics": f"{top}{placed('t')} SELECT qid, round(mrr, 9) AS mrr, recall_1, recall_5, recall_10 FROM x",
        "retrieval_questions": f"WITH {C}, {questions()} SELECT qid, doc_id, question, answer FROM qs",
        "retrieval_best_chunk": f"WITH {C}, {questions()}, {CHUNKS.replace('{i}', 'd').replace('{o}', 'ck')}, "
        f"bs AS (SELECT qid, doc_id, chunk_index, contains(lower(chunk), lower(answer)) AND length(answer) > 0 AS holds, list_distinct(list_transform(regexp_extract_all(answer, '{P.TOKEN}'), lambda x: lower(x))) AS w, list_distinct(list_transform(regexp_extract_all(chunk, '{P.TOKEN}'), lambda x: lower(x))) AS c FROM ck JOIN qs USING (doc_id)), "
        "br AS (SELECT qid, doc_id, chunk_index, holds, len(list_intersect(w, c)) / greatest(len(w), 1) AS share FROM bs) "
        "SELECT qid, doc_id, chunk_index, holds FROM br WHERE holds OR share > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY holds DESC, CASE WHEN NOT holds THEN -share END, chunk_index) = 1",
        "retrieval_top_k_json": f"{TOPK} SELECT qid, '[' || string_agg('{{\"doc_id\":' || doc_id || ',\"chunk_index\":' || chunk_index || ',\"d\":' || round(1 - round(score, 9), 4) || '}}', ',' ORDER BY rank) || ']' AS topk FROM t GROUP BY qid",
        "refine_safe": refined_sql(),
        "refine_strict": refined_sql(profile="strict", references="on", structure="light"),
        "refine_light": refined_sql(extracted="on", repeated="on", collapse=False),
        "refine_markdown": refined_sql(profile="markdown_safe"),
        "refine_aggressive": refined_sql(noise="on", references="on", structure="aggressive"),
        "refine_paragraphs": refined_sql("doc_id, text", extracted="off", structure="light"),
        "refine_stream": refined_sql("z.doc_id, (SELECT d.text FROM d WHERE d.doc_id = z.doc_id) AS text, z.text AS refined"),
        "text_normalize": f"WITH {D} SELECT doc_id, nfc_normalize(text) AS text FROM d",
        "text_unescape": f"SELECT page_id, sha1({unescaped('html')}) AS html_sha1 FROM pages",
        "html_strings": "WITH a AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(regexp_replace(html, '(?s)<(script|style|noscript)\\b.*?</(script|style|noscript)>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g'), '<[^>]*>'), lambda x: x <> '') AS parts FROM pages) "
        f"SELECT page_id, {strip('regexp_replace(regexp_replace(' + unescaped('array_to_string(parts, chr(10))') + ', chr(92) || chr(110) || chr(123) || chr(51) || chr(44) || chr(125), chr(10) || chr(10), chr(103)), chr(91) || chr(32) || chr(9) || chr(93) || chr(123) || chr(50) || chr(44) || chr(125), chr(32), chr(103))')} AS text FROM a",
        "text_pollution": f"WITH {D} SELECT doc_id, {', '.join(f'{x}::INT AS {n}' for n, x in POLLUTION.items())}, {polluted} OR {POLLUTION['entities']} >= 3 AS polluted FROM d",
        "text_artifact_removal": f"WITH {D} SELECT doc_id, {digest('out', removed)} FROM d",
        "text_typographic": f"WITH {D} SELECT doc_id, {digest('out', typo)} FROM d",
        "text_whitespace": f"{LINES}, s AS ({_safe('l')}) SELECT doc_id, {digest('safe', 'coalesce(safe, chr(0))')}, {digest('strict', strict)}, {digest('gaps', gaps.format('text'))} FROM d LEFT JOIN s USING (doc_id)",
        "text_profile": PROFILE.replace("{0}", LINES) + " SELECT * FROM g",
        "text_profile_counts": PROFILE.replace("{0}", f"WITH {C}, {_lines()}") + " SELECT profile, count(*) AS n FROM g GROUP BY profile",
        "line_flags": f"{LINES} SELECT doc_id, line_idx, {', '.join(f'{x} AS {n}' for n, x in FLAGS.items())} FROM l",
        "line_titles": f"{LINES} SELECT doc_id, line_idx, {TITLE} AS title, {guarded(KEY)} AS guarded FROM l",
        "line_bullets": f"{LINES} SELECT doc_id, line_idx, regexp_replace(line, '{BULLET}', '• ') AS bulleted, regexp_replace(line, '{BULLET}', '- ') AS markdown, {KEY} AS key FROM l",
        "line_ratios": f"{LINES} SELECT doc_id, line_idx, round({share(count('line', chr(92) + 'p{Lu}'), 'line')}, 9) AS caps_ratio, round({share(digits('line'), 'line')}, 9) AS digit_ratio, round({share(punctuation('line'), 'line')}, 9) AS punctuation_ratio FROM l",
        "line_codepoints": f"{LINES} SELECT doc_id, line_idx, array_to_string(list_transform(CASE WHEN line = '' THEN [] ELSE string_split(line, '') END, lambda c: 'U+' || CASE WHEN unicode(c) < 65536 THEN lpad(hex(unicode(c)), 4, '0') ELSE hex(unicode(c)) END), ' ') AS codepoints FROM l",
        "line_noise_runs": f"{LINES}, {RUNS.replace("{l}", "l")} SELECT doc_id, line_idx, kind, run_length, noise FROM ln",
        "line_blocks": f"{LINES}, {BLOCKS.replace("{l}", "l")} SELECT doc_id, line_idx, block FROM le",
        "line_headers": f"{LINES}, {HEADERS.replace("{l}", "l")} SELECT * FROM lx",
        "line_references": f"{LINES} SELECT doc_id, line_idx FROM (SELECT *, max(CASE WHEN {HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS r FROM l) WHERE r = 1",
        "line_markers": f"{LINES}, m AS (SELECT *, '## SECTION: ' || {BARE} AS marker, lag(line) OVER (PARTITION BY doc_id ORDER BY line_idx) AS before FROM l) SELECT doc_id, line_idx, marker FROM m WHERE {TITLE} AND (before IS NULL OR {strip('before')} <> marker)",
        "line_references_start": f"{LINES}, m AS (SELECT *, lower({BARE}) IN {NAMES} AS named, {ENTRY} AND line_idx > max(line_idx) OVER (PARTITION BY doc_id) - 50 AS entry FROM l), g AS (SELECT doc_id, coalesce(min(line_idx) FILTER (named), CASE WHEN count(*) FILTER (entry) >= 5 THEN min(line_idx) FILTER (entry) END) AS \"at\" FROM m GROUP BY doc_id) SELECT * FROM g WHERE \"at\" IS NOT NULL",
        "line_decided": f"{DECIDED} SELECT doc_id, line_idx, CASE category WHEN 'other' THEN 'keep' ELSE 'drop' END AS action, category, CASE WHEN category = 'other' THEN regexp_replace(line, '{BULLET}', '• ') END AS out FROM c",
        "line_counters": f"{DECIDED} SELECT doc_id, count(*) AS n_lines, " + ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in ("boilerplate", "layout_noise", "toc_navigation", "header_footer", "references_section", "toc")) + " FROM c GROUP BY doc_id",
        "line_dotted_rejoined": f"{LINES}, j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_idx) AS text FROM l WHERE NOT {DOTTED} GROUP BY doc_id) SELECT doc_id, {digest('out', 'text')} FROM j",
        "refine_raw": f"WITH {D} SELECT doc_id, {digest('out', 'text')} FROM d",
        "page_doc_ids": "SELECT page_id, right(trim(regexp_replace(url, '[^\\p{L}\\p{N}\\p{M}_]+', '_', 'g'), '_'), 60) AS doc_id FROM pages",
        "dropped_lines": f"{LINES}, j AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_idx) FILTER (NOT {has(BARE, f'^({drop})', 'i')}), '') AS text FROM l GROUP BY doc_id) SELECT doc_id, {digest('out', 'text')} FROM j",
        "chunks_offsets": f"WITH {C}, {CHUNKS.replace('{i}', 'd').replace('{o}', 'k')} SELECT doc_id || '__raw__' || lpad(chunk_index::VARCHAR, 5, '0') AS chunk_id, doc_id, chunk_index, start_char, end_char, md5(chunk) AS chunk_md5 FROM k",
        "chunks_stripped": f"SELECT doc_id, (s // 1050)::INT AS chunk_index, md5({strip('substring(text, s + 1, 1200)')}) AS chunk_md5 FROM documents, unnest(range(0, length(text), 1050)) AS u(s) WHERE length({strip('substring(text, s + 1, 1200)')}) >= 40",
        "chunk_pages": "WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents), "
        "d AS (SELECT doc_id, array_to_string(pages, chr(10) || chr(10) || chr(10)) AS text, list_transform(range(0, len(pages)), lambda i: coalesce(list_sum(list_transform(pages[1:i], lambda x: length(x) + 3)), 0)) AS offs FROM p), "
        + CHUNKS.replace("{i}", "d").replace("{o}", "k")
        + ", s AS (SELECT k.doc_id, chunk_index, greatest(len(list_filter(offs, lambda o: o <= start_char)), 1) AS a, greatest(len(list_filter(offs, lambda o: o <= greatest(end_char - 1, start_char))), 1) AS b FROM k JOIN d USING (doc_id)) "
        "SELECT doc_id, chunk_index, CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS page_span FROM s",
        "hash_embedding": f"WITH {C}, {CHUNKS.replace('{i}', 'd').replace('{o}', 'k')}, {embedding('k', 'doc_id, chunk_index', 'chunk', 'v')} SELECT doc_id, chunk_index, dim, round(weight, 7) AS weight FROM v",
        "retrieval_top_k": f"{TOPK} SELECT qid, doc_id, chunk_index, round(score, 6) AS score, rank::INT AS rank FROM t",
        "retrieval_sentences": f"{SENTENCES} SELECT doc_id, pos, {INFORMATIVE} AS score, {FOCUS} AS focus FROM k",
        "lines_changed": f"WITH {D}, e AS (SELECT doc_id, text FROM documents), {_lines()}, {_lines('e', 'k')}, b AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT doc_id, line, count(*) AS n FROM k GROUP BY ALL) "
        "SELECT doc_id, line, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after FROM a FULL JOIN b USING (doc_id, line) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
        "lines_added": f"WITH {D}, e AS (SELECT doc_id, text FROM documents), {_lines()}, {_lines('e', 'k')} SELECT doc_id, line_idx, line FROM l ANTI JOIN k USING (doc_id, line)",
        "lines_frequent": f"{LINES} SELECT {KEY} AS key, count(*) AS n FROM l WHERE {KEY} <> '' GROUP BY 1 HAVING count(*) >= 5",
        "chunks_collapsed": f"WITH {D}, g AS (SELECT doc_id, {strip(gaps.format('text'))} AS text FROM d), {CHUNKS.replace('{i}', 'g').replace('{o}', 'k')} SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5 FROM k",
        "line_layout_noise": f"{LINES} SELECT doc_id, line_idx, {NOISE} AS noise, {BARE} = '' OR regexp_matches(lower(line), '{P.BOILERPLATE_TERMS}') OR {DOTTED} OR {BOILERPLATE} AS boilerplate FROM l",
        "line_overview": OVERVIEW,
        "line_dropped": f"{DECIDED} SELECT doc_id, line_idx, category, line, array_to_string(list_transform(CASE WHEN line = '' THEN [] ELSE string_split(line, '') END, lambda c: 'U+' || CASE WHEN unicode(c) < 65536 THEN lpad(hex(unicode(c)), 4, '0') ELSE hex(unicode(c)) END), ' ') AS codepoints FROM c WHERE category <> 'other'",
        "text_totals": f"{LINES}, s AS ({_safe('l')}), t AS (SELECT doc_id, length(text) AS a, length({gaps.format('safe')}) AS b FROM d JOIN s USING (doc_id)) "
        "SELECT count(*) AS docs, sum(a)::BIGINT AS before, sum(b)::BIGINT AS after, round(sum(b) / sum(a), 9) AS ratio, arg_max(doc_id, (a - b, -doc_id)) AS most_compressed FROM t",
    }
