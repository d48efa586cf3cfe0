"""DuckDB SQL for the screening queries, generated from the same fixed values.

The tables' texts are in normal form and hold no white space beyond ASCII; what payloads put in is changed by name.
"""

from __future__ import annotations

from textshield.functions import columns as C
from textshield.functions.signatures import SIGNATURES
from textshield.operators import detect as D
from textshield.operators import sanitize as S
from textshield.plans.attacks import VARIANTS, quoted

CLASSES = C.invisible_classes()
ANY = "[" + "".join(CLASSES.values()) + "]"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def tidy(text: str) -> str:
    lines = f"regexp_replace(regexp_replace({text}, '[^\\S\\n]+', ' ', 'g'), '(?m)^ +| +$', '', 'g')"
    return strip(f"regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def bare(text: str) -> str:
    return f"regexp_replace({text}, {quoted(ANY)}, '', 'g')"


def nfkc(text: str) -> str:
    """The normal form of texts whose only characters out of it are those that plans.attacks puts in."""
    for variant, plain in VARIANTS.items():
        text = f"replace({text}, '{variant}', '{plain}')"
    return text


def clean(raw: str) -> str:
    return tidy(nfkc(bare(raw)))


def fold(text: str, *maps: tuple[str, str]) -> str:
    return f"translate({text}, {quoted(''.join(a for a, _ in maps))}, {quoted(''.join(b for _, b in maps))})"


def bucket(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least} THEN '{name}'" for least, name in C.BUCKETS) + " ELSE 'info' END"


def _hits(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, {quoted('(?im)' + s.pattern)}) THEN {i} END" for i, s in enumerate(SIGNATURES)) + "], lambda x: x IS NOT NULL)"


FIRST_WORD = "(?m)" + D.FIRST_WORD
DIRECTIVE = "(?i)" + D.DIRECTIVE
LINES = f"regexp_extract_all(t, {quoted(FIRST_WORD)}, 1)"
COMMANDS = "list_filter(" + LINES + ", lambda w: lower(w) IN (" + ", ".join(map(quoted, D.COMMANDS)) + "))"
DIRECTIVES = count("t", DIRECTIVE)


def scanned(source: str, keys: str, threshold: float = 0.5, before: str = "") -> str:
    """CTEs up to `scanned`: keys, t, hits, weights, score, risk, injected, n_findings. source selects keys and raw.

    before: weights of findings that come before the others, as a list over columns of the source, which are among the keys.
    """
    invisible = ", ".join(f"{count('raw', '[' + c + ']')} AS {k}" for k, c in CLASSES.items())
    sanitize = (before + ", " if before else "") + ", ".join(f"CASE WHEN {k} > 0 THEN {w}::DOUBLE END" for k, _, _, _, w, _ in C.INVISIBLE)
    weights = "[" + ", ".join(f"{s.weight}::DOUBLE" for s in SIGNATURES) + "]"
    high = "[" + ", ".join("true" if s.severity in ("high", "critical") else "false" for s in SIGNATURES) + "]"
    return f"""
src AS ({source}),
c AS (SELECT {keys}, raw, {invisible}, {clean('raw')} AS t FROM src),
u AS (SELECT *, {fold('t', C.LEET, C.CONFUSABLES)} AS u, {_hits('t')} AS first,
  len({LINES}) AS n_lines, len({COMMANDS}) AS n_commands, {DIRECTIVES} AS n_directives FROM c),
h AS (SELECT *, list_concat(first, list_filter(CASE WHEN u <> t THEN {_hits('u')} ELSE [] END, lambda i: NOT list_contains(first, i))) AS hits,
  n_lines >= 4 AND n_commands >= 3 AND n_commands / n_lines >= 0.4 AS imperative,
  n_directives >= 2 AND n_directives / greatest(1.0, length(t) / 1000.0) >= 1.5 AS directive FROM u),
w AS (SELECT *, list_concat(list_concat(list_filter([{sanitize}], lambda x: x IS NOT NULL), list_transform(hits, lambda i: ({weights})[i + 1])),
  list_filter([CASE WHEN imperative THEN 0.45::DOUBLE END, CASE WHEN directive THEN 0.40::DOUBLE END], lambda x: x IS NOT NULL)) AS weights FROM h),
s AS (SELECT *, 1 - list_reduce(list_prepend(1::DOUBLE, list_transform(weights, lambda x: 1 - x)), lambda a, b: a * b) AS score FROM w),
scanned AS (SELECT *, {bucket('score')} AS risk, len(weights) AS n_findings,
  score >= {threshold} OR tag_chars > 0 OR bidi_controls > 0 OR variation_selectors > 0 OR len(list_filter(hits, lambda i: ({high})[i + 1])) > 0 AS injected FROM s)
"""


def visible(page: str) -> str:
    """What is seen of the generated pages: their markup is regular, and hides an element only as plans.catalog puts it in."""
    blocks = "|".join(sorted(S.BLOCKS, key=len, reverse=True))
    steps = (
        ("(?s)<!--.*?-->", ""),
        ("(?is)<(?:head)[\\s>].*?</head>", ""),
        ("(?is)<div style=\"display:none\">[^<]*</div>", "\n\n"),
        (f"(?i)</?(?:{blocks})(?:\\s[^>]*)?>", "\n"),
        ("(?s)<[/!a-zA-Z][^>]*>", ""),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&copy;", "©"),
        ("&middot;", "·"),
        ("&amp;", "&"),
    )
    for pattern, by in steps:
        page = f"regexp_replace({page}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return page


def spans(source: str, keys: str) -> str:
    """CTEs up to `spans`: keys, i, span_start, span_end, excerpt of the first match of each signature that hits."""
    before = "CASE i " + " ".join(f"WHEN {i} THEN length(regexp_extract(s, {quoted(f'(?im)\\A((?s:.*?))(?:{x.pattern})')}, 1))" for i, x in enumerate(SIGNATURES)) + " END"
    size = "CASE i " + " ".join(f"WHEN {i} THEN length(regexp_extract(s, {quoted(f'(?im)\\A(?s:.*?)({x.pattern})')}, 1))" for i, x in enumerate(SIGNATURES)) + " END"
    inside = strip(f"replace(substring(s, a + 1, b - a), chr(10), ' ')")
    return f"""{scanned(source, keys)},
x AS (SELECT {keys}, unnest(hits) AS i, t, u, first FROM scanned),
y AS (SELECT {keys}, i, CASE WHEN list_contains(first, i) THEN t ELSE u END AS s FROM x),
z AS (SELECT *, {before} AS span_start, {size} AS size FROM y),
w2 AS (SELECT *, span_start + size AS span_end, greatest(0, span_start - {D.PAD}) AS a, least(length(s), span_start + size + {D.PAD}) AS b FROM z),
spans AS (SELECT {keys}, i, span_start, span_end, CASE WHEN a > 0 THEN '…' ELSE '' END || {inside} || CASE WHEN b < length(s) THEN '…' ELSE '' END AS excerpt FROM w2)
"""


IDS = "[" + ", ".join(quoted(s.id) for s in SIGNATURES) + "]"
CATEGORIES = "[" + ", ".join(quoted(s.category) for s in SIGNATURES) + "]"
