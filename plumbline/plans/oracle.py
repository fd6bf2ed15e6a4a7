"""DuckDB SQL for the queries, built from the same lexicons but by other means: phrase by phrase, without lookbehind."""

from __future__ import annotations

from plumbline.functions import lexicon as L
from plumbline.plans import catalogue as C
from plumbline.plans.score import COUNTS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: tuple) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"


SPIKE = lambda key: f"({listed(C.SPIKES)})[({key}) % {len(C.SPIKES)} + 1]"
SPIKED = f"SELECT doc_id, lang, source, coalesce(text, '') || ' ' || {SPIKE('doc_id')} AS txt FROM documents"
_WORDS = lambda s: f"len(regexp_extract_all(lower({s}), {lit(L.WORD)}))"
_COLLAPSED = lambda s: f"trim(regexp_replace({s}, {lit(L.WS + '+')}, ' ', 'g'))"
_TRIMMED = lambda s: f"regexp_replace({s}, {lit(f'^{L.WS}+|{L.WS}+$')}, '', 'g')"
_UP = lambda x, digits=0: f"floor(({x})::DOUBLE * {10**digits} + 0.5) / {10**digits}"


def _ends(t: str, n: str) -> str:
    last = f"""regexp_extract(lower(regexp_replace({t}, {lit(r'''[.!?"')\]]+$''')}, '')), '([a-z.]*)$', 1)"""
    return f"""(regexp_matches({t}, {lit(r'''[.!?…]["')\]]?$''')}) AND NOT list_contains({listed(L.ABBREVIATIONS)}, {last})
      AND (NOT regexp_matches(lower({t}), {lit(r'''^[a-z](?:\.[a-z])*\.?["')\]]*$''')}) OR regexp_matches(coalesce({n}, ''), {lit(r'''^["'(\[]*[A-Z]''')})))"""


def _hits(phrases: tuple[str, ...]) -> str:
    """Each phrase's hits, by the characters at both sides of every split."""
    free = lambda c: f"NOT regexp_matches({c}, '[a-z'']')"
    before = f"(CASE WHEN p[i] = '' THEN i = 1 ELSE {free('right(p[i], 1)')} END)"
    after = f"(CASE WHEN p[i + 1] = '' THEN i + 1 = len(p) ELSE {free('left(p[i + 1], 1)')} END)"
    return f"""list_sum(list_transform(list_transform({listed(phrases)}, lambda q: string_split(low, q)),
      lambda p: len(list_filter(range(1, len(p)), lambda i: {before} AND {after}))))::BIGINT"""


def _phrase_finds(phrases: tuple[str, ...], rule: str) -> str:
    """Findings of phrases in list order, each phrase's from left to right, with their places."""
    free = lambda c: f"NOT regexp_matches({c}, '[a-z'']')"
    before = f"(CASE WHEN x.p[i] = '' THEN i = 1 ELSE {free('right(x.p[i], 1)')} END)"
    after = f"(CASE WHEN x.p[i + 1] = '' THEN i + 1 = len(x.p) ELSE {free('left(x.p[i + 1], 1)')} END)"
    at = "(list_sum(list_transform(x.p[1:i], lambda y: length(y))) + (i - 1) * length(x.q))::BIGINT"
    one = f"{{'rule': {lit(rule)}, 'snippet': substring(norm, {at} + 1, length(x.q)), 'start': {at}, 'stop': {at} + length(x.q)}}"
    return f"""flatten(list_transform(list_transform({listed(phrases)}, lambda q: {{'q': q, 'p': string_split(low, q)}}),
      lambda x: list_transform(list_filter(range(1, len(x.p)), lambda i: {before} AND {after}), lambda i: {one})))"""


def _finds() -> str:
    """All findings of ``norm, low, sents``, in order of rule, list and place."""
    pivot = lit("(?i)" + "|".join(f"(?:{p})" for p in L.PIVOTS))
    hedge = lit(rf"\b(?:{L.alternation(L.HEDGES)})\b")
    one = lambda rule, snippet: f"{{'rule': {lit(rule)}, 'snippet': {snippet}, 'start': NULL::BIGINT, 'stop': NULL::BIGINT}}"
    some = lambda rule, test, n: f"list_transform(list_filter(sents, lambda s: {test}), lambda s: {one(rule, f'left(s, {n})')})"
    parts = [
        _phrase_finds(L.BANNED, "banned-phrase"), _phrase_finds(L.HOLLOW, "hollow-confidence"),
        f"list_transform(flatten(list_transform(sents, lambda s: regexp_extract_all(s, {lit('(?i)' + L.TRIAD)}))), lambda s: {one('triad', 's')})",
        some("negation-pivot", f"regexp_matches(s, {pivot})", 80),
        some("hedge-stack", f"len(list_distinct(regexp_extract_all(lower(s), {hedge}))) >= 2", 80),
        some("cliche-opener", f"regexp_matches(lower(s), {lit(f'^(?:{L.alternation(L.OPENERS)})[ ,]')})", 50),
    ]
    return " || ".join(parts)


def measured(source: str, finds: bool = False) -> str:
    """Common table expressions up to ``m``: the source's columns, counts and sums, with ``finds`` also all findings; the text is ``txt``."""
    pivot = lit("(?i)" + "|".join(f"(?:{p})" for p in L.PIVOTS))
    hedge = lit(rf"\b(?:{L.alternation(L.HEDGES)})\b")
    summed = lambda x: f"coalesce(list_sum({x}), 0)::BIGINT"
    return f"""WITH src AS ({source}),
a AS (SELECT *, translate(coalesce(txt, ''), '‘’‛ʼ“”', '''''''''""') AS norm FROM src),
b AS (SELECT *, lower(norm) AS low, string_split({_COLLAPSED("translate(norm, chr(1), ' ')")}, ' ') AS toks FROM a),
c AS (SELECT * EXCLUDE (toks), array_to_string(list_transform(toks, lambda t, i: t || CASE WHEN {_ends('t', 'toks[i + 1]')} THEN chr(1) ELSE ' ' END), '') AS joined FROM b),
d AS (SELECT * EXCLUDE (joined), list_filter(list_transform(string_split(joined, chr(1)), lambda s: trim(s)), lambda s: s <> '') AS sents FROM c),
e AS (SELECT *, list_filter(list_transform(sents, lambda s: {_WORDS('s')}), lambda n: n > 0) AS lens, regexp_extract_all(low, {lit(L.WORD)}) AS ws FROM d),
m AS MATERIALIZED (SELECT * EXCLUDE (lens, ws, low, norm){f", {_finds()} AS finds" if finds else ""}, len(ws) AS n_words, len(sents) AS n_sentences, len(lens) AS n_lengths,
  {summed('lens')} AS sum_lengths, {summed('list_transform(lens, lambda n: n * n)')} AS sum_squares,
  len(list_filter(ws, lambda w: suffix(w, 'ly') AND length(w) > 4)) AS adverbs, len(regexp_extract_all(norm, {lit(L.DASHES)})) AS dashes,
  {_hits(L.BANNED)} AS banned, {_hits(L.HOLLOW)} AS hollow,
  {summed(f"list_transform(sents, lambda s: len(regexp_extract_all(s, {lit('(?i)' + L.TRIAD)})))")} AS triads,
  len(list_filter(sents, lambda s: regexp_matches(s, {pivot}))) AS pivots,
  len(list_filter(sents, lambda s: len(list_distinct(regexp_extract_all(lower(s), {hedge}))) >= 2)) AS hedges,
  len(list_filter(sents, lambda s: regexp_matches(lower(s), {lit(f'^(?:{L.alternation(L.OPENERS)})[ ,]')}))) AS openers
  FROM e)"""


def graded(source: str, finds: bool = False) -> str:
    """``measured`` and ``g``: rates, points, score and grade."""
    over = lambda x, most, times: f"CASE WHEN {x} > {most} THEN floor(({x} - {most}::DOUBLE) * {times} + 0.5)::BIGINT ELSE 0 END"
    per100 = lambda c: f"CASE WHEN n_words > 0 THEN {c} * 100.0::DOUBLE / n_words ELSE 0::DOUBLE END"
    grades = " ".join(f"WHEN score <= {most} THEN '{g}'" for g, most in L.GRADES)
    return f"""{measured(source, finds)},
r AS (SELECT *, CASE WHEN n_lengths > 1 AND sum_lengths > 0 THEN sqrt(n_lengths::DOUBLE * sum_squares - sum_lengths::DOUBLE * sum_lengths) / sum_lengths ELSE 0::DOUBLE END AS cv,
  CASE WHEN n_lengths > 0 THEN sum_lengths::DOUBLE / n_lengths ELSE 0::DOUBLE END AS avg_length, {per100('adverbs')} AS adverb_rate, {per100('dashes')} AS dash_rate, CASE WHEN n_sentences > 0 THEN triads::DOUBLE / n_sentences ELSE 0::DOUBLE END AS triad_density,
  6 * (banned + pivots) AS high, 4 * hollow AS med, 2 * (triads + hedges + openers) AS low FROM m),
u AS (SELECT *, n_sentences >= 5 AND cv < 0.4::DOUBLE AS uniform FROM r),
t AS (SELECT *, CASE WHEN uniform THEN floor((0.4::DOUBLE - cv) * 60 + 0.5)::BIGINT ELSE 0 END AS rhythm_points,
  {over('adverb_rate', 5, 2)} AS adverb_points, {over('dash_rate', 2.5, 3)} AS dash_points, {over('triad_density', 0.25, 40)} AS triad_points FROM u),
s AS (SELECT *, (high + med + low + rhythm_points + adverb_points + dash_points + triad_points)::BIGINT AS total FROM t),
h AS (SELECT *, least(100, greatest(0, total))::BIGINT AS score FROM s),
g AS MATERIALIZED (SELECT *, CASE {grades} ELSE 'F' END AS grade FROM h)"""


LABELLED = f"{graded(SPIKED)}, l AS (SELECT g.*, quality, toxic FROM g JOIN labels USING (doc_id))"
TURNS = f"SELECT conv_id, turn, role, coalesce(text, '') || ' ' || {SPIKE('conv_id * 5 + turn')} AS txt FROM conversations"
PAIRS = f"""SELECT conv_id, turn, text AS input, output || ' ' || {SPIKE('conv_id')} AS txt FROM (
  SELECT *, lead(text) OVER w AS output, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'"""


def _html() -> str:
    s = "coalesce(html, '')"
    for pattern, new in ((L.HTML_COMMENT, " "), (L.HTML_HIDDEN, " "), (L.HTML_BLOCK_END, "\n"), (L.HTML_BREAK, "\n"), (L.HTML_TAG, " ")):
        s = f"regexp_replace({s}, {lit(pattern)}, {lit(new)}, 'g')"
    for name, value in L.ENTITIES.items():
        s = f"replace({s}, {lit(name)}, {lit(value)})"
    for pattern, new in (("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        s = f"regexp_replace({s}, {lit(pattern)}, {lit(new)}, 'g')"
    return _TRIMMED(s)


def _confusion(thresholds: tuple[int, ...]) -> str:
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0::DOUBLE END"
    return f"""{LABELLED}, k AS (SELECT t.threshold::INTEGER AS threshold, count(*) FILTER (quality = 0 AND score > t.threshold) AS tp, count(*) FILTER (quality <> 0 AND score > t.threshold) AS fp,
  count(*) FILTER (quality <> 0 AND score <= t.threshold) AS tn, count(*) FILTER (quality = 0 AND score <= t.threshold) AS fn
  FROM (SELECT unnest({listed(thresholds)}) AS threshold) t LEFT JOIN l ON true GROUP BY 1),
 z AS (SELECT *, {share('tp', 'tp + fn')} AS recall, {share('tn', 'tn + fp')} AS specificity, {share('tp', 'tp + fp')} AS "precision", {share('tp + tn', 'tp + fp + tn + fn')} AS accuracy FROM k)"""


def _arms() -> str:
    grades = ", ".join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in "ABCDF")
    counts = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTS.values())
    return f"""{graded(TURNS)}, arms AS (SELECT role, count(*) AS n, {_UP('sum(score)::DOUBLE / count(*)', 1)} AS mean_score, {grades}, {counts},
  {_UP('sum(floor(cv * 100 + 0.5))::DOUBLE / 100.0::DOUBLE / count(*)', 3)} AS mean_cv FROM g GROUP BY role)"""


def _wilson() -> str:
    def bound(k: str, n: str, sign: str) -> str:
        p, z = f"(({k})::DOUBLE / ({n}))", "1.96::DOUBLE"
        x = f"({p} + {z} * {z} / (2 * ({n})) {sign} {z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4 * ({n}) * ({n})))) / (1 + {z} * {z} / ({n}))"
        return _UP(f"CASE WHEN {n} > 0 THEN least(1, greatest(0, {x})) ELSE 0 END", 6)

    ends = ", ".join(f"{bound(k, n, sign)} AS {name}_{e}" for name, k, n in (("recall", "tp", "tp + fn"), ("specificity", "tn", "tn + fp")) for e, sign in (("low", "-"), ("high", "+")))
    return f"{_confusion(C.SWEEP)} SELECT threshold, {ends} FROM z"


def _diagnostics() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {lit(rule)} AS rule, count(*) FILTER ({c} > 0) AS samples, count(*) FILTER (quality = 0 AND {c} > 0) AS positives, count(*) FILTER (quality <> 0 AND {c} > 0) AS negatives, count(*) FILTER (quality = 0) AS y, count(*) FILTER (quality <> 0) AS n FROM l"
        for rule, c in COUNTS.items()
    )
    rate = lambda a, b: _UP(f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END", 3)
    return f"{LABELLED} SELECT rule, samples, positives, negatives, {rate('positives', 'y')} AS positive_rate, {rate('negatives', 'n')} AS negative_rate FROM ({rows}) WHERE samples > 0"


_RATES = ", ".join(f"{_UP(q, 6)} AS {q}" for q in ("recall", "specificity", '"precision"', "accuracy"))
_F1 = _UP('CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END', 6)
_PER100 = lambda c: f"CASE WHEN n_words > 0 THEN {_UP(f'{c} * 100.0::DOUBLE / n_words', 2)} ELSE 0::DOUBLE END"
_SAID = f"left({_COLLAPSED('''coalesce(text, '')''')}, 500)"
_BLOCKS = f"""SELECT doc_id, replace(txt, chr(10), chr(10) || ' ' || chr(9) || chr(10)) || chr(10) || chr(10) || '---' || chr(10) || chr(9) || chr(10) || '123 456' || chr(10) || chr(10)
  || 'first half' || chr(10) || chr(13) || chr(10) || 'second half' || chr(10) || ' ' || chr(10) || chr(10) || '  ' || chr(10) || 'last words here.' AS txt FROM ({SPIKED})"""
_PARAGRAPHS = graded(f"""SELECT doc_id, place - 1 AS index, paragraph AS txt FROM (SELECT doc_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) AS place FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(txt, '\n[ \t]*\n'), lambda p: {_TRIMMED('p')}), lambda p: regexp_matches(lower(p), '[a-z]')) AS ps FROM ({_BLOCKS})))""")
_NUMBER = lambda x, digits: f"regexp_replace(printf('%.{digits}f', ({_UP(x, digits)})::DOUBLE), '\\.?0+$', '')"


def _markdown() -> str:
    """A reduction over the wrapped text's lines that carries the open fence along."""
    wrapped = "'# Title' || chr(10) || '```' || chr(10) || 'code ~~~' || chr(10) || left(txt, 40) || chr(10) || '~~~' || chr(10) || '```' || chr(10) || '> quoted' || chr(10) || '<b>' || txt || '</b>' || chr(10) || '| a | b |' || chr(10) || '~~~' || chr(10) || 'open'"
    line = f"{{'l': l, 'b': {_TRIMMED('l')}, 'fence': '', 'out': NULL::VARCHAR}}"
    mark = "CASE WHEN starts_with(x.b, '```') THEN '```' WHEN starts_with(x.b, '~~~') THEN '~~~' ELSE '' END"
    fence = f"CASE WHEN {mark} = '' THEN a.fence WHEN a.fence = '' THEN {mark} WHEN a.fence = {mark} THEN '' ELSE a.fence END"
    out = f"CASE WHEN {mark} <> '' OR a.fence <> '' OR regexp_matches(x.b, '^[>|#<]') THEN a.out ELSE coalesce(a.out || chr(10), '') || regexp_replace(x.l, '<[^>]+>', '', 'g') END"
    step = f"{{'l': '', 'b': '', 'fence': {fence}, 'out': {out}}}"
    lines = f"list_transform([''] || string_split({wrapped}, chr(10)), lambda l: {line})"
    return f"SELECT doc_id, sha256(coalesce(list_reduce({lines}, lambda a, x: {step}).out, '')) AS prose_sha256 FROM ({SPIKED})"


def _fixed() -> str:
    """Phrase by phrase, once with a capital and once without, twice because neighbours share a border; then the blanks."""
    quote = "['‘’‛ʼ]"
    edge = "[^A-Za-z'‘’‛ʼ]"
    s = "txt"
    for phrase, new in L.FIXES.items():
        spelled = phrase.replace("-", "\\-").replace("'", quote)
        tail = f"{L.WS}*,?{L.WS}*(?:that{L.WS}+)?" if not new else ""
        for head, put in ((f"(?i:{spelled})", new),) if not new else ((f"{spelled[0].upper()}(?i:{spelled[1:]})", new[0].upper() + new[1:]), (f"(?i:{spelled})", new)):
            for _ in range(2):
                s = f"regexp_replace({s}, {lit(f'(^|{edge})(?:{head})($|{edge})')}, {lit(f'{chr(92)}1{put}' + (chr(2) if not new else '') + f'{chr(92)}2')}, 'g')"
        if not new:
            s = f"regexp_replace({s}, {lit(chr(2) + tail)}, '', 'g')"
    for pattern, new in (("[ \t]{2,}", " "), ("[ \t]+([,.;:!?])", "\\1"), (f"^(?:{L.WS}|[,;])+", "")):
        s = f"regexp_replace({s}, {lit(pattern)}, {lit(new)}, 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        s = f"regexp_replace({s}, {lit(f'([.!?]{L.WS}+){c}')}, {lit(f'{chr(92)}1{c.upper()}')}, 'g')"
    return f"(SELECT *, CASE WHEN regexp_matches(f, '^[a-z]') THEN upper(left(f, 1)) || substring(f, 2) ELSE f END AS fixed FROM (SELECT *, {s} AS f FROM ({SPIKED})))"


def _report() -> str:
    rule = f"""list_transform(list_filter({listed(L.RULES)}, lambda r: len(list_filter(finds, lambda f: f.rule = r)) > 0), lambda r:
      '  ' || r || ' (' || len(list_filter(finds, lambda f: f.rule = r)) || '): '
      || array_to_string(list_transform(list_filter(finds, lambda f: f.rule = r)[1:6], lambda f: '"' || f.snippet || '"'), ', ')
      || CASE WHEN len(list_filter(finds, lambda f: f.rule = r)) > 6 THEN ' …+' || (len(list_filter(finds, lambda f: f.rule = r)) - 6) ELSE '' END)"""
    head = f"""['Score ' || score || '/100  ·  grade ' || grade, '{'─' * 46}', 'words ' || n_words || '   sentences ' || n_sentences || '   avg len ' || {_NUMBER('avg_length', 1)},
      'rhythm variance (CV) ' || {_NUMBER('cv', 2)} || CASE WHEN uniform THEN '  ⚠ too uniform' ELSE '  ok' END,
      'adverb rate ' || {_NUMBER('adverb_rate', 1)} || '/100   em-dash rate ' || {_NUMBER('dash_rate', 1)} || '/100   triad density ' || {_NUMBER('triad_density', 2)}, '',
      CASE WHEN len(finds) = 0 THEN 'No lexical tells found.' ELSE len(finds) || CASE WHEN len(finds) = 1 THEN ' finding:' ELSE ' findings:' END END]"""
    return f"{graded(SPIKED, True)} SELECT doc_id, array_to_string({head} || {rule}, chr(10)) AS report FROM g"


def _share() -> str:
    fired = f"list_filter({listed(L.RULES)}, lambda r: len(list_filter(finds, lambda f: f.rule = r)) > 0)"
    top = f"list_transform(list_sort(list_transform({fired}, lambda r, i: {{'n': -len(list_filter(finds, lambda f: f.rule = r)), 'i': i, 'r': r}}))[1:3], lambda x: x.r)"
    shown = f"""list_transform({fired}, lambda r: r || ' (' || array_to_string(list_transform(list_filter(finds, lambda f: f.rule = r)[1:3], lambda f: '"' || f.snippet || '"'), ', ') || ')')"""
    body = f"""'{{"g":"' || grade || '","s":' || score || ',"t":[' || array_to_string(list_transform({top}, lambda r: '"' || r || '"'), ',') || '],"w":' || n_words || '}}'"""
    return f"""{graded(SPIKED, True)} SELECT doc_id, rtrim(translate(to_base64(encode({body})), '+/', '-_'), '=') AS payload,
  array_to_string(CASE WHEN uniform THEN [{lit(L.UNIFORM_NOTE)}] ELSE [] END || {shown}, '; ') AS tells FROM g"""


def _result() -> str:
    places = "CASE WHEN f.start IS NULL THEN '' ELSE ',\"start\":' || f.start || ',\"end\":' || f.stop END"
    severity = " ".join(f"WHEN {lit(r)} THEN {lit(v)}" for r, v in L.SEVERITY.items())
    found = f"""array_to_string(list_transform(finds, lambda f: '{{"rule":"' || f.rule || '","severity":"' || CASE f.rule {severity} END || '","snippet":' || to_json(f.snippet) || {places} || '}}'), ',')"""
    number = lambda x, digits: f"({_UP(x, digits)})::DOUBLE::VARCHAR"
    return f"""{graded(SPIKED, True)} SELECT doc_id, '{{"score":' || score || ',"grade":"' || grade || '","breakdown":{{"lexical":{{"high":' || high || ',"med":' || med || ',"low":' || low || ',"total":' || (high + med + low)
  || '}},"structural":{{"uniformRhythm":' || rhythm_points::BIGINT || ',"adverbs":' || adverb_points::BIGINT || ',"emDashes":' || dash_points::BIGINT || ',"triads":' || triad_points::BIGINT || ',"total":' || (rhythm_points + adverb_points + dash_points + triad_points)::BIGINT
  || '}},"total":' || total || '}},"metrics":{{"words":' || n_words || ',"sentences":' || n_sentences || ',"avgSentenceLength":' || {number('avg_length', 1)} || ',"sentenceLengthCV":' || {number('cv', 2)} || ',"uniformRhythm":' || uniform
  || ',"adverbRate":' || {number('adverb_rate', 1)} || ',"emDashRate":' || {number('dash_rate', 1)} || ',"triadDensity":' || {number('triad_density', 2)} || '}},"findings":[' || {found} || ']}}' AS result FROM g"""


def _diagnostics_sql() -> str:
    """Each finding's snippet as a pattern; its places from the lengths of what stands between the hits."""
    spelled = f"'(?i)' || array_to_string(list_transform(string_split({_COLLAPSED('f.snippet')}, ' '), lambda w: regexp_escape(w)), {lit(L.WS + '+')})"
    return f"""{measured(f"SELECT doc_id, txt, txt AS body FROM ({SPIKED})", True)}, fs AS (SELECT DISTINCT doc_id, body, f.rule AS rule, {spelled} AS p
  FROM (SELECT doc_id, body, unnest(finds) AS f FROM m) WHERE length({_TRIMMED('f.snippet')}) >= 3),
hs AS (SELECT *, string_split_regex(body, p) AS parts, regexp_extract_all(body, p) AS hits FROM fs),
ps AS (SELECT doc_id, rule, unnest(list_transform(range(1, least(len(hits), 50) + 1), lambda i: {{'start': list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0), 'n': length(hits[i])}})) AS x FROM hs)
SELECT doc_id, rule, x.start::INTEGER AS start, max(x.start + x.n)::INTEGER AS stop FROM ps GROUP BY ALL"""


def _books() -> str:
    """The text that each page's three files hold, from the page itself."""
    ascii_ = "regexp_replace(coalesce(html, ''), '[^ -~]+', ' ', 'g')"
    pdf = f"trim(regexp_replace({ascii_}, '[ \t]{{2,}}', ' ', 'g'))"
    body = "coalesce(html, '')"
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        body = f"replace({body}, {lit(name)}, {lit(value)})"
    docx = f"({body} || chr(10) || 'page ' || page_id)"
    for pattern, new in (("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        docx = f"regexp_replace({docx}, {lit(pattern)}, {lit(new)}, 'g')"
    epub = f"CASE WHEN {_html()} = '' THEN '' ELSE {_html()} || chr(10) || chr(10) END || 'part of ' || page_id"
    one = lambda kind, text: f"SELECT page_id || '.{kind}' AS path, sha256({text}) AS text_sha256 FROM pages"
    return f"{one('pdf', pdf)} UNION ALL {one('docx', _TRIMMED(docx))} UNION ALL {one('epub', epub)}"


_CHROME = L.CHROME
_DIFF = """WITH t AS (SELECT doc_id AS diff_id, unnest(ps) AS raw, generate_subscripts(ps, 1) - 1 AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents))
SELECT diff_id, 'notes/f' || (place % 2) || '.md' AS file, string_agg(raw || chr(10), '' ORDER BY place) AS added FROM t WHERE place % 3 = 0 AND NOT starts_with(raw, '++') GROUP BY ALL"""
_GRADE_MAP = lambda table: "CASE grade " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"

SQL: dict[str, str] = {
    "q_words": f"{measured('SELECT doc_id, text AS txt FROM documents')} SELECT doc_id, n_words, adverbs, dashes, {_PER100('adverbs')} AS adverb_rate, {_PER100('dashes')} AS dash_rate FROM m",
    "q_sentences": f"{measured(SPIKED)} SELECT doc_id, n_sentences, n_lengths, sum_lengths, sum_squares, sents[1] AS first_sentence, sents[-1] AS last_sentence FROM m",
    "q_rhythm": f"{graded(SPIKED)} SELECT doc_id, n_sentences, {_UP('cv', 4)} AS cv, uniform FROM g",
    "q_lexical_hits": f"{measured(SPIKED)} SELECT doc_id, banned, hollow FROM m",
    "q_findings_by_rule": f"{measured(SPIKED)} " + " UNION ALL ".join(f"SELECT {lit(r)} AS rule, sum({c})::BIGINT AS findings, count(*) FILTER ({c} > 0) AS documents FROM m" for r, c in COUNTS.items()),
    "q_score": f"{graded(SPIKED)} SELECT doc_id, high, med, low, rhythm_points, adverb_points, dash_points, triad_points, total, score, grade FROM g",
    "q_grade_by_lang": f"{graded(SPIKED)} SELECT lang, {', '.join(f'''count(*) FILTER (grade = '{g}') AS grade_{g.lower()}''' for g in 'ABCDF')}, sum(score)::BIGINT AS sum_score, count(*) AS n FROM g GROUP BY lang",
    "q_rank_worst": f"{graded(SPIKED)} SELECT doc_id, score, grade FROM g ORDER BY score DESC, doc_id LIMIT 50",
    "q_scan_summary": f"{graded(SPIKED)} SELECT count(*) AS files, floor(sum(score)::DOUBLE / count(*) + 0.5)::BIGINT AS mean_score, (SELECT doc_id FROM g ORDER BY score DESC, doc_id LIMIT 1) AS worst FROM g",
    "q_source_gate": f"{graded(SPIKED)} SELECT source, count(*) AS n, max(score) AS worst, bool_or(score > {C.GATE}) AS failed FROM g GROUP BY source",
    "q_paragraphs": f"{_PARAGRAPHS} SELECT doc_id, index, left({_COLLAPSED('txt')}, 80) AS snippet, n_words, score, grade FROM g",
    "q_paragraph_table": f"""{_PARAGRAPHS}, s80 AS (SELECT *, left({_COLLAPSED('txt')}, 80) AS snippet, list_filter([{', '.join(f"CASE WHEN {c} > 0 THEN {lit(r)} END" for r, c in COUNTS.items())}], lambda r: r IS NOT NULL) AS fired FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, index) AS place, '  ' || grade || '  ' || lpad(score::VARCHAR, 3, ' ') || '   ¶' || (index + 1) || '  “' || snippet || CASE WHEN length(snippet) >= 80 THEN '…' ELSE '' END
  || '”  · ' || n_words || 'w · ' || CASE WHEN len(fired) = 0 THEN 'clean' ELSE array_to_string(fired[1:4], ', ') END AS line FROM s80""",
    "q_strip_markdown": _markdown(),
    "q_apply_fixes": f"""WITH a0 AS MATERIALIZED (SELECT * FROM ({graded(f"SELECT * FROM {_fixed()}")} SELECT * FROM g)),
b0 AS MATERIALIZED (SELECT doc_id, lower(translate(txt, '‘’‛ʼ“”', '\'\'\'\'\'\'\'\'""')) AS low FROM a0), c0 AS (SELECT doc_id, {_hits(tuple(L.FIXES))} AS applied FROM b0),
d0 AS MATERIALIZED (SELECT * FROM ({graded(f"SELECT doc_id, fixed AS txt FROM {_fixed()}")} SELECT doc_id, score AS after FROM g))
SELECT doc_id, sha256(fixed) AS fixed_sha256, applied, banned + hollow + triads + pivots + hedges + openers - applied AS skipped, score AS before, after FROM a0 JOIN c0 USING (doc_id) JOIN d0 USING (doc_id)""",
    "q_share_payload": _share(),
    "q_report": _report(),
    "q_result_json": _result(),
    "q_binary_sources": _books(),
    "q_diagnostics": _diagnostics_sql(),
    "q_diff_scores": f"{graded(f'SELECT diff_id, file, added AS txt FROM ({_DIFF}) WHERE length(regexp_replace(added, {lit(L.WS)}, {lit(str())}, {lit(chr(103))})) >= 20')} SELECT diff_id, file, n_words, score, grade FROM g",
    "q_verdicts": f"""{graded(f"SELECT doc_id, txt, len(list_filter(string_split({_COLLAPSED('txt')}, ' '), lambda w: w <> '')) AS page_words FROM ({SPIKED}) WHERE lang IN ('en', 'fr')")}
SELECT doc_id, page_words, grade, {_GRADE_MAP(L.VERDICTS)} AS verdict, {_GRADE_MAP(L.BUCKETS)} AS bucket FROM g WHERE page_words >= {L.LEAST_PAGE_WORDS}""",
    "q_rules_fired": f"{measured(SPIKED)} " + " UNION ALL ".join(f"SELECT {lit(r)} AS rule FROM m GROUP BY ALL HAVING max({c}) > 0" for r, c in COUNTS.items()),
    "q_kept_pairs": f"{graded(PAIRS)} SELECT conv_id, turn, input, txt AS output FROM g WHERE score <= {C.PAIR_LIMIT}",
    "q_outputs": "SELECT b.item_id AS id, b.text AS sample, coalesce(d.text, '') AS output FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id AND d.lang = 'en'",
    "q_paired": "SELECT b.item_id AS id, b.text AS sample FROM benchmark b JOIN labels l ON l.doc_id = b.item_id",
    "q_first_outputs": f"SELECT conv_id * 1000 + turn AS id, txt AS output FROM ({PAIRS}) ORDER BY 1 LIMIT 10",
    "q_strip_html": f"{graded(f'SELECT page_id, {_html()} AS txt FROM pages')} SELECT page_id, txt AS visible, n_words, score, grade FROM g",
    "q_transcript_tail": f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, {_SAID} AS body FROM conversations)
SELECT conv_id, left(coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'You: ' ELSE 'Them: ' END || body, chr(10) ORDER BY turn) FILTER (body <> ''), ''), 4000) AS transcript FROM t WHERE n <= 6 GROUP BY conv_id""",
    "q_harvest": f"""WITH t AS (SELECT conv_id, turn, unnest(ps) AS raw, generate_subscripts(ps, 1) AS place FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ps FROM conversations)),
u AS (SELECT conv_id, turn, place, {_TRIMMED('raw')} AS l FROM t),
v AS (SELECT * FROM u WHERE length(l) >= 20 AND regexp_matches(l, {lit(L.WS)}) AND NOT regexp_matches(l, {lit(_CHROME)}) QUALIFY row_number() OVER (PARTITION BY conv_id, l ORDER BY turn, place) = 1)
SELECT conv_id, left(string_agg(l, chr(10) ORDER BY turn, place), 8000) AS harvested FROM v GROUP BY conv_id""",
    "q_role_style": f"{_arms()} SELECT *, CASE greatest(grade_a, grade_b, grade_c, grade_d, grade_f) WHEN grade_a THEN 'A' WHEN grade_b THEN 'B' WHEN grade_c THEN 'C' WHEN grade_d THEN 'D' ELSE 'F' END AS dominant FROM arms",
    "q_role_deltas": f"{_arms()} SELECT a.role, a.n, a.mean_score, a.mean_cv, {_UP('a.mean_score - b.mean_score', 1)} AS score_delta, {_UP('a.mean_cv - b.mean_cv', 3)} AS cv_delta FROM arms a LEFT JOIN arms b ON b.role = 'user'",
    "q_confusion": f"{_confusion((10,))} SELECT threshold, tp, fp, tn, fn, {_RATES}, {_F1} AS f1 FROM z",
    "q_sweep": f"{_confusion(C.SWEEP)} SELECT threshold, tp, fp, tn, fn, {_RATES}, {_F1} AS f1 FROM z",
    "q_wilson": _wilson(),
    "q_rule_diagnostics": _diagnostics(),
    "q_score_distribution": f"{LABELLED} SELECT quality, count(*) AS samples, min(score) AS least, max(score) AS most, {_UP('sum(score)::DOUBLE / count(*)', 1)} AS mean, median(score)::DOUBLE AS median FROM l GROUP BY quality",
    "q_filter_pairs": f"{graded(PAIRS)} SELECT conv_id, turn, score, score <= {C.PAIR_LIMIT} AS kept FROM g",
    "q_holdout_split": f"""WITH p AS (SELECT *, 's' || (conv_id % 7) AS source FROM ({PAIRS}))
SELECT conv_id, turn, source, row_number() OVER (ORDER BY source, sha1(coalesce(input, '')), input) <= greatest(1, round_even(count(*) OVER () * 0.15::DOUBLE, 0)) AS held FROM p""",
    "q_diff_added": _DIFF,
    "q_readable": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws, length(regexp_replace(coalesce(text, ''), {lit(L.WS + '+')}, '', 'g')) AS n FROM documents)
SELECT doc_id, len(ws) >= 30 AND len(list_filter(ws, lambda w: list_contains({listed(L.FUNCTION_WORDS)}, w))) > len(ws) * 0.12::DOUBLE AS readable, n >= 20 AS enough FROM t""",
    "q_corpus_audit": """WITH p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (coalesce(length(text), 0) = 0) AS e, count(*) FILTER (source IS NULL) AS s FROM documents GROUP BY doc_id)
SELECT count(*) FILTER (n > 1) AS repeated_ids, coalesce(sum(e), 0)::BIGINT AS empty_texts, coalesce(sum(s), 0)::BIGINT AS without_source,
count(*) FILTER (quality NOT IN (0, 1)) AS unknown_labels, count(*) FILTER (n IS NULL) AS labels_without_document FROM p FULL JOIN labels USING (doc_id)""",
} | {f"q_{c}": f"{measured(SPIKED)} SELECT doc_id, {c} FROM m WHERE {c} > 0" for c in ("triads", "pivots", "hedges", "openers")}
