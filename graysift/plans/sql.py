"""The queries in DuckDB's SQL.

RE2 knows no look-around and takes \\b and \\w as ASCII. Letters with accents are therefore written as other word
characters of the same length before matching; places and values are read from the text itself. Numbers that must not
touch others are found as maximal runs.
"""

from __future__ import annotations

from graysift.functions.rules import ADVICE, GENERIC, IDENTIFYING, MAX_NAMES, MAX_PER_TYPE, MAX_TERMS, NAME, RANK, RULES, SPECIAL, SPECIAL_NOTE, TOPIC_NOTE, TOPIC_SUFFIX
from graysift.operators.provenance import TAGS
from graysift.plans import samples
from graysift.sources.files import ARCHIVES, IMAGES, MEDIA, TEXT


def quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


TEXTS = f"SELECT doc_id, coalesce(text, '') AS text, source FROM documents UNION ALL SELECT doc_id, text, 'samples' FROM {values(samples.TEXTS)} v(doc_id, text)"
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"
LATIN = "regexp_replace(regexp_replace(text, '[à-ÿ]', 'z', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
NO_RUN = "d <> repeat(left(d, 1), length(d))"
BSN = f"length(d) = 9 AND {NO_RUN} AND (list_sum(list_transform(range(1, 9), lambda i: (10 - i) * try_cast(substr(d, i::INT, 1) AS INT))) - try_cast(substr(d, 9, 1) AS INT)) % 11 = 0"
LUHN = f"length(d) BETWEEN 13 AND 19 AND {NO_RUN} AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i::INT, 1)::INT WHEN substr(reverse(d), i::INT, 1)::INT > 4 THEN 2 * substr(reverse(d), i::INT, 1)::INT - 9 ELSE 2 * substr(reverse(d), i::INT, 1)::INT END)) % 10 = 0"
IBAN = (
    "regexp_full_match(v, '[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}') AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(v, 5) || left(v, 4), ''), "
    "lambda c: coalesce(try_cast(c AS BIGINT), ascii(c)::BIGINT - 55))), lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1"
)
CHECKS = {
    "bsn": BSN,
    "iban": IBAN,
    "betaalkaart": LUHN,
    "email": r"NOT regexp_matches(value, '(?i)@(?:example\.(?:com|org|net)|test\.|localhost|domein\.nl|voorbeeld\.nl)')",
    "ipadres": r"NOT regexp_matches(value, '^(?:0\.|127\.|255\.255)') AND value <> '1.1.1.1'",
}


def re2(pattern: str) -> str:
    return pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("a-zà-ÿ", "a-z").replace("ïi]", "zi]").replace("ëe]", "ze]").replace("eë]", "ez]").replace("'", "''")


PHONE = r"(?:\+31|0031)[ \-]?\(?0?\)?[ \-]?[1-9](?:[ \-]?\d){8}|0[1-9](?:[ \-]?\d){8}"


def places(source: str, t: str, pattern: str) -> str:
    """Rows (doc_id, text, t, start, value) of all matches."""
    return f"""SELECT doc_id, text, t, start, substr(text, start + 1, length(v)) AS value FROM (
  SELECT doc_id, text, t, m[i] AS v, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, text, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM (SELECT doc_id, text, {t} AS t FROM {source}) WHERE regexp_matches(t, '{pattern}'))))"""


def hits(rule, source: str = "texts", every: bool = False) -> str:
    """Rows (doc_id, text, start, value) of a rule as the engine lists them: checked, in context, different, capped unless every."""
    t, pattern = LATIN if rule is NAME else ASCII, re2(rule.pattern)
    if rule.type == "bsn":
        found = places(source, t, r"[0-9]+(?:[ .\-][0-9]+)*")
        found = rf"SELECT * FROM ({found}) WHERE regexp_full_match(value, '\d{{9}}|\d{{3}}[ .\-]\d{{3}}[ .\-]\d{{3}}')"
    elif rule.type == "telefoon":
        found = rf"""SELECT doc_id, text, text AS t, (instr(text, value) - 1)::BIGINT AS start, value FROM (
  SELECT doc_id, text, unnest(regexp_extract_all({ASCII}, '(?:^|[^\w.]|[^0-9]\.)({PHONE})(?:$|[^\w.]|\.(?:$|[^0-9]))', 1)) AS value FROM {source})"""
    else:
        found = places(source, t, pattern)
    if rule.type in CHECKS:
        found = rf"SELECT doc_id, text, t, start, value FROM (SELECT *, {DIGITS} AS d, upper(regexp_replace(value, '[\s.\-]', '', 'g')) AS v FROM ({found})) WHERE {CHECKS[rule.type]}"
    if rule.context:
        before, after = (100, 40) if rule is NAME else (120, 120)
        found = f"SELECT * FROM ({found}) WHERE regexp_matches(substr(t, greatest(start - {before}, 0) + 1, start + length(value) + {after} - greatest(start - {before}, 0)), '{re2(rule.context)}')"
    if rule is NAME and not every:
        found = f"SELECT * FROM ({found}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) <= {MAX_NAMES}"
    found = f"SELECT * FROM ({found}) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY start) = 1"
    return f"SELECT doc_id, text, start, value, count(*) OVER (PARTITION BY doc_id) AS different FROM ({found}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) <= {10**9 if every else MAX_PER_TYPE}"


def special(pattern: str, source: str = "texts") -> str:
    """Rows (doc_id, text, start, value, n) of a special category."""
    first = f"SELECT doc_id, text, lower(value) AS term, min(start) AS start FROM ({places(source, LATIN, re2(pattern))}) GROUP BY ALL"
    kept = f"SELECT * FROM ({first}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) <= {MAX_TERMS}"
    return f"SELECT doc_id, any_value(text) AS text, min(start) AS start, string_agg(term, ', ' ORDER BY start) AS value, count(*) AS n FROM ({kept}) GROUP BY doc_id"


MASK = "CASE WHEN length(value) <= 4 THEN repeat('•', length(value)) ELSE left(value, 2) || repeat('•', greatest(3, length(value) - 4)) || right(value, 2) END"
MASK_AT = f"CASE WHEN contains(value, '@') THEN left(value, least(2, instr(value, '@') - 1)) || repeat('•', greatest(3, instr(value, '@') - 3)) || substr(value, instr(value, '@')) ELSE {MASK} END"
LINE = "(length(left(text, start)) - length(replace(left(text, start), chr(10), '')) + 1)::BIGINT"
CONTEXT = (
    "CASE WHEN start > 70 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(start - 70, 0) + 1, least(length(text), start + length(value) + 70) - greatest(start - 70, 0)), '\\s+', ' ', 'g'))"
    " || CASE WHEN start + length(value) + 70 < length(text) THEN '…' ELSE '' END"
)


def rule_query(rule) -> str:
    mask = MASK if rule.category == "geheim" else MASK_AT
    return f"WITH texts AS ({TEXTS}) SELECT doc_id, start, value, {mask} AS masked, {LINE} AS line, {CONTEXT} AS context FROM ({hits(rule)})"


def scanned(source_sql: str, every: bool = False) -> str:
    """CTEs: found (doc_id, no, type, label, severity, rank, category, start, value, n), over (doc_id, warnings) and
    verdicts (doc_id, verdict, n_findings) for the rows (doc_id, text) of a source."""
    rules = [(k, r.type, r.label, r.severity, RANK[r.severity], r.category) for k, r in enumerate(RULES)]
    rules += [(len(RULES) + k, s[0], s[1], "hoog", 3, "bijzonder") for k, s in enumerate(SPECIAL)] + [(len(RULES) + len(SPECIAL), NAME.type, NAME.label, NAME.severity, RANK[NAME.severity], NAME.category)]
    parts = [f"SELECT doc_id, text, {k} AS no, start, value, 1 AS n, different FROM ({hits(r, every=every)})" for k, r in [*enumerate(RULES), (len(rules) - 1, NAME)]]
    parts += [f"SELECT doc_id, text, {len(RULES) + k}, start, value, n, 0 FROM ({special(s[2])})" for k, s in enumerate(SPECIAL)]
    generic, person = ", ".join(map(quoted, GENERIC)), ", ".join(map(quoted, IDENTIFYING))
    return f"""WITH texts AS ({source_sql}),
raw AS ({' UNION ALL '.join(parts)}),
typed AS (SELECT r.*, type, label, severity, rank, category, {DIGITS} AS d FROM raw r JOIN {values(rules)} k(no, type, label, severity, rank, category) USING (no)),
held AS (SELECT * FROM typed a WHERE a.type NOT IN ({generic}) OR NOT EXISTS (
  SELECT 1 FROM typed b WHERE b.doc_id = a.doc_id AND b.type NOT IN ({generic}) AND length(b.d) >= 6 AND (contains(a.d, b.d) OR contains(b.d, a.d)))),
persons AS (SELECT DISTINCT doc_id FROM held WHERE type IN ({person})),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, type, no, start) - 1 AS pos, category = 'bijzonder' AND doc_id NOT IN (SELECT doc_id FROM persons) AS light FROM held),
found AS (SELECT doc_id, text, no, pos, type, category, start, value, n, label || CASE WHEN light THEN '{TOPIC_SUFFIX}' ELSE '' END AS label,
  CASE WHEN light THEN 'laag' ELSE severity END AS severity, CASE WHEN light THEN 1 ELSE rank END AS rank FROM ordered),
warned AS (SELECT doc_id, count(DISTINCT no) AS n_warnings FROM raw WHERE different > {MAX_PER_TYPE} GROUP BY doc_id),
verdicts AS (SELECT t.*, coalesce(n_findings, 0) AS n_findings, ['geen', 'laag', 'middel', 'hoog'][coalesce(top, 0) + 1] AS verdict, coalesce(n_warnings, 0) AS n_warnings
  FROM texts t LEFT JOIN (SELECT doc_id, count(*) AS n_findings, max(rank) AS top FROM found GROUP BY doc_id) USING (doc_id) LEFT JOIN warned USING (doc_id))
"""


def html(column: str, then: str) -> str:
    steps = [(r"(?i)<script[\s\S]*?</script>", " "), (r"(?i)<style[\s\S]*?</style>", " "), (r"<w:tab\b[^>]*/?>", "\t"), (r"<(?:w:br|w:cr)\b[^>]*/?>", "\n"), (r"</(?:w:p|a:p|text:p|text:h)>", "\n"),
             (r"</(?:w:tc|a:tc)>", "\t"), (r"</(?:w:tr|a:tr|table:table-row)>", "\n"), (r"</(?:si|c)>", "\n"), (r"<[^>]+>", ""), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&apos;", "'"),
             ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]
    for pattern, text in steps:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(text)}, 'g')"
    return then.format(column)


def picked(key: str, by: int, items: tuple) -> str:
    return f"([{', '.join(map(quoted, items))}])[{key} // {by} % {len(items)} + 1]"


def queries() -> dict[str, str]:
    full, advice = scanned(TEXTS), values(ADVICE.items())
    summary = ", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in ADVICE)
    reached = "count(*) FILTER (verdict IN ('middel', 'hoog'))"
    found = {f"findings_{r.type}": rule_query(r) for r in (*RULES, NAME)}
    parts = " UNION ALL ".join(f"SELECT doc_id, '{s[0]}' AS type, value AS terms, n, start FROM ({special(s[2])})" for s in SPECIAL)
    found["special_categories"] = f"WITH texts AS ({TEXTS}) {parts}"
    found["document_findings"] = f"{full} SELECT doc_id, pos, type, label, severity, value, CASE WHEN category = 'bijzonder' THEN value WHEN category = 'geheim' THEN {MASK} ELSE {MASK_AT} END AS masked, {LINE} AS line, n FROM found"
    found["document_verdicts"] = f"{full} SELECT doc_id, verdict, advice, n_findings, n_warnings FROM verdicts JOIN {advice} a(verdict, advice) USING (verdict)"
    found["verdict_summary"] = (
        f"{full} SELECT count(*) AS files, {summary}, ['geen', 'laag', 'middel', 'hoog'][coalesce(max(list_position(['laag', 'middel', 'hoog'], verdict)), 0) + 1] AS highest, {reached} AS n_blocked, 'middel' AS threshold, "
        f"CASE WHEN {reached} = 0 THEN 'Alle bestanden blijven onder de drempel — uploaden kan.' ELSE {reached} || ' van ' || count(*) || ' bestand(en) haalt de drempel \"middel\" of hoger. Schoon die eerst op.' END AS advice FROM verdicts"
    )
    found["verdict_by_source"] = f"{full} SELECT source, verdict, count(*) AS files, sum(n_findings)::BIGINT AS findings FROM verdicts GROUP BY ALL"
    redacted = """, pairs AS (SELECT doc_id, list({v: value, k: type, n: 0::BIGINT} ORDER BY length(value) DESC, value, type) AS p FROM found WHERE category <> 'bijzonder' AND length(value) >= 3 GROUP BY doc_id)
SELECT doc_id, sha256(r.v) AS text_sha256, r.n AS replaced FROM (
  SELECT doc_id, list_reduce(list_prepend({v: text, k: '', n: 0::BIGINT}, coalesce(p, [])), lambda a, b: {v: replace(a.v, b.v, '[GEREDIGEERD:' || b.k || ']'), k: '', n: a.n + ((length(a.v) - length(replace(a.v, b.v, ''))) // length(b.v))::BIGINT}) AS r
  FROM texts LEFT JOIN pairs USING (doc_id))"""
    found["redacted_documents"] = full + redacted
    found["redacted_every"] = scanned(TEXTS, every=True) + redacted
    found["merged_findings"] = f"""WITH t AS (SELECT doc_id, text, regexp_extract_all({ASCII}, '{re2(RULES[3].pattern)}') AS m FROM ({TEXTS})),
a AS (SELECT doc_id, unnest(m) AS value, unnest(range(1, len(m) + 1)) AS i FROM t),
f AS (SELECT doc_id, value, 0 AS part, i, 'patroon' AS source, 2 AS rank, true AS by_name FROM a WHERE i = 1 UNION ALL SELECT doc_id, value, 1, i, 'patroon', 2, false FROM a
  UNION ALL SELECT doc_id, upper(value), 2, i, 'ai', CASE WHEN i % 3 = 0 THEN 3 ELSE 1 END, false FROM a WHERE i % 2 = 1),
g AS (SELECT doc_id, lower(value) AS k, count(*) AS n, max(rank) AS rank, min(part * 1000000000 + i) AS place, arg_min(value, (source <> 'patroon')::INT * 10000000000 + part * 1000000000 + i) AS value,
  arg_min(by_name, (source <> 'patroon')::INT * 10000000000 + part * 1000000000 + i) AS in_filename FROM f GROUP BY doc_id, lower(value))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, place) - 1 AS pos, value, n, ['laag', 'middel', 'hoog'][rank] AS severity, in_filename FROM g"""
    said = "label || ': nog ' || (different - 25) || ' andere unieke treffer(s) gevonden; alleen de eerste 25 staan in het rapport.'"
    notes = values([(r.type, r.note) for r in (*RULES, NAME)] + [(s[0], SPECIAL_NOTE) for s in SPECIAL])
    shown_value = f"CASE WHEN category = 'bijzonder' THEN value WHEN category = 'geheim' THEN {MASK} ELSE {MASK_AT} END"
    one = f"json_object('type', type, 'label', label, 'ernst', severity, 'categorie', category, 'bron', 'patroon', 'regel', {LINE}, 'aantal', n, 'waarde', {shown_value}, 'avg', CASE WHEN ends_with(label, {quoted(TOPIC_SUFFIX)}) THEN {quoted(TOPIC_NOTE)} ELSE note END, 'toelichting', NULL)"
    found["report_documents"] = f"""{full}, notes AS (SELECT * FROM {notes} k(type, note)), b AS (SELECT doc_id, list({one} ORDER BY pos) AS b FROM found JOIN notes USING (type) GROUP BY doc_id),
w AS (SELECT doc_id, list({said} ORDER BY no) AS w FROM (SELECT DISTINCT doc_id, no, label, different FROM typed WHERE different > 25) GROUP BY doc_id)
SELECT doc_id, json_object('naam', NULL, 'pad', NULL, 'bytes', NULL, 'soort', NULL, 'oordeel', verdict, 'advies', advice, 'aiGebruikt', false, 'samenvattingAi', '', 'waarschuwingen', coalesce(w, []), 'bevindingen', coalesce(b, []))::VARCHAR AS report
FROM verdicts JOIN {advice} a(verdict, advice) USING (verdict) LEFT JOIN b USING (doc_id) LEFT JOIN w USING (doc_id)"""
    kinds = " ".join(f"WHEN list_contains([{', '.join(map(quoted, e))}], e) THEN '{k}'" for e, k in ((TEXT, "tekst"), (ARCHIVES, "document"), (["pdf"], "pdf"), (["rtf"], "rtf"), (IMAGES, "afbeelding"), (MEDIA, "media")))
    unit = "CASE WHEN bytes < 1000 THEN bytes || ' B' " + " ".join(
        f"WHEN {f'bytes < {top}' if top else 'TRUE'} THEN CASE WHEN bytes / {by} >= 100 THEN round_even(bytes / {by}, 0)::BIGINT::VARCHAR ELSE printf('%.1f', bytes / {by}) END || ' {u}'"
        for by, top, u in ((1e3, "1e6", "kB"), (1e6, "1e9", "MB"), (1e9, "1e12", "GB"), (1e12, "", "TB"))
    ) + " END"
    names = (
        "SELECT page_id AS doc_id, translate(name, '_-.', '   ') AS text, lower(regexp_extract(name, '[^/]\\.([^./]+)$', 1)) AS e, (page_id % 1000 + 1) * pow(10, page_id // 5 % 14)::BIGINT + 1 AS bytes "
        f"FROM (SELECT page_id, 'brief_' || lpad((page_id * 7919 % 1000000000)::VARCHAR, 9, '1') || '.' || {picked('page_id', 1, samples.FILE_KINDS)} AS name FROM pages)"
    )
    shown = "(floor(bytes / 1e6 + 0.5)::BIGINT // 60) || ':' || lpad((floor(bytes / 1e6 + 0.5)::BIGINT % 60)::VARCHAR, 2, '0')"
    found["file_facts"] = f"{scanned(names)} SELECT doc_id, CASE {kinds} ELSE 'onbekend' END AS kind, {unit} AS size, verdict, {shown} AS shown FROM verdicts"
    turns = "SELECT conv_id * 100000 + turn AS doc_id, coalesce(text, '') AS text, conv_id FROM conversations"
    top = "['geen', 'laag', 'middel', 'hoog'][coalesce(max(list_position(['laag', 'middel', 'hoog'], verdict)), 0) + 1]"
    found["conversation_verdicts"] = f"{scanned(turns)} SELECT conv_id, count(*) AS turns, {top} AS verdict, sum(n_findings)::BIGINT AS findings FROM verdicts GROUP BY conv_id"
    found["page_text"] = html("coalesce(html, '')", "SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT page_id, {} AS t FROM pages)")
    found["page_files"] = html(
        "coalesce(html, '')",
        "SELECT '_' || page_id || '.html' AS name, 'tekst' AS kind, octet_length(encode(h)) AS bytes, true AS readable, sha256(h) AS sha256, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT page_id, coalesce(html, '') AS h, {} AS t FROM pages)",
    )
    pages = html("coalesce(html, '')", "SELECT page_id AS doc_id, {} AS text, page_id FROM pages")
    found["page_verdicts"] = f"{scanned(pages)} SELECT page_id, verdict, n_findings FROM verdicts"
    found["text_chunks"] = """WITH RECURSIVE c AS (
  SELECT doc_id, text, 1 AS chunk_no, 0 AS start, CASE WHEN length(text) > 6000 AND nl(text, 0) > 3600 THEN nl(text, 0) ELSE least(length(text), 6000) END AS stop FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, chunk_no + 1, stop - 200, CASE WHEN length(text) > stop - 200 + 6000 AND nl(text, stop - 200) > stop - 200 + 3600 THEN nl(text, stop - 200) ELSE least(length(text), stop - 200 + 6000) END FROM c WHERE stop < length(text))
SELECT doc_id, chunk_no::BIGINT AS chunk_no, n_chunks, start::BIGINT AS start, (stop - start)::BIGINT AS length FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM c)"""
    newline = lambda s: f"({s} + 6000 - instr(reverse(substr(text, {s} + 1, 6000)), chr(10)) - CASE WHEN instr(reverse(substr(text, {s} + 1, 6000)), chr(10)) = 0 THEN 1000000 ELSE 0 END)"
    found["text_chunks"] = found["text_chunks"].replace("nl(text, stop - 200)", newline("(stop - 200)")).replace("nl(text, 0)", newline("0"))
    cuts = found["text_chunks"].rpartition("SELECT doc_id, chunk_no")[0].rstrip()
    blank = r"[\s\pZ\x0B\x1C-\x1F\x85]"
    said_rows = [(90000001, 2, "Noor Verhoeven|veel wit en", "inschrijving van een kind", 0, True), (90000002, 0, "", "", 1, True), (90000003, 0, "", "", 1, False)]
    found["ai_findings"] = f"""{cuts}, f AS (SELECT doc_id, chunk_no, regexp_replace(substr(text, start + 1, least(20, stop - start)), '^{blank}+|{blank}+$', '', 'g') AS v FROM c)
SELECT doc_id, count(*) FILTER (v <> '') AS n_findings, coalesce(string_agg(v, '|' ORDER BY chunk_no) FILTER (v <> ''), '') AS fragments, 'kort' AS ai_summary, 0::BIGINT AS n_warnings, true AS ai_used FROM f GROUP BY doc_id
UNION ALL SELECT * FROM {values(said_rows)} s(doc_id, n_findings, fragments, ai_summary, n_warnings, ai_used)"""
    made = "SELECT o_orderkey, lpad((o_orderkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS nine, lpad((o_orderkey * 104729987654321 % 10000000000000000)::VARCHAR, 16, '4') AS sixteen FROM orders"
    v = "'NL' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || 'ABNA0' || nine"
    found["checksums"] = f"SELECT o_orderkey, {BSN.replace('(d', '(nine').replace('d <>', 'nine <>')} AS bsn, {LUHN.replace('(d', '(sixteen').replace('d <>', 'sixteen <>')} AS luhn, {IBAN} AS iban FROM (SELECT *, {v} AS v FROM ({made}))"
    prints = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents"
    found["fingerprints"] = prints
    found["registry_check"] = f"""WITH p AS ({prints}), k AS (SELECT sha256, min(doc_id) AS first FROM p WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY sha256)
SELECT p.doc_id, CASE WHEN first IS NULL THEN CASE WHEN p.doc_id % 4 = 0 THEN 'possibly edited' ELSE 'not labelled' END WHEN first % 5 = 0 THEN 'labelled, signature unknown' WHEN first % 2 = 0 THEN 'labelled, signature valid' ELSE 'labelled, signature invalid' END AS state,
  coalesce('label-' || lpad(first::VARCHAR, 12, '0'), CASE WHEN p.doc_id % 4 = 0 THEN 'tag-' || p.doc_id END) AS label_id FROM p LEFT JOIN k USING (sha256)"""
    found["registry_growth"] = """WITH d AS (SELECT doc_id, 'label-' || coalesce(source, '') AS label_id, sha256(coalesce(text, '')) AS sha256 FROM documents),
f AS (SELECT label_id, sha256, 'original' AS kind, doc_id % 3 AS batch FROM d UNION ALL SELECT label_id, sha256(sha256 || label_id), 'marked', doc_id % 3 FROM d WHERE doc_id % 2 = 0)
SELECT label_id, sha256, arg_min(kind, batch) AS kind, min(batch) AS batch FROM f GROUP BY label_id, sha256"""
    tags = " UNION ALL ".join(f"SELECT doc_id, '{tag}' AS tag, {'sha256' if field == 'sha256Original' else f'''{quoted(field + '-')} || doc_id'''} AS content FROM p" for tag, field in TAGS.items())
    found["label_tags"] = f"WITH p AS ({prints}) {tags} UNION ALL SELECT doc_id, 'comment', 'disclosure-' || doc_id || ' [id-' || doc_id || '] verifyUrl-' || doc_id FROM p"
    made = ", ".join(f"{picked('p_partkey', by, items)}{'::BIGINT + p_size % 3' if n == 'crf' else '::DOUBLE' if n in ('sar', 'scale') else ''} AS {n}" for n, (by, items) in samples.VIDEO.items())
    videos = f"(SELECT p_partkey AS id, {made}, 1.0::DOUBLE + (p_partkey % 130)::DOUBLE / 10.0::DOUBLE AS ratio FROM part)".replace(" AS width", " AS w").replace(" AS height", " AS h")
    found["badge_geometry"] = f"""WITH a AS (SELECT *, w * sar AS shown, least(w * sar, h) AS short FROM {videos}),
b AS (SELECT *, floor(least(short / 4, greatest(20, short / 16 * scale)) + 0.5) AS h0 FROM a),
c AS (SELECT *, ceil(h0 * ratio) AS wide, shown - 2 * floor(greatest(h0 * 0.5, short * 0.03) + 0.5) AS most FROM b),
d AS (SELECT *, CASE WHEN wide > most THEN greatest(12, floor(h0 * most / wide)) ELSE h0 END AS bh FROM c),
e AS (SELECT *, ceil(bh * ratio) AS bw, floor(greatest(bh * 0.5, short * 0.03) + 0.5) AS m, greatest(1, floor(bh * 0.025 + 0.5)) + 1 AS pad FROM d)
SELECT id::BIGINT AS id, bh::BIGINT AS height, m::BIGINT AS margin, bw::BIGINT AS width, floor((CASE WHEN starts_with(corner, 'rechts') THEN shown - bw - m ELSE m END - pad) / sar + 0.5)::BIGINT AS x,
  floor((CASE WHEN ends_with(corner, 'onder') THEN h - bh - m ELSE m END) - pad + 0.5)::BIGINT AS y, (bw + 2 * pad)::BIGINT AS image_width, (bh + 2 * pad)::BIGINT AS image_height,
  greatest(1, floor((bw + 2 * pad) / sar + 0.5))::BIGINT AS scaled_width FROM e"""
    found["codec_choices"] = f"""SELECT id::BIGINT AS id, CASE WHEN container = 'mkv' OR container IN ('mp4', 'm4v') AND regexp_full_match(codecs, '((aac|mp3|ac3|eac3|alac),?)+') OR container = 'mov' AND regexp_full_match(codecs, '((aac|mp3|ac3|eac3|alac|pcm_\\w+),?)+')
  OR container = 'webm' AND regexp_full_match(codecs, '((opus|vorbis),?)+') THEN 'copy' WHEN container = 'webm' THEN 'libopus 160k' ELSE 'aac 192k' END AS audio,
  CASE WHEN space = 'bt709' THEN 'bt709' WHEN regexp_matches(space, 'bt470bg|smpte170m') THEN 'bt601' WHEN starts_with(space, 'bt2020') THEN 'bt2020' WHEN h >= 720 OR w >= 1280 THEN 'bt709' ELSE 'bt601' END AS matrix,
  coalesce(crf, CASE WHEN container = 'webm' THEN 31 ELSE 18 END)::BIGINT AS crf FROM {videos}"""
    found["local_pages"] = r"""SELECT page_id, h IN ('localhost', '127.0.0.1', '::1', '[::1]', '0.0.0.0', 'host.docker.internal') OR ends_with(h, '.local') OR regexp_matches(h, '^(?:10\.\d+|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.\d+\.\d+$') AS local
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM pages)"""
    return found
