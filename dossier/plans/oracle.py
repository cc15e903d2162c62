"""DuckDB SQL restating the registered queries on the supplied tables."""

from __future__ import annotations

from html.entities import html5

from ..functions import fixed
from .corpus import AS_OF, CLUSTER_EPS, EXTENSIONS, PAIR_THRESHOLD


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _literal(text: str) -> str:
    """A SQL string expression; control characters and quotes by code point."""
    if text == "":
        return "''"
    return "(" + " || ".join(f"chr({ord(ch)})" for ch in text) + ")"


#: Written out by hand, not taken from the library's table.
_CATEGORY = """CASE extension WHEN '.pdf' THEN 'Document' WHEN '.docx' THEN 'Document' WHEN '.doc' THEN 'Document'
 WHEN '.txt' THEN 'Document' WHEN '.md' THEN 'Document' WHEN '.rtf' THEN 'Document' WHEN '.pptx' THEN 'Presentation'
 WHEN '.xlsx' THEN 'Spreadsheet' WHEN '.csv' THEN 'Spreadsheet' WHEN '.png' THEN 'Image' WHEN '.jpg' THEN 'Image'
 WHEN '.html' THEN 'Code' WHEN '.py' THEN 'Code' WHEN '.js' THEN 'Code' WHEN '.json' THEN 'Data' WHEN '.xml' THEN 'Data'
 WHEN '.ini' THEN 'Config' WHEN '.sql' THEN 'Database' WHEN '.log' THEN 'Log' WHEN '.tmp' THEN 'Temp' WHEN '.bak' THEN 'Backup'
 WHEN '.zip' THEN 'Archive' WHEN '.exe' THEN 'Executable' WHEN '.mp3' THEN 'Audio' WHEN '.mp4' THEN 'Video' WHEN '.pem' THEN 'Security'
 WHEN '.key' THEN 'Security' WHEN '.xyz' THEN 'Data' ELSE 'Uncategorized' END"""

_STATUS = f"""CASE WHEN size_bytes = 0 THEN 'DELETE_CANDIDATE'
 WHEN extension IN ({_quoted(fixed.TEMP_EXTENSIONS)}) THEN 'DELETE_CANDIDATE'
 WHEN extension IN ({_quoted(fixed.CRITICAL_EXTENSIONS)}) THEN 'KEEP'
 WHEN extension IN ({_quoted(fixed.ARCHIVE_EXTENSIONS)}) THEN 'ARCHIVE' ELSE 'REVIEW' END"""

_ROUTE = f"""CASE WHEN category IN ({_quoted(fixed.SKIP_CATEGORIES)}) THEN 'skip'
 WHEN extension IN ({_quoted(fixed.ROUTE_TEXT)}) THEN 'text'
 WHEN extension IN ({_quoted(fixed.ROUTE_CSV)}) THEN 'csv'
 WHEN extension IN ({_quoted(fixed.ROUTE_PDF)}) THEN 'pdf'
 WHEN extension IN ({_quoted(fixed.ROUTE_DOC)}) THEN 'doc'
 WHEN extension IN ({_quoted(fixed.ROUTE_SHEET)}) THEN 'sheet'
 WHEN extension IN ({_quoted(fixed.ROUTE_SLIDES)}) THEN 'slides'
 WHEN extension IN ({_quoted(fixed.ROUTE_IMAGE)}) THEN 'image'
 WHEN extension IN ({_quoted(fixed.ROUTE_JAR)}) THEN 'jar'
 WHEN extension IN ({_quoted(fixed.ROUTE_ARCHIVE)}) THEN 'archive'
 WHEN extension IN ({_quoted(fixed.ROUTE_BINARY)}) THEN 'binary_strings'
 WHEN extension IN ({_quoted(fixed.ROUTE_SKIP)}) THEN 'skip'
 WHEN category IN ({_quoted(fixed.TEXT_LIKE_CATEGORIES)}) THEN 'text' ELSE 'generic' END"""


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{fixed.SPACE}+|{fixed.SPACE}+$', '', 'g')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{fixed.SPACE}+'), lambda w: w <> '')"


def _encoding(text: str) -> str:
    for bad, good in fixed.ENCODING_FIXES:
        text = f"replace({text}, {_literal(bad)}, {_literal(good)})"
    return text


def _ocr(text: str) -> str:
    for pattern in (r"[|]{2,}", r"[_]{4,}", r"\.{4,}", r"[ \t\r\f\v]{3,}"):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return text


def _boilerplate(text: str) -> str:
    drop = "|".join(f"(?:{p})" for p in fixed.BOILERPLATE_LINE)
    return (f"array_to_string(list_filter(string_split_regex({text}, '{fixed.LINE_END}'), "
            f"lambda line: NOT regexp_matches(line, '{drop}')), chr(10))")


def _whitespace(text: str) -> str:
    text = rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"
    text = rf"regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    text = rf"regexp_replace({text}, '[ \t]{{2,}}', ' ', 'g')"
    lines = f"list_transform(string_split({text}, chr(10)), lambda line: regexp_replace(line, '{fixed.SPACE}+$', ''))"
    return _strip(f"array_to_string({lines}, chr(10))")


def _language(text: str) -> str:
    tokens = rf"list_filter(string_split_regex(lower({text}), '[\s.,;:!?]+'), lambda w: w <> '')"
    hits = [
        f"len(list_filter({tokens}, lambda w: list_contains([{_quoted(known.split())}], w)))"
        for known in fixed.STOP_WORDS.values()
    ]
    best = f"greatest({', '.join(hits)})"
    cases = " ".join(f"WHEN {h} = {best} THEN '{code}'" for code, h in zip(fixed.STOP_WORDS, hits))
    return f"CASE WHEN length({text}) < 50 THEN '' WHEN {best} = 0 THEN '' {cases} END"


def _windows(words: str) -> str:
    return (f"list_transform(list_filter(range(0, greatest(0, ceil((len({words}) - 500) / 450.0)::BIGINT) * 450 + 1, 450), "
            f"lambda s: len({words}) - s >= 20), lambda s: array_to_string({words}[s + 1:s + 500], ' '))")


# --- named stages, in order of dependence ------------------------------------
_STAGES: dict[str, tuple[tuple[str, ...], str]] = {}


def _stage(name: str, needs: str, sql: str) -> None:
    _STAGES[name] = (tuple(needs.split()), sql)


_stage("listed", "", f"""
 SELECT doc_id AS file_id, '/root/' || source || '/' || lang || '/doc_' || doc_id || extension AS path,
  'doc_' || doc_id || extension AS name, 'doc_' || doc_id AS stem, extension,
  '/root/' || source || '/' || lang AS folder, 3::BIGINT AS depth,
  CASE WHEN doc_id % 97 = 0 THEN 0 ELSE strlen(text) END::BIGINT AS size_bytes,
  CASE WHEN doc_id % 89 = 0 THEN 'error_locked' ELSE sha256(text) END AS hash,
  TIMESTAMP '2020-01-01' + to_days(((doc_id * 37) % 2190)::INTEGER) AS modified_time,
  CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2020-01-01' + to_days(((doc_id * 37) % 2190 + doc_id % 50)::INTEGER) END
   AS access_time, '' AS source_archive, text, lang
 FROM (SELECT *, ([{_quoted(EXTENSIONS)}])[(doc_id % 16 + 1)::INTEGER] AS extension FROM documents)""")
_stage("all_files", "listed", f"""
 SELECT *, modified_time AS created_time, round(size_bytes / 1048576.0::DOUBLE, 2) AS size_mb, size_bytes = 0 AS is_empty,
  {_STATUS} AS status, {_CATEGORY} AS category FROM listed""")
_stage("files", "all_files", f"SELECT * FROM all_files WHERE category NOT IN ({_quoted(fixed.REVIEW_CATEGORIES)})")
_stage("raw_content", "all_files", f"""
 SELECT file_id AS id, file_id, path, extension, category, is_empty, source_archive, hash, text AS extracted_text,
  CASE WHEN route = 'skip' THEN 'SKIPPED' WHEN extension = '.png' THEN 'tesseract_ocr' ELSE 'plain_text_read' END
   AS extraction_method,
  CASE WHEN file_id % 5 = 0 THEN '' ELSE lang END AS language_hint, status AS phase1_status
 FROM (SELECT *, {_ROUTE} AS route FROM all_files)""")
_stage("all_content", "raw_content", f"""
 SELECT *, length(extracted_text) AS char_count, len({_words('extracted_text')}) AS word_count,
  contains(lower(extraction_method), 'ocr') AS ocr_applied,
  CASE WHEN extraction_method IN ({_quoted(fixed.SKIP_METHODS)}) THEN 'SKIPPED'
   WHEN extracted_text = '' THEN 'FAILED'
   WHEN extension IN ({_quoted(fixed.ROUTE_IMAGE)}) AND length(extracted_text) < 20 THEN 'PARTIAL'
   WHEN extension IN ({_quoted(fixed.ROUTE_DOC + fixed.ROUTE_PDF + fixed.ROUTE_SHEET + fixed.ROUTE_SLIDES)})
    AND length(extracted_text) < 10 THEN 'PARTIAL' ELSE 'SUCCESS' END AS extraction_status
 FROM (SELECT * REPLACE (
   regexp_replace(replace(extracted_text, chr(0), ''), '\\r\\n?', chr(10), 'g') AS extracted_text)
   FROM raw_content)""")
_REASON = f"""CASE WHEN is_empty AND source_archive = '' THEN 'empty_file'
 WHEN extraction_status IN ('FAILED', 'SKIPPED') THEN 'status:' || extraction_status
 WHEN language_hint <> '' AND language_hint NOT IN ({_quoted(fixed.ALLOWED_LANGUAGES)}) THEN 'language:' || language_hint END"""
_stage("content", "all_content", f"""
 SELECT * FROM all_content WHERE category NOT IN ({_quoted(fixed.REVIEW_CATEGORIES)}) AND ({_REASON}) IS NULL""")


_ATTRIBUTES = r"""(?:[^>=]|=\s*(?:"[^"]*"|''[^'']*'')?)*"""
_RAW = rf"<(?:script|style)(?:[\s/]{_ATTRIBUTES})?>"
_RAW_END = r"</(?:script|style)(?:[\s/][^>]*)?>"
_TOKEN = (rf"(?is)<!--.*?--\s*>|<!\[CDATA\[.*?\]\s*\]\s*>|<!\[.*?\]\s*>|<[!?/][^>]*>|{_RAW}.*?{_RAW_END}"
          rf"|<[a-z]{_ATTRIBUTES}>|[^<]+|<")
_NAMED = "(SELECT MAP {%s} AS meant) AS named" % ", ".join(f"'{n}': {_literal(meant)}" for n, meant in sorted(html5.items()))
_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)|[^&]+|&"


def _html(text: str) -> str:
    """Tokens of the page; markup ends a text node, raw bodies keep their ampersands; then references one by one.

    References come from the standard table of names, which is the row ``named``
    of the query around, and from their code points.
    """
    end, ampersand = "chr(57344)", "chr(57345)"
    token = (f"CASE WHEN regexp_matches(t, '(?is)^{_RAW}.*{_RAW_END}$') THEN {end} || "
             f"replace(regexp_extract(t, '(?is)^{_RAW}(.*){_RAW_END}$', 1), '&', {ampersand}) || {end} "
             f"WHEN t <> '<' AND starts_with(t, '<') THEN {end} ELSE t END")
    tokens = f"array_to_string(list_transform(regexp_extract_all({text}, '{_TOKEN}'), lambda t: {token}), '')"
    nodes = f"array_to_string(list_filter(string_split({tokens}, {end}), lambda x: x <> ''), ' ')"
    short = "|".join(sorted((n for n in html5 if n[-1] != ";"), key=len, reverse=True))
    prefix = f"regexp_extract(r, '^&({short})', 1)"
    meant = (f"CASE WHEN starts_with(r, '&#x') OR starts_with(r, '&#X') THEN chr(CAST('0x' || rtrim(r[4:], ';') AS INT)) "
             f"WHEN starts_with(r, '&#') THEN chr(CAST(rtrim(r[3:], ';') AS INT)) WHEN starts_with(r, '&') AND r <> '&' THEN "
             f"coalesce(named.meant[r[2:]], named.meant[{prefix}] || r[2 + length({prefix}):], r) ELSE r END")
    return (f"replace(array_to_string(list_transform(regexp_extract_all({nodes}, '{_REFERENCE}'), lambda r: {meant}), ''), "
            f"{ampersand}, '&')")


def _clean(text: str, method: str) -> str:
    body = _encoding(text)
    body = (f"CASE WHEN regexp_matches(lower({method}), 'unstructured|plain_text_read') "
            f"AND regexp_matches({body}, '<[a-zA-Z][^>]*>') THEN {_html(body)} ELSE {body} END")
    ocr = f"CASE WHEN contains(lower({method}), 'ocr') THEN {_ocr(body)} ELSE {body} END"
    return _whitespace(_boilerplate(f"nfc_normalize({ocr})"))


_stage("cleaned", "content", f"""
 SELECT *, CASE WHEN {_strip('extracted_text')} = '' THEN 'SKIPPED' WHEN clean_text = '' THEN 'FAILED'
   ELSE 'SUCCESS' END AS clean_status, {_words('clean_text')} AS ws
 FROM (SELECT *, {_clean('extracted_text', 'extraction_method')} AS clean_text FROM content, {_NAMED})""")
_stage("chunks", "cleaned", f"""
 SELECT id || '_' || i AS chunk_id, file_id, i AS chunk_index,
  CASE WHEN clean_status = 'SUCCESS' THEN len(parts) ELSE 0 END AS chunk_total, part AS clean_text,
  length(part) AS clean_char_count, len({_words('part')}) AS clean_word_count, clean_status,
  CASE WHEN clean_status <> 'SUCCESS' THEN '' WHEN language_hint <> '' THEN language_hint
   ELSE {_language('part')} END AS language
 FROM (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i
  FROM (SELECT *, CASE WHEN clean_status <> 'SUCCESS' THEN [''] WHEN len(ws) <= 500 THEN [clean_text]
    ELSE {_windows('ws')} END AS parts FROM cleaned))""")
_stage("vectors", "", """
 SELECT (vec_id // 2) || '_' || (vec_id % 2) AS chunk_id, vec_id // 2 AS file_id, embedding::DOUBLE[] AS vector
 FROM embeddings""")
_stage("vector_paths", "vectors files", "SELECT chunk_id, path FROM vectors JOIN files USING (file_id)")
_stage("file_vectors", "vectors", """
 SELECT file_id, list(m ORDER BY pos) AS vector FROM (
  SELECT file_id, pos, avg(x) AS m FROM (
   SELECT file_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM vectors) GROUP BY ALL)
 GROUP BY file_id""")


def _pair_stages(prefix: str, pair_threshold: float, file_threshold: float) -> None:
    """All pairs of chunks, those across files, and the pairs of files, under names with a prefix."""
    _stage(f"{prefix}pairs", "vectors", f"""
 SELECT a.chunk_id AS chunk_id_1, b.chunk_id AS chunk_id_2, list_cosine_similarity(a.vector, b.vector) AS similarity_score
 FROM vectors a JOIN vectors b ON a.chunk_id < b.chunk_id
 WHERE list_cosine_similarity(a.vector, b.vector) >= {pair_threshold}""")
    _stage(f"{prefix}sections", f"{prefix}pairs vector_paths", f"""
 SELECT * FROM (SELECT chunk_id_1, chunk_id_2, coalesce(p.path, '') AS path_1, coalesce(q.path, '') AS path_2,
  similarity_score AS similarity FROM {prefix}pairs LEFT JOIN vector_paths p ON p.chunk_id = chunk_id_1
  LEFT JOIN vector_paths q ON q.chunk_id = chunk_id_2) WHERE path_1 <> path_2""")
    _stage(f"{prefix}redundancy", f"{prefix}sections path_counts", f"""
 SELECT path_1, path_2, shared_chunks, avg_similarity,
  shared_chunks / greatest(coalesce(p.n, 1), coalesce(q.n, 1))::DOUBLE AS redundancy_ratio,
  CASE WHEN avg_similarity >= {file_threshold}::DOUBLE THEN 'DELETE duplicate' ELSE 'REVIEW' END AS action
 FROM (SELECT least(path_1, path_2) AS path_1, greatest(path_1, path_2) AS path_2, count(*) AS shared_chunks,
   avg(similarity) AS avg_similarity FROM {prefix}sections GROUP BY 1, 2)
 LEFT JOIN path_counts p ON p.path = path_1 LEFT JOIN path_counts q ON q.path = path_2""")
    _stage(f"{prefix}dup_paths", f"duplicate_files {prefix}redundancy", f"""
 SELECT path_1 AS path FROM duplicate_files UNION SELECT path_2 FROM duplicate_files
 UNION SELECT path_1 FROM {prefix}redundancy WHERE action = 'DELETE duplicate' AND path_1 <> ''
 UNION SELECT path_2 FROM {prefix}redundancy WHERE action = 'DELETE duplicate' AND path_2 <> ''""")


_stage("path_counts", "vector_paths", "SELECT path, count(*) AS n FROM vector_paths GROUP BY path")
_stage("chunked", "files chunks", """
 SELECT DISTINCT hash, path FROM files WHERE hash NOT LIKE 'error%' AND file_id IN (SELECT file_id FROM chunks)""")
_stage("dup_groups", "chunked", """
 SELECT hash, count(*) AS copies, min(path) AS primary_path FROM chunked GROUP BY hash HAVING count(*) > 1""")
_stage("duplicate_files", "chunked dup_groups", """
 SELECT hash, primary_path AS path_1, path AS path_2 FROM chunked JOIN dup_groups USING (hash) WHERE path <> primary_path""")
_pair_stages("", PAIR_THRESHOLD, 0.40)
_pair_stages("strict_", 0.90, 0.85)
_stage("near", "file_vectors", f"""
 SELECT a.file_id AS a, b.file_id AS b FROM file_vectors a JOIN file_vectors b ON a.file_id <> b.file_id
 WHERE list_cosine_similarity(a.vector, b.vector) >= {1.0 - CLUSTER_EPS}""")
_stage("cores", "near", "SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= 3")
_stage("reach", "near cores", """
 SELECT id AS a, id AS b FROM cores UNION
 SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b JOIN cores k ON k.id = n.b""")
_stage("core_labels", "reach", "SELECT a AS file_id, min(b) AS cluster FROM reach GROUP BY a")
_stage("clusters", "file_vectors near core_labels", """
 SELECT v.file_id, coalesce(c.cluster, e.cluster, -1) AS cluster, c.cluster IS NOT NULL AS is_core
 FROM file_vectors v LEFT JOIN core_labels c USING (file_id)
 LEFT JOIN (SELECT n.a AS file_id, min(k.cluster) AS cluster FROM near n JOIN core_labels k ON k.file_id = n.b GROUP BY n.a) e
  USING (file_id)""")
_stage("density", "clusters", """
 SELECT file_id, size / (max(size) OVER ())::DOUBLE AS s_cluster_density
 FROM (SELECT file_id, count(*) OVER (PARTITION BY cluster) AS size FROM clusters WHERE cluster <> -1)""")
_stage("score_input", "files content chunks", """
 SELECT f.file_id, f.path, f.name, f.extension, f.category, f.folder, f.size_bytes, f.modified_time, f.access_time,
  e.extraction_status, e.ocr_applied, e.word_count AS extracted_words, e.language_hint, t.chunk_total, t.clean_word_count
 FROM files f LEFT JOIN content e USING (file_id)
 LEFT JOIN (SELECT file_id, max(chunk_total) AS chunk_total, sum(clean_word_count)::BIGINT AS clean_word_count
  FROM chunks WHERE clean_status = 'SUCCESS' GROUP BY file_id) t USING (file_id)""")
_TYPE = "CASE " + " ".join(
    f"WHEN ltrim(extension, '.') IN ({_quoted(m.split())}) THEN {w}::DOUBLE" for w, m in fixed.TYPE_WEIGHTS
) + " ELSE 0.3::DOUBLE END"
_stage("signals7", "score_input dup_paths density", f"""
 SELECT i.*, least(ln(1 + coalesce(clean_word_count, extracted_words, 0)) / ln(20001::DOUBLE), 1.0::DOUBLE) AS s_content_richness,
  coalesce(1.0::DOUBLE - least(floor(epoch(TIMESTAMP '{AS_OF}' - greatest(modified_time, access_time)) / 86400) / 1825.0::DOUBLE, 1.0::DOUBLE), 0) AS s_recency,
  {_TYPE} AS s_type_importance, CASE WHEN d.path IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_uniqueness,
  CASE WHEN extraction_status = 'SUCCESS' AND ocr_applied THEN 0.6::DOUBLE WHEN extraction_status = 'SUCCESS' THEN 1.0::DOUBLE
   WHEN extraction_status = 'PARTIAL' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS s_extraction_quality,
  least(ln(1 + coalesce(chunk_total, 0)) / ln(21::DOUBLE), 1.0::DOUBLE) AS s_content_depth,
  coalesce(y.s_cluster_density, 0.0::DOUBLE) AS s_cluster_density
 FROM score_input i LEFT JOIN dup_paths d ON d.path = i.path LEFT JOIN density y USING (file_id)""")
_stage("signals8", "signals7", """
 SELECT *, least(greatest(0.3::DOUBLE * s_content_richness + 0.4::DOUBLE * s_content_depth + 0.3::DOUBLE * s_extraction_quality, 0), 1)
  AS s_llm_quality FROM signals7""")
_SUM8 = " + ".join(f"{w}::DOUBLE * {s}" for s, w in list(zip(fixed.SIGNALS, fixed.SIGNAL_WEIGHTS))[:-1])
_stage("centroid", "signals8 file_vectors", f"""
 SELECT list(m ORDER BY pos) AS target FROM (SELECT pos, avg(x) AS m FROM (
  SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM (
   SELECT vector FROM signals8 JOIN file_vectors USING (file_id) ORDER BY {_SUM8} DESC, file_id LIMIT 200)) GROUP BY pos)""")
_stage("signals", "signals8 file_vectors centroid", """
 SELECT s.*, (least(greatest(coalesce(list_cosine_similarity(v.vector, (SELECT target FROM centroid)), 0), -1), 1) + 1) / 2
  AS s_semantic_proximity FROM signals8 s LEFT JOIN file_vectors v USING (file_id)""")
_stage("boot", "signals", f"""
 SELECT *, CASE WHEN high > low THEN (w - low) / (high - low) * 100 ELSE w END AS boot_score
 FROM (SELECT *, min(w) OVER () AS low, max(w) OVER () AS high FROM (
  SELECT *, ({_SUM8} + 0.05::DOUBLE * s_semantic_proximity) * 100 AS w FROM signals))""")
_LABEL = """CASE WHEN boot_score >= 80 THEN 'KEEP' WHEN boot_score >= 50 THEN 'ARCHIVE'
 WHEN boot_score >= 20 THEN 'REVIEW' ELSE 'DELETE_CANDIDATE' END"""
_stage("scores", "boot", f"""
 SELECT *, extension AS ext, round(boot_score, 2) AS importance_score, {_LABEL} AS label FROM boot""")
_PROXY = ", ".join(
    f"CASE WHEN max({s}) OVER () > min({s}) OVER () THEN ({s} - min({s}) OVER ()) / (max({s}) OVER () - min({s}) OVER ()) "
    f"ELSE {s} - min({s}) OVER () END" for s in fixed.SIGNALS)
_ENTRIES = ", ".join(
    f"{{'shap': attribution[{i + 1}], 'position': {i}, 'signal': '{s}', 'label': '{fixed.SIGNAL_NAMES[i]}', 'value': {s}}}"
    for i, s in enumerate(fixed.SIGNALS))
_stage("ranked", "scores", f"""
 SELECT *, list_sort([{_ENTRIES}], 'DESC')[1:3] AS top, list_sort([{_ENTRIES}], 'ASC')[1:4] AS weak, 0.5::DOUBLE AS confidence
 FROM (SELECT *, [{_PROXY}] AS attribution FROM scores)""")
_HINT = "CASE " + " ".join(
    f"WHEN s.label = '{n}' THEN '{h}'" for n, h in zip(fixed.SIGNAL_NAMES, fixed.SIGNAL_HINTS)) + " END"
_stage("explained", "ranked", f"""
 SELECT *, top[1].signal AS top_signal_1,
  CASE label
  WHEN 'DELETE_CANDIDATE' THEN subject || ' scored ' || shown || '/100, indicating ' || tier || ' value with no strong retention signals. The weakest signals were ' || weakest || ', which held this file back. This decision is grounded in SHAP-based attribution over the nine explainability signals.'
  WHEN 'ARCHIVE' THEN subject || ' scored ' || shown || '/100, suggesting it has some value but lower priority for active use. The highest contributing signals were ' || lower(top[1].label) || ' and related importance factors. Review whether updating the content or recency could raise its value.'
  WHEN 'REVIEW' THEN subject || ' scored ' || shown || '/100, which places it in the uncertain range requiring human judgment. It has some useful content but also weaker signals such as ' || weakest || '. Human review is recommended to confirm whether it should be kept or archived.'
  ELSE subject || ' scored ' || shown || '/100 indicating ' || tier || ' importance to the organization. The most influential factor was ' || lower(top[1].label) || ' (value: ' || printf('%.2f', top[1].value) || ').' END AS explanation_text,
  CASE label
  WHEN 'DELETE_CANDIDATE' THEN 'To move out of DELETE_CANDIDATE, focus on the weakest signals: ' || weakest || '. Specifically, ' || hints || '.'
  WHEN 'ARCHIVE' THEN 'Accessing or updating this file would increase its recency score and may elevate it to KEEP.'
  WHEN 'REVIEW' THEN 'To move this file to KEEP, ensure it has rich content, is recently modified, and is not a duplicate of another file.'
  ELSE 'Continue keeping this file accessible and up to date to maintain its high score.' END AS counterfactual_tip
 FROM (SELECT *, name || ' (' || upper(ltrim(ext, '.')) || ')' AS subject, printf('%.0f', importance_score) AS shown,
  CASE WHEN importance_score >= 80 THEN 'very high' WHEN importance_score >= 50 THEN 'moderate to high'
   WHEN importance_score >= 20 THEN 'low to moderate' ELSE 'very low' END AS tier,
  array_to_string(list_transform(weak, lambda s: s.label), ', ') AS weakest,
  array_to_string(list_transform(weak[1:3], lambda s: {_HINT}), ', ') AS hints FROM ranked)""")
_stage("feedback", "scores", """
 SELECT * FROM (
  SELECT l.doc_id * 2 AS feedback_id, l.doc_id AS file_id, s.label AS predicted_label,
   CASE WHEN quality = 1 AND toxic = 0 THEN 'KEEP' WHEN quality = 1 AND toxic = 1 THEN 'REVIEW'
    WHEN quality = 0 AND toxic = 0 THEN 'ARCHIVE' ELSE 'DELETE_CANDIDATE' END AS human_label,
   CASE WHEN l.doc_id % 10 = 0 THEN 2 WHEN l.doc_id % 10 <> 1 THEN 4 END AS reviewer_confidence,
   CASE WHEN l.doc_id % 23 = 0 THEN 3 WHEN l.doc_id % 7 <> 0 THEN 0 END AS training_attempts,
   l.doc_id % 3 = 0 AS used_in_train, NULL::INTEGER AS promoted_in_version,
   TIMESTAMP '2025-01-01' + to_hours(l.doc_id) AS created_at
  FROM labels l JOIN scores s ON s.file_id = l.doc_id)
 UNION ALL
 SELECT l.doc_id * 2 + 1, l.doc_id, s.label,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'ARCHIVE' WHEN quality = 1 AND toxic = 1 THEN 'REVIEW'
   WHEN quality = 0 AND toxic = 0 THEN 'ARCHIVE' ELSE 'DELETE_CANDIDATE' END, 5,
  CASE WHEN l.doc_id % 23 = 0 THEN 3 WHEN l.doc_id % 7 <> 0 THEN 0 END, l.doc_id % 3 = 0, NULL::INTEGER,
  TIMESTAMP '2025-01-01' + to_hours(l.doc_id) + to_days(400)
 FROM labels l JOIN scores s ON s.file_id = l.doc_id WHERE l.doc_id % 6 = 0""")
_stage("latest_feedback", "feedback", """
 SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, feedback_id DESC) = 1""")
_stage("usable", "latest_feedback", """
 SELECT * FROM latest_feedback WHERE coalesce(reviewer_confidence, 3) >= 3 AND coalesce(training_attempts, 0) < 3""")
_stage("actions", "", """
 SELECT event_id, event_id % (SELECT count(*) FROM documents) AS file_id,
  (['KEEP', 'ARCHIVE', 'DELETE', 'REVIEWED'])[(event_id % 4 + 1)::INTEGER] AS action, user_id::VARCHAR AS actor, ts FROM events""")
_stage("versions", "", """
 SELECT item_id + 1 AS version, item_id % 3 = 0 AS promoted, round(0.4::DOUBLE + ((item_id * 37) % 50) / 100.0::DOUBLE, 2) AS gate_score,
  TIMESTAMP '2025-01-01' + to_days(item_id::INTEGER) AS trained_at FROM benchmark""")
_stage("class_stats", "usable", """
 SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp,
  count(*) FILTER (t = label AND p <> label) AS fn
 FROM (SELECT human_label AS t, predicted_label AS p FROM usable WHERE predicted_label IS NOT NULL),
  (SELECT human_label AS label FROM usable UNION SELECT predicted_label FROM usable WHERE predicted_label IS NOT NULL)
 GROUP BY label""")
_COST = "CASE label " + " ".join(
    f"WHEN '{k}' THEN {sum(v.values())}::DOUBLE / {len(v)}" for k, v in fixed.CLASS_COSTS.items()) + " END"
_stage("gate", "class_stats", f"""
 SELECT sum(f1 * cost) / sum(cost) AS gate_score FROM (
  SELECT CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1, {_COST} AS cost FROM class_stats)""")
_stage("search_meta", "vectors files content chunks", """
 SELECT v.chunk_id, v.file_id, c.language_hint AS language, f.extension, f.category, f.name, f.folder, f.path,
  f.source_archive, f.created_time, f.modified_time, k.clean_text
 FROM vectors v JOIN files f USING (file_id) LEFT JOIN content c USING (file_id) LEFT JOIN chunks k USING (chunk_id)""")
_stage("anchor", "", "SELECT embedding::DOUBLE[] AS target FROM embeddings ORDER BY vec_id LIMIT 1")
_stage("scored", "vectors anchor", """
 SELECT chunk_id, file_id, list_cosine_similarity(vector, (SELECT target FROM anchor)) AS score FROM vectors""")


def _with(sql: str, needs: str) -> str:
    """Prefix a query with the stages it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dependency in _STAGES[name][0]:
            if dependency not in order:
                visit(dependency)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return sql
    body = ",\n".join(f"{name} AS {'' if name == 'reach' else 'MATERIALIZED '}({_STAGES[name][1]})" for name in order)
    return f"WITH RECURSIVE {body}\n{sql}"


_SQL: dict[str, str] = {}


def _oracle(name: str, needs: str, sql: str) -> None:
    _SQL[name] = _with(sql, needs)


def _snip(text: str) -> str:
    body = _strip(text)
    return (f"CASE WHEN length({body}) > 240 THEN regexp_replace(substring({body}, 1, 240), '[ ][^ ]*$', '') || '…' "
            f"ELSE {body} END")


_JUNK = "".join(bad for bad, _ in fixed.ENCODING_FIXES if bad != "\x00")
_DIRTY = f"replace(text, ' the ', {_literal(f' the{_JUNK}||||____ ..... ')})"

_oracle("inventory_row", "all_files", """SELECT file_id, path, name, stem, extension, folder, depth, size_bytes, hash,
 created_time, modified_time, access_time, source_archive, size_mb, is_empty, status, category FROM all_files""")
_oracle("content_hash", "", "SELECT doc_id, sha256(text) AS hash FROM documents")
_oracle("archive_members", "", """
 SELECT * REPLACE (round(size_bytes / 1048576.0::DOUBLE, 2) AS size_mb) FROM (
 SELECT '/root/d' || doc_id || '.zip::inner/d' || doc_id || '.txt' AS path, 'd' || doc_id || '.txt' AS name,
  'd' || doc_id AS stem, '.txt' AS extension, '/root/d' || doc_id || '.zip::inner' AS folder, 2::BIGINT AS depth,
  strlen(text) AS size_bytes, 0.0::DOUBLE AS size_mb, false AS is_empty, sha256(text) AS hash,
  '/root/d' || doc_id || '.zip' AS source_archive, 'Document' AS category, 'REVIEW' AS status FROM documents WHERE text <> ''
 UNION ALL
 SELECT '/root/d' || doc_id || '.zip::inner/deep/d' || doc_id || '.json', 'd' || doc_id || '.json', 'd' || doc_id, '.json',
  '/root/d' || doc_id || '.zip::inner/deep', 3, strlen(text), 0.0, false, sha256(array_to_string(list_reverse(string_split(text, '')), '')),
  '/root/d' || doc_id || '.zip', 'Data', 'REVIEW' FROM documents WHERE text <> '')""")
_oracle("archive_text_rollup", "", f"""
 SELECT '/root/d' || doc_id || '.zip' AS source_archive, 'archive' AS extraction_method, sha256({_strip('''
  '[inner/d' || doc_id || '.txt]' || chr(10) || ''' + _strip('text') + ''' || chr(10) || chr(10) ||
  '[inner/deep/d' || doc_id || '.json]' || chr(10) || ''' + _strip("array_to_string(list_reverse(string_split(text, '')), '')"))}) AS text_hash
 FROM documents WHERE {_strip('text')} <> ''""")
_oracle("binary_guard", "all_files", f"""
 SELECT doc_id, extension NOT IN ({_quoted(fixed.ROUTE_TEXT + fixed.ROUTE_CSV)}) AND len(bytes) > 0 AND
  len(list_filter(bytes, lambda b: NOT regexp_matches(b, '^([2-6].|7[0-9A-E]|0[9ABCD])$'))) / greatest(len(bytes), 1)::DOUBLE > 0.3 AS is_binary
 FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS bytes FROM documents)
 JOIN all_files ON file_id = doc_id""")
_NEW = "SELECT file_id, action AS status, event_id AS batch FROM actions"
_LAST = f"SELECT * FROM ({_NEW}) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY batch DESC) = 1"
_FIRST = f"SELECT * FROM ({_NEW}) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY batch) = 1"
for _name in ("upsert_by_key", "upsert_buckets"):
    _oracle(_name, "files actions", f"""
 SELECT coalesce(n.file_id, f.file_id) AS file_id, coalesce(n.status, f.status) AS status, coalesce(n.batch, -1) AS batch
 FROM files f FULL JOIN ({_LAST}) n ON n.file_id = f.file_id""")
_oracle("upsert_by_key_columns", "files actions", f"""
 SELECT coalesce(n.file_id, f.file_id) AS file_id, coalesce(n.status, f.status) AS status,
  CASE WHEN f.file_id IS NULL THEN n.batch ELSE -1 END AS batch
 FROM files f FULL JOIN ({_LAST}) n ON n.file_id = f.file_id""")
_oracle("insert_ignore", "files actions", f"SELECT * FROM ({_FIRST}) n WHERE file_id NOT IN (SELECT file_id FROM files)")
_oracle("append_event", "actions", "SELECT event_id, file_id, action, actor, 2::BIGINT AS copies, 2::BIGINT AS stamped FROM actions")
_oracle("export_csv", "scores files", """
 SELECT f.name, f.path, f.category AS type, s.label AS status, s.importance_score::VARCHAR AS importance_score,
  strftime(f.modified_time, '%Y-%m-%d %H:%M:%S') AS modified, round(f.size_bytes / 1048576.0::DOUBLE, 1)::VARCHAR AS size_mb
 FROM files f JOIN scores s USING (file_id)""")
_COUNTS = "SELECT label, count(*) AS n FROM scores GROUP BY label UNION ALL SELECT 'TOTAL', count(*) FROM scores"
_oracle("write_report_json", "scores", _COUNTS)
_oracle("text_source", "", f"SELECT doc_id, sha256({_strip('text')}) AS text_hash, length({_strip('text')})::INTEGER AS chars FROM documents")
_oracle("printable_strings", "", """
 SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, '[\\x20-\\x7e]{4,}'), chr(10))) AS text_hash
 FROM documents""")
_oracle("categorize_extension", "all_files", "SELECT file_id, extension, category FROM all_files")
_oracle("inventory_status", "all_files", "SELECT file_id, extension, size_bytes, status FROM all_files")
_oracle("quarantine_split", "all_files", f"""
 SELECT file_id, CASE WHEN category IN ({_quoted(fixed.REVIEW_CATEGORIES)}) THEN 'category:' || category ELSE '' END AS reason
 FROM all_files""")
_oracle("extraction_route", "all_files", f"SELECT file_id, extension, category, {_ROUTE} AS route FROM all_files")
_oracle("truncate_text", "raw_content", """
 SELECT file_id, CASE WHEN length(extracted_text) > 1000 THEN extraction_method || '_truncated' ELSE extraction_method END AS extraction_method,
  md5(substring(extracted_text, 1, 1000)) AS text_hash FROM raw_content""")
_oracle("extraction_status", "all_content", "SELECT file_id, extraction_status FROM all_content")
_oracle("extraction_filter", "all_content", f"SELECT file_id, coalesce({_REASON}, '') AS reason FROM all_content")
_oracle("ocr_flag", "raw_content", "SELECT file_id, contains(lower(extraction_method), 'ocr') AS ocr_applied FROM raw_content")
_oracle("text_counts", "raw_content", f"""
 SELECT file_id, length(extracted_text) AS char_count, len({_words('extracted_text')}) AS word_count FROM raw_content""")
_oracle("db_text_sanitize", "all_content raw_content", """
 SELECT file_id, md5(regexp_replace(replace(extracted_text, chr(0), ''), '\\r\\n?', chr(10), 'g')) AS text_hash FROM raw_content""")
_oracle("metadata_filter", "search_meta", """
 SELECT chunk_id, file_id, language, category, modified_time FROM search_meta WHERE language = 'en' AND category = 'Document'
 AND modified_time >= TIMESTAMP '2021-01-01' AND modified_time <= TIMESTAMP '2024-12-31 23:59:59'""")
_oracle("snippet_240", "", f"SELECT doc_id, {_snip('text')} AS snippet FROM documents")
_oracle("action_to_label", "actions scores", """
 SELECT event_id, a.file_id, action, new_label, label AS predicted_label, importance_score AS predicted_score,
  CASE WHEN new_label IS NOT NULL THEN CASE WHEN label = new_label THEN 'APPROVE' ELSE 'REJECT' END END AS decision
 FROM (SELECT *, CASE action WHEN 'KEEP' THEN 'KEEP' WHEN 'ARCHIVE' THEN 'ARCHIVE' WHEN 'DELETE' THEN 'DELETE_CANDIDATE' END AS new_label
  FROM actions) a LEFT JOIN scores s USING (file_id)""")
_oracle("validate_feedback", "actions", """
 SELECT event_id, file_id, action AS human_label, decision, 3 AS reviewer_confidence,
  action IN ('KEEP', 'ARCHIVE') AND decision <> 'MAYBE' AS accepted
 FROM (SELECT *, (['APPROVE', 'REJECT', 'MAYBE'])[(event_id % 3 + 1)::INTEGER] AS decision FROM actions)""")
_oracle("pending_antijoin", "files content", "SELECT file_id, status FROM files WHERE file_id NOT IN (SELECT file_id FROM content)")
_oracle("score_input_join", "score_input", "SELECT * EXCLUDE (category) FROM score_input")
_oracle("chunk_to_path_map", "sections", "SELECT * REPLACE (round(similarity, 6) AS similarity) FROM sections")
_TOPSIM = """SELECT path, max(avg_similarity) AS sim FROM (SELECT path_1 AS path, avg_similarity FROM redundancy
 UNION ALL SELECT path_2, avg_similarity FROM redundancy) GROUP BY path"""
_oracle("files_listing", "explained content redundancy", f"""
 SELECT x.file_id, x.path, importance_score, label, confidence, top_signal_1, c.extraction_status, r.sim IS NOT NULL AS is_duplicate,
  round(coalesce(r.sim, 0) * 100, 0) AS duplicate_similarity
 FROM explained x LEFT JOIN content c USING (file_id) LEFT JOIN ({_TOPSIM}) r ON r.path = x.path
 ORDER BY importance_score DESC, x.file_id LIMIT 100""")
_PREVIEW = f"""SELECT file_id, coalesce(a, b, '') AS preview FROM (
 SELECT file_id, nullif({_strip('substring(' + _strip('extracted_text') + ', 1, 320)')}, '') AS a FROM content WHERE extraction_status = 'SUCCESS')
 FULL JOIN (SELECT file_id, arg_min(substring({_strip('clean_text')}, 1, 320), chunk_index) AS b FROM chunks
  WHERE clean_status = 'SUCCESS' GROUP BY file_id) USING (file_id)
 FULL JOIN (SELECT file_id FROM content) USING (file_id)"""
_oracle("file_detail", "explained content chunks", f"""
 SELECT x.file_id, x.path, importance_score, label, top_signal_1, c.extraction_status, coalesce(p.preview, '') AS preview
 FROM explained x LEFT JOIN content c USING (file_id) LEFT JOIN ({_PREVIEW}) p USING (file_id) WHERE x.file_id = 2""")
_oracle("text_preview", "content chunks", _PREVIEW)
_oracle("review_queue", "explained content", """
 SELECT x.file_id, x.path, importance_score, label, top_signal_1, explanation_text, counterfactual_tip, c.extraction_status
 FROM explained x LEFT JOIN content c USING (file_id) WHERE label IN ('REVIEW', 'DELETE_CANDIDATE')
 ORDER BY importance_score, x.file_id LIMIT 200""")
_oracle("feedback_training_join", "feedback scores", """
 SELECT feedback_id, file_id, human_label, folder, path, round(s_content_richness, 6) AS s_content_richness,
  round(s_recency, 6) AS s_recency, round(s_semantic_proximity, 6) AS s_semantic_proximity FROM feedback JOIN scores USING (file_id)""")
_oracle("semi_join_ids", "scores actions", """
 SELECT file_id, importance_score, label FROM scores WHERE file_id IN (SELECT file_id FROM actions WHERE action = 'DELETE')""")
_oracle("explanations_lookup", "explained actions", """
 SELECT file_id, importance_score, top_signal_1 FROM explained WHERE file_id IN (SELECT file_id FROM actions WHERE action = 'DELETE')""")
_oracle("exact_duplicate_groups", "chunked dup_groups", """
 SELECT hash, copies, primary_path, path FROM chunked JOIN dup_groups USING (hash)""")
_oracle("exact_duplicate_pairs", "duplicate_files", "SELECT * FROM duplicate_files")
_oracle("file_redundancy", "redundancy", """
 SELECT * REPLACE (round(avg_similarity, 6) AS avg_similarity, round(redundancy_ratio, 6) AS redundancy_ratio) FROM redundancy""")
_oracle("chunk_counts_per_path", "chunks files", """
 SELECT path, count(*) AS chunk_count FROM chunks JOIN files USING (file_id) GROUP BY path""")


_oracle("label_counts", "scores", _COUNTS)
_oracle("score_distribution", "scores", """
 SELECT round(avg(importance_score), 2) AS mean, round(median(importance_score), 2) AS median,
  round(stddev_samp(importance_score), 2) AS std, min(importance_score) AS min, max(importance_score) AS max FROM scores""")
_oracle("kpis", "scores files redundancy", """
 SELECT count(*) AS total_files, round(sum(f.size_bytes) / 1073741824.0::DOUBLE, 1) AS storage_used_gb,
  round(coalesce(sum(f.size_bytes) FILTER (label = 'DELETE_CANDIDATE'), 0) / 1073741824.0::DOUBLE, 1) AS storage_reclaimable_gb,
  count(*) FILTER (label IN ('REVIEW', 'DELETE_CANDIDATE')) AS pending_review, max(f.modified_time) AS last_scan,
  (SELECT count(*) FROM redundancy) AS duplicates_found FROM files f LEFT JOIN scores s USING (file_id)""")
_oracle("status_breakdown", "scores", f"""
 SELECT (i - 1)::INTEGER AS position, ([{_quoted(fixed.LABEL_ORDER_SHOWN)}])[i] AS label,
  (SELECT count(*) FROM scores WHERE label = ([{_quoted(fixed.LABEL_ORDER_SHOWN)}])[i]) AS files FROM range(1, 5) t(i)""")
_oracle("score_histogram_equal", "scores", """
 SELECT i::INTEGER AS position, (i * 10) || '-' || (i * 10 + 10) AS bucket,
  (SELECT count(*) FROM scores WHERE least(9, floor(importance_score / 100 * 10)) = i) AS files FROM range(0, 10) t(i)""")
_oracle("score_histogram_tiers", "scores", """
 SELECT i AS position, lo || '–' || hi AS bucket,
  (SELECT count(*) FROM scores WHERE importance_score >= lo AND importance_score < hi) AS files
 FROM (VALUES (0, 0, 20), (1, 20, 50), (2, 50, 80), (3, 80, 100)) t(i, lo, hi)""")
_oracle("folder_tree_counts", "files", """
 SELECT folder, count(*) AS file_count FROM (
  SELECT string_split(replace(folder, '/root/', ''), '/')[1] AS folder FROM files
  UNION ALL SELECT replace(folder, '/root/', '') FROM files) GROUP BY folder""")
_oracle("explanation_report", "explained", """
 SELECT 'method' AS section, 'template' AS key, count(*) AS n, NULL::DOUBLE AS value, NULL AS text FROM explained
 UNION ALL SELECT 'label', label, count(*), avg(confidence), NULL FROM explained GROUP BY label
 UNION ALL (SELECT 'top_signal', top_signal_1, count(*) AS n, NULL, NULL FROM explained GROUP BY top_signal_1 ORDER BY n DESC, top_signal_1 LIMIT 5)
 UNION ALL SELECT 'overall', 'all', count(*), round(avg(confidence), 3), NULL FROM explained
 UNION ALL SELECT 'sample', label, 1, importance_score, name || ': ' || explanation_text FROM explained
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY importance_score DESC, file_id) = 1""")
_oracle("inventory_summary", "all_files", f"""
 SELECT count(*) FILTER (category NOT IN ({_quoted(fixed.REVIEW_CATEGORIES)})) AS real_files, 0::BIGINT AS archive_members,
  count(*) FILTER (status = 'DELETE_CANDIDATE') AS delete_candidates,
  count(*) FILTER (category IN ({_quoted(fixed.REVIEW_CATEGORIES)})) AS quarantined,
  round(sum(size_mb) FILTER (category NOT IN ({_quoted(fixed.REVIEW_CATEGORIES)})), 2) AS total_mb FROM all_files""")
_oracle("extraction_summary", "all_content", f"""
 SELECT status, count(s) AS files, round(count(s) * 100.0::DOUBLE / (SELECT count(*) FROM all_content WHERE ({_REASON}) IS NULL), 1) AS percent,
  (SELECT count(*) FROM all_content WHERE ({_REASON}) IS NOT NULL) AS quarantined
 FROM (VALUES ('SUCCESS'), ('PARTIAL'), ('FAILED'), ('SKIPPED')) v(status)
 LEFT JOIN (SELECT extraction_status AS s FROM all_content WHERE ({_REASON}) IS NULL) ON s = status GROUP BY status""")
_oracle("clean_summary", "chunks content", """
 SELECT *, round(cleaned * 100.0::DOUBLE / source_files, 1) AS cleaned_percent, round(failed * 100.0::DOUBLE / source_files, 1) AS failed_percent,
  round(skipped * 100.0::DOUBLE / source_files, 1) AS skipped_percent,
  (SELECT count(*) - count(DISTINCT hash) FROM content WHERE hash NOT LIKE 'error%') AS reused
 FROM (SELECT count(*) FILTER (chunk_index = 0) AS source_files,
  count(*) FILTER (chunk_index = 0 AND clean_status = 'SUCCESS') AS cleaned,
  count(*) FILTER (chunk_index = 0 AND clean_status = 'FAILED') AS failed,
  count(*) FILTER (chunk_index = 0 AND clean_status = 'SKIPPED') AS skipped,
  count(*) FILTER (clean_status = 'SUCCESS') AS total_chunks,
  (sum(clean_word_count) FILTER (clean_status = 'SUCCESS'))::BIGINT AS total_words FROM chunks)""")
_oracle("chunk_languages", "chunks", """
 SELECT language, count(*) AS chunks FROM chunks WHERE clean_status = 'SUCCESS' AND language <> '' GROUP BY language""")
_oracle("duplicates_summary", "duplicate_files sections redundancy", """
 SELECT 'exact_duplicate_pairs' AS output, count(*) AS rows FROM duplicate_files
 UNION ALL SELECT 'near_duplicate_chunk_pairs', count(*) FROM sections
 UNION ALL SELECT 'redundant_file_pairs', count(*) FROM redundancy
 UNION ALL SELECT 'recommendations', (SELECT count(*) FROM duplicate_files) + (SELECT count(*) FROM redundancy)""")
_oracle("disagreement_rate", "usable", """
 SELECT round(avg((predicted_label <> human_label)::INTEGER), 4) AS disagreement_rate FROM usable WHERE predicted_label IS NOT NULL""")
_oracle("class_balance_check", "usable", "SELECT human_label, count(*) AS examples FROM usable GROUP BY human_label HAVING count(*) < 40")
_oracle("retrain_status", "feedback usable", """
 SELECT count(*) FILTER (NOT used_in_train) >= 30 AS should_retrain, count(*) FILTER (NOT used_in_train) AS new_feedback_rows,
  30::BIGINT AS threshold, (SELECT count(*) FROM usable) AS usable_labeled FROM feedback""")
_oracle("top_chunk_excerpt", "chunks", """
 SELECT file_id, md5(string_agg(clean_text, ' ' ORDER BY chunk_index)) AS excerpt_hash FROM chunks
 WHERE clean_status = 'SUCCESS' AND clean_text <> '' AND chunk_index < 3 GROUP BY file_id""")
_oracle("first_chunk_per_file", "chunks", """
 SELECT file_id, md5(substring(clean_text, 1, 1000)) AS preview_hash FROM chunks WHERE clean_status = 'SUCCESS' AND chunk_index = 0""")
_oracle("latest_feedback_per_file", "latest_feedback", """
 SELECT file_id, feedback_id, human_label, reviewer_confidence, created_at FROM latest_feedback""")
_oracle("best_hit_per_file", "scored chunks", f"""
 SELECT s.file_id, s.chunk_id, round(score, 3) AS relevance, {_snip("coalesce(k.clean_text, '')")} AS snippet
 FROM scored s LEFT JOIN chunks k ON k.chunk_id = s.chunk_id
 QUALIFY row_number() OVER (PARTITION BY s.file_id ORDER BY score DESC, s.chunk_id) = 1""")
_TOPCOLS = """file_id, name, ext, importance_score, label, round(s_llm_quality, 6) AS s_llm_quality,
 round(s_cluster_density, 6) AS s_cluster_density, round(s_semantic_proximity, 6) AS s_semantic_proximity"""
_oracle("top_bottom_files", "scores", f"""
 (SELECT {_TOPCOLS}, 'top' AS side FROM scores ORDER BY importance_score DESC, file_id LIMIT 10)
 UNION ALL (SELECT {_TOPCOLS}, 'bottom' FROM scores ORDER BY importance_score, file_id LIMIT 10)""")
_oracle("explorer_page", "scores", """
 SELECT file_id, name, folder, category, size_bytes, label FROM scores WHERE contains(folder, '/en') AND category = 'Document'
 ORDER BY size_bytes DESC, file_id LIMIT 60""")
_oracle("biggest_files", "files", """
 SELECT name, category AS type, round(size_bytes / 1048576.0::DOUBLE, 6) AS size_mb FROM files ORDER BY size_bytes DESC, file_id LIMIT 5""")
_oracle("duplicates_listing", "redundancy", """
 SELECT path_1, path_2, round(avg_similarity, 2) AS avg_similarity, action FROM redundancy ORDER BY redundancy.avg_similarity DESC, path_1, path_2 LIMIT 10""")
_oracle("session_history", "", """
 SELECT session_id, message_id, role, row_number() OVER (PARTITION BY session_id ORDER BY message_id) AS position FROM (
  SELECT conv_id AS session_id, turn AS message_id, role FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)""")
_oracle("latest_promoted_model", "versions", """
 SELECT version, gate_score, (SELECT max(version) + 1 FROM versions) AS next_version FROM versions WHERE promoted
 ORDER BY trained_at DESC, version DESC LIMIT 1""")
_oracle("duplicate_paths", "dup_paths", "SELECT path FROM dup_paths")
_oracle("duplicate_paths_default", "strict_dup_paths", "SELECT path FROM strict_dup_paths")
_oracle("s_uniqueness_default", "score_input strict_dup_paths", """
 SELECT file_id, CASE WHEN path IN (SELECT path FROM strict_dup_paths) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS s_uniqueness
 FROM score_input""")
_oracle("redundancy_of_paths", "strict_redundancy files", """
 SELECT * REPLACE (round(avg_similarity, 6) AS avg_similarity, round(redundancy_ratio, 6) AS redundancy_ratio)
 FROM strict_redundancy WHERE path_1 IN (SELECT path FROM files WHERE file_id % 50 = 0)
  OR path_2 IN (SELECT path FROM files WHERE file_id % 50 = 0)""")
_oracle("recommendations", "duplicate_files redundancy", """
 SELECT 'exact_duplicate' AS rec_type, 'HIGH' AS severity, path_1 AS primary_id, path_2 AS duplicate_id, 'Delete one copy' AS action,
  'Identical files (hash=' || hash[1:12] || '…)' AS details FROM duplicate_files
 UNION ALL SELECT 'near_duplicate_file', CASE WHEN avg_similarity >= 0.40::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END, path_1, path_2, action,
  'Shared chunks: ' || shared_chunks || ', avg sim: ' || printf('%.2f', avg_similarity) || ', overlap: ' || printf('%.0f', redundancy_ratio * 100) || '%'
 FROM redundancy""")
_oracle("fix_encoding", "", f"SELECT doc_id, md5({_encoding(_DIRTY)}) AS text_hash FROM documents")
_oracle("strip_html", "", f"""
 SELECT page_id, length(t)::INTEGER AS chars, md5(t) AS text_hash FROM (SELECT page_id, {_html('html')} AS t FROM pages, {_NAMED})""")
_oracle("clean_html_pages", "", f"SELECT page_id, md5({_clean('html', chr(39) + 'plain_text_read' + chr(39))}) AS text_hash FROM pages, {_NAMED}")
_oracle("strip_html_tags", "", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_hash FROM pages")
_oracle("remove_ocr_noise", "", f"SELECT doc_id, md5({_ocr(_DIRTY)}) AS text_hash FROM documents")
_oracle("normalize_unicode", "", """
 SELECT doc_id, md5(nfc_normalize(replace(text, chr(233), 'e' || chr(769)))) AS text_hash FROM documents""")
_NOISY = "replace(text, chr(10), " + _literal("\n Page 3 of 9\n12\nCONFIDENTIAL\nwww.x.org\nWWW.x\n") + ")"
_oracle("remove_boilerplate", "", f"SELECT doc_id, md5({_boilerplate(_NOISY)}) AS text_hash FROM documents")
_LOOSE = "replace(text, chr(10), " + _literal(" \t\r\n\r\n\n\n  ") + ")"
_oracle("normalize_whitespace", "", f"SELECT doc_id, md5({_whitespace(_LOOSE)}) AS text_hash FROM documents")
_RAWCLEAN = _clean("extracted_text", "extraction_method")
_oracle("clean_text", "raw_content", f"SELECT file_id, md5({_RAWCLEAN}) AS text_hash FROM raw_content, {_NAMED}")
_oracle("reuse_clean_by_hash", "all_content", f"""
 SELECT file_id, md5(CASE WHEN hash LIKE 'error%' THEN clean ELSE first_value(clean) OVER (
  PARTITION BY hash ORDER BY phase1_status <> 'KEEP', id) END) AS text_hash
 FROM (SELECT *, {_RAWCLEAN} AS clean FROM all_content, {_NAMED})""")
_oracle("chunk_sliding", "raw_content", f"""
 SELECT file_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS chunk_index, md5(unnest(parts)) AS text_hash FROM (
  SELECT file_id, CASE WHEN len(ws) <= 500 THEN CASE WHEN len(ws) > 0 THEN [t] ELSE [] END ELSE {_windows('ws')} END AS parts
  FROM (SELECT *, {_words('t')} AS ws FROM (SELECT file_id, {_RAWCLEAN} AS t FROM raw_content, {_NAMED})))""")
_CHUNKS = """SELECT chunk_id, file_id, chunk_index, chunk_total, clean_char_count, clean_word_count, language, clean_status,
 md5(clean_text) AS text_hash FROM chunks"""
_RUN = "CASE WHEN {1} > 0 THEN [{{'f': {0}, 'n': {1}}}] ELSE [] END"
_HELD = "acc.last - acc.first"
_CLOSE = _RUN.format("acc.first", f"({_HELD})")
_SPLIT = ("list_transform(list_filter(range(0, {1}, 450), lambda s: s = 0 OR {1} - s >= 20), "
          "lambda s: {{'f': {0} + s, 'n': CASE WHEN s + 450 < {1} AND {1} - s - 450 < 20 THEN {1} - s ELSE least({1} - s, 500) END}})")
_SHORT = f"(x.c > 500 OR {_HELD} + x.c > 500) AND {_HELD} > 0 AND {_HELD} < 20"
_oracle("chunk_paragraphs", "raw_content", f"""
 SELECT file_id, (generate_subscripts(runs, 1) - 1)::INTEGER AS chunk_index,
  array_to_string(ws[unnest(runs).f + 1:unnest(runs).f + unnest(runs).n], ' ') AS chunk_text
 FROM (SELECT file_id, ws, list_concat(done.runs, {_RUN.format("done.first", "(done.last - done.first)")}) AS runs FROM (
  SELECT file_id, ws, list_reduce(
   list_transform(paras, lambda p: {{'runs': []::STRUCT(f BIGINT, n BIGINT)[], 'first': 0::BIGINT, 'last': 0::BIGINT, 'c': len({_words('p')})::BIGINT}}),
   lambda acc, x: {{
    'runs': CASE WHEN {_SHORT} THEN list_concat(acc.runs, {_SPLIT.format("acc.first", f"({_HELD} + x.c)")})
      WHEN x.c > 500 THEN list_concat(list_concat(acc.runs, {_CLOSE}), {_SPLIT.format("acc.last", "x.c")})
      WHEN {_HELD} + x.c > 500 THEN list_concat(acc.runs, {_CLOSE}) ELSE acc.runs END,
    'first': CASE WHEN x.c > 500 OR {_SHORT} THEN acc.last + x.c - 50 WHEN {_HELD} + x.c > 500 THEN greatest(acc.first, acc.last - 50) ELSE acc.first END,
    'last': acc.last + x.c, 'c': 0::BIGINT}},
   {{'runs': []::STRUCT(f BIGINT, n BIGINT)[], 'first': 0::BIGINT, 'last': 0::BIGINT, 'c': 0::BIGINT}}) AS done
  FROM (SELECT file_id, {_words('t')} AS ws, list_filter(list_transform(string_split(t, chr(10)), lambda p: {_strip('p')}), lambda p: p <> '') AS paras
   FROM (SELECT file_id, {_RAWCLEAN} AS t FROM raw_content, {_NAMED}))
  WHERE len(ws) > 500 AND len(paras) > 1))""")
_oracle("embed_truncate", "chunks", """
 SELECT chunk_id, 256 AS dims, CASE WHEN regexp_matches(clean_text, '[\\p{L}\\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
 FROM chunks WHERE clean_status = 'SUCCESS'""")
_oracle("chunk_documents", "chunks", _CHUNKS)
_oracle("stream_ingest", "chunks", _CHUNKS)
_stage("doc_words", "", r"""
 SELECT doc_id, lang, word, count(*) AS n FROM (
  SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY ALL""")
_stage("word_grams", "doc_words", """
 SELECT word, substr(padded, i::INT, 3) AS gram, count(*) AS n FROM (
  SELECT word, ' ' || word || ' ' AS padded, unnest(range(1, length(word) + 1)) AS i FROM (SELECT DISTINCT word FROM doc_words))
 GROUP BY ALL""")
_stage("gram_counts", "doc_words word_grams", """
 SELECT lang, gram, sum(d.n * g.n) AS n FROM (SELECT lang, word, sum(n) AS n FROM doc_words WHERE lang <> '' GROUP BY ALL) d
 JOIN word_grams g USING (word) GROUP BY ALL""")
_stage("gram_model", "gram_counts", """
 SELECT gram, lang, ln((coalesce(n, 0) + 1)::DOUBLE / sum(coalesce(n, 0) + 1) OVER (PARTITION BY lang)) AS logp
 FROM (SELECT gram FROM gram_counts GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT 20000)
 CROSS JOIN (SELECT DISTINCT lang FROM gram_counts) LEFT JOIN gram_counts USING (gram, lang)""")
_oracle("language_model", "gram_model", "SELECT gram, lang, round(logp, 6) AS logp FROM gram_model")
_oracle("detect_language", "doc_words word_grams gram_model", """
 SELECT doc_id, CASE WHEN length(text) < 50 THEN '' ELSE coalesce(best, '') END AS language FROM documents LEFT JOIN (
  SELECT doc_id, m.lang AS best FROM doc_words d JOIN word_grams g USING (word) JOIN gram_model m USING (gram) GROUP BY doc_id, m.lang
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sum(d.n * g.n * logp) DESC, m.lang) = 1) USING (doc_id)""")
_oracle("detect_language_words", "", f"SELECT doc_id, {_language('text')} AS language FROM documents")


def _long(key: str, array: str, source: str) -> str:
    return (f"SELECT {key}, (generate_subscripts({array}, 1) - 1)::INTEGER AS position, "
            f"round(unnest({array}), 6) AS value FROM {source}")


_oracle("vector_normalize", "vectors", _long("chunk_id", "unit", """(SELECT chunk_id,
 list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS unit FROM vectors)"""))
_oracle("file_embedding_mean", "file_vectors", _long("file_id", "vector", "file_vectors"))
_oracle("attribution_proxy", "ranked", _long("file_id", "attribution", "ranked"))
_oracle("semantic_search", "scored search_meta", """
 SELECT s.chunk_id, s.file_id, round(score, 6) AS score, name, language FROM scored s JOIN search_meta m USING (chunk_id)
 WHERE language = 'en' ORDER BY s.score DESC, s.chunk_id LIMIT 20""")
_oracle("search_files", "scored search_meta explained files", f"""
 SELECT h.file_id, x.path, round(h.score, 3) AS relevance, importance_score, label, {_snip("coalesce(h.clean_text, '')")} AS snippet, explanation_text
 FROM (SELECT s.*, m.clean_text FROM (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 30) s JOIN search_meta m USING (chunk_id)
  QUALIFY row_number() OVER (PARTITION BY s.file_id ORDER BY s.score DESC, s.chunk_id) = 1) h JOIN explained x USING (file_id)""")
_oracle("knn_batch_join", "vectors", """
 SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM (
  SELECT q.chunk_id AS query_id, v.chunk_id, list_cosine_similarity(q.vector, v.vector) AS similarity,
   row_number() OVER (PARTITION BY q.chunk_id ORDER BY round(list_cosine_similarity(q.vector, v.vector), 12) DESC, v.chunk_id) AS rank
  FROM vectors q, vectors v) WHERE rank <= 5""")
_oracle("similar_chunks", "scored", """
 SELECT chunk_id, round(score, 6) AS similarity_score FROM scored WHERE chunk_id <> '0_0' AND score >= 0.15
 ORDER BY scored.score DESC, chunk_id LIMIT 20""")
_oracle("near_duplicate_pairs", "pairs", "SELECT * REPLACE (round(similarity_score, 6) AS similarity_score) FROM pairs")
_oracle("dbscan_cluster", "clusters", "SELECT file_id, cluster, is_core FROM clusters")
_oracle("cluster_density", "files density", """
 SELECT file_id, round(coalesce(s_cluster_density, 0), 6) AS s_cluster_density FROM files LEFT JOIN density USING (file_id)""")
_oracle("keep_centroid", "centroid", """
 SELECT (generate_subscripts(target, 1) - 1)::INTEGER AS position,
  round(unnest(list_transform(target, lambda x: x / sqrt(list_sum(list_transform(target, lambda y: y * y))))), 6) AS value FROM centroid""")
_oracle("semantic_proximity", "signals", "SELECT file_id, round(s_semantic_proximity, 6) AS s_semantic_proximity FROM signals")
for _name in ("s_content_richness", "s_recency", "s_type_importance", "s_uniqueness", "s_extraction_quality", "s_content_depth"):
    _oracle(_name, "signals7", f"SELECT file_id, round({_name}, 6) AS {_name} FROM signals7")
_oracle("s_llm_quality", "signals8", "SELECT file_id, round(s_llm_quality, 6) AS s_llm_quality FROM signals8")
_stage("rating_keys", "score_input dup_paths chunks", f"""
 SELECT i.file_id, md5(substring(coalesce(t, ''), 1, 800)) AS cache_key,
  md5(array_to_string({_words("coalesce(t, '')")}[1:200], ' ')) AS snippet_hash
 FROM score_input i LEFT JOIN (SELECT file_id, string_agg(clean_text, ' ' ORDER BY chunk_index) AS t FROM chunks
  WHERE clean_status = 'SUCCESS' AND clean_text <> '' AND chunk_index < 3 GROUP BY file_id) USING (file_id)
 WHERE extracted_words > 20 AND path NOT IN (SELECT path FROM dup_paths)""")
_oracle("llm_rating_batch", "rating_keys", """
 SELECT cache_key, min(file_id) AS file_id, arg_min(snippet_hash, file_id) AS snippet_hash FROM rating_keys GROUP BY cache_key""")
_oracle("llm_rating_applied", "files rating_keys", """
 SELECT f.file_id, CASE WHEN l.doc_id IS NULL THEN 0.2::DOUBLE
  ELSE (least(greatest(l.quality * 3 + l.toxic * 7, 1), 5) - 1) / 4.0::DOUBLE END AS s_llm_quality
 FROM files f LEFT JOIN rating_keys k USING (file_id)
 LEFT JOIN (SELECT cache_key, min(file_id) AS first FROM rating_keys GROUP BY cache_key) q ON q.cache_key = k.cache_key
 LEFT JOIN labels l ON l.doc_id = q.first""")
_oracle("signals", "signals", "SELECT file_id, " + ", ".join(f"round({s}, 6) AS {s}" for s in fixed.SIGNALS) + " FROM signals")
_oracle("boot_score", "boot", "SELECT file_id, round(boot_score, 6) AS boot_score FROM boot")
_oracle("boot_label", "boot", f"SELECT file_id, {_LABEL} AS boot_label FROM boot")
_oracle("score_with_model", "signals", """
 SELECT file_id, round(least(greatest(p[1] * 10 + p[2] * 35 + p[3] * 65 + p[4] * 90, 0), 100), 2) AS importance_score,
  (['DELETE_CANDIDATE', 'REVIEW', 'ARCHIVE', 'KEEP'])[list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS confidence
 FROM (SELECT file_id, [s_content_richness / t, s_type_importance / t, s_uniqueness / t, s_semantic_proximity / t] AS p FROM (
  SELECT *, s_content_richness + s_type_importance + s_uniqueness + s_semantic_proximity AS t FROM signals))""")
_oracle("top_signals", "ranked", "SELECT file_id, array_to_string(list_transform(top, lambda s: s.signal), ',') AS signals FROM ranked")
_oracle("weak_signals", "ranked", "SELECT file_id, array_to_string(list_transform(weak, lambda s: s.signal), ',') AS signals FROM ranked")
_oracle("template_explanation", "explained", "SELECT file_id, explanation_text, counterfactual_tip FROM explained")
_LINES = """array_to_string(list_transform({0}, lambda s: '  - ' || s.label || ': ' || printf('%.2f', s.value) || ' ({1}: ' || printf('%.3f', s.shap) || ')'), chr(10))"""
_oracle("explanation_prompt", "ranked", f"""
 SELECT file_id, 'File: ' || name || chr(10) || 'Type: ' || ext || chr(10) || 'Score: ' || printf('%.1f', importance_score) || '/100' || chr(10)
  || 'Decision: ' || label || chr(10) || 'Top contributing signals:' || chr(10) || {_LINES.format('top', 'impact')} || chr(10)
  || 'Weakest signals:' || chr(10) || {_LINES.format('weak', 'low impact')} AS prompt FROM ranked""")
_oracle("build_explanations", "ranked", "SELECT file_id, path, name, label, importance_score, "
        + ", ".join(f"top[{i}].signal AS top_signal_{i}, round(top[{i}].value, 6) AS top_signal_{i}_value, "
                    f"round(top[{i}].shap, 6) AS top_signal_{i}_shap" for i in (1, 2, 3))
        + ", confidence, 'template' AS explanation_method, "
        + ", ".join(f"round(attribution[{i + 1}], 6) AS shap_{s}" for i, s in enumerate(fixed.SIGNALS)) + " FROM ranked")
_TITLES = ", ".join("'" + s.replace("_", " ").title() + "'" for s in fixed.SIGNALS)
_oracle("explanation_fallback_view", "explained", f"""
 SELECT file_id, CASE WHEN file_id % 2 = 1 THEN explanation_text ELSE 'This file is labeled ' || label || ' with an importance score of '
   || regexp_replace(importance_score::VARCHAR, '[.]0$', '') || '. The strongest signals are ' || array_to_string(leading_names, ', ') || '.' END AS text,
  CASE WHEN file_id % 2 = 1 THEN counterfactual_tip
   ELSE 'Use this explanation to decide whether the file should be kept, archived, or reviewed.' END AS tip,
  array_to_string(CASE WHEN file_id % 2 = 1 THEN list_transform(top, lambda s: s.signal) ELSE leading_names END, ',') AS top3,
  round(CASE WHEN file_id % 2 = 1 THEN confidence ELSE least(greatest(importance_score / 100, 0.05), 1) END, 6) AS confidence,
  file_id % 2 = 1 AS has_real_confidence
 FROM (SELECT *, list_transform(list_sort(list_transform(range(1, 10), lambda i: {{'v': -attribution[i], 'n': length(([{_quoted(fixed.SIGNALS)}])[i]),
  'k': ([{_quoted(fixed.SIGNALS)}])[i], 't': ([{_TITLES}])[i]}}))[1:3], lambda e: e.t) AS leading_names FROM explained)""")
_oracle("llm_sampling_gate", "ranked", """
 SELECT file_id, label, CASE label WHEN 'KEEP' THEN ('0x' || substring(md5(file_id::VARCHAR), 1, 8))::BIGINT % 100 < 40
  WHEN 'DELETE_CANDIDATE' THEN confidence <= 0.55 ELSE false END AS use_llm FROM ranked""")
_oracle("usable_feedback", "usable", "SELECT file_id, feedback_id, human_label, predicted_label FROM usable")
_oracle("stratified_split", "usable", """
 SELECT file_id, human_label, row_number() OVER (PARTITION BY human_label ORDER BY md5(file_id::VARCHAR), file_id)
  <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY human_label)) AS is_holdout FROM usable""")
_oracle("class_weights", "usable", """
 SELECT human_label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight
 FROM (SELECT human_label, count(*) AS n FROM usable GROUP BY human_label)""")
_oracle("gate_score", "gate", "SELECT round(gate_score, 6) AS gate_score FROM gate")
_oracle("classification_report", "class_stats", """
 SELECT label, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1, tp + fn AS support,
  round((SELECT sum(tp) / sum(tp + fn)::DOUBLE FROM class_stats), 6) AS accuracy FROM class_stats""")
_DECIDED = """SELECT g.gate_score AS c, v.gate_score AS b, g.gate_score >= v.gate_score + 0.01 OR v.gate_score = 0 AS promoted
 FROM gate g, (SELECT gate_score FROM versions WHERE promoted ORDER BY trained_at DESC LIMIT 1) v"""
_oracle("promotion_decision", "gate versions", f"""
 SELECT round(c, 6) AS candidate_gate_score, round(b, 6) AS baseline_gate_score, promoted,
  CASE WHEN promoted THEN 'Candidate gate_score ' || printf('%.4f', c) || ' beat baseline ' || printf('%.4f', b) || ' by >= 0.01.'
  ELSE 'Rejected: candidate ' || printf('%.4f', c) || ' did not beat baseline ' || printf('%.4f', b) || ' by 0.01.' END AS reason
 FROM ({_DECIDED})""")
_oracle("model_version_log", "gate versions", f"""
 SELECT version, promoted, gate_score FROM versions UNION ALL
 SELECT (SELECT max(version) + 1 FROM versions), promoted, round(c, 6) FROM ({_DECIDED})""")
_oracle("rollback_to_version", "versions", "SELECT version, promoted, gate_score, trained_at FROM versions WHERE version = 4 AND promoted")
_oracle("mark_feedback_used", "feedback usable", """
 SELECT feedback_id, used_in_train OR u AS used_in_train,
  CASE WHEN u THEN coalesce(training_attempts, 0) + 1 ELSE training_attempts END AS training_attempts, promoted_in_version
 FROM (SELECT *, feedback_id IN (SELECT feedback_id FROM usable) AS u FROM feedback)""")
_oracle("mark_feedback_promoted", "feedback usable", """
 SELECT feedback_id, used_in_train OR u AS used_in_train, training_attempts, CASE WHEN u THEN 9 END AS promoted_in_version
 FROM (SELECT *, feedback_id IN (SELECT feedback_id FROM usable) AS u FROM feedback)""")
_oracle("retrieval_context", "vectors scores chunks", """
 SELECT v.chunk_id AS query_id, coalesce(context, 'No matching files were found.') AS context FROM vectors v LEFT JOIN (
  SELECT query_id, string_agg('- ' || s.name || ' | label=' || s.label || ' | score=' || s.importance_score::VARCHAR
    || CASE WHEN coalesce(k.clean_text, '') <> '' THEN chr(10) || '  Preview: ' || substring(k.clean_text, 1, 200) ELSE '' END,
    chr(10) ORDER BY relevance DESC, h.file_id) AS context
  FROM (SELECT query_id, file_id, round(max(similarity), 3) AS relevance FROM (
    SELECT q.chunk_id AS query_id, v.file_id, list_cosine_similarity(q.vector, v.vector) AS similarity
    FROM vectors q, vectors v
    QUALIFY row_number() OVER (PARTITION BY q.chunk_id ORDER BY round(list_cosine_similarity(q.vector, v.vector), 12) DESC, v.chunk_id) <= 5)
   GROUP BY ALL) h
  JOIN scores s ON s.file_id = h.file_id
  LEFT JOIN chunks k ON k.file_id = h.file_id AND k.chunk_index = 0 AND k.clean_status = 'SUCCESS'
  GROUP BY query_id) c ON c.query_id = v.chunk_id""")
_oracle("apply_actions", "scores actions", """
 SELECT s.file_id, coalesce(CASE a.action WHEN 'KEEP' THEN 'KEEP' WHEN 'ARCHIVE' THEN 'ARCHIVE' WHEN 'DELETE' THEN 'DELETE_CANDIDATE' END, s.label) AS label
 FROM scores s LEFT JOIN (SELECT file_id, arg_max(action, (ts, event_id)) AS action FROM actions WHERE action <> 'REVIEWED' GROUP BY file_id) a
  USING (file_id)""")
_oracle("stream_feedback_latest", "actions", """
 SELECT file_id, event_id, action, actor, ts FROM actions
 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) = 1""")


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
