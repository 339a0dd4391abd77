"""SQL of the queries that SQL can express: by the statements' rules alone."""

from __future__ import annotations

from tallyspan.llm.overlap import GROUPS, SEXES
from tallyspan.llm.reading import FUNCTION_WORDS

_WIDE = "".join(chr(0xFEE0 + c) for c in (*range(48, 58), *range(65, 91), *range(97, 123)))
_NARROW = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123)))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _plain(text: str) -> str:
    bare = rf"regexp_replace(translate({text}, '{_WIDE}', '{_NARROW}'), '[\p{{Cf}}\p{{Mn}}]', '', 'g')"
    return rf"trim(regexp_replace(replace(lower(strip_accents({bare})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"


_PATH = r"regexp_replace(replace(lower(trim({0}, ' ')), '\', '/'), '^\./', '')"
_CASE = lambda names: "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"

_P4 = rf"""
WITH roles AS (
  SELECT DISTINCT {_PATH.format("benchmark_file")} AS file, 'e' AS role FROM freeze_manifests WHERE lower(trim(freeze_status, ' ')) = 'frozen' AND benchmark_file IS NOT NULL
  UNION SELECT DISTINCT {_PATH.format("development_benchmark")}, 't' FROM freeze_manifests WHERE development_benchmark IS NOT NULL),
places AS (
  SELECT DISTINCT regexp_replace({_plain("name")}, ' total$', '') AS p FROM (SELECT number_label AS name FROM census_rows UNION SELECT planning_area FROM census_rows UNION SELECT planning_region FROM region_rows) WHERE name IS NOT NULL),
q AS (
  SELECT example_id, file, role, {_plain("question")} AS w FROM qa_examples JOIN roles ON file = {_PATH.format("benchmark_file")} WHERE question IS NOT NULL),
named AS (SELECT q.w, list(DISTINCT p) AS l FROM (SELECT DISTINCT w FROM q) q JOIN places ON contains(' ' || q.w || ' ', ' ' || p || ' ') AND p NOT IN ('', 'total') GROUP BY q.w),
facts AS (
  SELECT DISTINCT q.w, list_sort(list_filter(coalesce(l, []), lambda a: NOT list_any_value([b FOR b IN l IF b <> a AND contains(' ' || b || ' ', ' ' || a || ' ')]) IS NOT NULL)) AS place,
    list_sort(list_distinct(regexp_extract_all(' ' || replace(q.w, ' ', '  ') || ' ', ' ((?:19|20)[0-9][0-9]) ', 1))) AS years,
    list_sort(list_distinct(regexp_extract_all(q.w, '\b(?:aged?|ages) [0-9]{{1,3}}(?: to| and)?(?: [0-9]{{1,3}}\b| over| older| up)?', 0))) AS ages,
    list_sort(list_distinct(list_filter([{_CASE(SEXES)} FOR x IN string_split(q.w, ' ')], lambda s: s IS NOT NULL))) AS sexes,
    list_sort(list_distinct(list_filter([{_CASE(GROUPS)} FOR x IN string_split(q.w, ' ')], lambda s: s IS NOT NULL))) AS groups
  FROM q LEFT JOIN named ON named.w = q.w),
f AS (SELECT example_id, file, role, q.w, string_split(q.w, ' ') AS words, facts.* EXCLUDE (w) FROM q JOIN facts ON facts.w = q.w),
c AS (
  SELECT a.example_id AS i, b.example_id AS j, a.file AS fi, b.file AS fj, a.words AS x, b.words AS y, len(list_filter(a.words, lambda t: list_contains(b.words, t))) AS xy, len(list_filter(b.words, lambda t: list_contains(a.words, t))) AS yx
  FROM f a JOIN f b ON a.role = 'e' AND b.role = 't' AND a.example_id <> b.example_id AND a.place = b.place AND a.years = b.years AND a.ages = b.ages AND a.sexes = b.sexes AND a.groups = b.groups),
pairs AS (SELECT * FROM c WHERE (len(x) <= len(y) AND 4 * xy >= 3 * len(x)) OR (len(y) <= len(x) AND 4 * yx >= 3 * len(y)))"""
P4_FOUND = f"{_P4} SELECT DISTINCT least(i, j) AS example_a, greatest(i, j) AS example_b FROM pairs"
P4_REPORT = f"""{_P4}, purposes AS (SELECT DISTINCT {_PATH.format("benchmark_file")} AS file, purpose FROM freeze_manifests WHERE lower(trim(freeze_status, ' ')) = 'frozen' AND benchmark_file IS NOT NULL)
SELECT fi AS evaluation_file, purpose, fj AS training_file, count(*) AS n_pairs, count(DISTINCT i) AS n_evaluation, count(DISTINCT j) AS n_training FROM pairs JOIN purposes ON purposes.file = fi GROUP BY ALL"""

_COUNT = lambda name: f"len(list_filter(string_split({_plain('body')}, ' '), lambda t: list_contains({_list(FUNCTION_WORDS[name])}, t)))"

P8_FOUND = rf"""
WITH lines AS (
  SELECT doc_id, regexp_extract(lower(trim(lang, ' ')), '^([a-z]{{2}})(?:[-_].*)?$', 1) AS label, array_to_string(list_filter(string_split(regexp_replace(text, '<[A-Za-z/!?][^<>]*>', ' ', 'g'), chr(10)),
    lambda l: NOT contains(l, '|') AND NOT regexp_matches(l, '^[ \t]*(#|[-*+•‣·–—][ \t]|\(?[0-9]{{1,3}}[.)][ \t])')), chr(10)) AS body FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, label, body, list_filter(regexp_split_to_array(regexp_replace(body, '\p{{Cf}}', '', 'g'), '[\s\p{{Zs}}]+'), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]')) AS words,
    list_filter(string_split(regexp_replace(body || ' ', '[.!?]([\s\p{{Zs}}"''`()\[\]{{}}<>“”‘’«»])', chr(1) || '\1', 'g'), chr(1)), lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]')) AS sentences FROM lines),
counted AS (
  SELECT doc_id, label, len(words) AS n_words, len(sentences) AS n_sentences, list_sum([length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) FOR t IN words]) AS n_letters, len(list_filter(words, lambda t: regexp_matches(t, '\p{{L}}'))) AS n_lettered,
    {_COUNT("en")} AS en, {_COUNT("de")} AS de, {_COUNT("fr")} AS fr FROM parts)
SELECT doc_id FROM counted WHERE en > 0 AND CASE WHEN label = 'de' AND 5 * de >= en + de + fr OR label = 'fr' AND 5 * fr >= en + de + fr THEN false ELSE en >= de AND en >= fr END AND n_words > 22 * n_sentences AND 10 * n_letters > 58 * n_lettered"""

ORACLES = {"p4_found": P4_FOUND, "p4_report": P4_REPORT, "p8_found": P8_FOUND}
