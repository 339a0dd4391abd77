"""SQL of the flat tables of problem 1, by recursion over the JSON."""

from __future__ import annotations


def _elements(v: str) -> str:
    """A list, one object, or either as JSON text, as a list of JSON values."""
    text = f"({v}->>'$')"
    inner = f"CASE WHEN json_valid({text}) THEN CASE json_type({text}) WHEN 'ARRAY' THEN from_json({text}::JSON, '[\"JSON\"]') WHEN 'OBJECT' THEN [{text}::JSON] END END"
    return f"coalesce(CASE json_type({v}) WHEN 'ARRAY' THEN from_json({v}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{v}] WHEN 'VARCHAR' THEN {inner} END, [])"


_CLAIMS = f"""
nodes AS (
  SELECT example_id, [i] AS path, c FROM (SELECT example_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (
    SELECT example_id, {_elements("coalesce(record_json->'$.claims', record_json->'$.example.claims')")} AS l FROM qa_examples WHERE json_valid(record_json))) WHERE json_type(c) = 'OBJECT'
  UNION ALL
  SELECT example_id, list_append(path, i), c FROM (SELECT example_id, path, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (
    SELECT example_id, path, {_elements("c->'$.parts'")} AS l FROM nodes)) WHERE json_type(c) = 'OBJECT'),
claims AS (SELECT example_id, path, c, CAST(row_number() OVER (PARTITION BY example_id ORDER BY path) - 1 AS INTEGER) AS claim_no FROM nodes),
ids AS (
  SELECT example_id, claim_no, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (
    SELECT example_id, claim_no, CASE json_type(c->'$.evidence_ids') WHEN 'ARRAY' THEN from_json(c->'$.evidence_ids', '["JSON"]') WHEN 'NULL' THEN [] ELSE [c->'$.evidence_ids'] END AS l FROM claims WHERE (c->'$.evidence_ids') IS NOT NULL)),
named AS (SELECT example_id, claim_no, i, CASE json_type(e) WHEN 'OBJECT' THEN e->>'$.id' WHEN 'NULL' THEN NULL ELSE e->>'$' END AS evidence_id FROM ids),
links AS (SELECT example_id, claim_no, CAST(row_number() OVER (PARTITION BY example_id, claim_no ORDER BY i) - 1 AS INTEGER) AS evidence_no, evidence_id FROM named WHERE evidence_id IS NOT NULL)"""

P1_FOUND = rf"""WITH RECURSIVE {_CLAIMS},
known AS (
  SELECT DISTINCT lower(trim(source_id, ' ')) AS s, TRY_CAST(regexp_extract(t.atom, '^\s*\+?([0-9]+)(?:\.0*)?\s*$', 1) AS BIGINT) AS n
  FROM source_payloads, LATERAL (SELECT value->>'$' AS atom FROM json_tree(body) WHERE key = '_id') t WHERE json_valid(body)),
form AS (
  SELECT *, regexp_extract(lower(evidence_id), '(?s)^\s*([^:]*[^:\s])\s*:r([0-9]+)\s*(:.*)?$', 1) AS s, TRY_CAST(regexp_extract(lower(evidence_id), '(?s)^\s*([^:]*[^:\s])\s*:r([0-9]+)\s*(:.*)?$', 2) AS BIGINT) AS n FROM links)
SELECT example_id, claim_no, evidence_no, coalesce(known.n, -1) AS record_id FROM form LEFT JOIN known ON known.s = form.s AND known.n = form.n"""

P1_CLAIMS = f"""WITH RECURSIVE {_CLAIMS},
counts AS (SELECT example_id, claim_no, count(*) AS n FROM links GROUP BY ALL)
SELECT c.example_id, c.claim_no, p.claim_no AS parent_claim_no, len(c.path) - 1 AS depth, c.c->>'$.claim' AS claim, c.c->>'$.supported' AS supported, CAST(coalesce(n, 0) AS INTEGER) AS n_evidence
FROM claims c LEFT JOIN claims p ON p.example_id = c.example_id AND p.path = c.path[:-2] LEFT JOIN counts k ON k.example_id = c.example_id AND k.claim_no = c.claim_no"""

CLAIM_LABELS = f"""WITH RECURSIVE {_CLAIMS}, g AS (SELECT example_id, coalesce(lower(c->>'$.supported') = 'true', false) AS good FROM claims)
SELECT example_id, count(*) AS n_claims, CASE WHEN bool_and(good) THEN 'ANSWERABLE' WHEN bool_or(good) THEN 'PARTIALLY_ANSWERABLE' ELSE 'INSUFFICIENT_EVIDENCE' END AS label FROM g GROUP BY example_id"""
