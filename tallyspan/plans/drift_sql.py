"""SQL of the change report of problem 2."""

_REPORT = r"""
WITH tree AS (
  SELECT file_id, t.* FROM source_payloads, LATERAL (SELECT key, value, type, parent FROM json_tree(body)) t WHERE json_valid(body)),
recs AS (SELECT file_id, parent, TRY_CAST(TRY_CAST(trim(value->>'$') AS DOUBLE) AS BIGINT) AS record_id FROM tree WHERE key = '_id'),
cells AS (SELECT t.file_id, r.record_id, t.key AS field_id, CASE WHEN t.type <> 'NULL' THEN trim(t.value->>'$', ' ') END AS v FROM tree t JOIN recs r ON r.file_id = t.file_id AND r.parent = t.parent WHERE t.type <> 'ARRAY'),
lists AS (SELECT file_id, prev_file_id, coalesce(body->'$.result.fields', body->'$[0].result.fields') AS l FROM source_payloads),
listed AS (SELECT file_id, f->>'$.id' AS field_id, f->>'$.type' AS t FROM (SELECT file_id, unnest(from_json(l, '["JSON"]')) AS f FROM lists WHERE json_type(l) = 'ARRAY')),
fields AS (
  SELECT file_id, field_id, any_value(t) AS t FROM listed WHERE field_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT DISTINCT file_id, field_id, NULL FROM cells WHERE file_id NOT IN (SELECT file_id FROM lists WHERE json_type(l) = 'ARRAY')),
pairs AS (SELECT a.file_id, a.prev_file_id, coalesce(json_type(a.l) = 'ARRAY' AND json_type(b.l) = 'ARRAY', false) AS both_listed FROM lists a JOIN lists b ON b.file_id = a.prev_file_id),
now AS (SELECT p.*, f.field_id, f.t FROM pairs p JOIN fields f USING (file_id)),
old AS (SELECT p.*, f.field_id, f.t FROM pairs p JOIN fields f ON f.file_id = p.prev_file_id),
fresh AS (SELECT * FROM now ANTI JOIN old USING (file_id, field_id)),
gone AS (SELECT * FROM old ANTI JOIN now USING (file_id, field_id)),
same AS (
  SELECT g.file_id, g.field_id AS old_id, n.field_id AS new_id, g.t AS old_t, n.t AS new_t, n.both_listed, count(*) AS n,
    count(*) FILTER (WHERE coalesce(TRY_CAST(a.v AS DOUBLE) = TRY_CAST(b.v AS DOUBLE), a.v = b.v)) / count(*) AS share
  FROM gone g JOIN fresh n USING (file_id) JOIN cells a ON a.file_id = g.prev_file_id AND a.field_id = g.field_id JOIN cells b ON b.file_id = n.file_id AND b.field_id = n.field_id AND b.record_id = a.record_id
  WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL
  HAVING 10 * count(*) FILTER (WHERE coalesce(TRY_CAST(a.v AS DOUBLE) = TRY_CAST(b.v AS DOUBLE), a.v = b.v)) >= 9 * count(*)),
best AS (SELECT file_id, old_id, new_id, old_t, new_t, both_listed, share, n FROM same QUALIFY row_number() OVER (PARTITION BY file_id, new_id ORDER BY share DESC, n DESC, old_id) = 1),
report AS (
SELECT file_id, field_id, 'added' AS change_kind, NULL::VARCHAR AS old_id, NULL::VARCHAR AS old_type, t AS new_type FROM fresh WHERE (file_id, field_id) NOT IN (SELECT (file_id, new_id) FROM same)
UNION ALL SELECT file_id, field_id, 'removed', field_id, t, NULL FROM gone WHERE (file_id, field_id) NOT IN (SELECT (file_id, old_id) FROM same)
UNION ALL SELECT file_id, new_id, 'renamed', old_id, old_t, new_t FROM best
UNION ALL SELECT file_id, new_id, 'retyped', old_id, old_t, new_t FROM best WHERE both_listed AND lower(trim(coalesce(old_t, ''), ' ')) <> lower(trim(coalesce(new_t, ''), ' '))
UNION ALL SELECT n.file_id, n.field_id, 'retyped', n.field_id, o.t, n.t FROM now n JOIN old o USING (file_id, field_id) WHERE n.both_listed AND lower(trim(coalesce(o.t, ''), ' ')) <> lower(trim(coalesce(n.t, ''), ' ')))"""

P2_FOUND = f"{_REPORT} SELECT file_id, field_id, change_kind FROM report"
P2_REPORT = f"{_REPORT} SELECT * FROM report"
