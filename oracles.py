"""DuckDB SQL for each registered query, written apart from the Spark code."""

from __future__ import annotations

# ---- the notes view --------------------------------------------------------

_C = (
    2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233, 3624381081,
    1103515245, 1664525, 22695477, 134775813, 69069, 1597334677, 747796405,
)


def _r(i: int) -> str:
    return f"(((k + 1) * {_C[i - 1]} % 4294967296) // 65536)"


_NOTES = f"""
keys AS (SELECT o_orderkey AS k FROM orders),
notes AS (
  SELECT concat_ws(chr(10),
    'Hospital note',
    CASE WHEN k % 89 <> 3 THEN 'Patient ID: ' || printf('PAT-%04d', k) END,
    'Age: ' || CASE WHEN {_r(2)} % 10 = 0 OR k % 211 = 11 THEN 'Unknown'
                    ELSE (45 + {_r(1)} % 45)::VARCHAR END,
    'Gender: ' || CASE WHEN {_r(3)} % 2 = 0 THEN 'Male' ELSE 'Female' END,
    'Primary Diagnosis: ' || CASE WHEN {_r(5)} % 20 = 0 OR k % 211 = 11 THEN 'Not documented'
      ELSE (['Type 2 Diabetes Mellitus', 'Congestive Heart Failure', 'COPD exacerbation',
             'Acute Myocardial Infarction', 'Pneumonia', 'Hip Fracture', 'Sepsis',
             'Chronic Kidney Disease Stage 3', 'Hypertensive Crisis',
             'Lumbar Spinal Stenosis'])[1 + {_r(4)} % 10] END,
    CASE WHEN k % 97 <> 5 THEN 'Length of Stay: ' || (1 + {_r(6)} % 14) || ' days' END,
    CASE WHEN k % 101 <> 7 THEN 'Prior Admissions (past 12 months): ' || ({_r(7)} % 6) END,
    'Medications at Discharge: ' ||
      CASE WHEN {_r(10)} % 12 = 0 OR k % 211 = 11 THEN 'See pharmacy notes'
      ELSE (['Paracetamol 500mg, Ibuprofen 400mg',
             'Amoxicillin 250mg, Prednisolone 5mg, Folic acid 5mg',
             'Levothyroxine 50mcg, Tamsulosin 400mcg, Paracetamol 500mg, Folic acid 5mg',
             'Salmeterol inhaler, Prednisolone 5mg, Ibuprofen 400mg, Amoxicillin 250mg, Levothyroxine 50mcg'
            ])[1 + {_r(8)} % 4] END,
    CASE WHEN {_r(11)} % 5 = 0
      THEN 'Patient has history of non-compliance with medications.' END,
    CASE WHEN {_r(12)} % 4 = 0 THEN 'Social support: Patient lives alone.'
      ELSE 'Social support: Family present.' END,
    (['Follow-up appointment scheduled in 7 days with primary care physician.',
      'Patient advised to follow up with cardiologist in 2 weeks.',
      'No follow-up appointment scheduled at time of discharge.',
      'Follow-up in 30 days with specialist.', ''])[1 + {_r(13)} % 5],
    'Signed: ' || (['Dr. Astrid Lindholm', 'Dr. Tomasz Zielinski', 'Dr. Ngozi Bello',
                    'Dr. Ines Duarte'])[1 + {_r(9)} % 4]
  ) AS raw_text,
  printf('patient_%04d.txt', k) AS file_name
  FROM keys
)"""

_EXTRACTED = r"""
found AS (
  SELECT *,
    regexp_extract(raw_text, 'Patient ID:\s*(PAT-\d+)', 1) AS f_id,
    regexp_extract(raw_text, 'Age:\s*(\d+|Unknown)', 1) AS f_age,
    regexp_extract(raw_text, 'Gender:\s*(Male|Female)', 1) AS f_gender,
    trim(regexp_extract(raw_text, 'Primary Diagnosis:\s*(.+)', 1), E' \t\r\n') AS f_dx,
    regexp_extract(raw_text, 'Length of Stay:\s*(\d+)', 1) AS f_stay,
    regexp_extract(raw_text, 'Prior Admissions.*?:\s*(\d+)', 1) AS f_prior,
    trim(regexp_extract(raw_text, 'Medications at Discharge:\s*(.+)', 1), E' \t\r\n') AS f_meds,
    lower(raw_text) AS low
  FROM notes
),
extracted AS (
  SELECT raw_text, file_name,
    nullif(f_id, '') AS patient_id,
    TRY_CAST(f_age AS INTEGER) AS age,
    nullif(f_gender, '') AS gender,
    CASE WHEN lower(f_dx) NOT LIKE '%not documented%' THEN nullif(f_dx, '') END AS diagnosis,
    TRY_CAST(nullif(f_stay, '') AS INTEGER) AS length_of_stay,
    TRY_CAST(nullif(f_prior, '') AS INTEGER) AS prior_admissions,
    CASE WHEN low LIKE '%no follow-up appointment scheduled%' THEN false
         ELSE low LIKE '%follow-up%' END AS has_follow_up,
    low LIKE '%lives alone%' AS lives_alone,
    low LIKE '%non-compliance%' AS non_compliant,
    CASE WHEN lower(f_meds) NOT LIKE '%see pharmacy%' THEN nullif(f_meds, '') END AS medications_raw
  FROM found
)"""

_CURATED = """
weighed AS (
  SELECT *,
    ((CASE WHEN patient_id IS NULL THEN 0 ELSE 10 END)
     + (CASE WHEN age IS NULL THEN 0 ELSE 20 END)
     + (CASE WHEN diagnosis IS NULL THEN 0 ELSE 25 END)
     + (CASE WHEN length_of_stay IS NULL THEN 0 ELSE 15 END)
     + (CASE WHEN prior_admissions IS NULL THEN 0 ELSE 20 END)
     + (CASE WHEN medications_raw IS NULL THEN 0 ELSE 10 END))::DOUBLE AS completeness_score,
    coalesce(nullif(concat_ws(', ',
      CASE WHEN patient_id IS NULL THEN 'Patient ID' END,
      CASE WHEN age IS NULL THEN 'Age' END,
      CASE WHEN diagnosis IS NULL THEN 'Primary Diagnosis' END,
      CASE WHEN length_of_stay IS NULL THEN 'Length of Stay' END,
      CASE WHEN prior_admissions IS NULL THEN 'Prior Admissions' END,
      CASE WHEN medications_raw IS NULL THEN 'Medications' END), ''), 'None') AS missing_fields
  FROM extracted
),
curated AS (
  SELECT *,
    CASE WHEN completeness_score >= 80 THEN 'HIGH'
         WHEN completeness_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_label,
    completeness_score >= 50 AS is_scoreable,
    CASE WHEN completeness_score >= 80 THEN '✅ Record complete. Risk score reliable.'
         WHEN completeness_score >= 50 THEN '⚠️ Some fields missing. Risk score is approximate.'
         ELSE '⚠️ Record incomplete. Risk score unreliable. Manual review required.'
    END AS quality_warning
  FROM weighed
)"""

_SCORED = """
factors AS (
  SELECT *,
    (coalesce(prior_admissions, 0) >= 3)::INT AS r_prior,
    (NOT coalesce(has_follow_up, false))::INT AS r_follow,
    lives_alone::INT AS r_alone,
    non_compliant::INT AS r_comply,
    (coalesce(length_of_stay, 0) > 7)::INT AS r_stay,
    (coalesce(age, 0) > 75)::INT AS r_age,
    regexp_matches(lower(coalesce(diagnosis, '')),
      'congestive heart failure|copd|sepsis|myocardial infarction')::INT AS r_dx,
    coalesce(age >= 60 AND age <= 75, false)::INT AS r_mid_age,
    regexp_matches(lower(coalesce(diagnosis, '')),
      'diabetes|ckd|chronic kidney disease|pneumonia')::INT AS r_mid_dx
  FROM curated
),
totals AS (
  SELECT *,
    3 * r_prior + 3 * r_follow + 2 * r_alone + 2 * r_comply + 2 * r_stay + 2 * r_age + 3 * r_dx
      AS risk_points,
    r_prior + r_follow + r_alone + r_comply + r_stay + r_age + r_dx AS signal_count
  FROM factors
),
scored AS (
  SELECT *,
    risk_points + r_mid_age + r_mid_dx AS guideline_points,
    CASE WHEN risk_points >= 7 THEN 'HIGH' WHEN risk_points >= 3 THEN 'MEDIUM' ELSE 'LOW' END
      AS risk_tier,
    CASE WHEN risk_points + r_mid_age + r_mid_dx >= 7 THEN 'HIGH'
         WHEN risk_points + r_mid_age + r_mid_dx >= 3 THEN 'MEDIUM' ELSE 'LOW' END
      AS guideline_tier,
    CASE WHEN signal_count >= 3 THEN 'HIGH' WHEN signal_count >= 1 THEN 'MEDIUM' ELSE 'LOW' END
      AS signal_tier,
    concat_ws('; ',
      CASE WHEN r_prior = 1 THEN '3+ prior admissions' END,
      CASE WHEN r_follow = 1 THEN 'No follow-up appointment' END,
      CASE WHEN r_alone = 1 THEN 'Lives alone' END,
      CASE WHEN r_comply = 1 THEN 'Medication non-compliance' END,
      CASE WHEN r_stay = 1 THEN 'Length of stay over 7 days' END,
      CASE WHEN r_age = 1 THEN 'Age over 75' END,
      CASE WHEN r_dx = 1 THEN 'High-risk diagnosis' END) AS risk_reasons
  FROM totals
),
actions(risk_tier, action) AS (VALUES
  ('HIGH', 'Contact within 24 hours post-discharge, arrange home visit'),
  ('MEDIUM', 'Phone call within 72 hours, confirm follow-up appointment'),
  ('LOW', 'Standard discharge instructions, confirm follow-up')),
assessed AS (
  SELECT scored.*, action,
    'Risk level: ' || risk_tier
    || chr(10) || 'Risk factors: ' || CASE WHEN risk_reasons = '' THEN 'none' ELSE risk_reasons END
    || chr(10) || 'Data quality: ' || completeness_score::INT || '% complete. ' || quality_warning
    || chr(10) || 'Action: ' || action AS assessment
  FROM scored JOIN actions USING (risk_tier)
)"""

_SERVING = """patient_id, age, gender, diagnosis, length_of_stay, prior_admissions, has_follow_up,
  lives_alone, non_compliant, medications_raw, completeness_score, confidence_label,
  quality_warning"""
_LISTED = f"file_name, {_SERVING}"

_RATES = """
rates(dx_key, rate_pct) AS (VALUES
  ('Congestive Heart Failure', 24), ('COPD', 22), ('Sepsis', 20),
  ('Acute Myocardial Infarction', 18), ('Pneumonia', 17), ('Hip Fracture', 15),
  ('Type 2 Diabetes', 14), ('Chronic Kidney Disease', 16), ('Hypertensive Crisis', 12),
  ('Lumbar Spinal Stenosis', 8))"""


def _from_notes(body: str, *more: str) -> str:
    return "WITH " + ",".join([_NOTES, _EXTRACTED, *more]) + "\n" + body


def _from_curated(body: str) -> str:
    return _from_notes(body, _CURATED)


def _from_scored(body: str, *more: str) -> str:
    return _from_notes(body, _CURATED, _SCORED, *more)


_POSITIONS = """
SELECT DISTINCT m.conv_id, m.turn,
  (SELECT count(*) FROM conversations e WHERE e.conv_id = m.conv_id AND e.turn < m.turn)
    AS messages_before,
  (SELECT count(*) FROM conversations e
    WHERE e.conv_id = m.conv_id AND e.turn < m.turn AND e.role = 'user') AS user_messages_before,
  (SELECT min(e.turn) FROM conversations e
    WHERE e.conv_id = m.conv_id AND e.turn > m.turn AND e.role = 'user') AS next_user_turn
FROM conversations m"""

_KNN = """
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d
  FROM embeddings q, embeddings v
),
ranked AS (
  SELECT query_id, vec_id, d,
    row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank
  FROM pairs
),
knn AS (SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM ranked WHERE rank <= 3)"""


def _embedded(table: str, key: str) -> str:
    return rf"""
WITH words AS (
  SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM {table}
),
counts AS (
  SELECT {key}, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INT AS bucket, count(*) AS n
  FROM words WHERE w <> '' GROUP BY ALL
)
SELECT {key}, bucket,
  round(n / sqrt((sum(n * n) OVER (PARTITION BY {key}))::DOUBLE), 6) AS weight
FROM counts"""


_KEYWORDS = r"""
WITH asked AS (
  SELECT conv_id || ':' || turn AS query_id, text FROM conversations WHERE role = 'user'
),
words AS (
  SELECT query_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS keyword FROM asked
),
tf AS (SELECT query_id, keyword, count(*) AS tf FROM words WHERE keyword <> '' GROUP BY ALL),
df AS (SELECT keyword, count(*) AS df FROM tf GROUP BY keyword),
scores AS (
  SELECT query_id, keyword, round(tf * ln((SELECT count(*) FROM asked) / df), 6) AS score
  FROM tf JOIN df USING (keyword)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyword)::INT AS rank
  FROM scores
)
SELECT query_id, keyword, score, rank FROM ranked WHERE rank <= 5"""


# The splitter, for texts without blank lines: pieces at line ends, long ones at blanks,
# short neighbours packed greedily, up to 50 characters carried forward.
_CHUNKS = r"""
pieces AS (
  -- text cut at line ends; each piece begins with its line end
  SELECT doc_id, n, CASE WHEN n = 0 THEN line ELSE chr(10) || line END AS piece
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), kept AS (
  SELECT doc_id, n, piece, length(piece) >= 500 AS long FROM pieces WHERE piece <> ''
), grouped AS (
  -- long pieces stand alone, short neighbours belong together
  SELECT *, sum(CASE WHEN long THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) * 2
            - CASE WHEN long THEN 1 ELSE 0 END AS part
  FROM kept
), cut AS (
  SELECT doc_id, part, 0 AS sub, n, piece FROM grouped WHERE NOT long
  UNION ALL
  SELECT doc_id, part, 0, i, CASE WHEN i = 0 THEN word ELSE ' ' || word END
  FROM (SELECT doc_id, part, unnest(words) AS word, unnest(range(len(words))) AS i
        FROM (SELECT doc_id, part, string_split(piece, ' ') AS words FROM grouped WHERE long))
  WHERE NOT (i = 0 AND word = '')
), runs AS (
  SELECT doc_id, part, string_agg(piece, '' ORDER BY n) AS run,
         list_prepend(0, list(upto ORDER BY n)) AS bounds
  FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, part ORDER BY n) AS upto FROM cut)
  GROUP BY doc_id, part
), steps AS (
  SELECT doc_id, part, run, bounds, 1 AS first,
         list_max(list_transform(range(1, len(bounds) + 1), lambda i: CASE WHEN bounds[i] <= 500 THEN i END)) AS last
  FROM runs
  UNION ALL
  SELECT doc_id, part, run, bounds, first,
         list_max(list_transform(range(1, len(bounds) + 1), lambda i: CASE WHEN bounds[i] <= bounds[first] + 500 THEN i END))
  FROM (
    SELECT doc_id, part, run, bounds,
      least(last, greatest(
        list_min(list_transform(range(first, len(bounds) + 1), lambda i: CASE WHEN bounds[i] >= bounds[last] - 50 THEN i END)),
        list_min(list_transform(range(first, len(bounds) + 1), lambda i: CASE WHEN bounds[i] >= bounds[last + 1] - 500 THEN i END)))) AS first
    FROM steps WHERE last < len(bounds)
  )
), chunks AS (
  SELECT doc_id, part, first, trim(substr(run, bounds[first]::BIGINT + 1, (bounds[last] - bounds[first])::BIGINT), E' \n') AS chunk
  FROM steps
), numbered AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, first) - 1)::INT AS chunk_ix, chunk
  FROM chunks WHERE chunk <> ''
), chunk_rows AS (
  SELECT doc_id || ':' || chunk_ix AS vec_id, doc_id, chunk_ix, chunk FROM numbered
)"""

_CONTEXTS = r"""
texts AS (
  SELECT 'q' AS kind, conv_id || ':' || turn AS id, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'c', vec_id, chunk FROM chunk_rows
), text_words AS (
  SELECT kind, id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM texts
), buckets AS (
  SELECT kind, id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INT AS bucket, count(*) AS n
  FROM text_words WHERE w <> '' GROUP BY ALL
), word_vectors AS (
  SELECT kind, id, map(list(bucket), list(n::DOUBLE)) AS held, sqrt(sum(n * n)::DOUBLE) AS norm FROM buckets GROUP BY kind, id
), text_vectors AS (
  SELECT t.kind, t.id, t.text,
    list_transform(range(64), lambda b: coalesce(v.held[b::INT] / v.norm, 0.0)) AS vector
  FROM texts t LEFT JOIN word_vectors v USING (kind, id)
), apart AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_distance(q.vector, c.vector) AS d
  FROM text_vectors q, text_vectors c WHERE q.kind = 'q' AND c.kind = 'c' AND coalesce(q.text, '') <> ''
), thirds AS (
  SELECT query_id, list_max(min(d, 3)) AS third FROM apart GROUP BY query_id
), near AS (
  -- squares of the few that may be among three, added up element after element
  SELECT query_id, vec_id, c.text AS chunk, row_number() OVER (PARTITION BY query_id ORDER BY
    list_reduce(list_concat([0.0::DOUBLE], list_transform(list_zip(q.vector, c.vector), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
                lambda total, x: total + x), vec_id) AS rank
  FROM apart JOIN thirds USING (query_id)
  JOIN text_vectors q ON q.kind = 'q' AND q.id = query_id JOIN text_vectors c ON c.kind = 'c' AND c.id = vec_id
  WHERE d <= third * 1.000001
), contexts AS (
  SELECT query_id, string_agg(chunk, chr(10) || chr(10) ORDER BY rank) AS context FROM near WHERE rank <= 3 GROUP BY query_id
), asked AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS query_id, m.text, coalesce(context, '') AS context
  FROM conversations m LEFT JOIN contexts c ON c.query_id = m.conv_id || ':' || m.turn WHERE role = 'user'
)"""

_PROMPTS = r"""
shown AS (
  SELECT to_json(list(s ORDER BY patient_id NULLS LAST))::VARCHAR AS records
  FROM (SELECT SERVING FROM curated WHERE is_scoreable ORDER BY patient_id NULLS LAST LIMIT 20) s
), total AS (
  SELECT count(*) AS n FROM curated WHERE is_scoreable
), placed AS (
  SELECT a.*,
    (SELECT count(*) FROM conversations e WHERE e.conv_id = a.conv_id AND e.turn < a.turn) AS messages_before,
    (SELECT count(*) FROM conversations e WHERE e.conv_id = a.conv_id AND e.turn < a.turn AND e.role = 'user') = 0 AS is_first
  FROM asked a
)
SELECT conv_id, turn, CASE WHEN is_first THEN 'analyze' ELSE 'followup' END AS route, messages_before,
  CASE WHEN is_first THEN 'Patient records, ' ELSE 'Patient records for reference, ' END
    || n || ' in all, first 20 shown:' || chr(10) || records || chr(10) || chr(10)
    || CASE WHEN is_first THEN 'Guideline passages:' ELSE 'Further guideline passages:' END || chr(10) || context
    || chr(10) || chr(10) || CASE WHEN is_first THEN 'Question:' ELSE 'Follow-up question:' END || chr(10) || text
    || chr(10) || chr(10) || CASE WHEN is_first
      THEN 'Answer for the patients at hand, give the points behind each tier and say where a record has gaps.'
      ELSE 'Answer with the earlier turns in mind; give the ids and figures it rests on.' END AS prompt
FROM placed, shown, total"""


def all_sql() -> dict[str, str]:
    curated = """SELECT raw_text, file_name, patient_id, age, gender, diagnosis, length_of_stay,
        prior_admissions, has_follow_up, lives_alone, non_compliant, medications_raw,
        completeness_score, missing_fields, confidence_label, is_scoreable, quality_warning
      FROM curated"""
    serving = f"SELECT {_SERVING} FROM curated WHERE is_scoreable"
    explained = """SELECT file_name, patient_id, risk_tier, risk_points, risk_reasons, assessment
      FROM assessed"""
    high = """SELECT file_name, patient_id, risk_points, completeness_score
      FROM scored WHERE risk_tier = 'HIGH'"""
    return {
        "extract_fields": _from_notes("SELECT * FROM extracted"),
        "quality_scores": _from_curated(curated),
        "stream_curated": _from_curated(curated),
        "quality_counts": _from_curated(
            "SELECT confidence_label, count(*) AS n_records FROM curated GROUP BY 1"
        ),
        "text_file_scan": """
            SELECT replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS raw_text,
              true AS is_text_file FROM documents""",
        "batch_counts": _from_curated(
            """SELECT count(*) AS n_notes, count(patient_id) AS n_with_id,
              count(*) FILTER (confidence_label = 'HIGH') AS n_high,
              count(*) FILTER (confidence_label = 'MEDIUM') AS n_medium,
              count(*) FILTER (confidence_label = 'LOW') AS n_low,
              count(*) FILTER (is_scoreable) AS n_serving FROM curated"""
        ),
        "stream_counts": _from_curated(
            """SELECT count(*) AS n_notes, count(patient_id) AS n_with_id,
              count(*) FILTER (confidence_label = 'HIGH') AS n_high,
              count(*) FILTER (confidence_label = 'MEDIUM') AS n_medium,
              count(*) FILTER (confidence_label = 'LOW') AS n_low,
              count(*) FILTER (is_scoreable) AS n_serving FROM curated"""
        ),
        "changed_files": _from_curated(
            curated.replace("raw_text, file_name,", "raw_text || chr(10) AS raw_text, (regexp_extract(file_name, '([0-9]+)')::BIGINT % 1000000)::VARCHAR AS file_name,")
        ).replace("SELECT o_orderkey AS k FROM orders", "SELECT s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN 1000000 ELSE 0 END AS k FROM supplier"),
        "turn_routing_stream": f"""
            SELECT m.conv_id, m.turn, p.messages_before, p.user_messages_before,
              CASE WHEN m.role = 'user' THEN CASE WHEN p.user_messages_before = 0 THEN 'analyze' ELSE 'followup' END END AS route
            FROM conversations m JOIN ({_POSITIONS}) p USING (conv_id, turn)""",
        "packed_note_scan": _from_notes("SELECT raw_text || chr(10) AS raw_text, regexp_extract(file_name, '([0-9]+)')::BIGINT::VARCHAR AS file_name FROM notes").replace(
            "SELECT o_orderkey AS k FROM orders", "SELECT s_suppkey AS k FROM supplier"
        ),
        "record_counts": _from_curated(
            """SELECT count(*) AS n_notes, count(patient_id) AS n_with_id,
              count(*) FILTER (is_scoreable) AS n_scoreable,
              count(patient_id) - count(DISTINCT patient_id) AS n_repeated_ids FROM curated"""
        ),
        "serving_set": _from_curated(serving),
        "serving_round_trip": _from_curated(serving),
        "risk_points": _from_scored(
            "SELECT file_name, patient_id, risk_points, risk_tier FROM scored"
        ),
        "risk_points_guideline": _from_scored(
            "SELECT file_name, patient_id, guideline_points, guideline_tier FROM scored"
        ),
        "risk_signals": _from_scored(
            "SELECT file_name, patient_id, signal_count, signal_tier FROM scored"
        ),
        "risk_summary": _from_scored(
            """SELECT risk_tier, count(*) AS n_patients FROM scored GROUP BY 1
            UNION ALL SELECT 'TOTAL', count(*) FROM scored"""
        ),
        "risk_crosstab": _from_scored(
            "SELECT risk_tier, signal_tier, count(*) AS n_patients FROM scored GROUP BY 1, 2"
        ),
        "risk_reasons": _from_scored("SELECT file_name, risk_tier, risk_reasons FROM scored"),
        "risk_bands": _from_scored(
            """SELECT file_name,
              CASE WHEN prior_admissions >= 3 THEN 'HIGH' WHEN prior_admissions IN (1, 2)
                THEN 'MEDIUM' WHEN prior_admissions = 0 THEN 'LOW' END AS prior_band,
              CASE WHEN has_follow_up THEN 'LOW' ELSE 'HIGH' END AS follow_up_band,
              CASE WHEN lives_alone THEN 'HIGH' END AS alone_band,
              CASE WHEN non_compliant THEN 'HIGH' END AS compliance_band,
              CASE WHEN length_of_stay > 7 THEN 'HIGH' WHEN length_of_stay BETWEEN 4 AND 7
                THEN 'MEDIUM' WHEN length_of_stay < 3 THEN 'LOW' END AS stay_band,
              CASE WHEN age > 75 THEN 'HIGH' WHEN age BETWEEN 60 AND 75 THEN 'MEDIUM'
                WHEN age < 60 THEN 'LOW' END AS age_band,
              CASE WHEN r_dx = 1 THEN 'HIGH' WHEN r_mid_dx = 1 THEN 'MEDIUM' END AS diagnosis_band
            FROM scored"""
        ),
        "risk_caveat": _from_scored(
            """SELECT file_name, risk_tier, confidence_label,
              CASE confidence_label WHEN 'LOW' THEN 'not definitive' WHEN 'MEDIUM'
                THEN 'approximate' END AS score_caveat FROM scored"""
        ),
        "intervention_plan": _from_scored(
            "SELECT file_name, patient_id, risk_tier, action FROM assessed"
        ),
        "diagnosis_rates": _from_notes(
            """SELECT file_name, diagnosis, dx_key, rate_pct
            FROM curated LEFT JOIN rates ON contains(lower(diagnosis), lower(dx_key))
            QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY rate_pct DESC, dx_key) = 1""",
            _CURATED,
            _RATES,
        ),
        "diagnosis_rates_from_table": _from_notes(
            """SELECT file_name, concat_ws(' ', patient_id, diagnosis) AS named, dx_key, rate_pct::INT AS rate_pct
            FROM curated LEFT JOIN (
              SELECT dx_key, rate_pct FROM rates
              UNION ALL SELECT printf('PAT-%04d', o_orderkey), o_orderkey % 31 FROM orders WHERE o_orderkey % 3 = 0
            ) ON contains(lower(concat_ws(' ', patient_id, diagnosis)), lower(dx_key))
            QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY rate_pct DESC, dx_key) = 1""",
            _CURATED,
            _RATES,
        ),
        "top5_high_risk": _from_scored(
            high + " ORDER BY risk_points DESC, completeness_score DESC, patient_id NULLS LAST,"
            " file_name LIMIT 5"
        ),
        "all_high_risk": _from_scored(high),
        "low_confidence": _from_curated(
            f"SELECT {_LISTED} FROM curated WHERE confidence_label = 'LOW'"
        ),
        "no_follow_up": _from_curated(f"SELECT {_LISTED} FROM curated WHERE NOT has_follow_up"),
        "over75_high_risk": _from_scored(
            f"SELECT {_LISTED}, risk_points FROM scored WHERE age > 75 AND risk_tier = 'HIGH'"
        ),
        "non_compliant": _from_curated(f"SELECT {_LISTED} FROM curated WHERE non_compliant"),
        "quality_issues": _from_curated(
            f"SELECT {_LISTED}, missing_fields FROM curated WHERE confidence_label <> 'HIGH'"
        ),
        "missing_field_records": _from_curated(
            f"SELECT {_LISTED}, missing_fields FROM curated WHERE missing_fields <> 'None'"
        ),
        "chf_no_follow_up": _from_curated(
            f"""SELECT {_LISTED} FROM curated
            WHERE lower(diagnosis) LIKE '%congestive heart failure%' AND NOT has_follow_up"""
        ),
        "patient_explain": _from_scored(explained + " WHERE patient_id = 'PAT-0023'"),
        "patient_assessments": _from_scored(explained),
        "first_records": _from_curated(
            serving + " ORDER BY patient_id NULLS LAST LIMIT 20"
        ),
        "turn_routing": """
            SELECT m.conv_id, m.turn,
              CASE WHEN count(e.turn) = 0 THEN 'analyze' ELSE 'followup' END AS route,
              CASE WHEN count(e.turn) = 0 THEN 'load_data > retrieve > analyze'
                   ELSE 'retrieve > followup' END AS path
            FROM conversations m LEFT JOIN conversations e
              ON e.conv_id = m.conv_id AND e.turn < m.turn AND e.role = 'user'
            WHERE m.role = 'user' GROUP BY m.conv_id, m.turn""",
        "turn_positions": _POSITIONS,
        "turn_history": f"""
            SELECT conv_id, turn, role, text, messages_before + 1 AS position,
              next_user_turn AS visible_from
            FROM conversations JOIN ({_POSITIONS}) USING (conv_id, turn)""",
        "turn_keywords": _KEYWORDS,
        "knn_top3": f"WITH {_KNN} SELECT query_id, vec_id, rank, distance FROM knn",
        "knn_top3_by_pivots": f"WITH {_KNN} SELECT query_id, vec_id, rank, distance FROM knn",
        "turn_history_sparse": """
            WITH m AS (
              SELECT CASE WHEN conv_id % 17 <> 3 THEN conv_id END AS conv_id,
                CASE WHEN turn <> 2 OR conv_id % 13 <> 5 THEN turn * 1000003 END AS turn, role, text
              FROM conversations
            )
            SELECT conv_id, turn, role, text,
              1 + (SELECT count(*) FROM m e WHERE e.conv_id IS NOT DISTINCT FROM m.conv_id
                   AND coalesce(e.turn, -1) < coalesce(m.turn, -1)) AS position,
              (SELECT min(e.turn) FROM m e WHERE e.conv_id IS NOT DISTINCT FROM m.conv_id
               AND coalesce(e.turn, -1) > coalesce(m.turn, -1) AND e.role = 'user') AS visible_from
            FROM m""",
        "turn_history_listed": """
            SELECT m.conv_id, a.turn AS asked_turn, m.turn, m.role, m.text
            FROM conversations m
            JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') a
              ON m.conv_id = a.conv_id AND m.turn < a.turn""",
        "knn_with_bad_vectors": f"""
            WITH {_KNN.replace("FROM embeddings q, embeddings v", "FROM embeddings q, embeddings v WHERE q.vec_id % 50 NOT IN (7, 11, 13, 17) AND v.vec_id % 50 NOT IN (7, 11, 13, 17)")}
            SELECT query_id, vec_id, rank, distance FROM knn""",
        "knn_from_index": f"""
            WITH {_KNN.replace("FROM embeddings q, embeddings v", "FROM embeddings q, embeddings v WHERE v.vec_id % 11 <> 3")}
            SELECT query_id, vec_id, rank, distance FROM knn""",
        "context_assembly": f"""
            WITH {_KNN},
            hits AS (
              SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
              FROM knn JOIN documents ON doc_id = vec_id GROUP BY query_id
            )
            SELECT e.vec_id AS query_id, coalesce(context, '') AS context
            FROM embeddings e LEFT JOIN hits ON query_id = e.vec_id""",
        "chunk_documents": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunk_rows",
        "retrieve_context": f"WITH RECURSIVE {_CHUNKS}, {_CONTEXTS} SELECT query_id, text, context FROM asked",
        "prompt_table": "WITH RECURSIVE "
        + ",".join([_NOTES, _EXTRACTED, _CURATED, _CHUNKS, _CONTEXTS, _PROMPTS.replace("SERVING", _SERVING)]),
        "hashed_embeddings": _embedded("documents", "doc_id"),
        "question_embeddings": _embedded("benchmark", "item_id"),
    }
