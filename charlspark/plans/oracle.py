"""The registered queries as DuckDB SQL over the same tables. Written from the definitions, in relational form: no masks,
no side-by-side columns, direct prefix conditions."""

from __future__ import annotations

import json

from charlspark.functions.codes import AGE_FROM, AGE_LABELS
from charlspark.plans.fixtures import BEYOND, CODES, MISSING_BAND
from charlspark.sources.charlson import ROOT, built_in_text

M, N_DRAWS, ALPHA_0, SEED = 20, 25, 10, 42
BANDS = [b for b in AGE_LABELS if b != MISSING_BAND]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows) + ")"


def band(age: str) -> str:
    whens = " ".join(f"WHEN {age} < {below} THEN {quoted(label)}" for below, label in zip([*AGE_FROM], AGE_LABELS))
    return f"CASE WHEN {age} IS NULL OR isnan({age}) THEN NULL {whens} ELSE {quoted(AGE_LABELS[-1])} END"


def number(column: str) -> str:
    return f"CASE WHEN trim({column}) IN ('-', '.', '/', 'NA') THEN NULL ELSE TRY_CAST(replace(replace(trim({column}), '.', ''), ',', '.') AS DOUBLE) END"


def german(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN '-' ELSE replace(format('{{:,}}', {n}), ',', '.') END"


def draws(stage: str, n: int) -> str:
    u = f"('0x' || substr(md5(concat_ws('|', '{SEED}', '{stage}', p.enc_id, p.pref, d.draw)), 1, 13))::BIGINT::DOUBLE / 4503599627370496"
    return f"""
{stage}_cdf AS (
  SELECT *, sum(weight) OVER (PARTITION BY pref ORDER BY code ROWS UNBOUNDED PRECEDING) AS hi, sum(weight) OVER (PARTITION BY pref) AS all_w,
    code = max(code) OVER (PARTITION BY pref) AS last FROM {stage}_w
), {stage}_draws AS (
  SELECT x.enc_id, x.pref, x.draw, c.code FROM (
    SELECT p.enc_id, p.pref, CAST(d.draw AS INTEGER) AS draw, {u} AS u FROM prefs p, range(1, {n + 1}) d(draw)
  ) x JOIN {stage}_cdf c ON c.pref = x.pref AND x.u * all_w >= hi - weight AND (x.u * all_w < hi OR last)
), {stage}_trig AS (
  SELECT DISTINCT d.enc_id, d.draw, g.gk FROM {stage}_draws d JOIN donor_groups g ON d.code = g.code
), {stage}_active AS (
  SELECT t.* FROM {stage}_trig t WHERE NOT EXISTS (
    SELECT 1 FROM deps JOIN {stage}_trig p ON p.gk = deps.parent WHERE deps.child = t.gk AND p.enc_id = t.enc_id AND p.draw = t.draw)
), {stage}_score AS (
  SELECT enc_id, draw, CAST(sum(w) AS INTEGER) AS cci FROM {stage}_active JOIN weights USING (gk) GROUP BY ALL
), {stage}_rate AS (
  SELECT enc_id, gk, count(*) / {float(n)} AS p_counted FROM {stage}_active GROUP BY ALL
)"""


def expected(name: str) -> str:
    """p_active and the expected score from (enc_id, gk, q) in {name}_q."""
    return f"""
{name}_p AS (
  SELECT enc_id, gk, greatest(1 - exp(sum(ln(1 - least(q, 1 - 1e-12)))), 0) AS p_active FROM {name}_q GROUP BY ALL
), {name}_terms AS (
  SELECT c.enc_id, c.gk, c.p_active * w.w * coalesce(product(1 - coalesce(p.p_active, 0)), 1) AS term
  FROM {name}_p c JOIN weights w USING (gk) LEFT JOIN deps ON deps.child = c.gk LEFT JOIN {name}_p p ON p.enc_id = c.enc_id AND p.gk = deps.parent
  GROUP BY c.enc_id, c.gk, c.p_active, w.w
), {name} AS (
  SELECT e.enc_id, coalesce(sum(term), 0) AS e_cci FROM enc e LEFT JOIN {name}_terms USING (enc_id) GROUP BY e.enc_id
)"""


def preamble() -> str:
    groups = json.loads(built_in_text("reduced"))[ROOT]
    map_rows = [(gk, float(g["weight"]), p) for gk, g in groups.items() for block in g["codes"] for p in block["codes"]]
    dep_rows = [(gk, parent) for gk, g in groups.items() for parent in g.get("depends_on", [])]
    pivot = ", ".join(f"sum(13) FILTER (band = {quoted(b)}) AS {quoted_name(b)}" for b in BANDS)
    text = ", ".join(f"{german('CAST(coalesce(' + quoted_name(b) + ', 0) AS BIGINT)')} AS {quoted_name(b)}" for b in BANDS)
    parsed = ", ".join(f"coalesce(sum({number(quoted_name(b))}), 0) AS {quoted_name(b)}" for b in BANDS)
    return f"""WITH RECURSIVE
codes AS (SELECT * FROM {values(list(enumerate(CODES + BEYOND)))} t(i, code)),
dx_raw AS (
  SELECT l_orderkey AS enc_id, l_linenumber AS ord, l_partkey, l_suppkey, i, code AS listed,
    CASE l_suppkey % 7 WHEN 0 THEN lower(code) WHEN 1 THEN replace(code, '.', ',') WHEN 2 THEN concat(' ', code, ' ')
      WHEN 3 THEN replace(code, '.', '') WHEN 4 THEN concat(code, '0') ELSE code END AS raw
  FROM lineitem JOIN codes ON l_partkey % 116 = i
), enc AS (
  SELECT o_orderkey AS enc_id, CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 101 AS DOUBLE) END AS age FROM orders
), wide AS (
  SELECT enc_id, CASE WHEN enc_id % 5 = 0 THEN a ELSE b END AS diagnosen, age FROM enc LEFT JOIN (
    SELECT enc_id, string_agg(raw, '||' ORDER BY ord, l_partkey, l_suppkey, raw) AS a, string_agg(raw, '|' ORDER BY ord, l_partkey, l_suppkey, raw) AS b
    FROM dx_raw GROUP BY enc_id) USING (enc_id)
), dx AS (
  SELECT enc_id, code FROM (SELECT enc_id, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS code FROM dx_raw) WHERE length(code) >= 3
), pats AS (
  SELECT DISTINCT replace(p, '.', '') AS pat, gk, w FROM {values(map_rows)} t(gk, w, p)
), deps AS (SELECT * FROM {values(dep_rows)} t(child, parent)),
weights AS (SELECT DISTINCT gk, w FROM pats),
distinct_codes AS (SELECT DISTINCT code FROM dx),
hits AS (SELECT code, pat, gk FROM distinct_codes JOIN pats ON starts_with(code, pat) OR starts_with(pat, code)),
code_groups AS (SELECT DISTINCT code, gk FROM hits),
trig AS (SELECT DISTINCT enc_id, gk FROM dx JOIN code_groups USING (code)),
active AS (
  SELECT enc_id, gk, w FROM trig t JOIN weights USING (gk) WHERE NOT EXISTS (
    SELECT 1 FROM deps JOIN trig p ON p.gk = deps.parent WHERE deps.child = t.gk AND p.enc_id = t.enc_id)
), gold AS (
  SELECT e.enc_id, CAST(coalesce(sum(w), 0) AS INTEGER) AS cci FROM enc e LEFT JOIN active USING (enc_id) GROUP BY e.enc_id
), freq_rows AS (
  SELECT listed AS code, CASE WHEN l_suppkey % 2 = 0 THEN 'm' ELSE 'w' END AS sex_raw, {band('age')} AS band
  FROM dx_raw JOIN enc USING (enc_id) WHERE i < {len(CODES)}
), freq_counts AS (SELECT code, sex_raw, 13 * count(*) AS total, {pivot} FROM freq_rows GROUP BY ALL),
freq_text AS (SELECT code, sex_raw, {german('total')} AS total, {text} FROM freq_counts),
freq AS (
  SELECT code, replace(code, '.', '') AS code_nodot, substr(code, 1, 3) AS code3, coalesce(sum({number('total')}), 0) AS freq_total, {parsed}
  FROM freq_text WHERE regexp_matches(code, '^[A-Z][0-9]{{2}}\\.') GROUP BY code
), aged AS (
  SELECT code3, code_nodot, age_bin, freq FROM (UNPIVOT freq ON {", ".join(map(quoted_name, BANDS))} INTO NAME age_bin VALUE freq)
), probs AS (
  SELECT code3, code_nodot, freq_total, CASE WHEN t > 0 THEN freq_total / t ELSE 0 END AS prob, n_children FROM (
    SELECT *, sum(freq_total) OVER (PARTITION BY code3) AS t, count(*) OVER (PARTITION BY code3) AS n_children FROM freq)
), probs_aged AS (
  SELECT code3, code_nodot, age_bin, CASE WHEN t > 0 THEN freq / t ELSE 0 END AS prob FROM (
    SELECT *, sum(freq) OVER (PARTITION BY code3, age_bin) AS t FROM aged)
), child_groups AS (SELECT DISTINCT code_nodot AS code, gk FROM freq JOIN pats ON starts_with(code_nodot, pat) OR starts_with(pat, code_nodot)),
status AS (
  SELECT code3, gk, CASE WHEN count(*) = any_value(n_children) THEN 'certain' ELSE 'possible' END AS status
  FROM probs JOIN child_groups ON code = code_nodot GROUP BY code3, gk
), q AS (SELECT code3, gk, sum(prob) AS q FROM probs JOIN child_groups ON code = code_nodot GROUP BY ALL HAVING sum(prob) > 0),
q_aged AS (SELECT code3, age_bin, gk, sum(prob) AS q FROM probs_aged JOIN child_groups ON code = code_nodot GROUP BY ALL HAVING sum(prob) > 0),
prefs AS (SELECT DISTINCT enc_id, substr(code, 1, 3) AS pref FROM dx),
s1_status AS (SELECT enc_id, gk, min(status) AS status FROM prefs JOIN status ON pref = code3 GROUP BY ALL),
s1_sure AS (
  SELECT enc_id, gk FROM s1_status t WHERE status = 'certain' AND NOT EXISTS (
    SELECT 1 FROM deps JOIN s1_status p ON p.gk = deps.parent AND p.status = 'certain' WHERE deps.child = t.gk AND p.enc_id = t.enc_id)
), s1 AS (
  SELECT *, (cci_min + cci_max) / 2 AS cci_mid, cci_max - cci_min AS interval_width FROM (
    SELECT e.enc_id, coalesce(lo, 0) AS cci_min, coalesce(hi, 0) AS cci_max FROM enc e
    LEFT JOIN (SELECT enc_id, CAST(sum(w) AS DOUBLE) AS lo FROM s1_sure JOIN weights USING (gk) GROUP BY ALL) USING (enc_id)
    LEFT JOIN (SELECT enc_id, CAST(sum(w) AS DOUBLE) AS hi FROM s1_status JOIN weights USING (gk) GROUP BY ALL) USING (enc_id))
), s2_q AS (SELECT enc_id, gk, q FROM prefs JOIN q ON pref = code3),{expected('s2')},
s2a_q AS (
  SELECT p.enc_id, q.gk, q.q FROM prefs p JOIN (SELECT enc_id, {band('age')} AS band FROM enc) e USING (enc_id)
  JOIN (SELECT code3, age_bin, gk, q FROM q_aged UNION ALL SELECT code3, '*', gk, q FROM q) q
    ON q.code3 = p.pref AND q.age_bin = CASE WHEN band IS NULL OR band = {quoted(MISSING_BAND)} THEN '*' ELSE band END
),{expected('s2a')},
pool AS (
  SELECT pref, coalesce(code_nodot, pref) AS code, coalesce(freq_total, 1) AS freq, coalesce(total, 1) AS total, code_nodot IS NULL AS bare
  FROM (SELECT DISTINCT pref FROM prefs) LEFT JOIN (
    SELECT code3, code_nodot, freq_total, sum(freq_total) OVER (PARTITION BY code3) AS total FROM probs WHERE prob > 0) ON code3 = pref
), donor_groups AS (SELECT DISTINCT code, gk FROM pool JOIN pats ON starts_with(code, pat) OR starts_with(pat, code)),
s3_w AS (SELECT pref, code, freq AS weight FROM pool),
s4_w AS (SELECT pref, code, CASE WHEN bare THEN 1 ELSE {float(ALPHA_0)} * freq + 0.5::DOUBLE * total END AS weight, CASE WHEN bare THEN 1 ELSE ({float(ALPHA_0)} * freq + 0.5::DOUBLE * total) / total END AS alpha FROM pool),
{draws('s3', M)},{draws('s4', N_DRAWS)},
s3 AS (SELECT e.enc_id, coalesce(sum(cci), 0) / {float(M)} AS s3_mi FROM enc e LEFT JOIN s3_score USING (enc_id) GROUP BY e.enc_id),
s4 AS (
  SELECT e.enc_id, CAST(median(coalesce(cci, 0)) AS DOUBLE) AS s4_bayes FROM (SELECT enc_id, draw FROM enc, range(1, {N_DRAWS + 1}) d(draw)) e
  LEFT JOIN s4_score s ON s.enc_id = e.enc_id AND s.draw = e.draw GROUP BY e.enc_id
), learners AS (
  SELECT enc_id, gold.cci AS cci_gold, cci_min AS s1_min, cci_max AS s1_max, cci_mid AS s1_mid, e_cci AS s2_ecci, s3_mi, s4_bayes
  FROM gold JOIN s1 USING (enc_id) JOIN s2 USING (enc_id) JOIN s3 USING (enc_id) JOIN s4 USING (enc_id)
), gram AS MATERIALIZED (SELECT count(*) AS n, {gram_columns()} FROM learners)
"""


LEARNERS = ["s1_mid", "s2_ecci", "s3_mi", "s4_bayes"]
NAMES = ["S1_mid", "S2_ecci", "S3_mi", "S4_bayes"]


def gram_columns() -> str:
    c = [*LEARNERS, "cci_gold"]
    return ", ".join(f"sum(CAST({a} AS DOUBLE) * {b}) AS {a}__{b}" for i, a in enumerate(c) for b in c[i:])


def descent() -> str:
    """Coordinate descent for the non-negative weights, as a recursion over sweeps."""
    g = lambda a, b: f"{LEARNERS[min(a, b)]}__{LEARNERS[max(a, b)]}"
    inner = "SELECT i, w0, w1, w2, w3, gram.* FROM cd, gram WHERE i < 3000"
    for k in range(4):
        rest = " + ".join(f"{g(k, j)} * w{j}" for j in range(4) if j != k)
        others = ", ".join(f"w{j}" for j in range(4) if j != k)
        columns = ", ".join(f"{LEARNERS[a]}__{LEARNERS[b]}" for a in range(4) for b in range(a, 4)) + ", " + ", ".join(f"{x}__cci_gold" for x in LEARNERS)
        inner = f"SELECT i, greatest(0, ({LEARNERS[k]}__cci_gold - ({rest})) / {g(k, k)}) AS w{k}, {others}, {columns} FROM ({inner})"
    return f""", cd AS (
  SELECT 0 AS i, 0.25::DOUBLE AS w0, 0.25::DOUBLE AS w1, 0.25::DOUBLE AS w2, 0.25::DOUBLE AS w3
  UNION ALL SELECT i + 1, w0, w1, w2, w3 FROM ({inner})
), fit AS (SELECT w0 / s AS w0, w1 / s AS w1, w2 / s AS w2, w3 / s AS w3 FROM (SELECT *, w0 + w1 + w2 + w3 AS s FROM cd WHERE i = 3000))
"""


def quoted_name(s: str) -> str:
    return '"' + s + '"'


def sql() -> dict[str, str]:
    base, fit = preamble(), descent()
    bands = '"15-18" AS f15_18, "40 - 45" AS f40_45'
    meta = "round(w0 * s1_mid + w1 * s2_ecci + w2 * s3_mi + w3 * s4_bayes, 3) AS meta"
    last = {
        "cohort_wide": "SELECT enc_id, diagnosen, age FROM wide",
        "quan_patterns": "SELECT pat, gk, w, count(enc_id) AS n_dx FROM pats LEFT JOIN hits USING (pat, gk) LEFT JOIN dx USING (code) GROUP BY ALL",
        "quan_deps": "SELECT child, parent, count(b.enc_id) AS n_enc FROM deps LEFT JOIN trig a ON a.gk = child LEFT JOIN trig b ON b.gk = parent AND b.enc_id = a.enc_id GROUP BY ALL",
        "quan_weights": "SELECT gk, w, count(enc_id) AS n_enc FROM weights LEFT JOIN trig USING (gk) GROUP BY ALL",
        "freq_from_raw": f"SELECT code, code_nodot, code3, freq_total, {bands} FROM freq",
        "freq_from_text": f"SELECT code, code_nodot, freq_total, \"15-18\" AS f15_18, NULL::VARCHAR AS rejected FROM freq UNION ALL SELECT NULL, NULL, NULL, NULL, concat_ws(';', code, sex_raw, {', '.join(map(quoted_name, BANDS))}) FROM freq_text WHERE sex_raw = 'm'",
        "quan_patterns_file": "SELECT pat, gk, w, count(enc_id) AS n_dx FROM pats LEFT JOIN hits USING (pat, gk) LEFT JOIN dx USING (code) GROUP BY ALL",
        "freq_custom": f"SELECT code, code_nodot, code3, freq_total, {bands} FROM freq",
        "freq_by_age": "SELECT code3, code_nodot, age_bin, freq FROM aged",
        "dx_long": "SELECT enc_id, code FROM dx JOIN enc USING (enc_id)",
        "dx_normalized": "SELECT DISTINCT raw, regexp_replace(regexp_replace(regexp_replace(replace(upper(trim(raw)), ',', '.'), '[^A-Z0-9.]', '', 'g'), '\\.+', '.', 'g'), '\\.$', '') AS code, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS code_nodot FROM dx_raw",
        "dx_anonymized": "SELECT enc_id, string_agg(pref, '|' ORDER BY pref) AS diagnosen FROM prefs GROUP BY enc_id",
        "dx_redotted": "SELECT DISTINCT raw, regexp_replace(upper(trim(raw)), '^([A-Z][0-9]{2})([0-9])$', '\\1.\\2') AS code FROM dx_raw",
        "age_bins": f"SELECT enc_id, age, {band('age')} AS age_bin FROM enc",
        "code_list_match": "SELECT DISTINCT enc_id FROM dx JOIN hits USING (code) WHERE gk IN ('hf', 'kidney')",
        "code_groups": "SELECT code, gk FROM code_groups",
        "gold_triggered": "SELECT enc_id, gk FROM trig",
        "gold_active": "SELECT enc_id, gk, w FROM active",
        "gold_score": "SELECT enc_id, cci FROM gold",
        "subcode_probs": "SELECT code3, code_nodot, freq_total, round(prob, 6) AS prob, n_children FROM probs",
        "subcode_probs_by_age": "SELECT code3, code_nodot, age_bin, round(prob, 6) AS prob FROM probs_aged",
        "child_groups": "SELECT code, gk FROM child_groups",
        "prefix_group_status": "SELECT code3, gk, status FROM status",
        "prefix_group_prob": "SELECT code3, gk, round(q, 6) AS q FROM q",
        "s1_group_status": "SELECT enc_id, gk, status FROM s1_status",
        "s1_interval": "SELECT enc_id, cci_min, cci_max, cci_mid, interval_width FROM s1",
        "s2_group_prob": "SELECT enc_id, gk, round(p_active, 6) AS p_active FROM s2_p",
        "s2_expected": "SELECT enc_id, round(e_cci, 6) AS e_cci FROM s2",
        "s2_expected_by_age": "SELECT enc_id, round(e_cci, 6) AS e_cci FROM s2a",
        "s3_donors": "SELECT pref, code, freq, total FROM pool",
        "s3_draws": "SELECT enc_id, pref, draw, code FROM s3_draws",
        "s3_mi": "SELECT enc_id, s3_mi FROM s3",
        "s3_group_rate": "SELECT enc_id, gk, p_counted FROM s3_rate",
        "s4_params": "SELECT pref, code, weight, round(alpha, 6) AS alpha FROM s4_w",
        "s4_draws": "SELECT enc_id, pref, draw, code FROM s4_draws",
        "s4_median": "SELECT enc_id, s4_bayes FROM s4",
        "s4_group_rate": "SELECT enc_id, gk, p_counted FROM s4_rate",
        "meta_gram": "SELECT n, " + ", ".join(f"round({a}__{b}, 6) AS {a}__{b}" for i, a in enumerate([*LEARNERS, "cci_gold"]) for b in [*LEARNERS, "cci_gold"][i:]) + " FROM gram",
        "meta_cv_risk": " UNION ALL ".join(f"SELECT '{n}' AS learner, round(avg(pow({c} - cci_gold, 2)), 6) AS cv_risk FROM learners" for c, n in zip(LEARNERS, NAMES)),
    }
    fitted = {
        "meta_weights": f"SELECT unnest({NAMES}) AS learner, unnest([round(w0, 4), round(w1, 4), round(w2, 4), round(w3, 4)]) AS weight FROM fit",
        "meta_predictions": f"SELECT enc_id, {meta} FROM learners, fit",
        "cohort_estimates": f"SELECT enc_id, cci_gold, s1_min, s1_max, s1_mid, round(s2_ecci, 6) AS s2_ecci, s3_mi, s4_bayes, {meta} FROM learners, fit",
    }
    return {k: base + v for k, v in last.items()} | {k: base + fit + v for k, v in fitted.items()}
