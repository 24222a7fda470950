"""DuckDB SQL for every query: written from the definitions, on exploded rows rather than arrays."""

from __future__ import annotations

PX = "px AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE + 1 AS v FROM embeddings)"
#: Each sample and the two that follow it, around the end: i counts components.
RGB = PX + ", rgb AS (SELECT a.vec_id, a.i * 3 + k AS i, b.v FROM px a, range(3) r(k), px b WHERE b.vec_id = a.vec_id AND b.i = (a.i + k) % 64)"
BLUR = (
    PX
    + """, p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, v FROM px),
taps AS (SELECT s, t, exp(-0.5 * (t / s) * (t / s)) AS raw FROM (VALUES (1.0::DOUBLE, 3), (2.5::DOUBLE, 7)) k(s, r), unnest(range(-r, r + 1)) u(t)),
k AS (SELECT s, t, raw / sum(raw) OVER (PARTITION BY s) AS w FROM taps),
dn AS (SELECT a.vec_id, s, a.x, a.y, sum(b.v * w) AS v FROM p a JOIN k ON true JOIN p b ON b.vec_id = a.vec_id AND b.x = a.x AND b.y = a.y + t GROUP BY ALL),
bl AS (SELECT a.vec_id, a.s, a.x, a.y, sum(b.v * w) AS v FROM dn a JOIN k ON k.s = a.s JOIN dn b ON b.vec_id = a.vec_id AND b.s = a.s AND b.y = a.y AND b.x = a.x + t GROUP BY ALL),
f AS (SELECT p.*, f.v AS fine, c.v AS coarse FROM p JOIN bl f ON f.vec_id = p.vec_id AND f.x = p.x AND f.y = p.y AND f.s = 1 JOIN bl c ON c.vec_id = p.vec_id AND c.x = p.x AND c.y = p.y AND c.s = 2.5)"""
)
PATTERN = "CASE vec_id % 4 WHEN 0 THEN 'RGGB' WHEN 1 THEN 'BGGR' WHEN 2 THEN 'GBRG' ELSE 'GRBG' END"
PROFILES = (
    PX
    + """, pr AS (SELECT vec_id, 'x' AS axis, i % 8 AS j, avg(v) AS m FROM px GROUP BY ALL UNION ALL SELECT vec_id, 'y', i // 8, avg(v) FROM px GROUP BY ALL)"""
)
LAGS = (
    PROFILES
    + """, sc0 AS (SELECT r.vec_id, r.axis, lag, r.m AS a, b.m AS b FROM pr r JOIN (SELECT unnest(range(-3, 4)) AS lag) l ON true JOIN pr b ON b.vec_id = r.vec_id + 1 AND b.axis = r.axis AND b.j = r.j - lag),
sc1 AS (SELECT *, avg(a) OVER w AS ma, avg(b) OVER w AS mb FROM sc0 WINDOW w AS (PARTITION BY vec_id, axis, lag)),
sc AS (SELECT vec_id, axis, lag, round(CASE WHEN count(*) >= 5 AND sum((a - ma) * (a - ma)) > 1e-8 AND sum((b - mb) * (b - mb)) > 1e-8
  THEN sum((a - ma) * (b - mb)) / sqrt(sum((a - ma) * (a - ma)) * sum((b - mb) * (b - mb))) END, 9) AS score FROM sc1 GROUP BY ALL)"""
)
SIZED = "sized AS (SELECT c_custkey::BIGINT AS id, (c_custkey * 37 % 7000 + 16)::INT AS width, (c_custkey * 53 % 5000 + 16)::INT AS height FROM customer)"
ZONES = (
    SIZED
    + """, q AS (SELECT *, least(greatest((width * 13 + 50) // 100, 1), width) AS pw, least(greatest((height * 13 + 50) // 100, 1), height) AS ph,
  least(greatest((width * 45 + 500) // 1000, 1), width) AS ix, least(greatest((height * 45 + 500) // 1000, 1), height) AS iy FROM sized),
z AS (SELECT id, width, height, zone, CASE zone WHEN 'centre' THEN (width - pw) // 2 WHEN 'top_right' THEN greatest(width - ix - pw, 0) WHEN 'bottom_right' THEN greatest(width - ix - pw, 0) ELSE ix END::INT AS x,
  CASE zone WHEN 'centre' THEN (height - ph) // 2 WHEN 'bottom_left' THEN greatest(height - iy - ph, 0) WHEN 'bottom_right' THEN greatest(height - iy - ph, 0) ELSE iy END::INT AS y, pw::INT AS w, ph::INT AS h
  FROM q, (VALUES ('centre'), ('top_left'), ('top_right'), ('bottom_left'), ('bottom_right')) n(zone))"""
)
FRAMES = """fr AS (
SELECT l_suppkey::BIGINT AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS input_index,
  l_orderkey AS o, l_partkey AS p, l_linenumber AS n,
  CASE WHEN l_suppkey % 13 = 5 AND l_linenumber = 3 THEN NULL WHEN l_suppkey % 13 = 7 AND l_partkey % 2 = 0 THEN 'lens alt' ELSE 'lens ' || l_suppkey END AS lens_model,
  (24 + l_suppkey % 5)::DOUBLE AS focal_length_mm,
  CASE WHEN l_suppkey % 17 = 3 AND l_linenumber = 7 THEN NULL ELSE ([2.8, 4, 5.6, 8, 11, 16, 22]::DOUBLE[])[least(l_linenumber, 7)] END AS f_number,
  (l_suppkey % 3 <> 2 OR l_returnflag <> 'R') AS ok,
  CASE l_suppkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN 0.12e0 ELSE CASE WHEN l_linenumber = 7 THEN -0.1e0 ELSE 0.35e0 END END AS base,
  ((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 101 - 50) / 1000e0 AS dt, ((l_orderkey * 13 + l_partkey * 29 + l_linenumber * 5) % 101 - 50) / 1000e0 AS db,
  2e0 - (CASE WHEN l_suppkey % 10 IN (3, 7) THEN 0.01e0 ELSE 0.15e0 END) * abs(l_linenumber - (CASE WHEN l_suppkey % 8 >= 4 THEN 3 ELSE 5 END)) AS ac_centre,
  1.6e0 - 0.12e0 * abs(l_linenumber - 5) AS ac_corner,
  NOT (l_suppkey % 5 = 4 AND l_partkey % 97 = 0) AS textured,
  1e0 + (l_orderkey % 7) * (CASE WHEN l_suppkey % 9 = 8 THEN 0.1e0 ELSE 0.005e0 END) AS lum,
  -0.1e0 * (8 - l_linenumber) + ((l_partkey * 7 + l_orderkey) % 11 - 5) / 200e0 - (CASE WHEN l_suppkey % 6 = 5 AND l_partkey % 50 = 0 THEN 0.3e0 ELSE 0e0 END) AS fall,
  CASE WHEN l_suppkey % 6 = 1 THEN -0.25e0 ELSE 0e0 END AS bias,
  CASE WHEN l_suppkey % 7 = 6 AND l_partkey % 3 = 0 THEN 'gated' WHEN l_partkey % 41 = 0 THEN 'blocked' ELSE 'passed' END AS tq,
  (l_partkey % 10) / 10e0 + (CASE WHEN l_suppkey % 7 = 6 AND l_partkey % 3 = 0 THEN 2e0 ELSE 0e0 END) AS ks
FROM lineitem),
fz AS (SELECT *, base + dt AS d_top, base + db AS d_bot FROM fr)"""
#: Blocker lists: conditions in order, joined by commas.
LIST = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def names(*pairs: tuple[str, str]) -> str:
    return LIST.format(", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs))


def counts(*pairs: tuple[str, str]) -> str:
    return LIST.format(", ".join(f"CASE WHEN {c} > 0 THEN '{n}:' || {c} END" for c, n in pairs))


def dedupe(expr: str) -> str:
    return f"(SELECT coalesce(string_agg(e, ',' ORDER BY pos), '') FROM (SELECT e, min(pos) AS pos FROM (SELECT unnest(string_split({expr}, ',')) AS e, unnest(range(len(string_split({expr}, ',')))) AS pos) WHERE e <> '' GROUP BY e))"


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0 AS {c.split('.')[-1]}" for c in columns)


KEYS = "run_id, lens_model, focal_length_mm, f_number"
GROUPS = (
    FRAMES
    + f""", g AS (SELECT {KEYS}, min(input_index) AS group_ord, count(*) AS frames, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_unknown,
  count(*) FILTER (ok AND textured) AS top_n, count(*) FILTER (ok AND NOT textured) AS top_low, avg(d_top) FILTER (ok AND textured) AS top_mean, stddev_samp(d_top) FILTER (ok AND textured) AS top_scatter,
  count(*) FILTER (ok) AS bottom_n, 0 AS bottom_low, avg(d_bot) FILTER (ok) AS bottom_mean, stddev_samp(d_bot) FILTER (ok) AS bottom_scatter,
  avg(ac_centre) FILTER (ok AND textured) AS fc_centre, avg(ac_corner) FILTER (ok AND textured) AS fc_corner,
  min(lum) FILTER (ok) AS lum_min, max(lum) FILTER (ok) AS lum_max, avg(fall) FILTER (ok) AS fall, max(fall) FILTER (ok) - min(fall) FILTER (ok) AS rng, max(bias) AS bias,
  count(*) FILTER (tq IN ('passed', 'gated')) AS t_assessed, count(*) FILTER (tq = 'blocked' OR NOT ok) AS t_blocked,
  max(ks) FILTER (ok AND tq = 'gated') AS t_gated, max(ks) FILTER (ok AND tq = 'passed') AS t_passed,
  min(input_index) FILTER (NOT ok) AS at_unknown, min(input_index) FILTER (ok AND tq = 'gated') AS at_gate,
  min((input_index, CASE p % 3 WHEN 0 THEN 2 ELSE 3 END)) FILTER (tq = 'blocked' AND p % 3 <> 1) AS at_contrast, min(input_index) FILTER (tq = 'blocked' AND p % 3 = 1) AS at_ref, min(input_index) FILTER (tq = 'blocked' AND p % 3 = 0) AS at_weak, min(input_index) FILTER (tq = 'blocked' AND p % 3 = 2) AS at_line
FROM fz GROUP BY {KEYS})"""
)
TARGETS = (
    GROUPS
    + """, tb AS (SELECT run_id, group_ord, string_agg(name, ',' ORDER BY seen, k) AS t_blockers FROM (
  SELECT run_id, group_ord, at_unknown AS seen, 0 AS k, 'unknown_corrections' AS name FROM g UNION ALL SELECT run_id, group_ord, at_gate, 1, 'keystone_above_threshold' FROM g
  UNION ALL SELECT run_id, group_ord, at_contrast[1], at_contrast[2], 'low_contrast' FROM g UNION ALL SELECT run_id, group_ord, at_ref, 2, 'no_suitable_target_reference' FROM g
  UNION ALL SELECT run_id, group_ord, at_weak, 3, 'weak_target_geometry' FROM g UNION ALL SELECT run_id, group_ord, at_line, 2, 'line_discontinuous' FROM g) WHERE seen IS NOT NULL GROUP BY ALL),
t AS (SELECT g.*, coalesce(t_blockers, '') AS t_blockers, CASE WHEN t_gated IS NOT NULL THEN 'gated' WHEN t_passed IS NOT NULL THEN 'passed' WHEN t_blocked > 0 THEN 'blocked' ELSE 'not_assessed' END AS t_status FROM g LEFT JOIN tb USING (run_id, group_ord))"""
)
# The corners of a frame move together here, so the search is over boxes of falloff and luminance: each box
# begins at some repeat's values; the largest wins, then the least scatter, then the lowest mask (bits from the top, as sets are equally large).
STABLE = (
    GROUPS
    + f""", un AS (SELECT {KEYS}, group_ord FROM g WHERE n_ok >= 3 AND (round(rng, 9) > 0.10 OR round(log2(lum_max / lum_min), 9) > 0.25)),
sa AS (SELECT un.run_id, group_ord, fall, lum, row_number() OVER (PARTITION BY un.run_id, group_ord ORDER BY input_index) - 1 AS bit FROM fz JOIN un ON fz.run_id = un.run_id AND fz.lens_model IS NOT DISTINCT FROM un.lens_model
  AND fz.focal_length_mm IS NOT DISTINCT FROM un.focal_length_mm AND fz.f_number IS NOT DISTINCT FROM un.f_number WHERE ok),
bx AS (SELECT a.run_id, a.group_ord, a.fall AS lo, b.lum AS ll, max(c.fall) - min(c.fall) AS sc, count(*) AS n, avg(c.fall) AS m
  FROM (SELECT DISTINCT run_id, group_ord, fall FROM sa) a JOIN (SELECT DISTINCT run_id, group_ord, lum FROM sa) b USING (run_id, group_ord)
  JOIN sa c ON c.run_id = a.run_id AND c.group_ord = a.group_ord AND c.fall >= a.fall AND round(c.fall - a.fall, 9) <= 0.10 AND c.lum >= b.lum AND round(log2(c.lum / b.lum), 9) <= 0.25 GROUP BY ALL HAVING count(*) >= 2),
bt AS (SELECT * FROM bx QUALIFY rank() OVER (PARTITION BY run_id, group_ord ORDER BY n DESC, round(sc, 9)) = 1),
bm AS (SELECT bt.*, list(c.bit ORDER BY c.bit DESC) AS mask FROM bt JOIN sa c ON c.run_id = bt.run_id AND c.group_ord = bt.group_ord AND c.fall >= lo AND round(c.fall - lo, 9) <= 0.10 AND c.lum >= ll AND round(log2(c.lum / ll), 9) <= 0.25 GROUP BY ALL),
be AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY run_id, group_ord ORDER BY mask) = 1),
v AS (SELECT g.*, coalesce(be.n, n_ok) AS v_n, coalesce(be.sc, CASE WHEN n_ok >= 2 THEN rng END, 0) AS v_scatter, n_ok - coalesce(be.n, n_ok) AS v_out, coalesce(m, fall) AS raw_tl, coalesce(m, fall) + bias AS raw_tr, coalesce(m, fall) AS raw_bl, coalesce(m, fall) AS raw_br
  FROM g LEFT JOIN be USING (run_id, group_ord))"""
)
MEMBERS = (
    STABLE
    + f""", fi AS (SELECT run_id, arg_min(lens_model, group_ord) AS l1, arg_min(focal_length_mm, group_ord) AS f1 FROM v WHERE lens_model IS NOT NULL GROUP BY run_id),
m AS (SELECT v.*, coalesce(lens_model, l1, 'submitted_series') AS s_lens, coalesce(focal_length_mm, f1, 0) AS s_focal, f_number IS NOT NULL AND v_n > 0 AS member,
  {names(("v_n = 0", "insufficient_aperture_series"), ("n_unknown > 0", "unknown_corrections"), ("true", "symmetry_not_assessed"), ("f_number IS NULL", "missing_aperture"))} AS m_blockers,
  {names(("v_out > 0", "unstable_repeat_outlier_excluded"), ("lens_model IS NULL", "missing_lens_focal_identity"))} AS m_warnings FROM v LEFT JOIN fi USING (run_id)),
pa AS (SELECT run_id, count(*) AS partitions, min(n) AS smallest FROM (SELECT run_id, s_lens, s_focal, count(*) AS n FROM m WHERE member GROUP BY ALL) GROUP BY run_id),
st AS (SELECT *, round((raw_tl + raw_tr + raw_bl + raw_br) / 4 + 0.12, 9) < round(lag((raw_tl + raw_tr + raw_bl + raw_br) / 4) OVER (PARTITION BY run_id ORDER BY f_number, group_ord), 9) AS falls FROM m WHERE member),
ss AS (SELECT run_id, max(v_scatter) FILTER (v_n >= 2) AS scatter, bool_or(v_n >= 2 AND v_out = 0 AND round(v_scatter, 9) > 0.10) AS unresolved, sum(n_ok) AS centres, min(lum_min) AS lo, max(lum_max) AS hi, bool_or(coalesce(falls, false)) AS contra,
  arg_max(group_ord, (f_number, group_ord)) AS ref_ord FROM st GROUP BY run_id),
r0 AS (SELECT u.run_id, coalesce(partitions, 0) AS partitions, {names(("partitions > 1", "mixed_lens_focal_identity"), ("smallest < 2", "insufficient_aperture_series"))} AS gate, ss.* EXCLUDE (run_id) FROM (SELECT DISTINCT run_id FROM m) u LEFT JOIN pa USING (run_id) LEFT JOIN ss USING (run_id)),
r1 AS (SELECT *, partitions = 1 AND gate = '' AS assessed, CASE WHEN centres < 2 THEN 0 ELSE log2(hi / lo) END AS drift FROM r0),
r2 AS (SELECT *, {names(("assessed AND round(scatter, 9) > 0.10", "unstable_repeat_outlier_excluded"), ("assessed AND round(drift, 9) > 0.25", "unstable_centre_luminance"))} AS r_warnings,
  {names(("assessed AND unresolved", "unstable_repeat_scatter"), ("assessed AND contra", "contradictory_aperture_trend"))} AS sanity FROM r1),
rr AS (SELECT r2.*, CASE WHEN gate <> '' THEN gate ELSE sanity END AS run_blockers, CASE WHEN assessed AND sanity = '' THEN ref_ord END AS reference_ord FROM r2),
rf AS (SELECT rr.*, x.f_number AS reference_f, x.raw_tl AS ref_tl, x.raw_tr AS ref_tr, x.raw_bl AS ref_bl, x.raw_br AS ref_br FROM rr LEFT JOIN m x ON x.run_id = rr.run_id AND x.group_ord = rr.reference_ord)"""
)
SERIES = (
    MEMBERS
    + f""", s0 AS (SELECT m.*, rf.* EXCLUDE (run_id), reference_f IS NOT NULL AND member AS inside, reference_f IS NOT NULL AND member AND group_ord = reference_ord AS is_ref, replace(m_blockers, 'symmetry_not_assessed', '') AS own FROM m JOIN rf USING (run_id)),
s1 AS (SELECT *, inside AND NOT is_ref AS compared, CASE WHEN run_blockers <> '' THEN {dedupe("own || ',' || run_blockers")} WHEN reference_f IS NULL THEN {dedupe("own")} WHEN is_ref THEN {dedupe("own || ',reference_aperture'")} WHEN inside THEN {dedupe("own")} ELSE m_blockers END AS blockers,
  CASE WHEN member THEN {dedupe("m_warnings || ',' || r_warnings")} ELSE m_warnings END AS warnings FROM s0),
s2 AS (SELECT *, CASE WHEN compared THEN raw_tl - ref_tl END AS delta_tl, CASE WHEN compared THEN raw_tr - ref_tr END AS delta_tr, CASE WHEN compared THEN raw_bl - ref_bl END AS delta_bl, CASE WHEN compared THEN raw_br - ref_br END AS delta_br, (raw_tl + raw_tr + raw_bl + raw_br) / 4 AS mean_raw FROM s1),
s3 AS (SELECT *, (delta_tl + delta_tr + delta_bl + delta_br) / 4 AS mean_delta FROM s2),
s4 AS (SELECT *, CASE WHEN compared THEN greatest(abs(delta_tl - mean_delta), abs(delta_tr - mean_delta), abs(delta_bl - mean_delta), abs(delta_br - mean_delta)) END AS max_deviation,
  ((delta_tl + delta_bl) - (delta_tr + delta_br)) / 2 AS left_right, ((delta_tl + delta_tr) - (delta_bl + delta_br)) / 2 AS top_bottom,
  CASE WHEN compared THEN greatest(abs(raw_tl - mean_raw), abs(raw_tr - mean_raw), abs(raw_bl - mean_raw), abs(raw_br - mean_raw)) END AS raw_bias FROM s3)"""
)
CURVES = (
    GROUPS
    + """, fp AS (SELECT run_id, lens_model, focal_length_mm, min(group_ord) AS ord, count(*) FILTER (f_number > 0 AND top_n > 0) AS ne, count(*) FILTER (NOT coalesce(f_number > 0 AND top_n > 0, false)) AS nx, bool_or(f_number IS NULL) AS missing,
  sum(n_unknown)::BIGINT AS unknown, sum(top_low)::BIGINT AS low, coalesce(string_agg(format('{:.1f}', f_number), ',' ORDER BY f_number) FILTER (f_number > 0 AND top_n > 0), '') AS included FROM g WHERE lens_model IS NOT NULL GROUP BY ALL),
rk AS (SELECT run_id, lens_model, focal_length_mm, f_number, round(fc_centre, 9) AS a, round(fc_corner, 9) AS b, row_number() OVER (w ORDER BY round(fc_centre, 9) DESC, f_number) AS ra, row_number() OVER (w ORDER BY round(fc_corner, 9) DESC, f_number) AS rb
  FROM g WHERE lens_model IS NOT NULL AND f_number > 0 AND top_n > 0 WINDOW w AS (PARTITION BY run_id, lens_model, focal_length_mm)),
pk AS (SELECT run_id, lens_model, focal_length_mm, max(f_number) FILTER (ra = 1) AS cf, max(f_number) FILTER (rb = 1) AS kf, max(a) FILTER (ra = 2) < max(a) FILTER (ra = 1) * 0.98 AND max(b) FILTER (rb = 2) < max(b) FILTER (rb = 1) * 0.98 AS clear FROM rk GROUP BY ALL),
fe AS (SELECT fp.*, cf, kf, coalesce(clear, false) AS clear, """
    + names(("missing", "missing_aperture"), ("ne < 2", "insufficient_aperture_series"), ("(ne < 2 OR missing) AND unknown > 0", "unknown_corrections"), ("(ne < 2 OR missing) AND low > 0", "low_texture"))
    + """ AS early FROM fp LEFT JOIN pk USING (run_id, lens_model, focal_length_mm)),
ff AS (SELECT *, early = '' AND clear AS peaked FROM fe),
fc AS (SELECT run_id, group_ord AS ord, 0 AS kind, lens_model, focal_length_mm, 'blocked' AS status, 0::BIGINT AS eligible_groups, 0::BIGINT AS excluded_groups, '' AS included, NULL::DOUBLE AS centre_peak_f, NULL::DOUBLE AS corner_peak_f, NULL::DOUBLE AS lag_stops, 'missing_lens_focal_identity' AS blockers, """
    + counts(("n_unknown", "unknown_corrections"), ("top_low", "low_texture"))
    + """ AS reasons FROM g WHERE lens_model IS NULL
  UNION ALL SELECT run_id, ord, 1, lens_model, focal_length_mm, CASE WHEN NOT peaked THEN 'blocked' WHEN 2 * log2(kf / cf) >= 1.75 THEN 'supported' ELSE 'not_supported' END, ne, nx, included, CASE WHEN peaked THEN cf END, CASE WHEN peaked THEN kf END, CASE WHEN peaked THEN 2 * log2(kf / cf) END,
    CASE WHEN early <> '' THEN early WHEN NOT peaked THEN 'ambiguous_peak' ELSE '' END, """
    + counts(("unknown", "unknown_corrections"), ("low", "low_texture"))
    + " FROM ff)"
)
PAIR = "CASE WHEN {0}_n < 2 THEN 'insufficient_samples,' ELSE '' END || CASE WHEN n_unknown > 0 THEN 'unknown_corrections,' ELSE '' END || CASE WHEN {0}_low > 0 THEN 'low_texture,' ELSE '' END"
_COPY = f""", c AS (SELECT t.*, CASE WHEN f_number IS NULL THEN 'missing_aperture' ELSE {dedupe("(CASE WHEN t_status <> 'passed' THEN 'target_quality_not_passed,' ELSE '' END || " + PAIR.format("top") + " || " + PAIR.format("bottom") + ")")} END AS c_blockers FROM t),
cs0 AS (SELECT run_id, bool_or(lens_model IS NULL) AS lost, count(DISTINCT (lens_model, focal_length_mm)) FILTER (lens_model IS NOT NULL) AS partitions, min(lens_model) AS lens_model, min(focal_length_mm) AS focal_length_mm, count(*) FILTER (c_blockers = '') AS candidates,
  coalesce(string_agg(format('{{:.1f}}', f_number), ',' ORDER BY f_number) FILTER (c_blockers = ''), '') AS included, coalesce(string_agg(c_blockers, ',' ORDER BY group_ord) FILTER (c_blockers <> ''), '') AS listed,
  avg(round(top_mean, 9)) FILTER (c_blockers = '') AS top_mean, avg(round(bottom_mean, 9)) FILTER (c_blockers = '') AS bottom_mean, max(greatest(abs(round(top_mean, 9)), abs(round(bottom_mean, 9)))) FILTER (c_blockers = '') AS max_abs,
  min(sign(round(top_mean, 9))) FILTER (c_blockers = '') AS tl, max(sign(round(top_mean, 9))) FILTER (c_blockers = '') AS th, min(sign(round(bottom_mean, 9))) FILTER (c_blockers = '') AS bl, max(sign(round(bottom_mean, 9))) FILTER (c_blockers = '') AS bh FROM c GROUP BY run_id),
cs AS (SELECT *, {dedupe("listed || CASE WHEN candidates < 2 THEN ',insufficient_aperture_series' ELSE '' END")} AS series_blockers FROM cs0)"""
COPY = TARGETS + _COPY


def keep(expr: str, *wanted: str) -> str:
    listed = ", ".join(f"'{w}'" for w in wanted)
    return f"array_to_string(list_filter(string_split({expr}, ','), lambda x: x IN ({listed})), ',')"


CONSISTENT = ("inconsistent_asymmetry", "asymmetry_above_centred_threshold", "asymmetry_below_decentred_threshold")
VERDICT = (
    CURVES
    + TARGETS[len(GROUPS) :]
    + _COPY
    + """, vd0 AS (SELECT cs.*, CASE WHEN lost THEN 'missing_lens_focal_identity' WHEN partitions = 0 THEN 'no_controlled_target_series' WHEN partitions > 1 THEN 'mixed_lens_focal_identity' ELSE '' END AS run_gate,
  CASE fc.status WHEN 'supported' THEN 'field_curvature_counterevidence' WHEN 'blocked' THEN replace(fc.blockers, 'ambiguous_peak', 'ambiguous_field_curvature') ELSE '' END AS fc_gate
  FROM cs LEFT JOIN fc ON fc.kind = 1 AND NOT lost AND partitions = 1 AND fc.run_id = cs.run_id AND fc.lens_model = cs.lens_model AND fc.focal_length_mm = cs.focal_length_mm),
vd1 AS (SELECT *, run_gate = '' AND series_blockers = '' AS assessed, round(max_abs, 9) <= 0.08 AS centred, CASE WHEN run_gate <> '' THEN run_gate WHEN series_blockers <> '' THEN series_blockers WHEN round(max_abs, 9) <= 0.08 THEN ''
  WHEN round(abs(top_mean), 9) < 0.18 OR round(abs(bottom_mean), 9) < 0.18 THEN 'asymmetry_above_centred_threshold,asymmetry_below_decentred_threshold'
  WHEN tl <> th OR bl <> bh OR tl = 0 OR bl = 0 OR sign(top_mean) <> sign(bottom_mean) THEN 'inconsistent_asymmetry' ELSE fc_gate END AS blockers FROM vd0),
vd AS (SELECT *, CASE WHEN blockers <> '' THEN 'inconclusive' WHEN centred THEN 'supports_centred' ELSE 'supports_decentred' END AS state FROM vd1)"""
)
RESHOOT = """rs(b, action) AS (VALUES ('no_controlled_target_series', 'capture_controlled_target_aperture_series'), ('target_quality_not_passed', 'improve_target_alignment'), ('unknown_corrections', 'use_uncorrected_raw_input'), ('low_texture', 'add_textured_corner_coverage'),
 ('insufficient_samples', 'add_repeat_frames'), ('missing_aperture', 'add_aperture_ladder'), ('insufficient_aperture_series', 'add_aperture_ladder'), ('ambiguous_field_curvature', 'add_corner_focus_disambiguator'), ('field_curvature_counterevidence', 'add_corner_focus_disambiguator'))"""
COURSES = """pl AS (SELECT s_suppkey::BIGINT AS run_id, x, y, CASE WHEN y % (CASE WHEN y < 48 THEN s_suppkey % 3 * 2 + 10 ELSE CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 3 * 2 + 10 WHEN 1 THEN s_suppkey % 3 * 2 + 13 WHEN 2 THEN s_suppkey % 3 * 2 + 11 ELSE 60 END END) < 3 THEN 0.05e0 ELSE 0.85e0 + (x % 3) * 0.01e0 END AS v
  FROM supplier, range(96) a(x), range(96) b(y)),
pf AS (SELECT run_id, 'vertical' AS axis, y AS i, avg(v) AS m FROM pl GROUP BY ALL UNION ALL SELECT run_id, 'horizontal', x, avg(v) FROM pl GROUP BY ALL),
pm AS (SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi FROM pf WINDOW w AS (PARTITION BY run_id, axis)),
pw AS (SELECT run_id, axis, pol, i, hi - lo AS contrast, CASE pol WHEN 0 THEN (lo + (hi - lo) * 0.35e0) - m ELSE m - (hi - (hi - lo) * 0.35e0) END AS w FROM pm, (VALUES (0), (1)) q(pol)),
pi AS (SELECT *, i - row_number() OVER (PARTITION BY run_id, axis, pol ORDER BY i) AS island FROM pw WHERE w > 0),
pc AS (SELECT run_id, axis, pol, island, sum(i * w) / sum(w) AS centre FROM pi GROUP BY ALL HAVING count(*) >= 2),
pn AS (SELECT a.run_id, a.axis, a.contrast, count(centre) FILTER (pol = 0) AS nd, count(centre) FILTER (pol = 1) AS nb FROM (SELECT DISTINCT run_id, axis, hi - lo AS contrast FROM pm) a LEFT JOIN pc ON pc.run_id = a.run_id AND pc.axis = a.axis GROUP BY ALL),
pp AS (SELECT pn.*, CASE WHEN nd >= nb THEN 'dark' ELSE 'bright' END AS polarity, greatest(nd, nb) AS marks FROM pn),
ct AS (SELECT pp.run_id, pp.axis, pp.polarity, (row_number() OVER (PARTITION BY pp.run_id, pp.axis ORDER BY centre) - 1)::INT AS i, centre FROM pp JOIN pc ON pc.run_id = pp.run_id AND pc.axis = pp.axis AND pc.pol = CASE pp.polarity WHEN 'dark' THEN 0 ELSE 1 END)"""
KEYSTONE = (
    COURSES
    + """, pd AS (SELECT run_id, axis, row_number() OVER (PARTITION BY run_id, axis ORDER BY i) AS k, centre - prev AS d FROM (SELECT *, lag(centre) OVER (PARTITION BY run_id, axis ORDER BY i) AS prev FROM ct) WHERE prev IS NOT NULL),
pe AS (SELECT *, count(*) OVER (PARTITION BY run_id, axis) AS n FROM pd),
pg AS (SELECT run_id, axis, avg(d) AS m, min(d) AS lo, max(d) AS hi, stddev_pop(d) / avg(d) AS cv, avg(d) FILTER (k <= n // 2) AS near, avg(d) FILTER (k > n - n // 2) AS far FROM pe GROUP BY ALL),
kk AS (SELECT pp.run_id, pp.axis, contrast, marks::INT AS marks, CASE WHEN contrast < 0.18 THEN 'low_contrast' WHEN marks < 5 THEN 'no_suitable_target_reference' WHEN lo <= 0 OR m < 3 THEN 'weak_target_geometry' WHEN hi > m * 1.8 THEN 'line_discontinuous' WHEN cv > 0.18 THEN 'weak_target_geometry' ELSE '' END AS blocker, near, far FROM pp LEFT JOIN pg USING (run_id, axis)),
kt AS (SELECT run_id, axis, contrast, marks, blocker, CASE WHEN blocker = '' THEN abs(far - near) / ((near + far) / 2) * 100 END AS keystone FROM kk)"""
)
LINES = """pr0 AS (SELECT s_suppkey::BIGINT AS run_id, CASE s_suppkey % 5 WHEN 0 THEN 8 WHEN 1 THEN 40 WHEN 2 THEN 25 WHEN 3 THEN 12 ELSE 36 END AS y0, (s_suppkey % 7 - 3)::DOUBLE AS sag, CASE WHEN s_suppkey % 6 = 5 THEN 30 ELSE 0 END AS fx,
  CASE WHEN s_suppkey % 6 = 5 THEN 44 WHEN s_suppkey % 6 = 4 THEN 70 ELSE 80 END AS tx, s_suppkey % 8 = 7 AS flat, s_suppkey % 2 = 0 AS dark FROM supplier),
pl AS (SELECT run_id, x, y, CASE WHEN NOT flat AND x >= fx AND x < tx AND abs(y - (y0 + 4e0 * sag * (x / 79e0) * (1e0 - x / 79e0))) <= 1e0 THEN CASE WHEN dark THEN 0.05e0 ELSE 0.85e0 END ELSE CASE WHEN dark THEN 0.85e0 ELSE 0.05e0 END END AS v FROM pr0, range(80) a(x), range(50) b(y)),
ln AS (SELECT run_id, 'horizontal' AS orientation, x AS major, y AS minor, v, 80 AS ml, 50 AS nl FROM pl UNION ALL SELECT run_id, 'vertical', y, x, v, 50, 80 FROM pl),
cd AS (SELECT orientation, base + 2 * k + d AS cand, d = 0 AS dark, CASE k WHEN 1 THEN nl - sd ELSE 0 END AS a, CASE k WHEN 0 THEN sd ELSE nl END AS b FROM (VALUES ('horizontal', 0, 50, 18), ('vertical', 6, 80, 28)) o(orientation, base, nl, sd), range(3) kk(k), range(2) dd(d)),
mm AS (SELECT run_id, ln.orientation, cand, dark, major, a, b, min(v) AS lo, max(v) AS hi FROM ln JOIN cd ON cd.orientation = ln.orientation AND minor >= a AND minor < b GROUP BY ALL HAVING max(v) - min(v) >= 0.15),
lv AS (SELECT *, CASE WHEN dark THEN lo + (hi - lo) * 0.45e0 ELSE hi - (hi - lo) * 0.45e0 END AS level FROM mm),
tp AS (SELECT lv.run_id, cand, lv.orientation, lv.major, sum(minor * abs(v - level)) / nullif(sum(abs(v - level)), 0) AS minor, any_value(hi - lo) AS contrast, count(*) / any_value(b - a)::DOUBLE AS support FROM lv JOIN ln ON ln.run_id = lv.run_id AND ln.orientation = lv.orientation AND ln.major = lv.major AND minor >= a AND minor < b AND CASE WHEN dark THEN v <= level ELSE v >= level END GROUP BY ALL),
pt AS (SELECT run_id, cand::INT AS cand, orientation, major::INT AS major, minor, contrast FROM tp WHERE support <= 0.75 AND minor IS NOT NULL)"""
FIT = (
    LINES
    + """, ga AS (SELECT *, major - lag(major) OVER (PARTITION BY run_id, cand ORDER BY major) - 1 AS gap FROM pt),
sx AS (SELECT run_id, cand, orientation, count(*) AS n, avg(contrast) AS contrast, coalesce(max(gap), 0) AS gap, min(major) AS first, max(major) AS last, arg_min(minor, major) AS fm, arg_max(minor, major) AS lm, avg(minor) AS mean_minor, avg(major) AS mid FROM ga GROUP BY ALL),
su AS (SELECT pt.*, major - mid AS u FROM pt JOIN sx USING (run_id, cand)),
sm AS (SELECT run_id, cand, count(*)::DOUBLE AS s0, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(minor) AS t0, sum(u * minor) AS t1, sum(u * u * minor) AS t2 FROM su GROUP BY ALL),
sd AS (SELECT *, CASE WHEN s0 >= 3 AND abs(s0 * (s2 * s4 - s3 * s3) - s2 * s2 * s2) > 1e-9 THEN s0 * (s2 * s4 - s3 * s3) - s2 * s2 * s2 END AS det FROM sm),
sf AS (SELECT run_id, cand, (t0 * (s2 * s4 - s3 * s3) + s2 * (t1 * s3 - s2 * t2)) / det AS c0, (s0 * (t1 * s4 - s3 * t2) - s2 * (t1 * s2 - t0 * s3)) / det AS c1, (s0 * (s2 * t2 - t1 * s3) - s2 * s2 * t0) / det AS c2 FROM sd),
sr AS (SELECT run_id, cand, sqrt(avg((minor - (c0 + c1 * u + c2 * u * u)) * (minor - (c0 + c1 * u + c2 * u * u)))) AS residual FROM su JOIN sf USING (run_id, cand) GROUP BY ALL),
fit AS (SELECT sx.*, c0, c1, c2, residual FROM sx JOIN sf USING (run_id, cand) JOIN sr USING (run_id, cand))"""
)
BOW = (
    FIT
    + """, b0 AS (SELECT *, CASE orientation WHEN 'horizontal' THEN 80 ELSE 50 END AS ml, CASE orientation WHEN 'horizontal' THEN 50 ELSE 80 END AS nl FROM fit),
b1 AS (SELECT *, (last - first + 1) / ml::DOUBLE AS span, (first + last) * 0.5 - mid AS u FROM b0),
b2 AS (SELECT *, CASE WHEN contrast < 0.15 THEN 'low_contrast' WHEN gap > greatest(ceil(ml * 0.08), 1) THEN 'line_discontinuous' WHEN span < 0.25 THEN 'profile_too_short' WHEN residual > 1 THEN 'fit_residual_too_high' END AS blocker,
  CASE WHEN mean_minor < nl * 0.35e0 THEN CASE orientation WHEN 'horizontal' THEN 'top' ELSE 'left' END WHEN mean_minor > nl * 0.65e0 THEN CASE orientation WHEN 'horizontal' THEN 'bottom' ELSE 'right' END END AS side, c0 + c1 * u + c2 * u * u - (fm + lm) * 0.5 AS raw FROM b1),
b3 AS (SELECT *, CASE WHEN side IN ('top', 'left') THEN -raw ELSE raw END AS sagitta FROM b2),
b4 AS (SELECT *, sagitta / nl * 100 AS bow, blocker IS NULL AND span >= 0.72 AND side IS NOT NULL AS eligible FROM b3),
b5 AS (SELECT * FROM b4 WHERE blocker IS NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY eligible DESC, round(span, 9) DESC, round(abs(bow), 9) DESC, cand) = 1),
b6 AS (SELECT run_id, string_agg(blocker, ',' ORDER BY pos) AS listed FROM (SELECT run_id, blocker, min(cand) AS pos FROM b4 WHERE blocker IS NOT NULL GROUP BY ALL) GROUP BY run_id)"""
)

SHIFT_BLOCKERS = ("low_texture", "flat_profile", "correlation_peak_not_found", "profile_too_short", "unsupported_colour_channels")


def nudged(sql: str) -> str:
    """Every round(.., 6) with the nudge that queries use."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 0, i + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if depth == 0:
                break
            j += 1
        inner = nudged(sql[i + 6 : j])
        out += sql[at:i] + "round(" + (inner[:-3] + " + 3.7e-10, 6" if inner.endswith(", 6") else inner) + ")"
        at = j + 1
    return out + sql[at:]


_SQL: dict[str, str] = {
    "acutance_patch": f"""WITH {BLUR} SELECT vec_id, round(CASE WHEN stddev_pop(v) <= 1e-6 OR stddev_pop(fine - coarse) <= 1e-6 THEN 0 ELSE stddev_pop(v - fine) / stddev_pop(fine - coarse) END, 6) AS acutance, round(CASE WHEN avg(v) <= 0 THEN 0 ELSE stddev_pop(v) / avg(v) END, 6) AS contrast, round(median(v), 6) AS luminance FROM f GROUP BY vec_id""",
    "gaussian_blur_patch": f"WITH {BLUR} SELECT vec_id, x::INT AS x, y::INT AS y, {r('fine', 'coarse')} FROM f",
    "median_luminance": f"WITH {PX} SELECT vec_id, round(median(v), 6) AS luminance FROM px GROUP BY vec_id",
    "contrast_texture_gate": f"WITH {PX} SELECT vec_id, round(stddev_pop(v) / avg(v), 6) AS contrast, round(stddev_pop(v) / avg(v), 9) >= 0.15 AS usable FROM px GROUP BY vec_id",
    "zone_geometry": f"WITH {ZONES} SELECT * FROM z",
    "zone_projection": f"""WITH {ZONES}, ph AS (SELECT *, CASE id % 4 WHEN 0 THEN 'RGGB' WHEN 1 THEN 'BGGR' WHEN 2 THEN 'GBRG' ELSE 'GRBG' END AS pattern, CASE WHEN id % 4 < 2 THEN 1 ELSE 0 END AS px FROM z),
s AS (SELECT *, greatest(CASE WHEN x % 2 = px THEN x ELSE x + 1 END, px) AS ax, CASE WHEN y % 2 = 0 THEN y ELSE y + 1 END AS ay FROM ph)
SELECT id, zone, pattern, ((ax - px) // 2)::INT AS gx, (ay // 2)::INT AS gy, ((x + w - 1 - ax) // 2 + 1)::INT AS gw, ((y + h - 1 - ay) // 2 + 1)::INT AS gh FROM s""",
    "green_extract": f"""WITH {PX}, q AS (SELECT *, {PATTERN} AS pattern, CASE WHEN vec_id % 4 < 2 THEN 1 ELSE 0 END AS ph, i % 8 AS x, i // 8 AS y FROM px)
SELECT vec_id, pattern, ((x - ph) // 2)::INT AS x, (y // 2)::INT AS y, round((v - (0.25 + 0.01 * ph)::DOUBLE) / ((1.75 - 0.01 * ph)::DOUBLE - (0.25 + 0.01 * ph)::DOUBLE), 6) + 0 AS green FROM q WHERE x % 2 = ph AND y % 2 = 0""",
    "luma_extract": f"WITH {RGB} SELECT vec_id, (i // 3)::INT AS i, round(sum(v * CASE i % 3 WHEN 0 THEN 0.2126e0 WHEN 1 THEN 0.7152e0 ELSE 0.0722e0 END), 6) AS luma FROM rgb GROUP BY ALL",
    "rgb_split": f"WITH {RGB} SELECT vec_id, (i // 3)::INT AS i, round(max(v) FILTER (i % 3 = 0), 6) AS red, round(max(v) FILTER (i % 3 = 2), 6) AS blue FROM rgb GROUP BY ALL",
    "bayer_interpolate": f"""WITH {PX}, q AS (SELECT *, i % 8 AS x, i // 8 AS y, vec_id % 4 AS k FROM px),
ph AS (SELECT * FROM (VALUES (0, 'red', 0, 0), (0, 'blue', 1, 1), (1, 'red', 1, 1), (1, 'blue', 0, 0), (2, 'red', 0, 1), (2, 'blue', 1, 0), (3, 'red', 1, 0), (3, 'blue', 0, 1)) t(k, colour, cx, cy)),
o AS (SELECT a.vec_id, a.x, a.y, colour, cx, cy, avg(b.v) AS v FROM q a JOIN ph USING (k) JOIN q b ON b.vec_id = a.vec_id AND b.x % 2 = cx AND b.y % 2 = cy AND abs(b.x - a.x) = CASE WHEN a.x % 2 = cx THEN 0 ELSE 1 END AND abs(b.y - a.y) = CASE WHEN a.y % 2 = cy THEN 0 ELSE 1 END GROUP BY ALL),
n AS (SELECT vec_id, x, y, colour, (v - (0.25 + 0.01 * (cy * 2 + cx))::DOUBLE) / ((1.75 - 0.01 * (cy * 2 + cx))::DOUBLE - (0.25 + 0.01 * (cy * 2 + cx))::DOUBLE) AS v FROM o)
SELECT vec_id, x::INT AS x, y::INT AS y, round(max(v) FILTER (colour = 'red'), 6) + 0 AS red, round(max(v) FILTER (colour = 'blue'), 6) + 0 AS blue FROM n GROUP BY ALL""",
    "level_normalise": f"WITH {RGB} SELECT vec_id, i::INT AS i, round((v - (0.1 * (i % 3 + 1))::DOUBLE) / ((1.9 - 0.1 * (i % 3))::DOUBLE - (0.1 * (i % 3 + 1))::DOUBLE), 6) + 0 AS value FROM rgb",
    "row_col_profiles": f"WITH {PROFILES} SELECT vec_id, axis, j::INT AS i, round(m, 6) AS mean FROM pr",
    "profile_variance_gate": f"""WITH {PX.replace("unnest(embedding)::DOUBLE + 1 AS v", "CASE WHEN vec_id % 10 = 0 THEN 1 ELSE unnest(embedding)::DOUBLE + 1 END AS v")}, a AS (SELECT vec_id, i % 8 AS j, avg(v) AS m FROM px GROUP BY ALL), b AS (SELECT vec_id, i // 8 AS j, avg(v) AS m FROM px GROUP BY ALL),
u AS (SELECT vec_id, var_pop(m) AS vx FROM a GROUP BY vec_id), w AS (SELECT vec_id, var_pop(m) AS vy FROM b GROUP BY vec_id)
SELECT vec_id, round(vx, 6) + 0 AS variance_x, round(vy, 6) + 0 AS variance_y, CASE WHEN round(vx, 12) < 1e-8 THEN 'flat_profile' ELSE '' END AS blocker_x, CASE WHEN round(vy, 12) < 1e-8 THEN 'flat_profile' ELSE '' END AS blocker_y FROM u JOIN w USING (vec_id)""",
    "lag_scores": f"WITH {LAGS} SELECT vec_id, axis, lag::INT AS lag, round(score, 6) AS score FROM sc",
    "ca_shift": f"""WITH {LAGS}, va AS (SELECT a.vec_id, a.axis, var_pop(a.m) < 1e-8 OR var_pop(b.m) < 1e-8 AS flat FROM pr a JOIN pr b ON b.vec_id = a.vec_id + 1 AND b.axis = a.axis AND b.j = a.j GROUP BY ALL),
be AS (SELECT * FROM sc WHERE abs(lag) <= 2 AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id, axis ORDER BY score DESC, abs(lag), lag) = 1),
re AS (SELECT va.vec_id, va.axis, CASE WHEN flat THEN 'flat_profile' WHEN be.lag IS NULL THEN 'correlation_peak_not_found' END AS blocker,
  be.lag + coalesce(CASE WHEN abs(l.score - 2 * be.score + r.score) > 1.1920929e-7 THEN least(greatest(0.5 * (l.score - r.score) / (l.score - 2 * be.score + r.score), -0.5), 0.5) END, 0) AS s
  FROM va LEFT JOIN be USING (vec_id, axis) LEFT JOIN sc l ON l.vec_id = be.vec_id AND l.axis = be.axis AND l.lag = be.lag - 1 LEFT JOIN sc r ON r.vec_id = be.vec_id AND r.axis = be.axis AND r.lag = be.lag + 1),
o AS (SELECT x.vec_id, coalesce(x.blocker, y.blocker) AS blocker, x.s AS sx, y.s AS sy FROM re x JOIN re y ON y.vec_id = x.vec_id AND x.axis = 'x' AND y.axis = 'y')
SELECT vec_id, CASE WHEN blocker IS NULL THEN round(sx, 6) + 0 END AS shift_x, CASE WHEN blocker IS NULL THEN round(sy, 6) + 0 END AS shift_y, CASE WHEN blocker IS NULL THEN round(sqrt(sx * sx + sy * sy), 6) END AS magnitude, coalesce(blocker, '') AS blocker FROM o""",
    "trace_points": f"WITH {LINES} SELECT run_id, cand, orientation, major, {r('minor', 'contrast')} FROM pt",
    "quadratic_fit": f"WITH {FIT} SELECT run_id, cand, n, gap, first, last, {r('mean_minor', 'c0', 'c1', 'c2', 'residual')} FROM fit",
    "distortion_frame": f"""WITH {BOW} SELECT u.run_id, CASE WHEN b5.cand IS NOT NULL THEN CASE WHEN eligible THEN 'measured_straight_line_bow' ELSE 'inferred_weak_reference_bow' END END AS method, b5.orientation, side, {r("bow", "sagitta", "span", "residual")}, CASE WHEN b5.cand IS NOT NULL THEN CASE WHEN eligible THEN 0.9e0 ELSE 0.4e0 END END AS confidence,
CASE WHEN b5.cand IS NOT NULL THEN CASE WHEN eligible THEN '' ELSE 'weak_reference_geometry' END ELSE coalesce(listed, 'no_straight_reference') END AS blockers FROM pr0 u LEFT JOIN b5 USING (run_id) LEFT JOIN b6 USING (run_id)""",
    "target_runs": f"WITH {COURSES} SELECT run_id, axis, polarity, i, round(centre, 6) AS centre FROM ct",
    "keystone": f"WITH {KEYSTONE} SELECT run_id, axis, {r('contrast')}, marks, {r('keystone')}, blocker FROM kt",
    "target_qa_frame": f"""WITH {KEYSTONE}, kr AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(keystone, 9) DESC, round(contrast, 9) DESC, axis DESC) AS rk, count(*) OVER (PARTITION BY run_id) AS n FROM kt WHERE blocker = ''),
kx AS (SELECT run_id, max(n) AS n, max(round(keystone, 9)) AS top, min(round(keystone, 9)) AS nxt, max(keystone) FILTER (rk = 1) AS exact, max(axis) FILTER (rk = 1) AS axis FROM kr GROUP BY run_id),
kb AS (SELECT run_id, max(CASE WHEN axis = 'vertical' THEN nullif(blocker, '') END) AS b1, max(CASE WHEN axis = 'horizontal' THEN nullif(blocker, '') END) AS b2 FROM kt GROUP BY run_id),
kd AS (SELECT kb.*, kx.* EXCLUDE (run_id), coalesce(n = 2 AND (top = 0 OR (top - nxt) / nullif(top, 0) <= 0.2), false) AS amb FROM kb LEFT JOIN kx USING (run_id))
SELECT run_id, CASE WHEN n > 0 AND NOT amb THEN CASE WHEN exact > 1.5 THEN 'gated' ELSE 'passed' END ELSE 'blocked' END AS status, CASE WHEN n > 0 AND NOT amb THEN round(exact, 6) END AS keystone, CASE WHEN n > 0 AND NOT amb THEN axis END AS axis,
CASE WHEN n > 0 AND NOT amb THEN '' WHEN amb THEN 'ambiguous_tilt_axis' WHEN b2 IS NULL THEN b1 WHEN b1 IS NULL OR b1 = b2 THEN b2 ELSE b1 || ',' || b2 END AS blockers FROM kd""",
    "falloff_stops": f"WITH {FRAMES} SELECT run_id, input_index, round(fall, 6) + 0 AS stops_tl, round(fall + bias, 6) + 0 AS stops_tr, round(fall, 6) + 0 AS stops_bl, round(fall, 6) + 0 AS stops_br FROM fz",
    "correction_gate": """SELECT CASE WHEN l_returnflag = 'N' THEN 'accepted_unknown_corrections' ELSE 'confirmed_uncorrected' END AS status, l_returnflag <> 'N' AS eligible, CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'OpcodeList1; OpcodeList3' ELSE 'correction metadata unavailable' END END AS provenance, count(*) AS frames FROM lineitem GROUP BY ALL""",
    "group_frames": f"WITH {FRAMES} SELECT run_id, min(input_index) AS group_ord, lens_model, focal_length_mm, f_number, count(*) AS frames FROM fr GROUP BY {KEYS}",
    "decentring_pairs": f"""WITH {GROUPS} SELECT run_id, group_ord, f_number, 'top_pair' AS pair, top_n AS included, n_unknown + top_low AS excluded, round(top_mean, 6) + 0 AS mean_delta, round(top_scatter, 6) AS scatter, {names(("top_n < 2", "insufficient_samples"))} AS blockers, {counts(("n_unknown", "unknown_corrections"), ("top_low", "low_texture"))} AS reasons FROM g
UNION ALL SELECT run_id, group_ord, f_number, 'bottom_pair', bottom_n, n_unknown, round(bottom_mean, 6) + 0, round(bottom_scatter, 6), {names(("bottom_n < 2", "insufficient_samples"))}, {counts(("n_unknown", "unknown_corrections"))} FROM g""",
    "ca_group": f"""WITH {FRAMES}, z AS (SELECT fz.*, corner, ((p + 7 * k) % 9 - 4) / 4e0 AS cx, ((o + 5 * k) % 7 - 3) / 4e0 AS cy,
  CASE WHEN p % 31 = 0 THEN ['flat_profile'] WHEN (p + 3 * k) % 37 = 0 THEN ['correlation_peak_not_found'] WHEN (o + k) % 41 = 0 THEN ['profile_too_short', 'low_texture'] WHEN (p + o + k) % 43 = 0 THEN ['unsupported_colour_channels'] WHEN (p + 5 * k) % 29 = 0 THEN ['low_texture'] END AS b
  FROM fz, (VALUES (0, 'top_left'), (1, 'top_right'), (2, 'bottom_left'), (3, 'bottom_right')) c(k, corner)),
s AS (SELECT {KEYS}, corner, min(input_index) AS group_ord, count(*) FILTER (ok AND b IS NULL) AS n, avg(cx) FILTER (ok AND b IS NULL) AS mx, avg(cy) FILTER (ok AND b IS NULL) AS my, stddev_samp(cx) FILTER (ok AND b IS NULL) AS sx, stddev_samp(cy) FILTER (ok AND b IS NULL) AS sy, count(*) FILTER (NOT ok) AS nu,
  {", ".join(f"count(*) FILTER (ok AND list_contains(b, '{x}')) AS n{i}" for i, x in enumerate(SHIFT_BLOCKERS))}, count(*) FILTER (list_contains(b, 'unsupported_colour_channels')) AS na FROM z GROUP BY ALL)
SELECT run_id, group_ord, f_number, corner, n AS included, nu + n0 + n1 + n2 + n3 + n4 AS excluded, round(mx, 6) + 0 AS mean_x, round(my, 6) + 0 AS mean_y, round(sqrt(mx * mx + my * my), 6) AS magnitude, round(sx, 6) AS scatter_x, round(sy, 6) AS scatter_y, round(sqrt(sx * sx + sy * sy), 6) AS scatter,
  {names(("n < 2", "insufficient_samples"), ("nu > 0", "unknown_corrections"), *[(f"n{i} > 0", x) for i, x in enumerate(SHIFT_BLOCKERS[:4])], ("na > 0", SHIFT_BLOCKERS[4]))} AS blockers, {counts(("nu", "unknown_corrections"), *[(f"n{i}", x) for i, x in enumerate(SHIFT_BLOCKERS)])} AS reasons FROM s""",
    "distortion_group": f"""WITH {FRAMES}, q AS (SELECT *, CASE WHEN p % 12 = 3 THEN 'n' WHEN p % 4 = 2 THEN 'l' WHEN p % 4 = 1 THEN 'w' ELSE 'm' END AS k, ((p + o) % 21 - 10) / 10e0 AS bow FROM fz),
s AS (SELECT {KEYS}, min(input_index) AS group_ord, count(*) FILTER (ok AND k = 'm') AS included, avg(bow) FILTER (ok AND k = 'm') AS mean_bow, stddev_samp(bow) FILTER (ok AND k = 'm') AS scatter, count(*) FILTER (NOT ok) AS nu, count(*) FILTER (ok AND k = 'n') AS nn, count(*) FILTER (ok AND k = 'w') AS nw, count(*) FILTER (ok AND k = 'l') AS nl FROM q GROUP BY ALL)
SELECT run_id, group_ord, f_number, included, {r("mean_bow", "scatter")}, {names(("included < 2", "insufficient_samples"), ("nu > 0", "unknown_corrections"), ("nn > 0", "no_straight_reference"), ("nw > 0", "weak_reference_geometry"), ("nl > 0", "line_discontinuous"))} AS blockers, {counts(("nu", "unknown_corrections"), ("nn", "no_straight_reference"), ("nw", "weak_reference_geometry"), ("nl", "line_discontinuous"))} AS reasons FROM s""",
    "target_quality_group": f"WITH {TARGETS} SELECT run_id, group_ord, t_status AS status, round(coalesce(t_gated, t_passed), 6) AS keystone, t_assessed AS assessed, t_blocked AS blocked, t_blockers AS blockers FROM t",
    "vignetting_group": f"""WITH {STABLE} SELECT run_id, group_ord, v_n AS included, round(v_scatter, 6) + 0 AS scatter, {r("raw_tl", "raw_tr", "raw_bl", "raw_br")}, {names(("v_n = 0", "insufficient_aperture_series"), ("n_unknown > 0", "unknown_corrections"), ("true", "symmetry_not_assessed"))} AS blockers, {names(("v_out > 0", "unstable_repeat_outlier_excluded"))} AS warnings, {counts(("v_out", "unstable_repeat_outlier"), ("n_unknown", "unknown_corrections"))} AS reasons FROM v""",
    "stable_repeats": """WITH q AS (SELECT l_orderkey::BIGINT AS run_id, (l_partkey * 7 % 11 - 5) / 200e0 - CASE WHEN l_partkey % 5 = 0 THEN 0.3e0 ELSE 0e0 END AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) - 1 AS bit FROM lineitem),
s AS (SELECT run_id, count(*) AS n, max(f) - min(f) AS rng, avg(f) AS mean FROM q GROUP BY run_id),
bx AS (SELECT a.run_id, a.f, count(*) AS k, max(c.f) - min(c.f) AS sc, avg(c.f) AS m, sum(1::HUGEINT << c.bit::INT) AS mask FROM (SELECT DISTINCT q.run_id, f FROM q JOIN s USING (run_id) WHERE n BETWEEN 3 AND 63 AND round(rng, 9) > 0.10) a JOIN q c ON c.run_id = a.run_id AND c.f >= a.f AND round(c.f - a.f, 9) <= 0.10 GROUP BY ALL HAVING count(*) >= 2),
be AS (SELECT * FROM bx QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k DESC, round(sc, 9), mask) = 1)
SELECT s.run_id, n, coalesce(k, n) AS kept, round(coalesce(sc, rng), 6) + 0 AS scatter, round(coalesce(m, mean), 6) + 0 AS mean FROM s LEFT JOIN be USING (run_id)""",
    "fc_samples": f"WITH {GROUPS} SELECT run_id, group_ord, f_number, top_n AS samples, n_unknown AS unknown, top_low AS low_texture, round(fc_centre, 6) AS centre, round(fc_corner, 6) AS corner FROM g",
    "field_curvature": f"WITH {CURVES} SELECT * EXCLUDE (kind, lag_stops), round(lag_stops, 6) + 0 AS lag_stops FROM fc",
    "vignetting_partitions": f"WITH {MEMBERS} SELECT run_id, group_ord, s_lens, s_focal, member, m_blockers AS blockers, m_warnings AS warnings, partitions, gate FROM m JOIN rf USING (run_id)",
    "vignetting_series_flags": f"WITH {MEMBERS} SELECT run_id, {r('scatter', 'drift')}, r_warnings AS warnings, sanity, reference_f FROM rf",
    "vignetting_optical_delta": f"WITH {SERIES} SELECT run_id, group_ord, f_number, CASE WHEN inside THEN reference_f END AS reference_f_number, {r('delta_tl', 'delta_tr', 'delta_bl', 'delta_br')}, blockers, warnings FROM s4",
    "vignetting_symmetry": f"""WITH {SERIES} SELECT run_id, group_ord, CASE WHEN run_blockers <> '' THEN 'blocked' WHEN reference_f IS NULL THEN CASE WHEN blockers <> '' THEN 'blocked' ELSE 'not_assessed' END WHEN compared THEN CASE WHEN round(max_deviation, 9) <= 0.08 AND round(raw_bias, 9) >= 0.15 THEN 'lighting_biased' WHEN round(max_deviation, 9) <= 0.12 THEN 'radially_symmetric' ELSE 'mixed_or_unstable' END ELSE 'not_assessed' END AS symmetry,
{r("mean_delta", "max_deviation", "left_right", "top_bottom", "raw_bias")}, CASE WHEN run_blockers <> '' THEN run_blockers WHEN reference_f IS NULL THEN blockers WHEN is_ref THEN 'reference_aperture' WHEN compared THEN '' ELSE 'symmetry_not_assessed' END AS symmetry_blockers FROM s4""",
    "copy_candidates": f"WITH {COPY} SELECT run_id, group_ord, f_number, {r('top_mean', 'bottom_mean')}, c_blockers = '' AS candidate, c_blockers AS blockers FROM c",
    "copy_series_summary": f"WITH {COPY} SELECT run_id, lost, partitions, candidates, included, {r('top_mean', 'bottom_mean', 'max_abs')}, series_blockers FROM cs",
    "copy_assessment": f"""WITH {VERDICT} SELECT run_id, state, blockers, CASE WHEN run_gate = '' THEN lens_model END AS lens_model, CASE WHEN run_gate = '' THEN focal_length_mm END AS focal_length_mm, CASE WHEN run_gate = '' THEN included ELSE '' END AS included,
CASE WHEN run_gate <> '' THEN 'no_controlled_target_series' WHEN assessed THEN '' ELSE {keep("blockers", "target_quality_not_passed", "unknown_corrections")} END AS gate_target_quality,
CASE WHEN run_gate <> '' THEN 'no_controlled_target_series' WHEN assessed THEN '' ELSE {keep("blockers", "unknown_corrections")} END AS gate_correction_provenance,
CASE WHEN run_gate <> '' THEN 'no_controlled_target_series' WHEN assessed THEN '' ELSE {keep("blockers", "missing_aperture", "insufficient_aperture_series")} END AS gate_aperture_series,
CASE WHEN run_gate <> '' THEN 'no_controlled_target_series' WHEN assessed THEN {keep("blockers", *CONSISTENT)} ELSE {keep("blockers", "low_texture", "insufficient_samples", *CONSISTENT)} END AS gate_left_right_consistency,
CASE WHEN run_gate <> '' THEN 'no_controlled_target_series' WHEN state = 'supports_centred' THEN '' ELSE fc_gate END AS gate_field_curvature,
CASE WHEN assessed THEN round(top_mean, 6) + 0 END AS top_mean, CASE WHEN assessed THEN round(bottom_mean, 6) + 0 END AS bottom_mean, CASE WHEN assessed THEN round(max_abs, 6) END AS max_abs FROM vd""",
    "reshoot_actions": f"""WITH {VERDICT}, {RESHOOT}, ex AS (SELECT run_id, unnest(string_split(blockers, ',')) AS b, unnest(range(len(string_split(blockers, ',')))) AS pos FROM vd),
ac AS (SELECT run_id, action, min(pos) AS pos FROM ex JOIN rs USING (b) GROUP BY ALL), al AS (SELECT run_id, string_agg(action, ',' ORDER BY pos) AS reshoot FROM ac GROUP BY run_id)
SELECT run_id, blockers, coalesce(reshoot, '') AS reshoot FROM vd LEFT JOIN al USING (run_id)""",
    "contact_layout": f"""WITH {FRAMES}, q AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n0 FROM fz)
SELECT run_id, input_index, least(n0, 4) AS columns, ceil(n0 / least(n0, 4))::BIGINT AS rows, (input_index % least(n0, 4)) * 108 AS left, (input_index // least(n0, 4)) * 96 AS top, substr('frame ?' || input_index || CASE WHEN f_number IS NULL THEN '' ELSE ' f/' || format('{{:.1f}}', f_number) END, 1, 24) AS label FROM q""",
    "thumbnail_sample": f"""WITH {PX} SELECT vec_id, x::INT AS x, y::INT AS y, floor(least(greatest(v - 0.5, 0), 1) * 255 + 0.5)::INT AS byte FROM range(12) a(x), range(9) b(y), px WHERE i = (y * 8 // 9) * 8 + x * 8 // 12""",
    "analyse_frames": """WITH s AS (SELECT s_suppkey // 4 AS run_id, s_suppkey % 4 AS input_index, CASE WHEN s_suppkey // 4 % 2 = 0 THEN 1 ELSE -1 END AS sign FROM supplier)
SELECT run_id::BIGINT AS run_id, input_index::BIGINT AS input_index, ['vignetting', 'colour_shift', 'bow', 'courses'][input_index + 1] AS kind,
CASE input_index WHEN 0 THEN -1::DOUBLE END AS falloff_tl, CASE input_index WHEN 0 THEN -1::DOUBLE END AS falloff_tr, CASE input_index WHEN 0 THEN -1::DOUBLE END AS falloff_bl, CASE input_index WHEN 0 THEN -1::DOUBLE END AS falloff_br,
CASE input_index WHEN 1 THEN true END AS shift_tl, CASE input_index WHEN 1 THEN true END AS shift_tr, CASE input_index WHEN 1 THEN true END AS shift_bl, CASE input_index WHEN 1 THEN true END AS shift_br,
CASE input_index WHEN 2 THEN true END AS bow_near, CASE input_index WHEN 2 THEN 'top' END AS bow_side,
CASE input_index WHEN 3 THEN CASE sign WHEN 1 THEN 'gated' ELSE 'passed' END END AS target, CASE input_index WHEN 3 THEN CASE sign WHEN 1 THEN 20::DOUBLE ELSE 0::DOUBLE END END AS keystone FROM s""",
    "green_correlation": f"""WITH {PX}, q AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, v, CASE WHEN vec_id % 4 < 2 THEN 1 ELSE 0 END AS ph FROM px),
p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM q a JOIN q b ON b.vec_id = a.vec_id AND b.x // 2 = a.x // 2 AND b.y = a.y + 1 WHERE a.y % 2 = 0 AND a.x % 2 = a.ph AND b.x % 2 = 1 - a.ph)
SELECT vec_id, round(corr(a, b), 6) + 0 AS correlation, coalesce(round(corr(a, b), 9) >= 0.9, false) AS plausible FROM p GROUP BY vec_id""",
    "top_centre_falloff": """WITH p AS (SELECT s_suppkey::BIGINT AS run_id, x, 1e0 - ((x - (s_suppkey % 11 + 35)) * (x - (s_suppkey % 11 + 35)) + (y - 25) * (y - 25)) * (s_suppkey % 5 + 1) / 20000e0 + (x % 3) * 0.001e0 AS v FROM supplier, range(80) a(x), range(50) b(y) WHERE y BETWEEN 2 AND 6),
m AS (SELECT run_id, median(v) FILTER (x BETWEEN 3 AND 10) AS l, median(v) FILTER (x BETWEEN 36 AND 43) AS c, median(v) FILTER (x BETWEEN 69 AND 76) AS r FROM p GROUP BY run_id)
SELECT run_id, round(log2(l / c), 6) + 0 AS top_left, round(log2(r / c), 6) + 0 AS top_right FROM m""",
    "vignetting_uncontrolled": f"""WITH {STABLE} SELECT run_id, group_ord, f_number, {names(("v_n = 0", "insufficient_aperture_series"), ("n_unknown > 0", "unknown_corrections"), ("true", "symmetry_not_assessed"), ("true", "controlled_aperture_series_not_assessed"))} AS blockers, {names(("v_out > 0", "unstable_repeat_outlier_excluded"))} AS warnings FROM v""",
    "batch_records": f"""WITH {FRAMES} SELECT run_id, input_index, to_json({{'file': 'frame_' || input_index, 'F': f_number, 'zones': {{'TL': [round(ac_corner + d_top / 2 + 3.7e-10, 3), round(CASE WHEN textured THEN 0.2e0 ELSE 0.1e0 END + 3.7e-10, 3)], 'TR': [round(ac_corner - d_top / 2 + 3.7e-10, 3), 0.2e0], 'C': [round(ac_centre + 3.7e-10, 3), 0.2e0], 'BL': [round(ac_corner + d_bot / 2 + 3.7e-10, 3), 0.2e0], 'BR': [round(ac_corner - d_bot / 2 + 3.7e-10, 3), 0.2e0]}}}})::VARCHAR AS record FROM fz""",
    "contact_sheets": f"""WITH {PX}, t AS (SELECT vec_id, 3 * sum(floor(least(greatest(v - 0.5, 0), 1) * 255 + 0.5)::BIGINT * 12 * 9)::BIGINT AS s FROM px GROUP BY vec_id), n AS (SELECT label::BIGINT AS run_id, count(*) AS n, sum(s)::BIGINT AS thumb_sum FROM embeddings JOIN t USING (vec_id) GROUP BY label)
SELECT run_id, (least(n, 4) * 108)::BIGINT AS width, (ceil(n / least(n, 4))::BIGINT * 96)::BIGINT AS height, ceil(ceil(n / least(n, 4)) / 64)::INT AS bands, thumb_sum FROM n""",
    "analyse_runs": """WITH k AS (SELECT s_suppkey::BIGINT AS run_id, s_suppkey % 4 AS kind FROM supplier)
SELECT run_id, CASE kind WHEN 0 THEN 'supports_centred' WHEN 1 THEN 'supports_decentred' ELSE 'inconclusive' END AS state, CASE kind WHEN 2 THEN 'missing_lens_focal_identity' WHEN 3 THEN 'target_quality_not_passed,insufficient_aperture_series' ELSE '' END AS blockers,
CASE WHEN kind <> 2 THEN 'bench lens' END AS lens_model, CASE WHEN kind <> 2 THEN 50::DOUBLE END AS focal_length_mm, CASE WHEN kind < 2 THEN '4.0,5.6,8.0,11.0' ELSE '' END AS included,
CASE kind WHEN 2 THEN 'no_controlled_target_series' WHEN 3 THEN 'target_quality_not_passed' ELSE '' END AS gate_target_quality, CASE kind WHEN 2 THEN 'no_controlled_target_series' ELSE '' END AS gate_correction_provenance,
CASE kind WHEN 2 THEN 'no_controlled_target_series' WHEN 3 THEN 'insufficient_aperture_series' ELSE '' END AS gate_aperture_series, CASE kind WHEN 2 THEN 'no_controlled_target_series' ELSE '' END AS gate_left_right_consistency,
CASE kind WHEN 2 THEN 'no_controlled_target_series' ELSE '' END AS gate_field_curvature, CASE kind WHEN 3 THEN 'improve_target_alignment,add_aperture_ladder' ELSE '' END AS reshoot FROM k""",
    "inspect_files": r"""WITH f AS (SELECT doc_id AS d, doc_id % 3 AS kind, CASE doc_id % 3 WHEN 2 THEN 3 ELSE 1 END AS parts, octet_length(encode(coalesce(text, ''))) AS size FROM documents WHERE doc_id IS NOT NULL)
SELECT d AS doc_id, ['dng', 'tif', 'tiff'][kind + 1] AS extension, CASE kind WHEN 0 THEN 'cfa' ELSE 'rgb' END AS source_kind, CASE kind WHEN 0 THEN 'maker' END AS camera_make, CASE WHEN kind = 0 AND d % 5 > 0 THEN 'lens ' || d % 5 END AS lens_model,
 16::INT AS width, greatest(2, (size + 32 * parts - 1) // (32 * parts))::INT AS height, parts::INT AS components, 16::INT AS bits_per_sample, CASE kind WHEN 0 THEN ['RGGB', 'BGGR', 'GBRG', 'GRBG'][d // 3 % 4 + 1] END AS cfa_pattern,
 CASE kind WHEN 0 THEN 0::DOUBLE END AS black, CASE kind WHEN 0 THEN 60000::DOUBLE END AS white, CASE kind WHEN 0 THEN (24 + d % 5)::DOUBLE END AS focal_length_mm, CASE WHEN kind = 0 AND d % 10 > 1 THEN round(d % 10 * 14 / 10e0, 6) END AS f_number,
 CASE kind WHEN 0 THEN round(1e0 / (d % 7 + 1), 6) END AS exposure_time_s, CASE kind WHEN 0 THEN 50 * (d % 6 + 1) END::INT AS iso, CASE kind WHEN 0 THEN ['', 'OpcodeList1', 'OpcodeList1,OpcodeList2', 'OpcodeList1,OpcodeList2,OpcodeList3'][d % 4 + 1] ELSE '' END AS corrections, CASE kind WHEN 0 THEN d % 4 > 0 END AS corrections_present, true AS ranged FROM f""",
    "folder_inputs": """WITH f AS (SELECT doc_id, '/shots/' || doc_id // 16 || '/' AS folder, '/shots/' || doc_id // 16 || '/frame_' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.dng' WHEN 1 THEN '.TIF' WHEN 2 THEN '.tiff' END AS path FROM documents WHERE doc_id % 6 < 3)
SELECT doc_id, path, folder, (row_number() OVER (PARTITION BY folder ORDER BY path) - 1)::INT AS input_index, CASE WHEN doc_id % 6 = 0 AND doc_id % 4 < 2 THEN 'cfa' ELSE 'rgb' END AS source_kind FROM f""",
    "extension_dispatch": """WITH f AS (SELECT doc_id, 'frame_' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.dng' WHEN 1 THEN '.TIF' WHEN 2 THEN '.tiff' WHEN 3 THEN '.nef' WHEN 4 THEN '.jpg' ELSE '' END AS path FROM documents), e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension FROM f)
SELECT doc_id, path, extension, CASE WHEN extension IN ('tif', 'tiff') THEN 'tiff' WHEN extension IN ('dng', 'nef') THEN 'raw' ELSE 'unsupported' END AS decoder, extension IN ('dng', 'tif', 'tiff') AS in_folder FROM e""",
    "metadata_inspect": f"""WITH f AS (SELECT doc_id, doc_id % 6 = 0 AS dng, doc_id % 4 AS k FROM documents)
SELECT doc_id, CASE WHEN dng THEN k > 0 END AS corrections_present, {names(("dng AND k >= 1", "OpcodeList1"), ("dng AND k >= 2", "OpcodeList2"), ("dng AND k >= 3", "OpcodeList3"))} AS detail,
CASE WHEN doc_id % 7 = 0 THEN 'body lens ' || doc_id % 2 WHEN doc_id % 3 = 1 THEN 'lens ' || doc_id % 5 WHEN doc_id % 9 > 2 THEN 'catalogue lens ' || doc_id % 9 END AS lens_model,
CASE WHEN doc_id % 10 > 1 THEN round((doc_id % 10) * 1.4e0, 6) END AS f_number, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 5 + 1) * 100 ELSE (doc_id % 6 + 1) * 50 END AS iso, CASE WHEN NOT dng THEN 'unknown' WHEN k > 0 THEN 'present' ELSE 'absent' END AS provenance FROM f""",
}
SQL = {name: nudged(sql) for name, sql in _SQL.items()}
