"""The plate queries in DuckDB's SQL, each a selection from common table expressions."""

from __future__ import annotations

from ..functions.text import ARABIC_DIGITS, FOLD_FROM, FOLD_TO, LETTERS, LOOKALIKES
from ..operators.boxes import FIELD_RENDERINGS, WHOLE_RENDERINGS

# The grammar of plates.
STANDARD = rf"^([^\-\s]{{1,5}})-([{LETTERS}])-([^\-\s]{{1,2}})$"
TEMPORARY = r"^([^\-\s]{5,6})-?WW$"

_N = "CAST(10000 + (group_id * 7919) % 90000 AS VARCHAR)"
_L, _R = "substr('أبدهوط', CAST(group_id % 6 + 1 AS INT), 1)", "CAST(group_id % 89 + 1 AS VARCHAR)"
_TRUE = f"CASE WHEN group_id % 10 = 9 THEN {_N} || ' WW' ELSE {_N} || '-' || {_L} || '-' || {_R} END"


def _repair(group: str) -> str:
    return f"CASE WHEN regexp_full_match(translate({group}, '{LOOKALIKES[0]}', '{LOOKALIKES[1]}'), '\\p{{Nd}}+') THEN translate({group}, '{LOOKALIKES[0]}', '{LOOKALIKES[1]}') END"


def _normal(raw: str) -> str:
    folded = f"upper(translate(regexp_replace(coalesce({raw}, ''), '[\\p{{C}}\\p{{M}}]', '', 'g'), '{FOLD_FROM}', '{FOLD_TO}'))"
    return f"trim(regexp_replace(regexp_replace({folded}, '\\s+', ' ', 'g'), '-{{2,}}', '-', 'g'), ' -')"


def _iou(a: str, b: str) -> str:
    inter = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    area = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
    return f"coalesce(CAST({inter} AS DOUBLE) / nullif({area.format(a)} + {area.format(b)} - {inter}, 0), 0)"


def _int(e: str) -> str:
    return f"CAST(trunc({e}) AS INT)"


_P = "CAST(0.08 AS DOUBLE)"
_WEIGHT = "round(sum(greatest(confidence, CAST(0.01 AS DOUBLE))), 6)"
_SPACED = f"trim(regexp_replace(regexp_replace(regexp_replace(normal_text, '\\s*([{LETTERS}])\\s*', '-\\1-', 'g'), '-{{2,}}', '-', 'g'), '\\s*-\\s*', '-', 'g'), ' -')"
_WON = "SELECT photo_id, det_seq, arg_min(text, (-weight, first_seq)) AS text, max(weight) AS score FROM {0} GROUP BY 1, 2"
_DISTORTED = f"""CASE WHEN m <= 3 THEN t WHEN m = 4 THEN translate(t, '0123456789', '{ARABIC_DIGITS}') WHEN m = 5 THEN replace(t, '-', ' ')
        WHEN m = 6 THEN replace(replace(t, '-', ''), ' ', '') WHEN m = 7 THEN replace(t, '-', 'ـ') WHEN m = 8 THEN translate(t, '01', 'OI') WHEN m = 9 THEN '1' || substr(t, 2)
        WHEN m = 10 THEN 'hello world' ELSE replace(t, 'أ', 'ا') END"""
_TALL = "CAST(h AS DOUBLE) >= plate_h * CAST(0.30 AS DOUBLE) AND h <= plate_h * CAST(0.95 AS DOUBLE) AND w <= plate_w * CAST(0.30 AS DOUBLE) AND w >= 2 AND area >= 20 AND CAST(w AS DOUBLE) / h < CAST(0.22 AS DOUBLE)"
_GLYPH = "area >= 8 AND y > 1 AND y + h < plate_h - 1 AND NOT (w > plate_w * CAST(0.85 AS DOUBLE) AND h < plate_h * CAST(0.40 AS DOUBLE))"
_SMALL = "b.w < plate_w * CAST(0.4 AS DOUBLE) OR b.h < plate_h * CAST(0.3 AS DOUBLE)"
_SOUND = "n_bars >= 2 AND left_cut >= plate_w * CAST(0.03 AS DOUBLE) AND right_cut <= plate_w - plate_w * CAST(0.03 AS DOUBLE) AND right_cut - left_cut >= plate_w * CAST(0.03 AS DOUBLE)"
_FIELDS = ("digits", "letter", "region")
_names = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"

def _cut_steps(p: str, components: str) -> dict[str, str]:
    """Bars, their outermost ones and the cuts of each crop, as steps whose names begin with p."""
    return {
        f"{p}bars": f"SELECT * FROM {components} WHERE {_TALL}",
        f"{p}ends": f"SELECT crop_id, min((x, w)) AS a, max((x, w)) AS b, count(*) AS n FROM {p}bars GROUP BY 1",
        f"{p}cut0": f"""SELECT crop_id, plate_w, plate_h, CAST(coalesce(n, 0) AS INT) AS n_bars, a[1] + a[2] // 2 AS left_cut, b[1] + b[2] // 2 AS right_cut, a[2] AS aw, b[2] AS bw
        FROM (SELECT DISTINCT crop_id, plate_w, plate_h FROM {components}) LEFT JOIN {p}ends USING (crop_id)""",
        f"{p}cut1": f"""SELECT crop_id, plate_w, plate_h, n_bars, CASE WHEN {_SOUND} THEN 0 END AS digits_start, CASE WHEN {_SOUND} THEN greatest(0, left_cut - aw) END AS digits_end,
        CASE WHEN {_SOUND} THEN least(left_cut + aw, plate_w) END AS letter_start, CASE WHEN {_SOUND} THEN CASE WHEN right_cut - bw < 0 THEN greatest(plate_w + right_cut - bw, 0) ELSE least(right_cut - bw, plate_w) END END AS letter_end,
        CASE WHEN {_SOUND} THEN least(right_cut + bw, plate_w) END AS region_start, CASE WHEN {_SOUND} THEN plate_w END AS region_end FROM {p}cut0""",
        f"{p}cuts": f"SELECT *, coalesce(digits_end > digits_start, false) AND coalesce(letter_end > letter_start, false) AND coalesce(region_end > region_start, false) AS is_complete FROM {p}cut1",
    }


def _parse_steps(p: str, readings: str) -> dict[str, str]:
    """Canonical texts of readings and the plates in them."""
    return {
        f"{p}normal": f"SELECT *, {_normal('raw_text')} AS normal_text FROM {readings}",
        f"{p}spaced": f"SELECT *, {_SPACED} AS s, replace(normal_text, ' ', '') AS u FROM {p}normal",
        f"{p}parts": f"""SELECT *, {_repair(f"regexp_extract(s, '{STANDARD}', 1)")} AS d, regexp_extract(s, '{STANDARD}', 2) AS l, {_repair(f"regexp_extract(s, '{STANDARD}', 3)")} AS g,
        regexp_matches(s, '{STANDARD}') AS standard, {_repair(f"regexp_extract(u, '{TEMPORARY}', 1)")} AS tmp FROM {p}spaced""",
        f"{p}parsed0": f"""SELECT * EXCLUDE (s, u, d, l, g, standard, tmp), CASE WHEN standard THEN CASE WHEN d IS NOT NULL AND g IS NOT NULL THEN d END ELSE tmp END AS digits,
        CASE WHEN standard AND d IS NOT NULL AND g IS NOT NULL THEN l END AS letter, CASE WHEN standard AND d IS NOT NULL AND g IS NOT NULL THEN g END AS region FROM {p}parts""",
        f"{p}parsed": f"SELECT *, CASE WHEN digits IS NOT NULL THEN letter IS NULL END AS is_temporary, CASE WHEN digits IS NULL THEN NULL WHEN letter IS NULL THEN digits || ' WW' ELSE digits || '-' || letter || '-' || region END AS plate_text FROM {p}parsed0",
    }


def _read_steps(p: str, base: str) -> dict[str, str]:
    """Votes that count and one reading for each detection."""
    return {
        f"{p}routed": f"""SELECT photo_id, det_index, true AS segmented, digits, letter, region, f_text AS text, f_weight AS weight, 0 AS first_seq, confidence FROM {base} WHERE cut AND f_text IS NOT NULL
        UNION ALL SELECT r.photo_id, r.det_index, r.cut AND w.text IS NULL, CASE WHEN cut THEN coalesce(digits, '?') END, CASE WHEN cut THEN coalesce(letter, '?') END, CASE WHEN cut THEN coalesce(region, '?') END,
          w.text, w.weight, coalesce(w.first_seq, 0), r.confidence FROM {base} r LEFT JOIN whole_votes w ON w.photo_id = r.photo_id AND w.det_seq = r.det_seq WHERE NOT (cut AND f_text IS NOT NULL)""",
        f"{p}read0": f"SELECT photo_id, det_index, segmented, digits, letter, region, confidence, arg_min(text, (-weight, first_seq)) AS plate_text, max(weight) AS weight FROM {p}routed GROUP BY 1, 2, 3, 4, 5, 6, 7",
        f"{p}read": f"SELECT photo_id, det_index, segmented, digits, letter, region, plate_text, coalesce(plate_text, 'unreadable') AS text, round(coalesce(weight * confidence, 0), 12) AS score, confidence AS detector_confidence FROM {p}read0",
    }


_ASKED = f"{len(FIELD_RENDERINGS)} * (" + " + ".join(f"CASE WHEN least({f}_end - {f}_start, plate_h) >= 3 THEN 1 ELSE 0 END" for f in _FIELDS) + ")"

_STEPS = {
    "photos": """SELECT o_orderkey AS photo_id, o_custkey AS group_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS position,
        CAST(640 + (o_orderkey % 3) * 320 AS INT) AS img_w, CAST(480 + (o_orderkey % 3) * 120 AS INT) AS img_h,
        '/cam' || (o_custkey % 7) || '/img_' || (o_orderkey % 1000) || (['.jpg', '.jpeg', '.png', '.webp', '.txt'])[o_orderkey % 5 + 1] AS path FROM orders""",
    "lines": "SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS det_seq FROM lineitem",
    "raw_boxes": """SELECT photo_id, det_seq, x1, y1, x1 + 70 + l_linenumber AS x2, y1 + 25 AS y2, confidence FROM (
        SELECT l_orderkey AS photo_id, det_seq, l_linenumber, CAST((l_partkey % 3) * 190 + (l_suppkey % 5) * 7 - 4 AS DOUBLE) AS x1, CAST((l_partkey % 2) * 6 + (l_suppkey % 3) - 1 AS DOUBLE) AS y1, l_quantity / CAST(64 AS DOUBLE) AS confidence FROM lines)""",
    "owned": """SELECT *, CASE WHEN det_seq > 1 AND l_suppkey % 4 = 0 THEN owner + 1 ELSE owner END AS shown
        FROM lines JOIN (SELECT o_orderkey, o_custkey AS owner FROM orders) ON o_orderkey = l_orderkey""",
    "readings": f"""SELECT photo_id, owner AS group_id, reading_seq, {_DISTORTED} AS raw_text, confidence FROM (
        SELECT l_orderkey AS photo_id, owner, owner AS group_id, det_seq AS reading_seq, l_partkey % 12 AS m, {_TRUE} AS t, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity / CAST(64 AS DOUBLE) END AS confidence FROM owned)""",
    "whole_readings": f"""SELECT photo_id, det_seq, owner AS group_id, reading_seq, restricted, {_DISTORTED} AS raw_text, confidence FROM (
        SELECT photo_id, det_seq, owner, reading_seq, reading_seq <> 2 AS restricted, m, {_TRUE} AS t, confidence FROM (
        SELECT l_orderkey AS photo_id, det_seq, owner, shown AS group_id, reading_seq, (l_partkey + 5 * reading_seq) % 12 AS m, CASE WHEN l_linenumber = 7 THEN 0 ELSE ((l_quantity + 7 * reading_seq) % 50) / CAST(64 AS DOUBLE) END AS confidence
        FROM owned, (SELECT CAST(unnest(range(1, 4)) AS INT) AS reading_seq)))""",
    "field_readings": f"""SELECT photo_id, det_seq, owner AS group_id, field, variant_no, true AS restricted, CASE WHEN z <= 5 THEN t
        WHEN field = 'letter' THEN CASE z WHEN 6 THEN t || '1' WHEN 7 THEN 'ا' WHEN 8 THEN 'ب' ELSE '' END
        WHEN z = 6 THEN translate(t, '0123456789', '{ARABIC_DIGITS}')
        WHEN field = 'digits' THEN CASE z WHEN 7 THEN substr(t, 1, 4) || 'W' WHEN 8 THEN '1' || substr(t, 2) ELSE t || '1' END
        ELSE CASE z WHEN 7 THEN 'X' WHEN 8 THEN '7' ELSE '123' END END AS raw_text, confidence FROM (
        SELECT photo_id, det_seq, owner, field, variant_no, z, confidence, CASE field WHEN 'digits' THEN {_N} WHEN 'region' THEN {_R} ELSE CASE WHEN group_id % 10 = 9 THEN '' ELSE {_L} END END AS t FROM (
        SELECT l_orderkey AS photo_id, det_seq, owner, shown AS group_id, field, variant_no, (l_partkey + 7 * variant_no) % 10 AS z, ((l_quantity + 3 * variant_no) % 50) / CAST(64 AS DOUBLE) AS confidence
        FROM owned, (SELECT unnest({_names(_FIELDS)}) AS field), (SELECT CAST(unnest(range(1, 6)) AS INT) AS variant_no)))""",
    "pooled": """SELECT photo_id, det_seq, 'fields' AS source, field, variant_no AS seq, restricted, raw_text, confidence FROM field_readings
        UNION ALL SELECT photo_id, det_seq, 'whole', 'whole', reading_seq, restricted, raw_text, confidence FROM whole_readings""",
    "components": """SELECT *, w * h AS area FROM (SELECT l_orderkey AS crop_id, det_seq AS comp_id, 420 AS plate_w, 150 AS plate_h,
        CAST((l_partkey * 13 + l_linenumber * 29) % 400 AS INT) AS x, CAST((l_suppkey * 11) % 60 AS INT) AS y, CAST(1 + l_suppkey % 20 AS INT) AS w, CAST(1 + (l_partkey * 7) % 146 AS INT) AS h FROM lines)""",
    "crop_components": """SELECT *, w * h AS area FROM (SELECT l_orderkey * 1000 + crop AS crop_id, det_seq AS comp_id, 420 AS plate_w, 150 AS plate_h,
        CAST((l_partkey * 13 + l_linenumber * 29 + 17 * (crop - 1)) % 400 AS INT) AS x, CAST((l_suppkey * 11) % 60 AS INT) AS y, CAST(1 + l_suppkey % 20 AS INT) AS w, CAST(1 + (l_partkey * 7) % 146 AS INT) AS h
        FROM (SELECT *, unnest(range(1, n + 1)) AS crop FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lines)))""",
    "levels": "SELECT l_returnflag AS grp, CAST(l_quantity * 5 AS INT) AS level FROM lineitem",
    "missing": "SELECT photo_id, group_id, path FROM photos WHERE photo_id % 11 = 0",
    "confident": "SELECT * FROM raw_boxes WHERE confidence > CAST(0.25 AS DOUBLE)",
    "grown": f"""SELECT photo_id, det_seq, greatest(0, {_int(f'x1 - (x2 - x1) * {_P}')}) AS x1, greatest(0, {_int(f'y1 - (y2 - y1) * {_P}')}) AS y1,
        least(img_w, {_int(f'x2 + (x2 - x1) * {_P}')}) AS x2, least(img_h, {_int(f'y2 + (y2 - y1) * {_P}')}) AS y2, confidence FROM raw_boxes JOIN photos USING (photo_id)""",
    "padded": "SELECT * FROM grown WHERE confidence > CAST(0.25 AS DOUBLE) AND x2 > x1 AND y2 > y1",
    "kept": f"""SELECT photo_id, unnest(list_reduce(list_transform(l, lambda i: [i]), lambda acc, i: CASE WHEN len(list_filter(acc, lambda k: {_iou('k', 'i[1]')} >= CAST(0.6 AS DOUBLE))) = 0 THEN list_concat(acc, i) ELSE acc END), recursive := true)
        FROM (SELECT photo_id, list({{'det_seq': det_seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'confidence': confidence}} ORDER BY confidence DESC, det_seq) AS l FROM padded GROUP BY 1)""",
    "found": "SELECT *, CAST(row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, det_seq) AS INT) AS det_index FROM kept",
    **_cut_steps("", "components"),
    **_cut_steps("crop_", "crop_components"),
    "frames": "SELECT crop_id, field, CAST(greatest(1, trunc(w * (CAST(160 AS DOUBLE) / plate_h))) AS INT) + 80 AS frame_w, 240 AS frame_h FROM ("
    + " UNION ALL ".join(f"SELECT crop_id, '{f}' AS field, {f}_end - {f}_start AS w, plate_h FROM cuts WHERE is_complete" for f in _FIELDS)
    + ") WHERE least(w, plate_h) >= 3 UNION ALL SELECT crop_id, 'whole', plate_w * 4, plate_h * 4 FROM cuts UNION ALL SELECT crop_id, 'working', plate_w * 6, plate_h * 6 FROM cuts",
    "tasks_fields": f"SELECT crop_id, field, CAST(k AS INT) AS variant_no, ({_names(FIELD_RENDERINGS)})[k] AS rendering FROM frames, (SELECT unnest(range(1, 6)) AS k) WHERE field NOT IN ('whole', 'working')",
    "tasks_whole": f"SELECT crop_id, CAST(k AS INT) AS variant_no, ({_names(WHOLE_RENDERINGS)})[k] AS rendering, restricted FROM frames, (SELECT unnest(range(1, 8)) AS k), (SELECT unnest([true, false]) AS restricted) WHERE field = 'whole'",
    "tasks": """SELECT crop_id, field, variant_no, rendering, CASE field WHEN 'letter' THEN 'letters' ELSE 'digits' END AS alphabet FROM tasks_fields
        UNION ALL SELECT crop_id, 'whole', variant_no, rendering, CASE WHEN restricted THEN 'both' ELSE 'any' END FROM tasks_whole""",
    "echoed": f"""SELECT *, 1 AS reading_seq, CASE field WHEN 'digits' THEN d WHEN 'letter' THEN l WHEN 'region' THEN g ELSE CASE WHEN alphabet = 'any' THEN d || '-' || l || '-' || g ELSE d || l || g END END AS raw_text, variant_no / CAST(8 AS DOUBLE) AS confidence FROM (
        SELECT *, CAST(10000 + crop_id % 90000 AS VARCHAR) AS d, substr('{LETTERS}', CAST(crop_id % 6 + 1 AS INT), 1) AS l, CAST(1 + crop_id % 89 AS VARCHAR) AS g FROM tasks WHERE NOT (crop_id % 11 = 0 AND variant_no = 1))""",
    **_parse_steps("", "readings"),
    **_parse_steps("whole_", "whole_readings"),
    "fields": f"SELECT *, {_normal('raw_text')} AS text FROM field_readings",
    "digit_votes": f"SELECT photo_id, det_seq, text, {_WEIGHT} AS weight, min(variant_no) AS first_seq FROM fields WHERE field = 'digits' AND regexp_full_match(text, '\\p{{Nd}}{{1,5}}') GROUP BY 1, 2, 3",
    "region_votes": f"SELECT photo_id, det_seq, text, {_WEIGHT} AS weight, min(variant_no) AS first_seq FROM fields WHERE field = 'region' AND regexp_full_match(text, '\\p{{Nd}}{{1,2}}') GROUP BY 1, 2, 3",
    "letter_votes": f"""SELECT photo_id, det_seq, c AS text, {_WEIGHT} AS weight, min((variant_no, k)) AS first_seq FROM (
        SELECT photo_id, det_seq, confidence, variant_no, unnest(string_split(text, '')) AS c, unnest(range(len(text))) AS k FROM fields WHERE field = 'letter') WHERE c <> '' AND contains('{LETTERS}', c) GROUP BY 1, 2, 3""",
    "digits_won": _WON.format("digit_votes"),
    "region_won": _WON.format("region_votes"),
    "letter_won": _WON.format("letter_votes"),
    "whole_votes": f"SELECT photo_id, det_seq, plate_text AS text, {_WEIGHT} AS weight, min(reading_seq) AS first_seq FROM whole_parsed WHERE plate_text IS NOT NULL GROUP BY 1, 2, 3",
    "composed": """SELECT photo_id, det_seq, d.text AS digits, l.text AS letter, r.text AS region, CASE WHEN d.text IS NOT NULL AND l.text IS NOT NULL AND r.text IS NOT NULL THEN d.text || '-' || l.text || '-' || r.text END AS plate_text,
        CASE WHEN d.text IS NOT NULL AND l.text IS NOT NULL AND r.text IS NOT NULL THEN round(d.score + l.score + r.score, 6) ELSE 0 END AS score
        FROM digits_won d FULL JOIN letter_won l USING (photo_id, det_seq) FULL JOIN region_won r USING (photo_id, det_seq)""",
    "routed0": """SELECT b.photo_id, b.det_seq, b.det_index, b.confidence, coalesce(c.is_complete, false) AS cut, f.digits, f.letter, f.region, f.plate_text AS f_text, f.score AS f_weight
        FROM found b LEFT JOIN crop_cuts c ON c.crop_id = b.photo_id * 1000 + b.det_seq LEFT JOIN composed f ON f.photo_id = b.photo_id AND f.det_seq = b.det_seq""",
    **_read_steps("", "routed0"),
    "staged0": "SELECT r.photo_id, r.det_seq, det_index, confidence, cut, "
    + ", ".join(f"CASE WHEN least({f}_end - {f}_start, plate_h) >= 3 THEN {f} END AS {f}, least({f}_end - {f}_start, plate_h) >= 3 AS {f}_asked" for f in _FIELDS)
    + f", CASE WHEN {_ASKED} = 15 THEN f_text END AS f_text, f_weight, CASE WHEN cut THEN CAST({_ASKED} AS BIGINT) ELSE 0 END AS asked FROM routed0 r LEFT JOIN crop_cuts c ON c.crop_id = r.photo_id * 1000 + r.det_seq",
    **_read_steps("staged_", "staged0"),
    "best": """SELECT photo_id, det_index, plate_text, text, score FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY plate_text IS NULL, CASE WHEN plate_text IS NOT NULL THEN -score END, CASE WHEN plate_text IS NOT NULL THEN -detector_confidence END, det_index) AS k FROM read) WHERE k = 1""",
    "results": """SELECT p.photo_id, p.group_id, p.position, coalesce(n.n, 0) AS n_readings, r.plate_text, r.text FROM photos p LEFT JOIN best r USING (photo_id) LEFT JOIN (SELECT photo_id, count(*) AS n FROM read GROUP BY 1) n USING (photo_id)""",
    "group_votes": """SELECT group_id, text, round(sum(weight * confidence), 12) AS weight, min((position, det_index, first_seq)) AS first_seq FROM routed JOIN photos USING (photo_id) WHERE text IS NOT NULL GROUP BY 1, 2""",
    "plates": """SELECT group_id, plate, score FROM (SELECT DISTINCT group_id FROM photos) LEFT JOIN (
        SELECT group_id, arg_min(text, (-weight, first_seq)) AS plate, max(weight) AS score FROM group_votes GROUP BY 1) USING (group_id)""",
    "agreed": "SELECT group_id, plate, CAST(sum(CASE WHEN plate_text = plate THEN 1 ELSE 0 END) AS BIGINT) AS agreeing, count(*) AS n_images FROM results JOIN plates USING (group_id) GROUP BY 1, 2",
    "report": """SELECT group_id, position, path, det_index, text, round(detector_confidence, 4) AS detector_confidence, x1, y1, x2, y2, CAST(round(CAST(score AS DECIMAL(24, 12)), 4) AS DOUBLE) AS score, CASE WHEN segmented THEN 'fields' ELSE 'whole_plate' END AS method, digits, letter, region
        FROM read JOIN photos USING (photo_id) JOIN (SELECT photo_id, det_index, x1, y1, x2, y2 FROM found) USING (photo_id, det_index)""",
}
_WITH = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in _STEPS.items())

_ECHOED_TASKS = f"""SELECT photo_id, det_seq, field, CAST(k AS INT) AS variant_no, ({_names(FIELD_RENDERINGS)})[k] AS rendering, CASE field WHEN 'letter' THEN 'letters' ELSE 'digits' END AS alphabet
        FROM staged0, (SELECT unnest({_names(_FIELDS)}) AS field), (SELECT unnest(range(1, 6)) AS k) WHERE cut AND CASE field WHEN 'digits' THEN digits_asked WHEN 'letter' THEN letter_asked ELSE region_asked END
        UNION ALL SELECT photo_id, det_seq, 'whole', CAST(k AS INT), ({_names(WHOLE_RENDERINGS)})[k], alphabet FROM staged0, (SELECT unnest(range(1, 8)) AS k), (SELECT unnest(['both', 'any']) AS alphabet) WHERE asked < 15"""
_SHOWN = ", ".join(f"CASE WHEN cut THEN CASE WHEN {f}_asked THEN {c} ELSE '?' END END AS {f}" for f, c in zip(_FIELDS, "dlg", strict=True))

_SELECT = {
    "photo_manifest": "SELECT photo_id, group_id, position, path FROM photos WHERE regexp_matches(path, '(?i)\\.(jpg|jpeg|png|bmp|webp)$')",
    "missing_photos": "SELECT * FROM missing",
    "confident_boxes": "SELECT photo_id, det_seq, confidence FROM confident",
    "padded_boxes": "SELECT * FROM padded",
    "overlap_pairs": f"SELECT a.photo_id, a.det_seq AS a_seq, b.det_seq AS b_seq, round({_iou('a', 'b')}, 6) AS iou FROM padded a JOIN padded b ON a.photo_id = b.photo_id AND a.det_seq < b.det_seq WHERE {_iou('a', 'b')} >= CAST(0.6 AS DOUBLE)",
    "dedup_boxes": "SELECT * FROM kept",
    "detection_index": "SELECT photo_id, det_seq, det_index FROM found",
    "crop_manifest": "SELECT photo_id, det_index, printf('%02d_%s_plate%d.jpg', position, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1), det_index) AS name, x1, y1, x2, y2, x2 - x1 AS crop_w, y2 - y1 AS crop_h FROM found JOIN photos USING (photo_id)",
    "separator_bars": "SELECT crop_id, comp_id, x, w FROM bars",
    "field_cuts": "SELECT * FROM cuts",
    "ink_extent": f"""SELECT crop_id, CASE WHEN inked THEN a ELSE 0 END AS y0, CASE WHEN inked THEN b ELSE plate_h END AS y1 FROM (
        SELECT *, top IS NOT NULL AND b - a >= 3 AS inked FROM (SELECT *, greatest(0, top - pad) AS a, least(plate_h, low + pad) AS b FROM (
        SELECT *, greatest(2, {_int('(low - top) * CAST(0.12 AS DOUBLE)')}) AS pad FROM (
        SELECT crop_id, plate_h, min(CASE WHEN {_GLYPH} THEN y END) AS top, max(CASE WHEN {_GLYPH} THEN y + h END) AS low FROM components GROUP BY 1, 2))))""",
    "plate_body": f"""SELECT crop_id, CASE WHEN {_SMALL} THEN 0 ELSE b.x END AS x, CASE WHEN {_SMALL} THEN 0 ELSE b.y END AS y, CASE WHEN {_SMALL} THEN plate_w ELSE b.w END AS w, CASE WHEN {_SMALL} THEN plate_h ELSE b.h END AS h FROM (
        SELECT crop_id, plate_w, plate_h, arg_max({{'x': x, 'y': y, 'w': w, 'h': h}}, (area, -comp_id)) AS b FROM components GROUP BY 1, 2, 3)""",
    "ocr_frame_size": "SELECT * FROM frames",
    "ocr_tasks_fields": "SELECT * FROM tasks_fields",
    "ocr_tasks_whole": "SELECT * FROM tasks_whole",
    "otsu_threshold": """SELECT grp, arg_max(level, (var, -level)) AS threshold, arg_max(CAST(w - w0 AS BIGINT), (var, -level)) AS n_above FROM (
        SELECT *, round(coalesce(w0 / w * ((w - w0) / w) * (s0 / w0 - (s - s0) / nullif(w - w0, 0)) * (s0 / w0 - (s - s0) / nullif(w - w0, 0)), 0), 6) AS var FROM (
        SELECT grp, level, CAST(sum(n) OVER (PARTITION BY grp ORDER BY level) AS DOUBLE) AS w0, CAST(sum(n * level) OVER (PARTITION BY grp ORDER BY level) AS DOUBLE) AS s0, CAST(sum(n) OVER (PARTITION BY grp) AS DOUBLE) AS w, CAST(sum(n * level) OVER (PARTITION BY grp) AS DOUBLE) AS s
        FROM (SELECT grp, level, count(*) AS n FROM levels GROUP BY 1, 2))) GROUP BY 1""",
    "clean_readings": "SELECT photo_id, det_seq, field, variant_no, trim(raw_text) AS raw_text FROM field_readings WHERE trim(raw_text) <> ''",
    "alphabet_violations": f"""SELECT field, restricted, count(*) AS n, CAST(sum(CAST(NOT regexp_full_match(raw_text, CASE field WHEN 'letter' THEN '[{LETTERS}]*' WHEN 'whole' THEN '[0-9{LETTERS}W]*' ELSE '[0-9W]*' END) AS INT)) AS BIGINT) AS n_violations
        FROM pooled GROUP BY 1, 2""",
    "normalize_text": "SELECT photo_id, reading_seq, normal_text FROM normal",
    "repair_digits": f"SELECT photo_id, det_seq, field, variant_no, {_repair('raw_text')} AS repaired FROM field_readings WHERE field <> 'letter'",
    "parse_plate": "SELECT photo_id, reading_seq, digits, letter, region, is_temporary, plate_text FROM parsed",
    "valid_plates": "SELECT photo_id, reading_seq, plate_text IS NOT NULL AS valid FROM parsed",
    "parse_rejects": f"SELECT CASE WHEN normal_text = '' THEN 'empty' WHEN NOT regexp_matches(normal_text, '[{LETTERS}]|WW') THEN 'no letter' WHEN NOT regexp_matches(normal_text, '[0-9]') THEN 'no digits' ELSE 'grammar' END AS reason, count(*) AS n FROM parsed WHERE plate_text IS NULL GROUP BY 1",
    "pooled_readings": "SELECT * FROM pooled",
    "vote_digits": "SELECT * FROM digits_won",
    "vote_region": "SELECT * FROM region_won",
    "vote_letter": "SELECT * FROM letter_won",
    "vote_whole": "SELECT photo_id, det_seq, text, weight FROM whole_votes",
    "compose_fields": "SELECT * FROM composed",
    "plate_readings": "SELECT * FROM read",
    "photo_best": "SELECT * FROM best",
    "photo_results": "SELECT * FROM results",
    "group_votes": "SELECT group_id, text, weight FROM group_votes",
    "group_plate": "SELECT * FROM plates",
    "agreement": "SELECT * FROM agreed",
    "run_summary": """SELECT group_id, plate, agreeing, n_images, CASE WHEN n_missing > 0 THEN 2 WHEN plate IS NOT NULL THEN 0 ELSE 1 END AS status, CASE WHEN plate IS NOT NULL THEN 'Plate: ' || plate ELSE 'Plate: unreadable' END AS line,
        CASE WHEN plate IS NOT NULL AND n_images > 1 THEN 'Agreement: ' || agreeing || '/' || n_images || ' images' END AS agreement_line FROM agreed LEFT JOIN (SELECT group_id, count(*) AS n_missing FROM missing GROUP BY 1) USING (group_id)""",
    "activity_log": """SELECT photo_id, group_id, position, 1 AS line_no, 'Detecting plates in ' || regexp_extract(path, '([^/]+)$', 1) || '...' AS line FROM photos
        UNION ALL SELECT photo_id, group_id, position, coalesce(det_index, 1) + 1, CASE WHEN text IS NULL THEN '  no plate found in ' || regexp_extract(path, '([^/]+)$', 1)
          ELSE printf('  plate %d: %s [%s, detector %.2f]', det_index, text, CASE WHEN segmented THEN 'fields' ELSE 'whole plate' END, detector_confidence) END FROM photos LEFT JOIN read USING (photo_id)""",
    "plate_report_rows": "SELECT * FROM report",
    "plate_report_json": """SELECT group_id, CAST(to_json(struct_pack(plate := coalesce(plate, 'unreadable'), found := plate IS NOT NULL, images_agreeing := agreeing, images := images)) AS VARCHAR) AS document FROM agreed JOIN (
        SELECT group_id, list(struct_pack(path := path, plates := coalesce(plates, [])) ORDER BY position) AS images FROM photos LEFT JOIN (
        SELECT group_id, position, list(struct_pack(text := text, detector_confidence := detector_confidence, box := [x1, y1, x2, y2], score := score, method := method, fields := CASE WHEN digits IS NOT NULL THEN struct_pack(digits := digits, letter := letter, region := region) END) ORDER BY det_index) AS plates
        FROM report GROUP BY 1, 2) USING (group_id, position) GROUP BY 1) USING (group_id)""",
    "votes_map": """SELECT group_id, '{' || string_agg('"' || text || '":"' || CAST(CAST(weight AS DECIMAL(20, 6)) AS VARCHAR) || '"', ',' ORDER BY text) || '}' AS votes FROM group_votes GROUP BY 1""",
    "recogniser_stage": "SELECT crop_id, field, variant_no, rendering, alphabet, reading_seq, raw_text, confidence FROM echoed",
    "recogniser_errors": "SELECT 'ValueError: no image' AS error, count(*) AS n FROM tasks WHERE crop_id % 11 = 0 AND variant_no = 1 HAVING count(*) > 0",
    "recogniser_plates": """SELECT crop_id AS photo_id, max(CASE WHEN field = 'digits' THEN raw_text END) AS digits, max(CASE WHEN field = 'letter' THEN raw_text END) AS letter, max(CASE WHEN field = 'region' THEN raw_text END) AS region,
        CASE WHEN count(DISTINCT field) = 3 THEN max(CASE WHEN field = 'digits' THEN raw_text END) || '-' || max(CASE WHEN field = 'letter' THEN raw_text END) || '-' || max(CASE WHEN field = 'region' THEN raw_text END) END AS plate_text,
        CASE WHEN count(DISTINCT field) = 3 THEN round(sum(confidence), 6) ELSE 0 END AS score FROM echoed WHERE field <> 'whole' GROUP BY 1""",
    "detector_stage": f"""SELECT photo_id, 1 AS det_seq, x1, y1, x2, y2, CAST(0.5 AS DOUBLE) AS confidence, 1 AS det_index FROM (SELECT photo_id,
        greatest(0, {_int(f'img_w / 4 - img_w / 2 * {_P}')}) AS x1, greatest(0, {_int(f'img_h / 4 - img_h / 2 * {_P}')}) AS y1, least(img_w, {_int(f'img_w * 3 / 4 + img_w / 2 * {_P}')}) AS x2, least(img_h, {_int(f'img_h * 3 / 4 + img_h / 2 * {_P}')}) AS y2 FROM photos)""",
    "staged_readings": "SELECT * FROM staged_read",
    "staged_calls": "SELECT photo_id, det_index, asked AS field_calls, w AS whole_calls, asked + w AS calls FROM (SELECT *, CAST(CASE WHEN cut AND f_text IS NOT NULL THEN 0 ELSE 14 END AS BIGINT) AS w FROM staged0)",
    "staged_quarantine": f"SELECT *, 'ValueError: no image' AS error FROM ({_ECHOED_TASKS}) WHERE (photo_id * 1000 + det_seq + 3) % 11 = 0 AND variant_no = 1",
    "staged_recogniser": f"""SELECT photo_id, det_index, asked = 15 AS segmented, {_SHOWN}, d || '-' || l || '-' || g AS plate_text, d || '-' || l || '-' || g AS text,
        round((CASE WHEN asked = 15 THEN 3 * (15 - lost) ELSE 2 * (28 - lost) END) / CAST(8 AS DOUBLE) * confidence, 12) AS score, confidence AS detector_confidence
        FROM (SELECT *, CAST(10000 + crop % 90000 AS VARCHAR) AS d, substr('{LETTERS}', CAST(crop % 6 + 1 AS INT), 1) AS l, CAST(1 + crop % 89 AS VARCHAR) AS g, CASE WHEN crop % 11 = 0 THEN 1 ELSE 0 END AS lost
          FROM (SELECT *, photo_id * 1000 + det_seq + 3 AS crop FROM staged0))""",
    "preview_pick": "SELECT group_id, arg_min(photo_id, position) AS photo_id, arg_min(text, position) AS text FROM results WHERE n_readings > 0 GROUP BY 1",
}
_SELECT |= {"crowded_pairs": _SELECT["overlap_pairs"], "crowded_boxes": _SELECT["dedup_boxes"]}
_SELECT["running_plates"] = "SELECT group_id, plate, score, agreeing, n_images FROM agreed JOIN plates USING (group_id, plate) UNION ALL SELECT group_id, plate, NULL, agreeing, n_images FROM agreed WHERE plate IS NULL"
_SELECT["written_documents"] = _SELECT["plate_report_json"]
_SELECT["written_logs"] = f"""SELECT group_id, lines || chr(10) || line || chr(10) || coalesce(agreement_line || chr(10), '') AS log FROM ({_SELECT["run_summary"]}) JOIN (
        SELECT group_id, string_agg(line || chr(10), '' ORDER BY position, line_no) AS lines FROM ({_SELECT["activity_log"]}) GROUP BY 1) USING (group_id)"""
QUERIES_SQL = {name: f"{_WITH}\n{body}" for name, body in _SELECT.items()}
