"""The registered queries in DuckDB SQL over the same tables."""

from __future__ import annotations

BUCKET = "(('0x' || substr(md5({key}), 1, 8))::ubigint % 100)"


def split(key: str) -> str:
    bucket = BUCKET.format(key=key)
    return f"CASE WHEN {bucket} < 70 THEN 'train' WHEN {bucket} < 90 THEN 'val' ELSE 'test' END"


CLASS = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END"
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
ZONE = (
    "CASE WHEN (x1 + x2) / 2 < 1280 * 0.33 THEN 'Lateral izquierdo' "
    "WHEN (x1 + x2) / 2 > 1280 * 0.66 THEN 'Lateral derecho' ELSE 'Zona frontal' END"
)

CAPTURES = """
captures AS (
  SELECT event_id // 4 AS image_id, arg_min(ts, event_id) AS captured_at,
         arg_min(user_id, event_id) AS station_id, arg_min(value, event_id) AS first_value
  FROM events GROUP BY 1
)"""
BOXES = f"""
boxes AS (
  SELECT event_id // 4 AS image_id, CAST(event_id % 4 AS INTEGER) AS box_no, {CLASS} AS class_id,
         least(value / 100, 0.99) AS conf, {K} / 100 * 1180 AS x1, 300.0 AS y1,
         {K} / 100 * 1180 + 100 AS x2, 400.0 AS y2
  FROM events WHERE event_type <> 'signup'
)"""
TRUTH = """
truth AS (
  SELECT image_id, box_no AS truth_no, class_id,
         x1 + (CAST(trunc(x1) AS BIGINT) * 7 + box_no * 13) % 60 AS x1, y1,
         x2 + (CAST(trunc(x1) AS BIGINT) * 7 + box_no * 13) % 60 AS x2, y2
  FROM boxes
)"""
VERDICTS = f"""
best AS (
  SELECT * FROM boxes WHERE conf >= 0.40
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, box_no) = 1
),
verdicts AS (
  SELECT c.image_id,
         CASE WHEN conf IS NULL THEN 'Aprobado' WHEN conf * 100 >= 70 THEN 'Defecto' ELSE 'Revisar' END AS status,
         CASE WHEN conf IS NULL THEN 'Sin defecto'
              ELSE ['mancha', 'rotura', 'agujero', 'variacion_color'][class_id + 1] END AS defect_type,
         CASE WHEN conf IS NULL THEN 90.0::DOUBLE ELSE round(conf * 100, 2) END AS confidence,
         CASE WHEN conf IS NULL THEN 'Centro' ELSE {ZONE} END AS zone,
         CASE WHEN conf IS NULL THEN 'clean' ELSE 'class_score' END AS confidence_kind
  FROM captures c LEFT JOIN best USING (image_id)
)"""
INSPECTIONS = """
identity AS (
  SELECT image_id, least(0.5 + first_value / 100, 0.99) AS similarity, similarity >= 0.72 AS identified,
         ['blusa_modelo_01', 'Blusa', 'Top corto'][station_id % 3 + 1] AS model_name
  FROM captures
),
inspections AS (
  SELECT image_id + 1 AS id,
         'INS-' || strftime(captured_at, '%H%M%S') || '-' || upper(substr(md5(image_id::VARCHAR), 1, 4)) AS code,
         strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS created_at,
         CASE WHEN identified THEN model_name ELSE 'Prenda no identificada' END AS garment_type,
         CASE WHEN identified THEN status ELSE 'Revisar' END AS status,
         CASE WHEN identified THEN defect_type ELSE 'Prenda no identificada' END AS defect_type,
         CAST(CAST(CASE WHEN identified THEN confidence ELSE round(similarity * 100, 2) END AS DECIMAL(5, 2)) AS DOUBLE) AS confidence,
         CASE WHEN identified THEN zone ELSE 'No aplica' END AS zone,
         CASE WHEN identified THEN 'results/result_' || image_id || '.jpg' END AS image_result,
         'Pendiente' AS human_validation,
         CASE WHEN identified THEN confidence_kind ELSE 'similarity' END AS confidence_kind,
         identified AS identity_identified, round(similarity, 4) AS identity_similarity
  FROM captures JOIN verdicts USING (image_id) JOIN identity USING (image_id)
)"""
RECORDS = "WITH " + ",".join([CAPTURES, BOXES, VERDICTS, INSPECTIONS])
VALIDATED = """,
newest AS (
  SELECT l_orderkey AS inspection_id,
         CASE l_returnflag WHEN 'R' THEN 'Correcto' WHEN 'A' THEN 'Incorrecto' ELSE 'Pendiente' END AS v
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC,
                             l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1
),
validated AS (
  SELECT i.* REPLACE (coalesce(v, human_validation) AS human_validation)
  FROM inspections i LEFT JOIN newest ON inspection_id = id
)"""
SHOWN = "id, code, created_at, garment_type, status, defect_type, confidence, zone"


def confusion(keys: str) -> str:
    lead = keys + ", " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{RECORDS}{VALIDATED},
cells AS (
  SELECT {lead}
    count(*) FILTER (status = 'Defecto' AND human_validation = 'Correcto') AS vp,
    count(*) FILTER (status = 'Defecto' AND human_validation = 'Incorrecto') AS fp,
    count(*) FILTER (status = 'Aprobado' AND human_validation = 'Correcto') AS vn,
    count(*) FILTER (status = 'Aprobado' AND human_validation = 'Incorrecto') AS fn,
    count(*) FILTER (status = 'Revisar' AND human_validation <> 'Pendiente') AS review,
    count(*) FILTER (human_validation = 'Pendiente') AS pending
  FROM validated {group}
)
SELECT *, round(vp / nullif(vp + fp, 0), 4) AS precision, round(vp / nullif(vp + fn, 0), 4) AS recall,
       round((vp + vn) / nullif(vp + fp + vn + fn, 0), 4) AS accuracy
FROM cells"""


STEM = "CAST(l_orderkey AS VARCHAR)"
LINES = f"""WITH lines AS (
  SELECT {split(STEM)} AS split, {STEM} AS stem, l_linenumber AS line_no,
         l_linenumber - 1 AS class_id, l_discount * 10 AS xc, l_tax * 10 AS yc, l_quantity / 50 AS w,
         l_discount AS h, l_quantity AS q
  FROM lineitem
),
checked AS (
  SELECT split, stem, line_no, unnest(list_filter(
    CASE WHEN q IN (17, 23) THEN [{{'rule': 'tokens', 'field': ''}}]
         WHEN q = 13 THEN [{{'rule': 'numeric', 'field': ''}}]
         ELSE [
      CASE WHEN class_id NOT IN (0, 1, 2, 3) THEN {{'rule': 'class', 'field': ''}} END,
      CASE WHEN q = 19 OR NOT (xc >= 0 AND xc <= 1) THEN {{'rule': 'range', 'field': 'x_center'}} END,
      CASE WHEN NOT (yc >= 0 AND yc <= 1) THEN {{'rule': 'range', 'field': 'y_center'}} END,
      CASE WHEN NOT (w >= 0 AND w <= 1) THEN {{'rule': 'range', 'field': 'width'}} END,
      CASE WHEN NOT (h >= 0 AND h <= 1) THEN {{'rule': 'range', 'field': 'height'}} END,
      CASE WHEN w <= 0 OR h <= 0 THEN {{'rule': 'size', 'field': ''}} END] END,
    lambda e: e IS NOT NULL)) AS e
  FROM lines
),
errors AS (SELECT split, stem, line_no, e.rule AS rule, e.field AS field FROM checked)"""
IMAGE_STEM = "CAST(o_orderkey AS VARCHAR)"
FILES = f"""WITH images AS (
  SELECT {split(IMAGE_STEM)} AS split, {IMAGE_STEM} AS stem, o_orderstatus FROM orders
),
marked AS (SELECT DISTINCT {split(STEM)} AS split, {STEM} AS stem FROM lineitem),
files AS (
  SELECT split, stem, true AS marked FROM marked
  UNION ALL
  SELECT split, stem, false FROM images
  WHERE o_orderstatus = 'F' AND stem NOT IN (SELECT stem FROM marked)
)"""

NAMES = """WITH names AS (
  SELECT event_id, ['blusa', 'top_corto', 'camisa_cropped'][user_id % 3 + 1] AS garment,
         CASE event_type WHEN 'click' THEN 'mancha' WHEN 'view' THEN 'rotura' WHEN 'purchase' THEN 'agujero'
              WHEN 'error' THEN 'variacion_color' ELSE 'sin_defecto' END AS defect,
         ts, substr(md5(event_id::VARCHAR), 1, 6) AS suffix,
         garment || '_' || defect || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || suffix || '.jpg' AS file_name
  FROM events
)"""


def slug(text: str) -> str:
    body = f"regexp_replace(lower(trim({text})), '[^a-z0-9áéíóúñ]+', '_', 'g')"
    return f"coalesce(nullif(trim({body}, '_'), ''), 'modelo_prenda')"


GAP = 6 * 3600 * 1_000_000
SEQUENCES = f"""WITH shots AS (
  SELECT event_id, user_id AS station_id, epoch_us(ts) AS ts_us FROM events
),
started AS (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {GAP} THEN 0 ELSE 1 END AS start
  FROM shots WINDOW w AS (PARTITION BY station_id ORDER BY ts_us, event_id)
),
numbered AS (
  SELECT event_id, station_id, ts_us,
         CAST(sum(start) OVER (PARTITION BY station_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
  FROM started
),
sequences AS (SELECT *, station_id || '-' || session AS sequence FROM numbered)"""

SIMILARITIES = """WITH items AS (
  SELECT vec_id, 'modelo_' || label AS model_name, embedding::DOUBLE[] AS e FROM embeddings
),
pairs AS (
  SELECT q.vec_id AS query_id, q.model_name AS own, g.model_name, list_dot_product(q.e, g.e) AS s
  FROM items q JOIN items g ON q.vec_id <> g.vec_id
),
best AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id, model_name ORDER BY s DESC) <= 3
),
likeness AS (
  SELECT query_id, own, model_name, avg(s) AS similarity FROM best GROUP BY ALL
)"""


def profiles(share: float, margin: float, low: float, high: float) -> str:
    return f""",
profiles AS (
  SELECT model_name, count(*) AS n, min(similarity) AS min_sim, avg(similarity) AS mean_sim,
         least(greatest(quantile_cont(similarity, {share}) - {margin}, {low}), {high}) AS threshold
  FROM likeness WHERE own = model_name GROUP BY 1 HAVING count(*) >= 10
)"""


CLOSED, OPEN = profiles(0.05, 0.04, 0.72, 0.90), profiles(0.5, 0.0, 0.10, 0.90)
IDENTIFY = """
SELECT query_id, similarity >= threshold AS identified,
       CASE WHEN similarity >= threshold THEN model_name END AS model_name,
       CASE WHEN similarity >= threshold THEN model_name ELSE 'prenda_no_identificada' END AS result,
       round(similarity, 4) AS similarity, round(threshold, 4) AS threshold
FROM likeness JOIN profiles USING (model_name)
QUALIFY row_number() OVER (PARTITION BY query_id
  ORDER BY similarity >= threshold DESC, similarity DESC, model_name DESC) = 1"""

DISTANCES = """WITH patches AS (
  SELECT vec_id AS patch_id, vec_id // 8 AS image_id, CAST(vec_id % 8 AS INTEGER) AS patch_no, embedding::DOUBLE[] AS e
  FROM embeddings
),
bank AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 8),
pairs AS (
  SELECT patch_id, image_id, patch_no, item_id, list_distance(p.e, b.e) AS distance
  FROM patches p JOIN bank b ON patch_id <> item_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY distance, item_id) AS r FROM pairs
)"""

SHAPED = "list_transform(embedding, lambda x, i: (x * pow(0.5::DOUBLE, i - 1))::FLOAT)::DOUBLE[]"

SCORES = """WITH scores AS (
  SELECT event_id AS image_id, event_type,
         CASE WHEN event_type IN ('signup', 'error') THEN 0.0::DOUBLE ELSE value / 100 END AS pred_score
  FROM events
)"""

SHOTS = """WITH RECURSIVE shots AS (
  SELECT event_id, user_id AS station_id, epoch_us(ts) AS ts_us, value,
         row_number() OVER w AS position, lag(value) OVER w AS previous
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""

OUTCOMES = f"""WITH RECURSIVE frames AS (
  SELECT event_id, user_id AS station_id, epoch_us(ts) AS ts_us, event_type <> 'error' AS readable,
         CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events
),
fold AS (
  SELECT DISTINCT station_id, 0::BIGINT AS position, NULL::BIGINT AS event_id, NULL::BIGINT AS ts_us, NULL::DOUBLE AS baseline,
         NULL::BIGINT AS last_us, NULL::BIGINT AS pending_us, NULL::DOUBLE AS pending, NULL::VARCHAR AS outcome, NULL::BIGINT AS trigger_us
  FROM frames
  UNION ALL
  SELECT station_id, position, event_id, ts_us,
         CASE kind WHEN 'captured' THEN NULL WHEN 'failed_read' THEN pending WHEN 'still' THEN value ELSE baseline END,
         CASE kind WHEN 'captured' THEN ts_us ELSE last_us END,
         CASE kind WHEN 'captured' THEN NULL WHEN 'failed_read' THEN NULL WHEN 'moved' THEN ts_us ELSE pending_us END,
         CASE kind WHEN 'captured' THEN NULL WHEN 'failed_read' THEN NULL WHEN 'moved' THEN value ELSE pending END,
         CASE WHEN kind IN ('captured', 'failed_read', 'unreadable', 'problem') THEN kind END,
         CASE WHEN kind IN ('captured', 'failed_read') THEN pending_us END
  FROM (
    SELECT f.station_id, s.position, s.event_id, s.ts_us, s.value, f.baseline, f.last_us, f.pending_us, f.pending,
           CASE WHEN f.pending_us IS NOT NULL THEN
                  CASE WHEN s.ts_us < f.pending_us + 3600000000 THEN 'waits' WHEN s.readable THEN 'captured' ELSE 'failed_read' END
                WHEN NOT s.readable THEN 'unreadable' WHEN s.value IS NULL THEN 'problem' WHEN f.baseline IS NULL THEN 'still'
                WHEN abs(s.value - f.baseline) > 40 AND (f.last_us IS NULL OR s.ts_us - f.last_us >= {GAP}) THEN 'moved'
                ELSE 'still' END AS kind
    FROM fold f JOIN frames s ON s.station_id = f.station_id AND s.position = f.position + 1
  )
)"""

# Predictions take turns by falling confidence; each takes the label it overlaps most among those still free.
MATCHES = f"""WITH RECURSIVE {BOXES},{TRUTH},{{crowd}}
thresholds AS (SELECT unnest([{{thresholds}}])::DOUBLE AS iou),
pairs AS (
  SELECT p.image_id, p.class_id, p.box_no, p.conf, t.truth_no,
         greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * 100 AS shared,
         shared / ((p.x2 - p.x1) * 100 + (t.x2 - t.x1) * 100 - shared) AS overlap
  FROM {{boxes}} p JOIN {{truth}} t USING (image_id, class_id)
),
wishes AS (
  SELECT image_id, class_id, box_no, conf, list({{{{'t': truth_no, 'o': overlap}}}} ORDER BY overlap DESC, truth_no) AS wished,
         row_number() OVER (PARTITION BY image_id, class_id ORDER BY conf DESC, box_no) AS turn
  FROM pairs WHERE overlap >= (SELECT min(iou) FROM thresholds) GROUP BY image_id, class_id, box_no, conf
),
taken(iou, image_id, class_id, turn, box_no, conf, truth_no, used) AS (
  SELECT DISTINCT iou, image_id, class_id, 0::BIGINT, NULL::INTEGER, NULL::DOUBLE, NULL::INTEGER, []::INTEGER[] FROM wishes, thresholds
  UNION ALL
  SELECT iou, image_id, class_id, turn, box_no, conf, truth_no, CASE WHEN truth_no IS NULL THEN used ELSE list_append(used, truth_no) END
  FROM (
    SELECT t.iou, w.image_id, w.class_id, w.turn, w.box_no, w.conf, t.used,
           list_filter(w.wished, lambda x: x.o >= t.iou AND NOT list_contains(t.used, x.t))[1].t AS truth_no
    FROM taken t JOIN wishes w ON w.image_id = t.image_id AND w.class_id = t.class_id AND w.turn = t.turn + 1
  )
),
hits AS (
  SELECT iou, image_id, class_id, truth_no, box_no, conf FROM taken WHERE truth_no IS NOT NULL
)"""
CROWD = """
crowd AS (
  SELECT image_id // 4 AS image_id, CAST(image_id % 4 * 4 + box_no AS INTEGER) AS box_no, class_id % 2 AS class_id, conf,
         x1 / 4 AS x1, y1, x1 / 4 + 100 AS x2, y2 FROM boxes
),
crowd_truth AS (
  SELECT image_id, box_no AS truth_no, class_id, x1 + (CAST(trunc(x1) AS BIGINT) * 7 + box_no * 13) % 40 AS x1, y1,
         x2 + (CAST(trunc(x1) AS BIGINT) * 7 + box_no * 13) % 40 AS x2, y2
  FROM crowd WHERE box_no % 2 = 0
),"""
CURVE_STEPS = """,
steps AS (
  SELECT iou, class_id, conf, n, coalesce(tp, 0) AS tp
  FROM (SELECT class_id, conf, count(*) AS n FROM {boxes} GROUP BY ALL) JOIN thresholds ON true
  LEFT JOIN (SELECT iou, class_id, conf, count(*) AS tp FROM hits GROUP BY ALL) USING (iou, class_id, conf)
),
positives AS (SELECT class_id, count(*) AS positives FROM {truth} GROUP BY 1),
curve AS (
  SELECT iou, class_id, conf, positives,
         CAST(sum(tp) OVER w AS BIGINT) AS cum_tp, CAST(sum(n) OVER w AS BIGINT) AS cum_n
  FROM steps JOIN positives USING (class_id)
  WINDOW w AS (PARTITION BY iou, class_id ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)
)"""
AP = """,
levels AS (SELECT range AS level FROM range(101)),
grid AS (
  SELECT c.iou, c.class_id, c.positives, l.level,
         max(cum_tp / cum_n) FILTER (cum_tp * 100 >= l.level * c.positives) AS best
  FROM curve c JOIN levels l ON true GROUP BY ALL
),
average AS (
  SELECT class_id, iou, positives, sum(coalesce(best, 0)) / 101 AS ap FROM grid GROUP BY ALL
)"""
def matches(sql: str, thresholds: str, crowd: bool = False) -> str:
    names = ("crowd", "crowd_truth", CROWD) if crowd else ("boxes", "truth", "")
    for place, text in zip(("boxes", "truth", "crowd"), names, strict=True):
        sql = sql.replace("{" + place + "}", text)
    return sql.replace("{thresholds}", thresholds).replace("{{", "{").replace("}}", "}")


CURVE = MATCHES + CURVE_STEPS
TEN = ", ".join(f"{0.5 + 0.05 * i:.2f}" for i in range(10))

NEAR = "abs({a}.x - {b}.x) <= 1 AND abs({a}.y - {b}.y) <= 1"


def morph(name: str, source: str, dilate: bool) -> str:
    """One 3 x 3 step; pixels beyond the border neither set nor clear anything."""
    if dilate:
        body = f"""SELECT DISTINCT image_id, x + dx AS x, y + dy AS y
  FROM {source}, (VALUES (-1), (0), (1)) h(dx), (VALUES (-1), (0), (1)) v(dy)
  WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 35"""
    else:
        body = f"""SELECT image_id, x, y FROM (
    SELECT image_id, x + dx AS x, y + dy AS y
    FROM {source}, (VALUES (-1), (0), (1)) h(dx), (VALUES (-1), (0), (1)) v(dy)
    WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 35)
  GROUP BY ALL
  HAVING count(*) = (1 + CAST(x > 0 AS INT) + CAST(x < 63 AS INT)) * (1 + CAST(y > 0 AS INT) + CAST(y < 35 AS INT))"""
    return f"{name} AS (\n  {body}\n)"


# Discs of a map in SQL. Neighbouring discs form chains, so their union has no holes to fill.
REGIONS = f"""WITH RECURSIVE {CAPTURES},{BOXES},
discs AS (
  SELECT image_id, max(conf) AS conf, floor(max((x1 + x2) / 2) / 20) AS cx, 8 + 6 * box_no AS cy, box_no
  FROM boxes GROUP BY image_id, box_no
),
painted AS (
  SELECT image_id, x, y, max(conf)::FLOAT AS v
  FROM discs, range(64) h(x), range(36) r(y)
  WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 20 GROUP BY ALL
),
pixels AS (
  SELECT c.image_id, h.x, r.y, greatest(0.05::FLOAT, coalesce(v, 0::FLOAT)) AS v
  FROM captures c, range(64) h(x), range(36) r(y)
  LEFT JOIN painted p ON p.image_id = c.image_id AND p.x = h.x AND p.y = r.y
),
gate AS (
  SELECT image_id, coalesce(max(conf), 0) AS pred_score FROM captures LEFT JOIN boxes USING (image_id) GROUP BY 1
),
levels AS (
  SELECT image_id, greatest(0.2::DOUBLE, quantile_cont(v, 0.995)::DOUBLE, max(v)::DOUBLE * 0.84::DOUBLE) AS threshold
  FROM pixels JOIN gate USING (image_id) WHERE pred_score >= 0.5 GROUP BY 1
),
candidate AS (
  SELECT image_id, x, y FROM pixels JOIN levels USING (image_id) WHERE v >= threshold::FLOAT
),
{morph('e1', 'candidate', False)},
{morph('o1', 'e1', True)},
{morph('d2', 'o1', True)},
{morph('part', 'd2', False)},
reach AS (
  SELECT image_id, x, y, y * 64 + x AS first FROM part
  UNION
  SELECT r.image_id, p.x, p.y, r.first FROM reach r JOIN part p
    ON p.image_id = r.image_id AND {NEAR.format(a='p', b='r')} WHERE r.first < p.y * 64 + p.x
),
labelled AS (SELECT image_id, x, y, min(first) AS first FROM reach GROUP BY ALL),
areas AS (
  SELECT image_id, first, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END) AS area FROM (
    SELECT image_id, first, x - dx AS wx, y - dy AS wy, count(*) AS n
    FROM labelled, (VALUES (0), (1)) h(dx), (VALUES (0), (1)) v(dy) GROUP BY ALL)
  GROUP BY ALL
),
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first) AS INTEGER) AS component_no FROM areas
),
stats AS (
  SELECT image_id, component_no, CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y,
         CAST(max(x) - min(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height,
         CAST(round_even(any_value(area), 0) AS INTEGER) AS area, avg(v::DOUBLE) AS mean_score, max(v::DOUBLE) AS max_score,
         100.0::DOUBLE AS median_edge_distance,
         round(max_score * 0.55::DOUBLE + mean_score * 0.35::DOUBLE + 0.10::DOUBLE, 6) AS ranking_score
  FROM labelled JOIN numbered USING (image_id, first) JOIN pixels USING (image_id, x, y) GROUP BY 1, 2
),
ranked AS (
  SELECT * REPLACE (round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score),
         row_number() OVER (PARTITION BY image_id ORDER BY ranking_score DESC, component_no) AS rank
  FROM stats WHERE area >= 20
)"""

# The same under a mask: a rectangle, from whose inside the edge is this far away.
INSIDE = "x BETWEEN side AND 63 - side AND y BETWEEN 2 AND 33"
REGIONS_MASKED = (
    REGIONS.replace("discs AS (", "sides AS (SELECT image_id, station_id % 6 + 2 AS side FROM captures),\ndiscs AS (", 1)
    .replace("WHERE pred_score >= 0.5 GROUP BY 1", f"JOIN sides USING (image_id) WHERE pred_score >= 0.5 AND {INSIDE} GROUP BY 1", 1)
    .replace("WHERE v >= threshold::FLOAT", f"JOIN sides USING (image_id) WHERE v >= threshold::FLOAT AND {INSIDE}", 1)
    .replace("100.0::DOUBLE AS", "median(greatest(0, least(x - side + 1, 64 - side - x, y - 1, 34 - y)))::DOUBLE AS", 1)
    .replace("+ 0.10::DOUBLE,", "+ 0.10::DOUBLE * least(median_edge_distance / 18, 1),", 1)
    .replace("FROM labelled JOIN numbered USING (image_id, first) JOIN pixels", "FROM labelled JOIN sides USING (image_id) JOIN numbered USING (image_id, first) JOIN pixels", 1)
)

SQL: dict[str, str] = {
    "verdict_from_boxes": f"WITH {CAPTURES},{BOXES},{VERDICTS} SELECT * FROM verdicts",
    "inspections": f"""{RECORDS} SELECT {SHOWN}, human_validation, confidence_kind, identity_identified,
        identity_similarity FROM inspections""",
    "kpis": f"""{RECORDS}{VALIDATED} SELECT count(*) AS total, count(*) FILTER (status = 'Defecto') AS defects,
        count(*) FILTER (status = 'Aprobado') AS approved, count(*) FILTER (status = 'Revisar') AS review,
        count(*) FILTER (human_validation = 'Pendiente') AS pending FROM validated""",
    "health": f"{RECORDS} SELECT count(*) AS inspections, 'model' AS detection_mode FROM inspections",
    "report_by_garment": f"""{RECORDS} SELECT garment_type, count(*) AS total,
        count(*) FILTER (status = 'Defecto') AS defects FROM inspections GROUP BY 1 ORDER BY 1""",
    "report_by_defect": f"""{RECORDS} SELECT defect_type, count(*) AS total FROM inspections
        GROUP BY 1 ORDER BY 2 DESC, 1""",
    "latest_8": f"{RECORDS} SELECT {SHOWN} FROM inspections ORDER BY id DESC LIMIT 8",
    "alerts_5": f"""{RECORDS} SELECT {SHOWN} FROM inspections WHERE status IN ('Defecto', 'Revisar')
        ORDER BY id DESC LIMIT 5""",
    "latest_one": f"{RECORDS} SELECT {SHOWN} FROM inspections ORDER BY id DESC LIMIT 1",
    "search_records": f"""{RECORDS} SELECT {SHOWN} FROM inspections
        WHERE (contains(code, 'rot') OR contains(defect_type, 'rot') OR contains(zone, 'rot'))
          AND status = 'Defecto' AND garment_type = 'Blusa' ORDER BY id DESC LIMIT 200""",
    "search_wildcards": f"""{RECORDS} SELECT {SHOWN} FROM inspections
        WHERE code LIKE '%INS-1%A_%' OR defect_type LIKE '%INS-1%A_%' OR zone LIKE '%INS-1%A_%'""",
    "search_wildcards_ai": f"""{RECORDS} SELECT {SHOWN} FROM inspections
        WHERE strip_accents(lower(zone)) LIKE '%l_ter%l%' OR strip_accents(lower(defect_type)) LIKE '%l_ter%l%'
          OR strip_accents(lower(code)) LIKE '%l_ter%l%'""",
    "search_ci_ai": f"""{RECORDS} SELECT {SHOWN} FROM inspections
        WHERE strip_accents(lower(zone)) LIKE '%lateral%' AND lower(status) = 'revisar'""",
    "validated_records": f"{RECORDS}{VALIDATED} SELECT {SHOWN}, human_validation FROM validated",
    "confusion_matrix": confusion(""),
    "confusion_by_garment": confusion("garment_type"),
    "code_collisions": f"""{RECORDS} SELECT substr(code, 12, 4) AS code, count(*) AS uses, min(id) AS first_id,
        max(id) AS last_id FROM inspections GROUP BY 1 HAVING count(*) > 1""",
    "garment_vocab_gap": f"""{RECORDS} SELECT garment_type, count(*) AS records FROM inspections
        WHERE garment_type NOT IN ('Blusa', 'Top corto', 'Camisa cropped') GROUP BY 1""",
    "vocabulary_violations": """SELECT 'human_validation' AS field, 'otro' AS value, count(*) AS records
        FROM lineitem WHERE l_returnflag NOT IN ('R', 'A') HAVING count(*) > 0""",
    "inspection_json": f"""{RECORDS} SELECT id, to_json({{'id': id, 'code': code, 'created_at': created_at,
        'garment_type': garment_type, 'status': status, 'defect_type': defect_type, 'confidence': confidence,
        'zone': zone, 'image_result': image_result}})::VARCHAR AS json FROM inspections""",
    "records_display": f"""{RECORDS} SELECT id, replace(code, 'INS-', '') AS short_code, lower(status) AS status_class,
        defect_type, zone, CAST(CAST(confidence AS DECIMAL(5, 2)) AS VARCHAR) || '%' AS confidence FROM inspections""",
    "label_errors": f"{LINES} SELECT * FROM errors",
    "label_error_preview": f"""{LINES} SELECT *, greatest((SELECT count(*) FROM errors) - 50, 0) AS more
        FROM errors ORDER BY split, stem, line_no, rule, field LIMIT 50""",
    "label_split_summary": f"""{FILES} SELECT s.split, count(i.stem) AS images,
        count(*) FILTER (f.marked) AS with_defects, count(*) FILTER (NOT f.marked) AS without_defects
        FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN images i USING (split)
        LEFT JOIN files f ON f.split = i.split AND f.stem = i.stem GROUP BY 1""",
    "missing_labels": f"""{FILES} SELECT split, stem FROM images
        WHERE stem NOT IN (SELECT stem FROM files)""",
    "orphan_labels": f"""{FILES} SELECT split, stem FROM files
        WHERE stem NOT IN (SELECT stem FROM images WHERE o_orderstatus <> 'F')""",
    "yolo_boxes": f"""WITH {BOXES} SELECT {split('image_id::VARCHAR')} AS split, image_id::VARCHAR AS stem,
        printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + (x2 - x1) / 2) / 1280, (y1 + (y2 - y1) / 2)::DOUBLE / 720,
               (x2 - x1) / 1280, (y2 - y1)::DOUBLE / 720) AS line FROM boxes""",
    "capture_name_parse": f"""{NAMES} SELECT event_id, file_name, garment, defect,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS captured_at, suffix FROM names""",
    "dataset_cube": f"""{NAMES} SELECT coalesce(garment, 'all') AS garment, coalesce(defect, 'all') AS defect,
        coalesce(split, 'all') AS split, count(*) AS captures
        FROM (SELECT garment, defect, {split('file_name')} AS split FROM names) GROUP BY CUBE (garment, defect, split)""",
    "duplicate_targets": f"""WITH files AS (SELECT {slug('p_brand')} || '/' || {slug('p_name')} AS base,
        ['.jpg', '.png', '.webp'][p_size % 3 + 1] AS suffix FROM part)
        SELECT base || '.png' AS target, count(*) AS sources, min(base || suffix) AS first_source,
        max(base || suffix) AS last_source FROM files GROUP BY 1 HAVING count(*) > 1""",
    "slugs": f"SELECT p_partkey, {slug(chr(39) + '  ' + chr(39) + ' || p_name || ' + chr(39) + ' — ' + chr(39) + ' || p_brand || ' + chr(39) + '!' + chr(39))} AS slug FROM part",
    "hash_splits": f"SELECT o_orderkey, {split('o_orderkey::VARCHAR')} AS split FROM orders",
    "holdout_splits": """WITH images AS (SELECT DISTINCT vec_id // 8 AS image_id FROM embeddings),
        placed AS (SELECT image_id, ('0x' || substr(md5('42:' || image_id), 1, 8))::ubigint % 10000 AS b FROM images)
        SELECT image_id, CASE WHEN b < 1000 THEN 'val' WHEN b < 2000 THEN 'test' ELSE 'train' END AS split FROM placed""",
    "sessions_null_station": f"""{SEQUENCES.replace("user_id AS station_id", "CASE WHEN event_id % 3 <> 0 THEN user_id END AS station_id")}
        SELECT event_id, station_id, session FROM numbered""",
    "sequence_split": f"""{SEQUENCES} SELECT event_id, station_id, session, sequence, {split('sequence')} AS split
        FROM sequences""",
    "split_leak_check": f"""{SEQUENCES}, torn AS (SELECT sequence, {split('event_id::VARCHAR')} AS split FROM sequences)
        SELECT sequence, min(split) AS first_split, max(split) AS last_split, count(*) AS shots
        FROM torn GROUP BY 1 HAVING min(split) <> max(split)""",
    "top3_similarity": f"{SIMILARITIES} SELECT query_id, model_name, round(similarity, 6) AS similarity FROM likeness",
    "profile_stats": f"""{SIMILARITIES}{CLOSED} SELECT model_name, n, round(min_sim, 6) AS min_sim,
        round(mean_sim, 6) AS mean_sim FROM profiles""",
    "loo_threshold": f"{SIMILARITIES}{CLOSED} SELECT model_name, round(threshold, 4)::DOUBLE AS threshold FROM profiles",
    "loo_threshold_open": f"{SIMILARITIES}{OPEN} SELECT model_name, round(threshold, 4)::DOUBLE AS threshold FROM profiles",
    "identify": f"{SIMILARITIES}{CLOSED}{IDENTIFY}",
    "identify_open": f"{SIMILARITIES}{OPEN}{IDENTIFY}",
    "identify_blocks": f"{SIMILARITIES}{OPEN}{IDENTIFY}",
    "identify_sparse_models": f"""{SIMILARITIES}{OPEN}, known AS (
        {IDENTIFY.replace("JOIN profiles USING (model_name)", "JOIN profiles USING (model_name) WHERE model_name < 'modelo_5'")})
        SELECT * FROM known
        UNION ALL SELECT vec_id, false, NULL, 'prenda_no_identificada', NULL, NULL FROM items
          WHERE vec_id NOT IN (SELECT query_id FROM known)
        UNION ALL SELECT -1 - vec_id, false, NULL, 'prenda_no_identificada', NULL, NULL FROM items""",
    "unit_vectors": """WITH scaled AS (
          SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7)) AS v FROM embeddings)
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END AS length,
          round(CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE (v[1] / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE END, 4) AS head FROM scaled""",
    "identify_pairs_open": f"""{SIMILARITIES}{OPEN} SELECT query_id, model_name, round(similarity, 4) AS similarity,
        round(threshold, 4) AS threshold, coalesce(similarity >= threshold, false) AS identified
        FROM likeness LEFT JOIN profiles USING (model_name)""",
    "patch_knn": f"""{DISTANCES} SELECT patch_id AS query_id, item_id, round(distance, 6) AS distance
        FROM ranked WHERE r <= 9""",
    "patch_knn_blocks": f"""{DISTANCES} SELECT patch_id AS query_id, item_id, round(distance, 6) AS distance
        FROM ranked WHERE r <= 9""",
    "image_anomaly_score": f"""{DISTANCES},
worst AS (
  SELECT * FROM ranked WHERE r = 1
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY distance DESC, patch_id) = 1
),
around AS (
  SELECT w.image_id, w.patch_id, w.distance, s.item_id AS support_id
  FROM worst w JOIN bank m USING (item_id) JOIN bank s ON true
  QUALIFY row_number() OVER (PARTITION BY w.image_id ORDER BY list_distance(m.e, s.e), s.item_id) <= 9
)
SELECT a.image_id, a.patch_id, round(any_value(distance), 6) AS distance,
       round(any_value(distance) * (1 - exp(any_value(distance)) / sum(exp(list_distance(p.e, s.e)))), 6) AS pred_score
FROM around a JOIN patches p USING (patch_id) JOIN bank s ON s.item_id = a.support_id GROUP BY 1, 2""",
    "patch_map": f"""{DISTANCES}, cells AS (SELECT image_id, unnest(range(8))::INTEGER AS patch_no
        FROM (SELECT DISTINCT image_id FROM patches))
        SELECT image_id, patch_no, round(distance::FLOAT::DOUBLE, 4) AS distance
        FROM cells LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (image_id, patch_no)""",
    "score_gate": f"""{SCORES} SELECT image_id, round(pred_score, 6) AS pred_score, pred_score >= 0.5 AS has_anomaly
        FROM scores""",
    "score_scale": f"""{SCORES} SELECT image_id, round(least(greatest((pred_score - 0.5) / (hi - lo) + 0.5, 0.0), 1.0), 6)
        AS scaled FROM scores, (SELECT min(pred_score) AS lo, max(pred_score) AS hi FROM scores)""",
    "dynamic_threshold": """SELECT event_id // 256 AS image_id, count(*) FILTER (event_type <> 'signup') AS pixels,
        round(greatest(0.2::DOUBLE, quantile_cont(value / 500, 0.995) FILTER (event_type <> 'signup'),
              max(value / 500) FILTER (event_type <> 'signup') * 0.84), 6) AS threshold FROM events GROUP BY 1""",
    "region_rank_topk": f"""WITH regions AS (
          SELECT event_id // 16 AS image_id, CAST(event_id % 16 AS INTEGER) AS component_no,
            round(least(value / 100, 1.0::DOUBLE) * 0.55::DOUBLE + least(value / 100, 1.0::DOUBLE) * 0.8::DOUBLE * 0.35::DOUBLE
                  + least({K} / 4 / 18.0::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE, 6) AS ranking_score FROM events),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ranking_score DESC, component_no)
                   AS INTEGER) AS rank FROM regions)
        SELECT image_id, rank, component_no, ranking_score FROM ranked WHERE rank <= 3""",
    "region_stats": f"""WITH stats AS (
          SELECT event_id // 256 AS image_id, event_type AS component, count(*) AS pixels, avg(value / 500) AS mean_score,
                 max(value / 500) AS max_score, quantile_cont({K}, 0.5) AS median_edge_distance
          FROM events GROUP BY 1, 2)
        SELECT image_id, component, pixels, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score,
          median_edge_distance, round(0.55::DOUBLE * max_score + 0.35::DOUBLE * mean_score
            + 0.10::DOUBLE * least(median_edge_distance / 18.0::DOUBLE, 1.0::DOUBLE), 6) AS ranking_score FROM stats""",
    "localize_maps": f"{REGIONS} SELECT * EXCLUDE (rank) FROM ranked WHERE rank <= 2",
    "localize_masked": f"{REGIONS_MASKED} SELECT * EXCLUDE (rank) REPLACE (round(median_edge_distance, 2) AS median_edge_distance) FROM ranked WHERE rank <= 2",
    "filtered_masks": f"""{REGIONS_MASKED} SELECT image_id, l.y, count(*) AS pixels, min(l.x) AS first,
        count(*) FILTER (l.x BETWEEN side AND 63 - side AND l.y BETWEEN 2 AND 33) AS inside
        FROM labelled l JOIN numbered n USING (image_id, first) JOIN ranked r USING (image_id, component_no) JOIN sides USING (image_id)
        WHERE rank <= 2 GROUP BY 1, 2""",
    "localization_report": f"""{REGIONS}
        SELECT g.image_id::VARCHAR AS image, round(pred_score, 6) AS pred_score, pred_score >= 0.5 AS has_anomaly,
          round(coalesce(threshold, 0), 6) AS threshold_used, CAST(rank IS NOT NULL AS INTEGER) AS region_count,
          CASE WHEN rank IS NULL THEN '[]' ELSE to_json([{{'x': x, 'y': y, 'width': width, 'height': height,
            'area': area, 'mean_score': mean_score, 'max_score': max_score,
            'median_edge_distance': median_edge_distance, 'ranking_score': ranking_score}}])::VARCHAR END AS regions
        FROM gate g LEFT JOIN levels USING (image_id) LEFT JOIN ranked r ON r.image_id = g.image_id AND rank = 1""",
    # the smallest id is first, and among equally far items the smaller id is next
    "coreset": """WITH RECURSIVE bank AS (
          SELECT vec_id AS item_id, embedding::DOUBLE[] AS e, greatest(1, round_even(0.1 * count(*) OVER (), 0)) AS wanted
          FROM embeddings WHERE label < 8
        ),
        fold AS (
          SELECT 1 AS step, b.item_id, b.e, list_distance(b.e, f.e) AS gap, f.item_id AS picked, wanted
          FROM bank b, (SELECT item_id, e FROM bank ORDER BY item_id LIMIT 1) f
          UNION ALL
          SELECT step + 1, item_id, e, least(gap, list_distance(e, far_e)), far_id, wanted
          FROM (SELECT *, first_value(item_id) OVER w AS far_id, first_value(e) OVER w AS far_e
                FROM fold WINDOW w AS (ORDER BY gap DESC, item_id))
          WHERE step < wanted
        )
        SELECT DISTINCT picked AS item_id FROM fold""",
    # four rows above and below the garment are closed up to the border
    "garment_mask": f"""WITH {CAPTURES} SELECT image_id, NULL::VARCHAR AS error, 90 AS mask_height, 160 AS mask_width,
        CAST((160 - 2 * (station_id % 16 + 8)) * 90 AS BIGINT) AS pixels FROM captures""",
    "motion_candidates": f"""{SHOTS} SELECT event_id, station_id, position, previous, value FROM shots
        WHERE abs(value - previous) > 40""",
    "auto_capture": f"""{SHOTS},
fold AS (
  SELECT station_id, event_id, ts_us, position, value AS baseline, NULL::BIGINT AS last_us, false AS taken
  FROM shots WHERE position = 1
  UNION ALL
  SELECT s.station_id, s.event_id, s.ts_us, s.position,
         CASE WHEN hit THEN NULL ELSE s.value END,
         CASE WHEN hit THEN s.ts_us ELSE last_us END, hit
  FROM (SELECT f.baseline, f.last_us, s.*,
               coalesce(abs(s.value - f.baseline) > 40, false)
               AND (f.last_us IS NULL OR s.ts_us - f.last_us >= {GAP}) AS hit
        FROM fold f JOIN shots s ON s.station_id = f.station_id AND s.position = f.position + 1) s
)
SELECT station_id, ts_us, event_id FROM fold WHERE taken""",
    "station_status": f"""WITH {CAPTURES},{BOXES},{VERDICTS}
        SELECT station_id, image_id, status, defect_type, zone FROM captures JOIN verdicts USING (image_id)
        QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY captured_at DESC, image_id DESC) = 1""",
    "live_kpis": f"""{RECORDS} SELECT strftime(date_trunc('hour', created_at::TIMESTAMP), '%Y-%m-%d %H:%M:%S')
        AS window_start, count(*) AS total, count(*) FILTER (status = 'Defecto') AS defects,
        count(*) FILTER (status = 'Aprobado') AS approved, count(*) FILTER (status = 'Revisar') AS review
        FROM inspections GROUP BY 1""",
    "capture_sessions": f"""{SEQUENCES} SELECT station_id, session, count(*) AS shots, min(ts_us) AS first_us,
        max(ts_us) AS last_us FROM sequences GROUP BY 1, 2""",
    "detection_pr_curve": matches(CURVE, "0.5") + """
        SELECT iou, class_id, round(conf, 6) AS conf, cum_tp, cum_n, positives, round(cum_tp / cum_n, 6) AS precision,
        round(cum_tp / positives, 6) AS recall FROM curve""",
    "detection_map": matches(CURVE, TEN) + AP
    + " SELECT class_id, iou, positives, round(ap, 6) AS ap FROM average",
    "detection_map_summary": matches(CURVE, TEN) + AP
    + " SELECT round(avg(ap) FILTER (iou = 0.5), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM average",
    "crowded_matches": matches(MATCHES, "0.2, 0.5, 0.75", True) + " SELECT * FROM hits",
    "crowded_map": matches(CURVE, TEN, True) + AP + " SELECT class_id, iou, positives, round(ap, 6) AS ap FROM average",
    "patch_knn_pivots": f"""{DISTANCES} SELECT patch_id AS query_id, item_id, round(distance, 6) AS distance
        FROM ranked WHERE r <= 9""",
    "shaped_knn_pivots": f"""{DISTANCES.replace("embedding::DOUBLE[]", SHAPED)} SELECT patch_id AS query_id, item_id,
        round(distance, 6) AS distance FROM ranked WHERE r <= 9""",
    "shaped_knn_work": """SELECT count(*) * count(*) FILTER (label < 8) AS pairs, true AS below_half FROM embeddings""",
    "stabilised_capture": f"{OUTCOMES} SELECT station_id, event_id, ts_us, trigger_us FROM fold WHERE outcome = 'captured'",
    "capture_failures": f"""{OUTCOMES} SELECT station_id, event_id, ts_us, outcome, trigger_us FROM fold
        WHERE outcome <> 'captured'""",
    "label_round_trip": f"""WITH {CAPTURES}, {BOXES}, lines AS (
        SELECT image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + (x2 - x1) / 2) / 1280,
            (y1 + (y2 - y1) / 2)::DOUBLE / 720, (x2 - x1) / 1280, (y2 - y1)::DOUBLE / 720) || chr(10), '' ORDER BY box_no) AS content
        FROM boxes GROUP BY image_id)
        SELECT {split('image_id::VARCHAR')} AS split, image_id::VARCHAR AS stem,
            coalesce(content, CASE WHEN image_id % 3 = 0 THEN chr(10) ELSE '' END) AS content
        FROM captures LEFT JOIN lines USING (image_id)""",
    "coreset_union": "SELECT CAST(round_even(0.1 * count(*), 0) AS BIGINT) AS chosen, true AS within_twice FROM embeddings WHERE label < 8",
}
SQL["late_frames"] = SQL["auto_capture"]
SQL["registered_twice"] = f"""SELECT id, code, created_at, garment_type, status, defect_type, confidence, zone FROM ({SQL["inspections"]})"""
