"""Table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

INSPECTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("garment_type", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("defect_type", T.StringType()),
        T.StructField("confidence", T.DecimalType(5, 2)),
        T.StructField("zone", T.StringType()),
        T.StructField("image_original", T.StringType()),
        T.StructField("image_result", T.StringType()),
        T.StructField("human_validation", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("created_record_at", T.TimestampNTZType()),
    ]
)

BOXES = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("box_no", T.IntegerType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("x2", T.DoubleType()),
        T.StructField("y2", T.DoubleType()),
        T.StructField("img_w", T.IntegerType()),
        T.StructField("img_h", T.IntegerType()),
    ]
)

GALLERY = "model_name string, image_name string, embedding array<float>"
PROFILE = "model_name string, n long, min_sim double, mean_sim double, threshold double"
ANOMALY_MAPS = "image_id long, height int, width int, map array<float>, pred_score array<double>"
FRAMES = (
    "station_id long, frame_seq long, ts timestamp, readable boolean, "
    "height int, width int, nChannels int, data binary"
)
REGION = (
    "struct<x:int,y:int,width:int,height:int,area:int,mean_score:double,max_score:double,"
    "median_edge_distance:double,ranking_score:double>"
)

# --- fixed values: words written to and compared in the records -------------------------------
APPROVED, DEFECT, REVIEW = "Aprobado", "Defecto", "Revisar"
STATUSES = [APPROVED, DEFECT, REVIEW]
ALERT_STATUSES = [DEFECT, REVIEW]
PENDING, CORRECT, INCORRECT = "Pendiente", "Correcto", "Incorrecto"
VALIDATIONS = [CORRECT, INCORRECT, PENDING]
CLASS_NAMES = {0: "mancha", 1: "rotura", 2: "agujero", 3: "variacion_color"}
VISIBLE_DEFECT = "Defecto visible"
NO_DEFECT = "Sin defecto"
INVALID_IMAGE = "Imagen no válida"
UNIDENTIFIED = "Prenda no identificada"
UNIDENTIFIED_RESULT = "prenda_no_identificada"
INSPECTED_GARMENT = "Prenda inspeccionada"
HEURISTIC_ANOMALY = "Anomalía visual (modo prototipo, sin modelo entrenado)"
HEURISTIC_CLEAR = "Sin anomalía evidente (modo prototipo)"
ZONE_LEFT, ZONE_RIGHT, ZONE_FRONT = "Lateral izquierdo", "Lateral derecho", "Zona frontal"
ZONE_CENTER, ZONE_UNDEFINED, ZONE_NOT_APPLICABLE = "Centro", "No definida", "No aplica"
ZONES = [ZONE_LEFT, ZONE_RIGHT, ZONE_FRONT, ZONE_CENTER, ZONE_UNDEFINED, ZONE_NOT_APPLICABLE]
GARMENT_FILTERS = ["Blusa", "Top corto", "Camisa cropped"]
CAPTURE_GARMENTS = ["blusa", "top_corto", "camisa_cropped"]
CAPTURE_DEFECTS = ["sin_defecto", "mancha", "rotura", "agujero", "variacion_color"]
SPLITS = ["train", "val", "test"]
DEFAULT_SIZE = "N/A"
DEFAULT_SLUG = "modelo_prenda"
STATION_NOTES = "Registro generado por estación de inspección."
AUTO_NOTES = "Registro automático generado por detección de movimiento."
CAMERA_ERROR = "Cámara no disponible."
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp"]
DATASET_EXTENSIONS = ["bmp", "jpeg", "jpg", "png", "webp"]
# --- end of fixed values ----------------------------------------------------------------------
