"""The registered queries: every one reads the given tables in full."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.functions.geometry import normalised_box
from seamline.functions.hashing import hash_split, holdout_split
from seamline.functions.scores import normalised_score
from seamline.functions.vectors import dot, l2_normalise
from seamline.functions.text import slug
from seamline.operators import (
    anomaly,
    capture,
    dataset,
    detections,
    identity,
    images,
    labels,
    localize,
    records,
)
from seamline.operators.farthest import farthest_items
from seamline.operators.nearest import EUCLIDEAN, nearest
from seamline.operators.pivots import Search, nearest_by_pivots
from seamline.operators.capture_rule import CaptureRule
from seamline.plans import fixtures as X
from seamline.sinks.jdbc import InspectionDatabase
from seamline.sources.label_files import read_label_folder, write_label_folder
from seamline.session import DEFAULT_CONF, cut_lineage, shared_folder
from seamline.streaming import capture as live_capture
from seamline.streaming import kpis as live

OPEN = {"percentile": 0.50, "margin": 0.0, "low": 0.10, "high": 0.90}
GAP_US = 6 * 3600 * 1_000_000
COOLDOWN_US = 6 * 3600 * 1_000_000
STABILISATION_US, LATE_US = 3600 * 1_000_000, 6 * 3600 * 1_000_000
MOTION = 40.0
SHOWN = ["id", "code", "created_at", "garment_type", "status", "defect_type", "confidence", "zone"]


def _shown(rows: DataFrame, *extra: str) -> DataFrame:
    """Record columns in plain types."""
    plain = rows.withColumn("confidence", F.col("confidence").cast("double"))
    plain = plain.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return plain.select(*SHOWN, *extra)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


# --- verdicts and records ---------------------------------------------------------------------


def verdict_from_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return X.verdicts(spark, folder)


def inspections(spark: SparkSession, folder: str) -> DataFrame:
    extra = ["human_validation", "confidence_kind", "identity_identified", "identity_similarity"]
    return _shown(X.inspections(spark, folder), *extra)


def registered_twice(spark: SparkSession, folder: str) -> DataFrame:
    """The inspections from a database in which both batches were registered twice, read back in ranges of ids."""
    home = shared_folder(spark).removeprefix("file:").replace("//", "/")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{home}/derby.log")
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    database = InspectionDatabase(spark, f"jdbc:derby:{home}/inspections-{uuid.uuid4().hex};create=true", driver=driver)
    rows = X.inspections(spark, folder)
    for batch in (0, 1, 0, 1):
        database.register(rows.where(F.col("id") % 2 == batch), f"half-{batch}")
    return _shown(database.read(8))


def kpis(spark: SparkSession, folder: str) -> DataFrame:
    return records.kpis(validated(spark, folder))


def health(spark: SparkSession, folder: str) -> DataFrame:
    return records.health(X.inspections(spark, folder), "model")


def report_by_garment(spark: SparkSession, folder: str) -> DataFrame:
    return records.by_garment(X.inspections(spark, folder))


def report_by_defect(spark: SparkSession, folder: str) -> DataFrame:
    return records.by_defect(X.inspections(spark, folder))


def latest_8(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(records.latest(X.inspections(spark, folder), 8))


def alerts_5(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(records.alerts(X.inspections(spark, folder), 5))


def latest_one(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(records.latest(X.inspections(spark, folder), 1))


def search_records(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(records.search(X.inspections(spark, folder), " rot ", "Defecto", "Blusa"))


def search_wildcards(spark: SparkSession, folder: str) -> DataFrame:
    found = records.search(X.inspections(spark, folder), "INS-1%A_", wildcards=True, limit=None)
    return _shown(found)


def search_wildcards_ai(spark: SparkSession, folder: str) -> DataFrame:
    blind = records.CASE_AND_ACCENT_BLIND
    return _shown(records.search(X.inspections(spark, folder), "L_TÉR%l", limit=None, collation=blind, wildcards=True))


def search_ci_ai(spark: SparkSession, folder: str) -> DataFrame:
    blind = records.CASE_AND_ACCENT_BLIND
    return _shown(records.search(X.inspections(spark, folder), "LÁTERAL", "REVISAR", limit=None, collation=blind))


def validated(spark: SparkSession, folder: str) -> DataFrame:
    rows, events = X.inspections(spark, folder), X.validations(spark, folder)
    return records.apply_validations(rows, events, X.VALIDATION_ORDER)


def validated_records(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(validated(spark, folder), "human_validation")


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return records.confusion(validated(spark, folder))


def confusion_by_garment(spark: SparkSession, folder: str) -> DataFrame:
    return records.confusion(validated(spark, folder), "garment_type")


def code_collisions(spark: SparkSession, folder: str) -> DataFrame:
    # the hash part alone repeats often enough to show
    rows = X.inspections(spark, folder).withColumn("code", F.substring("code", 12, 4))
    return records.code_collisions(rows)


def garment_vocab_gap(spark: SparkSession, folder: str) -> DataFrame:
    return records.garment_vocabulary_gap(X.inspections(spark, folder))


def vocabulary_violations(spark: SparkSession, folder: str) -> DataFrame:
    values = X.validations(spark, folder).select(
        F.col("value").alias("human_validation"), F.lit("Aprobado").alias("status"), F.lit("Centro").alias("zone")
    )
    return records.vocabulary_violations(values)


def inspection_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.inspections(spark, folder)
    columns = ["id", "code", "created_at", "garment_type", "status", "defect_type", "confidence", "zone", "image_result"]
    return records.as_json(rows.select(*columns))


def records_display(spark: SparkSession, folder: str) -> DataFrame:
    return records.for_display(X.inspections(spark, folder))


# --- labels and datasets ----------------------------------------------------------------------


def label_errors(spark: SparkSession, folder: str) -> DataFrame:
    return labels.line_errors(X.label_lines(spark, folder))


def label_error_preview(spark: SparkSession, folder: str) -> DataFrame:
    return labels.error_preview(labels.line_errors(X.label_lines(spark, folder)))


def label_split_summary(spark: SparkSession, folder: str) -> DataFrame:
    return labels.split_summary(X.label_images(spark, folder), X.label_files(spark, folder))


def missing_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels.missing_labels(X.label_images(spark, folder), X.label_files(spark, folder))


def orphan_labels(spark: SparkSession, folder: str) -> DataFrame:
    # finished orders stand for images that were deleted while their label stayed
    kept = X.label_images(spark, folder).filter(F.col("o_orderstatus") != "F")
    return labels.orphan_labels(kept, X.label_files(spark, folder))


def _box_lines(spark: SparkSession, folder: str, *kept: str) -> DataFrame:
    found = X.boxes(spark, folder)
    sides = ("x1", "y1", "x2", "y2", "img_w", "img_h")
    x1, y1, x2, y2, img_w, img_h = (F.col(c) for c in sides)
    box = normalised_box(x1, y1, x2 - x1, y2 - y1, img_w, img_h)
    stem = F.col("image_id").cast("string")
    rows = found.select(hash_split(stem).alias("split"), stem.alias("stem"), "class_id", box.alias("b"), *kept)
    return labels.format_lines(rows.select("split", "stem", "class_id", "b.*", *kept), *kept)


def yolo_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return _box_lines(spark, folder)


def capture_name_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = dataset.parsed_captures(X.capture_files(spark, folder))
    return parsed.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"))


def dataset_cube(spark: SparkSession, folder: str) -> DataFrame:
    parsed = dataset.parsed_captures(X.capture_files(spark, folder))
    return dataset.capture_cube(parsed.withColumn("split", hash_split(F.col("file_name"))))


def duplicate_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of one name and brand, stored once per type, as pictures of different formats."""
    suffix = F.get(F.array(F.lit(".jpg"), F.lit(".png"), F.lit(".webp")), (F.col("p_size") % 3).cast("int"))
    name = F.concat_ws("/", slug(F.col("p_brand")), slug(F.col("p_name")))
    files = X.table(spark, folder, "part").select(F.concat(name, suffix).alias("relative_path"))
    return dataset.duplicate_targets(files)


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    label = F.concat(F.lit("  "), F.col("p_name"), F.lit(" — "), F.col("p_brand"), F.lit("!"))
    return X.table(spark, folder, "part").select("p_partkey", slug(label).alias("slug"))


def hash_splits(spark: SparkSession, folder: str) -> DataFrame:
    return X.table(spark, folder, "orders").select("o_orderkey", hash_split(F.col("o_orderkey")).alias("split"))


def holdout_splits(spark: SparkSession, folder: str) -> DataFrame:
    images = X.patches(spark, folder).select("image_id").distinct()
    return images.withColumn("split", holdout_split(F.col("image_id")))


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.sequence_split(X.shots(spark, folder), ["station_id"], "ts_us", "event_id", GAP_US)


def sequence_split(spark: SparkSession, folder: str) -> DataFrame:
    return _sequences(spark, folder).select("event_id", "station_id", "session", "sequence", "split")


def sessions_null_station(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions where a third of all shots have no station."""
    shots = X.shots(spark, folder).withColumn("station_id", F.expr("if(event_id % 3 = 0, null, station_id)"))
    return dataset.sessions(shots, ["station_id"], "ts_us", "event_id", GAP_US).select("event_id", "station_id", "session")


def split_leak_check(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences that a split by single shots would tear apart."""
    torn = _sequences(spark, folder).withColumn("split", hash_split(F.col("event_id")))
    return dataset.split_leaks(torn)


# --- identity ---------------------------------------------------------------------------------


def top3_similarity(spark: SparkSession, folder: str) -> DataFrame:
    found = identity.similarity(X.gallery_queries(spark, folder), X.gallery(spark, folder), skip_self=True)
    return _rounded(found)


def profile_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(identity.profiles(X.gallery(spark, folder)).drop("threshold"))


def loo_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(identity.profiles(X.gallery(spark, folder)).select("model_name", "threshold"), 4)


def loo_threshold_open(spark: SparkSession, folder: str) -> DataFrame:
    found = identity.profiles(X.gallery(spark, folder), **OPEN)
    return _rounded(found.select("model_name", "threshold"), 4)


def _identify(spark: SparkSession, folder: str, **constants) -> DataFrame:
    items = X.gallery(spark, folder)
    profile = identity.profiles(items, **constants)
    return identity.identify(X.gallery_queries(spark, folder), items, profile, skip_self=True)


def identify(spark: SparkSession, folder: str) -> DataFrame:
    return _identify(spark, folder)


def identify_open(spark: SparkSession, folder: str) -> DataFrame:
    return _identify(spark, folder, **OPEN)


def identify_pairs_open(spark: SparkSession, folder: str) -> DataFrame:
    items = X.gallery(spark, folder)
    pairs = identity.similarity(X.gallery_queries(spark, folder), items, skip_self=True)
    compared = identity.compare(pairs, identity.profiles(items, **OPEN))
    return _rounded(compared, 4).select("query_id", "model_name", "similarity", "threshold", "identified")


def identify_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as ``identify_open``, with nothing broadcast."""
    items, blocks = X.gallery(spark, folder), {"broadcast_bytes": 0, "block_rows": 100}
    profile = identity.profiles(items, **OPEN, **blocks)
    return identity.identify(X.gallery_queries(spark, folder), items, profile, skip_self=True, **blocks)


def identify_sparse_models(spark: SparkSession, folder: str) -> DataFrame:
    """Only models with a number below five have enough images; every query still has its row."""
    items = X.gallery(spark, folder)
    profile = identity.profiles(items, **OPEN).where("model_name < 'modelo_5'")
    asked = X.gallery_queries(spark, folder).unionByName(
        X.gallery_queries(spark, folder).select((-1 - F.col("query_id")).alias("query_id"), "embedding")
    )
    found = identity.identify(asked.where("query_id >= 0"), items, profile, skip_self=True)
    none = identity.identify(asked.where("query_id < 0"), items, profile.limit(0), skip_self=True)
    return found.unionByName(none)


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Length and first number of the normalised vectors, scaled by their id first."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    unit = X.table(spark, folder, "embeddings").select("vec_id", l2_normalise(scaled).alias("unit"))
    return unit.select("vec_id", F.round(dot(F.col("unit"), F.col("unit")), 5).alias("length"), F.round(F.get("unit", F.lit(0)).cast("double"), 4).alias("head"))


# --- anomaly model ----------------------------------------------------------------------------


def patch_knn(spark: SparkSession, folder: str) -> DataFrame:
    queries = X.patches(spark, folder).select(F.col("patch_id").alias("query_id"), "embedding")
    bank = X.nominal_bank(spark, folder)
    found = nearest(queries, bank, anomaly.BANK_NEIGHBOURS, EUCLIDEAN, skip_self=True)
    return _rounded(found.withColumnRenamed("score", "distance"))


def patch_knn_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as ``patch_knn``, with nothing broadcast."""
    queries = X.patches(spark, folder).select(F.col("patch_id").alias("query_id"), "embedding")
    found = nearest(queries, X.nominal_bank(spark, folder), anomaly.BANK_NEIGHBOURS, EUCLIDEAN, skip_self=True, broadcast_bytes=0, block_rows=100)
    return _rounded(found.withColumnRenamed("score", "distance"))


def patch_knn_pivots(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as ``patch_knn``, visiting blocks of items in the order of their pivots' bounds."""
    queries = X.patches(spark, folder).select(F.col("patch_id").alias("query_id"), "embedding")
    found = nearest_by_pivots(queries, X.nominal_bank(spark, folder), anomaly.BANK_NEIGHBOURS, skip_self=True, block_rows=100)
    return _rounded(found.withColumnRenamed("score", "distance"))


def _shaped_search(spark: SparkSession, folder: str) -> Search:
    queries = X.shaped(X.patches(spark, folder)).select(F.col("patch_id").alias("query_id"), "embedding")
    return Search(queries, X.shaped(X.nominal_bank(spark, folder)), anomaly.BANK_NEIGHBOURS, skip_self=True, block_rows=100)


def shaped_knn_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_shaped_search(spark, folder).rows.withColumnRenamed("score", "distance"))


def shaped_knn_work(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs there are, and whether fewer than half of them were compared."""
    search = _shaped_search(spark, folder)
    return spark.createDataFrame([(search.pairs, 2 * search.compared < search.pairs)], "pairs long, below_half boolean")


def image_anomaly_score(spark: SparkSession, folder: str) -> DataFrame:
    found = anomaly.image_scores(X.patches(spark, folder), X.nominal_bank(spark, folder), skip_self=True)
    return _rounded(found)


def patch_map(spark: SparkSession, folder: str) -> DataFrame:
    patches = X.patches(spark, folder)
    distances = anomaly.patch_distances(patches, X.nominal_bank(spark, folder), skip_self=True)
    maps = anomaly.patch_maps(patches, distances, 2, 4)
    cells = maps.select("image_id", F.posexplode("map").alias("patch_no", "distance"))
    return cells.withColumn("distance", F.round(F.col("distance").cast("double"), 4))


def coreset(spark: SparkSession, folder: str) -> DataFrame:
    return farthest_items(X.nominal_bank(spark, folder), anomaly.BANK_RATIO).select("item_id")


def coreset_union(spark: SparkSession, folder: str) -> DataFrame:
    """A bank reduced from several blocks, against the same share of it picked in one block."""
    bank = X.nominal_bank(spark, folder)
    chosen = cut_lineage(anomaly.coreset_union(bank, block_rows=100))
    return chosen.agg(F.count("*").alias("chosen")).withColumn("within_twice", F.lit(anomaly.covers_within(bank, chosen, 2)))


def score_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(anomaly.score_gate(X.raw_scores(spark, folder)))


def score_scale(spark: SparkSession, folder: str) -> DataFrame:
    gated = anomaly.score_gate(X.raw_scores(spark, folder))
    bounds = anomaly.score_bounds(gated)
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    scaled = normalised_score(F.col("pred_score"), low, high, F.lit(0.5))
    return _rounded(gated.select("image_id", scaled.alias("scaled")))


# --- localisation -----------------------------------------------------------------------------


def dynamic_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(localize.pixel_thresholds(X.map_pixels(spark, folder), "event_id"))


def region_rank_topk(spark: SparkSession, folder: str) -> DataFrame:
    top = localize.top_regions(X.regions(spark, folder), max_regions=3)
    return _rounded(top.select("image_id", "rank", "component_no", "ranking_score"))


def region_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(localize.region_stats(X.component_pixels(spark, folder), "event_id"))


def localize_maps(spark: SparkSession, folder: str) -> DataFrame:
    found = localize.localize(X.anomaly_maps(spark, folder), max_regions=2)
    return localize.region_rows(found)


def localization_report(spark: SparkSession, folder: str) -> DataFrame:
    found = localize.localize(X.anomaly_maps(spark, folder))
    rows = localize.report(found)
    return rows.select(
        "image", "pred_score", "has_anomaly", "threshold_used", "region_count", F.to_json("regions").alias("regions")
    )


def localize_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Regions under a garment mask: thresholds from inside it, distances to its edge."""
    found = localize.localize(X.anomaly_maps(spark, folder), X.side_masks(spark, folder), max_regions=2)
    return localize.region_rows(found)


def filtered_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of the kept regions, and those of them on the garment, by row of the picture."""
    masks = X.side_masks(spark, folder)
    kept = cut_lineage(localize.filtered_mask(localize.localize(X.anomaly_maps(spark, folder), masks, max_regions=2)))
    inside = localize.overlapping_runs(kept, localize.mask_runs(masks)).groupBy("image_id", "y").agg(F.sum("length").alias("inside"))
    rows = kept.groupBy("image_id", "y").agg(F.sum("length").alias("pixels"), F.min("x").alias("first"))
    return rows.join(inside, ["image_id", "y"], "left").na.fill(0, ["inside"])


# --- images -----------------------------------------------------------------------------------


def prepare_images(spark: SparkSession, folder: str) -> DataFrame:
    done = images.prepare_images(X.pictures(spark, folder), ["image_id"], size=128)
    level = F.round("mean_level", 4)
    return done.select("image_id", "status", "height", "width", level.alias("mean_level"))


def garment_mask(spark: SparkSession, folder: str) -> DataFrame:
    return images.garment_masks(X.pictures(spark, folder)).drop("mask")


def heuristic_detect(spark: SparkSession, folder: str) -> DataFrame:
    return images.heuristic_verdict(X.pictures(spark, folder))


def frame_motion(spark: SparkSession, folder: str) -> DataFrame:
    frames = X.picture_rows(spark, folder).withColumn("ts_us", F.unix_micros(F.col("captured_at").cast("timestamp")))
    found = images.frame_motion(frames, "station_id", "ts_us", "image_id", pixels=X.drawn)
    return found.select("image_id", "station_id", "changed_pixels")


# --- capture and live figures -----------------------------------------------------------------


def _moved(before, after):
    return F.abs(after - before) > MOTION


def motion_candidates(spark: SparkSession, folder: str) -> DataFrame:
    shots = X.shots(spark, folder)
    found = capture.motion_candidates(shots, "station_id", "ts_us", "event_id", "value", _moved)
    return found.select("event_id", "station_id", "position", "previous", "value")


def auto_capture(spark: SparkSession, folder: str) -> DataFrame:
    shots = X.shots(spark, folder)
    return capture.auto_captures(shots, "station_id", "ts_us", "event_id", "value", _moved, COOLDOWN_US)


def _value_moved(before: bytes, after: bytes) -> bool:
    return abs(float(after) - float(before)) > MOTION


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    rule = CaptureRule(_value_moved, COOLDOWN_US, STABILISATION_US)
    return capture.stored_outcomes(X.stored_frames(spark, folder), "station_id", "ts_us", "event_id", rule)


def stabilised_capture(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of the whole rule: a frame that moves, then the first one after the scene has come to rest."""
    return _outcomes(spark, folder).where("outcome = 'captured'").select("station_id", "event_id", "ts_us", "trigger_us")


def capture_failures(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder).where("outcome <> 'captured'").select("station_id", "event_id", "ts_us", "outcome", "trigger_us")


def late_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of ``auto_capture``, from a stream in which every frame arrives up to six hours late."""
    at = f"{shared_folder(spark)}/late-frames-{uuid.uuid4().hex}"
    X.arriving_frames(spark, folder, f"{at}/in", LATE_US)
    rocks = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(rocks, None) or ""):
        spark.conf.set(rocks, DEFAULT_CONF[rocks])
    kinds = "station_id long, frame_seq long, ts timestamp, readable boolean, signal binary, error string"
    frames = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 8).parquet(f"{at}/in")
    rule = CaptureRule(_value_moved, COOLDOWN_US, None)
    captures = live_capture.capture_stream(frames, rule, f"{LATE_US} microseconds", ordered=True)
    writer = captures.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("station_id long, frame_seq long, ts timestamp").parquet(f"{at}/out")
    return found.select("station_id", F.unix_micros("ts").alias("ts_us"), F.col("frame_seq").alias("event_id"))


def station_status(spark: SparkSession, folder: str) -> DataFrame:
    keep = ("captured_at", "station_id")
    rows = detections.verdict_from_boxes(X.captures(spark, folder), X.boxes(spark, folder), keep=keep)
    order = ["captured_at", "image_id"]
    return capture.station_status(rows, "station_id", order, ["image_id", "status", "defect_type", "zone"])


def live_kpis(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.inspections(spark, folder).withColumn("created_at", F.col("created_at").cast("timestamp"))
    found = live.live_kpis(rows)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def capture_sessions(spark: SparkSession, folder: str) -> DataFrame:
    shots = dataset.sessions(X.shots(spark, folder), ["station_id"], "ts_us", "event_id", GAP_US)
    return shots.groupBy("station_id", "session").agg(
        F.count("*").alias("shots"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


def label_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Label files of all captures, written and read again: marked, clean (0 bytes) and, for some, one blank line."""
    shots = X.captures(spark, folder).select("image_id")
    stem = F.col("image_id").cast("string")
    boxes, marked = X.boxes(spark, folder), _box_lines(spark, folder, "box_no")
    bare = shots.join(boxes.select("image_id"), "image_id", "left_anti").where("image_id % 3 = 0")
    blank = bare.select(hash_split(stem).alias("split"), stem.alias("stem"), F.lit(0).alias("line_no"), F.lit("").alias("line"))
    lines = marked.withColumnRenamed("box_no", "line_no").select(*blank.columns).unionByName(blank)
    at = f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    write_label_folder(lines, shots.select(hash_split(stem).alias("split"), stem.alias("stem")), at)
    return read_label_folder(spark, at)


# --- detector quality -------------------------------------------------------------------------


def detection_pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    found = detections.pr_curve(X.boxes(spark, folder), X.labelled_boxes(spark, folder))
    return _rounded(found)


def detection_map(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(detections.detection_map(X.boxes(spark, folder), X.labelled_boxes(spark, folder)))


def detection_map_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = detections.detection_map(X.boxes(spark, folder), X.labelled_boxes(spark, folder))
    return _rounded(detections.map_summary(found))


def crowded_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches in pictures full of boxes, where many predictions are turned down; also at a small overlap."""
    predictions, truth = X.crowded_boxes(spark, folder), X.crowded_labels(spark, folder)
    return detections.match_boxes(predictions, truth, [0.2, 0.5, 0.75])


def crowded_map(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(detections.detection_map(X.crowded_boxes(spark, folder), X.crowded_labels(spark, folder)))


QUERIES = {
    f.__name__: f
    for f in (
        verdict_from_boxes, inspections, kpis, health, report_by_garment, report_by_defect,
        latest_8, alerts_5, latest_one, search_records, search_wildcards, search_wildcards_ai, search_ci_ai,
        validated_records, confusion_matrix, confusion_by_garment, code_collisions,
        garment_vocab_gap, vocabulary_violations, inspection_json, records_display,
        label_errors, label_error_preview, label_split_summary, missing_labels, orphan_labels,
        yolo_boxes, capture_name_parse, dataset_cube, duplicate_targets, slugs, hash_splits,
        holdout_splits,
        sequence_split, split_leak_check, top3_similarity, profile_stats, loo_threshold,
        loo_threshold_open, identify, identify_open, identify_pairs_open, patch_knn,
        image_anomaly_score, patch_map, coreset, score_gate, score_scale, dynamic_threshold,
        region_rank_topk, region_stats, localize_maps, localization_report, prepare_images, garment_mask,
        heuristic_detect, frame_motion, motion_candidates, auto_capture, station_status,
        live_kpis, capture_sessions, detection_pr_curve, detection_map, detection_map_summary,
        sessions_null_station, identify_blocks, identify_sparse_models, patch_knn_blocks, unit_vectors,
        crowded_matches, crowded_map, patch_knn_pivots, shaped_knn_pivots, shaped_knn_work,
        late_frames, stabilised_capture, capture_failures, coreset_union, label_round_trip,
        registered_twice, localize_masked, filtered_masks,
    )
}
