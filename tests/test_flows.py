"""Whole jobs, from pictures to records and reports."""

import numpy as np
from pyspark.sql import functions as F

from seamline.operators import anomaly, identity, images, localize, records
from seamline.operators.register import STATION, register
from seamline.sinks.tables import append_inspections, write_profiles
from seamline.sources.files import read_images
from seamline.sources.tables import read_inspections, read_profiles
from tests.pictures import png


def colour_model():
    """A loader that the workers get by value, as they cannot import this file."""

    def load():
        def predict(batch):
            return batch.reshape(len(batch), 3, -1).mean(axis=2) + 3.0

        return predict

    return load


def paint(path, colour, rng, spot=False):
    pixels = np.clip(rng.normal(colour, 4, (100, 100, 3)), 0, 255).astype(np.uint8)
    if spot:
        pixels[40:70, 20:50] = 10
    png(path, pixels)


def test_from_reference_images_to_records(spark, tmp_path):
    rng = np.random.default_rng(1)
    for i in range(11):
        paint(tmp_path / f"refs/red/r{i}.png", (200, 150, 150), rng)
    (tmp_path / "refs/red/broken.png").write_bytes(b"x")
    paint(tmp_path / "shots/0.png", (200, 150, 150), rng)
    paint(tmp_path / "shots/1.png", (200, 150, 150), rng, spot=True)
    paint(tmp_path / "shots/2.png", (60, 150, 220), rng)

    refs = read_images(spark, str(tmp_path / "refs")).select(
        F.lit("blusa_modelo_01").alias("model_name"), F.concat("stem", F.lit(".png")).alias("image_name"),
        "height", "width", "nChannels", "data",
    )
    gallery, profile = identity.build_profiles(refs, colour_model(), side=8)
    assert gallery.count() == 11 and profile.first().threshold == 0.9
    write_profiles(gallery, profile, str(tmp_path / "profile"))
    gallery, profile = read_profiles(spark, str(tmp_path / "profile"))
    gallery = gallery.withColumn("item_id", F.xxhash64("model_name", "image_name"))

    shots = read_images(spark, str(tmp_path / "shots"), source_kind="upload").withColumn("image_id", F.col("stem").cast("long"))
    vectors = images.embed_images(shots, ["image_id"], colour_model(), side=8)
    found = identity.identify(vectors.withColumnRenamed("image_id", "query_id"), gallery, profile.withColumn("threshold", F.lit(0.999)))
    captures = shots.select("image_id", "has_image").withColumn("captured_at", F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))
    rows = register(captures, images.heuristic_verdict(shots), found.withColumnRenamed("query_id", "image_id"), STATION)
    append_inspections(rows, str(tmp_path / "records"))

    stored = {r.id: r for r in read_inspections(spark, str(tmp_path / "records")).collect()}
    assert stored[1].garment_type == stored[2].garment_type == "blusa_modelo_01"
    assert stored[1].defect_type.startswith("Sin anomalía") and stored[2].defect_type.startswith("Anomalía visual")
    assert stored[2].zone == "Zona frontal"
    assert stored[3].garment_type == "Prenda no identificada" and stored[3].zone == "No aplica"
    figures = records.kpis(read_inspections(spark, str(tmp_path / "records"))).first()
    assert (figures.total, figures.review, figures.pending) == (3, 3, 3)


def test_from_patches_to_report(spark):
    rng = np.random.default_rng(2)
    bank = rng.normal(0, 0.05, (200, 6))
    patches = rng.normal(0, 0.05, (2, 64, 6))
    odd = [27, 28, 35, 36]  # the middle of an 8 x 8 grid in the second image
    patches[1, odd] += 3
    rows = [(i, n, i * 64 + n, [float(v) for v in patches[i, n]]) for i in range(2) for n in range(64)]
    table = spark.createDataFrame(rows, "image_id long, patch_no int, patch_id long, embedding array<float>")
    nominal = spark.createDataFrame([(i, [float(v) for v in bank[i]]) for i in range(200)], "item_id long, embedding array<float>")
    reduced = anomaly.coreset(nominal, 0.25)
    scores = anomaly.image_scores(table, reduced)
    maps = anomaly.patch_maps(table, anomaly.patch_distances(table, reduced), 8, 8)
    predictions = maps.join(scores.select("image_id", F.array(F.col("pred_score") / 10).alias("pred_score")), "image_id")
    masks = spark.createDataFrame(
        [(i, 64, 64, np.packbits(np.ones(64 * 64, bool)).tobytes()) for i in range(2)],
        "image_id long, mask_height int, mask_width int, mask binary",
    )
    report = {r.image: r for r in localize.report(localize.localize(predictions, masks, percentile=90.0)).collect()}
    assert not report["0"].has_anomaly and report["0"].region_count == 0
    region = report["1"].regions[0]
    assert report["1"].has_anomaly and report["1"].region_count == 1
    assert 22 <= region.x <= 30 and 22 <= region.y <= 30 and region.area > 50
