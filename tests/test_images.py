import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seamline.functions import raster
from seamline.operators import dataset, images
from seamline.sinks.tables import write_prepared
from seamline.sources.files import list_images, read_images, relative_path
from tests.pictures import png


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    rgba = np.zeros((20, 30, 4), np.uint8)
    rgba[5:15, 5:25] = (200, 100, 50, 255)
    png(root / "images/train/a.PNG", rgba)
    png(root / "images/train/b.png", np.full((8, 6, 3), (10, 20, 30), np.uint8))
    png(root / "images/val/deep/c.png", np.full((4, 4), 90, np.uint8))
    clear = rgba.copy()
    clear[..., 3] = 10
    png(root / "images/val/clear.png", clear)
    (root / "images/train/broken.jpg").write_bytes(b"not a picture")
    (root / "images/train/notes.txt").write_text("x")
    return str(root / "images")


def test_listing(spark, folder):
    found = list_images(spark, folder).orderBy("path").collect()
    assert [(r.split, r.stem) for r in found] == [
        ("train", "a"), ("train", "b"), ("train", "broken"), ("val", "clear"), ("val", "c"),
    ]
    assert list_images(spark, folder + "/val", recursive=False).count() == 1
    assert list_images(spark, folder, extensions=["jpg"]).count() == 1


def test_reading(spark, folder):
    found = {r.stem: r for r in read_images(spark, folder).collect()}
    assert (found["a"].nChannels, found["b"].nChannels, found["c"].nChannels) == (4, 3, 1)
    assert not found["broken"].has_image and found["a"].has_image
    b = found["b"]
    assert raster.decode(b.data, b.height, b.width, b.nChannels)[0, 0].tolist() == [10, 20, 30]
    a = found["a"]
    assert raster.decode(a.data, a.height, a.width, a.nChannels)[5, 5].tolist() == [200, 100, 50, 255]
    c = found["c"]
    assert raster.decode(c.data, c.height, c.width, c.nChannels)[0, 0].tolist() == [90, 90, 90]


def test_prepare(spark, folder, tmp_path):
    source = read_images(spark, folder).withColumn("relative", relative_path(F.col("path"), folder))
    done = images.prepare_images(source, ["relative", "split"], size=40)
    rows = {r.relative: r for r in done.collect()}
    assert rows["train/broken.jpg"].status == rows["val/clear.png"].status == "failed"
    assert "alpha" in rows["val/clear.png"].error
    boxed = raster.decode(rows["train/a.PNG"].data, 40, 40, 3)
    # 20 x 10 object and a margin of one: 22 x 12 fit into 40 as 40 x 22
    assert boxed[20, 20].tolist() == [200, 100, 50] and boxed[8, 20].tolist() == [205] * 3
    summary = {r.status: r["images"] for r in images.preparation_summary(done).collect()}
    assert summary == {"success": 3, "failed": 2}
    write_prepared(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("split = 'train'").count() == 2


def test_orientation_column(spark):
    pixels = np.zeros((2, 4, 3), np.uint8)
    pixels[0, 0] = 255
    row = pd.DataFrame({"k": [1], "height": [2], "width": [4], "nChannels": [3], "data": [pixels.tobytes()], "orientation": [6]})
    schema = "k int, height int, width int, nChannels int, data binary, orientation int"
    done = images.prepare_images(spark.createDataFrame(row, schema), ["k"], size=4).first()
    turned = raster.decode(done.data, 4, 4, 3)
    assert turned[0, 2].tolist() == [255] * 3  # turned clockwise: the top left corner is at the top right


def test_duplicate_targets(spark):
    files = spark.createDataFrame([("x/a.jpg",), ("x/a.png",), ("y/a.png",)], "relative_path string")
    found = dataset.duplicate_targets(files).collect()
    assert [(r.target, r.sources) for r in found] == [("x/a.png", 2)]


SCHEMA = "image_id long, height int, width int, nChannels int, data binary"


def picture(spark, *arrays):
    rows = [(i, a.shape[0], a.shape[1], 3, a[:, :, ::-1].tobytes()) for i, a in enumerate(arrays)]
    return spark.createDataFrame([*rows, (99, -1, -1, -1, None)], SCHEMA)


def test_heuristic_verdict(spark):
    plain = np.full((200, 300, 3), 180, np.uint8)
    dark, small, coloured = plain.copy(), plain.copy(), plain.copy()
    dark[80:120, 40:80] = 20
    small[80:92, 40:52] = 20
    coloured[60:100, 240:262] = (200, 20, 20)
    found = {r.image_id: r for r in images.heuristic_verdict(picture(spark, plain, dark, small, coloured)).collect()}
    assert {r.status for r in found.values()} == {"Revisar"}
    assert (found[0].defect_type, found[0].confidence, found[0].zone) == (
        "Sin anomalía evidente (modo prototipo)", 0.0, "Centro",
    )
    # 40 x 40 grows by two on each side; its outline is 43 x 43
    assert found[1].confidence == round(min(95, 70 + 43 * 43 / 60000 * 900), 2)
    assert found[1].zone == "Lateral izquierdo"
    assert found[2].confidence == 0.0  # 15 x 15 is not above 250
    assert found[3].zone == "Lateral derecho"
    assert (found[99].defect_type, found[99].zone) == ("Imagen no válida", "No definida")


def test_empty_region_of_interest_is_an_error_row(spark):
    plain = np.full((20, 30, 3), 180, np.uint8)
    found = images.frame_signals(picture(spark, plain), ["image_id"], roi=(0.9, 0.1, 0.2, 0.9))
    assert {r.image_id: r.error for r in found.collect()}[0] == "the region of interest is empty"


def test_masks_of_unreadable_images_are_null(spark):
    image = np.full((40, 40, 3), 205, np.uint8)
    image[10:30, 10:30] = 0
    found = {r.image_id: r for r in images.garment_masks(picture(spark, image)).collect()}
    assert found[0].pixels == 400 and found[99].mask is None and found[99].error


def test_frame_signal_and_motion(spark):
    still = np.full((100, 100, 3), 50, np.uint8)
    moved = still.copy()
    moved[:, 50:] = 200
    signals = images.frame_signals(picture(spark, still, moved), ["image_id"]).toPandas().set_index("image_id")["signal"]
    assert len(signals[0]) == 80 * 80
    changed = images.changed_pixels(signals[0], signals[1])
    assert 80 * 36 < changed < 80 * 48
    assert images.changed_pixels(signals[0], signals[0]) == 0
    with pytest.raises(ValueError):
        images.changed_pixels(b"ab", b"abc")


@pytest.mark.parametrize("runs", [1, 4])
def test_frame_motion(spark, runs):
    rng = np.random.default_rng(8)
    frames = [rng.integers(0, 255, (40, 50, 3)).astype(np.uint8) // 64 * 64 for _ in range(12)]
    frames = [np.kron(f[:4, :5], np.ones((10, 10, 1))).astype(np.uint8) for f in frames]
    rows = [(i % 3 == 0, i, i, *f.shape, f[:, :, ::-1].tobytes()) for i, f in enumerate(frames)]
    rows[7] = (*rows[7][:3], -1, -1, -1, None)
    table = spark.createDataFrame(rows, "hot boolean, ts_us long, n long, height int, width int, nChannels int, data binary")
    found = {r.n: r.changed_pixels for r in images.frame_motion(table, "hot", "ts_us", "n", runs=runs).collect()}

    def signal(f):
        return raster.blur(raster.gray(f[4:36, 5:45])).astype(int)

    for hot in (True, False):
        own = [r[1] for r in rows if r[0] == hot and r[6] is not None]
        assert found[own[0]] is None
        for a, b in zip(own, own[1:]):
            assert found[b] == (np.abs(signal(frames[a]) - signal(frames[b])) > 25).sum()
    assert 7 not in found


def test_embedding_through_a_user_model(spark, folder):
    def load():
        import numpy as np

        def predict(batch):
            return np.stack([[t[0].mean() + 3, t[2].mean() + 3] for t in batch.reshape(len(batch), 3, -1)])

        return predict

    found = images.embed_images(read_images(spark, folder), ["stem"], load, side=8).toPandas()
    assert len(found) == 4  # the broken one is left out
    assert np.allclose([np.linalg.norm(v) for v in found["embedding"]], 1, atol=1e-6)


def test_model_inputs(spark):
    flat = np.full((10, 20, 3), (255, 0, 0), np.uint8)
    row = images.model_inputs(picture(spark, flat), ["image_id"], side=4).filter("image_id = 0").first()
    tensor = np.array(row.tensor).reshape(3, 4, 4)
    red = (np.array([1.0, 0, 0]) - images.CHANNEL_MEAN) / images.CHANNEL_STD
    assert np.allclose(tensor[:, 2, 2], tensor[:, 2, 1]) and np.allclose(tensor[:, 1, 1], tensor[:, 2, 1])
    gray = (np.array([220, 220, 220]) / 255 - images.CHANNEL_MEAN) / images.CHANNEL_STD
    inner, outer = tensor[:, 1, 1], tensor[:, 0, 0]
    assert (np.abs(inner - red) < np.abs(gray - red)).all() and np.allclose(outer, gray, atol=0.7)
