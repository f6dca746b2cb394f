"""From detector boxes to one verdict per image, and detector quality against labelled boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seamline import schema as S
from seamline.functions.geometry import box_iou, zone
from seamline.functions.scores import BOX_FLOOR, CLEAN_CONFIDENCE, DEFECT_PERCENT, percent, status_of
from seamline.operators.ordered import ordered_runs, with_history
from seamline.session import cut_lineage

IOU_THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]


def class_names(spark: SparkSession, names: dict[int, str] | None = None) -> DataFrame:
    rows = sorted((names or S.CLASS_NAMES).items())
    return spark.createDataFrame(rows, "class_id int, class_name string")


def class_name(class_id: Column, names: dict[int, str] | None = None) -> Column:
    """Name of a class from the fixed dictionary; unknown classes get the fallback."""
    known = F.lit(None).cast("string")
    for number, name in (names or S.CLASS_NAMES).items():
        known = F.when(class_id == number, name).otherwise(known)
    return F.coalesce(known, F.lit(S.VISIBLE_DEFECT))


def best_box(boxes: DataFrame, floor: float = BOX_FLOOR) -> DataFrame:
    """Most confident box of each image at or above ``floor``; the first box wins a tie.

    An arg-max aggregate, so partial results are combined before the shuffle and images with very
    many boxes do not weigh on one task.
    """
    kept = boxes.filter(F.col("conf") >= floor)
    box = F.struct("box_no", "class_id", "conf", "x1", "y1", "x2", "y2", "img_w", "img_h")
    rank = F.struct(F.col("conf"), -F.col("box_no"))
    best = kept.groupBy("image_id").agg(F.max_by(box, rank).alias("best"))
    return best.select("image_id", "best.*")


def verdict_from_boxes(
    images: DataFrame,
    boxes: DataFrame,
    names: dict[int, str] | None = None,
    floor: float = BOX_FLOOR,
    defect_percent: float = DEFECT_PERCENT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One verdict per image; images without a box at or above the floor are approved.

    ``keep`` carries further image columns along, so that registration needs no second join.
    """
    best = best_box(boxes, floor)
    joined = images.select("image_id", *keep).join(best, "image_id", "left")
    clean = F.col("conf").isNull()
    center = (F.col("x1") + F.col("x2")) / 2
    return joined.select(
        "image_id",
        *keep,
        F.when(clean, S.APPROVED).otherwise(status_of(F.col("conf"), defect_percent)).alias("status"),
        F.when(clean, S.NO_DEFECT)
        .otherwise(class_name(F.col("class_id"), names))
        .alias("defect_type"),
        F.when(clean, CLEAN_CONFIDENCE).otherwise(percent(F.col("conf"))).alias("confidence"),
        F.when(clean, S.ZONE_CENTER).otherwise(zone(center, F.col("img_w"))).alias("zone"),
        F.when(clean, "clean").otherwise("class_score").alias("confidence_kind"),
    )


IMAGE_CLASS = ["image_id", "class_id"]


def _clamped(boxes: DataFrame) -> DataFrame:
    """Corners moved into the picture, where the rows say how large it is."""
    limits = {"x": "img_w", "y": "img_h"}
    for corner in ("x1", "y1", "x2", "y2"):
        limit = limits[corner[0]]
        if limit in boxes.columns:
            boxes = boxes.withColumn(corner, F.greatest(F.lit(0.0), F.least(F.col(corner), F.col(limit).cast("double"))))
    return boxes


def _candidate_pairs(predictions: DataFrame, truth: DataFrame, least: float, cell: int) -> DataFrame:
    """Pairs of one image and class that overlap by ``least`` or more, each pair once, with their overlap.

    Boxes meet in grid cells. An overlap of at least one half covers half of the labelled width and height, hence
    the labelled centre: then the labelled box goes to the cell of its centre only and the prediction to the cells
    it touches. For smaller overlaps both go to all cells they touch, and a pair counts in the cell that holds the
    top left corner of what they share.
    """

    def cells(low: str, high: str) -> Column:
        first, last = F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)
        return F.explode(F.sequence(first, F.greatest(first, last)))

    corners = ["x1", "y1", "x2", "y2"]
    p = _clamped(predictions).select(*IMAGE_CLASS, "box_no", "conf", *[F.col(c).alias("p_" + c) for c in corners])
    p = p.withColumn("cx", cells("p_x1", "p_x2")).withColumn("cy", cells("p_y1", "p_y2"))
    t = _clamped(truth).select(*IMAGE_CLASS, "truth_no", *[F.col(c).alias("t_" + c) for c in corners])
    if least >= 0.5:
        t = t.withColumn("cx", F.floor((F.col("t_x1") + F.col("t_x2")) / 2 / cell))
        t = t.withColumn("cy", F.floor((F.col("t_y1") + F.col("t_y2")) / 2 / cell))
        once = F.lit(True)
    else:
        t = t.withColumn("cx", cells("t_x1", "t_x2")).withColumn("cy", cells("t_y1", "t_y2"))
        once = (F.floor(F.greatest("p_x1", "t_x1") / cell) == F.col("cx")) & (F.floor(F.greatest("p_y1", "t_y1") / cell) == F.col("cy"))
    joined = p.join(t, [*IMAGE_CLASS, "cx", "cy"]).filter(once)
    pairs = joined.select(*IMAGE_CLASS, "box_no", "conf", "truth_no", box_iou("p_", "t_").alias("overlap"))
    return pairs.filter(F.col("overlap") >= least)


#: Proposals of a round that are broadcast, and results of rounds that are kept side by side.
FEW, WRITTEN = 100_000, 8


def _all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def match_boxes(
    predictions: DataFrame, truth: DataFrame, thresholds: list[float] | None = None, cell: int = 128
) -> DataFrame:
    """Predictions that hit a labelled box, one row per overlap threshold: iou, image_id, class_id, truth_no, box_no, conf.

    Deferred acceptance, once for every threshold: a prediction proposes to the labelled box of its image and class
    that it overlaps most, a labelled box keeps the most confident proposal, and a prediction that was turned down
    proposes to its next choice, until nothing changes. As all boxes rank predictions alike, this is what taking the
    predictions by falling confidence gives, each the free box it overlaps most. Equal overlaps go to the smaller
    truth_no, equal confidences to the smaller box_no.

    A round looks only at the labelled boxes that get new proposals: one arg-max aggregate over what these have kept and
    the proposals, written beside what earlier rounds wrote. Of what is written for a labelled box the best counts, and
    only predictions that were turned down go on. ``predictions``: image_id, box_no, class_id, conf, corners, and if given img_w and img_h, which the
    corners are clamped to; ``truth``: image_id, truth_no, class_id and corners. Thresholds are above zero.
    """
    thresholds = thresholds or [0.5]
    if min(thresholds) <= 0:
        raise ValueError("overlap thresholds must be above zero")
    liked = Window.partitionBy(*IMAGE_CLASS, "box_no").orderBy(F.desc("overlap"), "truth_no")
    pairs = _candidate_pairs(predictions, truth, min(thresholds), cell)
    ranked = cut_lineage(pairs.withColumn("choice", F.row_number().over(liked)))
    passed = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("overlap"))
    made = ranked.filter("choice = 1").withColumn("iou", F.explode(passed))
    columns = ["iou", *IMAGE_CLASS, "truth_no", "box_no", "conf", "choice"]
    later = ranked.filter("choice > 1")
    one, label = ["iou", *IMAGE_CLASS, "box_no"], ["iou", *IMAGE_CLASS, "truth_no"]
    best = F.max_by(F.struct("box_no", "conf", "choice"), F.struct(F.col("conf"), -F.col("box_no"))).alias("hit")

    def winners(standing: DataFrame) -> DataFrame:
        return standing.groupBy(*label).agg(best).select(*label, "hit.*")

    proposals, written, few = made.select(*columns), [], lambda rows: rows
    while True:
        standing = proposals
        if written:
            asked = few(proposals.select(*label).distinct())
            standing = winners(_all_of(written).join(asked, label, "left_semi")).unionByName(proposals)
        won = cut_lineage(winners(standing))
        turned_down = standing.join(few(won.select(*one)), one, "left_anti")
        again = turned_down.select(*one, (F.col("choice") + 1).alias("choice"))
        proposals = later.join(few(again), [*IMAGE_CLASS, "box_no", "choice"]).filter("overlap >= iou").select(*columns)
        proposals = cut_lineage(proposals)
        written.append(won)
        if len(written) > WRITTEN:  # the first one is by far the largest
            written = [written[0], cut_lineage(winners(_all_of(written[1:])))]
        waiting = proposals.count()
        if not waiting:
            return winners(_all_of(written)).drop("choice")
        few = F.broadcast if waiting <= FEW else few


def pr_curve(
    predictions: DataFrame, truth: DataFrame, thresholds: list[float] | None = None
) -> DataFrame:
    """Precision and recall at every distinct confidence, per overlap threshold and class.

    Equal confidences are one step of the curve and are summed first; the running totals then use
    sorted runs, since classes are far too few keys to partition by.
    """
    thresholds = thresholds or [0.5]
    hits = match_boxes(predictions, truth, thresholds)
    tp = hits.groupBy("iou", "class_id", "conf").agg(F.count("*").alias("tp"))
    seen = predictions.groupBy("class_id", "conf").agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    steps = seen.withColumn("iou", grid).join(tp, ["iou", "class_id", "conf"], "left")
    steps = steps.select(
        "iou", "class_id", (-F.col("conf")).alias("order"), "conf", "n", F.coalesce("tp", F.lit(0)).alias("tp")
    )
    runs = ordered_runs(steps, ["iou", "class_id"], ["order"])
    sums = {"tp": "cum_tp", "n": "cum_n"}
    summed = with_history(runs, ["iou", "class_id"], ["order"], totals=sums)
    wanted = truth.groupBy("class_id").agg(F.count("*").alias("positives"))
    joined = summed.join(wanted, "class_id", "left").na.fill(0, ["positives"])
    return joined.select(
        "iou",
        "class_id",
        "conf",
        "cum_tp",
        "cum_n",
        "positives",
        (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
        F.coalesce(F.try_divide("cum_tp", "positives"), F.lit(0.0)).alias("recall"),
    )


def detection_map(
    predictions: DataFrame, truth: DataFrame, thresholds: list[float] | None = None
) -> DataFrame:
    """Average precision per class at each overlap threshold, by the 101-point rule.

    AP = mean over r in {0, .01, .., 1} of the best precision among curve steps with recall >= r.
    A step serves the recall levels up to its own, so the best precision per top level is a grouped
    maximum, and a class keeps at most 101 rows for the running maximum that follows.
    """
    thresholds = thresholds or IOU_THRESHOLDS
    curve = pr_curve(predictions, truth, thresholds).filter(F.col("positives") > 0)
    level = F.expr("cast(cum_tp * 100 div positives as int)")
    best = curve.groupBy("iou", "class_id", level.alias("level")).agg(
        F.max("precision").alias("precision")
    )
    down = Window.partitionBy("iou", "class_id").orderBy(F.desc("level"))
    envelope = best.select(
        "iou",
        "class_id",
        (F.col("level") - F.coalesce(F.lead("level").over(down), F.lit(-1))).alias("width"),
        F.max("precision").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("precision"),
    )
    summed = envelope.groupBy("iou", "class_id").agg(
        (F.sum(F.col("width") * F.col("precision")) / 101).alias("ap")
    )
    wanted = truth.groupBy("class_id").agg(F.count("*").alias("positives"))
    grid = wanted.withColumn("iou", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return grid.join(summed, ["iou", "class_id"], "left").select(
        "class_id", "iou", "positives", F.coalesce("ap", F.lit(0.0)).alias("ap")
    )


def map_summary(average_precision: DataFrame) -> DataFrame:
    """mAP50 and mAP50-95 over the classes that have labelled boxes."""
    return average_precision.agg(
        F.avg(F.when(F.col("iou") == 0.50, F.col("ap"))).alias("map50"),
        F.avg("ap").alias("map50_95"),
    )
