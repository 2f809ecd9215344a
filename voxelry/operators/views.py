"""The queries behind a viewer: which points a mode shows, in which colours, what is selected, and the track list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.operators import clustering
from voxelry.schemas import frame_key

LISTED = 15
#: Least opacity of the points that the opaque mode shows.
OPAQUE = 0.3
# Red, green, blue by class, and of classes that are not known; of boxes by how they were split, and if selected.
CLASS_RGB = {"car": (0.2, 0.6, 1.0), "pedestrian": (1.0, 0.3, 0.3), "bicyclist": (1.0, 0.8, 0.0), "background": (0.7, 0.7, 0.7)}
OTHER_RGB = (0.5, 0.5, 0.5)
GUIDED_RGB, SPLIT_RGB, SELECTED_RGB = (0.0, 1.0, 1.0), (1.0, 0.0, 1.0), (1.0, 1.0, 1.0)
#: Opacity of boxes beside a selected one, as a share of their own, and of boxes of unknown class.
DIM, UNKNOWN_BOX = 0.25, 0.7
# Ground, points without cluster, and clusters by whether they are background, as (r, g, b, alpha) or alpha, by palette.
PALETTES = {
    "clusters": {"ground": (0.1, 0.8, 0.1, 0.6), "loose": (0.2, 0.2, 0.2, 0.3), "background": 1.0, "object": 1.0},
    "tracks": {"ground": (0.1, 0.8, 0.1, 0.5), "loose": (0.15, 0.15, 0.15, 0.2), "background": 0.7, "object": 1.0},
}


def _rgba(rgb: tuple[float, float, float], alpha: float | Column) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("rgb", rgb, strict=True)], (F.lit(alpha) if isinstance(alpha, float) else alpha).alias("alpha"))


def point_colour(is_ground: Column, has_cluster: Column, class_label: Column, palette: str = "tracks") -> Column:
    """r, g, b, alpha of a point: of the ground, of its cluster's class, or dim if it has no cluster.

    A cluster without class counts as background, an unknown class is grey. Ground goes before clusters; null flags count as false.
    """
    if palette not in PALETTES:
        raise ValueError(f"no palette {palette}")
    of, known = PALETTES[palette], F.coalesce(class_label, F.lit("background"))
    colour = _rgba(OTHER_RGB, of["object"])
    for name, rgb in CLASS_RGB.items():
        colour = F.when(known == name, _rgba(rgb, of["background" if name == "background" else "object"])).otherwise(colour)
    *ground, ground_alpha = of["ground"]
    *loose, loose_alpha = of["loose"]
    return F.when(is_ground, _rgba(ground, ground_alpha)).when(has_cluster, colour).otherwise(_rgba(loose, loose_alpha))


def box_colour(class_label: Column, was_split: Column, track_guided: Column, is_selected: Column, any_selected: Column) -> Column:
    """r, g, b, alpha of a box: white if selected, else by how it was split, else by class; dim where another one is selected.

    Null flags count as false; boxes of unknown class are grey and less opaque.
    """
    alpha = lambda own: F.when(any_selected, F.lit(own * DIM)).otherwise(F.lit(own))
    colour = _rgba(CLASS_RGB["background"], alpha(UNKNOWN_BOX))
    for name, rgb in CLASS_RGB.items():
        if name != "background":
            colour = F.when(class_label == name, _rgba(rgb, alpha(1.0))).otherwise(colour)
    return F.when(is_selected, _rgba(SELECTED_RGB, 1.0)).when(track_guided, _rgba(GUIDED_RGB, alpha(1.0))).when(was_split, _rgba(SPLIT_RGB, alpha(1.0))).otherwise(colour)


def wireframe(boxes: DataFrame, selected: Column | None = None) -> DataFrame:
    """edge, x1..z2, r, g, b, alpha of the boxes (x_min..z_max, class_label, was_split, track_guided) of objects, 12 rows each.

    ``selected`` marks the selected box of a frame; others of its frame are dim. Background and boxes without class have
    no edges, but count as selected. Other columns are kept.
    """
    chosen = F.lit(False) if selected is None else F.coalesce(selected, F.lit(False))
    rows = boxes.withColumn("__chosen", chosen)
    some = F.lit(False) if selected is None else F.max("__chosen").over(Window.partitionBy(*frame_key(boxes)))
    rows = rows.withColumn("__some", some).where("class_label <> 'background'")
    rows = rows.withColumn("__colour", box_colour(*[F.col(c) for c in ("class_label", "was_split", "track_guided", "__chosen", "__some")]))
    return clustering.bbox_edges(rows).select("*", "__colour.*").drop("__colour", "__chosen", "__some")


def shown(mode: str) -> Column:
    """Whether a mode shows a point; needs is_ground, and label, alpha, is_object, is_tracked where the mode names them."""
    modes = {
        "all": F.lit(True), "ground": F.col("is_ground"), "other": ~F.col("is_ground"), "clusters": F.col("label").isNotNull(),
        "objects": F.col("is_object"), "tracked": F.col("is_tracked"), "opaque": F.col("alpha") > OPAQUE,
    }
    if mode not in modes:
        raise ValueError(f"no mode {mode}")
    return modes[mode]


def selected(points: DataFrame, x: float, y: float, xy_spread: float) -> DataFrame:
    """The points around a selected cluster's centre, within its width but a metre at least."""
    dx, dy = F.col("x") - x, F.col("y") - y
    return points.where(F.sqrt(dx * dx + dy * dy) < max(xy_spread, 1.0))


def track_list(tracks: DataFrame, n: int = LISTED) -> DataFrame:
    """The first ``n`` of a frame's tracks by id, for each sensor, and how many ``more`` there are; a bounded list, as a viewer prints it."""
    by = Window.partitionBy("sensor_id")
    ranked = tracks.withColumn("nth", F.row_number().over(by.orderBy("track_id"))).withColumn("more", F.greatest(F.count(F.lit(1)).over(by) - n, F.lit(0)))
    return ranked.where(F.col("nth") <= n).drop("nth")
