"""Checks on incoming requests: ranges, references, finishes and boxes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import clamp_box, is_degenerate
from ..functions.colour import f0_of_ior, grazing_reflectance
from ..functions.numeric import _c
from ..scale import GROUP_ROWS, attach, hot_keys, hot_metric, settle, settled, skew_join

# Literals and ranges of the request model.
KINDS = ("floor", "object", "image3d")
FINISHES = ("smooth-matte", "smooth-glossy")
REGIONS = ("mask", "dilated", "box", "full")
M_PER_1000PX = 5.0
MATERIAL_FIELDS = ("albedo", "roughness", "ior", "coat", "coat_roughness", "delight")


def validate_specs(specs: DataFrame, removals: list[str] | None = None, insertions: list[str] | None = None) -> DataFrame:
    """Each request with the names of the fields that break a rule of its kind.

    Ids are required. Any other field may be missing, as a column or as a value, and then takes its default. Backends must
    be among `removals` and `insertions`, by default those that are registered.
    """
    from .. import registry                      # the registry imports operators that import this module
    have, kind = set(specs.columns), F.col("kind")
    among = lambda *v: (lambda c: c.isin(*v))
    between = lambda lo, hi: (lambda c: c.between(lo, hi))
    required = {"floor": ("scene_id", "pattern_id"), "object": ("scene_id",), "image3d": ("scene_id", "mask_id")}
    ranges = {
        "floor": {"material": among(*FINISHES), "m_per_1000px": lambda c: (c > 0) & (c <= 100)},
        "object": {"removal": among(*(removals or registry.names("removal"))), "insertion": among(*(insertions or registry.names("insertion"))),
                   "src_region": among(*REGIONS), "dst_region": among(*REGIONS), "region_margin": between(0, 2), "sr_factor": among(1, 2, 3, 4),
                   "omnipaint_mode": among("window", "full"), "omnipaint_res": between(256, 1536), "omnipaint_steps": between(1, 50)},
        "image3d": {"ss_steps": between(1, 50), "slat_steps": between(1, 50)},
    }

    def value(field):
        return F.col(field) if field in have else F.lit(None)
    rules = [F.when(kind.isNull() | ~kind.isin(*KINDS), F.lit("kind"))]
    for of in KINDS:
        rules += [F.when((kind == of) & value(f).isNull(), F.lit(f)) for f in required[of]]
        if of == "object":
            rules.append(F.when((kind == of) & (F.coalesce(value("n_moves"), F.lit(0)) < 1), F.lit("moves")))
        rules += [F.when((kind == of) & F.col(f).isNotNull() & ~ok(F.col(f)), F.lit(f)) for f, ok in ranges[of].items() if f in have]
    errors = F.filter(F.array(*rules), lambda e: e.isNotNull())
    return specs.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def resolve_material(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Preset values overridden by the non-null columns of the request, f0, and whether the finish gains energy."""
    named = presets.select(F.col("name").alias("material"), *[F.col(f).alias(f"_{f}") for f in MATERIAL_FIELDS])
    both = attach(requests, named, ["material"], "left")
    have = set(requests.columns)
    out = both.withColumns({f: F.coalesce(F.col(f), F.col(f"_{f}")) if f in have else F.col(f"_{f}") for f in MATERIAL_FIELDS})
    out = out.drop(*[f"_{f}" for f in MATERIAL_FIELDS]).withColumn("f0", f0_of_ior("ior"))
    grazing = grazing_reflectance("f0", "roughness")
    energy = (F.lit(1.0) - grazing) * F.col("albedo") + grazing
    return out.withColumn("energy_max", energy).withColumn("gains_energy", energy > 1.0)


def default_tile_m(width_px, m_per_1000px=M_PER_1000PX) -> Column:
    """Repeat width of a pattern whose physical size is unknown."""
    return _c(width_px) / 1000.0 * _c(m_per_1000px)


def tile_extent(tile_m, width_px, height_px, m_per_1000px=M_PER_1000PX) -> tuple[Column, Column]:
    """Metric footprint of one repeat; the height follows the aspect of the picture."""
    su = F.coalesce(_c(tile_m), default_tile_m(width_px, m_per_1000px))
    return su, su * (_c(height_px) / _c(width_px))


def clamp_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes limited to their frame; those under 2 px in a direction are marked."""
    c = clamp_box("x0", "y0", "x1", "y1", "w", "h")
    return boxes.withColumns(c).withColumn("degenerate", is_degenerate("x0", "y0", "x1", "y1"))


def resolve_refs(moves: DataFrame, masks: DataFrame, scenes: DataFrame, hot_rows: int = GROUP_ROWS) -> DataFrame:
    """Moves with their scene and mask, and what is wrong with the reference, if anything.

    Many moves may name one mask or one scene, or none, so both joins deal out hot and null ids. The moves are written once and both kinds
    of id are sketched while that is done; the row numbers they get serve both joins.
    """
    known_mask = masks.select("mask_id", "n_px", "mask_w", "mask_h", F.lit(True).alias("_mask"))
    known_scene = scenes.select("scene_id", "width", "height", F.lit(True).alias("_scene"))
    once = settle(moves, "moves", scene=hot_metric(["scene_id"]), mask=hot_metric(["mask_id"]))
    hot = {c: hot_keys(settled(once)[c], hot_rows) for c in ("scene", "mask")}
    numbered = once.withColumn("_move", F.monotonically_increasing_id())
    both = skew_join(numbered, known_scene, ["scene_id"], "left", hot_rows, hot=hot["scene"], row="_move")
    both = skew_join(both, known_mask, ["mask_id"], "left", hot_rows, hot=hot["mask"], row="_move")
    error = (F.when(F.col("_scene").isNull(), "unknown scene").when(F.col("_mask").isNull(), "unknown mask")
             .when((F.col("mask_w") != F.col("width")) | (F.col("mask_h") != F.col("height")), "mask size differs")
             .when(F.col("n_px") == 0, "mask is empty"))
    return both.withColumn("error", error).drop("_mask", "_scene", "_move")
