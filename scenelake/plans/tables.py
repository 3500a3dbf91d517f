"""Scene tables derived from the given relational tables; `oracle_tables` states the same tables in SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.raster import explode_raster

WIDTH, HEIGHT = 64, 50
RGB_WIDTH = 22
CAMERA = {"fx": 20.0, "fy": 20.0, "cx": 32.0, "cy": 25.0}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the given tables hold them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"})


def _i(c):
    return c.cast("int")


def images(spark, sf):
    return read(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / HEIGHT).alias("image_id")).distinct().select(
        "image_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def rgb_images(spark, sf):
    return images(spark, sf).select("image_id", F.lit(RGB_WIDTH).alias("width"), "height")


def raster(spark, sf):
    lines = read(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / HEIGHT).alias("image_id"), _i(F.col("vec_id") % HEIGHT).alias("y"), "embedding")
    return explode_raster(lines, "embedding", ["image_id", "y"])


def mask(spark, sf):
    px = raster(spark, sf)
    which = F.filter(F.array(F.when(F.col("v") > 0.05, 0), F.when(F.col("v") > 0.1, 1)), lambda m: m.isNotNull())
    return px.select("image_id", F.explode(which).alias("mask_id"), "y", "x")


def one_mask(spark, sf, mask_id=0):
    return raster(spark, sf).where(F.col("v") > (0.05, 0.1)[mask_id]).select("image_id", "y", "x")


def votes(spark, sf):
    passes = F.explode(F.array(*[F.lit(p) for p in range(3)]))
    p = F.col("pass_id")
    return raster(spark, sf).withColumn("pass_id", passes).select(
        "image_id", "pass_id", (p == 2).alias("mirrored"), "y",
        _i(F.when(p == 2, WIDTH - 1 - F.col("x")).otherwise(F.col("x"))).alias("x"),
        (F.col("v") > F.lit(0.04) + F.lit(0.01) * p).alias("v"))


def rgb(spark, sf):
    """Three neighbouring columns make one pixel; the last column, left alone, is grey."""
    px = raster(spark, sf).withColumn("c", F.least(F.greatest(F.col("v") * 2 + 0.5, F.lit(0.0)), F.lit(1.0)))

    def channel(i):
        return F.max(F.when(F.col("x") % 3 == i, F.col("c")))
    wide = px.groupBy("image_id", "y", _i(F.floor(F.col("x") / 3)).alias("x3")).agg(
        channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))
    return wide.select("image_id", "y", F.col("x3").alias("x"), "r", F.coalesce("g", "r").alias("g"),
                       F.coalesce("b", "r").alias("b"))


def frames(spark, sf):
    px = rgb(spark, sf)
    inside = F.col("x").between(5, 12) & F.col("y").between(10, 25)
    u8 = {c: _i(F.floor(F.col(c) * 255)) for c in "rgb"}
    return px.select("image_id", "y", "x", u8["r"].alias("r0"), u8["g"].alias("g0"), u8["b"].alias("b0"),
                     _i(F.least(u8["r"] + F.when(inside, F.col("x") % 6).otherwise(0), F.lit(255))).alias("r1"),
                     u8["g"].alias("g1"), u8["b"].alias("b1"))


def frame_before(spark, sf):
    return frames(spark, sf).select("image_id", "y", "x", F.col("r0").alias("r"), F.col("g0").alias("g"), F.col("b0").alias("b"))


def frame_after(spark, sf):
    return frames(spark, sf).select("image_id", "y", "x", F.col("r1").alias("r"), F.col("g1").alias("g"), F.col("b1").alias("b"))


def tex(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.floor(F.col("p_partkey") / 32).cast("int").alias("ty"), _i(F.col("p_partkey") % 32).alias("tx"),
                    (F.col("p_size") / 50.0).alias("r"), ((F.col("p_retailprice") % 100) / 100).alias("g"),
                    ((F.col("p_partkey") % 17) / 17.0).alias("b"))


def scores(spark, sf):
    px = raster(spark, sf)
    w = WIDTH - 1 - F.col("x")
    a = px.select("image_id", F.lit("a").alias("model"), "y", _i(F.floor(F.col("x") / 8)).alias("x"),
                  _i(F.col("x") % 8).alias("class_id"), F.col("v").alias("logit"))
    b = px.select("image_id", F.lit("b").alias("model"), "y", _i(F.floor(w / 8)).alias("x"),
                  _i(w % 8).alias("class_id"), F.col("v").alias("logit"))
    return a.union(b)


def classes(spark, sf):
    """Class names in the dictionary style 'first, synonym'."""
    return read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("class_id"), F.concat_ws(", ", F.lower("n_name"), F.lit("other")).alias("name"))


def prop(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                                 "l_extendedprice", "l_discount", "l_tax")
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"), (F.row_number().over(w) - 1).cast("bigint").alias("k"),
        F.round(F.lit(1.0) - F.lit(6.0) * F.col("l_discount"), 2).alias("iou"),
        (F.col("l_quantity") * 100).cast("bigint").alias("area"), F.lit(10000).alias("frame_px"))


def points(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("scene_id"), F.col("l_quantity").alias("px"),
                     (F.col("l_extendedprice") / 1000).alias("py"), (F.col("l_discount") * 100 + 1).alias("pz"),
                     (F.col("l_tax") < 0.07).alias("valid"),
                     F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("point_id"))


def depth(spark, sf):
    return raster(spark, sf).select("image_id", "y", "x", (F.col("v") + 3).alias("z"), (F.col("v") < 0.2).alias("valid"))


def anchors(spark, sf):
    s = read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("move_id"), (k % image_count(spark, sf)).alias("image_id"), _i(F.col("s_nationkey") * 2).alias("src_x"),
                    _i(k % 50).alias("src_y"), _i(63 - F.col("s_nationkey")).alias("dst_x"), _i((k * 7) % 50).alias("dst_y"))


def vertices(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.floor(F.col("p_partkey") / 50).alias("mesh_id"), (F.col("p_partkey") % 50).alias("vid"),
                    F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"),
                    (F.col("p_partkey") % 37).cast("double").alias("z"))


def faces(spark, sf):
    return vertices(spark, sf).select(
        "mesh_id", F.col("vid").alias("fid"), F.col("vid").alias("v0"), ((F.col("vid") + 1) % 50).alias("v1"),
        ((F.col("vid") + 7) % 50).alias("v2"))


def vox(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 20).alias("batch"), _i(F.floor(F.col("l_quantity") / 7)).alias("x"),
                      _i(F.round(F.col("l_discount") * 100)).alias("y"), _i(F.round(F.col("l_tax") * 100)).alias("z")).agg(
        (F.sum("l_extendedprice") / 1000).alias("feat"))


def splats(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("asset_id"), F.col("l_quantity").alias("x"),
                     (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z"),
                     ((F.col("l_discount") - 0.05) * 100).alias("opacity"),
                     F.array((F.col("l_tax") - 0.04) * 20, F.col("l_discount") * 10, (F.col("l_quantity") - 25) / 20).alias("f_dc"))


def stages(spark, sf):
    """A drifted stage log: time in gen_s or time_s, an old stage name, open properties."""
    e = read(spark, sf, "events")
    t = F.col("event_type")
    name = (F.when(t == "view", "segmentation").when(t == "click", "geometry").when(t == "signup", "illumination")
            .when(t == "purchase", "render").otherwise("load"))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("run_id"), "ts",
                    name.alias("stage"), F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("gen_s"),
                    F.when(F.col("user_id") % 2 == 1, F.col("value")).alias("time_s"), k.alias("k"),
                    (k < 50).alias("cached"), "props", F.element_at(F.array(*[F.lit(s) for s in ("floor", "object", "image3d")]), (F.col("user_id") % 3 + 1).cast("int")).alias("kind"),
                    F.when(k % 5 > 0, F.concat(F.lit("m"), k % 5)).alias("model"), F.when(k % 2 == 0, k / 4).alias("gpu_peak_gb"))


def jobs(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = F.col("event_type")
    status = (F.when(t == "view", "running").when(t.isin("click", "signup"), "queued")
              .when(t == "purchase", "done").otherwise("failed"))
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("value") * 1000000).cast("bigint"))
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("queue_id"), F.col("ts").alias("created"),
                    (F.col("event_id") % 4 == 0).alias("interactive"), status.alias("status"),
                    F.when(t.isin("purchase", "error"), end).alias("finished"))


def image_count(spark, sf) -> int:
    """Number of frames, so that what refers to frames refers to all of them at any scale."""
    return read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50)).distinct().count()


def job_events(events: DataFrame) -> DataFrame:
    """Progress events of long-lived jobs, from the raw event rows (batch or stream): one job per user."""
    t = F.col("event_type")
    kind = (F.when(t == "signup", "created").when(t == "click", "started").when(t == "view", "stage")
            .when((t == "purchase") & (F.get_json_object("props", "$.k").cast("int") >= 90), "done")
            .when((t == "error") & (F.get_json_object("props", "$.k").cast("int") >= 95), "failed").otherwise("stage"))
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("segmentation", "geometry", "irradiance", "render")]), k % 4 + 1)
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"),
                         F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"),
                         F.when(kind == "stage", stage).alias("stage"), F.lit("floor").alias("kind"),
                         F.when(kind == "stage", F.col("value")).alias("time_s"), F.when(k % 3 > 0, F.concat(F.lit("m"), k % 3)).alias("model"),
                         F.when(k % 5 == 0, F.col("value") / 2).alias("gen_s"), F.when(k % 2 == 0, k / 4).alias("gpu_peak_gb"))


def moves(spark, sf):
    """Moves that refer to masks by id; some ids lie beyond the masks that exist."""
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("scene_id"), (F.col("l_partkey") + F.col("l_linenumber") * 40).alias("mask_id"),
                     _i(F.col("l_quantity") * 12).alias("src_x"), _i(F.col("l_linenumber") * 50).alias("src_y"),
                     _i(600 - F.col("l_quantity") * 10).alias("dst_x"), _i(F.col("l_linenumber") * 40).alias("dst_y"), "l_suppkey")


def masks_present(spark, sf):
    """Mask inventory with its frame size; some masks are empty and some belong to frames of another size."""
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("mask_id"), F.greatest(F.col("p_size") - 3, F.lit(0)).alias("n_px"),
                    F.when(F.col("p_size") == 50, 320).otherwise(640).alias("mask_w"), F.lit(480).alias("mask_h"))


def scenes_present(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("scene_id"), F.lit(640).alias("width"), F.lit(480).alias("height"))


def boxes(spark, sf):
    c = read(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    x0, y0 = _i(k % 70 - 3), _i(n * 2 - 4)
    return c.select(k.alias("box_id"), (k % image_count(spark, sf)).alias("image_id"), x0.alias("x0"), y0.alias("y0"),
                    _i(x0 + k % 13).alias("x1"), _i(n * 2 + k % 11).alias("y1"), F.lit(WIDTH).alias("w"), F.lit(HEIGHT).alias("h"))


def specs(spark, sf):
    c = read(spark, sf, "customer")
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "floor").when(k % 4 == 1, "object").when(k % 4 == 2, "image3d").otherwise("bogus")
    return c.select(k.alias("spec_id"), kind.alias("kind"), (F.col("c_acctbal") / 100).alias("m_per_1000px"),
                    (F.col("c_acctbal") / 4000).alias("region_margin"), _i(k % 6).alias("sr_factor"), _i(k % 60).alias("steps"),
                    F.when(k % 5 == 0, "smooth-matte").when(k % 5 == 1, "smooth-glossy").otherwise("satin").alias("material"),
                    _i(k % 3).alias("n_moves"), _i(k % 2000).alias("omnipaint_res"),
                    F.when(k % 3 == 0, "full").when(k % 3 == 1, "box").otherwise("halo").alias("src_region"),
                    F.when(k % 7 > 0, F.concat(F.lit("s"), k % 7)).alias("scene_id"), F.when(k % 8 > 0, F.concat(F.lit("p"), k % 9)).alias("pattern_id"),
                    F.when(k % 10 != 2, F.concat(F.lit("m"), k)).alias("mask_id"), F.when(k % 11 < 8, "background").when(k % 11 < 9, "lasso").alias("removal"),
                    F.when(k % 13 < 10, "paste").otherwise("glue").alias("insertion"), F.when(k % 4 < 3, "mask").otherwise("halo").alias("dst_region"),
                    F.when(k % 9 < 4, "window").when(k % 9 < 7, "full").otherwise("tile").alias("omnipaint_mode"), _i(k * 7 % 60).alias("omnipaint_steps"),
                    F.when(k % 3 > 0, _i(k * 11 % 60)).alias("ss_steps"), _i(k * 13 % 60).alias("slat_steps"))


def assets(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("asset_id"), F.col("source").alias("kind"),
                    F.substring(F.sha1("text"), 1, 16).alias("content_key"), F.col("n_chars").alias("size"),
                    (F.col("doc_id") % 3 == 0).alias("is_clean"))


def listing(spark, sf):
    """A file listing: originals for every document, and a cleaned copy for every third one."""
    a = assets(spark, sf)
    root = F.concat(F.lit("file:/data/uploads/"), F.col("kind"), F.lit("/"), F.lpad(F.col("asset_id").cast("string"), 12, "0"))
    names = F.when(F.col("is_clean"), F.array(F.concat(root, F.lit(".jpg")), F.concat(root, F.lit("_clean.png")))) \
        .otherwise(F.array(F.concat(root, F.lit(".jpg"))))
    return a.select(F.explode(names).alias("path"), (F.col("size") * 4096).alias("length"))


# The two published finishes.
PRESETS = [("smooth-matte", 0.35, 0.75, 1.5, 0.0, 0.03, 0.8), ("smooth-glossy", 0.35, 0.08, 1.5, 0.0, 0.03, 0.8)]
PRESET_SCHEMA = ("name string, albedo double, roughness double, ior double, coat double, coat_roughness double, "
                 "delight double")


def presets(spark):
    return spark.createDataFrame(PRESETS, PRESET_SCHEMA)


def point_map(spark, sf):
    """A metric point per pixel, from the depth raster and the camera."""
    d = depth(spark, sf)
    return d.select("image_id", "y", "x", ((F.col("x") - CAMERA["cx"]) / CAMERA["fx"] * F.col("z")).alias("px"),
                    ((F.col("y") - CAMERA["cy"]) / CAMERA["fy"] * F.col("z")).alias("py"), F.col("z").alias("pz"), "valid")


def planes(spark, sf):
    """A given plane per image, tilted one of two ways."""
    even = F.col("image_id") % 2 == 0
    ny, nz = F.when(even, -0.8).otherwise(-0.6), F.when(even, -0.6).otherwise(-0.8)
    zero, one = F.lit(0.0), F.lit(1.0)
    return images(spark, sf).select(
        "image_id", zero.alias("c_x"), (one + F.col("image_id") % 3).alias("c_y"), F.lit(4.0).alias("c_z"),
        zero.alias("n_x"), ny.alias("n_y"), nz.alias("n_z"), one.alias("u_x"), zero.alias("u_y"), zero.alias("u_z"),
        zero.alias("v_x"), nz.alias("v_y"), (-ny).alias("v_z"))


def triangles(spark, sf, kx: float = 0.6, ky: float = 1.5):
    """Faces of the meshes in grid coordinates."""
    from ..operators.mesh import faces_with_vertices
    wide = faces_with_vertices(faces(spark, sf), vertices(spark, sf))
    cols = [c for i in range(3) for c in ((F.col(f"x{i}") * kx).alias(f"sx{i}"), (F.col(f"y{i}") * ky).alias(f"sy{i}"),
                                          (F.col(f"z{i}") + 1).alias(f"z{i}"), F.col(f"x{i}").alias(f"q{i}"))]
    return wide.select("mesh_id", "fid", *cols)


def tex_size(spark, sf):
    """Height of the texture; its width is 32."""
    return int(read(spark, sf, "part").agg(F.max(F.floor(F.col("p_partkey") / 32))).first()[0]) + 1
