"""Queries of the convolution dataflow, and their SQL. Kernels are small integers, so sums are exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.operators import blocks, resize, tensor
from tilewright.shared import staged, staged_path
from tilewright.sources import adapters, video

#: A 3x3 kernel for each of two output channels, and their biases.
KERNELS = {0: (1, 2, 1, 2, 4, 2, 1, 2, 1), 1: (-1, 0, 1, -2, 0, 2, -1, 0, 1)}
BIASES = {0: 3, 1: -5}
SIDE = 8
GRID = blocks.Grid(1, SIDE, SIDE, 3, 2)
KERNEL_SQL = "select * from (values " + ", ".join(f"({oc}, {k // 3}, {k % 3}, {w}, {BIASES[oc]})" for oc, ws in KERNELS.items() for k, w in enumerate(ws)) + ") t(oc, ky, kx, w, b)"


def _maps(spark, sf_dir):
    return adapters.relation(spark, sf_dir, adapters.FEATURE_MAP_SPARK)


def _weights(spark):
    return spark.createDataFrame([(oc, 0, k // 3, k % 3, float(w), float(BIASES[oc])) for oc, ws in KERNELS.items() for k, w in enumerate(ws)], "oc int, ic int, ky int, kx int, w double, b double")


CONV_SQL = f"select p.img, k.oc as c, p.y, p.x, sum(k.w * q.v) + min(k.b) as v from ({adapters.FEATURE_MAP_ANSI}) p cross join ({KERNEL_SQL}) k join ({adapters.FEATURE_MAP_ANSI}) q on q.img = p.img and q.y = p.y + k.ky - 1 and q.x = p.x + k.kx - 1 group by 1, 2, 3, 4"
RELU_SQL = f"select img, c, y, x, greatest(0.0, v) as v from ({CONV_SQL})"


def e8_convolution(spark, sf_dir):
    """E8, J15, A20, E2, E12."""
    return tensor.conv3x3(_maps(spark, sf_dir), _weights(spark), SIDE, SIDE)


def e6_block_convolution(spark, sf_dir):
    """The same by 3x2 blocks, whose border strips meet them by a join."""
    return tensor.conv3x3_blocks(_maps(spark, sf_dir), _weights(spark), 1, GRID)


def e4_halo_modes(spark, sf_dir):
    """Pixels of the convolution in both modes of the halo exchange, with how they differ."""
    rows = {mode: tensor.conv3x3_blocks(_maps(spark, sf_dir), _weights(spark), 1, GRID, mode) for mode in ("replicate", "strips")}
    keys = ["img", "c", "y", "x"]
    both = rows["replicate"].join(rows["strips"].withColumnRenamed("v", "w"), keys, "full_outer")
    return both.groupBy("img", "c").agg(F.count("*").alias("pixels"), F.sum("v").alias("total"), F.max(F.abs(F.col("v") - F.col("w"))).alias("largest_difference"))


E4_SQL = f"select img, c, count(*) as pixels, sum(v) as total, cast(0 as double) as largest_difference from ({CONV_SQL}) group by 1, 2"


def e3_halo_pixels(spark, sf_dir):
    """Pixels that each block holds with its halo."""
    return tensor.with_halo(_maps(spark, sf_dir), SIDE, SIDE, 3, 2).groupBy("block").agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))


BLOCKS_SQL = """select cast(i as int) as block, i // 2 as br, i % 2 as bc, (i // 2) * 2 + least(i // 2, 2) as y0, (i // 2 + 1) * 2 + least(i // 2 + 1, 2) as y1, (i % 2) * 4 as x0, (i % 2 + 1) * 4 as x1 from (select unnest(range(6)) as i)"""
E3_SQL = f"select block, count(*) as pixels, sum(v) as total from ({adapters.FEATURE_MAP_ANSI}) p join ({BLOCKS_SQL}) b on p.y between b.y0 - 1 and b.y1 and p.x between b.x0 - 1 and b.x1 group by 1"


def p15_blocks(spark, sf_dir):
    """The blocks of a grid for each supplier."""
    key = F.col("s_suppkey")
    grids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", *[(lo + key % n).cast("int").alias(c) for c, lo, n in (("height", 5, 11), ("width", 3, 8), ("rows", 1, 4), ("cols", 1, 3))])
    return tensor.blocks_of(grids)


P15_SQL = """
with g as (select s_suppkey, 5 + s_suppkey % 11 as height, 3 + s_suppkey % 8 as width, 1 + s_suppkey % 4 as rows, 1 + s_suppkey % 3 as cols from supplier),
b as (select *, block // cols as br, block % cols as bc from (select *, unnest(range(rows * cols)) as block from g))
select s_suppkey, cast(height as int) as height, cast(width as int) as width, cast(rows as int) as rows, cast(cols as int) as cols, cast(block as int) as block, cast(br as int) as br, cast(bc as int) as bc,
 cast(br * (height // rows) + least(br, height % rows) as int) as y0, cast((br + 1) * (height // rows) + least(br + 1, height % rows) as int) as y1,
 cast(bc * (width // cols) + least(bc, width % cols) as int) as x0, cast((bc + 1) * (width // cols) + least(bc + 1, width % cols) as int) as x1 from b
"""


def a21_relu_pool(spark, sf_dir):
    """P18, A21, T21."""
    return tensor.max_pool(tensor.relu(e8_convolution(spark, sf_dir)), SIDE, SIDE)


A21_SQL = f"select img, c, cast(y // 2 as int) as y, cast(x // 2 as int) as x, max(v) as v from ({RELU_SQL}) group by 1, 2, 3, 4"


def a22_tensor_error(spark, sf_dir):
    """Blocks against the whole, with one planted difference per map."""
    actual = e6_block_convolution(spark, sf_dir).withColumn("v", F.col("v") + F.when((F.col("y") == 3) & (F.col("x") == 3), 0.25 * (F.col("img") % 3)).otherwise(0.0))
    err = tensor.tensor_error(e8_convolution(spark, sf_dir), actual)
    return err.select("max_abs_error", F.round("mean_abs_error", 6).alias("mean_abs_error"), "correct")


A22_SQL = f"select cast(0.5 as double) as max_abs_error, round(avg(case when y = 3 and x = 3 then 0.25 * (img % 3) else 0 end), 6) as mean_abs_error, 'NO' as correct from ({CONV_SQL})"


def a23_image_set_error(spark, sf_dir):
    """A23, T23."""
    actual = e8_convolution(spark, sf_dir).withColumn("v", F.col("v") + F.when(F.col("y") == 0, F.col("img") % 5).otherwise(0))
    out = tensor.image_set_error(tensor.image_errors(e8_convolution(spark, sf_dir), actual))
    return out.select("images", "max_abs_error", F.round("mean_abs_error", 6).alias("mean_abs_error"))


A23_SQL = f"select count(*) as images, cast(max(m) as double) as max_abs_error, round(avg(a), 6) as mean_abs_error from (select img, max(case when y = 0 then img % 5 else 0 end * 1.0) as m, avg(case when y = 0 then img % 5 else 0 end) as a from ({CONV_SQL}) group by img)"


def e10_stack(spark, sf_dir):
    """All layers of the tiny profile over the maps of ``embeddings``, first in 2x3 blocks, at six decimals."""
    pixels = _maps(spark, sf_dir).withColumn("v", F.col("v") / 100)
    out = tensor.stack(spark, pixels, 1, SIDE, SIDE, "tiny", grid=(2, 3), save=lambda df: staged(df, "layers"))
    return out.select("img", "c", "y", "x", F.round("v", 6).alias("v"))


def s13_synthetic_maps(spark, sf_dir):
    """What each map of ``embeddings`` differs by from the synthetic one of its size, at six decimals."""
    made = tensor.synthetic_map(spark, 1, SIDE, SIDE).select("c", "y", "x", F.col("v").alias("made"))
    both = _maps(spark, sf_dir).join(F.broadcast(made), ["c", "y", "x"])  # 64 rows
    return both.groupBy("img").agg(F.round(F.sum(F.col("v") * F.col("made")), 6).alias("product"))


S13_SQL = f"select img, round(sum(v * sin(0.013 * ((c + 1) * 17 + 3 * y + x))), 6) as product from ({adapters.FEATURE_MAP_ANSI}) group by 1"


def _layer_sql(source: str, side: int, inputs: int, outputs: int, layer: int, pool: bool) -> str:
    kernel = f"select oc, ic, ky, kx, 0.035 * sin(0.007 * (i + 101 * ({layer} + 1))) as w, 0.01 * cos(0.11 * ({layer} + oc)) as b from (select i, i // {inputs * 9} as oc, i // 9 % {inputs} as ic, i // 3 % 3 as ky, i % 3 as kx from (select unnest(range({outputs * inputs * 9})) as i))"
    places = f"select distinct img, y, x from {source}"
    conv = f"select p.img, k.oc as c, p.y, p.x, greatest(0, sum(k.w * q.v) + min(k.b)) as v from ({places}) p cross join ({kernel}) k join {source} q on q.img = p.img and q.c = k.ic and q.y = p.y + k.ky - 1 and q.x = p.x + k.kx - 1 group by 1, 2, 3, 4"
    return f"select img, c, y // 2 as y, x // 2 as x, max(v) as v from ({conv}) group by 1, 2, 3, 4" if pool else conv


def _stack_sql(side: int) -> str:
    steps, channels = [f"l0 as materialized (select img, c, y, x, v / 100 as v from ({adapters.FEATURE_MAP_ANSI}))"], 1
    for layer, outputs, pool in tensor.layers("tiny"):
        pool = pool and side >= 2
        steps.append(f"l{layer} as materialized ({_layer_sql(f'l{layer - 1}', side, channels, outputs, layer - 1, pool)})")
        side, channels = side // 2 if pool else side, outputs
    return f"with {', '.join(steps)} select img, cast(c as int) as c, cast(y as int) as y, cast(x as int) as x, round(v, 6) as v from l8"


E10_SQL = _stack_sql(SIDE)

RESIZED = (5, 3)


def s19_area_resize(spark, sf_dir):
    """The maps of ``embeddings`` at 5 x 3 pixels, each the mean of the area under it."""
    return resize.area_resize(_maps(spark, sf_dir), (SIDE, SIDE), RESIZED).withColumn("v", F.round("v", 6))


_OVERLAP = "greatest(0, least((p.{k} + 1) * {t}, (t.{k} + 1) * 8) - greatest(p.{k} * {t}, t.{k} * 8))"
S19_SQL = f"""select p.img, p.c, cast(t.y as int) as y, cast(t.x as int) as x, round(sum(p.v * {_OVERLAP.format(k='y', t=5)} * {_OVERLAP.format(k='x', t=3)}) / 64, 6) as v
from ({adapters.FEATURE_MAP_ANSI}) p, (select range // 3 as y, range % 3 as x from range(15)) t group by 1, 2, 3, 4"""
VIDEO = DetectionConfig(tile_grid="3x2", overlap=1)


def _video(spark, sf_dir) -> str:
    """The maps of ``embeddings`` in order of their ids as the frames of a mono video of 25 frames a second, in the shared folder."""
    from tilewright.shared import numbered

    # in the type of the values, as the SQL has it: Spark takes a float times a whole number as doubles
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.expr("transform(embedding, v -> pmod(cast(round(v * cast(100 as float)) as int), 256))").alias("p"))
    luma = F.unhex(F.array_join(F.transform("p", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    path = staged_path(spark, "video")
    video.write_video(numbered(rows, ["vec_id"]).select("place", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), luma.alias("luma")), path, 25)
    return path


def s3_video_tiles(spark, sf_dir):
    """Tiles of every frame of a video of the maps of ``embeddings``, read by byte ranges: their sizes and the sums of their pixels."""
    path = _video(spark, sf_dir)
    frames = video.read_video(spark, path, "frame_id bigint, width int, height int")
    tiles = video.tile_pixels(video.video_tasks(VIDEO, frames, SIDE, SIDE), path)
    value = lambda s: F.conv(F.hex(s), 16, 10).cast("bigint")
    total = F.aggregate(F.sequence(F.lit(1), F.length("pixels")), F.lit(0).cast("bigint"), lambda a, k: a + value(F.substring(F.col("pixels"), k, F.lit(1))))
    return tiles.select("frame_id", "tile_id", F.length("pixels").alias("n_pixels"), total.alias("total"))


S3_SQL = """
with f as (select row_number() over (order by vec_id) - 1 as frame_id, embedding from embeddings),
 p as (select frame_id, k // 8 as y, k % 8 as x, ((cast(round(v * 100) as int) % 256) + 256) % 256 as v from (select frame_id, unnest(embedding) as v, unnest(range(len(embedding))) as k from f)),
 t as (select cast(range as int) as tile_id, greatest(0, round_even(range % 3 * 8 / 3, 0) - 1) as x1, least(8, round_even((range % 3 + 1) * 8 / 3, 0) + 1) as x2, greatest(0, range // 3 * 4 - 1) as y1, least(8, (range // 3 + 1) * 4 + 1) as y2 from range(6))
select frame_id, tile_id, cast(count(*) as int) as n_pixels, cast(sum(v) as bigint) as total from p join t on x >= x1 and x < x2 and y >= y1 and y < y2 group by 1, 2
"""


def s18_video_probe(spark, sf_dir):
    """Size, rate and number of frames of the same video, without reading a frame."""
    rows = video.probe(spark, _video(spark, sf_dir))
    return rows.groupBy("width", "height", "fps").agg(F.sum("frames").alias("frames"))


S18_SQL = "select 8 as width, 8 as height, cast(25 as double) as fps, count(*) as frames from embeddings"

QUERIES = {
    "s19_area_resize": (s19_area_resize, S19_SQL), "s3_video_tiles": (s3_video_tiles, S3_SQL), "s18_video_probe": (s18_video_probe, S18_SQL),
    "e8_convolution": (e8_convolution, CONV_SQL), "e6_block_convolution": (e6_block_convolution, CONV_SQL), "e3_halo_pixels": (e3_halo_pixels, E3_SQL), "p15_blocks": (p15_blocks, P15_SQL),
    "a21_relu_pool": (a21_relu_pool, A21_SQL), "a22_tensor_error": (a22_tensor_error, A22_SQL), "a23_image_set_error": (a23_image_set_error, A23_SQL), "e10_stack": (e10_stack, E10_SQL),
    "e4_halo_modes": (e4_halo_modes, E4_SQL), "s13_synthetic_maps": (s13_synthetic_maps, S13_SQL),
}
