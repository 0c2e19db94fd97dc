"""Operators on pixels in the long form (image_id, i, j, v, area). A blank pixel is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(v: Column) -> Column:
    """NaN and infinities are blank."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def coadd(pix: DataFrame, mode: str = "mean", keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Co-add by output pixel: area-weighted mean, median, count or sum of the covered pixels."""
    good = F.col("v").isNotNull() & (F.col("area") > 0)
    area = F.sum(F.when(good, F.col("area")))
    value = {
        "mean": F.sum(F.when(good, F.col("v") * F.col("area"))) / F.nullif(area, F.lit(0.0)),
        "median": F.median(F.when(good, F.col("v"))),
        "count": F.count(F.when(good, F.lit(1))).cast("double"),
        "sum": F.sum(F.when(good, F.col("v"))),
    }[mode]
    return pix.groupBy(*keys).agg(value.alias("v"), area.alias("area"))


def difference(pix: DataFrame, edges: DataFrame, factor: float = 1.0, tolerance: float = 1 / 3) -> DataFrame:
    """Per edge (plus, minus) the difference image on their common pixels. Each pixel is
    2 (v1 a1 - factor v2 a2) / (a1 + a2); pixels whose summed area is off the expected one go."""
    good = pix.filter("v IS NOT NULL AND area > 0")
    sides = [good.select(F.col("image_id").alias(name), "i", "j", F.col("v").alias(f"v{k}"), F.col("area").alias(f"a{k}")) for k, name in ((1, "plus"), (2, "minus"))]
    both = edges.join(sides[0], "plus").join(sides[1], ["minus", "i", "j"])
    usual = both.groupBy("plus", "minus").agg((F.avg("a1") + F.avg("a2")).alias("usual"))
    total = F.col("a1") + F.col("a2")
    kept = both.join(usual, ["plus", "minus"]).filter(F.abs(total - F.col("usual")) / F.col("usual") <= tolerance)
    return kept.select("plus", "minus", "i", "j", (2 * (F.col("v1") * F.col("a1") - factor * F.col("v2") * F.col("a2")) / total).alias("v"))


def region_statistics(pix: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Count, blanks, mean and rms over the box around (x, y); least and largest value with their
    places within the circle."""
    box = pix.filter(F.col("i").between(x - radius, x + radius) & F.col("j").between(y - radius, y + radius))
    inside = ((F.col("i") - x) ** 2 + (F.col("j") - y) ** 2 <= radius**2) & F.col("v").isNotNull()
    place = F.struct("j", "i")
    first = lambda f, sign: f(place, F.when(inside, F.struct(F.col("v"), (sign * F.col("j")), (sign * F.col("i")))))
    return box.groupBy("image_id").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_blank"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("rms"),
        F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"),
        first(F.max_by, -1)["i"].alias("high_i"), first(F.max_by, -1)["j"].alias("high_j"),
    )


def histogram(pix: DataFrame, bins: int) -> DataFrame:
    """(bin, datalev, n, cumulative): equal bins between the least and largest value."""
    ends = pix.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.floor((bins - 1) * (F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    counted = (
        pix.filter("v IS NOT NULL").crossJoin(F.broadcast(ends))  # one row
        .select(F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"), "low", "high")
        .groupBy("bin").agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
    )
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        "bin", (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / (bins - 1)).alias("datalev"), "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cumulative"),
    )


def combine_histograms(parts: DataFrame, bins: int) -> DataFrame:
    """Histograms (datalev, n) summed over a common range, each bin placed by its low edge."""
    return histogram_of_counts(parts, bins)


def histogram_of_counts(parts: DataFrame, bins: int) -> DataFrame:
    ends = parts.agg(F.min("datalev").alias("low"), F.max("datalev").alias("high"))
    place = F.floor((bins - 1) * (F.col("datalev") - F.col("low")) / (F.col("high") - F.col("low")))
    return parts.crossJoin(F.broadcast(ends)).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def percentile_level(hist: DataFrame, share: float) -> DataFrame:
    """The data level below which ``share`` of the pixels lie, interpolated within its bin."""
    total = Window.partitionBy()
    step = Window.orderBy("bin")
    found = hist.withColumn("total", F.sum("n").over(total)).withColumn("next", F.lead("datalev").over(step)).filter(
        (F.col("cumulative") + F.col("n") >= F.floor(F.col("total") * share)) & (F.col("cumulative") < F.floor(F.col("total") * share))
    )
    part = (F.floor(F.col("total") * share) - F.col("cumulative")) / F.col("n")
    return found.select((F.col("datalev") + part * (F.coalesce("next", "datalev") - F.col("datalev"))).alias("level"))


def shrink(pix: DataFrame, factor: int) -> DataFrame:
    """Block average by a whole factor, blanks left out."""
    return pix.filter("v IS NOT NULL").groupBy("image_id", F.floor(F.col("i") / factor).cast("int").alias("i"), F.floor(F.col("j") / factor).cast("int").alias("j")).agg(F.avg("v").alias("v"))


def shrink_fractional(pix: DataFrame, factor: float) -> DataFrame:
    """Block average by any factor above 0: a pixel counts in each output cell by its covered part."""
    def cells(c: str) -> Column:
        first, last = F.floor(F.col(c) / factor), F.floor((F.col(c) + 1 - 1e-12) / factor)
        part = lambda k: F.least(F.col(c) + 1, (k + 1) * factor) - F.greatest(F.col(c), k * factor)
        return F.transform(F.sequence(first, last), lambda k: F.struct(k.cast("int").alias("k"), part(k).alias("w")))

    wide = pix.filter("v IS NOT NULL").select("image_id", "v", F.explode(cells("i")).alias("x"), "j").select("image_id", "v", "x", F.explode(cells("j")).alias("y"))
    weight = F.col("x.w") * F.col("y.w")
    return wide.groupBy("image_id", F.col("x.k").alias("i"), F.col("y.k").alias("j")).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("v"))


def plane_average(cube: DataFrame, first: int, count: int) -> DataFrame:
    """Mean over ``count`` planes; a blank plane makes the pixel blank."""
    return cube.filter(F.col("k").between(first, first + count - 1)).groupBy("i").agg(F.when(F.count("v") == count, F.sum("v") / count).alias("v"))


def plane_median(cube: DataFrame, first: int, count: int) -> DataFrame:
    """The upper middle of the sorted planes."""
    return cube.filter(F.col("k").between(first, first + count - 1) & F.col("v").isNotNull()).groupBy("i").agg(
        F.sort_array(F.collect_list("v")).alias("s")  # one entry a plane, so at most ``count``
    ).select("i", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("v"))


def spectrum(cube: DataFrame, low: int, high: int) -> DataFrame:
    """Mean value by plane over the pixels low..high."""
    return cube.filter(F.col("i").between(low, high)).groupBy("k").agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def fix_blanks(pix: DataFrame, value: float | None = None, ranges: tuple[tuple[float | None, float | None], ...] = ()) -> DataFrame:
    """Closed ranges become blank, blanks become ``value``."""
    v = blank(F.col("v"))
    for low, high in ranges:
        hit = (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high)
        v = F.when(hit, None).otherwise(v)
    return pix.withColumn("v", v if value is None else F.coalesce(v, F.lit(value)))


def to_integers(pix: DataFrame, bits: int, blank_value: int) -> DataFrame:
    """Values rounded to whole numbers of 8 (unsigned), 16 or 32 bits; those out of range and blanks get ``blank_value``."""
    low, high = (0, 255) if bits == 8 else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)
    whole = F.round(F.col("v"))
    return pix.withColumn("v", F.when(whole.between(low, high), whole.cast("int")).otherwise(F.lit(blank_value)))


def mask_boxes(pix: DataFrame, boxes: list[tuple[int, int, int, int]]) -> DataFrame:
    """Pixels in any inclusive box (xmin, xmax, ymin, ymax) become blank."""
    hit = F.lit(False)
    for x0, x1, y0, y1 in boxes:
        hit = hit | (F.col("i").between(x0, x1) & F.col("j").between(y0, y1))
    return pix.withColumn("v", F.when(~hit, F.col("v")))


def cutout(pix: DataFrame, i0: int, j0: int, width: int, height: int) -> DataFrame:
    """A box of pixels, renumbered from 0."""
    return pix.filter(F.col("i").between(i0, i0 + width - 1) & F.col("j").between(j0, j0 + height - 1)).withColumns({"i": F.col("i") - i0, "j": F.col("j") - j0})


def bounding_info(pix: DataFrame) -> DataFrame:
    """Box, mean place and number of the pixels that aren't blank, by image."""
    good = pix.filter("v IS NOT NULL")
    ends = [F.min("i").alias("xmin"), F.max("i").alias("xmax"), F.min("j").alias("ymin"), F.max("j").alias("ymax")]
    return good.groupBy("image_id").agg(*ends, F.avg("i").alias("xcenter"), F.avg("j").alias("ycenter"), F.count("*").alias("npixel"))


def oriented_box(pix: DataFrame, steps: int = 180) -> DataFrame:
    """(image_id, angle, width, height, x, y): the least box of the pixels that aren't blank over ``steps``
    directions of a quarter turn, its angle in degrees, size and centre. One partial aggregate of four
    extremes a direction."""
    turns = F.array(*[F.lit(90.0 * k / steps) for k in range(steps)])
    good = pix.filter("v IS NOT NULL").groupBy("image_id", "j").agg(F.min("i").alias("i0"), F.max("i").alias("i1"))  # a row's ends suffice
    ends = good.select("image_id", "j", F.explode(F.array_distinct(F.array("i0", "i1"))).alias("i")).select("image_id", "i", "j", F.explode(turns).alias("angle"))
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    u, v = F.col("i") * c + F.col("j") * s, F.col("j") * c - F.col("i") * s
    boxes = ends.groupBy("image_id", "angle").agg(F.min(u).alias("u0"), F.max(u).alias("u1"), F.min(v).alias("v0"), F.max(v).alias("v1"))
    w, h = F.round(F.col("u1") - F.col("u0"), 9), F.round(F.col("v1") - F.col("v0"), 9)
    best = boxes.groupBy("image_id").agg(F.min(F.struct(F.round(w * h, 6).alias("area"), "angle", w.alias("width"), h.alias("height"), ((F.col("u0") + F.col("u1")) / 2).alias("u"), ((F.col("v0") + F.col("v1")) / 2).alias("v"))).alias("b"))
    c, s = F.cos(F.radians("b.angle")), F.sin(F.radians("b.angle"))
    return best.select("image_id", "b.angle", "b.width", "b.height", (F.col("b.u") * c - F.col("b.v") * s).alias("x"), (F.col("b.u") * s + F.col("b.v") * c).alias("y"))


def tight_box(pix: DataFrame) -> DataFrame:
    """The box of the pixels that aren't blank, by image."""
    good = pix.filter("v IS NOT NULL")
    return good.groupBy("image_id").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


def without_border(pix: DataFrame, nx: int, ny: int, border: int) -> DataFrame:
    return pix.filter(F.col("i").between(border, nx - border - 1) & F.col("j").between(border, ny - border - 1))


def pad(pix: DataFrame, nx: int, ny: int, left: int, right: int, top: int, bottom: int) -> DataFrame:
    """A full grid with the pixels shifted by the margins; new pixels are blank."""
    images = pix.select("image_id").distinct()
    grid = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(nx + left + right - 1))).alias("i")).select("image_id", "i", F.explode(F.sequence(F.lit(0), F.lit(ny + top + bottom - 1))).alias("j"))
    moved = pix.withColumns({"i": F.col("i") + left, "j": F.col("j") + bottom})
    return grid.join(moved, ["image_id", "i", "j"], "left")


def transpose(cube: DataFrame, order: dict[str, str]) -> DataFrame:
    """Rename index columns: ``order`` maps new names to old ones."""
    return cube.withColumns({new: F.col(old) for new, old in order.items()})


def subtract_plane(pix: DataFrame, a: Column, b: Column, c: Column, crpix1: float = 0.0, crpix2: float = 0.0) -> DataFrame:
    """Background removal: v - (a x + b y + c) with x, y relative to the reference pixel."""
    plane = a * (F.col("i") - crpix1) + b * (F.col("j") - crpix2) + c
    return pix.withColumn("v", F.when(F.col("area") > 0, F.col("v") - plane))


def row_extent(pix: DataFrame) -> DataFrame:
    """First and last pixel of each row that isn't blank."""
    return pix.filter("v IS NOT NULL").groupBy("image_id", "j").agg(F.min("i").alias("first"), F.max("i").alias("last"))


def radial_profile(pix: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Pixels within ``radius`` by rising distance with the running sum of their values, by image."""
    r = F.sqrt((F.col("i") - x) ** 2 + (F.col("j") - y) ** 2)
    near = pix.filter("v IS NOT NULL").select("image_id", "i", "j", r.alias("r"), "v").filter(F.col("r") <= radius)
    by = Window.partitionBy("image_id").orderBy("r", "i", "j", "v").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("flux", F.sum("v").over(by))


def tiles(pix: DataFrame, width: int, overlap: int) -> DataFrame:
    """Pixels dealt to square tiles that overlap: a pixel near an edge is in several tiles."""
    def of(c: str) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - overlap) / width)), F.floor((F.col(c) + overlap) / width))

    dealt = pix.select("*", F.explode(of("i")).alias("tile_x")).select("*", F.explode(of("j")).alias("tile_y"))
    return dealt.withColumns({c: F.col(c).cast("int") for c in ("tile_x", "tile_y")})


def smooth_neighbours(tiles_: DataFrame, value: str = "n") -> DataFrame:
    """3 x 3 neighbourhood sums on a grid (i, j): each cell is sent to its neighbours."""
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    sent = tiles_.select("i", "j", value, near.alias("di")).select("i", "j", value, "di", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dj"))
    summed = sent.groupBy((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).agg(F.sum(value).alias(value))
    return summed.join(tiles_.select("i", "j"), ["i", "j"], "left_semi")


def catalogue_map(sources: DataFrame, kernel: list[float]) -> DataFrame:
    """Sources (x, y, flux) spread over a separable kernel and summed by pixel."""
    half = len(kernel) // 2
    cells = F.array(*[F.struct(F.lit(a - half).alias("dx"), F.lit(b - half).alias("dy"), F.lit(kernel[a] * kernel[b]).alias("w")) for a in range(len(kernel)) for b in range(len(kernel))])
    spread = sources.select("x", "y", "flux", F.explode(cells).alias("k"))
    return spread.groupBy((F.col("x") + F.col("k.dx")).alias("i"), (F.col("y") + F.col("k.dy")).alias("j")).agg(F.sum(F.col("flux") * F.col("k.w")).alias("v"))
