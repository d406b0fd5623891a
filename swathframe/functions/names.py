"""Dates, product names, archive paths and grid-cell names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathframe.constants import GRID_CELL_DEGREES
from swathframe.functions.common import as_col, let


def pad2(value) -> Column:
    return F.lpad(as_col(value).cast("string"), 2, "0")


def parse_day(text) -> Column:
    return F.to_date(as_col(text), "yyyy-MM-dd")


def format_day(value) -> Column:
    return F.date_format(as_col(value), "yyyy-MM-dd")


def shift_day(text, days) -> Column:
    """``yyyy-mm-dd`` text moved by a number of days, as text."""
    return format_day(F.date_add(parse_day(text), as_col(days)))


def file_name(path) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def tile_id_from_path(path) -> Column:
    """Fields 4 and 5 of the file name: ``<row>_<col>.tif``."""
    return F.array_join(F.slice(F.split(file_name(path), "_"), 5, 2), "_")


def relative_dir(path) -> Column:
    """The two directories right above the file."""
    return F.array_join(F.slice(F.split(as_col(path), "/"), -3, 2), "/")


def platform_of(product_name) -> Column:
    return F.element_at(F.split(as_col(product_name), "_"), 1)


def product_name_fields(product_name) -> Column:
    """Metadata held in a product file name; times and orbit only for RAW and OCN products."""
    parts = F.split(F.regexp_replace(as_col(product_name), "\\.zip$", ""), "_")

    def part(i):
        return F.get(parts, i)

    coarse = part(2).isin("RAW", "OCN")

    def stamp(i):
        return F.when(coarse, F.try_to_timestamp(part(i), F.lit("yyyyMMdd'T'HHmmss")))

    return F.struct(
        part(0).alias("sat_id"), part(1).alias("mode"), part(2).alias("product_type"),
        stamp(5).alias("start_time"), stamp(6).alias("stop_time"),
        F.when(coarse, part(7).cast("int")).alias("absolute_orbit"),
    )


def fix_tile_id(esa_tile_id, computed_square, baseline) -> Column:
    """Baselines before 02.01 mis-assigned the last letter; correct only that letter."""
    given = F.lower(as_col(esa_tile_id))
    ours = F.concat(F.lit("t"), F.lower(as_col(computed_square)))
    stem = given.substr(F.lit(1), F.length(given) - 1) == ours.substr(F.lit(1), F.length(ours) - 1)
    last = F.right(given, F.lit(1)) != F.right(ours, F.lit(1))
    return F.when((as_col(baseline) < F.lit("02.01")) & stem & last, ours).otherwise(given)


def gridcell_name(lon, lat, size) -> Column:
    """``05S145E-10S150E``: top-left and bottom-right of the cell holding the point.

    Truncates toward zero and steps one cell down for negatives, so an exact
    negative multiple falls one cell low.
    """
    cell = as_col(size).cast("int")

    def low_edge(v):
        base = (as_col(v) / cell).cast("int") * cell
        return F.when(as_col(v) < 0, base - cell).otherwise(base)

    left, bottom = low_edge(lon), low_edge(lat)
    right, top = left + cell, bottom + cell

    def ns(v):
        return F.when(v < 0, F.lit("S")).otherwise(F.lit("N"))

    def ew(v):
        return F.when(v < 0, F.lit("W")).otherwise(F.lit("E"))

    return F.format_string("%02d%s%03d%s-%02d%s%03d%s", F.abs(top), ns(top), F.abs(left), ew(left),
                           F.abs(bottom), ns(bottom), F.abs(right), ew(right))


def gridcell_bounds(name) -> Column:
    """Decode a grid-cell name into (north, west, south, east) degrees."""
    n = as_col(name)

    def degrees(start, width):
        value = F.substring(n, start, width - 1).cast("int")
        return F.when(F.substring(n, start + width - 1, 1).isin("S", "W"), -value).otherwise(value)

    return F.struct(degrees(1, 3).alias("north"), degrees(4, 4).alias("west"),
                    degrees(9, 3).alias("south"), degrees(12, 4).alias("east"))


def gridcell_overlaps(name, west, east, south, north) -> Column:
    """Inclusive overlap of a named cell with a bounding box on both axes."""
    return let(name, lambda n: let(gridcell_bounds(n), lambda b: (
        (b["east"] >= as_col(west)) & (b["west"] <= as_col(east))
        & (b["south"] <= as_col(north)) & (b["north"] >= as_col(south)))))


def gridcell_size(sat_id) -> Column:
    number = F.substring(as_col(sat_id), 2, 1)
    chain = None
    for sensor, size in GRID_CELL_DEGREES.items():
        hit = number == str(sensor)
        chain = F.when(hit, F.lit(size)) if chain is None else chain.when(hit, F.lit(size))
    return chain


def instrument_dir(sat_id, instrument) -> Column:
    family = F.substring(as_col(sat_id), 1, 2)
    return (F.when(family == "S1", F.lit("C-SAR")).when(family == "S2", F.lit("MSI"))
            .when(family.isin("S3", "S5"), as_col(instrument)))


def product_dir(sat_id, product_type, level) -> Column:
    family = F.substring(as_col(sat_id), 1, 2)
    return (F.when(family == "S2", F.concat(F.lit("L"), F.right(as_col(level), F.lit(2))))
            .when(family.isin("S1", "S3", "S5"), as_col(product_type)))


def processing_level(sat_id, product_type, level) -> Column:
    family = F.substring(as_col(sat_id), 1, 2)
    kind = as_col(product_type)
    s1 = (F.when(kind == "RAW", F.lit("LEVEL-0")).when(kind == "OCN", F.lit("LEVEL-2"))
          .otherwise(F.lit("LEVEL-1")))
    return (F.when(family == "S1", s1)
            .when(family == "S2", F.concat(F.lit("L"), F.right(as_col(level), F.lit(2))))
            .when(family.isin("S3", "S5"), F.concat(F.lit("LEVEL-"), as_col(level)))
            .otherwise(F.lit("LEVEL-1")))


def archive_path(sat_id, instrument, product_type, level, mode, start_time, lon, lat,
                 cell_size=None, with_product: bool = True) -> Column:
    """Relative archive directory of a scene.

    Month directory, then: the date for S3, S5 and OCN products; ``WV`` for wave
    mode; else the grid cell; only the month when there is no centroid.
    """
    sat, start = as_col(sat_id), as_col(start_time)
    size = gridcell_size(sat) if cell_size is None else as_col(cell_size)
    month = F.concat_ws("/", F.date_format(start, "yyyy"), F.date_format(start, "yyyy-MM"))
    by_day = F.substring(sat, 2, 1).isin("3", "5") | (F.coalesce(as_col(product_type), F.lit("")) == "OCN")
    leaf = (F.when(by_day, F.date_format(start, "yyyy-MM-dd"))
            .when(as_col(mode) == "WV", F.lit("WV"))
            .when(as_col(lon).isNotNull(), gridcell_name(lon, lat, size)))
    out = F.concat_ws("/", month, leaf)  # concat_ws skips the NULL leaf
    if not with_product:
        return out
    return F.concat_ws("/", F.concat(F.lit("Sentinel-"), F.substring(sat, 2, 1)),
                       instrument_dir(sat, instrument), product_dir(sat, product_type, level), out)


def checksum_md5(checksum) -> Column:
    """The digest, only if the ``kind:digest`` text declares md5."""
    parts = F.split(as_col(checksum), ":")
    return F.when(F.get(parts, 0) == "md5", F.get(parts, 1))


def zip_url(quicklook_url) -> Column:
    """The archive sits next to the quicklook, with another three-letter extension."""
    url = as_col(quicklook_url)
    return F.concat(url.substr(F.lit(1), F.length(url) - 3), F.lit("zip"))
