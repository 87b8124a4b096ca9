"""Raster and building files: written from the tables, read back by their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rasters
from ..sources import buildingfiles, rasterfiles, sinks
from ..sources.tables import Tables
from .registry import query

_W, _ROWS = 100, 40


def _written(t: Tables, size: float, **how: object) -> str:
    """Rasters of 100 by 40 cells, one below the other; a cell's height comes from the part of its number, every eleventh has none."""
    k = F.col("p_partkey")
    folder = sinks.scratch_folder(t.spark, "rasters")
    tile = F.floor(k / (_W * _ROWS)).cast("int")
    cells = t.read("part").select(
        F.concat(F.lit("r"), tile).alias("tile"), (k % _W).cast("int").alias("rx"), (F.floor(k / _W) % _ROWS).cast("int").alias("ry"),
        F.lit(500.0).alias("west"), (1000.0 - tile * _ROWS * size).alias("north"), F.when(k % 11 != 0, F.col("p_size") - 3.0).alias("value"),
    )
    rasterfiles.write(cells, folder, size, **how)
    return folder


def _cells_sql(size: str) -> str:
    return f"""c AS (SELECT 'r' || p_partkey // {_W * _ROWS} AS tile, CAST(p_partkey % {_W} AS INTEGER) AS rx, CAST(p_partkey // {_W} % {_ROWS} AS INTEGER) AS ry, 500e0 + (p_partkey % {_W} + 0.5e0) * {size} AS x,
  (1000e0 - p_partkey // {_W * _ROWS} * {_ROWS} * {size}) - (p_partkey // {_W} % {_ROWS} + 0.5e0) * {size} AS y, CASE WHEN p_partkey % 11 <> 0 THEN p_size - 3e0 END AS value FROM part)"""


@query("src08_raster_cells", f"WITH {_cells_sql('0.5e0')} SELECT tile, rx, ry, x, y, value FROM c WHERE value IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Every cell of tiled rasters of floats, deflated, with the predictor for floats."""
    return rasterfiles.cells(t.spark, _written(t, 0.5, kind="f4", block=(16, 32), predictor=3)).where("value is not null")


@query("src09_raster_box", f"WITH {_cells_sql('2e0')} SELECT tile, count(*) AS n, sum(value) AS total FROM c WHERE value IS NOT NULL AND x >= 530 AND x < 590 AND y > 940 AND y <= 981 GROUP BY tile")
def _(t: Tables) -> DataFrame:
    """Sums within a box of rasters in strips; strips outside of it are not opened."""
    c = rasterfiles.cells(t.spark, _written(t, 2.0, kind="f8", block=8, predictor=1))
    return c.where("x >= 530 and x < 590 and y > 940 and y <= 981 and value is not null").groupBy("tile").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("src10_canopy_lookup", """WITH c AS (SELECT p_partkey // 4000 AS tile, p_partkey % 100 AS rx, p_partkey // 100 % 40 AS ry, CASE WHEN p_partkey % 11 <> 0 THEN p_size - 3e0 END AS value FROM part),
  f AS (SELECT tile, 1000e0 - tile * 40 AS north, max(ry) + 1 AS h, max(rx) + 1 AS w FROM c GROUP BY tile), p AS (SELECT s_suppkey AS probe, 500e0 + s_suppkey % 100 + 0.25e0 AS sx, 1000.25e0 - s_suppkey % 97 AS sy FROM supplier),
  j AS (SELECT probe, min(tile) AS tile FROM p JOIN f ON sx BETWEEN 500 AND 500 + w AND sy BETWEEN north - h AND north GROUP BY probe)
  SELECT p.probe, c.value FROM p LEFT JOIN j USING (probe) LEFT JOIN f USING (tile) LEFT JOIN c ON c.tile = f.tile AND c.rx = least(w - 1, CAST(floor(sx - 500) AS BIGINT)) AND c.ry = least(h - 1, CAST(floor(north - sy) AS BIGINT))""")
def _(t: Tables) -> DataFrame:
    """Points looked up in rasters of whole numbers, deflated, with the predictor for whole numbers."""
    folder = _written(t, 1.0, kind="i2", block=(32, 32), predictor=2)
    k = F.col("s_suppkey")
    points = t.read("supplier").select(k.alias("probe"), (500.25 + k % 100).alias("sx"), (1000.25 - k % 97).alias("sy"))
    return rasters.sample(points, rasterfiles.files(t.spark, folder), rasterfiles.cells(t.spark, folder).select("tile", "rx", "ry", "value")).select("probe", "value")


#: Faces of a box whose points are the floor's four and then the roof's.
_BOX = [[1, 4, 3, 2], [5, 6, 7, 8], [1, 2, 6, 5], [2, 3, 7, 6], [3, 4, 8, 7], [4, 1, 5, 8]]


def _archives(t: Tables) -> DataFrame:
    """The polyfaces of archives, one for each brand, with a box for each of its parts: every ninth is too low, every seventh lacks its last points."""
    folder = sinks.scratch_folder(t.spark, "buildings")

    def one(rows):
        import pandas as pd

        shapes = []
        for r in rows.sort_values("id").itertuples():
            top = r.min_z + 0.5 if r.id % 9 == 0 else r.max_z
            ring = [(r.min_x, r.min_y), (r.max_x, r.min_y), (r.max_x, r.max_y), (r.min_x, r.max_y)]
            points = [(*p, r.min_z) for p in ring] + [(*p, top) for p in ring]
            shapes.append((points[:3] if r.id % 7 == 0 else points, _BOX))
        name = rows.source.iloc[0].replace("#", "-")
        fs, at = rasterfiles.pafs.FileSystem.from_uri(folder) if ":" in folder else (rasterfiles.pafs.LocalFileSystem(), folder)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{name}.zip") as out:
            out.write(buildingfiles.archive(shapes, f"{name}.dxf"))
        return pd.DataFrame({"n": [len(shapes)]})

    t.obstacles().groupBy("source").applyInPandas(one, "n long").write.format("noop").mode("overwrite").save()
    return buildingfiles.read_polyfaces(t.spark, folder)


_BRANDS = "o AS (SELECT *, replace(source, '#', '-') AS s, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS n FROM obstacles)"


@query("src11_polyfaces", f"WITH {_BRANDS} SELECT s || '.zip' AS source, CAST(n AS INTEGER) AS n, CASE WHEN id % 7 = 0 THEN 3 ELSE 8 END AS points, CAST(CASE WHEN id % 7 = 0 THEN 1 ELSE 12 END AS BIGINT) AS triangles FROM o", "obstacles")
def _(t: Tables) -> DataFrame:
    """Points and triangles of every polyface in zipped drawings made from the parts."""
    faces = _archives(t)
    count = buildingfiles.triangles(faces, "source", "n").groupBy("source", "n").agg(F.count("*").alias("triangles"))
    return faces.select("source", "n", F.size("points").alias("points")).join(count, ["source", "n"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))


@query("src12_obstacles", f"""WITH {_BRANDS} SELECT s || '.zip' AS source, CAST(n AS INTEGER) AS n, min_x, min_y, max_x, max_y, max_z, floor((max_z - min_z) * 1e3 + 0.5) / 1e3 AS height, center_x, center_y,
  floor(sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y)) / 2 * 1e3 + 0.5) / 1e3 AS half_diagonal FROM o WHERE id % 7 <> 0 AND id % 9 <> 0 AND max_x >= 100 AND min_x <= 800 AND max_y >= 50 AND min_y <= 600""", "obstacles")
def _(t: Tables) -> DataFrame:
    """Obstacles of those drawings that are large enough, within a box."""
    o = buildingfiles.obstacles(_archives(t), (100.0, 50.0, 800.0, 600.0))
    return o.select("source", "n", "min_x", "min_y", "max_x", "max_y", "max_z", "height", "center_x", "center_y", "half_diagonal")
