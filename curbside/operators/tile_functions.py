"""Vector tiles as a table function of SQL.

``SELECT * FROM vector_tile(TABLE(features) PARTITION BY (z, x, y) ORDER BY (px, py, n, amount))`` gives one row for each
tile: z, x, y, n_features, mvt. ``features``: z, x, y, layer, px, py (places in pixels), n, amount, as
:func:`placed_features` gives them. A tile's rows are written as they come and not gathered before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from curbside.operators.line_tiles import POINT, Tile
from curbside.operators.tiles import pixels, tile_features
from curbside.operators.vector_tiles import EXTENT, varint, zigzag


class VectorTile:
    """Called once for each tile; a null amount is left out of the feature, rows without a place are passed over."""

    def __init__(self) -> None:
        self.at, self.tile = None, Tile()

    def eval(self, row) -> None:
        if row["px"] is None or row["py"] is None:
            return
        self.at = row["z"], row["x"], row["y"]
        properties = {"count": row["n"]} if row["amount"] is None else {"count": row["n"], "amount": row["amount"]}
        self.tile.add(row["layer"], POINT, b"".join(map(varint, (1 << 3 | 1, zigzag(row["px"]), zigzag(row["py"])))), properties)

    def terminate(self):
        if self.at is not None:
            yield (*self.at, self.tile.n, self.tile.close())


def register(spark: SparkSession, name: str = "vector_tile") -> None:
    spark.udtf.register(name, udtf(VectorTile, returnType="z int, x long, y long, n_features int, mvt binary"))


def placed_features(points: DataFrame, tiles: DataFrame, zoom: int, name: str = "parking", limit: int = 500) -> DataFrame:
    """What the asked tiles (x, y) of one zoom show: the rows that the table function takes."""
    placed = pixels(tile_features(points, tiles, zoom, limit), zoom, EXTENT)
    return placed.select(F.lit(zoom).alias("z"), "x", "y", F.lit(name).alias("layer"), "px", "py", "n", F.col("amount").cast("double").alias("amount"))
