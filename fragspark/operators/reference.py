"""Stretches of a tiled reference sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragspark.errors import ContigNotFoundError, OutOfBoundsError
from fragspark.functions.sequence import div
from fragspark.operators.motifs import TILE, sizes_of


def sequences(regions: DataFrame, reference: DataFrame, tile: int = TILE) -> DataFrame:
    """(idx, seq) of regions (contig, start, stop, idx), cut off at their contig's end; regions that meet no tile have an empty one."""
    some = regions.where("stop > start and start >= 0")
    cut = some.select("idx", "contig", "start", "stop", F.explode(F.sequence(div(F.col("start"), tile), div(F.col("stop") - 1, tile))).alias("tile"))
    low = F.greatest(F.col("start") - F.col("tile") * tile, F.lit(0))
    high = F.least(F.col("stop") - F.col("tile") * tile, F.lit(tile))
    part = F.substring("seq", (low + 1).cast("int"), (high - low).cast("int"))
    parts = cut.join(reference, ["contig", "tile"]).select("idx", "tile", part.alias("part"))
    # as many parts as a region has tiles, in their order
    whole = parts.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("tile", "part"))).alias("p")).select("idx", F.array_join("p.part", "").alias("seq"))
    return regions.select("idx").join(whole, "idx", "left").select("idx", F.coalesce("seq", F.lit("")).alias("seq"))


def sequence(reference: DataFrame, contig: str, start: int | None = None, stop: int | None = None, fail_on_excess_range: bool = True) -> str:
    """The upper-case bases of [start, stop), all of the contig by default; past its end an error, or what there is."""
    own = reference.where(F.col("contig") == contig)
    size = sizes_of(own).first()
    if size is None:
        raise ContigNotFoundError(f"no contig {contig}")
    size = size["size"]
    start, stop = 0 if start is None else start, size if stop is None else stop
    if fail_on_excess_range and not 0 <= start <= stop <= size:
        raise OutOfBoundsError(f"{contig}:{start}-{stop} isn't within its {size} bases")
    start, stop = max(0, start), min(stop, size)
    region = reference.sparkSession.createDataFrame([(contig, start, stop, 0)], "contig string, start bigint, stop bigint, idx bigint")
    return sequences(region, own).first()["seq"]


class Reference:
    """A tiled reference that is sliced like a mapping of strings: ``reference["chr1"][10:20]``."""

    def __init__(self, tiles: DataFrame) -> None:
        self.tiles = tiles

    def __getitem__(self, contig: str) -> Contig:
        return Contig(self.tiles, contig)


class Contig:
    def __init__(self, tiles: DataFrame, name: str) -> None:
        self.tiles, self.name = tiles, name

    def __getitem__(self, part: slice | int) -> str:
        if isinstance(part, int):
            part = slice(part, part + 1)
        return sequence(self.tiles, self.name, part.start, part.stop, fail_on_excess_range=False)[:: part.step or 1]
