"""Searches that read every vector once: tiles of rows that questions pass by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a tile; small tables get smaller tiles, so that all cores have some.
LARGEST, SMALLEST, TILES = 65_536, 4096, 32


def tile_count(n: int) -> int:
    return max(1, -(-n // min(LARGEST, max(SMALLEST, n // TILES))))


def pass_by(rows: DataFrame, questions: DataFrame, count: int, build: Callable, search: Callable, schema: T.StructType | str,
            finish: Callable | None = None) -> DataFrame:
    """``search(build(rows of a tile), questions)`` for every tile of rows and every question.

    ``rows`` and ``questions`` have the same columns. The rows are dealt to
    ``count`` tiles by their number, so that no id or vector is a hot key, and
    travel once. Questions go to every tile and pass by in Arrow batches, after
    the tile's rows: a task holds one tile and one batch of questions.
    ``search`` yields record batches; ``finish`` yields more once all questions
    of a tile have passed, also where there was none.
    """
    tile = F.pmod(F.monotonically_increasing_id(), F.lit(count)).cast("int")
    own = rows.withColumn("_tile", tile).withColumn("_asks", F.lit(False))
    every = questions.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("_asks", F.lit(True))
    dealt = own.unionByName(every).repartition(count, "_tile").sortWithinPartitions("_tile", "_asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if finish is not None and (held or built is not None):
                yield from finish(built if built is not None else build(pa.Table.from_batches(held)))

        for batch in batches:
            kind = 2 * batch.column("_tile").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("_asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if kind[a] // 2 != at:
                    yield from done()
                    at, held, built = kind[a] // 2, [], None
                part = batch.slice(a, b - a)
                if kind[a] % 2 == 0:
                    held.append(part)
                elif held or built is not None:
                    if built is None:
                        built, held = build(pa.Table.from_batches(held)), []
                    yield from search(built, part) or ()
        yield from done()

    return dealt.mapInArrow(run, schema)
