"""Tagging by embedding: the nearest categories of every article, and the job that tags whole collections anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import dot
from ..session import cut_lineage, shared_dir
from .merge import one_per_key, update_all

BLOCK = 512  # categories a block holds on average; 512 vectors of 1,024 doubles are 4 MB
MOST_BLOCKS = 1024  # clusters at most, and as many blocks again for those that are cut; longer lists get larger blocks
HELD = 8  # blocks a worker remembers
PLACES = 6  # similarities are ranked after rounding, so order does not hang on the last bit
Encoder = Callable[[list[str]], np.ndarray]


def top_categories(articles: DataFrame, categories: DataFrame, keep: int = 5, block: int = BLOCK) -> DataFrame:
    """Add ``tags``, the names of the ``keep`` nearest categories by cosine, nearest first.

    ``articles`` has an embedding; ``categories`` pos, name and embedding. Ties go to the lower
    position. Categories are gathered round pivots into blocks, which lie in the shared folder; what
    goes with the tasks are the pivots and the radius of every block, ``MOST_BLOCKS`` and twice as many at
    most. No article is shuffled. A batch of articles opens the block each is nearest to, then those that
    can still hold one of its ``keep`` nearest: a category within angle r of its pivot is no nearer to an
    article than the article's angle to the pivot less r. The answer is exact, whatever the number of categories.

    An article whose vector is null, holds null or non-finite entries or is of norm 0 has null tags; such a
    category is near to none. Without categories tags are empty.
    """
    folder, pivots, blocks = _in_blocks(categories, block)
    return articles.withColumn("tags", _nearest(folder, pivots, blocks, keep)(F.col("embedding")))


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and those as rows of norm 1."""
    usable, rows = [], []
    for i, v in enumerate(vectors):
        if v is not None:
            v = np.asarray(v, dtype=float)
            if np.isfinite(v).all() and v.any():
                usable.append(i)
                rows.append(v)
    x = np.vstack(rows) if rows else np.zeros((0, 0))
    return np.array(usable, dtype=int), x / np.linalg.norm(x, axis=1, keepdims=True) if rows else x


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _in_blocks(categories: DataFrame, block: int) -> tuple[str, np.ndarray, list[tuple[int, int, float]]]:
    """Write the categories as blocks; gives their folder, the pivots and (block, pivot, radius) of each block."""
    spark = categories.sparkSession
    size = dot(F.col("embedding"), F.col("embedding"))
    usable = cut_lineage(categories.select("pos", "name", "embedding").where((size > 0) & (size <= float(np.finfo(float).max))))
    n = usable.count()
    folder = f"{shared_dir(spark)}/categories/{uuid.uuid4().hex}"
    if not n:
        return folder, np.zeros((0, 0)), []
    block = max(block, -(-n // MOST_BLOCKS))
    chosen = usable.orderBy(F.md5(F.col("pos").cast("string")), "pos", "name").limit(-(-n // block)).collect()
    _, pivots = _units(pd.Series([r.embedding for r in chosen]))

    @F.pandas_udf("pivot int, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        angles = _angles(_units(vectors)[1], pivots)
        nearest = angles.argmin(axis=1)
        return pd.DataFrame({"pivot": nearest.astype(np.int32), "angle": angles[np.arange(len(nearest)), nearest]})

    placed = usable.withColumn("_at", place("embedding")).select("pos", "name", "embedding", "_at.*")
    pieces = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).alias("pieces"))  # MOST_BLOCKS rows at most
    number = F.col("pivot") + len(pivots) * F.pmod(F.xxhash64("pos", "name"), F.col("pieces"))
    rows = placed.join(pieces, "pivot").withColumn("block", number).drop("pieces")
    rows.repartition("block").write.partitionBy("block").parquet(folder)
    heads = spark.read.parquet(folder).groupBy("block").agg(F.first("pivot").alias("pivot"), F.max("angle").alias("radius"))
    return folder, pivots, sorted((r.block, r.pivot, r.radius) for r in heads.collect())


@lru_cache(HELD)
def _open(folder: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, names and vectors of a block in the order of positions."""
    path = f"{folder}/block={block}"
    system, path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    rows = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["pos", "name", "embedding"]).to_pandas()
    rows = rows.sort_values(["pos", "name"], kind="stable")
    return rows["pos"].to_numpy(), rows["name"].to_numpy(dtype=object), _units(rows["embedding"])[1]


def _nearest(folder: str, pivots: np.ndarray, blocks: list[tuple[int, int, float]], keep: int) -> Callable[[Column], Column]:
    slack = 2 * 10.0 ** -PLACES  # bounds are not rounded, similarities are

    def search(x: np.ndarray) -> np.ndarray:
        close, at = np.full((len(x), keep), -np.inf), np.zeros((len(x), keep))
        names = np.full((len(x), keep), None, dtype=object)
        angles = _angles(x, pivots)
        reach = np.cos(np.maximum(angles[:, [p for _, p, _ in blocks]] - np.array([r for _, _, r in blocks]), 0.0))
        first = reach.argmax(axis=1)

        def meet(j: int, rows: np.ndarray) -> None:
            pos, called, vectors = _open(folder, blocks[j][0])
            near = np.round(x[rows] @ vectors.T, PLACES)
            best = np.argsort(-near, axis=1, kind="stable")[:, :keep]
            both = np.hstack([close[rows], np.take_along_axis(near, best, 1)]), np.hstack([at[rows], pos[best]]), np.hstack([names[rows], called[best]])
            order = np.lexsort((both[1], -both[0]), axis=1)[:, :keep]
            close[rows], at[rows], names[rows] = (np.take_along_axis(b, order, 1) for b in both)

        for j in np.unique(first):
            meet(j, np.flatnonzero(first == j))
        for j in range(len(blocks)):
            rows = np.flatnonzero((first != j) & (reach[:, j] + slack >= close[:, -1]))
            if len(rows):
                meet(j, rows)
        return names

    @F.pandas_udf("array<string>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            tags = pd.Series([None] * len(vectors), dtype=object)
            usable, x = _units(vectors)
            if len(usable):
                found = search(x) if blocks else np.zeros((len(x), 0), dtype=object)
                for i, row in zip(usable, found, strict=True):
                    tags.iat[i] = [name for name in row if name is not None]
            yield tags

    return nearest


def embed(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding") -> DataFrame:
    """Add vectors from an encoder given by the caller, one Arrow batch at a time; blank texts are left out."""
    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encoder(texts.tolist()), dtype=np.float32)))

    return df.where(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn(out, encode(F.col(text)))


def retag(backend: DataFrame, reader: DataFrame, categories: DataFrame, encoder: Encoder, row_id: str = "_id",
          keep: int = 5) -> tuple[DataFrame, DataFrame]:
    """Both article tables with the tags of all articles set anew from their texts.

    ``backend`` has ``row_id``, link, textcontent and tags; ``reader`` href and tags; ``categories`` pos and name. Articles
    without text keep their tags. A backend row is found by its id, reader rows by their link; of articles that
    share a link the last one (by id) gives the tags. Vectors and texts stay where they are computed: the
    joins carry ids, links and tags.
    """
    named = embed(categories, "name", encoder)
    tagged = top_categories(embed(backend.select(row_id, "link", "textcontent"), "textcontent", encoder), named, keep)
    updates = tagged.where("tags is not null").select(row_id, "link", "tags")
    by_link = one_per_key(updates.where("link is not null"), ["link"], [row_id])
    return update_all(backend, updates, {row_id: row_id}, ["tags"]), update_all(reader, by_link, {"href": "link"}, ["tags"])
