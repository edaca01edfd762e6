"""SimHash near-duplicates: exact links within a radius, by tiles that numpy compares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal_tiles, group_bounds, local_labels, materialize, whole_groups
from .components import connected_components


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed long; 0 if it has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, max(1, len(words) - width + 1))
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def add_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, digest: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp: the texts stay behind, 16 bytes a document leave this stage. digest: columns of which a 64-bit hash comes along."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", "digest"][: b.num_columns])

    more = [F.xxhash64(*digest).alias("digest")] if digest else []
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return picked.mapInArrow(run, "doc_id long, fp long" + (", digest long" if digest else ""))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """radius + 1 blocks of the 64 bits, as shift and width: texts within the radius agree on one at least."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def tile_links(fp_l: np.ndarray, fp_r: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix of the pairs within the radius: exclusive-or and bit counts."""
    return np.bitwise_count(fp_l[:, None] ^ fp_r[None, :]) <= radius


def banded(fps: DataFrame, radius: int) -> DataFrame:
    """fp, block, value, cell, band: the fingerprints once for each bit block and each cell of bit counts they take part in.

    A band holds radius + 1 neighbouring bit counts. Counts of a pair within the radius differ by the radius at most, so
    they lie in one band or in neighbouring ones: cell c compares band c with itself and with band c + 1. All other pairs of
    bands are skipped here, before anything is sent.
    """
    blocks = F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
            for i, (s, w) in enumerate(_blocks(radius))
        ]
    )
    band = F.floor(F.bit_count("fp") / F.lit(radius + 1)).cast("int")
    rows = fps.select("fp", band.alias("band"), F.explode(blocks).alias("b"))
    return rows.select("fp", "b.block", "b.value", "band", F.explode(F.array(F.col("band") - 1, "band")).alias("cell"))


def tile_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """One row: pairs of tiles (bands of one block value) that are compared, and those that are skipped for their bit counts."""
    tiles = banded(fps.select("fp").distinct(), radius).where("cell = band").groupBy("block", "value").agg(F.collect_set("band").alias("bands"))
    n = F.size("bands").cast("long")  # 64 / (radius + 1) + 1 bands at most
    near = n + F.aggregate("bands", F.lit(0).cast("long"), lambda k, x: k + F.array_contains("bands", x + 1).cast("long"))
    return tiles.agg(F.sum(near).alias("compared"), F.sum(n * (n + 1) / 2 - near).cast("long").alias("skipped"))


def _compare(radius: int):
    def one(cell, fp, band, part):
        """Links of one cell, as (larger, smaller) ends of a spanning forest."""
        order = np.lexsort((fp, band))
        fp, band, part = fp[order], band[order], part[order]
        low = int((band == cell).sum())
        linked = np.zeros((len(fp), len(fp)), bool)
        linked[:low] = tile_links(fp[:low], fp, radius)  # the upper band is compared with itself in the next cell
        linked[:, :low] |= linked[:low].T
        if part.min() != part.max():
            linked &= part[:, None] != part[None, :]
        label = local_labels(linked)
        far = label != np.arange(len(fp))
        return fp[far], fp[label[far]]

    def run(batches):
        names = ["block", "value", "cell", "cell_a", "cell_b"]
        for t in whole_groups(batches, names):
            if t is None:
                continue
            col = {c: t.column(c).to_numpy() for c in t.column_names}
            fp = col["fp"].view(np.uint64)
            at = group_bounds([col[c] for c in names])
            found = [one(col["cell"][s], fp[s:e], col["band"][s:e], col["part"][s:e]) for s, e in zip(at, at[1:], strict=False) if e - s > 1]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def simhash_components(fps: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """fp, component: each fingerprint that links to another, and the least fingerprint that links within the radius reach.

    Copies collapse first: one row stands for all documents of a fingerprint. A pair within the radius has one of
    radius + 1 bit blocks in common, so comparing within equal blocks loses no link; this spreads the work. Inside a block, tiles
    of neighbouring bit counts meet and others are skipped. A cell that many fingerprints share is dealt over pairs of
    parts, so no task holds more than two tiles at once; each cell returns a spanning forest, never all its pairs.
    """
    rows = banded(fps.select("fp").distinct(), radius).withColumn("key", F.xxhash64("block", "value", "cell"))
    cells = deal_tiles(rows, "key", "fp", tile).drop("key")
    order = ["block", "value", "cell", "cell_a", "cell_b"]
    cells = cells.repartition(*order).sortWithinPartitions(*order)
    links = cells.mapInArrow(_compare(radius), "a long, b long")
    return connected_components(links).withColumnRenamed("node", "fp")


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3, tile: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, kept.

    Null and wordless texts have fingerprint zero and link like any other. Rows that repeat an id each keep
    their own fingerprint. A row without id links like any other but gives a component no id; one whose component has
    no id at all has a null component_id. kept: the row's id is the component's, or the component has none.
    """
    fps = materialize(add_fingerprint(docs, id_col, text_col, width), "fingerprints")  # 16 bytes a document; spares hashing all texts twice
    found = simhash_components(fps, radius, tile)
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = reps.join(ids, "component").select("fp", "component_id")
    return fps.join(ids, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def one_of_each(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), radius: int = 2, width: int = 3, tile: int = 2048) -> DataFrame:
    """The rows of docs (its columns: `columns`) without near-duplicates: one row of each component, that with the smallest id.

    A null id comes after all others. Among rows of one id those of the least fingerprint and hash come first; rows
    equal in all columns are one. Texts are hashed once, and shuffled once in the join that takes the rows kept.
    """
    fps = materialize(add_fingerprint(docs, width=width, digest=columns), "fingerprints")
    found = simhash_components(fps, radius, tile)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "digest")
    best = fps.groupBy("fp").agg(F.min(rank).alias("first")).join(found, "fp", "left")
    best = best.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    own, nameless = F.xxhash64(*columns), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    best = best.select(F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("first.digest").alias("_own"))
    rows = docs.select(*columns, own.alias("_own"), nameless.alias("_id")).join(best, ["_own", "_id"], "left_semi")
    return rows.dropDuplicates(["_own", "_id"]).select(*columns)
