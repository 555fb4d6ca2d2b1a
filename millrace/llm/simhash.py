"""SimHash near-duplicate detection by exact tiled comparison.

1. Every text gets a 64-bit fingerprint: the bitwise majority of the XXH64
   values (seed 42) of its word shingles, repeats included.
2. Distinct fingerprints are laid out in tiles by the population counts of
   their parts (four of 16 bits, or eight of 8 bits for large inputs). Two
   fingerprints within the radius have part counts within the radius in sum,
   so every tile is compared with the neighbouring tiles only and all other
   tile pairs are skipped. Within a pair of tiles every fingerprint meets every
   other by exclusive-or and bit count: no link is missed.
3. Each comparing task reduces its links to a spanning forest, and distributed
   connected components join the forests.

Hot groups: equal texts share one fingerprint and are collapsed before the
comparison; a crowded cell is cut into tiles of bounded size.

``similar_texts`` groups by the Jaccard similarity of the shingle sets. The
fingerprints of the sets that lie within the radius, found as above, are its
first candidates. Most such pairs differ in more bits than a search by radius
reaches, so BANDS bands of BAND_ROWS minima each propose the others. Every link
is verified on the whole sets, whoever proposed it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tables import free_names, load
from millrace.llm.workers import map_batches
from millrace.operators.components import connected_components
from millrace.scratch import materialize

SEED = 42
SHINGLE = 3
RADIUS = 2
TILE_ROWS = 2048
ROWS_PER_GROUP = 150_000
MANY_FINGERPRINTS = 4_000_000
#: A pair of similarity 0.8 shares none of the bands with a chance of 7e-5.
BANDS, BAND_ROWS = 24, 5
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
SIMILAR_TILE = 512
#: Up to so many links are joined to groups by one task, more by rounds of joins.
FEW_LINKS = 1 << 19


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle in order; of all words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)),
        np.uint64,
        len(words) - width + 1,
    )


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer.

    Null and texts without words give 0; with fewer words than a shingle has,
    the whole sequence counts as one shingle.
    """
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, h, fp) for every row; ``fp`` holds the 64 bits as a signed long and
    ``h`` the hash of the text, which tells apart the texts of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter(
                (text_fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))], ["id", "h", "fp"])

    narrow = _narrow(docs, id_col, text_col)
    return map_batches(narrow, run, f"id {narrow.schema['id'].dataType.simpleString()}, h long, fp long")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))


def near_links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(src, dst) links that span the groups of distinct values ``fp`` within
    ``radius`` bits: transitively they say the same as all such pairs."""
    distinct = prints.select("fp").where("fp is not null").distinct()
    n = distinct.count()
    parts = 4 if n < MANY_FINGERPRINTS else 8
    width = 64 // parts
    base = width + 1

    masks = [((1 << width) - 1) << (width * i) for i in range(parts)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    powers = [base**i for i in range(parts)]
    placed = distinct.selectExpr("fp", *[f"bit_count(fp & {m}L) p{i}" for i, m in enumerate(signed)])
    placed = placed.withColumn("cell", F.expr(" + ".join(f"p{i} * {b}L" for i, b in enumerate(powers))))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("tiles"))

    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius]
    ahead = [s for s in steps if s > (0,) * parts]
    inside = ", ".join(
        "if({}, cell + {}L, null)".format(
            " and ".join(f"p{i} + {d} between 0 and {width}" for i, d in enumerate(s) if d),
            sum(d * b for d, b in zip(s, powers, strict=True)),
        )
        for s in ahead
    )
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    at_home = placed.join(sizes, "cell").select("cell", own.alias("tile"), "fp", "tiles")
    guests = (
        placed.select("fp", F.explode(F.expr(f"array_compact(array({inside}))")).alias("cell"))
        .join(sizes, "cell")
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "fp")
    )
    # rows of a cell that has several tiles also visit the later tiles of their own cell
    movers = at_home.where("tile < tiles - 1").select(
        "cell", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), "fp"
    )
    rows = at_home.select("cell", "tile", "fp", F.lit(True).alias("home")).unionByName(
        guests.unionByName(movers).withColumn("home", F.lit(False))
    )
    groups = max(64, n * (len(ahead) + 1) // ROWS_PER_GROUP)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("cell", "tile"), F.lit(groups)).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "tile", "home", "fp"], ascending=[True, True, False, True])
        fps = pdf["fp"].to_numpy().view(np.uint64)
        home = pdf["home"].to_numpy()
        cells, tiles = pdf["cell"].to_numpy(), pdf["tile"].to_numpy()
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (tiles[1:] != tiles[:-1])) + 1
        left, right = [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True):
            residents = fps[a : a + int(home[a:b].sum())]
            for x, y in tile_links(residents, fps[a + len(residents) : b], radius):
                left.append(x)
                right.append(y)
        if not left:
            return pd.DataFrame({"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64)})
        src, dst = spanning_forest(np.concatenate(left), np.concatenate(right))
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return rows.groupBy("grp").applyInPandas(compare, "src long, dst long")


def tile_links(
    residents: np.ndarray, guests: np.ndarray, radius: int, block: int = 1 << 21
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``radius`` among residents and between them and guests."""
    if not len(residents):
        return
    others = np.concatenate((residents, guests))
    step = max(1, block // len(residents))
    for at in range(0, len(others), step):
        part = others[at : at + step]
        i, j = np.nonzero(np.bitwise_count(residents[:, None] ^ part[None, :]) <= radius)
        keep = (j + at >= len(residents)) | (i < j + at)
        if keep.any():
            yield residents[i[keep]], part[j[keep]]


def spanning_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with its group's root; loses no connection."""
    nodes, codes = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = codes[: len(left)], codes[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits. Null texts, empty texts and texts without words
    have fingerprint 0 and are linked like any other. Rows with a null id take
    part; a group that has null ids only gets a null component. Repeated rows
    stay. Columns other than the two named are ignored. An empty table gives
    an empty result.
    """
    return near_groups(docs, id_col, text_col, shingle, radius).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(id, h, fp, component, component_id) of all rows, by fingerprints."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    return _labelled(prints, near_links(prints, radius))


def joined_groups(links: DataFrame) -> DataFrame:
    """``connected_components`` of links (src, dst) between longs that differ, in
    one task if they are few: the rounds' many small jobs cost the driver more
    memory than the links take."""
    links = materialize(links.select("src", "dst"))
    if links.count() > FEW_LINKS:
        return connected_components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            node, root = spanning_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            roots = np.unique(root)
            columns = [pa.array(np.concatenate(x)) for x in ((node, roots), (root, roots))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "component"])

    return map_batches(links.coalesce(1), run, "node long, component long")


def _labelled(prints: DataFrame, links: DataFrame, join=connected_components) -> DataFrame:
    """``prints`` (id, h, fp) with ``component``, a number for each group, and
    ``component_id``, its smallest id, for links between values of ``fp``."""
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    groups = join(links)
    linked = firsts.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    lowest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    mapping = linked.join(lowest, "component").select("fp", "component", "component_id")
    return prints.join(mapping, "fp").select("id", "h", "fp", "component", "component_id")


def set_hash(shingles: np.ndarray) -> int:
    """One number for a sorted set of shingle hashes; 0 for the empty set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if len(shingles) else 0


def band_hashes(shingles: np.ndarray) -> list[int]:
    """A signed number for each band of minima of a set; none for the empty set."""
    if not len(shingles):
        return []
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64)
    minima = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 11):
        np.minimum(minima, (shingles[None, at : at + (1 << 11)] * factor + shift).min(axis=1), out=minima)
    bands = minima.reshape(BANDS, BAND_ROWS)
    digests = [xxhash.xxh64_intdigest(band.tobytes(), number) for number, band in enumerate(bands)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def similar_links(sets: dict[int, np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links that span the groups of sets of a Jaccard ``similarity`` or more."""
    names = sorted(sets)
    sizes = np.array([len(sets[n]) for n in names])
    flat = np.concatenate([sets[n] for n in names])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(names)), sizes)
    label = np.arange(len(names))
    for i, name in enumerate(names[:-1]):
        if (label[i + 1 :] == label[i]).all():
            continue
        mine, rest = sets[name], flat[ends[i] :]
        place = np.minimum(np.searchsorted(mine, rest), len(mine) - 1)
        shared = np.bincount(owner[ends[i] :][mine[place] == rest], minlength=len(names))[i + 1 :]
        # shared / union >= similarity, in doubles: 0.8 of a whole number of five is met exactly
        near = i + 1 + np.flatnonzero(shared >= similarity * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9)
        for j in near.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield name, names[j]


def similar_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SIMILAR_SHINGLE,
    similarity: float = SIMILARITY,
    tile_rows: int = SIMILAR_TILE,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per input row: id and ``component_id``, the smallest id reachable
    over pairs whose sets of word shingles have a Jaccard ``similarity`` or more.

    Null texts and texts without words are alike. Rows without an id take part.
    """
    groups = similar_groups(docs, id_col, text_col, shingle, similarity, tile_rows, radius)
    return groups.select(F.col("id").alias(id_col), "component_id")


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SIMILAR_SHINGLE,
    similarity: float = SIMILARITY,
    tile_rows: int = SIMILAR_TILE,
    radius: int = RADIUS,
) -> DataFrame:
    """(id, h, fp, component, component_id) of all rows, by similarity.

    Texts whose fingerprints lie within ``radius`` bits or that share a band are
    joined to clusters; within a cluster every text meets every other, a crowded
    one being cut into tiles. ``fp`` numbers the distinct sets of shingles, and
    the fingerprint is that of the set.
    """
    narrow = _narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(2)]
            fps = np.fromiter(map(set_hash, found), np.uint64, len(found)).view(np.int64)
            # the empty set is like no other
            empty = np.fromiter((not len(x) for x in found), bool, len(found))
            bits = pa.array(np.fromiter(map(majority, found), np.uint64, len(found)).view(np.int64), mask=empty)
            bands = pa.array([band_hashes(x) for x in found], pa.list_(pa.int64()))
            columns = [*batch.columns[:2], pa.array(fps), bits, bands]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "fp", "bits", "bands"])

    kind = narrow.schema["id"].dataType.simpleString()
    prints = materialize(map_batches(narrow, run, f"id {kind}, h long, fp long, bits long, bands array<long>"))
    banded = prints.select("fp", F.explode("bands").alias("band")).distinct()
    least = banded.groupBy("band").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = banded.join(least, "band").where("fp <> low").select(F.col("low").alias("src"), F.col("fp").alias("dst")).distinct()
    candidates = stars.unionByName(_fingerprint_links(prints, radius))
    members = materialize(joined_groups(candidates).select(F.col("node").alias("fp"), F.col("component").alias("cluster")))
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("tiles"))
    reps = prints.join(members, "fp").groupBy("fp", "cluster").agg(F.min(F.struct("id", "h")).alias("rep"))
    owners = reps.join(sizes, "cluster").select("fp", "cluster", "tiles", F.col("rep.id").alias("rep"), F.col("rep.h").alias("rep_h"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            fps = np.fromiter(map(set_hash, found), np.uint64, len(found)).view(np.int64)
            # another text of one id and hash
            right = pa.array(fps == batch.column("fp").to_numpy())
            sets = pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
            columns = [batch.column("cluster"), batch.column("fp"), batch.column("tiles"), sets]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "fp", "tiles", "s"]).filter(right)

    own = F.col("id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h"))
    texts = narrow.join(owners, own).select("cluster", "fp", "tiles", "text")
    sets = map_batches(texts, to_sets, "cluster long, fp long, tiles int, s array<long>")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = sets.withColumn("own", tile).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    met = met.select("cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "s")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = {n: np.asarray(x, np.int64).view(np.uint64) for n, x in zip(pdf["fp"], pdf["s"], strict=True)}
        pairs = list(similar_links(sets, similarity))
        return pd.DataFrame(pairs, columns=["src", "dst"]).astype("int64")

    links = met.groupBy("cluster", "a", "b").applyInPandas(compare, "src long, dst long")
    return _labelled(prints.select("id", "h", "fp"), links, joined_groups)


def _fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """(src, dst) links between sets ``fp`` that span the groups whose
    fingerprints ``bits`` lie within ``radius``, equal ones among them."""
    near = near_links(prints.select(F.col("bits").alias("fp")), radius)
    owners = prints.where("bits is not null").groupBy("bits").agg(F.min("fp").alias("low"))
    equal = prints.join(owners, "bits").where("fp <> low").select(F.col("low").alias("src"), F.col("fp").alias("dst"))
    left = owners.select(F.col("bits").alias("src"), F.col("low").alias("a"))
    right = owners.select(F.col("bits").alias("dst"), F.col("low").alias("b"))
    apart = near.join(left, "src").join(right, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return equal.unionByName(apart).distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest
    id, rows without an id coming last; of several texts of that id the one of
    the smallest hash. Of rows alike in id and text any one stays. No other row
    goes, whether ids repeat or are null. The groups are those of ``groups``
    (id, h, component), by default of ``near_groups``."""
    groups = materialize((near_groups(docs, id_col, text_col) if groups is None else groups).select("id", "h", "component"))
    key_id, key_h, own_h = free_names(docs, "key_id", "key_h", "own_h")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"))
    chosen = first.select(F.col("first.id").alias(key_id), F.col("first.h").alias(key_h))
    hashed = docs.withColumn(own_h, F.xxhash64(text_col))
    kept = hashed.join(chosen, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(own_h) == F.col(key_h)), "left_semi")
    if not groups.groupBy("id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, own_h])
    return kept.select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return near_duplicates(load(spark, sf_dir, "documents"))
