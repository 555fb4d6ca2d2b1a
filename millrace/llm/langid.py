"""Language identification with averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed byte n-grams (within words,
with the neighbouring blank as boundary mark), and a linear softmax follows.
Embeddings and softmax are trained by stochastic gradient descent in numpy on
a bounded sample of labelled rows. Temperature scaling on a part of the sample
that training leaves out calibrates the probabilities; predictions below
``reject_below`` are rejected.

Because the classifier is linear after averaging, embedding and softmax fold
into one table of bucket x language weights for scoring, which reads each byte
of every text from the Arrow buffers without making Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.tables import free_names, load
from millrace.llm.workers import bound_batches, frugal, give_back, map_batches
from millrace.scratch import materialize

UNKNOWN = "und"
BUCKET_BITS = 15
GRAMS = (2, 3, 4)
DIM = 16
#: Bounds on the labelled rows that training takes; every language has its share.
SAMPLE_PER_LANG, SAMPLE_ROWS = 500, 1 << 15
HASH_RANGE = 1 << 31
EPOCHS = 3
RATE = 0.3
REJECT_BELOW = 0.5
CHUNK_BYTES = 1 << 18

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def buckets(data: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n-gram size the bucket of the n-gram starting at each byte and
    whether it counts (no blank inside). Bucket arrays are shorter than
    ``data`` by n - 1."""
    x = _CLASS[data]
    blank = x == 32
    mixed = x * np.uint32(0x9E3779B1)
    state = mixed
    out, valid = [], []
    inside = np.zeros(len(x), bool)
    for n in range(2, max(GRAMS) + 1):
        if len(x) < n:
            out.append(np.empty(0, np.uint32))
            valid.append(np.empty(0, bool))
            continue
        state = (state[:-1] ^ (state[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + mixed[n - 1 :]
        if n == 2:
            ok = ~(blank[:-1] & blank[1:])
        else:
            inside = inside[:-1] | blank[n - 2 : len(x) - 1]
            ok = ~inside
        if n == 2:
            inside = np.zeros(len(x) - 1, bool)
        if n in GRAMS:
            out.append((state * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BUCKET_BITS))
            valid.append(ok)
    return out, valid


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, which sum to 1."""
    found, valid = buckets(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    counts = np.bincount(
        np.concatenate([f[v] for f, v in zip(found, valid, strict=True)] or [np.empty(0, np.uint32)]),
        minlength=1 << BUCKET_BITS,
    )
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / max(1, counts.sum())


@dataclass(frozen=True)
class LanguageModel:
    """``table`` holds for every bucket its weights for the languages, or, when
    there are more languages than dimensions, its embedding, which ``head``
    turns into weights for the languages."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    head: np.ndarray | None = None

    def logits(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        mean = sums / np.maximum(grams, 1)[:, None]
        return (mean if self.head is None else mean @ self.head) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel | None:
    """Train on (text, lang) pairs, every eighth of which only calibrates.

    Deterministic for a given order of rows. No rows: None.
    """
    return fit_features([(*features(text), lang) for text, lang in rows], seed)


def fit_features(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> LanguageModel | None:
    """``fit`` on (buckets, shares, lang)."""
    langs = tuple(sorted({lang for _, _, lang in rows}))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    known = {lang: i for i, lang in enumerate(langs)}
    data = [(ids, share, known[lang]) for ids, share, lang in rows if len(ids)]
    tune = data[::8] if len(data) >= 64 else data
    train = [d for i, d in enumerate(data) if i % 8] if len(data) >= 64 else data
    embed = rng.normal(0, 1 / DIM, (1 << BUCKET_BITS, DIM))
    out = np.zeros((DIM, len(langs)))
    bias = np.zeros(len(langs))
    steps, total = 0, max(1, EPOCHS * len(train))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(train)):
            ids, share, y = train[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ embed[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * 10 * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            embed[ids] -= rate * 100 * share[:, None] * back
    table, head = ((embed @ out).T, None) if len(langs) <= DIM else (embed.T, out)
    model = LanguageModel(langs, np.ascontiguousarray(table), bias, 1.0, head)
    if not tune:
        return model
    logits = model.logits(np.array([table[:, ids] @ share for ids, share, _ in tune]), np.ones(len(tune)))
    truth = np.array([y for _, _, y in tune])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())

    best = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0), key=loss)
    return replace(model, temperature=best)


def fold_of(id_col: str = "doc_id") -> Column:
    """True for the held-out fifth: crc32 of the id as text, modulo 5, is 0. A
    null id counts as the empty text and is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on rows of every language of the training folds, in hash order of the
    id: at most SAMPLE_PER_LANG of each, and at most SAMPLE_ROWS of all unless
    that left a language without a row.

    The ranking reads ids and languages only, and of each language only as many
    of the lowest hashes as hold the sample, so that a frequent language gives
    its task no more rows than another. The texts of the sample then come by a
    join, and only their features reach the driver, whatever the texts' lengths.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~fold_of(id_col))
    usable = usable.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = materialize(usable.groupBy("lang").agg(F.count("*").alias("n")))
    most = max(1, min(SAMPLE_PER_LANG, SAMPLE_ROWS // max(1, sizes.count())))
    order = Window.partitionBy("lang").orderBy("hash", "id")
    low = F.pmod(F.col("hash"), F.lit(HASH_RANGE)) <= F.lit(2.0 * most * HASH_RANGE) / F.col("n")
    ranked = (
        usable.select("id", "lang", F.xxhash64("id").alias("hash")).join(sizes, "lang").where(low)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    )
    # at most ``most`` ids of each language, each with one text
    chosen = ranked.groupBy("id", "lang").agg(F.min("rank").alias("rank"))
    if most * sizes.count() <= SAMPLE_ROWS:
        chosen = F.broadcast(chosen)
    picked = usable.join(chosen, ["id", "lang"]).groupBy("id", "lang", "rank").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["lang", "rank", "ids", "shares"])

    schema = "lang string, rank int, ids array<int>, shares array<float>"
    table = map_batches(picked.select("lang", "rank", "text"), counted, schema).toArrow()
    table = table.sort_by([("rank", "ascending"), ("lang", "ascending")]).combine_chunks()
    ids, shares = (table.column(c).combine_chunks() for c in ("ids", "shares"))
    rows = range(table.num_rows)
    langs = table.column("lang").to_pylist()
    model = fit_features([(ids[i].values.to_numpy(), shares[i].values.to_numpy(), langs[i]) for i in rows])
    del table, ids, shares
    give_back()
    return model


def _large_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, without a copy of the bytes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.empty(0, np.uint8)
    return offsets, data


def score_texts(model: LanguageModel, column: pa.Array) -> np.ndarray:
    """Calibrated probabilities of every text: rows x languages.

    Works through the bytes in chunks of bounded size that need not end where
    texts end, so one very long text takes no more memory than many short ones.
    """
    offsets, data = _large_binary(column)
    rows = len(column)
    sums = np.zeros((rows, len(model.table)))
    grams = np.zeros(rows)
    longest = max(GRAMS)
    for at in range(int(offsets[0]), int(offsets[-1]), CHUNK_BYTES):
        end = min(at + CHUNK_BYTES, int(offsets[-1]))
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        bounds = np.maximum(offsets[first:last], at) - at
        full = np.flatnonzero(np.diff(np.append(bounds, end - at)) > 0)
        found, valid = buckets(data[at : min(end + longest - 1, int(offsets[-1]))])
        for n, ids, ok in zip(GRAMS, found, valid, strict=True):
            m = min(len(ids), end - at)
            ids, ok = ids[:m], ok[:m]
            stops = offsets[first + 1 : last + 1] - at
            for k in range(1, n):  # n-grams that would reach into the next text
                over = stops - k
                ok[over[(over >= 0) & (over < m)]] = False
            starts = bounds[full]
            inside = starts < m
            if not inside.any():
                continue
            target = first + full[inside]
            grams[target] += np.add.reduceat(ok, starts[inside], dtype=np.int64)
            for j in range(len(model.table)):
                weights = model.table[j][ids]
                weights *= ok
                sums[target, j] += np.add.reduceat(weights, starts[inside])
    return model.probabilities(model.logits(sums, grams))


def has_letter(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def judged(model: LanguageModel | None, text_col: str = "text") -> Column:
    """Struct of ``lang_pred`` and ``score`` of a text. Texts go to Python and
    nothing comes back but these two."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    @frugal
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
            if model is not None and known.any():
                p = score_texts(model, pc.fill_null(texts, ""))
                best = p.argmax(1)
                lang[known] = np.array(model.langs, object)[best[known]]
                score[known] = p[np.arange(len(p)), best][known]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predict(F.when(has_letter(text_col), F.col(text_col)))


def accepted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns as they are."""
    bound_batches(docs.sparkSession)
    (found,) = free_names(docs, "found")
    judgement = docs.withColumn(found, judged(model, text_col))
    kept = (F.col(found)["lang_pred"] != UNKNOWN) & (F.col(found)["score"] >= reject_below)
    return judgement.where(kept).select(*docs.columns)


def identify(
    docs: DataFrame, model: LanguageModel | None, text_col: str = "text", reject_below: float = REJECT_BELOW
) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (the calibrated probability of
    that language) and ``rejected``.

    Null texts and texts without a letter get ``und`` with score 0 and are
    rejected; without a model so does every text. Whole texts are read.
    Repeated rows stay. Columns of these three names in ``docs`` are replaced.
    """
    bound_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "rejected")
    (found,) = free_names(kept, "found")
    score, lang = F.col(found)["score"], F.col(found)["lang_pred"]
    return kept.withColumn(found, judged(model, text_col)).select(
        *kept.columns,
        lang.alias("lang_pred"),
        score.alias("score"),
        ((score < reject_below) | (lang == UNKNOWN)).alias("rejected"),
    )


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs)
    narrow = docs.select("doc_id", fold_of().alias("held_out"), "text")
    return identify(narrow, model).drop("text")
