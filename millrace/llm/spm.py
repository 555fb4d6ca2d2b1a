"""SentencePiece encoding and decoding over a relational lattice.

The distinct stretches of the corpus that no piece can cross ("words", each
with its leading blanks) are found first. Their substrings of bounded length
are exploded, equi-joined to the piece table, and the edges found are grouped
by word: the lattice. A higher-order ``aggregate`` folds each lattice into the
best segmentation: the Viterbi path for a unigram model; for a BPE model the
merges in order of their rank, because the path of the best rank sum is not
what a BPE model means (README has figures). Every document's ids are then put
together, decoded, restored and compared with the document.

Skew and size: the words that are most frequent in a sample, at most HOT_WORDS
of at most HOT_LENGTH bytes, are encoded first and broadcast, so that the words
that make up most of every text never move. A document leaves its task as the
numbers of its words; of its other words only the distinct ones are dealt out,
each with the documents it came from, encoded, and sent back to their
documents. Both reads of the texts depend on the texts alone, so a lost task is
done again with the same result. Two kinds of rare words are encoded by the
tokenizer library in Arrow batches instead: those longer than LONG characters,
as a fold over a lattice takes quadratic time, and under BPE those with runs of
blanks, whose pieces share one rank, so that one pass over ranks does not order
them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tables import load
from millrace.llm.workers import give_back, map_batches
from millrace.scratch import materialize

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
HOT_WORDS = 1 << 18
HOT_LENGTH = 64
SAMPLE_TEXTS = 8192
HASH_RANGE = 1 << 31
SEED = 42
WORDS_PER_TASK = 1 << 15
TEXT_PER_TASK = 1 << 24
#: Bytes of texts, or of word numbers, that are worked on at a time.
SLICE_BYTES = 1 << 22
LONG = 256
#: Bits of an edge that hold start and length, each, and the id of its piece.
BITS, ID_BITS = 9, 17
#: Fixed values of the model file format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """A piece vocabulary; ids are list positions."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    dummy_prefix: bool = True
    proto: bytes = field(default=b"", repr=False)

    @property
    def usable(self) -> list[tuple[str, int, float]]:
        return [(p, i, s) for i, (p, s, k) in enumerate(self.pieces) if k in (NORMAL, USER_DEFINED)]

    @property
    def byte_ids(self) -> list[int] | None:
        found = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        return [found[f"<0x{b:02X}>"] for b in range(256)] if found else None

    @property
    def unknown_id(self) -> int:
        return next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)

    def cuts(self) -> np.ndarray:
        """Flags over pairs of bytes, 256 * first + second: no piece holds the
        second right behind the first, so a text may be cut between them. Never
        within a character. Blanks count as the byte 32."""
        cut = np.ones((256, 256), bool)
        cut[:, 0x80:0xC0] = False
        for piece, _, _ in self.usable:
            data = np.frombuffer(piece.replace(BLANK, " ").encode(), np.uint8)
            cut[data[:-1], data[1:]] = False
        return cut.ravel()


def read_model(path: str = MODEL_PATH) -> PieceModel:
    """Read a model file. Only the identity normalisation is supported."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, kind, prefix = [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            at = dict(_fields(value))
            pieces.append((at[1].decode(), struct.unpack("<f", at[2])[0] if 2 in at else 0.0, at.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            at = dict(_fields(value))
            if at.get(2) or at.get(4, 1):
                raise ValueError("the model normalises texts; only the identity is supported")
            prefix = bool(at.get(3, 1))
    return PieceModel(tuple(pieces), kind, prefix, data)


def marked(text: Column, model: PieceModel) -> Column:
    """The text that the model sees, with plain blanks: one is put in front of
    every text that is not null or empty, and U+2581 means a blank."""
    prefix = F.lit(" " if model.dummy_prefix else "")
    return F.when(F.length(text) > 0, F.concat(prefix, F.replace(text, F.lit(BLANK), F.lit(" ")))).otherwise(F.lit(""))


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold at most ``most`` bytes, or one row each."""
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, stop
        at = stop


def split_words(texts: pa.Array, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, in order and without a copy, and for each text
    and the end the number of words before it. Texts are as ``marked`` gives."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, size = int(ends[0]), int(ends[-1] - ends[0])
    if not size:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + size]
    begins = np.empty(size, bool)
    pairs = data[:-1].astype(np.uint16)
    pairs <<= 8
    pairs |= data[1:]
    np.take(cuts, pairs, out=begins[1:])
    local = ends - first
    begins[local[:-1][np.diff(local) > 0]] = True
    places = np.flatnonzero(begins)
    offsets = np.append(places, size) + first
    words = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), texts.buffers()[2])
    return words, np.searchsorted(places, local)


@dataclass(frozen=True)
class Frequent:
    """Frequent words, the most frequent first, and their ids."""

    words: pa.Array
    ids: pa.Array


def number_words(texts: pa.Array, cuts: np.ndarray, frequent: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The words of texts as numbers: its place for a frequent word; for another
    the count of the frequent words plus its place among the distinct other
    words of its text, in order of their first occurrence. So a text's numbers
    depend on that text only.

    Returns the numbers, for each text and the end the number of words before
    it, and for each distinct other word of each text: text, place and word.
    """
    words, bounds = split_words(texts, cuts)
    coded = words.dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, value_set=frequent), -1).to_numpy().astype(np.int64)
    which = coded.indices.to_numpy()
    numbers = known[which]
    rare = np.flatnonzero(numbers < 0)
    owner = np.searchsorted(bounds, rare, "right") - 1
    _, first, inverse = np.unique(owner * (len(known) + 1) + which[rare], return_index=True, return_inverse=True)
    order = np.argsort(first)
    text = owner[first[order]]
    place = np.arange(len(order)) - np.searchsorted(text, text)
    place_of = np.empty(len(order), np.int64)
    place_of[order] = place
    numbers[rare] = len(frequent) + place_of[inverse]
    return numbers, bounds, text, place, coded.dictionary.take(pa.array(which[rare[first[order]]]))


def pack(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes: seven bits each, the lowest first, the highest
    bit set on all but the last byte of a number."""
    size = np.ones(len(numbers), np.int64)
    for bits in range(7, 63, 7):
        more = numbers >= 1 << bits
        if not more.any():
            break
        size += more
    starts = np.concatenate(([0], np.cumsum(size)))
    data = np.empty(starts[-1], np.uint8)
    at, left, size = starts[:-1], numbers, size
    while len(left):
        longer = size > 1
        data[at] = (left & 127) | np.where(longer, 128, 0)
        at, left, size = at[longer] + 1, left[longer] >> 7, size[longer] - 1
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(starts[bounds]), pa.py_buffer(data)])


def unpack(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``pack``: numbers, and for each row and the end the numbers before it."""
    rows = rows.cast(pa.large_binary())
    ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    if ends[0] == ends[-1]:
        return np.empty(0, np.int64), np.zeros(len(ends), np.int64)
    data = np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    last = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], last[:-1] + 1))
    numbers = (data[starts] & 127).astype(np.int64)
    size, some, at, shift = last - starts, np.arange(len(starts)), starts, 0
    while True:
        longer = size > 0
        if not longer.any():
            break
        some, at, size, shift = some[longer], at[longer] + 1, size[longer] - 1, shift + 7
        numbers[some] |= (data[at] & 127).astype(np.int64) << shift
    return numbers, np.searchsorted(starts, ends - ends[0])


def ranked(model: PieceModel) -> list[tuple[str, int, float]]:
    """Pieces by score, best first; the place in this list is a piece's rank."""
    return sorted(model.usable, key=lambda p: (-p[2], p[1]))


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """``words`` with ``edges``: all pieces in each word, as sorted numbers that
    hold rank, id, start (from 1) and length of a piece, after the edge -1.

    The edges of a word leave the explode and the broadcast join one after the
    other, the edge -1 first, so they are grouped as they come, without a
    shuffle or a sort of all edges, and only one batch is held. An order other
    than this one is an error, not a wrong result.
    """
    longest = max((len(p) for p, _, _ in model.usable), default=1)
    if len(model.pieces) >= 1 << ID_BITS:
        raise ValueError("the vocabulary is too large for the packed edges")
    codes = [(p, ((rank << ID_BITS) + i) << 2 * BITS) for rank, (p, i, _) in enumerate(ranked(model))]
    table = pd.DataFrame([("", -1), *codes], columns=["piece", "code"])
    # the size of the vocabulary bounds what is broadcast
    pieces = F.broadcast(words.sparkSession.createDataFrame(table, "piece string, code long"))
    starts = words.select("*", F.replace("word", F.lit(" "), F.lit(BLANK)).alias("_text"))
    starts = starts.select("*", F.explode(F.expr("sequence(1, char_length(_text))")).alias("_s"))
    lengths = f"sequence(if(_s = 1, 0, 1), least({longest}, char_length(_text) - _s + 1))"
    spans = starts.select("*", F.explode(F.expr(lengths)).alias("_l")).withColumn("piece", F.expr("substring(_text, _s, _l)"))
    edge = F.expr(f"if(code < 0, -1L, code + _s * {1 << BITS} + _l)")
    once = [F.when(F.col("_l") == 0, F.col(c)).alias(c) for c in words.columns]
    edges = spans.join(pieces, "piece").select(*once, edge.alias("edges"))
    return map_batches(edges, _group_runs, words.withColumn("edges", F.lit(None).cast("array<bigint>")).schema)


def _group_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (columns of the word, edge) to one row for each word: the columns
    are those of its first row, whose edge is -1."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(table.column("edges").to_numpy() == -1)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield _runs(table.slice(0, last), starts[:-1])
        held = table.slice(last)
    if held is not None:
        yield _runs(held, np.array([0]))


def _runs(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    values = rows.column("edges").to_numpy()
    bounds = np.append(starts, len(values)).astype(np.int32)
    place = values & ((1 << 2 * BITS) - 1)
    place[starts] = -1
    rises = np.diff(place) > 0
    rises[starts[1:] - 1] = True
    if values[0] != -1 or not rises.all():
        raise RuntimeError("the edges of a word did not arrive in order")
    order = np.lexsort((values, np.repeat(np.arange(len(starts)), np.diff(bounds))))
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[order]))
    first = rows.take(pa.array(starts))
    return pa.RecordBatch.from_arrays([*first.columns[:-1], lists], first.schema.names)


def _start(e: str) -> str:
    return f"cast(shiftright({e}, {BITS}) & {(1 << BITS) - 1} as int)"


def _length(e: str) -> str:
    return f"cast({e} & {(1 << BITS) - 1} as int)"


def _spelled(model: PieceModel) -> str:
    """SQL: ids of the character ``c`` that is no piece: its bytes, or unknown."""
    if model.byte_ids is None:
        return f"array({model.unknown_id})"
    first = model.byte_ids[0]
    if model.byte_ids != list(range(first, first + 256)):
        raise ValueError("the model's byte pieces are not in one row")
    return f"transform(sequence(1, octet_length(c)), k -> {first} + cast(conv(substring(hex(encode(c, 'UTF-8')), 2 * k - 1, 2), 16, 10) as int))"


def fold_merges(model: PieceModel) -> str:
    """SQL over ``word`` and ``edges``: borders of the pieces by BPE.

    The state is the list of symbol borders. Edges come in order of rank, then
    place; one that consists of two symbols just now merges them. One pass is
    enough: a piece's parts rank before it.
    """
    s, l = _start("e"), _length("e")
    at = f"array_position(b, {s})"
    merge = f"if({at} > 0 and array_position(b, {s} + {l}) = {at} + 2, array_remove(b, element_at(b, cast({at} + 1 as int))), b)"
    return f"aggregate(edges, sequence(1, char_length(word) + 1), (b, e) -> if({l} < 2, b, {merge}))"


def fold_viterbi(model: PieceModel) -> str:
    """SQL over ``word`` and ``edges``: borders on the path of the best score sum.

    Edges are taken by end; the state holds for each border the best sum so far
    and where its last piece began. A character that is no piece costs
    UNKNOWN_PENALTY more than the worst piece. Ties go to the earlier start.
    """
    scores = [s for _, _, s in ranked(model)]
    worst = min(scores, default=0.0) - UNKNOWN_PENALTY
    table = "split('" + " ".join(map(repr, scores)) + "', ' ')"
    known = (
        f"transform(filter(edges, e -> e >= 0), e -> named_struct('e', {_start('e')} + {_length('e')}, 's', {_start('e')}, "
        f"'score', cast(element_at({table}, cast(shiftright(e, {2 * BITS + ID_BITS}) as int) + 1) as double)))"
    )
    alone = f"transform(sequence(1, char_length(word)), s -> named_struct('e', s + 1, 's', s, 'score', {worst}D))"
    new = "named_struct('sum', b[x.s - 1].sum + x.score, 'frm', x.s)"
    step = (
        f"case when size(b) < x.e then concat(b, array({new})) "
        f"when b[x.e - 1].sum < b[x.s - 1].sum + x.score then concat(slice(b, 1, size(b) - 1), array({new})) else b end"
    )
    best = f"aggregate(array_sort(concat({known}, {alone})), array(named_struct('sum', 0D, 'frm', 0)), (b, x) -> {step})"
    back = "aggregate(best, array(size(best)), (a, z) -> if(a[0] = 1, a, concat(array(best[a[0] - 1].frm), a)))"
    return f"transform(array({best}), best -> {back})[0]"


def border_ids(model: PieceModel) -> str:
    """SQL over ``word``, ``edges`` and ``borders``: the ids of the pieces."""
    place = "array_position(keys, cast(borders[i] as bigint) * {0} + borders[i + 1] - borders[i])".format(1 << BITS)
    known = f"array(cast(shiftright(edges[cast(p as int) - 1], {2 * BITS}) & {(1 << ID_BITS) - 1}L as int))"
    one_char = f"replace(substring(word, borders[i], borders[i + 1] - borders[i]), ' ', '{BLANK}')"
    spelled = f"transform(array({one_char}), c -> {_spelled(model)})[0]"
    one = f"transform(array({place}), p -> if(p > 0, {known}, {spelled}))[0]"
    keys = f"transform(edges, e -> e & {(1 << 2 * BITS) - 1}L)"
    return f"transform(array({keys}), keys -> flatten(transform(sequence(0, size(borders) - 2), i -> {one})))[0]"


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """``words`` (word, not empty, and other columns) with ``ids``. Blanks may be
    written as such or as U+2581."""
    foldable = F.char_length("word") <= LONG
    if model.kind == BPE:
        foldable = foldable & ~F.contains(F.replace("word", F.lit(BLANK), F.lit(" ")), F.lit("  "))
    short = lattice(words.where(foldable), model)
    fold = fold_merges(model) if model.kind == BPE else fold_viterbi(model)
    folded = short.withColumn("borders", F.expr(fold)).select(*words.columns, F.expr(border_ids(model)).alias("ids"))
    proto = model.proto

    def by_library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = lead = None
        for batch in batches:
            if processor is None and batch.num_rows:
                processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
                lead = len(processor.encode("\n"))
            # a newline ends every word, so that what follows it is encoded as it stands
            ids = [processor.encode("\n" + w)[lead:] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return folded.unionByName(map_batches(words.where(~foldable), by_library, folded.schema))


def decode(ids: Column, model: PieceModel) -> Column:
    """The text that the model saw, of an array of ids."""
    spelling = _spelling(model)

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        parts = spelling.take(lists.flatten())
        ends = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        bounds = ends[np.concatenate(([0], np.cumsum(sizes)))]
        data = parts.buffers()[2] if len(parts) else pa.py_buffer(b"")
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds.tobytes()), data])
        return texts.cast(pa.binary())

    return F.decode(joined(ids), "UTF-8")


def restore(text: Column, model: PieceModel) -> Column:
    """Plain text of what ``decode`` gives for a whole document."""
    return F.substring(text, 2, 2**31 - 1) if model.dummy_prefix else text


def spread(words: DataFrame) -> DataFrame:
    """``words`` in partitions of WORDS_PER_TASK: a word is few bytes and much
    work, so partitions by size would be too few."""
    return words.repartition(-(-words.count() // WORDS_PER_TASK) or 1, "word")


def _prepared(docs: DataFrame, model: PieceModel, id_col: str, text_col: str) -> DataFrame:
    """(id, h, digest, text): the texts as the model sees them, the hash of the
    texts as they stand, and in ``h`` that hash again to tell apart the texts of
    one id. Where no id repeats ``h`` is 0, which takes no room in a shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    several = not docs.groupBy(F.col(id_col)).count().where("count > 1").isEmpty()
    h = F.xxhash64(text) if several else F.lit(0).cast("long")
    return docs.select(F.col(id_col).alias("id"), h.alias("h"), F.xxhash64(text).alias("digest"), marked(text, model).alias("text"))


def frequent_words(prepared: DataFrame, model: PieceModel) -> tuple[Frequent, int]:
    """At most HOT_WORDS words of at most HOT_LENGTH bytes, the most frequent
    ones of about SAMPLE_TEXTS texts, taken by the hash of their ids; and how
    many bytes all texts have by this sample. Which words these are decides how
    a word travels and nothing else."""
    cuts, n = model.cuts(), prepared.count()
    share = SAMPLE_TEXTS * HASH_RANGE // max(1, n)
    pick = F.xxhash64("id", F.when(F.col("id").isNull(), F.col("digest")))
    sample = prepared.where(F.pmod(pick, F.lit(HASH_RANGE)) <= share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(0), SLICE_BYTES):
                found = split_words(batch.column(0).slice(a, b - a), cuts)[0].value_counts()
                texts = pa.array([b - a] + [0] * (len(found) - 1), pa.int64()) if len(found) else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1), texts], ["word", "n", "texts"])

    counts = map_batches(sample.select("text"), count, "word string, n long, texts long").groupBy("word")
    counts = materialize(counts.agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")))
    size = counts.agg(F.sum(F.col("n") * F.octet_length("word")).alias("bytes"), F.sum("texts").alias("texts")).first()
    top = counts.where(F.octet_length("word") <= HOT_LENGTH).orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word", "n")
    table = encode_words(spread(materialize(top)), model).toArrow().sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    words, ids = (table.column(c).cast(t).combine_chunks() for c, t in (("word", pa.large_string()), ("ids", pa.list_(pa.int32()))))
    return Frequent(words, ids), int((size["bytes"] or 0) / max(1, size["texts"] or 0) * n)


def _numbered(prepared: DataFrame, cuts: np.ndarray, shared) -> tuple[DataFrame, DataFrame]:
    """(id, h, digest, others, numbers) of every row, the numbers being packed
    and ``others`` the number of its distinct other words; and these words: (id,
    h, place, word). ``shared`` is the broadcast of the frequent words."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                found, bounds, text, _, _ = number_words(part.column("text"), cuts, shared.value.words)
                others = np.bincount(text, minlength=b - a).astype(np.int32)
                rows = pack(found, bounds).cast(pa.binary())
                same = [part.column(c) for c in ("id", "h", "digest")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(others), rows], ["id", "h", "digest", "others", "numbers"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                _, _, text, place, word = number_words(part.column("text"), cuts, shared.value.words)
                ids, hashes = (part.column(c).take(pa.array(text)) for c in ("id", "h"))
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(place.astype(np.int32)), word.cast(pa.string())], ["id", "h", "place", "word"])

    kind = prepared.schema["id"].dataType.simpleString()
    return (
        map_batches(prepared, numbers, f"id {kind}, h long, digest long, others int, numbers binary"),
        map_batches(prepared, others, f"id {kind}, h long, place int, word string"),
    )


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, place, word) in order of their words to rows (word, spots),
    one for each word of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        word = batch.column("word")
        new = pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        spots = pa.StructArray.from_arrays([batch.column(c) for c in ("id", "h", "place")], ["id", "h", "place"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(word)).astype(np.int32)), spots)
        yield pa.RecordBatch.from_arrays([word.take(pa.array(starts)), lists], ["word", "spots"])


def pieces_of(docs: DataFrame, model: PieceModel, id_col: str, text_col: str) -> tuple[DataFrame, object]:
    """Rows in order, partition by partition: a document's row (id, h, digest,
    place -1, others, numbers), or several of them that are alike, and then (id, h, place,
    ids) for each of its other words, repeated when its row is. And the
    broadcast of the frequent words, whose number and length are bounded."""
    prepared = _prepared(docs, model, id_col, text_col)
    frequent, size = frequent_words(prepared, model)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    del frequent
    give_back()
    rows, others = _numbered(prepared, model.cuts(), shared)
    dealt = others.repartition(-(-size // TEXT_PER_TASK) or 1, "word").sortWithinPartitions("word")
    kind = prepared.schema["id"].dataType.simpleString()
    gathered = map_batches(dealt, _gather, f"word string, spots array<struct<id:{kind},h:bigint,place:int>>")
    found = encode_words(gathered, model).select(F.explode("spots").alias("s"), "ids").select("s.id", "s.h", "s.place", "ids")
    both = rows.withColumn("place", F.lit(-1)).unionByName(found, allowMissingColumns=True)
    return both.repartition("id", "h").sortWithinPartitions("id", "h", "place"), shared


def _documents(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the rows of ``pieces_of``: documents' rows, with the ids of all of
    them, for each document and the end the number of ids before it, and the
    documents' numbers of words. A document is given once its words are there."""
    held = None
    for batch in _and_none(batches):
        if batch is None:
            if held is not None:
                yield from _assembled(held, frequent)
            return
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        place = table.column("place").to_numpy()
        # documents whose words may still be to come: the last ones that have any
        waits = (place < 0) & (pc.fill_null(table.column("others"), 0).to_numpy() > 0)
        runs = np.flatnonzero(waits & np.concatenate(([True], ~waits[:-1])))
        whole = int(runs[-1]) if len(runs) else table.num_rows
        if whole:
            yield from _assembled(table.slice(0, whole), frequent)
        held = table.slice(whole) if whole < table.num_rows else None


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _assembled(table: pa.RecordBatch, frequent: Frequent) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    place = table.column("place").to_numpy()
    is_word = place >= 0
    is_word[1:] &= place[1:] != place[:-1]
    docs = np.flatnonzero(place < 0)
    before = np.cumsum(is_word)[docs]
    others = table.column("ids").take(pa.array(np.flatnonzero(is_word))).cast(pa.list_(pa.int32()))
    lists = pa.concat_arrays([frequent.ids, others])
    rows = table.take(pa.array(docs))
    for a, b in _slices(rows.column("numbers"), SLICE_BYTES >> 4):
        numbers, bounds = unpack(rows.column("numbers").slice(a, b - a))
        rare = np.flatnonzero(numbers >= len(frequent.ids))
        numbers[rare] += before[a + np.searchsorted(bounds, rare, "right") - 1]
        pieces = lists.take(pa.array(numbers))
        upto = np.concatenate(([0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))))
        yield rows.slice(a, b - a), pieces.flatten().to_numpy(), upto[bounds], np.diff(bounds)


def _spelling(model: PieceModel) -> pa.Array:
    """The bytes of every piece, with plain blanks."""
    spelled = []
    for piece, _, kind in model.pieces:
        raw = bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else piece.replace(BLANK, " ").encode()
        spelled.append(raw)
    return pa.array(spelled, pa.large_binary())


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the piece ids of every text; none for null or empty texts.

    Repeated rows stay. Columns other than the two named are ignored.
    """
    rows, shared = pieces_of(docs, model, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds, _ in _documents(batches, shared.value):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encoding_report(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_words``, ``n_pieces``, ``n_bytes`` (byte pieces),
    ``ids_digest`` (of all ids in their order) and ``round_trip``: whether the
    ids of the whole document, decoded and restored, give its text (by hash).

    Null and empty texts have no pieces. A text that holds U+2581 itself does
    not come back, as the format has it. Repeated rows stay. Columns other than
    the two named are ignored.
    """
    rows, shared = pieces_of(docs, model, id_col, text_col)
    spelling, lead = _spelling(model), int(model.dummy_prefix)
    low = (model.byte_ids or [len(model.pieces)])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for part, ids, bounds, words in _documents(batches, shared.value):
            spelled = spelling.take(pa.array(ids))
            ends = np.frombuffer(spelled.buffers()[1], np.int64)[bounds].tolist() if len(ids) else [0] * len(bounds)
            text, raw = memoryview(spelled.buffers()[2] or b""), memoryview(np.ascontiguousarray(ids)).cast("B")
            in_bytes = np.concatenate(([0], np.cumsum((ids >= low) & (ids < low + 256))))[bounds]
            at = bounds.tolist()
            spans = list(zip(at[:-1], at[1:], strict=True))
            digests = np.array([digest(raw[4 * a : 4 * b], SEED) for a, b in spans], np.uint64).view(np.int64)
            back = np.array(
                [digest(text[x + lead * (a < b) : y], SEED) for (a, b), x, y in zip(spans, ends[:-1], ends[1:], strict=True)], np.uint64
            ).view(np.int64)
            columns = [words, np.diff(bounds), np.diff(in_bytes), digests, back == part.column("digest").to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *map(pa.array, columns)], ["id", "n_words", "n_pieces", "n_bytes", "ids_digest", "round_trip"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_pieces long, n_bytes long, ids_digest long, round_trip boolean"
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document with the 32k model."""
    return encoding_report(load(spark, sf_dir, "documents"), read_model())
