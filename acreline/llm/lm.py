"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token is one of a fixed number of outputs: the most frequent words have one each, every other
word falls by its ending into a tail bucket. Outputs are grouped into classes;

    P(word | context) = P(class | context) P(output | class, context) P(word | output),

where the first two are softmaxes over weights summed from hashed context features (n-grams
of the previous words and skips over them), and the last is 1 for a frequent word and the
smoothed unigram share within its bucket otherwise, so the whole sums to 1. The weights start
at the unigram model and are trained by distributed gradient updates: in each round every task
takes a share of the training documents, starts from the broadcast weights, makes its updates
in batches, and the changes are averaged by tokens, slice by slice. The weights' size is
fixed; word counts, which grow with the corpus, stay in Spark and are joined by word, except
for a bounded number of the most frequent words that every task knows. Texts are split and their
words looked up once; training and scoring read the words' numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import stored
from acreline.llm.encoding import PORTION_BYTES, portions

CLASSES = 16
OUTPUTS = CLASSES * CLASSES
TAILS = 96
START = 0  # stands before a text; words follow from 1 on
#: Weight rows that hashed contexts share, a power of two, after those of the constant feature.
CLASS_HASHES, WORD_HASHES = 1 << 14, 1 << 17
CLASS_ROWS, WORD_ROWS = CLASS_HASHES + 1, WORD_HASHES + CLASSES
FEATURES = 5
SLICES = 64
KNOWN_WORDS = 500_000
BATCH_TOKENS = 4096
SCORED_TOKENS = 1 << 13
LOOKED_UP = 1 << 15  # words of several texts at once
TRAIN_BYTES = 64 << 20
RATE = 0.3
END = b""  # no word is empty, so the empty string stands for the end


def held_out(id_col: str) -> Column:
    """Rows that are not learnt from: crc32 of the id as text leaves 0 by 10, or a NULL id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def bucket_of(word: bytes) -> int:
    """The tail bucket of a word, by its last three bytes."""
    return zlib.crc32(word[-3:]) % TAILS


@dataclass
class Vocabulary:
    """What every task knows of the counts; bounded by KNOWN_WORDS."""

    words: list[bytes]
    counts: np.ndarray      # of `words`
    output: np.ndarray      # of `words`
    out_count: np.ndarray   # tokens of each output
    out_types: np.ndarray   # different words of each output
    tokens: int
    types: int

    def __post_init__(self):
        smooth = np.log10(self.counts + 0.1)
        self.base = smooth - log10(self.tokens + 0.1 * (self.types + 1))
        self.tail_total = np.log10(self.out_count[-TAILS:] + 0.1 * (self.out_types[-TAILS:] + 1))
        tail = self.output >= OUTPUTS - TAILS
        inside = np.zeros(len(self.words))
        inside[tail] = smooth[tail] - self.tail_total[self.output[tail] - (OUTPUTS - TAILS)]
        self.inside = inside


_INDEX: dict[int, dict[bytes, int]] = {}


def _index(vocabulary: Vocabulary, key: int) -> dict[bytes, int]:
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = dict(zip(vocabulary.words, range(len(vocabulary.words))))
    return _INDEX[key]


def start_weights(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the unigram model over outputs: all in the rows of the constant feature."""
    p = (v.out_count + 0.1) / (v.out_count + 0.1).sum()
    by_class = p.reshape(CLASSES, CLASSES)
    cls, word = np.zeros((CLASS_ROWS, CLASSES), "f4"), np.zeros((WORD_ROWS, CLASSES), "f4")
    cls[0] = np.log(by_class.sum(axis=1))
    word[:CLASSES] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return cls, word


def features(words: np.ndarray) -> np.ndarray:
    """Hashed contexts (FEATURES x n) of each token of a padded run: constant, three skips, a bigram."""
    a, b, c = (np.concatenate([np.full(k, START), words[:-k]]).astype(np.uint64) for k in (1, 2, 3))
    mixed = [np.zeros(len(words), np.uint64)]
    for kind, value in ((1, a), (2, b), (3, c), (4, a * np.uint64(0xD6E8FEB86659FD93) + b)):
        h = (value + (np.uint64(kind) << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed.append((h >> np.uint64(20)) | np.uint64(1))
    return np.stack(mixed)


def _rows(mixed: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the class softmax and of the softmax within each token's class."""
    in_class = ((mixed >> np.uint64(3)) & np.uint64(CLASS_HASHES - 1)).astype(np.int32) + np.int32(1)
    hashed = (mixed + cls.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    in_word = (hashed >> np.uint64(64 - 17)).astype(np.int32) + np.int32(CLASSES)
    in_class[0], in_word[0] = 0, cls
    return in_class, in_word


_ONES = np.ones((CLASSES, 1), "f4")
_SAFE = 60  # sums of exponentials up to here and their inverses are single-precision numbers
_ROW = np.dtype((np.void, 4 * CLASSES))  # a weight row as one item


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z, more = np.empty((2, rows.shape[1], CLASSES), "f4")
    # The rows lie within the weights; to clip them spares a copy of what is taken.
    weights.take(rows[0], axis=0, out=z, mode="clip")
    for r in rows[1:]:
        z += weights.take(r, axis=0, out=more, mode="clip")
    if z.size and max(z.max(), -z.min()) > _SAFE:
        # The maximum of each row by halves: a reduction along so short an axis costs far more.
        top = z
        while top.shape[1] > 1:
            half = top.shape[1] // 2
            top = np.maximum(top[:, :half], top[:, half:])
        z -= top
    np.exp(z, out=z)
    z /= z @ _ONES
    return z


def log_probabilities(weights, outs: np.ndarray, words: np.ndarray, real: np.ndarray) -> np.ndarray:
    """log10 P(output | context) of tokens: `outs` at positions `real` of a padded run of words."""
    mixed = features(words).take(real, axis=1)
    cls, word = np.divmod(outs, CLASSES)
    at = np.arange(len(cls))
    in_class, in_word = _rows(mixed, cls)
    p = _softmax(weights[0], in_class)[at, cls] * _softmax(weights[1], in_word)[at, word]
    return np.log10(np.maximum(p, 1e-30))


class Trainer:
    """Batched gradient steps, the step of each weight row shrinking with its past gradients."""

    def __init__(self, weights):
        self.weights = [w.copy() for w in weights]
        self.past = [np.full(len(w), 1.0, "f4") for w in weights]

    def step(self, outs: np.ndarray, words: np.ndarray, real: np.ndarray) -> None:
        mixed = features(words).take(real, axis=1)
        cls, word = np.divmod(outs, CLASSES)
        at = np.arange(len(cls))
        # A weight row and its token in one number, so that one sort brings the tokens of every row together.
        low = len(cls).bit_length()
        for k, (rows, target) in enumerate(zip(_rows(mixed, cls), (cls, word))):
            g = _softmax(self.weights[k], rows)
            np.negative(g, out=g)
            g[at, target] += 1
            # The constant feature has few rows: a product with their indicators sums it up. A row without
            # tokens has a sum of zero and stays.
            fixed = np.arange(rows[0].max(initial=0) + 1)
            marks = (rows[0] == fixed[:, None]).astype("f4")
            packed = np.sort(((rows[1:].astype(np.int64) << low) | at).ravel())
            row, token = packed >> low, packed & ((1 << low) - 1)
            new = np.diff(row, prepend=-1, append=-1) != 0
            first, alone = new[:-1], new[:-1] & new[1:]
            # Most rows have one token, whose gradient is their sum; only the others are added up.
            shared = ~alone
            start = np.flatnonzero(first[shared])
            row = np.concatenate([fixed, row[alone], row[shared][start]])
            sums = [marks @ g, g.take(token[alone], axis=0)]
            if len(start):
                # Pairs of columns are summed as complex numbers, whose loop takes a fraction of the time.
                pairs = np.add.reduceat(g.take(token[shared], axis=0).view("c8"), start, axis=0)
                sums.append(pairs.view("f4"))
            total = np.concatenate(sums)
            past = self.past[k].take(row)
            past += np.einsum("ij,ij->i", total, total)
            self.past[k][row] = past
            total *= (RATE / np.sqrt(past))[:, None]
            total += self.weights[k].take(row, axis=0)
            # Whole rows are put back as one item each, not number by number.
            self.weights[k].view(_ROW).ravel()[row] = total.view(_ROW).ravel()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, bucket, n) over the texts (one string column); one end for each text."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush():
            words = list(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for part in portions(text.as_py() or b""):
                    counts.update(part.lower().split())
                    if len(counts) > 400_000:
                        yield flush()
                counts[END] += 1
        yield flush()

    partial = texts.mapInArrow(counted, "word binary, n long")
    bucket = (F.crc32(F.expr("if(length(word) > 3, substring(word, length(word) - 2, 3), word)")) % TAILS).cast("int")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).select("word", bucket.alias("bucket"), "n")


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, and totals over all words, from stored counts."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, types = totals[0] or 0, totals[1]
    # So many different counts are few: they lie on the table of counts of counts.
    floor, room = None, KNOWN_WORDS
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(KNOWN_WORDS).toLocalIterator():
        if r["k"] > room:
            break
        floor, room = r["n"], room - r["k"]
    known = counts.filter(F.col("n") >= floor if floor is not None else F.lit(False)).toArrow()
    words, n = known.column("word").to_pylist(), known.column("n").to_numpy()
    bucket = known.column("bucket").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n, bucket = [bytes(words[i]) for i in order], n[order], bucket[order]
    output = OUTPUTS - TAILS + bucket.astype(np.int64)
    frequent = min(OUTPUTS - TAILS, len(words))
    output[:frequent] = np.arange(frequent)
    out_count, out_types = np.zeros(OUTPUTS, np.int64), np.zeros(OUTPUTS, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        out_count[OUTPUTS - TAILS + r["bucket"]], out_types[OUTPUTS - TAILS + r["bucket"]] = r["n"], r["k"]
    for i in range(frequent):
        out_count[i], out_types[i] = n[i], 1
        out_count[OUTPUTS - TAILS + bucket[i]] -= n[i]
        out_types[OUTPUTS - TAILS + bucket[i]] -= 1
    return Vocabulary(words, n, output, out_count, out_types, tokens, types)


def _pieces(text: bytes | None) -> Iterator[tuple[list[bytes], bool]]:
    """Words of a text by portions; the last one has the end, and says so."""
    own = None
    for part in portions(text or b"", PORTION_BYTES // 4):
        if own is not None:
            yield own, False
        own = part.lower().split()
    own.append(END)
    yield own, True


def look_up(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Texts as numbers: a row for each portion of a text, in order, and one for each token that is not known.

    A portion has its `tokens` and how many are `known`, `base`, `codes` and `marks`, and whether it is the `last`.
    `codes` are 32-bit indexes of known words, -1 - bucket for others, whose crc32 are `marks`. The other rows
    have only `word`. `h` tells the texts of one id apart. What is known adds to `base` as a whole; of other tokens the
    part that their count adds is left out.
    """
    shared_v = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = zlib.crc32(repr((vocabulary.tokens, vocabulary.types, vocabulary.words[:50])).encode())
    id_type = docs.schema[id_col].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared_v.value
        index = _index(v, key)
        unseen = -log10(v.tokens + 0.1 * (v.types + 1))

        def numbered(batch: pa.RecordBatch, words: list[bytes], pieces: list[tuple[int, int, bool]]) -> pa.RecordBatch:
            number, length, last = map(np.array, zip(*pieces))
            codes = np.fromiter(map(index.get, words, repeat(-1)), "<i4", len(words))
            rare = np.flatnonzero(codes < 0)
            plain = v.base[codes] if len(v.words) else np.zeros(len(words))
            rare_words = [words[i] for i in rare.tolist()]
            marks = np.fromiter(map(zlib.crc32, rare_words), "<u4", len(rare))
            endings = np.fromiter(map(zlib.crc32, [w[-3:] for w in rare_words]), "<u4", len(rare))  # as bucket_of
            codes[rare] = -1 - (endings % TAILS).astype("<i4")
            plain[rare] = unseen
            n, m, piece = len(pieces), len(rare), np.repeat(np.arange(len(pieces)), length)
            unknown = np.bincount(piece[rare], minlength=n)
            base = np.bincount(piece, weights=plain, minlength=n)
            where = pa.array(np.concatenate([number, number[piece[rare]]]))
            lists = (pa.array(length), pa.array(length - unknown), pa.array(base), _binary(codes, length),
                     _binary(marks, unknown), pa.array(last))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where),
                 pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(rare_words, pa.binary())]),
                 *(pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in lists)],
                names=["id", "h", "word", "tokens", "known", "base", "codes", "marks", "last"])

        for batch in batches:
            words, pieces = [], []
            for number, text in enumerate(batch.column(2).cast(pa.binary())):
                for own, last in _pieces(text.as_py()):
                    words += own
                    pieces.append((number, len(own), last))
                    if len(words) >= LOOKED_UP:
                        yield numbered(batch, words, pieces)
                        words, pieces = [], []
            if pieces:
                yield numbered(batch, words, pieces)

    text = F.col(text_col).cast("string")
    return (docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
            .mapInArrow(found, f"id {id_type}, h long, word binary, tokens long, known long, base double, "
                               "codes binary, marks binary, last boolean"))


def _binary(numbers: np.ndarray, length: np.ndarray) -> pa.Array:
    """32-bit numbers as one binary value for each length."""
    offsets = np.concatenate([[0], np.cumsum(length * 4)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(numbers)])


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column made by `_binary`, and how many there are up to each value."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, "u1")[at[0]:at[-1]].view(kind) if data else np.zeros(0, kind)
    return flat, (at[1:] - at[0]) // 4


def _runs(batch: pa.RecordBatch, output: np.ndarray, most: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of several portions (codes, marks, last) at once: place, codes, outputs, contexts, whether an end.

    A run stops at the first portion or end at which it has `most` tokens or more.
    """
    codes, until = _numbers(batch.column(0), "<i4")
    marks, _ = _numbers(batch.column(1), "<u4")
    last = until[batch.column(2).to_numpy(zero_copy_only=False).astype(bool)] - 1
    ends = np.zeros(len(codes), bool)
    ends[last] = True
    rare, stops, lo = np.flatnonzero(codes < 0), np.unique(np.concatenate([until, last])), 0
    while lo < len(codes):
        stop = np.searchsorted(stops, lo + most)
        hi = int(stops[stop]) if stop < len(stops) else len(codes)
        place, own = slice(lo, hi), codes[lo:hi].astype(np.int64)
        outs = output.take(own, mode="clip") if len(output) else np.zeros(len(own), np.int64)
        context = own + 1
        some = slice(*np.searchsorted(rare, (lo, hi)))
        unknown = rare[some] - lo
        if len(unknown):
            outs[unknown] = OUTPUTS - TAILS - 1 - own[unknown]
            # Words beyond the known ones are contexts by their own hash.
            context[unknown] = (1 << 32) + marks[some].astype(np.int64)
        yield place, own, outs, context, ends[place]
        lo = hi


def _padded(words: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with three starts after each end, after the three words `before`."""
    shift = np.concatenate([[0], np.cumsum(ends)[:-1]]) * 3 + 3
    real = np.arange(len(words)) + shift
    run = np.full(len(words) + 3 * int(ends.sum()) + 3, START, np.int64)
    run[:3] = before
    run[real] = words
    return run, real


def train(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, rounds: int = 2):
    """Weights after `rounds` rounds; each round takes its own share of the training documents."""
    return train_numbers(stored(look_up(docs.filter(~held_out(id_col)), vocabulary, id_col, text_col)), vocabulary, rounds)


def train_numbers(numbers: DataFrame, vocabulary: Vocabulary, rounds: int = 2):
    """`train` on texts that were looked up."""
    spark = numbers.sparkSession
    weights = start_weights(vocabulary)
    if not vocabulary.tokens:
        return weights
    shared_o = spark.sparkContext.broadcast(vocabulary.output)
    texts = numbers.filter(F.col("word").isNull() & ~held_out("id")).select(
        "codes", "marks", "last", F.pmod(F.xxhash64("id"), F.lit(rounds)).alias("_round"))
    # About 7 bytes a token: one task for so many bytes, for the change a task sends is as large as the model.
    tasks = max(spark.sparkContext.defaultParallelism, 7 * vocabulary.tokens // TRAIN_BYTES)

    for n in range(rounds):
        shared_w = spark.sparkContext.broadcast(weights)

        def updates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            output, start = shared_o.value, shared_w.value
            trainer, tokens = Trainer(start), 0
            before = np.full(3, START)
            for batch in batches:
                for _, _, outs, context, ends in _runs(batch, output, BATCH_TOKENS):
                    for lo in range(0, len(outs), BATCH_TOKENS):
                        part = slice(lo, lo + BATCH_TOKENS)
                        run, real = _padded(context[part], ends[part], before)
                        trainer.step(outs[part], run, real)
                        before = run[-3:]
                    tokens += len(outs)
            if tokens:
                flat = np.concatenate([(a - b).ravel() for a, b in zip(trainer.weights, start)])
                for k, piece in enumerate(np.array_split(flat * np.float32(tokens), SLICES)):
                    yield _slice_row(k, tokens, piece)

        change = (texts.filter(F.col("_round") == n).select("codes", "marks", "last").coalesce(tasks)
                  .mapInArrow(updates, "k int, tokens long, change binary"))
        # Sums of a few tasks first, then of those, so no task meets all of a large cluster's changes.
        some = change.groupBy("k", F.pmod(F.xxhash64("change"), F.lit(16)).alias("g")).applyInArrow(
            _summed, "k int, tokens long, change binary")
        sums = some.groupBy("k").applyInArrow(_summed, "k int, tokens long, change binary")
        got = sorted(stored(sums).collect(), key=lambda r: r["k"])
        if not got:
            continue
        flat = np.concatenate([np.frombuffer(r["change"], "f4") for r in got]) / np.float32(got[0]["tokens"])
        size = weights[0].size
        weights = (weights[0] + flat[:size].reshape(weights[0].shape),
                   weights[1] + flat[size:].reshape(weights[1].shape))
    return weights


def _slice_row(k: int, tokens: int, change: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k], pa.int32()), pa.array([tokens], pa.int64()), pa.array([change.astype("f4").tobytes()], pa.binary())],
        names=["k", "tokens", "change"])


def _summed(table: pa.Table) -> pa.Table:
    total = None
    for c in table.column("change"):
        x = np.frombuffer(c.as_py(), "f4")
        total = x.copy() if total is None else total + x
    tokens = sum(table.column("tokens").to_pylist())
    return pa.Table.from_batches([_slice_row(table.column("k")[0].as_py(), tokens, total)])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Words are lower-cased in A-Z; one end closes every text, so a NULL, empty or blank text is
    one token. The model learns from all documents that are not held out. `base_score` is the
    smoothed unigram log10 probability, `score` the model's; a word that was never seen counts
    as the one unseen word of its bucket. Without training documents both follow from counts
    of zero. NULL ids are held out; repeated rows stay. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    counts = stored(count_words(rows.filter(~held_out(id_col)).select(text_col)))
    vocabulary = learn_vocabulary(counts)
    numbers = stored(look_up(rows, vocabulary, id_col, text_col))
    weights = train_numbers(numbers, vocabulary, rounds)
    shared = spark.sparkContext.broadcast((vocabulary.output, vocabulary.inside, vocabulary.tail_total, weights))
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        output, inside, tail_total, weights = shared.value
        for batch in batches:
            n = len(batch)
            piece = np.repeat(np.arange(n), batch.column(3).to_numpy())
            model, before = np.zeros(n), np.full(3, START)
            for place, codes, outs, context, ends in _runs(batch, output, SCORED_TOKENS):
                logs = np.empty(len(codes))
                for lo in range(0, len(codes), SCORED_TOKENS):
                    part = slice(lo, lo + SCORED_TOKENS)
                    run, real = _padded(context[part], ends[part], before)
                    logs[part] = log_probabilities(weights, outs[part], run, real)
                    before = run[-3:]
                unknown = codes < 0
                if len(inside):
                    logs += np.where(unknown, 0.0, inside.take(codes, mode="clip"))
                if unknown.any():  # without the count's own part, which is joined
                    logs[unknown] -= tail_total[-1 - codes[unknown]]
                model += np.bincount(piece[place], weights=logs, minlength=n)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(model)], names=[*batch.schema.names[2:], "model"])

    parts = (numbers.filter("word IS NULL").select("codes", "marks", "last", "tokens", "id", "h", "known", "base")
             .mapInArrow(scored, f"last boolean, tokens long, id {id_type}, h long, known long, base double, model double"))
    parts = stored(parts)
    # Rare words: count once per document and word, join the corpus count, add up per document.
    rare = numbers.filter("word IS NOT NULL").groupBy("word", "id", "h").agg(F.count("*").alias("k"))
    found = rare.join(counts.select(F.col("word").alias("_w"), "n"), F.col("word") == F.col("_w"), "left")
    times = F.col("k").cast("double")
    extra = found.select("id", "h", F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).alias("known"),
                         (times * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("own"))
    lists = parts.unionByName(extra, allowMissingColumns=True)
    # Rows equal in id and text meet here and are counted; each gets its share and comes out again.
    n = F.count_if("last")
    sums = lists.groupBy("id", "h").agg(
        n.alias("m"), (F.sum("tokens") / n).cast("long").alias("n_tokens"), (F.sum("known") / n).cast("long").alias("n_known"),
        ((F.sum("base") + F.coalesce(F.sum("own"), F.lit(0.0))) / n).alias("base_score"),
        ((F.sum("model") + F.coalesce(F.sum("own"), F.lit(0.0))) / n).alias("score"))
    each = sums.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return each.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens", "n_known",
                       F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
