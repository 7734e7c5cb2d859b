"""Text scores of a log-bilinear neural language model trained with noise-contrastive estimation.

Outcomes of the network are symbols: the end of a text, the VOCABULARY most frequent words, and
CLASSES classes of all other words by their last bytes. The two words before predict a vector,
q = r(w1) C1 + r(w2) C2, and a symbol's score is q . t(w) + b(w). A word of a class has, besides, its
probability inside the class: its count, less the share kept for unseen words (one outcome of each
class), which is estimated by the words seen once. The probabilities of all outcomes after any two
words add up to 1: the normalisers of all pairs of symbols come from one matrix product.

The work is spread by blocks of tokens. Each task trains on its own blocks, starting from the same
parameters, and the results are averaged by tokens; every training token is used in each round.
Counts of words are exact over the whole corpus and are never collected: words meet by buckets of
their hash, and every block gets those of its own words back by a join.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators.scratch import store
from hearsay.operators.termcounts import slices

from .common import utf8, worker_cache

END, BETWEEN = b"\n", b" "  # no word holds white space
VOCABULARY = 1500
CLASSES = 512
SUFFIX = 3
WIDTH = 32
NOISE = 64
ROUNDS = 2
BATCH = 4096
SHORT_RUN = 8
RATE = 0.02  # of the first round; the next ones take RATE / 2, RATE / 3, ...
SQUARES = 1e-9
BLOCK_TOKENS = 1 << 20
BUCKETS = 1 << 12  # of words, by their hash
PIECE_BYTES = 1 << 22
SCORED_TOKENS = 1 << 17  # scored at a time; a piece is never parted

PARTS = ("target", "context", "bias")  # parameters kept by symbol


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % CLASSES


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes: the high ones are nearly constant, so the codecs of
    files and shuffles make little of them."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def joined(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the numbers between each two cuts."""
    # The cast is an error, not a wrong number, where 32 bits are too few.
    at = pa.array(cuts.astype(np.int64) * numbers.itemsize).cast(pa.int32())
    data = pa.py_buffer(np.ascontiguousarray(numbers))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, at.buffers()[1], data])


def numbers_of(parts: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts.to_pylist()), dtype=dtype)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a few megabytes at a time; cuts are at white space."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = max(text.rfind(c, at, at + PIECE_BYTES) for c in (b" ", b"\n", b"\t", b"\r"))
        if cut <= at:
            break
        yield text[at:cut].lower().split()
        at = cut
    yield text[at:].lower().split()


class _Block:
    """Pieces of texts with words numbered in order of appearance."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count(1).__next__, {END: 0})
        self.keys: list = []
        self.rids: list[int] = []
        self.learn: list[bool] = []
        self.sizes: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.total = 0

    def add(self, key, rid: int, learn: bool, before: list[bytes], words: list[bytes]) -> None:
        numbers = map(self.ids.__getitem__, before + words)
        self.tokens.append(np.fromiter(numbers, np.uint32, len(before) + len(words)))
        self.keys.append(key)
        self.rids.append(rid)
        self.learn.append(learn)
        self.sizes.append(len(words))
        self.total += len(words)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """The block as a row; its words are numbered anew, by bucket."""
        bucket = np.fromiter(map(zlib.crc32, self.ids), np.uint32, len(self.ids)) % BUCKETS
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        counts = np.zeros(len(order), dtype=np.int64)
        learned = [t[2:] for t, learn in zip(self.tokens, self.learn) if learn]
        if learned:
            counts += np.bincount(np.concatenate(learned), minlength=len(counts))
        held, first = np.unique(bucket[order], return_index=True)
        cuts = np.append(first, len(order))
        words = pa.ListArray.from_arrays(
            pa.array(cuts, pa.int32()), pa.array(list(self.ids), pa.binary()).take(pa.array(order))
        )
        by_bucket = pa.StructArray.from_arrays(
            [
                pa.array(held, pa.int32()),
                pc.binary_join(words, BETWEEN),
                joined(counts[order].astype("<u4"), cuts),
            ],
            fields=list(schema.field("words").type.value_type),
        )
        values = [self.keys, self.rids, self.learn, self.sizes]
        values.append(packed(place[np.concatenate(self.tokens)]))
        arrays = [pa.array([v], f.type) for v, f in zip(values, schema)]
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), by_bucket))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def token_blocks(docs: DataFrame, text: str, key: str, learn: Column) -> DataFrame:
    """Stored blocks of about BLOCK_TOKENS tokens; a long text may go on in the next block.

    A row holds, by text: key, a number of its own, whether it is learned from, how many tokens;
    then all tokens as numbers (each text led by the two words before it), and by bucket of words
    the block's words in the order of their numbers and how often each occurs in learned texts.
    """
    key_type = docs.schema[key].dataType
    bucket = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("words", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )
    schema = T.StructType(
        [
            T.StructField("keys", T.ArrayType(key_type)),
            T.StructField("rids", T.ArrayType(T.LongType())),
            T.StructField("learn", T.ArrayType(T.BooleanType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("words", T.ArrayType(bucket)),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text's number: its task and its place there. The blocks are stored, so it stays.
        rid, block = (TaskContext.get().partitionId() << 40) - 1, _Block()
        for batch in batches:
            keys, learns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, learn, value in zip(keys, learns, batch.column(2)):
                rid, before = rid + 1, [END, END]
                for words in _pieces(value.as_py()):
                    block.add(key, rid, learn, before, words)
                    before = (before + words[-2:])[-2:]
                    if block.total >= BLOCK_TOKENS:
                        yield block.batch(arrow)
                        block = _Block()
                block.add(key, rid, learn, before, [END])
        if block.keys:
            yield block.batch(arrow)

    blocks = docs.select(
        key, F.coalesce(learn, F.lit(False)).alias("_learn"), utf8(text).alias("_llm_text")
    ).mapInArrow(run, schema)
    return store(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def word_counts(blocks: DataFrame) -> DataFrame:
    """Stored counts of the blocks' words over all learned texts.

    A row with a block has, for one of its buckets, the count of each word. A row without has the
    different words of some buckets that occur in learned texts, with their counts.
    """
    groups = max(1, min(BUCKETS, 4 * blocks.count()))
    by_bucket = blocks.select("block", F.inline("words"))

    def run(group: pa.Table) -> pa.Table:
        words = group["words"].cast(pa.large_binary()).combine_chunks()
        words = pc.split_pattern(words, BETWEEN)
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        # Sums of whole numbers are exact in doubles up to 2 ** 53.
        total = np.bincount(code, numbers_of(group["counts"], "<u4"), len(coded.dictionary))
        total = total.astype("<i8")
        seen = np.flatnonzero(total)
        n = group.num_rows
        last = pa.nulls(1)
        return pa.table(
            {
                "block": pa.chunked_array([*group["block"].chunks, last.cast(pa.int64())]),
                "bucket": pa.chunked_array([*group["bucket"].chunks, last.cast(pa.int32())]),
                "counts": pa.chunked_array(
                    [joined(total[code], words.offsets.to_numpy()), last.cast(pa.binary())]
                ),
                "totals": pa.ListArray.from_arrays(
                    pa.array([0] * (n + 1) + [len(seen)], pa.int32()),
                    pa.StructArray.from_arrays(
                        [
                            coded.dictionary.take(pa.array(seen)).cast(pa.binary()),
                            pa.array(total[seen]),
                        ],
                        names=["word", "c"],
                    ),
                ),
            }
        )

    counted = by_bucket.groupBy((F.col("bucket") % groups).alias("group")).applyInArrow(
        run,
        "block bigint, bucket int, counts binary, totals array<struct<word binary, c bigint>>",
    )
    return store(counted, "totals")


def _symbols(words: pa.Array, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The symbol of each word; a class is worked out once for each ending."""
    first = len(vocabulary)
    listed = pc.index_in(words, pa.array(list(vocabulary), words.type))
    symbols = pc.fill_null(listed, -1).to_numpy(zero_copy_only=False).astype(np.int32)
    other = np.flatnonzero(symbols < 0)
    ends = pc.binary_slice(words.take(pa.array(other)), -SUFFIX).dictionary_encode()
    classes = [first + word_class(end) for end in ends.dictionary.to_pylist()]
    symbols[other] = np.array(classes, dtype=np.int32)[ends.indices.to_numpy()]
    return symbols


def _contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the counted tokens: all but the two that lead each piece."""
    starts = np.concatenate(([0], np.cumsum(sizes + 2)[:-1]))
    counted = np.ones(len(tokens), dtype=bool)
    counted[starts] = counted[starts + 1] = False
    return np.flatnonzero(counted)


def initial(symbol_counts: np.ndarray, seed: int = 42) -> dict[str, np.ndarray]:
    """Small random vectors, and the bias of a model without context."""
    rng, n = np.random.default_rng(seed), len(symbol_counts)
    share = (symbol_counts + 1) / (symbol_counts + 1).sum()
    return {
        "target": (rng.standard_normal((n, WIDTH)) * 0.1).astype(np.float32),
        "context": (rng.standard_normal((n, WIDTH)) * 0.1).astype(np.float32),
        "bias": np.log(share).astype(np.float32),
        "c1": np.eye(WIDTH, dtype=np.float32),
        "c2": np.eye(WIDTH, dtype=np.float32),
        "noise": share,
    }


class Trainer:
    """Noise-contrastive estimation on batches, with step sizes that shrink by parameter.

    The large tables of a step are written to the same memory each time: fresh memory would cost
    more than the arithmetic.
    """

    def __init__(self, parameters: dict[str, np.ndarray], seed: int, rate: float) -> None:
        self.rate = rate
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.squares = {k: np.full(v.shape, SQUARES, np.float32) for k, v in self.p.items()}
        self.rng = np.random.default_rng(seed)
        self.steps_from = np.cumsum(self.p["noise"])
        self.log_noise = np.log(NOISE * self.p["noise"]).astype(np.float32)
        self.held: dict[str, np.ndarray] = {}

    def _table(self, name: str, rows: int, columns: int) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < rows:
            self.held[name] = np.empty((rows, columns), dtype=np.float32)
        return self.held[name][:rows]

    def _taken(self, name: str, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``rows[at]`` in the memory of that name."""
        out = self._table(name, len(at), rows.shape[1])
        return np.take(rows, at, axis=0, out=out, mode="clip")

    def _like(self, name: str, table: np.ndarray) -> np.ndarray:
        shape = table.shape
        held = self.held.setdefault(f"{name} {shape}", np.empty(0, np.float32))
        if held.shape != shape:
            held = self.held[f"{name} {shape}"] = np.empty(shape, dtype=np.float32)
        return held

    def _sums(
        self, name: str, at: np.ndarray, rows: np.ndarray, places: int | None = None
    ) -> np.ndarray:
        """Sums of rows by symbol: rows in the order of their symbol are added run by run.

        Most runs are short: their second rows are added together, then their third rows, and so on.
        Where ``at`` is longer than ``rows``, its end is for the last rows once more.
        """
        n = len(self.p["bias"]) if places is None else places
        out = self._table(name, n, rows.shape[1])
        out.fill(0)
        order = np.argsort(at.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
        index = at[order]
        if len(at) > len(rows):
            order[order >= len(rows)] -= len(at) - len(rows)
        edge = np.ones(len(index) + 1, dtype=bool)
        np.not_equal(index[1:], index[:-1], out=edge[1:-1])
        edge = np.flatnonzero(edge)
        first, length = edge[:-1], edge[1:] - edge[:-1]
        long = length > SHORT_RUN
        if long.any():
            held = self._taken("sorted", rows, order[np.repeat(long, length)])
            starts = np.cumsum(length[long]) - length[long]
            out[index[first[long]]] = np.add.reduceat(held, starts, axis=0)
        if not long.all():
            first, length = first[~long], length[~long]
            first = first[np.argsort((SHORT_RUN - length).astype(np.uint8), kind="stable")]
            more = len(length) - np.cumsum(np.bincount(length, minlength=SHORT_RUN + 1))
            rest = self._taken("rest", rows, order[first[: more[1]] + 1])
            for at_least in range(2, SHORT_RUN):
                k = more[at_least]
                if k:
                    rest[:k] += self._taken("next", rows, order[first[:k] + at_least])
            total = self._taken("total", rows, order[first])
            total[: more[1]] += rest
            out[index[first]] = total
        return out

    def _move(self, name: str, gradient: np.ndarray) -> None:
        squares = self.squares[name]
        change = self._like("change", gradient)
        squares += np.multiply(gradient, gradient, out=change)
        np.multiply(gradient, self.rate, out=change)
        change /= np.sqrt(squares, out=self._like("root", gradient))
        self.p[name] -= change

    def step(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> None:
        p, n, size = self.p, len(self.p["bias"]), len(w)
        noise = np.searchsorted(self.steps_from, self.rng.random(NOISE) * self.steps_from[-1])
        noise = np.minimum(noise, n - 1)
        query = self._taken("query", p["context"] @ p["c1"], w1)
        spare = self._taken("spare", p["context"] @ p["c2"], w2)
        query += spare
        true = self._taken("true", p["target"], w)
        score = np.einsum("ij,ij->i", query, true) + p["bias"][w] - self.log_noise[w]
        false = p["target"][noise]
        # Gradients of -log sigmoid(score) - sum of log sigmoid(-against), per token; the large
        # table of scores against noise is turned into them in place.
        share = np.float32(1 / size)
        up = -share / (1 + np.exp(np.minimum(score, 30)))
        down = np.matmul(query, -false.T, out=self._table("down", size, NOISE))
        down -= (p["bias"] - self.log_noise)[noise]
        np.minimum(down, 30, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(share, down, out=down)
        # Gradients by token: of the word itself, and of the query, which the vectors of both words
        # before share. They are added up in one go; each use of a symbol has a place of its own.
        rows = self._table("rows", 2 * size, WIDTH)
        np.multiply(query, up[:, None], out=rows[:size])
        back = np.matmul(down, false, out=rows[size:])
        back += np.multiply(true, up[:, None], out=spare)
        sums = self._sums("sums", np.concatenate((w, w1 + n, w2 + 2 * n)), rows, 3 * n)
        target = sums[:n]
        bias = np.bincount(w, weights=up, minlength=n).astype(np.float32)
        np.add.at(target, noise, down.T @ query)
        np.add.at(bias, noise, np.einsum("ij->j", down))
        context = self._table("context", n, WIDTH)
        context.fill(0)
        for name, before in (("c1", sums[n : 2 * n]), ("c2", sums[2 * n :])):
            context += before @ p[name].T
            self._move(name, p["context"].T @ before)
        self._move("context", context)
        self._move("target", target)
        self._move("bias", bias)


def train_round(
    blocks: DataFrame,
    parameters: dict[str, np.ndarray],
    vocabulary: dict[bytes, int],
    seed: int,
    rate: float,
) -> dict[str, np.ndarray]:
    """One pass over every learned token; the mean of the tasks' parameters by their tokens."""
    shared = blocks.sparkSession.sparkContext.broadcast((parameters, vocabulary))
    columns = 2 * WIDTH + 1
    n = len(parameters["bias"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words_of = shared.value
        trainer, seen = Trainer(start, seed, rate), 0
        for batch in batches:
            for row in range(batch.num_rows):
                learn = np.array(batch.column(0)[row].as_py(), dtype=bool)
                sizes = np.array(batch.column(1)[row].as_py())
                tokens = unpacked(batch.column(2)[row].as_py())
                words = pc.split_pattern(batch.column(3)[row].values, BETWEEN).flatten()
                symbols = _symbols(words, words_of)[tokens]
                at = _contexts(tokens, sizes)
                at = at[np.repeat(learn, sizes)]
                for i in range(0, len(at), BATCH):
                    t = at[i : i + BATCH]
                    trainer.step(symbols[t - 2], symbols[t - 1], symbols[t])
                seen += len(at)
        if not seen:
            return
        p = trainer.p
        by_symbol = np.concatenate((p["target"], p["context"], p["bias"][:, None]), axis=1)
        by_width = np.zeros((WIDTH, columns), dtype=np.float32)
        by_width[:, :WIDTH], by_width[:, WIDTH : 2 * WIDTH] = p["c1"], p["c2"]
        rows = np.concatenate((by_symbol, by_width)).astype(np.float64) * seen
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(rows)), pa.int32()),
                pa.array(np.full(len(rows), float(seen))),
                pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), columns).cast(
                    pa.list_(pa.float64())
                ),
            ],
            names=["part", "seen", "v"],
        )

    sums = (
        blocks.select("learn", "sizes", "tokens", F.col("words.words").alias("words"))
        .mapInArrow(run, "part int, seen double, v array<double>")
        .groupBy("part")
        .agg(F.sum("seen").alias("seen"), *(F.sum(F.col("v")[i]) for i in range(columns)))
        .orderBy("part")
        .collect()
    )
    if not sums:
        return parameters
    mean = np.array([r[2:] for r in sums]) / sums[0]["seen"]
    mean = mean.astype(np.float32)
    return {
        "target": mean[:n, :WIDTH],
        "context": mean[:n, WIDTH : 2 * WIDTH],
        "bias": mean[:n, -1],
        "c1": mean[n:, :WIDTH],
        "c2": mean[n:, WIDTH : 2 * WIDTH],
        "noise": parameters["noise"],
    }


def scorer(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, second, log_z)`` such that log p(w | w2, w1) of symbols is
    first[w1, w] + second[w2, w] - log_z[w2, w1].

    The sum over w of exp(first + second) is a matrix product of the two exponentials.
    """
    context, target = p["context"].astype(np.float64), p["target"].astype(np.float64)
    first = context @ p["c1"] @ target.T + p["bias"]
    second = context @ p["c2"] @ target.T
    top1, top2 = first.max(1), second.max(1)
    z = np.exp(second - top2[:, None]) @ np.exp(first - top1[:, None]).T
    log_z = np.log(np.maximum(z, 1e-300)) + top2[:, None] + top1[None, :]
    return first.astype(np.float32), second.astype(np.float32), log_z.astype(np.float32)


def score_texts(
    docs: DataFrame,
    learn: Column,
    text: str = "text",
    key: str = "doc_id",
    vocabulary_size: int = VOCABULARY,
    rounds: int = ROUNDS,
    seed: int = 42,
) -> DataFrame:
    """One row a row of ``docs``: key, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (add-one word counts) and ``score`` (this model),
    both the log10 probability of the whole text with its end.

    Null and empty texts are their end alone. Without any training row nothing is known, and the
    model is uniform over symbols. Rows with repeated or null keys stay rows of their own.
    """
    blocks = token_blocks(docs, text, key, learn)
    spark = docs.sparkSession
    counted = word_counts(blocks)
    totals = counted.where("block is null").select(F.inline("totals"))
    top = [
        (bytes(r["word"]), r["c"])
        for r in totals.where(F.col("word") != F.lit(END))
        .orderBy(F.desc("c"), "word")
        .limit(vocabulary_size)
        .collect()
    ]
    vocabulary = {END: 0} | {w: i + 1 for i, (w, _) in enumerate(top)}
    # Rows by class of the words outside the vocabulary: at most CLASSES.
    listed = F.broadcast(
        spark.createDataFrame([(bytearray(w),) for w in vocabulary], "word binary")
    )
    in_class = F.crc32(F.substring("word", -SUFFIX, SUFFIX)) % CLASSES
    rest = totals.join(listed, "word", "left_anti")
    once = F.sum((F.col("c") == 1).cast("bigint"))
    by_class = rest.groupBy(in_class.alias("k")).agg(
        F.sum("c").alias("n"), once.alias("once"), F.count("*").alias("v")
    ).collect()
    ends = totals.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    class_n, class_once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_n[r["k"]], class_once[r["k"]] = r["n"], r["once"]
    total = int(ends + sum(c for _, c in top) + sum(r["n"] for r in by_class))
    distinct = int(bool(ends) + len(top) + sum(r["v"] for r in by_class))
    counts = np.concatenate(([ends], [c for _, c in top], class_n)).astype(np.float64)
    parameters = initial(counts, seed)
    for i in range(rounds):
        parameters = train_round(blocks, parameters, vocabulary, seed + i, RATE / (1 + i))
    known = (
        counted.where("block is not null")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "counts")).alias("known"))
    )
    unseen = np.where(class_n > 0, (class_once + 0.5) / (class_n + 1), 1.0)
    shared = spark.sparkContext.broadcast((scorer(parameters), vocabulary, class_n, unseen))
    version = uuid.uuid4().hex
    schema = T.StructType(
        [
            T.StructField("rid", T.LongType()),
            docs.schema[key],
            T.StructField("learn", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, second, log_z), words_of, in_classes, left = worker_cache(
            "language model", lambda: shared.value, version
        )
        n_words = len(words_of)
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                words = pc.split_pattern(column["words"][row].values, BETWEEN).flatten()
                sizes = np.array(column["sizes"][row].as_py())
                tokens = unpacked(column["tokens"][row].as_py())
                symbol = _symbols(words, words_of)
                held = column["known"][row].values
                by_bucket = held.take(pc.sort_indices(pc.struct_field(held, "bucket")))
                count = numbers_of(pc.struct_field(by_bucket, "counts"), "<i8")
                base = np.log10((count + 1) / (total + distinct + 1))
                inside = np.zeros(len(words))
                other = np.flatnonzero(symbol >= n_words)
                k = symbol[other] - n_words
                seen = count[other] > 0
                with np.errstate(divide="ignore"):
                    share = np.where(
                        seen,
                        (1 - left[k]) * count[other] / np.maximum(in_classes[k], 1),
                        left[k],
                    )
                inside[other] = np.log(share)
                # A piece's two leading tokens are in its part of the tokens.
                cuts = np.concatenate(([0], np.cumsum(sizes + 2)))
                sums = np.zeros((3, len(sizes)))
                for start, stop in slices(sizes, SCORED_TOKENS):
                    part, held = tokens[cuts[start] : cuts[stop]], sizes[start:stop]
                    at = _contexts(part, held)
                    symbols = symbol[part]
                    w2, w1, w = symbols[at - 2], symbols[at - 1], symbols[at]
                    own = part[at]
                    score = first[w1, w] + second[w2, w] - log_z[w2, w1] + inside[own]
                    # Pieces may be empty; sums by piece from running totals would lose digits.
                    piece = np.repeat(np.arange(len(held)), held)
                    for i, v in enumerate(((count > 0)[own], base[own], score)):
                        sums[i, start:stop] = np.bincount(piece, weights=v, minlength=len(held))
                yield pa.RecordBatch.from_arrays(
                    [
                        column["rids"][row].values,
                        column["keys"][row].values,
                        column["learn"][row].values,
                        pa.array(sizes.astype(np.int64)),
                        pa.array(sums[0].astype(np.int64)),
                        pa.array(sums[1]),
                        pa.array(sums[2] / np.log(10)),
                    ],
                    names=schema.names,
                )

    pieces = (
        blocks.join(known, "block")
        .select(
            "rids", "keys", "learn", "sizes", "tokens", F.col("words.words").alias("words"), "known"
        )
        .mapInArrow(run, schema)
    )
    return (
        pieces.groupBy("rid")
        .agg(
            F.first(key).alias(key),
            (~F.first("learn")).alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.lit(total).cast("bigint").alias("train_tokens"),
            F.sum("base_score").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("rid")
    )
