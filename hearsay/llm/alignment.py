"""Alignment of two tokenizers over a corpus, with an inverted index of token pairs.

Both tokenizers cut the same bytes. Every stretch between two neighbouring cuts of either belongs
to one token of each, so it is one link, and a place where both cut ends a group.

Documents are numbered inside blocks; a block is what one task indexes before it writes. A posting
holds the documents of a block in which a pair is linked: a bitmap, or the positions as 16-bit
numbers where these are shorter, then planes with the bits of (links - 1) of each such document.
Blocks are the high part of a document's number, so the bitmaps of a pair never overlap: the
popcount of their union is the sum of their popcounts. Counts by pair travel back to the postings,
and the postings of a block add them up by document.

A pair has at most one posting a block, so no pair, however frequent, is more than a share of
1 / (pairs of a block) of the rows of a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hearsay.operators.scratch import store

from .common import worker_cache

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How the byte-level tokenizer splits text before its merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are aligned at a time, and (document, pair) entries of a block.
CHUNK_BYTES = 1 << 20
BLOCK_ENTRIES = 1 << 20
BLOCK_DOCS = 1 << 16
ROWS = 1 << 12
UNPACKED_BITS = 1 << 24
SPACE = "▁"


def default_paths() -> tuple[str, str]:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(BYTE_FILE), public_tokenizers.path(PIECE_FILE)


class ByteTokenizer:
    """A byte-level BPE vocabulary file; texts are cut without special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        # Printable bytes stand for themselves; the others, in order, are written from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in entry): i for entry, i in vocab.items()}
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.size = max([*ranks.values(), *added]) + 1
        self.bytes = [b""] * self.size
        for entry, i in [*ranks.items(), *((x, i) for i, x in added.items())]:
            self.bytes[i] = entry
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        split = spec.get("pre_tokenizer") or {}
        if (
            all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges))
            and spec.get("normalizer") is None
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True))
            == ("ByteLevel", False, True)
        ):
            # Ids in the order of merges: the rank form of the same vocabulary gives the same ids.
            import tiktoken

            encoder = tiktoken.Encoding(
                "byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}
            )
            self.encode = encoder.encode_ordinary
        else:
            import tokenizers

            tokenizer = tokenizers.Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """A sentence-piece model; it puts a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            as_byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes.append(
                bytes([int(as_byte[1], 16)]) if as_byte else piece.replace(SPACE, " ").encode()
            )
        self.encode_batch = lambda texts: model.encode(texts, num_threads=1) if texts else []


class Aligner:
    """Both tokenizers, and the tables that alignment looks up."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        self.length_a = np.array([len(x) for x in self.a.bytes])
        self.length_b = np.array([len(x) for x in self.b.bytes])
        # Ids as text with what follows them: inside a side, after A's side, after B's side.
        self.size = max(self.a.size, self.b.size)
        self.names = [f"{i}{end}" for end in ",|;" for i in range(self.size)]

    def tokens(self, texts: Sequence[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none where a text is null or empty or either does not give its bytes."""
        texts = [x or "" for x in texts]
        some = [i for i, x in enumerate(texts) if x]
        ids_a: list[list[int]] = [[] for _ in texts]
        ids_b: list[list[int]] = [[] for _ in texts]
        bytes_a, bytes_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        for i, b in zip(some, self.b.encode_batch([texts[i] for i in some])):
            whole = " " + texts[i]
            a = self.a.encode(whole)
            raw = whole.encode()
            if raw == b"".join(map(bytes_b, b)) and raw == b"".join(map(bytes_a, a)):
                ids_a[i], ids_b[i] = a, b
        return ids_a, ids_b

    def align(self, texts: Sequence[str | None]) -> dict:
        """Columns of the documents, and of each link its document, A id and B id."""
        ids_a, ids_b = self.tokens(texts)
        n_a = np.array([len(x) for x in ids_a], dtype=np.int64)
        n_b = np.array([len(x) for x in ids_b], dtype=np.int64)
        a = np.array([i for x in ids_a for i in x], dtype=np.int64)
        b = np.array([i for x in ids_b for i in x], dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        mark = np.zeros(ends_a[-1] + 1 if len(a) else 1, dtype=np.uint8)
        mark[ends_a] = 1
        mark[ends_b] += 2
        cut = mark[np.flatnonzero(mark)]
        ends = cut == 3
        of_a, of_b = cut & 1 == 1, cut > 1
        link_a, link_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        doc = np.repeat(np.arange(len(texts)), n_a)[link_a]
        # Order of the digest: group by group, the tokens of A before those of B.
        group = np.cumsum(ends) - ends
        group_a, group_b = group[of_a], group[of_b]
        count_a, count_b = np.bincount(group_a), np.bincount(group_b)
        merged = np.empty(len(a) + len(b), dtype=np.int64)
        merged[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]] = a + (
            self.size * ends[of_a]
        )
        merged[np.arange(len(b)) + np.cumsum(count_a)[group_b]] = b + 2 * self.size * ends[of_b]
        name, digests, start = self.names.__getitem__, [], 0
        for n in (n_a + n_b).tolist():
            if n:
                spelt = "".join(map(name, merged[start : start + n].tolist()))[:-1]
                digests.append(hashlib.sha256(spelt.encode()).hexdigest())
            else:
                digests.append("")
            start += n
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(doc[ends], minlength=len(texts)),
            "n_links": np.bincount(doc, minlength=len(texts)),
            "groups_sha256": digests,
            "doc": doc,
            "a": a[link_a],
            "b": b[link_b],
        }


def _head(n: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Whether a posting of ``n`` documents has a bitmap, its bytes, and those of a bitmap."""
    whole = n_docs + 7 >> 3
    dense = 2 * n >= whole
    return dense, np.where(dense, whole, 2 * n), whole


def pack(
    starts: np.ndarray, pos: np.ndarray, links: np.ndarray, n_docs: int
) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of postings; ``starts`` are their first entries and the end, ``pos``
    (ascending in a posting) and ``links`` (1 at least) the documents' numbers and link counts."""
    n = np.diff(starts)
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(pos)) - starts[row]
    dense, head, _ = _head(n, n_docs)
    more = links - 1
    most = np.maximum.reduceat(more, starts[:-1]) if len(n) else more
    planes, width = np.frexp(most.astype(float))[1], n + 7 >> 3
    offsets = np.concatenate(([0], np.cumsum(head + planes * width)))
    data = np.zeros(offsets[-1], dtype=np.uint8)
    bit = lambda x: (1 << (x & 7)).astype(np.uint8)
    at = dense[row]
    np.add.at(data, offsets[row[at]] + (pos[at] >> 3), bit(pos[at]))
    low = offsets[row[~at]] + 2 * rank[~at]
    data[low], data[low + 1] = pos[~at] & 255, pos[~at] >> 8
    for k in range(int(planes.max(initial=0))):
        at = more >> k & 1 == 1
        first = offsets[row[at]] + head[row[at]] + k * width[row[at]]
        np.add.at(data, first + (rank[at] >> 3), bit(rank[at]))
    return offsets, data


def unpack(
    n: np.ndarray, offsets: np.ndarray, data: np.ndarray, n_docs: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posting, document and link count of every entry; the reverse of ``pack``."""
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    dense, head, whole = _head(n, n_docs)
    pos = np.empty(len(row), dtype=np.int64)
    at = dense[row]
    low = offsets[row[~at]] + 2 * rank[~at]
    pos[~at] = data[low] + (data[low + 1].astype(np.int64) << 8)
    bitmaps, found = np.flatnonzero(dense), [np.empty(0, np.int64)]
    step = max(1, UNPACKED_BITS // max(1, 8 * whole))
    for i in range(0, len(bitmaps), step):
        held = data[offsets[bitmaps[i : i + step], None] + np.arange(whole)]
        found.append(np.nonzero(np.unpackbits(held, axis=1, bitorder="little"))[1])
    pos[at] = np.concatenate(found)
    links = np.ones(len(row), dtype=np.int64)
    width = n + 7 >> 3
    planes = (np.diff(offsets) - head) // np.maximum(width, 1)
    for k in range(int(planes.max(initial=0))):
        at = np.flatnonzero(planes[row] > k)
        first = offsets[row[at]] + head[row[at]] + k * width[row[at]]
        set_ = data[first + (rank[at] >> 3)] >> (rank[at] & 7) & 1
        links[at] += set_.astype(np.int64) << k
    return row, pos, links


KEY = "_llm_key"
OF_DOCS = ["n_a", "n_b", "n_groups", "n_links"]
DOCUMENT = [KEY, *OF_DOCS, "groups_sha256"]


def _index_schema(key: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType(
        [
            T.StructField("block", long),
            T.StructField("n_docs", T.IntegerType()),
            # Rows of documents.
            T.StructField("pos", T.IntegerType()),
            T.StructField(KEY, key),
            *(T.StructField(c, long) for c in OF_DOCS),
            T.StructField("groups_sha256", T.StringType()),
            # Rows of postings.
            T.StructField("a", T.IntegerType()),
            T.StructField("b", T.IntegerType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("links", long),
            T.StructField("bits", T.BinaryType()),
        ]
    )


class _Block:
    """What a task holds of a block until it is written."""

    def __init__(self):
        self.keys: list = []
        self.columns: dict[str, list] = {c: [] for c in [*OF_DOCS, "groups_sha256"]}
        self.entries: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.n_docs = self.n_entries = 0

    def add(self, keys: pa.Array, found: dict) -> None:
        pair = found["a"] << 32 | found["b"] << 16 | (found["doc"] + self.n_docs)
        entries, links = np.unique(pair, return_counts=True)
        self.keys.append(keys)
        for c, parts in self.columns.items():
            parts.append(found[c])
        self.entries.append(entries)
        self.links.append(links)
        self.n_docs += len(keys)
        self.n_entries += len(entries)

    def batches(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def rows(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            columns |= {"block": np.full(n, number), "n_docs": np.full(n, self.n_docs, np.int32)}
            filled = [
                pa.array(columns[f.name], f.type)
                if isinstance(columns.get(f.name), (np.ndarray, list))
                else columns.get(f.name, pa.nulls(n, f.type))
                for f in schema
            ]
            return pa.RecordBatch.from_arrays(filled, schema=schema)

        digests = [x for part in self.columns["groups_sha256"] for x in part]
        columns = {c: np.concatenate(self.columns[c]) for c in OF_DOCS}
        yield rows(
            columns
            | {
                "pos": np.arange(self.n_docs, dtype=np.int32),
                KEY: pa.concat_arrays(self.keys),
                "groups_sha256": digests,
            }
        )
        entries, links = np.concatenate(self.entries), np.concatenate(self.links)
        order = np.argsort(entries)
        entries, links = entries[order], links[order]
        pair, pos = entries >> 16, entries & 0xFFFF
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
        starts = np.concatenate((starts, [len(pair)]))
        for i in range(0, len(starts) - 1, ROWS):
            cuts = starts[i : i + ROWS + 1]
            part = slice(cuts[0], cuts[-1])
            own = cuts - cuts[0]
            offsets, data = pack(own, pos[part], links[part], self.n_docs)
            bits = pa.Array.from_buffers(
                pa.binary(),
                len(own) - 1,
                [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)],
            )
            pairs = pair[cuts[:-1]]
            yield rows(
                {
                    "a": (pairs >> 16).astype(np.int32),
                    "b": (pairs & 0xFFFF).astype(np.int32),
                    "n": np.diff(own).astype(np.int32),
                    "links": np.add.reduceat(links[part], own[:-1]),
                    "bits": bits,
                }
            )


def build_index(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    paths: tuple[str, str] | None = None,
    block_entries: int = BLOCK_ENTRIES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The index of ``docs``, stored: rows of documents (``pos`` is set) and of postings (``a`` and
    ``b`` are). One pass, no shuffle; a task holds one block, which ends at ``block_entries``
    (document, pair) entries, after the document that reaches them.

    Every row is a document, also where rows are repeated or keys null. Null and empty texts, and
    texts that a tokenizer does not give back byte for byte, have no tokens.
    """
    byte_path, piece_path = paths or default_paths()
    schema = _index_schema(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_cache(
            "aligner", lambda: Aligner(byte_path, piece_path), (byte_path, piece_path)
        )
        number = TaskContext.get().partitionId() << 33
        held, out = _Block(), None
        for batch in batches:
            keys, texts = batch.columns
            if out is None:
                kinds = {
                    T.LongType: pa.int64(), T.IntegerType: pa.int32(),
                    T.StringType: pa.string(), T.BinaryType: pa.binary(),
                }
                kind = lambda f: keys.type if f.name == KEY else kinds[type(f.dataType)]
                out = pa.schema([(f.name, kind(f)) for f in schema])
            first = 0
            while first < batch.num_rows:
                last, size, part = first, 0, []
                while last < batch.num_rows and (not part or size < chunk_bytes):
                    if held.n_docs + len(part) == BLOCK_DOCS:
                        break
                    part.append(texts[last].as_py())
                    size += len(part[-1] or "")
                    last += 1
                if part:
                    held.add(keys.slice(first, last - first), aligner.align(part))
                if held.n_entries >= block_entries or held.n_docs == BLOCK_DOCS:
                    yield from held.batches(number, out)
                    held, number = _Block(), number + 1
                first = last
        if held.n_docs:
            yield from held.batches(number, out)

    columns = docs.select(F.col(key).alias(KEY), F.col(text).cast("string").alias("_llm_text"))
    return store(columns.mapInArrow(run, schema), "alignment")


def pair_counts(index: DataFrame) -> DataFrame:
    """``a, b, docs, links, best`` of every linked pair of ids: the documents that hold it, its
    links, and whether no pair with the same ``a`` is in more documents (ties are all best)."""
    merged = (
        index.where("a IS NOT NULL")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("docs"), F.sum("links").alias("links"))
    )
    most = F.max("docs").over(Window.partitionBy("a"))  # at most one row for each id of B
    return merged.withColumn("best", F.col("docs") == most)


def scores(index: DataFrame) -> DataFrame:
    """Of every document its columns in the index, ``n_best`` (links whose pair is best) and
    ``count_sum`` (documents of its links' pairs, added up)."""
    counted = pair_counts(index).select("a", "b", "docs", "best")
    postings = (
        index.where("a IS NOT NULL")
        .select("block", "n_docs", "a", "b", "n", "bits")
        .join(counted, ["a", "b"])
        .select(
            "block",
            F.lit(-1).alias("pos"),
            "n_docs",
            "n",
            "bits",
            "docs",
            "best",
            *(F.lit(None).cast(index.schema[c].dataType).alias(c) for c in DOCUMENT),
        )
    )
    docs = index.where("pos IS NOT NULL").select(
        "block",
        "pos",
        "n_docs",
        F.lit(None).cast("int").alias("n"),
        F.lit(None).cast("binary").alias("bits"),
        F.lit(None).cast("bigint").alias("docs"),
        F.lit(None).cast("boolean").alias("best"),
        *DOCUMENT,
    )
    schema = T.StructType(
        [
            *(index.schema[c] for c in DOCUMENT),
            T.StructField("n_best", T.LongType()),
            T.StructField("count_sum", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a block the postings come first, then the documents.
        block, total, best = None, None, None
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                n_docs = part.column("n_docs")[0].as_py()
                if block != numbers[i]:
                    block = numbers[i]
                    total, best = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
                pos = part.column("pos").to_numpy()
                split = int(np.searchsorted(pos, 0))
                if split:
                    postings = part.slice(0, split)
                    n = postings.column("n").to_numpy().astype(np.int64)
                    offsets, data = _buffers(postings.column("bits"))
                    row, doc, links = unpack(n, offsets, data, n_docs)
                    count = postings.column("docs").to_numpy()
                    is_best = postings.column("best").to_numpy(zero_copy_only=False)
                    np.add.at(total, doc, links * count[row])
                    np.add.at(best, doc, links * is_best[row])
                if split < len(pos):
                    found = part.slice(split)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(found.column(c) for c in DOCUMENT),
                            pa.array(best[pos[split:]]),
                            pa.array(total[pos[split:]]),
                        ],
                        names=schema.names,
                    )

    return (
        postings.unionByName(docs)
        .repartition("block")
        .sortWithinPartitions("block", "pos")
        .mapInArrow(run, schema)
    )


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a binary column without nulls."""
    size = 8 if pa.types.is_large_binary(column.type) else 4
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, dtype=f"<i{size}")[column.offset :][: len(column) + 1]
    cuts = cuts.astype(np.int64)
    if data is None:
        return cuts - cuts[0], np.empty(0, np.uint8)
    return cuts - cuts[0], np.frombuffer(data, dtype=np.uint8)[cuts[0] : cuts[-1]]


def align_documents(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """One row a document: ``key``, token, group and link counts, ``n_best``, ``count_sum`` and the
    digest of its groups. Other columns of ``docs`` play no part, whatever their names. An empty
    table gives an empty result."""
    return scores(build_index(docs, text, key, paths)).withColumnRenamed(KEY, key)
