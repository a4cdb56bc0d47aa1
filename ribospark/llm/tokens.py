"""Encoding of a corpus with a byte-level BPE vocabulary by overlapping chunks.

Every text is cut into chunks that overlap; a short one is a text of one chunk. The chunks are pre-tokenised, two
neighbours are stitched at the first pre-token boundary on which both agree, from where on they must agree, and the
pre-tokens between the stitches are encoded. Decoding concatenates the raw bytes of the tokens. A task does so for the
chunks of the texts it holds; the chunks of a text that is long for one task are spread over the cluster.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribospark.session import checkpointed

#: Where the box keeps the vocabulary; pass another path where it lies elsewhere. It must be readable by every worker.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pre-tokens for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 1_024, 128
#: Chunks of a text that one task works on; those of a longer text are spread over the tasks.
TASK_CHUNKS = 1_024
#: A boundary this close to the end of a cut chunk may depend on what follows.
_MARGIN = 8


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder, once per worker process."""
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks(path).items()}


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of token ids: their raw bytes, concatenated."""
    tokens = _tokens(path)
    return b"".join(tokens[i] for i in ids).decode("utf-8")


def pre_tokens(text: str) -> list[str]:
    return _splitter().findall(text)


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens of a text."""
    return list(accumulate(map(len, pre_tokens(text))))


class Pieces(dict):
    """Pre-token -> its token ids. What is remembered is bounded; long pre-tokens are encoded anew."""

    SIZE, LENGTH = 500_000, 40

    def __init__(self, path: str):
        super().__init__()
        self._encode = encoding(path)._encode_single_piece

    def __missing__(self, piece: str) -> list[int]:
        ids = self._encode(piece)
        if len(piece) <= self.LENGTH:
            if len(self) >= self.SIZE:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, tokens: Iterator[str]) -> Iterator[int]:
        return chain.from_iterable(map(self.__getitem__, tokens))


def stitch(ends: list[int], following: list[int], chunk: int, overlap: int) -> int | None:
    """Where a chunk and the one after it are cut, counted in the latter: the least boundary on which both agree.

    ``ends`` and ``following`` are their boundaries. Those of the former too close to its end don't count; the start
    of the latter is one of its own. None if they agree on none.
    """
    tail = ends[bisect_left(ends, chunk) : bisect_right(ends, ends[-1] - _MARGIN)]
    head = {0, *following[: bisect_right(following, overlap)]}
    return next((e - chunk for e in tail if e - chunk in head), None)


def stitched_tokens(text: str, chunk: int, overlap: int) -> tuple[Iterator[str], int]:
    """The pre-tokens of a text, from its chunks, and how often two neighbours agreed on no boundary.

    Such a chunk is made twice as long and tried again; in the end it is the rest of the text.
    """
    out, joined = [], 0
    at, end, start = 0, chunk, 0
    tokens = pre_tokens(text[: end + overlap])
    own = list(accumulate(map(len, tokens)))
    while end < len(text):
        following = pre_tokens(text[end : end + chunk + overlap])
        ends = list(accumulate(map(len, following)))
        cut = stitch(own, ends, end - at, overlap)
        if cut is None:
            joined += 1
            end = at + 2 * (end - at)
            tokens = pre_tokens(text[at : end + overlap])
            own = list(accumulate(map(len, tokens)))
        else:
            out.append(islice(tokens, bisect_right(own, start) if start else 0, bisect_right(own, cut + end - at)))
            at, end, start, tokens, own = end, end + chunk, cut, following, ends
    out.append(islice(tokens, bisect_right(own, start) if start else 0, None))
    return chain.from_iterable(out), joined


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker holds the lists of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(rows: Iterator[Iterator[int]]) -> pa.Array:
    flat, offsets = [], [0]
    for ids in rows:
        flat += ids
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _encode(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)

        def encoded(text: str | None) -> Iterator[int]:
            return pieces.ids(stitched_tokens(text, chunk, overlap)[0]) if text else iter(())

        for batch in _slices(batches):
            ids = _lists(map(encoded, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, texts, last = [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                n = -(-len(t) // chunk)
                at += [i] * n
                number += range(n)
                texts += [t[k * chunk : (k + 1) * chunk + overlap] for k in range(n)]
                last += [k == n - 1 for k in range(n)]
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "uid")]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(number, pa.int32()), pa.array(texts, pa.string()), pa.array(last, pa.bool_())],
                ["doc_id", "uid", "k", "text", "last"],
            )

    return run


def _pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        ends = [boundaries(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], [*batch.schema.names, "ends"])


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)

        def own(text: str, ends: list[int], start: int, stop: int) -> Iterator[int]:
            inside = ends[bisect_right(ends, start) if start else 0 : bisect_right(ends, stop)]
            return pieces.ids(text[a:b] for a, b in zip([start, *inside], inside, strict=False))

        for batch in _slices(batches):
            cols = [batch.column(c).to_pylist() for c in ("text", "ends", "start", "stop")]
            keep = [batch.column(c) for c in ("doc_id", "uid", "k")]
            yield pa.RecordBatch.from_arrays([*keep, _lists(map(own, *cols))], ["doc_id", "uid", "k", "ids"])

    return run


def stitched(chunks: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(uid, k, start, stop, agreed) for each chunk: the part of it that is its own, and whether its text could be stitched.

    ``chunks`` has uid, k, last and ends. A cut between chunk k and k + 1 is the least boundary on which both agree;
    boundaries of k too close to its end don't count, and the start of k + 1 is one of its boundaries.
    """
    w = Window.partitionBy("uid").orderBy("k")
    tail = F.transform(F.filter("ends", lambda e: (e >= chunk) & (e <= F.col("reach") - _MARGIN)), lambda e: e - chunk)
    zones = chunks.withColumn("reach", F.coalesce(F.array_max("ends"), F.lit(0)))
    head = F.concat(F.array(F.lit(0)), F.filter("ends", lambda e: e <= overlap))
    zones = zones.select("uid", "k", "last", "reach", tail.alias("tail"), head.alias("head"))
    cut = F.array_min(F.array_intersect(F.col("tail"), F.lead("head").over(w)))
    cuts = zones.select("uid", "k", "last", "reach", cut.alias("cut"))
    every = Window.partitionBy("uid")
    return cuts.select(
        "uid",
        "k",
        F.coalesce(F.lag("cut").over(w), F.lit(0)).alias("start"),
        F.when(F.col("last"), F.col("reach")).otherwise(F.col("cut") + chunk).alias("stop"),
        (F.count(F.when(~F.col("last") & F.col("cut").isNull(), 1)).over(every) == 0).alias("agreed"),
    )


def encode_corpus(
    documents: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, task_chunks: int = TASK_CHUNKS
) -> DataFrame:
    """(doc_id, ids): every row of ``documents`` (doc_id, text) with the token ids of its text, without special tokens.

    Null and empty texts give an empty list; blank text is encoded as it is, and strings that look like special tokens
    are plain text. Every text is encoded chunk by chunk; where neighbouring chunks agree on no boundary (an overlap
    without any, such as one endless word) the chunk is made longer. The chunks of a text of more than ``task_chunks``
    are pre-tokenised and encoded by different tasks. Repeated rows and repeated or null ids give one
    result per row. Other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    whole_schema = f"doc_id {kind}, ids array<int>"
    docs = documents.select("doc_id", "text")
    spread = F.coalesce(F.length("text") > chunk * task_chunks, F.lit(False))
    own_task = docs.where(~spread).mapInArrow(_encode(vocabulary, chunk, overlap), whole_schema)
    long = docs.where(spread).withColumn("uid", F.monotonically_increasing_id())
    cut = long.mapInArrow(_cut(chunk, overlap), f"doc_id {kind}, uid bigint, k int, text string, last boolean")
    # Written once: the stitching reads the boundaries, the encoding the chunks.
    chunks = checkpointed(
        cut.repartition("uid", "k").mapInArrow(
            _pretokenise, f"doc_id {kind}, uid bigint, k int, text string, last boolean, ends array<int>"
        )
    )
    parts = chunks.join(stitched(chunks, chunk, overlap), ["uid", "k"])
    pieces = parts.where("agreed").mapInArrow(_encode_pieces(vocabulary), f"doc_id {kind}, uid bigint, k int, ids array<int>")

    def in_order(value: str):
        return F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda s: s[value])

    joined = pieces.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.flatten(in_order("ids")).alias("ids"))
    # No agreement: put the chunks' own parts together again and encode the text as one.
    own = parts.where(~F.col("agreed")).withColumn("own", F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk)))
    unstitched = own.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_join(in_order("own"), "").alias("text"))
    rest = unstitched.select("doc_id", "text").mapInArrow(_encode(vocabulary, chunk, overlap), whole_schema)
    return own_task.unionByName(joined.select("doc_id", "ids")).unionByName(rest)


def agreement(documents: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(n_chunks, joined, n): how many texts have so many chunks, and how often one of their chunks had to be made longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t]
            counts = [[-(-len(t) // chunk) for t in texts], [stitched_tokens(t, chunk, overlap)[1] for t in texts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in counts], ["n_chunks", "joined"])

    return documents.select("text").mapInArrow(run, "n_chunks int, joined int").groupBy("n_chunks", "joined").agg(F.count(F.lit(1)).alias("n"))
