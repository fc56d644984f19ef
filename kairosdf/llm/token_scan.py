"""Token counts by separator scan of flat, unindexed token files.

A token file is nothing but little-endian 16- or 32-bit ids, each document's
followed by the end-of-document id.  The scan reads every file in blocks of a
fixed number of tokens, wherever documents begin or end, and finds the
separators of a block with one vectorised comparison.  A prefix scan over the
blocks' separator counts and last separators then numbers the documents and
tells where the first document of each block began, in an earlier block as the
case may be.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Work, file_sizes, open_fs, qualify

BLOCK_TOKENS = 1 << 21
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: an id that the vocabulary leaves free
END_OF_DOCUMENT = 50256
#: splits text into pieces before the merges; a fixed part of the vocabulary's definition
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def encoding(path: str):
    """A tiktoken encoding from a file of ranks, kept for the worker's life."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _writer(folder: str, tokenizer: str, end: int, width: int):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        system, where = open_fs(folder)
        name, ordinal, out = f"tokens-{uuid.uuid4().hex}", 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(where, recursive=True)
                    out = system.open_output_stream(f"{where}/.{name}.tmp")
                for text in batch.column(1).to_pylist():
                    out.write(np.array([*(enc.encode_ordinary(text) if text else ()), end], kind).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n))], names=["doc_id", "file", "ordinal"])
                ordinal += n
        finally:
            if out:
                out.close()
        if out:
            system.move(f"{where}/.{name}.tmp", f"{where}/{name}.bin")

    return run


def write_token_files(docs: DataFrame, folder: str, work: Work, *, tokenizer: str = TOKENIZER, end: int = END_OF_DOCUMENT, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts into flat files under folder, one a partition.

    Returns (doc_id, file, ordinal): which place in which file each row took,
    kept only by the caller; the files themselves have no index.  A task that
    runs twice writes a file of its own each time, and the table names those
    that count.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return work.table("places", base.mapInArrow(_writer(qualify(docs.sparkSession, folder), tokenizer, end, width), "doc_id long, file string, ordinal long"))


def _scan(end: int, width: int, block_tokens: int):
    kind = np.dtype(f"<u{width}")
    names = ["file", "block", "n_tokens", "n_ends", "first_end", "last_end", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, block, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                system, where = open_fs(path)
                with system.open_input_file(where) as f:
                    f.seek(block * block_tokens * width)
                    ids = np.frombuffer(f.read(tokens * width), kind)
                ends = np.flatnonzero(ids == end) + block * block_tokens
                first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (None, None)
                yield pa.RecordBatch.from_arrays([
                    pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()),
                    pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64())),
                ], names=names)

    return run


def scan_token_files(spark: SparkSession, folder: str, work: Work, *, end: int = END_OF_DOCUMENT, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, first_token, n_tokens) of every document of the token files in folder.

    Tokens after a file's last separator are one more document; a file that
    is no whole number of ids is refused.  Empty files hold no documents.
    """
    rows = []
    for path, size in sorted(file_sizes(spark, folder).items()):
        name = path.rsplit("/", 1)[1]
        if name.endswith(".bin") and not name.startswith("."):
            if size % width:
                raise ValueError(f"{path}: {size} bytes are no whole number of {width}-byte ids")
            rows.append((path, name[:-4], size // width))
    # one row a file here; blocks are dealt out on the executors
    files = spark.createDataFrame(rows, "path string, file string, tokens long")
    blocks = files.where("tokens > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {block_tokens}"))))
    blocks = blocks.select("path", "file", "block", F.least(F.lit(block_tokens), F.col("tokens") - F.col("block") * block_tokens).cast("long").alias("tokens"))
    blocks = blocks.repartition(F.col("path"), F.col("block"))
    scanned = work.table("blocks", blocks.mapInArrow(_scan(end, width, block_tokens), "file string, block long, n_tokens long, n_ends long, first_end long, last_end long, ends array<long>"))
    # the prefix scan: documents ended before, and the last separator before, each block of a file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    summary = scanned.select("file", "block", "n_tokens", "n_ends", "last_end")
    summary = summary.withColumns({
        "ordinal": F.coalesce(F.sum("n_ends").over(before), F.lit(0)).cast("long"), "carry": F.coalesce(F.max("last_end").over(before), F.lit(-1)).cast("long"),
        "last": F.row_number().over(whole.orderBy(F.desc("block"))) == 1,
    })
    summary = work.table("prefix", summary.select("file", "block", "ordinal", "carry", "last", (F.col("block") * block_tokens + F.col("n_tokens")).alias("stop")))
    joined = scanned.select("file", "block", "ends").join(summary, ["file", "block"])
    # where a document starts is one past the separator before it
    tail = F.when(F.col("last") & (F.coalesce(F.get("ends", F.size("ends") - 1), F.col("carry")) < F.col("stop") - 1), F.array("stop")).otherwise(F.array().cast("array<long>"))
    stops = F.concat("ends", tail)
    docs = joined.withColumn("stops", stops).select("file", "ordinal", F.concat(F.array("carry"), "stops").alias("bounds"), F.posexplode("stops").alias("k", "stop"))
    start = F.get("bounds", F.col("k")) + 1
    return docs.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("first_token"), (F.col("stop") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, *, tokenizer: str = TOKENIZER, end: int = END_OF_DOCUMENT, width: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of every row, from token files written and then scanned.

    Null and empty texts have no tokens and still one row; rows without an id
    have a null doc_id; repeated rows are each returned.  Only the named
    columns are read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Work(spark, "tokens")
    folder = qualify(spark, work.folder("files"))
    places = write_token_files(docs, folder, work, tokenizer=tokenizer, end=end, width=width, id_col=id_col, text_col=text_col)
    counted = scan_token_files(spark, folder, work, end=end, width=width, block_tokens=block_tokens)
    out = work.table("counts", places.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens"))
    work.drop("files", "blocks", "prefix", "places")
    return out
