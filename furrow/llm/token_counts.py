"""Token counts by a separator scan.

Documents become flat files of token ids, each document followed by the end-of-document id and nothing
else: no index, no lengths. Counting them again takes one pass over fixed-size blocks that many tasks
read at once: a vectorised search finds the separators of a block, a prefix scan over the blocks of a
file (a row each) carries the ordinal and the place of the last separator across block boundaries, and
the gaps between separators are the counts.

Edge cases: a null text counts as empty (no tokens, but its separator); an empty table makes no files and
an empty result; repeated rows and null ids stay as they are; tokens after a file's last separator are a
document of their own, marked as not terminated; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import cut, fresh_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern published with that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a block that one task reads at once.
BLOCK = 8 << 20
BUFFER = 1 << 20

SIDE_SQL = "file string, ordinal long, doc_id long, ids long"
SIDE = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.int64())])


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks: dict[bytes, int]) -> Callable[[str], np.ndarray]:
    import tiktoken

    encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=())


def id_type(end: int) -> np.dtype:
    """Little-endian, as narrow as the largest id allows."""
    return np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")


def write_flat(docs: DataFrame, path: str, ranks: dict[bytes, int], end: int) -> DataFrame:
    """Flat token files under path, one for each task; returns rows (file, ordinal, doc_id, null) in file order, and (file, null, null, ids) for each file.

    The vocabulary goes out as a broadcast: its size is that of the vocabulary file, whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = id_type(end)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name, held = f"{folder}/part-{context.partitionId():06d}.ids", f"{folder}/.attempt-{context.taskAttemptId()}"
        encode, out, ordinal, total = None, None, 0, 0
        mark = np.array([end], kind).tobytes()
        buffer = bytearray()
        for batch in batches:
            encode = encode or encoder(shared.value)
            out = out or fs.open_output_stream(held, compression=None)
            for text in batch.column("text"):
                ids = encode(text.as_py() or "").astype(kind)
                total += len(ids) + 1
                buffer += ids.tobytes() + mark
                if len(buffer) >= BUFFER:
                    out.write(bytes(buffer))
                    buffer.clear()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id"), pa.nulls(n, pa.int64())], schema=SIDE)
            ordinal += n
        if out:
            out.write(bytes(buffer))
            out.close()
            fs.move(held, name)
            yield pa.RecordBatch.from_pylist([{"file": name, "ordinal": None, "doc_id": None, "ids": total}], schema=SIDE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(task, SIDE_SQL)


def scan_blocks(files: DataFrame, shared: str, end: int, block: int = BLOCK) -> DataFrame:
    """(file, block, ids, ends): for each block its number of ids and the places of its separators, counted from its start. files: (file, ids)."""
    kind = id_type(end)
    per = block // kind.itemsize
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ids", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(shared)
        for batch in batches:
            for name, no in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with fs.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(per * kind.itemsize, no * per * kind.itemsize), kind)
                yield pa.RecordBatch.from_pydict({"file": [name], "block": [no], "ids": [len(ids)], "ends": [np.flatnonzero(ids == end)]}, schema=schema)

    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(ids - 1) div {per}"))).alias("block"))
    return blocks.repartition(F.col("file"), F.col("block")).mapInArrow(task, "file string, block long, ids long, ends array<long>")


def stitch(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, terminated) for each document from the rows of scan_blocks().

    The prefix scan runs over one narrow row for each block; the places of the separators don't take part.
    """
    narrow = blocks.select("file", "block", "ids", F.size("ends").alias("n"), F.expr("if(size(ends) > 0, ends[size(ends) - 1], null)").alias("last_end"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = narrow.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    scan = scan.withColumn("place", F.col("start") + F.col("last_end"))
    scan = scan.select(
        "file", "block", "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.last("place", ignorenulls=True).over(before), F.lit(-1)).alias("carried"),
        F.lead("block").over(order).isNull().alias("final"),
        (F.col("start") + F.col("ids")).alias("until"),
        F.last("place", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("latest"),
        (F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).alias("count"),
    )
    gaps = "transform(ends, (e, i) -> if(i = 0, e + start - carried, e - ends[i - 1]) - 1)"
    ended = blocks.select("file", "block", "ends").join(scan.select("file", "block", "start", "base", "carried"), ["file", "block"])
    ended = ended.select("file", "base", F.posexplode(F.expr(gaps)).alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    tail = scan.where("final").select("file", F.col("count").alias("ordinal"), (F.col("until") - F.coalesce("latest", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(tail.where("n_tokens > 0"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens for every row of docs, through flat files in the shared folder."""
    spark: SparkSession = docs.sparkSession
    ranks = load_ranks(vocabulary)
    end = max(ranks.values()) + 1  # the first free id
    path = fresh_path(spark, "flat-ids")
    side = cut(write_flat(docs, path, ranks, end), "flat-side")
    files = side.where("ordinal is null").select("file", "ids")
    counted = stitch(scan_blocks(files, path, end, block))
    return side.where("ordinal is not null").select("file", "ordinal", "doc_id").join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
