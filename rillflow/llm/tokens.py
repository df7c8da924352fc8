"""Token counts from flat token files by a scan for separators."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256  #: end of document: the first id that the vocabulary leaves free
WIDTH = 2  #: bytes of an id, little endian
BLOCK_BYTES = 1 << 22

SEGMENT = 1024  #: blocks whose summaries one task adds up
LONG_RUN = 1_000  #: blanks in a row that the pattern isn't tried on
#: What the pattern takes as a blank.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_encoders: dict = {}


class Encoder:
    """A byte-pair tokenizer whose special strings are ordinary text, for texts of any kind.

    The pattern goes back blank by blank over a run of them, which ends the process on a very long one. There its result is known: all blanks
    but the last are one piece (the last too at the end of the text), and what comes before and after is split as it would be anyway. So long runs are encoded as one piece, and the rest by the pattern.
    """

    def __init__(self, ranks: dict[bytes, int], long_run: int = LONG_RUN):
        import tiktoken

        self.plain, self.whole = (tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for name, pattern in (("own", PATTERN), ("whole", r"(?s:.+)")))
        self.runs = re.compile(f"{BLANK}{{{max(long_run, 2)},}}")

    def encode_ordinary(self, text: str) -> list[int]:
        ids, at = [], 0
        for run in self.runs.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.plain(text[at : run.start()])
            ids += self.whole(text[run.start() : end])
            at = end
        return ids + self.plain(text[at:]) if at else self.plain(text)


def encoder(ranks: bytes | None = None) -> Encoder:
    """The tokenizer of a ranks file's content (VOCABULARY's by default), built once per worker."""
    if ranks is None:
        with open(VOCABULARY, "rb") as f:
            ranks = f.read()
    name = hash(ranks)
    if name not in _encoders:
        _encoders[name] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
    return _encoders[name]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each partition's texts as one flat file of 16-bit ids in ``folder``, ``end`` after each text; returns (file, ordinal, id), an order without lengths.

    A file's name is new for each attempt of a task, and only the files of attempts that count are named in the
    result, so a task that runs twice does no harm. ``folder`` is opened through pyarrow.fs by its address, so it can be in any store that has a driver there. A null text has no token.
    The driver reads the ranks file (about 1 MB) and sends it to the tasks. A vocabulary with an id that isn't below ``end``, and an ``end`` that
    takes more than 16 bits, are errors.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    top = max((int(line.split()[1]) for line in content.splitlines()), default=-1)
    if not top < end < 1 << (8 * WIDTH):
        raise ValueError(f"ids go up to {top}, the end of a document is {end}, and {WIDTH} bytes hold less than {1 << (8 * WIDTH)}")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, ordinal = f"{uuid.uuid4().hex}.tok", None, 0
        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            if out is None:
                store, path = _store(folder)
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}")
            for t in batch.column(1):
                ids = encode(t.as_py() or "")
                ids.append(end)
                out.write(np.array(ids, "<u2").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], ["file", "ordinal", "id"])
            ordinal += n
        if out is not None:
            out.close()

    return written(docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, f"file string, ordinal long, id {kind}"))


def scan_token_files(spark: SparkSession, folder: str, names: DataFrame | None = None, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Length of every document in the flat token files of a folder: (file, ordinal, n_tokens), the separator not counted. ``names`` (file) are the files that count; all by default.

    Files are cut into blocks of ``block_bytes`` wherever that falls, and dealt out block by block. Each block is searched on its own with one comparison over all its ids,
    giving the lengths of documents that lie inside, and how far its first and last separators are from its ends. A prefix scan over the blocks' summaries (the place of the last separator so
    far, and the number of separators so far), first over segments of SEGMENT blocks and then inside them, closes
    the documents that cross blocks, however many, and the lengths are joined to it by block. Ids after a file's last separator are one more document; an empty file has none.
    A file whose size is no multiple of ``width`` fails the job.
    """
    dtype = {2: "<u2", 4: "<u4"}[width]
    step = block_bytes // width * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "length")
    if names is not None:
        files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(names.select("file").distinct(), "file", "left_semi").select("path", "length")
    blocks = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block"))
    blocks = blocks.repartition("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, block in zip(*[c.to_pylist() for c in batch.columns]):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are no whole number of ids")
                store, at = _store(path)
                with store.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(min(step, length - block * step), block * step), dtype)
                ends = np.flatnonzero(ids == end)
                first = block * step // width
                last = [int(ends[-1]) + first] if len(ends) else [None]
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([block]), pa.array([first]), pa.array([(block + 1) * step >= length]), pa.array([len(ids)]), pa.array([len(ends)]), pa.array([int(ends[0]) if len(ends) else None], pa.int64()), pa.array(last, pa.int64()), pa.array([np.diff(ends) - 1], pa.list_(pa.int64()))], ["file", "block", "first", "final", "ids", "ends", "head", "last", "inside"])

    seen = written(blocks.mapInArrow(run, "file string, block long, first long, final boolean, ids long, ends long, head long, last long, inside array<long>"))
    short = seen.select("file", "block", F.expr(f"block div {SEGMENT}").alias("segment"), "ends", "last")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = before(Window.partitionBy("file").orderBy("segment"))
    segments = short.groupBy("file", "segment").agg(F.sum("ends").alias("e"), F.max("last").alias("l"))
    segments = segments.select("file", "segment", F.coalesce(F.sum("e").over(over), F.lit(0)).alias("s_ends"), F.max("l").over(over).alias("s_last"))
    inside = before(Window.partitionBy("file", "segment").orderBy("block"))
    short = short.select("file", "segment", "block", F.coalesce(F.sum("ends").over(inside), F.lit(0)).alias("b_ends"), F.max("last").over(inside).alias("b_last")).join(segments, ["file", "segment"])
    short = short.select("file", "block", (F.col("s_ends") + F.col("b_ends")).alias("ordinal"), (F.coalesce("b_last", "s_last", F.lit(-1)) + 1).alias("from"))
    seen = seen.join(short, ["file", "block"]).withColumn("since", F.col("first") - F.col("from"))
    rest = F.when(F.col("ends") > 0, F.col("first") + F.col("ids") - 1 - F.col("last")).otherwise(F.col("since") + F.col("ids"))
    none = F.array().cast("array<bigint>")
    lengths = F.concat(F.when(F.col("ends") > 0, F.array(F.col("since") + F.col("head"))).otherwise(none), "inside", F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(none))
    return seen.select("file", "ordinal", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each document: (id, n_tokens), from flat token files written to the shared folder and scanned there; files that failed attempts left there aren't read. Null ids and repeated rows are rows like others; null and empty texts have 0 tokens; a text of any length is encoded whole; other columns are ignored; an empty table gives no rows."""
    folder = shared_dir(docs.sparkSession)
    order = write_token_files(docs, folder, vocabulary, id_col=id_col, text=text)
    if order.isEmpty():
        return order.select(F.col("id").alias(id_col), F.col("ordinal").alias("n_tokens"))
    counts = scan_token_files(docs.sparkSession, folder, order)
    return order.join(counts.hint("merge"), ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
