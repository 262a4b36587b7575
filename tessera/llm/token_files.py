"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

Method. Documents are range-partitioned by id and sorted, and each partition
encodes its texts and writes one part in the shared folder:

* ``part-N.tokens``: ids in a row, little-endian, 2 bytes where the vocabulary
  has at most 65,536 ids, else 4;
* ``part-N.offsets``: little-endian 64-bit, a document's first id within the
  part, and one entry more;
* ``part-N.docs``: little-endian signed 64-bit document ids (the least of all
  stands for null).

A part is written under a name of its own and renamed when whole, so a task that
is run again, or twice, leaves the same file. ``index.json`` lists the parts in
order with their bases, the prefix sums of their sizes; a base plus a part's
offset is a document's place in the whole. Reading maps the files into memory
where the folder is a file system's, else reads ranges of them.

A partition holds ``PART_BYTES`` of text or a single text; a long text is encoded in
one go (its ids take four bytes each).

Defined cases: a null or empty text is the end id alone; rows of one id (null, say)
follow one another by a hash of their texts, over as many parts as they fill; equal
rows are equal in the files too; an empty table gives an index without parts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, public_id, slices
from .tokens import SLICE, encoder, with_end

_PART = "part int, docs long, tokens long"
#: Bytes of text that one part is made of, about.
PART_BYTES = 64 << 20


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def _writer(folder: str, tokenizer: str, space_leads: bool, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = _at(folder)
        enc = encoder(tokenizer, space_leads)
        kind = np.dtype("<u2") if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
        own = uuid.uuid4().hex
        names = {x: (f"{base}/.{own}-{part:05d}.{x}", f"{base}/part-{part:05d}.{x}") for x in ("tokens", "offsets", "docs")}
        files, docs, tokens = {}, 0, 0
        for b in slices(batches, most=SLICE):
            if not files:
                files = {x: fs.open_output_stream(tmp) for x, (tmp, _) in names.items()}
                files["offsets"].write(np.zeros(1, "<u8").tobytes())
            ids, offsets = with_end(*enc.encode(b.column("text")), end_id)
            files["tokens"].write(ids.astype(kind).tobytes())
            files["offsets"].write((offsets[1:] + tokens).astype("<u8").tobytes())
            files["docs"].write(b.column("doc_id").to_numpy().astype("<i8").tobytes())
            docs += b.num_rows
            tokens += len(ids)
        if files:
            for x, f in files.items():
                f.close()
                fs.move(*names[x])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": [docs], "tokens": [tokens]})

    return write


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end_id: int, space_leads: bool = False, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode all texts into ``folder``, a URI that all executors share; returns the index."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    fs, base = _at(folder)
    fs.create_dir(base, recursive=True)
    docs = documents(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    docs = docs.repartitionByRange(max(partitions(df.sparkSession), size // PART_BYTES), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    rows = sorted(docs.mapInArrow(_writer(folder, tokenizer, space_leads, end_id), _PART).collect())  # a row for each part
    parts, first_doc, first_token = [], 0, 0
    for r in rows:
        parts.append({"name": f"part-{r.part:05d}", "docs": r.docs, "tokens": r.tokens, "first_doc": first_doc, "first_token": first_token})
        first_doc, first_token = first_doc + r.docs, first_token + r.tokens
    index = {"bytes_per_id": width, "end_id": end_id, "docs": first_doc, "tokens": first_token, "parts": parts}
    with fs.open_output_stream(f"{base}/index.json") as f:
        f.write(json.dumps(index).encode())
    return index


def read_index(folder: str) -> dict:
    fs, base = _at(folder)
    with fs.open_input_file(f"{base}/index.json") as f:
        return json.loads(f.read())


def open_array(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where the folder is a local path, else read."""
    fs, base = _at(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", kind, "r")
    with fs.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def _digests(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column("name").to_pylist(), b.column("first_token").to_pylist()):
                ids = open_array(folder, f"{name}.tokens", f"<u{width}")
                offsets = np.asarray(open_array(folder, f"{name}.offsets", "<u8"), np.int64)
                docs = np.asarray(open_array(folder, f"{name}.docs", "<i8"))
                for low in range(0, len(docs), 10_000):
                    part = offsets[low : low + 10_001]
                    crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(part[:-1].tolist(), part[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[low : low + 10_000]), pa.array(part[:-1] + first), pa.array(np.diff(part)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    index = read_index(folder)
    parts = [(p["name"], p["first_token"]) for p in index["parts"]]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(parts, max(1, len(parts))), "name string, first_token long")
    return rows.mapInArrow(_digests(folder, index["bytes_per_id"]), "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", public_id())
