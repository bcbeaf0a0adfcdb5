"""Token-ID output: Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned and sorted by doc_id; each task encodes its texts, appends the end id to each, and
packs the ids of its partition into sequences of equal length. ``ids-N.arrow`` holds the columns ids (fixed-size list
of uint16 or uint32) and mask (fixed-size list of booleans, false on the padding of the last sequence), so sequence k
of a file is found without reading the others and without copying. ``docs-N.arrow`` holds each document's first id
and number of ids within the file. Both are written under a temporary name and renamed, so a task that runs again
leaves the same files.

Words between ASCII white space are encoded once per worker and kept in a table of bounded size: a tokenizer that
drops white space never joins across it, so a text's ids are its words' ids.

Cases: a null text is empty and has the end id alone; rows with a null doc_id come first; rows that share a doc_id are
written each, by text; an empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, small_batches, table, worker_state

SEQUENCE = 2048
BATCH = 64
END_ID = 2
#: Words, and units of words, that a worker keeps: two generations of this many.
CACHED_WORDS, CACHED_UNITS = 400_000, 200_000
#: The pattern by which a word of ASCII letters alone is one unit.
LETTERS_WHOLE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Cache(dict):
    """Values of keys by a function, in two generations of bounded size."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordEncoder:
    """Ids of UTF-8 texts as bytes.

    With a tokenizer that folds case by NFC and Lowercase and keeps only the matches of a pattern free of white space,
    words are encoded apart and kept. Words of Latin letters below U+0180, where NFC changes nothing, are cut by the
    same pattern and given to the BPE model unit by unit; other words go through the whole tokenizer, and any other
    tokenizer gets whole texts.
    """

    def __init__(self, path: str, dtype: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.code = Tokenizer.from_file(path), dtype, {"<u2": "H", "<u4": "I"}[dtype]
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and cut.get("type") == "Split" and cut["behavior"] == "Removed" and cut["invert"] and not any(a["lstrip"] or a["rstrip"] for a in spec["added_tokens"])
        if self.by_word:
            self.units_of = regex.compile(cut["pattern"]["Regex"]).findall
            self.letters_whole = cut["pattern"]["Regex"] == LETTERS_WHOLE
            self.by_word = all(a["content"].startswith("<|") for a in spec["added_tokens"])
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in set(plain)]
            self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}  # the byte-level alphabet
            self.units = _Cache(self._unit, CACHED_UNITS)
            self.words = _Cache(self._word, CACHED_WORDS)

    def _ids(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _unit(self, unit: str) -> bytes:
        letters = unit if unit.isascii() and unit.isprintable() else unit.encode().decode("latin1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if self.letters_whole and word.isalpha():  # of bytes: ASCII letters only
            return self.units[word.lower().decode()]
        text = word.decode("utf-8")
        if b"<|" not in word and (len(text) == len(word) or (max(text) < "\u0180" and "\u0130" not in text)):
            units = self.units_of(text.lower())
            return self.units[units[0]] if len(units) == 1 else b"".join(map(self.units.__getitem__, units))
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: bytes) -> bytes:
        if self.by_word:
            return b"".join(map(self.words.__getitem__, text.split()))
        return self._ids(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


class _Packer:
    """Writes a stream of ids as equal-length sequences."""

    def __init__(self, sink, dtype: str, length: int):
        self.dtype, self.length = dtype, length
        kind = pa.uint16() if dtype == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts, self.held = [], 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids) // np.dtype(self.dtype).itemsize
        if self.held >= self.length * BATCH:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), dtype=self.dtype)
        rows = -(-len(ids) // self.length) if last else len(ids) // self.length
        whole, rest = ids[: rows * self.length], ids[rows * self.length :]
        pad = rows * self.length - len(whole)
        mask = np.ones(rows * self.length, bool)
        if pad:
            whole, mask[-pad:] = np.concatenate([whole, np.zeros(pad, whole.dtype)]), False
        for at in range(0, rows, BATCH):
            cut = slice(at * self.length, min(rows, at + BATCH) * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), self.length) for x in (whole, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.parts, self.held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self.flush(True)
        self.writer.close()


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE, vocabulary: int = 65_536) -> DataFrame:
    """Writes the files under uri; part, documents and ids of each file."""
    spark = docs.sparkSession
    small_batches(spark)
    dtype = "<u2" if vocabulary <= 65_536 else "<u4"
    end = np.array([end_id], dtype=dtype).tobytes()

    def encode(batches):
        part, encoder, packer = TaskContext.get().partitionId(), None, None
        ids, starts, sizes, at = [], [], [], 0
        for batch in batches:
            if encoder is None:
                encoder = worker_state((tokenizer, dtype), lambda: WordEncoder(tokenizer, dtype))
                system, root = _open(uri)
                system.create_dir(root)
                names = {kind: (f"{root}/.{kind}-{part:05d}-{uuid.uuid4().hex}", f"{root}/{kind}-{part:05d}.arrow") for kind in ("ids", "docs")}
                sink = system.open_output_stream(names["ids"][0])
                packer = _Packer(sink, dtype, length)
            for text in batch.column(1).cast(pa.large_binary()):
                own = encoder(text.as_py() or b"") + end
                packer.add(own)
                starts.append(at)
                sizes.append(len(own) // np.dtype(dtype).itemsize)
                at += sizes[-1]
            ids.append(batch.column(0))
        if packer is None:
            return
        packer.close()
        sink.close()
        index = pa.table({"doc_id": pa.chunked_array(ids), "start": pa.array(starts, pa.int64()), "n": pa.array(sizes, pa.int64())})
        with system.open_output_stream(names["docs"][0]) as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        for temporary, final in names.values():
            if system.type_name == "hdfs" and system.get_file_info(final).type != pafs.FileType.NotFound:
                system.delete_file(final)
            system.move(temporary, final)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(sizes)]), pa.array([at])], ["part", "n_docs", "n_ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, "part long, n_docs long, n_ids long")


def sequences(path: str):
    """Batches of one ids file, mapped into memory where it is local."""
    system, at = _open(path)
    source = pa.memory_map(at) if system.type_name == "local" else system.open_input_file(at)
    reader = pa.ipc.open_file(source)
    for k in range(reader.num_record_batches):
        yield reader.get_batch(k)


def read(spark: SparkSession, uri: str, files: DataFrame, kind: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files that ``files`` lists."""
    parts = files.orderBy("part").collect()  # a row for each file
    at, rows = 0, []
    for r in parts:
        rows.append((r.part, at))
        at += r.n_ids

    def load(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, root = _open(uri)
                with system.open_input_file(f"{root}/docs-{part:05d}.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                starts, sizes = index["start"].to_numpy(), index["n"].to_numpy()
                crcs, doc, left, crc = np.zeros(len(sizes), np.int64), 0, int(sizes[0]) if len(sizes) else 0, 0
                for b in sequences(f"{uri}/ids-{part:05d}.arrow"):
                    ids = b.column(0).flatten().to_numpy()[b.column(1).flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                    pos = 0
                    while pos < len(ids):
                        take = min(left, len(ids) - pos)
                        crc = zlib.crc32(ids[pos : pos + take].tobytes(), crc)
                        pos, left = pos + take, left - take
                        if not left:
                            crcs[doc], doc, crc = crc, doc + 1, 0
                            left = int(sizes[doc]) if doc < len(sizes) else 0
                assert doc == len(sizes), "an ids file is short"
                for c in pa.table([index["doc_id"], pa.array(starts + base), pa.array(sizes), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches(max_chunksize=10_000):
                    yield c

    order = spark.createDataFrame(rows, "part long, base long")
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    return order.repartition(max(1, len(rows)), "part").mapInArrow(load, schema) if rows else order.limit(0).mapInArrow(load, schema)


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    uri = scratch.path("files")
    files = scratch.save(write(docs, uri, tokenizer), "manifest")
    return read(spark, uri, files, dict(docs.dtypes)["doc_id"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_read(spark, table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_read(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
