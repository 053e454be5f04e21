"""Token ids as length-delimited binary records, with an index file of offsets beside each data file.

A data file is a run of frames: payload length (8 bytes), masked checksum of those 8 bytes (4), payload,
masked checksum of the payload (4), all little-endian. The checksum is CRC-32; masking rotates it right
by 15 bits and adds a constant, so that a checksum stored among checked bytes does not cancel out. A
payload is the document id (8), flags (1: bit 0 a null id, bit 1 four-byte ids) and the token ids, two or
four bytes each. The index file holds the offset of every frame (8 bytes each) for shuffled reads.

Documents are dealt in ascending id ranges, one file each. A task writes under a name of its own attempt
and renames when it is done, so a task that runs again replaces its own file and leaves no half file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm import worker
from holdfast.llm.storage import settle, shared_folder

#: Fixed value of the masking step.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
FOOT = struct.Struct("<I")
LEAD = struct.Struct("<qB")
MANIFEST = "part int, path string, records long, tokens long, bytes long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, nth long"


class DamagedFile(ValueError):
    """A frame whose length, checksum or end does not fit."""


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, FOOT.pack(masked(zlib.crc32(size))), payload, FOOT.pack(masked(zlib.crc32(payload)))))


def read_frame(stream) -> bytes | None:
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise DamagedFile("the file ends inside a frame")
    size, check = HEAD.unpack(head)
    if masked(zlib.crc32(head[:8])) != check:
        raise DamagedFile("the checksum of a length does not fit")
    body = stream.read(size + FOOT.size)
    if len(body) < size + FOOT.size:
        raise DamagedFile("the file ends inside a frame")
    payload = body[:size]
    if masked(zlib.crc32(payload)) != FOOT.unpack(body[size:])[0]:
        raise DamagedFile("the checksum of a payload does not fit")
    return payload


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return LEAD.pack(doc_id or 0, (doc_id is None) | (wide << 1)) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = LEAD.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=LEAD.size)


class UnitEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct unit once.

    The tokenizer's splitting never joins what stands on both sides of a single space or line break
    between two non-space characters: a space opens the next piece and a line break is a piece of its own.
    So a text is cut at its spaces, the units, each with its leading space, are encoded on their own, and
    repeated units come from a cache of two generations of bounded size: when the newer is full, it becomes the
    older, from which units that are met again move over. New units go through the tokenizer together, parted
    by line breaks. Texts with other runs of white space, or with the mark that opens special tokens, are
    encoded whole.
    """

    def __init__(self, path: str, end_id: int, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = max(self.tokenizer.get_vocab_size(), end_id + 1) > 65_536
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.end = self.dtype.type(end_id).tobytes()
        self.line = self.whole("\n")
        self.tails = {c: self.whole(c) for c in ",."}
        self.most = most
        self.units: dict[str, bytes | None] = {}  # keys stand after a space
        self.older: dict[str, bytes | None] = {}  # units that are dropped unless they are met again
        self.firsts: dict[str, bytes | None] = {}  # keys stand at the start of a text or line

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode_new(self, words: list[str], lead: str, step: int = 100) -> list[bytes]:
        groups = [words[i : i + step] for i in range(0, len(words), step)]
        found = self.tokenizer.encode_batch_fast(
            ["\n".join([lead + w for w in g]) for g in groups], add_special_tokens=False
        )
        line, n, out = np.frombuffer(self.line, self.dtype)[0], self.dtype.itemsize, []
        for group, e in zip(groups, found):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == line)
            if len(cuts) != len(group) - 1:
                out += [self.whole(lead + w) for w in group]
                continue
            raw = ids.tobytes()
            out += [raw[n * x : n * y] for x, y in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]
        return out

    def _learn(self, known: dict, parts: set[str], lead: str) -> None:
        new = parts.difference(known)
        plain, broken, tailed = set(), [], []
        for p in new:
            if p.isalpha():
                plain.add(p)
            elif not p or p[0].isspace() or p[-1].isspace() or "<|" in p:
                known[p] = None
            elif "\n" in p:
                broken.append((p, p.split("\n")))
            elif p[-1] in self.tails and p[:-1].isalpha():
                tailed.append(p)
            else:
                plain.add(p)
        plain.update(p[:-1] for p in tailed if p[:-1] not in known)
        if broken:
            self._learn(known, {s[0] for _, s in broken}, lead)
            self._learn(self.firsts, {w for _, s in broken for w in s[1:]}, "")
        words = list(plain)
        known.update(zip(words, self._encode_new(words, lead)))
        for p in tailed:
            known[p] = known[p[:-1]] + self.tails[p[-1]]
        for p, (first, *rest) in broken:
            ids = [known[first], *(self.firsts[w] for w in rest)]
            known[p] = None if None in ids else self.line.join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        if len(self.units) > self.most:
            self.units, self.older = {}, self.units
        if len(self.firsts) > self.most // 8:
            self.firsts.clear()
        split = [t.split(" ") for t in texts]
        self._learn(self.firsts, {s[0] for s in split}, "")
        parts = set().union(*split).difference(self.units)
        if self.older:
            again = parts.intersection(self.older)
            self.units.update(zip(again, map(self.older.__getitem__, again)))
            parts -= again
        self._learn(self.units, parts, " ")
        of, out = self.units.__getitem__, []
        for text, parts in zip(texts, split):
            ids = list(map(of, parts))
            ids[0] = self.firsts[parts[0]]
            ids.append(self.end)
            try:
                out.append(b"".join(ids))
            except TypeError:  # a unit that has to be encoded in its text
                out.append(self.whole(text) + self.end)
        return out


def encoder(path: str, end_id: int) -> UnitEncoder:
    """One encoder for each Python worker."""
    return worker.kept("tokens", (path, end_id), lambda: UnitEncoder(path, end_id))


def open_store(path: str):
    """(file system, path on it) of a URI, for local and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text) below ``folder``; one manifest row for each file.

    Rows are in ascending doc_id, nulls first, equal ids by text. Null text is empty: only the end id.
    Every row is a record, also a repeated one. The result is written already; an empty table gives no row.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer_path, end_id)
        part = TaskContext.get().partitionId()
        store, root = open_store(folder)
        name, own = f"{root}/part-{part:06d}", uuid.uuid4().hex
        store.create_dir(root, recursive=True)
        offsets, place, tokens = [], 0, 0
        with store.open_output_stream(f"{name}.{own}") as out:
            for batch in batches:
                for at in range(0, len(batch), 500):
                    rows = batch.iloc[at : at + 500]
                    texts = ["" if t is None else t for t in rows["text"]]
                    for i, ids in zip(rows["doc_id"], coder.encode(texts)):
                        body = frame(pack(None if pd.isna(i) else int(i), ids, coder.wide))
                        out.write(body)
                        offsets.append(place)
                        place += len(body)
                        tokens += len(ids) // coder.dtype.itemsize
        if not offsets:
            store.delete_file(f"{name}.{own}")
            return
        with store.open_output_stream(f"{name}.idx.{own}") as out:
            out.write(np.array(offsets, "<i8").tobytes())
        store.move(f"{name}.idx.{own}", f"{name}.idx")
        store.move(f"{name}.{own}", f"{name}.bin")
        yield pd.DataFrame(
            {"part": [part], "path": [f"{folder}/part-{part:06d}"], "records": [len(offsets)], "tokens": [tokens], "bytes": [place]}
        )

    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return settle(dealt.mapInPandas(write, MANIFEST), "token-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: a row for each record, every checksum verified.

    Columns: doc_id, start (tokens of all records before it), n_tokens (with the end id), ids_crc32 (of
    the ids as four-byte little-endian integers), part, nth (place in its file).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, path, records, earlier in zip(batch["part"], batch["path"], batch["records"], batch["earlier"]):
                store, name = open_store(path)
                rows, start, nth = [], int(earlier), 0
                with store.open_input_stream(f"{name}.bin", buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), part, nth))
                        start, nth = start + len(ids), nth + 1
                        if len(rows) == 5000:
                            yield _frame(rows)
                            rows = []
                if nth != records:
                    raise DamagedFile(f"{path}: {nth} records, {records} in the manifest")
                yield _frame(rows)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("earlier")
    files = manifest.select("part", "path", "records", earlier)
    # A number of partitions keeps adaptive execution from merging the small rows that stand for large files.
    return files.repartitionByRange(max(1, manifest.count()), "part").mapInPandas(read, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "part", "nth"])
    return out.astype({"doc_id": "Int64"})


def read_at(path: str, nth: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in a file, through the index alone."""
    store, name = open_store(path)
    with store.open_input_file(f"{name}.idx") as index:
        index.seek(8 * nth)
        at = int.from_bytes(index.read(8), "little")
    with store.open_input_file(f"{name}.bin") as data:
        data.seek(at)
        return unpack(read_frame(data))


def token_folder(spark: SparkSession) -> str:
    """A new shared folder, as a full URI, so that tasks resolve it as Spark does."""
    return settle_uri(spark, shared_folder(spark, "tokens"))


def settle_uri(spark: SparkSession, folder: str) -> str:
    if "://" in folder or folder.startswith("file:"):
        return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and "://" not in folder else folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return settle_uri(spark, full)
