"""Token ids packed into rows of a fixed length.

Each document is encoded whole and ended by one end-of-text id. What is longer than a
row is split into full rows and a rest; nothing is dropped. Pieces are placed by
best-fit decreasing: longest first, each into the open row with the least room that
still holds it, found by a descent in a segment tree over the room left.

Tasks pack what they read, in blocks of a bounded number of tokens, so no shuffle and
no unbounded buffer is needed; a very long text is held once, as any row is. A task
that runs again gives the same rows.

A result row holds shard (the task's partition), block, row, n_tokens, `ids` (the row
of the id matrix, little-endian 16-bit, or 32-bit for larger vocabularies, padded
with the end id), `cu_seqlens` (cumulative segment lengths from 0), `position_resets`
(where positions start again at 0), and for each segment its doc_id (of the input's
own type), `copies` (the document's number within the shard, so that repeated rows
and ids stay apart) and the piece's first token in the document. Null or empty texts
become a single end id. A null doc_id stays null. Other columns are ignored. An empty
input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import sliced, text_of
from bramble.llm.tokens import END, VOCABULARY, encoder, model, read_vocabulary

ROW, BLOCK = 2048, 4_000_000


class Rooms:
    """Open rows by the room they have left; a segment tree counts them and finds the least room that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the least room of at least `least`, taken out."""
        node, count = least + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first subtree to the right that holds any
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of indices into lengths, each length at most row."""
    rooms, rows = Rooms(row), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = rooms.take(n)
        if found is None:
            rows.append([i])
            rooms.put(row - n, len(rows) - 1)
        else:
            room, at = found
            rows[at].append(i)
            rooms.put(room - n, at)
    return rows


def pack(docs: DataFrame, row: int = ROW, vocabulary: str = VOCABULARY, end: int = END, block: int = BLOCK) -> DataFrame:
    """The packed rows of all documents."""
    data = read_vocabulary(vocabulary)
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")

    def flush(shard: int, number: int, pieces: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        fields = [("shard", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(id_type)), ("copies", pa.list_(pa.int64())), ("piece_starts", pa.list_(pa.int64()))]
        rows = best_fit_decreasing([len(p[3]) for p in pieces], row)
        for at in range(0, len(rows), 512):
            out = []
            for k, members in enumerate(rows[at : at + 512], at):
                ends = np.cumsum([0, *(len(pieces[i][3]) for i in members)]).tolist()
                ids = np.full(row, end, kind)
                ids[: ends[-1]] = np.concatenate([pieces[i][3] for i in members])
                said = {name: [pieces[i][j] for i in members] for j, name in enumerate(("doc_ids", "copies", "piece_starts"))}
                out.append({"shard": shard, "block": number, "row": k, "n_tokens": ends[-1], "ids": ids.tobytes(), "cu_seqlens": ends, "position_resets": ends[:-1], **said})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(data), TaskContext.get().partitionId()
        number, held, copy, pieces, id_type = 0, 0, 0, [], None
        for b in sliced(batches):
            ids, id_type = b.column(0).to_pylist(), b.schema.field(0).type
            for k in range(b.num_rows):
                found = np.array([*encode(b.column(1)[k].as_py()), end], dtype=kind)
                for start in range(0, len(found), row):
                    pieces.append((ids[k], copy, start, found[start : start + row]))
                    held += len(pieces[-1][3])
                    if held >= block:
                        yield from flush(shard, number, pieces, id_type)
                        number, held, pieces = number + 1, 0, []
                copy += 1
        if pieces:
            yield from flush(shard, number, pieces, id_type)

    said = docs.schema["doc_id"].dataType.simpleString()
    schema = f"shard int, block int, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{said}>, copies array<bigint>, piece_starts array<bigint>"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def unpack(packed: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id and text again, a row for each document that was packed, repeated ones too."""
    data = read_vocabulary(vocabulary)
    kind = "<u2" if end < 1 << 16 else "<u4"
    segments = packed.select("shard", "ids", F.explode(F.arrays_zip("doc_ids", "copies", "piece_starts", "position_resets", F.slice("cu_seqlens", F.lit(2), F.size("cu_seqlens") - 1).alias("ends"))).alias("s"))
    width = np.dtype(kind).itemsize
    part = F.substring(F.col("ids"), F.col("s.position_resets") * width + 1, (F.col("s.ends") - F.col("s.position_resets")) * width)
    pieces = segments.select("shard", F.col("s.copies").alias("copy"), F.col("s.doc_ids").alias("doc_id"), F.struct(F.col("s.piece_starts").alias("start"), part.alias("part")).alias("p"))
    joined = pieces.groupBy("shard", "copy").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("p")).alias("parts")).select("doc_id", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model(data).decode
        for b in batches:
            texts = [decode(np.frombuffer(b"".join(p["part"] for p in parts), kind)[:-1].tolist()) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, text string")
