"""Bounded-space online packing of token ids into training sequences.

Each task reads its documents as a stream and keeps a fixed number of open windows. A document is cut into full windows
and a rest; the rest goes to the open window in which it leaves the least room (best fit). If none has room and all are
open, the fullest is emitted. What is open at the end of a task is merged with the leftovers of other tasks.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_back, materialize

WINDOW = 2048
END = 1
OPEN = 64
#: Tasks whose leftovers are merged together: at most OPEN * MERGED windows of WINDOW ids in one group.
MERGED = 8
#: Document ids are strings in Python, where a column of numbers with a null would be one of doubles.
PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPENED = PIECE + ", task int, ids binary"


def _file(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _encoder(vocabulary: str, ranks: str | None):
    """A function from a text to its ids as a numpy array, without special tokens added.

    With ``ranks`` (the same byte-level vocabulary as merge ranks) the ids come from the faster of the two libraries;
    a text that holds a special token's string, which only the vocabulary file knows, is always encoded from that file.
    Names without a folder are those of public vocabularies and are found where the task runs."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(_file(vocabulary))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def plain(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if not ranks:
        return plain
    import public_tokenizers
    import tiktoken

    with open(_file(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        return plain(text) if any(s in text for s in special) else fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    return encode


class _Packer:
    """Open windows by the room that is left in them."""

    def __init__(self, window: int, most_open: int, number):
        self.window, self.most_open, self.number = window, most_open, number
        self.rooms: list[tuple[int, int]] = []  # (room, key), sorted
        self.held: dict[int, list[tuple]] = {}
        self.next = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        sequence, offset = self.number(), 0
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset))
            offset += len(ids)

    def add(self, doc, ids: np.ndarray) -> None:
        n, rest = len(ids), len(ids) - len(ids) % self.window
        for at in range(0, rest, self.window):
            self.emit([(doc, at, ids[at : at + self.window], n)])
        if rest < n:
            self.place((doc, rest, ids[rest:], n))

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, key = self.rooms.pop(at)
            self.held[key].append(piece)
        else:
            if len(self.rooms) >= self.most_open:
                self.emit(self.held.pop(self.rooms.pop(0)[1]))
            room, key = self.window, self.next
            self.next += 1
            self.held[key] = [piece]
        if room == size:
            self.emit(self.held.pop(key))
        else:
            insort(self.rooms, (room - size, key))

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _frame(rows: list[tuple], task: int | None = None) -> pd.DataFrame:
    names = [x.split()[0] for x in PIECE.split(", ")]
    frame = pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype="object" if name == "doc_id" else "int64") for i, name in enumerate(names)})
    return frame if task is None else frame.assign(task=np.int32(task), ids=None)


def _numbers(task: int):
    count = iter(range(1 << 32))
    return lambda: (task << 32) | next(count)


def _pack(vocabulary: str, ranks: str | None, end: int, window: int, most_open: int):
    def run(batches):
        encode, task = _encoder(vocabulary, ranks), TaskContext.get().partitionId()
        packer = _Packer(window, most_open, _numbers(task))
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                packer.add(doc, np.append(encode(text or ""), np.uint32(end)).astype("<u4"))
                if len(packer.out) > 20_000:
                    yield _frame(packer.taken(), task)
        yield _frame(packer.taken(), task)
        left = [p for pieces in packer.held.values() for p in pieces]
        yield pd.DataFrame(
            {
                "doc_id": pd.Series([p[0] for p in left], dtype="object"), "start": [p[1] for p in left], "length": [len(p[2]) for p in left], "ids_crc32": 0,
                "doc_tokens": [p[3] for p in left], "sequence_id": -1, "offset": 0, "task": task, "ids": [p[2].tobytes() for p in left],
            }
        )

    return run


def _merge(window: int):
    """Joins the pieces that were left open into full windows, cut where one is full; one window of a group stays short."""

    def run(key, left: pd.DataFrame) -> pd.DataFrame:
        packer = _Packer(window, 1, _numbers((1 << 30) | int(key[0])))
        left = left.sort_values(["task", "doc_id", "start"], kind="stable")
        pieces, room = [], window
        for doc, start, n, ids in zip(left["doc_id"], left["start"], left["doc_tokens"], left["ids"], strict=True):
            ids = np.frombuffer(ids, dtype="<u4")
            while len(ids):
                pieces.append((doc, start, ids[:room], n))
                start, ids, room = start + len(pieces[-1][2]), ids[room:], room - len(pieces[-1][2])
                if not room:
                    packer.emit(pieces)
                    pieces, room = [], window
        if pieces:
            packer.emit(pieces)
        return _frame(packer.taken())

    return run


def pack(documents: DataFrame, vocabulary: str, ranks: str | None = None, end: int = END, window: int = WINDOW, most_open: int = OPEN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of a document.

    Null and empty texts are the single id ``end``; null ids are kept; repeated rows are packed as often as they occur;
    other columns are not read; an empty table gives no piece. Every id lies in one piece, and pieces fill a sequence
    without gaps from 0. Sequences hold ``window`` ids at most; a task keeps ``most_open`` windows, whatever it reads,
    and leftovers (only these carry ids through a shuffle) are merged in groups of MERGED tasks."""
    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialize(rows.mapInPandas(_pack(vocabulary, ranks, end, window, most_open), OPENED), "packed")
    done = packed.filter("sequence_id >= 0").drop("task", "ids")
    left = packed.filter("sequence_id < 0").withColumn("merge", F.floor(F.col("task") / MERGED).cast("int"))
    return ids_back(done.unionByName(left.groupBy("merge").applyInPandas(_merge(window), PIECE)), "doc_id")
