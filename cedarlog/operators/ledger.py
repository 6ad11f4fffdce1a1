"""A table that takes each batch of a stream once, with a ledger that is committed with the data.

A micro-batch is written to a folder of its own that nobody reads, then an entry for (run, micro-batch) is renamed into the
ledger; the rename is the commit. Readers read the folders that the ledger names. A stream that is stopped before the
commit leaves a folder without an entry, and writes it anew when it runs again; one that is stopped after it finds the
entry and writes nothing. Batches known by their flush_id from an earlier run (one that lost its checkpoint, say) are left out.

As each micro-batch has a folder, ``compact`` writes the rows of small folders into one and renames a base into place: the
folders that count from then on, and the micro-batches they stand for. Full folders are kept as they are, so what a call
rewrites is bounded however large the table is. A compaction that is stopped before its rename has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sinks import BaseHandler, aggregate_rows


class Ledger:
    """The folder ``path``: data/<uuid> for what is written, ledger/<run>-<batch>.json for what is committed, and
    bases/<number>.json for what has been compacted, of which the last one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("ledger", "bases"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def base(self) -> dict:
        """The last compaction: its number, its folders with their bytes, and ranges of micro-batches by run."""
        names = [n for n in self._names("bases") if n.endswith(".json")]
        return json.loads(self.spark.read.text(f"{self.root}/bases/{names[-1]}").first()[0]) if names else {"number": 0, "folders": [], "ranges": {}}

    def _open(self) -> tuple[dict, dict[str, dict]]:
        """The base and the entries beside it. Entries are listed first: a base that comes between then holds their rows."""
        paths = [f"{self.root}/ledger/{n}" for n in self._names("ledger") if n.endswith(".json")]
        found = [json.loads(r[0]) for r in self.spark.read.text(paths).collect()] if paths else []
        base = self.base()
        return base, {f"{e['run']}-{e['batch']}": e for e in found if not _covers(base, e["run"], e["batch"])}

    def entries(self) -> dict[str, dict]:
        """Committed entries by name that are not in the base, as they were written: a short line each."""
        return self._open()[1]

    def committed(self, run: str, batch: int) -> bool:
        return self._fs.exists(self._path(f"{self.root}/ledger/{run}-{batch}.json")) or _covers(self.base(), run, batch)

    def read(self) -> DataFrame | None:
        """All committed rows, or None before the first commit."""
        base, entries = self._open()
        folders = [f"{self.root}/data/{f}" for f in [name for name, _ in base["folders"]] + [e["folder"] for e in entries.values()]]
        return self.spark.read.parquet(*folders) if folders else None

    def write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{folder}")
        return folder

    def commit(self, run: str, batch: int, folder: str) -> None:
        """The entry appears as a whole or not at all; a second one of the same name is refused."""
        if _covers(self.base(), run, batch):
            raise FileExistsError(f"{run}-{batch} is committed already")
        self._publish(f"ledger/{run}-{batch}.json", {"folder": folder, "run": run, "batch": batch})

    def _publish(self, name: str, what: dict) -> None:
        target, part = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name.split('/')[0]}/_{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise FileExistsError(f"{name} is there already")

    def compact(self, full_bytes: int = 64 << 30, file_bytes: int = 256 << 20) -> int:
        """Merges folders of fewer than ``full_bytes`` into one, in files of about ``file_bytes``; streams may go on
        meanwhile, their commits stay beside the base. Returns how many folders were merged; of none or one, nothing is
        written unless entries have to move into the base. Of two calls at once, one fails and changes nothing."""
        base, entries = self._open()
        if not entries:
            return 0
        sizes = dict(base["folders"]) | {e["folder"]: self._bytes(e["folder"]) for e in entries.values()}
        small = [f for f, n in sizes.items() if n < full_bytes]
        kept = [[f, n] for f, n in sizes.items() if n >= full_bytes or len(small) < 2]
        if len(small) > 1:
            files = max(1, -(-sum(sizes[f] for f in small) // file_bytes))
            folder = self.write(self.spark.read.parquet(*(f"{self.root}/data/{f}" for f in small)).coalesce(files))
            kept.append([folder, self._bytes(folder)])
        ranges = {run: _merged(base["ranges"].get(run, []), [e["batch"] for e in entries.values() if e["run"] == run]) for run in {*base["ranges"], *(e["run"] for e in entries.values())}}
        self._publish(f"bases/{base['number'] + 1:010d}.json", {"number": base["number"] + 1, "folders": kept, "ranges": ranges})
        return len(small) if len(small) > 1 else 0

    def _bytes(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.root}/data/{folder}")).getLength()

    def clean(self) -> int:
        """Deletes folders that neither the base nor an entry names, entries that are in the base, and earlier bases; only
        while nothing writes or reads. Returns how many folders."""
        base, entries = self._open()
        for name in self._names("ledger"):
            if name.removesuffix(".json") not in entries:
                self._fs.delete(self._path(f"{self.root}/ledger/{name}"), False)
        for name in self._names("bases"):
            if name != f"{base['number']:010d}.json":
                self._fs.delete(self._path(f"{self.root}/bases/{name}"), False)
        known = {f for f, _ in base["folders"]} | {e["folder"] for e in entries.values()}
        gone = [f for f in self._names("data") if f not in known]
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
        return len(gone)


def _covers(base: dict, run: str, batch: int) -> bool:
    return any(first <= batch <= last for first, last in base["ranges"].get(run, ()))


def _merged(ranges: list, batches: list[int]) -> list[list[int]]:
    """Ranges [first, last] with more numbers, joined where they touch: one range for a stream, however long it runs."""
    out: list[list[int]] = []
    for first, last in sorted([*map(list, ranges), *([b, b] for b in batches)]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


class LedgerHandler(BaseHandler):
    """Batches of a stream to a ``Ledger``: the rows of ``aggregate_rows`` and the flush_id that tells them apart.

    run: names the stream whose micro-batch numbers count; it lives as long as its checkpoint. known: whether flush_ids of
    other runs are left out, for which their column of the whole table is read."""

    def __init__(self, ledger: Ledger, run: str, known: bool = True, keep: Callable[[DataFrame], DataFrame] | None = None):
        super().__init__()
        self.ledger, self.run, self.known = ledger, run, known
        self.keep = keep or (lambda batches: aggregate_rows(batches, also=("flush_id",)))

    def flush_batch(self, batches: DataFrame, batch: int) -> bool:
        """Writes and commits a micro-batch; false if it is committed already."""
        if self.ledger.committed(self.run, batch):
            return False
        new = batches.dropDuplicates(["flush_id"])
        if self.known and (before := self.ledger.read()) is not None:
            new = new.join(before.select("flush_id"), "flush_id", "left_anti")
        self.ledger.commit(self.run, batch, self.ledger.write(self.keep(new)))
        return True

    def __call__(self, batches: DataFrame, batch: int) -> None:
        """For writeStream.foreachBatch."""
        self.before()
        try:
            self.flush_batch(batches, batch)
        except Exception as e:
            self.on_error(e)
            raise
        finally:
            self.after()
