"""Folders of source code as tables: a data source that lists the files of many trees, and a reader of their contents.

The listing is metadata alone: ignored folders are never entered, names that begin with a dot are seen, links are not followed. A
tree's first level is dealt out by hash of the folders' names over a few slices for every core, each of which lists the root for itself
and walks its share: their number does not grow with the folders. Contents are read afterwards, from the rows
of the listing that are wanted, in as many tasks as their bytes ask for; as no wanted file is larger than the audit's limit, a spread by
hash of the path splits by size as well. A task that is lost lists or reads its part again.

Defined results: a root that does not exist is an error; an empty folder gives no rows; a folder whose reading is forbidden is passed
over; bytes that are no UTF-8 become replacement characters; a file that goes between listing and reading is an error.
"""

from __future__ import annotations

import json
import os
import posixpath
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Kinds of files that are read, a name without kind that is, and folders that are not entered.
EXTENSIONS = ("php", "ts", "tsx", "js", "jsx", "mjs", "cjs", "html", "htm", "css", "scss", "json")
NAMES = (".htaccess",)
IGNORED = ("vendor", "node_modules", ".git", "dist", "build", ".next", "upload", "uploads", ".phpunit.cache", "arsiv")

LISTED = "client string, run_id int, root string, rel_path string, length long"
PART_BYTES = 64 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def readable(name: str) -> bool:
    return name in NAMES or posixpath.splitext(name)[1].lower().lstrip(".") in EXTENSIONS


def _opened(root: str):
    """The file system of a root and the root's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root.rstrip("/"))


def _entries(files, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Folders to enter and (path, length) of readable files directly below a folder, in order of name."""
    from pyarrow import fs

    try:
        found = files.get_file_info(fs.FileSelector(folder))
    except PermissionError:
        return [], []
    if isinstance(files, fs.LocalFileSystem):
        found = [x for x in found if not os.path.islink(x.path)]
    found.sort(key=lambda x: x.base_name)
    folders = [x.path for x in found if x.type == fs.FileType.Directory and x.base_name not in IGNORED]
    return folders, [(x.path, x.size) for x in found if x.type == fs.FileType.File and readable(x.base_name)]


class Slice(InputPartition):
    """The folders of a tree's first level whose names fall to ``nr`` of ``of``, with all below them; the first one has the root's own files."""

    def __init__(self, client: str, run_id: int, root: str, nr: int, of: int):
        self.client, self.run_id, self.root, self.nr, self.of = client, run_id, root, nr, of


class TreeReader(DataSourceReader):
    def __init__(self, trees: list[dict], slices: int):
        self.trees, self.slices = trees, slices

    def partitions(self) -> Sequence[InputPartition]:
        """As many slices for a tree of any size; the driver lists nothing."""
        return [Slice(t["client"], t["run_id"], t["root"], i, self.slices) for t in self.trees for i in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, top = _opened(partition.root)
        folders, own = _entries(files, top)
        todo = [p for p in folders if zlib.crc32(posixpath.basename(p).encode("utf-8", "surrogatepass")) % partition.of == partition.nr]
        rows = [(path[len(top) :].lstrip("/"), size) for path, size in own] if partition.nr == 0 else []
        while todo or rows:
            if todo:
                folders, found = _entries(files, todo.pop())
                todo += folders
                rows += [(path[len(top) :].lstrip("/"), size) for path, size in found]
            while len(rows) >= BATCH_ROWS or (rows and not todo):
                yield self._batch(partition, rows[:BATCH_ROWS])
                rows = rows[BATCH_ROWS:]

    @staticmethod
    def _batch(part: Slice, rows: list[tuple[str, int]]) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([part.client] * n), pa.array([part.run_id] * n, pa.int32()), pa.array([part.root] * n), pa.array([r for r, _ in rows]), pa.array([s for _, s in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["client", "run_id", "root", "rel_path", "length"])


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("trees", json)``; json: a list of client, run_id, root. Option ``slices``: tasks of a tree."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(json.loads(self.options["trees"]), int(self.options.get("slices", 1)))


def listing(spark: SparkSession, trees: dict[str, str], run_id: int = 1) -> DataFrame:
    """client, run_id, root, rel_path, length of every readable file below the roots; trees: client to root (a path or a URI)."""
    spark.dataSource.register(SourceTree)
    told = [{"client": c, "run_id": run_id, "root": r} for c, r in trees.items()]
    slices = max(4, -(-4 * spark.sparkContext.defaultParallelism // max(1, len(told))))
    return spark.read.format("source_tree").option("trees", json.dumps(told)).option("slices", slices).load()


def contents(listed: DataFrame, part_bytes: int = PART_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The listed files with ``content``. The listing is run once for the number of bytes and once to be read from."""
    total = listed.agg(F.sum("length")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        for batch in batches:
            roots, paths = batch.column("root").to_pylist(), batch.column("rel_path").to_pylist()
            texts, held, start = [], 0, 0
            for i, (root, path) in enumerate(zip(roots, paths)):
                if root not in opened:
                    opened[root] = _opened(root)
                files, top = opened[root]
                with files.open_input_stream(f"{top}/{path}") as f:
                    raw = f.read()
                texts.append(raw.decode("utf-8", "replace"))
                held += len(raw)
                if held >= batch_bytes or i + 1 == len(paths):
                    part = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "content"])
                    texts, held, start = [], 0, i + 1

    spread = listed.select("client", "run_id", "root", "rel_path", "length").repartition(max(1, -(-total // part_bytes)), "client", "rel_path")
    return spread.mapInArrow(run, LISTED + ", content string")


def land(files: DataFrame, root: str) -> None:
    """Write files (client, rel_path, content) as ``root``/client/rel_path, each by the task that holds its row; written again they are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        for batch in batches:
            for client, path, content in zip(*(batch.column(c).to_pylist() for c in ("client", "rel_path", "content"))):
                at = f"{top}/{client}/{path}"
                fs.create_dir(posixpath.dirname(at), recursive=True)
                with fs.open_output_stream(at) as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("client", "rel_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
