"""Source trees as files, on a shared file system or in any other store.

Spark's own file sources leave out names starting with ``_`` or ``.`` and follow links, so
trees are listed by a data source of their own: the driver only opens the top of the tree,
tasks walk the parts below it, and the texts are read in a second, evenly spread step.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftlake.functions.paths import language_of
from siftlake.model import DEFAULT_IGNORE

_LISTING = "file_id string, path string, ord bigint, size bigint"
_BATCH_BYTES = 32 << 20


FILE, OWN_FILES, TREE = "file", "own files", "tree"
Wanted = Callable[[str], bool]


def _share(share: int, shares: int) -> Wanted:
    """Whether a name belongs to a share; the shares of a directory are about equal and stable."""
    return lambda name: shares == 1 or zlib.crc32(os.fsencode(name)) % shares == share


class LocalStore:
    """A file system mounted on the driver and all executors. Names need not be UTF-8, and links are seen as such."""

    def __init__(self, location: str) -> None:
        self.root = location

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def is_directory(self, path: str) -> bool:
        return os.path.isdir(path)

    def children(self, directory: str, wanted: Wanted) -> Iterator[tuple[str, bool, int | None]]:
        """(path, whether a directory, size) of the directories and the wanted files right inside; links are left out."""
        try:
            with os.scandir(directory) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.path, True, None
                    elif wanted(entry.name) and entry.is_file(follow_symlinks=False):
                        yield entry.path, False, entry.stat(follow_symlinks=False).st_size
        except OSError:
            return  # an unreadable directory holds nothing

    def size(self, path: str) -> int | None:
        return os.stat(path).st_size if os.path.isfile(path) else None

    def read(self, path: str) -> bytes:
        with open(path, "rb") as file:
            return file.read()

    def write(self, path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(data)


class RemoteStore:
    """Any other store that Arrow reaches by a URI, such as HDFS or an object store. Paths keep the start of their URI."""

    def __init__(self, location: str, files: fs.FileSystem | None = None) -> None:
        self.files, inside = (files, location) if files else fs.FileSystem.from_uri(location)
        self.start = location.rstrip("/").removesuffix(inside.rstrip("/"))
        self.root = self.start + inside.rstrip("/")

    def _inside(self, path: str) -> str:
        return path.removeprefix(self.start)

    def exists(self, path: str) -> bool:
        return self.files.get_file_info(self._inside(path)).type != fs.FileType.NotFound

    def is_directory(self, path: str) -> bool:
        return self.files.get_file_info(self._inside(path)).type == fs.FileType.Directory

    def children(self, directory: str, wanted: Wanted) -> Iterator[tuple[str, bool, int | None]]:
        try:
            for info in self.files.get_file_info(fs.FileSelector(self._inside(directory))):
                if info.type == fs.FileType.Directory or wanted(info.base_name):
                    yield self.start + info.path, info.type == fs.FileType.Directory, info.size
        except OSError:
            return

    def size(self, path: str) -> int | None:
        return self.files.get_file_info(self._inside(path)).size

    def read(self, path: str) -> bytes:
        with self.files.open_input_stream(self._inside(path)) as file:
            return file.read()

    def write(self, path: str, data: bytes) -> None:
        inside = self._inside(path)
        self.files.create_dir(inside.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(inside) as file:
            file.write(data)


def store_of(location: str) -> LocalStore | RemoteStore:
    """The store of a path or URI. ``file:`` URIs and plain paths are local; an unreachable store raises."""
    scheme = re.match("([A-Za-z][A-Za-z0-9+.-]*):/", location)
    if scheme and scheme[1].lower() != "file":
        return RemoteStore(location)
    # file:/a, file:///a and file://host/a name the same path on a shared file system.
    return LocalStore(re.sub("^//[^/]*", "", location[len(scheme[1]) + 1 :]) if scheme else location.removeprefix("file:"))


class Walk(InputPartition):
    """One task's part of the listing: files, a share of those right inside a directory, or whole trees."""

    def __init__(self, number: int, entries: list[tuple[int, str, str, int, int]]):
        super().__init__(number)
        self.entries = entries


class SourceTreeReader(DataSourceReader):
    def __init__(self, options):
        self.targets = json.loads(options["targets"])
        self.ignore = set(json.loads(options["ignore"]))
        self.tasks = int(options["tasks"])

    def _children(self, store: LocalStore | RemoteStore, directory: str, wanted: Wanted) -> list[tuple[str, bool, int | None]]:
        """The directories and wanted files right inside a directory, by name."""
        named = store.children(directory, wanted)
        return sorted(child for child in named if child[0].rstrip("/").rpartition("/")[2] not in self.ignore)

    def partitions(self) -> list[Walk]:
        # A file target stands for itself, a directory for its tree, a missing target for nothing.
        stores = [store_of(target) for target in self.targets]
        found = [
            (at, store.root, TREE if store.is_directory(store.root) else FILE)
            for at, store in enumerate(stores)
            if store.exists(store.root)
        ]
        # Open the topmost directories until there are some for every task, or none is left. The
        # driver only ever keeps directories: the files inside them are left to the tasks.
        while len(found) < 2 * self.tasks:
            trees = [at for at, (_, _, kind) in enumerate(found) if kind == TREE]
            if not trees:
                break
            at = min(trees, key=lambda tree: found[tree][1].count("/"))
            target, path, _ = found[at]
            below = [(target, name, TREE) for name, _, _ in self._children(stores[target], path, lambda name: False)]
            found[at : at + 1] = [(target, path, OWN_FILES), *below]
        # With fewer directories than tasks, one may hold very many files: each is listed in shares of its names.
        shares = max(1, 2 * self.tasks // max(1, len(found)))
        entries = [(*entry, share, shares) for entry in found for share in range(shares if entry[2] == OWN_FILES else 1)]
        size = -(-len(entries) // self.tasks) or 1
        return [Walk(at // size, entries[at : at + size]) for at in range(0, len(entries), size)]

    def read(self, partition: Walk) -> Iterator[tuple]:
        number = 0
        stores: dict[int, LocalStore | RemoteStore] = {}
        for target, start, kind, share, shares in partition.entries:
            if target not in stores:
                stores[target] = store_of(self.targets[target])
            store = stores[target]
            wanted = _share(share, shares if kind == OWN_FILES else 1)
            walk = self._walk(store, start, wanted, deep=kind == TREE)
            for path, size in [(start, store.size(start))] if kind == FILE else walk:
                name = os.fsencode(path).decode("utf-8", "replace")
                yield f"{target}:{name}", name, (partition.value << 40) + number, size
                number += 1

    def _walk(
        self, store: LocalStore | RemoteStore, directory: str, wanted: Wanted, deep: bool
    ) -> Iterator[tuple[str, int | None]]:
        pending = [directory]
        while pending:
            children = self._children(store, pending.pop(), wanted)
            yield from ((path, size) for path, is_tree, size in children if not is_tree)
            if deep:
                pending += [path for path, is_tree, _ in reversed(children) if is_tree]


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _LISTING

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options)


def list_tree(
    spark: SparkSession, targets: Sequence[str], ignore: Sequence[str] = tuple(DEFAULT_IGNORE), tasks: int = 0
) -> DataFrame:
    """Every regular file below the targets, one row per target that reaches it.

    Targets are paths on a file system that the driver and all executors share, or URIs of any store that Arrow
    reaches; one it cannot reach raises.
    """
    for target in targets:
        store_of(str(target))  # a store that cannot be reached raises here, not in some task
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree")
    reader = reader.option("targets", json.dumps([str(t) for t in targets]))
    reader = reader.option("ignore", json.dumps(list(ignore)))
    return reader.option("tasks", tasks or 4 * spark.sparkContext.defaultParallelism).load()


def read_texts(listing: DataFrame) -> DataFrame:
    """Add the UTF-8 text of each listed file; NULL when unreadable or not UTF-8."""
    fields = [field for field in listing.schema if field.name != "size"]
    names = [field.name for field in fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.select(names)
            schema = named.schema.append(pa.field("text", pa.string()))
            rows, pending, stores = [], 0, {}
            for row in named.to_pylist():
                start = re.match("[A-Za-z][A-Za-z0-9+.-]*://[^/]*|", row["path"])[0]
                try:
                    if start not in stores:
                        stores[start] = store_of(row["path"])
                    row["text"] = stores[start].read(row["path"]).decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    row["text"] = None
                rows.append(row)
                pending += len(row["text"] or "")
                if pending > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, pending = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in fields) + ", text string"
    # Only names are shuffled; then every task reads an even share of the files. The number of
    # tasks is fixed, or Spark would judge by the size of the names and merge them into one.
    spark = listing.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listing.repartition(tasks, "file_id").mapInArrow(read, schema)


def source_tree(
    spark: SparkSession, targets: Sequence[str], ignore: Sequence[str] = tuple(DEFAULT_IGNORE), tasks: int = 0
) -> DataFrame:
    """All supported files below the targets, with their texts."""
    listing = list_tree(spark, targets, ignore, tasks).withColumn("language", language_of(F.col("path")))
    texts = read_texts(listing.filter(F.col("language").isNotNull()))
    return texts.select("file_id", "path", "language", "text", "ord")


def write_tree(texts: DataFrame, root: str) -> int:
    """Write each row's ``text`` as the file ``path`` below ``root``, where the tasks run; returns how many."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(root)
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                store.write(f"{store.root}/{path}", text.encode())
            yield pa.RecordBatch.from_pydict({"written": [batch.num_rows]})

    written = texts.select("path", "text").where("text is not null").mapInArrow(write, "written bigint")
    return written.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
