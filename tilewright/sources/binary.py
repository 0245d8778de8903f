"""Python data sources for the binary formats: ``featureblocks`` (read, write) and ``osmpbf`` (read).

Both cut files into runs of whole blocks: the driver reads just the block
headers, every task its own range.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tilewright.kernels import blocks, osm
from tilewright.types import FEATURE_DDL

#: Bytes of whole blocks that one task reads.
RANGE_BYTES = 64 << 20
OSM_DDL = {
    "node": "id bigint, lat double, lon double, tags map<string,string>",
    "way": "id bigint, node_ids array<bigint>, tags map<string,string>",
    "relation": "id bigint, members array<struct<id:bigint,type:string,role:string>>, tags map<string,string>",
}


def file_system(path: str):
    """File system and the path in it, of a local path or a URI."""
    from pyarrow import fs

    if path.startswith("file:/") and "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def list_files(path: str, suffixes: tuple[str, ...] = ()) -> list[str]:
    """The file, or the files under the folder (sorted, hidden ones left out)."""
    from pyarrow import fs

    where, root = file_system(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f.path for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    visible = [p for p in found if not posixpath.basename(p).startswith((".", "_")) and (not suffixes or p.lower().endswith(suffixes))]
    prefix = path[: path.rindex(root)] if "://" in path and root in path else ""  # scheme and host
    return [prefix + p for p in sorted(visible)]


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.lenient = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"

    def partitions(self) -> list[Range]:
        out = []
        for path in list_files(self.path):
            where, p = file_system(path)
            with where.open_input_file(p) as f:
                total = f.size()
                try:
                    blocks.check_header(f.read(8))
                except ValueError:
                    if not self.lenient:
                        raise
                    continue
                if total <= self.size:
                    out.append(Range(path, 8, total))
                    continue
                begin = at = 8
                while at < total:
                    f.seek(at)
                    at += blocks.HEAD.size + blocks.read_head(f.read(blocks.HEAD.size))
                    if at - begin >= self.size:
                        out.append(Range(path, begin, min(at, total)))
                        begin = at
                if begin < total:
                    out.append(Range(path, begin, total))
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        where, p = file_system(partition.path)
        with where.open_input_file(p) as f:
            at = partition.begin
            try:
                while at < partition.end:
                    f.seek(at)
                    size = blocks.read_head(f.read(blocks.HEAD.size))
                    body = f.read(size)
                    if len(body) < size:
                        raise ValueError("block ends early")
                    for typ, rings, props, srid in blocks.read_body(body):
                        yield (typ, rings), props, srid
                    at += blocks.HEAD.size + size
            except ValueError:
                if not self.lenient:
                    raise


@dataclass
class Written(WriterCommitMessage):
    path: str


class BlockWriter(DataSourceWriter):
    """One file per task; a task's file gets its name when the job commits."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.per_block = int(options.get("blockfeatures", blocks.FEATURES_PER_BLOCK))

    def write(self, iterator: Iterator) -> Written:
        where, root = file_system(self.path)
        where.create_dir(root, recursive=True)
        name = posixpath.join(root, f".part-{uuid.uuid4().hex}")
        with where.open_output_stream(name) as f:
            f.write(blocks.header())
            queue: list[tuple] = []
            srid: str | None = None
            for row in iterator:
                own = row["srid"]
                if queue and (own != srid or len(queue) >= self.per_block):
                    f.write(blocks.block(queue, srid))
                    queue = []
                srid = own
                g, props = row["geom"], row["props"] or {}
                if g is None:
                    raise ValueError("a feature without geometry cannot be stored")
                queue.append((g["typ"], [[(v["x"], v["y"]) for v in r] for r in g["rings"]], {k: tuple(v) for k, v in props.items()}))
            f.write(blocks.block(queue, srid))
        return Written(name)

    def commit(self, messages: list) -> None:
        where, root = file_system(self.path)
        if self.overwrite:
            for old in list_files(self.path):
                where.delete_file(file_system(old)[1])
        for i, m in enumerate(m for m in messages if m is not None):
            where.move(m.path, posixpath.join(root, f"part-{i:05d}-{uuid.uuid4().hex[:8]}.blocks"))

    def abort(self, messages: list) -> None:
        where, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.path)


class FeatureBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "featureblocks"

    def schema(self) -> str:
        return FEATURE_DDL

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options, overwrite)


class OsmReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "node")
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in list_files(self.path):
            where, p = file_system(path)
            with where.open_input_file(p) as f:
                total, begin, at = f.size(), 0, 0
                while at < total:
                    f.seek(at)
                    n = int.from_bytes(f.read(4), "big")
                    _, size = osm.blob_header(f.read(n))
                    at += 4 + n + size
                    if at - begin >= self.size or at >= total:
                        out.append(Range(path, begin, at))
                        begin = at
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        where, p = file_system(partition.path)
        with where.open_input_file(p) as f:
            at = partition.begin
            while at < partition.end:
                f.seek(at)
                n = int.from_bytes(f.read(4), "big")
                name, size = osm.blob_header(f.read(n))
                if name == "OSMData":
                    yield from osm.elements(osm.blob_data(f.read(size)), self.kind)
                at += 4 + n + size


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return OSM_DDL[self.options.get("kind", "node")]

    def reader(self, schema) -> OsmReader:
        return OsmReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatureBlocks)
    spark.dataSource.register(OsmPbf)
