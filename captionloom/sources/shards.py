"""Tar shards as a Spark data source: read and write tasks take a few tars each, a large tar is a task of its own.

A sample is a key and its members by extension. The key of a member is its name up to the first
dot of the base name, the extension what follows.
"""

from __future__ import annotations

import contextlib
import io
import json
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.streaming import StreamingQuery

from captionloom.sources.paths import expand_braces, list_files, open_fs

SCHEMA = "shard string, key string, members map<string,binary>, error string"
#: Folder, beside the tars, of the lists of what each committed write made.
LISTS = "_shards"
# What counts as an image, the first that a sample has.
IMAGE_EXTENSIONS = ("jpg", "png", "jpeg")
BATCH_BYTES = 16 << 20
BATCH_SAMPLES = 1000
#: Tars are read together up to so many bytes a task; what opening one costs, in bytes.
TASK_BYTES = 64 << 20
OPEN_BYTES = 256 << 10


@dataclass
class _Tars(InputPartition):
    paths: list[str]


def _sizes(paths: list[str]) -> list[int]:
    """Bytes of each file, from one listing per folder; 0 where it is not listed."""
    listed: dict[str, dict[str, int]] = {}
    for folder in {p.rpartition("/")[0] for p in paths}:
        system, inner = open_fs(folder or "/")
        found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        listed[folder] = {f.base_name: f.size or 0 for f in found}
    return [listed[folder].get(name, 0) for folder, _, name in (p.rpartition("/") for p in paths)]


def _packed(paths: list[str], cores: int) -> list[_Tars]:
    """Tars in their order, put together so that every core has some and no task reads much more than its bytes."""
    costs = [size + OPEN_BYTES for size in _sizes(paths)]
    most = min(TASK_BYTES, sum(costs) / max(1, cores))
    tasks: list[_Tars] = []
    held = 0
    for path, cost in zip(paths, costs):
        if not tasks or held + cost > most:
            tasks.append(_Tars([]))
            held = 0
        tasks[-1].paths.append(path)
        held += cost
    return tasks


def _lists(system: fs.FileSystem, root: str) -> list[tuple[int, str]]:
    """Number and path of the list of each committed write to a folder, in the order of their numbers."""
    folder = f"{root}/{LISTS}"
    if system.get_file_info(folder).type != fs.FileType.Directory:
        return []
    paths = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".json")]
    number = lambda path: re.match(r"(\d{10})-", path.rsplit("/", 1)[-1])
    return sorted((int(m[1]) if (m := number(path)) else 0, path) for path in paths)


def _names(system: fs.FileSystem, path: str) -> list[str]:
    with system.open_input_stream(path) as stream:
        return json.loads(stream.read())


def _listed(system: fs.FileSystem, root: str) -> list[str] | None:
    """Names of the tars that committed writes to a folder have listed; None where there is no list."""
    if system.get_file_info(f"{root}/{LISTS}").type != fs.FileType.Directory:
        return None
    return sorted({name for _, path in _lists(system, root) for name in _names(system, path)})


def _put_list(system: fs.FileSystem, root: str, label: str, names: list[str]) -> None:
    """Commits tars: their list gets the next number. It is written aside first, so that nobody reads half of it."""
    system.create_dir(f"{root}/{LISTS}", recursive=True)
    before = _lists(system, root)
    final = f"{root}/{LISTS}/{before[-1][0] + 1 if before else 1:010d}-{label}.json"
    with system.open_output_stream(f"{final}.part") as out:
        out.write(json.dumps(sorted(names)).encode())
    system.move(f"{final}.part", final)


def _shard_files(pattern: str) -> list[str]:
    """The tars of a path or brace pattern. Each parent folder is listed once; a tar that is missing fails.

    In a folder written by ``write_shards`` only committed tars count: what a failed job left behind does not.
    """
    paths = expand_braces(pattern)
    if paths == [pattern] and not pattern.endswith(".tar"):
        system, inner = open_fs(pattern.rstrip("/"))
        names = _listed(system, inner)
        if names is not None:
            paths = [f"{pattern.rstrip('/')}/{n}.tar" for n in names]
        else:
            paths = list_files(pattern, ".tar")
            if not paths:
                raise ValueError(f"no shards at {pattern}")
            return paths
    by_folder: dict[str, list[str]] = {}
    for path in paths:
        by_folder.setdefault(path.rpartition("/")[0], []).append(path)
    missing = []
    for folder, wanted in by_folder.items():
        there = {f.rpartition("/")[2] for f in list_files(folder, ".tar")}
        missing += [p for p in wanted if p.rpartition("/")[2] not in there]
    if missing or not paths:
        raise ValueError(f"no shards at {', '.join(missing[:5]) or pattern} ({len(missing)} of {len(paths)} missing)")
    return paths


class _TarReading:
    """Reads a task's tars one after the other, in batches of bounded size."""

    def __init__(self, options: dict):
        self.cores = int(options.get("cores", 1))
        self.skip_bad = str(options.get("skipbad", "false")).lower() == "true"
        self.names_only = str(options.get("members", "all")).lower() == "none"

    def read(self, partition: _Tars) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from self._read_tar(path)

    def _read_tar(self, path: str) -> Iterator[pa.RecordBatch]:
        system, inner = open_fs(path)
        shard = inner.rsplit("/", 1)[-1].removesuffix(".tar")
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*[(shard, *row) for row in rows])
            kinds = (pa.string(), pa.string(), pa.map_(pa.string(), pa.binary()), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "key", "members", "error"])

        with system.open_input_file(inner) as stream:
            for key, members, error in _samples(stream, not self.names_only):
                if error is not None and not self.skip_bad:
                    raise tarfile.ReadError(f"{path}: {error}")
                rows.append((key, members, error))
                size += sum(len(data) for _, data in members or ())
                if size >= BATCH_BYTES or len(rows) >= BATCH_SAMPLES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class _ShardReader(_TarReading, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.paths = _shard_files(options["path"])

    def partitions(self):
        return _packed(self.paths, self.cores)


class _ShardFollower(_TarReading, DataSourceStreamReader):
    """A folder's committed lists as a stream: an offset is the number of the last list and how many there are up to it.

    Numbers rise by commit, so each list falls into one micro-batch. A list that turns up behind the offset (two
    writers at once) or is gone (the folder was overwritten) shows in the count, and fails the stream.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.root = options["path"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"number": -1, "lists": 0}

    def latestOffset(self) -> dict:
        lists = _lists(*open_fs(self.root))
        return {"number": lists[-1][0] if lists else -1, "lists": len(lists)}

    def partitions(self, start: dict, end: dict) -> list[_Tars]:
        system, root = open_fs(self.root)
        lists = _lists(system, root)
        for offset in (start, end):
            there = sum(number <= offset["number"] for number, _ in lists)
            if there != offset["lists"]:
                raise RuntimeError(f"{self.root} has {there} committed lists up to number {offset['number']}, not {offset['lists']} as before")
        new = [path for number, path in lists if start["number"] < number <= end["number"]]
        return _packed([f"{self.root}/{name}.tar" for path in new for name in _names(system, path)], self.cores)


def _is_blank(stream, start: int, end: int) -> bool:
    """Whether a stretch of a file holds nothing but zeros, as between and behind the members of a tar."""
    stream.seek(start)
    while start < end:
        part = stream.read(min(BATCH_BYTES, end - start))
        if not part or part.count(0) < len(part):
            return not part
        start += len(part)
    return True


def _members(stream, data: bool) -> Iterator[tuple[tarfile.TarInfo | None, bytes, tuple[int, int] | None]]:
    """The files of a tar and, where something else stands between them, the range of bytes that is lost.

    Behind damage the reader goes on at the next block of 512 bytes whose header has the right checksum. A tar ends with
    zeros: one that does not has been cut off.
    """
    block = tarfile.BLOCKSIZE
    size = stream.seek(0, io.SEEK_END)
    stream.seek(0)
    expected = 0  # where the next header should be
    with contextlib.ExitStack() as stack:
        try:
            tar = stack.enter_context(tarfile.open(fileobj=stream, mode="r:", ignore_zeros=True))
        except tarfile.TarError:  # less than a header
            yield None, b"", (0, size)
            return
        while True:
            try:
                info = tar.next()
            except tarfile.TarError:  # a header that speaks of another one, which is not there
                tar.offset += block
                if tar.offset >= size:
                    break
                continue
            if info is None:
                break
            tar.members.clear()
            length = info.size if info.isfile() else 0
            if info.offset_data + length > size:  # cut off, or no header but by chance
                tar.offset = info.offset + block
                continue
            if info.offset > expected and not _is_blank(stream, expected, info.offset):
                yield None, b"", (expected, info.offset)
            expected = info.offset_data + -(-length // block) * block
            if info.isfile():
                yield info, tar.extractfile(info).read() if data else b"", None
        if expected + block > size:
            yield None, b"", (min(expected, size), max(expected, size))
        elif not _is_blank(stream, expected, size):
            yield None, b"", (expected, size)


def _samples(stream, data: bool) -> Iterator[tuple[str | None, list[tuple[str, bytes]] | None, str | None]]:
    """``key, members, error`` of a tar: samples, and a row without a key for each range of bytes that is lost.

    A sample beside a gap may have lost members to it. It is kept if it has the extensions of an undisturbed sample
    of the tar, and counted as lost, with its key, if not.
    """
    usual: set[frozenset[str]] = set()
    beside: list[tuple[str, list[tuple[str, bytes]]]] = []
    key, members, hurt = None, [], False
    for info, content, gap in _members(stream, data):
        if gap is not None:
            yield None, None, f"bytes {gap[0]} to {gap[1]} are missing or no part of a tar"
            hurt = True
            if key is not None:
                beside.append((key, members))
            key, members = None, []
            continue
        folder, _, base = info.name.rpartition("/")
        stem, _, ext = base.partition(".")
        name = f"{folder}/{stem}" if folder else stem
        if name != key:
            if key is not None:
                if hurt:
                    beside.append((key, members))
                else:
                    usual.add(frozenset(e for e, _ in members))
                    yield key, members, None
                hurt = False
            key, members = name, []
        members.append((ext.lower(), content))
    if key is not None:
        if not hurt:
            usual.add(frozenset(e for e, _ in members))
            yield key, members, None
        else:
            beside.append((key, members))
    # The two sides of a gap may be parts of one sample.
    for i, (name, parts) in enumerate(beside):
        if i and beside[i - 1][0] == name:
            continue
        if i + 1 < len(beside) and beside[i + 1][0] == name:
            parts = [*parts, *beside[i + 1][1]]
        if frozenset(e for e, _ in parts) in usual or not usual:
            yield name, parts, None
        else:
            yield None, None, f"sample {name} has lost members"


@dataclass
class _Written(WriterCommitMessage):
    names: list
    query: str = ""


class _TarOut:
    """Tars of one task: each is written under a name of its own, and gets its final name when it is whole."""

    def __init__(self, system: fs.FileSystem, root: str, staging: str):
        self.system, self.root, self.staging = system, root, staging
        self.attempt = uuid.uuid4().hex
        self.names: list[str] = []
        self.shard = self.tar = self.stream = self.part = None
        system.create_dir(staging, recursive=True)

    def begin(self, shard: str) -> None:
        self.close()
        self.shard = shard
        self.part = f"{self.staging}/{shard}-{self.attempt}.part"
        self.stream = self.system.open_output_stream(self.part)
        self.tar = tarfile.open(fileobj=self.stream, mode="w|")

    def add(self, key: str, members) -> None:
        for ext, data in sorted(dict(members).items()):
            info = tarfile.TarInfo(f"{key}.{ext}")
            info.size = len(data)
            self.tar.addfile(info, io.BytesIO(data))

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.stream.close()
            self.system.move(self.part, f"{self.root}/{self.shard}.tar")
            self.names.append(self.shard)
            self.tar = None


class _Staging:
    """Folders, named by run, in which the tasks of a write make their tars."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def tars(self, run: str) -> _TarOut:
        system, root = open_fs(self.root)
        return _TarOut(system, root, f"{root}/_staging-{run}")

    def drop(self, run: str) -> None:
        system, root = open_fs(self.root)
        staging = f"{root}/_staging-{run}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class _ShardWriter(DataSourceArrowWriter):
    """Rows of a shard come together, by name; commit lists the tars."""

    def __init__(self, options: dict, overwrite: bool):
        self.staging = _Staging(options)
        self.run = uuid.uuid4().hex
        self.overwrite = overwrite
        self.old = _listed(*open_fs(self.staging.root)) or []
        replace = str(options.get("replace", "false")).lower() == "true"
        self.taken = set() if overwrite or replace else set(self.old)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        out = self.staging.tars(self.run)
        shard = None
        for batch in iterator:
            for name, key, members in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "members"))):
                if name != shard:
                    if name in self.taken:
                        raise RuntimeError(f"shard {name} is there already; overwrite, or give the batch names of its own")
                    shard = name
                    out.begin(name)
                out.add(key, members)
        out.close()
        return _Written(out.names)

    def commit(self, messages) -> None:
        system, root = open_fs(self.staging.root)
        names = [name for m in messages if m for name in m.names]
        if len(names) != len(set(names)):
            raise RuntimeError("a shard was written by more than one task; repartition by shard first")
        before = _lists(system, root)
        _put_list(system, root, self.run, names)
        if self.overwrite:
            for _, path in before:
                system.delete_file(path)
            for name in set(self.old) - set(names):
                system.delete_file(f"{root}/{name}.tar")
        self.staging.drop(self.run)

    def abort(self, messages) -> None:
        self.staging.drop(self.run)


class _ShardSink(DataSourceStreamArrowWriter):
    """Each task of a micro-batch fills tars of a fixed number of samples in the order in which rows come.

    A tar's name says epoch, task and number, and ends with the attempt, so that no attempt touches another's.
    The list of an epoch bears the query's id, which lives in the checkpoint: an epoch that has been committed
    before is not listed again, and what its second run wrote is taken away.
    """

    def __init__(self, options: dict):
        self.staging = _Staging(options)
        self.size = int(options.get("shardsize", 1000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        # Spark makes commit a sink of its own: what both must know goes by the query's id and the epoch.
        task = TaskContext.get()
        query, epoch = (task.getLocalProperty(p) for p in ("sql.streaming.queryId", "streaming.sql.batchId"))
        out = self.staging.tars(f"{query}-{epoch}")
        prefix = f"{int(epoch):06d}-{task.partitionId():05d}"
        count = 0
        for batch in iterator:
            for key, members in zip(*(batch.column(c).to_pylist() for c in ("key", "members"))):
                if count % self.size == 0:
                    out.begin(f"{prefix}-{count // self.size:05d}-{out.attempt[:12]}")
                out.add(key, members)
                count += 1
        out.close()
        return _Written(out.names, query)

    def commit(self, messages, batchId: int) -> None:
        system, root = open_fs(self.staging.root)
        names = [name for m in messages if m for name in m.names]
        for query in {m.query for m in messages if m}:
            label = f"{query}-{batchId}"
            if any(path.endswith(f"-{label}.json") for _, path in _lists(system, root)):
                for name in names:
                    system.delete_file(f"{root}/{name}.tar")
            elif names:
                _put_list(system, root, label, names)
        self.abort(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        for query in {m.query for m in messages if m}:
            self.staging.drop(f"{query}-{batchId}")


class TarShards(DataSource):
    """``format("tarshards")``: tars of a path or pattern, and a folder's committed tars as a stream; both ways."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ShardWriter(self.options, overwrite)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ShardFollower(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _ShardSink(self.options)


def read_shards(spark: SparkSession, pattern: str, skip_bad: bool = False, members: bool = True) -> DataFrame:
    """``shard, key, members`` of a tar, a folder of tars, or a pattern with brace ranges.

    A damaged tar fails the job. With ``skip_bad`` the samples before and behind the damage are read, and
    ``shard_faults`` accounts for the rest. ``members=False`` leaves the bytes unread, for keys and counts.
    """
    return _read(spark, pattern, skip_bad, members).filter("key IS NOT NULL").drop("error")


def shard_faults(spark: SparkSession, pattern: str) -> DataFrame:
    """``shard, samples, error``: of every shard the samples that could be read, and the bytes and samples lost, if any were."""
    rows = _read(spark, pattern, True, False)
    errors = F.array_join(F.sort_array(F.collect_list("error")), "; ")
    return rows.groupBy("shard").agg(F.count("key").alias("samples"), F.nullif(errors, F.lit("")).alias("error"))


def _read(spark: SparkSession, pattern: str, skip_bad: bool, members: bool) -> DataFrame:
    spark.dataSource.register(TarShards)
    return _opened(spark, spark.read, pattern, skip_bad, members)


def _opened(spark: SparkSession, reader, path: str, skip_bad: bool, members: bool) -> DataFrame:
    tars = reader.format("tarshards").option("skipbad", str(skip_bad)).option("members", "all" if members else "none")
    return tars.option("cores", spark.sparkContext.defaultParallelism).load(path)


def follow_shards(spark: SparkSession, folder: str, skip_bad: bool = False, members: bool = True) -> DataFrame:
    """A stream of ``shard, key, members`` of the tars that writes to a folder commit, each of them once.

    What is there already comes first; a folder without a commit yet is waited for. One writer at a time: a
    list out of turn, or a folder that was overwritten, fails the stream. Damage as in ``read_shards``.
    """
    spark.dataSource.register(TarShards)
    return _opened(spark, spark.readStream, folder, skip_bad, members).filter("key IS NOT NULL").drop("error")


def shard_sink(
    samples: DataFrame, path: str, checkpoint: str, shard_size: int = 1000, key: str = "key", members: str = "members"
) -> StreamingQuery:
    """A stream's samples as tars of ``shard_size``, written where the rows are: no exchange, and bytes written once.

    A tar belongs to one task of one micro-batch, so the last of each is shorter. Readers see whole epochs.
    """
    if shard_size < 1:
        raise ValueError(f"shards of {shard_size} samples")
    samples.sparkSession.dataSource.register(TarShards)
    none = F.lit(None).cast("string")
    rows = samples.select(none.alias("shard"), F.col(key).alias("key"), F.col(members).alias("members"), none.alias("error"))
    writer = rows.writeStream.format("tarshards").option("path", path).option("shardsize", shard_size)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def member(*extensions: str) -> Column:
    """The first of the members with these extensions."""
    return F.coalesce(*[F.element_at("members", e) for e in extensions])


def image_samples(shards: DataFrame) -> DataFrame:
    """``shard, key, image, caption`` of samples that have both an image and a text."""
    rows = shards.select("shard", "key", member(*IMAGE_EXTENSIONS).alias("image"), F.decode(member("txt"), "UTF-8").alias("caption"))
    return rows.filter(F.col("image").isNotNull() & F.col("caption").isNotNull())


def latent_samples(shards: DataFrame) -> DataFrame:
    rows = shards.select("shard", "key", member("pt", "npy").alias("latent"), F.decode(member("txt"), "UTF-8").alias("caption"))
    return rows.filter(F.col("latent").isNotNull() & F.col("caption").isNotNull())


def write_shards(
    samples: DataFrame, path: str, shard: str = "shard", key: str = "key", mode: str = "append", replace: bool = False
) -> None:
    """Writes ``shard, key, members`` rows, one tar per shard name, keys in order.

    A shard has a bounded number of samples, so rows are exchanged by shard name, and sorted
    and streamed into tars within each task. ``mode='overwrite'`` takes away what earlier writes to the folder
    listed; appending a shard name that is there already fails, unless ``replace`` says that it is written anew,
    as when a micro-batch runs again.
    """
    samples.sparkSession.dataSource.register(TarShards)
    rows = samples.select(F.col(shard).alias("shard"), F.col(key).alias("key"), "members", F.lit(None).cast("string").alias("error"))
    placed = rows.repartition("shard").sortWithinPartitions("shard", "key")
    placed.write.format("tarshards").option("replace", str(replace)).mode(mode).save(path)
