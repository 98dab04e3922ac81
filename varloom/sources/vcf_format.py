"""VCF as a data source: `spark.read.format("vcf")`, after `register(spark)`.

Rows are contig, pos, file, place and gt (an array of genotype texts).  Plain and block-compressed files are read in
splits, each by a task; a line belongs to the split in which the line feed before it lies.  Ordinary gzip is one split.
Conditions on contig and pos are taken over by the reader: a line is cut into samples only if it meets them.

options: splitBytes (compressed bytes of a split, 32 MiB without it); sorted ("true": positions ascend within a contig, so
a split ends where its contig's range does).
"""

from __future__ import annotations

import gzip
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from varloom.sources import bgzf

SCHEMA = "contig string, pos long, file int, place long, gt array<string>"
_ARROW = pa.schema([("contig", pa.string()), ("pos", pa.int64()), ("file", pa.int32()), ("place", pa.int64()), ("gt", pa.list_(pa.string()))])
#: Genotypes of a batch, and bytes of plain text that are read at once.
BATCH, CHUNK = 1 << 17, 1 << 20
_COMPARED = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path there; a path without a scheme is of the local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The file, or those of a folder in the order of their names, without hidden ones."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(at))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def kind_of(path: str) -> str:
    """plain, bgzf or gzip, by the file's first bytes."""
    fs, at = opened(path)
    with fs.open_input_file(at) as file:
        head = file.read(64)
    return "plain" if head[:2] != b"\x1f\x8b" else "bgzf" if bgzf.size_of(head) else "gzip"


@dataclass
class Split(ds.InputPartition):
    number: int
    file_number: int
    path: str
    kind: str
    start: int
    end: int


def _chunks(file, kind: str, start: int) -> Iterator[tuple[int, bytes]]:
    """Offset in the file and text of each piece from `start` on."""
    if kind == "bgzf":
        first = bgzf.first_member(file, start)
        yield from bgzf.members(file, first) if first is not None else ()
    elif kind == "gzip":
        with gzip.GzipFile(fileobj=file) as whole:
            while chunk := whole.read(CHUNK):
                yield 0, chunk
    else:
        file.seek(start)
        while chunk := file.read(CHUNK):
            yield start, chunk
            start += len(chunk)


def lines_of(file, split: Split) -> Iterator[bytes]:
    """The lines of a split: it begins behind the first line feed at or after its start and ends with the line that holds, or ends at, its end."""
    held, begun = b"", split.start == 0
    for at, chunk in _chunks(file, split.kind, split.start):
        if split.kind == "plain" and at < split.end < at + len(chunk):
            pieces = ((at, chunk[: split.end - at]), (split.end, chunk[split.end - at :]))
        else:
            pieces = ((at, chunk),)
        for place, text in pieces:
            beyond = split.kind != "gzip" and place >= split.end
            if not begun:
                cut = text.find(b"\n")
                if cut < 0:
                    continue
                if beyond:
                    return  # no line begins in this split
                begun, text = True, text[cut + 1 :]
            if beyond:
                cut = text.find(b"\n")
                if cut >= 0:
                    yield held + text[:cut]
                    return
                held += text
                continue
            parts = (held + text).split(b"\n")
            held = parts.pop()
            yield from parts
    if held and begun:
        yield held


class VcfReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size, self.sorted = options["path"], int(options.get("splitBytes", 32 << 20)), options.get("sorted", "false") == "true"
        self.conditions: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column in (("contig",), ("pos",)) and (type(f) in _COMPARED or isinstance(f, (ds.In, ds.IsNotNull))):
                if not isinstance(f, ds.IsNotNull):  # both are in every line
                    self.conditions.append((column[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[Split]:
        out = []
        for number, path in enumerate(files_of(self.path)):
            kind = kind_of(path)
            fs, at = opened(path)
            size = fs.get_file_info(at).size
            step = max(size, 1) if kind == "gzip" else self.size
            out += [Split(len(out) + k, number, path, kind, low, min(low + step, size)) for k, low in enumerate(range(0, size, step))]
        return [Split(k, s.file_number, s.path, s.kind, s.start, s.end) for k, s in enumerate(out)]

    def _meets(self) -> tuple[list, list]:
        """Tests of contig and of pos."""
        tests: dict[str, list] = {"contig": [], "pos": []}
        by_name = {t.__name__: f for t, f in _COMPARED.items()}
        for column, kind, value in self.conditions:
            tests[column].append((lambda x, v=frozenset(value): x in v) if kind == "In" else (lambda x, f=by_name[kind], v=value: f(x, v)))
        return tests["contig"], tests["pos"]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        on_contig, on_pos = self._meets()
        last = min((v for c, kind, v in self.conditions if c == "pos" and kind in ("LessThan", "LessThanOrEqual", "EqualTo")), default=None)
        one = next((v for c, kind, v in self.conditions if c == "contig" and kind == "EqualTo"), None)
        rows, cells = [], 0
        fs, at = opened(split.path)
        with fs.open_input_file(at) as file:
            for n, line in enumerate(lines_of(file, split)):
                if not line or line[:1] == b"#":
                    continue
                head = line.rstrip(b"\r").decode().split("\t", 9)
                contig, pos = head[0], int(head[1])
                if not (all(t(contig) for t in on_contig) and all(t(pos) for t in on_pos)):
                    if self.sorted and one is not None and contig == one and last is not None and pos > last:
                        break
                    continue
                rows.append((contig, pos, split.file_number, (split.number << 36) + n, _genotypes(head)))
                cells += len(rows[-1][4])
                if cells >= BATCH:
                    yield _batch(rows)
                    rows, cells = [], 0
        if rows:
            yield _batch(rows)


def _genotypes(fields: list[str]) -> list[str | None]:
    samples = fields[9].split("\t") if len(fields) > 9 else []
    keys = fields[8].split(":") if len(fields) > 8 else []
    if keys == ["GT"]:
        return [x.split(":", 1)[0] for x in samples]
    if "GT" not in keys:
        return [None] * len(samples)
    k = keys.index("GT")
    return [parts[k] if len(parts := x.split(":", k + 1)) > k else None for x in samples]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class VcfWriter(ds.DataSourceArrowWriter):
    """Lines (column value) as block-compressed part files, which come to their place when all tasks are done."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        fs, at = opened(self.path)
        if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)
        self.pending = f"{at}/_pending"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        from pyspark import TaskContext

        fs, _ = opened(self.path)
        fs.create_dir(self.pending)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.vcf.gz"
        chunks = (("\n".join(b.column(0).to_pylist()) + "\n").encode() for b in iterator if b.num_rows)
        with fs.open_output_stream(f"{self.pending}/{name}", compression=None) as out:
            for piece in bgzf.compressed(chunks):
                out.write(piece)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for m in messages:
            if m is not None:
                fs.move(f"{self.pending}/{m.name}", f"{at}/{m.name}")
        fs.create_dir(self.pending)
        fs.delete_dir(self.pending)  # with what failed attempts left

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        fs.create_dir(self.pending)
        fs.delete_dir(self.pending)


@dataclass
class Written(ds.WriterCommitMessage):
    name: str


class VcfSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> VcfReader:
        return VcfReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> VcfWriter:
        return VcfWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it hand conditions to the reader."""
    spark.dataSource.register(VcfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("vcf").options(**{k: str(v) for k, v in options.items()}).load(path)


def head_lines(path: str) -> Iterator[str]:
    """The lines of the header, read from the first file alone."""
    name = files_of(path)[0]
    fs, at = opened(name)
    size = fs.get_file_info(at).size
    with fs.open_input_file(at) as file:
        for line in lines_of(file, Split(0, 0, name, kind_of(name), 0, size)):
            if line[:1] != b"#":
                return
            yield line.rstrip(b"\r").decode()
