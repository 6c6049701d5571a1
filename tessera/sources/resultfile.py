"""Result files as a data source: nodes, elements and nodal results in blocks of fixed-width lines.

    spark.dataSource.register(resultfile.ResultFiles)
    spark.read.format("resultfile").option("name", "DISP").load(path)

A file holds header lines, then blocks: nodes, elements, and one block for each
result set (step, increment, time, name, components). The reader takes a file or a
folder. It finds the blocks without reading their rows: from the index that the
writer leaves, else by the row counts in the block headers, since lines have a fixed
width. Blocks that the options or pushed filters rule out are never opened, and
large ones are cut into byte ranges, so that a partition is a piece of one block.

The writer takes rows in any order of blocks and begins a block wherever the result
set changes (``write_results`` sorts first, so that each task has few). Every task
writes a whole file of its own under a temporary name; the commit renames them and
writes the index, so that a lost or repeated task leaves nothing behind.

Files are reached from Python: on mounted paths (``file:`` or none), or by whatever
scheme pyarrow opens. Values have six digits, as the lines have twelve characters.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMAS = {
    "results": "step int, increment int, time double, name string, node long, values array<double>",
    "nodes": "node long, x double, y double, z double",
    "elements": "elem long, type int, material string, nodes array<long>",
    "blocks": "kind string, step int, increment int, time double, name string, components array<string>, n_rows long, file string, first long, last long",
}
# How many nodes an element of each type number has.
ELEMENT_NODES = {1: 8, 2: 6, 3: 4, 4: 20, 5: 15, 6: 10, 7: 3, 8: 6, 9: 4, 10: 8, 11: 2, 12: 3}
#: Bytes of a block that one partition reads, and rows of a batch that it hands on.
PIECE, ROWS = 32 << 20, 10_000
_VALUE, _KEY, _PER_LINE, _NODES_PER_LINE = 12, 13, 6, 10


@dataclass
class Block:
    """Rows ``first`` to ``last`` (bytes) of a file, all of one kind and result set."""

    file: str
    kind: str
    first: int
    last: int
    n_rows: int | None
    step: int | None = None
    increment: int | None = None
    time: float | None = None
    name: str | None = None
    components: tuple[str, ...] = ()


@dataclass
class Piece(InputPartition):
    block: Block
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    blocks: list


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z0-9+.-]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def row_width(components: int) -> int:
    """Bytes of a row with so many values, its continuation lines included."""
    lines = max(1, -(-components // _PER_LINE))
    return lines * (_KEY + 1) + components * _VALUE


def _number(text: bytes, kind=int):
    text = text.strip()
    return kind(text) if text else None


def _end_of(f, at: int) -> int:
    """Where the line that closes the block begins, by reading on."""
    f.seek(at)
    tail, where = b"\n", at - 1
    while some := f.read(1 << 20):
        if (k := (tail + some).find(b"\n -3")) >= 0:
            return where + k + 1
        where += len(some) + len(tail) - 4
        tail = (tail + some)[-4:]
    raise ValueError("result file: a block has no end")


def scan(store: fs.FileSystem, path: str) -> list[Block]:
    """The blocks of a file; of nodes and results only the headers are read."""
    found, step, increment = [], None, None
    with store.open_input_file(path) as f:
        size, at = f.size(), 0

        def line() -> bytes:
            nonlocal at
            f.seek(at)
            some = f.read(256)
            end = some.find(b"\n")
            if end < 0:
                end = len(some)
            at += end + 1
            return some[:end].rstrip(b"\r")

        while at < size:
            head = line()
            block = None
            if head.startswith(b"    1PSTEP"):
                increment, step = _number(head[36:48]), _number(head[48:60])
            elif head.startswith(b"    2C"):
                block = Block(path, "nodes", at, 0, _number(head[24:36]))
                width = row_width(3)
            elif head.startswith(b"    3C"):
                block = Block(path, "elements", at, 0, _number(head[24:36]))
                width = None
            elif head.startswith(b"  100C"):
                time, rows = _number(head[12:24], float), _number(head[24:36])
                if head[74:75] not in (b"0", b"1", b""):
                    raise ValueError(f"result file {path}: only text blocks can be read")
                first = line()
                name, names = first[5:13].decode().strip(), []
                for _ in range(_number(first[13:18])):
                    part = line()
                    told = re.fullmatch(rb"([\d\s]*?)([A-Z]*)\s*", part[13:])
                    numbers = told[1].split() if told else []
                    if not (told and told[2]) and (len(numbers) < 5 or int(numbers[4]) == 0):  # a component that is told, not left to be computed
                        names.append(part[5:13].decode().strip())
                block = Block(path, "results", at, 0, rows, step, increment, time, name, tuple(names))
                width = row_width(len(names))
            if block is not None:
                end = block.first + block.n_rows * width if width and block.n_rows is not None else None
                if end is not None and end <= size:
                    f.seek(end)
                    end = end if f.read(3) == b" -3" else None
                block.last = end if end is not None and end <= size else _end_of(f, block.first)
                if block.n_rows is None:
                    block.n_rows = (block.last - block.first) // width if width else None
                found.append(block)
                at = block.last
                line()
    return found


def _listed(path: str) -> tuple[fs.FileSystem, list[Block]]:
    """All blocks under a path: by the writers' indices, of other files by a scan."""
    store, where = _store(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return store, scan(store, where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"result file: {path} is not there")
    names = {posixpath.basename(x.path): x.path for x in store.get_file_info(fs.FileSelector(where)) if x.type == fs.FileType.File}
    blocks, known = [], set()
    for name in sorted(names):
        if name.startswith("_blocks-"):
            with store.open_input_stream(names[name]) as f:
                for entry in json.loads(f.read()):
                    known.add(entry["file"])
                    blocks += [Block(**{**b, "file": f"{where}/{entry['file']}", "components": tuple(b["components"])}) for b in entry["blocks"]]
    for name in sorted(names):
        if name[0] not in "_." and name not in known:
            blocks += scan(store, names[name])
    return store, blocks


def _floats(table: np.ndarray, at: int, n: int) -> np.ndarray:
    """n values of twelve characters each from column ``at`` on."""
    some = np.ascontiguousarray(table[:, at : at + n * _VALUE]).view(f"S{_VALUE}")
    return some.astype(np.float64)


def _rows(data: bytes, block: Block) -> Iterator[pa.RecordBatch]:
    n = 3 if block.kind == "nodes" else len(block.components)
    width = row_width(n)
    if len(data) % width:
        raise ValueError(f"result file {block.file}: the lines from byte {block.first} on do not have {width} characters a row")
    every = np.frombuffer(data, np.uint8).reshape(-1, width)
    for at in range(0, len(every), ROWS):
        table = every[at : at + ROWS]
        node = np.ascontiguousarray(table[:, 3:_KEY]).view(f"S{_KEY - 3}").ravel().astype(np.int64)
        parts, line = [], 0
        for k in range(0, n, _PER_LINE):
            some = min(_PER_LINE, n - k)
            parts.append(_floats(table, line + _KEY, some))
            line += _KEY + some * _VALUE + 1
        values = np.concatenate(parts, axis=1) if parts else np.zeros((len(table), 0))
        if block.kind == "nodes":
            yield pa.RecordBatch.from_arrays([pa.array(node), *(pa.array(values[:, k]) for k in range(3))], names=["node", "x", "y", "z"])
            continue
        same = lambda v, t: pa.array([v] * len(table), t)  # noqa: E731, B023
        ends = pa.array(np.arange(len(table) + 1, dtype=np.int32) * n)
        lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([same(block.step, pa.int32()), same(block.increment, pa.int32()), same(block.time, pa.float64()), same(block.name, pa.string()), pa.array(node), lists], names=["step", "increment", "time", "name", "node", "values"])


def _elements(data: bytes) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for record in data.decode("ascii").removeprefix(" -1").split("\n -1"):
        head, *more = record.rstrip("\n").split("\n -2")
        nodes = [int(part[i : i + 10]) for part in more for i in range(0, len(part.rstrip()), 10)]
        kind = int(head[10:15])
        if len(nodes) != ELEMENT_NODES.get(kind, len(nodes)):
            raise ValueError(f"result file: element {head[:10].strip()} of type {kind} has {len(nodes)} nodes")
        rows.append((int(head[:10]), kind, head[20:25].strip(), nodes))
    for at in range(0, len(rows), ROWS):
        some = list(zip(*rows[at : at + ROWS], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), pa.array(some[1], pa.int32()), pa.array(some[2], pa.string()), pa.array(some[3], pa.list_(pa.int64()))], names=["elem", "type", "material", "nodes"])


class Reader(DataSourceReader):
    """Options: what (results, nodes, elements or blocks), and for results name, step, from_time, to_time."""

    def __init__(self, options: dict):
        self.path, self.what = options["path"], options.get("what", "results")
        self.tests: list[tuple[str, str, object]] = []
        if options.get("name"):
            self.tests.append(("name", "in", [n.strip() for n in options["name"].split(",")]))
        if options.get("step"):
            self.tests.append(("step", "in", [int(n) for n in options["step"].split(",")]))
        if options.get("from_time"):
            self.tests.append(("time", ">=", float(options["from_time"])))
        if options.get("to_time"):
            self.tests.append(("time", "<=", float(options["to_time"])))

    def wanted(self, block: Block) -> bool:
        """Whether the block may have rows that pass; only result sets have what is tested."""
        for column, how, value in self.tests:
            own = getattr(block, column)
            if own is None or not {"in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[how](own, value):
                return False
        return True

    def partitions(self):
        _, blocks = _listed(self.path)
        if self.what == "blocks":
            return [InputPartition([b for b in blocks if self.wanted(b)])]
        out = []
        for b in blocks:
            if b.kind == self.what and self.wanted(b):
                width = row_width(3 if b.kind == "nodes" else len(b.components)) if b.kind != "elements" else 1
                step = max(1, PIECE // width) * width
                out += [Piece(b, a, min(b.last, a + step)) for a in range(b.first, b.last, step)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if not isinstance(partition, Piece):
            for b in partition.value or ():
                yield (b.kind, b.step, b.increment, b.time, b.name, list(b.components), b.n_rows, b.file, b.first, b.last)
            return
        block = partition.block
        store = _store(self.path)[0]
        with store.open_input_file(block.file) as f:
            first, last = partition.first, partition.last
            if block.kind == "elements":
                first, last = (_record_start(f, block, at) for at in (first, last))
            f.seek(first)
            data = f.read(last - first)
        if data:
            yield from _elements(data) if block.kind == "elements" else _rows(data, block)


def _record_start(f, block: Block, at: int) -> int:
    """The first element line that begins at ``at`` or later, or the block's end."""
    if at <= block.first:
        return block.first
    at -= 1
    while at < block.last:
        f.seek(at)
        some = f.read(min(4096, block.last - at))
        if (k := some.find(b"\n -1")) >= 0:
            return at + k + 1
        if len(some) < 4:
            break
        at += len(some) - 3
    return block.last


class FilteringReader(Reader):
    """As Reader, with filters on step, increment, time and name pushed to the blocks."""

    _PUSHED = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def pushFilters(self, filters):
        for f in filters:
            how = self._PUSHED.get(type(f))
            if self.what not in ("results", "blocks") or how is None or len(f.attribute) != 1 or f.attribute[0] not in ("step", "increment", "time", "name"):
                yield f
            elif how == "==":
                self.tests.append((f.attribute[0], "in", [f.value]))
            else:
                self.tests.append((f.attribute[0], how, list(f.value) if how == "in" else f.value))


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.what, self.overwrite = options["path"], options.get("what", "results"), overwrite
        if self.what not in ("results", "nodes", "elements"):
            raise ValueError(f"result file: {self.what} can't be written")
        named = (part.partition("=") for part in options.get("components", "").split(";") if part)
        self.components = {k.strip(): [c.strip() for c in v.split(",")] for k, _, v in named}
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, where = _store(self.path)
        return store, where, f"{where}/_temporary-{self.job}"

    def write(self, iterator) -> Written:
        store, _, temporary = self._folder()
        store.create_dir(temporary, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.txt"
        with store.open_output_stream(f"{temporary}/{name}") as f:
            f.write(b"    1C\n")
            blocks = list(self._results(f, iterator) if self.what == "results" else self._model(f, iterator))
            f.write(b" 9999\n")
        return Written(name, blocks)

    def _spool(self, f, at: int, head: str, body: list[bytes], block: dict) -> dict:
        """Write a block, whose row count its header has; ``at`` is where it begins."""
        head_bytes = head.encode("ascii")
        f.write(head_bytes)
        size = sum(map(len, body))
        for part in body:
            f.write(part)
        f.write(b" -3\n")
        return block | {"first": at + len(head_bytes), "last": at + len(head_bytes) + size}

    def _model(self, f, iterator):
        body, n = [], 0
        for batch in iterator:
            rows = batch.to_pylist()
            n += len(rows)
            body.append("".join([_node_line(r) if self.what == "nodes" else _element_lines(r) for r in rows]).encode("ascii"))
        if n:
            head = f"{'    2C' if self.what == 'nodes' else '    3C'}{'':18}{n:12d}{'':37}1\n"
            yield self._spool(f, 7, head, body, {"kind": self.what, "n_rows": n, "components": []})

    def _results(self, f, iterator):
        at, key, body, n, k = 7, None, [], 0, 0
        done = []

        def close():
            nonlocal at, body, n
            if n:
                step, increment, time, name = key
                names = self.components.get(name) or [f"V{i + 1}" for i in range(k)]
                if len(names) != k:
                    raise ValueError(f"result file: {name} has {k} values and {len(names)} names")
                number = len(done) + 1
                head = f"    1PSTEP{'':14}{number:12d}{increment:12d}{step:12d}\n  100CL{100 + number % 900:5d}{_time(time)}{n:12d}{'':20}{0:2d}{number % 100000:5d}{'':10}{1:2d}\n -4  {name:<8}{k:5d}{1:5d}\n"
                head += "".join(f" -5  {c:<8}{1:5d}{2:5d}{i + 1:5d}{0:5d}\n" for i, c in enumerate(names))
                done.append(self._spool(f, at, head, body, {"kind": "results", "n_rows": n, "step": step, "increment": increment, "time": float(_time(time)), "name": name, "components": names}))
                at = done[-1]["last"] + 4
                body, n = [], 0

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("step", "increment", "time", "name", "node", "values")]
            lines: list[str] = []
            for step, increment, time, name, node, values in zip(*columns, strict=True):
                if None in (step, increment, time, name, node) or values is None or None in values:
                    raise ValueError("result file: null in a row")
                if (step, increment, time, name) != key or len(values) != k:
                    body.append("".join(lines).encode("ascii"))
                    lines = []
                    close()
                    key, k = (step, increment, time, name), len(values)
                    if len(name) > 8:
                        raise ValueError(f"result file: the name {name} has more than 8 letters")
                lines.append(_value_lines(node, values))
                n += 1
            body.append("".join(lines).encode("ascii"))
        close()
        return done

    def commit(self, messages) -> None:
        store, where, temporary = self._folder()
        store.create_dir(where, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(where)):
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
        entries = []
        for m in messages:
            if m is not None:
                store.move(f"{temporary}/{m.file}", f"{where}/{m.file}")
                entries.append({"file": m.file, "blocks": m.blocks})
        with store.open_output_stream(f"{where}/_blocks-{self.job}.json") as f:
            f.write(json.dumps(entries).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        store, _, temporary = self._folder()
        if store.get_file_info(temporary).type == fs.FileType.Directory:
            store.delete_dir(temporary)


def _key(number: int) -> str:
    if not -(10**9) < number < 10**10:
        raise ValueError(f"result file: the number {number} has more than 10 digits")
    return f"{number:10d}"


def _value(v: float) -> str:
    """Twelve characters; what needs a third digit in its exponent is out of a single's range, so 0 or infinite."""
    if v != v or v in (float("inf"), float("-inf")):
        return f"{v:12}"
    if abs(v) < 1e-99:
        return f"{0:12.5E}"
    if abs(v) >= 9.999995e99:
        return f"{float('inf') if v > 0 else float('-inf'):12}"
    return f"{v:12.5E}"


def _time(t: float) -> str:
    """Twelve characters, with as many digits as fit."""
    for digits in range(9, -1, -1):
        if len(text := f"{t:.{digits}f}") <= 11 and (t == 0 or abs(t) >= 1e-3):
            return f"{text:>12}"
    return f"{t:12.5E}"


def _value_lines(node: int, values: list[float]) -> str:
    parts = [f" -1{_key(node)}{''.join(map(_value, values[:_PER_LINE]))}\n"]
    parts += [f" -2{'':10}{''.join(map(_value, values[k : k + _PER_LINE]))}\n" for k in range(_PER_LINE, len(values), _PER_LINE)]
    return "".join(parts)


def _node_line(r: dict) -> str:
    return _value_lines(r["node"], [r["x"], r["y"], r["z"]])


def _element_lines(r: dict) -> str:
    nodes = r["nodes"]
    if len(nodes) != ELEMENT_NODES.get(r["type"], len(nodes)):
        raise ValueError(f"result file: element {r['elem']} of type {r['type']} has {len(nodes)} nodes")
    return f" -1{_key(r['elem'])}{r['type']:5d}{0:5d}{str(r['material'] or 0)[:5]:>5}\n" + "".join(f" -2{''.join(map(_key, nodes[k : k + _NODES_PER_LINE]))}\n" for k in range(0, len(nodes), _NODES_PER_LINE))


class ResultFiles(DataSource):
    """The format "resultfile". ``filters=true`` pushes filters to the blocks, and needs ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "resultfile"

    def schema(self) -> str:
        what = self.options.get("what", "results")
        if what not in SCHEMAS:
            raise ValueError(f"result file: what is {what}, not one of {', '.join(SCHEMAS)}")
        return SCHEMAS[what]

    def reader(self, schema):
        options = dict(self.options)
        return (FilteringReader if options.get("filters", "").lower() == "true" else Reader)(options)

    def writer(self, schema, overwrite: bool):
        return Writer(dict(self.options), overwrite)


def read(spark, path: str, what: str = "results", **options) -> DataFrame:
    spark.dataSource.register(ResultFiles)
    return spark.read.format("resultfile").options(what=what, **options).load(path)


def write(rows: DataFrame, path: str, what: str = "results", mode: str = "append", parts: int | None = None, components: dict[str, list[str]] | None = None) -> None:
    """``rows`` (as SCHEMAS[what]) into the folder ``path``, sorted, in ranges of result sets and nodes."""
    columns = [c.split()[0] for c in SCHEMAS[what].split(", ")]
    order = {"results": ["step", "increment", "time", "name", "node"], "nodes": ["node"], "elements": ["elem"]}[what]
    ranged = rows.select(*columns).repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    rows.sparkSession.dataSource.register(ResultFiles)
    named = ";".join(f"{k}={','.join(v)}" for k, v in (components or {}).items())
    ranged.write.format("resultfile").mode(mode).options(what=what, components=named).save(path)
