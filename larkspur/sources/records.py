"""A Spark data source for JSON of several layouts and encodings: `spark.read.format("larkspur_records")` after `register`.

Layouts (option `layout`): `messages` (a record with role and content), `qa` (question-answer pairs, alone or in batches with a
`qa_pairs` list and a document id) and `blocks` (documents of pages of blocks, children included). Files hold one
JSON value, an array, or one value a line. Text is UTF-8, UTF-16 or UTF-32 by its mark, else UTF-8, else Latin-1. Files are read
in partitions: line files are cut into byte ranges of `split` bytes at line ends, other files are read whole. Records that
are not JSON are left out, or fail with option `strict`.

As a stream the source polls the folder: each trigger takes at most `per_trigger` files that were not taken yet, by name, so new
files must sort after old ones, as with dated names; the offset is the last name.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMAS = {
    "messages": "role string, content string, conversation string",
    "qa": "document string, question string, answer string, type string, confidence double",
    "blocks": "document string, page int, path string, type string, level int, text string",
}
_MARKS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]


def decoded(raw: bytes) -> str:
    """By a mark, else UTF-8, else Latin-1."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _number(value, kind):
    try:
        return None if value is None else kind(value)
    except (TypeError, ValueError):
        return None


def _messages(record: dict) -> Iterator[tuple]:
    inner = record.get("messages")
    for m in inner if isinstance(inner, list) else [record]:
        if isinstance(m, dict) and "role" in m:
            yield _text(m.get("role")), _text(m.get("content")), _text(record.get("conversation_id"))


def _qa(record: dict) -> Iterator[tuple]:
    inner = record.get("qa_pairs")
    for q in inner if isinstance(inner, list) else [record]:
        if isinstance(q, dict) and "question" in q:
            yield _text(q.get("document_id", record.get("document_id"))), _text(q.get("question")), _text(q.get("answer")), _text(q.get("question_type", q.get("type"))), _number(q.get("confidence"), float)


def _blocks(record: dict) -> Iterator[tuple]:
    whole = record.get("document") if isinstance(record.get("document"), dict) else record
    name = _text(whole.get("id", record.get("document_id")))
    for p, page in enumerate(whole.get("pages") or []):
        number = _number(page.get("page_num", page.get("page_number", p)), int)
        todo = [(str(k), b) for k, b in reversed(list(enumerate(page.get("blocks") or [])))]
        while todo:  # children follow their block
            path, b = todo.pop()
            if isinstance(b, dict):
                yield name, number, path, _text(b.get("type")), _number(b.get("level"), int), _text(b.get("text"))
                todo += [(f"{path}.{k}", x) for k, x in reversed(list(enumerate(b.get("children") or b.get("blocks") or [])))]


_ROWS = {"messages": _messages, "qa": _qa, "blocks": _blocks}


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None  # None: the whole file


def _files(path: str):
    """The file system and the sorted (path, size) of a file or a folder's files."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File]
    return system, sorted((f.path, f.size) for f in found if not f.base_name.startswith(("_", ".")))


class _Records:
    def __init__(self, options: dict[str, str]):
        self.path, self.layout = options["path"], options.get("layout", "messages")
        if self.layout not in SCHEMAS:
            raise ValueError(f"layout must be one of {', '.join(SCHEMAS)}")
        self.split, self.strict = int(options.get("split", 64 << 20)), options.get("strict", "false").lower() == "true"

    def parts(self, files: list[tuple[str, int]], system) -> list[Part]:
        out: list[Part] = []
        for path, size in files:
            cut = False
            if path.endswith(("l", ".ndjson")) and size > self.split:  # .jsonl
                with system.open_input_file(path) as f:
                    head = f.read(4)
                    cut = not any(head.startswith(m) for m, name in _MARKS if name != "utf-8-sig")
            out += [Part(path, a, min(a + self.split, size)) for a in range(0, size, self.split)] if cut else [Part(path, 0, None)]
        return out

    def _lines(self, part: Part, system) -> Iterator[bytes]:
        """Lines that start in the range: what the range before began is its own."""
        with system.open_input_file(part.path) as f:
            at = part.start
            if at:
                f.seek(at - 1)
            rest = b"" if at else None
            skipping = bool(at)
            position = at - 1 if at else 0
            while True:
                block = f.read(1 << 20)
                if not block:
                    break
                data, rest = (rest or b"") + block, b""
                lines = data.split(b"\n")
                rest = lines.pop()
                for line in lines:
                    began, position = position, position + len(line) + 1
                    if skipping:
                        skipping = False
                        continue
                    if began >= part.end:
                        return
                    yield line
            if rest and not skipping and position < part.end:
                yield rest

    def values(self, part: Part) -> Iterator[dict]:
        system, _ = _files(self.path)
        if part.end is None:
            with system.open_input_file(part.path) as f:
                whole = decoded(f.read())
            try:
                value = json.loads(whole)
                yield from value if isinstance(value, list) else [value]
                return
            except ValueError:
                lines: Iterator[str] = iter(whole.splitlines())
        else:
            lines = (decoded(x) for x in self._lines(part, system))
        for line in lines:
            if line.strip():
                try:
                    yield json.loads(line)
                except ValueError:
                    if self.strict:
                        raise

    def rows(self, part: Part) -> Iterator[tuple]:
        for value in self.values(part):
            if isinstance(value, dict):
                yield from _ROWS[self.layout](value)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.records = _Records(options)

    def partitions(self) -> list[Part]:
        system, files = _files(self.records.path)
        return self.records.parts(files, system)

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.records.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.records, self.most = _Records(options), int(options.get("per_trigger", 10))
        self.last = ""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        new = [path for path, _ in _files(self.records.path)[1] if path > self.last][: self.most]
        self.last = new[-1] if new else self.last
        return {"last": self.last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.last = max(self.last, end["last"])  # after a restart
        system, files = _files(self.records.path)
        return self.records.parts([f for f in files if start["last"] < f[0] <= end["last"]], system)

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.records.rows(partition)


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "larkspur_records"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("layout", "messages")]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Source)
