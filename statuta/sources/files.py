"""Record files, YAML or JSON, as a data source: a row for each file, whether it can be read or not."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.validation import duplicates
from . import schemas

FORMAT = "record_files"
#: Bytes of files that one task reads, about.
GROUP_BYTES = 16 << 20
#: Bytes of a file that are taken at a time where its list comes in parts, and characters of a part, about.
BLOCK_BYTES, PART_CHARS = 1 << 20, 1 << 18
_WHITE, _DECODER = re.compile(r"[ \t\n\r]*"), json.JSONDecoder()


@dataclass
class Group(InputPartition):
    paths: tuple[str, ...]


def grouped(files: list[tuple[str, int]], most: int) -> list[Group]:
    """Files in the order of their paths, in groups of about `most` bytes; a larger file is a group of its own."""
    out, held, size = [], [], 0
    for path, n in sorted(files):
        if held and size + n > most:
            out.append(Group(tuple(held)))
            held, size = [], 0
        held.append(path)
        size += n + 4096  # opening a file has a price
    return [*out, Group(tuple(held))] if held else out


def read_record(raw: bytes, path: str) -> tuple[str | None, str | None]:
    """The record as a JSON object with dates in ISO form, or else what is wrong with the file."""
    try:
        text = raw.decode("utf-8")
        if path.endswith(".json"):
            value = json.loads(text)
        else:
            import yaml

            value = yaml.safe_load(text)
    except UnicodeDecodeError:
        return None, "not UTF-8"
    except Exception as e:  # a parser's error, or a text that it can't take
        return None, f"unreadable: {type(e).__name__}"
    if not isinstance(value, dict):
        return None, "no record"
    return json.dumps(value, default=str, ensure_ascii=False), None


def _option(options: dict, name: str, default: str | None = None) -> str | None:
    """Options keep their case on some ways to a reader."""
    return options.get(name.lower(), options.get(name, default))


class _Json:
    """A JSON text taken block by block: what is held is a value and the blocks that it lies in."""

    def __init__(self, blocks: Iterable[str]):
        self.blocks, self.text, self.at = iter(blocks), "", 0

    def more(self, n: int = 1) -> bool:
        new = list(islice(self.blocks, n))
        self.text, self.at = "".join([self.text[self.at :], *new]), 0
        return bool(new)

    def sign(self) -> str:
        """The next character that is no white space, which isn't taken; "" at the end."""
        while True:
            self.at = _WHITE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, signs: str) -> str:
        if not (c := self.sign()) or c not in signs:
            raise json.JSONDecodeError(f"Expecting one of {signs}", self.text, self.at)
        self.at += 1
        return c

    def value(self):
        self.sign()
        n = 1
        while True:
            try:
                value, end = _DECODER.raw_decode(self.text, self.at)
            except json.JSONDecodeError as e:
                # only what the blocks end within may go on; escapes and names are under 16 characters
                if not (e.msg.startswith("Unterminated string") or e.pos > len(self.text) - 16) or not self.more(n):
                    raise
                n *= 2  # so a long value is tried a few times only
                continue
            size = end - self.at
            if end > len(self.text) - 3 and isinstance(value, int | float) and self.more():
                continue  # a number may go on, also after a sign or two that belong to none yet ("2e-")
            self.at += size
            return value


def _members(text: _Json, name: str) -> Iterator[tuple]:
    """(key, value, False) of the members of a JSON object in turn. A list at `name` comes as
    (name, [], False) and then, element by element, as (name, element, True)."""
    if text.sign() != "{":
        text.value()
        yield None, None, False
    elif text.take("{") and text.sign() == "}":
        text.take("}")
    else:
        then = ","
        while then == ",":
            if text.sign() != '"':
                raise json.JSONDecodeError("Expecting a name", text.text, text.at)
            key = text.value()
            text.take(":")
            if key == name and text.sign() == "[":
                yield key, [], False
                text.take("[")
                last = text.sign() == "]" and text.take("]")
                while last != "]":
                    yield key, text.value(), True
                    last = text.take(",]")
            else:
                yield key, text.value(), False
            then = text.take(",}")
    if text.sign():
        raise json.JSONDecodeError("Extra data", text.text, text.at)


def _decoded(stream) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")()
    while raw := stream.read(BLOCK_BYTES):
        if text := decoder.decode(raw):
            yield text
    decoder.decode(b"", True)


def _parts(head: dict, name: str, elements: Iterable | None) -> Iterator[str]:
    """The record as JSON, once for each stretch of the list at `name`; at least once."""
    if elements is None:
        yield json.dumps(head, default=str, ensure_ascii=False)
        return
    rest = json.dumps({k: v for k, v in head.items() if k != name}, default=str, ensure_ascii=False)
    opening = rest[:-1] + (", " if len(rest) > 2 else "") + json.dumps(name) + ": ["
    held, size, none = [], 0, True
    for x in elements:
        held.append(json.dumps(x, default=str, ensure_ascii=False))
        size += len(held[-1]) + 2
        if size >= max(PART_CHARS, len(opening)):
            yield opening + ", ".join(held) + "]}"
            held, size, none = [], 0, False
    if held or none:
        yield opening + ", ".join(held) + "]}"


def read_in_parts(opened: Callable, path: str, name: str, heads: bool = False) -> Iterator[tuple[str | None, str | None]]:
    """(record, problem) as of read_record, but a record for each stretch of its list at `name`, so
    that no more than a stretch is held; with heads one record, whose list is empty.

    A first reading finds whether the file is whole, and what it holds besides; where a key comes
    twice, the last counts. Files that are no JSON and may be YAML are read as wholes."""
    head, lists, counts = {}, 0, None
    with opened() as stream:
        blocks = _decoded(stream)
        try:
            for key, value, element in _members(_Json(blocks), name):
                if key is None:
                    head = None
                elif not element:
                    head[key] = value
                    if key == name:
                        lists += 1
                        counts = lists if isinstance(value, list) else None
        except UnicodeDecodeError:
            yield None, "not UTF-8"
            return
        except Exception as e:  # as in read_record
            counts, head, problem = None, None, f"unreadable: {type(e).__name__}"
            try:
                for _ in blocks:
                    pass
            except UnicodeDecodeError:
                problem = "not UTF-8"
        else:
            problem = "no record" if head is None else None
    if head is None and problem.startswith("unreadable") and not path.endswith(".json"):
        with opened() as stream:
            record, problem = read_record(stream.read(), path)
        head = record and json.loads(record)
    if head is None:
        yield None, problem
    elif not isinstance(head.get(name), list):
        yield from ((r, None) for r in _parts(head, name, None))
    elif heads or counts is None:
        yield from ((r, None) for r in _parts(head, name, () if heads else head[name]))
    else:

        def elements(blocks):
            seen = 0
            for key, value, element in _members(_Json(blocks), name):
                seen += key == name and not element
                if element and seen == counts:
                    yield value

        with opened() as stream:
            yield from ((r, None) for r in _parts(head, name, elements(_decoded(stream))))


class RecordFiles(DataSource):
    """Options: path, suffixes (comma-separated; .yaml,.yml,.json) and groupBytes. Folders are
    read with all below them; a folder that doesn't exist has no files. Paths are those that
    Arrow's file systems open (file, hdfs, s3, gs).

    With the option inParts, the name of a list, a file has a row for each stretch of that list,
    numbered by part from 0; with heads "true" besides, one row, whose list is empty."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, record string, problem string" + (", part int" if _option(self.options, "inParts") else "")

    def reader(self, schema) -> DataSourceReader:
        return RecordFilesReader(dict(self.options))


class RecordFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".yaml,.yml,.json").split(","))
        self.most = int(_option(options, "groupBytes", GROUP_BYTES))
        self.in_parts, self.heads = _option(options, "inParts"), options.get("heads") == "true"

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Group]:
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return grouped([(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffixes)], self.most) or [Group(())]

    def read(self, partition: Group) -> Iterator[tuple]:
        store, _ = self._store()
        if self.in_parts:
            yield from self._read_in_parts(store, partition)
            return
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as stream:
                    raw = stream.read()
            except OSError as e:
                yield path, None, f"can't be opened: {type(e).__name__}"
                continue
            yield path, *read_record(raw, path)

    def _read_in_parts(self, store, partition: Group) -> Iterator:
        """Batches of one row, as rows by the thousands would be gathered into one batch."""
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("record", pa.string()), ("problem", pa.string()), ("part", pa.int32())])

        def batch(*row):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

        for path in partition.paths:
            part = 0
            try:
                for record, problem in read_in_parts(lambda p=path: store.open_input_stream(p), path, self.in_parts, self.heads):
                    yield batch(path, record, problem, part)
                    part += 1
            except OSError as e:
                if part:  # some of it has been given
                    raise
                yield batch(path, None, f"can't be opened: {type(e).__name__}", 0)


def record_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, record, problem) of the files of a folder: record is JSON, and null where there is a problem."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format(FORMAT).options(**options).load(path)


def read_records(spark: SparkSession, path: str, schema: str = schemas.POLICY, key: str = "id", **options: str) -> tuple[DataFrame, DataFrame]:
    """Records of a folder, the first file of a key by path, and issues: (record_id, rule, severity, extra_rows) of
    files with a problem or without the key, and of further files of a key."""
    rows = record_files(spark, path, **options).select("path", "problem", F.from_json("record", schema).alias("r"))
    has_key = F.col(f"r.{key}").isNotNull()
    good = rows.filter(has_key).select("path", "r.*")
    bad = rows.filter(~F.coalesce(has_key, F.lit(False)))
    bad = bad.select(F.col("path").alias("record_id"), F.when(F.col("problem").isNull(), "no_key").otherwise("unreadable").alias("rule"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("extra_rows"))
    first, extra = duplicates(good, key, "path")
    return first, bad.unionByName(extra)


def read_change_days(spark: SparkSession, path: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """Change days as rows of changes, newest day first (a day without changes keeps a row), and the files with a problem or without a day.

    A day's changes come in parts, as a day may hold more than a task can."""
    rows, heads = (record_files(spark, path, inParts="changes", heads=h, **options).select("path", "problem", F.from_json("record", schemas.DAY).alias("d")) for h in ("false", "true"))
    dated = F.coalesce(F.col("d.detected_on").isNotNull(), F.lit(False))
    changes = rows.filter(dated).select(F.col("d.detected_on").alias("day"), F.explode_outer("d.changes").alias("c")).select("day", "c.*")
    return changes.orderBy(F.desc("day"), "policy_id"), heads.filter(~dated).select(F.col("path").alias("file"), F.coalesce("problem", F.lit("no day")).alias("error"))
