"""Document trees, mail files and index files."""

from __future__ import annotations

import csv
import os
import re
import tempfile
from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..runtime import cut_lineage

SUFFIXES = (".docx", ".pdf", ".eml", ".emlx", ".msg", ".oft", ".mht", ".mhtml", ".mbox")
MESSAGE = "path string, pos int, subject string, sender string, to_addrs string, cc_addrs string, date_raw string, body string, attachments array<string>, error string"


class _Folder(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__(folder)
        self.folder, self.deep = folder, deep


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, skip: set[str]):
        self.root, self.skip = root, skip

    def _kept(self, name: str) -> bool:
        return not name.startswith(".") and name not in self.skip

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and one partition for each folder below it."""
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and self._kept(e.name))
        return [_Folder(self.root, False), *(_Folder(f, True) for f in below)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for folder, below, names in os.walk(partition.folder):
            below[:] = sorted(d for d in below if self._kept(d)) if partition.deep else []
            for name in sorted(names):
                suffix = os.path.splitext(name)[1].lower()
                if not name.startswith("~") and (suffix in SUFFIXES or suffix == ".mbx"):
                    path = os.path.join(folder, name)
                    yield (os.path.relpath(path, self.root), suffix, os.path.getsize(path))


class DocumentTree(DataSource):
    """Supported documents below a folder on a shared file system: ``file``, ``suffix``, ``length``.

    Unlike Spark's own file sources it lists files whose names begin with a dot; folders that
    do, and those named in the option ``skip``, are pruned before they are entered.
    """

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def schema(self) -> str:
        return "file string, suffix string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], set(self.options.get("skip", "").split(",")) - {""})


def document_tree(spark: SparkSession, root: str, skip: str = "") -> DataFrame:
    spark.dataSource.register(DocumentTree)
    return spark.read.format("document_tree").option("skip", skip).load(root)


# The kinds of part that give a file's body, the wanted one first.
_BODY = {"archive": ("text/html", "text/plain"), "mail": ("text/plain",)}
MAIL_SUFFIXES = (".eml", ".emlx", ".mht", ".mhtml", ".mbox")
SPLIT = 64 << 20  # bytes of a mailbox file that one task reads


def _text(part) -> str:
    try:
        return part.get_content()
    except (LookupError, UnicodeError, KeyError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", errors="replace")


def _body(msg, route: str) -> str | None:
    """The text of the first part of the wanted kinds; of HTML parts the one that the message names as its start comes first."""
    start = (msg.get_param("start") or "").strip(" <>")
    leaves = [(kind, start != "" and (p.get("Content-ID") or "").strip(" <>") == start, p) for p in msg.walk() if not p.is_multipart() for kind in [p.get_content_type()]]
    for wanted in _BODY[route]:
        fitting = sorted((leaf for leaf in leaves if leaf[0] == wanted), key=lambda leaf: not leaf[1])
        if fitting and wanted == "text/html":
            return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", _text(fitting[0][2]))).strip()
        if fitting:
            return _text(fitting[0][2])
    return None


def _message(raw: bytes, route: str) -> dict:
    msg = message_from_bytes(raw, policy=policy.default)
    head = lambda k: None if msg[k] is None else str(msg[k])
    return {"subject": head("subject"), "sender": head("from"), "to_addrs": head("to"), "cc_addrs": head("cc"), "date_raw": head("date"), "body": _body(msg, route), "attachments": [p.get_filename() for p in msg.iter_attachments() if p.get_filename()] if msg.is_multipart() else []}


def mailbox_messages(path: str, begin: int, end: int) -> Iterator[bytes]:
    """The messages of a mailbox file whose ``From`` line begins within these bytes, each read to its end.

    Every line that begins so parts messages; within a message it is escaped by ``>``, which
    is taken off again.
    """
    with open(path, "rb") as file:
        file.seek(max(0, begin - 1))
        if begin:
            file.readline()  # a line that began before belongs to the range before
        at, message = file.tell(), None
        for line in file:
            if line.startswith(b"From "):
                if message is not None:
                    yield b"".join(message)
                    message = None
                if at >= end:
                    return
                message = []
            elif message is not None:
                message.append(line[1:] if re.match(rb">+From ", line) else line)
            elif at >= end:
                return
            at += len(line)
        if message is not None:
            yield b"".join(message)


def mail_messages(spark: SparkSession, path: str) -> DataFrame:
    """All messages of the .eml, .emlx, .mht, .mhtml and .mbox files below ``path``, in file order.

    Files are listed by ``document_tree`` (dot-files too) and read in the tasks, mailbox files
    in ranges of ``SPLIT`` bytes. A file that cannot be read gives a row with ``error``; a
    mailbox without messages too.
    """
    split = SPLIT
    blank = dict.fromkeys(f.split(" ")[0] for f in MESSAGE.split(", "))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, suffix, part in zip(batch["file"], batch["suffix"], batch["part"], strict=True):
                rows, full = [], os.path.join(path, file)
                try:
                    if suffix == ".mbox":
                        contents = list(mailbox_messages(full, part * split, (part + 1) * split))
                    else:
                        with open(full, "rb") as source:
                            contents = [source.read()]
                    if suffix == ".emlx" and contents[0][:12].split(b"\n")[0].strip().isdigit():
                        contents = [contents[0].split(b"\n", 1)[1]]
                    route = "archive" if suffix in (".mht", ".mhtml") else "mail"
                    rows = [{"path": file, "pos": k, **_message(raw, route), "error": None} for k, raw in enumerate(contents)]
                except Exception as e:  # one broken file must not fail the job
                    rows = [blank | {"path": file, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(rows, columns=list(blank), dtype=object).assign(part=part)

    files = document_tree(spark, path).where(F.col("suffix").isin(*MAIL_SUFFIXES))
    last = F.when(F.col("suffix") == ".mbox", F.expr(f"length div {split}")).otherwise(0).cast("int")
    parts = files.select("file", "suffix", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    rows = cut_lineage(parts.repartition("file", "part").mapInPandas(read, MESSAGE + ", part int"))
    counts = rows.where("error is null").groupBy("path", "part").agg(F.count("*").alias("n"))
    before = counts.select("path", "part", (F.sum("n").over(Window.partitionBy("path").orderBy("part")) - F.col("n")).cast("int").alias("before"))
    placed = rows.join(before, ["path", "part"], "left").withColumn("pos", F.col("pos") + F.col("before"))
    none = files.where("suffix = '.mbox'").join(rows.select(F.col("path").alias("file")).distinct(), "file", "left_anti")
    empty = none.select(*(F.col("file").alias(c) if c == "path" else F.lit("no messages found").alias(c) if c == "error" else F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in MESSAGE.split(", "))))
    return placed.select(*blank).unionByName(empty)


def read_index(spark: SparkSession, path: str, value: str) -> DataFrame:
    """An index file (CSV with the columns ``file`` and ``value``) with each row's position; no rows if it is missing."""
    if not os.path.exists(path):
        return spark.createDataFrame([], f"file string, {value} string, row_no bigint")
    rows = spark.read.csv(path, header=True, schema=f"file string, {value} string", multiLine=True, escape='"')
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def write_index(index: DataFrame, path: str, columns: list[str]) -> bool:
    """Writes an index as one CSV file with CRLF line ends, sorted by file; true if its bytes changed.

    Rows stream from the sorted table one partition at a time; the file is replaced at once,
    and left alone if nothing changed.
    """
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with open(fd, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(columns)
        for row in index.select(*columns).orderBy(columns[0]).toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
    if os.path.exists(path) and os.path.getsize(path) == os.path.getsize(temporary):
        with open(path, "rb") as a, open(temporary, "rb") as b:
            if all(x == y for x, y in zip(iter(lambda: a.read(1 << 20), b""), iter(lambda: b.read(1 << 20), b""), strict=False)):
                os.remove(temporary)
                return False
    os.replace(temporary, path)
    return True


