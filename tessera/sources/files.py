"""Text and binary sources: a converter registry over Spark's binary reader, and a content-addressed sink."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from ..functions import text

CONVERTERS: dict[str, Callable[[bytes], str]] = {}


def register_converter(ending: str, convert: Callable[[bytes], str]) -> None:
    """convert turns a file's bytes into text, or raises."""
    CONVERTERS[ending.lower()] = convert


def _plain(data: bytes) -> str:
    return data.decode("utf-8")


def _docx(data: bytes) -> str:
    """Paragraphs of a word-processing package, by the standard library alone."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(w + "t")) for p in root.iter(w + "p"))


def _pdf(data: bytes) -> str:
    import io

    from pypdf import PdfReader  # not part of the environment: gated by the import

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


for _ending, _convert in ((".txt", _plain), (".md", _plain), (".docx", _docx), (".pdf", _pdf)):
    register_converter(_ending, _convert)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, text, unreadable, error, checksum of every file below path whose ending has a converter.

    Text is NFC with NUL characters replaced; unreadable counts them and is null where nothing was read.
    """
    book = dict(CONVERTERS)

    def convert(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for p, data in zip(paths, contents, strict=True):
            try:
                rows.append((book[p[p.rfind(".") :].lower()](bytes(data)), None))
            except Exception as e:  # a converter's own failure is the file's error, not the job's
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    known = files.filter(ending.isin(*book)).select("path", F.when(ending.isin(".txt", ".md"), "text").otherwise("binary").alias("kind"), F.pandas_udf(convert, "text string, error string")("path", "content").alias("r"))
    clean = known.select("path", "kind", text.sanitize(F.col("r.text")).alias("s"), F.col("r.text").isNotNull().alias("read"), "r.error")
    out = clean.select(text.nfc(F.col("path")).alias("path"), "kind", text.nfc(F.col("s.text")).alias("text"), F.when(F.col("read"), F.col("s.nulls")).alias("unreadable"), "error")
    return out.withColumn("checksum", F.sha2("text", 256))


def new_artifacts(sources: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Sources whose (path, checksum) is not stored: writing them twice adds nothing."""
    fresh = sources.filter(F.col("error").isNull()).dropDuplicates(["path", "checksum"])
    return fresh if stored is None else fresh.join(stored.select("path", "checksum").distinct(), ["path", "checksum"], "left_anti")


#: The session's setting that lets Python sources apply filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: SQL types of a SQLite column by what its declared type holds, in this order; others are strings.
SQLITE_TYPES = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))


def _open(path: str):
    import sqlite3
    from contextlib import closing

    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _SqliteReader(DataSourceReader):
    """Ranges of rowid with equal numbers of rows, whatever gaps the rowids have."""

    def __init__(self, path: str, table: str, columns: list[str], pieces: int):
        self.path, self.table, self.columns, self.pieces = path, table, columns, pieces
        self.where, self.values = [], []

    def _clause(self, *more: str) -> str:
        return " WHERE " + " AND ".join([*self.where, *more]) if self.where or more else ""

    def partitions(self):
        with _open(self.path) as db:
            n, last = db.execute(f'SELECT count(*), max(rowid) FROM "{self.table}"{self._clause()}', self.values).fetchone()
            if not n:
                return [_Rows(0, -1)]
            step = -(-n // self.pieces)
            numbered = f'SELECT rowid AS r, row_number() OVER (ORDER BY rowid) - 1 AS k FROM "{self.table}"{self._clause()}'
            starts = [r for (r,) in db.execute(f"SELECT r FROM ({numbered}) WHERE k % {step} = 0 ORDER BY r", self.values)]
        return [_Rows(lo, hi - 1) for lo, hi in zip(starts, [*starts[1:], last + 1], strict=True)]

    def read(self, partition):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with _open(self.path) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}"{self._clause("rowid BETWEEN ? AND ?")}', [*self.values, *partition.value])


#: Spark's filters by the SQL of the same meaning.
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _PushingReader(_SqliteReader):
    """The reader that lets SQLite apply filters: null tests, equality of numbers and strings, order of numbers.

    Both engines mean the same by these: strings are compared by bytes, and the order of strings, which depends on
    the file's encoding, stays Spark's.
    """

    def __init__(self, *args, kinds: dict[str, str]):
        super().__init__(*args)
        self.kinds = kinds

    def _term(self, column: str, value, ordered: bool) -> bool:
        number = self.kinds.get(column) in ("long", "double") and isinstance(value, (int, float)) and not isinstance(value, bool) and value == value
        return number or (not ordered and self.kinds.get(column) == "string" and isinstance(value, str))

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            name = f'"{column}" COLLATE BINARY'
            if column not in self.kinds:
                yield f
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"\"{column}\" IS {'' if isinstance(f, IsNull) else 'NOT '}NULL")
            elif type(f) in _COMPARED and self._term(column, f.value, not isinstance(f, EqualTo)):
                self.where.append(f"{name} {_COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and f.value and all(self._term(column, v, False) for v in f.value):
                self.where.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values += list(f.value)
            else:
                yield f


class SqliteSource(DataSource):
    """Spark source "sqlite": a table of a SQLite file that every executor can open, read-only, by ranges of rowid.

    Options: path, table, pieces, into how many ranges of equal numbers of rows the table is cut (8), and pushdown,
    whether SQLite applies the filters that it can; Spark refuses it while spark.sql.python.filterPushdown.enabled
    is false.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> str:
        table = self.options["table"]
        if not table.isidentifier():
            raise ValueError(f"no table name: {table}")
        return table

    def _kinds(self) -> dict[str, str]:
        with _open(self.options["path"]) as db:
            rows = db.execute(f'PRAGMA table_info("{self._table()}")').fetchall()
        if not rows:
            raise ValueError(f"no table {self._table()}")
        kind = lambda t: next((to for part, to in SQLITE_TYPES if part in (t or "").upper()), "string")
        return {r[1]: kind(r[2]) for r in rows}

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self._kinds().items())

    def reader(self, schema):
        args = (self.options["path"], self._table(), schema.names, int(self.options.get("pieces", 8)))
        return _PushingReader(*args, kinds=self._kinds()) if self.options.get("pushdown", "false").lower() == "true" else _SqliteReader(*args)


def read_sqlite(spark: SparkSession, path: str, table: str, pieces: int = 8) -> DataFrame:
    """A table of a SQLite file, read by the executors. SQLite filters where the session allows it to."""
    spark.dataSource.register(SqliteSource)
    pushed = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("sqlite").option("path", path).option("table", table).option("pieces", pieces).option("pushdown", pushed).load()


def write_whole(path: str, text: str) -> None:
    """Writes a small driver-side file so that readers see the old or the new text, never a part."""
    import os
    import tempfile

    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".new-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def query_text(questions: DataFrame) -> str:
    """The query file's text: the queries of translated questions by id. As long as what people asked."""
    rows = questions.filter((F.col("status") == "translated") & F.col("query_dl").isNotNull()).select("id", "query_dl").orderBy("id").collect()
    return "\n".join(r["query_dl"].rstrip() for r in rows) + ("\n" if rows else "")


def read_query(path: str) -> str:
    """The text of a query file; an absent one asks nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return ""
