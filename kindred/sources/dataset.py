"""A data source over folders of jobs, schemas, records and cue texts.

The layout: ``schemas/*.json``; ``jobs/<folder>/job.json`` and ``records.json``;
``**/*.vtt``. Folders are dealt to partitions by name alone, and a partition
reads its own files, so that listing is all that the driver does. A job counts
if both of its files are there and can be read; other files that are bad are
left out. Filters on ids are pushed down: a job's records, the bulk of the
bytes, are opened only if its id is wanted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from kindred.sources.package import ship

TABLES = {
    "jobs": "job_id string, schema_id string, name string, status string, completed_at string, body string",
    "schemas": "schema_id string, fields array<string>, body string",
    "records": "job_id string, result_index long, page_url string, data string",
    "texts": "ref string, text string",
}
_KEY = {"jobs": "job_id", "records": "job_id", "schemas": "schema_id", "texts": "ref"}


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _list(store, path: str, recursive: bool = False) -> list:
    from pyarrow import fs

    return store.get_file_info(fs.FileSelector(path, recursive=recursive, allow_not_found=True))


def _read(store, path: str) -> bytes | None:
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except (OSError, FileNotFoundError):
        return None


def _parsed(data: bytes | None, kind: type):
    """The JSON value if it is of the kind asked for, else None."""
    try:
        got = json.loads(data) if data is not None else None
    except ValueError:
        return None
    return got if isinstance(got, kind) else None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class DatasetReader(DataSourceReader):
    def __init__(self, path: str, table: str, chunk: int):
        self.path, self.table, self.chunk, self.wanted = path, table, chunk, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (_KEY[self.table],):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f  # Spark tests it

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _fs(self.path)
        if self.table == "schemas":
            names = [i.path for i in _list(store, f"{root}/schemas") if i.path.endswith(".json")]
        elif self.table == "texts":
            names = [i.path for i in _list(store, root, recursive=True) if i.path.endswith(".vtt")]
        else:
            names = [i.path for i in _list(store, f"{root}/jobs") if i.type == fs.FileType.Directory]
        names.sort()
        return [Files(names[i : i + self.chunk]) for i in range(0, len(names), self.chunk)] or [Files([])]

    def _rows_of(self, store, name: str) -> Iterator[tuple]:
        if self.table == "texts":
            ref = name.rpartition("/")[2].removesuffix(".vtt")
            if self.wanted is None or ref in self.wanted:
                data = _read(store, name)
                try:
                    yield ref, data.decode("utf-8") if data is not None else None
                except UnicodeDecodeError:
                    yield ref, None
        elif self.table == "schemas":
            s = _parsed(_read(store, name), dict)
            if s and "id" in s and (self.wanted is None or _text(s["id"]) in self.wanted):
                fields = [f["name"] for f in s.get("fields") or [] if isinstance(f, dict) and f.get("name")]
                yield _text(s["id"]), fields, json.dumps(s)
        else:
            job = _parsed(_read(store, f"{name}/job.json"), dict)
            if not job or "id" not in job or (self.wanted is not None and _text(job["id"]) not in self.wanted):
                return
            records = _parsed(_read(store, f"{name}/records.json"), list)
            if records is None:
                return
            job_id = _text(job["id"])
            if self.table == "jobs":
                yield job_id, _text((job.get("extraction_config") or {}).get("schema_id")), _text(job.get("name")), _text(job.get("status")), _text(job.get("completed_at")), json.dumps(job)
            else:
                for i, r in enumerate(records):
                    r = r if isinstance(r, dict) else {}
                    data = r.get("data", r)
                    yield job_id, i, _text(r.get("page_url")), data if isinstance(data, str) else json.dumps(data)

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _fs(self.path)
        for name in partition.names:
            yield from self._rows_of(store, name)


class DatasetSource(DataSource):
    """Options: path, table (a key of TABLES) and chunk, the number of folders or files of a partition."""

    @classmethod
    def name(cls) -> str:
        return "job_dataset"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> DatasetReader:
        return DatasetReader(self.options["path"].rstrip("/"), self.options["table"], int(self.options.get("chunk", "64")))


def dataset(spark: SparkSession, path: str, table: str, chunk: int = 64) -> DataFrame:
    """A table of the folders under ``path``: jobs, schemas, records in their order (result_index), or texts. ``path`` must be one that executors reach."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DatasetSource)
    return spark.read.format("job_dataset").option("table", table).option("chunk", chunk).load(path)
