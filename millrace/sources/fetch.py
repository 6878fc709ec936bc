"""Files that requests name, read under limits: tasks are planned by the listed sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from millrace.sources.inputs import allowed_address, data_uri_bytes, data_uri_mime
from millrace.sources.stores import files_below, store

#: A file, or one that was refused by its listed size (``error`` set, nothing read).
FOUND = "path string, length long, content binary, error string"
#: Fixed value: bytes of the largest file that is read unless told otherwise.
FILE_BYTES = 100 << 20
#: Bytes that one task reads at most, of several files.
TASK_BYTES = 256 << 20
#: Addresses that go to the reader as a list; with more of them all files under the roots are read.
LISTED = 10_000


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)


def planned(files: list[tuple[str, int]], most: int, task: int) -> list[list[tuple[str, int]]]:
    """Files in groups of at most ``task`` bytes (or one file); refused ones weigh nothing but
    are at most 10,000 a group."""
    groups: list[list[tuple[str, int]]] = []
    room = 0
    for path, size in files:
        weight = size if size <= most else 0
        if not groups or weight > room or len(groups[-1]) >= 10_000:
            groups.append([])
            room = task
        groups[-1].append((path, size))
        room -= weight
    return groups


def _prefix(root: str) -> str:
    """What stands before the paths that a store lists: the scheme, for other than local ones."""
    scheme = re.match(r"^([a-z][a-z0-9+.-]*)://", root)
    return "" if scheme is None or scheme[1] == "file" else scheme[0]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["roots"].split("\n")
        self.most, self.task, self.tests = int(options["filebytes"]), int(options["taskbytes"]), []

    def pushFilters(self, filters):
        """Paths are chosen before anything is read."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((type(f).__name__, f.value if not isinstance(f, In) else frozenset(f.value)))
            else:
                yield f

    def partitions(self):
        wanted = lambda p: all(p == v if k == "EqualTo" else p in v if k == "In" else p.startswith(v) for k, v in self.tests)
        found = {_prefix(root) + path: size for root in self.roots for path, size in files_below(root) if wanted(_prefix(root) + path)}
        return [_Files(g) for g in planned(sorted(found.items()), self.most, self.task)]

    def read(self, partition):
        for path, size in partition.value if partition is not None else []:
            if size > self.most:
                yield (path, size, None, f"larger than {self.most} bytes")
                continue
            system, at = store(path)
            with system.open_input_file(at) as file:
                content = file.read(self.most + 1)  # a file can have grown since it was listed
            yield (path, size, None, f"larger than {self.most} bytes") if len(content) > self.most else (path, len(content), content, None)


class LimitedFiles(DataSource):
    """``format("limited_files")``. Options: roots (folders, a line each), fileBytes, taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "limited_files"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema):
        return _Reader({"roots": self.options["roots"], "filebytes": self.options.get("fileBytes", FILE_BYTES), "taskbytes": self.options.get("taskBytes", TASK_BYTES)})


def read_files(spark: SparkSession, roots: list[str], file_bytes: int = FILE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of FOUND of all files under folders; a filter on path is applied to the listing. Lets
    Python sources take filters in this session."""
    spark.dataSource.register(LimitedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("limited_files").option("roots", "\n".join(r.rstrip("/") for r in roots)).option("fileBytes", file_bytes).option("taskBytes", task_bytes).load()


def local_path(url: Column) -> Column:
    """Path as the reader lists it: ``file:`` addresses without their scheme, others as they are."""
    return F.regexp_replace(url, "^(?i:file):(//)?(?=/)", "")


def fetch(requests: DataFrame, roots: list[str], file_bytes: int = FILE_BYTES, task_bytes: int = TASK_BYTES, url_col: str = "url") -> DataFrame:
    """The requests with (mime_type, content, error): bytes of data URIs and of files under the
    allowed folders, or the reason why there are none.

    Reasons: an empty address, a data URI that cannot be decoded, an address of the network
    (refused, or not reached from here), a relative part, a folder that is not allowed, a
    file that is not there or larger than ``file_bytes`` (known from the listing, so never
    read). Each file is read once however many requests name it; it then goes to each.
    Rows keep their order of columns; ``mime_type`` is known for data URIs only."""
    spark = requests.sparkSession
    url = F.col(url_col)
    path = local_path(url)
    inside = F.lit(False)
    for root in roots:
        base = _prefix(root) + store(root)[1].rstrip("/")
        inside = inside | path.startswith(base + "/")
    data, web = url.startswith("data:"), F.regexp(url, F.lit("(?i)^[a-z][a-z0-9+.-]*:")) & F.regexp(url, F.lit("(?i)^https?:"))
    inline = F.when(data, data_uri_bytes(url))
    reason = (
        F.when(F.coalesce(url, F.lit("")) == "", "empty address")
        .when(data & inline.isNull(), "invalid data URI")
        .when(data & (F.octet_length(inline) > file_bytes), f"larger than {file_bytes} bytes")
        .when(web & ~allowed_address(url), "address not allowed")
        .when(web, "no network here")
        .when(~data & F.regexp(path, F.lit("(^|/)\\.\\.?(/|$)")), "relative path")
        .when(~data & ~inside, "outside the allowed folders")
    )
    names = [f"`{c}`" for c in requests.columns]
    judged = requests.select(F.struct(*names).alias("row"), F.when(reason.isNull() & ~data, path).alias("wanted"), data_uri_mime(url).alias("mime_type"),
                             F.when(reason.isNull(), inline).alias("inline"), reason.alias("reason"))
    files = read_files(spark, roots, file_bytes, task_bytes)
    named = judged.where("wanted is not null").select("wanted").distinct().limit(LISTED + 1).collect()
    if len(named) <= LISTED:
        files = files.where(F.col("path").isin([r.wanted for r in named]))
    out = judged.join(files.select(F.col("path").alias("wanted"), "content", "error"), "wanted", "left")
    lost = F.when(F.col("wanted").isNotNull() & F.col("content").isNull(), F.coalesce("error", F.lit("not found")))
    return out.select("row.*", "mime_type", F.coalesce("inline", "content").alias("content"), F.coalesce("reason", lost).alias("error"))
