"""Records of JSON documents of any size, without a whole document in one place.

Documents are read as pieces that end at closing braces, which Spark streams, and
a walker follows quotes and brackets from piece to piece; it holds one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'["{}\[\]]')
_IN_STRING = re.compile(r'["\\]')
#: Records that leave a task at once.
BATCH = 1000


class Walker:
    """Follows one document after another; gives the texts of records as they end.

    A document is an object whose ``name`` is an array of records, an array of
    them, or else a record itself, which is held whole. What isn't an object is no
    record, and neither is one that breaks off.
    """

    def __init__(self, name: str = "Records"):
        self.name = name
        self._begin()

    def _begin(self) -> None:
        self.depth, self.in_string, self.skip, self.level = 0, False, 0, 0
        self.array = self.found = False
        self.parts: list[str] | None = None  # of the record that is open
        self.whole: list[str] | None = None  # of a document that may be a record itself
        self.key: list[str] | None = None
        self.last_key = ""

    def feed(self, text: str) -> Iterator[str]:
        i, since, whole_since, key_since = self.skip, 0, 0, 0
        self.skip = 0
        while True:
            m = (_IN_STRING if self.in_string else _TOKEN).search(text, i)
            if not m:
                break
            at, c, i = m.start(), m[0], m.end()
            if self.in_string:
                if c == "\\":
                    i += 1
                else:
                    self.in_string = False
                    if self.key is not None:
                        self.last_key, self.key = "".join([*self.key, text[key_since:at]]), None
            elif c == '"':
                self.in_string = True
                if self.depth == 1 and not self.array:
                    self.key, key_since = [], i
            elif c in "{[":
                if not self.depth:
                    self.array = c == "["
                    self.level = 1 if self.array else 0
                    if not self.array:
                        self.whole, whole_since = [], at
                elif self.depth == 1 and not self.array and c == "[" and self.last_key == self.name:
                    self.level, self.found, self.whole = 2, True, None
                elif self.level and self.depth == self.level and c == "{" and self.parts is None:
                    self.parts, since = [], at
                self.depth += 1
            else:
                self.depth -= 1
                if self.parts is not None and self.depth == self.level:
                    yield "".join([*self.parts, text[since:i]])
                    self.parts = None
                elif self.level == 2 and self.depth == 1:
                    self.level = 0  # the array's end
                if self.depth <= 0:
                    if self.whole is not None:
                        yield "".join([*self.whole, text[whole_since:i]])
                    self._begin()
        self.skip = max(0, i - len(text))
        for open_, start in ((self.parts, since), (self.whole, whole_since), (self.key, key_since)):
            if open_ is not None:
                open_.append(text[start:])


def _walk(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[str] = []
        file, walker, held, read, size = None, Walker(name), None, 0, 0

        def last() -> Iterator[str]:
            """The file's last piece, which may lack the brace that ends the others; a packed file doesn't tell."""
            if held is not None:
                yield from walker.feed(held + ("" if read == size + 1 and not file.endswith(".gz") else "}"))

        for batch in batches:
            for f, value, n, length in zip(*(batch.column(c).to_pylist() for c in ("file", "value", "n", "size"))):
                if f != file:
                    out += last()
                    file, walker, held, read, size = f, Walker(name), None, 0, length
                if held is not None:
                    out += walker.feed(held + "}")
                held, read = value, read + n + 1
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["raw"])
                    out = []
        out += last()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["raw"])

    return run


def json_records(spark: SparkSession, path: str | list[str], name: str = "Records", glob: str = "*") -> DataFrame:
    """raw: the JSON text of each record of the documents at path, gzip included, of files whose names a pattern fits.

    Files that Spark may split are put in order by file first, smaller ones are
    walked where they are read. Broken documents give the records before the
    break.
    """
    info = F.col("_metadata")
    pieces = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).text(path, recursiveFileLookup=True).select(
        "value", F.octet_length("value").alias("n"), info["file_path"].alias("file"), info["file_size"].alias("size"), info["file_block_start"].alias("start")
    )
    conf = spark._jsparkSession.sessionState().conf()
    whole = min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())
    small = pieces.filter(F.col("size") <= whole).select("file", "value", "n", "size")
    large = pieces.filter(F.col("size") > whole).withColumn("place", F.monotonically_increasing_id())
    large = large.repartition("file").sortWithinPartitions("file", "start", "place").select("file", "value", "n", "size")
    raw = small.mapInArrow(_walk(name), "raw string").unionByName(large.mapInArrow(_walk(name), "raw string"))
    return raw.select(F.to_json(F.try_parse_json("raw")).alias("raw")).filter("raw IS NOT NULL")
