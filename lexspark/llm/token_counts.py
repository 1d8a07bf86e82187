"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A ledger keeps additive totals.  Every batch of changes (inserted, deleted and revised documents) is turned into signed
rows, summed by (source, lang, tokenizer) and committed under its batch id as one small table; totals are the sum of
the tables that the ledger's manifest names.  A batch counts from the moment that a manifest with its id is there; an id that
is committed already is left as it is, so a replayed batch changes nothing, also after a restart and after tables were folded
into one.  The manifest keeps all batch ids, some 40 bytes each.

Deletes and revisions are signed from the counts that documents entered with (a state table of ids and counts), so
texts are read once per tokenizer version.

Defined results: null texts have 0 tokens; null source and lang are groups of their own; a document that occurs several times
counts each time; a deletion removes every row of its doc_id, and one of a null doc_id removes none; an empty table gives an empty result; groups whose totals are
all 0 are not listed.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.columns import pick, text_of
from lexspark.llm.storage import delete

KEYS = ("source", "lang", "tokenizer")
_ENCODINGS: dict = {}


def _encoding(path: str, pattern: str):
    import tiktoken

    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_words(docs: DataFrame, version: str, pattern: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) where tokens are the matches of a pattern."""
    return pick(docs, "doc_id", "source", "lang", "text").select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.regexp_count(text_of(), F.lit(pattern)).cast("bigint").alias("n_tokens"))


def count_pieces(docs: DataFrame, version: str, ranks: str, pattern: str) -> DataFrame:
    """The same, with a byte-level merge tokenizer from a file of ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(x.as_py() or "")) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    return pick(docs, "doc_id", "source", "lang", "text").mapInArrow(run, "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")


def _signed(counted: DataFrame, sign: int) -> DataFrame:
    return counted.select(*KEYS, F.lit(sign).cast("bigint").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"))


class TokenLedger:
    """Totals under root, a folder that driver and executors share, with one writer at a time or several.

    The manifest lists the batch ids that are committed and the tables that hold their sums.  Every version of it is a file of its
    own, named by its number; it comes into being by renaming a finished file, which fails if the number is taken, so
    a version is whole or not there, and of two writers one has to read and try again.  A table counts only through the
    manifest: what a lost driver wrote without getting to the rename is never read.

    The folder's store must refuse a rename onto a file that is there, as HDFS and POSIX file systems do; on an object store
    whose renames copy and overwrite, two writers at once could lose a commit, so there only one may write.  A version
    holds all batch ids, so n commits write some 20 * n**2 bytes.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def manifest(self) -> dict:
        """The newest version: its number, the committed batch ids, the names of the tables that count."""
        versions = self._names("manifests")
        if not versions:
            return {"version": 0, "batches": [], "tables": []}
        stream = self._fs.open(self._path(f"manifests/{versions[-1]}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, version: int, batches: list[str], tables: list[str]) -> bool:
        """Make this the newest version; False if another writer has made one of that number."""
        whole, name = self._path(f"unfinished/{uuid.uuid4().hex}"), f"manifests/{version:012d}"
        self._fs.mkdirs(self._path("manifests"))
        stream = self._fs.create(whole)
        stream.write(bytearray(json.dumps({"version": version, "batches": batches, "tables": tables}).encode()))
        stream.close()
        if not self._fs.exists(self._path(name)) and self._fs.rename(whole, self._path(name)):
            return True
        self._fs.delete(whole, False)
        return False

    def _save(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/tables/{name}")
        return name

    def committed(self, batch: str) -> bool:
        return batch in self.manifest()["batches"]

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> bool:
        """Apply counted rows; revised is (old, new).  False if the batch was committed before, folded or not."""
        if self.committed(batch):
            return False
        parts = [_signed(df, sign) for df, sign in ((inserts, 1), (deletes, -1), (revised and revised[0], -1), (revised and revised[1], 1)) if df is not None]
        if not parts:
            raise ValueError("a batch without inserts, deletes and revisions")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        name = self._save(rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
        while not self.committed(batch):
            now = self.manifest()
            if self._publish(now["version"] + 1, [*now["batches"], batch], [*now["tables"], name]):
                return True
        delete(self.spark, f"{self.root}/tables/{name}")  # another writer committed the same batch meanwhile
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens)."""
        return self._sum(self.manifest()["tables"])

    def _sum(self, tables: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/tables/{t}" for t in tables]) if tables else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def fold(self) -> None:
        """Replace the tables so far by their sum; the batch ids stay known.  Tables go only after the manifest without them is there."""
        old = self.manifest()["tables"]
        name = self._save(self._sum(old))
        while True:
            now = self.manifest()
            if not set(old) <= set(now["tables"]):  # another writer folded them
                delete(self.spark, f"{self.root}/tables/{name}")
                return
            if self._publish(now["version"] + 1, now["batches"], [name, *(t for t in now["tables"] if t not in old)]):
                break
        for t in old:
            delete(self.spark, f"{self.root}/tables/{t}")

    def clean(self) -> None:
        """Delete what no manifest names, and older manifests.  Only while nobody else writes."""
        now = self.manifest()
        for t in set(self._names("tables")) - set(now["tables"]):
            delete(self.spark, f"{self.root}/tables/{t}")
        for v in self._names("manifests")[:-1]:
            delete(self.spark, f"{self.root}/manifests/{v}")
        delete(self.spark, f"{self.root}/unfinished")
