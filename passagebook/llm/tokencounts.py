"""Token counts as rollups that are kept up by deltas.

A count is a row (source, lang, tokenizer, tokens) of one document under one version of a
tokenizer. Changes are such rows with a sign: +1 inserted, -1 deleted, and for a revised
count the old row with -1 and the new one with +1. A batch of changes is summed by source,
language and tokenizer version; totals are the sums over all committed batches, so nothing
is ever counted anew.

A batch has an id. Its sums are written to a folder of this attempt's own, and then a marker
under the batch's name, which says whose sums count. A marker is made whole under another name
and renamed, which fails where one is there: of two writers of a batch one wins, and the sums
of the other are never read. A batch without a marker does not count.

compact() folds batches into a generation: the sums of those it has listed, and of the
generation before, with a table of their names. A generation's marker is exclusive as well,
so of two compactions at once only one counts; a batch that is committed meanwhile is not
among the names and counts beside the generation. Readers take the last generation they see
and all batches it does not name. vacuum() removes what the last generation but one had
folded already, which only a reader older than that could still need.

Defined results: a null source, language or tokenizer is a group of its own; null tokens
count as none, of a document all the same. Groups without documents and tokens have no row.
Repeated rows count each. Empty batches can be committed. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.sources.session import materialize

KEYS = ["source", "lang", "tokenizer"]
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_DELTA = f"{_SUMS}, attempt string"
_MARKER = "batch string, attempt string"
_GENERATION = "generation long, attempt string"


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*[F.col(k).cast("string").alias(k) for k in KEYS], F.col("tokens").cast("long").alias("tokens"), F.lit(sign).alias("sign"))


def inserted(counts: DataFrame) -> DataFrame:
    return signed(counts, 1)


def deleted(counts: DataFrame) -> DataFrame:
    return signed(counts, -1)


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Equal rows of before and after cancel each other in the sums; no join is needed."""
    return deleted(before).unionByName(inserted(after))


class Rollup:
    """The totals in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> Rollup:
        own = cls(spark, folder)
        for kind in ("commits", "generations", "deltas", "folds"):
            fs, path = own._path(kind)
            fs.mkdirs(path)
        return own

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _mark(self, kind: str, name: str, content: dict) -> bool:
        """A marker of this name, whole and once; False if there is one already."""
        jvm = self.spark._jvm
        fs, path = self._path(f"{kind}/{name}")
        if fs.exists(path):
            return False
        _, draft = self._path(f"{kind}/_{uuid.uuid4().hex}")  # readers pass over such names
        out = fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, path, never_over)
        except Py4JJavaError as failure:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in failure.java_exception.getClass().getName():
                return False
            raise
        return True

    @staticmethod
    def _name(batch: str) -> str:
        return hashlib.sha256(batch.encode()).hexdigest()[:32]

    def commits(self) -> DataFrame:
        """(batch, attempt) of the markers there are now."""
        return self.spark.read.schema(_MARKER).json(f"{self.folder}/commits")

    def generation(self) -> tuple[int, str | None]:
        """The last generation and whose sums it counts; 0 before the first."""
        last = self.spark.read.schema(_GENERATION).json(f"{self.folder}/generations").orderBy(F.desc("generation")).first()
        return (last.generation, last.attempt) if last else (0, None)

    def _folded(self, attempt: str | None) -> DataFrame:
        if attempt is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/folds/{attempt}")

    def committed(self, batch: str) -> bool:
        fs, path = self._path(f"commits/{self._name(batch)}")
        return fs.exists(path) or not self._folded(self.generation()[1]).filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed counts; False if its id is known and nothing was done."""
        if not batch:
            raise ValueError("a batch needs an id")
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("n_tokens")
        )
        return self._mark("commits", self._name(batch), {"batch": batch, "attempt": self._write(sums)})

    def _write(self, sums: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        sums.select(*KEYS, "n_docs", "n_tokens").coalesce(1).write.parquet(f"{self.folder}/deltas/attempt={attempt}")
        return attempt

    def _live(self, attempt: str | None) -> DataFrame:
        """(batch, attempt) of the batches that this generation does not name."""
        return self.commits().join(self._folded(attempt), "batch", "left_anti")

    def _sums(self, live: DataFrame, attempt: str | None) -> DataFrame:
        counted = live.select("attempt").unionByName(self.spark.createDataFrame([(attempt,)] if attempt else [], "attempt string"))
        rows = self.spark.read.schema(_DELTA).parquet(f"{self.folder}/deltas").join(counted, "attempt", "left_semi")
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens)."""
        attempt = self.generation()[1]
        return self._sums(self._live(attempt), attempt)

    def compact(self) -> bool:
        """Folds the batches there are into a new generation; False if there was nothing to fold,
        or another compaction was first. Folded batches stay known by their ids."""
        number, attempt = self.generation()
        # Listed once: sums and names speak of the same batches.
        live = materialize(self._live(attempt), "rollup-live")
        if live.isEmpty():
            return False
        new = self._write(self._sums(live, attempt))
        self._folded(attempt).unionByName(live.select("batch")).write.parquet(f"{self.folder}/folds/{new}")
        return self._mark("generations", f"{number + 1:012d}", {"generation": number + 1, "attempt": new})

    def vacuum(self) -> int:
        """Removes sums and markers of the batches that the last generation but one had folded,
        and what generations before it kept; the number of batches removed."""
        made = self.spark.read.schema(_GENERATION).json(f"{self.folder}/generations").orderBy(F.desc("generation"))
        before = [r.attempt for r in made.limit(2).toLocalIterator()][1:]
        if not before:
            return 0
        old = materialize(self.commits().join(self._folded(before[0]), "batch", "left_semi"), "rollup-old")
        gone = 0
        for row in old.toLocalIterator():  # the batches of one generation, each of which a driver has committed
            for name in (f"deltas/attempt={row.attempt}", f"commits/{self._name(row.batch)}"):
                fs, path = self._path(name)
                fs.delete(path, True)
            gone += 1
        for row in made.offset(2).toLocalIterator():
            for name in (f"deltas/attempt={row.attempt}", f"folds/{row.attempt}", f"generations/{row.generation:012d}"):
                fs, path = self._path(name)
                fs.delete(path, True)
        return gone


#: Versions of a plain tokenizer: runs without white space, then runs of ASCII letters and
#: digits, and any other sign by itself.
TOKENIZERS = {"words/1": r"[^\x20\x09-\x0D]+", "words/2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def tokens(text: Column, tokenizer: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKENIZERS[tokenizer]))
