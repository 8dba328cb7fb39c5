"""A stored full-text index of documents: built, opened, updated by session, searched by term.

A commit adds a segment of documents and one of postings; what is valid, and the
counts that scores need, stand in its version record, so a search reads the
postings of its terms and nothing else of the text.  Postings lie in folders by
a hash of the term, sorted by term.
"""

from __future__ import annotations

import zlib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.fulltext import UNICODE, tokens
from quern.segments import SEGMENT, Segments

TEXT_FIELDS = ["content", "summary", "solution_summary", "code_content"]
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType(), False), T.StructField("session_id", T.StringType(), False), T.StructField("doc_type", T.StringType(), False),
    T.StructField("source_agent", T.StringType()), T.StructField("project", T.StringType()), T.StructField("model", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("session_type", T.StringType()), T.StructField("timestamp", T.TimestampNTZType()), T.StructField("turn_count", T.LongType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("error_fingerprint", T.ArrayType(T.StringType())), T.StructField("file_paths", T.ArrayType(T.StringType())), T.StructField("git_commits", T.ArrayType(T.StringType())),
    T.StructField("code_language", T.StringType()), T.StructField("code_file_path", T.StringType()), T.StructField("code_is_final", T.BooleanType()),
    *[T.StructField(f, T.StringType()) for f in TEXT_FIELDS],
])
_LENGTHS = [f"n_{f}" for f in TEXT_FIELDS]


def as_documents(df: DataFrame) -> DataFrame:
    """The columns of ``DOCUMENT``, those that are missing as nulls; clashing extra columns are left out."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


class Index(Segments):
    """``Index.create(spark, path, buckets=64, pattern=UNICODE)``, ``Index.open(spark, path)``."""

    kinds = {
        "documents": T.StructType([*DOCUMENT.fields, *[T.StructField(n, T.IntegerType()) for n in _LENGTHS], SEGMENT]),
        "postings": T.StructType([*[T.StructField(c, T.StringType()) for c in ("session_id", "doc_id", "field", "term")], T.StructField("dl", T.IntegerType()), T.StructField("tf", T.LongType()), SEGMENT, T.StructField("bucket", T.IntegerType())]),
    }

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64, pattern: str = UNICODE) -> Index:
        return super().create(spark, path, buckets=buckets, pattern=pattern, docs=0, tokens=dict.fromkeys(TEXT_FIELDS, 0))

    def documents(self) -> DataFrame:
        """The documents that are valid, with the lengths of their text fields."""
        return self.rows("documents")

    def postings(self, terms: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
        """field, term, doc_id, tf, dl.  With ``terms`` only their folders are listed, and only their row groups read."""
        state = self.state()
        rows = self._read("postings", state["segments"])
        if rows is None:
            return self.spark.createDataFrame([], "field string, term string, doc_id string, tf bigint, dl int")
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % state["buckets"] for t in terms})) & F.col("term").isin(*terms)) if terms else rows.where("false")
        if fields is not None:
            rows = rows.where(F.col("field").isin(*fields))
        return self.alive(rows.drop("bucket"), state).select("field", "term", "doc_id", "tf", "dl")

    def vocabulary(self, field: str = "content") -> DataFrame:
        """term, df of a field."""
        return self.postings(fields=[field]).groupBy("term").agg(F.count("*").alias("df"))

    def counts(self) -> tuple[int, dict[str, float]]:
        """Documents, and the average length of each text field (over all documents, as a field that is missing has length 0)."""
        s = self.state()
        return s["docs"], {f: n / s["docs"] if s["docs"] else 0.0 for f, n in s["tokens"].items()}

    def stats(self) -> dict[str, Any]:
        """Documents, segments, files, bytes and fields."""
        return {"docs": self.state()["docs"], **self.size(), "fields": [f.name for f in DOCUMENT.fields]}

    def totals(self) -> dict[str, Any]:
        got = self.documents().agg(F.count("*").alias("docs"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _LENGTHS]).first()
        return {"docs": got["docs"], "tokens": {f: got[f"n_{f}"] for f in TEXT_FIELDS}}

    def write(self, rows: dict[str, DataFrame], n: int) -> None:
        docs, posted = as_documents(rows["documents"]), rows.get("postings")
        state = self.state()
        words = lambda f: tokens(F.coalesce(F.col(f), F.lit("")), state["pattern"])
        docs.withColumns({f"n_{f}": F.size(words(f)) for f in TEXT_FIELDS}).write.mode("overwrite").parquet(self.place("documents", n))
        if posted is None:
            said = F.array(*[F.struct(F.lit(f).alias("field"), words(f).alias("terms")) for f in TEXT_FIELDS])
            stored = self.spark.read.schema(self.kinds["documents"]).parquet(self.place("documents", n))  # what was written, not what it was made from
            each = stored.select("session_id", "doc_id", F.inline(said)).select("session_id", "doc_id", "field", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
            posted = each.groupBy("session_id", "doc_id", "field", "term").agg(F.max("dl").alias("dl"), F.count("*").alias("tf"))
        bucket = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(state["buckets"])).cast("int")
        # by range, so that a term that every document has is spread over many tasks
        by = posted.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term", "doc_id")
        by.write.mode("overwrite").partitionBy("bucket").parquet(self.place("postings", n))

    def add(self, docs: DataFrame) -> None:
        """Add documents; all that the index has of their sessions, artifacts too, gives way to them."""
        self.put({"documents": docs}, "documents")

    def rebuild(self, docs: DataFrame) -> None:
        """Replace everything by these documents."""
        self.replace_all({"documents": docs})


def term_score(idf: Column, tf: Column, dl: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf * (k1 + 1) * tf / (tf + k1 * (1 - b + b * dl / average))
