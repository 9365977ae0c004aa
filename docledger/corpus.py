"""One entry point for a corpus: the operators bound to its tables.

    corpus = Corpus.ingest(spark.table("pages"), "html", text_col="html", id_col="page_id")
    corpus.extract(); corpus.validate(); corpus.redact(targets).extract()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators import disclosure, forms, merkle, store, tree, validate
from docledger.sinks import container
from docledger.sources import corpus as reader


class Corpus:
    """A node table ``(doc_id, path, ord, depth, kind, text, ...)`` and what follows from it."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    @classmethod
    def ingest(cls, df: DataFrame, fmt: str, text_col: str = "text", id_col: str = "doc_id") -> Corpus:
        """Documents in a registered format; ``lines`` takes each line as a block."""
        if fmt == "lines":
            return cls(tree.nodes_of_lines(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
        return cls(reader.ingest(df, fmt, text_col, id_col))

    @classmethod
    def migrate(cls, spark: SparkSession, folder: str) -> Corpus:
        return cls(reader.migrate(spark, folder))

    def objects(self) -> DataFrame:
        """Blocks with text as content-addressed objects."""
        data = F.concat_ws("\x1f", "kind", "text").cast("binary")
        rows = self.nodes.where("text is not null")
        return rows.select("doc_id", "ord", F.sha2(data, 256).alias("object_id"), data.alias("bytes"), F.octet_length(data).cast("bigint").alias("n_bytes"))

    def info(self) -> DataFrame:
        return store.info(self.objects())

    def dedup_report(self) -> DataFrame:
        return store.dedup_report(self.objects())

    def extract(self) -> DataFrame:
        return tree.extract(self.nodes)

    def search(self, needle: str) -> DataFrame:
        return tree.matches(self.nodes, needle)

    def failures(self) -> DataFrame:
        """Documents that could not be read."""
        return self.nodes.where("depth = 0 and error is not null").select("doc_id", "error") if "error" in self.nodes.columns else self.nodes.select("doc_id").where("false").withColumn("error", F.lit(None).cast("string"))

    def validate(self) -> DataFrame:
        """Findings of the rules that a node table alone can answer."""
        unread = self.failures().select("doc_id", F.lit("root").alias("part"), F.col("error").alias("problem"))
        nodes = self.nodes
        for name, kind in (("alt", "string"), ("decorative", "boolean"), ("res_id", "string")):
            if name not in nodes.columns:
                nodes = nodes.withColumn(name, F.lit(None).cast(kind))
        known = nodes.where("res_id is not null").select("doc_id", "res_id").distinct()
        return validate.report(validate.root_kind(nodes), validate.undecodable(unread), validate.figures(nodes, known), validate.emptiness(nodes.withColumn("items", F.lit(1))))

    def verdicts(self) -> DataFrame:
        return validate.roll_up(self.nodes.select("doc_id").distinct(), self.validate())

    def diff(self, other: Corpus) -> DataFrame:
        """Objects shared, added and removed on the way to another corpus."""
        return store.object_diff(self.objects(), other.objects())

    def redact(self, targets: DataFrame) -> Corpus:
        return Corpus(disclosure.redact(self.nodes, targets))

    def seal(self, salts: DataFrame | None = None) -> DataFrame:
        return disclosure.seal(self.nodes, salts)

    def disclose(self, wanted: DataFrame, salts: DataFrame | None = None) -> DataFrame:
        return disclosure.disclose(self.seal(salts), self.nodes, wanted, salts)

    def verify_disclosure(self, bundles: DataFrame, salts: DataFrame | None = None) -> DataFrame:
        return disclosure.verify_disclosure(bundles, disclosure.roots(self.seal(salts)))

    def pack(self) -> DataFrame:
        """A container file for each document."""
        return container.pack(self.objects().select("doc_id", "bytes"))

    def log(self) -> DataFrame:
        """A transparency log of the documents' roots, in the order of their ids."""
        roots = disclosure.roots(self.seal()).select("doc_id", F.unhex("root").alias("entry"))
        return merkle.append(roots, ["doc_id"])

    fill, flatten, violations = staticmethod(forms.fill), staticmethod(forms.flatten), staticmethod(forms.violations)
