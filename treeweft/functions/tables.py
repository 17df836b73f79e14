"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@udtf
class NewickEdges:
    """newick_edges(TABLE(t)): the edges of the trees in ``t``, by a table argument with the columns ``tumour`` and ``text``.

    Rows of one tumour go to one call, in order of a column ``position`` if there is one; a tree is as long as a task can hold.
    The tumour keeps its own type. Null texts hold nothing.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f for f in rows.dataType.fields} if rows.isTable else {}
        if not {"tumour", "text"} <= set(fields):
            raise ValueError("newick_edges takes a table with the columns tumour and text")
        out = T.StructType([T.StructField("tumour", fields["tumour"].dataType)])
        out = out.add("parent", "string").add("child", "string").add("length", "double")
        order = [OrderingColumn("position")] if "position" in fields else []
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("tumour")], orderBy=order)

    def __init__(self):
        self.tumour, self.parts = None, []

    def eval(self, row):
        self.tumour = row["tumour"]
        if row["text"] is not None:
            self.parts.append(row["text"])

    def terminate(self):
        from treeweft.sources.newick import parse_tree

        for text in "".join(self.parts).split(";"):
            for _, parent, child, length in parse_tree(text + ";", self.tumour) if text.strip() else ():
                yield self.tumour, parent, child, length


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("newick_edges", NewickEdges)
