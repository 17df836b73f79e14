"""Newick text to edges and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweft.functions.vectors import positions, running
from treeweft.operators.tree import intervals
from treeweft.plans.lineage import settled

TOKEN = re.compile(r"'(?:[^']|'')*'|[(),;:]|[^(),;:\s]+")
EDGES = "tumour int, parent string, child string, length double"


def parse_tree(text: str, tumour: int) -> list[tuple[int, str, str, float | None]]:
    """The edges of one tree. Unnamed nodes are called T<tumour>_u<i>."""
    edges, open_, unnamed = [], [], 0
    children: list[tuple[str, float | None]] = []
    label, length, want_length = None, None, False

    def close() -> tuple[str, float | None]:
        nonlocal unnamed
        if label is None:
            unnamed += 1
        return label if label is not None else f"T{tumour}_u{unnamed}", length

    below: list[tuple[str, float | None]] | None = None
    for token in TOKEN.findall(text):
        if token == "(":
            open_.append(children)
            children, label, length, below = [], None, None, None
        elif token in ",);":
            if token != ";" or label is not None or below is not None:
                name, size = close()
                for child, far in below or []:
                    edges.append((tumour, name, child, far))
                children.append((name, size))
            label, length, want_length, below = None, None, False, None
            if token == ")":
                if not open_:
                    raise ValueError("a closing bracket too many")
                below, children = children, open_.pop()
        elif token == ":":
            want_length = True
        elif want_length:
            length, want_length = float(token), False
        else:
            label = token[1:-1].replace("''", "'") if token[0] == "'" else token
    if open_:
        raise ValueError("a bracket stays open")
    return edges


def parse(texts: DataFrame, column: str = "value", number: str | None = None) -> DataFrame:
    """Edges of the forest in a column of Newick text: trees end with ';' and are numbered in order, blank ones are
    no trees. Each row is a forest of its own; its trees are numbered from 0, or all as the column ``number`` says, so
    that a large forest can be a row a tree."""
    cut = F.filter(F.transform(F.split(column, ";"), lambda s: F.trim(s)), lambda s: s != "")
    trees = texts.select(F.posexplode(cut)) if number is None else texts.select(F.col(number).alias("pos"), F.explode(cut))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [e for t, s in zip(frame["pos"], frame["col"], strict=True) for e in parse_tree(s + ";", int(t))]
            yield pd.DataFrame(rows, columns=["tumour", "parent", "child", "length"])

    return trees.mapInPandas(work, EDGES)


def text_rows(edges: DataFrame) -> DataFrame:
    """(tumour, position, text): the forest's Newick text in parts, which follow each other by tumour and position.

    A walk through a tree opens and closes each node; of the 2n places of that walk, a node's are known from its interval. What
    opens a node is a comma, if it isn't the first child, and a bracket, if it has children; what closes it is the
    bracket, its label and its length. No tree is gathered. Children are in order of their labels.
    """
    plain = F.col("node").rlike(r"^[^\s(),:;']+$")
    label = F.when(plain, F.col("node")).otherwise(F.concat(F.lit("'"), F.replace("node", F.lit("'"), F.lit("''")), F.lit("'")))
    name = F.concat(label, F.coalesce(F.concat(F.lit(":"), "length"), F.lit("")), F.when(F.col("parent").isNull(), ";").otherwise(""))
    comma = F.when(F.col("parent").isNotNull() & (F.col("nth") > 0), ",").otherwise("")
    opens, closes = 2 * F.col("entry") - F.col("depth"), 2 * F.col("exit") - F.col("depth") + 1
    parts = F.when(F.col("size") == 1, F.array(F.struct(opens.alias("position"), F.concat(comma, name).alias("text")))).otherwise(
        F.array(
            F.struct(opens.alias("position"), F.concat(comma, F.lit("(")).alias("text")),
            F.struct(closes.alias("position"), F.concat(F.lit(")"), name).alias("text")),
        )
    )
    return intervals(edges).select("tumour", F.explode(parts).alias("p")).select("tumour", "p.position", "p.text")


def serialise(edges: DataFrame) -> DataFrame:
    """(tumour, newick): each tree as one text, for trees that fit into a row; others are ``text_rows``."""
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return text_rows(edges).groupBy("tumour").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("newick"))


STRUCTURE = "(),;"
PART = r"'(?:[^']|'')*'|[(),;]|[^(),;'\s]+"


def parse_parts(rows: DataFrame, column: str, order: list[str], number: str | None = None) -> DataFrame:
    """Edges of the forest whose text ``rows`` hold in parts, in order of ``order``; none of them ends within a label.

    Trees end with ';' and are numbered from 0 in order, blank ones left out, or as the column ``number`` says. No tree is walked by
    one task: running sums over all tokens say how deep each lies and which node it belongs to. A node ends at a comma, a
    closing bracket or a semicolon, and its parent is the one that the next bracket closes which closes the level that it
    lies on: of one tree and level, nodes with k closed brackets before them belong to bracket k. Unnamed nodes are called
    T<tumour>_u<i>. Brackets that don't match, and a last tree without a name or semicolon, are ValueErrors.
    """
    own = [F.col(number).cast("int").alias("_own")] if number else []
    tokens = rows.select(*order, *own, F.posexplode(F.expr(f"regexp_extract_all(`{column}`, r\"{PART}\", 0)")).alias("_i", "t"))
    structural = F.col("t").isin(*STRUCTURE)
    sums = {
        "n": F.lit(1),
        "g": structural.cast("int"),
        "level": F.when(F.col("t") == "(", 1).when(F.col("t") == ")", -1).otherwise(0),
        "ended": (F.col("t") == ";").cast("int"),
    }
    found = running(tokens, [], [*order, "_i"], sums)
    # what lies before a structural token, and that token, are one row: g counts those before it
    found = found.withColumn("g", F.col("g") - structural.cast("int"))
    mark = F.max(F.when(structural, F.col("t"))).alias("mark")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~structural, F.struct("n", "t")))), lambda x: x["t"]), "").alias("body")
    level = F.coalesce(F.max(F.when(structural, F.col("level") + (F.col("t") == ")").cast("int"))), F.max("level")).alias("level")
    tree = F.min(F.col("ended") - (F.col("t") == ";").cast("int")).alias("tree")
    groups = found.groupBy("g").agg(mark, body, level, tree, *([F.min("_own").alias("_own")] if number else []))
    groups = settled(groups.withColumn("mark", F.coalesce("mark", F.lit(";"))))  # a name at the end may lack its semicolon
    wrong = groups.agg(
        F.coalesce(F.min(F.when(F.col("mark") == ")", F.col("level") - 1).otherwise(F.col("level"))), F.lit(0)).alias("least"),
        F.coalesce(F.max(F.when(F.col("mark") == ";", F.col("level"))), F.lit(0)).alias("left"),
        F.max(F.struct("g", "level", "mark")).alias("last"),
    ).head()
    last = wrong["last"]
    if wrong["least"] < 0:
        raise ValueError("a closing bracket too many")
    if wrong["left"] > 0 or (last and last["mark"] != ";" and last["level"] - (last["mark"] == ")") > 0):
        raise ValueError("a bracket stays open")
    if last and last["mark"] != ";":
        raise ValueError("the last tree has no semicolon")
    closed = running(groups, ["tree", "level"], ["g"], {"k": (F.col("mark") == ")").cast("int")})
    closed = closed.withColumn("k", F.col("k") - (F.col("mark") == ")").cast("int"))
    # a closing bracket is followed by the node that it makes
    closed = settled(closed)
    made = closed.filter("mark = ')'").select((F.col("g") + 1).alias("g"), F.lit(True).alias("inner"))
    named = closed.filter("mark <> '('").join(made, "g", "left").filter("mark <> ';' or body <> '' or inner")
    quoted = F.col("body").startswith("'")
    label = F.when(quoted, F.replace(F.regexp_extract("body", r"^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'"))).otherwise(F.regexp_extract("body", "^([^:]*)", 1))
    size = F.regexp_extract(F.regexp_replace("body", r"^'(?:[^']|'')*'", ""), ":([^:]*)$", 1)
    label = F.when(quoted | (label != ""), label)
    named = settled(named.withColumn("label", label).withColumn("length", F.when(size != "", size.cast("double"))))
    if number:
        named = named.withColumn("tumour", F.col("_own"))
    elif named.filter("mark = ';'").count() == groups.filter("mark = ';'").count():
        named = named.withColumn("tumour", F.col("tree").cast("int"))
    else:
        ends = positions(named.filter("mark = ';'").select("tree").withColumn("_all", F.lit(0)), "_all", ["tree"])
        named = named.join(ends.select("tree", (F.col("position") - 1).alias("tumour")), "tree")
    if not named.filter("label is null").isEmpty():
        named = running(named, ["tree"], ["g"], {"u": F.col("label").isNull().cast("int")})
        named = settled(named.withColumn("label", F.coalesce("label", F.concat(F.lit("T"), "tumour", F.lit("_u"), "u"))))
    upper = closed.filter("mark = ')'").select("tree", "level", "k", (F.col("g") + 1).alias("_g"))
    parents = upper.join(named.select(F.col("g").alias("_g"), F.col("label").alias("parent")), "_g").drop("_g")
    edges = named.join(parents, ["tree", "level", "k"])
    return edges.select("tumour", "parent", F.col("label").alias("child"), "length")
