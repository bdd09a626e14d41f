"""Main text of web pages: text blocks, classified by a decision tree on themselves and their neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import cycle, islice, product

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from circuitlens.llm.common import text_blocks
from circuitlens.llm.html_blocks import Block, blocks

BLOCK = "struct<text string, words int, linked int, hint int, heading boolean, share double>"
#: Depth of the tree, labelled blocks of a leaf at least.
MAX_DEPTH, MIN_ROWS = 6, 15

#: Lengths of the labelled blocks, in turn, as shares of those that the layouts state.
LENGTHS = (1, 0.4, 2.2, 0.7, 1.5)
#: What the labelled pages hold beside the article. A number in brackets stands for so many words, in links after a letter.
MENU, LINKS = "<ul><li><a href='/a'>[1]</a></li><li><a href='/b'>[2]</a></li><li><a href='/c'>[1]</a></li></ul>", "<p><a href='/d'>[3]</a> | <a href='/e'>[2]</a></p>"
#: Shapes of articles, from long to a few words.
ARTICLES = (
    "<h1>[6]</h1><p>[60]</p><p>[45]</p><p>[2]</p><p>[80]</p><p>[12]</p><p>[1]</p>",
    "<h1>[9]</h1><p><b>[25]<br><p>[5]</p><p>[3]</p>",
    "<h1>[4]</h1><p><b>[4]<br>",
    "<h2>[5]</h2><p>[70]</p><h3>[3]</h3><ul><li>[8]</li><li>[4]</li></ul><blockquote>[20]</blockquote><p>[30] <a href='/f'>[4]</a> [9]</p><table><tr><td>[2]</td><td>[1]</td></tr></table><p>[25]</p>",
    "<p>[30]</p><p>[200]</p><p>[6]</p>",
    "<h1>[8]</h1><p>[4]</p><p>[90]</p>",
    "<p>[1]</p><p>[150]</p>",
)
#: Layouts of pages, as parts in turn; a part with a plus is main text, ``+`` alone is the article.
LAYOUTS = (
    (f"<nav>{MENU}</nav><!-- x --><div class='ad'>[7]</div>", "<article>", "+", "</article><footer>&copy; [1] &middot; [11]</footer>"),
    (f"<header><h1>[2]</h1><p>[5]</p></header><nav>{MENU}</nav><main><article>", "+", "</article><section class='comments'><h3>[1]</h3><p>[25]</p><p>[40]</p></section></main><aside><h3>[2]</h3><p>[30]</p></aside><footer><p>[8]</p></footer>"),
    (f"<div id='header'>[3]</div><div id='menu'>{MENU}</div><div id='content'>", "+", f"</div><div id='sidebar'><h4>[2]</h4><p>[22]</p>{MENU}</div><div id='footer'>[9]</div>"),
    (f"<div>{MENU}</div><div>", "+", f"</div><div>{LINKS}<p>[6]</p></div>"),
    ("<div class='cookie-notice'><p>[28]</p></div><div class='post'>", "+", "<div class='share'><a href='/x'>[1]</a> [2]</div></div><ol class='commentlist'><li class='comment'><p>[33]</p></li><li class='comment'><p>[5]</p></li></ol><form><p>[6]</p></form>"),
    (f"<form id='page'><div class='banner'>[4]</div>{MENU}<div class='article-body'>", "+", "</div><div class='copyright'>[12]</div></form>"),
    (f"<table><tr><td>{MENU}</td><td>", "+", f"</td><td>{LINKS}<p>[5]</p></td></tr></table>"),
    (f"<div class='page'><div class='top'>{LINKS}</div><div class='inner'>", "+", f"</div><div class='box'><h4>[2]</h4>{MENU}</div><div class='end'>[4] <a href='/y'>[3]</a></div></div>"),
    (f"<article><header>", "+<h1>[7]</h1>", "<p>[4]</p></header>", "+<p>[40]</p>", "<div class='advert'>[15]</div>", "+<p>[20]</p><p>[3]</p>", "<aside>[18]</aside>", "+<p>[33]</p>", f"<footer>[5]</footer></article><div>{LINKS}</div><div>[14]</div>"),
    ("<div>[13]</div><article>", "+", f"</article><div>{LINKS}</div><p>[9]</p>"),
    ("", "+", ""),
)


def labelled() -> list[tuple[str, list[bool]]]:
    """The small labelled table: pages, and for each of their blocks whether it is main text."""
    out = []
    for (k, layout), article, turn in product(enumerate(LAYOUTS), ARTICLES, range(3)):
        lengths = islice(cycle(LENGTHS), turn + k, None)
        page, kept = "", []
        for part in layout:
            kept.append((len(page), part.startswith("+")))
            page += re.sub(r"\[(\d+)\]", lambda m: " ".join(["word"] * max(1, round(int(m[1]) * next(lengths)))), article if part == "+" else part.removeprefix("+"))
        out.append((page, [[keep for start, keep in kept if start <= b.start][-1] for b in blocks(page)]))
    return out


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = Block._fields[:6]
    kinds = dict(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64())))
    for batch in text_blocks(batches, column=2):
        rows, ends = [], [0]
        for page in batch.column(2).to_pylist():
            rows += blocks(page or "")
            ends.append(len(rows))
        cells = pa.StructArray.from_arrays([pa.array([getattr(r, n) for r in rows], kind) for n, kind in kinds.items()], names=list(names))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], names=["id", "url", "blocks"])


def features(all_blocks: Column, i: Column) -> list[Column]:
    """What is looked at for the block number ``i``: words and link density of the block and its neighbours, its surroundings, and whether the page has named main text."""
    out = []
    for step in (0, -1, 1):
        b = F.when(i + step >= 0, F.get(all_blocks, i + step))
        out += [F.coalesce(b["words"], F.lit(0)).cast("double"), F.coalesce(b["linked"] / b["words"], F.lit(0.0))]
    own = F.get(all_blocks, i)
    return [*out, own["hint"].cast("double"), own["heading"].cast("double"), own["share"], F.exists(all_blocks, lambda b: b["hint"] > 0).cast("double")]


class Tree:
    """A decision tree for main text, as an expression of Spark."""

    def __init__(self, node) -> None:
        """``node``: a node of a fitted tree, read once on the driver."""
        self.at = None
        if node.subtreeDepth():
            split = node.split()
            self.at, self.cut, self.left, self.right = split.featureIndex(), split.threshold(), Tree(node.leftChild()), Tree(node.rightChild())
        else:
            self.keep = node.prediction() > 0.5

    def column(self, found: list[Column]) -> Column:
        if self.at is None:
            return F.lit(self.keep)
        return F.when(found[self.at] <= self.cut, self.left.column(found)).otherwise(self.right.column(found))


def train(spark: SparkSession, pages: list[tuple[str, list[bool]]] | None = None, max_depth: int = MAX_DEPTH) -> Tree:
    """Fit the tree on a small labelled table, by default on ``labelled()``."""
    rows = [([tuple(b[:6]) for b in blocks(page)], keep) for page, keep in (labelled() if pages is None else pages)]
    table = spark.createDataFrame(rows, f"blocks array<{BLOCK}>, keep array<boolean>").select("blocks", "keep", F.posexplode("keep").alias("i", "label"))
    table = table.select(F.array(*features(F.col("blocks"), F.col("i"))).alias("x"), F.col("label").cast("double").alias("label"))
    rows = [(Vectors.dense(r.x), r.label) for r in table.collect()]  # as many as the labelled table has
    fitted = DecisionTreeClassifier(maxDepth=max_depth, maxBins=256, minInstancesPerNode=MIN_ROWS, seed=1).fit(spark.createDataFrame(rows, ["features", "label"]).coalesce(1))
    return Tree(fitted._call_java("rootNode"))


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of pages: (id, url, text, n_chars), one row for each row.

    A page is cut into flat blocks of text, and a tree keeps those that are main text
    by their words and link density, those of their neighbours, the
    weight of their container, and what the elements around them are named. Kept blocks are
    joined in their order by an empty line; inside a block character
    references are decoded and white space is one blank.

    A null or empty page, and one without main text, has the text ''. Null ids
    and urls stay, repeated rows are pages of their own, an empty table gives
    an empty one; other columns are not read. A page of any length is read
    whole, in linear time. There is no shuffle.
    """
    tree = tree or train(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInArrow(_parsed, f"id {kind['id']}, url {kind['url']}, blocks array<{BLOCK}>")
    b = F.col("blocks")
    marked = F.transform(b, lambda x, i: F.when(tree.column(features(b, i)), x["text"]))
    text = F.array_join(F.filter(marked, lambda t: t.isNotNull()), "\n\n")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
