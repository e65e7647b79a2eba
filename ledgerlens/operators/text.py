"""Text operators of the report tools: caption numbering and stripping, image references, data URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_captions(text: Column) -> Column:
    """Text without lines that are a bold or italic table caption."""
    return F.regexp_replace(text, r"(?m)^\*{1,2}Table [0-9.]+[^\n]*\*{1,2}\n?", "")


def drop_rules(text: Column) -> Column:
    """Markdown without the lines that are a numbered table caption in italics or a horizontal rule.

    A rule between two blank lines goes with the second of them, so paragraphs stay one blank line apart.
    """
    lines = F.split(text, "\n", -1)
    caption = lambda x: x.startswith("*Table ") & x.endswith("*") & F.substring_index(x, ":", 1).rlike("^.Table [0-9]+[.][0-9]+$")
    rule, blank = (lambda x: x == "---"), (lambda x: F.trim(x) == "")

    def stays(x: Column, i: Column) -> Column:
        behind = lambda k: F.get(lines, i - k)
        doubled = (i >= 2) & blank(x) & rule(behind(1)) & blank(behind(2))
        return ~caption(x) & ~rule(x) & ~F.coalesce(doubled, F.lit(False))

    return F.array_join(F.filter(lines, stays), "\n")


def _bare(x: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _blocks(html: Column) -> Column:
    """The page as stretches that each end with a paragraph (the last may not): head, the paragraph's inside, its
    kind and, for captions, their text.  Attributes may stand in any tag and order."""

    def block(x: Column) -> Column:
        inside = _bare(F.substring_index(F.regexp_replace(x, r"(?s)^.*<p(\s[^<>]*)?>", ""), "</p>", 1))
        is_paragraph = x.endswith("</p>") & x.rlike(r"<p(\s[^<>]*)?>")
        said = F.when(inside.rlike(r"^<em[^<>]*>[^<>]*</em>$"), _bare(F.regexp_replace(inside, "<[^<>]*>", "")))
        label, words = _bare(F.substring_index(said, ":", 1)), said.contains(":")
        numbered = words & label.rlike(r"^[A-Za-z]+\s+[0-9]+[.][0-9]+$")
        kind = (
            F.when(~is_paragraph, "other").when(inside.rlike(r"^<img\s[^<>]*>$"), "image")
            .when(numbered & label.startswith("Figure"), "figure caption").when(numbered & label.startswith("Table"), "table caption").otherwise("other")
        )
        head = F.when(is_paragraph, F.regexp_replace(x, r"(?s)<p(\s[^<>]*)?>((?!<p(\s[^<>]*)?>).)*$", "")).otherwise(x)
        return F.struct(x.alias("whole"), head.alias("head"), inside.alias("inside"), kind.alias("kind"), said.alias("said"))

    return F.transform(F.split(html, "(?<=</p>)", -1), block)


def captioned(html: Column) -> Column:
    """Paragraphs of one image become figures, with the figure caption if the next paragraph is one; table captions
    in italics become paragraphs of their own class.  Everything else stays as it is."""

    def written(blocks: Column) -> Column:
        at = lambda i: F.get(blocks, i)
        joined = lambda i: (at(i)["kind"] == "figure caption") & (_bare(at(i)["head"]) == "") & (i > 0) & (at(i - 1)["kind"] == "image")

        def one(x: Column, i: Column) -> Column:
            follows = F.coalesce(joined(i + 1), F.lit(False))
            caption = F.when(follows, F.concat(F.lit("<figcaption>"), at(i + 1)["said"], F.lit("</figcaption>"))).otherwise("")
            return (
                F.when(x["kind"] == "image", F.concat(x["head"], F.lit("<figure>"), x["inside"], caption, F.lit("</figure>")))
                .when(F.coalesce(joined(i), F.lit(False)), "")
                .when(x["kind"] == "table caption", F.concat(x["head"], F.lit('<p class="table-caption">'), x["said"], F.lit("</p>")))
                .otherwise(x["whole"])
            )

        return F.array_join(F.transform(blocks, one), "")

    return F.get(F.transform(F.array(_blocks(html)), written), 0)


def wrap_contents(html: Column) -> Column:
    """The heading with id table-of-contents and the list that follows it, nested lists included, in a page of their own."""
    # A page may begin with the heading, and nothing is split off before the first character: one is put there.
    cut = F.split(F.concat(F.lit(" "), html), r"(?i)(?=<h2\s[^<>]*?\bid\s*=\s*.?table-of-contents\b)", 2)
    before, rest = F.substring(F.get(cut, 0), 2, 2**31 - 1), F.get(cut, 1)
    count = lambda x, tag: F.size(F.regexp_extract_all(x, F.lit(tag), F.lit(0)))

    def state(depth, inside, after):
        return F.struct(depth.alias("depth"), inside.alias("inside"), after.alias("after"))

    def step(acc: Column, x: Column) -> Column:
        # Pieces end with a list's end; the contents end where as many lists have ended as begun.
        depth = acc["depth"] + count(x, "<[ou]l[ >]") - count(x, "</[ou]l>")
        over = acc["depth"] < 0
        return F.when(over, state(acc["depth"], acc["inside"], F.concat(acc["after"], x))).otherwise(state(F.when(depth <= 0, -1).otherwise(depth), F.concat(acc["inside"], x), acc["after"]))

    pieces = F.split(rest, "(?<=</[ou]l>)", -1)
    wrapped = F.aggregate(pieces, state(F.lit(0), F.lit(""), F.lit("")), step, lambda a: F.concat(before, F.lit('<div class="toc-page">'), a["inside"], F.lit("</div>"), a["after"]))
    listed = F.get(F.split(rest, "</h2>", 2), 1).rlike(r"^\s*<[ou]l[ >]")
    return F.when(listed, wrapped).otherwise(html)


def column_title(name: Column) -> Column:
    """A column's name as a title: without a flag suffix, blanks for underscores, each word capitalised."""
    return F.initcap(F.replace(F.replace(name, F.lit("_flag"), F.lit("")), F.lit("_"), F.lit(" ")))


def image_names(text: Column) -> Column:
    """The sources of <img> tags, in order."""
    return F.regexp_extract_all(text, F.lit(r"<img[^>]*\ssrc=[\"']([^\"']+)[\"']"), 1)


def mime_type(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "gif", "image/gif").when(ext == "svg", "image/svg+xml").otherwise("application/octet-stream")


def base64_text(content: Column) -> Column:
    """Base64 in one line: Spark breaks it after every 76 characters."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def data_uri(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), base64_text(content))


def numbered_tables(lines: DataFrame, doc: str = "doc_id", line: str = "line_no", text: str = "line") -> DataFrame:
    """(doc, line, section, table_no): first lines of the tables of a text, numbered within their section.

    Gaps and islands: a table starts where a line with a leading bar follows one without; its section is the
    last heading "## n" before it.  Lines between code fences count for nothing.
    """
    up = Window.partitionBy(doc).orderBy(line)
    fenced = F.sum(F.when(F.col(text).startswith("```"), 1).otherwise(0)).over(up) % 2 == 1
    out = lines.withColumn("__open", ~fenced)
    out = out.withColumn("__table", F.col("__open") & F.ltrim(F.col(text)).startswith("|"))
    out = out.withColumn("__section", F.last(F.when(F.col("__open") & F.col(text).rlike(r"^##\s+\d+"), F.regexp_extract(text, r"^##\s+(\d+)", 1).cast("int")), ignorenulls=True).over(up))
    first = F.col("__table") & ~F.coalesce(F.lag("__table").over(up), F.lit(False))
    out = out.withColumn("__first", first).filter("__first")
    own = Window.partitionBy(doc, "__section").orderBy(line)
    return out.select(doc, line, F.coalesce("__section", F.lit(0)).alias("section"), F.row_number().over(own).alias("table_no"))
