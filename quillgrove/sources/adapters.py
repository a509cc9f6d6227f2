"""The data model from tables: pages, contents items, titles; and documents from files."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.functions.text import clean_text
from quillgrove.operators.provider import with_retries
from quillgrove.plans.lineage import settled

EXTENSIONS = ("pdf", "PDF", "md", "markdown", "MD", "MARKDOWN")
PDF_BYTES = 50 * 1024 * 1024
TOTAL_PAGES = 50


#: Rows of a partition, about.
CELL_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(doc_id, page_number, text): a page for each turn of a conversation."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(doc_id, page_number, text): a page for each line of a document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", (F.col("pos") + 1).cast("int").alias("page_number"), "text")


def toc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toc_items(doc_id, structure, title, physical_index, list_index, ...): orders are a customer's chapters, lineitems their sections.

    l_partkey, l_suppkey and l_extendedprice come along: codes repeat, and these make orders total.
    Large tables are dealt by documents to as many partitions as their rows need, so that what a task
    sorts and holds does not grow with them.
    """
    chapter = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("chapter", chapter.cast("int"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    cells = -(-lines.count() // CELL_ROWS)  # of the files' footers
    wide = cells > int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wide:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(cells, "o_custkey")
        joined, lines = orders.withColumn("chapter", chapter.cast("int")).repartition(cells, "o_orderkey"), lines.repartition(cells, "l_orderkey")
    met = lines.join(joined, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    out = met.select(
        F.col("o_custkey").alias("doc_id"),
        F.concat_ws(".", F.col("chapter").cast("string"), F.col("l_linenumber").cast("string")).alias("structure"),
        F.coalesce("p_name", F.lit("")).alias("title"),
        F.col("l_quantity").cast("int").alias("physical_index"),
        (F.col("chapter") * 100 + F.col("l_linenumber")).cast("int").alias("list_index"),
        "l_partkey", "l_suppkey", "l_extendedprice",
    )
    return out.repartition(cells, "doc_id") if wide else out


def files(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """documents(doc_id, source_path, kind, content, problem) from files; unsupported ones have a problem, no content.

    The kind comes from the extension, of which just those of EXTENSIONS are known, or of `kinds`
    (kinds by lower-case extension) in any case. A PDF must begin
    with %PDF- and have 50 MiB at most.
    """
    extension = F.regexp_extract("path", r"\.([^./\\]+)$", 1)
    found = spark.read.format("binaryFile").load(path).select("path", "length", "content", extension.alias("ext"))
    if kinds is None:
        kind = F.when(F.col("ext").isin("pdf", "PDF"), "pdf").when(F.col("ext").isin(*EXTENSIONS), "markdown")
    else:
        kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.lower("ext"))
    problem = (
        F.when(kind.isNull(), F.concat(F.lit("unsupported file type: "), F.col("ext")))
        .when((kind == "pdf") & ~pdf_ok("content"), "not a PDF, or too large")
    )
    return found.select(F.sha2("path", 256).alias("doc_id"), F.col("path").alias("source_path"), kind.alias("kind"), F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))


def pdf_ok(content: str):
    """Whether bytes may be a PDF: its first five bytes and its size."""
    return (F.length(content) <= PDF_BYTES) & (F.hex(F.substring(F.col(content), 1, 5)) == b"%PDF-".hex().upper())


FENCE = re.compile(r" {0,3}(`{3,}(?!.*`)|~{3,})")
ATX = re.compile(r" {0,3}#{1,6}(?=[ \t]|$)")
UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
MARKER = re.compile(r" {0,3}(?:(?:[-*+]|\d{1,9}[.)])(?:[ \t]{1,4}|$)|> ?)")
DEFINITION = re.compile(r" {0,3}\[[^\[\]]+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
RAW = re.compile(r" {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*(?=[\s/>]|$)|[!?])")
#: Within a paragraph: runs of marks, and what stands between. Addresses in angle brackets and tags have no text.
TOKEN = re.compile(r"`+|\*+|_+|!?\[|\]|<|!|[^`*_!\[\]<]+")
SILENT = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+|/?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*|/)?)>")
TARGET = re.compile(r"\([^()\s]*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)|\[[^\[\]]*\]")


def _spoken(text: str) -> str:
    """A paragraph's text without marks, in one pass. What stands in code spans is left as it is."""
    out: list[str] = []
    marks: list[tuple[str, int]] = []  # runs that may begin emphasis, and their places in `out`
    begun: Counter[str] = Counter()
    brackets: list[int] = []
    spans: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        spans.setdefault(len(m.group()), []).append(m.start())
    for places in spans.values():
        places.reverse()
    at, comments = 0, True
    while at < len(text):
        mark = TOKEN.match(text, at).group()
        end = at + len(mark)
        if mark[0] == "`":
            places = spans[len(mark)]
            while places and places[-1] <= at:
                places.pop()
            if places:
                mark, end = text[end : places[-1]], places[-1] + len(mark)
        elif mark[0] in "*_":
            before, after = text[at - 1 : at], text[end : end + 1]
            inside = mark[0] == "_" and (before.isalnum() and after.isalnum())
            if begun[mark] and before.strip() and not inside:
                while (last := marks.pop())[0] != mark:
                    begun[last[0]] -= 1
                begun[mark] -= 1
                out[last[1]] = mark = ""
            elif after.strip() and not (mark[0] == "_" and before.isalnum()):
                marks.append((mark, len(out)))
                begun[mark] += 1
        elif mark in ("[", "!["):
            brackets.append(len(out))
        elif mark == "]" and brackets:
            opened = brackets.pop()
            if target := TARGET.match(text, end):
                out[opened] = mark = ""
                end = target.end()
        elif mark == "<":
            if silent := SILENT.match(text, at):
                mark, end = "", silent.end()
            elif comments and text.startswith("<!--", at):
                close = text.find("-->", at)
                comments = close >= 0
                mark, end = ("", close + 3) if comments else (mark, end)
        out.append(mark)
        at = end
    return "".join(out)


def markdown_text(source: str) -> str:
    """The text of Markdown, by its blocks: an empty line goes before headings, each line ends with a space.

    Code blocks, HTML, breaks, link definitions and addresses in angle brackets have no text. A
    heading is marked by # or by a line of = or - below its paragraph.
    """
    out: list[str] = []
    paragraph: list[str] = []  # not yet in `out`, as a line below may make it a heading
    hangs: list[int] = []  # where the text of open list items begins
    fence = raw = ""

    def close(heading: bool = False) -> None:
        if heading:
            out.append("\n\n")
        if paragraph:
            out.extend(t + " " for x in _spoken("\n".join(paragraph)).split("\n") if (t := x.strip()))
        paragraph.clear()

    for line in source.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if fence:
            inner = line.lstrip("> \t").rstrip()
            fence = "" if len(inner) >= len(fence) and not inner.strip(fence[0]) else fence
            continue
        if raw:
            raw = "" if (not line.strip() if raw == "\n" else raw in line) else raw
            continue
        bare = line.lstrip(" \t")
        line = line[: len(line) - len(bare)].expandtabs(4) + bare
        indent = len(line) - len(bare)
        while hangs and bare and not paragraph and indent < hangs[-1]:
            hangs.pop()
        base = hangs[-1] if hangs else 0
        if not paragraph and bare and indent >= base + 4:
            continue
        if paragraph and indent >= base and UNDERLINE.match(line, base):
            close(heading=True)
            continue
        ruler = line.rstrip()[-1:]
        ruled = len(line.rstrip(ruler + " \t")) if ruler and ruler in "-*_" else len(line)  # from here on it is a break, if it has three
        is_break = lambda k: k >= ruled and line.count(ruler, k) >= 3  # noqa: E731, B023  within this turn
        at = min(indent, base)
        while not is_break(at) and (mark := MARKER.match(line, at)) and mark.end() > at:
            if ">" not in mark.group() or not paragraph:
                close()
            if ">" not in mark.group():
                while hangs and hangs[-1] > at:
                    hangs.pop()
                hangs.append(mark.end())
            at = mark.end()
        inner = line[at:]
        if is_break(at) or not inner.strip():
            close()
        elif found := FENCE.match(inner):
            close()
            fence = found.group(1)
        elif found := ATX.match(inner):
            close()
            title = inner[found.end() :].strip()
            bare = title.rstrip("#")
            paragraph.append(bare if not bare.strip() or bare[-1:] in " \t" else title)
            close(heading=True)
        elif not paragraph and DEFINITION.match(inner):
            continue
        elif not paragraph and RAW.match(inner):
            raw = "-->" if inner.lstrip().startswith("<!--") else "\n"
            raw = "" if raw == "-->" and raw in inner else raw
        else:
            paragraph.append(inner)
    close()
    return "".join(out).strip()


def markdown_pages(docs: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, text): one page for each Markdown document of files()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [markdown_text(bytes(c).decode("utf-8", "replace")) for c in frame["content"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "page_number": 1, "text": texts})

    return docs.where("kind = 'markdown' and content is not null").select("doc_id", "content").mapInPandas(run, "doc_id string, page_number int, text string")


def pdf_pages(docs: DataFrame, reader=None) -> DataFrame:
    """pages(doc_id, page_number, text) of PDF documents of files().

    reader(bytes) gives the texts of a file's pages. Where none is given, pypdf is used if it is
    installed; without it a document with PDF content raises.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = reader or _pypdf
        for frame in frames:
            rows = [(d, k + 1, text or "") for d, c in zip(frame["doc_id"], frame["content"], strict=True) for k, text in enumerate(own(bytes(c)))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text"])

    found = docs.where("kind = 'pdf' and content is not null").select("doc_id", "content").mapInPandas(run, "doc_id string, page_number int, text string")
    return found.withColumn("text", clean_text("text"))


def _pypdf(content: bytes) -> list[str]:
    import io

    try:
        from pypdf import PdfReader
    except ImportError as problem:
        raise RuntimeError("reading PDF needs a reader or the package pypdf") from problem
    return [_rows(page) for page in PdfReader(io.BytesIO(content)).pages]


def _rows(page) -> str:
    """A page's text by rows; as the package orders it where places can't be had."""
    pieces: list[tuple[float, float, str]] = []
    try:
        page.extract_text(visitor_text=lambda text, _, place, *more: pieces.append((place[4], place[5], text)))
        if text := by_rows(pieces):
            return text
    except Exception:  # noqa: BLE001  the plain order serves
        pass
    return page.extract_text() or ""


def by_rows(pieces: list[tuple[float, float, str]]) -> str:
    """Text of pieces (x, y, text): a line for each height, from the top (the largest y), pieces from the left, a space between."""
    rows: dict[int, list[tuple[float, str]]] = {}
    for x, y, text in pieces:
        if text.strip():
            rows.setdefault(round(y), []).append((x, text.strip()))
    return "\n".join(" ".join(t for _, t in sorted(rows[y], key=lambda p: p[0])) for y in sorted(rows, reverse=True))


def rendered(docs: DataFrame, dpi: int = 150, renderer: Callable[[bytes, int], Iterable[bytes]] | None = None) -> DataFrame:
    """images(doc_id, page_number, image) of PDF documents of files(), a page at a time.

    renderer(bytes, dpi) gives PNG files; where none is given, pypdfium2 is used if it is installed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = renderer or _pypdfium
        for frame in frames:
            for d, c in zip(frame["doc_id"], frame["content"], strict=True):
                for k, image in enumerate(own(bytes(c), dpi)):
                    yield pd.DataFrame({"doc_id": [d], "page_number": [k + 1], "image": [image]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.where("kind = 'pdf' and content is not null").select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, page_number int, image binary")


def _pypdfium(content: bytes, dpi: int) -> Iterator[bytes]:
    import io

    try:
        import pypdfium2
    except ImportError as problem:
        raise RuntimeError("rendering PDF needs a renderer or the package pypdfium2") from problem
    for page in pypdfium2.PdfDocument(content):
        out = io.BytesIO()
        page.render(scale=dpi / 72).to_pil().save(out, "PNG")
        yield out.getvalue()


def recognised(images: DataFrame, recognise: Callable[[bytes], str], calls: int = 20) -> tuple[DataFrame, DataFrame]:
    """pages(doc_id, page_number, text) of images(doc_id, page_number, image), and problems(doc_id, problem).

    A call for each page, tried again after RetryableError. A document with a page that fails gives no
    pages but the problem of the first such page. Each image is read once: replies are settled.
    """
    kind = dict(images.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = with_retries(lambda image: recognise(bytes(image)))
        for frame in frames:
            texts: list[str | None] = []
            problems: list[str | None] = []
            for image in frame["image"]:
                try:
                    texts.append(ask(image))
                    problems.append(None)
                except Exception as problem:  # noqa: BLE001  reported as the document's
                    texts.append(None)
                    problems.append(f"{type(problem).__name__}: {problem}")
            yield frame[["doc_id", "page_number"]].assign(text=texts, problem=problems)

    told = settled(images.select("doc_id", "page_number", "image").repartition(calls).mapInPandas(run, f"doc_id {kind}, page_number int, text string, problem string"))
    problems = told.where("problem is not null").groupBy("doc_id").agg(F.min_by("problem", "page_number").alias("problem"))
    return told.join(problems, "doc_id", "left_anti").select("doc_id", "page_number", clean_text(F.coalesce("text", F.lit(""))).alias("text")), problems


def with_ocr(pages: DataFrame, images: DataFrame, recognise: Callable[[bytes], str], calls: int = 20) -> tuple[DataFrame, DataFrame]:
    """Pages, and problems, where documents that need it are read from images(doc_id, page_number, image).

    Those are the ones that needs_ocr() names, and those with images but no page of text. One without
    images keeps its pages.
    """
    flagged = settled(images.select("doc_id").distinct().join(needs_ocr(pages).where("not needs_ocr").select("doc_id"), "doc_id", "left_anti"))
    read, problems = recognised(images.join(flagged, "doc_id", "left_semi"), recognise, calls)
    return pages.join(flagged, "doc_id", "left_anti").select("doc_id", "page_number", "text").unionByName(read), problems


def needs_ocr(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, empty_pages, needs_ocr): whether no page has text, or over three tenths (whole number) have none."""
    empty = F.count_if(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\s\p{Z}\x{85}]"))
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), empty.alias("empty_pages"))
    return counted.withColumn("needs_ocr", (F.col("empty_pages") == F.col("pages")) | (F.col("empty_pages") > F.expr("pages * 3 div 10")))
