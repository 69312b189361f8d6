"""Collections in their file formats, read as ``documents(name, text, metadata, path)``.

Block formats are read with their end mark as the record separator, so large plain files are
split between tasks; compressed files are read whole by one task each, as their codec demands.
Records without a name are dropped; an empty folder gives an empty table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import arrow_map

SCHEMA = "name string, text string, metadata map<string,string>, path string"
#: Tags whose text makes up a news record. Fixed values.
TREC_TAGS = ("TEXT", "HEADLINE", "TITLE", "HL", "HEAD", "TTL", "DD", "DATE", "LP", "LEADPARA")


def _text(spark: SparkSession, path, **options) -> DataFrame:
    r = spark.read.option("recursiveFileLookup", "true")
    for k, v in options.items():
        r = r.option(k, v)
    return r.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _of(pairs: dict[str, Column]) -> Column:
    """A map without its null values."""
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return F.map_filter(m, lambda k, v: v.isNotNull())


def _some(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def _end(df: DataFrame) -> DataFrame:
    return df.where(F.col("name").isNotNull() & (F.col("name") != "")).select("name", "text", "metadata", "path")


def trec_text(spark: SparkSession, path, tags: tuple[str, ...] = TREC_TAGS) -> DataFrame:
    """``<DOC>`` blocks: name from DOCNO, text from the listed tags in order, with the tags."""
    x = _text(spark, path, lineSep="</DOC>")
    name = F.trim(F.regexp_extract("value", r"(?is)<DOCNO>(.*?)</DOCNO>", 1))
    alt = "|".join(tags)
    parts = F.regexp_extract_all(F.col("value"), F.lit(rf"(?is)(<({alt})\b[^>]*>.*?</\2\s*>)"), F.lit(1))
    return _end(x.select(name.alias("name"), F.array_join(parts, "\n").alias("text"), _no_map().alias("metadata"), "path"))


def trec_web(spark: SparkSession, path) -> DataFrame:
    """``<DOC>`` blocks with DOCNO and DOCHDR; the address is the header's first word."""
    x = _text(spark, path, lineSep="</DOC>")
    name = F.trim(F.regexp_extract("value", r"(?is)<DOCNO>(.*?)</DOCNO>", 1))
    header = F.regexp_extract("value", r"(?is)<DOCHDR>\s*(.*?)</DOCHDR>", 1)
    url = _some(F.regexp_extract(header, r"^(\S+)", 1))
    body = F.when(F.col("value").rlike("(?i)</DOCHDR>"), F.regexp_extract("value", r"(?is)</DOCHDR>(.*)$", 1)).otherwise(F.regexp_extract("value", r"(?is)</DOCNO>(.*)$", 1))
    return _end(x.select(name.alias("name"), F.trim(body).alias("text"), _of({"url": url}).alias("metadata"), "path"))


def warc(spark: SparkSession, path) -> DataFrame:
    """Response records: name is the record's TREC id, else its address; HTTP headers are cut."""
    x = _text(spark, path, lineSep="WARC/")
    head = F.regexp_extract("value", r"(?s)^(.*?)\r?\n\r?\n", 1)
    rest = F.regexp_extract("value", r"(?s)^.*?\r?\n\r?\n(.*)$", 1)

    def field(n: str) -> Column:
        return _some(F.regexp_extract(head, rf"(?im)^{n}:[ \t]*([^\r\n]*)", 1))

    body = F.when(rest.rlike(r"(?s)^HTTP/"), F.regexp_extract(rest, r"(?s)^.*?\r?\n\r?\n(.*)$", 1)).otherwise(rest)
    url = F.regexp_replace(field("WARC-Target-URI"), "^<|>$", "")
    meta = _of({"url": url, "date": field("WARC-Date"), "content_type": _some(F.regexp_extract(rest, r"(?im)^Content-Type:[ \t]*([^\r\n]*)", 1))})
    x = x.where(F.lower(field("WARC-Type")) == "response")
    return _end(x.select(F.coalesce(field("WARC-TREC-ID"), url).alias("name"), F.trim(body).alias("text"), meta.alias("metadata"), "path"))


def _files(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(df: DataFrame, parse: Callable[[str, bytes], Iterator[tuple[str, str, dict]]]) -> DataFrame:
    """Files too odd for a record separator, each parsed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for r in parse(p, content or b""):
                    rows.append(r)
                    if len(rows) == 256:
                        yield _batch(rows, p, kind)
                        rows = []
                if rows:
                    yield _batch(rows, p, kind)

    return _end(arrow_map(df, run, SCHEMA))


def _batch(rows, path, kind) -> pa.RecordBatch:
    names, texts, metas = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array([list(m.items()) for m in metas], kind), pa.array([path] * len(rows), pa.string())], names=["name", "text", "metadata", "path"])


def parse_arc(path: str, content: bytes) -> Iterator[tuple[str, str, dict]]:
    """Records of a one-line header (address, IP, date, type, length) and a body of that length."""
    import gzip

    if path.endswith(".gz"):
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            return
        head = content[at:end].decode("utf-8", "replace").split()
        if len(head) < 5 or not head[-1].isdigit():
            at = end + 1
            continue
        body = content[end + 1 : end + 1 + int(head[-1])]
        at = end + 1 + int(head[-1])
        if head[0].startswith("filedesc:"):
            continue
        if body.startswith(b"HTTP/"):
            body = re.split(rb"\r?\n\r?\n", body, maxsplit=1)[-1]
        yield head[0], body.decode("utf-8", "replace").strip(), {"url": head[0], "date": head[2], "content_type": head[3]}


def arc(spark: SparkSession, path) -> DataFrame:
    return _parsed(_files(spark, path), parse_arc)


def whole_files(spark: SparkSession, path) -> DataFrame:
    """One document per file: the name is the path, the title that of an HTML file."""
    x = _text(spark, path, wholetext="true")
    title = _some(F.regexp_extract("value", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return _end(x.select(F.col("path").alias("name"), F.col("value").alias("text"), _of({"title": title}).alias("metadata"), "path"))


def lines(spark: SparkSession, path) -> DataFrame:
    """One document per line, named by a hash of path and text."""
    x = _text(spark, path)
    return _end(x.select(F.concat(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("-"), F.lower(F.hex(F.xxhash64("path", "value")))).alias("name"), F.col("value").alias("text"), _no_map().alias("metadata"), "path"))


def blocks(spark: SparkSession, path, delimiter: str = "====") -> DataFrame:
    """Documents between delimiter lines; the first line of each is its name."""
    x = _text(spark, path, lineSep=f"{delimiter}\n").withColumn("value", F.regexp_replace("value", r"^\s*\n", ""))
    name = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    return _end(x.select(name.alias("name"), F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1).alias("text"), _no_map().alias("metadata"), "path"))


_ID = ("id", "docid", "docno", "identifier")
_BODY = ("text", "contents", "body", "passage")


def json_documents(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """JSON lines (or an array with ``multiline``): the id and text under any of their usual
    keys, everything else as metadata. Lines that are no JSON objects are dropped."""
    r = spark.read.option("recursiveFileLookup", "true")
    if multiline:
        raw = r.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"), F.col("_metadata.file_path").alias("path"))
    else:
        raw = r.text(path).select(F.from_json("value", "map<string,string>").alias("m"), F.col("_metadata.file_path").alias("path"))
    first = lambda keys: F.coalesce(*[F.col("m")[k] for k in keys])
    rest = F.map_filter("m", lambda k, v: ~k.isin(*_ID, *_BODY) & v.isNotNull())
    return _end(raw.where(F.col("m").isNotNull()).select(first(_ID).alias("name"), first(_BODY).alias("text"), rest.alias("metadata"), "path"))


def news_json(spark: SparkSession, path) -> DataFrame:
    """One article a line with id, title, content, source, published and media-type."""
    x = spark.read.option("recursiveFileLookup", "true").text(path).select(F.from_json("value", "map<string,string>").alias("m"), F.col("_metadata.file_path").alias("path"))
    g = lambda k: F.col("m")[k]
    text = F.concat(F.lit("<title>"), F.coalesce(g("title"), F.lit("")), F.lit("</title>\n"), F.coalesce(g("content"), F.lit("")))
    return _end(x.where("m is not null").select(g("id").alias("name"), text.alias("text"), _of({k: g(k) for k in ("title", "source", "published", "media-type")}).alias("metadata"), "path"))


def microblog(spark: SparkSession, path) -> DataFrame:
    """Tab-separated user, time, text and source; named by user and time."""
    p = F.split("value", "\t")
    x = _text(spark, path).select(p.alias("p"), "path").where(F.size("p") >= 3)
    g = lambda i: F.get("p", F.lit(i))
    return _end(x.select(F.concat_ws("-", g(0), g(1)).alias("name"), g(2).alias("text"), _of({"user": g(0), "time": g(1), "source": g(3)}).alias("metadata"), "path"))


def tac(spark: SparkSession, path) -> DataFrame:
    """``<DOC id=...>`` blocks with HEADLINE and TEXT."""
    x = _text(spark, path, lineSep="</DOC>")
    name = F.regexp_extract("value", r"(?is)<DOC\b[^>]*\bid\s*=\s*[\"']([^\"']+)", 1)
    get = lambda t: F.trim(F.regexp_extract("value", rf"(?is)<{t}>(.*?)</{t}>", 1))
    return _end(x.select(name.alias("name"), F.concat_ws("\n", _some(get("HEADLINE")), _some(get("TEXT"))).alias("text"), _no_map().alias("metadata"), "path"))


def wiki_xml(spark: SparkSession, path) -> DataFrame:
    """``<page>`` elements: title, id, text of the last revision."""
    schema = "title string, id bigint, revision struct<text: struct<_VALUE: string>>"
    x = spark.read.format("xml").option("rowTag", "page").option("recursiveFileLookup", "true").schema(schema).load(path)
    x = x.select("*", F.col("_metadata.file_path").alias("path"))
    return _end(x.select(F.col("title").alias("name"), F.col("revision.text._VALUE").alias("text"), _of({"title": F.col("title"), "id": F.col("id").cast("string")}).alias("metadata"), "path"))


def wiki_tsv(spark: SparkSession, path) -> DataFrame:
    """Tab-separated page id, title, time, XML and text; the text is taken from the XML's
    paragraphs where the last column is missing."""
    p = F.split("value", "\t")
    x = _text(spark, path).select(p.alias("p"), "path").where(F.size("p") >= 4)
    g = lambda i: F.get("p", F.lit(i))
    plain = F.trim(F.regexp_replace(F.regexp_replace(g(3), r"\\n", "\n"), "(?s)<[^>]*>", " "))
    return _end(x.select(g(1).alias("name"), F.coalesce(_some(g(4)), plain).alias("text"), _of({"id": g(0), "title": g(1), "time": g(2)}).alias("metadata"), "path"))


def word_counts(spark: SparkSession, path) -> DataFrame:
    """(word, n) of lines with a word and a number; other lines are dropped."""
    p = F.split(F.trim("value"), r"\s+")
    return _text(spark, path).select(F.get(p, F.lit(0)).alias("word"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) as bigint)").alias("n")).where("n is not null and word <> ''")


def zipped(spark: SparkSession, path, reader: str = "txt") -> DataFrame:
    """Members of zip files: text files as documents, ``trectext`` members block by block."""

    def parse(p: str, content: bytes) -> Iterator[tuple[str, str, dict]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n in sorted(z.namelist()):
                if n.endswith("/"):
                    continue
                text = z.read(n).decode("utf-8", "replace")
                if reader == "trectext":
                    for block in text.split("</DOC>"):
                        m = re.search(r"(?is)<DOCNO>(.*?)</DOCNO>", block)
                        if m:
                            yield m[1].strip(), "\n".join(x[0] for x in re.finditer(rf"(?is)<({'|'.join(TREC_TAGS)})\b[^>]*>.*?</\1\s*>", block)), {"member": n}
                else:
                    yield f"{p}!{n}", text, {"member": n}

    return _parsed(_files(spark, path), parse)


def corpus(spark: SparkSession, path, first: str | None = None, last: str | None = None) -> DataFrame:
    """A stored collection, whole or the names from ``first`` up to before ``last``."""
    x = spark.read.parquet(path)
    if first is not None:
        x = x.where(F.col("name") >= first)
    return x.where(F.col("name") < last) if last is not None else x


#: Reader by format name; ``register`` adds one.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "trectext": trec_text, "trecweb": trec_web, "warc": warc, "arc": arc, "html": whole_files, "xml": whole_files, "txt": whole_files, "lines": lines, "blocks": blocks,
    "json": json_documents, "jsonl": json_documents, "newsjson": news_json, "twitter": microblog, "tac": tac, "wiki": wiki_xml, "wikitsv": wiki_tsv, "zip": zipped, "corpus": corpus, "parquet": corpus,
}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[name] = reader


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file by its ending (less ``.gz`` and the like), else by its first lines."""
    bare = re.sub(r"\.(gz|bz2|zst|lz4|snappy|deflate)$", "", path.lower().rstrip("/"))
    ending = bare.rpartition(".")[2]
    if ending in READERS:
        return ending
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(30).collect())
    if re.search(r"(?i)<DOCHDR>", head):
        return "trecweb"
    if re.search(r"(?i)<DOCNO>", head):
        return "trectext"
    if head.startswith("WARC/"):
        return "warc"
    return "json" if head.lstrip().startswith("{") else "txt"


def read(spark: SparkSession, path: str | list[str], format: str | None = None, on_unknown: str = "require") -> DataFrame:
    """Documents of files or folders; several paths may differ in format, and a
    file ``*.list`` names further ones, a line each. ``on_unknown`` says
    whether a format without reader is an error (``require``) or skipped (``warn``)."""
    out = None
    paths: list[str] = []
    for p in [path] if isinstance(path, str) else path:
        # a list file names one path a line; it is a setting, not data
        paths += [r["value"].strip() for r in spark.read.text(p).collect() if r["value"].strip()] if p.endswith(".list") else [p]
    for p in paths:
        f = format or sniff(spark, p)
        if f not in READERS:
            if on_unknown == "require":
                raise ValueError(f"no reader for {f}")
            continue
        one = READERS[f](spark, p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return spark.createDataFrame([], SCHEMA) if out is None else out
