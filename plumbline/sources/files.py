"""Files as tables: prose folders, JSON lines, voice profiles, and PDF, DOCX and EPUB bytes."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lexicon as L
from plumbline.functions import text as T

WORD_GAP = -110


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deals a table that the scan cuts into fewer parts than there are cores to all of them; other tables stay as they are.

    Only a table of a few files is dealt, so what crosses the network is small beside the cores' memory."""
    want = tasks or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def loaded_text(path: Column, content: Column) -> Column:
    """The prose of a file by its extension: HTML and Markdown are stripped."""
    return F.when(F.lower(path).rlike(r"\.html?\z"), T.strip_html(content)).when(F.lower(path).rlike(r"\.(md|markdown|mdx)\z"), T.strip_markdown(content)).otherwise(content)


def _files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """``file, length, content``: paths below the folder, whatever the folder is called. Names that begin with a dot or an underscore are not listed."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    spelled = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + spelled + "}").load(folder)
    return files.select(F.substr(F.col("path"), F.lit(len(root) + 2)).alias("file"), "length", "content")


def _utf8(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def scan_dir(spark: SparkSession, folder: str, least: int = 20) -> DataFrame:
    """``file, text`` of a folder's prose files, below no skipped or hidden folder, with ``least`` visible characters.

    Extensions count in any case. Files over the size limit are left out."""
    skipped = "|".join(re.escape(x) for x in L.SKIPPED_FOLDERS if not x.startswith("."))
    kept = _files(spark, folder, L.PROSE_EXTENSIONS).where(~F.col("file").rlike(rf"(^|/)(?:{skipped}|\.[^/]*)/") & (F.col("length") <= L.MAX_INPUT_BYTES))
    rows = kept.select("file", loaded_text(F.col("file"), _utf8(F.col("content"))).alias("text"))
    return rows.where(T.visible_length(F.col("text")) >= least)


def read_text(spark: SparkSession, path: str, prose_only: bool = False) -> DataFrame:
    """``path, text`` of single files: HTML is stripped, Markdown only with ``prose_only``, all else is raw."""
    raw = spark.read.format("binaryFile").load(path).select("path", _utf8(F.col("content")).alias("t"))
    html = F.lower("path").rlike(r"\.html?\z")
    return raw.select("path", (loaded_text(F.col("path"), F.col("t")) if prose_only else F.when(html, T.strip_html(F.col("t"))).otherwise(F.col("t"))).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labelled samples."""
    return spark.read.schema("id string, label string, note string, text string, source string").option("multiLine", "true").json(path)


def read_voices(spark: SparkSession, *folders: str) -> DataFrame:
    """``name, label, source, register, body`` of voice profiles; a later folder's profile overrides an earlier one's."""
    out = None
    for folder in folders:
        raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
        field = lambda n: F.regexp_extract("value", rf"(?m)^{n}:[ \t]*(.*?)[ \t]*$", 1).alias(n)
        rows = raw.select(*[field(n) for n in ("name", "label", "source", "register")], F.regexp_replace("value", r"\A---[\s\S]*?\n---\n?", "").alias("body"))
        out = rows if out is None else out.join(rows.select("name"), "name", "left_anti").unionByName(rows)
    return out


def cv_target(body: Column) -> Column:
    """The variation of sentence length that a profile asks for."""
    return F.regexp_extract(body, r"CV\s*(?:~|≥|>=|of|:)?\s*([0-9]+\.[0-9]+)", 1).try_cast("double")


def meets_target(scored: DataFrame, target: Column) -> Column:
    """Whether a draft's variation of sentence length reaches the target; null without one."""
    return T.rounded(scored["cv"], 2) >= target


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "(": "(", ")": ")", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|([\s\S])|$)")


def decode_literal(s: str) -> str:
    """A PDF string's escapes: octal codes, line continuations, letters."""

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 8) & 0xFF)
        return "" if m[2] or not m[3] else _ESCAPES.get(m[3], m[3])

    return _ESCAPE.sub(one, s)


def decode_hex(s: str) -> str:
    digits = re.sub("[^0-9a-fA-F]", "", s)
    return bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("latin-1")


_TOKEN = re.compile(
    r"(?P<dict><<[\s\S]*?(?:>>|\Z))|(?P<hex><[^>]*(?:>|\Z))|(?P<open>\()|(?P<array>\[)|(?P<close>\])|(?P<number>-?[0-9][0-9.]*)|(?P<move>T[dD*])|(?P<line>['\"])"
)


def _literal_end(s: str, start: int) -> int:
    depth, at = 1, start + 1
    for m in re.compile(r"\\[\s\S]|[()]").finditer(s, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            return m.start()
    return len(s)


def text_from_content(content: str) -> str:
    """The text that a content stream shows; wide kerning in an array is a space, moves are line breaks."""
    out, at, inside = [], 0, False
    while m := _TOKEN.search(content, at):
        at = m.end()
        kind = m.lastgroup
        if kind == "open":
            end = _literal_end(content, m.start())
            out.append(decode_literal(content[m.end() : end]))
            at = end + 1
        elif kind == "hex":
            out.append(decode_hex(m[0]))
        elif kind in ("array", "close"):
            inside = kind == "array"
        elif kind == "number" and inside:
            shown = next((x for x in reversed(out) if x), "")
            if float(re.match(r"-?[0-9]*\.?[0-9]*", m[0])[0].rstrip("-.") or 0) < WORD_GAP and not shown.endswith(" "):
                out.append(" ")
        elif kind in ("move", "line") and not inside:
            out.append("\n")
    return "".join(out)


#: Bytes before a stream in which its dictionary stands.
_DICTIONARY = 500


def _inflated(raw: bytes) -> bytes:
    """The bytes of a deflated stream, with or without its header; as far as they go, if it is cut."""
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            if found := zlib.decompressobj(bits).decompress(raw):
                return found
        except zlib.error:
            continue
    return b""


def _streams(data: bytes) -> Iterator[str]:
    """The content of plain and deflated streams; other filters hold no text."""
    end = 0
    while (start := data.find(b"stream", end)) >= 0:
        first = re.compile(rb"\r?\n?").match(data, start + 6).end()
        if (end := data.find(b"endstream", first)) < 0:
            return
        own = data[max(0, start - _DICTIONARY) : start]
        if b"/FlateDecode" in own:
            yield _inflated(data[first:end]).decode("latin-1")
        elif b"/Filter" not in own:
            yield data[first:end].decode("latin-1")
        end += len(b"endstream")


def extract_pdf(data: bytes) -> str:
    """The text that a PDF's content streams show."""
    shows = [s for s in _streams(data) if "(" in s or re.search(r"(?:Tj|TJ|BT)\b", s, re.ASCII)]
    found = [t for t in map(text_from_content, shows) if t.strip()]
    return re.sub("[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "\n".join(found)))).strip()


def _entries(data: bytes) -> Iterator[tuple[str, Callable[[], bytes]]]:
    """Names and bytes of an archive's entries, by its directory. An entry that can't be read is empty; the others stay."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, struct.error):
        return

    def read(entry: zipfile.ZipInfo) -> bytes:
        at = entry.header_offset
        if entry.flag_bits & 1 or entry.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or len(data) < at + 30:
            return b""
        first = at + 30 + int.from_bytes(data[at + 26 : at + 28], "little") + int.from_bytes(data[at + 28 : at + 30], "little")
        raw = data[first : first + entry.compress_size]
        if entry.compress_type == zipfile.ZIP_STORED:
            return raw
        try:
            return zlib.decompress(raw, -zlib.MAX_WBITS)
        except zlib.error:
            return b""

    for entry in archive.infolist():
        yield entry.filename, partial(read, entry)


def _character(n: int) -> str:
    return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else ""


def decode_xml(s: str) -> str:
    """Named references with ``&amp;`` first, then decimal, then hexadecimal ones; a number beyond the last code point gives nothing."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        s = s.replace(a, b)
    s = re.sub("&#0*([0-9]*);", lambda m: _character(int(m[1] or 0) if len(m[1]) < 9 else 1 << 32) if m[0] != "&#;" else m[0], s)
    return re.sub("(?i)&#x0*([0-9a-f]*);", lambda m: _character(int(m[1] or "0", 16) if len(m[1]) < 9 else 1 << 32) if m[0].lower() != "&#x;" else m[0], s)


def extract_docx(data: bytes) -> str:
    """The text of a document's body: paragraphs and breaks are lines, tabs and blanks one blank."""
    body = next((read() for n, read in _entries(data) if n == "word/document.xml"), b"").decode("utf-8", "replace")
    body = re.sub(r"<w:tab\b[^>]*/?>", "\t", re.sub(r"</w:p>|<w:br\b[^>]*/?>", "\n", body))
    text = re.sub("[ \t]+", " ", decode_xml(re.sub(r"<[^>]+>", "", body)))
    return re.sub(r"\n{3,}", "\n\n", re.sub(" *\n *", "\n", text)).strip()


#: Entries of a book with text, and those of them that are no part of it.
_PART, _FRONT = re.compile(r"\.x?html?\Z", re.I), re.compile(r"(?:^|/)(?:nav|toc|cover|title(?:page)?|copyright)\b", re.I | re.ASCII)


def epub_parts(data: bytes) -> list[str]:
    """The HTML of the reading parts, in the archive's order."""
    return [read().decode("utf-8", "replace") for n, read in _entries(data) if _PART.search(n) and not _FRONT.search(n)]


def read_binary(files: DataFrame) -> DataFrame:
    """``path, text`` from ``path, content``: PDF and DOCX in Python batches; EPUB parts are split there and stripped as HTML columns.

    A null path or content, another extension and bytes that can't be read give an empty text."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                kind, data = (path or "").rsplit(".", 1)[-1].lower(), bytes(content or b"")
                found = [extract_pdf(data)] if kind == "pdf" else [extract_docx(data)] if kind == "docx" else epub_parts(data) if kind == "epub" else []
                rows.append((path, kind, found))
            yield pd.DataFrame(rows, columns=["path", "kind", "parts"])

    rows = files.select("path", "content").mapInPandas(parts, "path string, kind string, parts array<string>")
    joined = F.array_join(F.filter(F.transform("parts", T.strip_html), lambda p: p != ""), "\n\n")
    html_parts = T.trim_space(F.regexp_replace(joined, "\n{3,}", "\n\n"))
    return rows.select("path", F.when(F.col("kind") == "epub", html_parts).otherwise(F.array_join("parts", "\n")).alias("text"))


def page_text(body: Column, content_type: Column) -> Column:
    """The prose of a reply: HTML, by its type or its first 2000 characters, is stripped."""
    html = F.lower(T.as_text(content_type)).rlike("html|xml") | F.left(body, F.lit(2000)).rlike("(?i)</?(?:html|body|main|article|p|div)(?![A-Za-z0-9_])")
    return F.when(html, T.strip_html(body)).otherwise(body)


def read_url(spark: SparkSession, url: str, seconds: float = 15) -> DataFrame:
    """``path, text`` of the page behind an address; for drivers with a network only."""
    body, kind = fetch_url(url, seconds)
    return spark.createDataFrame([(url, body, kind)], "path string, body string, kind string").select("path", page_text(F.col("body"), F.col("kind")).alias("text"))


def fetch_url(url: str, seconds: float = 15) -> tuple[str, str]:
    """The body behind an address and its type."""
    from urllib.request import urlopen

    with urlopen(url, timeout=seconds) as reply:
        return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace"), reply.headers.get("content-type") or ""
