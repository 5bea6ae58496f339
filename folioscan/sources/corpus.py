"""Corpora: files and tables as documents with a path, a text and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.text import digest, document_key

#: Path components that are never indexed, and suffixes of plain-text files.
DENIED = (".git", ".folioscan", "node_modules", "target", ".local", "auth.json")
PLAIN = ("txt", "md", "mdx", "rst", "log", "csv", "json", "toml", "yaml", "yml", "py", "rs", "js", "ts", "go", "java", "c", "h", "sql")
PLAIN_NAMES = ("readme", "license", "notice")
MOST_BYTES = 64 << 20


def denied(path: Column) -> Column:
    """Whether a component of a path is on the deny list: version control, build output, secrets."""
    return F.exists(F.split(F.lower(path), "/"), lambda c: c.isin(*DENIED) | (c == ".env") | c.startswith(".env.") | c.endswith(".pem") | c.endswith(".key"))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: c.startswith(".") & ~c.isin(".", ".."))


def safe_relative(path: Column) -> Column:
    """Whether a path is relative and has plain components only."""
    return ~path.rlike(r"^/|\\|(^|/)\.{0,2}(/|$)")


def supported(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.regexp_extract(name, r"\.([^./]+)$", 1).isin(*PLAIN) | F.regexp_replace(name, r"\..*$", "").isin(*PLAIN_NAMES)


def files(spark: SparkSession, root: str, most_files: int | None = None) -> DataFrame:
    """Plain-text files below root: path, content, source_sha256 and source_bytes; excluded files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    raw = raw.withColumn("path", F.substring_index(F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/"), prefix, -1))
    chosen = raw.filter(~denied(F.col("path")) & ~hidden(F.col("path")) & supported(F.col("path")) & safe_relative(F.col("path")))
    if most_files is not None and (found := chosen.select("path").limit(most_files + 1).count()) > most_files:
        raise ValueError(f"more than {most_files} files: {found}")
    fits = F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("file is too large: "), F.col("path"))))
    return chosen.select("path", fits.alias("content")).withColumns({"source_sha256": F.sha2("content", 256), "source_bytes": F.octet_length("content").cast("long")}).orderBy("path")


def parsed(sources: DataFrame) -> DataFrame:
    """Documents of plain-text files; bytes that aren't UTF-8 are an error."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
    return described(sources.withColumn("text", text), F.col("path")).withColumns({"source_sha256": F.col("source_sha256"), "source_bytes": F.col("source_bytes")})


def described(rows: DataFrame, path: Column) -> DataFrame:
    """Add doc_key, path, text_sha256, source_bytes and title to rows with a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.withColumns({"path": path, "text": text}).withColumns({"doc_key": document_key(F.col("path")), "text_sha256": digest(F.col("text")), "source_bytes": F.octet_length("text").cast("long"), "title": F.element_at(F.split("path", "/"), -1)})


def corpus_rows(rows: DataFrame) -> DataFrame:
    """Rows of a table of documents (doc_id, source, text) as plain-text files, in folders by source."""
    # Ids of more than eight digits stay whole; documents without a source have a folder of their own.
    number = F.col("doc_id").cast("string")
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("_none")), F.lit("/"), F.when(F.length(number) < 8, F.lpad(number, 8, "0")).otherwise(F.coalesce(number, F.lit("_none"))), F.lit(".txt"))
    return described(rows.select("doc_id", "source", "text"), path)


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a corpus of plain-text files."""
    return corpus_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as paginated documents: a turn is a page."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).cast("int").alias("number"), "role", F.coalesce("text", F.lit("")).alias("text"))


def fresh(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Add source_fresh to recorded documents: whether the source's bytes still have the recorded digest."""
    now = current.select("path", F.col("source_sha256").alias("_now"))
    return recorded.join(now, "path", "left").withColumn("source_fresh", F.coalesce(F.col("_now") == F.col("source_sha256"), F.lit(False))).drop("_now")


def scoped(documents: DataFrame, path: str | None) -> DataFrame:
    """Documents of one exact path; a path that isn't a normal relative one, or unknown, is an error."""
    if path is None:
        return documents
    parts = path.split("/")
    if path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a normal relative path: {path!r}")
    chosen = documents.filter(F.col("path") == path)
    if chosen.isEmpty():
        raise ValueError(f"no such document: {path!r}")
    return chosen
