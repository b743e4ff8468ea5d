"""Files as a source: listing with scope rules, content extraction, fingerprints."""

from __future__ import annotations

import os
import re
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findgrain.functions import paths
from findgrain.sources.documents import EXTRACTORS

CONTENT_BYTES = 64 * 1024
HASHED_AT_ONCE = 1 << 20
# What is left out, what is read, what is never indexed.
EXCLUDED_NAMES = [
    "node_modules", "target", "dist", "build", "tmp", "temp", "cache", "caches",
    "deriveddata", "modulecache", "trash", "__pycache__", "venv", "site-packages", "pods",
]
PACKAGES = [".app", ".photoslibrary", ".framework", ".bundle", ".xcodeproj", ".xcworkspace"]
TEXT_TYPES = [
    "txt", "md", "markdown", "rst", "org", "tex", "log", "csv", "tsv",
    "json", "yaml", "yml", "toml", "xml", "html", "htm", "css", "scss", "ini", "cfg", "conf", "plist",
    "rs", "py", "js", "jsx", "ts", "tsx", "swift", "go", "java", "kt", "c", "h", "cpp", "hpp", "cc", "m", "mm",
    "rb", "php", "sh", "zsh", "bash", "sql", "lua", "r", "scala", "dart", "cs",
]
RICH_TYPES = ["docx", "doc", "rtf", "odt"]
SECRET_FOLDERS = ["/.ssh/", "/Library/Keychains/", "/.aws/", "/.config/gcloud/", "/.gnupg/", "/Keychains/"]
SECRET_TYPES = ["pem", "key", "p12", "pfx", "asc"]
SECRET_NAMES = [".env", "id_rsa", "id_ed25519", "id_dsa", "id_ecdsa"]
HOT_FOLDERS = ["Desktop", "Documents", "Downloads"]


@dataclass(frozen=True)
class Scope:
    """Which files belong to an index; missing keys of a stored one take the defaults."""

    roots: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=lambda: list(EXCLUDED_NAMES))
    max_depth: int = 12
    index_hidden: bool = False
    index_content: bool = True
    memory_budget_mb: int = 256

    def normalised(self) -> Scope:
        """Home expanded, duplicate and nested roots dropped, numbers clamped."""
        full = sorted({os.path.normpath(os.path.expanduser(r)) for r in self.roots})
        kept = [r for r in full if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in full)]
        return replace(self, roots=kept, max_depth=min(64, max(1, self.max_depth)), memory_budget_mb=max(16, self.memory_budget_mb))

    @classmethod
    def of(cls, stored: dict | None) -> Scope:
        """A stored scope; what it does not have or know takes the defaults."""
        return cls(**{k: v for k, v in (stored or {}).items() if k in cls.__dataclass_fields__})


def excluded_name(name: Column, scope: Scope) -> Column:
    out = name.startswith("~$") | (name == ".DS_Store") | F.lower(name).isin(scope.excludes)
    return out if scope.index_hidden else out | name.startswith(".")


def is_package(name: Column) -> Column:
    return F.lower(name).rlike("(" + "|".join(p.replace(".", r"\.") for p in PACKAGES) + ")$")


def root_of(path: Column, scope: Scope) -> Column:
    """The root a path belongs to, null if it is out of scope: too deep, below an excluded name or inside a package."""
    out = F.lit(None).cast("string")
    for root in sorted(scope.roots):
        parts = F.split(F.substring(path, len(root) + 2, 1 << 20), "/")
        deep = F.size(parts) > scope.max_depth
        shut = F.exists(parts, lambda c: excluded_name(c, scope)) | F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), is_package)
        out = F.when(path.startswith(root.rstrip("/") + "/") & ~deep & ~shut, F.lit(root)).otherwise(out)
    return out


def content_kind(path: Column) -> Column:
    ext = paths.extension(paths.file_name(path))
    return F.when(ext == "pdf", "pdf").when(ext.isin(RICH_TYPES), "rich").when(ext.isin(TEXT_TYPES), "text").otherwise("unsupported")


def never_indexed(path: Column) -> Column:
    name = F.lower(paths.file_name(path))
    hit = paths.extension(name).isin(SECRET_TYPES) | name.isin(SECRET_NAMES)
    for part in SECRET_FOLDERS:
        hit = hit | path.contains(part)
    return hit


def queryable(path: Column, network_volumes: bool = False) -> Column:
    """Files on mounted volumes are hidden unless asked for."""
    return F.lit(True) if network_volumes else ~path.startswith("/Volumes/")


def read_contents(network: Column, opted_in: Column) -> Column:
    """Whether contents of a volume's files are indexed: those of a network volume only where it was asked for."""
    return ~network | opted_in


def watch_strategy(network: Column) -> Column:
    """How changes on a volume are noticed."""
    return F.when(network, "poll every 300 s").otherwise("events")


def in_access_scope(path: Column, access: str, home: str) -> Column:
    """``full`` sees all, ``limited`` three folders of the home, anything else nothing."""
    if access == "full":
        return F.lit(True)
    if access != "limited":
        return F.lit(False)
    out = F.lit(False)
    for folder in HOT_FOLDERS:
        out = out | paths.under(path, f"{home}/{folder}")
    return out


def read_text(content: bytes | None, limit: int | None = CONTENT_BYTES) -> tuple[str, bool]:
    """The first ``limit`` bytes (None: all) as text and whether that is all; binary content (a NUL byte) has no text. Never cuts inside a character."""
    if content is None:
        return "", True
    whole, limit = limit is None, len(content) if limit is None else limit
    head = content[:limit]
    if b"\0" in head:
        return "", True
    if len(content) > limit:
        # drop the bytes of a character that the cut divided
        for back in range(1, 4):
            if len(head) >= back and head[-back] & 0xC0 == 0xC0:
                need = 2 + (head[-back] >= 0xE0) + (head[-back] >= 0xF0)
                head = head[:-back] if need > back else head
                break
            if len(head) >= back and head[-back] < 0x80:
                break
    # a text of exactly the limit may go on: nothing beyond it was looked at
    return head.decode("utf-8", "replace"), whole or len(content) < limit


Extractor = Callable[[str, bytes], str]


def read_bytes(uri: str, most: int | None = None) -> bytes:
    """A file of any file system that Arrow knows, on the executor: all of it or its first ``most`` bytes."""
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    with system.open_input_stream(path) as stream:
        return stream.read(most) if most is not None else stream.readall()


@contextmanager
def time_limit(seconds: float):
    """Raises ``TimeoutError`` inside after so many seconds, where this thread can be interrupted."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError(f"longer than {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None, max_bytes: dict[str, int] | None = None, limit: int | None = None, timeout_s: float = 15.0) -> DataFrame:
    """Adds ``content`` and ``full`` to files (``path`` and ``bytes``, or ``uri`` to read them from); each kind by its extractor.

    Text is read here, word-processor and PDF files by ``documents.EXTRACTORS`` unless others are given. Texts are whole, or their
    first ``limit`` bytes where that is given, of which no more is read; ``full`` tells which. Contents are read on the executors, file by
    file, and only of kinds that have an extractor. A file whose extractor fails, or takes longer than ``timeout_s``, has empty
    content, as have unsupported, secret and too large ones; the worker goes on with the next file.
    """
    own = EXTRACTORS | (extractors or {})
    largest = {"pdf": 100 << 20, "rich": 50 << 20} | (max_bytes or {})

    def one(kind: str, path: str, uri: str | None, data: bytes | None, size) -> tuple[str, bool]:
        if kind == "unsupported":
            return "", True
        if kind == "text":
            # one byte more tells whether the limit cut anything off
            data = read_bytes(uri, None if limit is None else limit + 1) if data is None else data
            return read_text(data, limit)
        if size is not None and size > largest.get(kind, 1 << 40):
            return "", True
        data = read_bytes(uri) if data is None else data
        if len(data) > largest.get(kind, 1 << 40):
            return "", True
        with time_limit(timeout_s):
            return read_text(own[kind](path, data).encode(), limit)

    has_bytes, has_uri, has_size = ("bytes" in files.columns), ("uri" in files.columns), ("size" in files.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                try:
                    done.append(one(row["kind"], row["path"], row["uri"] if has_uri else None, row["bytes"] if has_bytes else None, row["size"] if has_size and pd.notna(row["size"]) else None))
                except Exception:
                    done.append(("", True))
            out = pdf.drop(columns=[c for c in ("bytes", "uri", "kind") if c in pdf.columns])
            yield out.assign(content=[t for t, _ in done], full=[f for _, f in done])

    kept = [c for c in files.columns if c not in ("bytes", "uri")]
    kind = F.when(never_indexed(F.col("path")), "unsupported").otherwise(content_kind(F.col("path")))
    if "is_dir" in files.columns:
        kind = F.when(F.col("is_dir"), "unsupported").otherwise(kind)
    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c in kept)
    more = [c for c in ("bytes", "uri") if c in files.columns]
    return files.withColumn("kind", kind).select(*kept, *more, "kind").mapInPandas(run, f"{schema}, content string, full boolean")


def fingerprint(content: Column) -> Column:
    """Hash of the first 64 KiB; 0 for none."""
    return F.coalesce(F.xxhash64(F.substring(content, 1, CONTENT_BYTES)), F.lit(0))


SCAN_SCHEMA = "path string, is_dir boolean, size long, mtime_ns long, uri string"


def _opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path on it, and what to put before a path on it to name it: nothing for local ones."""
    if "://" in uri and not uri.startswith("file:"):
        system, path = fs.FileSystem.from_uri(uri)
        return system, path, uri[: len(uri) - len(path)] if uri.endswith(path) else uri.partition("://")[0] + "://"
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri), ""


def _opened_name(name: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a name as Spark gives it, where nothing is escaped."""
    return _opened(name if name.startswith(("file:", "/")) else quote(name, safe=":/@"))[:2]


def arrow_reads(name: str) -> bool:
    """Whether Arrow knows the file system of a name; other than local ones it must also see what is named there."""
    try:
        system, path = _opened_name(name)
        return isinstance(system, fs.LocalFileSystem) or system.get_file_info(path).type != fs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def hash_bytes(name: str) -> str:
    """What Spark's ``hex(xxhash64(content))`` gives for all bytes of a file, on the executor; read in pieces, so a file of any length fits."""
    import xxhash

    system, path = _opened_name(name)
    made = xxhash.xxh64(seed=42)
    with system.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(HASHED_AT_ONCE):
            made.update(piece)
    return format(made.intdigest(), "X")


def _entries(system: fs.FileSystem, folder: str, scope: Scope) -> list[fs.FileInfo]:
    """What a folder has in it, without links and excluded names; nothing if it cannot be listed."""
    try:
        found = system.get_file_info(fs.FileSelector(folder))
    except OSError:
        return []
    local = isinstance(system, fs.LocalFileSystem)
    return [i for i in found if not shut_name(i.base_name, scope) and not (local and os.path.islink(i.path))]


def shut_name(name: str, scope: Scope) -> bool:
    """``excluded_name`` for one name."""
    return name.startswith("~$") or name == ".DS_Store" or name.lower() in scope.excludes or (not scope.index_hidden and name.startswith("."))


def _row(info: fs.FileInfo, before: str) -> tuple:
    is_dir = info.type == fs.FileType.Directory
    return before + info.path, is_dir, None if is_dir else info.size, info.mtime_ns if not is_dir else None, (before or "file://") + info.path


def _open_folder(info: fs.FileInfo) -> bool:
    return info.type == fs.FileType.Directory and not info.base_name.lower().endswith(tuple(PACKAGES))


def _below(spark: SparkSession, folders: list[str], scope: Scope) -> DataFrame:
    """Everything below some folders. Their upper levels are listed here until there is a folder for every core, the rest by the executors.

    Excluded names, packages and links are not gone into, so their trees cost nothing.
    """
    enough, rows, waiting = 4 * spark.sparkContext.defaultParallelism, [], list(folders)
    while waiting and len(waiting) < enough and len(rows) < 10_000:
        nxt = []
        for folder in waiting:
            system, path, before = _opened(folder)
            for info in _entries(system, path, scope):
                rows.append(_row(info, before))
                if _open_folder(info):
                    nxt.append(before + info.path)
        waiting = nxt
    done = spark.createDataFrame(rows, SCAN_SCHEMA)
    if not waiting:
        return done

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]
        for pdf in batches:
            found = []
            for folder in pdf["folder"]:
                system, path, before = _opened(folder)
                stack = [path]
                while stack:
                    for info in _entries(system, stack.pop(), scope):
                        found.append(_row(info, before))
                        if _open_folder(info):
                            stack.append(info.path)
                    if len(found) >= 10_000:
                        yield _frame(found, columns)
                        found = []
            yield _frame(found, columns)

    seeds = spark.createDataFrame([(f,) for f in waiting], "folder string").repartition(min(len(waiting), enough))
    return done.unionByName(seeds.mapInPandas(walk, SCAN_SCHEMA))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("size", "mtime_ns"):
        out[c] = out[c].astype("Int64")
    return out


def readable_roots(spark: SparkSession, scope: Scope) -> list[str]:
    """The roots that can be listed now; a root that cannot be is no empty one."""
    out = []
    for root in scope.normalised().roots:
        system, path, _ = _opened(root)
        try:
            system.get_file_info(fs.FileSelector(path))
            out.append(root)
        except OSError:
            continue
    return out


def _in_scope(rows: DataFrame, scope: Scope) -> DataFrame:
    placed = rows.withColumn("root", root_of(F.col("path"), scope)).where("root is not null")
    return placed.select("path", "root", "is_dir", "size", "mtime_ns", "uri")


def scan(spark: SparkSession, scope: Scope) -> DataFrame:
    """``(path, root, is_dir, size, mtime_ns, uri)`` of all entries in scope below the roots that can be read; folders are entries too.

    Metadata only: no content is read. Links are not followed.
    """
    scope = scope.normalised()
    return _in_scope(_below(spark, readable_roots(spark, scope), scope), scope)


def stat(spark: SparkSession, names: list[str], scope: Scope) -> DataFrame:
    """As ``scan``, of a few changed paths as they are now: files by themselves, folders with all that is in them. Paths that are gone have no rows."""
    scope, rows, folders = scope.normalised(), [], []
    for name in names:
        system, path, before = _opened(name)
        info = system.get_file_info(path.rstrip("/") or "/")
        if info.type == fs.FileType.NotFound:
            continue
        rows.append(_row(info, before))
        if _open_folder(info):
            folders.append(before + info.path)
    own = spark.createDataFrame(rows, SCAN_SCHEMA)
    return _in_scope(own.unionByName(_below(spark, folders, scope)).dropDuplicates(["path"]), scope)
