"""What a user types: words and inline filters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrain.functions import analyze, paths

MAX_QUERY = 256
# Fixed values of the filter language.
SIZE_UNITS = {"": 1, "b": 1, "kb": 1_000, "mb": 1_000_000, "gb": 1_000_000_000}
IMAGE_TYPES = ["png", "jpg", "jpeg", "gif", "webp", "heic", "tiff", "bmp", "svg"]
CODE_TYPES = ["rs", "swift", "ts", "tsx", "js", "jsx", "py", "go", "java", "kt", "cpp", "c", "h", "rb", "sh", "sql"]
KIND_NAMES = {"document": ["document", "doc"], "image": ["image", "photo", "picture"], "code": ["code", "source"], "folder": ["folder", "directory", "dir"]}

_DATE = re.compile(r"(\d+)(?:-(\d+))?(?:-(\d+))?$")
_SIZE = re.compile(r"([<>])(\d+)(b|kb|mb|gb|)$")

REQUEST_SCHEMA = (
    "text string, kinds array<string>, folders array<string>, excluded array<string>, tags array<string>, "
    "from_day string, before_day string, min_bytes long, max_bytes long, unrecognised array<string>"
)


@dataclass
class Request:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    from_day: str | None = None
    before_day: str | None = None
    min_bytes: int | None = None
    max_bytes: int | None = None
    unrecognised: list[str] = field(default_factory=list)


def parse_day(text: str) -> str | None:
    """First day of a year, month or day as YYYY-MM-DD."""
    m = _DATE.match(text)
    if not m:
        return None
    y, mo, d = int(m[1]), int(m[2] or 1), int(m[3] or 1)
    return f"{y:04d}-{mo:02d}-{d:02d}" if 1970 <= y <= 9999 and 1 <= mo <= 12 and 1 <= d <= 31 else None


def parse_request(query: str | None) -> Request:
    """Splits a query at blanks into words and filters. Filters that cannot be read are noted, not searched for."""
    r, words = Request(), []
    for token in (query or "").split(" "):
        key, colon, value = token.lower().partition(":")
        if not token:
            continue
        if colon and key == "kind":
            r.kinds.append(value)
        elif colon and key == "in":
            r.folders.append(value.replace("~", ""))
        elif colon and key == "tag":
            r.tags.append(value)
        elif colon and key in ("after", "before"):
            day = parse_day(value)
            if day is None:
                r.unrecognised.append(token)
            elif key == "after":
                r.from_day = day
            else:
                r.before_day = day
        elif colon and key == "size":
            m = _SIZE.match(value)
            if m is None:
                r.unrecognised.append(token)
            elif m[1] == ">":
                r.min_bytes = int(m[2]) * SIZE_UNITS[m[3]]
            else:
                r.max_bytes = int(m[2]) * SIZE_UNITS[m[3]]
        elif token.startswith("-") and len(token) > 1:
            r.excluded.append(token[1:].lower())
        else:
            words.append(token)
    r.text = " ".join(words)
    return r


def parse_requests(queries: DataFrame) -> DataFrame:
    """``(query_id, query)`` to ``(query_id, query, text, filters...)``."""
    kind = dict(queries.dtypes)["query_id"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = pd.DataFrame([vars(parse_request(q)) for q in pdf["query"]], columns=[c.split()[0] for c in REQUEST_SCHEMA.split(", ")])
            for c in ("min_bytes", "max_bytes"):
                parsed[c] = parsed[c].astype("Int64")
            yield pd.concat([pdf[["query_id", "query"]].reset_index(drop=True), parsed], axis=1)

    return queries.select("query_id", "query").mapInPandas(parse, f"query_id {kind}, query string, {REQUEST_SCHEMA}")


def prepared(requests: DataFrame, stems: bool = False) -> DataFrame:
    """Adds ``q`` (trimmed, cut, lower-case), ``words``, ``terms`` and ``literal``; empty queries fall out."""
    cut = F.substring(F.trim("text"), 1, MAX_QUERY)
    out = requests.withColumn("cut", cut).where("cut <> ''").withColumn("q", F.lower("cut"))
    # words and terms come from the query as typed: inner capitals divide them
    out = out.withColumn("words", analyze.query_words(F.col("cut"))).withColumn("literal", F.col("q").rlike("[./]"))
    terms = analyze.index_terms(F.col("cut"))
    return out.withColumn("terms", F.when(F.col("literal"), F.array().cast("array<string>")).otherwise(terms)).drop("cut")


def file_kinds(path: Column, is_dir: Column | None = None) -> Column:
    """Extension and the names of the kind of a file, or of a folder."""
    ext = paths.extension(paths.file_name(path))
    names = F.when(F.lit(False) if is_dir is None else is_dir, F.array(*map(F.lit, KIND_NAMES["folder"]))).when(ext.isin(IMAGE_TYPES), F.array(*map(F.lit, KIND_NAMES["image"]))).when(ext.isin(CODE_TYPES), F.array(*map(F.lit, KIND_NAMES["code"])))
    return F.array_append(names.otherwise(F.array(*map(F.lit, KIND_NAMES["document"]))), ext)


def day_ns(day: Column) -> Column:
    """Nanoseconds of a YYYY-MM-DD day; a day past the month's end runs into the next month."""
    first = F.to_date(F.concat(F.substring(day, 1, 8), F.lit("01")))
    return (F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") + F.substring(day, 9, 2).cast("long") - 1) * 86_400_000_000_000


def matches(r: str = "", is_dir: Column | None = None) -> Column:
    """Whether a file (path, size, mtime_ns, tag; a folder by ``is_dir``) passes the filters of a request in columns prefixed ``r``. A missing attribute fails its filter."""
    c = lambda n: F.col(r + n)
    kinds = file_kinds(F.col("path"), is_dir)
    folder, name = F.lower(paths.directory(F.col("path"))), F.lower(paths.file_name(F.col("path")))
    tags = F.split(F.lower(F.coalesce(F.col("tag"), F.lit(""))), ",")
    ok = (
        F.forall(c("kinds"), lambda k: (k == "") | F.array_contains(kinds, k))
        & F.forall(c("folders"), lambda f: (f == "") | folder.contains(f))
        & ~F.exists(c("excluded"), lambda w: name.contains(w))
        & F.forall(c("tags"), lambda t: F.array_contains(tags, t))
        & (c("from_day").isNull() | (F.col("mtime_ns") >= day_ns(c("from_day"))))
        & (c("before_day").isNull() | (F.col("mtime_ns") < day_ns(c("before_day"))))
        & (c("min_bytes").isNull() | (F.col("size") > c("min_bytes")))
        & (c("max_bytes").isNull() | (F.col("size") < c("max_bytes")))
    )
    return F.coalesce(ok, F.lit(False))


def parse_engine_query(query: Column) -> dict[str, Column]:
    """The low-level grammar: scope from the last ``in:``, ``key:value`` filters with a letter in them (the last of a key counts), stemmed terms of the rest, and the intent.

    A query that leaves no terms is read again as the words without a colon.
    """
    parts = F.filter(F.split(F.trim(query), r"\s+"), lambda p: p != "")
    is_filter = lambda p: p.contains(":") & p.rlike(r"\p{IsAlphabetic}")
    scoped = F.filter(parts, lambda p: p.startswith("in:"))
    given = F.filter(parts, lambda p: ~p.startswith("in:") & is_filter(p))
    keys = F.array_distinct(F.transform(given, lambda p: F.substring_index(p, ":", 1)))
    value = lambda k: F.try_element_at(F.filter(given, lambda p: F.substring_index(p, ":", 1) == k), F.lit(-1))
    filters = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.substr(value(k), F.length(k) + 2).alias("value"))))
    rest = F.array_join(F.filter(parts, lambda p: ~p.startswith("in:") & ~is_filter(p)), " ")
    again = F.array_join(F.filter(parts, lambda p: ~p.contains(":")), " ")
    words = analyze.index_terms(F.when(F.size(analyze.index_terms(rest)) > 0, rest).otherwise(again))
    terms = F.split(analyze.stemmed_all(F.array_join(words, " ")), " ")
    terms = F.filter(terms, lambda t: t != "")
    intent = (
        F.when(F.array_contains(keys, "after") | F.array_contains(keys, "before"), "Recovery")
        .when(F.exists(terms, lambda t: t.rlike(r"[*?]")), "Exploration")
        .when(F.exists(terms, lambda t: t.isin("exist", "find", "check")), "Verification")
        .otherwise("Lookup")
    )
    scope = F.regexp_replace(F.try_element_at(scoped, F.lit(-1)), "^in:", "")
    return {"terms": terms, "words": words, "scope": scope, "filters": filters, "filter_keys": F.array_sort(keys), "intent": intent}
