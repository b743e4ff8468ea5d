"""Path columns: plain form, parts, ancestors, scope and exclusion predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrain.functions.text import nfc

NEEDS_RESOLVING = r"//|/\.{1,2}(/|$)|[^/]/$|^\.{1,2}(/|$)"


def resolve_dots(p: Column) -> Column:
    """Drops repeated and trailing slashes and resolves ``.`` and ``..`` by text alone.

    ``..`` above an absolute root stays at the root; leading ``..`` of a relative path is kept.
    Null stays null, an empty path stays empty. Paths already plain skip the array work.
    """
    absolute = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda c: (c != "") & (c != "."))

    def step(done: Column, c: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        up = (
            F.when(can_pop, F.slice(done, F.lit(1), F.size(done) - 1))
            .when(absolute, done)
            .otherwise(F.concat(done, F.array(c)))
        )
        return F.when(c == "..", up).otherwise(F.concat(done, F.array(c)))

    stack = F.aggregate(parts, F.array().cast("array<string>"), step)
    plain = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(stack, "/"))
    return F.when(p.rlike(NEEDS_RESOLVING), plain).otherwise(p)


def plain_path(p: Column) -> Column:
    """The plain form under which two spellings of a path are the same file: resolved and composed."""
    return nfc(resolve_dots(p))


def with_plain_path(df: DataFrame, source: str, name: str) -> DataFrame:
    """Adds the plain form in two steps, so that neither is computed again where the other uses it twice."""
    return df.withColumn(name, resolve_dots(F.col(source))).withColumn(name, nfc(F.col(name)))


def file_name(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def directory(p: Column) -> Column:
    return F.regexp_replace(p, "/[^/]*$", "")


def stem(name: Column) -> Column:
    """Name without its last extension; a name that is only an extension keeps it."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def ancestors(p: Column) -> Column:
    """Every prefix of an absolute path that ends at a component, itself included."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def under(p: Column, scope: Column | str) -> Column:
    """At or below a folder, by whole components."""
    s = F.lit(scope) if isinstance(scope, str) else scope
    return (p == s) | p.startswith(F.concat(s, F.lit("/")))
