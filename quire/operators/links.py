"""References from one document to another, resolved by their normalised places.

A reference is read against the place of the document that holds it, as for web
addresses: a scheme or host of its own, an absolute path, or a path beside the holder's.
Scheme and host are lower-cased, default ports, fragments, ``.`` and ``..`` are taken
out, percent signs of unreserved characters are undone. What is resolved is joined with the
documents' own places; what is not is left to ``missed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scans import let
from quire.plans.skew import lookup

#: The ports that schemes imply.
PORTS = {"http": ":80", "https": ":443", "ftp": ":21"}
_SCHEME, _REST = r"^([A-Za-z][A-Za-z0-9+.\-]*):", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(.*)$"


def _path_of(path: Column) -> Column:
    """A path without ``.`` and ``..``, which never climb above the root."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda held, p: F.when(p == ".", held).when(p == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(p))),
    )
    last = F.get(parts, n - 1)
    joined = F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.regexp_replace(F.when(startswith(path, "/") & ~startswith(joined, "/"), F.concat(F.lit("/"), joined)).otherwise(joined), "^/+$", "/")


def startswith(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))


def _plain(text: Column) -> Column:
    """Percent codes of letters, digits and ``-._~`` as those characters, all others in upper case."""
    pieces = F.regexp_extract_all(text, F.lit("(%[0-9A-Fa-f]{2}|[^%]+|%)"), F.lit(1))
    shown = lambda p: F.chr(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))
    code = lambda p: F.when(shown(p).rlike(r"^[A-Za-z0-9\-._~]$"), shown(p)).otherwise(F.upper(p))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), code(p)).otherwise(p)), "")


def parts_of(place: Column) -> Column:
    """struct(scheme, host, path, query) of a place; what it does not name is null (a path is then empty)."""
    bare = F.regexp_replace(F.trim(place), "#.*$", "")
    found = lambda s: F.struct(
        F.nullif(F.lower(F.regexp_extract(s, _SCHEME, 1)), F.lit("")).alias("scheme"),
        F.when(F.regexp_extract(s, _REST, 1).rlike("^//"), F.lower(F.regexp_extract(F.regexp_extract(s, _REST, 1), r"^//([^/?]*)", 1))).alias("host"),
        F.regexp_extract(F.regexp_replace(F.regexp_extract(s, _REST, 1), r"^//[^/?]*", ""), r"^([^?]*)", 1).alias("path"),
        F.when(s.contains("?"), F.regexp_extract(s, r"\?(.*)$", 1)).alias("query"),
    )
    return let(bare, found)


def _built(p: Column) -> Column:
    host = p["host"]
    for scheme, port in PORTS.items():
        host = F.when((p["scheme"] == scheme) & F.endswith(p["host"], F.lit(port)), F.regexp_replace(p["host"], f"{port}$", "")).otherwise(host)
    path = F.when(p["host"].isNotNull() & (p["path"] == ""), "/").otherwise(_path_of(_plain(p["path"])))
    return F.concat(F.coalesce(F.concat(p["scheme"], F.lit(":")), F.lit("")), F.coalesce(F.concat(F.lit("//"), host), F.lit("")), path, F.coalesce(F.concat(F.lit("?"), _plain(p["query"])), F.lit("")))


def normalised(place: Column) -> Column:
    return let(parts_of(place), _built)


def resolved(reference: Column, base: Column) -> Column:
    """The normalised place that a reference names, read against the holder's own; null if either is."""

    def against(z: Column) -> Column:
        r, b = z["r"], z["b"]
        beside = F.concat(F.when(b["host"].isNotNull() & (b["path"] == ""), "/").otherwise(F.regexp_extract(b["path"], r"^(.*/)?[^/]*$", 1)), r["path"])
        inner = F.when(r["path"] == "", b["path"]).when(startswith(r["path"], "/"), r["path"]).otherwise(beside)
        own = r["scheme"].isNotNull() | r["host"].isNotNull()
        return F.struct(
            F.coalesce(r["scheme"], b["scheme"]).alias("scheme"), F.when(own, r["host"]).otherwise(b["host"]).alias("host"),
            F.when(own, r["path"]).otherwise(inner).alias("path"), F.when((r["path"] == "") & ~own & r["query"].isNull(), b["query"]).otherwise(r["query"]).alias("query"),
        )

    both = F.struct(parts_of(reference).alias("r"), parts_of(base).alias("b"))
    return F.when(reference.isNotNull() & base.isNotNull(), let(let(both, against), _built))


def linked(links: DataFrame, documents: DataFrame, key: str = "doc_id", place: str = "place") -> DataFrame:
    """``links`` with ``target`` (the normalised place) and ``target_id`` (the document there, or null).

    ``links``: ``key`` of the holder and ``reference``. ``documents``: ``key`` and ``place``; of several
    at one place the least key stands for it. Links of unknown holders, and null references,
    have null targets. A place that very many links name is not gathered (``lookup``).
    """
    own = documents.select(F.col(key), F.col(place).alias("_place"))
    held = lookup(links, own.groupBy(key).agg(F.min("_place").alias("_base")), [key])
    named = held.withColumn("target", resolved(F.col("reference"), F.col("_base"))).drop("_base")
    at = own.where("_place IS NOT NULL").groupBy(normalised(F.col("_place")).alias("target")).agg(F.min(key).alias("target_id"))
    return lookup(named, at, ["target"])


def missed(links: DataFrame) -> DataFrame:
    """target and n: the places that links name and no document has, with how many name them."""
    return links.where("target IS NOT NULL AND target_id IS NULL").groupBy("target").agg(F.count("*").alias("n"))
