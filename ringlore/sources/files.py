"""Readers of feeds that come as files."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC05: RFC 4180 with a header; quotes doubled, line breaks inside quotes, blank rows dropped; all columns as text.

    Header names are folded: case, spaces, underscores and hyphens do not matter.
    """
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True)
    df = df.toDF(*[re.sub(r"[\s_\-﻿]", "", c.lower()) for c in df.columns])
    return df.where(F.coalesce(*[F.col(f"`{c}`") for c in df.columns]).isNotNull()) if df.columns else df


def typed(df: DataFrame, schema: dict[str, str], required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """SRC06: (rows with typed columns, problems): a value that does not fit is null and a problem; absent columns are null."""
    row = F.monotonically_increasing_id().alias("row")
    have = df.select(row, *[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in schema])
    cast = {c: F.col(c).try_cast(t) for c, t in schema.items()}
    bad = [F.when(F.col(c).isNotNull() & cast[c].isNull(), F.concat(F.lit(f"{c}: "), F.col(c))) for c in schema]
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in required]
    problems = have.select("row", F.explode(F.filter(F.array(*bad, *missing), lambda x: x.isNotNull())).alias("problem"))
    whole = [F.col(c).isNotNull() for c in required]
    rows = have.select("row", *[v.alias(c) for c, v in cast.items()])
    for test in whole:
        rows = rows.where(test)
    return rows, problems


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC04: one JSON document per file."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC07: a JSON object per line; lines that are none are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


_ITEM = re.compile(r"<(item|entry)\b.*?</\1>", re.S | re.I)
_TRACKING = re.compile(r"^(utm_|fbclid$|gclid$)", re.I)


def _field(item: str, *names: str) -> str | None:
    for n in names:
        if m := re.search(rf"<{n}\b[^>]*>(.*?)</{n}>", item, re.S | re.I):
            text = re.sub(r"^\s*<!\[CDATA\[(.*?)\]\]>\s*$", r"\1", m[1], flags=re.S)
            text = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", text))).strip()
            if text:
                return text[:500]
    return None


def clean_url(url: str | None) -> str | None:
    """The address without tracking parameters; only http and https."""
    parts = urlsplit((url or "").strip())
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not _TRACKING.match(k)]
    return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(kept), ""))


def _items(xml: str) -> list[tuple[str, str | None, str | None]]:
    out = []
    for m in _ITEM.finditer(xml):
        link = re.search(r"<link\b[^>]*href=[\"']([^\"']+)", m[0], re.I)
        url = clean_url(html.unescape(link[1]) if link else _field(m[0], "link"))
        if (title := _field(m[0], "title")) and url:
            out.append((title, url, _field(m[0], "pubDate", "updated", "published")))
    return out


def feed_items(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """SRC08: items of RSS 2.0 and Atom documents: title, link, date as given; plain bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *i) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in _items(x or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], b.schema.field(0).type if i == 0 else pa.string()) for i in range(4)], names=["key", "title", "link", "published"])

    rows = documents.select(F.col(key).alias("key"), xml)
    text = [T.StructField(n, T.StringType()) for n in ("title", "link", "published")]
    return rows.mapInArrow(run, T.StructType([rows.schema["key"], *text]))
