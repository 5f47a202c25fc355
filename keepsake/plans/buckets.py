"""Sorting plans: a few buckets with terms, the first that matches takes a file, one takes the rest."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields to match on; most buckets and terms of a plan.
FIELDS, MOST_BUCKETS, MOST_TERMS = ["caption", "name", "source", "kind"], 8, 24


@dataclass
class Bucket:
    name: str
    action: str = "keep"
    folder: str = ""
    field: str | None = None
    terms: tuple[str, ...] = ()
    rest: bool = False


def first_object(text: str) -> dict | None:
    """The first balanced JSON object in a text; None if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


def checked(raw: dict) -> list[Bucket]:
    """Usable buckets of a plan as it was written: what has no known field or no term is dropped, one
    bucket at the end takes the rest."""
    out: list[Bucket] = []
    for b in raw.get("buckets") or []:
        match = (b or {}).get("match") or {}
        rest = match.get("field") == "rest"
        field = match.get("field") if match.get("field") in FIELDS else None
        terms = tuple(t for t in (str(x).lower().strip() for x in match.get("any") or []) if t)[:MOST_TERMS]
        if not rest and not (field and terms):
            continue
        folder = re.sub(r"[^\w \-]", "", str(b.get("folder") or "")).strip()[:40]
        out.append(Bucket(str(b.get("name") or ("Everything else" if rest else "Bucket"))[:40], "drop" if b.get("action") == "drop" else "keep", folder, field, terms, rest))
        if len(out) == MOST_BUCKETS:
            break
    if not out:
        raise ValueError("no usable bucket")
    rest = next((b for b in out if b.rest), Bucket("Everything else", rest=True))
    return [b for b in out if not b.rest] + [rest]


def matches(bucket: Bucket) -> Column:
    """Whether a row of media(caption, name, source, kind) belongs into a bucket."""
    if bucket.rest:
        return F.lit(True)
    text = F.when(F.col("kind") == "video", "video").otherwise("photo") if bucket.field == "kind" else F.lower(F.coalesce(F.col(bucket.field), F.lit("")))
    return F.exists(F.array(*map(F.lit, bucket.terms)), lambda t: F.contains(text, t))


def sort_media(media: DataFrame, plan: list[Bucket]) -> DataFrame:
    """media with bucket and action; one expression, no shuffle."""
    name = F.coalesce(*(F.when(matches(b), F.lit(b.name)) for b in plan))
    drop = F.coalesce(*(F.when(matches(b), F.lit(b.action)) for b in plan))
    return media.withColumn("bucket", name).withColumn("action", drop)


def preview(sorted_media: DataFrame, size: str = "size") -> DataFrame:
    """Files and bytes by bucket and action."""
    return sorted_media.groupBy("bucket", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
