"""Licence scans by sparse TF-IDF cosine, with inheritance from directories (operator 9), in DataFrame functions only.

Each line of a text, and the whole text of a licence file, is compared with licence
templates as sparse TF-IDF vectors; the best template of at least ``THRESHOLD`` is the
record's own licence. A record without one takes that of the nearest directory above it
that has a licence file.

Only lines that can reach the threshold are compared: by the Cauchy-Schwarz inequality a
line that shares none of a template's heavy words stays below it. Equal lines are one
line first, so a line that a third of all records have is compared once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

THRESHOLD = 0.75
#: A result of up to so many lines or directories (some 64 MB) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000

# Notices by which licences are known.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAMES = r"^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"


def _vectors() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, word, normalised weight), each word's idf and that of other words."""
    bags = [re.findall("[a-z0-9]+", text.lower()) for _, text in TEMPLATES]
    known = {w: sum(w in bag for bag in bags) for bag in bags for w in bag}
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in sorted(known.items())}
    rows = []
    for k, (name, bag) in enumerate(zip((n for n, _ in TEMPLATES), bags, strict=True)):
        weights = {w: bag.count(w) * idf[w] for w in dict.fromkeys(bag)}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        rows += [(k, name, w, x / norm) for w, x in weights.items()]
    return rows, idf, math.log(1 + len(bags)) + 1


VECTORS, IDF, IDF_OTHER = _vectors()


_COMMON = set("a and any are by in into is it may not of or that the this to with you".split())


def _anchors(threshold: float) -> list[str]:
    """Words of which every line that reaches the threshold has one."""
    out = set()
    for k in range(len(TEMPLATES)):
        light = 0.0
        # any order is right; words that most texts have come first, so that they are light
        for _, weight, word in sorted((w not in _COMMON and not w.isdigit(), x, w) for t, _, w, x in VECTORS if t == k):
            light += weight * weight
            if light >= (threshold - 1e-9) ** 2:
                out.add(word)
    return sorted(out)


ANCHORS = _anchors(THRESHOLD)
_ANCHOR = f"(^|[^a-z0-9])({'|'.join(ANCHORS)})([^a-z0-9]|$)"


def _folded(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def scan(records: DataFrame) -> DataFrame:
    """kind, id, own_license, similarity, inherited_license, inherited_from, license of each record (kind, id, path, text).

    Paths are directories with "/" between; one that ends in "/" or has no "/" is its
    directory's index, which counts as a licence file, as do names like LICENSE or
    COPYING. A null text has no lines; a null path has no directory; repeated rows each
    give a row; ties go to the first template, and in a directory to the name that sorts
    last; an empty table gives no rows.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "licenses")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    index = F.col("path").rlike("/$") | ~F.col("path").contains("/") | _folded(name).rlike(r"^index\.")
    rows = records.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path")))
    rows = rows.withColumn("file", F.coalesce(index | _folded(name).rlike(_NAMES), F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    folded = rows.withColumn("text", _folded(F.col("text")))
    segments = F.array_distinct(F.transform(F.concat(F.split("text", "\n"), F.when(F.col("file"), F.array(F.regexp_replace("text", "\n", " "))).otherwise(F.array())), F.trim))
    lines = F.filter(segments, lambda s: s.rlike(_ANCHOR))
    found = scratch.save(folded.select("row", "kind", "id", "dir", "file", F.when(F.col("text").rlike(_ANCHOR), lines).otherwise(F.array().cast("array<string>")).alias("lines")), "records")
    of_row = found.select("row", F.explode("lines").alias("line"))
    distinct = scratch.save(of_row.select("line").distinct().withColumn("n", F.monotonically_increasing_id()), "lines")

    idf = F.broadcast(spark.createDataFrame(sorted(IDF.items()), "word string, idf double"))  # the templates' words
    weights = F.broadcast(spark.createDataFrame(VECTORS, "template int, name string, word string, weight double"))
    words = distinct.select("n", F.explode(F.filter(F.split("line", "[^a-z0-9]+"), lambda w: w != "")).alias("word")).groupBy("n", "word").agg(F.count("*").alias("tf"))
    words = scratch.save(words.join(idf, "word", "left").select("n", "word", (F.col("tf") * F.coalesce("idf", F.lit(IDF_OTHER))).alias("x")), "words")
    norms = words.groupBy("n").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = words.join(weights, "word").groupBy("n", "template", "name").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    close = dots.join(norms, "n").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("similarity") >= THRESHOLD)
    close = close.groupBy("n").agg(F.max(F.struct("similarity", (-F.col("template")).alias("order"), "name")).alias("best"))
    named = scratch.save(distinct.join(close, "n").select("line", "best"), "named")

    own = of_row.join(_near(named), "line").groupBy("row").agg(F.max("best").alias("best"))
    own = scratch.save(found.drop("lines").join(own, "row", "left").select("row", "kind", "id", "dir", "file", F.col("best.name").alias("own_license"), F.col("best.similarity").alias("similarity")), "own")
    holders = own.filter("file and own_license is not null").groupBy("dir").agg(F.max(F.struct("similarity", "own_license")).alias("best")).select(F.col("dir").alias("above"), F.col("best.own_license").alias("inherited_license"))
    # each directory once, its ancestors as paths
    steps = F.split("dir", "/")
    up = own.filter("own_license is null and dir is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("above")))).alias("a"))
    up = up.select("dir", "a.depth", "a.above").join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "inherited_license", "above")).alias("nearest"))
    up = scratch.save(up.select("dir", "nearest.inherited_license", F.col("nearest.above").alias("inherited_from")), "inherited")
    lacking = F.col("own_license").isNull()
    out = own.join(_near(up), "dir", "left").withColumn("inherited_license", F.when(lacking, F.col("inherited_license"))).withColumn("inherited_from", F.when(lacking, F.col("inherited_from")))
    return out.select("kind", "id", "own_license", "similarity", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))


def _near(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def records(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents under their source, and pages under their address; tags and entities of pages end lines."""
    docs = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("path"), "text")
    path = F.regexp_replace(F.regexp_replace("url", "^[A-Za-z]+://", ""), "[?#].*$", "")
    return docs.unionByName(pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), path.alias("path"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text")))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(records(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _values(rows) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x) if isinstance(x, int) else f"cast({x!r} as double)"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


OP9_SQL = rf"""
with idf(word, idf) as (values {_values(sorted(IDF.items()))}),
weights(template, name, word, weight) as (values {_values(VECTORS)}),
record as (
  select 'document' as kind, doc_id as id, coalesce(source, '') || '/' || coalesce(cast(doc_id as varchar), '') as path, text from documents
  union all
  select 'page', page_id, regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', ''), regexp_replace(html, '<[^>]*>', chr(10), 'g') from pages
), placed as (
  select row_number() over () as r, kind, id, translate(text, '{_UPPER}', '{_LOWER}') as text, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else path end as dir,
    coalesce(path like '%/' or not contains(path, '/') or regexp_matches(translate(regexp_extract(path, '([^/]*)$', 1), '{_UPPER}', '{_LOWER}'), '^index\.')
      or regexp_matches(translate(regexp_extract(path, '([^/]*)$', 1), '{_UPPER}', '{_LOWER}'), '{_NAMES}'), false) as file
  from record
), segment as (
  select distinct r, trim(unnest(case when file then list_append(string_split(text, chr(10)), replace(text, chr(10), ' ')) else string_split(text, chr(10)) end), ' ') as line from placed
), line as (
  select line, row_number() over () as n from (select distinct line from segment where regexp_matches(line, '{_ANCHOR}'))
), word as (
  select n, word, count(*) * coalesce(any_value(idf), cast({IDF_OTHER!r} as double)) as x from (select n, unnest(regexp_split_to_array(line, '[^a-z0-9]+')) as word from line) left join idf using (word) where word <> '' group by n, word
), norm as (
  select n, sqrt(sum(x * x)) as norm from word group by n
), close as (
  select line, name, template, round(sum(x * weight) / any_value(norm), 6) as similarity from word join weights using (word) join norm using (n) join line using (n) group by n, line, name, template
), own as (
  select r, max(row(similarity, -template, name)) as best from segment join close using (line) where similarity >= {THRESHOLD} group by r
), done as (
  select kind, id, dir, file, best[3] as own_license, best[1] as similarity from placed left join own using (r)
), holder as (
  select dir as above, arg_max(own_license, row(similarity, own_license)) as inherited_license from done where file and own_license is not null group by dir
), up as (
  select dir, unnest(generate_series(1, len(string_split(dir, '/')))) as depth from (select distinct dir from done where own_license is null and dir is not null)
), inherited as (
  select dir, arg_max(inherited_license, depth) as inherited_license, arg_max(above, depth) as inherited_from
  from up join holder on above = array_to_string(string_split(dir, '/')[1:depth], '/') group by dir
)
select kind, id, own_license, similarity, case when own_license is null then inherited_license end as inherited_license,
  case when own_license is null then inherited_from end as inherited_from, coalesce(own_license, inherited_license) as license
from done left join inherited using (dir)
"""
