"""License scans [native]: MinHash bands over overlapping windows, then exact containment.

Every template has windows of its own size, a little longer than itself and
overlapping so that each passage of its length lies inside one.  A window's
signature is ``bands`` minima of its five-word shingles' hashes, each a band of
its own; a template is retrieved if any band agrees.  A window that holds a
share ``containment`` of a template has a similarity of s or more (``least``),
so it is retrieved with probability 1 - (1 - s) ** bands at least; ``Settings``
refuses a number of bands that leaves this under ``recall``.  Then the share of
the template's shingles in the window is computed exactly.

A minimum can agree only if it is a template's shingle, so windows without any
are not signed: nothing is lost, and most texts end there.  No text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import SIZE, kept_whole, window, with_shingles

#: Short notices and the openings of well-known licence texts.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


@dataclass(frozen=True)
class Settings:
    containment: float = 0.8
    bands: int = 10
    recall: float = 0.999

    def least(self, size: int) -> float:
        """Least similarity of a template of so many words and a window that contains enough of it."""
        own, held = max(1, size - SIZE + 1), max(1, self.span(size) - SIZE + 1)
        return self.containment * own / (held + (1 - self.containment) * own)

    @staticmethod
    def stride(size: int) -> int:
        return max(1, size // 8)

    def span(self, size: int) -> int:
        return size + self.stride(size) - 1

    def check(self, sizes: list[int]) -> None:
        for n in sizes:
            if 1 - (1 - self.least(n)) ** self.bands < self.recall:
                raise ValueError(f"{self.bands} bands find fewer than {self.recall:.1%} of windows of {n} words")


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, settings: Settings = Settings(), max_shingles: int = 100_000) -> DataFrame:
    """One row for each document and template that it holds: doc_id, license, start_word, n_words, containment.

    The row is of the best window, the first on a tie; words are runs of letters
    and digits, numbered from 0 over the whole text.  Null and empty texts hold
    nothing; repeated rows and rows with a null id each give their own rows or
    share them; other columns are ignored.  The templates are a parameter of at
    most ``max_shingles`` shingles: they are sent with the plan.
    """
    spark = docs.sparkSession
    rows = with_shingles(spark.createDataFrame(list(templates.items()), "license string, text string")).select("license", "n_words", F.array_distinct("sh").alias("t")).where("n_words > 0").collect()
    wanted = sorted({h for r in rows for h in r["t"]})
    if len(wanted) > max_shingles:
        raise ValueError("too many templates for one scan; scan them in parts")
    settings.check([r["n_words"] for r in rows])
    sizes = sorted({r["n_words"] for r in rows})
    # Only texts with a template's shingle go on.
    found = (
        with_shingles(docs.select("doc_id", F.col("text").cast("string").alias("text")))
        .select("doc_id", "n_words", "sh").withColumn("hit", kept_whole(F.filter(F.transform("sh", lambda h, i: F.when(h.isin(wanted), i)), lambda i: i.isNotNull()))).where(F.size("hit") > 0)
    )
    # A hit at p lies in the windows that start at multiples of the stride from p + SIZE - span to p.
    def starts(n: int):
        step, span = settings.stride(n), settings.span(n)
        low = lambda p: F.greatest(F.lit(0), F.ceil((p + SIZE - span) / step)).cast("int")
        spans = F.flatten(F.transform("hit", lambda p: F.sequence(low(p), F.greatest(low(p), F.floor(p / step).cast("int")))))
        return F.transform(F.array_distinct(spans), lambda k: F.struct((k * step).alias("s"), F.lit(n).alias("size"), F.lit(span).alias("span")))

    windows = (
        found.select("doc_id", "n_words", "sh", F.explode(F.flatten(F.array(*[starts(n) for n in sizes]))).alias("w"))
        .select("doc_id", "w.s", "w.size", F.least(F.col("w.span"), F.col("n_words") - F.col("w.s")).alias("span"), window(F.col("sh"), F.col("w.s"), F.col("w.span")).alias("sh"))
    )
    minimum = lambda sh, band: F.array_min(F.transform(sh, lambda x: F.xxhash64(x, F.lit(band))))
    sign = lambda sh: F.array(*[minimum(sh, band) for band in range(settings.bands)])
    signed = spark.createDataFrame([(r["license"], r["n_words"], r["t"]) for r in rows], "license string, size int, t array<bigint>").select(
        "license", "size", "t", F.posexplode(sign(F.col("t"))).alias("band", "low")
    )
    candidates = (
        windows.select("*", F.posexplode(sign(F.col("sh"))).alias("band", "low"))
        .join(F.broadcast(signed), ["size", "band", "low"])  # bands x templates rows
    )
    shared = F.size(F.array_intersect("t", "sh")) / F.size("t")
    best = F.max(F.struct("containment", (-F.col("s")).alias("first"), (-F.col("span")).alias("words")))
    return (
        candidates.withColumn("containment", shared).where(F.col("containment") >= settings.containment)
        .groupBy("doc_id", "license").agg(best.alias("b"))
        .select("doc_id", "license", (-F.col("b.first")).cast("long").alias("start_word"), (-F.col("b.words")).cast("long").alias("n_words"), F.col("b.containment").alias("containment"))
    )
