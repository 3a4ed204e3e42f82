"""Licence scan by diagonal voting.

Every rolling word k-gram of every text is hashed and joined in Spark to the positions of the
same k-grams in the templates. A hit votes for its diagonal (its place in the text minus its
place in the template); neighbouring diagonals, which small insertions and deletions cause, are
merged (by less than the template's own length, so copies that follow one another stay apart); a
merged run is verified by the share of the template's words that its hits cover, each word once, by
the words that tell it from other licences (version numbers, named rights holders' clauses; see
``TELLING``), which must all be covered, and by the length of its span. Phrases are templates of one
k-gram: every hit is an exact place. The templates, whole licence texts, notices and short wordings,
are a parameter; their table is some thousand rows and is broadcast behind a check of its size.
Texts are read and rolled once.

Defined cases: a null or empty text has no words, places or labels, and score 0; rows with equal
id and text get equal results, counted once each; repeated ids with different texts are apart;
words are runs of 0-9, a-z (A-Z lower-cased) and bytes from 128 up; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

from .shared import col, lean, written
from .textcore import ALNUM, hashed_words, mix

#: The phrases and labels of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but
not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
dealings in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must
reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct
indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits
or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any
way out of the use of this software even if advised of the possibility of such damage"""
_NEITHER = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all
implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the
use or performance of this software"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject
to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in
a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be
misrepresented as being the original software this notice may not be removed or altered from any source distribution"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
_APACHE = """you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless
required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
either express or implied see the license for the specific language governing permissions and limitations under the license"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""
#: Public licence wordings and the labels this operator adds: whole texts and notices first, then short wordings.
TEMPLATES = {
    _MIT: "mit-text",
    f"{_BSD} {_BSD_END}": "bsd-2-clause-text",
    f"{_BSD} {_NEITHER} {_BSD_END}": "bsd-3-clause-text",
    _ISC: "isc-text",
    _ZLIB: "zlib-text",
    _UNLICENSE: "unlicense-text",
    _APACHE: "apache-text",
    _GPL.format(2): "gpl-2.0-notice",
    _GPL.format(3): "gpl-3.0-notice",
    _MIT[: _MIT.index(" including")]: "mit-grant",
    _BSD[: _BSD.index("\n")]: "bsd-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "released under the mit license": "mit-notice",
    "all rights reserved": "all-rights-reserved",
}
GRAMS = (2, 4)
#: Words that tell licences of like wording apart, besides numbers: all that a template has must be covered.
TELLING = {"apache", "gnu", "cc", "by", "sa", "nc", "mit", "mozilla", "unencumbered", "reserved", "neither", "endorse"}
#: Diagonals at most this far apart belong to one run, which must cover this share of the template's words and may be longer by one word in ROOM.
NEAR, COVER, ROOM = 3, 0.8, 8


#: Stands in front of each text's grams, so that every text is among the hits.
START = -0x5851F42D4C957F2D


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on, where the array has so many."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, 0x6A09E667F3BCC908 + k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def _words(text: str) -> np.ndarray:
    return next(hashed_words(pa.array([text]), ALNUM))[2]


def template_table(spark, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """gram, template, tpos, k, size, label, phrase, telling: a row for each k-gram of each template; telling places of the template's words. Row -1 catches each text's first row."""
    rows = [(START, -1, 0, 0, 0, "", False, [])]
    for number, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        words, is_phrase = _words(text), number < len(phrases)
        k = len(words) if is_phrase else max(g for g in GRAMS if g <= max(GRAMS[0], len(words) // 4))
        if k not in GRAMS:
            raise ValueError(f"a phrase has {' or '.join(map(str, GRAMS))} words: {text!r}")
        telling = [i for i, w in enumerate(text.split()) if w in TELLING or w.isdigit()]
        rows += [(int(h), number, p, k, len(words), label, is_phrase, telling) for p, h in enumerate(gram_hashes(words, k).view(np.int64))]
    if len(rows) > 100_000:
        raise ValueError("too many template k-grams to broadcast")
    return spark.createDataFrame(rows, "gram long, template int, tpos int, k int, size int, label string, phrase boolean, telling array<int>")


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score; and the verified spans (key, id, label, first and last word, cover)."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(col(id_col), col(text_col)).alias("key"), col(id_col).alias("id"), col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def grams(batches):
        for b in batches:
            for first, last, words, at in hashed_words(b.column(2), ALNUM):
                of, flat = [np.arange(last - first)], [np.full(last - first, START, np.int64).view(np.uint64)]
                for k in GRAMS:
                    g = gram_hashes(words, k)
                    row = np.searchsorted(at, np.arange(len(g)), "right") - 1
                    inside = np.arange(len(g)) + k <= at[row + 1]
                    of.append(row[inside])
                    flat.append(g[inside])
                order = np.argsort(np.concatenate(of), kind="stable")
                values = np.concatenate(flat)[order].view(np.int64)
                offsets = np.searchsorted(np.concatenate(of)[order], np.arange(last - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[first:last], b.column(1)[first:last], pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["key", "id", "n_words", "grams"])

    table = F.broadcast(template_table(spark, phrases, templates))
    rolled = rows.mapInArrow(lean(grams), f"key long, id {kind}, n_words long, grams array<long>")
    twos = F.greatest(F.col("n_words") - GRAMS[0] + 1, F.lit(0))  # the text's first row, its pairs, then its longer grams
    pos = F.when(F.col("i") <= twos, F.col("i") - 1).otherwise(F.col("i") - 1 - twos).cast("long")
    placed = rolled.select("key", "id", "n_words", F.posexplode("grams").alias("i", "gram")).join(table, "gram")
    right = F.when(F.col("template") < 0, F.col("i") == 0).otherwise((F.col("i") > 0) & ((F.col("k") == GRAMS[0]) == (F.col("i") <= twos)))
    placed = written(placed.filter(right).select("key", "id", "n_words", "template", "label", "phrase", "k", "size", "telling", pos.alias("pos"), "tpos"), "license-hits")
    hits = placed.filter("template >= 0").drop("id", "n_words").distinct()

    base = hits.filter("phrase").select("key", "label", F.col("pos").alias("first"), (F.col("pos") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("cover"), F.lit(True).alias("base"))
    of_template = Window.partitionBy("key", "template").orderBy("diag", "pos")
    near = F.least(F.lit(NEAR), F.col("size") - 1)
    runs = (hits.filter("NOT phrase").withColumn("diag", F.col("pos") - F.col("tpos"))
        .withColumn("new", (F.col("diag") - F.lag("diag", 1, -(1 << 30)).over(of_template) > near).cast("int"))
        .withColumn("run", F.sum("new").over(of_template)))
    covered = F.flatten(F.transform(F.col("places"), lambda t: F.sequence(t, t + F.col("k") - 1)))  # a template's places: bounded
    verified = (runs.groupBy("key", "template", "run", "label", "size", "k", "telling").agg(F.collect_set("tpos").alias("places"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k") - 1).alias("last"))
        .withColumn("covered", F.array_distinct(covered))
        .withColumn("cover", F.size("covered") / F.col("size"))
        .filter((F.col("cover") >= COVER) & (F.size(F.array_except("telling", "covered")) == 0) & (F.col("last") - F.col("first") + 1 <= F.col("size") + F.floor(F.col("size") / ROOM)))
        .select("key", "label", "first", "last", "cover", F.lit(False).alias("base")))
    spans = base.unionByName(verified)
    found = spans.groupBy("key").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"))
    texts = placed.filter("template < 0").select("key", "id", "n_words")
    out = texts.join(found, "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return out, spans.join(texts.select("key", "id").distinct(), "key")


def brute_base(text: str | None, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """All places of the phrases, word by word: for tests."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def op10_license_scan(spark, sf_dir):
    return scan_licenses(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"))[0]
