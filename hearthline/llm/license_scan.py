"""License scans by diagonal voting.

Each template (a known phrase or notice) is a list of words. All rolling word
k-grams of a text are hashed, k being the template's own gram length, and joined
to the template positions of the same gram. A hit votes for the diagonal
(place in the text minus place in the template). Diagonals of one template that
lie within SLACK of each other and near in the text are merged, so that inserted
or dropped words don't break a match. A merged span is verified in order: its hits
are walked along the text, those that go back in the template are passed over, and
the template words that the others cover must be at least the template's share.
The hit words themselves are compared, not their hashes.

The texts don't move. A task drops the k-grams that no template holds (the
template table is small and fixed) and emits one row per text with its hits;
the join with the templates, the votes and the spans are Spark's. A text's hits
are all in one group, whose size its own length bounds.

Null texts count as empty: 0 words, no places, empty labels, score 0. Repeated
rows, and rows of a null doc_id, are told apart by their place in the scan and
each gives a row; an empty table gives none. Ties of spans can't change the
result, which holds counts, extremes and sets. Texts of any length are read whole.
Other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.common import LETTERS, by_batch, record, rolling, signed, table, text_bytes, tune, word_hashes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SLACK = 3
GRAM = 4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    share: float = 0.6

    @property
    def words(self) -> list[bytes]:
        return WORD.findall(self.text.encode().lower())

    @property
    def gram(self) -> int:
        """Short templates are one gram, and thereby exact."""
        return len(self.words) if self.base or len(self.words) <= GRAM + 1 else GRAM


# Public license phrases and notices.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache-2.0", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    Template("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc", "This work is licensed under a Creative Commons Attribution International License"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("public-domain", "This work is free and unencumbered and released into the public domain"),
    # whole texts
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    Template(
        "public-domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
)


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(h, k, gram, template, place): all grams of all templates; fixed and small."""
    rows = []
    for t, x in enumerate(templates):
        words, k = x.words, x.gram
        h = signed(rolling(word_hashes([b" ".join(words)], kind=LETTERS)[0], k))
        rows += [(int(h[i]), k, bytearray(b" ".join(words[i : i + k])), t, i) for i in range(len(h))]
    return spark.createDataFrame(rows, "h long, k int, gram binary, template int, place int")


def _hits(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """row_id, doc_id, n_words and the hits (h, k, gram, at) of each row of (row_id, doc_id, b)."""
    wanted: dict[int, np.ndarray] = {}
    for k in sorted({t.gram for t in templates}):
        wanted[k] = np.unique(np.concatenate([rolling(word_hashes([t.text.encode()], kind=LETTERS)[0], k) for t in templates if t.gram == k]))
    hit = pa.struct([("h", pa.int64()), ("k", pa.int32()), ("gram", pa.binary()), ("at", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        h, n = word_hashes(texts, kind=LETTERS)
        ends = np.cumsum(n)
        starts = ends - n
        found: list[list[dict]] = [[] for _ in texts]
        own: dict[int, list[bytes]] = {}  # the words of texts with a hit
        for k, known in wanted.items():
            grams = rolling(h, k)
            near = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            for i in np.flatnonzero(known[near] == grams).tolist():
                d = int(np.searchsorted(ends, i, side="right"))
                if i + k <= ends[d]:
                    at = i - int(starts[d])
                    if d not in own:
                        own[d] = WORD.findall(texts[d].lower())
                    found[d].append({"h": int(grams[i : i + 1].view(np.int64)[0]), "k": k, "gram": b" ".join(own[d][at : at + k]), "at": at})
        return record(row_id=batch.column(0), doc_id=batch.column(1), n_words=pa.array(n), hits=pa.array(found, pa.list_(hit)))

    return by_batch(docs, run, "row_id long, doc_id long, n_words long, hits array<struct<h:long,k:int,gram:binary,at:long>>")


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """The candidate spans of each row of (doc_id, text), and a row with a null label for a text without hits.

    row_id, doc_id, n_words, label, base, first_word, last_word, coverage (of the
    template's words) and verified.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    facts = spark.createDataFrame([(i, t.label, t.base, len(t.words), t.share) for i, t in enumerate(templates)], "template int, label string, base boolean, n int, share double")
    grams = template_grams(spark, templates).join(F.broadcast(facts), "template")
    votes = (
        _hits(docs, templates)
        .select("row_id", "doc_id", "n_words", F.explode_outer("hits").alias("x"))
        .select("row_id", "doc_id", "n_words", "x.*")
        .join(F.broadcast(grams), ["h", "k", "gram"], "left")
        .repartition("row_id")
        .groupBy("row_id", "doc_id", "n_words", "template", "label", "base", "n", "share", "k", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set(F.struct("at", "place")).alias("hits"))
    )
    w = Window.partitionBy("row_id", "template").orderBy("diagonal")
    exact = F.col("n") == F.col("k")  # of one gram: every hit is a span of its own
    apart = exact | (F.col("diagonal") - F.lag("diagonal").over(w) > slack) | (F.col("first") - F.lag("last").over(w) > F.col("n") + slack)
    merged = (
        votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w))
        .groupBy("row_id", "doc_id", "n_words", "template", "label", "base", "n", "share", "k", "span")
        .agg(F.min("first").alias("first_word"), F.max("last").alias("last"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    )
    zero = F.struct(F.lit(-1).alias("place"), F.lit(0).alias("end"), F.lit(0).alias("covered"))
    on = lambda was, x: F.struct(x["place"].alias("place"), (x["place"] + F.col("k")).alias("end"), (was["covered"] + x["place"] + F.col("k") - F.greatest(was["end"], x["place"])).alias("covered"))
    covered = F.aggregate("hits", zero, lambda was, x: F.when(x["place"] > was["place"], on(was, x)).otherwise(was), lambda was: was["covered"])
    coverage = F.when(F.col("n").isNotNull(), covered / F.col("n"))
    return merged.select("row_id", "doc_id", "n_words", "label", "base", "first_word", (F.col("last") + F.col("k") - 1).alias("last_word"), coverage.alias("coverage"), F.coalesce(coverage >= F.col("share"), F.lit(False)).alias("verified"))


def scan_documents(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs: counts and labels of its verified spans."""
    ok, base = F.col("verified"), F.col("verified") & F.col("base")
    found = spans(docs, templates).groupBy("row_id", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",").alias("labels"),
        F.count_if(ok).alias("n_spans"),
        F.coalesce(F.max(F.when(ok, F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return found.drop("row_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
