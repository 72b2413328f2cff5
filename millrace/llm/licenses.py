"""Licence scans by a positional rare-token index, in DataFrame operations only.

Licence templates are indexed by their rarest words: document frequencies over the whole corpus give the IDF of the words of
each template's mandatory key phrase, and the index has a posting (word, template, position) for those of highest IDF. A file
that has all words of some key phrase looks up all of its words there; postings that agree on where the phrase would begin are
intersected, and where all of a template's postings meet, the phrase is verified in place and the template's other words are
compared. Only places are shuffled, and the lines of files with such a place; what is broadcast is as large as the templates.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import NOTICES, TEXTS
from .shared import ascii_lower, broadcast_if_small, stored

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of highest IDF that are indexed of a template's key phrase.
INDEXED = 4


@dataclass(frozen=True)
class Template:
    """A licence's words in lower case, the phrase that must stand in a file, and the place of the phrase among the words."""

    label: str
    text: str
    key: str

    def __post_init__(self):
        if not self.key.split() or self.key_at < 0:
            raise ValueError(f"{self.label}: the key phrase is not in the text")

    @property
    def words(self) -> list[str]:
        return re.sub(GAP, " ", self.text.lower()).split()

    @property
    def key_at(self) -> int:
        key, words = self.key.split(), self.words
        return next((i for i in range(len(words)) if words[i : i + len(key)] == key), -1)


TEMPLATES = [Template(*t) for t in [*NOTICES, *TEXTS]]


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _count(haystack: Column, needle: str) -> Column:
    """Occurrences of one character."""
    return F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))


def _let(value: Column, make) -> Column:
    """make(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _base_places(base: dict[str, str]) -> dict[str, list[Column]]:
    """For each base phrase how often it stands in `line`, and the numbers of its first and its last place's first word."""
    line, there = F.col("line"), lambda p, c: F.when(F.contains(F.col("line"), F.lit(f" {p} ")), c)
    back = lambda p: F.substring(F.reverse(line), F.lit(1), F.locate(f" {p} "[::-1], F.reverse(line)) + len(p) + 1)
    return {
        "counts": [F.coalesce(there(p, F.regexp_count("line", F.lit(f" {p}(?= )"))), F.lit(0)) for p in base],
        "first": [there(p, _count(F.substring("line", F.lit(1), F.locate(f" {p} ", line)), " ") - 1) for p in base],
        "last": [there(p, _count(line, " ") - _count(back(p), " ")) for p in base],
    }


def _checked(spots: Column, words: Column, templates: list[Template]) -> Column:
    """array<struct<label, share>> of the spots(template, start) where the template's key phrase stands; words[0] is no word."""
    forms = [{"label": t.label, "words": t.words, "key": t.key.split(), "key_at": t.key_at} for t in templates]
    given = F.from_json(F.lit(json.dumps(forms)), "array<struct<label: string, words: array<string>, key: array<string>, key_at: int>>")
    stands = lambda form, s: F.slice(words, s["start"] + 2, F.size(form["key"])) == form["key"]
    share = lambda form, s: F.size(F.filter(F.transform(form["words"], lambda w, j: F.get(words, s["start"] - form["key_at"] + 1 + j).eqNullSafe(w)), lambda x: x)) / F.size(form["words"])
    one = lambda s: _let(F.get(given, s["template"]), lambda form: F.when(stands(form, s), F.struct(form["label"].alias("label"), share(form, s).alias("share"))))
    return F.array_compact(F.transform(spots, one))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of docs(doc_id, text).

    n_base, first_word and last_word tell of places where a base phrase's words stand consecutively; labels adds those of all
    templates whose key phrase stands in the text. score is the largest share of a found template's words that stand in place,
    1 for a base phrase, else 0. Null and empty texts have no words, no labels ('') and score 0; rows without doc_id are left
    out; repeated rows stay, and rows of one doc_id with other texts are files of their own; a text of any length is split
    into words twice, however many places it has; other columns don't matter; an empty table gives an empty result.
    """
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), GAP, " ")), F.lit(" "))
    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("line"))
    keys = [t.key.split() for t in templates]
    vocabulary = sorted({w for k in keys for w in k})
    places = _base_places(base)
    read = kept.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.col("line") == "  ", 0).otherwise(_count(F.col("line"), " ") - 1).cast("long").alias("n_words"),
        F.array(*places["counts"]).alias("counts"), F.array_min(F.array(*places["first"])).cast("long").alias("first_word"),
        F.array_max(F.array(*places["last"])).cast("long").alias("last_word"), F.array_intersect(_literals(vocabulary), F.split("line", " ")).alias("present"), "line",
    )
    whole = F.exists(F.from_json(F.lit(json.dumps(keys)), "array<array<string>>"), lambda key: F.forall(key, lambda w: F.array_contains("present", w)))
    files = stored(read.withColumn("line", F.when(whole, F.col("line"))), "files")

    n = files.count()
    seen = {r[0]: r[1] for r in files.select(F.explode("present").alias("w")).groupBy("w").count().collect()}  # a row for each key word at most
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}
    rarest = [sorted(set(k), key=lambda w: (-idf[w], w))[:INDEXED] for k in keys]
    postings = [(w, k, i) for k, words in enumerate(keys) for i, w in enumerate(words) if w in rarest[k]]
    index = docs.sparkSession.createDataFrame(postings, "word string, template int, position int")
    needed = _literals([]).cast("array<int>") if not keys else F.array(*[F.lit(sum(w in rarest[k] for w in words)) for k, words in enumerate(keys)])

    looked = files.where("line is not null").select("row", F.posexplode(F.split("line", " ")).alias("place", "word"))
    hits = looked.join(F.broadcast(index), "word").select("row", "template", (F.col("place") - 1 - F.col("position")).alias("start"))
    met = hits.groupBy("row", "template", "start").count().where((F.col("count") == F.get(needed, F.col("template"))) & (F.col("start") >= 0))
    spots = stored(met.groupBy("row").agg(F.collect_list(F.struct("template", "start")).alias("spots")), "spots")
    lines = files.select("row", "line").join(broadcast_if_small(spots.select("row")), "row", "left_semi").join(spots, "row")
    found = lines.select("row", _let(F.split("line", " "), lambda words: _checked(F.col("spots"), words, templates)).alias("found"))
    found = stored(found.select(F.col("row").alias("of"), F.array_distinct("found.label").alias("more"), F.array_max("found.share").alias("share")), "found")

    here = F.array_compact(F.array(*[F.when(F.col("counts")[i] > 0, F.lit(label)) for i, label in enumerate(base.values())]))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    out = files.drop("line", "present").withColumn("base", F.array_sort(F.array_distinct(here))).join(broadcast_if_small(found, 200_000), F.col("row") == F.col("of"), "left")
    return out.select(
        "doc_id", "n_words", total.alias("n_base"), "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(total > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
