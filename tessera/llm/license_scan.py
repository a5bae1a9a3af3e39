"""License scan with a positional rare-token index, DataFrame functions only.

One pass over the texts keeps, per document, the number of words and, where licence words (a fixed
vocabulary: the words of the phrases and templates below, without function words) stand in it, their places
and the words. Document frequencies over all documents give each licence word its IDF. For each template a
document looks up those RARE_WORDS words of it that have the highest IDF among the document's own; each hit
(document place minus template place) is an alignment, at each alignment the template's words are
intersected with the document's by relative position, and the template counts where its mandatory key
phrase is verified at that alignment: every word of the phrase, function words too, at its own place.
A whole phrase holds its rarest words, so no place of a phrase is missed. All of it works on one
document's arrays, in time proportional to its words, and nothing but word counts is shuffled.

Defined results: a null text counts as empty; a document without licence words has n_base 0, null places,
empty labels and score 0; repeated rows, and rows with null ids, are scanned each for itself; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, table, text_or_empty

# The phrases and labels of the contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further labels of ours. Each template is a key phrase, followed by other words of its notice.
TEMPLATES = {
    "agpl": ("affero general public license", ""),
    "apache-2.0": ("apache license version 2 0", "licensed under the apache license version 2 0"),
    "bsd": ("bsd license", "redistribution and use in source and binary forms with or without modification are permitted"),
    "cc-by": ("licensed under cc by", ""),
    "cc-by-nc": ("licensed under cc by nc", ""),
    "cc-by-sa": ("licensed under cc by sa", ""),
    "creative-commons": ("creative commons", "creative commons attribution license"),
    "gpl-2": ("general public license version 2", "gnu general public license version 2"),
    "gpl-3": ("general public license version 3", "this work is licensed under the gnu general public license version 3"),
    "isc": ("isc license", ""),
    "lgpl": ("lesser general public license", ""),
    "mit-text": ("permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    "mpl": ("mozilla public license", ""),
    "no-warranty": ("without warranty of any kind", "the software is provided as is without warranty of any kind express or implied"),
    "unlicense": ("released into the public domain", "this is free and unencumbered software released into the public domain"),
}
# The notice that supports a base label.
FAMILIES = {"mit": "mit-text", "apache": "apache-2.0", "gpl": "gpl-3"}
# Function words, which are never indexed.
COMMON_WORDS = ("a", "and", "any", "as", "by", "in", "into", "is", "of", "or", "the", "this", "to", "under", "use", "with", "are")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Highest-IDF words of a template that are looked up.
RARE_WORDS = 2
#: Alignments are numbered: place times this, plus the template.
NUMBERS = 64


def _templates() -> list[tuple[int, str, bool, str, list[str]]]:
    """id, label, whether it is a base phrase, kind, words. A notice is a template of its own, for the score."""
    out = [(label, True, "key", phrase.split()) for phrase, label in BASE_PHRASES.items()]
    for label, (key, notice) in TEMPLATES.items():
        out.append((label, False, "key", key.split()))
        if notice:
            out.append((label, False, "notice", notice.split()))
    return [(i, *x) for i, x in enumerate(out)]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _idf(n_docs: int, df: dict[str, int], vocabulary: list[str]) -> dict[str, float]:
    return {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare_words: int = RARE_WORDS) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    places: label and start of each key phrase found. score: the largest, over the labels found, of the share
    (by IDF) of the label's notice that stands at one alignment, its key phrase counted whole; 1 for a label
    without a notice, 0 without labels.
    """
    templates = _templates()
    vocabulary = sorted({w for *_, words in templates for w in words if w not in COMMON_WORDS})
    words = F.regexp_extract_all(F.translate(text_or_empty(text_col), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))
    found = F.filter(F.transform(F.col("words"), lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("p")))), lambda x: x.isNotNull())
    pages = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).withColumn("hits", found)
    kept = F.when(F.size("hits") > 0, F.col("words")).otherwise(_strings([]))
    pages = materialize(pages.select("doc_id", F.size("words").cast("long").alias("n_words"), "hits", kept.alias("words")), "op3-words")

    n_docs = pages.count()
    counted = pages.where(F.size("hits") > 0).select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    idf = _idf(n_docs, {r["w"]: r["n"] for r in counted.collect()}, vocabulary)  # at most the vocabulary

    # The index: a template's words by IDF, with their places in it; its words in order; and their weights.
    index, order, weight = [], [], []
    for t, _, _, kind, ws in templates:
        own = sorted({w for w in ws if w in idf}, key=lambda w: (-idf[w], w))
        entries = [F.struct(F.lit(w).alias("w"), F.array(*[F.lit(q) for q, x in enumerate(ws) if x == w]).alias("q")) for w in own]
        index.append(F.struct(F.lit(t).alias("t"), F.lit(kind == "key").alias("key"), _strings(own).alias("own"), F.array(*entries).alias("entries")))
        order.append(_strings(ws))
        weight.append(F.array(*[F.lit(idf.get(w, 0.0)) for w in ws]))
    total = {t: sum(idf.get(w, 0.0) for w in ws) for t, *_, ws in templates}
    order, weight, needed = F.array(*order), F.array(*weight), F.array(*[F.lit(len(ws)) for *_, ws in templates])

    # Look-up: of the templates whose words the document may hold, its rarest words and where they stand.
    present = pages.withColumn("present", F.array_distinct("hits.w"))
    possible = F.filter(F.array(*index), lambda x: ~x["key"] | (F.size(F.array_except(x["own"], F.col("present"))) == 0))
    looked = F.flatten(F.transform(possible, lambda x: F.transform(F.slice(F.filter(x["entries"], lambda e: F.array_contains("present", e["w"])), 1, rare_words), lambda e: F.struct(x["t"].alias("t"), e["w"].alias("w"), e["q"].alias("q")))))
    rows = present.withColumn("looked", F.when(F.size("hits") > 0, looked))
    places = lambda h: F.flatten(F.transform(F.filter("looked", lambda e: e["w"] == h["w"]), lambda e: F.transform(e["q"], lambda q: (h["p"] - q).cast("long") * NUMBERS + e["t"])))
    rows = rows.withColumn("at", F.array_distinct(F.filter(F.flatten(F.transform("hits", places)), lambda x: x >= 0)))
    # Intersection: which of the template's words stand at their place relative to the alignment.
    here = lambda at, q: F.get("words", F.floor(at / NUMBERS).cast("int") + q)
    t_of = lambda at: (at % NUMBERS).cast("int")
    agree = lambda at: F.transform(F.get(order, t_of(at)), lambda w, q: here(at, q) == w)
    share = lambda at, yes: F.aggregate(F.zip_with(yes, F.get(weight, t_of(at)), lambda y, g: F.when(y, g).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    judged = F.transform("at", lambda at: F.transform(F.array(agree(at)), lambda yes: F.struct(t_of(at).alias("t"), F.floor(at / NUMBERS).alias("at"), (F.size(F.filter(yes, lambda y: y)) == F.get(needed, t_of(at))).alias("whole"), share(at, yes).alias("weight")))[0])
    rows = rows.withColumn("judged", judged).drop("words", "hits", "present", "looked", "at")

    # Verification: key phrases that stand whole, and how much of a label's notice stands.
    keys, bases = [t for t, _, _, kind, _ in templates if kind == "key"], [t for t, _, base, _, _ in templates if base]
    among = lambda some: lambda x: x["t"].isin(some)
    label_of = F.array(*[F.lit(label) for _, label, *_ in templates])
    rows = rows.withColumn("verified", F.filter("judged", lambda x: x["whole"] & x["t"].isin(keys)))
    rows = rows.withColumn("base", F.filter("verified", among(bases)))
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(label_of, x["t"]))))
    scores = []
    for t, label, _, kind, _ in templates:
        if kind == "key":
            notice = [n for n, other, _, k, _ in templates if k == "notice" and other == FAMILIES.get(label, label)]
            stands = F.coalesce(F.array_max(F.transform(F.filter("judged", among(notice)), lambda x: x["weight"])), F.lit(0.0))
            own = (total[t] + stands) / F.lit(total[t] + total[notice[0]]) if notice else F.lit(1.0)
            scores.append(F.when(F.exists("verified", among([t])), own).otherwise(0.0))
    # A table of its own: a filter on it must not repeat the steps above for every hit.
    found = rows.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"), F.array_min("base.at").cast("long").alias("first_word"), F.array_max("base.at").cast("long").alias("last_word"),
        F.array_join(names("base"), ",").alias("base_labels"), F.array_join(names("verified"), ",").alias("labels"), F.round(F.greatest(*scores), 6).alias("score"),
        F.transform("verified", lambda x: F.struct(F.get(label_of, x["t"]).alias("label"), x["at"].cast("long").alias("at"))).alias("places"),
    )
    found = materialize(found, "op3-found")
    release(pages)
    return found


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def _sql() -> str:
    """The same by plain joins: every word with every place in every template."""
    templates = _templates()
    entries = ", ".join(f"({t}, {q}, '{w}', {str(w not in COMMON_WORDS).lower()})" for t, *_, ws in templates for q, w in enumerate(ws))
    heads = ", ".join(f"({t}, '{label}', {str(base).lower()}, '{kind}', {len(ws)}, '{FAMILIES.get(label, label)}')" for t, label, base, kind, ws in templates)
    return f"""
with tp(t, q, w, indexed) as (values {entries}), hd(t, label, base, kind, n, family) as (values {heads}),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as ws from documents),
tok as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as p from d),
df as (select w, count(distinct rid) as n from tok where w in (select w from tp where indexed) group by w),
idf as (select w, ln(((select count(*) from d) + 1) / (coalesce(n, 0) + 1)) + 1 as g from (select distinct w from tp where indexed) left join df using (w)),
tw as (select tp.t, sum(coalesce(g, 0)) as total from tp left join idf using (w) group by 1),
seen as (select distinct rid, t, w, g from tok join tp using (w) join idf using (w)),
look as (select rid, t, w from (select *, row_number() over (partition by rid, t order by g desc, w) as k from seen) where k <= {RARE_WORDS}),
al as (select tok.rid, tp.t, p - q as pos, count(*) as agree, sum(coalesce(g, 0)) as weight from tok join tp using (w) left join idf using (w) left join look on look.rid = tok.rid and look.t = tp.t and look.w = tok.w
  where p >= q group by 1, 2, 3 having bool_or(look.w is not null)),
ver as (select rid, pos, hd.* from al join hd using (t) where kind = 'key' and agree = n),
best as (select rid, label as family, max(weight) as stands from al join hd using (t) where kind = 'notice' group by 1, 2),
nt as (select label as family, total as notice from hd join tw using (t) where kind = 'notice'),
sc as (select ver.rid, max(case when notice is null then 1 else (total + coalesce(stands, 0)) / (total + notice) end) as score
  from ver join tw using (t) left join nt on nt.family = ver.family left join best on best.rid = ver.rid and best.family = ver.family group by 1),
ag as (select rid, count(*) filter (where base) as n_base, min(pos) filter (where base) as first_word, max(pos) filter (where base) as last_word,
  string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels from ver group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0), 6) as score
from d left join ag using (rid) left join sc using (rid)
"""


ORACLE_SQL = _sql()
