"""The stages of the pipeline against brute force, on planted copies, benchmark items, nulls and repeated rows."""

import random
import re

import pytest

import corpus_pipeline as pipeline
from tessera.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    rng = random.Random(8)
    tongues = {"en": "the house and water of this world with many small trees", "de": "das wasser und der garten ist nicht gross aber schön", "fr": "la maison et les enfants dans une ville avec leur mère"}
    text = lambda lang, n: " ".join(rng.choice(tongues[lang].split()) for _ in range(n))
    texts = [(lang, text(lang, 80)) for lang in sorted(tongues) * 12]
    texts += [("en", texts[1][1].replace(" ", "  ")), ("en", texts[1][1])]  # exact copies
    texts += [("fr", texts[2][1] + " fin"), ("fr", "voici " + texts[2][1])]  # near copies
    item = text("en", 30)
    texts += [("de", texts[0][1] + " " + item + " " + text("de", 40)), ("en", None), ("en", ""), ("en", "12 ½ --")]
    rows = [(i, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(texts)]
    return rows + [rows[3], rows[37], rows[-3]], [(1, item), (2, None)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, items = make()
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return rows, items, where


def lettered(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def one_exact(rows):
    first = {}
    for r in sorted(rows):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", r[1] or ""), r)
    return list(first.values())


def one_near(rows):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = sorted(rows)
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


def clean(rows, items):
    block = decontaminate.Items([(*x, None) for x in items if x[1]])
    out = []
    for r in rows:
        h = decontaminate.words_of([(r[1] or "").encode()])[0].tolist()
        if not any(block.contaminates(i, h[lo : lo + len(w)]) for i, w in enumerate(block.words) for lo in range(max(1, len(h) - len(w) + 1))):
            out.append(r)
    return out


def tokens(rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path("word_bpe_49k.json"))
    return sum(len(full.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)


def test_stages_against_brute_force(spark, made):
    rows, items, where = made
    docs = pipeline.table(spark, where, "documents")
    key = lambda r: (r[0], r[1] or "", r[2])
    stages = dict(pipeline.STAGES)
    for name, want in {"language ID": lettered(rows), "exact dedup": one_exact(rows), "n-gram Jaccard join": one_near(rows), "benchmark decontamination": clean(rows, items)}.items():
        assert len(want) < len(rows), name
        assert sorted(key(r) for r in stages[name](spark, docs, where).collect()) == sorted(map(key, want)), name
    assert sum(r.length for r in stages["packing"](spark, docs, where).collect()) == tokens(rows)


def test_run_against_brute_force(spark, made):
    rows, items, where = made
    want = clean(one_near(one_exact(lettered(rows))), items)
    out = pipeline.run(spark, where).collect()
    assert sum(r.length for r in out) == tokens(want)
    assert {r.doc_id for r in out} == {r[0] for r in want} if "doc_id" in out[0] else True
