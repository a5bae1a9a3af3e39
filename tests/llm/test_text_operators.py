"""The text operators against brute force, on nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, packing, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, keep_id string, score string, h string"


def sentence(rng, n, words="the of and to in is was for on that with as it be at by this from or an mit license".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "a", "en", "ing", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " ", "a b", "a  b", "a\tb", "a b", "MIT License mit license", "Under the Apache License, general public license."]
    base = sentence(rng, 120)
    texts += [base, base, base + " x", sentence(rng, 40) + " " + " ".join(base.split()[10:60]), sentence(rng, 3000), "\n".join(sentence(rng, 12) for _ in range(9))]
    words = base.split()
    for k in range(6):
        texts.append(" ".join(words[:k] + ["new"] + words[k:]))
    lines = ["error %d in module alpha beta gamma delta epsilon zeta eta" % k for k in range(4)]
    texts += [line + "\nown line " + sentence(rng, 11) for line in lines]
    out = [(i, t, "en", "k", "s", "h") for i, t in enumerate(texts)]
    return out + [out[9], (None, base, None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("route", [F.xxhash64, lambda b: F.length(b) % 2])
def test_exact_dedup(docs, rows, route):
    """Blocks of 16 bytes give several levels; a poor route gives equal sorting prefixes."""
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    got = exact_dedup.exact_dedup(docs, block_bytes=16, route=route).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_license_scan(docs, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_scan(docs).collect())
    want = collections.Counter()
    for r in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        at = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want[(r[0], len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))] += 1
    assert got == want


def test_chat_round_trip(spark):
    hard = ["\\", "</turn>", "<\\/turn>", "<turn>x\ny</turn>\n", "<part image 0>", "\\\\<turn", "", None, "é\n\\n"]
    rows = [(1, k, "assistant" if k % 2 else "us\ner<\\", t) for k, t in enumerate(hard)] + [(None, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(turns.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(hard)]]
    assert back[1].loss_texts == [t or "" for _, _, r, t in rows[: len(hard)] if r == "assistant"]
    assert back[2].n_turns == 2 and back[None].n_turns == 1


def test_chat_parts(spark):
    parts = [("text", "see <part", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7)]
    got = chat_format.format_chat(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")).first()
    assert got.formatted == "<turn>user\nsee <\\part<part image 1><part audio 2></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in got.attachments] == [("image", "a.png", 256), ("audio", "b.wav", 7)] and got.expanded_tokens == 263


def test_substring_dedup(docs, rows):
    words = [(r[1] or "").encode().split() for r in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = collections.Counter()
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = [x for x, g in zip(w, gone) if not g]
        want[(r[0], len(w), len(w) - len(kept), b" ".join(kept).decode())] += 1
    got = collections.Counter(map(tuple, substring_dedup.substring_dedup(docs, batch_bytes=2000, bucket_entries=500).collect()))
    assert got == want and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(docs, rows, block):
    sets = []
    for r in rows:
        w = (r[1] or "").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else []))
    links = lambda a: sum(b is not a and (sets[b] == sets[a] or bool(sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))) for b in range(len(rows)) if b != a)
    want = collections.Counter((r[0], links(i)) for i, r in enumerate(rows))
    got = near_dedup.near_duplicates(docs, block=block).collect()
    assert collections.Counter((r.doc_id, r.n_links) for r in got) == want
    assert sum(r.keep for r in got) == len({r.class_id for r in got})


def test_line_dedup(docs, rows):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect() if r.doc_id is not None}
    planted = [r[0] for r in rows if r[1] and r[1].startswith("error")]
    assert all(got[i].n_lines == 2 and got[i].n_dropped == 1 and got[i].kept.startswith("own line") for i in planted)
    assert got[14].n_dropped == 0


def test_decontamination(spark, docs, rows):
    rng = random.Random(5)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    para = item.split()
    para[3:6] = ["other"]
    extra = [(100, sentence(rng, 200) + " " + item + " " + sentence(rng, 50), *[None] * 4), (101, sentence(rng, 100) + " " + " ".join(para), *[None] * 4), (102, sentence(rng, 100) + " " + " ".join(item.split()[:10]), *[None] * 4)]
    more = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, " ".join(f"q{k}" for k in range(300)))], "item_id long, text string")
    found = {(r.id, r.item_id) for r in decontaminate.contaminated(more, bench).collect()}
    assert found == {(100, 1), (101, 1)}
    assert decontaminate.decontaminate(more, bench).count() == len(rows) + 1
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_packing(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    full, own = Tokenizer.from_file(path("word_bpe_49k.json")), packing.Tokenizer(path("word_bpe_49k.json"))
    texts = [r.text or "" for r in docs.collect()] + ["It's... 3.5,000 ÀÉ İx ΑΣ <|endoftext|> <|ENDOFTEXT|> q'll", ". ,", "ﬁ ½ x̂"]
    assert all(list(own.ids(t)) == full.encode(t, add_special_tokens=False).ids + [2] for t in texts)
    out = packing.pack(packing.tokenized_pieces(docs, path("word_bpe_49k.json"))).collect()
    assert sum(r.length for r in out) == sum(len(own.ids(r.text or "")) for r in docs.collect())
    windows = collections.defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096


def test_differencing_raises_windows():
    assert [sorted(w) for w in packing.pack_group([3000, 3000, 3000])] and len(packing.pack_group([3000, 3000, 3000])) == 3
    assert sorted(i for w in packing.pack_group([700] * 20) for i in w) == list(range(20))


def test_url_rules(spark):
    urls = ["http://a.com/en/1", "http://a.example.com/en/7x?q", "http://xexample.com/en/7", "http://A.NET/de/8", "http://b.example.net/de/8", "no scheme", None, "http://org#x", "://com/en/"]
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(9)] == ["com/en/", "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None, None, None, "com/en/"]
    assert got[3].host == "a.net" and got[5].host == got[6].path == "" and got[1].verdict == "allow" and got[4].verdict == "block"


def test_language_id(spark, docs):
    from public_tokenizers import path

    tongue = {"en": "the house and the water of this world", "de": "das wasser und der garten ist nicht gross", "fr": "la maison et les enfants dans une ville"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(t.split(), k=12)), lang) for i, (lang, t) in enumerate(sorted(tongue.items()) * 30)] + [(900, None, "en"), (901, "12 ½ --", "en"), (None, "the house", None)]
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path("piece_bpe_32k.model"), language_id.trains()).collect()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 900)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901)} == {"und"} and all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    from public_tokenizers import path

    none = empty(spark)
    assert exact_dedup.exact_dedup(none).count() == license_scan.license_scan(none).count() == substring_dedup.substring_dedup(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == line_dedup.line_dedup(none).count() == 0
    assert packing.pack(packing.tokenized_pieces(none, path("word_bpe_49k.json"))).count() == 0
    assert url_filter.url_filter(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))).count() == 0
    assert language_id.language_id(none, path("piece_bpe_32k.model"), language_id.trains()).count() == 0


def test_decontamination_recall_at_the_limits(spark):
    """Every pair that a search of all windows finds: copies, and paraphrases that the verifier only just accepts."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(30)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.62 else f"rare{rng.randrange(4000)}" for _ in range(rng.randrange(15, 56)))) for i in range(150)]
    texts = []
    for i, item in items:
        words = item.split()
        n, answer = len(words), len(words) - decontaminate.ANSWER_WORDS
        share = (0.2, 0.4)[i % 2]  # without and with the answer
        order = sorted(range(n if i % 2 == 0 else answer), key=lambda k: (words[k] in common, rng.random()))
        for k in order[: int(share * n)]:
            words[k] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(rng.choices(common, k=rng.randrange(40)) + words + rng.choices(common, k=rng.randrange(40))))
    texts += [" ".join(rng.choices(common, k=60)) for _ in range(50)]
    block = decontaminate.Items([(*x, None) for x in items])
    truth = set()
    for d, text in enumerate(texts):
        h = decontaminate.words_of([text.encode()])[0].tolist()
        truth |= {(d, i) for i, w in enumerate(block.words) if any(block.contaminates(i, h[lo : lo + len(w)]) for lo in range(max(1, len(h) - len(w) + 1)))}
    assert {(i, i) for i in range(150)} <= truth
    found = {(r.id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert truth <= found


@pytest.mark.parametrize("n", [15, 16, 17, 33, 64, 65, 150])
def test_decontamination_limit_is_implied(n):
    """Texts that hold the least the verifier accepts, of the lightest words, are found whatever the size class leaves over."""
    rng = random.Random(n)
    item = [f"w{k}" for k in range(n)]
    block = decontaminate.Items([(7, " ".join(item), None)])
    idf = decontaminate._idf(2.0 ** np.array([rng.randrange(13) for _ in range(n)]), 5000)
    weight = dict(zip(block.vocabulary.tolist(), idf, strict=True))
    of = {w: weight[h] for w, h in zip(item, block.words[0], strict=True)}
    answer, space = item[-decontaminate.ANSWER_WORDS :], decontaminate.Space(block, [0], idf)
    for share, always in ((decontaminate.SAME, []), (decontaminate.PARAPHRASE, answer)):
        others = sorted((w for w in item if w not in always), key=of.get)
        kept = {*always, *others[: -int(-share * n // 1) - len(always)]}
        text = " ".join(["x"] * 77 + [w if w in kept else "new" for w in item] + ["x"] * 9).encode()
        assert [(d, i) for d, i, _ in decontaminate._found([b"x y", text, b""], block, [space])] == [(1, 0)]


def test_url_training_by_rules(spark, monkeypatch):
    """No host holds a seed term: rule-blocked URLs alone train the rejected model, each once however often it is repeated."""
    samples, fit = [], url_filter.fitted
    monkeypatch.setattr(url_filter, "fitted", lambda *both, **how: samples.extend([u for u, _ in x] for x in both[:2]) or fit(*both, **how))
    good = [f"http://library{k}.edu/catalogue/{k * 37}" for k in range(300)]
    blocked = [f"http://win{k}.com/en/bonus-jackpot-{k}" for k in range(300)]
    unruled = [f"http://win{k}.org/bonus-jackpot-{k}" for k in range(20)]
    urls = good * 2 + blocked * 3 + unruled
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_filter(pages, loss=0.1).collect()}
    accepted, rejected = samples
    assert len(got) == len(urls) and len(set(accepted)) == len(accepted) and len(set(rejected)) == len(rejected)
    assert set(rejected) <= set(blocked) and len(rejected) > 200 and not set(accepted) & set(blocked)
    assert sum(got[i].verdict == "allow" for i in range(600)) >= 0.95 * 600
    assert max(got[1500 + k].score for k in range(20)) < min(got[i].score for i in range(600))
    left_out = [r for r in got.values() if r.rule is None and urls[r.page_id] not in accepted]
    assert sum(r.verdict == "block" for r in left_out) <= 0.1 * len(left_out)


def test_line_templates_without_digits(spark):
    """Fields without a digit: in short lines, among the leading tokens, and in several parts of a line."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choices("bcdfghjklm", k=9))
    forms = [
        lambda: f"User {name()} logged in from {name()}",
        lambda: f"{name()} wrote on this page",
        lambda: f"posted by {name()}",
        lambda: f"{name()} visit the {name()} archive for more of what we print each week in our {name()} section today",
    ]
    texts = [f"{form()}\nown {name()} {name()} {name()} {name()}" for form in forms for _ in range(40)]
    texts += ["\n".join(f"list of {name()} things" for _ in range(9))]  # of one document alone
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(160):
        assert got[i].kept == texts[i].split("\n")[1], texts[i]
    assert got[160].n_dropped == 0


def test_license_phrases_are_whole(spark):
    notice = "redistribution and use in source and binary forms with or without modification are permitted"
    texts = ["licensed under cc by", "licensed foo cc bar", "released xx yy public domain", "released into the public domain", "bsd license " + notice, "bsd license " + notice.replace("binary", "other"), "bsd license " + notice.replace("redistribution", "other")]
    got = [r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r.labels for r in got] == ["cc-by", "", "", "unlicense", "bsd", "bsd", "bsd"]
    assert got[4].score == 1 and 0 < got[5].score < 1 and 0 < got[6].score < 1
