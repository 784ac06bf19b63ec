"""Each operator on a small table with every awkward case, against a plain version."""

import collections
import hashlib
import itertools
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, conversations, decontaminate, filter_audit, langid, licenses, near_dup, pii, quality, rules, suffix_dedup, toxicity, word_dedup
from millrace.llm.license_texts import TEXTS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key string, hit int, sig int"
R = random.Random(5)


def words(n, rng=R):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


LONG = words(6_000)
BASE = words(120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS_ = [None, "", "   \n", "...!!", BASE, BASE, NEAR, LONG, LONG[:9_000] + words(40), "a" * 1_500, "é" * 900 + "日本 ok", words(3), words(40) + "\n" + words(40)]


def frame(spark, texts, first=0):
    """Documents with columns that clash with the operators' own."""
    rows = [(first + i if i != 2 else None, t, "en" if i % 2 else None, "s", len(t or ""), 0.5, "x", "k", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS_).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(spark, docs, none):
    fr, en = "le chat est dans la maison avec une souris", "the cat sits within this house where another mouse lives"
    train = frame(spark, [en, fr] * 4).withColumn("lang", F.when(F.col("text") == fr, "fr").otherwise("en"))
    profiles = langid.learn_profiles(train)
    got = {r["text"]: r for r in langid.identify(frame(spark, [fr, en, None, "", "123 !"]).withColumn("t", F.col("text")), profiles, ["text"], "t").collect()}
    assert got[fr]["lang_pred"] == "fr" and got[en]["lang_pred"] == "en"
    assert all(got[t]["lang_pred"] == "und" and got[t]["score"] == 0 for t in (None, "", "123 !"))
    ref = {}
    for lang, text in (("en", en), ("fr", fr)):
        padded = re.sub(r"\s+", " ", f" {text} ")
        grams = [padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1) if padded[i : i + k] != " "]
        ref[lang] = sorted(set(grams), key=lambda g: (-grams.count(g), sum(ord(c) << 21 * i for i, c in enumerate(g))))[: langid.PROFILE]
    learned = {}
    for r in profiles.orderBy("lang", "rank").collect():
        learned.setdefault(r["lang"], []).append("".join(chr(r["code"] >> 21 * i & 0x1FFFFF) for i in range(3)).rstrip("\0"))
    assert learned == ref
    assert langid.identify(docs, langid.learn_profiles(none), ["doc_id"]).where("lang_pred != 'und'").count() == 0
    assert langid.identify(none, profiles, ["doc_id"]).count() == 0


def test_language_by_plain_distances(spark):
    """Predictions and scores against out-of-place distances counted one by one, ties between languages included."""
    rng = random.Random(6)
    speak = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    kinds = {"aa": "abcde", "bb": "cdefg", "cc": "éàçxyz", "dd": "абвгд", "zz": "abcde"}
    train = [(lang, speak(letters, 40)) for lang, letters in kinds.items() if lang != "zz" for _ in range(5)]
    train += [("zz", t) for lang, t in train if lang == "aa"]  # the same profile twice: the language that sorts first wins
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))

    def grams(text):
        padded = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        return [padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1) if padded[i : i + k] != " "] if padded.strip() else []

    def ranked(all_grams):
        counts = collections.Counter(all_grams)
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.PROFILE]

    profiles = {lang: {g: i for i, g in enumerate(ranked([g for own, t in train if own == lang for g in grams(t)]))} for lang in kinds}
    texts = [speak(rng.choice(list(kinds.values())), rng.randint(1, 60)) + rng.choice(["", " 12!", "\n\n"]) for _ in range(60)] + ["ghij", "a", "1 2", "qqq www", "Ab  aB\tab"]
    learned = langid.learn_profiles(frame(spark, [t for _, t in train]).drop("lang").join(spark.createDataFrame([(t, lang) for lang, t in train], "text string, lang string").distinct(), "text"))
    got = {r["text"]: r for r in langid.identify(frame(spark, texts).withColumn("t", F.col("text")), learned, ["text"], "t").collect()}
    for t in texts:
        top = ranked(grams(t))
        if not top:
            assert (got[t]["lang_pred"], got[t]["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert got[t]["lang_pred"] == best and abs(got[t]["score"] - (1 - far[best] / (langid.PROFILE * len(top)))) < 1e-9, t


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())][::-1]
        if 12 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_patterns():
    rng = random.Random(1)
    for _ in range(4_000):
        t = "".join(rng.choice(["a", "b@", "@", ".", ".c", "1", "23", "255.", "-", " ", "+4", "(", "4539 1488 0343 6467", "10.0.0.1", "x@y.z", "é"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_personal_data(spark, docs, none):
    texts = [f"{words(5)} write to {w}@mail.example.com please now {words(4)}" for w in ("ann", "bob", "cy", "dee", "eve", "fay", "gus", "hal", "ida", "jo", "kim", "lee", "max", "ned")]
    texts += [f"{words(5)} write to pat(at)site9 please now {words(4)}", None, "", "call +1 (312) 555-0100"]
    got = {r["text"]: r for r in pii.find(frame(spark, texts).withColumn("t", F.col("text")), ["text"], "t").collect()}
    hidden = got[texts[14]]
    assert [(s["kind"], texts[14][s["start"] : s["end"]]) for s in hidden["spans"]] == [("email", "pat(at)site9")] and not hidden["base"]
    assert all(len(got[t]["spans"]) == len(got[t]["base"]) == 1 for t in texts[:14])
    assert not got[None]["spans"] and not got[""]["spans"]
    red = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts), ["doc_id", "text", "key", "spans"]).collect()}
    assert red[17] == "call <phone>" and "<email>" in red[0] and red[15] is None
    assert pii.find(none, ["doc_id"]).count() == 0 and pii.find(docs, ["doc_id", "key", "source"]).count() == len(TEXTS_)


def test_personal_data_of_several_words(spark):
    def card(i):
        head = f"4539 1488 {1000 + i:04d} 64"
        return next(c for c in (f"{head}{d:02d}" for d in range(100)) if pii.luhn(c.replace(" ", "")))

    texts = [f"{words(5)} dial +1 (312) 555-{2000 + i} for help {words(4)}" for i in range(30)] + [f"{words(5)} card number {card(i)} expires soon {words(4)}" for i in range(30)]
    hidden = {"phone": ["(312) 555-0100", "020 7946 0958"], "card": ["4539 1488 0343 6468"]}
    assert not pii.luhn("4539148803436468")
    texts += [f"{words(5)} dial {p} for help {words(4)}" for p in hidden["phone"]] + [f"{words(5)} card number {p} expires soon {words(4)}" for p in hidden["card"]]
    got = {r["text"]: r["spans"] for r in pii.find(frame(spark, texts), ["text"]).collect()}
    for t, kind, value in zip(texts[60:], ["phone", "phone", "card"], hidden["phone"] + hidden["card"]):
        assert [(s["kind"], t[s["start"] : s["end"]]) for s in got[t]] == [(kind, value)]


def test_discovered_instances_bring_in_patterns(spark):
    texts = [f"{words(5)} write to who{i}@mail.example.com please now {words(4)}" for i in range(120)]
    texts += [f"{words(5)} write to user(at)site{i} please now {words(4)}" for i in range(20)]
    texts += [f"{words(5)} my own handle user(at)site{i} since last year {words(4)}" for i in range(20)]
    texts += [f"{words(5)} my own handle lone(at)place7 since last year {words(4)}"]
    t = texts[-1]
    got = {r["text"]: r["spans"] for r in pii.find(frame(spark, texts), ["text"]).collect()}
    assert [(s["kind"], t[s["start"] : s["end"]]) for s in got[t]] == [("email", "lone(at)place7")]


def test_secrets_and_ties(spark, none):
    rng = random.Random(6)
    secret = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n)) + "a1"
    texts = [f"{words(8, rng)} token = \"{secret(38)}\" {words(8, rng)}" for _ in range(12)] + [f"x token = \"{secret(9)}\" y", f"{words(5)} {secret(38)} {words(5)}"]
    texts += ["long " + "w" * 300 + f" id 1.2.3.{k} end" for k in range(8)] + ["long " + "w" * 300 + " id 77-12 end", "long " + "w" * 299 + "v id 77-13 end"]
    rows = frame(spark, texts).withColumns({"Spans": F.lit("own"), "base": F.lit(2)})
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(rows, ["doc_id", "Spans", "base"]).collect()}
    for i in [0, 1, *range(3, 13)]:
        start = texts[i].index('"') + 1
        assert got[i] == [("secret", start, texts[i].index('"', start))]
    assert got[13] == [] and [k for k, _, _ in got[22]] == ["ip"]
    both = [f"{words(3, rng)} call at {x} now {words(2, rng)}" for k in range(8) for x in (f"a{k}@b.org", f"+1 800 555 01{k}0")]
    got = pii.find(frame(spark, [*both, "call at 12345 now"], 3), ["text"])
    assert {s["kind"] for r in got.where("text like 'call at 12345%'").collect() for s in r["spans"]} <= {"email"}
    assert pii.find(none, ["doc_id", "spans"]).count() == 0


def test_licenses(spark, docs, none):
    mit = TEXTS[0][2]
    changed = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit.replace(",", " ,").replace("sublicense", "sublicence").upper()
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, [mit, changed, None, mit + " extra", "Some text.\nReleased under the MIT Licence\nx", ""]), ["doc_id", "key"]).collect()}
    assert got[0]["license_id"] == got[1]["license_id"] == "MIT" and got[3]["license_id"] is None and got[5]["license_id"] is None
    assert got[4]["n_notices"] == 1 and got[4]["notices"] == "MIT" and got[4]["key"] == "k"
    assert licenses.scan(none, ["doc_id"]).count() == 0 and licenses.scan(docs, ["doc_id"]).count() == len(TEXTS_)


def test_licenses_at_every_width(spark):
    """Wrapped anywhere, with titles and notices of one and of several lines."""
    known = dict(licenses.known())
    digest = lambda t: known.get(hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest())
    wrap = lambda t, w: "\n\n".join(textwrap.fill(" ".join(p.split()), w) for p in t.split("\n\n"))
    texts = []
    for name, title, body in TEXTS:
        for width in range(30, 130):
            text = wrap(body, width)
            assert digest(text) == name, (name, width)
            if width % 25 == 5:
                heads = [f"The {title} ({name})\n\nCopyright (c) 2020, 2021 A. Person\n", f"{title}\n\nCopyright 2019 A. Person,\n  B. Person and others\nfor Some Company\n", "(C) 2001 by A. Person\nAll rights reserved.\n", f"/* {title}\n * Copyright © 2020 A\n */\n"]
                texts += [(name, f"{h}\n{text}") for h in heads]
    got = {r["text"]: r["license_id"] for r in licenses.scan(frame(spark, [t for _, t in texts]), ["text"]).collect()}
    assert [(n, got[t]) for n, t in texts] == [(n, n) for n, _ in texts]


def test_long_licenses(spark):
    folder = "/usr/share/common-licenses"
    named = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all(os.path.exists(f"{folder}/{f}") for f in named):
        pytest.skip("no licence texts on this machine")
    texts = [open(f"{folder}/{f}", encoding="utf-8").read() for f in named]
    got = {r["text"]: r["license_id"] for r in licenses.scan(frame(spark, texts), ["text"]).collect()}
    assert [got[t] for t in texts] == list(named.values())


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(500):
        s = [rng.randint(0, rng.randint(1, 5)) for _ in range(rng.randint(1, 60))]
        assert suffix_dedup.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def plain_removed(data):
    """What stays when every byte under a 400-byte string that starts twice goes."""
    seen = {}
    for i, b in enumerate(data):
        for k in range(len(b) - 399):
            seen.setdefault(b[k : k + 400], []).append((i, k))
    cover = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                cover[i][k : k + 400] = b"\1" * 400
    return [(len(b), sum(c), len(re.findall(b"\1+", bytes(c))), hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest(), any(c)) for b, c in zip(data, cover)]


REMOVED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats"]


@pytest.mark.parametrize("most", [16_384, 3, 1])
def test_suffix_dedup(spark, docs, none, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    shared = words(120)
    texts = [*TEXTS_, words(90) + shared + words(90), shared[7:] + words(10), words(50) + shared[:450], shared[:399], "ab" * 400, words(10) + LONG[500:1_200]]
    texts += [words(5) + shared[k : k + 401 + 3 * k] + words(5) for k in range(12)]
    want = plain_removed([(t or "").encode() for t in texts])
    rows = frame(spark, texts).withColumns({"n_bytes": F.lit("own"), "Kept_SHA256": F.lit(0)})
    got = suffix_dedup.remove_repeats(rows, ["doc_id", "text", "n_bytes", "Kept_SHA256"], with_kept=True).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in REMOVED)) for r in got) == sorted((i == 2, 0 if i == 2 else i, *w) for i, w in enumerate(want))
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    if most == 3:
        assert suffix_dedup.remove_repeats(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("most", [16_384, 700])
def test_suffix_dedup_of_a_common_passage(spark, most, monkeypatch):
    """More segments of one anchor than a sorting batch or a block of rows holds, whole and split."""
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng, passage = random.Random(4), words(90)[:420]
    texts = [words(rng.randint(1, 9), rng) + passage[rng.randint(0, 30) :] + words(rng.randint(1, 9), rng) for _ in range(2_500)]
    want = plain_removed([t.encode() for t in texts])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert [tuple(r[c] for c in REMOVED) for r in sorted(got)] == want


def test_segments_share_what_strings_share():
    rng = random.Random(8)
    for _ in range(30):
        anchor, groups = rng.randbytes(suffix_dedup.ANCHOR), []
        for _ in range(3):
            base_l, base_r = rng.randbytes(300), rng.randbytes(300)
            group = []
            for _ in range(rng.randint(2, 9)):
                l, r = rng.randint(0, 300), rng.randint(0, 300)
                before = (rng.randbytes(300 - l) + base_l[300 - l :])[-rng.randint(0, suffix_dedup.LEFT) :]
                after = (base_r[:r] + rng.randbytes(300 - r))[: rng.randint(0, suffix_dedup.RIGHT - suffix_dedup.ANCHOR)]
                group.append((before + anchor + after, len(before)))
            groups.append(sorted(set(group)))
        flat = [s for g in groups for s in g]
        left, right = suffix_dedup.ranges(flat, np.repeat(np.arange(3), [len(g) for g in groups]))
        at = 0
        for g in groups:
            strings = [{off - k: data[k : k + 400] for k in range(max(0, off - suffix_dedup.LEFT), len(data) - 399)} for data, off in g]
            for i, mine in enumerate(strings):
                hit = [x for x, t in mine.items() if any(other.get(x) == t for j, other in enumerate(strings) if j != i)]
                assert (left[at], right[at]) == ((max(hit), 400 - min(hit)) if hit else (0, 0))
                at += 1


def test_bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = random.Random(3)
    odd = ["don't I'll <|endoftext|>x <|startoftext|>", "İΣσς ΟΔΟΣ ẞ ﬁ 日本語 a\x1cb 🎉 é   x　y", "hahahahaha loooool", "".join(chr(rng.choice([rng.randint(33, 126), rng.randint(160, 1500)])) for _ in range(3_000))]
    texts = [*filter(None, TEXTS_), *odd, "", "hahaha " * 40, "aaaaa" * 9, "日本語" * 200]
    ids, n = own.encode(texts)
    decoded, ends = own.decode(ids, n).to_pylist(), np.cumsum(n)
    for t, got, text in zip(texts, np.split(ids, ends), decoded):
        want = ref.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want and text.decode() == ref.decode(want, skip_special_tokens=False), t[:80]


def plain_bpe(word, ranks):
    """Merge the pair of least rank, from left to right, until none is left."""
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks]:
        rank, i = min(pairs)
        word = [*word[:i], word[i] + word[i + 1], *word[i + 2 :]]
    return word


def test_bpe_automaton():
    rng = random.Random(12)
    for _ in range(60):
        symbols = [c + e for c in "abc" for e in ("", "</w>")]
        tokens, merges = list(symbols), []
        while len(merges) < 14:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if not a.endswith("</w>") and a + b not in tokens:
                tokens.append(a + b)
                merges.append([a, b])
        made = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges, "</w>")
        ranks = {tuple(m): i for i, m in enumerate(merges)}
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["a" * 120, "ab" * 70]
        ids, n = made.encode([w.encode() for w in words])
        for w, got in zip(words, np.split(ids, np.cumsum(n))):
            want = plain_bpe([*w[:-1], w[-1] + "</w>"], ranks)
            assert [made.labels[i] for i in got] == want
            assert all(made.arc(s, t) for s, t in zip([0, *made.target[got[:-1]]], got))


def test_bpe_rows(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.encode(docs, path, ["doc_id", "key"]).collect()}
    assert got[0]["n_tokens"] == 0 and got[4]["ids"] == ref.encode(BASE, add_special_tokens=False).ids
    assert bpe.encode(none, path, ["doc_id"]).count() == 0


def plain_metrics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, none):
    texts = [t for t in TEXTS_ if t is None or len(t) < 3_000] + ["a b c d e f g h i " * 5, "x\nx\n\nx y\nx", "A***** B%%% | <c>", "p q r s t u v w p q r s t u v w p", "é b\x0bc\x1cd"]
    got = {r["doc_id"]: r for r in rules.apply_rules(frame(spark, texts), ["doc_id", "text"]).collect()}
    for i, t in enumerate(texts):
        r = got[None if i == 2 else i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_metrics(t), t
    assert got[4]["kept"] and not got[0]["kept"]
    order = rules.rule_order(frame(spark, texts), rules.rules())
    assert all(rules.rule_order(frame(spark, texts[::-1]).repartition(k), rules.rules()) == order for k in (1, 3, 7))
    assert sorted(order) == sorted(rules.rules())
    other = {r["doc_id"]: r["kept"] for r in rules.apply_rules(frame(spark, texts), ["doc_id"], order=order[::-1]).collect()}
    assert other == {k: r["kept"] for k, r in got.items()}
    assert rules.apply_rules(none, ["doc_id"]).count() == 0


def labels(spark, ys, name):
    return spark.createDataFrame([(i, y) for i, y in enumerate(ys)], f"doc_id long, {name} int")


def test_quality(spark, none):
    texts = [words(60) if i % 2 else " ".join(w + "###" for w in words(60).split()) for i in range(240)]
    docs = frame(spark, texts)
    vectors = quality.word_vectors(docs)
    net = quality.fit(docs, labels(spark, [i % 2 for i in range(240)], "quality"), vectors)
    got = [(r["doc_id"], r["score"]) for r in quality.score(docs, vectors, net, ["doc_id"], "text").collect() if r["doc_id"] is not None]
    assert np.mean([(s >= 0.3) == i % 2 for i, s in got]) > 0.97 and all(0 <= s <= 1 for _, s in got)
    ids = [r for t in texts[:3] for r in [*quality.rows_of(t), *[quality.ROWS] * quality.REACH]]
    plain = np.zeros((quality.ROWS + 1, quality.SIZE))
    places, signs = quality.index_vectors()
    for i, a in enumerate(ids):
        for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
            if i != j:
                np.add.at(plain[a], places[ids[j]], signs[ids[j]])
    plain = plain[:-1] / np.maximum(np.linalg.norm(plain[:-1], axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(frame(spark, texts[:2] + [texts[2]])), plain, atol=1e-5)
    empty = quality.fit(docs, labels(spark, [1] * 240, "quality"), vectors)
    assert set(empty.predict(quality.pooled(["", "x"], vectors))) == {1.0}
    assert quality.score(none, vectors, net, ["doc_id"], "text").count() == 0
    assert np.isfinite(net.predict(quality.pooled(["", LONG], vectors))).all()


def test_decontamination(spark, docs, none, monkeypatch):
    bench = [words(30, random.Random(9)), words(6, random.Random(8)), "", None, words(13, random.Random(7)), "ab ab ab"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    edited = bench[4].split()
    edited[6] = "edited"
    texts = [f"{words(10)} {bench[0]} {words(5)}", f"{bench[1]} {bench[1].upper()}!", " ".join(bench[0].split()[5:25]) + " tail", None, "", " ".join(bench[0].split()[:12]), bench[4], BASE]
    texts += [" ".join(edited), " ".join(["odd", *bench[4].split()[1:]]), "ab ab ab ab", f"{words(30)} {' '.join(edited[:5])} more {' '.join(edited[5:])}"] + [" ".join(random.Random(k).choices(bench[0].split(), k=200)) for k in range(20)]
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    lists = [token(t) for t in texts]
    counts = [w for ws in lists for w in ws]
    for most, shard in ((10**6, 10**6), (20, 300)):
        monkeypatch.setattr(decontaminate, "SHARD", shard)
        rows = frame(spark, texts).withColumns({"N_near": F.lit("own"), "hit": F.lit(1)})
        found = decontaminate.decontaminate(rows, items, ["doc_id", "key", "N_near", "hit"], block_words=most)
        got = {r["doc_id"]: r for r in found.withColumn("n_hit", decontaminate.n_hit()).collect()}
        for i, w in enumerate(lists):
            hit, exact, near = set(), set(), set()
            for k, b in enumerate(bench):
                b = token(b)
                for s in range(max(1, len(b) - 12) if b else 0):
                    win = b[s : s + 13]
                    for j in range(len(w) - len(win) + 1):
                        if w[j : j + len(win)] == win:
                            hit |= set(range(j, j + len(win)))
                            exact.add(str(k))
                    rare = sorted(range(len(win)), key=lambda j: counts.count(win[j]))[:5]
                    miss = int(len(rare) > 3)
                    for pivot in rare[: 1 + miss]:
                        for at in range(len(w)):
                            if w[at] == win[pivot]:
                                places = [at - pivot + j for j in rare]
                                missed = sum(win[j] not in w[max(0, p - 2) : max(0, p + 3)] for j, p in zip(rare, places) if j != pivot)
                                if missed <= miss:
                                    near.add((str(k), max(0, at - pivot), min(at - pivot + len(win), len(w))))
            r = got[None if i == 2 else i]
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(exact)), (i, most)
            assert [tuple(x) for x in r["near"]] == sorted(near) and r["n_near"] == len({x[0] for x in near}), (i, most)
        assert got[8]["n_near"] and not got[8]["items"]
    assert decontaminate.decontaminate(none, items, ["doc_id"]).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0), ["doc_id"]).where("size(items) > 0").count() == 0


def test_near_duplicates(spark, none):
    rng = random.Random(4)
    base = [words(150, rng) for _ in range(4)]
    texts = [None, "", "  "]
    for b in base:
        for _ in range(16):
            w = b.split()
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        texts += [b, b]
    texts += [words(100, rng) for _ in range(10)] + ["tiny text", "tiny  TEXT!"]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in near_dup.classes(docs).collect()}
    idf = near_dup.document_frequency(docs)
    feats = [near_dup.weighted((t or "").encode(), idf) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if feats[i][0].size and near_dup.similarity(feats[i], feats[j]) >= near_dup.SIMILAR:
                root[find(i)] = find(j)
    for i in range(len(texts)):
        if i == 2:
            continue
        mine = {k for k in range(len(texts)) if find(k) == find(i)}
        assert got[i]["class_id"] == min(mine) and got[i]["class_size"] == len(mine), i
    assert near_dup.classes(none).count() == 0
    a, b = near_dup.samples(feats[3]), near_dup.samples(feats[4])
    assert abs((a == b).mean() - near_dup.similarity(feats[3], feats[4])) < 0.25


def test_large_bands(spark, monkeypatch):
    """Letters that share a boilerplate, in pairs that are alike: every pair is found, however small the parts of a band."""
    monkeypatch.setattr(near_dup, "MOST", 5)
    rng = random.Random(8)
    boilerplate, texts = words(230, rng), []
    for _ in range(40):
        own = words(14, rng)
        texts += [f"{boilerplate} {own} {words(20, rng)}" for _ in range(2)]
    docs = frame(spark, texts).withColumn("doc_id", F.monotonically_increasing_id())
    ids = {r["text"]: r["doc_id"] for r in docs.collect()}
    idf = near_dup.document_frequency(docs)
    feats = [near_dup.weighted(t.encode(), idf) for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if near_dup.similarity(feats[i], feats[j]) >= near_dup.SIMILAR}
    assert alike == {(i + 1, i) for i in range(0, len(texts), 2)}
    sigs = np.array([near_dup.samples(f) for f in feats]).reshape(len(texts), near_dup.BANDS, near_dup.PER_BAND)
    assert max(np.unique(sigs[:, b], axis=0, return_counts=True)[1].max() for b in range(near_dup.BANDS)) > 2 * near_dup.MOST
    got = {r["doc_id"]: r for r in near_dup.classes(docs).collect()}
    for i, j in alike:
        assert got[ids[texts[i]]]["class_id"] == got[ids[texts[j]]]["class_id"] and got[ids[texts[i]]]["class_size"] == 2


def test_segments():
    rng = random.Random(6)
    for _ in range(300):
        x = np.array([rng.choice([-2.0, -1.0, -0.5, 0.7, 1.5]) for _ in range(rng.randint(1, 25))])
        got = toxicity.segments(x)
        best = max(float(x[i:j].sum()) for i in range(len(x)) for j in range(i + 1, len(x) + 1))
        if best > 0:
            assert abs(max(s for _, _, s in got) - best) < 1e-9
        else:
            assert not got

        def split(a, b):  # the definition: the best, then the same left and right of it
            spans = [(float(x[i:j].sum()), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            top = max((s for s, _, _ in spans), default=0)
            if top <= 1e-12:
                return []
            _, i, j = min(((s, i, j) for s, i, j in spans if s > top - 1e-9), key=lambda t: (t[2] - t[1], t[1]))
            return [*split(a, i), (i, j), *split(j, b)]

        assert sum(s for _, _, s in got) == pytest.approx(sum(x[i:j].sum() for i, j in split(0, len(x))))


def test_token_scores_and_calibration(spark):
    """Log-odds against counts by hand; the extreme-value law against scores drawn from one."""
    rng = random.Random(8)
    texts, ys = [], []
    for _ in range(300):
        y = int(rng.random() < 0.4)
        own = ["vileness", "grimly"] if y else ["kindness", "calm"]
        texts.append(" ".join(rng.choice(own) if rng.random() < 0.3 else words(1, rng) for _ in range(12)))
        ys.append(y)
    sample = spark.createDataFrame(list(zip(texts, ys)), "text string, y int").repartition(3)
    count = [collections.Counter(), collections.Counter()]
    for t, y in zip(texts, ys):
        w = set(t.encode().split())
        count[y].update(w | {b"^" + x[:k] for x in w for k in (5, 4) if len(x) > k})
    n_b, n_a = (sum(c.values()) for c in count)
    want = {}
    for token in set(count[0]) | set(count[1]):
        a, b = count[1][token], count[0][token]
        prior = toxicity.PRIOR * (a + b) / (n_a + n_b)
        odds = np.log((a + prior) / (n_a + toxicity.PRIOR - a - prior)) - np.log((b + prior) / (n_b + toxicity.PRIOR - b - prior))
        ratio = 2 * sum(k * np.log(k * (n_a + n_b) / ((a + b) * n)) for k, n in ((a, n_a), (b, n_b)) if k)
        if a + b >= toxicity.LEAST_COUNT and ratio >= toxicity.RATIO and abs(odds) >= toxicity.LEAST_ODDS:
            want[token] = odds
    got = toxicity.token_scores(sample)
    assert set(got) == set(want) and b"vileness" in got and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    few = sorted(toxicity.token_scores(sample, 3).values())
    assert len(few) == 3 and set(few) <= set(got.values())
    draw = np.random.default_rng(1)
    n, lam, log_k = draw.integers(20, 2_000, 20_000), 1.7, -2.0
    best = (np.log(n) + log_k + draw.gumbel(size=n.size)) / lam
    model = toxicity.Model({})
    model.calibrate(n, best, np.zeros(n.size))
    assert abs(model.lam - lam) < 0.15 and abs(model.log_k - log_k) < 0.5
    chance = np.exp([model.expected(int(k), 6.0) for k in n])  # expected number of scores of 6 or more
    assert 0.6 < (1 - np.exp(-chance)).mean() / (best >= 6.0).mean() < 1.6


def test_toxicity(spark, docs, none):
    rng = random.Random(8)
    texts = []
    for i in range(400):
        w = words(60, rng).split()
        if i % 4 == 0:
            for k in rng.sample(range(60), 5):
                w[k] = rng.choice(["vilest", "rotter", "scoundrel"])
        texts.append(" ".join(w))
    table = frame(spark, texts)
    model = toxicity.fit(table, labels(spark, [int(i % 4 == 0) for i in range(400)], "toxic"))
    got = [r for r in toxicity.score(table, model, ["doc_id", "key"]).collect() if r["doc_id"] is not None]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got]) > 0.97
    r = next(r for r in got if r["doc_id"] == 0)
    inside = {k for p in r["passages"] for k in range(p["start"], p["end"])}
    assert {k for k, w in enumerate(texts[0].split()) if w in ("vilest", "rotter", "scoundrel")} <= inside
    blank = toxicity.fit(table, labels(spark, [0] * 400, "toxic"))
    assert {r["score"] for r in toxicity.score(docs, blank, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(none, model, ["doc_id"]).count() == 0 and toxicity.score(docs, model, ["doc_id"]).count() == len(TEXTS_)


def test_pipeline(spark, tmp_path):
    """Every stage on a table with all the awkward rows."""
    import corpus_pipeline

    bench = words(30, random.Random(9))
    texts = [None, "", "12 34", BASE, BASE, NEAR, f"{bench} {words(30)}", f"{words(80)} mail me@site.example.org", words(90)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, words(70), "en", "s", 1), (8, texts[8], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert kept[0] == sorted([3, 4, 5, 6, 7, 8, 8, None], key=str)
    assert kept[1] == sorted([3, 6, 7, 8, None], key=str)
    assert kept[2] == kept[3] == kept[4] == sorted([3, 7, 8, None], key=str)
    assert "<email>" in spark.read.parquet(f"{tmp_path}/3").where("doc_id = 7").first()["text"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def repaired_plainly(rows, limit=4):
    """Cheapest (cost, audit, lines) over every sequence of edits of (role, text, fault) with at most `limit` insertions in a row."""
    legal, best = re.compile("(s?(ua)+)?"), None
    names = {"u": "user", "a": "assistant"}
    todo = [(0, "", (), 0)]
    for role, text, fault in rows:
        grown = []
        for cost, audit, lines, _ in todo:
            for ins in ("", "u", "a", "ua", "au"):
                c, a, ls = cost + 2 * len(ins), audit + "I" * len(ins), lines + tuple((names[x], "") for x in ins)
                grown.append((c + 3, a + "D", ls, 0))
                if fault < 2:
                    grown.append((c + fault, a + "K", (*ls, (role, text)), 0))
                    grown += [(c + 2 + fault, a + "R", (*ls, (names[x], text)), 0) for x in "ua"]
        # paths whose roles are no beginning of a legal sequence go
        todo = [g for g in grown if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in g[2]))]
    for cost, audit, lines, _ in todo:
        for ins in ("", "u", "a", "ua", "au"):
            ls = lines + tuple((names[x], "") for x in ins)
            found = (cost + 2 * len(ins), audit + "I" * len(ins), ls)
            if legal.fullmatch("".join(r[:1] for r, _ in ls)) and (best is None or found[:2] < best[:2]):
                best = found
    return best


def test_pipeline_batches_are_small(spark, monkeypatch):
    """Stages hand long texts to Python workers a few megabytes at a time, whatever number of rows that is."""
    import pyarrow as pa

    import corpus_pipeline
    from millrace.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(corpus_pipeline, "_left", [])
    try:
        spark.conf.unset(name)
        docs = spark.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("doc_id"), F.expr("repeat('word ', 20000)").alias("text"))
        stage = corpus_pipeline._tidy(lambda spark, docs, sf_dir: docs)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

        got = stage(spark, docs, "").mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 300
        assert max(r["bytes"] for r in got) <= common.BATCH_BYTES + 200_000
        spark.conf.set(name, "1m")
        common.small_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_conversations(spark):
    rng = random.Random(11)
    texts, roles = ["Fine.", "Well!", "cut", "", " \n", "Why?", None], ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(150) for _ in range(rng.randint(1, 4))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho.")]
    frame_ = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, gone int, audit string")
    key = lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode())
    for broken in (False, True):
        want = {}
        for c in {r[0] for r in rows}:
            own = []
            for _, turn, role, text in (r for r in rows if r[0] == c):
                role, text = " " if role is None else role, " " if text is None else text
                k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if broken else 19
                if k:
                    text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
                    own += [(c, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
            own.sort(key=key)
            seen, marked = set(), []
            for _, _, role, text in own:
                bare = text.strip(" \t\n\x0b\x0c\r")
                fault = 2 if not bare else 3 if (role, text) in seen else 1 if bare[-1] not in ".!?" else 0
                seen.add((role, text))
                marked.append((role, text, fault))
            turns = [r[1] for r in own if r[1] is not None]
            heads = [r[0][:1] for r in marked]
            cost, audit, lines = repaired_plainly(marked)
            faults = [r[2] for r in marked]
            want[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(2), faults.count(3), faults.count(1), sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(), [tuple(x) for x in lines])
        given = conversations.damaged(frame_) if broken else conversations.plain(frame_)
        for block in (1, 2, 256):
            got = {r[0]: (*r[1:-1], [tuple(x) for x in r[-1]]) for r in conversations.repair(given, with_turns=True, block=block).collect()}
            assert got == want
    assert conversations.repair(conversations.damaged(frame_.limit(0))).count() == 0


def test_long_conversation(spark):
    """Blocks give what one search gives, also where the best paths part for long."""
    rng = random.Random(4)
    for roles in ("uauauaua", "uuuuuuuu", "aaaaaa", "suas", "".join(rng.choice("suat") for _ in range(300))):
        rows = [(r, rng.choice([0, 0, 0, 1, 2, 3])) for r in roles]
        (whole,) = conversations.search(rows, {0: (0, "")}, True).values()
        c = conversations._Conversation(0, False, 7)
        for i, (r, f) in enumerate(rows):
            c.add(i, r, "t", f)
        assert c.result()[6:8] == whole[:2]


def test_filter_audit(spark, none):
    rng = random.Random(12)
    pool = [None, "", " \n", words(60, rng), words(60, rng) + " #", "Same " * 70, words(70, rng).title(), words(49, rng), "ÄÖ " * 60, LONG, "a b " * 40]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(pool), "en", rng.choice([None, "", "s", "t"]), 1, 0.5, "x", "k", 1, 2) for i in [*range(60), 3, 3]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"score": "kept", "spans": "bits", "key": "text_key", "hit": "step", "sig": "id"})
    marks = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [*range(0, 60, 2), 4, None]]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = {}
    for order in itertools.permutations("ABCDE"):
        for i, t, _, part, *_ in rows:
            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            fails = {k for k, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])) if bad}
            at = next((k for k, f in enumerate(order) if f in fails), 9)
            for k, f in enumerate(order):
                c = want.setdefault((part or "", "".join(order), k + 1), [0] * 6)
                for n, yes in enumerate((at > k, at == k, f in fails and at < k, fails == {f}, at == k and i in good, at == k and i in toxic)):
                    c[n] += yes
    total = {}
    for (part, order, step), c in want.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + c[1]
    got = {tuple(r[:3]): list(r[3:]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == {k: [*c, total[k[0], k[1][k[2] - 1]]] for k, c in want.items()}
    assert filter_audit.audit(none, labels).count() == 0 and filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def without_later_windows(rows):
    """(id, text) -> words, removed and kept, by comparison of all windows."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda d: d[:2])
    seen, out = set(), {}
    for has, i, t in docs:
        w = t.encode().split()
        gone = set()
        for a in range(len(w) - 19):
            s = tuple(w[a : a + 20])
            gone |= set(range(a, a + 20)) if s in seen else set()
            seen.add(s)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i if has else None, t] = (len(w), len(gone), b" ".join(kept).decode())
    return out


def test_word_dedup(spark, docs, none, monkeypatch):
    rng = random.Random(13)
    shared = words(45, rng)
    texts = [*TEXTS_, shared, f"{words(30, rng)} {shared}\n{words(5, rng)}", f"{shared} {shared}", "x " * 90, "x y " * 40 + shared, f"É{words(19, rng)}", " ".join(words(40, rng).split()), "x " * 19, "x " * 20]
    given = frame(spark, texts).withColumnsRenamed({"spans": "kept", "key": "__text", "hit": "high", "sig": "start"})
    again = given.where("doc_id in (4, 13)")
    want = without_later_windows([(r["doc_id"], r["text"]) for r in given.collect()])
    for block, share in ((1 << 20, 1), (200, 3), (30, 7)):
        monkeypatch.setattr(word_dedup, "BLOCK", block)
        rows = given.unionByName(again).repartition(share).withColumn("t", F.coalesce("text", F.lit("")))
        got = word_dedup.remove_repeats(rows, ["doc_id", "t", "kept", "__text", "high"])
        assert got.count() == len(texts) + 2
        assert {(r["doc_id"], r["t"]): (r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()} == want
    assert word_dedup.remove_repeats(none, ["doc_id"]).count() == 0


def test_sketch_loses_nothing(spark):
    """However few cells there are, counts are never too low."""
    rng = random.Random(3)
    shared = words(30, rng)
    given = frame(spark, [f"{words(rng.randint(0, 30), rng)} {shared} {words(rng.randint(0, 30), rng)}" for _ in range(20)])
    for bits in (6, 16):
        rows = word_dedup.sketch(given.repartition(5), bits)
        seen = []
        for _, texts, digests in word_dedup._blocks(given.select("text").toArrow().to_batches()):
            seen.append(word_dedup._Block(texts, digests, word_dedup._Hashes()).anchors())
        kinds, counts = np.unique(np.concatenate(seen), return_counts=True)
        for cells, row in zip(word_dedup._cells(kinds, bits), rows):
            assert np.unpackbits(row)[cells][counts > 1].all()
        assert (counts > 1).any() and (bits == 6 or not np.unpackbits(rows[0]).all())
