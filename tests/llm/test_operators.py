"""Each operator against SQL, or a plain version of it, and on rows that are null, empty, tied or repeated."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from timberline.llm import chat, embeddings, langid, licenses, mixing, packing, pii, quality, simhash, sketch
from timberline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, spans string, taken string"
ODD = [
    (1, None, None, None),
    (2, "", "en", None),
    (3, "  \n ", None, "a"),
    (4, "one two three four five six", "en", "a"),
    (4, "one two three four five six", "en", "a"),
    (5, "one two three four five six", "en", "b"),
    (None, "sieben acht neun zehn elf", "de", "b"),
    (7, "x" * 50_000, "en", "\x00"),
    (8, "mail me at a.b@c.example.com or +1 (212) 555-1234, card 4111 1111 1111 1111 from 10.0.0.1", "en", "c"),
    (9, "Released under the MIT License. apache license, version 2 " * 3, "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, s, 0, 1, "x", "y") for i, t, g, s in ODD], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, agrees, name):
    agrees(QUERIES[name](spark, SF), duck, SQL[name])


# mixing


def test_mix(spark, odd, none):
    got = mixing.mix(odd, bucket_rows=2).collect()
    assert len(got) == len(ODD) and sum(r["size"] for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in ODD)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(0 <= target[s] - taken[s] < 1 for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in got)) < 1e-6
    assert sorted(map(str, mixing.mix(odd, bucket_rows=2).collect())) == sorted(map(str, got))
    mixed = mixing.mixed_documents(odd, bucket_rows=2)
    assert mixed.columns == odd.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(taken.values())
    lined = spark.createDataFrame([(1, "  w1\nw2\n\nw3\n\tindented w4 ", "a"), (2, "p q", "b")], "doc_id bigint, text string, source string")
    whole = "  w1\nw2\n\nw3\n\tindented w4 "
    cuts = [r["text"] for r in mixing.mixed_documents(lined).collect() if "w1" in r["text"]]
    assert cuts and all(whole.startswith(t) for t in cuts) and any(t != whole for t in cuts)
    same = spark.createDataFrame([(None, f"t{i} " * 5, "a") for i in range(60)] + [(3, f"u{i % 30} x", "a") for i in range(60)], "doc_id bigint, text string, source string")
    first = sorted((r["start"], r["size"]) for r in mixing.mix(same, bucket_rows=4).collect())
    assert [a for a, _ in first] == [sum(n for _, n in first[:i]) for i in range(len(first))]
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_fair_shares(spark):
    rows = spark.createDataFrame([("sa", "a", 100), ("sb", "b", 1), ("sc", "c", 0), ("n", None, 10)], "sk string, source string, source_size bigint")
    t = {r["source"]: r["target"] for r in mixing.fair_shares(rows).collect()}
    assert t["b"] == 3 and t["c"] == 0 and t[None] == 30 and abs(t["a"] - 78) < 1e-9


# quality and language


def test_quality(spark, odd, none):
    got = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert area(held) > 0.95
    assert sum(p == q for _, p, q in held) / len(held) > 0.95 > np.mean([q for _, _, q in held]) + 0.05
    forest = quality.train(odd, spark.createDataFrame([(4, 1), (2, 0), (None, 1)], "doc_id bigint, quality int"), F.col("doc_id").isNotNull())
    assert all(0 <= r["score"] <= 1 for r in quality.classify(odd, forest).collect())
    assert quality.classify(none, forest).count() == 0
    blank = quality.train(none, spark.createDataFrame([], "doc_id bigint, quality int"), F.col("doc_id").isNotNull())
    assert {r["score"] for r in quality.classify(odd, blank).collect()} == {0.5}
    twice = quality.train(odd.union(odd), spark.createDataFrame([(4, 1), (4, 0), (2, 0), (2, 0), (9, 1)], "doc_id bigint, quality int"), F.col("doc_id").isNotNull())
    once = quality.train(odd, spark.createDataFrame([(4, 1), (2, 0), (9, 1)], "doc_id bigint, quality int"), F.col("doc_id").isNotNull())
    assert np.array_equal(twice.leaf, once.leaf) and twice.base == once.base


def area(held):
    """That under the ROC curve, of (score, _, truth)."""
    good, bad = ([s for s, _, q in held if q == k] for k in (1, 0))
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_by_hand(spark):
    """Scores of the query against statistics and trees taken row by row, of whole texts."""
    sf = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    taught = sorted(i for i in truth if i in text and zlib.crc32(str(i).encode()) % 5)
    forest = quality.boost(np.array([quality.statistics(text[i]) for i in taught]), np.array([float(truth[i]) for i in taught]))
    for r in QUERIES["op2_quality"](spark, sf).collect():
        want = forest.score(np.array([quality.statistics(text[r["doc_id"]])]))[0]
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (want >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_statistics():
    """A text's statistics against their meaning, one by one."""
    t = "The cat sat. The cat sat.\n\nThe cat sat. The cat sat.\nWHY 12 é!"
    got = dict(zip(quality.NAMES, quality.statistics(t)))
    words, raw = t.split(), t.encode()
    assert got["words"] == pytest.approx(np.log1p(len(words))) and got["bytes"] == pytest.approx(np.log1p(len(raw)))
    assert got["distinct"] == len(set(words)) / len(words) and got["same_lines"] == pytest.approx(1 / 3) and got["shouted"] == 1 / len(words)
    assert got["digit"] == 2 / len(raw) and got["high"] == 2 / len(raw) and got["top_word"] == 4 / len(words)
    assert got["pair_repeat"] == pytest.approx(1 - len(set(zip(words, words[1:]))) / (len(words) - 1))
    assert quality.statistics(None) == quality.statistics("")


def test_forest_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 3] > 0.2).astype(float)
    forest = quality.boost(x, y)
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.97

    def walk(row):
        total = forest.base
        for f, v, leaf in zip(forest.feature, forest.value, forest.leaf):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + (2 if row[f[at]] >= v[at] else 1)
            total += leaf[at - (2**quality.DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:40]], forest.score(x[:40]))


def test_language(spark, odd, none):
    got = QUERIES["op4_langid"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [(r["lang_pred"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    trees = langid.train(odd, F.col("doc_id").isNotNull())
    by = [(r["text"], r["lang_pred"], r["score"]) for r in langid.identify(odd, trees).collect()]
    assert all((p == "und") == (not any(map(str.isalpha, t or ""))) and 0 <= s <= 1 for t, p, s in by)
    assert langid.identify(none, trees).count() == 0 and langid.train(none, F.col("doc_id").isNotNull()) is None
    assert langid.identify(odd, None).where("lang_pred <> 'und'").count() == 0


def test_language_learns_from_whole_texts(spark):
    """What tells two languages apart may stand at the end of long texts."""
    start = "lorem ipsum dolor " * 2000
    df = spark.createDataFrame([(i, start + ("the quick brown fox " if i % 2 else "der schnelle braune fuchs ") * 300, "en" if i % 2 else "de") for i in range(8)], "doc_id bigint, text string, lang string")
    trees = langid.train(df, F.lit(True))
    asked = spark.createDataFrame([(1, "the brown fox"), (2, "der braune fuchs")], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in langid.identify(asked, trees).orderBy("doc_id").collect()] == ["en", "de"]


def test_samples_of_any_rate(spark):
    """No rate rounds to nothing: the threshold goes with it down to one key in 2**63."""
    from timberline.llm.common import sampled

    df = spark.range(200_000)
    for share in (0.25, 0.01, 0.0005):
        assert abs(df.where(sampled("id", share)).count() - share * 200_000) < 5 * (share * 200_000) ** 0.5 + 1
    assert df.where(sampled("id", 1.0)).count() == 200_000
    least = df.select(F.min(F.xxhash64("id"))).first()[0]
    assert df.where(sampled("id", (least + 2**63 + 2**20) / 2**64)).count() == 1


def test_index_of_many_grams():
    """The hash table finds each gram and no other, whatever their number of byte pairs."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**32, 60_000).astype(np.uint32))
    trees = langid.ContextTrees(["a"], [np.zeros(0, np.uint32)] * 3 + [keys], [np.zeros((len(keys), 1))] * 4, [np.zeros(0, np.uint32)] * 4, [np.zeros((0, 1))] * 4)
    trees.index()
    other = np.setdiff1d(rng.integers(0, 2**32, 60_000).astype(np.uint32), keys)
    assert np.array_equal(trees.rows_of(keys), np.arange(len(keys))) and (trees.rows_of(other) == -1).all()
    assert len(trees.row) <= 8 * len(keys)


def test_code_lengths():
    """Against the tree walked byte by byte."""
    texts = {"a": [b"the cat and the hat", b"that then"], "b": [b"der hund und die katze \xc3\xa4"]}
    counts = {}
    tree = {g: defaultdict(Counter) for g in texts}
    for g, ts in texts.items():
        parts = [np.frombuffer(langid.PAD + t, dtype=np.uint8) for t in ts]
        counts[g] = {k: tuple(x.astype(float) if i else x for i, x in enumerate(np.unique(np.concatenate([langid._grams(p, k) for p in parts]), return_counts=True))) for k in range(langid.ORDER + 1)}
        for t in ts:
            whole = langid.PAD + t
            for i in range(langid.ORDER, len(whole)):
                for k in range(langid.ORDER + 1):
                    tree[g][whole[i - k : i]][whole[i]] += 1
    model = langid.ContextTrees.grown(counts)
    model.index()

    def bits(g, text):
        whole, total = langid.PAD + text, 0.0
        for i in range(langid.ORDER, len(whole)):
            for k in range(langid.ORDER, -1, -1):
                seen = tree[g].get(whole[i - k : i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if whole[i] in seen:
                    total += np.log2((n + d) / seen[whole[i]])
                    break
                total += np.log2((n + d) / d)
            else:
                total += 8
        return total

    for text in (b"the hund", b"zzz\xff", b"", b"and then die hat" * 500):
        assert np.allclose(model.code_lengths([text])[0], [bits(g, text) for g in ("a", "b")], rtol=1e-5)
        assert np.allclose(model.code_lengths([text], part=7)[0], model.code_lengths([text])[0], rtol=1e-5)


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for i, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            ds = [int(c) for c in m.group() if c.isdigit() and c.isascii()]
            luhn = sum(d if j % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for j, d in enumerate(reversed(ds))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(ds) <= 19 and luhn, "phone": 9 <= len(ds) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end(), kind))
    return sorted(out)


TRICKY = ["a@b.c_d@e.f", "a@b.com@c.com", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "1.2.3.300", "é 4111-1111 1111-1111 ü +44 20 7946 0958.", "0001.2.3.4", "+1+12 345 678 90 1", "%x@y.z", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1", "a@b.c.@d.e", "4111111111111111 4111111111111111", "12 " * 3000, "1.2.3.4, " * 300, "a@b.cc " * 500, "9" * 30_000, "a" * 30_000, "call (212) 555-0199 now, or write joe (at) example (dot) com", "🙂 10.1.1.1"]


def test_personal_spans(spark, odd, none, docs):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(1000 + i, t) for i, t in docs.items()] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find_personal(df).collect()}
    for i, t in rows:
        want = [(s, k, e) for s, k, e, _ in plain_spans(t)]
        assert [(x["s"], x["k"], x["e"]) for x in got[i]["spans"] or [] if x["base"]] == want, t[:80]
        for x in got[i]["spans"] or []:
            assert x["base"] or not any(s < x["e"] and x["s"] < e for s, _, e in want)
    assert pii.find_personal(none).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[8] == "mail me at [email] or [phone], card [card] from [ip]" and text[1] is None and text[2] == ""
    assert pii.redact(none).count() == 0


def test_labelers_reliabilities():
    """Expectation-maximisation finds the labelers' error rates that votes were drawn with, without knowing the truth."""
    rng = np.random.default_rng(11)
    truth = rng.random(200_000) < 0.6
    right = (0.95, 0.85, 0.7, 0.9)  # of those who vote; a fifth abstain
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, 1, 2 * np.where(rng.random(len(truth)) < r, truth, ~truth)) for r in right], axis=1)
    pattern = votes @ np.array([27, 9, 3, 1])
    table, prior, post = pii.estimate(Counter(pattern.tolist()))
    assert abs(prior - 0.6) < 0.02
    for i, r in enumerate(right):
        for t in (0, 1):
            assert abs(table[i][t][2 * t] - 0.8 * r) < 0.02 and abs(table[i][t][1] - 0.2) < 0.02
    told = np.array([post[v] > 0.5 for v in pattern.tolist()])
    assert (told == truth).mean() > 0.95


def test_personal_proposals(spark):
    """Each kind's odd spellings are found where checks, lists and context speak for them, and left where they speak against."""
    good = [("email", f"please write to anna{i} (at) mail{i} (dot) com today") for i in range(40)] + [("ip", f"the server 10{i % 9}[.]20.{i}[.]7 answers") for i in range(40)] + [("card", f"paid by visa card 4111.1111.1111.1111 in {i}") for i in range(40)] + [("phone", f"call (212) 555-01{i:02} now") for i in range(40)]
    good = [(k, t.replace("[.]20.", "[.]20[.]")) for k, t in good]
    bad = [f"order 0{i % 9}12 . 999 . 400 . 3{i:02}" for i in range(40)] + [f"invoice 1234.5678.9012.{1000 + i}" for i in range(40)] + [f"Seen (at) place{i} nothing" for i in range(40)]
    sure = [f"mail x{i}@site.org, host 10.0.0.{i}, card 4111 1111 1111 1111, phone +1 212 555 01{i:02}" for i in range(40)]
    texts = [t for _, t in good] + bad + sure
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal(df).collect()}
    for i, (kind, t) in enumerate(good):
        assert [pii.KINDS[x["k"]] for x in got[i]] == [kind] and not got[i][0]["base"], (t, got[i])
    kept = sum(bool(got[len(good) + i]) for i in range(len(bad)))
    assert kept == 0
    assert all(sorted(pii.KINDS[x["k"]] for x in got[len(good) + len(bad) + i] if x["base"]) == ["card", "email", "ip", "phone"] for i in range(len(sure)))
    model = pii.fit_spans(pii.candidates(df))
    assert set(model.reliability) == {0, 1, 2, 3} and all(0 <= p <= 1 for p in model.score.values())


def test_personal_digest(spark, docs):
    for r in QUERIES["op3_pii"](spark, SF).collect():
        base = plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in base) for k in pii.KINDS]


# licenses


def plain_labels(words):
    """Every block against every template, by sets."""
    number = [(label, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for label, ts in licenses.TEMPLATES.items() for t in ts for w in [re.findall(r"[a-z0-9]+", t.lower())]]
    out, half = set(), licenses.BLOCK // 2
    for lo in range(0, max(1, len(words)), half):
        end = min(len(words), lo + licenses.BLOCK)
        block = {tuple(words[i : i + n]) for n in (3, 4, 5) for i in range(lo, end) if i + n <= len(words)}
        held = [(label, t) for label, t in number if len(t & block) >= licenses.CONTAINED * len(t)]
        for label, t in held:
            rivals = [(other, r) for other, r in number if other != label and len(t & r) >= licenses.CONTAINED * len(t)]
            if all(len((t - r) & block) >= licenses.CONTAINED * len(t - r) if t - r else (other, r) not in held for other, r in rivals):
                out.add(label)
    return out


def test_licenses(spark, odd, none, docs):
    mit, gpl, lgpl = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["gpl-3"][0], licenses.TEMPLATES["lgpl"][0]
    said = ["Under the MIT license under the mit license", "apache-license: version 2", "cc by nc", None, "", "the license under mit filler " * 400, mit, "x " * 700 + gpl + " y" * 700, lgpl, mit + lgpl, " ".join(gpl.split()[:60]), licenses.TEMPLATES["bsd-2"][0], licenses.TEMPLATES["bsd-3"][0], "é" + mit.replace("software", "work")]
    every = dict(docs) | {-1 - i: t for i, t in enumerate(said)}
    df = spark.createDataFrame(list(every.items()), "doc_id bigint, text string")
    for r in licenses.scan_licenses(df).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), every[r["doc_id"]] or ""))
        places, base = [], set()
        for label, p in licenses.PHRASES.items():
            p = p.split()
            for i in range(len(words)):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    base.add(label)
        more = plain_labels(words)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | more)), every[r["doc_id"]]
        assert (r["score"] > 0) == bool(base | more)
    assert licenses.scan_licenses(odd.union(odd)).count() == 2 * len(ODD) and licenses.scan_licenses(none).count() == 0


def test_license_verdicts(spark):
    """Each template gets its own label alone; prose and other licenses get none of it."""
    said = [(label, "Some words before. " * 90 + t + " Some words after." * 90) for label, ts in licenses.TEMPLATES.items() for t in ts]
    said += [("", t) for t in ("released under the GPL license", "The film was released in May. Under the new law every license expires", "the MIT license is not the license of this work, which is released under no license", "Permission is hereby granted to any person")]
    said += [("agpl-3,mit", licenses.TEMPLATES["mit"][0] + licenses.TEMPLATES["agpl-3"][0]), ("gpl-3", licenses.TEMPLATES["gpl-3"][0].replace("program", "library")), ("lgpl", licenses.TEMPLATES["lgpl"][0].replace("program", "library"))]
    df = spark.createDataFrame(list(enumerate(t for _, t in said)), "doc_id bigint, text string")
    for r in licenses.scan_licenses(df).collect():
        want, text = said[r["doc_id"]]
        assert set(r["labels"].split(",")) - set(r["base_labels"].split(",")) | {want} >= set(want.split(",")) and set(r["labels"].split(",")) <= set(want.split(",")) | set(r["base_labels"].split(",")), (text, r)
        assert set(want.split(",")) <= set(r["labels"].split(",")), (text, r)


# chat


def test_chat_round_trip(spark):
    said = ["", None, "\\", "\\\\", "</turn>", "<\\/turn>", "### user: hi</turn>\n### x: ", "#\\## ", "a\\b", "</turn", "\\:\n", "x" * 20_000, "é🙂</turn>é"]
    rows = [(i, j, role, t) for i, role in enumerate(["user", "assistant", None, "a:b", "### ", "\\", "</turn>"]) for j, t in enumerate(said)] + [(None, None, "user", "hi"), (None, None, "user", "hi")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = chat.format_conversations(df).collect()
    assert len(got) == 8 and all(r["roundtrip_ok"] for r in got)
    for r in got:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a or "", b or "") for c, _, a, b in rows if c == r["conv_id"]]
        spoken = [b or "" for c, _, a, b in rows if c == r["conv_id"] and a == "assistant"]
        undo = lambda x: re.sub(r"\\([\\/#:])", r"\1", x)
        assert [undo(r["formatted"][m["start"] : m["end"]]) for m in r["mask"]] == spoken
        assert r["formatted"].count("</turn>") == len(r["turns"]) and r["formatted"].count("### ") == len(r["turns"])
    assert chat.format_conversations(df.limit(0)).count() == 0


# near-duplicates


def test_fingerprint_bits(docs):
    for t in [None, "", "One two", "one two three", "a b c d", *list(docs.values())[:30]]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
        assert simhash.fingerprint(t) == want


def test_components(spark, odd, none):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    fps = {i: r["fp"] & (2**64 - 1) for i, r in got.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], dtype=np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= simhash.RADIUS):
            x, y = find(i), find(ids[k + 1 + j])
            root[max(x, y)] = min(x, y)
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in ids}
    assert len(set(map(find, ids))) < len(ids)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["fp"] == 0} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "7", "8", "9", "None"])
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one_by_component(spark, docs):
    """Rows that share a null or repeated doc_id stay where their components differ; which row stays does not hang on order."""
    a, b, c, d, e = [t for t in docs.values() if len(t) > 500][:5]
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "w"), (2, c, "x"), (4, d, "x"), (4, c, "x"), (4, e, "z"), (4, e, "y"), (9, a, "x"), (None, None, "x"), (None, "", "x")]
    apart = [simhash.fingerprint(t) for t in (a, b, c, d, e)]
    assert min((x ^ y).bit_count() for i, x in enumerate(apart) for y in apart[:i]) > simhash.RADIUS
    for order in (rows, rows[::-1]):
        kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(order, "doc_id bigint, text string, source string").repartition(3)).collect()]
        assert Counter(kept) - Counter([(None, None, "x"), (None, "", "x")]) == Counter([(None, a, "x"), (None, b, "w"), (2, c, "x"), (4, d, "x"), (4, e, "y")])
        assert len(kept) == 6


def test_links_at_each_distance(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    pairs = []
    for x in base:
        for d in range(1, 8):
            y = x
            for b in rng.permutation(64)[:d]:
                y ^= 1 << int(b)
            pairs.append((x, y, d))
    sign = lambda x: x - 2**64 if x >> 63 else x
    fps = sorted({v for x, y, _ in pairs for v in (sign(x), sign(y))})
    from timberline.llm.common import connected_components

    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))).collect()}
    for x, y, d in pairs:
        if d <= simhash.RADIUS:
            assert roots[sign(x)] == roots[sign(y)]
    a = np.array(fps, dtype=np.int64).view(np.uint64)
    lonely = [f for f, v in zip(fps, a) if (np.bitwise_count(a ^ v) <= simhash.RADIUS).sum() == 1]
    assert lonely and not any(f in roots for f in lonely)


def test_links_in_crowded_keys(spark, monkeypatch):
    """Links are found where a key holds many fingerprints too far apart, more of them than are compared."""
    rng = np.random.default_rng(9)
    found = set()
    for _ in range(12):
        two = int(rng.integers(0, 2**42))
        found |= {two | int(x) << 42 for x in rng.integers(0, 2**22, 60)}
    for x in list(found)[::5]:
        found.add(x ^ sum(1 << int(b) for b in rng.permutation(64)[:4]))
    sign = lambda x: x - 2**64 if x >> 63 else x
    from timberline.llm.common import connected_components

    df = spark.createDataFrame([(sign(f),) for f in found], "fp bigint")
    a = np.array(sorted(found), dtype=np.uint64)
    root = {int(x): int(x) for x in a}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, x in enumerate(a):
        for y in a[k + 1 :][np.bitwise_count(a[k + 1 :] ^ x) <= simhash.RADIUS]:
            root[find(int(x))] = find(int(y))
    want = Counter(frozenset(g) for g in grouped({sign(i): sign(find(i)) for i in root}) if len(g) > 1)
    for near in (1, 7, 100):
        monkeypatch.setattr(simhash, "NEAR", near)
        got = {r["node"]: r["root"] for r in connected_components(simhash.links(df)).collect()}
        assert Counter(frozenset(g) for g in grouped(got)) == want


def grouped(root):
    out = defaultdict(set)
    for k, v in root.items():
        out[v].add(k)
    return out.values()


# sketches


def test_fingerprints(spark, odd, none, docs):
    df = spark.createDataFrame([(i, t) for i, t in docs.items()] + [(10_001, None), (10_002, ""), (10_003, "a b")], "doc_id bigint, text string").repartition(3)
    df.write.mode("overwrite").parquet("/tmp/timberline-op8/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprint"](spark, "/tmp/timberline-op8").collect()}
    texts = dict(sorted({**docs, 10_001: "", 10_002: "", 10_003: "a b"}.items()))
    ids = list(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[j][:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[10_001]["near_next"] == 1 and got[10_001]["fingerprint"] == got[10_002]["fingerprint"]
    long = [got[i] for i in ids if len(texts[i]) > 3000]
    assert np.mean([r["near_edited"] for r in long]) > 0.4 > 0.2 > np.mean([r["near_next"] for r in long])
    chained = sketch.with_next(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], rows_a_bucket=7)
    assert {r["doc_id"]: r["next_text"] for r in chained.collect()} == {i: texts[j] for i, j in zip(ids, ids[1:] + ids[:1])}
    odder = sketch.with_next(sketch.fingerprints(odd), ["text", "sketch"], rows_a_bucket=2)
    order = sorted([(i is not None, i or 0, t or "") for i, t, _, _ in ODD])
    assert Counter((r["text"], r["next_text"]) for r in odder.collect()) == Counter(zip([o[2] for o in order], [o[2] for o in order[1:] + order[:1]]))
    assert sketch.with_next(sketch.fingerprints(none), ["text"]).count() == 0


def test_likeness_of_short_texts(spark, tmp_path):
    """Against exact containment of shingle sets: texts of 1 to 100 words, copies with another last word among them."""
    rng = np.random.default_rng(8)
    texts = []
    for n in range(1, 101):
        words = [f"w{x}" for x in rng.integers(0, 5000, n)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[n // 3 :] + [f"v{x}" for x in rng.integers(0, 5000, n // 2)])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprint"](spark, str(tmp_path)).collect()}

    def exact(a, b):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
        return 1.0 if a == b else len(x & y) / min(len(x), len(y))

    between = 0
    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        near = [exact(t, t[: len(t) - half] + after[:half]), exact(t, after)]
        assert [got[i]["near_edited"], got[i]["near_next"]] == pytest.approx(near), t
        between += sum(0 < v < 1 for v in near)
    assert between > 200


# packing


def test_pack_unit():
    for lengths in ([1], [2048], [5000, 3, 3], [1, 2, 3, 4, 5] * 500, [2049] * 9):
        pieces = packing.pack_unit(lengths)
        spans, fill = defaultdict(list), defaultdict(list)
        for d, a, n, s, o in pieces:
            spans[d].append((a, n))
            fill[s].append((o, n))
        for d, n in enumerate(lengths):
            at = 0
            for a, k in sorted(spans[d]):
                assert a == at
                at += k
            assert at == n
        for s, parts in fill.items():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 2048
        padded = sum(n if n & (n - 1) == 0 else 2048 for n in (sum(k for _, k in parts) for parts in fill.values()))
        assert padded - sum(lengths) <= 2 * packing.SLACK * padded


def test_few_documents_are_cut():
    """Documents that fit a sequence stay whole, but for a few; each goes to the least cost among sequences with room."""
    rng = np.random.default_rng(1)
    lengths = np.maximum(1, np.exp(rng.normal(6.3, 1.0, 4000))).astype(int).tolist()
    pieces = packing.pack_unit(lengths)
    n = Counter(p[0] for p in pieces)
    fits = [i for i, x in enumerate(lengths) if x <= 2048]
    assert sum(n[i] > 1 for i in fits) < 0.08 * len(fits)
    used, cost = Counter(), Counter()
    last = 2049
    for d, a, k, s, o in [p for p in pieces if p[2] < 2048]:
        if k == lengths[d] % 2048 and k <= last:  # not cut: none of less cost has room
            assert all(cost[t] >= cost[s] or 2048 - used[t] < k for t in {p[3] for p in pieces if p[2] < 2048})
        used[s] += k
        cost[s] += packing.piece_cost(k)


def test_packing(spark, odd, none, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    some = dict(list(docs.items())[:60]) | {-1: "İstanbul don't ΣΑΣ we'll <|endoftext|> word### é e\u0301 \x85\xa0x\t12a", -2: None, -3: "ª º µ ß\u2028x"}
    df = spark.createDataFrame([(i, x) for i, x in some.items()], "doc_id bigint, text string")
    pieces = packing.pack_documents(df, packing.default_tokenizer()).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
    for i, x in some.items():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    fill = defaultdict(int)
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values()) <= 2048 and sum(n if n & (n - 1) == 0 else 2048 for n in fill.values()) <= 1.05 * sum(fill.values())
    assert packing.pack_documents(odd, packing.default_tokenizer()).agg({"length": "sum"}).first()[0] > len(ODD)
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0


# embeddings


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, None):
        centre = rng.normal(size=16)
        for group in range(40):
            c = rng.normal(size=16) if group else centre
            for _ in range(1 + group % 5 if group else 60):
                rows.append((k, [float(v) for v in c + rng.normal(size=16) * 0.06], label))
                k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [float("nan")] + [1.0] * 15, 0), (k + 3, [float("inf")] + [1.0] * 15, 0), (k + 4, [1.0] * 3, 0), (k + 5, [], 1), (k + 6, [None] * 16, 1), (k + 7, [2 * v for v in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, root string")
    monkeypatch.setattr(embeddings, "LIST", 16)
    monkeypatch.setattr(embeddings, "SIDE", 32)
    got = {r["vec_id"]: r for r in embeddings.embedding_components(df).collect()}
    good = [(i, np.array(e, dtype=np.float32).astype(float), g) for i, e, g in rows if g is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    n, root = Counter(), {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(good)):
        for y in range(x):
            (i, a, g), (j, b, h) = good[x], good[y]
            if g == h and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= embeddings.COSINE:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert sum(n.values()) > 1000
    for i in root:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], find(i), find(i) == i), i
    assert embeddings.embedding_components(df.limit(0)).count() == 0


def test_embeddings_of_low_rank(spark, monkeypatch):
    """In many dimensions neighbours may differ in a few directions only; all their links across lists are found."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(1500, 4)) @ np.linalg.qr(rng.normal(size=(256, 4)))[0].T).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in e], 0) for i, e in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "LIST", 32)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_components(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= embeddings.COSINE).sum(axis=1) - 1
    assert want.sum() > 1000 and got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize(("dim", "lists", "side"), [(64, 8, 50), (96, 40, 4096), (1, 100, 4096), (3, 10, 20)])
def test_planted_embeddings(spark, agrees, monkeypatch, tmp_path, dim, lists, side):
    """The query against its SQL on a table with links: across lists, in hot groups of copies, at the threshold's edge."""
    import duckdb

    rng = np.random.default_rng(dim)
    rows = []
    for g in range(120):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(1 + g % 4):
            d = rng.normal(size=dim)
            d -= (d @ c) * c
            d /= max(np.linalg.norm(d), 1e-9)
            t = rng.uniform(0, 0.25)
            rows.append((np.cos(t) * c + np.sin(t) * d) * rng.uniform(0.5, 2))
    rows += [rows[0]] * 150 + [-rows[0]] * 3 + [np.zeros(dim)]
    df = spark.createDataFrame([(i, [float(v) for v in e], i % 2 if i % 50 else None) for i, e in enumerate(rows)], "vec_id bigint, embedding array<float>, label int")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(embeddings, "LIST", max(1, len(rows) // 2 // lists))
    monkeypatch.setattr(embeddings, "LISTS", 7)
    monkeypatch.setattr(embeddings, "SIDE", side)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["op10_embeddings"](spark, str(tmp_path))
    agrees(got, con, SQL["op10_embeddings"])
    assert got.agg({"n_links": "sum"}).first()[0] > 5000


def test_lists_grow(monkeypatch):
    """Many cells from few centres; of a near pair, one visits the other's list and there one probes the other's cell."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(embeddings, "LISTS", 50)
    x = embeddings._unit(rng.normal(size=(3000, 48)))
    index = embeddings.Index.fit(x, 2500)
    assert len(index.centres) == len(index.cells) == 50
    y = embeddings._unit(x + rng.normal(size=x.shape) * 0.02)
    (hx, lx, ox, cx), (hy, ly, oy, cy) = index.places(x, 0.2), index.places(y, 0.2)
    assert len({(h, o[list(v).index(h)]) for h, v, o in zip(hx, lx, ox)}) > 500
    close = np.flatnonzero(np.linalg.norm(x - y, axis=1) <= 0.2)
    assert len(close) > 1000 and (hx != hy).sum() > 100
    for i in close:
        shared = [h for h in {hx[i], hy[i]} if h in lx[i] and h in ly[i]]
        assert shared
        for h in shared:
            a, b = list(lx[i]).index(h), list(ly[i]).index(h)
            assert oy[i][b] in cx[i][a] or ox[i][a] in cy[i][b]
