"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, and a span classifier
learnt from that decides. DataFrame functions only on the rows; the driver sees a table of vote patterns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import materialize, read_table, spread, whole_row

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CONTEXT = 32
#: The base patterns, written so that no start in a run is tried twice and nothing recurses: a match can only begin where
#: its run of characters begins, or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, which only propose: addresses and numbers written so that a plain pattern misses them.
DOT = r"(?: ?[\[(]\.[\])] ?| ?[\[(] ?dot ?[\])] ?| \. )"
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,64}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,64}+)++",
    "ip": rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:{DOT}[0-9]{{1,3}}+){{3}}(?![0-9.])",
    "card": r"(?<![0-9][ .,/_-])(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}|[ -]{2}[0-9]{4}){3}(?![ .,/_-]?[0-9])",
    "phone": r"(?<![0-9+.-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[ .-][0-9])",
}
MAYBE = {
    ("email", True): lambda t: F.contains(t, F.lit("@")),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    ("phone", True): lambda t: F.contains(t, F.lit("+")),
    ("email", False): lambda t: (F.contains(t, F.lit("(")) | F.contains(t, F.lit("["))) & t.rlike(r"[\[(] ?[aA][tT] ?[\])]"),
    ("ip", False): lambda t: (F.contains(t, F.lit("(")) | F.contains(t, F.lit("[")) | F.contains(t, F.lit(" . "))) & t.rlike(r"[0-9] ?(?:[\[(] ?(?:\.|[dD][oO][tT]) ?[\])]|\.) ?[0-9]"),
    ("card", False): lambda t: t.rlike(r"[0-9]{4}(?:[._/]|[ -]{2})[0-9]{4}"),
    ("phone", False): lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
}
#: Gazetteers and context words.
TLDS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be se no dk pl ru cn jp in br au ca mx".split()
NEAR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|reach)\W",
    "ip": r"(?i)(?:\bip|host|server|address|login|from|client)\W",
    "card": r"(?i)(?:card|visa|credit|pay|debit|account)\W",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|dial|contact)\W",
}
AGAINST = r"(?i)(?:version|\bv|isbn|order|invoice|section|figure|part no|id)\W{0,3}$"
#: Labelers, feature patterns of a kind, and matches whose places are added up in one go.
LABELERS, FEATURES, PARTS = 4, 24, 64


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _found(df: DataFrame, kind: str, base: bool, out: str) -> DataFrame:
    """Adds out: an array of (s, e, m) of a pattern's matches in column text, in code points.

    The pattern cuts the text; lengths of pieces and matches add up to places, in blocks so that a text
    with many matches costs no square of their number.
    """
    pattern = BASE[kind] if base else LOOSE[kind]
    text = F.col("text")
    has = MAYBE[kind, base](text)
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.transform(F.split(text, pattern, -1), lambda g: F.length(g))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_s", F.zip_with(F.slice("_g", 1, F.size("_m")), "_m", lambda g, m: g + F.length(m)))
    n = F.size("_s")
    df = df.withColumn("_k", F.when(n > PARTS, F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / PARTS).cast("int")), lambda b: _sum(F.slice("_s", b * PARTS + 1, PARTS)))).otherwise(F.array().cast("array<int>")))

    def place(m: Column, i: Column) -> Column:
        b = F.floor(i / PARTS).cast("int")
        s = _sum(F.slice("_k", 1, b)) + _sum(F.slice("_s", b * PARTS + 1, i % PARTS)) + F.get("_g", i)
        return F.struct(s.cast("long").alias("s"), (s + F.length(m)).cast("long").alias("e"), m.alias("m"))

    return df.withColumn(out, F.transform("_m", place)).drop("_m", "_g", "_s", "_k")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    ds = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), c.cast("int"))))
    return _sum(ds) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    """2 for, 0 against, 1 abstains."""
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _described(kind: str, base: bool, x: Column, text: Column) -> Column:
    """A candidate with its labelers' votes (in base 3) and the classifier's features (a small number)."""
    m, before = x["m"], F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(x["s"], F.lit(CONTEXT)).cast("int"))
    n = F.length(_digits(m))
    tail = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)[^A-Za-z0-9-]*$", 1))
    if kind == "ip":
        checks = m.rlike(rf"^{OCTET}(?:[^0-9]+{OCTET}){{3}}$")
    else:
        checks = {"email": tail.rlike("^[a-z]{2,18}$"), "card": _luhn(_digits(m)), "phone": n.between(9, 15)}[kind]
    checks = _vote(checks, ~checks)
    gazetteer = {
        "email": _vote(tail.isin(TLDS), F.length(tail) > 6),
        "ip": _vote(m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])[^0-9]"), m.rlike(r"^0")),
        "card": _vote(m.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), m.rlike("^[01789]")),
        "phone": _vote(m.rlike(r"^(?:\+[1-9]|\(?[2-9][0-9]{2})"), m.rlike(r"^\(?[01]")),
    }[kind]
    context = _vote(before.rlike(NEAR[kind]), before.rlike(AGAINST))
    shape = {
        "email": _vote(F.length(m).between(6, 64), F.length(m) > 120),
        "ip": _vote(F.length(m).between(7, 15), m.rlike("[0-9]{4}") | m.rlike(r"(?:^|[^0-9])0[0-9]")),
        "card": _vote(n.isin(13, 14, 15, 16, 19), m.rlike(r"(?:[0-9] ){6}") | m.rlike(r"^([0-9])\1{7}")),
        "phone": _vote(n.between(10, 13), n < 9),
    }[kind]
    votes = ((checks * 3 + gazetteer) * 3 + context) * 3 + shape
    k = KINDS.index(kind)
    length = F.least(F.floor(F.length(m) / 8), F.lit(3)).cast("int")
    feats = ((F.lit(k) * 4 + length) * 2 + F.when(checks == 2, 1).otherwise(0)) * 3 + context
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"), F.lit(base).alias("base"), votes.cast("int").alias("v"), feats.cast("int").alias("f"))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds spans: base spans of docs.text (which fail no check), and proposals that overlap none, each with votes and features."""
    text = F.col("text")
    for kind in KINDS:
        docs = _found(docs, kind, True, f"_b_{kind}")
    for kind in LOOSE:
        docs = _found(docs, kind, False, f"_l_{kind}")
    valid = lambda k: lambda x: _valid(k, x["m"])
    described = lambda k, is_base: lambda x: _described(k, is_base, x, text)
    base = F.concat(*[F.transform(F.filter(f"_b_{k}", valid(k)), described(k, True)) for k in KINDS])
    loose = F.concat(*[F.transform(f"_l_{k}", described(k, False)) for k in LOOSE])
    docs = docs.withColumn("_base", base).withColumn("_loose", loose)
    free = F.when(F.size("_loose") > 0, F.filter("_loose", lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))).otherwise(F.col("_loose"))
    drop = [f"_b_{k}" for k in KINDS] + [f"_l_{k}" for k in LOOSE] + ["_base", "_loose"]
    return docs.withColumn("spans", F.array_sort(F.concat("_base", free), lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).otherwise(F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise((a["e"] - b["e"]).cast("int"))))).drop(*drop)


@dataclass(frozen=True)
class SpanModel:
    """For each kind seen: reliability, for each labeler P(vote | truth) as [truth][vote]; prior; posterior by vote pattern.
    score: P(personal) of each feature pattern seen."""

    reliability: dict[int, list]
    prior: dict[int, float]
    posterior: dict[tuple[int, int], float]
    score: dict[int, float]


def estimate(counts: dict[int, int], rounds: int = 60) -> tuple[list, float, dict[int, float]]:
    """Two-class expectation-maximisation (Dawid and Skene) over the vote patterns of one kind: each labeler's reliability, the
    share of true candidates, and each pattern's posterior. It begins at the votes' balance."""
    split = {v: [v // 3**i % 3 for i in reversed(range(LABELERS))] for v in counts}
    post = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(x - 1 for x in votes))) for v, votes in split.items()}
    table, prior = [], 0.5
    for _ in range(rounds):
        table = [[[1.0, 2.0, 1.0] for _ in range(2)] for _ in range(LABELERS)]
        mass = [1.0, 1.0]
        for v, n in counts.items():
            for truth in (0, 1):
                w = n * (post[v] if truth else 1 - post[v])
                mass[truth] += w
                for i, x in enumerate(split[v]):
                    table[i][truth][x] += w
        table = [[[c / sum(side) for c in side] for side in one] for one in table]
        prior = mass[1] / sum(mass)
        for v, votes in split.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[i][1][x] / table[i][0][x]) for i, x in enumerate(votes))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return table, prior, post


def fit_spans(spans: DataFrame) -> SpanModel:
    """Reliabilities of the labelers, each kind's own, then a logistic classifier on the features, taught their posteriors.

    The rows are counted by pattern in Spark, with partial sums before the shuffle; 81 vote patterns times 96
    feature patterns bound what the driver reads. Without candidates the model is empty.
    """
    rows = [(r["v"], r["f"], r["n"]) for r in spans.select(F.explode("spans").alias("c")).groupBy(F.col("c.v").alias("v"), F.col("c.f").alias("f")).agg(F.count("*").alias("n")).collect()]
    by_kind: dict[int, dict[int, int]] = {}
    for v, f, n in rows:
        own = by_kind.setdefault(f // FEATURES, {})
        own[v] = own.get(v, 0) + n
    reliability, priors, post = {}, {}, {}
    for k, counts in sorted(by_kind.items()):
        reliability[k], priors[k], of = estimate(counts)
        post |= {(k, v): p for v, p in of.items()}
    n_of, y_of = {}, {}
    for v, f, n in rows:
        n_of[f], y_of[f] = n_of.get(f, 0) + n, y_of.get(f, 0.0) + n * post[f // FEATURES, v]
    on = lambda f: ("b", ("k", f // FEATURES), ("l", f // 6 % 4), ("o", f // 3 % 2), ("c", f % 3), ("kl", f // 6))
    weight: dict = {}
    total = sum(n_of.values()) or 1
    for _ in range(300):
        step: dict = {}
        for f, n in n_of.items():
            p = 1 / (1 + math.exp(-sum(weight.get(x, 0.0) for x in on(f))))
            for x in on(f):
                step[x] = step.get(x, 0.0) + (y_of[f] - n * p) / total
        for x, g in step.items():
            weight[x] = weight.get(x, 0.0) * (1 - 1e-4) + 2.0 * g
    return SpanModel(reliability, priors, post, {f: 1 / (1 + math.exp(-sum(weight.get(x, 0.0) for x in on(f)))) for f in n_of})


def decided(spans: DataFrame, model: SpanModel, least: float = 0.5) -> DataFrame:
    """Keeps, in spans, the base ones and the proposals that the classifier scores at least ``least``."""
    good = [f for f, p in model.score.items() if p >= least] or [-1]
    return spans.withColumn("spans", F.filter("spans", lambda c: c["base"] | c["f"].isin(good)))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each personal span of its text replaced by its kind in brackets; overlapping spans become one,
    named after the first. Columns stay; n_chars follows the text. Null and empty texts, and rows without spans, stay as they are;
    repeated rows are redacted alike; an empty table gives none. Candidates are found once: rows with theirs go to the
    shared folder, from which the model is fitted and the texts are redacted."""
    found = materialize(candidates(docs.select(whole_row(docs), F.col("text").cast("string").alias("text"))).select("_doc", "spans"), "pii-rows")
    found = decided(found, fit_spans(found.select("spans"))).withColumn("text", F.col("_doc.text").cast("string"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def join(acc: Column, c: Column) -> Column:
        begin = acc["at"]
        piece = F.substring(F.col("text"), (begin + 1).cast("int"), F.greatest(c["s"] - begin, F.lit(0)).cast("int"))
        tag = F.get(F.lit([f"[{k}]" for k in KINDS]), c["k"])
        fresh = F.struct(c["e"].alias("at"), F.concat(acc["out"], F.array(piece, tag)).alias("out"))
        return F.when(c["s"] >= begin, fresh).otherwise(F.struct(F.greatest(begin, c["e"]).alias("at"), acc["out"].alias("out")))

    found = found.withColumn("_r", F.when(F.size("spans") > 0, F.aggregate("spans", first, join)))
    text = F.when(F.col("_r").isNotNull(), F.concat(F.array_join("_r.out", ""), F.substring(F.col("text"), (F.col("_r.at") + 1).cast("int"), F.length("text")))).otherwise(F.col("text"))
    doc = F.col("_doc").withField("text", text)
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(F.col("_r").isNotNull(), F.length(text).cast("long")).otherwise(F.col("_doc.n_chars")))
    return found.select(doc.alias("_doc")).select("_doc.*")


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (s, e, k, base, ...) in order of start, then kind, for each document.

    A null text has none; a very long one is searched whole, with work in its length; rows with one doc_id, and equal rows,
    are documents of their own; of proposals that overlap a base span none counts; extra columns are ignored; an
    empty table gives an empty result. The text is read once: candidates, without it, go to the shared folder.
    """
    spans = materialize(candidates(spread(docs, ["doc_id", "text"])).select("doc_id", "spans"), "pii-spans")
    return decided(spans, fit_spans(spans))


def op3_pii(spark, sf_dir):
    """Counts and digest of base spans, and all spans, of every document."""
    got = find_personal(read_table(spark, sf_dir, "documents"))
    got = got.withColumn("spans", F.coalesce("spans", F.array().cast(got.schema["spans"].dataType)))
    named = lambda x: F.concat_ws(":", F.get(F.lit(list(KINDS)), x["k"]), x["s"], x["e"])
    base = F.filter("spans", lambda x: x["base"])
    of = lambda i: lambda x: x["base"] & (x["k"] == i)
    counts = [F.size(F.filter("spans", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", named), ",").alias("spans"))
