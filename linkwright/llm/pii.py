"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans, which always stay.  Looser patterns give
more candidates: what a strict match swallowed or what its checks dropped (two
card numbers in a row, a phone number with an address behind it), national,
spelt-out and bracketed forms, and secrets.  Labelers vote on every candidate:
the strict pattern, a checksum or range, a gazetteer of issuers, domains and
prefixes, cue words in the context before it, its length, and clean edges.
Expectation-maximisation over the counts of the vote patterns (at most 64 a kind)
estimates each labeler's hit and false-alarm rate; the posteriors are soft labels
from which a naive-Bayes span classifier over shape, preceding word, following
sign, length, checksum and gazetteer is trained.  It decides on the candidates
beyond the base.  Secrets have no strict pattern and a column of their own.

Texts stay in their rows throughout: only votes and hashed features are
aggregated, and the trained tables are bounded by KINDS and FEATURE_BUCKETS.

Patterns use possessive groups and a look-behind, so they take linear time and
no recursion on long runs and match exactly what the plain ones do; places of
matches are summed in blocks, so a text with n of them takes about n * BLOCK steps.

Defined results: a null text is empty; a null doc_id is kept; every row is judged
alone, repeated or not; candidates that overlap a base span, or an earlier
accepted one, are left out, of those that begin together the longest stays; a
secret may overlap other spans; very long texts are read whole; extra columns,
also such as are named like a result, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.runtime import rest_of, saved

# The kinds in their order and their strict patterns.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Found beside the listed kinds, by looser patterns alone.
SECRET = "secret"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{7}}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])|(?<![0-9.])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?:\([0-9]{2,4}\)\x20?|0[0-9]{1,3}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-]))",
    SECRET: r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+(?![A-Za-z0-9_+/-])",
}
CUES = {
    "email": "mail|contact|kontakt|correo|write|reach|address",
    "ip": r"\bip\b|host|server|address|adresse|login|from",
    "card": "card|visa|master|amex|karte|carte|tarjeta|credit|pay|account",
    "phone": r"tel|phone|call|fax|mobil|number|nummer|ruf|contact|appel",
    SECRET: "token|secret|key|passw|pwd|credential|bearer|auth",
}
GAZETTEER = {
    "email": r"(?i)(?:gmail|yahoo|hotmail|outlook|example|mail)\.|\.(?:com|org|net|de|fr|es|edu|gov|io)$",
    "ip": r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|127\.|8\.8\.|1\.1\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\(?\+?(?:1|33|34|49|44|91|0[1-9]|[2-9][0-9]{2})",
    SECRET: r"^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|AIza|eyJ)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
}
CONTEXT = 32
FEATURE_BUCKETS = 256
ROUNDS = 30
ACCEPT = 0.9
SHRINKAGE = 4.0
LABELERS = 6
#: Items whose running values are summed at once.
BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# From here to `candidates` expressions are SQL text: they are long, and text is parsed at once.


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, name: str, body: str) -> str:
    """`let` in SQL."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def before_each(items: str, value: str, joined: str) -> str:
    """For each of items (a name): the values of all before it, joined, from 0 on; by blocks, and over blocks.

    value is SQL over an item x, joined is SQL over two values l and r.
    """
    start = "named_struct('at', 0, 'out', cast(array() as array<int>))"
    step = "named_struct('at', {join}, 'out', concat(a.out, array(a.at)))"
    over = lambda of: step.format(join=re.sub(r"\bl\b", "a.at", re.sub(r"\br\b", f"({of})", joined)))
    blocks = f"transform(sequence(0, cast(ceil(size({items}) / {BLOCK}) as int) - 1), i -> slice({items}, i * {BLOCK} + 1, {BLOCK}))"
    inner = f"transform({blocks}, b -> aggregate(b, {start}, (a, x) -> {over(value)}))"
    begins = f"aggregate(parts, {start}, (a, x) -> {over('x.at')}, a -> a.out)"
    moved = re.sub(r"\bl\b", "o", re.sub(r"\br\b", "v", joined))
    return f"CASE WHEN size({items}) > 0 THEN {bound(inner, 'parts', f'flatten(zip_with(parts, {begins}, (x, o) -> transform(x.out, v -> {moved})))')} ELSE cast(array() as array<int>) END"


def matches(text: str, pattern: str) -> str:
    """start, end and match of each match from left to right, in code points, and what stands before (since the last match) and after it.

    The text split at the matches gives what lies between them.
    """
    p = literal(pattern)
    first = f"zip_with(slice(gaps, 1, size(found)), found, (g, m) -> named_struct('gap', length(g), 'size', length(m), 'match', m, 'before', lower(right(g, {CONTEXT}))))"
    units = f"zip_with({first}, slice(gaps, 2, size(found)), (u, g) -> named_struct('gap', u.gap, 'size', u.size, 'match', u.match, 'before', u.before, 'after', left(g, 1)))"
    placed = "named_struct('start', at + x.gap, 'end', at + x.gap + x.size, 'match', x.match, 'before', x.before, 'after', x.after)"
    whole = f"zip_with(units, {before_each('units', 'x.gap + x.size', 'l + r')}, (x, at) -> {placed})"
    some = bound(bound(f"split({text}, {p}, -1)", "gaps", units), "units", whole)
    return bound(f"regexp_extract_all({text}, {p}, 0)", "found", f"CASE WHEN size(found) > 0 THEN {some} ELSE cast(array() as {FOUND}) END")


FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
DIGITS = "length(regexp_replace(m.match, '[^0-9]', ''))"
LUHN = "luhn_check(regexp_replace(m.match, '[^0-9]', ''))"
# What a strict match must also satisfy.
SOUND = {
    "email": "true",
    "ip": "m.match RLIKE " + literal(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"),
    "card": f"{DIGITS} BETWEEN 16 AND 19 AND {LUHN}",
    "phone": f"{DIGITS} BETWEEN 8 AND 15",
}
#: Whether a match's own digits or letters are plausible.
CHECKED = {
    "email": "m.match RLIKE " + literal(r"\.[A-Za-z]{2,}$"),
    "ip": "m.match RLIKE " + literal(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$|:"),
    "card": f"{DIGITS} BETWEEN 15 AND 19 AND {LUHN}",
    "phone": f"{DIGITS} BETWEEN 8 AND 15",
    SECRET: "m.match RLIKE '[0-9]' AND m.match RLIKE '[A-Za-z]' AND NOT m.match RLIKE '[A-Za-z]{16}'",
}
LONG_ENOUGH = {
    "email": "length(m.match) BETWEEN 6 AND 64", "ip": f"{DIGITS} BETWEEN 4 AND 12", "card": f"{DIGITS} IN (15, 16)", "phone": f"{DIGITS} BETWEEN 9 AND 13",
    SECRET: "length(m.match) BETWEEN 20 AND 128",
}


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def known(kind: str) -> str:
    return f"m.match RLIKE {literal(GAZETTEER[kind])}"


def votes(kind: str, strict: bool) -> str:
    """0 or 1 of each labeler, for a match m."""
    edges = "NOT m.after RLIKE '[A-Za-z0-9]' AND NOT m.before RLIKE '[a-z0-9]$'"
    assigned = literal(r"""(?:token|secret|key|password|passwd|pwd|bearer)["']?\s*[:=]?\s*["']?$""")
    given = f"m.before RLIKE {assigned}" if kind == SECRET else str(strict).lower()
    told = [given, CHECKED[kind], known(kind), f"m.before RLIKE {literal(CUES[kind])}", LONG_ENOUGH[kind], edges]
    return f"array({', '.join(f'cast(({v}) as int)' for v in told)})"


def features(kind: str) -> str:
    """Hashed features of a match m."""
    shape = "substr(regexp_replace(regexp_replace(m.match, '[0-9]+', '9'), '[A-Za-z]+', 'a'), 1, 24)"
    word = f"regexp_extract(m.before, {literal(r'([^ ]{1,20})\s*$')}, 1)"
    values = [("shape", shape), ("word", word), ("after", "m.after"), ("length", DIGITS), ("checked", CHECKED[kind]), ("known", known(kind))]
    return f"array({', '.join(f"concat('{kind}:{name}:', cast(pmod(xxhash64(cast(({v}) as string)), {FEATURE_BUCKETS}) as string))" for name, v in values)})"


def described(kind: str, found: str, strict: bool) -> str:
    return f"transform({found}, m -> named_struct('kind', '{kind}', 'start', m.start, 'end', m.end, 'votes', {votes(kind, strict)}, 'features', {features(kind)}))"


EMPTY = "array<struct<kind:string,start:int,end:int,votes:array<int>,features:array<string>>>"


def candidates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (with `carry`, the text and the other columns named, as `rest`), base and extra: arrays of candidates with votes and features."""
    plain = F.col("text").cast("string")
    rows = docs.select("doc_id", plain.alias("text"), F.coalesce(plain, F.lit("")).alias("t"), *rest_of(carry))
    none = f"cast(array() as {EMPTY})"
    strict, loose = [], []
    for kind in KINDS:
        worth = "t RLIKE '[0-9]'" if NEEDS[kind] is None else f"contains(t, '{NEEDS[kind]}')"
        strict.append(f"CASE WHEN {worth} THEN {described(kind, f'filter({matches("t", STRICT[kind])}, m -> {SOUND[kind]})', True)} ELSE {none} END")
    for kind in (*KINDS, SECRET):
        loose.append(f"CASE WHEN t RLIKE {literal(LOOSE[kind])} THEN {described(kind, matches('t', LOOSE[kind]), False)} ELSE {none} END")
    kept = ["text", "rest"] if carry else []
    found = rows.select("doc_id", *kept, F.expr(f"concat({', '.join(strict)})").alias("base"), F.expr(f"concat({', '.join(loose)})").alias("loose"))

    def apart(x: Column) -> Column:
        return (x["kind"] == SECRET) | ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]))

    return found.select("doc_id", *kept, "base", F.when(F.size("base") == 0, F.col("loose")).otherwise(F.filter("loose", apart)).alias("extra"))


def posteriors(cands: DataFrame) -> DataFrame:
    """kind, votes and q: the probability that a candidate with these votes is personal data.

    One row a kind holds its vote patterns and counts; the rounds of
    expectation and maximisation run over that array.
    """
    each = cands.select(F.explode(F.concat("base", "extra")).alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).agg(F.count("*").cast("double").alias("n"))
    patterns = each.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    first = F.struct(F.lit(0.7).alias("share"), F.array(*[F.lit(x) for x in (0.95, 0.9, 0.7, 0.6, 0.9, 0.9)]).alias("hit"), F.array(*[F.lit(x) for x in (0.05, 0.3, 0.3, 0.1, 0.4, 0.4)]).alias("alarm"))

    def likely(votes: Column, rate: Column) -> Column:
        return F.aggregate(F.zip_with(votes, rate, lambda v, r: F.when(v == 1, r).otherwise(1 - r)), F.lit(1.0), lambda a, x: a * x)

    def judged(p: Column, s: Column) -> Column:
        both = F.struct((s["share"] * likely(p["votes"], s["hit"])).alias("yes"), ((1 - s["share"]) * likely(p["votes"], s["alarm"])).alias("no"))
        return let(both, lambda b: b["yes"] / (b["yes"] + b["no"]))

    def total(items: Column, value) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))

    def rates(items: Column, weight, all_n: Column, prior: tuple[float, float]) -> Column:
        return F.array(*[(total(items, lambda x, j=j: weight(x) * x["votes"][j]) + prior[0]) / (all_n + prior[0] + prior[1]) for j in range(LABELERS)])

    def update(s: Column, _: Column) -> Column:
        def rated(items: Column) -> Column:
            def share(sums: Column) -> Column:
                yes, no = sums["yes"], sums["no"]
                return F.struct(((yes + 1) / (yes + no + 2)).alias("share"), rates(items, lambda x: x["yes"], yes, (2.0, 1.0)).alias("hit"), rates(items, lambda x: x["no"], no, (1.0, 2.0)).alias("alarm"))

            return let(F.struct(total(items, lambda x: x["yes"]).alias("yes"), total(items, lambda x: x["no"]).alias("no")), share)

        judgedly = F.transform("patterns", lambda p: let(judged(p, s), lambda q: F.struct(p["votes"].alias("votes"), (p["n"] * q).alias("yes"), (p["n"] * (1 - q)).alias("no"))))
        return let(judgedly, rated)

    fitted = patterns.select("kind", "patterns", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, update).alias("s"))
    return fitted.select("kind", F.explode("patterns").alias("p"), "s").select("kind", F.col("p.votes").alias("votes"), judged(F.col("p"), F.col("s")).alias("q"))


def constant_map(values: dict[str, float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,double>")


def classifier(cands: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of each kind and of each hashed feature, from soft labels; both bounded."""
    q = {f"{r['kind']}:{''.join(map(str, r['votes']))}": r["q"] for r in posteriors(cands).collect()}
    if not q:
        return {}, {}
    c = F.col("c")
    soft = cands.select(F.explode(F.concat("base", "extra")).alias("c")).select(
        c["kind"].alias("kind"), c["features"].alias("features"), F.element_at(constant_map(q), F.concat(c["kind"], F.lit(":"), F.array_join(c["votes"].cast("array<string>"), ""))).alias("q"))
    kinds = {r["kind"]: (r["yes"], r["no"]) for r in soft.groupBy("kind").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()}
    odds = soft.select("kind", "q", F.explode("features").alias("f")).groupBy("kind", "f").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    totals = F.from_json(F.lit(json.dumps({k: list(v) for k, v in kinds.items()})), "map<string,array<double>>")[F.col("kind")]
    # shares are drawn to the feature's share of all candidates, so one that tells nothing weighs nothing
    pooled = SHRINKAGE * (F.col("yes") + F.col("no")) / (totals[0] + totals[1])
    weight = F.log((F.col("yes") + pooled) / (totals[0] + SHRINKAGE)) - F.log((F.col("no") + pooled) / (totals[1] + SHRINKAGE))
    rows = odds.select("f", weight.alias("w")).collect()
    return {k: log((y + 1) / (n + 1)) for k, (y, n) in kinds.items()}, {r["f"]: r["w"] for r in rows}


def spans(docs: DataFrame, carry: tuple[str, ...] = (), accept: float = ACCEPT) -> DataFrame:
    """doc_id (text and rest), base, accepted and secrets: arrays of (kind, start, end); accepted holds the base as well, secrets are apart."""
    cands = saved(candidates(docs, carry), "candidates")
    prior, weight = classifier(cands)
    kept = ["text", "rest"] if carry else []
    slim = lambda items: F.transform(items, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    if not prior:
        return cands.select("doc_id", *kept, slim("base").alias("base"), slim("base").alias("accepted"), slim("extra").alias("secrets"))
    priors, weights = constant_map(prior), constant_map(weight)

    def score(x: Column) -> Column:
        return F.aggregate(x["features"], F.coalesce(F.element_at(priors, x["kind"]), F.lit(0.0)), lambda a, f: a + F.coalesce(F.element_at(weights, f), F.lit(0.0)))

    good = F.filter("extra", lambda x: score(x) >= log(accept / (1 - accept)))
    # of overlapping ones the earlier, then the longer, stays
    ordered = F.array_sort(F.transform(F.filter("good", lambda x: x["kind"] != SECRET), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("out"))
    apart = F.aggregate(ordered, state, lambda a, x: F.when(x["start"] >= a["at"], F.struct(
        (-x["back"]).alias("at"), F.concat(a["out"], F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end")))).alias("out"))).otherwise(a), lambda a: a["out"])
    judged = cands.select("doc_id", *kept, slim("base").alias("base"), slim(good).alias("good"))
    return judged.select("doc_id", *kept, "base", F.concat("base", apart).alias("accepted"), F.filter("good", of_kind(SECRET)).alias("secrets"))


def listed(items: Column | str) -> Column:
    """kind:start:end of each, by kind as listed and start, joined by commas."""
    place = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for kv in {**place, SECRET: len(KINDS)}.items() for x in kv])
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(rank[x["kind"]].alias("k"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, spans (all of the kinds listed), secrets, and n_found: how many spans and secrets."""
    found = spans(docs)
    return found.select(
        "doc_id", *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("accepted").alias("spans"), listed("secrets").alias("secrets"),
        (F.size("accepted") + F.size("secrets")).cast("long").alias("n_found"))


def redacted(items: str) -> Column:
    """The column `text` with every span of items (an SQL array) replaced by its kind in brackets; of overlapping spans the first names the whole."""
    items = f"transform({items}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))"
    part = "concat(substr(text, at + 1, greatest(x.start - at, 0)), CASE WHEN x.start >= at THEN concat('[', upper(x.kind), ']') ELSE '' END)"
    parts = f"zip_with(spans, {before_each('spans', 'x.end', 'greatest(l, r)')}, (x, at) -> {part})"
    cut = bound(f"array_sort({items})", "spans", f"array_join(concat({parts}, array(substr(text, array_max(transform(spans, x -> x.end)) + 1))), '')")
    return F.expr(f"CASE WHEN size({items}) > 0 THEN {cut} ELSE text END")
