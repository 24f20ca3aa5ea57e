"""Personal data by weak supervision, in DataFrame functions alone.

1. Candidates.  Four base kinds, found by pattern and check (card: Luhn; ip: parts up
   to 255; digit counts), and two wider kinds: ``secret`` (name=value) and ``number``
   (grouped digits).  ``split`` and ``regexp_extract_all`` give gaps and matches, and a
   window over a document's matches turns their lengths into code-point offsets.
2. Labelers vote yes, no or nothing on each candidate: strict regex, gazetteers, context
   before the span, shape.
3. Expectation-maximisation estimates how reliable each labeler is, from the counts of
   vote patterns over all candidates (a few hundred rows, whatever the corpus).
4. The posteriors train the span classifier, a logistic regression on span features,
   again from counts.  It admits the wider candidates; base spans always stay.

Patterns use possessive groups, so that a match of any length needs no deep stack, and
start at \\G or after a foreign character, so that a long run is tried once: that gives
the same leftmost non-overlapping matches in linear time.

Defined cases: null or empty text has no spans; rows equal in doc_id and text are one
document and each gets its result; null doc_id is a document; spans of different base
kinds may overlap, an admitted one overlaps no other; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, scratch

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# between a name and its value: quotes, blanks and a sign, as in  token = "..."
_SET = r"[\"']?[\x20\t]*+[=:]{1,2}>?[\x20\t]*+[\"']?"
#: kind: (what a text must hold, pattern)
PATTERNS = {
    "email": (r"@[A-Za-z0-9-]++\.", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (rf"[A-Za-z0-9_]{_SET}[^\s,;\"']{{8}}", rf"(?:\G|(?<![A-Za-z0-9_]))[A-Za-z_][A-Za-z0-9_]{{2,}}+{_SET}[^\s,;\"']{{8,}}+"),
    "number": (r"[0-9][)]?[\x20.-][0-9]{2,}[\x20.-][0-9]{4}", r"(?<![0-9A-Za-z+.-])[(]?[0-9]{3}[)]?[\x20.-]{1,2}[0-9]{2,3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
}
# Gazetteers and cues: fixed lists.
TOP_DOMAINS = (
    "com org net edu gov mil int info biz name pro io ai app dev cloud online site shop tech "
    "de fr es uk it nl eu at ch be pt pl cz dk se no fi ie ru ua gr tr il in cn jp kr tw hk sg au nz br mx ar cl co za ca us"
).split()
SECRET_NAMES = (
    "password passwd passwort passphrase pwd pass secret token apikey api_key access_key secret_key signing_key encryption_key "
    "auth bearer credential private_key session_key session_id cookie jwt otp pin contrasena mot_de_passe clave geheim"
).split()
PUBLIC_NAMES = (
    "http https ftp url uri href src link path file dir time date day year note see version release revision rev commit "
    "sha sha1 sha256 sha512 md5 crc checksum digest etag hash build branch tag uuid guid isbn issn doi title color colour width height"
).split()
CUES = (
    "mail contact kontakt contacto tel phone call fax mobile handy anruf address adresse direccion card carte karte tarjeta visa "
    "mastercard amex iban login user host server ssn password passwort secret account konto compte cuenta customer kunde client reach"
).split()
COUNTER_CUES = "version release isbn issn section chapter kapitel page seite figure table price preis precio total sum http serial commit revision checksum example".split()
LABELERS = ("strict", "gazetteer", "context", "shape")
EM_ROUNDS, FIT_ROUNDS = 50, 400


def _digits(c) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0)


def _matches(kind: str) -> Column:
    """Array of (kind, i, gap, before, body, after) of a text's matches."""
    need, pattern = PATTERNS[kind]
    gaps, bodies = F.split("_text", pattern, -1), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    both = F.arrays_zip(gaps.alias("gap"), bodies.alias("body"), F.concat(F.slice(gaps, 2, F.size(gaps)), F.array(F.lit(""))).alias("next"))
    some = F.transform(
        both,
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("ord"),
            i.alias("i"),
            F.length(x["gap"]).alias("gap"),
            F.right(x["gap"], F.lit(40)).alias("before"),
            x["body"].alias("body"),
            F.left(x["next"], F.lit(10)).alias("after"),
        ),
    )
    return F.when(F.col("_text").rlike(need), F.filter(some, lambda x: x["body"].isNotNull()))


def _any(c: Column, listed) -> Column:
    return c.rlike("(?i)(?:" + "|".join(listed) + ")")


def _vote(yes: Column, no: Column) -> Column:
    """2 yes, 1 no, 0 nothing."""
    return F.when(F.coalesce(yes, F.lit(False)), 2).when(F.coalesce(no, F.lit(False)), 1).otherwise(0)


def candidates(docs: DataFrame) -> DataFrame:
    """One row for each candidate of each document: place, base or not, votes, features."""
    flat = F.flatten(F.filter(F.array(*[_matches(k) for k in KINDS]), lambda x: x.isNotNull()))
    rows = keyed(docs).select("_did", "_tid", F.explode(flat).alias("c")).select("_did", "_tid", "c.*").dropDuplicates(["_did", "_tid", "ord", "i"])
    w = Window.partitionBy("_did", "_tid", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.length("body")).over(w)).withColumn("start", F.col("stop") - F.length("body"))
    rows = rows.withColumn("digits", _digits("body")).withColumn("n_digits", F.length("digits"))
    kind = lambda k: F.col("ord") == KINDS.index(k)
    body, before, n = F.col("body"), F.lower("before"), F.col("n_digits")
    # chained when(): a check runs on rows of its own kind only
    public = rf"^(?:.*_)?(?:{'|'.join(PUBLIC_NAMES)})$"
    passes = F.when(kind("email"), True).when(kind("ip"), body.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).when(kind("phone"), n.between(10, 15))
    passes = passes.when(kind("card"), F.when(n.between(14, 19), luhn(F.col("digits"))).otherwise(False)).otherwise(False)
    value = F.regexp_extract("body", rf"^[A-Za-z0-9_]+{_SET}(.*)$", 1)
    name = F.lower(F.regexp_extract("body", r"^([A-Za-z0-9_]+)", 1))
    drawn = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_.~=-]{16,}$"  # letters and digits mixed, no words
    plain = r"^[A-Za-z.]+$|^[0-9.:,T/Z+-]+$|^//|^[a-z]+://|^[./~][A-Za-z0-9_./-]*$"
    strict = _vote(
        F.when(kind("secret"), value.rlike(drawn) & ~value.rlike(plain)).when(kind("number"), body.rlike(r"^[(]?[2-9][0-9]{2}[)]?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")).otherwise(passes),
        F.when(kind("secret"), value.rlike(plain)).when(kind("number"), F.lit(False)).otherwise(~passes),
    )
    gazetteer = _vote(
        F.when(kind("email"), body.rlike(rf"(?i)\.(?:{'|'.join(TOP_DOMAINS)})$")).when(kind("card"), F.col("digits").rlike("^(?:4|5[1-5]|3[47]|6011|65|2[2-7])")).when(kind("phone"), F.col("digits").rlike("^(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")).when(kind("secret"), _any(name, SECRET_NAMES) & ~name.rlike(public)).when(kind("ip"), ~F.col("digits").rlike("^0+$")),
        F.when(kind("card"), F.col("digits").rlike("^[09]")).when(kind("secret"), name.rlike(public)),
    )
    # a secret's own name stands for its context
    near = F.when(kind("secret"), F.concat_ws(" ", before, name)).otherwise(before)
    context = _vote(_any(near, (*CUES, "token", "key")), _any(near, COUNTER_CUES))
    shape = _vote(
        F.when(kind("secret"), (F.length(value) >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")).when(n >= 7, ~F.col("digits").rlike(r"^([0-9])\1+$")),
        F.when(kind("secret"), value.rlike("[(){}<>]|^[0-9.]+$")).when(kind("ip") | kind("number"), F.col("after").rlike("^[.][0-9]") | F.col("before").rlike("[0-9][.-]$")).when(n > 3, F.col("digits").rlike(r"^([0-9])\1+$")),
    )
    size = F.least(F.floor(F.length("body") / 8), F.lit(5)).cast("int")
    share = F.floor(4 * n / F.length("body")).cast("int")
    edge = F.when(F.col("before").rlike(r"(?:^|[\s(:=])$"), 1).otherwise(0) + F.when(F.col("after").rlike(r"^(?:$|[\s,.;)])"), 2).otherwise(0)
    return rows.select("_did", "_tid", "ord", F.col("start").cast("int"), F.col("stop").cast("int"), F.coalesce(passes, F.lit(False)).alias("base"), strict.alias("strict"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"), size.alias("size"), share.alias("share"), edge.alias("edge"))


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS):
    """counts: (votes, times).  Posterior of "personal" for each vote pattern, and each
    labeler's chance of each vote given the truth."""
    k = len(LABELERS)
    rate = 0.5
    # reliable a priori: a vote is right four times in five
    table = [[[0.34, 0.53, 0.13], [0.34, 0.13, 0.53]] for _ in range(k)]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _n in counts:
            a = math.log(rate) + sum(math.log(table[j][1][v]) for j, v in enumerate(votes))
            b = math.log(1 - rate) + sum(math.log(table[j][0][v]) for j, v in enumerate(votes))
            post[votes] = 1 / (1 + math.exp(min(50.0, b - a)))
        total = sum(n for _, n in counts)
        rate = min(0.99, max(0.01, (1 + sum(n * post[v] for v, n in counts)) / (2 + total)))
        for j in range(k):
            for truth in (0, 1):
                # pseudo-counts keep a labeler from turning against its meaning
                seen = [2.0, 2.0 + 6.0 * (truth == 0), 2.0 + 6.0 * (truth == 1)]
                for votes, n in counts:
                    p = post[votes]
                    seen[votes[j]] += n * (p if truth else 1 - p)
                table[j][truth] = [x / sum(seen) for x in seen]
    return post, table


FEATURES = ("ord", "size", "share", "edge", *LABELERS)


def fit(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = FIT_ROUNDS) -> dict[tuple[str, int], float]:
    """Logistic regression on one-hot features.  rows: (feature values, weight, target)."""
    weight: dict[tuple[str, int], float] = {("", 0): 0.0}
    squares: dict[tuple[str, int], float] = {("", 0): 1e-6}
    for values, _, _ in rows:
        for f in zip(FEATURES, values, strict=True):
            weight.setdefault(f, 0.0)
            squares.setdefault(f, 1e-6)
    total = sum(w for _, w, _ in rows) or 1.0
    for _ in range(rounds):
        slope = {f: 1e-4 * w for f, w in weight.items()}
        for values, w, y in rows:
            on = [("", 0), *zip(FEATURES, values, strict=True)]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[f] for f in on)))))
            for f in on:
                slope[f] += w * (p - y) / total
        for f, g in slope.items():
            squares[f] += g * g
            weight[f] -= 0.3 * g / math.sqrt(squares[f])
    return weight


def classify(found: DataFrame) -> Column:
    """The trained span classifier as one expression; training reads counts only."""
    rows = found.groupBy(*FEATURES).count().collect()
    patterns: dict[tuple[int, ...], int] = {}
    for r in rows:
        votes = tuple(r[f] for f in LABELERS)
        patterns[votes] = patterns.get(votes, 0) + r["count"]
    if not rows:
        return F.lit(0.0)
    post, _ = estimate(sorted(patterns.items()))
    weight = fit([(tuple(r[f] for f in FEATURES), float(r["count"]), post[tuple(r[f] for f in LABELERS)]) for r in rows])
    total = F.lit(weight[("", 0)])
    for f in FEATURES:
        own = None
        for (name, value), w in sorted(weight.items()):
            if name == f:
                own = (F.when if own is None else own.when)(F.col(f) == value, F.lit(w))
        total = total + own.otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def find_spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """_did, _tid, ord (kind), start, stop, base: the base spans and the admitted ones."""
    found = scratch(candidates(docs), "candidates")
    scored = found.withColumn("p", classify(found)).filter(F.col("base") | (F.col("ord") >= len(BASE)) & (F.col("p") >= least))
    doc = Window.partitionBy("_did", "_tid").orderBy("start", "ord")
    before, after = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(1, Window.unboundedFollowing)
    free = (F.coalesce(F.max("stop").over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after), F.col("stop")) >= F.col("stop"))
    return scored.withColumn("free", free).filter("base or free").select("_did", "_tid", "ord", "start", "stop", "base")


_NAME = F.element_at  # kinds by number, from one


def _kind(ord_: Column) -> Column:
    return _NAME(F.array(*[F.lit(k) for k in KINDS]), ord_ + 1)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s["ord"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def spans_by_document(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of docs, _text, base_spans and spans: arrays of (start, ord, stop)."""
    found = find_spans(docs)
    span = F.struct("start", "ord", "stop")
    by_doc = found.groupBy("_did", "_tid").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base_spans"), F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast("array<struct<start:int,ord:int,stop:int>>")
    out = keyed(docs, *columns).join(by_doc, ["_did", "_tid"], "left")
    return out.withColumn("base_spans", F.coalesce("base_spans", empty)).withColumn("spans", F.coalesce("spans", empty))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (as text) and spans (as text)."""
    out = spans_by_document(docs, "doc_id")
    # a function of one argument: Spark would pass a second one the place in the array
    of_kind = lambda k: F.filter("base_spans", lambda s: s["ord"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, _listed(F.col("base_spans")).alias("base"), _listed(F.col("spans")).alias("spans"))


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """docs, all columns, with each span of text replaced by [kind]; null text stays null."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_x{k}") for k, c in enumerate(names)], F.col("doc_id"), F.col("text"))
    out = spans_by_document(plain, *[f"_x{k}" for k in range(len(names))])
    # overlapping spans become one cut: what lies beyond the furthest stop so far
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["stop"] <= acc["at"], acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(F.struct(F.greatest(acc["at"], s["start"]).alias("start"), s["ord"].alias("ord"), s["stop"].alias("stop"))))).alias("cuts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,stop:int>>").alias("cuts"))
    out = out.withColumn("_cuts", F.when(F.size("spans") > 0, F.aggregate("spans", start, step)["cuts"]))
    upto = lambda i: F.when(i == 0, 0).otherwise(F.get("_cuts", i - 1)["stop"])
    pieces = F.transform("_cuts", lambda s, i: F.concat(F.substring(F.col("_text"), upto(i) + 1, s["start"] - upto(i)), F.lit("["), _kind(s["ord"]), F.lit("]")))
    text = F.concat(F.array_join(pieces, ""), F.substring(F.col("_text"), F.element_at("_cuts", -1)["stop"] + 1, F.length("_text")))
    at = names.index("text")
    return out.select(*[(F.when(F.col("_cuts").isNotNull(), text).otherwise(F.col(f"_x{k}")) if k == at else F.col(f"_x{k}")).alias(c) for k, c in enumerate(names)])
