"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are the matches of the four strict patterns and of wider ones (written-out addresses, phone
numbers without a plus, cards inside longer rows of digits, names after a title). Every candidate gets the
votes of five labelers: strict format, checksum or range, gazetteer, context words, isolation. Votes are
counted per kind and pattern of votes over all candidates (at most 32 patterns a kind), and
expectation-maximisation over these counts estimates the share of true spans and how reliable each
labeler is. A logistic classifier over the votes is then trained on the estimated labels and decides
about every candidate. Strict matches that pass their check always stay, those that fail go (they
are the negative evidence); the classifier adds wide matches that pass their check and overlap none.

Only DataFrame functions. Patterns are written with possessive quantifiers and start conditions, so each
text is read in linear time without recursion, and only texts that hold a trigger are searched.
Positions are running sums over the pieces between matches, as a window over the few match rows, so
texts themselves are never shuffled and a text may hold any number of matches.

Defined cases: a null text is empty and has no spans; null ids and repeated rows get their own result;
ties in start go by kind in the order listed; further columns are ignored.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterfold.llm.common import written

# The kinds in their order, and the strict patterns of the contract. A match starts at a
# place no match can start before: behind the last match, or behind a sign the pattern cannot hold.
KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = KINDS[:4]
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[\[(](?:at|AT)[\])]\x20?{_HOST}{{1,63}}+"
             rf"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?){_HOST}{{1,63}}+){{1,5}}+",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30}){0,2}+",
}
TRIGGER = {"email": "@", "phone": r"\+[0-9]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]"}
WIDE_TRIGGER = {"email": r"[\[(](?:at|AT)[\])]", "card": r"[0-9]{4}[\x20-]?[0-9]{4}",
                "phone": r"[0-9]{3}[\x20.-][0-9]{4}",
                "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]"}
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
CONTEXT = {
    "email": "mail|contact|write|reach", "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|pay|account", "phone": "phone|tel|call|fax|mobile|contact",
    "name": "name|dear|by|from|signed",
}
LABELERS = ("strict", "checked", "gazetteer", "context", "isolated")
ROUNDS = 50
_DOC = ["doc_id", "text_hash"]


def _matches(docs: DataFrame, kind: str, pattern: str, trigger: str, strict: bool) -> DataFrame:
    """One row per match: document, kind, start, end, the match and what stands around it."""
    text = F.col("text")
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.slice(F.split(text, pattern, -1), 2, 2147483647).alias("next"))
    rows = docs.where(text.rlike(trigger)).select(*_DOC, F.posexplode(pieces)).select(
        *_DOC, "pos", F.length("col.gap").alias("gap"), F.col("col.found").alias("found"),
        F.substring("col.gap", -40, 40).alias("before"), F.substring("col.next", 1, 1).alias("after")
    ).where(F.col("found").isNotNull())
    order = Window.partitionBy(*_DOC, "copy").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # Rows equal in id and text give the same matches; the window sees each place once.
    rows = rows.dropDuplicates([*_DOC, "pos"]).withColumn("copy", F.lit(0))
    end = F.sum(F.col("gap") + F.length("found")).over(order)
    return rows.withColumn("end", end).select(
        *_DOC, F.lit(kind).alias("kind"), (F.col("end") - F.length("found")).alias("start"), "end", "found",
        "before", "after", F.lit(strict).alias("strict"))


def _luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, 1).cast("int")).otherwise(
            F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                  F.substring(digits, i, 1).cast("int"))))
    return (n > 0) & (total % 10 == 0)


def _by_kind(values: dict, default: Column) -> Column:
    out = default
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, base, and one vote column per labeler)."""
    rows = None
    for patterns, triggers, strict in ((STRICT, TRIGGER, True), (WIDE, WIDE_TRIGGER, False)):
        for kind, pattern in patterns.items():
            part = _matches(docs, kind, pattern, triggers[kind], strict)
            rows = part if rows is None else rows.unionByName(part)
    found, digits = F.col("found"), F.regexp_replace("found", "[^0-9]", "")
    n = F.length(digits)
    octets = F.split(found, r"\.")
    small = F.forall(octets, lambda o: F.length(F.ltrim(o, F.lit("0"))) <= 3) & F.forall(
        octets, lambda o: F.coalesce(F.substring(F.ltrim(o, F.lit("0")), 1, 3).cast("int"), F.lit(0)) <= 255)
    # Luhn sums are taken of at most 19 digits; longer groups fail by their number.
    passed = _by_kind({
        "email": F.lit(True), "ip": small,
        "card": F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)),
        "phone": n.between(10, 15), "name": F.lit(True)}, F.lit(False))
    ending = F.lower(F.regexp_extract(found, r"([A-Za-z]+)$", 1))
    listed = _by_kind({
        "email": ending.isin(*ENDINGS), "ip": ~found.rlike(r"^(?:0|127|255)\."),
        "card": digits.rlike("^[3-6]"), "phone": ~digits.rlike("^0"),
        "name": F.lit(True)}, F.lit(False))
    nearby = _by_kind({k: F.lower("before").rlike(rf"(?:{w})[^\n]{{0,24}}$") for k, w in CONTEXT.items()}, F.lit(False))
    apart = ~F.col("before").rlike(r"[\p{L}0-9]$") & ~F.coalesce("after", F.lit("")).rlike(r"^[\p{L}0-9]")
    votes = {"strict": F.col("strict"), "checked": passed, "gazetteer": listed, "context": nearby,
             "isolated": apart}
    return rows.select(
        *_DOC, "kind", "start", "end", (F.col("strict") & passed).alias("base"),
        *[F.coalesce(v, F.lit(False)).cast("int").alias(f"v_{name}") for name, v in votes.items()])


def aggregate_votes(counts: list) -> list[float]:
    """Probability that a span is true for every (votes, n), by expectation-maximisation.

    Labelers are independent given the truth; each has one rate of voting yes on true and one on false
    spans. Starts from the share of yes votes, so the labels keep their sense.
    """
    total = sum(n for _, n in counts)
    width = len(counts[0][0])
    belief = [(1 + sum(v)) / (2 + width) for v, _ in counts]
    for _ in range(ROUNDS):
        true = sum(b * n for b, (_, n) in zip(belief, counts))
        prior = (true + 1) / (total + 2)
        rates = []
        for j in range(width):
            yes = sum(b * n * v[j] for b, (v, n) in zip(belief, counts))
            no = sum((1 - b) * n * v[j] for b, (v, n) in zip(belief, counts))
            rates.append(((yes + 1) / (true + 2), (no + 1) / (total - true + 2)))
        belief = []
        for v, _ in counts:
            odds = math.log(prior / (1 - prior))
            for x, (p, q) in zip(v, rates):
                odds += math.log(p / q) if x else math.log((1 - p) / (1 - q))
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return belief


def train_classifier(counts: list, belief: list[float], rounds: int = 300, rate: float = 0.5) -> list[float]:
    """Logistic weights (intercept first) over votes, fitted to the estimated labels by gradient steps."""
    total = sum(n for _, n in counts)
    weights = [0.0] * (len(counts[0][0]) + 1)
    for _ in range(rounds):
        step = [-0.001 * w for w in weights]
        for (v, n), b in zip(counts, belief):
            x = (1, *v)
            z = sum(w * y for w, y in zip(weights, x))
            error = b - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for j, y in enumerate(x):
                step[j] += error * y * n / total
        weights = [w + rate * s for w, s in zip(weights, step)]
    return weights


def train(found: DataFrame) -> dict[str, list[float]]:
    """Classifier weights per kind, from the vote patterns of all candidates.

    At most len(KINDS) * 2 ** len(LABELERS) rows of counts reach the driver.
    """
    names = [f"v_{x}" for x in LABELERS]
    by_kind = {}
    for r in found.groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *names).collect():
        by_kind.setdefault(r.kind, []).append((tuple(r[x] for x in names), r.n))
    return {kind: train_classifier(counts, aggregate_votes(counts)) for kind, counts in by_kind.items()}


def decided(found: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """Base spans, and the other candidates the classifier takes that overlap no base span."""
    z = _by_kind({
        kind: sum((F.col(f"v_{x}") * float(w) for x, w in zip(LABELERS, ws[1:])), F.lit(float(ws[0])))
        for kind, ws in weights.items()}, F.lit(-1.0))
    added = (F.col("v_strict") == 0) & (F.col("v_checked") == 1) & (z > 0)
    taken = found.where(F.col("base") | added)
    by_place = Window.partitionBy(*_DOC).orderBy("start", "end", "kind", "base")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(
        by_place.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(
        by_place.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (
        F.coalesce(base_start >= F.col("end"), F.lit(True)))
    return taken.withColumn("_clear", clear).where(F.col("base") | F.col("_clear")).drop("_clear").dropDuplicates(
        [*_DOC, "kind", "start", "end", "base"])


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, text_hash, kind, start, end (code points, end exclusive), base."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.length("text") > 0)
    found = written(candidates(rows))
    return decided(found, train(found)).select(*_DOC, "kind", "start", "end", "base")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("rank")
    span = F.struct("start", rank, "end", "kind", "base")
    per_doc = find_spans(docs).groupBy(*_DOC).agg(F.array_sort(F.collect_list(span)).alias("all"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash"))
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string,base:boolean>>")
    joined = rows.join(per_doc.alias("s"), same, "left").select(
        F.col("d.doc_id").alias("doc_id"), F.coalesce("s.all", none).alias("all"))
    base = F.filter("all", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("all", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return joined.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"))
