"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns find the base spans (email, ip, card, phone), which stay, and looser
candidates. Labelers of three sorts vote on each candidate: its own form
(regular expressions and checksums), gazetteers, and the text around it. The
votes are counted per pattern of votes, a table of fixed size; expectation
maximisation over it estimates how reliable each labeler is and how often each
kind is real, without any labelled row. The probabilities that follow train
the final span classifier, naive Bayes over features of form and context,
which decides about the candidates that the base patterns do not settle.

Offsets are in code points: a text is split at a pattern, and the lengths of
gaps and matches are summed up in a window over the text's matches. Only
matches and a few characters around them shuffle, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewatch.llm.shared import cut

AROUND = 24
EM_ROUNDS = 12
#: What labelers see of a long span, so that their patterns take bounded time: its two ends.
ENDS = "if(length(span) > 64, concat(left(span, 32), right(span, 32)), span)"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "name", "secret")

# Base patterns in forms that need no backtracking over long runs: they match what
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+        [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+  (13 digits or more)               \+[0-9][\x20().0-9-]+[0-9]
# match. A local part starts at its run's start or where the match before it ended.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DIGIT = "[0-9]"
#: (kind, pattern, a cheaper test that every text with a match passes, whether a base pattern)
PATTERNS = (
    ("email", EMAIL, "@", True),
    ("ip", IP, DIGIT, True),
    ("card", CARD, DIGIT, True),
    ("phone", PHONE, r"\+[0-9]", True),
    ("email", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,40}+[ ]?[(\[][ ]?at[ ]?[)\]][ ]?[a-z0-9-]{2,40}+[ ]?[(\[][ ]?dot[ ]?[)\]]"
              r"[ ]?[a-z]{2,10}+", r"(?i)[(\[][ ]?dot[ ]?[)\]]", False),
    ("phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])", DIGIT, False),
    ("id", r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", DIGIT, False),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?", r"(?:Mr|Mrs|Ms|Dr)\.? [A-Z]",
     False),
    ("secret", r"AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|api_?key|token)[\"']?[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+-]{8,}+",
     r"AKIA|(?i:password|passwd|secret|api_?key|token)[\"']?[ ]?[=:]", False),
)

# The gazetteers.
PROVIDERS = "example gmail yahoo hotmail outlook icloud proton mail gmx web".split()
TOP_DOMAINS = "com org net edu gov io co de fr es uk info eu".split()
NAMES = "james mary john anna maria david peter paul laura sarah thomas julia carlos lucia pierre marie hans ana".split()
CUES = {
    "email": "mail|e-mail|contact|write|reach|@", "ip": "ip|address|host|server|from|client",
    "card": "card|visa|master|amex|credit|pay", "phone": "call|phone|tel|mobile|fax|dial|contact",
    "id": "ssn|social|tax|id|passport", "name": "name|dear|contact|from|by|patient", "secret": "login|key|auth|user|access|cred",
}
AGAINST = "version|release|license|licence|isbn|issn|page|figure|table|section|chapter|build|step"


def _luhn(digits: str) -> str:
    at = f"cast(substring(reverse({digits}), i, 1) as int)"
    return (f"aggregate(transform(sequence(1, greatest(length({digits}), 1)), i -> if(i % 2 = 0, {at} * 2 - if({at} > 4, 9, 0),"
            f" {at})), 0, (s, x) -> s + x) % 10 = 0")


_DIGITS = "regexp_replace(span, '[^0-9]', '')"
_SMALL = r"regexp_replace(p, '^0+(?=.)', '')"
VALID = {
    "email": "true",
    "ip": rf"forall(split(span, '\\.'), p -> length({_SMALL}) <= 3 and cast({_SMALL} as int) <= 255)",
    "card": f"length({_DIGITS}) between 13 and 19 and {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def _in_kind(by_kind: dict[str, str], default: str) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in by_kind.items()) + f" ELSE {default} END"


def _vote(yes: str, no: str = "false") -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


_HOST = r"lower(regexp_extract(span, '([A-Za-z]+)$', 1))"
_LEFT, _RIGHT = "lower(lctx)", "lower(rctx)"
#: Votes on a candidate (kind, span, lctx, rctx, base): 1 personal, -1 not, 0 no opinion.
LABELERS = {
    "form": _in_kind({"email": _vote(r"span rlike '^[^@]+@[^@]+\\.[A-Za-z]{2,}$'", r"span not rlike '[A-Za-z]{2,}$'"),
                      "ip": _vote("base", "not base"), "card": _vote("base", "not base"),
                      "phone": _vote(r"span rlike '^\\+?[0-9]{0,2} ?\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$'", "not base"),
                      "id": _vote(r"span rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'", "true"),
                      "name": _vote(r"span rlike ' [A-Z][a-z]+ [A-Z][a-z]+$'"),
                      "secret": _vote(r"span rlike '^AKIA' or span rlike '[0-9]'", "span not rlike '[0-9]'")}, "0"),
    "variety": _in_kind({"name": "0"}, _vote(
        "size(array_distinct(split(regexp_replace(span, '[^0-9A-Za-z]', ''), ''))) >= 5",
        "size(array_distinct(split(regexp_replace(span, '[^0-9A-Za-z]', ''), ''))) <= 2")),
    "gazetteer": _in_kind({
        "email": _vote(f"{_HOST} in ({', '.join(map(repr, TOP_DOMAINS))}) or lower(span) rlike '[@.]({'|'.join(PROVIDERS)})[0-9]*[.]'",
                       f"length({_HOST}) < 2"),
        "ip": _vote("cast(split(span, '[.]')[0] as int) between 1 and 223", r"span rlike '^(0|127|255)[.]'"),
        "card": _vote("span rlike '^[3-6]'", "span rlike '^[0789]'"),
        "phone": _vote(r"span rlike '^\\+1 ?[( ]?[2-9]' or span rlike '^\\+[2-9]'", r"span rlike '^\\(?[01]'"),
        "name": _vote(f"lower(span) rlike '\\\\b({'|'.join(NAMES)})\\\\b'")}, "0"),
    "cue": _vote(_in_kind({k: f"{_LEFT} rlike '(?<![a-z])({v})[^a-z]*$'" for k, v in CUES.items()}, "false")),
    "subject": _vote("false", f"{_LEFT} rlike '(?<![a-z])({AGAINST})[^a-z]*$' or {_RIGHT} rlike '^[^a-z]*({AGAINST})'"),
    "edges": _vote("lctx not rlike '[0-9A-Za-z]$' and rctx not rlike '^[0-9A-Za-z]'",
                   "lctx rlike '[0-9A-Za-z]$' and rctx rlike '^[0-9A-Za-z]'"),
}
#: Features of the final classifier; each has a fixed number of levels.
FEATURES = {
    "digits": f"least(length({_DIGITS}), 20)",
    "length": "least(length(span) div 4, 12)",
    "first": "CASE WHEN span rlike '^[0-9]' THEN 0 WHEN span rlike '^[a-z]' THEN 1 WHEN span rlike '^[A-Z]' THEN 2 ELSE 3 END",
    "marks": "least(size(array_distinct(split(regexp_replace(span, '[0-9A-Za-z]', ''), ''))), 4)",
    "left": r"CASE WHEN lctx = '' THEN 0 WHEN lctx rlike '\\s$' THEN 1 WHEN lctx rlike '[0-9A-Za-z]$' THEN 2 ELSE 3 END",
    "right": r"CASE WHEN rctx = '' THEN 0 WHEN rctx rlike '^\\s' THEN 1 WHEN rctx rlike '^[0-9A-Za-z]' THEN 2 ELSE 3 END",
    "cue": LABELERS["cue"],
    "subject": LABELERS["subject"],
}


def candidates(docs: DataFrame) -> DataFrame:
    """(id, key, kind, base, start, end, span, lctx, rctx) for every match in ``docs`` (id, key, t).

    ``base`` tells spans of the base patterns that pass their tests. Matches of
    a base pattern that fail them are no candidates, as no part of them is.
    """
    found = None
    for n, (kind, pattern, test, base) in enumerate(PATTERNS):
        p, quick = F.lit(pattern), F.col("t").contains("@") if test == "@" else F.col("t").rlike(test)
        gaps, hits = F.split("t", pattern, -1), F.regexp_extract_all("t", p, F.lit(0))
        part = (docs.where(quick).select("id", "key", gaps.alias("g"), hits.alias("h")).where("size(h) > 0")
                .select("id", "key", F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.lit(base).alias("of_base"),
                        F.posexplode(F.expr(
                            "transform(h, (m, i) -> named_struct('span', m, 'gap', length(g[i]),"
                            f" 'lctx', right(g[i], {AROUND}), 'rctx', left(g[i + 1], {AROUND})))")).alias("pos", "m"))
                .select("id", "key", "n", "kind", "of_base", "pos", "m.*"))
        found = part if found is None else found.unionByName(part)
    # Rows repeated with id and text have the same matches; one of each stays.
    found = found.dropDuplicates(["id", "key", "n", "pos"])
    upto = Window.partitionBy("id", "key", "n").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.length("span")).over(upto)) \
        .withColumn("start", F.col("end") - F.length("span"))
    valid = F.expr(_in_kind(VALID, "true"))
    return (found.withColumn("base", F.col("of_base") & valid).where("base or not of_base")
            .select("id", "key", "kind", "base", "start", "end", F.expr(ENDS).alias("span"), "lctx", "rctx"))


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _posterior(prior: dict[str, float], right: dict[str, float]) -> Column:
    odds = F.expr(_in_kind({k: repr(_log_odds(v)) for k, v in prior.items()}, "0.0"))
    for name, value in right.items():
        odds = odds + F.col(f"v_{name}") * F.lit(_log_odds(value))
    return F.lit(1.0) / (1 + F.exp(-odds))


def reliabilities(votes: DataFrame, rounds: int = EM_ROUNDS) -> tuple[dict[str, float], dict[str, float]]:
    """(prior of each kind, chance that each labeler's vote is right), by expectation maximisation.

    ``votes`` has one row per kind and pattern of votes, with its count ``n``:
    at most 7 * 3**6 rows whatever the corpus. Each round is one aggregate that
    brings a row of numbers to the driver. Reliabilities stay within 0.55 and
    0.99, which tells the two classes apart; pseudo-counts stand for kinds and
    labelers that were not seen.
    """
    prior, right = dict.fromkeys(KINDS, 0.5), dict.fromkeys(LABELERS, 0.8)
    for _ in range(rounds):
        p = _posterior(prior, right)
        sums = []
        for k in KINDS:
            own = F.when(F.col("kind") == k, F.col("n")).otherwise(0)
            sums += [F.sum(own * F.col("p")).alias(f"p_{k}"), F.sum(own).alias(f"n_{k}")]
        for name in LABELERS:
            v = F.col(f"v_{name}")
            agrees = F.when(v == 1, F.col("p")).when(v == -1, 1 - F.col("p")).otherwise(0.0)
            sums += [F.sum(F.col("n") * agrees).alias(f"a_{name}"), F.sum(F.when(v != 0, F.col("n")).otherwise(0)).alias(f"m_{name}")]
        got = votes.withColumn("p", p).agg(*sums).first().asDict()
        prior = {k: ((got[f"p_{k}"] or 0) + 1) / ((got[f"n_{k}"] or 0) + 2) for k in KINDS}
        right = {name: min(max(((got[f"a_{name}"] or 0) + 4) / ((got[f"m_{name}"] or 0) + 5), 0.55), 0.99)
                 for name in LABELERS}
    return prior, right


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """(id, key, kind, start, end, base, p) for the spans of every row's whole text.

    All base spans, and the other candidates whose probability by the final
    classifier is ``sure`` or more and that overlap no base span. Null and
    empty texts have none; rows repeated with id and text have one set of
    spans; an empty table gives none; only id and text are read. ``key`` is a
    hash of the text, which with the id names a row's text.
    """
    rows = _keyed(docs, id_col, text_col)
    found = cut(candidates(rows).select("*", *[F.expr(v).alias(f"v_{k}") for k, v in LABELERS.items()],
                                        *[F.expr(v).cast("int").alias(f"f_{k}") for k, v in FEATURES.items()])
                .drop("span", "lctx", "rctx"), "pii-candidates")
    names = [f"v_{k}" for k in LABELERS]
    prior, right = reliabilities(cut(found.groupBy("kind", *names).agg(F.count("*").alias("n")), "pii-votes"))
    judged = found.withColumn("p", _posterior(prior, right))
    # The classifier: log ratios of each feature's levels per kind, from the probabilities as soft labels.
    long = judged.select("kind", "p", F.explode(F.array(*[
        F.concat_ws(":", F.lit(k), F.col("kind"), F.col(f"f_{k}")) for k in FEATURES])).alias("level"))
    levels = {r["level"]: (r["yes"], r["no"]) for r in
              long.groupBy("level").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    kinds = {r["kind"]: (r["yes"], r["no"]) for r in
             judged.groupBy("kind").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    odds = F.lit(0.0)
    if levels:
        ratio = {}
        for level, (yes, no) in sorted(levels.items()):
            of_yes, of_no = kinds[level.split(":")[1]]
            ratio[level] = math.log((yes + 0.5) / (of_yes + 1)) - math.log((no + 0.5) / (of_no + 1))
        table = F.create_map(*[F.lit(x) for kv in ratio.items() for x in kv])
        odds = F.expr(_in_kind({k: repr(math.log((y + 1) / (n + 1))) for k, (y, n) in kinds.items()}, "0.0"))
        for k in FEATURES:
            odds = odds + F.element_at(table, F.concat_ws(":", F.lit(k), F.col("kind"), F.col(f"f_{k}")))
    scored = judged.select("id", "key", "kind", "start", "end", "base",
                           (F.lit(1.0) / (1 + F.exp(-odds))).alias("p")).where(f"base or p >= {sure}")
    text = Window.partitionBy("id", "key").orderBy("start", F.col("base").desc(), "end", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(text.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(text.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(F.col("b") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("a") >= F.col("end"), F.lit(True)))
    return (scored.withColumn("b", before).withColumn("a", after).where(F.col("base") | clear).drop("a", "b"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("t"))


def pii_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, counts of the base kinds, digest of the base spans, and all spans."""
    spans = find_pii(docs, id_col=id_col, text_col=text_col, **options)
    place = F.expr(_in_kind({k: str(i) for i, k in enumerate(KINDS)}, "99"))
    item = F.struct(place.alias("o"), "start", "end", "kind")
    per = spans.groupBy("id", "key").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(F.col("base"), item))).alias("base_spans"),
        F.sort_array(F.collect_list(item)).alias("all_spans"))

    def listed(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    per = per.select("id", "key", *[f"n_{k}" for k in BASE], listed("base_spans").alias("b"), listed("all_spans").alias("a"))
    rows = _keyed(docs, id_col, text_col).select(F.col("id").alias("id0"), F.col("key").alias("key0"))
    joined = rows.join(per, rows["id0"].eqNullSafe(per["id"]) & (rows["key0"] == per["key"]), "left")
    return joined.select(
        F.col("id0").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("a", F.lit("")).alias("spans"))
